import math
import unicodedata
import zlib
from collections import Counter, defaultdict

import pandas as pd

from strandloom.llm import langid


def slow_words(text):
    words, word = [], ""
    for c in (text or "").lower():
        kind = unicodedata.category(c)[0]
        if kind == "L" or (kind == "M" and word):
            word += c
        else:
            words += [word] * bool(word)
            word = ""
    return words + [word] * bool(word)


def slow_grams(word, n):
    marked = word if n == 1 else f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def slow_predictor(documents):
    """A predictor learned from (doc_id, text, lang) of the training folds, by plain counting."""
    counts = defaultdict(lambda: defaultdict(Counter))  # kind -> language -> token
    for doc_id, text, lang in documents:
        if text is None or lang is None or zlib.crc32(str(doc_id).encode()) % 5 == 0:
            continue
        for word in slow_words(text):
            counts[0][lang][word] += 1
            for n in (4, 3, 2, 1):
                counts[n][lang].update(slow_grams(word, n))
    languages = sorted(counts[0])
    known = {kind: set().union(*by.values()) for kind, by in counts.items()}
    totals = {(kind, lang): sum(counts[kind][lang].values()) for kind in counts for lang in languages}

    def score(kind, lang, token):
        return math.log((counts[kind][lang][token] + 0.5) / (totals[kind, lang] + 0.5 * len(known[kind]) + 0.5))

    def predict(text):
        words = slow_words(text)
        if not words or not languages:
            return "und", 0.0
        sums = dict.fromkeys(languages, 0.0)
        for word in words:
            kind, tokens = 0, [word] * (word in known[0])
            while not tokens and kind < 4:
                kind += 1
                tokens = [g for g in slow_grams(word, 5 - kind) if g in known[5 - kind]]
            order = 0 if kind == 0 else 5 - kind
            for lang in languages:
                sums[lang] += sum(score(order, lang, t) for t in tokens) / max(1, len(tokens))
        best = max(languages, key=lambda x: sums[x])
        return best, 1 / sum(math.exp(s - sums[best]) for s in sums.values())

    return predict


def test_against_plain_counting(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    predict = slow_predictor(rows)
    texts = {i: t for i, t, _ in rows}
    for r in langid.predict(docs, langid.fit(docs)).collect():
        lang, score = predict(texts[r["doc_id"]])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-3


def test_letters():
    model = langid.build(pd.DataFrame([("de", 0, "wort", 1), ("en", 0, "word", 1)], columns=["lang", "kind", "token", "n"]))
    for text in ("\u00bd", "\u00b2\u00b3", "\u2460", "12", "\u0301", "!"):
        assert model.predict(text) == ("und", 0.0)
    assert langid.words_of("\u0939\u093f\u0928\u094d\u0926\u0940 a1b \u0301c") == slow_words("\u0939\u093f\u0928\u094d\u0926\u0940 a1b \u0301c") == ["\u0939\u093f\u0928\u094d\u0926\u0940", "a", "b", "c"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 100 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_words_then_shorter_and_shorter_grams():
    rows = [("a", 0, "hello", 5, 5), ("b", 0, "salut", 5, 5)]
    rows += [(lang, n, g, 3, 9) for lang, word in (("a", "hello"), ("b", "salut")) for n in langid.ORDERS for g in langid.grams_of(word, n)]
    model = langid.build(pd.DataFrame(rows, columns=["lang", "kind", "token", "n", "total"]))
    assert model.predict("Hello, HELLO 12")[0] == "a"
    assert model.predict("salutation")[0] == "b"
    assert model.predict("xxe")[0] == "a" and model.predict("xxs")[0] == "b"
    assert model.predict("zzz") == ("a", 0.5)  # nothing known: even, the first by name
    assert model.predict("12 !?") == model.predict("") == model.predict(None) == ("und", 0.0)


def test_odd_documents(spark, odd_documents, no_documents):
    model = langid.fit(odd_documents)
    rows = langid.predict(odd_documents, model).collect()
    assert len(rows) == odd_documents.count()
    by_text = {r["doc_id"]: r for r in rows}
    assert all(by_text[i]["lang_pred"] == "und" and by_text[i]["score"] == 0 for i in (2, 3, 4, 10))
    assert all(r["held_out"] is False for r in rows if r["doc_id"] is None)
    assert all(r["lang_pred"] in {*model.languages, "und"} for r in rows)
    empty = langid.fit(no_documents)
    assert empty.languages == [] and langid.predict(no_documents, empty).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd_documents, empty).collect()} == {"und"}
    assert langid.keep(odd_documents, model).columns == odd_documents.columns
