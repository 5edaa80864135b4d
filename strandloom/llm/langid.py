"""Language identification by words first and shorter and shorter character n-grams after.

A known word scores its log frequency in each language. An unseen word is scored by its character n-grams of the
longest order of which it has a known one, from four characters down to one; the mean of that order's known
n-grams counts for the word. A document's scores are sums over all its words; its language is the best sum.

A word is a run of letters and combining marks that begins with a letter. Counting runs in Spark over a bounded
sample of labelled documents: at most `docs_per_language` of each language in expectation, chosen by a hash of the
id and the text. The model has every word and n-gram of the sample, so the sample bounds it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNDETERMINED = "und"
ORDERS = (4, 3, 2, 1)
DOCS_PER_LANGUAGE = 600
FOLDS = 5
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+")


def held_out(doc_id: Column) -> Column:
    """True for the fold that training never sees: crc32 of the id as text is 0 modulo FOLDS; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, order: int) -> list[str]:
    """The n-grams of a word between boundary marks; the marks alone count only within longer n-grams."""
    if order == 1:
        return list(word)
    marked = f"^{word}$"
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


@dataclass
class LanguageModel:
    languages: list[str]
    words: dict[str, int]  # row of each word in `scores`
    grams: dict[str, int]  # row of each n-gram
    scores: np.ndarray  # log frequencies, a column for each language

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its posterior under equal priors; (und, 0) without letters or without a trained language."""
        counts = Counter(words_of(text)) if text else None
        if not counts or not self.languages:
            return UNDETERMINED, 0.0
        rows: list[int] = []
        weights: list[float] = []
        known_words, known_grams = self.words.get, self.grams.get
        for word, n in counts.items():
            row = known_words(word)
            if row is not None:
                rows.append(row)
                weights.append(n)
                continue
            for order in ORDERS:
                found = [r for g in grams_of(word, order) if (r := known_grams(g)) is not None]
                if found:
                    rows += found
                    weights += [n / len(found)] * len(found)
                    break
        total = np.asarray(weights) @ self.scores[rows] if rows else np.zeros(len(self.languages))
        best = int(total.argmax())  # languages are sorted, so ties go to the first name
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def _counted(sample: DataFrame) -> DataFrame:
    """(lang, kind, token, n) of a sample (text, lang); kind 0 for words, else the n-gram's order."""
    schema = "lang string, kind int, token string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, Counter()).update(words_of(text))
            found: Counter = Counter()
            for lang, words in by_lang.items():
                for word, n in words.items():
                    found[lang, 0, word] += n
                    for order in ORDERS:
                        for gram in grams_of(word, order):
                            found[lang, order, gram] += n
            if found:
                lang, kind, token = zip(*found)
                columns = [pa.array(lang), pa.array(kind, pa.int32()), pa.array(token), pa.array(list(found.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "kind", "token", "n"])

    return sample.mapInArrow(run, schema).groupBy("lang", "kind", "token").agg(F.sum("n").alias("n"))


def fit(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE, smoothing: float = 0.5
) -> LanguageModel:
    """Learns from rows with a text and a language whose id is not held out; of each language a sample, see above."""
    usable = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & ~held_out(F.col("id"))
    )
    sizes = usable.groupBy("lang").count().collect()
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, docs_per_language / r["count"]))]) if sizes else F.lit(None)
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) / 1_000_000  # by both: many rows may have one id, or none
    sample = usable.filter(F.col("text").isNotNull() & (draw < (share[F.col("lang")] if sizes else F.lit(0.0)))).select("text", "lang")
    # bounded by the sample; tokens are grouped by their codes, which takes the driver less memory
    return build(_counted(sample).toPandas().astype({"token": "category"}), smoothing)


def build(table: pd.DataFrame, smoothing: float = 0.5) -> LanguageModel:
    """The model of counts (lang, kind, token, n); smoothing is added to each count, unseen tokens among them."""
    languages = sorted(set(table["lang"]))
    keys = table.groupby(["kind", "token"], sort=True, observed=True).ngroup().to_numpy()
    where = table["lang"].astype(pd.CategoricalDtype(languages)).cat.codes.to_numpy()
    counts = np.zeros((keys.max() + 1 if len(table) else 0, len(languages)))
    np.add.at(counts, (keys, where), table["n"].to_numpy(float))
    tokens = table.assign(key=keys).drop_duplicates("key").sort_values("key")
    kinds = tokens["kind"].to_numpy(int)
    scores = np.zeros_like(counts)
    for kind in set(kinds.tolist()):
        of_kind = counts[kinds == kind]
        scores[kinds == kind] = np.log((of_kind + smoothing) / (of_kind.sum(axis=0) + smoothing * len(of_kind) + smoothing))
    words = kinds == 0
    row = dict(zip(tokens["token"][words], np.flatnonzero(words).tolist()))
    gram_row = dict(zip(tokens["token"][~words], np.flatnonzero(~words).tolist()))
    return LanguageModel(languages, row, gram_row, scores.astype(np.float32))


def predict(documents: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, lang_pred and score of every row.

    A null text or one without letters (Unicode's, so neither digits nor fractions) is `und` with score 0; so is every text where no language was learned.
    Repeated rows are judged one by one, texts of any length whole; no rows give none. Other columns, the
    language's own among them, are neither read nor carried.
    """
    source = documents.select(id_col, text_col)
    given = source.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it was fitted on
    schema = T.StructType([T.StructField(id_col, source.schema[0].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [given.value.predict(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema).select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")


def keep(documents: DataFrame, model: LanguageModel, *, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows with a determined language of at least min_score, with all their columns."""
    given = documents.sparkSession.sparkContext.broadcast(model)
    text_at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [given.value.predict(t) for t in batch.column(text_at).to_pylist()]
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= min_score for lang, score in found], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
