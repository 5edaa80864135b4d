"""Texts with very long runs go through every operator on documents and give what plainer ways give."""

import hashlib
import zlib

import numpy as np
import pytest

from strandloom.llm import bpe, chat, langid, packing, quality, simhash
from strandloom.llm.vocabulary import encode_text, encode_with_offsets, tokenizer
from tests.llm.test_packing import check
from tests.llm.test_quality import slow
from tests.llm.test_simhash import slow_fingerprint

N = 2_000_000
RUNS = {1: " " * N, 2: "\n" * N, 3: "start" + " \n\t " * (N // 4) + "end of it", 4: "a word " + "x" * 300_000 + " and more", 5: " " * 30_000 + "<|endoftext|>" + " " * 9000 + "<|endoftext|>tail"}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in RUNS.items()], "doc_id long, text string, lang string, source string").repartition(2)


@pytest.fixture(scope="module")
def ids():
    return {i: tokenizer().encode(t, add_special_tokens=False).ids for i, t in RUNS.items()}


def test_ids(ids):
    for i, text in RUNS.items():
        assert encode_text(text) == ids[i]


@pytest.mark.parametrize("text", ["a" + " " * 5000 + "\n" * 5000 + "b", "\n" * 5000 + " b", "<turn>" + " " * 5000 + "</turn>x", " \n" + "y" * 5000 + "  z", "é" * 5000 + "'s", "\x1c" * 5000])
def test_markers_and_offsets(text):
    encoded = chat.chat_tokenizer().encode(text, add_special_tokens=False)
    got, offsets = encode_with_offsets(text, added=chat.MARKERS)
    assert got.tolist() == encoded.ids and [tuple(x) for x in offsets.tolist()] == encoded.offsets


def test_packing(documents):
    check(packing.pack(documents).collect(), list(RUNS.items()))


def test_round_trip(spark, documents, ids):
    for r in bpe.round_trip(documents, bpe.pieces(spark)).collect():
        text = RUNS[r["doc_id"]]
        assert r["n_tokens"] == len(ids[r["doc_id"]]) and r["ids_sha256"] == hashlib.sha256(np.array(ids[r["doc_id"]], "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_chat(spark):
    rows = [(i, k, role, t) for i, t in RUNS.items() for k, role in enumerate(("user", "assistant"))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.digest(chat.format_conversations(frame)).collect():
        text = RUNS[r["conv_id"]]
        assert r["loss_chars"] == len(text) and r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_fingerprints_and_measures(documents):
    rows = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(documents).collect()}
    assert rows == {i: f"{slow_fingerprint(t):016x}" for i, t in RUNS.items()}
    model = quality.QualityModel()
    for r in quality.judge(documents, model).collect():
        if r["doc_id"] != 2:  # a million equal lines are too much for the plain count
            assert tuple(r[c] for c in quality.COUNTS) == slow(RUNS[r["doc_id"]])
        assert r["base_failed"] and not r["kept"]


def test_languages(documents):
    rows = {r["doc_id"]: r for r in langid.predict(documents, langid.fit(documents)).collect()}
    assert all(rows[i]["lang_pred"] == "und" for i in (1, 2)) and all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in RUNS)
