import zlib
from collections import defaultdict

import numpy as np
import pytest

from strandloom.llm import packing
from strandloom.llm.vocabulary import encode_text, tokenizer


def ids_of(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, documents):
    """Each token of each document row lies in one piece; sequences are gapless and unpadded."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
    for group in sequences.values():
        group.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in group] == list(np.cumsum([0] + [r["length"] for r in group])[:-1])
        size = sum(r["length"] for r in group)
        assert size == group[0]["window"] <= 2048 and size & (size - 1) == 0
    wanted = defaultdict(list)
    for doc_id, text in documents:
        ids = np.array(ids_of(text), "<u4")
        wanted[doc_id, len(ids)].append(ids)
    assert wanted.keys() == pieces.keys()
    for key, texts in wanted.items():
        assert sum(r["length"] for r in pieces[key]) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for r in sorted(pieces[key], key=lambda r: r["start"]):
                assert r["start"] == at and r["ids_crc32"] == zlib.crc32(texts[0][at : at + r["length"]].tobytes())
                at += r["length"]


def test_odd_documents(odd_documents, no_documents):
    rows = packing.pack(odd_documents).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in odd_documents.collect()])
    assert packing.pack(no_documents).count() == 0


def test_tiers_and_steps():
    documents = [(i, "word " * (1 + 37 * i % 3000)) for i in range(400)]
    rows = [dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_id"), r)) for r in packing.pack_stream(documents, 3)]
    check(rows, documents)
    assert {256, 512, 1024, 2048} <= {r["window"] for r in rows}
    steps, windows = defaultdict(int), defaultdict(set)
    for r in rows:
        steps[r["step_id"]] += r["length"]
        windows[r["step_id"]].add(r["window"])
    assert max(steps.values()) == packing.STEP_TOKENS and all(len(w) == 1 for w in windows.values())
    assert rows[0]["sequence_id"] >> 36 == 3


def test_tiers_must_be_powers_of_two(odd_documents):
    with pytest.raises(ValueError):
        packing.pack(odd_documents, tiers=(100, 2048))


@pytest.mark.parametrize("text", ["", " ", "  a", "a  \n b", "<|endoftext|>", "x <|endoftext|>y", "\u00a0\u2003x\x85y", "١٢٣ ½ Ⅷ²", "é\u0301漢字😀👩‍👩‍👧", "\x1c\x1fa", "don't DON'T 'll", "a" * 5000])
def test_fast_encoding_equals_tokenizers(text):
    assert [*encode_text(text), 1] == ids_of(text)


def plain(documents):
    """Lengths of the windows of a packer that cuts the documents' ids, one after the other, at every 2048 and the rest at powers of two."""
    total = sum(len(ids_of(text)) for _, text in documents)
    return [2048] * (total // 2048) + [1 << b for b in range(11) if total % 2048 >> b & 1]


def test_windows_hold_what_plain_packing_holds(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack(frame).collect()
    check(got, rows)
    windows = {r["sequence_id"]: r["window"] for r in got}
    # shorter tiers make more windows, never more tokens than the plain packer's, which pads nothing either
    assert sum(windows.values()) == sum(plain(rows))
    assert sum(r["length"] for r in got) == sum(windows.values())


def test_step_groups_are_equal_over_all_partitions(spark):
    rows = [(i, "word " * (1 + 37 * i % 3000)) for i in range(1000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), step_tokens=16_384).collect()
    check(got, rows)
    tokens, windows = defaultdict(int), defaultdict(set)
    for r in got:
        tokens[r["step_id"]] += r["length"]
        windows[r["step_id"]].add(r["window"])
    assert all(len(w) == 1 for w in windows.values()) and max(tokens.values()) == 16_384
    short = [next(iter(windows[s])) for s, n in tokens.items() if n < 16_384]
    assert len(short) == len(set(short))  # at most one short group of each window length
