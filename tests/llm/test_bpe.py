import hashlib

import numpy as np

from strandloom.llm import bpe
from strandloom.llm.vocabulary import tokenizer


def test_encode_and_decode(spark, odd_documents, no_documents):
    given = sorted((str(r["doc_id"]), r["text"] or "") for r in odd_documents.collect())
    wanted = [(i, tokenizer().encode(t, add_special_tokens=False).ids) for i, t in given]
    encoded = bpe.encode(odd_documents, chunk_bytes=50)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in encoded.collect()) == sorted(wanted)
    decoded = bpe.decode(encoded, bpe.pieces(spark))
    assert sorted((str(r["doc_id"]), r["text"]) for r in decoded.collect()) == given
    assert bpe.encode(no_documents).count() == 0


def test_round_trip(spark, odd_documents):
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    rows = bpe.round_trip(odd_documents, bpe.pieces(spark)).collect()
    wanted = []
    for r in odd_documents.collect():
        ids = tokenizer().encode(r["text"] or "", add_special_tokens=False).ids
        wanted.append((str(r["doc_id"]), len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tokenizer().decode(ids, skip_special_tokens=False).encode())))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == sorted(wanted)


def test_invalid_bytes_decode_as_the_library_does(spark):
    ids = [[i, j] for i in range(120, 190, 3) for j in range(94, 250, 7)]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(ids)], "doc_id long, ids array<int>")
    for r in bpe.decode(frame, bpe.pieces(spark)).collect():
        assert r["text"] == tokenizer().decode(ids[r["doc_id"]], skip_special_tokens=False)


def test_equal_chunks(spark):
    docs = spark.createDataFrame([(1, "same words here")] * 6, "doc_id long, text string").repartition(6)
    assert [r["ids"] for r in bpe.encode(docs, chunk_bytes=1).collect()] == [tokenizer().encode("same words here").ids] * 6
