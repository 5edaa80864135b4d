import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from strandloom.llm import token_files
from strandloom.llm.vocabulary import encode_runs, tokenizer
from strandloom.session import Workspace
from tests.llm.conftest import SF


def want(rows):
    """Rows of the digest, by plain means; ties in the order of Spark's XXH64 are left to the caller."""
    found, at = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer(token_files.WORD_BPE).encode(text or "", add_special_tokens=False).ids, 1]
        found.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return found


def written(spark, docs, **options):
    work = Workspace(spark, "tokens")
    token_files.write(docs, f"{work.folder}/files", **options)
    return work, f"{work.folder}/files"


def test_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    work, folder = written(spark, docs)
    rows = sorted(token_files.digest(token_files.read(spark, folder), work).collect(), key=lambda r: r["start"])
    given = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    assert [tuple(r) for r in rows] == want(given)
    some = [given[7][0], given[100][0], -5]
    asked = token_files.read(spark, folder, some).collect()
    whole = {r["doc_id"]: r["ids"] for r in token_files.read(spark, folder).collect()}
    assert {r["doc_id"]: r["ids"] for r in asked} == {i: whole[i] for i in some[:2]}
    assert token_files.read(spark, folder, []).count() == 0


def test_odd_rows(spark, odd_documents, no_documents):
    hashed = {r["doc_id"]: r["h"] for r in odd_documents.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    clashing = odd_documents.withColumns({n: F.lit("x") for n in ("ids", "file", "_hash", "_copy", "place")})
    work, folder = written(spark, clashing)
    rows = sorted(token_files.digest(token_files.read(spark, folder), work).collect(), key=lambda r: r["start"])
    given = [(r["doc_id"], r["text"]) for r in odd_documents.withColumn("h", F.xxhash64("text")).orderBy(F.asc_nulls_first("doc_id"), F.asc_nulls_first("h")).collect()]
    assert hashed and sorted(map(str, (tuple(r) for r in rows))) == sorted(map(str, want(given)))
    work, folder = written(spark, no_documents)
    assert token_files.digest(token_files.read(spark, folder), work).count() == 0


def test_one_id_for_all_is_dealt_out(spark):
    docs = spark.range(4000).selectExpr("7 as doc_id", "concat('text ', id) as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few bytes would be one partition
    work, folder = written(spark, docs)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = token_files.read(spark, folder)
    assert rows.select("file").distinct().count() > 1 and rows.count() == 4000


def test_file_format(tmp_path):
    rng = random.Random(3)
    lengths = [0, 3, 40, 200, 0, 63, 64, 65, 1, 128, 0]
    docs = [np.array([rng.randrange(60_000) for _ in range(n)], np.int32) for n in lengths]
    path = tmp_path / "x"
    with open(path, "wb") as out:
        writer = token_files.FrameWriter(out, 2, 64)
        for i, ids in enumerate(docs):
            writer.add(None if i == 2 else i * 10, ids)
        writer.finish()
    raw = path.read_bytes()
    # any reader of zstandard streams passes over the tables
    content = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert content == np.concatenate(docs).astype("<u2").tobytes()
    with open(path, "rb") as source:
        found = token_files.FrameFile(source, len(raw))
        assert [found.document(i).tolist() for i in range(len(docs))] == [d.tolist() for d in docs]
        assert found.known.tolist() == [i != 2 for i in range(len(docs))] and all(found.frames["length"] <= 128)
        for step in (1, 7, 50, 10_000):  # every document begins in one range
            parts = [found.beginning_in(a, a + step) for a in range(0, len(raw), step)]
            assert [p for part in parts for p in part] == list(range(len(docs)))
        found.source.read = None  # the index is at hand: a document reads its own frames alone
        read = []
        found._read = lambda at, n: read.append(at) or raw[at : at + n]
        found.document(3)
        held = np.flatnonzero((found.tokens[1:] > found.doc_starts[3]) & (found.tokens[:-1] < found.doc_starts[3] + 200))
        assert read == found.starts[held].tolist() and len(read) < len(found.frames)


@pytest.mark.parametrize("where", ["frame", "index", "table"])
def test_damage_is_seen(tmp_path, where):
    path = tmp_path / "x"
    with open(path, "wb") as out:
        writer = token_files.FrameWriter(out, 4)
        writer.add(1, np.arange(5000, dtype=np.int32))
        writer.finish()
    raw = bytearray(path.read_bytes())
    size = int(np.frombuffer(raw[-token_files.FOOTER.itemsize - token_files.ENTRY.itemsize :], token_files.ENTRY, 1)["size"][0])
    at = {"frame": size // 2, "index": size + 20, "table": len(raw) - 1}[where]
    raw[at] ^= 0x55
    path.write_bytes(raw)
    with open(path, "rb") as source, pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.FrameFile(source, len(raw)).document(0)


def test_ids_that_do_not_fit(tmp_path):
    with open(tmp_path / "x", "wb") as out, pytest.raises(ValueError):
        token_files.FrameWriter(out, 2).add(1, np.array([70_000], np.int32))


def test_runs_and_the_library():
    rng = random.Random(5)
    letters = 3 * list("ßÀÖØÿŒœ'st.,9aZé") + list(" \t\n\r\x0b\x0c\x1c\x85  　aABZ's-_<|>13éßÀÖØÿŒœ×÷²ª\x00漢😀ΣσİIŉﬁ̈​̸=") + ["<|endoftext|>", "<|startoftext|>", " ", "'s"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(4000)] + [None, "", "  ", "x" * 100_000, " " * 100_000]
    offsets, ids = token_files.encode_column(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == [*tokenizer(token_files.WORD_BPE).encode(text or "", add_special_tokens=False).ids, 1]


def test_texts_are_encoded_where_they_are_written(spark, monkeypatch):
    """One Python process a task: no second one encodes before the writer."""
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "Word " * 50)], "doc_id long, text string")
    given = []
    plain = type(docs).write.fget
    monkeypatch.setattr(type(docs), "write", property(lambda self: given.append(self._jdf.queryExecution().toString()) or plain(self)))
    work, folder = written(spark, docs)
    assert len(given) == 1 and "MapInArrow" not in given[0]
    monkeypatch.undo()
    rows = sorted(token_files.digest(token_files.read(spark, folder), work).collect(), key=lambda r: r["start"])
    assert [tuple(r) for r in rows] == want([(1, "a b"), (2, None), (3, "Word " * 50)])
    work, folder = written(spark, docs, end=None)
    assert [len(r["ids"]) for r in token_files.read(spark, folder).orderBy("doc_id").collect()][1] == 0


def test_folder_with_files_is_not_written_again(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    _, folder = written(spark, docs)
    with pytest.raises(Exception, match="holds token files"):
        token_files.write(docs, folder)
    assert token_files.read(spark, folder).count() == 1


def test_fast_runs_and_the_library(spark):
    """Every distinct run of the documents, and made-up ones of the letters that go the fast way."""
    runs = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").selectExpr("explode(split(text, '[ \\n]+')) as run").distinct().collect()]
    rng = random.Random(9)
    runs += ["".join(rng.choice("aeinrstlhou'dgßÀÖéüœ.,;!0-9ABT") for _ in range(rng.randrange(1, 30))) for _ in range(20_000)]
    for some in (runs, [], [""], ["<|endoftext|>", "ΑΣ"]):
        ids, counts = encode_runs(some, token_files.WORD_BPE)
        want = [e.ids for e in tokenizer(token_files.WORD_BPE).encode_batch(some, add_special_tokens=False)]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
