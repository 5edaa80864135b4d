import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandloom.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    said = [None if row[f] is None else str(row[f]) for f in merkle.FIELDS]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in said))


def plain_tree(nodes):
    """The root and every node's proof."""
    proofs = [[] for _ in nodes]
    spots = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for leaf, at in enumerate(spots):
            run = runs[at // 16]
            proofs[leaf].append((at % 16, run[: at % 16] + run[at % 16 + 1 :]))
        nodes, spots = [sha("".join(run)) for run in runs], [at // 16 for at in spots]
    return nodes[0], proofs


def plain(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r["source"]].append(((r["doc_id"] is not None, r["doc_id"] or 0), plain_leaf(r), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([leaf for _, leaf, _ in sorted(sources[s], key=lambda x: x[:2])]) for s in order}
    root, above = plain_tree([trees[s][0] for s in order])
    found = []
    for s, upper in zip(order, above):
        for (_, leaf, r), proof in zip(sorted(sources[s], key=lambda x: x[:2]), trees[s][1]):
            whole = proof + upper
            found.append((r["doc_id"], leaf, trees[s][0], root, sha("".join(x for _, others in whole for x in others)), whole))
    return found


def key(rows):
    return sorted((tuple(map(str, r)) for r in rows))


@pytest.mark.parametrize("sizes", [[1], [16, 1], [17, 256, 257], [1, 4097, 15, 300]])
def test_sizes_of_sources(spark, sizes):
    rows = [(1000 * k + i, f"Text {i}", None if k == 1 else "" if k == 2 else f"s{k}") for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"lang": F.lit(None).cast("string"), "n_chars": F.lit(3)})
    want = plain([r.asDict() for r in docs.collect()])
    found = merkle.proofs(merkle.manifest(docs)).collect()
    assert key(r[:5] for r in found) == key(w[:5] for w in want)
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in found)
    altered = merkle.proofs(merkle.manifest(docs, carried={"digest": F.when(F.col("doc_id") % 3 == 0, F.unhex(F.sha2("text", 256)))}), F.col("digest")).collect()
    assert all(r["verified"] == (r["doc_id"] % 3 != 0) for r in altered)
    by_id = {w[0]: w for w in want}
    for r in altered[:20]:
        fold = sha(dict((i, t) for i, t, _ in rows)[r["doc_id"]]) if r["doc_id"] % 3 == 0 else r["leaf"]
        for place, others in by_id[r["doc_id"]][5]:
            fold = sha("".join(others[:place] + [fold] + others[place:]))
        assert r["folded_root"] == fold


def test_odd_rows(odd_documents, no_documents):
    """Nulls, repeats and clashing names; a source's ties go by leaf."""
    want = plain([r.asDict() for r in odd_documents.collect()])
    assert key(r[:5] for r in merkle.proofs(merkle.manifest(odd_documents)).collect()) == key(w[:5] for w in want)
    clashing = odd_documents.withColumns({n: F.lit(7) for n in ("tree", "idx", "digest", "witness", "top", "place", "_part", "_id", "leaf", "root")})
    assert key(r[:5] for r in merkle.proofs(merkle.manifest(clashing)).collect()) == key(w[:5] for w in want)
    assert merkle.proofs(merkle.manifest(no_documents)).collect() == []


def test_witnesses_grow_by_siblings():
    appender = merkle.Appender()
    nodes = [bytes([i]) * 32 for i in range(20)]
    for i, node in enumerate(nodes):
        appender.append(node)
        assert len(appender.witnesses[0]) == (i >= 15)
    assert appender.close(2) == merkle.run_digest([merkle.run_digest(nodes[:16]), merkle.run_digest(nodes[16:])])
    assert [len(w) for w in appender.witnesses] == [2] * 20
    assert all(merkle.folded(n, merkle.packed(w)) == merkle.folded(nodes[0], merkle.packed(appender.witnesses[0])) for n, w in zip(nodes, appender.witnesses))
