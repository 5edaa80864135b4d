import corpus_pipeline
from strandloom.llm import packing
from tests.llm.conftest import SF
from tests.llm.test_jaccard import brute
from tests.llm.test_langid import slow_predictor
from tests.llm.test_packing import check
from tests.llm.test_quality import slow


def passes(text):
    """The base check. None of the strata of these tables has the labels that a cutoff needs."""
    n_words, _, _, _, n_repeat = slow(text)
    return n_words >= 50 and 100 * n_repeat <= 50 * n_words


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = set(rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = docs
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name == "language_id":
            predict = slow_predictor([(i, rows[i]["text"], rows[i]["lang"]) for i in kept])
            want = {i for i in kept if (p := predict(rows[i]["text"]))[0] != "und" and p[1] >= 0.5}
        elif name == "quality_rules":
            assert labels.filter("quality = 1").count() < 148  # at 2% and 5%, fewer show nothing even in one stratum
            want = {i for i in kept if passes(rows[i]["text"])}
        elif name == "near_dedup":
            want = {int(i) for i in brute([(i, rows[i]["text"]) for i in kept])}
        else:
            check(docs.collect(), [(i, rows[i]["text"]) for i in kept])
            break
        assert {r["doc_id"] for r in docs.collect()} == want and docs.count() == len(want) and docs.columns == given.columns
        assert 0.5 * len(kept) < len(want) <= len(kept)
        kept = want
    # windows depend on how documents are dealt out, what they hold does not
    check(corpus_pipeline.run(spark, SF).collect(), [(i, rows[i]["text"]) for i in kept])


def test_odd_rows_go_through(spark, odd_documents, no_documents, tmp_path):
    for n, docs in enumerate((odd_documents, no_documents)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{n}-{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{n}-{k}"))
    assert packing.pack(no_documents).count() == 0


def test_guard_lets_the_rest_stand():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names
