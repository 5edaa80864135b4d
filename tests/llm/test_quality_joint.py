import corpus_pipeline

from strandloom.llm import quality
from tests.llm.conftest import prose


def none(k=0):
    return {name: [k] * len(cuts) for name, cuts in quality.RULES.items()}


def test_strata_with_few_labels_get_joint_cutoffs():
    joint = {"es": [0] * 3 + [9] * (quality.STEPS - 3), "xx": [0] * quality.STEPS, "en": [9] * quality.STEPS}
    counts = {"es": (307, none()), "xx": (200, none()), "en": (5000, none())}
    model = quality.choose(counts, 0.02, 0.05, joint)
    assert model.cutoffs["es"] == {name: cuts[2] for name, cuts in quality.RULES.items()}
    assert model.cutoffs["en"] == quality.choose(counts, 0.02, 0.05).cutoffs["en"] and model.unproven == ["xx"]


def test_pipeline_stage_drops_junk_of_a_small_stratum(spark, tmp_path):
    good = [(i, prose(i, 60), "es") for i in range(260)]
    bad = [(1000 + i, " ".join(w + "#########" for w in prose(i, 60).split()), "es") for i in range(20)]
    labels = [(i, 1) for i, _, _ in good] + [(i, 0) for i, _, _ in bad]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string").repartition(3)
    assert {r["doc_id"] for r in corpus_pipeline.apply_quality_rules(spark, docs, str(tmp_path)).collect()} == {i for i, _, _ in good}


def test_rules_are_at_work_in_the_registered_query(spark, tmp_path):
    """On the given small tables one stratum has cutoffs, and on a table with junk the query's SQL drops it alike."""
    import duckdb

    from strandloom.llm.queries import QUERIES
    from strandloom.session import table

    small = "/root/testdata/sf0.01"
    model = quality.fit(table(spark, small, "documents"), table(spark, small, "labels"), joint=True)
    assert "en" in model.cutoffs and model.unproven == ["de", "es", "fr"]
    good = [(i, prose(i, 60), "es") for i in range(260)] + [(300 + i, prose(300 + i, 70), None) for i in range(20)]
    bad = [(1000 + i, " ".join(w + "#########" for w in prose(i, 60).split()), "es" if i % 2 else None) for i in range(20)]
    spark.createDataFrame(good + bad, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i, _, _ in good], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r["doc_id"]: r["kept"] for r in QUERIES["op9_quality"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert rows == {r[0]: r[-1] for r in con.execute(quality.oracle_sql()).fetchall()}
    assert not any(rows[1000 + i] for i in range(1, 20, 2)) and all(rows[1000 + i] for i in range(0, 20, 2)) and all(rows[i] for i, _, _ in good)
