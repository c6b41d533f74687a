import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
queries = pytest.importorskip("metricspark.llm.queries")


def test_each_stage_works_on_what_is_left(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_duplicates", "mixing", "bpe"]
    seen = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen, sf).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if name != "bpe":
            assert out.columns == docs.columns
            assert out.join(seen, "doc_id", "left_anti").count() == 0
        if name in ("toxicity", "quality"):
            clean = labels.where("toxic = 0" if name == "toxicity" else "quality = 1").join(seen, "doc_id", "left_semi")
            assert clean.join(out, "doc_id", "left_semi").count() >= 0.97 * clean.count()
        if name == "near_duplicates":
            assert out.count() == out.select("text").distinct().count() and out.count() <= seen.select("text").distinct().count()
        if name == "bpe":
            assert out.count() == seen.count()
        seen = out
    assert corpus_pipeline.run(spark, sf).count() == seen.count()


def test_operator_8_decides_what_is_mixed(spark, sf, monkeypatch):
    """Texts that only its fingerprints link: one of them reaches the mix, all of them if the operator linked nothing."""
    from pyspark.sql import functions as F

    from metricspark.llm import copies, simhash

    paragraph = " ".join(f"p{i}" for i in range(41))
    rows = [(k, " ".join([paragraph] * 30 + [f"t{k}-{i}" for i in range(20)]), "en", "a", 0) for k in range(8)] + [(8, "a text unlike the others", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    fps = [simhash.fingerprint(r[1]) for r in rows]
    assert all((fps[0] ^ f).bit_count() <= 2 for f in fps[:8])
    stages = dict(corpus_pipeline.STAGES)

    def mixed():
        left = stages["near_duplicates"](spark, docs, sf)
        return {r["doc_id"] for r in left.collect()}, {r["doc_id"] for r in stages["mixing"](spark, left, sf).collect()}

    kept, taken = mixed()
    assert kept == {0, 8} and taken and taken <= kept
    monkeypatch.setattr(copies, "near_duplicates", lambda d: d.select("doc_id", F.col("doc_id").alias("component_id")))
    kept, taken = mixed()
    assert kept == set(range(9)) and not taken <= {0, 8}


def test_sql_of_the_mix(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        got = con.sql(sql)
        cols = sorted(df.columns)
        assert cols == sorted(got.columns)
        assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[got.columns.index(c)] for c in cols) for r in got.fetchall())


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
