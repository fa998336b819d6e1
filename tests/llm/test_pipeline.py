import duckdb
import pytest

import corpus_pipeline
from loomwork.llm import linededup, mixing, neardup, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returns, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        out.append((docs, spark.read.parquet(f"{folder}/{k}")))
        docs = out[-1][1]
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").distinct().collect())


def test_stages_keep_the_columns(stages):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "mixing", "packing"]
    for before, after in stages[:-1]:
        assert before.columns == columns and after.columns == columns


def test_toxic_documents_go(spark, stages):
    before, after = stages[0]
    scores = toxicity.toxicity(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == ids(scores.where("predicted = 0"))


def test_boilerplate_lines_go_as_sql_says(stages, tmp_path):
    before, after = stages[1]
    before.write.parquet(f"{tmp_path}/d")
    sql = linededup.ORACLE.format(documents="d") + "SELECT doc_id, CASE WHEN less THEN array_to_string(kept, chr(10)) ELSE text END AS text FROM decided"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW d AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted(con.execute(sql).fetchall())
    assert sorted((r["doc_id"], r["text"]) for r in after.collect()) == want
    assert after.where("n_chars <> length(text)").count() == 0


def test_one_document_of_each_group_stays(stages):
    before, after = stages[2]
    assert ids(after) == ids(neardup.near_duplicates(before).where("kept"))
    assert after.count() == len(ids(after))


def test_mixing_keeps_rows_whole(stages):
    before, after = stages[3]
    assert after.exceptAll(before).count() == 0
    total = lambda df: df.select(mixing.tokens(df["text"]).alias("t")).agg({"t": "sum"}).first()[0]
    assert 0.6 < total(after) / total(before) < 1.0


def test_all_documents_are_packed(stages):
    before, after = stages[4]
    assert ids(after) == ids(before)
    per_doc = {r["doc_id"]: (r["n"], r["t"]) for r in after.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).toDF("doc_id", "n", "t").collect()}
    assert all(n == t for n, t in per_doc.values())


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_rows_without_ids_and_repeated_rows(spark):
    rows = [(None, "alone in the world", "en", "s", 18), (1, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.without_near_duplicates(spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1]
