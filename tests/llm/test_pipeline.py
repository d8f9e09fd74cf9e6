import os

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from opsdesk.llm import decontam
from opsdesk.llm.common import cut, read

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = read(spark, DATA, "documents"), []
    out.append(("documents", docs))
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, DATA))
        out.append((name, docs))
    return dict(out)


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    for name in ("toxicity", "line_dedup", "near_dedup", "decontamination"):
        assert stages[name].columns == stages["documents"].columns


def test_toxic_documents_go_and_clean_ones_stay(stages, spark):
    labels = read(spark, DATA, "labels").where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    before = stages["documents"].join(labels, "doc_id").groupBy("toxic").count().collect()
    after = stages["toxicity"].join(labels, "doc_id").groupBy("toxic").count().collect()
    n, m = ({r.toxic: r["count"] for r in x} for x in (before, after))
    assert m[0] >= 0.97 * n[0] and m.get(1, 0) <= 0.05 * n[1]


def test_line_dedup_leaves_one_of_each_line(stages):
    lines = stages["line_dedup"].select(F.explode(F.split("text", "\n")).alias("x")).select(F.trim("x").alias("x")).where(F.length("x") >= 20)
    assert lines.groupBy("x").count().where("count > 1").count() == 0
    had = stages["toxicity"].select(F.explode(F.split("text", "\n")).alias("x")).select(F.trim("x").alias("x")).where(F.length("x") >= 20).distinct()
    assert lines.distinct().count() >= 0.9 * had.count()


def test_near_dedup_keeps_one_of_each_group(stages):
    from test_neardup import brute

    rows = [(r.doc_id, r.text) for r in stages["line_dedup"].select("doc_id", "text").collect()]
    assert {r.doc_id for r in stages["near_dedup"].collect()} == {i for i, root in brute(rows, 5, 80).items() if i == root}


def test_no_leak_is_left(stages, spark):
    bench = read(spark, DATA, "benchmark")
    gone = {r.doc_id for r in decontam.contaminated(stages["near_dedup"], bench, min_match=5, coverage=0.5).select("doc_id").distinct().collect()}
    assert gone and {r.doc_id for r in stages["near_dedup"].collect()} - {r.doc_id for r in stages["decontamination"].collect()} == gone


def test_mixing_reads_every_document_at_least_once(stages):
    ids = {r.doc_id for r in stages["decontamination"].collect()}
    read_ids = stages["mixing"].groupBy("doc_id").count().collect()
    assert {r.doc_id for r in read_ids} == ids and max(r["count"] for r in read_ids) <= 3


def test_run_and_empty_input(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        read(spark, DATA, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_repeated_rows_and_extra_columns(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "one text\nof two lines", "en", "s", 20), (1, "one text\nof two lines", "en", "s", 20), (2, "", None, None, 0), (3, "x" * 100_000, "en", None, 100_000)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("clash")).withColumn("line", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.columns, cut(stage(spark, docs, DATA))
        assert name == "mixing" or docs.columns == before
    assert {r.doc_id for r in docs.collect()} >= {1, 2, 3}
