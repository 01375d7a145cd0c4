"""The pipeline against its stages done by brute force, on the smallest tables."""

import os

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from stylecast.llm import decontaminate, lines, quality  # noqa: E402

from .test_operators import components_of  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_pipeline_keeps_what_its_stages_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = quality.judged(docs).where("kept").select("doc_id")
    con = duckdb.connect()
    con.register("documents", docs.join(kept, "doc_id").toPandas())
    texts = [(i, t) for i, t in con.execute(f"SELECT doc_id, text FROM ({lines.LINES_SQL})").fetchall() if t and t.split()]
    firsts = {c for _, c in components_of(texts).values()}
    left = spark.createDataFrame([(i, t) for i, t in texts if i in firsts], "doc_id long, text string")
    bad = {r.doc_id for r in decontaminate.contaminated(left, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == firsts - bad and min(got.values()) > 0


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
