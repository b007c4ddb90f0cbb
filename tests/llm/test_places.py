"""Rows are told apart by what stands in the data: other cores between planning and reading change nothing."""

import re
from collections import Counter

import pytest
from helpers import odd_docs, write_docs
from pyspark.sql import functions as F

from steadfield.llm import bag_minhash, common, exact_dedup, line_dedup, mixing


@pytest.fixture
def cores(spark):
    """Sets what Spark takes for the number of cores when it cuts files into tasks."""
    key = "spark.sql.files.minPartitionNum"

    def put(n):
        spark.conf.set(key, n)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", n)

    yield put
    for k in (key, "spark.sql.leafNodeDefaultParallelism"):
        spark.conf.unset(k)


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture
def docs(spark, tmp_path):
    return write_docs(spark, str(tmp_path / "docs"), [(*r, f"s{k % 6}") for k, r in enumerate(odd_docs() * 2)], parts=3)


@pytest.mark.parametrize("operator", [exact_dedup.drop_copies, bag_minhash.keep_one, line_dedup.remove_boilerplate, mixing.take], ids=["exact", "near", "lines", "mix"])
def test_other_cores_between_plan_and_reading(docs, cores, operator):
    cores(4)
    plan = operator(docs)
    first = rows_of(plan)
    assert first
    cores(1)
    assert rows_of(plan) == first  # read again
    cores(7)
    plan = operator(docs)
    cores(2)
    assert rows_of(plan) == first


def test_exact_against_plain_python_with_other_cores(docs, cores):
    cores(5)
    plan = exact_dedup.drop_copies(docs)
    cores(2)
    kept = [r.text for r in plan.collect()]
    fold = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    assert Counter(map(fold, kept)) == Counter({fold(r.text) for r in docs.collect()})


def test_a_place_is_one_row(spark, docs):
    clash = docs.withColumn("place", F.lit(1)).withColumn("_metadata", F.lit("mine"))
    for df in (docs, clash, docs.repartition(2), docs.filter("doc_id > 3"), docs.limit(0), docs.join(docs.select("doc_id").distinct(), "doc_id")):
        got, place = common.placed(df, "test-places")
        assert got.columns == [*df.columns, place]
        assert got.select(place).distinct().count() == df.count()
