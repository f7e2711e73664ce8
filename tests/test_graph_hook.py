"""A user's extractor as a table function, and summaries from one scan."""

from __future__ import annotations

import statistics

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodeline.operators import graph
from lodeline.operators.aggregates import dataset_summary, describe_numeric


def extractors():
    """A function, and a class with a state per task; defined here so that they are sent to the workers whole."""

    def pairs(text):
        words = text.split()
        return [(a, b, "then") for a, b in zip(words, words[1:])]

    class Counted:
        def __init__(self):
            self.kind = "then"

        def eval(self, text: str):
            for a, b, _ in pairs(text):
                yield a, b, self.kind

    return [pairs, Counted]


@pytest.mark.parametrize("extractor", extractors())
def test_extractor(spark, extractor):
    df = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None), (4, "a b"), (4, "a b")], "doc_id long, text string")
    found = graph.extract_triples(df, extractor)
    want = [(1, "a", "b", "then"), (1, "b", "c", "then"), (4, "a", "b", "then"), (4, "a", "b", "then")]
    assert rows(found, "doc_id", "source", "target", "type") == want
    nodes, edges = graph.build_graph_tables(found)
    assert rows(edges, "source", "target", "weight") == [("a", "b", 3), ("b", "c", 1)]
    assert rows(nodes, "id", "mentions") == [("a", 3), ("b", 4), ("c", 1)]


def test_describe_reads_once(spark, tmp_path):
    data = [(1.0, 5, None), (2.0, 5, None), (2.0, 7, None), (None, -1, None)]
    spark.createDataFrame(data, "a double, b int, c double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = {r["column"]: r for r in describe_numeric(df, ["a", "b", "c"]).collect()}
    assert tuple(got["c"])[1:] == (0, None, None, None, None, None, None, None)
    b = [5, 5, 7, -1]
    assert got["b"]["count"] == 4 and got["b"]["mean"] == 4 and got["b"]["std"] == pytest.approx(statistics.stdev(b))
    assert [got["b"][c] for c in ("min", "p25", "p50", "p75", "max")] == [-1, 3.5, 5, 5.5, 7]
    assert [got["a"][c] for c in ("count", "p50", "max")] == [3, 2, 2]
    near = {r["column"]: r for r in describe_numeric(df, ["a", "b"], approximate=True).collect()}
    assert near["b"]["p50"] == 5 and near["a"]["min"] == 1


def test_summary(spark):
    df = spark.createDataFrame([(1, 1, 4.0), (1, 2, 5.0), (2, 1, None)], "user long, item long, rating double")
    got = {r["metric"]: r["value"] for r in dataset_summary(df).collect()}
    assert got == {"rows": 3, "users": 2, "items": 2, "ratings_per_user": 1.5, "ratings_per_item": 1.5, "mean_rating": 4.5, "median_rating": 4.5}
    empty = {r["metric"]: r["value"] for r in dataset_summary(df.where(F.lit(False))).collect()}
    assert empty["users"] == 0 and empty["median_rating"] is None
