"""A stored inverted file over unit vectors: k-means cells, several cells per query, exact re-ranking.

The index is a folder: ``centers`` (one row per cell) and ``vectors`` (id, vector, cell), partitioned by
cell, so a search reads the cells it probes. New vectors go to the cell of their nearest center and are
appended; the centers stay as they were fitted, and nothing is built again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.operators.aggregates import topk_per_group
from lodeline.operators.vectors import SIM_DIGITS

# Centers are fitted on a sample of at most this many vectors per cell.
SAMPLE_PER_CELL = 256
MAX_CELLS = 4_096
# Rows of one cell that meet its queries in one task.
CELL_ROWS = 50_000
QUERY_ROWS = 1_024


class VectorIndex:
    """Open an index with ``VectorIndex(spark, path)``; make one with ``build``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/centers").orderBy("cell").limit(MAX_CELLS).collect()
        self.centers = np.array([r["center"] for r in rows])

    @staticmethod
    def build(corpus: DataFrame, path: str, *, cells: int | None = None, id: str = "id", vector: str = "embedding", seed: int = 42) -> VectorIndex:
        """Fit the centers and store all vectors. ``cells`` is the root of the number of vectors by default."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark, path = corpus.sparkSession, path.rstrip("/")
        good = _unit(corpus, id, vector)
        n = good.count()
        cells = max(1, min(cells or round(n**0.5), MAX_CELLS, n // 2))
        share = min(1.0, 1.2 * cells * SAMPLE_PER_CELL / max(1, n))
        sample = good.sample(share, seed).limit(cells * SAMPLE_PER_CELL) if share < 1 else good
        sample = sample.select(array_to_vector("v").alias("features"))
        if cells == 1:
            # One cell holds everything, wherever its center lies.
            centers = [np.zeros(len(good.first()["v"]) if n else 1)]
        else:
            centers = KMeans(k=cells, seed=seed, maxIter=15).fit(sample).clusterCenters()
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
        spark.createDataFrame(rows, "cell int, center array<double>").coalesce(1).write.parquet(f"{path}/centers")
        index = VectorIndex(spark, path)
        index._append(good)
        return index

    def add(self, corpus: DataFrame, *, id: str = "id", vector: str = "embedding") -> None:
        """Append vectors; a search sees them at once."""
        self._append(_unit(corpus, id, vector))

    def _append(self, good: DataFrame) -> None:
        placed = good.withColumn("cell", self._nearest(1)("v")[0])
        placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("append").partitionBy("cell").parquet(f"{self.path}/vectors")

    def _nearest(self, probes: int):
        """Function of a vector column to its ``probes`` nearest cells."""
        centers = self.centers
        half = (centers**2).sum(1) / 2

        @F.pandas_udf("array<int>")
        def nearest(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                if not len(part):
                    yield pd.Series([], dtype=object)
                    continue
                far = half - np.stack(part.to_numpy()) @ centers.T
                yield pd.Series(list(np.argsort(far, axis=1, kind="stable")[:, :probes].astype("int32")))

        return nearest

    def search(self, queries: DataFrame, *, k: int, probes: int = 8, query: str = "query", vector: str = "embedding") -> DataFrame:
        """(query, id, sim, rank): the ``k`` best of the probed cells by exact cosine; ties go to the smaller id.

        With as many probes as cells the search is exact. Vectors that are null, zero or hold null or
        non-finite components are neither indexed nor answered.
        """
        asked = _unit(queries, query, vector).withColumnRenamed("id", "query")
        asked = asked.withColumn("cell", F.explode(self._nearest(min(probes, len(self.centers)))("v")))
        stored = self.spark.read.schema(f"{self._id_type()}, v array<double>, cell int").parquet(f"{self.path}/vectors")
        # A long cell is cut into pieces, each of which meets all queries of the cell.
        sizes = {r["cell"]: -(-r["count"] // CELL_ROWS) for r in stored.groupBy("cell").count().limit(MAX_CELLS).collect()}
        cut = {c: n for c, n in sizes.items() if n > 1}
        pieces = reduce(lambda acc, x: acc.when(F.col("cell") == x[0], x[1]), cut.items(), F.when(F.lit(False), 1)).otherwise(1)
        left = stored.withColumn("piece", F.pmod(F.xxhash64("id"), pieces).cast("int"))
        right = asked.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        id_type = stored.schema["id"].dataType.simpleString()
        query_type = asked.schema["query"].dataType.simpleString()

        def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out = {"query": [], "id": [], "sim": []}
            if len(a) and len(b):
                a = a.sort_values("id")
                ids, vectors = a["id"].to_numpy(), np.stack(a["v"].to_numpy())
                for lo in range(0, len(b), QUERY_ROWS):
                    some = b.iloc[lo : lo + QUERY_ROWS]
                    sims = np.round(np.stack(some["v"].to_numpy()) @ vectors.T, SIM_DIGITS)
                    top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                    out["query"].append(np.repeat(some["query"].to_numpy(), top.shape[1]))
                    out["id"].append(ids[top].ravel())
                    out["sim"].append(np.take_along_axis(sims, top, 1).ravel())
            return pd.DataFrame({n: np.concatenate(x) if x else [] for n, x in out.items()})

        found = left.groupBy("cell", "piece").cogroup(right.groupBy("cell", "piece"))
        found = found.applyInPandas(best, f"query {query_type}, id {id_type}, sim double")
        return topk_per_group(found, group=["query"], order=[F.desc("sim"), F.asc("id")], k=k)

    def probes_for(self, *, k: int, recall: float = 0.95, sample: int = 200) -> int:
        """The fewest cells per query that reach ``recall`` at ``k`` on a sample of the stored vectors.

        At most ``sample`` vectors, chosen by a hash of their id, are searched exactly, and the places of the
        cells that hold their neighbors, in the order in which they would be probed, tell the recall of any number.
        """
        stored = self.spark.read.schema(f"{self._id_type()}, v array<double>, cell int").parquet(f"{self.path}/vectors")
        some = stored.orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("id").alias("query"), F.col("v").alias("embedding"))
        order = some.select("query", self._nearest(len(self.centers))("embedding").alias("cells"))
        near = self.search(some, k=k + 1, probes=len(self.centers)).where("query <> id").select("query", "id")
        placed = near.join(stored.select("id", "cell"), "id").join(order, "query")
        at = placed.select(F.array_position("cells", F.col("cell")).alias("at")).agg(F.percentile("at", recall)).first()[0]
        return 1 if at is None else int(-(-at // 1))

    def _id_type(self) -> str:
        field = self.spark.read.parquet(f"{self.path}/vectors").schema["id"]
        return f"id {field.dataType.simpleString()}"


def _unit(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v): vectors of length one in double precision, without those that have no direction."""
    v = F.col(vector).cast("array<double>")
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    good = df.where(fine).select(F.col(id).alias("id"), v.alias("v")).withColumn("_n", norm).where("_n > 0")
    return good.select("id", F.transform("v", lambda x: x / F.col("_n")).alias("v"))
