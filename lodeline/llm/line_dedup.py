"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A ``LineIndex`` keeps, under one folder of the shared storage,

* ``refs``: signed references (key, doc_id, +1 or -1), appended by every insert and delete. Their
  sums are the exact reference counts: a document holds a key while its sum is above zero.
* ``filters``: per shard of the key space a cuckoo filter of the keys that at least ``min_docs``
  documents hold now. A batch changes it only by the keys whose exact count crossed the limit: up
  is an insert, down a delete, so inserting and deleting the same documents restores it.

``dedup`` probes the filters with every line of the documents. Only lines that may be repeated
leave their task; the exact counts then confirm each of them. Keys are 128-bit hashes of lines.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm.common import BLANKS, map_arrow
from lodeline.llm.cuckoo import CuckooFilter
from lodeline.session import work_dir

KEYS_PER_SHARD = 100_000
MIN_SHARDS = 32
MAX_SENT_BYTES = 64 << 20
"""Filters of more bytes in all are not sent to the tasks; lines then meet the exact table directly."""

REFS = "k1 long, k2 long, doc_id long"


def _key(line: str, min_chars: int) -> bytes | None:
    line = line.strip(BLANKS)
    if len(line) < min_chars:
        return None
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest()


def _document_keys(docs: DataFrame, min_chars: int, sent=None) -> DataFrame:
    """(k1, k2, doc_id) for each key of each document row, once; with ``sent`` filters, only of those they let through."""

    def run(part: pa.RecordBatch):
        ids, digests = [], []
        for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
            keys = {k for k in (_key(x, min_chars) for x in (text or "").split("\n")) if k}
            digests.extend(keys)
            ids.extend([doc] * len(keys))
        halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        k1, k2, ids = halves[:, 0], halves[:, 1], np.array(ids, dtype=np.int64)
        if sent is not None and len(ids):
            n, filters = sent.value
            keep = np.zeros(len(ids), bool)
            shard = _shard(k1, n)
            for s in np.unique(shard):
                if s in filters:
                    at = np.flatnonzero(shard == s)
                    keep[at] = _loaded(filters, s).contains(k1[at], k2[at])
            k1, k2, ids = k1[keep], k2[keep], ids[keep]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x), pa.int64()) for x in (k1, k2, ids)], ["k1", "k2", "doc_id"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null"), run, REFS)


def _shard(k1: np.ndarray, n: int) -> np.ndarray:
    # The filters use the low bits of k1, the shards its high ones.
    return ((k1.astype(np.int64).view(np.uint64) >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _loaded(filters: dict, shard: int) -> CuckooFilter:
    if isinstance(filters[shard], bytes):
        filters[shard] = CuckooFilter.from_bytes(filters[shard])
    return filters[shard]


def _counts(refs: DataFrame) -> DataFrame:
    """Exact live counts: (k1, k2, n_docs, top), top being the largest document that holds the key."""
    live = refs.groupBy("k1", "k2", "doc_id").agg(F.sum("sign").alias("net")).where("net > 0")
    return live.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("top"))


class LineIndex:
    """Which lines at least ``min_docs`` documents hold, kept exact under inserts and deletes.

    Documents are (doc_id, text); further columns are ignored. Rows with a null doc_id hold no
    references. A document inserted twice counts once, and must be deleted twice to go.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = 3, min_chars: int = 20, shards: int | None = None):
        self.spark, self.min_docs, self.min_chars, self.shards = spark, min_docs, min_chars, shards
        self.path = path or work_dir(spark, "line-index")
        self.batches: list[str] = []
        self.filters: DataFrame | None = None
        self.repeated: DataFrame | None = None

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._apply(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Take back documents that were inserted with the same text."""
        return self._apply(docs, -1)

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{len(self.batches)}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def _refs(self) -> DataFrame:
        return self.spark.read.parquet(*self.batches)

    def _apply(self, docs: DataFrame, sign: int) -> LineIndex:
        path = f"{self.path}/refs-{len(self.batches)}"
        _document_keys(docs, self.min_chars).withColumn("sign", F.lit(sign)).write.parquet(path)
        before, self.batches = self.repeated, [*self.batches, path]
        if before is None:
            self.repeated = self._write(_counts(self._refs()).where(F.col("n_docs") >= self.min_docs), "repeated")
            crossed = self.repeated.select("k1", "k2", F.lit(True).alias("up"))
        else:
            # Only keys of this batch can change: their references in all batches are summed anew.
            touched = self._write(self.spark.read.parquet(path).select("k1", "k2").distinct(), "touched")
            now = _counts(self._refs().join(touched, ["k1", "k2"], "left_semi")).where(F.col("n_docs") >= self.min_docs)
            now = self._write(now, "changed")
            kept = before.join(touched, ["k1", "k2"], "left_anti")
            self.repeated = self._write(kept.unionByName(now), "repeated")
            up = now.join(before, ["k1", "k2"], "left_anti").select("k1", "k2", F.lit(True).alias("up"))
            down = before.join(self.repeated, ["k1", "k2"], "left_anti").select("k1", "k2", F.lit(False).alias("up"))
            crossed = up.unionByName(down)
        if self.shards is None:
            self.shards = max(MIN_SHARDS, -(-self.repeated.count() // KEYS_PER_SHARD))
        self._update_filters(crossed)
        return self

    def _update_filters(self, crossed: DataFrame) -> None:
        n = self.shards
        shard = F.pmod(F.shiftrightunsigned("k1", 40), F.lit(n)).alias("shard")

        def update(key, held, moves):
            table = CuckooFilter.from_bytes(held["filter"].iloc[0]) if len(held) else CuckooFilter(len(moves) // 3 + 1)
            moves = moves.sort_values(["k1", "k2"], kind="stable")  # the same bytes when a task runs again
            for k1, k2, up in zip(moves["k1"].tolist(), moves["k2"].tolist(), moves["up"].tolist()):
                table.insert(k1, k2) if up else table.delete(k1, k2)
            return held.iloc[:0].assign(shard=[], filter=[]) if not table.layers else _row(key[0], table)

        old = self.filters if self.filters is not None else self.spark.createDataFrame([], "shard long, filter binary")
        moves = crossed.select(shard, "k1", "k2", "up")
        new = old.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(update, "shard long, filter binary")
        self.filters = self._write(new, "filters")

    def dropped(self, docs: DataFrame) -> DataFrame:
        """(doc_id, keys): the keys that each document must lose, for documents that lose any."""
        size = self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
        sent = None
        if size <= MAX_SENT_BYTES:
            sent = self.spark.sparkContext.broadcast((self.shards, {r.shard: bytes(r.filter) for r in self.filters.collect()}))
        maybe = _document_keys(docs, self.min_chars, sent)
        hits = maybe.join(self.repeated, ["k1", "k2"]).where(F.col("doc_id") < F.col("top"))
        return hits.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("keys"))

    def dedup(self, docs: DataFrame) -> DataFrame:
        """Every row of ``docs`` with its repeated lines removed from ``text``, and ``n_lines``, ``n_dropped``.

        A null text is one empty line, and gives an empty text. Columns of ``docs`` named like the
        two counts are replaced; others stay.
        """
        lost = self.dropped(docs).select(F.col("doc_id").alias("_doc"), F.col("keys").alias("_keys"))
        base = docs.drop("n_lines", "n_dropped")
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "text"]
        ddl = ", ".join([*fields, "text string", "n_lines long", "n_dropped long"])
        names = [f.name for f in base.schema if f.name != "text"]
        min_chars = self.min_chars

        def run(part: pa.RecordBatch):
            texts, n_lines, n_dropped = [], [], []
            for text, keys in zip(part["text"].to_pylist(), part["_keys"].to_pylist()):
                lines = (text or "").split("\n")
                if keys:
                    lose = {np.array([k["k1"], k["k2"]], "<i8").tobytes() for k in keys}
                    left = [x for x in lines if _key(x, min_chars) not in lose]
                    texts.append("\n".join(left))
                else:
                    left = lines
                    texts.append(text or "")
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            added = [pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(part[c] for c in names), *added], [*names, "text", "n_lines", "n_dropped"])

        joined = base.join(lost, base["doc_id"] == lost["_doc"], "left").drop("_doc")
        out = map_arrow(joined, run, ddl)
        return out.select(*base.columns, "n_lines", "n_dropped")


def _row(shard: int, table: CuckooFilter):
    import pandas as pd

    return pd.DataFrame({"shard": [shard], "filter": [table.to_bytes()]})


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """Insert all documents into a new index and remove their repeated lines.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Keys of
    at least ``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines
    except in the largest doc_id that holds them (there every occurrence stays). Rows that share a
    doc_id are one document; a row without a doc_id neither counts nor loses lines.
    """
    return LineIndex(docs.sparkSession, min_docs=min_docs, min_chars=min_chars).insert(docs).dedup(docs)
