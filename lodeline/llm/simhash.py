"""SimHash near-dedup by multi-index hashing.

A 64-bit fingerprint has two segments of 32 bits. If two fingerprints differ in at most two bits,
either their high segments differ in at most one bit, or the high ones in two and the low ones in
none. So one table is keyed by high segments and probed with small Hamming balls around them
(radius one), and one is keyed by low segments and probed with the segment alone. Every match is
verified over all 64 bits. Copies share a fingerprint and enter the tables once, so a group of
copies costs one row, however large it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import bytes_words, map_arrow
from lodeline.llm.components import components
from lodeline.session import stored

SEED = 42
BLOCK = 50_000
"""Shingles whose hashes are counted at once; bounds the memory of a very long text."""


def simhash(text: str | None, width: int = 3) -> int:
    """Unsigned fingerprint of a text's word shingles, repeats included; zero without words."""
    words = bytes_words(text)
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, BLOCK):
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(lo, min(n, lo + BLOCK))]
        ones += np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) per row; ``fp`` is the fingerprint as a signed long."""

    def run(part: pa.RecordBatch):
        fps = np.array([simhash(t, width) for t in part["text"].to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def near_links(distinct_fps: DataFrame) -> DataFrame:
    """(a, b): the ``rep`` of each two fingerprints (fp, rep) that differ in one or two bits, each pair once."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    seg = F.sequence(F.lit(0), F.lit(31))
    # A ball of radius one, halved: of two segments one bit apart, the one that has the bit probes
    # without it; equal segments meet at the segment itself. So no pair is fetched twice.
    ball = F.concat(
        F.array(high),
        F.transform(
            F.filter(seg, lambda i: F.call_function("shiftright", high, i).bitwiseAND(F.lit(1)) == 1),
            lambda i: high.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)),
        ),
    )
    probes = F.concat(
        F.transform(ball, lambda s: F.struct(F.lit(0).alias("seg"), s.alias("value"))),
        F.array(F.struct(F.lit(1).alias("seg"), low.alias("value"))),
    )
    tables = F.array(F.struct(F.lit(0).alias("seg"), high.alias("value")), F.struct(F.lit(1).alias("seg"), low.alias("value")))
    p = distinct_fps.select(F.col("fp").alias("pf"), F.col("rep").alias("a"), F.inline(probes))
    t = distinct_fps.select(F.col("fp").alias("tf"), F.col("rep").alias("b"), F.inline(tables))
    differ = F.col("pf").bitwiseXOR(F.col("tf"))
    high_bits = F.bit_count(F.shiftrightunsigned(differ, 32))
    once = F.when(F.col("p.seg") == 1, (high_bits == 2) & (F.col("a") < F.col("b"))).otherwise(
        (high_bits == 1) | (F.col("a") < F.col("b"))
    )
    match = (F.col("p.seg") == F.col("t.seg")) & (F.col("p.value") == F.col("t.value"))
    return p.alias("p").join(t.alias("t"), match & (F.bit_count(differ) <= 2) & once).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs`` (doc_id, text).

    Words are between ASCII white space, A-Z lower-cased; a text of fewer than ``width`` words is
    one shingle, one without words (null, empty) has fingerprint zero and links like any other.
    Documents link at two or fewer differing bits; ``component_id`` is the smallest doc_id that
    links reach. Repeated rows give repeated rows; a null doc_id gets a component only through others.
    """
    fps = stored(fingerprints(docs, width), "fingerprints")
    reps = stored(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    found = components(stored(near_links(reps), "near-links"))
    named = stored(
        reps.join(found, reps["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id")),
        "named",
    )
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 3) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component; of rows that repeat a doc_id, all.

    Rows without a doc_id stay, as nothing identifies their group.
    """
    found = near_duplicates(docs, width).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
