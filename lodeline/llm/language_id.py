"""Language identification: nearest of several clustered centroids of TF-IDF n-gram vectors.

Texts become counts of hashed character n-grams (one to three letters, word borders included),
weighted by inverse document frequency and scaled to length one. Each language is described by a
few centroids, found by spherical k-means, so that different kinds of text of one language need
not share a mean. A text takes the language of the centroid with the highest cosine and is
rejected when it lies further from it than any text that the model learned from, with slack.

The classifier is fitted on a bounded sample, ``SAMPLE`` labelled rows of each language, chosen by
a hash of the id over the whole table. Predictions read every whole text.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.llm.common import map_arrow
from lodeline.session import stored

DIM = 1 << 13
SAMPLE = 600
CLUSTERS = 4
ROUNDS = 12
SLACK = 0.5
"""A text is rejected below this share of the lowest cosine seen among a centroid's own texts."""
MAX_MODEL_BYTES = 256 << 20
MAX_LANGUAGES = 10_000
BLOCK = 1 << 18
UNKNOWN = "und"

_state: dict = {}


def _letters() -> np.ndarray:
    """For every code point: whether it is a letter."""
    if "letters" not in _state:
        _state["letters"] = np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)])
    return _state["letters"]


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text; None if it has no letter."""
    if not text:
        return None
    out = np.zeros(DIM, np.float64)
    seen, tail = False, np.zeros(0, np.uint64)
    for lo in range(0, len(text), BLOCK):
        block = text[lo : lo + BLOCK].lower().encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(block, "<u4").astype(np.uint64)
        codes = np.where(_letters()[codes], codes, 0)
        seen = seen or bool(codes.any())
        joined = np.concatenate([tail if lo else np.zeros(1, np.uint64), codes])
        if lo + BLOCK >= len(text):
            joined = np.append(joined, np.uint64(0))
        # Runs of other characters count as one border.
        keep = np.ones(len(joined), bool)
        keep[1:] = (joined[1:] != 0) | (joined[:-1] != 0)
        c = joined[keep]
        old = len(tail)
        for n in (1, 2, 3):
            if len(c) < n:
                continue
            h = np.full(len(c) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ c[k : len(c) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            # N-grams that lie wholly in the kept tail were counted with the block before.
            out += np.bincount((h % np.uint64(DIM)).astype(np.int64)[max(0, old - n + 1) :], minlength=DIM)
        tail = c[-2:]
    return out if seen else None


def unit_vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def sample(docs: DataFrame, rows: int = SAMPLE, train: Column | None = None) -> DataFrame:
    """(lang, text, at): at most ``rows`` labelled rows of each language, those with the smallest hash of their id.

    ``at`` orders the rows of a language.
    """
    label = docs.where("lang is not null and doc_id is not null")
    if train is not None:
        label = label.where(train)
    # A share of the hash range that holds twice as many as wanted comes first, so that no task
    # gathers candidates from all over the table; their smallest hashes are the sample.
    counts = stored(label.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_n")), "languages")
    if counts.count() > MAX_LANGUAGES:
        raise ValueError(f"the labels have more than {MAX_LANGUAGES} languages")
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    few = label.select("doc_id", "lang").join(F.broadcast(counts), F.col("lang") == F.col("_lang"))
    few = few.where(place * F.col("_n") <= 2.0 * rows).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 11), "doc_id")
    ids = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows)
    ids = stored(ids.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")), "sample-ids")
    keys = (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))
    few = label.select("doc_id", "lang", "text").join(ids, keys, "left_semi")
    # Rows that repeat an id count once, so the bound holds for them too.
    few = few.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    return few.select("lang", "text", F.xxhash64("doc_id").alias("at"))


def fit(docs: DataFrame, train: Column | None = None, rows: int = SAMPLE, clusters: int = CLUSTERS) -> list[dict]:
    """The model: the weights and, for each language, its centroids with their limits.

    Rows whose text is null or has no letters are ignored. A table without usable rows gives a
    model without centroids, which calls every text unknown.
    """

    def vectors(part: pa.RecordBatch):
        langs, orders, index, value = [], [], [], []
        for lang, text, order in zip(*(part[c].to_pylist() for c in ("lang", "text", "at"))):
            counts = ngram_counts(text)
            if counts is not None:
                at = np.flatnonzero(counts)
                langs.append(lang)
                orders.append(order)
                index.append(at.astype(np.int32))
                value.append(counts[at])
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(orders, pa.int64()), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float64()))],
            ["lang", "o", "at", "n"],
        )

    vecs = stored(map_arrow(sample(docs, rows, train), vectors, "lang string, o long, at array<int>, n array<double>"), "vectors")
    total = vecs.count()
    df = np.zeros(DIM)
    for r in vecs.select(F.explode("at").alias("at")).groupBy("at").count().collect():  # DIM rows at most
        df[r["at"]] = r["count"]
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0

    def centroids(key, own):
        own = own.sort_values("o", kind="stable")  # the same sums when a task runs again
        x = np.zeros((len(own), DIM), np.float32)
        for i, (at, n) in enumerate(zip(own["at"], own["n"])):
            dense = np.zeros(DIM)
            dense[at] = n
            x[i] = unit_vector(dense, idf)
        means = _spherical_kmeans(x, clusters)
        near = (x @ means.T).max(axis=1)
        limit = float(near.min()) * SLACK
        return pd.DataFrame({"lang": key[0], "limit": limit, "mean": [m.astype(np.float32).tobytes() for m in means]})

    found = vecs.groupBy("lang").applyInPandas(centroids, "lang string, limit double, mean binary")
    found = stored(found, "centroids")
    size = found.agg(F.sum(F.length("mean"))).first()[0] or 0
    if size > MAX_MODEL_BYTES:
        raise ValueError(f"the centroids take {size} bytes; use fewer languages or clusters")
    rows_ = sorted(found.collect(), key=lambda r: (r["lang"], bytes(r["mean"])))
    return [{"idf": idf.tobytes()}, *({"lang": r["lang"], "limit": r["limit"], "mean": bytes(r["mean"])} for r in rows_)]


def _spherical_kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """At most ``k`` unit means; the first is the mean of all, each next the row furthest from those before."""
    centre = x.mean(axis=0)
    norm = np.linalg.norm(centre)
    means = [centre / (norm if norm else 1)]
    for _ in range(min(k, len(x)) - 1):
        far = int(np.argmin((x @ np.stack(means).T).max(axis=1)))
        means.append(x[far])
    means = np.stack(means)
    for _ in range(ROUNDS):
        own = np.argmax(x @ means.T, axis=1)
        new = means.copy()
        for j in range(len(means)):
            if (own == j).any():
                m = x[own == j].sum(axis=0)
                new[j] = m / (np.linalg.norm(m) or 1)
        if np.allclose(new, means, atol=1e-6):
            break
        means = new
    # A mean of one or two odd rows is not a kind of text; rows near it fall to the others.
    own = np.bincount(np.argmax(x @ means.T, axis=1), minlength=len(means))
    return means[own >= min(3, own.max())]


def predict(docs: DataFrame, model: list[dict]) -> DataFrame:
    """Every row of ``docs`` with ``lang_pred``, ``score`` and ``rejected`` added (columns of these names are replaced).

    ``lang_pred`` is ``und`` and the score 0 if the text is null or has no letters; ``rejected`` is
    true for those and for texts beyond the limit of their nearest centroid. Only ``text`` is used.
    Equal cosines go to the language that sorts first.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop("lang_pred", "score", "rejected")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema]
    names = base.columns

    def run(part: pa.RecordBatch):
        head, *cents = sent.value
        idf = np.frombuffer(head["idf"])
        means = np.stack([np.frombuffer(c["mean"], np.float32) for c in cents]) if cents else np.zeros((0, DIM), np.float32)
        langs, scores, rejected = [], [], []
        texts = part["text"].to_pylist()
        for lo in range(0, len(texts), 128):
            counts = [ngram_counts(t) for t in texts[lo : lo + 128]]
            x = np.stack([np.zeros(DIM) if c is None else unit_vector(c, idf) for c in counts]).astype(np.float32)
            cos = x @ means.T
            for row, c in zip(cos, counts):
                if c is None or not len(row):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                best = int(np.argmax(row))
                langs.append(cents[best]["lang"])
                scores.append(min(1.0, max(0.0, float(row[best]))))
                rejected.append(float(row[best]) < cents[best]["limit"])
        added = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
        yield pa.RecordBatch.from_arrays([*(part[c] for c in names), *added], [*names, "lang_pred", "score", "rejected"])

    return map_arrow(base, run, ", ".join([*fields, "lang_pred string", "score double", "rejected boolean"]))
