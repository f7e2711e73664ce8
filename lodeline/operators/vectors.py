"""Similarity search, embeddings and scoring against prototypes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.functions.text import strip
from lodeline.operators.aggregates import topk_per_group
from lodeline.plans.layout import waves

SIM_DIGITS = 9
# Query vectors are sent to every task only up to this many numbers.
MAX_SHARED_VALUES = 1_000_000
QUERY_SLICE = 512
# Vectors that one step of a Python task holds as doubles.
ROW_SLICE = 512
# Texts that one task turns into vectors.
TASK_TEXTS = 20_000
BLOCK_VECTORS = 20_000
MAX_SENT_ROWS = 1_000_000


def centroids(df: DataFrame, *, group: str, vector: str) -> DataFrame:
    """Mean vector of each group, averaged position by position."""
    means = df.select(group, F.posexplode(vector).alias("_i", "_x")).groupBy(group, "_i").agg(
        F.avg(F.col("_x").cast("double")).alias("_m")
    )
    listed = F.array_sort(F.collect_list(F.struct("_i", "_m")))
    return means.groupBy(group).agg(F.transform(listed, lambda x: x["_m"]).alias(vector))


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return _unit(np.array([np.asarray(v, dtype="float64") for v in column]))


def _best(ids, scopes, vectors, q_ids, q_scopes, q_unit, k) -> pd.DataFrame:
    """The k most similar of these rows for each query, a slice of the rows and of the queries at a time."""
    ids, q_ids = np.asarray(ids), np.asarray(q_ids)
    vectors = np.asarray(vectors, dtype=object)
    order = np.argsort(ids, kind="stable")
    if q_scopes is not None:
        scopes, q_scopes = np.asarray(scopes), np.asarray(q_scopes)
    best = np.zeros((len(q_ids), 0), dtype="int64"), np.zeros((len(q_ids), 0))
    for at in range(0, len(order), ROW_SLICE):
        rows = order[at : at + ROW_SLICE]
        best = _merged(best, rows, _matrix(vectors[rows]), scopes, q_scopes, q_unit, k)
    at, sims = best
    out = pd.DataFrame({"query": np.repeat(q_ids, at.shape[1]), "id": ids[at.ravel()], "sim": sims.ravel()})
    return out[np.isfinite(out["sim"])].reset_index(drop=True)


def _merged(best, rows, unit, scopes, q_scopes, q_unit, k):
    """The k best of those found so far and of these rows, whose ids are all higher."""
    ats, tops = [], []
    for lo in range(0, len(q_unit), QUERY_SLICE):
        cut = slice(lo, lo + QUERY_SLICE)
        sims = np.round(q_unit[cut] @ unit.T, SIM_DIGITS)
        if q_scopes is not None:
            sims[q_scopes[cut, None] != scopes[rows][None, :]] = -np.inf
        sims = np.concatenate([best[1][cut], sims], axis=1)
        at = np.concatenate([best[0][cut], np.broadcast_to(rows, (len(sims), len(rows)))], axis=1)
        # Columns are in id order, so a stable sort breaks ties by the smaller id.
        top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        ats.append(np.take_along_axis(at, top, axis=1))
        tops.append(np.take_along_axis(sims, top, axis=1))
    return np.concatenate(ats), np.concatenate(tops)


def cosine_topk(
    corpus: DataFrame,
    queries: DataFrame,
    *,
    k: int,
    id: str = "id",
    vector: str = "embedding",
    query: str = "query",
    scope: str | None = None,
    max_shared_values: int = MAX_SHARED_VALUES,
) -> DataFrame:
    """The ``k`` most similar corpus rows per query (``query, id, sim, rank``); ties go to the smaller id.

    Each task keeps only ``k`` rows per query and batch, so what is shuffled does not grow
    with the corpus rows. The query vectors are shared with all tasks while their size is
    below a limit; more queries are cut into blocks and met by corpus blocks. With
    ``scope`` a query sees only rows with its own scope value.
    """
    cols = [id, vector] + ([scope] if scope else [])
    qcols = [query, vector] + ([scope] if scope else [])
    c, q = corpus.select(*cols), queries.select(*qcols)
    schema = f"query {q.schema[query].dataType.simpleString()}, id {c.schema[id].dataType.simpleString()}, sim double"
    size = q.agg(F.sum(F.size(vector))).first()[0] or 0

    if size <= max_shared_values:
        rows = q.collect()
        q_ids = [r[query] for r in rows]
        q_scopes = [r[scope] for r in rows] if scope else None
        q_unit = _unit(np.array([r[vector] for r in rows], dtype="float64")) if rows else np.zeros((0, 1))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b) and len(q_ids):
                    yield _best(b[id], b[scope] if scope else None, b[vector], q_ids, q_scopes, q_unit, k)

        found = c.mapInPandas(scan, schema)
    else:
        per_block = max(1, max_shared_values // max(1, size // max(1, q.count())))
        q_blocks = math.ceil(q.count() / per_block)
        c_blocks = max(1, math.ceil(c.count() / BLOCK_VECTORS))
        left = c.withColumn("_c", F.pmod(F.xxhash64(id), F.lit(c_blocks))).withColumn(
            "_q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
        )
        right = q.withColumn("_q", F.pmod(F.xxhash64(query), F.lit(q_blocks)).cast("int")).withColumn(
            "_c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_blocks - 1).cast("long")))
        )

        def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if a.empty or b.empty:
                return pd.DataFrame({"query": [], "id": [], "sim": []})
            q_scopes = b[scope].tolist() if scope else None
            return _best(a[id], a[scope] if scope else None, a[vector], b[query].tolist(), q_scopes, _matrix(b[vector]), k)

        found = left.groupBy("_c", "_q").cogroup(right.groupBy("_c", "_q")).applyInPandas(block, schema)
    return topk_per_group(found, group=["query"], order=[F.desc("sim"), F.asc("id")], k=k)


def filtered_memory_search(
    corpus: DataFrame, queries: DataFrame, *, scope: Sequence[str], k: int, **kw
) -> DataFrame:
    """Search within a user, agent or run: rows must agree with the query on every scope column."""
    if not scope:
        raise ValueError("a search needs at least one scope column")
    tag = F.to_json(F.struct(*scope), {"ignoreNullFields": "false"})
    return _scoped_topk(corpus.withColumn("_scope", tag), queries.withColumn("_scope", tag), k, **kw)


def _scoped_topk(corpus: DataFrame, queries: DataFrame, k: int, *, id: str = "id", vector: str = "embedding", query: str = "query",
                 piece_rows: int = BLOCK_VECTORS) -> DataFrame:
    """Rows meet the queries of their own scope and no others; a long scope is cut into pieces, each of which meets them all."""
    c = corpus.select(F.col(id).alias("id"), F.col(vector).alias("v"), "_scope")
    q = queries.select(F.col(query).alias("query"), F.col(vector).alias("v"), "_scope")
    c = c.join(q.select("_scope").distinct(), "_scope", "left_semi")
    long_ones = c.groupBy("_scope").agg(F.ceil(F.count("*") / piece_rows).cast("int").alias("_n")).where("_n > 1")
    if long_ones.count() <= MAX_SENT_ROWS:  # at most one in piece_rows
        long_ones = F.broadcast(long_ones)
    of = lambda df: df.join(long_ones, "_scope", "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    left = of(c).withColumn("_piece", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    right = of(q).withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    schema = f"query {q.schema['query'].dataType.simpleString()}, id {c.schema['id'].dataType.simpleString()}, sim double"

    def piece(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query": [], "id": [], "sim": []})
        return _best(a["id"], None, a["v"], b["query"].tolist(), None, _matrix(b["v"]), k)

    found = left.groupBy("_scope", "_piece").cogroup(right.groupBy("_scope", "_piece")).applyInPandas(piece, schema)
    return topk_per_group(found, group=["query"], order=[F.desc("sim"), F.asc("id")], k=k)


def embedder(texts: DataFrame, *, text: str = "text", features: int = 1024):
    """A fitted text-to-vector model: hashed word counts, inverse document frequency, unit length."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer

    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\s+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_vec"),
    ]
    return Pipeline(stages=stages).fit(waves(texts.select(text), TASK_TEXTS))


def embed_documents(
    texts: DataFrame,
    *,
    text: str = "text",
    out: str = "embedding",
    model=None,
    embed_fn: Callable[[Iterator[pd.Series]], Iterator[pd.Series]] | None = None,
) -> DataFrame:
    """Adds the vector of each text. ``embed_fn`` plugs in a model of the user's own, called
    once per task with an iterator of text batches."""
    if embed_fn is not None:
        return texts.withColumn(out, F.pandas_udf(embed_fn, "array<float>")(F.col(text)))
    from pyspark.ml.functions import vector_to_array

    model = model or embedder(texts, text=text)
    made = model.transform(waves(texts, TASK_TEXTS))
    return made.withColumn(out, vector_to_array("_vec", "float32")).drop("_words", "_tf", "_idf", "_vec")


def retrieve_topk_sources(
    docs: DataFrame, queries: DataFrame, *, k: int = 3, doc_id: str = "doc_id", query: str = "query", text: str = "text"
) -> DataFrame:
    """Per query the ``k`` best documents with score, the first 200 characters and metadata."""
    model = embedder(docs.select(text), text=text)
    corpus = embed_documents(docs.select(doc_id, text), text=text, model=model).select(doc_id, "embedding")
    asked = embed_documents(queries.select(query, text), text=text, model=model).select(query, "embedding")
    top = cosine_topk(corpus, asked, k=k, id=doc_id, query=query)
    cut = F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 200), F.lit("..."))).otherwise(F.col(text))
    meta = docs.withColumn("content", cut).drop(text).withColumnRenamed(doc_id, "id")
    # A short result list is sent to the documents, so that the texts are not shuffled.
    if queries.count() * k <= MAX_SENT_ROWS:
        top = F.broadcast(top)
    return meta.join(top, "id")


MAX_LABELS = 1000


def zero_shot_multilabel(
    pages: DataFrame,
    prototypes: DataFrame | None = None,
    *,
    id: str,
    label: str = "label",
    vector: str = "embedding",
    score_fn: Callable | None = None,
    text: str = "text",
) -> DataFrame:
    """An independent score per candidate label, highest first (``labels``: array of label, score).

    Scores are cosines against one prototype vector per label, or come from ``score_fn``
    (text batches in, array of (label, score) out). Blank texts are skipped.
    """
    df = pages.filter(strip(F.col(text) if isinstance(text, str) else text) != "")
    kind = "array<struct<label:string,score:double>>"
    if score_fn is not None:
        scored = df.withColumn("labels", F.pandas_udf(score_fn, kind)(F.col(text)))
    else:
        rows = prototypes.select(label, vector).limit(MAX_LABELS + 1).collect()
        if len(rows) > MAX_LABELS:
            raise ValueError(f"more than {MAX_LABELS} candidate labels")
        names = [str(r[0]) for r in rows]
        unit = _unit(np.array([r[1] for r in rows], dtype="float64"))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for at in range(0, len(whole), ROW_SLICE):
                    b = whole.iloc[at : at + ROW_SLICE]
                    sims = np.round(_matrix(b[vector]) @ unit.T, 4)
                    yield pd.DataFrame(
                        {id: b[id], "labels": [[{"label": n, "score": float(s)} for n, s in zip(names, r)] for r in sims]}
                    )

        scored = df.select(id, vector).mapInPandas(scan, f"{id} {df.schema[id].dataType.simpleString()}, labels {kind}")
    by_score = F.array_sort(F.transform("labels", lambda x: F.struct((-x["score"]).alias("s"), x["label"].alias("label"))))
    return scored.select(id, F.transform(by_score, lambda x: F.struct(x["label"].alias("label"), (-x["s"]).alias("score"))).alias("labels"))
