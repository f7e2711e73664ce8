"""Benchmark decontamination with DataFrame functions only.

The windows of a benchmark are hashed and sent to every task (behind a check of their number). The
documents are scanned once: the window at every word position is hashed inside generated code and
looked up; hits are verified word by word. Then spans or whole documents are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import ascii_lower, with_columns_replaced

# The characters that end a word, before and after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

WINDOW = 10
MAX_SENT_WINDOWS = 500_000
"""A larger benchmark is not broadcast; the windows of documents are then shuffled to it."""


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _window_hash(at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get("w", at + k) for k in range(length)])


def _window_text(at: Column, length) -> Column:
    return F.array_join(F.slice("w", at + 1, length), " ")


def benchmark_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """(len, window, items): each window of ``bench`` (item_id, text) once, with the items that hold it.

    An item of fewer words than ``window`` is one window; one without words has none.
    """
    w = bench.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    length = F.least(F.size("w"), F.lit(window))
    at = w.select("item_id", "w", length.alias("len"), F.explode(F.sequence(F.lit(0), F.size("w") - length)).alias("p"))
    return (
        at.select("len", _window_text(F.col("p"), F.col("len")).alias("window"), "item_id")
        .groupBy("len", "window")
        .agg(F.collect_set("item_id").alias("items"))
    )


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, max_sent: int = MAX_SENT_WINDOWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_words, n_hit, items, spans.

    ``items`` are the item_ids with occurring windows, sorted as strings; ``spans`` are the hit
    windows as sorted (pos, len). A word inside any occurrence is hit and counts once. Null and
    empty texts have no words. An empty benchmark hits nothing.
    """
    wins = benchmark_windows(bench, window)
    lengths = {r["len"]: r["n"] for r in wins.groupBy("len").agg(F.count("*").alias("n")).collect()}
    base = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        words(F.col("text")).alias("w"),
    )
    if sum(lengths.values()) <= max_sent:
        rows = _scan_sent(base, wins, sorted(lengths))
    else:
        rows = _scan_shuffled(base, wins, sorted(lengths))
    per = rows.groupBy("row", "doc_id", "text_hash").agg(
        F.max("n").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("items").isNotNull(), F.struct(F.col("p").alias("pos"), "len")))).alias("spans"),
        F.collect_set("items").alias("sets"),
    )
    end = F.col("x.pos") + F.col("x.len")
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit"))

    def cover(acc, x):
        stop = x["pos"] + x["len"]
        return F.struct(
            F.greatest(acc["end"], stop).alias("end"),
            (acc["hit"] + F.greatest(F.lit(0), stop - F.greatest(acc["end"], x["pos"]))).alias("hit"),
        )

    return per.select(
        "doc_id",
        "text_hash",
        "n_words",
        F.aggregate("spans", zero, cover)["hit"].cast("long").alias("n_hit"),
        F.array_sort(F.transform(F.array_distinct(F.flatten("sets")), lambda i: i.cast("string"))).alias("items"),
        "spans",
    )


def _positions(base: DataFrame, lengths: list[int], ends: bool) -> DataFrame:
    """A row for each word position and window length, with ``ends`` also one at each document's end."""
    n = F.size("w")
    last = n if ends else n - 1
    at = base.select("row", "doc_id", "text_hash", "w", n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("p"))
    fits = lambda k: F.when(F.col("p") + k <= F.col("n"), _window_hash(F.col("p"), k))
    if len(lengths) == 1:
        return at.select("*", F.lit(lengths[0]).alias("len"), fits(lengths[0]).alias("h"))
    each = F.array(*[F.struct(F.lit(k).alias("len"), fits(k).alias("h")) for k in lengths])
    return at.select("*", F.inline(each))


def _keyed_windows(wins: DataFrame, lengths: list[int]) -> DataFrame:
    w = wins.select("len", "window", "items", F.split("window", " ").alias("w"))
    h = F.lit(None).cast("long")
    for k in lengths:
        h = F.when(F.col("len") == k, _window_hash(F.lit(0), k)).otherwise(h)
    return w.select(h.alias("wh"), F.col("len").alias("wlen"), "window", "items")


def _match(window_p: Column) -> Column:
    return (
        (F.col("h") == F.col("wh"))
        & (F.col("len") == F.col("wlen"))
        & (_window_text(window_p, F.col("len")) == F.col("window"))
    )


def _scan_sent(base: DataFrame, wins: DataFrame, lengths: list[int]) -> DataFrame:
    # The position after a document's last word fits no window: its row survives and brings the word count.
    at = _positions(base, lengths or [1], ends=True)
    found = at.join(F.broadcast(_keyed_windows(wins, lengths)), _match(F.col("p")), "left")
    return found.where("items is not null or p = n").select("row", "doc_id", "text_hash", "n", "p", "len", "items")


def _scan_shuffled(base: DataFrame, wins: DataFrame, lengths: list[int]) -> DataFrame:
    at = _positions(base.where("size(w) > 0"), lengths, ends=False).where("h is not null")
    slim = at.select("row", "doc_id", "text_hash", "n", "p", "len", "h", _window_text(F.col("p"), F.col("len")).alias("text"))
    keyed = _keyed_windows(wins, lengths)
    same = (F.col("h") == F.col("wh")) & (F.col("len") == F.col("wlen")) & (F.col("text") == F.col("window"))
    hits = slim.join(keyed, same).select("row", "doc_id", "text_hash", "n", "p", "len", "items")
    none = base.select(
        "row", "doc_id", "text_hash", F.size("w").alias("n"), F.size("w").alias("p"),
        F.lit(0).alias("len"), F.lit(None).cast(keyed.schema["items"].dataType).alias("items"),
    )
    return hits.unionByName(none)


def _same_row(docs: DataFrame, found: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(found["_doc"]) & (F.xxhash64(docs["text"]) == found["_hash"])


def remove_documents(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a hit word, all columns as they are."""
    found = contamination(docs, bench, window).where("n_hit > 0")
    found = found.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(found, _same_row(docs, found), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_spans(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row of ``docs``, hit words cut from ``text``; what stands between words stays."""
    found = contamination(docs, bench, window).where("n_hit > 0")
    found = found.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans"))
    both = docs.join(found.distinct(), _same_row(docs, found), "left")
    word = F.regexp_extract_all("text", F.lit(f"({WORD_ANY_CASE})"), 1)
    gap = F.split("text", WORD_ANY_CASE, -1)
    hit = lambda i: F.exists("_spans", lambda s: (i > s["pos"]) & (i <= s["pos"] + s["len"]))
    cut = F.array_join(
        F.transform(gap, lambda g, i: F.when((i == 0) | hit(i), g).otherwise(F.concat(F.get(word, i - 1), g))), ""
    )
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cut)
    return with_columns_replaced(both.select(*[F.col(f"`{c}`") for c in docs.columns], "_spans"), text=text).drop("_spans")
