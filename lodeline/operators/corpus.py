"""Search, mentions, keywords, line ranges and sensitive-data scans over text tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions.text import SENSITIVE_PATTERNS, count_matches, words
from lodeline.plans.layout import spread
from lodeline.session import stored

GRAM = 4
# Terms are sent to every task only up to these sizes.
MAX_SENT_TERMS = 50_000
MAX_SENT_CHARS = 16_000_000
# Terms up to this length are looked up whole among the pieces of words.
PIECE = 32


def _longest(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(""), lambda x, w: F.when(F.length(w) > F.length(x), w).otherwise(x))


def contained_terms(
    docs: DataFrame,
    terms: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    term_id: str = "term_id",
    term: str = "term",
    case_insensitive: bool = False,
    whole_words: bool = False,
    context: int | None = None,
) -> DataFrame:
    """Pairs where the term is a substring of the text, with its 1-based position.

    The pairs to test come from equality joins, never from comparing everything with
    everything. A term with a word strictly inside it can only occur where that word is a
    word of the text, so the longest inner word is the join key. A shorter term must lie
    within a word or across the border of two, so a four-character piece of its longest
    word is looked up among the pieces of the text's words.

    While the terms are few (their size is checked) they are sent to the texts, and a text
    never leaves its task. Otherwise only ids and keys are shuffled to find candidates, and
    the texts join them once by id. ``context`` adds the text around the hit.
    """
    norm = (lambda c: F.lower(c)) if case_insensitive else (lambda c: c)
    t = terms.select(F.col(term_id).alias("_t"), norm(F.col(term)).alias("_term")).filter(F.length("_term") > 0)
    size = t.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("_term")), F.lit(0)).alias("chars")).first()
    few = size["n"] <= MAX_SENT_TERMS and size["chars"] <= MAX_SENT_CHARS
    t = t.withColumn("_w", F.split("_term", r"\s"))
    t = t.withColumn("_anchor", _longest(F.slice("_w", 2, F.greatest(F.size("_w") - 2, F.lit(0)))))
    by_word = t.filter(F.col("_anchor") != "").select("_t", "_term", "_anchor")
    piece = F.substring(_longest(F.col("_w")), 1, GRAM)
    by_piece = t.filter(F.col("_anchor") == "").select("_t", "_term", piece.alias("_anchor"))
    lengths = sorted(r[0] for r in by_piece.select(F.length("_anchor").alias("n")).distinct().collect())
    if 0 in lengths:
        raise ValueError("terms made only of blanks cannot be searched")

    body = [F.col(text).alias("_orig"), norm(F.col(text)).alias("_text")]
    source = spread(docs.select(doc_id, text)).select(F.col(doc_id).alias("_d"), *body)
    tokens = F.array_distinct(F.filter(F.split("_text", r"\s"), lambda w: w != ""))

    def pieces_of(n: int) -> Column:
        last = F.greatest(F.length("_word") - n + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.col("_word").substr(i, F.lit(n)))

    def keyed(by: DataFrame, anchors: Column, word: bool) -> DataFrame:
        d = source if word else source.withColumn("_word", F.explode(tokens))
        d = d.withColumn("_anchor", F.explode(anchors)).drop("_word")
        if few:
            return d.join(F.broadcast(by), "_anchor").filter(F.col("_text").contains(F.col("_term")))
        pairs = d.select("_d", "_anchor").join(by.select("_t", "_anchor"), "_anchor").select("_d", "_t").distinct()
        return pairs.join(source, "_d").join(by.select("_t", "_term"), "_t").filter(F.col("_text").contains(F.col("_term")))

    cols = ["_d", "_t", "_term", "_orig", "_text"]
    found = keyed(by_word, tokens, True).select(*cols)
    if lengths:
        grams = F.array_distinct(F.concat(*[pieces_of(n) for n in lengths]))
        found = found.unionByName(keyed(by_piece, grams, False).select(*cols))
    if whole_words:
        edge = F.concat(F.lit(r"(^|\W)\Q"), F.col("_term"), F.lit(r"\E(\W|$)"))
        found = found.filter(F.regexp_like("_text", edge))
    found = found.withColumn("position", F.expr("instr(_text, _term)").cast("long"))
    out = [F.col("_d").alias(doc_id), F.col("_t").alias(term_id), F.col("position")]
    if context is not None:
        start = F.greatest(F.col("position") - context, F.lit(1))
        stop = F.col("position") + F.length("_term") + context
        around = F.col("_orig").substr(start.cast("int"), (stop - start).cast("int"))
        out.append(F.replace(around, F.lit("\n"), F.lit(" ")).alias("context"))
    made = found.select(*out)
    # Several pieces of one text may lead to the same short term.
    return made.dropDuplicates([doc_id, term_id]) if lengths and few else made


def mentioned_terms(
    docs: DataFrame, terms: DataFrame, *, text: str = "text", term_id: str = "term_id", term: str = "term", whole_words: bool = False
) -> DataFrame:
    """The ``term_id`` of every term that is a substring of any of the texts.

    A term without blanks can only occur within a word. So only the distinct words leave their tasks, in pieces
    of the terms' lengths, and a term is found by equality: the work grows with the words, not with the pairs
    of texts and terms. Terms with blanks are searched in the texts, long ones in the long words.
    """
    t = terms.select(F.col(term_id).alias("_t"), F.col(term).alias("_term")).filter(F.length("_term") > 0)
    spaced, long_term = F.col("_term").rlike(r"\s"), F.length("_term") > PIECE
    kind = F.when(spaced, -1).when(long_term, 0).otherwise(F.length("_term"))
    lengths = sorted(r[0] for r in t.select(kind.alias("n")).distinct().collect())
    found_words = F.array_distinct(F.filter(F.split("_text", r"\s"), lambda w: w != ""))
    tokens = spread(docs.select(F.col(text).alias("_text"))).select(F.explode(found_words).alias("_word")).distinct()

    word = F.col("_word")
    listed = F.array(*[F.lit(n) for n in lengths if n > 0]).cast("array<int>")
    # Beyond either end of the word there is nothing, which is an edge as well.
    edge = lambda at: (at < 1) | (at > F.length(word)) | F.regexp_like(word.substr(at, F.lit(1)), F.lit(r"\W"))

    def pieces_at(i: Column) -> Column:
        ends = F.filter(listed, lambda n: edge(i - 1) & edge(i + n)) if whole_words else listed
        return F.transform(ends, lambda n: word.substr(i, n))

    pieces = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(word)), pieces_at)))
    met = tokens.select(F.explode(pieces).alias("_term")).distinct()
    found = t.filter(~spaced & ~long_term).join(met, "_term", "left_semi").select("_t")
    names = dict(term_id="_t", term="_term", whole_words=whole_words)
    if 0 in lengths:
        big = tokens.filter(F.length(word) > PIECE).select(word.alias("doc_id"), word.alias("text"))
        found = found.unionByName(contained_terms(big, t.filter(~spaced & long_term), **names).select("_t"))
    if -1 in lengths:
        whole = docs.select(F.monotonically_increasing_id().alias("doc_id"), F.col(text).alias("text"))
        found = found.unionByName(contained_terms(stored(whole, "texts"), t.filter(spaced), **names).select("_t"))
    return found.select(F.col("_t").alias(term_id)).distinct()


def needle_presence(
    docs: DataFrame, needles: DataFrame, *, needle_id: str, needle: str, context: int = 60, case_insensitive: bool = False
) -> DataFrame:
    """Per needle and document: position and the text around it; absent needles have one row."""
    hits = contained_terms(
        docs, needles, term_id=needle_id, term=needle, case_insensitive=case_insensitive, context=context
    )
    return needles.select(needle_id).join(hits, needle_id, "left").withColumn("present", F.col("doc_id").isNotNull())


def lines(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line, numbered from 1."""
    cols = [c for c in df.columns if c != text]
    return df.select(*cols, F.posexplode(F.split(text, "\n")).alias("_i", "line")).select(
        *cols, (F.col("_i") + 1).alias("line_number"), "line"
    )


def corpus_grep(
    docs: DataFrame,
    *,
    query: str,
    regex: bool = False,
    case_insensitive: bool = True,
    max_matches: int | None = None,
    max_chars: int | None = None,
    include: Column | None = None,
) -> DataFrame:
    """All lines that match. ``max_matches`` takes the first in document and line order, ``max_chars`` skips longer texts."""
    df = docs if max_chars is None else docs.filter(F.length("text") <= max_chars)
    if include is not None:
        df = df.filter(include)
    found = lines(df.select("doc_id", "text"))
    if regex:
        hit = F.col("line").rlike(f"(?i){query}" if case_insensitive else query)
    else:
        hit = F.lower("line").contains(query.lower()) if case_insensitive else F.col("line").contains(query)
    found = found.filter(hit)
    return found.orderBy("doc_id", "line_number").limit(max_matches) if max_matches else found


def line_range(docs: DataFrame, *, start: int, end: int, max_lines: int | None = None) -> DataFrame:
    """Lines start..end of each text (with ``max_lines`` at most so many) with the number of all lines."""
    end = end if max_lines is None else min(end, start + max_lines - 1)
    cut = docs.withColumn("_all", F.split("text", "\n"))
    part = F.slice("_all", start, end - start + 1)
    rows = cut.select("doc_id", F.size("_all").alias("total_lines"), F.posexplode(part).alias("_i", "line"))
    return rows.select("doc_id", (F.col("_i") + start).alias("line_number"), "line", "total_lines")


def keyword_distribution(df: DataFrame, keywords: Sequence[str], *, text: str = "text") -> DataFrame:
    """Share of each keyword in all keyword hits, in percent; keywords without hits get 0.

    The keyword list is given by the caller, and words are counted before they are shuffled.
    """
    wanted = list(dict.fromkeys(keywords))
    listed = F.array(*[F.lit(w) for w in wanted]).cast("array<string>")
    mine = F.filter(words(F.col(text)), lambda w: F.array_contains(listed, w))
    found = df.select(F.explode(mine).alias("keyword"))
    counts = found.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
    listed = df.sparkSession.createDataFrame([(w,) for w in wanted], "keyword string")
    filled = listed.join(counts, "keyword", "left").select("keyword", F.coalesce("n", F.lit(0)).alias("n"))
    # A row per keyword of the list: its total needs no second pass over the texts.
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return filled.withColumn("pct", F.coalesce(F.try_divide(F.col("n"), total) * 100, F.lit(0.0)))


def drift_comparison(
    old: DataFrame, new: DataFrame, *, old_keywords: Sequence[str], new_keywords: Sequence[str], label: str
) -> DataFrame:
    """Keyword shares of the positive class in two periods, with sample totals and class shares."""
    parts = []
    for name, df, kws in (("old", old, old_keywords), ("new", new, new_keywords)):
        shares = keyword_distribution(df.filter(F.col(label) == 1), kws)
        parts.append(shares.select(F.lit(name).alias("period"), F.lit("keyword").alias("kind"), "keyword", F.col("pct").alias("value")))
        one = df.agg(F.count(F.lit(1)).cast("double").alias("samples"), (F.avg(label) * 100).alias("positive_pct"))
        rows = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("samples", "positive_pct")]
        parts.append(
            one.select(F.inline(F.array(*rows))).select(F.lit(name).alias("period"), "kind", F.lit("-").alias("keyword"), "value")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def top_tokens(df: DataFrame, *, k: int = 10, text: str = "text") -> DataFrame:
    counts = df.select(F.explode(words(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "token").limit(k)


def sensitive_counts(df: DataFrame, *, text: str = "text", patterns: dict[str, str] = SENSITIVE_PATTERNS) -> DataFrame:
    """Each row with the number of matches per class (columns ``n_<class>``)."""
    return df.withColumns({f"n_{name}": count_matches(F.col(text), p) for name, p in patterns.items()})


def pii_leak_scan(df: DataFrame, *, text: str = "text", patterns: dict[str, str] = SENSITIVE_PATTERNS) -> DataFrame:
    """Rows with a finding and matches per class, in one pass over the texts."""
    counted = sensitive_counts(spread(df.select(text)), text=text, patterns=patterns)
    one = counted.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(f"n_{n}") > 0).alias(f"r_{n}") for n in patterns],
        *[F.sum(f"n_{n}").alias(f"m_{n}") for n in patterns],
    )
    rows = [
        F.struct(F.lit(n).alias("class"), F.col(f"r_{n}").alias("rows_with"), F.col(f"m_{n}").alias("matches")) for n in patterns
    ]
    return one.select("rows", F.inline(F.array(*rows)))
