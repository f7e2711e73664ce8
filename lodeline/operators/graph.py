"""Graph tables from text, traversal by levels, and query subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.operators.corpus import lines, mentioned_terms
from lodeline.session import stored

TERM_PATTERN = "[A-Z][a-z]+"


def neighbor_triples(docs: DataFrame, *, pattern: str = TERM_PATTERN) -> DataFrame:
    """Default extraction: each capitalized term of a line with the next one.

    The number of triples is linear in the text; no line yields all pairs of its terms.
    """
    terms = lines(docs.select("doc_id", "text")).withColumn("t", F.regexp_extract_all("line", F.lit(pattern), F.lit(0)))
    ends = F.greatest(F.size("t") - 1, F.lit(0))
    paired = F.arrays_zip(F.slice("t", 1, ends).alias("a"), F.slice("t", 2, ends).alias("b"))
    p = terms.select("doc_id", F.explode(paired).alias("p"))
    p = p.select("doc_id", F.col("p.a").alias("source"), F.col("p.b").alias("target"), F.lit("next_to").alias("type"))
    return p.filter(F.col("source") != F.col("target"))


def extract_triples(docs: DataFrame, extract_fn, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, source, target, type): what a user's extractor finds in each text.

    ``extract_fn`` is a function from a text to (source, target, type) tuples, or a class whose ``eval`` is
    one; an object of the class is made once per task, so it may load a model. It becomes a table function
    that is called laterally for every document. A null text is not given to it.
    """
    handler = extract_fn
    if not isinstance(extract_fn, type):

        class handler:  # noqa: N801
            def eval(self, text: str):
                yield from extract_fn(text)

    triples = F.udtf(handler, returnType="source string, target string, type string")
    found = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    return found.lateralJoin(triples(F.col("_text").outer())).drop("_text")


def build_graph_tables(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables from (source, target, type) rows; repeated edges add weight.

    The triples may come from ``neighbor_triples`` or from an extractor of the user's own (see
    ``extract_triples``).
    """
    edges = triples.groupBy("source", "target", "type").agg(F.count(F.lit(1)).alias("weight"))
    ends = triples.select(F.explode(F.array("source", "target")).alias("id"))
    nodes = ends.groupBy("id").agg(F.count(F.lit(1)).alias("mentions"))
    return nodes, edges


def query_subgraph(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, *, whole_words: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges with an end mentioned in a retrieved chunk, and the nodes they connect."""
    nodes = stored(nodes, "nodes")
    seen = mentioned_terms(chunks, nodes.select(F.col("id").alias("term_id"), F.col("id").alias("term")), whole_words=whole_words)
    seen = stored(seen.select(F.col("term_id").alias("id"), F.lit(True).alias("_seen")), "mentioned")
    at = lambda end: seen.select(F.col("id").alias(end), F.col("_seen").alias(f"_{end}"))
    met = edges.join(at("source"), "source", "left").join(at("target"), "target", "left")
    met = met.filter(F.col("_source").isNotNull() | F.col("_target").isNotNull())
    kept = stored(met.select(*edges.columns).distinct(), "kept")
    ends = kept.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return nodes.join(ends, "id", "left_semi"), kept


def bfs(
    edges: DataFrame,
    seeds: DataFrame,
    *,
    max_depth: int = 2,
    hosts: DataFrame | None = None,
    same_host: bool = False,
) -> DataFrame:
    """Nodes with the smallest number of steps from a seed (``node, depth``).

    ``edges`` has src and dst, ``seeds`` has node. One join per level; each level is stored,
    so later levels do not recompute earlier ones. With ``same_host`` only nodes on a seed's
    host are entered (``hosts``: node, host).
    """
    if same_host:
        home = hosts.join(seeds, "node", "left_semi").select("host").distinct()
        inside = hosts.join(home, "host", "left_semi").select(F.col("node").alias("dst"))
        edges = edges.join(inside, "dst", "left_semi")
    frontier = stored(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "bfs")
    visited = frontier
    for depth in range(1, max_depth + 1):
        reached = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        fresh = reached.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))
        frontier = stored(fresh, "bfs")
        visited = visited.unionByName(frontier)
    return visited


def link_graph(pages: DataFrame, *, same_host: bool = False) -> DataFrame:
    """Pages and their relative links as a two-sided graph: page -> link -> page.

    Two pages with a common link are two steps apart; pairs of pages are never written. With
    ``same_host`` a link belongs to the host of its page, so no walk leaves a host.
    """
    href = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))))
    host = F.coalesce(F.parse_url("url", F.lit("HOST")), F.lit("")) if same_host else F.lit("")
    link = pages.select(F.concat(F.lit("p:"), F.col("page_id").cast("string")).alias("page"), host.alias("host"), href.alias("href"))
    link = link.withColumn("href", F.concat(F.lit("h:"), "host", "href"))
    there = link.select(F.col("page").alias("src"), F.col("href").alias("dst"))
    return there.unionByName(link.select(F.col("href").alias("src"), F.col("page").alias("dst")))


def bounded_crawl(
    pages: DataFrame, *, seed: int = 0, max_depth: int = 2, max_pages: int | None = None, same_host: bool = True
) -> DataFrame:
    """Pages in breadth-first order from a seed; within a level by URL, then id.

    ``same_host`` stays on the seed's host; ``max_pages`` takes the first so many. The links are
    read from the pages once.
    """
    edges = stored(link_graph(pages, same_host=same_host), "links")
    found = bfs(edges, pages.sparkSession.createDataFrame([(f"p:{seed}",)], "node string"), max_depth=2 * max_depth)
    on_page = found.filter(F.col("node").startswith("p:")).select(
        F.substring_index("node", ":", -1).cast("long").alias("page_id"), (F.col("depth") / 2).cast("int").alias("depth")
    )
    listed = on_page.join(pages.select("page_id", "url"), "page_id").orderBy("depth", "url", "page_id")
    return listed if max_pages is None else listed.limit(max_pages)
