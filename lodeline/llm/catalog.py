"""The registered queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeline.catalog import query
from lodeline.catalog.fixtures import table
from lodeline.llm import language_id, url_filter
from lodeline.llm.common import LOWER, UPPER, crc_mod
from lodeline.llm.decontaminate import contamination
from lodeline.llm.html_text import extract_text
from lodeline.llm.lattice_lm import lattice_scores
from lodeline.llm.line_dedup import dedup_lines
from lodeline.llm.packing import pack_documents
from lodeline.llm.pivot_index import near_vectors
from lodeline.llm.prefix_trie import rebuilt_trie
from lodeline.llm.secret_scan import BASE_KINDS, KINDS, find_secrets, written
from lodeline.llm.simhash import near_duplicates
from lodeline.llm.token_alignment import align_documents
from lodeline.llm.warc import round_trip

SQL_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def sql_lower(expr: str) -> str:
    return f"translate({expr}, '{UPPER}', '{LOWER}')"


@query(
    "op1_line_dedup",
    f"""WITH ln AS (
      SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
             unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
    k AS (SELECT *, {sql_lower(f"trim(line, {SQL_BLANKS})")} AS key FROM ln),
    rep AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    m AS (SELECT k.doc_id, k.pos, k.line, r.top IS NOT NULL AND k.doc_id < r.top AS lost
          FROM k LEFT JOIN rep r ON k.key = r.key)
    SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (lost) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
    FROM m GROUP BY doc_id""",
)
def op1_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """A public vocabulary file of the contracts; every machine has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_simhash")
def op2_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op3_lattice_lm")
def op3_lattice_lm(spark, sf_dir):
    return lattice_scores(table(spark, sf_dir, "documents"), vocabulary())


def _url_sql() -> str:
    alone = lambda terms: f"'(^|[^\\p{{L}}])({'|'.join(terms)})([^\\p{{L}}]|$)'"
    strict = f"regexp_matches(low, {alone(url_filter.STRICT)})"
    soft = " + ".join(f"CAST(regexp_matches(low, {alone([t])}) AS INTEGER)" for t in url_filter.SOFT)
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    longest = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in longest)
    verdict = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in longest)
    return f"""WITH a AS (
      SELECT page_id, coalesce({sql_lower("url")}, '') AS low,
             CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
    c AS (SELECT *, {sql_lower("h")} AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
    d AS (SELECT *, CASE {rule} END AS rule FROM c)
    SELECT page_id, host, path, rule,
           CASE {verdict} WHEN {strict} OR ({soft}) >= {url_filter.MIN_SOFT} THEN 'block' ELSE 'allow' END AS verdict FROM d"""


@query("op4_url_filter", _url_sql())
def op4_url_filter(spark, sf_dir):
    found = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict")


SQL_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op6_decontaminate",
    f"""WITH b AS (SELECT item_id, {SQL_WORDS.format(sql_lower("coalesce(text, '')"))} AS w FROM benchmark),
    win AS (SELECT item_id, least(len(w), 10) AS l, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i, w
            FROM b WHERE len(w) > 0),
    wt AS (SELECT DISTINCT item_id, l, array_to_string(w[i + 1:i + l], ' ') AS t FROM win),
    d AS (SELECT doc_id, {SQL_WORDS.format(sql_lower("coalesce(text, '')"))} AS w FROM documents),
    p AS (SELECT doc_id, l, unnest(range(0, len(w) - l + 1)) AS i, w FROM d, (SELECT DISTINCT l FROM wt) WHERE len(w) >= l),
    h AS (SELECT p.doc_id, p.i, p.l, wt.item_id
          FROM (SELECT doc_id, i, l, array_to_string(w[i + 1:i + l], ' ') AS t FROM p) p JOIN wt USING (l, t)),
    hw AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS pos FROM h) GROUP BY 1),
    hi AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
           FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hw.n, 0) AS n_hit, coalesce(hi.n, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""",
)
def op6_decontaminate(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


@query("op10_language_id")
def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(True))
    model = language_id.fit(docs, ~held)
    found = language_id.predict(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query("op5_html_text")
def op5_html_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query(
    "op7_warc",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    s AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
    o AS (SELECT payload_digest, min(page_id) AS owner FROM s WHERE payload_bytes >= 100 GROUP BY 1)
    SELECT page_id, payload_bytes, s.payload_digest,
           CASE WHEN page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id <> owner THEN owner END AS refers_to
    FROM s LEFT JOIN o USING (payload_digest)""",
)
def op7_warc(spark, sf_dir):
    found = round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op9_pivot_index",
    """WITH RECURSIVE e AS (
      SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
    r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.c = l.a)
    SELECT r.vec_id, (SELECT count(*) FROM l WHERE l.a = r.vec_id) AS n_links, min(c) AS component_id,
           r.vec_id = min(c) AS kept FROM r GROUP BY r.vec_id""",
)
def op9_pivot_index(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


_SQL_CRC = """xor(list_reduce([4294967295] || flatten(list_transform(string_split(CAST({} AS VARCHAR), ''),
      lambda s: [CAST(ord(s) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"""


@query(
    "op11_prefix_trie",
    f"""WITH t AS (
      SELECT conv_id, turn, coalesce(text, '') AS text,
             sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
      FROM conversations WHERE conv_id IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM t),
    c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, {_SQL_CRC.format("conv_id")} % 6 AS h FROM t),
    r AS (SELECT c.conv_id, o.pos, o.digest, length(o.text) AS chars FROM c JOIN o ON o.conv_id = c.base AND o.pos <= c.h
          UNION ALL SELECT c.conv_id, o.pos, o.digest, length(o.text) FROM c JOIN o USING (conv_id) WHERE o.pos > c.h),
    a AS (SELECT c.conv_id, list(r.digest ORDER BY r.pos) FILTER (r.pos IS NOT NULL) AS ds,
                 list(r.chars ORDER BY r.pos) FILTER (r.pos IS NOT NULL) AS cs
          FROM c LEFT JOIN r USING (conv_id) GROUP BY 1),
    p AS (SELECT conv_id, coalesce(len(ds), 0) AS n, unnest(range(0, coalesce(len(ds), 0) + 1)) AS depth, ds, cs FROM a),
    k AS (SELECT conv_id, depth, n = depth AS ends, sha256(coalesce(array_to_string(ds[1:depth], ','), '')) AS key,
                 sha256(coalesce(array_to_string(ds[1:depth - 1], ','), '')) AS up,
                 CASE WHEN depth > 0 THEN cs[depth] ELSE 0 END AS chars FROM p),
    v AS (SELECT depth, key, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(chars) AS saved,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
          FROM k GROUP BY depth, key),
    ch AS (SELECT depth - 1 AS depth, up AS key, count(*) AS n FROM v WHERE depth > 0 GROUP BY 1, 2),
    w AS (SELECT v.*, coalesce(ch.n, 0) AS n_children FROM v LEFT JOIN ch ON ch.depth = v.depth AND ch.key = v.key),
    s AS (SELECT k.depth, k.key, CAST(sum(w.saved) AS BIGINT) AS saved_tokens, count(*) FILTER (w.n_children = 0) AS n_leaves
          FROM w JOIN k ON k.conv_id = w.conv_id AND k.depth <= w.depth GROUP BY k.depth, k.key)
    SELECT w.conv_id, w.depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
    FROM w JOIN s ON s.depth = w.depth AND s.key = w.key LEFT JOIN v u ON u.depth = w.depth - 1 AND u.key = w.up""",
)
def op11_prefix_trie(spark, sf_dir):
    return rebuilt_trie(table(spark, sf_dir, "conversations"))


@query("op12_secret_scan")
def op12_secret_scan(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    of = lambda kind: F.filter("secrets", lambda s: s["kind"] == kind)
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("secrets")).alias("spans"),
    )


@query("op13_token_alignment")
def op13_token_alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align_documents(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
