"""Text, search, conversations and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeline.catalog import query
from lodeline.catalog.fixtures import LAB, labeled, r6, sql_words, table
from lodeline.functions import text as tx
from lodeline.functions.rubrics import RUBRICS, rubric_score, rubric_sql
from lodeline.functions.scalar import snippet
from lodeline.operators import conversations as conv
from lodeline.operators import corpus, records
from lodeline.plans.layout import spread

# Common English words used as keywords.
KEYWORDS = ["the", "of", "and", "to", "in", "that"]
NEW_KEYWORDS = ["is", "for", "with", "from", "this"]


def _kw_sql(where: str, words: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""SELECT k.keyword, count(t.w) AS n FROM (SELECT unnest([{listed}]) AS keyword) k LEFT JOIN
      (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM ({where})) t ON t.w = k.keyword GROUP BY 1"""


@query("keyword_distribution", f"""WITH c AS ({_kw_sql("SELECT text FROM documents", KEYWORDS)})
    SELECT keyword, n, round(n / (SELECT sum(n) FROM c) * 100, 6) AS pct FROM c""")
def _(spark, sf):
    df = corpus.keyword_distribution(table(spark, sf, "documents"), KEYWORDS)
    return df.withColumn("pct", r6(F.col("pct")))


OLD = "CAST(substr(source, 4) AS INTEGER) < 10"


@query(
    "drift_comparison",
    f"""WITH {LAB}, o AS ({_kw_sql(f"SELECT text FROM lab WHERE {OLD} AND quality = 1", KEYWORDS)}),
        n AS ({_kw_sql(f"SELECT text FROM lab WHERE NOT {OLD} AND quality = 1", NEW_KEYWORDS)})
        SELECT 'old' AS period, 'keyword' AS kind, keyword, round(n / (SELECT sum(n) FROM o) * 100, 6) AS value FROM o
        UNION ALL SELECT 'new', 'keyword', keyword, round(n.n / (SELECT sum(n) FROM n) * 100, 6) FROM n
        UNION ALL SELECT CASE WHEN {OLD} THEN 'old' ELSE 'new' END AS p, 'samples', '-', CAST(count(*) AS DOUBLE) FROM lab GROUP BY 1
        UNION ALL SELECT CASE WHEN {OLD} THEN 'old' ELSE 'new' END AS p, 'positive_pct', '-', round(avg(quality) * 100, 6)
        FROM lab GROUP BY 1""",
)
def _(spark, sf):
    lab = labeled(spark, sf)
    old = F.expr("int(substr(source, 4)) < 10")
    df = corpus.drift_comparison(
        lab.filter(old), lab.filter(~old), old_keywords=KEYWORDS, new_keywords=NEW_KEYWORDS, label="quality"
    )
    return df.withColumn("value", r6(F.col("value")))


@query("top_tokens", f"""WITH {LAB}, t AS (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS token FROM lab WHERE quality = 1)
    SELECT token, count(*) AS n FROM t WHERE token <> '' GROUP BY 1 ORDER BY n DESC, token LIMIT 10""")
def _(spark, sf):
    return corpus.top_tokens(labeled(spark, sf).filter(F.col("quality") == 1))


@query(
    "token_estimate",
    f"""SELECT doc_id, CAST(greatest(floor(length(text) / 4), 1) AS BIGINT) AS chars,
          CAST(floor({sql_words("text")} * CAST(1.3 AS DOUBLE)) AS BIGINT) AS words_up,
          CAST(floor({sql_words("text")} * CAST(0.75 AS DOUBLE)) AS BIGINT) AS words_down FROM documents""",
)
def _(spark, sf):
    methods = ("chars", "words_up", "words_down")
    return table(spark, sf, "documents").select("doc_id", *[tx.token_estimate(F.col("text"), m).alias(m) for m in methods])


@query("strip_tags", rf"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), {tx.SQL_WHITE_SPACE}) AS text FROM pages""")
def _(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", tx.strip_tags(F.lit(None).cast("string"), F.col("html")).alias("text"))


@query(
    "snippet_preview",
    """SELECT doc_id, substr(text, 1, 280) AS preview,
              CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS short FROM documents""",
)
def _(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", snippet(t, 280).alias("preview"), snippet(t, 200, "…").alias("short"))


def _main_text_sql(html: str) -> str:
    t = f"regexp_replace({html}, '(?is)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "nav"):
        t = f"regexp_replace({t}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?is)<head[^>]*>.*?</head>', ' ', 'g')"
    block = "(?i)<(?:/p|/div|/h[1-6]|/li|/tr|/article|/section|/ul|/ol|/table|br)[^>]*>"
    t = f"regexp_replace({t}, '{block}', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    for entity, char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&nbsp;", "' '"), ("&amp;", "'&'")):
        t = f"replace({t}, '{entity}', {char})"
    t = f"regexp_replace({t}, '[ \\t\\r\\f]+', ' ', 'g')"
    return f"trim(regexp_replace({t}, '[ ]*\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"


@query("main_text", f"SELECT page_id, {_main_text_sql('html')} AS text FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.main_text(F.col("html")).alias("text"))


# ---- search --------------------------------------------------------------------------

LINES = """ln AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_number, len(l) AS total
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""


@query("line_range", f"""WITH {LINES} SELECT doc_id, CAST(line_number AS INTEGER) AS line_number, line,
    CAST(total AS INTEGER) AS total_lines FROM ln WHERE line_number BETWEEN 2 AND 4""")
def _(spark, sf):
    return corpus.line_range(table(spark, sf, "documents"), start=2, end=4)


@query(
    "corpus_grep",
    f"""WITH {LINES} SELECT 'literal' AS kind, doc_id, line_number, line FROM ln WHERE contains(lower(line), 'tion of')
        UNION ALL SELECT 'regex', doc_id, line_number, line FROM ln WHERE regexp_matches(line, '(?i)[0-9]{{3}}-[0-9]{{4}}')""",
)
def _(spark, sf):
    d = table(spark, sf, "documents")
    lit = corpus.corpus_grep(d, query="tion of").withColumn("kind", F.lit("literal"))
    rex = corpus.corpus_grep(d, query="[0-9]{3}-[0-9]{4}", regex=True).withColumn("kind", F.lit("regex"))
    return lit.unionByName(rex)


@query(
    "entity_mention_join",
    """SELECT b.item_id, d.doc_id, instr(d.text, b.text) AS position FROM benchmark b JOIN documents d ON contains(d.text, b.text)""",
)
def _(spark, sf):
    d = table(spark, sf, "documents")
    return corpus.contained_terms(d, table(spark, sf, "benchmark"), term_id="item_id", term="text")


def part_name_terms(spark, sf):
    """The distinct words of part names as short terms."""
    name = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("term")).distinct()
    return name.withColumn("term_id", F.col("term"))


@query(
    "entity_mention_words",
    """WITH t AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part)
       SELECT t.term AS term_id, d.doc_id, instr(d.text, t.term) AS position FROM t JOIN documents d ON contains(d.text, t.term)""",
)
def _(spark, sf):
    return corpus.contained_terms(table(spark, sf, "documents"), part_name_terms(spark, sf))


@query(
    "needle_presence",
    """SELECT b.item_id, d.doc_id, instr(d.text, b.text) AS position,
              replace(substr(d.text, greatest(instr(d.text, b.text) - 60, 1),
                CAST(instr(d.text, b.text) + length(b.text) + 60 - greatest(instr(d.text, b.text) - 60, 1) AS BIGINT)),
                chr(10), ' ') AS context, d.doc_id IS NOT NULL AS present
       FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text)""",
)
def _(spark, sf):
    return corpus.needle_presence(
        table(spark, sf, "documents"), table(spark, sf, "benchmark"), needle_id="item_id", needle="text"
    )


@query(
    "answer_contains",
    """SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(upper(b.text)))""",
)
def _(spark, sf):
    b = table(spark, sf, "benchmark").withColumn("text", F.upper("text"))
    hits = corpus.contained_terms(
        table(spark, sf, "documents"), b, term_id="item_id", term="text", case_insensitive=True
    )
    return hits.select("item_id", "doc_id")


@query(
    "position_accuracy",
    """WITH r AS (SELECT (item_id % 5) * 25 AS position,
                         EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text)) AS correct FROM benchmark b),
       p AS (SELECT position, count(*) AS n, count(*) FILTER (WHERE correct) AS "right" FROM r GROUP BY 1
             UNION ALL SELECT NULL, count(*), count(*) FILTER (WHERE correct) FROM r)
       SELECT position, n, "right", round("right" / n * 100, 6) AS accuracy_pct FROM p""",
)
def _(spark, sf):
    from lodeline.operators.reports import position_accuracy

    b = table(spark, sf, "benchmark")
    hits = corpus.contained_terms(table(spark, sf, "documents"), b, term_id="item_id", term="text")
    found = b.join(hits.select("item_id").distinct().withColumn("hit", F.lit(True)), "item_id", "left")
    results = found.select(((F.col("item_id") % 5) * 25).alias("position"), F.col("hit").isNotNull().alias("correct"))
    return position_accuracy(results).withColumn("accuracy_pct", r6(F.col("accuracy_pct")))


@query(
    "pii_leak_scan",
    "WITH t AS (SELECT 'documents' AS src, text FROM documents UNION ALL SELECT 'conversations', text FROM conversations) "
    + " UNION ALL ".join(
        f"""SELECT src, '{n}' AS class, count(*) AS rows,
                   count(*) FILTER (WHERE len(regexp_extract_all(text, '{p}')) > 0) AS rows_with,
                   CAST(sum(len(regexp_extract_all(text, '{p}'))) AS BIGINT) AS matches FROM t GROUP BY 1"""
        for n, p in tx.SENSITIVE_PATTERNS.items()
    ),
)
def _(spark, sf):
    d = corpus.pii_leak_scan(table(spark, sf, "documents")).withColumn("src", F.lit("documents"))
    c = corpus.pii_leak_scan(table(spark, sf, "conversations")).withColumn("src", F.lit("conversations"))
    return d.unionByName(c)


# ---- replies: conversation turns dressed up as model output ---------------------------


def replies(spark, sf):
    """Turns as structured replies: valid JSON, JSON in prose, broken JSON, fenced code, plain text."""
    c = table(spark, sf, "conversations")
    head = F.substring(F.regexp_replace("text", r"\s+", " "), 1, 40)
    payload = F.to_json(
        F.struct(
            F.array(F.struct(head.alias("text"), F.col("role").alias("key"), F.lit(0.9).alias("confidence"))).alias("decisions"),
            F.array(F.struct(F.concat(F.lit("Noted: "), head).alias("summary"), F.array(F.lit("coder")).alias("roles"))).alias("facts"),
            F.array().cast("array<string>").alias("plans"),
        )
    )
    kind = F.col("conv_id") % 5
    reply = (
        F.when(kind == 0, payload)
        .when(kind == 1, F.concat(F.lit("Here is the result: "), payload, F.lit(" as asked.")))
        .when(kind == 2, F.concat(F.lit('{"decisions": ['), head))
        .when(kind == 3, F.concat(F.lit("```python\n"), head, F.lit("\n```")))
        .otherwise(head)
    )
    return c.select("conv_id", "turn", F.col("role").alias("agent"), reply.alias("reply"))


@query(
    "extract_json_span",
    r"""WITH h AS (SELECT conv_id, turn, role, substr(regexp_replace(text, '\s+', ' ', 'g'), 1, 40) AS head FROM conversations)
        SELECT conv_id, turn, 'decision' AS type, head AS text, CAST(0.9 AS DOUBLE) AS confidence, 'planner' AS roles, 'plan' AS stages
        FROM h WHERE conv_id % 5 IN (0, 1)
        UNION ALL SELECT conv_id, turn, 'fact', 'Noted: ' || head, 0.7, 'planner,coder', 'plan' FROM h WHERE conv_id % 5 IN (0, 1)
        UNION ALL SELECT conv_id, turn, 'fact', trim(CASE conv_id % 5 WHEN 2 THEN '{"decisions": [' || head
            WHEN 3 THEN '```python' || chr(10) || head || chr(10) || '```' ELSE head END), 0.6, 'planner', 'plan'
        FROM h WHERE conv_id % 5 IN (2, 3, 4)""",
)
def _(spark, sf):
    items = records.extract_items(replies(spark, sf), text="reply", roles=["planner"], stages=["plan"])
    return items.select(
        "conv_id", "turn", "type", "text", "confidence",
        F.array_join("roles", ",").alias("roles"), F.array_join("stages", ",").alias("stages"),
    )


@query(
    "extract_fenced_block",
    """WITH r AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'Code:' || chr(10) || '```python' || chr(10) || text || '```' || ' end'
                    WHEN 1 THEN '```' || text || '```' ELSE text END AS reply FROM conversations)
       SELECT conv_id, turn, CASE WHEN regexp_matches(reply, '(?s)```python\\s*(.*?)```')
                THEN regexp_extract(reply, '(?s)```python\\s*(.*?)```', 1) ELSE reply END AS code FROM r""",
)
def _(spark, sf):
    c, t = table(spark, sf, "conversations"), F.col("text")
    reply = (
        F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Code:\n```python\n"), t, F.lit("``` end")))
        .when(F.col("conv_id") % 3 == 1, F.concat(F.lit("```"), t, F.lit("```")))
        .otherwise(t)
    )
    return c.select("conv_id", "turn", tx.fenced_block(reply).alias("code"))


@query(
    "clean_path_list",
    r"""WITH h AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages),
        x AS (SELECT page_id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM h),
        v AS (SELECT page_id, i, replace(trim(CASE WHEN i % 2 = 0 THEN ' .' || p || '/' ELSE replace(p, '/', '\') END), '\', '/') AS p FROM x),
        c AS (SELECT page_id, i, regexp_replace(regexp_replace(p, '^\./', ''), '/$', '') AS path FROM v)
        SELECT page_id, path, CAST(row_number() OVER (PARTITION BY page_id ORDER BY min(i)) - 1 AS INTEGER) AS at
        FROM c WHERE path <> '' GROUP BY page_id, path""",
)
def _(spark, sf):
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    odd = lambda p: F.replace(p, F.lit("/"), F.lit("\\"))
    messy = F.transform(hrefs, lambda p, i: F.when(i % 2 == 1, F.concat(F.lit(" ."), p, F.lit("/"))).otherwise(odd(p)))
    cleaned = table(spark, sf, "pages").select("page_id", tx.clean_path_list(messy).alias("l"))
    return cleaned.select("page_id", F.posexplode("l").alias("at", "path"))


def plan_records(spark, sf):
    """Turns as plan records, each sixth one broken in another way."""
    c, kind = table(spark, sf, "conversations"), F.col("conv_id") % 6
    name = F.concat(F.lit("src/"), "role", F.lit(".py"))
    files = F.when(kind == 1, F.array().cast("array<string>")).otherwise(F.array(name))
    approach = F.when(kind == 2, F.lit("short")).otherwise(F.concat(F.lit("Implement the following step by step: "), F.substring("text", 1, 30)))
    described = F.when(kind == 3, F.create_map(F.lit("other"), F.lit("x"))).otherwise(F.create_map(name, F.lit("entry point")))
    flow = F.when(kind == 4, F.array(F.lit(" "))).otherwise(F.array(F.lit("main")))
    full = F.to_json(
        F.struct(
            approach.alias("Implementation approach"),
            files.alias("File list"),
            described.alias("Data structures and interfaces"),
            flow.alias("Program call flow"),
            F.array(F.lit("./a/")).alias("Task list"),
        )
    )
    return c.select("conv_id", "turn", F.when(kind == 5, F.lit('{"File list": ["a.py"]}')).otherwise(full).alias("record"))


@query(
    "validate_record",
    """SELECT CASE conv_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'File list must contain at least one filename'
                WHEN 2 THEN 'Implementation approach must be descriptive'
                WHEN 3 THEN 'Data structures and interfaces must describe every file'
                WHEN 4 THEN 'Program call flow must be a list of non-empty strings'
                ELSE 'missing keys: Implementation approach, Data structures and interfaces, Program call flow, Task list'
              END AS reason, count(*) AS n FROM conversations GROUP BY 1""",
)
def _(spark, sf):
    checked = records.validate_plans(plan_records(spark, sf), "record")
    return checked.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "termination_flag",
    """SELECT conv_id, turn, regexp_matches(lower(t), '(terminate|task completed|conversation complete|no further action needed)') AS done
       FROM (SELECT conv_id, turn, text || CASE conv_id % 4 WHEN 0 THEN ' Task Completed.' WHEN 1 THEN ' TERMINATE' ELSE '' END AS t
             FROM conversations)""",
)
def _(spark, sf):
    tail = F.when(F.col("conv_id") % 4 == 0, " Task Completed.").when(F.col("conv_id") % 4 == 1, " TERMINATE").otherwise("")
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", tx.termination_flag(F.concat("text", tail)).alias("done"))


@query(
    "flatten_message_parts",
    """SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || role ELSE role END AS flat FROM conversations""",
)
def _(spark, sf):
    c, kind = table(spark, sf, "conversations"), F.col("conv_id") % 3
    part = lambda **kw: F.struct(*[v.alias(k) for k, v in kw.items()])
    two = F.concat(
        F.lit("["), F.to_json(part(text=F.col("text"))), F.lit(","), F.to_json(part(content=F.col("role"))), F.lit("]")
    )
    one = F.to_json(F.array(part(content=F.col("role"))))
    content = F.when(kind == 0, F.col("text")).when(kind == 1, two).otherwise(one)
    return c.select("conv_id", "turn", tx.flatten_parts(content).alias("flat"))


PROMPTS = list(RUBRICS)
_PROMPT_SQL = f"[{', '.join(repr(p) for p in PROMPTS)}][doc_id % {len(PROMPTS)} + 1]"


@query("rubric_score", f"""WITH r AS (SELECT doc_id, {_PROMPT_SQL} AS prompt, text FROM documents)
    SELECT doc_id, prompt, CAST({rubric_sql("prompt", "text")} AS INTEGER) AS score FROM r""")
def _(spark, sf):
    ids = F.array(*[F.lit(p) for p in PROMPTS])
    prompt = F.get(ids, (F.col("doc_id") % len(PROMPTS)).cast("int"))
    d = spread(table(spark, sf, "documents").select("doc_id", prompt.alias("prompt"), "text"))
    d = d.withColumn("lowered", F.lower("text"))
    score = rubric_score(F.col("prompt"), F.col("text"), lower=F.col("lowered"))
    return d.select("doc_id", "prompt", score.alias("score"))


# ---- conversations -------------------------------------------------------------------


@query(
    "conversation_assemble",
    """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, role, text
       FROM conversations WHERE role <> 'system'""",
)
def _(spark, sf):
    return conv.conversation_assemble(table(spark, sf, "conversations")).select("conv_id", "position", "role", "text")


@query(
    "render_chat_template",
    """SELECT conv_id, CAST(0 AS BIGINT) AS part, string_agg(CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'Human' ELSE 'Assistant' END
                || ': ' || text || chr(10), '' ORDER BY turn) || 'Assistant: ' AS prompt FROM conversations GROUP BY 1""",
)
def _(spark, sf):
    return conv.render_chat_template(table(spark, sf, "conversations"))


@query(
    "stage_progression",
    """WITH s AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'planner' WHEN 'assistant' THEN 'coder' ELSE 'reviewer' END AS spoken
                 FROM conversations),
       a AS (SELECT conv_id, min(turn) AS e0 FROM s WHERE spoken = 'planner' GROUP BY 1),
       b AS (SELECT s.conv_id, min(turn) AS e1 FROM s JOIN a USING (conv_id) WHERE spoken = 'coder' AND turn > e0 GROUP BY 1)
       SELECT conv_id, turn, spoken, CASE WHEN e0 IS NULL OR turn <= e0 THEN 'plan' WHEN e1 IS NULL OR turn <= e1 THEN 'execute'
              ELSE 'review' END AS stage FROM s LEFT JOIN a USING (conv_id) LEFT JOIN b USING (conv_id)""",
)
def _(spark, sf):
    c = table(spark, sf, "conversations")
    spoken = F.when(F.col("role") == "user", "planner").when(F.col("role") == "assistant", "coder").otherwise("reviewer")
    staged = conv.stage_progression(c.withColumn("spoken", spoken), conv="conv_id", order="turn", role="spoken")
    return staged.select("conv_id", "turn", "spoken", "stage")
