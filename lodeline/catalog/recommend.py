"""Neighbors, recommendations and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeline.catalog import query
from lodeline.catalog.fixtures import ARRIVAL, RAT, RAW, r6, ratings, raw_ratings, table
from lodeline.catalog.timeline import HELD, TIME_ORDER
from lodeline.operators import recsys, windows
from lodeline.operators.aggregates import topk_per_group
from lodeline.session import stored


def _recommend_sql(source: str, k: int, n: int) -> str:
    """The common table expressions nb (neighbors) and rec (recommendations) over ``source``."""
    return f"""nr AS (SELECT s."user", item, rating / sqrt(q) AS w FROM {source} s JOIN
        (SELECT "user", sum(rating * rating) AS q FROM {source} GROUP BY 1) z ON z."user" = s."user"),
    pr AS (SELECT a."user", b."user" AS neighbor, round(sum(a.w * b.w), 9) AS sim FROM nr a JOIN nr b
           ON a.item = b.item AND a."user" <> b."user" GROUP BY 1, 2),
    nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY sim DESC, neighbor) AS rank FROM pr)
           WHERE rank <= {k}),
    cand AS (SELECT nb."user", s.item, round(sum(sim * rating), 9) AS score FROM nb JOIN {source} s
             ON s."user" = nb.neighbor AND rating >= 4 GROUP BY 1, 2),
    opn AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM {source} s WHERE s."user" = c."user" AND s.item = c.item)),
    rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS rank FROM opn)
            WHERE rank <= {n})"""


@query("pair_similarity_join", f"""WITH {RAT}, {_recommend_sql("rat", 20, 10)}
    SELECT "user", neighbor, sim, CAST(rank AS INTEGER) AS rank FROM nb""")
def _(spark, sf):
    return recsys.user_neighbors(ratings(spark, sf), k=20)


@query("user_knn_recommend", f"""WITH {RAT}, {_recommend_sql("rat", 20, 10)}
    SELECT "user", item, CAST(rank AS INTEGER) AS rank, score, coalesce(p_name, 'Movie ' || item) AS title
    FROM rec LEFT JOIN part ON item = p_partkey""")
def _(spark, sf):
    recs = recsys.recommend(ratings(spark, sf))
    titles = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("title"))
    out = recsys.enrich_title(recs, titles)
    return out.select("user", "item", "rank", "score", "title")


@query("enrich_title", f"""WITH {RAT} SELECT "user", item, coalesce(p_name, 'Movie ' || item) AS title
    FROM rat LEFT JOIN part ON item = p_partkey AND p_size > 10""")
def _(spark, sf):
    titles = table(spark, sf, "part").filter(F.col("p_size") > 10)
    titles = titles.select(F.col("p_partkey").alias("item"), F.col("p_name").alias("title"))
    return recsys.enrich_title(ratings(spark, sf), titles).select("user", "item", "title")


@query("unseen_items", f"""WITH {RAT}, {_recommend_sql("rat", 3, 10)} SELECT "user", item, score FROM opn""")
def _(spark, sf):
    r = ratings(spark, sf)
    found = recsys.candidate_items(recsys.user_neighbors(r, k=3), r)
    return recsys.unseen_items(found, r).select("user", "item", "score")


TRAIN = f"""{RAW}, {HELD}, tr AS (SELECT "user", item, CAST(sum(rating) AS BIGINT) AS rating FROM held
      WHERE NOT (size > 5 AND back <= 5) GROUP BY 1, 2),
  liked AS (SELECT "user", item, max(rating) AS rating FROM held WHERE size > 5 AND back <= 5 GROUP BY 1, 2)"""


@query("relevant_hits", f"""WITH {TRAIN}, {_recommend_sql("tr", 20, 5)}
    SELECT "user", item FROM rec r WHERE EXISTS
      (SELECT 1 FROM liked l WHERE l."user" = r."user" AND l.item = r.item AND l.rating >= 4)""")
def _(spark, sf):
    marked = windows.last_n_holdout(raw_ratings(spark, sf), user="user", order=TIME_ORDER, n=5)
    marked = stored(marked.select("user", "item", "rating", "held"), "marked")
    recs = recsys.recommend(recsys.user_item(marked.filter(~F.col("held"))), topn=5)
    return recsys.relevant_hits(recs, marked.filter("held")).select("user", "item")


@query("precision_at_k", f"""WITH {TRAIN}, {_recommend_sql("tr", 20, 5)},
    h AS (SELECT r."user", count(*) AS recs, count(l.item) AS hits FROM rec r LEFT JOIN liked l
          ON l."user" = r."user" AND l.item = r.item AND l.rating >= 4 GROUP BY 1)
    SELECT "user", recs, hits, round(hits / recs, 6) AS "precision" FROM h WHERE "user" IN (SELECT "user" FROM liked)""")
def _(spark, sf):
    made = recsys.precision_at_k(raw_ratings(spark, sf), order=TIME_ORDER)
    return made.withColumn("precision", r6(F.col("precision")))


@query("holdout_complement", f"""WITH {RAW}, {HELD} SELECT "user", item, rating, ord, line FROM raw r WHERE NOT EXISTS
    (SELECT 1 FROM held h WHERE size > 5 AND back <= 5 AND h.ord = r.ord AND h.line = r.line AND h.price = r.price
       AND h.ship = r.ship AND h.item = r.item AND h.rating = r.rating)""")
def _(spark, sf):
    raw = raw_ratings(spark, sf)
    held = windows.last_n_holdout(raw, user="user", order=TIME_ORDER, n=5).filter("held")
    return recsys.holdout_complement(raw, held, key=ARRIVAL).select("user", "item", "rating", "ord", "line")


@query("topk_per_group", f"""WITH {RAT} SELECT "user", item, rating, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY rating DESC, item) AS rank FROM rat) WHERE rank <= 5""")
def _(spark, sf):
    return topk_per_group(ratings(spark, sf), group=["user"], order=[F.desc("rating"), F.asc("item")], k=5)
