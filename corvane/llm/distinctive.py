"""Problem 7: how distinctive a term is of a record.

One pass over the postings gives two scores. Residual idf is the observed idf less the idf that a Poisson spread of the
term's occurrences would give, times the term's frequency in the record: it rewards terms that are concentrated in few
records. TF-IDF is the score that p7_found is defined by; both come from the same statistics and the same join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import idf, tf_weight
from corvane.llm.registry import query
from corvane.operators.skew import heavy_keys, salted_join
from corvane.plans.registry import POSTS
from corvane.session import settle
from corvane.sources.tables import clean_postings, table


def scores(postings: DataFrame) -> DataFrame:
    """(page_id, term, tf, tfidf, ridf) of each valid posting, statistics counted from these postings alone.

    Invalid rows (null term or page, tf null or below 1) are no postings; copies count once; an empty table gives no
    rows. Frequent terms are salted in the join with the statistics, which have one row per term.
    """
    rows = settle(clean_postings(postings))
    n = rows.select("page_id").distinct().agg(F.count("*").alias("n"))
    stats = rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    heavy = heavy_keys(stats, "term", "df")
    expected = -F.log2(1 - F.exp(-F.col("cf") / F.col("n")))
    residual = -F.log2(F.col("df") / F.col("n")) - expected
    return (
        salted_join(rows, stats, "term", heavy)
        .crossJoin(F.broadcast(n))
        .select(
            "page_id", "term", "tf",
            F.round(tf_weight(F.col("tf")) * idf(F.col("df"), F.col("n")), 6).alias("tfidf"),
            F.round(F.col("tf") * residual, 6).alias("ridf"),
        )
    )


def best_term(scored: DataFrame, score: str) -> DataFrame:
    """(page_id, term): the term of the highest score; equal scores: the smaller by code points."""
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col("term").alias("t"))).alias("b")
    return scored.groupBy("page_id").agg(best).select("page_id", F.col("b.t").alias("term"))


STATS = f"""WITH {POSTS}, n AS (SELECT count(DISTINCT page_id)::DOUBLE AS n FROM posts),
    d AS (SELECT term, count(*)::DOUBLE AS df, sum(tf)::DOUBLE AS cf FROM posts GROUP BY 1),
    s AS (SELECT page_id, term, tf, round((1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1), 6) AS tfidf,
    round(tf * (log2(1 - exp(-cf / n)) - log2(df / n)), 6) AS ridf FROM posts JOIN d USING (term), n)"""


@query(
    "p7_found",
    f"""{STATS} SELECT page_id, term FROM (SELECT page_id, term,
    row_number() OVER (PARTITION BY page_id ORDER BY tfidf DESC, term) AS k FROM s) WHERE k = 1""",
)
def found(spark, where):
    return best_term(scores(table(spark, where, "postings")), "tfidf")


@query("p7_scores", f"{STATS} SELECT page_id, term, tf, tfidf, ridf FROM s")
def all_scores(spark, where):
    return scores(table(spark, where, "postings"))


@query(
    "p7_best_ridf",
    f"""{STATS} SELECT page_id, term FROM (SELECT page_id, term,
    row_number() OVER (PARTITION BY page_id ORDER BY ridf DESC, term) AS k FROM s) WHERE k = 1""",
)
def best_residual(spark, where):
    return best_term(scores(table(spark, where, "postings")), "ridf")
