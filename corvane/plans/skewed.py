"""Problem 3: per-term and per-domain results that stay even although a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import skew
from corvane.plans.registry import HOST, NUM_PAGES, POSTS, query
from corvane.sources.tables import clean_postings, page_hosts, table

SHARE = 0.025


def term_pairs(spark, where):
    return skew.compress(clean_postings(table(spark, where, "postings")), "term", "tf", "tf")


def host_pairs(spark, where):
    return skew.compress(page_hosts(table(spark, where, "pages")), "host", "pagerank")


@query(
    "p3_found",
    f"""WITH {POSTS}, {NUM_PAGES}, h AS (SELECT {HOST.format("url")} AS host, count(*) AS n FROM cur GROUP BY 1),
    t AS (SELECT term, count(*) AS n FROM posts GROUP BY 1)
    SELECT 'term' AS field, term AS key_value FROM t WHERE n * 1000 >= 25 * (SELECT sum(n) FROM t)
    UNION ALL SELECT 'domain', host FROM h WHERE n * 1000 >= 25 * (SELECT sum(n) FROM h)""",
)
def found(spark, where):
    terms = skew.per_key(term_pairs(spark, where), "term", "tf")
    hosts = skew.per_key(host_pairs(spark, where), "host", "pagerank")
    named = skew.named_heavy(terms, "term", "n_rows", SHARE, "term")
    return named.unionByName(skew.named_heavy(hosts, "host", "n_rows", SHARE, "domain")).distinct()


@query(
    "p3_terms",
    f"""WITH {POSTS}, f AS (SELECT term, tf, count(*) AS freq FROM posts GROUP BY 1, 2)
    SELECT term, sum(freq)::BIGINT AS postings, sum(freq * tf)::BIGINT AS sum_tf, count(*)::BIGINT AS tf_values,
    arg_min(tf, -freq * 1000000 + tf)::INT AS mode_tf FROM f GROUP BY term""",
)
def per_term(spark, where):
    out = skew.per_key(term_pairs(spark, where), "term", "tf")
    return out.select(
        "term", F.col("n_rows").alias("postings"), F.col("weight").cast("long").alias("sum_tf"),
        F.col("n_values").alias("tf_values"), F.col("mode_value").alias("mode_tf"),
    )


@query(
    "p3_domains",
    f"""WITH {NUM_PAGES} SELECT {HOST.format("url")} AS host, count(*) AS pages,
    count(DISTINCT CASE WHEN isnan(pagerank) THEN 0 ELSE coalesce(pagerank, 0) END) AS pagerank_values FROM cur GROUP BY 1""",
)
def per_domain(spark, where):
    out = skew.per_key(host_pairs(spark, where), "host", "pagerank")
    return out.select("host", F.col("n_rows").alias("pages"), F.col("n_values").alias("pagerank_values"))


@query(
    "p3_percentiles",
    f"""WITH {POSTS}, r AS (SELECT term, tf, row_number() OVER (PARTITION BY term ORDER BY tf) AS k,
    count(*) OVER (PARTITION BY term) AS n FROM posts), s AS (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE]) AS share)
    SELECT term, share, min(tf)::INT AS tf FROM r, s WHERE k >= greatest(1, ceil(share * n - 1e-9)) GROUP BY 1, 2""",
)
def tf_percentiles(spark, where):
    return skew.percentiles(term_pairs(spark, where), "term", "tf", [0.5, 0.95]).withColumnRenamed("value", "tf")
