"""The catalogue of queries: each a function of a session and a folder, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


# Pieces of SQL that several checks share.
NUM_PAGES = """cur AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
    PARTITION BY id ORDER BY last_crawled_at DESC NULLS LAST, status DESC, tfidf_norm DESC) AS rn FROM pages) WHERE rn = 1)"""
BODIES = """bodies AS (SELECT minio_key, html FROM (SELECT *, row_number() OVER (
    PARTITION BY minio_key ORDER BY stored_at DESC NULLS LAST, html DESC) AS rn FROM html_objects) WHERE rn = 1)"""
# translate() folds the full-width forms that stand in the table; lower and trim do the rest.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW = "".join(map(chr, range(0x21, 0x7F)))
POSTS = f"""posts AS (SELECT lower(trim(translate(term, '{WIDE}', '{NARROW.replace("'", "''")}'), ' \t\n\r\u00a0\u3000')) AS term, page_id, max(tf) AS tf
    FROM postings WHERE tf >= 1 GROUP BY 1, 2)"""
HOST = r"lower(regexp_extract({0}, '^[a-zA-Z]+://(?:[^/?#]*@)?([^/?#:@]+)', 1))"
