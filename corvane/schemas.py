"""Schemas of the tables and of the records that cross stages. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

#: Table name to DDL, as stored.
TABLES: dict[str, str] = {
    "pages": """id BIGINT, url STRING, url_hash STRING, domain STRING, status STRING, http_status INT, depth INT,
        title STRING, content_hash STRING, last_indexed_hash STRING, etag STRING, last_modified STRING,
        content_length INT, minio_key STRING, tfidf_norm DOUBLE, pagerank DOUBLE, discovered_at TIMESTAMP,
        first_crawled_at TIMESTAMP, last_crawled_at TIMESTAMP, next_crawl_at TIMESTAMP, error STRING,
        retry_count INT, next_retry_at TIMESTAMP""",
    "html_objects": "minio_key STRING, html STRING, stored_at TIMESTAMP",
    "links": "id BIGINT, src_page_id BIGINT, dst_url STRING, dst_page_id BIGINT, anchor_text STRING",
    "postings": "term STRING, page_id BIGINT, tf INT",
    "terms": "term STRING, doc_freq INT",
    "domains": "domain STRING, robots_txt STRING, robots_fetched_at TIMESTAMP, crawl_delay_sec DOUBLE, disallow_all BOOLEAN",
    "frontier": "entry_id STRING, url STRING, domain STRING, depth STRING, parent_id STRING, enqueued_at TIMESTAMP",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, url STRING, fetched_at TIMESTAMP",
    "eval_items": "item_id BIGINT, suite STRING, lang STRING, text STRING",
    "index_stats": "key STRING, value DOUBLE, updated_at TIMESTAMP",
}

PAGE_STATUSES = ("pending", "in_progress", "crawled", "failed", "skipped", "not_modified")

# Records between stages, as DDL.
FETCH_RESULT = (
    "status INT, url STRING, html STRING, etag STRING, last_modified STRING, content_length INT,"
    " not_modified BOOLEAN, error STRING"
)
EXTRACTED_PAGE = "title STRING, text STRING, links ARRAY<STRUCT<url: STRING, anchor_text: STRING>>"
FRONTIER_ITEM = "entry_id STRING, url STRING, domain STRING, depth INT, page_id BIGINT, parent_id BIGINT"
METRIC = "ts TIMESTAMP, metric STRING, labels MAP<STRING, STRING>, value DOUBLE"


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])
