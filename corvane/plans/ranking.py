"""Queries of the search path: postings, pages and stored bodies."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from corvane.functions.html import extract_pages
from corvane.functions.text import tokenize
from corvane.operators import search
from corvane.plans.registry import BODIES, HOST, NUM_PAGES, POSTS, query
from corvane.session import settle
from corvane.sources.tables import bodies_of_pages, current_pages, table

ONE, MANY = "guide archive", "How do the index pages guide the notes and notes?"
PR = "CASE WHEN isnan(pagerank) THEN 0 ELSE coalesce(pagerank, 0) END"


def _terms_sql(q: str) -> str:
    rows = ", ".join(f"('{t}', {n})" for t, n in sorted(Counter(tokenize(q)).items()))
    return f"q(term, q_count) AS (VALUES {rows})"


def _ranked_sql(q: str, limit: int = 10) -> str:
    return f"""{POSTS}, {NUM_PAGES}, {_terms_sql(q)}, n AS (SELECT count(last_indexed_hash)::DOUBLE AS n FROM cur),
    raw AS (SELECT page_id, sum((1 + ln(tf)) * (ln((1 + n) / (1 + coalesce(doc_freq, 0))) + 1) * q_count) AS raw
        FROM posts JOIN q USING (term) LEFT JOIN terms USING (term), n GROUP BY 1),
    sc AS (SELECT page_id, CASE WHEN tfidf_norm > 0 THEN raw / tfidf_norm ELSE raw END AS cosine, {PR} AS pr FROM raw LEFT JOIN cur ON id = page_id),
    top AS (SELECT page_id, cosine * (1 + 2.0 * pr) AS score, pr FROM sc WHERE cosine > 0 ORDER BY score DESC, page_id LIMIT {limit})"""


def text_sql(html: str) -> str:
    """Title and text of the tables' bodies by regular expressions, for comparison."""
    body = f"regexp_replace({html}, '(?s)^.*?<body[^>]*>', '')"
    for tag in ("script", "style", "noscript", "svg", "template", "nav", "header", "footer", "aside"):
        body = f"regexp_replace({body}, '(?s)<{tag}[ >].*?</{tag}>', ' ', 'g')"
    for ident in ("mw-navigation", "catlinks"):
        body = f"regexp_replace({body}, '(?s)<div id=\"{ident}\">.*?</div>', ' ')"
    body = f"regexp_replace({body}, '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')"
    return collapse_sql(entities_sql(body))


def entities_sql(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&mdash;", "—"), ("&nbsp;", " "), ("&copy;", "©"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def collapse_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\v\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+', ' ', 'g'))"


TITLE = collapse_sql(entities_sql("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))
H1 = collapse_sql(entities_sql("regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"))


def _inputs(spark, where, q):
    """The query's postings and statistics, the pages' scores, and the number of pages ever indexed."""
    words = sorted(set(tokenize(q)))
    scored = settle(current_pages(table(spark, where, "pages"), "tfidf_norm", "pagerank", "last_indexed_hash"))
    n = scored.agg(F.count("last_indexed_hash").alias("n"))
    return search.postings_of_terms(table(spark, where, "postings"), words), table(spark, where, "terms").where(F.col("term").isin(words)), scored, n


def _hits(spark, where, q):
    postings, terms, scored, n = _inputs(spark, where, q)
    return search.search(spark, q, postings, terms, scored, table(spark, where, "pages"), table(spark, where, "html_objects"), n)


TOP = f"""WITH {_ranked_sql(MANY)}, {BODIES},
    r AS (SELECT page_id, url, title, domain, score, pr, {text_sql("html")} AS text FROM top JOIN cur ON id = page_id LEFT JOIN bodies USING (minio_key)),
    s AS (SELECT *, length(text) AS len, list_min(list_filter([{", ".join(f"strpos(lower(text), '{t}')" for t in sorted(set(tokenize(MANY))))}], lambda x: x > 0)) - 1 AS p FROM r),
    hits AS (SELECT page_id, url, title, domain, round(score, 4) AS score, round(pr, 4) AS pagerank,
    coalesce(trim(regexp_replace(CASE WHEN p IS NULL THEN substr(text, 1, 320) ELSE CASE WHEN p > 80 THEN '… ' ELSE '' END ||
    substr(text, greatest(0, p - 80) + 1, least(len, p + 160) - greatest(0, p - 80)) || CASE WHEN least(len, p + 160) < len THEN ' …' ELSE '' END END,
    '\\s+', ' ', 'g')), '') AS snippet FROM s)"""


@query("search_topk", f"{TOP} SELECT * FROM hits")
def search_topk(spark, where):
    return _hits(spark, where, MANY)


@query("search_single_term", f"WITH {_ranked_sql(ONE, 50)} SELECT page_id, round(score, 6) AS score FROM top")
def search_single_term(spark, where):
    postings, terms, pages, n = _inputs(spark, where, ONE)
    top = search.rank(search.query_terms(spark, ONE), postings, terms, pages, n, 50, 2.0)
    return top.select("page_id", F.round("score", 6).alias("score"))


@query(
    "search_total_matches",
    f"WITH {POSTS}, {_terms_sql(MANY)} SELECT count(DISTINCT page_id) AS total_matches FROM posts JOIN q USING (term)",
)
def search_total_matches(spark, where):
    return _matches(spark, where, MANY)


def _matches(spark, where, q):
    return search.total_matches(search.query_terms(spark, q), search.postings_of_terms(table(spark, where, "postings"), sorted(set(tokenize(q)))))


@query(
    "search_response",
    f"""{TOP}, m AS (SELECT count(DISTINCT page_id) AS n FROM posts JOIN q USING (term)),
    o AS (SELECT string_agg('{{"url":' || to_json(url) || ',"title":' || coalesce(to_json(title)::VARCHAR, 'null') || ',"snippet":' || to_json(snippet) ||
        ',"score":' || score::DECIMAL(18, 4) || ',"domain":' || coalesce(to_json(domain)::VARCHAR, 'null') || ',"pagerank":' || pagerank::DECIMAL(18, 4) || '}}', ',' ORDER BY score DESC, page_id) AS l FROM hits)
    SELECT '{{"query":' || to_json('{MANY}') || ',"total_matches":' || n || ',"results":[' || coalesce(l, '') || ']}}' AS response FROM o, m""",
)
def search_response(spark, where):
    """The JSON body of the response."""
    return search.as_response(MANY, _hits(spark, where, MANY), _matches(spark, where, MANY))


@query(
    "search_shown",
    f"""WITH {NUM_PAGES} SELECT id, CASE WHEN title <> '' THEN title ELSE url END AS shown_title,
    CASE WHEN domain <> '' THEN domain ELSE coalesce(nullif({HOST.format("url")}, ''), url) END AS shown_domain FROM cur""",
)
def search_shown(spark, where):
    """What a result shows for each page: fallbacks for missing titles and domains."""
    return search.shown(current_pages(table(spark, where, "pages"), "url", "title", "domain")).select("id", "shown_title", "shown_domain")


@query(
    "stats",
    f"""WITH {NUM_PAGES} SELECT count(last_indexed_hash) AS total_docs, (SELECT count(*) FROM terms WHERE doc_freq > 0) AS total_terms,
    strftime(max(last_crawled_at) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%fZ') AS last_crawl_at FROM cur""",
)
def stats(spark, where):
    from corvane.operators.index import index_stats

    pages = current_pages(table(spark, where, "pages"), "last_indexed_hash", "last_crawled_at")
    return search.stats(index_stats(pages, table(spark, where, "terms")), pages)


@query(
    "extract_text_title",
    f"""WITH {NUM_PAGES}, {BODIES} SELECT id, nullif(substr(CASE WHEN {TITLE} <> '' THEN {TITLE} ELSE {H1} END, 1, 500), '') AS title, {text_sql("html")} AS text
    FROM cur JOIN bodies USING (minio_key)""",
)
def extract_text_title(spark, where):
    pages = bodies_of_pages(table(spark, where, "pages"), table(spark, where, "html_objects"), "url")
    return extract_pages(pages).select("id", "title", "text")


_HREF = """'(?s)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>'"""


@query(
    "extract_links",
    rf"""WITH {NUM_PAGES}, {BODIES}, p AS (SELECT id, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS site, html FROM cur JOIN bodies USING (minio_key)),
    a AS (SELECT id, site, unnest(regexp_extract_all(html, {_HREF}, 1)) AS href, unnest(regexp_extract_all(html, {_HREF}, 2)) AS inner_html,
        unnest(range(len(regexp_extract_all(html, {_HREF}, 1)))) AS pos FROM p),
    u AS (SELECT id, pos, regexp_replace(CASE WHEN href LIKE '/%' THEN site || {entities_sql("href")} ELSE {entities_sql("href")} END, '#.*$', '') AS dst_url,
        substr({collapse_sql(entities_sql("regexp_replace(inner_html, '<[^>]*>', '', 'g')"))}, 1, 200) AS anchor_text FROM a WHERE href NOT LIKE '#%' AND (href LIKE '/%' OR href LIKE 'http%'))
    SELECT id AS src_page_id, dst_url, anchor_text FROM (SELECT *, row_number() OVER (PARTITION BY id, dst_url ORDER BY pos) AS k FROM u) WHERE k = 1""",
)
def extract_links(spark, where):
    pages = bodies_of_pages(table(spark, where, "pages"), table(spark, where, "html_objects"), "url")
    links = extract_pages(pages).select(F.col("id").alias("src_page_id"), F.explode("links").alias("l"))
    return links.select("src_page_id", F.col("l.url").alias("dst_url"), F.col("l.anchor_text").alias("anchor_text"))
