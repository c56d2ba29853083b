import dataclasses

import pytest
from pyspark.sql import functions as F

from corvane import config
from corvane.functions import bloom, html, text, urls

TOKENS = [
    ("Hello World", ["hello", "world"]),
    ("the cat and the dog", ["cat", "dog"]),
    ("crawler crawlers", ["crawler", "crawler"]),
    ("indexing indexed index", ["index", "index", "index"]),
    ("page 42 found", ["page", "42", "found"]),
    ("café", ["café"]),
    ("", []),
    ("   ", []),
    (None, []),
    ("sees", ["sees"]),
    ("abc123 x_y don't", ["abc", "123", "don"]),
    ("class classes cities queries series", ["clas", "class", "citi", "query", "seri"]),
    ("ＧＵＩＤＥ ﬁnding", ["guide", "find"]),
]


def test_tokens(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TOKENS)], "id int, t string")
    got = {r.id: r.x for r in text.folded_text(df, "t").select("id", text.tokens_of(F.col("_folded")).alias("x")).collect()}
    for i, (t, want) in enumerate(TOKENS):
        assert got[i] == want, t
        assert text.tokenize(t) == want


def test_term_counts_skip_empty(spark):
    df = spark.createDataFrame([(1, "a b bb bb"), (2, None), (3, "")], "id int, t string")
    assert [(r.id, r.term, r.tf) for r in text.term_counts(df, "id", "t").collect()] == [(1, "bb", 2)]


def test_weights(spark):
    row = spark.range(1).select(
        *[text.tf_weight(F.lit(t)).alias(f"t{i}") for i, t in enumerate((-1, 0, 1, 10))],
        *[text.idf(F.lit(d), F.lit(n)).alias(f"i{i}") for i, (d, n) in enumerate(((1, 1000), (10, 1000), (0, 0), (500, 500)))],
    ).first()
    assert (row.t0, row.t1, row.t2) == (0, 0, 1) and 3.30 < row.t3 < 3.31
    assert row.i0 > row.i1 > 1 and row.i2 == 0 and row.i3 == 1


@pytest.mark.parametrize(
    "raw,want",
    [
        ("HTTP://U:p@Ex.com:80/a?b#c", "http://ex.com/a?b"), ("https://h", "https://h/"), ("https://h:8443/", "https://h:8443/"), ("ftp://h", None),
        ("#x", None), ("", None), (None, None), ("mailto:a@b", None), (" \thttps://H/p;v=1?q=2 \n", "https://h/p;v=1?q=2"), ("https://h:443/x", "https://h/x"),
        ("http://h:99999/", None), ("https://h:abc/", None), ("http:///x", None), ("https://h/?", "https://h/"), ("http://[::1]:81/", "http://[::1]:81/"), ("http://h?x", "http://h/?x"),
    ],
)
def test_normalize(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "u string").select(urls.normalize("u").alias("n")).first().n == want
    assert urls.normalize_text(raw) == want


def test_resolve():
    assert urls.normalize_text("../b", "http://H/a/c/d") == "http://h/a/b"
    assert urls.normalize_text("//o.org", "https://h/") == "https://o.org/"
    assert urls.normalize_text("javascript:void(0)", "https://h/") is None


def test_addresses(spark):
    bad = ["10.0.0.1", "127.0.0.1", "169.254.1.1", "192.168.0.1", "::1", "0.0.0.0", "224.0.0.1", "fe80::1", "x", "", None]
    df = spark.createDataFrame([(a,) for a in bad + ["8.8.8.8", "1.1.1.1", "2606:4700::1111"]], "ip string")
    assert [r.b for r in df.select(urls.disallowed_address("ip").alias("b")).collect()] == [True] * len(bad) + [False] * 3


def test_snippet(spark):
    long = "x" * 100 + " needle " + "y" * 300
    df = spark.createDataFrame([("",), (None,), ("short text",), (long,), ("needle first",)], "t string")
    got = [r.s for r in df.select(text.snippet(F.col("t"), ["needle", "zzz"]).alias("s")).collect()]
    assert got[:3] == ["", "", "short text"]
    assert got[3].startswith("… ") and got[3].endswith(" …") and "needle" in got[3]
    assert got[4] == "needle first"
    assert spark.createDataFrame([("z" * 900,)], "t string").select(F.length(text.snippet(F.col("t"), ["q"])).alias("n")).first().n == 320


HTML = """<html><head><title> A  title </title><style>p{}</style></head><body><nav><a href="/n">nav</a></nav>
<div class="navbox x">gone</div><div id="toc"><div>gone</div></div><p>foo<b>bar</b> <a href="/x">one<i>two</i></a><a href="/x#y">again</a>
<a href="mailto:a@b">m</a><a href="#top">t</a></p><script>var a = "</p>";</script><br><p>tail &amp; end<footer>f</footer></body></html>"""


def test_extract():
    title, body, links = html.extract(HTML, "https://Ex.org/d/")
    assert title == "A title" and body == "foo bar one two again m t tail & end"
    assert links == [("https://ex.org/n", "nav"), ("https://ex.org/x", "onetwo")]
    assert html.extract(None, None) == (None, "", []) and html.extract("", "https://h/")[1] == ""
    assert html.extract("<h1>Head</h1><p>unclosed <b>x", "https://h/")[:2] == ("Head", "Head unclosed x")
    assert html.extract("</div></p>odd <a href='http://h:abc/'>l</a>", "https://h/") == (None, "odd l", [])
    assert len(html.extract("<title>" + "t" * 900 + "</title>", None)[0]) == 500


def test_extract_pages(spark):
    df = spark.createDataFrame([(1, HTML, "https://ex.org/"), (2, None, None)], "id bigint, html string, url string").withColumn("title", F.lit(1))
    rows = {r.id: r for r in html.extract_pages(df).collect()}
    assert rows[1].title == "A title" and len(rows[1].links) == 2 and rows[2].text == "" and rows[2].links == []


def test_options():
    got = config.from_env(config.CrawlOptions, {"MAX_DEPTH": "5", "ALLOW_OFFSITE_LINKS": "Yes", "DEFAULT_CRAWL_DELAY_SECONDS": "1.5", "RECRAWL_INTERVAL_HOURS": "0.5", "CRAWL_DELAY_SEC": "9"})
    assert (got.max_depth, got.allow_offsite_links, got.crawl_delay_sec, got.max_pages, got.recrawl_hours) == (5, True, 1.5, 200, 0.5)
    assert config.from_env(config.SearchOptions, {"PAGERANK_BOOST_ALPHA": "0.5"}).alpha == 0.5 and config.from_env(config.IndexOptions, {}).batch_size == 25
    assert set(config.VARIABLES) <= {f.name for k in (config.CrawlOptions, config.IndexOptions, config.SearchOptions) for f in dataclasses.fields(k)}
    assert config.parse_bool("off") is False and config.parse_bool(None, True) is True


def test_bloom(spark):
    import hashlib

    keys = spark.createDataFrame([(f"http://h/{i}",) for i in range(500)] + [(None,), ("",), ("http://h/1",)], "url string")
    row = keys.where("url = 'http://h/7'").select(bloom.places(F.col("url"), 1 << 16, 7).alias("p")).first().p
    assert row == [int.from_bytes(hashlib.blake2b(b"http://h/7", digest_size=8, salt=str(k).encode() + b"\0" * 15).digest(), "big") % (1 << 16) for k in range(7)]
    bits = bloom.set_bits(keys, "url", 1 << 16, 7)
    assert bloom.might_contain(keys, "url", bits, 1 << 16, 7).where("not maybe").count() == 0
    others = spark.createDataFrame([(f"http://g/{i}",) for i in range(1000)], "url string")
    assert bloom.might_contain(others, "url", bits, 1 << 16, 7).where("maybe").count() < 10
    assert bloom.might_contain(others, "url", bits.limit(0)).where("maybe").count() == 0
    with pytest.raises(ValueError):
        bloom.places(F.col("url"), 0)


def test_folding_in_one_pass(spark):
    df = spark.createDataFrame([(1, " Page "), (2, "\uff30age"), (3, None), (4, ""), (5, "\ufb01n")], "id int, t string")
    plan = text.fold_term(df, "t")
    assert {r.id: r.t for r in plan.collect()} == {1: "page", 2: "page", 4: "", 5: "fin"}
    assert {r.id: r._folded for r in text.folded_text(df, "t").collect()} == {1: " page ", 2: "page", 3: "", 4: "", 5: "fin"}
    assert "Union" not in plan._jdf.queryExecution().toString()
