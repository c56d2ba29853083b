"""Title, text and links of html pages for the index, in one pass over the markup, as an Arrow UDF.

Chrome (landmark tags, some ids and class names) is left out of the text but not of the links. Null bodies give a null
title, empty text and no links; markup that doesn't nest is tolerated: an end tag closes up to its start tag, one
without a start tag is ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.functions.urls import normalize_text

# Elements whose text isn't indexed.
CHROME_TAGS = frozenset("script style noscript svg template nav header footer aside".split())
CHROME_IDS = frozenset(
    "mw-navigation mw-panel mw-page-base mw-head-base p-navigation vector-header-container vector-page-toolbar"
    " vector-sticky-header mw-indicators siteNotice catlinks vector-toc toc footer mw-footer".split()
)
CHROME_CLASS_PARTS = "navbox vector-menu mw-editsection mw-jump-link noprint navigation-not-searchable".split()
TITLE_CHARS, ANCHOR_CHARS = 500, 200

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TOKEN = re.compile(r"<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<!--.*?-->|<[!?][^>]*>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style")}


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(text)} if text.strip() else {}


def extract(html: str | None, base: str | None) -> tuple[str | None, str, list[tuple[str, str]]]:
    """(title, text, [(url, anchor)]): urls resolved against base and normalised, the first of equal ones kept."""
    stack: list[tuple[str, bool]] = []
    text, title, h1 = [], [], []
    links: dict[str, str] = {}
    ids_left = set(CHROME_IDS)
    skipped = title_open = h1_open = h1_done = 0
    seen_body = "<body" in (html or "")
    in_body = not seen_body
    anchor: list[str] | None = None
    href = None
    raw = html or ""
    at = 0
    while m := _TOKEN.match(raw, at):
        at = m.end()
        tag = m[2] and m[2].lower()
        if tag is None:
            if m[0].startswith(("<!", "<?")):
                continue
            piece = entities.unescape(m[0])
            if title_open:
                title.append(piece)
                continue
            if anchor is not None:
                anchor.append(piece)
            if not skipped:
                if h1_open:
                    h1.append(piece)
                if in_body:
                    text.append(piece)
            continue
        if m[1]:
            if tag == "a" and anchor is not None:
                links.setdefault(href, " ".join("".join(anchor).split())[:ANCHOR_CHARS]) if href else None
                anchor = None
            if tag == "title":
                title_open = 0
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    skipped -= sum(s for _, s in stack[i:])
                    if any(t == "h1" for t, _ in stack[i:]) and h1_open:
                        h1_open, h1_done = 0, 1
                    del stack[i:]
                    break
            continue
        if tag == "a":
            if anchor is not None and href:
                links.setdefault(href, " ".join("".join(anchor).split())[:ANCHOR_CHARS])
            given = _attributes(m[3])
            href = normalize_text(given.get("href"), base) if "href" in given else None
            anchor = [] if "href" in given else None
        if tag == "body":
            in_body = True
        if tag == "title":
            title_open = 1
        if tag in _VOID or m[3].rstrip().endswith("/"):
            continue
        skip = tag in CHROME_TAGS
        if m[3] and ("id" in m[3] or "class" in m[3]):
            given = _attributes(m[3])
            if given.get("id") in ids_left:
                ids_left.discard(given["id"])
                skip = True
            skip |= any(part in c for c in given.get("class", "").split() for part in CHROME_CLASS_PARTS)
        stack.append((tag, skip))
        skipped += skip
        if tag == "h1" and not skipped and not h1_done:
            h1_open = 1
        if tag in _RAW_END:
            end = _RAW_END[tag].search(raw, at)
            at = end.start() if end else len(raw)
    if anchor is not None and href:
        links.setdefault(href, " ".join("".join(anchor).split())[:ANCHOR_CHARS])
    name = " ".join("".join(title).split())[:TITLE_CHARS] or " ".join("".join(h1).split())[:TITLE_CHARS]
    return name or None, " ".join(" ".join(text).split()), list(links.items())


EXTRACTED = "title string, text string, links array<struct<url: string, anchor_text: string>>"


def extract_pages(pages: DataFrame, key: str = "id", html: str = "html", url: str = "url") -> DataFrame:
    """(key, title, text, links) of each row: a map over Arrow batches."""
    link = pa.list_(pa.struct([("url", pa.string()), ("anchor_text", pa.string())]))

    def run(batches):
        for batch in batches:
            done = [extract(h, u) for h, u in zip(batch.column(html).to_pylist(), batch.column(url).to_pylist())]
            links = [[{"url": a, "anchor_text": b} for a, b in d[2]] for d in done]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string()), pa.array(links, link)],
                names=[key, "title", "text", "links"],
            )

    kind = dict(pages.dtypes)[key]
    return pages.select(key, html, url).mapInArrow(run, f"`{key}` {kind}, {EXTRACTED}")
