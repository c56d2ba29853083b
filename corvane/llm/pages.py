"""Problems 1, 4 and 6 on crawled pages: main bodies, residue, stuffing. Each page's current body is parsed once.

Bodies are shuffled once, to find the latest of each key, and joined with the pages' current states; parsing, labelling
and residue are a map over them. Stuffing needs the counts of all main bodies, so the map's result, the blocks of each
main body, is written as a table, which is counted and then judged. Pages without a body, with an empty one or without
blocks give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm import residue
from corvane.llm.blocks import parse, vectors
from corvane.llm.labeller import trained
from corvane.llm.registry import query
from corvane.llm.stuffing import Counts, Part, corpus_counts, stuffed_shares
from corvane.session import stored
from corvane.sources.tables import bodies_of_pages, table

PAGES_AT_ONCE = 400
MAIN = 0.5  # probability from which a block is main body
STUFFED = 0.5


def main_blocks(pages: list) -> list[list[bool]]:
    """For each parsed page which of its blocks the labeller takes for main body."""
    lengths = np.array([len(bs) for _, bs in pages])
    if not lengths.sum():
        return [[] for _ in pages]
    p = trained().predict(vectors(pages), lengths[lengths > 0]) >= MAIN
    ends = np.cumsum(lengths)
    return [p[e - n : e].tolist() for e, n in zip(ends, lengths)]


def residue_flags(pages: list, main: list[list[bool]]) -> list[bool]:
    return [residue.touched(t, bs) and residue.is_residue(t, bs, m) for (t, bs), m in zip(pages, main)]


def parts_of(blocks: list, main: list[bool]) -> list[Part]:
    """The blocks of a page that count for stuffing: main body, and whatever is hidden."""
    return [Part(b.text, b.linked, b.path[-1] if b.path else "") for b, m in zip(blocks, main) if m or b.hidden]


def stuffed_flags(parts: list[list[Part]], counts: Counts) -> list[bool]:
    return (stuffed_shares(parts, counts) > STUFFED).tolist()


def _over(bodies: DataFrame, work, schema: str) -> DataFrame:
    """Maps (id, html) with work(ids, parsed pages) -> arrays."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches):
        for batch in batches:
            ids, htmls = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), PAGES_AT_ONCE):
                pages = [parse(x) for x in htmls.slice(lo, PAGES_AT_ONCE).to_pylist()]
                yield pa.RecordBatch.from_arrays(work(ids[lo : lo + PAGES_AT_ONCE], pages), names=names)

    return bodies.select("id", "html").mapInArrow(run, schema)


MAIN_BODIES = "page_id bigint, residue boolean, lines array<int>, texts array<string>, linked array<int>, tags array<string>"


def main_bodies(bodies: DataFrame) -> DataFrame:
    """A row per body, in a stored table: whether it is residue, the lines that show main body, and the blocks for stuffing."""

    def work(ids, pages):
        main = main_blocks(pages)
        parts = [parts_of(bs, m) for (_, bs), m in zip(pages, main)]
        return [
            pa.array(ids, pa.int64()), pa.array(residue_flags(pages, main), pa.bool_()),
            pa.array([sorted({b.line for b, v in zip(bs, m) if v and not b.hidden}) for (_, bs), m in zip(pages, main)], pa.list_(pa.int32())),
            pa.array([[x.text for x in p] for p in parts], pa.list_(pa.string())),
            pa.array([[x.linked for x in p] for p in parts], pa.list_(pa.int32())), pa.array([[x.tag for x in p] for p in parts], pa.list_(pa.string())),
        ]

    return stored(_over(bodies, work, MAIN_BODIES))


def _judged(mains: DataFrame, counts: Counts, columns: list[str], work, schema: str) -> DataFrame:
    """Maps the table of main bodies with work(rows of the columns, whether each is stuffed) -> arrays."""
    shared = mains.sparkSession.sparkContext.broadcast(counts)
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(lo, PAGES_AT_ONCE)
                texts, linked, tags = (part.column(c).to_pylist() for c in ("texts", "linked", "tags"))
                flags = stuffed_flags([[Part(*x) for x in zip(*p)] for p in zip(texts, linked, tags)], shared.value)
                yield pa.RecordBatch.from_arrays(work([part.column(c) for c in columns], flags), names=names)

    return mains.select("texts", "linked", "tags", *columns).mapInArrow(run, schema)


def main_lines(mains: DataFrame, counts: Counts) -> DataFrame:
    """(page_id, line_no) of the lines that show text of the main body; none for pages of residue or stuffing."""

    def work(columns, stuffed):
        ids, residual, lines = (c.to_pylist() for c in columns)
        keep = [(i, x) for i, r, x, s in zip(ids, residual, lines, stuffed) if not (r or s)]
        return [pa.array([i for i, x in keep for _ in x], pa.int64()), pa.array([n for _, x in keep for n in x], pa.int32())]

    return _judged(mains, counts, ["page_id", "residue", "lines"], work, "page_id bigint, line_no int")


def main_texts(bodies: DataFrame) -> DataFrame:
    """(page_id, title, text): the main body's blocks as lines, of every page; what is left may be empty."""

    def work(ids, pages):
        main = main_blocks(pages)
        texts = ["\n".join(b.text for b, v in zip(bs, m) if v and not b.hidden) for (_, bs), m in zip(pages, main)]
        return [pa.array(ids, pa.int64()), pa.array([t for t, _ in pages], pa.string()), pa.array(texts, pa.string())]

    return _over(bodies, work, "page_id bigint, title string, text string")


def residue_pages(bodies: DataFrame) -> DataFrame:
    """(page_id) of pages with residue. Only pages in which the automaton finds something are labelled."""

    def work(ids, pages):
        at = [k for k, (t, bs) in enumerate(pages) if residue.touched(t, bs)]
        some = [pages[k] for k in at]
        hit = [residue.is_residue(t, bs, m) for (t, bs), m in zip(some, main_blocks(some))]
        return [pa.array([ids[k] for k, h in zip(at, hit) if h], pa.int64())]

    return _over(bodies, work, "page_id bigint")


def stuffed_pages(mains: DataFrame, counts: Counts) -> DataFrame:
    """(page_id) of stuffed pages; residue, whose labels repeat as well, is left to p4."""

    def work(columns, stuffed):
        ids, residual = (c.to_pylist() for c in columns)
        return [pa.array([i for i, r, s in zip(ids, residual, stuffed) if s and not r], pa.int64())]

    return _judged(mains, counts, ["page_id", "residue"], work, "page_id bigint")


def bodies(spark, where) -> DataFrame:
    return bodies_of_pages(table(spark, where, "pages"), table(spark, where, "html_objects"))


@query("p1_found")
def p1_found(spark, where):
    mains = main_bodies(bodies(spark, where))
    return main_lines(mains, corpus_counts(mains, "texts"))


@query("p1_texts")
def p1_texts(spark, where):
    return main_texts(bodies(spark, where))


@query("p4_found")
def p4_found(spark, where):
    return residue_pages(bodies(spark, where))


@query("p6_found")
def p6_found(spark, where):
    mains = main_bodies(bodies(spark, where))
    return stuffed_pages(mains, corpus_counts(mains, "texts"))
