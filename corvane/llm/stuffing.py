"""Problem 6: pages of repeated keywords, tags, labels or bare links in place of sentences.

Counts of words and of neighbouring words over all main bodies give the pointwise mutual information of neighbours.
For each page its own share is taken off the counts, so that a page can't vouch for itself. Two tests follow:

* Coherence: the mean normalised PMI of a block's neighbours, pairs that no other page has counting -1. Words thrown
  together at random stay far below running text, whether they come in lines or in mock sentences.
* Repetition: pairs that the page has several times more often than the corpus lets expect (the PMI of pair and page).
  A block not written in sentences is stuffed if such collocations hold much of it; where the page's words are so
  concentrated that no text could be, its sentences don't save a block.

Links without description, tags and lists of short labels with repeated words count as stuffed by their form. A page
is a case if stuffed blocks hold most of the words of its main body, hidden ones included.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.blocks import word_hashes
from corvane.session import settle

#: Least share of all words or pairs that an entry of the broadcast counts has: so many keys at most can reach it.
WORD_SUPPORT, PAIR_SUPPORT = 1e-6, 2e-7  # a million words and five million pairs, 72 MB, whatever the corpus
LEAST_COUNT = 2
REPEATED = 3  # a word or pair that often on a page is repeated
EXCESS = 4.0  # times more often than the corpus lets expect
REPEATED_SHARE = 0.35  # of a block's pairs
COVERED_SHARE = 0.5  # of a block's words, on pages with concentrated words
CONCENTRATION, SHORT_TEXT = 0.06, 2.0  # chance that two words of a page are the same: limit, and 2 / words more for short pages
SALAD, SALAD_PAIRS = -0.5, 8  # mean normalised PMI, and the pairs of known words that it takes
SENTENCE = (4.5, 45.0)  # words per sentence of a block in sentences
BARE = 0.8  # of a block's characters within links
LEAST_WORDS = 6
LISTED_ITEMS, ITEM_WORDS, LISTED_SHARE = 6, 4.5, 0.3  # a block of so many short items, so many of its words repeated
FLUSH = 2_000_000  # distinct entries that a task of the count holds

_STOP = re.compile(r"[.!?؟](?=\s|$|[^\s\d\w])|[。！？]")
_PARTED = re.compile(r"[,;|/•·、，]|\s[-–—]\s|\.\s")
_HASHTAG = re.compile(r"#\w")
_DENSE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿฀-໿]")
_NUMBERS = word_hashes(["\n".join("0" * n for n in range(1, 25))])[0]


@dataclass(slots=True)
class Part:
    """A block of a main body as far as this problem needs it."""

    text: str
    linked: int = 0  # characters within links
    tag: str = ""  # the innermost


def pair_hashes(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        x ^= x >> np.uint64(31)
        return x * np.uint64(0xBF58476D1CE4E5B9)


def count_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and their counts, pairs of neighbours within a text and their counts. Null texts hold none."""
    h, at = word_hashes([t for t in texts if t])
    pairs = pair_hashes(h)[at[1:] == at[:-1]] if len(h) > 1 else h[:0]
    return *np.unique(h, return_counts=True), *np.unique(pairs, return_counts=True)


class Table:
    """Counts by hash; what isn't listed counts 0. total is the sum over everything, listed or not."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, total: int):
        order = np.argsort(keys)
        self.keys, self.counts, self.total = keys[order], counts[order], total

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.counts[at], 0).astype(np.int64)


class Counts:
    """Corpus counts of words and of pairs of neighbours."""

    def __init__(self, words: Table, pairs: Table):
        self.words, self.pairs = words, pairs

    @classmethod
    def of(cls, texts: list[str]) -> Counts:
        """Counts of some texts, each kept."""
        w, wn, p, pn = count_texts(texts)
        return cls(Table(w, wn, int(wn.sum())), Table(p, pn, int(pn.sum())))


def corpus_counts(blocks: DataFrame, texts: str) -> Counts:
    """Counts over all rows of a column with the texts of blocks.

    Tasks send the sums of what they read, which are grouped by hash: exact counts of every word and pair, in a
    settled table. The driver gets those that hold at least WORD_SUPPORT of all words or PAIR_SUPPORT of all pairs.
    """

    def count(batches):
        held, size = [], 0
        rows = lambda k, h, n: pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int8)), pa.array(h.view(np.int64)), pa.array(n)], names=["kind", "h", "n"])

        def flush():
            for kind, at in (("words", 0), ("pairs", 2)):
                h, inverse = np.unique(np.concatenate([x[at] for x in held]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([x[at + 1] for x in held]), minlength=len(h)).astype(np.int64)
                yield rows(int(kind == "pairs"), h, n)

        for batch in batches:
            column = batch.column(0)
            for lo in range(0, len(column), 500):
                held.append(count_texts(column.slice(lo, 500).flatten().to_pylist()))
                size += len(held[-1][0]) + len(held[-1][2])
                if size > FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    counted = settle(blocks.select(texts).mapInArrow(count, "kind tinyint, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n")))
    total = {r.kind: r.n for r in counted.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    least = F.greatest(F.lit(LEAST_COUNT), F.when(F.col("kind") == 0, WORD_SUPPORT * total.get(0, 0)).otherwise(PAIR_SUPPORT * total.get(1, 0)))
    listed = counted.where(F.col("n") >= least).toArrow()
    kind, h, n = (listed.column(c).to_numpy() for c in ("kind", "h", "n"))
    return Counts(*(Table(h[kind == k].view(np.uint64), n[kind == k], total.get(k, 0)) for k in (0, 1)))


def times_within(page: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How often each hash occurs within its page."""
    order = np.lexsort((h, page))
    k, p = h[order], page[order]
    group = np.cumsum(np.concatenate([[True], (k[1:] != k[:-1]) | (p[1:] != p[:-1])])) - 1 if len(k) else np.zeros(0, np.int64)
    out = np.empty(len(k), np.int64)
    out[order] = np.bincount(group)[group] if len(k) else 0
    return out


def spoken_words(text: str, words: int) -> float:
    """Words of a block, two characters of a script without spaces counting as one."""
    return words if text.isascii() else words - len(_DENSE.findall(text)) / 2


def in_sentences(text: str, words: float) -> bool:
    ends = len(_STOP.findall(text))
    return ends > 0 and SENTENCE[0] <= words / ends <= SENTENCE[1]


def coherence(h: np.ndarray, at: np.ndarray, page: np.ndarray, blocks: int, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Of each block the mean normalised PMI of neighbours (0 without any), and how many pairs it rests on.

    Counts are those of the other pages. Pairs with a word that no other page has say nothing; pairs of known words
    that no other page has count -1.
    """
    if len(h) < 2:
        return np.zeros(blocks), np.zeros(blocks)
    inner = at[1:] == at[:-1]
    word = np.maximum(counts.words(h) - times_within(page[at], h), 0)
    a, b, where = word[:-1][inner], word[1:][inner], at[1:][inner]
    pairs = pair_hashes(h)[inner]
    pair = np.maximum(counts.pairs(pairs) - times_within(page[where], pairs), 0)
    known = (a > 0) & (b > 0)
    n, m = max(1, counts.words.total), max(1, counts.pairs.total)
    p = np.maximum(pair, 1) / m
    pmi = np.log(p * n * n / (np.maximum(a, 1) * np.maximum(b, 1).astype(float)))
    value = np.where(pair > 0, pmi / -np.log(np.minimum(p, 0.5)), -1.0)
    each = np.bincount(where, known, minlength=blocks)
    return np.bincount(where, np.where(known, value, 0), minlength=blocks) / np.maximum(each, 1), each


def stuffed_shares(pages: list[list[Part]], counts: Counts) -> np.ndarray:
    """Of each page, given by the parts of its main body, the share of its words that are stuffed.

    Pages with fewer than six words have share 0. A character of a script without spaces counts as a word.
    """
    flat = [b for bs in pages for b in bs]
    out = np.zeros(len(pages))
    if not flat:
        return out
    h, at = word_hashes([b.text for b in flat])
    n = np.bincount(at, minlength=len(flat))
    page = np.repeat(np.arange(len(pages)), [len(bs) for bs in pages])
    total = np.bincount(page, n, minlength=len(pages))
    mean, pairs_known = coherence(h, at, page, len(flat), counts)
    incoherent = (mean < SALAD) & (pairs_known >= SALAD_PAIRS)
    # repetition: how often words and pairs stand on their page, against what the other pages let expect
    number = np.isin(h, _NUMBERS)
    often = times_within(page[at], h)
    rate = np.maximum(counts.words(h) - often, 0) / max(1, counts.words.total)
    excess = (often >= REPEATED) & (often >= EXCESS * rate * total[page[at]]) & ~number
    same = np.bincount(page[at], (often - 1) * ~number, minlength=len(pages)) / np.maximum(total * (total - 1), 1)
    dull = same >= CONCENTRATION + SHORT_TEXT / np.maximum(total, 1)
    covered = np.bincount(at, excess, minlength=len(flat)) / np.maximum(n, 1)
    again = np.bincount(at, often >= REPEATED, minlength=len(flat)) / np.maximum(n, 1)
    repeats = np.zeros(len(flat))
    if len(h) > 1:
        inner = at[1:] == at[:-1]
        pairs, where = pair_hashes(h)[inner], at[1:][inner]
        times = times_within(page[where], pairs)
        held = np.bincount(page[where], minlength=len(pages))[page[where]]
        rate = np.maximum(counts.pairs(pairs) - times, 0) / max(1, counts.pairs.total)
        each = np.maximum(np.bincount(where, minlength=len(flat)), 1)
        repeats = np.bincount(where, (times >= REPEATED) & (times >= EXCESS * rate * held), minlength=len(flat)) / each
    stuffed = np.zeros(len(flat))
    linked = np.array([b.linked >= BARE * len(b.text) for b in flat])
    tagged = np.array(["#" in b.text for b in flat])
    hollow = incoherent | (dull[page] & (covered >= COVERED_SHARE))
    stuffed[hollow] = n[hollow]
    for i in np.flatnonzero((n > 0) & ~hollow & (linked | tagged | (repeats >= REPEATED_SHARE) | (again >= LISTED_SHARE))).tolist():
        b, words = flat[i], spoken_words(flat[i].text, n[i])
        if linked[i] or (tagged[i] and 2 * len(_HASHTAG.findall(b.text)) >= len(b.text.split())):
            stuffed[i] = n[i]
        elif again[i] >= LISTED_SHARE and words <= ITEM_WORDS * (items := len(_PARTED.findall(b.text)) + 1) and items >= LISTED_ITEMS:
            stuffed[i] = n[i]
        elif repeats[i] >= REPEATED_SHARE and not in_sentences(b.text, words) and not b.tag.startswith(("li", "td", "th", "dd", "dt")) and n[i] >= LEAST_WORDS:
            stuffed[i] = n[i]
    share = np.bincount(page, stuffed, minlength=len(pages)) / np.maximum(total, 1)
    # short labels and items count as stuffed only where hardly a sentence stands beside them
    first = np.searchsorted(page, np.arange(len(pages) + 1))
    candidate = np.bincount(page, (n > 0) & (stuffed == 0) & (repeats >= 0.5), minlength=len(pages)) > 0
    for k in np.flatnonzero((share < 0.5) & (total >= LEAST_WORDS) & candidate):
        own = np.arange(first[k], first[k + 1])
        items = [i for i in own if n[i] and not stuffed[i] and repeats[i] >= 0.5 and not in_sentences(flat[i].text, spoken_words(flat[i].text, n[i]))]
        if items and stuffed[own].sum() + n[items].sum() > 0.8 * total[k]:
            share[k] = (stuffed[own].sum() + n[items].sum()) / total[k]
    return np.where(total >= LEAST_WORDS, share, 0)
