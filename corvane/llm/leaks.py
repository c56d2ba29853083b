"""Problem 9: passages of evaluation items inside training documents.

The items form an inverted index whose terms are letter sequences of eight characters, taken from a form of the text
in which spelling no longer counts (case, punctuation, spacing, word breaks, mark-up, entities, accents). Every
passage of every document is a query: BM25 scores of all items above a threshold are retrieved with block-max upper
bounds, so that only blocks of items that can reach the threshold are scored. Nothing else decides what is retrieved.
Retrieved pairs are then verified: the common sequences must keep their distance, they are aligned, the item's words
are counted, and the passage must hold wording that no other item has.

In scripts without spaces two characters count as a word, and a character stands for three letters, so that sequences,
words and passages carry about as much as in other scripts.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.registry import query
from corvane.session import settle, spread, stored
from corvane.sources.tables import table

GRAM = 8
PASSAGE = 384  # characters of a passage, which overlaps its neighbours by half
BLOCK = 16  # items of a block
K1, B = 1.2, 0.75
SHARED_WORDS = 10  # a sequence of so many words that stands in several items is nobody's own
MIN_WORDS, ONE_IN = 15, 8
#: A document's passage must hold so many runs of so many words, unaltered, that no other item has: phrases that several items use are nobody's own.
OWN_RUN, OWN_RUNS = 3, 2
#: A passage of fifteen words or more with c altered ones, at most one in eight, has c + 1 exact runs: the longest has at least five words.
RUN_WORDS = 5
REACH = 60  # characters between two links of a chain
JOINED = 24  # letters of a document's word from which it may be several without spaces
JOINED_WORD = 4  # letters of a word that ends a run inside such a word
PART_LETTERS = 500_000  # letters of the items in one index, which is broadcast: about 45 MB; more items are searched part by part
DENSE_CELLS = 4_000_000  # scores of half passages and items that are kept in a plain table
SLICE_LETTERS = 500_000  # letters of documents that are searched at once
BUCKET_BITS = 22

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕԁһոցԛԝαορνικτυ", "aeopcyxijsdhngqwaopviktu"))
_DROP_ASCII = bytes(c for c in range(128) if not chr(c).isalnum())
_OTHERS = str.maketrans(LOOKALIKES)
_ALIKE = re.compile(f"[{''.join(LOOKALIKES)}]")
_MARKUP = re.compile(r"<[/!a-zA-Z][^<>]{0,300}>")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_PERCENT = re.compile(r"(?:%[0-9a-fA-F]{2})+")
_GARBLED = re.compile("[Â-ô][\u0080-¿Œ-Ÿ–-™ƒˆ˜]+")
_SIGNS = re.compile(r"[\W_]+")
_DENSE = "぀-ヿ㐀-䶿一-鿿豈-﫿\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
_CHARACTER = re.compile(f"([{_DENSE}])")
_PIECES = re.compile(f"[{_DENSE}]{{1,2}}|[^{_DENSE}]+")
_SINGLE = re.compile(f"[{_DENSE}]|[^{_DENSE}]+")
_HYPHEN = re.compile(r"(?<=\w)[-\u00ad\u2010]\s*\n\s*(?=\w)")


def _repaired(m: re.Match) -> str:
    try:
        return m[0].encode("cp1252").decode("utf-8")
    except UnicodeError:
        try:
            return m[0].encode("latin-1").decode("utf-8")
        except UnicodeError:
            return m[0]


def readable(text: str) -> str:
    """Undoes entities, escapes, mark-up and UTF-8 read as Latin."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    if "\\u" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
    if "%" in text:
        from urllib.parse import unquote

        text = _PERCENT.sub(lambda m: unquote(m[0]), text)
    return text if text.isascii() else _GARBLED.sub(_repaired, text)


def plain(text: str) -> str:
    """Letters and digits alone, without case and accents. A character of a script without spaces stands three times."""
    if text.isascii():
        return text.encode().lower().translate(None, _DROP_ASCII).decode()
    text = unicodedata.normalize("NFKD", text).casefold()
    text = _SIGNS.sub("", text.translate(_OTHERS) if _ALIKE.search(text) else text)
    return _CHARACTER.sub(r"\1\1\1", text) if _CHARACTER.search(text) else text


def item_words(text: str) -> list[str]:
    """The words of a readable text in plain form; runs of a script without spaces are cut into pairs of characters."""
    if _CHARACTER.search(text):
        return [w for t in text.split() for piece in _PIECES.findall(t) if (w := plain(piece))]
    return [w for w in map(plain, text.split()) if w]


def run_hashes(words: list[str], size: int) -> np.ndarray:
    """Hashes of all runs of so many words, the same in every process."""
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    if len(h) < size:
        return h[:0]
    out = np.full(len(h) - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
    return out


class Breaks:
    """Places between the words of a text, counted in letters of its plain form."""

    def __init__(self, text: str | None):
        at, self.signs, self.spaces = 0, [0], [0]
        for token in _HYPHEN.sub("", readable(text or "")).split():
            for piece in _SIGNS.split(token):
                for part in _SINGLE.findall(piece) if _CHARACTER.search(piece) else (piece,):
                    if n := len(plain(part)):
                        at += n
                        self.signs.append(at)
            if at > self.spaces[-1]:
                self.spaces.append(at)
        self.every = frozenset(self.signs)

    def joined(self, p: int, step: int) -> bool:
        """Whether the word that begins at p, or holds p, in the direction of step seems to be several without spaces."""
        k = bisect_right(self.spaces, p) if step > 0 else bisect_left(self.spaces, p)
        return 0 < k < len(self.spaces) and self.spaces[k] - self.spaces[k - 1] > JOINED

    def past(self, p: int, step: int) -> list[int]:
        """Places where one word that begins at p in the direction of step, or is left of it, can end."""
        if self.joined(p, step):
            lo, hi = (p + 1, min(p + JOINED, self.spaces[-1])) if step > 0 else (max(p - JOINED, 0), p - 1)
            return list(range(lo, hi + 1))
        if step > 0:
            k = bisect_right(self.spaces, p)
            return self.signs[bisect_right(self.signs, p) : bisect_right(self.signs, self.spaces[k])] if k < len(self.spaces) else []
        k = bisect_left(self.spaces, p) - 1
        return self.signs[bisect_left(self.signs, self.spaces[k]) : bisect_left(self.signs, p)] if k >= 0 else []


def grams(z: str) -> np.ndarray:
    """Hashes of all sequences of eight characters."""
    c = np.frombuffer(z.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < GRAM:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        base, width = np.uint64(0x9E3779B97F4A7C15), 1
        h = (c + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        while width < GRAM:
            h = h[:-width] * base + h[width:]
            base, width = base * base, 2 * width
        return h ^ (h >> np.uint64(29))


class ItemIndex:
    """Inverted index of the items with per-block bounds. Size grows with the items, never with the documents."""

    def __init__(self, items: list[tuple[int, str | None]], shared: np.ndarray | None = None):
        """shared: hashes of the runs that stand in several items; without it they are taken from these items alone."""
        items = sorted((i, readable(t)) for i, t in items if t)
        self.ids, self.words, self.streams, self.own, self.alone, self.starts, self.ends = [i for i, _ in items], [], [], [], [], [], []
        pieces = [item_words(t) for _, t in items]
        if shared is None:
            shared = several(pieces)
        postings = []
        for k, words in enumerate(pieces):
            own = np.ones(len(words), bool)
            for j in np.flatnonzero(np.isin(run_hashes(words, SHARED_WORDS), shared)).tolist():
                own[j : j + SHARED_WORDS] = False
            self.alone.append((~np.isin(run_hashes(words, OWN_RUN), shared)).tolist())  # whether the run from each word on is its own
            ends = np.cumsum([len(w) for w in words]).tolist() if words else []
            self.words.append([(b - len(w), b) for b, w in zip(ends, words)])
            self.starts.append([a for a, _ in self.words[-1]])
            self.ends.append([b for _, b in self.words[-1]])
            self.own.append(own)
            self.streams.append("".join(words))
            g = grams(self.streams[-1])
            mine = np.repeat(own, [len(w) for w in words])[: len(g)] if len(g) else np.zeros(0, bool)
            postings.append((g[mine], np.full(int(mine.sum()), k), np.flatnonzero(mine)))
        g, item, place = (np.concatenate([p[x] for p in postings]) if postings else np.zeros(0, np.int64) for x in range(3))
        order = np.argsort(g.astype(np.uint64), kind="stable")
        g, self.item, self.place = g.astype(np.uint64)[order], item[order].astype(np.int64), place[order].astype(np.int64)
        self.terms, first = np.unique(g, return_index=True)
        self.first = np.append(first, len(g))
        self.filter = np.zeros(1 << BUCKET_BITS, bool)
        self.filter[(self.terms >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)] = True
        sizes = np.array([len(x) for x in self.streams] or [0])
        self.offset = np.cumsum(sizes) - sizes  # of each item's letters and words, laid end to end
        words = np.array([len(x) for x in self.words] or [0])
        self.first_word = np.cumsum(words) - words
        self.all_starts = np.concatenate([o + np.asarray(x, int) for o, x in zip(self.offset, self.starts)] or [np.zeros(0, int)])
        self.all_ends = np.concatenate([o + np.asarray(x, int) for o, x in zip(self.offset, self.ends)] or [np.zeros(0, int)])
        letters = int(sizes.sum())
        self.letter_item = np.repeat(np.arange(len(sizes)), sizes).astype(np.int32)
        self.word_from = np.searchsorted(self.all_starts, np.arange(letters)).astype(np.int32)  # the first word that begins at a letter or behind it
        self.letter = self.offset[self.item] + self.place if len(self.item) else np.zeros(0, np.int64)
        n, length = max(1, len(items)), np.array([len(s) for s in self.streams] or [1], float)
        term = np.repeat(np.arange(len(self.terms)), np.diff(self.first))
        pair, tf = np.unique(term * n + self.item, return_counts=True)  # one posting per (term, item)
        self.p_term, self.p_item = pair // n, pair % n
        df = np.bincount(self.p_term, minlength=len(self.terms))
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.p_item] / length.mean()))
        self.p_score = idf[self.p_term] * weight
        self.p_first = np.searchsorted(self.p_term, np.arange(len(self.terms) + 1))
        self.blocks = -(-n // BLOCK)
        block = self.p_term * self.blocks + self.p_item // BLOCK
        self.b_key, inverse = np.unique(block, return_inverse=True)
        self.b_bound = np.zeros(len(self.b_key))
        np.maximum.at(self.b_bound, inverse, self.p_score)
        self.b_first = np.searchsorted(self.b_key // self.blocks, np.arange(len(self.terms) + 1))
        self.t_bound = np.zeros(len(self.terms))
        np.maximum.at(self.t_bound, self.p_term, self.p_score)
        self.least = self._least_scores()
        self.threshold = float(self.least[0].min(initial=np.inf)) if len(weight) else np.inf
        self.block_threshold = np.minimum.reduceat(self.least[0], np.arange(0, n, BLOCK)) if items else np.zeros(1)
        self.fewest = int(self.least[1].min(initial=1 << 30))

    def _least_scores(self) -> np.ndarray:
        """For each item the least score, and the least number of sequences, that a passage of it can have in a document.

        A passage of 15 words has one altered; one of 16 and more holds 16 words with at most two. What an altered word
        takes away are the sequences that touch it. Items without 15 words of their own have no passage.
        """
        out = np.full((2, max(1, len(self.ids))), np.inf)
        key = self.p_term * max(1, len(self.ids)) + self.p_item
        owner = np.repeat(np.arange(len(self.terms)), np.diff(self.first)) * max(1, len(self.ids)) + self.item
        posting = np.searchsorted(key, owner)
        each = self.p_score[posting] / np.bincount(posting, minlength=len(key))[posting] if len(key) else np.zeros(0)
        by_item = np.argsort(self.item, kind="stable")
        edge = np.searchsorted(self.item[by_item], np.arange(len(self.ids) + 1))
        for k in range(len(self.ids)):
            starts, ends, own = np.asarray(self.starts[k]), np.asarray(self.ends[k]), self.own[k]
            mine = by_item[edge[k] : edge[k + 1]]
            score = np.zeros((2, len(self.streams[k]) + 1))
            score[0, self.place[mine] + 1], score[1, self.place[mine] + 1] = each[mine], 1
            total = np.cumsum(score, axis=1)  # of the sequences that begin before each place
            for size, altered in ((MIN_WORDS, MIN_WORDS // ONE_IN), (2 * ONE_IN, 2)):
                i = np.arange(len(own) - size + 1) if len(own) >= size else np.zeros(0, int)
                held = np.cumsum(np.concatenate([[0], own]))
                i = i[held[i + size] - held[i] == size]
                if not len(i):
                    continue
                a, b = starts[i], ends[i + size - 1]
                last = np.maximum(b - GRAM + 1, a)
                word = i[:, None] + np.arange(size)[None, :]
                lo, hi = np.maximum(starts[word] - GRAM + 1, a[:, None]), np.minimum(ends[word], last[:, None])
                hi = np.maximum(hi, lo)
                for row in (0, 1):
                    lost = np.sort(total[row][hi] - total[row][lo], axis=1)[:, -altered:].sum(1)
                    rest = total[row][last] - total[row][a] - lost
                    rest = rest * np.minimum(1.0, PASSAGE / 2 / (b - a + 2 * JOINED))  # what of it surely lies in one passage of a document
                    out[row, k] = min(out[row, k], rest.min())
        return np.where(np.isfinite(out), np.maximum(out - 1e-6, 0.5), np.inf)

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h whose sequence is a term, and the terms."""
        at = np.flatnonzero(self.filter[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)])
        if not len(at) or not len(self.terms):
            return at[:0], at[:0]
        t = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        same = self.terms[t] == h[at]
        return at[same], t[same]

    @staticmethod
    def _spread(first: np.ndarray, terms: np.ndarray):
        """For each term the range of its entries, laid end to end: (index of the term in the list, entry)."""
        n = first[terms + 1] - first[terms]
        ends = np.cumsum(n)
        which = np.repeat(np.arange(len(terms)), n)
        return which, np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + first[terms][which]

    def retrieve(self, half: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(half passage, item) of every item whose BM25 score for the passage that begins there reaches the least that a passage of it can have.

        A passage is two halves in a row; a sequence counts as often as the passage has it. First the greatest scores
        of a passage's terms are added up, then, for passages that can reach the least threshold, their bounds per block
        of items; only blocks that can reach their threshold have their postings scored.
        """
        halves = int(half.max()) + 2
        most = np.bincount(half, self.t_bound[term], minlength=halves)
        good = np.flatnonzero(most[:-1] + most[1:] >= self.threshold)
        live = np.zeros(halves, bool)
        live[good] = live[good + 1] = True
        keep = live[half]
        half, term = half[keep], term[keep]
        if not len(half):
            return half, half
        dense = np.cumsum(live) - 1 + np.cumsum(np.diff(live.astype(np.int8), prepend=0) == 1)  # halves in use, a gap between stretches
        back = np.zeros(int(dense[-1]) + 2, np.int64)
        back[dense[live]] = np.flatnonzero(live)
        half, rows = dense[half], len(back)
        which, entry = self._spread(self.b_first, term)
        bound = np.bincount(half[which] * self.blocks + self.b_key[entry] % self.blocks, self.b_bound[entry], minlength=rows * self.blocks).reshape(rows, self.blocks)
        passes = bound[:-1] + bound[1:] >= self.block_threshold
        open_ = np.zeros((rows, self.blocks), bool)
        open_[:-1] |= passes
        open_[1:] |= passes
        keep = open_.any(1)[half]
        half, term = half[keep], term[keep]
        which, entry = self._spread(self.p_first, term)
        keep = open_[half[which], self.p_item[entry] // BLOCK]
        n = len(self.ids)
        key, weight = (half[which] * n + self.p_item[entry])[keep], self.p_score[entry][keep]
        if rows * n <= DENSE_CELLS:
            score = np.bincount(key, weight, minlength=rows * n).reshape(rows, n)
            both = score[:-1] + score[1:]
            at, item = np.nonzero((both >= self.least[0][:n]) & (score[:-1] > 0))
            more, other = np.nonzero((both >= self.least[0][:n]) & (score[1:] > 0))
            return np.concatenate([back[at], back[more + 1]]), np.concatenate([item, other])
        cells, inverse = np.unique(key, return_inverse=True)
        if not len(cells):
            return cells, cells
        score = np.bincount(inverse, weight)
        after = np.minimum(np.searchsorted(cells, cells + n), len(cells) - 1)
        before = np.maximum(np.searchsorted(cells, cells - n), 0)
        pair = score + np.where(cells[after] == cells + n, score[after], 0)
        other = score + np.where((before < len(cells)) & (cells[np.minimum(before, len(cells) - 1)] == cells - n), score[np.minimum(before, len(cells) - 1)], 0)
        good = cells[np.maximum(pair, other) >= self.least[0][cells % n]]
        return back[good // n], good % n

    def anchors(self, starts: np.ndarray, at: np.ndarray, term: np.ndarray, pairs: np.ndarray) -> dict[int, list[tuple]]:
        """Exact common runs of the pairs (text * items + item, sorted) that can be a passage's longest: {pair: [(shift, first word, end)]}.

        at are places in the texts laid end to end, starts where each begins. Common sequences are sorted by their
        distance from item to text, so that those of one run lie in a row.
        """
        n = len(self.ids)
        doc = np.searchsorted(starts, at, side="right") - 1
        wanted = np.zeros(len(starts), bool)
        wanted[pairs // n] = True
        keep = wanted[doc]
        which, entry = self._spread(self.first, term[keep])
        d, letters = at[keep][which], len(self.letter_item)
        key = np.sort(((d - self.letter[entry] + letters) << 32) | d)
        if not len(key):
            return {}
        lo = np.flatnonzero(np.diff(key, prepend=key[0] - 2) != 1)
        size = np.diff(np.append(lo, len(key))) + GRAM - 1
        d, far = key[lo] & 0xFFFFFFFF, (key[lo] >> 32) - letters
        place = d - far
        item, text = self.letter_item[place], np.searchsorted(starts, d, side="right") - 1
        a = self.word_from[place]
        inner = np.searchsorted(self.all_ends, place + size, side="right") - a  # words wholly within
        good = np.flatnonzero(inner >= RUN_WORDS)
        good = good[np.isin(text[good] * n + item[good], pairs)]
        out: dict[int, list[tuple]] = {}
        first = a - self.first_word[item]
        shift = d - starts[text] - (place - self.offset[item])
        for x in good.tolist():
            out.setdefault(int(text[x]) * n + int(item[x]), []).append((int(shift[x]), int(first[x]), int(first[x] + inner[x])))
        return out

    def holds(self, z: str, at: np.ndarray, term: np.ndarray, item: int, anchors: list[tuple], breaks: Callable[[], Breaks]) -> bool:
        """Whether the stream z holds 15 words in a row of the item, at most one in eight altered, missing or added.

        Exact common sequences are chained along the document; between two links the item's words are looked for in
        the text between, beyond the ends of a chain word by word. Words of shared wording end a run. Chains without a
        run that can be a passage's longest are left out.
        """
        good = {(shift, a) for shift, a, b in anchors if self._plausible(z, shift, item, a, b)}
        if not good:
            return False
        which, entry = self._spread(self.first, term)
        mine = self.item[entry] == item
        d, s = at[which][mine], self.place[entry][mine]
        order = np.lexsort((d, d - s))
        d, s = d[order], s[order]
        cut = np.flatnonzero((np.diff(d - s) != 0) | (np.diff(d) != 1)) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(d)]])
        links = sorted(zip(d[lo].tolist(), s[lo].tolist(), (hi - lo + GRAM - 1).tolist()))
        anchor = {link for link in links if (link[0] - link[1], bisect_left(self.starts[item], link[1])) in good}
        return any(self._run(z, chain, item, breaks) for chain in self._chains(links) if not anchor.isdisjoint(chain))

    def _reach(self, z: str, shift: int, item: int, k: int, step: int) -> tuple[int, int, int]:
        """How many words from k on in the direction of step come before the first, second and third that isn't in z near its place."""
        words, own, stream, out, near = self.words[item], self.own[item], self.streams[item], [], 3 * JOINED
        n, last = 0, len(words)
        while 0 <= k < last and own[k] and n < 2 * ONE_IN:
            p, q = words[k]
            if z.find(stream[p:q], max(0, p + shift - near), q + shift + near) < 0:
                out.append(n)
                if len(out) == 3:
                    return tuple(out)
            n, k = n + 1, k + step
        return tuple(out + [n] * (3 - len(out)))

    def _plausible(self, z: str, shift: int, item: int, a: int, b: int) -> bool:
        """Whether the words a to b, which z holds in a row, and their surroundings in the item can be a passage.

        A passage has 15 words with one altered or holds 16 in a row with two altered; more needn't be seen.
        """
        if not self.own[item][a:b].all():
            return False
        if b - a >= MIN_WORDS:
            return True
        right = self._reach(z, shift, item, b, 1)
        if b - a + right[2] + 2 * ONE_IN < MIN_WORDS:
            return False
        left = self._reach(z, shift, item, a - 1, -1)
        return any(b - a + left[c] + right[altered - c] >= (MIN_WORDS if altered < 2 else 2 * ONE_IN) for altered in range(3) for c in range(altered + 1))

    @staticmethod
    def _chains(links: list[tuple[int, int, int]]) -> list[list]:
        """Every link with the best way to it, unless it lies on the way to another. Links near it in the document are all tried."""
        score, back, inner, near = [n for _, _, n in links], [-1] * len(links), set(), []
        for x, (d, s, n) in enumerate(links):
            near = [y for y in near if d - links[y][0] - links[y][2] <= REACH]
            for y in near:
                pd, ps, pn = links[y]
                gap_d, gap_s = d - pd - pn, s - ps - pn
                if -GRAM < gap_s <= REACH and -GRAM < gap_d <= REACH and abs(gap_d - gap_s) <= 40 and s > ps:
                    if (new := score[y] + n - abs(gap_d - gap_s)) > score[x] or back[x] < 0:
                        score[x], back[x] = new, y
            near.append(x)
            inner.add(back[x])
        chains = []
        for x in range(len(links)):
            if x not in inner:
                chain = []
                while x >= 0:
                    chain.append(links[x])
                    x = back[x]
                chains.append(chain[::-1])
        return chains

    def _beyond(self, z: str, breaks: Breaks, item: int, k: int, p: int, step: int, most: int) -> dict[int, int]:
        """Words from k on, in the direction of step, that stand in z from p on: the least number of words altered, missing or added before each.

        An altered or added word ends where a word of the document does. All ways with at most `most` of them are followed.
        """
        words, own, stream, found = self.words[item], self.own[item], self.streams[item], {}
        level, seen = {(k, p)}, set()
        for c in range(most + 1):
            todo, level = list(level), set()
            while todo:
                state = k, p = todo.pop()
                if state in seen or not 0 <= k < len(words) or not own[k]:
                    continue
                seen.add(state)
                w = stream[words[k][0] : words[k][1]]
                if z.startswith(w, p) if step > 0 else z.endswith(w, 0, p):
                    q = p + step * len(w)
                    if q in breaks.every or (len(w) >= JOINED_WORD and breaks.joined(p, step)):
                        found.setdefault(k, c)
                    todo.append((k + step, q))
                if c < most:
                    level.add((k + step, p))
                    for q in breaks.past(p, step):
                        level |= {(k + step, q), (k, q)}
        return found

    def _run(self, z: str, chain: list, item: int, breaks: Callable[[], Breaks]) -> bool:
        words, own, stream = self.words[item], self.own[item], self.streams[item]
        where = {}  # item word -> place in z of its start
        starts = [a for a, _ in words]
        for d, s, n in chain:
            k = int(np.searchsorted(starts, s))
            while k < len(words) and words[k][1] <= s + n:
                where[k] = d + words[k][0] - s
                k += 1
        if not where:
            return False
        known = sorted(where)
        # short words between two links count where they stand directly at one of them
        for a, b in zip(known, known[1:]):
            left, right, lo, hi = where[a] + words[a][1] - words[a][0], where[b], a + 1, b - 1
            while lo <= hi and z.startswith(w := stream[words[lo][0] : words[lo][1]], left) and left + len(w) <= right:
                where[lo], left, lo = left, left + len(w), lo + 1
            while lo <= hi and z.endswith(w := stream[words[hi][0] : words[hi][1]], left, right):
                right -= len(w)
                where[hi], hi = right, hi - 1
        first, last = min(where), max(where)
        # cost of each word: 1 if it is altered or missing; added text before it counts by its length
        cost, prev = [], None
        for k in range(first, last + 1):
            c = 0.0
            if k in where:
                if prev is not None:
                    between = where[k] - (where[prev] + words[prev][1] - words[prev][0])
                    lost = sum(words[j][1] - words[j][0] for j in range(prev + 1, k))
                    if between > 0 and k - prev == 1:
                        c = max(1, round(between / 6))
                    elif between > lost + 8:
                        c = max(0, round((between - lost) / 6))
                prev = k
            else:
                c = 1.0
            cost.append(c if own[k] else float("inf"))

        def owned(i: int, j: int, lo: int, hi: int) -> bool:
            """Whether enough of the item's own runs among the words i to j stand in z between lo and hi."""
            text, held = z[max(0, lo) : max(0, hi)], 0
            for k in range(i, j - OWN_RUN + 2):
                if self.alone[item][k] and stream[words[k][0] : words[k + OWN_RUN - 1][1]] in text:
                    held += 1
                    if held == OWN_RUNS:
                        return True
            return False

        def whole(i: int, j: int, total: float, lo: int, hi: int) -> bool:
            return j - i + 1 >= MIN_WORDS and total * ONE_IN <= j - i + 1 and owned(i, j, lo, hi)

        for i in (k for k in range(first, last + 1) if k in where):
            total = 0.0
            for j in range(i, last + 1):
                total += cost[j - first] if j > i or cost[j - first] == float("inf") else 0
                if total == float("inf"):
                    break
                if j in where and whole(i, j, total, where[i], where[j] + words[j][1] - words[j][0]):
                    return True
        # else word by word from each link on, in both directions
        most, before = len(words) // ONE_IN, (-1, -1)
        for d, s, n in chain:
            k = bisect_left(starts, s)
            if k == len(words) or words[k][1] > s + n or before == (k, d - s):
                continue
            before, p = (k, d - s), d + words[k][0] - s
            right = self._beyond(z, breaks(), item, k, p, 1, most)
            left = self._beyond(z, breaks(), item, k - 1, p, -1, most) | {k: 0}
            near = 3 * JOINED  # how far altered and added words may move the passage's ends
            if own[k] and any(
                whole(i, j, a + b, d - s + words[i][0] - near, d - s + words[j][1] + near) for i, a in left.items() for j, b in right.items()
            ):
                return True
        return False

    def search(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(place of the text, item id) of every leak among the texts, which are searched in slices of bounded length."""
        out, held, size, began = [], [], 0, 0
        for k, text in enumerate(texts):
            held.append(plain(readable(text)) if text else "")
            size += len(held[-1])
            if size >= SLICE_LETTERS or k == len(texts) - 1:
                out += [(began + j, i) for j, i in self._search(held, texts[began : k + 1])]
                held, size, began = [], 0, k + 1
        return out

    def _search(self, streams: list[str], texts: list[str | None]) -> list[tuple[int, int]]:
        lengths = np.array([len(z) for z in streams])
        h = grams("".join(streams))
        at, term = self.lookup(h)
        starts = np.cumsum(lengths) - lengths
        doc = np.searchsorted(starts, at, side="right") - 1
        inside = at - starts[doc] + GRAM <= lengths[doc] if len(at) else np.zeros(0, bool)
        at, term, doc = at[inside], term[inside], doc[inside]
        if not len(at):
            return []
        half = PASSAGE // 2
        local = at - starts[doc]
        halves = lengths // half + 2  # of each text, with a gap behind
        begin = np.cumsum(halves) - halves
        p, item = self.retrieve(begin[doc] + local // half, term)
        if not len(p):
            return []
        n = len(self.ids)
        found = self.anchors(starts, at, term, np.unique((np.searchsorted(begin, p, side="right") - 1) * n + item))
        out, breaks = [], lru_cache(maxsize=1)(lambda k: Breaks(texts[k]))
        for pair, anchors in found.items():
            k, i = divmod(pair, n)
            a, b = np.searchsorted(doc, [k, k + 1])
            if self.holds(streams[k], local[a:b], term[a:b], i, anchors, lambda k=k: breaks(k)):
                out.append((k, self.ids[i]))
        return out


def several(pieces: list[list[str]]) -> np.ndarray:
    """Hashes of the runs of SHARED_WORDS and of OWN_RUN words that stand in several of the texts."""
    each = [np.unique(np.concatenate([run_hashes(words, n) for n in (SHARED_WORDS, OWN_RUN)])) for words in pieces]
    h, count = np.unique(np.concatenate(each or [np.zeros(0, np.uint64)]), return_counts=True)
    return h[count > 1]


def _runs(batches):
    for batch in batches:
        for i, t in zip(*(batch.column(c).to_pylist() for c in ("item_id", "text"))):
            words = item_words(readable(t))
            h = np.unique(np.concatenate([run_hashes(words, n) for n in (SHARED_WORDS, OWN_RUN)])).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(h), pa.int64()), pa.array(h)], names=["item_id", "run"])


def _hits(docs: DataFrame, key: str, text: str, own: ItemIndex) -> DataFrame:
    index = docs.sparkSession.sparkContext.broadcast(own)

    def run(batches):
        own = index.value
        for batch in batches:
            ids, texts = batch.column(key), batch.column(text)
            for lo in range(0, batch.num_rows, 1000):
                hits = own.search(texts.slice(lo, 1000).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([lo + k for k, _ in hits], pa.int64())), pa.array([i for _, i in hits], pa.int64())], names=[key, "item_id"]
                )

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, item_id bigint")


def find_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, part_letters: int = PART_LETTERS) -> DataFrame:
    """(key, item_id) of every document that holds a passage of an item; each pair once per row of docs.

    Items whose text is null or empty match nothing; documents likewise. The items' index is a broadcast value of
    bounded size: more than part_letters are cut into parts by a hash of their id, and the documents are searched for
    one part after the other. What items share is found over all of them. The documents are never shuffled.
    """
    known = items.where(F.length("text") > 0).select("item_id", "text")
    parts = -(-int(known.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // part_letters)
    if parts <= 1:
        return _hits(docs, key, text, ItemIndex([(r.item_id, r.text) for r in known.collect()])).distinct()
    runs = known.mapInArrow(_runs, "item_id bigint, run bigint")
    shared = settle(runs.distinct().groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("run"))
    found = []
    for p in range(parts):
        mine = known.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p)
        here = mine.mapInArrow(_runs, "item_id bigint, run bigint").join(shared, "run", "left_semi").select("run").distinct()
        own = ItemIndex([(r.item_id, r.text) for r in mine.collect()], here.toArrow().column(0).to_numpy().view(np.uint64))
        found.append(stored(_hits(docs, key, text, own)))  # one index at a time
    return reduce(DataFrame.unionByName, found).distinct()


@query("p9_found")
def found(spark, where):
    return find_leaks(spread(table(spark, where, "documents")), "doc_id", "text", table(spark, where, "eval_items"))
