"""Problem 10: the languages of documents and of their segments by rank-order profiles.

A language's profile holds its most frequent n-grams (1 to 5 letters within padded words) in order of frequency. A
text's distance to a language is the sum, over the text's n-grams, of how far out of place each one is; an n-gram that
the profile lacks is out of place by the profile's length. n-grams that are equally frequent share the first rank.

A text is cut into segments where its language seems to change: a path of least cost through the words of a paragraph,
in which a word costs its n-grams' distances as if each stood at first rank, as nearly all do within a few words. The
language of a segment, and its confidence, are then what the out-of-place distance of all its n-grams says, ranked by
their frequency in the segment; so are those of whole documents.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.registry import query
from corvane.session import spread
from corvane.sources.tables import table

PROFILE = 500  # n-grams of a language
TEXT_PROFILE = 300  # n-grams of a document
SAMPLE = 150  # labelled documents of a language that profiles are fitted on, at most
SAMPLE_CHARS = 20_000  # longer ones aren't taken into the sample
PASSAGE_WORDS = 7
FOUND_WORDS = 6  # a passage's first or last word may be taken for its neighbour's language
WHOLE = 0.7  # of a sentence's words: the others may be names
WORD_EVIDENCE = 6.0  # least mean evidence of a word: below it, words are names, signs or code
DENSE_EVIDENCE = 0.5  # the same for two letters of a script without spaces
SWITCH, SWITCH_AT_SENTENCE = 9.0, 4.0  # cost of a change of language, in units of one n-gram of first rank
CONFIDENT = 0.04  # least confidence of a short sentence: of some words, 2 % of evidence are about 4 % of distance
REMEMBERED = 400_000
REMEMBERED_CHARS = 40  # longer tokens, of scripts without spaces, hardly come again
GRAM_BITS = 13  # 16 profiles of 500 n-grams are numbered within them
BLOCK = 1 << 16  # n-grams that distances are taken of at once
WORDS_AT_ONCE = 1 << 12  # that are searched for changes at once

# Code, codes of three letters, English name.
LANGUAGES = """
en eng english
de deu ger german
fr fra fre french
es spa spanish
pt por portuguese
it ita italian
nl nld dut dutch
sv swe swedish
pl pol polish
tr tur turkish
ru rus russian
uk ukr ukrainian
el ell gre greek
ja jpn japanese
zh zho chi chinese
ar ara arabic
"""
CODES = [line.split()[0] for line in LANGUAGES.strip().splitlines()]
NAMES = {name: line.split()[0] for line in LANGUAGES.strip().splitlines() for name in line.split()}

_WORD = re.compile(r"[^\W\d_]+(?:[̀-ًͯ-ٟ]+[^\W\d_]*)*")
_ADDRESS = re.compile(r"\S+://\S+|www\.\S+|\S+@\S+\.\S+")
_END = re.compile(r"[.!?…。！？؟]+[\"'»”’)\]]*(?=\s|$)|[。！？]+|\n")
_DENSE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")


#: Scripts that one of the languages alone is written in: the words of a text that are written in it need no label.
SCRIPTS = {"ja": "\u3040-\u30ff\u3400-\u9fff", "zh": "\u3400-\u9fff", "ar": "\u0600-\u06ff", "el": "\u0370-\u03ff\u1f00-\u1fff"}
#: What tells the script in a text.
_SIGN = {"ja": "[\u3040-\u30ff]{3}", "zh": "[\u3400-\u9fff]{3}", "ar": "[\u0600-\u06ff]{3}", "el": "[\u0370-\u03ff]{3}"}
_WRITTEN = {code: re.compile(f"[{script}]+$") for code, script in SCRIPTS.items()}


def code_of(label: str | None) -> str | None:
    """The code that a label names, in any spelling; None if it names none of the sixteen."""
    parts = re.split(r"[-_\s]", (label or "").strip().lower())
    return NAMES.get(parts[0])


def word_grams(word: str) -> list[str]:
    """n-grams of a lower-case word; scripts without spaces give characters and pairs."""
    if _DENSE.search(word):
        return list(word) + [word[i : i + 2] for i in range(len(word) - 1)]
    w = f"_{word}_"
    return [w[i : i + n] for n in range(1, 6) for i in range(len(w) - n + 1) if w[i : i + n] != "_"]


def _gram_hashes(c: np.ndarray) -> list[np.ndarray]:
    """Hashes of all runs of 1 to 5 characters."""
    out = [c.astype(np.uint64) + np.uint64(1)]
    with np.errstate(over="ignore"):
        for n in range(1, 5):
            out.append(out[-1][: max(0, len(c) - n)] * np.uint64(0x9E3779B97F4A7C15) + c[n:].astype(np.uint64) + np.uint64(1))
    return out


def _hash_of(gram: str) -> int:
    return int(_gram_hashes(np.frombuffer(gram.encode("utf-32-le", "surrogatepass"), np.uint32))[len(gram) - 1][0])


class _Numbers(dict):
    """Numbers of words, given out when a word is first asked for."""

    def __init__(self, owner: Profiles):
        self.owner = owner

    def __missing__(self, word: str) -> int:
        at = self[word] = self.owner.add(word)
        return at


class _Tokens(dict):
    """Numbers of tokens, the runs of signs between white space."""

    def __init__(self, owner: Profiles):
        self.owner = owner

    def __missing__(self, token: str) -> int:
        at = self.owner.add_token(token)
        if len(token) <= REMEMBERED_CHARS:
            self[token] = at
        return at


class Profiles:
    """Rank-order profiles of the languages, and the distances of words and texts to them."""

    def __init__(self, texts: list[tuple[str, str]]):
        """texts: (code, text). Texts that turn out nearer to another language are left out of a second fit."""
        words = lambda code, text: (w for w in _WORD.findall(text) if code not in _WRITTEN or _WRITTEN[code].match(w))
        counts = [(code, Counter(w.lower() for w in words(code, text))) for code, text in texts]
        self._fit(counts)
        if len(self.codes) > 1:
            numbers = [[self.numbers[w] for w, k in n.items() for _ in range(k)] for _, n in counts]
            nearest = self.distances(np.array([i for x in numbers for i in x], int), np.array([len(x) for x in numbers])).argmin(1)
            self._fit([(c, n) for (c, n), k in zip(counts, nearest) if n and self.codes[k] == c] or counts)

    def _fit(self, counts):
        total: dict[str, Counter] = {}
        for code, words in counts:
            total.setdefault(code, Counter()).update(words)
        self.codes = [c for c in CODES if total.get(c)]
        self.row: dict[str, int] = {}
        ranks = []
        for k, code in enumerate(self.codes):
            grams: Counter = Counter()
            for w, n in total[code].items():
                for g in word_grams(w):
                    grams[g] += n
            for r, (g, _) in enumerate(sorted(grams.items(), key=lambda x: (-x[1], x[0]))[:PROFILE]):
                if (at := self.row.setdefault(g, len(ranks))) == len(ranks):
                    ranks.append([PROFILE] * len(self.codes))
                ranks[at][k] = r
        self.ranks = np.array(ranks, np.float64).reshape(len(ranks), len(self.codes))
        self.places = np.where(self.ranks < PROFILE, self.ranks, 1 << 14).astype(np.int16)  # what a profile lacks is out of place by its length
        hashes = np.array([_hash_of(g) for g in self.row], np.uint64)
        self.gram_hash, self.gram_row = np.sort(hashes), np.array(list(self.row.values()), np.int32)[np.argsort(hashes)]
        self.near = (1 - self.ranks / PROFILE).astype(np.float32)  # how far below the greatest distance
        self.forget()

    def forget(self):
        """Words met so far get numbers, under which their length, n-grams and evidence are kept."""
        self.numbers = _Numbers(self)
        self.size = array("i")
        self.vectors = np.zeros((1024, len(self.codes)), np.float32)  # a row per word, with room to grow
        self.grams, self.gram_edge = np.zeros(0, np.int16), np.zeros(1, np.int64)  # word i has those from edge i to edge i + 1
        self.waiting: list[str] = []
        self.tokens = _Tokens(self)
        self.token_items, self.token_edge = array("i", [-1]), array("i", [0, 1])  # token 0 is the end of a line

    def add(self, word: str) -> int:
        self.size.append(len(word))
        self.waiting.append(word)
        return len(self.size) - 1

    def add_token(self, token: str) -> int:
        """A token's items are the numbers of its words, and -1 where a sentence ends."""
        at, number, find = 0, self.numbers.__getitem__, _WORD.findall
        for m in _END.finditer(token):
            self.token_items.extend(map(number, find(token, at, at := m.end())))
            self.token_items.append(-1)
        self.token_items.extend(map(number, find(token, at)))
        self.token_edge.append(len(self.token_items))
        return len(self.token_edge) - 2

    def items_of(self, tokens: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The items of tokens laid end to end, and where each token's items end."""
        at, edge = np.array(tokens, np.int64), np.array(self.token_edge, np.int64)
        first, n = edge[at], edge[at + 1] - edge[at]
        ends = np.cumsum(n)
        return np.array(self.token_items)[np.arange(ends[-1]) + np.repeat(first - ends + n, n)], ends

    def settle_words(self) -> None:
        """Looks up the n-grams of the words met since the last time, all at once."""
        if not self.waiting:
            return
        words, at = [w if w.isascii() else unicodedata.normalize("NFKC", w) for w in self.waiting], len(self.gram_edge) - 1
        self.waiting = []
        dense = [k for k, w in enumerate(words) if not w.isascii() and _DENSE.search(w)]
        skipped = set(dense)
        text = "\n" + "\n".join("" if k in skipped else f"_{w.lower()}_" for k, w in enumerate(words)) + "\n"
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.cumsum(c == 10) - 1
        found = []
        for n, h in enumerate(_gram_hashes(c), 1):
            inside = (owner[: len(h)] == owner[n - 1 :]) & (c[: len(h)] != 10) & ((n > 1) | (c[: len(h)] != 95))
            place = np.flatnonzero(inside)
            slot = np.minimum(np.searchsorted(self.gram_hash, h[place]), max(0, len(self.gram_hash) - 1))
            same = self.gram_hash[slot] == h[place] if len(self.gram_hash) else np.zeros(len(place), bool)
            found.append((owner[place[same]], self.gram_row[slot[same]]))
        who, rows = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        if dense:
            more = [(k, r) for k in dense for g in word_grams(words[k].lower()) if (r := self.row.get(g)) is not None]
            who, rows = np.concatenate([who, [k for k, _ in more]]).astype(int), np.concatenate([rows, [r for _, r in more]]).astype(np.int32)
        order = np.argsort(who, kind="stable")
        who, rows = who[order], rows[order]
        edge = np.searchsorted(who, np.arange(len(words) + 1))
        self.gram_edge = np.concatenate([self.gram_edge, self.gram_edge[-1] + edge[1:]])
        self.grams = np.concatenate([self.grams, rows.astype(np.int16)])
        if at + len(words) > len(self.vectors):
            room = np.zeros((max(2 * len(self.vectors), at + len(words)), len(self.codes)), np.float32)
            room[:at] = self.vectors[:at]
            self.vectors = room
        some = np.flatnonzero(np.diff(edge))
        if len(some):
            self.vectors[at + some] = np.add.reduceat(self.near[rows], edge[some], axis=0)

    def distances(self, numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Out-of-place distances (row per text, column per language) of texts given by the numbers of their words, laid end to end."""
        self.settle_words()
        out = np.full((len(sizes), len(self.codes)), float(PROFILE))
        if not len(numbers) or not self.codes:
            return out
        first = self.gram_edge[numbers]
        width = self.gram_edge[numbers + 1] - first
        edge = np.concatenate([[0], np.cumsum(sizes)])
        total = np.concatenate([[0], np.cumsum(width)])[edge]
        lo = 0
        while lo < len(sizes):
            hi = max(lo + 1, min(int(np.searchsorted(total, total[lo] + BLOCK, "right")) - 1, lo + BLOCK))
            if total[hi] > total[lo]:
                words = slice(edge[lo], edge[hi])
                self._distances(first[words], width[words], np.diff(total[lo : hi + 1]), out[lo:hi])
            lo = hi
        return out

    def _distances(self, first: np.ndarray, width: np.ndarray, sizes: np.ndarray, out: np.ndarray) -> None:
        """distances of some texts; first, width: where the n-grams of each word are and how many; sizes: those of each text."""
        ends, low = np.cumsum(width), (1 << GRAM_BITS) - 1
        gram = self.grams[np.arange(ends[-1]) + np.repeat(first - ends + width, width)]
        key = np.repeat(np.arange(len(sizes), dtype=np.int32) << GRAM_BITS, sizes) + gram
        key.sort()
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count, key = np.diff(start, append=len(key)), key[start].astype(np.int64)
        bits = int(count.max()).bit_length()
        key = (key >> GRAM_BITS << bits | (1 << bits) - 1 - count) << GRAM_BITS | key & low
        key.sort()  # by frequency within each text
        gram, level = key & low, key >> GRAM_BITS
        text = level >> bits
        begin = np.searchsorted(text, np.arange(len(sizes)))[text]
        fresh = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1]]))
        rank = np.repeat(fresh, np.diff(fresh, append=len(level))) - begin  # equally frequent ones share the first rank
        keep = np.arange(len(text)) - begin < TEXT_PROFILE
        text, gram, rank = text[keep], gram[keep], rank[keep]
        away = self.places.take(gram, 0)
        away -= rank.astype(np.int16)[:, None]
        np.minimum(np.abs(away, out=away), PROFILE, out=away)
        edge = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        out[text[edge]] = np.add.reduceat(away, edge, axis=0, dtype=np.int32) / np.diff(edge, append=len(text))[:, None]


def paths(costs: list[np.ndarray], switch: list[np.ndarray]) -> list[np.ndarray]:
    """For each paragraph the states of least total cost, changes costing switch[i] before word i. All at once."""
    order = sorted(range(len(costs)), key=lambda i: -len(costs[i]))
    out: list[np.ndarray] = [np.zeros(0, int)] * len(costs)
    for lo in range(0, len(order), 512):
        part = order[lo : lo + 512]
        longest, n = len(costs[part[0]]), len(part)
        if not longest:
            continue
        k = costs[part[0]].shape[1]
        c, s, size = np.zeros((longest, n, k), np.float32), np.zeros((longest, n), np.float32), np.array([len(costs[i]) for i in part])
        for j, i in enumerate(part):
            c[: size[j], j], s[: size[j], j] = costs[i], switch[i]
        back = np.zeros((longest, n, k), np.int8)
        total, stay = c[0].copy(), np.arange(k)[None, :]
        for t in range(1, longest):
            live = int((size > t).sum())
            best = total[:live].argmin(1)
            jump = total[np.arange(live), best] + s[t, :live]
            change = jump[:, None] < total[:live]
            back[t, :live] = np.where(change, best[:, None], stay)
            total[:live] = np.where(change, jump[:, None], total[:live]) + c[t, :live]
        for j, i in enumerate(part):
            state, path = int(total[j].argmin()), np.zeros(size[j], int)
            for t in range(size[j] - 1, -1, -1):
                path[t] = state
                state = back[t, j, state] if t else state
            out[i] = path
    return out


def may_change(near: np.ndarray, main: np.ndarray, start: np.ndarray, owner: np.ndarray, switch: np.ndarray) -> np.ndarray:
    """The paragraphs whose path of least cost may leave the text's language.

    A path that does so has a run of words in another language, which gains more than half of the changes at its ends cost:
    each change ends two runs at most, and the ends of the paragraph cost nothing. All other paragraphs stay as they are.
    """
    half = switch / 2
    half[start] = 0
    out, ends, lo = [], np.append(start[1:], len(near)), 0
    while lo < len(start):  # in parts that fit into caches
        hi = max(lo + 1, int(np.searchsorted(ends, start[lo] + WORDS_AT_ONCE, "right")))
        words, first, k = slice(start[lo], ends[hi - 1]), start[lo:hi] - start[lo], main[owner[start[lo] : ends[hi - 1]]]
        gain, each = near[words].astype(np.float64), np.arange(len(k))
        gain -= gain[each, k][:, None]
        gain[each, k] = -1  # the text's language itself
        upto = np.cumsum(gain, axis=0)
        lower = np.zeros((hi - lo, gain.shape[1]))
        lower[1:] = upto[first[1:] - 1]
        lower += np.arange(hi - lo)[:, None] * 3 * (np.abs(upto).max() + SWITCH)  # sums start again, below all that went before
        upto -= lower[owner[words] - lo]
        gain -= half[words, None]
        least = np.minimum.accumulate(np.subtract(upto, gain, out=gain), axis=0, out=gain)
        upto -= least
        best = upto.max(1) - np.append(half[words][1:], 0)
        out.append(lo + np.flatnonzero(np.maximum.reduceat(best, first) > -1e-3))
        lo = hi
    return np.concatenate(out)


def words_of(code: str, n: int, letters: int) -> int:
    """Words of a segment: two letters of a script without spaces count as one, and so do its characters and pairs."""
    return max(n, letters // 2) if code in ("ja", "zh") else n


def segments_of(texts: list[str | None], own: Profiles) -> tuple[list[list[tuple]], np.ndarray]:
    """For each text its segments (para_no, code, n_words, is_sentence, evidence, confidence, first word, end), in order, as the path cuts them; and the words' numbers."""
    if max(len(own.numbers), len(own.token_edge)) > REMEMBERED:
        own.forget()
    tokens, ends, where = [], [], []
    number = own.tokens.__getitem__
    for k, text in enumerate(texts):
        for p, part in enumerate(text.split("\n\n") if text else ()):
            if "://" in part or "@" in part or "www." in part:
                part = _ADDRESS.sub(" ", part)
            for line in part.split("\n"):
                tokens += map(number, line.split())
                tokens.append(0)
            ends.append(len(tokens))
            where.append((k, p))
    out: list[list[tuple]] = [[] for _ in texts]
    if not tokens or not own.numbers or not own.codes:
        return out, np.zeros(0, int)
    items, stops = own.items_of(tokens)
    real = items >= 0
    length = np.diff(np.cumsum(real)[stops[np.array(ends) - 1] - 1], prepend=0)
    if not length.any():
        return out, np.zeros(0, int)
    where = [where[i] for i in np.flatnonzero(length)]
    num, sent, length = items[real].astype(np.int64), np.cumsum(~real)[real], length[length > 0]
    start = np.cumsum(length) - length
    own.settle_words()
    near = own.vectors[num]  # of each word
    owner = np.repeat(np.arange(len(start)), length)
    text_of = np.array([k for k, _ in where])
    by_para = np.add.reduceat(near, start, axis=0)
    by_text = np.zeros((len(texts), near.shape[1]), np.float32)
    np.add.at(by_text, text_of, by_para)
    main = by_text.argmax(1)
    mine = main[text_of[owner]]
    fresh = np.concatenate([[True], np.diff(sent) != 0])
    switch = np.where(fresh, SWITCH_AT_SENTENCE, SWITCH)
    todo = may_change(near, main[text_of], start, owner, switch)
    spans = [slice(start[i], start[i] + length[i]) for i in todo]
    found = paths([-near[s] for s in spans], [switch[s] for s in spans])
    state = mine.copy()
    for s, path in zip(spans, found):
        state[s] = path
    # a change of state or paragraph ends a segment
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(state) != 0) | (np.diff(owner) != 0)]))
    stop = np.append(edge[1:], len(num))
    weight = np.add.reduceat(near, edge, axis=0)
    sent = np.cumsum(fresh) - 1
    held, opens = np.bincount(sent), np.flatnonzero(fresh)
    i, j = sent[edge], sent[stop - 1]
    within = (np.minimum(stop, opens[i] + held[i]) - edge >= WHOLE * held[i]) | (stop - np.maximum(edge, opens[j]) >= WHOLE * held[j])
    whole = within | (j > i + 1)
    code = state[edge]
    best = weight[np.arange(len(edge)), code]
    weight[np.arange(len(edge)), code] = 0
    share = np.where(best > 0, np.clip((best - weight.max(1)) / np.where(best > 0, best, 1), 0, 1), 0)
    size = np.add.reduceat(np.array(own.size)[num], edge)
    for x in zip(owner[edge].tolist(), code.tolist(), whole.tolist(), best.tolist(), share.tolist(), edge.tolist(), stop.tolist(), size.tolist()):
        k, p = where[x[0]]
        out[k].append((p, own.codes[x[1]], words_of(own.codes[x[1]], x[6] - x[5], x[7]), *x[2:7]))
    return out, num


def by_rank(segments: list[list[tuple]], num: np.ndarray, own: Profiles) -> list[list[tuple]]:
    """The segments with the languages and confidences that their out-of-place distances say; the confidence is 1 - nearest / second nearest.

    A segment whose nearest languages are equally far keeps the path's one.
    """
    spans = [s[6:8] for part in segments for s in part]
    if not spans:
        return segments
    words = np.concatenate([num[a:b] for a, b in spans])
    d = own.distances(words, np.array([b - a for a, b in spans]))
    two = np.sort(d, axis=1)[:, :2]
    sure = np.where(two[:, -1] > 0, 1 - two[:, 0] / np.maximum(two[:, -1], 1e-9), 0.0) if d.shape[1] > 1 else np.ones(len(d))
    at = {code: i for i, code in enumerate(own.codes)}
    path = np.array([at[s[1]] for part in segments for s in part])
    named = np.where(d[np.arange(len(d)), path] <= two[:, 0], path, d.argmin(1)).tolist()
    out, k, sure = [], 0, sure.tolist()
    for part in segments:
        new = []
        for p, code, n, whole, best, _, a, b in part:
            if at[code] != named[k]:
                code = own.codes[named[k]]
                best = float(own.vectors[num[a:b], named[k]].sum())
                n = words_of(code, b - a, sum(own.size[i] for i in num[a:b]))
            new.append((p, code, n, whole, best, sure[k], a, b))
            k += 1
        out.append(new)
    return out


def judged(texts: list[str | None], labels: list[str | None], own: Profiles) -> list[tuple[str | None, set[tuple[int, str]]]]:
    """rows_of_text of each text, from the languages and confidences that the ranks of all its segments say."""
    return [rows_of_text(part, label) for part, label in zip(by_rank(*segments_of(texts, own), own), labels)]


def rows_of_text(segments: list[tuple], label: str | None) -> tuple[str | None, set[tuple[int, str]]]:
    """The main language, and the rows (para_no, code) if the label or a mixture makes the text a case."""
    words: Counter = Counter()
    whole: set[str] = set()
    shown: set[tuple[int, str, bool]] = set()
    parts = Counter(s[0] for s in segments)
    for p, code, n, sentence, best, share, _, _ in segments:
        if best < (DENSE_EVIDENCE if code in ("ja", "zh") else WORD_EVIDENCE) * n:
            continue
        words[code] += n
        strong = share > CONFIDENT or n >= PASSAGE_WORDS
        if sentence and n >= 3 and strong:
            whole.add(code)
        if (sentence and strong) or n >= FOUND_WORDS:
            shown.add((p, code, n >= 3 or parts[p] == 1))  # a word or two amid a paragraph are borrowed, if not in the text's language
    if not words or not (whole or max(words.values()) >= PASSAGE_WORDS):
        return None, set()
    main = max(words, key=lambda c: (words[c], c))
    if code_of(label) == main and len(whole) < 2:
        return main, set()
    return main, {(p, c) for p, c, own in shown if c == main or own and (c in whole or words[c] >= FOUND_WORDS)}


def fit_profiles(docs: DataFrame, text: str, label: str, key: str) -> Profiles:
    """Profiles from a bounded sample: SAMPLE documents of each language, chosen by a hash of the key.

    The language is that of the label; where a script belongs to one language alone, it is fitted on the words in that
    script of texts with any label. A language that has neither has no profile and isn't recognised.
    """
    spelled = F.lower(F.split(F.trim(label), r"[-_\s]")[0])
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    strange = F.octet_length(text) != F.length(text)  # ASCII needs no look at scripts
    has = {c: strange & F.col(text).rlike(sign) for c, sign in _SIGN.items()}
    has["zh"] = has["zh"] & ~has["ja"]
    labelled = F.try_element_at(names, spelled)
    codes = [F.when(cond, F.lit(c)) for c, cond in has.items()] + [F.when(~labelled.isin(*has), labelled)]
    usable = docs.where(F.length(text).between(60, SAMPLE_CHARS)).select(
        F.col(key).alias("k"), F.explode(F.array_compact(F.array(*codes))).alias("code"), F.xxhash64(key).alias("h")
    )
    order = Window.partitionBy("code").orderBy("h", "k")
    chosen = usable.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE)  # at most SAMPLE rows a language
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")
    rows = texts.select("code", "n", "t").collect()
    rows.sort(key=lambda r: (r.code, r.n, r.t))
    return Profiles([(r.code, r.t) for r in rows])


def _mapped(docs: DataFrame, key: str, text: str, label: str, own: Profiles, make, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(own)  # some thousand n-grams, whatever the corpus

    def run(batches):
        for batch in batches:
            ids, texts, labels = (batch.column(c).to_pylist() for c in (key, text, label))
            for lo in range(0, len(ids), 2000):
                yield make(ids[lo : lo + 2000], texts[lo : lo + 2000], labels[lo : lo + 2000], shared.value)

    return docs.select(key, text, label).mapInArrow(run, schema)


def label_cases(docs: DataFrame, key: str, text: str, label: str, own: Profiles | None = None) -> DataFrame:
    """(key, para_no, lang): paragraphs and their languages for each document with a wrong, missing or mixed label.

    Null, empty and blank texts and texts without words have no language and no rows. Equal texts under several keys
    are judged each. No shuffle but for the sample's.
    """

    def make(ids, texts, labels, own):
        rows = [(i, p, c) for i, (_, found) in zip(ids, judged(texts, labels, own)) for p, c in sorted(found)]
        a, b, c = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.string())], names=[key, "para_no", "lang"])

    own = own or fit_profiles(docs, text, label, key)
    return _mapped(docs, key, text, label, own, make, f"`{key}` bigint, para_no int, lang string")


def document_languages(docs: DataFrame, key: str, text: str, label: str, own: Profiles | None = None) -> DataFrame:
    """(key, lang, confidence) of each document from the ranks of its own n-grams; no language: null and 0.

    The confidence is 1 - nearest distance / second nearest.
    """

    def make(ids, texts, labels, own):
        if len(own.numbers) > REMEMBERED:
            own.forget()
        words = [[own.numbers[w] for w in _WORD.findall(t or "")] for t in texts]
        distance = own.distances(np.array([i for x in words for i in x], int), np.array([len(x) for x in words]))
        langs, sure = [], []
        for x, d in zip(words, distance):
            two = np.sort(d)[:2]
            known = len(x) > 0 and len(d) > 0 and two[0] < PROFILE
            langs.append(own.codes[int(d.argmin())] if known else None)
            sure.append(round(float(1 - two[0] / two[-1]), 4) if known and len(two) > 1 and two[1] > 0 else 0.0)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(sure, pa.float64())], names=[key, "lang", "confidence"])

    own = own or fit_profiles(docs, text, label, key)
    return _mapped(docs, key, text, label, own, make, f"`{key}` bigint, lang string, confidence double")


def segment_languages(docs: DataFrame, key: str, text: str, label: str, own: Profiles | None = None) -> DataFrame:
    """(key, segment_no, para_no, lang, n_words, confidence): every segment of every document."""

    def make(ids, texts, labels, own):
        rows = [(i, n, s[0], s[1], s[2], round(s[5], 4)) for i, segs in zip(ids, by_rank(*segments_of(texts, own), own)) for n, s in enumerate(segs)]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64())
        columns = zip(*rows) if rows else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[key, "segment_no", "para_no", "lang", "n_words", "confidence"])

    own = own or fit_profiles(docs, text, label, key)
    return _mapped(docs, key, text, label, own, make, f"`{key}` bigint, segment_no int, para_no int, lang string, n_words int, confidence double")


@query("p10_found")
def found(spark, where):
    return label_cases(spread(table(spark, where, "documents")), "doc_id", "text", "lang")


@query("p10_documents")
def documents(spark, where):
    return document_languages(spread(table(spark, where, "documents")), "doc_id", "text", "lang")


@query("p10_segments")
def segments(spark, where):
    return segment_languages(spread(table(spark, where, "documents")), "doc_id", "text", "lang")
