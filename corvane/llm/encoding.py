"""Problem 8: a whole corpus encoded with a public byte-level BPE vocabulary.

Two tiers. A minimal perfect hash over the vocabulary answers for pre-tokens that are whole tokens, for all distinct
pre-tokens of a batch at once. The others are merged: their bytes form a linked list, a heap holds the possible
merges by rank, so that a pre-token of n bytes takes n log n steps however long it is.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.registry import query
from corvane.session import spread
from corvane.sources.tables import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SLICE_BYTES = 4_000_000  # of text that is encoded at once
# Fixed value: how this vocabulary cuts a text before merging.
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for ASCII, written out so that the faster standard engine can be used.
ASCII_PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
REMEMBERED = 200_000


class PerfectHash:
    """A minimal perfect hash in levels: at each a bit is set where exactly one of the remaining keys falls.

    The value of a key is the number of set bits before its own. Strange keys get some value or -1; the caller
    compares the key.
    """

    def __init__(self, hashes: np.ndarray):
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two keys have the same hash")
        self.levels, rest, base = [], hashes.astype(np.uint64), 0
        while len(rest):
            size = max(64, 2 * len(rest))
            place = self._place(rest, len(self.levels), size)
            single = np.bincount(place, minlength=size) == 1
            rank = np.cumsum(single) - single + base
            self.levels.append((size, single, rank.astype(np.int64)))
            base += int(single.sum())
            rest = rest[~single[place]]

    @staticmethod
    def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (h ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return ((x >> np.uint64(33)) % np.uint64(size)).astype(np.int64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        h = hashes.astype(np.uint64)
        for level, (size, single, rank) in enumerate(self.levels):
            place = self._place(h[left], level, size)
            hit = single[place]
            out[left[hit]] = rank[place[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out


class BytePairs:
    """Encoder for a vocabulary file of lines "base64 rank"."""

    def __init__(self, path: str = VOCABULARY):
        import re

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = list(self.ranks)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
        self.hash = PerfectHash(hashes)
        self.token_at: list[bytes] = [b""] * len(tokens)
        self.id_at = np.zeros(len(tokens), np.int32)
        # Whole-token answers hold only for tokens that merging reaches by itself.
        self.unreached = {t for t in tokens if len(t) > 1 and self.merge(t) != [self.ranks[t]]}
        for t, place in zip(tokens, self.hash(hashes)):
            self.token_at[place], self.id_at[place] = t, self.ranks[t]
        self.any_cut = regex.compile(PRE_TOKENS).findall
        self.ascii_cut = re.compile(ASCII_PRE_TOKENS).findall
        self.merged: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token: the adjacent pair of the least rank is joined, of equal ranks the left one."""
        n, ranks = len(piece), self.ranks
        if n == 1:
            return [ranks[piece]]
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here; end 0: no part
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:  # one of the two parts has changed since
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the offsets of each text; null and empty texts have none."""
        seen: dict[str, int] = {}
        number, cuts, codes = seen.setdefault, [0], []
        for t in texts:
            if t:
                codes += [number(p, len(seen)) for p in (self.ascii_cut(t) if t.isascii() else self.any_cut(t))]
            cuts.append(len(codes))
        pieces = [p.encode("utf-8", "surrogatepass") for p in seen]
        place = self.hash(np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), np.uint64, len(pieces)))
        ids, count = [], np.ones(len(pieces), np.int64)
        if len(self.merged) > REMEMBERED:
            self.merged.clear()
        for i, (p, at) in enumerate(zip(pieces, place.tolist())):
            if at >= 0 and self.token_at[at] == p and p not in self.unreached:
                ids.append(self.id_at[at])
                continue
            if (found := self.merged.get(p)) is None:
                found = self.merge(p)
                if len(p) <= 64:
                    self.merged[p] = found
            ids += found
            count[i] = len(found)
        flat, order = np.array(ids, np.int32), np.array(codes, np.int64)
        start = np.concatenate([[0], np.cumsum(count)])[:-1]
        n = count[order] if len(order) else np.zeros(0, np.int64)
        ends = np.cumsum(n)
        out = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[order] - (ends - n), n)] if len(order) else flat[:0]
        return out, np.concatenate([[0], ends])[np.array(cuts)]


@lru_cache(maxsize=4)
def encoder(path: str) -> BytePairs:
    return BytePairs(path)


def encode_batches(batches, path: str, key: str, text: str):
    own = encoder(path)
    for batch in batches:
        step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.column(text).nbytes))
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            flat, offsets = own.encode(part.column(text).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(key), lists], names=[key, "ids"])


def encode_texts(docs: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, ids) of each row, without special tokens; their strings in a text are ordinary text.

    A map over Arrow batches, no shuffle. Null and empty texts give an empty list; repeated rows stay. `path` names
    the vocabulary file on every executor.
    """
    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(lambda it: encode_batches(it, path, key, text), f"`{key}` {kind}, ids array<int>")


@query("p8_ids")
def ids(spark, where):
    return encode_texts(spread(table(spark, where, "documents")), "doc_id", "text")


@query("p8_token_counts")
def token_counts(spark, where):
    """(doc_id, n_tokens), for budgets of tokens."""
    return ids(spark, where).select("doc_id", F.size("ids").alias("n_tokens"))
