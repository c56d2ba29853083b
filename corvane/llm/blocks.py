"""Leaf blocks of a page: runs of text with the path of tags above them, and vectors for both.

A block lies on one line of the html and under one path of block-level tags. Parsing is tolerant: unknown end tags are
ignored, unclosed ones end with their parent. Text inside script and style isn't shown and makes no block; text inside
hidden elements makes a block marked as hidden.
"""

from __future__ import annotations

import html as html_lib
import re
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import numpy as np

TAG_BUCKETS, WORD_BUCKETS = 64, 256
DEEPEST = 512  # levels; what opens below stands beside, as in browsers, whose parsers have this bound

_TOKEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>|\n|[^<\n]+|<[!?][^>]*>|<")
_RAW = re.compile(r"<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", re.S | re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo br button center cite code em font i img kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
_CLOSED_BY = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NAMED = re.compile(r"""\b(id|class|role|style|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HIDING = re.compile(r"display:none|visibility:hidden|font-size:0(?![.1-9])|text-indent:-|opacity:0(?![.1-9])", re.I)
_COLOURS = re.compile(r"(?<![-\w])color:([^;]+);?.*background(?:-color)?:\s*([^;]+)", re.I)
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Block:
    line: int
    path: tuple[str, ...]  # names of the tags above and around, outermost first
    text: str = ""
    linked: int = 0  # characters within links
    links: int = 0
    sample: list[str] = field(default_factory=list)  # texts of code, pre, samp and kbd
    hidden: bool = False
    noscript: bool = False


@lru_cache(maxsize=20_000)
def tag_name(tag: str, attributes: str) -> tuple[str, bool]:
    """The tag with what its id, class and role say, numbers masked; and whether it hides its content."""
    name, hidden = tag, False
    if attributes:
        for key, a, b, c in _NAMED.findall(attributes):
            key, value = key.lower(), (a or b or c).strip().lower()
            if key == "style":
                value = value.replace(" ", "")
                pair = _COLOURS.search(value)
                hidden |= bool(_HIDING.search(value)) or bool(pair and pair[1] == pair[2])
                name += ".styled"
            elif key == "hidden":
                hidden = True
            elif value:
                name += f".{key[0]}:" + re.sub(r"\d+", "9", value)
    return name, hidden


def parse(html: str | None) -> tuple[str, list[Block]]:
    """Title and blocks in order. Null and empty bodies have neither."""
    if not html:
        return "", []
    if "<!--" in html or "<script" in html or "<style" in html or "<SCRIPT" in html:
        html = _RAW.sub(lambda m: "\n" * m[0].count("\n"), html)
    stack: list[tuple[str, str, bool]] = []  # tag, name, hides
    blocks: list[Block] = []
    title: list[str] = []
    line, now, anchor, sample, hidden, noscript, in_title = 0, None, 0, 0, 0, 0, False
    names: tuple[str, ...] = ()
    inline: list[str] = []
    for m in _TOKEN.finditer(html):
        tag = m[2]
        if tag:
            tag = tag.lower()
            if "\n" in m[3]:
                line += m[3].count("\n")
            if tag == "br":
                if now is not None:
                    now.text += " "
                continue
            if tag in _VOID or tag in ("html", "body", "head"):
                continue
            if tag == "title":
                in_title = not m[1]
                continue
            if tag in _INLINE:
                if tag == "a":
                    anchor = 0 if m[1] else 1
                    if now is not None and not m[1]:
                        now.links += 1
                    elif not m[1]:
                        inline.append("a")
                elif tag in ("code", "samp", "kbd"):
                    sample += -1 if m[1] and sample else 0 if m[1] else 1
                elif not m[1] and now is None:
                    inline.append(tag)
                elif tag == "button" and now is not None and not m[1]:
                    now.text += " "
                continue
            now = None
            inline.clear()
            anchor = 0
            if m[1]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        for t, _, h in stack[i:]:
                            hidden -= h
                            sample -= t == "pre"
                            noscript -= t == "noscript"
                        del stack[i:]
                        break
            else:
                shut = _CLOSED_BY.get(tag)
                if shut and stack and stack[-1][0] in shut:
                    hidden -= stack[-1][2]
                    stack.pop()
                name, hides = tag_name(tag, m[3])
                if len(stack) >= DEEPEST:
                    _, _, h = stack.pop()
                    hidden -= h
                stack.append((tag, name, hides))
                hidden += hides
                sample += tag == "pre"
                noscript += tag == "noscript"
            names = tuple([s[1] for s in stack])
            continue
        piece = m[0]
        if piece == "\n":
            line += 1
            now = None
            inline.clear()
            continue
        if piece[:2] in ("<!", "<?"):
            line += piece.count("\n")
            continue
        if in_title:
            title.append(piece)
            continue
        if "&" in piece:
            piece = html_lib.unescape(piece)
        if now is None:
            if piece.isspace():
                continue
            if blocks and blocks[-1].line == line and blocks[-1].path[: len(names)] == names:
                now = blocks[-1]
                now.text += " "
            else:
                now = Block(line, names + tuple(inline), hidden=hidden > 0, noscript=noscript > 0)
                blocks.append(now)
            now.links += "a" in inline
            inline.clear()
        now.text += piece
        if anchor:
            now.linked += len(piece.strip())
        if sample > 0:
            now.sample.append(piece)
    for b in blocks:
        b.text = _SPACE.sub(" ", b.text).strip()
    return _SPACE.sub(" ", html_lib.unescape("".join(title))).strip(), [b for b in blocks if b.text]


# Byte classes for words: letters in lower case, digits as one, everything beyond ASCII as it is, all else 0.
_BYTE = np.zeros(256, np.uint64)
for _c in range(256):
    _BYTE[_c] = ord(chr(_c).lower()) if _c < 128 and chr(_c).isalpha() else 48 if 48 <= _c < 58 else _c if _c >= 128 else 0
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def _unspaced(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of bytes with the signs of East Asian scripts as breaks, and the places at which a new word begins.

    Each character of a script that is written without spaces (kana, Han, Thai, Lao, Burmese, Khmer) is a word.
    """
    opens = np.zeros(len(u), bool)
    lead = np.flatnonzero(u[: len(u) - 2] >= 0xE0)
    a, b, c = u[lead], u[lead + 1], u[lead + 2]
    sign = ((a == 0xE3) & (b == 0x80)) | ((a == 0xE2) & (b == 0x80)) | ((a == 0xEF) & (b == 0xBC) & ((c < 0x90) | ((c > 0x99) & (c < 0xA1)))) | (
        (a == 0xEF) & (b == 0xBD) & (c < 0xA6) & ((c > 0x9A) | (c < 0x81)))
    for k in range(3):
        v[lead[sign] + k] = 0
    alone = ~sign & (((a >= 0xE3) & (a <= 0xE9)) | ((a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)) | ((a == 0xE1) & ((b <= 0x82) | (b == 0x9E))))
    opens[lead[alone]] = True
    after = lead[alone] + 3
    opens[after[after < len(u)]] = True
    return v, opens


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts, and the text that it stands in. Digits are alike, case doesn't count.

    Scripts without spaces between words give a word for each character.
    """
    raw = "\n".join(texts).encode("utf-8", "replace")
    u = np.frombuffer(raw, np.uint8)
    if not len(u):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    v = _BYTE[u]
    opens = np.zeros(len(u), bool)
    if (u >= 0xE0).any():
        v, opens = _unspaced(u, v.copy())
    inside = v > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1] | opens[1:]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | opens[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(len(u))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * power, dtype=np.uint64)])
        h = (total[ends] - total[starts]) * inverse[starts]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    breaks = np.flatnonzero(u == 10)
    return h, np.searchsorted(breaks, starts)


NUMBERS = 18
_PARTING = re.compile(r"[,;|/•·#]")


@lru_cache(maxsize=50_000)
def path_buckets(path: tuple[str, ...]) -> tuple[int, ...]:
    """Buckets of all of a path's names with their depth from below, of the bare tags, and of the lowest pair; each once."""
    own = [f"{len(path) - i if len(path) - i < 3 else 3}>{name}" for i, name in enumerate(path)]
    own += [f"in {name.split('.')[0]}" for name in path] + ["+".join(p.split(".")[0] for p in path[-2:])]
    return tuple(crc32(x.encode()) % TAG_BUCKETS for x in dict.fromkeys(own))


def vectors(pages: list[tuple[str, list[Block]]]) -> np.ndarray:
    """A row per block of the pages in order: path buckets, word buckets, and some numbers."""
    blocks = [b for _, bs in pages for b in bs]
    out = np.zeros((len(blocks), TAG_BUCKETS + WORD_BUCKETS + NUMBERS), np.float32)
    if not blocks:
        return out
    h, at = word_hashes([b.text for b in blocks])
    words = np.bincount(at, minlength=len(blocks)).astype(np.float32)
    order = np.lexsort((h, at))
    again_word = order[1:][(h[order[1:]] == h[order[:-1]]) & (at[order[1:]] == at[order[:-1]])]
    repeated = np.bincount(at[again_word], minlength=len(blocks)) / np.maximum(words, 1)
    cell = at * WORD_BUCKETS + ((h >> np.uint64(33)) % np.uint64(WORD_BUCKETS)).astype(np.int64)
    bag = np.bincount(cell, minlength=len(blocks) * WORD_BUCKETS).reshape(len(blocks), WORD_BUCKETS)
    out[:, TAG_BUCKETS : TAG_BUCKETS + WORD_BUCKETS] = bag / np.sqrt(np.maximum(words, 1))[:, None]
    rows, cells = [], []
    numbers = []
    k = 0
    for title, bs in pages:
        heading = title.lower()
        n = len(bs)
        seen: dict[str, int] = {}
        for i, b in enumerate(bs):
            buckets = path_buckets(b.path)
            rows += [k] * len(buckets)
            cells += buckets
            t = b.text
            size = len(t)
            again = seen.get(t, 0)
            seen[t] = again + 1
            numbers.append((
                np.log1p(size), words[k], b.linked / size, b.links, t[-1] in ".!?。！？؟:", "©" in t, i / n, n,
                bool(heading) and (t.lower() == heading or heading.startswith(t.lower()) and size > 12), "|" in t or "›" in t, t[0].islower(), again > 0,
                t.endswith(")") and t[-2:-1].isdigit(), bs[i - 1].path == b.path if i else False,
                t.count("#") > 1, b.hidden, repeated[k], min(1.0, len(_PARTING.findall(t)) / max(words[k], 1)),
            ))
            k += 1
    np.add.at(out, (np.array(rows), np.array(cells)), 0.5)
    numbers = np.array(numbers, np.float32)
    numbers[:, 0] /= 5
    numbers[:, 1] = np.log1p(numbers[:, 1]) / 4
    numbers[:, 3] = np.minimum(numbers[:, 3], 8) / 4
    numbers[:, 7] = np.minimum(numbers[:, 7], 60) / 30
    out[:, -NUMBERS:] = numbers
    return out
