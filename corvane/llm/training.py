"""python -m corvane.llm.training HTML_OBJECTS: trains the block labeller and writes its weights beside the module.

No page comes with labels. The teacher below labels blocks by what the mark-up of a sample says outright: landmarks and
class names, copyright lines, notices, headings over link lists, comment sections. Where the mark-up says nothing (tag
names and classes are dropped from half of the pages, as is the wording from some), the network has to use context.
"""

from __future__ import annotations

import random
import re
import sys

import numpy as np

from corvane.llm.blocks import NUMBERS, TAG_BUCKETS, WORD_BUCKETS, Block, parse, vectors
from corvane.llm.labeller import BiLSTM
from corvane.llm.residue import asks_for_scripts
from corvane.llm.stuffing import ITEM_WORDS, LISTED_ITEMS

SAMPLE_PAGES = 12_000

LANDMARK = re.compile(
    r"^(nav|footer|aside|header|noscript|button|form|span)\b|c:(menu|nav|sidebar|bottom|footer|consent|cookie\w*|layer|banner|promo|ad|ads|c|comments?)$"
    r"|i:(catlinks|mw-navigation|nav|menu|footer|sidebar)$|^td\.c:l$"
)
NOTICE = re.compile(
    r"sign up for the letter|subscribe to|abonnez-vous|melden sie sich für|apúntese a|suscríbase|cookies|petits fichiers|small files|pequeños archivos"
    r"|kleine dateien|in your browser\.|in ihrem browser|en su navegador|dans votre navigateur",
    re.I,
)
LABELS = re.compile(r"[,;|/•·#]")
COUNTED = re.compile(r"\(\d+\)$")


def repeats_itself(text: str) -> bool:
    """Whether a short text says the same word or words over and over."""
    words = text.lower().split()
    return len(words) >= 4 and 2 * len(set(words)) <= len(words)


def is_list_of_labels(text: str) -> bool:
    """Whether a text is many short items parted by signs instead of sentences."""
    items = [x for x in LABELS.split(text) if x.strip()]
    return len(items) >= LISTED_ITEMS and len(text.split()) <= (ITEM_WORDS + 1) * len(items) and not re.search(r"[.!?。] ", text)


def teach(blocks: list[Block]) -> list[int]:
    """1 for main body, 0 for the rest."""
    out, comments, teasers = [], False, False
    for b in blocks:
        last = b.path[-1] if b.path else ""
        above = b.path[-2] if len(b.path) > 1 else ""
        listed = any(p == "ul" or p == "ol" for p in b.path)
        bold = last == "b" and above.startswith("p") and not b.linked and len(b.text) < 70
        heading = last.startswith("h3") or bold
        comments |= last.startswith("h3") and bool(COUNTED.search(b.text))
        main = 1
        if comments or any(LANDMARK.search(p) for p in b.path) or "©" in b.text or NOTICE.search(b.text):
            main = 0
        elif repeats_itself(b.text) or (last.split(".")[0] in ("p", "div", "td") and not b.linked and is_list_of_labels(b.text)):
            pass
        elif heading:
            teasers, main = True, 0
        elif b.linked > 0.55 * len(b.text) and last == "a" and not listed and not b.text.startswith("#"):
            main = 0
        elif teasers and b.linked and not listed and last == "a":
            main = 0
        elif last == "b" and above.startswith("div") and "msg" not in above:
            main = 0
        elif last.startswith("li") and not listed:
            main = 0
        if main and not b.linked:
            teasers = False
        out.append(main)
    plain = [i for i, b in enumerate(blocks) if out[i] and b.path and b.path[-1] == "div" and not b.hidden]
    other = any(out[i] and i not in plain and not (b.path and b.path[-1].startswith("h")) for i, b in enumerate(blocks))
    for i in plain:
        if is_list_of_labels(blocks[i].text) or repeats_itself(blocks[i].text):
            continue
        if other or not (i - 1 in plain or i + 1 in plain or (i and blocks[i - 1].path[-1:] == ("h1",))):
            out[i] = 0
    if not any(v and not (b.path and b.path[-1].startswith("h")) for v, b in zip(out, blocks)):
        for i, b in enumerate(blocks):  # nothing but a notice stands for the content
            if asks_for_scripts(b.text) >= 0.5 and not any(LANDMARK.search(p) for p in b.path):
                out[i] = 1
    return out


def as_tag_page(blocks: list[Block], labels: list[int], rng: random.Random) -> list[Block]:
    """The page with its main paragraphs replaced by lines of tag links, which stand in a main body far less often."""
    words = [w for b in blocks for w in re.findall(r"[^\W\d_]{3,}", b.text)] or ["tag"]
    out = []
    for b, main in zip(blocks, labels):
        if main and b.path and not b.path[-1].startswith("h"):
            parts = ["#" + rng.choice(words).lower() + rng.choice(["", "", str(rng.randrange(90))]) for _ in range(rng.randrange(2, 9))]
            b = Block(b.line, (*[p for p in b.path if p not in ("em", "a")], "a"), " ".join(parts), sum(map(len, parts)), len(parts))
        out.append(b)
    return out


def as_deep_page(blocks: list[Block], rng: random.Random) -> list[Block]:
    """The page with more levels of plain containers below its outermost tags, as real pages nest deeper than samples."""
    at, more = rng.randrange(1, 3), ("div",) * rng.randrange(1, 9)
    return [Block(b.line, b.path[:at] + more + b.path[at:], b.text, b.linked, b.links, b.sample, b.hidden, b.noscript) if len(b.path) > 1 else b for b in blocks]


def examples(bodies: list[str], seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, labels) of each page; some with the path or the words blanked."""
    rng, out = random.Random(seed), []
    for html in bodies:
        title, blocks = parse(html)
        if not blocks:
            continue
        labels = teach(blocks)
        x, y = vectors([(title, blocks)]), np.array(labels, np.float32)
        out.append((x, y))
        if rng.random() < 0.06 and sum(labels) > 1:
            out.append((vectors([(title, as_tag_page(blocks, labels, rng))]), y))
        if rng.random() < 0.15:
            out.append((vectors([(title, as_deep_page(blocks, rng))]), y))
        kind = rng.random()
        if kind < 0.25:
            blind = x.copy()
            blind[:, :TAG_BUCKETS] *= np.array([rng.random() > 0.4 for _ in range(TAG_BUCKETS)], np.float32)
            out.append((blind, y))
        elif kind < 0.35:
            blind = x.copy()
            blind[:, TAG_BUCKETS : TAG_BUCKETS + WORD_BUCKETS] *= np.array([rng.random() > 0.4 for _ in range(WORD_BUCKETS)], np.float32)
            out.append((blind, y))
    return out


def main(path: str) -> None:
    import pyarrow.parquet as pq

    table = pq.read_table(path, columns=["html"]).column("html").to_pylist()
    bodies = sorted(set(x for x in table if x))
    random.Random(1).shuffle(bodies)
    bodies = bodies[:SAMPLE_PAGES]
    cut = len(bodies) // 10
    train, held = examples(bodies[cut:]), [(x, y) for x, y in examples(bodies[:cut])]
    model = BiLSTM.fresh(TAG_BUCKETS + WORD_BUCKETS + NUMBERS)
    model.fit(train, say=lambda s: print(s, flush=True))
    x, y = np.concatenate([p[0] for p in held]), np.concatenate([p[1] for p in held])
    p = model.predict(x, np.array([len(q[1]) for q in held]))
    print(f"held-out blocks {len(y)}, wrong {np.mean((p > 0.5) != (y > 0.5)):.4f}")
    model.save()


if __name__ == "__main__":
    main(sys.argv[1])
