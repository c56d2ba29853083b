import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import encoding

pytestmark = pytest.mark.skipif(not Path(encoding.VOCABULARY).exists(), reason="no vocabulary file")


@pytest.fixture(scope="module")
def own():
    return encoding.encoder(encoding.VOCABULARY)


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(str(Path(encoding.VOCABULARY).with_name("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return t


def lists(own, texts):
    flat, cuts = own.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(cuts, cuts[1:])]


PARTS = ["a", "B", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "　", "'s", "'S", "'ll", "1", "½", "٣", "é", "e\u0301", "中", "😀", "\u200b", "<|endoftext|>", "...", "_", "\0", "the", "Zelgrimir", "===="]


def test_against_public_library(own, public):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(4000)]
    assert lists(own, texts) == [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]


def test_long_pieces(own, public):
    rng = random.Random(2)
    texts = ["ab" * 3000, "".join(rng.choice("etaoin") for _ in range(20_000)), "x" * 5000, " " * 3000]
    assert lists(own, texts) == [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]


def test_round_trip(own):
    back = {i: t for t, i in own.ranks.items()}
    text = "Größe, naïve 東京 \n\n don't  stop 12345"
    assert b"".join(back[i] for i in lists(own, [text])[0]).decode() == text


def test_perfect_hash():
    h = np.random.default_rng(3).integers(0, 2**63, 20_000, dtype=np.uint64)
    f = encoding.PerfectHash(h)
    assert sorted(f(h).tolist()) == list(range(len(h)))
    with pytest.raises(ValueError):
        encoding.PerfectHash(np.array([1, 1], np.uint64))


def test_frames(spark):
    df = spark.createDataFrame([(1, "Hello"), (2, None), (3, ""), (1, "Hello")], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = sorted((r.doc_id, r.ids) for r in encoding.encode_texts(df, "doc_id", "text").collect())
    assert got[0] == got[1] and len(got[0][1]) == 1 and got[2] == (2, []) and got[3] == (3, [])
    assert encoding.encode_texts(df.limit(0), "doc_id", "text").count() == 0
