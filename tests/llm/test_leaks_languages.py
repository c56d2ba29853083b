import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import languages, leaks

RNG = random.Random(5)
SYL = "ba de fi gol mur nex pra tol ves wan zel kir".split()


def name():
    return "".join(RNG.choice(SYL) for _ in range(3)).capitalize()


def sentence(n=14):
    return " ".join(name() if i % 3 == 0 else RNG.choice("under the old bridge seven grey stones were counted before dawn by nobody".split()) for i in range(n)) + "."


SHARED = "Read the passage below with great care and answer the question in one full sentence of your own words."
ITEMS = [(i, f"{SHARED} {sentence(20)} {sentence(20)}") for i in range(40)] + [(90, None), (91, "")]
NOISE = "Some other text stands here for a while and says nothing of note. "


@pytest.fixture(scope="module")
def index():
    return leaks.ItemIndex(ITEMS)


def passage(i, a, b):
    return " ".join(ITEMS[i][1][len(SHARED) + 1 :].split()[a:b])


def ids(index, text):
    return {i for _, i in index.search([text])}


def test_leaks_found(index):
    for i in range(12):
        assert ids(index, NOISE + passage(i, 2, 22) + " " + NOISE) == {i}
        assert ids(index, passage(i, 0, 15)) == {i}


def test_spelling_does_not_count(index):
    p = passage(3, 0, 24)
    for text in (p.upper(), re.sub(r"\W+", "", p), p.replace(" ", "&nbsp;"), p.replace(" ", "\u200b \xa0"), "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in p),
                 " ".join(f"<b>{w}</b>" for w in p.split()), re.sub(r"(\w{4})(\w{3})", "\\1-\n\\2", p), p.translate(str.maketrans("aeo", "аео"))):
        assert ids(index, NOISE + text) == {3}, text[:40]


def test_altered_words(index):
    words = passage(5, 0, 32).split()
    few, many = list(words), list(words)
    few[9], few[20] = "changed", "altered"
    for k in range(1, 32, 3):
        many[k] = "different"
    assert ids(index, " ".join(few)) == {5} and ids(index, " ".join(many)) == set()
    assert ids(index, " ".join(words[:10] + words[11:])) == {5}


def test_altered_words_near_the_ends(index):
    for i in range(12):
        for at in range(1, 14):
            words = passage(i, 2, 17).split()
            words[at] = "different"
            assert ids(index, " ".join(words)) == {i} == ids(index, f"{NOISE}{' '.join(words)} {NOISE}"), (i, at)
    words = passage(5, 0, 24).split()
    for at in (1, 8, 22):
        words[at] = "altered"
    assert ids(index, " ".join(words)) == {5} and ids(index, " ".join(words[:8] + words[9:])) == {5}
    for at in range(1, 24, 5):
        words[at] = "another"
    assert ids(index, " ".join(words)) == set()


def test_chains_with_many_repeats():
    true, repeats = [(0, 100, 40), (50, 150, 40)], [(5 + k, 300 + 20 * k, 12) for k in range(8)]
    assert any(set(true) <= set(c) for c in leaks.ItemIndex._chains(sorted(true + repeats)))
    stray = (42, 120, 8)  # fits behind the first link, but is not on its way to the second
    assert any(set(true) <= set(c) for c in leaks.ItemIndex._chains(sorted([*true, stray, (52, 146, 9)])))


def test_no_leaks(index):
    assert ids(index, SHARED + " " + NOISE) == set()
    assert ids(index, passage(7, 0, 12)) == set()
    assert ids(index, NOISE * 200) == set()
    assert index.search([None, "", "   ", "x"]) == [] and leaks.ItemIndex([]).search(["text of some length"]) == []


def test_leaks_frame(spark):
    items = spark.createDataFrame([(i, t) for i, t in ITEMS], "item_id bigint, text string")
    rows = [(1, passage(1, 0, 30)), (1, passage(1, 0, 30)), (2, None), (3, NOISE * 3000 + passage(2, 0, 20))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    assert sorted(map(tuple, leaks.find_leaks(docs, "doc_id", "text", items).collect())) == [(1, 1), (3, 2)]
    assert leaks.find_leaks(docs.limit(0), "doc_id", "text", items).count() == 0
    assert leaks.find_leaks(docs, "doc_id", "text", items.limit(0)).count() == 0


KANJI = "春夏秋冬山川海空雨雪風月星花草木森林石火水土金銀銅鉄糸紙本机椅子窓門家村町市国道橋駅船車馬牛羊鳥魚虫"


def test_scripts_without_spaces():
    rng = random.Random(8)
    texts = ["".join(rng.choice(KANJI) for _ in range(60)) for _ in range(30)]
    index = leaks.ItemIndex(list(enumerate(texts)))
    other = "".join(rng.choice(KANJI) for _ in range(200))
    for i in range(8):
        assert ids(index, texts[i]) == {i} == ids(index, other + texts[i][10:42] + other)
        altered = list(texts[i][8:48])
        altered[13] = altered[27] = "龍"
        assert ids(index, other + "".join(altered)) == {i}
        assert ids(index, other + texts[i][10:32] + other) == set()


def test_exact_copies_among_many_items():
    rng = random.Random(9)
    words = ["".join(rng.choice("aeioubdfgklmnprstvz") for _ in range(rng.randrange(3, 9))) for _ in range(1500)]
    items = [(i, " ".join(rng.choice(words) for _ in range(45))) for i in range(4000)]
    index = leaks.ItemIndex(items)
    chosen = rng.sample(range(4000), 60)
    docs = [NOISE + " ".join(items[i][1].split()[20:38]) + " " + NOISE for i in chosen]
    assert sorted(index.search(docs)) == list(enumerate(chosen))


def test_items_in_parts(spark):
    items = spark.createDataFrame([(i, t) for i, t in ITEMS], "item_id bigint, text string")
    rows = [(k, NOISE + passage(k, 1, 22)) for k in range(40)] + [(50, SHARED), (51, None), (52, NOISE)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = sorted(map(tuple, leaks.find_leaks(docs, "doc_id", "text", items).collect()))
    parts = sorted(map(tuple, leaks.find_leaks(docs, "doc_id", "text", items, part_letters=5000).collect()))
    assert whole == parts == [(k, k) for k in range(40)]


def test_phrases_of_several_items_are_nobodys_own():
    """Shared phrases with an item's own names between them: a document that holds the phrases without the names leaks nothing."""
    rng = random.Random(12)
    phrases = ["in spite of the many errors", "for the visitors from the north", "until the end of the month", "the new index compares every entry", "during the night between two meetings"]
    items = [(i, " ".join(f"{rng.choice(phrases)} {name()}" for _ in range(8))) for i in range(40)]
    index = leaks.ItemIndex(items)
    for i in range(10):
        words = items[i][1].split()
        assert ids(index, " ".join(w for w in words if w.islower())) == set()
        assert ids(index, items[i][1]) == {i}


def test_least_scores_bound_real_passages(index):
    """Every passage of 15 words with one altered reaches the score that retrieval asks for."""
    for i in range(10):
        for at in (1, 7, 13):
            words = passage(i, 4, 19).split()
            words[at] = "different"
            z = leaks.plain(leaks.readable(NOISE + " ".join(words) + NOISE))
            place, term = index.lookup(leaks.grams(z))
            assert i in {index.ids[k] for k in index.retrieve(place // (leaks.PASSAGE // 2), term)[1]}


WORDS = {
    "en": "the old workshop keeps many short notes about the weather and every page with pictures which nobody has read before the end of the month".split(),
    "de": "die alte werkstatt speichert viele kurze notizen über das wetter und jede seite mit bildern die niemand vor dem ende des monats gelesen hat".split(),
    "fr": "le vieil atelier garde beaucoup de notes courtes sur la météo et toutes les pages avec des images que personne n a lues avant la fin du mois".split(),
    "ru": "старая мастерская хранит много коротких заметок о погоде и все страницы с картинками которые никто не читал до конца месяца".split(),
    "uk": "стара майстерня зберігає багато коротких нотаток про погоду і всі сторінки з малюнками які ніхто не читав до кінця місяця".split(),
}


def say(code, rng, n=12):
    return " ".join(rng.choice(WORDS[code]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def own():
    rng = random.Random(6)
    texts = [(c, " ".join(say(c, rng) for _ in range(6))) for c in WORDS for _ in range(30)]
    return languages.Profiles(texts + [("ar", "الكتاب القديم في المدينة " * 5), ("de", " ".join(say("en", rng) for _ in range(6)))])


def test_labels():
    assert [languages.code_of(x) for x in ("EN", "en-GB", "deu", "ger", "Ukrainian", "fr_FR", "", None, "xx", "unknown", "n/a")] == ["en", "en", "de", "de", "uk", "fr", None, None, None, None, None]


def test_held_out_accuracy(own):
    rng = random.Random(7)
    right = 0
    for code in WORDS:
        for _ in range(20):
            segs = languages.by_rank(*languages.segments_of([say(code, rng)], own), own)[0]
            right += max(segs, key=lambda s: s[2])[1] == code
            numbers = __import__("numpy").array([own.numbers[w] for w in say(code, rng, 40).split()])
            assert own.codes[int(own.distances(numbers, np.array([len(numbers)]))[0].argmin())] == code
    assert right >= 97


def test_distances_are_out_of_place_distances(own):
    rng = random.Random(17)
    texts = [say(rng.choice(list(WORDS)), rng, n).split() for n in (1, 7, 60, 400)] + [[]]
    numbers = [[own.numbers[w] for w in t] for t in texts]
    got = own.distances(np.array([i for x in numbers for i in x], int), np.array([len(x) for x in numbers]))
    for words, row in zip(texts, got):
        counts = {}
        for w in words:
            for g in languages.word_grams(w.lower()):
                if g in own.row:
                    counts[own.row[g]] = counts.get(own.row[g], 0) + 1
        order = sorted(counts, key=lambda g: (-counts[g], g))[: languages.TEXT_PROFILE]
        for k in range(len(own.codes)):
            away = []
            for g in order:
                rank = sum(n > counts[g] for n in counts.values())
                away.append(abs(own.ranks[g][k] - rank) if own.ranks[g][k] < languages.PROFILE else languages.PROFILE)
            assert row[k] == pytest.approx(sum(away) / len(away) if away else languages.PROFILE, rel=1e-4)


def test_segments_are_named_by_their_distance(own, monkeypatch):
    """A segment keeps neither the path's language nor its confidence where the distance says otherwise."""
    rng = random.Random(18)
    segments, num = languages.segments_of([say("en", rng)], own)
    wrong = [[(p, "de", n, w, best, 0.5, a, b) for p, _, n, w, best, _, a, b in segments[0]]]
    named = languages.by_rank(wrong, num, own)[0]
    assert [s[1] for s in named] == ["en"] * len(named) and all(s[5] != 0.5 for s in named)
    assert languages.by_rank([[]], num, own) == [[]]


def test_texts_that_the_path_takes_for_no_cases_are_judged_by_rank(own, monkeypatch):
    """Where the path agrees with a wrong label, or sees one language only, the ranks still decide."""
    rng = random.Random(19)
    cut = languages.segments_of

    def misled(texts, own):
        segments, num = cut(texts, own)
        return [[(s[0], "de", *s[2:]) for s in part] for part in segments], num

    monkeypatch.setattr(languages, "segments_of", misled)
    en, de, fr = (say(code, rng, 20) for code in ("en", "de", "fr"))
    got = languages.judged([en, f"{de}\n\n{fr}", de, None], ["de", "German", "de", "de"], own)
    assert got == [("en", {(0, "en")}), (got[1][0], {(0, "de"), (1, "fr")}), ("de", set()), (None, set())]


def test_short_sentences_need_confidence():
    """A borrowed phrase between quotes is about as near to several languages."""
    text = (0, "pl", 18, True, 250.0, 0.45, 0, 18)
    phrase = lambda n, sure: (0, "nl", n, True, 10.0 * n, sure, 18, 18 + n)
    assert languages.rows_of_text([text, phrase(3, 0.037)], "pl") == ("pl", set())
    assert languages.rows_of_text([text, phrase(3, 0.2)], "pl") == languages.rows_of_text([text, phrase(7, 0.03)], "pl") == ("pl", {(0, "pl"), (0, "nl")})


def test_borrowed_words_amid_a_paragraph():
    text = [(0, "en", 30, True, 400.0, 0.4, 0, 30), (1, "de", 20, True, 300.0, 0.4, 30, 50)]
    word = lambda p: (p, "de", 1, True, 18.0, 0.4, 50, 51)
    assert languages.rows_of_text([*text, word(0)], "en")[1] == {(0, "en"), (1, "de")}
    assert languages.rows_of_text([*text, word(2)], "en")[1] == {(0, "en"), (1, "de"), (2, "de")}  # a heading


def test_no_paragraph_with_a_change_is_left_out(own, monkeypatch):
    """A sentence of one long word, as in scripts without spaces, and the same segments as with a path through every paragraph."""
    rng = random.Random(21)
    assert {s[1] for s in languages.segments_of([say("en", rng) + " المدينة."], own)[0][0]} == {"en", "ar"}
    codes = [*WORDS, "en", "en"]
    texts = ["\n\n".join(" ".join(say(rng.choice(codes), rng, rng.choice((1, 2, 3, 12))) for _ in range(rng.randrange(1, 6))) for _ in range(4)) for _ in range(60)]
    some = languages.segments_of(texts, own)[0]
    monkeypatch.setattr(languages, "WORDS_AT_ONCE", 7)
    assert languages.segments_of(texts, own)[0] == some
    monkeypatch.setattr(languages, "may_change", lambda near, main, start, *_: np.arange(len(start)))
    assert languages.segments_of(texts, own)[0] == some


def test_distances_in_blocks(own, monkeypatch):
    rng = random.Random(20)
    texts = [say(rng.choice(list(WORDS)), rng, n).split() for n in (1, 300, 5, 0, 40, 900, 0)]
    numbers, sizes = np.array([own.numbers[w] for t in texts for w in t]), np.array([len(t) for t in texts])
    whole = own.distances(numbers, sizes)
    for block in (1, 500, 5000):
        monkeypatch.setattr(languages, "BLOCK", block)
        assert (own.distances(numbers, sizes) == whole).all()


def test_tokens_hold_the_words_and_sentences_of_the_text(own):
    long = "".join(chr(0x4E00 + i) for i in range(60))
    for text in ("One two。three four！？five… end\nline two. (x) a.b\r\nc", f"{long}。{long} and.\u3000more", "...!!! \n . a", " \t\x1c a.\x85b  c.", "\u201cHi.\u201d they said.  'No!'\tYes", ". . ."):
        spans, at = [], 0
        for m in languages._END.finditer(text):
            spans.append(languages._WORD.findall(text, at, at := m.end()))
        spans.append(languages._WORD.findall(text, at))
        tokens = [i for line in text.split("\n") for i in [*map(own.tokens.__getitem__, line.split()), 0]]
        got, names = [[]], list(own.numbers)
        for i in own.items_of(tokens)[0].tolist():
            if i < 0:
                got.append([])
            else:
                got[-1].append(names[i])
        assert [x for x in got if x] == [x for x in spans if x]


def test_cases(own):
    rng = random.Random(8)
    en, de = [say("en", rng) for _ in range(6)], [say("de", rng) for _ in range(6)]
    rows = lambda text, label: languages.judged([text], [label], own)[0][1]
    assert rows(" ".join(en), "English") == set() and rows(" ".join(en), "de") == {(0, "en")} and rows(" ".join(en), None) == {(0, "en")}
    assert rows("\n\n".join([en[0], "12 + 34 = 46", en[1]]), "xx") == {(0, "en"), (2, "en")}
    assert rows("\n\n".join([en[0] + " " + en[1], de[0]]), "en") == {(0, "en"), (1, "de")}
    assert rows(" ".join([en[0], en[1], de[0], de[1], en[2]]), "en") == {(0, "en"), (0, "de")}
    for nothing in (None, "", "  \n\n ", "1 2 3 == != 😀", "https://a.b/c?d=e"):
        assert rows(nothing, None) == set()


def test_language_frames(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(say(c, rng) for _ in range(8)), c) for i, c in enumerate([c for c in WORDS for _ in range(20)])]
    rows += [(900, rows[0][1], "fr"), (901, None, None), (902, "", "en"), (903, rows[0][1], None), (904, "x" * 100_000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("para_no", F.lit("clash"))
    assert sorted(map(tuple, languages.label_cases(docs, "doc_id", "text", "lang").collect())) == [(900, 0, "en"), (903, 0, "en")]
    by = {r.doc_id: r for r in languages.document_languages(docs, "doc_id", "text", "lang").collect()}
    assert by[901].lang is None and by[902].lang is None and by[25].lang == "de" and 0 < by[25].confidence < 1
    assert {r.lang for r in languages.segment_languages(docs, "doc_id", "text", "lang").where("doc_id = 900").collect()} == {"en"}
    assert languages.label_cases(docs.limit(0), "doc_id", "text", "lang").count() == 0
