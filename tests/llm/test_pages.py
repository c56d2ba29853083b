import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import pages as P
from corvane.llm import residue, stuffing
from corvane.llm.blocks import parse, vectors, word_hashes
from corvane.llm.labeller import BiLSTM

ARTICLE = "".join(f"<p>In {1900 + i} the old quarry was opened by walkers from Torvik, and the river kept its course until the spring came back to the valley.</p>\n" for i in range(5))


def page(main, title="How the quarry repairs the bakery", head=True):
    h1 = f"<h1>{title}</h1>\n" if head else ""
    return f"""<!DOCTYPE html>
<html>
<head><meta charset="utf-8"><title>{title}</title></head>
<body>
<nav>
<li><a href="/home">Home</a></li>
<li><a href="/press">Press</a></li>
</nav>
<main><article>
{h1}{main}</article></main>
<aside>
<h3>You might also like</h3>
<li><a href="https://x.test/1">The day the loom feeds our garden</a> Another text.</li>
</aside>
<footer>
<p><a href="/contact">Contact</a> <a href="/shop">Shop</a> © 2017 Torvik Notes. All rights reserved.</p>
</footer>
</body>
</html>"""


def test_parse():
    title, blocks = parse("<title>T &amp; x</title><body>\n<p>a <b>b</b> <a href=x>c</a>\n<li>one<li>two\n</div><p style='display: none'>hid</p><pre>{{x}}</pre>\n<script>\nvar a;\n</script><p>last")
    assert title == "T & x" and [(b.line, b.text) for b in blocks] == [(1, "a b c"), (2, "one two"), (3, "hid"), (3, "{{x}}"), (6, "last")]
    assert blocks[0].linked == 1 and blocks[2].hidden and blocks[3].sample == ["{{x}}"]
    assert [(b.line, b.text) for b in parse('<p>a\nb</p><p\nclass="x">c\n\n<!-- \n -->d')[1]] == [(0, "a"), (1, "b"), (2, "c"), (5, "d")]
    assert parse(None) == ("", []) and parse("") == ("", []) and parse("<<<>>>")[0] == ""
    assert len(parse("<p>" + "long " * 100_000)[1]) == 1


def test_word_hashes():
    h, at = word_hashes(["Red blue", "", "blue, RED 12 34"])
    assert at.tolist() == [0, 0, 2, 2, 2, 2] and h[0] == h[3] and h[1] == h[2] and h[4] == h[5]
    assert len(word_hashes([])[0]) == 0


def test_gradients():
    rng = np.random.default_rng(1)
    model, lengths = BiLSTM.fresh(5, 3), np.array([4, 1, 3])
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, y = rng.normal(size=(8, 5)), (rng.random(8) > 0.5).astype(float)
    _, grad = model.gradients(x, lengths, y)
    for k, w in model.w.items():
        at = np.unravel_index(rng.integers(w.size), w.shape)
        old = w[at]
        w[at] = old + 1e-3
        up = model.gradients(x, lengths, y)[0]
        w[at] = old - 1e-3
        down = model.gradients(x, lengths, y)[0]
        w[at] = old
        assert grad[k][at] == pytest.approx((up - down) / 2e-3, abs=2e-4), k


def test_context_is_document_wide():
    rng = np.random.default_rng(2)
    seqs = []
    for _ in range(400):  # the label is whether the sequence's last row is marked: only the way back can tell
        n = rng.integers(2, 9)
        x = np.zeros((n, 2), np.float32)
        x[:, 0] = rng.normal(size=n)
        x[-1, 1] = rng.integers(2)
        seqs.append((x, np.full(n, x[-1, 1], np.float32)))
    model = BiLSTM.fresh(2, 8).fit(seqs[:300], epochs=20, batch=20, rate=0.02)
    x, y = np.concatenate([s[0] for s in seqs[300:]]), np.concatenate([s[1] for s in seqs[300:]])
    assert ((model.predict(x, np.array([len(s[1]) for s in seqs[300:]])) > 0.5) == y).mean() > 0.98


def test_batches_do_not_matter():
    parsed = [parse(page(ARTICLE)), parse(page("<p>short</p>\n")), parse(None)]
    together = P.main_blocks(parsed)
    assert together == [P.main_blocks([p])[0] for p in parsed] and vectors([]).shape[0] == 0


def flag(html):
    parsed = parse(html)
    return residue.is_residue(*parsed, P.main_blocks([parsed])[0])


def test_residue():
    assert not flag(page(ARTICLE)) and not flag(page(ARTICLE + "<noscript>Please enable JavaScript to view this page.</noscript>\n"))
    for main in ("<p>{{ page.title }}</p>\n", ARTICLE + "<p>Then ${user.name} came.</p>\n", "<p>404 Not Found</p>\n<p>The requested item could not be located.</p>\n",
                 ARTICLE + "<p>Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor.</p>\n", "<p>Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.</p>\n",
                 "<p>Accès refusé. Vous n'avez pas les droits pour voir cette page.</p>\n", "<p>null</p>\n"):
        assert flag(page(main)), main
    for title in ("__meta_title__", "undefined | Torvik Notes", "%marsh.label% - Torvik", "{seo_h1} - Torvik", "Page title", "Sorry, the page cannot be shown right no", "__loom.name__"):
        assert flag(page(ARTICLE, title)), title
    for title in ("How the shell reads null values", "An undefined place | Torvik Notes", "Sorry seems to be the hardest word to say in the valley"):
        assert not flag(page(ARTICLE, title)), title
    long = "a" * 300
    assert flag(page(ARTICLE + f"<p>{{{{ {long} }}}}</p>\n")) and not flag(page(ARTICLE + f"<p>He wrote “{'so ' * 150} {{{{ title }}}} and so on” to them.</p>\n"))
    assert flag(page('<div id="root">Please switch on scripts in your browser.</div>\n')) and flag(page("<p>First allow JavaScript to see Torvik.</p>\n"))
    for main in ("<p>Write the field between braces:</p>\n<pre>{{ title }}</pre>\n", "<p>The shell replaces <code>${HOME}</code> before it reads the line.</p>\n",
                 "<p>A server answers “404 not found” when an address is missing, and the crawler writes that down.</p>\n"):
        assert not flag(page(ARTICLE + main)), main
    assert residue.kinds_of("") == {} and not residue.is_residue("", [], [])


def test_residue_with_capital_dotted_i():
    assert [chr(c) for c in range(0x110000) if len(residue.fold(chr(c))) != 1] == []
    assert residue.kinds_of("İzniniz yok")["e"] == 1 and residue.kinds_of("İstediğiniz sayfa bulunamadı")["e"] >= residue.BLOCK_COVERAGE
    assert flag(page("<p>İstediğiniz sayfa bulunamadı.</p>\n", "İzniniz yok")) and not flag(page(ARTICLE + "<p>İstanbul eski bir şehirdir.</p>\n"))


def test_early_exit_changes_nothing():
    texts = ["Parse error: syntax error, unexpected end of file", "PHP Parse error: unexpected token", "Warning: unexpected value in line 3", "Uncaught ValueException", "Uncaught TypeError",
             "Fatal error: an exception", "SQLSTATE[42]", "Traceback (most recent", "Exception in thread main", "ORDER_NO", "Your number is ORDER_NO today", "Dear NAME", "{{ a }}", "{{{ a }}}", "${a}", "#{a}", "<%= a %>",
             "[% a %]", "[[a b]]", "@@abc@@", "??a.b??", "%name_x%", "__abc__", "{abc_d}", "i18n:a.b", "t('a.b')", "MISSING_A", "%s", "%d", "%2$s", "[object Object]", "page.main.label", "a_b.c.caption",
             "null", "undefined", "NaN", "None", "nil", "ut labore et dolore magna aliqua", "in ea sit non est sed", 'ut labore et dolore magna "words of another kind stand here"']
    for text in texts:
        full = residue._kinds_in_full(text)
        assert full and residue.kinds_of(text) == full and residue.touched("", parse(f"<p>{text.replace('<', '&lt;')}</p>")[1]), text
    assert residue.kinds_of("notxfound", ["x"]) == residue._kinds_in_full("notxfound", ["x"]) and residue.kinds_of("A plain sentence.") == {}


WORDS = "quarry bridge candle river orchard letter ferry museum winter garden engine marble harbour violin lantern tunnel pepper saddle copper meadow".split()
RUNNING = [f"<p>The {a} near the old {b} was opened in spring, and nobody who saw it asked why the {b} should keep its {a} so long.</p>\n" for a in WORDS for b in WORDS if a < b]
KEYWORDS = "cheap oak table best oak table buy oak table online oak table price " * 12


def corpus(*more):
    pages = [page("".join(RUNNING[i : i + 6])) for i in range(0, len(RUNNING), 6)] + [page(x) for x in more]
    return [b.text for html in pages for b, m in zip(parse(html)[1], P.main_blocks([parse(html)])[0]) if m]


def stuffed(html, own):
    parsed = parse(html)
    return P.stuffed_flags([P.parts_of(parsed[1], P.main_blocks([parsed])[0])], own)[0]


def test_stuffing():
    own = stuffing.Counts.of(corpus(f"<p>{KEYWORDS}</p>\n"))
    assert not stuffed(page(ARTICLE), own) and not any(stuffed(page("".join(RUNNING[i : i + 4])), own) for i in range(0, 40, 4))
    assert stuffed(page(f"<p>{KEYWORDS}</p>\n"), own) and stuffed(page(f'<p>One sentence stands here for show.</p>\n<div style="display:none">{KEYWORDS}</div>\n'), own)
    assert stuffed(page("".join("<p>" + " ".join(f'<a href="http://s{i}.test/x-{j}">#tag{j}</a>' for j in range(6)) + "</p>\n" for i in range(5))), own)
    assert stuffed(page('<a href="/x">oak table oak table oak table oak table</a>\n' * 5), own)
    assert not stuffed(page(ARTICLE + "<ul>\n" + "<li>12 oak tables</li>\n" * 8 + "</ul>\n"), own)
    subject = "".join(f"<p>The oak table of room {i} was {x}, as the oak table beside the {x} window had always been when {y} came to see it.</p>\n" for i, (x, y) in enumerate(zip(WORDS, WORDS[5:])))
    assert not stuffed(page(subject), own)
    assert stuffing.stuffed_shares([], own).tolist() == [] and stuffing.stuffed_shares([[]], own).tolist() == [0]


def test_sentence_shaped_stuffing_and_unspaced_scripts():
    own = stuffing.Counts.of(corpus())
    assert stuffed(page("<p>" + "Buy cheap oak table best oak chair price. " * 15 + "</p>\n"), own)
    assert stuffed(page("<p>" + "激安オークテーブル通販、最安オークテーブル、オークテーブル価格。" * 8 + "</p>\n"), own)
    assert not stuffed(page("<p>博物館は来週のあいだに渡し船の時刻表を比べています。古い工房は早朝から短いメモをたくさん公開しています。港の会は月末まで天気の報告を読んでいます。</p>\n"), own)


def test_salad_needs_the_pmi(monkeypatch):
    rng = np.random.default_rng(4)
    own = stuffing.Counts.of(corpus())
    every = "the near old was opened in spring and nobody who saw it asked why should keep its so long".split() + WORDS
    salads = ["<p>" + " ".join(rng.choice(every, 60)) + "</p>\n", "<p>" + " ".join(" ".join(rng.choice(every, 9)).capitalize() + "." for _ in range(8)) + "</p>\n"]
    assert all(stuffed(page(s), own) for s in salads)
    mean, pairs = stuffing.coherence(*stuffing.word_hashes([" ".join(rng.choice(WORDS, 60)), RUNNING[3][3:-5]]), np.zeros(2, int), 2, own)
    assert mean[0] < stuffing.SALAD < 0 < mean[1] and pairs[0] == 59  # unseen pairs lower the mean
    monkeypatch.setattr(stuffing, "SALAD", -2.0)  # the PMI test off
    assert not any(stuffed(page(s), own) for s in salads)


def test_a_page_does_not_vouch_for_itself():
    salad = " ".join(np.random.default_rng(5).choice(WORDS, 60))
    own = stuffing.Counts.of(corpus(f"<p>{salad}</p>\n"))
    h, at = stuffing.word_hashes([salad])
    assert stuffing.coherence(h, at, np.zeros(1, int), 1, own)[0][0] < stuffing.SALAD


def test_short_items_that_repeat_a_third_of_their_words():
    own = stuffing.Counts.of([])

    def share(text):
        return stuffing.stuffed_shares([[stuffing.Part(text, 0, "p")]], own)[0]

    labels = "amber bolt, brass hinge, cedar bolt, dusk lamp, elm bolt, fern hinge, glass vase, hazel hinge, iron bolt"
    words = labels.replace(",", "").split()
    repeated = sum(words.count(w) >= stuffing.REPEATED for w in words) / len(words)
    assert 0.3 <= repeated < 0.5 and share(labels) == 1
    assert share(labels.replace("bolt, dusk", "clasp, dusk").replace("fern hinge", "fern knob")) == 0


def test_frames(spark):
    rows = [(1, page(ARTICLE)), (2, page("<p>[[title]]</p>\n")), (3, page(f"<p>{KEYWORDS}</p>\n")), (4, None), (5, ""), (6, "<p>")]
    bodies = spark.createDataFrame(rows, "id bigint, html string").withColumn("page_id", F.lit("clash"))
    mains = P.main_bodies(bodies)
    counts = stuffing.corpus_counts(mains, "texts")
    lines = sorted((r.page_id, r.line_no) for r in P.main_lines(mains, counts).collect())
    assert lines == [(1, n) for n in range(9, 15)]
    assert [r.page_id for r in P.residue_pages(bodies).collect()] == [2]
    assert [r.page_id for r in P.stuffed_pages(mains, counts).collect()] == [3]
    texts = {r.page_id: r.text for r in P.main_texts(bodies).collect()}
    assert texts[1].startswith("How the quarry") and "Contact" not in texts[1] and texts[4] == ""
    none = P.main_bodies(bodies.limit(0))
    assert P.main_lines(none, stuffing.corpus_counts(none, "texts")).count() == 0


def test_counts_are_exact_sums(spark):
    rows = [(i, RUNNING[i : i + 3] + [None, ""]) for i in range(40)]
    frame = spark.createDataFrame(rows, "id bigint, texts array<string>").repartition(5)
    counts, whole = stuffing.corpus_counts(frame, "texts"), stuffing.Counts.of([t for _, ts in rows for t in ts if t])
    for mine, theirs in ((counts.words, whole.words), (counts.pairs, whole.pairs)):
        kept = theirs.counts >= stuffing.LEAST_COUNT
        assert mine.total == theirs.total and (mine.keys == theirs.keys[kept]).all() and (mine.counts == theirs.counts[kept]).all()


def test_landmarks_far_above_are_seen():
    levels = 9
    deep = page(ARTICLE).replace("<nav>\n", "<nav>\n" + "<div>" * levels + "<ul>\n").replace("</nav>", "</ul>" + "</div>" * levels + "</nav>")
    parsed = parse(deep)
    assert max(len(b.path) for b in parsed[1]) > levels and [b.text for b, m in zip(parsed[1], P.main_blocks([parsed])[0]) if m and "link" not in b.text][0].startswith("How the quarry")
    assert not any(m for b, m in zip(parsed[1], P.main_blocks([parsed])[0]) if "nav" in b.path)
    bottomless = parse("<div>" * 3000 + "text" + "</div>" * 3000)[1]
    assert [b.text for b in bottomless] == ["text"] and len(bottomless[0].path) == 512


def test_words_of_unspaced_scripts():
    h, at = word_hashes(["冬の新しい、レシピ。 abc", "ไทย x", "日"])
    assert at.tolist() == [0] * 9 + [1] * 4 + [2]
