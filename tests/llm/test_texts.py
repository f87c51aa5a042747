"""Operators 4, 5, 7 and 8: brute force, planted cases, held-out accuracy, and rows that are out of the ordinary."""

from __future__ import annotations

import html as markup
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairmine.llm import decontam, html, langid, quality, queries

FOLDER = "/root/testdata/sf0.01"


def test_pages_of_the_table(spark):
    """The template of the table is known: the article is what stands between its tags."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.op4_extract_main_text(spark, FOLDER).collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        inner = re.search(r"<article>(.*)</article>", page.html, re.DOTALL).group(1)
        inner = re.sub(r"</?(?:p|h1|br|ul|li)>", " ", inner)
        want = " ".join(markup.unescape(re.sub(r"<[^>]*>", "", inner)).split())
        assert got[i].text == want and got[i].n_chars == len(want) and got[i].url == page.url


CASES = {
    "": "",
    "plain words, no markup": "plain words, no markup",
    "<p>One, two.<p>Three &amp; four&nbsp;five &#233;": "One, two. Three & four five é",
    "<body><div class='menu'><a href=x>Home</a></div><div id=content><h2>T</h2><p>Some text, with a <b>bo</b>ld word.</p>"
    "<p>More text, and <a href=y>a link</a> here.</p></div><div class='comments'><p>First comment, long enough.</p></div>"
    "<div class='cookie-notice'>We use cookies.</div></body>": "T Some text, with a bold word. More text, and a link here.",
    "<main><aside>Side</aside><p>Body text, here.</p><form><p>Name</p></form><script>if (a<b) x('</p>')</script></main>"
    "<footer>Foot</footer>": "Body text, here.",
    "<article><header><h1>Head</h1></header><section><p>A, b.</p></section><section><p>C, d.</p></section></article>"
    "<header>Site</header>": "Head A, b. C, d.",
    "<article><p>x\n  y<br>z</p><ul><li>one<li>two</ul><p hidden>no</p></article>": "x y z one two",
    "<nav>only a menu</nav>": "",
    "<div><p>unclosed <i>tags <div>next": "unclosed tags next",
    "a < b and c > d, 1<2": "a < b and c > d, 1<2",
    "<!-- x --><!DOCTYPE html><p title='a>b'>quoted, fine.</p>": "quoted, fine.",
}


@pytest.mark.parametrize("page", list(CASES))
def test_pages(page):
    assert html.main_text(page) == CASES[page]


LONG = " ".join(["Much more text, and more, in the body."] * 30)
BODY = "<p>Much more text, and more, in the body.</p>" * 30
TEMPLATES = {
    f"<div id=page><h1>Title</h1><div class=lead><p>A lead, of one line or so, stands first.</p></div><div class=body>{BODY}</div></div>": f"Title A lead, of one line or so, stands first. {LONG}",
    f"<div><p>One line before, and so on.</p><blockquote>{BODY}</blockquote><p>One line after, and so on.</p></div>": f"One line before, and so on. {LONG} One line after, and so on.",
    f"<div class='menu'><a href=x>Home</a></div><div class='site has-sidebar'><p>{LONG}</p><div class=sidebar>Side</div></div>": LONG,
    f"<div id='main search-results'><h1>Found</h1><p>{LONG}</p></div><div class=footer>Foot</div>": f"Found {LONG}",
    "<div class='post tags-x'><p>Short, but the page.</p></div>": "Short, but the page.",
    f"<div><p>An article, of some words only.</p><p>And more, at its end.</p></div><div class=comments><p>{LONG[:160]}</p></div>": "An article, of some words only. And more, at its end.",
}


@pytest.mark.parametrize("page", list(TEMPLATES))
def test_pages_of_divs(page):
    assert html.main_text(page) == TEMPLATES[page]


NESTED = {
    "unclosed": "<b>x", "without an end": "<a ", "only elements": "<div>", "wrong ends": "<div></x></b>", "headings": "<b><h1>y",
    "items": "<i><li>y", "comments": "<!--", "data": "<![CDATA[", "quotes": "<a x=\"'", "odd quotes": "<a \"x\" '<b' ", "signs": "<",
}


@pytest.mark.parametrize("name", list(NESTED))
@pytest.mark.parametrize("end", ["", ">", '">"'])
def test_a_long_page_takes_time_like_its_length(name, end):
    def seconds(size):
        page = NESTED[name] * (size // len(NESTED[name])) + end
        started = time.process_time()
        html.main_text(page)
        return time.process_time() - started

    seconds(10_000)
    half, whole = seconds(250_000), seconds(1_000_000)
    assert whole < 10 and whole < 12 * half + 0.5, (half, whole)  # 16 times if it grew with the square


def test_tags_and_quotes_without_an_end():
    assert html.main_text("<p>One, two.</p><p>Three <a href='x") == "One, two. Three <a href='x"
    assert html.main_text("<p>One, <a title=\"x>two</a>.</p><p>Three.</p>") == "One, two. Three."
    assert html.main_text("<p>One <![CDATA[ a > b ]]>two <![CDATA[ <b>three</b></p>") == "One two three"


def test_odd_pages(spark):
    rows = [(1, None, None, "x"), (None, "u", "", "x"), (2, "u", "<p>a b</p>", "x"), (2, "u", "<p>a b</p>", "x"), (3, "u", "<p>" + "w " * 200000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html.extract(pages).collect()), key=repr)
    assert [(g[0], g[3]) for g in got] == [(1, 0), (2, 3), (2, 3), (3, 399999), (None, 0)]
    assert html.extract(pages.limit(0)).count() == 0


def plain_leaks(docs, items):
    """Any run of 13 template tokens (or the whole item) that a document has in common with an item."""
    forms = lambda t: [decontam.PLACEHOLDERS[k] or p for p, k in zip(*[decontam.canonical(t or "")[i] for i in (0, 2)], strict=True)]
    texts = {i: " ".join(["", *forms(t), ""]) for i, t in docs}
    found = set()
    for item, text in items:
        own = forms(text)
        size = min(decontam.RUN_WORDS, len(own))
        runs = {" ".join(["", *own[i : i + size], ""]) for i in range(len(own) - size + 1)} if own else set()
        found |= {(i, item) for i, t in texts.items() if any(r in t for r in runs)}
    return found


def test_leaks_of_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in queries.op5_decontaminate(spark, FOLDER).collect()}
    assert got == plain_leaks(docs, items)
    assert got == {(i, item) for item, x in items for i, t in docs if x in (t or "")}


QUESTION = "Yesterday morning Anna bought 12 kg of apples and gave 5 kg to Bob, so how many kg of apples does Anna have left?"


def test_leaks_with_other_values(spark):
    docs = [
        (1, "Some words before. yesterday morning Carl bought 30 lb of apples and gave 7 lb to Dora, so how many lb of apples does Carl have left? And more."),
        (2, "yesterday morning Carl bought 30 lb of apples and gave 30 lb to Dora, how few"),
        (3, "a text about apples and pears that has nothing to do with it and is long enough to have windows"),
        (4, QUESTION.upper()),
        (5, None),
        (5, "  "),
        (None, "So. " + QUESTION),
        (6, QUESTION + " " + "word " * 50000),
        (6, QUESTION + " " + "word " * 50000),
    ]
    items = [(1, QUESTION), (1, QUESTION), (2, None), (3, "!!"), (4, "four plain words only"), (None, "")]
    docs = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, mark string, size int")
    benchmark = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, hash string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, benchmark).collect()}
    assert got >= {(1, 1), (None, 1), (6, 1)} and not {i for i, _ in got} & {3, 5}
    kept = decontam.remove_leaks(docs, benchmark)
    assert kept.columns == docs.columns
    assert {3, 5} <= {r.doc_id for r in kept.collect()} and not {1, 6, None} & {r.doc_id for r in kept.collect()}
    assert decontam.find_leaks(docs.limit(0), benchmark).count() == 0
    assert decontam.find_leaks(docs, benchmark.limit(0)).count() == 0
    assert decontam.remove_leaks(docs, benchmark.limit(0)).count() == docs.count()


def test_leaks_in_other_case_and_without_literals(spark):
    names, sums, title = "Anna Bob Carl Dora Emil Frida", "12 + 7 = 19", "The Old Man And His Three Red Boats Went Out Once More Before Dawn Came"
    items = [(1, QUESTION), (2, names), (3, sums), (4, title), (5, "!!")]
    texts = [QUESTION.upper(), QUESTION.lower(), f"we saw {names} there", f"as told, {sums}, no more", "so: " + title.swapcase(), QUESTION, "12 and 7 make 19"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_leaks(docs, benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(0, 1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 1)]
    words = len(QUESTION.split())
    assert [(r.matched, r.windows, r.run_words) for r in got if r.doc_id == 0] == [(words - 12, words - 12, words)]
    assert [r.doc_id for r in decontam.remove_leaks(docs, benchmark).collect()] == [6]


def test_items_of_one_or_two_words(spark):
    items = [(1, "Paris"), (2, "a day"), (3, "the old mill")]
    texts = ["what a day it was for the paris people", "PARIS!", "A day.", "at the old mill we met", "paris paris"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontam.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (2, 2), (3, 3)]


def test_words_of_many_texts_at_once():
    """A text's tokens do not depend on the texts beside it."""
    texts = ["Two kg. Of Bob", "", "kg of 5", "kg 12 kg\nAnna met Anna\x0b Carl!", " \n ", "...", "5", "miles to Go", "é Éa 7 °"]
    both = decontam.Canonical(pa.array(texts))
    for k, text in enumerate(texts):
        plain, tokens, kinds, bare = decontam.canonical(text)
        own = slice(both.begin[k], both.begin[k + 1])
        assert both.plain(own.start, own.stop) == plain and both.kinds[own].tolist() == kinds.tolist()
        assert both.tokens[own].tolist() == tokens.tolist() and both.bare[own].tolist() == bare.tolist()
    assert decontam.canonical(texts[3])[2].tolist() == [0, 1, 3, 0, 0, 2, 2]


def test_slots_must_be_consistent(spark):
    item = "The number 4 goes to x and the number 4 goes to y and the number 4 goes to z at the very end"
    same = item.replace("4", "9").lower()
    mixed = "the number 1 goes to x and the number 2 goes to y and the number 3 goes to z at the very end"
    docs = spark.createDataFrame([(1, same), (2, mixed)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.doc_id for r in decontam.find_leaks(docs, benchmark).collect()] == [1]


def test_language_of_held_out_documents(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op7_language_id(spark, FOLDER).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(langs) and len(held) > 100
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) <= 2


def test_language_of_odd_documents(spark):
    rows = [("the cat and the dog " * 3, "en"), ("the house of the man", "en"), ("le chat et le chien", "fr"), ("une maison et la rue", "fr"), (None, "en"), ("x", None), ("12 34", "en")]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    assert set(model.languages) == {"en", "fr"}
    texts = ["the dog of the house", "et la maison", None, "", "12 + 3 !", "the " * 300000, "漢字だけの文章" * 30, "the dog of the house"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, langid_text2 string")
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert [got[i].langid_pred for i in range(6)] == ["en", "fr", "und", "und", "und", "en"]
    assert got[7].langid_score == got[0].langid_score and got[6].langid_rejected and got[2].langid_rejected
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and {0, 1, 7} <= {r.doc_id for r in kept.collect()} and 4 not in {r.doc_id for r in kept.collect()}
    assert langid.predict(docs.limit(0), model).count() == 0
    nothing = langid.train(spark.createDataFrame([], "text string, lang string"))
    assert {r.langid_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_language_of_few_texts_with_many_copies(spark):
    few = [f"le chat numéro {w} dort dans la maison près de la rivière" for w in ("un", "deux", "trois", "quatre", "cinq")]
    many = [f"the {w} dog sleeps in the house near the river" for w in ("old", "big", "red", "sad", "shy", "odd", "new", "wet")]
    rows = [(t, "fr") for t in few] * 2000 + [(t, "en") for t in many] * 50
    labelled = spark.createDataFrame(rows, "text string, lang string").repartition(8)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(langid, "CENTROIDS", 8)  # as many centroids as distinct texts are fitted on, if there are fewer
        model = langid.train(labelled, per_language=6)
    assert [model.languages.count(x) for x in ("fr", "en")] == [5, 6]
    seen = [(few[0], "fr"), ("la maison du chat est dans la rue", "fr"), (many[0], "en")]
    told = langid.predict(spark.createDataFrame(seen, "text string, want string"), model).collect()
    assert all(r.langid_pred == r.want for r in told)
    assert not any(r.langid_rejected for r in told if r.text in few + many)


def test_long_pieces_are_read_whole(monkeypatch):
    text = "Some words, and more; " * 50
    want = langid.counts(text)
    monkeypatch.setattr(langid, "_PIECE", 400)
    # Pieces start and end with a blank of their own; what lies inside is counted alike.
    assert abs(langid.counts(text) - want).sum() < 0.05 * want.sum()


def test_quality_of_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = queries.op8_quality_rules(spark, FOLDER).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_quality_rules_as_columns(spark):
    rules = quality.Rules(0.5, (((("upper", False, 0.5),), -3.0), ((("upper", True, 0.5), ("digits", False, 0.1)), 1.0)))
    docs = spark.createDataFrame([(1, "ABC"), (2, "ab 12"), (3, "abc"), (4, None), (4, ""), (5, "x " * 300000)], "doc_id long, text string")
    got = sorted((r.doc_id, round(r.score, 6)) for r in quality.statistics(docs).select("doc_id", quality.score(rules).alias("score")).collect())
    want = lambda x: round(1 / (1 + 2.718281828459045 ** -x), 6)
    assert got == [(1, want(-2.5)), (2, want(1.5)), (3, want(0.5)), (4, want(0.5)), (4, want(0.5)), (5, want(0.5))]


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "z"), (None, None, "z")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in quality.rate(docs, labels).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1), (1, 1), (2, None)], "doc_id long, label int")
    assert all(r.score > 0.99 for r in quality.rate(docs, ones).collect())
    assert quality.rate(docs.limit(0), labels).count() == 0
    assert quality.rate(docs.filter(F.col("doc_id") > 5), ones).count() == 0
