import html as entities
import random
import re
import time

import duckdb
import numpy as np
import pytest
from gaugeworks.llm import html_text, top_k, url_filter

SMALL = "/root/testdata/sf0.001"


def rows_of(frame, columns):
    return sorted(map(repr, map(tuple, frame.select(*columns).collect())))


def test_articles_of_the_given_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    for row in html_text.extract_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", row.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br)>", article)
        text = " ".join(" ".join(entities.unescape(re.sub(r"<[^>]*>", "", block)) for block in blocks).split())
        assert row.text == text and row.n_chars == len(text)


LONG = "This paragraph goes on for long enough to be taken for main text by its length alone, and then some."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("no markup but " + LONG, "no markup but " + LONG),
        (f"<body><div class='cookie-notice'>{LONG}</div><h2>Head</h2><p>{LONG}<p>A &amp; b&nbsp;c<footer>x</footer>", f"Head {LONG} A & b c"),
        (f"<nav>{LONG}</nav><main><p>Short.</p><aside>{LONG}</aside><p>End.</main><div id=comments>{LONG}</div>", "Short. End."),
        (f"<article><h1>T</h1><script>'</p>'</script><p>{LONG}</p><form>Your name</form></article><p>{LONG}", f"T {LONG}"),
        (f"<article><p><b>Bold<p>{LONG}</article><footer>{LONG}", f"Bold {LONG}"),
        (f"<!-- <p>{LONG}</p> --><p>{LONG}</p><ul class=menu><li>{LONG}</ul>", LONG),
        (f"<div><p>{LONG}</p><div class=ad>{LONG}</div><p>{LONG}</p></div>", f"{LONG} {LONG}"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div id=page class='site has-sidebar'><article><p>{LONG}</article></div>", LONG),
        (f"<div id=page class='sidebar'><article><p>{LONG}</article></div>", LONG),
        (f"<div class='header-fixed wrapper'><p>{LONG}<p>{LONG}</div>", f"{LONG} {LONG}"),
        (f"<div class='header'><p>{LONG}<p>{LONG}</div><p>{LONG}", f"{LONG} {LONG} {LONG}"),
        (f"<article><h2 id=related-work>Work</h2><p class=notice>{LONG}<section id=discussion><p>{LONG}</section></article>", f"Work {LONG} {LONG}"),
    ],
)
def test_labels_are_hints(page, text):
    assert html_text.main_text(page) == text
    assert html_text.main_text("<div class=ad>" * 20_000 + LONG) == LONG


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><p>{LONG}<p>{LONG}</article><article class='comment'><p>{LONG}</article>", f"{LONG} {LONG}"),
        ("<article><p>See also</article><div>" + f"<p>{LONG}" * 5 + "</div>", " ".join([LONG] * 5)),
        (f"<article><p>{LONG}</article><div>" + f"<p>{LONG}" * 3 + "</div>", LONG),
    ],
)
def test_main_elements_weigh_more_up_to_a_bound(page, text):
    assert html_text.main_text(page).endswith(text) and len(html_text.main_text(page)) <= len(text) + 9


CELLS = "<table>" + "<tr><td>1<td>2" * 8 + "</table>"


@pytest.mark.parametrize("times", [3, 20, 200])
def test_later_runs_do_not_depend_on_the_largest(times):
    page = "<div>" + f"<p>{LONG}" * times + f"{CELLS}<div class=ad>x</div>{CELLS}<h2>Last</h2><p>{LONG}<p>{LONG}</div>"
    assert html_text.main_text(page) == " ".join([LONG] * times + ["1 2"] * 16 + ["Last", LONG, LONG])


def test_short_pages_have_a_text():
    assert html_text.main_text("<div><h1>Closed</h1><p>Back on Monday.</div>") == "Closed Back on Monday."


def test_pages_of_odd_rows(spark):
    rows = [(1, None, None, 1), (2, "u", "", 1), (3, "u", "<p>" + "word " * 40_000, 1), (3, "u", "<p>x", 1), (None, "u", f"<p>{LONG}", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {(row.page_id, row.url, row.n_chars) for row in html_text.extract_text(pages).collect()}
    assert got == {(1, None, 0), (2, "u", 0), (3, "u", 199_999), (3, "u", 0), (None, "u", len(LONG))}
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_deep_and_broken_markup_takes_one_pass():
    assert html_text.main_text("<div>" * 20_000 + LONG) == LONG
    assert html_text.main_text("<p " * 2000 + LONG) is not None
    size = 1_000_000
    for page in (
        "<p " * (size // 3), "<p>" + "<p " * (size // 3), "<p a='" * (size // 6) + ">", '<p a="\'>' * (size // 8), "<div>" * 60_000 + "</x>" * 60_000,
        "<b>" * 60_000 + "<hr>" * 60_000, "<article>" + "<div>" * 60_000 + "</article></div>" * 60_000, "<nav>" * 60_000 + LONG, "<!--" * (size // 4), "<" * size,
    ):
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 8, page[:20]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<html><head><title>T</title><meta charset=x><body><p>{LONG}</p></body>", LONG),
        (f"<head><title>T</title><p>{LONG}", LONG),
        (f"<body><form action=x><div><p>{LONG}<p>{LONG}</div><input><select><option>a</select></form>", f"{LONG} {LONG}"),
        (f"<form><article><p>{LONG}</article></form><p>short", LONG),
        (f"<article><p>{LONG}<form><label>Your name</label></form></article>", LONG),
        (f"<nav><a>Home</a><p>{LONG}<p>{LONG}", f"{LONG} {LONG}"),
        (f"<nav><a>Home</a><main><p>{LONG}</main>", LONG),
        (f"<nav>{LONG} {LONG}</nav><p>{LONG}", LONG),
        ("<article><p>A line of it.<section class=comments>" + f"<p>{LONG}" * 3 + "</section></article>", "A line of it."),
        (f"<div><p>{LONG}</div><ol class=comment-list><li><article class=comment-body><p>{LONG}</article></ol>", LONG),
        (f"<div id=main class=comments-open><p>{LONG}</div><div class='comment-body'><p>{LONG} {LONG}</div>", LONG),
        (f"<p title='a > b'>{LONG}</p><p title='it's'>{LONG}", f"{LONG} {LONG}"),
    ],
)
def test_common_pages(page, text):
    assert html_text.main_text(page).removeprefix("Home ") == text


ODD_URLS = [None, "", "nohost", "HTTP://A.COM?x", "x://net/es/", "http://h.net/es/1/2/3/4/5/6#a", "http://h.net/es/1/2/3/4/5/6/7#a", "http://h.net/p/1/2/3/4/x", "http://h.net/p/1/2/3/4/y", "://", "http://b.Example.com/en/", "http://xnet/es/a"]


def test_urls_agree_with_sql(spark):
    random.seed(4)
    many = [f"http://q.net/{random.choice(['es', 'en', 'p'])}/{random.choice('abc')}{random.randrange(60)}/x" for _ in range(300)]
    rows = [(n if n % 50 else None, url, "x") for n, url in enumerate(ODD_URLS * 2 + many)]
    pages = spark.createDataFrame(rows, "page_id long, url string, template string")
    given = spark.read.parquet(f"{SMALL}/pages.parquet").selectExpr("page_id", "url", "'x' AS template")
    pages = pages.union(given)
    learned = (("block", "net", "/es/"), ("allow", "net", "/en/"), ("block", "m.net", "/"), ("block", "com", "/en/"))
    for rules in (url_filter.RULES, learned):
        connection = duckdb.connect()
        table = pages.toPandas()
        table["page_id"] = table["page_id"].astype("Int64")
        connection.register("pages", table)
        columns = ["page_id", "host", "path", "rule", "verdict"]
        theirs = connection.execute(f"SELECT {', '.join(columns)} FROM ({url_filter.oracle(rules)})").fetchall()
        assert rows_of(url_filter.judge(pages, rules), columns) == sorted(map(repr, theirs))
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_deep_branches_are_told_apart(spark):
    # Branches differ from the sixth segment on; one of them is blocked wherever a rule looks.
    urls = [f"http://h.org/1/2/3/4/5/{kind}/{n}/x" for kind in ("bad", "good") for n in range(30)] + ["http://h.org/" + "a/" * 3000 + "b"]
    pages = spark.createDataFrame([(n, url) for n, url in enumerate(urls)], "page_id long, url string")
    rules = tuple((("block", "h.org", f"/1/2/3/4/5/bad/{n}/")) for n in range(25)) + tuple(("allow", "h.org", f"/1/2/3/4/5/good/{n}/") for n in range(25))
    verdicts = {row.page_id: (row.rule, row.verdict) for row in url_filter.judge(pages, rules).collect()}
    assert verdicts[29] == (None, "block") and verdicts[59] == (None, "allow") and verdicts[60] == (None, "allow")


def test_templates_reject_by_what_rules_say(spark):
    # Branch s is blocked wherever a rule looks; its other values fall under the same wildcard.
    urls = [f"http://h.org/s/{n}/a" for n in range(30)] + [f"http://h.org/s/{n}/b" for n in range(30)] + ["http://h.org/t/1/b"] * 3
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = tuple(("block", "h.org", f"/s/{n}/") for n in range(25))
    verdicts = {row.page_id: (row.rule, row.verdict) for row in url_filter.judge(pages, rules).collect()}
    assert verdicts[29] == (None, "block") and verdicts[59] == (None, "block") and verdicts[60] == (None, "allow")


def test_long_rules_win(spark):
    pages = spark.createDataFrame([(1, "http://www.example.com/en/1"), (2, "http://example.com/en/1"), (3, "http://a.b.com")], "page_id long, url string")
    got = {row.page_id: (row.rule, row.verdict) for row in url_filter.judge(pages).collect()}
    assert got == {1: ("www.example.com/en/", "allow"), 2: ("example.com/en/", "block"), 3: (None, "allow")}


def brute_top(rows, k, every):
    whole = {}
    for vec_id, vector in rows:
        if vec_id is not None and vector and all(c is not None and np.isfinite(c) for c in vector):
            whole[vec_id, tuple(int(np.floor(64 * float(c))) for c in vector)] = None
    out = []
    for query, mine in whole:
        if query % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(mine, other)), vec_id) for vec_id, other in whole if vec_id != query)
            out += [(query, rank, vec_id, -score) for rank, (score, vec_id) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_blocks_and_ties_of_a_vector_with_many_copies(spark, monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK", 64)
    random = np.random.default_rng(5)
    common = (3 * random.normal(size=6)).tolist()
    rows = [(n, common if n % 3 else random.normal(size=6).tolist()) for n in range(600)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(20)
    blocks = top_k._blocks(top_k.whole_numbers(vectors)).groupBy("block").count().collect()
    assert sorted(row["count"] for row in blocks) == [600 % 64] + [64] * (600 // 64)
    got = sorted(map(tuple, top_k.search(vectors, 20, 50).collect()))
    assert got == brute_top(rows, 20, 50)


@pytest.mark.parametrize("size", [8, 3000])
def test_top_products_are_those_of_all_pairs(spark, size):
    random = np.random.default_rng(size)
    rows = [(n, (random.normal(size=6) * random.exponential()).astype("f4").tolist()) for n in range(size)]
    rows += [(size + n, rows[n][1]) for n in range(4)] + [(size + 9, [0.0] * 6), rows[0]]
    rows += [(None, rows[1][1]), (size + 20, None), (size + 21, [None] * 6), (size + 22, [float("nan")] * 6), (size + 23, [float("inf")] * 6)]
    vectors = spark.createDataFrame([(*row, 0.5) for row in rows], "vec_id long, embedding array<float>, score double").repartition(3)
    every = 4 if size == 8 else 300
    got = sorted(map(tuple, top_k.search(vectors, 20, every).collect()))
    assert got == brute_top(rows, 20, every)
    assert top_k.search(vectors.limit(0)).count() == 0
