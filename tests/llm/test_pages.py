from __future__ import annotations

import os
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from sparkwell.llm import html_text as H
from sparkwell.llm import warc_audit as W

FOLDER = "/root/testdata/sf0.001"

BODY = "<article><h1>Title &amp; more</h1><p>First <b>bo</b>ld words<br>and a line.<div class='ad'>Buy now</div><p>Second   one,\n with &lt;marks&gt;.<form><input>Name</form><aside>Aside</aside><script>var x = '</p>';</script></article>"
PAGE = f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><!-- c --><header>Site header</header><nav><ul><li><a href=/>Home</a><li>Else</ul></nav><div id='cookie-notice'>We use cookies</div>{BODY}<section class='comments'><p>A long comment by some reader of the page who has much to say</p></section><footer>&copy; us</footer></body></html>"
TEXT = "Title & more First bold words and a line. Second one, with <marks>."


#: As learned from pages: an advert's class and the comments' say what they are.
LEARNED = {".ad": -6.0, ".comments": -6.0, ".cookie": -6.0, "word:p": 3.0, "word:h": 3.0, "word:other": 1.0}


def test_article_alone():
    assert H.main_text(PAGE, LEARNED) == TEXT
    hidden = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    assert H.main_text(hidden, LEARNED) == TEXT


ARTICLE = " ".join(f"word{i}" for i in range(52))
NAV = "<nav><ul><li><a href=x>Home</a></li></ul></nav>"


def test_teasers_and_ids_inside_the_article():
    card = "<article class=card><h3>Teaser</h3><p>short teaser text of ten words to lure you in</p></article>"
    assert H.main_text(f"<body>{NAV}<article><h1>Title</h1><p>{ARTICLE}</p></article>{card * 4}<footer>c</footer></body>", LEARNED) == f"Title {ARTICLE}"
    assert H.main_text(f"<body>{NAV}<div><h1>Title</h1><p>{ARTICLE}</p></div><article class=card><p>short teaser</p></article></body>", LEARNED) == f"Title {ARTICLE}"
    parts = f"<section id=legal><p>{ARTICLE}</p></section><section id=search><p>{ARTICLE}</p></section>"
    assert H.main_text(f"<body>{NAV}<article><h1>Title</h1>{parts}</article></body>", LEARNED) == f"Title {ARTICLE} {ARTICLE}"


def test_all_maximal_stretches_by_repeated_search():
    def again(x, at=0):
        a, b = H.best_stretch(x)
        return [] if a == b else [*again(x[:a], at), (at + a, at + b), *again(x[b:], at + b)]

    r = random.Random(9)
    for _ in range(500):
        x = [r.choice((-3.0, -2.5, -1.25, 1.5, 2.75, 4.0)) + r.random() / 64 for _ in range(r.randrange(25))]
        assert H.maximal_stretches(x) == again(x)
    began = time.time()
    H.maximal_stretches([1.0, -2.0] * 200_000)
    H.maximal_stretches([(-1.0) ** i * (i % 7) for i in range(400_000)])
    assert time.time() - began < 10


@pytest.mark.parametrize("page, text", [("", ""), ("<p>", ""), ("plain words", "plain words"), ("<p>a<p>b", "a b"), ("<script>x", ""), ("<p>a<!-- b", "a"), ("a &lt b &#233;&nbsp;c", "a < b é c"), ("<div hidden>no</div><p>yes yes", "yes yes"), ("<p title='a>b'>x y", "x y"), ("<p>a < b and c", "a < b and c"), ("<a href=\"q>x y", "x y")])
def test_odd_pages(page, text):
    assert H.main_text(page, {}) == text


def test_best_stretch():
    assert H.best_stretch([]) == (0, 0) and H.best_stretch([-1.0]) == (0, 0)
    assert H.best_stretch([1, -5, 2, 3, -1, 2, -9, 1]) == (2, 6)


HOSTILE = [lambda n: "<a href='" * n, lambda n: "<div>" * n + "x", lambda n: "<div>" * n + "</x>" * n, lambda n: "<b>" * n + "</b></i>" * n, lambda n: '<a "1>" ' * n + "'>", lambda n: "<a b='" * n + ">", lambda n: "<a" + " " * n + ">", lambda n: "<!--" * n, lambda n: "<script>" * n, lambda n: "<p class=ad>" * n, lambda n: "&#" + "9" * n]


@pytest.mark.parametrize("page", HOSTILE)
def test_many_open_tags_take_linear_time(page):
    began = time.time()
    H.main_text(page(200_000), {})
    assert time.time() - began < 20


def test_stretch_is_the_best_by_brute_force():
    r = random.Random(5)
    for _ in range(300):
        x = [r.choice((-3, -1, -0.5, 0, 1, 2)) for _ in range(r.randrange(12))]
        a, b = H.best_stretch(x)
        best = max([0.0] + [sum(x[i:j]) for i in range(len(x)) for j in range(i, len(x) + 1)])
        assert sum(x[a:b]) == best


class Plain(HTMLParser):
    """Text of the article by the standard library's parser, for pages whose tags
    are all closed."""

    def __init__(self):
        super().__init__()
        self.inside, self.cut, self.blocks = 0, 0, [""]

    def _tag(self, name, step):
        if name in H.BLOCKS:
            self.blocks.append("")
        self.inside += step * (name == "article")
        self.cut += step * (name in ("nav", "aside", "script", "form"))

    def handle_starttag(self, name, attrs):
        self._tag(name, 1)

    def handle_endtag(self, name):
        self._tag(name, -1)

    def handle_data(self, data):
        if self.inside and not self.cut:
            self.blocks[-1] += data


def random_page(r, mark="article"):
    def element(depth):
        name = r.choice(["p", "div", "b", "span", "aside", "form", "ul", "h2"])
        inner = "".join(element(depth + 1) if depth < 3 and r.random() < 0.3 else " ".join(r.choice(["alder", "birch &amp; elm", "fir,\n", " x", "5&lt;6"]) for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 4)))
        if name == "p":
            inner = re.sub(r"<[^>]*>", "", inner)
        return f"<{name}>{inner}</{name}>"

    menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("home", "news", "more"))
    body = "".join(element(0) for _ in range(r.randrange(3, 9)))
    return f"<html><head><title>t</title><script>var a = '<p>no</p>';</script></head><body><nav><ul>{menu}</ul></nav><div class=\"ad\">buy this now</div><{mark}><h1>Title word</h1>{body}<p>last words of it</p></{mark}><footer>&copy; us</footer></body></html>"


def test_marked_pages_by_a_plain_parser():
    r = random.Random(11)
    for _ in range(300):
        page = random_page(r)
        plain = Plain()
        plain.feed(page)
        want = " ".join(x for b in plain.blocks if (x := " ".join(b.split())))
        assert H.main_text(page, LEARNED) == want


def f1(got, want):
    both = sum((Counter(got.split()) & Counter(want.split())).values())
    return 2 * both / max(1, len(got.split()) + len(want.split()))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")
def test_weights_and_scan_decide_where_marks_are_hidden(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    weights = H.learn_weights(pages.where("page_id % 2 = 0"))
    for r in pages.where("page_id % 2 = 1").collect():
        want = H.main_text(r["html"], weights)
        hidden = r["html"].replace("<article>", "<div>").replace("</article>", "</div>")
        bare = re.sub(r"(</?)(nav|footer)>", r"\1div>", hidden.replace(' class="ad"', ""))
        # with marks and names hidden the weights of words and tags and the scan are enough
        for page in (hidden, bare):
            assert f1(H.main_text(page, weights), want) >= 0.95
            assert H.main_text(page, weights, inner=False) == want
            assert H.main_text(page, weights, scan=False, inner=False) != want


def test_unmarked_menu_goes_by_its_tags():
    menu = "<div><ul>" + "".join(f"<li><a href=/{i}>go</a></li>" for i in range(9)) + "</ul></div>"
    text = "<div><p>Here are some words to read, with <a href=x>a link</a> too.</p><div class=ad>Buy now</div><p>The end.</p></div>"
    assert H.main_text(f"<body>{menu}{text}{menu}</body>", LEARNED | {"word:a": -1.0}) == "Here are some words to read, with a link too. The end."


def test_weights_of_signs():
    w = H.weights_of([(".x", 0, 500), (".y", 10, 500), ("nav", 0, 30), ("word:p", 50, 0), ("word:a", 1, 9), ("<li", 2, 9)])
    assert -H.SIGN == w[".x"] < w[".y"] < w["nav"] < 0 and w["word:p"] >= H.WORD > w["word:a"]
    assert H.main_text("<article><p>a b c</p><i class=x>no</i></article>", w) == "a b c"
    assert H.weights_of([]) == {}


def test_table(spark):
    # without the comments, whose paragraphs outweigh the article's in so small a table
    page = re.sub("<section class='comments'>.*?</section>", "", PAGE)
    rows = [(1, "u", page), (2, None, None), (None, "v", page), (1, "u", page), (3, "w", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted(map(tuple, H.extract(df).collect()), key=str)
    text = got[0][2]  # the weights are those of these few words
    assert "First bold words and a line." in text and "Home" not in text and "Site header" not in text
    n = len(text)
    assert got == sorted([(1, "u", text, n), (1, "u", text, n), (None, "v", text, n), (2, None, "", 0), (3, "w", "", 0)], key=str)
    assert H.extract(df.limit(0)).count() == 0


def records(spark, rows):
    return spark.createDataFrame(rows, "record_id long, record binary")


def test_audit_finds_every_fault(spark):
    good = [(i, f"record {i} ".encode() * (i % 5 + 1)) for i in range(5000)]
    bad = {i: r for i, r in good}
    bad[17] += b"!"
    bad[4999] = b"gone"
    del bad[0], bad[3000]
    bad[-5] = b"new"
    got = {r["record_id"]: (r["fault"], r["offset"]) for r in W.audit(records(spark, good).repartition(6), records(spark, list(bad.items()))).collect()}
    at = lambda k: sum(len(r) for i, r in good if i < k)
    assert got == {17: ("changed", at(17)), 4999: ("changed", at(4999)), 0: ("missing", 0), 3000: ("missing", at(3000)), -5: ("extra", None)}
    assert W.audit(records(spark, good), records(spark, good)).count() == 0


def test_agreeing_branches_are_not_read(spark):
    good = [(i, b"x" * (i % 9)) for i in range(4096)]
    rows = W.leaves(records(spark, good), records(spark, [x for x in good if x[0] != 70]))
    shape = W.levels(rows)
    found = W.mismatches(W.tree(rows, shape), shape)
    # one id of 4096 is lost: the leaves of its range alone, for the others' hashes do not shift
    assert found.where("side = 0").count() == 64 and found.where("side = 1").count() == 63
    assert "GreaterThanOrEqual(id,64)" in found._jdf.queryExecution().toString()


def test_audit_counts_repeated_and_nameless_records(spark):
    a = [(1, b"x"), (1, b"x"), (1, b"y"), (None, b"n"), (None, b"m"), (2, b"z"), (3, None), *[(7, b"%d" % i) for i in range(300)]]
    b = [(1, b"x"), (1, b"y"), (1, b"w"), (None, b"n"), (None, b"M"), (2, b"z"), (2, b"z"), (3, b""), *[(7, b"%d" % i) for i in range(1, 301)]]
    got = sorted((str(r["record_id"]), r["fault"], r["copies"], r["digest"] is None, r["replica_digest"] is None) for r in W.audit(records(spark, a), records(spark, b)).collect())
    assert got == [("1", "changed", 1, False, False), ("2", "extra", 1, True, False), ("3", "changed", 1, False, False), ("7", "changed", 1, False, False), ("None", "changed", 1, False, False)]
    more = W.audit(records(spark, a), records(spark, a[3:])).collect()
    assert sorted((r["fault"], r["copies"]) for r in more) == [("missing", 1), ("missing", 2)]


def test_audit_finds_a_replica_in_another_order(spark):
    rows = [(i, b"r%03d" % i) for i in range(500)]

    def placed(order):
        at = {i: 4 * k for k, i in enumerate(order)}
        return spark.createDataFrame([(i, r, at[i]) for i, r in rows if i in at], "record_id long, record binary, offset long")

    same = list(range(500))
    swapped = [*same[:10], 11, 10, *same[12:]]
    assert {(r["record_id"], r["fault"]) for r in W.audit(placed(same), placed(swapped)).collect()} >= {(10, "moved"), (11, "moved")}
    far = [i for i in same if i != 33] + [33]
    got = [(r["record_id"], r["fault"]) for r in W.audit(placed(same), placed(far)).collect()]
    assert (33, "moved") in got and len(got) < 4
    assert W.audit(placed(swapped), placed(swapped)).count() == 0
    lost = [i for i in same if i != 200]
    assert [(r["record_id"], r["offset"], r["fault"]) for r in W.audit(placed(same), placed(lost)).collect()] == [(200, 800, "missing")]


def test_audit_odd_archives(spark):
    none = records(spark, [])
    one = records(spark, [(1, b"x"), (1, b"x"), (None, b"y")])
    assert W.audit(none, none).count() == 0 and W.audit(one, one).count() == 0
    assert sorted((r["fault"], r["copies"]) for r in W.audit(one, none).collect()) == [("missing", 1), ("missing", 2)]
    assert sorted(r["fault"] for r in W.audit(none, one).collect()) == ["extra", "extra"]
    clash = records(spark, [(-9, b"x"), (1 << 62, b"z" * 3_000_000)]).selectExpr("*", "1 AS id", "2 AS p", "3 AS n", "4 AS digest")
    assert [r["offset"] for r in W.audit(clash, clash.where("record_id < 0")).collect()] == [1]
    nulls = spark.range(1).select(W.warc_record(F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("r")).first()[0]
    assert bytes(nulls).startswith(b"WARC/1.1\r\n") and b"Content-Length: 0" in bytes(nulls)
