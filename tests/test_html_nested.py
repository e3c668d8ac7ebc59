"""Elements within elements of their own tag, against Python's HTML parser."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from merchantry.operators import html


class Elements(HTMLParser):
    """Inner markup of elements, found by a stack."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.page, self.open, self.found = page, [], []
        self.lines = [0]
        for line in page.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(page)
        for tag, classes, begin, at in self.open:
            self.found.append((at, tag, classes, page[begin:], len(page)))

    def place(self):
        row, column = self.getpos()
        return self.lines[row - 1] + column

    def handle_starttag(self, tag, attrs):
        at = self.place()
        self.open.append((tag, (dict(attrs).get("class") or "").split(), at + len(self.get_starttag_text()), at))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                _, classes, begin, at = self.open.pop(i)
                self.found.append((at, tag, classes, self.page[begin : self.place()], self.place()))
                return

    def of(self, tag, name=""):
        return [(at, inner, end) for at, t, classes, inner, end in sorted(self.found) if t == tag and (not name or name in classes)]


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice(["text ", "a &amp; b", "\n", "<img src='x.jpg'>"])
    tag = rng.choice(["div", "span", "table", "div"])
    name = rng.choice(["", ' class="box"', " class='big box last'", ' id="i" class="boxed"', ' class="detail"'])
    return f"<{tag}{name}>" + "".join(tree(rng, depth - 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(5)
    made = ["".join(tree(rng, 5) for _ in range(3)) for _ in range(40)]
    return [*made, "", "no tags", "<div><div class=\"box\">never closed", "</div><div class='box'>after</div>", "<DIV CLASS=\"box\">Upper<Div>x</dIV ></DIV>"]


@pytest.mark.parametrize(("tag", "name"), [("div", ""), ("div", "box"), ("span", "box"), ("table", "detail")])
def test_blocks_are_balanced(spark, pages, tag, name):
    rows = spark.createDataFrame(list(enumerate(pages)), "id long, html string")
    got = {r.id: r.b for r in rows.select("id", html.blocks(F.col("html"), tag, name).alias("b")).collect()}
    assert got == {i: [inner for _, inner, _ in Elements(p).of(tag, name)] for i, p in enumerate(pages)}


def test_descendants_are_found_once(spark, pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "id long, html string")
    got = {r.id: r.b for r in rows.select("id", html.within(F.col("html"), ("div", "box"), ("span", "")).alias("b")).collect()}
    for i, p in enumerate(pages):
        parsed = Elements(p)
        outer = parsed.of("div", "box")
        assert got[i] == [inner for at, inner, _ in parsed.of("span") if any(a < at < end for a, _, end in outer)]
    assert sum(map(len, got.values())) > 20


def test_a_box_that_holds_a_div(spark):
    page = '<div class="detail"><div>in</div><p>a</p><div class="x"><div>deep</div></div></div><div class="detail">b</div>'
    rows = spark.createDataFrame([(page,)], "html string")
    assert rows.select(html.blocks(F.col("html"), "div", "detail").alias("b")).first().b == ["<div>in</div><p>a</p><div class=\"x\"><div>deep</div></div>", "b"]


def test_lists_within_lists_and_closing_tags_left_out(spark):
    pages = [("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>", ["a<ul><li>b</li></ul>", "b", "c"]), ("<li>a<li>b</li>", ["b"]), ("<p>x<p>y</p>", None)]
    rows = spark.createDataFrame([(p,) for p, _ in pages], "html string")
    got = rows.select(html.blocks(F.col("html"), "li").alias("b"), html.blocks(F.col("html"), "p").alias("p")).collect()
    assert [r.b for r in got[:2]] == [e for _, e in pages[:2]] and got[2].p == ["y"]


def test_mobile_page_with_nested_boxes(spark):
    """Boxes around and within the detail block of a page do not hide its lines."""
    inner = "".join(f"<p>{x}</p>" for x in ("价格：12.50", "x", "销量：34", "所在地：北京"))
    flat = f'<title>{"好" * 12}</title><p class="box"><a href="/cat/7">c</a></p><div class="detail">{inner}</div>'
    nested = flat.replace('<div class="detail">', '<div class="wrap"><div class="detail"><div class="inner">').replace("</p></div>", "</p></div></div></div>")
    a, b = (r.m for r in spark.createDataFrame([(flat,), (nested,)], "html string").select(html.mobile_item(F.col("html")).alias("m")).collect())
    assert a == b and a.cid == 7
