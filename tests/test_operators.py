"""Operators on small hand-made tables, for constructs that the given tables lack."""

import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import diffs, links, pages, search, selectors, structure, versions, words
from quire.operators import tokens as M
from quire.sources import archives
from quire.streaming import changes


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return row.select(column.alias("v")).first().v


def html(spark, *texts):
    return spark.createDataFrame([(i, f"http://a.example/f{i}.html", x) for i, x in enumerate(texts)], "page_id long, url string, html string")


# functions


@pytest.mark.parametrize(
    ("base", "href", "want"),
    [
        ("Text/a.xhtml", "../Images/b c.png", "Images/b c.png"), ("Text/a.xhtml", "b%20c.xhtml#f", "Text/b c.xhtml"), ("Text/a.xhtml", "#top", "Text/a.xhtml"), ("a.xhtml", "目次.xhtml", "目次.xhtml"),
        ("Text/a.xhtml", "./x/../b.xhtml", "Text/b.xhtml"), ("Text/a.xhtml", "/Styles/s.css", "Styles/s.css"), ("Text/a.xhtml", "../../../b.xhtml", "b.xhtml"), ("Text/a.xhtml", "a+b%2Bc.xhtml", "Text/a+b+c.xhtml"),
    ],
)
def test_resolve(spark, base, href, want):
    assert one(spark, T.resolve("base", "href"), base=base, href=href) == want


@pytest.mark.parametrize(("a", "b", "want"), [("Text/a.html", "Text/b.html", "b.html"), ("Text/a.html", "Images/b.png", "../Images/b.png"), ("a.html", "x/y.html", "x/y.html"), ("x/y/a.html", "b.html", "../../b.html"), ("x/a.html", "x/y/b.html", "y/b.html")])
def test_relative_inverts_resolve(spark, a, b, want):
    assert one(spark, T.relative("a", "b"), a=a, b=b) == want
    assert one(spark, T.resolve("a", T.relative("a", "b")), a=a, b=b) == b


def test_scalars(spark):
    assert one(spark, T.url_encode("x"), x="a b/é?c~目") == "a%20b/é%3Fc~目"
    assert one(spark, T.url_decode("x"), x="a%20b+%zz") == "a%20b+%zz"
    assert one(spark, T.full_width("x"), x="Az 09!") == "Ａｚ　０９！"
    assert one(spark, T.half_width(T.full_width("x")), x="Az 09!~") == "Az 09!~"
    assert (one(spark, T.css_length("x")[0], x=" 1.5em"), one(spark, T.css_length("x")[1], x=" 1.5em")) == (1.5, "em")
    assert one(spark, T.css_length("x")[0], x="auto") is None
    assert one(spark, T.style_property("x", "margin"), x="color:red; margin : 0 1em;") == "0 1em"
    assert one(spark, T.title_case("x"), x="the lord of the rings by J.R. o'neil iPhone") == "The Lord of the Rings by J.R. O'Neil iPhone"
    assert one(spark, T.swapcase("x"), x="aBc é") == "AbC É"
    assert one(spark, T.valid_id("x"), x="1 a.b/ü") == "x1a.b"
    assert one(spark, T.is_scene_break("x"), x=" * * * ") and not one(spark, T.is_scene_break("x"), x="* a *") and not one(spark, T.is_scene_break("x"), x="   ")
    maps = spark.sql("select map('a', '1', 'b', '2') a, map('a', '1', 'c', '2') b, map('a', '9') c")
    assert [tuple(r) for r in maps.select(T.style_distance("a", "b"), T.style_distance("a", "a"), T.style_distance("a", "c")).collect()] == [(22, 0, 12)]


def test_natural_sort(spark):
    names = spark.createDataFrame([(x,) for x in ("f10", "f9", "F1", "f010b")], "n string")
    assert [r.n for r in names.orderBy(words.natural_key("n")).collect()] == ["F1", "f9", "f10", "f010b"]


# markup


def test_tokens_are_the_document(spark):
    nasty = ["", "a < b <p>x", "<!-- <p> -->", "<![CDATA[x]]><?xml version='1.0'?><?pi x?><br/><P CLASS=x>", "<p a='1' A=\"2\" b=c d>", "<unclosed", "<!--" + "x" * 30_000 + "-->"]
    docs = html(spark, *nasty)
    back = {r.doc: r.text for r in M.serialize(M.tokens(docs)).collect()}
    assert all(back.get(i, "") == x for i, x in enumerate(nasty))
    kinds = {r.ttype for r in M.tokens(docs).collect()}
    assert kinds >= {"text", "comment", "cdata", "xmlheader", "pi", "single", "begin"}
    attrs = M.tokens(docs).where("doc = 4 and ttype = 'begin'").select(M.attributes("tok").alias("a")).first().a
    assert attrs == {"a": "1", "b": "c"}


def test_elements(spark):
    docs = html(spark, "<html><body><p>a<b>b<p>c</p><br><img src='x'/></body></html>", "", "no tags")
    rows = {(r.tname, r.eid): r for r in M.elements(docs).collect()}
    shape = sorted((r.eid, r.tname, r.depth, r.matched, r.child_no) for r in rows.values())
    assert [x[1:4] for x in shape] == [("html", 1, True), ("body", 2, True), ("p", 3, False), ("b", 4, False), ("p", 5, True), ("br", 5, True), ("img", 5, True)]


def random_pages(n, seed=5):
    import random

    r = random.Random(seed)
    names = ["div", "p", "b", "ul", "li", "section"]
    out = []
    for k in range(n):
        open_, parts = [], []
        for _ in range(r.randint(0, 40)):
            what = r.random()
            if what < 0.45:
                open_.append(r.choice(names))
                parts.append(f"<{open_[-1]}{r.choice(['', ' lang=de', ' lang=fr'])}>")
            elif what < 0.8 and open_:
                parts.append(f"</{open_.pop(-1 if k % 3 == 0 or r.random() < 0.8 else r.randrange(len(open_)))}>")
            elif what < 0.85 and k % 3 == 2:
                parts.append(f"</{r.choice(names)}>")
            else:
                parts.append(r.choice(["text ", "<br>", "more"]))
        out.append("".join(parts))
    return out


def test_innermost_elements_on_tangled_pages(spark):
    """Windows against holding every place against every element."""
    docs = html(spark, *random_pages(60))
    els = M.elements(docs).cache()
    family = {}
    for e in els.where("not alone").collect():
        family.setdefault(e.doc, []).append((e.eid, e.end_seq))
    for found in family.values():  # properly nested
        assert not any(a < b < x < y for a, x in found for b, y in found)
    for e in els.collect():
        around = [x for x in family.get(e.doc, []) if x[0] < e.eid and x[1] >= e.end_seq]
        assert e.parent_eid == (max(around)[0] if around else None) and e.depth == len(around) + 1
    texts = M.tokens(docs, positions=False).where("ttype = 'text'").select("doc", "seq")
    want = {(t.doc, t.seq): sorted(a for a, b in family.get(t.doc, []) if a < t.seq <= b) for t in texts.collect()}
    nearest = {(r.doc, r.seq): r.eid for r in M.around(texts, els, {"eid": F.col("eid")}).collect()}
    assert nearest == {k: max(v, default=None) for k, v in want.items()} and any(len(v) > 4 for v in want.values())
    every = {}
    for r in M.around(texts, els, {"eid": F.col("eid")}, every=True).orderBy("doc", "seq", "up").collect():
        every.setdefault((r.doc, r.seq), []).append(r.eid)
    assert every == {k: v for k, v in want.items() if v}
    langs = {(e.doc, e.eid): e.tok for e in els.collect()}
    for r in pages.token_lang(docs, els).collect():
        inside = [langs[r.doc, a][-3:-1] for a in want[r.doc, r.seq] if "lang=" in langs[r.doc, a]]
        assert r.lang == (inside or ["en"])[-1]


def test_crossing_tags_are_unclosed(spark):
    rows = {r.tname: (r.matched, r.end_seq) for r in M.elements(html(spark, "<div><b>1<i>2</b>3</i></div><p>x")).collect()}
    assert rows == {"div": (True, 8), "b": (False, 8), "i": (False, 8), "p": (False, 10)}


def test_large_page(spark):
    import time

    n = 30_000
    docs = html(spark, "<div>" * 40 + "<ul>" + "<li>x</li>" * n + "</ul>" + "</div>" * 40 + "<p>y" * n)
    began = time.time()
    els = M.elements(docs)
    assert els.agg(F.max("depth")).first()[0] >= n
    assert M.around(M.tokens(docs, positions=False).where("ttype = 'text'").select("doc", "seq"), els.where("tname = 'li'"), {"eid": F.col("eid")}).where("eid is not null").count() == n
    assert time.time() - began < 120
    for plan in (els, pages.text_blocks(docs, els), pages.element_at(els, els.select("doc", F.col("eid").alias("seq"))), structure.nav_entries(docs, els)):
        assert not any(x in plan._jdf.queryExecution().executedPlan().toString() for x in ("Cartesian", "NestedLoop", "<= seq", ">= seq"))


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("ul > li", ["a", "b", "c"]), ("li:nth-child(even)", ["b"]), ("li:nth-last-child(1)", ["c"]), ("li + li", ["b", "c"]), ("li.x ~ li", ["b", "c"]), ("#q", ["b"]), ("[data-k|=en]", ["c"]), ("[class~=y]", ["a"]),
        ("li:not(.x)", ["b", "c"]), ("ul:has(#q)", ["u"]), ("li:first-child, li:last-child", ["a", "c"]), ("li:hover", ["a", "b", "c"]), ("p:only-child", ["p"]), ("li:contains('two')", ["b"]), ("em:empty", ["e"]), ("p em", ["e"]),
    ],
)
def test_selectors(spark, selector, want):
    docs = html(spark, "<ul title=u><li title=a class='x y'>one</li><li title=b id=q>two</li><li title=c data-k='en-GB'>three</li></ul><div><p title=p>t<em title=e></em></p></div>")
    els = M.elements(docs)
    found = selectors.select(selectors.prepared(pages.with_lang(els, "en")), selector, pages.element_texts(docs, els))
    assert sorted(r.t for r in found.select(M.attributes("tok")["title"].alias("t")).collect()) == want


@pytest.mark.parametrize("bad", ["", "p >", "p[", ":nth-child(x)", "p:unknown(", "..a", "p,,q"])
def test_selector_errors(spark, bad):
    els = M.elements(html(spark, "<p>x</p>"))
    rows = selectors.selects_or_error(selectors.prepared(els), bad).collect()
    assert [r.note for r in rows] == [selectors.PARSE_ERROR]


def test_css(spark):
    css = "@import 'b.css'; /* p{} */ @media print { p.c, a > b { color: red } } .x{background:url( \"i/a.png\" );content:'\\2014 a'}"
    docs = spark.createDataFrame([("s", "Styles/s.css", css)], "doc string, path string, css string")
    rules = M.css_rules(docs, "doc", "css", style_blocks=False)
    assert [r.selector for r in rules.orderBy("rule_no", "selector_no").collect()] == ["p.c", "a > b", ".x"]
    assert {r.path for r in M.css_urls(docs, "doc", "css", "path").collect()} == {"Styles/b.css", "Styles/i/a.png"}
    assert [r.url for r in M.css_imports(docs, "doc", "css").collect()] == ["b.css"]
    assert sorted(r.codepoint for r in M.css_used_codepoints(M.css_declarations(rules)).collect()) == [97, 0x2014]
    left = links.without_selectors(rules, spark.createDataFrame([("p.c",), (".x",)], "selector string")).first().css
    assert left == "a > b { color: red }"


def test_stylesheet_closure_ends_in_cycles(spark):
    start = spark.createDataFrame([("p1", "a"), ("p2", "d")], "page string, sheet string")
    imports = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "sheet string, target string")
    found = {(r.page, r.sheet, r.step) for r in links.stylesheet_closure(start, imports).collect()}
    assert found == {("p1", "a", 0), ("p1", "b", 1), ("p1", "c", 2), ("p2", "d", 0)}


def test_class_usage_takes_the_first_rule_in_cascade_order(spark):
    markup = {
        1: "<style>p.x{} .x{} p > .y{} .y:hover{}</style><link rel=stylesheet href='a.css'><p class='x y z'></p><div class='x'></div>",
        2: "<link rel=stylesheet href='../s/a.css'><link rel=stylesheet href='b.css'><link rel=stylesheet href='gone.css'><p class='x'></p><b class='w y'></b><p class='deep'></p>",
        3: "<link rel=stylesheet href='http://z/b.css'><p class='x'></p>",
    }
    rows = [(k, "b", "s/p.html", v) for k, v in markup.items()]
    docs = spark.createDataFrame(rows, "page_id long, book string, path string, html string")
    css = {"s/a.css": "@import 'c.css'; @import 'd.css'; div.x{} p.x.k{} .y.q{}", "s/b.css": ".w{} .x{} .y{}", "s/c.css": "@import 'a.css'; .w{} .a.w{}", "s/d.css": "b.w{}.deep{}", "s/e.css": ".z{}"}
    sheets = spark.createDataFrame([("b", k, v) for k, v in css.items()], "book string, path string, css string")
    got = {(r.doc, r.tname, r["class"]): (r.selector, r.css) for r in links.class_usage(docs, sheets=sheets).collect()}
    assert got == {
        (1, "p", "x"): ("p.x", None), (1, "p", "y"): (".y.q", "s/a.css"), (1, "p", "z"): (None, None), (1, "div", "x"): (".x", None),
        (2, "p", "x"): ("p.x.k", "s/a.css"), (2, "b", "w"): (".w", "s/c.css"), (2, "b", "y"): (".y.q", "s/a.css"), (2, "p", "deep"): (".deep", "s/d.css"), (3, "p", "x"): (None, None),
    }
    assert {(r.doc, r.tname, r["class"]): r.selector for r in links.class_usage(docs).collect()}[2, "p", "x"] is None


def test_deep_imports(spark):
    n = 40
    start = spark.createDataFrame([("p", 0)], "page string, sheet long")
    imports = spark.createDataFrame([(k, k + 1, 0) for k in range(n)] + [(0, 7, 1)], "sheet long, target long, n long")
    found = {r.sheet: (r.step, r.place) for r in links.stylesheet_closure(start, imports, merge=4).collect()}
    assert len(found) == n + 1 and found[7] == (1, [1]) and found[n] == (1 + n - 7, [1] + [0] * (n - 7)) and found[6] == (6, [0] * 6)


def test_natural_key(spark):
    names = ["a2", "a10", "a" + "9" * 25, "a1" + "0" * 25, "a007b", "a7c", "B1"]
    got = [r.x for r in spark.createDataFrame([(x,) for x in reversed(names)], "x string").orderBy(words.natural_key("x")).collect()]
    assert got == ["a2", "a007b", "a7c", "a10", "a" + "9" * 25, "a1" + "0" * 25, "B1"]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_scripts_are_shortest():
    import random

    r = random.Random(8)
    for k in range(3000):
        letters = "abcdefgh"[: r.randint(1, 8)]
        a, b = ([r.choice(letters) for _ in range(r.randint(0, 14))] for _ in range(2))
        if k % 3 == 0:
            b = [x for x in a if r.random() < 0.8] + ["z"] * (k % 2)
        ops, back, at = list(diffs.opcodes(a, b)), [], (0, 0)
        for op, i, j, x, y in ops:
            assert (i, x) == at and (op == "equal") == (a[i:j] == b[x:y]) and op == ("equal" if a[i:j] == b[x:y] else "replace" if i < j and x < y else "delete" if i < j else "insert")
            back, at = back + (a[i:j] if op == "equal" else b[x:y]), (j, y)
        assert back == b and at == (len(a), len(b))
        assert sum(j - i for op, i, j, *_ in ops if op == "equal") == longest_common(a, b), (a, b)
        assert all(p[0] != q[0] or p[0] != "equal" for p, q in zip(ops, ops[1:]))


def test_long_texts_with_few_differences():
    import random
    import time

    r = random.Random(9)
    a = [str(r.randrange(1000)) for _ in range(100_000)]
    b = [x for i, x in enumerate(a) if i % 5000 != 7]
    began = time.time()
    ops = list(diffs.opcodes(a, b))
    assert sum(j - i for op, i, j, *_ in ops if op != "equal") == 20 and time.time() - began < 5
    assert len(list(diffs.opcodes([f"a{i}" for i in range(50_000)], [f"b{i}" for i in range(50_000)]))) == 1


def test_line_opcodes_of_odd_rows(spark):
    kind = "doc_id long, text string, _a int"
    a = spark.createDataFrame([(1, None, 1), (2, "x", 1), (2, "y", 1), (None, "n", 1), (3, "same", 1), (4, "a\nb", 1)], kind)
    b = spark.createDataFrame([(1, "x\ny", 1), (2, "y", 1), (None, "m", 1), (3, "same", 1), (5, "new", 1), (4, "", 1)], kind)
    got = {tuple(r) for r in versions.line_opcodes(a, b).collect()}
    assert got == {(1, "replace", 0, 1, 0, 2), (2, "replace", 0, 1, 0, 1), (4, "replace", 0, 2, 0, 1)}
    assert versions.line_opcodes(a.limit(0), b).count() == 0
    assert {tuple(r) for r in versions.edit_counts(versions.line_opcodes(a, b)).collect()} == {(1, 0, 1, 2, 1), (2, 0, 1, 1, 1), (4, 0, 2, 1, 1)}


def test_links(spark):
    docs = spark.createDataFrame(
        [(1, "http://b/x/a.html", "<a id=s href='c.html#n'>1</a><a href='http://z/'>2</a><a href='C.HTML'>3</a><a href='gone.html'>4</a>"), (2, "http://b/x/c.html", "<p id=n><a href='a.html'>back</a></p>")],
        "page_id long, url string, html string",
    )
    resources = links.resources_of(docs)
    report = links.link_report(resources, pages.ids(docs))
    assert {(r.page_id, r.href, r.target_exists, r.is_match) for r in links.points_back(report).collect()} == {
        (1, "c.html#n", "yes", True), (1, "http://z/", "n/a", False), (1, "C.HTML", "no", False), (1, "gone.html", "no", False), (2, "a.html", "yes", True),
    }
    fixed = links.case_fix(links.local_links(resources), resources).collect()
    assert [(r.href, r.fixed) for r in fixed] == [("C.HTML", "x/c.html")]
    tails = spark.createDataFrame([("X/C.html",), ("c.html",), ("y/c.html",)], "tail string")
    assert {r.tail for r in links.path_end_match(resources, tails).collect()} == {"X/C.html", "c.html"}


def test_page_extraction(spark):
    docs = html(spark, "<head><meta name='DC.creator' content='Me'><link rel=stylesheet href='s.css'><link href='t.css'><script src='j.js'></script></head><img src='i.png'><math altimg='m.png'></math><img src='http://x/y.png'><p style='background:url(b.png)'>é</p>")
    assert {r.path for r in pages.media_paths(docs).collect()} == {"i.png", "m.png"}
    assert {(r.kind, r.href) for r in pages.stylesheet_links(docs).collect()} == {("stylesheet", "s.css"), ("css", "t.css"), ("script", "j.js")}
    assert [r.url for r in pages.style_attr_urls(docs).collect()] == ["b.png"]
    assert [(r.name, r.content) for r in pages.html_metadata(docs).collect()] == [("dc:creator", "Me")]
    entities = html(spark, "<!DOCTYPE x [<!ENTITY me 'Anna'>]><p>&me; &amp;</p>")
    assert pages.resolve_entities(entities, "page_id", "html").first().html == "<!DOCTYPE x []><p>Anna &amp;</p>"


def test_heading_tree_equals_nesting(spark):
    import random

    r = random.Random(1)
    rows = [(d, k, r.randint(1, 6)) for d in range(6) for k in range(60)]
    got = {(x.doc, x.seq): x for x in structure.heading_tree(spark.createDataFrame(rows, "doc long, seq long, level int")).collect()}
    for d in range(6):
        stack = []
        for _, k, level in (x for x in rows if x[0] == d):
            while stack and stack[-1][1] >= level:
                stack.pop()
            x = got[d, k]
            assert (x.parent_seq, x.toc_level) == (stack[-1][0] if stack else None, len(stack) + 1)
            stack.append((k, level))


# search


def test_batch_workload(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("v0 "), 256).alias("text"))
    rules = [search.Rule(f"r{n}", f"v{n} ", f"v{n + 1} ") for n in range(50)]
    run = search.run_recipe(docs, rules)
    total = run.agg(F.sum(sum((F.col(f"n_{k}") for k in range(1, 51)), F.lit(0))).alias("n")).first().n
    assert total == 12_800_000
    done = search.committed(run)
    assert done.count() == 1000 and done.select("text").distinct().first().text == "v50 " * 256


def test_recursive_guards(spark):
    docs = spark.createDataFrame([("aaaa",), ("ab",), (None,), ("none",)], "t string")
    run = lambda p, r: [x.r and (x.r.status, x.r.text) for x in docs.select(search.recursive_replace("t", p, r).alias("r")).collect()]
    assert run("aa", "a") == [("ok", "a"), ("ok", "ab"), None, ("ok", "none")]
    assert run("ab|ba", "ba")[1] == ("no_progress", "ab")
    assert run("a", "aa")[0] == ("replacements", "aaaa")
    assert docs.select(search.recursive_replace("t", "a", "ba", rounds=3).alias("r")).first().r.status == "limit"
    assert run("^a", "ba")[0][0] == "ok" and run("x", "xx")[3] == ("ok", "none")


def test_templates(spark):
    docs = spark.createDataFrame([("john smith",)], "t string")
    use = lambda p, r: docs.select(search.replace_all("t", p, r)).first()[0]
    assert use(r"(\w+) (\w+)", r"\2 \1") == "smith john"
    assert use(r"(?P<a>\w+) (\w+)", r"\u\g{a} \U\g{2}\E!\x{41}\q") == "John SMITH!A\\q"
    assert use(r"\w+", r"\u\0") == "John Smith"
    assert use(r"smith", r"\LABC\E$1\\") == "john abc$1\\"


@pytest.mark.parametrize("bad", [r"a\Kb", r"(?R)", r"(?(1)a)", r"(*SKIP)"])
def test_refused_patterns(bad):
    with pytest.raises(search.PatternError):
        search.java_pattern(bad)


def test_recipe_variables(spark):
    docs = spark.createDataFrame([(1, "<p>A1 x</p>"), (2, "<p>A2 x</p>"), (3, "<p>x</p>")], "doc_id long, text string")
    rules = [search.Rule("seed", r"(?P<seed>A\d)", "mark", capture=True), search.Rule("use", "x", "${var:seed}")]

    def run(df=docs, rules=rules, **how):
        return {r.doc_id: (r.text, r.error) for r in search.run_recipe(df, rules, **how).collect()}

    assert run() == {1: ("<p>mark A1</p>", ""), 2: ("<p>mark A2</p>", ""), 3: ("<p>x</p>", "use")}
    assert {k: x for k, (x, _) in run(scope="batch").items()} == {1: "<p>mark A2</p>", 2: "<p>mark A2</p>", 3: "<p>A2</p>"}
    assert run(scope="batch", policy="first")[2][0] == "<p>mark A1</p>"
    assert run(scope="session", variables={"seed": "S"}, policy="first")[2][0] == "<p>mark S</p>"
    assert run(variables={"seed": "$1\\1"})[3] == ("<p>$1\\1</p>", "")  # plain text, not a reference
    assert search.committed(search.run_recipe(docs, rules)).count() == 0  # one failing document stops the whole
    only = [search.Rule("seed", r"(<p>)(?P<seed>A\d)", capture_only=True), rules[1]]
    assert run(rules=only)[1] == ("<p>A1 A1</p>", "")
    report = search.dry_run(docs, only, scope="batch").orderBy("rule_no", "doc_id").collect()
    assert [(r.rule, r.doc_id, r.start, r.before, r.after, r.variables) for r in report[:3]] == [("seed", 1, 0, "<p>A1", "<p>A1", "seed"), ("seed", 2, 0, "<p>A2", "<p>A2", "seed"), ("use", 1, 6, "x", "A2", "")]
    long = spark.createDataFrame([(1, "A" * 70_000)], "doc_id long, text string")
    assert run(long, [search.Rule("big", "(?P<v>A+)", capture_only=True)])[1][1] == "big"
    many = spark.createDataFrame([(1, "B" * 60_000 + " ")], "doc_id long, text string").withColumn("text", F.repeat("text", 80))
    for policy, error in (("append", "big"), ("last", "")):
        assert search.run_recipe(many, [search.Rule("big", "(?P<v>B+)", capture_only=True)], policy=policy).first().error == error
    for bad in ([search.Rule("r", "(?P<v>a)", "${var:v}", capture=True)], [search.Rule("r", "a", capture_only=True)], [search.Rule("r", "(?P<v>a)", recursive=True, capture=True)]):
        with pytest.raises(ValueError):
            search.run_recipe(docs, bad)
    assert search.group_numbers(r"(a)[(](?:b)\((?P<x>c)(?<y>(d))(?<!e)(?=f)") == {"x": 2, "y": 3}


def test_recipes(spark):
    rules = [search.Rule("x", "a", "b"), search.Rule("y", "aa", "a", recursive=True, enabled=False)]
    assert search.load_recipe(search.dump_recipe(rules)) == rules
    for bad in ('{"version": 2, "rules": []}', search.dump_recipe([rules[0], rules[0]]), search.dump_recipe([search.Rule("k", r"\K")])):
        with pytest.raises(ValueError):
            search.load_recipe(bad)
    docs = spark.createDataFrame([(1, "ab"), (2, "xyz")], "doc_id long, text string")
    failing = search.run_recipe(docs, [search.Rule("loop", "ab|ba", "ba", recursive=True), search.Rule("z", "z", "q")])
    assert search.committed(failing).count() == 0  # all or nothing
    kept = search.run_recipe(docs, [search.Rule("acc", "[a-z]", "-", accept="[ax]")])
    assert sorted(r.text for r in kept.collect()) == ["-b", "-yz"]


def test_edits(spark):
    docs = spark.createDataFrame([(1, "a😀cdef"), (2, "abc"), (3, "abc"), (4, "abc")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 2, 3, "X"), (1, 3, 4, ""), (1, 6, 6, "!"), (2, 0, 2, "x"), (2, 1, 3, "y"), (3, 2, 9, "")], "doc_id long, start long, end long, text string")
    got = {r.doc_id: (r.text, r.error) for r in search.apply_edits(docs, edits).collect()}
    assert got == {1: ("a😀Xef!", ""), 2: ("abc", "overlap"), 3: ("abc", "range"), 4: ("abc", "")}


def test_function_replace_keeps_failing_matches(spark):
    docs = spark.createDataFrame([(5, "a1 b2"), (2000, "c3 d4"), (7, None)], "doc_id long, text string")

    def fn(match, n):
        return match + str(10 // (n - 2))

    got = {r.doc_id: r.text for r in search.function_replace(docs, "[a-z][0-9]", fn).collect()}
    assert got == {5: "a1-10 b2", 2000: "c310 d45", 7: None}


# versions and streams


def test_streams_keep_order_across_batches(spark, tmp_path):
    """Files come one by one, out of order within the watermark; a row later than it goes, and nothing waits longer than it must."""
    import datetime
    import random

    r = random.Random(6)
    start = datetime.datetime(2024, 5, 1)
    rows = [(i, start + datetime.timedelta(seconds=20 * i + r.random()), r.randrange(4), "edit", 0.0, "") for i in range(600)]
    order = sorted(rows, key=lambda x: x[0] + r.randint(0, 20))  # at most seven minutes late
    late = (1000, start + datetime.timedelta(seconds=30), 1, "edit", 0.0, "")
    parts = [order[k : k + 60] for k in range(0, 600, 60)]
    parts[8].append(late)
    for k, part in enumerate(parts):
        spark.createDataFrame(part, changes.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.02)
    stream = changes.ingest(spark, f"{tmp_path}/in", changes.EVENTS, files_per_trigger=1)
    batch = spark.createDataFrame(rows, changes.EVENTS)
    passed = max(x[1] for x in rows).timestamp() - 600
    as_rows = lambda df: {tuple(x) for x in df.collect()}
    with changes.state_store(spark):
        got = as_rows(changes.run_to_end(changes.ordered_revisions(stream), "ordered", f"{tmp_path}/a").select("event_id", "user_id", "revision"))
        hours = as_rows(changes.run_to_end(changes.coalesce_changes(stream, every="10 minutes"), "hours", f"{tmp_path}/b"))
        edits = as_rows(changes.run_to_end(changes.sessions(stream, gap="1 minute"), "edits", f"{tmp_path}/c"))
    want = as_rows(changes.revisions(batch).where(F.unix_millis("ts") < passed * 1000 - 1).select("event_id", "user_id", "revision"))
    assert got >= want and len(got) <= len(want) + 1 and 1000 not in {x[0] for x in got}
    assert hours == {x for x in as_rows(changes.coalesce_changes(batch, every="10 minutes")) if x[0].timestamp() + 600 <= passed}
    assert edits == {x for x in as_rows(changes.sessions(batch, gap="1 minute")) if x[1].timestamp() <= passed}


def test_commit_is_all_or_nothing(spark):
    live = spark.createDataFrame([(1, "a", 3), (2, "b", 5)], "doc_id long, text string, revision int")
    staged = spark.createDataFrame([(1, "A", 3), (2, "B", 4)], "doc_id long, text string, base_revision int")
    assert {r.doc_id: r.status for r in versions.stage_commit(live, staged).collect()} == {1: "ready", 2: "conflict"}
    assert {tuple(r) for r in versions.apply_staged(live, staged).select("doc_id", "text", "revision").collect()} == {(1, "a", 3), (2, "b", 5)}
    assert {tuple(r) for r in versions.apply_staged(live, staged.where("doc_id = 1")).select("doc_id", "text", "revision").collect()} == {(1, "A", 4), (2, "b", 5)}


def test_exact_line_diff(spark):
    a = spark.createDataFrame([(1, "x\ny\nz"), (2, "same")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "x\nq\nz\nw"), (2, "same")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in versions.line_opcodes(a, b).orderBy("old_from", "new_from").collect()] == [("equal", 0, 1, 0, 1), ("replace", 1, 2, 1, 2), ("equal", 2, 3, 2, 3), ("insert", 3, 3, 3, 4)]


def test_streams_equal_batches(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(source)
    (tmp_path / "in").mkdir()
    batch.write.parquet(str(tmp_path / "in" / "events"))
    stream = changes.ingest(spark, str(tmp_path / "in" / "*"), changes.EVENTS)
    as_set = lambda df: {tuple(r) for r in df.collect()}
    got = changes.run_to_end(changes.subscribe(stream, ["click", "view", "purchase"]), "subscribed", str(tmp_path / "c2"))
    assert as_set(got) == as_set(changes.subscribe(batch, ["click", "view", "purchase"]))
    report = changes.run_to_end(stream.groupBy("event_type").count(), "report", str(tmp_path / "c3"), "complete")
    assert as_set(report) == as_set(batch.groupBy("event_type").count())
    counted = changes.run_to_end(changes.stream_revisions(stream), "revs", str(tmp_path / "c4"))
    assert as_set(counted.select("event_id", "user_id", "revision")) == as_set(changes.revisions(batch).select("event_id", "user_id", "revision"))
    hourly = changes.run_to_end(changes.coalesce_changes(stream, late="1000 days"), "hourly", str(tmp_path / "c5"), "update")
    assert as_set(hourly) == as_set(changes.coalesce_changes(batch))


def test_stream_recipe(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a  b"), (2, "c")], "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = changes.ingest(spark, str(tmp_path / "in"), "doc_id long, text string")
    rules = [search.Rule("blanks", "  +", " ")]
    got = changes.run_to_end(search.run_recipe(stream, rules).select("doc_id", "text", "n_1"), "recipe", str(tmp_path / "c"))
    assert {tuple(r) for r in got.collect()} == {(1, "a b", 1), (2, "c", 0)}


# archives


def test_archives(spark, tmp_path):
    def pack(name, entries):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            for k, v in entries.items():
                z.writestr(k, v)

    pack("good.epub", {"mimetype": "application/epub+zip", "Text/a.xhtml": "<p>x</p>"})
    pack("bad.epub", {"../evil": "x", "/abs": "y", "bomb": "0" * 3_000_000, "ok": "z"})
    (tmp_path / "none.epub").write_bytes(b"not a zip")
    rows = {(r.source.rsplit("/", 1)[1], r.bookpath): r for r in archives.scan_archives(spark, str(tmp_path / "*.epub")).collect()}
    assert {k: v.issue for k, v in rows.items()} == {
        ("good.epub", "mimetype"): None, ("good.epub", "Text/a.xhtml"): None, ("bad.epub", "../evil"): "unsafe path", ("bad.epub", "/abs"): "unsafe path", ("bad.epub", "bomb"): "ratio", ("bad.epub", "ok"): None,
        ("none.epub", None): "not an archive",
    }
    few = archives.scan_archives(spark, str(tmp_path / "good.epub"), archives.Limits(entries=1))
    assert sorted(r.issue or "" for r in few.collect()) == ["", "too many entries"]
    books = spark.createDataFrame([("b", "z.txt", b"zz"), ("b", "mimetype", b"m"), ("c", "only", b"1")], "book_id string, bookpath string, bytes binary")
    made = {r.book_id: zipfile.ZipFile(io.BytesIO(r.bytes)) for r in archives.write_archives(books).collect()}
    assert made["b"].namelist() == ["mimetype", "z.txt"] and made["b"].getinfo("mimetype").compress_type == zipfile.ZIP_STORED and made["c"].read("only") == b"1"


def test_package(spark):
    opf = "<package version='3.0'><metadata><dc:title>T</dc:title><meta name='cover' content='c1'/></metadata><manifest><item id='a' href='Text/a.xhtml' media-type='application/xhtml+xml'/><item id='a' href='Text/a.xhtml' media-type='x'/><item id='g' href='gone.css' media-type='text/css'/></manifest><spine><itemref idref='a'/><itemref idref='q' linear='no'/></spine></package>"
    tables = archives.package_tables(spark.createDataFrame([("b", "OPS/p.opf", opf)], "book_id string, bookpath string, text string"))
    assert {(r.name, r.content) for r in tables["metadata"].collect()} == {("dc:title", "T"), ("cover", "c1")}
    files = spark.createDataFrame([("b", "OPS/Text/a.xhtml"), ("b", "OPS/extra")], "book_id string, bookpath string")
    assert {(r.bookpath, r.issue) for r in archives.manifest_audit(files, tables["manifest"]).collect()} == {("OPS/extra", "not listed"), ("OPS/gone.css", "no file"), ("OPS/Text/a.xhtml", "repeated path"), ("a", "repeated id")}
    spine = archives.manifest_spine(tables["manifest"].where("media_type <> 'x'"), tables["spine"]).orderBy("pos").collect()
    assert [(r.id, r.linear, r.bookpath) for r in spine] == [("a", "yes", "OPS/Text/a.xhtml"), ("q", "no", None)]


@pytest.mark.parametrize(
    ("data", "want", "encoding"),
    [(b"\xef\xbb\xbfa\r\nb", "a\nb", "UTF-8"), ("é".encode("utf-16"), "é", "UTF-16LE"), ("ab".encode("utf-16-be"), "ab", "UTF-16BE"), (b"\xe9<meta charset=latin1>", "é<meta charset=latin1>", "ISO-8859-1"), (b"a\xffb", "aÿb", "ISO-8859-1"), (b"", "", "UTF-8")],
)
def test_decoding(spark, data, want, encoding):
    text, name = archives.decode_bytes("x")
    row = spark.createDataFrame([(data,)], "x binary").select(text.alias("t"), name.alias("e")).first()
    assert (row.t, row.e) == (want, encoding)


def test_headers_of_bytes(spark):
    png = bytes.fromhex("89504e470d0a1a0a0000000d49484452000002800000 01e0".replace(" ", ""))
    gif = b"GIF89a" + (300).to_bytes(2, "little") + (20).to_bytes(2, "little")
    w, h = archives.image_size("x")
    rows = spark.createDataFrame([(png,), (gif,), (b"OTTO",)], "x binary").select(w.alias("w"), h.alias("h"), archives.font_kind("x").alias("f")).collect()
    assert [tuple(r) for r in rows] == [(640, 480, "unknown"), (300, 20, "unknown"), (None, None, "opentype")]


def test_report_files(spark, tmp_path):
    archives.write_report(spark.createDataFrame([("a,b", 1)], "x string, n long"), str(tmp_path / "r"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "r"), header=True).collect()] == [("a,b", "1")]
