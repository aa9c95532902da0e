"""Operators do the whole job: large groups, limits, and odd input."""

import io
import re
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.catalog import derived, markup, register
from quire.operators import checks, chinese, layout, links, navigation, pages, structure, words
from quire.operators import tokens as M
from quire.plans import scratch, shares
from quire.sources import archives


def test_archive_volumes(spark):
    rows = [("b", f"Text/{i}", b"x" * 100) for i in range(300)] + [("b", "mimetype", b"m"), ("s", "Text/1", b"y"), ("s", "mimetype", b"m"), (None, "n", b"z")]
    books = spark.createDataFrame(rows, "book_id string, bookpath string, bytes binary")
    for by_rows, by_size in ((50, 1 << 20), (1000, 5000)):
        made = archives.write_archives(books, by_rows, by_size)
        got = made.collect()
        large = [zipfile.ZipFile(io.BytesIO(r.bytes)) for r in sorted(got, key=lambda r: r.volume) if r.book_id == "b"]
        assert 5 <= len(large) <= 7 and max(len(z.namelist()) for z in large) < 100 and large[0].namelist()[0] == "mimetype"
        assert [r.volume for r in got if r.book_id != "b"] == [0, 0]
        back = archives.unpacked(made.select(F.col("book_id").alias("path"), F.col("bytes").alias("content")))
        assert sorted(((r.source, r.bookpath, bytes(r.bytes)) for r in back.collect()), key=repr) == sorted(rows, key=repr)


def test_entries_beyond_a_limit(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(5):
            z.writestr(f"e{i}", b"x" * 10)
    files = spark.createDataFrame([("a", out.getvalue())], "path string, content binary")
    for limits, issue in ((archives.Limits(entries=2), "too many entries"), (archives.Limits(total_bytes=25), "archive too large")):
        got = [(r.bookpath, r.bytes is None, r.issue) for r in archives.unpacked(files, limits).collect()]
        assert got == [("e0", False, None), ("e1", False, None), *((f"e{i}", True, issue) for i in (2, 3, 4))]


def test_names_of_large_groups(spark):
    df = spark.range(0, 25_000, 1, 8).select((F.col("id") * 7919 % 25_000).alias("k"), F.when(F.col("id") % 1000 == 0, "b").when(F.col("id") % 1000 != 1, "a").alias("p"))
    rows = sorted((r.k, r.p) for r in df.collect())
    want, n = {}, {"a": 0, "b": 0}
    for k, p in rows:
        if p:
            n[p] += 1
        want[k] = f"{p}{n[p]:04d}" if p else None
    got = {r.k: r.name for r in words.unique_names(df, "p", "k").collect()}
    assert got == want and n["a"] > 10_000


def test_packages_are_bounded(spark, tmp_path, monkeypatch):
    docs = spark.range(2500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 3 > 0, "en").otherwise("de").alias("lang"), F.when(F.col("id") < 2400, "a/b").otherwise("c").alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen, tables = [], archives.package_tables
    monkeypatch.setattr(archives, "package_tables", lambda r: seen.append(r) or tables(r))
    got = sorted((r.book_id, r.place, r.bookpath) for r in derived.manifest_spine(spark, str(tmp_path)).collect())
    english = [[i for i in x if i % 3] for x in (range(2400), range(2400, 2500))]
    assert got == sorted((b, k, f"OPS/Text/{i}.xhtml") for b, x in zip(("a/b", "c"), english, strict=True) for k, i in enumerate(x, 1))
    assert sorted(r.text.count("<item ") for r in seen[0].collect()) == [100, 400, 1000, 1000]
    assert derived.package_tables(spark, str(tmp_path)).distinct().count() == 2500
    assert sorted(r.book_id for r in derived.ensure_uuid(spark, str(tmp_path)).collect()) == ["a/b", "c"]


def test_pages_of_a_file_name(spark, tmp_path):
    rows = [(1, "http://b/x/A.html", ""), (2, "http://c/a.HTML?q", ""), (3, "http://b/y/c.html", ""), (4, "http://b/", ""), (5, "http://c/x/", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = derived.path_end_match(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.tail_of) for r in found) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (4, 4), (4, 5), (5, 4), (5, 5)]


def test_pages_of_a_frequent_file_name(spark, tmp_path, monkeypatch):
    names = ["http://b/", "http://c/x/", "http://c/X/a.html", "http://c/y/A.html", None]
    spark.createDataFrame([(k, names[min(k // 20, 4)], "") for k in range(85)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(links, "BLOCK", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for large tables
    try:
        parts = derived.path_end_match(spark, str(tmp_path)).rdd.glom().map(lambda x: [tuple(r) for r in x]).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r for x in parts for r in x) == sorted((i, j) for m in (0, 40) for i in range(m, m + 40) for j in range(m, m + 40))
    # the pairs of a name lie in several tasks
    assert max(map(len, parts)) < 1600 and sum(1 for x in parts if any(r[0] < 40 for r in x)) > 1
    tails = spark.createDataFrame([("X/A.html", 1), ("", 2), ("b.html", 3), (None, 4), ("html", 5)], "tail string, n int")
    ended = links.path_end_match(links.resources_of(spark.read.parquet(str(tmp_path / "pages.parquet"))), tails)
    assert sorted((r.n, r.page_id, r.path, r.tail) for r in ended.collect()) == sorted([*((1, k, "X/a.html", "X/A.html") for k in range(40, 60)), *((2, k, "x/" if k > 19 else "", "") for k in range(40))])


def test_partitions_grow_with_the_input(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "pages")
    spark.range(60).selectExpr("id as page_id", "concat('<p>', repeat(sha2(string(id), 512), 50), '</p><!-- -->') as html").write.parquet(at)
    table = spark.read.parquet(at)
    rows = lambda: M.tokens(table, positions=False).rdd.glom().map(len).collect()
    few = len(rows())
    monkeypatch.setattr(shares, "SHARE", shares.input_bytes(table) // 20)
    many = rows()
    assert few == spark.sparkContext.defaultParallelism and len(many) >= 20 and sum(many) == 240 and max(many) < 60
    # a table of unknown size, and one with no tokens
    assert M.elements(spark.createDataFrame([(1, ""), (2, None), (3, "<p>")], "page_id long, html string")).count() == 1


def test_elements_are_found_once(spark):
    page = "<html><head></head><body><div><div>one</div><div>***</div><div> </div><div>two</div></div></body></html>"
    made = spark.createDataFrame([(1, page)], "page_id long, html string")
    els = M.elements(made)
    texts = pages.element_texts(made, els)
    leaves = {(r.eid, r.leaf) for r in layout.leaf_kinds(els, texts).where("tname = 'div'").collect()}
    assert leaves == {(r.eid, r.leaf) for r in layout.leaf_kinds(els, layout._said(texts)).where("tname = 'div'").collect()}
    assert sorted(x for _, x in leaves) == ["nested-complex", "other", "paragraph", "paragraph", "scene-break"]
    plan = layout.div_flow_kind(made, els, texts)._jdf.queryExecution().optimizedPlan().toString()
    assert "own_text" not in plan


def test_flows_of_divs_are_never_sent_whole(spark, tmp_path):
    rows = [(1, "\n".join(["one line"] * 12)), (2, "a\n\nb\nc\nd"), (3, "one line"), (4, ""), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = derived.div_flow_kind(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    # no table of elements goes through the driver, however well it packs
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 8
    assert sorted((r.doc_id, r.n_paragraphs, r.kind) for r in found.collect()) == [(1, 12, "normal-body-flow"), (2, 4, "short-flow"), (3, None, "no-candidate"), (4, None, "no-candidate")]


PAGE = "<html lang=de><head><meta a=b></head><body><p>x</p><code lang=fr>y<p>z</p></code><meta>t</body></html>"


def selected(spark, tmp_path, key):
    """Rows of a selector's query, and how often its plan takes texts apart."""
    spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, "u", "")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    made = register.QUERIES[key](spark, str(tmp_path))
    return sorted((r.page_id, r.eid) for r in made.collect()), made._jdf.queryExecution().optimizedPlan().toString().count("posexplode")


def test_empty_elements_are_found_once(spark, tmp_path):
    assert selected(spark, tmp_path, "sel_empty_root") == ([(1, 2), (1, 14)], 1)


def test_empty_elements_are_those_without_texts_and_children(spark, tmp_path):
    page = "<html><body><p></p><p>x</p><p> </p><div><br></div><div><!-- c --></div><i><b></b></i><u><script>s</script></u><a/><em>y</body></html>"
    spark.createDataFrame([(1, "u", page), (2, "u", "<hr>"), (3, "u", "<html>"), (4, "u", None)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = register.QUERIES["sel_empty_root"](spark, str(tmp_path))
    want = [(1, 2, "p"), (1, 11, "br"), (1, 13, "div"), (1, 17, "b"), (1, 20, "u"), (1, 22, "a"), (2, 0, "hr"), (3, 0, "html")]
    assert sorted(tuple(r) for r in found.collect()) == want
    db = duckdb.connect()
    db.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(db.sql(register.ORACLE_SQL["sel_empty_root"]).fetchall()) == want
    # no table of elements goes through the driver
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_languages_are_found_once(spark, tmp_path):
    assert selected(spark, tmp_path, "sel_lang") == ([(1, 5)], 0)


def test_conversion_takes_texts_apart_twice(spark):
    rows = [(1, PAGE), (2, None), (3, ""), (None, "<p>x</p>"), (4, "<p lang=ja>x<i lang=de>x<code>x</code></i>x</p>x")]
    made = chinese.convert(spark.createDataFrame(rows, "page_id long, html string"), [[("x", "w"), ("z", "v")]])
    got = {r.page_id: (r.html, r.changes, r.skipped_japanese, r.skipped_protected) for r in made.collect()}
    first = PAGE.replace(">x<", ">w<")
    assert got == {1: (first, 1, 0, 2), 2: (None, 0, 0, 0), 3: ("", 0, 0, 0), None: ("<p>x</p>", 0, 0, 0), 4: ("<p lang=ja>x<i lang=de>w<code>x</code></i>x</p>w", 2, 2, 1)}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 2


def test_texts_are_asked_of_few_elements(spark, tmp_path, monkeypatch):
    written, table = [], scratch.Scratch.table
    monkeypatch.setattr(scratch.Scratch, "table", lambda self, df, name: written.append(df.columns) or table(self, df, name))
    assert selected(spark, tmp_path, "sel_text") == ([], 1)
    assert [sorted(x) for x in written] == [["alone", "doc", "eid", "end_seq", "matched", "tname", "tok"]]


def pieces(df):
    """How often a plan takes texts apart, and the numbers of partitions it asks for."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("posexplode"), [int(x) for x in re.findall(r"RepartitionByExpression \[doc[^\]]*\], (\d+)", plan)]


def menus(spark, tmp_path, monkeypatch):
    """A table of menus, in shares of a twentieth of it."""
    page = "<nav epub:type=toc><ol><li><a href=a>A <b>x</b></a><ul><li><a href=b>B</a></li></ul></li></ol></nav><nav epub:type=page-list><a href=c>1</a></nav><a href=d>out</a>"
    spark.range(40).selectExpr("id as page_id", f"concat('{page}', repeat(sha2(string(id), 512), 20)) as html").write.parquet(str(tmp_path / "menus"))
    made = spark.read.parquet(str(tmp_path / "menus"))
    monkeypatch.setattr(shares, "SHARE", shares.input_bytes(made) // 20)
    return made


def test_shares_of_menus(spark, tmp_path, monkeypatch):
    made = menus(spark, tmp_path, monkeypatch)
    found = navigation.nav_tables(made, M.elements(made))
    n, parts = pieces(found)
    assert n == 1 and len(parts) >= 4 and min(parts) >= 20
    assert sorted((r.section, r.pos, r.lvl, r.title, r.href) for r in found.where("doc = 7").collect()) == [("page-list", 1, 0, "1", "c"), ("toc", 1, 1, "A x", "a"), ("toc", 2, 2, "B", "b")]


def test_menus_are_read_once(spark, tmp_path, monkeypatch):
    made = menus(spark, tmp_path, monkeypatch)
    files = navigation.ncx(navigation.nav_tables(made, M.elements(made)))
    assert pieces(files) == (0, [])
    got = [(r.section, r.pos, r.lvl, r.title, r.href) for r in navigation.read_ncx(files).where("doc = 7").collect()]
    assert sorted(got) == [("page-list", 1, 1, "1", "c"), ("toc", 1, 1, "A x", "a"), ("toc", 2, 2, "B", "b")]


def test_checks_take_pages_apart_three_times(spark):
    page = "<html><head></head><body>\n<p>a<p>b</p></br><u>\n<p>c</body></html>"
    found = checks.issues(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string"))
    assert sorted((r.code, r.line, r.col) for r in found.where("doc = 1").collect()) == [("nested-p", 2, 5), ("nested-p", 3, 1), ("unclosed", 2, 1), ("unclosed", 2, 18), ("unclosed", 3, 1), ("void-end", 2, 13)]
    assert found.where("doc > 1").groupBy("doc").agg(F.count("*").alias("n"), F.max("line").alias("line"), F.max("col").alias("col")).orderBy("doc").collect() == [(2, 3, 1, 1), (3, 3, 1, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert pieces(found)[0] == 3 and plan.count("Join") == 1


TITLED = "<body><h2>A <i>b</i>\n c</h2><h3>B</h3><h5>C</h5><h4></h4><h1>D</h1><p>x</p><h7>y</h7><h2>E</h2></body>"


def test_contents_have_all_headings(spark, tmp_path):
    rows = [(1, "http://b/x/a.html", TITLED), (2, "http://b/c.html", "<h6>Z</h6>"), (3, "http://c/d.html", "<p>h1</p>"), (4, "http://c/e.html", None), (5, "http://c/", "<h1>F")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    made = register.QUERIES["build_toc"](spark, str(tmp_path))
    want = [
        ("b", "c.html", 0, 6, 1, "Z", "c.html"), ("b", "x/a.html", 1, 2, 1, "A b c", "x/a.html"), ("b", "x/a.html", 8, 3, 2, "B", "x/a.html#h8"), ("b", "x/a.html", 11, 5, 3, "C", "x/a.html#h11"),
        ("b", "x/a.html", 14, 4, 3, "", "x/a.html#h14"), ("b", "x/a.html", 16, 1, 1, "D", "x/a.html#h16"), ("b", "x/a.html", 25, 2, 2, "E", "x/a.html#h25"), ("c", "", 0, 1, 1, "F", ""),
    ]
    assert sorted(tuple(r) for r in made.select("book", "path", "seq", "level", "lvl", "title", "href").collect()) == want
    db = duckdb.connect()
    db.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(db.sql(f"select book, path, seq, level, lvl, title, href from ({register.ORACLE_SQL['build_toc']})").fetchall()) == want
    # each heading is written once, texts are taken apart for the titles
    assert pieces(made)[0] == 1
    # a book's navigation page has no entries
    found = markup.docs(spark, str(tmp_path))
    nav = spark.createDataFrame([("b", "x/a.html"), ("c", "c.html")], "book string, path string")
    rest = structure.build_toc(structure.headings(found, M.spans(found)), links.resources_of(found), nav)
    assert sorted((r.book, r.path, r.seq) for r in rest.collect()) == [("b", "c.html", 0), ("c", "", 0)]


LIST = "<h1>x</h1><nav><ul><li><a href=a>a</a></li><li><a href=b>b</a></li><li>c</li><li><a href=d>d</a></li></ul></nav><p>y</p><ul><li>z</li></ul>"


@pytest.mark.parametrize(("key", "wanted", "rows"), [
    ("sel_child_desc", ["parent_eid"], ["a", "a", "a"]), ("sel_group", ["child_no", "parent_eid"], ["h1", "li", "li"]),
    ("sel_not_has", ["child_no", "n_children", "parent_eid"], ["li", "li"]), ("sel_sibling", ["child_no", "parent_eid"], ["p"]),
])
def test_selectors_read_what_they_need(spark, tmp_path, monkeypatch, key, wanted, rows):
    written, table = [], scratch.Scratch.table
    monkeypatch.setattr(scratch.Scratch, "table", lambda self, df, name: written.append(sorted(df.columns)) or table(self, df, name))
    monkeypatch.setattr(shares, "SHARE", 100)
    spark.createDataFrame([(1, "u", LIST)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = register.QUERIES[key](spark, str(tmp_path))
    assert sorted(r.tname for r in found.collect()) == rows and written == [sorted(["doc", "eid", "tname", "end_seq", *wanted])]
    n, parts = pieces(found)
    # windows and joins over a document's elements are in shares too
    assert n == 0 and (key in ("sel_group", "sel_sibling") or len(parts) >= 3 and min(parts) > spark.sparkContext.defaultParallelism)


@pytest.mark.parametrize(("key", "want"), [("element_at", 120), ("text_blocks", 40)])
def test_shares_of_texts(spark, tmp_path, monkeypatch, key, want):
    at = str(tmp_path / "pages.parquet")
    spark.range(40).selectExpr("id as page_id", "'u' as url", "concat('<body><p>a<b>', repeat(sha2(string(id), 512), 20), '</b>c</p></body>') as html").write.parquet(at)
    monkeypatch.setattr(shares, "SHARE", shares.input_bytes(spark.read.parquet(at)) // 20)
    found = register.QUERIES[key](spark, str(tmp_path))
    sizes = found.rdd.glom().map(len).collect()
    assert len(sizes) >= 20 and sum(sizes) == want and pieces(found)[0] == 2 and min(pieces(found)[1]) >= 20


LOOSE = "<body><p>a<b>b<i>c</b>d</i><div>e</div>f<br></body>g<p>h"


def windows(spark, tmp_path, key):
    """Rows of a query on a page of unclosed and crossing tags, and how many windows its plan has."""
    spark.createDataFrame([(1, "u", LOOSE), (2, "u", None), (3, "u", "x")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = register.QUERIES[key](spark, str(tmp_path))
    return sorted(tuple(r) for r in found.collect()), found._jdf.queryExecution().optimizedPlan().toString().count("Window [")


def test_innermost_elements_need_no_tree(spark, tmp_path):
    deep = [(2, 1, "body/p"), (4, 3, "body/p/b"), (6, 5, "body/p/b/i"), (8, 5, "body/p/b/i"), (11, 10, "body/p/b/i/div"), (13, 5, "body/p/b/i")]
    assert windows(spark, tmp_path, "element_at") == ([(1, *x, True) for x in deep] + [(1, 18, 17, "p", False)], 8)


def test_blocks_need_no_tree(spark, tmp_path):
    assert windows(spark, tmp_path, "text_blocks") == ([(1, 1, "abcdf"), (1, 10, "e"), (1, 17, "h")], 8)


def test_languages_of_texts_need_no_tree(spark, tmp_path):
    assert windows(spark, tmp_path, "token_lang") == ([*((1, x, "en") for x in (2, 4, 6, 8, 11, 13, 16, 18)), (3, 0, "en")], 8)
