"""Writing direction of books: declarations, pages, packages and the gate of a book."""

import pytest
from pyspark.sql import functions as F

from quire.operators import direction


def value(spark, column, x):
    return spark.createDataFrame([(x,)], "x string").select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("style", "want"),
    [
        ("writing-mode: vertical-rl", "writing-mode: horizontal-tb"), (" color:red ;-epub-writing-mode:tb-rl !important ; margin:0; ", " color:red ;-epub-writing-mode:horizontal-tb !important ; margin:0; "),
        ("writing-mode:horizontal-tb;", "writing-mode:horizontal-tb;"), ("writing-mode: verticalish", "writing-mode: verticalish"), ("x-writing-mode: tb", "x-writing-mode: tb"), ("", ""),
    ],
)
def test_style_values(spark, style, want):
    assert value(spark, direction.style_value("x"), style) == want


@pytest.mark.parametrize(
    ("css", "want"),
    [
        ("p { writing-mode : vertical-rl; color:red }", "p { writing-mode : horizontal-tb; color:red }"), ("/* a{writing-mode:tb} */ a{writing-mode:tb ! important}", "/* a{writing-mode:tb} */ a{writing-mode:horizontal-tb !important}"),
        ("a{text-orientation:upright; text-combine-upright : all;color:red}", "a{color:red}"), ("@media print { .v{-webkit-writing-mode:vertical-rl} } b{}", "@media print { .v{-webkit-writing-mode:horizontal-tb} } b{}"),
        ("a{font-feature-settings: 'vert' 1, \"kern\" on;x:y}", "a{font-feature-settings: \"kern\" on;x:y}"), ("a{font-feature-settings:'vert','vrt2' on;x:y}", "a{x:y}"), ("a{font-feature-settings:'vert' off}", "a{font-feature-settings:'vert' off}"), ("", ""), ("a{", "a{"),
    ],
)
def test_sheets(spark, css, want):
    assert value(spark, direction.css_rewritten("x"), css) == want


def test_sheets_to_the_vertical_keep_horizontal_parts(spark):
    css = "html, body{writing-mode:horizontal-tb} p{writing-mode:lr-tb; text-orientation:mixed}"
    assert value(spark, direction.css_rewritten("x", to_horizontal=False), css) == "html, body{writing-mode:vertical-rl} p{writing-mode:lr-tb; text-orientation:mixed}"
    assert "p{writing-mode:vertical-rl;" in value(spark, direction.css_rewritten("x", to_horizontal=False, root_only=False), css)


@pytest.mark.parametrize("spine", ["<spine>", "<spine toc='n'>", '<spine page-progression-direction="rtl" toc="n">', "<opf:spine page-progression-direction='default'>"])
def test_spines_go_back(spark, spine):
    opf = f"<package>\n{spine}<itemref/></spine></package>"
    there, problem = direction.spine_rewritten("x")
    turned = value(spark, there, opf)
    assert "page-progression-direction=" in turned and "ltr" in turned and "applied=ltr" in turned and value(spark, problem, opf) is None
    assert value(spark, there, turned) == turned
    assert value(spark, direction.spine_rewritten("x", to_horizontal=False)[0], turned) == opf
    by_hand = turned.replace('direction="ltr"', 'direction="rtl"').replace("direction='ltr'", "direction='rtl'")
    assert value(spark, problem, by_hand) == "page progression changed by hand" and value(spark, there, by_hand) == by_hand


@pytest.mark.parametrize(("opf", "problem"), [("<package/>", "no spine"), ('<spine page-progression-direction="up"/>', "invalid page progression")])
def test_spine_problems(spark, opf, problem):
    assert value(spark, direction.spine_rewritten("x")[1], opf) == problem


def test_books_convert_whole_or_not_at_all(spark):
    page = "<html class='a'><head><title>t</title><script>x='<p style=\"writing-mode:tb\">'</script></head><body style=\"writing-mode:vertical-rl\"><p id='i'>漢<ruby>字<rt>じ</rt></ruby><a href='x.html'>x</a></p></body></html>"
    opf, css = "<package><spine></spine></package>", "body{writing-mode:vertical-rl}"
    files, modes = [], []
    for b in "ABCDEF":
        files += [(b, "p1.html", "html", page if b != "B" else page.replace("<head>", "").replace("</head>", "")), (b, "p2.html", "html", page), (b, "s.css", "css", css), (b, "c.opf", "opf", "<package/>" if b == "C" else opf), (b, "n.html", "html", None)]
        modes += [(b, "p1.html", "horizontal" if b == "D" else "vertical", b == "E", 10), (b, "p2.html", "horizontal" if b == "D" else "vertical", False, 60 if b == "F" else None)]
    files += [("A", "p2.html", "html", page), (None, "p.html", "html", page)]
    df = spark.createDataFrame(files, "book string, path string, kind string, text string")
    out, verdicts = direction.convert_books(df, spark.createDataFrame(modes, "book string, path string, mode string, fixed boolean, risk int"))
    told = {r.book: (r.n_pages, r.problems, r.converted) for r in verdicts.collect()}
    assert told == {
        "A": (3, [], True), "B": (2, ["p1.html: no root or head"], False), "C": (2, ["c.opf: no spine"], False), "D": (0, [], False), "E": (1, [], True), "F": (1, [], True), None: (0, [], False),
    }
    rows = out.collect()
    assert len(rows) == len(files)
    changed = {(r.book, r.path) for r in rows if r.changed}
    assert changed == {("A", "p1.html"), ("A", "p2.html"), ("A", "s.css"), ("A", "c.opf"), ("E", "p2.html"), ("E", "s.css"), ("F", "p1.html"), ("F", "s.css"), ("F", "c.opf")}
    made = next(r.text for r in rows if (r.book, r.path) == ("A", "p1.html"))
    assert "<html class='v2h-horizontal a'>" in made and 'body style="writing-mode:horizontal-tb"' in made and "x='<p style=\"writing-mode:tb\">'" in made and made.count("<style class=") == 1
    back, _ = direction.convert_books(out.drop("changed"), out.where("kind = 'html'").select("book", "path", F.lit("horizontal").alias("mode"), F.lit(False).alias("fixed"), F.lit(0).alias("risk")).where("book = 'A' and path <> 'n.html'").distinct(), to_horizontal=False)
    again = {(r.book, r.path): r.text for r in back.collect() if r.book == "A"}
    assert again["A", "p1.html"] == page.replace("vertical-rl", "vertical-rl") and again["A", "c.opf"] == opf and again["A", "s.css"] == css
    assert direction.convert_books(df.limit(0), spark.createDataFrame(modes, "book string, path string, mode string, fixed boolean, risk int"))[0].count() == 0


def test_page_classes_are_exchanged(spark):
    page = '<html class="x vrtl y"><head></head><body><p>t</p></body></html>'
    assert value(spark, direction.page_rewritten("x", page_class=F.lit(True)), page) == page.replace("vrtl", "hltr")


@pytest.mark.parametrize(("after", "problem"), [("<p id=a>y<a href=z></a></p>", "visible text differs"), ("<p id=b>x<a href=z></a></p>", "ids differ"), ("<p id=a>x<a href=w></a></p>", "links differ"), ("<p id=a>x<img><a href=z></a></p>", "elements differ"), ("<p id=a class=c>x<a href=z></a></p>", None)])
def test_invariants(spark, after, problem):
    row = spark.createDataFrame([("<p id=a>x<a href=z></a></p>", after)], "a string, b string")
    assert row.select(direction.invariant_problem("a", "b").alias("v")).first().v == problem
