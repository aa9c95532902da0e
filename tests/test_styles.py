"""Inline styles as classes, and classes renamed in pages and sheets together."""

import pytest
from pyspark.sql import functions as F

from quire.operators import styles
from quire.operators import tokens as M


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")


@pytest.mark.parametrize(
    ("style", "want"),
    [
        ("B:2;  a : 1 ", "a: 1; b: 2"), ("a:1;a:2;;c", "a: 2"), ("margin-left:1px; margin:2px", "margin-left: 1px; margin: 2px"), ("margin:2px;margin-left:1px", "margin: 2px; margin-left: 1px"),
        ("background:url(a;b:c) ; content:'x;y: z'", "background: url(a;b:c); content: 'x;y: z'"), ("", ""), ("a:", ""), ("a:b:c", "a: b:c"),
    ],
)
def test_declarations(spark, style, want):
    assert spark.createDataFrame([(style,)], "x string").select(styles.body(styles.declarations("x")).alias("v")).first().v == want


def test_every_element_says_the_same(spark):
    docs = frame(
        spark,
        "<html><head><script>x='<p style=\"q:r\">'</script></head><body style='color:red'><p class=\"k l\" style=\"margin:0; COLOR: red\">a</p><p style='color:red;margin:0;'>b</p><br style=''/></body></html>",
        "<p STYLE=color:red class=auto_9>c</p>", "<p>none</p>", None, "<HEAD></HEAD><b class='' style='$1:\\2'>d</b>",
    )
    made, rules = styles.extract_inline_styles(docs, "s.css")
    bodies = {r["class"]: r.body for r in rules.collect()}
    assert not any(c.startswith("auto_9") for c in bodies) and len(set(bodies.values())) == len(bodies) == 3

    def said(df, of):
        els = df.where("html is not null").select("page_id", "html")
        rows = M.tokens(els, positions=False, whole=True).where("ttype in ('begin', 'single') and tname <> 'link'").withColumn("a", M.attributes("tok")).orderBy("doc", "seq").collect()
        found = {}
        for r in rows:
            found.setdefault(r.doc, []).append((r.tname, of(r.a), [c for c in r.a.get("class", "").split() if c not in bodies]))
        return found

    canonical = {r.style: r.b for r in M.tokens(docs, positions=False).where("ttype in ('begin', 'single')").select(M.attributes("tok")["style"].alias("style")).where("style is not null").select("style", styles.body(styles.declarations("style")).alias("b")).collect()}
    before = said(docs, lambda a: canonical.get(a.get("style", ""), ""))
    after = said(made, lambda a: "".join(bodies.get(c, "") for c in a.get("class", "").split()) if "style" not in a else "left")
    assert after == {k: v for k, v in before.items() if k in (0, 1, 4)}
    texts = {r.page_id: (r.html, r.n) for r in made.collect()}
    assert "x='<p style=\"q:r\">'" in texts[0][0] and texts[0][1] == 4 and '<link rel="stylesheet" type="text/css" href="s.css"/></head>' in texts[0][0] and 'class="k l auto_' in texts[0][0]
    css = styles.sheet(rules).first().css
    assert all(f".{c} {{{b}}}" in css for c, b in bodies.items())


@pytest.mark.parametrize(
    ("css", "want"),
    [
        (".a, p.b > .a-x{c:url(x.a)}", ".b, p.a > .a-x{c:url(x.a)}"), ("/* .a{} */ @media x { .a.b{} } [href$='.a'].b{}", "/* .a{} */ @media x { .b.a{} } [href$='.a'].a{}"), (".a{d:'}.a{'}", None), ("a.1 .a", "a.1 .a"), ("", ""),
    ],
)
def test_renames_exchange_names(spark, css, want):
    got = spark.createDataFrame([(css,)], "x string").select(styles.css_renamed("x", {"a": "b", "b": "a"}).alias("v")).first().v
    assert want is None or got == want


def test_pages_and_sheets_change_together(spark):
    docs = frame(spark, "<style>p.a{x:y}</style><p class=a id='a'>.a<b class='b\n c a'></b></p>", "<p class='ab'>a</p>", None)
    sheets = spark.createDataFrame([("1.css", ".a{}"), ("2.css", ".c{}"), ("3.css", None)], "path string, css string")
    made, css = styles.rename_classes(docs, sheets, {"a": "b", "b": "a"})
    assert [tuple(r) for r in made.collect()] == [(0, "<style>p.b{x:y}</style><p class=b id='a'>.a<b class='a\n c b'></b></p>")]
    assert [tuple(r) for r in css.collect()] == [("1.css", ".b{}")]
    assert styles.rename_classes(docs, sheets, {})[0].count() == 0
    again, _ = styles.rename_classes(made, css, {"a": "b", "b": "a"})
    assert again.first().html == docs.where(F.col("page_id") == 0).first().html
