"""Kinds and risks of pages, and flows of pseudo paragraphs, on small pages."""

import pytest
from pyspark.sql import functions as F

from quire.operators import layout, pages
from quire.operators import tokens as M


def page(body, head="", html=""):
    return f"<html{html}><head><title>t</title>{head}</head><body>{body}</body></html>"


LONG = "<p>" + "word " * 100 + "</p>"
CASES = [
    (page(LONG), "already-horizontal", 0), (page("<p>short</p>"), "title-or-colophon", 0), ("<html><body><img src='a'/></body></html>", "image-only", 0), (None, "parse-error", None),
    (page(LONG, '<meta content="width=1, height=2" name="viewport"/>'), "fixed-layout", 30), (page(LONG, '<meta name="viewport" content="width=device-width"/>'), "already-horizontal", 0),
    (page(LONG, html=' style="writing-mode: vertical-rl"'), "reflow-vertical-safe", 0), (page("<p>x</p>", html=" style='-webkit-writing-mode:tb-rl !important'"), "reflow-vertical-safe", 0),
    (page(LONG, "<style>.v{writing-mode:vertical-rl}.h{writing-mode:horizontal-tb}</style>"), "mixed-writing-mode", 15), (page("<svg><text>x</text></svg>" + LONG, html=" style='writing-mode:vertical-lr'"), "svg-text-layout", 20),
    (page("<svg></svg><text>x</text>" + LONG, html=" style='writing-mode:vertical-lr'"), "reflow-vertical-safe", 0), (page("<nav epub:type='x toc'>" + LONG + "</nav>"), "toc-or-nav", 5), (page("<nav>" + LONG + "</nav>"), "already-horizontal", 0),
    (page("<script>a</script><p style='position: absolute'>x</p>" + LONG), "script-driven", 20), (page("<i style='position:absolute'>x</i>" * 3 + LONG), "already-horizontal", 20),
    (page("<script>a</script>" + "<i style='position:absolute;transform:rotate(1deg)'>x</i>" * 3 + LONG, html=" style='writing-mode:vertical-rl'"), "script-driven", 45),
    (page("<i style='position:absolute;transform:ROTATE(1deg)'>x</i>" * 3 + "<svg><text>y</text></svg><nav role='doc-toc'></nav>" + LONG, html=" style='writing-mode:vertical-rl'"), "svg-text-layout", 60),
    (page("/* */" + LONG, "<style>/* writing-mode:vertical-rl; */ p{margin:0}</style>"), "already-horizontal", 0), (page("<p>&nbsp;&amp;</p><img src='x'/>").replace("<title>t</title>", ""), "image-only", 0),
]


def test_layout(spark):
    df = spark.createDataFrame([(k, x) for k, (x, _, _) in enumerate(CASES)], "page_id long, html string")
    got = {r.page_id: r for r in layout.layout(df).collect()}
    assert [(got[k].kind, got[k].risk if x else None) for k, (x, _, _) in enumerate(CASES)] == [(kind, risk) for _, kind, risk in CASES]
    assert [r.level for r in spark.createDataFrame([(0,), (24,), (25,), (50,), (75,)], "s long").select(layout.level("s").alias("level")).collect()] == ["auto-safe", "auto-safe", "auto-safe-with-warnings", "manual-review", "unsupported"]
    bad = spark.createDataFrame([(0, False), (1, True)], "page_id long, balanced boolean")
    assert {r.page_id: r.kind for r in layout.layout(df.where("page_id < 2"), bad).collect()} == {0: "parse-error", 1: "title-or-colophon"}
    extra = layout.risk(layout.sheet_points(F.lit(True), F.lit(True), F.lit(True), F.lit(2)), F.lit(True))
    assert layout.signals(df.where("page_id = 0")).select(extra.alias("r")).first().r == 45
    assert layout.layout(df.limit(0)).count() == 0


def kinds(spark, fn, bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "page_id long, html string")
    got = {r.page_id: r.kind for r in fn(df).collect()}
    return [got[k] for k in range(len(bodies))]


def test_break_flows(spark):
    lines = "<br/>".join(["one line"] * 6)
    want = [
        (page("<p>x</p>"), "already-normalized"), (page("<div>" + "y" * 200 + "</div>"), "block-layout"), (page("<div>y</div>"), "image-or-title-page"), (page("Table of<br/>Contents"), "toc-like"), (page("<a href='x'>a</a><br/><a href='y'>b</a><br/>c"), "toc-like"),
        (page("<img src='x'/>a<br/>b"), "image-or-title-page"), (page("text only"), "no-candidate"), (page("<br/> <br/>"), "no-candidate"), (page("発行日<br/>ISBN 1<br/>a<br/>b<br/>c<br/>d"), "notice-or-imprint"), (page("a<br/>b"), "short-flow"), (page(lines), "normal-body-flow"), ("<html></html>", "no-body"),
    ]
    assert kinds(spark, layout.br_flow_kind, [x for x, _ in want]) == [x for _, x in want]


def test_spacer_flows(spark):
    gap, flat = "<p style='height: 1.5em'> </p>", '<p class="z" style="height:0"></p>'
    want = [
        (page(gap.join(["one line"] * 13)), "normal-body-flow"), (page(flat.join(["one line"] * 13)), "normal-body-flow"), (page(gap.join(["one line"] * 5)), "short-flow"), (page("<p>x</p>" + gap), "already-normalized"), (page("x<div>y</div>" + gap), "image-or-title-page"),
        (page("x" * 200 + "<div>y</div>" + gap), "block-layout"), (page("x<p id='a' style='height:1em'></p>y"), "image-or-title-page"), (page("text"), "no-candidate"), (page("<img src='x'/>a" + gap + "b"), "image-or-title-page"), (page("複製" + gap + "b"), "notice-or-imprint"),
        (page(gap.join(f"<a href='{k}'>l</a>" for k in range(4))), "toc-like"), ("<html></html>", "no-body"),
    ]
    assert kinds(spark, layout.kfx_flow_kind, [x for x, _ in want]) == [x for _, x in want]


@pytest.mark.parametrize("wrap", ["<div>{}</div>", "<div><div class='w'>{}</div></div>"])
def test_div_flows(spark, wrap):
    def fn(df):
        els = M.elements(df)
        return layout.div_flow_kind(df, els, pages.element_texts(df, els))

    many = "<div>one line of text</div>" * 12
    inner = [
        (many, "normal-body-flow"), (many.replace("<div>", "<div><span>").replace("</div>", "</span></div>"), "normal-body-flow"), ("<div>one line</div>" * 3, "short-flow"), (many + "<div><br/></div><div>＊＊＊</div><div><img src='x'/></div><h2>h</h2>", "normal-body-flow"),
        (many + "<div><div>a</div><div>b</div></div>", "block-layout"), (many + "<div><div>a</div></div>", "normal-body-flow"), (many + "loose text", "no-candidate"), ("<p>a</p>" * 9, "no-candidate"), ("<div>Copyright</div>" * 5, "notice-or-imprint"),
        ("<ul>" + "<li>x</li>" * 9 + "</ul>", "no-candidate"), (many.replace("one", "Contents"), "toc-like"),
    ]
    assert kinds(spark, fn, [page(wrap.format(x)) for x, _ in inner]) == [x for _, x in inner]
    assert kinds(spark, fn, ["<html><body>" + wrap.format(many) + "</body></html>", page(wrap.format(many)).replace("<body>", "<body class='p-image'>")]) == ["no-candidate", "image-or-title-page"]
