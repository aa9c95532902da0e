"""Kinds of pages: their layout with its risk, and flows of pseudo paragraphs set apart by breaks, spacers or divs.

Signals of a page are columns over its own markup, without a shuffle; only div flows need the element table. Pages are read as they are:
whether their markup is balanced is ``pages.well_formed``'s question, and ``els`` adds it as the kind ``parse-error``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import tokens as M
from quire.plans.scratch import Scratch
from quire.plans.shares import unsent

# Block elements; weights and limits of the risk; words of contents, notices and imprints; thresholds of flows.
BLOCKS = "address article aside blockquote center dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split()
LEVELS = [(25, "auto-safe"), (50, "auto-safe-with-warnings"), (75, "manual-review")]
CONTENTS = ["目次", "tableofcontents", "contents"]
BR_NOTICES = ["縦書き表示", "横書き表示", "外部リンク", "本電子書籍", "私的利用", "著作権法", "ブックデザイン", "ファンレター", "初出", "未読の方", "単行本として刊行", "電子書籍化", "掲載されました", "書き下ろし"]
BR_IMPRINT = ["発行日", "発行者", "発行所", "発行元", "発行：", "著者：", "©", "isbn", "〒"]
KFX_NOTICES = ["縦書き表示", "横書き表示", "外部リンク", "本電子書籍", "私的利用", "著作権法", "電子版発行", "本データには購買者", "複製", "頒布", "転売"]
KFX_IMPRINT = ["発行日", "発行者", "発行所", "発行元", "発行", "著者", "挿絵", "isbn", "©", "(c)", "printedin"]
DIV_NOTICES = ["イラスト", "奥付", "版権", "colophon", "©", "copyright", "縦書き表示", "横書き表示", "著作権法", "本電子書籍"]
DIV_IMPRINT = ["発行日", "発行者", "発行所", "発行元", "発行", "著者", "挿絵", "isbn", "(c)", "printedin"]
BR_LEAST, KFX_LEAST, DIV_LEAST = (4, 4), (12, 4), (5, 2, 12, 20_000, 0.75)

TAG = "<[A-Za-z][^<>]*>"
_STYLE = r"""(?i)\sstyle\s*=\s*(?:"([^"]*)"|'([^']*)')"""
_MODE = r"^(?:-(?:webkit|epub|ms)-)?writing-mode\s*:\s*"
VERTICAL = _MODE + r"(?:vertical-rl|vertical-lr|sideways-rl|sideways-lr|vertical|tb|tb-rl)\s*(?:!\s*important\s*)?$"
HORIZONTAL = _MODE + r"(?:horizontal-tb|horizontal|lr|lr-tb|rl|rl-tb)\s*(?:!\s*important\s*)?$"
ABSOLUTE, ROTATE = r"^position\s*:\s*absolute\s*(?:!\s*important\s*)?$", r"^transform\s*:.*rotate"
DECLARATION = r"[a-z-]+\s*:\s*[^;{}]+"
NAV = r"""(?i)^<nav\s(?:.*\s)?epub:type\s*=\s*["'](?:[^"']*\s)?(?:toc|landmarks|page-list|loi|lot)(?:\s[^"']*)?["']"""
ROLE = r"""(?i)\srole\s*=\s*["']doc-toc["']"""
VIEWPORT = r"""(?i)^<meta\s(?:.*\s)?name\s*=\s*["']?(?:-epub-)?viewport["'\s/>]"""
BODY = r"(?is)<body(?:\s[^<>]*)?>(.*?)(?:</body>|$)"
PIECES = r"(?s)<!--.*?-->|<[^<>]*>"
SPACER = r"(?is)<p(?:\s[^<>]*)?>(?:\s|&nbsp;|&#160;|\x{A0})*</p>"


def _count(html: Column | str, *names: str) -> Column:
    return F.regexp_count(T.col(html), F.lit(rf"(?i)<(?:{'|'.join(names)})[\s/>]")).cast("long")


def texts_of(html: Column | str) -> Column:
    """The texts between tags and comments; an entity counts as one sign."""
    return F.transform(F.split(T.col(html), PIECES, -1), lambda x: F.regexp_replace(x, "&[#A-Za-z0-9]+;", "x"))


def signals(pages: DataFrame) -> DataFrame:
    """pages with what their markup says about layout: n_absolute, n_rotate, vertical, horizontal, svg_text, n_script and so on."""
    found = pages.withColumn("_rest", M.blanked("html")).withColumn("_tags", F.regexp_extract_all("_rest", F.lit(TAG), F.lit(0)))
    inline = F.transform("_tags", lambda x: F.concat(F.regexp_extract(x, _STYLE, 1), F.regexp_extract(x, _STYLE, 2)))
    sheets = F.regexp_extract_all("html", F.lit("(?is)<style[^<>]*>(.*?)</style>"), F.lit(1))
    declared = F.transform(F.concat(F.filter(inline, lambda x: x != ""), sheets), lambda x: F.regexp_extract_all(F.lower(F.regexp_replace(x, r"(?s)/\*.*?\*/", "")), F.lit(DECLARATION), F.lit(0)))
    found = found.withColumn("_decls", F.transform(F.flatten(declared), F.btrim))
    having = lambda rx: F.filter("_decls", lambda x: x.rlike(rx))
    meta = F.get(F.filter("_tags", lambda x: x.rlike(VIEWPORT)), F.lit(0))
    return found.withColumns({
        "n_absolute": F.size(having(ABSOLUTE)).cast("long"), "n_rotate": F.size(having(ROTATE)).cast("long"),
        "vertical": F.size(having(VERTICAL)) > 0, "horizontal": F.size(having(HORIZONTAL)) > 0,
        "svg_text": F.exists(F.regexp_extract_all("_rest", F.lit(r"(?is)<svg[\s>].*?</svg>"), F.lit(0)), lambda x: x.rlike(r"(?i)<text[\s>]")), "n_svg": _count("_rest", "svg"),
        "n_table": _count("_rest", "table"), "n_image": _count("_rest", "img", "image"), "n_script": _count("html", "script"),
        "chars": F.aggregate(texts_of("_rest"), F.lit(0).cast("long"), lambda n, x: n + F.length(F.btrim(x, F.lit(" \t\r\n")))),
        "fixed_viewport": F.coalesce(meta.rlike("(?i)width=") & meta.rlike("(?i)height="), F.lit(False)), "is_nav": F.exists("_tags", lambda x: x.rlike(NAV) | x.rlike(ROLE)),
    }).drop("_rest", "_tags", "_decls")


def _points(*parts: tuple[Column, int]) -> Column:
    return reduce(lambda a, b: a + b, (F.when(c, n).otherwise(0) for c, n in parts))


def risk(css: Column | None = None, high_profile: Column | None = None) -> Column:
    """0 to 100 from signals; css: points of linked sheets; high_profile: the book's template is known."""
    c = F.col
    points = _points(
        (c("fixed_viewport"), 30), (c("n_absolute") >= 3, 20), (c("n_absolute").isin(1, 2), 10), (c("svg_text") & c("vertical"), 20), (c("vertical") & c("horizontal"), 15), (c("n_rotate") > 0, 15),
        ((c("n_script") > 0) & ((c("n_absolute") > 0) | c("vertical")), 10), (c("is_nav"), 5),
        (c("vertical") & ~c("horizontal") & (c("n_absolute") == 0) & (c("n_rotate") == 0) & (c("n_table") == 0) & (c("n_svg") == 0) & (c("chars") >= 300), -10),
    )
    points = points + (css if css is not None else 0) + (F.when(high_profile, -20).otherwise(0) if high_profile is not None else 0)
    return F.greatest(F.lit(0), F.least(F.lit(100), points)).cast("long")


def sheet_points(fixed_viewport: Column, rotate: Column, absolute: Column, side_utilities: Column) -> Column:
    """Points of a linked sheet's own signals."""
    return _points((fixed_viewport, 30), (rotate, 15), (absolute, 10), (side_utilities > 0, 10))


def level(score: Column | str) -> Column:
    return F.when(T.col(score) < LEVELS[0][0], LEVELS[0][1]).when(T.col(score) < LEVELS[1][0], LEVELS[1][1]).when(T.col(score) < LEVELS[2][0], LEVELS[2][1]).otherwise("unsupported")


def layout(pages: DataFrame, balanced: DataFrame | None = None) -> DataFrame:
    """pages with their signals, kind, risk and level; balanced (page_id, balanced): others have the kind parse-error.

    Null markup has the kind parse-error and no risk.
    """
    c = F.col
    kind = (
        F.when(c("html").isNull(), "parse-error").when(c("fixed_viewport"), "fixed-layout").when(c("svg_text") & c("vertical"), "svg-text-layout").when(c("is_nav"), "toc-or-nav")
        .when((c("n_image") > 0) & (c("chars") <= 2), "image-only").when((c("n_script") > 0) & (c("n_absolute") > 0), "script-driven").when(c("vertical") & c("horizontal"), "mixed-writing-mode")
        .when(c("vertical"), F.when(c("risk") >= 50, "reflow-vertical-review").otherwise("reflow-vertical-safe")).when((c("chars") > 0) & (c("chars") < 400), "title-or-colophon").otherwise("already-horizontal")
    )
    out = signals(pages).withColumn("risk", risk()).withColumn("kind", kind)
    if balanced is not None:
        out = out.join(balanced.select("page_id", "balanced"), "page_id", "left").withColumn("kind", F.when(F.coalesce("balanced", F.lit(True)), c("kind")).otherwise("parse-error")).drop("balanced")
    return out.withColumn("level", level("risk"))


def _has(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def _number(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.contains(text, F.lit(w)).cast("int") for w in words))


def _flow(pages: DataFrame) -> DataFrame:
    """pages with body, its text, and counts of elements in the page."""
    out = pages.withColumn("_rest", M.blanked("html")).withColumn("body", F.when(F.col("_rest").rlike(r"(?i)<body[\s>]"), F.regexp_extract("_rest", BODY, 1)))
    out = out.withColumn("_text", F.array_join(F.split("body", PIECES, -1), ""))
    return out.withColumns({
        "n_br": _count("_rest", "br"), "n_p": _count("_rest", "p"), "n_image": _count("_rest", "img", "image"), "n_links": _count("_rest", "a"),
        "chars": F.length(F.btrim("_text", F.lit(" \t\r\n"))).cast("long"), "_compact": F.lower(F.regexp_replace("_text", r"[\s\x{3000}]", "")),
    }).drop("_rest", "_text")


def _runs(body: Column | str, cut: str) -> Column:
    """Parts of a body with visible text between what cuts it."""
    return F.filter(F.split(T.col(body), cut, -1), lambda x: F.regexp_replace(x, PIECES, "").rlike(r"\S"))


def br_flow_kind(pages: DataFrame) -> DataFrame:
    """pages with counts, candidates (paragraphs to be between breaks) and kind; kinds candidate for a rewrite by hand or, normal-body-flow, without.

    A block element anywhere in the body counts as block layout.
    """
    c = F.col
    out = _flow(pages).withColumn("_runs", _runs("body", r"(?i)<br\s*/?>"))
    out = out.withColumns({"n_block": _count("body", *BLOCKS), "candidates": F.size("_runs").cast("long"), "link_runs": F.size(F.filter("_runs", lambda x: x.rlike(r"(?i)<a\s[^<>]*href"))).cast("long")})
    contents = _has(c("_compact"), CONTENTS) | ((c("link_runs") >= 2) & (c("link_runs") * 2 >= F.greatest(F.lit(1), c("candidates"))))
    notice = (c("candidates") <= 25) & (_has(c("_compact"), BR_NOTICES) | (_number(c("_compact"), BR_IMPRINT) >= 2))
    kind = (
        F.when(c("body").isNull(), "no-body").when(c("n_p") > 0, "already-normalized").when(c("n_block") > 0, F.when((c("n_image") > 0) | (c("chars") < 120), "image-or-title-page").otherwise("block-layout"))
        .when(contents, "toc-like").when(c("n_image") > 0, "image-or-title-page").when((c("n_br") == 0) | (c("candidates") == 0), "no-candidate").when(notice, "notice-or-imprint")
        .when((c("candidates") < BR_LEAST[0]) | (c("n_br") < BR_LEAST[1]), "short-flow").otherwise("normal-body-flow")
    )
    return out.withColumn("kind", kind).drop("_runs", "_compact")


def spacers(body: Column | str) -> Column:
    """Empty paragraphs with a height in their style and without marks of their own."""
    return F.filter(F.regexp_extract_all(T.col(body), F.lit(SPACER), F.lit(0)), lambda x: F.coalesce(T.css_length(_height(x))[0].isNotNull(), F.lit(False)) & ~x.rlike(r"(?i)^<p[^<>]*\s(?:id|name|href|src)\s*="))


def _height(p: Column) -> Column:
    return T.style_property(F.concat(F.regexp_extract(p, _STYLE, 1), F.regexp_extract(p, _STYLE, 2)), "height")


def kfx_flow_kind(pages: DataFrame) -> DataFrame:
    """pages with counts and kind of text that stands in the body itself, its paragraphs set apart by empty paragraphs with a height."""
    c = F.col
    out = _flow(pages).withColumn("_spacers", spacers("body"))
    zero = F.filter("_spacers", lambda x: T.css_length(_height(x))[0] <= 0.0001)
    # what is left of the body without spacers, whose places a sign keeps, and without whole paragraphs
    bare = F.aggregate(F.array_distinct("_spacers"), F.col("body"), lambda a, x: F.replace(a, x, F.lit("\x01")))
    out = out.withColumns({"n_spacers": F.size("_spacers").cast("long"), "n_zero": F.size(zero).cast("long"), "_bare": bare})
    out = out.withColumn("_direct", F.regexp_replace("_bare", r"(?is)<(p|div|h[1-6]|ul|ol|table|section|article|blockquote|figure|nav|aside)(?:\s[^<>]*)?>.*?</\1>", "\x02"))
    paragraphs = F.filter(F.regexp_extract_all("_bare", F.lit(r"(?is)<p(?:\s[^<>]*)?>(.*?)</p>"), F.lit(1)), lambda x: F.regexp_replace(x, PIECES, "").rlike(r"\S"))
    out = out.withColumns({
        "direct": F.regexp_replace(F.regexp_replace("_direct", PIECES, ""), "[\x01\x02]", "").rlike(r"\S"), "n_paragraphs": F.size(paragraphs).cast("long"), "n_block": F.regexp_count("_direct", F.lit("\x02")).cast("long"),
        "candidates": F.size(_runs("_direct", "[\x01\x02]")).cast("long"),
    })
    contents = _has(c("_compact"), CONTENTS) | ((c("n_links") >= 4) & (c("n_br") >= F.greatest(F.lit(1), c("n_links") - 2))) | ((c("n_links") >= 3) & (c("n_links") >= F.greatest(F.lit(1), c("candidates"))))
    notice = (c("candidates") <= 25) & (_has(c("_compact"), KFX_NOTICES) | (_number(c("_compact"), KFX_IMPRINT) >= 3))
    kind = (
        F.when(c("body").isNull(), "no-body").when(~c("direct") & (c("n_paragraphs") > 0), "already-normalized")
        .when(c("n_block") > 0, F.when((c("n_image") > 0) | (c("chars") < 120), "image-or-title-page").otherwise("block-layout")).when(contents, "toc-like")
        .when((c("n_spacers") == 0) | (c("candidates") == 0) | ~c("direct"), "no-candidate").when((c("n_image") > 0) & (c("candidates") <= 3), "image-or-title-page").when(notice, "notice-or-imprint")
        .when((c("candidates") < KFX_LEAST[0]) | (c("n_spacers") < KFX_LEAST[1]), "short-flow").otherwise("normal-body-flow")
    )
    return out.withColumn("kind", kind).drop("_spacers", "_bare", "_direct", "_compact")


def leaf_kinds(els: DataFrame, texts: DataFrame) -> DataFrame:
    """els (doc, eid, parent_eid, tname, tok, end_seq, depth) with leaf: what each is as a child of a content parent.

    texts: (doc, eid, text, own_text). anchor-only, heading, existing-p, scene-break, spacer-br, image-only, paragraph, wrapped-block, nested-complex or other.
    """
    c, is_block = F.col, F.col("tname").isin(*BLOCKS)
    inside = Window.partitionBy("doc")
    # block elements and images begin in document order, so those inside an element are counted by ranks of their starts
    starts = els.select("doc", "eid", "end_seq", is_block.alias("block"), c("tname").isin("img", "image").alias("image"))
    marks = starts.select("doc", F.explode(F.array(F.struct(c("eid").alias("at"), F.lit(0).alias("o"), c("eid").alias("of"), c("block").cast("int").alias("b"), c("image").cast("int").alias("i")), F.struct(c("end_seq").alias("at"), F.lit(1).alias("o"), c("eid").alias("of"), F.lit(0).alias("b"), F.lit(0).alias("i")))).alias("m")).select("doc", "m.*")
    run = inside.orderBy("at", "o")
    totals = marks.withColumns({"nb": F.sum("b").over(run), "ni": F.sum("i").over(run)}).groupBy("doc", c("of").alias("eid")).agg((F.max("nb") - F.min("nb")).alias("n_blocks"), (F.max("ni") - F.min("ni")).alias("n_images"))
    children = els.select("doc", c("parent_eid").alias("eid"), c("eid").alias("child"), "tname").join(unsent(totals.select("doc", c("eid").alias("child"), c("n_blocks").alias("deep"))), ["doc", "child"])
    by_parent = children.groupBy("doc", "eid").agg(F.count_if(is_block).alias("direct_blocks"), F.count_if(is_block & (c("tname") == "div") & (c("deep") == 0)).alias("plain_divs"), F.count_if(c("tname") == "br").alias("brs"), F.count("*").alias("n_children"))
    rows = els.join(unsent(totals), ["doc", "eid"]).join(unsent(by_parent), ["doc", "eid"], "left").fillna(0, ["direct_blocks", "plain_divs", "brs", "n_children"]).join(unsent(_said(texts)), ["doc", "eid"], "left")
    empty = ~F.coalesce("filled", F.lit(False))
    attrs = M.attributes("tok")
    has = lambda k: F.try_element_at(attrs, F.lit(k)).isNotNull()
    plain = (
        F.when(F.coalesce("scene", F.lit(False)), "scene-break").when(empty & (c("brs") > 0) & (c("brs") == c("n_children")), "spacer-br").when(empty & (c("n_images") > 0), "image-only")
        .when(~empty & (c("n_blocks") == 0), "paragraph").otherwise("other")
    )
    leaf = (
        F.when((c("tname") == "a") & ~has("href") & (has("name") | has("id")) & empty, "anchor-only").when(c("tname").rlike("^h[1-6]$"), "heading").when(c("tname") == "p", "existing-p").when(c("tname") != "div", "other")
        .when(c("direct_blocks") == 0, plain).when((c("direct_blocks") == 1) & (c("plain_divs") == 1), "wrapped-block").otherwise("nested-complex")
    )
    return rows.withColumn("leaf", leaf)


def _said(texts: DataFrame) -> DataFrame:
    """(doc, eid, filled, scene, spoken): whether an element has text below it, only a scene break, and text of its own."""
    if "filled" in texts.columns:
        return texts
    return texts.select("doc", "eid", F.col("text").rlike(r"\S").alias("filled"), T.is_scene_break(T.compact("text")).alias("scene"), F.coalesce(F.col("own_text").rlike(r"\S"), F.lit(False)).alias("spoken"))


CONVERTIBLE = ["paragraph", "spacer-br", "scene-break", "image-only", "wrapped-block"]


def div_flow_kind(pages: DataFrame, els: DataFrame, texts: DataFrame) -> DataFrame:
    """page_id, kind, and of the content parent: eid, n_children, n_paragraphs, n_convertible.

    The content parent is the div, reached from the body through divs only, whose children are leaves to three quarters at least: the best share, then the
    most children, then the deepest; of five children or more, else of two.
    """
    c = F.col
    # read several times; of the texts only what is asked of them
    texts = Scratch(els.sparkSession, "said").table(_said(texts), "said")
    leaves = leaf_kinds(els, texts)
    counts = leaves.groupBy("doc", c("parent_eid").alias("eid")).agg(
        F.count("*").alias("n"), F.count_if(~c("leaf").isin("nested-complex", "other")).alias("leafish"), F.count_if(c("leaf").isin(*CONVERTIBLE)).alias("n_convertible"), F.count_if(c("leaf") == "paragraph").alias("n_paragraphs"),
        F.count_if(c("leaf") == "wrapped-block").alias("n_wrapped"), F.count_if(c("leaf") == "nested-complex").alias("n_nested"),
    )
    # divs under other elements than divs and the body are out: as many of their ancestors below the body are divs as there are
    body = els.where("tname = 'body'").groupBy("doc").agg(F.min("eid").alias("body_eid"), F.min_by("depth", "eid").alias("body_depth"), F.min_by("end_seq", "eid").alias("body_end"))
    below = els.select("doc", "eid", "end_seq", "tname", "depth").join(unsent(body), "doc").where("eid > body_eid and end_seq <= body_end and tname = 'div'")
    # how many of them are open where one begins, itself included
    marks = below.select("*", F.explode(F.array(F.struct(c("eid").alias("at"), F.lit(1).alias("step")), F.struct(c("end_seq").alias("at"), F.lit(-1).alias("step")))).alias("m"))
    chains = marks.withColumn("divs", F.sum("m.step").over(Window.partitionBy("doc").orderBy("m.at", F.desc("m.step")))).where("m.step = 1 and divs = depth - body_depth").select("doc", "eid", "divs", "depth", "body_depth")
    spoken = texts.where("spoken").select("doc", "eid")
    able = chains.join(unsent(counts), ["doc", "eid"]).join(unsent(spoken), ["doc", "eid"], "left_anti").withColumn("share", c("leafish") / c("n")).where((c("n") >= DIV_LEAST[1]) & (c("n") <= DIV_LEAST[3]) & (c("share") >= DIV_LEAST[4]) & (c("n_convertible") > 0))
    best = able.withColumn("short", c("n") < DIV_LEAST[0]).withColumn("_r", F.row_number().over(Window.partitionBy("doc").orderBy("short", F.desc("share"), F.desc("n"), F.desc("depth"), "eid"))).where("_r = 1")
    # what is asked of a page's own markup, before its text would be shuffled
    asked = {
        "no_body": c("body").isNull(), "image_page": c("html").rlike(r"""(?i)<body\s[^<>]*class\s*=\s*["'](?:[^"']*\s)?p-image[\s"']"""), "no_head": ~c("html").rlike(r"(?i)<head[\s>]"), "hrefs": F.regexp_count("html", F.lit(r"(?i)<a\s[^<>]*href")),
        "chars": F.length("_compact"), "contents": _has(c("_compact"), CONTENTS), "notices": _has(c("_compact"), DIV_NOTICES), "imprint": _number(c("_compact"), DIV_IMPRINT),
    }
    own = _flow(pages).select("page_id", *(x.alias(n) for n, x in asked.items()))
    rows = own.join(unsent(best.select(c("doc").alias("page_id"), "eid", c("n").alias("n_children"), "n_convertible", "n_paragraphs", "n_wrapped", "n_nested", "short")), "page_id", "left")
    contents = c("contents") | ((c("hrefs") >= 8) & (c("hrefs") * 2 >= F.greatest(F.lit(1), c("n_children"))))
    few = (c("n_wrapped") >= 1) & (c("n_paragraphs") <= 3) & (c("chars") < 120)
    strong = c("notices") & (c("short") | (c("n_paragraphs") <= 6) | (c("chars") < 600))
    notice = few | ((c("n_paragraphs") + c("n_wrapped") <= 25) & (strong | (c("imprint") >= 3)))
    kind = (
        F.when(c("no_body"), "no-body").when(c("image_page"), "image-or-title-page").when(c("no_head") | c("eid").isNull(), "no-candidate")
        .when(contents, "toc-like").when(c("n_nested") > 0, "block-layout").when(c("n_convertible") == 0, "no-candidate").when(notice, "notice-or-imprint")
        .when((c("n_paragraphs") < DIV_LEAST[2]) | c("short"), "short-flow").otherwise("normal-body-flow")
    )
    return rows.select("page_id", kind.alias("kind"), "eid", "n_children", "n_paragraphs", "n_convertible")
