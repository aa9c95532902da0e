"""Rewrites and classifications on small hand-made pages."""

import pytest
from pyspark.sql import functions as F

from quire.operators import chinese, classify, links, pages, rewrite
from quire.operators import tokens as M
from quire.sources import archives


def book(spark, **files):
    rows = [(i, "b", path, text) for i, (path, text) in enumerate(files.items())]
    return spark.createDataFrame(rows, "page_id long, book string, path string, html string")


def html(df):
    return {r.page_id: r.html for r in df.collect()}


FILES = {
    "Text/a.xhtml": "<p id='x'><a href=\"b.xhtml#n\">1</a><a href='#x'>2</a><a href='http://e/b.xhtml'>3</a><img src='../Images/p%20q.png'/></p>",
    "Text/b.xhtml": "<p id=n>plain <a href='a.xhtml#x'>back</a></p>",
    "c.xhtml": "<p>no links</p>",
}


def test_renamed_files(spark):
    updates = spark.createDataFrame([("b", "Text/b.xhtml", "Other/d e.xhtml"), ("b", "Images/p q.png", "Images/r.png")], "book string, old_path string, new_path string")
    got = html(rewrite.apply_renames(book(spark, **FILES), updates))
    assert got == {0: "<p id='x'><a href=\"../Other/d%20e.xhtml#n\">1</a><a href='#x'>2</a><a href='http://e/b.xhtml'>3</a><img src=\"../Images/r.png\"/></p>"}


def test_anchors_after_a_split(spark):
    old = spark.createDataFrame([("b", "Text/a.xhtml")], "book string, old_path string")
    places = spark.createDataFrame([("b", "x", "Text/a2.xhtml"), ("b", "x", "Text/a1.xhtml")], "book string, id string, path string")
    got = html(rewrite.relink_anchors(book(spark, **FILES), old, places))
    assert set(got) == {0, 1} and 'href="a2.xhtml#x">2<' in got[0] and 'href="a2.xhtml#x"' in got[1] and "b.xhtml#n" in got[0]


def test_renamed_fragments(spark):
    updates = spark.createDataFrame([("b", "Text/a.xhtml", "x", "new")], "book string, path string, old_id string, new_id string")
    got = html(rewrite.rename_fragments(book(spark, **FILES), updates))
    assert set(got) == {0, 1} and '<p id="new">' in got[0] and 'href="#new"' in got[0] and 'href="a.xhtml#new"' in got[1]


def test_sheets(spark):
    sheets = spark.createDataFrame([("s", "Styles/s.css", "@import 'b.css'; p{background:url(../i/a.png)}"), ("t", "Styles/t.css", "p{}")], "doc string, path string, css string")
    updates = spark.createDataFrame([("i/a.png", "i/z.png"), ("Styles/b.css", "c.css")], "old_path string, new_path string")
    assert [r.css for r in rewrite.css_renames(sheets, updates).collect()] == ["@import '../c.css'; p{background:url(../i/z.png)}"]
    page = book(spark, a="<head><link rel=stylesheet href='x.css'/><title>t</title></head>")
    assert html(rewrite.relink_styles(page, ["y.css"]))[0] == '<head><title>t</title><link rel="stylesheet" type="text/css" href="y.css"/></head>'
    rules = M.css_rules(spark.createDataFrame([("s", "a , b{color:red;margin : 0}c{}")], "doc string, css string"), "doc", "css", style_blocks=False)
    assert rewrite.format_css(rules).first().css == "a, b {\n  color: red;\n  margin: 0;\n}\n\nc {\n}\n"


def test_scripts_are_relinked(spark):
    page = book(spark, a="<head><script src='o.js'></script><script>own('src=')</script><link rel=stylesheet href='x.css'/></head><body><script src='o.js'></script></body>")
    got = html(rewrite.relink_styles(page, [], ["n$.js"]))[0]
    assert got == "<head><script>own('src=')</script><script type=\"text/javascript\" src=\"n$.js\"></script></head><body><script src='o.js'></script></body>"
    assert html(rewrite.relink_styles(page, ["y.css"]))[0].count("o.js") == 2


def test_packages_are_found(spark):
    opf = "<package><metadata><meta property='dcterms:modified'>x</meta></metadata><bindings><mediaType media-type='a/b' handler='h'/></bindings></package>"
    files = spark.createDataFrame([
        ("a", "META-INF/container.xml", "<container><rootfiles><rootfile full-path='o/x.pdf' media-type='application/pdf'/><rootfile full-path='o/b%20c.opf' media-type='application/oebps-package+xml'/><rootfile full-path='a.opf'/></rootfiles></container>"),
        ("a", "a.opf", "no"), ("a", "o/b c.opf", opf), ("b", "z.OPF", "z"), ("b", "y.opf", "y"), ("c", "META-INF/container.xml", "<rootfile full-path='gone.opf'/>"), ("d", "x.html", None),
    ], "book_id string, bookpath string, text string")
    found = archives.package_files(files)
    assert {(r.book_id, r.bookpath) for r in found.collect()} == {("a", "o/b c.opf"), ("b", "y.opf")}
    assert [tuple(r)[2:] for r in archives.package_tables(found)["bindings"].collect()] == [("a/b", "h")]
    when = spark.createDataFrame([(opf,), ("<metadata></metadata>",), ("<x/>",)], "t string").select(archives.with_modified("t", F.lit("2024-05-06 07:08:09").cast("timestamp")).alias("t"))
    assert [r.t for r in when.collect()] == [opf.replace(">x<", ">2024-05-06T07:08:09Z<"), '<metadata><meta property="dcterms:modified">2024-05-06T07:08:09Z</meta></metadata>', "<x/>"]


def test_character_names(spark):
    from quire.operators import words

    got = {r.char: (r.entity, r.description) for r in words.char_names(words.char_usage(spark.createDataFrame([("é&\x01漢",)], "text string"))).collect()}
    assert got == {"é": ("eacute", "LATIN SMALL LETTER E WITH ACUTE"), "&": ("amp", "AMPERSAND"), "\x01": (None, ""), "漢": (None, "CJK UNIFIED IDEOGRAPH-6F22")}


def test_script_conversion(spark):
    page = book(spark, a="<html><head><title>发</title></head><body><p id='发'>头发发<code>发</code><span lang='ja'>发</span></p></body></html>")
    got = rewrite.convert_script(page, [("头发", "頭髮")], {"发": "發", "头": "頭"}).first()
    assert got.html == "<html><head><title>发</title></head><body><p id='发'>頭髮發<code>发</code><span lang='ja'>发</span></p></body></html>" and got.skipped == 3


S2T = [("汉", "漢"), ("体", "體"), ("标", "標"), ("题", "題"), ("简", "簡"), ("转", "轉"), ("换", "換"), ("图", "圖"), ("插", "插"), ("诗", "詩"), ("识", "識"), ("里", "裡"), ("软", "軟"), ("鼠", "鼠"), ("发", "發"), ("乾", "乾")]


@pytest.fixture(scope="module")
def dictionaries(spark):
    rows = [("STCharacters", a, b) for a, b in S2T] + [("TSCharacters", b, a) for a, b in S2T if a != b] + [("STPhrases", "头发", "頭髮"), ("STPhrases", "里面", "裡面"), ("HKVariants", "裡", "裏"), ("TWPhrases", "軟件", "軟體"), ("TWPhrases", "鼠標", "滑鼠"), ("TWVariants", "裏", "裡")]
    return spark.createDataFrame(rows, "dictionary string, source string, target string")


@pytest.mark.parametrize(("mode", "text", "want"), [("s2t", "汉字", "漢字"), ("t2s", "漢字", "汉字"), ("s2twp", "鼠标和软件", "滑鼠和軟體"), ("s2hk", "里面", "裏面"), ("s2t", "头发发", "頭髮發"), ("t2hk", "裡裡", "裏裏")])
def test_chinese_directions(spark, dictionaries, mode, text, want):
    page = spark.createDataFrame([(1, f"<p>{text}</p>"), (2, None), (3, "")], "page_id long, html string")
    got = {r.page_id: r.html for r in chinese.convert_direction(page, dictionaries, mode).collect()}
    assert got == {1: f"<p>{want}</p>", 2: None, 3: ""}


def test_chinese_markup(spark, dictionaries):
    source = (
        '<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head>\n  <title>汉字标题</title></head><body id="汉字标识">\n  <p class="汉字类" title=\'简体提示\'>汉&amp;字'
        '<a href="汉字.xhtml#章节">汉字</a></p>\n  <p lang="ja-JP" title="汉字">汉字日文</p><code>汉字代码</code>\n  <pre>汉字诗歌</pre><script>var label = "汉字<b>脚本";</script>\n  <ruby>汉字<rt>かんじ</rt></ruby>\n</body></html>\n'
    )
    page = spark.createDataFrame([(1, source)], "page_id long, html string")
    got = chinese.convert_direction(page, dictionaries).first()
    want = source.replace("'简体提示'", "'簡體提示'").replace("汉&amp;字", "漢&amp;字").replace(">汉字</a>", ">漢字</a>").replace("<pre>汉字诗歌", "<pre>漢字詩歌").replace("<ruby>汉字", "<ruby>漢字")
    assert got.html == want and got.skipped_japanese == 1 and got.skipped_protected == 3
    plain = chinese.convert_direction(page, dictionaries, attributes=(), skip_pre=True, skip_code=False, metadata=True).first().html
    assert "title='简体提示'" in plain and "<pre>汉字诗歌" in plain and "<code>漢字代" in plain and "<title>漢字標題" in plain
    drawing = '<svg id="汉字图" aria-label="汉字插图"><title>汉字标题</title><path id="汉字路径" d="M 0 0 L 1 1"/><text>汉字<tspan>转换</tspan></text><metadata>汉字机器数据</metadata></svg>'
    svg = chinese.convert_direction(spark.createDataFrame([(1, drawing)], "page_id long, html string"), dictionaries, svg=True).first().html
    assert svg == '<svg id="汉字图" aria-label="漢字插圖"><title>漢字標題</title><path id="汉字路径" d="M 0 0 L 1 1"/><text>漢字<tspan>轉換</tspan></text><metadata>汉字机器数据</metadata></svg>'
    for mode in ("s2x", "tw2t"):
        with pytest.raises(ValueError):
            chinese.convert_direction(page, dictionaries, mode)


def test_large_phrase_tables(spark):
    """Leftmost and longest against plain search; the plan doesn't grow with the table."""
    import random

    r = random.Random(4)
    word = lambda n: "".join(r.choice("一二三四五六七八") for _ in range(n))
    table = {word(r.randint(1, 7)): word(2) for _ in range(50_000)}
    texts = [word(r.randint(0, 300)) + r.choice(["", "。", "x"]) for _ in range(40)]

    def brute(t):
        out, at = "", 0
        while at < len(t):
            n = next((n for n in range(7, 0, -1) if t[at : at + n] in table and len(t[at : at + n]) == n), 0)
            out, at = out + (table[t[at : at + n]] if n else t[at]), at + (n or 1)
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")
    small, large = chinese.convert(df, [[("一", "二")]]), chinese.convert(df, [list(table.items())])
    size = lambda x: len(x._jdf.queryExecution().analyzed().toString())
    assert {r.page_id: r.html for r in large.collect()} == {i: brute(t) for i, t in enumerate(texts)} and abs(size(small) - size(large)) < 2000


def test_files_move_with_their_links(spark):
    pages_ = book(spark, **{"Text/a.html": "<a href='b.html#x'>1</a><img src='../i/p.png'><a href='#own'>2</a><a href='http://z/q'>3</a>", "Text/b.html": "<a href='a.html'>4</a><p id='x'></p>", "c.html": "<a href='Text/a.html#own'>5</a><a href='Text/b.html'>6</a>"})
    moves = spark.createDataFrame([("b", "Text/a.html", "Text/b.html"), ("b", "Text/b.html", "new/a.html")], "book string, old_path string, new_path string")
    got = {r.path: r.html for r in rewrite.move_files(pages_, moves).collect()}
    assert got == {
        "Text/b.html": "<a href=\"../new/a.html#x\">1</a><img src='../i/p.png'><a href='#own'>2</a><a href='http://z/q'>3</a>", "new/a.html": "<a href=\"../Text/b.html\">4</a><p id='x'></p>",
        "c.html": "<a href=\"Text/b.html#own\">5</a><a href=\"new/a.html\">6</a>",
    }


def test_numbered_names(spark):
    pages_ = book(spark, **{"t/b.xhtml": "<a href='a.html'>x</a>", "t/a.html": "<a href='b.xhtml#f'>y</a>", "c.htm": ""})
    got = {r.path: r.html for r in rewrite.rename_files(pages_, "ch-##{ext}", start=9).collect()}
    assert got == {"ch-09.htm": "", "t/ch-10.html": '<a href="ch-11.xhtml#f">y</a>', "t/ch-11.xhtml": '<a href="ch-10.html">x</a>'}
    plan = {r.old_path: (r.new_path, r.problem) for r in rewrite.rename_plan(pages_, "{name}.X", ["path"]).collect()}
    assert plan == {"t/b.xhtml": ("t/b.X", None), "t/a.html": ("t/a.X", None), "c.htm": ("c.X", None)}
    others = spark.createDataFrame([("b", "T/CH-10.html"), ("b", "c.htm")], "book string, path string")
    told = {r.old_path: r.problem for r in rewrite.rename_plan(pages_, "ch-#{ext}", ["path"], 9, others).collect()}
    assert told == {"t/b.xhtml": None, "t/a.html": "the path is taken", "c.htm": None}
    assert {r.path for r in rewrite.rename_files(pages_, "ch-#{ext}", start=9, others=others).collect()} == {"t/b.xhtml", "t/a.html", "c.htm"}
    twins = book(spark, **{"t/x.a": "", "t/X.b": ""})
    assert {r.problem for r in rewrite.rename_plan(twins, "{name}", ["path"]).collect()} == {"several files get this path"}
    with pytest.raises(ValueError):
        rewrite.rename_plan(twins, "same.html", ["path"])


def test_merged_files_keep_their_links(spark):
    page = "<html><head><title>{0}</title></head><body class='{0}'>{1}</body></html>"
    files = {
        "a.html": page.format("A", "<p id='x'>1</p><a href='t/b.html#x'>2</a><a href='#x'>3</a>"), "t/b.html": page.format("B", "<p id='x'>4</p><b id='x__1'></b><a href='#x'>5</a><img src='../i.png'><a href='c.html'>6</a>"),
        "t/c.html": page.format("C", "<a href='b.html#x'>7</a><a href='../a.html#x'>8</a><a href='b.html'>9</a>"), "d.html": "<i id='x'>no body</i>",
    }
    plan = spark.createDataFrame([("b", "t/b.html", "a.html", 2), ("b", "a.html", "a.html", 1), ("b", "d.html", "a.html", 3), ("b", "gone.html", "a.html", 4)], "book string, path string, target string, n int")
    got = {r.path: r.html for r in rewrite.merge_documents(book(spark, **files), plan).collect()}
    body = (
        "<p id='x'>1</p><a href=\"#x___2\">2</a><a href='#x'>3</a>\n<p id=\"x___2\">4</p><b id='x__1'></b><a href=\"#x___2\">5</a><img src=\"i.png\"><a href=\"t/c.html\">6</a>\n<i id=\"x___3\">no body</i>"
    )
    assert got == {"a.html": page.format("A", body), "t/c.html": page.format("C", "<a href=\"../a.html#x___2\">7</a><a href='../a.html#x'>8</a><a href=\"../a.html\">9</a>")}
    assert rewrite.merge_documents(book(spark, **files), plan.limit(0)).count() == 4


def test_ids(spark):
    manifest = spark.createDataFrame([("b", 1, "q1", "Text/a b.xhtml"), ("b", 2, "q2", "Other/a b.xhtml"), ("b", 3, "q3", "1.css")], "book_id string, pos int, id string, bookpath string")
    spine = spark.createDataFrame([("b", 1, "q2"), ("b", 2, "zz")], "book_id string, pos int, idref string")
    named, refs = rewrite.rebase_ids(manifest, spine)
    assert [r.id for r in named.orderBy("pos").collect()] == ["ab.xhtml", "ab.xhtml_2", "x1.css"]
    assert [r.idref for r in refs.orderBy("pos").collect()] == ["ab.xhtml_2", "zz"]
    metadata = spark.createDataFrame([("b", "dc:identifier", "urn:uuid:0FAB1234-0000-4000-8000-00000000000a"), ("c", "dc:title", "t")], "book_id string, name string, content string")
    got = {r.book_id: r.uuid for r in rewrite.ensure_uuid(metadata).collect()}
    assert got["b"] == "0fab1234-0000-4000-8000-00000000000a" and len(got["c"]) == 36 and got["c"][14] == "4"


def test_formatting(spark):
    docs = book(spark, a="<p>x</p>  \n", b="<p>x", c="<p>y</p>")
    els = M.elements(docs)
    assert {r.doc: r.status for r in rewrite.format_status(els, docs).collect()} == {0: "formatted", 1: "skipped", 2: "unchanged"}
    assert html(rewrite.format_markup(docs, els)) == {0: "<p>x</p>\n"}


def test_break_paragraphs(spark):
    docs = book(spark, a="<html><body>one<br/>two <i id='k'>x</i><br/><br/>three<br>four</body></html>", b="<html><body>a<br>b</body></html>", c="<html><body><p>a</p><br><br><br><br></body></html>")
    got = {r.page_id: (r.status, r.html) for r in classify.normalize_breaks(docs, M.elements(docs)).collect()}
    assert got[0] == ("normalized", "<html><body><p>one</p>\n<p>two <i id='k'>x</i></p>\n<p>three</p>\n<p>four</p></body></html>")
    assert got[1][0] == got[2][0] == "unsafe" and got[2][1].count("<br>") == 4


def test_spacers_and_divs(spark):
    docs = book(spark, a="<p style='height:0'>&nbsp;</p><p>a</p><p style='height:1em'></p>", b="<div class=c>" + "".join(f"<div>{k}</div>" for k in range(5)) + "</div>", c="<div>x</div>")
    spaced = {r.page_id: (r.html, r.removed) for r in classify.spacer_paragraphs(docs).collect()}
    assert spaced[0] == ("<p>a</p><p style='height:1em'></p>", 1)
    got = html(classify.div_normalize(docs, M.elements(docs)))
    assert got == {1: "<div class=c>" + "".join(f"<p>{k}</p>" for k in range(5)) + "</div>"}


def test_vertical_layouts(spark):
    css = spark.createDataFrame([("v", "html.tate{-epub-writing-mode:vertical-rl} .c{text-combine-upright:all}"), ("h", "p{color:red} .r{transform:rotate(90deg)}")], "doc string, css string")
    features = classify.css_layout_features(M.css_declarations(M.css_rules(css, "doc", "css", style_blocks=False)))
    told = {r.doc: r for r in features.collect()}
    assert told["v"].vertical and told["v"].combine and not told["h"].vertical and told["h"].rotate
    docs = book(spark, a="<html class='tate x'><body>1</body></html>", b="<html><body style='writing-mode: vertical-rl'>2</body></html>", c="<html class=\"tate\"><body style='writing-mode:horizontal-tb'>3</body></html>", d="<html>4</html>")
    uses = spark.createDataFrame([(i, "v") for i in range(4)], "page_id long, doc string")
    modes = classify.effective_mode(docs, features, uses)
    assert {r.page_id: r.mode for r in modes.collect()} == {0: "vertical", 1: "vertical", 2: "horizontal", 3: "horizontal"}
    got = {r.page_id: (r.html, r.converted) for r in classify.convert_direction(docs, modes, "yoko").collect()}
    assert got[0] == ("<html class='yoko tate x'><body>1</body></html>", True) and got[1][0].startswith('<html class="yoko"><body') and not got[3][1]
    broken = docs.withColumn("html", F.when(F.col("page_id") == 1, "<body style='writing-mode:vertical-rl'>").otherwise(F.col("html")))
    assert not any(r.converted for r in classify.convert_direction(broken, modes).collect())
    kinds = docs.select("page_id", "book", F.lit("text").alias("kind"))
    assert [tuple(r) for r in classify.layout_summary(modes, kinds).collect()] == [("b", 4, 2, 0)]


def test_profiles(spark):
    signals = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "unknown")], "book string, signal string")
    got = {r.book: (r.family, r.score) for r in classify.profile(signals, {"f": {"x": 30, "y": 30}, "g": {"y": 10}}).collect()}
    assert got == {"a": ("f", 60), "b": ("generic", 30), "c": ("none", 0)}


def test_package_rules(spark):
    docs = book(spark, a="<package><metadata><dc:title>t</dc:title></metadata><manifest><item/></manifest></package>", b="<package><item/></package>")
    rules = [("item", "manifest", 1, None), ("metadata", "package", 1, 1)]
    got = {(r.doc, r.tname, r.issue) for r in classify.package_check(M.elements(docs), rules).collect()}
    assert got == {(1, "item", "parent is package"), (1, "metadata", "count is 0")}


def test_reports(spark):
    sheets = spark.createDataFrame([("s.css", "x" * 2048), ("t.css", "")], "path string, css string")
    uses = spark.createDataFrame([(1, "s.css"), (2, "s.css"), (2, "s.css")], "page_id long, path string")
    assert {tuple(r) for r in classify.css_files_report(sheets, uses).collect()} == {("s.css", 2.0, 2, 0), ("t.css", 0.0, 0, 0), (None, 2.0, 2, 1)}
    images = spark.createDataFrame([("a.gif", b"GIF89a" + (3).to_bytes(2, "little") + (2).to_bytes(2, "little")), ("b.jpg", b"x")], "path string, bytes binary")
    used = spark.createDataFrame([("a.gif",), ("a.gif",)], "path string")
    assert {(r.path, r.n_used, r.pixels) for r in classify.image_report(images, used).collect()} == {("a.gif", 2, 6), ("b.jpg", 0, None)}
    assert [(r.bookpath, r.semantics) for r in classify.semantics(spark.createDataFrame([("x",), ("y",)], "bookpath string"), spark.createDataFrame([("x", "toc"), ("x", "cover")], "bookpath string, role string")).orderBy("bookpath").collect()] == [("x", "cover, toc"), ("y", "")]
    guide = spark.createDataFrame([("b", "Text", "T", "t.html"), ("b", "other.x", "O", "o.html")], "book_id string, type string, title string, href string")
    assert [(r.landmark, r.href) for r in classify.guide_to_landmark(guide).collect()] == [("bodymatter", "t.html")]
    ids = pages.ids(book(spark, a="<a name=q></a><p id=q>", b="<p id='q'>"))
    assert [tuple(r) for r in links.repeated_ids(ids).collect()] == [("q", 2)]


@pytest.mark.parametrize(("path", "bad"), [("a/b", False), ("../a", True), ("/a", True), ("a/../../b", True), ("C:/x", True), ("a/../b", False), ("\\x", True)])
def test_unsafe_paths(path, bad):
    assert archives.unsafe(path) == bad


def test_structure_rules(spark):
    ncx = "<ncx><head><meta/></head><docTitle><text>t</text></docTitle><navMap><navPoint><navLabel><text>x</text></navLabel><content/></navPoint></navMap></ncx>"
    docs = book(spark, a=ncx, b=ncx.replace("<content/>", "<content>y</content>"), c="<ncx><navMap><text>z</text></navMap><head/><head/><odd/></ncx>")
    els = M.elements(docs)
    got = {(r.doc, r.tname, r.issue) for r in classify.structure_check(els, classify.NAVIGATION, pages.element_texts(docs, els), free=()).collect()}
    assert got == {
        (1, "content", "void element has contents"), (2, "navmap", "head must precede"), (2, "text", "wrong parent"), (2, "head", "too many"), (2, "odd", "illegal element"), (2, "doctitle", "required element is missing"),
    }


def test_xml_links(spark):
    updates = spark.createDataFrame([("b", "OPS/a.xhtml", "OPS/new/a b.xhtml")], "book string, old_path string, new_path string")
    for kind, before, after in (
        ("ncx", "<content src='a.xhtml#f'/><item href='a.xhtml'/>", "<content src=\"new/a%20b.xhtml#f\"/><item href='a.xhtml'/>"), ("smil", "<par epub:textref='a.xhtml'><text src='a.xhtml#g'/></par>", '<par epub:textref="new/a%20b.xhtml"><text src="new/a%20b.xhtml#g"/></par>'),
        ("pagemap", "<page href='a.xhtml#p'/>", '<page href="new/a%20b.xhtml#p"/>'), ("opf", "<item href='http://x/a.xhtml'/><reference href='./a.xhtml'/>", "<item href='http://x/a.xhtml'/><reference href=\"new/a%20b.xhtml\"/>"),
    ):
        files = spark.createDataFrame([(1, "b", "OPS/x.xml", before)], "page_id long, book string, path string, html string")
        assert [r.html for r in rewrite.xml_renames(files, updates, kind).collect()] == [after]


def test_import(spark):
    html = '<html><head><link rel="stylesheet" href="s.css"/><script src="j.js"></script></head><body><img src="../pic.JPG"/><a href="other.html">o</a><img src="http://x/y.png"/><img src="none.png"/><video poster="p.png"></video></body></html>'
    page = spark.createDataFrame([(1, "b", "d/in.html", html), (2, "b", "d/other.html", None)], "page_id long, book string, path string, html string")
    files = spark.createDataFrame([("b", x) for x in ("d/s.css", "d/j.js", "pic.JPG", "d/p.png", "d/other.html", "d/free.png")], "book string, path string")
    made, media = rewrite.import_html(page, files)
    assert {(r.path, r.new_path) for r in media.collect()} == {("d/s.css", "Styles/s.css"), ("pic.JPG", "Images/pic.JPG"), ("d/p.png", "Images/p.png")}
    want = html.replace('"s.css"', '"../Styles/s.css"').replace('"../pic.JPG"', '"../Images/pic.JPG"').replace('"p.png"', '"../Images/p.png"')
    assert {(r.path, r.html) for r in made.collect()} == {("Text/in.html", want), ("Text/other.html", None)}


def test_font_licences(spark):
    bits = {None: "invalid-or-missing", 0: "installable", 2: "restricted", 4: "preview-and-print", 8: "editable", 0x108: "no-subsetting", 0x208: "bitmap-only", 6: "invalid-or-missing", 1: "invalid-or-missing", 0x8000: "invalid-or-missing"}
    rows = spark.createDataFrame([(k,) for k in bits], "b int").withColumn("x", archives.font_license("b")).collect()
    assert {r.b: r.x for r in rows} == bits
    entry = lambda tag, at: tag + bytes(4) + at.to_bytes(4, "big") + (96).to_bytes(4, "big")
    font = b"OTTO" + (2).to_bytes(2, "big") + bytes(6) + entry(b"CFF ", 0x4F532F32) + entry(b"OS/2", 44) + bytes(8) + (0x204).to_bytes(2, "big") + bytes(9)
    rows = [(font,), (font[:50],), (b"x",), (b"",), (None,)]
    assert [r.b for r in spark.createDataFrame(rows, "f binary").select(archives.font_embedding_bits("f").alias("b")).collect()] == [0x204, None, None, None, None]
