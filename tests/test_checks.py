"""Issues of markup with their places, and the validation of staged files."""

from quire.operators import checks


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")


PAGE = '<html><head></head><body>{}</body></html>'


CASES = [
    ("<p>a</p>", []), ("<p>a\n <b>c", [("unclosed", 1, 26), ("unclosed", 2, 2)]), ("x</b>", [("stray", 1, 27)]), ("\n\n<b><i></b></i>", [("crossing", 3, 1), ("crossing", 3, 4), ("crossing", 3, 7), ("crossing", 3, 11)]),
    ("<br></br>", [("void-end", 1, 30)]), ("<p><p>x</p></p>", [("nested-p", 1, 29)]), ("<i a=b></i>", [("attributes", 1, 26)]), ('<i a="b"c="d"></i>', [("attributes", 1, 26)]), ("<i a='1' A='2'></i>", [("twice", 1, 26)]),
    ("1 < 2", [("sign", 1, 28)]), ("<i id=\"q\"></i><b id='q'></b>", [("id-twice", 1, 40)]), ("<link rel='stylesheet' href='a'/>", [("link-type", 1, 26)]), ("<head></head>", [("order", 1, 26), ("parts", 1, 26)]), ("<!DOCTYPE html>", [("order", 1, 26)]),
    ("<script>if (a<b) x='</p>';</script>", []), ("<b>é😀\n</b></i>", [("stray", 2, 5)]),
]


def test_issues(spark):
    found = {}
    for r in checks.issues(frame(spark, *(PAGE.format(body) for body, _ in CASES))).collect():
        found.setdefault(r.doc, []).append((r.code, r.line, r.col))
    for k, (body, want) in enumerate(CASES):
        assert sorted(found.get(k, [])) == sorted(want), body


def test_first_errors(spark):
    docs = frame(spark, PAGE.format("\n</b>\n</i><u>"), PAGE.format(""), "", None, "<p>x</p>")
    got = {r.doc: tuple(r)[1:] for r in checks.well_formed(docs, checks.issues(docs)).collect()}
    assert got[0] == (1, 2, 0, 3, False, True, 2, 1, "stray end tag: b") and got[1] == (0, 0, 0, 0, True, True, None, None, None)
    assert got[2] == got[3] == (0, 0, 0, 3, True, False, 1, 1, "missing or multiple body tags") and got[4][4:6] == (True, False)
    assert checks.issues(docs.limit(0)).count() == 0


def test_staged_files(spark):
    rows = [
        ("a.xhtml", "application/xhtml+xml; charset=utf-8", "<html><body><p>x</p></body></html>"), ("b.opf", "application/oebps-package+xml", "<package><meta>x</meta></package>"), ("c.css", "text/css", "p{"), ("d.xhtml", "application/xhtml+xml", "<html>\n<br></html>"),
        ("e.svg", "IMAGE/SVG+XML", "<svg a=b/>"), ("f.xml", None, "<a/>"), ("g.xml", " ", "<a/>"), ("h.xml", "text/xml", "<a>x & y</a>"), ("i.xml", "application/foo+xml", ""), ("j.xml", "text/xml", None), ("k.xml", "text/xml", "<a b='1' b='2'/>"), ("l.ncx", "application/x-dtbncx+xml", "<ncx>&amp;</ncx>"),
    ]
    got = {r.path: (r.status, r.n_issues, r.line, r.col) for r in checks.validate_staged(spark.createDataFrame(rows, "path string, media_type string, text string")).collect()}
    assert got == {
        "a.xhtml": ("valid", 0, None, None), "b.opf": ("valid", 0, None, None), "c.css": ("unchecked", 0, None, None), "d.xhtml": ("invalid", 1, 2, 1), "e.svg": ("invalid", 1, 1, 1), "f.xml": ("missing media type", 1, None, None), "g.xml": ("missing media type", 1, None, None),
        "h.xml": ("invalid", 1, 1, 4), "i.xml": ("invalid", 1, 1, 1), "j.xml": ("invalid", 1, 1, 1), "k.xml": ("invalid", 1, 1, 1), "l.ncx": ("valid", 0, None, None),
    }
