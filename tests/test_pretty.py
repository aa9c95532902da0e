"""Pretty printing: what may move, and that the second time changes nothing."""

import random

from quire.operators import links, pretty
from quire.operators import tokens as M


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")


def test_pages(spark):
    cases = {
        "<html><head><title>t</title></head><body><p>a <b>b</b> c</p>  <ul><li>x</li><li>y <ul><li>z</li></ul></li></ul></body></html>": (
            "<html>\n  <head>\n    <title>t</title>\n  </head>\n  <body>\n    <p>a <b>b</b> c</p>\n    <ul>\n      <li>x</li>\n      <li>y <ul>\n          <li>z</li>\n        </ul>\n      </li>\n    </ul>\n  </body>\n</html>"
        ),
        "<?xml version='1.0'?><!DOCTYPE html><div><p></p>\n\n\n<pre>a\n  <b>c</b>\n</pre><!-- c --></div>": "<?xml version='1.0'?>\n<!DOCTYPE html>\n<div>\n  <p></p>\n  <pre>a\n  <b>c</b>\n</pre>\n  <!-- c -->\n</div>",
        "<div><script>if (a) {\n}</script>text <br> <hr><i> </i> <p>q</p></div>": "<div>\n  <script>if (a) {\n}</script>text <br> <hr><i> </i> <p>q</p>\n</div>",
        "<div><p>a</div>": None, "<p>a</b></p>": None, "plain": None, "": None, None: None, "<p>a</p>": None,
    }
    got = {r.page_id: (r.status, r.html) for r in pretty.pretty(frame(spark, cases)).collect()}
    for k, (text, want) in enumerate(cases.items()):
        assert got[k][1] == (text if want is None else want), text
    assert [got[k][0] for k in range(9)] == ["formatted"] * 3 + ["skipped"] * 2 + ["unchanged"] * 4


def test_twice_is_once_and_nothing_is_lost(spark):
    r = random.Random(7)

    def tree(depth):
        name = r.choice(["div", "ul", "li", "p", "b", "i", "pre", "section"])
        parts = [r.choice([" ", "\n ", "x y", "", "<br>", "<!-- c -->", tree(depth - 1) if depth else "z"]) for _ in range(r.randint(0, 4))]
        return f"<{name} id='a{r.randrange(9)}'>{''.join(parts)}</{name}>"

    docs = frame(spark, [tree(5) for _ in range(80)])
    once = pretty.pretty(docs).cache()
    assert {r.status for r in once.collect()} == {"formatted", "unchanged"}
    assert {r.status for r in pretty.pretty(once.drop("status")).collect()} == {"unchanged"}
    assert all(r.equal for r in links.multiset_equal(docs, once).collect())
    squeezed = lambda df: {r.doc: "".join(r.text.split()) for r in M.visible_text(df).collect()}
    assert squeezed(docs) == squeezed(once)
