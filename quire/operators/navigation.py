"""Trees as rows and as markup: navigation files with their three lists, NCX files both ways, nested lists and indexes.

A tree is rows in order with a level. What opens and closes between two rows follows from their depths, by lead and lag, so that trees of any depth are written
without recursion; reading them back is the innermost element around each entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import tokens as M
from quire.operators.structure import heading_tree
from quire.plans.scratch import Scratch
from quire.plans.shares import dealt

# The sections of a navigation file.
SECTIONS = ["toc", "page-list", "landmarks"]


def nav_tables(docs: DataFrame, els: DataFrame) -> DataFrame:
    """doc, section, pos, lvl, title, href, kind of the links in navigation elements.

    section is the epub:type of the innermost nav around (toc, page-list, landmarks; null for others), pos the place in it, lvl how many lists of that nav are around, kind the link's own
    epub:type. Links outside of navigation elements are left out.
    """
    attr = lambda name: F.try_element_at(M.attributes("tok"), F.lit(name))
    made = Scratch(els.sparkSession, "nav").table(els.where("tname in ('a', 'nav', 'ul', 'ol')").select("doc", "eid", "end_seq", "tname", "tok", "alone"), "elements")
    els = dealt(made, "doc", like=docs)
    links = els.where("tname = 'a'").select("doc", F.col("eid").alias("seq"), attr("href").alias("href"), attr("epub:type").alias("kind"))
    navs = els.where("tname = 'nav'").withColumn("type", attr("epub:type"))
    found = M.around(links, navs, {"nav": F.col("eid"), "section": F.when(F.col("type").isin(*SECTIONS), F.col("type"))}).where("nav is not null")
    lists = M.around(found.select("doc", "seq", "nav"), els.where("tname in ('ul', 'ol')"), {"list": F.col("eid")}, every=True)
    levels = lists.where("list > nav").groupBy("doc", "seq").agg(F.count("*").alias("lvl"))
    inside = M.around(M.tokens(docs.withColumn("html", M.blanked("html")), positions=False).where("ttype = 'text'").select("doc", "seq", "tok"), els.where("tname = 'a'"), {"at": F.col("eid")}).where("at is not null")
    titles = inside.groupBy("doc", F.col("at").alias("seq")).agg(_joined("seq", "tok").alias("title"))
    whole = found.join(levels, ["doc", "seq"], "left").join(titles, ["doc", "seq"], "left")
    pos = F.row_number().over(Window.partitionBy("doc", "section").orderBy("seq")).cast("long")
    return whole.select("doc", "section", pos.alias("pos"), F.coalesce("lvl", F.lit(0)).cast("long").alias("lvl"), T.simplified(F.coalesce("title", F.lit(""))).alias("title"), F.coalesce("href", F.lit("")).alias("href"), "kind")


def _joined(order: str, value: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), "")


def nested(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, pos, lvl, ...) with depth, opens (the next row lies in this one) and closes (how many end after it, itself included unless it opens).

    A row lies in the nearest earlier one of a smaller level; the depth counts such rows, so that levels may be left out. Levels may be any numbers; a null level is 0.
    """
    level = F.coalesce("lvl", F.lit(0))
    distinct = [r[0] for r in rows.select(level.alias("l")).distinct().orderBy("l").limit(1001).collect()]
    if len(distinct) > 1000:
        raise ValueError("more than 1000 different levels")
    numbered = F.create_map(*(F.lit(x) for n, v in enumerate(distinct, 1) for x in (v, n))) if distinct else None
    place = F.try_element_at(numbered, level) if distinct else F.lit(1)
    heads = rows.withColumn("_d", F.struct(*keys)).select("*", F.struct(*rows.columns).alias("_row")).select(F.col("_d").alias("doc"), F.col("pos").cast("long").alias("seq"), place.alias("level"), "_row")
    deep = heading_tree(heads, max(2, len(distinct))).select("_row.*", F.col("toc_level").cast("long").alias("depth"))
    following = F.coalesce(F.lead("depth").over(Window.partitionBy(*keys).orderBy("pos")), F.lit(1))
    last = F.lead("depth").over(Window.partitionBy(*keys).orderBy("pos")).isNull()
    opens = ~last & (following > F.col("depth"))
    return deep.withColumns({"opens": opens, "closes": F.when(last, F.col("depth")).otherwise(F.greatest(F.col("depth") - following + 1, F.lit(0)))})


def nested_lists(rows: DataFrame, keys: list[str], item: Column, tag: str = "ul", before: Column | None = None) -> DataFrame:
    """(keys, markup): rows as nested lists in order of pos; item is the markup of an entry, before what stands as an item of its own before it."""
    made = nested(rows.withColumns({"_item": item, "_before": before if before is not None else F.lit("")}), keys)
    end = F.concat(F.lit("</li>"), F.repeat(F.lit(f"</{tag}></li>"), (F.col("closes") - 1).cast("int")))
    text = F.concat("_before", F.lit("<li>"), "_item", F.when(F.col("opens"), F.lit(f"<{tag}>")).otherwise(end))
    # the last row closes its own list too, which the whole opens
    whole = made.withColumn("_t", text).groupBy(*keys).agg(_joined("pos", "_t").alias("markup"))
    return whole.select(*keys, F.concat(F.lit(f"<{tag}>"), "markup", F.lit(f"</{tag}>")).alias("markup"))


def ncx(entries: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(doc, ncx): an NCX file for each document of ``nav_tables`` rows: nested navigation points in play order, then page targets that go on counting.

    titles: (doc, title, uid), empty where they are missing. Titles are markup and taken as they are; addresses are escaped.
    """
    # read four times
    entries = Scratch(entries.sparkSession, "ncx").table(entries.select("doc", "section", "pos", "lvl", "title", "href"), "entries")
    href = F.replace(F.replace("href", F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))
    number = lambda c: F.col(c).cast("string")
    toc = nested(entries.where("section = 'toc'").select("doc", "pos", "lvl", "title", "href"), ["doc"])
    label = F.concat(F.lit("<navLabel><text>"), "title", F.lit('</text></navLabel><content src="'), href, F.lit('"/>'))
    point = F.concat(F.lit('<navPoint id="navPoint'), number("pos"), F.lit('" playOrder="'), number("pos"), F.lit('">'), label, F.repeat(F.lit("</navPoint>"), F.col("closes").cast("int")))
    maps = toc.withColumn("_t", point).groupBy("doc").agg(_joined("pos", "_t").alias("map"), F.max("depth").alias("depth"), F.max("pos").alias("n"))
    counted = entries.where("section = 'page-list'").join(maps.select("doc", "n"), "doc", "left").withColumn("play", F.col("pos") + F.coalesce("n", F.lit(0)))
    page = F.concat(F.lit('<pageTarget id="navPoint'), number("play"), F.lit('" type="normal" playOrder="'), number("play"), F.lit('" value="'), F.replace("title", F.lit('"'), F.lit("&quot;")), F.lit('">'), label, F.lit("</pageTarget>"))
    listed = counted.withColumn("_t", page).groupBy("doc").agg(_joined("pos", "_t").alias("pages"), F.count("*").alias("n_pages"))
    rows = entries.select("doc").distinct().join(maps, "doc", "left").join(listed, "doc", "left")
    rows = rows.withColumns({"title": F.lit(""), "uid": F.lit("")}) if titles is None else rows.join(titles.select("doc", "title", "uid"), "doc", "left")
    meta = lambda name, c: F.concat(F.lit(f'<meta name="dtb:{name}" content="'), F.coalesce(c, F.lit("")), F.lit('"/>'))
    count = F.coalesce("n_pages", F.lit(0)).cast("string")
    head = F.concat(meta("uid", F.col("uid")), meta("depth", F.coalesce("depth", F.lit(0)).cast("string")), meta("totalPageCount", count), meta("maxPageNumber", count))
    whole = F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head>'), head, F.lit("</head><docTitle><text>"), F.coalesce("title", F.lit("")), F.lit("</text></docTitle><navMap>"),
        F.coalesce("map", F.lit("")), F.lit("</navMap>"), F.when(F.col("pages").isNotNull(), F.concat(F.lit("<pageList>"), "pages", F.lit("</pageList>"))).otherwise(""), F.lit("</ncx>"),
    )
    return rows.select("doc", whole.alias("ncx"))


def read_ncx(files: DataFrame, id_col: str = "doc", text_col: str = "ncx") -> DataFrame:
    """doc, section (toc, page-list or title), pos, lvl, title, href, value: what NCX files say, namespace prefixes or not.

    Navigation points come in order of their begin tags, at the depth of their nesting; one without an address has an empty href. A document type goes first.
    """
    plain = files.select(F.col(id_col).alias("page_id"), F.regexp_replace(text_col, r"(?is)<!DOCTYPE[^<>\[]*(?:\[.*?\])?\s*>", "").alias("html"))
    toks = M.tokens(plain, positions=False)
    els = M.elements(plain).withColumn("tname", F.regexp_replace("tname", "^[^:]*:", "")).where("tname in ('navpoint', 'pagetarget', 'navlabel', 'content', 'doctitle')")
    els = Scratch(files.sparkSession, "ncx").table(els.select("doc", "eid", "end_seq", "tname", "tok", "alone"), "elements")
    points, attr = els.where("tname in ('navpoint', 'pagetarget')"), lambda name: F.try_element_at(M.attributes("tok"), F.lit(name))
    levels = M.around(points.select("doc", F.col("eid").alias("seq"), "tname", attr("value").alias("value")), points, {"up_eid": F.col("eid")}, every=True).groupBy("doc", "seq").agg((F.count("*") + 1).alias("lvl"))
    own = points.select("doc", F.col("eid").alias("seq"), "tname", attr("value").alias("value")).join(levels, ["doc", "seq"], "left")
    contents = M.around(els.where("tname = 'content'").select("doc", F.col("eid").alias("seq"), attr("src").alias("src")), points, {"at": F.col("eid")}).where("at is not null")
    hrefs = contents.groupBy("doc", F.col("at").alias("seq")).agg(F.min_by("src", "seq").alias("href"))
    words = M.around(toks.where("ttype = 'text'").select("doc", "seq", "tok"), els.where("tname in ('navlabel', 'doctitle')"), {"label": F.col("tname")}).where("label is not null")
    words = M.around(words, points, {"at": F.col("eid")})
    labels = words.where("label = 'navlabel' and at is not null").groupBy("doc", F.col("at").alias("seq")).agg(T.simplified(_joined("seq", "tok")).alias("title"))
    rows = own.join(hrefs, ["doc", "seq"], "left").join(labels, ["doc", "seq"], "left").withColumn("section", F.when(F.col("tname") == "navpoint", "toc").otherwise("page-list"))
    pos = F.row_number().over(Window.partitionBy("doc", "section").orderBy("seq")).cast("long")
    listed = rows.select("doc", "section", pos.alias("pos"), F.coalesce("lvl", F.lit(1)).cast("long").alias("lvl"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("href", F.lit("")).alias("href"), "value")
    titles = words.where("label = 'doctitle'").groupBy("doc").agg(T.simplified(_joined("seq", "tok")).alias("title"))
    return listed.unionByName(titles.select("doc", F.lit("title").alias("section"), F.lit(1).cast("long").alias("pos"), F.lit(0).cast("long").alias("lvl"), "title", F.lit("").alias("href"), F.lit(None).cast("string").alias("value")))


def index_rows(hits: DataFrame, book: str = "book") -> DataFrame:
    """book, pos, lvl, name, path, targets, letter: the index of each book as a tree, in order without case.

    hits: book, entry (levels split by /), found (order), target (an address). An entry's targets stand with it in found order, each once; categories have none of their own. letter is the
    first letter, in upper case, of a root entry that differs from that of the root before.
    """
    levels = F.split("entry", "/")
    leaf = hits.groupBy(book, "entry", "target").agg(F.min("found").alias("found")).groupBy(book, levels.alias("names")).agg(F.transform(F.array_sort(F.collect_list(F.struct("found", "target"))), lambda x: x["target"]).alias("targets"))
    up = leaf.select(book, F.explode(F.transform(F.sequence(F.lit(1), F.size("names")), lambda k: F.slice("names", 1, k))).alias("names")).distinct()
    rows = up.join(leaf, [book, "names"], "left")
    order = Window.partitionBy(book).orderBy(F.transform("names", F.lower), "names")
    placed = rows.withColumn("pos", F.row_number().over(order).cast("long"))
    first = F.upper(F.substring(F.col("names")[0], 1, 1))
    root = F.size("names") == 1
    before = F.last(F.when(root, first), ignorenulls=True).over(Window.partitionBy(book).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return placed.select(
        book, "pos", F.size("names").cast("long").alias("lvl"), F.element_at("names", -1).alias("name"), F.array_join("names", "/").alias("path"), F.coalesce("targets", F.array().cast("array<string>")).alias("targets"),
        F.when(root & ~first.eqNullSafe(before), first).alias("letter"),
    )


def render_index(rows: DataFrame, book: str = "book") -> DataFrame:
    """(book, markup): rows of ``index_rows`` as nested lists with numbered links, and an item for each new letter."""
    one = lambda x, i: F.concat(F.lit('<a href="'), x, F.lit('">'), (i + 1).cast("string"), F.lit("</a>"))
    item = F.concat(T.html_escape("name"), F.when(F.size("targets") > 0, " ").otherwise(""), F.array_join(F.transform("targets", one), ", "))
    letter = F.when(F.col("letter").isNotNull(), F.concat(F.lit('<li class="letter">'), T.html_escape("letter"), F.lit("</li>"))).otherwise("")
    return nested_lists(rows, [book], item, before=letter)
