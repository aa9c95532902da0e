"""Classifying pages and books: flows of pseudo paragraphs and their normal form, layout of stylesheets, package rules, and small reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import tokens as M

# EPUB 2 guide types and EPUB 3 landmarks; classes and properties of vertical layouts; thresholds of automatic rewrites.
LANDMARKS = {
    "cover": "cover", "title-page": "titlepage", "toc": "toc", "index": "index", "glossary": "glossary", "acknowledgements": "acknowledgments", "bibliography": "bibliography", "colophon": "colophon",
    "copyright-page": "copyright-page", "dedication": "dedication", "epigraph": "epigraph", "foreword": "foreword", "loi": "loi", "lot": "lot", "notes": "endnotes", "preface": "preface", "text": "bodymatter",
}
LEAST_PARAGRAPHS, LEAST_BREAKS = 4, 4


def guide_to_landmark(guide: DataFrame) -> DataFrame:
    """guide (book_id, type, title, href) with the landmark's code; unknown types are left out."""
    table = F.create_map(*(F.lit(x) for kv in LANDMARKS.items() for x in kv))
    return guide.withColumn("landmark", F.try_element_at(table, F.lower("type"))).where("landmark is not null")


def semantics(resources: DataFrame, roles: DataFrame) -> DataFrame:
    """(bookpath, semantics): roles (bookpath, role) of each file, joined by commas in order."""
    lists = roles.groupBy("bookpath").agg(F.array_join(F.array_sort(F.collect_set("role")), ", ").alias("semantics"))
    return resources.select("bookpath").join(lists, "bookpath", "left").fillna("", ["semantics"])


def css_files_report(sheets: DataFrame, links: DataFrame) -> DataFrame:
    """(path, size_kb, n_pages, is_total) of stylesheets (path, css): by how many pages (page_id, path) each is linked; and totals."""
    used = links.groupBy("path").agg(F.countDistinct("page_id").alias("n_pages"))
    rows = sheets.select("path", F.round(F.octet_length("css") / 1024, 2).alias("size_kb")).join(used, "path", "left").fillna(0, ["n_pages"])
    return rows.groupingSets([["path"], []], "path").agg(F.round(F.sum("size_kb"), 2).alias("size_kb"), F.sum("n_pages").alias("n_pages"), F.grouping("path").cast("int").alias("is_total"))


def image_report(images: DataFrame, uses: DataFrame) -> DataFrame:
    """path, size, n_used, width, height, pixels of images (path, bytes); dimensions of PNG and GIF only."""
    from quire.operators.links import media_usage
    from quire.sources.archives import image_size

    w, h = image_size("bytes")
    counts = media_usage(images, uses).withColumnRenamed("n", "n_used")
    return images.select("path", F.octet_length("bytes").alias("size"), w.alias("width"), h.alias("height")).join(counts, "path").withColumn("pixels", F.col("width") * F.col("height"))


def normalize_breaks(pages: DataFrame, els: DataFrame) -> DataFrame:
    """(page_id, html, status): runs between line breaks in the body of automatically safe pages become paragraphs.

    Safe: balanced tags, no paragraphs yet, at least four breaks and four paragraphs to be. A page whose texts, ids or links would differ keeps
    its markup (status ``kept``).
    """
    body = F.regexp_extract("html", r"(?is)<body\b[^>]*>(.*)</body>", 1)
    runs = F.filter(F.split(body, r"(?i)<br\s*/?>"), lambda x: x.rlike(r"\S"))
    counts = els.groupBy(F.col("doc").alias("page_id")).agg(F.count_if(F.col("tname") == "br").alias("n_br"), F.count_if(F.col("tname").isin(*M.BLOCK)).alias("n_block"), F.bool_and("matched").alias("ok"))
    rows = pages.select("page_id", "html").join(counts, "page_id", "left").withColumn("runs", runs)
    safe = F.coalesce(F.col("ok") & (F.col("n_br") >= LEAST_BREAKS) & (F.col("n_block") == 0) & (F.size("runs") >= LEAST_PARAGRAPHS), F.lit(False))
    made = F.concat(F.regexp_extract("html", r"(?is)^(.*<body\b[^>]*>)", 1), F.array_join(F.transform("runs", lambda x: F.concat(F.lit("<p>"), F.btrim(x), F.lit("</p>"))), "\n"), F.regexp_extract("html", r"(?is)(</body>.*)$", 1))
    marks = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(r"""(?i)\b(?:id|name|href|src)\s*=\s*(?:"[^"]*"|'[^']*')"""), F.lit(0)))
    texts = lambda c: T.compact(F.regexp_replace(c, r"<[^<>]*>", ""))
    staged = rows.withColumns({"safe": safe, "made": made})
    same = (marks(F.col("html")) == marks(F.col("made"))) & (texts(F.col("html")) == texts(F.col("made")))
    status = F.when(~F.col("safe"), "unsafe").when(same, "normalized").otherwise("kept")
    return staged.select("page_id", F.when(F.col("safe") & same, F.col("made")).otherwise(F.col("html")).alias("html"), status.alias("status"))


def spacer_paragraphs(pages: DataFrame) -> DataFrame:
    """(page_id, html, removed): empty paragraphs whose style gives them no height go; those with a height stay."""
    rx = r"""(?is)<p\b[^<>]*style\s*=\s*["'][^"'<>]*\bheight\s*:\s*0(?:px|em|%|pt)?\s*[;"'][^<>]*>\s*(?:&nbsp;|\x{A0})?\s*</p>\s*"""
    return pages.select("page_id", F.regexp_replace("html", rx, "").alias("html"), F.regexp_count("html", F.lit(rx)).cast("long").alias("removed"))


def div_paragraphs(els: DataFrame, least: int = LEAST_PARAGRAPHS) -> DataFrame:
    """(doc, parent_eid, n): the content parent of each page, the element with most leaf divs, if they are enough to be paragraphs."""
    inner = els.select("doc", F.col("parent_eid").alias("eid")).where("eid is not null").distinct()
    leaves = els.where("tname = 'div' and not alone").join(inner, ["doc", "eid"], "left_anti")
    counts = leaves.groupBy("doc", "parent_eid").agg(F.count("*").alias("n"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n"), "parent_eid")))
    return best.where(f"r = 1 and n >= {least}").drop("r")


def div_normalize(pages: DataFrame, els: DataFrame) -> DataFrame:
    """(page_id, html, n): leaf divs of the content parent become paragraphs; pages without such a parent are left out."""
    parents = div_paragraphs(els).select("doc", F.col("parent_eid").alias("p"))
    inner = els.select("doc", F.col("parent_eid").alias("eid")).where("eid is not null").distinct()
    leaves = els.where("tname = 'div' and not alone and matched").join(inner, ["doc", "eid"], "left_anti").join(parents, "doc").where("parent_eid = p").select("doc", "eid", "end_seq")
    marks = leaves.select("doc", F.explode(F.array("eid", "end_seq")).alias("seq")).withColumn("hit", F.lit(1))
    toks = M.tokens(pages.withColumn("html", M.blanked("html")), positions=False).join(marks, ["doc", "seq"], "left")
    new = F.when(F.col("hit").isNotNull(), F.regexp_replace("tok", r"(?i)^(</?)div\b", "$1p")).otherwise(F.col("tok"))
    out = toks.withColumn("t", new).groupBy(F.col("doc").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "t"))), lambda x: x["t"]), "").alias("html"), (F.count("hit") / 2).cast("long").alias("n"))
    return out.where("n > 0")


def css_layout_features(decls: DataFrame) -> DataFrame:
    """Per stylesheet: vertical writing, its classes, upright and combined text, absolute places, rotation."""
    prop = F.regexp_replace("prop", "^-(?:epub|webkit|ms|moz)-", "")
    rows = decls.withColumns({"p": prop, "v": F.lower("value")})
    vertical = (F.col("p") == "writing-mode") & F.col("v").rlike("vertical|tb-")
    horizontal = (F.col("p") == "writing-mode") & F.col("v").rlike("horizontal|lr-")
    return rows.groupBy("doc").agg(
        F.bool_or(vertical).alias("vertical"), F.bool_or(horizontal).alias("horizontal"), F.array_join(F.array_sort(F.collect_set(F.when(vertical, F.col("selector")))), ",").alias("vertical_selectors"),
        F.bool_or((F.col("p") == "text-orientation") & (F.col("v") == "upright")).alias("upright"), F.bool_or(F.col("p").isin("text-combine", "text-combine-upright", "text-combine-horizontal")).alias("combine"),
        F.bool_or((F.col("p") == "position") & (F.col("v") == "absolute")).alias("absolute"), F.bool_or((F.col("p") == "transform") & F.col("v").contains("rotate")).alias("rotate"),
    )


def effective_mode(pages: DataFrame, features: DataFrame, uses: DataFrame) -> DataFrame:
    """(page_id, mode): own style of html or body, else a vertical sheet it uses (page_id, doc) by root class or for all, else horizontal.

    pages: page_id, html.
    """
    own = F.lower(F.regexp_extract("html", r"""(?is)<(?:html|body)\b[^<>]*style\s*=\s*["'][^"']*writing-mode\s*:\s*([a-z-]+)""", 1))
    root = F.regexp_extract("html", r"""(?is)<html\b[^<>]*class\s*=\s*["']([^"']*)["']""", 1)
    sheets = uses.join(features.where("vertical").select("doc", "vertical_selectors"), "doc").groupBy("page_id").agg(F.flatten(F.collect_list(F.split("vertical_selectors", ","))).alias("sel"))
    rows = pages.select("page_id", own.alias("own"), root.alias("root")).join(sheets, "page_id", "left")
    by_sheet = F.exists("sel", lambda s: s.isin("html", "body", "*") | F.array_contains(F.split("root", r"\s+"), F.regexp_extract(s, r"^(?:html)?\.([-\w]+)$", 1)))
    return rows.select("page_id", F.when(F.col("own").rlike("^(?:vertical|tb)"), "vertical").when(F.col("own") != "", "horizontal").when(F.coalesce(by_sheet, F.lit(False)), "vertical").otherwise("horizontal").alias("mode"))


def layout_summary(modes: DataFrame, kinds: DataFrame) -> DataFrame:
    """Per book (page_id, book; modes; kinds): pages, vertical ones and those of images only."""
    return kinds.join(modes, "page_id", "left").groupBy("book").agg(F.count("*").alias("n_pages"), F.count_if(F.col("mode") == "vertical").alias("n_vertical"), F.count_if(F.col("kind") == "image_only").alias("n_image_only"))


def profile(signals: DataFrame, families: dict[str, dict[str, int]], least: int = 50) -> DataFrame:
    """(book, family, score): the template family with the highest score of its signals (book, signal), from 50 on; else generic, or none without signals."""
    weights = [(f, s, w) for f, ws in families.items() for s, w in ws.items()]
    table = F.broadcast(signals.sparkSession.createDataFrame(weights, "family string, signal string, weight int"))  # a parameter of the call
    scored = signals.distinct().join(table, "signal", "left").groupBy("book", "family").agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("score"))
    top = scored.withColumn("r", F.row_number().over(Window.partitionBy("book").orderBy(F.desc("score"), "family"))).where("r = 1")
    return top.select("book", F.when(F.col("score") >= least, F.col("family")).when(F.col("score") > 0, "generic").otherwise("none").alias("family"), "score")


def convert_direction(pages: DataFrame, modes: DataFrame, override: str = "horizontal-override") -> DataFrame:
    """(book, page_id, html, converted): vertical pages get an override class at their root; a book converts whole or not at all.

    pages: book, page_id, html. A vertical page without an html element fails its book.
    """
    rows = pages.join(modes, "page_id", "left")
    has_class = F.col("html").rlike(r"""(?is)<html\b[^<>]*\bclass\s*=""")
    made = F.when(has_class, F.regexp_replace("html", r"""(?is)(<html\b[^<>]*\bclass\s*=\s*["'])""", f"$1{override} ")).otherwise(F.regexp_replace("html", r"(?i)<html\b", f'<html class="{override}"'))
    vertical = F.coalesce(F.col("mode") == "vertical", F.lit(False))
    staged = rows.withColumns({"made": F.when(vertical, made).otherwise(F.col("html")), "fine": ~vertical | (made != F.col("html"))})
    whole = staged.groupBy(F.col("book").alias("_book")).agg(F.bool_and("fine").alias("whole"))
    return staged.join(whole, F.col("book").eqNullSafe(F.col("_book"))).select("book", "page_id", F.when(F.col("whole"), F.col("made")).otherwise(F.col("html")).alias("html"), (F.col("whole") & vertical).alias("converted"))


@dataclass(frozen=True)
class ElementRule:
    """An element of a package file: its allowed parents (none: the root), whether it is void, how often it stands, and what must stand before it."""

    tname: str
    parents: tuple[str, ...] = ()
    void: bool = False
    least: int = 0
    most: int | None = None
    after: tuple[str, ...] = ()


# The structure of a package file, as far as both versions share it.
PACKAGE = [
    ElementRule("package", (), least=1, most=1), ElementRule("metadata", ("package",), least=1, most=1), ElementRule("manifest", ("package",), least=1, most=1, after=("metadata",)),
    ElementRule("item", ("manifest",), void=True, least=1), ElementRule("spine", ("package",), least=1, most=1, after=("metadata", "manifest")), ElementRule("itemref", ("spine",), void=True, least=1),
    ElementRule("guide", ("package",), most=1, after=("metadata", "manifest", "spine")), ElementRule("reference", ("guide",), void=True),
]
NAVIGATION = [
    ElementRule("ncx", (), least=1, most=1), ElementRule("head", ("ncx",), least=1, most=1), ElementRule("meta", ("head",), void=True), ElementRule("doctitle", ("ncx",), least=1, most=1, after=("head",)),
    ElementRule("navmap", ("ncx",), least=1, most=1, after=("head",)), ElementRule("navpoint", ("navmap", "navpoint")), ElementRule("navlabel", ("navpoint",)), ElementRule("text", ("navlabel", "doctitle")), ElementRule("content", ("navpoint",), void=True),
]


def structure_check(els: DataFrame, rules: list[ElementRule], texts: DataFrame | None = None, version: str = "3.0", free: tuple[str, ...] = ("metadata",)) -> DataFrame:
    """(doc, eid, tname, issue) of elements against rules; eid is null for a required element that is missing.

    free: elements in which anything may stand. texts (doc, eid, text): with it, void elements must not hold any. Version 2.0 knows no properties of items.
    """
    spark = els.sparkSession
    rows = [(r.tname, list(r.parents), r.void, r.least, r.most, list(r.after)) for r in rules]
    table = F.broadcast(spark.createDataFrame(rows, "tname string, parents array<string>, void boolean, least int, most int, after array<string>"))  # a parameter of the call
    ups = els.select("doc", F.col("eid").alias("parent_eid"), F.col("tname").alias("up"))
    order = Window.partitionBy("doc", "tname").orderBy("eid")
    placed = els.withColumn("nth", F.row_number().over(order)).join(ups, ["doc", "parent_eid"], "left").where(~F.coalesce("up", F.lit("")).isin(*free))
    known = placed.join(table, "tname", "left").withColumn("known", F.col("parents").isNotNull())
    firsts = els.groupBy("doc", F.col("tname").alias("before")).agg(F.min("eid").alias("first"))
    needs = known.where("known").select("doc", "eid", F.explode("after").alias("before")).join(firsts, ["doc", "before"], "left").where("first is null or first > eid").groupBy("doc", "eid").agg(F.min("before").alias("lacks"))
    checked = known.join(needs, ["doc", "eid"], "left")
    if texts is not None:
        checked = checked.join(texts.select("doc", "eid", F.col("text").rlike(r"\S").alias("filled")), ["doc", "eid"], "left")
    else:
        checked = checked.withColumn("filled", F.lit(False))
    properties = F.lit(version == "2.0") & (F.col("tname") == "item") & F.try_element_at(M.attributes("tok"), F.lit("properties")).isNotNull()
    issue = (
        F.when(~F.col("known"), "illegal element").when(F.col("nth") > F.col("most"), "too many").when(F.col("up").isNotNull() & ~F.array_contains("parents", F.col("up")), "wrong parent").when(F.col("lacks").isNotNull(), F.concat(F.col("lacks"), F.lit(" must precede")))
        .when(properties, "properties in version 2.0").when(F.col("void") & F.coalesce("filled", F.lit(False)), "void element has contents")
    )
    wrong = checked.withColumn("issue", issue).where("issue is not null").select("doc", "eid", "tname", "issue")
    counts = els.groupBy("doc").agg(*(F.count_if(F.col("tname") == r.tname).alias(f"n_{k}") for k, r in enumerate(rules)))
    lacking = F.array_compact(F.array(*(F.when(F.col(f"n_{k}") < r.least, F.lit(r.tname)) for k, r in enumerate(rules))))
    missing = counts.select("doc", F.lit(None).cast("int").alias("eid"), F.explode(lacking).alias("tname")).withColumn("issue", F.lit("required element is missing"))
    return wrong.unionByName(missing)


def package_check(els: DataFrame, rules: list[tuple[str, str, int, int | None]]) -> DataFrame:
    """(doc, tname, issue): elements with a wrong parent, and wrong counts, by rules (element, allowed parent, at least, at most)."""
    table = F.broadcast(els.sparkSession.createDataFrame(rules, "tname string, parent string, least int, most int"))  # a parameter of the call
    ups = els.select("doc", F.col("eid").alias("parent_eid"), F.col("tname").alias("p"))
    pairs = els.select("doc", "eid", "tname", "parent_eid").join(ups, ["doc", "parent_eid"], "left").join(table, "tname")
    wrong = pairs.where(~F.coalesce("p", F.lit("")).eqNullSafe(F.col("parent"))).select("doc", "tname", F.concat(F.lit("parent is "), F.coalesce("p", F.lit("none"))).alias("issue"))
    counts = els.select("doc").distinct().crossJoin(table).join(els.groupBy("doc", "tname").agg(F.count("*").alias("n")), ["doc", "tname"], "left").fillna(0, ["n"])
    off = counts.where("n < least or n > most").select("doc", "tname", F.concat(F.lit("count is "), F.col("n").cast("string")).alias("issue"))
    return wrong.unionByName(off)
