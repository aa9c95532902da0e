"""Page-level operators: texts of elements, languages, reports, checks, layout classes and rewrites of markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import tokens as M

#: Fixed value: letters joined by apostrophes and hyphens are one word.
WORD = r"[\p{L}]+(?:['’-][\p{L}]+)*"


def _text_tokens(docs: DataFrame) -> DataFrame:
    return M.tokens(docs.withColumn("html", M.blanked("html")), positions=False).where("ttype = 'text'")


def own_lang() -> Column:
    """The language that a tag names."""
    a = M.attributes("tok")
    return F.coalesce(F.try_element_at(a, F.lit("lang")), F.try_element_at(a, F.lit("xml:lang")))


def token_lang(docs: DataFrame, els: DataFrame, default: str = "en") -> DataFrame:
    """(doc, seq, lang) of text tokens: of the innermost element around that names one (lang, else xml:lang)."""
    named = els.withColumn("lang", own_lang()).where("lang is not null")
    found = M.around(_text_tokens(docs).select("doc", "seq"), named, {"lang": F.col("lang")})
    return found.withColumn("lang", F.coalesce("lang", F.lit(default)))


def with_lang(els: DataFrame, default: str) -> DataFrame:
    """Elements with the language in force."""
    rows = els.withColumn("lang", F.lower(own_lang()))
    found = M.around(rows.withColumn("seq", F.col("eid")), rows.where("lang is not null"), {"_lang": F.col("lang")})
    return found.withColumn("lang", F.coalesce("lang", "_lang", F.lit(default))).drop("seq", "_lang")


def element_at(els: DataFrame, places: DataFrame) -> DataFrame:
    """For (doc, seq): innermost open element, path of its ancestors, and whether it is in the body; places outside of all elements are left out."""
    inside = M.around(places, els, {"eid": F.col("eid"), "tname": F.col("tname")}, every=True)
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("up", "tname"))), lambda x: x["tname"]), "/")
    return inside.groupBy("doc", "seq").agg(F.max("eid").alias("eid"), path.alias("path"), F.bool_or(F.col("tname") == "body").alias("in_body"))


def element_texts(docs: DataFrame, els: DataFrame) -> DataFrame:
    """(doc, eid, text, own_text): the texts below an element, and those directly in it (of the elements given, it is the innermost)."""
    inside = M.around(_text_tokens(docs).select("doc", "seq", "tok"), els, {"eid": F.col("eid")}, every=True)
    nearest = inside.withColumn("own", F.max("up").over(Window.partitionBy("doc", "seq")) == F.col("up"))
    joined = lambda x: F.array_join(F.transform(F.array_sort(x), lambda y: y["tok"]), "")
    return nearest.groupBy("doc", "eid").agg(joined(F.collect_list(F.struct("seq", "tok"))).alias("text"), joined(F.collect_list(F.when(F.col("own"), F.struct("seq", "tok")))).alias("own_text"))


def classes_used(docs: DataFrame) -> DataFrame:
    tags = M.tokens(docs, positions=False).where("ttype in ('begin', 'single')")
    split = tags.select("doc", "tname", F.explode(F.split(F.try_element_at(M.attributes("tok"), F.lit("class")), " ")).alias("c"))
    return split.select("doc", F.concat_ws(".", "tname", "c").alias("class_used")).distinct()


def line_at(text: Column | str, pos: Column | str) -> Column:
    """1-based line of a 0-based offset."""
    before = F.substring(T.col(text), F.lit(1), T.col(pos).cast("int"))
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")


def first_use_of_class(docs: DataFrame, name: str) -> DataFrame:
    """(doc, line): the line of the first tag with the class, -1 if there is none."""
    used = M.tokens(docs).where("ttype in ('begin', 'single')").where(F.array_contains(F.split(F.try_element_at(M.attributes("tok"), F.lit("class")), " "), name))
    firsts = used.groupBy("doc").agg(F.min("pos").alias("pos"))
    return docs.select(F.col("page_id").alias("doc"), "html").join(firsts, "doc", "left").select("doc", F.coalesce(line_at("html", "pos"), F.lit(-1)).alias("line"))


def href_src(docs: DataFrame) -> DataFrame:
    """Distinct src, then href values: (doc, kind, n, link), each link once at its first place."""
    tags = M.tokens(docs, positions=False).where("ttype in ('begin', 'single')").select("doc", "seq", M.attributes("tok").alias("a"))
    both = tags.select("doc", "seq", F.lit(0).alias("kind"), F.try_element_at("a", F.lit("src")).alias("link")).unionByName(tags.select("doc", "seq", F.lit(1).alias("kind"), F.try_element_at("a", F.lit("href")).alias("link")))
    firsts = both.where("link is not null").groupBy("doc", "link").agg(F.min(F.struct("kind", "seq")).alias("at"))
    return firsts.select("doc", "at.kind", F.row_number().over(Window.partitionBy("doc").orderBy("at")).alias("n"), "link")


def ids(docs: DataFrame) -> DataFrame:
    """(page_id, seq, id): id attributes, and names of anchors without one; an element counts once."""
    tags = M.tokens(docs, positions=False).where("ttype in ('begin', 'single')").select("doc", "seq", "tname", M.attributes("tok").alias("a"))
    found = F.coalesce(F.try_element_at("a", F.lit("id")), F.when(F.col("tname") == "a", F.try_element_at("a", F.lit("name"))))
    return tags.select(F.col("doc").alias("page_id"), "seq", found.alias("id")).where("id is not null")


def style_attr_urls(docs: DataFrame) -> DataFrame:
    """(doc, seq, url): the first url() of each inline style."""
    tags = M.tokens(docs, positions=False).where("ttype in ('begin', 'single')")
    url = F.regexp_extract(F.try_element_at(M.attributes("tok"), F.lit("style")), r"""(?i)url\(\s*["']?([^"')\s]+)""", 1)
    return tags.select("doc", "seq", url.alias("url")).where("url <> ''")


def media_paths(docs: DataFrame) -> DataFrame:
    """(doc, path): relative media that images, videos, audios and formulas point to."""
    tags = M.tokens(docs, positions=False).where("ttype in ('begin', 'single') and tname in ('img', 'image', 'video', 'audio', 'source', 'math', 'm:math')").select("doc", "tname", M.attributes("tok").alias("a"))
    own = lambda k: F.try_element_at("a", F.lit(k))
    path = F.coalesce(own("src"), own("xlink:href"), own("href"), F.when(F.col("tname").isin("math", "m:math"), own("altimg")))
    return tags.select("doc", path.alias("path")).where("path is not null and path not like '%:%'").distinct()


def stylesheet_links(docs: DataFrame) -> DataFrame:
    """(doc, seq, kind, href): stylesheet links, other links to .css files, and scripts with a source."""
    tags = M.tokens(docs, positions=False).where("ttype in ('begin', 'single') and tname in ('link', 'script')").select("doc", "seq", "tname", M.attributes("tok").alias("a"))
    own = lambda k: F.lower(F.coalesce(F.try_element_at("a", F.lit(k)), F.lit("")))
    href = F.coalesce(F.try_element_at("a", F.lit("href")), F.try_element_at("a", F.lit("src")))
    kind = F.when(F.col("tname") == "script", "script").when((own("rel") == "stylesheet") & own("type").isin("", "text/css"), "stylesheet").when(T.extension(T.link_path(href)) == "css", "css")
    return tags.select("doc", "seq", kind.alias("kind"), href.alias("href")).where("kind is not null and href is not null")


def html_metadata(docs: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """(doc, name, content): meta elements, names mapped to Dublin Core by a small table; others stay."""
    names = names or {"author": "dc:creator", "creator": "dc:creator", "description": "dc:description", "keywords": "dc:subject", "title": "dc:title", "language": "dc:language", "publisher": "dc:publisher", "date": "dc:date"}
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    tags = M.tokens(docs, positions=False).where("tname = 'meta' and ttype <> 'end'").select("doc", M.attributes("tok").alias("a"))
    name = F.lower(F.try_element_at("a", F.lit("name")))
    plain = F.regexp_replace(name, r"^dc(?:terms)?[.:]", "")
    return tags.where(name.isNotNull()).select("doc", F.coalesce(F.try_element_at(table, plain), name).alias("name"), F.try_element_at("a", F.lit("content")).alias("content"))


def resolve_entities(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts with the entities that the document type declares put in their places, and without the declarations."""
    found = F.regexp_extract_all(text_col, F.lit(r"""<!ENTITY\s+[\w.-]+\s+(?:"[^"]*"|'[^']*')\s*>"""), F.lit(0))
    rx = r"""<!ENTITY\s+([\w.-]+)\s+["'](.*?)["']\s*>"""
    bare = F.regexp_replace(text_col, r"""<!ENTITY\s+[\w.-]+\s+(?:"[^"]*"|'[^']*')\s*>""", "")
    out = F.aggregate(found, bare, lambda t, e: F.replace(t, F.concat(F.lit("&"), F.regexp_extract(e, rx, 1), F.lit(";")), F.regexp_extract(e, rx, 2)))
    return docs.select(id_col, out.alias(text_col))


def text_blocks(docs: DataFrame, els: DataFrame) -> DataFrame:
    """(doc, eid, text): each text goes to the innermost block-like element around it."""
    nearest = M.around(_text_tokens(docs).select("doc", "seq", "tok"), els.where(F.col("tname").isin(M.BLOCK)), {"eid": F.col("eid")}).where("eid is not null")
    return nearest.groupBy("doc", "eid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "tok"))), lambda x: x["tok"]), "").alias("text"))


def split_sections(docs: DataFrame, marker: str) -> DataFrame:
    """(doc, section, text): documents cut before each tag of a kind; the pieces put together are the document."""
    w = Window.partitionBy("doc").orderBy("seq")
    cut = M.tokens(docs, positions=False).withColumn("section", F.sum((F.col("tname") == marker).cast("long")).over(w))
    return cut.groupBy("doc", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "tok"))), lambda x: x["tok"]), "").alias("text"))


def report_filter(df: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(needle.lower())))


def classify_media(resources: DataFrame) -> DataFrame:
    """Media type and group by the path's extension, with a prefix fallback for the group."""
    kinds = {"htm": "application/xhtml+xml", "html": "application/xhtml+xml", "xhtml": "application/xhtml+xml", "css": "text/css", "js": "text/javascript", "svg": "image/svg+xml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "ttf": "font/ttf", "otf": "font/otf", "woff": "font/woff", "mp3": "audio/mpeg", "mp4": "video/mp4", "xml": "text/xml", "ncx": "application/x-dtbncx+xml", "opf": "application/oebps-package+xml"}
    table = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    return resources.withColumn("media_type", F.try_element_at(table, T.extension("path"))).withColumn("grp", media_group("media_type"))


def media_group(c: Column | str) -> Column:
    kind = F.lower(F.btrim(F.substring_index(T.col(c), ";", 1)))
    return F.when(kind == "application/xhtml+xml", "text").when(kind == "text/css", "style").when(F.startswith(kind, F.lit("image/")), "image").when(F.startswith(kind, F.lit("font/")), "font").when(F.startswith(kind, F.lit("audio/")), "audio").when(F.startswith(kind, F.lit("video/")), "video").otherwise("other")


def html_files_report(docs: DataFrame, els: DataFrame) -> DataFrame:
    """Per page: size, words, media and whether tags are balanced; and a row of totals."""
    found = F.filter(F.regexp_extract_all(M.blanked("html"), F.lit(M.TOKEN), F.lit(0)), lambda x: M.token_type(x) == "text")
    words = F.size(F.regexp_extract_all(F.array_join(found, " "), F.lit(WORD), F.lit(0)))
    own = docs.select("page_id", F.round(F.octet_length("html") / 1024, 2).alias("size_kb"), F.coalesce(words, F.lit(0)).cast("long").alias("words"))
    tags = {"images": "img", "video": "video", "audio": "audio", "stylesheets": "link"}
    counts = els.groupBy(F.col("doc").alias("page_id")).agg(*(F.count_if(F.col("tname") == t).alias(n) for n, t in tags.items()), F.bool_and("matched").cast("long").alias("well_formed"))
    rows = own.join(counts, "page_id", "left").fillna({**dict.fromkeys(tags, 0), "well_formed": 1})
    sums = [F.round(F.sum("size_kb"), 1).alias("size_kb"), *(F.sum(c).alias(c) for c in ("words", *tags, "well_formed"))]
    return rows.groupingSets([["page_id"], []], "page_id").agg(*sums, F.grouping("page_id").cast("int").alias("is_total"))


# Fixed value: attributes whose values are shown or spoken.
SPOKEN = ["alt", "title", "aria-label", "label"]


def font_usage(docs: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """Code points that visible texts, spoken attributes and generated content need, and three blanks; control characters don't count.

    Generated content is what strings in content declarations of style blocks, and of sheets (doc, css) if there are any, say.
    """
    texts = M.visible_text(docs).select(F.explode(F.array_distinct(F.split("text", ""))).alias("c"))
    tags = F.filter(F.regexp_extract_all(M.blanked("html"), F.lit(M.TOKEN), F.lit(0)), lambda x: M.token_type(x).isin("begin", "single"))
    said = docs.select(F.explode(tags).alias("tok")).withColumn("a", M.attributes("tok")).select(F.explode(F.array(*(F.try_element_at("a", F.lit(n)) for n in SPOKEN))).alias("text")).where("text is not null")
    points = texts.unionByName(said.select(F.explode(F.array_distinct(F.split("text", ""))).alias("c"))).where("c <> ''").select(F.ascii("c").cast("long").alias("codepoint"))
    rules = M.css_rules(docs).select("rule_no", "selector", F.col("doc").cast("string").alias("doc"), "body")
    if sheets is not None:
        rules = rules.unionByName(M.css_rules(sheets, "doc", "css", style_blocks=False).select("rule_no", "selector", F.col("doc").cast("string").alias("doc"), "body"))
    made = M.css_used_codepoints(M.css_declarations(rules)).select("codepoint")
    fixed = docs.sparkSession.createDataFrame([(32,), (160,), (12288,)], "codepoint long")
    return points.unionByName(made).where("codepoint >= 32 and codepoint not between 127 and 159").unionByName(fixed).distinct()


def class_set(rules: DataFrame) -> DataFrame:
    return rules.select(F.explode(F.regexp_extract_all("selector", F.lit(r"\.([-_\w]+)"), F.lit(1))).alias("class")).distinct()


def well_formed(els: DataFrame) -> DataFrame:
    """Per page with elements: unbalanced tags, required parts, and the token of the first error."""
    bad = F.when(~F.col("matched"), F.col("eid"))
    has = [F.bool_or(F.col("tname") == t) for t in ("html", "head", "body")]
    return els.groupBy("doc").agg(F.count(bad).alias("n_unmatched"), F.bool_and("matched").alias("balanced"), (has[0] & has[1] & has[2]).alias("has_parts"), F.min(bad).alias("first_error"))


def unclosed_issues(els: DataFrame) -> DataFrame:
    return els.where("not matched").select("doc", F.col("eid").alias("seq"), F.lit("error").alias("severity"), F.concat(F.lit("unclosed "), "tname").alias("message"))


def validate(els: DataFrame, staged: DataFrame) -> DataFrame:
    return els.join(staged, "doc", "left_semi").groupBy("doc").agg(F.bool_and("matched").alias("valid"))


def case_text_only(docs: DataFrame, fn) -> DataFrame:
    """A function on texts outside tags only."""
    found = F.regexp_extract_all("html", F.lit(M.TOKEN), F.lit(0))
    return docs.withColumn("html", F.array_join(F.transform(found, lambda x: F.when(M.token_type(x) == "text", fn(x)).otherwise(x)), ""))


def rename_class(docs: DataFrame, old: str, new: str) -> DataFrame:
    """Changed pages only, with the number of tags changed."""
    import re

    rx = rf"""^(<[^<>]*\bclass\s*=\s*["'](?:[^"']*\s)?){re.escape(old)}((?:\s[^"']*)?["'])"""
    found = F.regexp_extract_all("html", F.lit(M.TOKEN), F.lit(0))
    n = F.size(F.filter(found, lambda x: x.rlike(rx)))
    out = docs.withColumns({"n": n.cast("long"), "new": F.array_join(F.transform(found, lambda x: F.regexp_replace(x, rx, f"$1{new}$2")), "")})
    return out.where("n > 0").drop("html").withColumnRenamed("new", "html")


def extract_styles(rules: DataFrame) -> DataFrame:
    """Distinct bodies as classes numbered in order, and on how many pages each stands."""
    from quire.operators.words import places

    bodies = places(rules.groupBy("body").agg(F.countDistinct("doc").alias("n_pages")), [F.col("body")])
    return bodies.select("body", F.concat(F.lit("auto_"), F.col("place").cast("string")).alias("class"), "n_pages")
