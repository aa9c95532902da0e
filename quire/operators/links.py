"""Links between resources: reports, counts, repairs, and the use of classes and selectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import selectors
from quire.operators import tokens as M
from quire.plans.scratch import Scratch
from quire.plans.shares import dealt

#: Rows of one end in a block of ``path_end_match``: two blocks give the square of it.
BLOCK = 1024


def resources_of(pages: DataFrame) -> DataFrame:
    """Pages with the book (host) and path that their address names."""
    return pages.withColumns({"book": F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), "path": F.regexp_extract("url", "^[a-z]+://[^/?#]*/([^?#]*)", 1)})


def all_links(resources: DataFrame) -> DataFrame:
    """page_id, n, href, kind, book, path, target (path within the book; root-relative links from the book's root), fragment."""
    found = M.anchors(resources, "page_id", "html").withColumnRenamed("doc", "page_id")
    rows = found.join(resources.select("page_id", "book", "path"), "page_id")
    target = F.when(F.startswith("href", F.lit("/")), F.ltrim(T.link_path("href"), F.lit("/"))).otherwise(T.resolve("path", "href"))
    return rows.select("page_id", "n", "href", T.link_kind("href").alias("kind"), "book", "path", target.alias("target"), T.link_fragment("href").alias("fragment"))


def local_links(resources: DataFrame) -> DataFrame:
    return all_links(resources).where("kind = 'local'")


def _paths(resources: DataFrame) -> DataFrame:
    return resources.groupBy("book", F.col("path").alias("target")).agg(F.min("page_id").alias("target_id"))


def link_report(resources: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Every link and whether its target exists: yes, no, or n/a for external ones.

    ids (page_id, id): with them, a fragment must be an id of the target too.
    """
    rows = all_links(resources).join(_paths(resources), ["book", "target"], "left")
    there = F.col("target_id").isNotNull()
    if ids is not None:
        known = ids.select(F.col("page_id").alias("target_id"), F.col("id").alias("fragment")).distinct().withColumn("has_id", F.lit(True))
        rows = rows.join(known, ["target_id", "fragment"], "left")
        there = there & ((F.col("fragment") == "") | F.coalesce("has_id", F.lit(False)))
    return rows.select("page_id", "n", "href", "kind", "target", "fragment", "target_id", F.when(F.col("kind") == "external", "n/a").when(there, "yes").otherwise("no").alias("target_exists"))


def points_back(report: DataFrame) -> DataFrame:
    """The report with is_match: the target page has a link back to the source page."""
    back = report.where("target_id is not null").select(F.col("page_id").alias("target_id"), F.col("target_id").alias("page_id")).distinct().withColumn("is_match", F.lit(True))
    return report.join(back, ["page_id", "target_id"], "left").withColumn("is_match", F.coalesce("is_match", F.lit(False)))


def broken_links(resources: DataFrame) -> DataFrame:
    return all_links(resources).where("kind <> 'external'").join(_paths(resources), ["book", "target"], "left_anti")


def link_counts(resources: DataFrame) -> DataFrame:
    return local_links(resources).groupBy("book", "target").agg(F.count("*").alias("n_links"), F.countDistinct("page_id").alias("n_pages"))


def case_fix(links: DataFrame, resources: DataFrame) -> DataFrame:
    """Links whose path matches exactly one resource when case is ignored, with that path; exact ones need none."""
    by_case = resources.groupBy("book", F.lower("path").alias("low")).agg(F.count("*").alias("same"), F.min("path").alias("fixed")).where("same = 1")
    return links.withColumn("low", F.lower("target")).join(by_case, ["book", "low"]).where("fixed <> target")


def path_end_match(resources: DataFrame, tails: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Resources (path) whose path ends with a tail (tail), a row for each pair; file names are compared as a whole, and without case. columns: of these columns only.

    The pairs of a frequent end are as many as its resources times its tails, so none is joined as rows: rows of an end lie in blocks, pairs of blocks
    are dealt to tasks, and a task writes a pair's rows one by one.
    """
    parts = F.split(F.lower("path"), "/", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    kept = lambda df: [c for c in df.columns if columns is None or c in columns]
    a = _blocks(resources.select(*kept(resources), F.explode(ends).alias("_end")), kept(resources), "_a")
    b = _blocks(tails.select(*kept(tails), F.lower("tail").alias("_end")).where("_end is not null"), kept(tails), "_b")
    pairs = dealt(a.join(b, "_end"), "_end", "_a", "_b", like=resources).drop("_end", "_a", "_b")
    rows = _expanded(_expanded(pairs, "_a"), "_b")
    return rows.toDF(*kept(resources), *kept(tails))


def _blocks(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """(_end, name, name0, name1, ...): rows of each end in blocks of ``BLOCK``, an array for each of columns."""
    number = F.row_number().over(Window.partitionBy("_end").orderBy(*columns)) - 1
    held = rows.withColumn(name, F.floor(number / BLOCK)).groupBy("_end", name).agg(F.collect_list(F.struct(*columns)).alias("_rows"))
    return held.select("_end", name, *(F.col("_rows")[c].alias(f"{name}{k}") for k, c in enumerate(columns)))


def _expanded(pairs: DataFrame, name: str) -> DataFrame:
    """pairs with the arrays of ``_blocks`` as rows; numbers are read from their arrays without an object for each."""
    one = lambda c: F.get(c, F.col("_at")).alias(c) if c.startswith(name) else F.col(c)
    return pairs.withColumn("_at", F.explode(F.sequence(F.lit(0), F.size(f"{name}0") - 1))).select(*map(one, pairs.columns))


def class_usage(pages: DataFrame, rules: DataFrame | None = None, sheets: DataFrame | None = None) -> DataFrame:
    """doc, tname, class, the first selector for it in cascade order (null if none matches), and css, the path of its stylesheet (null for a style block).

    The order is data: a rule's rank is where it stands, first the page's own style blocks, then, with sheets (book, path, css) and pages that have a book and
    path, the stylesheets by link, each before what it imports, and in a sheet the rule and the place in its group. A selector without combinators and pseudo-classes stands
    for its first class, on any element or on the one that it names. Sheets that don't exist are left out.
    """
    toks = M.tokens(pages, positions=False).where("ttype in ('begin', 'single')")
    used = toks.select("doc", "tname", F.explode(F.split(F.try_element_at(M.attributes("tok"), F.lit("class")), " ")).alias("class")).distinct()
    no_place = F.array().cast("array<int>")
    own = _class_rules(M.css_rules(pages) if rules is None else rules)
    fits = (F.col("el") == "") | (F.col("el") == F.col("tname"))
    rank = F.struct(F.lit(-1).alias("link"), F.lit(0).alias("step"), no_place.alias("place"), "at")
    matched = used.join(own, ["doc", "class"]).where(fits).select("doc", "tname", "class", rank.alias("rank"), F.lit(None).cast("string").alias("css"), "selector")
    if sheets is not None:
        keyed = sheets.select(F.struct("book", "path").alias("sheet"), "book", "path", "css")
        imports = M.css_imports(keyed, "sheet", "css").withColumnRenamed("doc", "sheet").where(~T.is_external("url"))
        target = F.struct(F.col("sheet.book").alias("book"), T.resolve(F.col("sheet.path"), F.col("url")).alias("path"))
        reach = stylesheet_closure(keyed.select(F.col("sheet").alias("page"), "sheet"), imports.select("sheet", target.alias("target"), "n"))
        href = F.when(F.startswith("href", F.lit("/")), F.ltrim(T.link_path("href"), F.lit("/"))).otherwise(T.resolve("path", "href"))
        linked = pages_links(pages).join(pages.select(F.col("page_id").alias("doc"), "book", "path"), "doc").select("doc", F.col("seq").cast("int").alias("link"), F.struct("book", href.alias("path")).alias("page"))
        theirs = _class_rules(M.css_rules(keyed, "sheet", "css", style_blocks=False)).withColumnRenamed("doc", "sheet")
        found = used.join(linked, "doc").join(reach, "page").join(theirs, ["sheet", "class"]).where(fits)
        matched = matched.unionByName(found.select("doc", "tname", "class", F.struct("link", "step", "place", "at").alias("rank"), F.col("sheet.path").alias("css"), "selector"))
    first = matched.groupBy("doc", "tname", "class").agg(F.min_by(F.struct("selector", "css"), "rank").alias("x"))
    return used.join(first, ["doc", "tname", "class"], "left").select("doc", "tname", "class", "x.selector", "x.css")


def pages_links(pages: DataFrame) -> DataFrame:
    """(doc, seq, href) of links to stylesheets of the book, in order."""
    from quire.operators.pages import stylesheet_links

    return stylesheet_links(pages).where((F.col("kind") == "stylesheet") & ~T.is_external("href")).select("doc", "seq", "href")


def _class_rules(rules: DataFrame) -> DataFrame:
    """doc, class, el and the first selector for them, with its place (at) in the sheet."""
    simple = rules.where(~F.col("selector").rlike(r"[:\s>~+]")).withColumn("parts", F.split("selector", r"\."))
    named = simple.where((F.size("parts") > 1) & (F.col("parts")[1] != ""))
    return named.groupBy("doc", F.col("parts")[1].alias("class"), F.lower(F.col("parts")[0]).alias("el")).agg(F.min_by("selector", F.struct("rule_no", "selector_no")).alias("selector"), F.min(F.struct("rule_no", "selector_no")).alias("at"))


def selector_usage(pages: DataFrame, els: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Each selector with one page (the least) in which it matches; null if it is unused.

    Selectors of an element, a class, an id, or an element with one of these are data: one join finds them however many there are. Others
    are plans of their own, a hundred in a job.
    """
    rules = M.css_rules(pages) if rules is None else rules
    scratch = Scratch(pages.sparkSession, "selectors")
    every = scratch.table(rules.select("selector").distinct(), "selectors")
    rx = r"^(\*|[A-Za-z_][\w-]*)?([.#][\w-]+)?$"
    simple = every.where(F.col("selector").rlike(rx) & (F.col("selector") != "")).select("selector", F.lower(F.regexp_extract("selector", rx, 1)).alias("tag"), F.regexp_extract("selector", rx, 2).alias("mark"))
    attrs = M.attributes("tok")
    classes = F.filter(F.split(F.coalesce(F.try_element_at(attrs, F.lit("class")), F.lit("")), r"\s+"), lambda x: x != "")
    marks = F.concat(F.array(F.lit("")), F.transform(classes, lambda x: F.concat(F.lit("."), x)), F.array_compact(F.array(F.concat(F.lit("#"), F.try_element_at(attrs, F.lit("id"))))))
    places = els.select("doc", F.array("tname", F.lit("")).alias("tags"), F.array_distinct(marks).alias("marks"))
    places = places.select("doc", F.explode("tags").alias("tag"), "marks").select("doc", "tag", F.explode("marks").alias("mark")).groupBy("tag", "mark").agg(F.min("doc").alias("doc"))
    found = [simple.withColumn("tag", F.when(F.col("tag") == "*", "").otherwise(F.col("tag"))).join(places, ["tag", "mark"]).select("selector", "doc")]
    rest = [r.selector for r in every.where(~F.col("selector").rlike(rx)).orderBy("selector").toLocalIterator()]
    ready = selectors.prepared(els, write=True) if rest else None
    for k in range(0, len(rest), 100):
        hits = [selectors.selects_or_error(ready, x).agg(F.min("doc").alias("doc"), F.count("*").alias("k")).where("k > 0").select(F.lit(x).alias("selector"), "doc") for x in rest[k : k + 100]]
        found.append(scratch.table(reduce(DataFrame.unionByName, hits), f"part-{k}"))
    return every.join(reduce(DataFrame.unionByName, found), "selector", "left")


def unused_selectors(usage: DataFrame) -> DataFrame:
    return usage.where("doc is null").select("selector")


def without_selectors(rules: DataFrame, unused: DataFrame) -> DataFrame:
    """(doc, css): stylesheets without the unused selectors; a rule goes when its last selector does."""
    left = rules.join(unused, "selector", "left_anti").groupBy("doc", "rule_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("selector_no", "selector"))), lambda x: x["selector"]), ", ").alias("sel"), F.first("body").alias("body"))
    return left.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule_no", "sel", "body"))), lambda x: F.concat(x["sel"], F.lit(" {"), x["body"], F.lit("}"))), "\n").alias("css"))


def union_links(pages: DataFrame) -> DataFrame:
    """doc, link, n over href and src attributes."""
    toks = M.tokens(pages, positions=False).where("ttype in ('begin', 'single')").select("doc", M.attributes("tok").alias("a"))
    both = toks.select("doc", F.explode(F.filter(F.array(F.try_element_at("a", F.lit("href")), F.try_element_at("a", F.lit("src"))), lambda x: x.isNotNull())).alias("link"))
    return both.groupBy("doc", "link").agg(F.count("*").alias("n"))


def _lists(pages: DataFrame, name: str) -> DataFrame:
    tags = F.filter(F.regexp_extract_all("html", F.lit(M.TOKEN), F.lit(0)), lambda x: M.token_type(x).isin("begin", "single"))
    of = lambda x: F.concat_ws("|", *(F.coalesce(F.try_element_at(M.attributes(x), F.lit(k)), F.lit("")) for k in ("id", "name", "href", "src")))
    return pages.select(F.col("page_id").alias("doc"), F.array_sort(F.transform(tags, of)).alias(name))


def multiset_equal(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc, equal): the sorted lists of ids, names and links are the same before and after a rewrite."""
    return _lists(before, "a").join(_lists(after, "b"), "doc", "full").select("doc", F.col("a").eqNullSafe(F.col("b")).alias("equal"))


def common_prefix(resources: DataFrame) -> DataFrame:
    """(book, prefix): the longest folder that all paths of a book share, from its least and greatest path."""
    ends = resources.groupBy("book").agg(F.split(T.folder(F.min("path")), "/").alias("a"), F.split(T.folder(F.max("path")), "/").alias("b"))
    same = F.aggregate(
        F.zip_with("a", "b", lambda x, y: F.when(x == y, x)), F.struct(F.array().cast("array<string>").alias("out"), F.lit(True).alias("on")),
        lambda s, x: F.struct(F.when(s["on"] & x.isNotNull(), F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out"), (s["on"] & x.isNotNull()).alias("on")), lambda s: s["out"],
    )
    return ends.select("book", F.array_join(same, "/").alias("prefix"))


def stylesheet_closure(start: DataFrame, imports: DataFrame, merge: int = 16) -> DataFrame:
    """(page, sheet, step, place): sheets reachable from pages' links (page, sheet) through imports (sheet, target and, if their order counts, n); cycles end.

    step is the least number of imports to a sheet, place the numbers of the imports on the way, the least of those of that step. Each round joins only what the last one
    found and is written; there are as many rounds as imports are nested. After ``merge`` rounds their tables become one, so that plans stay small.
    """
    scratch = Scratch(start.sparkSession, "closure")
    n = F.col("n").cast("int") if "n" in imports.columns else F.lit(0)
    imports = imports.select("sheet", "target", n.alias("n"))
    last = start.select("page", "sheet").distinct().select("page", "sheet", F.lit(0).alias("step"), F.array().cast("array<int>").alias("place"))
    parts, step = [last], 0
    while True:
        step += 1
        seen = reduce(DataFrame.unionByName, parts)
        found = last.join(imports, "sheet").groupBy("page", F.col("target").alias("sheet")).agg(F.min(F.concat("place", F.array("n"))).alias("place"))
        new = found.join(seen, ["page", "sheet"], "left_anti").select("page", "sheet", F.lit(step).alias("step"), "place")
        last = scratch.table(new, f"step-{step}")
        if last.isEmpty():
            return seen
        parts.append(last)
        if len(parts) > merge:
            parts = [scratch.table(reduce(DataFrame.unionByName, parts), f"to-{step}")]


def media_usage(media: DataFrame, *uses: DataFrame) -> DataFrame:
    """(path, n): how often each media resource is used by link sets (path)."""
    every = uses[0].select("path")
    for x in uses[1:]:
        every = every.unionByName(x.select("path"))
    return media.select("path").join(every.groupBy("path").agg(F.count("*").alias("n")), "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"))


def repeated_ids(ids: DataFrame) -> DataFrame:
    """Ids present in several pages: (id, n_pages)."""
    return ids.groupBy("id").agg(F.countDistinct("page_id").alias("n_pages")).where("n_pages > 1")


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each group in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
