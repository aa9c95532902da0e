"""Rewrites of marked-up resources: renamed files, ids and styles, anchors after splits, script conversion, ids and formatting.

Links are rewritten tag by tag: the tags that change are found by joins of the token table, and documents without such a tag are not
touched. Resources are rows (book, path, html) with a page_id.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import tokens as M
from quire.operators.pages import ids as pages_ids
from quire.operators.words import numbered
from quire.plans.scratch import Scratch

LINKS = ("href", "src", "xlink:href", "altimg", "poster")


def _put_together(toks: DataFrame) -> DataFrame:
    """(doc, html) of documents in which a token has a new text (column new)."""
    parts = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("new", "tok").alias("t"))))
    whole = toks.groupBy("doc").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("html"), F.count("new").alias("n"))
    return whole.where("n > 0")


def _set(tok: Column, name: Column, value: Column) -> Column:
    """A tag with the value of one attribute replaced."""
    rx = F.concat(F.lit(r"(?i)(\s"), name, F.lit(r"""\s*=\s*)("[^"]*"|'[^']*'|[^\s"'>]+)"""))
    return F.regexp_replace(tok, rx, F.concat(F.lit("$1\""), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")), F.lit('"')))


# Elements and attributes that hold links in package, navigation, synchronisation and page-map files.
XML_LINKS = {
    "opf": {"link": ["href"], "item": ["href"], "reference": ["href"], "site": ["href"]}, "ncx": {"content": ["src"]}, "pagemap": {"page": ["href"]},
    "smil": {"text": ["src"], "audio": ["src"], "body": ["epub:textref"], "seq": ["epub:textref"], "par": ["epub:textref"]},
}
#: Where a file of a book goes, by its extension.
FOLDERS = {"Images": "bmp gif jpeg jpg png svg webp".split(), "Styles": ["css"], "Fonts": "otf ttf woff woff2".split(), "Audio": "m4a mp3 ogg wav".split(), "Video": "m4v mp4 webm".split()}


def rewrite_links(resources: DataFrame, targets: DataFrame, places: Column | None = None, to_path: str = "path", follow: bool = False) -> DataFrame:
    """(page_id, html, n) of changed pages. targets (book, target, fragment or null, new_path, new_fragment or null): where links go now.

    A row with a null fragment holds for every fragment of its target, which stays; one with a fragment only for that one.
    places: which of (tname, attr) hold links, if not the usual attributes; to_path: column with the page's own new path; follow: in pages that move, all links still lead where they did.
    """
    keyed = resources.select(F.col("page_id").alias("doc"), "book", "path", F.col(to_path).alias("own_path"))
    toks = M.tokens(resources, positions=False)
    found = toks.where("ttype in ('begin', 'single')").select("doc", "seq", "tok", "tname", F.explode(M.attributes("tok")).alias("attr", "value")).where((F.col("attr").isin(*LINKS) if places is None else places) & ~T.is_external("value"))
    path = F.when(F.startswith("value", F.lit("/")), T.normal_path(T.link_path("value"))).otherwise(T.resolve("path", "value"))
    aimed = found.join(keyed, "doc").withColumns({"target": path, "fragment": T.link_fragment("value")})
    general = targets.where("fragment is null").select("book", "target", F.col("new_path").alias("g_path"))
    exact = targets.where("fragment is not null").select("book", "target", "fragment", F.col("new_path").alias("e_path"), F.col("new_fragment").alias("e_fragment"))
    aimed = aimed.withColumn("o_path", F.when(F.lit(follow) & (F.col("own_path") != F.col("path")), F.col("target")))
    moved = aimed.join(general, ["book", "target"], "left").join(exact, ["book", "target", "fragment"], "left").where("g_path is not null or e_path is not null or o_path is not null")
    new_path, fragment = F.coalesce("e_path", "g_path", "o_path"), F.coalesce(F.when(F.col("e_path").isNotNull(), F.col("e_fragment")), "fragment")
    same_file = new_path == F.col("own_path")
    href = F.concat(F.when(same_file & (fragment != ""), F.lit("")).otherwise(T.url_encode(T.relative("own_path", new_path))), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))
    changes = moved.withColumn("new_value", href).where("new_value <> value").withColumn("new", _set(F.col("tok"), F.col("attr"), F.col("new_value")))
    one = changes.groupBy("doc", "seq").agg(F.first("new").alias("new"))
    whole = _put_together(toks.join(one, ["doc", "seq"], "left"))
    return whole.withColumnRenamed("doc", "page_id")


def apply_renames(resources: DataFrame, updates: DataFrame) -> DataFrame:
    """Rewrites links for renamed files: updates (book, old_path, new_path)."""
    null = F.lit(None).cast("string")
    return rewrite_links(resources, updates.select("book", F.col("old_path").alias("target"), null.alias("fragment"), "new_path", null.alias("new_fragment")))


def move_files(resources: DataFrame, moves: DataFrame) -> DataFrame:
    """resources (page_id, book, path, html, ...) with new paths, and all links of the books' pages that follow: moves (book, old_path, new_path). Several files may go to one path."""
    null = F.lit(None).cast("string")
    own = moves.select("book", F.col("old_path").alias("path"), F.col("new_path").alias("_path"))
    placed = resources.join(own, ["book", "path"], "left").withColumn("_path", F.coalesce("_path", "path"))
    targets = moves.select("book", F.col("old_path").alias("target"), null.alias("fragment"), "new_path", null.alias("new_fragment"))
    made = rewrite_links(placed, targets, to_path="_path", follow=True).select("page_id", F.col("html").alias("_html"))
    return placed.join(made, "page_id", "left").withColumns({"html": F.coalesce("_html", "html"), "path": F.col("_path")}).drop("_html", "_path").select(*resources.columns)


def rename_plan(files: DataFrame, template: str, order: list[str], start: int = 1, others: DataFrame | None = None) -> DataFrame:
    """book, old_path, new_path, problem for files (book, path, and what orders them): names numbered in each book by a template.

    The last run of # in the template is the number, with zeros to its width; longer numbers stay whole. {name} is the old name without its ending, {ext} the ending with its dot. Files stay in their
    folders. problem, null if there is none: the new path, case aside, is that of another file of the plan, or of one of ``others`` (book, path; all files of the books) that keeps its path.
    """
    if "#" not in template and "{name}" not in template:
        raise ValueError("the template needs # or {name}")
    head, width, tail = re.fullmatch(r"(.*?)(#*)([^#]*)", template, re.S).groups()
    rows = numbered(files.select("book", "path", *[c for c in order if c not in ("book", "path")]), "book", order, "_n")
    n = (F.col("_n") + (start - 1)).cast("string")
    number = F.lpad(n, F.greatest(F.lit(len(width)), F.length(n)), "0") if width else F.lit("")
    name, ext = T.file_name("path"), F.regexp_extract(T.file_name("path"), r"(\.[^.]*)$", 1)
    filled = lambda x: F.replace(F.replace(F.lit(x), F.lit("{ext}"), ext), F.lit("{name}"), F.regexp_replace(name, r"\.[^.]*$", ""))
    folder = F.regexp_extract("path", r"^(.*/)[^/]*$", 1)
    plan = rows.select("book", F.col("path").alias("old_path"), F.concat(folder, filled(head), number, filled(tail)).alias("new_path"), F.lower(F.concat(folder, filled(head), number, filled(tail))).alias("low"))
    same = plan.groupBy("book", "low").agg(F.count("*").alias("same"))
    kept = plan.select("book", F.lit(None).cast("string").alias("low")).limit(0).withColumn("taken", F.lit(True)) if others is None else others.select("book", F.col("path").alias("old_path")).join(plan.select("book", "old_path"), ["book", "old_path"], "left_anti").select("book", F.lower("old_path").alias("low"), F.lit(True).alias("taken")).distinct()
    found = plan.join(same, ["book", "low"], "left").join(kept, ["book", "low"], "left")
    problem = F.when(F.col("same") > 1, "several files get this path").when(F.col("taken"), "the path is taken")
    return found.select("book", "old_path", "new_path", problem.alias("problem"))


def rename_files(resources: DataFrame, template: str, order: list[str] | None = None, start: int = 1, others: DataFrame | None = None) -> DataFrame:
    """resources with numbered paths and links that follow; a book with a problem in its ``rename_plan`` stays as it is."""
    plan = rename_plan(resources, template, order or ["path"], start, others)
    bad = plan.where("problem is not null").select("book").distinct()
    return move_files(resources, plan.join(bad, "book", "left_anti").select("book", "old_path", "new_path"))


def merge_documents(resources: DataFrame, plan: DataFrame) -> DataFrame:
    """resources (page_id, book, path, html) in which files have become one: plan (book, path, target, n) says which, into what path, and in what order.

    The first gives the head and what stands around, its body then holds the bodies of all. Ids that an earlier member has get a new name in the later one, which no id of the
    target has; then all links of the book follow: to renamed ids, to members, and, from members that leave their folder, to everything else. The merged file has the first member's page_id.
    A member without a body counts whole. Other files stay, with their links changed; a member that doesn't exist is left out.
    """
    members = resources.join(plan.select("book", "path", "target", "n"), ["book", "path"])
    own = pages_ids(members).join(members.select("page_id", "book", "path", "target", "n"), "page_id").select("book", "path", "target", "n", "id").distinct()
    runs = F.transform(F.regexp_extract_all("id", F.lit("_+"), F.lit(0)), F.length)
    deep = own.groupBy("book", "target").agg(F.max(F.coalesce(F.array_max(runs), F.lit(0))).alias("deep"))
    again = own.withColumn("k", F.row_number().over(Window.partitionBy("book", "target", "id").orderBy("n", "path"))).where("k > 1").join(deep, ["book", "target"])
    new_id = F.concat("id", F.repeat(F.lit("_"), (F.col("deep") + 1).cast("int")), F.col("n").cast("string"))
    renamed = rename_fragments(resources, again.select("book", "path", F.col("id").alias("old_id"), new_id.alias("new_id"))).select("page_id", F.col("html").alias("_html"))
    step = resources.join(renamed, "page_id", "left").withColumn("html", F.coalesce("_html", "html")).drop("_html")
    step = Scratch(resources.sparkSession, "merge").table(step, "renamed")
    moved = move_files(step, plan.select("book", F.col("path").alias("old_path"), F.col("target").alias("new_path")))
    keyed = moved.join(members.select("page_id", "n", "target"), "page_id", "left")
    body = r"(?is)^(.*?<body\b[^<>]*>)(.*)(</body\s*>.*)$"
    whole = F.col("html").rlike(body)
    part = F.struct("n", "page_id", F.when(whole, F.regexp_extract("html", body, 2)).otherwise(F.col("html")).alias("body"), F.when(whole, F.regexp_extract("html", body, 1)).otherwise("").alias("before"), F.when(whole, F.regexp_extract("html", body, 3)).otherwise("").alias("after"))
    merged = keyed.where("target is not null").groupBy("book", "path").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    text = F.concat(F.col("parts")[0]["before"], F.array_join(F.transform("parts", lambda x: x["body"]), "\n"), F.col("parts")[0]["after"])
    done = merged.select(F.col("parts")[0]["page_id"].alias("page_id"), "book", "path", text.alias("html"))
    return keyed.where("target is null").select("page_id", "book", "path", "html").unionByName(done)


def xml_renames(resources: DataFrame, updates: DataFrame, kind: str) -> DataFrame:
    """Rewrites links of package, ncx, smil or pagemap files (page_id, book, path, html) for renamed files: (page_id, html, n) of changed ones."""
    null = F.lit(None).cast("string")
    places = reduce(lambda a, b: a | b, ((F.col("tname") == tag) & F.col("attr").isin(*names) for tag, names in XML_LINKS[kind].items()))
    return rewrite_links(resources, updates.select("book", F.col("old_path").alias("target"), null.alias("fragment"), "new_path", null.alias("new_fragment")), places)


def import_html(resources: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, media): pages (page_id, book, path, html) brought into the layout of a book, and the files (book, path) that they use.

    Images, sound, video and stylesheets that a page points to and that exist go to the folder of their kind, media with path and new_path; the page goes
    to Text and its links to them follow. Links to files that don't exist, to scripts and to other pages stay as they are.
    """
    toks = M.tokens(resources, positions=False).where("ttype in ('begin', 'single')").select("doc", "tname", F.explode(M.attributes("tok")).alias("attr", "value"))
    sheet = (F.col("tname") == "link") & (F.col("attr") == "href")
    media = F.col("tname").isin("img", "image", "source", "audio", "video", "embed", "object") & F.col("attr").isin("src", "xlink:href", "href", "poster", "data")
    kinds = F.create_map(*(F.lit(x) for folder, exts in FOLDERS.items() for ext in exts for x in (ext, folder)))
    keyed = resources.select(F.col("page_id").alias("doc"), "book", F.col("path").alias("page_path"))
    wanted = toks.where((sheet | media) & ~T.is_external("value")).join(keyed, "doc").select("book", T.resolve("page_path", "value").alias("path")).distinct()
    folder = F.try_element_at(kinds, T.extension("path"))
    found = files.select("book", "path").distinct().join(wanted, ["book", "path"], "left_semi").where(folder.isNotNull()).withColumn("new_path", F.concat_ws("/", folder, T.file_name("path")))
    null = F.lit(None).cast("string")
    moved = resources.withColumn("new_path", F.concat(F.lit("Text/"), T.file_name("path")))
    changed = rewrite_links(moved, found.select("book", F.col("path").alias("target"), null.alias("fragment"), "new_path", null.alias("new_fragment")), to_path="new_path")
    out = moved.join(changed.select("page_id", F.col("html").alias("_html")), "page_id", "left").withColumns({"path": F.col("new_path"), "html": F.coalesce("_html", "html")}).drop("_html", "new_path")
    return out, found


def relink_anchors(resources: DataFrame, old_paths: DataFrame, places: DataFrame) -> DataFrame:
    """After a split or merge: links to an id of an old path (book, old_path) point at the file that now holds it.

    places: (book, id, path); of files with the same id the last by path counts.
    """
    last = places.groupBy("book", "id").agg(F.max("path").alias("new_path"))
    return rewrite_links(resources, old_paths.select("book", F.col("old_path").alias("target")).join(last, "book").select("book", "target", F.col("id").alias("fragment"), "new_path", F.col("id").alias("new_fragment")))


def rename_fragments(resources: DataFrame, updates: DataFrame) -> DataFrame:
    """Ids and all links to them: updates (book, path, old_id, new_id). Returns changed pages (page_id, html)."""
    keyed = resources.select(F.col("page_id").alias("doc"), "book", "path")
    toks = M.tokens(resources, positions=False).join(keyed, "doc")
    own = toks.withColumn("old_id", F.when(F.col("ttype").isin("begin", "single"), F.try_element_at(M.attributes("tok"), F.lit("id"))))
    renamed = own.join(updates, ["book", "path", "old_id"], "left").withColumn("new", F.when(F.col("new_id").isNotNull(), _set(F.col("tok"), F.lit("id"), F.col("new_id"))))
    ids_done = _put_together(renamed).select(F.col("doc").alias("page_id"), F.col("html").alias("_html"))
    step = resources.join(ids_done, "page_id", "left").withColumn("html", F.coalesce("_html", "html")).drop("_html")
    links = updates.select("book", F.col("path").alias("target"), F.col("old_id").alias("fragment"), F.col("path").alias("new_path"), F.col("new_id").alias("new_fragment"))
    linked = rewrite_links(step, links).select("page_id", F.col("html").alias("_html"))
    both = step.join(linked, "page_id", "left").select("page_id", F.coalesce("_html", "html").alias("html"))
    return both.join(resources.select("page_id", F.col("html").alias("_old")), "page_id").where("html <> _old").drop("_old")


def css_renames(sheets: DataFrame, updates: DataFrame) -> DataFrame:
    """Stylesheets (doc, path, css) with url() and @import targets rewritten: updates (old_path, new_path). Changed ones only."""
    found = M.css_urls(sheets, "doc", "css", "path").join(updates, F.col("path") == F.col("old_path")).select("doc", "url", "new_path").distinct()
    lists = found.groupBy("doc").agg(F.collect_list(F.struct("url", "new_path")).alias("x"))
    out = F.aggregate("x", F.col("css"), lambda c, u: F.replace(c, u["url"], T.url_encode(T.relative("path", u["new_path"]))))
    return sheets.join(lists, "doc").withColumn("css", out).drop("x")


def relink_styles(pages: DataFrame, hrefs: list[str], scripts: list[str] | None = None) -> DataFrame:
    """Pages with their stylesheet links replaced by links to ``hrefs`` before the end of the head; with scripts, also the scripts of the head that have a source.

    Scripts in the page's text, and those in the body, stay.
    """
    bare = F.regexp_replace("html", r"""(?i)<link\b[^<>]*\brel\s*=\s*["']?stylesheet["']?[^<>]*>\s*""", "")
    links = "".join(f'<link rel="stylesheet" type="text/css" href="{x}"/>' for x in hrefs)
    if scripts is not None:
        head = F.regexp_extract(bare, r"(?is)^(.*?)</head>", 1)
        cleared = F.regexp_replace(head, r"""(?is)<script\b[^<>]*\ssrc\s*=[^<>]*>\s*</script>\s*|<script\b[^<>]*\ssrc\s*=[^<>]*/>\s*""", "")
        bare = F.concat(cleared, F.substring(bare, F.length(head) + 1, F.length(bare)))
        links += "".join(f'<script type="text/javascript" src="{x}"></script>' for x in scripts)
    return pages.withColumn("html", F.regexp_replace(bare, "(?i)(</head>)", links.replace("$", r"\$") + "$1"))


def convert_script(pages: DataFrame, phrases: list[tuple[str, str]], characters: dict[str, str], **options) -> DataFrame:
    """Script conversion of pages by phrases and characters, leftmost and longest: page_id, html, skipped (texts that stay). Options as in ``chinese.convert``."""
    from quire.operators import chinese

    found = chinese.convert(pages, [list((characters | dict(phrases)).items())], **options)
    return found.select("page_id", "html", (F.col("skipped_japanese") + F.col("skipped_protected")).alias("skipped"))


def rebase_ids(manifest: DataFrame, spine: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest ids from file names, made unique in their book by a number, and the spine's references to them."""
    base = T.valid_id(T.file_name("bookpath"))
    n = F.row_number().over(Window.partitionBy("book_id", "base").orderBy("pos"))
    named = manifest.withColumn("base", base).withColumn("n", n).withColumn("new_id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("n").cast("string"))))
    refs = spine.join(named.select("book_id", F.col("id").alias("idref"), "new_id"), ["book_id", "idref"], "left")
    return named.withColumn("id", F.col("new_id")).drop("base", "n", "new_id"), refs.withColumn("idref", F.coalesce("new_id", "idref")).drop("new_id")


def ensure_uuid(metadata: DataFrame) -> DataFrame:
    """(book_id, uuid): a book's own UUID identifier, or one made from a hash of its id."""
    rx = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    own = metadata.groupBy("book_id").agg(F.min(F.when((F.col("name") == "dc:identifier") & F.col("content").rlike(rx), F.lower(F.regexp_extract("content", f"({rx})", 1)))).alias("own"))
    h = F.sha2("book_id", 256)
    made = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return own.select("book_id", F.coalesce("own", made).alias("uuid"))


def format_status(els: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, status): skipped (unbalanced tags), unchanged, or formatted, by what ``format_markup`` would do."""
    bad = els.where("not matched").select("doc").distinct().withColumn("bad", F.lit(1))
    rows = docs.select(F.col("page_id").alias("doc"), "html").join(bad, "doc", "left")
    trimmed = F.regexp_replace("html", r"[ \t]+(\r?\n)", "$1")
    return rows.select("doc", F.when(F.col("bad").isNotNull(), "skipped").when(trimmed == F.col("html"), "unchanged").otherwise("formatted").alias("status"))


def format_markup(docs: DataFrame, els: DataFrame) -> DataFrame:
    """(page_id, html) of well-formed pages, blanks at line ends removed."""
    good = format_status(els, docs).where("status = 'formatted'").select(F.col("doc").alias("page_id"))
    return docs.join(good, "page_id", "left_semi").select("page_id", F.regexp_replace("html", r"[ \t]+(\r?\n)", "$1").alias("html"))


def format_css(rules: DataFrame) -> DataFrame:
    """(doc, css): one declaration on a line, rules in order."""
    groups = rules.groupBy("doc", "rule_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("selector_no", "selector"))), lambda x: x["selector"]), ", ").alias("sel"), F.first("body").alias("body"))
    decls = F.transform(F.filter(F.split("body", ";"), lambda d: d.rlike(r"\S")), lambda d: F.concat(F.lit("  "), F.regexp_replace(F.btrim(d, F.lit(" \t\r\n\f")), r"^([^:]*?)\s*:\s*", "$1: "), F.lit(";\n")))
    text = F.concat("sel", F.lit(" {\n"), F.array_join(decls, ""), F.lit("}\n"))
    return groups.select("doc", "rule_no", text.alias("t")).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule_no", "t"))), lambda x: x["t"]), "\n").alias("css"))
