"""Styles moved and renamed across pages and stylesheets: inline styles become classes by what they say, classes change names everywhere at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import tokens as M
from quire.operators.direction import CSS_PIECES
from quire.operators.words import places
from quire.plans.scratch import Scratch

_DECLARATION = r"""(?s)(?:[^;"'()]|"[^"]*"|'[^']*'|\([^()]*\)|[()"'])+"""
_VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""


def declarations(style: Column | str) -> Column:
    """Array of (prop, value) of a style attribute: names in lower case, blanks squeezed, of repeated properties the last; sorted, unless one is a part of another (margin-left, margin).

    So styles that say the same have the same array, and where the order matters it stays.
    """
    parts = F.filter(F.regexp_extract_all(T.col(style), F.lit(_DECLARATION), F.lit(0)), lambda d: F.instr(d, ":") > 0)
    squeezed = lambda x: F.btrim(F.regexp_replace(x, r"\s+", " "))
    one = lambda d: F.struct(F.lower(squeezed(F.substring_index(d, ":", 1))).alias("prop"), squeezed(F.substring(d, F.instr(d, ":") + 1, F.length(d))).alias("value"))
    every = F.filter(F.transform(parts, one), lambda x: (x["prop"] != "") & (x["value"] != ""))
    last = F.filter(every, lambda x, i: ~F.exists(F.slice(every, i + 2, F.size(every)), lambda y: y["prop"] == x["prop"]))
    tied = F.exists(last, lambda x: F.exists(last, lambda y: F.startswith(y["prop"], F.concat(x["prop"], F.lit("-")))))
    return F.when(tied, last).otherwise(F.array_sort(last))


def body(found: Column | str) -> Column:
    return F.array_join(F.transform(T.col(found), lambda x: F.concat(x["prop"], F.lit(": "), x["value"])), "; ")


def _free_prefix(toks: DataFrame, prefix: str) -> str:
    """The prefix, made longer until no class begins with it."""
    used = toks.where(F.col("tok").rlike(r"(?i)\sclass\s*=")).select(F.explode(F.split(F.try_element_at(M.attributes("tok"), F.lit("class")), r"\s+")).alias("c"))
    while not used.where(F.startswith("c", F.lit(prefix))).isEmpty():
        prefix += "x_"
    return prefix


def extract_inline_styles(pages: DataFrame, href: str, prefix: str = "auto_") -> tuple[DataFrame, DataFrame]:
    """(pages, rules): pages (page_id, html, n) whose inline styles have become classes and that link ``href``, and the rules (class, body, n_elements) of that sheet.

    One class for each thing that styles say, numbered in order of their bodies; no class of the pages has such a name. Style attributes without a declaration go. Pages without a
    style attribute stay out, as do null ones. A rule of a sheet is weaker than a style attribute: where others are stronger, write the bodies with ``!important``.
    """
    toks = M.tokens(pages, positions=False, whole=True)
    styled = toks.where(F.col("ttype").isin("begin", "single")).withColumn("style", F.try_element_at(M.attributes("tok"), F.lit("style"))).where("style is not null")
    found = Scratch(pages.sparkSession, "styles").table(styled.select("doc", "seq", "tok", body(declarations("style")).alias("body")), "found")
    prefix = _free_prefix(toks, prefix)
    rules = places(found.where("body <> ''").groupBy("body").agg(F.count("*").alias("n_elements")), [F.col("body")]).select(F.concat(F.lit(prefix), F.col("place").cast("string")).alias("class"), "body", "n_elements")
    named = found.join(rules.select("body", "class"), "body", "left")
    bare = F.regexp_replace("tok", rf"(?i)\sstyle\s*=\s*{_VALUE}", "")
    value = F.regexp_extract(bare, rf"(?i)\sclass\s*=\s*{_VALUE}", 1)
    quote = F.when(F.startswith(value, F.lit("'")), "'").otherwise('"')
    classes = F.concat(quote, F.concat_ws(" ", F.nullif(F.regexp_replace(value, "^[\"']|[\"']$", ""), F.lit("")), "class"), quote)
    escaped = F.replace(F.replace(classes, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    with_class = F.when(value != "", F.regexp_replace(bare, rf"(?i)(\sclass\s*=\s*){_VALUE}", F.concat(F.lit("$1"), escaped))).otherwise(F.regexp_replace(bare, r"^(<[^\s/>]+)", F.concat(F.lit("$1 class="), escaped)))
    new = named.select("doc", "seq", F.when(F.col("class").isNull(), bare).otherwise(with_class).alias("new"))
    parts = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("new", "tok").alias("t"))))
    made = toks.join(new, ["doc", "seq"], "left").groupBy("doc").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("html"), F.count("new").alias("n")).where("n > 0")
    link = f'<link rel="stylesheet" type="text/css" href="{href}"/>'
    return made.select(F.col("doc").alias("page_id"), F.regexp_replace("html", "(?i)</head>", link.replace("$", r"\$") + "$0").alias("html"), "n"), rules


def sheet(rules: DataFrame) -> DataFrame:
    """(css): the rules as one sheet; there are as many as there are different styles."""
    return rules.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("body", "class"))), lambda x: F.concat(F.lit("."), x["class"], F.lit(" {"), x["body"], F.lit("}"))), "\n").alias("css"))


def _renamed_selector(selector: Column, names: Column) -> Column:
    pieces = F.regexp_extract_all(selector, F.lit(r"""(?s)\[[^\]]*\]|/\*.*?\*/|\.-?[_A-Za-z\x{80}-\x{10FFFF}][-\w\x{80}-\x{10FFFF}]*|[^.\[/]+|[.\[/]"""), F.lit(0))
    return F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(r"^\.."), F.concat(F.lit("."), F.coalesce(F.try_element_at(names, F.substring(x, F.lit(2), F.length(x))), F.substring(x, F.lit(2), F.length(x))))).otherwise(x)), "")


def css_renamed(css: Column | str, renames: dict[str, str]) -> Column:
    """A sheet with classes renamed in its selectors, all at once, so that names may be exchanged; bodies, comments and attribute tests stay."""
    names = F.create_map(*(F.lit(x) for kv in renames.items() for x in kv))
    rule = lambda x: F.concat(_renamed_selector(F.substring_index(x, "{", 1), names), F.substring(x, F.length(F.substring_index(x, "{", 1)) + 1, F.length(x)))
    return F.array_join(F.transform(F.regexp_extract_all(T.col(css), F.lit(CSS_PIECES), F.lit(0)), lambda x: F.when(x.rlike(r"(?s)^(?!/\*).*\{"), rule(x)).otherwise(x)), "")


def page_renamed(html: Column | str, renames: dict[str, str]) -> Column:
    """A page with classes renamed in class attributes and in style elements, all at once."""
    names = F.create_map(*(F.lit(x) for kv in renames.items() for x in kv))
    rx, style = rf"(?is)^(<[^<>]*?\sclass\s*=\s*){_VALUE}(.*)$", r"(?is)^(<style\b[^>]*>)(.*)(</style>)$"

    def tag(x: Column) -> Column:
        value = F.regexp_extract(x, rx, 2)
        pieces = F.regexp_extract_all(value, F.lit(r"""[^\s"']+|[\s"']+"""), F.lit(0))
        return F.concat(F.regexp_extract(x, rx, 1), F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(names, p), p)), ""), F.regexp_extract(x, rx, 3))

    toks = F.regexp_extract_all(T.col(html), F.lit(f"{M.SILENT}|{M.TOKEN}"), F.lit(0))
    sheet_of = lambda x: F.concat(F.regexp_extract(x, style, 1), css_renamed(F.regexp_extract(x, style, 2), renames), F.regexp_extract(x, style, 3))
    return F.array_join(F.transform(toks, lambda x: F.when(x.rlike(style), sheet_of(x)).when(x.rlike(r"^<[A-Za-z]") & x.rlike(rx), tag(x)).otherwise(x)), "")


def rename_classes(pages: DataFrame, sheets: DataFrame, renames: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(pages, sheets) that changed: pages (page_id, html) and sheets (path, css) with classes renamed together. Null texts don't change; no renames change nothing."""
    if not renames:
        return pages.select("page_id", "html").limit(0), sheets.limit(0)
    made = pages.select("page_id", page_renamed("html", renames).alias("html"), F.col("html").alias("_old")).where("html <> _old").drop("_old")
    return made, sheets.withColumns({"_old": F.col("css"), "css": css_renamed("css", renames)}).where("css <> _old").drop("_old")
