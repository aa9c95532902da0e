"""Checks of markup as one table of issues, with lines and columns, and the validation of staged files.

Brackets are matched twice, by the level of their own name and by the common depth of all; where the two disagree tags cross. Every check adds rows to the
same table, so that reports, first errors and verdicts are aggregates of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import tokens as M

# Fixed value: media types of files that must be well-formed XML, besides all that end in +xml.
XML_TYPES = ["application/xhtml+xml", "image/svg+xml", "application/oebps-package+xml", "application/x-dtbncx+xml", "application/xml", "text/xml"]
#: A test of a token, its code and its message.
Check = tuple[Column, Column | str, Column | str]
_ATTRIBUTE = r"""\s+[^\s=<>"'/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'))?"""


def placed(toks: DataFrame) -> DataFrame:
    """Tokens (doc, seq, pos, tok, ...) with line and col of their first character, both from 1."""
    before = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.length("tok") - F.length(F.replace("tok", F.lit("\n"), F.lit("")))
    after = F.when(ends > 0, F.col("pos") + F.length("tok") - F.length(F.substring_index("tok", "\n", -1)))
    return toks.withColumns({"line": F.coalesce(F.sum(ends).over(before), F.lit(0)) + 1, "col": F.col("pos") - F.coalesce(F.max(after).over(before), F.lit(0)) + 1})


# All checks take tokens with their places and tell of them with what they find, so that no issue is joined with its token again.


def tag_issues(toks: DataFrame, xml: bool = False) -> DataFrame:
    """doc, code, message, and seq, line and col as far as the tokens have them: unclosed and crossing begin tags, stray and crossing end tags; of tokens with last also a p in another p.

    xml: no element is void by its name.
    """
    tags = M.paired(toks, void=[] if xml else M.VOID)
    begin = F.col("ttype") == "begin"
    code = F.when(F.col("crossing"), "crossing").when(begin & ~F.col("alone") & F.col("partner").isNull(), "unclosed").when((F.col("ttype") == "end") & F.col("partner").isNull(), "stray")
    told = F.concat(code, F.lit(" "), F.when(begin, "begin").otherwise("end"), F.lit(" tag: "), F.col("tname"))
    checks = [(code.isNotNull(), code, told)]
    if "last" in toks.columns:
        p = begin & (F.col("tname") == "p")
        before = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        tags = M.with_ends(tags).withColumn("nested", p & (F.max(F.when(p, F.col("end_seq"))).over(before) >= F.col("seq")))
        checks.append((F.col("nested"), "nested-p", "a p in another p"))
    return _found(tags, checks)


def syntax_checks(xml: bool = False) -> list[Check]:
    """Tags whose attributes aren't quoted or parted, lone signs, attributes that occur twice, end tags of void elements, and in XML also entities."""
    tag = F.col("ttype").isin("begin", "single")
    names = F.transform(F.regexp_extract_all("tok", F.lit(M.ATTR), F.lit(1)), F.lower)
    checks = [
        (tag & ~F.col("tok").rlike(rf"^<[^\s/>]+(?:{_ATTRIBUTE})*\s*/?>$"), "attributes", "attributes are not quoted or not parted by blanks"),
        (F.col("tok") == "<", "sign", "a lone < in text"),
        (tag & (F.size(names) != F.size(F.array_distinct(names))), "twice", "an attribute occurs twice"),
    ]
    if xml:
        return [*checks, (F.col("ttype").isin("text", "begin", "single") & F.col("tok").rlike(r"&(?!#?\w+;)"), "entity", "an & that begins no entity")]
    return [*checks, ((F.col("ttype") == "end") & F.col("tname").isin(M.VOID), "void-end", F.concat(F.lit("end tag of the void element: "), "tname"))]


def page_checks(toks: DataFrame) -> tuple[DataFrame, list[Check]]:
    """Tokens with what these ask for: parts of a page that are out of order, links to stylesheets without their type, and repeated ids."""
    doc = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("ttype").isin("begin", "single")
    seen = {n: F.coalesce(F.max((F.col("tname").eqNullSafe(n) & begin).cast("int")).over(doc), F.lit(0)) == 1 for n in ("html", "body")}
    rows = toks.withColumns({f"_{n}": c for n, c in seen.items()}).withColumn("_a", F.when(begin, M.attributes("tok")))
    rows = rows.withColumn("_id", F.try_element_at("_a", F.lit("id")))
    rows = rows.withColumn("_same", F.when(F.col("_id").isNotNull(), F.row_number().over(Window.partitionBy("doc", "_id").orderBy("seq"))))
    rel, kind = (F.lower(F.coalesce(F.try_element_at("_a", F.lit(n)), F.lit(""))) for n in ("rel", "type"))
    checks = [
        (begin & F.col("tname").isin("html", "head") & F.col("_body"), "order", "the html or head tag stands after the body"), (begin & (F.col("tname") == "body") & ~F.col("_html"), "order", "the body stands before the html tag"),
        (F.col("ttype").isin("xmlheader", "doctype") & F.col("_html"), "order", "a declaration stands after the html tag"), (begin & (F.col("tname") == "link") & (rel == "stylesheet") & (kind != "text/css"), "link-type", "a stylesheet link without its type"),
        (F.col("_same") > 1, "id-twice", "an id occurs twice"),
    ]
    return rows, checks


def _found(rows: DataFrame, checks: list[Check]) -> DataFrame:
    """A row for each check that holds, in one pass."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    told = F.array_compact(F.array(*(F.when(test, F.struct(text(code).alias("code"), text(message).alias("message"))) for test, code, message in checks)))
    return rows.select(*(c for c in ("doc", "seq", "line", "col") if c in rows.columns), F.inline(told))


def part_issues(toks: DataFrame, docs: DataFrame, id_col: str = "page_id") -> DataFrame:
    """doc, seq, line, col, code, message: pages with no or several html, head or body elements; at the second one, else at the first token."""
    names = ("html", "head", "body")
    tags = toks.where(F.col("ttype").isin("begin", "single") & F.col("tname").isin(*names))
    numbered = tags.withColumn("n", F.row_number().over(Window.partitionBy("doc", "tname").orderBy("seq")))
    found = numbered.groupBy("doc").agg(*(F.count_if(F.col("tname") == n).alias(n) for n in names), *(F.min(F.when((F.col("tname") == n) & (F.col("n") == 2), F.struct("seq", "line", "col"))).alias(f"_{n}") for n in names))
    rows = docs.select(F.col(id_col).alias("doc")).join(found, "doc", "left")
    at = lambda n: [F.coalesce(f"_{n}.{c}", F.lit(first)).cast("long").alias(c) for c, first in (("seq", 0), ("line", 1), ("col", 1))]
    told = [F.when(F.coalesce(n, F.lit(0)) != 1, F.struct(*at(n), F.lit(f"missing or multiple {n} tags").alias("message"))) for n in names]
    return rows.select("doc", F.inline(F.array_compact(F.array(*told)))).select("doc", "seq", "line", "col", F.lit("parts").alias("code"), "message")


def issues(docs: DataFrame, id_col: str = "page_id", text_col: str = "html", xml: bool = False) -> DataFrame:
    """doc, line, col, severity, code, message: all checks of pages, or with xml those of any XML file. A null or empty text has no tokens, and of pages lacks all parts."""
    toks = placed(M.tokens(docs, id_col, text_col, whole=not xml, last=not xml))
    rows, checks = (toks, []) if xml else page_checks(toks)
    found = [tag_issues(toks, xml), _found(rows, [*syntax_checks(xml), *checks])]
    if not xml:
        found.append(part_issues(toks, docs, id_col))
    rows = reduce(DataFrame.unionByName, found)
    severity = F.when(F.col("code").isin("link-type", "twice", "id-twice"), "warning").otherwise("error")
    return rows.select("doc", "line", "col", severity.alias("severity"), "code", "message")


def well_formed(docs: DataFrame, found: DataFrame, id_col: str = "page_id") -> DataFrame:
    """doc, n_unclosed, n_stray, n_crossing, n_errors, balanced, has_parts, and line, col, message of the first error, for each document and its ``issues``."""
    n = lambda *codes: F.count_if(F.col("code").isin(*codes))
    error = F.col("severity") == "error"
    first = F.min(F.when(error, F.struct("line", "col", "message")))
    sums = found.groupBy("doc").agg(n("unclosed").alias("n_unclosed"), n("stray").alias("n_stray"), n("crossing").alias("n_crossing"), F.count_if(error).alias("n_errors"), n("parts").alias("_parts"), first.alias("first"))
    rows = docs.select(F.col(id_col).alias("doc")).join(sums, "doc", "left").fillna(0, ["n_unclosed", "n_stray", "n_crossing", "n_errors", "_parts"])
    balanced = F.col("n_unclosed") + F.col("n_stray") + F.col("n_crossing") == 0
    return rows.select("doc", "n_unclosed", "n_stray", "n_crossing", "n_errors", balanced.alias("balanced"), (F.col("_parts") == 0).alias("has_parts"), "first.line", "first.col", "first.message")


def validate_staged(staged: DataFrame) -> DataFrame:
    """path, status, n_issues, line, col, message of staged files (path, media_type, text); paths are unique.

    valid or invalid for XML, by the media type without its parameters; missing media type; unchecked for others. A staged set may be written if none is invalid or lacks its type.
    """
    kind = F.lower(F.btrim(F.substring_index("media_type", ";", 1)))
    rows = staged.withColumn("kind", kind)
    is_xml = kind.isin(*XML_TYPES) | F.endswith(kind, F.lit("+xml"))
    # a root is asked for too: text beside tags, or no element at all, is no XML
    found = issues(rows.where(is_xml), "path", "text", xml=True)
    told = found.where("severity = 'error' or code = 'twice'").groupBy(F.col("doc").alias("path")).agg(F.count("*").alias("n"), F.min(F.struct("line", "col", "message")).alias("first"))
    empty = ~F.coalesce("text", F.lit("")).rlike("<[A-Za-z_]")
    joined = rows.join(told, "path", "left").withColumn("n", F.coalesce("n", F.when(empty & is_xml, 1), F.lit(0)))
    missing = F.coalesce(F.col("kind"), F.lit("")) == ""
    status = F.when(missing, "missing media type").when(~is_xml, "unchecked").when(F.col("n") > 0, "invalid").otherwise("valid")
    message = F.when(missing, "missing media type").when(is_xml & empty, "no element").otherwise(F.col("first.message"))
    return joined.select("path", status.alias("status"), F.when(missing, 1).otherwise(F.col("n")).cast("long").alias("n_issues"), F.coalesce("first.line", F.when(is_xml & empty, 1)).alias("line"), F.coalesce("first.col", F.when(is_xml & empty, 1)).alias("col"), message.alias("message"))
