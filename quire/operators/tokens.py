"""Markup as tables: tokens, elements and what can be read from them.

Documents are rows (id, text). ``tokens`` partitions them by id before they are exploded, so that the windows and joins by id
that follow need no other shuffle of the larger token table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.plans.shares import dealt

# Fixed values, shared with the oracles: they mean the same in Java's and RE2's dialects.
TOKEN = r"<!--(?s:.*?)-->|<[^<>]*>|[^<]+|<"
SILENT = r"(?is)<(script|style)\b[^>]*>.*?</(?:script|style)>"
ATTR = r"""([A-Za-z_:][-A-Za-z0-9_:.]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BLOCK = "h1 h2 h3 h4 h5 h6 p div li dt dd blockquote pre td th figcaption caption".split()


def blanked(c: Column | str) -> Column:
    """Text without script and style elements; tree operators work on this."""
    return F.regexp_replace(T.col(c), SILENT, "")


def token_type(tok: Column) -> Column:
    return (
        F.when(~F.startswith(tok, F.lit("<")) | (tok == "<"), "text")
        .when(F.startswith(tok, F.lit("<!--")), "comment")
        .when(F.startswith(tok, F.lit("<![CDATA[")), "cdata")
        .when(F.startswith(tok, F.lit("<!")), "doctype")
        .when(F.startswith(F.lower(tok), F.lit("<?xml ")), "xmlheader")
        .when(F.startswith(tok, F.lit("<?")), "pi")
        .when(F.startswith(tok, F.lit("</")), "end")
        .when(F.endswith(tok, F.lit("/>")), "single")
        .otherwise("begin")
    )


def tokens(docs: DataFrame, id_col: str = "page_id", text_col: str = "html", positions: bool = True, whole: bool = False, last: bool = False) -> DataFrame:
    """doc, seq, pos, tok, ttype, tname: all tokens in order; their texts put together are the document.

    A null text has no tokens. ``positions``: with pos, the 0-based code point where the token begins. ``whole``: a script or style element is one token, of type silent.
    ``last``: with last, the seq of the document's last token.
    """
    rows = dealt(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t")), "doc")
    found = F.regexp_extract_all("t", F.lit(f"{SILENT}|{TOKEN}" if whole else TOKEN), F.lit(0))
    if last:
        rows = rows.select("doc", found.alias("l")).select("doc", (F.size("l") - 1).cast("long").alias("last"), "l")
    # outer, since for an inner explode Spark looks for tokens before the shuffle too
    out = rows.select("doc", *(["last"] if last else []), F.posexplode_outer("l" if last else found).alias("seq", "tok")).where("seq is not null")
    if positions:
        before = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("pos", F.coalesce(F.sum(F.length("tok")).over(before), F.lit(0)))
    kind = token_type(F.col("tok"))
    if whole:
        kind = F.when(F.col("tok").rlike(rf"^{SILENT}$"), "silent").otherwise(kind)
    name = F.when(kind.isin("begin", "end", "single"), F.lower(F.regexp_extract("tok", r"^</?([^\s/>]*)", 1))).otherwise("")
    return out.select("doc", F.col("seq").cast("long").alias("seq"), *(["pos"] if positions else []), "tok", kind.alias("ttype"), name.alias("tname"), *(["last"] if last else []))


def attributes(tok: Column | str) -> Column:
    """Map of lower-cased attribute names to values without quotes; of repeated names the first counts."""
    found = F.regexp_extract_all(T.col(tok), F.lit(ATTR), F.lit(0))
    pair = lambda x: F.struct(F.lower(F.regexp_extract(x, ATTR, 1)).alias("k"), F.regexp_replace(F.regexp_extract(x, ATTR, 2), "^[\"']|[\"']$", "").alias("v"))
    pairs = F.transform(found, pair)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    firsts = F.aggregate(pairs, F.array().cast("array<struct<k:string,v:string>>"), lambda a, x: F.when(F.exists(a, lambda y: y["k"] == x["k"]), a).otherwise(F.concat(a, F.array(x))))
    return F.when(F.size(found) > 0, F.map_from_entries(firsts)).otherwise(none)


def token_attrs(toks: DataFrame) -> DataFrame:
    """Rows (doc, seq, tname, attr, value) of begin and single tags."""
    return toks.where("ttype in ('begin', 'single')").select("doc", "seq", "tname", F.explode(attributes("tok")).alias("attr", "value"))


def token_depth(toks: DataFrame) -> DataFrame:
    """The stack depth after each token, pushing on begin and popping on end tags; it may drift where tags are unclosed."""
    w = Window.partitionBy("doc").orderBy("seq")
    step = F.when(F.col("ttype") == "begin", 1).when(F.col("ttype") == "end", -1).otherwise(0)
    return toks.withColumn("depth", F.sum(step).over(w))


def paired(toks: DataFrame, void: list[str] = VOID) -> DataFrame:
    """Tags (doc, seq, tok, tname, ttype, ...) with alone (void or single), partner and crossing.

    A begin tag's partner is the end tag of its name and level. Where the brackets of all names, by their common depth, don't close in that order, the tags cross
    others and have no partner.
    """
    doc = Window.partitionBy("doc").orderBy("seq")
    alone = (F.col("ttype") == "single") | F.col("tname").isin(void)
    tags = toks.where("ttype in ('begin', 'single', 'end') and tname <> ''")
    tags = tags.withColumn("alone", alone).where("not (alone and ttype = 'end')")
    begins, ends = F.col("ttype") == "begin", F.col("ttype") == "end"
    step = F.when(F.col("alone"), 0).when(begins, 1).otherwise(-1)
    level = F.sum(step).over(Window.partitionBy("doc", "tname").orderBy("seq")) + ends.cast("int")
    named = Window.partitionBy("doc", "tname", "level").orderBy("seq")
    other = F.when(begins & (F.lead("ttype").over(named) == "end"), F.lead("seq").over(named)).when(ends & (F.lag("ttype").over(named) == "begin"), F.lag("seq").over(named))
    own = tags.withColumn("level", F.when(F.col("alone"), F.lit(None)).otherwise(level)).withColumn("other", F.when(~F.col("alone"), other)).drop("level")
    step = F.when(F.col("other").isNull(), 0).when(begins, 1).otherwise(-1)
    common = own.withColumn("common", F.when(F.col("other").isNotNull(), F.sum(step).over(doc) + ends.cast("int")))
    brackets = Window.partitionBy("doc", "common").orderBy("seq")
    crossing = F.coalesce(F.when(begins, F.lead("seq").over(brackets)).otherwise(F.lag("seq").over(brackets)) != F.col("other"), F.lit(True))
    found = common.withColumn("crossing", F.col("other").isNotNull() & crossing)
    return found.withColumn("partner", F.when(~F.col("crossing"), F.col("other"))).drop("common", "other")


def elements(docs: DataFrame, id_col: str = "page_id", text_col: str = "html", whole: bool = False) -> DataFrame:
    """doc, eid (its first token), tname, tok, end_seq, matched, depth, parent_eid, child_no, type_no: ``spans`` with their places in the tree."""
    return with_parents(spans(docs, id_col, text_col, whole))


def spans(docs: DataFrame, id_col: str = "page_id", text_col: str = "html", whole: bool = False) -> DataFrame:
    """doc, eid, tname, tok, alone, matched, end_seq: elements without their places in the tree, as ``around`` needs them.

    Tags are paired by name and level. Void and single tags end where they begin; a begin tag without a partner, or one that crosses others, ends with the nearest
    paired element around it, or with the document. Scripts and styles are left out, or, with ``whole``, tokens that count but are no elements. Everything comes from running windows over a document, in time in proportion to
    its tags and their depth.
    """
    text = F.col(text_col) if whole else blanked(text_col)
    tags = paired(tokens(docs.select(F.col(id_col), text.alias(text_col)), id_col, text_col, positions=False, whole=whole, last=True))
    ended = with_ends(tags).where("ttype <> 'end'")
    return ended.select("doc", F.col("seq").alias("eid"), "tname", "tok", "alone", (F.col("alone") | F.col("partner").isNotNull()).alias("matched"), "end_seq")


def with_ends(tags: DataFrame) -> DataFrame:
    """Tags of ``paired``, made of tokens with last, with end_seq: where the element of a begin or single tag ends, by the rules of ``spans``."""
    doc = Window.partitionBy("doc").orderBy("seq")
    begins, loose = (F.col("ttype") == "begin") & F.col("partner").isNotNull(), (F.col("ttype") == "begin") & ~F.col("alone") & F.col("partner").isNull()
    step = F.when(F.col("alone") | F.col("partner").isNull(), 0).when(begins, 1).otherwise(-1)
    # a loose tag lies in the latest paired one that opened at the depth there
    open_ = tags.withColumn("open", F.when(begins | loose, F.sum(step).over(doc)))
    around_ = F.last(F.when(begins, F.col("partner")), ignorenulls=True).over(Window.partitionBy("doc", "open").orderBy("seq"))
    end = F.when(F.col("alone"), F.col("seq")).when(loose, F.coalesce("around", "last")).when(F.col("ttype") == "begin", F.col("partner"))
    return open_.withColumn("around", around_).withColumn("end_seq", end).drop("open", "around")


def with_parents(ended: DataFrame) -> DataFrame:
    """Depth, parent and places among siblings, by windows: each element gives rows for its two ends, then rows as a parent and as a child."""
    mark = lambda seq, turn, step: F.struct(F.col(seq).alias("seq"), F.lit(turn).alias("turn"), step.alias("step"))
    opens, closes = mark("eid", 1, F.when(F.col("alone"), 0).otherwise(1)), mark("end_seq", 2, F.lit(-1))
    marks = ended.withColumn("m", F.explode(F.when(F.col("alone"), F.array(opens)).otherwise(F.array(opens, closes)))).select("*", "m.*").drop("m")
    depth = F.sum("step").over(Window.partitionBy("doc").orderBy("seq", "turn")) + F.col("alone").cast("long")
    deep = marks.withColumn("depth", depth).where("turn = 1").drop("seq", "turn", "step")
    role = lambda key, child: F.struct(key.alias("key"), F.lit(child).alias("child"))
    child, parent = role(F.col("depth") - 1, True), role(F.col("depth"), False)
    roles = deep.withColumn("r", F.explode(F.when(F.col("alone"), F.array(child)).otherwise(F.array(child, parent)))).select("*", "r.*").drop("r")
    before = Window.partitionBy("doc", "key").orderBy("eid")
    found = roles.withColumn("parent_eid", F.last(F.when(~F.col("child"), F.col("eid")), ignorenulls=True).over(before)).where("child").drop("key", "child")
    siblings = Window.partitionBy("doc", "parent_eid").orderBy("eid")
    same = Window.partitionBy("doc", "parent_eid", "tname").orderBy("eid")
    return found.withColumns({"child_no": F.row_number().over(siblings), "type_no": F.row_number().over(same)})


def around(places: DataFrame, els: DataFrame, carried: dict[str, Column], every: bool = False) -> DataFrame:
    """places (doc, seq, ...) with the columns ``carried`` of the innermost of the elements that began before and don't end before; null where there is none.

    every: a row for each of these elements instead, from the outermost (up: 1) in; places outside of all are left out. Elements must be properly nested, as those of
    ``elements`` are. One sort of the document gives the depth of each place, a sort by depth the latest element that opened at it.
    """
    mine = [c for c in places.columns if c != "doc"]
    none = F.lit(None)
    value = F.struct(*(c.alias(n) for n, c in carried.items()))
    ends = els.where("not alone").select("doc", value.alias("e"), F.explode(F.array(F.struct(F.col("eid").alias("at"), F.lit(2).alias("turn"), F.lit(1).alias("step")), F.struct(F.col("end_seq").alias("at"), F.lit(3).alias("turn"), F.lit(-1).alias("step")))).alias("m"))
    kind = ends.schema["e"].dataType
    own = places.select("doc", F.struct(*mine).alias("p"), none.cast(kind).alias("e"), F.col("seq").alias("at"), F.lit(1).alias("turn"), F.lit(0).alias("step"))
    both = own.unionByName(ends.select("doc", none.cast(own.schema["p"].dataType).alias("p"), "e", "m.*"))
    levels = both.withColumn("up", F.sum("step").over(Window.partitionBy("doc").orderBy("at", "turn"))).where("turn < 3")
    if every:
        levels = levels.withColumn("up", F.explode(F.when(F.col("turn") == 2, F.array("up")).when(F.col("up") > 0, F.sequence(F.lit(1).cast("long"), F.col("up"))).otherwise(F.array().cast("array<long>"))))
    last = F.last(F.when(F.col("turn") == 2, F.col("e")), ignorenulls=True).over(Window.partitionBy("doc", "up").orderBy("at", "turn"))
    return levels.withColumn("e", last).where("turn = 1").select("doc", *(F.col("p")[c].alias(c) for c in mine), *(["up"] if every else []), *(F.col("e")[n].alias(n) for n in carried))


def surrounded(places: DataFrame, els: DataFrame, flags: dict[str, Column], named: Column, carried: dict[str, Column]) -> DataFrame:
    """places (doc, seq, ...) with, for each of flags, whether an element lies around for which it holds, and the columns ``carried`` of the innermost around for which named holds.

    What ``around`` says for several sets of elements, in its two sorts for all of them.
    """
    mine = [c for c in places.columns if c != "doc"]
    value = F.when(named, F.struct(*(c.alias(n) for n, c in carried.items())))
    one = lambda test: F.coalesce(test.cast("int"), F.lit(0))
    held = els.where("not alone").select("doc", value.alias("e"), F.struct(one(named).alias("named"), *(one(c).alias(n) for n, c in flags.items())).alias("is"), "eid", "end_seq")
    mark = lambda at, turn, sign: F.struct(F.col(at).alias("at"), F.lit(turn).alias("turn"), F.lit(sign).alias("sign"))
    ends = held.select("doc", "e", "is", F.explode(F.array(mark("eid", 2, 1), mark("end_seq", 3, -1))).alias("m")).select("doc", "e", "is", "m.*")
    none = lambda c: F.lit(None).cast(ends.schema[c].dataType).alias(c)
    own = places.select("doc", F.struct(*mine).alias("p"), none("e"), none("is"), F.col("seq").alias("at"), F.lit(1).alias("turn"), F.lit(0).alias("sign"))
    both = own.unionByName(ends.withColumn("p", F.lit(None).cast(own.schema["p"].dataType)))
    order = Window.partitionBy("doc").orderBy("at", "turn")
    open_ = lambda n: F.sum(F.coalesce(F.col("sign") * F.col("is")[n], F.lit(0))).over(order)
    levels = both.withColumns({"up": open_("named"), **{f"_{n}": open_(n) > 0 for n in flags}}).where("turn = 1 or (turn = 2 and is.named = 1)")
    last = F.last("e", ignorenulls=True).over(Window.partitionBy("doc", "up").orderBy("at", "turn"))
    return levels.withColumn("e", last).where("turn = 1").select("doc", *(F.col("p")[c].alias(c) for c in mine), *(F.col(f"_{n}").alias(n) for n in flags), *(F.col("e")[n].alias(n) for n in carried))


def visible_text(docs: DataFrame, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """(doc, text): what stands outside scripts, styles, comments and other markup, in order. Computed inside the row."""
    found = F.regexp_extract_all(blanked(text_col), F.lit(TOKEN), F.lit(0))
    return docs.select(F.col(id_col).alias("doc"), F.array_join(F.filter(found, lambda x: token_type(x) == "text"), "").alias("text"))


def serialize(toks: DataFrame) -> DataFrame:
    """(doc, text): the tokens of each document put together again."""
    return toks.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "tok"))), lambda x: x["tok"]), "").alias("text"))


def anchors(docs: DataFrame, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """doc, n, href: values of all href attributes, in order of their tags. Computed inside the row."""
    tags = F.filter(F.regexp_extract_all(text_col, F.lit(TOKEN), F.lit(0)), lambda x: token_type(x).isin("begin", "single"))
    found = F.filter(F.transform(tags, lambda x: F.try_element_at(attributes(x), F.lit("href"))), lambda x: x.isNotNull())
    return docs.select(F.col(id_col).alias("doc"), F.posexplode(found).alias("n", "href"))


def css_rules(docs: DataFrame, id_col: str = "page_id", text_col: str = "html", style_blocks: bool = True) -> DataFrame:
    """doc, rule_no, selector_no, selector, body: rules of stylesheets, or of the style blocks of pages; groups are split.

    Comments go first; at-rules with nested rules are opened, other at-rules and their statements left out.
    """
    css = F.array_join(F.transform(F.regexp_extract_all(text_col, F.lit(r"(?is)<style\b[^>]*>(.*?)</style>"), F.lit(1)), lambda x: x), "\n") if style_blocks else F.col(text_col)
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(css, r"(?s)/\*.*?\*/", ""), r"@(?:media|supports)[^{]*\{", ""), r"@[a-z-]+[^{};]*;", "")
    rules = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.regexp_extract_all(clean, F.lit(r"[^{}]+\{[^{}]*\}"), F.lit(0))).alias("rule_no", "rule"))
    split = rules.select("doc", "rule_no", F.posexplode(F.split(F.regexp_extract("rule", r"^([^{]*)\{", 1), ",")).alias("selector_no", "selector"), F.regexp_extract("rule", r"\{([^}]*)\}", 1).alias("body"))
    return split.select("doc", F.col("rule_no").cast("long").alias("rule_no"), F.col("selector_no").cast("long").alias("selector_no"), F.btrim("selector", F.lit(" \t\r\n\f")).alias("selector"), "body")


def css_declarations(rules: DataFrame) -> DataFrame:
    """doc, rule_no, selector, prop, value."""
    one = rules.select("doc", "rule_no", "selector", F.explode(F.split("body", ";")).alias("d")).where("instr(d, ':') > 0")
    return one.select("doc", "rule_no", "selector", F.lower(F.btrim(F.substring_index("d", ":", 1))).alias("prop"), F.btrim(F.regexp_extract("d", r"(?s)^[^:]*:(.*)$", 1)).alias("value"))


def css_urls(docs: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    """doc, url, path: targets of url() and @import in a stylesheet, resolved against its folder."""
    rx = r"""(?i)(?:url\(\s*|@import\s+)["']?([^"')\s;]+)"""
    found = docs.select(F.col(id_col).alias("doc"), F.col(path_col).alias("base"), F.explode(F.regexp_extract_all(text_col, F.lit(rx), F.lit(1))).alias("url"))
    return found.where("lower(url) <> 'url('").select("doc", "url", F.when(T.is_external("url"), F.col("url")).otherwise(T.resolve("base", "url")).alias("path"))


def css_imports(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rx = r"""(?i)@import\s+(?:url\(\s*)?["']?([^"')\s;]+)"""
    return docs.select(F.col(id_col).alias("doc"), F.posexplode(F.regexp_extract_all(text_col, F.lit(rx), F.lit(1))).alias("n", "url"))


def css_used_codepoints(decls: DataFrame) -> DataFrame:
    """doc, codepoint of strings in content declarations, hex escapes resolved; and dynamic: the value is more than strings."""
    content = decls.where("prop = 'content'")
    strings = F.regexp_extract_all("value", F.lit(r"\"[^\"]*\"|'[^']*'"), F.lit(0))
    pieces = F.flatten(F.transform(strings, lambda x: F.regexp_extract_all(F.substring(x, F.lit(2), F.length(x) - 2), F.lit(r"\\[0-9A-Fa-f]{1,6}\s?|(?s:.)"), F.lit(0))))
    point = lambda p: F.when(p.rlike(r"^\\[0-9A-Fa-f]"), F.conv(F.regexp_extract(p, r"^\\([0-9A-Fa-f]+)", 1), 16, 10).cast("long")).otherwise(F.ascii(p).cast("long"))
    dynamic = F.regexp_replace("value", r"\"[^\"]*\"|'[^']*'", "").rlike(r"\S")
    return content.select("doc", dynamic.alias("dynamic"), F.explode(F.transform(pieces, point)).alias("codepoint")).distinct()
