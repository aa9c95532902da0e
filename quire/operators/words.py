"""Words, characters, dictionaries and the reports about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.pages import WORD
from quire.plans.scratch import Scratch

#: Fixed value: longer runs are no words.
LONGEST = 90


def word_list(text: Column | str) -> Column:
    return F.filter(F.regexp_extract_all(T.col(text), F.lit(WORD), F.lit(0)), lambda x: F.length(x) <= LONGEST)


def unique_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return docs.select(F.col(lang_col).alias("lang"), F.explode(word_list(text_col)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))


def char_usage(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """char, codepoint, hex, n_docs; line ends don't count. Characters are made distinct inside the row first."""
    chars = docs.select(F.explode(F.array_distinct(F.split(F.col(text_col), ""))).alias("char")).where("char <> '' and char <> '\n'")
    return chars.groupBy("char").agg(F.count("*").alias("n_docs")).select("char", F.ascii("char").cast("long").alias("codepoint"), F.hex(F.ascii("char")).alias("hex"), "n_docs")


def counted_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """unique_words as a written table, for operators that read it twice."""
    return Scratch(docs.sparkSession, "words").table(unique_words(docs, text_col, lang_col), "words")


def dictionary(words: DataFrame, least: int) -> DataFrame:
    """(lang, key): words that occur often enough to count as correct."""
    return words.where(F.col("n") >= least).select("lang", F.lower(T.spelling_safe("word")).alias("key")).distinct()


def misspelled(words: DataFrame, least: int) -> DataFrame:
    """Words (lang, word, n) that are written in no way at least so often; languages in which no word is have none.

    One aggregate: the ways to write a key, a few words, stand in one row.
    """
    keyed = words.groupBy("lang", F.lower(T.spelling_safe("word")).alias("key")).agg(F.max("n").alias("most"), F.collect_list(F.struct("word", "n")).alias("ways"))
    known = words.groupBy("lang").agg(F.max("n").alias("most")).where(F.col("most") >= least).select("lang")
    return keyed.where(F.col("most") < least).select("lang", F.inline("ways")).join(known, "lang", "left_semi")


def deletions(word: Column) -> Column:
    """The word, and all that is left of it after deleting one or two letters beyond the first."""
    n = F.length(word)
    rest = lambda i: F.substring(word, i + 1, n)
    places = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    between = lambda i, j: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, j - i - 1), rest(j))
    one = F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), rest(i)))
    two = F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: j > i), lambda j: between(i, j))))
    return F.array_distinct(F.concat(F.array(word), one, two))


def suggest(wrong: DataFrame, known: DataFrame, most: int = 4) -> DataFrame:
    """lang, word, rank, suggestion, distance: dictionary words of the same first letter and about the same length within two edits.

    Words within two edits of each other share what is left after deleting up to two letters of each, so that an equi-join finds them.
    """
    a = wrong.select("lang", "word", F.lower("word").alias("w")).withColumn("part", F.explode(deletions(F.col("w"))))
    b = known.select("lang", "key", F.explode(deletions(F.col("key"))).alias("part"))
    near = a.join(b, ["lang", "part"]).where(F.abs(F.length("w") - F.length("key")) <= 1).select("lang", "word", "key", F.levenshtein("w", "key", 2).alias("d")).where("d >= 0").distinct()
    rank = F.row_number().over(Window.partitionBy("lang", "word").orderBy("d", "key"))
    return near.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).select("lang", "word", "rank", F.col("key").alias("suggestion"), F.col("d").cast("long").alias("distance"))


def counts_report(docs: DataFrame, searches: dict[str, str], by: str, text_col: str = "text") -> DataFrame:
    """name, target, n: matches of each saved search by group; a search that can't be run counts -1 and not in the total; and totals.

    One pass: a sum for each search, then unpivoted.
    """
    from quire.operators.search import PatternError, count_matches

    sums = {}
    for name, pattern in searches.items():
        try:
            sums[name] = F.sum(count_matches(text_col, pattern))
        except PatternError:
            sums[name] = F.lit(-1).cast("long")
    one = docs.groupBy(F.col(by).alias("target")).agg(*(c.alias(f"c{k}") for k, c in enumerate(sums.values())))
    rows = F.array(*(F.struct(F.lit(name).alias("name"), F.coalesce(F.col(f"c{k}"), F.lit(0)).alias("n")) for k, name in enumerate(sums)))
    long = one.select("target", F.inline(rows))
    total = F.sum(F.when(F.col("n") > -1, F.col("n")).otherwise(0))
    return long.groupingSets([["name", "target"], []], "name", "target").agg(F.when(F.grouping("name") == 1, total).otherwise(F.min("n")).alias("n"), F.grouping("name").cast("int").alias("is_total"))


#: Rules of an index that one plan takes; they are few, as each is a test of every line.
MOST_RULES = 10_000


def index_hits(docs: DataFrame, rules: list[tuple[str, str]] | DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, block, entry: lines in which a rule's pattern occurs. Rules are pairs or a table (pattern, entry).

    Patterns are compiled once each: 200 rules are tested in one array, further ones in arrays of their own. A table of more than MOST_RULES is refused; a line has each entry once.
    """
    from quire.operators.search import java_pattern

    if isinstance(rules, DataFrame):
        found = rules.select("pattern", "entry").distinct().where("pattern is not null and entry is not null").limit(MOST_RULES + 1).collect()
        if len(found) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules")
        rules = sorted((r.pattern, r.entry) for r in found)
    blocks = docs.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("block", "line"))
    tests = [F.when(F.col("line").rlike(java_pattern(p)), F.lit(e)) for p, e in rules]
    arrays = [F.array_compact(F.array(*tests[k : k + 200])) for k in range(0, len(tests), 200)] or [F.array().cast("array<string>")]
    return blocks.select(id_col, F.col("block").cast("long").alias("block"), F.explode(F.array_distinct(F.flatten(F.array(*arrays)))).alias("entry"))


def char_names(chars: DataFrame) -> DataFrame:
    """``char_usage`` rows with entity (the first named reference in HTML, null if there is none) and description, the character's name in Unicode; by the distinct characters only."""
    import unicodedata
    from html.entities import codepoint2name

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            points = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codepoint2name.get(p) for p in points], pa.string()), pa.array([unicodedata.name(chr(p), "") for p in points], pa.string())], names=["codepoint", "entity", "description"])

    named = chars.select("codepoint").distinct().mapInArrow(run, "codepoint long, entity string, description string")
    return chars.join(named, "codepoint", "left")


def index_anchor_ids(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Numbers the blocks with hits of each document: (id, block, anchor)."""
    blocks = hits.select(id_col, "block").distinct()
    return blocks.withColumn("anchor", F.concat(F.lit("idx"), F.row_number().over(Window.partitionBy(id_col).orderBy("block")).cast("string")))


def index_tree(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """path, lvl, parent, n: entries split on '/' and merged into a tree of categories."""
    parts = F.split("entry", "/")
    prefixes = hits.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.slice(parts, 1, k))).alias("p"))
    joined = lambda c: F.array_join(c, "/")
    return prefixes.groupBy(joined("p").alias("path"), F.size("p").cast("long").alias("lvl"), joined(F.slice("p", 1, F.size("p") - 1)).alias("parent")).agg(F.count("*").alias("n"))


def letter_breaks(entries: DataFrame) -> DataFrame:
    """Root entries in order with a mark where the first letter differs from that of the entry before."""
    placed = places(entries.select("entry", F.upper(F.substring("entry", 1, 1)).alias("letter")), [F.lower("entry"), F.col("entry")])
    before = placed.select((F.col("place") + 1).alias("place"), F.col("letter").alias("last"))
    return placed.join(before, "place", "left").select("entry", "letter", (~F.col("letter").eqNullSafe(F.col("last"))).alias("new_letter"))


def numbered(df: DataFrame, by: str, order: list[str | Column], number: str = "n") -> DataFrame:
    """df with the place of each row among those with the same ``by``, from 1, in two levels.

    Rows are dealt into ranges of the order, which a table fixes; windows go over the rows of a range, then over the ranges' counts.
    """
    dealt = Scratch(df.sparkSession, "numbered").table(df.repartitionByRange(*order).withColumn("_r", F.spark_partition_id()), "dealt")
    sums = dealt.groupBy(F.col(by).alias("_by"), F.col("_r").alias("_s")).agg(F.count("*").alias("_m"))
    before = Window.partitionBy("_by").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(by, "_r").orderBy(*order)))
    found = own.join(sums, (F.col("_r") == F.col("_s")) & F.col(by).eqNullSafe(F.col("_by")))
    return found.withColumn(number, F.col("_own") + F.col("_before")).drop("_r", "_s", "_by", "_own", "_before")


def places(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with the place of each row in an order, from 1."""
    return numbered(df.withColumn("_all", F.lit(0)), "_all", order, "place").drop("_all").withColumn("place", F.col("place").cast("long"))


def unique_names(df: DataFrame, prefix: str, order: str, width: int = 4) -> DataFrame:
    """The next free numbered name of each row within its prefix: numbers in order, padded with zeros; longer numbers stay whole."""
    n = F.col("_n").cast("string")
    return numbered(df.select(prefix, order), prefix, [order], "_n").select(order, F.concat(F.col(prefix), F.lpad(n, F.greatest(F.lit(width), F.length(n)), "0")).alias("name"))


def natural_key(c: Column | str) -> Column:
    """A sort key in which runs of digits count as numbers of any length: each goes after the count of its digits."""
    runs = F.regexp_extract_all(T.col(c), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    number = lambda x: F.concat(F.lpad(F.length(x).cast("string"), 10, "0"), x)
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), number(F.regexp_replace(x, "^0+(?=.)", ""))).otherwise(F.lower(x))), "")


def paragraphs(docs: DataFrame, ignore_blank: bool = False, text_col: str = "text") -> DataFrame:
    """docs with each line as a paragraph of markup, inside the row; blank lines are empty paragraphs or left out."""
    lines = F.split(F.col(text_col), "\n")
    if ignore_blank:
        lines = F.filter(lines, lambda x: x.rlike(r"\S"))
    return docs.withColumn(text_col, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), T.html_escape(x), F.lit("</p>"))), "\n"))


def merged_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, par, text): a paragraph begins at an empty or indented line or ends with a full stop; its lines are joined by blanks."""
    lines = docs.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("k", "line")).repartition(id_col)
    w = Window.partitionBy(id_col).orderBy("k")
    par = F.sum(((F.col("line") == "") | F.col("line").rlike("^[ \t]")).cast("long")).over(w)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: F.btrim(x["line"])), " ")
    return lines.withColumn("par", par).groupBy(id_col, "par").agg(joined.alias("text"))


def line_diff(old: DataFrame, new: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, added, removed): lines as multisets, of changed documents only."""
    both = old.select(id_col, F.col(text_col).alias("a")).join(new.select(id_col, F.col(text_col).alias("b")), id_col).where("a <> b")
    lines = lambda c, s: both.select(id_col, F.explode(F.split(c, "\n")).alias("line"), F.lit(s).alias("s"))
    by_line = lines("a", -1).unionByName(lines("b", 1)).groupBy(id_col, "line").agg(F.sum("s").alias("s"))
    return by_line.groupBy(id_col).agg(F.sum(F.when(F.col("s") > 0, F.col("s")).otherwise(0)).alias("added"), F.sum(F.when(F.col("s") < 0, -F.col("s")).otherwise(0)).alias("removed"))
