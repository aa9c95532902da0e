"""Pretty printing of markup: a line for each block, indented by the depth of blocks; inline and preformatted runs stay as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import checks
from quire.operators import tokens as M

# Elements around which white space means nothing, and those in which all of it counts.
BLOCKS = (
    "html head body title meta link base address article aside blockquote dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section summary "
    "table caption colgroup col thead tbody tfoot tr th td ul"
).split()
PREFORMATTED = ["pre", "textarea", "listing"]


def pretty(docs: DataFrame, id_col: str = "page_id", text_col: str = "html", indent: str = "  ") -> DataFrame:
    """id, status, text: formatted pages; those with unclosed, stray or crossing tags are skipped and stay, as do those that need nothing (unchanged).

    Only white space between two blocks changes: it becomes a line end and the indentation of what follows. Text, inline elements and what stands next to them, empty
    elements, scripts, styles and preformatted text stay to the letter. Formatting twice changes nothing. Null and empty texts are unchanged. A window over a document tells depths
    and neighbours.
    """
    toks = M.tokens(docs, id_col, text_col, positions=False, whole=True)
    bad = checks.tag_issues(toks).where("code in ('unclosed', 'stray', 'crossing')").select("doc").distinct().withColumn("bad", F.lit(True))
    doc = Window.partitionBy("doc").orderBy("seq")
    before, after = doc.rowsBetween(Window.unboundedPreceding, -1), doc.rowsBetween(1, Window.unboundedFollowing)
    tag, begin, end = F.col("ttype").isin("begin", "single", "end"), F.col("ttype") == "begin", F.col("ttype") == "end"
    blank = (F.col("ttype") == "text") & ~F.col("tok").rlike(r"\S")
    block = (tag & F.col("tname").isin(BLOCKS)) | F.col("ttype").isin("silent", "doctype", "comment", "xmlheader", "pi")
    holds = tag & F.col("tname").isin(BLOCKS) & ~F.col("tname").isin(M.VOID)
    rows = toks.withColumns({"blank": blank, "kind": F.when(~blank, F.when(block & begin & holds, "begin").when(block & end, "end").when(block, "block").otherwise("inline"))})
    step = F.when(holds & begin, 1).when(holds & end, -1).otherwise(0)
    pre = F.when(F.col("tname").isin(PREFORMATTED), F.when(begin, 1).when(end, -1)).otherwise(0)
    rows = rows.withColumns({
        "last": F.last("kind", ignorenulls=True).over(before), "next": F.first("kind", ignorenulls=True).over(after), "deep": F.coalesce(F.sum(step).over(before), F.lit(0)), "pre": F.coalesce(F.sum(F.coalesce(pre, F.lit(0))).over(before), F.lit(0)),
    })
    between = lambda a, b: a.isNotNull() & b.isNotNull() & (a != "inline") & (b != "inline") & ~((a == "begin") & (b == "end"))
    free = F.col("pre") == 0
    gone = F.col("blank") & free & (between(F.col("last"), F.col("next")) | F.col("last").isNull() & (F.col("next") != "inline"))
    depth = (F.col("deep") - F.when(end & holds, 1).otherwise(0)).cast("int")
    broken = ~F.col("blank") & free & between(F.col("last"), F.col("kind"))
    new = F.when(gone, "").when(broken, F.concat(F.lit("\n"), F.repeat(F.lit(indent), depth), F.col("tok"))).otherwise(F.col("tok"))
    made = rows.withColumn("new", new).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "new"))), lambda x: x["new"]), "").alias("_new"))
    whole = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("_old")).join(made, "doc", "left").join(bad, "doc", "left")
    status = F.when(F.col("bad").isNotNull(), "skipped").when(F.coalesce(F.col("_new") != F.col("_old"), F.lit(False)), "formatted").otherwise("unchanged")
    return whole.withColumn("status", status).select(F.col("doc").alias(id_col), "status", F.when(F.col("status") == "formatted", F.col("_new")).otherwise(F.col("_old")).alias(text_col))
