"""Quality rules with risk-controlled thresholds, with DataFrame functions only (operator 5).

A rule rejects a text whose score exceeds a cutoff. A chain is a fixed sequence of cutoffs for all rules, each step stricter than the one
before: one rule's cutoff comes down its grid, then the next one's. In each stratum, the steps of a chain are tested in their order
on labelled good texts: does an exact binomial test reject "more than alpha of the good texts are rejected by these rules
together"? Testing stops at the first step that fails, so the steps of a chain share one level without a correction; the
chains and strata divide delta between them (Bonferroni, chains by their weights). With probability 1 - delta every step that
passed is safe in its stratum; of these the one is taken that rejects the most labelled bad texts, then the fewest good ones,
then the strictest. A stratum without a safe step has the base rule alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.scratch import Scratch

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Rules, each with its score and its grid of cutoffs, highest first.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / word_chars", [i / 100 for i in range(30, 0, -1)]),
    "long_words": ("word_chars / n_words", [i / 2 for i in range(60, 11, -1)]),
    "dup_lines": ("n_dup_lines / n_words", [i / 200 for i in range(30, 0, -1)]),
    "repeats": ("n_repeat_words / n_words", [i / 40 for i in range(39, 0, -1)]),
}
#: The rules' order in each chain, and its share of delta.
CHAINS: list[tuple[list[str], float]] = [([*list(RULES)[k:], *list(RULES)[:k]], 0.05 if k else 0.85) for k in range(len(RULES))]
STEPS = sum(len(grid) for _, grid in RULES.values())
#: False rejections of good texts that all rules of a stratum may have together; chance that a bound fails; strata broadcast.
ALPHA, DELTA, BROADCAST_STRATA = 0.01, 0.05, 100_000


def starts(chain: int) -> dict[str, int]:
    """How many steps of a chain come before a rule's first."""
    out, n = {}, 0
    for rule in CHAINS[chain][0]:
        out[rule], n = n, n + len(RULES[rule][1])
    return out


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs without the text, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Everything is computed inside the row: repeated windows are neighbours after sorting the hashes of all three-word windows.
    """
    keep = [c for c in docs.columns if c != text_col]
    whole = docs.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    words = F.filter(F.split(F.col(text_col), "[ \\t-\\r]+"), lambda x: x != "")
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    split = whole.select(*keep, text_col, words.alias("_words"), lines.alias("_lines"))
    counted = split.select(
        *keep,
        "_words",
        F.size("_words").alias("n_words"),
        F.length(F.translate(text_col, SPACE, "")).alias("word_chars"),
        (F.length(text_col) - F.length(F.translate(text_col, SYMBOLS, ""))).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
    )
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    hashes = F.slice(F.transform("_words", lambda x, i: F.xxhash64(x, F.get("_words", i + 1), F.get("_words", i + 2))), 1, F.greatest(F.col("n_words") - 2, F.lit(0)))
    hashed = counted.select(*keep, *numbers, hashes.alias("_windows"))
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    pairs = F.when(again, F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array())
    ordered = hashed.select(*keep, *numbers, pairs.alias("_pairs"))
    same = lambda x, k: (x["h"] == F.get("_pairs", k - 1)["h"]) | (x["h"] == F.get("_pairs", k + 1)["h"])
    places = F.sort_array(F.transform(F.filter("_pairs", lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"]))
    placed = ordered.select(*keep, *numbers, places.alias("_places"))
    covered = F.transform("_places", lambda x, k: F.coalesce(F.least(F.get("_places", k + 1) - x, F.lit(3)), F.lit(3)))
    repeated = F.aggregate(covered, F.lit(0), lambda a, x: a + x)
    return placed.select(*keep, *(F.col(x).cast("long").alias(x) for x in numbers), repeated.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def most_exceeding(n: Column, p: float, log_level: Column) -> Column:
    """The largest k up to n * p with P(X <= k) of at most the level, X of n trials of chance p; -1 if there is none.

    Exact: the terms are summed one by one in logarithms.
    """
    first = n * math.log1p(-p)

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + math.log(p / (1 - p))
        high = F.greatest(a["sum"], term)
        total = high + F.log1p(F.exp(-F.abs(a["sum"] - term)))
        return F.struct(term.alias("term"), total.alias("sum"), F.when(total <= log_level, i).otherwise(a["best"]).alias("best"))

    start = F.struct(first.alias("term"), first.alias("sum"), F.when(first <= log_level, F.lit(0)).otherwise(F.lit(-1)).cast("long").alias("best"))
    last = F.floor(n * p)
    return F.aggregate(F.when(last > 0, F.sequence(F.lit(1).cast("long"), last)).otherwise(F.array().cast("array<bigint>")), start, step, lambda a: a["best"])


def cutoffs(labelled: DataFrame, stratum_col: str, good_col: str = "good", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Stratum and a cutoff for each rule (null: the rule doesn't apply), from measured labelled texts; strata without a safe step have no row."""

    def exceeded(score: str, grid: list[float]) -> Column:
        """How many cutoffs of the grid the score exceeds."""
        return F.size(F.filter(F.array(*map(F.lit, grid)), lambda c: F.expr(score) > c))

    def so_far(what: str) -> Column:
        return F.aggregate("by", F.lit(0).cast("long"), lambda a, c: a + F.when(c["step"] <= F.col("at"), c[what]).otherwise(0))

    above = {r: exceeded(*x) for r, x in RULES.items()}
    lengths = {r: len(grid) for r, (_, grid) in RULES.items()}
    first = F.array(*(F.least(*(F.when(F.col(f"above_{r}") > 0, n + lengths[r] - F.col(f"above_{r}") + 1).otherwise(STEPS + 1) for r, n in starts(k).items())) for k in range(len(CHAINS))))
    rows = labelled.select(F.col(stratum_col).alias("stratum"), F.col(good_col).alias("good"), *(c.alias(f"above_{r}") for r, c in above.items()))
    counts = rows.select("stratum", "good", F.posexplode(first).alias("chain", "step")).groupBy("stratum", "chain", "step").agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"))
    # at most STEPS + 1 counts for a chain of a stratum
    marks = counts.groupBy("stratum", "chain").agg(F.sum("n_good").alias("total"), F.collect_list(F.struct("step", "n_good", "n_bad")).alias("by"))
    n_strata = marks.agg(F.count_distinct("stratum").alias("n_strata"))
    weight = F.get(F.array(*(F.lit(w) for _, w in CHAINS)), F.col("chain"))
    limits = marks.crossJoin(F.broadcast(n_strata)).withColumn("most", most_exceeding(F.col("total"), alpha, F.log(delta * weight / F.col("n_strata"))))  # one row
    tests = limits.withColumn("at", F.explode(F.sequence(F.lit(1), F.lit(STEPS)))).withColumns({"exceed": so_far("n_good"), "caught": so_far("n_bad")})
    # what a chain rejects only grows, so the steps before its first failure are those that pass
    best = tests.where("exceed <= most").groupBy("stratum").agg(F.max_by(F.struct("chain", "at"), F.struct("caught", -F.col("exceed"), "at", -F.col("chain"))).alias("best"))

    def cutoff(rule: str) -> Column:
        done = F.get(F.array(*(F.col("best.at") - starts(k)[rule] for k in range(len(CHAINS)))), F.col("best.chain"))
        return F.when(done > 0, F.get(F.array(*map(F.lit, RULES[rule][1])), F.least(done, F.lit(lengths[rule])) - 1))

    return best.select("stratum", *(cutoff(r).alias(f"cut_{r}") for r in RULES))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", quality_col: str = "quality") -> DataFrame:
    """id, stratum, the measures, base_failed, the stratum's cutoffs and kept, one row per input row.

    labels: id and quality (1: good). A null stratum is one of its own, null texts have no words. Labels of unknown
    ids and null labels count for nothing; repeated labels of an id count once, as good if any of them is. With few labels no cutoff is safe,
    and the base rule decides alone. Repeated rows are judged one by one. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.col(text_col).alias("text"))
    seen = Scratch(spark, "quality").table(measured(rows).withColumn("base_failed", base_failed()), "measured")
    told = labels.where(F.col(quality_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(quality_col) == 1).alias("good"))
    chosen = Scratch(spark, "quality").table(cutoffs(seen.where("not base_failed").join(told, id_col), "stratum"), "cutoffs")
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_STRATA else chosen
    over = F.lit(False)
    for r, (score, _) in RULES.items():
        over = over | F.coalesce(F.expr(score) > F.col(f"cut_{r}"), F.lit(False))
    return seen.join(chosen, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~over)
