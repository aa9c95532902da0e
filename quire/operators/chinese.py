"""Conversion of Chinese scripts in markup: phrase tables of any size, matched leftmost and longest in one pass, in chained stages.

The tables are data: rows (dictionary, source, target). A direction is a chain of stages, each a set of dictionaries that are matched together; what a stage has
converted it doesn't convert again. Which tokens of a page are converted is decided by windows over its elements; only those texts and tags go
through Python, in Arrow batches, with an automaton over the table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import tokens as M
from quire.operators.pages import own_lang

# The directions (simplified, traditional, Taiwan, Hong Kong; p: with phrases) as stages of public dictionaries.
ST, TS = ["STPhrases", "STCharacters"], ["TSPhrases", "TSCharacters"]
TW, HK, TW_BACK, HK_BACK = ["TWVariants"], ["HKVariants"], ["TWVariantsRevPhrases", "TWVariantsRev"], ["HKVariantsRevPhrases", "HKVariantsRev"]
DIRECTIONS = {
    "s2t": [ST], "t2s": [TS], "s2tw": [ST, TW], "tw2s": [TW_BACK, TS], "s2hk": [ST, HK], "hk2s": [HK_BACK, TS], "s2twp": [ST, ["TWPhrases"], TW], "tw2sp": [["TWPhrasesRev", *TW_BACK], TS],
    "t2tw": [TW], "tw2t": [TW_BACK], "t2hk": [HK], "hk2t": [HK_BACK],
}
# Elements whose texts stay, and attributes and SVG elements whose texts are converted.
SILENT, CODE = ["script", "style"], ["code", "kbd", "samp", "var"]
ATTRIBUTES = ["alt", "title", "aria-label"]
SVG_TEXTS = ["text", "tspan", "title", "desc"]
#: Rows of a table that are sent to all tasks; a larger one is refused (a million phrases take some 100 MB).
MOST_PHRASES = 1_000_000
ENTITY = re.compile(r"(&#?\w+;)")


class Stage:
    """A table of phrases, applied leftmost and longest."""

    def __init__(self, table: dict[str, str]) -> None:
        self.table = table
        self.automaton = ahocorasick.Automaton()
        for x in table:
            self.automaton.add_word(x, len(x))
        self.automaton.make_automaton()

    def convert(self, text: str) -> str:
        if not self.table:
            return text
        longest: dict[int, int] = {}
        for end, n in self.automaton.iter(text):
            start = end + 1 - n
            if longest.get(start, 0) < n:
                longest[start] = n
        out, at = [], 0
        for start in sorted(longest):
            if start >= at:
                end = start + longest[start]
                out += text[at:start], self.table[text[start:end]]
                at = end
        return "".join(out) + text[at:]


@lru_cache(4)
def _stages(key: int, sent) -> list[Stage]:
    return [Stage(dict(x)) for x in sent.value]


def _convert(sent, key: int, attributes: tuple[str, ...]):
    """Batches with new, the token after conversion, and changed. mode: 1 a text, 2 a tag."""
    rx = re.compile(rf"""(?i)(\s(?:{"|".join(map(re.escape, attributes)) or "(?!)"})\s*=\s*)("[^"]*"|'[^']*')""")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stages = _stages(key, sent)

        def text(x: str) -> str:
            parts = ENTITY.split(x)
            for k in range(0, len(parts), 2):
                for s in stages:
                    parts[k] = s.convert(parts[k])
            return "".join(parts)

        for batch in batches:
            toks, modes = (batch.column(batch.schema.names.index(c)) for c in ("tok", "mode"))
            old = toks.to_pylist()
            new = [text(t) if m == 1 else rx.sub(lambda x: x[1] + text(x[2]), t) if m == 2 else t for t, m in zip(old, modes.to_pylist(), strict=True)]
            made = {"new": pa.array(new, pa.string()), "changed": pa.array([a != b for a, b in zip(old, new, strict=True)], pa.bool_())}
            yield pa.RecordBatch.from_pydict({c: made[c] if c in made else batch.column(batch.schema.names.index(c)) for c in ("doc", "seq", "new", "changed", "ja", "kept")})

    return run


def stages_of(tables: DataFrame, mode: str) -> list[list[tuple[str, str]]]:
    """The chain of a direction from rows (dictionary, source, target); of one source in several dictionaries of a stage the first counts."""
    if mode not in DIRECTIONS:
        raise ValueError(f"no such direction: {mode}")
    names = [n for s in DIRECTIONS[mode] for n in s]
    wanted = tables.where(F.col("dictionary").isin(names) & (F.col("source") != "") & F.col("target").isNotNull())
    if (n := wanted.count()) > MOST_PHRASES:
        raise ValueError(f"{n} phrases; at most {MOST_PHRASES} can be sent to all tasks")
    found: dict[str, dict[str, str]] = {}
    for r in wanted.groupBy("dictionary", "source").agg(F.min("target").alias("target")).toArrow().to_pylist():
        found.setdefault(r["dictionary"], {})[r["source"]] = r["target"]
    if not found:
        raise ValueError(f"the tables have none of the dictionaries of {mode}")
    return [list({k: v for n in reversed(s) for k, v in found.get(n, {}).items()}.items()) for s in DIRECTIONS[mode]]


def convert(
    pages: DataFrame, stages: list[list[tuple[str, str]]], attributes: tuple[str, ...] = tuple(ATTRIBUTES), skip_code: bool = True, skip_pre: bool = False, metadata: bool = False, svg: bool = False
) -> DataFrame:
    """page_id, html, changes (tokens that changed), skipped_japanese and skipped_protected (texts with more than blanks) of pages (page_id, html).

    Texts and the attributes named are converted. Scripts, styles, code (skip_code), preformatted text (skip_pre), the head (unless metadata) and elements in Japanese stay; of
    SVG documents only what is in text, tspan, title or desc is converted. Entities, quotes and all other markup stay as they are. A null page stays null.
    """
    spark = pages.sparkSession
    toks = M.tokens(pages, positions=False, whole=True)
    names = [*SILENT, *(CODE if skip_code else []), *(["pre"] if skip_pre else []), *([] if metadata or svg else ["head"])]
    protected, spoken = F.col("tname").isin(names), F.col("tname").isin(SVG_TEXTS) if svg else F.lit(False)
    els = M.spans(pages, whole=True).withColumn("lang", F.lower(own_lang())).where(F.col("lang").isNotNull() | protected | spoken)
    placed = M.surrounded(toks, els, {"protected": protected, "spoken": spoken}, F.col("lang").isNotNull(), {"_lang": F.col("lang")})
    tag = F.col("ttype").isin("begin", "single")
    lang = F.coalesce(F.when(tag, F.lower(own_lang())), "_lang", F.lit(""))
    japanese = (lang == "ja") | F.startswith(lang, F.lit("ja-"))
    kept = F.col("protected") | (tag & F.col("tname").isin(names)) | (F.col("ttype") == "silent")
    text = (F.col("ttype") == "text") & (F.col("spoken") if svg else F.lit(True))
    said = text & F.col("tok").rlike(r"\S")
    mode = F.when(kept | japanese, 0).when(text, 1).when(tag, 2).otherwise(0)
    marked = placed.select("doc", "seq", "tok", mode.alias("mode"), (said & japanese).alias("ja"), ((said & kept & ~japanese) | (F.col("ttype") == "silent")).alias("kept"))
    sent = spark.sparkContext.broadcast(stages)
    done = marked.mapInArrow(_convert(sent, sent._jbroadcast.id(), attributes), f"doc {pages.schema['page_id'].dataType.simpleString()}, seq long, new string, changed boolean, ja boolean, kept boolean")
    whole = done.groupBy("doc").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "new"))), lambda x: x["new"]), "").alias("_html"), F.count_if("changed").alias("changes"),
        F.count_if("ja").alias("skipped_japanese"), F.count_if("kept").alias("skipped_protected"),
    )
    # only a null or empty page has no tokens, and one without an id meets none of its own
    rows = pages.select("page_id", F.when(F.col("page_id").isNull() | (F.col("html") == ""), F.col("html")).alias("html")).join(whole.withColumnRenamed("doc", "page_id"), "page_id", "left")
    return rows.select("page_id", F.coalesce("_html", "html").alias("html"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("changes", "skipped_japanese", "skipped_protected")))


def convert_direction(pages: DataFrame, tables: DataFrame, mode: str = "s2t", **options) -> DataFrame:
    """``convert`` with the dictionaries (dictionary, source, target) of one of the twelve directions."""
    return convert(pages, stages_of(tables, mode), **options)
