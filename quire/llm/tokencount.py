"""Token counts without ids (operator 10).

A text is cut into pre-tokens at places that no piece of the vocabulary can span, so the library's count of a text is the sum of
its counts of the pre-tokens. One pass counts how often each pre-token occurs; each distinct pre-token is then encoded
once; and each document's pre-token frequencies are joined to those counts and summed. The most frequent pre-tokens (a fixed
number) are joined through a broadcast table, all others through a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.scratch import Scratch

#: Pre-tokens in the broadcast table, at most: about 3 MB sent, 30 MB in a worker.
HOT = 200_000
#: Distinct pre-tokens that a task counts before it passes them on.
FLUSH = 300_000
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


class PieceCounter:
    """Piece counts of pre-tokens by the sentencepiece library, and the cuts that are safe for its vocabulary."""

    def __init__(self, model: bytes) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        inner = any("▁" in x.lstrip("▁") or "\n" in x for x in pieces)
        line = self.library.encode("\n", out_type=str)
        #: A text " a  b" is cut before each run of spaces, around line ends, and between a letter and a stop or comma.
        self.safe = not inner and line[:1] == ["▁"] and self.library.encode("\n\n", out_type=str) == line + line[1:]
        self.lead = len(line)
        ends = "(?=[.,])" if not any(re.search(f"[{LETTERS}][.,]", x) for x in pieces) else "(?!)"
        self.pattern = re.compile(rf"[ ▁]*(?:[{LETTERS}]++{ends}|[^ ▁\n]+)|[ ▁]+|\n")

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        return self.pattern.findall(" " + text) if self.safe else [" " + text]

    def counts(self, tokens: list[str]) -> list[int]:
        """The library puts a space before each string; where the pre-token has none, a line end shields it and is taken off."""
        spaced = [x[0] in " ▁" for x in tokens]
        found = self.library.encode([x[1:] if s else "\n" + x for x, s in zip(tokens, spaced, strict=True)], num_threads=1)
        # an empty string after the taken space is the lone space itself, which the library would leave out
        return [(len(y) if len(x) > 1 else 1) if s else len(y) - self.lead for x, y, s in zip(tokens, found, spaced, strict=True)]


@lru_cache(2)
def counter(model: bytes) -> PieceCounter:
    return PieceCounter(model)


def _frequencies(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = counter(model).split, Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

        for batch in batches:
            for text in batch.column(1):
                seen.update(split(text.as_py()))
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    return run


def _pieces(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = counter(model).counts(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=["token", "n", "pieces"])

    return run


def _documents(model: bytes, hot):
    """A row with the sum over frequent pre-tokens for each text, and a row for each other pre-token of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = counter(model).split, hot.value.get
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text, row = text.as_py(), row + 1
                tokens = split(text)
                found = list(map(known, tokens, repeat(0)))
                rest = Counter(x for x, n in zip(tokens, found, strict=True) if not n) if 0 in found else {}
                for x, y in zip(out, (row, i, f"\n{row}", sum(found), len(text.encode())), strict=True):
                    x.append(y)
                out[0].extend(repeat(row, len(rest)))
                out[1].extend(repeat(i, len(rest)))
                out[2].extend(rest)
                out[3].extend(rest.values())
                out[4].extend(repeat(0, len(rest)))
            kinds = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["row", "id", "token", "n", "bytes"])

    return run


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, hot: int = HOT) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens as the library counts the whole text, over_limit.

    A null or empty text has 0 bytes and 0 tokens. Repeated or null ids keep a row each. Other columns are not read.
    """
    spark, model = docs.sparkSession, open(model_path, "rb").read()
    scratch = Scratch(spark, "tokencount")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    totals = texts.mapInArrow(_frequencies(model), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = scratch.table(totals.mapInArrow(_pieces(model), "token string, n long, pieces long"), "counts")
    # the least count of which there are no more than ``hot`` pre-tokens, by eighths of a power of two
    step = F.floor(8 * F.log2("n"))
    least, there = 0, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True):
        there += r.n
        if there > hot:
            least = r.step + 1
            break
    frequent = spark.sparkContext.broadcast({x.token: x.pieces for x in counts.where(step >= least).select("token", "pieces").collect()})
    rows = texts.mapInArrow(_documents(model, frequent), "row long, id long, token string, n long, bytes long")
    return (
        rows.join(counts.select("token", "pieces"), "token", "left")
        .groupBy("row")
        .agg(F.max("id").alias(id_col), F.sum("bytes").alias("n_bytes"), F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens"))
        .drop("row")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
