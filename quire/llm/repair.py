"""Conversation structure repair by Four-Russians block tables (operator 11).

A repair edits a conversation's turns so that the initials of their roles read ``(s?(ua)+)?``: keep, re-role, delete a turn, or insert an empty one. For
every place the costs of the best repair of all turns from there on, one for each state of that expression, form a vector; less its least entry it is one of a few
dozen. So a table holds, for each such vector and each block of BLOCK symbols, the vector before the block and what it costs. Blocks
are looked up from the last to the first; then the edits are read from the first on: each block is expanded backward from the vector at its end,
which says exactly which edits are among the cheapest, and the ASCII-least of them is taken.

Turns are numbered by a range sort over conversation and turn, so that a conversation with very many turns is dealt to many tasks; only its symbols, one
character a turn, are gathered, as the result holds as many. Texts are streamed in order, never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.scratch import Scratch

#: Symbols in a block of the table.
BLOCK = 4
#: Turns whose symbols are put together at first, as a power of two.
CHUNK_BITS = 12
#: Costs of the edits; a truncated turn that stays costs TRUNCATED more.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
WHITE = " \t\n\x0b\f\r"
#: Kinds of initials and faults of a turn; their numbers make its symbol.
INITIALS, FAULTS = "sua?", ("fine", "truncated", "blank", "duplicate")
#: States: nothing yet, after the system's turn, after a user's, after an assistant's; by initial the next state, and what a new or re-roled turn is.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEW = ("user", "user", "assistant", "user")
AFTER_NEW = (2, 2, 3, 2)
#: Digits that stand for symbols in blocks: a deleted turn, each initial fine and truncated, nothing.
DELETED, NOTHING, DIGITS = 8, 9, 10
#: Expanded blocks that a worker remembers.
EXPANDED = 100_000


def relaxed(g: list[int]) -> list[int]:
    """Costs when turns may be inserted first."""
    two, three = min(g[2], INSERT + g[3]), min(g[3], INSERT + g[2])
    return [min(g[0], INSERT + two), min(g[1], INSERT + two), two, three]


def edits(digit: int, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of the edits of one turn, in ASCII order."""
    out = [("D", DELETE, state)]
    if digit != DELETED:
        more = TRUNCATED * (digit % 2)
        if (to := NEXT[state].get(INITIALS[digit // 2])) is not None:
            out.append(("K", more, to))
        out.append(("R", REROLE + more, AFTER_NEW[state]))
    return out


class Tables:
    """Vectors of costs, and the steps between them by one symbol and by a block of symbols."""

    def __init__(self) -> None:
        never = 10**6
        self.end = tuple(relaxed([0, never, never, 0]))
        self.vectors, self.step, at = [self.end], [], 0
        index = {self.end: 0}
        while at < len(self.vectors):
            row = []
            for digit in range(DIGITS):
                new = self.vectors[at] if digit == NOTHING else relaxed([min(c + self.vectors[at][to] for _, c, to in edits(digit, q)) for q in range(4)])
                least = min(new)
                norm = tuple(x - least for x in new)
                if norm not in index:
                    index[norm] = len(self.vectors)
                    self.vectors.append(norm)
                row.append((index[norm], least))
            self.step.append(row)
            at += 1
        one, cost = (np.array([[x[k] for x in row] for row in self.step], np.int32) for k in (0, 1))
        to, total = np.arange(len(self.vectors), dtype=np.int32)[:, None], np.zeros((len(self.vectors), 1), np.int32)
        for _ in range(BLOCK):  # one more symbol before the block
            total = (total[:, None, :] + cost[to].transpose(0, 2, 1)).reshape(len(to), -1)
            to = one[to].transpose(0, 2, 1).reshape(len(to), -1)
        self.block_to, self.block_cost = to.tolist(), total.tolist()
        self.known: dict[tuple[int, int, int], tuple[str, int]] = {}

    def expand(self, end: int, code: int, state: int) -> tuple[str, int]:
        """The ASCII-least cheapest edits of a block that is followed by the vector ``end``, from a state on, and the state after it."""
        found = self.known.get((end, code, state))
        if found is None:
            digits = [int(x) for x in f"{code:0{BLOCK}d}"]
            before, at = [], end
            for digit in reversed(digits):
                to, least = self.step[at][digit]
                before.append((digit, self.vectors[to], least, self.vectors[at]))
                at = to
            out, q = "", state
            for digit, now, least, then in reversed(before):
                while digit != NOTHING:
                    worth = now[q] + least
                    ways = [(i, to) for i, c, to in edits(digit, q) if worth == c + then[to]]
                    if now[q] == INSERT + now[AFTER_NEW[q]]:
                        ways.append(("I", AFTER_NEW[q]))
                    kind, q = min(ways)
                    out += kind
                    if kind != "I":
                        break
            if len(self.known) >= EXPANDED:
                self.known.clear()
            found = self.known[end, code, state] = out, q
        return found

    def cheapest(self, digits: np.ndarray) -> tuple[int, str]:
        """Cost and edits of the repair of a row of turns."""
        whole = np.concatenate([np.full(-len(digits) % BLOCK, NOTHING, np.int64), digits])
        blocks = (whole.reshape(-1, BLOCK) @ (DIGITS ** np.arange(BLOCK)[::-1])).tolist()
        at, cost, ends = 0, 0, []
        for code in reversed(blocks):
            ends.append(at)
            cost += self.block_cost[at][code]
            at = self.block_to[at][code]
        cost, q, out = cost + self.vectors[at][0], 0, []
        for code in blocks:
            found, q = self.expand(ends.pop(), code, q)
            out.append(found)
        while self.end[q]:
            q = AFTER_NEW[q]
            out.append("I")
        return cost, "".join(out)


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text with faults put in by a checksum of conversation and turn: a twentieth each is dropped, emptied, loses its stops, is repeated, is set to user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))
    role, text = F.coalesce(F.col(role_col), space), F.coalesce(F.col(text_col), space)
    kind = F.crc32(key.cast("binary")) % 20
    made = rows.select(F.col(conv_col), F.col(turn_col), role.alias("_quire_role"), text.alias("_quire_text"), kind.alias("_quire_kind")).where("_quire_kind <> 0")
    text = F.when(F.col("_quire_kind") == 1, "").when(F.col("_quire_kind") == 2, F.regexp_replace("_quire_text", "[.!?]", "")).otherwise(F.col("_quire_text"))
    out = made.select(conv_col, turn_col, F.when(F.col("_quire_kind") == 4, "user").otherwise(F.col("_quire_role")).alias(role_col), text.alias(text_col), F.array_repeat(F.lit(0), F.when(F.col("_quire_kind") == 3, 2).otherwise(1)).alias("_quire_times"))
    return out.withColumn("_quire_times", F.explode("_quire_times")).drop("_quire_times")


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts, cost and edits from a conversation's symbols."""
    legal = np.array([[a + b in ("su", "ua", "au") for b in INITIALS] for a in INITIALS])
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("blank", "duplicate", "truncated", "illegal", "cost", "audit")}
        for symbols in batch.column(2):
            x = np.frombuffer((symbols.as_py() or "").encode(), np.uint8).astype(np.int64) - ord("A")
            initial, fault = np.divmod(x, len(FAULTS))
            cost, audit = tables().cheapest(np.where(fault > 1, DELETED, 2 * initial + fault))
            counts = np.bincount(fault, minlength=4)
            for c, v in zip(out, (int(counts[2]), int(counts[3]), int(counts[1]), int((~legal[initial[:-1], initial[1:]]).sum()), cost, audit), strict=True):
                out[c].append(v)
        kinds = [pa.int64()] * 5 + [pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=["conv", "gaps", *out])


def _turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    space = F.lit(" ")
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"))


def audited(rows: DataFrame, conversations: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: its id, gaps, blank, duplicate, truncated, illegal, cost (long) and audit, the edits' initials.

    A turn's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier), truncated (it does not end with a stop, question or exclamation mark). gaps are
    the numbers missing between the least and the largest turn; illegal are neighbours whose initials are not su, ua or au. Blank turns and duplicates must be deleted.

    Turns go by turn (nulls first), then role and text. A null role or text is one space; a null id is a conversation of its own. Repeated rows are turns of their own, and
    duplicates but the first. ``conversations`` has ids of which those without turns get zeros and an empty audit. Other columns are not read; texts may have any length; an empty
    table gives no rows.
    """
    scratch = Scratch(rows.sparkSession, "repair")
    turns = _turns(rows, conv_col, turn_col, role_col, text_col)
    bare = F.rtrim("text", F.lit(WHITE))
    fault = F.when(bare == "", 2).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    order = ("conv", "turn", "role", "text")
    marks = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", F.monotonically_increasing_id().alias("at"), kind.alias("kind"), fault.alias("fault"), said.alias("said"))
    marks = scratch.table(marks, "marks")
    first = marks.where("fault <> 2").groupBy("conv", "said").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("conv").alias("_conv"), F.col("said").alias("_said"), "first")
    both = marks.join(first, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("said") == F.col("_said")), "left")
    fault = F.when((F.col("fault") != 2) & (F.col("at") > F.col("first")), 3).otherwise(F.col("fault"))
    symbol = F.char(ord("A") + F.col("kind") * len(FAULTS) + fault)

    def joined(c: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x[c]), "").alias("symbols")

    chunks = both.select("conv", "at", symbol.alias("symbol")).groupBy("conv", F.shiftright("at", CHUNK_BITS).alias("chunk")).agg(joined("symbol")).withColumnRenamed("chunk", "at")
    symbols = chunks.groupBy("conv").agg(joined("symbols")).select("conv", "symbols", F.lit(None).cast("long").alias("gaps"))
    numbers = marks.where("turn is not null").groupBy("conv", "turn").agg(F.count("*").alias("n")).groupBy("conv")
    gaps = numbers.agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps")).select("conv", F.lit(None).cast("string").alias("symbols"), "gaps")
    parts = symbols.unionByName(gaps)
    if conversations is not None:
        parts = parts.unionByName(conversations.select(F.col(conv_col).alias("conv"), F.lit(None).cast("string").alias("symbols"), F.lit(None).cast("long").alias("gaps")))
    whole = parts.groupBy("conv").agg(F.coalesce(F.max("gaps"), F.lit(0)).alias("gaps"), F.max("symbols").alias("symbols"))
    conv = rows.schema[conv_col].dataType.simpleString()
    found = whole.mapInArrow(_audit, f"conv {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    found = scratch.table(found.withColumnRenamed("conv", conv_col), "found")
    scratch.drop("marks")
    return found


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns, each conversation after its audit; a position of 0 stands for an insertion that is still to come at a conversation's end."""
    audit, at, q, place, conv = "", 0, 0, 0, None
    out: list[list] = [[], [], [], []]

    def put(role: str, text: str) -> None:
        nonlocal place
        place += 1
        for x, y in zip(out, (conv, place, role, text), strict=True):
            x.append(y)

    def insert() -> None:
        nonlocal at, q
        while at < len(audit) and audit[at] == "I":
            put(NEW[q], "")
            q, at = AFTER_NEW[q], at + 1

    def flush(kind: pa.DataType) -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (kind, pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv", "place", "role", "text"])
        for x in out:
            x.clear()
        return done

    kind = pa.null()
    for batch in batches:
        kind = batch.schema.field(0).type
        for key, told, role, text in zip(*(batch.column(i) for i in range(4)), strict=True):
            if told.is_valid:
                insert()
                audit, at, q, place, conv = told.as_py(), 0, 0, 0, key.as_py()
                continue
            insert()
            edit, at = audit[at], at + 1
            if edit == "K":
                role = role.as_py()
                put(role, text.as_py())
                q = NEXT[q][role[:1]]
            elif edit == "R":
                put(NEW[q], text.as_py())
                q = AFTER_NEW[q]
        yield flush(kind)
    insert()
    if out[0]:
        yield flush(kind)


def repaired(rows: DataFrame, audits: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns after the edits in ``audits`` (of ``audited`` for the same rows): id, place (from 1), role, text.

    A conversation's turns are adjacent and in order in one partition, streamed through it. Nulls, ties and repeated rows as in ``audited``.
    """
    none = F.lit(None).cast("string")
    told = audits.select(F.col(conv_col).alias("conv"), F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text"), "audit")
    both = _turns(rows, conv_col, turn_col, role_col, text_col).withColumn("audit", none).unionByName(told).withColumn("is_turn", F.col("audit").isNull())
    dealt = both.repartition("conv").sortWithinPartitions("conv", "is_turn", "turn", "role", "text").select("conv", "audit", "role", "text")
    made = dealt.mapInArrow(_repaired, f"conv {rows.schema[conv_col].dataType.simpleString()}, place long, role string, text string")
    return made.withColumnRenamed("conv", conv_col)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, hashed, kind = None, None, pa.null()
    for batch in batches:
        kind, done = batch.schema.field(0).type, []
        for key, place, role, text in zip(*(batch.column(i) for i in range(4)), strict=True):
            line = f"{role.as_py()}:{text.as_py()}".encode()
            if place.as_py() == 1:
                if hashed:
                    done.append((conv, hashed.hexdigest()))
                conv, hashed = key.as_py(), hashlib.sha256(line)
            else:
                hashed.update(b"\n" + line)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], kind), pa.array([x[1] for x in done], pa.string())], names=["conv", "sha256"])
    if hashed:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([hashed.hexdigest()], pa.string())], names=["conv", "sha256"])


def digests(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """id and sha256 of ``role:text`` lines of each conversation in what ``repaired`` gives; SHA-256 is sequential, so it is streamed in that order without another shuffle."""
    kind = turns.schema[conv_col].dataType.simpleString()
    return turns.select(conv_col, "place", "role", "text").mapInArrow(_digests, f"conv {kind}, sha256 string").withColumnRenamed("conv", conv_col)
