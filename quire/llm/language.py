"""Language ID by segmentation-marginalised unigrams (operator 8).

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all ways to
segment it into pieces, by a forward algorithm over its characters; a text's is the product over its words. The piece
probabilities are learned by expectation maximisation on word counts of a bounded sample of labelled rows: forward-backward
gives expected piece counts as a Spark job, the driver divides them. Words are scored in batches of equal length, whole
whatever their length: where a product of so many chances could leave the range of a double, the sums are sums of logarithms.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shingles import odd_numbers
from quire.plans.scratch import Scratch

#: Labelled rows for each language that the model is fitted on, at most about; iterations.
SAMPLE, ROUNDS = 3000, 4
#: Scored words kept in a worker, for up to eight languages (fewer words for more); characters that are looked up together.
CACHE, TOGETHER = 450_000, 1 << 15
UNDETERMINED = "und"
_words = re.compile(r"[^\W\d_]+")
UNKNOWN = 1e-8
U = np.uint64
STEP = U(0x100000001B3)


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    found = _words.findall(text.lower()) if text else []
    if found and not "".join(found).isalpha():
        found = [x for run in found for x in "".join(c if c.isalpha() else " " for c in run).split()]  # numerals that count as word characters go
    return found


def piece_hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h + ord(c)) * int(STEP) % (1 << 64)
    return h


class PieceTable:
    """Pieces by a hash of their characters: a large table, and a smaller one for those whose place there is taken.

    Multipliers are tried until every piece has a place.
    """

    def __init__(self, pieces: dict[str, int]) -> None:
        hashes = np.array([piece_hash(x) for x in pieces], U)
        ids = np.fromiter(pieces.values(), np.int64, len(pieces))
        for a, b in odd_numbers(128, 3).reshape(-1, 2):
            self.multipliers, self.shifts = (a, b), (U(64 - 20), U(64 - 18))
            places = self._places(hashes)
            first = np.zeros(len(hashes), bool)
            first[np.unique(places[0], return_index=True)[1]] = True
            rest = places[1][~first]
            if len(np.unique(rest)) == len(rest):
                break
        else:
            raise ValueError("the tables are too small for this vocabulary")
        self.tables = []
        for size, chosen, at in ((1 << 20, first, places[0]), (1 << 18, ~first, places[1])):
            table = np.zeros(size, U), np.full(size, -1, np.int64)
            table[0][at[chosen]], table[1][at[chosen]] = hashes[chosen], ids[chosen]
            self.tables.append(table)

    def _places(self, h: np.ndarray) -> list[np.ndarray]:
        mixed = h ^ (h >> U(29))
        return [(mixed * m >> s).astype(np.int64) for m, s in zip(self.multipliers, self.shifts, strict=True)]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids by hashes, -1 for none."""
        (h1, i1), (h2, i2) = self.tables
        a, b = self._places(h)
        return np.where(h1[a] == h, i1[a], np.where(h2[b] == h, i2[b], -1))


@dataclass
class Model:
    """pieces: ids of the vocabulary; chances: [piece, language], then a row for an unknown letter and a row of zeros."""

    langs: list[str]
    pieces: dict[str, int]
    chances: np.ndarray

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.pieces), default=1)
        self.key = len(self.pieces), xxhash.xxh3_64_intdigest("\n".join(self.pieces))
        least = self.chances[self.chances > 0].min(initial=1.0)
        #: Characters of a word up to which no product of chances comes near the least double.
        self.safe = int(280 / max(-np.log10(least), 0.1))


    @property
    def table(self) -> PieceTable:
        """Made where it is used: it is much larger than the model and the same for all of a vocabulary."""
        if self.key not in _tables:
            _tables.clear()
            _tables[self.key] = PieceTable(self.pieces)
        return _tables[self.key]


_tables: dict[tuple[int, int], PieceTable] = {}


def vocabulary(path: str) -> dict[str, int]:
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (library.id_to_piece(i).lower() for i in range(library.get_piece_size()))
    return {x: i for i, x in enumerate(dict.fromkeys(["▁", *(x for x in found if x.lstrip("▁").isalpha() and x.rfind("▁") <= 0)]))}


def _arcs(same: list[str], model: Model, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, words, pieces): the words of equal length whose characters i to j are a piece, and which; by i, then j.

    start, stop: bounds of i. Runs of one length are looked up together for all i of a block.
    """
    n, unknown, table = len(same[0]), len(model.pieces), model.table
    stop = n if stop is None else stop
    points = np.frombuffer("".join(same).encode("utf-32-le"), np.uint32).reshape(-1, n).T.astype(U)
    block = max(1, TOGETHER // len(same))
    for low in range(start, stop, block):
        high, found = min(stop, low + block), []
        h = np.zeros((high - low, len(same)), U)
        for d in range(1, min(n - low, model.longest) + 1):
            h = (h[: n - d + 1 - low] + points[low + d - 1 : high + d - 1]) * STEP
            ids = table.find(h)
            if d == 1:
                found.append((None, np.where(ids < 0, unknown, ids), None))
            else:
                rows, cols = np.nonzero(ids >= 0)
                found.append((cols, ids[rows, cols], np.searchsorted(rows, np.arange(high - low + 1))))
        every = np.arange(len(same))
        for i in range(low, high):
            for d, (cols, ids, ends) in enumerate(found, 1):
                if ends is None:
                    yield i, i + 1, every, ids[i - low]
                elif (a := ends[i - low]) < (b := ends[i - low + 1]):
                    yield i, i + d, cols[a:b], ids[a:b]


def _by_length(found) -> dict[int, list[str]]:
    out = defaultdict(list)
    for x in found:
        out[len(x)].append("▁" + x)
    return out


def log_chances(found: list[str], model: Model) -> np.ndarray:
    """Logarithms of the words' probabilities: [word, language]."""
    at = {x: k for k, x in enumerate(found)}
    out = np.empty((len(found), len(model.langs)))
    with np.errstate(divide="ignore"):
        logs = np.log(model.chances)
    for n, same in _by_length(found).items():
        if n + 1 <= model.safe:
            forward = np.zeros((n + 2, len(same), len(model.langs)))
            forward[0] = 1
            for i, j, at_words, ids in _arcs(same, model):
                forward[j, at_words] += forward[i, at_words] * model.chances[ids]
            last = np.log(forward[-1])
        else:  # a ring of positions that arcs can still reach
            ring = np.full((model.longest + 1, len(same), len(model.langs)), -np.inf)
            ring[0], done = 0, 0
            for i, j, at_words, ids in _arcs(same, model):
                if i > done:
                    ring[done % len(ring)], done = -np.inf, i
                to = j % len(ring)
                ring[to, at_words] = np.logaddexp(ring[to, at_words], ring[i % len(ring), at_words] + logs[ids])
            last = ring[(n + 1) % len(ring)]
        out[[at[x[1:]] for x in same]] = last
    return out


def _expected_short(same: list[str], weight: np.ndarray, model: Model, lang: int) -> np.ndarray:
    """Expected counts of the pieces in words of equal length that no product can underflow."""
    arcs, p = list(_arcs(same, model)), model.chances[:, lang]
    forward, backward = np.zeros((2, len(same[0]) + 1, len(same)))
    forward[0] = backward[-1] = 1
    for i, j, at, ids in arcs:
        forward[j, at] += forward[i, at] * p[ids]
    for i, j, at, ids in reversed(arcs):
        backward[i, at] += backward[j, at] * p[ids]
    total = np.zeros(len(p))
    for i, j, at, ids in arcs:
        total += np.bincount(ids, forward[i, at] * p[ids] * backward[j, at] / forward[-1, at] * weight[at], len(total))
    return total


def _expected_long(word: str, weight: float, model: Model, lang: int, block: int = 4096) -> np.ndarray:
    """The same for one long word, in logarithms; arcs are made anew for each block of the backward pass."""
    n, log = len(word), math.log
    p = model.chances[:, lang].tolist()
    forward, backward = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    forward[0] = backward[-1] = 0.0
    for i, j, _, ids in _arcs([word], model):
        if (x := p[ids[0]]) > 0:
            forward[j] = _log_sum(forward[j], forward[i] + log(x))
    total = np.zeros(len(p))
    for low in reversed(range(0, n, block)):
        for i, j, _, ids in reversed(list(_arcs([word], model, low, min(n, low + block)))):
            if (x := p[ids[0]]) > 0:
                backward[i] = _log_sum(backward[i], backward[j] + log(x))
                total[ids[0]] += weight * math.exp(min(0.0, forward[i] + log(x) + backward[j] - forward[-1]))
    return total


def _log_sum(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def _expected(model: Model):
    """Rows (lang, word, n) to expected counts (lang, piece, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(model.chances.shape), {x: k for k, x in enumerate(model.langs)}
        for batch in batches:
            groups = defaultdict(list)
            for lang, word, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                groups[known[lang], len(word)].append(("▁" + word, n))
            for (lang, length), rows in groups.items():
                if length + 1 <= model.safe:
                    total[:, lang] += _expected_short([x for x, _ in rows], np.array([n for _, n in rows], float), model, lang)
                else:
                    total[:, lang] += sum(_expected_long(x, n, model, lang) for x, n in rows)
        pieces, langs = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([model.langs[x] for x in langs], pa.string()), pa.array(pieces), pa.array(total[pieces, langs])], names=["lang", "piece", "n"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = defaultdict(Counter)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            seen[lang].update(words(text.as_py()))
        rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])


def train(docs: DataFrame, vocabulary_path: str, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """Fit on about ``sample`` rows of each value of lang_col (all, if there are fewer), chosen by a hash of the text.

    Rows with a null language or text are not used. Without labelled rows the model knows no language.
    """
    pieces = vocabulary(vocabulary_path)
    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    start = np.full((len(pieces) + 2, len(langs)), 1 / len(pieces))
    start[-1] = 0
    model = Model(langs, pieces, start)
    if not langs:
        return model
    scratch, million = Scratch(docs.sparkSession, "language"), 1_000_000
    share = F.create_map(*(F.lit(x) for lang in langs for x in (lang, min(million, -(-sample * million // counts[lang])))))
    chosen = labelled.where(F.pmod(F.xxhash64("text"), F.lit(million)) < share[F.col("lang")])
    seen = scratch.table(chosen.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    seen = seen.repartition(tasks, "word")  # the table is small, the work on it is not
    at = {x: k for k, x in enumerate(langs)}
    for _ in range(rounds):
        total = np.full(start.shape, 0.01)
        for r in seen.mapInArrow(_expected(model), "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect():
            total[r.piece, at[r.lang]] += r.n
        chances = total / total.sum(axis=0)
        chances[-2:] = [[UNKNOWN], [0]]
        model = Model(langs, pieces, chances)
    return model


class Scorer:
    """Scores texts; keeps the words it has scored."""

    def __init__(self, model: Model) -> None:
        self.model, self.at, self.table, self.used = model, {}, np.empty((1024, len(model.langs))), 0

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [words(x) for x in texts]
        new = list(set().union(*split).difference(self.at))
        if self.used + len(new) > min(CACHE, CACHE * 8 // max(1, len(self.model.langs))):
            self.at, self.used = {}, 0
            new = list(set().union(*split))
        if new and self.model.langs:
            if self.used + len(new) > len(self.table):
                self.table = np.concatenate([self.table[: self.used], np.empty((max(len(new), len(self.table)), len(self.model.langs)))])
            self.table[self.used : self.used + len(new)] = log_chances(new, self.model)
            self.at.update(zip(new, range(self.used, self.used + len(new)), strict=True))
            self.used += len(new)
        out = []
        for found in split:
            if not found or not self.model.langs:
                out.append((UNDETERMINED, 0.0))
                continue
            total = self.table[np.fromiter(map(self.at.__getitem__, found), np.int64, len(found))].sum(axis=0)
            best = int(total.argmax())
            out.append((self.model.langs[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())))
        return out


_kept: dict[int, Scorer] = {}


def _predicted(model, key: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _kept:
            _kept.clear()
            _kept[key] = Scorer(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = _kept[key].score(part.column(text_at).to_pylist())
                columns = [*part.columns[:-2], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """The rows of docs with two columns more: the most likely language and its posterior probability (equal priors).

    ``und`` and 0 if the text is null, empty or has no letter, or if the model knows no language. Ties go to the first
    language in order. Only the text decides. Columns of docs with the new names are replaced.
    """
    sent, docs = docs.sparkSession.sparkContext.broadcast(model), docs.drop(lang_out, score_out)
    out = docs.withColumns({lang_out: F.lit(None).cast("string"), score_out: F.lit(None).cast("double")})
    key = hash(model.chances.tobytes())
    return out.mapInArrow(_predicted(sent, key, docs.columns.index(text_col)), out.schema)
