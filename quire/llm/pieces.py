"""SentencePiece encoding and decoding by a table over prefixes (operator 13).

A merging tokenizer joins, again and again, the adjacent pair whose joined piece has the best score (the leftmost of equals). No merge
crosses an end of a piece of the result, so what stands before such an end is merged as it would be alone: the result for a prefix of a text
is the result for a shorter prefix and one last piece. And a row of pieces is a result if each two neighbours merge to just
themselves, as a first merge across an end would be seen by that pair alone. So one piece ends each prefix, and it is the only one among
the pieces that match there (an automaton finds them) which is compatible with the last piece of the prefix before it. The table of
these last pieces takes time in proportion to the text; ids are read off it from the end.

A text is cut where no piece of the vocabulary can span: all pairs are compatible there, so tables of the stretches are the table of the text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tokencount import PieceCounter

#: Stretches of at most KEPT_CHARS characters that a worker remembers, and pairs with their tests: bounds on memory (some 100 MB), not on results.
KEPT, KEPT_CHARS, PAIRS = 400_000, 48, 400_000
#: Ids in an outgoing batch, unless one text has more.
FLUSH = 1_000_000
#: Rows that are decoded at once.
DECODED = 1000
SPACE = "▁"


class Vocabulary:
    """Pieces of a sentencepiece model that merges pairs, falls back to bytes, puts a space first and changes no character."""

    def __init__(self, model: bytes) -> None:
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        kinds = range(library.get_piece_size())
        self.names = [library.id_to_piece(i) for i in kinds]
        self.silent = {i for i in kinds if library.is_control(i)}
        self.unknown = library.unk_id()
        self.byte_ids = {int(self.names[i][1:-1], 16): i for i in kinds if library.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        plain = [i for i in kinds if i not in self.silent and i != self.unknown and i not in self.byte_of]
        self.ids = {self.names[i]: i for i in plain}
        self.ranks = {self.names[i]: -library.get_score(i) for i in plain}
        if len(self.byte_ids) != 256 or any(map(library.is_unused, kinds)) or library.encode("  x", out_type=str)[0][:1] != SPACE:
            raise ValueError("the model must fall back to bytes, have no unused pieces and keep white space")
        self.split = PieceCounter(model).split
        self.automaton = ahocorasick.Automaton()
        self.size, self.lengths = len(self.names), [len(x) for x in self.names]
        for piece, i in self.ids.items():
            # pieces that merging never makes can't end a prefix
            if len(piece) == 1 or self.merge(piece) == [piece]:
                self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.characters = {x for x in self.ids if len(x) == 1}
        self.pairs: dict[int, bool] = {}
        #: Ids of stretches, the newer and the older half.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """The pieces of a short string by merging pairs as they are defined."""
        parts, rank, never = list(text), self.ranks.get, float("inf")
        while len(parts) > 1:
            ranks = [rank(a + b, never) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == never:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def name(self, piece: int) -> str:
        """A piece's string; a character that no piece is goes by its code point below zero."""
        return self.names[piece] if piece >= 0 else chr(~piece)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves these two neighbours as they are."""
        a, b = self.name(left), self.name(right)
        return self.merge(a + b) == [a, b]

    def last_pieces(self, text: str) -> list[int]:
        """For each prefix of 1, 2, ... characters the last piece of its encoding."""
        last: list = [None] * len(text)
        if not self.characters.issuperset(text):
            last = [None if x in self.characters else ~ord(x) for x in text]
        pairs, lengths, size = self.pairs, self.lengths, self.size
        done = -1
        for end, piece in self.automaton.iter(text):
            if end == done:
                continue
            before = end - lengths[piece]
            if before >= 0:
                left = last[before]
                pair = left * size + piece
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    fits = pairs[pair] = self.compatible(left, piece)
                if not fits:
                    continue
            last[end], done = piece, end
        return last

    def stretch(self, text: str) -> bytes:
        """The ids of a stretch without cuts, as 32-bit integers, read off the table from the end."""
        last, at, out, lengths = self.last_pieces(text), len(text) - 1, [], self.lengths
        while at >= 0:
            piece = last[at]
            if piece >= 0:
                out.append(piece)
                at -= lengths[piece]
            else:
                out.extend(self.byte_ids[b] for b in reversed(chr(~piece).encode()))
                at -= 1
        out.reverse()
        return array("i", out).tobytes()

    def encode(self, text: str) -> np.ndarray:
        parts = self.split(text)
        out = list(map(self.known.get, parts))
        if None in out:
            out = [self.remembered(x) if y is None else y for x, y in zip(parts, out, strict=True)]
        return np.frombuffer(b"".join(out), np.int32)

    def remembered(self, part: str) -> bytes:
        found = self.known.get(part) or self.older.get(part)
        if found is None:
            found = self.stretch(part.replace(" ", SPACE))
        if len(part) <= KEPT_CHARS:
            if len(self.known) >= KEPT // 2:
                self.known, self.older = {}, self.known
            self.known[part] = found
        return found

    @cached_property
    def texts(self) -> list[str]:
        """What each id stands for; bytes of longer characters are characters from U+D880 on, which no text has."""
        plain = ["" if i in self.silent else " ⁇ " if i == self.unknown else x.replace(SPACE, " ") for i, x in enumerate(self.names)]
        for i, b in self.byte_of.items():
            plain[i] = chr(b if b < 128 else 0xD800 + b)
        return plain

    @cached_property
    def simple(self) -> tuple[pa.Array, np.ndarray]:
        """Texts of ids, and which ids stand for them wherever they are."""
        odd = [i in self.silent or i == self.unknown or self.byte_of.get(i, 0) > 127 for i in range(self.size)]
        return pa.array(["" if x else y for x, y in zip(odd, self.texts, strict=True)]), ~np.array(odd)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: without the space that encoding puts first; a byte that belongs to no whole character is U+FFFD."""
        out = "".join(map(self.texts.__getitem__, ids))
        first = next((i for i in ids if i not in self.silent), None)
        if out[:1] == " " and first != self.unknown and first not in self.byte_of:
            out = out[1:]
        if not BYTES.search(out):
            return out
        return BYTES.sub(lambda m: _characters(bytes(ord(x) - 0xD800 for x in m[0])), out)

    def decoded(self, rows: pa.ListArray) -> pa.Array:
        """Texts of many rows: joined by columns where all ids are simple, else one by one."""
        flat, ends = rows.flatten(), np.concatenate([[0], np.cumsum(np.nan_to_num(pc.list_value_length(rows).to_numpy(zero_copy_only=False)).astype(np.int64))])
        texts, simple = self.simple
        if flat.null_count or rows.null_count:
            return pa.array([None if x is None else self.decode([i for i in x if i is not None]) for x in rows.to_pylist()], pa.string())
        ids = flat.to_numpy()
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is not in the vocabulary")
        odd = np.concatenate([[0], np.cumsum(~simple[ids])])
        parts = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), texts.take(pa.array(ids)))
        found = pc.binary_join(parts, "")
        started = np.zeros(len(rows), bool)
        full = ends[:-1] < ends[1:]
        started[full] = np.array([x[:1] == SPACE for x in self.names])[ids[ends[:-1][full]]]
        found = pc.if_else(pa.array(started), pc.utf8_slice_codeunits(found, 1), found)
        slow = np.flatnonzero(odd[ends[1:]] > odd[ends[:-1]])
        if len(slow):
            own = pa.array([self.decode(ids[ends[i] : ends[i + 1]].tolist()) for i in slow], pa.string())
            found = pc.replace_with_mask(found, pa.array(odd[ends[1:]] > odd[ends[:-1]]), own)
        return found


BYTES = re.compile("[\ud880-\ud8ff]+")


def _characters(found: bytes) -> str:
    out = []
    while found:
        try:
            out.append(found.decode())
            break
        except UnicodeDecodeError as e:
            out.append(found[: e.start].decode() + "�")
            found = found[e.start + 1 :]
    return "".join(out)


@lru_cache(2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def _encode(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(model).encode
        for batch in batches:
            texts, start, held, found = batch.column(batch.num_columns - 1), 0, 0, []
            for at, text in enumerate(texts, 1):
                found.append(encode(text.as_py() or ""))
                held += len(found[-1])
                if at == len(texts) or held > FLUSH:
                    offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                    yield pa.RecordBatch.from_arrays([*(x.slice(start, at - start) for x in batch.columns[:-1]), ids], names=[*batch.schema.names[:-1], "ids"])
                    start, held, found = at, 0, []

    return run


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ids (array of int), as the library encodes the whole text, without begin and end.

    A null or empty text has no ids. Repeated or null ids of rows keep a row each; other columns are not read. Texts of any length are encoded
    whole, in memory in proportion to the longest stretch without a cut. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_quire_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_encode(open(model_path, "rb").read()), f"`{id_col}` {kind}, ids array<int>")


def _decode(model: bytes, at: int, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            for start in range(0, batch.num_rows, DECODED):
                part = batch.slice(start, DECODED)
                yield pa.RecordBatch.from_arrays([*part.columns, v.decoded(part.column(at))], names=[*part.schema.names, out])

    return run


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns and ``out``, the text that the library decodes from the ids; an older column of that name is replaced.

    Null ids give a null text, no ids an empty one; null elements are left out. An id outside of the vocabulary is an error.
    """
    rows = rows.drop(out) if out in rows.columns and out != ids_col else rows
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{out}` string"])
    return rows.mapInArrow(_decode(open(model_path, "rb").read(), rows.columns.index(ids_col), out), schema)
