"""Personal data by patterns and a semi-Markov conditional random field (operator 6).

Base spans come from fixed patterns. The field then looks at the stretches of a text around digits and at signs: a candidate segment
is a run of up to eight successive tokens there, features describe the whole segment (its shape, counts, check sum, the
word before it), and dynamic programming over segment ends chooses boundaries and kinds together. Weights are fitted by gradient
steps on the conditional log-likelihood, with the base spans (also without their marks, such as a plus sign) and quoted keys
after words like "token" of a bounded sample as labels, and numbers that fail the checks of their kind as counter-examples. Spans of the field that touch no base span are added to the base.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.scratch import Scratch

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: Most tokens in a segment; rows that the field is fitted on, at most about, and stretches of them; steps through them.
LONGEST, SAMPLE, STRETCHES, EPOCHS = 8, 4000, 500, 4
#: In training: stretches of a row, and characters of a stretch.
STRETCHES_OF_TEXT, LONGEST_STRETCH = 20, 400

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_dotted = re.compile(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]+")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_marks = re.compile(r"[0-9@]+|[\[(](?:at|dot)[\])]")
_token = re.compile(r"\S+")
_key = re.compile(r"(?:token|key|secret|password)\s*[=:]\s*[\"']?([A-Za-z0-9_/+-]{16,})", re.I)
_digit = re.compile("[0-9]")
_long_number = re.compile(r"(?:[0-9][ ().-]?){9}")
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) by the fixed patterns: leftmost, not overlapping within a kind; failing matches go, without retries.

    Each search takes time in proportion to the text: runs are widened to the left from their mark, not tried from each start.
    """
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _local:
            start -= 1
        if start < at and (m := _domain.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    end = 0
    while m := _dotted.search(text, end):
        start = m.start()
        while start > end and "0" <= text[start - 1] <= "9":
            start -= 1
        if all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in text[start : m.end()].split(".")):
            out.append((start, m.end(), "ip"))
        end = m.end()
    for m in _card.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    at = text.find("+")
    while at >= 0 and (m := _phone.search(text, at)):
        if 9 <= len(_digit.findall(m[0])) <= 15:
            out.append((*m.span(), "phone"))
        at = text.find("+", m.end())
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """Tokens, as (start, end), near digits and at signs; a stretch goes on while at most one other token lies between."""
    out: list[list[tuple[int, int]]] = []
    done = 0
    for m in _marks.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        token = _token.match(text, start)
        gap = text[done:start].split() if out and start - done < 40 else ["", ""]
        if len(gap) <= 1:
            if gap:
                k = text.index(gap[0], done)
                out[-1].append((k, k + len(gap[0])))
            out[-1].append(token.span())
        else:
            out.append([token.span()])
        done = token.end()
    for tokens in out:  # cues stand before the first token
        before = text[max(0, tokens[0][0] - 60) : tokens[0][0]]
        words = [x.span() for x in _token.finditer(before)][-1:]
        tokens[:0] = [(tokens[0][0] - len(before) + a, tokens[0][0] - len(before) + b) for a, b in words]
    return out


_strip_left, _strip_right = "\"'([{<*#$%&|,;:=", "\"')]}>*#$%&|,;:.!?="


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The segment without outer quotes, brackets and stops; an opening bracket stays if it is closed inside."""
    while start < end and text[start] in _strip_left and not (text[start] == "(" and ")" in text[start:end]):
        start += 1
    while end > start and text[end - 1] in _strip_right and not (text[end - 1] == ")" and "(" in text[start : end - 1]):
        end -= 1
    return start, end


_cues = {"token": "key", "key": "key", "secret": "key", "password": "key", "tel": "tel", "phone": "tel", "call": "tel", "mail": "mail", "email": "mail", "card": "card", "ip": "ip"}


def features(text: str, start: int, end: int, n_tokens: int) -> list[str]:
    """Of a whole segment."""
    part = text[start:end]
    n = len(part)
    if not n:
        return ["empty"]
    digits = sum(map(part.count, "0123456789"))
    letters = sum(map(str.isalpha, part))
    cue = re.findall(r"[A-Za-z]+", text[max(0, start - 20) : start])[-1:]
    rest = n - digits - letters
    out = [
        "bias", f"tokens {n_tokens}", f"digits {min(digits, 20)}", f"share {10 * digits // n}", f"letters {min(letters, 3)}", f"at {min(part.count('@'), 2)}",
        f"dots {min(part.count('.'), 4)}", f"cue {_cues.get(cue[0].lower()) if cue else None}", f"plus {part[0] == '+'}", f"open {part[0] == '('}",
        f"length {min(n // 4, 12)}", f"other {min(rest, 8)}",
    ]
    if not letters and 12 <= digits <= 19 and not part.strip("0123456789 -"):
        out.append(f"luhn {luhn(re.sub('[^0-9]', '', part))}")
    if not letters and 9 <= digits <= 15 and not part.strip("0123456789 ().+-"):
        out.append("phone signs" + (" grouped" if rest else ""))
    if re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", part):
        out.append(f"quad {all(int(x) < 256 for x in part.split('.'))}")
    if re.fullmatch(r"[\w.%+-]+(?:@|\s*[\[(]at[\])]\s*)[\w-]+(?:(?:\.|\s*[\[(]dot[\])]\s*)[\w-]+)+", part):
        out.append("address")
    if n >= 16 and digits and letters and re.fullmatch(r"[\w/+-]+", part):
        out.append("mixed run" + (" long" if n >= 32 else ""))
    return out


class Field:
    """The semi-Markov field: weights of (kind, feature); other tokens are segments of one token without a kind."""

    def __init__(self, weights: dict[str, list[float]] | None = None) -> None:
        self.weights = weights or {}

    def segments(self, text: str, tokens: list[tuple[int, int]]) -> list[list[tuple[int, tuple[int, int], list[str]]]]:
        """For each end: (first token, span, features) of the candidates."""
        out = []
        for j in range(len(tokens)):
            ends = []
            for i in range(max(0, j - LONGEST + 1), j + 1):
                span = trimmed(text, tokens[i][0], tokens[j][1])
                if _marks.search(text, *span):
                    ends.append((i, span, features(text, *span, j - i + 1)))
            out.append(ends)
        return out

    def scores(self, found: list[str]) -> list[float]:
        rows = [w for x in found if (w := self.weights.get(x))]
        return list(map(sum, zip(*rows, strict=True))) if rows else [0.0] * len(KINDS)

    def decode(self, text: str, tokens: list[tuple[int, int]]) -> list[Span]:
        """The best segmentation's spans with a kind."""
        best, back = [0.0], [None]
        for j, ends in enumerate(self.segments(text, tokens)):
            top, how = best[j], None
            for i, span, found in ends:
                s = self.scores(found)
                k = max(range(len(KINDS)), key=s.__getitem__)
                if best[i] + s[k] > top:
                    top, how = best[i] + s[k], (i, span, KINDS[k])
            best.append(top)
            back.append(how)
        out, j = [], len(tokens)
        while j:
            if back[j]:
                i, span, kind = back[j]
                out.append((*span, kind))
                j = i
            else:
                j -= 1
        return out[::-1]

    def fit(self, examples: list[tuple[str, list[tuple[int, int]], dict[tuple[int, int], str]]], epochs: int = EPOCHS, rate: float = 0.5) -> Field:
        """Gradient steps on the log-likelihood of the labelled segmentations: observed minus expected features."""
        ready = []
        for text, tokens, gold in examples:
            ends = self.segments(text, tokens)
            ready.append((ends, {(i, j): KINDS.index(gold[span]) for j, e in enumerate(ends) for i, span, _ in e if span in gold}))
        squares: dict[str, list[float]] = {}
        for _ in range(epochs):
            for ends, gold in ready:
                n = len(ends)
                arcs = [[(i, found, self.scores(found)) for i, _, found in e] for e in ends]
                starts: list[list] = [[] for _ in range(n)]
                for j, e in enumerate(arcs):
                    for i, _, x in e:
                        starts[i].append((j, x))
                forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
                for j in range(n):
                    forward[j + 1] = _logsum([forward[j], *(forward[i] + x for i, _, s in arcs[j] for x in s)])
                for i in range(n - 1, -1, -1):
                    backward[i] = _logsum([backward[i + 1], *(backward[j + 1] + x for j, s in starts[i] for x in s)])
                step: dict[str, list[float]] = defaultdict(lambda: [0.0] * len(KINDS))
                for j in range(n):
                    for i, found, s in arcs[j]:
                        share = [-math.exp(min(0.0, forward[i] + x + backward[j + 1] - forward[n])) for x in s]
                        if (i, j) in gold:
                            share[gold[i, j]] += 1
                        if max(share) > 1e-4 or min(share) < -1e-4:
                            for f in found:
                                step[f] = [a + b for a, b in zip(step[f], share, strict=True)]
                for f, g in step.items():
                    w, q = self.weights.setdefault(f, [0.0] * len(KINDS)), squares.setdefault(f, [1.0] * len(KINDS))
                    for k, x in enumerate(g):
                        q[k] += x * x
                        w[k] += rate * x / math.sqrt(q[k])
        return self


def _logsum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(y - top) for y in x)) if top > -math.inf else top


def _changed(part: str, own: list[Span], k: int, new: str, kind: str | None) -> tuple[str, list[Span]]:
    """The part with new text in place of its k-th span, now of another kind or none; the other spans move with it."""
    a, b, _ = own[k]
    by = len(new) - (b - a)
    others = [(x + by * (x >= b), y + by * (y >= b), z) for j, (x, y, z) in enumerate(own) if j != k and (y <= a or x >= b)]
    return part[:a] + new + part[b:], sorted(others + ([(a, a + len(new), kind)] if kind else []))


def twins(part: str, own: list[Span]) -> Iterator[tuple[str, list[Span]]]:
    """For each span what looks like it: numbers that fail their check and are no personal data, phone numbers without their plus that are."""
    for k, (a, b, kind) in enumerate(own):
        if kind == "card":  # another last digit fails the check sum
            yield _changed(part, own, k, part[a : b - 1] + str((int(part[b - 1]) + 1) % 10), None)
        elif kind == "ip":
            yield _changed(part, own, k, "99" + part[a:b], None)
        elif kind == "phone":
            yield _changed(part, own, k, part[a + 1 : b], "phone")


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches with their labels as text, start:end:kind joined by commas, and whether they are hard: long numbers without a label."""
    for batch in batches:
        out: list[tuple[str, str, bool]] = []
        for text in batch.column(0).to_pylist():
            keys = [(*m.span(1), "secret") for m in _key.finditer(text)]
            keys = [x for x in keys if _digit.search(text, x[0], x[1])]
            labels = [x for x in base_spans(text) if not any(a < x[1] and x[0] < b for a, b, _ in keys)] + keys
            for tokens in stretches(text)[:STRETCHES_OF_TEXT]:
                low, high = tokens[0][0], tokens[-1][1]
                part = text[max(0, low - 20) : high]
                if high - low < LONGEST_STRETCH:
                    own = sorted((a - high + len(part), b - high + len(part), k) for a, b, k in labels if low <= a and b <= high)
                    for told, spans in ((part, own), *twins(part, own)):
                        out.append((told, ",".join(f"{a}:{b}:{k}" for a, b, k in spans), not spans and bool(_long_number.search(told))))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.bool_()))], names=["part", "labels", "hard"])


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, n_stretches: int = STRETCHES) -> Field:
    """Fit the field on a bounded sample: about ``sample`` rows chosen by a hash of the text, of each row the first 20 stretches of under 400 characters.

    Up to n_stretches / 3 of them are used for each kind that they end with, for none, and for long numbers without a label; among
    these are twins of labelled ones that fail the check sum or the range of their kind. The bounds hold for training only.
    """
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null and text <> ''")
    total = texts.count()
    share = min(1_000_000, -(-sample * 1_000_000 // max(total, 1)))
    sampled = texts.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share).mapInArrow(_examples, "part string, labels string, hard boolean")
    rows = Scratch(docs.sparkSession, "pii").table(sampled.distinct(), "stretches")
    examples = []
    for kind in [F.col("hard"), ~F.col("hard") & (F.col("labels") == ""), *(F.col("labels").endswith(k) for k in KINDS)]:
        for r in rows.where(kind).orderBy(F.xxhash64("part"), "part").limit(n_stretches // 3).collect():
            gold = {(int(a), int(b)): k for a, b, k in (x.split(":") for x in r.labels.split(",") if x)}
            examples.extend((r.part, tokens, {x: k for x, k in gold.items() if tokens[0][0] <= x[0]}) for tokens in stretches(r.part))
    examples.sort(key=lambda x: (zlib.crc32(x[0].encode()), x[0]))
    return Field().fit(examples)


def find(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), by start and kind."""
    if not text:
        return [], []
    base = base_spans(text)
    taken = sorted((a, b) for a, b, _ in base)
    extra = []
    for tokens in stretches(text):
        low, high = tokens[0][0], tokens[-1][1]
        near = [x for x in taken if x[0] < high and low < x[1]] if taken else []
        extra += [x for x in field.decode(text, tokens) if not any(a < x[1] and x[0] < b for a, b in near)]
    return base, sorted(base + extra, key=lambda x: (x[0], KINDS.index(x[2])))


_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
SPANS = "array<struct<start: bigint, end: bigint, kind: string>>"


def _found(field, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [find(x.as_py(), field.value) for x in batch.column(text_at)]
            made = [pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in x[n]] for x in both], _kind) for n in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *made], names=batch.schema.names)

    return run


def detect(docs: DataFrame, field: Field, text_col: str = "text", base_out: str = "base_spans", spans_out: str = "spans") -> DataFrame:
    """The rows of docs with two columns more: the base spans and all spans (start, end exclusive, kind; code points).

    Null and empty texts have no spans. Base spans of different kinds may overlap; spans that the field adds overlap nothing. Texts are
    searched whole, in time proportional to their length; repeated rows are searched one by one; an empty table gives no
    rows. Columns of docs with the new names are replaced.
    """
    docs = docs.drop(base_out, spans_out)
    out = docs.withColumns({base_out: F.lit(None).cast(SPANS), spans_out: F.lit(None).cast(SPANS)})
    return out.mapInArrow(_found(docs.sparkSession.sparkContext.broadcast(field), docs.columns.index(text_col)), out.schema)


def masked(text, spans):
    """Column: the text with each span replaced by its kind in angle brackets; overlapping spans count as the first of them."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def put(done, x):
        room = x["start"] >= done["at"]
        length = (x["start"] - done["at"]).cast("int")
        return F.when(
            room, F.struct(F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), length), F.lit("<"), F.upper(x["kind"]), F.lit(">")).alias("out"), x["end"].alias("at"))
        ).otherwise(F.struct(done["out"].alias("out"), F.greatest(done["at"], x["end"]).alias("at")))

    whole = F.aggregate(spans, start, put, lambda x: F.concat(x["out"], F.substring(text, (x["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
