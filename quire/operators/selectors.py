"""CSS selectors compiled to plans over the element table.

``select(els, selector)`` parses a selector on the driver and gives the elements that match. Tests on one element are columns;
combinators are joins by document and parent, or running windows over a document; :has and :not of whole selectors are semi and anti joins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.tokens import attributes
from quire.plans.scratch import Scratch
from quire.plans.shares import dealt, unsent

KEY = ["doc", "eid"]
PARSE_ERROR = "*** Selector Parse Error ***"
STATES = {"hover", "active", "focus", "visited", "link", "target", "enabled", "disabled", "checked"}


class SelectorError(ValueError):
    """The selector can't be parsed."""


@dataclass
class Simple:
    """One element's tests: (kind, name, argument)."""

    tests: list[tuple[str, str, object]] = field(default_factory=list)


def parse(selector: str) -> list[list[tuple[str, Simple]]]:
    """Groups of chains of (combinator before, tests)."""
    groups, at = [], 0
    text = selector.strip()
    if not text:
        raise SelectorError(selector)

    def balanced(i: int) -> int:
        depth = 0
        for k in range(i, len(text)):
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            if depth == 0:
                return k
        raise SelectorError(selector)

    chain: list[tuple[str, Simple]] = []
    combinator, simple = "", Simple()
    while True:
        rest = text[at:]
        if m := re.match(r"\*|[A-Za-z_][\w-]*", rest):
            if simple.tests:
                raise SelectorError(selector)
            simple.tests.append(("tag", m[0].lower(), None))
        elif m := re.match(r"([.#])([\w-]+)", rest):
            simple.tests.append(("class" if m[1] == "." else "id", m[2], None))
        elif m := re.match(r"""\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*("[^"]*"|'[^']*'|[^\]\s]+)\s*)?\]""", rest):
            simple.tests.append(("attr", m[1].lower(), (m[2], m[3].strip("\"'")) if m[2] else None))
        elif m := re.match(r":{1,2}([\w-]+)", rest):
            name, end, arg = m[1].lower(), at + m.end(), None
            if text[end : end + 1] == "(":
                close = balanced(end)
                arg, end = text[end + 1 : close].strip(), close + 1
            simple.tests.append(("pseudo", name, arg))
            at = end
            if at < len(text) and not re.match(r"[\s>+~,.#\[:]", text[at]):
                raise SelectorError(selector)
            if at < len(text):
                continue
            m = None
        elif m := re.match(r"\s*([>+~,])\s*|\s+", rest):
            if not simple.tests:
                raise SelectorError(selector)
            chain.append((combinator, simple))
            combinator, simple = m[1] or " ", Simple()
            if combinator == ",":
                groups.append(chain)
                chain, combinator = [], ""
        else:
            raise SelectorError(selector)
        at += m.end() if m else 0
        if at >= len(text):
            break
    if not simple.tests:
        raise SelectorError(selector)
    chain.append((combinator, simple))
    return [*groups, chain]


def nth(text: str) -> tuple[int, int]:
    """an+b as (a, b)."""
    text = {"odd": "2n+1", "even": "2n"}.get(text.lower().strip(), text.lower()).replace(" ", "")
    if m := re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", text):
        return int(m[1] + "1" if m[1] in ("", "+", "-") else m[1]), int(m[2] or 0)
    if re.fullmatch(r"[+-]?\d+", text):
        return 0, int(text)
    raise SelectorError(text)


def at_place(place: Column, a: int, b: int) -> Column:
    if a == 0:
        return place == b
    return ((place - b) % a == 0) & ((place - b) / a >= 0)


def needs(selector: str) -> set[str]:
    """Columns that a selector reads, besides doc, eid, tname and end_seq: attrs, lang, and places in the tree."""
    found = set()
    for combinator, simple in (step for chain in parse(selector) for step in chain):
        found |= {">": {"parent_eid"}, "+": {"parent_eid", "child_no"}, "~": {"parent_eid", "child_no"}}.get(combinator, set())
        for kind, name, arg in simple.tests:
            if kind in ("class", "id", "attr"):
                found.add("attrs")
            elif kind == "pseudo" and name in ("not", "has", "haschild"):
                found |= {"parent_eid"} | needs((arg or "").lstrip("> "))
            elif kind == "pseudo" and name.endswith(("child", "of-type")):
                place, number = ("child_no", "n_children") if name.endswith("child") else ("type_no", "n_type")
                found |= {"parent_eid", place} | ({number} if "last" in name or name.startswith("only") else set())
            elif kind == "pseudo":
                found |= {"lang": {"lang"}, "empty": {"parent_eid"}, "root": {"parent_eid"}}.get(name, set())
    return found


def _windows(els: DataFrame, wanted: set[str] | None = None) -> DataFrame:
    parent, same = Window.partitionBy("doc", "parent_eid"), Window.partitionBy("doc", "parent_eid", "tname")
    made = {"attrs": attributes("tok"), "n_children": F.count("*").over(parent), "n_type": F.count("*").over(same)}
    return els.withColumns({n: c for n, c in made.items() if wanted is None or n in wanted})


def prepared(els: DataFrame, write: bool = False, selector: str | None = None) -> DataFrame:
    """Elements with what the tests of one element need; made once and reused for many selectors.

    write: as a table in the shared folder, for selectors that hold elements against each other or for many selectors. selector: with the columns that this one needs only,
    so that windows for others aren't made.
    """
    wanted = None if selector is None else needs(selector)
    ready = _windows(els, wanted)
    if wanted is not None:
        ready = ready.select(*KEY, "tname", "end_seq", *sorted(wanted))
    return Scratch(els.sparkSession, "elements").table(ready, "elements") if write else ready


def _test(els: DataFrame, kind: str, name: str, arg, texts: DataFrame | None) -> DataFrame:
    value = F.try_element_at("attrs", F.lit(name))
    classes = F.split(F.coalesce(F.try_element_at("attrs", F.lit("class")), F.lit("")), r"\s+")
    if kind == "tag":
        return els if name == "*" else els.where(F.col("tname") == name)
    if kind == "class":
        return els.where(F.array_contains(classes, name))
    if kind == "id":
        return els.where(F.try_element_at("attrs", F.lit("id")) == name)
    if kind == "attr":
        if arg is None:
            return els.where(value.isNotNull())
        op, x = arg
        tests = {
            "=": value == x, "~=": F.array_contains(F.split(value, r"\s+"), x), "|=": (value == x) | F.startswith(value, F.lit(x + "-")),
            "^=": F.startswith(value, F.lit(x)), "$=": F.endswith(value, F.lit(x)), "*=": F.contains(value, F.lit(x)),
        }
        return els.where(tests[op] & (F.lit(x) != "")) if op in ("^=", "$=", "*=") else els.where(tests[op])
    last, last_type = F.col("n_children") - F.col("child_no") + 1, F.col("n_type") - F.col("type_no") + 1
    simple = {
        "first-child": F.col("child_no") == 1, "last-child": last == 1, "first-of-type": F.col("type_no") == 1, "last-of-type": last_type == 1,
        "only-child": F.col("n_children") == 1, "only-of-type": F.col("n_type") == 1, "root": F.col("parent_eid").isNull(),
    }
    places = {"nth-child": F.col("child_no"), "nth-last-child": last, "nth-of-type": F.col("type_no"), "nth-last-of-type": last_type}
    if name in simple:
        return els.where(simple[name])
    if name in places and arg:
        return els.where(at_place(places[name], *nth(arg)))
    if name in STATES:
        return els
    if name == "empty":
        filled = texts.where("length(text) > 0").select("doc", "eid")
        children = els.select("doc", F.col("parent_eid").alias("eid")).where("eid is not null")
        raise_if(texts)
        return els.join(filled.unionByName(children).distinct(), KEY, "left_anti")
    if name == "lang" and arg:
        return els.where((F.col("lang") == arg.lower()) | F.startswith("lang", F.lit(arg.lower() + "-")))
    if name in ("contains", "containsown") and arg is not None:
        raise_if(texts)
        own = "own_text" if name == "containsown" else "text"
        return _held(els, texts.where(F.contains(own, F.lit(arg.strip("\"'")))), "left_semi")
    raise SelectorError(f":{name}")


def raise_if(texts: DataFrame | None) -> None:
    if texts is None:
        raise SelectorError("this selector needs the elements' texts")


def select(els: DataFrame, selector: str, texts: DataFrame | None = None) -> DataFrame:
    """The elements (doc, eid, tname and the other columns of ``prepared``) that match, each once.

    texts: (doc, eid, text, own_text) for :empty, :contains and :containsown. A selector that can't be parsed raises SelectorError.
    """
    out = None
    for chain in parse(selector):
        found = None
        for combinator, simple in chain:
            now = els
            for kind, name, arg in simple.tests:
                if kind == "pseudo" and name in ("not", "has", "haschild"):
                    now = _related(els, now, name, arg or "", texts)
                elif kind == "pseudo" and name == "empty":
                    raise_if(texts)
                    filled = texts.where("length(text) > 0").select(*KEY)
                    parents = els.select("doc", F.col("parent_eid").alias("eid")).where("eid is not null")
                    now = _held(now, unsent(filled.unionByName(parents)), "left_anti")
                else:
                    now = _test(now, kind, name, arg, texts)
            found = now if found is None else _combined(found, now, combinator)
        out = found if out is None else out.unionByName(found).dropDuplicates(KEY)
    return out


def _held(els: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """els that are, or are not, among found; both in shares of the input of els, since ids pack so well that shuffled bytes say little about the memory of a sort."""
    return dealt(els, *KEY).join(dealt(found.select(*KEY), *KEY, like=els), KEY, how)


def _inside(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(doc, eid, outer): elements of inner within an element of outer, and elements of outer (outer: true) with one of inner within.

    By two running extremes in document order instead of a join of intervals: an element lies in one that began before it and ends no earlier, so
    the latest end of those that began before it tells; and likewise the earliest end of those that begin after it.
    """
    rows = inner.select("doc", "eid", "end_seq", F.lit(False).alias("outer")).unionByName(outer.select("doc", "eid", "end_seq", F.lit(True).alias("outer")))
    rows, order = dealt(rows, "doc"), Window.partitionBy("doc").orderBy("eid")
    around = F.max(F.when(F.col("outer"), F.col("end_seq"))).over(order.rangeBetween(Window.unboundedPreceding, -1))
    within = F.min(F.when(~F.col("outer"), F.col("end_seq"))).over(order.rangeBetween(1, Window.unboundedFollowing))
    found = rows.withColumns({"around": around, "within": within})
    return found.where(F.when(F.col("outer"), F.col("within") <= F.col("end_seq")).otherwise(F.col("around") >= F.col("end_seq"))).select("doc", "eid", "outer")


def _combined(left: DataFrame, right: DataFrame, combinator: str) -> DataFrame:
    if combinator == " ":
        return _held(right, _inside(right, left).where("not outer"), "left_semi")
    a = left.select(*(F.col(c).alias(n) for c, n in {"doc": "a_doc", "eid": "a_eid", "parent_eid": "a_parent", "child_no": "a_no"}.items() if c in left.columns))
    same = F.col("doc") == F.col("a_doc")
    on = {
        ">": same & (F.col("parent_eid") == F.col("a_eid")),
        "+": same & F.col("parent_eid").eqNullSafe(F.col("a_parent")) & (F.col("child_no") == F.col("a_no") + 1),
        "~": same & F.col("parent_eid").eqNullSafe(F.col("a_parent")) & (F.col("child_no") > F.col("a_no")),
    }[combinator]
    return right.join(a, on, "left_semi")


def _related(els: DataFrame, now: DataFrame, name: str, arg: str, texts: DataFrame | None) -> DataFrame:
    inner = select(els, arg.lstrip("> "), texts)
    if name == "not":
        return _held(now, inner, "left_anti")
    if name == "haschild" or arg.startswith(">"):
        return _held(now, inner.select("doc", F.col("parent_eid").alias("eid")), "left_semi")
    return _held(now, _inside(inner, now).where("outer"), "left_semi")


def selects_or_error(els: DataFrame, selector: str, texts: DataFrame | None = None) -> DataFrame:
    """(doc, eid, note): matches; or, for a selector that can't be parsed, one row that says so, as it counts as used."""
    try:
        return select(els, selector, texts).select(*KEY, F.lit("").alias("note"))
    except SelectorError:
        spark = els.sparkSession
        return spark.createDataFrame([(None, None, PARSE_ERROR)], "doc long, eid long, note string")
