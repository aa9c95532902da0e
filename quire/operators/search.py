"""Searching and replacing with regular expressions: matches, recipes of rules, guards and reports.

Patterns are literals of the plan, never columns, so that Spark compiles each once. They are in Java's dialect; ``java_pattern`` translates
named groups and refuses what that dialect lacks. Rules of a recipe are projections one after another over each document.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

# Limits of a recursive replacement and of recipes.
MAX_ROUNDS, GROWTH, GROWTH_UNITS, MAX_UNITS, MAX_REPLACEMENTS = 32, 4, 1 << 20, 64 << 20, 100_000
RECIPE_BYTES, RECIPE_RULES, REPORT_ROWS, SNIPPET = 4 << 20, 1000, 10_000, 240
VALUE_UNITS, VARIABLE_UNITS, MAX_VARIABLES = 64 << 10, 4 << 20, 4096
SCOPES, POLICIES = ("resource", "batch", "session"), ("last", "first", "append")
VARIABLE = r"\$\{var:(\w+)\}"
REFUSED = {r"\K": r"\\K", "recursion": r"\(\?(?:R|\d+|&\w+)\)", "conditional": r"\(\?\(", "verb": r"\(\*[A-Z]"}


class PatternError(ValueError):
    """The pattern uses a construct that Java's dialect lacks."""


def java_pattern(pattern: str) -> str:
    for what, rx in REFUSED.items():
        if re.search(rx, pattern):
            raise PatternError(f"{what} is not supported: {pattern}")
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", re.sub(r"\(\?P<", "(?<", pattern))


def _found(text: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(T.col(text), F.lit(java_pattern(pattern)), F.lit(group))


def count_matches(text: Column | str, pattern: str) -> Column:
    """Non-overlapping matches that are not empty."""
    return F.size(F.filter(_found(text, pattern), lambda x: x != "")).cast("long")


def find_matches(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text", lines: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, match_no, start, end, match of each non-empty match, the line it starts in, and the columns in keep; offsets are code points.

    Texts are cut at the matches, so a match's start is the length of what stands before it, and its line the line ends there: one pass.
    For patterns that don't look around.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_t"), *keep).repartition(id_col)
    pairs = rows.select(id_col, *keep, F.posexplode(F.arrays_zip(F.split("_t", java_pattern(pattern), -1).alias("gap"), _found("_t", pattern).alias("match"))).alias("match_no", "x"))
    w = Window.partitionBy(id_col).orderBy("match_no")
    breaks = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit("\n"), F.lit("")))
    line = [(F.sum(breaks("x.gap") + breaks("x.match")).over(w) - breaks("x.match") + 1).alias("line")] if lines else []
    ends = pairs.where("x.match is not null").select(id_col, F.col("match_no").cast("long").alias("match_no"), F.col("x.match").alias("match"), F.sum(F.length("x.gap") + F.length("x.match")).over(w).alias("end"), *line, *keep)
    return ends.where("match <> ''").select(id_col, "match_no", (F.col("end") - F.length("match")).alias("start"), "end", "match", *(["line"] if lines else []), *keep)


def group_numbers(pattern: str) -> dict[str, int]:
    """Numbers of the named groups of a pattern, counting unnamed ones too."""
    out, n, in_class = {}, 0, False
    for m in re.finditer(r"\\.|\[\^?\]?|\]|\((?:(\?)(?:P?<([A-Za-z]\w*)>)?)?", pattern, re.S):
        if m[0][0] == "[":
            in_class = True
        elif m[0] == "]":
            in_class = False
        elif m[0][0] == "(" and not in_class and (not m[1] or m[2]):
            n += 1
            if m[2]:
                out[m[2]] = n
    return out


def compile_template(template: str, pattern: str, variables: dict[str, Column] | None = None):
    """A function from a match's column to its replacement.

    With variables, ${var:name} is the variable's value as plain text; without, it stays as it is.

    Understands \\0-\\9, \\g{n}, \\g{name}, \\a \\b \\f \\n \\r \\t \\v \\\\, \\x{h}, and \\l \\u (next character) and \\L \\U ... \\E; other
    escapes stay as they are.
    """
    rx, names = java_pattern(pattern), group_numbers(pattern)
    signs = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\"}
    parts: list[tuple[str, str, object]] = []  # (block case, next case, literal or group)
    block = following = ""

    def put(x: object) -> None:
        nonlocal following
        parts.append((block, following, x))
        following = ""

    for m in re.finditer(r"\\(?:g\{(\w+)\}|x\{([0-9A-Fa-f]+)\}|(.))|([^\\]+)", template, re.S):
        name, point, sign, plain = m.groups()
        if plain is not None:
            for k, x in enumerate(re.split(VARIABLE, plain) if variables is not None else [plain]):
                if k % 2:
                    put(variables[x])
                elif x:
                    put(x)
        elif point:
            put(chr(int(point, 16)))
        elif name is not None:
            put(int(name) if name.isdigit() else names.get(name, m[0]))
        elif sign.isdigit():
            put(int(sign))
        elif sign in "LU":
            block = sign
        elif sign == "E":
            block = ""
        elif sign in "lu":
            following = sign
        else:
            put(signs.get(sign, m[0]))

    def replacement(match: Column) -> Column:
        out = []
        for in_block, first, x in parts:
            c = F.regexp_extract(match, rx, x) if isinstance(x, int) else x if isinstance(x, Column) else F.lit(x)
            c = F.lower(c) if in_block == "L" else F.upper(c) if in_block == "U" else c
            if first:
                one = F.lower(F.substring(c, 1, 1)) if first == "l" else F.upper(F.substring(c, 1, 1))
                c = F.concat(one, F.substring(c, 2, 2**31 - 1))
            out.append(c)
        return F.concat(*out) if out else F.lit("")

    return replacement


def is_plain(template: str) -> bool:
    return not re.search(r"\\(?![0-9\\])|\$", template)


def replace_all(text: Column | str, pattern: str, template: str) -> Column:
    """All matches replaced. Plain templates are one regexp_replace; others put gaps and replaced matches together."""
    if is_plain(template):
        java = re.sub(r"\\([0-9])", r"$\1", template)
        return F.regexp_replace(T.col(text), java_pattern(pattern), java)
    return replace_with(text, pattern, compile_template(template, pattern))


def replace_with(text: Column | str, pattern: str, fn) -> Column:
    gaps, matches = F.split(T.col(text), java_pattern(pattern), -1), _found(text, pattern)
    return F.array_join(F.zip_with(gaps, matches, lambda g, m: F.concat(F.coalesce(g, F.lit("")), F.when(m.isNotNull(), fn(m)).otherwise(""))), "")


def changed(docs: DataFrame, pattern: str, template: str, text_col: str = "text") -> DataFrame:
    """Only the documents that a replacement changes, with the number of matches."""
    out = docs.withColumns({"n": count_matches(text_col, pattern), "_new": replace_all(text_col, pattern, template)})
    return out.where(~F.col("_new").eqNullSafe(F.col(text_col))).drop(text_col).withColumnRenamed("_new", text_col)


def presearch(docs: DataFrame, outer: str, inner: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, range_no, n: matches of a pattern inside the ranges that a first pattern finds (its group 1, if it has one)."""
    group = min(1, re.compile(re.sub(r"\+\+|\*\+|\?\+", "+", outer)).groups)
    ranges = docs.select(id_col, F.posexplode(_found(text_col, outer, group)).alias("range_no", "range"))
    return ranges.select(id_col, F.col("range_no").cast("long").alias("range_no"), count_matches("range", inner).alias("n"))


def filtered(text: Column | str, pattern: str, secondary: str, accept: bool = True) -> Column:
    """The matches in which a second pattern does (or does not) occur."""
    rx = java_pattern(secondary)
    return F.filter(_found(text, pattern), lambda m: m.rlike(rx) if accept else ~m.rlike(rx))


def recursive_replace(text: Column | str, pattern: str, template: str, rounds: int = MAX_ROUNDS) -> Column:
    """Struct (text, rounds, replacements, status): replacing until nothing matches, inside the row.

    status: ok, limit (it still matches after the last round), no_progress (a round changed nothing), growth (over four times and
    a million code points more than at first, or over 64 million), replacements (over 100,000). A failed text is the original.
    """
    first, rx = T.col(text), java_pattern(pattern)
    start = F.struct(first.alias("t"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("n"), F.lit("").alias("s"))

    def step(a: Column, _: Column) -> Column:
        new, n = replace_all(a["t"], pattern, template), a["n"] + count_matches(a["t"], pattern)
        grown = (F.length(new) > F.greatest(GROWTH * F.length(first), F.length(first) + GROWTH_UNITS)) | (F.length(new) > MAX_UNITS)
        status = F.when(new == a["t"], "no_progress").when(grown, "growth").when(n > MAX_REPLACEMENTS, "replacements").otherwise("")
        return F.when((a["s"] != "") | ~a["t"].rlike(rx), a).otherwise(F.struct(new.alias("t"), (a["k"] + 1).alias("k"), n.alias("n"), status.alias("s")))

    def finish(a: Column) -> Column:
        status = F.when(a["s"] != "", a["s"]).when(a["t"].rlike(rx), "limit").otherwise("ok")
        return F.struct(F.when(status == "ok", a["t"]).otherwise(first).alias("text"), a["k"].cast("long").alias("rounds"), a["n"].alias("replacements"), status.alias("status"))

    return F.when(first.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, finish))


@dataclass(frozen=True)
class Rule:
    """One step of a recipe; ``accept`` or ``reject``: a second pattern that a match must or must not hold; recursive: until nothing matches.

    capture: the named groups of all matches become variables, which ${var:name} in replacements of later rules reads; capture_only: nothing is
    replaced.
    """

    name: str
    find: str
    replace: str = ""
    enabled: bool = True
    recursive: bool = False
    accept: str = ""
    reject: str = ""
    capture: bool = False
    capture_only: bool = False

    def captured(self) -> dict[str, int]:
        return group_numbers(self.find) if self.capture or self.capture_only else {}

    def used(self) -> set[str]:
        return set() if self.capture_only else set(re.findall(VARIABLE, self.replace))

    def takes(self):
        """A test on a match's column."""
        second = self.accept or self.reject
        if not second:
            return lambda m: m != ""
        return (lambda m: (m != "") & m.rlike(java_pattern(second))) if self.accept else (lambda m: (m != "") & ~m.rlike(java_pattern(second)))


def checked(rules: list[Rule], scope: str = "resource", policy: str = "last") -> list[Rule]:
    """The enabled rules of a recipe that can run; others are an error."""
    out = [r for r in rules if r.enabled]
    if scope not in SCOPES or policy not in POLICIES:
        raise ValueError(f"unknown scope or policy: {scope}, {policy}")
    for r in out:
        if r.recursive and (r.captured() or r.used()):
            raise ValueError(f"{r.name}: a recursive rule can't use variables")
        if r.used() & set(r.captured()):
            raise ValueError(f"{r.name}: a rule can't read a variable that it writes, as that would depend on the order of documents")
        if r.capture_only and not r.captured():
            raise ValueError(f"{r.name}: nothing to capture")
        if not re.fullmatch(r"(?s).+", r.find):
            raise ValueError(f"{r.name}: an empty pattern")
    if len({x for r in out for x in r.captured()}) > MAX_VARIABLES:
        raise ValueError("too many variables")
    return out


def _captures(out: DataFrame, r: Rule, text_col: str, id_col: str, scope: str, policy: str) -> DataFrame:
    """out with the rule's captures in the columns _var_name (the value a reference reads) and _units (of all values so far)."""
    too_long = F.lit(False)
    for name, k in r.captured().items():
        values = F.filter(F.transform(F.filter(_found(text_col, r.find), r.takes()), lambda m, k=k: F.regexp_extract(m, java_pattern(r.find), k)) if r.accept or r.reject else _found(text_col, r.find, k), lambda x: x != "")
        out = out.withColumn("_new", values)
        total, long = F.aggregate("_new", F.lit(0).cast("long"), lambda a, x: a + F.length(x)), F.exists("_new", lambda x: F.length(x) > VALUE_UNITS)
        one = F.when(F.size("_new") > 0, F.get("_new", F.lit(0)) if policy == "first" else F.element_at("_new", -1))
        before = F.col(f"_var_{name}")
        if scope == "resource":
            out = out.withColumns({"_value": one, "_total": total, "_long": long})
        else:  # in the order of the ids; a value of its own beside many rows, so one row is sent
            place = F.when(F.size("_new") > 0, F.col(id_col))
            whole = out.agg((F.min_by if policy == "first" else F.max_by)(one, place).alias("_value"), F.coalesce(F.sum(total), F.lit(0)).alias("_total"), F.coalesce(F.bool_or(long), F.lit(False)).alias("_long"))
            out = out.crossJoin(F.broadcast(whole))
        value = F.coalesce(before, F.col("_value")) if policy == "first" else F.coalesce("_value", before)
        held = F.coalesce(F.length(value), F.lit(0)) - F.coalesce(F.length(before), F.lit(0))
        units = F.col("_units") + (F.col("_total") if policy == "append" else held)
        failed = F.when((F.col("error") == "") & (F.col("_long") | (units > VARIABLE_UNITS)), r.name).otherwise(F.col("error"))
        out = out.withColumns({f"_var_{name}": value, "_units": units, "error": failed}).drop("_new", "_value", "_total", "_long")
    return out


def _steps(docs: DataFrame, rules: list[Rule], text_col: str, id_col: str, scope: str, policy: str, variables: dict[str, str] | None):
    """(number, rule, documents before it, after it) of each enabled rule."""
    rules, given = checked(rules, scope, policy), variables or {}
    names = {x for r in rules for x in (*r.captured(), *r.used())}
    held = {x: F.col(f"_var_{x}") for x in names}
    out = docs.withColumns({"_first": F.col(text_col), "error": F.lit(""), **({"_units": F.lit(sum(map(len, given.values()))).cast("long")} if names else {}), **{f"_var_{x}": F.lit(given.get(x)).cast("string") for x in sorted(names)}})
    for k, r in enumerate(rules, 1):
        before = out
        out = out.withColumn("_was", F.col(text_col))
        if r.recursive:
            out = out.withColumn("_r", recursive_replace(text_col, r.find, r.replace))
            failed = F.when((F.col("error") == "") & (F.col("_r.status") != "ok"), r.name).otherwise(F.col("error"))
            out = out.withColumns({f"n_{k}": F.coalesce("_r.replacements", F.lit(0).cast("long")), "error": failed, text_col: F.col("_r.text")}).drop("_r")
        elif r.capture_only:
            out = out.withColumn(f"n_{k}", F.lit(0).cast("long"))
        elif r.accept or r.reject or r.used():
            take, fn = r.takes(), compile_template(r.replace, r.find, held)
            n = F.size(F.filter(_found(text_col, r.find), take)).cast("long")
            lacks = reduce(lambda a, x: a | held[x].isNull(), r.used(), F.lit(False))
            out = out.withColumn(f"n_{k}", n)
            failed = F.when((F.col("error") == "") & lacks & (F.col(f"n_{k}") > 0), r.name).otherwise(F.col("error"))
            out = out.withColumns({"error": failed, text_col: replace_with(text_col, r.find, lambda m, t=take, f=fn: F.when(t(m), f(m)).otherwise(m))})
        else:
            out = out.withColumns({f"n_{k}": count_matches(text_col, r.find), text_col: replace_all(text_col, r.find, r.replace)})
        if r.captured():
            out = _captures(out.withColumnsRenamed({text_col: "_now", "_was": text_col}), r, text_col, id_col, scope, policy).withColumnsRenamed({text_col: "_was", "_now": text_col})
        out = out.drop("_was")
        yield k, r, before, out


def run_recipe(docs: DataFrame, rules: list[Rule], text_col: str = "text", id_col: str = "doc_id", scope: str = "resource", policy: str = "last", variables: dict[str, str] | None = None) -> DataFrame:
    """docs with the text after all rules, n_1, n_2 ... (replacements of each enabled rule) and error (the first failing rule's name, or '').

    Each rule sees what earlier ones made of the document; a document with an error keeps its text. Variables: those given (of a session), and
    what rules capture, for the document alone (scope resource) or in the order of the ids for all of them (batch, session); the policy says
    which capture a reference reads: the last (also with append, which counts all values against the limits) or the first. A
    reference to a variable without a value is an error where the rule matches. The columns _var_name hold the last state.
    """
    out = docs.withColumns({"_first": F.col(text_col), "error": F.lit("")})
    for _, _, _, out in _steps(docs, rules, text_col, id_col, scope, policy, variables):  # noqa: B007
        pass
    return out.withColumn(text_col, F.when(F.col("error") == "", F.col(text_col)).otherwise(F.col("_first"))).drop("_units")


def rule_stats(run: DataFrame, rules: list[Rule]) -> DataFrame:
    """name, replacements, matched_docs of each enabled rule, from one pass."""
    names = [r.name for r in rules if r.enabled]
    one = run.agg(*(F.sum(f"n_{k}").alias(f"s_{k}") for k in range(1, len(names) + 1)), *(F.count_if(F.col(f"n_{k}") > 0).alias(f"d_{k}") for k in range(1, len(names) + 1)))
    rows = F.array(*(F.struct(F.lit(x).alias("name"), F.coalesce(F.col(f"s_{k}"), F.lit(0)).alias("replacements"), F.col(f"d_{k}").alias("matched_docs")) for k, x in enumerate(names, 1)))
    return one.select(F.inline(rows))


def committed(run: DataFrame, text_col: str = "text") -> DataFrame:
    """The changed rows without helper columns; none at all if any document failed."""
    errors = run.agg(F.count_if(F.col("error") != "").alias("n_errors"))
    return run.crossJoin(F.broadcast(errors)).where((F.col("n_errors") == 0) & ~F.col(text_col).eqNullSafe(F.col("_first"))).drop("n_errors", "_first", "error", *(c for c in run.columns if c.startswith("_var_")))


def dry_run(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text", scope: str = "resource", policy: str = "last", variables: dict[str, str] | None = None) -> DataFrame:
    """rule_no, rule, doc_id, start, line, before, after, variables of every replacement that the rules would make; nothing is written.

    One pass over the documents for each rule. Of a recursive rule the first round is shown; of a rule that only captures, what it found.
    variables: the names that the rule captures.
    """
    out = None
    for k, r, now, _ in _steps(docs, rules, text_col, id_col, scope, policy, variables):
        names = sorted(r.used())
        found = find_matches(now, r.find, id_col, text_col, lines=True, keep=tuple(f"_var_{x}" for x in names)).where(r.takes()(F.col("match")))
        new = F.col("match") if r.capture_only else compile_template(r.replace, r.find, {x: F.col(f"_var_{x}") for x in names})(F.col("match"))
        rows = found.select(F.lit(k).alias("rule_no"), F.lit(r.name).alias("rule"), id_col, "start", "line", F.substring("match", 1, SNIPPET).alias("before"), F.substring(new, 1, SNIPPET).alias("after"), F.lit(",".join(sorted(r.captured()))).alias("variables"))
        out = rows if out is None else out.unionByName(rows)
    return out


def capture_vars(docs: DataFrame, pattern: str, policy: str = "last", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the captured value of group 1 by policy: first, last, or append (joined by blanks); documents without one are left out."""
    found = F.filter(_found(text_col, pattern, 1), lambda x: x != "")
    rows = docs.select(id_col, found.alias("v")).where("size(v) > 0")
    value = {"first": F.get("v", F.lit(0)), "last": F.element_at("v", -1), "append": F.array_join("v", " ")}[policy]
    return rows.select(id_col, value.alias("value"))


def batch_var(docs: DataFrame, pattern: str, policy: str = "last", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: the value over all documents, in order of their ids."""
    own = capture_vars(docs, pattern, policy, id_col, text_col)
    return own.agg((F.min_by if policy == "first" else F.max_by)("value", id_col).alias("value"))


def report_cap(report: DataFrame, order: list[str], n: int = REPORT_ROWS) -> tuple[DataFrame, DataFrame]:
    """The first n rows of a report in an order, and a row with the number of rows and of those left out."""
    return report.orderBy(*order).limit(n), report.agg(F.count("*").alias("n_rows")).withColumn("omitted", F.greatest(F.col("n_rows") - n, F.lit(0)))


def dump_recipe(rules: list[Rule]) -> str:
    return json.dumps({"version": 1, "rules": [asdict(r) for r in rules]})


def load_recipe(text: str) -> list[Rule]:
    """Rules from versioned JSON; too large a text, too many rules, repeated names and bad patterns are errors."""
    if len(text.encode()) > RECIPE_BYTES:
        raise ValueError("recipe is too large")
    told = json.loads(text)
    if told.get("version") != 1:
        raise ValueError(f"unknown recipe version {told.get('version')}")
    rules = [Rule(**x) for x in told["rules"]]
    if len(rules) > RECIPE_RULES or len({r.name for r in rules}) < len(rules):
        raise ValueError("too many rules, or repeated names")
    for r in rules:
        java_pattern(r.find)
    checked(rules)
    return rules


RECIPE = "version int, name string, scope string, policy string, rules array<struct<name: string, find: string, replace: string, enabled: boolean, recursive: boolean, accept: string, reject: string, capture: boolean, capture_only: boolean>>"


def read_recipes(texts: DataFrame, json_col: str = "recipe") -> DataFrame:
    """texts with name, n_rules and error of the recipe in a column of JSON; error is '' for a recipe that may run.

    too large, not a recipe, version, scope or policy, too many rules, empty field, repeated name, or rule: a second pattern both to accept and to
    reject, or nothing to capture. Checks are columns, so that any number of recipes is read where it lies.
    """
    told = F.from_json(json_col, RECIPE)
    rules = F.coalesce("_r.rules", F.array().cast(RECIPE.split("rules ", 1)[1]))
    names = F.transform(rules, lambda x: x["name"])
    empty = F.exists(rules, lambda x: F.coalesce(F.length(x["name"]), F.lit(0)) * F.coalesce(F.length(x["find"]), F.lit(0)) == 0)
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    odd = F.exists(rules, lambda x: (has(x["accept"]) & has(x["reject"])) | (F.coalesce(x["capture_only"], F.lit(False)) & ~F.coalesce(x["find"].rlike(r"\(\?P?<[A-Za-z]"), F.lit(False))))
    error = (
        F.when(F.octet_length(json_col) > RECIPE_BYTES, "too large").when(F.col("_r").isNull() | F.col("_r.rules").isNull(), "not a recipe").when(~F.col("_r.version").eqNullSafe(F.lit(1)), "version")
        .when(~F.coalesce("_r.scope", F.lit("batch")).isin(*SCOPES) | ~F.coalesce("_r.policy", F.lit("last")).isin(*POLICIES), "scope or policy").when(F.size(rules) > RECIPE_RULES, "too many rules")
        .when(empty, "empty field").when(F.size(F.array_distinct(names)) < F.size(names), "repeated name").when(odd, "rule").otherwise("")
    )
    return texts.withColumn("_r", told).withColumns({"name": F.col("_r.name"), "n_rules": F.size(rules).cast("long"), "error": error}).drop("_r")


def apply_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1000) -> DataFrame:
    """docs with edits (id, start, end, text) applied, and error: overlap, range, or limit; such documents keep their text.

    Edits of a document are put in order and applied inside its row.
    """
    one = F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.col("text").alias("x"))
    lists = edits.groupBy(id_col).agg(F.array_sort(F.collect_list(one)).alias("_edits"))
    rows = docs.join(lists, id_col, "left")
    overlap = F.exists(F.transform("_edits", lambda x, i: (i > 0) & (F.get("_edits", i - 1)["e"] > x["s"])), lambda b: F.coalesce(b, F.lit(False)))
    outside = F.exists("_edits", lambda x: (x["s"] < 0) | (x["e"] < x["s"]) | (x["e"] > F.length(text_col)))
    error = F.when(F.col("_edits").isNull(), "").when(F.size("_edits") > limit, "limit").when(outside, "range").when(overlap, "overlap").otherwise("")
    checked = rows.withColumn("error", error)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    put = lambda a, x: F.struct(F.concat(a["out"], F.substring(F.col(text_col), (a["at"] + 1).cast("int"), (x["s"] - a["at"]).cast("int")), x["x"]).alias("out"), x["e"].cast("long").alias("at"))
    done = F.aggregate("_edits", start, put, lambda a: F.concat(a["out"], F.substring(F.col(text_col), (a["at"] + 1).cast("int"), F.length(text_col))))
    return checked.withColumn(text_col, F.when((F.col("error") == "") & F.col("_edits").isNotNull(), done).otherwise(F.col(text_col))).drop("_edits")


def function_replace(docs: DataFrame, pattern: str, fn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replace each match by fn(match, number), a plain Python function; number runs over all documents in order of their ids.

    An exception keeps the match. Arrow batches; the documents' base numbers come from a sum over blocks of ids and one within them.
    """
    compiled = re.compile(pattern)
    numbered = docs.join(match_base(docs, pattern, id_col, text_col), id_col)

    @F.pandas_udf("string")
    def run(texts: pd.Series, bases: pd.Series) -> pd.Series:
        def one(text, base):
            n = iter(range(base + 1, 2**62))

            def safe(m):
                k = next(n)
                try:
                    return fn(m[0], k)
                except Exception:  # noqa: BLE001 - a failing function keeps the match, as documented
                    return m[0]

            return compiled.sub(safe, text) if text is not None else None

        return pd.Series([one(a, b) for a, b in zip(texts, bases, strict=True)])

    return numbered.withColumn(text_col, run(F.col(text_col), F.col("base"))).drop("base", "n_matches")


def match_base(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text", block: int = 1000) -> DataFrame:
    """id, n_matches, base: matches in all documents of smaller ids. Windows go over blocks of ids, then over the blocks' sums."""
    counts = docs.select(id_col, count_matches(text_col, pattern).alias("n_matches")).withColumn("_b", F.floor(F.col(id_col) / block))
    sums = counts.groupBy("_b").agg(F.sum("n_matches").alias("s")).withColumn("_c", F.floor(F.col("_b") / block))
    tops = sums.groupBy("_c").agg(F.sum("s").alias("s"))
    before = lambda *p: Window.partitionBy(*p).rowsBetween(Window.unboundedPreceding, -1)
    top = tops.select("_c", F.coalesce(F.sum("s").over(before(F.lit(1)).orderBy("_c")), F.lit(0)).alias("top"))  # one row for a million ids
    mid = sums.select("_b", "_c", F.coalesce(F.sum("s").over(before("_c").orderBy("_b")), F.lit(0)).alias("mid")).join(top, "_c").select("_b", (F.col("mid") + F.col("top")).alias("mid"))
    own = counts.withColumn("own", F.coalesce(F.sum("n_matches").over(before("_b").orderBy(id_col)), F.lit(0)))
    return own.join(mid, "_b").select(id_col, "n_matches", (F.col("own") + F.col("mid")).alias("base"))
