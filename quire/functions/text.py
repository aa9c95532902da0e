"""Scalar functions on texts, paths and links, all as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stay small in titles, and the characters escaped in markup.
SMALL_WORDS = "a an and as at but by en for if in of on or the to v v. via vs vs.".split()
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def capitalize(c: Column | str) -> Column:
    return F.concat(F.upper(F.substring(col(c), 1, 1)), F.lower(F.substring(col(c), 2, 2**31 - 1)))


def swapcase(c: Column | str) -> Column:
    """Upper and lower case exchanged, character by character."""
    return F.array_join(F.transform(F.split(col(c), ""), lambda x: F.when(F.upper(x) == x, F.lower(x)).otherwise(F.upper(x))), "")


def title_case(c: Column | str) -> Column:
    """Words capitalised; small words stay small but for the first; initials such as A.B. and words with inner capitals are left."""

    def word(x: Column, i: Column) -> Column:
        small = F.lower(x).isin(SMALL_WORDS) & (i > 0)
        keep = x.rlike(r"^[A-Z]\.(?:[A-Z]\.)*$") | x.rlike(r"^\S+[A-Z]")
        second = x.rlike(r"^[Oo]['’]\p{L}")
        return F.when(small, F.lower(x)).when(keep, x).when(second, F.concat(F.upper(F.substring(x, 1, 3)), F.substring(x, 4, 2**31 - 1))).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 2**31 - 1)))

    return F.array_join(F.transform(F.split(col(c), " "), word), " ")


def html_escape(c: Column | str) -> Column:
    out = col(c)
    for a, b in ESCAPES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def entity_encode(c: Column | str, names: dict[str, str]) -> Column:
    """Chosen characters as named entities: {'é': 'eacute'}."""
    out = col(c)
    for a, b in names.items():
        out = F.replace(out, F.lit(a), F.lit(f"&{b};"))
    return out


def url_encode(c: Column | str) -> Column:
    """Percent-encode the UTF-8 bytes of everything but ASCII letters, digits, _.-/~ and characters beyond U+009F."""

    def char(x: Column) -> Column:
        return F.when(x.rlike(r"^[A-Za-z0-9_.\-/~]$") | (F.ascii(x) > 159), x).otherwise(F.regexp_replace(F.hex(F.encode(x, "UTF-8")), "(..)", "%$1"))

    return F.array_join(F.transform(F.split(col(c), ""), char), "")


def url_decode(c: Column | str) -> Column:
    """Percent-decode; a plus stays a plus; what can't be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(col(c), F.lit("+"), F.lit("%2B"))), col(c))


def normal_path(c: Column | str) -> Column:
    """Drop '.' and resolve '..' segments, as far as there are any to drop."""
    empty = F.array().cast("array<string>")

    def step(out: Column, x: Column) -> Column:
        return F.when((x == ".") | (x == ""), out).when(x == "..", F.when(F.size(out) > 1, F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))).otherwise(empty)).otherwise(F.concat(out, F.array(x)))

    return F.array_join(F.aggregate(F.split(col(c), "/"), empty, step), "/")


def folder(c: Column | str) -> Column:
    return F.regexp_extract(col(c), "^(.*)/[^/]*$", 1)


def file_name(c: Column | str) -> Column:
    return F.regexp_extract(col(c), "([^/]*)$", 1)


def extension(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(file_name(c), r"\.([^.]*)$", 1))


def is_external(c: Column | str) -> Column:
    return col(c).rlike("^[A-Za-z][A-Za-z0-9+.-]*:")


def link_kind(c: Column | str) -> Column:
    return F.when(is_external(c), "external").when(F.startswith(col(c), F.lit("#")), "fragment").otherwise("local")


def link_path(c: Column | str) -> Column:
    return F.substring_index(col(c), "#", 1)


def link_fragment(c: Column | str) -> Column:
    return F.regexp_extract(col(c), "^[^#]*#(.*)$", 1)


def resolve(base: Column | str, href: Column | str) -> Column:
    """The path that a relative link in the file ``base`` points to; '' for a fragment of its own file means base."""
    path = url_decode(link_path(href))
    return F.when(path == "", col(base)).when(F.startswith(path, F.lit("/")), normal_path(path)).otherwise(normal_path(F.concat_ws("/", F.nullif(folder(base), F.lit("")), path)))


def relative(start: Column | str, target: Column | str) -> Column:
    """The relative path from file ``start`` to file ``target``."""
    a, b = F.split(col(start), "/"), F.split(col(target), "/")
    a_dirs, b_dirs = F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(b, 1, F.greatest(F.size(b) - 1, F.lit(0)))
    same = F.aggregate(F.zip_with(a_dirs, b_dirs, lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & x, 1).otherwise(0)).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"])
    ups = F.array_repeat(F.lit(".."), F.size(a_dirs) - same)
    return F.array_join(F.concat(ups, F.slice(b, same + 1, F.greatest(F.size(b) - same, F.lit(0)))), "/")


def is_scene_break(c: Column | str) -> Column:
    """Up to 16 ornament characters and blanks, at least one ornament."""
    return col(c).rlike(r"^[\s*＊※◆◇■□●○★☆§~〜\-—–_=+.·•・…|]{1,16}$") & col(c).rlike(r"\S")


def compact(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\s+", "")


def simplified(c: Column | str) -> Column:
    return F.btrim(F.regexp_replace(col(c), r"\s+", " "))


def valid_id(c: Column | str) -> Column:
    """A name as an XML id: other characters than letters, digits, _, - and . go, and it begins with a letter."""
    kept = F.regexp_replace(col(c), r"[^A-Za-z0-9_.\-]", "")
    return F.when(kept.rlike("^[A-Za-z]"), kept).otherwise(F.concat(F.lit("x"), kept))


def full_width(c: Column | str) -> Column:
    """ASCII signs, letters and digits to full width, blanks to the ideographic space."""
    half = "".join(map(chr, range(0x21, 0x7F))) + " "
    return F.translate(col(c), half, "".join(chr(ord(x) + 0xFEE0) for x in half[:-1]) + "　")


def half_width(c: Column | str) -> Column:
    half = "".join(map(chr, range(0x21, 0x7F))) + " "
    return F.translate(col(c), "".join(chr(ord(x) + 0xFEE0) for x in half[:-1]) + "　", half)


def css_length(c: Column | str) -> tuple[Column, Column]:
    """Number and unit of a CSS length; nulls if it is none."""
    rx = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))([a-z%]*)\s*$"
    return F.regexp_extract(F.lower(col(c)), rx, 1).try_cast("double"), F.when(F.lower(col(c)).rlike(rx), F.regexp_extract(F.lower(col(c)), rx, 2))


def style_property(c: Column | str, name: str) -> Column:
    """Value of a property in an inline style; '' if it isn't there."""
    return F.btrim(F.regexp_extract(F.lower(col(c)), rf"(?:^|;)\s*{re.escape(name)}\s*:\s*([^;]*)", 1))


def spelling_safe(c: Column | str) -> Column:
    """Curly apostrophes to straight ones, soft hyphens gone."""
    return F.translate(col(c), "’ʼ­", "''")


def style_distance(a: Column | str, b: Column | str) -> Column:
    """10 for each property that one of two maps lacks, and 1 for each that differs."""
    keys = F.array_union(F.map_keys(col(a)), F.map_keys(col(b)))
    return F.aggregate(
        keys, F.lit(0), lambda n, k: n + F.when(F.map_contains_key(col(a), k) & F.map_contains_key(col(b), k), 0).otherwise(10) + F.when(F.try_element_at(col(a), k).eqNullSafe(F.try_element_at(col(b), k)), 0).otherwise(1)
    )
