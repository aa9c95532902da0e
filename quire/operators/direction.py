"""Writing direction of whole books: pages, stylesheets and packages are rewritten together, behind checks, all or none of a book.

Everything is a Column expression inside a file's row; the verdict on a book is an aggregate that is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import tokens as M

# The writing modes of either direction, properties that only vertical text has, and names that mark converted pages.
VERTICAL = ["vertical-rl", "vertical-lr", "sideways-rl", "sideways-lr", "vertical", "tb-rl", "tb"]
HORIZONTAL = ["horizontal-tb", "horizontal", "lr-tb", "lr", "rl-tb", "rl"]
ONLY_VERTICAL = ["text-orientation", "text-combine-upright", "text-combine-horizontal", "-webkit-text-combine"]
CLASSES, PAGE_CLASSES = {True: "v2h-horizontal", False: "h2v-vertical"}, {True: ("vrtl", "hltr"), False: ("hltr", "vrtl")}
ROOT = r"(?i)(^|[\s>+~,])(?:html|body|:root)(?=$|[\s>+~.#:\[])"
MARKER = r"<!-- layout-progression original=(absent|default|ltr|rtl) applied=(ltr|rtl) -->\n?"
#: From this risk on a page is left to a person.
RISKY = 50
_WRITING = r"(?:-(?:webkit|epub|ms)-)?writing-mode\s*:\s*"
#: Comments, rules, and what is between them; together they are the sheet.
CSS_PIECES = r"(?s)/\*.*?\*/|(?:[^{}/]|/(?!\*))*\{(?:[^{}/]|/(?!\*)|/\*.*?\*/)*\}|(?:[^{}/]|/(?!\*))+|[{}]|/"


def target(to_horizontal: bool) -> str:
    return "horizontal-tb" if to_horizontal else "vertical-rl"


def _modes(text: Column, before: str, after: str, to_horizontal: bool) -> Column:
    source = "|".join(VERTICAL if to_horizontal else HORIZONTAL)
    rx = rf"(?i)({before}\s*{_WRITING})(?:{source})"
    marked = F.regexp_replace(text, rf"{rx}\s*!\s*important(?=\s*{after})", f"$1{target(to_horizontal)} !important")
    return F.regexp_replace(marked, rf"{rx}(?=\s*{after})", f"$1{target(to_horizontal)}")


def style_value(style: Column | str, to_horizontal: bool = True) -> Column:
    """The value of a style attribute with writing modes of the other direction; all else stays as it is."""
    return _modes(T.col(style), "(?:^|;)", "(?:;|$)", to_horizontal)


def css_rewritten(css: Column | str, to_horizontal: bool = True, root_only: bool = True) -> Column:
    """A stylesheet with writing modes of the other direction; to the horizontal also without properties and font features of vertical text.

    To the vertical, with ``root_only``, only rules for the root or body change, so that horizontal parts stay. Comments and all other declarations stay as they are.
    """

    def rule(x: Column) -> Column:
        out = _modes(x, "[{;]", "[;}]", to_horizontal)
        if not to_horizontal:
            return F.when(F.regexp_extract(x, r"^([^{]*)\{", 1).rlike(ROOT), out).otherwise(x) if root_only else out
        out = F.regexp_replace(out, rf"(?i)(?<=[{{;][ \t]{{0,9}})(\s*)(?:{'|'.join(ONLY_VERTICAL)})\s*:[^;{{}}]*(?:;[ \t]*)?", "$1")
        found = F.regexp_extract_all(out, F.lit(r"(?i)(?<=[{;\s])font-feature-settings\s*:[^;{}]*(?:;[ \t]*)?"), F.lit(0))
        return F.aggregate(found, out, lambda t, d: F.replace(t, d, _features(d)))

    return F.array_join(F.transform(F.regexp_extract_all(T.col(css), F.lit(CSS_PIECES), F.lit(0)), lambda x: F.when(x.rlike(r"(?s)^(?!/\*).*\{"), rule(x)).otherwise(x)), "")


def _features(declaration: Column) -> Column:
    """A declaration of font features without the vertical ones that are on; nothing, if none is left."""
    value = F.regexp_extract(declaration, r"(?s)^[^:]*:([^;]*)", 1)
    important = F.when(value.rlike(r"(?i)!\s*important\s*$"), " !important").otherwise("")
    parts = F.split(F.regexp_replace(value, r"(?i)\s*!\s*important\s*$", ""), ",")
    kept = F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(" \t\r\n\f"))), lambda p: ~p.rlike(r"""(?i)^(['"]?)(?:vert|vrt2)\1(?:\s+(?:on|\+?0*[1-9]\d*|-0*[1-9]\d*))?$"""))
    same = F.size(kept) == F.size(parts)
    new = F.concat(F.regexp_extract(declaration, r"(?s)^([^:]*:\s*)", 1), F.array_join(kept, ", "), important, F.regexp_extract(declaration, r"(;[ \t]*)$", 1))
    return F.when(same, declaration).when(F.size(kept) == 0, "").otherwise(new)


def override_css(to_horizontal: bool) -> str:
    """The style that turns a page whatever its sheets say."""
    modes = "".join(f"{p}writing-mode:{target(to_horizontal)} !important;" for p in ("", "-epub-", "-webkit-"))
    root = f"html.{CLASSES[to_horizontal]}"
    inner = modes + "text-combine-upright:none !important;-webkit-text-combine:none !important;text-orientation:initial !important;" if to_horizontal else "text-orientation:mixed !important;"
    return f"{root},{root} body{{{modes}}}{root} *{{{inner}}}"


def page_rewritten(html: Column | str, to_horizontal: bool = True, page_class: Column | None = None) -> Column:
    """A page with its style attributes rewritten, and either its page class exchanged (where ``page_class`` holds) or an override class and style put in; null if it has no root or head."""
    old, new = PAGE_CLASSES[to_horizontal]
    own, other = CLASSES[to_horizontal], CLASSES[not to_horizontal]
    attribute = r"""(?is)^(<[^<>]*\sstyle\s*=\s*)("[^"]*"|'[^']*')"""

    def tag(x: Column) -> Column:
        value = F.regexp_extract(x, attribute, 2)
        changed = F.concat(F.substring(value, 1, 1), style_value(F.substring(value, F.lit(2), F.length(value) - 2), to_horizontal), F.substring(value, 1, 1))
        return F.when(value == "", x).otherwise(F.concat(F.regexp_extract(x, attribute, 1), changed, F.regexp_replace(x, attribute, "")))

    toks = F.regexp_extract_all(T.col(html), F.lit(f"{M.SILENT}|{M.TOKEN}"), F.lit(0))
    styled = F.array_join(F.transform(toks, lambda x: F.when(x.rlike(r"(?is)^<[^!?/][^<>]*\sstyle\s*="), tag(x)).otherwise(x)), "")
    root = r"(?is)(<html\b[^<>]*\bclass\s*=\s*[\"'])"
    override = f'<style class="{own}">{override_css(to_horizontal)}</style>'
    # a page that the other direction has overridden gets its own look back
    undone = F.regexp_replace(F.replace(styled, F.lit(f'<style class="{other}">{override_css(not to_horizontal)}</style>'), F.lit("")), rf'(?is)(<html\b[^<>]*?)(?: class="{other}"|(?<=[\s"\']){other} )', "$1")
    classed = F.when(styled.rlike(r"(?is)<html\b[^<>]*\bclass\s*="), F.regexp_replace(styled, root, f"$1{own} ")).otherwise(F.regexp_replace(styled, r"(?i)<html\b", f'<html class="{own}"'))
    overridden = F.regexp_replace(classed, "(?i)</head>", f"{override}</head>")
    switched = F.regexp_replace(styled, rf"""(?is)(<html\b[^<>]*\bclass\s*=\s*["'](?:[^"']*\s)?){old}(?=[\s"'])""", f"$1{new}")
    made = F.when(F.contains(styled, F.lit(f'<style class="{other}">')), undone).when(page_class if page_class is not None else F.lit(False), switched).otherwise(overridden)
    return F.when(T.col(html).rlike(r"(?i)<html[\s>]") & T.col(html).rlike("(?i)</head>"), made)


def spine_rewritten(opf: Column | str, to_horizontal: bool = True) -> tuple[Column, Column]:
    """(package with the spine's page progression turned, problem or null). A comment keeps the former value, which turning back restores."""
    c, attribute = T.col(opf), r"""\spage-progression-direction\s*=\s*["']([^"']*)["']"""
    wanted = "ltr" if to_horizontal else "rtl"
    spine = F.regexp_extract(c, r"(?s)<(?:\w+:)?spine\b[^<>]*>", 0)
    now = F.when(spine.rlike(attribute), F.lower(F.btrim(F.regexp_extract(spine, attribute, 1)))).otherwise("absent")
    was, applied = F.regexp_extract(c, MARKER, 1), F.regexp_extract(c, MARKER, 2)
    marked = applied != ""
    problem = F.when(spine == "", "no spine").when(~now.isin("absent", "default", "ltr", "rtl"), "invalid page progression").when(marked & (now != applied), "page progression changed by hand")
    without = F.regexp_replace(spine, attribute, "")
    with_value = lambda v: F.concat(F.regexp_extract(without, r"(?s)^(<[\w:]+)", 1), F.lit(' page-progression-direction="'), v, F.lit('"'), F.regexp_replace(without, r"(?s)^<[\w:]+", ""))
    set_to = lambda v: F.when(spine.rlike(attribute), F.regexp_replace(spine, r"""(\spage-progression-direction\s*=\s*["'])[^"']*""", F.concat(F.lit("$1"), v))).otherwise(with_value(v))
    back = F.replace(F.regexp_replace(c, MARKER, ""), spine, F.when(was == "absent", without).otherwise(set_to(was)))
    note = F.concat(F.lit("<!-- layout-progression original="), now, F.lit(f" applied={wanted} -->\n"))
    turned = F.when(marked & (applied == wanted), c).when(marked, back).otherwise(F.replace(c, spine, F.concat(note, set_to(F.lit(wanted)))))
    return F.when(problem.isNull(), turned).otherwise(c), problem


def _profile(html: Column) -> Column:
    """What a rewrite must not change: visible text, ids, names and links as sorted lists, and how many ruby parts, images and anchors there are."""
    toks = F.regexp_extract_all(M.blanked(html), F.lit(M.TOKEN), F.lit(0))
    text = F.array_join(F.filter(toks, lambda x: M.token_type(x) == "text"), "")
    tags = F.filter(toks, lambda x: M.token_type(x).isin("begin", "single"))
    of = lambda *names: F.array_sort(F.flatten(F.transform(tags, lambda x: F.array_compact(F.array(*(F.try_element_at(M.attributes(x), F.lit(n)) for n in names))))))
    count = lambda name: F.size(F.filter(tags, lambda x: x.rlike(rf"(?i)^<{name}[\s/>]")))
    counts = [count(name) for name in ("ruby", "rt", "rp", "img", "a")]
    return F.struct(text.alias("text"), of("id", "name").alias("ids"), of("href", "src").alias("links"), F.array(*counts).alias("counts"))


def invariant_problem(before: Column | str, after: Column | str) -> Column:
    """What differs that must not: text, ids, links or counts; null if nothing does."""
    a, b = _profile(T.col(before)), _profile(T.col(after))
    return F.when(a["text"] != b["text"], "visible text differs").when(a["ids"] != b["ids"], "ids differ").when(a["links"] != b["links"], "links differ").when(a["counts"] != b["counts"], "elements differ")


def convert_books(files: DataFrame, modes: DataFrame, to_horizontal: bool = True, page_class: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, verdicts). files: book, path, kind (html, css, opf), text; modes: book, path, mode (vertical or horizontal), fixed, risk.

    The files come back with the new text and changed. Pages of the other direction are rewritten unless they are fixed or their risk is RISKY or more; with them the book's
    stylesheets and, if none of its pages is fixed, its package. verdicts has book, n_pages (to convert), problems (of files, in order) and converted: a book is converted
    if it has such pages and no file has a problem, else all its files stay. A page without a root or head, a package without a usable spine, and a page whose text, ids,
    links or elements would differ are problems. Null texts stay null; files without modes are no pages to convert; repeated rows are each rewritten.
    """
    source = "vertical" if to_horizontal else "horizontal"
    look = modes.groupBy("book", "path").agg(F.max("mode").alias("mode"), F.coalesce(F.bool_or("fixed"), F.lit(False)).alias("fixed"), F.max("risk").alias("risk"))
    rows = files.select("book", "path", "kind", "text").join(look, ["book", "path"], "left")
    page = (F.col("kind") == "html") & (F.col("mode") == source) & ~F.col("fixed") & (F.coalesce("risk", F.lit(0)) < RISKY)
    page = F.coalesce(page, F.lit(False))
    spine, spine_problem = spine_rewritten("text", to_horizontal)
    made = F.when(page, page_rewritten("text", to_horizontal, page_class)).when(F.col("kind") == "css", css_rewritten("text", to_horizontal)).when(F.col("kind") == "opf", spine).otherwise(F.col("text"))
    staged = rows.withColumns({"page": page, "made": made})
    problem = F.when(F.col("page") & F.col("made").isNull(), "no root or head").when(F.col("page"), invariant_problem("text", "made")).when(F.col("kind") == "opf", spine_problem)
    staged = staged.withColumn("problem", problem)
    told = F.transform(F.array_sort(F.collect_list(F.when(F.col("problem").isNotNull(), F.struct("path", "problem")))), lambda x: F.concat_ws(": ", x["path"], x["problem"]))
    verdicts = staged.groupBy("book").agg(F.count_if("page").alias("n_pages"), told.alias("problems"), F.coalesce(F.bool_or("fixed"), F.lit(False)).alias("has_fixed"))
    verdicts = verdicts.withColumn("converted", (F.col("n_pages") > 0) & (F.size("problems") == 0))
    held = staged.join(verdicts.select("book", "converted", "has_fixed"), "book", "left")
    take = F.coalesce("converted", F.lit(False)) & ~((F.col("kind") == "opf") & F.col("has_fixed"))
    text = F.when(take, F.col("made")).otherwise(F.col("text"))
    return held.select("book", "path", "kind", text.alias("text"), (~text.eqNullSafe(F.col("text"))).alias("changed")), verdicts.drop("has_fixed")
