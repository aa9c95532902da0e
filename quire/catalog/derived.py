"""Queries for constructs that the given tables lack: their inputs are derived from those tables row by row, so that work grows with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog.markup import _PATH, ELEMENTS, TOK, docs
from quire.catalog.register import query, table
from quire.functions import text as T
from quire.operators import chinese, classify, direction, layout, links, pages, rewrite, structure
from quire.operators import search as S
from quire.operators import tokens as M
from quire.operators import versions as V
from quire.operators import words as W
from quire.plans.scratch import Scratch
from quire.plans.shares import dealt
from quire.sources import archives

_P = "length(regexp_extract_all(html, '<p>'))"


def texts(spark, d):
    return table(spark, d, "documents")


def put(spark, d, old, new):
    return docs(spark, d).withColumn("html", F.replace("html", F.lit(old), new if not isinstance(new, str) else F.lit(new)))


# sources


@query("select doc_id, source, octet_length(encode(text))::bigint as size from documents where text is not null")
def write_archives(spark, d):
    """Documents packed into archives, volumes of about a thousand for each source, and unpacked again."""
    entries = texts(spark, d).where("text is not null").select(F.col("source").alias("book_id"), F.concat(F.lit("Text/"), F.col("doc_id").cast("string")).alias("bookpath"), F.col("text").cast("binary").alias("bytes"))
    packed = archives.write_archives(entries, rows=1000, size=8 << 20).select(F.col("book_id").alias("path"), F.col("bytes").alias("content"))
    back = archives.unpacked(packed, archives.Limits(ratio=1_000_000))  # some of the given texts repeat themselves beyond the default
    return back.select(F.substring("bookpath", 6, 20).cast("long").alias("doc_id"), "source", F.octet_length("bytes").cast("long").alias("size"))


@query("select source, count(*) as entries, count(*) filter (doc_id % 10 = 0) as refused from documents group by 1")
def scan_archives(spark, d):
    """As above, every tenth entry with a path that leaves the archive."""
    path = F.concat(F.when(F.col("doc_id") % 10 == 0, "../").otherwise("Text/"), F.col("doc_id").cast("string"))
    entries = texts(spark, d).select(F.col("source").alias("book_id"), path.alias("bookpath"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    back = archives.unpacked(archives.write_archives(entries, rows=1000, size=8 << 20).select(F.col("book_id").alias("path"), F.col("bytes").alias("content")), archives.Limits(ratio=1_000_000))
    return back.groupBy("source").agg(F.count("*").alias("entries"), F.count_if(F.col("issue") == "unsafe path").alias("refused"))


@query("select doc_id, case doc_id % 3 when 0 then 'UTF-8' when 1 then 'UTF-16LE' else 'UTF-16BE' end as encoding, replace(text, chr(13), chr(10)) as text from documents")
def decode_bytes(spark, d):
    mark = lambda x: F.unhex(F.lit(x))
    n = F.col("doc_id") % 3
    data = F.when(n == 0, F.encode("text", "UTF-8")).when(n == 1, F.concat(mark("FFFE"), F.encode("text", "UTF-16LE"))).otherwise(F.concat(mark("FEFF"), F.encode("text", "UTF-16BE")))
    text, encoding = archives.decode_bytes("b")
    return texts(spark, d).select("doc_id", data.alias("b")).select("doc_id", encoding.alias("encoding"), text.alias("text"))


@query("select doc_id::varchar as doc_id, source, n_chars::varchar as n_chars from documents")
def write_report(spark, d):
    at = Scratch(spark, "report").at
    archives.write_report(texts(spark, d).select("doc_id", "source", "n_chars"), at)
    return spark.read.option("header", True).schema("doc_id string, source string, n_chars string").csv(at)


#: Items of a package at most.
ITEMS = 1000


def _package(spark, d):
    """Packages of a source, in volumes of ``ITEMS`` documents: documents as items, those in English in the spine.

    Their tables are the source's: book_id is the source, and pos goes on from volume to volume.
    """
    item = F.concat(F.lit('<item id="i'), F.col("doc_id").cast("string"), F.lit('" href="Text/'), F.col("doc_id").cast("string"), F.lit('.xhtml" media-type="text/'), "lang", F.lit('"/>'))
    ref = F.when(F.col("lang") == "en", F.concat(F.lit('<itemref idref="i'), F.col("doc_id").cast("string"), F.lit('"/>')))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("doc_id", c.alias("x"))))), lambda y: y["x"]), "")
    whole = F.concat(F.lit('<package version="3.0"><metadata><dc:title>'), "source", F.lit("</dc:title></metadata><manifest>"), ordered(item), F.lit("</manifest><spine>"), ordered(ref), F.lit("</spine></package>"))
    rows = W.numbered(texts(spark, d).select("source", "doc_id", "lang"), "source", ["doc_id"], "n").withColumn("volume", F.floor((F.col("n") - 1) / ITEMS))
    volumes = rows.groupBy("source", "volume").agg(whole.alias("text"))
    found = archives.package_tables(volumes.select(F.concat_ws("/", "volume", "source").alias("book_id"), F.lit("OPS/p.opf").alias("bookpath"), "text"))
    pos = F.substring_index("book_id", "/", 1).cast("long") * (1 << 32) + F.col("pos")
    return {k: found[k].withColumn("pos", pos).withColumn("book_id", F.expr("substr(book_id, instr(book_id, '/') + 1)")) for k in ("metadata", "manifest", "spine")}


@query("select source as book_id, 'i' || doc_id as id, 'OPS/Text/' || doc_id || '.xhtml' as bookpath, 'text/' || lang as media_type from documents")
def package_tables(spark, d):
    return _package(spark, d)["manifest"].select("book_id", "id", "bookpath", "media_type")


@query("select source as book_id, row_number() over (partition by source order by doc_id) as place, 'OPS/Text/' || doc_id || '.xhtml' as bookpath from documents where lang = 'en'")
def manifest_spine(spark, d):
    p = _package(spark, d)
    return W.numbered(archives.manifest_spine(p["manifest"], p["spine"]).select("book_id", "pos", "bookpath"), "book_id", ["pos"], "place").select("book_id", "place", "bookpath")


@query("select source as book_id, 'OPS/Text/' || doc_id || '.xhtml' as bookpath, 'no file' as issue from documents where doc_id % 7 = 0 union all select source, 'OPS/Text/x' || doc_id || '.xhtml', 'not listed' from documents where doc_id % 11 = 0")
def manifest_audit(spark, d):
    files = texts(spark, d).select(F.col("source").alias("book_id"), F.inline(F.array(F.struct(F.concat(F.lit("OPS/Text/"), F.col("doc_id").cast("string"), F.lit(".xhtml")).alias("bookpath"), (F.col("doc_id") % 7 != 0).alias("there")), F.struct(F.concat(F.lit("OPS/Text/x"), F.col("doc_id").cast("string"), F.lit(".xhtml")).alias("bookpath"), (F.col("doc_id") % 11 == 0).alias("there")))))
    return archives.manifest_audit(files.where("there").drop("there"), _package(spark, d)["manifest"])


@query("select source as book_id, 'i' || doc_id as old_id, 'x' || doc_id || '.xhtml' as name from documents")
def rebase_ids(spark, d):
    p = _package(spark, d)
    named, _ = rewrite.rebase_ids(p["manifest"].withColumn("old_id", F.col("id")), p["spine"])
    return named.select("book_id", "old_id", F.col("id").alias("name"))


@query("select source as book_id, length(u) as n, substr(u, 15, 1) as version from (select distinct source, '00000000-0000-4000-a000-000000000000' as u from documents)")
def ensure_uuid(spark, d):
    made = rewrite.ensure_uuid(_package(spark, d)["metadata"])
    return made.select("book_id", F.length("uuid").cast("long").alias("n"), F.substring("uuid", 15, 1).alias("version"))


# extraction


@query(f"select page_id, 'i/' || page_id || '.png' as url, {_P}::bigint as n from pages where {_P} > 0")
def style_attr_urls(spark, d):
    with_style = put(spark, d, "<p>", F.concat(F.lit("<p style=\"background: url('i/"), F.col("page_id").cast("string"), F.lit(".png')\">")))
    return pages.style_attr_urls(with_style).groupBy(F.col("doc").alias("page_id"), "url").agg(F.count("*").alias("n"))


@query(f"select page_id, 'p' || page_id as id, {_P}::bigint as n from pages where {_P} > 0 union all select page_id, 'nav', length(regexp_extract_all(html, '<a '))::bigint from pages where contains(html, '<a ')")
def ids(spark, d):
    with_ids = put(spark, d, "<p>", F.concat(F.lit("<p name=z id=p"), F.col("page_id").cast("string"), F.lit(">"))).withColumn("html", F.replace("html", F.lit("<a "), F.lit("<a name='nav' ")))
    return pages.ids(with_ids).groupBy("page_id", "id").agg(F.count("*").alias("n"))


@query("select 'p' || page_id % 20 as id, count(*) as n_pages from pages where contains(html, '<p>') group by 1 having count(*) > 1")
def intersect_ids(spark, d):
    with_ids = put(spark, d, "<p>", F.concat(F.lit("<p id=p"), (F.col("page_id") % 20).cast("string"), F.lit(">")))
    return links.repeated_ids(pages.ids(with_ids))


@query("select page_id, 'i/' || page_id || '.png' as path from pages where contains(html, '<b>')")
def media_paths(spark, d):
    with_images = put(spark, d, "<b>", F.concat(F.lit("<img src='i/"), F.col("page_id").cast("string"), F.lit(".png'><img src='http://x/y.png'>")))
    return pages.media_paths(with_images).withColumnRenamed("doc", "page_id")


@query("select page_id, kind, href from (select page_id, unnest(['stylesheet', 'css', 'script']) as kind, unnest(['s' || page_id % 9 || '.css', 't.css', 'j.js']) as href from pages where contains(html, '</head>'))")
def stylesheet_links(spark, d):
    head = F.concat(F.lit("<link rel=stylesheet href='s"), (F.col("page_id") % 9).cast("string"), F.lit(".css'><link href='t.css'><script src='j.js'></script></head>"))
    return pages.stylesheet_links(put(spark, d, "</head>", head)).select(F.col("doc").alias("page_id"), "kind", "href")


def _sheets(spark, d):
    """A stylesheet for each page: an import, a url and a content string."""
    k = F.col("page_id").cast("string")
    css = F.concat(F.lit("@import 's"), (F.col("page_id") % 9).cast("string"), F.lit(".css'; .c"), k, F.lit(" , p{background:url( \"../i/"), k, F.lit(".png\" );content:'"), "url", F.lit("\\2014 '} @media print{.v{writing-mode:vertical-rl}}"))
    return docs(spark, d).select(F.col("page_id").alias("doc"), F.concat(F.lit("Styles/"), k, F.lit(".css")).alias("path"), css.alias("css"))


@query("select page_id, unnest(['Styles/s' || page_id % 9 || '.css', 'i/' || page_id || '.png']) as path from pages")
def css_urls(spark, d):
    return M.css_urls(_sheets(spark, d), "doc", "css", "path").select(F.col("doc").alias("page_id"), "path")


@query("select page_id, 's' || page_id % 9 || '.css' as url from pages")
def css_imports(spark, d):
    return M.css_imports(_sheets(spark, d), "doc", "css").select(F.col("doc").alias("page_id"), "url")


@query("select distinct page_id, unicode(unnest(string_split(url || '—', '')))::bigint as codepoint from pages")
def css_used_codepoints(spark, d):
    rules = M.css_rules(_sheets(spark, d), "doc", "css", style_blocks=False)
    return M.css_used_codepoints(M.css_declarations(rules)).select(F.col("doc").alias("page_id"), "codepoint")


@query("select page_id, true as vertical, '.v' as vertical_selectors from pages")
def css_layout_features(spark, d):
    rules = M.css_rules(_sheets(spark, d), "doc", "css", style_blocks=False)
    return classify.css_layout_features(M.css_declarations(rules)).where("vertical is not null").select(F.col("doc").alias("page_id"), F.coalesce("vertical", F.lit(False)).alias("vertical"), "vertical_selectors")


@query("""select page_id, '@import ''s' || page_id % 9 || '.css''; .c' || page_id || ' , p{background:url( "../new/' || page_id || '.png" );content:''' || url || '\\2014 ''} @media print{.v{writing-mode:vertical-rl}}' as css from pages where page_id % 3 = 0""")
def css_renames(spark, d):
    k = F.col("page_id").cast("string")
    updates = docs(spark, d).where("page_id % 3 = 0").select(F.concat(F.lit("i/"), k, F.lit(".png")).alias("old_path"), F.concat(F.lit("new/"), k, F.lit(".png")).alias("new_path"))
    return rewrite.css_renames(_sheets(spark, d), updates).select(F.col("doc").alias("page_id"), "css")


@query("select page_id, '.c' || page_id || ', p {' || chr(10) || '  background: url( \"../i/' || page_id || '.png\" );' || chr(10) || '  content: ''' || url || '\\2014 '';' || chr(10) || '}' || chr(10) || chr(10) || '.v {' || chr(10) || '  writing-mode: vertical-rl;' || chr(10) || '}' || chr(10) as css from pages")
def format_css(spark, d):
    return rewrite.format_css(M.css_rules(_sheets(spark, d), "doc", "css", style_blocks=False)).select(F.col("doc").alias("page_id"), "css")


@query("select page_id % 9 as k, count(*) as n_pages from pages group by 1")
def css_files_report(spark, d):
    used = docs(spark, d).select("page_id", F.concat(F.lit("s"), (F.col("page_id") % 9).cast("string")).alias("path"))
    sheets = used.select("path").distinct().withColumn("css", F.lit("p{}"))
    report = classify.css_files_report(sheets, used).where("is_total = 0")
    return report.select(F.substring("path", 2, 5).cast("long").alias("k"), "n_pages")


@query("""with e as (select page_id, page_id % 97 as s from pages), n as (select distinct s from e), r as (select page_id, s, unnest(range(0, 4)) as step from e) select page_id, (s + step) % 97 as sheet, step::int as step from r where s + step < 97 and (s // 4) = ((s + step) // 4)""")
def stylesheet_closure(spark, d):
    """Sheets in chains of four: each imports the next."""
    start = docs(spark, d).select(F.col("page_id").alias("page"), (F.col("page_id") % 97).alias("sheet"))
    imports = spark.range(96).select(F.col("id").alias("sheet"), (F.col("id") + 1).alias("target")).where("floor(sheet / 4) = floor(target / 4)")
    return links.stylesheet_closure(start, imports).select(F.col("page").alias("page_id"), "sheet", F.col("step").cast("int").alias("step"))


@query("select doc_id, '<!DOCTYPE x []>' || source || '|' || text as text from documents where text is not null")
def resolve_entities(spark, d):
    rows = texts(spark, d).where("text is not null").withColumn("text", F.concat(F.lit("<!DOCTYPE x [<!ENTITY src '"), "source", F.lit("'>]>&src;|"), "text"))
    return pages.resolve_entities(rows, "doc_id", "text")


@query("select page_id, name, content from (select page_id, unnest(['dc:creator', 'robots']) as name, unnest([regexp_extract(url, '^[a-z]+'), 'all']) as content from pages where contains(html, '</head>'))")
def html_metadata(spark, d):
    head = F.concat(F.lit("<meta name='DC.Creator' content='"), F.regexp_extract("url", "^[a-z]+", 0), F.lit("'><meta name=robots content=all></head>"))
    return pages.html_metadata(put(spark, d, "</head>", head)).select(F.col("doc").alias("page_id"), "name", "content")


# joins and reports


@query("select distinct selector from (select page_id, unnest(['unused' || page_id % 50, 'p']) as selector from pages) where selector <> 'p'")
def unused_selectors(spark, d):
    css = docs(spark, d).withColumn("html", F.concat("html", F.lit("<style>unused"), (F.col("page_id") % 50).cast("string"), F.lit("{}</style>")))
    return links.unused_selectors(links.selector_usage(css, M.elements(css)))


@query("select page_id, 'p {margin:0}' as css from pages where contains(html, 'p{margin:0}')")
def delete_styles(spark, d):
    css = docs(spark, d).withColumn("html", F.concat("html", F.lit("<style>unused"), (F.col("page_id") % 50).cast("string"), F.lit("{a:b}</style>")))
    rules = M.css_rules(css)
    unused = rules.select("selector").distinct().where("selector like 'unused%'")
    return links.without_selectors(rules, unused).withColumnRenamed("doc", "page_id")


_HREF = """nullif(regexp_replace(regexp_extract(tok, '(?i)[\\s"''](href\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+))', 2), '^["'']|["'']$', '', 'g'), '')"""


@query(f"with {TOK}, l as (select {_HREF} as path from tok where ttype in ('begin', 'single')) select path, count(*) as n from l where path is not null group by 1")
def media_usage(spark, d):
    used = M.anchors(docs(spark, d)).select(F.col("href").alias("path"))
    return links.media_usage(used.distinct(), used)


@query(f"with r as (select page_id, {_PATH} from pages) select a.page_id, b.page_id as tail_of from r a join r b on lower(regexp_extract(a.path, '([^/]*)$', 1)) = lower(regexp_extract(b.path, '([^/]*)$', 1))")
def path_end_match(spark, d):
    """Every page against the file name of every page, in capitals."""
    r = links.resources_of(docs(spark, d))
    tails = r.select(F.col("page_id").alias("tail_of"), F.upper(T.file_name("path")).alias("tail"))
    return links.path_end_match(r, tails, ["page_id", "tail_of"])


@query("select source, string_agg(distinct lang, ', ' order by lang) as semantics from documents group by 1")
def semantics(spark, d):
    roles = texts(spark, d).select(F.col("source").alias("bookpath"), F.col("lang").alias("role"))
    return classify.semantics(roles.select("bookpath").distinct(), roles).withColumnRenamed("bookpath", "source")


@query("select doc_id, case doc_id % 3 when 0 then 'bodymatter' else 'titlepage' end as landmark from documents where doc_id % 3 < 2")
def guide_to_landmark(spark, d):
    kind = F.when(F.col("doc_id") % 3 == 0, "Text").when(F.col("doc_id") % 3 == 1, "title-page").otherwise("other")
    return classify.guide_to_landmark(texts(spark, d).select("doc_id", kind.alias("type"))).select("doc_id", "landmark")


@query("select page_id, 100 + page_id % 50 as width, 20 as height, (100 + page_id % 50) * 20 as pixels, page_id % 2 as n_used from pages")
def image_report(spark, d):
    """A GIF header for each page; pages with an odd number are used once."""
    byte = lambda n: F.unhex(F.lpad(F.hex(n), 2, "0"))
    gif = F.concat(F.lit("GIF89a").cast("binary"), byte(100 + F.col("page_id") % 50), F.unhex(F.lit("001400")))
    images = docs(spark, d).select(F.col("page_id").cast("string").alias("path"), gif.alias("bytes"))
    report = classify.image_report(images, images.where("cast(path as long) % 2 = 1").select("path"))
    return report.select(F.col("path").cast("long").alias("page_id"), "width", "height", "pixels", "n_used")


@query(f"with r as (select page_id, {_PATH} from pages) select book, count(*) as n_pages, count(*) filter (page_id % 2 = 0) as n_vertical, count(*) filter (page_id % 3 = 0) as n_image_only from r group by 1")
def layout_summary(spark, d):
    r = links.resources_of(docs(spark, d))
    modes = r.select("page_id", F.when(F.col("page_id") % 2 == 0, "vertical").otherwise("horizontal").alias("mode"))
    return classify.layout_summary(modes, r.select("page_id", "book", F.when(F.col("page_id") % 3 == 0, "image_only").otherwise("text").alias("kind")))


_BITS = [0, 2, 4, 8, 0x0100, 0x0204, 6, 0x1000]


@query("select doc_id, case doc_id % 5 when 0 then 'truetype' when 1 then 'opentype' when 2 then 'woff' when 3 then 'woff2' else 'unknown' end as kind, case doc_id % 9 when 0 then 'installable' when 1 then 'restricted' when 2 then 'preview-and-print' when 3 then 'editable' when 4 then 'no-subsetting' when 5 then 'bitmap-only' else 'invalid-or-missing' end as license from documents")
def font_audit(spark, d):
    """A font for each document: a directory of two tables, the second with the embedding bits; every ninth lacks it."""
    k = F.col("doc_id") % 9
    head = F.element_at(F.array(*(F.lit(x) for x in ("00010000", "4F54544F", "774F4646", "774F4632", "00010001"))), (F.col("doc_id") % 5 + 1).cast("int"))
    bits = F.lpad(F.hex(F.element_at(F.array(*map(F.lit, [*_BITS, 0])), (k + 1).cast("int"))), 4, "0")
    entry = lambda tag: F.concat(tag, F.lit("00000000" "0000002C" "00000060"))
    directory = F.concat(entry(F.lit("676C7966")), entry(F.when(k < 8, F.lit("4F532F32")).otherwise(F.lit("6E616D65"))))
    font = F.unhex(F.concat(head, F.lit("0002" "000000000000"), directory, F.lit("0003" "0000000000" "00"), bits, F.repeat(F.lit("00"), 40)))
    fonts = texts(spark, d).select("doc_id", font.alias("font"))
    return fonts.select("doc_id", archives.font_kind("font").alias("kind"), archives.font_license(archives.font_embedding_bits("font")).alias("license"))


@query("select source as book, case when bool_or(lang = 'de') and bool_or(lang = 'fr') then 'mixed' when bool_or(lang in ('de', 'fr')) then 'generic' else 'none' end as family from documents group by 1")
def profile(spark, d):
    signals = texts(spark, d).select(F.col("source").alias("book"), F.col("lang").alias("signal"))
    return classify.profile(signals, {"mixed": {"de": 30, "fr": 30}}).select("book", "family")


@query("""select doc_id, 'item' as tname, case doc_id % 6 when 1 then 'properties in version 2.0' when 2 then 'wrong parent' when 3 then 'void element has contents' end as issue from documents where doc_id % 6 in (1, 2, 3) union all select doc_id, 'manifest', 'required element is missing' from documents where doc_id % 6 = 2
 union all select doc_id, 'spine', 'manifest must precede' from documents where doc_id % 6 in (2, 4) union all select doc_id, 'toc', 'illegal element' from documents where doc_id % 6 = 5""")
def package_check(spark, d):
    """A package of version 2.0 for each document; five of six have a fault."""
    k = F.col("doc_id") % 6
    item = F.when(k == 1, "<item id='a' properties='nav'/>").when(k == 3, "<item id='a'>text</item>").otherwise("<item id='a'/>")
    manifest, spine = F.when(k == 2, item).otherwise(F.concat(F.lit("<manifest>"), item, F.lit("</manifest>"))), F.lit("<spine><itemref idref='a'/></spine>")
    parts = F.when(k == 4, F.concat(spine, manifest)).otherwise(F.concat(manifest, spine))
    made = texts(spark, d).select(F.col("doc_id").alias("page_id"), F.concat(F.lit("<package version='2.0'><metadata><title>"), "source", F.lit("</title></metadata>"), parts, F.when(k == 5, "<toc/>").otherwise(""), F.lit("</package>")).alias("html"))
    els = M.elements(made)
    return classify.structure_check(els, classify.PACKAGE, pages.element_texts(made, els), "2.0").select(F.col("doc").alias("doc_id"), "tname", "issue")


# functions


@query("select doc_id, replace(replace(text, 'é', '&eacute;'), 'ü', '&uuml;') as named from documents")
def entity_encode(spark, d):
    return texts(spark, d).select("doc_id", T.entity_encode("text", {"é": "eacute", "ü": "uuml"}).alias("named"))


_HALF = "".join(map(chr, range(0x21, 0x7F))) + " "
_FULL = "".join(chr(ord(x) + 0xFEE0) for x in _HALF[:-1]) + "　"
_TABLES = _HALF.replace("'", "''"), _FULL


@query(f"with w as (select doc_id, translate(text, '{_TABLES[0]}', '{_TABLES[1]}') as wide from documents) select doc_id, wide, translate(wide, '{_TABLES[1]}', '{_TABLES[0]}') as back from w")
def width_convert(spark, d):
    return texts(spark, d).select("doc_id", T.full_width("text").alias("wide")).select("doc_id", "wide", T.half_width("wide").alias("back"))


@query("select doc_id, doc_id / 4.0 as number, case doc_id % 2 when 0 then 'em' else '%' end as unit from documents")
def css_length(spark, d):
    number, unit = T.css_length("x")
    text = F.concat((F.col("doc_id") / 4).cast("decimal(20,2)").cast("string"), F.when(F.col("doc_id") % 2 == 0, " EM").otherwise("%"))
    return texts(spark, d).select("doc_id", F.replace(text, F.lit(" "), F.lit("")).alias("x")).select("doc_id", number.alias("number"), unit.alias("unit"))


@query("select doc_id, (case when doc_id % 2 = 0 then 0 else 22 end + case when lang = 'en' then 0 else 1 end)::int as distance from documents")
def style_distance(spark, d):
    a = F.create_map(F.lit("color"), F.col("lang"), F.lit("x"), F.lit("1"))
    b = F.create_map(F.lit("color"), F.lit("en"), F.when(F.col("doc_id") % 2 == 0, "x").otherwise("y"), F.lit("1"))
    return texts(spark, d).select("doc_id", a.alias("a"), b.alias("b")).select("doc_id", T.style_distance("a", "b").cast("int").alias("distance"))


# rewrites


@query("select page_id, replace(html, '<p>', '<p id=\"new' || page_id || '\">') as html from pages where contains(html, '<p>')")
def rename_fragments(spark, d):
    r = links.resources_of(put(spark, d, "<p>", F.concat(F.lit('<p id="old'), F.col("page_id").cast("string"), F.lit('">'))))
    k = F.col("page_id").cast("string")
    return rewrite.rename_fragments(r, r.select("book", "path", F.concat(F.lit("old"), k).alias("old_id"), F.concat(F.lit("new"), k).alias("new_id")).distinct()).select("page_id", "html")


@query(f"select page_id, 'Text/page.html' as path, replace(html, '<p>', '<p><img src=\"../Images/a%20b.png\"/><img src=\"gone.png\"/>') as html from pages union all select page_id, 'Images/a b.png', '' from pages where {_P} > 0")
def import_html(spark, d):
    """Each page with an image beside its folder, and one that isn't there; pages and imported files."""
    r = put(spark, d, "<p>", '<p><img src="../m/a%20b.png"/><img src="gone.png"/>').select("page_id", F.col("page_id").cast("string").alias("book"), F.lit("in/page.html").alias("path"), "html")
    files = r.select("book", F.explode(F.array(F.lit("m/a b.png"), F.lit("m/unused.png"))).alias("path"))
    made, media = rewrite.import_html(r, files)
    return made.select("page_id", "path", "html").unionByName(media.select(F.col("book").cast("long").alias("page_id"), F.col("new_path").alias("path"), F.lit("").alias("html")))


@query("select doc_id, '<package><manifest><item href=\"Text/n' || doc_id || '.xhtml#f\"/><item href=\"b.css\"/></manifest><a href=''Text/o' || doc_id || '.xhtml''/></package>' as xml from documents")
def xml_renames(spark, d):
    """A package for each document, one of its files renamed; only elements that hold links count."""
    k = F.col("doc_id").cast("string")
    xml = F.concat(F.lit('<package><manifest><item href="Text/o'), k, F.lit('.xhtml#f"/><item href="b.css"/></manifest><a href=\'Text/o'), k, F.lit(".xhtml'/></package>"))
    r = texts(spark, d).select(F.col("doc_id").alias("page_id"), k.alias("book"), F.lit("OPS/p.opf").alias("path"), xml.alias("html"))
    updates = r.select("book", F.concat(F.lit("OPS/Text/o"), "book", F.lit(".xhtml")).alias("old_path"), F.concat(F.lit("OPS/Text/n"), "book", F.lit(".xhtml")).alias("new_path"))
    return rewrite.xml_renames(r, updates, "opf").select(F.col("page_id").alias("doc_id"), F.col("html").alias("xml"))


@query("select page_id, replace(html, '<p>', '<p><a href=\"m' || page_id || '.html#x\">l</a>') as html from pages where contains(html, '<p>')")
def relink_anchors(spark, d):
    """Each page is a book of its own; its paragraphs link to an id that has moved to another file."""
    r = put(spark, d, "<p>", '<p><a href="o.html#x">l</a>').select("page_id", F.col("page_id").cast("string").alias("book"), F.lit("page.html").alias("path"), "html")
    old = r.select("book", F.lit("o.html").alias("old_path"))
    places = r.select("book", F.lit("x").alias("id"), F.concat(F.lit("m"), "book", F.lit(".html")).alias("path"))
    return rewrite.relink_anchors(r, old, places).select("page_id", "html")


@query("select page_id, replace(html, '</head>', '<link rel=\"stylesheet\" type=\"text/css\" href=\"n.css\"/></head>') as html from pages")
def relink_styles(spark, d):
    return rewrite.relink_styles(put(spark, d, "</head>", "<link rel='stylesheet' href='o.css'></head>"), ["n.css"]).select("page_id", "html")


_ESCAPED = "replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


_SWAPPED = "translate(translate(replace({}, 'the ', 'THE_'), 'xyz', 'yzx'), 'y', 'Y')"


@query(f"select doc_id, {_SWAPPED.format(_ESCAPED)} as text, {_SWAPPED.format('source')} as title, text as kept from documents where text is not null")
def chinese_convert(spark, d):
    """Two stages of phrase tables, here of Latin letters, the first of which exchanges letters, over a page with a title, a code block and the text of each document."""
    title, text = F.concat(F.lit("<p title='"), "source", F.lit("'>")), T.html_escape("text")
    made = texts(spark, d).where("text is not null").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("<html><head><title>the x</title></head><body>"), title, text, F.lit("</p><code>"), text, F.lit("</code></body></html>")).alias("html"), "text")
    table = spark.createDataFrame([("TWPhrasesRev", "the ", "THE_"), ("TWVariantsRev", "x", "y"), ("TWVariantsRev", "y", "z"), ("TWVariantsRev", "z", "x"), ("TSCharacters", "y", "Y")], "dictionary string, source string, target string")
    out = chinese.convert_direction(made, table, "tw2sp").join(made.select("page_id", "text"), "page_id")
    of = lambda rx: F.regexp_extract("html", rx, 1)
    same = F.contains("html", F.concat(F.lit("<code>"), T.html_escape("text"), F.lit("</code>")))
    return out.select(F.col("page_id").alias("doc_id"), of("(?s)'>(.*)</p><code>").alias("text"), of("(?s)<p title='([^']*)'").alias("title"), F.when(same, F.col("text")).alias("kept"))


@query("select lang || '/' || doc_id // 1000 as book, '<ul>' || string_agg('<li><a href=\"' || doc_id || '.html\">' || source || '</a></li>', '' order by doc_id) || '</ul>' as markup from documents group by 1")
def render_toc(spark, d):
    """A thousand documents of a language are a book."""
    book = F.concat("lang", F.lit("/"), F.floor(F.col("doc_id") / 1000).cast("string"))
    return structure.render_toc(texts(spark, d).select(book.alias("book"), F.col("doc_id").alias("pos"), F.col("source").alias("title"), F.concat(F.col("doc_id").cast("string"), F.lit(".html")).alias("href")))


@query("select doc_id, array_to_string(list_filter(regexp_extract_all(text, '[a-z]+ing'), lambda x: contains(x, 'th')), ' ') as accepted from documents")
def filter_accept(spark, d):
    return texts(spark, d).select("doc_id", F.array_join(S.filtered("text", "[a-z]+ing", "th"), " ").alias("accepted"))


@query("select doc_id, array_to_string(list_filter(regexp_extract_all(text, '[a-z]+ing'), lambda x: not contains(x, 'th')), ' ') as rejected from documents")
def filter_reject(spark, d):
    return texts(spark, d).select("doc_id", F.array_join(S.filtered("text", "[a-z]+ing", "th", accept=False), " ").alias("rejected"))


_LINES = "length(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')))"
_SAFE = f"(length(string_split(text, chr(10))) > 4 and {_LINES} >= 4)"


@query(f"select doc_id, case when {_SAFE} then 'normalized' else 'unsafe' end as status, case when {_SAFE} then {_LINES} else 0 end::bigint as n from documents where text is not null")
def br_normalize(spark, d):
    """Documents as pages whose lines are set apart by breaks."""
    made = texts(spark, d).where("text is not null").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("<html><body>"), F.replace(T.html_escape("text"), F.lit("\n"), F.lit("<br/>")), F.lit("</body></html>")).alias("html"))
    out = classify.normalize_breaks(made, M.elements(made))
    return out.select(F.col("page_id").alias("doc_id"), "status", F.regexp_count("html", F.lit("<p>")).cast("long").alias("n"))


_words = lambda words: "[" + ", ".join(f"'{x}'" for x in words) + "]"
_hits = lambda words: f"length(list_filter({_words(words)}, lambda w: contains(compact, w)))"
_FLOW = f"l as (select doc_id, length(string_split(text, chr(10))) as n_lines, {_LINES} as lines, lower(regexp_replace({_ESCAPED}, '[\\s\\x{{3000}}]', '', 'g')) as compact, string_split(text, chr(10)) as every from documents where text is not null)"


def _paged(spark, d, before, between, after):
    """Documents as pages, their lines set apart."""
    return texts(spark, d).where("text is not null").select(F.col("doc_id").alias("page_id"), F.concat(F.lit(before), F.replace(T.html_escape("text"), F.lit("\n"), F.lit(between)), F.lit(after)).alias("html"))


@query(f"""with {_FLOW} select doc_id, (n_lines - 1)::bigint as n_br, lines::bigint as candidates, case when {_hits(layout.CONTENTS)} > 0 then 'toc-like' when n_lines = 1 or lines = 0 then 'no-candidate'
 when lines <= 25 and ({_hits(layout.BR_NOTICES)} > 0 or {_hits(layout.BR_IMPRINT)} >= 2) then 'notice-or-imprint' when lines < 4 or n_lines < 5 then 'short-flow' else 'normal-body-flow' end as kind from l""")
def br_flow_kind(spark, d):
    return layout.br_flow_kind(_paged(spark, d, "<html><body>", "<br/>", "</body></html>")).select(F.col("page_id").alias("doc_id"), "n_br", "candidates", "kind")


@query(f"""with {_FLOW} select doc_id, (n_lines - 1)::bigint as n_spacers, lines::bigint as candidates, case when {_hits(layout.CONTENTS)} > 0 then 'toc-like' when n_lines = 1 or lines = 0 then 'no-candidate'
 when lines <= 25 and ({_hits(layout.KFX_NOTICES)} > 0 or {_hits(layout.KFX_IMPRINT)} >= 3) then 'notice-or-imprint' when lines < 12 or n_lines < 5 then 'short-flow' else 'normal-body-flow' end as kind from l""")
def kfx_flow_kind(spark, d):
    made = _paged(spark, d, "<html><body>", '<p class="s" style="height: 1.5em"> </p>', "</body></html>")
    return layout.kfx_flow_kind(made).select(F.col("page_id").alias("doc_id"), "n_spacers", "candidates", "kind")


@query(f"""with {_FLOW}, p as (select *, length(list_filter(every, lambda x: regexp_matches(regexp_replace(x, '\\s+', '', 'g'), '^[*＊※◆◇■□●○★☆§~〜\\-—–_=+.·•・…|]{{1,16}}$'))) as scenes from l),
 q as (select *, n_lines >= 2 and lines >= 0.75 * n_lines as parent, n_lines < 5 as short, lines - scenes as pars, length(compact) as chars from p)
 select doc_id, case when parent then pars end::bigint as n_paragraphs, case when not parent then 'no-candidate' when {_hits(layout.CONTENTS)} > 0 then 'toc-like'
 when pars <= 25 and (({_hits(layout.DIV_NOTICES)} > 0 and (short or pars <= 6 or chars < 600)) or {_hits(layout.DIV_IMPRINT)} >= 3) then 'notice-or-imprint' when pars < 12 or short then 'short-flow' else 'normal-body-flow' end as kind from q""")
def div_flow_kind(spark, d):
    made = _paged(spark, d, "<html><head><title></title></head><body><div><div>", "</div><div>", "</div></div></body></html>")
    els = dealt(Scratch(spark, "divs").table(M.elements(made), "elements"), "doc", like=made)
    return layout.div_flow_kind(made, els, pages.element_texts(made, els)).select(F.col("page_id").alias("doc_id"), "n_paragraphs", "kind")


@query(f"select page_id, {_P}::bigint as removed from pages")
def kfx_normalize(spark, d):
    return classify.spacer_paragraphs(put(spark, d, "<p>", "<p style='height: 0'>&nbsp;</p><p>")).select("page_id", "removed")


@query("with l as (select doc_id, length(string_split(text, chr(10))) as n from documents where text is not null) select doc_id, n::bigint as n from l where n >= 4")
def div_normalize(spark, d):
    """Documents as pages of one div for each line."""
    rows = texts(spark, d).where("text is not null")
    made = rows.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("<body><div>"), F.replace(T.html_escape("text"), F.lit("\n"), F.lit("</div><div>")), F.lit("</div></body>")).alias("html"))
    return classify.div_normalize(made, M.elements(made)).select(F.col("page_id").alias("doc_id"), "n")


@query("select page_id, case page_id % 4 when 0 then 'vertical' when 1 then 'vertical' else 'horizontal' end as mode from pages")
def effective_mode(spark, d):
    """Roots with a class of a vertical sheet, styles of their own, or neither."""
    tag = F.element_at(F.array(*map(F.lit, ("<html class='v' ", "<html style='writing-mode:vertical-rl' ", "<html class='v' style='writing-mode:horizontal-tb' ", "<html "))), (F.col("page_id") % 4 + 1).cast("int"))
    marked = put(spark, d, "<html ", tag)
    features = classify.css_layout_features(M.css_declarations(M.css_rules(_sheets(spark, d), "doc", "css", style_blocks=False)))
    return classify.effective_mode(marked, features, marked.select("page_id", F.col("page_id").alias("doc")))


@query(f"with r as (select page_id, html, {_PATH} from pages) select page_id, replace(html, '<html ', '<html class=\"h\" ') as html from r where page_id % 2 = 0")
def convert_direction(spark, d):
    r = links.resources_of(docs(spark, d))
    modes = r.select("page_id", F.when(F.col("page_id") % 2 == 0, "vertical").otherwise("horizontal").alias("mode"))
    return classify.convert_direction(r.select("book", "page_id", "html"), modes, "h").where("converted").select("page_id", "html")


_OVERRIDE = direction.override_css(True)
_V2H = f"""r as (select page_id, html, {_PATH} from pages), g as (select book, length(book) % 5 = 0 as bad, bool_or(page_id % 2 = 0) as any_page from r group by 1),
 f as (select book, 'p' || page_id as path, 'html' as kind, page_id % 2 = 0 as page, replace(html, '<html ', '<html style="margin:0; writing-mode : vertical-rl !important;" ') as text, html from r
  union all select book, 's.css', 'css', true, '/* ' || book || ' */ p.v{{writing-mode:tb-rl; text-orientation:upright; color:red}}', null from g union all select book, 'c.opf', 'opf', true, '<package><' || case when bad then 'spines' else 'spine' end || ' toc="n"/></package>', null from g)"""


@query(f"""with {_V2H} select f.book, path, case when bad or not any_page or not page then text when kind = 'html' then replace(replace(html, '<html ', '<html class="v2h-horizontal" style="margin:0; writing-mode : horizontal-tb !important;" '), '</head>', '<style class="v2h-horizontal">{_OVERRIDE}</style></head>')
 when kind = 'css' then '/* ' || f.book || ' */ p.v{{writing-mode:horizontal-tb; color:red}}' else '<package><!-- layout-progression original=absent applied=ltr -->' || chr(10) || '<spine page-progression-direction="ltr" toc="n"/></package>' end as text,
 not bad and any_page and page as changed from f join g on g.book = f.book""")
def convert_books(spark, d):
    """Books of vertical and horizontal pages, a stylesheet and a package; some packages have no spine, so that their books stay."""
    r = links.resources_of(docs(spark, d))
    vertical = F.replace("html", F.lit("<html "), F.lit('<html style="margin:0; writing-mode : vertical-rl !important;" '))
    path = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    files = r.select("book", path.alias("path"), F.lit("html").alias("kind"), vertical.alias("text"))
    books = r.select("book").distinct()
    css = F.concat(F.lit("/* "), "book", F.lit(" */ p.v{writing-mode:tb-rl; text-orientation:upright; color:red}"))
    opf = F.concat(F.lit("<package><"), F.when(F.length("book") % 5 == 0, "spines").otherwise("spine"), F.lit(' toc="n"/></package>'))
    files = files.unionByName(books.select("book", F.lit("s.css").alias("path"), F.lit("css").alias("kind"), css.alias("text"))).unionByName(books.select("book", F.lit("c.opf").alias("path"), F.lit("opf").alias("kind"), opf.alias("text")))
    modes = r.select("book", path.alias("path"), F.when(F.col("page_id") % 2 == 0, "vertical").otherwise("horizontal").alias("mode"), F.lit(False).alias("fixed"), F.lit(0).alias("risk"))
    return direction.convert_books(files, modes)[0].select("book", "path", "text", "changed")


@query("select doc_id, text from documents where doc_id % 10 <> 3")
def restore(spark, d):
    rows = texts(spark, d).select("doc_id", "text")
    both = V.snapshot(rows.where("doc_id % 10 <> 3"), 1).unionByName(V.snapshot(rows.withColumn("text", F.upper("text")), 2))
    return V.restore(both, 1).select("doc_id", "text")
