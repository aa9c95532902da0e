"""Queries over marked-up pages: tokens, elements, selectors, links and page reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.catalog.register import query, table
from quire.functions import text as T
from quire.operators import checks, layout, links, navigation, pages, pretty, rewrite, selectors, structure, styles
from quire.operators import tokens as M
from quire.plans.scratch import Scratch
from quire.plans.shares import dealt

_q = lambda x: x.replace("'", "''")
_type = lambda t: f"""case when not starts_with({t}, '<') or {t} = '<' then 'text' when starts_with({t}, '<!--') then 'comment' when starts_with({t}, '<![CDATA[') then 'cdata'
 when starts_with({t}, '<!') then 'doctype' when starts_with(lower({t}), '<?xml ') then 'xmlheader' when starts_with({t}, '<?') then 'pi' when starts_with({t}, '</') then 'end'
 when ends_with({t}, '/>') then 'single' else 'begin' end"""  # noqa: E731
_name = r"case when ttype in ('begin','end','single') then lower(regexp_extract(tok, '^</?([^\s/>]*)', 1)) else '' end"
_void = ", ".join(f"'{x}'" for x in M.VOID)


def _tokens(name: str, source: str) -> str:
    return f"""{name} as (select *, {_name} as tname, coalesce(sum(length(tok)) over (partition by doc order by seq rows between unbounded preceding and 1 preceding), 0)::bigint as pos from (
 select *, {_type('tok')} as ttype from (select doc, generate_subscripts(l, 1) - 1 as seq, unnest(l) as tok from (select page_id as doc, regexp_extract_all({source}, '{M.TOKEN}') as l from pages))))"""


TOK = _tokens("tok", "html")
BLANK = f"regexp_replace(html, '{M.SILENT}', '', 'g')"
ELEMENTS = f"""{_tokens('btok', BLANK)},
 tags as (select *, max(seq) over (partition by doc) as last, (ttype = 'single' or tname in ({_void})) as alone from btok),
 lev as (select *, case when not alone then sum(case when alone then 0 when ttype = 'begin' then 1 else -1 end) over (partition by doc, tname order by seq) + case when ttype = 'end' then 1 else 0 end end as level
  from tags where ttype in ('begin', 'single', 'end') and tname <> '' and not (alone and ttype = 'end')),
 par as (select *, lead(ttype) over w as nt, lead(seq) over w as ns from lev window w as (partition by doc, tname, level order by seq)),
 mat as (select doc, seq as s, ns as e from par where ttype = 'begin' and not alone and nt = 'end'),
 bra as (select doc, z, sum(step) over (partition by doc order by z) + (step < 0)::int as d from (select doc, s as z, 1 as step from mat union all select doc, e, -1 from mat)),
 clo as (select doc, z as s, lead(z) over (partition by doc, d order by z) as e from bra), good as (select m.doc, m.s, m.e from mat m join clo c on c.doc = m.doc and c.s = m.s and c.e = m.e),
 b as (select p.doc, p.seq as eid, p.tname, p.tok, p.last, p.alone, (p.alone or g.e is not null) as matched, case when p.alone then p.seq else g.e end as e0 from par p left join good g on g.doc = p.doc and g.s = p.seq where p.ttype <> 'end'),
 el0 as (select b.*, coalesce(e0, (select min(p.e0) from b p where p.doc = b.doc and not p.alone and p.e0 is not null and p.eid < b.eid and p.e0 > b.eid), last) as end_seq from b),
 el1 as (select c.doc, c.eid, c.tname, c.tok, c.end_seq, c.matched, c.alone, (select max(p.eid) from el0 p where p.doc = c.doc and not p.alone and p.eid < c.eid and p.end_seq >= c.end_seq) as parent_eid,
  1 + (select count(*) from el0 p where p.doc = c.doc and not p.alone and p.eid < c.eid and p.end_seq >= c.end_seq) as depth from el0 c),
 el as (select *, row_number() over (partition by doc, parent_eid order by eid) as child_no, row_number() over (partition by doc, parent_eid, tname order by eid) as type_no,
  count(*) over (partition by doc, parent_eid) as n_children, count(*) over (partition by doc, parent_eid, tname) as n_type from el1)"""


def _attr(name: str, tok: str = "tok") -> str:
    """Value of an attribute by a pattern of its own."""
    return f"""nullif(regexp_replace(regexp_extract({tok}, '(?i)[\\s"'']({name}\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+))', 2), '^["'']|["'']$', '', 'g'), '')"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", "html")


def els(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.elements(docs(spark, sf_dir))


# tokens and extraction


@query(f"with {TOK} select doc as page_id, seq, pos, tok, ttype, tname from tok")
def tokens(spark, d):
    return M.tokens(docs(spark, d)).withColumnRenamed("doc", "page_id").select("page_id", "seq", "pos", "tok", "ttype", "tname")


@query(f"""with {TOK}, a as (select doc, seq, tname, unnest(regexp_extract_all(tok, '{_q(M.ATTR)}')) as x from tok where ttype in ('begin', 'single')),
 p as (select doc, seq, tname, lower(regexp_extract(x, '{_q(M.ATTR)}', 1)) as attr, regexp_replace(regexp_extract(x, '{_q(M.ATTR)}', 2), '^["'']|["'']$', '', 'g') as value from a)
 select doc as page_id, seq, tname, attr, value from p""")
def token_attrs(spark, d):
    return M.token_attrs(M.tokens(docs(spark, d), positions=False)).withColumnRenamed("doc", "page_id")


@query(f"with {TOK} select doc as page_id, seq, sum(case ttype when 'begin' then 1 when 'end' then -1 else 0 end) over (partition by doc order by seq)::bigint as depth from tok")
def token_depth(spark, d):
    return M.token_depth(M.tokens(docs(spark, d), positions=False)).select(F.col("doc").alias("page_id"), "seq", "depth")


@query(f"with {ELEMENTS} select doc as page_id, eid, tname, end_seq, matched, parent_eid, depth, child_no, type_no from el")
def match_tags(spark, d):
    return els(spark, d).select(F.col("doc").alias("page_id"), "eid", "tname", "end_seq", "matched", "parent_eid", F.col("depth").cast("long").alias("depth"), F.col("child_no").cast("long").alias("child_no"), F.col("type_no").cast("long").alias("type_no"))


_LANG = _attr("lang")


@query(f"""with {ELEMENTS}, l as (select doc, eid, end_seq, {_LANG} as lang from el where {_LANG} is not null)
 select t.doc as page_id, t.seq, coalesce((select max_by(lang, eid) from l where l.doc = t.doc and l.eid <= t.seq and l.end_seq >= t.seq), 'en') as lang from btok t where t.ttype = 'text'""")
def token_lang(spark, d):
    return pages.token_lang(docs(spark, d), M.spans(docs(spark, d)), default="en").select(F.col("doc").alias("page_id"), "seq", "lang")


@query(f"""with {ELEMENTS}, t as (select doc, seq from btok where ttype = 'text')
 select t.doc as page_id, t.seq, max_by(e.eid, e.eid) as eid, string_agg(e.tname, '/' order by e.eid) as path, bool_or(e.tname = 'body') as in_body from t join el e on e.doc = t.doc and e.eid < t.seq and e.end_seq >= t.seq and not e.alone group by all""")
def element_at(spark, d):
    at = M.tokens(docs(spark, d).withColumn("html", M.blanked("html")), positions=False).where("ttype = 'text'").select("doc", "seq")
    return pages.element_at(M.spans(docs(spark, d)), at).withColumnRenamed("doc", "page_id")


@query(f"with {ELEMENTS} select doc as page_id, eid, {_attr('href')} as href from el where tname = 'a'")
def tags_in(spark, d):
    return els(spark, d).where("tname = 'a'").select(F.col("doc").alias("page_id"), "eid", F.try_element_at(M.attributes("tok"), F.lit("href")).alias("href"))


@query(f"with {TOK} select distinct doc as page_id, tname || '.' || unnest(string_split(cls, ' ')) as class_used from (select *, {_attr('class')} as cls from tok where ttype in ('begin', 'single')) where cls is not null")
def classes_used(spark, d):
    return pages.classes_used(docs(spark, d)).withColumnRenamed("doc", "page_id")


@query(f"""with {TOK} select p.page_id, coalesce(min(length(substr(p.html, 1, t.pos)) - length(replace(substr(p.html, 1, t.pos), chr(10), '')) + 1), -1)::bigint as line
 from pages p left join (select * from tok where ttype = 'begin' and {_attr('class')} = 'ad') t on t.doc = p.page_id group by 1""")
def first_use_of_class(spark, d):
    return pages.first_use_of_class(docs(spark, d), "ad").withColumnRenamed("doc", "page_id")


@query(f"with {TOK} select doc as page_id, row_number() over (partition by doc order by seq) - 1 as n, {_attr('href')} as href from tok where ttype in ('begin', 'single') and {_attr('href')} is not null")
def hrefs(spark, d):
    return M.anchors(docs(spark, d)).select(F.col("doc").alias("page_id"), F.col("n").cast("long").alias("n"), "href")


@query(f"with {TOK} select distinct doc as page_id, {_attr('href')} as link from tok where ttype in ('begin', 'single') and {_attr('href')} is not null")
def href_src(spark, d):
    return pages.href_src(docs(spark, d)).select(F.col("doc").alias("page_id"), "link")


@query(f"select page_id, coalesce(array_to_string(list_filter(regexp_extract_all({BLANK}, '{M.TOKEN}'), lambda x: {_type('x')} = 'text'), ''), '') as text from pages")
def visible_text(spark, d):
    return M.visible_text(docs(spark, d)).withColumnRenamed("doc", "page_id")


_blocks = ", ".join(f"'{x}'" for x in M.BLOCK)


@query(f"""with {ELEMENTS}, o as (select t.doc, t.seq, t.tok, max(e.eid) as eid from btok t join el e on e.doc = t.doc and e.eid < t.seq and e.end_seq >= t.seq and e.tname in ({_blocks}) where t.ttype = 'text' group by all)
 select doc as page_id, eid, string_agg(tok, '' order by seq) as text from o group by all""")
def text_blocks(spark, d):
    return pages.text_blocks(docs(spark, d), M.spans(docs(spark, d))).withColumnRenamed("doc", "page_id")


@query(f"with {TOK}, s as (select doc, seq, tok, sum((tname = 'br')::int) over (partition by doc order by seq) as section from tok) select doc as page_id, section::bigint as section, string_agg(tok, '' order by seq) as text from s group by all")
def split_sections(spark, d):
    return pages.split_sections(docs(spark, d), "br").withColumnRenamed("doc", "page_id")


@query("select page_id, html as text from pages where html <> ''")
def serialize(spark, d):
    return M.serialize(M.tokens(docs(spark, d), positions=False)).withColumnRenamed("doc", "page_id")


_CSS = r"""r as (select page_id as doc, unnest(regexp_extract_all(array_to_string(regexp_extract_all(html, '(?is)<style\b[^>]*>(.*?)</style>', 1), chr(10)), '[^{}]+\{[^{}]*\}')) as rule from pages),
 s as (select doc, trim(unnest(string_split(regexp_extract(rule, '^([^{]*)\{', 1), ','))) as selector, regexp_extract(rule, '\{([^}]*)\}', 1) as body from r)"""


@query(f"with {_CSS} select doc as page_id, selector, body from s")
def css_rules(spark, d):
    return M.css_rules(docs(spark, d)).select(F.col("doc").alias("page_id"), "selector", "body")


@query(f"with {_CSS}, v as (select doc, selector, unnest(string_split(body, ';')) as x from s) select doc as page_id, selector, lower(trim(split_part(x, ':', 1))) as prop, trim(regexp_extract(x, '(?s)^[^:]*:(.*)$', 1)) as value from v where contains(x, ':')")
def css_property_values(spark, d):
    return M.css_declarations(M.css_rules(docs(spark, d))).select(F.col("doc").alias("page_id"), "selector", "prop", "value")


# selectors


def _selected(key: str, selector: str, where: str, texts: str | None = None):
    """texts: which elements' texts the selector asks for."""

    @query(f"with {ELEMENTS} select doc as page_id, eid, tname from el e where {where}", key)
    def run(spark, d):
        found = els(spark, d).drop(*({"depth", "parent_eid", "child_no", "type_no"} - selectors.needs(selector)))
        if texts or ":lang" in selector:  # read twice or more
            found = dealt(Scratch(spark, "selected").table(found, "elements"), "doc", like=docs(spark, d))
        own = pages.element_texts(docs(spark, d), found.where(texts)) if texts else None
        related = any(x in selector for x in (" ", ":has", ":not"))
        return selectors.select(selectors.prepared(pages.with_lang(found, "en") if ":lang" in selector else found, related, selector), selector, own).select(F.col("doc").alias("page_id"), "eid", "tname")

    return run


_cls, _href = _attr("class"), _attr("href")
_up = "exists (select 1 from el p where p.doc = e.doc and not p.alone and p.eid < e.eid and p.end_seq >= e.end_seq and p.tname = '{}')"
_selected("sel_tag", "li", "tname = 'li'")
_selected("sel_class_id", "div.ad", f"tname = 'div' and list_contains(string_split({_cls}, ' '), 'ad')")
_selected("sel_attr", "a[href^='/'][href*=e]", f"tname = 'a' and starts_with({_href}, '/') and contains({_href}, 'e')")
_selected("sel_nth", "li:nth-child(2n+1)", "tname = 'li' and child_no % 2 = 1")
_selected("sel_only", "article:only-of-type", "tname = 'article' and n_type = 1")
_selected("sel_empty_root", ":empty", "not exists (select 1 from el c where c.doc = e.doc and c.parent_eid = e.eid) and not exists (select 1 from btok t where t.doc = e.doc and t.ttype = 'text' and t.seq > e.eid and t.seq <= e.end_seq)", texts="true")
_selected("sel_lang", "p:lang(de)", f"tname = 'p' and (select max_by({_attr('lang', 'l.tok')}, l.eid) from el l where l.doc = e.doc and l.eid <= e.eid and l.end_seq >= e.eid and {_attr('lang', 'l.tok')} is not null) = 'de'")
_selected("sel_child_desc", "nav > ul a", f"tname = 'a' and exists (select 1 from el u join el n on n.doc = u.doc and n.eid = u.parent_eid and n.tname = 'nav' where u.doc = e.doc and u.tname = 'ul' and u.eid < e.eid and u.end_seq >= e.end_seq)")
_selected("sel_sibling", "h1 ~ p", "tname = 'p' and exists (select 1 from el p where p.doc = e.doc and p.parent_eid is not distinct from e.parent_eid and p.child_no < e.child_no and p.tname = 'h1')")
_selected("sel_group", "h1, li:first-child, h1", "tname = 'h1' or (tname = 'li' and child_no = 1)")
_selected("sel_not_has", "li:has(a):not(:last-child)", "tname = 'li' and child_no < n_children and exists (select 1 from el a where a.doc = e.doc and a.tname = 'a' and a.eid > e.eid and a.end_seq <= e.end_seq)")
_selected("sel_text", "p:contains('the')", "tname = 'p' and contains(coalesce((select string_agg(t.tok, '' order by t.seq) from btok t where t.doc = e.doc and t.ttype = 'text' and t.seq > e.eid and t.seq <= e.end_seq), ''), 'the')", texts="tname = 'p'")


@query("select page_id, url from pages where contains(lower(page_id || ' ' || url), 'org/e')")
def report_filter(spark, d):
    return pages.report_filter(docs(spark, d), "ORG/e", ["page_id", "url"]).select("page_id", "url")


# links


_PATH = r"regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as book, regexp_extract(url, '^[a-z]+://[^/?#]*/([^?#]*)', 1) as path"
_LINKS = f"""{TOK}, r as (select page_id, {_PATH} from pages), l as (select doc as page_id, row_number() over (partition by doc order by seq) - 1 as n, {_href} as href from tok where ttype in ('begin', 'single') and {_href} is not null),
 k as (select l.*, r.book, r.path, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then 'external' when starts_with(href, '#') then 'fragment' else 'local' end as kind, ltrim(split_part(href, '#', 1), '/') as target from l join r using (page_id))"""


@query(f"""with {_LINKS}, p as (select book, path, min(page_id) as target_id from r group by 1, 2), t as (select k.*, p.target_id from k left join p on p.book = k.book and p.path = k.target)
 select page_id, n, href, kind, case when kind = 'external' then 'n/a' when target_id is not null then 'yes' else 'no' end as target_exists, exists (select 1 from t b where b.page_id = t.target_id and b.target_id = t.page_id) as is_match from t""")
def link_report(spark, d):
    report = links.link_report(links.resources_of(docs(spark, d)))
    return links.points_back(report).select("page_id", F.col("n").cast("long").alias("n"), "href", "kind", "target_exists", "is_match")


@query(f"with {_LINKS} select k.page_id, n, href from k where kind <> 'external' and not exists (select 1 from r where r.book = k.book and r.path = k.target)")
def broken_links(spark, d):
    return links.broken_links(links.resources_of(docs(spark, d))).select("page_id", F.col("n").cast("long").alias("n"), "href")


@query(f"with {_LINKS} select book, target, count(*) as n_links, count(distinct page_id) as n_pages from k where kind = 'local' group by all")
def link_counts(spark, d):
    return links.link_counts(links.resources_of(docs(spark, d)))


#: Rules in cascade order by page_id % 4: link (-1: the page itself), imports on the way, rule, selector and sheet.
_RULES = """values (1, -1, 0, 0, 'div.ad', null), (1, -1, 0, 1, '.ad', null), (1, 0, 0, 0, '.ad', 't.css'), (2, 0, 0, 0, 'p.ad', 's' || u.doc % 9 || '.css'), (2, 0, 0, 1, 'div .ad', 's' || u.doc % 9 || '.css'),
 (2, 0, 1, 0, '.ad.wide', 'z' || u.doc % 9 % 3 || '.css'), (2, 0, 1, 1, '.ad', 'z' || u.doc % 9 % 3 || '.css'), (2, 1, 0, 0, '.ad', 't.css'), (3, 0, 0, 0, '.ad', 't.css')"""


@query(f"""with {TOK}, u as (select distinct doc, tname, unnest(string_split({_cls}, ' ')) as class from tok where ttype in ('begin', 'single') and {_cls} is not null),
 m as (select u.*, r.* from u, lateral ({_RULES}) r(k, link, step, rule_no, selector, css) where r.k = u.doc % 4 and not contains(selector, ' ') and split_part(selector, '.', 2) = class and split_part(selector, '.', 1) in ('', tname)),
 f as (select *, row_number() over (partition by doc, tname, class order by link, step, rule_no) as n from m) select u.doc as page_id, u.tname, u.class, f.selector, f.css from u left join f on f.doc = u.doc and f.tname = u.tname and f.class = u.class and f.n = 1""")
def class_usage(spark, d):
    """Pages with style blocks, with links to sheets that import others, with one link, and with neither."""
    k, sheet = F.col("page_id") % 4, lambda x: F.concat(F.lit("<link rel=stylesheet href='/"), x, F.lit(".css'>"))
    s = F.concat(F.lit("s"), (F.col("page_id") % 9).cast("string"))
    head = F.when(k == 1, F.concat(F.lit("<style>div.ad{a:b}.ad{a:c}</style>"), sheet(F.lit("t")))).when(k == 2, F.concat(sheet(s), sheet(F.lit("t")))).when(k == 3, sheet(F.lit("t"))).otherwise("")
    resources = links.resources_of(docs(spark, d)).withColumn("html", F.replace("html", F.lit("</head>"), F.concat(head, F.lit("</head>"))))
    books = resources.select("book").distinct()
    n = F.col("n").cast("string")
    many = lambda k, name, css: books.select("book", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("n")).select("book", name.alias("path"), css.alias("css"))
    sheets = many(9, F.concat(F.lit("s"), n, F.lit(".css")), F.concat(F.lit("@import 'z"), (F.col("n") % 3).cast("string"), F.lit(".css'; p.ad{} div .ad{}")))
    sheets = sheets.unionByName(many(3, F.concat(F.lit("z"), n, F.lit(".css")), F.lit(".ad.wide{} .ad{}"))).unionByName(many(1, F.lit("t.css"), F.lit(".ad{}")))
    return links.class_usage(resources, sheets=sheets).select(F.col("doc").alias("page_id"), "tname", "class", "selector", "css")


@query(f"with {_CSS}, {ELEMENTS} select selector, (select min(e.doc) from el e where e.tname = selector) as page_id from (select distinct selector from s)")
def selector_usage(spark, d):
    return links.selector_usage(docs(spark, d), els(spark, d)).withColumnRenamed("doc", "page_id")


@query(f"""with r as (select page_id, {_PATH} from pages), f as (select book, lower(path) as low, count(*) as n, min(path) as path from r group by all)
 select r.page_id, upper(r.path) as target, f.path as fixed from r join f on f.book = r.book and f.low = lower(r.path) and f.n = 1 and f.path <> upper(r.path)""")
def case_fix(spark, d):
    resources = links.resources_of(docs(spark, d))
    wrong = resources.select("page_id", "book", F.upper("path").alias("target"))
    return links.case_fix(wrong, resources).select("page_id", "target", "fixed")


@query(f"with {TOK} select doc as page_id, link, count(*) as n from (select doc, {_href} as link from tok where ttype in ('begin', 'single') union all select doc, {_attr('src')} from tok where ttype in ('begin', 'single')) where link is not null group by all")
def union_links(spark, d):
    return links.union_links(docs(spark, d)).withColumnRenamed("doc", "page_id")


@query("select page_id, true as equal from pages")
def multiset_equal(spark, d):
    before = docs(spark, d)
    after = M.serialize(M.tokens(before, positions=False)).select(F.col("doc").alias("page_id"), F.col("text").alias("html"))
    return links.multiset_equal(before, after).withColumnRenamed("doc", "page_id")


@query(f"""with r as (select {_PATH} from pages), g as (select book, string_split(regexp_extract(min(path), '^(.*)/[^/]*$', 1), '/') as a, string_split(regexp_extract(max(path), '^(.*)/[^/]*$', 1), '/') as b from r group by 1),
 m as (select *, list_position([coalesce(a[i] = b[i], false) for i in range(1, len(a) + 1)], false) as k from g) select book, array_to_string(case when coalesce(k, 0) = 0 then a else a[1:k - 1] end, '/') as prefix from m""")
def common_prefix(spark, d):
    return links.common_prefix(links.resources_of(docs(spark, d)))


@query(f"with r as (select page_id, {_PATH} from pages) select page_id, case when regexp_matches(lower(path), '\\.html?$') then 'application/xhtml+xml' when path like '%.css' then 'text/css' end as media_type, case when regexp_matches(lower(path), '\\.html?$') then 'text' when path like '%.css' then 'style' else 'other' end as grp from r")
def classify_media(spark, d):
    return pages.classify_media(links.resources_of(docs(spark, d))).select("page_id", "media_type", "grp")


# page reports


_WORD = r"[\p{L}]+(?:[''’-][\p{L}]+)*"
_page = f"""{ELEMENTS}, w as (select page_id, round(octet_length(encode(html)) / 1024.0, 2)::double as size_kb, coalesce(length(regexp_extract_all(array_to_string(list_filter(regexp_extract_all({BLANK}, '{M.TOKEN}'), lambda x: {_type('x')} = 'text'), ' '), '{_WORD}')), 0)::bigint as words from pages),
 c as (select doc, count(*) filter (tname = 'img') as images, count(*) filter (tname = 'video') as video, count(*) filter (tname = 'audio') as audio, count(*) filter (tname = 'link') as stylesheets, bool_and(matched)::int as well_formed from el group by 1)"""


@query(f"with {_page} select page_id, sum(size_kb) as size_kb, sum(words)::bigint as words, sum(images)::bigint as images, sum(video)::bigint as video, sum(audio)::bigint as audio, sum(stylesheets)::bigint as stylesheets, sum(well_formed)::bigint as well_formed, grouping(page_id)::int as is_total from (select w.*, coalesce(images, 0) as images, coalesce(video, 0) as video, coalesce(audio, 0) as audio, coalesce(stylesheets, 0) as stylesheets, coalesce(well_formed, 1) as well_formed from w left join c on c.doc = page_id) group by grouping sets ((page_id), ())".replace("sum(size_kb)", "round(sum(size_kb), 1)"))
def html_files_report(spark, d):
    return pages.html_files_report(docs(spark, d), els(spark, d))


_DRAWN = """v as (select page_id, replace(replace(html, '</head>', '<style>p{content:"\\2014\\6c49" "Ω";}</style></head>'), '<h1>', '<h1 title="字' || url || '"><img ALT=''Ж'' src="Я">') as html from pages)"""


@query(f"""with {_DRAWN}, t as (select array_to_string(list_filter(regexp_extract_all({BLANK}, '{M.TOKEN}'), lambda x: {_type('x')} = 'text'), '') as x from v union all select url from pages)
 select codepoint from (select distinct unicode(unnest(string_split(x, '')))::bigint as codepoint from t where x <> '') where codepoint >= 32 and codepoint not between 127 and 159 union select unnest([32, 160, 12288, 8212, 27721, 937, 23383, 1046])""")
def font_usage(spark, d):
    """Pages with generated content, a title and an alternative text in signs of their own."""
    head, title = F.lit('<style>p{content:"\\2014\\6c49" "Ω";}</style></head>'), F.concat(F.lit('<h1 title="字'), "url", F.lit("\"><img ALT='Ж' src=\"Я\">"))
    return pages.font_usage(docs(spark, d).withColumn("html", F.replace(F.replace("html", F.lit("</head>"), head), F.lit("<h1>"), title)))


@query(f"with {_CSS} select distinct unnest(regexp_extract_all(selector, '\\.([-_\\w]+)', 1)) as class from s")
def class_set(spark, d):
    return pages.class_set(M.css_rules(docs(spark, d)))


@query(f"with {TOK} select doc as page_id, string_agg(href, ' ' order by first) as hrefs from (select doc, {_href} as href, min(seq) as first from tok where ttype in ('begin', 'single') and {_href} is not null group by 1, 2) group by 1")
def distinct_lists(spark, d):
    return M.anchors(docs(spark, d)).groupBy(F.col("doc").alias("page_id")).agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("n", "href"))), lambda x: x["href"])), " ").alias("hrefs"))


@query(f"with {ELEMENTS} select doc as page_id, count(*) filter (not matched) as n_unmatched, bool_and(matched) as balanced, bool_or(tname = 'html') and bool_or(tname = 'head') and bool_or(tname = 'body') as has_parts, min(eid) filter (not matched) as first_error from el group by 1")
def balance(spark, d):
    return pages.well_formed(els(spark, d)).withColumnRenamed("doc", "page_id")


#: Faults by page_id % 6, put before the first heading: none, stray, crossing, unclosed, a void element's end, attributes.
_FAULTS = ["", "</em>", "<b>x<i>y</b>z</i>", "<u>", "a</br>", "<i k=v>n</i>"]
_FAULTY = "select page_id, replace(html, '<h1>', case page_id % 6 " + " ".join(f"when {k} then '\n{x}'" for k, x in enumerate(_FAULTS)) + " end || '<h1>') as html from pages"
_CHECKED = f"""v as (select page_id, replace(html, chr(92) || 'n', chr(10)) as html from ({_FAULTY})), {_tokens('tok0', 'html').replace('from pages', 'from v').replace("'" + M.TOKEN + "'", "'" + M.SILENT + "|" + M.TOKEN + "'")},
 btok as (select doc, seq, tok, pos, tname, case when regexp_matches(tok, '^(?is)<(script|style).*</') then 'silent' else ttype end as ttype from tok0), {ELEMENTS[ELEMENTS.index(' tags as'):ELEMENTS.index(' el1 as')].rstrip().rstrip(',')},
 f as (select p.doc, p.seq, case when m.s is not null and g.s is null then 'crossing' when p.ttype = 'begin' and not p.alone and m.s is null then 'unclosed' end as code from par p left join mat m on m.doc = p.doc and m.s = p.seq left join good g on g.doc = p.doc and g.s = p.seq
  union all select p.doc, p.seq, case when m.e is not null and g.e is null then 'crossing' when m.e is null then 'stray' end from par p left join mat m on m.doc = p.doc and m.e = p.seq left join good g on g.doc = p.doc and g.e = p.seq where p.ttype = 'end'
  union all select doc, seq, 'void-end' from btok where ttype = 'end' and tname in ({_void}) union all select doc, seq, 'attributes' from btok where ttype in ('begin', 'single') and not regexp_matches(tok, '^<[^\\s/>]+(?:\\s+[^\\s=<>"''/]+(?:\\s*=\\s*(?:"[^"]*"|''[^'']*''))?)*\\s*/?>$')
  union all select doc, seq, 'sign' from btok where tok = '<'
  union all select b.doc, b.seq, 'nested-p' from btok b where b.ttype = 'begin' and b.tname = 'p' and exists (select 1 from el0 o where o.doc = b.doc and o.tname = 'p' and not o.alone and o.eid < b.seq and o.end_seq >= b.seq)),
 w as (select f.doc as page_id, f.code, length(substr(html, 1, pos)) - length(replace(substr(html, 1, pos), chr(10), '')) + 1 as line, pos - coalesce(length(substr(html, 1, pos)) - strpos(reverse(substr(html, 1, pos)), chr(10)) + 1, 0) * (contains(substr(html, 1, pos), chr(10)))::int + 1 as col
  from f join btok b on b.doc = f.doc and b.seq = f.seq join v on v.page_id = f.doc where f.code is not null)"""


def _faulty(spark, d):
    fault = F.element_at(F.array(*(F.lit(f"\n{x}") for x in _FAULTS)), (F.col("page_id") % 6 + 1).cast("int"))
    return docs(spark, d).withColumn("html", F.replace("html", F.lit("<h1>"), F.concat(fault, F.lit("<h1>"))))


@query(f"with {_CHECKED} select page_id, line, col, code from w")
def page_issues(spark, d):
    """All issues of pages with planted faults but those that the pages have by nature."""
    return checks.issues(_faulty(spark, d)).where("code not in ('parts', 'order', 'link-type', 'id-twice', 'twice')").select(F.col("doc").alias("page_id"), "line", "col", "code")


@query(f"with {_CHECKED} select v.page_id, count(*) filter (code = 'unclosed') as n_unclosed, count(*) filter (code = 'stray') as n_stray, count(*) filter (code = 'crossing') as n_crossing, coalesce(bool_and(code not in ('unclosed', 'stray', 'crossing')), true) as balanced, min((line, col)).a as line, min((line, col)).b as col from v left join (select page_id, code, line, col from w) using (page_id) group by 1".replace("min((line, col)).a", "min({'a': line, 'b': col}).a").replace("min((line, col)).b", "min({'a': line, 'b': col}).b"))
def well_formed(spark, d):
    rows = _faulty(spark, d)
    return checks.well_formed(rows, checks.issues(rows)).select(F.col("doc").alias("page_id"), "n_unclosed", "n_stray", "n_crossing", "balanced", "line", "col")


#: What is put into every eighth page, so that each signal of a layout stands in some.
_PUT = {
    1: ("<html ", '<html style="writing-mode: vertical-rl" '), 2: ("</head>", '<meta name="viewport" content="width=600, height=800"></head>'), 3: ("<p>", '<p style="position:absolute">'),
    4: ("</head>", "<style>.a{-epub-writing-mode:vertical-rl} .b{writing-mode : horizontal-tb}</style></head>"), 5: ("</head>", '<style>html{writing-mode:vertical-rl !important}</style><svg><text>x</text></svg></head>'),
    6: ("<nav", '<nav epub:type="toc"'), 7: ("</head>", "<style>p{transform:rotate(3deg)} html{writing-mode:tb-rl}</style></head>"),
}
_VARIED = "case page_id % 8 " + " ".join(f"when {k} then replace(html, '{a}', '{_q(b)}')" for k, (a, b) in _PUT.items()) + " else html end"


def varied(spark, d):
    html = F.col("html")
    for k, (old, new) in _PUT.items():
        html = F.when(F.col("page_id") % 8 == k, F.replace("html", F.lit(old), F.lit(new))).otherwise(html)
    return docs(spark, d).withColumn("html", html)


_list = lambda rx: f"length(list_filter(decls, lambda x: regexp_matches(x, '{_q(rx)}')))"
_n = lambda names, source="rest": f"length(regexp_extract_all({source}, '(?i)<(?:{names})[\\s/>]'))"
_layout = f"""v as (select page_id, {_VARIED} as html from pages), r as (select page_id, html, {BLANK} as rest from v),
 t as (select *, regexp_extract_all(rest, '{_q(layout.TAG)}') as tags from r),
 s as (select *, list_concat(list_filter(list_transform(tags, lambda x: regexp_extract(x, '{_q(layout._STYLE)}', 1) || regexp_extract(x, '{_q(layout._STYLE)}', 2)), lambda x: x <> ''), regexp_extract_all(html, '(?is)<style[^<>]*>(.*?)</style>', 1)) as css from t),
 c as (select *, list_transform(flatten(list_transform(css, lambda x: regexp_extract_all(lower(x), '{layout.DECLARATION}'))), lambda x: trim(x)) as decls from s),
 f as (select page_id, {_list(layout.ABSOLUTE)} as n_abs, {_list(layout.ROTATE)} as n_rot, {_list(layout.VERTICAL)} > 0 as ver, {_list(layout.HORIZONTAL)} > 0 as hor, regexp_matches(rest, '(?is)<svg[\\s>].*<text[\\s>].*</svg>') as svg_text, {_n('svg')} as n_svg,
  {_n('table')} as n_table, {_n('img|image')} as n_image, {_n('script', 'html')} as n_script, contains(rest, 'name="viewport" content="width=600, height=800"') as fixed, length(list_filter(tags, lambda x: regexp_matches(x, '{_q(layout.NAV)}'))) > 0 as nav,
  list_sum(list_transform(regexp_split_to_array(rest, '{layout.PIECES}'), lambda x: length(trim(regexp_replace(x, '&[#A-Za-z0-9]+;', 'x', 'g'), chr(32) || chr(9) || chr(10) || chr(13))))) as chars from c),
 k as (select *, greatest(0, least(100, (case when fixed then 30 else 0 end) + (case when n_abs > 2 then 20 when n_abs > 0 then 10 else 0 end) + (case when svg_text and ver then 20 else 0 end) + (case when ver and hor then 15 else 0 end) + (case when n_rot > 0 then 15 else 0 end)
  + (case when n_script > 0 and (n_abs > 0 or ver) then 10 else 0 end) + (case when nav then 5 else 0 end) - (case when ver and not hor and n_abs + n_rot + n_table + n_svg = 0 and chars >= 300 then 10 else 0 end)))::bigint as risk from f),
 kinds as (select *, case when fixed then 'fixed-layout' when svg_text and ver then 'svg-text-layout' when nav then 'toc-or-nav' when n_image > 0 and chars <= 2 then 'image-only' when n_script > 0 and n_abs > 0 then 'script-driven'
  when ver and hor then 'mixed-writing-mode' when ver and risk >= 50 then 'reflow-vertical-review' when ver then 'reflow-vertical-safe' when chars > 0 and chars < 400 then 'title-or-colophon' else 'already-horizontal' end as kind from k)"""


@query(f"with {_layout} select page_id, n_abs::bigint as n_absolute, n_rot::bigint as n_rotate, ver as vertical, hor as horizontal, n_image::bigint as n_image, n_script::bigint as n_script, chars::bigint as chars, kind, risk from kinds")
def page_layout_features(spark, d):
    return layout.layout(varied(spark, d)).select("page_id", "n_absolute", "n_rotate", "vertical", "horizontal", "n_image", "n_script", "chars", "kind", "risk")


@query(f"with {_layout}, {ELEMENTS.replace('from pages', 'from v')}, w as (select doc, bool_and(matched) as balanced from el group by 1) select page_id, case when coalesce(balanced, true) then kind else 'parse-error' end as kind from kinds left join w on doc = page_id")
def page_kind(spark, d):
    """Kinds of pages; unbalanced ones are parse errors."""
    pages_ = varied(spark, d)
    balanced = pages.well_formed(M.elements(pages_)).select(F.col("doc").alias("page_id"), "balanced")
    return layout.layout(pages_, balanced).select("page_id", "kind")


@query(f"with {_layout} select case when risk < 25 then 'auto-safe' when risk < 50 then 'auto-safe-with-warnings' when risk < 75 then 'manual-review' else 'unsupported' end as level, count(*) as n from k group by 1")
def risk_score(spark, d):
    return layout.layout(varied(spark, d)).groupBy("level").agg(F.count("*").alias("n"))


@query(f"with {ELEMENTS} select doc as page_id, eid as seq, 'error' as severity, 'unclosed ' || tname as message from el where not matched")
def issues_report(spark, d):
    return pages.unclosed_issues(els(spark, d)).withColumnRenamed("doc", "page_id")


@query("select page_id, case page_id % 4 when 0 then 'missing media type' when 1 then 'unchecked' when 2 then 'valid' else 'invalid' end as status, case page_id % 4 when 0 then 1 when 3 then 1 else 0 end::bigint as n_issues, case when page_id % 4 = 3 then 2 end as line, case when page_id % 4 = 3 then length(url) + 4 end as col from pages")
def validate_staged(spark, d):
    """Staged package files of four kinds: without a media type, a sheet, well-formed, and with a stray end tag."""
    k, path = F.col("page_id") % 4, F.col("page_id").cast("string")
    url = F.replace("url", F.lit("&"), F.lit("+"))
    text = F.concat(F.lit("<package>\n<a>"), url, F.when(k == 3, "</b>").otherwise(""), F.lit("</a><meta>x</meta></package>"))
    kind = F.when(k == 1, "text/css").when(k == 2, "application/oebps-package+xml; charset=utf-8").when(k == 3, "IMAGE/SVG+XML")
    found = checks.validate_staged(docs(spark, d).select(path.alias("path"), kind.alias("media_type"), text.alias("text")))
    return found.select(F.col("path").cast("long").alias("page_id"), "status", "n_issues", "line", "col")


@query(f"with {ELEMENTS} select doc as page_id, bool_and(matched) as valid from el group by 1")
def staged_balance(spark, d):
    return pages.validate(els(spark, d), docs(spark, d).select(F.col("page_id").alias("doc"))).withColumnRenamed("doc", "page_id")


@query(f"with {ELEMENTS} select 'a:hover' as selector, count(*) as n, '' as note from el where tname = 'a' union all select 'ul > li', count(*), '' from el c join el p on p.doc = c.doc and p.eid = c.parent_eid where c.tname = 'li' and p.tname = 'ul' union all select unnest(['p[', '..x']), 1, '{selectors.PARSE_ERROR}'")
def sel_error(spark, d):
    """Selectors that can't be parsed count as used, with a note."""
    ready = selectors.prepared(els(spark, d))
    told = lambda x: selectors.selects_or_error(ready, x).groupBy("note").agg(F.count("*").alias("n")).select(F.lit(x).alias("selector"), "n", "note")
    return told("a:hover").unionByName(told("ul > li")).unionByName(told("p[")).unionByName(told("..x"))


# structure


_HEAD = f"""{ELEMENTS}, h as (select e.doc, e.eid, case e.tname when 'h1' then 1 when 'ul' then 2 when 'li' then 3 when 'p' then 4 end as level, case when e.tname in ('h1', 'p', 'li') then e.tname else 'ul' end as tname from el e where e.tname in ('h1', 'ul', 'li', 'p'))"""
_PARENT = f"{_HEAD}, pr as (select h.*, (select max(g.eid) from h g where g.doc = h.doc and g.eid < h.eid and g.level < h.level) as parent from h)"


@query(f"with {ELEMENTS} select e.doc as page_id, e.eid as seq, substr(e.tname, 2)::bigint as level, trim(regexp_replace(coalesce((select string_agg(t.tok, '' order by t.seq) from btok t where t.doc = e.doc and t.ttype = 'text' and t.seq > e.eid and t.seq <= e.end_seq), ''), '\\s+', ' ', 'g')) as text, row_number() over (partition by e.doc order by e.eid) = 1 as at_file_start from el e where regexp_matches(e.tname, '^h[1-6]$')")
def headings(spark, d):
    return structure.headings(docs(spark, d), els(spark, d)).select(F.col("doc").alias("page_id"), "seq", "level", "text", "at_file_start")


@query(f"with {_PARENT} select doc as page_id, eid as seq, level::bigint as level, parent as parent_seq from pr")
def heading_tree(spark, d):
    levels = {"h1": 1, "ul": 2, "li": 3, "p": 4}
    return structure.heading_tree(structure.pseudo_headings(els(spark, d), levels)).select(F.col("doc").alias("page_id"), "seq", F.col("level").cast("long").alias("level"), "parent_seq")


@query(f"""with {ELEMENTS}, r as (select page_id, {_PATH} from pages), h as (select e.doc, e.eid, substr(e.tname, 2)::bigint as level, row_number() over (partition by e.doc order by e.eid) = 1 as first,
  trim(regexp_replace(coalesce((select string_agg(t.tok, '' order by t.seq) from btok t where t.doc = e.doc and t.ttype = 'text' and t.seq > e.eid and t.seq <= e.end_seq), ''), '\\s+', ' ', 'g')) as title from el e where regexp_matches(e.tname, '^h[1-6]$')),
 up as (select h.doc, h.eid, count(*) as n from h join h g on g.doc = h.doc and g.eid < h.eid where g.level < (select min(m.level) from h m where m.doc = h.doc and m.eid > g.eid and m.eid <= h.eid) group by all)
 select r.book, r.path, h.eid as seq, h.level, 1 + coalesce(up.n, 0) as lvl, h.title, r.path || case when h.first then '' else '#h' || h.eid end as href from h join r on r.page_id = h.doc left join up on up.doc = h.doc and up.eid = h.eid""")
def build_toc(spark, d):
    """The entries of all headings; they are written once, without their places in the tree of elements."""
    found = docs(spark, d)
    heads = dealt(Scratch(spark, "toc").table(M.spans(found).where(structure.IS_HEADING), "headings"), "doc", like=found)
    return structure.build_toc(structure.headings(found, heads), links.resources_of(found))


@query(f"with {ELEMENTS} select doc as page_id, eid as seq, row_number() over (partition by doc order by eid) as play_order from el where tname = 'a'")
def play_order(spark, d):
    return structure.play_order(els(spark, d).where("tname = 'a'")).select(F.col("doc").alias("page_id"), F.col("eid").alias("seq"), "play_order")


@query(f"with {ELEMENTS}, l as (select a.doc, a.eid, (select count(*) from el u where u.doc = a.doc and u.tname in ('ul', 'ol') and u.eid < a.eid and u.end_seq >= a.end_seq) as lvl from el a where a.tname = 'a' and exists (select 1 from el n where n.doc = a.doc and n.tname = 'nav' and n.eid < a.eid and n.end_seq >= a.end_seq)) select doc as page_id, max(lvl) as toc_depth from l group by 1")
def toc_depth(spark, d):
    return structure.nav_entries(docs(spark, d), els(spark, d)).groupBy(F.col("doc").alias("page_id")).agg(F.max("lvl").alias("toc_depth"))


_NAV = f"""{ELEMENTS}, l as (select a.doc, a.eid, {_attr('href', 'a.tok')} as href, (select count(*) from el u where u.doc = a.doc and u.tname in ('ul', 'ol') and u.eid < a.eid and u.end_seq >= a.end_seq) as lvl,
 coalesce((select string_agg(t.tok, '' order by t.seq) from btok t where t.doc = a.doc and t.ttype = 'text' and t.seq > a.eid and t.seq <= a.end_seq), '') as title from el a where a.tname = 'a' and exists (select 1 from el n where n.doc = a.doc and n.tname = 'nav' and n.eid < a.eid and n.end_seq >= a.end_seq))"""


@query(f"with {_NAV} select doc as page_id, row_number() over (partition by doc order by eid) as pos, lvl, title, href from l")
def nav_links(spark, d):
    return structure.nav_entries(docs(spark, d), els(spark, d)).select(F.col("doc").alias("page_id"), "pos", "lvl", "title", "href")


#: The menu of a page as a table of contents of two levels, a page list and landmarks.
_MENU = [
    ("<nav><ul>", '<nav epub:type="toc"><ol><li><a href="top.html">Top</a><ul>'),
    ("</ul></nav>", '</ul></li><li><a href="end.html">The <b>End</b></a></li></ol></nav><nav epub:type="page-list"><ol><li><a href="#p1">1</a></li></ol></nav><nav epub:type="landmarks"><ol><li><a epub:type="cover" href="c.html">Cover</a></li></ol></nav>'),
]
_MENUS = """m as (select page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) as nav from pages where contains(html, '<nav>')),
 l as (select page_id, regexp_extract_all(nav, '<a href="([^"]*)">([^<]*)</a>', 1) as hs, list_transform(regexp_extract_all(nav, '<a href="([^"]*)">([^<]*)</a>', 2), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) as ts from m)"""


def _menus(spark, d):
    html = F.col("html")
    for old, new in _MENU:
        html = F.replace(html, F.lit(old), F.lit(new))
    with_menu = docs(spark, d).withColumn("html", html)
    return navigation.nav_tables(with_menu, M.elements(with_menu))


@query(f"""with {_MENUS} select page_id, section, pos::bigint as pos, lvl::bigint as lvl, title, href, kind from (select page_id, 'toc' as section, 1 as pos, 1 as lvl, 'Top' as title, 'top.html' as href, null as kind from l union all select page_id, 'toc', 1 + generate_subscripts(hs, 1), 2, unnest(ts), unnest(hs), null from l
 union all select page_id, 'toc', 2 + len(hs), 1, 'The End', 'end.html', null from l union all select page_id, 'page-list', 1, 1, '1', '#p1', null from l union all select page_id, 'landmarks', 1, 1, 'Cover', 'c.html', 'cover' from l)""")
def nav_tables(spark, d):
    return _menus(spark, d).withColumnRenamed("doc", "page_id")


_POINT = "'<navPoint id=\"navPoint' || {0} || '\" playOrder=\"' || {0} || '\"><navLabel><text>' || {1} || '</text></navLabel><content src=\"' || {2} || '\"/>'".format
_META = "'<meta name=\"dtb:{}\" content=\"' || {} || '\"/>'".format


@query(f"""with {_MENUS} select page_id, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head>' || {_META("uid", "''")} || {_META("depth", "case when len(hs) > 0 then 2 else 1 end")} || {_META("totalPageCount", "1")} || {_META("maxPageNumber", "1")}
 || '</head><docTitle><text></text></docTitle><navMap>' || {_POINT("1", "'Top'", "'top.html'")} || coalesce(array_to_string([{_POINT("(i + 1)", "ts[i]", "hs[i]")} || '</navPoint>' for i in range(1, len(hs) + 1)], ''), '') || '</navPoint>' || {_POINT("(len(hs) + 2)", "'The End'", "'end.html'")} || '</navPoint></navMap><pageList><pageTarget id="navPoint'
 || (len(hs) + 3) || '" type="normal" playOrder="' || (len(hs) + 3) || '" value="1"><navLabel><text>1</text></navLabel><content src="#p1"/></pageTarget></pageList></ncx>' as ncx from l""")
def ncx_from_nav(spark, d):
    return navigation.ncx(_menus(spark, d)).withColumnRenamed("doc", "page_id")


@query(f"""with {_MENUS} select page_id, section, pos::bigint as pos, lvl::bigint as lvl, title, href from (select page_id, 'toc' as section, 1 as pos, 1 as lvl, 'Top' as title, 'top.html' as href from l union all select page_id, 'toc', 1 + generate_subscripts(hs, 1), 2, unnest(ts), unnest(hs) from l
 union all select page_id, 'toc', 2 + len(hs), 1, 'The End', 'end.html' from l union all select page_id, 'page-list', 1, 1, '1', '#p1' from l)""")
def read_ncx(spark, d):
    return navigation.read_ncx(navigation.ncx(_menus(spark, d))).select(F.col("doc").alias("page_id"), "section", "pos", "lvl", "title", "href")


@query(f"""with r as (select page_id, book, path, string_split(path, '/') as parts from (select page_id, {_PATH} from pages)), t as (select page_id, book, k, array_to_string(parts[-k:], '/') as tail from r, unnest(range(1, len(parts) + 1)) as u(k)),
 n as (select *, count(*) over (partition by book, tail) as c, max(k) over (partition by page_id) as most from t) select page_id, coalesce(min_by(tail, k) filter (c = 1), max_by(tail, k)) as short_path from n group by 1""")
def short_paths(spark, d):
    return structure.short_paths(links.resources_of(docs(spark, d))).select("page_id", "short_path")


# functions on links


@query(f"with {TOK}, l as (select distinct {_href} as href from tok where {_href} is not null) select href, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then 'external' when starts_with(href, '#') then 'fragment' else 'local' end as kind from l")
def is_external(spark, d):
    return M.anchors(docs(spark, d)).select("href").distinct().select("href", T.link_kind("href").alias("kind"))


@query(f"with {TOK} select distinct {_href} as href, {_href} as back from tok where {_href} is not null")
def url_codec(spark, d):
    return M.anchors(docs(spark, d)).select("href").distinct().select("href", T.url_decode(T.url_encode("href")).alias("back"))


@query(f"with r as (select page_id, {_PATH} from pages) select page_id, regexp_extract(path, '^(.*)/[^/]*$', 1) as folder, regexp_extract(path, '([^/]*)$', 1) as name, regexp_extract(path, '^(.*)/[^/]*$', 1) || case when path like '%/%' then '/' else '' end || 'x.html' as resolved, '../' || path as rel from r")
def path_algebra(spark, d):
    r = links.resources_of(docs(spark, d))
    return r.select("page_id", T.folder("path").alias("folder"), T.file_name("path").alias("name"), T.resolve("path", F.lit("./y/../x.html#f")).alias("resolved"), T.relative(F.lit("top/a.html"), F.col("path")).alias("rel"))


@query(f"select page_id, array_to_string(list_transform(regexp_extract_all(html, '{M.TOKEN}'), lambda x: case when {_type('x')} = 'text' then upper(replace(x, 'ß', 'SS')) else x end), '') as html from pages")
def case_text_only(spark, d):
    return pages.case_text_only(docs(spark, d), F.upper).select("page_id", "html")


@query(f"""select page_id, replace(html, 'class="ad"', 'class="advert"') as html, (length(html) - length(replace(html, 'class="ad"', ''))) // 10 as n from pages where html like '%class="ad"%'""")
def rename_class(spark, d):
    return pages.rename_class(docs(spark, d), "ad", "advert").select("page_id", "html", "n")


@query(f"with {_CSS}, k as (select distinct body from s) select body, 'auto_' || dense_rank() over (order by body) as class, (select count(distinct doc) from s where s.body = k.body) as n_pages from k")
def extract_styles(spark, d):
    return pages.extract_styles(M.css_rules(docs(spark, d)))


_STYLED = """v as (select page_id, replace(replace(html, '<p>', case page_id % 3 when 0 then '<p style="COLOR: red;  margin:0">' when 1 then '<p class=''k'' style=''margin:0;color:red;''>' else '<p>' end), '<h1>', case when page_id % 2 = 0 then '<h1 style="margin-left:1px;margin:2px">' else '<h1>' end) as html from pages)"""


def _styled(spark, d):
    k = F.col("page_id") % 3
    p = F.when(k == 0, '<p style="COLOR: red;  margin:0">').when(k == 1, "<p class='k' style='margin:0;color:red;'>").otherwise("<p>")
    h = F.when(F.col("page_id") % 2 == 0, '<h1 style="margin-left:1px;margin:2px">').otherwise("<h1>")
    return docs(spark, d).select("page_id", F.replace(F.replace("html", F.lit("<p>"), p), F.lit("<h1>"), h).alias("html"))


@query(f"""with {_STYLED} select page_id, replace(replace(replace(replace(html, '<p style="COLOR: red;  margin:0">', '<p class="auto_1">'), '<p class=''k'' style=''margin:0;color:red;''>', '<p class=''k auto_1''>'), '<h1 style="margin-left:1px;margin:2px">', '<h1 class="auto_2">'), '</head>', '<link rel="stylesheet" type="text/css" href="auto.css"/></head>') as html,
 len(regexp_extract_all(html, '<(p|h1)[^<>]* style='))::bigint as n from v where contains(html, ' style=')""")
def inline_styles(spark, d):
    """Pages in which two ways to write one style, and one whose order matters, have become two classes."""
    return styles.extract_inline_styles(_styled(spark, d), "auto.css")[0]


@query(f"with {_STYLED}, e as (select unnest(regexp_extract_all(html, '<(p|h1)[^<>]* style=', 1)) as t from v) select case t when 'p' then 'auto_1' else 'auto_2' end as class, case t when 'p' then 'color: red; margin: 0' else 'margin-left: 1px; margin: 2px' end as body, count(*) as n_elements from e group by t")
def inline_style_rules(spark, d):
    return styles.extract_inline_styles(_styled(spark, d), "auto.css")[1]


@query("""select page_id, replace(replace(html, 'class="ad"', 'class="advert"'), '<style>p{margin:0}</style>', '<style>p.advert > .ad-x, .ad{margin:0} /* .ad */</style>') as html from pages where contains(html, 'class="ad"') or contains(html, '<style>p{margin:0}</style>')""")
def rename_classes(spark, d):
    """Two classes exchange their names in the class attributes and style blocks of pages."""
    rows = docs(spark, d).withColumn("html", F.replace("html", F.lit("<style>p{margin:0}</style>"), F.lit("<style>p.ad > .ad-x, .advert{margin:0} /* .ad */</style>")))
    sheets = spark.createDataFrame([], "path string, css string")
    return styles.rename_classes(rows, sheets, {"ad": "advert", "advert": "ad"})[0]


# rewrites and SQL



@query(f"""with {TOK}, l as (select doc, seq, tok, {_href} as link from tok where ttype in ('begin', 'single')), c as (select doc, seq, replace(tok, '"' || link || '"', '"moved' || link || '"') as new from l where starts_with(link, '/') and length(link) % 5 = 0 and regexp_matches(link, '^/[a-z]+$'))
 select t.doc as page_id, string_agg(coalesce(c.new, t.tok), '' order by t.seq) as html from tok t left join c on c.doc = t.doc and c.seq = t.seq group by 1 having count(c.new) > 0""")
def apply_renames(spark, d):
    """Files whose root-relative path has a length divisible by 5 move below moved/; pages are taken as files of the book's root."""
    resources = links.resources_of(docs(spark, d)).withColumn("path", F.lit("page.html"))
    targets = links.local_links(resources).where("length(href) % 5 = 0 and href rlike '^/[a-z]+$'").select("book", "target").distinct()
    return rewrite.apply_renames(resources, targets.select("book", F.col("target").alias("old_path"), F.concat(F.lit("moved/"), "target").alias("new_path"))).select("page_id", "html")


@query(f"with {ELEMENTS}, e as (select doc, bool_and(matched) as ok from el group by 1) select page_id, case when not coalesce(ok, true) then 'skipped' when regexp_matches(html, '[ \\t]+\\r?\\n') then 'formatted' else 'unchanged' end as status from pages left join e on e.doc = page_id")
def trim_line_ends(spark, d):
    return rewrite.format_status(els(spark, d), docs(spark, d)).withColumnRenamed("doc", "page_id")


_LINES = """m as (select page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) as nav, url from pages), l as (select page_id, url, regexp_extract_all(nav, '<li>.*?</li>') as items from m)"""


@query(f"""with {_LINES} select page_id, case when page_id % 5 = 0 then 'skipped' else 'formatted' end as status, case when page_id % 5 = 0 then '<html><head> <title>' || url || '</title></head><body><nav><ul>' || array_to_string(items, ' ') || '</ul></nav><p>a <b>b</b></p><pre> x' || chr(10) || '  <i>y</i> </pre><p></p></em></body></html>' else
 '<html>' || chr(10) || '  <head>' || chr(10) || '    <title>' || url || '</title>' || chr(10) || '  </head>' || chr(10) || '  <body>' || chr(10) || '    <nav>' || chr(10) || '      <ul>' || array_to_string([chr(10) || '        ' || x for x in items], '') || case when len(items) > 0 then chr(10) || '      ' else '' end || '</ul>' || chr(10) || '    </nav>' || chr(10)
 || '    <p>a <b>b</b></p>' || chr(10) || '    <pre> x' || chr(10) || '  <i>y</i> </pre>' || chr(10) || '    <p></p>' || chr(10) || '  </body>' || chr(10) || '</html>' end as html from l""")
def format_markup(spark, d):
    """Pages made of each page's menu; every fifth has a stray end tag."""
    items = F.array_join(F.regexp_extract_all(F.regexp_extract("html", "(?s)<nav>(.*?)</nav>", 1), F.lit("<li>.*?</li>"), F.lit(0)), " ")
    parts = [F.lit("<html><head> <title>"), F.col("url"), F.lit("</title></head><body><nav><ul>"), items, F.lit("</ul></nav><p>a <b>b</b></p><pre> x\n  <i>y</i> </pre><p></p>"), F.when(F.col("page_id") % 5 == 0, "</em>").otherwise(""), F.lit("</body></html>")]
    return pretty.pretty(docs(spark, d).select("page_id", F.concat(*parts).alias("html")))


@query(f"select tag, count(*) as n from (select unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) as tag from pages) group by 1")
def tokens_tvf(spark, d):
    docs(spark, d).createOrReplaceTempView("quire_pages")
    return spark.sql("select tag, count(*) as n from quire_pages lateral view explode(regexp_extract_all(html, '<([a-z0-9]+)', 1)) t as tag group by tag")
