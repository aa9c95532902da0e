"""Queries over plain texts, conversations and events: functions, searches, words, reports, rewrites, versions and changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.catalog.register import query, table
from quire.functions import text as T
from quire.operators import navigation, rewrite, store
from quire.operators import search as S
from quire.operators import versions as V
from quire.operators import words as W
from quire.plans.scratch import Scratch
from quire.streaming import changes as C

WORD = W.WORD.replace("'", "''")


def docs(spark, d):
    return table(spark, d, "documents")


# sources and filters


@query("select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: '<p>' || replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</p>'), chr(10)) as text from documents where text is not null")
def import_text(spark, d):
    return W.paragraphs(docs(spark, d).where("text is not null")).select("doc_id", "text")


@query("""with l as (select doc_id, generate_subscripts(a, 1) as k, unnest(a) as line from (select doc_id, string_split(text, chr(10)) as a from documents)),
 p as (select *, sum((line = '' or regexp_matches(line, '^[ \t]'))::int) over (partition by doc_id order by k)::bigint as par from l)
 select doc_id, par, string_agg(trim(line), ' ' order by k) as text from p group by all""")
def import_text_merged(spark, d):
    return W.merged_paragraphs(docs(spark, d))


@query("select doc_id, octet_length(encode(text))::bigint as size, sha256(text) as sha256 from documents")
def source_fingerprint(spark, d):
    return V.fingerprint(docs(spark, d))


@query("select doc_id, source from documents where lang in ('en', 'fr') and source in ('src1', 'src2', 'src3')")
def resource_filter(spark, d):
    return docs(spark, d).where(F.col("lang").isin("en", "fr") & F.col("source").isin("src1", "src2", "src3")).select("doc_id", "source")


# functions

# Java's upper case of sharp s is SS, and its word boundaries know letters beyond ASCII, which the oracle's don't.
_LATIN = "[À-ÖØ-öø-ɏ]"
_UPPER, _LOWER = "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF)])), "".join(map(chr, [*range(0xE0, 0xF7), *range(0xF8, 0xFF)]))
_up = "upper(replace({}, 'ß', 'SS'))".format
_wordy = f"regexp_replace({{}}, '{_LATIN}', '_', 'g')".format  # for counts
_marked, _unmarked = f"regexp_replace({{}}, '({_LATIN})', '_\\1_', 'g')".format, f"regexp_replace({{}}, '_({_LATIN})_', '\\1', 'g')".format  # for replacements


@query(f"select doc_id, {_up('text')} as up, lower(text) as low, {_up('text[1]')} || lower(text[2:]) as cap, replace(translate(text, '{T.UPPER}{T.LOWER}{_UPPER}{_LOWER}', '{T.LOWER}{T.UPPER}{_LOWER}{_UPPER}'), 'ß', 'SS') as swapped from documents")
def case_fns(spark, d):
    return docs(spark, d).select("doc_id", F.upper("text").alias("up"), F.lower("text").alias("low"), T.capitalize("text").alias("cap"), T.swapcase("text").alias("swapped"))


_small = ", ".join(f"'{x}'" for x in T.SMALL_WORDS)


@query(f"""select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l: array_to_string(list_transform(string_split(l, ' '), lambda x, i: case when lower(x) in ({_small}) and i > 1 then lower(x) when regexp_matches(x, '^[A-Z]\\.(?:[A-Z]\\.)*$') or regexp_matches(x, '^\\S+[A-Z]') then x
 else {_up('x[1]')} || x[2:] end), ' ')), chr(10)) as title from documents""")
def title_case(spark, d):
    """Each line of each text as a title."""
    return docs(spark, d).select("doc_id", F.array_join(F.transform(F.split("text", "\n"), T.title_case), "\n").alias("title"))


@query("select doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as escaped, replace(replace(text, 'é', '&eacute;'), 'ü', '&uuml;') as named from documents")
def html_escape(spark, d):
    return docs(spark, d).select("doc_id", T.html_escape("text").alias("escaped"), T.entity_encode("text", {"é": "eacute", "ü": "uuml"}).alias("named"))


@query("""with l as (select doc_id, unnest(string_split(text, ' ')) as w from documents) select w, count(*) as n from l where regexp_matches(w, '^[\\s*=~_+.§•|-]{1,16}$') and regexp_matches(w, '\\S') group by 1""")
def scene_break(spark, d):
    words = docs(spark, d).select(F.explode(F.split("text", " ")).alias("w"))
    return words.where(T.is_scene_break("w")).groupBy("w").agg(F.count("*").alias("n"))


@query(r"select doc_id, regexp_replace(text, '\s+', '', 'g') as compacted, trim(regexp_replace(text, '\s+', ' ', 'g')) as simplified from documents")
def compact_text(spark, d):
    return docs(spark, d).select("doc_id", T.compact("text").alias("compacted"), T.simplified("text").alias("simplified"))


@query(r"""with k as (select doc_id, regexp_replace(text, '[^A-Za-z0-9_.\-]', '', 'g') as x from documents) select doc_id, case when regexp_matches(x, '^[A-Za-z]') then x else 'x' || x end as id from k""")
def valid_id(spark, d):
    return docs(spark, d).select("doc_id", T.valid_id("text").alias("id"))


@query(rf"select doc_id, {_unmarked(rf"regexp_replace({_marked('text')}, '([a-z])([a-z]*)ing\b', '[\2:\1]', 'g')")} as replaced from documents")
def replacement_template(spark, d):
    rx = r"([a-z])([a-z]*)ing\b"
    return docs(spark, d).select("doc_id", S.replace_with("text", rx, S.compile_template(r"[\2:\1]", rx)).alias("replaced"))


@query("select lang, translate(word, '’ʼ', '''''') as safe, count(*) as n from (select lang, unnest(regexp_extract_all(text, '" + WORD + "')) as word from documents) where length(word) <= 90 group by all")
def spelling_safe(spark, d):
    return docs(spark, d).select("lang", F.explode(W.word_list("text")).alias("word")).groupBy("lang", T.spelling_safe("word").alias("safe")).agg(F.count("*").alias("n"))


# search


@query("select doc_id, length(regexp_extract_all(text, '(?i)th[a-z]+'))::bigint as n from documents")
def count_matches(spark, d):
    return docs(spark, d).select("doc_id", S.count_matches("text", "(?i)th[a-z]+").alias("n"))


_MATCH = r"""p as (select doc_id, unnest(regexp_extract_all(text, '{0}')) as match, unnest(regexp_split_to_array(text, '{0}')[:length(regexp_extract_all(text, '{0}'))]) as gap, generate_subscripts(regexp_extract_all(text, '{0}'), 1) - 1 as match_no from documents)"""


@query(f"with {_MATCH.format('[a-z]+ing[.,]')} select doc_id, match_no, e - length(match) as start, e as \"end\", match from (select *, (sum(length(gap) + length(match)) over (partition by doc_id order by match_no))::bigint as e from p)")
def find_matches(spark, d):
    return S.find_matches(docs(spark, d), "[a-z]+ing[.,]")


@query(rf"select doc_id, length(regexp_extract_all({_marked('text')}, '([a-z]+)ion\b'))::bigint as n, {_unmarked(rf"regexp_replace({_marked('text')}, '([a-z]+)ion\b', '\1ION', 'g')")} as text from documents where regexp_matches({_marked('text')}, '([a-z]+)ion\b')")
def replace_all(spark, d):
    return S.changed(docs(spark, d), r"([a-z]+)ion\b", r"\1ION").select("doc_id", "n", "text")


@query("with r as (select doc_id, unnest(regexp_extract_all(text, '[A-Z][^.]*[.]')) as s, generate_subscripts(regexp_extract_all(text, '[A-Z][^.]*[.]'), 1) - 1 as range_no from documents) select doc_id, range_no, length(regexp_extract_all(s, 'the'))::bigint as n from r")
def presearch(spark, d):
    return S.presearch(docs(spark, d), "[A-Z][^.]*[.]", "the")


@query("select doc_id, array_to_string(list_filter(regexp_extract_all(text, '[a-z]+ing'), lambda x: contains(x, 'th')), ' ') as accepted, len(list_filter(regexp_extract_all(text, '[a-z]+ing'), lambda x: not contains(x, 'th')))::bigint as n_rejected from documents")
def filter_accept_reject(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(S.filtered("text", "[a-z]+ing", "th"), " ").alias("accepted"), F.size(S.filtered("text", "[a-z]+ing", "th", accept=False)).cast("long").alias("n_rejected"))


@query("select doc_id, 'ok' as status, regexp_replace(text, '(th){2,}', 'th', 'g') as text from documents")
def recursive_replace(spark, d):
    return docs(spark, d).select("doc_id", S.recursive_replace("text", "thth", "th").alias("r")).select("doc_id", "r.status", "r.text")


_CAP = "regexp_extract_all(text, '([a-z]+)ble', 1)"


@query(f"select doc_id, list_extract({_CAP}, -1) as last_value, {_CAP}[1] as first_value, array_to_string({_CAP}, ' ') as every_value from (select doc_id, text from documents) where length(list_filter({_CAP}, lambda x: x <> '')) > 0")
def capture_vars(spark, d):
    own = lambda p: S.capture_vars(docs(spark, d), "([a-z]+)ble", p).withColumnRenamed("value", f"{p}_value")
    return own("last").join(own("first"), "doc_id").join(own("append").withColumnRenamed("append_value", "every_value"), "doc_id")


RULES = [S.Rule("spaces", "  +", " "), S.Rule("ion", "([a-z]+)ion,", r"\1ION,"), S.Rule("off", "a", "b", enabled=False), S.Rule("stops", r"\.\.", ".")]
_RUN = r"""a as (select doc_id, text, length(regexp_extract_all(text, '  +')) as n_1, regexp_replace(text, '  +', ' ', 'g') as t1 from documents), b as (select *, length(regexp_extract_all(t1, '([a-z]+)ion,')) as n_2, regexp_replace(t1, '([a-z]+)ion,', '\1ION,', 'g') as t2 from a),
 c as (select *, length(regexp_extract_all(t2, '\.\.')) as n_3, regexp_replace(t2, '\.\.', '.', 'g') as t3 from b)"""


@query(f"with {_RUN} select doc_id, n_1::bigint as n_1, n_2::bigint as n_2, n_3::bigint as n_3, t3 as text from c where t3 <> text")
def run_recipe(spark, d):
    return S.committed(S.run_recipe(docs(spark, d), RULES)).select("doc_id", "n_1", "n_2", "n_3", "text")


@query(f"with {_RUN} select unnest(['spaces', 'ion', 'stops']) as name, unnest([sum(n_1), sum(n_2), sum(n_3)])::bigint as replacements, unnest([count(*) filter (n_1 > 0), count(*) filter (n_2 > 0), count(*) filter (n_3 > 0)]) as matched_docs from c")
def rule_stats(spark, d):
    return S.rule_stats(S.run_recipe(docs(spark, d), RULES), RULES)


@query(f"with {_MATCH.format('[a-z]+ing[.,]')}, q as (select *, (sum(length(gap) + length(match)) over (partition by doc_id order by match_no))::bigint - length(match) as start from p) select 1 as rule_no, 'ing' as rule, doc_id, start, (length(substr(text, 1, start)) - length(replace(substr(text, 1, start), chr(10), '')) + 1)::bigint as line, match as before, upper(match) as after, '' as variables from q join documents using (doc_id)")
def dry_run(spark, d):
    return S.dry_run(docs(spark, d), [S.Rule("ing", "[a-z]+ing[.,]", r"\U\0\E")])


VARIABLES = [S.Rule("opening", r"^(?:[^ ]* )?(?P<word>[A-Za-z]+)", capture_only=True), S.Rule("marks", r"[0-9]+", r"<${var:word}>"), S.Rule("last", r"(?P<name>[a-z]+)tion", r"\g{name}TION", capture=True), S.Rule("stops", r"[!?]", r"${var:name}", enabled=False)]


@query(r"with t as (select doc_id, text, regexp_extract(text, '^(?:[^ ]* )?([A-Za-z]+)', 1) as word from documents) select doc_id, length(regexp_extract_all(text, '[0-9]+'))::bigint as n_2, nullif(word, '') as word, regexp_replace(regexp_replace(text, '[0-9]+', '<' || word || '>', 'g'), '([a-z]+)tion', '\1TION', 'g') as text from t where not (word = '' and regexp_matches(text, '[0-9]'))")
def recipe_variables(spark, d):
    """A word captured in a document takes the place of its numbers; documents that have none to put there fail and are left out here."""
    run = S.run_recipe(docs(spark, d), VARIABLES)
    return run.where("error = ''").select("doc_id", "n_2", F.col("_var_word").alias("word"), "text")


@query(r"with b as (select max_by(regexp_extract(text, '([0-9]+)', 1), doc_id) as seed from documents where regexp_matches(text, '[0-9]+')) select doc_id, replace(text, '%%%', '[' || seed || ']') as text from documents, b where contains(text, '%%%')")
def recipe_batch_variables(spark, d):
    """The first number of the last document that has one, kept for all documents."""
    rules = [S.Rule("seed", "(?s)^.*?(?P<seed>[0-9]+)", capture_only=True), S.Rule("use", "%%%", "[${var:seed}]")]
    return S.committed(S.run_recipe(docs(spark, d), rules, scope="batch")).select("doc_id", "text")


@query("select doc_id, source as name, case when doc_id % 7 = 1 then 0 else 1 + (doc_id % 7 = 4)::int end::bigint as n_rules, case doc_id % 7 when 1 then 'not a recipe' when 2 then 'version' when 3 then 'scope or policy' when 4 then 'repeated name' when 5 then 'empty field' when 6 then 'rule' else '' end as error from documents where doc_id % 7 <> 1 union all select doc_id, null, 0, 'not a recipe' from documents where doc_id % 7 = 1")
def recipe_io(spark, d):
    """A recipe of each document's source; six of seven kinds have a fault."""
    k = F.col("doc_id") % 7
    rule = F.struct(F.lit("a").alias("name"), F.when(k == 5, "").otherwise(F.lit("x+")).alias("find"), F.lit("y").alias("replace"), (k == 6).alias("capture_only"))
    made = F.struct(F.when(k == 2, 9).otherwise(1).alias("version"), F.col("source").alias("name"), F.when(k == 3, "planet").otherwise("batch").alias("scope"), F.when(k == 4, F.array(rule, rule)).otherwise(F.array(rule)).alias("rules"))
    texts = docs(spark, d).select("doc_id", F.when(k == 1, "no json").otherwise(F.to_json(made)).alias("recipe"))
    return S.read_recipes(texts).select("doc_id", "name", "n_rules", "error")


@query("select doc_id, n_matches, coalesce(sum(n_matches) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as base from (select doc_id, length(regexp_extract_all(text, '[a-z]+tion'))::bigint as n_matches from documents)")
def match_numbering(spark, d):
    return S.match_base(docs(spark, d), "[a-z]+tion")


@query(f"with {_MATCH.format('[A-Z][a-z]+')}, q as (select *, (sum(length(gap) + length(match)) over (partition by doc_id order by match_no))::bigint - length(match) as pos from p) select doc_id, pos, (length(substr(text, 1, pos)) - length(replace(substr(text, 1, pos), chr(10), '')) + 1)::bigint as line from q join documents using (doc_id)")
def line_of(spark, d):
    """The lines of all capitalised words."""
    return S.find_matches(docs(spark, d), "[A-Z][a-z]+", lines=True).select("doc_id", F.col("start").alias("pos"), "line")


@query("select doc_id, array_to_string(list_transform(string_split(text, ' '), lambda x: case when x = 'the' then 'THE' else x end), ' ') as text from documents")
def function_replace(spark, d):
    return docs(spark, d).select("doc_id", S.replace_with("text", "(?<= |^)the(?= |$)", F.upper).alias("text"))


@query(key="function_replace_custom")
def function_replace_custom(spark, d):
    return S.function_replace(docs(spark, d), "[a-z]+tion", lambda m, n: f"{m}#{n}").select("doc_id", "text")


@query(f"select doc_id, {_up('text')} as text, true as valid from documents where text is not null")
def transform_job(spark, d):
    job = lambda df: df.withColumn("text", F.upper("text"))
    return docs(spark, d).where("text is not null").transform(job).select("doc_id", "text", F.is_valid_utf8("text").alias("valid"))


# words and reports


@query(f"select doc_id, length(list_filter(regexp_extract_all(text, '{WORD}'), lambda x: length(x) <= 90))::bigint as n_words from documents")
def word_count(spark, d):
    return docs(spark, d).select("doc_id", F.size(W.word_list("text")).cast("long").alias("n_words"))


_UNIQUE = f"u as (select lang, word, count(*) as n from (select lang, unnest(regexp_extract_all(text, '{WORD}')) as word from documents) where length(word) <= 90 group by all)"


@query(f"with {_UNIQUE} select lang, word, n from u")
def unique_words(spark, d):
    return W.unique_words(docs(spark, d))


@query("with c as (select doc_id, unnest(list_distinct(string_split(text, ''))) as char from documents) select char, unicode(char)::bigint as codepoint, upper(to_hex(unicode(char))) as hex, count(*) as n_docs from c where char <> '' and char <> chr(10) group by all")
def char_usage(spark, d):
    return W.char_usage(docs(spark, d))


@query(key="char_names")
def char_names(spark, d):
    """Entities and descriptions of all characters; tested against the tables that they come from."""
    return W.char_names(W.char_usage(docs(spark, d)))


_KNOWN = f"{_UNIQUE}, k as (select distinct lang, lower(translate(word, '’ʼ', '''''')) as key from u where n >= 20), m as (select * from u where not exists (select 1 from k where k.lang = u.lang and k.key = lower(translate(u.word, '’ʼ', ''''''))))"


@query(f"with {_KNOWN} select lang, word, n from m where lang in (select lang from k)")
def misspelled(spark, d):
    return W.misspelled(W.unique_words(docs(spark, d)), 20)


# The oracle's edit distance counts bytes: its words are written with one byte for each letter.
_one_byte = f"translate({{}}, 'ß’{_LOWER}', '0123456789{T.UPPER}')".format
_NEAR = f"{_KNOWN}, j as (select m.lang, m.word, k.key, levenshtein({_one_byte('lower(m.word)')}, {_one_byte('k.key')}) as dist from m join k on k.lang = m.lang and k.key[1] = lower(m.word)[1] and abs(length(k.key) - length(m.word)) <= 1 where m.n >= 5), s as (select *, row_number() over (partition by lang, word order by dist, key) as rank from j where dist <= 2)"


def _suggested(spark, d, most):
    words = W.counted_words(docs(spark, d))
    return W.suggest(W.misspelled(words, 20).where("n >= 5"), W.dictionary(words, 20), most=most)


@query(f"with {_NEAR} select lang, word, rank, key as suggestion, dist::bigint as distance from s where rank <= 4")
def suggest(spark, d):
    return _suggested(spark, d, 4)


@query(f"with {_NEAR} select lang, word, key as suggestion from s where rank = 1")
def top_suggestions(spark, d):
    return _suggested(spark, d, 1).select("lang", "word", "suggestion")


@query(rf"select doc_id, {_unmarked(rf"regexp_replace({_marked('text')}, '\bthe\b', 'teh', 'g')")} as text from documents where lang = 'en' and regexp_matches({_marked('text')}, '\bthe\b')")
def replace_word(spark, d):
    return S.changed(docs(spark, d).where("lang = 'en'"), r"\bthe\b", "teh").select("doc_id", "text")


@query(f"with {_KNOWN} select doc_id, count(*) as n from (select doc_id, lang, unnest(regexp_extract_all(text, '{WORD}')) as word from documents) w where exists (select 1 from m where m.lang = w.lang and m.word = w.word) and regexp_matches(word, 'tion$') and length(word) <= 90 group by 1")
def spell_scoped(spark, d):
    wrong = W.misspelled(W.unique_words(docs(spark, d)), 20).where("word rlike 'tion$'").select("lang", "word")
    every = docs(spark, d).select("doc_id", "lang", F.explode(F.filter(W.word_list("text"), lambda x: F.endswith(x, F.lit("tion")))).alias("word"))
    return every.join(wrong, ["lang", "word"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"with {_KNOWN}, w as (select doc_id, lang, unnest(l) as word, generate_subscripts(l, 1) as k from (select doc_id, lang, list_filter(regexp_extract_all(text, '{WORD}'), lambda x: length(x) <= 90) as l from documents)) select doc_id, min_by(w.word, k) as first_wrong, max_by(w.word, k) as last_wrong from w join m on m.lang = w.lang and m.word = w.word group by 1")
def first_match(spark, d):
    wrong = W.misspelled(W.unique_words(docs(spark, d)), 20).select("lang", "word")
    every = docs(spark, d).select("doc_id", "lang", F.posexplode(W.word_list("text")).alias("k", "word"))
    return every.join(wrong, ["lang", "word"]).groupBy("doc_id").agg(F.min_by("word", "k").alias("first_wrong"), F.max_by("word", "k").alias("last_wrong"))


@query("select source, doc_id, sum(n_bytes)::bigint as n_bytes, sum(coalesce(quality, 0))::bigint as good, grouping(doc_id)::int as is_total from (select d.doc_id, source, octet_length(encode(text)) as n_bytes, quality from documents d left join labels using (doc_id)) group by grouping sets ((source, doc_id), (source), ())")
def all_files_report(spark, d):
    rows = docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left").select("source", "doc_id", F.octet_length("text").cast("long").alias("b"), F.coalesce("quality", F.lit(0)).alias("q"))
    return rows.groupingSets([["source", "doc_id"], ["source"], []], "source", "doc_id").agg(F.sum("b").alias("n_bytes"), F.sum("q").cast("long").alias("good"), F.grouping("doc_id").cast("int").alias("is_total"))


SEARCHES = {"the": r"\bthe\b", "digits": "[0-9]+", "bad": r"(?R)x", "caps": "[A-Z][a-z]+"}
_COUNTS = rf"""c as (select lang as target, sum(length(regexp_extract_all({_wordy('text')}, '\bthe\b')))::bigint as a, sum(length(regexp_extract_all(text, '[0-9]+')))::bigint as b, sum(length(regexp_extract_all(text, '[A-Z][a-z]+')))::bigint as e from documents group by 1),
 l as (select target, unnest(['the', 'digits', 'bad', 'caps']) as name, unnest([a, b, -1, e])::bigint as n from c)"""


@query(f"with {_COUNTS} select name, target, n, 0 as is_total from l union all select null, null, sum(case when n > -1 then n else 0 end)::bigint, 1 from l")
def counts_report(spark, d):
    return W.counts_report(docs(spark, d), SEARCHES, "lang")


@query(f"with {_COUNTS}, r as (select name, target, n, 0 as is_total from l union all select null, null, sum(case when n > -1 then n else 0 end)::bigint, 1 from l) select row_number() over (order by is_total, n desc, name, target) as place, name, target, n from r")
def sort_report(spark, d):
    return W.places(counts_report(spark, d), [F.col("is_total"), F.desc("n"), F.col("name"), F.col("target")]).select("place", "name", "target", "n")


@query("select source, row_number() over (order by regexp_extract(source, '^[^0-9]*'), regexp_extract(source, '[0-9]+$')::bigint) as place from (select distinct source from documents)")
def natural_sort(spark, d):
    return W.places(docs(spark, d).select("source").distinct(), [W.natural_key("source")]).select("source", "place")


@query(f"with {_UNIQUE} select count(*) as n_rows, greatest(count(*) - 10000, 0)::bigint as omitted from u")
def report_cap(spark, d):
    _, told = S.report_cap(W.unique_words(docs(spark, d)), ["lang", "word"])
    return told


@query("select distinct substr(text, 1, 256) as sample from documents order by 1 limit 64")
def text_samples(spark, d):
    return docs(spark, d).select(F.substring("text", 1, 256).alias("sample")).distinct().orderBy("sample").limit(64)


INDEX = [("(?i)tion", "nouns/tion"), ("ing\\b", "verbs/ing"), ("\\bthe\\b", "articles"), ("[0-9]", "numbers/any")]
_INDEX = f"h as (select distinct doc_id, block, entry from (select doc_id, block, unnest([case when regexp_matches(line, '(?i)tion') then 'nouns/tion' end, case when regexp_matches(line, 'ing\\b') then 'verbs/ing' end, case when regexp_matches(line, '\\bthe\\b') then 'articles' end, case when regexp_matches(line, '[0-9]') then 'numbers/any' end]) as entry from (select doc_id, unnest(l) as line, generate_subscripts(l, 1) - 1 as block from (select doc_id, string_split({_wordy('text')}, chr(10)) as l from documents))) where entry is not null)"


def _hits(spark, d):
    return W.index_hits(docs(spark, d), spark.createDataFrame(INDEX, "pattern string, entry string"))


@query(f"with {_INDEX} select doc_id, block, entry from h")
def index_hits(spark, d):
    return _hits(spark, d)


@query(f"with {_INDEX} select doc_id, block, 'idx' || row_number() over (partition by doc_id order by block) as anchor from (select distinct doc_id, block from h)")
def index_anchor_ids(spark, d):
    return W.index_anchor_ids(_hits(spark, d))


@query(f"with {_INDEX} select path, lvl::bigint as lvl, parent, count(*) as n from (select array_to_string(p[1:lvl], '/') as path, lvl, array_to_string(p[1:lvl - 1], '/') as parent from (select string_split(entry, '/') as p, unnest(range(1, length(string_split(entry, '/')) + 1)) as lvl from h)) group by all")
def index_tree(spark, d):
    return W.index_tree(_hits(spark, d))


@query("with e as (select distinct source as entry from documents union select distinct lang from documents) select entry, upper(entry[1]) as letter, upper(entry[1]) is distinct from lag(upper(entry[1])) over (order by lower(entry), entry) as new_letter from e")
def index_letter_breaks(spark, d):
    rows = docs(spark, d)
    return W.letter_breaks(rows.select(F.col("source").alias("entry")).union(rows.select("lang")).distinct())


@query("select doc_id, source || lpad(n, greatest(4, length(n))::int, '0') as name from (select doc_id, source, (row_number() over (partition by source order by doc_id))::varchar as n from documents)")
def unique_names(spark, d):
    return W.unique_names(docs(spark, d), "source", "doc_id")


@query("select conv_id, turn, row_number() over w as place, lag(role) over w as previous, max(turn) over (partition by conv_id) as highest from conversations window w as (partition by conv_id order by turn)")
def reading_order(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(w).cast("long").alias("place"), F.lag("role").over(w).alias("previous"), F.max("turn").over(Window.partitionBy("conv_id")).alias("highest"))


# rewrites


@query("select doc_id, case when length(text) >= 24 then substr(text, 1, 3) || '<b>' || substr(text, 4, 5) || '</b>' || substr(text, 9, 11) || substr(text, 25) else text end as text, case when length(text) < 24 then 'range' else '' end as error from documents")
def apply_edits(spark, d):
    """Two edits of each text; texts that are too short for them stay and say so."""
    rows = docs(spark, d).select("doc_id", "text")
    edits = rows.select("doc_id", F.inline(F.array(*(F.struct(s.cast("long").alias("start"), e.cast("long").alias("end"), x.alias("text")) for s, e, x in ((F.lit(3), F.lit(8), F.concat(F.lit("<b>"), F.substring("text", 4, 5), F.lit("</b>"))), (F.lit(19), F.lit(24), F.lit("")))))))
    return S.apply_edits(rows, edits)


@query("select conv_id, string_agg(coalesce(text, ''), chr(10) order by turn) as text from conversations group by 1")
def joined_turns(spark, d):
    parts = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text"))


_PLAIN = "replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"""select conv_id, '<html><head></head><body>' || string_agg('<p id="x' || case when n = 1 then '' else '_' || turn end || '">' || {_PLAIN} || '</p><a href="#x' || case when n = 1 then '' else '_' || turn end || '">own</a>', chr(10) order by turn) || '</body></html>' as html
 from (select *, row_number() over (partition by conv_id order by turn) as n from conversations) group by 1""")
def merge_documents(spark, d):
    """The turns of a conversation, a page each with the same id and a link to it, become one page."""
    turns, name = table(spark, d, "conversations"), F.concat(F.lit("t/"), F.col("turn").cast("string"), F.lit(".html"))
    html = F.concat(F.lit('<html><head></head><body><p id="x">'), T.html_escape(F.coalesce("text", F.lit(""))), F.lit('</p><a href="'), F.col("turn").cast("string"), F.lit('.html#x">own</a></body></html>'))
    book = F.col("conv_id").cast("string").alias("book")
    pages = turns.select((F.col("conv_id") * 100_000 + F.col("turn")).alias("page_id"), book, name.alias("path"), html.alias("html"))
    plan = turns.select(book, name.alias("path"), F.lit("all.html").alias("target"), F.col("turn").alias("n"))
    return rewrite.merge_documents(pages, plan).select(F.col("book").cast("long").alias("conv_id"), "html")


@query("select doc_id, lang || '/doc-' || lpad(n, greatest(4, length(n))::int, '0') || '.txt' as path, '<a href=\"doc-' || lpad(n, greatest(4, length(n))::int, '0') || '.txt#f\">me</a>' as html from (select doc_id, lang, (row_number() over (partition by source order by doc_id))::varchar as n from documents)".replace("'.txt#f", "'#f").replace("<a href=\"doc-' || lpad(n, greatest(4, length(n))::int, '0') || '#f", "<a href=\"#f"))
def rename_files(spark, d):
    """Documents as files of their source, numbered by a template; each has a link to itself."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    files = docs(spark, d).select(F.col("doc_id").alias("page_id"), F.col("source").alias("book"), F.concat("lang", F.lit("/"), name).alias("path"), F.concat(F.lit('<a href="'), name, F.lit('#f">me</a>')).alias("html"))
    return rewrite.rename_files(files, "doc-####{ext}", ["page_id"]).select(F.col("page_id").alias("doc_id"), "path", "html")


@query("with n as (select doc_id, 'book-' || regexp_extract(source, '[0-9]+') || '/' || lang || '.txt' as name from documents) select name, count(*) as n_same from n group by 1")
def renamed_by_pattern(spark, d):
    renamed = docs(spark, d).select(F.regexp_replace(F.concat_ws("/", "source", "lang"), "^src([0-9]+)/(.*)$", "book-$1/$2.txt").alias("name"))
    return renamed.groupBy("name").agg(F.count("*").alias("n_same"))


_INDEXED = f"""{_INDEX}, a as (select doc_id, block, 'idx' || row_number() over (partition by doc_id order by block) as anchor from (select distinct doc_id, block from h)),
 t as (select d.source as book, string_split(entry, '/') as names, doc_id, block, doc_id || '.html#' || anchor as target from h join a using (doc_id, block) join documents d using (doc_id)),
 u as (select distinct book, names[1:k] as names from (select book, names, unnest(range(1, len(names) + 1)) as k from t)),
 v as (select u.book, u.names, string_agg(t.target, ' ' order by t.doc_id, t.block) as targets from u left join t on t.book = u.book and t.names = u.names group by 1, 2),
 w as (select *, row_number() over (partition by book order by [lower(x) for x in names], names) as pos from v)"""


def _index_rows(spark, d):
    hits = _hits(spark, d)
    placed = hits.join(W.index_anchor_ids(hits), ["doc_id", "block"]).join(docs(spark, d).select("doc_id", F.col("source").alias("book")), "doc_id")
    target = F.concat(F.col("doc_id").cast("string"), F.lit(".html#"), "anchor")
    return navigation.index_rows(placed.select("book", "entry", F.struct("doc_id", "block").alias("found"), target.alias("target")))


@query(f"with {_INDEXED} select book, pos, len(names) as lvl, names[-1] as name, coalesce(targets, '') as targets from w")
def index_targets(spark, d):
    """The index of each source as a tree with its targets in found order."""
    return _index_rows(spark, d).select("book", "pos", "lvl", "name", F.array_join("targets", " ").alias("targets"))


@query(f"""with {_INDEXED}, x as (select *, names[1] as root, names[-1] || coalesce(' ' || array_to_string([('<a href="' || string_split(targets, ' ')[i] || '">' || i || '</a>') for i in range(1, len(string_split(targets, ' ')) + 1)], ', '), '') as item from w),
 g as (select book, root, min(pos) as pos, max(item) filter (len(names) = 1) as own, string_agg('<li>' || item || '</li>', '' order by pos) filter (len(names) = 2) as below from x group by 1, 2),
 m as (select *, upper(root[1]) is distinct from lag(upper(root[1])) over (partition by book order by pos) as fresh from g)
 select book, '<ul>' || string_agg(case when fresh then '<li class="letter">' || upper(root[1]) || '</li>' else '' end || '<li>' || own || coalesce('<ul>' || below || '</ul>', '') || '</li>', '' order by pos) || '</ul>' as markup from m group by 1""")
def render_index(spark, d):
    return navigation.render_index(_index_rows(spark, d))


# versions


def _new(spark, d):
    rows = docs(spark, d).select("doc_id", "text")
    edited = F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("\nadded line"))).when(F.col("doc_id") % 10 == 2, F.regexp_replace("text", "^[^\n]*\n", "")).otherwise(F.col("text"))
    return rows.where("doc_id % 10 <> 0").withColumn("text", edited).unionByName(rows.where("doc_id % 100 = 5").withColumn("doc_id", F.col("doc_id") + 1_000_000_000))


_NEW = "n as (select doc_id, case doc_id % 10 when 1 then text || chr(10) || 'added line' when 2 then regexp_replace(text, '^[^\\n]*\\n', '') else text end as text from documents where doc_id % 10 <> 0 union all select doc_id + 1000000000, text from documents where doc_id % 100 = 5)"


@query(f"with {_NEW} select 2::bigint as version, 'V0002' as tag, doc_id, sha256(text) as sha256 from n")
def checkpoint(spark, d):
    return V.snapshot(_new(spark, d), 2).drop("text")


_LINES = "len(string_split(coalesce({}.text, ''), chr(10)))"
_HISTORY = f"""{_NEW}, c as (select d.doc_id is null as added, n.doc_id is null as removed, d.doc_id is not null and n.doc_id is not null as modified, case when d.doc_id is null then {_LINES.format("n")} when n.doc_id is null then 0 else (d.doc_id % 10 = 1)::int end as ins, case when n.doc_id is null then {_LINES.format("d")} when d.doc_id is null then 0 else (d.doc_id % 10 = 2)::int end as del
 from documents d full join n on n.doc_id = d.doc_id where coalesce(d.text, '') is distinct from coalesce(n.text, '') or d.doc_id is null or n.doc_id is null)"""


def _versions(spark, d):
    old, new = docs(spark, d).select("doc_id", "text"), _new(spark, d)
    first = store.unseen_texts(old, None)
    texts = Scratch(spark, "store").table(first.unionByName(store.unseen_texts(new, first)), "texts")
    return store.manifest(old, 1).unionByName(store.manifest(new, 2)), texts


@query(f"""with {_HISTORY} select 1::bigint as version, 'V0001' as tag, timestamp '2024-01-01' as ts, 'first' as message, count(*) as files, count(*) as added, 0 as removed, 0 as modified, sum({_LINES.format("d")})::bigint as insertions, 0::bigint as deletions from documents d
 union all select 2, 'V0002', timestamp '2024-02-01', 'edited', (select count(*) from n), count(*) filter (added), count(*) filter (removed), count(*) filter (modified), sum(ins)::bigint, sum(del)::bigint from c""")
def checkpoint_log(spark, d):
    manifests, texts = _versions(spark, d)
    log = spark.sql("select * from values (1L, 'V0001', timestamp'2024-01-01', 'first'), (2L, 'V0002', timestamp'2024-02-01', 'edited') as t(version, tag, ts, message)")
    return store.history(manifests, texts, log)


@query(f"with {_NEW} select count(*) as n_texts, (select count(distinct sha256(coalesce(text, ''))) from n where sha256(coalesce(text, '')) not in (select sha256(coalesce(text, '')) from documents)) as n_added from (select distinct sha256(coalesce(text, '')) from documents union select sha256(coalesce(text, '')) from n)")
def checkpoint_texts(spark, d):
    """How many texts two versions take in the store, and how many the second added."""
    manifests, texts = _versions(spark, d)
    of = lambda v: manifests.where(F.col("version") == v).select("sha256").distinct()
    added = of(2).join(of(1), "sha256", "left_anti").agg(F.count("*").alias("n_added"))
    return texts.agg(F.count("*").alias("n_texts")).join(F.broadcast(added))  # a row each


@query(f"with {_NEW} select doc_id, coalesce(text, '') as text from n")
def restore_by_hash(spark, d):
    return store.restore(*_versions(spark, d), 2)


@query(f"with {_NEW} select coalesce(d.doc_id, n.doc_id) as doc_id, case when n.doc_id is null then 'left_only' when d.doc_id is null then 'right_only' when d.text <> n.text then 'modified' else 'same' end as status from documents d full join n on n.doc_id = d.doc_id")
def compare_versions(spark, d):
    return V.compare(docs(spark, d), _new(spark, d))


_DIFF = f"""{_NEW}, b as (select d.doc_id, d.text as a, n.text as b from documents d join n on n.doc_id = d.doc_id where d.text <> n.text),
 l as (select doc_id, unnest(string_split(a, chr(10))) as line, -1 as s from b union all select doc_id, unnest(string_split(b, chr(10))), 1 from b), g as (select doc_id, line, sum(s) as s from l group by 1, 2),
 f as (select doc_id, sum(case when s > 0 then s else 0 end)::bigint as added, sum(case when s < 0 then -s else 0 end)::bigint as removed from g group by 1)"""


@query(f"with {_DIFF} select doc_id, added, removed from f")
def line_diff(spark, d):
    return W.line_diff(docs(spark, d), _new(spark, d))


@query(f"with {_DIFF} select doc_id, sum(added)::bigint as added, sum(removed)::bigint as removed, count(*) as files, grouping(doc_id)::int as is_total from f group by grouping sets ((doc_id), ())")
def diffstat(spark, d):
    return V.diffstat(W.line_diff(docs(spark, d), _new(spark, d)))


@query(key="line_opcodes")
def line_opcodes(spark, d):
    return V.line_opcodes(docs(spark, d), _new(spark, d))


#: Every second line goes, every tenth line is doubled and one is put before the first: few of the lines of a text are the same.
_EDITS = """e as (select doc_id, string_split(text, chr(10)) as l from documents where text is not null), p as (select doc_id, l, [i for i in range(1, len(l) + 1) if i % 2 = 1] as own from e),
 c as (select doc_id, len(own) as kept, len(l) - len(own) as deleted, 1 + len([i for i in own if i % 10 = 1]) as inserted from p)"""


@query(f"with {_EDITS} select doc_id, deleted - inserted as shrinks from c")
def edit_scripts(spark, d):
    """Scripts give the new texts back, and the counts of lines add up. How short scripts are is tested against brute force."""
    old = docs(spark, d).where("text is not null").select("doc_id", "text")
    odd = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: y["i"] % 2 == 0)
    lines = F.flatten(F.transform(odd, lambda y: F.when(y["i"] % 10 == 0, F.array(y["x"], y["x"])).otherwise(F.array(y["x"]))))
    new = old.select("doc_id", F.array_join(F.concat(F.array(F.lit("<first>")), lines), "\n").alias("text"))
    return V.edit_counts(V.line_opcodes(old, new)).select("doc_id", (F.col("deleted") - F.col("inserted")).alias("shrinks"))


@query(f"with {_NEW} select d.doc_id, len(string_split(d.text, chr(10))) - (d.doc_id % 10 = 2)::int as kept, (d.doc_id % 10 = 2)::bigint as deleted, (d.doc_id % 10 = 1)::bigint as inserted, 1::bigint as n_ops from documents d join n on n.doc_id = d.doc_id where d.text <> n.text")
def edit_counts(spark, d):
    """Kept, deleted and inserted lines of the shortest scripts, for edits that SQL can tell."""
    return V.edit_counts(V.line_opcodes(docs(spark, d), _new(spark, d)))


@query(f"select doc_id, case when doc_id % 3 = 0 then 'conflict' else 'ready' end as status, length(text)::bigint as old_length, length({_up('text')})::bigint as new_length from documents")
def stage_commit(spark, d):
    rows = docs(spark, d).select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1).alias("revision"))
    return V.stage_commit(rows, rows.select("doc_id", F.upper("text").alias("text"), F.lit(1).alias("base_revision")))



@query("select doc_id, substr(text, 101, 50) as part, least(150, length(text))::bigint as next from documents")
def range_read(spark, d):
    part, following = V.range_read("text", 100, 50)
    return docs(spark, d).select("doc_id", part.alias("part"), following.alias("next"))


@query("select doc_id, source from documents where doc_id > 100 order by doc_id limit 50")
def page_list(spark, d):
    return V.page(docs(spark, d).select("doc_id", "source"), "doc_id", 100, 50)


# changes


def events(spark, d):
    return table(spark, d, "events")


@query("select time_bucket(interval '1 hour', ts) as since, user_id, max_by(event_type, (ts, event_id)) as event_type, max_by(event_id, (ts, event_id)) as event_id, count(*) as n from events group by 1, 2")
def coalesce_changes(spark, d):
    return C.coalesce_changes(events(spark, d))


@query("select event_id, user_id, event_type from events where event_type in (select distinct event_type from events order by 1 limit 2) and user_id <> 7")
def subscribe(spark, d):
    names = [r[0] for r in events(spark, d).select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    return C.subscribe(events(spark, d), names, own=7).select("event_id", "user_id", "event_type")


@query("select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as revision from events")
def revisions(spark, d):
    return C.revisions(events(spark, d)).select("event_id", "user_id", "revision")


@query("with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30 minutes' then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as k from g) select min(ts) as since, max(ts) + interval '30 minutes' as until, user_id, count(*) as n from s group by user_id, k")
def edit_sessions(spark, d):
    return C.sessions(events(spark, d))


# As streams: what the watermark, ten minutes behind the latest event (in whole milliseconds), has passed.
_PASSED = "p as (select date_trunc('milliseconds', max(ts)) - interval '10 minutes' as z from events)"


def _events_stream(spark, d):
    return C.ingest(spark, f"{d}/events.parque[t]", C.EVENTS)


@query(f"with {_PASSED} select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as revision from events where ts <= (select z from p)")
def stream_revisions(spark, d):
    with C.state_store(spark):
        return _streamed(spark, d, "revisions", C.ordered_revisions, _events_stream)


@query(f"with {_PASSED}, w as (select time_bucket(interval '1 hour', ts) as since, user_id, max_by(event_type, (ts, event_id)) as event_type, max_by(event_id, (ts, event_id)) as event_id, count(*) as n from events group by 1, 2) select * from w where since + interval '1 hour' <= (select z from p)")
def stream_coalesce(spark, d):
    with C.state_store(spark):
        return _streamed(spark, d, "coalesce", C.coalesce_changes, _events_stream)


@query(f"with {_PASSED}, g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30 minutes' then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as k from g), w as (select min(ts) as since, max(ts) + interval '30 minutes' as until, user_id, count(*) as n from s group by user_id, k) select * from w where until <= (select z from p)")
def stream_sessions(spark, d):
    with C.state_store(spark):
        return _streamed(spark, d, "sessions", C.sessions, _events_stream)


@query("select lang, source, count(*) as n, sum(length(text))::bigint as chars from documents group by all")
def stream_report(spark, d):
    """Running counts of a stream of documents: each batch of the stream writes the whole report anew; its last state."""
    at = Scratch(spark, "report").at
    report = _documents_stream(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/out")
    report.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(report.schema).parquet(f"{at}/out")


@query("select doc_id, length(text)::bigint as chars from documents", "stream_ingest")
def stream_ingest(spark, d):
    """Documents as a stream, run to its end."""
    return _streamed(spark, d, "ingest", lambda s: s.select("doc_id", F.length("text").cast("long").alias("chars")))


@query(f"with {_RUN} select doc_id, n_1::bigint as n_1, n_2::bigint as n_2, n_3::bigint as n_3 from c", "stream_recipe")
def stream_recipe(spark, d):
    return _streamed(spark, d, "recipe", lambda s: S.run_recipe(s, RULES).select("doc_id", "n_1", "n_2", "n_3"))


def _documents_stream(spark, d):
    """The files of documents as a stream (a pattern, as the table may be a file or a folder)."""
    return C.ingest(spark, f"{d}/documents.parque[t]", "doc_id long, text string, lang string, source string, n_chars long")


def _streamed(spark, d, name, fn, source=_documents_stream):
    """A stream written to a table in the shared folder and read back."""
    at = Scratch(spark, name).at
    out = fn(source(spark, d))
    out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")
