"""Operators on texts, each against brute force, with nulls, empty and long texts, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quire.llm import chat, components as components_module, decontaminate, htmltext, language, licenses, neardup, packing, pii, quality, tokencount

BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\t ", "a", "one two", "<|endoftext|> x  \n<|endoftext|>", "a  b\n c ▁▁ d ▁e", "x　y z ﬁ ² don't 'tis", "Word.Word,word ..., .com 3.14 a,b", "  lead", "trail  ", "\x00\x1c!\x1c? é́"]


def prose(n, seed=1):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeiourstln") for _ in range(r.randint(1, 8))) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def frame(spark, texts, **more):
    rows = [(i, x, "text", 7) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n long")


def test_token_counts(spark):
    import sentencepiece

    texts = [*ODD, prose(3000), prose(50, 2), prose(50, 2), *(prose(20, k) for k in range(30))]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for hot in (8, 1000):
        got = {r.doc_id: r for r in tokencount.token_counts(frame(spark, texts), PIECES, hot=hot, limit=100).collect()}
        assert len(got) == len(texts)
        for i, x in enumerate(texts):
            n = len(library.encode(x or ""))
            assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((x or "").encode()), n > 100), x
    assert tokencount.token_counts(frame(spark, []), PIECES).count() == 0


@pytest.mark.parametrize("window", [16, 1024])
def test_packing(spark, window):
    from tokenizers import Tokenizer

    texts = [*ODD, prose(4000), *(prose(k % 37, k) for k in range(150)), *[prose(9, 9)] * 40]
    library = Tokenizer.from_file(BYTE_BPE)
    ids = [np.array(library.encode(x or "", add_special_tokens=False).ids + [0], "<u4") for x in texts]
    rows = packing.pack(frame(spark, texts).repartition(3), BYTE_BPE, window=window).collect()
    sequences, covered = {}, {}
    for r in rows:
        assert bytes(r.ids) == ids[r.doc_id][r.start : r.start + r.length].tobytes() and r.doc_tokens == len(ids[r.doc_id])
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
    for parts, total in [(v, None) for v in sequences.values()] + [(v, len(ids[k])) for k, v in covered.items()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at <= window if total is None else at == total
    assert len(covered) == len(texts)
    assert len(sequences) == -(-sum(map(len, ids)) // window)
    assert packing.pack(frame(spark, []), BYTE_BPE).count() == 0


def test_plan_uses_no_more_than_there_is():
    r = np.random.default_rng(1)
    histogram = r.integers(0, 30, 65)
    histogram[[0, 64]] = 0
    used = np.zeros(65, int)
    for n, *lengths in packing.plan(histogram, 64):
        assert sum(lengths) == 64 and n > 0
        np.add.at(used, lengths, n)
    assert (used <= histogram).all() and used.sum() > 0.8 * histogram.sum()


def components(texts, percent):
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset() for w in (re.sub("[A-Z]", lambda m: m[0].lower(), x or "").split() for x in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root, [len(x) for x in sets]


def test_near_duplicates(spark, monkeypatch):
    r = random.Random(4)

    def edited(text, n):
        words = text.split()
        for _ in range(n):
            words[r.randrange(len(words))] = "changed%d" % r.randrange(10**6)
        return " ".join(words)

    base = [prose(300, 11), prose(120, 12), prose(60, 13)]
    texts = [None, "", " \n", "Hi there", "hi  THERE", prose(20, 3), *(edited(x, k % 6) for x in base for k in range(25)), *[base[0]] * 5, *(prose(80, k) for k in range(50, 80))]
    r.shuffle(texts)
    roots, sizes = components(texts, 85)
    for block, hot, few in ((512, 8192, 10**6), (8, 8192, 0), (8, 16, 0)):
        monkeypatch.setattr(neardup, "BLOCK", block)
        monkeypatch.setattr(neardup, "HOT", hot)
        monkeypatch.setattr(components_module, "BROADCAST_ROWS", few)
        got = {x.doc_id: x for x in neardup.near_duplicates(frame(spark, texts)).collect()}
        assert [got[i].component_id for i in range(len(texts))] == roots
        assert [got[i].n_shingles for i in range(len(texts))] == sizes
        assert all(x.kept == (x.doc_id == x.component_id) for x in got.values())
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_odd_sketch_estimates():
    r = np.random.default_rng(2)
    for share in (0.7, 0.85, 0.95):
        a = r.integers(0, 2**63, neardup.SAMPLES).astype(np.uint64)
        b = np.where(r.random(len(a)) < share, a, a + np.uint64(1))
        assert abs(neardup.similarity(neardup.sketch(a), neardup.sketch(b)) - (a == b).mean()) < 0.12


def test_gates_lose_no_link():
    """Pairs at the threshold, and rows linked with a member of a leader at the least similarity to it."""
    r, one = np.random.default_rng(5), np.uint64(1)
    for _ in range(3000):
        x = r.integers(0, 2**63, neardup.SAMPLES).astype(np.uint64)
        y = np.where(r.random(len(x)) < 0.85, x, x + one)
        leader = np.where(r.random(len(x)) < 0.7, x, x + one + one)
        a, b, c = map(neardup.sketch, (x, y, leader))
        assert neardup.similarity(a, b) >= 0.85 - neardup.SLACK
        assert neardup.similarity(a, c) < neardup.SAME or neardup.similarity(b, c) >= neardup.TIE


def contained(text, item):
    words, own = (text or "").lower().split(), item.lower().split()
    k = min(5, len(own))
    if not k or len(words) < k:
        return 0
    a, b = ({tuple(x[i : i + k]) for i in range(len(x) - k + 1)} for x in (own, words))
    return len(a & b) / len(a)


def test_decontamination(spark, monkeypatch):
    items = [prose(n, 100 + n) for n in (1, 3, 5, 8, 12, 20, 33, 60, 130)] + ["", None]
    texts = [*ODD, prose(500, 1)]
    for k, x in enumerate(items[:-2]):
        words = x.split()
        texts += [x, prose(2000, k) + " " + x + " " + prose(700, 50 + k), " ".join(words[: len(words) * 9 // 10]), " ".join(words[: len(words) // 2]), prose(33, k) + " " + " ".join(words[::-1])]
    frames = frame(spark, texts).withColumn("item_id", F.lit(5))
    want = {i: sorted((k, round(contained(x, y), 9)) for k, y in enumerate(items) if y and contained(x, y) >= 0.8) for i, x in enumerate(texts)}
    for size, blocks in ((20_000, 10), (3, 10), (2, 2)):
        monkeypatch.setattr(decontaminate, "ITEMS", size)
        monkeypatch.setattr(decontaminate, "BLOCKS", blocks)
        found = decontaminate.contaminated(frames, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
        assert found.columns == [*frames.columns, "hits"]
        assert {r.doc_id: sorted((h.item_id, round(h.containment, 9)) for h in r.hits) for r in found.collect()} == want
    assert decontaminate.contaminated(frame(spark, []), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_chat(spark):
    nasty = ["\\", "<s>", "</s>[INST] ok [/INST]", "<\\s>", "[[INST]INST]", "[ROLE]x[:]y[/ROLE]", "\\\\<</SYS>>", "", None, "line\nline é"]
    rows = [(c, t, role, nasty[(c + t) % len(nasty)], "x") for c in range(12) for t, role in enumerate(["system", "user", "assistant", "tool[:]", None][: 1 + c % 5])] + [(None, 1, "user", "lost", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.render(turns.repartition(4))
    read = {r.conv_id: r for r in made.withColumn("turns", chat.read_back(F.col("formatted"), chat.INST)).collect()}
    assert set(read) == set(range(12))
    for c, r in read.items():
        assert [(t.role, t.text) for t in r.turns] == [(a or "", x or "") for k, _, a, x, _ in rows if k == c]
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.valid == ([x[2] for x in rows if x[0] == c] == ["system", "user", "assistant"])
        assert [t.text for t in r.turns if t.loss] == [x[3] or "" for x in rows if x[0] == c and x[2] == "assistant"]
    assert chat.render(turns.limit(0)).count() == 0


def measures(x):
    words = re.findall(r"[^\x20\x09-\x0D]+", x or "")
    counts, covered = Counter(zip(words, words[1:], words[2:])), set()
    for k in range(len(words) - 2):
        if counts[words[k], words[k + 1], words[k + 2]] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [y for y in (x or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", x or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    r = random.Random(8)
    texts = [*ODD, "a b c a b c a b c", "x\nx\n \nx\n", prose(60) + " " + prose(60), *("\n".join(prose(30, r.randrange(9)) for _ in range(3)) + " #$% |" * (k % 3) for k in range(40))]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(texts))] + [(None, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))
    got = {x.doc_id: x for x in quality.judged(docs, labels).collect()}
    for i, x in enumerate(texts):
        y, m = got[i], measures(x)
        assert (y.n_words, y.word_chars, y.n_symbols, y.n_dup_lines, y.n_repeat_words) == m, x
        assert y.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0]) and y.kept == (not y.base_failed)  # too few labels for a cutoff
    assert quality.judged(docs.limit(0), labels).count() == 0


def test_risk_bound(spark):
    from math import comb

    rows = spark.createDataFrame([(n, x) for n in (0, 10, 300, 440, 3000) for x in (0.5, 0.0125, 1e-4)], "n long, level double")
    for r in rows.withColumn("k", quality.most_exceeding(F.col("n"), 0.01, F.log("level"))).collect():
        below = [sum(comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(k + 1)) for k in range(r.n // 100 + 1)]
        assert r.k == max((k for k, p in enumerate(below) if p <= r.level), default=-1), r
    # 40,000 good texts, one in a hundred with symbols at 0.12, one in a thousand at 0.18; bad ones at 0.125: the lowest cutoffs are not safe, 0.12 is
    symbols = F.when(~F.col("good"), 62).when(F.col("id") % 100 == 0, 60).when(F.col("id") % 1000 == 1, 90).otherwise(4)
    texts = spark.range(40_500).withColumn("good", F.col("id") < 40_000)
    texts = texts.select("good", F.lit("en").alias("stratum"), F.lit(100).alias("n_words"), F.lit(500).alias("word_chars"), symbols.alias("n_symbols"), F.lit(0).alias("n_dup_lines"), F.lit(0).alias("n_repeat_words"))
    assert quality.cutoffs(texts, "stratum").first().cut_symbols == 0.12
    assert quality.cutoffs(texts.limit(300), "stratum").count() == 0


def test_quality_with_safe_cutoffs(spark):
    """Every text of a stratum against the plain statement of the method."""
    from math import comb

    texts = [prose(60, k) for k in range(700)] + [prose(60, k).replace(" ", " #$% ", 40) for k in range(700, 740)] + [prose(60, k).replace(" ", " # ", 6) for k in range(740, 745)]
    labels = spark.createDataFrame([(k, int(k < 700 or k >= 740), 0) for k in range(745) if k % 25 or k >= 700], "doc_id long, quality int, toxic int")
    docs = frame(spark, texts).withColumn("lang", F.lit("en"))
    got = {x.doc_id: x for x in quality.judged(docs, labels).collect()}
    score = {k: [got[k].n_symbols / got[k].word_chars, got[k].word_chars / got[k].n_words, got[k].n_dup_lines / got[k].n_words, got[k].n_repeat_words / got[k].n_words] for k in got}
    usable = [k for k in score if (k % 25 or k >= 700) and not got[k].base_failed]
    good = [k for k in usable if k < 700 or k >= 740]
    grids, best = [g for _, g in quality.RULES.values()], None
    for chain, (order, weight) in enumerate(quality.CHAINS):
        places, cuts = [list(quality.RULES).index(x) for x in order], [float("inf")] * 4
        steps = [(p, c) for p in places for c in grids[p]]
        for at, (p, c) in enumerate(steps, 1):
            cuts[p] = c
            over = lambda k: any(s > x for s, x in zip(score[k], cuts, strict=True))
            exceed = sum(map(over, good))
            if sum(comb(len(good), i) * 0.01**i * 0.99 ** (len(good) - i) for i in range(exceed + 1)) > 0.05 * weight or exceed > 0.01 * len(good):
                break
            found = (sum(map(over, usable)) - exceed, -exceed, at, -chain), list(cuts)
            best = max(best, found) if best else found
    for k, x in got.items():
        assert x.kept == (not x.base_failed and not any(s > c for s, c in zip(score[k], best[1], strict=True))), k
    assert not any(got[k].kept for k in range(700, 740)) and sum(got[k].kept for k in range(700)) > 690


def test_personal_data(spark):
    shapes = ["mail %s.9@mail9.example.com now", "call +1 (415) 555-0134 now", "pay 4111111111111111 now", "at 10.2.3.4 now", 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" now', "in 1999 there were 12 of 345"]
    r = random.Random(2)
    texts = [prose(20, k) + " " + shapes[k % 6].replace("%s", prose(1, k).strip(".,")) + " " + prose(20, k + 1) for k in range(300)]
    texts += [None, "", "@", "a@b", "x@y.z_w@q.r", "1.2.3.4.5.6.7.8", "999.1.1.1", "0000000001.2.3.4", "+1+1 23456789 0", "9" * 6000, "1.1.1." * 3000, "a." * 5000 + "@", "é 4111 1111 1111 1111."]
    docs = frame(spark, texts)
    field = pii.train(docs)
    got = {x.doc_id: x for x in pii.detect(docs, field).withColumn("masked", pii.masked(F.col("text"), F.col("spans"))).collect()}
    for i, x in enumerate(texts):
        x = x or ""
        base = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x if len(x) < 9000 else "")]
        base += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(len(y.lstrip("0")) < 4 and int(y) < 256 for y in m[0].split("."))]
        base += [(*m.span(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
        base += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert [(s.start, s.end, s.kind) for s in got[i].base_spans] == sorted(base, key=lambda s: (s[0], pii.KINDS.index(s[2]))), x[:99]
        assert {tuple(s) for s in got[i].base_spans} <= {tuple(s) for s in got[i].spans}
        if i < 300 and i % 6 == 4:
            assert [s.kind for s in got[i].spans] == ["secret"] and "9f86d081" not in got[i].masked and 'token = "<SECRET>"' in got[i].masked
        if i < 300 and i % 6 == 5:
            assert not got[i].spans and got[i].masked == x
    assert got[300].masked is None
    assert pii.detect(docs.limit(0), pii.train(docs.limit(0))).count() == 0


def test_segmentations_are_summed_and_decoded():
    r = random.Random(6)
    text = "card 4111 1111 x@y.z 1999 or"
    tokens = [m.span() for m in re.finditer(r"\S+", text)]
    field = pii.Field()
    ends = field.segments(text, tokens)
    for e in ends:
        for _, _, found in e:
            for f in found:
                field.weights.setdefault(f, [r.uniform(-1, 1) for _ in pii.KINDS])

    def every(j):  # segmentations of the first j tokens: (score, segments)
        if not j:
            return [(0.0, ())]
        out = list(every(j - 1))
        for i, span, found in ends[j - 1]:
            for kind, x in enumerate(field.scores(found)):
                out += [(s + x, (*parts, (i, j - 1, span, kind, tuple(found)))) for s, parts in every(i)]
        return out

    whole = every(len(tokens))
    best = max(whole, key=lambda x: x[0])
    assert field.decode(text, tokens) == [(*span, pii.KINDS[kind]) for _, _, span, kind, _ in best[1]]
    gold = {tuple(best[1][0][2]): pii.KINDS[best[1][0][3]]}
    z = sum(np.exp(s) for s, _ in whole)
    want = Counter()
    for s, parts in whole:
        for _, _, _, kind, found in parts:
            for f in found:
                want[f, kind] -= np.exp(s) / z
    for f in best[1][0][4]:
        want[f, best[1][0][3]] += 1
    before = {f: list(w) for f, w in field.weights.items()}
    field.fit([(text, tokens, gold)], epochs=1, rate=1.0)
    for (f, kind), g in want.items():  # a step of the adaptive rate: g / sqrt(1 + g * g)
        assert abs(field.weights[f][kind] - before[f][kind] - g / np.sqrt(1 + g * g)) < 2e-3, (f, kind)


def test_twins():
    part = "at 10.2.3.4 pay 4111111111111111 or +1 415 555 0134 now"
    own = sorted(pii.base_spans(part))
    made = list(pii.twins(part, own))
    assert [x for x, _ in made] == [part.replace("10.2", "9910.2"), part.replace("1111 or", "1112 or"), part.replace("+1 4", "1 4")]
    for x, spans in made:
        assert [x[a:b] for a, b, _ in spans] == [x[a:b] for a, b, _ in sorted(pii.base_spans(x))] + ["1 415 555 0134"] * ("+" not in x)


def test_html(spark):
    pages = [htmltext.generated(i) for i in range(40)]
    rows = [(i, "u", x, "old") for i, x in enumerate([None, "", "plain", "<p>", "<script>var a='</p>';", "<article><p>a&amp;b\n c</p></article", *pages])]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    model = htmltext.train(table)
    got = {r.page_id: r.text for r in htmltext.extract(table, model).collect()}
    assert got[0] == got[1] == got[3] == got[4] == ""
    right = 0
    for k in range(1000, 1100):  # held-out pages
        page = htmltext.generated(k)
        right += model.extract(page) == "\n\n".join(x.text for x in htmltext.labelled(page) if x.text and x.label)
    assert right >= 90
    page = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav><!-- <p>x</p> --><article><h1>A title here</h1><p>First  part,<br>with <b>bold &amp; more.<p>Second part of it, longer &eacute; words.</p></article><footer>&copy; us</footer>"
    assert model.extract(page) == "A title here\n\nFirst part, with bold & more.\n\nSecond part of it, longer é words."
    assert htmltext.extract(table.limit(0), htmltext.train(table.limit(0))).count() == 0


PARTS = [
    "<ul><li>One</li><li>Two</li><li>Three things</li></ul>", "<ol><li>First</li><li>Second</li></ol>", "<h3>Short head</h3>", "<table><tr><th>Name</th><th>Size</th></tr><tr><td>A</td><td>12</td></tr></table>",
    "<dl><dt>Term</dt><dd>What it means here.</dd></dl>", "<details><summary>More</summary><p>Hidden text is here.</p></details>", "<figure><img src=x><figcaption>A view</figcaption></figure>", "<p><a href=x>A paragraph that is a link</a></p>",
    "<pre>x = 5</pre>", "<blockquote>Short quote.</blockquote>", "<p>Let <math><mi>x</mi><mo>=</mo><mn>5</mn></math> hold</p>", "<button>ok", "<svg><path>", "<video><source>", "<select><option>a",
]


def test_articles_stay_whole():
    """Parts of an article in containers of three kinds, between a header, a menu and a footer, by a model of generated pages only."""
    trees = [(htmltext.contained(htmltext.labelled(htmltext.generated(i)), i), i % 7 == 1) for i in range(htmltext.GENERATED)]
    model = htmltext.Tree().fit(trees)
    one = "<p>This is a long paragraph of running text, which says what the article is about and goes on for a while.</p>"
    two = "<p>Another paragraph follows, with more of the story, and it ends with a full stop after some words.</p>"
    menu = "".join(f"<li><a href={x}>{x} page</a></li>" for x in ("Home", "About", "News"))
    for part in PARTS:
        inner = f"<h1>The title of it</h1>{one}{part}{two}"
        want = "\n\n".join(x.text for x in htmltext.parse(inner) if x.text)
        assert two[3:-4] in want
        for kind in ("article", "main", 'div class="content"'):
            page = f"<html><body><header><h1>Site</h1></header><nav><ul>{menu}</ul></nav><{kind}>{inner}</{kind.split()[0]}><footer>&copy; Site, all rights reserved</footer></body></html>"
            assert model.extract(page) == want, (part, kind)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><p>a</p><script>for(var i=0;i<n;i++){f(i)}</script><p>b</p>", ["a", "b"]), ("<p>a</p><style>a:before{content:'<b'}</STYLE ><p>b", ["a", "b"]), ("<p>a<script>x = '</p>'", ["a"]),
        ("<head><title>T</title><body><p>a</p>", ["a"]), ("<head><meta charset=utf-8><title>a<b</title><p>a</p>", ["a"]), ("<head><script>if(a<b)c()</script></head><body>a", ["a"]), ("<head><title>T</title>a", ["a"]),
        ("<svg><script>i<n</script><p>x</p></svg><p>a", ["a"]), ("<p>a<button>ok<p>b</p><button>x</button><p>c", ["a", "b", "c"]), ("<div>a<svg><path></div>b<audio>", ["a", "b"]), ("<p>x <math><mi>y</mi></math>", ["x y"]), ("<select><p>a</select><p>b", ["b"]), ("<select><option>x<option>y</select><p>a", ["a"]), ("<script src='x'/><p>a", ["a"]),
        ("if a < b then c", ["if a < b then c"]), ("<p>1 < 2 and 3 <4 > 5", ["1 < 2 and 3 <4 > 5"]), ("<p>a</p>b < c <p class='x", ["a", "b < c"]), ("a <!-- b", ["a"]), ("a </p", ["a"]), ("a <", ["a <"]),
        ("<p title='a>b</p><p>c", ["b", "c"]), ("<p title='>'>b</p>", ["b"]), ("<p x='>", []), ("<div>a<ul><li>b<div><p>c</div><li>d</ul>e", ["a", "b", "c", "d", "e"]),
    ],
)
def test_page_text_is_whole(page, want):
    assert [x.text for x in htmltext.parse(page) if x.text] == want


def test_page_marginals_sum_over_all_labels():
    from itertools import product

    r = random.Random(11)
    for k in range(6):
        nodes = [htmltext.Node("root", -1)]
        for i in range(1, 8):
            up = r.choice([j for j, x in enumerate(nodes) if not x.text])
            nodes.append(htmltext.Node(r.choice(["div", "p", "article"]), up, ["ad"] * (i % 2)) if r.random() < 0.5 else htmltext.Node("text", up, text="Some words, here."))
        model = htmltext.Tree()
        found = [htmltext.features(x, nodes, False) for x in nodes]
        model.weights = {f: r.uniform(-2, 2) for fs in found for f in fs}
        model.pairs = {kind: [[r.uniform(-2, 2) for _ in "ab"] for _ in "ab"] for kind in (False, True)}
        own, total, ones, edges = [sum(model.weights[f] for f in fs) for fs in found], 0.0, np.zeros(len(nodes)), np.zeros((len(nodes), 2, 2))
        for labels in product((0, 1), repeat=len(nodes)):
            score = sum(x for x, y in zip(own, labels, strict=True) if y) + sum(model.pairs[bool(x.text)][labels[x.parent]][y] for x, y in zip(nodes[1:], labels[1:], strict=True))
            total += (weight := np.exp(score))
            ones += weight * np.array(labels)
            for i, x in enumerate(nodes[1:], 1):
                edges[i, labels[x.parent], labels[i]] += weight
        got, pairs = model.marginals(nodes)
        assert np.allclose(got, ones / total)
        for i in range(1, len(nodes)):
            assert np.allclose(np.exp(pairs[i]) / np.exp(pairs[i]).sum(), edges[i] / total)


def test_pages_take_time_in_proportion():
    import time

    n, began = 16_000, time.time()
    for page in ("<a ", '<a "', '<a x=">" ', "<script></script ", "<!--", "<", "&", "<p", "<li><p>", "<dd><li>"):
        htmltext.parse(page * n)
    htmltext.parse("<div>" * n + "</p>" * n)
    htmltext.parse("<li><ul>" + "<div>" * n + "<li></li>" * n)
    assert time.time() - began < 10


def test_language(spark):
    r = random.Random(5)
    parts = {"aa": ["lo", "mi", "ta", "re"], "bb": ["sch", "en", "ung", "er"], "cc": ["eau", "oi", "ment", "que"]}

    def words(lang, n):
        return " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))

    rows = [(i, words(x, 30), x) for i, x in enumerate(["aa", "bb", "cc"] * 40)] + [(900, None, "aa"), (901, "12 34 !", "aa"), (902, "², ½", None), (903, "x" * 5000, None), (904, words("bb", 4), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs.where("doc_id < 60"), PIECES)
    got = {x.doc_id: x for x in language.identify(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:120]) and got[904].lang_pred == "bb"
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred in parts
    assert all(0 <= x.score <= 1 for x in got.values())
    none = language.train(docs.limit(0), PIECES)
    assert {x.lang_pred for x in language.identify(docs, none).collect()} == {"und"}


def segmentations(word, pieces):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if n == 1 or word[:n] in pieces:
            for rest in segmentations(word[n:], pieces):
                yield [pieces.get(word[:n], len(pieces)), *rest]


def test_language_sums_all_segmentations():
    r, g = random.Random(3), np.random.default_rng(3)
    pieces = {x: i for i, x in enumerate(["▁", "a", "b", "ab", "▁a", "ba", "aab", "bb", "▁ba"])}
    chances = np.vstack([g.random((len(pieces) + 1, 2)) / 10, np.zeros((1, 2))])
    model = language.Model(["x", "y"], pieces, chances)
    found = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(60)})
    for safe in (model.safe, 0):  # products, then sums of logarithms
        model.safe = safe
        got = language.log_chances(found, model)
        for k, word in enumerate(found):
            every = list(segmentations("▁" + word, pieces))
            weights = np.array([chances[s].prod(axis=0) for s in every])
            assert np.allclose(np.exp(got[k]), weights.sum(axis=0))
            want = sum(w / weights[:, 1].sum() * np.bincount(s, minlength=len(chances)) for w, s in zip(weights[:, 1], every, strict=True))
            assert np.allclose(language._expected_short(["▁" + word], np.array([1.0]), model, 1), want)
            assert np.allclose(language._expected_long("▁" + word, 1, model, 1, block=2), want)


def test_language_of_long_unknown_runs():
    pieces = {x: i for i, x in enumerate(["▁", "a", "ab"])}
    model = language.Model(["x", "y"], pieces, np.array([[1e-12, 1e-12], [1e-12, 1e-11], [1e-12, 1e-12], [1e-12, 1e-12], [0, 0]]))
    (one,) = language.log_chances(["z" * 1000], model)
    assert np.allclose(one, 1001 * np.log(1e-12))
    assert np.isclose(language._expected_long("▁" + "z" * 1000, 3.0, model, 0, block=100)[3], 3000)
    scored = language.Scorer(model).score(["z" * 1000 + "a", "a" * 3000, "z" * 40])
    assert scored[0][0] == "y" and scored[1] == ("y", 1.0) and scored[2] == ("x", 0.5)
    assert language.words("x" * 5000 + " ½y") == ["x" * 5000, "y"]


def test_licenses(spark):
    full = licenses.TEMPLATES["MIT"][3]
    words = full.split()
    texts = [None, "", "license license license", prose(900), prose(50) + "\nReleased under the MIT License.\n" + prose(40, 2), full, prose(30) + " " + " ".join(w for k, w in enumerate(words) if k % 12) + " " + prose(30, 2), " ".join(words[::3]), (full + "\n") * 3, "İK Licensed under CC BY-NC 4.0."]
    got = {r.doc_id: r.licenses for r in licenses.scan(frame(spark, texts)).collect()}
    assert [len(got[i]) for i in range(len(texts))] == [0, 0, 0, 0, 1, 1, 1, 0, 3, 1]
    assert texts[4][got[4][0].start : got[4][0].end] == "Released under the MIT License" and got[5][0].coverage == 1
    assert 0.8 <= got[6][0].coverage < 1 and {h.license for i in (4, 5, 6, 8) for h in got[i]} == {"MIT"} and got[9][0].license == "CC-BY-NC-4.0"
    assert licenses.scan(frame(spark, [])).count() == 0


def test_patience_alignment():
    a, b = "the quick brown fox jumps over the dog".split(), "x the quick red fox jumps the dog y".split()
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and [i for i, _ in pairs] == sorted({i for i, _ in pairs}) and [j for _, j in pairs] == sorted({j for _, j in pairs})
    assert len(pairs) == 6


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_against_brute_force():
    r = random.Random(21)
    for _ in range(200):
        a, b = r.sample(range(30), r.randint(0, 20)), r.sample(range(30), r.randint(0, 20))
        assert len(licenses.align(a, b)) == common(a, b)  # words that stand once: the best there is
        a, b = ([r.randrange(6) for _ in range(r.randint(0, 15))] for _ in "ab")
        pairs = licenses.align(a, b)
        assert len(pairs) <= common(a, b) and all(a[i] == b[j] for i, j in pairs) and all(p < q and x < y for (p, x), (q, y) in zip(pairs, pairs[1:], strict=False))


def test_license_scan_against_brute_force():
    r = random.Random(22)
    template = [f"w{k}" for k in range(24)]
    scanner = licenses.Scanner({"L": [" ".join(template)]}, 0.8)
    need, reach, seen = 0.8 * len(template), len(template) * 3 // 2 + 2, Counter()
    for k in range(150):
        text = [f"x{r.randrange(40)}" if r.random() < 0.8 else r.choice(template) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 2)):
            at, copy = r.randint(0, len(text)), [w for w in template if r.random() > r.choice([0, 0.1, 0.2, 0.3])]
            for _ in range(r.randint(0, 4)):
                copy.insert(r.randint(0, len(copy)), "y")
            text[at:at] = copy
        hits = scanner.scan(" ".join(text))
        best = max((common(template, text[i : i + reach]) for i in range(len(text))), default=0)
        if best < need:
            assert not hits  # no window holds enough
        elif best >= need + 2:
            assert hits
        for h in hits:
            words = " ".join(text)[h["start"] : h["end"]].split()
            assert need <= h["coverage"] * 24 + 1e-9 and h["coverage"] * 24 <= common(template, words) + 1e-9
        assert all(x["end"] <= y["start"] for x, y in zip(hits, hits[1:], strict=False))
        seen[len(hits)] += 1
    assert min(seen[0], seen[1]) > 10 and seen[2] > 3
    many = scanner.scan((" ".join(template) + " ") * 3000)
    assert len(many) == 3000


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    item = prose(30, 77)
    twin = prose(200, 5)
    texts = [twin, twin.replace(twin.split()[7], "new", 1), prose(100, 6) + " " + item, None, "", "12 34", prose(90, 8) + " mail me.9@mail9.example.com please", *(prose(70, k) for k in range(20, 40))]
    rows = [(i, x, "en", "s", len(x) if x else None) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    every = set(range(len(texts)))
    assert kept == [every - {3, 4, 5}, every - {1, 3, 4, 5}, *[every - {1, 2, 3, 4, 5}] * 3]
    masked = spark.read.parquet(f"{tmp_path}/personal_data").where("doc_id = 6").first()
    assert "<EMAIL>" in masked.text and "@" not in masked.text and masked.n_chars == len(masked.text)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "start", "length", "ids_crc32").collect()))


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    a, b, c = prose(120, 1), prose(120, 2), prose(120, 3)
    near = b.replace(b.split()[5], "other", 1)
    rows = [(1, a), (1, a), (2, b), (5, near), (5, c), (7, None), (7, None), (None, a), (8, ""), (9, c), (10, prose(60, 9)), (10, prose(60, 9) + " end"), (11, prose(60, 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("hits", "spans", "score", "id", "quire", "text_key", "group", "kept", "component_id", "rest"):
        docs = docs.withColumn(name, F.lit("x"))
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    tens = [x for x in left if x[0] == 10]
    assert len(tens) == 1 and sorted((x for x in left if x[0] != 10), key=repr) == sorted([(1, a), (2, b), (5, c), (7, None), (7, None), (None, a), (8, "")], key=repr)
    spark.createDataFrame([(1, c)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for empty in (False, True):
        rows = docs.withColumn("lang", F.lit("en")).where(F.lit(not empty))
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, rows, str(tmp_path))
            assert name == "packing" or found.columns == rows.columns
            n = {"language_id": 10, "near_duplicates": 8, "decontamination": 11, "personal_data": 13}.get(name, found.count())
            assert found.count() == (0 if empty else n), name


def test_queries_read_back(spark):
    from quire.llm import queries

    row = next(r for r in queries.op2_chat_format(spark, "/root/testdata/sf0.001").collect() if r.conv_id == -1)
    text = "</s>[INST] ok [/INST]"
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, 21, hashlib.sha256(text.encode()).hexdigest())
    assert zlib.crc32(b"") == 0


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "Released under the MIT License. " + prose(60), "en", 5), (1, "Released under the MIT License. " + prose(60), "en", 5), (None, None, None, None)]
    names = ["hits", "licenses", "spans", "base_spans", "lang_pred", "score", "html", "n", "row", "bands", "kept", "n_words", "cluster", "ids", "rest"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, id long")
    for x in names:
        docs = docs.withColumn(x, F.lit("x"))
    items = spark.createDataFrame([(1, "y z")], "item_id long, text string")
    assert [len(r.hits) for r in decontaminate.contaminated(docs, items).orderBy("doc_id").collect()] == [0, 0, 0]
    assert [len(r.licenses) for r in licenses.scan(docs).orderBy("doc_id").collect()] == [0, 1, 1]
    assert [len(r.spans) for r in pii.detect(docs, pii.train(docs)).collect()] == [0, 0, 0]
    found = language.identify(docs, language.train(docs, PIECES)).orderBy("doc_id").collect()
    assert [r.lang_pred for r in found] == ["und", "en", "en"] and found[1].licenses == "x"
    assert [r.text for r in htmltext.extract(docs.withColumn("html", F.lit("")), htmltext.train(docs.withColumn("html", F.lit("")))).collect()] == ["", "", ""]
    assert [r.n_bytes for r in tokencount.token_counts(docs, PIECES).orderBy("doc_id").collect()][0] == 0 and tokencount.token_counts(docs, PIECES).count() == 3
    assert {r.doc_id for r in packing.pack(docs, BYTE_BPE).collect()} == {None, 1}
    assert [(r.doc_id, r.kept) for r in neardup.near_duplicates(docs).collect()] == [(1, True), (1, True)]
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, quality int")
    assert sorted(r.base_failed for r in quality.judged(docs, labels).collect()) == [False, False, True]
