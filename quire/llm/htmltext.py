"""Main text of web pages by a tree-structured graphical model (operator 7).

A page becomes a tree: block elements, and below them leaves of running text. Every node is content or not; its features give a
potential, and each pair of parent and child has another. Sum-product messages, once up and once down the tree, give each leaf's
marginal probability of being content. The weights maximise the likelihood of labelled pages: generated ones with known
parts, and a bounded sample of given pages whose own article, navigation and footer elements label them; one of five labelled
pages has those elements renamed, so that the model also learns from text and structure.
"""

from __future__ import annotations

import bisect
import html
import math
import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Given pages that the model is fitted on, at most about; generated ones; passes through them.
SAMPLE, GENERATED, EPOCHS = 150, 500, 14
# Elements by their role in HTML.
BLOCKS = set(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style title noscript template textarea select option button iframe svg object canvas datalist audio video".split())
RAW = set("script style title noscript textarea iframe".split())  # of the silent ones: no tags inside but their own end
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
ITEMS = {"p", "li", "dd", "dt"}
CUES = (
    "ad ads advert advertisement banner promo promoted sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side aside cookie cookies consent gdpr notice "
    "alert popup modal comment comments reply replies disqus share sharing social related recommended newsletter subscribe signup login search form widget pagination tags copyright "
    "article content main post entry story body text page"
).split()
_cues = set(CUES)
_name = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_stop = re.compile("[>\"']")
_raw_end = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in RAW}
_tag = re.compile("</?[a-zA-Z]")
_named = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_word = re.compile(r"[a-z]+")


class Node:
    """An element or, with text, a leaf."""

    __slots__ = ("tag", "cues", "parent", "text", "chars", "linked", "leaves", "label")

    def __init__(self, tag: str, parent: int, cues: list[str] | None = None, text: str = "", linked: int = 0) -> None:
        self.tag, self.parent, self.cues, self.text, self.linked = tag, parent, cues or [], text, linked
        self.chars, self.leaves, self.label = len(text), int(bool(text)), 0


class Tags:
    """Ends of tags in one page, found in time proportional to the page whatever it holds."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, {c: page.rfind(c) for c in ">\"'"}
        self.quoted = True  # until a tag is found that only a sign in quotes could end
        self.places: dict[str, list[tuple[int, bool]]] = {}

    def end(self, at: int) -> int:
        """The place of the sign that ends the tag whose name ends at ``at``, -1 for none: signs in closed quotes don't count."""
        if at > self.last[">"]:
            return -1
        k = at
        while self.quoted:
            m = _stop.search(self.page, k)
            if not m:
                self.quoted = False
            elif m[0] == ">":
                return m.start()
            elif m.start() < self.last[m[0]]:
                k = self.page.find(m[0], m.end()) + 1
            else:
                k = m.end()
        return self.page.find(">", at)

    def closed(self, tag: str, at: int) -> bool:
        """Whether an element that begins before ``at`` has an end tag before the next of its kind begins."""
        if tag not in self.places:
            self.places[tag] = [(m.start(), m[0][1] == "/") for m in re.finditer(rf"</?{tag}(?=[\s/>])", self.page, re.I)]
        k = bisect.bisect_left(self.places[tag], (at, False))
        return k < len(self.places[tag]) and self.places[tag][k][1]


def parse(page: str) -> list[Node]:
    """Nodes of the tree in page order, parents first; the first is the root.

    The head needs no end of its own: what may stand in it is silent or void, and anything else belongs to the body. Scripts,
    styles and the like end at their own end tag, or with the page; buttons, drawings, players and such that have no end tag of their own end at the next block. A sign that starts no tag is text, and so is what follows
    it; an unfinished last tag or comment is none. Time is proportional to the page.
    """
    nodes, stack, run, links = [Node("root", -1)], [("root", 0)], [], 0
    linked, silent, until_block, at, tags = 0, "", False, 0, Tags(page)
    places: dict[str, list[int]] = defaultdict(lambda: [-1])  # in the stack, by name; "" for all but items

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(run).split()) if run else ""
        if text:
            nodes.append(Node("text", stack[-1][1], text=text, linked=min(linked, len(text))))
        run.clear()
        linked = 0

    def close(to: int) -> None:
        for name, _ in stack[to:]:
            places[name].pop()
            if name not in ITEMS:
                places[""].pop()
        del stack[to:]

    def say(text: str) -> None:
        nonlocal linked
        if not silent and text:
            piece = html.unescape(text)
            run.append(piece)
            if links:
                linked += len(piece.strip())

    seen = 0
    while (here := page.find("<", seen)) >= 0:
        if page.startswith("<!--", here):
            end = page.find("-->", here + 4) + 2
            say(page[at:here])
            at = seen = end + 1 if end > 1 else len(page)
            continue
        if page[here + 1 : here + 2] in ("!", "?"):
            end = page.find(">", here)
            say(page[at:here])
            at = seen = end + 1 if end >= 0 else len(page)
            continue
        name = _name.match(page, here + 1)
        end = tags.end(name.end()) if name else -1
        if end < 0:
            seen = here + 1
            continue
        say(page[at:here])
        at = seen = end + 1
        tag, inside, ends = name[1].lower(), page[name.end() : end], page[here + 1] == "/"
        if tag in RAW and not ends:
            if not inside.endswith("/"):
                found = _raw_end[tag].search(page, at)
                end = page.find(">", found.end()) if found else -1
                at = seen = end + 1 if end >= 0 else len(page)
            continue
        if silent and until_block and tag in BLOCKS:
            silent = ""
        if silent:
            if ends and tag == silent:
                silent = ""
            continue
        if ends:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS:
                flush()
                if places[tag][-1] > 0:
                    close(places[tag][-1])
            continue
        if tag in SILENT:
            silent = "" if inside.endswith("/") else tag
            until_block = bool(silent) and not tags.closed(tag, at)
        elif tag == "br":
            run.append(" ")
        elif tag == "a":
            links = 1
        elif tag in BLOCKS:
            flush()
            links = 0
            ended = max(places[x][-1] for x in ("p", *CLOSES.get(tag, ())))  # implied ends
            if 0 < ended >= max(places[x][-1] for x in SCOPES.get(tag, ("",))):
                close(ended)
            if tag not in VOID and not inside.endswith("/"):
                cues = [w for x in _named.findall(inside) for w in _word.findall(x.lower()) if w in _cues] if inside else None
                nodes.append(Node(tag, stack[-1][1], cues))
                places[tag].append(len(stack))
                if tag not in ITEMS:
                    places[""].append(len(stack))
                stack.append((tag, len(nodes) - 1))
    if not silent and at < len(page):
        unfinished = _tag.search(page, max(at, page.rfind(">") + 1))
        run.append(html.unescape(page[at : unfinished.start()] if unfinished else page[at:]))
    flush()
    for node in reversed(nodes[1:]):
        up = nodes[node.parent]
        up.chars += node.chars
        up.linked += node.linked
        up.leaves += node.leaves
    return nodes


def bucket(n: int) -> int:
    return min(n.bit_length(), 12)


def features(node: Node, nodes: list[Node], plain: bool) -> list[str]:
    """Of one node; plain: elements with a telling name look like div."""
    up = nodes[node.parent] if node.parent >= 0 else node
    density = 4 * node.linked // max(node.chars, 1)
    if node.text:
        words = node.text.count(" ") + 1
        stops = node.text.count(".") + node.text.count(",")
        return [
            "leaf", f"leaf words {bucket(words)}", f"leaf links {density}", f"leaf stops {min(stops, 4)}", f"leaf end {node.text[-1] in '.!?:'}",
            f"leaf in {up.tag if not plain or up.tag not in TELLING else 'div'}", f"leaf sign {node.text[0] in '©'}",
        ]
    tag = "div" if plain and node.tag in TELLING else node.tag
    out = [f"tag {tag}", f"chars {bucket(node.chars)}", f"links {density}", f"mean {bucket(node.chars // max(node.leaves, 1))}", f"leaves {bucket(node.leaves)}"]
    if not plain:
        out += [f"cue {x}" for x in node.cues]
    return out


TELLING = {"article", "main", "nav", "aside", "footer", "header", "form"}


class Tree:
    """Weights by feature, and of (parent, child) labels for leaves and for elements."""

    def __init__(self) -> None:
        # the page itself is no content, whatever is in it
        self.weights: dict[str, float] = {"tag root": -8.0, "tag html": -8.0, "tag body": -8.0}
        self.pairs = {kind: [[0.0, 0.0], [0.0, 0.0]] for kind in (False, True)}

    def marginals(self, nodes: list[Node], plain: bool = False, found: list[list[str]] | None = None):
        """(P(content) of each node, P(parent, child) of each node's edge to its parent)."""
        get = self.weights.get
        found = found or [features(x, nodes, plain) for x in nodes]
        own = [[0.0, sum(get(f, 0.0) for f in fs)] for fs in found]
        below = [[*x] for x in own]  # own potential and messages from the children
        up = [None] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            pair, b, p = self.pairs[bool(nodes[i].text)], below[i], below[nodes[i].parent]
            up[i] = [_add(b[0] + pair[y][0], b[1] + pair[y][1]) for y in (0, 1)]
            p[0] += up[i][0]
            p[1] += up[i][1]
        full = [below[0]] + [None] * (len(nodes) - 1)  # with the message from the parent
        edges = [None] * len(nodes)
        for i in range(1, len(nodes)):
            pair, p = self.pairs[bool(nodes[i].text)], full[nodes[i].parent]
            rest = [p[y] - up[i][y] for y in (0, 1)]
            full[i] = [below[i][y] + _add(rest[0] + pair[0][y], rest[1] + pair[1][y]) for y in (0, 1)]
            edges[i] = [[rest[a] + pair[a][b] + below[i][b] for b in (0, 1)] for a in (0, 1)]
        return [_chance(x[1] - x[0]) for x in full], edges

    def fit(self, pages: list[tuple[list[Node], bool]], epochs: int = EPOCHS, rate: float = 0.3) -> Tree:
        """Adaptive gradient steps: observed minus expected features and label pairs. The weights are the means of those after each pass of the second half."""
        squares: dict = defaultdict(lambda: 1.0)
        sums: dict[str, float] = defaultdict(float)
        pair_sums, means = {kind: [[0.0, 0.0], [0.0, 0.0]] for kind in self.pairs}, epochs - epochs // 2
        ready = [(nodes, [features(x, nodes, plain) for x in nodes]) for nodes, plain in pages]
        for epoch in range(epochs):
            for nodes, found in ready:
                chance, edges = self.marginals(nodes, found=found)
                step: dict = defaultdict(float)
                for i, node in enumerate(nodes):
                    miss = node.label - chance[i]
                    for f in found[i]:
                        step[f] += miss
                    if i:
                        total = _add(_add(*edges[i][0]), _add(*edges[i][1]))
                        for a in (0, 1):
                            for b in (0, 1):
                                step[bool(node.text), a, b] += (nodes[node.parent].label == a and node.label == b) - math.exp(edges[i][a][b] - total)
                for f, g in step.items():
                    squares[f] += g * g
                    move = rate * g / math.sqrt(squares[f])
                    if isinstance(f, str):
                        self.weights[f] = self.weights.get(f, 0.0) + move
                    else:
                        self.pairs[f[0]][f[1]][f[2]] += move
            if epoch >= epochs // 2:
                for f, w in self.weights.items():
                    sums[f] += w / means
                for kind, pair in self.pairs.items():
                    pair_sums[kind] = [[pair_sums[kind][a][b] + pair[a][b] / means for b in (0, 1)] for a in (0, 1)]
        if epochs:
            self.weights, self.pairs = dict(sums), pair_sums
        return self

    def extract(self, page: str | None) -> str:
        """The content leaves' texts, joined by two line ends."""
        if not page:
            return ""
        nodes = parse(page)
        chance, _ = self.marginals(nodes)
        return "\n\n".join(x.text for x, p in zip(nodes, chance, strict=True) if x.text and p > 0.5)


def _add(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high))


def _chance(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -500 else 0.0


def labelled(page: str) -> list[Node]:
    """A tree with labels from the page's own article or main element, and from the parts in it that are never content."""
    nodes = parse(page)
    for node in nodes[1:]:
        up = nodes[node.parent].label
        aside = node.tag in TELLING - {"article", "main"} or bool({"ad", "ads", "comments", "comment", "related", "share", "social"} & set(node.cues))
        node.label = int((up or node.tag in ("article", "main")) and not aside)
    return nodes


def generated(seed: int) -> str:
    """A labelled page: its content is in an article element, its other parts around and in it."""
    r = random.Random(seed)
    bare = r.choice([0] * 8 + [1, 2])  # texts without stops, or of one word again and again

    def prose(low: int, high: int) -> str:
        words = ["".join(r.choice("aeioudnrstlm") for _ in range(r.randint(1, 9))) for _ in range(r.randint(low, high))]
        if bare:
            return " ".join(words[:1] * len(words) if bare > 1 else words).capitalize()
        return re.sub(r"(\w+) (\w+)", lambda m: m[0] + r.choice(["", "", "", ",", "."]), " ".join(words)).capitalize() + "."

    def label() -> str:
        return prose(1, r.choice([1, 3])).rstrip(".")

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{label()}</a></li>' for k in range(n))

    def part(tags: str, classes: str, inner: str) -> str:
        """An element, in one of three cases without a telling name."""
        tag = r.choice(tags.split())
        return f"<{tag}>{inner}</{tag}>" if r.random() < 0.33 else f'<{tag} class="{r.choice(classes.split())}">{inner}</{tag}>'

    def items(tag: str, n: int) -> str:
        return f"<{tag}>" + "".join(f"<li>{r.choice([label, lambda: prose(2, 12)])()}</li>" for _ in range(n)) + f"</{tag}>"

    def table() -> str:
        wide = r.randint(2, 4)
        row = lambda tag: "<tr>" + "".join(f"<{tag}>{r.choice([label(), str(r.randint(1, 9999)), prose(1, 4)])}</{tag}>" for _ in range(wide)) + "</tr>"
        return "<table>" + (row("th") if r.random() < 0.7 else "") + "".join(row("td") for _ in range(r.randint(1, 6))) + "</table>"

    def link() -> str:
        return f'<a href="/{r.randint(1, 99)}">{label()}</a>'

    def block() -> str:
        """Something that stands in an article."""
        long = prose(3, r.choice([8, 20, 60]))
        return r.choice([
            lambda: f"<p>{long}</p>", lambda: f"<p>{long}</p>", lambda: f"<p>{long} {link()} {prose(2, 20)}</p>", lambda: f"<p><b>{long}</b></p>", lambda: f"<h2>{r.choice([label(), long])}</h2>", lambda: f"<h3>{label()}</h3>",
            lambda: items(r.choice(["ul", "ol"]), r.randint(1, 7)), lambda: f"<blockquote>{long}</blockquote>", lambda: f"<blockquote><p>{long}</p></blockquote>", lambda: f"<div>{long}</div>", table,
            lambda: "<dl>" + "".join(f"<dt>{label()}</dt><dd>{prose(2, 15)}</dd>" for _ in range(r.randint(1, 4))) + "</dl>", lambda: f"<figure><img src='i.png'><figcaption>{r.choice([label(), long])}</figcaption></figure>",
            lambda: f"<pre>{label()} = {r.randint(1, 99)}\n  {label()}({label()})</pre>", lambda: f"<details><summary>{label()}</summary><p>{long}</p></details>", lambda: f"<p>{link()}</p>", lambda: f"<p>{label()}: {link()}, {link()}</p>",
        ])()

    before = [
        part("nav div", "nav menu navbar", f"<ul>{links(r.choice([1, 1, 2, 3, 4, 6, 9]))}</ul>"),
        part("header header div", "header masthead banner", f"<h1>{r.choice([label(), link()])}</h1>" + r.choice(["", f"<p>{prose(3, 8)}</p>"])),
        part("div aside", "ad advert promo sponsored", prose(4, 12)),
        part("div section", "cookie notice consent alert", f"<p>{prose(8, 25)}</p><button>ok</button>"),
        part("div ul", "breadcrumb", links(r.randint(1, 4))),
    ]
    after = [
        part("footer footer div", "footer copyright", r.choice([f"&copy; {label()}", f"&copy; {label()} &middot; {prose(4, 14)}", f"<p>&copy; {label()}</p><p>{link()}</p>"])),
        part("aside div", "sidebar widget related", f"<h3>{label()}</h3><ul>{links(r.randint(1, 8))}</ul>"),
        part("aside aside div", "sidebar widget", f"<h3>{label()}</h3><p>{prose(8, 30)}</p>"),
        part("form form div", "newsletter subscribe search form", f"<p>{prose(4, 10)}</p><label>{label()}</label><input>"),
        f'<section class="comments">{"".join(f"""<div class="comment"><p>{label()}</p><p>{prose(5, 40)}</p></div>""" for _ in range(r.randint(1, 5)))}</section>',
        part("aside", "ad ads promoted", prose(4, 12)),
    ]
    body = [f"<h1>{prose(3, 9)}</h1>"] + [block() for _ in range(r.choice([1, 2, 3, 5, 8, 12, 12, 40]))]
    if r.random() < 0.4:
        body.insert(r.randint(1, len(body)), f'<div class="{r.choice("ad advert promo share related".split())}">{prose(3, 10)}</div>')
    wrap = r.choice(["{}", '<div class="page">{}</div>', "<div><div>{}</div></div>"])
    main = f'<article class="{r.choice(["", "content", "post entry", "story"])}">{"".join(body)}</article>'
    chosen = [x for x in before if r.random() < 0.6], [x for x in after if r.random() < 0.6]
    return f"<html><body>{wrap.format(''.join(chosen[0]) + main + ''.join(chosen[1]))}</body></html>"


def contained(nodes: list[Node], seed: int) -> list[Node]:
    """A labelled tree whose article, whatever its name, is of one of five kinds, by the seed."""
    kind = [("article", None), ("main", []), ("div", ["content"]), ("div", []), ("section", ["content"])][seed % 5]
    for node in nodes:
        if node.tag == "article" and kind[1] is not None:
            node.tag, node.cues = kind[0], [*kind[1]]
    return nodes


def train(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> Tree:
    """Fit on generated pages and about ``sample`` given ones, chosen by a hash, that have an article or main element and under 200,000 characters."""
    own = pages.select(F.col(html_col).alias("html")).where(F.col("html").rlike("(?i)<(article|main)\\b") & (F.length("html") < 200_000))
    share = min(1_000_000, -(-sample * 1_000_000 // max(own.count(), 1)))
    given = [r.html for r in own.where(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < share).limit(2 * sample).collect()]
    trees = [(labelled(x), k % 5 == 1) for k, x in enumerate(sorted(given, key=lambda x: zlib.crc32(x.encode())))]
    trees += [(contained(labelled(generated(i)), i), i % 7 == 1) for i in range(GENERATED)]
    random.Random(7).shuffle(trees)
    return Tree().fit(trees)


def _extracted(model, html_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.extract(x.as_py()) for x in batch.column(html_at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], names=batch.schema.names)

    return run


def extract(pages: DataFrame, model: Tree, html_col: str = "html", text_out: str = "text") -> DataFrame:
    """The rows of pages with their main text: blocks in page order, white space inside a block as one space.

    Null, empty and text-free pages give an empty text; a page without markup is one block, judged like any other. What unclosed
    elements, scripts and lone signs mean is said at ``parse``; very long pages take time and memory in proportion. Repeated
    rows are judged one by one, an empty table gives no rows. A column of pages with the new name is replaced.
    """
    pages = pages.drop(text_out)
    out = pages.withColumn(text_out, F.lit(None).cast("string"))
    return out.mapInArrow(_extracted(pages.sparkSession.sparkContext.broadcast(model), pages.columns.index(html_col)), out.schema)
