"""Op 2: main text of web pages by minimum-cut labelling of blocks.

A page is cut into blocks of text at block-level tags. A linear classifier of
each block (its containers, the words in their class and id, length, links)
gives a cost for either label; these are capacities to the two terminals.
Neighbours in page order, more so with the same parent, are joined by
smoothness edges. The minimum cut, by maximum flow, separates content from
boilerplate. Nodes whose terminal capacity outweighs all their edges keep
their side in every minimum cut, so only the doubtful ones enter the flow.

Defined cases: null or empty html gives an empty text; broken or unclosed
markup is read as far as it goes (a lone ``<`` is text); pages of any length
are read whole, in time that follows their length; a block whose costs tie is
boilerplate; repeated rows are extracted alike; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from marlstone.llm._shared import table

# no "<" inside a tag but in quotes, and no way back: what is unclosed is read once
PLAIN = r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([A-Za-z][^\s/<>]*+)((?>[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
PLAIN, TOKEN = re.compile(PLAIN, re.S), re.compile(r"<!\[CDATA\[.*?\]\]>|" + PLAIN, re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body article main section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th"
    " blockquote pre figure figcaption address form fieldset legend details summary dialog menu center hr search hgroup".split()
)
LEAF = frozenset("p h1 h2 h3 h4 h5 h6".split())  # closed by any block that starts
SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
OUTSIDE = frozenset("nav aside form footer dialog menu head search button fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
BAD = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar rail ad ads advert adverts advertisement"
    " advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter"
    " subscribe subscription signup login signin comment comments respond reply replies disqus discussion share sharing social related recommended"
    " recommendations trending popular widget pagination pager toolbar copyright disclaimer skip".split()
)
GOOD = frozenset("article post entry story content main body text".split())
TITLES = frozenset("header title heading headline".split())
INSIDE, HARD = 6.0, 40.0
DEPTH = 512  # elements below that stand beside each other, as in browsers
NEXT, SIBLING = 0.8, 0.7


def words_of(value: str) -> list:
    return [w.lower() for w in WORD.findall(value)]


class Box:
    """An open element: its parent, and what it says about the text within."""

    __slots__ = ("tag", "parent", "bad", "inside", "link")

    def __init__(self, tag, parent, attributes):
        self.tag, self.parent = tag, parent
        self.bad = parent.bad if parent else False
        self.inside = parent.inside if parent else False
        if tag in ("html", "body"):
            return
        named = {}
        for m in ATTRIBUTE.finditer(attributes) if attributes.strip(" /") else ():
            named.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        names = [*named.get("class", "").split(), *([named["id"]] if named.get("id") else [])]
        role = named.get("role", "").lower()
        if tag in ("article", "main") or role in ("main", "article"):
            # a whole name has to say it: "has-comments" does not make an article a comment
            self.bad = self.bad or any(n.lower() in BAD for n in names)
            self.inside = True
            return
        self.bad = self.bad or tag in OUTSIDE or role in ROLES or (tag == "header" and not self.inside)
        for n in names:
            w = words_of(n)
            hit = BAD.intersection(w)
            if hit and not (hit <= TITLES and (self.inside or GOOD.intersection(w))):
                self.bad = True


class Block:
    __slots__ = ("text", "box", "score")

    def __init__(self, text, box, linked):
        self.text, self.box = text, box
        self.score = classify(text, box, linked)


def classify(text: str, box: Box, linked: int) -> float:
    """Above 0: the cost of calling it boilerplate; below: of calling it content."""
    if box.bad:
        return -HARD
    n, density = text.count(" ") + 1, linked / max(1, len(text))
    s = INSIDE if box.inside else 0.0
    s += 2.0 if n >= 12 else 0.8 if n >= 5 else -0.2
    s += 0.6 if text[-1] in ".!?…:;\"”»" else 0.0
    s += 0.8 if box.tag in LEAF or box.tag in ("blockquote", "pre") else 0.0
    s -= 0.6 if box.tag in ("li", "td", "th", "dt", "dd") else 0.0
    s -= 3.5 * density
    if not box.inside and n < 25 and ("©" in text or text.lower().startswith("copyright")):
        s -= 6.0
    return s


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    top = Box("", None, "")
    stack, text, linked, anchors = [top], [], 0, 0
    unclosed: set = set()

    def flush():
        nonlocal text, linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, stack[-1], linked))
        text, linked = [], 0

    def close(k):
        del stack[k:]

    at, size, sections = 0, len(page), page.rfind("]]>")
    while at < size:
        m = (TOKEN if at < sections else PLAIN).search(page, at)
        end = m.start() if m else size
        if end > at:
            text.append(page[at:end])
            if anchors:
                linked += end - at
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text.append(html.escape(m[0][9:-3]))
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not closing and not m[3].rstrip().endswith("/"):
                e = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^<>]*>", re.I).search(page, at)
                at = e.end() if e else (size if tag in ("script", "style") else at)
                if not e:
                    unclosed.add(tag)
            text.append(" ")
            continue
        if tag == "a":
            anchors = max(0, anchors + (-1 if closing else 1))
        if tag == "br":
            text.append(" ")
        if tag not in BLOCK and tag != "button":
            if tag not in VOID and not closing and ("class" in m[3] or "id" in m[3] or "role" in m[3]) and Box(tag, stack[-1], m[3]).bad and not stack[-1].bad:
                flush()  # an inline element that names itself an advert, notice, ...
                close(DEPTH)
                stack.append(Box(tag, stack[-1], m[3]))
            elif closing and stack[-1].tag == tag and len(stack) > 1:
                flush()
                close(len(stack) - 1)
            continue
        flush()
        anchors = 0
        if closing:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if k:
                close(k)
            continue
        while len(stack) > 1 and stack[-1].tag in LEAF:
            close(len(stack) - 1)
        if tag in SAME:  # <li> ends an open <li> of the same list
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SAME[tag]:
                    break
                if stack[k].tag == tag or (tag in ("td", "th") and stack[k].tag in ("td", "th")) or (tag in ("dt", "dd") and stack[k].tag in ("dt", "dd")):
                    close(k)
                    break
        elif tag == "body":
            stack[:] = [b for b in stack if b.tag != "head"]
            stack.append(Box(tag, top, m[3]))
            continue
        if tag not in VOID:
            if len(stack) > DEPTH:
                close(DEPTH)
            stack.append(Box(tag, stack[-1], m[3]))
    flush()
    return out


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut: s > 0 joins a node to the source, s < 0 to the sink."""
    around: list[dict] = [{} for _ in scores]
    for a, b, w in edges:
        around[a][b] = around[a].get(b, 0.0) + w
        around[b][a] = around[b].get(a, 0.0) + w
    s = list(scores)
    side: list = [None] * len(s)
    todo = deque(range(len(s)))
    while todo:  # what outweighs its edges is settled; its edges then pull at the neighbours
        v = todo.popleft()
        if side[v] is None and abs(s[v]) > sum(around[v].values()):
            side[v] = s[v] > 0
            for u, w in around[v].items():
                s[u] += w if side[v] else -w
                del around[u][v]
                todo.append(u)
            around[v] = {}
    rest = [v for v in range(len(s)) if side[v] is None]
    if rest:
        place = {v: k for k, v in enumerate(rest)}
        inner = [(place[v], place[u], w) for v in rest for u, w in around[v].items() if u > v]
        for v, ok in zip(rest, max_flow([s[v] for v in rest], inner)):
            side[v] = ok
    return side


def max_flow(s: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The nodes that the source still reaches when the flow is at its maximum, by levels and blocking flows."""
    n = len(s)
    to, room, out = [], [], [[] for _ in range(n + 2)]
    source, sink = n, n + 1

    def arc(a, b, w, back):
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((w, back))

    for v, x in enumerate(s):
        if x > 0:
            arc(source, v, x, 0.0)
        elif x < 0:
            arc(v, sink, -x, 0.0)
    for a, b, w in edges:
        arc(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in out[v]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        at, path, v = [0] * (n + 2), [], source
        while True:
            if v == sink:
                flow = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                v = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[v] < len(out[v]):
                e = out[v][at[v]]
                if room[e] > 1e-9 and level[to[e]] == level[v] + 1:
                    break
                at[v] += 1
            else:
                if v == source:
                    break
                v = to[path.pop() ^ 1]
                at[v] += 1
                continue
            path.append(e)
            v = to[e]


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    edges = []
    last: dict = {}
    for k, b in enumerate(blocks):
        if k:
            edges.append((k - 1, k, NEXT))
        parent = id(b.box.parent)
        if parent in last:
            edges.append((last[parent], k, SIBLING))
        last[parent] = k
    keep = min_cut([b.score for b in blocks], edges)
    return "\n\n".join(b.text for b, ok in zip(blocks, keep) if ok)


def _extract(batches):
    for b in batches:
        for k in range(0, b.num_rows, 500):
            part = b.slice(k, 500)
            texts = [main_text(x.as_py()) for x in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of ``pages`` (page_id, url, html)."""
    p = pages.selectExpr("page_id", "url", "CAST(html AS STRING) AS html")
    return p.mapInArrow(_extract, f"page_id {p.schema['page_id'].dataType.simpleString()}, url {p.schema['url'].dataType.simpleString()}, text string, n_chars long")


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
