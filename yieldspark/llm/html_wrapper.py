"""Operator 5, HTML extraction: union-free wrappers, inferred by aligning the pages of a host.

A page is a token stream of block tags and text, read as a nested list. A host's wrapper is what its pages
have in common: two streams are aligned level by level (longest common subsequence of tags); what only one
of them has becomes an optional group, neighbours that repeat (of one tag, or a run of up to four) fold into
a repeated group, and text that differs becomes a slot, text that never does stays a constant. Alignment is
associative enough to run per batch first and then over the batches' wrappers, so a host with a third of
all pages is no single task. Extraction keeps the slots of the main region, which an element's name or the
wrapper's mass gives, and drops its constants; texts of a repeated group are slots unless all are alike.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldspark.llm._spark import staged, table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
RAW = frozenset("script style noscript template iframe svg textarea select button datalist object canvas audio video head title".split())
RAW_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in RAW}
BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address hr header footer nav aside form fieldset details summary center dialog menu".split())
VOID = frozenset(["hr"])
#: Elements deeper than this give their text to the element at this depth, in page order; furniture stays furniture.
DEPTH = 100
#: Elements whose text belongs to what is around them, and those that head a section or a list.
TEXTUAL = frozenset("p li dt dd td th tr caption figcaption summary address pre blockquote center h1 h2 h3 h4 h5 h6".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6 dt th caption figcaption summary".split())
#: Wrappers of a host's batches are merged in so many groups first.
GROUPS = 64
#: An element whose start ends open elements of these names up to the nearest of its bounds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
FURNITURE = frozenset("nav footer aside form fieldset dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = re.compile(
    r"^(ads?|adverts?|advertis\w+|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|aside|widgets?|footer\w*|header\w*|masthead|topbar|cookies?|consent|gdpr|notices?|alert\w*|newsletter|subscribe|subscription|signup|login|popup|modal|overlay|"
    r"share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|respond|replies|reply|discussion|disclaimer|paywall|search\w*|pagination|pager|toolbar|skip)$"
)
#: A name that starts so says what an element has, not what it is.
MODIFIERS = frozenset("has no non not with without is hide show".split())
#: Of NAMES, those that also head content (related-work, search-engines): furniture alone or beside NAMES and holders only.
DOUBTFUL = re.compile(r"^(related|recommend\w*|search\w*|discussion|notices?|alert\w*|header\w*|social|sharing|share|skip|reply|replies|respond|consent)$")
HOLDER = re.compile(r"^(\d*|posts?|articles?|stories|items?|links?|lists?|news|media|products?|topics?|videos?|threads?|box|bar|forms?|results?|field|input|buttons?|icons?|blocks?|sections?|containers?|content|wrap|wrapper|inner|outer|area|row|col|main|site|page|top|bottom|left|right|to|js|title|text|message)$")
#: Element furniture by name is kept after all where a page has no named main region and all else is under this share of it.
REST = 0.1
SURE = 2
MAIN = re.compile(r"^(article|story|entry|post|articlebody|storybody|postbody|maincontent)$")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: A constant of this many different pages is template text; on a host of fewer, one of all its pages (two at least).
TEMPLATE_PAGES = 5
#: Extraction plans of all hosts up to this size are broadcast; more are joined by host.
BROADCAST_CHARS = 16 << 20
WRAPPER = "host string, wrapper string"

# A node is [tag, pages, repeated, characters, constant or None, children, common, seen]; text is a node of tag
# "#", a folded run of siblings one of tag "+". common: the hash of a constant's path and whole text, if it
# is one; seen: the least hashes of the different pages that have it, up to TEMPLATE_PAGES.


def _furniture(word: str, inside: bool) -> bool:
    """Whether a class or id word names furniture; inside a main region a header is the article's own."""
    parts = re.split(r"[-_]+", word)
    named = [x for x in parts if NAMES.match(x)]
    if not named or parts[0] in MODIFIERS or "discussion" in parts and set(parts) <= {"discussion", "results", "section", "text", "content"}:
        return False
    if inside and all(x.startswith("header") for x in named):
        return False
    return any(not DOUBTFUL.match(x) for x in named) or all(NAMES.match(x) or HOLDER.match(x) for x in parts)


def _marks(attrs: str, inside: bool) -> tuple[str, int, bool]:
    """Class and id words that name a role, whether the element is page furniture (1 by name, SURE otherwise), and whether it is a main region."""
    names, off, main = [], 0, False
    for key, value in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "itemprop"):
            for word in value.split():
                off = max(off, int(_furniture(word, inside)))
                main |= bool(MAIN.match(word.replace("-", "").replace("_", "")))
                names.append(re.sub(r"\d+", "0", word))
        elif key == "role":
            off = SURE if value in ROLES else off
            main |= value in ("main", "article")
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            off = SURE
    return ".".join(sorted(set(names))), off, main


class Page:
    """Block tree of one page. Elements are lists [tag, off, main, children]; text children are strings."""

    __slots__ = ("root",)

    def __init__(self, source: str) -> None:
        self.root = ["", False, False, []]
        # an open element's node, or below DEPTH the node that takes its text
        stack, names, inner = [self.root], [""], [False]
        text: list[str] = []
        at = 0

        def flush() -> None:
            if text:
                words = "".join(text).split()
                text.clear()
                if words:
                    stack[-1][3].append(" ".join(words))

        def close(k: int) -> None:
            del stack[k:], names[k:], inner[k:]

        while True:
            m = TOKEN.search(source, at)
            if m is None:
                break
            if m.start() > at:
                text.append(entities.unescape(source[at : m.start()]))
            at = m.end()
            end, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if name in RAW:
                if not end and not attrs.endswith("/"):
                    stop = RAW_END[name].search(source, at)
                    at = stop.end() if stop else at if name in ("head", "title", "object", "noscript", "svg", "button", "select", "audio", "video") else len(source)
                continue
            if name == "br":
                text.append(" ")
            if name not in BLOCK:
                continue
            flush()
            if end:
                for k in range(len(names) - 1, 0, -1):
                    if names[k] == name:
                        close(k)
                        break
                continue
            kinds, bounds = CLOSES.get(name, ((), ()))
            for k in range(len(names) - 1, 0, -1):
                if names[k] in bounds:
                    break
                if names[k] == "p" or names[k] in kinds:
                    close(k)
                elif names[k] not in ("p", *kinds) and not kinds:
                    break
            inside = inner[-1]
            key, off, main = _marks(attrs, inside) if attrs.strip() else ("", 0, False)
            if name in FURNITURE or (name == "header" and not inside):
                off = SURE
            if name[0] == "h" and name[1:].isdigit() or name in ("html", "body"):
                off = SURE if off and not key.strip() or "hidden" in attrs else 0
            node = [f"{name}.{key}" if key else name, off, main or name in ("article", "main"), []]
            if len(stack) > DEPTH and not (off and not stack[-1][1]):
                node = stack[-1]
            else:
                stack[-1][3].append(node)
            if name not in VOID:
                stack.append(node)
                names.append(name)
                inner.append(inside or node[2])
        text.append(entities.unescape(source[at:]))
        flush()
        self._settle()

    def _settle(self) -> None:
        """Names only vote: without a named main region elsewhere, what holds one, or nearly all text, is no furniture."""
        while True:
            rest, main, named = 0, False, []
            open_ = [(self.root, False)]
            while open_:
                node, inside = open_.pop()
                inside = inside or node[2]
                for c in node[3]:
                    if isinstance(c, str):
                        rest, main = rest + len(c), main or inside
                    elif c[1] == 1:
                        named.append(c)
                    elif not c[1]:
                        open_.append((c, inside))
            if main or not named:
                return
            sizes = [_held(c) for c in named]
            best = max(range(len(named)), key=lambda k: (sizes[k][1] > 0, sizes[k][0]))
            if not sizes[best][1] and sizes[best][0] * REST <= rest or not sizes[best][0]:
                return
            named[best][1] = 0


def _held(top: list) -> tuple[int, int]:
    """Characters below an element that are no sure furniture, and those of them in main regions."""
    size = region = 0
    open_ = [(top, False)]
    while open_:
        node, inside = open_.pop()
        inside = inside or node[2]
        for c in node[3]:
            if isinstance(c, str):
                size, region = size + len(c), region + len(c) * inside
            elif c[1] != SURE:
                open_.append((c, inside))
    return size, region


def _fold(nodes: list[list]) -> list[list]:
    """Neighbouring siblings that repeat, as one repeated node (runs of 2 to 4 as a "+" group)."""
    out: list[list] = []
    for n in nodes:
        if out and out[-1][0] == n[0]:
            out[-1] = _align(out[-1], n, out[-1][1], True)
            out[-1][2] = True
        else:
            out.append(n)
    for size in (2, 3, 4):
        k, folded = 0, []
        while k < len(out):
            run = out[k : k + size]
            tags, reps = [n[0] for n in run], 1
            while len(run) == size and [n[0] for n in out[k + reps * size : k + (reps + 1) * size]] == tags:
                run = [_align(a, b, a[1], True) for a, b in zip(run, out[k + reps * size : k + (reps + 1) * size], strict=True)]
                reps += 1
            if reps > 1:
                folded.append(["+", run[0][1], True, 0, None, run, [], []])
                k += reps * size
            else:
                folded.append(out[k])
                k += 1
        out = folded
    return out


def _tag(n: list) -> str:
    return "+" + " ".join(x[0] for x in n[5]) if n[0] == "+" else n[0]


def _align(a: list, b: list, pages: int, within: bool = False) -> list:
    """One node that generalises both; within: siblings of one page, not positions of two."""
    constant, common = (a[4], a[6]) if a[6] == b[6] else (None, [])
    seen = sorted({*a[7], *b[7]})[:TEMPLATE_PAGES] if common or a[0] == "" else []
    return [a[0], pages, a[2] or b[2], a[3] + b[3], constant, _aligned(a[5], b[5], within), common, seen]


def _aligned(xs: list[list], ys: list[list], within: bool = False) -> list[list]:
    """Siblings of two streams: common ones merge, the others stay, seen in fewer pages, so optional."""
    kx, ky = [_tag(n) for n in xs], [_tag(n) for n in ys]
    if kx == ky:
        return [_align(a, b, a[1] if within else a[1] + b[1], within) for a, b in zip(xs, ys, strict=True)]
    out, i, j = [], 0, 0
    for x, y in [*common_places(kx, ky), (len(kx), len(ky))]:
        out += xs[i:x] + ys[j:y]
        if x < len(kx):
            out.append(_align(xs[x], ys[y], xs[x][1] if within else xs[x][1] + ys[y][1], within))
        i, j = x + 1, y + 1
    return out


def _lengths(xs: list[str], ys: list[str]) -> list[int]:
    """Length of a longest common subsequence of xs and each prefix of ys, by a bit vector of ys' places."""
    places: dict[str, int] = {}
    for j, y in enumerate(ys):
        places[y] = places.get(y, 0) | 1 << j
    whole = v = (1 << len(ys)) - 1
    for x in xs:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & whole
    out = [0]
    for bit in reversed(f"{v:0{len(ys)}b}"):
        out.append(out[-1] + (bit == "0"))
    return out


def common_places(kx: list[str], ky: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in memory that grows with the lists and not with their product:
    one list is halved, the other cut where the two halves have most in common."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(kx), 0, len(ky))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and kx[a] == ky[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and kx[b - 1] == ky[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        if b - a == 1:
            if kx[a] in ky[c:d]:
                out.append((a, ky.index(kx[a], c, d)))
            continue
        half = (a + b) // 2
        first, last = _lengths(kx[a:half], ky[c:d]), _lengths(kx[half:b][::-1], ky[c:d][::-1])
        cut = c + max(range(d - c + 1), key=lambda k: first[k] + last[d - c - k])
        todo += [(a, half, c, cut), (half, b, cut, d)]
    return sorted(out)


def _hash(*parts: str) -> str:
    return hashlib.blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).hexdigest()


def _label(node: list) -> str:
    return ("-" if node[1] else "*" if node[2] else "") + node[0]


def _texts(node: list) -> Iterator[str]:
    for c in node[3]:
        if isinstance(c, str):
            yield c
        elif not c[1]:
            yield from _texts(c)


def stream(node: list, path: str = "", page: str | None = None) -> list:
    """A parsed element as a wrapper of one page; furniture keeps its tag only. Copies of a page count as one."""
    page = _hash(*_texts(node)) if page is None else page
    path += "/" + _label(node)
    children = [] if node[1] else [["#", 1, False, len(c), c[:200], [], [_hash(path, c)], [page]] if isinstance(c, str) else stream(c, path, page) for c in node[3]]
    return [_label(node), 1, False, 0, None, _fold(children), [], [] if node[0] else [page]]


def merge(wrappers: list[list]) -> list:
    out = wrappers[0]
    for w in wrappers[1:]:
        out = _align(out, w, out[1] + w[1])
    return out


def pattern(node: list, pages: int | None = None) -> str:
    """The wrapper as a union-free regular expression over tags, constants and #TEXT slots."""
    inner = "".join(pattern(c, node[1]) for c in node[5])
    body = (node[4] or "#TEXT") if node[0] == "#" else inner if node[0] in ("", "+") else f"<{node[0]}>{inner}</{node[0]}>"
    body = f"({body})+" if node[2] else body
    return f"({body})?" if pages is not None and node[1] < pages else body


def _mass(node: list) -> int:
    return node[3] + sum(map(_mass, node[5]))


def _has_main(node: list) -> bool:
    return node[0].startswith("*") and _mass(node) > 0 or any(_has_main(c) for c in node[5] if not c[0].startswith("-"))


def plan(wrapper: list) -> dict:
    """What extraction needs: the path of the main region (None where an element names it), and the hashes of
    template constants: what all pages with a position share there. In a main region only those of an element
    that holds nothing else are dropped, a notice or a share box, and headings never: a section's heading or a
    line between paragraphs is the article's own, however many pages have it. Elsewhere all constants go."""
    main: list[str] | None = None
    region = None
    if not _has_main(wrapper):
        main, region = [], wrapper
        while True:
            below = [c for c in _flat(region) if not c[0].startswith("-") and c[0] != "#" and not c[2]]
            heavy = max(below, key=_mass, default=None)
            if heavy is None or _mass(heavy) < 0.6 * _mass(region):
                break
            main.append(heavy[0])
            region = heavy
    constants: set[str] = set()
    least = max(2, len(wrapper[7]))
    fixed = lambda node: all(len(c[7]) >= least if c[0] == "#" else fixed(c) for c in _flat(node) if not c[0].startswith("-"))

    def walk(node: list, inside: bool, box: bool) -> None:
        """inside: in a main region; box: the element that holds this one has constants only."""
        name = node[0].lstrip("*").split(".")[0]
        alone = fixed(node) if name not in TEXTUAL else box
        for c in _flat(node):
            if c[0] == "#":
                if len(c[7]) >= least and not (inside and (name in HEADING or not alone)):
                    constants.update(c[6])
            elif not c[0].startswith("-"):
                starts = c is region or c[0].startswith("*")
                walk(c, inside or starts, alone and not starts)

    if region is not None and region[0].split(".")[0] in ("", "html", "body"):
        region = None  # no element stands out: constants may be of any part of the page
    walk(wrapper, False, False)
    return {"main": main, "constants": sorted(constants)}


def _flat(node: list) -> Iterator[list]:
    for c in node[5]:
        if c[0] == "+":
            yield from _flat(c)
        else:
            yield c


def main_text(page: Page, todo: dict) -> str:
    """The blocks of the page's main region that are slots of the wrapper, one a line. A named region that has
    constants only gives those."""
    path, constants = todo["main"], set(todo["constants"])
    blocks: list[str] = []

    def take(node: list, at: str, free: bool = False) -> None:
        for c in node[3]:
            if isinstance(c, str):
                if free or not constants or _hash(at, c) not in constants:
                    blocks.append(c)
            elif not c[1]:
                take(c, f"{at}/{_label(c)}", free)

    def regions(node: list, at: str) -> Iterator[tuple[list, str]]:
        for c in node[3]:
            if not isinstance(c, str) and not c[1]:
                below = f"{at}/{_label(c)}"
                if c[2]:
                    yield c, below
                else:
                    yield from regions(c, below)

    root = "/" + _label(page.root)
    if path is None:
        own: list[tuple[list, str]] = []
        for r, at in regions(page.root, root):
            own += (r[0].startswith("main") and list(regions(r, at))) or [(r, at)]
        for free in (False, True):
            for r, at in own if not blocks else ():
                take(r, at, free)
    else:
        node, at = page.root, root
        for key in path:
            down = next((c for c in node[3] if not isinstance(c, str) and not c[1] and _label(c) == key), None)
            if down is None:
                break
            node, at = down, f"{at}/{_label(down)}"
        take(node, at)
    if not blocks:
        take(page.root, root)
    return "\n".join(blocks)


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, wrapper (JSON) of every host, from all of its pages."""

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts: dict[str, list] = {}
            for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                own = stream(Page(source).root)
                hosts[host] = _align(hosts[host], own, hosts[host][1] + 1) if host in hosts else own
            yield pa.RecordBatch.from_arrays([pa.array(list(hosts), pa.string()), pa.array([json.dumps(w) for w in hosts.values()], pa.string())], ["host", "wrapper"])

    def of_host(rows: pa.Table) -> pa.Table:
        return pa.table({"host": rows["host"].slice(0, 1), "wrapper": [json.dumps(merge([json.loads(w) for w in sorted(rows["wrapper"].to_pylist())]))]})

    batches = pages.select(*_host_and_html(url_col, html_col)).mapInArrow(of_batch, WRAPPER)
    grouped = batches.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(GROUPS)).alias("part")).applyInArrow(of_host, WRAPPER)
    return grouped.groupBy("host").applyInArrow(of_host, WRAPPER)


def _host_and_html(url_col: str, html_col: str) -> tuple[Column, Column]:
    host = F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.lower(host).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (main text, "" if none) of every page, under its host's wrapper.

    Null html is empty; a null or hostless url falls under the host ""; broken and cut markup is read as far
    as it goes, very long and very deep markup to its end; repeated rows give repeated rows; other columns
    are ignored; an empty table gives none.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), *(_host_and_html(url_col, html_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            todo = {p: json.loads(p) for p in b.column("plan").unique().to_pylist()}
            out = [main_text(Page(source), todo[p]) for p, source in zip(b.column("plan").to_pylist(), b.column("html").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            todo = [json.dumps(plan(json.loads(w))) for w in b.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(todo, pa.string())], ["host", "plan"])

    plans = staged(infer_wrappers(pages, url_col, html_col).mapInArrow(planned, "host string, plan string"), "plans")
    small = (plans.agg(F.sum(F.length("plan") + F.length("host"))).first()[0] or 0) <= BROADCAST_CHARS
    joined = rows.join(F.broadcast(plans) if small else plans, "host")
    return joined.select("page_id", "url", "plan", "html").mapInArrow(run, "page_id long, url string, text string")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
