"""HTML extraction by wrapper induction.

Pages of one host are aligned as DOM trees by simple tree matching (the largest matching that keeps order and ancestors). Nodes whose
text is the same on all aligned pages become template; nodes whose text varies are slots. A content slot is a container (div, section,
article and the like) whose own text, outside links and inner containers, varies, or that some of the pages lack. A wrapper is the
paths of all content slots, outermost ones, and the text of the template nodes. Pages of a host are counted by layout, the set of
paths of their containers; each layout of three pages or more has a wrapper, rarer ones (and those whose pages are not three
different ones) share one of the host. Each is induced from at most PAGES whole pages, chosen by a hash of page_id; pages with the same main text count once, and slots and template need three different ones.

Extraction takes all nodes at the slots' paths, in page order; of several, those with at least half of their text in links only if
all are so. Where no three pages could be aligned, or a page has no text at the slots, it takes the longest <article>, else <main>,
of the page, else the node at the path of the slot with most text outside links (two pages suffice for that), else the body. It leaves out what navigates, frames, asks, sells or comments, by tag, role or class, and the host's template nodes; decodes character references;
joins the text of each block with single spaces and the blocks with line breaks. Nothing else is dropped and nothing is capped.

Nulls and odd rows: a null or empty html has an empty text; a null or odd url has a host of its own, the empty one; a null
page_id is kept; repeated rows give repeated rows; markup that is cut off or not closed is read as browsers read it, nearly; plain text is
its own main text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

PAGES, MOST_CELLS, TEMPLATE_PAGES = 8, 1 << 20, 3

#: Fixed values of HTML: elements without content, with raw text, that begin a block, that a new one ends.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "xmp", "noembed", "noframes"}
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "menu", "dl", "table", "article", "section", "div", "main", "body", "aside", "nav", "footer", "header", "form"}
#: Elements that divide a page; what they hold is its text.
CONTAINERS = {"html", "body", "div", "section", "article", "main", "center", "aside", "nav", "header", "footer", "form"}
#: What a page has besides its main text, by tag, role and the words of class and id.
SIDE_TAGS = {"nav", "header", "footer", "aside", "form", "button", "select", "input", "dialog", "menu", "head", "script", "style", "noscript", "template", "textarea", "iframe", "svg", "object", "canvas", "audio", "video", "fieldset", "title", "label"}
SIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "menu", "menubar", "toolbar"}
SIDE_WORDS = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead comment comments comentarios kommentare commentaires disqus reply replies cookie cookies consent notice notices gdpr popup modal newsletter subscribe subscription share sharing social related recommended widget toolbar pagination pager login signup search form".split())

#: What begins with "<": a comment, CDATA, a declaration, or the name of a tag; and what follows the name. Neither ever goes back.
_MARK = re.compile(r"<(?:(!--(?:(?!-->)[\s\S])*+(?:-->)?+|!\[CDATA\[(?:(?!\]\]>)[\s\S])*+(?:\]\]>)?+|[!?][^>]*+>?+)|(/?+)([a-zA-Z][^\s/>]*+))")
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+""")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.IGNORECASE)
_NAMES = re.compile(r"[a-z]+")


#: Digests of paths, by that of the parent and the node's key. Bounded; what is let go is made again.
_PATHS: dict[tuple[int, str], int] = {}


def path_of(up: int, key: str) -> int:
    """A digest of a node's path, alike in all processes; as paths of deep pages would be long."""
    out = _PATHS.get((up, key))
    if out is None:
        if len(_PATHS) > 100_000:
            _PATHS.clear()
        out = _PATHS[up, key] = xxhash.xxh64_intdigest(f"{up:x}>{key}".encode("utf-8", "surrogatepass"))
    return out


class Node:
    """side: it, hidden: it or a node above it, is beside the main text. measure() sets what stands below."""

    __slots__ = ("tag", "key", "path", "depth", "side", "hidden", "children", "up", "mark", "texts", "size", "links", "free")

    def __init__(self, tag: str, attributes: str, up: Node | None):
        self.tag, self.up, self.children = tag, up, []
        self.key, self.side = tag, tag in SIDE_TAGS
        if attributes and "=" in attributes or "hidden" in attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower()
                if name == "role":
                    self.side |= value in SIDE_ROLES
                elif name == "hidden":
                    self.side |= value != "until-found" and not m[1] == ""
                else:
                    self.key += ("." if name == "class" else "#") + value if name == "class" or not any(c.isdigit() for c in value) else ""
                    if tag not in ("body", "html", "article", "main"):
                        # A class speaks for its element; of compounds (site-nav, adBox) each part does.
                        parts = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[2] or m[3] or m[4] or "").lower()
                        self.side |= any(w in SIDE_WORDS for w in _NAMES.findall(parts))
        self.path, self.depth = path_of(up.path if up else 0, self.key), up.depth + 1 if up else 1
        self.hidden = self.side or (up.hidden if up else False)


def parse(page: str) -> Node:
    """The DOM tree of a page, with implied ends; children are nodes and texts. One pass, in time in proportion to the page."""
    root = Node("html", "", None)
    node, at, open_ = root, 0, Counter()

    def leave(to: Node) -> Node:
        """Ends all elements under to."""
        x = node
        while x is not to:
            open_[x.tag] -= 1
            x = x.up
        return to

    while at < len(page):
        m = _MARK.search(page, at)
        if not m:
            node.children.append(page[at:])
            break
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        if m[1]:
            continue
        tag = m[3].lower()
        end = _REST.match(page, at).end()
        if end < len(page) and page[end] == "=":  # a quote that is never closed: the tag ends at the next bracket
            end = page.find(">", end)
        if end < 0 or end >= len(page):
            break  # a tag that is cut off
        attributes, at = page[at:end], end + 1
        if m[2]:
            if open_[tag]:
                x = node
                while x.tag != tag:
                    x = x.up
                node = leave(x.up)
            continue
        if tag in ("html", "head", "body"):
            if tag == "body" and node.tag == "head":
                node = leave(node.up)
            if tag == "html":
                continue
        ended = ENDS.get(tag, ())
        if tag in ENDS_P and open_["p"] or any(open_[t] for t in ended):
            x = node
            while x.up is not None and x.tag not in SCOPES:
                if x.tag == "p" and tag in ENDS_P or x.tag in ended:
                    node = leave(x.up)
                    if x.tag != "td" and x.tag != "th":
                        break
                x = x.up
        new = Node(tag, attributes, node)
        node.children.append(new)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+(?:>|\Z)", re.IGNORECASE).search(page, at)
            new.children.append(page[at : close.start()] if close else page[at:])
            at = close.end() if close else len(page)
        elif tag not in VOID and not attributes.endswith("/"):
            node = new
            open_[tag] += 1
    return root


def text_blocks(node: Node, template: set[str], out: list[list[str]]) -> None:
    """Adds the texts of each block under node, those of side nodes and of template nodes left out."""
    stack: list = [*reversed(node.children)]
    while stack:
        child = stack.pop()
        if child is None:  # a block ends here
            out.append([])
        elif isinstance(child, str):
            out[-1].append(child)
        elif child.side or (template and signed(child) in template):
            out[-1].append(" ") if child.tag not in BLOCK else out.append([])
        elif child.tag in ("br", "wbr"):
            out[-1].append(" " if child.tag == "br" else "")
        else:
            if child.tag in BLOCK:
                out.append([])
                stack.append(None)
            stack.extend(reversed(child.children))


def squeezed(text: str) -> str:
    return " ".join(entities.unescape(text).split())


_PRIME, _STEP = (1 << 61) - 1, 0x1F3D5B79


def measure(root: Node) -> Node:
    """Sets for each node: texts, mark (number and digest of its texts in order), size, links (characters, and those in links),
    free (characters outside links and side nodes). Texts that are not shown count for nothing."""
    for n in reversed(nodes(root)):
        n.mark, n.texts, n.size, n.links, n.free = 0, 0, 0, 0, 0
        for c in n.children if n.tag not in RAW else ():
            if isinstance(c, str):
                t = squeezed(c)
                if t:
                    n.mark = (n.mark * _STEP + xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"))) % _PRIME
                    n.texts += 1
                    n.size += len(t) + 1
                    n.free += len(t) + 1
            else:
                n.mark = (n.mark * pow(_STEP, c.texts, _PRIME) + c.mark) % _PRIME
                n.texts += c.texts
                n.size += c.size
                n.links += c.size if c.tag == "a" else c.links
                n.free += 0 if c.tag == "a" or c.side else c.free
    return root


def signed(node: Node) -> str:
    """A measured node's place and text, as templates hold them."""
    return f"{node.path:x}|{node.texts}|{node.mark:x}"


def nodes(root: Node) -> list[Node]:
    """All nodes in page order."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(c for c in reversed(x.children) if isinstance(c, Node))
    return out


def shapes(root: Node, known: dict[tuple, int], sizes: dict[int, int]) -> dict[int, int]:
    """The number of each node's tree of keys, alike for like trees, and in sizes how many nodes that tree has."""
    out: dict[int, int] = {}
    for n in reversed(nodes(root)):
        own = [out[id(c)] for c in n.children if isinstance(c, Node)]
        k = out[id(n)] = known.setdefault((n.key, *own), len(known))
        sizes[k] = 1 + sum(sizes[x] for x in own)
    return out


def align(xs: list, ys: list, weight) -> list[tuple]:
    """Pairs of the heaviest matching of two lists that keeps order; memory is bounded by halving long ones (Hirschberg)."""
    if not xs or not ys:
        return []

    def rows(xs: list, ys: list) -> Iterator[np.ndarray]:
        last = np.zeros(len(ys) + 1, np.int64)
        yield last
        known: dict = {}
        for x in xs:
            w = known.get(x)
            if w is None:
                per = {y: weight(x, y) for y in set(ys)}
                w = known[x] = np.array([per[y] for y in ys], np.int64)
            new = last.copy()
            np.maximum(new[1:], last[:-1] + w, out=new[1:])
            last = np.maximum.accumulate(new)
            yield last

    if len(xs) > 1 and len(xs) * len(ys) > MOST_CELLS:
        half = len(xs) // 2
        for head in rows([x for _, x in xs[:half]], [y for _, y in ys]):
            pass
        for tail in rows([x for _, x in xs[half:]][::-1], [y for _, y in ys][::-1]):
            pass
        cut = int((head + tail[::-1]).argmax())
        return align(xs[:half], ys[:cut], weight) + align(xs[half:], ys[cut:], weight)
    table = list(rows([x for _, x in xs], [y for _, y in ys]))
    pairs, i, j = [], len(xs), len(ys)
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((xs[i][0], ys[j][0]))
    return pairs[::-1]


def match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching of whole trees: the size of the largest matching of two trees with like roots, and its pairs.

    Subtrees of one shape match whole, at either end of two lists of children at once; others are met once a pair of shapes.
    """
    if a.key != b.key:
        return 0, []
    known: dict[tuple, int] = {}
    sizes: dict[int, int] = {}
    left, right = shapes(a, known, sizes), shapes(b, known, sizes)
    parts = {k: shape for shape, k in known.items()}
    weights: dict[tuple[int, int], int] = {}

    def ends(xs: list, ys: list) -> tuple[int, int]:
        head = tail = 0
        least = min(len(xs), len(ys))
        while head < least and xs[head] == ys[head]:
            head += 1
        while tail < least - head and xs[-1 - tail] == ys[-1 - tail]:
            tail += 1
        return head, tail

    def fill(x: int, y: int) -> None:
        """Weights of a pair of shapes and of all pairs under it, without recursion, as pages may nest deep."""
        stack = [(x, y, False)]
        while stack:
            x, y, ready = stack.pop()
            if (x, y) in weights:
                continue
            if x == y or parts[x][0] != parts[y][0]:
                weights[x, y] = sizes[x] if x == y else 0
                continue
            xs, ys = parts[x][1:], parts[y][1:]
            head, tail = ends(xs, ys)
            inner, other = xs[head : len(xs) - tail], ys[head : len(ys) - tail]
            if not ready:
                stack.append((x, y, True))
                stack += [(p, q, False) for p in set(inner) for q in set(other) if (p, q) not in weights]
                continue
            size = 1 + sum(sizes[p] for p in (*xs[:head], *xs[len(xs) - tail :]))
            weights[x, y] = size + sum(weights[p, q] for p, q in align([(p, p) for p in inner], [(q, q) for q in other], lambda p, q: weights[p, q]))

    fill(left[id(a)], right[id(b)])
    pairs, stack = [], [(a, b)]
    while stack:
        x, y = stack.pop()
        pairs.append((x, y))
        xs, ys = ([c for c in n.children if isinstance(c, Node)] for n in (x, y))
        p, q = [left[id(c)] for c in xs], [right[id(c)] for c in ys]
        head, tail = ends(p, q)
        stack += zip(xs[:head], ys[:head], strict=True)
        stack += zip(xs[len(xs) - tail :], ys[len(ys) - tail :], strict=True)
        inner = align([(c, left[id(c)]) for c in xs[head : len(xs) - tail]], [(c, right[id(c)]) for c in ys[head : len(ys) - tail]], lambda p, q: weights[p, q])
        stack += inner
    return weights[left[id(a)], right[id(b)]], pairs


def content(root: Node, slots: list[int]) -> list[Node]:
    """The outermost nodes of a measured tree at the slots that have text, in page order; lists of links only if there is nothing else."""
    wanted, found, stack = set(slots), [], [root]
    while stack:
        x = stack.pop()
        if x.side:
            continue
        if x.path in wanted and x.size:
            found.append(x)
        else:
            stack.extend(c for c in reversed(x.children) if isinstance(c, Node))
    return [x for x in found if 2 * x.links < x.size] or found


def own_text(node: Node) -> str:
    """A container's text outside links, side nodes and inner containers."""
    parts, stack = [], [*reversed(node.children)]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif not (x.side or x.tag in CONTAINERS or x.tag == "a" or x.tag in RAW):
            stack.extend(reversed(x.children))
    return squeezed(" ".join(parts))


def main_node(root: Node, slot: int | None) -> Node:
    """The main text's node of a measured tree where no slots are known."""
    all_ = nodes(root)
    # Elements that hold another of their kind hold comments or teasers of it: the first outermost one with most text.
    for tag in ("article", "main"):
        found = [n for n in all_ if n.tag == tag and not n.hidden]
        if found:
            return max(found, key=lambda n: n.size)
    for n in all_ if slot else ():
        if n.path == slot and not n.hidden:
            return n
    return next((n for n in all_ if n.tag == "body"), root)


def extract(page: str | None, wrapper: dict | None = None) -> str:
    if not page:
        return ""
    root, wrapper = measure(parse(page)), wrapper or {}
    template = set(wrapper.get("template", ()))
    out: list[list[str]] = [[]]
    for node in content(root, wrapper.get("slots", [])) or [main_node(root, wrapper.get("slot"))]:
        out.append([])
        text_blocks(node, template, out)
        out.append([])
    return "\n".join(t for b in out if (t := squeezed("".join(b))))


def induce(pages: list[str]) -> dict:
    """The wrapper of pages of one host."""
    trees, seen = [], set()
    for page in sorted(set(pages)):
        text = extract(page)
        if text not in seen:
            seen.add(text)
            trees.append(measure(parse(page)))
    if len(trees) < 2:
        return {}
    base = trees[0]
    containers = [[n for n in nodes(t) if n.tag in CONTAINERS and not n.hidden] for t in trees]
    varied: dict[int, set[tuple]] = {}
    own: dict[int, set[str]] = {}
    met = {id(n): 0 for n in containers[0]}
    slots = set()
    for other, theirs in zip(trees[1:], containers[1:], strict=True):
        pairs = match(base, other)[1]
        for a, b in pairs:
            varied.setdefault(id(a), {(a.texts, a.mark)}).add((b.texts, b.mark))
            if id(a) in met:
                own.setdefault(id(a), {own_text(a)}).add(own_text(b))
                met[id(a)] += 1
        matched = {id(b) for _, b in pairs}
        slots |= {n.path for n in theirs if id(n) not in matched and own_text(n)}
    for n in containers[0]:
        if len(own.get(id(n), ())) > 1 or (met[id(n)] < len(trees) - 1 and own_text(n)):
            slots.add(n.path)
    aligned = nodes(base)
    counts = {k: len(v) for k, v in varied.items()}
    found = [(n.free / (1 + 0.1 * n.depth), n.path) for n in aligned if counts.get(id(n), 0) > 1 and not n.hidden and n.tag in BLOCK - {"html", "body", "p", "li"}]
    out = {"slot": max(found)[1]} if found else {}
    if len(trees) >= TEMPLATE_PAGES:
        out["slots"] = sorted(slots)
        held = [{signed(n) for x in content(t, out["slots"]) for n in nodes(x)[1:]} for t in trees]
        kept, stack = [], content(base, out["slots"])
        while stack:
            for c in stack.pop().children:
                if isinstance(c, Node):
                    if counts.get(id(c)) == 1 and c.texts and all(signed(c) in h for h in held):
                        kept.append(signed(c))
                    else:
                        stack.append(c)
        out["template"] = kept
    return out


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def layout(page: str | None) -> str:
    """A digest of the paths of a page's containers, alike for pages that differ only in text, paragraphs, lists and tables."""
    found = sorted({n.path for n in nodes(parse(page or "")) if n.tag in CONTAINERS})
    return hashlib.md5(np.array(found, "<u8").tobytes()).hexdigest()


def with_layout(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, html, host, layout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([layout(x) for x in part.column(2).to_pylist()], pa.string())], ["page_id", "url", "html", "host", "layout"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of().alias("host"))
    return rows.mapInArrow(run, "page_id long, url string, html string, host string, layout string")


def wrappers(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> host, layout, wrapper (JSON): one for each layout of at least TEMPLATE_PAGES pages, and one
    for the host's other pages (layout ''), each from at most PAGES pages."""
    h = F.xxhash64("page_id")
    rows = with_layout(pages).where("page_id IS NOT NULL").select("page_id", "host", F.explode(F.array("layout", F.lit(""))).alias("layout"))
    # The least hash in each of PAGES slices: partial minima, so a large host or layout is one row a task and slice.
    slices = rows.groupBy("host", "layout", F.pmod(h, F.lit(PAGES)).alias("slice")).agg(F.min(F.struct(h.alias("h"), F.col("page_id"))).alias("m"), F.count("*").alias("n"))
    chosen = slices.groupBy("host", "layout").agg(F.collect_set("m.page_id").alias("ids"), F.sum("n").alias("n")).where((F.col("layout") == "") | (F.col("n") >= TEMPLATE_PAGES)).select(F.explode("ids").alias("chosen"), F.col("host").alias("host_"), F.col("layout").alias("layout_"))

    def run(group: pa.Table) -> pa.Table:
        found = [h for h in group.column("html").to_pylist() if h]
        return pa.table({"host": group.column("host_").slice(0, 1), "layout": group.column("layout_").slice(0, 1), "wrapper": pa.array([json.dumps(induce(found))])})

    chosen = materialize(chosen, "chosen")  # its size is known then, so that a small one is broadcast and pages are not shuffled
    html = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    made = html.join(chosen, F.col("page_id") == F.col("chosen")).select("host_", "layout_", "html").groupBy("host_", "layout_").applyInArrow(run, "host string, layout string, wrapper string")
    return made


def main_texts(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars, host."""
    known = materialize(wrappers(pages), "wrappers").select(F.col("host").alias("host_"), F.col("layout").alias("layout_"), "wrapper")
    own = known.where("layout_ != '' AND wrapper LIKE '%\"slots\"%'")
    rest = known.where("layout_ = ''").select(F.col("host_").alias("host__"), F.col("wrapper").alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, dict] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = []
                for page, wrapper in zip(part.column(2).to_pylist(), part.column(4).to_pylist(), strict=True):
                    if wrapper and wrapper not in read:
                        read[wrapper] = json.loads(wrapper)
                    texts.append(extract(page, read.get(wrapper)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), part.column(3)], ["page_id", "url", "text", "n_chars", "host"])

    joined = with_layout(pages).join(own, (F.col("host") == F.col("host_")) & (F.col("layout") == F.col("layout_")), "left").join(rest, F.col("host") == F.col("host__"), "left")
    joined = joined.select("page_id", "url", "html", "host", F.coalesce("wrapper", "rest").alias("wrapper"))
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long, host string")
