"""HTML extraction by union-free wrappers, inferred for each host from aligned token streams.

A page's token stream becomes a tree in which runs of like siblings fold into one repeated group. Wrappers of the same
host are aligned child list by child list; what only one side has becomes optional, and text turns into a slot that is
constant or variable. Partial wrappers are built for each task and host and merged in two steps, so that no task ever sees
the pages of a host. The wrapper names the slots that hold the main text, and each page is then read by its wrapper.

Main text is what varies from page to page: the search goes down from the root while one child holds all that varies. Beside the
main text, slots that are the same on all pages (of MANY_PAGES or more) and slots that are mostly links, with a repeated group, are
left out; so is what an element's name, class or role marks as menu, notice, comments and so on. Where several siblings vary, an element
named as the article settles the tie. Neighbours with the same tag and attributes are one repeated group, which varies as a whole.

Defined results: a null or empty html gives an empty text; a page of any size and depth is read whole; repeated rows are
extracted alike; a null url belongs to the host ''; an empty table gives an empty result; ids are of any atomic type, null
included; other columns of the input are not read. Where a page has no slot that its wrapper names, its own wrapper decides.
"""

from __future__ import annotations

import html as html_lib
import json
import re
import sys
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrove.llm.common import id_back, id_text, stored, table
from lexgrove.llm.url_filter import host_path

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "select"}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
INLINE = set("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label del".split())
#: Ends an open element of the same kind when it starts again.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCK_ENDS_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
BOILER_TAGS = set("nav footer header aside form script style button head menu dialog".split()) | RAW
BOILER_WORD = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|footer|header|masthead|sidebar|side|widget|widgets|ad|ads|advert|adverts|advertisement|advertising|banner|promo|promotion|sponsor|sponsored|cookie|cookies|notice|notices|consent|gdpr"
    r"|popup|modal|overlay|share|sharing|social|comment|comments|disqus|replies|reply|responses|related|recommended|breadcrumb|breadcrumbs|subscribe|newsletter|login|signup|search|pager|pagination|copyright|toolbar|skip|alert|hidden)(?=$|[\s_-])",
    re.I,
)
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert"}
HEADING = re.compile(r"h[1-6]")
SPACES = re.compile(r"\s+")


#: From so many pages on, a slot with the same text on all of them is part of the template.
MANY_PAGES = 3
#: Child lists whose table of common orders would have more cells are aligned by their longest common runs.
MOST_CELLS = 250_000
VARIES = "~"


def deep() -> None:
    """Trees are walked by plain recursion; pages may nest as deeply as they like."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))


def short(text: str) -> str:
    """A text that stands for a long one."""
    return text if len(text) <= 80 else f"{text[:40]}#{xxhash.xxh3_128_hexdigest(text)}"


class Node:
    """One element of a wrapper: its key, its children in order, and what its own text slots hold."""

    __slots__ = ("children", "key", "links", "optional", "pages", "repeated", "size", "text")

    def __init__(self, key: str) -> None:
        self.key, self.children, self.optional, self.repeated = key, [], False, False
        self.size = self.links = self.pages = 0  # characters of text, of links; pages
        self.text: str | None = None  # the constant of the slot; VARIES where it isn't one

    def dump(self) -> list:
        """All nodes, each before its children, as one flat list."""
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            out += [n.key, n.optional, n.repeated, n.size, n.links, n.pages, n.text, len(n.children)]
            todo += n.children[::-1]
        return out

    @staticmethod
    def load(x: list) -> Node:
        root = Node("")
        todo = [(root, 1)]
        for i in range(0, len(x), 8):
            while todo[-1][1] == 0:
                todo.pop()
            parent, left = todo[-1]
            todo[-1] = (parent, left - 1)
            n = Node(x[i])
            _, n.optional, n.repeated, n.size, n.links, n.pages, n.text, many = x[i : i + 8]
            parent.children.append(n)
            todo.append((n, many))
        return root.children[0]


def matches(x: list[str], y: list[str]) -> Iterator[tuple[int, int]]:
    """Places of the longest common order of two lists of keys, ends in common first."""
    a = 0
    while a < min(len(x), len(y)) and x[a] == y[a]:
        yield a, a
        a += 1
    b = 0
    while b < min(len(x), len(y)) - a and x[-1 - b] == y[-1 - b]:
        b += 1
    p, q = x[a : len(x) - b], y[a : len(y) - b]
    if len(p) * len(q) > MOST_CELLS:
        for m in SequenceMatcher(None, p, q, False).get_matching_blocks():
            yield from ((a + m.a + k, a + m.b + k) for k in range(m.size))
    elif p and q:
        best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i in range(len(p) - 1, -1, -1):
            for j in range(len(q) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if p[i] == q[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(p) and j < len(q):
            if p[i] == q[j]:
                yield a + i, a + j
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    yield from ((len(x) - k, len(y) - k) for k in range(b, 0, -1))


def align(a: Node, b: Node) -> Node:
    """The wrapper of all pages of a and of b. Keys are equal; children are aligned by their longest common order."""
    a.size, a.links, a.pages = a.size + b.size, a.links + b.links, a.pages + b.pages
    a.text = a.text if a.text == b.text else VARIES
    a.optional, a.repeated = a.optional or b.optional, a.repeated or b.repeated
    x, y = a.children, b.children
    if [c.key for c in x] == [c.key for c in y]:
        for c, d in zip(x, y, strict=True):
            align(c, d)
        return a
    i = j = 0
    out: list[Node] = []
    for p, q in [*matches([c.key for c in x], [c.key for c in y]), (len(x), len(y))]:
        for n in (*x[i:p], *y[j:q]):
            n.optional = True
            out.append(n)
        if p < len(x):
            out.append(align(x[p], y[q]))
        i, j = p + 1, q + 1
    a.children = fold(out)
    return a


def fold(children: list[Node]) -> list[Node]:
    """Like neighbours become one repeated group; a shape that a list shows again and again stands once."""
    out: list[Node] = []
    for c in children:
        if out and out[-1].key == c.key:
            align(out[-1], c).repeated = True
            continue
        out.append(c)
        while len(out) >= 4 and out[-1].key == out[-3].key and out[-2].key == out[-4].key:  # (a b) (a b)
            b2, a2 = out.pop(), out.pop()
            align(out[-2], a2).repeated = True
            align(out[-1], b2).repeated = True
    return out


def key_of(tag: str, attributes: str) -> str:
    """Tag and the attributes that tell its part in the page; digits don't tell slots apart."""
    found = {m[0].lower(): (m[1] or m[2] or m[3]) for m in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    if not found:
        return tag
    parts = [f"{k}={short(re.sub(r'[0-9]+', '0', v))}" for k, v in sorted(found.items())]
    key = f"{tag}[{';'.join(parts)}]"
    cut = not is_boiler(key) and any(tells_boiler(tag, k, v) for k, v in found.items())  # by what the key leaves out
    return f"{key[:-1]};boiler]" if cut else key


def read(page: str) -> Iterator[tuple[str, str]]:
    """Tokens of a page: ('open', key), ('close', tag), ('text', characters), ('break', '')."""
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:]
            return
        if m.start() > at:
            yield "text", page[at : m.start()]
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            yield "close", tag
        elif tag == "br":
            yield "text", " "
        elif tag in EMPTY or m[3].endswith("/"):
            if tag == "hr":
                yield "break", ""
        elif tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else (n if tag in ("script", "style") else at)
        else:
            yield "open", key_of(tag, m[3])


def tag_of(key: str) -> str:
    return key.partition("[")[0]


def tells_boiler(tag: str, name: str, value: str) -> bool:
    """Whether an attribute marks boiler; "boiler" is the mark of a key whose whole values do."""
    if name in ("class", "id"):
        return tag not in ("article", "main", "body", "html") and BOILER_WORD.search(value) is not None
    return (name == "role" and value in BOILER_ROLES) or name in ("hidden", "boiler") or (name == "aria-hidden" and value == "true")


def is_boiler(key: str) -> bool:
    tag, _, attributes = key.partition("[")
    if tag in BOILER_TAGS:
        return True
    for part in attributes.rstrip("]").split(";") if attributes else ():
        name, _, value = part.partition("=")
        if tells_boiler(tag, name, value):
            return True
    return False


def is_main(key: str) -> bool:
    return tag_of(key) in ("article", "main") or "itemprop=articleBody" in key or "role=main" in key


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], str, int]]:
    """Text blocks in page order: the keys of the elements around, the text, the characters of it in links."""
    stack: list[str] = []
    open_tags: Counter[str] = Counter()
    text: list[str] = []
    links = in_link = 0

    def flush() -> Iterator[tuple[tuple[str, ...], str, int]]:
        nonlocal links
        if text and (joined := SPACES.sub(" ", html_lib.unescape("".join(text))).strip()):
            yield tuple(stack), joined, links
        text.clear()
        links = 0

    for kind, what in read(page):
        if kind == "text":
            text.append(what)
            links += len(what) if in_link else 0
        elif kind == "break":
            yield from flush()
        elif kind == "open":
            tag = tag_of(what)
            if tag in INLINE:
                in_link += tag == "a"
                if not is_boiler(what):
                    continue
            yield from flush()
            closes = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCK_ENDS_P else set())
            for i in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                if tag_of(stack[i]) in closes:
                    open_tags.subtract(map(tag_of, stack[i:]))
                    del stack[i:]
                    break
                if tag_of(stack[i]) not in ("td", "th", "p", "li", "dt", "dd"):
                    break
            stack.append(what)
            open_tags[tag] += 1
        else:
            if what == "a":
                in_link = max(0, in_link - 1)
            if what in INLINE and what not in map(tag_of, stack[-1:]):
                continue
            if open_tags[what]:
                yield from flush()
                while True:
                    closed = tag_of(stack.pop())
                    open_tags[closed] -= 1
                    if closed == what:
                        break
    yield from flush()


def page_wrapper(page: str) -> Node:
    """The wrapper of one page: its blocks as a tree, like neighbours folded."""
    deep()
    root = Node("")
    root.pages = 1
    path = [root]
    for stack, text, links in blocks(page):
        same = 0
        while same < min(len(stack), len(path) - 1) and path[same + 1].key == stack[same]:
            same += 1
        same = min(same, len(stack) - 1) if stack and same == len(stack) and tag_of(stack[-1]) not in ("body", "html", "div", "article", "main", "section", "td") else same
        for closed in path[:same:-1]:
            closed.children = fold(closed.children)
        del path[same + 1 :]
        for key in stack[same:]:
            n = Node(key)
            n.pages = 1
            path[-1].children.append(n)
            path.append(n)
        n = path[-1]
        n.text = short(text) if n.text is None else VARIES
        n.size, n.links = n.size + len(text), n.links + links
    for closed in path[::-1]:
        closed.children = fold(closed.children)
    return root


Slots = dict[str, list[list[str]]]


def main_slots(wrapper: Node) -> Slots:
    """Paths of the elements whose text is the page's main text ("in"), and of those in them that aren't ("out")."""
    deep()
    many = wrapper.pages >= MANY_PAGES
    sums: dict[int, tuple[int, int, int, bool]] = {}

    def total(n: Node) -> tuple[int, int, int, bool]:
        """Characters that vary and that don't, both without links but for those in headings; characters in links; a named element in it."""
        if id(n) not in sums:
            links = n.links * (not HEADING.fullmatch(tag_of(n.key)))
            fixed = many and n.pages >= MANY_PAGES and n.text not in (None, VARIES) and not n.repeated
            own = n.size - links
            parts = [total(c) for c in n.children if not is_boiler(c.key)]
            sums[id(n)] = ((0 if fixed else own) + sum(p[0] for p in parts), (own if fixed else 0) + sum(p[1] for p in parts), links + sum(p[2] for p in parts), is_main(n.key) or any(p[3] for p in parts))
        return sums[id(n)]

    def aside(n: Node) -> bool:
        """Whether a slot beside the main text is part of the template: the same on all pages, or a list of links."""
        varies, fixed, links, _ = total(n)
        return (not varies and fixed > 0) or (links > varies + fixed and any_repeated(n))

    def any_repeated(n: Node) -> bool:
        return n.repeated or any([any_repeated(c) for c in n.children])

    def inside(n: Node) -> list[Node]:
        return [c for c in n.children if not is_boiler(c.key) and sum(total(c)[:3])]

    n, path = wrapper, []
    if not total(n)[0]:  # nothing varies: all pages are one page, and names are all there is
        many = False
        sums.clear()
    while True:
        rest = [c for c in inside(n) if not aside(c)]
        own = n.size - n.links if n.text is not None else 0
        if len(rest) == 1 and not own and not is_leaf(rest[0]):
            n, path = rest[0], [*path, rest[0].key]
            continue
        named = [c for c in rest if total(c)[3]]
        if is_main(n.key) or not named or own and total(n)[3] and not path:
            break
        # several vary, and some are named or hold what is named
        if len(named) == 1 and not is_leaf(named[0]):
            n, path = named[0], [*path, named[0].key]
            continue
        return {"in": [[*path, c.key] for c in named], "out": []}
    return {"in": [path], "out": [[*path, c.key] for c in inside(n) if aside(c)]}


def is_leaf(n: Node) -> bool:
    """Elements that are one of many in a main text, not what holds it."""
    return n.repeated or tag_of(n.key) in ("p", "li", "td", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote")


def extract(page: str | None, slots: Slots | None) -> str:
    """The main text of a page by its wrapper's slots; without a match, by the page's own."""
    if not page:
        return ""
    own = list(blocks(page))

    def inside(slots: Slots) -> list[str]:
        wanted, left = ([tuple(s) for s in slots[k]] for k in ("in", "out"))
        return [text for stack, text, _ in own if any(stack[: len(s)] == s for s in wanted) and not any(stack[: len(s)] == s for s in left) and not any(map(is_boiler, stack))]

    found = inside(slots) if slots else []
    if not found:
        found = inside(main_slots(page_wrapper(page)))
    return "\n".join(found)


def _merge(rows: pd.DataFrame) -> Node:
    deep()
    merged: Node | None = None
    for w in rows["wrapper"].sort_values():
        n = Node.load(json.loads(w))
        merged = n if merged is None else align(merged, n)
    return merged


def infer_wrappers(pages: DataFrame, salts: int = 32, held_hosts: int = 2000) -> DataFrame:
    """host, slots (JSON) from the columns host and html. A task holds at most held_hosts wrappers at once."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Node] = {}
        frame = lambda: pd.DataFrame([(h, json.dumps(n.dump(), ensure_ascii=False)) for h, n in held.items()], columns=["host", "wrapper"])
        for batch in batches:
            for host, page in zip(batch["host"], batch["html"], strict=True):
                if page:
                    n = page_wrapper(page)
                    held[host] = align(held[host], n) if host in held else n
                if len(held) >= held_hosts:
                    yield frame()
                    held.clear()
        if held:
            yield frame()

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(_merge(rows).dump(), ensure_ascii=False)]})

    def finish(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "slots": [json.dumps(main_slots(_merge(rows)), ensure_ascii=False)]})

    parts = pages.select("host", "html").mapInPandas(partial, "host string, wrapper string")
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts))).groupBy("host", "salt").applyInPandas(merge, "host string, wrapper string")
    return parts.groupBy("host").applyInPandas(finish, "host string, slots string")


#: Up to so many characters of wrappers they are sent to every executor; beyond, pages and wrappers meet by a salted join.
BROADCAST_CHARS = 16_000_000


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", salts: int = 64) -> DataFrame:
    """page_id, url, text, n_chars."""
    source = pages.select(id_text(pages, id_col).alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    source = source.withColumn("host", host_path(F.col("url"))[0])
    wrappers = stored(infer_wrappers(source))
    size = wrappers.agg(F.sum(F.length("slots") + F.length("host"))).first()[0] or 0
    if size <= BROADCAST_CHARS:
        joined = source.join(F.broadcast(wrappers), "host", "left")
    else:
        salted = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = source.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left")
    schema = T.StructType([source.schema["page_id"], source.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Slots] = {}
        for batch in batches:
            texts = []
            for page, slots in zip(batch["html"], batch["slots"], strict=True):
                if slots and slots not in known:
                    known.clear() if len(known) > 5000 else None
                    known[slots] = json.loads(slots)
                texts.append(extract(page, known.get(slots)))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    out = joined.select("page_id", "url", "html", "slots").mapInPandas(apply, schema)
    return out.withColumn("page_id", id_back("page_id", pages.schema[id_col].dataType))


def op3_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
