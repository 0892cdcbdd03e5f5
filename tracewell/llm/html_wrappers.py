"""Main text of web pages by wrappers: union-free regular expressions that the pages of a host have in common.

A page is a stream of tags and texts. Its block elements are balanced, and what repeats is folded into repeated groups;
that is the page's own expression. The distinct expressions of a host are aligned one after the other: what stands in
only one of two becomes optional, texts that differ become slots, and what repeats after an alignment is folded again.
The wrapper of a host then says of each of its slots what it holds: boilerplate by the elements around it, template text
(the same on all pages) and lists of links by what all pages had there, or main text. A page is read by aligning its
expression with its host's wrapper.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.arrow import slices
from tracewell.llm.tables import lookup, materialise

#: Bytes of wrappers that go to every task; beyond that pages and wrappers are joined.
SHARED_BYTES = 8 << 20
#: Elements nested deeper than this are read as if their tags were not there.
DEPTH = 60
#: From this many on, places of one element between others are a list; a page's frame holds fewer that are alike.
REPEATS = 5
#: Rows into which the expressions of one host are dealt before its wrapper is put together.
PARTS = 32
_KEPT = 500  # wrappers in the making that a task holds before it passes them on

# HTML's elements by what they mean for text, and words that name boilerplate.
_BLOCKS = frozenset(
    "html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption article section main header footer nav aside "
    "blockquote pre figure figcaption form fieldset address details summary dialog menu noscript button select textarea option center hgroup search".split()
)
_RAW = frozenset("script style title template svg math iframe object canvas noembed noframes xmp audio video".split())
_DROPPED = frozenset("nav footer aside form button select textarea option menu dialog noscript fieldset search".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer "
    "comment comments respond disqus cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription share "
    "sharing social related recommended widget toolbar pagination pager login signup search copyright masthead topbar".split()
)
_CONTENT = frozenset("content article post entry story main".split())
_ENDS_P = _BLOCKS - {"option", "caption"}
_CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_HOLDS = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table thead tbody tfoot", "td": "tr table", "th": "tr table", "option": "select"}

_TAG = re.compile(r"""<!--|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"<]*"|'[^'<]*'|["'])*+)>|<[!?][^>]*>""")
_NAMED = re.compile(r"""(?:^|[\s/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|$))""", re.I)
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


class Item:
    """A part of an expression: an element (its label), a group ("") or a text slot ("#"), once or many times, perhaps missing.

    ``slot`` is what is known of a slot: while a page is read, the numbers of its texts; in a wrapper, pages, characters,
    characters in links, and the smallest and largest checksum of a text.
    """

    __slots__ = ("label", "kids", "many", "maybe", "slot")

    def __init__(self, label: str, kids: list[Item], many: bool = False, maybe: bool = False, slot: list | None = None):
        self.label, self.kids, self.many, self.maybe, self.slot = label, kids, many, maybe, slot

    @property
    def key(self) -> str:
        return self.label or self.kids[0].key

    def plain(self) -> list:
        """As nested lists, to be written."""
        return [self.label, int(self.many), int(self.maybe), self.slot if self.label == "#" else [k.plain() for k in self.kids]]

    @staticmethod
    def of(plain: list) -> Item:
        label, many, maybe, rest = plain
        return Item(label, [], bool(many), bool(maybe), rest) if label == "#" else Item(label, [Item.of(k) for k in rest], bool(many), bool(maybe))

    def __str__(self) -> str:
        body = "#" if self.label == "#" else f"{self.label}({''.join(map(str, self.kids))})"
        return body + ("*" if self.many and self.maybe else "+" if self.many else "?" if self.maybe else "")


def _pairs(a: list[Item], b: list[Item]) -> list[tuple[int, int]]:
    """The longest common subsequence of two lists by key (keys stand at most a few times in each)."""
    where: dict[str, list[int]] = {}
    for j, item in enumerate(b):
        where.setdefault(item.key, []).append(j)
    tails, links = [], []  # of the shortest chains by length: place in b; chains as linked tuples
    for i, item in enumerate(a):
        for j in reversed(where.get(item.key, ())):
            low, high = 0, len(tails)
            while low < high:
                mid = (low + high) // 2
                low, high = (mid + 1, high) if tails[mid] < j else (low, mid)
            tails[low:low + 1], links[low:low + 1] = [j], [(i, j, links[low - 1] if low else None)]
    out, link = [], links[-1] if links else None
    while link:
        out.append(link[:2])
        link = link[2]
    return out[::-1]


def _joined(a: list | None, b: list | None, reading: bool) -> list | None:
    if a is None or b is None:
        return a or b
    return a + b if reading else [a[0] + b[0], a[1] + b[1], a[2] + b[2], min(a[3], b[3]), max(a[4], b[4])]


def merge(a: Item, b: Item, reading: bool = False) -> Item:
    """The expression of all that either of two with the same key matches."""
    if a.label != b.label:  # a group and a single item that is like its first
        a, b = (x if x.label == "" else Item("", [x]) for x in (a, b))
    kids = align(a.kids, b.kids, reading) if a.label != "#" else []
    return Item(a.label, kids, a.many or b.many, a.maybe or b.maybe, _joined(a.slot, b.slot, reading))


def align(a: list[Item], b: list[Item], reading: bool = False) -> list[Item]:
    """Two lists as one: what only one of them has becomes optional."""
    if len(a) == len(b) and all(x.key == y.key for x, y in zip(a, b)):
        return [merge(x, y, reading) for x, y in zip(a, b)]
    out, i, j = [], 0, 0
    for x, y in [*_pairs(a, b), (len(a), len(b))]:
        for item in [*a[i:x], *b[j:y]]:
            item.maybe = True
            out.append(item)
        if x < len(a):
            out.append(merge(a[x], b[y], reading))
        i, j = x + 1, y + 1
    return fold(out, reading)


def fold(items: list[Item], reading: bool = False) -> list[Item]:
    """Neighbours alike become one item that repeats. What stands ``REPEATS`` times is where a repeated group begins: all
    between its first and its last place is cut there, and the pieces are aligned."""
    out: list[Item] = []
    for item in items:
        if out and out[-1].key == item.key:
            out[-1] = merge(out[-1], item, reading)
            out[-1].many = True
        else:
            out.append(item)
    while len(out) >= REPEATS:
        key, times = max(Counter(item.key for item in out).items(), key=lambda x: x[1])  # of the most frequent, the first
        if times < REPEATS:
            break
        at = [k for k, item in enumerate(out) if item.key == key]
        body: list[Item] | None = None
        for k, start in enumerate(at):
            first = out[start]
            head = list(first.kids) if first.label == "" else [first]
            piece = head + out[start + 1 : at[k + 1] if k + 1 < len(at) else start + 1]
            body = piece if body is None else align(body, piece, reading)
        group = body[0] if len(body) == 1 else Item("", body)
        group.many, group.maybe = True, False
        out[at[0] : at[-1] + 1] = [group]
    return out


def _label(name: str, attributes: str) -> tuple[str, bool]:
    """The element's name with its classes and ids (less digits), and whether it is boilerplate by them."""
    words, hidden = [], False
    for kind, value in _NAMED.findall(attributes) if attributes else ():
        kind, value = kind.lower(), value.strip("\"'").lower()
        hidden |= kind == "hidden" or (kind == "aria-hidden" and value == "true")
        words += re.sub(r"\d+", "", value).split() if kind in ("class", "id", "role") else []
    parts = {p for w in words for p in re.split(r"[^a-z]+", w)}
    content = bool(parts & _CONTENT)
    # The last word of a name is what it is: "post-footer" is boilerplate, though "content-with-sidebar" is not.
    ends = {found[-1] for w in words if (found := re.findall("[a-z]+", w)) and not {"with", "has", "no"} & set(found)}
    return ".".join([name, *sorted(set(words))]), hidden or bool(ends & _WORDS) or (not content and bool(parts & _WORDS))


def read(page: str) -> tuple[Item, list[str], list[int]]:
    """A page's expression, its texts, and how many of each text's characters are in links.

    Elements that are boilerplate by name or class have a label that ends in "!"; an open p, li, cell ... ends where
    HTML ends it. Comments, scripts, styles and titles are left out. Slots hold the numbers of their texts.
    """
    top = Item("", [])
    stack: list[tuple[str, list[Item]]] = [("", top.kids)]
    texts: list[str] = []
    links: list[int] = []
    run: list[str] = []
    linked, in_link, deep, at = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            stack[-1][1].append(Item("#", [], slot=[len(texts)]))
            texts.append(text)
            links.append(min(linked, len(text)))
        run.clear()
        linked = 0

    def close() -> None:
        # What an element repeats is folded when it ends.
        kids = stack.pop()[1]
        kids[:] = fold(kids, True)

    last = page.rfind(">") + 1
    while match := _TAG.search(page, at, last):
        begin, end = match.span()
        if begin > at:
            run.append(page[at:begin])
            linked += (begin - at) * bool(in_link)
        at = end
        if match[2] is None:
            if match[0] == "<!--":
                stop = page.find("-->", max(begin + 2, end - 2))
                at = len(page) if stop < 0 else stop + 3
            continue
        name = match[2].lower()
        if name in _RAW:
            if not match[1] and not match[3].endswith("/"):
                over = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
                at = over.start() if over else len(page)
            run.append(" " if name in ("iframe", "object", "audio", "video") else "")
        elif name == "a":
            in_link = 0 if match[1] else 1
        elif name in ("br", "hr", "img", "input", "wbr"):
            if name != "wbr":
                run.append(" ")
            if name == "hr":
                flush()
        elif name in _BLOCKS:
            flush()
            in_link = 0
            if match[1]:
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
                if k and deep:
                    deep -= 1
                while k and len(stack) > k:
                    close()
                continue
            if name in _ENDS_P and stack[-1][0] == "p":
                close()
            if name in _CLOSES:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in _HOLDS[name].split():
                        break
                    if stack[k][0] in _CLOSES[name].split():
                        while len(stack) > k:
                            close()
            if len(stack) > DEPTH:
                continue
            label, dropped = _label(name, match[3])
            dropped |= name in _DROPPED
            item = Item(label + "!" * dropped, [])
            stack[-1][1].append(item)
            stack.append((name, item.kids))
    run.append(page[at:])
    linked += (len(page) - at) * bool(in_link)
    flush()
    while stack:
        close()
    return top, texts, links


def _slots(item: Item, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Item]]:
    for kid in item.kids:
        if kid.label == "#":
            yield path, kid
        else:
            yield from _slots(kid, (*path, kid.label) if kid.label else path)


def summary(page: str) -> Item:
    """A page's expression with what a wrapper keeps of its texts."""
    top, texts, links = read(page)
    for _, slot in _slots(top):
        sums = [zlib.crc32(texts[k].encode("utf-8", "surrogatepass")) for k in slot.slot]
        slot.slot = [1, sum(len(texts[k]) for k in slot.slot), sum(links[k] for k in slot.slot), min(sums), max(sums)]
    return top


def level(path: tuple[str, ...], slot: list | None, pages: int) -> int:
    """What a slot below these elements holds: 3 article, 2 a container of content, 1 other text, 0 boilerplate.

    Outside of articles, text that is the same on all of at least three pages, or mostly links, is boilerplate.
    """
    names = [re.split(r"[.!]", label, maxsplit=1)[0] for label in path]
    inner = next((k for k in range(len(names) - 1, -1, -1) if names[k] in ("article", "main")), -1)
    if any(label.endswith("!") for label in path):
        return 0
    if "header" in names and not (inner >= 0 and names.index("header") > inner and names[-1] in ("h1", "h2", "h3", "h4", "h5", "h6")):
        return 0
    if "article" in names:
        return 3
    if slot is not None and ((pages >= 3 and slot[0] >= pages and slot[3] == slot[4]) or 2 * slot[2] > slot[1]):
        return 0
    words = {w for label in path for w in re.split(r"[^a-z]+", label)[1:]}
    return 2 if "main" in names or words & _CONTENT else 1


def text(page: str, wrapper: Item | None, pages: int) -> str:
    """The texts of the highest level that the page has, in its order, as blocks."""
    top, texts, _ = read(page)
    found = [0] * len(texts)

    def follow(items: list[Item], known: list[Item], path: tuple[str, ...]) -> None:
        met = dict(_pairs(items, known))
        for i, item in enumerate(items):
            other = known[met[i]] if i in met else None
            if item.label == "#":
                own = level(path, other.slot if other is not None and other.label == "#" else None, pages)
                for k in item.slot:
                    found[k] = own
                continue
            if other is not None and other.label != item.label:  # a group and a single item
                if item.label == "":
                    follow(item.kids, [other], path)
                else:
                    follow([item], other.kids, path)
                continue
            follow(item.kids, other.kids if other is not None else [], (*path, item.label) if item.label else path)

    follow(top.kids, wrapper.kids if wrapper else [], ())
    best = max(found, default=0)
    return "\n\n".join(t for t, own in zip(texts, found, strict=True) if own == best) if best else ""


def _host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1))
    return pages.withColumn("_host", host)


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper, n_pages): the wrapper of every host of ``pages`` (url, html), learnt from all of its pages.

    Tasks put pages of the same expression together before anything is shuffled. The expressions of a host are dealt into
    ``PARTS`` rows by what they are, each aligned in sorted order as it streams by, and these in their order, so that a
    wrapper does not depend on how pages were stored.
    """

    def expressions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}
        for batch in batches:
            for host, page in zip(batch.column("_host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                item = summary(page or "")
                key = host, str(item)
                if key in held:
                    held[key][0] += 1
                    held[key][1] = merge(held[key][1], item)
                else:
                    held[key] = [1, item]
                if len(held) >= _KEPT:
                    yield rows(held)
                    held = {}
        yield rows(held)

    def rows(held: dict[tuple[str, str], list]) -> pa.RecordBatch:
        packed = [(h, zlib.crc32(e.encode("utf-8", "surrogatepass")) % PARTS, e, n, json.dumps(item.plain())) for (h, e), (n, item) in held.items()]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string()]
        columns = [pa.array([p[k] for p in packed], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, ["host", "part", "expression", "n_pages", "wrapper"])

    def aligned(*keys: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def row(key: tuple, n: int, item: Item) -> pa.RecordBatch:
                kinds = {"host": pa.string(), "part": pa.int32(), "n_pages": pa.int64(), "wrapper": pa.string()}
                values = [*key, n, json.dumps(item.plain())]
                names = [*keys, "n_pages", "wrapper"]
                return pa.RecordBatch.from_arrays([pa.array([v], kinds[name]) for name, v in zip(names, values, strict=True)], names)

            now, n, item = None, 0, None
            for batch in batches:
                for values in zip(*(batch.column(c).to_pylist() for c in (*keys, "n_pages", "wrapper")), strict=True):
                    key, other = values[:-2], Item.of(json.loads(values[-1]))
                    if key != now:
                        if now is not None:
                            yield row(now, n, item)
                        now, n, item = key, 0, None
                    n, item = n + values[-2], other if item is None else merge(item, other)
            if now is not None:
                yield row(now, n, item)

        return run

    own = _host(pages).select("_host", "html").mapInArrow(expressions, "host string, part int, expression string, n_pages long, wrapper string")
    parts = own.repartition("host", "part").sortWithinPartitions("host", "part", "expression", "wrapper").select("host", "part", "n_pages", "wrapper")
    halves = parts.mapInArrow(aligned("host", "part"), "host string, part int, n_pages long, wrapper string")
    whole = halves.repartition("host").sortWithinPartitions("host", "part").select("host", "n_pages", "wrapper")
    return whole.mapInArrow(aligned("host"), "host string, n_pages long, wrapper string")


@lru_cache(maxsize=256)
def _wrapper(plain: str) -> Item:
    return Item.of(json.loads(plain))


def extract(pages: DataFrame, wrappers: DataFrame | None = None, shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """``pages`` (url, html and whatever else) with ``text``: the main text by the wrapper of the page's host.

    ``wrappers`` are learnt from ``pages`` unless given. Blocks are in page order, joined by two line ends; character
    references are decoded, and white space inside a block is one space. A page of an unknown host, or of none (null or
    odd url: all of these are one host), is read by the names of its elements alone where its wrapper has nothing.
    Null and empty pages have an empty text. Repeated rows and other columns stay; a column ``text`` is replaced.
    An empty table gives an empty one. Wrappers of up to ``shared_bytes`` in all go to every task, larger ones are joined
    with hot hosts dealt over several tasks.
    """
    wrappers = materialise(infer(pages) if wrappers is None else wrappers.select("host", "n_pages", "wrapper"))
    known = wrappers.select(F.col("host").alias("_host"), F.col("n_pages").alias("_pages"), F.col("wrapper").alias("_wrapper"))
    size = wrappers.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host")), F.lit(0))).first()[0]
    hosted = _host(pages.drop("text"))
    if size <= shared_bytes:
        met = hosted.join(F.broadcast(known), "_host", "left")
    else:
        met = lookup(hosted, known, ["_host"], F.xxhash64("html"))
    keep = [c for c in pages.columns if c != "text"]
    schema = hosted.select(*keep).withColumn("text", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                out = [
                    text(page or "", None if plain is None else _wrapper(plain), n or 0)
                    for page, plain, n in zip(*(part.column(c).to_pylist() for c in ("html", "_wrapper", "_pages")), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(out, pa.string())], [*keep, "text"])

    return met.select(*keep, *[c for c in ("html",) if c not in keep], "_wrapper", "_pages").mapInArrow(run, schema)
