"""Main-text extraction by union-free regular expressions inferred for each host.

A page becomes a stream of tokens: one for each opening or closing tag (with its class words and the id and role words that
tell kinds of boxes apart) and one for each text, which carries the path of boxes around it. A wrapper is a sequence of
tokens, optional groups and repeated groups, that is a regular expression without unions. Repeats inside a page are
folded to repeated groups, whatever their length; then same-host streams are aligned one after another with the wrapper so
far, by a longest common subsequence found in linear space: where tokens agree they are kept, where groups of one kind meet
they are aligned inside, and what only one side has becomes an optional group. Text tokens are the slots. A wrapper is
compiled to a regular expression over token codes, and matching a page with it tells which slot each of its texts fills.

What the slots say. Over all pages of a host, for each slot: whether its text ever varies, how much text it holds and how
much of that is links. A slot that is the same on ``LEAST_PAGES`` pages or more, of different contents, is template (in
article and main only if no slot of the same path varies, as one of many paragraphs may be the same everywhere). Of
those that vary, the content region is the box that holds the most text: an article or main element, or a box named as
content, that has half of it or more, else the innermost box with nine tenths of it. Main text is what fills the varying slots of
that region. Word lists tell apart what varies and is not main text (menus, headers, footers, side bars, notices, adverts,
forms, reader comments); slots that hold mostly links, outside article and main, count as menus.

Slots of groups that repeat several texts each time (a name and what was said), outside article, main and boxes named as
content, are left out where at least as much of the varying text stands outside of them: they are comments or lists.

Slots of repeated groups hold several texts. One of them, outside article and main, that stands in one path beside
``LEAST_PAGES`` different contents or more, and beside at least one of ``SHARE`` of all that the host has, is template as
well, unless it is the text between the heading and the first other text of its slot, a by-line. A content is told by the longest other main text of its page, so that copies of one page, and pages that differ in
small things, count once; a text longer than all others of its page is not counted. A page all of whose main text would go
keeps it, and a page without text in the region of its host is read by its own boxes, as are hosts without variation.

Only distinct folded streams of a host are aligned (they are found by one aggregation, which sums up a host with a
third of all pages in each task first), in blocks of ``BLOCK`` whose wrappers are aligned in turn, so no task gathers
a host's pages. Slots are summed up by one aggregation, over numbers of 64 bits that stand for texts. Pages meet their
wrapper in a join that adaptive execution can split or broadcast by measured size. A page that its wrapper does not accept,
because the compiled form never backtracks, has its texts told apart by their paths.

Defined results: null html counts as empty and gives an empty text; null or odd addresses form a host of their own;
markup that is never closed is read to the end of the page; repeated rows are extracted alike; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import html as htmllib
import json
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..runtime import ship
from . import common

BLOCK = 256
#: A text is template beside so many different contents, and beside one of so many of the host's contents.
LEAST_PAGES, SHARE = 3, 2
_RAW = "script|style|noscript|template|textarea|select|svg|math|iframe|object|canvas|title"
_ATTRIBUTES = r"""(?:"[^"]*"|'[^']*'|[^'">])*"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTRIBUTES})(?:>|\Z)", re.S | re.I)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WHITE = re.compile(r"\s+")
#: The share of a host's varying text that makes a box its content region, named so or not.
NAMED_SHARE, REGION_SHARE = 0.5, 0.75
#: Elements that neither end a block nor stand in a path.
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr meta link".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements and class words of what is not main text.
DROPPED_ELEMENTS = frozenset("nav aside form footer menu dialog button head".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar widget related footer masthead cookie cookies consent notice notices alert banner popup modal newsletter subscribe share social comment comments reply replies disqus login search".split()
)
CONTENT_ELEMENTS = ("article", "main")
CONTENT_WORDS = frozenset("main article content post entry story".split())
#: Elements that can be a content region.
CONTAINERS = frozenset("html body div section article main center".split())
#: Words of class names, and such words with a short number, that tell like boxes apart; longer numbers are those of items.
_WORD, _NUMBERED = re.compile(r"[a-z]+"), re.compile(r"[a-z]+[0-9]{1,2}(?![0-9])")


def _words(attributes: str) -> list[str]:
    found: set[str] = set()
    for m in _NAMED.finditer(attributes):
        said = next(filter(None, m.groups()[1:]), "").lower()
        words = _WORD.findall(said)
        found.update(words + _NUMBERED.findall(said) if m[1].lower() == "class" else (DROPPED_WORDS | CONTENT_WORDS).intersection(words))
    return sorted(found)


def tokenize(page: str) -> tuple[list[str], list[str], list[int]]:
    """Token keys, and for each the text of a text token (else empty) and how many characters of it are links. Keys:
    <name.words, </name, #path."""
    keys: list[str] = []
    texts: list[str] = []
    links: list[int] = []
    stack: list[str] = []
    linked = False

    def text(s: str) -> None:
        s = _WHITE.sub(" ", htmllib.unescape(s))
        if keys and keys[-1][0] == "#":  # inline tags and comments don't end a text
            texts[-1] += s
            links[-1] += linked * len(s)
        elif s.strip():
            keys.append("#" + "/".join(stack))
            texts.append(s)
            links.append(linked * len(s))

    def close(n: int) -> None:
        """Ends all boxes beyond the first n, also those whose end tag is left out."""
        while len(stack) > n:
            keys.append("</" + stack.pop().partition(".")[0])
            texts.append("")
            links.append(0)

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        name = m[3].lower()
        if name in INLINE:
            if name == "br":
                text(" ")
            elif name == "a":
                linked = not m[2]
            continue
        if m[2]:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n].partition(".")[0] == name:
                    close(n)
                    break
        else:
            if stack and stack[-1].partition(".")[0] in ("p", name if name in ("li", "dt", "dd", "tr", "td", "th", "option") else "p"):
                close(len(stack) - 1)
            box = ".".join([name, *_words(m[4])])
            keys.append(f"<{box}")
            if name not in VOID and not m[4].rstrip().endswith("/"):
                stack.append(box)
            texts.append("")
            links.append(0)
    text(page[at:])
    close(0)
    return keys, texts, links


# Wrappers: lists of items; an item is a token key, ["?", items] or ["+", items].


def _key(item: str | list) -> str:
    return item if isinstance(item, str) else json.dumps(item, separators=(",", ":"))


def _kind(item: str | list) -> str:
    """Items of one kind can be aligned: equal tokens, or repeats of groups that begin alike."""
    while not isinstance(item, str):
        if item[0] == "?":
            return _key(item)
        item = item[1][0]
        if isinstance(item, str):
            return "+" + item
    return item


def _numbers(keys: list[str]) -> np.ndarray:
    number: dict[str, int] = {}
    return np.array([number.setdefault(k, len(number)) for k in keys], dtype=np.int64)


def fold(items: list) -> list:
    """Repeats of adjacent equal runs as repeated groups, shortest periods first, until none is left."""
    keys, changed = [_key(x) for x in items], True
    while changed:
        changed, period = False, 0
        ids = _numbers(keys)
        while (period := period + 1) <= len(items) // 2:
            if np.count_nonzero(ids[:-period] == ids[period:]) < period:
                continue
            out, out_keys, i = [], [], 0
            while i < len(items):
                n = 1
                if i + period < len(items) and keys[i] == keys[i + period]:
                    group = keys[i : i + period]
                    while keys[i + n * period : i + (n + 1) * period] == group:
                        n += 1
                if n > 1:
                    x = items[i] if period == 1 and items[i][0] == "+" else ["+", items[i : i + period]]
                    i, changed = i + n * period, True
                else:
                    x, i = items[i], i + 1
                out.append(x)
                out_keys.append(_key(x))
            if len(out) < len(items):
                ids = _numbers(out_keys)
            items, keys = out, out_keys
    # a copy beside its repeated group belongs to the group
    out, out_keys, due = [], [], {}  # due: the place where a group's copy would end, and the group's place
    for x, k in zip(items, keys):
        out.append(x)
        out_keys.append(k)
        if not isinstance(x, str) and x[0] == "+":
            due[len(out) - 1 + len(x[1])] = len(out) - 1
        elif (g := due.get(len(out) - 1)) is not None and g < len(out) - 1 and [_key(y) for y in out[g][1]] == out_keys[g + 1 :]:
            del out[g + 1 :], out_keys[g + 1 :]
    return out


def _optional(items: list) -> list:
    if len(items) == 1 and not isinstance(items[0], str) and items[0][0] == "?":
        return items
    return [["?", items]] if items else []


def _apart(a: list, b: list) -> list:
    """What stands between two matches: a group beside its own repeat is a repeat, all else is optional."""
    for x, y in ((a, b), (b, a)):
        if len(y) == 1 and not isinstance(y[0], str) and y[0][0] == "+" and _key(["+", x]) == _key(y[0]):
            return y
    return _optional(a) + _optional(b)


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The length of the longest common subsequence of a and b[:j], for each j, in one integer of len(b) bits."""
    masks: dict[int, int] = {}
    for j, c in enumerate(b):
        masks[c] = masks.get(c, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    for c in a:
        if u := v & masks.get(c, 0):
            v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _common(a: list[int], b: list[int], i: int = 0, j: int = 0) -> Iterator[tuple[int, int]]:
    """The places of a longest common subsequence, in order, by halving a: in space linear in the lists."""
    if len(a) == 1 and a[0] in b:
        yield i, j + b.index(a[0])
    if len(a) < 2 or not b:
        return
    half = len(a) // 2
    cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
    yield from _common(a[:half], b[:cut], i, j)
    yield from _common(a[half:], b[cut:], i + half, j + cut)


def align(a: list, b: list) -> list:
    """A wrapper that accepts what a and b accept, apart from what possessive matching can't tell apart."""
    n = 0
    while n < min(len(a), len(b)) and _key(a[n]) == _key(b[n]):
        n += 1
    m = 0
    while m < min(len(a), len(b)) - n and _key(a[-1 - m]) == _key(b[-1 - m]):
        m += 1
    head, tail = a[:n], a[len(a) - m :]
    a, b = a[n : len(a) - m], b[n : len(b) - m]
    # an optional group and what it holds are of one kind as well
    bare = lambda x: x[1][0] if not isinstance(x, str) and x[0] == "?" and len(x[1]) == 1 else x
    number: dict[str, int] = {}
    kinds = [[number.setdefault(_kind(bare(x)), len(number)) for x in side] for side in (a, b)]
    out, i, j = list(head), 0, 0
    for p, q in _common(*kinds):
        out += _apart(a[i:p], b[j:q])
        x, y = bare(a[p]), bare(b[q])
        merged = x if _key(x) == _key(y) else ["+", align(x[1] if not isinstance(x, str) else [x], y[1] if not isinstance(y, str) else [y])]
        out += [merged] if x is a[p] and y is b[q] else [["?", [merged]]]
        i, j = p + 1, q + 1
    return out + _apart(a[i:], b[j:]) + tail


def skeleton(keys: list[str]) -> list:
    return fold(list(keys))


class Wrapper:
    """A wrapper ready to match: token codes, the compiled expression, and the paths of its slots."""

    def __init__(self, items: list) -> None:
        self.codes: dict[str, str] = {}
        self.slots: list[str] = []
        #: Slots of repeated groups that hold several texts each time, as a list of comments does.
        self.records: set[int] = set()
        pattern = "".join(map(self._pattern, items))
        self.pattern = regex.compile(pattern)
        self.by_path = {path: n for n, path in reversed(list(enumerate(self.slots)))}

    def _pattern(self, item: str | list) -> str:
        if not isinstance(item, str):
            first = len(self.slots)
            pattern = f"(?:{''.join(map(self._pattern, item[1]))}){item[0]}+"
            if item[0] == "+" and len(self.slots) - first > 1:
                self.records.update(range(first, len(self.slots)))
            return pattern
        code = regex.escape(self.codes.setdefault(item, chr(0x10000 + len(self.codes))))
        if item[0] == "#":
            self.slots.append(item)
            return f"({code})"
        return code

    def filled(self, keys: list[str]) -> dict[int, int] | None:
        """The slot that each text token fills, or None where the wrapper does not accept the stream."""
        if any(k not in self.codes for k in keys):
            return None
        m = self.pattern.fullmatch("".join(map(self.codes.__getitem__, keys)))
        return None if m is None else {at: n for n in range(len(self.slots)) for at in m.starts(n + 1)}

    def places(self, keys: list[str]) -> dict[int, int]:
        """As filled, or else by path: the first slot in the path of each text token, -1 if there is none."""
        found = self.filled(keys)
        return {i: self.by_path.get(k, -1) for i, k in enumerate(keys) if k[0] == "#"} if found is None else found


def _boxes(path: str) -> list[tuple[str, set[str]]]:
    return [(n, set(w)) for n, *w in (box.split(".") for box in path[1:].split("/"))]


def _content(paths: list[str]) -> str:
    """The kind of box that holds the content: the first of article, main, a box so named, or else the whole page."""
    boxes = [b for p in paths for b in _boxes(p)]
    for name in CONTENT_ELEMENTS:
        if any(n == name for n, _ in boxes):
            return name
    return ".named" if any(w & CONTENT_WORDS and not w & DROPPED_WORDS for _, w in boxes) else ""


@functools.lru_cache(maxsize=65536)
def _is_main(path: str, content: str) -> bool:
    inside = not content
    for name, words in _boxes(path):
        if name in DROPPED_ELEMENTS or words & DROPPED_WORDS and name not in ("html", "body"):
            return False
        if name == "header" and not inside:
            return False
        inside = inside or name == content or content == ".named" and bool(words & CONTENT_WORDS)
    return inside


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").hostname or ""
    except ValueError:
        return ""


@functools.lru_cache(maxsize=4096)
def _compiled(wrapper: str) -> Wrapper:
    return Wrapper(json.loads(wrapper))


def _listed(keys: list[str]) -> set[int]:
    """The places of main-text tokens by the page alone."""
    content = _content(sorted({k for k in keys if k[0] == "#"}))
    return {i for i, k in enumerate(keys) if k[0] == "#" and _is_main(k, content)}


def _mark(path: str, text: str) -> int:
    """64 bits of a text in its path."""
    return int.from_bytes(hashlib.blake2b(f"{path}\n{text.strip()}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def contents(keys: list[str], texts: list[str]) -> tuple[int | None, dict[int, int]]:
    """The mark of a page's longest main text, which tells its content; and for each main text, up to half of it all, its
    mark, and the mark of the longest other one. Texts inside a content element are content whatever they say."""
    size: dict[int, int] = {}
    for i in _listed(keys):
        if not any(name in CONTENT_ELEMENTS for name, _ in _boxes(keys[i])):
            size[_mark(keys[i], texts[i])] = len(texts[i])
    order, all_ = sorted(size, key=lambda h: (-size[h], h))[:2], sum(size.values())
    beside = {h: order[1] if h == order[0] else order[0] for h in size if 2 * size[h] <= all_ and len(order) > 1}
    return (order[0] if order else None), beside


def region(slots: list[tuple[str, int]]) -> tuple[str, str]:
    """The content region of varying slots (path, size of their texts): ("name", element or ".named") for all boxes of
    that kind, or ("path", box) for the innermost box that holds most; the whole page if there is no text."""
    total = sum(n for _, n in slots)
    inside: dict[str, int] = {}
    held: dict[str, int] = {}
    for path, n in slots:
        boxes = _boxes(path)
        kinds = {name for name, _ in boxes if name in CONTENT_ELEMENTS} | {".named" for _, w in boxes if w & CONTENT_WORDS and not w & DROPPED_WORDS}
        for kind in kinds:
            held[kind] = held.get(kind, 0) + n
        parts = path[1:].split("/")
        for k, (name, _) in enumerate(boxes):
            if name in CONTAINERS:
                box = "/".join(parts[: k + 1])
                inside[box] = inside.get(box, 0) + n
    for kind in (*CONTENT_ELEMENTS, ".named"):
        if total and held.get(kind, 0) >= NAMED_SHARE * total:
            return "name", kind
    most = [box for box, n in inside.items() if total and n >= REGION_SHARE * total]
    return ("path", max(most, key=lambda box: (box.count("/"), box))) if most else ("name", "")


def _named(path: str) -> bool:
    """Whether a path leads through an element, or a box so named, that says that it is content."""
    return any(name in CONTENT_ELEMENTS or words & CONTENT_WORDS for name, words in _boxes(path))


def main_slots(slots: list[str], seen: dict[int, tuple[bool, int, int]], records: set[int] = frozenset()) -> list[int]:
    """The slots of main text. slots: the paths of a wrapper's slots; records: those of groups that repeat several texts; seen: for slots that pages fill, whether the text is
    always the same over different contents, its size over all pages, and how much of that is links."""
    varying, alive = [], {slots[n] for n, (same, _, _) in seen.items() if 0 <= n < len(slots) and not same}
    for n, (same, size, links) in sorted(seen.items()):
        if 0 <= n < len(slots) and size and same and any(name in CONTENT_ELEMENTS for name, _ in _boxes(slots[n])):
            same = slots[n] not in alive
        if 0 <= n < len(slots) and not same and size and not any(name in DROPPED_ELEMENTS or w & DROPPED_WORDS and name not in ("html", "body") for name, w in _boxes(slots[n])):
            if 2 * links <= size or any(name in CONTENT_ELEMENTS for name, _ in _boxes(slots[n])):
                varying.append((n, slots[n], size))
    # lists of records beside at least as much plain text are what readers and others added, whatever their boxes are called
    listed = [n for n, path, _ in varying if n in records and not _named(path)]
    if 2 * sum(size for n, _, size in varying if n in listed) <= sum(size for _, _, size in varying):
        varying = [v for v in varying if v[0] not in listed]
    how, box = region([(path, size) for _, path, size in varying])
    if how == "name":
        return [n for n, path, _ in varying if _is_main(path, box)]
    return [n for n, path, _ in varying if (path[1:] + "/").startswith(box + "/") and not any(name == "header" for name, _ in _boxes(path) if "header" not in box)]


class Page:
    """A page's texts by the slots of its host's wrapper."""

    def __init__(self, page: str, wrapper: str | None, template: frozenset[int] = frozenset()) -> None:
        keys, texts, links = tokenize(page)
        places = _compiled(wrapper).places(keys) if wrapper else {i: -1 for i, k in enumerate(keys) if k[0] == "#"}
        own = _listed(keys)
        #: slot, whether the page alone takes it for main text, whether it is a text of the host's template, and the text
        self.blocks = [(n, i in own, bool(template) and _mark(keys[i], texts[i]) in template, _WHITE.sub(" ", texts[i]).strip()) for i, n in sorted(places.items())]
        longest = max(((len(texts[i]), i) for i in own or places), default=None)
        self.content = _mark(keys[longest[1]], texts[longest[1]]) if longest else None
        fills: dict[int, list[int]] = {}
        for i, n in sorted(places.items()):
            fills.setdefault(n, []).append(i)
        #: slot, mark of what fills it, its size, how much of that is links
        self.fills = [(n, _mark("", "\n".join(texts[i].strip() for i in at)), sum(len(texts[i]) for i in at), sum(links[i] for i in at)) for n, at in fills.items()]


def _streams(pages: DataFrame) -> DataFrame:
    """From all pages (host, html), without repeats: rows (host, wrapper) of streams, rows (host, beside) of contents
    and rows (host, mark, beside) of main texts; in each the other columns are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple, None] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, texts, _ = tokenize(page or "")
                rows[host, json.dumps(skeleton(keys), separators=(",", ":")), None, None] = None
                content, found = contents(keys, texts)
                if content is not None:
                    rows[host, None, None, content] = None
                for mark, beside in found.items():
                    rows[host, None, mark, beside] = None
            columns = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["host", "wrapper", "mark", "beside"])

    return common.materialize(pages.mapInArrow(run, "host string, wrapper string, mark long, beside long").distinct(), "html-streams")


def template_texts(streams: DataFrame) -> DataFrame:
    """(host, template): the marks of texts that are the same over the contents of a host."""
    beside = streams.filter("mark is not null").groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n"))
    every = streams.filter("mark is null and beside is not null").groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    same = beside.filter(F.col("n") >= LEAST_PAGES).join(every, "host").filter(F.col("n") * SHARE >= F.col("all"))
    return same.groupBy("host").agg(F.array_sort(F.collect_set("mark")).alias("template"))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, template), from all pages (host, html)."""
    streams = _streams(pages)
    return _aligned(streams.filter("wrapper is not null").select("host", "wrapper")).join(template_texts(streams), "host", "left")


def _aligned(now: DataFrame) -> DataFrame:
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        wrapper = None
        for w in sorted(pdf["wrapper"]):  # the same order however rows arrive
            items = json.loads(w)
            wrapper = items if wrapper is None else align(wrapper, items)
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "wrapper": json.dumps(wrapper, separators=(",", ":"))})

    while True:
        per = now.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        most = per.agg(F.max("n")).first()[0]
        if not most or most == 1:
            return now
        dealt = now.join(per, "host").withColumn("block", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / BLOCK).cast("long")))
        now = common.materialize(dealt.groupBy("host", "block").applyInPandas(merge, "host string, wrapper string"), "html-wrappers")


_PAGE = "page_id long, url string, host string, content long, blocks array<struct<slot:int,own:boolean,same:boolean,text:string>>, fills array<struct<slot:int,mark:long,size:long,links:long>>"


def _pages(with_host: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Each page's texts by slot, from (page_id, url, html, host) and (host, wrapper, template)."""
    schema = to_arrow_schema(StructType.fromDDL(_PAGE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [[f.name for f in schema.field(c).type.value_type] for c in ("blocks", "fills")]
        for whole in batches:
            for batch in common.slices(whole, 2):
                found = [Page(p or "", w, frozenset(t or ())) for p, w, t in zip(*(batch.column(n).to_pylist() for n in (2, 4, 5)))]
                blocks, fills = ([[dict(zip(names[k], x)) for x in (f.blocks, f.fills)[k]] for f in found] for k in (0, 1))
                columns = [batch.column(0), batch.column(1), batch.column(3), [f.content for f in found], blocks, fills]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    met = with_host.join(wrappers, "host", "left").select("page_id", "url", "html", "host", "wrapper", "template")
    return common.materialize(met.mapInArrow(common.lean(run), _PAGE), "html-pages")


def _decided(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, main): the slots of main text of each host's wrapper."""
    fills = pages.select("host", "content", F.explode("fills").alias("f"))
    same = (F.count(F.lit(1)) >= LEAST_PAGES) & (F.min("f.mark") == F.max("f.mark")) & (F.min("content") < F.max("content"))
    seen = fills.groupBy("host", F.col("f.slot").alias("slot")).agg(same.alias("same"), F.sum("f.size").alias("size"), F.sum("f.links").alias("links"))

    def decide(slots: pd.DataFrame, wrapper: pd.DataFrame) -> pd.DataFrame:
        if not len(slots) or not len(wrapper):
            return pd.DataFrame({"host": [], "main": []})
        rows = {int(n): (bool(s), int(z), int(k)) for n, s, z, k in zip(slots["slot"], slots["same"], slots["size"], slots["links"])}
        return pd.DataFrame({"host": wrapper["host"].iloc[:1], "main": [main_slots((w := _compiled(wrapper["wrapper"].iat[0])).slots, rows, w.records)]})

    met = seen.groupBy("host").cogroup(wrappers.select("host", "wrapper").groupBy("host"))
    return common.materialize(met.applyInPandas(decide, "host string, main array<int>"), "html-slots")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars)"""
    ship(pages.sparkSession)

    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("host", pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string()))

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    with_host = rows.mapInArrow(hosts, "page_id long, url string, html string, host string")
    wrappers = common.materialize(infer_wrappers(with_host.select("host", "html")), "html-templates")
    found = _pages(with_host, wrappers)
    met = found.select("page_id", "url", "host", "blocks").join(_decided(found, wrappers), "host", "left")
    of_main = lambda b: F.array_contains("main", b.slot)
    some = lambda take: F.transform(F.filter("blocks", lambda b: take(b) & (b.text != "")), lambda b: b.text)
    none = F.array().cast("array<string>")
    # what is the same on all pages but stands between the heading and a text that is not, in a slot of that text, is its by-line
    met = met.withColumn("told", F.filter("blocks", lambda b: of_main(b) & (b.text != "")))
    at = lambda i: F.get("told", F.lit(i))
    by_line = (F.size("told") > 2) & ~at(0).same & ~at(2).same & (at(1).slot == at(2).slot)
    varying = F.transform(F.filter("told", lambda b, i: ~b.same | ((i == 1) & by_line)), lambda b: b.text)
    choices = [varying, some(of_main), some(lambda b: b.own & ~b.same), some(lambda b: b.own)]
    text = F.array_join(F.coalesce(*(F.when(F.size(c) > 0, c) for c in choices), none), "\n").alias("text")
    return met.select("page_id", "url", text).withColumn("n_chars", F.char_length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(common.read_table(spark, sf_dir, "pages"))
