"""HTML extraction: union-free regular expressions inferred from same-host pages serve as wrappers.

Every page is read as a stream of elements and texts, its own wrapper. The wrappers of a host's pages are aligned one
after the other: mismatching texts become slots, repeated neighbours one repeated group, and parts that only some
pages have optional groups; no alternatives arise. The wrapper then says where a host's articles are: in the part
that holds most of what its slots take in. Texts that all pages have at one place are the site's and not the article's.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from prunescan.llm.common import fresh, sliced, stored
from prunescan.llm.url_filter import url_host

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|title|textarea|noscript|template|iframe|svg|math|canvas|object|select|video|audio"
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
BOILER_TAGS = frozenset("aside button dialog footer form head header input label menu nav option".split())
BOILER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class and id names that mark menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
BOILER = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|copyright|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notification|pager|pagination|popup|promo\w*|replies|respond|sidebar|signup|sponsor\w*|subscribe|subscription|widget)(?:$|[-_\s])",
    re.IGNORECASE,
)
# What an opening tag implicitly closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {t: {"p"} for t in BLOCKS - {"body", "html", "li", "dt", "dd", "tr"}}
SCOPE = frozenset("article aside body div footer form header html main nav ol section table td th ul".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>|([^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements nested deeper belong to the one at this depth.
DEPTH = 120
#: Cells (bits) of an alignment's table that are held at a time; of larger tables single rows are, and those between are made again.
MOST_CELLS = 1 << 23
#: Page wrappers that a task merges at a time.
FAN_IN = 256


@dataclass(slots=True)
class Node:
    """An element with its children (elements and texts) in order."""

    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    kids: list = field(default_factory=list)

    @property
    def sign(self) -> str:
        """Tag, landmark and class names; digits are left out as they tend to number pages."""
        if not self.attrs:
            return self.tag
        mark = ["@article"] * (self.attrs.get("itemprop", "").lower() == "articlebody") + ["@main"] * (self.attrs.get("role", "").lower() == "main")
        return ".".join([self.tag, *mark, *sorted(re.sub(r"\d+", "", self.attrs.get("class", "")).split())])


def parse(page: str) -> Node:
    """The page's elements; scripts, styles and the like are left out, missing end tags are put in.

    What is nested deeper than DEPTH goes to the element there, with a rule where a block begins or ends.
    """
    root = Node("#root")
    stack = [root]
    for m in TOKEN.finditer(page):
        text, tag = m[5], (m[3] or "").lower()
        if text:
            stack[-1].kids.append(entities.unescape(text))
            continue
        if not tag:
            continue
        before = len(stack)
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE and tag not in SCOPE:
                    break
        else:
            shut = CLOSES.get(tag, ())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in shut:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE:
                    break
            node = Node(tag, {a.lower(): entities.unescape(b or c or d or "") for a, b, c, d in ATTRIBUTE.findall(m[4])} if m[4] else {})
            if len(stack) <= DEPTH:
                stack[-1].kids.append(node)
            elif not _boiler(node):
                node.kids = stack[-1].kids
            if tag not in VOID and not (m[4] or "").rstrip().endswith("/"):
                stack.append(node)
        if max(before, len(stack)) > DEPTH and tag in BLOCKS:
            stack[-1].kids.append(Node("hr"))
    return root


def squeeze(text: str) -> str:
    """White space runs as one space, trimmed."""
    return " ".join(text.split())


def text_key(text: str) -> int:
    """What stands for a text in a wrapper."""
    return xxhash.xxh64_intdigest(text) >> 1


@dataclass(slots=True)
class Part:
    """Part of a wrapper: an element, a group ``()`` or a text ``#``.

    ``common`` are the texts, with their lengths, that all pages which have the part have at this place; a text part is a
    slot if others stand there too. ``chars`` and ``links`` are the characters of all pages there and how many of them are
    in links. ``pages`` have the part.
    """

    sign: str
    kids: list = field(default_factory=list)
    common: dict[int, int] = field(default_factory=dict)
    slot: bool = False
    optional: bool = False
    repeated: bool = False
    chars: int = 0
    links: int = 0
    pages: int = 1

    def __str__(self) -> str:
        if self.sign == "#":
            body = "#SLOT" if self.slot else "#TEXT"
        else:
            inner = "".join(map(str, self.kids))
            body = inner if self.sign == "()" else f"<{self.sign}>{inner}</{self.sign.partition('.')[0]}>"
        return body if not (self.optional or self.repeated) else f"({body})" + ("*" if self.optional and self.repeated else "?" if self.optional else "+")

    def packed(self) -> list:
        """The part as nested lists, for its way between tasks."""
        flags = self.slot + 2 * self.optional + 4 * self.repeated
        return [self.sign, [k.packed() for k in self.kids], list(self.common.items()), flags, self.chars, self.links, self.pages]

    @classmethod
    def unpacked(cls, x: list) -> Part:
        sign, kids, common, flags, chars, links, pages = x
        return cls(sign, [cls.unpacked(k) for k in kids], {k: n for k, n in common}, bool(flags & 1), bool(flags & 2), bool(flags & 4), chars, links, pages)


def as_parts(node: Node, link: bool = False) -> Part:
    """A page's own wrapper, repeated neighbours folded."""
    kids = []
    for kid in node.kids:
        if isinstance(kid, Node):
            if kid.kids:
                kids.append(as_parts(kid, link or kid.tag == "a"))
        elif text := squeeze(kid):
            kids.append(Part("#", common={text_key(text): len(text)}, chars=len(text), links=len(text) * link))
    return Part(node.sign, fold(kids))


def fold(kids: list[Part], longest: int = 4) -> list[Part]:
    """Turn runs that repeat at once (of up to ``longest`` parts) into one repeated part or group."""
    for period in range(1, longest + 1):
        out: list[Part] = []
        for kid in kids:
            out.append(kid)
            while len(out) > period:
                last, group = out[-period:], out[-period - 1]
                if period > 1 and group.sign == "()" and len(group.kids) == period and all(x.sign == y.sign for x, y in zip(group.kids, last)):
                    del out[-period:]
                    group.kids = [merge(x, y, True) for x, y in zip(group.kids, last)]
                elif len(out) >= 2 * period and all(x.sign == y.sign for x, y in zip(out[-2 * period :], last)) and any(x.sign != "#" for x in last):
                    both = [merge(x, y, True) for x, y in zip(out[-2 * period :], last)]
                    one = both[0] if period == 1 else Part("()", both, pages=max(x.pages for x in both))
                    one.repeated = True
                    out[-2 * period :] = [one]
                else:
                    break
        kids = out
    return kids


def merge(a: Part, b: Part, within: bool = False) -> Part:
    """The wrapper of two parts of one sign, of different pages or (``within``) of the same.

    Pages have in common what both have; within pages it is what either holds, unless some pages lack it.
    """
    kids = [] if a.sign == "#" else fold(align(a.kids, b.kids, within))
    if within:
        common = ({} if a.optional else a.common) | ({} if b.optional else b.common)
        pages, optional = max(a.pages, b.pages), a.optional and b.optional
    else:
        common = {k: n for k, n in a.common.items() if k in b.common}
        pages, optional = a.pages + b.pages, a.optional or b.optional
    return Part(a.sign, kids, common, a.slot or b.slot or a.common.keys() != b.common.keys(), optional, a.repeated or b.repeated, a.chars + b.chars, a.links + b.links, pages)


def _longest_match(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, whatever the lengths.

    Row ``i`` of the table says how much ``a[i:]`` has in common with every end of ``b``, as one number: bit ``k`` is 0 where
    the end of length ``k + 1`` has one more in common than that of length ``k``. A row is a few operations on whole numbers.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return []
    full, places = (1 << m) - 1, {sign: [] for sign in a}
    for k, sign in enumerate(reversed(b)):
        if sign in places:
            places[sign].append(k)
    at = {sign: _bits(p, m) for sign, p in places.items()}

    def row(sign: str, below: int) -> int:
        hit = below & at[sign]
        return (below + hit | below - hit) & full

    step = n if n * m <= MOST_CELLS else max(1, math.isqrt(n))
    kept, own = {n: full}, full
    if step < n:
        for i in range(n - 1, 0, -1):
            own = row(a[i], own)
            if i % step == 0:
                kept[i] = own
    in_common = lambda i, k: k - (rows[i - first] & (1 << k) - 1).bit_count()
    out, i, j, first, rows = [], 0, 0, 0, []
    while i < n and j < m:
        if i >= first + len(rows) - 1:
            first, last = i, min(i - i % step + step, n)
            rows = [kept[last]]
            for k in range(last - 1, first - 1, -1):
                rows.append(row(a[k], rows[-1]))
            rows.reverse()
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif in_common(i + 1, m - j) >= in_common(i, m - j - 1):
            i += 1
        else:
            j += 1
    return out


def _bits(places: list[int], m: int) -> int:
    """The number with these bits of ``m`` set."""
    out = bytearray(m // 8 + 1)
    for p in places:
        out[p >> 3] |= 1 << (p & 7)
    return int.from_bytes(out, "little")


def _matched(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places that match, in order and as many as can be; equal beginnings and ends match whole."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    inner = _longest_match(a[first : len(a) - last], b[first : len(b) - last])
    ahead = [(k, k) for k in range(first)]
    return ahead + [(first + i, first + j) for i, j in inner] + [(len(a) - k, len(b) - k) for k in range(last, 0, -1)]


def align(a: list[Part], b: list[Part], within: bool = False) -> list[Part]:
    """Match the parts of two streams in order; those of one stream only become optional."""
    out, i, j = [], 0, 0
    for p, q in [*_matched([x.sign for x in a], [x.sign for x in b]), (len(a), len(b))]:
        for rest in a[i:p] + b[j:q]:
            rest.optional = True
            out.append(rest)
        if p < len(a):
            out.append(merge(a[p], b[q], within))
        i, j = p + 1, q + 1
    return out


def infer(pages: list[str]) -> Part | None:
    """The wrapper that the pages share."""
    whole = None
    for page in pages:
        own = as_parts(parse(page))
        whole = own if whole is None else merge(whole, own)
    return whole


def _boiler_sign(sign: str) -> bool:
    tag, *names = sign.split(".")
    return tag in BOILER_TAGS or tag not in ("body", "html") and bool(BOILER.search(" ".join(n for n in names if n[0] != "@")))


def _boiler(node: Node) -> bool:
    if not node.attrs:
        return node.tag in BOILER_TAGS
    a = node.attrs
    named = BOILER.search(a.get("class", "")) or BOILER.search(a.get("id", ""))
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    return node.tag in BOILER_TAGS or a.get("role", "").lower() in BOILER_ROLES or hidden or bool(named) and node.tag not in ("body", "html")


def _landmark(sign: str) -> str | None:
    if sign.split(".")[0] == "article" or "@article" in sign:
        return "article"
    return "main" if sign.split(".")[0] == "main" or "@main" in sign else None


@dataclass(slots=True)
class Plan:
    """What a wrapper says of a host's pages: ``regions`` (paths of what holds the article), ``menus`` (paths of groups of links), ``fixed`` (path and key of the site's texts)."""

    regions: set[str]
    menus: set[str]
    fixed: set[tuple[str, int]]

    def packed(self) -> str:
        return json.dumps([sorted(self.regions), sorted(self.menus), sorted(self.fixed)])

    @classmethod
    def unpacked(cls, text: str) -> Plan:
        regions, menus, fixed = json.loads(text)
        return cls(set(regions), set(menus), {(path, key) for path, key in fixed})


def plan(wrapper: Part, least: int) -> Plan:
    """Find the article in a wrapper.

    What counts is the text outside links that the slots take in (all text, if fewer than ``least`` pages were merged or the
    place has no slot with that much as the pages are copies). The article is in the ``article`` elements, else in
    ``main``; else it is the innermost element that still has most of what counts, without repeated groups that hold
    links only, the menus. Texts that all pages which have a part (at least ``least``, and a tenth of all) have there
    are the site's, unless they are most of the article: then the pages are copies of each other.
    """
    known = wrapper.pages >= least

    def mass(part: Part, slots: bool) -> int:
        if part.sign == "#":
            fixed = 0 if not slots or part.slot else part.chars
            return part.chars - part.links - min(fixed, part.chars - part.links)
        return 0 if _boiler_sign(part.sign) else sum(mass(k, slots) for k in part.kids)

    slots = known and mass(wrapper, True) > 0
    marks: dict[str, set[str]] = {"article": set(), "main": set()}
    todo = [(wrapper, "", frozenset())]
    while todo:
        part, path, inside = todo.pop()
        if part.sign == "#" or _boiler_sign(part.sign):
            continue
        here = path if part.sign == "()" else f"{path}/{part.sign}"
        mark = _landmark(part.sign) if part.sign != "()" else None
        if mark and mark not in inside and sum(k.chars for k in _texts(part)):
            marks[mark].add(here)
        todo += [(k, here, inside | {mark} if mark else inside) for k in part.kids]
    regions, menus = marks["article"] or marks["main"], set()
    if not regions:
        node, path = wrapper, f"/{wrapper.sign}"
        while True:
            inner = [(k, path) for k in node.kids]
            while any(k.sign == "()" for k, _ in inner):
                inner = [x for k, at in inner for x in ([(g, at) for g in k.kids] if k.sign == "()" else [(k, at)])]
            blocks = [(mass(k, slots), k) for k, _ in inner if k.sign.split(".")[0] in BLOCKS and not _boiler_sign(k.sign)]
            best = max(blocks, key=lambda x: x[0], default=(0, None))
            tag = best[1].sign.split(".")[0] if best[1] else ""
            if not best[0] or best[0] < 0.7 * mass(node, slots) or best[1].repeated or tag in HEADINGS or tag == "p":
                break
            node, path = best[1], f"{path}/{best[1].sign}"
        regions = {path}
        todo = [(node, path.rpartition("/")[0], False)]
        while todo:
            part, at, again = todo.pop()
            here = at if part.sign == "()" else f"{at}/{part.sign}"
            texts = list(_texts(part))
            if part.sign not in ("#", "()") and (again or part.repeated) and texts and all(t.links == t.chars for t in texts):
                menus.add(here)
                continue
            todo += [(k, here, again or part.repeated) if part.sign == "()" else (k, here, False) for k in part.kids if k.sign != "#"]
    fixed, size, total = set(), 0, 0
    todo = [(wrapper, "", wrapper.pages)] if known else []
    while todo:
        part, path, pages = todo.pop()
        if part.sign == "#":
            if any(f"{path}/".startswith(f"{r}/") for r in regions):
                total += part.chars
                if pages >= max(least, wrapper.pages / 10):
                    fixed |= {(path, k) for k in part.common}
                    size += sum(part.common.values()) * pages
            continue
        if not _boiler_sign(part.sign):
            here = path if part.sign == "()" else f"{path}/{part.sign}"
            todo += [(k, here, k.pages if k.optional else pages) for k in part.kids]
    return Plan(regions, menus, fixed if 2 * size <= total else set())


def _texts(part: Part) -> Iterator[Part]:
    todo = [part]
    while todo:
        x = todo.pop()
        if x.sign == "#":
            yield x
        todo += x.kids


def _matching(root: Node, p: Plan) -> list[tuple[Node, str]]:
    """The page's elements that the plan takes the article from, outermost only, in order."""
    found, todo = [], [(root, "")]
    while todo:
        node, at = todo.pop()
        here = f"{at}/{node.sign}"
        if here in p.regions:
            found.append((node, at))
        elif node is root or not _boiler(node):
            todo += [(k, here) for k in reversed(node.kids) if isinstance(k, Node)]
    return found


def _blocks(node: Node, path: str, p: Plan) -> list[str]:
    """Blocks of text under ``node``, without boilerplate elements, menus and the site's texts."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := squeeze("".join(run)):
            blocks.append(text)
        run.clear()

    todo: list = [(node, path, False, False)]
    while todo:  # without recursion
        item, at, heads, leaving = todo.pop()
        if isinstance(item, str):
            if not heads and not (p.fixed and (at, text_key(squeeze(item))) in p.fixed):
                run.append(item)
            continue
        if item.tag in BLOCKS:
            flush()
        if leaving:
            continue
        if item.tag in ("br", "td", "th"):
            run.append(" ")
        here = f"{at}/{item.sign}"
        if item is not node and _boiler(item):
            if item.tag != "header" or "/article" not in at and "/main" not in at:
                continue
            heads = True  # of an article's header its headings stay
        if here in p.menus:
            continue
        if item.tag in HEADINGS:
            heads = False
        todo.append((item, at, heads, True))
        todo += [(kid, here, heads, False) for kid in reversed(item.kids)]
    flush()
    return blocks


def extract(page: str, p: Plan | None = None) -> str:
    """The article's blocks, joined by an empty line; a page that the host's plan doesn't fit is its own wrapper."""
    root = parse(page)
    for _ in range(2):
        if p is not None:
            found = _matching(root, p)
            if blocks := [b for node, at in found for b in _blocks(node, at, p)]:
                return "\n\n".join(blocks)
        p = plan(as_parts(root), 2)
    found = _matching(root, p)
    return "\n\n".join(b for node, at in found for b in _blocks(node, at, p))


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) -> (host, h, wrapper): every page's own wrapper."""
    for batch in sliced(batches):
        packed = [json.dumps(as_parts(parse(page)).packed(), separators=(",", ":")) for page in batch.column(1).to_pylist()]
        keys = [xxhash.xxh64_intdigest(x) >> 1 for x in packed]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(packed, pa.string())], ["host", "h", "wrapper"])


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for x in frame.sort_values("h", kind="stable")["wrapper"]:
        own = Part.unpacked(json.loads(x))
        whole = own if whole is None else merge(whole, own)
    return pd.DataFrame({"host": frame["host"][:1], "h": frame["part"][:1], "wrapper": [json.dumps(whole.packed(), separators=(",", ":"))]})


def wrappers(pages: DataFrame, url: str = "url", html: str = "html", least: int = 5) -> DataFrame:
    """One wrapper a host: ``host, n_pages, wrapper`` (a union-free regular expression), ``plan`` (``Plan``).

    All different pages of a host take part. Their own wrappers are merged FAN_IN at a time, by their hashes and then by
    the places of the groups, until a host has one; so a host of any size is many tasks, and the outcome doesn't depend on
    where rows lie.
    """
    p = pages.select(url_host(F.col(url)).alias("host"), F.col(html).cast("string").alias("html")).filter("html is not null")
    w = stored(p.mapInArrow(_own, "host string, h long, wrapper string").dropDuplicates(["host", "h"]))
    n = w.groupBy("host").agg(F.count("*").alias("n"))
    hosts, most = n.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(1))).first()
    parts = n.select("host", F.ceil(F.col("n") / FAN_IN).alias("parts"))
    w = w.join(F.broadcast(parts) if hosts <= 100_000 else parts, "host").select("host", "h", "wrapper", F.pmod(F.xxhash64("h"), "parts").alias("part"))
    while True:  # dealt by both, as the join's dealing by host alone would put a hot host into one task
        w = w.repartition("host", "part").groupBy("host", "part").applyInPandas(_merged, "host string, h long, wrapper string")
        most = -(-most // FAN_IN)
        if most <= 1:
            break
        w = stored(w).withColumn("part", F.expr(f"h div {FAN_IN}"))
    return w.mapInArrow(lambda it: _planned(it, least), "host string, n_pages int, wrapper string, plan string")


def _planned(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = [Part.unpacked(json.loads(x)) for x in batch.column(2).to_pylist()]
        own = [pa.array([x.pages for x in whole], pa.int32()), pa.array(map(str, whole), pa.string()), pa.array([plan(x, least).packed() for x in whole], pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *own], ["host", "n_pages", "wrapper", "plan"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        cache: dict[int, Plan] = {}
        texts = []
        plans = batch.column(1).dictionary_encode()
        for k, page in enumerate(batch.column(0).to_pylist()):
            i = plans.indices[k].as_py()
            if i is not None and i not in cache:
                cache[i] = Plan.unpacked(plans.dictionary[i].as_py())
            texts.append(extract(page, cache.get(i)) if page else "")
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[2:], "text", "n_chars"])


def extract_articles(pages: DataFrame, url: str = "url", html: str = "html", least: int = 5, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Main text of every page: all input columns but ``html``, then ``text`` and ``n_chars`` (code points).

    Wrappers are inferred by host from all its pages (``wrappers``); what they say of the article (``plan``) is joined to
    the pages by host. That side is sent to all tasks if its measured size is at most ``broadcast_bytes``, else a
    sort-merge join is asked for, whose hot hosts adaptive execution splits. Each page is then matched: the article is
    what stands in the wrapper's regions, without the site's texts, menus and elements that are by their kind
    navigation, headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments. Blocks keep their
    order, white space within a block is one space, blocks are joined by an empty line. A page where this finds nothing
    (one of another kind than the rest) is its own wrapper.

    Null and empty html give an empty text. A null or odd url has host "" and shares a wrapper with its like.
    Broken markup is mended as browsers do in the common cases; nesting of any depth and any number of siblings are
    read. Repeated rows stay and count once in a wrapper. Input columns named ``text`` or ``n_chars`` are replaced. An
    empty table gives no rows.
    """
    learned = stored(wrappers(pages, url, html, least).select("host", "plan"))
    keep = [c for c in pages.columns if c != html and c.lower() not in ("text", "n_chars")]
    host, known, page = fresh(keep, "host", "plan", "page")
    learned = learned.select(F.col("host").alias(host), F.col("plan").alias(known))
    size = learned.agg(F.coalesce(F.sum(F.length(host) + F.length(known)), F.lit(0)).alias("n")).first().n
    learned = learned.hint("broadcast" if size <= broadcast_bytes else "merge")
    p = pages.withColumn(host, url_host(F.col(url))).join(learned, host, "left").select(F.col(html).cast("string").alias(page), F.col(known), *keep)
    kinds = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep), "text string, n_chars long"])
    return p.mapInArrow(_extracted, kinds)
