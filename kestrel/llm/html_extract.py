"""Main text of web pages by nearest-URL page differencing.

1. Each page is read into lines: a line is the text of a block (inline tags
   join, ``br`` and block tags separate), with character references decoded and
   white space made single. Scripts, styles, comments, forms, navigation,
   headers, footers, sidebars, hidden parts and elements whose role or a whole
   class (outside of articles also id) says notice, advert, comment and the like
   give no lines; ``cookie-notice`` is such a class, as all its parts are such
   words. Where only a part is (``ad-hoc``, ``search-algorithms``), or the id of
   an element inside an article, page differencing decides as for a page without
   article; on headings, paragraphs and inline elements it says nothing. A header
   inside an article stays (it holds the headline). If a page has article (else main)
   elements, only their lines are candidates, else all lines are.
2. Pages of a host are put in order of their URL path, and every page is paired
   with the nearest page on either side that is not (nearly) a copy of it,
   however far away. Nearly a copy: the shared lines hold at least 0.95 of the
   characters of the smaller page. A page next to a copy of it goes on from
   where that copy's search ended, so a run of copies costs one comparison each.
   If a page has no such partner on either side of the whole host, pages of
   another path count that are nearly copies but, like it, hold a line whose
   words are not those of a line of the other: short texts in a long template.
3. The lines of a pair are aligned by longest common subsequence, and lines that
   they share are deleted: template text. Inside an explicit article, where
   passages recur between articles, a line goes only if both partners share it,
   more than half of the pages of the host share it with a partner, and it is no
   heading and no long paragraph (fewer than 30 words).
   With partners that are nearly copies, a line goes only if all of them share it.

Only hashes of lines are put in order and compared, in blocks of consecutive
pages. A search that comes to the edge of its block goes on among the ends of
blocks: of every block its first and last page with the partners of these, 64
blocks in a block of the next level, until one block is left. So a host of any
size spreads over all tasks. A partner that shares no line is passed over inside
a block; beyond its edge the partner of the block's outermost page is taken.
How many pages of a host share a
line is a count by host and line hash, combined map-side; its result meets the
doubtful lines by a salted join, as one line may be on a third of all pages.
The deletions (page key and line
numbers) are joined back to the pages; the planner broadcasts them when small.
A page row is known by page_id and a hash of url and html, so null or repeated
ids do no harm and repeated rows get the same text. Null or empty html gives an
empty text; a null url belongs to the host without name.
"""

from __future__ import annotations

import html as entities
import pickle
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.llm.common import bounded_batches, materialize

BLOCK, ENDS = 256, 64  # pages of a block; blocks of which the ends make a block of the next level
SAME_PAGE = 0.95
LONG = 30  # words of a paragraph that stays in an article though shared
SALTS = 16  # parts of the rows of one line of a host
PLAIN, INNER, FIRM = 0, 1, 2  # candidate line, or one of a doubtful element; other one in an article; heading or long paragraph in an article

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>",
    re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[^\W\d_]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template svg math iframe object canvas textarea title xmp audio video".split())
_CLOSED_BY_NEXT = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
                   "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                            "header hr main menu nav ol p pre section table ul".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                    "small span strike strong sub sup time tt u var wbr".split())
_FRAME = frozenset("nav aside form dialog menu footer select button fieldset head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
# Words of a class or id that mark what is not the article.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar widget "
    "widgets related recommended breadcrumb breadcrumbs menu nav navbar navigation topbar toolbar pagination pager footer "
    "masthead comment comments commentlist respond reply replies disqus share sharing social search skip hidden".split())
_HEADER_MARKS = frozenset(("header", "topbar", "masthead"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

Line = tuple[str, int]


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


STAYS, DOUBTFUL, FRAME = range(3)


def _standing(name: str, attributes: dict[str, str], inside: bool) -> int:
    """Whether an element is no part of the article, whatever it holds (FRAME), or page differencing decides (DOUBTFUL)."""
    if name in _FRAME or name == "header" and not inside:
        return FRAME
    if name in ("html", "body"):
        return STAYS
    if ("hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
            or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I)
            or attributes.get("role", "").lower() in _ROLES):
        return FRAME
    classes, ids = attributes.get("class", "").lower().split(), attributes.get("id", "").lower().split()
    if name in ("article", "main"):
        return STAYS if _MARKS.isdisjoint(classes + ids) else FRAME
    text = name in _HEADINGS or name == "p" or name in _INLINE
    parts = {n: {p for p in re.split(r"[-_]+", n) if p} for n in (classes if text else classes + ids)}
    if any(parts[n] and parts[n] <= _MARKS for n in (classes if text or inside else parts)):
        return FRAME
    if text:
        return STAYS
    if not inside and any(not p.isdisjoint(_HEADER_MARKS) for p in parts.values()):
        return FRAME
    return DOUBTFUL if any(not p.isdisjoint(_MARKS) for p in parts.values()) else STAYS


def page_lines(page: str | None) -> list[Line]:
    """Candidate lines of a page with their kind."""
    page = page or ""
    open_names: list[str] = []
    frames: list[int] = []      # depths at which a frame element opened
    doubtful: list[int] = []    # depths at which a doubtful element opened
    regions: dict[str, list[int]] = {"article": [], "main": []}
    parts: list[str] = []
    every: list[tuple[str, bool, bool, bool, bool]] = []  # text, in article, in main, doubtful, heading

    def end_line() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                every.append((text, bool(regions["article"]), bool(regions["main"]), bool(doubtful),
                              any(n in _HEADINGS for n in open_names[-4:])))

    def close(depth: int) -> None:
        """Close all elements from that depth on."""
        while len(open_names) > depth:
            name = open_names[-1]
            if name not in _INLINE:
                end_line()  # while a heading is still open
            open_names.pop()
            at = len(open_names)
            if frames and frames[-1] == at:
                frames.pop()
            if doubtful and doubtful[-1] == at:
                doubtful.pop()
            if name in regions and regions[name] and regions[name][-1] == at:
                regions[name].pop()

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if not frames:
            parts.append(page[at:m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name == "br" or name == "p" and "p" not in open_names:
                if not frames:
                    end_line()
            elif name in open_names:
                close(len(open_names) - 1 - open_names[::-1].index(name))
            continue
        if name in _RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if name in _ENDS_PARAGRAPH and "p" in open_names:
            where = len(open_names) - 1 - open_names[::-1].index("p")
            if not any(n in ("table", "td", "button") for n in open_names[where:]):
                close(where)
        if name in _CLOSED_BY_NEXT and open_names and open_names[-1] in _CLOSED_BY_NEXT[name]:
            close(len(open_names) - 1)
        if name not in _INLINE and not frames:
            end_line()
        if name in _VOID:
            continue
        text = m[3] or m[6] or ""
        if text.endswith("/") and name in ("svg", "math"):
            continue
        inside = bool(regions["article"] or regions["main"])
        attributes = _attributes(text) if len(text) > 1 else {}
        if not frames and (standing := _standing(name, attributes, inside)) != STAYS:
            end_line()
            (frames if standing == FRAME else doubtful).append(len(open_names))
        if not frames:
            if name in regions:
                regions[name].append(len(open_names))
            elif attributes.get("role", "").lower() in regions or attributes.get("itemprop", "").lower() == "articlebody":
                regions["article"].append(len(open_names))
        open_names.append(name)
    end_line()
    for k in (1, 2):  # article elements, else main
        if any(line[k] for line in every):
            return [(t, PLAIN if doubt else FIRM if heading or _is_long(t) else INNER)
                    for t, *where, doubt, heading in every if where[k - 1]]
    return [(t, PLAIN) for t, *_ in every]


def _is_long(text: str) -> bool:
    return text.count(" ") >= LONG - 1


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    places = defaultdict(list)
    for j in range(len(b) - 1, -1, -1):
        places[b[j]].append(j)
    ends: list[int] = []      # smallest last place in b of a common subsequence of each length
    nodes: list[tuple] = []
    for i, x in enumerate(a):
        for j in places.get(x, ()):  # from the last to the first, so a line is used once
            k = bisect_left(ends, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                nodes.append(node)
            else:
                ends[k], nodes[k] = j, node
    out, node = [], nodes[-1] if nodes else None
    while node:
        out.append(node[0])
        node = node[1]
    return out[::-1]


COPY, SIMILAR, OTHER, APART = range(4)  # (nearly) the same; that, but with own text; sharing lines; sharing none


@dataclass
class Page:
    host: str
    path: str
    lines: list[int]
    sizes: list[int]
    kinds: list[int]
    words: list[tuple[int, ...]]  # smallest word hashes of each line

    def __post_init__(self):
        self.known, self.total = frozenset(self.lines), sum(self.sizes)


def line_words(text: str) -> tuple[int, ...]:
    """The 4 smallest hashes of the words of a line; digits do not count."""
    return tuple(sorted({zlib.crc32(w.encode()) for w in _WORD.findall(text.lower())})[:4])


def _own_text(a: list[tuple[int, ...]], b: list[tuple[int, ...]]) -> bool:
    """Whether a line of ``a`` has other words than every line of ``b``."""
    return any(x and all(y and 2 * len({*x} & {*y}) < min(len(x), len(y)) for y in b) for x in a)


def compare(a: Page, b: Page) -> tuple[int, list[int]]:
    """How ``b`` relates to ``a``, and the places of shared lines in ``a``."""
    if a.lines == b.lines:
        return COPY, []
    if a.known.isdisjoint(b.known):
        return APART, []
    shared = common_lines(a.lines, b.lines)
    if sum(a.sizes[x] for x in shared) < SAME_PAGE * min(a.total, b.total):
        return OTHER, shared
    if a.path != b.path:
        places, left = set(shared), Counter(a.lines[x] for x in shared)
        mine = [w for x, w in enumerate(a.words) if x not in places]
        theirs = []
        for h, w in zip(b.lines, b.words, strict=True):
            if left[h]:
                left[h] -= 1
            else:
                theirs.append(w)
        if mine and theirs and _own_text(mine, theirs) and _own_text(theirs, mine):
            return SIMILAR, shared
    return COPY, shared


def partners(pages: list[Page], step: int) -> list[tuple[int | None, int | None, bool]]:
    """For each page of an ordered run, going by ``step``: the nearest page that is no near copy, the nearest similar
    one before it, and whether the search came to the edge of the run."""
    out: list[tuple[int | None, int | None, bool]] = [(None, None, False)] * len(pages)
    for i in range(len(pages)) if step < 0 else range(len(pages) - 1, -1, -1):
        other = similar = None
        j, edge = i + step, False
        while True:
            if not 0 <= j < len(pages):
                edge = True
                break
            if pages[j].host != pages[i].host:
                break
            relation = compare(pages[i], pages[j])[0]
            if relation == OTHER:
                other = j
                break
            if relation == APART:
                j += step
                continue
            if similar is None and relation == SIMILAR:
                similar = j
            beyond, alike, edge = out[j]
            if similar is None and alike is not None and compare(pages[i], pages[alike])[0] == SIMILAR:
                similar = alike
            if beyond is None:
                break
            j, edge = beyond, False
        out[i] = other, similar, edge
    return out


def shared_lines(page: Page, found: list[Page]) -> tuple[list[int], list[int], list[int]]:
    """Of a page with its partners (other or similar pages): the lines that go, those in its article that go if most
    pages of the host share them, and all those in its article that a partner shares."""
    pairs = [compare(page, f) for f in found]
    sets = [set(shared) for relation, shared in pairs if relation == OTHER]
    if sets:
        both = set.intersection(*sets) if len(sets) == 2 else set()
        some = set.union(*sets)
    else:
        sets = [set(shared) for relation, shared in pairs if relation == SIMILAR]
        some = set.intersection(*sets) if sets else set()
        both = some if len(sets) == 2 else set()
    inner = [x for x in sorted(some) if page.kinds[x] == INNER]
    return [x for x in sorted(some) if page.kinds[x] == PLAIN], [x for x in inner if x in both], inner


# What is known of the shared lines of a page: numbers of lines that go, numbers and hashes of doubtful ones, hashes that count.
_SHARED = "host string, gone array<int>, doubt array<int>, doubt_hash array<long>, counted array<long>"


def _shared_row(page: Page, found: list[Page]) -> tuple | None:
    gone, doubt, inner = shared_lines(page, found)
    if not gone and not inner:
        return None
    return page.host, gone, doubt, [_signed(page.lines[x]) for x in doubt], sorted({_signed(page.lines[x]) for x in inner})


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def url_key(url: str | None) -> tuple[str, str]:
    """Host and path by which pages are put in order."""
    try:
        parts = urlsplit((url or "").strip())
        return (parts.hostname or "").removeprefix("www."), parts.path.rstrip("/")
    except ValueError:
        return "", url or ""


def _outline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for url, page in zip(batch["url"], batch["html"], strict=True):
            lines, (host, path) = page_lines(page), url_key(url)
            rows.append((host, path, pickle.dumps((
                host, path, [xxhash.xxh64_intdigest(t) for t, _ in lines], [len(t) for t, _ in lines],
                [k for _, k in lines], [line_words(t) for t, _ in lines])) if lines else None))
        yield pd.concat([batch[["page_id", "key"]].reset_index(drop=True),
                         pd.DataFrame(rows, columns=["host", "path", "page"])], axis=1)


def _read(packed: bytes) -> Page:
    return Page(*pickle.loads(packed))


def _ends(pages: list[Page], left: list[tuple], right: list[tuple]) -> list[int]:
    """Places of the first and the last page and of the partners that these have inside the run."""
    return sorted({0, len(pages) - 1, *(x for x in (*right[0][:2], *left[-1][:2]) if x is not None)})


# Of a block: rows to keep as its ends (role ``end``), and what a search found (role ``found``; open: it goes on beyond the block).
_FOUND = ("role string, block long, part long, side int, pos long, page binary, other binary, similar binary, open boolean")


def _first_level(kind: str):
    """Schema and function: the deletions of a block's pages, the searches that leave it, and its ends."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos").reset_index(drop=True)
        packed = rows["page"].tolist()
        pages = [_read(p) for p in packed]
        left, right = partners(pages, -1), partners(pages, 1)
        out = []
        for i, page in enumerate(pages):
            own = [(side, x) for side in (left[i], right[i]) for x in side[:2] if x is not None]
            if left[i][2] or right[i][2]:
                out.append(("page", i, *no_lines, packed[i], pickle.dumps([packed[x] for _, x in own]), left[i][2], right[i][2]))
            elif shared := _shared_row(page, [pages[x] for _, x in own]):
                out.append(("gone", i, *shared, None, None, False, False))
        out += [("end", i, *no_lines, packed[i], None, False, False) for i in _ends(pages, left, right)]
        got = pd.DataFrame(out, columns=["role", "row", *lines, "page", "near", "to_left", "to_right"])
        got[lines] = got[lines].astype(object)
        return pd.concat([rows.loc[got["row"], ["page_id", "key", "block", "pos"]].reset_index(drop=True),
                          got.drop(columns="row")], axis=1)[_names(schema)]

    lines = _names(_SHARED)
    no_lines = [None] * len(lines)
    schema = (f"role string, page_id {kind}, key long, block long, pos long, {_SHARED}, page binary, near binary, "
              "to_left boolean, to_right boolean")
    return run, schema


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _next_level(rows: pd.DataFrame) -> pd.DataFrame:
    """Ends of ``ENDS`` blocks (``part``): what the first page of each finds to the left and the last to the right."""
    rows = rows.sort_values(["part", "pos"])
    block, parts, packed, pos = int(rows["block"].iloc[0]), rows["part"].tolist(), rows["page"].tolist(), rows["pos"].tolist()
    pages = [_read(p) for p in packed]
    left, right = partners(pages, -1), partners(pages, 1)
    out = []
    for i, part in enumerate(parts):
        for side, found, outer in ((-1, left, i - 1), (1, right, i + 1)):
            if not 0 <= outer < len(parts) or parts[outer] != part:
                other, similar, edge = found[i]
                out.append(("found", block, part, side, pos[i], None, None if other is None else packed[other],
                            None if similar is None else packed[similar], edge))
    out += [("end", block, part, 0, pos[i], packed[i], None, None, False)
            for i in _ends(pages, left, right) for part in (parts[i],)]
    return pd.DataFrame(out, columns=_names(_FOUND))


def _gone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shared lines of pages whose search left their block."""
    for batch in batches:
        rows, names = [], _names(_SHARED)
        for page, near, *far in zip(*(batch[c] for c in ("page", "near", "other_l", "similar_l", "other_r", "similar_r")), strict=True):
            found = [_read(p) for p in (*pickle.loads(near), *far) if p is not None]
            rows.append(_shared_row(_read(page), found) or (None,) * len(names))
        yield pd.concat([batch[["page_id", "key"]].reset_index(drop=True),
                         pd.DataFrame(rows, columns=names).astype(object)], axis=1)


def _far_partners(ends: DataFrame, blocks: int) -> DataFrame:
    """part (block of the first level), side, other, similar: partners beyond the edges of the blocks."""
    levels = []
    while True:
        blocks = -(-blocks // ENDS)
        level = materialize(ends.withColumn("block", F.floor(F.col("part") / ENDS)).groupBy("block").applyInPandas(
            _next_level, _FOUND), "block-ends")
        levels.append(level.filter("role = 'found'").select("block", "part", "side", "other", "similar", "open"))
        if blocks <= 1:
            break
        ends = level.filter("role = 'end'").select(F.col("block").alias("part"), "pos", "page")
    found = levels.pop()
    while levels:
        up = found.select(F.col("part").alias("up_part"), F.col("side").alias("up_side"), F.col("other").alias("up_other"),
                          F.col("similar").alias("up_similar"))
        low = levels.pop()
        same = F.col("open") & (F.col("block") == F.col("up_part")) & (F.col("side") == F.col("up_side"))
        found = low.join(up, same, "left").select("part", "side", F.coalesce("other", "up_other").alias("other"),
                                                  F.coalesce("similar", "up_similar").alias("similar"))
    return found.select("part", "side", "other", "similar")


def deletions(shared: DataFrame, hosts: DataFrame) -> DataFrame:
    """page_id, key, gone: of ``shared`` (page_id, key and ``_SHARED``) the lines that go for certain and the doubtful
    ones that more than half of the pages of the host share; ``hosts``: host, n_pages."""
    pages = shared.select("host", F.explode("counted").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n"))
    salted = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    usual = pages.join(hosts, "host").filter(2 * F.col("n") > F.col("n_pages")).select("host", "hash", salted.alias("salt"))
    doubt = shared.select("page_id", "key", "host", F.pmod(F.xxhash64("page_id", "key"), F.lit(SALTS)).cast("int").alias("salt"),
                          F.explode(F.arrays_zip("doubt", "doubt_hash")).alias("line"))
    doubt = doubt.select("page_id", "key", "host", "salt", F.col("line.doubt").alias("gone"), F.col("line.doubt_hash").alias("hash"))
    lines = doubt.join(usual, ["host", "hash", "salt"], "left_semi").select("page_id", "key", "gone")
    certain = shared.select("page_id", "key", F.explode("gone").alias("gone"))
    return certain.unionByName(lines).groupBy("page_id", "key").agg(F.collect_list("gone").alias("gone"))


def find_deletions(rows: DataFrame) -> DataFrame:
    """page_id, key, gone (line numbers) of the pages of which shared lines go."""
    kind = rows.schema["page_id"].dataType.simpleString()
    order = ["host", "path", "page_id", "key"]
    outline = rows.mapInPandas(_outline, f"page_id {kind}, key long, host string, path string, page binary").filter(
        "page IS NOT NULL").dropDuplicates(["page_id", "key"])
    placed = materialize(
        outline.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("slice", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()), "page-order")
    # One row per slice, that is at most spark.sql.shuffle.partitions rows.
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = materialize(placed.groupBy("slice").agg(F.count("*").alias("n"), F.min("nth").alias("least")).select(
        "slice", "least", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "page-slices")
    blocks = -(-(slices.agg(F.sum("n")).first()[0] or 0) // BLOCK)
    placed = placed.join(F.broadcast(slices), "slice").withColumn("pos", F.col("before") + F.col("nth") - F.col("least"))
    run, schema = _first_level(kind)
    near = materialize(placed.select("page_id", "key", "pos", "page", F.floor(F.col("pos") / BLOCK).alias("block"))
                       .groupBy("block").applyInPandas(run, schema), "block-partners")
    names = ["page_id", "key", *_names(_SHARED)]
    shared = near.filter("role = 'gone'").select(names)
    far = _far_partners(near.filter("role = 'end'").select(F.col("block").alias("part"), "pos", "page"), blocks)
    far = materialize(far, "far-partners")
    left, right = (far.filter(F.col("side") == side).select(F.col("part").alias(f"part_{n}"), F.col("other").alias(f"other_{n}"),
                                                            F.col("similar").alias(f"similar_{n}"))
                   for side, n in ((-1, "l"), (1, "r")))
    at_edge = near.filter("role = 'page'")
    at_edge = at_edge.join(left, F.col("to_left") & (F.col("block") == F.col("part_l")), "left").join(
        right, F.col("to_right") & (F.col("block") == F.col("part_r")), "left")
    beyond = at_edge.select("page_id", "key", "page", "near", "other_l", "similar_l", "other_r", "similar_r").mapInPandas(
        _gone, f"page_id {kind}, key long, {_SHARED}").filter("host IS NOT NULL")
    shared = materialize(shared.unionByName(beyond), "shared-lines")
    return deletions(shared, placed.groupBy("host").agg(F.count("*").alias("n_pages")))


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = []
        for page, gone in zip(batch["html"], batch["gone"], strict=True):
            gone = set() if gone is None else set(gone.tolist())
            texts.append("\n".join(t for k, (t, _) in enumerate(page_lines(page)) if k not in gone))
        out = batch[["page_id", "url"]].assign(text=texts)
        yield out.assign(n_chars=[len(t) for t in texts])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages(page_id, url, html)``."""
    bounded_batches()
    rows = pages.select("page_id", "url", "html", F.xxhash64("url", "html").alias("key"))
    gone = materialize(find_deletions(rows), "deletions")
    same = rows["page_id"].eqNullSafe(gone["page_id"]) & (rows["key"] == gone["key"])
    kind = pages.schema["page_id"].dataType.simpleString()
    return (rows.join(gone, same, "left").select(rows["page_id"], "url", "html", "gone")
            .mapInPandas(_extract, f"page_id {kind}, url string, text string, n_chars long"))
