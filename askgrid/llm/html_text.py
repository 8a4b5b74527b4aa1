"""Main text of web pages: differencing with the page of the nearest URL, then a check by the markup.

Each page becomes a list of all its text lines, one per block element, furniture included. It is laid
beside the page of the same host whose path is nearest: pages are put in order of host and path, and of
a page's two neighbours the one with more of the path in common is taken. A copy of the page says nothing
about the site, so copies are passed over to the nearest page that differs. Both lists of lines are aligned by a
longest common subsequence, and lines in common, which the site repeats, are deleted.

The check follows. What the markup marks as furniture (navigation, footers, forms, adverts, comments and
so on) goes even if the neighbour has something else there. If the page has an `article` or `main` element, lines
outside it go, and lines in it stay even if the neighbour has them, as near copies of an article do; only lines in
elements whose class is in doubt (`share-price`: a word of furniture beside another) are left to differencing, as all
lines are of a page without an article.

Pages are parsed where they lie; their lines are shuffled once, into ranges of (host, path), so a
host of any size is spread. Tasks read their range in order and hold three pages at a time, and of neighbouring
copies the ids and URLs. Only the first and last copies of each range meet in another table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.llm.ranges import with_sampled_range
from askgrid.session import materialise

# Elements of HTML by what they mean for the text.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr "
    "ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
_SELF_ENDING = frozenset("dd dt li p td th tr".split())
_FURNITURE = frozenset(
    "aside audio button canvas datalist dialog dir embed footer form head label map menu nav object "
    "select svg video".split()
)
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disclaimer disqus footer gdpr masthead menu modal nav navbar navigation "
    "newsletter notice notification pagination paywall popup promo promotion related respond "
    "share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription "
    "toolbar topbar widget".split()
)
_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split()
)
_TOPS = frozenset(["header"])
#: Parts of class names that say nothing by themselves.
_NEUTRAL = frozenset(
    "area article articles bar block body bottom box button buttons container content entry form fixed icons "
    "inner item items left link links list main outer page panel post posts right section site stories text "
    "top wrap wrapper".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.DOTALL,
)
_UNENDED = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")


def _kind(name: str, attributes: str) -> str:
    """`skip`, `top` (a header: skipped outside an article), `doubt` or empty.

    A class or id is furniture as a whole (`ad`, `cookie-notice`, `related-posts`). One that has such a word
    beside others (`share-price`) is in doubt.
    """
    if name in _FURNITURE:
        return "skip"
    kind = "top" if name in _TOPS else ""
    if attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values).lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                return "skip"
            if key == "style" and "display:none" in value.replace(" ", ""):
                return "skip"
            if key == "role" and value in _ROLES:
                return "skip"
            if key in ("class", "id"):
                for token in value.split():
                    words = _WORDS.findall(token)
                    if not _MARKS.isdisjoint(words):
                        if all(w in _MARKS or w in _NEUTRAL for w in words):
                            return "skip"
                        kind = kind or "doubt"
                    if "header" in words:
                        kind = "top"
    return kind


def page_lines(source: str, furniture: bool = False) -> list[tuple[int, str]]:
    """Text lines of a page outside its furniture, each with 1 if inside an article, 2 if there in an element
    in doubt, else 0. With `furniture` also the lines inside it, with 3."""
    lines: list[tuple[int, str]] = []
    text: list[str] = []
    inside, skipped, depth = 0, "", 0  # articles open; element being skipped, and how deep in it
    doubted, within = "", 0  # element in doubt, and how deep in it

    def block_ends() -> None:
        line = " ".join("".join(text).split())
        if line:
            lines.append((3 if skipped else 0 if not inside else 2 if doubted else 1, line))
        text.clear()

    at, end = 0, len(source)
    while at < end:
        found = _TOKEN.search(source, at)
        until = found.start() if found else end
        if until > at and (furniture or not skipped):
            piece = source[at:until] if found else _UNENDED.sub("", source[at:])
            text.append(html.unescape(piece))
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            if found[0].startswith("<![CDATA[") and (furniture or not skipped):
                text.append(found[0][9:].removesuffix("]]>"))
            continue
        closing, attributes = found[1], found[3]
        if not closing and name in _RAW and not attributes.rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            at = close.end() if close else end
            continue
        if skipped:
            ends = name in ("article", "main") and skipped not in ("article", "main")
            if not closing and (ends or (name == "body" and skipped == "head")):
                block_ends()
                skipped = ""  # the skipped element was never closed
            elif name == skipped:
                depth += -1 if closing else 1
                if depth == 0 or name in _BLOCKS:
                    block_ends()
                if depth == 0:
                    skipped = ""
                continue
            else:
                if name in _BLOCKS:
                    block_ends()
                elif name == "br":
                    text.append(" " if furniture else "")
                continue
        if name in ("article", "main"):
            block_ends()
            doubted = ""
            if not closing and _kind(name, attributes) == "skip":
                skipped, depth = name, 1
            else:
                inside = max(0, inside + (-1 if closing else 1))
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in _BLOCKS:
            block_ends()
        if name == doubted:
            within += -1 if closing else 1
            if within == 0 or (not closing and name in _SELF_ENDING):
                block_ends()
                doubted = ""
        if closing or name in _VOID or name in ("body", "html"):
            continue
        kind = _kind(name, attributes)
        if kind == "skip" or (kind == "top" and not inside):
            if not attributes.rstrip().endswith("/"):
                block_ends()
                skipped, depth = name, 1
        elif kind == "doubt" and inside and name in _BLOCKS and not doubted:
            doubted, within = name, 1
    block_ends()
    return lines


def common_lines(mine: list[str], other: list[str]) -> set[int]:
    """Which of `mine` are in a longest common subsequence with `other`.

    Equal starts and ends are cut off; the rest is aligned bit-parallel: one long integer per line
    holds a row of the table.
    """
    start, end = 0, 0
    shorter = min(len(mine), len(other))
    while start < shorter and mine[start] == other[start]:
        start += 1
    while end < shorter - start and mine[-1 - end] == other[-1 - end]:
        end += 1
    shared = set(range(start)) | set(range(len(mine) - end, len(mine)))
    theirs = other[start : len(other) - end]
    known = set(theirs)
    mid = [i for i in range(start, len(mine) - end) if mine[i] in known]
    used = {mine[i] for i in mid}
    theirs = [t for t in theirs if t in used]
    if not mid:
        return shared
    places: dict[str, int] = {}
    for j, line in enumerate(theirs):
        places[line] = places.get(line, 0) | (1 << j)
    full = (1 << len(theirs)) - 1
    row, rows = full, []
    for i in mid:
        rows.append(row)
        step = row & places[mine[i]]
        row = ((row + step) | (row - step)) & full
    # A zero bit j means the subsequence grows with their line j; walk back from the last row.
    j = len(theirs) - 1
    for k in range(len(mid) - 1, -1, -1):
        while j >= 0 and row >> j & 1:
            j -= 1
        if j < 0:
            break
        if rows[k] >> j & 1:  # it didn't grow there before this line
            shared.add(mid[k])
            j -= 1
        row = rows[k]
    return shared


def _common_path(one: str, other: str) -> int:
    """Characters that two paths have in common at their start."""
    n = 0
    for a, b in zip(one, other, strict=False):
        if a != b:
            break
        n += 1
    return n


def _pack(lines: list[tuple[int, str]]) -> str:
    return "\n".join([f"{zone}{line}" for zone, line in lines])


def _partner(page: tuple, neighbours: list[tuple | None]) -> tuple | None:
    """The neighbour of the same host with more of the path in common; the one before on a tie. Copies are none."""
    there = [n for n in neighbours if n is not None and n[1] == page[1] and n[3] != page[3]]
    return max(there, key=lambda n: _common_path(n[2], page[2])) if there else None


def _text(page: tuple, before: tuple | None, after: tuple | None) -> str:
    """Text of a page: (page_id and url, host, path, packed lines)."""
    lines = page[3].split("\n") if page[3] else []
    partner = _partner(page, [before, after])
    shared = common_lines(lines, partner[3].split("\n")) if partner is not None else set()
    return "\n".join([line[1:] for line in checked(lines, shared)])


def checked(lines: list[str], shared: set[int]) -> list[str]:
    """What stays of packed lines of which `shared` are deleted by differencing, after the check by their zones."""
    article = any(line[0] in "12" for line in lines)
    unsure = "2" if article else "0"  # zone that differencing alone decides on
    return [
        line
        for i, line in enumerate(lines)
        if (article and line[0] == "1") or (line[0] == unsure and i not in shared)
    ]


_COLUMNS = ["_range", "page_id", "url", "host", "path", "lines"]


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """For each batch of sorted pages: (place in its range, whether first or last there, page, page before it, page
    after it), where the pages before and after are the nearest that are no copies.

    The place is 1 for the first page of a range and its copies, 2 for the last, 3 for both, else 0; first or last
    is 1, 2 or 3 for one page of these. Neighbours are those in the same range.
    """
    before = None
    run: list[tuple] = []  # pages of a range and host with the same lines

    def closed(after: tuple | None) -> Iterator[tuple]:
        place = (before is None) + 2 * (after is None)
        for i, page in enumerate(run):
            edge = (place & 1) * (i == 0) + (place & 2) * (i + 1 == len(run))
            yield place, edge, page, before, after

    for batch in batches:
        out: list[tuple] = []
        for range_, page_id, url, host, path, lines in batch[_COLUMNS].itertuples(index=False):
            page = ((range_, None if pd.isna(page_id) else page_id, url), host, path, lines)
            if run:
                last = run[-1]
                same = last[0][0] == range_
                if same and last[1] == host and last[3] == lines:
                    # The strings of copies are kept once.
                    url, path = (o if n == o else n for n, o in ((url, last[0][2]), (path, last[2])))
                    run.append(((range_, page[0][1], url), last[1], path, last[3]))
                    continue
                out.extend(closed(page if same else None))
                before = last if same else None
            run = [page]
        yield out
    if run:
        yield list(closed(None))


def _inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of the pages that have both neighbours in their range."""
    for walked in _walk(batches):
        rows = [(*page[0][1:], _text(page, b, a)) for place, _, page, b, a in walked if place == 0]
        yield pd.DataFrame(rows, columns=["page_id", "url", "text"], dtype=object)


def _range_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First and last pages of the ranges and their copies, as they are, with the one neighbour they have there."""
    names = [*_COLUMNS, "part_end", "edge", "near_host", "near_path", "near_lines"]
    for walked in _walk(batches):
        rows = [
            (*page[0], *page[1:], place, edge, *((b or a)[1:] if b or a else (None, None, None)))
            for place, edge, page, b, a in walked
            if place
        ]
        yield pd.DataFrame(rows, columns=names, dtype=object)


def _at_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row in batch.to_dict("records"):
            page = (None, row["host"], row["path"], row["lines"])
            near = [
                (None, row[f"{k}_host"], row[f"{k}_path"], row[f"{k}_lines"])
                if row[f"{k}_host"] is not None else None
                for k in ("before", "near", "after")
            ]
            kind = row["part_end"]
            before = near[0] if kind != 2 else near[1]
            after = near[2] if kind != 1 else near[1]
            page_id = None if pd.isna(row["page_id"]) else row["page_id"]
            out.append((page_id, row["url"], _text(page, before, after)))
        yield pd.DataFrame(out, columns=["page_id", "url", "text"], dtype=object)


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["lines"] = [_pack(page_lines(x or "", furniture=True)) for x in batch.pop("html")]
        yield batch


def _beside(ends: DataFrame) -> DataFrame:
    """Each range with the ranges whose last and first page are the nearest that differ from its own first and last:
    `range_before`, `range_after` (null: none), and whether it is these pages' neighbour there instead (`near_before`,
    `near_after`), since they are copies.

    Three values per range come to the driver, PER_PARTITION ranges for each shuffle partition at most.
    """
    digest = F.sha2(F.concat_ws("\x01", "host", "lines").cast("binary"), 256)
    rows = ends.where("edge > 0").select("_range", "part_end", "edge", digest.alias("digest")).collect()
    first = {r["_range"]: r["digest"] for r in rows if r["edge"] & 1}
    last = {r["_range"]: r["digest"] for r in rows if r["edge"] & 2}
    single = {r["_range"] for r in rows if r["part_end"] == 3}
    there = sorted(first)

    def nearest(order: list[int], mine: dict, theirs: dict) -> dict[int, tuple]:
        found: dict[int, tuple] = {}
        for i, number in enumerate(order):
            other = order[i - 1] if i else None
            if other is None:
                found[number] = (None, False)
            elif theirs[other] != mine[number]:
                found[number] = (other, False)
            else:
                found[number] = found[other] if other in single else (other, True)
        return found

    before, after = nearest(there, first, last), nearest(there[::-1], last, first)
    schema = "_range int, range_before int, near_before boolean, range_after int, near_after boolean"
    return F.broadcast(ends.sparkSession.createDataFrame([(n, *before[n], *after[n]) for n in there], schema))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of `pages` (page_id, url, html).

    Blocks are joined by a line feed; white space within a block is one space. Null or empty pages
    have an empty text. Pages without a host (null URL, no `://`) are neighbours of each other.
    Repeated rows each give a row. Null ids stay null. Empty table: empty result.
    """
    id_type = pages.schema["page_id"].dataType.simpleString()
    host = F.lower(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*(.*)$", 1)
    rows = pages.select(
        "page_id",
        "url",
        F.coalesce(host, F.lit("")).alias("host"),
        F.coalesce(path, F.lit("")).alias("path"),
        "html",
    )
    rows = with_sampled_range(rows, F.concat("host", F.lit("\x01"), "path"), "_range")
    columns = f"_range int, page_id {id_type}, url string, host string, path string, lines string"
    lines = rows.select("_range", "page_id", "url", "host", "path", "html").mapInPandas(_parsed, columns)
    order = ["_range", "host", "path", "page_id", "lines"]
    ordered = lines.repartition("_range").sortWithinPartitions(*order)
    texts = f"page_id {id_type}, url string, text string"
    inside = ordered.mapInPandas(_inside, texts)

    # Two rows per range and their copies, whatever the number of pages.
    near = "part_end int, edge int, near_host string, near_path string, near_lines string"
    ends = ordered.mapInPandas(_range_ends, f"{columns}, {near}")
    ends = materialise(ends, "range_ends")
    placed = ends.join(_beside(ends), "_range")
    for name, edge in (("before", 2), ("after", 1)):
        edges = ends.where(F.col("edge").isin(edge, 3))
        sides = [
            edges.select(
                F.col("_range").alias(f"range_{name}"),
                F.lit(kind).alias(f"near_{name}"),
                *[F.col(f"{start}{c}").alias(f"{name}_{c}") for c in ("host", "path", "lines")],
            )
            for kind, start in ((False, ""), (True, "near_"))
        ]
        placed = placed.join(sides[0].union(sides[1]), [f"range_{name}", f"near_{name}"], "left")
    return inside.union(placed.mapInPandas(_at_ends, texts)).withColumn("n_chars", F.length("text").cast("long"))


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
