"""Main text of web pages by nearest-URL page differencing.

A page is split into lines, the runs of text between block tags.  Within each host pages are put in order of their URL's
path, so the pages before and after are the nearest by URL.  A run is a longest sequence of such pages each of which is a copy
of the one before; the neighbours of a page are the first page of the next run and the last of the run before, whatever the
length of its own.  All lines of a page and of the nearest neighbour that isn't a copy of it are aligned twice by a longest
common subsequence, as they are and as templates (a line that is all links is a link, numbers and the host's name are
placeholders):

* lines that both have are furniture of the site and deleted, and so is the rest of an element most of whose lines were (a menu
  with one entry of its own);
* an element whose lines are mostly alike as templates, and mostly links or shared, is furniture too if it has no text of its own
  (a menu of other entries, a basket with a count); texts that differ in a number only are not.

Markup settles what the alignment leaves open: a shared line inside an article or main element stays (pages quote the same
passages), and furniture that differs from page to page, or stands on a page without a neighbour, goes by its element or
class: menus, headers, footers, sidebars, notices, adverts, forms and comments.  Class names count as a whole, or if all
their parts are names of furniture or of places (``site-footer``, not ``ad-free``).

Pages in URL order over all hosts are dealt to blocks of about equal bytes, so a large host is spread over many tasks.  A first
pass over the ends of blocks, and over those blocks that share a run, finds where runs begin and from it the page before and the
page after that each block needs as guests, so the text of a page doesn't depend on the blocks.  Then the lines of the pages are shuffled, once, and a task
streams through its block.

Defined cases: a null html or url is empty; hosts and paths are lower-cased and lose query and fragment; pages of the same
path are ordered by page_id, then by a hash of the html, so only equal rows are in no order; equal rows are copies and stay in
one block; an unclosed element ends with the page, a void or raw one at once; a neighbour that holds nearly all that may be text
of the page (a copy of it) says nothing about furniture; columns other than page_id, url and html, whatever their names, are
not looked at; an empty neighbour isn't asked; a page is parsed whole, whatever its length; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import forget, longs, numbered, table
from .textvec import slices

# fixed values: elements by what they mean for the text
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select option canvas video audio".split())
OUT = frozenset("head nav header footer aside form menu button dialog".split())
IN = frozenset("article main".split())
#: Names in a class, id or role that mark what is not the article, and words that say where something is.
MARKS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside banner cookie cookies notice consent newsletter subscribe ad ads advert advertisement advertising sponsored promo popup modal social share sharing related recommended comment comments reply replies discussion respond complementary contentinfo search login signup".split())
PLACES = frozenset("site page main global primary secondary top bottom left right upper lower head foot side bar box block area section list wrapper container inner outer item items form link links button buttons widget".split())
#: Elements that hold one line of something rather than a group of lines.
LEAVES = frozenset("p li dt dd tr td th h1 h2 h3 h4 h5 h6".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_MARKED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none", re.I)
_PART = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"\d+(?:[.,:/-]\d+)*")
#: From this share of its text on that a neighbour has as well, the page is a copy; of an element's lines, it is furniture.
COPY, MOST = 0.8, 0.5

#: Bytes of html in a block, blocks at most, pages in a block at least; the keys at their ends are all that the driver knows.
BLOCK_BYTES, MOST_BLOCKS, LEAST_BLOCK = 16 << 20, 16_384, 64
KEPT, ASKED, GONE = 1, 0, -1


def _left_out(tag: str, attributes: str) -> bool:
    if tag in OUT:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    if _HIDDEN.search(attributes):
        return True
    for m in _MARKED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = _PART.findall(name)
            if MARKS.intersection(parts) and all(x in MARKS or x in PLACES for x in parts):
                return True
    return False


def lines_of(html: str) -> list[tuple[int, int, str]]:
    """(KEPT, ASKED or GONE by the markup; the element it stands in; line) in page order."""
    return [x[:3] for x in parsed(html)]


def parsed(html: str) -> list[tuple[int, int, str, bool]]:
    """The lines of a page with a mark on those that are all links."""
    lines: list[tuple[int, int, str, bool]] = []
    run: list[str] = []
    anchors, bare = 0, False  # open links; whether the run has text outside of links
    stack: list[tuple[str, bool, bool, int]] = []  # tag, is left out, is kept, number
    out = kept = False
    number = 0
    at = 0

    def flush() -> None:
        nonlocal bare
        if run:
            line = " ".join(unescape("".join(run)).split())
            if line:
                group = next((x[3] for x in reversed(stack) if x[0] not in LEAVES and x[0] not in INLINE), 0)
                lines.append((GONE if out else KEPT if kept else ASKED, group, line, not bare))
            run.clear()
            bare = False

    def add(text: str) -> None:
        nonlocal bare
        run.append(text)
        bare = bare or not anchors and not text.isspace()

    def reset() -> None:
        nonlocal out, kept
        out, kept = any(x[1] for x in stack), any(x[2] for x in stack)

    while at < len(html):
        m = _TAG.search(html, at)
        if not m:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            flush()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if any(x not in INLINE or gone or stays for x, gone, stays, _ in stack[i:]):
                        flush()
                    anchors -= sum(x[0] == "a" for x in stack[i:])
                    del stack[i:]
                    reset()
                    break
        elif tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\s*[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            gone, stays = _left_out(tag, m[3]) and not (kept and tag == "header"), tag in IN
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == tag and not gone:
                continue  # the one before ends here
            if gone or stays:
                flush()
            number += 1
            stack.append((tag, gone, stays, number))
            anchors += tag == "a"
            out, kept = out or gone, kept or stays
    flush()
    return lines


def common(a: list[str], b: list[str]) -> np.ndarray:
    """Which lines of ``a`` are in a longest common subsequence with ``b``."""
    shared = np.zeros(len(a), bool)
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        shared[lo] = True
        lo += 1
    ea, eb = len(a), len(b)
    while ea > lo and eb > lo and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
        shared[ea] = True
    in_b = set(b[lo:eb])
    rows = [i for i in range(lo, ea) if a[i] in in_b]
    in_a = {a[i] for i in rows}
    cols = [j for j in range(lo, eb) if b[j] in in_a]
    if not rows:
        return shared
    # Hunt and Szymanski: a longest increasing chain of matches, in n log n steps for each match
    places: dict[str, list[int]] = {}
    for j in cols:
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list[tuple[int, tuple | None]] = []
    for i in rows:
        for j in reversed(places[a[i]]):
            k = bisect_left(ends, j)
            node = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(node)
            else:
                ends[k], links[k] = j, node
    node = links[-1] if links else None
    while node:
        shared[node[0]] = True
        node = node[1]
    return shared


def digests(page: list[tuple[int, int, str, bool]]) -> tuple[list[int], list[int]]:
    """(hash of each line, its length where it may be text of the page, else 0; all count on a page without such lines)."""
    text = any(kind != GONE for kind, *_ in page)
    return [xxhash.xxh32_intdigest(x[2]) for x in page], [len(x[2]) if x[0] != GONE or not text else 0 for x in page]


def is_copy(own: tuple[list[int], list[int]], theirs: tuple[list[int], list[int]]) -> bool:
    """Whether the neighbour has most of what may be text of the page."""
    there = set(theirs[0])
    return sum(n for h, n in zip(*own, strict=True) if h in there) >= COPY * sum(own[1])


def alike(own: list[tuple[int, int, str, bool]], theirs: list[tuple[int, int, str, bool]], host: str) -> np.ndarray:
    """Which lines are in a longest common subsequence of templates; equal ones in a row (the links of a menu) count once.

    Lines that the markup keeps are their own templates.
    """

    def templates(page: list[tuple[int, int, str, bool]]) -> list[tuple[str, int]]:
        bare = lambda line: _NUMBER.sub("0", line.replace(host, "\x1e") if host else line)
        all_of = (line if kind == KEPT else "\x1f" if linked else bare(line) for kind, _, line, linked in page)
        return [(t, sum(1 for _ in same)) for t, same in groupby(all_of)]

    mine = templates(own)
    return np.repeat(common([t for t, _ in mine], [t for t, _ in templates(theirs)]), [n for _, n in mine])


def furniture(own: list[tuple[int, int, str, bool]], theirs: list[tuple[int, int, str, bool]], host: str = "") -> np.ndarray:
    """The lines that the alignment with a neighbour deletes."""
    if not own:
        return np.zeros(0, bool)
    same = common([line for _, _, line, _ in own], [line for _, _, line, _ in theirs])
    like = same | alike(own, theirs, host)
    _, at = np.unique(np.array([group for _, group, _, _ in own], np.int64), return_inverse=True)
    lines = np.bincount(at)
    known = same | np.array([linked for *_, linked in own], bool)
    listed = (np.bincount(at, known) > MOST * lines) & (np.bincount(at, ~like & ~known) == 0)
    whole = (np.bincount(at, same) >= MOST * lines) | (np.bincount(at, like) >= MOST * lines) & listed
    return same | whole[at]


def main_text(own: list[tuple[int, int, str, bool]], gone: np.ndarray) -> str:
    """The page's text: what the alignment doesn't delete, as far as the markup agrees."""
    return " ".join(line for (kind, _, line, _), twice in zip(own, gone.tolist(), strict=True) if kind == KEPT or kind == ASKED and not twice)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, to in slices(b.column(4), 8 << 20):
            pages = [parsed(h or "") for h in b.column(4)[lo:to].to_pylist()]
            kinds = pa.array([[k + 4 * linked for k, _, _, linked in p] for p in pages], pa.list_(pa.int8()))
            groups = pa.array([[g for _, g, _, _ in p] for p in pages], pa.list_(pa.int32()))
            lines = pa.array([[x for _, _, x, _ in p] for p in pages], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*[b.column(i)[lo:to] for i in range(4)], kinds, groups, lines], ["page_id", "url", "key", "near", "kinds", "groups", "lines"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, to in slices(b.column(3), 8 << 20):
            pages = [digests(parsed(h or "")) for h in b.column(3)[lo:to].to_pylist()]
            hashes, sizes = (pa.array([p[i] for p in pages], pa.list_(t)) for i, t in enumerate((pa.int64(), pa.int32())))
            yield pa.RecordBatch.from_arrays([*[b.column(i)[lo:to] for i in range(3)], hashes, sizes], ["key", "host", "near", "hashes", "sizes"])


def _run_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block: whether its first page begins a run, the first page that does, and the page before the last one that
    does (both null where the host changes there); no row for a block in which none begins.  Rows come in order; the page
    before the block is its guest."""
    before: dict | None = None
    found: dict[int, list] = {}
    for b in batches:
        for row in b.to_pylist():
            row["digests"] = row.pop("hashes"), row.pop("sizes")
            near = before if before and before["block"] == row["block"] and before["host"] == row["host"] else None
            if not row["guest"] and not (near and is_copy(row["digests"], near["digests"])):
                at_start = not before or before["block"] != row["block"] or before["guest"]
                found.setdefault(row["block"], [at_start, near and row["key"], None])[2] = near and near["key"]
            before = row
    columns = [pa.array([x[i] for x in found.values()], t) for i, t in enumerate((pa.bool_(), pa.string(), pa.string()))]
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), *columns], ["block", "at_start", "first", "before_last"])


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of block and key.  A run is held until the next begins; guests are runs by themselves."""
    kind = pa.int64()
    runs: list[list[dict]] = [[], []]  # the run before (its last page) and the present one
    done: list[tuple] = []

    def finish(after: dict | None) -> None:
        for row in runs[1]:
            if row["guest"]:
                continue
            near = [x for x in (after, *runs[0]) if x and x["page"] and x["block"] == row["block"] and x["host"] == row["host"] and not is_copy(row["digests"], x["digests"])]
            gone = furniture(row["page"], near[0]["page"], row["host"]) if near else np.zeros(len(row["page"]), bool)
            text = main_text(row["page"], gone)
            done.append((row["page_id"], row["url"], text, len(text)))
        runs[:] = runs[1][-1:], [after] if after else []

    def out() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [[]] * 4
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "url", "text", "n_chars"])

    for b in batches:
        kind = b.schema.field("page_id").type
        for row in b.to_pylist():
            marks = row.pop("kinds")
            row["page"] = [((m + 1) % 4 - 1, g, x, m > 1) for m, g, x in zip(marks, row.pop("groups"), row.pop("lines"), strict=True)]
            row["digests"] = digests(row["page"])
            last = runs[1][-1] if runs[1] else None
            if last and all(row[c] == last[c] for c in ("block", "host", "guest")) and is_copy(row["digests"], last["digests"]):
                runs[1].append(row)
            else:
                finish(row)
        yield out()
    finish(None)
    yield out()


def url_key() -> Column:
    """Pages in this order are in order of host, path, id and html."""
    page_id, html = F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.hex(F.xxhash64("html"))
    key = F.concat_ws("\x01", host(F.col("url")), path(F.col("url")), F.lpad(page_id, 20, "0"), html)
    return F.translate(key, "\x1e", " ")


def _strings(values: list[str]) -> Column:
    return F.split(F.lit("\x1e".join(values)), "\x1e") if values else F.array().cast("array<string>")


def guests(runs: list, lasts: list[str]) -> list[tuple[str, int]]:
    """(key of a page, block that needs it): the last page of the run before a block's first run, the first of the one after its last.

    ``runs`` has (block, at_start, first, before_last) of the blocks in which runs begin, ``lasts`` the last key of each block.
    """
    begins = {r["block"]: r for r in runs}
    needed: list[tuple[str, int]] = []
    open_run: str | None = None  # the page before the run that is open at the end of the block
    for block in range(len(lasts)):
        if block and block in begins and begins[block]["at_start"]:
            open_run = lasts[block - 1] if begins[block]["first"] else None
        if block and open_run:
            needed.append((open_run, block))
        if block in begins:
            open_run = begins[block]["before_last"]
    after: str | None = None
    for block in reversed(range(len(lasts))):
        if after:
            needed.append((after, block))
        if block in begins:
            after = begins[block]["first"]
    return needed


def _at(block: Column, guest: bool) -> Column:
    return F.struct(block.cast("int").alias("block"), F.lit(guest).alias("guest"))


def _runs(rows: DataFrame, firsts: list[str], lasts: list[str]) -> list:
    """What ``guests`` needs.  The pages at the ends of blocks tell which blocks a run goes on into; these and the blocks before
    them are looked through for where their runs begin, since for others their ends are all that matters."""
    block, key, n = F.col("block"), F.col("key"), len(firsts)
    is_last = (block < n - 1) & (key == F.get(_strings(lasts), block))

    def starts(own: Column) -> list:
        near = F.array_compact(F.array(F.when(own, _at(block, False)), F.when(is_last, _at(block + 1, True))))
        parts = rows.where(own | is_last).select("key", host(F.col("url")).alias("host"), near.alias("near"), "html")
        parts = parts.mapInArrow(_digests, "key string, host string, near array<struct<block:int,guest:boolean>>, hashes array<long>, sizes array<int>")
        parts = parts.withColumn("at", F.explode("near")).select("key", "host", "hashes", "sizes", "at.block", "at.guest")
        parts = parts.repartitionById(n, F.col("block")).sortWithinPartitions("block", "key")
        return parts.mapInArrow(_run_starts, "block int, at_start boolean, first string, before_last string").collect()

    known = {r["block"]: r for r in starts(key == F.get(_strings(["", *firsts[1:]]), block)) if r["at_start"]}
    crossed = [b for b in range(1, n) if b not in known]
    inside = sorted({*crossed, *(b - 1 for b in crossed)})
    if not inside:
        return list(known.values())
    found = [r for r in starts(F.array_contains(longs(inside), block.cast("long"))) if r["block"] in set(inside)]
    return [*found, *(r for b, r in known.items() if b not in set(inside))]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    spark = pages.sparkSession
    size = pages.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("bytes")).first()
    blocks = min(MOST_BLOCKS, 1 + size["bytes"] // BLOCK_BYTES)
    per = max(LEAST_BLOCK, -(-size["n"] // blocks))
    block, key, needed = F.col("block"), F.col("key"), []
    rows = pages.select("page_id", "url", "html", url_key().alias("key"))
    firsts: list[str] = [""]
    if size["n"] > per:
        order = numbered(pages.select(url_key().alias("key")), [F.col("key")])
        firsts = sorted({r[0] for r in order.where(F.pmod(F.col("number") - 1, F.lit(per)) == 0).select("key").collect()})
        rows = rows.withColumn("block", range_of_strings(firsts[1:], key))
        lasts = order.groupBy(range_of_strings(firsts[1:], key).alias("block")).agg(F.max("key").alias("last")).collect()
        lasts = [last for _, last in sorted((r["block"], r["last"]) for r in lasts)]
        needed = guests(_runs(rows, firsts, lasts), lasts)
        forget(spark, order)
    else:
        rows = rows.withColumn("block", F.lit(0))
    asked = spark.createDataFrame(needed, "key string, to int").groupBy("key").agg(F.collect_list("to").alias("to"))  # two for each block at most
    rows = rows.join(F.broadcast(asked), "key", "left")
    near = F.concat(F.array(_at(block, False)), F.transform(F.coalesce("to", F.array().cast("array<int>")), lambda x: _at(x, True)))
    rows = rows.select("page_id", "url", "key", near.alias("near"), "html")
    rows = rows.mapInArrow(_lines, f"page_id {dict(pages.dtypes)['page_id']}, url string, key string, near array<struct<block:int,guest:boolean>>, kinds array<tinyint>, groups array<int>, lines array<string>")
    rows = rows.withColumn("at", F.explode("near")).select("page_id", "url", "key", "kinds", "groups", "lines", host(F.col("url")).alias("host"), "at.block", "at.guest")
    rows = rows.repartitionById(len(firsts), block).sortWithinPartitions("block", "key").drop("key")
    return rows.mapInArrow(_difference, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")


def range_of_strings(splitters: list[str], key: Column) -> Column:
    """The number of splitters up to the key, by binary search."""
    steps = [1 << i for i in reversed(range(max(1, len(splitters)).bit_length()))]
    values = _strings(splitters)
    step = lambda p, b: F.when((p + b <= len(splitters)) & (F.try_element_at(values, (p + b).cast("int")) <= key), p + b).otherwise(p)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1))
