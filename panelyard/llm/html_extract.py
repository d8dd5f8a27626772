"""Main text of HTML pages by nearest-URL page differencing.

Pages of a host are put in order of their URL path, and each is paired with the neighbour whose path
it shares the longest start with. Pages become lines (one per block of text) in three zones: the
article, the plain body, and furniture, which tags and class names tell. The lines of a pair are
aligned by their longest common subsequence; shared lines go. Those in the article go too if a third
page of the host shares them and the articles are no copies as a whole: a passage that just two
articles have in common is content. Then furniture that differs from page to page goes.

Only hashes of lines are sorted and paired, one row for all pages of a host with the same lines, so a
run of copies meets the nearest page with other lines. Pages are read twice, and move once, to meet the
list of their shared lines. The order is cut into ranges of equal size, so a host of a third of all pages is
many tasks; the first and last page of each range (one row per range) reach over the cuts.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from os.path import commonprefix
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.llm.store import arrow_map, stored, table

ARTICLE, BODY, FURNITURE = 0, 1, 2

#: Elements whose text is no page text at all, and elements that are furniture.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "canvas", "object"}
FURNITURE_TAGS = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "label"}
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar"}
#: Words for furniture in class names and ids.
FURNITURE_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar rail header masthead footer cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations "
    "comment comments commentlist disqus respond reply replies widget pagination pager toolbar".split()
)
#: Words that a name of furniture may have besides: `site-header` and `share-buttons` tell furniture,
#: `has-sidebar`, `entry-header` and `market-share` do not.
PLAIN_NAMES = set(
    "site page global main top bottom primary secondary bar box area block section wrapper wrap container inner outer list item "
    "items link links button buttons icons form posts articles stories".split()
)
#: Elements that never are furniture by name.
CONTAINERS = {"html", "body", "main"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.IGNORECASE)


def _names_furniture(token: str) -> bool:
    words = {w.lower() for w in _WORDS.findall(token)}
    return bool(words & FURNITURE_NAMES) and words <= FURNITURE_NAMES | PLAIN_NAMES


def _is_furniture(tag: str, attributes: str) -> bool:
    if tag in FURNITURE_TAGS:
        return True
    if tag in CONTAINERS or not attributes.strip():
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            if any(map(_names_furniture, value.split())):
                return True
        elif name == "role":
            if not FURNITURE_ROLES.isdisjoint(value.lower().split()):
                return True
        elif name == "style":
            if _UNSEEN.search(value):
                return True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
    return False


def _zones(nodes: list[tuple[int, str, bool]], lines: list[tuple[int, str]]) -> list[int]:
    """The zone of each element; `nodes` has parent, name and whether it looks like furniture, `lines`
    the element of each text.

    What holds the page's article, main element or title is no furniture. The title is the first h1,
    if there is one in main or an article the first of those; the article is the one around the title,
    or else the one with the most text.
    """
    within: list[int] = []  # the outermost article
    in_main: list[bool] = []
    for at, (parent, name, _) in enumerate(nodes):
        around = within[parent] if parent >= 0 else -1
        within.append(around if around >= 0 else at if name == "article" else -1)
        in_main.append(name == "main" or parent >= 0 and in_main[parent])
    text = [0] * len(nodes)
    h1s = set()
    for at, line in lines:
        if at >= 0 and within[at] >= 0:
            text[within[at]] += len(line)
        while at >= 0 and nodes[at][1] != "h1":
            at = nodes[at][0]
        h1s.add(at)
    titles = sorted(h1s - {-1}, key=lambda at: (within[at] < 0 and not in_main[at], at))[:1]
    articles = [within[at] for at in titles if within[at] >= 0]
    if not articles and any(text):
        articles = [max(range(len(nodes)), key=text.__getitem__)]
    mains = [at for at, node in enumerate(nodes) if node[1] == "main"][:1]
    kept = set()
    for at in titles + articles + mains:
        while at >= 0 and at not in kept:
            kept.add(at)
            at = nodes[at][0]
    zones: list[int] = []
    for at, (parent, name, looks) in enumerate(nodes):
        above = zones[parent] if parent >= 0 else BODY
        if above == FURNITURE or looks and at not in kept:
            zones.append(FURNITURE)
        elif above == ARTICLE or name == "article":
            zones.append(ARTICLE)
        else:
            zones.append(-1 if name == "main" else above)
    return zones


def page_lines(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of each block of a page, in page order; blocks without text are left out.

    An element that is never closed does not hide what follows it: it ends where its parent does, or
    is ignored if it would be furniture to the end of the page.
    """
    page = page or ""
    tokens = list(_MARKUP.finditer(page))
    names = [(m[2] or "").lower() for m in tokens]
    closing_left: dict[str, int] = {}
    for m, name in zip(tokens, names):
        if m[1]:
            closing_left[name] = closing_left.get(name, 0) + 1
    lines: list[tuple[int, str]] = []
    parts: list[str] = []
    nodes: list[tuple[int, str, bool]] = []  # parent, name, looks like furniture
    open_tags: list[int] = []  # places in nodes
    article = 0
    at, raw = 0, ""

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            lines.append((open_tags[-1] if open_tags else -1, text))

    for m, name in zip(tokens, names):
        closing = bool(m[1])
        if raw:
            if closing and name == raw:
                closing_left[name] -= 1
                raw, at = "", m.end()
            elif closing:
                closing_left[name] -= 1
            continue
        if m.start() > at:
            parts.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if not name:
            continue
        if closing:
            closing_left[name] -= 1
        if name in BLOCKS:
            flush()
        elif name == "br":
            parts.append(" ")
        if name in VOID:
            continue
        if closing:
            if any(nodes[t][1] == name for t in open_tags):
                while True:
                    gone = nodes[open_tags.pop()][1]
                    article -= gone == "article"
                    if gone == name:
                        break
            continue
        if name in RAW:
            if closing_left.get(name):
                raw = name
            continue
        if name not in BLOCKS and name not in FURNITURE_TAGS and name not in ("span", "a", "font"):
            continue
        # The header of an article holds its title.
        is_furniture = _is_furniture("div" if name == "header" and article else name, m[3]) and bool(closing_left.get(name))
        if name not in BLOCKS and not is_furniture:
            continue
        if name == "p" and open_tags and nodes[open_tags[-1]][1] == "p":
            open_tags.pop()  # a paragraph ends the one before
        nodes.append((open_tags[-1] if open_tags else -1, name, is_furniture))
        open_tags.append(len(nodes) - 1)
        article += name == "article"
    if not raw and at < len(page):
        parts.append(html.unescape(page[at:]))
    flush()
    # The article is what article elements hold, else the main element; without either, the body is all.
    zones = [*_zones(nodes, lines), BODY]  # the last one is for text outside of all elements
    in_main = BODY if any(zones[n] == ARTICLE for n, _ in lines) else ARTICLE
    return [(in_main if zones[n] == -1 else zones[n], t) for n, t in lines]


def main_text(lines: list[tuple[int, str]], shared: set[int]) -> str:
    """The lines of a page's article, or of its body if it has no article zone, that it does not share."""
    zone = ARTICLE if any(z == ARTICLE for z, _ in lines) else BODY
    return "\n\n".join(text for i, (z, text) in enumerate(lines) if z == zone and i not in shared)


#: Articles are copies when so large a part of the shorter one, in characters, is common.
COPIED = 0.5
#: An article line is a site's when so many pages of the host share it with their neighbours.
LEAST_PAGES = 3
#: Low bits of a line's hash: article or not, and above it the length of the text as far as it fits.
LENGTH_BITS = 16
MOST_LENGTH = (1 << LENGTH_BITS) - 1


def line_hash(zone: int, text: str) -> int:
    """47 bits of the text's hash, its length, and one bit: an article line equals no other zone's line."""
    digest = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 2 + LENGTH_BITS
    return (digest << LENGTH_BITS | min(len(text), MOST_LENGTH)) << 1 | (zone == ARTICLE)


def article_length(lines: list[int]) -> int:
    return sum(x >> 1 & MOST_LENGTH for x in lines if x & 1)


def copied(lines: list[int], other: list[int], common: list[int]) -> bool:
    """Whether two articles are copies as a whole; `common` has places in `lines`."""
    shorter = min(article_length(lines), article_length(other))
    return article_length([lines[i] for i in common]) > COPIED * shorter


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in `a` of a longest common subsequence of `a` and `b`.

    Equal ends are matched first and lines that the other side lacks are left out. The rest takes
    one long integer per line (a bit per line of the other side), and is halved while that is much.
    """
    start, end_a, end_b = 0, len(a), len(b)
    while start < min(end_a, end_b) and a[start] == b[start]:
        start += 1
    while end_a > start and end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    ends = [*range(start), *range(end_a, len(a))]
    in_a, in_b = set(a[start:end_a]), set(b[start:end_b])
    left = [i for i in range(start, end_a) if a[i] in in_b]
    right = [x for x in b[start:end_b] if x in in_a]
    if left and right:
        ends += [left[i] for i in _aligned([a[i] for i in left], right)]
    return sorted(ends)


#: Bits of the table of an alignment that is traced back directly.
TABLE_BITS = 200_000_000


def _rows(a: list[int], b: list[int], keep: bool) -> list[int]:
    """Row i has a zero at bit j where the common length with b[:j+1] is one more than with b[:j]."""
    every = (1 << len(b)) - 1
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    row, rows = every, [every]
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & every
        if keep:
            rows.append(row)
    return rows if keep else [row]


def _aligned(a: list[int], b: list[int]) -> list[int]:
    if len(a) * len(b) > TABLE_BITS and len(a) > 1:
        half = len(a) // 2
        ahead = _prefix_lengths(_rows(a[:half], b, False)[0], len(b))
        behind = _prefix_lengths(_rows(a[half:][::-1], b[::-1], False)[0], len(b))[::-1]
        cut = max(range(len(b) + 1), key=lambda j: ahead[j] + behind[j])
        return _aligned(a[:half], b[:cut]) + [half + i for i in _aligned(a[half:], b[cut:])]
    rows = _rows(a, b, True)
    lengths = _prefix_lengths(rows[-1], len(b))
    i, j, length, out = len(a), len(b), lengths[-1], []
    while i and j and length:
        bit = 1 << (j - 1)
        if rows[i] & bit:  # as long without the last of b
            j -= 1
        elif ((~rows[i - 1]) & ((1 << j) - 1)).bit_count() == length:  # as long without the last of a
            i -= 1
        else:
            i, j, length = i - 1, j - 1, length - 1
            out.append(i)
    return out[::-1]


def _prefix_lengths(row: int, n: int) -> list[int]:
    lengths = [0]
    for digit in reversed(bin(row | 1 << n)[3:]):
        lengths.append(lengths[-1] + (digit == "0"))
    return lengths


def _place(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; what is no URL is a path without a host."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path or "/"
    except ValueError:
        return "", url or ""


def line_hashes(pages: DataFrame) -> DataFrame:
    """`page_id, page_hash, host, path, lines` of every page; a line is a `line_hash`."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, hashes = [], [], []
            for url, page in zip(batch.column(2), batch.column(3)):
                host, path = _place(url.as_py())
                hosts.append(host)
                paths.append(path)
                hashes.append([line_hash(zone, text) for zone, text in page_lines(page.as_py())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hosts), pa.array(paths), pa.array(hashes, pa.list_(pa.int64()))],
                ["page_id", "page_hash", "host", "path", "lines"],
            )

    kind = dict(pages.dtypes)["page_id"]
    return arrow_map(
        pages.select("page_id", "page_hash", "url", "html"),
        of_batches,
        f"page_id {kind}, page_hash bigint, host string, path string, lines array<bigint>",
    )


def distinct_pages(hashed: DataFrame) -> DataFrame:
    """One row per host and list of lines, `host, lines_hash, path, lines`, with the first of its paths."""
    return hashed.groupBy("host", "lines_hash").agg(F.min("path").alias("path"), F.first("lines").alias("lines"))


def neighbours(hashed: DataFrame) -> DataFrame:
    """`hashed` with `before` and `after`: path and lines of the pages next to it in its host's order."""
    order = ["host", "path", "lines_hash"]
    ranged = stored(
        hashed.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "pages_in_order"
    )
    within = Window.partitionBy("range").orderBy(*order)
    page = F.struct("host", "path", "lines")
    edges = ranged.groupBy("range").agg(
        F.min_by(page, F.struct(*order)).alias("first"), F.max_by(page, F.struct(*order)).alias("last")
    )
    over = Window.orderBy("range")  # one row per range
    edges = stored(
        edges.select(
            F.col("range").alias("_range"), F.lag("last").over(over).alias("earlier"), F.lead("first").over(over).alias("later")
        ),
        "range_edges",
    )
    placed = ranged.withColumns({"before": F.lag(page).over(within), "after": F.lead(page).over(within)})
    placed = placed.join(edges, F.col("range") == F.col("_range"))

    def same_host(other: str, beyond: str):
        there = F.coalesce(F.col(other), F.col(beyond))
        return F.when(there["host"] == F.col("host"), F.struct(there["path"].alias("path"), there["lines"].alias("lines")))

    return placed.select(
        *hashed.columns, same_host("before", "earlier").alias("before"), same_host("after", "later").alias("after")
    )


def shared_lines(pages: DataFrame) -> DataFrame:
    """`page_id, page_hash, shared`: places of the lines that a page shares with its neighbour, in up to
    two rows per page; article lines are among them as far as they are the site's.

    The neighbour is the page with other lines whose path has the longest common start, the earlier one
    of two. Copies share one neighbour, that of the first of their paths.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, places, repeated = [], [], []
            for path, lines, before, after in zip(*(batch.column(i) for i in range(2, 6))):
                path, lines = path.as_py(), lines.as_py()
                others = [o for o in (before.as_py(), after.as_py()) if o is not None]
                common, in_article = [], []
                if others:
                    nearest = max(others, key=lambda o: len(commonprefix([path, o["path"]])))
                    common = common_lines(lines, nearest["lines"])
                    if not copied(lines, nearest["lines"], common):
                        in_article = [i for i in common if lines[i] & 1]
                found.append([i for i in common if not lines[i] & 1])
                places.append(in_article)
                repeated.append([lines[i] for i in in_article])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(found, pa.list_(pa.int32())),
                    pa.array(places, pa.list_(pa.int32())),
                    pa.array(repeated, pa.list_(pa.int64())),
                ],
                ["host", "lines_hash", "shared", "places", "repeated"],
            )

    hashed = stored(line_hashes(pages).withColumn("lines_hash", F.xxhash64("lines")), "line_hashes")
    paired = neighbours(distinct_pages(hashed)).select("host", "lines_hash", "path", "lines", "before", "after")
    found = arrow_map(
        paired, of_batches, "host string, lines_hash bigint, shared array<int>, places array<int>, repeated array<bigint>"
    )
    found = stored(found.where("size(shared) + size(places) > 0"), "found")
    found = stored(
        found.where("size(shared) > 0").select("host", "lines_hash", "shared").unionByName(_site_lines(found)), "shared_by_lines"
    )
    return hashed.select("page_id", "page_hash", "host", "lines_hash").join(found, ["host", "lines_hash"]).drop("host", "lines_hash")


def _site_lines(found: DataFrame) -> DataFrame:
    """`host, lines_hash, shared`: places of the article lines that are shared on enough pages of a host."""
    once = found.select("host", F.explode(F.array_distinct("repeated")).alias("line"))
    often = stored(once.groupBy("host", "line").count().where(F.col("count") >= LEAST_PAGES).drop("count"), "site_lines")
    zipped = F.arrays_zip(F.col("places").alias("place"), F.col("repeated").alias("line"))
    lines = found.select("host", "lines_hash", F.explode(zipped).alias("l")).select("host", "lines_hash", "l.place", "l.line")
    return lines.join(often, ["host", "line"]).groupBy("host", "lines_hash").agg(F.collect_set("place").alias("shared"))


def extract(pages: DataFrame) -> DataFrame:
    """`page_id, url, text, n_chars` for every row of `pages`.

    Null or empty html gives an empty text. Pages of a null or odd URL are paired among themselves;
    a page without a neighbour keeps its lines. Repeated rows get a row each, with the same text.
    Other columns are not read. An empty table gives an empty result.
    """
    keyed = pages.select("page_id", F.xxhash64("url", "html").alias("page_hash"), "url", "html")
    shared = stored(shared_lines(keyed), "shared_lines")
    shared = shared.groupBy(F.col("page_id").alias("_id"), F.col("page_hash").alias("_hash")).agg(
        F.flatten(F.collect_set("shared")).alias("shared")
    )
    met = keyed.join(
        shared.hint("shuffle_hash"),
        F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("page_hash") == F.col("_hash")),
        "left",
    ).select("page_id", "url", "html", "shared")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(page_lines(page.as_py()), set(shared.as_py() or []))
                for page, shared in zip(batch.column(2), batch.column(3))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = dict(pages.dtypes)["page_id"]
    return arrow_map(met, of_batches, f"page_id {kind}, url string, text string, n_chars bigint")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
