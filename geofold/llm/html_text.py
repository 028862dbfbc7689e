"""Main text of web pages: block extraction, then differencing against the page with the nearest URL on the same host."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, released, stored

# Names of HTML elements by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = set("script style noscript template nav footer aside form button select option textarea iframe object svg canvas audio video dialog menu head title".split())
RAW = set("script style textarea title noscript iframe xmp".split())
#: Elements that end one of their own kind.
SAME = set("li dt dd tr td th option".split())
#: A paragraph ends where one of these begins.
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words in class, id or role that mark parts beside the article.
BESIDE = re.compile(
    r"(?:^|\s)(?!(?:has|with|no|without)[-_])(?:[^\s]*[-_])?(?:ad|ads|advert|advertisement|advertising|banner|breadcrumbs?|comment|comments|commentlist|consent|cookies?|disqus|footer|header|masthead|menu|modal|nav|navbar|navigation"
    r"|newsletter|notice|popup|promo|promoted|related|share|sharing|sidebar|social|sponsor|sponsored|subscribe|toolbar|widget|complementary|contentinfo|search|alert|replies|responses|respond)(?:$|[-_\s])", re.I)
COMMENTS = re.compile(r"(?:^|[-_\s])(?:comment|comments|reply|replies)(?:$|[-_\s])", re.I)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
MARK = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
SPACE = re.compile(r"\s+")
#: Where a block stands: free, in an article or main element, or in a part beside it.
FREE, ARTICLE, ASIDE = 0, 1, 2
#: Bits of a difference table; larger ones are halved.
TABLE_BITS = 1 << 30


def blocks(page: str) -> list[tuple[str, int]]:
    """Text blocks of a page in order, each with where it stands.

    Parts beside the article are known by element, class, id, role or hidden; ``header`` is one outside an article
    only, where it holds the site's head.  Comments, scripts, styles and inline parts of that kind give no text.
    Unclosed elements end with the element around them or the page.
    """
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int, bool]] = []  # name, and what held before it
    held: list[str] = []
    beside, inside = 0, False  # beside: 1 in a block, 2 in an inline element, whose text is skipped

    def flush() -> None:
        if held:
            text = SPACE.sub(" ", html.unescape("".join(held))).strip()
            if text:
                out.append((text, ASIDE if beside else ARTICLE if inside else FREE))
            held.clear()

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        lt = n if lt < 0 else lt
        if lt > at and beside < 2:
            held.append(page[at:lt])
        if lt >= n:
            break
        m = TAG.match(page, lt)
        if not m:
            if beside < 2:
                held.append("<")
            at = lt + 1
            continue
        at, name = m.end(), (m[2] or "").lower()
        if not name or m[0][-1] != ">":  # a comment, or a tag torn off at the end
            continue
        if name not in INLINE:
            flush()
        if m[1]:
            if any(x[0] == name for x in stack):
                while True:
                    was, beside, inside = stack.pop()
                    if was == name:
                        break
            continue
        if name in VOID:
            continue
        if name in ENDS_P:  # closes an open paragraph with what is left open inside it
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    beside, inside = stack[i][1:]
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        if name in SAME and stack and stack[-1][0] == name:
            _, beside, inside = stack.pop()
        if name in RAW:
            end = re.compile(rf"</{name}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack.append((name, beside, inside))
        if not beside:
            out_of_it = name in DROPPED or name == "header" and not inside
            for k, v in MARK.findall(m[3]) if m[3] and name not in ("html", "body", "main") else ():
                k, v = k.lower(), v.strip("\"'")
                out_of_it |= k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and re.search(r"display\s*:\s*none", v) is not None
                out_of_it |= k in ("class", "id", "role") and bool((COMMENTS if name == "article" else BESIDE).search(v))
            if out_of_it:
                beside = 2 if name in INLINE else 1
            elif name in ("article", "main"):
                inside = True
    flush()
    return out


def _rows(a: Sequence, b: Sequence) -> list[int]:
    """Bit rows of the common-subsequence table of ``a`` against ``b``: a zero at j says that b[j] lengthens it."""
    at: dict = {}
    for j, s in enumerate(b):
        at[s] = at.get(s, 0) | 1 << j
    ones = (1 << len(b)) - 1
    row, rows = ones, []
    for s in a:
        both = row & at.get(s, 0)
        row = ((row + both) | (row - both)) & ones
        rows.append(row)
    return rows


def _lengths(a: Sequence, b: Sequence) -> np.ndarray:
    row = (1 << len(b)) - 1
    for row in _rows(a, b)[-1:]:
        pass
    bits = np.frombuffer(format(row, f"0{len(b)}b")[::-1].encode(), np.uint8) - 48
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared(a: Sequence, b: Sequence) -> set[int]:
    """Positions of ``a`` on a longest common subsequence with ``b``.

    Equal heads and tails go first, then the table's rows are kept as bits; above ``TABLE_BITS`` the longer side is
    halved where the lengths of both halves add up to most, so memory stays bounded.
    """
    found: set[int] = set()
    lo, x, y = 0, len(a), len(b)
    while lo < min(x, y) and a[lo] == b[lo]:
        found.add(lo)
        lo += 1
    while x > lo and y > lo and a[x - 1] == b[y - 1]:
        x, y = x - 1, y - 1
        found.add(x)
    mine, theirs = set(a[lo:x]), set(b[lo:y])
    place = [i for i in range(lo, x) if a[i] in theirs]
    p, q = [a[i] for i in place], [s for s in b[lo:y] if s in mine]
    if not p:
        return found
    if len(p) * len(q) > TABLE_BITS and len(p) > 1:
        half = len(p) // 2
        split = int((_lengths(p[:half], q) + _lengths(p[half:][::-1], q[::-1])[::-1]).argmax())
        found |= {place[i] for i in shared(p[:half], q[:split])} | {place[half + i] for i in shared(p[half:], q[split:])}
        return found
    rows = _rows(p, q)
    i, j = len(p), len(q)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not (i and not rows[i - 1] >> (j - 1) & 1):
                j -= 1
                found.add(place[i])
    return found


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _identity(key: str, url: str, page: str) -> list:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return [text(key).alias("_k"), F.xxhash64(F.col(key).isNull(), text(url), text(page)).alias("_h")]


def neighbours(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """For each distinct page (``_k``, ``_h``) the line digests of the page before it by URL path on its host.

    The first page of a host gets the one after it; a host's only page gets null.  Pages are sorted by ranges of host
    and path, so a host with most pages lies in many tasks; a range's first and last pages are looked up in a table of
    one row a range.
    """
    kept = pages.select(*_identity(key, url, page), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("_url"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("_html"))

    def parse(cols) -> Iterator[pa.RecordBatch]:
        lines = pa.array([[_digest(t) for t, _ in blocks(x.as_py())] for x in cols["_html"]], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([cols["_k"], cols["_h"], cols["_url"], lines], ["_k", "_h", "_url", "_lines"])

    lines = batches(kept, parse, "_k string, _h bigint, _url string, _lines array<bigint>")
    host = F.lower(F.regexp_extract("_url", r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract("_url", r"^(?:[a-zA-Z][\w+.-]*://[^/?#]*)?([^?#]*)", 1)
    lines = stored(lines.select("_k", "_h", "_lines", host.alias("_host"), path.alias("_path")))
    order = ["_host", "_path", "_url_", "_h"]
    ranged = stored(lines.withColumn("_url_", F.col("_k")).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    released(lines)
    # Equal rows are in one range: they are one page here.
    w = Window.partitionBy("_range").orderBy(*order)
    # By range once, for this and for the window.
    ranged = ranged.repartition("_range").dropDuplicates(["_range", "_host", "_path", "_k", "_h"])
    this = F.struct("_host", "_lines")
    row = ranged.withColumn("_prev", F.lag(this).over(w)).withColumn("_next", F.lead(this).over(w))
    by = F.struct(*order)
    ends = ranged.groupBy("_range").agg(F.max_by(this, by).alias("_last"), F.min_by(this, by).alias("_first"))
    edge = Window.partitionBy(F.lit(1)).orderBy("_range")
    ends = ends.select("_range", F.lag("_last").over(edge).alias("_before"), F.lead("_first").over(edge).alias("_after"))
    row = row.join(ends, "_range")
    before, after = F.coalesce("_prev", "_before"), F.coalesce("_next", "_after")
    other = F.when(before["_host"] == F.col("_host"), before["_lines"]).when(after["_host"] == F.col("_host"), after["_lines"])
    return row.select("_k", "_h", other.alias("_other"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, ``text``, ``n_chars`` and ``n_shared`` (lines removed as the site's) of each page.

    All text lines of a page, those of menus and footers included, are aligned with its neighbour's (``neighbours``);
    lines on a longest common subsequence are the site's and go, but for those inside an article or main element, as
    one text may stand on two pages.  Lines of parts beside the article go too.  A page with the very lines of its
    neighbour is a copy and loses nothing for that.

    Null html is an empty page with an empty text; null or torn URLs share the host ``''``; a repeated row is a page
    of its own with the same result.  An empty table gives an empty result; other columns are not read.
    """
    names = ["_id", "_url", "_html"]
    left = pages.select(F.col(key).alias("_id"), F.col(url).alias("_url"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("_html"), *_identity(key, url, page))
    both = left.join(neighbours(pages, key, url, page), ["_k", "_h"], "left").select(*names, "_other")
    schema = T.StructType([T.StructField(key, pages.schema[key].dataType), T.StructField(url, pages.schema[url].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_shared", T.LongType())])

    def pick(cols) -> Iterator[pa.RecordBatch]:
        texts, gone = [], []
        for x, o in zip(cols["_html"], cols["_other"]):
            found, other = blocks(x.as_py()), o.as_py()
            mine = [_digest(t) for t, _ in found] if other else []
            off = {i for i in shared(mine, other) if found[i][1] == FREE} if other and mine != other else set()
            texts.append("\n".join(t for i, (t, where) in enumerate(found) if where != ASIDE and i not in off))
            gone.append(len(off))
        yield pa.RecordBatch.from_arrays([cols["_id"], cols["_url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64())], schema.names)

    return batches(both, pick, schema)
