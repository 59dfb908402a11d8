"""Main text of web pages, by their markup and by what the page of the nearest URL says as well.

A page is read into blocks of text. Markup that names a menu, footer, form, advert, comment and so on takes its blocks out, and
blocks inside ``article`` or ``main`` are known as such. What markup leaves open is settled by page differencing: the pages of a
host are put in the order of their paths, each is paired with the neighbour that shares more of its path, their lines are aligned by a
longest common subsequence, and lines that both hold are deleted as the host's template.

Lines inside ``article`` are never deleted as shared: an article that is quoted or copied on a neighbouring page is still its
page's text. Exact copies of a page's lines under one path are one page when pairs are made, and a page of which nothing would be left keeps its lines,
because its neighbour is a copy of it and no template.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagspark.llm.common import in_batches, keep, slices, table
from tagspark.llm.ordered import numbered

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+)>""")
ATTRIBUTE = re.compile(r"""(class|id|role|style|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose content is no markup, and those that never have any.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header"
    " hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul caption button".split()
)
#: Elements that an element of the second kind ends if it is still open.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol menu dl table select article main body div section".split())
#: Elements and names (in class, id or role) that are no part of an article.
ASIDE = frozenset("nav footer aside form button select fieldset menu dialog svg math canvas audio video object head".split())
NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead footer contentinfo sidebar complementary ad ads advert adverts advertisement adslot sponsor sponsored promo"
    " cookie cookies consent notice notices banner alert popup modal newsletter subscribe signup share sharing social comment comments reply replies disqus"
    " widget toolbar pagination pager search login related".split()
)
OUTSIDE_NAMES = NAMES | {"header"}
#: What an ``article`` may be named and be none.
NO_ARTICLE = frozenset("comment comments reply replies ad ads advert advertisement sponsored promo teaser related".split())
OPEN, MAIN, ARTICLE = 1, 2, 3
#: Cells of an alignment kept at once, in bits; neighbours looked up together.
CELLS, BUCKET = 1 << 28, 64


def _names(attributes: str) -> tuple[set[str], bool, bool]:
    """Words of class, id and role; whether the element is hidden; whether it says to be the main text."""
    words: set[str] = set()
    hidden = main = False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            words.update(w.lower() for w in WORDS.findall(value))
            main |= name == "role" and value.strip().lower() == "main"
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            hidden = True
        elif name == "itemprop" and value.lower() == "articlebody":
            main = True
    return words, hidden, main


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, OPEN, MAIN or ARTICLE) of each block that markup does not take out, in page order.

    Character references are decoded, white space becomes one space, empty blocks are passed over. An element that is never closed
    ends with the element around it.
    """
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, int]] = []  # name, taken out, kind of text inside
    text: list[str] = []
    away, kind = False, OPEN

    def flush():
        line = " ".join("".join(text).split())
        if line:
            out.append((line, kind))
        text.clear()

    def state():
        return (stack[-1][1], stack[-1][2]) if stack else (False, OPEN)

    def leave(names, scope=()):
        """Close the innermost open element of these names, unless one of ``scope`` is open inside it."""
        nonlocal away, kind
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                away, kind = state()
                return
            if stack[i][0] in scope:
                return

    at, size, no_end = 0, len(page), False
    while at < size:
        start = page.find("<", at)
        if start < 0:
            start = size
        if start > at and not away:
            part = page[at:start]
            text.append(entities.unescape(part) if "&" in part else part)
        if start == size:
            break
        found = TAG.match(page, start)
        if not found:
            after = page[start + 1 : start + 2]
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = size if end < 0 else end + 3
            elif after and (after in "!?/" or (after.isascii() and after.isalpha())):
                end = -1 if no_end else page.find(">", start)
                no_end |= end < 0
                at = size if end < 0 else end + 1
            else:
                if not away:
                    text.append("<")
                at = start + 1
            continue
        at = found.end()
        close, name, attributes = found.group(1), found.group(2).lower(), found.group(3)
        if name == "br":
            text.append(" ")
            continue
        if not close and name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            stop = page.find(">", end.end()) if end else -1
            at = size if stop < 0 else stop + 1
            continue
        if name in BLOCK:
            flush()
        if close:
            leave((name,))
            continue
        if name in VOID:
            continue
        if name in BLOCK:
            leave(("p",), BLOCK - {"p"})
            if name in ENDS:
                leave(ENDS[name], SCOPE)
        words, hidden, main = _names(attributes) if attributes and not attributes.isspace() else (frozenset(), False, False)
        if name not in BLOCK and not (words or hidden) and name not in ASIDE:
            continue  # plain inline markup changes nothing
        gone = hidden or name in ASIDE
        if name in ("html", "body", "main"):
            gone = False
        elif name == "article" or main:
            gone = gone or bool(words & NO_ARTICLE)
        elif name == "header" or words & OUTSIDE_NAMES:
            gone = gone or kind == OPEN or bool(words & NAMES)
        inside = ARTICLE if name == "article" or (main and name != "main" and "main" not in words) else MAIN if name == "main" or main else kind
        if not attributes.endswith("/") or name in BLOCK:
            stack.append((name, away or gone, max(kind, inside)))
            away, kind = state()
    flush()
    return out


def line_digest(line: str) -> bytes:
    return hashlib.blake2b(line.encode("utf-8", "replace"), digest_size=16).digest()


def shared_lines(a: list, b: list, cells: int = CELLS) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``; bit rows, halved where they would take too much room."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[len(a) - 1 - hi] == b[len(b) - 1 - hi]:
        hi += 1
    mine, yours = a[lo : len(a) - hi], b[lo : len(b) - hi]
    both = set(mine) & set(yours)
    at = [i + lo for i, x in enumerate(mine) if x in both]
    mine, yours = [a[i] for i in at], [x for x in yours if x in both]
    middle = [at[i] for i in _aligned(mine, yours, cells)]
    return [*range(lo), *middle, *range(len(a) - hi, len(a))]


def _bit_rows(a: list, b: list, every: bool) -> list[int]:
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v, rows = full, [full]
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if every:
            rows.append(v)
    return rows if every else [v]


def _aligned(a: list, b: list, cells: int) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) <= cells or len(a) == 1:
        rows, i, j, out = _bit_rows(a, b, True), len(a), len(b), []
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            elif not rows[i - 1] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                out.append(i)
        return out[::-1]
    half = len(a) // 2

    def lengths(x, y):
        bits = np.unpackbits(np.frombuffer(_bit_rows(x, y, False)[0].to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
        return np.r_[0, np.cumsum(bits == 0)]

    cut = int((lengths(a[:half], b) + lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
    return [*_aligned(a[:half], b[:cut], cells), *(half + i for i in _aligned(a[half:], b[cut:], cells))]


def place_of(url: str | None) -> tuple[str, str]:
    """Host (lower case, without port) and path; a missing or broken URL has neither."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path
    except ValueError:
        return "", ""


def _form(page: str | None, url: str | None) -> tuple[str, str, list[tuple[str, int]], bytes, bytes]:
    lines = blocks(page or "")
    host, path = place_of(url)
    return host, path, lines, b"".join(line_digest(x) for x, _ in lines), bytes(k for _, k in lines)


def _key(host: str, path: str, digests: bytes, kinds: bytes) -> bytes:
    return hashlib.blake2b(b"\0".join((host.encode("utf-8", "replace"), path.encode("utf-8", "replace"), digests + kinds)), digest_size=16).digest()


def _cut(digests: bytes) -> list[bytes]:
    return [digests[i : i + 16] for i in range(0, len(digests), 16)]


def nearest(path: str, before: tuple | None, after: tuple | None) -> int:
    """0 for the row before, 1 for the row after: the one whose path begins alike for longer, the earlier on ties; -1 without any."""

    def alike(other):
        n = 0
        for x, y in zip(path, other, strict=False):
            if x != y:
                break
            n += 1
        return n

    ways = [-1 if x is None else alike(x) for x in (before, after)]
    return -1 if max(ways) < 0 else ways.index(max(ways))


def template_lines(pages: DataFrame) -> DataFrame:
    """(key, shared): for each distinct page with lines to delete, their places. Written to the shared folder."""

    def forms(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                rows = [_form(h, u) for h, u in zip(part.column("html").to_pylist(), part.column("url").to_pylist(), strict=True)]
                columns = list(zip(*((h, p, d, k) for h, p, _, d, k in rows if h and d), strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["host", "path", "digests", "kinds"])

    found = in_batches(pages.select("url", "html"), forms, "host string, path string, digests binary, kinds binary").distinct()
    found = numbered(found, ["host", "path", "digests", "kinds"], "place", "page-forms")
    own, mod = F.floor(F.col("place") / BUCKET), F.col("place") % BUCKET
    go = F.array_compact(F.array(own, F.when(mod == 0, own - 1), F.when(mod == BUCKET - 1, own + 1)))
    w = Window.partitionBy("bucket").orderBy("place")  # BUCKET rows and their two neighbours
    side = F.struct("host", "path", "digests")
    near = found.withColumn("bucket", F.explode(go)).withColumns({"before": F.lag(side).over(w), "after": F.lead(side).over(w)})
    near = near.where(F.col("bucket") == own).where(F.col("before.host").eqNullSafe(F.col("host")) | F.col("after.host").eqNullSafe(F.col("host")))

    def compare(batches):
        for batch in batches:
            out = []
            for host, path, digests, kinds, *sides in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "digests", "kinds", "before", "after")), strict=True):
                if max(kinds) == ARTICLE:
                    continue  # lines outside are out anyway, lines inside stay
                sides = [x if x and x["host"] == host else None for x in sides]
                side = nearest(path, *(x and x["path"] for x in sides))
                gone = shared_lines(_cut(digests), _cut(sides[side]["digests"]))
                top = [i for i, k in enumerate(kinds) if k == max(kinds)]
                gone = sorted(set(gone) & set(top))
                if gone and len(gone) < len(top):
                    out.append((_key(host, path, digests, kinds), gone))
            columns = list(zip(*out, strict=True)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.list_(pa.int32()))], ["key", "shared"])

    return keep(in_batches(near.select("host", "path", "digests", "kinds", "before", "after"), compare, "key binary, shared array<int>"), "template-lines")


def extract(pages: DataFrame) -> DataFrame:
    """All columns of ``pages`` but ``html``, with ``text``, the main text (its blocks joined by a line end), and ``n_chars``.

    Text is that of ``article`` elements, else of ``main``, else of all blocks that markup leaves; but for the first, less the lines
    shared with the page of the nearest URL. Null, empty or textless pages give the empty text. Pages with a null or broken URL and
    the only page of a host have no neighbour. Repeated rows come back as often. Columns named like the results are replaced.
    """
    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    carried = [c if c == "url" else f"own_{i}" for i, c in enumerate(kept)]
    source = pages.select(*(F.col(f"`{c}`").alias(a) for c, a in zip(kept, carried, strict=True)), "html")
    schema = source.drop("html").select("*", F.array(F.lit(None).cast("string")).alias("lines"), F.lit(b"").alias("key")).schema
    names = schema.names

    def read(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                lines, keys = [], []
                for h, u in zip(part.column("html").to_pylist(), part.column("url").to_pylist(), strict=True):
                    host, path, found, digests, kinds = _form(h, u)
                    best = max(kinds, default=0)
                    # other lines become null, so that places still hold
                    lines.append([x if k == best else None for x, k in found])
                    keys.append(_key(host, path, digests, kinds))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(lines, pa.list_(pa.string())), pa.array(keys, pa.binary())], names)

    found = in_batches(source, read, schema).join(template_lines(pages), "key", "left")
    stay = F.when(F.col("shared").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x, i: ~F.array_contains("shared", i))
    )
    text = F.array_join(F.filter(stay, lambda x: x.isNotNull()), "\n")
    out = found.select(*(F.col(a).alias(c) for c, a in zip(kept, carried, strict=True)), text.alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op12_html_extraction(spark, sf: str) -> DataFrame:
    return extract(table(spark, sf, "pages").select("page_id", "url", "html"))
