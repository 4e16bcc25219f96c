"""Main text of web pages: blocks of markup, and differencing against pages with the nearest URL.

A page becomes its blocks of text in page order. Blocks inside elements that hold no article (navigation, forms, notices,
reader comments and the like) go, with all they hold. Every page is paired with pages of the same host whose URL path shares the deepest
prefix; their lines are aligned by longest common subsequence, and lines of the alignment are deleted as boilerplate.
Markup is evidence in this: where a page marks its article (``article`` or ``main``) only lines in it can be its text, and
a line in it goes only if it aligns with two pages of the group (or with the only other one), and not if the aligned lines
are half of the article or more, as then the articles are copies of each other.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements whose content is never text of the page.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "object", "canvas", "title"}
#: Elements that hold no article.
ASIDE = {"head", "nav", "footer", "aside", "form", "button", "dialog", "menu"}
#: Names in class, id or role that tell the same, as whole names; parts of hyphenated names tell nothing.
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu menubar breadcrumb breadcrumbs"
    " sidebar complementary footer contentinfo cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup"
    " login search share sharing social related recommended comment comments disqus replies pagination pager toolbar widget skip ad-banner ad-container"
    " ad-slot nav-bar nav-menu main-navigation site-navigation navigation-menu site-header site-footer page-footer cookie-banner cookie-notice"
    " cookie-consent cookie-bar newsletter-signup related-posts related-articles share-buttons social-share social-links comment-list"
    " comments-area comments-list comments-section comment-respond".split()
)
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = {"article", "main"}
#: Elements that no name in class, id or role skips.
WHOLE = ARTICLE | {"html", "body"}
LEVELS = 8
#: Bytes of a line's digest.
DIGEST = 8


def _raw_end(page: str, name: str, at: int) -> int:
    found = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
    return found.end() if found else len(page)


def _end(page: str, name: str, at: int) -> int:
    """Place behind the element ``name`` whose start tag ends at ``at``, with all that it holds.

    A paragraph ends before the next block. An element that is never closed goes up to the first marked article, or to the
    end of the page; a head that is not closed ends at once, as what it may hold has no text.
    """
    nested, begin, article = 1, at, None
    while (m := TAG.search(page, at)) is not None:
        at = m.end()
        if m[2] is None:
            continue
        inner, ends = m[2].lower(), bool(m[1])
        if name == "p" and inner in BLOCKS:
            return at if ends and inner == "p" else m.start()
        if inner in ARTICLE and not ends and article is None:
            article = m.start()
        if inner == name and not m[3].endswith("/"):
            nested += -1 if ends else 1
            if not nested:
                return at
        elif inner in RAW and not ends:
            at = _raw_end(page, inner, at)
    return begin if name == "head" else len(page) if article is None else article


def blocks(page: str) -> list[tuple[str, bool]]:
    """Text blocks in page order, each with whether the page marks it as its article."""
    out: list[tuple[str, bool]] = []
    parts: list[str] = []
    depth, at = 0, 0

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, depth > 0))
        parts.clear()

    while True:
        m = TAG.search(page, at)
        parts.append(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        name, ends = m[2].lower(), bool(m[1])
        if name in BLOCKS:
            close()
        elif name == "br":
            parts.append(" ")
        if ends:
            depth -= name in ARTICLE and depth > 0
            continue
        if name in RAW:
            at = _raw_end(page, name, at)
            continue
        if name in VOID:
            continue
        words = {w for a in NAMES.findall(m[3]) for w in "".join(a).lower().split()} if m[3] else set()
        aside = name in ASIDE or words & ASIDE_WORDS or ("header" in words | {name} and not depth)
        if aside and name not in WHOLE:
            if name in BLOCKS or words & ASIDE_WORDS:
                close()
            at = _end(page, name, at)
        else:
            depth += name in ARTICLE
    close()
    return out


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of one longest common subsequence of the lines."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    found = set(range(start)) | set(range(len(a) - end, len(a)))
    places: dict[str, list[int]] = {}
    for j in range(len(b) - end - 1, start - 1, -1):
        places.setdefault(b[j], []).append(j)
    tails: list[int] = []
    chain: list[tuple[int, tuple | None]] = []
    for i in range(start, len(a) - end):
        for j in places.get(a[i], ()):
            k = bisect_left(tails, j)
            node = (i, chain[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                chain.append(node)
            else:
                tails[k], chain[k] = j, node
    node = chain[-1] if chain else None
    while node:
        found.add(node[0])
        node = node[1]
    return found


def own_lines(lines: list[str], inside: list[bool], known: list, others: list[list]) -> list[str]:
    """The lines that are the page's text. ``known`` and ``others`` are digests of its lines and of its partners' lines.

    Lines of a page without a marked article go if they align with the nearest page; all stay if that would leave none. Of
    a marked article those go that align with every partner, unless they hold half of its characters or more.
    """
    shared = common_lines(known, others[0]) if others else set()
    if not any(inside):
        return [line for i, line in enumerate(lines) if i not in shared] or lines
    own = {i for i, marked in enumerate(inside) if marked}
    shared &= own
    for other in others[1:] if shared else []:
        shared &= common_lines(known, other)
    if 2 * sum(len(lines[i]) for i in shared) >= sum(len(lines[i]) for i in own):
        shared = set()
    return [lines[i] for i in sorted(own - shared)]


def line_digests(lines: list[str]) -> bytes:
    return b"".join(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=DIGEST).digest() for line in lines)


def cut_digests(data: bytes) -> list[bytes]:
    return [data[i : i + DIGEST] for i in range(0, len(data), DIGEST)]


def sketches(pages: DataFrame) -> DataFrame:
    """Per row with a page_id: page_id and the digests of its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_digests([text for text, _ in blocks(page or "")]) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(found, pa.binary())], ["page_id", "known"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("html").cast("string")).where("page_id is not null")
    return rows.mapInArrow(run, "page_id bigint, known binary")


def parsed(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, its lines (none has a line break) as one text, and whether each is inside a marked article."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(page or "") for page in batch.column("html").to_pylist()]
            lines = ["\n".join(text for text, _ in page) for page in found]
            inside = [bytes(own for _, own in page) for page in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(lines, pa.string()), pa.array(inside, pa.binary())],
                ["page_id", "url", "lines", "inside"],
            )

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id bigint, url string, lines string, inside binary")


def partners(pages: DataFrame) -> DataFrame:
    """page_id, partners: one or two pages of the same host that share the deepest path prefix, for pages that have one.

    Every prefix of a path is a group. A page's partners are the first two others among its group's first page by URL, its
    last and one picked by hash, so groups of any size are aggregated, never paired out.
    """
    split = F.regexp_extract_all(F.regexp_replace(F.lower("url"), "[?#].*$", ""), F.lit("[^/]+"), F.lit(0))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", split.alias("steps")).where("page_id is not null and size(steps) > 1")
    # The first step is the scheme, the second the host.
    levels = F.sequence(F.lit(2), F.least(F.size("steps"), F.lit(LEVELS)))
    rows = rows.select("page_id", F.struct("url", "page_id").alias("me"), F.posexplode(F.transform(levels, lambda n: F.array_join(F.slice("steps", F.lit(2), n - 1), "/"))).alias("level", "prefix"))
    some = F.min(F.struct(F.xxhash64("page_id").alias("h"), "page_id"))
    groups = rows.groupBy("prefix").agg(F.min("me").alias("first"), F.max("me").alias("last"), some.alias("some")).where("first.page_id <> last.page_id")
    groups = groups.select("prefix", F.array_distinct(F.array("first.page_id", "last.page_id", "some.page_id")).alias("members"))
    found = rows.select("page_id", "level", "prefix").join(groups, "prefix")
    other = F.slice(F.array_except("members", F.array("page_id")), 1, 2)
    return found.groupBy("page_id").agg(F.max_by(other, "level").alias("partners"))


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars.

    Null and empty pages, and pages without any block, have an empty text. A page without a partner (no URL, the only one
    of its host, a null page_id) keeps all its lines, or those of its marked article. A page whose every line aligns with
    its partner's keeps all: that is a copy, not boilerplate. Rows that repeat a page_id are kept; as a partner, the last
    of them in the order of line digests counts.

    Pages meet as digests of their lines; the lines themselves are dealt once, by page_id.
    """
    pairs = partners(pages).select("page_id", F.posexplode("partners").alias("turn", "partner"))
    wanted = pairs.select(F.col("partner").alias("page_id")).distinct()
    others = sketches(pages).join(wanted, "page_id", "left_semi").groupBy(F.col("page_id").alias("partner")).agg(F.max("known").alias("other"))
    met = pairs.join(others, "partner").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("turn", "other"))).alias("met"))
    both = parsed(pages).join(met.select("page_id", F.transform("met", lambda m: m["other"]).alias("others")), "page_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, inside, others in zip(*(batch.column(c).to_pylist() for c in ("lines", "inside", "others"))):
                lines = text.split("\n") if text else []
                own = own_lines(lines, [b > 0 for b in inside], cut_digests(line_digests(lines)), [cut_digests(o) for o in others or []])
                texts.append("\n".join(own))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    diffed = both.select("page_id", "url", "lines", "inside", "others").mapInArrow(run, "page_id bigint, url string, text string")
    return diffed.withColumn("n_chars", F.length("text").cast("bigint"))
