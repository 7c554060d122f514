"""Main text of web pages by the repeated substrings of each host's token stream, with the pages' own structure deciding where they speak.

Pages are read into blocks. The tokens of a host's pages outside articles form its stream. Suffixes of the stream that agree in
their first RUN tokens, which are neighbours in its suffix array, meet in one aggregate however large the host is; where pages
of PAGES contents share one, its tokens are boilerplate, and overlapping ones merge into the longest substrings. Unique runs stay.
Markup that names what a block is comes first: an article stays whole even where other pages repeat it, and menus and adverts go
even where they are unique.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .shingles import scramble, text_chunks, words

#: Tokens of the shortest run that counts as repeated, and pages of different content that must share it.
RUN, PAGES = 8, 3
# Fixed values of HTML: elements that have no content, whose content isn't markup, that begin a block, and that are no main text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
NO_TEXT = set("head script style template noscript iframe svg canvas object audio video math textarea title nav header footer aside menu select button dialog".split())
NO_TEXT_NAMES = set("ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus respond reply share sharing social related recommended newsletter subscribe popup modal overlay toolbar widget pagination".split())
NO_TEXT_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

#: Elements that a form holds only if the page's own content is in it.
CONTENT = re.compile(r"<(?:article|main|nav|header|footer|section|h1|/form)\b", re.I)

#: Comments, other markup declarations, and tags with their attributes, each part as a tokeniser of HTML takes it: a quote opens a value only after an equals sign.
_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+|(?=>)|\Z))?+)*+)(>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>"'][^\s>]*+)))?+""", re.S)
#: Where a block stands: in an article, in main but in no article, in the rest of the body, or in what is no main text.
ARTICLE, MAIN, BODY, DROPPED = range(4)


def _is_dropped(tag: str, attributes: str) -> bool:
    if tag in NO_TEXT:
        return True
    if not attributes.strip() or tag in ("html", "body", "main"):
        return False
    for name, a, b, c in _ATTR.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id") and NO_TEXT_NAMES & set(re.split(r"[\s_-]+", value)):
            return True
        if name == "hidden" or name == "role" and value in NO_TEXT_ROLES or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def _holds_page(page: str, at: int) -> bool:
    """Whether a form that begins there holds content of the page and not only controls."""
    m = CONTENT.search(page, at)
    return bool(m) and m[0][1] != "/"


def blocks(page: str | None) -> list[tuple[str, int]]:
    """The blocks of a page in order, each with ARTICLE, MAIN, BODY or DROPPED for where it stands."""
    out: list[tuple[str, int]] = []
    open_tags: list[tuple[str, int]] = []  # with the zone inside
    parts: list[str] = []
    zone, at, page = BODY, 0, page or ""

    def end_block():
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, zone))
        parts.clear()

    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or not m[4]:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            end_block()
        if m[1]:
            k = next((k for k in range(len(open_tags) - 1, -1, -1) if open_tags[k][0] == tag), None)
            if k is not None:
                if tag not in BLOCKS and open_tags[k][1] != zone:
                    end_block()
                del open_tags[k:]
                new = open_tags[-1][1] if open_tags else BODY
                if new != zone:
                    end_block()
                zone = new
        elif tag not in VOID:
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else len(page)
                continue
            inside = DROPPED if zone == DROPPED or _is_dropped(tag, m[3]) or tag == "form" and not _holds_page(page, at) else ARTICLE if tag == "article" else min(zone, MAIN) if tag == "main" else zone
            if tag in BLOCKS or inside != zone:
                if inside != zone:
                    end_block()
                if tag == "p":  # a paragraph ends the one before
                    if open_tags and open_tags[-1][0] == "p":
                        open_tags.pop()
                        inside = DROPPED if (open_tags[-1][1] if open_tags else BODY) == DROPPED or _is_dropped(tag, m[3]) else (open_tags[-1][1] if open_tags else BODY)
                open_tags.append((tag, inside))
                zone = inside
    end_block()
    return out


def _parsed(batches):
    for b in batches:
        pages = [blocks(x) for x in b.column(2).to_pylist()]
        # Articles and main are the text where there are any; what is left of the others goes here.
        kept = []
        for p in pages:
            best = min((z for _, z in p), default=BODY)
            kept.append([(t, z == ARTICLE) for t, z in p if z <= (BODY if best == BODY else MAIN)])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array([[t for t, _ in p] for p in kept], pa.list_(pa.string())), pa.array([[w for _, w in p] for p in kept], pa.list_(pa.bool_()))], names=["page_id", "url", "rid", "texts", "whole"])


def _suffixes(batches):
    """Each place of a page's stream with a hash of the RUN tokens that follow, and a hash of the whole stream."""
    for b in batches:
        streams = [" ".join(t for t, w in zip(texts, whole, strict=True) if not w) for texts, whole in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        for i, off, data in text_chunks(pa.array(streams, pa.large_string()), 1 << 20):
            h, at = words(off, data)
            n = max(0, len(h) - RUN + 1)
            run = np.zeros(n, dtype=np.uint64)
            for k in range(RUN):
                run = scramble(run * np.uint64(31) + h[k : k + n])
            total = np.concatenate(([0], np.cumsum(scramble(h + np.arange(len(h), dtype=np.uint64)), dtype=np.uint64))).astype(np.uint64)
            size = np.maximum(np.diff(at) - RUN + 1, 0)
            row = np.repeat(np.arange(len(size)), size)
            pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            content = scramble(h[at[:-1][row]] + (total[at[1:]] - total[at[:-1]])[row]) if len(row) else run[:0]
            take = pa.array(i + row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(content.view(np.int64)), pa.array(pos, pa.int64()), pa.array(run[at[:-1][row] + pos].view(np.int64))], names=["rid", "host", "content", "pos", "run"])


def repeated_runs(streams: DataFrame) -> DataFrame:
    """rid and starts, the places of a page's stream at which RUN tokens begin that pages of PAGES contents or more of its host share. streams: rid, host, texts, whole."""
    suffixes = streams.select("rid", "host", "texts", "whole").mapInArrow(_suffixes, "rid long, host string, content long, pos long, run long")
    shared = suffixes.select("host", "run", "content").distinct().groupBy("host", "run").agg(F.count(F.lit(1)).alias("contents")).where(F.col("contents") >= PAGES)
    return suffixes.join(shared, ["host", "run"]).groupBy("rid").agg(F.collect_set("pos").alias("starts"))


def _unique_runs(words: list[str], hit: np.ndarray) -> str:
    """A block without its covered runs, of which those count that are RUN long or all of the block: a shorter one is the end of a run in the block beside."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    gone = np.zeros(len(words), dtype=bool)
    for a, b in zip(edges[0::2], edges[1::2], strict=True):
        gone[a:b] = b - a >= min(RUN, len(words))
    return " ".join(w for w, x in zip(words, gone, strict=True) if not x)


def _joined(batches):
    """The text of each page from its blocks and the repeated places of its stream."""
    for b in batches:
        out = []
        for texts, whole, starts in zip(*(b.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
            if starts:
                covered, at, kept = np.zeros(sum(t.count(" ") + 1 for t in texts) + RUN, dtype=bool), 0, []
                for k in range(RUN):
                    covered[np.array(starts) + k] = True
                for t, w in zip(texts, whole, strict=True):
                    if not w:
                        own = t.split(" ")
                        t, at = _unique_runs(own, covered[at : at + len(own)]), at + len(own)
                    kept.append(t)
                texts = [t for t in kept if t]
            out.append("\n\n".join(texts))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    - The text is what stands in articles, whole, and in main outside articles; without either, in the body. What structure drops is left
      out everywhere, and outside articles also what pages of PAGES contents of the host share for RUN tokens or more.
    - A form counts as controls unless it holds an article, main, section, menu, header, footer or h1.
    - Null or empty html, and pages without text: empty text, 0 characters. A page cut off in the middle of a tag loses that tag only.
    - Null page_id or url pass through; pages without a host form a host. Repeated rows give a row each and count as one content.
    - A page of any length is read whole by one task. Empty tables give an empty result. Columns other than page_id, url and html are ignored.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    parsed = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("rid")).mapInArrow(_parsed, f"page_id {kind}, url string, rid long, texts array<string>, whole array<boolean>")
    parsed = materialize(parsed.withColumn("host", host), "blocks")
    mixed = F.exists("whole", lambda w: ~w)
    some = parsed.where(mixed)
    runs = materialize(repeated_runs(some.dropDuplicates(["rid"])), "runs")
    found = some.join(runs, "rid", "left").select("page_id", "url", "texts", "whole", "starts")
    sure = parsed.where(~mixed).select("page_id", "url", "texts", "whole", F.lit(None).cast("array<bigint>").alias("starts"))
    return sure.union(found).mapInArrow(_joined, f"page_id {kind}, url string, text string, n_chars long")
