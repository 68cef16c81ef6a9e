"""Main text of web pages: each host's repeated spans, where structure leaves a block open.

A page is cut into blocks. Structure decides where it speaks: what lies in a menu, header, footer, sidebar, notice,
advert, form, comment list, script or style (by element, or by a whole class, id or role name) is boilerplate; what lies
in article or main is text. A wrapper that only its class names as boilerplate does not hide an article or main in it, if
the page has no other. Blocks that neither covers are open, and the host's suffix groups decide them: a page's open and
boilerplate blocks are its token streams (unbroken across blocks, broken by article text); the suffixes of all its pages are grouped by
their first SPAN tokens over the whole host, and substrings of that length that two distinct pages hold mark the tokens
they cover. Covered tokens of open blocks go; unique runs stay. repeated() does the same in memory.

Repetition does not overrule article and main: an article that is repeated on a host (copies, quoted passages, licence
lines) stays whole. Pages with equal text and open blocks are copies and count as one page, so that copies do not erase
each other.

Defined cases: null html is empty and gives the empty text; rows of one page id count as one page, and every row gets a
result; a null id is a page of its own; a null url is a host of its own; a page of any length is one row's work; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomalign.llm.common import slices, stored

SPAN, SALTS = 8, 8

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|aria-label|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_RAW = frozenset("script style noscript template textarea select title svg math iframe object xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img button".split())
_OUT = frozenset("nav footer aside form dialog head menu button".split())
_IN = frozenset(["article", "main"])
_PARTS = frozenset(
    """nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar banner footer sidebar aside rail widget widgets related recommended ad ads advert adverts
    advertisement advertisements sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup
    share sharing social comment comments reply replies discussion disqus respond form search searchform login pagination pager copyright legal toolbar skip""".split()
)
_IMPLIED = {"p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"])}
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul p".split())


_HEADS = frozenset("header masthead banner topbar".split())  # inside an article these hold its title
_ROLES = frozenset("contentinfo complementary search navigation banner dialog alert".split())
_NOT = frozenset("no not has with without is hide show".split())  # no-sidebar, has-comments: said of something else
_PLACE = frozenset("left right top bottom main wrap wrapper box container inner outer area list section block bar links items content group primary secondary".split())


def _names_part(name: str, inside: bool) -> bool:
    """Is a whole class or id name that of a page part? Of compounds the last word counts (cookie-notice), or the first before words of place (sidebar-left)."""
    words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
    part = lambda w: w in _PARTS and not (inside and w in _HEADS)
    if not words or words[0] in _NOT:
        return False
    return part(words[-1]) or part(words[0]) and all(w in _PLACE or w.isdigit() for w in words[1:])


def _is_part(element: str, attributes: str, inside: bool = False) -> bool:
    for name, a, b, c in _NAMES.findall(attributes):
        name, value = name.lower(), (a or b or c or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _ROLES:
            return True
        if name in ("class", "id", "itemprop"):
            if element in _IN:  # only a whole name of one word (comment, ad) says what an article is
                if any(w in _PARTS and w not in _HEADS for w in value.split()):
                    return True
            elif any(_names_part(w, inside) for w in value.split()):
                return True
    return False


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(state, text) of each block in page order; state 1: text by structure, 0: open, -1: boilerplate."""
    page = page or ""
    out: list[tuple[int, str]] = []
    buffer: list[str] = []
    stack: list[tuple[str, int]] = []
    state, at, n = 0, 0, len(page)
    mark = None  # where in the buffer, and in what state, an inline element of boilerplate began

    def flush():
        nonlocal mark
        if buffer:
            text = " ".join(_html.unescape("".join(buffer if mark is None else buffer[: mark[0]])).split())
            buffer.clear()
            if text:
                out.append((state if mark is None else mark[1], text))
        if mark is not None:
            mark = (0, mark[1])

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            rest = page[at:]
            cut = rest.rfind("<")
            buffer.append(rest if cut < 0 or not re.match(r"</?[a-zA-Z!]", rest[cut:]) else rest[:cut])  # a tag that the page's end cuts off
            break
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if closing:
            if name == "p" and not any(t == "p" for t, _ in stack):
                flush()
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name not in _INLINE or any(t not in _INLINE for t, _ in stack[k + 1 :]):
                        if name in _INLINE and any(t not in _INLINE for t, _ in stack[k + 1 :]):
                            break  # a stray end tag of an inline element does not close blocks
                        flush()
                    del stack[k:]
                    new = stack[-1][1] if stack else 0
                    if mark is not None and new >= 0:
                        del buffer[mark[0] :]
                        mark = None
                    elif new != state:
                        flush()
                    state = new
                    break
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if name in ("title", "iframe", "svg", "math", "object", "template", "select", "textarea", "noscript") and name != "title":
                flush()
            at = end.end() if end else (at if name in ("noscript", "object", "template", "svg", "math") else n)
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name in _VOID:
            if name not in _INLINE:
                flush()
            continue
        if name not in _INLINE:
            flush()
            closes = _IMPLIED.get(name, frozenset()) | (frozenset(["p"]) if name in _CLOSES_P else frozenset())
            while stack and closes:  # the element that an open one of the same kind ends with; inline ones inside end as well
                k = len(stack) - 1
                while k >= 0 and stack[k][0] in _INLINE:
                    k -= 1
                if k < 0 or stack[k][0] not in closes:
                    break
                del stack[k:]
            state = stack[-1][1] if stack else 0
            if state >= 0:
                mark = None
        new = state
        if state >= 0:
            if name in _OUT or name == "header" and state == 0:
                new = -1
            elif _is_part(name, m[3], state > 0) and name not in ("html", "body"):
                new = -2
            elif name in _IN:
                new = max(1, state)
        elif state == -2 and name in _IN and not _is_part(name, m[3]):
            new = 2
        if m[3].rstrip().endswith("/") and name not in _INLINE and name not in ("div", "p", "article", "main", "section", "span"):
            continue
        if new != state and name in _INLINE:
            mark = (len(buffer), state)
        stack.append((name, new))
        state = new
    flush()
    own = any(x == 1 for x, _ in out)  # -2: boilerplate by its class; 2: an article in such a wrapper
    return [((-1 if own else 1) if x == 2 else max(x, -1), text) for x, text in out]


def repeated(pages: list[tuple[int, list[str]]], span: int = SPAN) -> list[list[bool]]:
    """For each (page, tokens) stream: is the token covered by a substring of span tokens that two distinct pages have?

    Suffixes are ranked by their first 1, 2, 4 ... span tokens (prefix doubling); equal ranks are equal substrings.
    """
    import numpy as np

    lengths = [len(t) for _, t in pages]
    total = sum(lengths)
    if not total:
        return [[] for _ in pages]
    words: dict[str, int] = {}
    rank = np.fromiter((words.setdefault(w, len(words)) for _, t in pages for w in t), np.int64, total)
    page = np.repeat(np.array([p for p, _ in pages], np.int64), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(total)  # tokens to the stream's end
    k = 1
    while k < span:
        step = min(k, span - k)
        shifted = np.zeros(total, np.int64)
        shifted[:-step] = rank[step:] + 1
        shifted[left <= step] = 0  # beyond the end
        _, rank = np.unique(rank * (int(shifted.max()) + 1) + shifted, return_inverse=True)
        k += step
    whole = np.flatnonzero(left >= span)
    order = whole[np.lexsort((page[whole], rank[whole]))]  # the suffix array, cut at span tokens
    if not len(order):
        return [[False] * n for n in lengths]
    new = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
    group = np.cumsum(new) - 1
    other = np.concatenate([[False], (page[order][1:] != page[order][:-1]) & ~new[1:]])
    shared = np.bincount(group, other, minlength=group[-1] + 1) > 0
    hits = order[shared[group]]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + span, -1)
    covered = np.cumsum(edge)[:-1] > 0
    return [x.tolist() for x in np.split(covered, np.cumsum(lengths)[:-1])]


def streams(found: list[tuple[int, str]]) -> list[list[str]]:
    """The token streams of a page's open and boilerplate blocks; article text breaks a stream."""
    out: list[list[str]] = [[]]
    for x, text in found:
        if x == 1:
            out.append([])
        else:
            out[-1] += text.split(" ")
    return [x for x in out if x]


def decided(found: list[tuple[int, str]], marks: set[int]) -> str:
    """Text of a page: article blocks whole, open blocks without the covered tokens; marks: covered places in its streams, one after the other."""
    at, kept = 0, []
    for x, text in found:
        if x == 1:
            kept.append(text)
            continue
        words = text.split(" ")
        own = " ".join(w for k, w in enumerate(words, at) if k not in marks) if x == 0 else ""
        at += len(words)
        if own:
            kept.append(own)
    return "\n".join(kept)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", span: int = SPAN) -> DataFrame:
    """One row per row of pages: id, url, text, n_chars, n_open (blocks that structure left open), n_covered (repeated tokens of the streams of a page with open blocks).

    The text of a page without open blocks is done where it is read; its streams are evidence for the host's other pages
    all the same. The spans of a whole host are summed up by (host, digest of the span), before and after they are dealt
    out, and only covered places go back to pages with open blocks: no task holds a host, and no host is split.
    """
    rows = pages.select(F.col(key).cast("long").alias("_id"), F.col(url).alias("_u"), F.col(html).alias("_h"))

    def cut(batches):
        import hashlib

        import pyarrow as pa

        kind = pa.schema([("_id", pa.int64()), ("_u", pa.string()), ("done", pa.string()), ("states", pa.list_(pa.int8())), ("parts", pa.list_(pa.string())), ("streams", pa.list_(pa.string())), ("copy", pa.binary())])
        for batch in batches:
            for s in slices(batch):
                done, states, parts, own, copy = [], [], [], [], []
                for h in s.column("_h").to_pylist():
                    found = blocks(h)
                    kept, closed = "\n".join(t for x, t in found if x >= 0), all(x for x, _ in found)
                    done.append(kept if closed else None)
                    states.append(None if closed else [x for x, _ in found])
                    parts.append(None if closed else [t for _, t in found])
                    own.append([" ".join(w) for w in streams(found)])
                    copy.append(hashlib.blake2b(kept.encode(), digest_size=16).digest())
                yield pa.record_batch([s.column("_id"), s.column("_u"), pa.array(done, pa.string()), pa.array(states, pa.list_(pa.int8())), pa.array(parts, pa.list_(pa.string())), pa.array(own, pa.list_(pa.string())), pa.array(copy, pa.binary())], schema=kind)

    first = stored(rows.mapInArrow(cut, "_id long, _u string, done string, states array<tinyint>, parts array<string>, streams array<string>, copy binary").withColumn("row", F.monotonically_increasing_id()), "blocks")
    host = F.coalesce(F.lower(F.regexp_extract("_u", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))

    def spans(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for s in slices(batch, 64):
                found, page, twin, row, at = [], [], [], [], []
                for host, i, r, copy, own in zip(*[s.column(c).to_pylist() for c in ("host", "_id", "row", "copy", "streams")], strict=True):
                    begin = 0
                    for w in (x.split(" ") for x in own):
                        n = max(0, len(w) - span + 1)
                        found += [hashlib.blake2b("\0".join([host, *w[k : k + span]]).encode(), digest_size=16).digest() for k in range(n)]
                        at += range(begin, begin + n)
                        page += [f"{i}" if i is not None else f"r{r}"] * n
                        twin += [int.from_bytes(copy[:8], "little", signed=True)] * n
                        row += [r] * n
                        begin += len(w)
                h = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                yield pa.record_batch([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(page, pa.string()), pa.array(twin, pa.int64()), pa.array(row, pa.int64()), pa.array(at, pa.int32())], names=["h1", "h2", "page", "twin", "row", "at"])

    units = stored(first.select(host.alias("host"), "_id", "row", "copy", "streams").mapInArrow(spans, "h1 long, h2 long, page string, twin long, row long, at int"), "spans")
    # Two pages differ in id and in content; where a span has two ids and two contents, two such pages exist.
    shared = units.groupBy("h1", "h2").agg(F.min("page").alias("p0"), F.max("page").alias("p1"), F.min("twin").alias("t0"), F.max("twin").alias("t1")).where("p0 != p1 and t0 != t1")
    shared = shared.select("h1", "h2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))  # a span of all pages of a hot host is joined in parts
    open_ = first.where(F.col("done").isNull()).select("_id", "_u", "row", "states", "parts")
    hits = units.join(open_.select("row"), "row", "left_semi").select("h1", "h2", "row", "at", F.pmod(F.hash("row"), F.lit(SALTS)).alias("salt")).join(shared, ["h1", "h2", "salt"]).groupBy("row").agg(F.collect_list("at").alias("hits"))

    def decide(batches):
        import pyarrow as pa

        for batch in batches:
            for s in slices(batch):
                texts, opened, covered = [], [], []
                for states, parts, hits in zip(*[s.column(c).to_pylist() for c in ("states", "parts", "hits")], strict=True):
                    marks = {k for h in hits or () for k in range(h, h + span)}
                    texts.append(decided(list(zip(states, parts, strict=True)), marks))
                    opened.append(states.count(0))
                    covered.append(len(marks))
                yield pa.record_batch([s.column("_id"), s.column("_u"), pa.array(texts, pa.string()), pa.array(opened, pa.int64()), pa.array(covered, pa.int64())], names=["_id", "_u", "done", "n_open", "n_covered"])

    closed = first.where(F.col("done").isNotNull()).select("_id", "_u", "done", F.lit(0).cast("long").alias("n_open"), F.lit(0).cast("long").alias("n_covered"))
    rest = open_.join(hits, "row", "left").select("_id", "_u", "states", "parts", "hits").mapInArrow(decide, "_id long, _u string, done string, n_open long, n_covered long")
    return closed.unionByName(rest).select(F.col("_id").alias(key), F.col("_u").alias(url), F.col("done").alias("text"), F.length("done").cast("long").alias("n_chars"), "n_open", "n_covered")
