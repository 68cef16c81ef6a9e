"""Operators 3, 6, 8, 9 and 10 against brute force, round trips and held-out rows."""

import base64
import hashlib
import math
import random
import zipfile
import zlib
from fractions import Fraction
from html.parser import HTMLParser
from io import BytesIO
from urllib.parse import urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomalign.llm import decontam, extract, kdshard, quality, warc
from loomalign.llm.common import py_words, shared_path
from loomalign.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_report(docs, items, window=13):
    out = []
    for text in docs:
        w, hit, names = py_words(text), set(), set()
        for name, item in items:
            iw = py_words(item)
            n = min(window, len(iw))
            grams = {tuple(iw[p : p + n]) for p in range(len(iw) - n + 1)} if n else set()
            for p in range(len(w) - n + 1) if n else ():
                if tuple(w[p : p + n]) in grams:
                    hit |= set(range(p, p + n))
                    names.add(str(name))
        out.append((len(w), len(hit), sorted(names)))
    return out


def test_decontamination(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "é", "x_y", "don't"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate((0, 1, 2, 5, 12, 13, 14, 25, 40, 60))] + [(10, None), (11, "a a a a a a a a a a a a a a a"), (5, "Zz yy"), (12, say(30))]
    docs = [None, "", "...", "w1", "É", "a " * 40, items[9][1].upper(), items[8][1], say(2000), "zz YY zz"]
    for _ in range(60):
        n, i = rng.randrange(30), rng.randrange(5, 10)
        w = (items[i][1] or "").split()
        a = rng.randrange(max(1, len(w) - 5))
        docs.append(f"{say(n)} {' '.join(w[a : a + rng.randrange(8, 40)])} {say(rng.randrange(20))}")
    docs += docs[-3:]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(docs)], "doc_id long, text string, n_words int, item string").repartition(5)
    for rows in (items, [x for x in items if len(py_words(x[1])) >= 13], []):
        test = spark.createDataFrame([(i, t, "y") for i, t in rows], "item_id long, text string, row string")
        got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontam.report(df, test).collect()}
        assert [got[i] for i in range(len(docs))] == brute_report(docs, rows)
    assert decontam.report(df.limit(0), test).count() == 0


def test_decontamination_of_repeated_words_and_odd_ids(spark):
    """Runs of one word meet as runs; rows that share or lack an id are judged apart."""
    docs = [(None, "a " * 900), (1, "b " + "a " * 700 + "b"), (1, "clean words only"), (None, None), (2, "a " * 12), (2, "x y")]
    items = [(3, "a " * 800), (None, "a " * 13), (4, "x y")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as doc", "2 as tag", "3 as id", "4 as h")
    test = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as row", "2 as item", "3 as iw")
    want = [(i, n, hit, [x for x in names if x != "None"]) for (i, _), (n, hit, names) in zip(docs, brute_report([t for _, t in docs], items), strict=True)]
    got = [(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in decontam.report(df, test).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_kd_shards(spark):
    rng = random.Random(5)
    rows = [(i, None if i % 50 == 0 else "é" * rng.randrange(1, 60), "hot" if i % 3 == 0 else f"s{rng.randrange(9)}", None if i % 7 == 0 else "en", 9) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, shard int").repartition(7)
    got = {r.doc_id: r for r in kdshard.kd_shards(df).collect()}
    assert len(got) == len(rows)
    total, slots = {}, {}
    for i, t, *_ in rows:
        r = got[i]
        data = (t or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        total[r.shard] = total.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(total) == set(range(16)) and max(total.values()) - min(total.values()) <= 4 * 120
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert kdshard.kd_shards(df.limit(0)).count() == 0
    assert sorted((r.shard, r.slot) for r in kdshard.kd_shards(df.limit(1)).collect())[0][1] == 0
    one = kdshard.kd_shards(spark.createDataFrame([(1, "a", "x", "y")] * 40, "doc_id long, text string, source string, lang string")).collect()
    assert len({(r.shard, r.slot) for r in one}) == 40  # one id: the rows stay together


def brute_tree(rows, shards):
    """id: shard, by sorting. rows: (id, size, coordinates)."""
    dims, out = len(rows[0][2]), {}
    wide = [max(max(x[2][d] for x in rows) - min(x[2][d] for x in rows), 1) for d in range(dims)]

    def split(part, first, leaves):
        if leaves == 1 or not part:
            out.update({i: first for i, _, _ in part})
            return
        spans = [(max(x[2][d] for x in part) - min(x[2][d] for x in part)) / wide[d] for d in range(dims)]
        d = max(range(dims), key=lambda k: (spans[k], -k))
        part = sorted(part, key=lambda x: (x[2][d], x[0]))
        goal, before = Fraction(leaves // 2 * sum(x[1] for x in part), leaves), 0
        for k, x in enumerate(part):  # the row in which the share is reached goes where the error is less
            if before < goal <= before + x[1]:
                cut = k + (before + x[1] - goal <= goal - before)
                break
            before += x[1]
        split(part[:cut], first, leaves // 2)
        split(part[cut:], first + leaves // 2, leaves - leaves // 2)

    split(rows, 0, shards)
    return out


def test_kd_tree_against_sorting(spark):
    rng = random.Random(8)
    urls = [f"https://site0.org/{'x' * rng.randrange(30)}" for _ in range(40)] + [None, "", "é"]
    rows = [(i, "a" * rng.randrange(200), rng.choice(urls) if i % 3 else urls[0], rng.choice([0.25, 0.5, 1e9, -3.5, None]), rng.randrange(1000) - 500) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score double, day int").selectExpr("*", "1 as node", "2 as size", "3 as x0", "4 as id", "5 as v").repartition(5)
    order = lambda k: {v: n for n, v in enumerate(sorted({r[k] for r in rows if r[k] is not None}, key=lambda x: x.encode() if isinstance(x, str) else x), 1)} | {None: 0}
    source, score = order(2), order(3)
    plain = [(i, len(t) + 1, (source[u], score[s], d, len(t) + 1)) for i, t, u, s, d in rows]
    total = sum(x[1] for x in plain)
    for option, shards in (({"shards": 16}, 16), ({"shards": 5}, 5), ({"shards": 1}, 1), ({"target_bytes": total // 7}, 8)):
        got = {r.doc_id: r.shard for r in kdshard.kd_shards(df, ("source", "score", "day"), **option).collect()}
        assert got == brute_tree(plain, shards), option


def test_kd_shards_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a", "s", "l")] * 5 + [(7, None, None, None)] * 3 + [(8, "b" * 1_000_000, "s", "l")], "doc_id long, text string, source string, lang string")
    got = kdshard.kd_shards(df, shards=2).collect()
    assert len({(r.shard, r.slot) for r in got}) == 9 and sum(r.doc_id is None for r in got) == 5 and {r["size"] for r in got if r.doc_id == 7} == {1}


def test_warc_round_trip(spark):
    pages = [(1, "http://a/", "<p>é"), (2, None, "<p>é"), (3, "http://b/\r\nX: 1", None), (4, "u", ""), (5, "u", "x" * 300_000), (6, "v", "\r\n\r\nHTTP/1.1"), (7, "v", "<p>é")]
    df = spark.createDataFrame([(*p, 5) for p in pages], "page_id long, url string, html string, payload_bytes int").repartition(3)
    files = warc.write_packages(df, shared_path(spark, "w"), package_bytes=1000)
    got = {r.page_id: r for r in warc.read_packages(files).collect()}
    assert len(got) == len(pages)
    for i, _, t in pages:
        data = (t or "").encode()
        first = max(k for k, _, x in pages if (x or "") == (t or ""))
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", first))
        assert r.payload is None if first != i else bytes(r.payload) == data
    small = warc.read_packages(warc.write_packages(df, shared_path(spark, "w"), least=100))
    assert {r.record_type for r in small.collect()} == {"response"}
    assert warc.read_packages(warc.write_packages(df.limit(0), shared_path(spark, "w"))).count() == 0


def test_zip_directories():
    records = [(i, "u", warc.record(i, "u", b"x" * i, i, "D", None)) for i in range(50)]
    for zip64 in (False, True):
        data = warc.package(records, zip64)
        assert zipfile.ZipFile(BytesIO(data)).testzip() is None
        p = warc.ZipPackage(lambda at, n, data=data: data[at : at + n], len(data))
        assert set(p.members) == {"archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"}
        found = [warc.parse(zlib.decompress(data[a : a + n], 31)) for a, n in p.index()]
        assert [h["warc-record-id"] for h, _ in found] == [f"<urn:page:{i}>" for i in range(50)] and [b for _, b in found] == [b"x" * i for i in range(50)]
    many = BytesIO()
    with zipfile.ZipFile(many, "w") as z:  # more members than the plain end record can count: a ZIP64 end record
        for i in range(66_000):
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"")
        z.writestr("archive/a.warc.gz", b"abc")
    p = warc.ZipPackage(lambda at, n: many.getvalue()[at : at + n] if n < 100 else memoryview(many.getbuffer())[at : at + n].tobytes(), len(many.getvalue()))
    at, n = p.locate("archive/a.warc.gz")
    assert len(p.members) == 66_001 and many.getvalue()[at : at + n] == b"abc"
    with pytest.raises(ValueError, match="central directory"):
        warc.ZipPackage(lambda at, n: b"\0" * n, 100)


def test_zip_with_several_archives():
    """Each index entry is read from the archive that it names."""
    parts = {f"{x}.warc.gz": [zlib.compress(warc.record(i, "u", f"{x}{i}".encode(), 2, "D", None), wbits=31) for i in range(3)] for x in "ab"}
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, (name, records) in enumerate(parts.items()):
            z.writestr(f"archive/{name}", b"".join(records))
            starts = np.cumsum([0, *map(len, records)])[:-1]
            z.writestr(f"indexes/{n}.cdxj", "".join(f'k 2000 {{"offset": "{at}", "length": {len(r)}, "filename": "{name}"}}\n' for at, r in zip(starts, records, strict=True)))
    p = warc.ZipPackage(lambda at, n: out.getvalue()[at : at + n], len(out.getvalue()))
    assert [warc.parse(zlib.decompress(out.getvalue()[a : a + n], 31))[1] for a, n in p.index()] == [f"{x}{i}".encode() for x in "ab" for i in range(3)]


def test_warc_of_null_and_repeated_ids(spark):
    rows = [(None, "u", "a"), (None, "u", "a"), (5, None, "a"), (5, "u", "a"), (4, "u", "a"), (6, "u", "b"), (6, "u", "b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as _id", "2 as _d", "3 as _n", "'x' as payload_digest")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.read_packages(warc.write_packages(df, shared_path(spark, "w"))).collect()), key=str)
    assert got == sorted([(None, "revisit", 5), (None, "revisit", 5), (5, "response", None), (5, "response", None), (4, "revisit", 5), (6, "response", None), (6, "response", None)], key=str)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{a:b}</style><script>var t="</p><p>no";</script></head><body><header><a href=/>Home</a></header>
<nav><ul><li><a>One</a><li>Two</ul></nav><!-- <p>hidden</p> --><div class="cookie-notice">We use cookies</div><div class='ad banner'>Buy</div><aside>Side</aside>
<article class="post"><h1>A  &lt;b&gt;
 title</h1><p><b>Bold<br>text.<br><p>Second &eacute;&nbsp;x &amp;copy; 1 &lt 2<p>Th<i>ir</i>d <span class="ad">spon</span>end<ul><li>i1<li>i2</ul>
<form><input value="q"><label>Search</label></form><section class="comments"><p>Nice!</p></section><footer>By me</footer></article><footer>&copy; us</footer>"""


def test_extract(spark):
    shared = "one two three four five six seven eight nine"
    loose = [f"<div>{shared}</div><p>u{i} words</p>" for i in range(3)]
    pages = [(1, "http://h/1", PAGE), (2, "http://h/2", None), (3, "http://h/3", ""), (4, None, "<p>plain"), (5, "http://h/5", "<article><p>cut &am"), (6, "http://h/6", "<article>kept <a hre"), (7, "http://h/7", "no tags at all <3 &#233;")] + [(10 + i, "https://k.org/x", t) for i, t in enumerate(loose)] + [(20, "http://h/20", f"<article><p>{shared}</p></article>"), (21, "http://h/21", f"<article><p>{shared}</p></article>")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, text string").repartition(3)
    got = {r.page_id: r for r in extract.extract(df).collect()}
    assert got[1].text == "A <b> title\nBold text.\nSecond é x © 1 < 2\nThird end\ni1\ni2".replace("©", "&copy;")
    assert [got[i].text for i in (2, 3, 4, 5, 6, 7)] == ["", "", "plain", "cut &am", "kept", "no tags at all <3 é"]
    assert [got[10 + i].text for i in range(3)] == [f"u{i} words" for i in range(3)] and got[10].n_covered == 9
    assert got[20].text == got[21].text == shared and got[20].n_chars == len(shared) and got[20].url == "http://h/20"
    assert extract.extract(df.limit(0)).count() == 0


def test_repeated_against_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(30):
        pages = [(int(rng.integers(0, 4)), rng.choice(list("abc"), rng.integers(0, 30)).tolist()) for _ in range(6)]
        span = int(rng.integers(1, 7))
        want = []
        for p, t in pages:
            marks = [False] * len(t)
            for i in range(len(t) - span + 1):
                if any(q != p and t[i : i + span] == u[k : k + span] for q, u in pages for k in range(len(u) - span + 1)):
                    marks[i : i + span] = [True] * span
            want.append(marks)
        assert extract.repeated(pages, span) == want


def brute_extract(rows, span=8):
    """(text, covered tokens) of each (id, host, html): spans of two pages that differ in id and in content."""
    found = [extract.blocks(h) for _, _, h in rows]
    seen = {}
    for n, ((i, host, _), b) in enumerate(zip(rows, found, strict=True)):
        page = (("row", n) if i is None else i, "\n".join(t for x, t in b if x >= 0))
        for w in extract.streams(b):
            for k in range(len(w) - span + 1):
                seen.setdefault((host, *w[k : k + span]), set()).add(page)
    out = []
    for (_, host, _), b in zip(rows, found, strict=True):
        marks, at = set(), 0
        for w in extract.streams(b) if any(x == 0 for x, _ in b) else ():
            for k in range(len(w) - span + 1):
                pages = seen[host, *w[k : k + span]]
                if any(p != q and c != d for p, c in pages for q, d in pages):
                    marks |= set(range(at + k, at + k + span))
            at += len(w)
        out.append((extract.decided(b, marks), len(marks)))
    return out


def test_hosts_are_not_split(spark):
    """A substring that two pages of a hot host share is found, whatever the number of its pages and the blocks it lies in."""
    rng = random.Random(9)
    text = [[f"u{i}x{k}" for k in range(12)] for i in range(1100)]
    for i in range(0, 1100, 2):
        text[i][2:11] = text[i + 1][1:10] = [f"s{i}x{k}" for k in range(9)]
    cut = lambda t, n: f"<div>{' '.join(t[:n])}</div><p>{' '.join(t[n:])}</p>"
    pages = [(i, "hot", cut(t, rng.randrange(12))) for i, t in enumerate(text)] + [(1099, "hot", cut(text[3], 5)), (None, "hot", cut(text[0], 4)), (None, "hot", cut(text[0], 4))]
    menu = "<ul><li>a b</li><li>c</li><li>d e f</li><li>g h i</li></ul>"
    pages += [(2000 + i, "b", f"{menu if i % 2 else '<nav>' + menu + '</nav>'}<article>x {i} y</article><div>own {i}</div>") for i in range(5)] + [(2005, "c", f"{menu}<p>alone"), (2008, "e", f"<nav>{menu}</nav><article>z</article>"), (2009, "e", f"{menu}<p>landing"), (2006, "d", f"{menu}<p>twin"), (2007, "d", f"{menu}<p>twin")]
    rng.shuffle(pages)
    df = spark.createDataFrame([(i, f"http://{h}/", t) for i, h, t in pages], "page_id long, url string, html string").repartition(5)
    want = sorted((str(i), *x) for (i, _, _), x in zip(pages, brute_extract(pages), strict=True))
    assert sorted((str(r.page_id), r.text, r.n_covered) for r in extract.extract(df).collect()) == want
    got = {i: x for i, *x in want}
    assert got["2001"] == ["x 1 y\nown 1", 9] and got["2005"][0].endswith("alone") and got["2006"] == got["2007"] and got["2006"][0].endswith("twin") and got["2009"] == ["landing", 9] and got["2008"] == ["z", 0]


def test_class_names_are_read_whole():
    """A part's name inside another word, or said of something else, hides nothing; a wrapper does not hide the only article."""
    keep = ['<div class="content no-sidebar"><article>kept words</article></div>', '<article class="has-comments">kept words</article>', '<main><div class="copyright-law story">kept words</div></main>', '<div class="social-studies-article"><article>kept words</article></div>', '<div class="sidebar"><article>kept words</article></div>', '<div id="comments-page"><main>kept words</main></div>']
    for page in keep:
        assert extract.blocks(page) == [(1, "kept words")], page
    drop = ["cookie-notice", "ad banner", "site_footer", "post-comments", "sidebar-left", "main-menu", "Comment"]
    for name in drop:
        assert extract.blocks(f'<article>a<div class="{name}">no</div></article>') == [(1, "a"), (-1, "no")], name
    assert extract.blocks('<div class="related"><article>teaser</article></div><article>text</article>') == [(-1, "teaser"), (1, "text")]
    assert extract.blocks('<article>text</article><article class="comment">reply</article>') == [(1, "text"), (-1, "reply")]


class Reader(HTMLParser):
    """The article's blocks of well-formed pages, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.out, self.now = False, [], []

    def cut(self):
        text = " ".join("".join(self.now).split())
        self.now = []
        if text and self.inside:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now.append(" ")
        elif tag not in ("b", "i", "a", "em", "strong", "span"):
            self.cut()
            self.inside |= tag == "article"

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a", "em", "strong", "span"):
            self.cut()
            self.inside &= tag != "article"

    def handle_data(self, data):
        self.now.append(data)


def test_extract_query_against_another_parser(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in QUERIES["op10_host_suffix"](spark, SF).collect()}
    for i, h in pages.items():
        reader = Reader()
        reader.feed(h or "")
        assert got[i] == "\n".join(reader.out), i


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    rows = quality.classify(docs, train).join(test, "doc_id").collect()
    clean = [r for r in rows if r.quality and not r.toxic]
    junk = [r for r in rows if not r.quality]
    assert sum(r.kept for r in clean) >= 0.97 * len(clean) and sum(r.kept for r in junk) <= 0.1 * len(junk)
    assert quality.filter_clean(docs, labels).columns == docs.columns


def test_quality_odd_inputs(spark):
    odd = spark.createDataFrame([(1, None, None, "en", 1), (2, "", "a", None, 2), (3, "!!!", "a", "en", 3), (3, "!!!", "a", "en", 3)], "doc_id long, text string, source string, lang string, kept int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(odd, none).count() == 4 and quality.filter_clean(odd, none).count() == 4
    one = spark.createDataFrame([(1, None, 0), (2, 1, 0), (3, 1, None)], "doc_id long, quality int, toxic int")
    assert quality.classify(odd, one).count() == 4 and quality.classify(odd.limit(0), one).count() == 0


def test_shrinkage(spark):
    """A sparse path lies nearer its host than its own share; a sparse host nearer the global share."""
    rows = [("big", "p", 0.9)] * 200 + [("big", "q", 0.1)] * 2 + [("small", "p", 0.1)] * 2 + [("mid", "p", 0.5)] * 100
    scores = spark.createDataFrame([(i, 0, h, p, 0.0, 0.0, c) for i, (h, p, c) in enumerate(rows)], "id long, tag long, host string, path string, p_junk double, p_toxic double, p_clean double")
    got = {(r.host, r.path): r for r in quality.posteriors(scores, 0.5).collect()}
    assert 0.1 < got["big", "q"].path_rate < got["big", "q"].host_rate and got["small", "p"].host_rate > 0.3
    assert abs(got["mid", "p"].path_rate - 0.5) < 0.05


def test_posteriors_against_brute_force(spark):
    """Rates, prior strengths and posteriors, computed row by row."""
    rng = random.Random(12)
    rows = [(i, f"h{rng.randrange(5)}", f"p{rng.randrange(4)}", round(rng.betavariate(3, 1), 6)) for i in range(400)] + [(900, "lone", "p", 0.2)]
    base = 0.8

    def strength(groups):
        n = sum(g[0] for g in groups)
        within = sum(c * m * (1 - m) for c, _, m in groups) / n
        between = max((sum(c * (s / c - m) ** 2 for c, s, m in groups) - len(groups) * within) / n, within * 1e-4)
        return min(1e4, max(2.0, within / between - 1))

    of = lambda k: {g: [r[3] for r in rows if r[1 : 1 + k] == g] for g in {r[1 : 1 + k] for r in rows}}
    hosts, paths, mu = of(1), of(2), sum(r[3] for r in rows) / len(rows)
    m = strength([(len(v), sum(v), mu) for v in hosts.values()])
    k = strength([(len(v), sum(v), (sum(hosts[g[:1]]) + m * mu) / (len(hosts[g[:1]]) + m)) for g, v in paths.items()])
    scores = spark.createDataFrame([(i, 0, h, p, 0.0, 0.0, c) for i, h, p, c in rows], "id long, tag long, host string, path string, p_junk double, p_toxic double, p_clean double")
    got = {r.id: r for r in quality.posteriors(scores, base).collect()}
    odds = lambda p: math.log(p / (1 - p))
    for i, h, p, c in rows:
        host = (sum(hosts[h,]) - c + m * mu) / (len(hosts[h,]) - 1 + m)
        path = (sum(paths[h, p]) - c + k * host) / (len(paths[h, p]) - 1 + k)
        want = 1 / (1 + math.exp(-(odds(c) + odds(path) - odds(base))))
        assert (got[i].host_rate, got[i].path_rate, got[i].posterior) == pytest.approx((host, path, want), abs=1e-9)


def test_features_against_brute_force(spark):
    """A document's junk and toxic evidence, from its text and the fitted weights alone; long, empty and null texts."""
    weights = quality.Model([0.1] * 10, [0.5] * 10, [0.2] * 10 + [-0.5], [1.0, 2.0, 0.5, -1.0], {"bad": 2.5, "^wors": 2.7, "evil": 4.0}, 0.7)
    texts = ["Some BAD bad words, worse worst!", "clean | table | 12\nclean | table | 12", "evil " * 300_000, "", None, "  "]
    df = spark.createDataFrame([(i, t, "h", "p", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, host int, p_junk int")
    got = {r.id: r for r in quality.score(df, weights, "source", "lang").collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        if not w:
            assert got[i].p_junk == pytest.approx(1 - 0.7) and got[i].p_toxic == pytest.approx(1 / (1 + math.exp(1)))
            continue
        lines = [x for x in t.split("\n") if x.strip()]
        x = [math.log1p(len(w)) / 10, 1 - math.log(len(set(w))) / math.log(len(w)), sum(a == b for a, b in zip(w, w[1:], strict=False)) / len(w), min(1, 5 * sum(c in "|!%#*&$@~^<>=+_\\{}[]" for c in t) / len(t)), sum(a.isupper() and len(a) > 1 for a in w) / len(w), min(1, 2 * t.count("|") / len(w)), min(2, (len(t) - len(w) + 1) / len(w) / 10), 1 - len(set(lines)) / len(lines), min(1, 5 * sum(c.isdigit() for c in t) / len(t)), min(1, 10 * (1 - sum(map(len, w)) / len(t)) / 3)]
        plain = {a.strip(".,!").lower() for a in w}
        found = sorted([v for k, v in weights.lexicon.items() if k in plain or k[0] == "^" and any(a.startswith(k[1:]) and len(a) > len(k) - 1 for a in plain)], reverse=True)
        y = [min(1, sum(found[:4]) / 16), min(1, len(found) / 8), 1.0 if found else 0.0]
        sigmoid = lambda v: 1 / (1 + math.exp(-v))
        assert got[i].p_junk == pytest.approx(sigmoid(sum(0.2 * (a - 0.1) / 0.5 for a in x) - 0.5)) and got[i].p_toxic == pytest.approx(sigmoid(y[0] + 2 * y[1] + 0.5 * y[2] - 1)), t


def test_pages_have_hosts_and_paths(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", F.col("html").alias("text"))
    own = quality.with_site(pages).select("url", "host", "path").collect()
    assert all((r.host, r.path) == ((u := urlsplit(r.url)).hostname, u.path.split("/")[1] if "/" in u.path else "") for r in own)
    labels = pages.selectExpr("page_id", "cast(page_id % 3 > 0 as int) as quality", "0 as toxic")
    rows = quality.classify(quality.with_site(pages), labels, host="host", path="path", key="page_id").collect()
    assert len(rows) == len(own) and len({r.host_rate for r in rows}) > 1
    odd = spark.createDataFrame([(1, None), (2, "http://A.b"), (3, "x")], "page_id long, url string")
    assert [(r.host, r.path) for r in quality.with_site(odd).orderBy("page_id").collect()] == [(None, None), ("a.b", ""), ("", "")]


def test_rows_that_share_or_lack_an_id_are_filtered_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels)
    found = quality.classify(docs, labels, model=model).collect()
    good, bad = next(r.doc_id for r in found if r.posterior > 0.95), next(r.doc_id for r in found if r.posterior < 0.05)
    some = docs.where(F.col("doc_id").isin(good, bad))
    odd = some.withColumn("doc_id", F.lit(None).cast("long")).union(some.withColumn("doc_id", F.lit(5).cast("long")))
    assert sorted(((r.doc_id, r.text) for r in quality.filter_clean(odd, labels, model=model).collect()), key=str) == sorted(((i, r.text) for r in some.collect() if r.doc_id == good for i in (None, 5)), key=str)


def test_queries_return_every_row(spark):
    docs, pages = (spark.read.parquet(f"{SF}/{n}.parquet").count() for n in ("documents", "pages"))
    for name, n in (("op3_winnow_decontam", docs), ("op6_kd_shards", docs), ("op9_bayes_quality", docs), ("op8_zip_warc", pages), ("op10_host_suffix", pages)):
        assert QUERIES[name](spark, SF).count() == n, name
