"""Operator 7 against brute force over all pairs."""

import random

import numpy as np
import pytest

from loomalign.llm import omh
from loomalign.llm.common import py_words


def brute_shingles(text):
    w = py_words(text)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_classes(texts, least=0.8):
    s, parent = [brute_shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = s[i], s[j]
            same = (texts[i] or "") == (texts[j] or "") if not a or not b else a == b
            if not same and a and b and min(len(a), len(b)) >= least * max(len(a), len(b)):
                m = lcs(a, b)
                same = m / (len(a) + len(b) - m) >= least
            if same:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(texts))]


def corpus(rng, n=25):
    words = [f"w{i}" for i in range(300)] + ["É", "é", "x"]
    say = lambda k: [rng.choice(words) for _ in range(k)]
    out = [None, "", "", "!!", "??", "one", "One", "a b c", "a b d", "x " * 50, "x " * 51, "x " * 80]
    for _ in range(n):
        base = say(rng.randrange(30, 200))
        out.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            w = list(base)
            for _ in range(rng.randrange(1, 6)):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = say(rng.randrange(3))
            out.append(rng.choice([" ", "  ", "-"]).join(w).replace("w1", "W1"))
        half = len(base) // 2
        out.append(" ".join(base[half:] + base[:half]))  # the same shingles in another order
    return out


def test_near_classes(spark):
    rng = random.Random(11)
    texts = corpus(rng)
    texts += texts[:20]
    df = spark.createDataFrame([(i, t, 0, "q") for i, t in enumerate(texts)], "doc_id long, text string, n long, digest string").repartition(4)
    got = {r.doc_id: r for r in omh.near_classes(df).collect()}
    want = brute_classes(texts)
    assert [got[i].class_id for i in range(len(texts))] == want
    assert all(got[i].class_size == want.count(want[i]) and got[i].kept == (want[i] == i) for i in range(len(texts)))
    assert omh.near_classes(df.limit(0)).count() == 0


def test_alignment():
    rng = random.Random(2)
    for _ in range(400):
        a = [rng.randrange(40) for _ in range(rng.randrange(1, 60))]
        b = list(a)
        for _ in range(rng.randrange(8)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(3)] = [rng.randrange(40) for _ in range(rng.randrange(3))]
        if not b:
            continue
        m = lcs(a, b)
        want = m / (len(a) + len(b) - m)
        got = omh.alignment(np.array(a, "<u4"), np.array(b, "<u4"), 0.8)
        assert abs(got - want) < 1e-12 if want >= 0.8 else got == 0.0


def test_words_and_shingles_follow_the_texts():
    texts = ["Ab c", "", "ab-C", "é É", "a" * 300 + " b", "ab c d e f g", "ab c d e f", "É"]
    data = [t.encode().lower() for t in texts]
    words, n = omh.word_hashes(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert n.tolist() == [len(py_words(t)) for t in texts]
    flat = [w for t in texts for w in py_words(t)]
    assert all((words[i] == words[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))
    value, k = omh.shingles(words, n)
    grams = [g for t in texts for g in brute_shingles(t)]
    assert k.tolist() == [len(brute_shingles(t)) for t in texts] and all((value[i] == value[j]) == (grams[i] == grams[j]) for i in range(len(grams)) for j in range(len(grams)))


def test_order_counts():
    """Equal shingle sets in another order share few sketches, equal sequences all of them."""
    rng = np.random.default_rng(0)
    v = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    n = np.array([400, 400])
    same = omh.sketches(np.concatenate([v, v]), n)
    other = omh.sketches(np.concatenate([v, v[::-1]]), n)
    assert (same[0] == same[1]).all() and (other[0] == other[1]).sum() == 0


def test_large_batches_are_read_whole(spark):
    """A batch that is cut into several slices gives the same counts as its texts alone."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["Ab", "cé", "d"]) + str(rng.randrange(999)) for _ in range(40_000)) for _ in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[-2:])], "doc_id long, text string").coalesce(1)
    got = {r.id: (r.n, bytes(r.digest)) for r in omh.read_texts(df).select("id", "n", "digest").collect()}
    assert all(got[i][0] == len(py_words(t)) - 4 for i, t in enumerate(texts)) and len({d for _, d in got.values()}) == 30 and got[28][1] == got[30][1]


def test_pairs_inside_a_loose_bucket(spark):
    """Variants of one text share sketches, few of them are near each other: all such pairs count, drawn or not."""
    rng, n, size = np.random.default_rng(5), 400, 200
    base, texts, whole = [f"b{i}" for i in range(size)], [], np.ones((n, size - 4), bool)
    for i in range(n):
        words = list(base)
        for k in rng.choice(size, 4, replace=False).tolist():
            words[k] = f"v{i}x{k}"
            whole[i, max(0, k - 4) : k + 1] = False
        texts.append(" ".join(words))
    same = whole.astype(int) @ whole.T.astype(int)  # words are distinct: shingles that neither text has changed
    near, label = same >= 0.8 * (2 * (size - 4) - same) - 1e-9, np.arange(n)
    while ((new := np.where(near, label, n).min(axis=1)) != label).any():
        label = new
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in omh.near_classes(df).collect()}
    assert n / 4 < len(set(label.tolist())) < n and [got[i] for i in range(n)] == label.tolist()


@pytest.mark.parametrize("worth", [4, 0])
def test_closure_over_variants_of_one_text(spark, monkeypatch, worth):
    """Many texts of one base: the classes are those of all pairs, whether draws come first (worth 0) or not."""
    monkeypatch.setattr(omh, "WORTH", worth)
    n = 250
    rng = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    base, texts = [rng.choice(words) for _ in range(120)], []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(120)] = rng.choice(words)
        texts.append(" ".join(w))
    number: dict = {}
    s = [np.array([number.setdefault(g, len(number)) for g in brute_shingles(t)], "<u4") for t in texts]
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if label[i] != label[j] and omh.alignment(s[i], s[j], 0.8):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in omh.near_classes(df).collect()}
    assert [got[i] for i in range(n)] == label and 1 < len(set(label)) < n


def test_rows_that_share_or_lack_an_id(spark):
    """One row of a class stays, whatever the ids; rows with one id and different texts are judged apart."""
    long = " ".join(f"a{i}" for i in range(60))
    other = " ".join(f"b{i}" for i in range(60))
    rows = [(1, long), (1, other), (1, other + " x"), (None, long), (None, "solo text of its own words here"), (2, None), (2, ""), (None, long + " y")]
    df = spark.createDataFrame([(*r, 0, "c") for r in rows], "doc_id long, text string, row long, part string").coalesce(1)
    got = [(r.doc_id, r.class_id, r.class_size, r.n_texts, r.kept) for r in omh.near_classes(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 3, 2, True), (1, 1, 2, 2, True), (1, 1, 2, 2, False), (None, 1, 3, 2, False), (None, None, 1, 1, True), (2, 2, 2, 1, True), (2, 2, 2, 1, False), (None, 1, 3, 2, False)], key=str)


def test_sketches_of_very_long_texts():
    """Beyond 2 ** 24 shingles positions still count: the order of the picks is the text's."""
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 62, (1 << 24) + 9).astype(np.uint64)
    same = omh.sketches(np.concatenate([v, v]), np.array([len(v)] * 2), bands=2)
    assert (same[0] == same[1]).all() and (omh.sketches(v[::-1].copy(), np.array([len(v)]), bands=2) != same[:1]).all()
