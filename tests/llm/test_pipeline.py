"""corpus_pipeline.run() against a brute-force version of what follows the classifier."""

import re

import corpus_pipeline
from loomalign.llm import quality
from loomalign.llm.common import py_words
from test_omh import brute_shingles, lcs
from test_table_ops import brute_report
from test_text_ops import whole_ids

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    good = {r.doc_id for r in quality.classify(docs, labels).where("kept").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in good)
    first = {}
    for i, t in rows:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    rows = [(i, t) for i, t in rows if i in set(first.values())]
    label, grams = {i: i for i, _ in rows}, {i: brute_shingles(t) for i, t in rows}
    sets = {i: set(g) for i, g in grams.items()}
    for n, (i, t) in enumerate(rows):
        for j, u in rows[:n]:
            a, b = grams[i], grams[j]
            if a == b and a:
                near = True
            elif not a or not b or min(len(a), len(b)) < 0.8 * max(len(a), len(b)) or len(sets[i] & sets[j]) < 0.3 * len(sets[i] | sets[j]):
                near = False
            else:
                m = lcs(a, b)
                near = m / (len(a) + len(b) - m) >= 0.8
            if near:
                x, y = sorted((label[i], label[j]))
                label = {k: x if v == y else v for k, v in label.items()}
    rows = [(i, t) for i, t in rows if label[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [x for x, (n, hit, _) in zip(rows, brute_report([t for _, t in rows], items), strict=True) if not (hit and 20 * hit >= n)]
    got = {}
    for p in corpus_pipeline.run(spark, SF).collect():
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    want = {i: len(x) for (i, _), x in zip(rows, whole_ids("byte_bpe_50k.json", [t for _, t in rows]), strict=True)}
    assert got == want and len(want) < 200
    assert py_words(None) == []


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(40).selectExpr("*", "1 as kept", "'x' as class_id", "2 as digest", "3 as host")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, SF)
        assert out.columns == extra.columns and out.count() <= 40
        assert stage(spark, extra.limit(0), SF).count() == 0


def test_rows_that_share_or_lack_an_id(spark):
    """Every stage judges rows apart: of equal texts one row stays, others with the same or no id stay or go on their own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality_ids = [r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("posterior > 0.9").orderBy("doc_id").collect()]
    a, b = [r.text for r in docs.where(docs.doc_id.isin(quality_ids)).orderBy("n_chars", ascending=False).limit(2).collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    near = a + " more"
    rows = [(None, a, "en", "s", 1), (None, a, "en", "s", 1), (None, b, "en", "s", 1), (7, item, "en", "s", 1), (7, b + " x", "en", "s", 2), (7, near, "en", "s", 3), (8, None, "en", "s", 0)]
    df = spark.createDataFrame(rows, docs.schema).repartition(3)
    stage = dict(corpus_pipeline.STAGES)
    texts = lambda out: sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert texts(stage["exact_dedup"](spark, df, SF)) == sorted({r[:2] for r in rows}, key=str)
    assert texts(stage["near_dedup"](spark, df, SF)) == sorted([(7, near), (7, b + " x"), (7, item), (8, None)], key=str)
    assert texts(stage["decontamination"](spark, df, SF)) == sorted([r[:2] for r in rows if r[1] != item], key=str)
    assert (None, b) in texts(stage["quality"](spark, df.union(docs), SF))
