"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

Document evidence: two logistic heads, one for low quality (shape of the text: repetition, symbols, capitals, tables) and
one for toxic text (words and word beginnings that a labelled sample shows to be far likelier in toxic documents). They
are fitted on at most sample_rows labelled rows, chosen by hash of the id. The model itself is of bounded size: a lexicon of
at most lexicon_rows words and beginnings of 4 or 5 letters (those with the strongest evidence), of which a document's
TOP_KEYS strongest count. Every document is scored, over its whole text.

Site evidence: the share of clean documents of a host is a beta-binomial posterior around the global share, and the share
of a path inside the host one around the host's; the prior strengths are estimated by moments from the spread of the
groups' shares over all documents. A sparse path thus falls back on its host and a sparse host on the global share. Each
document is left out of its own groups' counts. The posterior odds of a document are its evidence times the odds of its
path, over the odds of the labelled rows.

Hosts and paths are any two columns; with_site() takes them from a url. A table without urls, like documents, has its source
as the host and its lang as the path inside it. Defined cases: a null or empty text has zero features; null hosts and paths
form groups of their own; repeated rows, and rows with null or repeated ids, count each; texts of any length are read whole; without labels (or with one class
only) a head is silent and everything is kept; a null label is no label; an empty table gives an empty result; columns
other than those named are ignored by classify() and kept by filter_clean().
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomalign.llm.common import row_tag, rows_of, slices, stored, tidy

FEATURES = ("log_words", "distinct", "adjacent", "symbols", "capitals", "tables", "word_length", "lines", "digits", "letters")
TOP_KEYS = 4
_STRIP = ".,;:!?\"'()[]{}«»“”"
_SYMBOLS = "|!%#*&$@~^<>=+_\\{}[]"


def shape(text: str, words: list[str], distinct: set[str]) -> list[float]:
    """Features of a text's shape, each near 0 to 1; zeros for an empty text."""
    import math

    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lines = [x for x in text.split("\n") if x.strip()]
    chars = len(text)
    return [
        math.log1p(n) / 10,
        1 - math.log(len(distinct)) / math.log(n) if n > 1 else 0.0,
        sum(map(str.__eq__, words, words[1:])) / n,
        min(1.0, 5 * sum(map(text.count, _SYMBOLS)) / chars),
        sum(w.isupper() and len(w) > 1 for w in words) / n,
        min(1.0, 2 * text.count("|") / n),
        min(2.0, (chars - n + 1) / n / 10),
        1 - len(set(lines)) / len(lines),
        min(1.0, 5 * sum(map(text.count, "0123456789")) / chars),
        min(1.0, 10 * (1 - sum(len(w) for w in words) / max(1, chars)) / 3),
    ]


def keys(distinct: set[str]) -> set[str]:
    """Words without outer punctuation, lower-cased, and their beginnings of 4 and 5 letters."""
    out = {w.strip(_STRIP).lower() for w in distinct}
    out |= {"^" + w[:k] for w in list(out) for k in (4, 5) if len(w) > k}
    out.discard("")
    return out


@dataclass
class Model:
    """heads: weights on the standardised features and the lexicon's evidence; lexicon: log odds of the toxic keys."""

    mean: list[float]
    scale: list[float]
    junk: list[float] | None = None
    toxic: list[float] | None = None
    lexicon: dict[str, float] = field(default_factory=dict)
    base: float = 0.5

    def features(self, text: str | None) -> tuple[list[float], list[float]]:
        text = text or ""
        words = text.split()
        distinct = set(words)
        return shape(text, words, distinct), toxic_evidence(distinct, len(words), self.lexicon)


def toxic_evidence(distinct: set[str], n: int, lexicon: dict[str, float]) -> list[float]:
    if not lexicon or not n:
        return [0.0, 0.0, 0.0]
    found = sorted((lexicon[k] for k in keys(distinct) if k in lexicon), reverse=True)
    return [min(1.0, sum(found[:TOP_KEYS]) / (4 * TOP_KEYS)), min(1.0, len(found) / 8), 1.0 if found else 0.0]


def logistic(x, y, ridge: float = 1e-2, rounds: int = 50):
    """Weights of a ridge logistic regression by Newton steps; the last is the intercept. None for a single class."""
    import numpy as np

    if len(y) == 0 or y.min() == y.max():
        return None
    a = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(a.shape[1]), ridge * len(y) * np.append(np.ones(x.shape[1]), 0) / 100
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-6), a.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def _keyed(batches, body):
    import pyarrow as pa

    for batch in batches:
        for s in slices(batch):
            out = [body(t) for t in s.column("_t").to_pylist()]
            yield s, pa, out
    tidy()


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", good: str = "quality", toxic: str = "toxic", sample_rows: int = 12_000, lexicon_rows: int = 2_000, least: int = 5, ratio: float = 12.0) -> Model:
    """Fit on the labelled rows with the smallest hashes of their ids, sample_rows at most.

    The lexicon keeps keys of at least `least` toxic documents whose rate there is `ratio` times the rate elsewhere.
    """
    import numpy as np

    chosen = labels.select(F.col(key).alias("_id"), F.col(good).cast("double").alias("_good"), F.col(toxic).cast("double").alias("_toxic")).where("_good is not null and _toxic is not null").dropDuplicates(["_id"])
    chosen = stored(chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows), "sample")
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_id")  # sample_rows at most

    def run(batches):
        def one(t):
            words = (t or "").split()
            distinct = set(words)
            return shape(t or "", words, distinct), len(words), sorted(keys(distinct))

        for s, pa, out in _keyed(batches, one):
            yield pa.record_batch([s.column("_good"), s.column("_toxic"), pa.array([x for x, _, _ in out], pa.list_(pa.float64())), pa.array([n for _, n, _ in out], pa.int64()), pa.array([k for _, _, k in out], pa.list_(pa.string()))], names=["good", "toxic", "shape", "n", "keys"])

    seen = stored(rows.mapInArrow(run, "good double, toxic double, shape array<double>, n long, keys array<string>"), "labelled")
    n1, n0 = (seen.where(F.col("toxic") == v).count() for v in (1, 0))
    lexicon: dict[str, float] = {}
    if n1 and n0:
        counts = seen.select("toxic", F.explode("keys").alias("k")).groupBy("k").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where(F.col("a") >= least)
        odds = F.log((F.col("a") + 0.1) / (n1 + 0.2)) - F.log((F.col("b") + 0.1) / (n0 + 0.2))
        found = counts.withColumn("o", odds).where(F.col("o") >= float(np.log(ratio))).orderBy(F.desc(F.col("o") * F.sqrt("a")), "k").limit(lexicon_rows)
        lexicon = {r["k"]: r["o"] for r in found.collect()}
    x, y, z, evidence = [], [], [], []
    for r in seen.select("good", "toxic", "shape", "n", "keys").toLocalIterator():  # sample_rows at most
        x.append(r["shape"])
        y.append(1 - r["good"])
        z.append(r["toxic"])
        found = sorted((lexicon[k] for k in r["keys"] if k in lexicon), reverse=True)
        evidence.append([min(1.0, sum(found[:TOP_KEYS]) / (4 * TOP_KEYS)), min(1.0, len(found) / 8), 1.0 if found else 0.0] if r["n"] else [0.0] * 3)
    if not x:
        return Model([0.0] * len(FEATURES), [1.0] * len(FEATURES))
    x, y, z = np.array(x), np.array(y), np.array(z)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    return Model(mean.tolist(), scale.tolist(), logistic((x - mean) / scale, y), logistic(np.array(evidence), z), lexicon, float(np.clip(((y == 0) & (z == 0)).mean(), 0.01, 0.99)))


def with_site(pages: DataFrame, url: str = "url", host: str = "host", path: str = "path") -> DataFrame:
    """pages with the host of a url and the first part of its path; null urls have neither, a url without a path has ''."""
    return pages.withColumns({host: F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), path: F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)})


def score(docs: DataFrame, model: Model, host: str, path: str, key: str = "doc_id", text: str = "text", tag: Column | None = None) -> DataFrame:
    """(id, tag, host, path, p_junk, p_toxic, p_clean) of every row, stored."""

    def run(batches):
        import numpy as np

        mean, scale = np.array(model.mean), np.array(model.scale)

        def head(w, x):
            return np.zeros(len(x)) if w is None else 1 / (1 + np.exp(-np.clip(x @ np.array(w[:-1]) + w[-1], -30, 30)))

        for s, pa, out in _keyed(batches, model.features):
            empty = np.array([not any(x) for x, _ in out], bool)
            junk = np.where(empty, 1 - model.base, head(model.junk, (np.array([x for x, _ in out]).reshape(len(out), -1) - mean) / scale))
            bad = head(model.toxic, np.array([e for _, e in out]).reshape(len(out), 3))
            if model.junk is None:
                junk[:] = 0
            yield pa.record_batch([s.column("_id"), s.column("_g"), s.column("_h"), s.column("_p"), pa.array(junk), pa.array(bad), pa.array((1 - junk) * (1 - bad))], names=["id", "tag", "host", "path", "p_junk", "p_toxic", "p_clean"])

    rows = docs.select(F.col(key).alias("_id"), F.lit(0).cast("long").alias("_g") if tag is None else tag.alias("_g"), F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("_h"), F.coalesce(F.col(path).cast("string"), F.lit("\0")).alias("_p"), F.col(text).alias("_t"))
    kind = dict(docs.dtypes)[key]
    return stored(rows.mapInArrow(run, f"id {kind}, tag long, host string, path string, p_junk double, p_toxic double, p_clean double"), "scores")


def strength(groups: DataFrame) -> float:
    """Prior strength of a beta distribution by moments: groups has n, s (expected clean documents) and m (the mean they shrink to)."""
    r = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("m"), 2)).alias("v"), F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("w"), F.count(F.lit(1)).alias("g")).first()
    if not r["n"] or r["g"] < 2 or not r["w"]:
        return 100.0
    within = r["w"] / r["n"]
    between = max((r["v"] - r["g"] * within) / r["n"], within * 1e-4)
    return float(min(1e4, max(2.0, within / between - 1)))


def posteriors(scores: DataFrame, base: float) -> DataFrame:
    """scores with host_rate, path_rate and posterior; grouped aggregation only, hot groups are summed up before they are dealt out."""
    paths = stored(scores.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p_clean").alias("s")), "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mu = min(0.999, max(0.001, total["s"] / total["n"])) if total["n"] else base
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    m = strength(hosts.select(F.col("hn").alias("n"), F.col("hs").alias("s"), F.lit(mu).alias("m")))
    shares = paths.join(hosts, "host").withColumn("hm", (F.col("hs") + m * mu) / (F.col("hn") + m))
    k = strength(shares.select("n", "s", F.col("hm").alias("m")))
    shares = stored(shares, "shares")  # written, so that the join of a hot site can be split or done by broadcast
    out = scores.join(shares, ["host", "path"])
    host_rate = (F.col("hs") - F.col("p_clean") + m * mu) / (F.col("hn") - 1 + m)
    path_rate = (F.col("s") - F.col("p_clean") + k * F.col("host_rate")) / (F.col("n") - 1 + k)
    odds = lambda p: F.log(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9)))
    out = out.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    return out.withColumn("posterior", 1 / (1 + F.exp(-(odds(F.col("p_clean")) + odds(F.col("path_rate")) - F.lit(odds_of(base))))))


def odds_of(p: float) -> float:
    import math

    return math.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", key: str = "doc_id", text: str = "text", threshold: float = 0.5, model: Model | None = None, tag: Column | None = None) -> DataFrame:
    """One row per row of docs: key, p_junk, p_toxic, host_rate, path_rate, posterior (of being clean), kept; and the row's tag, if it is given."""
    model = model or fit(docs, labels, key, text)
    found = posteriors(score(docs, model, host, path, key, text, tag), model.base)
    return found.select(F.col("id").alias(key), *[F.round(c, 6).alias(c) for c in ("p_junk", "p_toxic", "host_rate", "path_rate", "posterior")], (F.col("posterior") >= threshold).alias("kept"), *(["tag"] if tag is not None else []))


def filter_clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns."""
    return rows_of(docs, classify(docs, labels, key=key, tag=row_tag(docs), **options).where("kept"), key)
