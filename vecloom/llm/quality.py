"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic regression on features of the whole text, of its form and its hashed words
and word pairs, gives each document's own evidence. Its mean over a host (here a source) is shrunk toward the global mean,
and that over a path of the host (here a language of the source) toward the
host's, with strengths estimated from how much hosts and paths really differ. A
document's posterior odds are its likelihood ratio times its path's odds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import materialize

SAMPLE = 6_000  # labelled rows that the classifier is fitted on at most, about; the driver holds 2 KB of each
_EDGE = 1e-6  # probabilities stay this far from 0 and 1
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
FORM, CONTENT = 14, 512
FEATURES = FORM + CONTENT


def features(text: str | None) -> np.ndarray:
    """Numbers that describe the whole text's form, then the log counts of its hashed words and word pairs, of length 1; an empty or null text gives zeros."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return np.zeros(FEATURES)
    hist = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    size, n = len(data), len(words)
    letters = hist[_UPPER].sum() + hist[_LOWER].sum() + hist[128:].sum()
    distinct = len(set(words))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    lines = data.split(b"\n")
    marks = sum(int(hist[ord(c)]) for c in "#$%&*@^~=<>{}[]\\_")
    hashes = hashing.word_hashes(data.lower())
    hashes = np.concatenate([hashes, hashing.shingle_hashes(hashes, 2)])
    content = np.log1p(np.bincount((hashing.mix(hashes, 3) & np.uint64(CONTENT - 1)).astype(np.int64), minlength=CONTENT))
    form = np.array([
        np.log1p(n), size / n / 10, hist[_UPPER].sum() / max(letters, 1), letters / size, hist[_DIGIT].sum() / size,
        min(hist[ord("!")] / n, 2), min(hist[ord("|")] / n, 2), min(marks / n, 4), min((hist[ord(".")] + hist[ord(",")]) / n, 2),
        distinct / n, np.log1p(distinct) - np.log1p(n) * 0.8, repeats / n, len(set(lines)) / len(lines), min(len(lines) / n * 10, 5),
    ])
    return np.concatenate([form, content / np.sqrt((content * content).sum())])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, content_ridge: float = 10.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's steps, form standardised: (mean, scale, weights with the intercept last)."""
    mean, scale = np.zeros(FEATURES), np.ones(FEATURES)
    mean[:FORM], scale[:FORM] = x[:, :FORM].mean(axis=0), x[:, :FORM].std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    keep = np.array([ridge] * FORM + [content_ridge] * CONTENT + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def train(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fits on about SAMPLE labelled rows, chosen by a hash of the id; only their features reach the driver.

    Without both labels there's nothing to tell apart: all documents then get the
    labels' share of good ones (one half without labels).
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    n = known.count()
    share = min(1.0, SAMPLE / max(n, 1))
    some = known.where(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(1_000_000)) < int(1_000_000 * share))
    some = some.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("double")).alias("_y"))
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(some), "_id")
    got = rows.select(_feature_udf()(F.col("_text")).alias("x"), "_y").toPandas().sort_values(["_y", "x"])  # in one order, for one sum
    y = got["_y"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        good = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(FEATURES), np.ones(FEATURES), np.array([0.0] * FEATURES + [np.log(good / (1 - good))])
    return fit(np.frombuffer(b"".join(got["x"]), dtype="<f4").reshape(-1, FEATURES).astype(float), (y > 0.5).astype(float))


def _feature_udf():
    """The features as bytes of 32-bit floats: two kilobytes a row for the driver."""

    @F.arrow_udf("binary")
    def run(text: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()).astype("<f4").tobytes() for t in text], pa.binary())

    return run


def score(model: tuple[np.ndarray, np.ndarray, np.ndarray], text: Column) -> Column:
    """The classifier's probability of a good document, kept off 0 and 1."""
    mean, scale, w = model

    @F.arrow_udf("double")
    def run(text: pa.Array) -> pa.Array:
        z = np.array([((features(t.as_py()) - mean) / scale * w[:-1]).sum() for t in text], dtype=float) + w[-1]
        return pa.array(np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), _EDGE, 1 - _EDGE))

    return run(text)


def _strength(groups: DataFrame, around: str) -> float:
    """Pseudo-counts of the prior of (k, n) groups around a mean, by the method of moments, between 1 and 10,000."""
    r = F.col("k") / F.col("n")
    m = F.col(around)
    row = groups.agg(F.sum(F.col("n") * (r - m) ** 2).alias("spread"), F.sum(m * (1 - m)).alias("chance"), F.sum("n").alias("n"), F.sum(F.col("n") * m * (1 - m)).alias("var")).first()
    if not row.n:
        return 1.0
    between = max((row.spread - row.chance) / row.n, 1e-9)
    return float(min(max(row["var"] / row.n / between - 1, 1.0), 10_000.0))


def path_table(scores: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, p_host, p_path) from (host, path, p_doc) of all documents, and the global mean."""
    paths = materialize(scores.groupBy("host", "path").agg(F.sum("p_doc").alias("k"), F.count("*").cast("double").alias("n")), "paths")
    row = paths.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    overall = float(row.k / row.n) if row.n else 0.5
    hosts = paths.groupBy("host").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).withColumn("m", F.lit(overall))
    c = _strength(hosts, "m")
    hosts = materialize(hosts.select("host", ((F.col("k") + c * F.col("m")) / (F.col("n") + c)).alias("p_host")), "hosts")
    both = paths.join(hosts, "host")
    d = _strength(both, "p_host")
    out = both.select("host", "path", "p_host", ((F.col("k") + d * F.col("p_host")) / (F.col("n") + d)).alias("p_path"))
    return materialize(out, "posteriors"), overall


def _posterior(overall: float) -> Column:
    logit = lambda p: F.log(p / (1 - p))
    return 1 / (1 + F.exp(-(logit(F.col("p_doc")) - logit(F.lit(overall)) + logit(F.col("p_path")))))


def judged(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", least: float = 0.5) -> DataFrame:
    """(row, p_doc, p_host, p_path, p_quality, keep): each row of ``df`` as a struct, so that no column's name can clash.

    Null hosts and paths count as ''. Null and empty texts have all features 0 and
    are judged like others. Rows that repeat an id are judged one by one; a label
    given twice counts as good if one is. An empty table gives no rows. The texts are read
    three times: once for the sample's features, once to sum evidence, once to judge.
    They aren't shuffled while the table of hosts and paths, a few numbers each, is below the
    session's broadcast threshold; beyond it rows are dealt by host and path, and AQE
    splits what is hot.
    """
    model = train(df, labels, id_col, text_col, label_col)
    key = lambda c: F.coalesce(F.col("row")[c].cast("string"), F.lit(""))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    scored = rows.select("row", key(host_col).alias("host"), key(path_col).alias("path"), score(model, F.col("row")[text_col]).alias("p_doc"))
    posteriors, overall = path_table(scored.select("host", "path", "p_doc"))
    out = scored.join(posteriors, ["host", "path"]).withColumn("p_quality", _posterior(overall))
    return out.select("row", "p_doc", "p_host", "p_path", "p_quality", (F.col("p_quality") >= least).alias("keep"))


def report(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, p_doc, p_host, p_path, p_quality, keep) for each row."""
    found = judged(df, labels, id_col, **options)
    return found.select(F.col("row")[id_col].alias(id_col), "p_doc", "p_host", "p_path", "p_quality", "keep")


def keep_good(df: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that the classifier keeps, with the columns of ``df``, whatever their names; an empty table stays empty, see judged() for odd rows."""
    return judged(df, labels, **options).where("keep").select(*[F.col("row")[c].alias(c) for c in df.columns])
