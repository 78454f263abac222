"""Toxicity by non-negative positive-unlabelled learning.

A linear logistic classifier over hashed words and word beginnings is trained in numpy from confirmed toxic texts and
unlabelled ones. Its risk is prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)): where the second part would fall below
zero, which only overfitting brings about, its gradient is turned round. The class prior is counted over all labels of
the training folds; confirmed texts and unlabelled ones come from the same labelled rows outside the held-out fold, the latter
without their labels, as the prior is theirs: toxic texts are rarer among all documents. Both are bounded by max_rows. Which
features tell the two apart is counted by grouped aggregation over that sample, and only these
reach the driver. All texts are scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, tune
from .textkernels import PUNCT, U64, hash_words, tidy

BITS = 18
HEAD = 5


def buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of each text, concatenated, and where each text's start."""
    words, first, heads = hash_words(texts, PUNCT, HEAD)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n), dtype=np.int64), n)
    own = np.concatenate([words >> U64(64 - BITS), heads[heads != 0] >> U64(64 - BITS)]).astype(np.int64)
    key = np.unique(np.concatenate([doc, doc[heads != 0]]) << BITS | own)
    return (key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key >> BITS, np.arange(len(n) + 1))


def choose(confirmed: np.ndarray, unlabelled: np.ndarray, n_pos: int, n_unl: int, most: int) -> np.ndarray:
    """The buckets, by number of texts that hold them, whose shares differ by over four deviations: `most` of the clearest."""
    rp, ru = confirmed / n_pos, unlabelled / n_unl
    clear = np.abs(rp - ru) / np.sqrt((ru + 1 / n_unl) * (1 / n_pos + 1 / n_unl))
    use = np.flatnonzero((clear > 4) & (confirmed + unlabelled >= 10))
    return np.sort(use[np.argsort(-clear[use], kind="stable")[:most]])


def train(pos: list[np.ndarray], unl: list[np.ndarray], width: int, prior: float, steps: int = 500, rate: float = 0.1, l2: float = 1e-5) -> np.ndarray:
    """Weights of `width` features, and last the bias, from the features' numbers in confirmed and unlabelled texts."""
    flat = lambda rows: (np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows))
    p, u = flat(pos), flat(unl)
    theta, m, v = np.zeros(width + 1), 0.0, 0.0
    theta[-1] = np.log(prior / (1 - prior))
    score = lambda x: np.bincount(x[1], weights=theta[x[0]], minlength=x[2]) + theta[-1]

    def gradient(x, g):
        out = np.empty_like(theta)
        out[:-1] = np.bincount(x[0], weights=g[x[1]], minlength=width)
        out[-1] = g.sum()
        return out / x[2]

    for t in range(1, steps + 1):
        sp, su = score(p), score(u)
        yp, yu = _sigmoid(sp), _sigmoid(su)
        negative = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
        g_neg = gradient(u, yu) - prior * gradient(p, yp)
        g = prior * gradient(p, yp - 1) + g_neg if negative >= 0 else -g_neg
        g[:-1] += l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return theta


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, max_features: int = 1 << 14) -> tuple[np.ndarray, float]:
    """(weights by bucket, bias), learnt from labels(doc_id, toxic) of the rows not held out: the toxic ones, and all without
    their labels.

    max_rows bounds the confirmed toxic and the unlabelled texts, max_features the features of each that the driver gets; the
    rows taken are those of the smallest hashes of their ids. Labels that are null or have no text are ignored; of repeated
    labels of a document the largest counts, of texts that share an id the smallest. Without confirmed or without unlabelled
    texts all weights are 0 and the bias is the prior's logit.
    """
    tune(docs.sparkSession)
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    n, toxic = own.agg(F.count("*"), F.sum((F.col("toxic") > 0).cast("long"))).first()
    prior = min(max((toxic or 0) / max(n, 1), 1e-4), 0.99)
    weights, bias = np.zeros(1 << BITS), float(np.log(prior / (1 - prior)))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    pos = own.where("toxic > 0").orderBy(*order).limit(max_rows).select("doc_id", F.lit(1).alias("p"))
    unl = own.orderBy(*order).limit(max_rows).select("doc_id", F.lit(0).alias("p"))  # the texts whose class prior is counted
    chosen = F.broadcast(pos.unionByName(unl))  # at most 2 * max_rows ids

    def features(batches):
        for b in batches:
            x, at = buckets(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32()))], ["p", "x"])

    texts = rows.join(chosen, "doc_id").groupBy("doc_id", "p").agg(F.min("text").alias("text"))
    sample = cut(texts.select("p", "text").mapInArrow(tidy(features), "p int, x array<int>"))
    size = {r.p: r.n for r in sample.groupBy("p").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(size) < 2:
        return weights, bias
    held = sample.select("p", F.explode("x").alias("b")).groupBy("b").agg(F.sum("p").alias("pos"), F.count_if(F.col("p") == 0).alias("unl")).toArrow()  # a row a bucket
    count = np.zeros((2, 1 << BITS))
    at = held.column("b").to_numpy()
    count[0, at], count[1, at] = held.column("pos").to_numpy(), held.column("unl").to_numpy()
    use = choose(count[0], count[1], size[1], size[0], max_features)
    to = np.full(1 << BITS, -1, dtype=np.int32)
    to[use] = np.arange(len(use), dtype=np.int32)

    def shrink(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[x >= 0] for x in (to[r.values.to_numpy()] for r in b.column(1))], pa.list_(pa.int32()))], ["p", "x"])

    got = sample.mapInArrow(shrink, "p int, x array<int>").toArrow()
    forget(sample)
    parts = ([], [])
    for p, x in zip(got.column("p").to_pylist(), got.column("x")):
        parts[p].append(x.values.to_numpy())
    theta = train(parts[1], parts[0], len(use), prior)
    weights[use] = theta[:-1]
    return weights, float(theta[-1])


def scores(texts: list[str | None], weights: np.ndarray, bias: float) -> np.ndarray:
    """Of each text, whatever stands beside it."""
    x, at = buckets(texts)
    n = len(at) - 1
    return _sigmoid(np.bincount(np.repeat(np.arange(n), np.diff(at)), weights=weights[x], minlength=n) + bias)


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text, ...). A null or empty text scores by the bias
    alone, a very long one by all its words. A null doc_id is kept, and not held out. Repeated rows, and texts with the
    same words (ties), score alike; a score equal to the threshold is toxic. An empty table gives no rows; extra columns
    are ignored."""
    tune(docs.sparkSession)
    where = np.flatnonzero(model[0])
    small, bias = (where, model[0][where]), model[1]

    def run(batches):
        w = np.zeros(1 << BITS)
        w[small[0]] = small[1]
        for b in batches:
            s = scores(b.column(1).to_pylist(), w, bias)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, that `score` doesn't predict to be toxic; nulls, empty and long texts as there."""
    tune(docs.sparkSession)
    where = np.flatnonzero(model[0])
    small, bias = (where, model[0][where]), model[1]
    at = docs.columns.index("text")

    def run(batches):
        w = np.zeros(1 << BITS)
        w[small[0]] = small[1]
        for b in batches:
            yield b.filter(pa.array(scores(b.column(at).cast(pa.string()).to_pylist(), w, bias) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
