"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard of bounded size.

Equal vectors collapse to one before indexing. Each shard's graph is grown in batches: beam searches from the entry point
propose neighbours, relaxed distance pruning (alpha) keeps diverse ones, back edges are pruned alike. A query walks the
graph of every shard by beam search; its best from all shards are merged. Shards grow with the square root of the rows,
from `shard` to `largest` vectors, and queries come to a shard in blocks of some thousands: an index is copied once a block.
So both the walks a query takes and the copies of an index grow more slowly than the table, until shards are at their
largest. Distances for the graph are Euclidean after the usual extension that turns the largest inner product into the
smallest distance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tune

DEGREE, BEAM, ALPHA, SHARD, LARGEST, QUERIES = 32, 64, 1.2, 4096, 65536, 8192


def _walk(x: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all rows of q at once: ids and squared distances (without |q|^2) of each beam, nearest first; -1 pads."""
    m = len(q)
    norm = (x * x).sum(axis=1)
    ids = np.full((m, beam), -1, dtype=np.int64)
    dist = np.full((m, beam), np.inf, dtype=np.float32)
    done = np.ones((m, beam), dtype=bool)
    ids[:, 0], dist[:, 0], done[:, 0] = entry, norm[entry] - 2 * (q @ x[entry]), False
    seen = np.zeros((m, len(x)), dtype=bool)
    seen[:, entry] = True
    rows = np.arange(m)
    while len(rows):
        open_ = np.where(done[rows], np.inf, dist[rows])
        step = 2 if open_.shape[1] > 1 else 1  # widen by the two nearest open nodes at a time
        at = np.argpartition(open_, step - 1, axis=1)[:, :step]
        ok = np.isfinite(np.take_along_axis(open_, at, 1))
        live = ok.any(axis=1)
        rows, at, ok = rows[live], at[live], ok[live]
        if not len(rows):
            break
        done[rows[:, None], at] = True
        near = graph[np.where(ok, ids[rows[:, None], at], -1)].reshape(len(rows), -1)  # graph[-1] is all -1
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        safe = np.where(fresh, near, 0)
        r, c = np.nonzero(fresh)
        d = np.full(near.shape, np.inf, dtype=np.float32)
        v = safe[r, c]
        d[r, c] = norm[v] - 2 * np.einsum("ij,ij->i", x[v], q[rows[r]])
        twice = np.zeros(near.shape, dtype=bool)
        o = np.argsort(safe, axis=1, kind="stable")
        so = np.take_along_axis(np.where(fresh, safe, -1 - np.arange(near.shape[1])), o, 1)
        dup = np.zeros_like(twice)
        dup[:, 1:] = so[:, 1:] == so[:, :-1]
        np.put_along_axis(twice, o, dup, 1)
        d[twice] = np.inf
        seen[rows[r], v] = True
        all_d = np.concatenate([dist[rows], d], axis=1)
        all_i = np.concatenate([ids[rows], np.where(fresh & ~twice, near, -1)], axis=1)
        all_o = np.concatenate([done[rows], ~(fresh & ~twice)], axis=1)
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        dist[rows], ids[rows], done[rows] = (np.take_along_axis(a, keep, 1) for a in (all_d, all_i, all_o))
    o = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, o, 1), np.take_along_axis(dist, o, 1)


def _prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of each node's candidates (rows of ids, -1 pads): the nearest stays, what it is nearer to (alpha
    times) than the node goes, and so on."""
    b, c = cand.shape
    xc = x[np.maximum(cand, 0)]
    xn = x[nodes]
    d = ((xc - xn[:, None, :]) ** 2).sum(axis=2)
    alive = (cand >= 0) & (cand != nodes[:, None])
    o = np.argsort(cand, axis=1, kind="stable")
    so = np.take_along_axis(cand, o, 1)
    dup = np.zeros_like(alive)
    dup[:, 1:] = so[:, 1:] == so[:, :-1]
    twice = np.zeros_like(alive)
    np.put_along_axis(twice, o, dup, 1)
    alive &= ~twice
    out = np.full((b, degree), -1, dtype=np.int64)
    every = np.arange(b)
    for k in range(degree):
        dd = np.where(alive, d, np.inf)
        p = dd.argmin(axis=1)
        ok = np.isfinite(dd[every, p])
        if not ok.any():
            break
        out[ok, k] = cand[every[ok], p[ok]]
        between = ((xc - xc[every, p][:, None, :]) ** 2).sum(axis=2)
        alive &= ~(alpha * alpha * between <= d)
        alive[every, p] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """The graph (one row of neighbours for each vector, and a last one of -1) and its entry point."""
    n = len(x)
    graph = np.full((n + 1, degree), -1, dtype=np.int64)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin()) if n else 0
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([[entry], order[order != entry]]) if n else order
    at = 1
    while at < n:
        size = min(max(1, at), 512, n - at)
        batch = order[at : at + size]
        found, _ = _walk(x, graph, entry, x[batch], min(beam, max(2, n)))
        graph[batch] = _prune(x, batch, np.concatenate([found, graph[batch]], axis=1), degree, alpha)
        back: dict[int, list[int]] = {}
        for u, row in zip(batch.tolist(), graph[batch].tolist()):
            for v in row:
                if v >= 0:
                    back.setdefault(v, []).append(u)
        full = []
        for v, us in back.items():
            own = graph[v][graph[v] >= 0]
            new = np.concatenate([own, np.setdiff1d(us, own)])
            if len(new) <= degree:
                graph[v, : len(new)] = new
            else:
                full.append((v, new))
        for lo in range(0, len(full), 256):
            part = full[lo : lo + 256]
            width = max(len(c) for _, c in part)
            cand = np.full((len(part), width), -1, dtype=np.int64)
            for i, (_, c) in enumerate(part):
                cand[i, : len(c)] = c
            nodes = np.array([v for v, _ in part])
            graph[nodes] = _prune(x, nodes, cand, degree, alpha)
        at += size
    return graph, entry


def _valid(df: DataFrame) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok)


def search(table: DataFrame, k: int = 20, every: int = 20, shard: int = SHARD, largest: int = LARGEST, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products found for each row whose vec_id is divisible by
    `every`, itself left out; ties go to the smaller vec_id, all candidates come where there are fewer than k.

    Vectors that are null, zero, or hold null or non-finite components take no part; nor do null ids. Vectors of another
    length than the first index apart: they neither find nor are found by others. Rows that repeat an id and vector count
    once. Vectors are used whole, however long. An empty table gives no rows. Extra columns of table(vec_id, embedding, ...)
    are ignored.
    """
    spark = table.sparkSession
    tune(spark)
    rows = _valid(table).withColumn("dim", F.size("embedding")).withColumn("vh", F.xxhash64("embedding")).withColumn("vh2", F.hash("embedding"))

    def partial(batches):  # the k + 1 smallest ids of each vector, batch by batch: a vector may have any number of copies
        for b in batches:
            pdf = b.select(["vh", "vh2", "vec_id", "embedding"]).to_pandas().sort_values("vec_id").drop_duplicates(["vh", "vh2", "vec_id"])
            some = pdf.groupby(["vh", "vh2"]).head(k + 1).groupby(["vh", "vh2"], sort=False)
            got = some.agg({"vec_id": list, "embedding": "first"}).reset_index()
            yield pa.RecordBatch.from_arrays([pa.array(got["vh"]), pa.array(got["vh2"], pa.int32()), pa.array(got["vec_id"].tolist(), pa.list_(pa.int64())), pa.array(got["embedding"].tolist(), pa.list_(pa.float64()))], ["vh", "vh2", "ids", "embedding"])

    some = rows.select("vh", "vh2", "vec_id", "embedding").mapInArrow(partial, "vh long, vh2 int, ids array<long>, embedding array<double>")
    salted = some.groupBy("vh", "vh2", F.pmod(F.hash("ids"), F.lit(64)).alias("s")).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"), F.first("embedding").alias("embedding"))
    uniq = salted.groupBy("vh", "vh2").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"), F.first("embedding").alias("embedding"))
    uniq = cut(uniq.withColumn("dim", F.size("embedding")).withColumn("own", F.monotonically_increasing_id()))
    dims = uniq.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)).alias("m"))
    size = F.least(F.lit(float(largest)), F.greatest(F.lit(float(shard)), F.ceil(16 * F.sqrt("n"))))
    dims = cut(dims.withColumn("shards", F.ceil(F.col("n") / size).cast("int")))
    kinds, shards = dims.agg(F.count("*"), F.sum("shards")).first()
    sized = uniq.join(F.broadcast(dims) if kinds <= 4096 else dims, "dim")
    parts = sized.withColumn("shard", F.pmod(F.xxhash64("vh", "vh2"), F.col("shards")).cast("int"))
    parts = parts.repartition(min(100_000, 4 * (shards or 1)), "dim", "shard")  # few shards share a task

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["embedding"].to_numpy()).astype(np.float32)
        more = np.sqrt(np.maximum(0, np.float32(pdf["m"].iloc[0]) - (x.astype(np.float64) ** 2).sum(axis=1))).astype(np.float32)
        graph, entry = build(np.concatenate([x, more[:, None]], axis=1), degree, beam, alpha)
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "shard": [int(pdf["shard"].iloc[0])], "n": [len(x)], "entry": [entry], "x": [np.stack(pdf["embedding"].to_numpy()).astype("<f8").tobytes()], "more": [more.tobytes()], "graph": [graph.astype("<i4").tobytes()], "ids": [pdf["ids"].map(list).tolist()]})

    built = cut(parts.select("dim", "m", "shard", "ids", "embedding").groupBy("dim", "shard").applyInPandas(index, "dim int, shard int, n int, entry int, x binary, more binary, graph binary, ids array<array<long>>"))
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "vh", "vh2").distinct()
    q = sized.join(asked.select("vh", "vh2").distinct(), ["vh", "vh2"], "left_semi")
    total = asked.select("vh", "vh2").distinct().count()
    blocks = max(1, -(-total // queries))
    q = q.withColumn("block", F.pmod(F.xxhash64("vh2", "vh"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    spread = built.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def look(ix: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        cols = ["own", "found", "score"]
        if not len(ix) or not len(qs):
            return pd.DataFrame({"own": [], "found": [], "score": []})[cols]
        r = ix.iloc[0]
        n, dim = int(r["n"]), int(r["dim"])
        exact = np.frombuffer(r["x"], dtype="<f8").reshape(n, dim)
        x = np.concatenate([exact.astype(np.float32), np.frombuffer(r["more"], dtype=np.float32)[:, None]], axis=1)
        graph = np.frombuffer(r["graph"], dtype="<i4").reshape(n + 1, degree).astype(np.int64)
        ids = list(r["ids"])
        out = []
        for lo in range(0, len(qs), 256):
            part = qs.iloc[lo : lo + 256]
            e = np.stack(part["embedding"].to_numpy())
            found, _ = _walk(x, graph, int(r["entry"]), np.concatenate([e, np.zeros((len(e), 1))], axis=1).astype(np.float32), beam)
            for own, v, row in zip(part["own"].tolist(), e, found):
                row = row[row >= 0]
                score = (exact[row] * v).sum(axis=1)
                pairs = sorted(((-s, i) for s, j in zip(score.tolist(), row.tolist()) for i in ids[j]))[: k + 1]
                out.append((own, [i for _, i in pairs], [-s for s, _ in pairs]))
        return pd.DataFrame(out, columns=cols)

    hits = q.groupBy("dim", "shard", "block").cogroup(spread.groupBy("dim", "shard", "block")).applyInPandas(lambda a, b: look(b, a), "own long, found array<long>, score array<double>")
    pair = F.transform(F.arrays_zip("found", "score"), lambda z: F.struct((-z["score"]).alias("d"), z["found"].alias("i")))
    best = hits.select("own", pair.alias("z")).groupBy("own").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("z")))), 1, k + 1).alias("z"))
    best = uniq.select("own", "vh", "vh2").join(best, "own").drop("own")
    out = asked.join(best, ["vh", "vh2"])
    z = F.slice(F.filter("z", lambda x: x["i"] != F.col("vec_id")), 1, k)
    return out.select(F.col("vec_id").alias("query_id"), F.posexplode(z).alias("p", "r")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("r.i").alias("vec_id"), (-F.col("r.d")).alias("score"))
