"""MinHash near-duplicates: universal hash minima in bands, signature and exact verification, connected components.

Every stage is a distributed table cut in the shared folder; nothing about documents reaches the driver. Exact copies
collapse first. In a band bucket every text is held against the bucket's smallest id only, so a group of copies costs as
many candidates as it has members. Buckets whose members then still lie in different components are searched whole for
links between components, in blocks of bounded size: first by signatures alone, then, for those that have a likely partner
in another component, on full texts. That leaves the components as if all pairs of a bucket had been compared.

What may be lost: at a similarity of 0.8 two texts share no band with probability 3e-6 (0.85: 2e-8), and their signatures
agree less than SLACK below the similarity with probability 1e-7; all else is exact. Joins have plain shuffles of tables
on both sides, so that the partition of a frequent key is split at run time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, tune
from .textkernels import U64, hash_words, mix, sequence_hash, shingles, tidy

BANDS, ROWS = 24, 4
#: Share of agreeing minima below the similarity asked for, under which no link is expected (over five deviations).
SLACK = 0.22
BLOCK = 256


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * n + 1, dtype=U64))
    return seed[:n] | U64(1), seed[n:]


def signatures(sh: np.ndarray, at: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """uint32 minima of n universal hashes (multiply, add, high half) of each text's shingles; texts must not be empty."""
    a, b = _coefficients(n)
    out = np.empty((len(at) - 1, n), dtype=np.uint32)
    step = max(1, len(at) // max(1, len(sh) // 65536 + 1))
    with np.errstate(over="ignore"):
        for lo in range(0, len(at) - 1, step):
            hi = min(len(at) - 1, lo + step)
            part, cuts = sh[at[lo] : at[hi]], at[lo:hi] - at[lo]
            for j in range(n):
                out[lo:hi, j] = np.minimum.reduceat(((part * a[j] + b[j]) >> U64(32)).astype(np.uint32), cuts)
    return out


def profile(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, h1, h2, n_shingles, sig, bands): hashes of the word sequence, distinct shingles, 16-bit minima, band keys."""
    schema = "doc_id long, h1 long, h2 long, n_shingles long, sig binary, bands array<long>"

    def run(batches):
        for b in batches:
            words, first = hash_words(b.column(1).to_pylist())
            h1, h2 = sequence_hash(words, first)
            sh, at = shingles(words, first, k)
            n = np.array([len(np.unique(sh[at[i] : at[i + 1]])) for i in range(len(at) - 1)], dtype=np.int64)
            full = np.flatnonzero(n)
            sig = [None] * len(n)
            bands = [None] * len(n)
            if len(full):
                cuts = np.concatenate([at[:-1][full], at[-1:]])
                mins = signatures(sh, cuts)
                with np.errstate(over="ignore"):
                    keys = np.zeros((len(full), BANDS), dtype=U64)
                    for r in range(ROWS):
                        keys = mix(keys * U64(0x9E3779B97F4A7C15) + mins[:, r::ROWS].astype(U64) + U64(r + 1))
                small = mins.astype(np.uint16)
                for row, i in enumerate(full):
                    sig[i], bands[i] = small[row].tobytes(), keys[row].view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(h1), pa.array(h2), pa.array(n), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "h1", "h2", "n_shingles", "sig", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), schema)


def shingle_set(text: str, k: int = 5) -> np.ndarray:
    return np.unique(shingles(*hash_words([text]), k)[0])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def agreeing(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Signature verification: the pairs (a, b) whose minima agree often enough for the similarity."""
    least = max(0.0, percent / 100 - SLACK)

    def run(batches):
        for x in batches:
            sa, sb = (np.frombuffer(b"".join(x.column(i).to_pylist()), dtype=np.uint16).reshape(x.num_rows, -1) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array((sa == sb).mean(axis=1) >= least if x.num_rows else np.zeros(0, dtype=bool)))

    with_b = pairs.join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    with_a = with_b.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
    return with_a.select("a", "b", "sig_a", "sig_b").mapInArrow(tidy(run), "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (a, b) that full shingle sets link. texts: (id, text)."""

    def run(batches):
        last: dict = {}
        for x in batches:
            keep = []
            for a, ta, tb in zip(x.column(0).to_pylist(), x.column(2).to_pylist(), x.column(3).to_pylist()):
                if last.get("id") != (a, ta):
                    last = {"id": (a, ta), "set": shingle_set(ta, k)}
                keep.append(linked(last["set"], shingle_set(tb, k), percent))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    with_a = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return with_a.select("a", "b", "text_a", "text_b").mapInArrow(tidy(run), "a long, b long")


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, component) of every id that occurs in links (a, b): alternating large-star and small-star until nothing changes.
    Raises an error where `rounds`, if given, are too few for that."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    stat = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = stat(edges)
    done = 0
    while before[0]:
        if done == rounds:
            raise RuntimeError(f"components not settled in {rounds} rounds")
        done += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        new = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        forget(edges, large)
        edges = new
        now = stat(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(roots)


def _largest(members: DataFrame) -> DataFrame:
    """(bucket, main, in_main, all): the largest component of each bucket, its members and all of them."""
    size = members.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    return size.groupBy("bucket").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("in_main"), F.sum("c").alias("all"))


def _blocks(members: DataFrame, main: DataFrame) -> DataFrame:
    """Members (bucket, comp, ...) once for each pair (i, j) of blocks that they are to meet in. The members of a bucket's
    largest component, by main, meet the others only, which alone meet each other."""
    blocks = members.join(main, "bucket").withColumn("inner", F.col("comp") == F.col("main"))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    blocks = blocks.withColumn("nm", parts(F.col("in_main"))).withColumn("nr", parts(F.col("all") - F.col("in_main")))
    blocks = blocks.withColumn("blk", F.pmod(F.xxhash64("rep"), F.when(F.col("inner"), F.col("nm")).otherwise(F.col("nr"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    # i: a block of the largest component (from -1 down) or of the rest; j: a block of the rest
    with_main = F.transform(upto(F.col("nm")), lambda o: F.struct((-1 - o).alias("i"), F.col("blk").alias("j")))
    with_rest = F.transform(upto(F.col("nr")), lambda o: F.struct(F.least("blk", o).alias("i"), F.greatest("blk", o).alias("j")))
    of_main = F.transform(upto(F.col("nr")), lambda o: F.struct((-1 - F.col("blk")).alias("i"), o.alias("j")))
    spread = blocks.withColumn("at", F.explode(F.when(F.col("inner"), of_main).otherwise(F.concat(with_main, with_rest))))
    return spread.select("*", "at.i", "at.j").drop("at", "blk", "nm", "nr", "main", "in_main", "all", "inner")


def _likely(members: DataFrame, main: DataFrame, percent: int) -> DataFrame:
    """(bucket, i, j, rep, comp) of the members (bucket, rep, comp, sig) whose signature agrees often enough with that of a
    member of another component in a pair of blocks."""
    least = max(0.0, percent / 100 - SLACK)

    def run(batches):
        for b in batches:
            rows = []
            for bucket, i, j, found in zip(*(b.column(c).to_pylist() for c in range(4))):
                sig = np.frombuffer(b"".join(x["sig"] for x in found), dtype=np.uint16).reshape(len(found), -1)
                comp = np.array([x["comp"] for x in found])
                hit = np.zeros(len(found), dtype=bool)
                for x in range(len(found) - 1):
                    near = ((sig[x + 1 :] == sig[x]).mean(axis=1) >= least) & (comp[x + 1 :] != comp[x])
                    hit[x + 1 :] |= near
                    hit[x] |= near.any()
                rows += [(bucket, i, j, found[x]["rep"], found[x]["comp"]) for x in np.flatnonzero(hit)]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["bucket", "i", "j", "rep", "comp"])

    # a list holds two blocks: some 512 members; dealt by all three keys, as the join's by bucket would keep a bucket in one task
    grouped = _blocks(members, main).repartition("bucket", "i", "j").groupBy("bucket", "i", "j").agg(F.collect_list(F.struct("rep", "comp", "sig")).alias("found"))
    return grouped.mapInArrow(tidy(run), "bucket long, i int, j int, rep long, comp long").distinct()


def _across(likely: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """Links (a, b) between different components among the members (bucket, i, j, rep, comp) of each pair of blocks."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["rep", "text"])
        pdf = pdf[pdf["text"].map(lambda t: bool(t) and len(hash_words([t])[0]) > 0)]
        reps, roots = pdf["rep"].to_numpy(), {}

        def root(x):
            while roots.get(x, x) != x:
                x = roots[x]
            return x

        words, first = hash_words(pdf["text"].tolist())
        sh, at = shingles(words, first, k)
        sets = [np.unique(sh[at[i] : at[i + 1]]) for i in range(len(reps))]
        sig = signatures(sh, at) if len(sh) else np.zeros((len(reps), 1))
        comp, out = pdf["comp"].tolist(), []
        for x in range(len(reps)):
            alike = (sig[x + 1 :] == sig[x]).mean(axis=1)
            for y in np.argsort(-alike, kind="stable"):
                if alike[y] < max(0.0, percent / 100 - SLACK):
                    break
                y = int(y) + x + 1
                p, q = root(comp[x]), root(comp[y])
                if p != q and linked(sets[x], sets[y], percent):
                    roots[max(p, q)] = min(p, q)
                    out.append((min(reps[x], reps[y]), max(reps[x], reps[y])))
        return pd.DataFrame(out, columns=["a", "b"])

    with_text = likely.join(texts.withColumnRenamed("id", "rep"), "rep")
    return with_text.groupBy("bucket", "i", "j").applyInPandas(search, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text, ...).

    Texts link where 100 * |A & B| >= percent * |A | B| over sets of k-word shingles. Null, empty and blank texts have no
    set and link with nothing. Rows that share a doc_id are one document: it is linked by any of its texts, though a row
    without words stands for itself. Repeated rows and equal texts are compared once. A row whose doc_id is null takes no
    part: its component is null and it isn't kept. Very long texts are compared whole. Of a component the smallest id names
    it, so there are no ties. Extra columns are ignored. An empty table gives no rows.
    """
    tune(docs.sparkSession)
    seen = cut(profile(docs, k))
    uniq = seen.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("sig", "bands"), "doc_id").alias("x"))
    uniq = cut(uniq.select("h1", "h2", "rep", "x.sig", "x.bands"))
    rows = cut(seen.select("doc_id", "h1", "h2", "n_shingles").join(uniq.select("h1", "h2", "rep"), ["h1", "h2"], "left").drop("h1", "h2"))
    forget(seen)
    # texts that share an id
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a != z")
    same = rows.join(several.select("doc_id", "a"), "doc_id").where("rep != a").select("a", F.col("rep").alias("b")).distinct()
    # every member of a bucket against its smallest id
    bands = uniq.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = cut(bands.groupBy("band", "key").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1"))
    members = cut(bands.join(shared, ["band", "key"]))
    forget(shared)
    star = cut(members.where("a != rep").select("a", F.col("rep").alias("b")).distinct())
    ids = star.select(F.explode(F.array("a", "b")).alias("id")).distinct()  # grows with the corpus: never broadcast
    texts = cut(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(ids.hint("merge"), "id", "left_semi").distinct())
    sigs = uniq.select("rep", "sig")
    passed = cut(agreeing(star, sigs, percent))
    links = cut(confirmed(passed, texts, percent, k).distinct().unionByName(same))
    forget(star, passed)
    comp = cut(components(links))
    # what the smallest ids of the buckets haven't brought together
    named = members.select("band", "key", "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    open_ = named.groupBy("band", "key").agg(F.min("comp").alias("p"), F.max("comp").alias("q"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x")).where("p != q")
    open_ = cut(open_.groupBy("x", "n").agg(F.min(F.struct("band", "key")).alias("at")).select("at.band", "at.key"))
    if not open_.isEmpty():
        left = named.join(open_, ["band", "key"]).select(F.xxhash64("band", "key").alias("bucket"), "rep", "comp")
        left = cut(left.join(sigs, "rep"))
        main = cut(_largest(left))  # a table, so that the members of a large bucket can be split in the join
        likely = cut(_likely(left, main, percent))
        if not likely.isEmpty():
            more = cut(_across(likely, texts, percent, k))
            if not more.isEmpty():
                comp = cut(components(links.unionByName(more)))
            forget(more)
        forget(left, main, likely)
    forget(open_, members, texts, links, uniq)
    out = rows.join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("found", F.coalesce("component", "rep"))
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("found"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
