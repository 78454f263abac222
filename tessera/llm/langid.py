"""Language ID by Bayesian evidence fusion: text likelihood x declared language x address suffix x host prior.

The text model is multinomial over hashed byte trigrams that hold a letter. Text in none of the languages is a class of its
own, with all trigrams alike: a language must explain a text better than that. How far declarations and suffixes can be
trusted, and which languages hosts publish in, is counted over all rows by grouped aggregation, with the verdict of each
row's text as its class; host priors shrink to their domain's, domains' to the whole table's. What a row's text says is
left out of the counts that judge this row, so that no evidence counts twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, tune
from .textkernels import LOWER, SPACE, slices, tidy

LANGUAGES = ("de", "en", "es", "fr")
BITS = 16
#: Trigrams after which more text adds little evidence: neighbours in a text are not independent.
TEMPER = 200.0
SHRINK = 10.0


def trigram_slices(text: str | None):
    """Buckets of the text's trigrams that hold a letter, a slice of a long text at a time."""
    tail = b" "
    for part in slices((text or "").encode("utf-8", "surrogatepass").translate(LOWER), SPACE):
        words = b" ".join(part.split())
        if words:
            raw = tail + words + b" "
            tail = raw[-2:]
            a = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
            a = np.where((a >= 48) & (a <= 57), 48, a)
            letter = ((a >= 97) & (a <= 122)) | (a >= 128)
            got = (((a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
            yield got[letter[:-2] | letter[1:-1] | letter[2:]]


def trigrams(text: str | None) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=np.int64), *trigram_slices(text)])


def fit(texts: DataFrame, languages: tuple[str, ...] = LANGUAGES, per_language: int = 2000) -> np.ndarray:
    """Log likelihoods (language x bucket) from texts(doc_id, lang, text). per_language bounds the rows fitted on: those of
    the smallest id hashes. Rows whose language is null or not asked for are ignored; without rows all buckets weigh alike."""
    ids = None
    for lang in languages:
        one = texts.where(F.col("lang") == lang).select(F.col("doc_id").alias("id"), "lang", F.lit(languages.index(lang)).alias("l")).orderBy(F.xxhash64("id"), "id").limit(per_language)
        ids = one if ids is None else ids.unionByName(one)

    def run(batches):
        seen: dict[int, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.setdefault(lang, np.zeros(1 << BITS))
                for g in trigram_slices(text):
                    seen[lang] += np.bincount(g, minlength=1 << BITS)
        for lang, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lang, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["l", "bucket", "n"])

    rows = texts.select(F.col("doc_id").alias("id"), "lang", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), ["id", "lang"])  # ids: at most languages * per_language rows
    got = rows.select("l", "text").mapInArrow(tidy(run), "l int, bucket int, n double").groupBy("l", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((len(languages), 1 << BITS), 0.05)
    np.add.at(counts, (got.column("l").to_numpy(), got.column("bucket").to_numpy()), got.column("n").to_numpy())
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def evidence(rows: DataFrame, key: str, text: Column, declared: Column, suffix: Column, host: Column, model: np.ndarray, languages: tuple[str, ...] = LANGUAGES, strip_markup: bool = False) -> DataFrame:
    """(key, declared, suffix, host, domain, units, t0..): t is the tempered log likelihood of the text in each language.
    Declarations outside the languages count as 'other', missing ones as 'none'."""
    import re

    tags = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|$)|<!--.*?(?:-->|$)|<[^>]*>|&#?\w+;")
    n = len(languages)

    def run(batches):
        for b in batches:
            out, units = np.zeros((b.num_rows, n)), np.zeros(b.num_rows, dtype=np.int64)
            for i, text in enumerate(b.column(1).to_pylist()):
                for g in trigram_slices(tags.sub(" ", text) if strip_markup and text else text):
                    units[i] += len(g)
                    out[i] += model[:, g].sum(axis=1, dtype=np.float64)
                out[i] /= 1 + units[i] / TEMPER
            yield pa.RecordBatch.from_arrays([b.column(0), *[b.column(i) for i in (2, 3, 4)], pa.array(units), *[pa.array(np.ascontiguousarray(out[:, j])) for j in range(n)]], [key, "declared", "suffix", "host", "units", *[f"t{j}" for j in range(n)]])

    two = F.lower(F.substring(F.coalesce(declared.cast("string"), F.lit("")), 1, 2))
    said = F.when(two.isin(*languages), two).when(two == "", "none").otherwise("other")
    base = rows.select(F.col(key), text.cast("string").alias("text"), said.alias("declared"), F.coalesce(suffix.cast("string"), F.lit("")).alias("suffix"), F.coalesce(host.cast("string"), F.lit("")).alias("host"))
    kind = dict(base.dtypes)[key]
    out = base.mapInArrow(tidy(run), f"{key} {kind}, declared string, suffix string, host string, units long, " + ", ".join(f"t{j} double" for j in range(n)))
    labels = F.split("host", r"\.")
    return out.withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), "."))


def fuse(found: DataFrame, key: str, languages: tuple[str, ...] = LANGUAGES, least: float = 0.5) -> DataFrame:
    """key, lang, posterior, declared, accepted. lang is the best of the languages; its posterior is among these and the class
    of other texts. Rows without any text unit are decided by the other evidence, and not accepted; nor are rows whose best
    posterior is under `least`. Ties go to the other texts, then to the first language in order."""
    other = len(languages)
    alike = float(np.float32(-BITS * np.log(2)))  # as precise as the model
    found = cut(found).withColumn(f"t{other}", F.col("units") * alike / (1 + F.col("units") / TEMPER))
    n = other + 1
    ts = [F.col(f"t{j}") for j in range(n)]
    best = F.greatest(*ts)
    top = F.when(ts[other] == best, other)
    for j in range(other):
        top = top.when(ts[j] == best, j)
    found = found.withColumn("top", F.when(F.col("units") > 0, top))
    seen = found.where("units > 0")
    counts = lambda name: [F.sum((F.col("top") == j).cast("double")).alias(f"{name}{j}") for j in range(n)]
    whole = seen.agg(*counts("g")).first()
    own = [F.coalesce((F.col("top") == j).cast("double"), F.lit(0.0)) for j in range(n)]
    # two levels: hosts sum up to domains, so the rows are read once
    hosts = seen.groupBy("host", "domain").agg(*counts("h"))
    domains = hosts.groupBy("domain").agg(*[F.sum(f"h{j}").alias(f"d{j}") for j in range(n)])
    prior = hosts.join(domains, "domain").drop("domain")
    said = {r["declared"]: r for r in seen.groupBy("declared").agg(*counts("s")).collect()}  # at most languages + 2 rows
    suffix = seen.groupBy("suffix").agg(*counts("x"))
    out = found.join(prior, "host", "left").join(suffix, "suffix", "left")
    # every count below is without the row's own verdict
    rest = lambda c: [F.coalesce(F.col(f"{c}{j}"), F.lit(0.0)) - own[j] for j in range(n)]
    judged = F.when(F.col("top").isNull(), 0.0).otherwise(1.0)
    total = lambda c: sum((F.coalesce(F.col(f"{c}{j}"), F.lit(0.0)) for j in range(1, n)), F.coalesce(F.col(f"{c}0"), F.lit(0.0))) - judged
    g = [(whole[j] or 0.0) - own[j] for j in range(n)]
    base = [(x + 1.0) / (sum(whole[j] or 0.0 for j in range(n)) - judged + n) for x in g]
    d, h, x = rest("d"), rest("h"), rest("x")
    by_domain = [(d[j] + SHRINK * base[j]) / (total("d") + SHRINK) for j in range(n)]
    by_host = [(h[j] + SHRINK * by_domain[j]) / (total("h") + SHRINK) for j in range(n)]
    logs = []
    for j in range(n):
        trust = F.lit(0.0)
        for value, r in said.items():
            trust = F.when(F.col("declared") == value, F.log(((r[f"s{j}"] or 0.0) - own[j] + 1.0) / (g[j] + len(languages) + 2.0))).otherwise(trust)
        tied = F.when(F.col(f"x{j}").isNotNull(), F.log((x[j] + 1.0) / (g[j] + 2.0))).otherwise(F.lit(0.0))
        logs.append(F.col(f"t{j}") + F.log(by_host[j]) + tied + trust)
    # a table: a filter on what follows would otherwise hold each sum some forty times, too much code to compile
    out = cut(out.select(key, "declared", "units", *[x.alias(f"l{j}") for j, x in enumerate(logs)]))
    best = F.greatest(*[F.col(f"l{j}") for j in range(other)]) if other > 1 else F.col("l0")
    most = F.greatest(best, F.col(f"l{other}"))
    lang = None
    for j in range(other):
        lang = F.when(F.col(f"l{j}") == best, languages[j]) if lang is None else lang.when(F.col(f"l{j}") == best, languages[j])
    share = F.exp(best - most) / sum((F.exp(F.col(f"l{j}") - most) for j in range(1, n)), F.exp(F.col("l0") - most))
    return out.select(key, lang.alias("lang"), share.alias("posterior"), "declared", ((F.col("units") > 0) & (share >= least)).alias("accepted"))


def identify_pages(pages: DataFrame, model: np.ndarray, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """page_id, lang, posterior, declared, accepted for each row of pages(page_id, url, html, ...). Null urls have no host
    and no suffix, null or empty html has no text and isn't accepted; repeated rows are judged each. Very long texts are
    read whole, a slice at a time. An empty table gives no rows. Extra columns are ignored. Ties as in fuse."""
    tune(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"://([^/?#:]*)", 1))
    return fuse(evidence(pages, "page_id", F.col("html"), F.regexp_extract(F.coalesce(F.col("html").cast("string"), F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2})", 1), F.regexp_extract(host, r"\.([^.]+)$", 1), host, model, languages, True), "page_id", languages)


def identify_documents(docs: DataFrame, model: np.ndarray, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """doc_id, lang, posterior, declared, accepted for each row of docs(doc_id, text, lang, source, ...): the lang column is
    what is declared, the source stands for the host. Nulls, empty and long texts, ties, repeats and empty tables as in identify_pages."""
    tune(docs.sparkSession)
    return fuse(evidence(docs, "doc_id", F.col("text"), F.col("lang"), F.lit(None), F.col("source"), model, languages), "doc_id", languages)
