"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Pieces longer than a third of the capacity pair at most twice per sequence: the largest unpaired piece takes the largest
one that still fits. Smaller pieces go, largest first, to the tightest gap that holds them, then to new sequences.

Only a piece's length matters to the plan, so it is made on the histogram of lengths: at most `capacity` numbers, whatever
the corpus. The plan is a bounded table (a few times `capacity` segments) that maps the r-th piece of a length to its
sequence and offset; ranks come from counts per input task, so no length, however common, meets in one task.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tune
from .textkernels import tidy

#: Fixed values of byte-level vocabularies: how texts are cut before merging, and the bytes that stand for themselves.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """The tokens of a plain byte-level BPE file as bytes, with their ids, and its special tokens; None for files of any
    other kind, or whose ids do not grow in the order of the merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    odd = [spec.get("normalizer"), spec.get("truncation"), spec.get("padding"), spec.get("post_processor"), *(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))]
    if model.get("type") != "BPE" or any(odd) or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    added = spec.get("added_tokens") or []
    if any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return None
    special = {x["content"]: x["id"] for x in added}
    hidden = [b for b in range(256) if b not in SHOWN]
    byte = {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(hidden)}
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    tokens = {t: i for t, i in model["vocab"].items() if t not in special}
    if None in merged or merged != sorted(set(merged)) or not all(c in byte for t in tokens for c in t):
        return None
    ranks = {bytes(byte[c] for c in t): i for t, i in tokens.items()}
    return (ranks, special) if all(bytes([b]) in ranks for b in range(256)) else None


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, as the library `tokenizers` gives them.

    With fast, a plain byte-level file is run by tiktoken, which needs a third of the time for the same ids.
    """

    def __init__(self, path: str, fast: bool):
        from tokenizers import Tokenizer

        plain = _ranks(path) if fast else None
        if plain:
            import tiktoken

            self.ranked = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=plain[0], special_tokens=plain[1])
        else:
            self.ranked = None
            self.whole = Tokenizer.from_file(path)
            self.whole.no_truncation()
            self.whole.no_padding()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if self.ranked:
            return [self.ranked.encode_to_numpy(t or "", allowed_special="all").astype("<u4", copy=False).tobytes() for t in texts]
        found = (self.whole.encode(t or "", add_special_tokens=False).ids for t in texts)
        return [np.asarray(ids, dtype="<u4").tobytes() for ids in found]


@lru_cache
def alike(path: str) -> bool:
    """Whether the fast way gives the ids of `tokenizers` for every token of the file on its own; on the driver, once."""
    plain = _ranks(path)
    if not plain:
        return False
    texts = [t.decode() for t in plain[0] if t == t.decode("utf-8", "ignore").encode()]
    return Encoder(path, True).encode(texts) == Encoder(path, False).encode(texts)


_encoders: dict[tuple[str, bool], Encoder] = {}


def _encoder(path: str, fast: bool) -> Encoder:
    if (path, fast) not in _encoders:
        _encoders[path, fast] = Encoder(path, fast)
    return _encoders[path, fast]


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Pack a histogram of lengths. Gives segments (length, first rank, last rank + 1, pieces per bin, first bin, offset)
    and the number of bins: rank r of a length lies in bin first + (r - low) // per at offset + (r - low) % per * length."""
    left = {n: c for n, c in counts.items() if c > 0}
    used: Counter = Counter()
    segments, bins, gaps = [], 0, {}  # gaps: free tokens -> [(first bin, how many)]
    heap: list[int] = []

    def put(n: int, m: int, per: int, first: int, at: int) -> None:
        segments.append((n, used[n], used[n] + m, per, first, at))
        used[n] += m
        left[n] -= m

    def free(gap: int, first: int, m: int) -> None:
        if gap > 0 and m > 0:
            if gap not in gaps or not gaps[gap]:
                heapq.heappush(heap, gap)
            gaps.setdefault(gap, []).append((first, m))

    large = sorted(n for n in left if 3 * n > capacity)
    hi = len(large) - 1
    while hi >= 0:
        n = large[hi]
        if not left[n]:
            hi -= 1
            continue
        mate = next((x for x in reversed(large[: hi + 1]) if left[x] and x + n <= capacity and (x != n or left[n] > 1)), None)
        if mate is None:
            m = left[n]
            put(n, m, 1, bins, 0)
        elif mate == n:
            m = left[n] // 2
            put(n, 2 * m, 2, bins, 0)
        else:
            m = min(left[n], left[mate])
            put(n, m, 1, bins, 0)
            put(mate, m, 1, bins, n)
        free(capacity - n - (mate or 0), bins, m)
        bins += m
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            gap = min((g for g in heap if g >= n and gaps[g]), default=None)
            if gap is None:
                per = capacity // n
                full, rest = divmod(left[n], per)
                if full:
                    put(n, full * per, per, bins, 0)
                    free(capacity - per * n, bins, full)
                    bins += full
                if rest:
                    put(n, rest, rest, bins, 0)
                    free(capacity - rest * n, bins, 1)
                    bins += 1
                break
            first, m = gaps[gap].pop()
            per, at = gap // n, capacity - gap
            take = min(m, left[n] // per)
            if take:
                put(n, take * per, per, first, at)
                free(gap - per * n, first, take)
            if take < m and left[n]:  # fewer are left than one more bin would take
                rest = left[n]
                put(n, rest, rest, first + take, at)
                free(gap - rest * n, first + take, 1)
                take += 1
            if take < m:
                gaps[gap].append((first + take, m - take))
            if not gaps[gap]:
                heap.remove(gap)
                heapq.heapify(heap)
    return segments, bins


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, eos: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, rank): one row per piece; rank counts pieces of a length in the task."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
    end, fast = np.array([eos], dtype="<u4").tobytes(), alike(tokenizer)

    def run(batches):
        task, seen = TaskContext.get().partitionId(), Counter()
        encoder = _encoder(tokenizer, fast)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                raw = encoder.encode([text.as_py()])[0] + end
                n = len(raw) // 4
                start, size, piece = 0, n % capacity or min(n, capacity), 0
                while start < n:
                    rows.append((doc, piece, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), task, seen[size]))
                    seen[size] += 1
                    start, size, piece = start + size, capacity, piece + 1
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), schema)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, eos: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the single end token. Texts of any length are encoded whole, one at a time. Ties in length are
    placed by the order of the input tasks. Repeated rows are packed each; a null doc_id stays null. An empty table gives
    no rows. Other columns of docs are ignored, whatever their names.
    """
    import public_tokenizers

    spark = docs.sparkSession
    tune(spark)
    pieces = cut(tokenize_pieces(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), capacity, eos))
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    totals = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    segments, _ = plan_bins(totals, capacity)
    before = per_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).drop("n")
    plan = spark.createDataFrame(segments, "p_length long, low long, high long, per long, first long, at long")
    at = F.col("rank") + F.col("before")
    ranked = pieces.join(before, ["length", "task"]).withColumn("r", at)
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("p_length")) & (F.col("r") >= F.col("low")) & (F.col("r") < F.col("high")))
    i = F.col("r") - F.col("low")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.floor(i / F.col("per"))).cast("long").alias("sequence_id"), (F.col("at") + i % F.col("per") * F.col("length")).cast("long").alias("offset"))
