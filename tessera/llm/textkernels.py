"""Vectorised word and shingle hashing over batches of texts (numpy, 64-bit, exact word boundaries)."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: A-Z to a-z on UTF-8 bytes, which leaves every other code point alone.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII that is no letter or digit separates words.
PUNCT = np.zeros(256, dtype=bool)
PUNCT[[c for c in range(128) if not chr(c).isalnum()]] = True

_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_MULT = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=U64)
_powers: dict[str, np.ndarray] = {}
#: Bytes of text hashed at a time: the work arrays take some 40 bytes for each.
_AT_ONCE = 1 << 20


def _power(kind: str, n: int) -> np.ndarray:
    got = _powers.get(kind)
    if got is None or len(got) < n:
        base = np.full(max(n, 1 << 16), _BASE if kind == "up" else _INV, dtype=U64)
        base[0] = 1
        with np.errstate(over="ignore"):
            got = np.multiply.accumulate(base)
        if len(got) <= 1 << 21:
            _powers[kind] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def slices(raw: bytes, sep: np.ndarray):
    """A long text in parts of about _AT_ONCE bytes that begin and end between words; a word is never cut."""
    at = 0
    while len(raw) - at > 2 * _AT_ONCE:
        end = at + _AT_ONCE
        while end < len(raw):
            gaps = np.flatnonzero(sep[np.frombuffer(raw, dtype=np.uint8, count=min(_AT_ONCE, len(raw) - end), offset=end)])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(len(raw), end + _AT_ONCE)
        yield raw[at:end]
        at = end
    yield raw[at:]


def hash_words(texts: list[str | None], sep: np.ndarray = SPACE, prefix: int = 0) -> tuple:
    """Hashes of all lower-cased words of the texts and the first word of each text: words[first[i]:first[i+1]] are those of text i.

    prefix > 0 gives also hashes of each word's first so many bytes (0 for words not longer than that).
    """
    runs, held, size, owner = [], [], 0, []
    for i, t in enumerate(texts):
        for part in slices((t or "").encode("utf-8", "surrogatepass").translate(LOWER), sep):
            held.append(part)
            owner.append(i)
            size += len(part)
            if size >= _AT_ONCE:
                runs.append(_hash_parts(held, sep, prefix))
                held, size = [], 0
    runs.append(_hash_parts(held, sep, prefix))
    counts = np.bincount(np.array(owner, dtype=np.int64), weights=np.concatenate([np.diff(r[1]) for r in runs])[: len(owner)], minlength=len(texts)) if owner else np.zeros(0)
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return (np.concatenate([r[0] for r in runs]), first, *([np.concatenate([r[2] for r in runs])] if prefix else []))


def _hash_parts(parts: list[bytes], sep: np.ndarray, prefix: int) -> tuple:
    ends = np.cumsum([len(p) + 1 for p in parts]) if parts else np.zeros(0, dtype=np.int64)
    buf = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8) if parts else np.zeros(1, dtype=np.uint8)
    gap = sep[buf]
    if not parts:
        gap = np.ones(1, dtype=bool)
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate([[0], edge])
    start, stop = edge[0::2], edge[1::2]
    with np.errstate(over="ignore"):
        total = np.empty(len(buf) + 1, dtype=U64)
        total[0] = 0
        np.cumsum((buf.astype(U64) + U64(1)) * _power("up", len(buf)), out=total[1:])
        down = _power("down", len(buf))
        words = mix((total[stop] - total[start]) * down[start])
        heads = None
        if prefix:
            cut = start + prefix
            longer = cut < stop
            cut = np.where(longer, cut, start)
            heads = np.where(longer, mix((total[cut] - total[start]) * down[start] ^ U64(0x5851F42D4C957F2D)), U64(0))
    first = np.concatenate([[0], np.searchsorted(start, ends)]).astype(np.int64)
    return (words, first, heads) if prefix else (words, first)


def shingles(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text; a text of fewer words, but not none, is one shingle. Repeats are kept."""
    n = np.diff(first)
    with np.errstate(over="ignore"):
        m = max(0, len(words) - k + 1)
        run = np.zeros(m, dtype=U64)
        for j in range(k):
            run += words[j : j + m] * (_MULT[j % 5] + U64(2 * (j // 5)))
        run = mix(run)
        count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        at = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        doc = np.repeat(np.arange(len(n)), count)
        out = np.empty(at[-1], dtype=U64)
        where = first[:-1][doc] + (np.arange(at[-1]) - at[:-1][doc])
        whole = n[doc] >= k
        out[whole] = run[where[whole]]
        for i in np.flatnonzero((n > 0) & (n < k)):
            w = words[first[i] : first[i + 1]]
            out[at[i]] = mix(np.array([np.sum(w * _MULT[: len(w)]) + U64(len(w))], dtype=U64) ^ U64(0xC2B2AE3D27D4EB4F))[0]
    return out, at


def sequence_hash(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each text's word sequence."""
    out = []
    with np.errstate(over="ignore"):
        pos = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
        for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
            w = mix(words ^ U64(salt)) * (mix(pos.astype(U64) + U64(salt)) | U64(1))
            total = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(w)])
            out.append(mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(U64)).view(np.int64))
    return out[0], out[1]


def begin() -> None:
    """At the start of a task: have glibc return large blocks at once and share two arenas among threads."""
    try:
        libc = ctypes.CDLL(None)
        for option, value in ((-8, 2), (-3, 1 << 20), (-1, 1 << 20)):  # arenas, mmap threshold, trim threshold
            libc.mallopt(option, value)
    except AttributeError:  # not glibc
        pass


def release() -> None:
    """At the end of a task: give freed memory back to the system."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def tidy(run: Callable) -> Callable:
    """run, a function of Arrow batches, between begin and release: a worker lives on through later stages, next to a JVM
    that needs the room. Both are named here, not written out: a nested function travels with copies of module globals."""

    def out(batches):
        begin()
        yield from run(batches)
        release()

    return out
