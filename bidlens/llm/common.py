"""What several operators share: the document view, byte-bounded batches, vector hashing of words."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Bytes of text a task works on at a time; longer single texts are cut at white space where that is exact.
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; further columns are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def own_name(name: str, columns: list[str]) -> str:
    """A column name that no other column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held_out(doc_id: Column) -> Column:
    """Rows no model learns from: crc32 of the id's digits leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def by_bytes(ids: list, texts: list[str], limit: int = BATCH_BYTES) -> Iterator[tuple[list, list[str]]]:
    """Runs of rows of about ``limit`` characters; a longer text is a run of its own."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield ids[start:k], texts[start:k]
            start, size = k, 0
        size += len(text) + 64
    if start < len(texts):
        yield ids[start:], texts[start:]


def rows_of(batches, limit: int = BATCH_BYTES) -> Iterator[tuple[list, list[str]]]:
    """Byte-bounded runs of (ids, texts) from Arrow batches whose first columns are doc_id and text."""
    for batch in batches:
        yield from by_bytes(batch.column(0).to_pylist(), batch.column(1).to_pylist(), limit)


# Word hashing. A word's hash is a polynomial over a random byte table, taken from running
# sums of the whole buffer, so no Python loop runs over words.

_MASK = (1 << 64) - 1
_RATE = 0x9E3779B97F4A7C15
_UNDO = pow(_RATE, -1, 1 << 64)
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (one to one)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int, undo: bool = False) -> np.ndarray:
    """rate ** 0..n-1 (or of its inverse) modulo 2 ** 64."""
    name = "undo" if undo else "rate"
    if name not in _powers or len(_powers[name]) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, _UNDO if undo else _RATE, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def word_hashes(data: bytes, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(hash, byte offset) of each word: runs of bytes other than ASCII white space, A-Z as a-z.

    ``prefixes`` adds the first so many bytes of each longer word, hashed apart from words.
    """
    raw = np.frombuffer(data, np.uint8)
    gap = _ASCII_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    values = _RANDOM[_LOWER[raw]] * powers(len(raw))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    undo = powers(len(raw), True)
    found = mix((total[end] - total[start]) * undo[start] + (end - start).astype(np.uint64))
    if not prefixes:
        return found, start
    parts, places = [found], [start]
    for n in prefixes:
        at = start[end - start > n]
        parts.append(mix((total[at + n] - total[at]) * undo[at] + np.uint64(n << 40)))
        places.append(at)
    where = np.concatenate(places)
    order = np.argsort(where, kind="stable")
    return np.concatenate(parts)[order], where[order]


def text_words(texts: list[str], prefixes: tuple[int, ...] = (), limit: int = BATCH_BYTES) -> list[np.ndarray]:
    """Word (and prefix) hashes of each text. A text beyond ``limit`` bytes is hashed in parts cut at white space."""
    found: list[np.ndarray] = []
    for _, run in by_bytes(texts, texts, limit):
        if len(run) == 1 and len(run[0]) > limit:
            data, parts, at = run[0].encode(), [], 0
            while at < len(data):
                end = at + limit
                while end < len(data) and not _ASCII_SPACE[data[end]]:
                    end += 1
                parts.append(word_hashes(data[at:end], prefixes)[0])
                at = end
            found.append(np.concatenate(parts))
            continue
        coded = [t.encode() for t in run]
        hashes, start = word_hashes(b"\n".join(coded), prefixes)
        bounds = np.cumsum([0] + [len(c) + 1 for c in coded])
        cut = np.searchsorted(start, bounds)
        found += [hashes[a:b] for a, b in zip(cut[:-1], cut[1:])]
    return found
