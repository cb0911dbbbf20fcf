"""Packing documents into sequences by linear grouping, few-size configurations and best fit.

The plan is made on the histogram of piece lengths (at most as many entries as a sequence
has tokens), so its cost does not follow the corpus:

1. lengths above ``LARGE_SHARE`` of a sequence are sorted and dealt into groups of equal
   cardinality; inside a group all lengths are rounded up to the largest one. Where there
   are no more lengths than groups, each is its own group and nothing is rounded;
2. few sizes are left, and configurations are chosen one after the other: the largest
   size still open together with the fill that a bounded knapsack finds best for it;
3. the actual lengths take the places of the rounded ones, and what that frees is offered
   to all lengths still open, the longest that fits first;
4. small lengths go, longest first, where they leave least space (best fit).

A plan is a list of runs: a pattern of lengths and how many sequences look like it. A
piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from bidlens.llm.common import documents, rows_of
from bidlens.llm.encoding import encoder
from bidlens.session import materialise

SEQUENCE = 2048
GROUPS = 256
LARGE_SHARE = 1 / 3
# Pieces of one length that are numbered by one task.
RANKED_TOGETHER = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def cut_lengths(n: int, capacity: int = SEQUENCE) -> list[int]:
    """Lengths of a document's pieces: full ones, after a first one that may be shorter."""
    if n <= capacity:
        return [n]
    return ([n % capacity] if n % capacity else []) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = SEQUENCE, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, cut."""

    def cut(batches):
        packed = encoder(vocabulary, lambda ids: np.asarray(ids, "<u4").tobytes(), "ids")
        for ids, texts in rows_of(batches):
            rows = []
            for doc_id, values in zip(ids, packed.values(texts)):
                data = b"".join(values) + int(end_id).to_bytes(4, "little")
                start = 0
                for k, length in enumerate(cut_lengths(len(data) // 4, capacity)):
                    part = data[4 * start:4 * (start + length)]
                    rows.append((doc_id, k, start, length, zlib.crc32(part), part))
                    start += length
            columns = list(zip(*rows)) if rows else [[]] * 6
            arrays = [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in columns[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def grouped_sizes(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths, longest first, in groups of equal cardinality: per group its runs (length, how many).

    As many groups as lengths leave nothing to round: each length is a group.
    """
    if len(counts) <= groups:
        return [[(length, counts[length])] for length in sorted(counts, reverse=True)]
    total = sum(counts.values())
    room = -(-total // groups) if total else 0
    out: list[list[tuple[int, int]]] = []
    left = 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not left:
                out.append([])
                left = room
            take = min(n, left)
            out[-1].append((length, take))
            n, left = n - take, left - take
    return out


def best_configuration(sizes: list[int], open_: list[int], capacity: int) -> list[int]:
    """How often each size stands in the fullest sequence that holds the largest open size."""
    first = next(j for j, n in enumerate(open_) if n)
    room = capacity - sizes[first]
    # reach[c]: the size that was put in last to fill exactly c, or -1; sizes in order, each up to its stock.
    reach = np.full(room + 1, -1, np.int64)
    reach[0] = len(sizes)
    chosen: list[np.ndarray] = []
    used = {first: 1}
    for j in range(first, len(sizes)):
        before = reach >= 0
        stock = min(open_[j] - (j == first), room // sizes[j])
        layer = np.zeros(room + 1, np.int32)
        now = before.copy()
        step = before
        for k in range(1, stock + 1):
            shifted = np.zeros(room + 1, bool)
            shifted[sizes[j]:] = step[:-sizes[j]] if sizes[j] else step
            fresh = shifted & ~now
            layer[fresh] = k
            now |= shifted
            step = shifted
            if not step.any():
                break
        reach[now & (reach < 0)] = j
        chosen.append(layer)
        if now[room]:
            break
    at = int(np.flatnonzero(reach >= 0).max())
    for back in range(len(chosen) - 1, -1, -1):
        k = int(chosen[back][at])
        if k:
            used[first + back] = used.get(first + back, 0) + k
            at -= k * sizes[first + back]
    return [used.get(j, 0) for j in range(len(sizes))]


def plan_runs(histogram: dict[int, int], capacity: int = SEQUENCE, groups: int = GROUPS, large_share: float = LARGE_SHARE) -> list[tuple[int, tuple[int, ...]]]:
    """Runs (how many sequences, their lengths in order) that hold every piece once."""
    done = [(histogram[capacity], (capacity,))] if histogram.get(capacity) else []
    rest = {n: c for n, c in histogram.items() if c and n < capacity}
    edge = max(1, int(capacity * large_share))
    stocks = grouped_sizes({n: c for n, c in rest.items() if n > edge}, groups)
    sizes = [g[0][0] for g in stocks]
    open_ = [sum(n for _, n in g) for g in stocks]
    begun: list[tuple[int, tuple[int, ...]]] = []
    while any(open_):
        use = best_configuration(sizes, open_, capacity)
        times = min(open_[j] // k for j, k in enumerate(use) if k)
        slots = []
        for j, k in enumerate(use):
            open_[j] -= times * k
            for _ in range(k):
                slots.append(take_runs(stocks[j], times))
        begun += fill_freed(meet(slots, times), stocks, open_, capacity)
    return done + best_fit(begun, {n: c for n, c in rest.items() if n <= edge}, capacity)


def take_runs(stock: list[tuple[int, int]], times: int) -> list[tuple[int, int]]:
    """Take the next ``times`` actual lengths from a group."""
    out = []
    while times:
        length, n = stock[0]
        took = min(n, times)
        out.append((length, took))
        times -= took
        if took == n:
            stock.pop(0)
        else:
            stock[0] = (length, n - took)
    return out


def meet(slots: list[list[tuple[int, int]]], times: int) -> list[tuple[int, tuple[int, ...]]]:
    """Sequences of one configuration as runs over which each place holds one actual length."""
    ends = sorted({int(e) for s in slots for e in np.cumsum([n for _, n in s])})
    out, before = [], 0
    cursors = [[0, 0] for _ in slots]
    for end in ends:
        pattern = []
        for slot, cursor in zip(slots, cursors):
            while cursor[1] + slot[cursor[0]][1] <= before:
                cursor[1] += slot[cursor[0]][1]
                cursor[0] += 1
            pattern.append(slot[cursor[0]][0])
        out.append((end - before, tuple(pattern)))
        before = end
    return out


def fill_freed(
    runs: list[tuple[int, tuple[int, ...]]], stocks: list[list[tuple[int, int]]], open_: list[int], capacity: int
) -> list[tuple[int, tuple[int, ...]]]:
    """Runs with the longest actual lengths still open that fit into their room; takes those from the stocks."""
    waiting, out = runs[::-1], []
    while waiting:
        n, pattern = waiting.pop()
        room = capacity - sum(pattern)
        # Stocks and their runs go from the longest length to the shortest.
        fits = next(((j, i) for j, stock in enumerate(stocks) if stock and stock[-1][0] <= room for i, (length, _) in enumerate(stock) if length <= room), None)
        if fits is None:
            out.append((n, pattern))
            continue
        j, i = fits
        length, left = stocks[j][i]
        took = min(n, left)
        stocks[j][i:i + 1] = [(length, left - took)] if left > took else []
        open_[j] -= took
        if n > took:
            waiting.append((n - took, pattern))
        waiting.append((took, (*pattern, length)))
    return out


def best_fit(begun: list[tuple[int, tuple[int, ...]]], small: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Small lengths, longest first, into the sequences that they leave fullest."""
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for n, pattern in begun:
        by_room.setdefault(capacity - sum(pattern), []).append((n, pattern))
    rooms = sorted(by_room)

    def put(room: int, run: tuple[int, tuple[int, ...]]) -> None:
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append(run)

    for length in sorted(small, reverse=True):
        left = small[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                put(capacity, (-(-left // (capacity // length)), ()))
                continue
            room = rooms[k]
            n, pattern = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[k]
            each = min(room // length, left)
            filled = min(n, left // each)
            if n > filled:
                put(room, (n - filled, pattern))
            put(room - each * length, (filled, pattern + (length,) * each))
            left -= filled * each
    return [run for room in rooms for run in by_room[room] if run[1]]


def places(runs: list[tuple[int, tuple[int, ...]]]) -> pd.DataFrame:
    """(length, rank_from, sequence_from, offset): where the pieces of a length go, by their rank."""
    rows, used, sequence = [], {}, 0
    for n, pattern in runs:
        offset = 0
        for length in pattern:
            rows.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        sequence += n
    return pd.DataFrame(rows, columns=["length", "rank_from", "sequence_from", "offset"], dtype="int64").sort_values(["length", "rank_from"])


def ranked(cut: DataFrame, n_pieces: int) -> DataFrame:
    """Pieces with their rank among those of their length; a common length is numbered in many tasks."""
    salts = max(8, -(-n_pieces // RANKED_TOGETHER))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    # At most capacity x salts rows of three numbers.
    starts = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "_row")
    numbered = salted.withColumn("_k", F.row_number().over(within) - 1)
    return numbered.join(starts, ["length", "_salt"]).withColumn("rank", F.col("_start") + F.col("_k"))


def pack(docs: DataFrame, vocabulary: str, capacity: int = SEQUENCE, groups: int = GROUPS, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece.

    Each document's ids are followed by id 0, so a null or empty text is one token. Only
    documents longer than ``capacity`` are cut, into full pieces after a first one that may
    be shorter. Pieces of a sequence stand one after the other from offset 0. Rows with a
    null id are packed as the others, repeated rows each for themselves; ties in length
    are numbered by id and piece. A very long text is one document of many pieces. An empty
    table gives an empty one; further columns, whatever their names, are ignored.
    """
    # The number is written with the pieces, so rows without an id or with one id are told apart and stay so.
    cut = pieces(documents(docs, id_col, text_col), vocabulary, capacity, with_ids=with_ids)
    cut = materialise(cut.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    # One row for each length, at most ``capacity`` of them.
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = places(plan_runs(histogram, capacity, groups))
    keys = where["length"].to_numpy() << 40 | where["rank_from"].to_numpy()
    rank_from, first, offset = (where[c].to_numpy() for c in ("rank_from", "sequence_from", "offset"))

    def assign(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 40 | rank, "right") - 1
            kept = [batch.column(n) for n in batch.schema.names if n not in ("rank", "ids")]
            more = [pa.array(first[at] + rank - rank_from[at]), pa.array(offset[at])]
            ids = [batch.column("ids")] if with_ids else []
            names = [n for n in batch.schema.names if n not in ("rank", "ids")] + ["sequence_id", "offset"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays(kept + more + ids, names=names)

    chosen = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return ranked(cut, sum(histogram.values())).select(*chosen, "rank").mapInArrow(assign, PACKED + (", ids array<int>" if with_ids else ""))
