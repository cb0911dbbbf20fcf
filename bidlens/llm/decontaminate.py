"""Benchmark passages in documents by pigeonhole edit matching.

An item that occurs with at most k edits, cut into k + 1 pieces, has one piece that occurs
unchanged. Aho-Corasick finds the pieces; around each hit Myers' bit-parallel distance
decides. The same count holds for every run of pieces: of two halves with m and n pieces
that hold fewer than m + n edits, one holds fewer edits than pieces. So a hit is followed
from its piece to runs twice as long, and most hits end after a few characters.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from bidlens.llm.common import documents, own_name, rows_of

ERROR_RATE = 0.1
# Characters of items whose pieces one pass looks for; more items make more passes.
ITEM_CHARS = 1 << 20
SCHEMA = "doc_id long, item_id long, distance int, start long, end long"


def fold(text: str) -> str:
    """A-Z as a-z; every character keeps its place."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def cut_item(text: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of nearly equal length."""
    bounds = [len(text) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, text[a:b]) for a, b in zip(bounds, bounds[1:])]


def runs_above(leaf: int, count: int) -> list[tuple[int, int]]:
    """Runs of pieces that hold piece ``leaf``, shorter ones first, as halves of halves of all; without all."""
    low, high, out = 0, count, []
    while high - low > 1:
        if (low, high) != (0, count):
            out.append((low, high))
        middle = (low + high) // 2
        low, high = (low, middle) if leaf < middle else (middle, high)
    return out[::-1]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << k
    return out


def myers(pattern: str, at: dict[str, int], text: str, anchored: bool = False) -> tuple[int, int]:
    """(distance, end): least edits of ``pattern`` against a part of ``text`` and the first end with it.

    The part may start anywhere, or only at 0 if ``anchored``.
    """
    m = len(pattern)
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = (m, 0)
    for j, c in enumerate(text, 1):
        eq = at.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq | down
        plus = down | ~(across | up) & full
        minus = up & across
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        plus = plus << 1 | anchored
        minus <<= 1
        diagonal = eq | down
        up = (minus | ~(diagonal | plus)) & full
        down = plus & diagonal & full
        if score < best[0]:
            best = (score, j)
    return best


def find_items(text: str, items: list, pieces: ahocorasick.Automaton) -> list[tuple]:
    """(item, distance, start, end) for each item in the text: its closest, then first place."""
    folded = fold(text)
    spans: dict[int, list[tuple[int, int]]] = {}
    for end, hits in pieces.iter(folded):
        for k, offset, size, above in hits:
            start = end - size + 1 - offset
            if not all(
                myers(part, at, folded[max(0, start + first - edits):start + first + len(part) + edits])[0] <= edits
                for first, part, at, edits in above
            ):
                continue
            spans.setdefault(k, []).append((start - items[k][3], start + len(items[k][1]) + items[k][3]))
    out = []
    for k, found in spans.items():
        item_id, pattern, at, budget, back, back_at = items[k]
        best = None
        low, high = None, None
        # A window may end behind the text; the last entry lies behind every window.
        for a, b in [*sorted(set(found)), (1 << 62, 1 << 62)]:
            if high is not None and a <= high:
                high = max(high, b)
                continue
            if high is not None:
                base = max(0, low)
                if budget:
                    distance, end = myers(pattern, at, folded[base:max(0, high)])
                else:
                    place = folded.find(pattern, base, max(0, high))
                    distance, end = (0, place - base + len(pattern)) if place >= 0 else (1, 0)
                if distance <= budget and (best is None or distance < best[0]):
                    best = (distance, base + end)
            low, high = a, b
        if best:
            distance, end = best
            # From the end backwards: the shortest way to the same distance.
            _, size = myers(back, back_at, folded[max(0, end - len(pattern) - budget):end][::-1], anchored=True)
            out.append((item_id, distance, end - size, end))
    return out


def prepared_items(rows: list[tuple[int, str]], rate: float) -> tuple[list, ahocorasick.Automaton]:
    items, pieces = [], {}
    for item_id, text in rows:
        pattern = fold(text)
        budget = int(len(pattern) * rate)
        items.append((item_id, pattern, masks(pattern), budget, pattern[::-1], masks(pattern[::-1])))
        cut = cut_item(pattern, budget)
        parts: dict[tuple[int, int], tuple] = {}
        for leaf, (offset, piece) in enumerate(cut):
            above = runs_above(leaf, len(cut))
            for low, high in above:
                if (low, high) not in parts:
                    part = pattern[cut[low][0]:cut[high - 1][0] + len(cut[high - 1][1])]
                    parts[low, high] = (cut[low][0], part, masks(part), high - low - 1)
            pieces.setdefault(piece, []).append((len(items) - 1, offset, len(piece), [parts[r] for r in above]))
    automaton = ahocorasick.Automaton()
    for piece, hits in pieces.items():
        automaton.add_word(piece, tuple(hits))
    automaton.make_automaton()
    return items, automaton


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, start, end): items that occur in a text within ``rate`` edits a character.

    One row per input row and item, with its closest place (then the first) in code points,
    end exclusive; A-Z count as a-z. Items shorter than 1 / rate characters must occur
    unchanged; null or empty items and texts match nothing. Repeated rows give repeated
    results. Items are searched in blocks of about ``ITEM_CHARS`` characters, each read and
    broadcast for itself, so neither the driver nor a task holds more than one; one block is
    one pass over the documents. Texts of any length are searched whole; no items or no texts
    give no rows; further columns, whatever their names, are left behind.
    """
    texts = documents(docs, id_col, text_col)
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).filter(F.length("text") > 0)
    blocks = -(-(wanted.agg(F.sum(F.length("text"))).first()[0] or 0) // ITEM_CHARS)
    found = None
    block_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks)))
    for block in range(max(1, blocks)):
        # At most about ITEM_CHARS characters, or one longer item.
        rows = [tuple(r) for r in wanted.filter(block_of == block).collect()]
        one = texts.mapInArrow(_finder(docs.sparkSession.sparkContext.broadcast(rows), rate), SCHEMA)
        found = one if found is None else found.unionByName(one)
    return found


def _finder(rows: Broadcast, rate: float):
    def find(batches):
        if not rows.value:
            return
        items, pieces = prepared_items(rows.value, rate)
        for ids, texts in rows_of(batches):
            out = [(doc_id, *hit) for doc_id, text in zip(ids, texts) for hit in find_items(text, items, pieces)]
            if out:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc_id", "item_id", "distance", "start", "end"])

    return find


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in which no benchmark item occurs, all columns kept, whatever their names.

    Rows with a null id stay; of rows that share an id all go if one holds an item. Null and
    empty texts stay; an empty table gives an empty one, an empty benchmark takes nothing.
    """
    name = own_name("_hit", docs.columns)
    hit = matches(docs, benchmark, rate, id_col, text_col).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(hit, F.col(id_col) == F.col(name), "left_anti")
