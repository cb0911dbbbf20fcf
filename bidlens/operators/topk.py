"""Exact top-k of many queries without pairing every row with every other.

Two physical forms share one merge step:

* ``scan_topk``: the query side is small (checked), every task holds it and reads
  its share of the base once; a task gives out at most k rows per query.
* ``block_topk``: both sides may be large. Rows meet in blocks of bounded size
  that Spark forms by hash; a hot routing key is split into as many blocks as its
  row count asks for. A block gives out at most k rows per query.

A scorer is built per task from the query rows and returns a (rows x queries)
matrix for a batch of base rows; larger is better.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from bidlens.session import bounded_rows, small_side, task_slots

Scorer = Callable[[pd.DataFrame], np.ndarray]
ScorerFactory = Callable[[pd.DataFrame], Scorer]

DIGITS = 6
MATRIX_CELLS = 1_000_000
# Rows of a block of either side. What is shuffled falls with it, a task holds two blocks.
BLOCK_ROWS = 1 << 14
# Queries scored at once inside a block.
QUERY_ROWS = 1024


def _sortable(values: pd.Series) -> np.ndarray:
    out = values.to_numpy()
    return out.astype(str) if out.dtype == object else out


class _Running:
    """Top-k per query over the batches one task sees.

    Once a query holds k rows, only scores that reach its k-th are looked at: of a
    score matrix little more than one comparison per cell is left. ``bar_col`` names
    a column of the queries below whose value no score is wanted.
    """

    def __init__(
        self, queries: pd.DataFrame, query_col: str, k: int, exclude_self: bool, with_worst: bool = True, bar_col: str | None = None
    ):
        self.qids = _sortable(queries[query_col])
        self.k, self.exclude_self, self.with_worst = k, exclude_self, with_worst
        self.score = np.full((len(self.qids), k), -np.inf)  # per query, best first
        self.ids: np.ndarray | None = None
        self.worst = np.full(len(self.qids), np.inf)
        self.limit = queries[bar_col].to_numpy(float) if bar_col else np.full(len(self.qids), -np.inf)

    def _same(self, ids: np.ndarray, query: np.ndarray) -> np.ndarray:
        same = ids == self.qids[query]
        if ids.dtype.kind == "U":  # two rows without an id are not one row
            same &= ids != ""
        return same

    def _cut(self, ids: np.ndarray, scores: np.ndarray, first_query: int) -> np.ndarray:
        """Score per query that a row of this batch needs at least, a rounding step below."""
        span = slice(first_query, first_query + scores.shape[1])
        cut = np.maximum(self.score[span, -1], self.limit[span])
        unset = np.flatnonzero(cut == -np.inf)
        if len(unset) and len(ids) > self.k:
            part = scores[:, unset]
            if self.exclude_self:
                part = np.where(self._same(ids[:, None], unset[None, :] + first_query), -np.inf, part)
            cut[unset] = np.partition(part, len(ids) - self.k, axis=0)[len(ids) - self.k]
        return cut - 10.0 ** -DIGITS

    def add(self, ids: np.ndarray, scores: np.ndarray, first_query: int) -> None:
        if self.with_worst:
            span = slice(first_query, first_query + scores.shape[1])
            self.worst[span] = np.minimum(self.worst[span], np.round(scores.min(axis=0), DIGITS) + 0.0)
        hit = np.flatnonzero(scores >= self._cut(ids, scores, first_query)[None, :])  # faster than two places at once
        rows, cols = np.divmod(hit, scores.shape[1])
        self._take(ids[rows], cols + first_query, scores[rows, cols])

    def reach(self, first_query: int, n: int) -> np.ndarray | None:
        """Scores that n queries need at least, or ``None`` where all scores of a batch have to be seen."""
        cut = np.maximum(self.score[first_query:first_query + n, -1], self.limit[first_query:first_query + n])
        return None if self.with_worst or np.isneginf(cut).any() else cut - 10.0 ** -DIGITS

    def _take(self, picked: np.ndarray, query: np.ndarray, score: np.ndarray) -> None:
        """Keep the best of what is held and these scores."""
        if self.ids is None:
            self.ids = np.empty(self.score.shape, picked.dtype)
        elif picked.dtype.itemsize > self.ids.dtype.itemsize:
            self.ids = self.ids.astype(picked.dtype)
        score = np.round(score, DIGITS) + 0.0
        last = self.score[query, -1]
        keep = (score > -np.inf) & (score >= self.limit[query]) & ((score > last) | ((score == last) & (picked < self.ids[query, -1])))
        if self.exclude_self:
            keep &= ~self._same(picked, query)
        query, picked, score = query[keep], picked[keep], score[keep]
        if not len(query):
            return
        touched = np.unique(query)
        held, place = np.nonzero(self.score[touched] > -np.inf)
        held = touched[held]
        query, picked, score = np.r_[held, query], np.r_[self.ids[held, place], picked], np.r_[self.score[held, place], score]
        order = np.lexsort((picked, -score, query))
        query, picked, score = query[order], picked[order], score[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        best = place < self.k
        self.score[touched] = -np.inf
        self.score[query[best], place[best]] = score[best]
        self.ids[query[best], place[best]] = picked[best]

    def rows(self, query_col: str, id_col: str) -> pd.DataFrame | None:
        query, place = np.nonzero(self.score > -np.inf)
        if self.ids is None or not len(query):
            return None
        return pd.DataFrame({
            query_col: self.qids[query], id_col: self.ids[query, place], "score": self.score[query, place], "worst": self.worst[query],
        })


def _feed(running: _Running, scorers: list[tuple[int, Scorer]], batch: pd.DataFrame, id_col: str, widest: int) -> None:
    step = max(1, MATRIX_CELLS // max(1, widest))
    for start in range(0, len(batch), step):
        part = batch.iloc[start:start + step]
        ids = _sortable(part[id_col])
        for first, scorer in scorers:
            cut = running.reach(first, min(QUERY_ROWS, len(running.qids) - first)) if hasattr(scorer, "reaching") else None
            if cut is None:
                running.add(ids, scorer(part), first)
            else:
                rows, cols, scores = scorer.reaching(part, cut)
                running._take(ids[rows], cols + first, scores)


def _out_schema(base: DataFrame, queries_type: T.DataType, query_col: str, id_col: str) -> T.StructType:
    return T.StructType([
        T.StructField(query_col, queries_type), T.StructField(id_col, base.schema[id_col].dataType),
        T.StructField("score", T.DoubleType()), T.StructField("worst", T.DoubleType()),
    ])


def rank(scored: DataFrame, query_col: str, id_col: str, k: int) -> DataFrame:
    """Final order inside each query; at most k rows per task and query reach it."""
    order = Window.partitionBy(query_col).orderBy(F.desc("score"), F.col(id_col))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _with_worst(scored: DataFrame, query_col: str, id_col: str, k: int) -> DataFrame:
    """Ranked rows with the lowest score any base row had for the query, from the same pass."""
    lowest = F.min("worst").over(Window.partitionBy(query_col))
    return rank(scored.withColumn("worst", lowest), query_col, id_col, k)


def scan_topk(
    base: DataFrame, query_rows: pd.DataFrame, query_type: T.DataType, make_scorer: ScorerFactory,
    query_col: str, id_col: str, k: int, exclude_self: bool = False, with_worst: bool = False,
) -> DataFrame:
    """One pass over ``base`` for a small set of queries held by every task."""
    schema = _out_schema(base, query_type, query_col, id_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        running = _Running(query_rows, query_col, k, exclude_self, with_worst)
        width = max(1, min(len(query_rows), QUERY_ROWS))
        scorers = [
            (first, make_scorer(query_rows.iloc[first:first + width])) for first in range(0, len(query_rows), width)
        ]
        for batch in batches:
            if len(batch):
                _feed(running, scorers, batch, id_col, width)
        found = running.rows(query_col, id_col)
        if found is not None:
            yield found

    if k <= 0 or not len(query_rows):
        return base.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1)).filter(F.lit(False))
    scored = base.mapInPandas(run, schema)
    return _with_worst(scored, query_col, id_col, k) if with_worst else rank(scored.drop("worst"), query_col, id_col, k)


def block_topk(
    base: DataFrame, queries: DataFrame, make_scorer: ScorerFactory, query_col: str, id_col: str, k: int,
    exclude_self: bool = False, with_worst: bool = False, route: str | None = None, block_rows: int | None = None,
    bar_col: str | None = None, once: bool = False,
) -> DataFrame:
    """Exact top-k where both sides are large.

    ``route`` names a column of both sides; a query only meets base rows of its
    routes (it may be repeated, once per route). Without it every query meets
    every block. Pairs live only inside a block's score matrix. ``bar_col`` names a
    column of the queries, the least score they want; ``once`` says that no query
    meets a base row on two routes.
    """
    if block_rows is None:
        side = math.ceil(math.sqrt(2 * task_slots(base.sparkSession)))
        block_rows = int(min(BLOCK_ROWS, max(256, math.ceil(base.count() / side))))
    key = "_route"
    b = base.withColumn(key, F.col(route).cast("string") if route else F.lit("0"))
    q = queries.withColumn(key, F.col(route).cast("string") if route else F.lit("0"))

    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))

    # One row per route; joined to both sides without moving them by a possibly hot route.
    sizes = small_side(parts(b, "_nb").join(parts(q, "_nq"), key), "routes")
    b = (
        b.join(sizes, key)
        .withColumn("_b", F.pmod(F.xxhash64(id_col), F.col("_nb").cast("long")).cast("int"))
        .withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1))).drop("_nb", "_nq")
    )
    q = (
        q.join(sizes, key)
        .withColumn("_q", F.pmod(F.xxhash64(query_col), F.col("_nq").cast("long")).cast("int"))
        .withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).drop("_nb", "_nq")
    )
    schema = _out_schema(base, queries.schema[query_col].dataType, query_col, id_col)

    def run(query_block: pd.DataFrame, base_block: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({f.name: pd.Series([], dtype=object) for f in schema.fields})
        if not len(query_block) or not len(base_block):
            return empty
        running = _Running(query_block, query_col, k, exclude_self, with_worst, bar_col)
        scorers = [(first, make_scorer(query_block.iloc[first:first + QUERY_ROWS])) for first in range(0, len(query_block), QUERY_ROWS)]
        _feed(running, scorers, base_block, id_col, min(len(query_block), QUERY_ROWS))
        found = running.rows(query_col, id_col)
        return empty if found is None else found

    # Both sides may come from one table: give the queries columns of their own.
    q = q.select(*[F.col(c).alias(c) for c in q.columns])
    cell = [key, "_b", "_q"]
    scored = q.groupBy(*cell).cogroup(b.groupBy(*cell)).applyInPandas(run, schema)
    if route and not once:
        # The same base row can be met on several routes.
        scored = scored.groupBy(query_col, id_col).agg(F.max("score").alias("score"), F.min("worst").alias("worst"))
    return _with_worst(scored, query_col, id_col, k) if with_worst else rank(scored.drop("worst"), query_col, id_col, k)


# Hits that may be sent to every task when they are joined back to their rows.
BROADCAST_HITS = 1_000_000


def hits_side(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Hits for a join with the searched table: at most queries x k rows, broadcast if that is little.

    A table of any size is then scanned once for its winners instead of being
    shuffled for them.
    """
    most = BROADCAST_HITS // max(k, 1)
    return F.broadcast(found) if queries.limit(most + 1).count() <= most else found


def topk(
    base: DataFrame, queries: DataFrame, make_scorer: ScorerFactory, query_col: str, id_col: str, k: int,
    exclude_self: bool = False, with_worst: bool = False,
) -> DataFrame:
    """Send the queries to the base when few, else let both sides meet in blocks."""
    if k <= 0:
        empty = _out_schema(base, queries.schema[query_col].dataType, query_col, id_col)
        frame = base.sparkSession.createDataFrame([], empty).withColumn("rank", F.lit(1))
        return frame if with_worst else frame.drop("worst")
    rows = bounded_rows(queries)
    if rows is not None:
        kind = queries.schema[query_col].dataType
        return scan_topk(base, rows, kind, make_scorer, query_col, id_col, k, exclude_self, with_worst)
    return block_topk(base, queries, make_scorer, query_col, id_col, k, exclude_self, with_worst)
