"""Vector search: exact top-k, nearest labelled row, projection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from bidlens.operators.sampling import training_sample
from bidlens.operators.topk import BLOCK_ROWS, DIGITS, Scorer, ScorerFactory, block_topk, rank, topk
from bidlens.session import MAX_BROADCAST_ROWS, bounded_rows, materialise, task_slots


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column])


def unit(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rows of length 1; one of length 0 stays as it is."""
    return x / np.where(length > 0, length, 1.0)[:, None]


# Squares beyond this are not held in single precision.
LARGEST_ROUGH = 1e18


def rough_sides(x: np.ndarray, x_squares: np.ndarray, y: np.ndarray, y_squares: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(left, right, off): left @ right.T are the squared distances of all rows, none off by more than ``off``.

    They are in single precision where lengths allow it, and tell which pairs need an exact one.
    """
    top = sum(float(s[np.isfinite(s)].max(initial=0.0)) for s in (x_squares, y_squares))
    kind = np.float32 if top < LARGEST_ROUGH else np.float64
    width = x.shape[1]
    left, right = np.empty((len(x), width + 2), kind), np.empty((len(y), width + 2), kind)
    left[:, :width], left[:, width], left[:, width + 1] = x, x_squares, 1
    right[:, :width], right[:, width], right[:, width + 1] = -2 * y, 1, y_squares
    return left, right, 8 * (width + 8) * float(np.finfo(kind).eps) * top + 1e-30


_held: list = [None, None, None]


def _matrix_of(batch: pd.DataFrame, vec_col: str) -> np.ndarray:
    """The vectors of a batch; many scorers ask for those of one batch after another."""
    if _held[0] is not batch or _held[1] != vec_col:
        _held[:] = batch, vec_col, matrix(batch[vec_col])
    return _held[2]


def vector_scorer(metric: str, vec_col: str, query_vec_col: str) -> ScorerFactory:
    """Scores of a batch against all queries by one matrix product.

    For l2 ``reaching`` gives (rows, queries, scores) of those that may reach a cut per query.
    """
    if metric not in ("cosine", "l2", "dot"):
        raise ValueError(f"unknown metric {metric!r}")

    def make(queries: pd.DataFrame) -> Scorer:
        q = matrix(queries[query_vec_col])
        q_norm = np.linalg.norm(q, axis=1)
        directed = unit(q, q_norm)

        def checked(batch: pd.DataFrame) -> np.ndarray:
            x = _matrix_of(batch, vec_col)
            if x.shape[1] != q.shape[1]:
                raise ValueError(f"vector widths differ: {x.shape[1]} and {q.shape[1]}")
            return x

        def reaching(batch: pd.DataFrame, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x = checked(batch)
            x_squares, q_squares = np.linalg.norm(x, axis=1) ** 2, q_norm ** 2
            left, right, off = rough_sides(x, x_squares, q, q_squares)
            with np.errstate(over="ignore"):
                most = (np.minimum(cut, 0.0) ** 2 * (1 + 1e-6) + off).astype(left.dtype)
            rows, cols = np.divmod(np.flatnonzero(left @ right.T <= most[None, :]), len(q))
            exact = -2.0 * np.einsum("ij,ij->i", x[rows], q[cols]) + x_squares[rows] + q_squares[cols]
            return rows, cols, np.negative(np.sqrt(np.maximum(exact, 0.0)))

        def score(batch: pd.DataFrame) -> np.ndarray:
            x = checked(batch)
            x_norm = np.linalg.norm(x, axis=1)
            if metric == "cosine":
                return unit(x, x_norm) @ directed.T
            prod = x @ q.T
            if metric == "dot":
                return prod
            prod *= -2.0  # one matrix, worked on in place
            prod += x_norm[:, None] ** 2
            prod += q_norm[None, :] ** 2
            return np.negative(np.sqrt(np.maximum(prod, 0.0, out=prod), out=prod), out=prod)

        if metric == "l2":
            score.reaching = reaching
        return score

    return make


def vector_topk(
    base: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", vec_col: str = "vec",
    query_col: str = "query_id", query_vec_col: str = "query_vec", exclude_self: bool = False,
    min_similarity: float = 0.0,
) -> DataFrame:
    """(query, id, score, rank). For l2 the score is 1 - d / (largest d of the query).

    The threshold is applied after the cut to k, and only when above 0.
    """
    base, queries = base.select(id_col, vec_col), queries.select(query_col, query_vec_col)
    make = vector_scorer(metric, vec_col, query_vec_col)
    found = topk(base, queries, make, query_col, id_col, k, exclude_self, with_worst=metric == "l2")
    if metric == "l2":
        relative = F.when(F.col("worst") < 0, 1.0 - F.try_divide(F.col("score"), F.col("worst"))).otherwise(1.0)
        found = found.withColumn("distance", -F.col("score")).withColumn("score", relative).drop("worst")
    if min_similarity > 0:
        found = found.filter(F.col("score") >= min_similarity)
    return found


def all_scores(
    base: DataFrame, queries: DataFrame, metric: str = "cosine", id_col: str = "id", vec_col: str = "vec",
    query_col: str = "query_id", query_vec_col: str = "query_vec",
) -> DataFrame:
    """(query, id, score) for every base row: complete rankings of a small, checked set of queries."""
    asked = bounded_rows(queries.select(query_col, query_vec_col))
    if asked is None:
        raise ValueError("complete rankings are for small query sets; use a top-k search")
    make = vector_scorer(metric, vec_col, query_vec_col)
    schema = T.StructType([
        queries.schema[query_col], base.schema[id_col], T.StructField("score", T.DoubleType()),
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make(asked)
        for batch in batches:
            if len(batch):
                cells = np.round(scorer(batch), DIGITS) + 0.0
                yield pd.DataFrame({
                    query_col: np.tile(asked[query_col].to_numpy(), len(batch)),
                    id_col: np.repeat(batch[id_col].to_numpy(), len(asked)), "score": cells.ravel(),
                })

    return base.select(id_col, vec_col).mapInPandas(run, schema)


# Rows from which a self join of vectors first looks which cells it can leave out.
PRUNE_FROM = 100_000
# Bytes of vectors and rows a block of such a join may have. A row is sent to as many blocks as the other side has.
BLOCK_BYTES, MOST_BLOCK_ROWS = 32 << 20, 1 << 17


def _block_rows(rows: int, width: int, slots: int) -> int:
    """Rows of a block: as many as its bytes allow, and few enough that every slot has a block."""
    most = max(BLOCK_ROWS, min(MOST_BLOCK_ROWS, BLOCK_BYTES // (8 * max(width, 1))))
    return min(most, max(256, math.ceil(rows / math.ceil(math.sqrt(2 * slots)))))


def knn(
    base: DataFrame, k: int, metric: str = "l2", id_col: str = "id", vec_col: str = "vec",
    block_rows: int | None = None, cells: int | None = None,
) -> DataFrame:
    """k nearest other rows of every row: (id, neighbour, distance or score, rank), exact.

    A large table, or one with ``cells`` given, goes through ``cell_knn``.
    """
    n = base.count()
    if block_rows is None:
        first = base.select(F.size(vec_col).alias("n")).first()
        block_rows = _block_rows(n, (first and first["n"]) or 1, task_slots(base.sparkSession))
    if metric == "l2" and cells is None:
        cells = math.ceil(math.sqrt(n) / 4) if n >= PRUNE_FROM else 0
    if metric == "l2" and cells:
        found = cell_knn(base, k, cells, id_col, vec_col, block_rows)
    else:
        left = base.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("query_vec"))
        make = vector_scorer(metric, vec_col, "query_vec")
        found = block_topk(
            base.select(id_col, vec_col), left, make, "query_id", id_col, k, exclude_self=True, block_rows=block_rows
        )
    out = found.select(F.col("query_id").alias(id_col), F.col(id_col).alias("neighbour"), "score", "rank")
    return out.withColumn("distance", -F.col("score")).drop("score") if metric == "l2" else out


def cell_knn(
    base: DataFrame, k: int, cells: int, id_col: str = "id", vec_col: str = "vec", block_rows: int | None = None
) -> DataFrame:
    """Exact l2 neighbours that leave out cells too far away to hold any.

    Rows belong to the nearest of a few sampled pivots. The k-th distance inside
    the own cell bounds the answer; by the triangle inequality a cell can only
    improve it if (distance to pivot) - (cell radius) is within that bound. A cell
    with fewer than k other rows bounds nothing, so all cells are asked.
    """
    pivots = matrix(training_sample(base.select(id_col, vec_col), id_col, min(cells, MAX_BROADCAST_ROWS)).toPandas()[vec_col])
    squares = (pivots ** 2).sum(axis=1)

    def far(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x ** 2).sum(axis=1)[:, None] + squares[None, :] - 2 * x @ pivots.T, 0.0))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = far(matrix(batch["query_vec"]))
                yield batch.assign(_route=d.argmin(axis=1).astype(np.int32), _own=d.min(axis=1))

    asked = base.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("query_vec"))
    placed = materialise(asked.mapInPandas(
        place, T.StructType([*asked.schema.fields, T.StructField("_route", T.IntegerType()), T.StructField("_own", T.DoubleType())])
    ), "placed")
    rows = placed.select(F.col("query_id").alias(id_col), F.col("query_vec").alias(vec_col), "_route")
    # One number per pivot; a pivot without rows can be left out by anyone.
    radius = np.full(len(pivots), -np.inf)
    for cell, widest in placed.groupBy("_route").agg(F.max("_own")).collect():
        radius[cell] = widest
    make = vector_scorer("l2", vec_col, "query_vec")

    def meet(queries: DataFrame, **how) -> DataFrame:
        return block_topk(rows, queries, make, "query_id", id_col, k, exclude_self=True, block_rows=block_rows, **how)

    home = materialise(meet(placed.select("query_id", "query_vec", "_route"), route="_route", once=True), "home")
    bound = home.filter(F.col("rank") == k).select("query_id", (-F.col("score")).alias("_bound"))
    bounded = placed.join(bound, "query_id", "left").select(
        "query_id", "query_vec", "_route", F.coalesce("_bound", F.lit(float("inf"))).alias("_bound")
    )

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                # Scores are rounded; the slack keeps a cell that ties with the bound.
                near = far(matrix(batch["query_vec"])) - radius[None, :] <= batch["_bound"].to_numpy()[:, None] + 1e-5
                near[:, ~np.isfinite(radius)] = False
                near[np.arange(len(batch)), batch["_route"].to_numpy()] = False
                bar = -batch["_bound"].to_numpy() - 10.0 ** -DIGITS
                yield batch[["query_id", "query_vec"]].assign(_bar=bar, _cells=[np.flatnonzero(r).astype(np.int32) for r in near])

    reached = materialise(bounded.mapInPandas(
        reach, T.StructType([*asked.schema.fields, T.StructField("_bar", T.DoubleType()), T.StructField("_cells", T.ArrayType(T.IntegerType()))])
    ), "reached")
    # Where most cells stay in reach, a query would be sent to more cells than there are blocks of all rows.
    size = reached.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("_cells")).alias("visits")).first()
    if (size["visits"] or 0) > 2 * size["n"] * math.ceil(size["n"] / (block_rows or BLOCK_ROWS)):
        return meet(reached.drop("_cells"), bar_col="_bar")
    others = reached.select("query_id", "query_vec", "_bar", F.explode("_cells").alias("_route"))
    found = meet(others, route="_route", once=True, bar_col="_bar")
    return rank(home.drop("rank").unionByName(found.drop("rank")), "query_id", id_col, k)


def relative_knn(base: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """Row-wise top of the euclidean similarity matrix: 1 - d / (largest d of all pairs)."""
    left = base.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("query_vec"))
    make = vector_scorer("l2", vec_col, "query_vec")
    # Written down: the largest distance and the rows come from one pass over all blocks.
    found = materialise(block_topk(base.select(id_col, vec_col), left, make, "query_id", id_col, k, True, with_worst=True), "matrix")
    widest = found.agg(F.min("worst").alias("widest")).first()["widest"] or 0.0
    similarity = F.lit(1.0) - F.col("score") / F.lit(widest) if widest < 0 else F.lit(1.0)
    return found.select(
        F.col("query_id").alias(id_col), F.col(id_col).alias("neighbour"), similarity.alias("score"), "rank"
    )


def nearest_label(
    labelled: DataFrame, rows: DataFrame, id_col: str = "id", vec_col: str = "vec", label_col: str = "label"
) -> DataFrame:
    """Label of the nearest labelled row for every row: (id, label, nearest, distance)."""
    queries = rows.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("query_vec"))
    make = vector_scorer("l2", vec_col, "query_vec")
    found = topk(labelled.select(id_col, vec_col), queries, make, "query_id", id_col, 1)
    labels = labelled.select(F.col(id_col).alias("nearest"), label_col)
    return (
        found.select(F.col("query_id").alias(id_col), F.col(id_col).alias("nearest"), (-F.col("score")).alias("distance"))
        .join(labels, "nearest")
        .select(id_col, label_col, "nearest", "distance")
    )


def assign_outliers(rows: DataFrame, id_col: str = "id", vec_col: str = "vec", label_col: str = "label") -> DataFrame:
    """Noise rows (-1) take the label of their nearest clustered row, if there is one."""
    clustered, noise = rows.filter(F.col(label_col) != -1), rows.filter(F.col(label_col) == -1)
    moved = nearest_label(clustered, noise, id_col, vec_col, label_col).select(id_col, F.col(label_col).alias("_new"))
    return rows.join(moved, id_col, "left").withColumn(label_col, F.coalesce("_new", label_col)).drop("_new")


def project(df: DataFrame, weights: np.ndarray, vec_col: str = "vec", out_col: str = "vec") -> DataFrame:
    """Linear map of every vector; the matrix is model-sized, never data-sized."""
    schema = T.StructType(
        [f for f in df.schema.fields if f.name != out_col] + [T.StructField(out_col, T.ArrayType(T.DoubleType()))]
    )
    order = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                out = batch.copy()
                out[out_col] = list(matrix(batch[vec_col]) @ weights)
                yield out[order]

    return df.mapInPandas(run, schema)
