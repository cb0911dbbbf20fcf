"""End-to-end searches: similar tenders, price analysis, vector search, training."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from bidlens.functions.dates import date_features, temporal_vector
from bidlens.functions.vectors import fuse
from bidlens.operators import clusters, density, index, metric, pairs, price
from bidlens.operators.catalog import apply_filters, post_filter
from bidlens.operators.composite import Groups, composite_topk, with_breakdown
from bidlens.operators.features import OneHot, hashed_words, pca_reduce, scaling as feature_scaling
from bidlens.operators.stats import exact_quantiles
from bidlens.operators.topk import hits_side
from bidlens.operators.vectors import assign_outliers, project, vector_topk
from bidlens.session import materialise, scratch_path


def find_similar(
    candidates: DataFrame, targets: DataFrame, k: int = 10, weights: Mapping[str, float] | None = None,
    filters: Mapping[str, Any] | None = None, min_similarity: float = 0.0,
    districts: Groups | None = None, method_groups: Groups | None = None,
) -> DataFrame:
    """Ranked neighbours of each target with component scores, explanation and result counts."""
    pool = apply_filters(candidates, filters)
    found = composite_topk(pool, targets, k, weights, min_similarity, districts, method_groups)
    detailed = with_breakdown(found, pool, targets, k, weights, districts, method_groups)
    per_query = Window.partitionBy("target_id")
    return detailed.select(
        "target_id", "rank", "tender_id", "score", "parts", "explanation", "c",
        F.count(F.lit(1)).over(per_query).alias("k_returned"), F.lit(k).alias("k_requested"),
    )


def analyze(
    candidates: DataFrame, targets: DataFrame, k: int = 5, method: str = "weighted_median",
    weights: Mapping[str, float] | None = None, districts: Groups | None = None, method_groups: Groups | None = None,
) -> DataFrame:
    """Price prediction for every target from its k most similar tenders, in one job."""
    near = priced_neighbours(candidates, targets, k, weights, districts, method_groups)
    # k rows per target, read by several aggregates: written, so the search runs once.
    return price.predict(materialise(near, "neighbours"), "target_id", method)


def priced_neighbours(
    candidates: DataFrame, targets: DataFrame, k: int, weights: Mapping[str, float] | None = None,
    districts: Groups | None = None, method_groups: Groups | None = None,
) -> DataFrame:
    """(target_id, tender_id, score, rank, price): winners with the price they state or null."""
    found = composite_topk(candidates, targets, k, weights, 0.0, districts, method_groups)
    prices = candidates.select("tender_id", F.col("offer_price").alias("price"))
    return prices.join(hits_side(found, targets, k), "tender_id")


def vector_find_similar(
    base: DataFrame, queries: DataFrame, k: int = 10, metric_name: str = "cosine", min_similarity: float = 0.0,
    filters: Mapping[str, Any] | None = None, metadata: DataFrame | None = None, weights: np.ndarray | None = None,
    filter_mode: str = "post",
) -> DataFrame:
    """Exact vector search: optional learned map, top k, threshold, filters.

    Filters apply to the hits, which may leave fewer than k; with
    ``filter_mode="pre"`` they choose the rows that are searched.
    """
    if filter_mode not in ("pre", "post"):
        raise ValueError("filter_mode is 'pre' or 'post'")
    b, q = base.select("id", "vec"), queries.select("query_id", "query_vec")
    if filters and filter_mode == "pre" and metadata is not None:
        b = b.join(post_filter(metadata, filters).select("id"), "id", "left_semi")
    if weights is not None:
        b, q = project(b, weights), project(q, weights, "query_vec", "query_vec")
    found = vector_topk(b, q, k, metric_name, min_similarity=min_similarity)
    if metadata is not None:
        found = metadata.join(hits_side(found, q, k), "id")
    return post_filter(found, filters) if filter_mode == "post" else found


def tender_vectors(
    tenders: DataFrame, text_fields: Sequence[str] = ("title", "description", "customer"), dims: int = 32,
    categories: Sequence[str] = ("method", "region", "currency", "funding", "status", "platform"), cap: int = 50,
    scaling: str = "standard", temporal: str = "cyclical", fusion: str = "concatenate", reference: datetime | None = None,
) -> DataFrame:
    """(id, vec): hashed words, one-hot categories, scaled price and calendar of prepared tenders in one vector.

    Dates count from ``reference``, by default the latest one seen.
    """
    latest = reference or tenders.agg(F.max("published")).first()[0]
    fit = OneHot.fit(tenders, categories, cap)
    blocks = {
        "text": F.concat(*[hashed_words(F.col(n), dims) for n in text_fields]),
        "categorical": F.concat(*[fit.vector(n) for n in categories]),
        "numerical": F.array(feature_scaling(tenders, ["price"], scaling)["price"]),
        "temporal": temporal_vector(F.col("_calendar"), temporal),
    }
    dated = tenders.withColumn("_calendar", date_features(F.col("published"), F.lit(latest).cast("timestamp")))
    return dated.select(F.col("tender_id").alias("id"), fuse(blocks, fusion).alias("vec"))


@dataclass
class TrainedModel:
    """What training leaves behind; tables are paths below the shared folder."""

    labels: DataFrame
    learned: metric.LearnedMap
    embeddings: DataFrame
    centroids: np.ndarray
    index_path: str

    def report(self) -> DataFrame:
        """Clusters, noise, widths and loss as one row."""
        rows = self.embeddings.join(self.labels, "id")
        base = clusters.label_report(rows, "label", "vec")
        return base.withColumns({
            "first_loss": F.lit(self.learned.losses[0]), "last_loss": F.lit(self.learned.losses[-1]),
            "n_cells": F.lit(len(self.centroids)),
        })

    def save(self, path: str) -> None:
        spark = self.embeddings.sparkSession
        index.write_centroids(spark, self.centroids, f"{path}/centroids")
        index.write_centroids(spark, self.learned.weights, f"{path}/map")
        self.labels.write.mode("overwrite").parquet(f"{path}/labels")
        spark.createDataFrame([(float(x),) for x in self.learned.losses], "loss double").coalesce(1).write.mode("overwrite").parquet(f"{path}/losses")
        index.read_index(spark, self.index_path).write.mode("overwrite").partitionBy("cell_id").parquet(f"{path}/index")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TrainedModel:
        """A saved model with all it needs to search, the learned map included."""
        losses = sorted((r["loss"] for r in spark.read.parquet(f"{path}/losses").collect()), reverse=True)
        learned = metric.LearnedMap(index.read_centroids(spark, f"{path}/map"), losses)
        built = index.read_index(spark, f"{path}/index")
        return cls(
            spark.read.parquet(f"{path}/labels"), learned, built.select("id", "vec"),
            index.read_centroids(spark, f"{path}/centroids"), f"{path}/index",
        )

    def search(self, queries: DataFrame, k: int = 10, nprobe: int = 10) -> DataFrame:
        """Index search for vectors of the space the map was learned in."""
        mapped = project(queries.select("query_id", "query_vec"), self.learned.weights, "query_vec", "query_vec")
        built = index.read_index(queries.sparkSession, self.index_path)
        return index.ivf_search(built, self.centroids, mapped, k, nprobe)


def train(
    vectors: DataFrame, components: int = 32, epsilon: float | None = None, min_cluster_size: int = 5, dim: int = 16,
    epochs: int = 5, nlist: int = 16, keep_noise: bool = False,
) -> TrainedModel:
    """Reduce, cluster, learn a map from cluster pairs, project, index."""
    reduced, _ = pca_reduce(vectors, "id", "vec", components)
    return train_reduced(reduced, epsilon, min_cluster_size, dim, epochs, nlist, keep_noise)


def train_reduced(
    reduced: DataFrame, epsilon: float | None = None, min_cluster_size: int = 5, dim: int = 64, epochs: int = 50,
    nlist: int = 100, keep_noise: bool = False,
) -> TrainedModel:
    """Cluster reduced vectors (id, vec), learn a map from cluster pairs, project, index."""
    reduced = materialise(reduced, "reduced")
    graph = clusters.neighbour_graph(reduced, min_cluster_size)
    if epsilon is None:
        epsilon = typical_reach(graph, min_cluster_size)
    labels = density.density_clusters(reduced, epsilon, min_cluster_size, min_cluster_size)
    labelled = materialise(reduced.join(labels, "id"), "labelled")
    if not keep_noise and labelled.filter("label != -1").limit(1).count():
        labelled = materialise(assign_outliers(labelled), "labelled")
    made = materialise(pairs.labelled_pairs(labelled), "pairs")
    if not made.filter("label = 0").limit(1).count() or not made.filter("label = 1").limit(1).count():
        made = materialise(pairs.unlabelled_pairs(labelled, graph=graph), "pairs")
    learned = metric.learn(made, labelled, dim, epochs)
    embeddings = materialise(project(labelled.select("id", "vec"), learned.weights), "embeddings")
    centroids = index.train_cells(embeddings, nlist)
    path = scratch_path(reduced.sparkSession, "index")
    index.write_index(index.assign_cells(embeddings, centroids), path)
    return TrainedModel(labelled.select("id", "label"), learned, embeddings, centroids, path)


def typical_reach(graph: DataFrame, min_samples: int) -> float:
    """Median core distance: half of all rows count as dense."""
    return exact_quantiles(clusters.core_distances(graph, min_samples), "core", [0.5])[0]
