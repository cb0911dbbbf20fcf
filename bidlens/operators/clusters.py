"""Cluster summaries, connected components, core distances."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, functions as F

from bidlens.functions.vectors import doubles, l2_distance
from bidlens.operators.stats import vector_summary
from bidlens.operators.vectors import knn
from bidlens.session import materialise, small_side


def sizes(rows: DataFrame, label_col: str = "label") -> DataFrame:
    return rows.groupBy(label_col).agg(F.count(F.lit(1)).alias("size"))


def centroids(rows: DataFrame, label_col: str = "label", vec_col: str = "vec") -> DataFrame:
    """(label, centroid) without noise."""
    found = vector_summary(rows.filter(F.col(label_col) != -1), label_col, vec_col)
    return found.select(label_col, F.col("mean").alias("centroid"))


def statistics(rows: DataFrame, label_col: str = "label", vec_col: str = "vec") -> DataFrame:
    """Size, share, centroid, largest distance to it, and per-feature mean and std of each cluster."""
    total = rows.count()
    clustered = rows.filter(F.col(label_col) != -1)
    summary = small_side(vector_summary(clustered, label_col, vec_col), "clusters")
    reach = (
        clustered.join(summary.select(label_col, "mean"), label_col)
        .groupBy(label_col).agg(F.max(l2_distance(doubles(F.col(vec_col)), F.col("mean"))).alias("diameter"))
    )
    return summary.join(reach, label_col).select(
        label_col, "size", (F.col("size") / F.lit(float(max(total, 1))) * 100.0).alias("percentage"),
        F.col("mean").alias("centroid"), "diameter", F.col("mean").alias("feature_means"), F.col("std").alias("feature_stds"),
    )


def top_features(rows: DataFrame, n: int = 5, label_col: str = "label", vec_col: str = "vec") -> DataFrame:
    """(label, size, place, pos, z_score, cluster_mean, global_mean): features furthest from the overall mean."""
    whole = vector_summary(rows, None, vec_col).first()
    base = F.array(*[
        F.struct(F.lit(float(m)).alias("mean"), F.lit(float(s)).alias("std")) for m, s in zip(whole["mean"], whole["std"])
    ])
    per = vector_summary(rows.filter(F.col(label_col) != -1), label_col, vec_col)
    cells = F.zip_with(
        F.col("mean"), base,
        lambda m, g: F.struct(
            F.when(g["std"] > 0, (m - g["mean"]) / g["std"]).otherwise(F.lit(0.0)).alias("z_score"),
            m.alias("cluster_mean"), g["mean"].alias("global_mean"),
        ),
    )
    ranked = F.sort_array(
        F.transform(
            cells,
            lambda c, i: F.struct(F.round(F.abs(c["z_score"]), 9).alias("importance"), i.alias("pos"),
                                  c["z_score"].alias("z_score"), c["cluster_mean"].alias("cluster_mean"),
                                  c["global_mean"].alias("global_mean")),
        ),
        asc=False,
    )
    flat = per.select(label_col, "size", F.posexplode(F.slice(ranked, 1, n)).alias("place", "f"))
    return flat.select(
        label_col, "size", (F.col("place") + 1).alias("place"), "f.pos", "f.z_score", "f.cluster_mean", "f.global_mean"
    )


def describe(rows: DataFrame, label_col: str = "label", vec_col: str = "vec", names: list[str] | None = None) -> DataFrame:
    """(label, description): the two strongest features in words."""
    top = top_features(rows, 3, label_col, vec_col)
    z = F.col("z_score")
    band = (
        F.when(F.abs(z) > 2.0, F.when(z > 0, "very high").otherwise("very low"))
        .when(F.abs(z) > 1.0, F.when(z > 0, "high").otherwise("low"))
        .otherwise(F.when(z > 0, "slightly above").otherwise("slightly below"))
    )
    name = F.concat(F.lit("feature_"), F.col("pos").cast("string"))
    if names:
        name = F.coalesce(F.get(F.array(*[F.lit(x) for x in names]), F.col("pos")), name)
    said = top.withColumn("phrase", F.concat_ws(" ", band, name)).groupBy(label_col, "size").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "phrase"))), lambda s: s["phrase"]).alias("phrases")
    )
    head = F.concat(
        F.lit("Cluster "), F.col(label_col).cast("string"), F.lit(" ("), F.col("size").cast("string"),
        F.lit(" tenders): Characterized by "), F.array_join(F.slice("phrases", 1, 2), ", "),
    )
    more = F.size("phrases") - 2
    tail = F.concat(F.lit(", and "), more.cast("string"), F.lit(" other distinctive features"))
    return said.select(label_col, F.when(more > 0, F.concat(head, tail)).otherwise(head).alias("description"))


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(id, component): smallest node id that can be reached.

    A round offers the smallest label around a node to the node and to the node
    whose label it carries, then follows the label of the label: the number of
    rounds grows with the logarithm of the longest chain. Offers are reduced per
    task before they move. Each round is written to the shared folder.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, "edges")
    labels = nodes.select("id", F.col("id").alias("component"))
    for _ in count() if max_rounds is None else range(max_rounds):
        there = labels.select(F.col("id").alias("b"), F.col("component").alias("_offer"))
        near = both.join(there, "b").groupBy("a").agg(F.min("_offer").alias("_offer"))
        offers = labels.join(near, F.col("id") == F.col("a")).select(
            F.explode(F.array("id", "component")).alias("_to"), "_offer"
        ).groupBy("_to").agg(F.min("_offer").alias("_offer"))
        lower = labels.join(offers, F.col("id") == F.col("_to"), "left").select(
            "id", F.col("component").alias("_old"), F.least("component", "_offer").alias("component")
        )
        parent = lower.select(F.col("id").alias("_p"), F.col("component").alias("_up"))
        stepped = lower.join(parent, F.col("component") == F.col("_p"), "left").select(
            "id", "_old", F.least("component", "_up").alias("component")
        )
        stepped = materialise(stepped, "components")
        labels = stepped.select("id", "component")
        if stepped.filter(F.col("_old") != F.col("component")).isEmpty():
            return labels
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def neighbour_graph(rows: DataFrame, neighbours: int, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """Nearest rows of every row, written once for all steps that read it."""
    return materialise(knn(rows, neighbours, "l2", id_col, vec_col), "neighbours")


def core_distances(graph: DataFrame, min_samples: int, id_col: str = "id") -> DataFrame:
    """(_id, core): distance to the ``min_samples``-th neighbour."""
    return graph.filter(F.col("rank") == min_samples).select(F.col(id_col).alias("_id"), F.col("distance").alias("core"))


def label_report(rows: DataFrame, label_col: str, vec_col: str) -> DataFrame:
    """One row: rows, clusters, noise rows, vector width."""
    real = F.when(F.col(label_col) != -1, F.col(label_col))
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(real).alias("n_clusters"),
        F.sum((F.col(label_col) == -1).cast("long")).alias("n_outliers"), F.max(F.size(vec_col)).alias("embedding_dim"),
    )


def training_report(rows: DataFrame, label_col: str, vec_col: str, widths: dict[str, int]) -> DataFrame:
    """``label_report`` with the size of every cluster (noise under -1) and the widths of the feature blocks.

    The distribution is one value of as many entries as there are clusters.
    """
    entry = F.struct(F.col(label_col).cast("long").alias("label"), "size")
    counted = sizes(rows, label_col).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    named = F.map_from_entries(F.transform("e", lambda e: F.struct(e["label"].cast("string"), e["size"])))
    dims = F.create_map(*[x for n in sorted(widths) for x in (F.lit(n), F.lit(widths[n]))])
    whole = label_report(rows, label_col, vec_col).withColumn("feature_dimensions", dims)
    return whole.crossJoin(counted.select(named.alias("cluster_distribution")))  # one row each
