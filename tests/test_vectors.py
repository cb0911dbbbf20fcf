import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlens.functions import vectors as vec
from bidlens.operators import clusters, density, features, index, metric, pairs, stats, vectors as vops
from bidlens.operators.evaluation import compare_methods, ranking_metrics, search_quality
from bidlens.operators.sampling import hash_sample, split_column
from bidlens.plans import search
from bidlens.plans.tenders import table


@pytest.fixture(scope="module")
def rows(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), vec.doubles(F.col("embedding")).alias("vec"), "label")


def as_arrays(df):
    data = df.orderBy("id").collect()
    return np.array([r["id"] for r in data]), np.array([r["vec"] for r in data])


def brute_force(x, k):
    d = np.round(np.sqrt(np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1), 0)), 6)
    np.fill_diagonal(d, np.inf)
    return [list(np.lexsort((np.arange(len(x)), row))[:k]) for row in d]


@pytest.mark.parametrize("options", [{}, {"block_rows": 40}, {"cells": 12, "block_rows": 25}, {"cells": 500}])
def test_knn_is_exact_in_every_form(rows, options):
    _, x = as_arrays(rows)
    got = {}
    for r in vops.knn(rows, 4, **options).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert [got[i] for i in range(len(x))] == brute_force(x, 4)


def test_knn_with_many_copies(spark):
    """A third of all rows are the same vector: its cell is split, its ties go by id."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    x[:100] = x[0]
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, vec array<double>")
    got = {}
    for r in vops.knn(df, 3, cells=10, block_rows=20).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert [got[i] for i in range(300)] == brute_force(x, 3)


def test_edges_of_topk(spark, rows):
    asked = rows.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    assert vops.vector_topk(rows, asked.limit(0), 5).count() == 0
    assert vops.vector_topk(rows.limit(0), asked.limit(3), 5).count() == 0
    assert vops.vector_topk(rows, asked.limit(2), 10_000).count() == 2 * rows.count()
    narrow = spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, query_vec array<double>")
    with pytest.raises(Exception, match="widths differ"):
        vops.vector_topk(rows, narrow, 5).collect()
    with pytest.raises(ValueError):
        vops.vector_topk(rows, asked, 5, "taxi")


def test_zero_vectors(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0])], "id long, vec array<double>")
    q = spark.createDataFrame([(9, [2.0, 0.0]), (8, [0.0, 0.0])], "query_id long, query_vec array<double>")
    got = {(r["query_id"], r["id"]): r["score"] for r in vops.vector_topk(df, q, 2).collect()}
    assert got == {(9, 1): 1.0, (9, 0): 0.0, (8, 0): 0.0, (8, 1): 0.0}
    same = vops.vector_topk(df.filter("id = 0"), q.filter("query_id = 8"), 1, "l2").first()
    assert same["score"] == 1.0


def test_outliers(spark):
    df = spark.createDataFrame([(0, [0.0], 5), (1, [10.0], 6), (2, [9.0], -1), (3, [1.0], -1)], "id long, vec array<double>, label int")
    assert {r["id"]: r["label"] for r in vops.assign_outliers(df).collect()} == {0: 5, 1: 6, 2: 6, 3: 5}
    alone = df.withColumn("label", F.lit(-1))
    assert {r["label"] for r in vops.assign_outliers(alone).collect()} == {-1}


def test_density_clusters_find_planted_groups(planted):
    got = {r["id"]: r["label"] for r in density.density_clusters(planted, 1.0, 3, 5).collect()}
    assert {got[i] for i in range(20)} == {0} and {got[i] for i in range(20, 35)} == {20}
    assert {got[i] for i in range(35, 45)} == {35} and {got[i] for i in range(45, 50)} == {-1}


def test_components_of_long_chain(spark):
    n = 300
    order = np.random.default_rng(0).permutation(n)
    nodes = spark.createDataFrame([(int(i),) for i in range(n + 2)], "id long")
    edges = spark.createDataFrame([(int(order[i]), int(order[i + 1])) for i in range(n - 1)], "a long, b long")
    got = clusters.connected_components(nodes, edges, max_rounds=15)
    assert {tuple(r) for r in got.groupBy("component").count().collect()} == {(0, n), (n, 1), (n + 1, 1)}


def test_cells_and_codes_recall(rows):
    asked = rows.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    exact = {(r["query_id"], r["id"]) for r in vops.vector_topk(rows, asked, 5, "l2").collect()}
    cents = index.train_cells(rows, 8)
    built = index.assign_cells(rows.select("id", "vec"), cents)

    def recall(found):
        return len(exact & {(r["query_id"], r["id"]) for r in found.collect()}) / len(exact)

    assert recall(index.ivf_search(built, cents, asked, 5, len(cents))) == 1.0
    few, more = recall(index.ivf_search(built, cents, asked, 5, 1)), recall(index.ivf_search(built, cents, asked, 5, 4))
    assert 0.2 < few < more
    codes = index.ProductCodes.train(rows, 8, 5)
    coded = codes.encode(rows.select("id", "vec"))
    plain, reranked = recall(index.pq_search(coded, codes, asked, 5)), recall(index.pq_search(coded, codes, asked, 5, rows, 10))
    assert plain < reranked and reranked > 0.7
    with pytest.raises(ValueError):
        index.ProductCodes.train(rows, 7)
    planes = index.hyperplanes(64, 8, 3)
    assert recall(index.lsh_topk(rows, asked, 5, planes, "l2")) > 0.5


def test_index_append(spark, rows, tmp_path):
    path = str(tmp_path / "index")
    cents = index.train_cells(rows, 4)
    index.write_index(index.assign_cells(rows.filter("id < 400").select("id", "vec"), cents), path)
    index.append_index(rows.filter("id >= 400").select("id", "vec"), cents, path)
    got = index.read_index(spark, path)
    assert got.count() == rows.count() and got.select("id").distinct().count() == rows.count()


def test_pairs(rows):
    made = pairs.labelled_pairs(rows)
    label = {r["id"]: r["label"] for r in rows.collect()}
    got = made.collect()
    assert all((label[r["id_a"]] == label[r["id_b"]]) == (r["label"] == 1) for r in got)
    assert sum(r["label"] == 0 for r in got) == len(label)
    drawn = pairs.random_pairs(rows).collect()
    assert len(drawn) == len(label) and all(r["id_a"] != r["id_b"] for r in drawn)


def test_pairs_with_one_dominant_label(spark):
    df = spark.range(500).select("id", F.when(F.col("id") < 490, 1).otherwise(F.col("id")).cast("int").alias("label"))
    label = {r["id"]: r["label"] for r in df.collect()}
    bad = pairs.negative_pairs(df).collect()
    assert len(bad) == 500 and all(label[r["id_a"]] != label[r["id_b"]] for r in bad)
    only = df.withColumn("label", F.lit(1))
    assert pairs.negative_pairs(only).count() == 0 and pairs.positive_pairs(only).count() == 500


def test_learning_lowers_the_loss(rows):
    made = pairs.labelled_pairs(rows)
    learned = metric.learn(made, rows, dim=8, epochs=6)
    assert learned.losses[-1] < learned.losses[0]
    assert all(b <= a for a, b in zip(learned.losses, learned.losses[1:]))
    mapped = vops.project(rows.select("id", "vec"), learned.weights)
    again = pairs.contrastive_loss(made, mapped).first()["loss"]
    assert again == pytest.approx(learned.losses[-1], rel=1e-9)


def test_pca(rows):
    out, model = features.pca_reduce(rows, "id", "vec", 5)
    loadings = model.pc.toArray()
    assert np.allclose(loadings.T @ loadings, np.eye(5), atol=1e-8)
    z = np.array([r["vec"] for r in out.collect()])
    cov = np.cov(z.T)
    assert np.allclose(cov - np.diag(np.diag(cov)), 0, atol=1e-6)


def test_cluster_summaries(planted):
    df = planted.withColumn("label", F.when(F.col("id") < 20, 0).when(F.col("id") < 45, 1).otherwise(-1))
    _, x = as_arrays(df)
    got = {r["label"]: r for r in clusters.statistics(df).collect()}
    assert set(got) == {0, 1} and got[1]["size"] == 25 and got[0]["percentage"] == pytest.approx(40.0)
    assert np.allclose(got[1]["centroid"], x[20:45].mean(axis=0)) and np.allclose(got[1]["feature_stds"], x[20:45].std(axis=0))
    assert got[1]["diameter"] == pytest.approx(np.linalg.norm(x[20:45] - x[20:45].mean(axis=0), axis=1).max())


def test_quantiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    values = np.r_[rng.lognormal(3, 2, 2000), np.full(1500, 7.0)]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    probabilities = [0.0, 0.25, 0.5, 0.51, 0.75, 0.999, 1.0]
    want = np.quantile(values, probabilities)
    assert stats.exact_quantiles(df, "v", probabilities) == pytest.approx(list(want))
    monkeypatch.setattr(stats, "FINAL_VALUES", 10)
    monkeypatch.setattr(stats, "BUCKETS", 16)
    assert stats.exact_quantiles(df, "v", probabilities) == pytest.approx(list(want))


def test_field_stats_edges(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (3.0, None, None)], "a double, b double, c double")
    got = {r["field"]: tuple(r)[1:] for r in stats.field_stats(df, ["a", "b", "c"]).collect()}
    assert got == {"a": (1.0, 3.0, 2.0, 1.0, 2), "b": (0.0, 1.0, 0.0, 1.0, 0), "c": (5.0, 5.0, 5.0, 1.0, 1)}


def test_rank_of_one_hot_key(spark):
    df = spark.range(5000).select(F.lit(1).alias("q"), "id", (F.col("id") % 7).alias("score"))
    got = stats.distributed_rank(df, ["q"], [F.desc("score"), F.asc("id")], F.col("id") % 2 == 0).orderBy("rank").collect()
    want = sorted(((r % 7, r) for r in range(5000)), key=lambda t: (-t[0], t[1]))
    assert [r["id"] for r in got] == [i for _, i in want] and [r["rank"] for r in got] == list(range(1, 5001))
    assert got[-1]["hits"] == 2500


def test_ranking_metrics(spark):
    results = spark.createDataFrame([("q", i, 1.0 - i / 10) for i in range(6)] + [("z", 1, 0.5)], "q string, id int, score double")
    relevant = spark.createDataFrame([("q", 1), ("q", 3), ("q", 99)], "q string, id int")
    got = {r["q"]: r for r in ranking_metrics(results, relevant, 2, "q", "id").collect()}
    assert (got["q"]["precision"], got["q"]["recall"], got["q"]["mrr"]) == (0.5, pytest.approx(1 / 3), 0.5)
    assert got["q"]["average_precision"] == pytest.approx((1 / 2 + 2 / 4) / 3)
    assert (got["z"]["recall"], got["z"]["mrr"], got["z"]["average_precision"]) == (0.0, 0.0, 0.0)


def test_quality_and_comparison(spark):
    a = spark.createDataFrame([("x", 0.5), ("x", 0.7), ("y", 0.1)], "q string, score double")
    b = spark.createDataFrame([("x", 0.9)], "q string, score double")
    row = search_quality(a, "q").first()
    assert (row["n_queries"], row["avg_similarity_mean"], row["top_similarity_std"]) == (2, pytest.approx(0.35), pytest.approx(0.3))
    got = {r["method"]: r for r in compare_methods(a, b, a, "q").collect()}
    assert (got["weighted"]["success_rate"], got["vector"]["success_rate"]) == (1.0, 0.5)
    assert got["vector"]["similarity_difference"] == pytest.approx(0.55)


def test_one_hot(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",)] * 2 + [("d",)] + [(None,)], "v string")
    open_, capped = features.OneHot.fit(df, ["v"], 10), features.OneHot.fit(df, ["v"], 3)
    assert open_.kept["v"] == ["", "a", "b", "c", "d"] and open_.width("v") == 5
    assert capped.kept["v"] == ["a", "b"] and capped.width("v") == 3
    new = spark.createDataFrame([("a",), ("zzz",)], "v string")
    assert [r[0] for r in new.select(open_.vector("v")).collect()] == [[0.0, 1.0, 0.0, 0.0, 0.0], [0.0] * 5]
    assert [r[0] for r in new.select(capped.slot("v")).collect()] == [0, 2]


def test_encoders(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, "a b a")], "id int, t string")
    got = {(r["id"], r["token"]): (r["n"], r["weight"]) for r in features.encode_words(df, "id", F.col("t")).collect()}
    assert got[(1, "a")] == (2, pytest.approx(2 / 5 ** 0.5)) and (2, "a") not in got
    once = {r["id"]: r["terms"] for r in features.encode_distinct(df, "id", "t").collect()}
    assert once == {1: 2, 2: 0, 3: 2}


def test_dimension_and_conversion(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    row = df.select(vec.fit_dimension(F.col("v"), 2), vec.fit_dimension(F.col("v"), 5), vec.unit(vec.scaled(F.col("v"), 0.0))).first()
    assert list(row) == [[1.0, 2.0], [1.0, 2.0, 3.0, 0.0, 0.0], [0.0, 0.0, 0.0]]
    scores = spark.createDataFrame([(-0.5,), (0.4,), (1.7,)], "d double")
    assert [r[0] for r in scores.select(vec.distance_to_similarity(F.col("d"))).collect()] == [0.0, 0.4, 1.0]
    assert [r[0] for r in scores.select(vec.distance_to_similarity(F.col("d"), "l2")).collect()] == [1.5, 0.6, 0.0]


def test_samples_are_stable(spark):
    df = spark.range(1000)
    a = [r["id"] for r in hash_sample(df, 50, "id").collect()]
    assert a == [r["id"] for r in hash_sample(df.repartition(7), 50, "id").collect()]
    train = df.filter(split_column(F.col("id")) == "train").count()
    assert 860 < train < 940


def test_training_end_to_end(planted, tmp_path):
    model = search.train(planted, components=6, min_cluster_size=5, dim=4, epochs=3, nlist=4)
    report = model.report().first()
    assert report["n_rows"] == 50 and report["n_clusters"] >= 2 and report["n_outliers"] == 0
    assert report["last_loss"] <= report["first_loss"] and report["embedding_dim"] == 4
    model.save(str(tmp_path / "model"))
    spark = planted.sparkSession
    again = index.read_centroids(spark, str(tmp_path / "model" / "centroids"))
    loaded = search.TrainedModel.load(spark, str(tmp_path / "model"))
    reduced, _ = features.pca_reduce(planted, "id", "vec", 6)
    asked = reduced.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    best = {r["query_id"]: r for r in loaded.search(asked, 1, 4).collect()}
    assert len(best) == 50 and all(r["score"] == 1.0 for r in best.values())
    assert np.allclose(loaded.learned.weights, model.learned.weights) and loaded.report().first() == report
    assert np.allclose(again, model.centroids) and index.read_index(spark, str(tmp_path / "model" / "index")).count() == 50


def test_filter_before_or_after(rows):
    asked = rows.filter("id < 3").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    meta = rows.select("id", "label")
    after = search.vector_find_similar(rows, asked, 5, filters={"label": [1, 2]}, metadata=meta)
    before = search.vector_find_similar(rows, asked, 5, filters={"label": [1, 2]}, metadata=meta, filter_mode="pre")
    assert after.count() < before.count() == 15
    assert {r["label"] for r in before.collect()} <= {1, 2}
    with pytest.raises(ValueError):
        search.vector_find_similar(rows, asked, 5, filter_mode="during")


def test_tender_vectors(spark):
    from bidlens.plans.tenders import prepared

    raw = [("1", "бумага а4", "Тула", "100,00", "15.03.2024 10:30"), ("2", "", "Москва", "300,00", "")]
    t = prepared(spark.createDataFrame(raw, ["tender_id", "title", "region", "price_text", "published_text"]))
    got = {r["id"]: r["vec"] for r in search.tender_vectors(t, ("title",), 4, ("region",)).collect()}
    assert len(got["1"]) == len(got["2"]) == 4 + 2 + 1 + 8
    assert sum(got["1"][:4]) == 2.0 and sum(got["2"][:4]) == 0.0 and got["1"][6] == -1.0 and got["2"][6] == 1.0
    assert got["1"][8] == 0.0


def test_word_counts_have_tasks_by_text(spark, monkeypatch):
    """More text is more tasks, not larger ones; the counts are the same in any number of them."""
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b b c"), F.repeat(F.lit(" d"), F.col("id").cast("int"))).alias("text"))
    want = {tuple(r) for r in features.encode_words(docs, "doc_id", F.col("text")).collect()}
    want_distinct = {tuple(r) for r in features.encode_distinct(docs, "doc_id", "text").collect()}
    monkeypatch.setattr(features, "TASK_TEXT", 50)
    assert features.text_parts(docs) == math.ceil(docs.agg(F.sum(F.length("text"))).first()[0] / 50) > 30
    counted = features.encode_words(docs, "doc_id", F.col("text"))
    assert counted.select(F.spark_partition_id()).distinct().count() > 15
    assert {tuple(r) for r in counted.collect()} == want
    assert {tuple(r) for r in features.encode_distinct(docs, "doc_id", "text").collect()} == want_distinct
    assert features.text_parts(docs.limit(0)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
