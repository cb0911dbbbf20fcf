"""Pruned search over a written history: the same rows as comparing everything, however it is asked."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bidlens.operators import history
from bidlens.operators.composite import Similarity, composite_scorer, composite_topk
from bidlens.operators.encoding import HashedWords, WordTable, composite_vectors, encode_fields
from bidlens.operators.history import Bounds, HistoryIndex
from bidlens.plans.tenders import order_tenders, prepared

OPTIONS = [
    Similarity(), Similarity(numeric="exponential", temporal="gaussian", scale_days=500), Similarity(numeric="inverse", scale=50_000.0, temporal="linear"),
    Similarity(encoder=lambda: HashedWords(12)),
]


@pytest.fixture(scope="module")
def tenders(spark, sf):
    return prepared(order_tenders(spark, sf)).cache()


@pytest.fixture(scope="module")
def built(tenders):
    return HistoryIndex.build(tenders)


def hits(df):
    return {(r["target_id"], r["tender_id"], r["rank"], r["score"]) for r in df.collect()}


@pytest.mark.parametrize("similarity", OPTIONS)
@pytest.mark.parametrize("weights", [None, {"text": 0.2, "price": 0.5, "date": 0.3}])
def test_pruning_loses_nothing(tenders, built, similarity, weights):
    asked = tenders.filter("o_orderkey % 97 = 0")
    want = composite_topk(tenders, asked, 7, weights, similarity=similarity)
    assert hits(built.topk(asked, 7, weights, similarity=similarity)) == hits(want)


def test_few_blocks_are_opened(tenders, built, monkeypatch):
    asked, opened = tenders.filter("o_orderkey % 97 = 0"), []
    weights = {"text": 0.5, "region": 0.3, "method": 0.2}
    got = built.topk(asked, 3, weights, opened=opened)
    assert hits(got) == hits(composite_topk(tenders, asked, 3, weights))
    scored = opened[0].agg(F.sum("n")).first()[0]
    assert scored < 0.9 * asked.count() * tenders.count()


@pytest.mark.parametrize("similarity", OPTIONS[:3])
def test_bounds_are_never_below_a_score(tenders, built, similarity):
    slim = tenders.withColumn("published_s", F.unix_micros("published") / 1e6).select("tender_id", *history.SCORED)
    targets = slim.filter("tender_id like '%7'").toPandas()
    targets.loc[0, ["price", "title"]] = [-5.0, "word word other"]
    rows = built.rows.withColumn("published_s", F.unix_micros("published") / 1e6).select("block", *history.SCORED).toPandas()
    rows.loc[rows.index[::11], "price"] *= -1
    rows.loc[rows.index[::13], "published_s"] = np.nan
    bounds, scorer = Bounds(targets, None, None, None, similarity), composite_scorer(similarity=similarity)(targets)
    for _, block in rows.groupby("block"):
        assert (bounds.of(history._summary(block)) >= np.round(scorer(block), 6).max(axis=0)).all()


def test_many_targets_meet_all_blocks(tenders, built, monkeypatch):
    asked = tenders.filter("o_orderkey % 50 = 0")
    want = hits(built.topk(asked, 4))
    monkeypatch.setattr(history, "bounded_rows", lambda df: None)
    assert hits(built.topk(asked, 4)) == want


def test_rows_without_id_stay_apart(spark):
    def rows(ids):
        out = [(i, "red ring", "", "", "north", "open", float(p), "EUR") for i, p in ids]
        df = spark.createDataFrame(out, "tender_id string, title string, description string, customer string, region string, method string, price double, currency string")
        return df.withColumns({"published": F.lit(None).cast("timestamp"), "funding": F.lit(""), "status": F.lit(""), "platform": F.lit("")})

    built = HistoryIndex.build(rows([("", 10), ("", 10), ("", 10), ("a", 10), ("a", 20), ("", 5e6)]))
    got = built.topk(rows([("", 10), ("", 10), ("a", 10), ("", 77)]), 10).toPandas()
    per = [g.sort_values("rank") for _, g in got.groupby("target_row")]
    assert [len(g) for g in per] == [5, 5, 4, 6]  # one equal row less, one less, both of its id less, all
    assert all(list(g["rank"]) == list(range(1, len(g) + 1)) and g["row"].is_unique for g in per)
    assert built.topk(rows([]), 3).count() == 0 and built.topk(rows([("", 10)]), 0).count() == 0
    assert HistoryIndex.build(rows([])).topk(rows([("", 10)]), 3).count() == 0


def test_options_are_checked():
    for wrong in ({"numeric": "cubic"}, {"temporal": "weekly"}):
        with pytest.raises(ValueError):
            Similarity(**wrong)


def test_an_encoder_is_loaded_once_per_task(spark, tmp_path):
    marks = str(tmp_path)

    def load():
        import uuid

        open(f"{marks}/{uuid.uuid4().hex}", "w").close()
        return WordTable({"red": [1.0, 0.0], "ring": [0.0, 2.0]})

    df = spark.createDataFrame([(k, "red ring" if k % 2 else None) for k in range(40)], "id long, title string").coalesce(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = encode_fields(df, ["title"], load).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(list(v) == ([1.0, 2.0] if k % 2 else [0.0, 0.0]) for k, v in zip(got["id"], got["title_vec"]))
    import os

    assert len(os.listdir(marks)) == df.rdd.getNumPartitions()


def test_composite_vectors_leave_out_empty_fields(spark):
    df = spark.createDataFrame([(1, "red", ""), (2, "red", "ring ring"), (3, "", "")], "id long, title string, customer string")
    got = {r["id"]: r["vec"] for r in composite_vectors(df, "id", {"title": 0.6, "customer": 0.2}, lambda: WordTable({"red": [3.0, 0.0], "ring": [0.0, 1.0]})).collect()}
    assert got[1] == [1.0, 0.0] and got[2] == pytest.approx([0.75, 0.25]) and got[3] == [0.0, 0.0]


@pytest.mark.parametrize("weights", [{"price": 0.5, "date": 0.3, "method": 0.2}, {"date": 0.6, "price": 0.4}])
def test_layout_follows_the_weights(tenders, monkeypatch, weights):
    """Price and date leave out blocks too where a history is laid out for them; the result stays."""
    monkeypatch.setattr(history, "BLOCK_BITS", 4)
    asked, shares, found = tenders.filter("o_orderkey % 97 = 0"), [], []
    how = Similarity(numeric="inverse", temporal="linear", scale_days=400.0)
    for laid in (None, weights):
        opened = []
        got = HistoryIndex.build(tenders, weights=laid).topk(asked, 3, weights, similarity=how, opened=opened)
        found.append(hits(got))
        shares.append(opened[0].agg(F.sum("n")).first()[0] / (asked.count() * tenders.count()))
    assert found[0] == found[1] == hits(composite_topk(tenders, asked, 3, weights, similarity=how))
    assert shares[1] < 0.5 * shares[0]


def test_layout_without_known_dates(spark, tenders, monkeypatch):
    """Missing dates and prices of one value are laid out like any others."""
    monkeypatch.setattr(history, "BLOCK_BITS", 4)
    rows = tenders.withColumn("published", F.when(F.col("o_orderkey") % 5 == 0, F.col("published"))).withColumn("price", F.lit(9.0)).cache()
    weights, asked = {"date": 0.7, "price": 0.3}, rows.filter("o_orderkey % 97 = 0")
    got = HistoryIndex.build(rows, weights=weights).topk(asked, 3, weights)
    assert hits(got) == hits(composite_topk(rows, asked, 3, weights))
