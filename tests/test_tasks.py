"""What a task holds, sends or compiles where tables grow."""

import re

import numpy as np

from bidlens.operators import catalog
from bidlens.operators.vectors import _block_rows, knn
from bidlens.plans.tenders import prepared
from registry.queries import QUERIES


def test_criteria_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(catalog, "TASK_CRITERIA", 10)
    rows = [(i, 0, "region", f"r{i}") for i in range(200)] + [(i, 1, "region", f"s{i}") for i in range(0, 200, 2)]
    got = catalog.targets_from_criteria(spark.createDataFrame(rows, "query int, ord int, key string, value string"))
    assert got.rdd.getNumPartitions() == 30
    assert {r["query"]: r["region"] for r in got.collect()} == {i: f"s{i}" if i % 2 == 0 else f"r{i}" for i in range(200)}


def test_fused_vectors_do_not_move(spark, sf):
    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    plan = QUERIES["fuse_features"](spark, sf)._jdf.queryExecution().optimizedPlan()
    joins = [n for n in nodes(plan) if n.nodeName() == "Join"]
    kinds = [n.output().apply(i).dataType().simpleString() for n in joins for i in range(n.output().size())]
    assert joins and "array<double>" not in kinds


def test_prepared_is_compiled(spark, tmp_path, capsys):
    """The JVM does not compile methods of more than 8000 bytes."""
    row = ("IKZ1", "5-LOW", "48 246,70", "09.08.1996 10:30", "O", "RUB", "Small\u00a0Gizmo!", "STANDARD Brand#19", "Brand#19", "27.10.2001 00:00", "Customer#7", "BUILDING", "N", "A")
    odd = ("IKZ2", None, "от 1.234,5 руб", "09.08.1996г  7:05", None, None, None, "", None, None, None, None, None, None)
    names = "tender_id method price_text published_text status currency title description platform closes_text customer funding region district"
    spark.createDataFrame([row, odd], ", ".join(f"{n} string" for n in names.split())).write.parquet(str(tmp_path / "t"))
    got = prepared(spark.read.parquet(str(tmp_path / "t")))
    got.explain("codegen")
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)) <= 8000
    first, second = got.selectExpr("*", "cast(published as string) as day").orderBy("tender_id").collect()
    assert (first["title"], first["description"], first["customer"]) == ("small gizmo", "standard brand 19", "customer 7")
    assert (first["price"], first["offer_price"], first["day"]) == (48246.7, 48246.7, "1996-08-09 10:30:00")
    assert (second["title"], second["offer_price"], second["day"]) == ("", 1234.5, "1996-08-09 07:05:00")


def test_neighbour_blocks_follow_bytes(spark):
    assert _block_rows(10_000_000, 16, 8) == 1 << 17 and _block_rows(10_000_000, 1 << 14, 8) == 1 << 14
    assert _block_rows(1000, 16, 8) == 256
    x = np.random.default_rng(3).normal(size=(700, 4))
    rows = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, vec array<double>")
    far = np.linalg.norm(x[:, None] - x[None], axis=2) + np.diag(np.full(700, np.inf))
    for cells in (None, 5):
        got = {(r["id"], r["rank"]): r["neighbour"] for r in knn(rows, 2, cells=cells).collect()}
        assert all(got[i, 1] == far[i].argmin() for i in range(700)) and len(got) == 1400
