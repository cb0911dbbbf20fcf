import numpy as np
import pytest

from bidlens.operators import price


def neighbours(spark, groups):
    rows = [(q, f"t{i}", float(p) if p is not None else None, float(s)) for q, items in groups.items() for i, (p, s) in enumerate(items)]
    return spark.createDataFrame(rows, "q string, tender_id string, price double, score double")


def test_weighted_median_by_hand(spark):
    n = neighbours(spark, {"a": [(1_000_000, 0.9), (1_500_000, 0.8), (800_000, 0.7)]})
    row = price.predict(n, "q").first()
    assert row["predicted_price"] == 1_000_000
    assert row["confidence"] == pytest.approx(0.37)
    assert (row["min_price"], row["max_price"], row["used"], row["total"]) == (800_000, 1_500_000, 3, 3)


def test_methods_against_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {f"g{i}": [(round(p, 2), s) for p, s in zip(rng.lognormal(10, 1, n), rng.uniform(0, 1, n))] for i, n in enumerate([1, 2, 3, 5, 10, 40, 100])}
    groups["same"] = [(5.0, 0.1)] * 6
    groups["zero"] = [(10.0, 0.0), (20.0, 0.0), (30.0, 0.0)]
    n = neighbours(spark, groups)
    for method in price.METHODS:
        got = {r["q"]: r["predicted_price"] for r in price.predict(n, "q", method).collect()}
        for q, items in groups.items():
            prices, scores = np.array([p for p, _ in items]), np.array([s for _, s in items])
            if method == "mode":
                if len(prices) == 1:
                    want = prices[0]
                else:
                    held, edges = np.histogram(prices, bins="auto")
                    i = int(np.argmax(held))
                    want = (edges[i] + edges[i + 1]) / 2
            elif method == "weighted_median":
                w = scores / scores.sum() if scores.sum() > 0 else np.full(len(scores), 1 / len(scores))
                order = np.argsort(prices, kind="stable")
                cum = np.round(np.cumsum(w[order]), 9)
                want = prices[order][np.argmax(cum >= 0.5)]
            else:
                want = {"mean": np.mean, "median": np.median, "min": np.min, "max": np.max}[method](prices)
            assert got[q] == pytest.approx(want), (method, q)


def test_missing_prices(spark):
    n = neighbours(spark, {"none": [(None, 0.5), (None, 0.4)], "some": [(None, 0.5), (100.0, 0.4)]})
    got = {r["q"]: r for r in price.predict(n, "q").collect()}
    assert (got["none"]["predicted_price"], got["none"]["confidence"], got["none"]["used"], got["none"]["total"]) == (None, 0.0, 0, 2)
    assert (got["some"]["predicted_price"], got["some"]["used"], got["some"]["total"]) == (100.0, 1, 2)
    assert got["some"]["confidence"] == pytest.approx(0.1)


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        price.predict(neighbours(spark, {"a": [(1, 1)]}), "q", "magic")
