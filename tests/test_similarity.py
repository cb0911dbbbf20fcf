import pytest
from pyspark.sql import functions as F

from bidlens.functions import kernels, vectors as vec
from bidlens.operators.composite import composite_topk, embedding_topk, with_breakdown
from bidlens.plans import search
from bidlens.plans.tenders import prepared
from bidlens.schema import COMPONENTS, WEIGHT_PRESETS, normalised_weights

NAMES = ["tender_id", "title", "description", "customer", "region", "method", "price_text", "published_text", "currency", "funding", "status"]


def pairs(spark, values, expr):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(values)], "i int, a string, b string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("a"), F.col("b"))).collect()]


@pytest.fixture(scope="module")
def tenders(spark):
    rows = [
        ("1", "Поставка компьютерной техники", "Закупка компьютеров", "Министерство образования", "Москва", "Электронный аукцион", "1 250 000,00", "15.03.2024 10:30", "RUB", "Бюджет", ""),
        ("2", "Поставка оргтехники", "Закупка техники техники", "Министерство", "Московская область", "Аукцион", "1 100 000,00", "20.03.2024 14:00", "RUB", "Бюджет города", "x"),
        ("3", "Ремонт дороги", "", "", "", "Конкурс", "ноль", "invalid", "", "", ""),
        ("4", "поставка поставка бумаги", "Бумага А4", "Школа 5", "г. Москва", "Запрос цен", "500,50", "01.01.1970", "rub", "бюджет", "y"),
        ("5", "Поставка компьютерной техники", "Закупка компьютеров", "Министерство образования", "СПб", "Электронные торги", "1 250 000,00", "15.03.2024 10:30", "RUB", "Бюджет", "x"),
        ("6", "", "", "", "Петербург", "", "", "", "", "", ""),
    ]
    return prepared(spark.createDataFrame(rows, NAMES))


def test_cosine_literals(spark):
    cases = [([1, 0, 0], [1, 0, 0], 1.0), ([1, 0, 0], [0, 1, 0], 0.0), ([1, 0, 0], [-1, 0, 0], -1.0), ([0, 0, 0], [1, 0, 0], 0.0)]
    df = spark.createDataFrame([(i, [float(x) for x in a], [float(x) for x in b]) for i, (a, b, _) in enumerate(cases)], "i int, a array<double>, b array<double>")
    got = [r[0] for r in df.orderBy("i").select(vec.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [e for _, _, e in cases]


def test_regions(spark):
    cases = [("Москва", "Москва"), ("москва", "МОСКВА"), ("Москва", "Московская область"), ("г. Москва", "Москва город"), ("Москва", "СПб"), ("", "Москва"), (None, "x")]
    assert pairs(spark, cases, kernels.region_similarity) == [1.0, 1.0, 0.5, 0.8, 0.0, 0.0, 0.0]


def test_methods(spark):
    cases = [("Аукцион", "Аукцион"), ("Электронный аукцион", "Аукцион"), ("Конкурс", "Закрытый конкурс"), ("прямой Конкурс", "Конкурс"), ("a", "b"), ("", "")]
    assert pairs(spark, cases, kernels.method_similarity) == [1.0, 0.8, 0.8, 0.3, 0.0, 0.0]


def test_categories(spark):
    cases = [("a", "A"), ("ab", "abc"), ("x", "y"), ("p", "q"), (None, "a")]
    assert pairs(spark, cases, lambda a, b: kernels.categorical_similarity(a, b, {"g": ["p", "q"]})) == [1.0, 0.3, 0.0, 0.5, 0.0]


def test_texts_with_repeated_words(spark):
    cases = [("a a b", "a b"), ("a b", "c d"), ("a", "a"), ("", "a")]
    got = pairs(spark, cases, kernels.text_similarity)
    assert got == pytest.approx([3 / (5 ** 0.5 * 2 ** 0.5), 0.0, 1.0, 0.0])


def test_missing_values(spark):
    df = spark.createDataFrame([(0.0, 0.0, None)], "p double, q double, d timestamp")
    row = df.select(kernels.numeric_similarity(F.col("p"), F.col("q"), kernels.price_scale(F.col("p"), F.col("q"))), kernels.temporal_similarity(F.col("d"), F.col("d"))).first()
    assert list(row) == [1.0, 0.0]


def test_unknown_kernel(spark):
    with pytest.raises(ValueError):
        kernels.numeric_similarity(F.lit(1.0), F.lit(2.0), 1.0, "cubic")
    with pytest.raises(ValueError):
        kernels.temporal_similarity(F.lit(None), F.lit(None), 1.0, "cubic")


@pytest.mark.parametrize("preset", list(WEIGHT_PRESETS))
def test_block_scores_equal_column_scores(spark, tenders, preset):
    weights = WEIGHT_PRESETS[preset]
    found = composite_topk(tenders, tenders, 10, weights)
    detailed = with_breakdown(found, tenders, tenders, 10, weights)
    rows = detailed.withColumn("again", kernels.composite_score({n: F.col(f"parts.{n}") for n in COMPONENTS}, weights)).collect()
    assert len(rows) == 30
    for r in rows:
        assert r["again"] == pytest.approx(r["score"], abs=1e-6)


def test_k_and_threshold(spark, tenders):
    assert composite_topk(tenders, tenders, 0).count() == 0
    assert composite_topk(tenders, tenders, -1).count() == 0
    assert composite_topk(tenders, tenders, 100).count() == 30
    top = composite_topk(tenders, tenders, 1).filter("target_id = '1'").first()
    assert (top["tender_id"], top["rank"]) == ("5", 1)
    strict = composite_topk(tenders, tenders, 10, min_similarity=0.9).collect()
    assert all(r["score"] >= 0.9 for r in strict)


def test_identical_rows_without_date_score_half(spark):
    same = [(str(i), "Тест", "", "", "Москва", "", "100", "", "", "", "") for i in range(5)]
    t = prepared(spark.createDataFrame(same, NAMES))
    got = composite_topk(t, t.filter("tender_id = '0'"), 10).collect()
    assert [r["score"] for r in got] == [0.5] * 4


def test_explanation(spark, tenders):
    out = search.find_similar(tenders, tenders.filter("tender_id = '1'"), 1).first()
    assert out["explanation"].startswith("strong similarity (score: 0.7") or out["explanation"].startswith("very strong")
    assert " due to high text similarity (1.00)" in out["explanation"]
    assert (out["k_requested"], out["k_returned"]) == (1, 1)


def test_weights():
    assert sum(normalised_weights({"a": 2.0, "b": 2.0}).values()) == 1.0
    assert normalised_weights({"a": 0.0}) == {"a": 0.0}
    for w in WEIGHT_PRESETS.values():
        assert sum(w.values()) == pytest.approx(1.0)


def test_embedding_search(spark, tenders):
    got = embedding_topk(tenders, tenders.filter("tender_id = '1'"), 2).collect()
    assert (got[0]["tender_id"], got[0]["score"]) == ("5", 1.0)


def test_targets_beyond_the_broadcast_bound_meet_in_blocks(spark, tenders, monkeypatch):
    from bidlens.operators import topk as module

    want = composite_topk(tenders, tenders, 3).orderBy("target_id", "rank").collect()
    monkeypatch.setattr(module, "bounded_rows", lambda df: None)
    got = composite_topk(tenders, tenders, 3).orderBy("target_id", "rank").collect()
    assert got == want


def test_candidates_without_id_are_not_the_target(spark):
    names = ["tender_id", "title"]
    pool = prepared(spark.createDataFrame([("", "red ring"), ("", "blue ring"), ("X", "red ring")], names))
    lone, known = (prepared(spark.createDataFrame([(i, "red ring")], names)) for i in ("", "X"))
    assert sorted(r.tender_id for r in composite_topk(pool, lone, 5).collect()) == ["", "", "X"]
    assert sorted(r.tender_id for r in composite_topk(pool, known, 5).collect()) == ["", ""]


def test_neighbours_state_prices_in_both_conventions_and_in_later_fields(spark):
    names = ["tender_id", "title", "price_text", "contract_price_text"]
    rows = [("a", "red ring", "1.250.000,00", ""), ("b", "red ring", "1,250.50", "7"), ("c", "red ring", None, "1 000,5"), ("d", "red ring", "0", "")]
    target = prepared(spark.createDataFrame([("t", "red ring", "", "")], names))
    found = search.priced_neighbours(prepared(spark.createDataFrame(rows, names)), target, 4)
    assert {r.tender_id: r.price for r in found.collect()} == {"a": 1250000.0, "b": 1250.5, "c": 1000.5, "d": None}


def test_prepared_makes_each_text_once(spark):
    """Price and date texts are cleaned in a step of their own, not again for every rule that reads them."""
    plan = prepared(spark.createDataFrame([("1", "12,50", "15.03.2024")], "tender_id string, price_text string, published_text string"))
    shown = plan._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count(r"[^\d.,]") == 1
    assert plan.select("price", "offer_price", F.date_format("published", "yyyy-MM-dd").alias("day")).first() == (12.5, 12.5, "2024-03-15")


def test_prepared_keeps_columns_named_like_steps(spark):
    df = spark.createDataFrame([("1", "7", "a", "b")], "tender_id string, price_text string, _number string, _day string")
    assert prepared(df).select("price", "_number", "_day").first() == (7.0, "a", "b")
