import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F, types as T

from bidlens.operators.catalog import apply_filters, exclude_one_identical, post_filter, targets_from_criteria
from bidlens.plans.tenders import canonical_tenders, typed_tenders
from bidlens.sources import html
from bidlens.sources.json_records import essential, read_json_records, write_results
from bidlens.sources.upsert import append_changes, current_state, upsert, upsert_stats
from bidlens.streaming.ingest import stream_upsert

RECORD = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType())])


@pytest.mark.parametrize("whole", [False, True])
def test_json_roots(spark, tmp_path, whole):
    one = [{"id": "1", "name": "a"}, {"id": "2", "name": "б"}]
    docs = {
        "list": one, "tenders": {"tenders": one}, "data": {"data": one}, "results": {"results": one}, "single": one[0], "empty": [],
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, ensure_ascii=False, indent=2 if whole else None), encoding="utf-8")
    (tmp_path / "broken.json").write_text('{"tenders": [', encoding="utf-8")
    got = sorted((r["id"], r["name"]) for r in read_json_records(spark, str(tmp_path), RECORD, whole_files=whole).collect())
    assert got == sorted([("1", "a"), ("2", "б")] * 4 + [("1", "a")])


def test_broken_json_can_end_the_job(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id": ', encoding="utf-8")
    with pytest.raises(Exception):
        read_json_records(spark, str(tmp_path), RECORD, on_error="raise").collect()
    with pytest.raises(ValueError):
        read_json_records(spark, str(tmp_path), RECORD, on_error="maybe")


PAGE = """
<script>var t = '<section><span class="section__title">no</span><span class="section__info">no</span></section>';</script>
<section class="s"><span class="section__title"> Регион&nbsp;</span><span class="section__info">Москва \n &amp; область</span></section>
<section><span class="section__info">first</span></section>
<section><span class="section__title">Empty</span></section>
<section><span class="section__title">Регион</span><span class="section__info">Тула</span></section>
<section><span class="section__info">second</span></section>
<div class="row no-gutters registry-entry__form mr-0"><div class="registry-entry__header-mid__number"><a href="/order/1">1</a></div><a href="/no">x</a></div>
<div class="row no-gutters registry-entry__form mr-0"><div class="registry-entry__header-mid__number"><a target="_blank" href="/order/2">2</a></div></div>
"""


def test_procurement_pages(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>nothing</p>")], "page int, html string")
    got = {r["title"]: r["info"] for r in html.sections(pages, "page", F.col("html")).collect()}
    assert got == {"Регион": "Тула", "unnamed1": "first", "unnamed2": "second"}
    folded = html.as_map(html.sections(pages, "page", F.col("html")), "page").first()
    assert folded["raw"] == got
    links = [(r["pos"], r["link"]) for r in html.links(pages, "page", F.col("html"), prefix="https://t.example").collect()]
    assert links == [(0, "https://t.example/order/1"), (1, "https://t.example/order/2")]


def test_typed_mapping(spark):
    raw = {
        "Идентификационный код закупки (ИКЗ)": "42", "Наименование объекта закупки": "Бумага", "Регион": "Тула",
        "Дата и время начала срока подачи заявок": "01.02.2024 09:00", "Дата и время окончания срока подачи заявок": "bad",
        "Максимальное значение цены контракта": "110 985,66", "Требуется обеспечение заявки": "Да",
        "Размер обеспечения заявки": "554,93 РОССИЙСКИЙ РУБЛЬ", "Требуется обеспечение исполнения контракта": "Нет",
        "Размер обеспечения исполнения контракта": "10 %", "Место поставки товара": "склад", "Номер контактного телефона": "8 (000) 1",
    }
    df = spark.createDataFrame([(raw,)], "raw map<string,string>")
    row = typed_tenders(df).first()
    assert (row["icz"], row["initial_price"], row["end_date_time"]) == ("42", Decimal("110985.66"), None)
    assert (row["bid_security_required"], row["bid_security_amount"]) == (True, "554,93")
    assert (row["performance_required"], row["performance_security_size"]) == (False, None)
    assert (row["delivery_place"], row["phone"], row["email"], row["advantages"]) == ("склад", "8(000)1", "", "")
    assert len(row) == 22
    named = canonical_tenders(df).first()
    assert (named["price_text"], named["published_text"], named["title"], named["method"]) == ("110 985,66", "01.02.2024 09:00", "Бумага", None)


COLS = "icz string, object_name string, n int, ord int"


def test_upsert_and_counts(spark):
    target = spark.createDataFrame([("a", "old a", 1, 0), ("b", "old b", 1, 0)], COLS)
    batch = spark.createDataFrame(
        [("a", "new a", 2, 1), ("c", "c1", 3, 2), ("c", "c2", 4, 3), ("", "x", 0, 4), ("d", "", 0, 5), (None, "y", 0, 6)], COLS
    )
    out = {r["icz"]: (r["object_name"], r["n"]) for r in upsert(target, batch, ["ord"]).collect()}
    assert out == {"a": ("new a", 2), "b": ("old b", 1), "c": ("c2", 4)}
    assert list(upsert_stats(target, batch).first()) == [1, 2, 3]


def test_rows_without_required_fields_are_errors(spark):
    target = spark.createDataFrame([], COLS + ", initial_price decimal(15,2)")
    batch = spark.createDataFrame([("a", "x", 1, 1, None), ("b", "y", 1, 2, Decimal("1"))], COLS + ", initial_price decimal(15,2)")
    assert [r["icz"] for r in upsert(target, batch, ["ord"]).collect()] == ["b"]
    assert list(upsert_stats(target, batch).first()) == [1, 0, 1]


def test_a_hot_key_keeps_its_last_row(spark):
    batch = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("icz"),
        F.lit("t").alias("object_name"), F.col("id").cast("int").alias("n"), F.col("id").cast("int").alias("ord"),
    )
    out = upsert(spark.createDataFrame([], COLS), batch, ["ord"])
    assert out.filter("icz = 'hot'").first()["n"] == 19_998
    assert out.count() == 1 + 20_000 - 6_667


def test_change_log_is_safe_to_repeat(spark, tmp_path):
    path = str(tmp_path / "log")
    first = spark.createDataFrame([("a", "1", 1, 1), ("b", "1", 1, 2)], COLS)
    append_changes(path, first, 0, ["ord"])
    append_changes(path, spark.createDataFrame([("a", "2", 2, 0)], COLS), 1, ["ord"])
    append_changes(path, spark.createDataFrame([("a", "2", 2, 0)], COLS), 1, ["ord"])
    got = {r["icz"]: r["n"] for r in current_state(spark.read.parquet(path), ["ord"]).collect()}
    assert got == {"a": 2, "b": 1}


def test_stream_without_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    schema = spark.createDataFrame([], COLS).schema
    state = stream_upsert(spark, str(tmp_path / "src"), schema, lambda d: d, str(tmp_path / "log"), str(tmp_path / "check"), ["ord"])
    assert state.count() == 0


def test_stream_takes_only_new_files(spark, tmp_path):
    src, log, check = (str(tmp_path / n) for n in ("src", "log", "check"))
    schema = spark.createDataFrame([], COLS).schema
    spark.createDataFrame([("a", "1", 1, 1), ("a", "2", 2, 2), ("", "bad", 0, 3)], COLS).write.parquet(src)
    state = stream_upsert(spark, src, schema, lambda d: d, log, check, ["ord"])
    assert [(r["icz"], r["n"]) for r in state.collect()] == [("a", 2)]
    spark.createDataFrame([("a", "3", 3, 0), ("b", "1", 1, 1)], COLS).write.mode("append").parquet(src)
    state = stream_upsert(spark, src, schema, lambda d: d, log, check, ["ord"])
    assert sorted((r["icz"], r["n"]) for r in state.collect()) == [("a", 3), ("b", 1)]
    again = stream_upsert(spark, src, schema, lambda d: d, log, check, ["ord"])
    assert sorted((r["icz"], r["n"]) for r in again.collect()) == [("a", 3), ("b", 1)]


def test_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, s string")
    def ids(d):
        return sorted(r["n"] for r in d.collect())
    assert ids(apply_filters(df, {"s": "a"})) == [1]
    assert ids(apply_filters(df, {"n": {"min": 2, "max": 3}})) == [2, 3]
    assert ids(apply_filters(df, {"n": {"min": 2}})) == [1, 2, 3]
    assert ids(apply_filters(df, {"s": {"in": ["a", "b"]}})) == [1, 2]
    assert ids(apply_filters(df, {"absent": "x"})) == []
    assert ids(post_filter(df, {"s": ["a"], "absent": "x"})) == [1, 3]
    assert ids(post_filter(df, {"n": 2})) == [2]
    assert ids(apply_filters(df, None)) == [1, 2, 3]


def test_exclude_one_identical(spark):
    rows = spark.createDataFrame([(1, "x", None), (2, "x", None), (3, "y", "k"), (4, "x", "k")], "pos int, a string, b string")
    target = spark.createDataFrame([("x", None)], "a string, b string")
    assert sorted(r["pos"] for r in exclude_one_identical(rows, target, ["a", "b"], "pos").collect()) == [2, 3, 4]


def test_criteria(spark):
    rows = [(1, 0, "region", "Тула"), (1, 1, "min_price", "1"), (1, 2, "max_price", "9"), (1, 3, "colour", "red"), (2, 0, "keywords", "бумага")]
    got = targets_from_criteria(spark.createDataFrame(rows, "query int, ord int, key string, value string")).orderBy("query").collect()
    assert (got[0]["region"], got[0]["price_text"], got[0]["title"]) == ("Тула", "9", None)
    assert got[1]["title"] == "бумага"


def test_results_sink(spark, tmp_path):
    df = spark.createDataFrame([("1", "t", 0.5, "x")], "tender_id string, title string, score double, secret string")
    assert essential(df).columns == ["tender_id", "title"]
    write_results(df, str(tmp_path / "r"), include_full=False, keep=["score"])
    assert set(spark.read.json(str(tmp_path / "r")).columns) == {"tender_id", "title", "score"}
