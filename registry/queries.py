"""One query per operator, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from bidlens.functions import kernels, numbers, text, vectors as vec
from bidlens.functions.dates import FEATURES, date_features, parse_date, temporal_vector
from bidlens.operators import (
    catalog, clusters, density, evaluation, features, index, metric, pairs, price, sampling, stats, vectors as vops,
)
from bidlens.operators.composite import Similarity, composite_topk, embedding_topk, with_breakdown
from bidlens.operators.encoding import HashedWords, composite_vectors
from bidlens.operators.history import HistoryIndex
from bidlens.operators.encoder import TenderEncoder, feature_dimensions as block_widths, slot_names
from bidlens.plans import search
from bidlens.plans.model import TenderSearch, TenderSearchModel, encodable
from bidlens.plans.tenders import (
    canonical_tenders as canonical, customer_places, day_text, money_text, order_tenders, prepared, preprocess, table, typed_tenders as typed,
)
from bidlens.schema import COMPONENTS
from bidlens.session import materialise, scratch_path
from bidlens.sources import html
from bidlens.sources.json_records import essential, read_json_records
from bidlens.sources.upsert import append_changes, compact, compacted_state, upsert, upsert_stats
from bidlens.streaming.ingest import stream_upsert
from registry.inputs import (
    consecutive, groups, label_queries, new_and_history, noisy_vectors, prepared_tenders, r6, vector_pairs, vectors,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Patterns for the driver pages: nav links, and a heading with its first paragraph
# or any other paragraph as a section.
PAGE_SECTION = r"(?is)(<h1\b[^>]*>.*?</h1>\s*<p\b[^>]*>.*?</p>|<p\b[^>]*>.*?</p>)"
PAGE_TITLE = r"(?is)<h1\b[^>]*>(.*?)</h1>"
PAGE_INFO = r"(?is)<p\b[^>]*>(.*?)</p>"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- sources and sinks -------------------------------------------------------

@query
def json_scan(spark, sf):
    events = table(spark, sf, "events")
    record = F.to_json(F.struct("event_id", "user_id", "event_type", "value", "props"))
    doc = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("["), record, F.lit("]")))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"tenders":['), record, F.lit("]}")))
        .otherwise(record)
    )
    path = scratch_path(spark, "json")
    events.select(doc.alias("value")).write.text(path)
    schema = T.StructType([f for f in events.schema.fields if f.name != "ts"])
    rows = read_json_records(spark, path, schema)
    return rows.select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query
def page_links(spark, sf):
    return html.links(table(spark, sf, "pages", "page_id"), "page_id", F.col("html"), html.ANY_LINK, "https://tenders.example")


@query
def page_sections(spark, sf):
    return html.sections(table(spark, sf, "pages", "page_id"), "page_id", F.col("html"), PAGE_SECTION, PAGE_TITLE, PAGE_INFO)


@query
def essential_projection(spark, sf):
    return essential(order_tenders(spark, sf))


def raw_tenders(spark, sf) -> DataFrame:
    """Tenders the way pages give them: one title -> text map per row."""
    t = order_tenders(spark, sf)
    yes, no = F.lit("Да"), F.lit("Нет")
    urgent = F.col("method").isin("1-URGENT", "2-HIGH")
    online = "электронной площадки в информационно-телекоммуникационной сети «Интернет»"
    cells = {
        "Идентификационный код закупки (ИКЗ)": F.col("tender_id"),
        "Наименование объекта закупки": F.col("title"),
        "Организация, осуществляющая размещение": F.col("customer"),
        "Регион": F.col("region"),
        "Способ определения поставщика (подрядчика, исполнителя)": F.col("method"),
        "Этап закупки": F.col("status"),
        "Дата и время начала срока подачи заявок": F.col("published_text"),
        "Дата и время окончания срока подачи заявок": F.col("closes_text"),
        "Дата подведения итогов определения поставщика (подрядчика, исполнителя)": F.col("closes_text"),
        "Начальная (максимальная) цена контракта": F.when(F.col("status") == "P", "").otherwise(F.col("price_text")),
        "Максимальное значение цены контракта": F.when(F.col("status") == "P", F.col("price_text")),
        "Требования к участникам": F.col("funding"),
        "Место поставки товара": F.col("district"),
        "Требуется обеспечение заявки": F.when(urgent, yes).otherwise(no),
        "Размер обеспечения заявки": F.concat(F.col("price_text"), F.lit(" РОССИЙСКИЙ РУБЛЬ")),
        "Требуется обеспечение исполнения контракта": F.when(F.col("status") == "F", yes).otherwise(no),
        "Размер обеспечения исполнения контракта": F.lit("10 %"),
        "Номер контактного телефона": F.concat(F.lit("+7 (495) "), F.col("tender_id"), F.lit(" доб. 12-3")),
        f"Наименование {online}": F.col("platform"),
    }
    pairs_ = [x for k, v in cells.items() for x in (F.lit(k), v)]
    return t.select("o_orderkey", F.map_filter(F.create_map(*pairs_), lambda k, v: v.isNotNull()).alias("raw"))


@query
def typed_tenders(spark, sf):
    return typed(raw_tenders(spark, sf)).withColumn("initial_price", F.col("initial_price").cast("double"))


@query
def canonical_tenders(spark, sf):
    t = prepared(canonical(raw_tenders(spark, sf)))
    return t.select("tender_id", "title", "customer", "region", "method", "price", "published", "status", "platform")


def _stored(spark, sf) -> DataFrame:
    """Catalogue before the batch: tenders that are not pending."""
    orders = table(spark, sf, "orders").filter(F.col("o_orderstatus") != "P")
    return orders.select(
        _icz(F.col("o_orderkey")), F.lit("stored").alias("object_name"),
        F.col("o_totalprice").cast("decimal(15,2)").alias("initial_price"),
    )


def _icz(key):
    return F.concat(F.lit("IKZ"), F.lpad(key.cast("string"), 12, "0")).alias("icz")


ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "initial_price"]


def _crawled(items: DataFrame) -> DataFrame:
    """Crawl records: every line item re-reports its tender; tax-free lines lost the id, undiscounted ones the title."""
    return items.select(
        F.when(F.col("l_tax") == 0, "").otherwise(_icz(F.col("l_orderkey"))).alias("icz"),
        F.when(F.col("l_discount") == 0, "").otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).alias("object_name"),
        F.col("l_extendedprice").cast("decimal(15,2)").alias("initial_price"),
        "l_linenumber", "l_partkey", "l_suppkey",
    )


@query
def upsert_tenders(spark, sf):
    out = upsert(_stored(spark, sf), _crawled(table(spark, sf, "lineitem")), ORDER)
    return out.withColumn("initial_price", F.col("initial_price").cast("double"))


@query
def upsert_stats_(spark, sf):
    return upsert_stats(_stored(spark, sf), _crawled(table(spark, sf, "lineitem")))


QUERIES["upsert_stats"] = QUERIES.pop("upsert_stats_")


@query
def stream_upsert_(spark, sf):
    schema = table(spark, sf, "lineitem").schema
    state = stream_upsert(
        spark, sf, schema, _crawled, scratch_path(spark, "log"), scratch_path(spark, "stream"), ORDER, glob="lineitem.parquet"
    )
    return state.select("icz", "object_name", F.col("initial_price").cast("double").alias("initial_price"))


QUERIES["stream_upsert"] = QUERIES.pop("stream_upsert_")


@query
def index_roundtrip(spark, sf):
    rows = vectors(spark, sf)
    cents = _label_centroids(spark, sf)
    path = scratch_path(spark, "index")
    index.write_index(index.assign_cells(rows.select("id", "vec"), cents, metric="l2"), path)
    index.write_centroids(spark, cents, path + "-centroids")
    again = index.read_centroids(spark, path + "-centroids")
    return index.read_index(spark, path).select(
        F.col("id").alias("vec_id"), "cell_id", F.size("vec").alias("width"), r6(vec.norm(F.col("vec")), "length"),
        F.lit(len(again)).alias("cells"),
    )


def _label_centroids(spark, sf) -> np.ndarray:
    """Label centroids as a model-sized matrix, in label order."""
    rows = label_queries(spark, sf).orderBy("query_id").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("too many cells for one matrix")
    return np.array([r["query_vec"] for r in rows])


# --- filters -----------------------------------------------------------------

@query
def filter_eq(spark, sf):
    t = order_tenders(spark, sf, parts=False, customers=False)
    return catalog.apply_filters(t, {"status": "F"}).select("tender_id", "status", "method")


@query
def filter_range(spark, sf):
    t = prepared(order_tenders(spark, sf, parts=False, customers=False))
    return catalog.apply_filters(t, {"price": {"min": 100000, "max": 250000}}).select("tender_id", "price")


@query
def filter_in(spark, sf):
    t = order_tenders(spark, sf, parts=False)
    return catalog.apply_filters(t, {"region": {"in": ["NATION_3", "NATION_7", "NATION_11"]}}).select("tender_id", "region")


@query
def post_filter(spark, sf):
    found = search.vector_find_similar(
        vectors(spark, sf), label_queries(spark, sf), 10, filters={"label": [1, 2, 3], "absent": "x"},
        metadata=vectors(spark, sf).select("id", "label"),
    )
    return found.select("query_id", F.col("id").alias("vec_id"), "label", "rank", r6(F.col("score"), "score"))


def _catalog(spark, sf) -> DataFrame:
    """Stored catalogue: typed columns straight from the star schema."""
    o = table(spark, sf, "orders")
    places = customer_places(spark, sf)
    return o.join(places, o.o_custkey == places.c_custkey).select(
        _icz(F.col("o_orderkey")),
        F.concat_ws(" ", F.lit("Supply contract number"), "o_orderkey", F.lit("for"), "customer", "funding").alias("object_name"),
        F.concat_ws(" ", "customer", F.lit("department of"), "funding", F.lit("supplies")).alias("customer_full_name"),
        F.col("region"), F.col("o_orderpriority").alias("procurement_method"), F.col("o_orderstatus").alias("stage"),
        F.col("o_orderdate").alias("end_date_time"), F.col("o_totalprice").cast("decimal(15,2)").alias("initial_price"),
    )


def _short(df: DataFrame) -> DataFrame:
    return df.select("icz", "region", "procurement_method", "stage", "end_date_time", F.col("initial_price").cast("double").alias("initial_price"))


@query
def catalog_contains(spark, sf):
    return _short(catalog.search(_catalog(spark, sf), region="nation_1", procurement_method="HIGH"))


@query
def catalog_date_range(spark, sf):
    return _short(catalog.search(_catalog(spark, sf), end_date_from="1997-03-01", end_date_to="1997-06-30"))


@query
def catalog_price_range(spark, sf):
    return _short(catalog.search(_catalog(spark, sf), price_min="1000.50", price_max="90000", end_date_from="soon"))


@query
def catalog_search(spark, sf):
    return _short(catalog.search(
        _catalog(spark, sf), region="NATION_", procurement_method="e", stage=" p ", end_date_from="1996-01-01",
        end_date_to="2000-12-31", price_min="50000", price_max="400000", search="machinery",
    ))


@query
def catalog_count(spark, sf):
    return catalog.search(_catalog(spark, sf), stage="f", search="building").agg(F.count(F.lit(1)).alias("found"))


@query
def catalog_listing(spark, sf):
    return catalog.listing(_catalog(spark, sf))


@query
def filter_values(spark, sf):
    return catalog.filter_values(_catalog(spark, sf), ["region", "procurement_method", "stage"])


@query
def exclude_one_identical(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return catalog.exclude_one_identical(docs, docs, ["text", "lang"], "doc_id").select("doc_id", "lang")


@query
def criteria_to_target(spark, sf):
    rows = customer_places(spark, sf)
    steps = [("region", "region"), ("keywords", "funding"), ("min_price", "c_custkey"), ("max_price", "customer"), ("colour", "region")]
    cells = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for i, (k, c) in enumerate(steps)
    ])
    criteria = rows.select(F.col("c_custkey").alias("query"), F.inline(cells))
    return catalog.targets_from_criteria(criteria).select("query", "region", "title", "price_text", "method")


# --- rule-weighted search ----------------------------------------------------

@query
def composite_top(spark, sf):
    new, old = new_and_history(spark, sf)
    return composite_topk(old, new, 10, **groups(spark, sf)).select("target_id", "tender_id", "rank", "score")


QUERIES["composite_topk"] = QUERIES.pop("composite_top")


@query
def topk_threshold(spark, sf):
    new, old = new_and_history(spark, sf)
    return composite_topk(old, new, 10, min_similarity=0.72, **groups(spark, sf)).select("target_id", "tender_id", "rank", "score")


def _literal_targets(spark) -> DataFrame:
    """Two searches a user might type in."""
    rows = [
        ("", "small ring", "ECONOMY Brand#2", "Customer#000000001", "NATION_3", "2-HIGH", "120 000,00", "15.03.1998 10:30", "BUILDING"),
        ("Q2", "red widget, blue", "LARGE Brand#17", "", "nation_12", "5-LOW", "", "дата неизвестна", ""),
    ]
    names = ["tender_id", "title", "description", "customer", "region", "method", "price_text", "published_text", "funding"]
    return prepared(spark.createDataFrame(rows, names)).withColumn("tender_id", F.concat(F.lit("target "), "tender_id"))


@query
def find_similar(spark, sf):
    found = search.find_similar(
        prepared_tenders(spark, sf), _literal_targets(spark), 10, weights={"text": 0.4, "region": 0.2, "price": 0.2, "date": 0.1, "other": 0.1},
        filters={"status": {"in": ["F", "O"]}, "price": {"min": 20000.0, "max": 450000.0}}, min_similarity=0.1, **groups(spark, sf),
    )
    return found.select("target_id", "rank", "tender_id", r6(F.col("score"), "score"), "k_returned", "k_requested", r6(F.col("parts.price"), "price_part"))


@query
def explain_composite(spark, sf):
    new, old = new_and_history(spark, sf)
    g = groups(spark, sf)
    found = with_breakdown(composite_topk(old, new, 5, **g), old, new, 5, **g)
    return found.select("target_id", "rank", "tender_id", "explanation")


@query
def analyze(spark, sf):
    new, old = new_and_history(spark, sf)
    out = search.analyze(old, new, 10, **groups(spark, sf))
    return out.select(
        "target_id", r6(F.col("predicted_price"), "predicted_price"), r6(F.col("confidence"), "confidence"),
        "min_price", "max_price", "used", "total",
    )


def _neighbours(spark, sf) -> DataFrame:
    new, old = new_and_history(spark, sf)
    return materialise(search.priced_neighbours(old, new, 10, **groups(spark, sf)), "neighbours")


def _price_query(method: str) -> Query:
    def run(spark, sf):
        out = price.predict(_neighbours(spark, sf), "target_id", method)
        return out.select("target_id", r6(F.col("predicted_price"), "predicted_price"), "method")
    return run


for _m in ("mean", "median", "weighted_median", "mode"):
    QUERIES[f"price_{_m}"] = _price_query(_m)


@query
def price_minmax(spark, sf):
    n = _neighbours(spark, sf)
    low, high = price.predict(n, "target_id", "min"), price.predict(n, "target_id", "max")
    return low.select("target_id", F.col("predicted_price").alias("lowest")).join(
        high.select("target_id", F.col("predicted_price").alias("highest")), "target_id"
    )


@query
def price_prediction(spark, sf):
    out = price.predict(_neighbours(spark, sf), "target_id", "median")
    return out.select("target_id", r6(F.col("confidence"), "confidence"), "min_price", "max_price", "used", "total")


@query
def compare_methods(spark, sf):
    new, old = new_and_history(spark, sf)
    weighted = composite_topk(old, new, 5, **groups(spark, sf))
    embedded = embedding_topk(old, new, 5)
    out = evaluation.compare_methods(weighted, embedded, new.select(F.col("tender_id").alias("target_id")), "target_id")
    return out.select("method", r6(F.col("success_rate"), "success_rate"), r6(F.col("avg_similarity"), "avg_similarity"),
                      "total_tested", r6(F.col("similarity_difference"), "similarity_difference"))


@query
def embedding_search(spark, sf):
    new, old = new_and_history(spark, sf)
    return embedding_topk(old, new, 10).select("target_id", "tender_id", "rank", "score")


# --- similarity of two values ------------------------------------------------

@query
def composite_breakdown(spark, sf):
    p = consecutive(spark, sf)
    parts = kernels.breakdown("t", "c", **groups(spark, sf))
    score = kernels.composite_score(parts)
    return p.select("pair_id", *[r6(v, n) for n, v in parts.items()], r6(score, "score"))


@query
def top_factors(spark, sf):
    p = consecutive(spark, sf)
    parts = {n: F.round(v, 6) for n, v in kernels.breakdown("t", "c", **groups(spark, sf)).items()}
    ready = p.select("pair_id", *[v.alias(n) for n, v in parts.items()])
    best = kernels.top_factors({n: F.col(n) for n in COMPONENTS})
    return ready.select("pair_id", F.array_join(F.transform(best, lambda e: e["name"]), ",").alias("factors"), r6(F.get(best, F.lit(0))["score"], "best"))


@query
def text_similarity(spark, sf):
    p = consecutive(spark, sf)
    return p.select("pair_id", r6(kernels.text_similarity(F.col("t.description"), F.col("c.description")), "similarity"))


@query
def categorical_similarity(spark, sf):
    p = consecutive(spark, sf)
    g = {"metal": ["Brand#1", "Brand#2", "Brand#3"], "wood": ["Brand#4", "Brand#5"]}
    return p.select("pair_id", r6(kernels.categorical_similarity(F.col("t.platform"), F.col("c.platform"), g), "similarity"))


@query
def numeric_similarity(spark, sf):
    p = consecutive(spark, sf)
    a, b = F.col("t.price"), F.col("c.price")
    return p.select(
        "pair_id", r6(kernels.numeric_similarity(a, b, kernels.price_scale(a, b)), "gaussian"),
        r6(kernels.numeric_similarity(a, b, 100000.0, "exponential"), "exponential"),
        r6(kernels.numeric_similarity(a, b, 0.0, "inverse"), "inverse"),
    )


@query
def temporal_similarity(spark, sf):
    p = consecutive(spark, sf)
    a, b, s = F.col("t.published"), F.col("c.published"), 400 * 86400.0
    return p.select("pair_id", *[r6(kernels.temporal_similarity(a, b, s, m), m) for m in ("exponential", "gaussian", "linear")])


@query
def region_similarity(spark, sf):
    p = consecutive(spark, sf)
    return p.select("pair_id", r6(kernels.region_similarity(F.col("t.region"), F.col("c.region"), groups(spark, sf)["districts"]), "similarity"))


@query
def method_similarity(spark, sf):
    p = consecutive(spark, sf)
    # A value beside a longer one holding its words shows the partial match.
    a = F.col("t.method")
    b = F.when(F.col("c.status") == "O", F.concat(F.lit("re-"), F.col("c.method"))).otherwise(F.col("c.method"))
    return p.select("pair_id", r6(kernels.method_similarity(a, b, groups(spark, sf)["method_groups"]), "similarity"))


@query
def vector_breakdown(spark, sf):
    p = consecutive(spark, sf)
    return p.select("pair_id", *[r6(v, n) for n, v in kernels.vector_breakdown("t", "c").items()])


@query
def explain_vector(spark, sf):
    p = consecutive(spark, sf)
    score = F.round(kernels.text_similarity(F.col("t.title"), F.col("c.title")), 6)
    cluster = F.ascii
    text_ = kernels.explain_vector("t", "c", score, cluster(F.col("t.status")), cluster(F.col("c.status")))
    return p.select("pair_id", text_.alias("explanation"))


@query
def cosine(spark, sf):
    return vector_pairs(spark, sf).select("id", r6(vec.cosine(F.col("a"), F.col("b")), "similarity"))


@query
def distance_to_similarity(spark, sf):
    p = vector_pairs(spark, sf)
    return p.select(
        "id", r6(vec.distance_to_similarity(vec.cosine(F.col("a"), F.col("b"))), "from_cosine"),
        r6(vec.distance_to_similarity(vec.l2_distance(F.col("a"), F.col("b")) / 2.0, "l2"), "from_distance"),
    )


@query
def normalize_vectors(spark, sf):
    v = vectors(spark, sf).select("id", vec.scaled(F.col("vec"), 3.0).alias("v"))
    u = vec.unit(F.col("v"))
    return v.select("id", r6(vec.norm(F.col("v")), "before"), r6(vec.norm(u), "after"), r6(F.get(u, F.lit(0)), "first"))


# --- scalars -----------------------------------------------------------------

@query
def parse_number(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey")
    money = money_text(F.col("o_totalprice"))
    forms = {
        "plain": money, "nbsp": F.translate(money, " ", " "), "currency": F.concat(money, F.lit(" РОССИЙСКИЙ РУБЛЬ")),
        "percent": F.concat(F.lit("до "), (F.col("o_custkey") % 100).cast("string"), F.lit(" %")),
        "negative": F.concat(F.lit("-"), money), "dotted": F.translate(money, " ", "."), "words": F.col("o_orderstatus"),
    }
    return o.select("o_orderkey", *[numbers.parse_number(c).alias(n) for n, c in forms.items()])


@query
def parse_date_(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey")
    d = day_text(F.col("o_orderdate"))
    forms = {
        "full": d, "day": F.substring(d, 1, 10), "spaced": F.concat(F.lit("  "), F.replace(d, F.lit(" "), F.lit("   ")), F.lit(" ")),
        "suffixed": F.concat(F.substring(d, 1, 10), F.lit("г")), "iso": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"),
        "impossible": F.concat(F.lit("31.02."), F.substring(d, 7, 4)),
    }
    return o.select("o_orderkey", *[parse_date(c).alias(n) for n, c in forms.items()])


QUERIES["parse_date"] = QUERIES.pop("parse_date_")


@query
def clean_text(spark, sf):
    return table(spark, sf, "documents", "doc_id").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query
def clean_text_stopwords(spark, sf):
    said = F.concat(F.lit("Поставка и монтаж, для "), F.col("lang"), F.lit(" в срок! "), F.col("text"))
    return table(spark, sf, "documents", "doc_id").select("doc_id", text.clean_text(said, remove_stopwords=True).alias("cleaned"))


@query
def collapse_spaces(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", text.collapse_spaces(F.concat(F.lit(r" \\n\\xa0"), "text")).alias("text"))


def _price_column(spark, sf) -> DataFrame:
    return prepared(order_tenders(spark, sf, parts=False, customers=False)).select("tender_id", "price")


def _only_stats(spark, sf) -> dict:
    return stats.field_stats(_price_column(spark, sf), ["price"]).first().asDict()


@query
def normalize_minmax(spark, sf):
    s = _only_stats(spark, sf)
    return _price_column(spark, sf).select("tender_id", r6(numbers.scale_minmax(F.col("price"), F.lit(s["min"]), F.lit(s["max"])), "scaled"))


@query
def normalize_zscore(spark, sf):
    s = _only_stats(spark, sf)
    return _price_column(spark, sf).select("tender_id", r6(numbers.scale_zscore(F.col("price"), F.lit(s["mean"]), F.lit(s["std"])), "scaled"))


@query
def normalize_log(spark, sf):
    return _price_column(spark, sf).select("tender_id", r6(numbers.scale_log(F.col("price")), "scaled"))


@query
def date_features_(spark, sf):
    t = order_tenders(spark, sf, parts=False, customers=False)
    f = date_features(parse_date(F.col("published_text")), F.lit("1998-01-01 12:00:00").cast("timestamp"))
    return t.select("tender_id", f.alias("f")).select("tender_id", *[r6(F.col(f"f.{n}"), n) for n in FEATURES])


QUERIES["date_features"] = QUERIES.pop("date_features_")


@query
def preprocess_(spark, sf):
    t = preprocess(order_tenders(spark, sf))
    return t.select(
        "tender_id", "title_cleaned", "description_cleaned", "customer_cleaned", "price_parsed", "published_parsed", "closes_parsed",
        r6(F.col("closes_features.day_of_week"), "closes_weekday"), F.coalesce("platform", F.lit("")).alias("platform"),
    )


QUERIES["preprocess"] = QUERIES.pop("preprocess_")


@query
def parse_price(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey")
    money = money_text(F.col("o_totalprice"))
    return o.select(
        "o_orderkey", numbers.parse_price(money).cast("double").alias("price"),
        numbers.parse_price(F.concat(money, F.lit(" руб"))).cast("double").alias("unreadable"),
    )


@query
def clean_phone(spark, sf):
    c = table(spark, sf, "customer")
    number = F.concat(F.lit("тел. +7 (495) "), F.col("c_custkey").cast("string"), F.lit("-00, доб. "), F.repeat(F.col("c_custkey").cast("string"), 20))
    return c.select("c_custkey", text.clean_phone(number).alias("phone"))


@query
def extract_price(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey")
    eu = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    first = F.when(F.col("o_orderstatus") == "P", "не указана").when(F.col("o_orderstatus") == "O", "0,00").otherwise(F.concat(F.lit("-"), eu, F.lit(" руб.")))
    second = F.when(F.col("o_orderstatus") == "O", F.format_number("o_totalprice", 2))
    third = money_text(F.col("o_totalprice"))
    return o.select("o_orderkey", numbers.extract_price(first, second, third).alias("price"))


@query
def mask_pii(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(
        "conv_id", "turn", text.mask_pii(F.col("text"), "Контакт заказчика").alias("contact"),
        text.mask_pii(F.col("text"), "note").alias("note"), text.mask_pii(F.col("role"), "email").alias("email"),
    )


@query
def mask_nested(spark, sf):
    d = table(spark, sf, "documents", "doc_id")
    nested = d.select(
        "doc_id",
        F.create_map(F.lit("Заказчик"), F.col("source"), F.lit("Номер телефона"), F.col("text")).alias("contacts"),
        F.struct(F.col("text").alias("body"), F.col("lang").alias("email"), "n_chars").alias("content"),
        F.split("text", "\n").alias("notes"),
    )
    m = text.mask_record(nested)
    return m.select(
        "doc_id", F.try_element_at("contacts", F.lit("Заказчик")).alias("customer"),
        F.try_element_at("contacts", F.lit("Номер телефона")).alias("phone"),
        "content.body", "content.email", "content.n_chars", F.array_join("notes", "|").alias("notes"),
    )


# --- statistics, samples, evaluation -----------------------------------------

@query
def field_stats(spark, sf):
    out = stats.field_stats(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out.select("field", *[r6(F.col(c), c) for c in ("min", "max", "mean", "std")], "count")


@query
def head_sample(spark, sf):
    return sampling.head_sample(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 1000, "o_orderkey")


@query
def train_test_split(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", sampling.split_column(F.col("o_orderkey")).alias("part"))


@query
def ranking_metrics(spark, sf):
    rows = vectors(spark, sf)
    results = vops.all_scores(rows, label_queries(spark, sf))
    relevant = rows.select(F.col("label").alias("query_id"), "id")
    out = evaluation.ranking_metrics(results, relevant, 10, "query_id", "id")
    return out.select("query_id", *[r6(F.col(c), c) for c in ("precision", "recall", "mrr", "average_precision")])


@query
def search_quality(spark, sf):
    rows = vectors(spark, sf)
    asked = sampling.hash_sample(rows, 50, "id").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    found = vops.vector_topk(rows, asked, 5, exclude_self=True)
    out = evaluation.search_quality(found, "query_id")
    return out.select("n_queries", *[r6(F.col(c), c) for c in out.columns if c != "n_queries"])


# --- vector search -----------------------------------------------------------

def _hits(found: DataFrame, *more: str) -> DataFrame:
    return found.select("query_id", F.col("id").alias("vec_id"), "rank", r6(F.col("score"), "score"), *more)


@query
def vector_topk_cosine(spark, sf):
    return _hits(vops.vector_topk(vectors(spark, sf), label_queries(spark, sf), 10))


@query
def vector_topk_l2(spark, sf):
    return _hits(vops.vector_topk(vectors(spark, sf), label_queries(spark, sf), 10, "l2"))


@query
def vector_topk_batch(spark, sf):
    rows = vectors(spark, sf)
    asked = rows.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    return _hits(vops.vector_topk(rows, asked, 5))


@query
def search_with_metadata(spark, sf):
    found = search.vector_find_similar(
        vectors(spark, sf), label_queries(spark, sf), 10, metadata=noisy_vectors(spark, sf).filter("label <> -1").select("id", "label")
    )
    return _hits(found, "label")


@query
def vector_find_similar(spark, sf):
    found = search.vector_find_similar(
        vectors(spark, sf), label_queries(spark, sf), 20, min_similarity=0.35, weights=_fixed_map(64, 16),
        metadata=vectors(spark, sf).select("id", "label"), filters={"label": [0, 2, 4, 6, 8]},
    )
    return _hits(found, "label")


def _fixed_map(width: int, out: int) -> np.ndarray:
    """Stand-in for a learned matrix that both engines can write down."""
    i, j = np.meshgrid(np.arange(1, width + 1), np.arange(1, out + 1), indexing="ij")
    return ((i * 7 + j * 13) % 11 - 5) / 10.0


def _matrix_top(metric_name: str) -> Query:
    def run(spark, sf):
        rows = vectors(spark, sf)
        found = vops.relative_knn(rows, 5) if metric_name == "euclidean" else vops.knn(rows, 5, metric_name)
        return found.select("id", "neighbour", "rank", r6(F.col("score"), "score"))
    return run


for _m in ("cosine", "euclidean", "dot"):
    QUERIES[f"pairwise_{_m}"] = _matrix_top(_m)


@query
def project_embeddings(spark, sf):
    out = vops.project(vectors(spark, sf).select("id", "vec"), _fixed_map(64, 16))
    return out.select("id", F.size("vec").alias("width"), r6(F.get("vec", F.lit(0)), "first"), r6(F.get("vec", F.lit(15)), "last"), r6(vec.norm(F.col("vec")), "length"))


@query
def fit_dimension(spark, sf):
    v = vectors(spark, sf)
    cut, padded = vec.fit_dimension(F.col("vec"), 16), vec.fit_dimension(F.col("vec"), 80)
    return v.select("id", F.size(cut).alias("cut"), F.size(padded).alias("padded"), r6(vec.norm(cut), "cut_length"), r6(vec.norm(padded), "padded_length"))


@query
def ivf_assign(spark, sf):
    out = index.assign_cells(vectors(spark, sf).select("id", "vec"), _label_centroids(spark, sf), metric="l2")
    return out.select(F.col("id").alias("vec_id"), "cell_id")


@query
def ivf_search(spark, sf):
    rows = vectors(spark, sf).select("id", "vec")
    cents = _label_centroids(spark, sf)
    built = index.assign_cells(rows, cents, metric="l2")
    asked = rows.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    return _hits(index.ivf_search(built, cents, asked, 5, 3, "l2")).withColumn("score", F.col("score"))


@query
def ivf_build(spark, sf):
    rows = vectors(spark, sf).select("id", "vec")
    cents = index.train_cells(rows, 16)
    path = scratch_path(spark, "index")
    index.write_index(index.assign_cells(rows, cents), path)
    return index.read_index(spark, path).groupBy("cell_id").agg(F.count(F.lit(1)).alias("members"))


@query
def index_append(spark, sf):
    rows = vectors(spark, sf)
    cents = _label_centroids(spark, sf)
    path = scratch_path(spark, "index")
    index.write_index(index.assign_cells(rows.filter("label < 7").select("id", "vec"), cents, metric="l2"), path)
    index.append_index(rows.filter("label >= 7").select("id", "vec"), cents, path, metric="l2")
    return index.read_index(spark, path).groupBy("cell_id").agg(F.count(F.lit(1)).alias("members"))


@query
def pq_search(spark, sf):
    rows = vectors(spark, sf).select("id", "vec")
    codes = index.ProductCodes.train(rows, 8, 6)
    asked = rows.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    return _hits(index.pq_search(codes.encode(rows), codes, asked, 5, rows, 10))


@query
def lsh_topk(spark, sf):
    rows = vectors(spark, sf).select("id", "vec")
    asked = rows.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    return _hits(index.lsh_topk(rows, asked, 5, index.hyperplanes(64, 8, 3), exclude_self=True))


# --- clusters ----------------------------------------------------------------

@query
def cluster_sizes(spark, sf):
    return clusters.sizes(noisy_vectors(spark, sf))


@query
def cluster_centroids(spark, sf):
    out = clusters.centroids(noisy_vectors(spark, sf))
    return out.select("label", F.posexplode("centroid").alias("pos", "v")).select("label", "pos", r6(F.col("v"), "value"))


@query
def cluster_stats(spark, sf):
    out = clusters.statistics(noisy_vectors(spark, sf))
    return out.select(
        "label", "size", r6(F.col("percentage"), "percentage"), r6(F.col("diameter"), "diameter"),
        r6(F.get("feature_means", F.lit(3)), "mean_3"), r6(F.get("feature_stds", F.lit(3)), "std_3"),
        r6(vec.norm(F.col("centroid")), "centroid_length"),
    )


@query
def cluster_top_features(spark, sf):
    out = clusters.top_features(noisy_vectors(spark, sf), 5)
    return out.select("label", "size", "place", "pos", r6(F.col("z_score"), "z_score"), r6(F.col("cluster_mean"), "cluster_mean"), r6(F.col("global_mean"), "global_mean"))


@query
def cluster_descriptions(spark, sf):
    return clusters.describe(noisy_vectors(spark, sf))


@query
def assign_outliers(spark, sf):
    return vops.assign_outliers(noisy_vectors(spark, sf)).select("id", "label")


@query
def predict_cluster(spark, sf):
    known = label_queries(spark, sf).select(F.col("query_id").cast("long").alias("id"), F.col("query_vec").alias("vec"), F.col("query_id").alias("label"))
    out = vops.nearest_label(known, vectors(spark, sf).select("id", "vec"))
    return out.select("id", "label", r6(F.col("distance"), "distance"))


@query
def model_report(spark, sf):
    return clusters.label_report(noisy_vectors(spark, sf), "label", "vec")


DENSITY_EPSILON = 1.15


@query
def density_clusters(spark, sf):
    return density.density_clusters(vectors(spark, sf).select("id", "vec"), DENSITY_EPSILON, 3, 5)


@query
def pca_reduce(spark, sf):
    out, _ = features.pca_reduce(vectors(spark, sf), "id", "vec", 8)
    return out.select("id", *[r6(F.abs(F.get("vec", F.lit(i))), f"pc{i}") for i in range(8)])


# --- features ----------------------------------------------------------------

@query
def encode_text(spark, sf):
    out = features.encode_words(table(spark, sf, "documents"), "doc_id", text.clean_text(F.col("text")))
    return out.select("doc_id", "token", "n", r6(F.col("weight"), "weight"))


@query
def encode_distinct(spark, sf):
    out = features.encode_distinct(table(spark, sf, "documents"), "doc_id", "text")
    return out.select("doc_id", "text_key", "terms", r6(F.col("length"), "length"))


@query
def composite_embedding(spark, sf):
    out = features.composite_embedding(prepared_tenders(spark, sf), "tender_id")
    return out.select("tender_id", "token", r6(F.col("weight"), "weight"))


@query
def onehot(spark, sf):
    t = prepared_tenders(spark, sf)
    names = ["method", "region", "funding", "platform"]
    fit = features.OneHot.fit(t, names, 12)
    cells = F.array(*[F.struct(F.lit(n).alias("field"), fit.slot(n).alias("slot")) for n in names])
    return t.select("tender_id", F.inline(cells))


def _scaled(method: str) -> Query:
    def run(spark, sf):
        rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
        out = features.scaling(rows, ["l_extendedprice", "l_quantity"], method)
        return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[r6(c, n[2:]) for n, c in out.items()])
    return run


for _m in ("standard", "minmax", "robust", "log"):
    QUERIES[f"scale_{_m}"] = _scaled(_m)


def _calendar(spark, sf) -> DataFrame:
    t = prepared_tenders(spark, sf)
    latest = t.agg(F.max("published")).first()[0]
    return t.withColumn("f", date_features(F.col("published"), F.lit(latest)))


@query
def temporal_cyclical(spark, sf):
    c = _calendar(spark, sf)
    v = temporal_vector(F.col("f"))
    return c.select("tender_id", *[r6(F.get(v, F.lit(i)), f"t{i}") for i in range(8)])


@query
def temporal_encodings(spark, sf):
    c = _calendar(spark, sf)
    u, k = temporal_vector(F.col("f"), "unix"), temporal_vector(F.col("f"), "components")
    return c.select("tender_id", r6(F.get(u, F.lit(0)), "unix"), *[r6(F.get(k, F.lit(i)), f"c{i}") for i in range(6)])


@query
def fuse_features(spark, sf):
    t = prepared_tenders(spark, sf)
    options = dict(text_fields=("title",), dims=8, categories=("method", "status"))
    def mix(c):
        # Places times values, without the raw time stamp.
        kept = F.transform(c, lambda x, i: F.when(i == 17, F.lit(0.0)).otherwise(x * (i + 1)))
        return F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)

    # What is said of a vector moves to the join, not the vector.
    v = search.tender_vectors(t, **options).select("id", F.size("vec").alias("width"), F.round(mix(F.col("vec")), 4).alias("joined"))
    w = search.tender_vectors(t, fusion="weighted", **options).select("id", F.round(mix(F.col("vec")), 4).alias("weighted"))
    return v.join(w, "id").select(F.col("id").alias("tender_id"), "width", "joined", "weighted")


# --- training pairs and learning ---------------------------------------------

@query
def labelled_pairs(spark, sf):
    return pairs.labelled_pairs(vectors(spark, sf))


@query
def random_pairs(spark, sf):
    return pairs.random_pairs(vectors(spark, sf))


@query
def knn_pairs(spark, sf):
    return pairs.knn_pairs(vectors(spark, sf))


@query
def contrastive_loss(spark, sf):
    rows = vectors(spark, sf)
    out = pairs.contrastive_loss(pairs.labelled_pairs(rows), rows, 1.5)
    return out.select(r6(F.col("loss"), "loss"), "pairs")


@query
def triplet_loss(spark, sf):
    rows = vectors(spark, sf)
    out = pairs.triplet_loss(pairs.triplets(pairs.labelled_pairs(rows)), rows)
    return out.select(r6(F.col("loss"), "loss"), "triples")


@query
def metric_learning(spark, sf):
    rows = vectors(spark, sf)
    learned = metric.learn(pairs.labelled_pairs(rows), rows, 16, 5)
    out = vops.project(rows.select("id", "vec"), learned.weights)
    return out.select("id", F.size("vec").alias("width"), F.lit(learned.losses[0]).alias("first_loss"), F.lit(learned.losses[-1]).alias("last_loss"))


@query
def train_model(spark, sf):
    return search.train(vectors(spark, sf).select("id", "vec")).report()


# --- encoder and search model ------------------------------------------------

def _encoded(spark, sf) -> DataFrame:
    rows = encodable(raw_tenders(spark, sf))
    return TenderEncoder(cap=20).fit(rows).transform(rows)


@query
def feature_dimensions(spark, sf):
    widths = block_widths(_encoded(spark, sf))
    return spark.createDataFrame(list(widths.items()), "block string, width long")


@query
def encoded_features(spark, sf):
    """All blocks of the feature vector: words per text, the category's slot, scaled numbers, the calendar."""
    rows = _encoded(spark, sf)
    names = {n: i for i, n in enumerate(slot_names(rows))}
    v = F.col("v")
    out = rows.withColumn("v", vector_to_array("features"))
    words = [F.aggregate(F.slice(v, 64 * i + 1, 64), F.lit(0.0), lambda a, x: a + x).cast("long").alias(f"{t}_words") for i, t in enumerate(("title", "description", "customer", "requirements", "criteria"))]
    first = 64 * 5
    kinds = [n for n in names if "=" in n or n.endswith(" (other)")]
    on = F.array_sort(F.filter(F.transform(F.slice(v, first + 1, len(kinds)), lambda x, i: F.when(x == 1, F.get(F.array(*[F.lit(k) for k in kinds]), i))), lambda n: n.isNotNull()))
    numbers_ = [r6(F.get(v, F.lit(names[n])), n) for n in ("price", "contract_price", "bid_security", "performance_security")]
    days = [r6(F.get(v, F.lit(names[n])), n) for n in ("days_from_reference", "week_sin", "week_cos", "year_sin", "year_cos", "quarter", "year")]
    return out.select("tender_id", *words, F.array_join(on, ";").alias("kinds"), *numbers_, *days)


@query
def train_save_search(spark, sf):
    """Train on raw tenders, save, load, and ask for the newest raw tenders: each finds itself, nothing scores higher."""
    raw = raw_tenders(spark, sf)
    path = scratch_path(spark, "search_model")
    TenderSearch(components=16, dim=16, epochs=3, nlist=16).fit(raw).write().save(path)
    new, _ = new_and_history(spark, sf)
    found = TenderSearchModel.load(path).find_similar(raw.join(new.select("o_orderkey"), "o_orderkey", "left_semi"), 10)
    best = F.max("score").over(Window.partitionBy("target_row"))
    found = found.withColumn("best", F.col("score") == best).filter("target_id = tender_id")
    return found.select("target_id", "score", "best", "k_returned", "searched", r6(F.col("parts.price_similarity"), "price_similarity"))


@query
def training_report(spark, sf):
    """Feature widths, clusters with their sizes, noise and vector width as one row."""
    widths = block_widths(_encoded(spark, sf))
    out = clusters.training_report(noisy_vectors(spark, sf), "label", "vec", widths)
    text_ = {c: F.to_json(c).alias(c) for c in ("feature_dimensions", "cluster_distribution")}
    return out.select(*[text_.get(c, F.col(c)) for c in out.columns])


# --- rule-weighted search over a written history -----------------------------

def _pruned(spark, sf, **how) -> DataFrame:
    new, old = new_and_history(spark, sf)
    found = HistoryIndex.build(old, weights=how.get("weights")).topk(new, 10, **how, **groups(spark, sf))
    return found.select("target_id", "tender_id", "rank", "score")


@query
def composite_topk_pruned(spark, sf):
    return _pruned(spark, sf)


@query
def composite_options(spark, sf):
    return _pruned(spark, sf, similarity=Similarity(numeric="inverse", temporal="linear", scale_days=400.0), weights={"price": 0.5, "date": 0.3, "method": 0.2})


@query
def composite_encoder(spark, sf):
    return _pruned(spark, sf, similarity=Similarity(encoder=lambda: HashedWords(16)))


@query
def dense_composite_embedding(spark, sf):
    t = prepared_tenders(spark, sf)
    out = composite_vectors(t, "tender_id", {"title": 0.4, "description": 0.3, "customer": 0.2}, lambda: HashedWords(8))
    return out.select("tender_id", F.posexplode("vec").alias("pos", "v")).select("tender_id", "pos", r6(F.col("v"), "value"))


@query
def find_similar_without_id(spark, sf):
    """Tenders of even orders have no id, every eighth is in the history twice, and their targets are asked twice."""
    rows = prepared_tenders(spark, sf)
    new, _ = new_and_history(spark, sf)
    nameless = F.col("o_orderkey") % 2 == 0

    def blanked(df):
        return df.withColumn("tender_id", F.when(nameless, "").otherwise(F.col("tender_id")))

    built = HistoryIndex.build(blanked(rows.unionByName(rows.filter("o_orderkey % 8 = 0"))))
    asked = built.numbered_targets(blanked(new.unionByName(new.filter(nameless))))
    found = built.topk(asked, 5, **groups(spark, sf))
    return found.join(asked.select("target_row", "o_orderkey"), "target_row").select("o_orderkey", "target_id", "rank", "tender_id", "score")


# --- index of cells and codes, sampled pairs, compacted log ------------------

@query
def ivf_pq_search(spark, sf):
    """Codes below coarse cells; the best hundred of three cells are ranked exactly."""
    rows = vectors(spark, sf).select("id", "vec")
    trained = index.CellCodes.train(rows, m=8, bits=6, centroids=_label_centroids(spark, sf))
    path = scratch_path(spark, "codes")
    index.write_index(trained.encode(rows), path)
    asked = rows.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    return _hits(index.ivf_pq_search(index.read_index(spark, path), trained, asked, 5, 3, rows, 20)).withColumn("score", F.col("score"))


@query
def sampled_pairs(spark, sf):
    return pairs.sampled_pairs(vectors(spark, sf), 6)


@query
def compacted_log(spark, sf):
    """The crawl in three batches, taken into the base after the first and the second."""
    path, lines = scratch_path(spark, "compacted"), table(spark, sf, "lineitem")
    for batch, (low, high) in enumerate([(0, 2), (3, 4), (5, 99)]):
        append_changes(f"{path}/log", _crawled(lines.filter(F.col("l_linenumber").between(low, high))), batch, ORDER)
        if batch < 2:
            compact(spark, path, ORDER)
    state = compacted_state(spark, path, ORDER)
    return state.select("icz", "object_name", F.col("initial_price").cast("double").alias("initial_price"))


@query
def lsh_recall(spark, sf):
    """Whether the multi-probe search finds nine of ten exact neighbours of every row."""
    rows = vectors(spark, sf).select("id", "vec")
    asked = rows.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    exact = vops.vector_topk(rows, asked, 5, exclude_self=True).select("query_id", "id")
    found = index.lsh_probe_topk(rows, asked, 5, probes=8, exclude_self=True).select("query_id", "id", F.lit(1).alias("hit"))
    out = exact.join(found, ["query_id", "id"], "left")
    return out.agg(F.count(F.lit(1)).alias("neighbours"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("enough"))
