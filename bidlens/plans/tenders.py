"""Tender tables: prepared records, the view over the star schema, raw and typed forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bidlens.functions.dates import bare_date, date_features, parse_date, parse_datetime, parse_day, plain_date, single_spaced
from bidlens.functions.numbers import number_of, parse_number, parse_price, plain_price, price_signs, squeezed
from bidlens.functions.text import clean_phone, clean_text, strip
from bidlens.schema import (
    CATEGORICAL_FIELDS, DATE_FIELDS, NUMERIC_FIELDS, RAW_TITLES, TEXT_FIELDS, TITLE_ALIASES,
)
from bidlens.session import spread

PREPARED = [
    "tender_id", "title", "description", "customer", "region", "method", "price", "published",
    "currency", "funding", "status", "platform", "offer_price",
]

# Fields that may state a price, the one asked first in front.
PRICE_TEXTS = ("price_text", "starting_price_text", "highest_price_text", "contract_price_text")


def preprocess(df: DataFrame, with_features: bool = True) -> DataFrame:
    """Add cleaned, parsed and calendar columns for every known field the table has."""
    out, calendar = {}, {}
    for name in TEXT_FIELDS:
        if name in df.columns:
            out[f"{name}_cleaned"] = clean_text(F.col(name))
    for name in NUMERIC_FIELDS:
        if name in df.columns:
            out[name.replace("_text", "_parsed")] = parse_number(F.col(name))
    for name in DATE_FIELDS:
        if name in df.columns:
            parsed = name.replace("_text", "_parsed")
            out[parsed] = parse_date(F.col(name))
            calendar[name.replace("_text", "_features")] = F.when(F.col(parsed).isNotNull(), date_features(F.col(parsed)))
    for name in CATEGORICAL_FIELDS:
        if name not in df.columns:
            out[name] = F.lit("")
    # Two steps, so that the features read a parsed date instead of parsing again.
    parsed_rows = df.withColumns(out)
    return parsed_rows.withColumns(calendar) if with_features and calendar else parsed_rows


def prepared(df: DataFrame) -> DataFrame:
    """The columns scoring needs: cleaned texts, parsed price and date, plain categories.

    ``price`` is the number that is compared; ``offer_price`` is the first positive price
    of ``PRICE_TEXTS`` in either decimal convention, or null, and is what is predicted.
    """
    def text(name: str) -> Column:
        return clean_text(F.col(name)) if name in df.columns else F.lit("")

    def plain(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")

    # In steps: a text that is read more than once is made once, and a projection whose method is beyond 8000
    # bytes is never compiled by the JVM. Columns that end in _text are never kept, so the steps hide none.
    stated = [c for c in PRICE_TEXTS if c in df.columns]
    first = {"_title_text": text("title"), **{f"_signs_{c}": price_signs(F.col(c)) for c in stated}}
    if "price_text" in df.columns:
        first["_number_text"] = squeezed(F.col("price_text"))
    if "published_text" in df.columns:
        first["_day_text"] = strip(F.col("published_text"))
    price = F.col("_amount_text") if "_number_text" in first else F.lit(0.0)
    offer = F.coalesce(*[F.when(F.col(f"_value_{c}") > 0, F.col(f"_value_{c}")) for c in stated]) if stated else F.lit(None).cast("double")
    published = F.lit(None).cast("timestamp")
    keep = [c for c in df.columns if c not in PREPARED and not c.endswith("_text")]
    values = {"_description_text": text("description"), **{f"_value_{c}": plain_price(F.col(f"_signs_{c}")) for c in stated}}
    later = {"_customer_text": text("customer")}
    if "_number_text" in first:
        later["_amount_text"] = number_of(F.col("_number_text"))
    if "_day_text" in first:
        values["_one_day_text"] = single_spaced(F.col("_day_text"))
        later["_stamp_text"] = plain_date(F.col("_day_text"), F.col("_one_day_text"))
        published = F.when(F.col("_stamp_text").isNotNull(), F.col("_stamp_text")).otherwise(bare_date(F.col("_day_text")))
    return df.withColumns(first).withColumns(values).withColumns(later).select(
        *keep,
        plain("tender_id").alias("tender_id"),
        F.col("_title_text").alias("title"), F.col("_description_text").alias("description"), F.col("_customer_text").alias("customer"),
        plain("region").alias("region"), plain("method").alias("method"),
        price.alias("price"), offer.alias("offer_price"), published.alias("published"),
        *[plain(n).alias(n) for n in ("currency", "funding", "status", "platform")],
    )


def table(spark: SparkSession, sf_dir: str, name: str, spread_by: str | None = None) -> DataFrame:
    """One table; ``spread_by`` names its key where costly row work follows."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, spread_by) if spread_by else df


def money_text(c: Column) -> Column:
    """1234.5 -> ``1 234,50``."""
    return F.translate(F.format_number(c, 2), ",.", " ,")


def day_text(c: Column) -> Column:
    return F.date_format(c, "dd.MM.yyyy HH:mm")


def order_tenders(spark: SparkSession, sf_dir: str, parts: bool = True, customers: bool = True) -> DataFrame:
    """One tender per order: texts from its first part, buyer and region from its customer.

    The wide joins are on unique keys; ``nation`` and ``region`` have a fixed size.
    """
    orders = table(spark, sf_dir, "orders", "o_orderkey")
    out = orders.select(
        "o_orderkey", "o_custkey",
        F.concat(F.lit("IKZ"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("tender_id"),
        F.col("o_orderpriority").alias("method"),
        money_text(F.col("o_totalprice")).alias("price_text"),
        day_text(F.col("o_orderdate")).alias("published_text"),
        F.col("o_orderstatus").alias("status"),
        F.lit("RUB").alias("currency"),
    )
    if parts:
        first = (
            table(spark, sf_dir, "lineitem")
            .groupBy("l_orderkey")
            .agg(
                F.min(F.struct("l_linenumber", "l_partkey")).getField("l_partkey").alias("first_part"),
                F.max("l_shipdate").alias("closes"),
            )
        )
        part = table(spark, sf_dir, "part").select(
            "p_partkey", F.col("p_name").alias("title"),
            F.concat_ws(" ", "p_type", "p_brand").alias("description"), F.col("p_brand").alias("platform"),
        )
        out = (
            out.join(first, out.o_orderkey == first.l_orderkey, "left")
            .join(part, F.col("first_part") == part.p_partkey, "left")
            .withColumn("closes_text", day_text(F.col("closes")))
            .drop("l_orderkey", "first_part", "p_partkey", "closes")
        )
    if customers:
        places = customer_places(spark, sf_dir)
        out = out.join(places, out.o_custkey == places.c_custkey, "left").drop("c_custkey")
    return out.drop("o_custkey")


def customer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == nation.n_nationkey, "left")
        .join(region, F.col("n_regionkey") == region.r_regionkey, "left")
        .select(
            "c_custkey", F.col("c_name").alias("customer"), F.col("c_mktsegment").alias("funding"),
            F.col("n_name").alias("region"), F.col("r_name").alias("district"),
        )
    )


def district_groups(spark: SparkSession, sf_dir: str, limit: int = 1000) -> dict[str, list[str]]:
    """Hierarchy of the star schema as a small lookup; refuses a table that has outgrown one."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = nation.join(region, nation.n_regionkey == region.r_regionkey).select("r_name", "n_name").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} regions: join the hierarchy as a table instead")
    groups: dict[str, list[str]] = {}
    for parent, child in rows:
        groups.setdefault(parent, []).append(child)
    return groups


# Groups for the order priorities that stand in for procurement methods.
PRIORITY_GROUPS = {"urgent": ["1-URGENT", "2-HIGH"], "planned": ["3-MEDIUM", "5-LOW"]}


def canonical_tenders(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Named columns out of raw title -> text maps, other spellings of a title included.

    This is where scraped records enter the search: ``prepared`` takes the result.
    """
    titles: dict[str, list[str]] = {}
    for title, name in [*RAW_TITLES.items(), *TITLE_ALIASES.items()]:
        titles.setdefault(name, []).append(title)
    raw = F.col(raw_col)
    return df.select(*[
        F.coalesce(*[F.nullif(F.try_element_at(raw, F.lit(t)), F.lit("")) for t in known]).alias(name)
        for name, known in titles.items()
    ])


# Titles read for the typed catalogue.
TYPED_TITLES = {
    "icz": "Идентификационный код закупки (ИКЗ)",
    "object_name": "Наименование объекта закупки",
    "customer_full_name": "Организация, осуществляющая размещение",
    "region": "Регион",
    "procurement_method": "Способ определения поставщика (подрядчика, исполнителя)",
    "stage": "Этап закупки",
    "start_date_time": "Дата и время начала срока подачи заявок",
    "end_date_time": "Дата и время окончания срока подачи заявок",
    "results_date": "Дата подведения итогов определения поставщика (подрядчика, исполнителя)",
    "initial_price": "Начальная (максимальная) цена контракта",
    "contract_execution_period": "Срок исполнения контракта",
    "participant_requirements": "Требования к участникам",
    "advantages": "Преимущества",
    "delivery_place": "Место поставки товара, выполнения работы или оказания услуги",
    "bid_security_required": "Требуется обеспечение заявки",
    "bid_security_amount": "Размер обеспечения заявки",
    "performance_required": "Требуется обеспечение исполнения контракта",
    "performance_security_size": "Размер обеспечения исполнения контракта",
    "email": "Адрес электронной почты",
    "phone": "Номер контактного телефона",
    "electronic_platform_name": "Наименование электронной площадки в информационно-телекоммуникационной сети «Интернет»",
    "electronic_platform_url": "Адрес электронной площадки в информационно-телекоммуникационной сети «Интернет»",
}
# Titles read where the first one is empty.
SECOND_TITLES = {"initial_price": "Максимальное значение цены контракта", "delivery_place": "Место поставки товара"}


def typed_tenders(df: DataFrame, raw_col: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """The 22 typed catalogue columns out of a raw title -> text map.

    Texts first, then parsing: a parsed column reads its text more than once, and
    two small projections compile to faster code than a single large one.
    """
    def text_of(name: str) -> Column:
        titles = [TYPED_TITLES[name], *([SECOND_TITLES[name]] if name in SECOND_TITLES else [])]
        found = [F.try_element_at(F.col(raw_col), F.lit(t)) for t in titles]
        # An empty first value gives way to the second title.
        return F.coalesce(*[F.nullif(v, F.lit("")) for v in found[:-1]], found[-1], F.lit(""))

    texts = df.select(*keep, *[text_of(n).alias(n) for n in TYPED_TITLES])
    rouble = F.lit("РОССИЙСКИЙ РУБЛЬ")
    bid = F.col("bid_security_amount")
    bid = F.when(F.contains(bid, rouble), strip(F.replace(bid, rouble, F.lit("")))).otherwise(bid)
    bid_due, performance_due = F.col("bid_security_required") == "Да", F.col("performance_required") == "Да"
    parsed = {
        "start_date_time": parse_datetime(F.col("start_date_time")),
        "end_date_time": parse_datetime(F.col("end_date_time")),
        "results_date": parse_day(F.col("results_date")),
        "initial_price": parse_price(F.col("initial_price")),
        "bid_security_required": bid_due,
        "bid_security_amount": F.when(bid_due, bid),
        "performance_required": performance_due,
        "performance_security_size": F.when(performance_due, F.col("performance_security_size")),
        "phone": clean_phone(F.col("phone")),
    }
    return texts.select(*keep, *[parsed.get(n, F.col(n)).alias(n) for n in TYPED_TITLES])
