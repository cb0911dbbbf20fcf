"""DuckDB SQL with the same columns and rows as each registered query."""

from __future__ import annotations

from bidlens.schema import STOP_WORDS
from registry.queries import PAGE_INFO, PAGE_SECTION, PAGE_TITLE

ORACLE: dict[str, str] = {}

SP = r"\s\x0B\x1C-\x1F\x85\p{Z}"
NOISE = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
STRICT = r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?"


# --- expressions -------------------------------------------------------------

def r6(e: str, digits: int = 6) -> str:
    return f"(round(({e})::DOUBLE, {digits}) + 0.0)"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^[{SP}]+|[{SP}]+$', '', 'g')"


def clean(e: str) -> str:
    spaced = rf"regexp_replace(lower({e}), '[^\p{{L}}\p{{N}}_{SP}\-.,]', ' ', 'g')"
    return f"coalesce({strip(f'''regexp_replace({spaced}, '[{SP}]+', ' ', 'g')''')}, '')"


def number(e: str) -> str:
    s = f"replace(regexp_replace({e}, '[{SP}]', '', 'g'), ',', '.')"
    return (
        f"coalesce(CASE WHEN regexp_full_match({s}, '{STRICT}') THEN try_cast({s} AS DOUBLE) END, "
        rf"try_cast(nullif(regexp_extract({s}, '[-+]?\d*[.,]?\d+'), '') AS DOUBLE), 0.0)"
    )


def stamp(e: str) -> str:
    full = rf"regexp_full_match({e}, '\d{{1,2}}\.\d{{1,2}}\.\d{{4}}[{SP}]+\d{{1,2}}:\d{{1,2}}')"
    day = rf"regexp_full_match({e}, '\d{{1,2}}\.\d{{1,2}}\.\d{{4}}')"
    single = f"regexp_replace({e}, '[{SP}]+', ' ', 'g')"
    return f"CASE WHEN {full} THEN try_strptime({single}, '%d.%m.%Y %H:%M') WHEN {day} THEN try_strptime({e}, '%d.%m.%Y') END"


def dated(e: str) -> str:
    s = strip(e)
    bare = rf"regexp_replace({s}, '[^\d.:{SP}]', '', 'g')"
    return f"coalesce({stamp(s)}, {stamp(bare)})"


def money(e: str) -> str:
    return f"translate(format('{{:,.2f}}', {e}), ',.', ' ,')"


def day_text(e: str) -> str:
    return f"strftime({e}, '%d.%m.%Y %H:%M')"


def words(e: str) -> str:
    return f"list_filter(string_split({e}, ' '), lambda w: w <> '')"


def tally(a: str, b: str) -> str:
    """Sum over distinct words of a: count in a times count in b."""
    return (
        f"coalesce(list_sum(list_transform(list_distinct({words(a)}), lambda d: "
        f"(len(list_filter({words(a)}, lambda x: x = d)) * len(list_filter({words(b)}, lambda y: y = d)))::DOUBLE)), 0.0)"
    )


def word_cosine(a: str, b: str) -> str:
    size = f"(sqrt({tally(a, a)}) * sqrt({tally(b, b)}))"
    return f"(CASE WHEN {size} = 0 THEN 0.0 ELSE {tally(a, b)} / {size} END)"


def text_sim(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE {word_cosine(a, b)} END)"


def category(a: str, b: str) -> str:
    return (
        f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN lower({a}) = lower({b}) THEN 1.0 "
        f"WHEN contains({b}, {a}) OR contains({a}, {b}) THEN 0.3 ELSE 0.0 END)"
    )


def method(a: str, b: str) -> str:
    def shares(x: str, y: str) -> str:
        return f"len(list_filter({words(x)}, lambda w: contains({y}, w))) > 0"

    return (
        f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 "
        f"WHEN {a} IN ('1-URGENT','2-HIGH') AND {b} IN ('1-URGENT','2-HIGH') THEN 0.8 "
        f"WHEN {a} IN ('3-MEDIUM','5-LOW') AND {b} IN ('3-MEDIUM','5-LOW') THEN 0.8 "
        f"WHEN {shares(a, b)} OR {shares(b, a)} THEN 0.3 ELSE 0.0 END)"
    )


def region(t: str, c: str) -> str:
    a, b = f"{t}.region", f"{c}.region"
    pa, pb = f"(SELECT any_value(r_name) FROM places WHERE n_name = {a})", f"(SELECT any_value(r_name) FROM places WHERE n_name = {b})"
    return (
        f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN lower({a}) = lower({b}) THEN 1.0 "
        f"WHEN {pa} = {pb} THEN 0.5 ELSE 0.0 END)"
    )


def price_sim(a: str, b: str) -> str:
    s = f"greatest(100000.0, (abs({a}) + abs({b})) / 2.0 * 0.5)"
    return f"exp(-pow({a} - {b}, 2) / (2.0 * {s} * {s}))"


def gap(a: str, b: str) -> str:
    return f"abs(epoch({a}) - epoch({b}))"


def parts(t: str, c: str) -> dict[str, str]:
    fields = ["currency", "funding", "status", "platform"]
    both = {f: f"({t}.{f} <> '' AND {c}.{f} <> '')" for f in fields}
    total = " + ".join(f"CASE WHEN {both[f]} THEN {category(f'{t}.{f}', f'{c}.{f}')} ELSE 0.0 END" for f in fields)
    n = " + ".join(f"CASE WHEN {both[f]} THEN 1 ELSE 0 END" for f in fields)
    return {
        "text": text_sim(f"{t}.title", f"{c}.title"),
        "region": region(t, c),
        "method": method(f"{t}.method", f"{c}.method"),
        "price": price_sim(f"{t}.price", f"{c}.price"),
        "date": f"coalesce(exp(-{gap(f'{t}.published', f'{c}.published')} / (90 * 86400.0)), 0.0)",
        "customer": text_sim(f"{t}.customer", f"{c}.customer"),
        "description": text_sim(f"{t}.description", f"{c}.description"),
        "other": f"coalesce(({total}) / nullif({n}, 0), 0.0)",
    }


WEIGHTS = {
    "text": 0.3, "description": 0.2, "customer": 0.15, "region": 0.1, "method": 0.05, "price": 0.1, "date": 0.05, "other": 0.05,
}


def score(columns: dict[str, str], weights: dict[str, float]) -> str:
    total = sum(weights.values())
    body = " + ".join(f"{columns[n]} * {w / total!r}" for n, w in weights.items())
    return f"greatest(0.0, least(1.0, {body}))"


# --- shared views ------------------------------------------------------------

TENDERS = f"""
places AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
first_part AS (
  SELECT l_orderkey, min(l_linenumber::BIGINT * 1000000000000 + l_partkey) % 1000000000000 AS pk, max(l_shipdate) AS closes
  FROM lineitem GROUP BY l_orderkey),
tenders AS (
  SELECT o_orderkey, 'IKZ' || lpad(o_orderkey::VARCHAR, 12, '0') AS tender_id, o_orderpriority AS method,
    {money('o_totalprice')} AS price_text, {day_text('o_orderdate')} AS published_text, o_orderstatus AS status,
    'RUB' AS currency, p_name AS title, p_type || ' ' || p_brand AS description, p_brand AS platform,
    {day_text('closes')} AS closes_text, c_name AS customer, c_mktsegment AS funding, n_name AS region, r_name AS district,
    o_orderdate, o_totalprice, closes
  FROM orders LEFT JOIN first_part ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = pk
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN places ON c_nationkey = n_nationkey),
prep AS MATERIALIZED (
  SELECT o_orderkey, tender_id, {clean('title')} AS title, {clean('description')} AS description, {clean('customer')} AS customer,
    coalesce(region, '') AS region, coalesce(method, '') AS method, {number('price_text')} AS price, {dated('published_text')} AS published,
    currency, coalesce(funding, '') AS funding, coalesce(status, '') AS status, coalesce(platform, '') AS platform
  FROM tenders)"""

NEW_OLD = """,
latest AS (SELECT max(published) - INTERVAL 7 DAY AS d FROM prep),
fresh AS (SELECT prep.* FROM prep, latest WHERE published > d),
history AS (SELECT prep.* FROM prep, latest WHERE published <= d)"""


def ranked(
    k: int, where: str = "", weights: dict[str, float] = WEIGHTS, targets: str = "fresh", pool: str = "history", other: dict[str, str] | None = None,
) -> str:
    cols = parts("t", "c") | (other or {})
    listed = ", ".join(f"{e} AS {n}" for n, e in cols.items() if n in weights)
    return f""",
pairs AS (SELECT t.tender_id AS target_id, c.tender_id AS tender_id, c.price AS neighbour_price, {listed}
  FROM {targets} t, {pool} c WHERE t.tender_id <> c.tender_id),
exact AS (SELECT *, {score({n: n for n in cols}, weights)} AS full_score FROM pairs),
scored AS (SELECT *, {r6('full_score')} AS score FROM exact),
best AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, tender_id) AS rank FROM scored {where}
  QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY score DESC, tender_id) <= {k})"""


VEC = "vecs AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings)"
NOISY = f"{VEC}, rows_ AS (SELECT id, vec, CASE WHEN label = 9 THEN -1 ELSE label END AS label FROM vecs)"


def cents(src: str = "vecs", out: str = "cents", where: str = "") -> str:
    return f"""{out} AS (SELECT label, any_value(n) AS n, list(a ORDER BY i) AS c FROM (
  SELECT label, i, avg(vec[i]) AS a, count(*) AS n FROM {src}, (SELECT unnest(range(1, 65)) AS i) {where} GROUP BY label, i) GROUP BY label)"""


def length(e: str) -> str:
    return f"sqrt(list_inner_product({e}, {e}))"


def cos(a: str, b: str) -> str:
    return f"(CASE WHEN {length(a)} * {length(b)} = 0 THEN 0.0 ELSE list_inner_product({a}, {b}) / ({length(a)} * {length(b)}) END)"


def vec_top(k: int, expr: str, queries: str, base: str = "vecs", where: str = "", order: str = "DESC") -> str:
    return f"""hits AS (SELECT q.query_id, b.id, {r6(expr)} AS score FROM {queries} q, {base} b {where}),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, id) AS rank FROM hits
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score {order}, id) <= {k})"""


ALL_Q = "asked AS (SELECT id AS query_id, vec AS query_vec FROM vecs)"
CENT_Q = f"{cents()}, asked AS (SELECT label AS query_id, c AS query_vec FROM cents)"


def hashed(e: str) -> str:
    return f"('0x' || substr(md5(({e})::VARCHAR), 1, 8))::BIGINT"


# --- sources and sinks -------------------------------------------------------

ORACLE["json_scan"] = "SELECT event_id, user_id, event_type, value, (props ->> '$.k')::INTEGER AS k FROM events"

ORACLE["page_links"] = rf"""
WITH found AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '{NOISE}', '', 'g'), '(?is)<a\b[^>]*href="([^"]*)"', 1) AS l FROM pages)
SELECT page_id, unnest(range(len(l)))::INTEGER AS pos, 'https://tenders.example' || unnest(l) AS link FROM found"""


def inner_text(e: str) -> str:
    out = f"regexp_replace({e}, '(?s)<[^>]*>', ' ', 'g')"
    for entity, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")]:
        out = f"replace({out}, '{entity}', '{char}')"
    return collapse(out)


def collapse(e: str) -> str:
    plain = rf"replace(replace({e}, '\\n', ' '), '\\xa0', ' ')"
    return strip(f"regexp_replace({plain}, '[{SP}]+', ' ', 'g')")


ORACLE["page_sections"] = rf"""
WITH blocks AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '{NOISE}', '', 'g'), '{PAGE_SECTION}', 1) AS l FROM pages),
one AS (SELECT page_id, unnest(range(len(l))) AS pos, unnest(l) AS b FROM blocks),
parsed AS (SELECT page_id, pos, regexp_matches(b, '{PAGE_TITLE}') AS titled, regexp_extract(b, '{PAGE_TITLE}', 1) AS t,
  regexp_extract(b, '{PAGE_INFO}', 1) AS i FROM one WHERE regexp_matches(b, '{PAGE_INFO}')),
named AS (SELECT page_id, pos, titled, {inner_text('i')} AS info, CASE WHEN titled THEN {inner_text('t')}
  ELSE 'unnamed' || row_number() OVER (PARTITION BY page_id, titled ORDER BY pos) END AS title FROM parsed)
SELECT page_id, title, info FROM named QUALIFY row_number() OVER (PARTITION BY page_id, title ORDER BY titled, pos DESC) = 1"""

ORACLE["essential_projection"] = f"WITH {TENDERS} SELECT tender_id, method, price_text, published_text, status, title, description, customer, region FROM tenders"

ORACLE["typed_tenders"] = f"""WITH {TENDERS}
SELECT tender_id AS icz, coalesce(title, '') AS object_name, coalesce(customer, '') AS customer_full_name, coalesce(region, '') AS region,
  method AS procurement_method, status AS stage, o_orderdate::TIMESTAMP AS start_date_time, closes::TIMESTAMP AS end_date_time,
  closes::DATE AS results_date, o_totalprice AS initial_price, '' AS contract_execution_period,
  coalesce(funding, '') AS participant_requirements, '' AS advantages, coalesce(district, '') AS delivery_place,
  method IN ('1-URGENT', '2-HIGH') AS bid_security_required,
  CASE WHEN method IN ('1-URGENT', '2-HIGH') THEN price_text END AS bid_security_amount,
  status = 'F' AS performance_required, CASE WHEN status = 'F' THEN '10 %' END AS performance_security_size,
  '' AS email, '+7(495)' || substr(tender_id, 4) || '12-3' AS phone, coalesce(platform, '') AS electronic_platform_name,
  '' AS electronic_platform_url FROM tenders"""

ORACLE["canonical_tenders"] = f"""WITH {TENDERS} SELECT tender_id, title, customer, region, method, price, published, status, platform FROM prep"""

CRAWL = """
stored AS (SELECT 'IKZ' || lpad(o_orderkey::VARCHAR, 12, '0') AS icz, 'stored' AS object_name, o_totalprice AS initial_price
  FROM orders WHERE o_orderstatus <> 'P'),
crawl AS (SELECT CASE WHEN l_tax = 0 THEN '' ELSE 'IKZ' || lpad(l_orderkey::VARCHAR, 12, '0') END AS icz,
  CASE WHEN l_discount = 0 THEN '' ELSE 'part ' || l_partkey END AS object_name, l_extendedprice AS initial_price,
  l_linenumber, l_partkey, l_suppkey FROM lineitem),
valid AS (SELECT * FROM crawl WHERE icz <> '' AND object_name <> ''),
last AS (SELECT icz, object_name, initial_price FROM valid
  QUALIFY row_number() OVER (PARTITION BY icz ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, initial_price DESC) = 1)"""

ORACLE["upsert_tenders"] = f"WITH {CRAWL} SELECT * FROM last UNION ALL SELECT * FROM stored WHERE icz NOT IN (SELECT icz FROM last)"
ORACLE["upsert_stats"] = f"""WITH {CRAWL}, n AS (SELECT count(*) AS created FROM last WHERE icz NOT IN (SELECT icz FROM stored))
SELECT created, (SELECT count(*) FROM valid) - created AS updated, (SELECT count(*) FROM crawl) - (SELECT count(*) FROM valid) AS errors FROM n"""
ORACLE["stream_upsert"] = f"WITH {CRAWL} SELECT * FROM last"

CELLS = f"""{VEC}, {cents()},
cells AS (SELECT id, vec, label AS cell_id FROM (SELECT v.id, v.vec, k.label, row_number() OVER (PARTITION BY v.id
  ORDER BY round(list_inner_product(v.vec, v.vec) + list_inner_product(k.c, k.c) - 2 * list_inner_product(v.vec, k.c), 9), k.label) AS rn
  FROM vecs v, cents k) WHERE rn = 1)"""

ORACLE["index_roundtrip"] = f"WITH {CELLS} SELECT id AS vec_id, cell_id, len(vec)::INTEGER AS width, {r6(length('vec'))} AS length, (SELECT count(*) FROM cents)::INTEGER AS cells FROM cells"
ORACLE["ivf_assign"] = f"WITH {CELLS} SELECT id AS vec_id, cell_id FROM cells"
ORACLE["index_append"] = f"WITH {CELLS} SELECT cell_id, count(*) AS members FROM cells GROUP BY cell_id"

# --- filters -----------------------------------------------------------------

KEYED = "'IKZ' || lpad(o_orderkey::VARCHAR, 12, '0')"
ORACLE["filter_eq"] = f"SELECT {KEYED} AS tender_id, o_orderstatus AS status, o_orderpriority AS method FROM orders WHERE o_orderstatus = 'F'"
ORACLE["filter_range"] = f"SELECT {KEYED} AS tender_id, o_totalprice AS price FROM orders WHERE o_totalprice BETWEEN 100000 AND 250000"
ORACLE["filter_in"] = f"""SELECT {KEYED} AS tender_id, n_name AS region FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN ('NATION_3', 'NATION_7', 'NATION_11')"""
ORACLE["post_filter"] = f"""WITH {VEC}, {CENT_Q}, {vec_top(10, cos('q.query_vec', 'b.vec'), 'asked')}
SELECT query_id, id AS vec_id, label, rank, score FROM top JOIN vecs USING (id) WHERE label IN (1, 2, 3)"""

CATALOG = f"""catalog AS (SELECT {KEYED} AS icz, 'Supply contract number ' || o_orderkey || ' for ' || c_name || ' ' || c_mktsegment AS object_name,
  c_name || ' department of ' || c_mktsegment || ' supplies' AS customer_full_name, n_name AS region, o_orderpriority AS procurement_method,
  o_orderstatus AS stage, o_orderdate::TIMESTAMP AS end_date_time, o_totalprice AS initial_price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
SHORT = f"WITH {CATALOG} SELECT icz, region, procurement_method, stage, end_date_time, initial_price FROM catalog WHERE "
ORACLE["catalog_contains"] = SHORT + "contains(lower(region), 'nation_1') AND contains(lower(procurement_method), 'high')"
ORACLE["catalog_date_range"] = SHORT + "end_date_time::DATE BETWEEN DATE '1997-03-01' AND DATE '1997-06-30'"
ORACLE["catalog_price_range"] = SHORT + "initial_price BETWEEN 1000.50 AND 90000"
ORACLE["catalog_search"] = SHORT + """contains(lower(region), 'nation_') AND contains(lower(procurement_method), 'e') AND lower(trim(stage)) = 'p'
  AND end_date_time::DATE BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND initial_price BETWEEN 50000 AND 400000
  AND (contains(lower(object_name), 'machinery') OR contains(lower(customer_full_name), 'machinery') OR contains(lower(icz), 'machinery'))"""
ORACLE["catalog_count"] = f"""WITH {CATALOG} SELECT count(*) AS found FROM catalog WHERE lower(stage) = 'f' AND
  (contains(lower(object_name), 'building') OR contains(lower(customer_full_name), 'building') OR contains(lower(icz), 'building'))"""
ORACLE["catalog_listing"] = f"""WITH {CATALOG} SELECT icz, CASE WHEN length(object_name) > 50 THEN substr(object_name, 1, 49) || '…' ELSE object_name END AS title,
  CASE WHEN length(customer_full_name) > 40 THEN substr(customer_full_name, 1, 39) || '…' ELSE customer_full_name END AS customer, region,
  initial_price::DECIMAL(15,2)::VARCHAR AS price, {day_text('end_date_time')} AS ends, stage FROM catalog ORDER BY end_date_time DESC, icz"""
ORACLE["filter_values"] = f"""WITH {CATALOG}, v AS (SELECT 'region' AS field, lower(trim(region)) AS value FROM catalog UNION
  SELECT 'procurement_method', lower(trim(procurement_method)) FROM catalog UNION SELECT 'stage', lower(trim(stage)) FROM catalog)
SELECT field, value FROM v WHERE value <> ''"""
ORACLE["exclude_one_identical"] = "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) > 1"
ORACLE["criteria_to_target"] = """SELECT c_custkey AS query, n_name AS region, c_mktsegment AS title, c_name AS price_text, NULL::VARCHAR AS method
FROM customer JOIN nation ON c_nationkey = n_nationkey"""

# --- rule-weighted search ----------------------------------------------------

SEARCH = f"WITH {TENDERS}{NEW_OLD}{ranked(10)}"
ORACLE["composite_topk"] = f"{SEARCH} SELECT target_id, tender_id, rank, score FROM best"
ORACLE["topk_threshold"] = f"WITH {TENDERS}{NEW_OLD}{ranked(10, 'WHERE score >= 0.72')} SELECT target_id, tender_id, rank, score FROM best"

TYPED_IN = f""",
typed_in(tender_id, title, description, customer, region, method, price_text, published_text, funding) AS (VALUES
  ('', 'small ring', 'ECONOMY Brand#2', 'Customer#000000001', 'NATION_3', '2-HIGH', '120 000,00', '15.03.1998 10:30', 'BUILDING'),
  ('Q2', 'red widget, blue', 'LARGE Brand#17', '', 'nation_12', '5-LOW', '', 'дата неизвестна', '')),
goals AS (SELECT 'target ' || tender_id AS tender_id, {clean('title')} AS title, {clean('description')} AS description, {clean('customer')} AS customer,
  region, method, {number('price_text')} AS price, {dated('published_text')} AS published, '' AS currency, funding, '' AS status, '' AS platform FROM typed_in),
pool AS (SELECT * FROM prep WHERE status IN ('F', 'O') AND price BETWEEN 20000 AND 450000)"""
OWN = {"text": 0.4, "region": 0.2, "price": 0.2, "date": 0.1, "other": 0.1}
ORACLE["find_similar"] = f"""WITH {TENDERS}{TYPED_IN}{ranked(10, 'WHERE score >= 0.1', OWN, 'goals', 'pool')}
SELECT target_id, rank, tender_id, score, count(*) OVER (PARTITION BY target_id) AS k_returned, 10 AS k_requested, {r6('price')} AS price_part FROM best"""


def explanation() -> str:
    names = ["text", "region", "method", "price", "date", "customer", "description", "other"]
    notes = ", ".join(
        f"CASE WHEN {n} > 0.7 THEN 'high {n} similarity (' || format('{{:.2f}}', {n}::DOUBLE) || ')' "
        f"WHEN {n} < 0.3 THEN 'low {n} similarity (' || format('{{:.2f}}', {n}::DOUBLE) || ')' END" for n in names
    )
    band = """CASE WHEN full_score >= 0.8 THEN 'very strong' WHEN full_score >= 0.6 THEN 'strong' WHEN full_score >= 0.4 THEN 'moderate'
      WHEN full_score >= 0.2 THEN 'weak' ELSE 'very weak' END"""
    picked = f"list_filter([{notes}], lambda x: x IS NOT NULL)[1:3]"
    return (
        f"({band}) || ' similarity (score: ' || format('{{:.3f}}', full_score) || ')' || "
        f"CASE WHEN len({picked}) > 0 THEN ' due to ' || array_to_string({picked}, ', ') ELSE '' END"
    )


ORACLE["explain_composite"] = f"WITH {TENDERS}{NEW_OLD}{ranked(5)} SELECT target_id, rank, tender_id, {explanation()} AS explanation FROM best"

NEIGHBOURS = f"""{SEARCH},
near AS (SELECT target_id, tender_id, score, CASE WHEN neighbour_price > 0 THEN neighbour_price END AS price FROM best),
summary AS (SELECT target_id, count(price) AS used, count(*) AS total, min(price) AS min_price, max(price) AS max_price,
  avg(price) AS mean_, quantile_cont(price, 0.5) AS median_ FROM near GROUP BY target_id),
weighed AS (SELECT *, CASE WHEN sum(score) OVER g > 0 THEN score / sum(score) OVER g ELSE 1.0 / count(*) OVER g END AS w
  FROM near WHERE price IS NOT NULL WINDOW g AS (PARTITION BY target_id)),
running AS (SELECT *, round(sum(w) OVER (PARTITION BY target_id ORDER BY price, tender_id ROWS UNBOUNDED PRECEDING), 9) AS cum FROM weighed),
wmed AS (SELECT target_id, min(price) FILTER (cum >= 0.5) AS wm FROM running GROUP BY target_id)"""
SURE = """greatest(0.0, least(1.0, CASE WHEN used >= 3 THEN 0.7 * least(used / 10.0, 1.0) + 0.3 * (CASE WHEN max_price > 0 THEN
  greatest(0.0, 1.0 - (max_price - min_price) / max_price) ELSE 0.5 END) ELSE 0.3 * (used / 3.0) END))"""
ORACLE["analyze"] = f"""{NEIGHBOURS} SELECT target_id, {r6('wm')} AS predicted_price, {r6(SURE)} AS confidence, min_price, max_price, used, total
FROM summary JOIN wmed USING (target_id)"""
ORACLE["price_mean"] = f"{NEIGHBOURS} SELECT target_id, {r6('mean_')} AS predicted_price, 'mean' AS method FROM summary"
ORACLE["price_median"] = f"{NEIGHBOURS} SELECT target_id, {r6('median_')} AS predicted_price, 'median' AS method FROM summary"
ORACLE["price_weighted_median"] = f"{NEIGHBOURS} SELECT target_id, {r6('wm')} AS predicted_price, 'weighted_median' AS method FROM wmed"
ORACLE["price_minmax"] = f"{NEIGHBOURS} SELECT target_id, min_price AS lowest, max_price AS highest FROM summary"
ORACLE["price_prediction"] = f"{NEIGHBOURS} SELECT target_id, {r6(SURE)} AS confidence, min_price, max_price, used, total FROM summary"
ORACLE["price_mode"] = f"""{NEIGHBOURS},
shape AS (SELECT target_id, count(price)::DOUBLE AS n, min(price) AS lo, max(price) AS hi,
  quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS iqr FROM near GROUP BY target_id),
sized AS (SELECT *, CASE WHEN hi > lo THEN ceil(round((hi - lo) / least(greatest(2 * iqr * pow(n, -1.0 / 3.0), (hi - lo) / sqrt(n) / 2.0),
  (hi - lo) / (log2(n) + 1.0)), 9)) ELSE 1.0 END AS bins FROM shape),
stepped AS (SELECT *, hi / bins - lo / bins AS step FROM sized),
binned AS (SELECT target_id, lo, step, CASE WHEN step > 0 THEN least(floor((price - lo) / step), bins - 1) ELSE 0.0 END AS bin
  FROM near JOIN stepped USING (target_id) WHERE price IS NOT NULL),
held AS (SELECT target_id, lo, step, bin, count(*) AS c FROM binned GROUP BY ALL)
SELECT target_id, {r6('lo + (bin + 0.5) * step')} AS predicted_price, 'mode' AS method FROM held
QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY c DESC, bin) = 1"""

EMBED = f""",
marked AS (SELECT tender_id, f.w, unnest({words('f.t')}) AS token, f.n FROM prep,
  LATERAL (SELECT unnest([{{'t': title, 'w': 0.4, 'n': 1}}, {{'t': description, 'w': 0.3, 'n': 2}}, {{'t': customer, 'w': 0.2, 'n': 3}}]) AS f)),
counted AS (SELECT tender_id, n, w, token, count(*) AS c FROM marked GROUP BY ALL),
unit_ AS (SELECT tender_id, n, w, token, c / sqrt(sum(c * c) OVER (PARTITION BY tender_id, n)) AS u FROM counted),
present AS (SELECT tender_id, sum(w) AS total FROM (SELECT DISTINCT tender_id, n, w FROM counted) GROUP BY tender_id),
embedded AS MATERIALIZED (SELECT tender_id, token, sum(u * w) / any_value(total) AS weight FROM unit_ JOIN present USING (tender_id) GROUP BY tender_id, token)"""
ORACLE["composite_embedding"] = f"WITH {TENDERS}{EMBED} SELECT tender_id, token, {r6('weight')} AS weight FROM embedded"


def embedding_best(k: int) -> str:
    return f"""{EMBED},
sizes AS (SELECT tender_id, sqrt(sum(weight * weight)) AS len FROM embedded GROUP BY tender_id),
dots AS (SELECT a.tender_id AS target_id, b.tender_id, sum(a.weight * b.weight) AS dot FROM embedded a JOIN embedded b USING (token)
  WHERE a.tender_id IN (SELECT tender_id FROM fresh) GROUP BY a.tender_id, b.tender_id),
cosines AS (SELECT t.tender_id AS target_id, c.tender_id, {r6('coalesce(dot / (x.len * y.len), 0.0)')} AS score
  FROM fresh t CROSS JOIN history c LEFT JOIN dots d ON d.target_id = t.tender_id AND d.tender_id = c.tender_id
  LEFT JOIN sizes x ON x.tender_id = t.tender_id LEFT JOIN sizes y ON y.tender_id = c.tender_id),
embedded_best AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, tender_id) AS rank FROM cosines
  QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY score DESC, tender_id) <= {k})"""


ORACLE["embedding_search"] = f"WITH {TENDERS}{NEW_OLD}{embedding_best(10)} SELECT target_id, tender_id, rank, score FROM embedded_best"
ORACLE["compare_methods"] = f"""WITH {TENDERS}{NEW_OLD}{ranked(5)}{embedding_best(5)},
per AS (SELECT 'weighted' AS method, target_id, avg(score) AS a FROM best GROUP BY target_id UNION ALL
  SELECT 'vector', target_id, avg(score) FROM embedded_best GROUP BY target_id),
summary AS (SELECT method, count(*) AS n, avg(a) AS a FROM per GROUP BY method)
SELECT method, {r6('n / (SELECT count(*) FROM fresh)')} AS success_rate, {r6('a')} AS avg_similarity, (SELECT count(*) FROM fresh) AS total_tested,
  {r6("(SELECT a FROM summary WHERE method = 'vector') - (SELECT a FROM summary WHERE method = 'weighted')")} AS similarity_difference FROM summary"""

# --- similarity of two values ------------------------------------------------

NEXT = "FROM prep t JOIN prep c ON c.o_orderkey = t.o_orderkey + 1"
_P = parts("t", "c")
BROKEN_DOWN = f"cut AS (SELECT t.o_orderkey AS pair_id, {', '.join(f'{e} AS {n}' for n, e in _P.items())} {NEXT})"
ORACLE["composite_breakdown"] = f"""WITH {TENDERS}, {BROKEN_DOWN}
SELECT pair_id, {', '.join(f'{r6(n)} AS {n}' for n in _P)}, {r6(score({n: n for n in _P}, WEIGHTS))} AS score FROM cut"""
ORACLE["top_factors"] = f"""WITH {TENDERS}, {BROKEN_DOWN},
long AS (SELECT pair_id, unnest([{', '.join(f"{{'name': '{n}', 'v': {r6(n)}, 'i': {i}}}" for i, n in enumerate(_P))}]) AS f FROM cut),
ranked AS (SELECT pair_id, f, row_number() OVER (PARTITION BY pair_id ORDER BY f.v DESC, f.i) AS rn FROM long)
SELECT pair_id, string_agg(f.name, ',' ORDER BY rn) AS factors, max(f.v) AS best FROM ranked WHERE rn <= 3 GROUP BY pair_id"""
ORACLE["text_similarity"] = f"WITH {TENDERS} SELECT t.o_orderkey AS pair_id, {r6(_P['description'])} AS similarity {NEXT}"
ORACLE["categorical_similarity"] = f"""WITH {TENDERS}, p AS (SELECT t.o_orderkey AS pair_id, t.platform AS a, c.platform AS b {NEXT})
SELECT pair_id, CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0
  WHEN a IN ('Brand#1', 'Brand#2', 'Brand#3') AND b IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 0.5
  WHEN a IN ('Brand#4', 'Brand#5') AND b IN ('Brand#4', 'Brand#5') THEN 0.5
  WHEN contains(b, a) OR contains(a, b) THEN 0.3 ELSE 0.0 END::DOUBLE AS similarity FROM p"""
ORACLE["numeric_similarity"] = f"""WITH {TENDERS} SELECT t.o_orderkey AS pair_id, {r6(_P['price'])} AS gaussian,
  {r6('exp(-abs(t.price - c.price) / 100000.0)')} AS exponential, {r6('1.0 / (1.0 + abs(t.price - c.price))')} AS inverse {NEXT}"""
_G = gap("t.published", "c.published")
ORACLE["temporal_similarity"] = f"""WITH {TENDERS} SELECT t.o_orderkey AS pair_id, {r6(f'exp(-{_G} / (400 * 86400.0))')} AS exponential,
  {r6(f'exp(-pow({_G}, 2) / (2.0 * pow(400 * 86400.0, 2)))')} AS gaussian, {r6(f'greatest(0.0, 1.0 - {_G} / (400 * 86400.0))')} AS linear {NEXT}"""
ORACLE["region_similarity"] = f"WITH {TENDERS} SELECT t.o_orderkey AS pair_id, {r6(region('t', 'c'))} AS similarity {NEXT}"
ORACLE["method_similarity"] = f"""WITH {TENDERS}, p AS (SELECT t.o_orderkey AS pair_id, t.method AS a,
  CASE WHEN c.status = 'O' THEN 're-' || c.method ELSE c.method END AS b {NEXT}) SELECT pair_id, {r6(method('a', 'b'))} AS similarity FROM p"""
ORACLE["vector_breakdown"] = f"""WITH {TENDERS} SELECT t.o_orderkey AS pair_id,
  {', '.join(f"{r6(word_cosine(f't.{n}', f'c.{n}'))} AS {n}_similarity" for n in ('title', 'description', 'customer'))},
  {', '.join(f"{r6(f'(t.{n} = c.{n})::INTEGER')} AS {n}_similarity" for n in ('region', 'method', 'currency'))},
  {r6('CASE WHEN t.price > 0 AND c.price > 0 THEN exp(-abs(ln(t.price) - ln(c.price))) END')} AS price_similarity {NEXT}"""
ORACLE["explain_vector"] = f"""WITH {TENDERS}, p AS (SELECT t.o_orderkey AS pair_id, {r6(_P['text'])} AS s, t.status AS k1, c.status AS k2,
  concat_ws(', ', CASE WHEN t.region <> '' AND t.region = c.region THEN 'same region' END,
    CASE WHEN t.method <> '' AND t.method = c.method THEN 'same procurement method' END,
    CASE WHEN t.customer <> '' AND c.customer <> '' AND (contains(c.customer, t.customer) OR contains(t.customer, c.customer)) THEN 'similar customer' END) AS shared
  {NEXT})
SELECT pair_id, concat_ws('. ', CASE WHEN s > 0.8 THEN 'Very high similarity' WHEN s > 0.6 THEN 'High similarity' WHEN s > 0.4 THEN 'Moderate similarity'
  ELSE 'Low similarity' END, CASE WHEN k1 = k2 THEN 'Both tenders belong to cluster ' || ascii(k2) END,
  CASE WHEN shared <> '' THEN 'Shared characteristics: ' || shared END) || '.' AS explanation FROM p"""

VPAIR = f"{VEC}, p AS (SELECT x.id, x.vec AS a, y.vec AS b FROM vecs x JOIN vecs y ON y.id = x.id + 1)"
ORACLE["cosine"] = f"WITH {VPAIR} SELECT id, {r6(cos('a', 'b'))} AS similarity FROM p"
ORACLE["distance_to_similarity"] = f"""WITH {VPAIR} SELECT id, {r6(f"greatest(0.0, least(1.0, {cos('a', 'b')}))")} AS from_cosine,
  {r6('greatest(0.0, 1.0 - list_distance(a, b) / 2.0)')} AS from_distance FROM p"""
ORACLE["normalize_vectors"] = f"""WITH {VEC}, s AS (SELECT id, list_transform(vec, lambda x: x * 3.0) AS v FROM vecs)
SELECT id, {r6(length('v'))} AS before, 1.0 AS after, {r6(f"v[1] / {length('v')}")} AS first FROM s"""

# --- scalars -----------------------------------------------------------------

_MONEY = money("o_totalprice")
ORACLE["parse_number"] = f"""WITH f AS (SELECT o_orderkey, {_MONEY} AS m, 'до ' || (o_custkey % 100) || ' %' AS pct, o_orderstatus AS s FROM orders)
SELECT o_orderkey, {number('m')} AS plain, {number("translate(m, ' ', ' ')")} AS nbsp, {number("m || ' РОССИЙСКИЙ РУБЛЬ'")} AS currency,
  {number('pct')} AS percent, {number("'-' || m")} AS negative, {number("translate(m, ' ', '.')")} AS dotted, {number('s')} AS words FROM f"""
ORACLE["parse_date"] = f"""WITH f AS (SELECT o_orderkey, {day_text('o_orderdate')} AS d, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS i FROM orders)
SELECT o_orderkey, {dated('d')} AS full, {dated('substr(d, 1, 10)')} AS day, {dated("'  ' || replace(d, ' ', '   ') || ' '")} AS spaced,
  {dated("substr(d, 1, 10) || 'г'")} AS suffixed, {dated('i')} AS iso, {dated("'31.02.' || substr(d, 7, 4)")} AS impossible FROM f"""
ORACLE["clean_text"] = f"SELECT doc_id, {clean('text')} AS cleaned FROM documents"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
ORACLE["clean_text_stopwords"] = f"""WITH c AS (SELECT doc_id, {clean("'Поставка и монтаж, для ' || lang || ' в срок! ' || text")} AS t FROM documents)
SELECT doc_id, array_to_string(list_filter(string_split(t, ' '), lambda w: NOT list_contains({_STOP}, w)), ' ') AS cleaned FROM c"""
ORACLE["collapse_spaces"] = rf"SELECT conv_id, turn, {collapse(chr(39) + ' ' + chr(92) * 2 + 'n' + chr(92) * 2 + 'xa0' + chr(39) + ' || text')} AS text FROM conversations"
ORACLE["normalize_minmax"] = f"SELECT {KEYED} AS tender_id, {r6('(o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders)')} AS scaled FROM orders"
ORACLE["normalize_zscore"] = f"SELECT {KEYED} AS tender_id, {r6('(o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders)')} AS scaled FROM orders"
ORACLE["normalize_log"] = f"SELECT {KEYED} AS tender_id, {r6('ln(1 + greatest(0.0, o_totalprice))')} AS scaled FROM orders"


def calendar(e: str, reference: str) -> dict[str, str]:
    return {
        "timestamp": f"epoch({e})", "day_of_week": f"isodow({e}) - 1", "month": f"month({e})", "quarter": f"quarter({e})",
        "year": f"year({e})", "days_from_reference": f"(epoch({e}) - epoch({reference})) / 86400.0",
    }


ORACLE["date_features"] = f"""SELECT {KEYED} AS tender_id,
  {', '.join(f'{r6(e)} AS {n}' for n, e in calendar('o_orderdate', "TIMESTAMP '1998-01-01 12:00:00'").items())} FROM orders"""
ORACLE["preprocess"] = f"""WITH {TENDERS} SELECT tender_id, {clean('title')} AS title_cleaned, {clean('description')} AS description_cleaned,
  {clean('customer')} AS customer_cleaned, {number('price_text')} AS price_parsed, {dated('published_text')} AS published_parsed,
  {dated('closes_text')} AS closes_parsed, {r6('isodow(closes) - 1')} AS closes_weekday, coalesce(platform, '') AS platform FROM tenders"""
ORACLE["parse_price"] = "SELECT o_orderkey, o_totalprice AS price, NULL::DOUBLE AS unreadable FROM orders"
ORACLE["clean_phone"] = """SELECT c_custkey, substr('+7(495)' || c_custkey || '-00' || repeat(c_custkey::VARCHAR, 20), 1, 50) AS phone FROM customer"""
ORACLE["extract_price"] = "SELECT o_orderkey, o_totalprice AS price FROM orders"


def hide(e: str) -> str:
    return f"CASE WHEN {strip(e)} = '' THEN {cut(e)} WHEN length({e}) <= 5 THEN '***' ELSE substr({e}, 1, 2) || '***' || right({e}, 2) END"


def cut(e: str) -> str:
    return f"(CASE WHEN length({e}) > 50 THEN substr({e}, 1, 47) || '...' ELSE {e} END)"


ORACLE["mask_pii"] = f"SELECT conv_id, turn, {hide('text')} AS contact, {cut('text')} AS note, {hide('role')} AS email FROM conversations"
ORACLE["mask_nested"] = f"""SELECT doc_id, {hide('source')} AS customer, {hide('text')} AS phone, {cut('text')} AS body,
  {hide('lang')} AS email, n_chars, array_to_string(list_transform(string_split(text, chr(10)), lambda x: {cut('x')}), '|') AS notes FROM documents"""

# --- statistics, samples, evaluation -----------------------------------------

ORACLE["field_stats"] = " UNION ALL ".join(
    f"""SELECT '{f}' AS field, {r6(f'min({f})')} AS min, {r6(f'max({f})')} AS max, {r6(f'avg({f})')} AS mean,
  {r6(f'CASE WHEN count({f}) <= 1 THEN 1.0 ELSE stddev_pop({f}) END')} AS std, count({f}) AS count FROM lineitem"""
    for f in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
)
ORACLE["head_sample"] = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000"
ORACLE["train_test_split"] = f"SELECT o_orderkey, CASE WHEN {hashed('o_orderkey')} % 100 < 90 THEN 'train' ELSE 'test' END AS part FROM orders"
ORACLE["ranking_metrics"] = f"""WITH {VEC}, {CENT_Q},
scored AS (SELECT q.query_id, b.id, {r6(cos('q.query_vec', 'b.vec'))} AS score, (b.label = q.query_id)::INTEGER AS rel FROM asked q, vecs b),
ranked AS (SELECT *, row_number() OVER w AS rank, sum(rel) OVER (w ROWS UNBOUNDED PRECEDING) AS hits FROM scored
  WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, id))
SELECT query_id, {r6('sum(rel) FILTER (rank <= 10) / 10.0')} AS precision, {r6('sum(rel) FILTER (rank <= 10) / sum(rel)')} AS recall,
  {r6('1.0 / min(rank) FILTER (rel = 1)')} AS mrr, {r6('sum(hits / rank) FILTER (rel = 1) / sum(rel)')} AS average_precision FROM ranked GROUP BY query_id"""
ORACLE["search_quality"] = f"""WITH {VEC}, asked AS (SELECT id AS query_id, vec AS query_vec FROM vecs ORDER BY {hashed('id')}, id LIMIT 50),
{vec_top(5, cos('q.query_vec', 'b.vec'), 'asked', where='WHERE q.query_id <> b.id')},
per AS (SELECT query_id, avg(score) AS a, max(score) AS t FROM top GROUP BY query_id)
SELECT count(*) AS n_queries, {r6('avg(a)')} AS avg_similarity_mean, {r6('stddev_pop(a)')} AS avg_similarity_std,
  {r6('avg(t)')} AS top_similarity_mean, {r6('stddev_pop(t)')} AS top_similarity_std FROM per"""

# --- vector search -----------------------------------------------------------

_COS = cos("q.query_vec", "b.vec")
_HIT = "query_id, id AS vec_id, rank, score"
ORACLE["vector_topk_cosine"] = f"WITH {VEC}, {CENT_Q}, {vec_top(10, _COS, 'asked')} SELECT {_HIT} FROM top"
ORACLE["vector_topk_batch"] = f"WITH {VEC}, {ALL_Q}, {vec_top(5, _COS, 'asked')} SELECT {_HIT} FROM top"
ORACLE["vector_topk_l2"] = f"""WITH {VEC}, {CENT_Q}, {vec_top(10, 'list_distance(q.query_vec, b.vec)', 'asked', order='ASC')},
far AS (SELECT query_id, max(score) AS m FROM hits GROUP BY query_id)
SELECT query_id, id AS vec_id, rank, {r6('1.0 - score / m')} AS score FROM top JOIN far USING (query_id)"""
ORACLE["search_with_metadata"] = f"""WITH {VEC}, {CENT_Q}, {vec_top(10, _COS, 'asked')}
SELECT {_HIT}, label FROM top JOIN vecs USING (id) WHERE label <> 9"""


def mapped(e: str) -> str:
    return (
        f"list_transform(range(1, 17), lambda j: list_sum(list_transform(range(1, 65), lambda i: {e}[i] * (((i * 7 + j * 13) % 11) - 5) / 10.0)))"
    )


ORACLE["vector_find_similar"] = f"""WITH {VEC}, {cents()}, asked AS (SELECT label AS query_id, {mapped('c')} AS query_vec FROM cents),
base AS MATERIALIZED (SELECT id, label, {mapped('vec')} AS vec FROM vecs), {vec_top(20, _COS, 'asked', 'base')}
SELECT {_HIT}, label FROM top JOIN vecs USING (id) WHERE score >= 0.35 AND label IN (0, 2, 4, 6, 8)"""
ORACLE["project_embeddings"] = f"""WITH {VEC}, m AS (SELECT id, {mapped('vec')} AS v FROM vecs)
SELECT id, len(v)::INTEGER AS width, {r6('v[1]')} AS first, {r6('v[16]')} AS last, {r6(length('v'))} AS length FROM m"""
ORACLE["fit_dimension"] = f"""WITH {VEC} SELECT id, 16 AS cut, 80 AS padded, {r6(length('vec[1:16]'))} AS cut_length, {r6(length('vec'))} AS padded_length FROM vecs"""
_NOT_SELF = "WHERE q.query_id <> b.id"
_NEAR = "query_id AS id, id AS neighbour, rank"
ORACLE["pairwise_cosine"] = f"WITH {VEC}, {ALL_Q}, {vec_top(5, _COS, 'asked', where=_NOT_SELF)} SELECT {_NEAR}, score FROM top"
ORACLE["pairwise_dot"] = f"WITH {VEC}, {ALL_Q}, {vec_top(5, 'list_inner_product(q.query_vec, b.vec)', 'asked', where=_NOT_SELF)} SELECT {_NEAR}, score FROM top"
ORACLE["pairwise_euclidean"] = f"""WITH {VEC}, {ALL_Q}, {vec_top(5, 'list_distance(q.query_vec, b.vec)', 'asked', where=_NOT_SELF, order='ASC')}
SELECT {_NEAR}, {r6('1.0 - score / (SELECT max(score) FROM hits)')} AS score FROM top"""
ORACLE["ivf_search"] = f"""WITH {CELLS},
probes AS (SELECT v.id AS query_id, v.vec AS query_vec, k.label AS cell_id FROM vecs v, cents k QUALIFY row_number() OVER (PARTITION BY v.id
  ORDER BY round(list_inner_product(v.vec, v.vec) + list_inner_product(k.c, k.c) - 2 * list_inner_product(v.vec, k.c), 9), k.label) <= 3),
hits AS (SELECT p.query_id, b.id, {r6('list_distance(p.query_vec, b.vec)')} AS d FROM probes p JOIN cells b USING (cell_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, id) <= 5)
SELECT query_id, id AS vec_id, rank, (0.0 - d) + 0.0 AS score FROM top"""

# --- clusters ----------------------------------------------------------------

_CL = f"{NOISY}, {cents('rows_', 'cents', 'WHERE label <> -1')}"
ORACLE["cluster_sizes"] = f"WITH {NOISY} SELECT label, count(*) AS size FROM rows_ GROUP BY label"
ORACLE["cluster_centroids"] = f"WITH {_CL} SELECT label, unnest(range(64))::INTEGER AS pos, {r6('unnest(c)')} AS value FROM cents"
ORACLE["cluster_stats"] = f"""WITH {_CL}, reach AS (SELECT label, max(list_distance(vec, c)) AS d, avg(vec[4]) AS m, stddev_pop(vec[4]) AS s
  FROM rows_ JOIN cents USING (label) GROUP BY label)
SELECT label, n AS size, {r6('n * 100.0 / (SELECT count(*) FROM rows_)')} AS percentage, {r6('d')} AS diameter, {r6('m')} AS mean_3, {r6('s')} AS std_3,
  {r6(length('c'))} AS centroid_length FROM cents JOIN reach USING (label)"""
_FEATS = f"""{NOISY},
long AS (SELECT id, label, i - 1 AS pos, vec[i] AS v FROM rows_, (SELECT unnest(range(1, 65)) AS i)),
whole AS (SELECT pos, avg(v) AS gm, stddev_pop(v) AS gs FROM long GROUP BY pos),
per AS (SELECT label, pos, avg(v) AS cm, count(*) AS size FROM long WHERE label <> -1 GROUP BY label, pos),
z AS (SELECT label, size, pos, cm, gm, CASE WHEN gs > 0 THEN (cm - gm) / gs ELSE 0.0 END AS z FROM per JOIN whole USING (pos)),
placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(abs(z), 9) DESC, pos DESC) AS place FROM z)"""
ORACLE["cluster_top_features"] = f"""WITH {_FEATS} SELECT label, size, place, pos, {r6('z')} AS z_score, {r6('cm')} AS cluster_mean, {r6('gm')} AS global_mean
FROM placed WHERE place <= 5"""
ORACLE["cluster_descriptions"] = f"""WITH {_FEATS}, said AS (SELECT label, size, place, CASE WHEN abs(z) > 2.0 THEN CASE WHEN z > 0 THEN 'very high' ELSE 'very low' END
  WHEN abs(z) > 1.0 THEN CASE WHEN z > 0 THEN 'high' ELSE 'low' END WHEN z > 0 THEN 'slightly above' ELSE 'slightly below' END || ' feature_' || pos AS phrase
  FROM placed WHERE place <= 3)
SELECT label, 'Cluster ' || label || ' (' || any_value(size) || ' tenders): Characterized by ' || string_agg(phrase, ', ' ORDER BY place) FILTER (place <= 2)
  || ', and 1 other distinctive features' AS description FROM said GROUP BY label"""
ORACLE["assign_outliers"] = f"""WITH {NOISY}, d AS (SELECT q.id, b.label AS new_label, row_number() OVER (PARTITION BY q.id
  ORDER BY {r6('list_distance(q.vec, b.vec)')}, b.id) AS rn FROM rows_ q, rows_ b WHERE q.label = -1 AND b.label <> -1)
SELECT id, coalesce(new_label, label) AS label FROM rows_ LEFT JOIN (SELECT * FROM d WHERE rn = 1) USING (id)"""
ORACLE["predict_cluster"] = f"""WITH {VEC}, {cents()}, d AS (SELECT id, k.label, {r6('list_distance(vec, c)')} AS distance,
  row_number() OVER (PARTITION BY id ORDER BY {r6('list_distance(vec, c)')}, k.label) AS rn FROM vecs, cents k) SELECT id, label, distance FROM d WHERE rn = 1"""
ORACLE["model_report"] = f"""WITH {NOISY} SELECT count(*) AS n_rows, count(DISTINCT CASE WHEN label <> -1 THEN label END) AS n_clusters,
  count(*) FILTER (label = -1) AS n_outliers, max(len(vec))::INTEGER AS embedding_dim FROM rows_"""
# All pairs within the radius; a row is dense with three others there.
ORACLE["density_clusters"] = f"""WITH RECURSIVE {VEC},
near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM vecs a, vecs b WHERE a.id <> b.id AND {r6('list_distance(a.vec, b.vec)')} <= 1.15),
dense AS MATERIALIZED (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 3),
links AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT id FROM dense) AND b IN (SELECT id FROM dense)),
reach AS (SELECT id AS start, id AS node FROM dense UNION SELECT reach.start, links.b FROM reach JOIN links ON reach.node = links.a),
comp AS (SELECT start AS id, min(node) AS component FROM reach GROUP BY start),
big AS (SELECT component FROM comp GROUP BY component HAVING count(*) >= 5)
SELECT vecs.id, coalesce(CASE WHEN component IN (SELECT component FROM big) THEN component END, -1) AS label FROM vecs LEFT JOIN comp ON vecs.id = comp.id"""

# --- features ----------------------------------------------------------------

_DOCS = f"docs AS (SELECT doc_id, {clean('text')} AS t FROM documents)"
ORACLE["encode_text"] = f"""WITH {_DOCS}, w AS (SELECT doc_id, unnest({words('t')}) AS token FROM docs),
n AS (SELECT doc_id, token, count(*) AS n FROM w GROUP BY ALL)
SELECT doc_id, token, n, {r6('n / sqrt(sum(n * n) OVER (PARTITION BY doc_id))')} AS weight FROM n"""
ORACLE["encode_distinct"] = f"""WITH {_DOCS}, w AS (SELECT doc_id, unnest({words('t')}) AS token FROM docs),
n AS (SELECT doc_id, token, count(*) AS n FROM w GROUP BY ALL), s AS (SELECT doc_id, count(*) AS terms, sqrt(sum(n * n)) AS length FROM n GROUP BY doc_id)
SELECT doc_id, md5(text) AS text_key, coalesce(terms, 0) AS terms, {r6('coalesce(length, 0.0)')} AS length FROM documents LEFT JOIN s USING (doc_id)"""


def slots(field: str, cap: int = 12) -> str:
    return f"""SELECT tender_id, '{field}' AS field, coalesce(slot, other)::INTEGER AS slot FROM prep LEFT JOIN (
  SELECT v, row_number() OVER (ORDER BY v) - 1 AS slot FROM (SELECT v, row_number() OVER (ORDER BY n DESC, v DESC) AS rn, count(*) OVER () AS all_
    FROM (SELECT {field} AS v, count(*) AS n FROM prep GROUP BY v)) WHERE all_ <= {cap} OR rn <= {cap - 1}) k ON {field} = v
  CROSS JOIN (SELECT CASE WHEN count(DISTINCT {field}) > {cap} THEN {cap - 1} END AS other FROM prep)"""


ORACLE["onehot"] = f"WITH {TENDERS} " + " UNION ALL ".join(slots(f) for f in ("method", "region", "funding", "platform"))
_LI = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey"


def scaled(shift: str, spread: str) -> str:
    cols = []
    for f in ("l_extendedprice", "l_quantity"):
        cols.append(f"{r6(f'({f} - (SELECT {shift.format(f)} FROM lineitem)) / (SELECT {spread.format(f)} FROM lineitem)')} AS {f[2:]}")
    return f"{_LI}, {', '.join(cols)} FROM lineitem"


ORACLE["scale_standard"] = scaled("avg({})", "stddev_pop({})")
ORACLE["scale_minmax"] = scaled("min({0})", "max({0}) - min({0})")
ORACLE["scale_robust"] = scaled("quantile_cont({}, 0.5)", "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)")
ORACLE["scale_log"] = f"{_LI}, {r6('ln(1 + l_extendedprice)')} AS extendedprice, {r6('ln(1 + l_quantity)')} AS quantity FROM lineitem"

_CAL = calendar("published", "(SELECT max(published) FROM prep)")
_CYC = [
    _CAL["timestamp"], _CAL["days_from_reference"], "sin((isodow(published) - 1) * 2 * pi() / 7)", "cos((isodow(published) - 1) * 2 * pi() / 7)",
    "sin((month(published) - 1) * 2 * pi() / 12)", "cos((month(published) - 1) * 2 * pi() / 12)", _CAL["quarter"], _CAL["year"],
]
ORACLE["temporal_cyclical"] = f"WITH {TENDERS} SELECT tender_id, {', '.join(f'{r6(e)} AS t{i}' for i, e in enumerate(_CYC))} FROM prep"
ORACLE["temporal_encodings"] = f"""WITH {TENDERS} SELECT tender_id, {r6(_CAL['timestamp'])} AS unix, {', '.join(f'{r6(e)} AS c{i}' for i, e in enumerate(_CAL.values()))} FROM prep"""


def fused(weights: tuple[float, float, float, float]) -> str:
    """Sum of place times value over the fused vector, without the raw time stamp."""
    text, cat, num, tim = weights
    terms = [f"{text} * {i + 1} * len(list_filter({words('title')}, lambda w: {hashed('w')} % 8 = {i}))" for i in range(8)]
    terms += [f"{cat} * (9 + (SELECT count(DISTINCT m.method) FROM prep m WHERE m.method < prep.method))"]
    terms += [f"{cat} * (14 + (SELECT count(DISTINCT m.status) FROM prep m WHERE m.status < prep.status))"]
    terms += [f"{num} * 17 * (price - (SELECT avg(price) FROM prep)) / (SELECT stddev_pop(price) FROM prep)"]
    terms += [f"{tim} * {i + 18} * ({e})" for i, e in enumerate(_CYC) if i]
    return " + ".join(terms)


ORACLE["fuse_features"] = f"""WITH {TENDERS} SELECT tender_id, 25 AS width, {r6(fused((1, 1, 1, 1)), 4)} AS joined,
  {r6(fused((0.4, 0.2, 0.2, 0.2)), 4)} AS weighted FROM prep"""

# --- training pairs ----------------------------------------------------------

POS = f"""posk AS (SELECT id, label, {hashed('id')} AS h, ceil(count(*) OVER (PARTITION BY label) / 1000.0)::BIGINT AS nb FROM vecs),
posr AS (SELECT id, coalesce(lead(id) OVER w, first_value(id) OVER w) AS p FROM posk WINDOW w AS (PARTITION BY label, h % nb ORDER BY h, id)),
pos AS (SELECT DISTINCT least(id, p) AS id_a, greatest(id, p) AS id_b, 1 AS label FROM posr WHERE p <> id)"""
NEG = f"""negk AS (SELECT id, label, {hashed('id')} AS h, {hashed('id')} % greatest(1, ceil((SELECT count(*) FROM vecs) / 1000.0)::BIGINT) AS b FROM vecs),
negp AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY label, h, id) - 1 AS p, count(*) OVER (PARTITION BY b) AS n,
  count(*) OVER (PARTITION BY b, label) AS own FROM negk),
negs AS (SELECT *, min(p) OVER (PARTITION BY b, label) AS st FROM negp),
neg AS (SELECT x.id AS id_a, y.id AS id_b, 0 AS label FROM negs x JOIN negs y ON x.b = y.b AND y.p = (x.st + x.own + x.h % (x.n - x.own)) % x.n WHERE x.n > x.own)"""
PAIRS = f"{VEC}, {POS}, {NEG}, made AS (SELECT * FROM pos UNION ALL SELECT * FROM neg)"
ORACLE["labelled_pairs"] = f"WITH {PAIRS} SELECT id_a, id_b, label FROM made"
ORACLE["random_pairs"] = f"""WITH {VEC}, k AS (SELECT id, {hashed('id')} AS h, {hashed("'p' || id")} AS g, {hashed('id')} % greatest(1, ceil((SELECT count(*) FROM vecs) / 1000.0)::BIGINT) AS b FROM vecs),
s AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY h, id) - 1 AS p, count(*) OVER (PARTITION BY b) AS n FROM k)
SELECT x.id AS id_a, y.id AS id_b, 0 AS label FROM s x JOIN s y ON x.b = y.b AND y.p = (x.p + 1 + x.g % (x.n - 1)) % x.n"""
ORACLE["knn_pairs"] = f"""WITH {VEC}, {ALL_Q}, {vec_top(3, 'list_distance(q.query_vec, b.vec)', 'asked', where=_NOT_SELF, order='ASC')}
SELECT query_id AS id_a, id AS id_b, 1 AS label FROM top"""
ORACLE["contrastive_loss"] = f"""WITH {PAIRS}, d AS (SELECT made.label AS y, list_distance(a.vec, b.vec) AS d FROM made JOIN vecs a ON id_a = a.id JOIN vecs b ON id_b = b.id)
SELECT {r6('avg(y * d * d + (1 - y) * pow(greatest(0.0, 1.5 - d), 2))')} AS loss, count(*) AS pairs FROM d"""
ORACLE["triplet_loss"] = f"""WITH {PAIRS}, g AS (SELECT id_a, min(id_b) AS p FROM pos GROUP BY id_a), x AS (SELECT id_a, min(id_b) AS n FROM neg GROUP BY id_a),
d AS (SELECT list_distance(a.vec, p.vec) - list_distance(a.vec, n.vec) AS gap FROM g JOIN x USING (id_a) JOIN vecs a ON a.id = id_a
  JOIN vecs p ON p.id = g.p JOIN vecs n ON n.id = x.n)
SELECT {r6('avg(greatest(0.0, gap + 1.0))')} AS loss, count(*) AS triples FROM d"""

# --- encoder and search model ------------------------------------------------

# Slots of a capped category: 19 values and a shared one where there are more than 20.
_KINDS = {"method": "method", "region": "region", "currency": "''", "funding": "''", "status": "status", "platform": "platform"}


def kept_names(field: str, value: str) -> str:
    return f"""kept_{field} AS (SELECT v, n_all > 20 AND rn > 19 AS other FROM (SELECT v, row_number() OVER (ORDER BY n DESC, v DESC) AS rn, count(*) OVER () AS n_all
  FROM (SELECT coalesce({value}, '') AS v, count(*) AS n FROM prep GROUP BY 1)))"""


_KEPT = ", ".join(kept_names(f, v) for f, v in _KINDS.items())
_ENCODED_WIDTHS = f"""widths AS (SELECT 5 * 64 AS text, {" + ".join(f"(SELECT least(count(*), 20) FROM kept_{f})" for f in _KINDS)} AS categorical, 4 AS numerical, 8 AS temporal)"""
ORACLE["feature_dimensions"] = f"""WITH {TENDERS}, {_KEPT}, {_ENCODED_WIDTHS}
SELECT unnest(['text', 'categorical', 'numerical', 'temporal', 'total']) AS block,
  unnest([text, categorical, numerical, temporal, text + categorical + numerical + temporal])::BIGINT AS width FROM widths"""
_KIND_NAMES = ", ".join(
    f"(SELECT CASE WHEN other THEN '{f} (other)' ELSE '{f}=' || v END FROM kept_{f} WHERE v = coalesce({value}, ''))" for f, value in _KINDS.items()
)
ORACLE["encoded_features"] = f"""WITH {TENDERS}, {_KEPT}
SELECT tender_id, len({words('title')})::BIGINT AS title_words, 0::BIGINT AS description_words, len({words('customer')})::BIGINT AS customer_words,
  len({words(clean('funding'))})::BIGINT AS requirements_words, 0::BIGINT AS criteria_words, array_to_string(list_sort([{_KIND_NAMES}]), ';') AS kinds,
  {r6('(price - (SELECT avg(price) FROM prep)) / (SELECT stddev_pop(price) FROM prep)')} AS price, 0.0::DOUBLE AS contract_price,
  {r6('(price - (SELECT avg(price) FROM prep)) / (SELECT stddev_pop(price) FROM prep)')} AS bid_security, 0.0::DOUBLE AS performance_security,
  {', '.join(f'{r6(_CYC[i])} AS {n}' for i, n in enumerate(("days_from_reference", "week_sin", "week_cos", "year_sin", "year_cos", "quarter", "year"), 1))}
FROM prep"""
ORACLE["train_save_search"] = f"""WITH {TENDERS} SELECT tender_id AS target_id, 1.0::DOUBLE AS score, true AS best, least(10, (SELECT count(*) FROM prep))::BIGINT AS k_returned,
  (SELECT count(*) FROM prep) AS searched, 1.0::DOUBLE AS price_similarity FROM prep WHERE published > (SELECT max(published) FROM prep) - INTERVAL 7 DAY"""
ORACLE["training_report"] = f"""WITH {TENDERS}, {_KEPT}, {_ENCODED_WIDTHS}, {NOISY}, sizes AS (SELECT label, count(*) AS size FROM rows_ GROUP BY label)
SELECT (SELECT count(*) FROM rows_) AS n_rows, (SELECT count(DISTINCT label) FROM rows_ WHERE label <> -1) AS n_clusters,
  (SELECT count(*) FROM rows_ WHERE label = -1) AS n_outliers, (SELECT max(len(vec))::INTEGER FROM rows_) AS embedding_dim,
  (SELECT '{{"categorical":' || categorical || ',"numerical":' || numerical || ',"temporal":' || temporal || ',"text":' || text || ',"total":' || (categorical + numerical + temporal + text) || '}}' FROM widths) AS feature_dimensions,
  (SELECT '{{' || string_agg('"' || label || '":' || size, ',' ORDER BY label) || '}}' FROM sizes) AS cluster_distribution"""

# --- rule-weighted search over a written history -----------------------------

_BEST = "SELECT target_id, tender_id, rank, score FROM best"
ORACLE["composite_topk_pruned"] = f"{SEARCH} {_BEST}"
_OPTIONS = {
    "price": "1.0 / (1.0 + abs(t.price - c.price) / greatest(100000.0, (abs(t.price) + abs(c.price)) / 2.0 * 0.5))",
    "date": f"coalesce(greatest(0.0, 1.0 - {gap('t.published', 'c.published')} / (400 * 86400.0)), 0.0)",
}
ORACLE["composite_options"] = f"WITH {TENDERS}{NEW_OLD}{ranked(10, '', {'price': 0.5, 'date': 0.3, 'method': 0.2}, other=_OPTIONS)} {_BEST}"


def slot_counts(e: str, dims: int) -> str:
    return f"list_transform(range({dims}), lambda i: len(list_filter({words(e)}, lambda w: {hashed('w')} % {dims} = i))::DOUBLE)"


_VECS = ", ".join(f"{slot_counts(f, 16)} AS {f}_v" for f in ("title", "description", "customer"))
_DENSE = {n: f"greatest(0.0, {cos(f't.{f}_v', f'c.{f}_v')})" for n, f in (("text", "title"), ("description", "description"), ("customer", "customer"))}
ORACLE["composite_encoder"] = f"""WITH {TENDERS}{NEW_OLD}, fresh_v AS MATERIALIZED (SELECT *, {_VECS} FROM fresh), history_v AS MATERIALIZED (SELECT *, {_VECS} FROM history)
{ranked(10, targets='fresh_v', pool='history_v', other=_DENSE)} {_BEST}"""
_UNITS = {"title": 0.4, "description": 0.3, "customer": 0.2}
_TERMS = " + ".join(f"coalesce({w} * {f}_v[i] / nullif({length(f'{f}_v')}, 0), 0.0)" for f, w in _UNITS.items())
_PRESENT = " + ".join(f"CASE WHEN {length(f'{f}_v')} > 0 THEN {w} ELSE 0.0 END" for f, w in _UNITS.items())
ORACLE["dense_composite_embedding"] = f"""WITH {TENDERS}, v AS MATERIALIZED (SELECT tender_id, {", ".join(f"{slot_counts(f, 8)} AS {f}_v" for f in _UNITS)} FROM prep),
p AS (SELECT v.*, i FROM v, (SELECT unnest(range(1, 9)) AS i))
SELECT tender_id, (i - 1)::INTEGER AS pos, {r6(f"coalesce(({_TERMS}) / nullif({_PRESENT}, 0), 0.0)")} AS value FROM p"""
_COLS = parts("t", "c")
ORACLE["find_similar_without_id"] = f"""WITH {TENDERS}{NEW_OLD},
pool AS (SELECT prep.* REPLACE (CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE tender_id END AS tender_id), copy
  FROM prep, (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR o_orderkey % 8 = 0),
goals AS (SELECT fresh.* REPLACE (CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE tender_id END AS tender_id), ask
  FROM fresh, (SELECT unnest([0, 1]) AS ask) WHERE ask = 0 OR o_orderkey % 2 = 0),
pairs AS (SELECT t.o_orderkey, t.ask, t.tender_id AS target_id, c.tender_id, {", ".join(f"{e} AS {n}" for n, e in _COLS.items())} FROM goals t, pool c
  WHERE CASE WHEN t.tender_id <> '' THEN c.tender_id <> t.tender_id ELSE NOT (c.o_orderkey = t.o_orderkey AND c.copy = 0) END),
scored AS (SELECT *, {r6(score({n: n for n in _COLS}, WEIGHTS))} AS score FROM pairs)
SELECT o_orderkey, target_id, row_number() OVER (PARTITION BY o_orderkey, ask ORDER BY score DESC, tender_id) AS rank, tender_id, score FROM scored
  QUALIFY row_number() OVER (PARTITION BY o_orderkey, ask ORDER BY score DESC, tender_id) <= 5"""

# --- index of cells and codes, sampled pairs, compacted log ------------------

ORACLE["ivf_pq_search"] = ORACLE["ivf_search"]
ORACLE["compacted_log"] = ORACLE["stream_upsert"]
ORACLE["sampled_pairs"] = f"""WITH {VEC}, k AS (SELECT id, label AS g, row_number() OVER (ORDER BY label, {hashed('id')}, id) - 1 AS pos FROM vecs),
l AS (SELECT g, min(pos) AS start, count(*) AS own, (count(*) * (count(*) - 1) // 2)::HUGEINT AS pairs FROM k GROUP BY g),
m AS (SELECT *, sum(pairs) OVER (ORDER BY g) AS upto, sum(pairs) OVER () AS all_pairs, (sum(own) OVER ())::BIGINT AS n FROM l),
w AS (SELECT *, least(n * 6 // 2, all_pairs)::HUGEINT AS wanted FROM m),
q AS (SELECT *, (wanted * upto // all_pairs - wanted * (upto - pairs) // all_pairs)::BIGINT AS quota FROM w),
j AS (SELECT q.*, unnest(range(quota)) AS j FROM q),
t AS (SELECT *, (j * pairs // quota + {hashed("g || ':' || j")} % ((j + 1) * pairs // quota - j * pairs // quota))::BIGINT AS t FROM j),
i AS (SELECT *, floor((sqrt(8.0 * t + 1) + 1) / 2)::BIGINT AS i FROM t),
good AS (SELECT start + i AS p, start + t - i * (i - 1) // 2 AS q, 1 AS label FROM i),
bad AS (SELECT pos AS p, (start + own + {hashed("'n:' || id || ':' || draw")} % (n - own)) % n AS q, 0 AS label FROM k JOIN q USING (g), (SELECT unnest([1, 2, 3]) AS draw) WHERE n > own)
SELECT CASE WHEN u.label = 0 THEN a.id ELSE least(a.id, b.id) END AS id_a, CASE WHEN u.label = 0 THEN b.id ELSE greatest(a.id, b.id) END AS id_b, u.label
FROM (SELECT * FROM good UNION ALL SELECT * FROM bad) u JOIN k a ON a.pos = u.p JOIN k b ON b.pos = u.q"""
ORACLE["lsh_recall"] = "SELECT count(*) * least(5, count(*) - 1) AS neighbours, true AS enough FROM embeddings"
