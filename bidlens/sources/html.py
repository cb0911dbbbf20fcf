"""Links and titled sections out of raw pages, by patterns given as parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bidlens.functions.text import collapse_spaces

# Class names on procurement pages.
BLOCK_CLASS = "row no-gutters registry-entry__form mr-0"
LINK_CLASS = "registry-entry__header-mid__number"
TITLE_CLASS = "section__title"
INFO_CLASS = "section__info"

NOISE = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
PROCUREMENT_LINK = rf'(?is)<div[^>]*class="[^"]*{LINK_CLASS}[^"]*"[^>]*>.*?<a[^>]*href="([^"]*)"'
PROCUREMENT_SECTION = r"(?is)<section\b[^>]*>(.*?)</section>"
PROCUREMENT_TITLE = rf'(?is)<span[^>]*class="{TITLE_CLASS}"[^>]*>(.*?)</span>'
PROCUREMENT_INFO = rf'(?is)<span[^>]*class="{INFO_CLASS}"[^>]*>(.*?)</span>'
ANY_LINK = r'(?is)<a\b[^>]*href="([^"]*)"'


def without_noise(html: Column) -> Column:
    return F.regexp_replace(html, NOISE, "")


# Entities decoded in extracted text, the ampersand last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def inner_text(html: Column) -> Column:
    text = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return collapse_spaces(text)


def links(pages: DataFrame, id_col: str, html: Column, pattern: str = PROCUREMENT_LINK, prefix: str = "") -> DataFrame:
    """(page, pos, link) in page order."""
    found = F.regexp_extract_all(without_noise(html), F.lit(pattern), F.lit(1))
    out = pages.select(id_col, F.posexplode(found).alias("pos", "link"))
    return out.withColumn("link", F.concat(F.lit(prefix), F.col("link"))) if prefix else out


def sections(
    pages: DataFrame, id_col: str, html: Column, section: str = PROCUREMENT_SECTION,
    title: str = PROCUREMENT_TITLE, info: str = PROCUREMENT_INFO,
) -> DataFrame:
    """(page, title, info): sections with info; of one title the last stays.

    Untitled sections are numbered within their page.
    """
    blocks = F.regexp_extract_all(without_noise(html), F.lit(section), F.lit(1))
    # Sections move to their page once; numbering and last-wins then work in place.
    found = pages.select(id_col, F.posexplode(blocks).alias("_pos", "_b")).filter(F.col("_b").rlike(info)).repartition(id_col)
    parsed = found.select(
        id_col, "_pos", F.col("_b").rlike(title).alias("_titled"),
        inner_text(F.regexp_extract("_b", title, 1)).alias("title"), inner_text(F.regexp_extract("_b", info, 1)).alias("info"),
    )
    number = F.row_number().over(Window.partitionBy(id_col, "_titled").orderBy("_pos"))
    named = parsed.withColumn(
        "title", F.when(F.col("_titled"), F.col("title")).otherwise(F.concat(F.lit("unnamed"), number.cast("string")))
    )
    last = F.row_number().over(Window.partitionBy(id_col, "title").orderBy("_titled", F.desc("_pos")))
    return named.withColumn("_last", last).filter("_last = 1").select(id_col, "title", "info")


def as_map(long: DataFrame, id_col: str) -> DataFrame:
    """Sections folded into one title -> text map per page."""
    entries = F.collect_list(F.struct("title", "info"))
    return long.groupBy(id_col).agg(F.map_from_entries(F.array_sort(entries)).alias("raw"))
