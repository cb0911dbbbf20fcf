"""Text clean-up, tokens, masking: all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from bidlens.schema import PII_NAME_PARTS, STOP_WORDS

# White space and word characters spelled out, so that the meaning does not
# depend on the regex engine's Unicode switches.
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
# The same characters as a list, for functions that need no regex.
SPACES = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Without any white space."""
    return F.translate(c, SPACES, "")


def collapse_spaces(c: Column) -> Column:
    """Scraper clean-up: literal ``\\n``/``\\xa0`` escapes and space runs become one space."""
    unescaped = F.replace(F.replace(c, F.lit(r"\\n"), F.lit(" ")), F.lit(r"\\xa0"), F.lit(" "))
    return strip(F.regexp_replace(unescaped, f"[{SPACE}]+", " "))


def clean_text(
    c: Column, lowercase: bool = True, remove_punctuation: bool = True, remove_stopwords: bool = False
) -> Column:
    out = F.lower(c) if lowercase else c
    if remove_punctuation:
        # White space is no kept character either, so one pass drops and collapses.
        out = F.regexp_replace(out, rf"[^{WORD}\-.,]+", " ")
    if remove_stopwords:
        words = F.filter(words_of(out), lambda w: ~w.isin(STOP_WORDS))
        out = F.array_join(words, " ")
    return F.coalesce(strip(out), F.lit(""))


def words_of(c: Column) -> Column:
    """Non-empty runs between spaces."""
    return F.array_remove(F.split(c, f"[{SPACE}]+"), "")


def clean_words(c: Column) -> Column:
    """Words of a text that ``clean_text`` has been through: single spaces, none outside."""
    return F.array_remove(F.split(c, " "), "")


def clean_phone(c: Column) -> Column:
    return F.coalesce(F.substring(F.regexp_replace(c, r"[^\p{Nd}+()\-]", ""), 1, 50), F.lit(""))


def is_pii_name(name: str) -> bool:
    lowered = name.lower()
    return any(part in lowered for part in PII_NAME_PARTS)


def shorten(c: Column) -> Column:
    return F.when(F.length(c) > 50, F.concat(F.substring(c, 1, 47), F.lit("..."))).otherwise(c)


def hide(c: Column) -> Column:
    edges = F.concat(F.substring(c, 1, 2), F.lit("***"), F.substring(c, -2, 2))
    return F.when(strip(c) == "", shorten(c)).when(F.length(c) <= 5, F.lit("***")).otherwise(edges)


def mask_pii(c: Column, name: str) -> Column:
    """Mask by field name: personal data keeps two characters at each end."""
    return hide(c) if is_pii_name(name) else shorten(c)


def mask_by_key(key: Column, value: Column) -> Column:
    """Same rule where the field name is itself data (map entries)."""
    marks = F.lit(False)
    for part in PII_NAME_PARTS:
        marks = marks | F.contains(F.lower(key), F.lit(part))
    return F.when(marks, hide(value)).otherwise(shorten(value))


def mask_value(c: Column, name: str, kind: T.DataType) -> Column:
    """Masked form of a column of any type: texts by field name, nested values by their own names.

    Numbers stay; other values are shown as text.
    """
    if isinstance(kind, T.StringType):
        return mask_pii(c, name)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c
    if isinstance(kind, T.StructType):
        fields = [mask_value(c.getField(f.name), f.name, f.dataType).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
        return F.transform_values(c, lambda k, v: mask_by_key(k, v))
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, T.StructType):
            return F.transform(c, lambda x: mask_value(x, name, inner))
        return F.transform(c, lambda x: mask_pii(x.cast("string"), name))
    return c.cast("string")


def mask_record(df: DataFrame) -> DataFrame:
    """The table with every column masked for logging."""
    return df.select(*[mask_value(F.col(f"`{f.name}`"), f.name, f.dataType).alias(f.name) for f in df.schema.fields])


def name_cut(c: Column, limit: int) -> Column:
    """Listing cut: at most ``limit`` characters, the last being an ellipsis."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("…"))).otherwise(c)
