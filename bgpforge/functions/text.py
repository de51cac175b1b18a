"""Scalar functions on terms, query texts and durations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"""[?$]\w+|<[^<>\s]*>|"[^"]*"(?:@[A-Za-z-]+|\^\^<[^<>\s]*>)?"""


def pattern_key() -> Column:
    return F.concat_ws(" ", "s", "p", "o", F.lit("."))


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def variables_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[?$]\w+"), F.lit(0)))


def body_of(query: Column) -> Column:
    return F.trim(F.regexp_extract(query, r"\{([^}]*)\}", 1))


def with_extra_pattern(query: Column, extra: Column) -> Column:
    """A further triple before the closing brace."""
    return F.concat(F.regexp_replace(query, r"\}\s*$", ""), extra, F.lit(" }"))


def seconds(text: Column) -> Column:
    """`12ms`, `3s`, `2m` as seconds; null for anything else."""
    number = F.regexp_extract(text, r"^([0-9.]+)(ms|s|m)$", 1).try_cast("double")
    return F.when(text.endswith("ms"), number / 1000).when(text.endswith("s"), number).when(text.endswith("m"), number * 60)


def duration(value: Column) -> Column:
    """Below a second in whole milliseconds, else in whole seconds, rounded up."""
    return F.when(value < 1, F.concat(F.ceil(value * 1000).cast("string"), F.lit("ms"))).otherwise(F.concat(F.ceil(value).cast("string"), F.lit("s")))


def unquoted(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.try_url_decode(text), r"\s+", " "))


def log_ratio_penalty(ratio: Column) -> Column:
    return F.log1p(F.nanvl(F.coalesce(ratio, F.lit(0.0)), F.lit(0.0)))


def shortened(term: Column, size: int = 40) -> Column:
    half = (size - 3) // 2
    return F.when(F.length(term) > size, F.concat(F.left(term, F.lit(half)), F.lit("..."), F.right(term, F.lit(half)))).otherwise(term)


def bar(share: Column, width: int = 40) -> Column:
    return F.repeat(F.lit("█"), F.round(share * width).cast("int"))
