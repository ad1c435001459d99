"""Predicates over cards and hits. Every argument is a Column, so a filter may be a
constant or differ per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.functions.text import or_empty, or_no_items, parse_legalities, trimmed


def is_legendary(type_line: Column) -> Column:
    return F.contains(or_empty(type_line), F.lit("Legendary"))


def type_contains(type_line: Column, wanted: Column) -> Column:
    """Letter case aside; a blank wish matches all."""
    wish = trimmed(or_empty(wanted))
    return (wish == "") | F.contains(F.lower(or_empty(type_line)), F.lower(wish))


def wanted_colors(text: Column) -> Column:
    """``"w, u"`` → ``["W", "U"]``; blanks between commas do not count."""
    items = F.split(F.replace(trimmed(or_empty(text)), F.lit(" "), F.lit("")), ",")
    return F.filter(F.transform(items, lambda c: F.upper(trimmed(c))), lambda c: c != "")


def has_all_colors(colors: Column, wanted: Column) -> Column:
    have = F.transform(or_no_items(colors), lambda c: F.upper(trimmed(c)))
    return F.size(F.array_except(wanted_colors(wanted), have)) == 0


def mana_value_between(cmc: Column, low: Column, high: Column) -> Column:
    """Whole part of the mana value, 0 if unknown; a bound that is NULL or below 0 is off."""
    value = F.coalesce(cmc, F.lit(0.0)).cast("bigint")
    low, high = F.coalesce(low, F.lit(-1)), F.coalesce(high, F.lit(-1))
    return ((low < 0) | (value >= low)) & ((high < 0) | (value <= high))


def legal_in(legalities: Column, card_format: str) -> Column:
    status = F.try_element_at(parse_legalities(legalities), F.lit(card_format))
    return F.coalesce(status == "legal", F.lit(False))


def request_filter() -> Column:
    """The filters a request row carries, against the card columns of the same row.

    Request columns: legendary, type_filter, colors_filter, cmc_min, cmc_max.
    """
    return (
        (~F.coalesce("legendary", F.lit(False)) | is_legendary(F.col("type_line")))
        & type_contains(F.col("type_line"), F.col("type_filter"))
        & has_all_colors(F.col("colors"), F.col("colors_filter"))
        & mana_value_between(F.col("cmc"), F.col("cmc_min"), F.col("cmc_max"))
    )


def wishes() -> dict[str, Column]:
    """What ``request_filter`` asks for, worked out once for each request row."""
    return {
        "wish_legendary": F.coalesce("legendary", F.lit(False)),
        "wish_type": F.lower(trimmed(or_empty(F.col("type_filter")))),
        "wish_colors": wanted_colors(F.col("colors_filter")),
        "wish_low": F.coalesce("cmc_min", F.lit(-1)),
        "wish_high": F.coalesce("cmc_max", F.lit(-1)),
    }


def traits() -> dict[str, Column]:
    """What ``request_filter`` looks at, worked out once for each card row."""
    return {
        "own_legendary": is_legendary(F.col("type_line")),
        "own_type": F.lower(or_empty(F.col("type_line"))),
        "own_colors": F.transform(or_no_items(F.col("colors")), lambda c: F.upper(trimmed(c))),
        "own_value": F.coalesce(F.col("cmc"), F.lit(0.0)),
    }


def wishes_met() -> Column:
    """``request_filter`` from the columns of ``wishes`` and ``traits``, for tables of many pairs of
    them: no text is parsed again for each pair."""
    colors = F.size(F.array_except("wish_colors", "own_colors")) == 0
    return (
        (~F.col("wish_legendary") | F.col("own_legendary"))
        & ((F.col("wish_type") == "") | F.contains("own_type", "wish_type"))
        & ((F.size("wish_colors") == 0) | colors)
        & mana_value_between(F.col("own_value"), F.col("wish_low"), F.col("wish_high"))
    )


def exclude_inputs(hits: DataFrame, members: DataFrame) -> DataFrame:
    """Hits without the items the query was made of; both by (query_id, id)."""
    return hits.join(members.select("query_id", "id"), ["query_id", "id"], "left_anti")


def service_k(k: Column) -> Column:
    """The service's number of hits: 10 unless positive."""
    return F.when(k > 0, k).otherwise(F.lit(10))


def browsing_k(k: Column) -> Column:
    """The browsing form's number of hits: from 200 to 500, 200 if not given."""
    return F.least(F.greatest(F.coalesce(k, F.lit(200)), F.lit(200)), F.lit(500))


def page_limit(limit: Column) -> Column:
    """The page size: 20 unless it is from 1 to 100."""
    return F.when(limit.between(1, 100), limit).otherwise(F.lit(20))
