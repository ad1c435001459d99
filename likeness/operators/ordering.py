"""Orders, pages and positions that never sort a whole table in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from likeness.functions.text import or_empty
from likeness.session import cut

# A page is found by counting rows between drawn keys, so many of them at a time, until no
# more than SKIP_ROWS rows lie between the key below the page and the page.
DRAWN_KEYS = 64
SKIP_ROWS = 10_000


def sort_key(key: str) -> str:
    """The column of a sort key; an unknown key sorts by name."""
    return key if key in ("cmc", "name", "similarity") else "name"


def is_descending(order: str) -> bool:
    """Blank means descending, for names too; any other word than desc ascending."""
    return order in ("", "desc")


def sort_hits(hits: DataFrame, key: str = "", order: str = "", similar: bool = False) -> DataFrame:
    """A total order: key, then name, then id, all in the same direction."""
    key = sort_key(key or ("similarity" if similar else "name"))
    first = F.coalesce("cmc", F.lit(0.0)) if key == "cmc" else F.col(key)
    keys = [first, F.col("name"), F.col("id")]
    return hits.orderBy(*[k.desc() if is_descending(order) else k.asc() for k in keys])


def position_in_request(hits: DataFrame, similar: bool, limited: bool = True) -> DataFrame:
    """Adds ``position`` within each query by the query's own sort and order columns.

    Descending is the ascending order read backwards, so one order serves both.
    """
    placed = places_in_request(hits, similar, limited)
    return position_by_order(placed, goes_down(F.col("order")))


def places_in_request(hits: DataFrame, similar: bool, limited: bool = True) -> DataFrame:
    """Adds ``place_in_group`` within each query by its own sort, ascending, and ``rows_in_group``.

    For hits that are ``limited`` per query a window places them; others are sorted over all
    tasks, so that a query which nearly everything matches is no single task.
    """
    key = F.coalesce(F.nullif("sort", F.lit("")), F.lit("similarity" if similar else "name"))
    number = F.when(key == "cmc", F.coalesce("cmc", F.lit(0.0)))
    if similar:
        number = number.when(key == "similarity", F.col("similarity"))
    # A column, as a sort works an expression out again whenever it compares two rows.
    hits = hits.withColumn("sort_number", number)
    keys = [F.asc_nulls_first("sort_number"), F.col("name"), F.col("id")]
    if limited:
        ascending, whole = Window.partitionBy("query_id").orderBy(*keys), Window.partitionBy("query_id")
        place, size = F.row_number().over(ascending), F.count("*").over(whole).cast("int")
        return hits.withColumns({"place_in_group": place, "rows_in_group": size}).drop("sort_number")
    return position_in_group(hits, "query_id", *keys).drop("sort_number")


def goes_down(order: Column) -> Column:
    """``is_descending`` for a column."""
    return or_empty(order).isin("", "desc")


def position_by_order(placed: DataFrame, down: Column) -> DataFrame:
    """``position`` from the place and the query's direction, for rows of ``places_in_request``."""
    place, size = F.col("place_in_group"), F.col("rows_in_group")
    position = F.when(down, size + 1 - place).otherwise(place).cast("int")
    return placed.withColumn("position", position).drop("place_in_group", "rows_in_group")


def position_in_group(rows: DataFrame, group: str, *keys: Column | str) -> DataFrame:
    """Adds ``place_in_group``, counted from 1 in the order of ``keys``, and ``rows_in_group``.

    One range sort by group and keys serves all groups: a group of any size lies in several
    tasks, and its places are positions in the whole less the first one of the group.
    """
    placed = with_position(rows, group, *keys)
    # Stored, so that Spark knows its size: few groups are broadcast, and the rows stay where they are.
    facts = cut(
        placed.groupBy(F.col(group).alias("group_")).agg(
            F.min("position").alias("group_start"), F.count("*").alias("rows_in_group")
        )
    )
    joined = placed.join(facts, placed[group].eqNullSafe(facts["group_"]))
    place = F.col("position") - F.col("group_start") + 1
    return joined.withColumn("place_in_group", place).drop("group_", "group_start", "position")


def collector_keys() -> list[Column]:
    """Set, then numbered before unnumbered, by number, by text, by id."""
    text = or_empty(F.col("collector_number"))
    number = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))
    return [F.col("set").asc(), number.asc_nulls_last(), text.asc(), F.col("id").asc()]


def sort_printings(printings: DataFrame) -> DataFrame:
    return printings.orderBy(*collector_keys())


def with_position(rows: DataFrame, *keys: Column | str) -> DataFrame:
    """Adds ``position``, counted from 0 in the order of ``keys``.

    A range sort over all tasks; the sorted rows are stored once, counted per partition,
    and each partition adds the rows before it.
    """
    spread = rows.orderBy(*keys).withColumn("slot", F.monotonically_increasing_id())
    stored = cut(spread)
    partition = F.shiftright("slot", 33)
    # One row per partition.
    sizes = dict(stored.groupBy(partition.alias("p")).agg(F.count("*")).collect())
    order = sorted(sizes)
    before = [0, *accumulate(sizes[p] for p in order)][: len(order)]
    if not order:
        return stored.withColumn("position", F.col("slot")).drop("slot")
    starts = stored.sparkSession.createDataFrame(
        list(zip(order, before, strict=True)), "p bigint, start bigint"
    )
    return (
        stored.withColumn("p", partition)
        .join(F.broadcast(starts), "p")
        .withColumn("position", F.col("start") + (F.col("slot").bitwiseAND(2**33 - 1)))
        .drop("slot", "p", "start")
    )


def window_of_rows(rows: DataFrame, offset: int, limit: int, *keys: Column | str) -> DataFrame:
    """Rows ``offset`` and on in key order, ``limit`` of them or all for 0."""
    placed = with_position(rows, *keys)
    kept = placed.filter(F.col("position") >= offset)
    return kept.filter(F.col("position") < offset + limit) if limit else kept


def near_page(rows: DataFrame, offset: int, limit: int) -> tuple[DataFrame, int]:
    """Rows of a range of keys that has the page and the row behind it, and the offset of
    the page there. Each round counts the rows between some keys, drawn by a hash of the
    id, in one pass that moves one row per task; only the range is looked at in the next."""
    at = F.struct("name", "id")
    while (total := rows.count()) > SKIP_ROWS:
        share = 16.0 * DRAWN_KEYS / total
        chance = F.xxhash64("id", F.lit(total)).cast("double") / 2.0**64 + 0.5
        drawn = rows.filter(chance <= share).select("name", "id").distinct()
        keys = drawn.orderBy(F.xxhash64("id", "name")).limit(DRAWN_KEYS).orderBy("name", "id")
        keys = [(row["name"], row["id"]) for row in keys.collect()]
        kind = [rows.schema[c].dataType for c in ("name", "id")]
        bounds = [F.struct(*[F.lit(x).cast(t) for x, t in zip(k, kind, strict=True)]) for k in keys]
        below = [F.count_if(at < bound) for bound in bounds]
        counts = list(rows.agg(*below).head()) if below else []
        first = max((i for i, n in enumerate(counts) if n <= offset), default=None)
        end = min((i for i, n in enumerate(counts) if n > offset + limit), default=None)
        start = 0 if first is None else counts[first]
        size = (total if end is None else counts[end]) - start
        if first is not None:
            rows = rows.filter(at >= bounds[first])
        if end is not None:
            rows = rows.filter(at < bounds[end])
        offset -= start
        if size > total // 2:
            break  # rows with one key, or a page of nearly all: no range is smaller
    return rows, offset


def page(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page in (name, id) order, with the facts a pager needs on every row."""
    near, skipped = near_page(rows, offset, limit)
    return page_facts(near.orderBy("name", "id").offset(skipped).limit(limit + 1), offset, limit)


def page_facts(asked: DataFrame, offset: int, limit: int) -> DataFrame:
    """The page and what a pager needs, from its rows and the one behind them."""
    # At most limit + 1 rows are numbered here.
    numbered = asked.withColumn("row", F.row_number().over(Window.orderBy("name", "id")))
    facts = numbered.withColumn("has_next", F.max("row").over(Window.partitionBy()) > limit)
    return facts.filter(F.col("row") <= limit).drop("row").withColumns(
        {
            "has_prev": F.lit(offset > 0),
            "prev_offset": F.lit(max(0, offset - limit)),
            "next_offset": F.lit(offset + limit),
        }
    )


def page_after(rows: DataFrame, name: str, last_id, limit: int) -> DataFrame:
    """The page behind a known last row: no skipping, however deep."""
    behind = (F.col("name") > name) | ((F.col("name") == name) & (F.col("id") > F.lit(last_id)))
    return rows.filter(behind).orderBy("name", "id").limit(limit)


def pages(rows: DataFrame, limit: int) -> DataFrame:
    """Every row with its page's offset and the pager facts: the whole list at once."""
    placed = with_position(rows, "name", "id")
    total = placed.count()
    offset = F.floor(F.col("position") / limit) * limit
    return placed.withColumns(
        {
            "offset": offset,
            "has_prev": offset > 0,
            "has_next": offset + limit < total,
            "prev_offset": F.greatest(offset - limit, F.lit(0)),
            "next_offset": offset + limit,
        }
    )


def sample_legendary(
    cards: DataFrame, n: int = 24, seed: str = "0", name_pool: int | None = None
) -> DataFrame:
    """``n`` legendary creatures in an order that depends on the seed alone.

    With ``name_pool`` they are drawn from that many cards with the word in their name.
    """
    if name_pool is not None:
        named = F.contains(F.lower("name"), F.lit("legendary"))
        cards = cards.filter(named).orderBy("name", "id").limit(name_pool)
    kind = or_empty(F.col("type_line"))
    picks = cards.filter(F.contains(kind, F.lit("Legendary")) & F.contains(kind, F.lit("Creature")))
    draw = F.sha2(F.concat(F.col("id").cast("string"), F.lit(":"), F.lit(seed)), 256)
    return picks.orderBy(draw, "id").limit(n)
