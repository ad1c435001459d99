"""From names and ids to rows of the catalogue, for whole tables of requests.

The catalogue is read once and reduced to one row per distinct name before any shuffle,
so a name shared by a third of all rows costs one row per map task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from likeness.functions.text import trimmed
from likeness.session import cut

# Patterns are looked up by substrings of these lengths, the longest that fits.
SHORT_GRAM, LONG_GRAM = 3, 5
# Names that share a frequent gram are spread over this many tasks.
SALTS = 16
# Up to this many patterns are tested on every name in one scan, without a join.
FEW_PATTERNS = 16
# Rows that one task counts or joins: tasks grow in number with the requests, and not in size.
TASK_ROWS = 500_000


def first_ids(catalogue: DataFrame) -> DataFrame:
    """(name, id): the smallest id of each name."""
    return catalogue.groupBy("name").agg(F.min("id").alias("id"))


def name_matches(name: Column, pattern: Column) -> Column:
    """``name`` holds ``pattern``, letter case aside; ``*`` stands for any text and
    ``?`` for one character."""
    plain = F.contains(F.lower(name), F.lower(pattern))
    quoted = F.regexp_replace(F.lower(pattern), r"([\\.^$|()\[\]{}+])", r"\\$1")
    open_ended = F.replace(quoted, F.lit("*"), F.lit(".*"))
    regex = F.concat(F.lit("(?s)"), F.replace(open_ended, F.lit("?"), F.lit(".")))
    return F.when(pattern.rlike(r"[*?]"), F.rlike(F.lower(name), regex)).otherwise(plain)


def _grams(text: Column, size: int) -> Column:
    """All substrings of one length; empty when the text is shorter."""
    starts = F.when(
        F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(text, i, F.lit(size)))


def name_grams(name: Column, sizes: list[int]) -> Column:
    """The grams of some sizes a name may be looked up by. All names hold the empty one."""
    text = F.lower(name)
    grams = [_grams(text, size) if size else F.array(F.lit("")) for size in sizes]
    return F.array_distinct(F.concat(*grams))


def pattern_grams(pattern: Column) -> Column:
    """Grams that every match must hold: long ones, else short ones, else the literal
    pieces, else the empty gram for a pattern of wildcards alone."""
    pieces = F.filter(F.split(F.lower(pattern), r"[*?]"), lambda p: p != "")
    long = F.flatten(F.transform(pieces, lambda p: _grams(p, LONG_GRAM)))
    short = F.flatten(F.transform(pieces, lambda p: _grams(p, SHORT_GRAM)))
    return (
        F.when(F.size(long) > 0, F.array_distinct(long))
        .when(F.size(short) > 0, F.array_distinct(short))
        .when(F.size(pieces) > 0, F.array_distinct(pieces))
        .otherwise(F.array(F.lit("")))
    )


def containing_names(patterns: DataFrame, names: DataFrame) -> DataFrame:
    """(pattern, name, ...) for all names that match; both inputs distinct.

    Few patterns become constants of one scan over the names. Else, instead of trying
    all pairs, a pattern meets the names that hold its rarest gram, and the match itself
    is tested inside the join.
    """
    few = [row["pattern"] for row in patterns.limit(FEW_PATTERNS + 1).collect()]
    if len(few) <= FEW_PATTERNS:
        hits = [F.when(name_matches(F.col("name"), F.lit(p)), F.lit(p)) for p in few]
        hits = F.array(*hits) if hits else F.array().cast("array<string>")
        return names.select("*", F.explode(hits).alias("pattern")).filter("pattern IS NOT NULL")
    wanted = patterns.select("pattern", F.explode(pattern_grams(F.col("pattern"))).alias("gram"))
    # At most one row per length up to the longest gram.
    sizes = sorted(r[0] for r in wanted.select(F.length("gram")).distinct().collect())
    grams = F.explode(name_grams(F.col("name"), sizes)).alias("gram")
    held = names.select("*", grams)
    counts = (
        held.select("gram")
        .join(wanted.select("gram").distinct(), "gram", "left_semi")
        .groupBy("gram")
        .agg(F.count("*").alias("n"))
    )
    rarest = (
        wanted.join(counts, "gram", "left")
        .groupBy("pattern")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
        .filter(F.col("rarest.n") > 0)
        .select(
            "pattern",
            F.col("rarest.gram").alias("gram"),
            F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
        )
    )
    held = held.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int"))
    matched = held.join(rarest, ["gram", "salt"]).filter(
        name_matches(F.col("name"), F.col("pattern"))
    )
    return matched.drop("gram", "salt")


def first_of_length(patterns: DataFrame, firsts: DataFrame) -> DataFrame:
    """(pattern, first) for patterns of wildcards alone: the first name that has at least as
    many characters as the pattern has question marks, from one row per length of a name."""
    shortest = firsts.groupBy(F.length("name").alias("size")).agg(
        F.min(F.struct("name", "id")).alias("first")
    )
    # At most as many rows as the longest name has characters.
    longer = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("size", 1, -1).over(Window.orderBy("size"))
    best = shortest.select(
        F.min("first").over(longer).alias("first"), before.alias("below"), "size"
    ).select(F.explode(F.sequence(F.col("below") + 1, F.col("size"))).alias("least"), "first")
    marks = F.length(F.regexp_replace("pattern", r"[^?]", ""))
    return patterns.select("pattern", marks.alias("least")).join(best, "least").select(
        "pattern", "first"
    )


def resolve_names(names: DataFrame, catalogue: DataFrame, index=None) -> DataFrame:
    """(name, match_kind, matched_name, id) for each distinct name asked for.

    An equal name wins (``exact``); only without one the first name that contains it
    (``like``), in (name, id) order; else ``none``. With a stored ``index`` (a NameIndex) the
    names and their grams are taken from there instead of the catalogue.
    """
    asked = names.select("name").distinct()
    firsts = cut(first_ids(catalogue) if index is None else index.names())
    looked_up = cut(asked.join(firsts, "name", "left"))
    exact = looked_up.filter(F.col("id").isNotNull()).select(
        "name", F.lit("exact").alias("match_kind"), F.col("name").alias("matched_name"), "id"
    )
    missing = looked_up.filter(F.col("id").isNull()).select(F.col("name").alias("pattern"))
    if missing.isEmpty():
        return exact
    bare = F.col("pattern").rlike(r"^[*?]+$")
    plain = missing.filter(~bare)
    if index is None:
        matched = containing_names(plain, firsts)
    else:
        matched = index.containing(plain).join(firsts, "name")
    found = (
        matched.groupBy("pattern")
        .agg(F.min(F.struct("name", "id")).alias("first"))
    ).unionByName(first_of_length(missing.filter(bare), firsts))
    like = missing.join(found, "pattern", "left").select(
        F.col("pattern").alias("name"),
        F.when(F.col("first").isNull(), "none").otherwise("like").alias("match_kind"),
        F.col("first.name").alias("matched_name"),
        F.col("first.id").alias("id"),
    )
    return exact.unionByName(like)


def resolve_ids(ids: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(asked_id, id): ``id`` is NULL where the catalogue has no such row."""
    asked = ids.select(F.col("id").alias("asked_id")).distinct()
    return asked.join(
        catalogue.select("id"), F.col("asked_id") == F.col("id"), "left"
    )


def named_items(requests: DataFrame) -> DataFrame:
    """(query_id, name): one row per entry of the requests' ``names`` arrays."""
    return requests.select("query_id", F.explode("names").alias("name"))


def clean_names(named: DataFrame) -> DataFrame:
    """Trimmed names, blank ones left out."""
    names = named.select("query_id", trimmed(F.col("name")).alias("name"))
    return names.filter(F.col("name") != "")


def in_tasks(rows: DataFrame, *keys: Column | str) -> DataFrame:
    """``rows`` dealt out by ``keys`` over as many tasks as TASK_ROWS asks for. Left to Spark, a
    task gets a number of compressed bytes, which may be any number of rows of few names."""
    return rows.repartition(max(1, math.ceil(rows.count() / TASK_ROWS)), *keys)


def counted_names(named: DataFrame) -> DataFrame:
    """(query_id, name, n): how often each request has each clean name. The task that a row comes
    from is one of the keys rows are dealt out by, so a name repeated without end is many tasks."""
    rows = in_tasks(clean_names(named), "query_id", "name", F.spark_partition_id())
    return rows.groupBy("query_id", "name").agg(F.count("*").alias("n"))


def resolve_requests(
    requests: DataFrame,
    catalogue: DataFrame,
    named: DataFrame | None = None,
    usable: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Resolve requests of several names each.

    The names are an array ``names`` of the requests, or rows ``named`` (query_id, name).
    Returns (members, status): members (query_id, id, n) for the requests all of whose
    names were found, with n the times an item was named; status (query_id, status) for
    every request: ``ok``, ``not_found`` (some name is unknown) or ``empty``. Items that
    are not among the ids ``usable`` are left out after their names were found; a request
    that has none left is ``empty``.
    """
    counted = cut(counted_names(named_items(requests) if named is None else named))
    known = resolve_names(counted, catalogue).select("name", "id")
    resolved = in_tasks(cut(counted.join(known, "name", "left")), "query_id")
    verdict = resolved.groupBy("query_id").agg(
        F.bool_and(F.col("id").isNotNull()).alias("complete")
    )
    members = (
        resolved.join(verdict.filter("complete"), "query_id", "left_semi")
        .groupBy("query_id", "id")
        .agg(F.sum("n").alias("n"))
    )
    if usable is not None:
        members = cut(members.join(usable.select("id"), "id", "left_semi"))
        left = members.select("query_id").distinct().withColumn("left", F.lit(True))
        verdict = verdict.join(left, "query_id", "left").filter("left OR NOT complete")
    status = requests.select("query_id").join(verdict, "query_id", "left")
    told = (
        F.when(F.col("complete").isNull(), "empty")
        .when(F.col("complete"), "ok")
        .otherwise("not_found")
    )
    return members, status.select("query_id", told.alias("status"))
