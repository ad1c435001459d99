"""Similar items, from names or ids to hits, for whole tables of requests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.functions.text import trimmed
from likeness.operators.cells import value_kind
from likeness.operators.centroid import centroids
from likeness.operators.filters import (
    browsing_k,
    exclude_inputs,
    request_filter,
    service_k,
)
from likeness.operators.neighbours import dimension, nearest
from likeness.operators.ordering import position_in_request
from likeness.operators.resolve import resolve_names, resolve_requests
from likeness.operators.topn import first_per_group
from likeness.session import cut

# What the vectors that means are made of may weigh to be sent to every task.
HELD_BYTES = 256 * 1024 * 1024
HIT_FIELDS = [
    "name",
    "type_line",
    "mana_cost",
    "oracle_text",
    "colors",
    "image_normal",
]


def searchable(vectors: DataFrame, cards: DataFrame) -> DataFrame:
    """The vectors that can be hits: those with a card. Others are left out before the
    search, so that they take no place among the k."""
    return vectors.join(cards.select("id"), "id", "left_semi")


def needed_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """The vectors of the given ids. Few distinct ids reach the scan as a broadcast that
    Spark sizes at run time, so the vector table itself is not shuffled for them."""
    return vectors.select("id", "vector").join(ids.select("id").distinct(), "id", "left_semi")


def describe(hits: DataFrame, cards: DataFrame, fields: list[str]) -> DataFrame:
    return hits.join(cards.select("id", *fields), "id")


def query_vectors(
    requests: DataFrame,
    cards: DataFrame,
    vectors: DataFrame,
    dim: int,
    named: DataFrame | None = None,
):
    """(queries, members, status) of requests with several names each. Names are looked
    up among all cards; items without a vector are then left out."""
    members, status = resolve_requests(requests, cards.select("name", "id"), named, vectors)
    return member_means(members, vectors, dim), members, status


def member_means(members: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(query_id, vector): the unit mean of each query's members (query_id, id, n). Vectors that
    every task can hold go to the members, which are dealt out by query before that, so that no
    sums are moved; else members go to the vectors."""
    rows = needed_vectors(vectors, members)
    if vectors.count() * (np.dtype(value_kind(vectors)).itemsize * dim + 64) <= HELD_BYTES:
        rows, members = F.broadcast(rows), members.repartition("query_id")
    return centroids(members.join(rows, "id"), "query_id", dim, F.col("n"))


def similar(
    requests: DataFrame,
    cards: DataFrame,
    vectors: DataFrame,
    *,
    named: DataFrame | None = None,
    refill: bool = False,
    where: Column | None = None,
    fields: list[str] = HIT_FIELDS,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """(hits, status) for requests (query_id, names, k), or (query_id, k) and ``named``
    rows (query_id, name).

    Hits are the k nearest items to the mean of the named ones, without those. They are
    left out after the search, so fewer than k may remain; ``refill`` asks for as many
    more. ``where`` limits the candidates before the search, so that k of them survive.
    Requests of the same items are searched and described once, for the largest k, and each
    takes its own from that.
    """
    dim = dimension(vectors) or 1
    members, status = resolve_requests(requests, cards.select("name", "id"), named, vectors)
    pool = searchable(vectors, cards if where is None else cards.filter(where))
    asked = requests.select("query_id", service_k(F.col("k")).cast("int").alias("k"))
    asked = cut(asked.join(same_members(members), "query_id"))

    def found(wanted: DataFrame) -> DataFrame:
        """Hits for (query_id, k, inputs), with their ``place`` before inputs were left out."""
        own = cut(members.join(wanted.select("query_id"), "query_id", "left_semi"))
        means = member_means(own, vectors, dim)
        number = F.col("k") + F.col("inputs") if refill else F.col("k")
        queries = means.join(wanted.select("query_id", number.alias("k")), "query_id")
        hits = exclude_inputs(nearest(queries, pool, dim=dim, **options), own)
        hits = hits.withColumn("place", F.col("rank"))
        if refill:
            most = wanted.agg(F.max("k")).head()[0] or 1
            hits = first_per_group(hits, ["query_id"], ["distance", "id"], most)
        return describe(hits, cards, fields)

    # Ids that several requests have are ranked together, and so on their own.
    again = repeated(asked)
    once = asked if again is None else asked.join(again, "query_id", "left_anti")
    first = cut(once.groupBy("like", "inputs").agg(F.max("k").alias("k")).withColumnRenamed("like", "query_id"))
    shared = found(first).withColumnRenamed("query_id", "like")
    columns = ["id", "query_id", "rank", "distance", "similarity", *fields]
    hits = within_k(once.join(shared, "like"), refill).select(columns)
    if again is not None:
        several = asked.join(again, "query_id", "left_semi")
        own = found(several)
        if refill:
            own = own.join(several.select("query_id", "k"), "query_id").filter(F.col("rank") <= F.col("k"))
        hits = hits.unionByName(own.select(columns))
    return hits, status


def same_members(members: DataFrame) -> DataFrame:
    """(query_id, inputs, like): how many members a request has, and the smallest id of a request
    that has the same ones, each as often. They are told apart by 128 bits of hashes, which
    together with their number makes a row of fixed size of any request."""
    marks = [F.bit_xor(F.xxhash64(F.lit(i), F.col("id"), F.col("n"))).alias(f"mark{i}") for i in range(2)]
    sets = cut(members.groupBy("query_id").agg(F.count("*").cast("int").alias("inputs"), *marks))
    key = ["inputs", "mark0", "mark1"]
    alike = sets.groupBy(*key).agg(F.min("query_id").alias("like"))
    return sets.join(alike, key).select("query_id", "inputs", "like")


def repeated(asked: DataFrame) -> DataFrame | None:
    """The query ids (query_id) that several rows have, if any."""
    ids = asked.groupBy("query_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("query_id")
    return None if ids.isEmpty() else cut(ids)


def within_k(hits: DataFrame, refill: bool) -> DataFrame:
    """Of the hits found for all that share a search those that one row asks for by its own k."""
    searched = F.col("k") + F.col("inputs") if refill else F.col("k")
    return hits.filter((F.col("rank") <= F.col("k")) & (F.col("place") <= searched))


def chosen_items(requests: DataFrame, cards: DataFrame) -> DataFrame:
    """(query_id, item_id) for requests by one name or id; an id wins."""
    by_id = requests.filter(trimmed(F.col("id")) != "").select("query_id", trimmed(F.col("id")).alias("item_id"))
    by_name = requests.filter((F.coalesce(trimmed(F.col("id")), F.lit("")) == "") & (trimmed(F.col("name")) != ""))
    named = by_name.select("query_id", trimmed(F.col("name")).alias("name"))
    resolved = resolve_names(named, cards.select("name", "id"))
    return by_id.unionByName(
        named.join(resolved.select("name", F.col("id").alias("item_id")), "name").select(
            "query_id", "item_id"
        )
    )


def item_vectors(chosen: DataFrame, vectors: DataFrame) -> DataFrame:
    """``chosen`` rows with the ``vector`` of their item_id."""
    rows = needed_vectors(vectors, chosen.select(F.col("item_id").alias("id")))
    return chosen.join(rows.withColumnRenamed("id", "item_id"), "item_id")


def single_queries(requests: DataFrame, cards: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, item_id, vector) for requests by one name or id; an id wins."""
    return item_vectors(chosen_items(requests, cards), vectors)


def similar_to_one(
    requests: DataFrame, cards: DataFrame, vectors: DataFrame, k: int = 10, **options
) -> DataFrame:
    """The k nearest to one named item, which is not left out."""
    queries = single_queries(requests, cards, vectors)
    hits = nearest(queries, searchable(vectors, cards), k, **options)
    return describe(hits, cards, HIT_FIELDS)


def browse_similar(
    requests: DataFrame, cards: DataFrame, vectors: DataFrame, **options
) -> DataFrame:
    """From 200 to 500 nearest to one item, then the request's own filters and order. Requests
    for the same item are searched and described once, for the largest k of them."""
    own = ["legendary", "type_filter", "colors_filter", "cmc_min", "cmc_max", "sort", "order"]
    fields = [*HIT_FIELDS, "cmc", "set", "rarity"]
    asked = requests.select("query_id", browsing_k(F.col("k")).cast("int").alias("k"))
    asked = cut(chosen_items(requests, cards).join(asked, "query_id"))
    pool = searchable(vectors, cards)

    def found(wanted: DataFrame) -> DataFrame:
        """Hits for (query_id, item_id, k)."""
        queries = item_vectors(wanted, vectors).select("query_id", "vector", "k")
        return describe(nearest(queries, pool, **options), cards, fields)

    again = repeated(asked)
    once = asked if again is None else asked.join(again, "query_id", "left_anti")
    first = cut(once.groupBy("item_id").agg(F.max("k").alias("k")))
    shared = found(first.withColumn("query_id", F.col("item_id"))).withColumnRenamed("query_id", "item_id")
    columns = ["query_id", "id", "rank", "distance", "similarity", *fields, *own]
    takers = once.join(requests.select("query_id", *own), "query_id")
    listed = shared.join(takers, "item_id").filter(F.col("rank") <= F.col("k")).select(columns)
    if again is not None:
        hits = found(asked.join(again, "query_id", "left_semi"))
        listed = listed.unionByName(hits.join(requests.select("query_id", *own), "query_id").select(columns))
    return position_in_request(listed.filter(request_filter()), similar=True).drop(*own)
