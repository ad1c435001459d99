"""Registered queries: resolution, centroids and nearest neighbours."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.functions import vectors as X
from likeness.operators import approximate, cells, hashing, neighbours, refine, resolve, similar
from likeness.operators.centroid import centroids, weighted_mean
from likeness.operators.filters import exclude_inputs
from likeness.plans import tables as V
from likeness.plans.registry import ORACLES, query

# Small blocks, so that the tiled way has many tiles on small tables as well.
TILES = {"strategy": "cells", "block_rows": 200, "n_cells": 6}


def vector_text(vector: Column) -> Column:
    """A vector with six decimals per value, in a form both engines print alike."""
    values = F.transform(X.doubles(vector), lambda x: x.cast("decimal(9,6)").cast("string"))
    return F.array_join(values, " ")


def sql_vector_text(vector: str) -> str:
    value = "CAST(CAST(CAST(x AS DOUBLE) AS DECIMAL(9,6)) AS VARCHAR)"
    return f"array_to_string(list_transform({vector}, lambda x: {value}), ' ')"


def rounded(hits: DataFrame, *more: str) -> DataFrame:
    return hits.select(
        "query_id",
        "rank",
        "id",
        F.round("distance", 6).alias("distance"),
        F.round("similarity", 6).alias("similarity"),
        *more,
    )


ROUNDED = "round(distance, 6) + 0.0 AS distance, round(1 - distance, 6) + 0.0 AS similarity"


@query(
    "p17_l2_normalize",
    """
    WITH scaled AS (
      SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * label) AS v
      FROM embeddings),
    sized AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM scaled)
    SELECT vec_id, """
    + sql_vector_text("CASE WHEN n > 0 THEN list_transform(v, lambda y: y / n) ELSE v END")
    + " AS vector FROM sized",
)
def p17_l2_normalize(spark, sf_dir):
    label = F.col("label")
    scaled = F.transform(X.doubles(F.col("embedding")), lambda x: x * label)
    rows = V.table(spark, sf_dir, "embeddings").select("vec_id", scaled.alias("vector"))
    unit = X.l2_normalize(F.col("vector"))
    return rows.select("vec_id", vector_text(unit).alias("vector"))


SQL_LABEL_CENTROIDS = """
spread AS (
  SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x,
    generate_subscripts(embedding, 1) AS pos FROM embeddings),
label_means AS (SELECT label, pos, avg(x) AS x FROM spread GROUP BY label, pos),
label_lengths AS (SELECT label, sqrt(sum(x * x)) AS n FROM label_means GROUP BY label),
label_centroids AS (
  SELECT m.label, list(x / n ORDER BY pos) AS centroid
  FROM label_means m JOIN label_lengths l ON m.label = l.label GROUP BY m.label)
"""


@query(
    "p18_similarity_to_label",
    V.with_ctes(SQL_LABEL_CENTROIDS)
    + """SELECT vec_id, e.label,
      round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid), 6) + 0.0 AS similarity
    FROM embeddings e JOIN label_centroids c ON e.label = c.label""",
)
def p18_similarity_to_label(spark, sf_dir):
    rows = V.table(spark, sf_dir, "embeddings")
    labelled = rows.select("label", F.col("embedding").alias("vector"))
    dim = neighbours.dimension(labelled)
    means = centroids(labelled, "label", dim).withColumnRenamed("vector", "centroid")
    distance = X.cosine_distance(F.col("embedding"), F.col("centroid"))
    return rows.join(means, "label").select(
        "vec_id", "label", F.round(X.similarity(distance), 6).alias("similarity")
    )


@query(
    "v1_resolve_names",
    V.with_ctes(V.SQL_CARDS, V.SQL_VECTORS, V.SQL_ORDER_REQUESTS, V.SQL_RESOLVED)
    + "SELECT name, match_kind, matched_name, id FROM resolved",
)
def v1_resolve_names(spark, sf_dir):
    _, named = V.order_requests(spark, sf_dir)
    cards = V.cards(spark, sf_dir)
    return resolve.resolve_names(resolve.clean_names(named), cards.select("name", "id"))


@query(
    "v2_resolve_ids",
    V.with_ctes(V.SQL_CARDS, V.SQL_VECTORS)
    + """SELECT a.id AS asked_id, c.id, c.id IS NOT NULL AS found
    FROM (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS id FROM lineitem) a
    LEFT JOIN catalogue c ON a.id = c.id""",
)
def v2_resolve_ids(spark, sf_dir):
    lines = V.table(spark, sf_dir, "lineitem")
    ids = lines.select(F.col("l_partkey").cast("string").alias("id"))
    catalogue = similar.searchable(V.cards(spark, sf_dir), V.vectors(spark, sf_dir))
    return resolve.resolve_ids(ids, catalogue).withColumn("found", F.col("id").isNotNull())


SQL_REQUESTS = V.with_ctes(
    V.SQL_CARDS, V.SQL_VECTORS, V.SQL_ORDER_REQUESTS, V.SQL_RESOLVED, V.SQL_MEMBERS
)


@query(
    "v3_request_status",
    SQL_REQUESTS
    + """SELECT a.query_id, CASE WHEN complete IS NULL THEN 'empty'
      WHEN NOT complete THEN 'not_found'
      WHEN a.query_id IN (SELECT query_id FROM members) THEN 'ok' ELSE 'empty' END AS status
    FROM asked a LEFT JOIN verdict v ON a.query_id = v.query_id""",
)
def v3_request_status(spark, sf_dir):
    requests, named = V.order_requests(spark, sf_dir)
    cards, vectors = V.cards(spark, sf_dir).select("name", "id"), V.vectors(spark, sf_dir)
    return resolve.resolve_requests(requests, cards, named, vectors)[1]


@query("v3_request_members", SQL_REQUESTS + "SELECT query_id, id, n FROM members")
def v3_request_members(spark, sf_dir):
    requests, named = V.order_requests(spark, sf_dir)
    cards, vectors = V.cards(spark, sf_dir).select("name", "id"), V.vectors(spark, sf_dir)
    return resolve.resolve_requests(requests, cards, named, vectors)[0]


@query(
    "v4_centroids",
    SQL_REQUESTS
    + f""", {V.SQL_CENTROIDS.strip()}
    SELECT query_id, {sql_vector_text('vector')} AS vector FROM centroids""",
)
def v4_centroids(spark, sf_dir):
    requests, named = V.order_requests(spark, sf_dir)
    cards, vectors = V.cards(spark, sf_dir).select("id", "name"), V.vectors(spark, sf_dir)
    dim = neighbours.dimension(vectors)
    queries, _, _ = similar.query_vectors(requests, cards, vectors, dim, named)
    return queries.select("query_id", vector_text(F.col("vector")).alias("vector"))


def _supplier_means(spark, sf_dir):
    lines = V.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("query_id"),
        F.col("l_partkey").cast("string").alias("id"),
        "l_quantity",
    )
    counted = lines.groupBy("query_id", "id").agg(F.sum("l_quantity").alias("w"))
    vectors = V.vectors(spark, sf_dir)
    dim = neighbours.dimension(vectors)
    return weighted_mean(counted.join(vectors, "id"), "query_id", dim, F.col("w"))


SQL_SUPPLIER_MEANS = """
weights AS (
  SELECT l_suppkey AS query_id, CAST(l_partkey AS VARCHAR) AS id, sum(l_quantity) AS w
  FROM lineitem GROUP BY l_suppkey, l_partkey),
weighed AS (
  SELECT query_id, w, unnest(v.vector) AS x, generate_subscripts(v.vector, 1) AS pos
  FROM weights JOIN vectors v ON weights.id = v.id),
supplier_means AS (
  SELECT query_id, list(x ORDER BY pos) AS vector FROM (
    SELECT query_id, pos, sum(w * x) / sum(w) AS x FROM weighed GROUP BY query_id, pos)
  GROUP BY query_id)
"""


@query(
    "v4_weighted_means",
    V.with_ctes(V.SQL_CARDS, V.SQL_VECTORS, SQL_SUPPLIER_MEANS)
    + f"SELECT query_id, {sql_vector_text('vector')} AS vector FROM supplier_means",
)
def v4_weighted_means(spark, sf_dir):
    means = _supplier_means(spark, sf_dir)
    return means.select("query_id", vector_text(F.col("vector")).alias("vector"))


SQL_TOP_10 = (
    V.with_ctes(V.SQL_CARDS, V.SQL_VECTORS, SQL_SUPPLIER_MEANS)
    + f""", pairs AS (
      SELECT q.query_id, v.id, {V.sql_distance('q.vector', 'v.vector')} AS distance
      FROM supplier_means q, vectors v),
    ranked AS (SELECT *, CAST(row_number() OVER (
      PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM pairs)
    SELECT query_id, rank, id, {ROUNDED} FROM ranked WHERE rank <= 10"""
)


@query("v5_exact_topk", SQL_TOP_10)
def v5_exact_topk(spark, sf_dir):
    queries, vectors = _supplier_means(spark, sf_dir), V.vectors(spark, sf_dir)
    return rounded(neighbours.nearest(queries, vectors, 10))


@query("v5b_exact_topk_one_pass", SQL_TOP_10)
def v5b_exact_topk_one_pass(spark, sf_dir):
    queries, vectors = _supplier_means(spark, sf_dir), V.vectors(spark, sf_dir)
    return rounded(
        neighbours.nearest(queries, vectors, 10, strategy="hold_queries", block_rows=200)
    )


@query("v5b_exact_topk_tiles", SQL_TOP_10)
def v5b_exact_topk_tiles(spark, sf_dir):
    queries, vectors = _supplier_means(spark, sf_dir), V.vectors(spark, sf_dir)
    return rounded(neighbours.nearest(queries, vectors, 10, **TILES))


def _all_as_queries(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("id").alias("query_id"), "vector")


def sql_calibrated(*ctes: str) -> str:
    """Cells around sampled rows, and how many of them the drawn queries need: the least number
    at which they find 0.9 of their true neighbours, less two standard errors."""
    return (
        V.with_ctes(*ctes)
        + f""", total AS (SELECT count(*) AS n FROM vectors),
    pivots AS (
      SELECT id AS spot, vector FROM vectors
      ORDER BY sha256(id), id LIMIT (SELECT CAST(ceil(sqrt(n)) AS BIGINT) FROM total)),
    near AS (
      SELECT v.id, p.spot, row_number() OVER (PARTITION BY v.id
        ORDER BY list_cosine_similarity(v.vector, p.vector) DESC, p.spot) AS turn
      FROM vectors v, pivots p),
    homes AS (SELECT id, spot FROM near WHERE turn = 1),
    pairs AS MATERIALIZED (
      SELECT q.id AS query_id, v.id, {V.sql_distance('q.vector', 'v.vector')} AS distance
      FROM vectors q, vectors v),
    best AS MATERIALIZED (
      SELECT query_id, id, distance, CAST(row_number() OVER (
        PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM pairs),
    exact AS (SELECT * FROM best WHERE rank <= 10),
    drawn AS (SELECT id AS query_id FROM vectors ORDER BY sha256('drawn:' || id), id LIMIT 256),
    lies AS (
      SELECT e.query_id, n.turn FROM exact e JOIN drawn USING (query_id)
        JOIN homes h ON e.id = h.id JOIN near n ON n.id = e.query_id AND n.spot = h.spot),
    sizes AS (SELECT spot, count(*) AS n FROM homes GROUP BY 1),
    held AS (
      SELECT d.query_id, turn, sum(n) OVER (PARTITION BY d.query_id ORDER BY turn) AS n
      FROM near JOIN drawn d ON near.id = d.query_id JOIN sizes USING (spot)),
    parts AS (
      SELECT p.turn AS probes, l.query_id, count(*) FILTER (WHERE l.turn <= p.turn) / count(*) AS part
      FROM (SELECT DISTINCT turn FROM lies) p, lies l GROUP BY ALL),
    tried AS (
      SELECT probes, avg(part) AS recall, stddev_pop(part) / sqrt(count(*)) AS error
      FROM parts GROUP BY 1),
    plan AS (
      SELECT probes, recall, error, (SELECT avg(h.n / t.n) FROM held h, total t WHERE h.turn = probes)
        AS share FROM tried WHERE recall - 2 * error >= 0.9 ORDER BY probes LIMIT 1),
    chosen AS (SELECT *, share > 0.5 AS exact FROM plan),
    visited AS (
      SELECT n.id AS query_id, h.id FROM near n JOIN homes h ON n.spot = h.spot, chosen c
      WHERE c.exact OR n.turn <= c.probes),
    ranked AS (SELECT query_id, id, distance, CAST(row_number() OVER (
      PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank
      FROM pairs JOIN visited USING (query_id, id))"""
    )


SQL_CELLS = sql_calibrated(V.SQL_CARDS, V.SQL_VECTORS)
SQL_GROUPED_CELLS = sql_calibrated(V.SQL_GROUPED_VECTORS)
SQL_FOUND = f"SELECT query_id, rank, id, {ROUNDED} FROM ranked WHERE rank <= 10"
SQL_CALIBRATION = """
    SELECT (SELECT CAST(count(*) AS INTEGER) FROM pivots) AS cells,
      (SELECT CAST(count(*) AS INTEGER) FROM drawn) AS drawn, CAST(probes AS INTEGER) AS probes,
      round(recall, 9) AS recall, round(error, 9) AS error, round(share, 9) AS share, exact
    FROM chosen"""
SQL_RECALL = """, hits AS (SELECT query_id, id FROM ranked WHERE rank <= 10),
    counts AS (
      SELECT (SELECT count(*) FROM exact) AS exact_hits,
        (SELECT count(*) FROM exact JOIN hits USING (query_id, id)) AS found_hits,
        (SELECT count(*) FROM visited) AS pairs, (SELECT count(*) FROM pairs) AS all_pairs)
    SELECT exact_hits, found_hits, round(found_hits / exact_hits, 9) AS recall, pairs,
      round(pairs / all_pairs, 9) AS candidate_share FROM counts"""


def _approximate(vectors: DataFrame) -> DataFrame:
    return rounded(approximate.approximate(_all_as_queries(vectors), vectors, 10)[0])


def _calibration(vectors: DataFrame) -> DataFrame:
    _, how = approximate.approximate(_all_as_queries(vectors), vectors, 10)
    told = approximate.as_table(vectors.sparkSession, how)
    return told.withColumns({c: F.round(F.col(c), 9) for c in ("recall", "error", "share")})


def _recall(vectors: DataFrame) -> DataFrame:
    """How much of the exact result was found, over all queries, and with how many pairs."""
    queries = _all_as_queries(vectors)
    index = approximate.cells_for(vectors)
    found, how = approximate.approximate(queries, vectors, 10, index=index)
    probes = how.cells if how.exact else how.probes
    share = cells.candidate_share(index, queries, probes, 10).head()
    facts = neighbours.recall(found, neighbours.nearest(queries, vectors, 10)).withColumns(
        {"pairs": F.lit(share["pairs"]).cast("bigint"), "candidate_share": F.lit(share["candidate_share"])}
    )
    return facts.withColumns({c: F.round(F.col(c), 9) for c in ("recall", "candidate_share")})


@query("v6_approximate_topk", SQL_CELLS + SQL_FOUND)
def v6_approximate_topk(spark, sf_dir):
    """These vectors form no groups, so the calibration goes the exact way."""
    return _approximate(V.vectors(spark, sf_dir))


@query("v6_calibration", SQL_CELLS + SQL_CALIBRATION)
def v6_calibration(spark, sf_dir):
    return _calibration(V.vectors(spark, sf_dir))


@query("v6_recall", SQL_CELLS + SQL_RECALL)
def v6_recall(spark, sf_dir):
    return _recall(V.vectors(spark, sf_dir))


@query("v6_grouped_topk", SQL_GROUPED_CELLS + SQL_FOUND)
def v6_grouped_topk(spark, sf_dir):
    return _approximate(V.grouped_vectors(spark, sf_dir))


@query("v6_grouped_calibration", SQL_GROUPED_CELLS + SQL_CALIBRATION)
def v6_grouped_calibration(spark, sf_dir):
    return _calibration(V.grouped_vectors(spark, sf_dir))


@query("v6_grouped_recall", SQL_GROUPED_CELLS + SQL_RECALL)
def v6_grouped_recall(spark, sf_dir):
    return _recall(V.grouped_vectors(spark, sf_dir))


def sql_hashed(*ctes: str) -> str:
    """Codes by hyperplanes, 12 tables at most, about 32 rows a code, five codes a query."""
    choices = ", ".join(
        f"({n}, {[n >> r & 1 for r in range(hashing.NEAR_PLANES)]})" for n in range(1 << hashing.NEAR_PLANES)
    )
    return (
        V.with_ctes(*ctes)
        + f""", total AS (
      SELECT count(*) AS n, greatest(2, CAST(round(log2(count(*) / 32.0)) AS INTEGER)) AS bits FROM vectors),
    planes AS (
      SELECT t, b, list(CASE WHEN ('0x' || substr(md5(t || ':' || b || ':' || d), 1, 2))::INTEGER < 128
        THEN 1.0::DOUBLE ELSE -1.0 END ORDER BY d) AS normal
      FROM range(12) AS ts(t), (SELECT unnest(range(bits)) AS b FROM total),
        (SELECT unnest(range(len(vector))) AS d FROM (SELECT vector FROM vectors LIMIT 1)) GROUP BY t, b),
    sides AS MATERIALIZED (
      SELECT id, t, b, list_dot_product(vector, normal) AS side FROM vectors, planes),
    codes AS MATERIALIZED (
      SELECT id, t, CAST(sum(CASE WHEN side > 0 THEN 1 << b ELSE 0 END) AS BIGINT) AS code
      FROM sides GROUP BY ALL),
    nearby AS (
      SELECT id, t, list(side * side ORDER BY abs(side), b) AS squares, list(1 << b ORDER BY abs(side), b) AS bit
      FROM sides GROUP BY ALL),
    choices(mask, flips) AS (VALUES {choices}),
    tried AS (
      SELECT id, t, mask,
        list_sum(list_transform(range(1, len(flips) + 1), lambda r: flips[r] * coalesce(squares[r], 0))) AS score,
        CAST(list_sum(list_transform(range(1, len(flips) + 1), lambda r: flips[r] * coalesce(bit[r], 0)))
          AS BIGINT) AS flip
      FROM nearby, choices, total WHERE mask < 1 << bits),
    probed AS MATERIALIZED (
      SELECT id AS query_id, t, xor(code, flip) AS code FROM (
        SELECT *, row_number() OVER (PARTITION BY id, t ORDER BY score, mask) AS place FROM tried)
      JOIN codes USING (id, t) WHERE place <= 5),
    pairs AS MATERIALIZED (
      SELECT q.id AS query_id, v.id, {V.sql_distance('q.vector', 'v.vector')} AS distance
      FROM vectors q, vectors v),
    best AS (SELECT query_id, id, row_number() OVER (
      PARTITION BY query_id ORDER BY distance, id) AS rank FROM pairs),
    exact AS MATERIALIZED (SELECT * FROM best WHERE rank <= 10),
    drawn AS (SELECT id AS query_id FROM vectors ORDER BY sha256('drawn:' || id), id LIMIT 256),
    met AS MATERIALIZED (
      SELECT p.query_id, c.id, p.t FROM probed p JOIN codes c ON p.t = c.t AND p.code = c.code),
    first_met AS (
      SELECT e.query_id, e.id, min(m.t) AS t FROM exact e JOIN drawn USING (query_id)
        LEFT JOIN met m ON m.query_id = e.query_id AND m.id = e.id GROUP BY ALL),
    parts AS (
      SELECT k.t, f.query_id, count(*) FILTER (WHERE f.t <= k.t) / count(*) AS part
      FROM range(12) AS k(t), first_met f GROUP BY ALL),
    shown AS (SELECT t, avg(part) AS recall, stddev_pop(part) / sqrt(count(*)) AS error FROM parts GROUP BY 1),
    chosen AS (
      SELECT * FROM shown WHERE t = coalesce(
        (SELECT min(t) FROM shown WHERE recall - 2 * error >= 0.9), 11)),
    visited AS MATERIALIZED (SELECT m.* FROM met m, chosen c WHERE m.t <= c.t),
    ranked AS (SELECT query_id, id, distance, CAST(row_number() OVER (
      PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank
      FROM pairs JOIN (SELECT DISTINCT query_id, id FROM visited) USING (query_id, id))"""
    )


SQL_HASHED = sql_hashed(V.SQL_CARDS, V.SQL_VECTORS)
SQL_GROUPED_HASHED = sql_hashed(V.SQL_GROUPED_VECTORS)
SQL_HASHED_RECALL = """, hits AS (SELECT query_id, id FROM ranked WHERE rank <= 10)
    SELECT (SELECT bits FROM total) AS bits, CAST(t + 1 AS INTEGER) AS tables,
      round(c.recall, 9) AS measured_recall,
      (SELECT count(*) FROM exact) AS exact_hits,
      (SELECT count(*) FROM exact JOIN hits USING (query_id, id)) AS found_hits,
      round((SELECT count(*) FROM exact JOIN hits USING (query_id, id)) / (SELECT count(*) FROM exact), 9)
        AS recall,
      (SELECT count(*) FROM visited) AS pairs,
      round((SELECT count(*) FROM visited) / (SELECT count(*) FROM pairs), 9) AS pair_share FROM chosen c"""


def _hashed(vectors: DataFrame) -> hashing.Hashed:
    return hashing.build_hashed(vectors, _all_as_queries(vectors), 10, tables=12, bucket_rows=32)


def _hashed_recall(vectors: DataFrame) -> DataFrame:
    """How much of the exact result the tables found, and with how many pairs."""
    index, queries = _hashed(vectors), _all_as_queries(vectors)
    found = hashing.search_hashed(index, queries, 10)
    share = hashing.pair_share(index, queries).head()
    tables, bits, _ = index.normals.shape
    facts = neighbours.recall(found, neighbours.nearest(queries, vectors, 10))
    return facts.select(
        F.lit(bits).alias("bits"),
        F.lit(tables).alias("tables"),
        F.round(F.lit(index.recall), 9).alias("measured_recall"),
        "exact_hits",
        "found_hits",
        F.round("recall", 9).alias("recall"),
        F.lit(share["pairs"]).cast("bigint").alias("pairs"),
        F.round(F.lit(share["pair_share"]), 9).alias("pair_share"),
    )


@query("v6_hashed_topk", SQL_HASHED + SQL_FOUND)
def v6_hashed_topk(spark, sf_dir):
    vectors = V.vectors(spark, sf_dir)
    return rounded(hashing.search_hashed(_hashed(vectors), _all_as_queries(vectors), 10))


@query("v6_hashed_recall", SQL_HASHED + SQL_HASHED_RECALL)
def v6_hashed_recall(spark, sf_dir):
    return _hashed_recall(V.vectors(spark, sf_dir))


@query("v6_hashed_grouped_recall", SQL_GROUPED_HASHED + SQL_HASHED_RECALL)
def v6_hashed_grouped_recall(spark, sf_dir):
    return _hashed_recall(V.grouped_vectors(spark, sf_dir))


@query(
    "v6_all_cells",
    V.with_ctes(V.SQL_CARDS, V.SQL_VECTORS)
    + f""", pairs AS (
      SELECT q.id AS query_id, v.id, {V.sql_distance('q.vector', 'v.vector')} AS distance
      FROM vectors q, vectors v),
    ranked AS (SELECT *, CAST(row_number() OVER (
      PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM pairs)
    SELECT query_id, rank, id, {ROUNDED} FROM ranked WHERE rank <= 5""",
)
def v6_all_cells(spark, sf_dir):
    """Probing every cell, the approximate search has to find what the exact one does."""
    vectors = V.vectors(spark, sf_dir)
    index = cells.build_cells(vectors, n_cells=4)
    return rounded(neighbours.nearest_in_cells(index, _all_as_queries(vectors), 5, probes=4))


SQL_SEARCHED = (
    SQL_REQUESTS
    + f""", {V.SQL_CENTROIDS.strip()},
    pairs AS (
      SELECT q.query_id, CASE WHEN a.k > 0 THEN a.k ELSE 10 END AS k, v.id,
        {V.sql_distance('q.vector', 'v.vector')} AS distance
      FROM centroids q JOIN asked a ON q.query_id = a.query_id, pool v),
    own AS (SELECT query_id, id FROM members)"""
)
_HIT_SQL = """c.name, c.type_line, c.mana_cost, c.oracle_text,
  coalesce(array_to_string(c.colors, '/'), '') AS colors, c.image_normal"""


def _hit_columns(hits: DataFrame) -> DataFrame:
    colors = F.coalesce(F.array_join("colors", "/"), F.lit("")).alias("colors")
    more = ["name", "type_line", "mana_cost", "oracle_text", "image_normal"]
    return rounded(hits.withColumn("colors", colors), *more, "colors")


@query(
    "v7_similar",
    SQL_SEARCHED
    + f""", ranked AS (SELECT *, CAST(row_number() OVER (
      PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM pairs)
    SELECT r.query_id, r.rank, r.id, {ROUNDED}, {_HIT_SQL}
    FROM ranked r JOIN cards c ON r.id = c.id
    WHERE r.rank <= r.k AND NOT EXISTS (
      SELECT 1 FROM own o WHERE o.query_id = r.query_id AND o.id = r.id)""",
)
def v7_similar(spark, sf_dir, **options):
    requests, named = V.order_requests(spark, sf_dir)
    cards, vectors = V.cards(spark, sf_dir), V.vectors(spark, sf_dir)
    return _hit_columns(similar.similar(requests, cards, vectors, named=named, **options)[0])


@query(
    "v7_similar_refill",
    SQL_SEARCHED
    + f""", ranked AS (SELECT *, CAST(row_number() OVER (
        PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank
      FROM pairs p WHERE NOT EXISTS (
        SELECT 1 FROM own o WHERE o.query_id = p.query_id AND o.id = p.id))
    SELECT r.query_id, r.rank, r.id, {ROUNDED}, c.name FROM ranked r JOIN cards c ON r.id = c.id
    WHERE r.rank <= r.k""",
)
def v7_similar_refill(spark, sf_dir, **options):
    requests, named = V.order_requests(spark, sf_dir)
    cards, vectors = V.cards(spark, sf_dir), V.vectors(spark, sf_dir)
    hits, _ = similar.similar(
        requests, cards, vectors, named=named, refill=True, fields=["name"], **options
    )
    return rounded(hits, "name")


@query(
    "f8_exclude_inputs",
    V.with_ctes(V.SQL_CARDS, V.SQL_VECTORS)
    + f""", pairs AS (
      SELECT q.id AS query_id, v.id, {V.sql_distance('q.vector', 'v.vector')} AS distance
      FROM vectors q, vectors v),
    ranked AS (SELECT *, CAST(row_number() OVER (
      PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM pairs)
    SELECT query_id, rank, id, {ROUNDED} FROM ranked WHERE rank <= 4 AND id <> query_id""",
)
def f8_exclude_inputs(spark, sf_dir):
    vectors = V.vectors(spark, sf_dir)
    queries = _all_as_queries(vectors)
    members = queries.select("query_id", F.col("query_id").alias("id"))
    return rounded(exclude_inputs(neighbours.nearest(queries, vectors, 4), members))


@query(
    "f10_filtered_similar",
    SQL_SEARCHED
    + f""", allowed AS (
      SELECT id FROM cards WHERE contains(type_line, 'Legendary')
        AND trunc(coalesce(cmc, 0)) BETWEEN 1 AND 4
        AND legalities LIKE '%"modern":"legal"%'),
    ranked AS (SELECT *, CAST(row_number() OVER (
        PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank
      FROM pairs WHERE id IN (SELECT id FROM allowed))
    SELECT r.query_id, r.rank, r.id, {ROUNDED}, c.type_line
    FROM ranked r JOIN cards c ON r.id = c.id
    WHERE r.rank <= r.k AND NOT EXISTS (
      SELECT 1 FROM own o WHERE o.query_id = r.query_id AND o.id = r.id)""",
)
def f10_filtered_similar(spark, sf_dir, **options):
    from likeness.operators import filters

    where = (
        filters.is_legendary(F.col("type_line"))
        & filters.mana_value_between(F.col("cmc"), F.lit(1), F.lit(4))
        & filters.legal_in(F.col("legalities"), "modern")
    )
    requests, named = V.order_requests(spark, sf_dir)
    cards, vectors = V.cards(spark, sf_dir), V.vectors(spark, sf_dir)
    hits, _ = similar.similar(
        requests, cards, vectors, named=named, where=where, fields=["type_line"], **options
    )
    return rounded(hits, "type_line")


SQL_BROWSED = (
    V.with_ctes(
        V.SQL_CARDS,
        V.SQL_VECTORS,
        V.SQL_BROWSE_REQUESTS,
        "named AS (SELECT query_id, trim(name) AS name FROM browse WHERE id = '')",
        V.SQL_RESOLVED,
    ).rstrip()
    + """,
    chosen AS (
      SELECT b.query_id, coalesce(nullif(b.id, ''), r.id) AS item
      FROM browse b LEFT JOIN resolved r ON b.id = '' AND trim(b.name) = r.name),
    sought AS (SELECT c.query_id, v.vector FROM chosen c JOIN vectors v ON c.item = v.id),
    pairs AS (
      SELECT q.query_id, v.id, """
    + V.sql_distance("q.vector", "v.vector")
    + """ AS distance FROM sought q, pool v),
    ranked AS (SELECT *, CAST(row_number() OVER (
      PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM pairs)"""
)


@query(
    "v8_browse_similar",
    SQL_BROWSED
    + f""", kept AS (
      SELECT r.query_id, r.id, r.distance, c.name, c.cmc, b.sort, b."order"
      FROM ranked r JOIN browse b ON r.query_id = b.query_id JOIN cards c ON r.id = c.id
      WHERE r.rank <= least(greatest(coalesce(b.k, 200), 200), 500) AND {V.SQL_BROWSE_FILTER}),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY
          CASE WHEN sort = 'cmc' THEN coalesce(cmc, 0)
            WHEN sort IN ('', 'similarity') THEN 1 - distance END, name, id) AS up,
        count(*) OVER (PARTITION BY query_id) AS n FROM kept)
    SELECT query_id, id, name, cmc, round(1 - distance, 6) + 0.0 AS similarity,
      CAST(CASE WHEN "order" IN ('', 'desc') THEN n + 1 - up ELSE up END AS INTEGER) AS position
    FROM placed""",
)
def v8_browse_similar(spark, sf_dir, **options):
    requests, cards = V.browse_requests(spark, sf_dir), V.cards(spark, sf_dir)
    listed = similar.browse_similar(requests, cards, V.vectors(spark, sf_dir), **options)
    close = F.round("similarity", 6).alias("similarity")
    return listed.select("query_id", "id", "name", "cmc", close, "position")


@query(
    "v9_similar_to_one",
    SQL_BROWSED
    + f"""SELECT r.query_id, r.rank, r.id, {ROUNDED}, {_HIT_SQL}
    FROM ranked r JOIN cards c ON r.id = c.id WHERE r.rank <= 10""",
)
def v9_similar_to_one(spark, sf_dir):
    requests = V.browse_requests(spark, sf_dir)
    cards, vectors = V.cards(spark, sf_dir), V.vectors(spark, sf_dir)
    return _hit_columns(similar.similar_to_one(requests, cards, vectors, 10))


def _other_ways() -> None:
    """The request queries again, by the ways that large tables take."""
    ways = {"tiles": TILES, "one_pass": {"strategy": "queries_first", "block_rows": 200}}
    for run in (v7_similar, v7_similar_refill, f10_filtered_similar, v8_browse_similar):
        for way, options in ways.items():
            query(f"{run.__name__}_{way}", ORACLES[run.__name__])(partial(run, **options))


_other_ways()


SQL_ALL_PAIRS = (
    V.with_ctes(V.SQL_CARDS, V.SQL_VECTORS)
    + f""", pairs AS (
      SELECT q.id AS query_id, v.id, {V.sql_distance('q.vector', 'v.vector')} AS distance
      FROM vectors q JOIN vectors v ON q.id <> v.id),
    ranked AS (SELECT *, CAST(row_number() OVER (
      PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM pairs)
    SELECT query_id, rank, id, {ROUNDED} FROM ranked WHERE rank <= 10"""
)


@query("v10_neighbours_of_all", SQL_ALL_PAIRS)
def v10_neighbours_of_all(spark, sf_dir):
    return rounded(neighbours.neighbours_of_all(V.vectors(spark, sf_dir), 10))


@query("v10_neighbours_of_all_tiles", SQL_ALL_PAIRS)
def v10_neighbours_of_all_tiles(spark, sf_dir):
    return rounded(neighbours.neighbours_of_all(V.vectors(spark, sf_dir), 10, **TILES))


@query("v10_neighbour_graph")
def v10_neighbour_graph(spark, sf_dir):
    """The same by refinement; what it finds is measured by ``v10_graph_recall``."""
    return rounded(refine.neighbour_graph(V.vectors(spark, sf_dir), 10))


@query(
    "v10_graph_recall",
    V.with_ctes(V.SQL_CARDS, V.SQL_VECTORS)
    + """SELECT count(*) * least(10, count(*) - 1) AS exact_hits, true AS reaches_nine_tenths FROM vectors""",
)
def v10_graph_recall(spark, sf_dir):
    """Whether the refined graph has nine tenths of all vectors' true neighbours."""
    vectors = V.vectors(spark, sf_dir)
    facts = neighbours.recall(refine.neighbour_graph(vectors, 10), neighbours.neighbours_of_all(vectors, 10))
    return facts.select("exact_hits", (F.col("recall") >= 0.9).alias("reaches_nine_tenths"))
