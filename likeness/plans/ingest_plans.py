"""Registered queries: files, encoders, upserts and the ingest stream."""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from likeness.operators import encode
from likeness.operators.encoders import HashingEncoder
from likeness.operators.flatten import flatten_cards
from likeness.plans import tables as V
from likeness.plans.registry import query
from likeness.plans.text_plans import SQL_TAGGED, embedding_sql
from likeness.plans.vector_plans import sql_vector_text, vector_text
from likeness.schema import VECTOR
from likeness.session import cut, fresh_dir
from likeness.sources import batches, vector_table
from likeness.sources.cards import read_cards
from likeness.streaming.ingest import card_stream, reembed_all, run_ingest

DIM = 64
# Records that the queries below write to one file, beyond a few files.
FILE_RECORDS = 50_000
CONFIG = encode.EncodeConfig(model="hashing-64", include_name=True, tags_weight=2)


_hashing = partial(HashingEncoder, DIM)


SQL_READ = V.with_ctes(V.SQL_RAW) + """
    SELECT id, name, cmc, stored_text AS oracle_text, image_normal, legalities,
      CAST(len(coalesce(colors, [])) AS INTEGER) AS n_colors FROM stored"""


def _read(spark, path, layout, **how):
    flat = flatten_cards(read_cards(spark, path, layout=layout, **how))
    return flat.select(
        F.col("scryfall_id").alias("id"),
        *["name", "cmc", "oracle_text", "image_normal", "legalities"],
        F.size("colors").alias("n_colors"),
    )


def _files(spark, sf_dir, least: int) -> int:
    """How many files all raw records are written to, so that no task has too many of them."""
    most = V.table(spark, sf_dir, "part").count() + V.table(spark, sf_dir, "documents").count()
    return max(least, math.ceil(most / FILE_RECORDS))


def _write_arrays(spark, sf_dir, pretty: bool = False) -> str:
    """Files of one JSON array each, with one record per line, or one value per line."""
    path = fresh_dir(spark, "cards-array")
    raw = V.raw_cards(spark, sf_dir)
    how = {"pretty": str(pretty).lower()}
    rows = raw.select("id", F.to_json(F.struct(*raw.columns), how).alias("card"))
    rows = rows.withColumn("file", F.pmod(F.xxhash64("id"), F.lit(_files(spark, sf_dir, 8))))
    of_file = Window.partitionBy("file").orderBy("id")
    first, last = F.lag("id").over(of_file).isNull(), F.lead("id").over(of_file).isNull()
    start = F.when(first, F.lit("[\n")).otherwise("")
    end = F.when(last, F.lit("\n]")).otherwise(",")
    lines = rows.withColumn("value", F.concat(start, "card", end)).select("file", "id", "value")
    lines = lines.repartition("file").sortWithinPartitions("file", "id")
    lines.select("file", "value").write.partitionBy("file").text(path)
    return path


@query("s1_read_card_files", SQL_READ)
def s1_read_card_files(spark, sf_dir):
    path = fresh_dir(spark, "cards-json")
    V.raw_cards(spark, sf_dir).write.json(path)
    return _read(spark, path, "lines")


@query("s1_read_array_lines", SQL_READ)
def s1_read_array_lines(spark, sf_dir):
    return _read(spark, _write_arrays(spark, sf_dir), "array_lines")


@query("s1_read_arrays", SQL_READ)
def s1_read_arrays(spark, sf_dir):
    return _read(spark, _write_arrays(spark, sf_dir), "array")


@query("s1_read_array_ranges", SQL_READ)
def s1_read_array_ranges(spark, sf_dir):
    """Formatted arrays, each file read by many tasks."""
    path = _write_arrays(spark, sf_dir, pretty=True)
    return _read(spark, path, "array_ranges", range_bytes=16 * 1024)


@query(
    "s4_s5_batch_files",
    V.with_ctes(V.SQL_RAW, V.SQL_VECTORS.replace("catalogue AS", "unused AS").replace(
        "SELECT * FROM cards WHERE", "SELECT id FROM stored WHERE"
    ))
    + f"""SELECT s.id, 'Card' AS class, s.name, s.cmc, s.edhrec_rank, s.image_normal,
      {sql_vector_text('v.vector')} AS vector
    FROM stored s JOIN vectors v ON s.id = v.id""",
)
def s4_s5_batch_files(spark, sf_dir):
    path = fresh_dir(spark, "batches")
    flat = flatten_cards(V.raw_cards(spark, sf_dir))
    batches.write_batches(batches.batch_objects(flat, V.vectors(spark, sf_dir)), path, 100)
    objects = batches.read_batches(spark, path)
    fields = ["name", "cmc", "edhrec_rank", "image_normal"]
    return objects.select(
        "id",
        "class",
        *[F.col(f"properties.{f}").alias(f) for f in fields],
        vector_text(F.col("vector")).alias("vector"),
    )


@query(
    "s6_upsert",
    """
    WITH news AS (
      SELECT l_partkey AS id, l_extendedprice AS price, row_number() OVER (PARTITION BY l_partkey
        ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS place
      FROM lineitem WHERE l_returnflag = 'R')
    SELECT p_partkey AS id, coalesce(n.price, p_retailprice) AS price
    FROM part LEFT JOIN news n ON p_partkey = n.id AND n.place = 1
    UNION ALL
    SELECT id, price FROM news WHERE place = 1 AND id NOT IN (SELECT p_partkey FROM part)""",
)
def s6_upsert(spark, sf_dir):
    current = V.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price")
    )
    lines = V.table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"]
    incoming = lines.select(
        F.col("l_partkey").alias("id"), F.col("l_extendedprice").alias("price"), *order
    )
    return vector_table.upsert(current, incoming, "id", *order)


@query(
    "s10_progress",
    V.with_ctes(V.SQL_CARDS, V.SQL_VECTORS)
    + """SELECT (SELECT count(*) FROM catalogue) AS done, count(*) AS total,
      round(100.0 * (SELECT count(*) FROM catalogue) / count(*), 6) AS percent FROM cards""",
)
def s10_progress(spark, sf_dir):
    facts = vector_table.progress(V.cards(spark, sf_dir), V.vectors(spark, sf_dir))
    return facts.select(
        F.col("done").cast("bigint").alias("done"), "total", F.round("percent", 6).alias("percent")
    )


SQL_HASHED = """
words AS (
  SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \\t\\r\\n]+')) AS w FROM documents),
spots AS (
  SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS spot, count(*) AS n
  FROM words WHERE w <> '' GROUP BY ALL),
sizes AS (SELECT doc_id, sqrt(sum(n * n)) AS size FROM spots GROUP BY doc_id),
places AS (SELECT unnest(range(64)) AS spot),
hashed AS (
  SELECT d.doc_id, list(coalesce(s.n / z.size, 0) ORDER BY p.spot) AS vector
  FROM documents d CROSS JOIN places p
    LEFT JOIN spots s ON s.doc_id = d.doc_id AND s.spot = p.spot
    LEFT JOIN sizes z ON z.doc_id = d.doc_id GROUP BY d.doc_id)
"""


def _texts(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


@query(
    "e1_encode_texts",
    V.with_ctes(SQL_HASHED)
    + f"""SELECT doc_id AS id, {sql_vector_text('CAST(vector AS FLOAT[])')} AS vector
    FROM hashed""",
)
def e1_encode_texts(spark, sf_dir):
    encoded = encode.encode_texts(_texts(spark, sf_dir), _hashing)
    return encoded.select("id", vector_text(F.col("vector")).alias("vector"))


@query(
    "e3_hashed_vectors",
    V.with_ctes(SQL_HASHED)
    + f"SELECT doc_id AS id, {sql_vector_text('vector')} AS vector FROM hashed",
)
def e3_hashed_vectors(spark, sf_dir):
    hashed = encode.hashed_vectors(_texts(spark, sf_dir), DIM)
    return hashed.select("id", vector_text(F.col("vector")).alias("vector"))


@query(
    "e2_pooled_vectors",
    f"""
    WITH words AS (
      SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \\t\\r\\n]+')) AS w
      FROM documents),
    tokens AS (
      SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT)
        % (SELECT count(*) FROM embeddings) AS token, count(*) AS n
      FROM words WHERE w <> '' GROUP BY ALL),
    states AS (
      SELECT t.doc_id, t.n, unnest(CAST(e.embedding AS DOUBLE[])) AS x,
        generate_subscripts(e.embedding, 1) AS pos
      FROM tokens t JOIN embeddings e ON t.token = e.vec_id),
    means AS (SELECT doc_id, pos, sum(n * x) / sum(n) AS x FROM states GROUP BY doc_id, pos),
    sizes AS (SELECT doc_id, sqrt(sum(x * x)) AS size FROM means GROUP BY doc_id),
    pooled AS (
      SELECT m.doc_id, list(x / size ORDER BY pos) AS vector
      FROM means m JOIN sizes s ON m.doc_id = s.doc_id GROUP BY m.doc_id)
    SELECT doc_id AS id, {sql_vector_text('vector')} AS vector FROM pooled""",
)
def e2_pooled_vectors(spark, sf_dir):
    states = V.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("int").alias("token"), F.col("embedding").alias("vector")
    )
    n = states.count()
    words = F.explode(F.split(F.lower("text"), r"[ \t\r\n]+")).alias("w")
    tokens = _texts(spark, sf_dir).select("id", words).filter(F.col("w") != "")
    tokens = tokens.select("id", encode.hash_bucket(F.col("w"), n).alias("token"))
    pooled = encode.pooled_vectors(tokens, states, DIM)
    return pooled.select("id", vector_text(F.col("vector")).alias("vector"))


@query(
    "e4_seeded_vectors",
    V.with_ctes(V.SQL_RAW)
    + f""", seeds AS (
      SELECT id, coalesce(name, '') || coalesce(type_line, '') AS seed FROM raw),
    drawn AS (
      SELECT id, flatten(list_transform(range(8), lambda b: list_transform(range(8), lambda i:
        CAST('0x' || substr(sha256(seed || ':' || b), i * 8 + 1, 8) AS BIGINT) / 2147483648.0::DOUBLE
        - 1))) AS v FROM seeds),
    sized AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM drawn)
    SELECT id, {sql_vector_text('list_transform(v, lambda y: y / n)')} AS vector FROM sized""",
)
def e4_seeded_vectors(spark, sf_dir):
    drawn = encode.seeded_vectors(V.raw_cards(spark, sf_dir), DIM)
    return drawn.select("id", vector_text(F.col("vector")).alias("vector"))


@query(
    "e6_t3_stale_inputs",
    V.with_ctes(V.SQL_RAW, SQL_TAGGED)
    + f"""SELECT t.id, sha256({embedding_sql(True, 2)}) AS text_hash FROM tagged t
    LEFT JOIN labels l ON t.id = CAST(l.doc_id AS VARCHAR)
    WHERE l.quality IS NULL OR l.quality = 0""",
)
def e6_t3_stale_inputs(spark, sf_dir):
    """Labelled records have a vector; those of quality 0 have one of other settings."""
    inputs = cut(encode.encoder_inputs(V.raw_cards(spark, sf_dir), CONFIG))
    labels = V.table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("id"), "quality"
    )
    model = F.when(F.col("quality") == 1, F.col("model")).otherwise("older")
    stored = inputs.join(labels, "id").withColumn("model", model)
    return encode.stale_inputs(inputs, stored).select("id", "text_hash")


def _table(spark) -> vector_table.VectorTable:
    return vector_table.VectorTable(spark, fresh_dir(spark, "vector-table"), VECTOR)


def _deliver(rows, path: str, least: int, files: int) -> None:
    """Append rows to a folder as ``least`` files, or as more by a hash of their ids."""
    spread = rows.coalesce(least) if files <= least else rows.repartition(files, "id")
    spread.write.mode("append").parquet(path)


def _ingested(spark, sf_dir) -> vector_table.VectorTable:
    raw, table = V.raw_cards(spark, sf_dir), _table(spark)
    source, files = fresh_dir(spark, "stream-source"), _files(spark, sf_dir, 4)
    raw.repartition(files, "id").write.parquet(source)
    stream = card_stream(spark, source, math.ceil(files / 4))
    checkpoint = fresh_dir(spark, "stream-checkpoint")
    run_ingest(stream, table, checkpoint, _hashing, CONFIG, total=raw.count())
    return table


@query(
    "t1_ingest_stream",
    V.with_ctes(V.SQL_RAW, SQL_TAGGED)
    + f"""SELECT id, sha256({embedding_sql(True, 2)}) AS text_hash, 'hashing-64' AS model,
      true AS include_name, 2 AS tags_weight, 64 AS dim FROM tagged""",
)
def t1_ingest_stream(spark, sf_dir):
    rows = _ingested(spark, sf_dir).read()
    stamp = ["text_hash", "model", "include_name", "tags_weight"]
    return rows.select("id", *stamp, F.size("vector").alias("dim"))


@query(
    "s9_manifest_latest",
    V.with_ctes(V.SQL_RAW)
    + """SELECT count(*) AS next_offset, count(*) AS total, 'hashing-64' AS model,
      true AS include_name, 'stream' AS kind FROM raw""",
)
def s9_manifest_latest(spark, sf_dir):
    steps = _ingested(spark, sf_dir).manifest()
    return steps.orderBy(F.desc("step")).limit(1).select(
        "next_offset", "total", "model", "include_name", "kind"
    )


SQL_STORED = V.with_ctes(V.SQL_RAW, SQL_TAGGED) + (
    f"SELECT id, sha256({embedding_sql(True, 2)}) AS text_hash FROM tagged"
)


@query("e5_reembed_all", SQL_STORED)
def e5_reembed_all(spark, sf_dir):
    """All records anew in the place of a table that has some of them with other settings."""
    raw, table = V.raw_cards(spark, sf_dir), _table(spark)
    older = encode.EncodeConfig(model="older", include_name=False, tags_weight=1)
    some = encode.encoder_inputs(raw.filter(F.col("id").endswith("7")), older)
    table.append(encode.embed(some, _hashing), 0)
    reembed_all(raw.unionByName(raw.filter(F.col("id").endswith("3"))), table, _hashing, CONFIG)
    return table.read().select("id", "text_hash")


@query(
    "t2_single_batch",
    V.with_ctes(V.SQL_RAW)
    + """SELECT 1::BIGINT AS steps, count(*) AS stored, 1::BIGINT AS steps_left,
      (SELECT count(*) FROM raw) AS stored_at_last FROM raw WHERE CAST(id AS BIGINT) % 2 = 0""",
)
def t2_single_batch(spark, sf_dir):
    """One step, and the rest by the next run: even ids are delivered first."""
    raw, table = V.raw_cards(spark, sf_dir), _table(spark)
    source, checkpoint = fresh_dir(spark, "in"), fresh_dir(spark, "stream-checkpoint")
    even = F.col("id").cast("bigint") % 2 == 0
    # Both deliveries have as many files, which are one step.
    sizes = raw.agg(F.count_if(even), F.count_if(~even)).head()
    files = max(1, math.ceil(min(sizes) / FILE_RECORDS))
    for rows in (raw.filter(even), raw.filter(~even)):
        _deliver(rows, source, 1, files)

    def go(most):
        return run_ingest(card_stream(spark, source, files), table, checkpoint, _hashing, CONFIG, most)

    steps, stored = go(1), table.read().count()
    left = go(None)
    facts = table.read().agg(F.count("*").alias("stored_at_last"))
    return facts.select(
        F.lit(steps).cast("bigint").alias("steps"),
        F.lit(stored).cast("bigint").alias("stored"),
        F.lit(left).cast("bigint").alias("steps_left"),
        "stored_at_last",
    )


@query("t4_repeat_delivery", SQL_STORED)
def t4_repeat_delivery(spark, sf_dir):
    """Records delivered again, by one run and by another with a checkpoint of its own."""
    raw, table = V.raw_cards(spark, sf_dir), _table(spark)
    older = raw.withColumn("name", F.concat("name", F.lit(" (older)")))
    source, checkpoint = fresh_dir(spark, "in"), fresh_dir(spark, "stream-checkpoint")
    files = _files(spark, sf_dir, 2)
    for rows in (older.filter(F.col("id").endswith("1")), raw):
        _deliver(rows, source, 2, files)
        run_ingest(card_stream(spark, source, files), table, checkpoint, _hashing, CONFIG)
        table.compact()
    again, few = fresh_dir(spark, "in"), math.ceil(files / 10)
    _deliver(raw.filter(F.col("id").endswith("5")), again, 1, few)
    run_ingest(card_stream(spark, again, few), table, fresh_dir(spark, "cp"), _hashing, CONFIG)
    return table.read().select("id", "text_hash")
