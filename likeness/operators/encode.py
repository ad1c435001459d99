"""Embedding jobs: texts to stamped vector rows, and which rows need one."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness.functions.vectors import l2_normalize, seeded_vector
from likeness.operators import encoders
from likeness.operators.centroid import centroids
from likeness.operators.flatten import drop_without_id, embedding_texts
from likeness.operators.resolve import in_tasks
from likeness.session import cut

# What the token vectors that every executor holds at a time may weigh.
HELD_BYTES = 256 * 1024 * 1024
STAMP = ["model", "include_name", "tags_weight", "text_hash"]


@dataclass(frozen=True)
class EncodeConfig:
    """What a vector depends on besides its text. Weight 2 is the documented setting."""

    model: str
    include_name: bool = False
    tags_weight: int = 2

    def stamp(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                "model": F.lit(self.model),
                "include_name": F.lit(self.include_name),
                "tags_weight": F.lit(self.tags_weight),
                "text_hash": F.sha2(F.col("text"), 256),
            }
        )


def encode_texts(
    df: DataFrame,
    factory: Callable[[], Callable],
    text: str = "text",
    batch_size: int = encoders.MODEL_BATCH,
) -> DataFrame:
    """Adds ``vector``, of unit length. ``factory`` is called once per task and returns
    the encoder: a callable from a list of texts to a matrix."""
    kept = [f for f in df.schema.fields if f.name != "vector"]
    vector = T.StructField("vector", T.ArrayType(T.FloatType()))
    schema = T.StructType([*kept, vector])
    work = encoders.encode_batches(factory, text, schema.fieldNames(), batch_size)
    return df.mapInArrow(work, schema)


def encoder_inputs(raw: DataFrame, config: EncodeConfig) -> DataFrame:
    """(id, text, and the stamp) for every record with an id."""
    return config.stamp(embedding_texts(raw, config.include_name, config.tags_weight))


def embed(inputs: DataFrame, factory: Callable[[], Callable]) -> DataFrame:
    """(id, vector, stamp) rows of the vector table."""
    return encode_texts(inputs, factory).select("id", "vector", *STAMP)


def stale_inputs(inputs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Inputs without a vector of the same text and settings: what a resumed run has to
    do. Only ids and stamps are compared; the texts of few stale rows do not move."""
    have = vectors.select("id", F.struct(*STAMP).alias("have"))
    want = inputs.select("id", F.struct(*STAMP).alias("want"))
    # Compared behind the join: as a join key the hash would be computed twice.
    stale = want.join(have, "id", "left").filter(~F.col("have").eqNullSafe(F.col("want")))
    return inputs.join(stale.select("id"), "id", "left_semi")


def seeded_vectors(raw: DataFrame, dim: int = 768) -> DataFrame:
    """(id, vector) that depend on name and type line alone, for tests of the plumbing."""
    seed = F.concat(F.coalesce("name", F.lit("")), F.coalesce("type_line", F.lit("")))
    return drop_without_id(raw).select("id", seeded_vector(seed, dim).alias("vector"))


def hash_bucket(word: Column, dim: int) -> Column:
    head = F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(dim)).cast("int")


def hashed_vectors(df: DataFrame, dim: int = 768) -> DataFrame:
    """(id, vector): unit vectors of hashed word counts from (id, text); zero without words.

    The same vectors as ``HashingEncoder``, without leaving the JVM. Words are counted
    per text before the shuffle, and a text has at most ``dim`` counts.
    """
    words = df.select("id", F.explode_outer(F.split(F.lower("text"), encoders.WORD_BREAK)).alias("w"))
    spot = F.when(F.col("w") != "", hash_bucket(F.col("w"), dim))
    counts = words.select("id", spot.alias("spot")).groupBy("id", "spot").agg(F.count("spot").alias("n"))
    filled = F.when(F.col("spot").isNotNull(), F.struct("spot", "n"))
    # collect_list leaves out the NULL entry of a text without words.
    lists = counts.groupBy("id").agg(F.sort_array(F.collect_list(filled)).alias("pairs"))
    # The zeros between one count and the next, then the count: each pair is met once.
    spots = F.concat(F.array(F.lit(-1)), F.transform("pairs", lambda p: p["spot"]))
    lists = lists.withColumn("spots", spots)
    zero = F.lit(0.0)
    runs = F.zip_with(
        "pairs",
        F.slice("spots", F.lit(1), F.size("pairs")),
        lambda p, before: F.concat(
            F.array_repeat(zero, p["spot"] - before - 1), F.array(p["n"].cast("double"))
        ),
    )
    tail = F.array_repeat(zero, F.lit(dim - 1) - F.element_at("spots", -1))
    dense = F.concat(F.flatten(runs), tail)
    return lists.select("id", dense.alias("dense")).select(
        "id", l2_normalize(F.col("dense")).alias("vector")
    )


def pooled_vectors(tokens: DataFrame, token_vectors: DataFrame, dim: int) -> DataFrame:
    """(id, vector): mean of the token vectors of each text, at unit length.

    ``tokens`` has (id, token), ``token_vectors`` (token, vector). Tokens are dealt out by text,
    once; a token that comes again is counted before the join. The vectors go to the tokens, in
    blocks of HELD_BYTES at most, as the sums of a text weigh far more than its tokens: with one
    block they are never shuffled, else once for each text and block."""
    dealt = in_tasks(tokens.select("id", "token"), "id")
    counted = dealt.groupBy("id", "token").agg(F.count("*").alias("n"))
    blocks = max(1, math.ceil(token_vectors.count() * (8 * dim + 64) / HELD_BYTES))
    if blocks == 1:
        joined = counted.join(F.broadcast(token_vectors), "token")
        return centroids(joined, "id", dim, F.col("n"))
    counted, block = cut(counted), F.pmod(F.xxhash64("token"), F.lit(blocks))
    parts = [
        counted.filter(block == b).join(F.broadcast(token_vectors.filter(block == b)), "token")
        for b in range(blocks)
    ]
    return centroids(reduce(DataFrame.unionByName, parts), "id", dim, F.col("n"))
