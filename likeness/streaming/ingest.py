"""The continuous embedding run as a file stream: embed a batch, ingest it, go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.operators.encode import EncodeConfig, embed, encoder_inputs, stale_inputs
from likeness.schema import RAW_CARD
from likeness.sources.vector_table import VectorTable, keep_last

KIND = "stream"
STEPS_DONE = "the steps asked for are done"


def card_stream(spark: SparkSession, path: str, files_per_step: int = 1) -> DataFrame:
    """Raw records from a folder of Parquet files, new files step by step.

    ``arrival`` orders records as they were delivered: by file, then by row.
    """
    reader = spark.readStream.schema(RAW_CARD).option("maxFilesPerTrigger", files_per_step)
    facts = ["file_modification_time", "file_path", "row_index"]
    arrival = F.struct(*[F.col(f"_metadata.{name}") for name in facts])
    return reader.parquet(path).select("*", arrival.alias("arrival"))


def run_ingest(
    stream: DataFrame,
    table: VectorTable,
    checkpoint: str,
    factory: Callable[[], Callable],
    config: EncodeConfig,
    max_steps: int | None = None,
    total: int | None = None,
    skip_current: bool = False,
) -> int:
    """Work through what the source holds now and stop; returns the steps done.

    Starting again goes on behind the last finished step. A step that was cut off runs
    again under its number and replaces itself, so nothing is doubled. With a new or
    emptied ``checkpoint`` the source is worked through again as another run: its steps
    bring rows up to date and take none away. ``max_steps``
    ends the run after that many steps; the next run takes up the rest. Of several
    records with one id in a step the last to arrive counts. With
    ``skip_current`` records whose vector is up to date are not encoded again.
    """
    steps = 0

    def step(raw: DataFrame, batch_id: int) -> None:
        nonlocal steps
        if max_steps is not None and steps >= max_steps:
            raise RuntimeError(STEPS_DONE)
        if "arrival" in raw.columns:
            raw = keep_last(raw, "id", "arrival").drop("arrival")
        inputs = encoder_inputs(raw, config)
        if skip_current:
            inputs = stale_inputs(inputs, table.read())
        table.append(
            embed(inputs, factory),
            batch_id,
            run=checkpoint_id(raw.sparkSession, checkpoint),
            total=total,
            model=config.model,
            include_name=config.include_name,
            kind=KIND,
        )
        steps += 1

    query = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    except StreamingQueryException as stopped:
        if STEPS_DONE not in str(stopped):
            raise
    return steps


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark gives a checkpoint when it is new; it tells its steps from others'."""
    return spark.read.json(f"{checkpoint}/metadata").head()["id"]


def reembed_all(
    raw: DataFrame, table: VectorTable, factory: Callable[[], Callable], config: EncodeConfig
) -> int:
    """Encode every record again and put the result in the table's place.

    The table stays as it is until the new rows are stored. Of several records with one id
    the one with the largest hash of its fields counts.
    """
    content = raw.withColumn("content", F.xxhash64(F.to_json(F.struct("*"))))
    inputs = encoder_inputs(keep_last(content, "id", "content").drop("content"), config)
    return table.replace(
        embed(inputs, factory), model=config.model, include_name=config.include_name
    )
