"""The vector table on plain Parquet, kept current by idempotent batches.

Every write goes to a folder of its own below ``data``, and is then recorded by a row of
its own below ``manifest``; nothing that was recorded is written again. A step belongs to
a run (one stream checkpoint, say) and has a batch number there. Of the rows for one batch
of a run the newest counts, so a repeated delivery replaces itself; a ``snapshot`` row
stands for all rows before it. Half-written folders are in no row and never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness.schema import MANIFEST
from likeness.session import delete_path, path_exists

SNAPSHOT = "snapshot"
# The column of stored rows that names the step which stored them.
STEP = "stored_step"


def keep_last(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that comes last. Copies of a key shrink to one per map task."""
    fields = [c for c in rows.columns if c != key]
    last = F.max_by(F.struct(*fields), F.struct(*order)).alias("last")
    return rows.groupBy(key).agg(last).select(key, "last.*")


def upsert(current: DataFrame, incoming: DataFrame, key: str, *order: str) -> DataFrame:
    """``incoming`` replaces the rows of ``current`` with the same key, last one wins.

    ``current`` has one row per key and is only filtered: few new keys are a broadcast.
    """
    latest = keep_last(incoming, key, *order).drop(*[c for c in order if c not in current.columns])
    kept = current.join(incoming.select(key).distinct(), key, "left_anti")
    return kept.unionByName(latest.select(*current.columns))


class VectorTable:
    """One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema
        self.known: list[Row] | None = None

    def manifest(self) -> DataFrame:
        """All that was recorded, in the order of ``step``; nothing for a new table."""
        if not path_exists(self.spark, f"{self.path}/manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        reader = self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true")
        return reader.parquet(f"{self.path}/manifest")

    def entries(self) -> list[Row]:
        """The manifest, a row for each step ever done; read once by the writer."""
        if self.known is None:
            self.known = sorted(self.manifest().collect(), key=lambda row: row["step"])
        return self.known

    def live(self) -> tuple[Row | None, list[Row]]:
        """The last snapshot, and the newest row of each batch recorded after it."""
        entries = self.entries()
        snapshot = max((e for e in entries if e["kind"] == SNAPSHOT), key=_step, default=None)
        since = -1 if snapshot is None else snapshot["step"]
        newest = {
            (e["run"], e["batch_id"]): e
            for e in entries
            if e["kind"] != SNAPSHOT and e["step"] > since
        }
        return snapshot, sorted(newest.values(), key=_step)

    def latest(self) -> Row | None:
        """The last finished step that stored rows."""
        return max((e for e in self.entries() if e["kind"] != SNAPSHOT), key=_step, default=None)

    def store(self, rows: DataFrame) -> tuple[int, str]:
        """Write rows to a new folder, with the number of the step that will record them."""
        step = max(map(_step, self.entries()), default=-1) + 1
        folder = f"{self.path}/data/{step}-{uuid.uuid4().hex}"
        columns = self.schema.fieldNames()
        rows.select(*columns, F.lit(step).cast("long").alias(STEP)).write.parquet(folder)
        return step, folder

    def record(self, step: int, folder: str, **facts) -> None:
        row = {name: facts.get(name) for name in MANIFEST.fieldNames()}
        row |= {"step": step, "last_batch_out": folder}
        one = self.spark.createDataFrame([row], MANIFEST)
        one.coalesce(1).write.parquet(f"{self.path}/manifest/{step}-{uuid.uuid4().hex}")
        self.known = [*self.entries(), Row(**row)]

    def append(self, rows: DataFrame, batch_id: int, run: str = "batch", **facts) -> int:
        """Store one batch of a run and record it; doing it again replaces it. Returns its
        size. ``next_offset`` counts the rows of the run up to and with this batch."""
        step, folder = self.store(rows)
        count = self.spark.read.schema(self.schema).parquet(folder).count()
        earlier = [e for e in self.entries() if e["run"] == run and e["batch_id"] is not None]
        before = {e["batch_id"]: e["next_offset"] for e in earlier if e["batch_id"] < batch_id}
        done = before[max(before)] if before else 0
        self.record(step, folder, run=run, batch_id=batch_id, next_offset=done + count, **facts)
        return count

    def replace(self, rows: DataFrame, **facts) -> int:
        """Put rows, one for each id, in the place of all there are. Until they are written
        and recorded the table stays as it was."""
        step, folder = self.store(rows)
        count = self.spark.read.schema(self.schema).parquet(folder).count()
        self.record(step, folder, **facts | {"next_offset": count, "kind": SNAPSHOT})
        return count

    def read(self) -> DataFrame:
        """One row per id, from the newest batch that has it."""
        self.known = None
        snapshot, steps = self.live()
        base = self.spark.createDataFrame([], self.schema)
        if snapshot is not None:
            base = self.spark.read.schema(self.schema).parquet(snapshot["last_batch_out"])
        if not steps:
            return base
        with_step = T.StructType([*self.schema.fields, T.StructField(STEP, T.LongType())])
        folders = [e["last_batch_out"] for e in steps]
        deltas = self.spark.read.schema(with_step).parquet(*folders)
        if snapshot is None:
            return keep_last(deltas, "id", STEP).select(*self.schema.fieldNames())
        return upsert(base, deltas, "id", STEP)

    def compact(self) -> None:
        """Fold the batches so far into a snapshot; their folders stay until ``vacuum``."""
        last = self.latest()
        if last is not None:
            step, folder = self.store(self.read())
            self.record(step, folder, kind=SNAPSHOT, next_offset=last["next_offset"])

    def vacuum(self) -> int:
        """Delete the folders of batches that a snapshot or a repeat has replaced; the
        manifest stays. Returns how many. No reader may still be at work on them."""
        snapshot, steps = self.live()
        kept = {e["last_batch_out"] for e in [snapshot, *steps] if e is not None}
        old = {e["last_batch_out"] for e in self.entries()} - kept
        return sum(delete_path(self.spark, folder) for folder in sorted(old))

    def wipe(self) -> None:
        """Forget vectors, batches and progress."""
        delete_path(self.spark, self.path)
        self.known = None


def _step(entry: Row) -> int:
    return entry["step"]


def progress(cards: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row (done, total, percent): cards with a vector; 0 percent of nothing."""
    done = cards.select("id").join(vectors.select("id"), "id", "left_semi")
    counts = cards.select("id", F.lit(0).alias("done")).unionByName(
        done.select("id", F.lit(1).alias("done"))
    )
    total = F.count_if(F.col("done") == 0)
    return counts.agg(F.sum("done").alias("done"), total.alias("total")).select(
        F.coalesce("done", F.lit(0)).alias("done"),
        "total",
        F.when(F.col("total") > 0, 100.0 * F.col("done") / F.col("total"))
        .otherwise(F.lit(0.0))
        .alias("percent"),
    )
