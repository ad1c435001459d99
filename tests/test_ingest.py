from functools import partial

import numpy as np
import pytest
from likeness.operators import encode
from likeness.operators.encoders import HashingEncoder, PooledEncoder, masked_mean
from likeness.operators.flatten import embedding_texts, flatten_cards
from likeness.schema import CARD, RAW_CARD, VECTOR
from likeness.sources import batches
from likeness.sources.vector_table import VectorTable, keep_last, progress, upsert
from likeness.streaming.ingest import card_stream, reembed_all, run_ingest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

CONFIG = encode.EncodeConfig("hashing", include_name=True, tags_weight=2)
HASHING = partial(HashingEncoder, 32)


def raw_rows(spark, rows):
    """(id, name) or (id, name, text) as raw records."""
    data = [{"id": r[0], "name": r[1], "oracle_text": r[2] if len(r) > 2 else ""} for r in rows]
    return spark.createDataFrame(data, RAW_CARD)


def deliver(spark, path, rows):
    raw_rows(spark, rows).coalesce(1).write.mode("append").parquet(str(path))


def contents(table):
    return sorted((r["id"], r["text_hash"]) for r in table.read().collect())


def hashes(spark, rows):
    inputs = encode.encoder_inputs(raw_rows(spark, rows), CONFIG)
    return sorted((r["id"], r["text_hash"]) for r in inputs.collect())


@pytest.fixture
def table(spark, tmp_path):
    return VectorTable(spark, str(tmp_path / "vectors"), VECTOR)


def test_stream_equals_batch(spark, table, tmp_path):
    source = tmp_path / "in"
    rows = [(f"c{i}", f"Card {i}", f"word{i} flying") for i in range(30)]
    for part in range(3):
        deliver(spark, source, rows[part::3])
    steps = run_ingest(
        card_stream(spark, str(source)), table, str(tmp_path / "cp"), HASHING, CONFIG, total=30
    )
    assert steps == 3
    assert contents(table) == hashes(spark, rows)
    last = table.latest()
    assert (last["next_offset"], last["total"], last["model"]) == (30, 30, "hashing")
    batch = VectorTable(spark, str(tmp_path / "batch"), VECTOR)
    reembed_all(raw_rows(spark, rows), batch, HASHING, CONFIG)

    def as_map(t):
        return {r["id"]: r["vector"] for r in t.read().collect()}

    assert as_map(batch) == as_map(table)
    # Nothing new: no step. A repeated start changes nothing.
    again = run_ingest(
        card_stream(spark, str(source)), table, str(tmp_path / "cp"), HASHING, CONFIG
    )
    assert again == 0 and contents(table) == hashes(spark, rows)


def test_steps_can_be_limited_and_taken_up(spark, table, tmp_path):
    source = tmp_path / "in"
    rows = [(f"c{i}", f"Card {i}") for i in range(12)]
    for part in range(4):
        deliver(spark, source, rows[part::4])

    def go(max_steps):
        stream = card_stream(spark, str(source))
        return run_ingest(stream, table, str(tmp_path / "cp"), HASHING, CONFIG, max_steps)

    assert go(1) == 1 and table.read().count() == 3
    assert go(2) == 2 and table.read().count() == 9
    assert go(None) == 1
    assert contents(table) == hashes(spark, rows)


class Breaking:
    """Fails on one text as long as a file is there."""

    def __init__(self, flag):
        self.flag = flag

    def __call__(self, texts):
        import os

        if any("poison" in t for t in texts) and os.path.exists(self.flag):
            raise ValueError("the worker broke")
        return np.ones((len(texts), 4))


def test_resume_after_a_broken_step(spark, table, tmp_path):
    from pyspark import cloudpickle
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    source, flag = tmp_path / "in", tmp_path / "broken"
    flag.write_text("")
    rows = [("a", "one"), ("b", "two"), ("c", "poison"), ("d", "four")]
    for row in rows:
        deliver(spark, source, [row])
    factory = partial(Breaking, str(flag))

    def go():
        return run_ingest(card_stream(spark, str(source)), table, str(tmp_path / "cp"), factory, CONFIG)

    with pytest.raises(StreamingQueryException, match="the worker broke"):
        go()
    before = table.read().count()
    assert 0 < before < 4
    flag.unlink()
    go()
    assert contents(table) == hashes(spark, rows)
    assert table.latest()["next_offset"] == 4


def test_last_delivery_of_an_id_wins(spark, table, tmp_path):
    source = tmp_path / "in"
    deliver(spark, source, [("a", "old"), ("b", "first"), ("b", "second")])
    go = partial(run_ingest, table=table, checkpoint=str(tmp_path / "cp"), factory=HASHING, config=CONFIG)
    go(card_stream(spark, str(source)))
    assert contents(table) == hashes(spark, [("a", "old"), ("b", "second")])
    deliver(spark, source, [("a", "new")])
    go(card_stream(spark, str(source)))
    assert contents(table) == hashes(spark, [("a", "new"), ("b", "second")])
    table.compact()
    assert contents(table) == hashes(spark, [("a", "new"), ("b", "second")])
    deliver(spark, source, [("c", "third"), ("a", "newest")])
    go(card_stream(spark, str(source)), skip_current=True)
    assert contents(table) == hashes(spark, [("a", "newest"), ("b", "second"), ("c", "third")])
    table.wipe()
    assert table.read().count() == 0 and table.latest() is None


def embedded(spark, rows):
    return encode.embed(encode.encoder_inputs(raw_rows(spark, rows), CONFIG), HASHING)


def test_unrecorded_folders_are_not_read(spark, table):
    rows = embedded(spark, [("a", "x")])
    table.append(rows, 0, kind="batch")
    table.store(rows)
    assert table.read().count() == 1
    table.append(rows, 0, kind="batch")
    assert table.read().count() == 1 and table.manifest().count() == 2
    assert table.vacuum() == 1 and table.read().count() == 1


def test_compacting_twice_loses_nothing(spark, table):
    table.append(embedded(spark, [("a", "x"), ("b", "y")]), 0)
    for _ in range(3):
        table.compact()
        assert contents(table) == hashes(spark, [("a", "x"), ("b", "y")])
    assert table.vacuum() == 3
    assert contents(VectorTable(spark, table.path, VECTOR)) == hashes(spark, [("a", "x"), ("b", "y")])


def test_a_new_checkpoint_after_a_compaction(spark, table, tmp_path):
    first, second = tmp_path / "first", tmp_path / "second"
    deliver(spark, first, [("a", "x"), ("b", "y")])
    run_ingest(card_stream(spark, str(first)), table, str(tmp_path / "cp1"), HASHING, CONFIG)
    table.compact()
    deliver(spark, second, [("c", "z"), ("d", "w"), ("a", "new")])
    run_ingest(card_stream(spark, str(second)), table, str(tmp_path / "cp2"), HASHING, CONFIG)
    want = [("a", "new"), ("b", "y"), ("c", "z"), ("d", "w")]
    assert contents(table) == hashes(spark, want)


def test_an_emptied_checkpoint_takes_nothing_away(spark, table, tmp_path):
    import shutil

    source, other = tmp_path / "in", tmp_path / "other"
    deliver(spark, source, [("a", "x"), ("b", "y")])
    run_ingest(card_stream(spark, str(source)), table, str(tmp_path / "cp"), HASHING, CONFIG)
    shutil.rmtree(tmp_path / "cp")
    deliver(spark, other, [("c", "z")])
    run_ingest(card_stream(spark, str(other)), table, str(tmp_path / "cp"), HASHING, CONFIG)
    assert contents(table) == hashes(spark, [("a", "x"), ("b", "y"), ("c", "z")])


def test_a_stream_after_reembedding(spark, table, tmp_path):
    reembed_all(raw_rows(spark, [("a", "x"), ("b", "y"), ("c", "z"), ("a", "x")]), table, HASHING, CONFIG)
    assert table.read().count() == 3
    deliver(spark, tmp_path / "in", [("d", "new")])
    run_ingest(card_stream(spark, str(tmp_path / "in")), table, str(tmp_path / "cp"), HASHING, CONFIG)
    assert [r["id"] for r in table.read().orderBy("id").collect()] == ["a", "b", "c", "d"]


def test_a_failing_reembedding_leaves_the_table(spark, table, tmp_path):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    table.append(embedded(spark, [("a", "x"), ("b", "y")]), 0)
    flag = tmp_path / "broken"
    flag.write_text("")
    with pytest.raises(Exception, match="the worker broke"):
        reembed_all(raw_rows(spark, [("a", "poison")]), table, partial(Breaking, str(flag)), CONFIG)
    assert contents(table) == hashes(spark, [("a", "x"), ("b", "y")])


def test_stale_inputs(spark, table):
    rows = [("a", "x"), ("b", "y"), ("c", "z")]
    inputs = encode.encoder_inputs(raw_rows(spark, rows), CONFIG)
    table.append(encode.embed(inputs, HASHING), 0, kind="batch")
    changed = raw_rows(spark, [("a", "x"), ("b", "other"), ("c", "z"), ("d", "new")])

    def stale(config):
        found = encode.stale_inputs(encode.encoder_inputs(changed, config), table.read())
        return sorted(r["id"] for r in found.collect())

    assert stale(CONFIG) == ["b", "d"]
    assert stale(encode.EncodeConfig("other", True, 2)) == ["a", "b", "c", "d"]


def test_hashed_vectors_agree(spark):
    texts = ["red fox Red", "", "  \n ", "one", "Été déjà"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    jvm = {r["id"]: r["vector"] for r in encode.hashed_vectors(df, 32).collect()}
    python = {r["id"]: r["vector"] for r in encode.encode_texts(df, HASHING).collect()}
    assert sorted(jvm) == sorted(python) == list(range(5))
    for i in range(5):
        assert np.allclose(jvm[i], python[i], atol=1e-7)
    assert jvm[1] == [0.0] * 32 and np.isclose(np.linalg.norm(jvm[0]), 1)


def test_pooling():
    hidden = np.arange(12.0).reshape(2, 3, 2)
    mask = [[1, 1, 0], [0, 0, 0]]
    assert masked_mean(hidden, mask).tolist() == [[1.0, 2.0], [0.0, 0.0]]

    def states(ids, mask):
        return np.stack([ids, ids * 10], axis=2).astype(float)

    encoder = PooledEncoder(lambda t: [int(x) for x in t.split()], states, batch=2, max_tokens=3)
    got = encoder(["1 2 3 100", "5", ""])
    assert got.tolist() == [[2.0, 20.0], [5.0, 50.0], [0.0, 0.0]]


def test_upsert(spark):
    current = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    news = spark.createDataFrame(
        [(2, "x", 1), (2, "y", 3), (2, "z", 2), (3, "n", 1)], "id int, v string, seq int"
    )
    assert sorted(map(tuple, upsert(current, news, "id", "seq").collect())) == [
        (1, "a"), (2, "y"), (3, "n"),
    ]
    assert keep_last(news, "id", "seq").count() == 2


def test_progress(spark):
    cards = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert tuple(progress(cards, cards.limit(1)).head()) == (1, 3, pytest.approx(100 / 3))
    assert tuple(progress(cards.limit(0), cards).head()) == (0, 0, 0.0)


def test_batch_files(spark, tmp_path):
    raw = raw_rows(spark, [(f"c{i}", f"Card {i}") for i in range(25)])
    flat = flatten_cards(raw)
    vectors = encode.encode_texts(embedding_texts(raw), HASHING).select("id", "vector")
    objects = batches.batch_objects(flat, vectors)
    path = str(tmp_path / "batches")
    batches.write_batches(objects, path, batch_size=10)
    lines = [r[0] for r in spark.read.text(path).collect()]
    assert len(lines) == 3
    assert all('"cmc"' not in line and line.startswith('{"objects":[{"class"') for line in lines)
    assert batches.count_objects(spark, path) == 25
    back = batches.read_batches(spark, path)
    assert back.schema["properties"].dataType == CARD
    want = {r["id"]: r["vector"] for r in vectors.collect()}
    got = {r["id"]: r["vector"] for r in back.collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))
    first = back.filter(F.col("id") == "c0").head()["properties"]
    assert first["name"] == "Card 0" and first["cmc"] is None and first["colors"] == []


@pytest.mark.parametrize("name", ["t1_ingest_stream", "s9_manifest_latest", "t2_single_batch", "t4_repeat_delivery", "s1_read_arrays"])
def test_queries_write_files_of_bounded_size(spark, name, monkeypatch):
    """One task writes a file, and one step or task reads it; the results stay the same."""
    from likeness.plans import ingest_plans
    from likeness.plans.registry import QUERIES

    folder, written = "/root/testdata/sf0.001", []

    def noted(*args, f=ingest_plans.fresh_dir):
        written.append(f(*args))
        return written[-1]

    want = sorted(map(str, QUERIES[name](spark, folder).collect()))
    monkeypatch.setattr(ingest_plans, "fresh_dir", noted)
    monkeypatch.setattr(ingest_plans, "FILE_RECORDS", 25, raising=False)
    assert sorted(map(str, QUERIES[name](spark, folder).collect())) == want
    source = next(p for p in written if any(x in p for x in ("/in-", "/stream-source-", "/cards-array-")))
    rows = spark.read.text(source) if "cards-array" in source else spark.read.parquet(source)
    sizes = rows.groupBy(F.input_file_name()).count().agg(F.max("count")).head()[0]
    assert sizes <= 4 * 25
