"""Token files and packing: round trips, brute force and edge cases."""

import random

import brute
import numpy as np
import pytest

from likeness.llm import bitplanes, packing, queries
from likeness.llm.tokens import Encoder

SF = "/root/testdata/sf0.01"
ODD = [
    "",
    None,
    "  a",
    "a  b",
    " a\n",
    "\na",
    "it's  a's don't.Stop,it's!",
    "$$$, x!! 's 'S",
    "áb ć ²x .,!a !!b ª º µ ×",
    "ÀÉ'll 12,3.4 5",
    "<|endoftext|> a <|startoftext|>",
    "a.b\n.c\n!d",
    "x y z\x1cw",
    "İıſ Σς a. ̀b à",
    "日本語 テキスト 😀😀",
    "ends. ",
    "word " * 5000 + "x" * 3000,
]


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_remembered_words_give_the_same_ids(vocabulary, spark):
    encoder = Encoder(vocabulary)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(400).collect()]
    pick = random.Random(3)
    alphabet = ["a", "B", "é", " ", "\n", ".", ",", "!", "'", "s", "1", "$", "́", "ß", "\t", "l"]
    texts += ["".join(pick.choices(alphabet, k=pick.randrange(30))) for _ in range(3000)]
    for text in ODD + texts + ODD:
        got = np.frombuffer(encoder.ids(text), "<u4").tolist()
        assert [*got, 0] == brute.ids_of(vocabulary, text, 0), text


def test_memory_is_bounded(monkeypatch):
    from likeness.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    encoder = Encoder("word_bpe_49k.json")
    words = [f"w{c}{d}" for c in "abcdefgh" for d in "abcdefgh"]
    for _ in range(3):
        text = " ".join(words)
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == brute.ids_of("word_bpe_49k.json", text, 0)[:-1]
    encoder.ids("x" * 5000 + " " + "y," * 300)
    assert all(len(w) <= 64 for w in encoder.spaced)
    assert len(encoder.spaced) <= 10 and len(encoder.spaced.older) <= 10


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("block", [7, 64, 1 << 16])
def test_file_round_trip(bits, block):
    pick = random.Random(4)
    texts = [np.array([pick.randrange(2**32) if k % 3 else pick.randrange(50_000) for k in range(n)], "<u4") for n in (0, 1, 6, 7, 8, 300)]
    names = [5, None, -3, 2**60, 0, 9]
    body = bitplanes.file_body(names, [t.tobytes() for t in texts], bits, block)
    got_names, lengths, ids = bitplanes.read_body(body)
    assert got_names == names and lengths.tolist() == [len(t) for t in texts]
    assert ids.tolist() == np.concatenate(texts).tolist()
    assert bitplanes.read_body(bitplanes.file_body([], [], bits, block))[2].tolist() == []


def check_files(got, docs):
    """docs: (doc_id, text) in any order."""
    at, want = 0, []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = brute.ids_of("byte_bpe_50k.json", text, 2)
        want.append((doc_id, at, len(ids), brute.crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_token_files_are_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(300)
    odd = spark.createDataFrame(
        [*((10_000 - i, t) for i, t in enumerate(ODD)), (None, "none")], docs.schema
    )
    docs = docs.union(odd)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_bit_planes(spark, str(tmp_path)).collect()
    check_files(got, [tuple(r) for r in docs.collect()])


def test_token_files_with_repeats_and_without_rows(spark, tmp_path):
    rows = [(1, "same", "x")] * 3 + [(1, "other", "x"), (0, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    bitplanes.write_planes(docs, f"{tmp_path}/a", "byte_bpe_50k.json", 2, bits=1, block=3)
    got = bitplanes.read_planes(spark, f"{tmp_path}/a").orderBy("start").collect()
    assert [r.doc_id for r in got] == [0, 1, 1, 1, 1]
    starts = np.cumsum([0] + [r.n_tokens for r in got])
    assert [r.start for r in got] == starts[:-1].tolist()
    texts = sorted(np.frombuffer(r.ids, "<u4").tolist() for r in got)
    assert texts == sorted(brute.ids_of("byte_bpe_50k.json", t, 2) for _, t, _ in rows)
    bitplanes.write_planes(docs.limit(0), f"{tmp_path}/b", "byte_bpe_50k.json", 2)
    assert bitplanes.read_planes(spark, f"{tmp_path}/b").count() == 0


def check_places(rows, capacity):
    """Rows (sequence_id, offset, length): no gaps, no overlap, no overflow."""
    by = {}
    for sequence, offset, length in rows:
        by.setdefault(sequence, []).append((offset, length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_is_gapless_and_near_the_bound(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, "a " * 5000), (None, "b")], docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_best_fit_packing(spark, str(tmp_path)).collect()
    want = []
    for doc_id, text in docs.collect():
        ids = brute.ids_of("word_bpe_49k.json", text, 0)
        for piece, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want.append((doc_id, piece, at, len(own), brute.crc(own)))
    keys = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr)
    assert keys == sorted(want, key=repr)
    used = check_places([(r.sequence_id, r.offset, r.length) for r in got], 2048)
    bound = -(-sum(w[3] for w in want) // 2048)
    assert used <= bound * 1.01 + 1


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_every_piece(seed):
    pick = random.Random(seed)
    capacity = pick.choice([10, 64, 300])
    lengths = [min(capacity, int(pick.lognormvariate(2 + seed / 3, 1)) + 1) for _ in range(pick.choice([1, 50, 5000]))]
    counts = np.bincount(lengths, minlength=capacity + 1)
    planned = packing.plan(counts, capacity, rounds=40)
    held = np.zeros(capacity + 1, int)
    for contents, times in planned:
        assert sum(s * a for s, a in contents.items()) <= capacity
        for s, a in contents.items():
            held[s] += a * times
    assert held.tolist() == counts.tolist()
    size = np.repeat(np.arange(capacity + 1), counts)
    number = np.concatenate([np.arange(n) for n in counts])
    sequence, offset = packing.place(size, number, packing.places(planned))
    used = check_places(zip(sequence.tolist(), offset.tolist(), size.tolist()), capacity)
    halves = sum(s > capacity // 2 for s in lengths)
    assert used <= max(halves, -(-sum(lengths) // capacity)) * 11 // 9 + 1


def test_the_dearest_configuration():
    pick = random.Random(7)
    for _ in range(20):
        prices = np.zeros(31)
        for s in pick.sample(range(1, 31), 6):
            prices[s] = pick.random() * s
        found = packing.dearest(prices, 30)
        best = [0.0] * 31
        for c in range(1, 31):
            best[c] = max([best[c - 1], *(best[c - s] + prices[s] for s in range(1, c + 1))])
        assert sum(s * a for s, a in found.items()) <= 30
        assert sum(prices[s] * a for s, a in found.items()) == pytest.approx(best[30])


def test_packing_edges(spark):
    pieces = spark.createDataFrame([(1, 5, "x")] * 7 + [(2, 8, None)], "id long, length int, Part string")
    got = packing.pack(pieces, capacity=10)
    assert got.columns == ["id", "length", "Part", "sequence_id", "offset"]
    rows = got.collect()
    assert check_places([(r.sequence_id, r.offset, r.length) for r in rows], 10) == 5
    assert packing.pack(pieces.limit(0), capacity=10).count() == 0
    for bad in (0, 11, None):
        with pytest.raises(Exception, match="a piece of length"):
            packing.pack(spark.createDataFrame([(bad,)], "length int"), capacity=10).collect()
    with_ids = packing.token_pieces(
        spark.createDataFrame([(1, "a b c")], "doc_id long, text string"),
        "word_bpe_49k.json", 0, capacity=2, keep_ids=True,
    ).collect()
    ids = b"".join(r.ids for r in with_ids)
    assert np.frombuffer(ids, "<u4").tolist() == brute.ids_of("word_bpe_49k.json", "a b c", 0)
