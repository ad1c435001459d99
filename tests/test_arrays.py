"""Arrays read by byte ranges, against the whole file read at once."""

import json
import random

import pytest
from likeness.sources import arrays
from likeness.sources.cards import read_cards

STRINGS = ['plain', '},{"id":1}', '\\', '\\\\"', 'a\\"b', '[{', ']', 'é😀', '', '\n\t{', '"' * 5, '\\' * 9, "{" * 30]


def values(n, seed):
    pick = random.Random(seed)
    return [
        {
            "id": str(i), "name": pick.choice(STRINGS) + pick.choice(STRINGS), pick.choice(STRINGS): [pick.choice(STRINGS)] * 2,
            "deep": {"a": [{"b": pick.choice(STRINGS)}, []]}, "cmc": pick.random(),
        }
        for i in range(n)
    ]


def read_by_ranges(path, size):
    """What the ranges give, without Spark."""
    whole = path.stat().st_size
    cuts = [(at, min(at + size, whole)) for at in range(0, whole, size)]
    found = [arrays.summary(str(path), start, end, whole) for start, end in cuts]
    random.Random(1).shuffle(found)
    return [[json.loads(r) for r in arrays.records(part)] for part in arrays.states(found)]


@pytest.mark.parametrize("indent,ascii", [(None, True), (2, False), (None, False), (0, True)])
def test_every_cut_gives_the_same_records(tmp_path, indent, ascii, monkeypatch):
    monkeypatch.setattr(arrays, "MORE_BYTES", 7)
    want = values(12, 3)
    path = tmp_path / "a.json"
    path.write_text(" \n" + json.dumps(want, indent=indent, ensure_ascii=ascii) + "\n")
    for size in [1, 2, 3, 5, 7, 11, 16, 31, 64, 100, 1000, 10**6]:
        parts = read_by_ranges(path, size)
        assert [r for part in parts for r in part] == want
    assert sum(bool(p) for p in read_by_ranges(path, 64)) > 5


def test_odd_files(tmp_path):
    path = tmp_path / "a.json"
    for text, want in [("[]", []), (" [ ] ", []), ('{"a": {}}', [{"a": {}}]), ("﻿[{}]", [{}]), ('[{"a":"]"}]', [{"a": "]"}])]:
        path.write_text(text)
        for size in (1, 2, 100):
            assert [r for part in read_by_ranges(path, size) for r in part] == want
    for text in ('[{"a": 1}', '[{"a": "1}]', "12", '"text"', '[{"a": "\\"}]'):
        path.write_text(text)
        for size in (1, 3, 100):
            with pytest.raises(ValueError):
                read_by_ranges(path, size)


def test_one_file_is_many_tasks_and_equals_spark(spark, tmp_path):
    cards = [
        {"id": str(i), "name": random.Random(i).choice(STRINGS), "oracle_text": "x" * (i % 50), "colors": ["U"] * (i % 3),
         "card_faces": [{"type_line": "}", "oracle_text": STRINGS[i % len(STRINGS)]}], "cmc": float(i % 7)}
        for i in range(3000)
    ]
    folder = tmp_path / "in put"
    folder.mkdir()
    (folder / "one.json").write_text(json.dumps(cards, indent=4, ensure_ascii=False))
    (folder / "two.json").write_text(json.dumps(cards[:3]))
    (folder / "none.json").write_text("")
    got = read_cards(spark, str(folder), "array_ranges", range_bytes=20_000)
    assert got.rdd.getNumPartitions() > 20
    whole = read_cards(spark, str(folder), "array")
    assert got.schema == whole.schema
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect()))
    (folder / "two.json").write_text(json.dumps(cards[:3])[:-4])
    with pytest.raises(Exception, match="ends within a record"):
        read_cards(spark, str(folder), "array_ranges")
    with pytest.raises(Exception):
        (folder / "two.json").write_text('[{"id": nonsense}]')
        read_cards(spark, str(folder), "array_ranges").collect()


def test_small_ranges_do_not_grow_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrays, "SMALL_RANGES", 20, raising=False)
    want = values(300, 8)
    for name in "ab":
        (tmp_path / f"{name}.json").write_text(json.dumps(want, indent=1))
    assert arrays.file_ranges(spark, str(tmp_path), 16).count() <= 20 + 2
    got = [json.loads(r["value"]) for r in arrays.array_records(spark, str(tmp_path), 16).collect()]
    assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, want * 2))
