"""The pipeline against brute force, stage by stage."""

import hashlib
import random

import brute
import corpus_pipeline
import pytest

from likeness.llm import mixing, quality

SF = "/root/testdata/sf0.01"


def shown(text, found):
    """The text with secrets replaced, overlapping ones as one."""
    out, at = "", 0
    for start, _, end, kind in found:
        if start >= at:
            out += text[at:start] + f"[{kind}]"
        at = max(at, end)
    return out + text[at:]


def chances(docs):
    import re

    def topic(text):
        for name, regex in mixing.TOPICS:
            if re.search(regex, text):
                return name
        return "prose"

    cells, of = {}, {}
    for d in docs:
        of[d["doc_id"]] = cell = (d["source"], d["lang"], topic(d["text"]))
        cells[cell] = cells.get(cell, 0) + max(1, -(-len(d["text"].encode()) // 4))
    targets = []
    for m, power in enumerate(mixing.TEMPERS.values()):
        held = {}
        for c, n in cells.items():
            held[c[m]] = held.get(c[m], 0) + n
        targets.append({v: n**power / sum(n**power for n in held.values()) for v, n in held.items()})
    weights = brute.raked(cells, targets, mixing.SWEEPS)
    found = brute.clipped(cells, weights, mixing.KEEP)
    return {d: found[c] for d, c in of.items()}


def test_every_stage_is_brute_force(spark):
    import zstandard

    compress = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    bands = (quality.TEXT_BANDS, quality.CHUNK_BAND, quality.CHUNK_SHARE)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs
    now = [r.asDict() for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "SimHash near-dedup", "secret scans",
        "mixing sources to target weights", "best-fit packing",
    ]

    def step(name, want):
        nonlocal rows, now
        rows = corpus_pipeline.cut(stages[name](spark, rows, SF))
        now = want
        assert rows.columns == docs.columns
        got = sorted((r.asDict() for r in rows.collect()), key=lambda d: d["doc_id"])
        assert got == sorted(want, key=lambda d: d["doc_id"]) and got

    step("quality rules", [d for d in now if quality.measured(d["text"], compress, *bands)[6]])
    groups = brute.simhash_rows([(d["doc_id"], d["text"]) for d in now])
    one = {d for d, _, c in groups if d == c}
    step("SimHash near-dedup", [d for d in now if d["doc_id"] in one])
    hidden = []
    for d in now:
        found = brute.secrets(d["text"])
        text = shown(d["text"], found)
        hidden.append(d | {"text": text, "n_chars": len(text) if found else d["n_chars"]})
    assert any("[assign]" in d["text"] for d in hidden)
    step("secret scans", hidden)
    chance = chances(now)
    kept = [
        d for d in now
        if int(hashlib.md5(f"17:{d['doc_id']}".encode()).hexdigest()[:8], 16) / 2**32 < chance[d["doc_id"]]
    ]
    step("mixing sources to target weights", kept)
    pieces = stages["best-fit packing"](spark, rows, SF).collect()
    want = {}
    for d in now:
        ids = brute.ids_of("word_bpe_49k.json", d["text"], 0)
        for piece, at in enumerate(range(0, len(ids), 2048)):
            want[d["doc_id"], piece] = (at, brute.crc(ids[at : at + 2048]))
    assert {(r.doc_id, r.piece): (r.start, r.ids_crc32) for r in pieces} == want
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted(
        (*k, c) for k, (_, c) in want.items()
    )


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_tables(spark, name, stage):
    """Nulls, no rows, columns whose names the operators use themselves."""
    pick = random.Random(1)
    parts = "an er th on re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar".split()
    long = " ".join("".join(pick.choices(parts, k=pick.randrange(1, 5))) for _ in range(300))
    rows = [
        (None, None, None, None, None, None, 1),
        (1, long, "en", "s", 1, "x", 2),
        (1, long, "en", "s", 1, "x", 2),
        (2, "", None, "s", None, "x", 3),
        (3, long + " password: hunter2hunter2", "de", None, 5, None, 4),
    ]
    docs = spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, "
        "quality string, rank int",
    )
    got = stage(spark, docs, SF)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == docs.columns
    assert got.count() >= 1
    assert stage(spark, docs.limit(0), SF).count() == 0
