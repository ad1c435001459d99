"""Best-fit packing by a configuration linear program over the length histogram.

Only the histogram (at most one count per length up to the capacity) reaches the driver.
A configuration is a set of lengths that fit one sequence. The program, to cover all
counts with the least number of configurations, is solved by multiplicative weights: a
length's price falls as it is covered, and a knapsack dynamic program finds the dearest
configuration at the current prices. The solution is rounded down, and what it leaves is
placed by best fit, longest first, a whole class of equal lengths at a time. The result is
a table of places per length; each piece finds its place by its number among the pieces
of its length.
"""

from __future__ import annotations

import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from likeness.llm.common import key, spare
from likeness.llm.tokens import encoder
from likeness.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048
ROUNDS = 250
# How fast a length's price falls as it is covered.
STEEPNESS = 4.0
TILT = 0.05
# Shares of the fractional solution that are tried when it is rounded.
SHARES = (1.0, 0.8, 0.6, 0.4, 0.2)


def dearest(prices: np.ndarray, capacity: int) -> Counter:
    """The configuration with the largest sum of prices: the knapsack program over all
    capacities. ``prices[s]`` is the price of one piece of length s, 0 where there is none."""
    sizes = np.flatnonzero(prices)
    worth = prices[sizes]
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    usable = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c], last[c] = best[c - 1], 0
        if n := usable[c]:
            values = best[c - sizes[:n]] + worth[:n]
            k = int(values.argmax())
            if values[k] > best[c]:
                best[c], last[c] = values[k], sizes[k]
    found, c = Counter(), capacity
    while c > 0:
        if last[c]:
            found[int(last[c])] += 1
            c -= last[c]
        else:
            c -= 1
    return found


def linear_program(counts: np.ndarray, capacity: int, rounds: int) -> list[tuple[dict, float]]:
    """Configurations and how often to use each, fractionally."""
    sizes = np.flatnonzero(counts)
    worth = np.zeros(capacity + 1)
    covered = np.zeros(capacity + 1)
    used: dict[tuple, float] = defaultdict(float)
    for _ in range(rounds):
        # Long pieces fit fewest configurations, so of equal sums theirs is the dearest.
        worth[sizes] = sizes * (1 + TILT * sizes / capacity) * np.exp(-STEEPNESS * covered[sizes])
        chosen = dearest(worth, capacity)
        # One step covers its scarcest length by an eighth at most.
        step = min(counts[s] / a for s, a in chosen.items()) / 8
        used[tuple(sorted(chosen.items()))] += step
        for s, a in chosen.items():
            covered[s] += step * a / counts[s]
    volume = float((counts * np.arange(capacity + 1)).sum())
    reached = sum(x * sum(s * a for s, a in c) for c, x in used.items())
    return [(dict(c), x * volume / reached) for c, x in used.items()]


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Counter, int]]:
    """Best fit, longest first, for classes of equal pieces and of equal sequences."""
    by_room: dict[int, list] = defaultdict(list)  # room left: [(times, contents)]
    rooms: list[int] = []  # sorted, those with sequences
    from bisect import bisect_left, insort

    def add(room, times, contents):
        if not by_room[room]:
            insort(rooms, room)
        by_room[room].append((times, contents))

    for s in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[s])
        while left:
            k = bisect_left(rooms, s)
            if k == len(rooms):
                whole, rest = divmod(left, capacity // s)
                if whole:
                    add(capacity - s * (capacity // s), whole, ((s, capacity // s),))
                if rest:
                    add(capacity - s * rest, 1, ((s, rest),))
                break
            room = rooms[k]
            times, contents = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(k)
            each = room // s
            whole, rest = divmod(min(left, times * each), each)
            if whole:
                add(room - s * each, whole, (*contents, (s, each)))
            if rest:
                add(room - s * rest, 1, (*contents, (s, rest)))
            if times > whole + bool(rest):
                add(room, times - whole - bool(rest), contents)
            left -= whole * each + rest
    found = []
    for groups in by_room.values():
        for times, contents in groups:
            one = Counter()
            for s, a in contents:
                one[s] += a
            found.append((one, times))
    return found


def rounded(
    solved: list[tuple[dict, float]], counts: np.ndarray, capacity: int, share: float
) -> list[tuple[dict, int]]:
    """The fullest configurations first, each as often as ``share`` of the solution says
    and as pieces are left for; then best fit for the pieces left over."""
    left, chosen = counts.copy(), []
    for contents, x in sorted(solved, key=lambda c: -sum(s * a for s, a in c[0].items())):
        times = min([int(x * share), *(int(left[s]) // a for s, a in contents.items())])
        if times:
            chosen.append((contents, times))
            for s, a in contents.items():
                left[s] -= a * times
    return chosen + best_fit(left, capacity)


def plan(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[dict, int]]:
    """Configurations and how many sequences have each; together they hold every piece.
    The solution is rounded at several shares, and the fewest sequences win."""
    counts = counts.astype(np.int64)
    if not counts.any():
        return []
    solved = linear_program(counts, capacity, rounds)
    plans = [rounded(solved, counts, capacity, share) for share in SHARES]
    return min(plans, key=lambda p: sum(times for _, times in p))


def places(planned: list[tuple[dict, int]]) -> dict[int, np.ndarray]:
    """For each length rows (first number, first sequence, pieces a sequence, offset): a
    row holds for the numbers from the first on, up to the next row."""
    found, number, sequence = defaultdict(list), Counter(), 0
    for contents, times in planned:
        offset = 0
        for s in sorted(contents, reverse=True):
            found[s].append((number[s], sequence, contents[s], offset))
            number[s] += contents[s] * times
            offset += s * contents[s]
        sequence += times
    return {s: np.array(rows, np.int64) for s, rows in found.items()}


def place(length: np.ndarray, number: np.ndarray, where: dict) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces, by length and number among those of the length."""
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    order = np.argsort(length, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
        if not len(some):
            continue
        s, rows, n = int(length[some[0]]), where[int(length[some[0]])], number[some]
        row = rows[np.searchsorted(rows[:, 0], n, side="right") - 1]
        turn, copy = np.divmod(n - row[:, 0], row[:, 2])
        sequence[some] = row[:, 1] + turn
        offset[some] = row[:, 3] + copy * s
    return sequence, offset


def pack(
    pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, rounds: int = ROUNDS
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; no sequence is longer than
    ``capacity`` and none has gaps.

    Lengths must be from 1 to ``capacity``; anything else, null too, is an error. Repeated
    rows are pieces of their own, other columns are passed on, and an empty table gives an
    empty one. Pieces are numbered per task and length; the numbers are made global by a
    table of counts (task, length), so no length is a hot key, however common.
    """
    for name in ("sequence_id", "offset"):
        if spare(pieces, name) != name:
            raise ValueError(f"pieces have a column {name!r} already")
    part, number, base = (spare(pieces, name) for name in ("part", "number", "base"))
    fields = [f"{key(f.name)} {f.dataType.simpleString()}" for f in pieces.schema]

    def count(batches):
        from pyspark import TaskContext

        mine, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            numbers = []
            for s in batch.column(batch.schema.get_field_index(length)).to_pylist():
                if s is None or not 0 < s <= capacity:
                    raise ValueError(f"a piece of length {s} in sequences of {capacity}")
                numbers.append(seen[s])
                seen[s] += 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([mine] * len(numbers), pa.int32()), pa.array(numbers, pa.int64())],
                [*batch.schema.names, part, number],
            )

    counted = ", ".join([*fields, f"{key(part)} int", f"{key(number)} long"])
    numbered = cut(pieces.mapInArrow(count, counted))
    sizes = numbered.groupBy(F.col(key(part)).alias("p"), F.col(key(length)).alias("s")).agg(
        F.count("*").alias("n")
    )
    sizes = cut(sizes)
    counts = np.zeros(capacity + 1, np.int64)
    for row in sizes.groupBy("s").agg(F.sum("n").alias("n")).collect():
        counts[row.s] = row.n
    where = places(plan(counts, capacity, rounds))
    before = F.sum("n").over(Window.partitionBy("s").orderBy("p")) - F.col("n")
    bases = sizes.select("p", "s", before.alias(base))
    joined = numbered.join(
        bases, (numbered[key(part)] == bases["p"]) & (numbered[key(length)] == bases["s"])
    ).select(
        *[numbered[key(c)] for c in pieces.columns],
        (numbered[key(number)] + bases[key(base)]).alias(number),
    )

    def assign(batches):
        for batch in batches:
            at = {name: batch.column(batch.schema.get_field_index(name)) for name in (length, number)}
            size, n = (at[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in (length, number))
            sequence, offset = place(size, n, where)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)],
                [*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    return joined.mapInArrow(assign, ", ".join([*fields, "sequence_id long", "offset long"]))


def token_pieces(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    keep_ids: bool = False,
) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, and with ``keep_ids`` the ids
    as little-endian unsigned 32-bit bytes.

    A document is the ids of its whole text and ``end_id``; a null text is an empty one.
    Only documents longer than ``capacity`` are cut, the last piece may be shorter. Each
    row is a document, also repeated ones and those without id; other columns are left out.
    """
    import struct

    end, wide = struct.pack("<I", end_id), 4 * capacity
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["id", "piece", "start", "length", "ids_crc32"]
    if keep_ids:
        kinds, names = [*kinds, pa.binary()], [*names, "ids"]

    def encode(batches):
        find = encoder(vocabulary).ids
        for batch in batches:
            rows = []
            for doc_id, body in zip(batch.column(0), batch.column(1), strict=True):
                ids, doc_id = find(body.as_py()) + end, doc_id.as_py()
                for piece, at in enumerate(range(0, len(ids), wide)):
                    own = ids[at : at + wide]
                    row = (doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own))
                    rows.append((*row, own) if keep_ids else row)
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )

    schema = "id long, piece int, start long, length long, ids_crc32 long"
    schema += ", ids binary" if keep_ids else ""
    own = docs.select(F.col(key(id)).cast("long").alias("id"), F.col(key(text)).alias("text"))
    return own.mapInArrow(encode, schema).withColumnRenamed("id", id)
