"""NumPy work on one block of queries against one block of vectors.

Spark decides which block meets which; nothing here knows about partitions. The module
travels by value, so executors need no copy of the package.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Distances that agree to this many decimals are ties, and ties go to the smaller id.
# It makes the order independent of how the vectors were blocked.
TIE_DECIMALS = 12
# Cells of one distance matrix: 2M doubles are 16 MB, a few copies of which are alive.
MATRIX_CELLS = 2_000_000
# Rows that are made doubles of unit length at a time; the others stay as they came.
BLOCK_ROWS = 8_192


def combined(column):
    """One contiguous array for a column that may come in chunks."""
    if isinstance(column, pa.ChunkedArray):
        return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def matrix(vectors, dim=None, kind=np.float64):
    """Rows of an Arrow list column, as doubles unless told; all must have the same length."""
    vectors = combined(vectors)
    if len(vectors) == 0:
        return np.empty((0, dim or 0))
    lengths = pc.unique(pc.list_value_length(vectors)).to_pylist()
    if len(lengths) != 1 or lengths[0] is None or dim not in (None, lengths[0]):
        raise ValueError(f"vectors must all have {dim or 'one'} dimensions, found {lengths}")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind).reshape(len(vectors), lengths[0])


def packed(vectors, kind):
    """An Arrow list column as a binary column of raw values of one numpy kind.

    Vectors cross shuffles and the border to Python as bytes; as arrays every value is
    written on its own.
    """
    rows = np.ascontiguousarray(matrix(vectors), dtype=kind)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.itemsize * rows.shape[1])
    buffers = [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(rows), buffers)


def raw_rows(column, kind):
    """Rows of a packed column in their own kind; all must have the same length."""
    parts, lengths = [], set()
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(chunk):
            chunk = chunk.cast(pa.large_binary())
            _, ends, data = chunk.buffers()
            ends = np.frombuffer(ends, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
            lengths.update(np.unique(np.diff(ends)).tolist())
            if len(lengths) != 1:
                raise ValueError("vectors must all have one number of dimensions")
            values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind)
            parts.append(values.reshape(len(chunk), -1))
    if not parts:
        return np.empty((0, 0))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def unpacked(column, kind):
    """Rows of a packed column as doubles; all must have the same length."""
    return raw_rows(column, kind).astype(np.float64)


def unit_rows(rows):
    """Rows scaled to length 1; zero rows stay zero, at distance 1 from everything."""
    lengths = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    lengths[lengths == 0] = 1.0
    return rows / lengths[:, None]


def equal_rows(rows):
    """(first, group): the position of the first of each set of identical rows, and the
    set every row belongs to."""
    whole = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.itemsize * rows.shape[1])))
    _, first, group = np.unique(whole.ravel(), return_index=True, return_inverse=True)
    return first, group.ravel()


def marks(rows):
    """A number for each row, the same for identical rows; others share one by chance only."""
    kind = np.dtype(f"u{rows.itemsize}")
    weights = np.random.default_rng(1).integers(1, 2**63, rows.shape[1], dtype=np.uint64) | np.uint64(1)
    found = np.empty(len(rows), np.uint64)
    for start in range(0, len(rows), BLOCK_ROWS):
        some = np.ascontiguousarray(rows[start : start + BLOCK_ROWS]).view(kind).astype(np.uint64)
        some ^= some >> np.uint64(23)
        found[start : start + BLOCK_ROWS] = (some * weights).sum(axis=1, dtype=np.uint64)
    return found


def by_id(ids, rows, most=None):
    """Ids and rows in ascending id order.

    Of identical rows only the ``most`` smallest ids stay: with ties going to the smaller
    id, no other can be among the ``most`` nearest of anything.
    """
    ids = combined(ids)
    order = pc.sort_indices(ids)
    ids, rows = ids.take(order), rows[order.to_numpy()]
    if most is None or len(rows) <= most:
        return ids, rows
    _, group, count = np.unique(marks(rows), return_inverse=True, return_counts=True)
    often = np.flatnonzero((count > most)[group])
    if not len(often):
        return ids, rows
    _, group = equal_rows(rows[often])
    sets = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[sets], group[sets])
    keep = np.ones(len(rows), bool)
    keep[often[sets]] = np.arange(len(often)) - starts < most
    return ids.filter(pa.array(keep)), rows[keep]


def near_columns(queries, rows, queries_32, rows_32, k, worst=None):
    """(query, column number, distance) of all pairs that may be among the k nearest of a query.

    Single precision finds them: whatever lies within its error bound of the k-th, or of
    ``worst``, the distance of the k-th that a query has already; their distances are then
    computed in double precision, so the result does not depend on the first pass.
    """
    height, width, dim = len(queries), len(rows), queries.shape[1]
    if width <= 4 * k:
        line, column = np.divmod(np.arange(height * width), width)
        cosines = (queries @ rows.T).ravel()
    else:
        opposed = -queries_32 @ rows_32.T
        # A dot product of unit vectors errs by at most (dim + 2) roundings.
        slack = 2 * (dim + 2) * float(np.finfo(np.float32).eps) + 10.0**-TIE_DECIMALS
        near = None
        if worst is not None:
            near = ~(opposed > (worst - 1.0 + slack).astype(np.float32)[:, None])
        if near is None or np.count_nonzero(near) > 2 * k * height:
            bound = np.partition(opposed, k - 1, axis=1)[:, k - 1 : k] + np.float32(slack)
            near = ~(opposed > bound) if near is None else near & ~(opposed > bound)
        line, column = np.nonzero(near)
        cosines = np.empty(len(line))
        step = max(1, MATRIX_CELLS // 16 // dim)
        for start in range(0, len(line), step):
            part = slice(start, start + step)
            cosines[part] = np.einsum("ij,ij->i", queries[line[part]], rows[column[part]])
    # Adding 0.0 turns -0.0 into 0.0.
    return line, column, np.round(1.0 - cosines, TIE_DECIMALS) + 0.0


def first_k(line, column, values, k):
    """The k pairs of least distance of each query, in order; ties go to the lower column."""
    order = np.lexsort((column, values, line))
    line, column, values = line[order], column[order], values[order]
    kept = np.arange(len(line)) - np.searchsorted(line, line) < k
    return line[kept], column[kept], values[kept]


def nearest_columns(queries, rows, queries_32, rows_32, k):
    """Column numbers of the k nearest rows per query and their distances, in order.

    Rows stand in id order, so ties go to the lower column.
    """
    _, column, values = first_k(*near_columns(queries, rows, queries_32, rows_32, k), k)
    shape = (len(queries), min(k, len(rows)))
    return column.reshape(shape), values.reshape(shape)


def block_of(n, k):
    """How many of ``n`` rows are compared at a time: all blocks have nearly as many."""
    return -(-n // -(-n // max(BLOCK_ROWS, 8 * k)))


def nearest_in_blocks(queries, rows, k):
    """As ``nearest_columns``, for rows of any kind and length, of which only a block at a time
    is made doubles of unit length. What the first blocks have bounds what others can add; it
    is put in order each time that twice as many rows have been seen, or much has come."""
    queries_32, worst, held, ordered, fresh = queries.astype(np.float32), None, [], 0, 0
    step = block_of(len(rows), k)
    for start in range(0, len(rows), step):
        some = unit_rows(rows[start : start + step].astype(np.float64))
        line, column, values = near_columns(queries, some, queries_32, some.astype(np.float32), k, worst)
        held.append((line, column + start, values))
        seen, fresh = start + len(some), fresh + len(line)
        if seen >= 2 * ordered or seen == len(rows) or fresh > MATRIX_CELLS // 2:
            held, ordered, fresh = [first_k(*map(np.concatenate, zip(*held, strict=True)), k)], seen, 0
            if seen >= k:
                worst = held[0][2].reshape(len(queries), -1)[:, -1]
    shape = (len(queries), min(k, len(rows)))
    return held[0][1].reshape(shape), held[0][2].reshape(shape)


def top_k(query_ids, queries, ks, ids, rows, exclude_self, reach=None):
    """The nearest rows of one block for each query of one block.

    ``ids``/``rows`` come in id order, ``rows`` of any kind and length, ``queries`` at unit
    length. Yields record batches (query_id, rank, id, distance); ranks count within the
    block. Equal queries are compared once. With ``exclude_self`` one hit more is looked up,
    and the query's own row is left out of them. Hits beyond a query's ``reach`` are not given.
    """
    query_ids, ids = combined(query_ids), combined(ids)
    if not len(ids) or not len(query_ids):
        return
    own = None
    if exclude_self:
        found = pc.index_in(query_ids.cast(ids.type), value_set=ids)
        own = pc.fill_null(found, -1).to_numpy(zero_copy_only=False)
    first, group = equal_rows(queries)
    asking = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[asking], np.arange(len(first) + 1))
    most = max(1, int(ks.max()) + exclude_self)
    # Where all pairs are computed in double precision they weigh more.
    room = MATRIX_CELLS if len(ids) > 4 * most else MATRIX_CELLS // 8
    step = max(1, room // block_of(len(ids), most))
    for start in range(0, len(first), step):
        stop = min(start + step, len(first))
        asked = asking[ends[start] : ends[stop]]
        most = max(1, int(ks[asked].max()) + exclude_self)
        columns, values = nearest_in_blocks(queries[first[start:stop]], rows, most)
        few = max(1, MATRIX_CELLS // 8 // most)
        for at in range(0, len(asked), few):
            lines = asked[at : at + few]
            near, far = columns[group[lines] - start], values[group[lines] - start]
            other = np.ones(near.shape, bool) if own is None else near != own[lines][:, None]
            ranks = np.cumsum(other, axis=1, dtype=np.int32)
            given = other & (ranks <= ks[lines][:, None])
            if reach is not None:
                given &= far <= reach[lines][:, None] + 2 * 10.0**-TIE_DECIMALS
            line, place = np.nonzero(given)
            yield pa.record_batch(
                [
                    query_ids.take(pa.array(lines[line])),
                    pa.array(ranks[line, place]),
                    ids.take(pa.array(near[line, place])),
                    pa.array(far[line, place]),
                ],
                names=["query_id", "rank", "id", "distance"],
            )


def gathered(batches, size):
    """Record batches joined into tables of about ``size`` rows."""
    held, count = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= size:
            yield pa.Table.from_batches(held)
            held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)


def search_held_vectors(held, exclude_self):
    """Map over queries; ``held`` is a broadcast (ids, rows as they came) in id order."""

    def run(batches):
        ids, rows = held.value
        for batch in batches:
            if batch.num_rows:
                queries = unit_rows(matrix(batch["vector"], rows.shape[1]))
                ks = batch["k"].to_numpy(zero_copy_only=False)
                yield from top_k(batch["query_id"], queries, ks, ids, rows, exclude_self)

    return run


def search_held_queries(held, block_rows, exclude_self):
    """Map over vectors; ``held`` is a broadcast (query ids, unit rows, ks)."""

    def run(batches):
        query_ids, queries, ks = held.value
        most = int(ks.max()) + exclude_self
        for table in gathered(batches, block_rows):
            ids, rows = by_id(table["id"], matrix(table["vector"], queries.shape[1]), most)
            yield from top_k(query_ids, queries, ks, ids, rows, exclude_self)

    return run


def search_tile(guest_kind, member_kind, exclude_self, schema):
    """Co-grouped: the queries of one tile against the vectors of the same tile. The vectors of
    the queries are unpacked a part at a time, so that a tile may have many of them."""

    def run(left, right):
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ks, reach = left["k"].to_numpy(), left["reach"].to_numpy()
        most = int(ks.max()) + exclude_self
        ids, rows = by_id(right["id"], raw_rows(right["packed"], member_kind), most)
        found, step = [], max(1, MATRIX_CELLS // max(1, rows.shape[1]))
        for start in range(0, left.num_rows, step):
            some, part = left.slice(start, step), slice(start, start + step)
            queries = unit_rows(unpacked(some["packed"], guest_kind))
            if queries.shape[1] != rows.shape[1]:
                raise ValueError(f"queries must all have {rows.shape[1]} dimensions")
            found += top_k(some["query_id"], queries, ks[part], ids, rows, exclude_self, reach[part])
        return pa.Table.from_batches(found).cast(schema) if found else schema.empty_table()

    return run


def angles(rows, pivots):
    return np.arccos(np.clip(rows @ pivots.T, -1.0, 1.0))


def nearest_pivot(held, kind):
    """Map over vectors: (id, packed, cell, angle), by the nearest pivot."""

    def run(batches):
        pivots = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = unit_rows(matrix(batch["vector"], pivots.shape[1]))
            cells = np.empty(len(rows), np.int32)
            turns = np.empty(len(rows))
            step = max(1, MATRIX_CELLS // len(pivots))
            for start in range(0, len(rows), step):
                turn = angles(rows[start : start + step], pivots)
                cell = turn.argmin(axis=1)
                cells[start : start + step] = cell
                turns[start : start + step] = turn[np.arange(len(cell)), cell]
            yield pa.record_batch(
                [batch["id"], packed(batch["vector"], kind), pa.array(cells), pa.array(turns)],
                names=["id", "packed", "cell", "angle"],
            )

    return run


def cells_near(turn, count, k, probes):
    """Cells (boolean, query × cell) by rising angle to their pivot: ``probes`` of them,
    or as many as it takes to hold k rows."""
    turn = np.where(count > 0, turn, np.inf)
    order = np.argsort(turn, axis=1, kind="stable")
    if probes is None:
        held = count[order]
        take = np.cumsum(held, axis=1) - held < k[:, None]
    else:
        take = np.broadcast_to(np.arange(turn.shape[1]) < probes, turn.shape)
    visit = np.zeros(turn.shape, bool)
    np.put_along_axis(visit, order, take, axis=1)
    return visit & (count > 0)


def cells_within(turn, count, radius, reach, slack):
    """Cells that may hold a row at a distance of at most ``reach``.

    By the triangle inequality no row of a cell is closer than the angle to its pivot
    less the radius of the cell.
    """
    widest = np.arccos(np.clip(1.0 - reach, -1.0, 1.0))
    return (turn - radius <= widest[:, None] + slack) & (count > 0)


def visited_cells(held, probes, slack, kind):
    """Map over queries (query_id, vector, k, reach): one row per cell to look into.

    Queries with a ``reach`` visit all cells that may hold a row within it; those without
    the nearest cells. Cells that were put together (``homes``, if any) are one row. The
    vectors are kept, packed, if a ``kind`` is given.
    """

    def run(batches):
        pivots, count, radius, homes = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = unit_rows(matrix(batch["vector"], pivots.shape[1]))
            ks = batch["k"].to_numpy(zero_copy_only=False)
            reach = batch["reach"].to_numpy(zero_copy_only=False)
            raw = packed(batch["vector"], kind) if kind else None
            # Queries at a time: bounds the angles and what one batch of visits may weigh.
            step = max(1, 2 * MATRIX_CELLS // len(pivots) // rows.shape[1])
            for start in range(0, len(rows), step):
                part = slice(start, start + step)
                turn = angles(rows[part], pivots)
                if np.isfinite(reach[part]).any():
                    visit = cells_within(turn, count, radius, reach[part], slack)
                else:
                    visit = cells_near(turn, count, ks[part], probes)
                line, cell = np.nonzero(visit)
                if homes is not None:
                    joint = np.zeros((len(visit), int(homes.max()) + 1), bool)
                    joint[line, homes[cell]] = True
                    line, cell = np.nonzero(joint)
                lines = pa.array(line + start)
                columns = {n: batch[n].take(lines) for n in ("query_id", "k", "reach")}
                if kind:
                    columns["packed"] = raw.take(lines)
                columns["cell"] = pa.array(cell.astype(np.int32))
                yield pa.record_batch(list(columns.values()), names=list(columns))

    return run
