"""Exact nearest neighbours of one block of queries in one block of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Largest number of float64 values one intermediate array may hold (64 MB).
BLOCK_VALUES = 2**23


def as_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equally long number lists as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    if len(pc.unique(pc.list_value_length(column))) > 1:
        raise ValueError("vectors differ in length")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def unit_of(*matrices: np.ndarray) -> float:
    """A power of two near the largest element; dividing by it is exact and keeps squares in range."""
    largest = max((float(np.abs(m).max(initial=0.0)) for m in matrices), default=0.0)
    return 2.0 ** int(np.clip(np.frexp(largest)[1], -1000, 1000)) if largest else 1.0


def squared_distances(left: np.ndarray, right: np.ndarray, unit: float = 1.0) -> np.ndarray:
    """All squared distances, in ``unit`` squared, by matrix product; fast, with a small rounding error."""
    left, right = left / unit, right / unit
    square = (left**2).sum(1)[:, None] + (right**2).sum(1)[None, :] - 2.0 * left @ right.T
    return np.maximum(square, 0.0)


def rounding_slack(left: np.ndarray, right: np.ndarray, unit: float = 1.0) -> float:
    """Bound, with room to spare, on the error of :func:`squared_distances`, in ``unit`` squared."""
    return 1e-12 * (((left / unit) ** 2).sum(1).max(initial=0.0) + ((right / unit) ** 2).sum(1).max(initial=0.0))


def first_copies(vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows left when of equal rows only the first ``k`` are kept; the others can
    never be among ``k`` nearest, with ties settled by order."""
    n, width = vectors.shape
    key = (vectors * np.cos(np.arange(width))).sum(1)  # equal for equal rows
    order = np.argsort(key, kind="stable")
    maybe = np.flatnonzero(key[order[1:]] == key[order[:-1]]) + 1
    repeats = np.zeros(n, bool)
    repeats[maybe] = (vectors[order[maybe]] == vectors[order[maybe - 1]]).all(1)
    place = np.arange(n)
    run = np.maximum.accumulate(np.where(repeats, 0, place))
    return np.sort(order[place - run < k])


def top_k(queries: np.ndarray, vectors: np.ndarray, k: int):
    """(query row, vector row, squared distance) of the ``k`` nearest per query.

    ``vectors`` must come in id order, which settles ties. The matrix product only narrows
    down the candidates; their distances are computed anew from the differences, added up
    in the order of the elements, so nothing depends on its rounding or on the block.
    """
    kept_rows = first_copies(vectors, k)
    vectors = vectors[kept_rows]
    n = len(vectors)
    step = max(1, BLOCK_VALUES // max(1, n))
    unit = unit_of(queries, vectors)
    found = []
    for start in range(0, len(queries), step):
        block = queries[start : start + step]
        rough = squared_distances(block, vectors, unit)
        limit = np.full(len(block), np.inf)
        if n > k:
            limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * rounding_slack(block, vectors, unit)
        rows, cols = np.nonzero(rough <= limit[:, None])
        exact = _pair_distances(block, vectors, rows, cols)
        order = np.lexsort((cols, exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        first = np.searchsorted(rows, rows, side="left")
        kept = np.arange(len(rows)) - first < k
        found.append((rows[kept] + start, kept_rows[cols[kept]], exact[kept]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(parts) for parts in zip(*found))


#: Candidates that are held before their distances are settled.
MOST_CANDIDATES = 2**20
#: Hits a row in one product, beyond which 32 bits are taken to tell too little and the product is made anew in 64.
MANY_HITS = 64


def top_k_in_groups(queries: np.ndarray, vectors: np.ndarray, group: np.ndarray, visits, k: int, rows: int = 1024, bound=None, about=None):
    """As :func:`top_k`, but a query meets the vectors of those groups alone that it visits.

    ``group`` has each vector's group. ``visits(queries, groups)`` gives, for some queries and the groups at hand, who visits
    which, and a distance below which no vector of the group lies from the query; with ``about``, an array of a row per query,
    it gets those queries' rows of it as well. Nearer groups come first, and what has been found so far leaves out others.
    ``bound`` has a distance per query beyond which nothing is wanted. ``rows`` of either side are compared at once, more
    queries where groups are small.

    Products are made in 32 bits, in memory that is used again, and narrow the candidates by more than they can be off:
    ``best`` holds upper bounds, a candidate's value is a lower one. Distances are computed anew as in :func:`top_k`.
    """
    order = first_copies(vectors, k)
    order = order[np.argsort(group[order], kind="stable")]
    groups, starts = np.unique(group[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    unit = unit_of(queries, vectors)
    fine = 2 * rounding_slack(queries, vectors, unit)
    # by one more column the product is the squared distance but for the query's own square
    right = vectors[order] / unit
    right = np.concatenate([right, (right**2).sum(1)[:, None]], axis=1)
    most, right = right[:, -1].max(initial=0.0), right.astype(np.float32)
    # what rounding of the elements and of their sum can come to
    coarse = (vectors.shape[1] + 8) * 2.0**-23
    step = rows * int(np.clip(rows * len(groups) // max(1, len(order)), 1, 4))
    area = max(rows * rows, step)
    product = np.empty(area, np.float32)
    found = []
    for start in range(0, len(queries), step):
        block = queries[start : start + step]
        left = block / unit
        own = (left**2).sum(1)
        rough = coarse * (own + 2 * most) + fine + 1e-36
        left = np.concatenate([-2.0 * left, np.ones((len(block), 1))], axis=1).astype(np.float32)
        visited, away = visits(block, groups) if about is None else visits(block, groups, about[start : start + step])
        away = away / unit
        best = np.full((len(block), k), np.inf)  # the k smallest squares so far, or more
        if bound is not None:
            with np.errstate(over="ignore"):
                best[:] = ((bound[start : start + step] / unit) ** 2 * (1 + 1e-12) + fine)[:, None]
        held, waiting = [], 0
        for g in np.argsort(away.mean(0), kind="stable"):
            at = starts[g]
            while at < ends[g]:
                asked = np.flatnonzero(visited[:, g] & (away[:, g] <= np.sqrt(best[:, -1])))
                if not len(asked):
                    break
                to = min(at + max(1, min(area // len(asked), 4 * rows)), ends[g])
                some = left if len(asked) == len(block) else left[asked]
                square = np.matmul(some, right[at:to].T, out=product[: len(asked) * (to - at)].reshape(len(asked), to - at))
                row, col, low, high = _within(square, best[asked, -1], own[asked], rough[asked], k)
                if len(row) > MANY_HITS * len(asked):
                    some = np.unique(row)
                    exact = squared_distances(block[asked[some]], vectors[order[at:to]], unit)
                    row, col, low, high = _within(exact, best[asked[some], -1], np.zeros(len(some)), np.full(len(some), fine), k)
                    row = some[row]
                if len(row):
                    row = asked[row]
                    _lower(best, row, high)
                    held.append((row, order[at + col], low))
                    waiting += len(row)
                if waiting > MOST_CANDIDATES:
                    held = [_settled(block, vectors, held, best, k)[:3]]
                    waiting = len(held[0][0])
                at = to
        if held:
            row, col, _, square = _settled(block, vectors, held, best, k)
            found.append((row + start, col, square))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _within(square: np.ndarray, best: np.ndarray, own: np.ndarray, slack: np.ndarray, k: int):
    """Where ``square + own``, off by ``slack`` at most, may be no more than ``best``: rows, columns, lower and upper values.

    A row that has no best yet takes its own k smallest.
    """
    limit = best - own + slack
    new = np.isinf(limit)
    if new.any() and square.shape[1] > k:
        limit[new] = np.partition(square[new], k - 1, axis=1)[:, k - 1] + 2 * slack[new]
    rows = np.flatnonzero(square.min(1) <= limit)
    square = square if len(rows) == len(square) else square[rows]
    flat = np.flatnonzero(square <= limit[rows].astype(square.dtype)[:, None])
    row, col = np.divmod(flat, square.shape[1])
    value = square.ravel()[flat] + own[rows[row]]
    row = rows[row]
    return row, col, value - slack[row], value + slack[row]


def _lower(best: np.ndarray, row: np.ndarray, value: np.ndarray) -> None:
    """Take new ``value`` of ``row`` into its smallest ones; ``row`` comes in order."""
    k = best.shape[1]
    touched = np.unique(row)
    rows = np.concatenate([np.repeat(touched, k), row])
    values = np.concatenate([best[touched].ravel(), value])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    first = np.searchsorted(rows, touched)
    best[touched] = values[first[:, None] + np.arange(k)]


def _settled(queries, vectors, held, best, k: int):
    """The ``k`` nearest of the candidates by exact distance: rows, columns, lower bounds and exact squares."""
    row, col, value = (np.concatenate(parts) for parts in zip(*held))
    kept = value <= best[row, -1]
    row, col, value = row[kept], col[kept], value[kept]
    square = _pair_distances(queries, vectors, row, col)
    order = np.lexsort((col, square, row))
    row, col, value, square = row[order], col[order], value[order], square[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
    return row[kept], col[kept], value[kept], square[kept]


def _pair_distances(left: np.ndarray, right: np.ndarray, rows: np.ndarray, cols: np.ndarray):
    """Squared distances of the named pairs, a bounded number of them at a time.

    Squares are added up element after element, as the SQL of the same search does.
    """
    square = np.zeros(len(rows))
    step = max(1, BLOCK_VALUES // max(1, left.shape[1]))
    for start in range(0, len(rows), step):
        part = slice(start, start + step)
        apart = np.ascontiguousarray(((left[rows[part]] - right[cols[part]]) ** 2).T)
        for column in apart:
            square[part] += column
    return square
