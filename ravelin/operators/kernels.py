"""Block scoring over Arrow batches.

A score is the sum of products from the first dimension to the last, so it doesn't depend on the block it was computed in and is the
same bit for bit as the JVM's and SQL's. Matrix products, whose order of addition is the library's, only preselect: whatever lies
within their rounding error of a decision is scored again in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Rows, centroids and queries scored at once; a bound, relative to the vectors' lengths, of how far two orders of addition can differ.
BLOCK, COLUMNS, QUERIES, SLACK = 4096, 2048, 256, 1e-11


def matrix_of(column: pa.Array) -> np.ndarray:
    """A list column as a matrix in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, len(flat) // n if n else 0)


def in_order(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Dot products of the rows with one query, or each with its own, added in order."""
    return np.add.accumulate(rows * query, axis=1)[:, -1] if rows.shape[1] else np.zeros(len(rows))


def scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """(rows, queries) dot products, added in order."""
    return np.stack([in_order(rows, q) for q in queries], axis=1) if len(queries) else np.zeros((len(rows), 0))


def _slack(rows: np.ndarray, queries: np.ndarray) -> float:
    longest = lambda m: float(np.sqrt((m * m).sum(axis=1).max())) if m.size else 0.0
    return SLACK * longest(rows) * longest(queries)


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Each row's centroid of the highest score, the first of equals; at most BLOCK x COLUMNS scores are held at once."""
    out = np.zeros(len(rows), dtype=np.int32)
    for i in range(0, len(rows), BLOCK):
        block = rows[i : i + BLOCK]
        n = np.arange(len(block))
        best, second = np.full(len(block), -np.inf), np.full(len(block), -np.inf)
        for at in range(0, len(centroids), COLUMNS):
            rough = block @ centroids[at : at + COLUMNS].T
            first = rough.argmax(axis=1)
            top = rough[n, first]
            rough[n, first] = -np.inf
            second = np.maximum(np.maximum(second, rough.max(axis=1)), np.minimum(best, top))
            out[i : i + BLOCK] = np.where(top > best, at + first, out[i : i + BLOCK])
            best = np.maximum(best, top)
        least = best - _slack(block, centroids)
        close = np.flatnonzero(second >= least)
        if len(close):
            out[i + close] = _first_of_close(block[close], centroids, least[close])
    return out


def _first_of_close(rows: np.ndarray, centroids: np.ndarray, least: np.ndarray) -> np.ndarray:
    """nearest() in exact scores, among the centroids whose rough score is at least so much."""
    found, best = np.zeros(len(rows), dtype=np.int32), np.full(len(rows), -np.inf)
    for at in range(0, len(centroids), COLUMNS):
        who, which = np.nonzero(rows @ centroids[at : at + COLUMNS].T >= least[:, None])
        for j in range(0, len(who), BLOCK):
            w, c = who[j : j + BLOCK], which[j : j + BLOCK] + at
            exact = in_order(rows[w], centroids[c])
            top = first_k(w, exact, c, 1)
            better = top[exact[top] > best[w[top]]]  # centroids come in order, so the first of equals stays
            found[w[better]], best[w[better]] = c[better], exact[better]
    return found


def top_pairs(ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of each query's k best rows, best first, ties by the lower id."""
    n, found = len(rows), [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for start in range(0, len(queries), QUERIES):
        some = queries[start : start + QUERIES]
        if n > k:
            rough = some @ rows.T
            least = np.partition(rough, n - k, axis=1)[:, n - k] - _slack(rows, some)
            who, at = np.nonzero(rough >= least[:, None])
        else:
            who, at = np.repeat(np.arange(len(some)), n), np.tile(np.arange(n), len(some))
        exact = np.empty(len(who))
        for i in range(0, len(who), BLOCK):  # many rows may tie
            exact[i : i + BLOCK] = in_order(rows[at[i : i + BLOCK]], some[who[i : i + BLOCK]])
        first = first_k(who, exact, ids[at], k)
        found.append((who[first] + start, at[first], exact[first]))
    return tuple(np.concatenate(x) for x in zip(*found))


def first_k(groups: np.ndarray, values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each group's k highest values, by group, then best first, ties by the lower id."""
    order = np.lexsort((ids, -values, groups))
    own = groups[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own, side="left") < k]


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision; zero rows stay."""
    norms = np.sqrt(np.add.accumulate(v * v, axis=1)[:, -1]) if v.size else np.zeros(len(v))
    return v / np.where(norms == 0, 1.0, norms)[:, None]
