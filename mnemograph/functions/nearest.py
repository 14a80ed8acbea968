"""The nearest vectors of a block of queries in a block of vectors, by cosine: what one task does with two Arrow tables.

A matrix product gives each score to within a bound; what may be among a query's best by that bound is scored again as
`scalars.cosine` does, by the same steps in the same order, so that scores and ties are the same to the last bit.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries and vectors of one matrix product: its scores take 8 MB.
QUERIES, VECTORS = 256, 4096


def _matrices(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the places and values of the lists that are not null and hold no null."""
    values = lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py())
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    size = np.diff(offsets)
    good = lists.is_valid().to_numpy(zero_copy_only=False)
    empty = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
    good &= empty[offsets[1:]] == empty[offsets[:-1]]
    numbers = values.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(size[good]):
        at = np.flatnonzero(good & (size == n))
        out[int(n)] = (at, numbers[offsets[at][:, None] + np.arange(n)])
    return out


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The dot products of rows, summed from the first component to the last."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def _first(rows: np.ndarray, k: int) -> np.ndarray:
    """Which of sorted rows are among the first k of their value."""
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, int)
    return np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows)))) < k


def _best(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, null: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each row: as Spark sorts, not-a-number before numbers, null behind them, equal ones by column."""
    level = np.where(null, 2, np.where(np.isnan(scores), 0, 1))
    order = np.lexsort((cols, np.where(level == 1, -scores, 0.0), level, rows))
    order = order[_first(rows[order], k)]
    return rows[order], cols[order], scores[order], null[order]


def block(k: int, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of queries (query, qv) and vectors (ref, v) that gives query, ref and score of each query's k best."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        asked, held = asked.filter(asked["query"].is_valid()), held.filter(held["ref"].is_valid()).sort_by("ref")
        query, ref = asked["query"].combine_chunks(), held["ref"].combine_chunks()
        ours, theirs = _matrices(asked["qv"].combine_chunks()), _matrices(held["v"].combine_chunks())
        own = pc.index_in(query.cast(ref.type), ref.unique())
        own = pc.fill_null(own, -1).to_numpy(zero_copy_only=False)
        name = pc.index_in(ref, ref.unique()).to_numpy(zero_copy_only=False)
        got = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool))]

        def add(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, null: np.ndarray) -> None:
            other = own[rows] != name[cols]
            got.append(_best(rows[other], cols[other], scores[other], null[other], k))

        scored = np.zeros(len(query), bool)
        for n, (at, a) in ours.items():
            to, b = theirs.get(n, (np.zeros(0, int), np.zeros((0, n))))
            with np.errstate(all="ignore"):
                la, lb = np.sqrt(_dots(a, a)), np.sqrt(_dots(b, b))
                if np.isfinite(la).all() and np.isfinite(lb).all():  # else a vector without a length may have a score: not a number
                    at, a, la = at[la != 0], a[la != 0], la[la != 0]
                    to, b, lb = to[lb != 0], b[lb != 0], lb[lb != 0]
                for i in range(0, len(at), QUERIES):
                    for j in range(0, len(to), VECTORS):
                        x, y, lx, ly = a[i : i + QUERIES], b[j : j + VECTORS], la[i : i + QUERIES], lb[j : j + VECTORS]
                        near = (x @ y.T) / (lx[:, None] * ly)
                        every = np.ones(near.shape, bool)
                        names = np.bincount(name[to[j : j + VECTORS]]).max()  # a query's own reference may take so many places
                        if np.isfinite(near).all() and k + names < near.shape[1]:
                            least = -np.partition(-near, k + names - 1, axis=1)[:, k + names - 1]
                            every = near >= (least - 8 * (n + 4) * np.finfo(float).eps)[:, None]
                        r, c = np.nonzero(every)
                        dot, norms = np.zeros(len(r)), lx[r] * ly[c]
                        for d in range(n):
                            dot += x[r, d] * y[c, d]
                        add(at[i + r], to[j + c], dot / norms, ~((norms > 0) | np.isnan(norms)))
            scored[at] = True
            # The vectors of another length, with a null or without a direction have no score; the first of them by reference can be wanted.
            rest = np.setdiff1d(np.arange(len(ref)), to, assume_unique=True)
            most = rest[_first_names(name[rest], k)]
            r, c = np.repeat(at, len(most)), np.tile(most, len(at))
            add(r, c, np.zeros(len(r)), np.ones(len(r), bool))
        at = np.flatnonzero(~scored)
        most = _first_names(name, k)
        r, c = np.repeat(at, most.sum()), np.tile(np.flatnonzero(most), len(at))
        add(r, c, np.zeros(len(r)), np.ones(len(r), bool))
        rows, cols, scores, null = _best(*(np.concatenate(x) for x in zip(*got)), k)
        return pa.table({"query": query.take(pa.array(rows)), "ref": ref.take(pa.array(cols)), "score": pa.array(scores, mask=null)}).cast(schema)

    return run


def _first_names(names: np.ndarray, k: int) -> np.ndarray:
    """Which of sorted names are enough for k others than any one of them: the first k + 1 names."""
    if not len(names):
        return np.zeros(0, bool)
    place = np.cumsum(np.concatenate([[0], names[1:] != names[:-1]]))
    return (place <= k) & _first(names, k)
