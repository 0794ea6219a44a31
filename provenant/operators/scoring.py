"""Scores of a block of chunks against all queries at once, inside a task: of each query only the n best of a block leave it.

A ranking meets every query with every chunk, but a table of such pairs is never made: chunks stay where they are read, queries are broadcast in bounded blocks,
and a task gives at most n rows a query for each block of chunks, fewer once it knows n better ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of a block of scores, products that are added at once, and vectors that a block holds: bounds of what a task holds.
CELLS, PRODUCTS, VECTORS = 1 << 21, 1 << 20, 4096
#: What rounding may make of a cosine.
SLACK = 1e-9


def sections(sizes: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum up to ``most`` at most, and that are ``rows`` at most, but of one row at least."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        to = min(max(to, at + 1), at + rows, len(sizes))
        yield at, to
        at = to


def first_of(group: np.ndarray, n: int) -> np.ndarray:
    """Which rows are among the first n of their group; groups stand together."""
    if not len(group):
        return np.zeros(0, bool)
    new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return np.arange(len(group)) - np.repeat(new, np.diff(np.append(new, len(group)))) < n


class Postings:
    """Queries' tokens: for each token the queries that have it, with weights."""

    def __init__(self, queries: np.ndarray, tokens: pa.Array, weights: np.ndarray):
        self.tokens = pc.unique(tokens)
        at = pc.index_in(tokens, value_set=self.tokens).to_numpy(zero_copy_only=False)
        order = np.argsort(at, kind="stable")
        self.query, self.weight = queries[order].astype(np.int64), weights[order].astype(np.float64)
        self.count = np.bincount(at, minlength=len(self.tokens)).astype(np.int64)
        self.start = np.cumsum(self.count) - self.count

    def found(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which values are tokens of queries, and which tokens these are."""
        at = pc.index_in(values, value_set=self.tokens)
        held = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False))
        return held, at.take(pa.array(held)).to_numpy(zero_copy_only=False).astype(np.int64)


def products(post: Postings, n_queries: int, rows: int, row: np.ndarray, token: np.ndarray, weight: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Inner products of some rows at a time with all queries (row, query), and which row is the first; occurrences (row, token, weight) are in order of rows."""
    bounds = np.searchsorted(row, np.arange(rows + 1))
    times = np.concatenate([[0], np.cumsum(post.count[token])])
    for a, b in sections(np.diff(times[bounds]), PRODUCTS, max(CELLS // max(n_queries, 1), 1)):
        lo, hi = bounds[a], bounds[b]
        count = post.count[token[lo:hi]]
        total = int(count.sum())
        if not total:
            continue
        at = np.repeat(post.start[token[lo:hi]] - (np.cumsum(count) - count), count) + np.arange(total)
        cell = np.repeat(row[lo:hi] - a, count) * n_queries + post.query[at]
        yield a, np.bincount(cell, np.repeat(weight[lo:hi], count) * post.weight[at], (b - a) * n_queries).reshape(b - a, n_queries)


def product_scorer(post: Postings, n_queries: int, n: int) -> Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """A function of rows' sides (in the order that decides ties, the later first) and occurrences (row, token, weight) in order of rows that gives (query, row, score) of what may be among
    the n largest positive inner products of a query and side."""
    floor = np.zeros((2, n_queries))

    def run(side: np.ndarray, row: np.ndarray, token: np.ndarray, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for a, score in products(post, n_queries, len(side), row, token, weight):
            for s in (0, 1):
                mine = np.flatnonzero(side[a : a + len(score)] == s)
                x = score[mine]
                r, q = np.nonzero((x > 0) & (x >= floor[s]))
                order = np.lexsort((-r, -x[r, q], q))
                r, q = r[order], q[order]
                kept = first_of(q, n)
                r, q = r[kept], q[kept]
                value = x[r, q]
                full = np.flatnonzero(np.bincount(q, minlength=n_queries) == n)
                last = np.searchsorted(q, full, "right") - 1
                floor[s, full] = np.maximum(floor[s, full], value[last])
                yield q, mine[r] + a, value

    return run


def exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added in order as ``functions.vectors.dot`` adds them."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def cosine_scorer(asked: np.ndarray, n: int, allowed: np.ndarray | None = None, least: np.ndarray | None = None) -> Callable[[np.ndarray, np.ndarray | None], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """A function of vectors (in the order that decides ties, the earlier first) and their lists that gives (query, row, score) of what may be among the n largest cosines.

    ``allowed`` (query, list) tells what is compared, and ``least`` a bound that the n-th score isn't below. A product of matrices finds candidates; their scores are computed as
    ``exact_dot`` does. Equal vectors are compared once.
    """
    norms = np.sqrt(exact_dot(asked, asked))
    unit = asked / norms[:, None]
    floor = np.full(len(asked), -np.inf) if least is None else least.copy()

    def meet(mine: np.ndarray, v: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Candidates among distinct vectors: queries, vectors, scores; best first for each query."""
        flat = (v / size[:, None]).T
        step = max(CELLS // max(len(v), 1), 1)
        for i in range(0, len(mine), step):
            q = mine[i : i + step]
            near = unit[q] @ flat
            near[np.isnan(near)] = np.inf
            over = near >= floor[q][:, None] - SLACK
            many = np.flatnonzero(over.sum(1) > 2 * n)
            if len(many):
                bar = -np.partition(-near[many], n - 1, axis=1)[:, n - 1]
                over[many] &= near[many] >= bar[:, None] - SLACK
            r, c = np.nonzero(over)
            score = np.concatenate([exact_dot(asked[q[r[j : j + 65_536]]], v[c[j : j + 65_536]]) for j in range(0, max(len(r), 1), 65_536)]) / (norms[q[r]] * size[c])
            yield q[r], c, score

    def block(rows: np.ndarray, v: np.ndarray, mine: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        one, where = np.unique(np.ascontiguousarray(v + 0.0).view(np.dtype((np.void, v.shape[1] * 8))).ravel(), return_inverse=True)
        one = one.view(np.float64).reshape(len(one), -1)
        order = np.argsort(where, kind="stable")
        order = order[first_of(where[order], n)]  # of equal vectors the first n
        copies = np.bincount(where[order], minlength=len(one))
        begin = np.cumsum(copies) - copies
        for q, c, score in meet(mine, one, np.sqrt(exact_dot(one, one))):
            times = copies[c]
            at = order[np.repeat(begin[c] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
            q, score = np.repeat(q, times), np.repeat(score, times)
            best = np.lexsort((at, np.where(np.isnan(score), -np.inf, -score), q))
            best = best[first_of(q[best], n)]
            q, at, score = q[best], at[best], score[best]
            full, held = np.unique(q, return_counts=True)
            full = full[held == n]
            last = np.searchsorted(q, full, "right") - 1
            floor[full] = np.fmax(floor[full], score[last])
            yield q, rows[at], score

    def run(v: np.ndarray, lists: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        with np.errstate(all="ignore"):
            if allowed is None:
                yield from block(np.arange(len(v)), v, np.arange(len(asked)))
            else:
                for x in np.unique(lists):
                    rows, mine = np.flatnonzero(lists == x), np.flatnonzero(allowed[:, x])
                    if len(mine):
                        yield from block(rows, v[rows], mine)

    return run
