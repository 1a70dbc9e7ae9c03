"""Boosting and forests of binned trees over one fold's cases, held as compact columns in one task.

The rules are those of Spark's trees: numeric columns in at most 32 bins by quantiles of the training rows, variance or Gini gain (for
0/1 labels both are the sum of s * s / n over the children), features drawn anew per node of a forest, Poisson weights per tree.
A category column holds its level, so that all of its 0/1 columns are counted at once, and of the codes only those held are read:
a case costs some 35 counts a level of the tree, however many 0/1 columns there are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

BINS = 32


def thresholds(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Up to BINS - 1 cuts between the distinct sorted values, all of them if they are few, else those nearest to equal shares."""
    values, counts = values[counts > 0], counts[counts > 0]
    between = (values[:-1] + values[1:]) / 2
    if len(between) < BINS:
        return between
    reached = np.cumsum(counts)
    stride = reached[-1] / BINS
    at = np.searchsorted(reached, stride * np.arange(1, BINS))
    nearer = (at > 0) & (np.abs(reached[np.maximum(at - 1, 0)] - stride * np.arange(1, BINS)) < np.abs(reached[at] - stride * np.arange(1, BINS)))
    return between[np.unique(np.minimum(at - nearer, len(between) - 1))]


class Cases:
    """Columns of bins and levels, and the (row, code) pairs. Features in order: numeric columns, levels of each category, codes."""

    def __init__(self, bins: list[np.ndarray], levels: list[np.ndarray], n_levels: list[int], rows: np.ndarray, codes: np.ndarray, n_codes: int):
        self.cols = [*bins, *levels]
        self.numeric, self.n_codes = len(bins), n_codes
        self.n = len(self.cols[0])
        self.table = np.column_stack(self.cols)
        self.widths = [BINS] * self.numeric + list(n_levels)
        self.starts = np.concatenate([[0], np.cumsum(self.widths)]).astype(np.int64)
        self.width = int(self.starts[-1]) + n_codes
        self.features = self.numeric + int(sum(n_levels)) + n_codes
        order = np.lexsort((codes, rows))
        self.rows, self.codes = rows[order].astype(np.int64), codes[order].astype(np.int64)
        self.held = self.rows * max(n_codes, 1) + self.codes
        self.by_code = self.rows[np.argsort(self.codes, kind="stable")]
        self.code_edges = np.concatenate([[0], np.cumsum(np.bincount(self.codes, minlength=n_codes))])

    def holders(self, code: int) -> np.ndarray:
        """The rows that hold a code."""
        return self.by_code[self.code_edges[code]:self.code_edges[code + 1]]

    def holds(self, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Whether the rows hold the codes."""
        key = at * max(self.n_codes, 1) + code
        place = np.searchsorted(self.held, key)
        return (place < len(self.held)) & (self.held[np.minimum(place, len(self.held) - 1)] == key) if len(self.held) else np.zeros(len(at), bool)

    def place(self, slot: int) -> tuple[int, int]:
        """(column, value) of a counted slot; column -1 for a code."""
        if slot >= self.starts[-1]:
            return -1, slot - int(self.starts[-1])
        c = int(np.searchsorted(self.starts, slot, side="right")) - 1
        return c, slot - int(self.starts[c])

    def inside(self, at: np.ndarray, slot: int) -> np.ndarray:
        """Which rows lie on the near side of a split: at or below the bin, or at the level, or with the code."""
        c, v = self.place(slot)
        if c < 0:
            return self.holds(at, np.full(len(at), v, np.int64))
        x = self.cols[c].take(at)
        return x <= v if c < self.numeric else x == v


class Reader:
    """Takes batches of cases in and keeps them compact: per batch the distinct values of a number and, per row, which it is."""

    def __init__(self, numeric: int, n_levels: list[int]):
        self.numeric, self.n_levels = numeric, n_levels
        self.ids: list[pa.Array] = []
        self.folds: list[pa.Array] = []
        self.fold_type: pa.DataType | None = None
        self.y: list[np.ndarray] = []
        self.values: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(numeric)]
        self.levels: list[list[np.ndarray]] = [[] for _ in n_levels]
        self.rows: list[np.ndarray] = []
        self.codes: list[np.ndarray] = []
        self.n = 0

    def add(self, batch: pa.RecordBatch, record_id: str, fold: str) -> None:
        self.ids.append(batch.column(record_id))
        self.folds.append(batch.column(fold))
        self.fold_type = batch.column(fold).type
        self.y.append(batch.column("__y").to_numpy(zero_copy_only=False))
        for i, kept in enumerate(self.values):
            known, which = np.unique(batch.column(f"__n{i}").to_numpy(zero_copy_only=False).astype(float), return_inverse=True)
            kept.append((known, which.astype(np.min_scalar_type(len(known)))))
        for i, kept in enumerate(self.levels):
            kept.append(batch.column(f"__c{i}").to_numpy(zero_copy_only=False).astype(np.min_scalar_type(self.n_levels[i])))
        held = batch.column("__held")
        sizes = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.rows.append(np.repeat(np.arange(batch.num_rows) + self.n, sizes))
        self.codes.append(held.flatten().to_numpy(zero_copy_only=False))
        self.n += batch.num_rows

    def _binned(self, kept: list[tuple[np.ndarray, np.ndarray]], order: np.ndarray, training: np.ndarray) -> np.ndarray:
        """Bins of a number in the given order; missing ones count as the exact median of the training rows."""
        known = np.unique(np.concatenate([v for v, _ in kept]))
        known = known[~np.isnan(known)]
        place = np.concatenate([np.where(np.isnan(v), len(known), np.searchsorted(known, v))[which] for v, which in kept])[order]
        counts = np.bincount(place[training], minlength=len(known) + 1)
        median, reached = 0.0, np.cumsum(counts[:-1])
        if len(known) and reached[-1]:
            middle = np.searchsorted(reached, np.array([(reached[-1] - 1) // 2, reached[-1] // 2]), side="right")
            median = float(known[middle].mean())
        merged, inverse = np.unique(np.append(known, median), return_inverse=True)
        cuts = thresholds(merged, np.bincount(inverse, counts))
        return np.searchsorted(cuts, np.append(known, median)).astype(np.uint8)[place]

    def parts(self, fold, used: list[int] | None, n_codes: int) -> tuple[Cases, np.ndarray, Cases, pa.Array]:
        """(training cases, their labels, cases of the fold, their ids), both in order of the id. used: the codes that enter."""
        ids = pa.chunked_array(self.ids).combine_chunks()
        order = pa.compute.sort_indices(ids).to_numpy()
        asked = np.asarray(pa.compute.equal(pa.chunked_array(self.folds).combine_chunks(), pa.scalar(fold, self.fold_type)).to_numpy(zero_copy_only=False), bool)[order]
        bins = [self._binned(kept, order, ~asked) for kept in self.values]
        levels = [np.concatenate(kept)[order] for kept in self.levels]
        back = np.empty(self.n, np.int64)
        back[order] = np.arange(self.n)
        rows, codes = back[np.concatenate(self.rows)], np.concatenate(self.codes).astype(np.int64)
        if used is not None:
            number = np.full(n_codes, -1, np.int64)
            number[used] = np.arange(len(used))
            rows, codes = rows[number[codes] >= 0], number[codes][number[codes] >= 0]
            n_codes = len(used)
        made = []
        for mask in (~asked, asked):
            number = np.cumsum(mask) - 1
            own = mask[rows]
            made.append(Cases([x[mask] for x in bins], [x[mask] for x in levels], self.n_levels, number[rows[own]], codes[own], n_codes))
        y = np.concatenate(self.y)[order]
        return made[0], y[~asked], made[1], ids.take(pa.array(order[asked]))


def gains(n: np.ndarray, s: np.ndarray, all_n: np.ndarray, all_s: np.ndarray) -> np.ndarray:
    """Gain of parting (n, s) from (all_n, all_s); -1 where a side is empty."""
    with np.errstate(divide="ignore", invalid="ignore"):
        g = s * s / n + (all_s - s) ** 2 / (all_n - n) - all_s * all_s / all_n
    return np.where((n > 1e-9) & (all_n - n > 1e-9), g, -1.0)


# ---------------------------------------------------------------- boosting

CELLS = 8192  # most combinations of values of columns that are counted as one; a node with fewer rows counts them apart


def joined(data: Cases) -> list[tuple[np.ndarray, list[int], list[int]]]:
    """(number of the combination, columns, how many values each has) of groups of columns, the widest first."""
    used = [int(x.max()) + 1 if data.n else 1 for x in data.cols]
    groups: list[list[int]] = []
    for c in sorted(range(len(used)), key=lambda c: -used[c]):
        fits = (m for m in groups if math.prod(used[i] for i in m) * used[c] <= CELLS)
        if (m := next(fits, None)) is None:
            groups.append([c])
        else:
            m.append(c)
    out = []
    for m in groups:
        dims = [used[c] for c in m]
        number = np.zeros(data.n, np.min_scalar_type(math.prod(dims)))
        for c, k in zip(m, dims, strict=True):
            number *= number.dtype.type(k)
            number += data.cols[c].astype(number.dtype)
        out.append((number, m, dims))
    return out


def _counts(data: Cases, groups: list[tuple[np.ndarray, list[int], list[int]]], at: np.ndarray | None, w: np.ndarray | None, g: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """(2, width): weight and weighted sum of g per slot over the rows `at` (all: None). w None: every row weighs 1. groups: joined()."""
    out = np.zeros((2, data.width))
    own_w, own_g = (w, g) if at is None else (None if w is None else w.take(at), g.take(at))
    if (data.n if at is None else len(at)) < CELLS:
        groups = [(x, [c], [data.widths[c]]) for c, x in enumerate(data.cols)]
    for x, columns, dims in groups:
        x = (x if at is None else x.take(at)).astype(np.intp)
        for row, v in zip(out, (own_w, own_g), strict=True):
            cells = np.bincount(x, v, math.prod(dims)).reshape(dims)
            for i, c in enumerate(columns):
                row[data.starts[c]:data.starts[c] + dims[i]] = cells.sum(axis=tuple(j for j in range(len(dims)) if j != i))
    if data.n_codes:
        if at is None:
            r, codes = data.rows, data.codes
        else:
            mark[at] = True
            hit = mark[data.rows]
            mark[at] = False
            r, codes = data.rows[hit], data.codes[hit]
        out[0, data.starts[-1]:] = np.bincount(codes, None if w is None else w[r], data.n_codes)
        out[1, data.starts[-1]:] = np.bincount(codes, g[r], data.n_codes)
    return out


def _best(data: Cases, counted: np.ndarray, n: float, s: float) -> int | None:
    side = counted.copy()
    k = data.numeric * BINS
    side[:, :k] = np.cumsum(counted[:, :k].reshape(2, data.numeric, BINS), axis=2).reshape(2, k)
    g = gains(side[0], side[1], n, s)
    slot = int(np.argmax(g))
    return slot if g[slot] > 1e-9 * max(n, 1.0) else None


def _add_tree(train: Cases, groups: list[tuple[np.ndarray, list[int], list[int]]], test: Cases, g: np.ndarray, w: np.ndarray | None, depth: int, step: float, f_train: np.ndarray, f_test: np.ndarray, mark: np.ndarray) -> None:
    """One regression tree on g, added to both scores. Of two children the smaller is counted, the other is what is left."""
    weighed = g if w is None else g * w
    nodes = [(None, np.arange(test.n), _counts(train, groups, None, w, weighed, mark))]
    for level in range(depth + 1):
        following = []
        for at, asked, counted in nodes:
            whole = slice(None) if at is None else at
            n = float(train.n if at is None and w is None else len(at) if w is None else w[whole].sum())
            s = float(weighed[whole].sum())
            slot = _best(train, counted, n, s) if level < depth else None
            if slot is None:
                f_train[whole] += step * s / n
                f_test[asked] += step * s / n
                continue
            at = np.arange(train.n) if at is None else at
            near, near_asked = train.inside(at, slot), test.inside(asked, slot)
            children = [at[near], at[~near]]
            if level + 1 < depth:
                less = int(len(children[0]) > len(children[1]))
                fewer = _counts(train, groups, children[less], w, weighed, mark)
                parts = [fewer, counted - fewer]
                if w is None:
                    parts[1][0] = np.round(parts[1][0])
                parts = parts[::-1] if less else parts
            else:
                parts = [None, None]
            following += [(children[0], asked[near_asked], parts[0]), (children[1], asked[~near_asked], parts[1])]
        nodes = following


def boosted(train: Cases, y: np.ndarray, w: np.ndarray | None, test: Cases, rounds: int, depth: int, step: float) -> np.ndarray:
    """Probabilities of test: trees on the negative gradient of log loss, the first one on the labels -1 and 1."""
    sign = 2.0 * y - 1
    f_train, f_test, mark = np.zeros(train.n), np.zeros(test.n), np.zeros(train.n, bool)
    groups = joined(train)
    for i in range(rounds):
        g = sign if i == 0 else 4 * sign / (1 + np.exp(2 * sign * f_train))
        _add_tree(train, groups, test, g, w, depth, 1.0 if i == 0 else step, f_train, f_test, mark)
    return 1 / (1 + np.exp(-2 * f_test))


# ---------------------------------------------------------------- forest

def _drawn(rng: np.random.Generator, nodes: int, features: int, k: int) -> np.ndarray:
    """(nodes, k) features without repeats per node (Floyd)."""
    out = np.empty((nodes, k), np.int64)
    for i, top in enumerate(range(features - k, features)):
        t = rng.integers(0, top + 1, nodes)
        out[:, i] = np.where((out[:, :i] == t[:, None]).any(axis=1), top, t)
    return out


def _rows_of(nodes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Positions of the rows of these nodes; rows lie in order of their node, from edges[node] to edges[node + 1]."""
    size = edges[nodes + 1] - edges[nodes]
    return np.repeat(edges[nodes] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


LARGE = 1024  # rows from which a node is worth a pass of its own over each column that it has drawn
ONE = float(1 << 26)  # a row's mass: how often its tree drew it, plus ONE times that if it is a positive; sums of both stay exact in a double


def _unpacked(mass: np.ndarray, own: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(weight, weight of the positives) of sums of masses; own: what a negative and a positive weigh."""
    ones = np.floor(mass / ONE)
    return (mass - ones * ONE - ones) * own[0] + ones * own[1], ones * own[1]


def _split_large(data: Cases, at: np.ndarray, mass: np.ndarray, whole: np.ndarray, here: np.ndarray | None, n: float, s: float, drawn: np.ndarray, own: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(gain, slot) of each feature drawn by one node with the rows `at`. whole: the mass of every row. here: which rows are the node's."""
    g, value = np.full(len(drawn), -1.0), np.where(drawn < data.numeric, 0, drawn + data.numeric * (BINS - 1))
    for j in np.flatnonzero(drawn < data.numeric):
        c = int(drawn[j])
        each = gains(*_unpacked(np.cumsum(np.bincount(data.cols[c].take(at), mass, BINS)), own), n, s)
        value[j], g[j] = c * BINS + each.argmax(), each.max()
    ones = np.flatnonzero(drawn >= data.numeric)
    cells, column = np.zeros(len(ones)), np.searchsorted(data.starts, value[ones], side="right") - 1
    for c in np.unique(column):
        mine = np.flatnonzero(column == c)
        level = value[ones[mine]] - data.starts[c]
        if c == len(data.cols):
            cells[mine] = [whole[r[here[r]]].sum() for r in map(data.holders, level)]
        elif data.widths[c] > 1:
            x = data.cols[c].take(at)
            cells[mine] = mass.take(np.flatnonzero(x == level[0])).sum() if len(mine) == 1 else np.bincount(x, mass, data.widths[c])[level]
    g[ones] = gains(*_unpacked(cells, own), n, s)
    return g, value


def _split_small(data: Cases, at: np.ndarray, node: np.ndarray, mass: np.ndarray, n: np.ndarray, s: np.ndarray, local: np.ndarray, chosen: np.ndarray, own: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(gain, slot) per node and feature drawn for it, for many nodes at once. at: rows in order of their node. Of a column only the
    rows are read whose node has drawn it or one of its levels."""
    nodes, edges = len(n), np.searchsorted(node, np.arange(len(n) + 1))
    marks = data.numeric * (BINS - 1)  # slot of a 0/1 column, less its number as a feature
    g, value = np.full(chosen.shape, -1.0), np.zeros(chosen.shape, np.int64)
    for c in range(data.numeric):
        r, j = np.nonzero(chosen == c)
        if not len(r):
            continue
        pos = _rows_of(r, edges)
        seat = np.repeat(np.arange(len(r)) * BINS, edges[r + 1] - edges[r]) + data.cols[c][at[pos]]
        near = _unpacked(np.cumsum(np.bincount(seat, mass[pos], len(r) * BINS).reshape(len(r), BINS), axis=1), own)
        each = gains(*near, n[r][:, None], s[r][:, None])
        value[r, j], g[r, j] = c * BINS + each.argmax(axis=1), each.max(axis=1)
    r, j = np.nonzero(chosen >= data.numeric)
    base, width = data.numeric * BINS, data.width - data.numeric * BINS
    value[r, j] = chosen[r, j] + marks
    seats = np.full(nodes * width, -1, np.int32)
    seats[r * width + value[r, j] - base] = np.arange(len(r))
    cells = np.zeros(len(r))
    for c in range(data.numeric, len(data.cols) + 1):
        first = int(data.starts[c])
        last = int(data.starts[c + 1]) if c < len(data.cols) else data.width
        if c < len(data.cols):
            drawn = np.zeros(nodes, bool)
            drawn[r[(value[r, j] >= first) & (value[r, j] < last)]] = True
            pos = _rows_of(np.flatnonzero(drawn), edges)
            seat = seats[node[pos] * width + (first - base) + data.cols[c][at[pos]]]
        elif data.n_codes:
            local[at] = np.arange(len(at))
            place = local[data.rows]
            local[at] = -1
            known = place >= 0
            pos = place[known]
            seat = seats[node[pos] * width + (first - base) + data.codes[known]]
        else:
            continue
        hit = np.flatnonzero(seat >= 0)
        if len(hit):
            cells += np.bincount(seat[hit], mass[pos[hit]], len(r))
    g[r, j] = gains(*_unpacked(cells, own), n[r], s[r])
    return g, value


def _split_nodes(data: Cases, at: np.ndarray, edges: np.ndarray, nodes: np.ndarray, held: np.ndarray, mass: np.ndarray, n: np.ndarray, s: np.ndarray, local: np.ndarray, rng: np.random.Generator, own: tuple[float, float], k: int) -> np.ndarray:
    """Slot of the best split per node of `nodes` among k features drawn for it, -1 where none gains. held: the masses of `at`;
    mass: of every row."""
    size = edges[nodes + 1] - edges[nodes]
    chosen = _drawn(rng, len(nodes), data.features, k)
    g, value = np.full(chosen.shape, -1.0), np.zeros(chosen.shape, np.int64)
    here = np.zeros(data.n, bool) if data.n_codes else None
    for i in np.flatnonzero(size >= LARGE):
        a, b = edges[nodes[i]], edges[nodes[i] + 1]
        if here is not None:
            here[at[a:b]] = True
        g[i], value[i] = _split_large(data, at[a:b], held[a:b], mass, here, n[i], s[i], chosen[i], own)
        if here is not None:
            here[at[a:b]] = False
    few = np.flatnonzero(size < LARGE)
    if len(few):
        pos = _rows_of(nodes[few], edges)
        g[few], value[few] = _split_small(data, at[pos], np.repeat(np.arange(len(few)), size[few]), held[pos], n[few], s[few], local, chosen[few], own)
    best, every = g.argmax(axis=1), np.arange(len(nodes))
    return np.where(g[every, best] > 1e-9 * n, value[every, best], -1)


def _near(data: Cases, at: np.ndarray, node: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Cases.inside() with a slot per node."""
    column = np.minimum(np.searchsorted(data.starts, slot, side="right") - 1, len(data.cols))
    column, value = column[node], (slot - data.starts[column])[node]
    x = data.table[at, np.minimum(column, len(data.cols) - 1)]
    out = np.where(column < data.numeric, x <= value, x == value)
    codes = np.flatnonzero(column == len(data.cols))
    out[codes] = data.holds(at[codes], value[codes])
    return out


def _parted(data: Cases, at: np.ndarray, edges: np.ndarray, nodes: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and edges of the children of these nodes, each parted at its slot: the far child, then the near one."""
    size = np.diff(edges)[nodes]
    few = np.flatnonzero(size < LARGE)
    pos, who = _rows_of(nodes[few], edges), np.repeat(few, size[few])
    near = _near(data, at[pos], who, slot)
    counts = np.zeros((len(nodes), 2), np.int64)
    counts[:, 1] = np.bincount(who[near], minlength=len(nodes))
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i in np.flatnonzero(size >= LARGE):
        mine = at[edges[nodes[i]]:edges[nodes[i] + 1]]
        inside = data.inside(mine, int(slot[i]))
        parts[int(i)] = mine[~inside], mine[inside]
        counts[i, 1] = len(parts[int(i)][1])
    counts[:, 0] = size - counts[:, 1]
    bounds = np.concatenate([[0], np.cumsum(counts.ravel())])
    out = np.empty(int(bounds[-1]), np.int64)
    for i, (far, close) in parts.items():
        out[bounds[2 * i]:bounds[2 * i + 1]], out[bounds[2 * i + 1]:bounds[2 * i + 2]] = far, close
    if len(few):
        out[_rows_of((2 * few[:, None] + [0, 1]).ravel(), bounds)] = at[pos][np.argsort(2 * who + near, kind="stable")]
    return out, bounds


def forest(train: Cases, y: np.ndarray, w: tuple[float, float] | None, test: Cases, trees: int, depth: int, seed: int, chunk: int = 2048, first: int = 0, last: int | None = None) -> np.ndarray:
    """Probabilities of test: mean share of positives in the leaves; of the trees from first to last only their part of it. w: what a negative and a positive weigh. Nodes are split level by
    level, `chunk` of them at once; a node's counts of rows and of positives are one sum of masses."""
    out, own = np.zeros(test.n), w or (1.0, 1.0)
    k = int(np.ceil(np.sqrt(train.features)))
    for t in range(first, trees if last is None else last):
        rng = np.random.default_rng([seed, t])
        mass = rng.poisson(1.0, train.n) * (1.0 + ONE * y)
        at, local = np.flatnonzero(mass > 0), np.full(train.n, -1, np.int64)
        edges, asked, asked_edges = np.array([0, len(at)]), np.arange(test.n), np.array([0, test.n])
        if not len(at):
            continue
        for level in range(depth + 1):
            held = mass.take(at)
            n, s = _unpacked(np.add.reduceat(held, edges[:-1]), own)
            slot = np.full(len(n), -1, np.int64)
            open_ = np.flatnonzero((s > 1e-9) & (n - s > 1e-9)) if level < depth else np.empty(0, np.int64)
            for i in range(0, len(open_), chunk):
                part = open_[i:i + chunk]
                slot[part] = _split_nodes(train, at, edges, part, held, mass, n[part], s[part], local, rng, own, k)
            ended, going = np.flatnonzero(slot < 0), np.flatnonzero(slot >= 0)
            out[asked[_rows_of(ended, asked_edges)]] += np.repeat(s[ended] / n[ended], np.diff(asked_edges)[ended])
            if not len(going):
                break
            at, edges = _parted(train, at, edges, going, slot[going])
            asked, asked_edges = _parted(test, asked, asked_edges, going, slot[going])
    return out / trees
