"""Distances inside one task: numpy over Arrow batches, bounded memory.

Used by ``search``, where Spark decides which rows meet and ranks what is left.
This module measures, and drops the rows that cannot be among a question's best
k because the task has seen k better ones: at most k per question and batch stay.

Costs are "smaller is better" and rounded to ``DIGITS`` decimals, so that sums
taken in another order rank the same; equal costs go to the smaller key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DIGITS = 9
CELLS = 1 << 21  # questions x rows looked at together
NEAR_CELLS = 1 << 18  # the same where they are added up one by one: they and what they add stay in a core's cache


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and flat values of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        raise ValueError("NULL vector")
    offsets = column.offsets.to_numpy()
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    if values.null_count:
        raise ValueError("NULL inside a vector")
    return offsets - offsets[0], values.to_numpy(zero_copy_only=False)


def first_k(q: np.ndarray, order: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first ``k`` entries per ``q`` under the sort keys, and their ranks."""
    pos = np.lexsort((*reversed(order), q))
    new = np.r_[True, np.diff(q[pos]) != 0] if len(q) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return pos[rank < k], rank[rank < k]


def _above(bound: np.ndarray) -> np.ndarray:
    """The bound as float32, rounded upwards."""
    return np.nextafter(bound.astype(np.float32), np.float32(np.inf))


def _room(n: int) -> np.ndarray:
    """Marks of ``n`` cells."""
    return np.zeros(-(-n // 8), np.uint64)


def _marked(n: int, room: np.ndarray) -> np.ndarray:
    """Places of the marks of ``n`` cells, few as a rule: eight cells are looked at as one number."""
    some = np.flatnonzero(room[: -(-n // 8)])
    at = (some[:, None] * 8 + np.arange(8)).ravel()
    return at[room.view(bool)[at] & (at < n)]


def _places(part: np.ndarray, limit: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Flat places of the cells up to the limit of their row."""
    np.less_equal(part, limit[:, None], out=room.view(bool)[: part.size].reshape(part.shape))
    return _marked(part.size, room)


def _share(metric, like) -> None:
    if like is not None:
        for name in metric.HELD:
            setattr(metric, name, getattr(like, name))


class DenseL2:
    """Squared Euclidean distance between float vectors."""

    HELD = "x", "x_sq"

    def __init__(self, query_vectors):
        self.q = self._matrix(query_vectors)
        self.n = len(self.q)
        self.q_norm = np.sqrt(np.einsum("ij,ij->i", self.q, self.q, dtype=np.float64))

    def _matrix(self, column) -> np.ndarray:
        offsets, values = _flat(column)
        dims = np.unique(np.diff(offsets))
        if len(dims) > 1:
            raise ValueError(f"vectors of different lengths: {dims.tolist()}")
        dim = int(dims[0]) if len(dims) else 0
        return values.astype(np.float32, copy=False).reshape(len(offsets) - 1, dim)

    def load(self, column, like: DenseL2 | None = None) -> int:
        """Takes the rows to measure; those of a metric that has loaded them as they are."""
        _share(self, like)
        if like is None:
            self.x = self._matrix(column)
        if self.n and len(self.x) and self.x.shape[1] != self.q.shape[1]:
            raise ValueError(f"questions have {self.q.shape[1]} dimensions, rows {self.x.shape[1]}")
        if like is None:
            self.x_sq = np.einsum("ij,ij->i", self.x, self.x, dtype=np.float64)
        return len(self.x)

    def candidates(self, kth: np.ndarray, k: int, place: np.ndarray) -> Iterator[tuple]:
        """Yield (question, row, cost) arrays that contain every top-k pair.

        ``kth`` are costs to beat, ``place`` orders the rows by key. A float32 matrix product screens the pairs with an error allowance;
        what passes is measured again by direct differences in float64.
        """
        x, rows = self.x, None
        step = max(1, CELLS // max(1, len(x)))
        slack_unit = 4.0 * (x.shape[1] + 8) * np.finfo(np.float32).eps
        x_max = float(np.sqrt(self.x_sq.max()))
        against = self._against(x, self.x_sq)
        # Used by all steps: fresh pages would cost as much as the comparison.
        room = np.empty(min(step, self.n) * len(x), np.float32), _room(min(step, self.n) * len(x))
        for lo in range(0, self.n, step):
            q = self.q[lo : lo + step]
            q_norm = self.q_norm[lo : lo + step]
            slack = slack_unit * (q_norm + x_max) ** 2 + 10.0**-DIGITS
            limit = kth[lo : lo + step]
            qi, xi = self._screen(q, q_norm, against, limit, slack, k, room)
            if len(qi) > 8 * k * len(q) and rows is None:
                # Many copies of one vector: only the k smallest keys of each can win.
                rows = self._distinct_rows(k, place)
                x = self.x[rows]
                against = self._against(x, self.x_sq[rows])
                qi, xi = self._screen(q, q_norm, against, limit, slack, k, room)
            if len(qi):
                yield qi + lo, xi if rows is None else rows[xi], self._measure(q, x, qi, xi)

    @staticmethod
    def _against(x, x_sq) -> np.ndarray:
        """The other side of the product: a row's own square is one more dimension of it."""
        return np.concatenate([x.T, x_sq.astype(np.float32)[None, :]])

    @staticmethod
    def _screen(q, q_norm, against, limit, slack, k, room) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs that may be among a question's best k, by question."""
        # |x|^2 - 2qx, which orders a question's rows as the distance does.
        n = against.shape[1]
        part = room[0][: len(q) * n].reshape(len(q), n)
        np.matmul(np.concatenate([q * np.float32(-2), np.ones((len(q), 1), np.float32)], axis=1), against, out=part)
        own = q_norm**2
        near = _places(part, _above(limit + slack - own), room[1])
        if 8 * len(near) > part.size and len(near) > 4 * k * len(q) and n > k:
            # Too many to sort: the k-th of each question by selection.
            kth = np.partition(part, k - 1, axis=1)[:, k - 1].astype(np.float64)
            near = _places(part, _above(np.minimum(limit + slack - own, kth + 2 * slack)), room[1])
        elif len(near) > k * len(q):
            # Only what the k best of these leave open needs to be measured.
            qi, value = near // n, part.ravel()[near]
            order = np.lexsort((value, qi))
            count = np.bincount(qi, minlength=len(q))
            full = np.flatnonzero(count >= k)
            kth = np.full(len(q), np.inf)
            kth[full] = value[order[(np.cumsum(count) - count)[full] + k - 1]]
            near = near[value <= _above(kth + 2 * slack)[qi]]
        return near // n, near % n

    @staticmethod
    def _measure(q, x, qi, xi) -> np.ndarray:
        step = max(1, CELLS // max(1, x.shape[1]))
        parts = []
        for lo in range(0, len(qi), step):
            d = x[xi[lo : lo + step]].astype(np.float64) - q[qi[lo : lo + step]]
            parts.append((d * d).sum(axis=1))
        return np.round(np.concatenate(parts), DIGITS)

    def _distinct_rows(self, k: int, place: np.ndarray) -> np.ndarray:
        as_bytes = self.x.view(np.dtype((np.void, self.x.shape[1] * self.x.itemsize))).ravel()
        group = np.unique(as_bytes, return_inverse=True)[1].ravel()
        return np.sort(first_k(group, (place,), k)[0])


class Sums:
    """What some weights of questions add up to: common features by a matrix product, the others by posting lists."""

    def __init__(self, n: int, n_features: int, q: np.ndarray, feature: np.ndarray, weight: np.ndarray):
        self.n, self.n_features = n, n_features
        used = np.bincount(feature, minlength=n_features)
        room = CELLS // max(1, self.n)
        common = np.argsort(-used, kind="stable")[:room]
        common = common[used[common] * 32 > self.n]
        self.common_ix = np.full(n_features, -1)
        self.common_ix[common] = np.arange(len(common))
        in_common = self.common_ix[feature] >= 0
        self.dense = np.zeros((self.n, len(common)), np.float32)
        np.add.at(self.dense, (q[in_common], self.common_ix[feature[in_common]]), weight[in_common])
        self.slack = (len(common) + np.bincount(q[~in_common], minlength=1).max() + 16) * float(np.finfo(np.float32).eps)
        self._list(q[~in_common], feature[~in_common], weight[~in_common])

    def _list(self, q: np.ndarray, feature: np.ndarray, weight: np.ndarray) -> None:
        """Posting lists, those of about the same length as rows of one table: shorter ones end in weights of 0."""
        by_feature = np.argsort(feature.astype(np.min_scalar_type(self.n_features)), kind="stable")
        feature, q, weight = feature[by_feature], q[by_feature], weight[by_feature]
        count = np.bincount(feature, minlength=self.n_features)
        at = np.arange(len(feature)) - (np.cumsum(count) - count)[feature]
        # 1, 2, 3, 4, 6, 8, 12, 16 ...: a third of a table is padding at most.
        widths = np.unique([w << i for i in range(max(1, int(count.max(initial=0)).bit_length())) for w in (1, 3)])
        table = np.searchsorted(widths, count)
        self.table_of = np.where(count > 0, table, -1).astype(np.int8)
        listed = np.flatnonzero(count)
        listed = listed[np.argsort(self.table_of[listed], kind="stable")]
        lines = np.bincount(table[listed], minlength=len(widths))
        self.line_of = np.zeros(self.n_features, np.int64)
        self.line_of[listed] = np.arange(len(listed)) - np.repeat(np.cumsum(lines) - lines, lines)
        ends = np.append(0, np.cumsum(lines * widths))
        cell = ends[table[feature]] + self.line_of[feature] * widths[table[feature]] + at
        asked, weights = np.zeros(ends[-1], np.int64), np.zeros(ends[-1], np.float32)
        asked[cell], weights[cell] = q, weight
        self.tables = [tuple(x[lo:hi].reshape(-1, w) for x in (asked, weights)) for lo, hi, w in zip(ends[:-1], ends[1:], widths)]

    def of(self, n_rows: int, row: np.ndarray, feature: np.ndarray, weight: np.ndarray, room: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Rows x questions, within ``slack``; what is added up for a row lies together."""
        common = self.common_ix[feature]
        own = np.flatnonzero(common >= 0)
        mine = np.zeros((n_rows, self.dense.shape[1]), np.float32)
        mine[row[own], common[own]] = weight[own]
        total = mine @ self.dense.T
        flat, base, table = total.reshape(-1), row * self.n, self.table_of[feature]
        cells, sums = room
        held = 0
        for i, (asked, weights) in enumerate(self.tables):
            own, width = np.flatnonzero(table == i), asked.shape[1]
            line, step = self.line_of[feature[own]], max(1, NEAR_CELLS // width)
            for at in range(0, len(own), step):
                some, lines = own[at : at + step, None], line[at : at + step]
                to = held + len(some) * width
                cell, part = cells[held:to].reshape(-1, width), sums[held:to].reshape(-1, width)
                np.take(asked, lines, axis=0, out=cell, mode="clip")
                cell += base[some]
                np.take(weights, lines, axis=0, out=part, mode="clip")
                part *= weight[some]
                held = to
                if held >= NEAR_CELLS:
                    np.add.at(flat, cells[:held], sums[:held])
                    held = 0
        np.add.at(flat, cells[:held], sums[:held])
        return total


class SparseCosine:
    """Negative cosine between sparse vectors; pairs that share nothing are no hits.

    Features that many questions use go through a dense float32 matrix product, the long
    tail through posting lists, so a word found everywhere costs no pair list. Both screen the pairs with an error
    allowance; what passes is measured again in float64, over the features of the question.
    """

    HELD = "row", "feature", "weight", "rows", "cell", "cell_weight"

    def __init__(self, query_vectors, n_features: int):
        q, feature, weight, self.n = self._unit(query_vectors)
        self.n_features, self.rest = n_features, np.zeros(self.n)
        self.q_weights = feature, weight, np.searchsorted(q, np.arange(self.n + 1))
        self.sums, self.others = Sums(self.n, n_features, q, feature, weight), None
        self.slack, self.signed = self.sums.slack, bool(len(weight)) and weight.min() < 0

    @staticmethod
    def _unit(column):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        offsets, feature = _flat(column.field("indices"))
        weight = _flat(column.field("values"))[1].astype(np.float64)
        n = len(offsets) - 1
        row = np.repeat(np.arange(n), np.diff(offsets))
        norm = np.sqrt(np.bincount(row, weight * weight, minlength=n))[row]
        keep = norm > 0
        return row[keep], feature[keep].astype(np.int64), weight[keep] / norm[keep], n

    def load(self, column, like: SparseCosine | None = None) -> int:
        _share(self, like)
        if like is None:
            self.row, self.feature, self.weight, self.rows = self._unit(column)
            cell = self.row * self.n_features + self.feature
            self.cell, self.cell_weight = cell, self.weight
            if (cell[1:] < cell[:-1]).any():  # Spark ML lists features in order
                order = np.argsort(cell, kind="stable")
                self.cell, self.cell_weight = cell[order], self.weight[order]
        self.any_signed = self.signed or (bool(len(self.weight)) and self.weight.min() < 0)
        return self.rows

    def candidates(self, kth: np.ndarray, k: int, place: np.ndarray) -> Iterator[tuple]:
        per_slice = max(1, min(NEAR_CELLS // max(1, self.n), self.rows))
        half = 0.5 * 10.0**-DIGITS
        flat = np.zeros(max(1, min(CELLS // self.n_features, per_slice)) * self.n_features)
        widest = max(x.tables[-1][0].shape[1] for x in (self.sums, self.others or self.sums))
        room = (_room(self.n * per_slice), *(np.empty(NEAR_CELLS + max(NEAR_CELLS, widest), x) for x in (np.int64, np.float32)))
        for lo in range(0, self.rows, per_slice):
            hi = min(lo + per_slice, self.rows)
            # The costs to beat are lower with each slice that was passed on.
            floor, rest = np.maximum(-kth - 2 * half, half), self.rest
            a, b = np.searchsorted(self.row, [lo, hi])
            rows = hi - lo, self.row[a:b] - lo, self.feature[a:b], self.weight[a:b].astype(np.float32)
            score = self.sums.of(*rows, room[1:])
            marks = room[0].view(bool)[: score.size].reshape(score.shape)
            np.greater_equal(score, self._limit(floor - rest), out=marks)
            if self.others is not None and np.count_nonzero(marks) * 64 > score.size:
                # More are left open than are worth a look each: a pair has one of the features so far, or cannot be a hit.
                score += self.others.of(*rows, room[1:])
                rest = 0.0
                marks &= score >= self._limit(floor)
            if hi - lo > k and np.count_nonzero(marks) > 4 * k * self.n:
                kth_here = np.partition(score, hi - lo - k, axis=0)[hi - lo - k]
                marks &= score >= (kth_here - 4 * self.slack - rest).astype(np.float32)
            near = _marked(score.size, room[0])
            step = max(1, CELLS // 64)
            for at in range(0, len(near), step):
                q, x = near[at : at + step] % self.n, near[at : at + step] // self.n + lo
                exact = self._measure(q, x, flat)
                open_ = exact >= floor[q]
                if open_.any():
                    yield q[open_], x[open_], -np.round(exact[open_], DIGITS)

    def _limit(self, floor: np.ndarray) -> np.ndarray:
        """What sums must reach."""
        limit = (floor - self.slack).astype(np.float32)
        # Nothing in common, no hit.
        return limit if self.any_signed else np.maximum(limit, np.finfo(np.float32).smallest_subnormal)

    def _measure(self, q: np.ndarray, x: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Cosines of pairs, by ascending row: the weights of each question's features, looked up in ``flat``, all features of some rows."""
        feature, weight, start = self.q_weights
        count = start[q + 1] - start[q]
        pair = np.repeat(np.arange(len(q)), count)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count) + start[q][pair]
        wanted, found = x[pair] * self.n_features + feature[at], np.empty(len(pair))
        lo, ends = 0, np.cumsum(count)
        while lo < len(wanted):
            base = x[pair[lo]] * self.n_features
            hi = int(ends[np.searchsorted(x, x[pair[lo]] + len(flat) // self.n_features) - 1])
            a, b = np.searchsorted(self.cell, [base, base + len(flat)])
            flat[self.cell[a:b] - base] = self.cell_weight[a:b]
            found[lo:hi] = flat[wanted[lo:hi] - base]
            flat[self.cell[a:b] - base] = 0
            lo = hi
        return np.bincount(pair, weight[at] * found, minlength=len(q))


class SkippingSums(SparseCosine):
    """Negative sums over the common features of lists of weights, the cosine where these are of length one.

    Questions are lists of (feature, weight, most, skipped), rows of (feature, unit). Skipped features add no more than their ``most`` and
    are looked at for those pairs alone that the others leave open. A feature listed twice counts twice.
    """

    def __init__(self, query_vectors, n_features: int):
        self.n_features = n_features
        q, feature, weight, self.n = self._unit(query_vectors)
        skipped, most = (self.pairs.field(c).to_numpy(zero_copy_only=False) for c in ("skipped", "most"))
        own = np.repeat(np.arange(self.n), self.counts)
        self.rest = np.bincount(own[skipped], most[skipped], minlength=self.n)
        self.q_weights = feature, weight, np.searchsorted(q, np.arange(self.n + 1))
        open_ = ~skipped
        all_features, all_weights = (self.pairs.field(c).to_numpy() for c in ("feature", "weight"))
        self.sums, self.others = (Sums(self.n, n_features, own[x], all_features[x], all_weights[x]) for x in (open_, skipped))
        self.signed = bool(len(all_weights)) and all_weights.min() < 0
        self.unit_slack, self.longest = self.sums.slack + self.others.slack, self._length(q, weight)

    @staticmethod
    def _length(row: np.ndarray, weight: np.ndarray) -> float:
        return float(np.sqrt(np.bincount(row, weight * weight).max(initial=0)))

    def _unit(self, column):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        offsets = column.offsets.to_numpy()
        self.pairs, self.counts, n = column.values.slice(offsets[0], offsets[-1] - offsets[0]), np.diff(offsets), len(column)
        weight = self.pairs.field("weight" if self.pairs.type.get_field_index("unit") < 0 else "unit").to_numpy()
        cell = np.repeat(np.arange(n), self.counts) * self.n_features + self.pairs.field("feature").to_numpy()
        cell, at = np.unique(cell, return_inverse=True)
        return cell // self.n_features, cell % self.n_features, np.bincount(at.ravel(), weight, minlength=len(cell)), n

    def load(self, column, like: SkippingSums | None = None) -> int:
        n = super().load(column, like)
        self.slack = self.unit_slack * max(1.0, self.longest * self._length(self.row, self.weight))
        return n


class Contenders:
    """Picks the rows of each batch that may be among a question's best ``k``."""

    def __init__(self, metric, k: int, best: np.ndarray | None = None):
        """``best`` are costs of k known rows per question, or one bound of the k-th."""
        self.metric, self.k, self.place = metric, k, None
        if best is None:
            best = np.full(metric.n, np.inf)
        self.best = best if best.ndim == 2 else np.repeat(best[:, None], k, axis=1)

    def pick(self, keys: pa.Table, vectors, like: Contenders | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Yield (question, row, cost) for one batch; ``like`` has picked from the same one."""
        if len(keys) == 0 or self.metric.n == 0:
            return
        if like is not None and like.place is not None:
            self.metric.load(vectors, like.metric)
            self.place = like.place
        else:
            self.metric.load(vectors)
            by_key = pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in keys.column_names])
            self.place = np.empty(len(keys), dtype=np.int64)
            self.place[by_key.to_numpy()] = np.arange(len(keys))
        for q, row, cost in self.metric.candidates(self.best[:, -1], self.k, self.place):
            open_ = cost <= self.best[q, -1]
            q, row, cost = q[open_], row[open_], cost[open_]
            keep, rank = first_k(q, (cost, self.place[row]), self.k)
            q, row, cost = q[keep], row[keep], cost[keep]
            self._remember(q, rank, cost)
            yield q, row, cost

    def _remember(self, q: np.ndarray, rank: np.ndarray, cost: np.ndarray) -> None:
        asked, line = np.unique(q, return_inverse=True)
        new = np.full((len(asked), self.k), np.inf)
        new[line, rank] = cost
        both = np.concatenate([self.best[asked], new], axis=1)
        both.partition(self.k - 1, axis=1)
        self.best[asked] = np.sort(both[:, : self.k], axis=1)
