"""Exact neighbours within a block of cases without a comparison of all pairs (tiles).

The cases of a block lie in strips: those of equal nominal codes, sorted along one numeric feature.  The nominal
part of the distance from a query to a strip is one number, and along the sorted feature the rest grows with the
difference, so for a query

1. the cases next to it in the strips of the nearest codes give a radius: the k-th of their distances, beyond
   which none of its first k lies;
2. of each strip whose nominal part lies within the radius it is compared with the stretch that the radius does
   not rule out.  Where that is much, the cases next to it in all these strips give a closer radius first;
3. a query that a quarter of the block or more is left for is compared with all of it.

A case or query without the sorted feature costs 1 there: such cases are strips of their own, taken whole.
Distances are summed as in :func:`casediff.operators.knn._exact_sq`, feature by feature.
"""

from __future__ import annotations

import numpy as np

from casediff.operators import knn

#: Cases of a block from which on strips are made, and cases that a strip has at least, on average.
MIN_CASES, STRIP_ROWS = 1024, 16
# Room for rounding: ranks go by 12 digits of the squared distance.
_ROOM = 1 + 1e-9


def suits(spec, width: int, match: bool) -> bool:
    """Whether strips can leave out work: not for a random order, nor where one matrix product compares all."""
    blas = spec.numeric == "sq" and not spec.tables and width >= knn._BLAS_MIN_DIM
    return bool(width) and not match and spec.random_seed is None and not blas


class Strips:
    """Cases by nominal codes and along the feature that spreads most."""

    def __init__(self, cid: np.ndarray, cx: np.ndarray, cc: np.ndarray):
        self.cid, self.cx, self.cc = cid, cx, cc
        with np.errstate(all="ignore"):
            there = ~np.isnan(cx)
            spread = [np.std(cx[there[:, j], j]) if there[:, j].any() else 0.0 for j in range(cx.shape[1])]
        self.axis = int(np.argmax(np.nan_to_num(spread)))
        along = cx[:, self.axis]
        number = np.isnan(along).astype(np.int64)
        for f in range(cc.shape[1]):
            value = np.unique(cc[:, f], return_inverse=True)[1]
            number = np.unique(number * (value.max(initial=0) + 1) + value, return_inverse=True)[1]
        self.order = np.lexsort((along, number))
        number = number[self.order]
        self.along = along[self.order]
        self.begin = np.flatnonzero(np.r_[True, np.diff(number) != 0])
        self.end = np.r_[self.begin[1:], len(cid)]
        self.codes = cc[self.order[self.begin]]
        self.missing = np.isnan(self.along[self.begin])

    @classmethod
    def of(cls, cid, cx, cc, least: int) -> "Strips | None":
        """The strips of a block, or None if it is small or its strips are."""
        found = cls(cid, cx, cc) if len(cid) >= max(least, 1) else None
        return found if found is not None and len(found.begin) * STRIP_ROWS <= len(cid) else None

    def nearest(self, qid, qx, qc, qg, cg, k: int, exclude_self: bool, spec, counter=None):
        """(query row, case row, d2, rounded d2, rank) of the first k of every query, as ``knn._nearest`` gives them."""
        # so many that the cases next to them in all strips are a chunk
        step = max(1, knn._CHUNK_ELEMS // (2 * (k + exclude_self) * len(self.begin)))
        out = []
        for at in range(0, len(qid), step):
            sl = slice(at, at + step)
            asked = _Asked(self, qid[sl], qx[sl], qc[sl], None if qg is None else qg[sl], cg, k, exclude_self, spec, counter)
            out += [(rows + at, *rest) for rows, *rest in asked.found()]
        if not out:
            none = np.empty(0, dtype=np.int64)
            return none, none, none.astype(float), none.astype(float), none
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class _Asked:
    """Queries that meet a block together."""

    def __init__(self, strips: Strips, qid, qx, qc, qg, cg, k, exclude_self, spec, counter):
        self.s, self.qid, self.qx, self.qc, self.qg, self.cg = strips, qid, qx, qc, qg, cg
        self.k, self.exclude_self, self.spec, self.counter = k, exclude_self, spec, counter
        self.want = k + exclude_self
        if qc.shape[1]:
            codes, which = np.unique(qc, axis=0, return_inverse=True)
            self.which = which.reshape(-1)
        else:
            codes, self.which = qc[:1], np.zeros(len(qid), dtype=np.int64)
        #: nominal parts by (codes of a query, strip), and their sum
        self.parts = [table.matrix(codes[:, f], strips.codes[:, f]) if hasattr(table, "matrix") else
                      np.asarray(table)[codes[:, f][:, None], strips.codes[:, f][None, :]] for f, table in enumerate(spec.tables)]
        self.nominal = np.zeros((len(codes), len(strips.begin)))
        for part in self.parts:
            self.nominal += part
        self.at = qx[:, strips.axis]
        self.lost = np.isnan(self.at)

    def found(self):
        radius = self._kth(*self._next_to(*self._first_strips()))
        asked = np.arange(len(self.qid))
        rows, strip, lo, hi = self._stretches(asked, radius)
        left = np.bincount(rows, hi - lo, len(asked))
        wide = left > 4 * self.want * np.bincount(rows, minlength=len(asked))
        if wide.any():
            some = wide[rows]
            radius = np.minimum(radius, self._kth(*self._next_to(rows[some], strip[some])))
            closer = self._stretches(asked[wide], radius)
            rows, strip, lo, hi = (np.concatenate([x[~some], y]) for x, y in zip((rows, strip, lo, hi), closer, strict=True))
            left = np.bincount(rows, hi - lo, len(asked))
        whole = left * 4 >= len(self.s.cid)
        if whole.any():
            yield self._with_all(np.flatnonzero(whole))
        some = ~whole[rows]
        rows, strip, lo, hi = (x[some] for x in (rows, strip, lo, hi))
        order = np.argsort(rows, kind="stable")
        rows, strip, lo, hi = (x[order] for x in (rows, strip, lo, hi))
        # whole queries at a time
        left = np.where(whole, 0, left)
        group = ((np.cumsum(left) - left) // knn._CHUNK_ELEMS)[rows]
        edges = np.flatnonzero(np.r_[True, np.diff(group) != 0, True]) if len(rows) else []
        for i, j in zip(edges, edges[1:]):
            r, c, d2 = self._distances(rows[i:j], strip[i:j], lo[i:j], hi[i:j])
            near = knn._digits(d2) <= radius[r]
            yield knn._select(r[near], c[near], d2[near], self.s.cid, self.k, False)

    def _first_strips(self):
        """(query, strip): for every query the strips of the nearest codes, until they have as many cases as it wants."""
        near = self.nominal + self.s.missing
        order = np.argsort(near, axis=1, kind="stable")
        size = (self.s.end - self.s.begin)[order]
        first = np.zeros(near.shape, dtype=bool)
        np.put_along_axis(first, order, np.cumsum(size, axis=1) - size < self.want, axis=1)
        return np.nonzero(first[self.which])

    def _next_to(self, rows, strip):
        """Distances to the cases next to each query in a strip."""
        begin, end = self.s.begin[strip], self.s.end[strip]
        mid = self._bisect(begin, end, self.at[rows], False)
        return self._distances(rows, strip, np.maximum(begin, mid - self.want), np.minimum(end, mid + self.want))

    def _stretches(self, asked, radius):
        """(query, strip, begin, end): the cases of each strip that the radius does not rule out."""
        bound = radius[asked] * _ROOM
        nominal = self.nominal[self.which[asked]]
        least = nominal + (self.lost[asked][:, None] | self.s.missing[None, :])
        i, strip = np.nonzero(least <= bound[:, None])
        rows = asked[i]
        reach = np.sqrt(np.maximum(bound[i] - nominal[i, strip], 0.0))
        whole = self.lost[rows] | self.s.missing[strip]
        if self.spec.numeric == "clip":
            whole |= reach * _ROOM >= 1.0
        begin, end, at = self.s.begin[strip], self.s.end[strip], self.at[rows]
        reach = reach * _ROOM + 1e-14 * np.abs(at) + 1e-150
        lo = np.where(whole, begin, self._bisect(begin, end, at - reach, False))
        hi = np.where(whole, end, self._bisect(begin, end, at + reach, True))
        return rows, strip, lo, np.maximum(lo, hi)

    def _bisect(self, begin, end, value, right: bool):
        """The place of each value in its own sorted stretch."""
        lo, hi = begin.copy(), end.copy()
        along = self.s.along
        for _ in range(int(np.max(end - begin, initial=0)).bit_length()):
            mid = np.minimum((lo + hi) >> 1, len(along) - 1)
            after = (along[mid] <= value) if right else (along[mid] < value)
            go, stay = (lo < hi) & after, (lo < hi) & ~after
            lo, hi = np.where(go, mid + 1, lo), np.where(stay, mid, hi)
        return lo

    def _distances(self, rows, strip, lo, hi):
        """(query, case, d2) of all pairs of the stretches, without those that are no neighbours whatever their distance."""
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        rows, strip, cols = np.repeat(rows, size), np.repeat(strip, size), self.s.order[at]
        if self.counter is not None:
            self.counter.add(len(rows))
        good = np.ones(len(rows), dtype=bool)
        if self.exclude_self:
            good &= self.qid[rows] != self.s.cid[cols]
        if self.qg is not None:
            good &= self.qg[rows] != self.cg[cols]
        if not good.all():
            rows, strip, cols = rows[good], strip[good], cols[good]
        d2 = np.zeros(len(rows))
        for j in range(self.qx.shape[1]):
            diff = self.qx[rows, j] - self.s.cx[cols, j]
            if self.spec.numeric == "clip":
                diff = np.minimum(np.abs(diff), 1.0)
            diff[np.isnan(diff)] = 1.0
            d2 += diff * diff
        for part in self.parts:
            d2 += part[self.which[rows], strip]
        return rows, cols, d2

    def _kth(self, rows, cols, d2):
        """The k-th rounded distance of every query, infinite for those with fewer."""
        key = knn._digits(d2)
        order = np.lexsort((key, rows))
        n = np.bincount(rows, minlength=len(self.qid))
        first = np.cumsum(n) - n
        out = np.full(len(self.qid), np.inf)
        enough = n >= self.k
        out[enough] = key[order][first[enough] + self.k - 1]
        return out

    def _with_all(self, some):
        s = self.s
        rows, *rest = knn._nearest(self.qid[some], self.qx[some], self.qc[some], None if self.qg is None else self.qg[some],
                                   s.cid, s.cx, s.cc, self.cg, self.k, self.exclude_self, self.spec, False, self.counter)
        return some[rows], *rest
