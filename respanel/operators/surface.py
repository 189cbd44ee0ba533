"""Differences between two probability surfaces, for a pack of items and a block of people inside a task."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle

# what runs inside tasks has to reach Python workers that do not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Columns of a block (more distinct first abilities share them), abilities of a column, terms of a curve.
COLUMNS, COLUMN_SIZE, TERMS = 1024, 1024, 96
#: Distance from a bound within which a difference is looked at itself; pairs looked at together.
CLOSE, TOGETHER = 1e-9, 500_000


def proposed(drawn: list, draws: int) -> tuple[float, float]:
    """Bounds that hold the median of what was drawn from, in all likelihood; counts (bin, n) of the differences by 2^16 bins of [0, 1]."""
    upto = np.cumsum([r["n"] for r in drawn])
    own = 0.5 + np.array([-1.0, 1.0]) * 3.0 / np.sqrt(draws)
    ends = np.searchsorted(upto, np.clip(own, 0.0, 1.0) * upto[-1]).clip(0, len(drawn) - 1)
    return drawn[ends[0]]["bin"] / 65536, (drawn[ends[1]]["bin"] + 1) / 65536


class Surface:
    """|P1 - P2| of a pack of items (a1, b1, a2, b2) and a block of people (t1, t2, w) of which each counts ``w`` times.

    People lie in columns of one first ability (of a narrow range of them,
    where a block holds more than ``COLUMNS``), in order of the second.
    """

    def __init__(self, items: np.ndarray, people: np.ndarray) -> None:
        self.a1, self.b1, self.a2, self.b2 = items.reshape(4, -1)
        t1, t2, w = people.reshape(3, -1)
        order = np.lexsort((t2, t1))
        start = np.flatnonzero(np.diff(t1[order], prepend=-np.inf))
        if len(start) > COLUMNS:
            start = np.unique(np.arange(COLUMNS) * len(order) // COLUMNS)
            order = np.concatenate([part[np.argsort(t2[part], kind="stable")] for part in np.split(order, start[1:])])
        start = [k for i, j in zip(start, [*start[1:], len(order)], strict=True) for k in range(i, j, COLUMN_SIZE)]
        self.t1, self.t2, self.w = t1[order], t2[order], w[order].astype(int)
        self.columns = list(zip(start, [*start[1:], len(order)], strict=True))
        self.before = np.concatenate([[0], np.cumsum(self.w)])
        # an item without slope has its cut beyond all abilities
        self.slope = np.where(self.a2 == 0, 1e-300, self.a2)

    def differences(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.abs(1 / (1 + np.exp(-(self.a1[i] * (self.t1[k] - self.b1[i])))) - 1 / (1 + np.exp(-(self.a2[i] * (self.t2[k] - self.b2[i])))))

    def draw(self, draws: int) -> tuple[np.ndarray, np.ndarray]:
        """(bin, n) of ``draws`` people for every item, weighted up to the block."""
        i = np.repeat(np.arange(len(self.a1)), min(draws, len(self.t1)))
        # no two packs draw the same people
        k = np.random.default_rng(zlib.crc32(self.b1.tobytes())).integers(0, len(self.t1), len(i))
        bins = (self.differences(i, k) * 65536).astype(int).clip(0, 65535)
        n = np.bincount(bins, self.w[k] * (len(self.t1) * len(self.a1) / len(i)), 65536)
        return np.flatnonzero(n), n[n > 0]

    def _range(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest a1 (t1 - b1) of each item in a column."""
        ends = [self.a1 * (t - self.b1) for t in {self.t1[i:j].min(), self.t1[i:j].max()}]
        return np.minimum(ends[0], ends[-1]), np.maximum(ends[0], ends[-1])

    def _place(self, i: int, j: int, logit: np.ndarray) -> np.ndarray:
        """Where the second curve of each item reaches a logit: that many of the column come before."""
        with np.errstate(over="ignore", invalid="ignore"):
            return i + np.searchsorted(self.t2[i:j], self.b2 + logit / self.slope)

    def _runs(self, low: float, high: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(weight below ``low``, items, people): what is surely below is weighed, pairs that may lie in [low, high] are given."""
        inner, outer = low - CLOSE, high + CLOSE
        below, held, items, people = 0, 0, [], []
        for i, j in self.columns:
            least, most = self._range(i, j)
            with np.errstate(over="ignore"):
                p, q = 1 / (1 + np.exp(-least)), 1 / (1 + np.exp(-most))
            with np.errstate(divide="ignore", invalid="ignore"):
                ends = [self._place(i, j, np.log(x / (1 - x))) for x in (np.clip(p - outer, 0, 1), np.clip(q + outer, 0, 1))]
                first, last = np.minimum(*ends), np.maximum(*ends)
                ends = [self._place(i, j, np.log(x / (1 - x))) for x in (np.clip(q - inner, 0, 1), np.clip(p + inner, 0, 1))]
            left, right = (np.clip(x, first, last) for x in (np.minimum(*ends), np.maximum(*ends)))
            none = q - p >= 2 * inner
            left[none] = right[none] = last[none]
            below += int((self.before[right] - self.before[left]).sum())
            for start, stop in ((first, left), (right, last)):
                some = np.flatnonzero(stop > start)
                n = stop[some] - start[some]
                items.append(np.repeat(some, n))
                people.append(np.repeat(start[some] - np.cumsum(n) + n, n) + np.arange(n.sum()))
                held += len(items[-1])
            if held > TOGETHER:
                yield below, np.concatenate(items), np.concatenate(people)
                below, held, items, people = 0, 0, [], []
        yield below, np.concatenate([np.zeros(0, int), *items]), np.concatenate([np.zeros(0, int), *people])

    def counted(self, low: float, high: float, bins: int) -> tuple[np.ndarray, ...]:
        """(bin, n, low, high): weight, least and greatest difference of the bins of [low, high], and of -1 for those below."""
        width = (high - low) / bins
        n, least, most = np.zeros(bins, int), np.full(bins, np.inf), np.full(bins, -np.inf)
        under = 0
        for below, i, k in self._runs(low, high):
            d, w = self.differences(i, k), self.w[k]
            under += below + int(w[d < low].sum())
            inside = (d >= low) & (d <= high)
            d, w = d[inside], w[inside]
            at = np.minimum((d - low) / width, bins - 1).astype(int) if width > 0 else np.zeros(len(d), int)
            np.add.at(n, at, w)
            np.minimum.at(least, at, d)
            np.maximum.at(most, at, d)
        own = np.flatnonzero(n)
        return np.append(own, -1), np.append(n[own], under), np.append(least[own], np.nan), np.append(most[own], np.nan)

    def listed(self, low: float, high: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(d, w) of the differences in [low, high]."""
        for _, i, k in self._runs(low, high):
            d = self.differences(i, k)
            inside = (d >= low) & (d <= high)
            values, at = np.unique(d[inside], return_inverse=True)
            n = np.zeros(len(values), int)
            np.add.at(n, at, self.w[k][inside])
            yield values, n

    def outermost(self) -> np.ndarray:
        """People whom nobody exceeds in both abilities, in one of the four directions: the largest difference is among theirs."""
        found = []
        for s in (1, -1):
            for z in (1, -1):
                order = np.lexsort((-z * self.t2, -s * self.t1))
                t = z * self.t2[order]
                found.append(order[t > np.concatenate([[-np.inf], np.maximum.accumulate(t)[:-1]])])
        return np.unique(np.concatenate(found))

    def sums(self) -> tuple[list[float], list[float]]:
        """(total, high): sum and maximum of the differences."""
        high, edge, items = 0.0, self.outermost(), np.arange(len(self.a1))
        for k in range(0, len(edge), 256):
            high = max(high, float(self.differences(items[:, None], edge[None, k : k + 256]).max()))
        total, steep = 0.0, np.zeros(len(self.a1), bool)
        whole, single = Curves(self.a2, self.b2, self.t2, self.w), all(self.t1[i:j].min() == self.t1[i:j].max() for i, j in self.columns)
        other = None if single else Curves(self.a1, self.b1, self.t1, self.w)
        steep = whole.steep if single else whole.steep | other.steep
        smooth, sign = ~steep, np.sign(self.slope)
        for i, j in self.columns:
            least, most = self._range(i, j)
            # the second curve is below the first up to one end and above it from the other
            ends = self._place(i, j, least), self._place(i, j, most)
            first, last = np.minimum(*ends), np.maximum(*ends)
            second = whole.split(i, j, first, last)
            if single:
                with np.errstate(over="ignore"):
                    p = 1 / (1 + np.exp(-least))
                one = p * (self.before[first] + self.before[last] - self.before[i] - self.before[j])
            else:
                one = other.split(i, j, first, last)
            total += float((sign * (one - second))[smooth].sum())
            some = np.flatnonzero(smooth & (last > first))
            n = last[some] - first[some]
            pairs = np.repeat(some, n), np.repeat(first[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
            total += float((self.differences(*pairs) * self.w[pairs[1]]).sum())
            for own in np.array_split(np.flatnonzero(steep), -(-int(steep.sum()) // 256)) if steep.any() else ():
                total += float((self.differences(own[:, None], np.arange(i, j)[None, :]) * self.w[i:j]).sum())
        return [total], [high]


class Curves:
    """Sums of w P over the first so many of an ordered list of abilities, for the logistic curves of many items.

    A curve is a polynomial over the range of the abilities, and the sums of
    each of its terms are known up to every place. Steep curves need too many
    terms and are left to their callers.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, theta: np.ndarray, w: np.ndarray) -> None:
        centre, half = (theta.max() + theta.min()) / 2, max((theta.max() - theta.min()) / 2, 1e-9)
        # the curve is analytic in an ellipse about the range that ends at its pole, pi / a away; terms fall like its axes' sum
        reach = np.arcsinh(np.pi / np.maximum(np.abs(a) * half, 1e-9))
        self.steep = ~(reach * TERMS >= 32.0)
        terms = int(np.ceil(32.0 / reach[~self.steep].min(initial=32.0))) + 1
        angle = (np.arange(terms) + 0.5) * np.pi / terms
        with np.errstate(over="ignore"):
            at = 1 / (1 + np.exp(-(a[:, None] * (centre + half * np.cos(angle)[None, :] - b[:, None]))))
        self.terms = at @ np.cos(np.outer(angle, np.arange(terms))) * (np.where(np.arange(terms), 2.0, 1.0) / terms)
        x = ((theta - centre) / half).clip(-1, 1)
        sums = np.zeros((len(theta) + 1, terms))
        np.cumsum(np.cos(np.arccos(x)[:, None] * np.arange(terms)) * w[:, None], axis=0, out=sums[1:])
        self.sums = sums

    def _upto(self, place: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.terms, self.sums[place])

    def split(self, i: int, j: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For every item the sum over places i to its ``first`` less that over its ``last`` to j."""
        ends = 2 * self._upto(first) if np.array_equal(first, last) else self._upto(first) + self._upto(last)
        return ends - self.terms @ (self.sums[i] + self.sums[j])
