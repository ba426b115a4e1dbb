"""Trailing windows over many series at once, as array operations.

Series are the rows of a matrix, padded at the end; NaN is missing. A window is the last
``n`` columns including the current one.

Totals and moments: columns are cut into blocks of ``n``. A window is the rear of one block
and the front of the next, so it is one merge of a running result from the front and one
from the rear (means and co-moments merge as counts, means and centred sums). No value
depends on anything outside its window, and a constant window has variance zero.

Ranks and quantiles: the values are replaced by their ranks and stored as a wavelet matrix
(one bit of the rank at each level, stably parted into zeros and ones, with running
counts). The number of smaller values in a stretch, or its k-th value, is read level
by level for all windows together: about log2(values) steps whatever the window.

Exponential averages: a row maps the average before it to the average behind it by
y -> q y + b. Maps compose, so the rows of a block become one map; a scan over the
blocks gives what each starts with.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

BLOCK = 128


def _blocks(x: np.ndarray, n: int, fill: float) -> np.ndarray:
    """(series, block, place) of a matrix, padded to whole blocks."""
    series, length = x.shape
    count = max(1, -(-length // n))
    out = np.full((series, count * n), fill, dtype=x.dtype)
    out[:, :length] = x
    return out.reshape(series, count, n)


def lag(x: np.ndarray, n: int = 1) -> np.ndarray:
    out = np.full_like(x, np.nan)
    out[:, n:] = x[:, :-n] if n else x
    return out


def ema(x: np.ndarray, alpha: float, min_periods: int) -> np.ndarray:
    """``y = alpha x + (1 - alpha) y_before``, starting with the first value; nothing may be missing."""
    q, length = 1.0 - alpha, x.shape[1]
    added = alpha * x
    added[:, 0] = x[:, 0]
    b = _blocks(added, BLOCK, 0.0)
    local, at = np.empty_like(b), np.zeros(b.shape[:2])
    for k in range(BLOCK):
        at = q * at + b[:, :, k]
        local[:, :, k] = at
    begin, carry = np.zeros(b.shape[:2]), np.zeros(len(b))
    for j in range(b.shape[1]):
        begin[:, j] = carry
        carry = q ** BLOCK * carry + local[:, j, -1]
    out = (local + begin[:, :, None] * q ** np.arange(1, BLOCK + 1)).reshape(len(b), -1)[:, :length]
    out[:, :min_periods - 1] = np.nan
    return out


def _merge(a: tuple, b: tuple) -> tuple:
    """(count, mean x, mean y, co-moment) of two parts together."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy = b[1] - a[1], b[2] - a[2]
    return n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dy * a[0] * share


def _running(x: np.ndarray, y: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
    """Moments of the first 1, 2, ... places of each block."""
    out = tuple(np.zeros(x.shape) for _ in range(4))
    count, mx, my, c = (np.zeros(x.shape[:2]) for _ in range(4))
    for k in range(x.shape[2]):
        v = known[:, :, k]
        count = count + v
        dx = np.where(v, x[:, :, k] - mx, 0.0)
        dy = np.where(v, y[:, :, k] - my, 0.0)
        share = np.divide(1.0, count, out=np.zeros_like(count), where=count > 0)
        mx, my = mx + dx * share, my + dy * share
        c = c + dx * np.where(v, y[:, :, k] - my, 0.0)
        for o, now in zip(out, (count, mx, my, c), strict=True):
            o[:, :, k] = now
    return out


def moments(x: np.ndarray, n: int, y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(count, mean x, mean y, co-moment) of the pairs without a missing value in each window."""
    same, length = y is None, x.shape[1]
    x = _blocks(x, n, np.nan)
    y = x if same else _blocks(y, n, np.nan)
    known = ~(np.isnan(x) | np.isnan(y))
    x, y = np.where(known, x, 0.0), np.where(known, y, 0.0)
    front = _running(x, y, known)
    back = [b[:, :, ::-1] for b in _running(x[:, :, ::-1], y[:, :, ::-1], known[:, :, ::-1])]
    rear = []
    for b in back:  # the places behind k in the block before
        r = np.zeros_like(b)
        r[:, 1:, :-1] = b[:, :-1, 1:]
        rear.append(r)
    return tuple(o.reshape(len(o), -1)[:, :length] for o in _merge(tuple(rear), front))


def mean(x: np.ndarray, n: int, need: int | None = None) -> np.ndarray:
    count, m, _, _ = moments(x, n)
    return np.where(count >= max(1, n if need is None else need), m, np.nan)


def covariance(x: np.ndarray, n: int, y: np.ndarray | None = None, need: int | None = None) -> np.ndarray:
    """Sample covariance (variance without ``y``); NaN below ``need`` pairs."""
    count, _, _, c = moments(x, n, y)
    return np.where(count >= max(2, n if need is None else need), c / np.maximum(count - 1, 1), np.nan)


class Order:
    """Ranks of values in stretches of a sequence: a wavelet matrix."""

    def __init__(self, values: np.ndarray):
        self.values, rank = np.unique(values, return_inverse=True)
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(max(1, len(self.values).bit_length()) - 1, -1, -1):
            one = (rank >> bit) & 1 == 1
            zeros = np.concatenate([[0], np.cumsum(~one)])
            self.levels.append((bit, zeros, int(zeros[-1])))
            rank = np.concatenate([rank[~one], rank[one]])

    def below(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """How many of the places low <= i < high have a smaller rank."""
        count = np.zeros(len(low), dtype=np.int64)
        for bit, zeros, total in self.levels:
            a, b = zeros[low], zeros[high]
            one = (rank >> bit) & 1 == 1
            count += np.where(one, b - a, 0)
            low, high = np.where(one, total + low - a, a), np.where(one, total + high - b, b)
        return count

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of the places low <= i < high."""
        rank = np.zeros(len(low), dtype=np.int64)
        for bit, zeros, total in self.levels:
            a, b = zeros[low], zeros[high]
            one = k >= b - a
            rank |= one.astype(np.int64) << bit
            k = np.where(one, k - (b - a), k)
            low, high = np.where(one, total + low - a, a), np.where(one, total + high - b, b)
        return self.values[rank]


def _windows(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The known values in order, and for each cell the stretch of them in its window."""
    known = ~np.isnan(x)
    upto = np.concatenate([[0], np.cumsum(known.ravel())])
    cell = np.arange(x.size).reshape(x.shape)
    first = cell - np.minimum(np.arange(x.shape[1]), n - 1)
    return known, x[known], upto[first], upto[cell + 1]


def pct_rank(x: np.ndarray, n: int, min_periods: int) -> np.ndarray:
    """Average-tie percentile rank of the current value among those of its window."""
    known, values, low, high = _windows(x, n)
    out = np.full(x.shape, np.nan)
    if len(values):
        order, low, high = Order(values), low[known], high[known]
        rank = np.searchsorted(order.values, values)
        less = order.below(low, high, rank)
        equal = order.below(low, high, rank + 1) - less
        out[known] = np.where(high - low >= min_periods, (less + 0.5 * equal + 0.5) / (high - low), np.nan)
    return out


def median(x: np.ndarray, n: int) -> np.ndarray:
    """Median of the windows without a missing value."""
    _, values, low, high = _windows(x, n)
    out, full = np.full(x.shape, np.nan), high - low == n
    if full.any():
        order, low, high = Order(values), low[full], high[full]
        mid = [order.kth(low, high, np.full(len(low), k)) for k in ((n - 1) // 2, n // 2)]
        out[full] = (mid[0] + mid[1]) / 2
    return out


Matrices = dict[str, np.ndarray]
#: A step takes the matrices so far and returns new ones.
Step = Callable[[Matrices], Matrices]
