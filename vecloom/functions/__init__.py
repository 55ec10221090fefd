"""Column functions over vectors, and NumPy kernels that give the same bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_l2(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance in doubles, added up from the first dimension to the last."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(squared_l2(a, b))


def triangle_cosine(uv: Column, uw: Column, vw: Column, squared: bool = True) -> Column:
    """Cosine of the angle at u of a triangle with the given (squared) side lengths; -1 where a side at u has no length."""
    den = 2 * F.sqrt(uv) * F.sqrt(uw) if squared else 2 * uv * uw
    num = uv + uw - vw if squared else uv * uv + uw * uw - vw * vw
    return F.when(den > 0, num / den).otherwise(F.lit(-1.0))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of point p from the segment a-b in the plane."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length))).otherwise(F.lit(0.0))
    return F.sqrt((px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2)


def hash_uniform(id_: Column | str, salt: int = 0) -> Column:
    """A number in (0, 1) from an integer id by a multiplicative hash that any SQL engine can repeat."""
    x = F.col(id_) if isinstance(id_, str) else id_
    x = F.pmod(x.cast("long") + F.lit(salt + 1), F.lit(1 << 31))  # so that the product fits a long
    return (F.pmod(x * F.lit(2654435761), F.lit(4294967296)) + F.lit(0.5)) / F.lit(4294967296.0)


def np_uniform(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """hash_uniform() of an array of integers."""
    x = (x + (salt + 1)) & (1 << 31) - 1
    return ((x * 2654435761 & (1 << 32) - 1) + 0.5) / 4294967296.0


def random_level(u: Column, degree: int, max_layers: int, norm: float | None = None) -> Column:
    """Layer of a node whose uniform number is u: floor(-ln(u) * norm), below max_layers; norm is 1 / ln(degree) if not given."""
    return F.least(F.floor(-F.log(u) * F.lit(1.0 / float(np.log(degree)) if norm is None else norm)), F.lit(max_layers - 1)).cast("int")


def block_d2(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All squared distances between rows of x and y, added in the order of squared_l2, so with equal bits."""
    out = np.zeros((len(x), len(y)))
    columns = np.ascontiguousarray(y.T)
    for at in range(0, len(x), 64):  # a few rows at a time stay in the processor's cache
        part, diff = out[at : at + 64], np.empty_like(out[at : at + 64])
        for k in range(x.shape[1]):
            np.subtract(x[at : at + 64, k, None], columns[k], out=diff)
            np.multiply(diff, diff, out=diff)
            part += diff
    return out


def row_d2(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances between equal rows of x and y, added in the order of squared_l2, so with equal bits."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        diff = x[:, k] - y[:, k]
        out += diff * diff
    return out


def near_d2(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All squared distances by one matrix product: fast, but rounded otherwise than squared_l2; good for choosing candidates."""
    centre = x.mean(axis=0) if len(x) else 0.0
    x, y = x - centre, y - centre
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T), 0.0)


class Near:
    """Squared distances from all rows of y by matrix products, which take a small part of block_d2's time; where numbers aren't finite by block_d2."""

    def __init__(self, y: np.ndarray) -> None:
        self.y, self.centre = y, y.mean(axis=0) if len(y) else np.zeros(y.shape[1])
        b = y - self.centre
        squares = (b * b).sum(axis=1)
        self.most = squares.max(initial=0.0)
        self.other = np.ascontiguousarray(np.hstack([-2 * b, squares[:, None], np.ones((len(b), 1))]).T)

    def to(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """(distances, slack) of rows of x: none is off squared_l2's by more than slack."""
        a = x - self.centre
        squares = (a * a).sum(axis=1)
        if not (np.isfinite(squares).all() and np.isfinite(self.most)):
            return block_d2(x, self.y), 0.0
        # each of the sums of products and of squares is off by its length times the unit roundoff, at most
        slack = 8 * (x.shape[1] + 8) * np.finfo(float).eps * (squares.max(initial=0.0) + self.most)
        return np.hstack([a, np.ones((len(a), 1)), squares[:, None]]) @ self.other, slack


def near_tiles(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray, float]]:
    """Squared distances of runs of rows of x from all of y, as (first row, distances, slack), see Near."""
    rows, near = max(1, (1 << 20) // max(len(y), 1)), Near(y)
    for at in range(0, len(x), rows):
        yield at, *near.to(x[at : at + rows])


def pairs_d2(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """row_d2 of rows i of x and j of y, a bounded number of them at a time."""
    out = np.zeros(len(i))
    for at in range(0, len(i), 1 << 15):
        out[at : at + (1 << 15)] = row_d2(x[i[at : at + (1 << 15)]], y[j[at : at + (1 << 15)]])
    return out
