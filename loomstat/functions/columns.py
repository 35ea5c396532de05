"""Column expressions: scaling, positions of the triangle, affine maps, distances, formatting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_or_zero(v: Column) -> Column:
    """Non-finite values become 0, as on reading an image."""
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v)


def scaled(raw: Column, slope: float | Column, inter: float | Column) -> Column:
    """raw * slope + inter; a slope of 0 leaves values as they are."""
    slope, inter = (x if isinstance(x, Column) else F.lit(float(x)) for x in (slope, inter))
    return F.when(slope == 0, raw.cast("double")).otherwise(raw.cast("double") * slope + inter)


def tri_index(i: Column, j: Column, n: int | Column) -> Column:
    """Position of (i, j), i < j, in the row-major strict upper triangle of n rows."""
    n = n if isinstance(n, Column) else F.lit(n)
    i, j, n = i.cast("long"), j.cast("long"), n.cast("long")
    half = lambda x: F.call_function("div", x * (x - 1), F.lit(2).cast("long"))
    return half(n) - half(n - i) + j - i - 1


def tri_inverse(k: Column, n: int | Column) -> tuple[Column, Column]:
    """(i, j) of a position. The square root is a first guess, moved by whole numbers to the exact row."""
    n = (n if isinstance(n, Column) else F.lit(n)).cast("long")
    k = k.cast("long")
    half = lambda x: F.call_function("div", x * (x - 1), F.lit(2).cast("long"))
    row_start = lambda i: half(n) - half(n - i)
    guess = (n - 2 - F.floor(F.sqrt((-8 * k + 4 * n * (n - 1) - 7).cast("double")) / 2.0 - 0.5)).cast("long")
    low = F.when(row_start(guess) > k, guess - 1).otherwise(guess)
    i = F.when(row_start(low + 1) <= k, low + 1).otherwise(low)
    return i, k - row_start(i) + i + 1


def euclid(a: list[Column], b: list[Column]) -> Column:
    total = None
    for x, y in zip(a, b, strict=True):
        d = (x - y).cast("double")
        total = d * d if total is None else total + d * d
    return F.sqrt(total)


def chebyshev(a: list[Column], b: list[Column]) -> Column:
    return F.greatest(*(F.abs(x - y) for x, y in zip(a, b, strict=True)))


def edge_distances(a: str = "a", b: str = "b") -> tuple[Column, Column]:
    """Distances of the first and of the second endpoints of two edges."""
    ep = lambda t, k: [F.col(f"{t}.{c}{k}") for c in "ijk"]
    return euclid(ep(a, 1), ep(b, 1)), euclid(ep(a, 2), ep(b, 2))


def affine(m: list[list[float]], x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The first three rows of a 4 by 4 matrix applied to a point."""
    return tuple(F.lit(float(r[0])) * x + F.lit(float(r[1])) * y + F.lit(float(r[2])) * z + F.lit(float(r[3])) for r in m[:3])


def to_voxel(v: Column) -> Column:
    """Rounds half to even, as coordinates are rounded."""
    return F.bround(v.cast("double"), 0).cast("int")


def decimals(v: Column, n: int = 6) -> Column:
    return F.format_string(f"%.{n}f", v.cast("double"))


def spline_mid(a: Column, b: Column, c: Column, length: Column) -> Column:
    """Middle control point of a drawn edge: half way, moved by a tenth of its length along c."""
    return (a + b) / 2.0 + 0.1 * c * length


def below(p: Column, threshold: float, kind: str = "double") -> Column:
    """p < threshold, strictly; a FLOAT column is compared with the threshold as a FLOAT."""
    return p < F.lit(threshold).cast("float" if kind == "float" else "double")


def positive_side(t: Column) -> Column:
    """Positive values, and zero and NaN, which go to both sides."""
    return ~(t < 0) | F.isnan(t)


def negative_side(t: Column) -> Column:
    return ~(t > 0) | F.isnan(t)


def second_name(name: str, mark: str = "_tstat") -> str:
    """A name with a mark before its last ending."""
    stem, dot, ending = name.rpartition(".")
    return f"{stem}{mark}.{ending}" if dot and "/" not in ending else name + mark


def significant_name(name: str, threshold: float) -> str:
    """Name of the table of edges below a threshold, which is written without its leading zero and point."""
    stem, dot, ending = name.rpartition(".")
    return f"{stem if dot and '/' not in ending else name}_significant_p{f'{threshold:g}'.replace('0.', '')}.csv"


def int_list(text: str, last: int | None = None) -> list[int]:
    """A list such as [2,7..4,3..9(2),$]: values, ranges in either direction, steps, and $ for the last index."""
    body = text.strip()
    if body[:1] in "[{(" and body[-1:] in "]})" and body:
        body = body[1:-1]
    out: list[int] = []

    def value(s: str) -> int:
        if s == "$":
            if last is None:
                raise ValueError("$ needs a last index")
            return last
        return int(s)

    for item in filter(None, (x.strip() for x in body.split(","))):
        m = re.fullmatch(r"(-?\d+|\$)(?:\s*(?:\.\.|-)\s*(-?\d+|\$)(?:\s*\(\s*(-?\d+)\s*\))?)?", item)
        if not m:
            raise ValueError(f"not a list item: {item}")
        a = value(m[1])
        if m[2] is None:
            out.append(a)
            continue
        b = value(m[2])
        step = int(m[3]) if m[3] else (1 if b >= a else -1)
        if step == 0:
            raise ValueError("a step of 0")
        out += range(a, b + (1 if step > 0 else -1), step)
    return out
