"""Column expressions for 3-vectors, bivectors and multivectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str = "", names: tuple[str, str, str] = ("x", "y", "z")) -> Vec:
    return tuple(F.col(f"{prefix}{n}") for n in names)


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def scale(a: Vec, s: Column | float) -> Vec:
    return tuple(p * s for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def wedge(a: Vec, b: Vec) -> Vec:
    """Bivector components in the order xy, yz, zx."""
    return (a[0] * b[1] - a[1] * b[0], a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec, least: float = 1e-12) -> Vec:
    """The unit vector; 0 where the norm is at most ``least``."""
    return tuple(F.when(norm(a) > least, p / norm(a)).otherwise(0.0) for p in a)


def product_signs(signature: tuple[int, int, int], outer: bool = False) -> list[tuple[int, int, int, int]]:
    """(blade a, blade b, blade of the product, sign) of all products that are not 0; blades are bitmaps of axes.

    The sign counts the swaps that sort the axes and squares shared ones by the metric: +1, -1 or 0. ``outer``
    keeps only blades without a shared axis.
    """
    p, q, r = signature
    metric = [1] * p + [-1] * q + [0] * r
    out = []
    for a in range(1 << len(metric)):
        for b in range(1 << len(metric)):
            swaps = sum((a >> i + 1).bit_count() for i in range(len(metric)) if b >> i & 1)
            sign = -1 if swaps & 1 else 1
            for i, m in enumerate(metric):
                if a & b & 1 << i:
                    sign *= 0 if outer else m
            if sign:
                out.append((a, b, a ^ b, sign))
    return out


def geometric_product(a: Column, b: Column, signature: tuple[int, int, int], outer: bool = False) -> Column:
    """Product of two multivectors held as arrays indexed by blade bitmap; ``outer`` gives the wedge product."""
    terms: dict[int, list[Column]] = {}
    for i, j, k, sign in product_signs(signature, outer):
        terms.setdefault(k, []).append(F.get(a, F.lit(i)) * F.get(b, F.lit(j)) * F.lit(float(sign)))
    size = 1 << sum(signature)
    return F.array(*[sum(terms[k][1:], terms[k][0]) if k in terms else F.lit(0.0) for k in range(size)])


def multivector_sum(a: Column, b: Column, sign: float = 1.0) -> Column:
    """Sum of two multivectors, or their difference with ``sign`` -1; components that one lacks are 0."""
    return F.zip_with(a, b, lambda p, q: F.coalesce(p, F.lit(0.0)) + sign * F.coalesce(q, F.lit(0.0)))


def from_blade(bitmap: int, scale: Column | float = 1.0, axes: int = 3) -> Column:
    """The multivector of one blade times ``scale``."""
    value = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.array(*[value if k == bitmap else F.lit(0.0) for k in range(1 << axes)])


def longer_than(a: Vec, least: float = 1e-6) -> Column:
    """Whether a vector's magnitude is above ``least``: a filter that drops vectors that are as good as 0."""
    return norm(a) > least
