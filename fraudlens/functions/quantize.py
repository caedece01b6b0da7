"""Quantised vectors and integer distances as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DIMS, QUANTISED_LIMIT, SCALE


def quantize_one(value: Column) -> Column:
    """round(value * 10000), half away from zero, clamped to 16 bits before the cast (ANSI casts raise)."""
    return F.greatest(F.lit(-float(QUANTISED_LIMIT)), F.least(F.lit(float(QUANTISED_LIMIT)), F.round(F.nanvl(value, F.lit(0.0)) * SCALE))).cast("smallint")


def quantize(vector: Column) -> Column:
    return F.transform(vector, quantize_one)


def dequantize(vector: Column) -> Column:
    return F.transform(vector, lambda q: q / F.lit(float(SCALE)))


def squared_distance(a: Column, b: Column, dims: int = DIMS, scale: int = 1) -> Column:
    """Exact squared distance as bigint, unrolled so that it stays in generated code; a is scaled by `scale`."""
    terms = []
    for i in range(dims):
        d = a[i].cast("bigint") * scale - b[i].cast("bigint")
        terms.append(d * d)
    return reduce(add, terms)


def squared_distance_exact(a: Column, b: Column, dims: int = DIMS) -> Column:
    """Squared distance of the doubles a to the quantised b."""
    terms = []
    for i in range(dims):
        d = a[i] - b[i] / F.lit(float(SCALE))
        terms.append(d * d)
    return reduce(add, terms)


def box_lower_bound(query: Column, low: Column, high: Column, dims: int = DIMS) -> Column:
    """The least squared distance that a vector inside the box can have; 0 inside."""
    terms = []
    for i in range(dims):
        x, lo, hi = query[i].cast("bigint"), low[i].cast("bigint"), high[i].cast("bigint")
        d = F.greatest(lo - x, F.lit(0).cast("bigint"), x - hi)
        terms.append(d * d)
    return reduce(add, terms)
