"""Vector functions over arrays, in double precision and built-in expressions."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is zero, null where a vector is."""
    both = norm(a) * norm(b)
    return F.when(both == 0, F.lit(0.0)).otherwise(dot(a, b) / both)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def literal(v: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def well_formed(v: Column, dims: int) -> Column:
    return v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))


def fitted(v: Column, dims: int) -> Column:
    """Cut or filled with zeros to a length."""
    short = F.slice(F.coalesce(v, F.array().cast("array<double>")), 1, dims)
    return F.concat(short, F.array_repeat(F.lit(0.0), F.lit(dims) - F.size(short)))


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """A unit vector drawn from a generator seeded by the text: what stands in for a model that is not there."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            v = np.random.default_rng(int.from_bytes(hashlib.md5((t or "").encode()).digest()[:8], "big")).normal(size=dims)
            return (v / np.linalg.norm(v)).tolist()

        return texts.map(one)

    return run(text)


def repaired(v: Column, dims: int, fields: dict[str, Column]) -> tuple[Column, Column]:
    """The vector a row should have, and how it came by it: kept; cut or padded to the length; made from the first field that
    is not blank (`made from <name>`); or null, `missing`, without any."""
    name = F.coalesce(*(F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.lit(n)) for n, c in fields.items()), F.lit(None).cast("string"))
    text = F.coalesce(*(F.when(F.trim(F.coalesce(c, F.lit(""))) != "", c) for c in fields.values()))
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))
    how = F.when(usable & (F.size(v) == dims), "kept").when(usable & (F.size(v) > dims), "cut").when(usable, "padded").when(name.isNotNull(), F.concat(F.lit("made from "), name)).otherwise("missing")
    return F.when(usable, fitted(v, dims)).when(name.isNotNull(), hash_embedding(text, dims)), how


def index_lists(n: Column) -> Column:
    """How many lists an inverted-file index of n vectors should have."""
    return F.least(F.when(n < 100, 2).when(n < 1000, 10).otherwise(50), n)
