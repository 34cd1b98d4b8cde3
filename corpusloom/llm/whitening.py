"""Whitening of embeddings by sums over the upper triangle of dimension pairs.

Entries become whole numbers ``x = floor(1024 * c) + 100000``. One aggregation
sums every dimension; a second one, made of generated SQL expressions, sums the
centred product of every pair of dimensions ``i <= j``. The driver puts the
d x d sums together and LAPACK takes the components. Tasks are added up in
``SLOTS`` groups by Spark; the driver adds the ``SLOTS`` rows, however large
the table is.

Edge cases: rows whose vector is null or holds null, NaN or infinite entries
have no place; of the others the most frequent length counts (of equally
frequent ones the longest), rows of another length have no place either. Null
and repeated vec_ids are rows of their own. A component without variance (all
rows equal, or more components than rank) has null ``whitened`` and explained
0. An empty table, or one without a usable row, gives no rows. Further columns
of any name are ignored. Entries beyond the range of a long stop the query
with Spark's overflow error.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 64
MOST = 4096  # pair sums in one aggregation: all of a triangle of up to 89 dimensions
FLAT = 1e-12  # variance below this share of the total is none


class Model:
    """n, per dimension sums, least and largest x; eigenvalues and components
    (rows) of the covariance."""

    def __init__(self, n: int, sums: list[int], low: list[int], high: list[int], cov: np.ndarray):
        self.n, self.sums, self.low, self.high = n, sums, low, high
        values, vectors = np.linalg.eigh(cov)
        self.values, self.vectors, self.trace = values[::-1], vectors[:, ::-1].T, float(np.trace(cov))
        top = np.abs(self.vectors).argmax(axis=1)
        self.vectors = self.vectors * np.sign(self.vectors[np.arange(len(sums)), top])[:, None]


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """Key and ``x0 ... x(d-1)`` as longs of the rows that have a place, and d."""
    base = df.select(F.col(key).alias("key"), F.col(vector).alias("v"))
    wrong = F.exists("v", lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")))
    whole = base.where(F.col("v").isNotNull() & ~wrong & (F.size("v") > 0))
    lengths = whole.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    # no entry is null here; saying so to Catalyst keeps the generated code short
    x = [F.coalesce(F.floor(F.get("v", F.lit(i)).cast("double") * 1024.0) + 100000, F.lit(0).cast("long")).alias(f"x{i}") for i in range(d)]
    return whole.where(F.size("v") == d).select("key", *x), d


def added(df: DataFrame, values: list) -> list[tuple]:
    """Every value's aggregates over the slots of tasks: ``SLOTS`` numbers each at most."""
    slot = F.pmod(F.spark_partition_id(), F.lit(SLOTS)).alias("slot")
    part = df.groupBy(slot).agg(*[v.alias(f"s{k}") for k, v in enumerate(values)]).collect()
    return [tuple(r[k + 1] for r in part) for k in range(len(values))]


def centred(sums: list[int], n: int) -> list:
    """``x - S / n`` of every dimension, the whole part taken off exactly."""
    return [((F.col(f"x{i}") - F.lit(s // n)).cast("double") - F.lit((s % n) / n)).alias(f"c{i}") for i, s in enumerate(sums)]


def fit(rows: DataFrame, d: int) -> Model | None:
    """Sums, covariance (divisor n) and its components; None without rows."""
    if not d:
        return None
    each = added(rows, [F.count("*"), *[f(f"x{i}") for f in (F.sum, F.min, F.max) for i in range(d)]])
    n, sums, low, high = sum(each[0]), [sum(v) for v in each[1 : d + 1]], [min(v) for v in each[d + 1 : 2 * d + 1]], [max(v) for v in each[2 * d + 1 :]]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    cov = np.zeros((d, d))
    middle = rows.select(*centred(sums, n))
    for at in range(0, len(pairs), MOST):
        some = pairs[at : at + MOST]
        for (i, j), total in zip(some, added(middle, [F.expr(f"sum(c{i} * c{j})") for i, j in some])):
            cov[i, j] = cov[j, i] = math.fsum(total) / n
    return Model(n, sums, low, high, cov)


def deviation(model: Model):
    """Sum over dimensions of (n x - S)**2, as long where all of them fit one
    and as decimal (exact up to 38 digits) where they may not."""
    n, sums = model.n, model.sums
    most = sum(max(abs(n * a - s), abs(n * b - s)) ** 2 for a, b, s in zip(model.low, model.high, sums))
    kind = "bigint" if most < 1 << 63 else "decimal(38,0)" if most < 10**38 else None
    if kind is None:
        raise OverflowError("deviations need more than 38 digits")
    away = [f"({f'cast(x{i} as decimal(19,0))' if kind != 'bigint' else f'x{i}'} * {n}L - {s}L)" for i, s in enumerate(sums)]
    square = [f"{a} * {a}" for a in away] if kind == "bigint" else [f"cast({a} * {a} as {kind})" for a in away]
    return F.expr(" + ".join(square))


def project(rows: DataFrame, model: Model, components: int = 8) -> tuple[DataFrame, list[int]]:
    """key, deviation and whitened values ``w1 ...``; the components with variance."""
    d, k = len(model.sums), min(components, len(model.sums))
    base = rows.select("key", deviation(model).alias("deviation"), *centred(model.sums, model.n))
    out, real = [], []
    for c in range(k):
        if model.values[c] > FLAT * model.trace and model.trace > 0:
            scale = model.vectors[c] / np.sqrt(model.values[c])
            out.append(F.expr(" + ".join(f"c{i} * {float(a)!r}D" for i, a in enumerate(scale))).alias(f"w{c + 1}"))
            real.append(c + 1)
        else:
            out.append(F.lit(None).cast("double").alias(f"w{c + 1}"))
    return base.select("key", "deviation", *out), real


def identity_error(white: DataFrame, real: list[int], n: int) -> float:
    """Largest absolute entry of the whitened values' covariance minus the identity."""
    if not real:
        return 0.0
    means = [math.fsum(t) / n for t in added(white, [F.sum(f"w{c}") for c in real])]
    middle = white.select(*[(F.col(f"w{c}") - F.lit(m)).alias(f"m{c}") for c, m in zip(real, means)])
    pairs = [(a, b) for a in real for b in real if a <= b]
    totals = added(middle, [F.expr(f"sum(m{a} * m{b})") for a, b in pairs])
    return max(abs(math.fsum(t) / n - (a == b)) for (a, b), t in zip(pairs, totals))


def whiten(df: DataFrame, components: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each usable row and component: the key, component (from 1),
    n, deviation, whitened, explained, identity_error."""
    rows, d = usable(df, key, vector)
    model = fit(rows, d)
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    white, real = project(rows, model, components)
    error = identity_error(white, real, model.n)
    share = lambda c: float(model.values[c - 1] / model.trace) if c in real else 0.0
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(f"w{c}").alias("whitened"), F.lit(share(c)).alias("explained")) for c in range(1, min(components, d) + 1)]))
    return white.select("key", "deviation", each.alias("e")).select(
        F.col("key").alias(key), "e.component", F.lit(model.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"), "e.whitened", "e.explained", F.lit(error).alias("identity_error")
    )
