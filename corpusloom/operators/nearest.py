"""Nearest vectors: blocks of queries meet blocks of entries.

A task multiplies two blocks at a time and passes on the best ``k`` of each
query in its block, so pairs are neither shuffled nor stored. Entries are sent
once for every ``QUERY_BLOCK`` queries, queries once for every ``ENTRY_BLOCK``
entries.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY_BLOCK, QUERY_BLOCK = 8192, 16384  # rows of a block, about
AT_ONCE = 256  # queries whose scores a task holds


def dense(v: str, dim: int) -> Column:
    """A vector of ``dim`` numbers that a product can't turn into null, NaN or
    infinity."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e100))
    return F.coalesce((F.size(v) == dim) & ~bad, F.lit(False))


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """``F.round``: half up, by the shortest decimal form."""
    y = np.abs(x) * 10.0**digits
    out = np.sign(x) * np.floor(y + 0.5) / 10.0**digits
    for i in np.nonzero((np.abs(y % 1 - 0.5) < 1e-6) | (y > 2.0**50))[0]:
        # no exponent holds more digits than a double of 1e200 has
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) if y[i] < 1e20 else x[i]
    return out + 0.0


def _matrix(column: pa.ChunkedArray, dim: int, kind) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten()).astype(kind).reshape(-1, dim)


def _best(k: int, digits: int, dim: int, tables: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def best(queries: pa.Table, entries: pa.Table) -> pa.Table:
        if not queries.num_rows or not entries.num_rows:
            return pa.table({"qid": queries["qid"].slice(0, 0), "id": entries["id"].slice(0, 0), "score": pa.array([], "float64")})
        # in the order of ids, so that of equal scores the first stay
        entries = entries.take(pc.sort_indices(entries, sort_keys=[("id", "ascending")]))
        e = _matrix(entries["v"], dim, "float64")
        q = _matrix(queries["qv"], dim, "float64")
        # of equal vectors only the first k can be among the best k
        _, same = np.unique(e, axis=0, return_inverse=True)
        same = same.reshape(-1)
        order = np.argsort(same, kind="stable")
        starts = np.searchsorted(same[order], same[order])
        keep = np.sort(order[np.arange(len(order)) - starts < k])
        e, ids = e[keep], entries["id"].take(pa.array(keep))
        if tables:
            eh, qh = _matrix(entries["h"], tables, "int64")[keep], _matrix(queries["qh"], tables, "int64")
        largest = np.sqrt((e * e).sum(axis=1).max(initial=0.0))
        found: list[list[np.ndarray]] = [[], [], []]
        for at in range(0, len(q), AT_ONCE):
            some = q[at : at + AT_ONCE]
            scores = some @ e.T
            if tables:
                met = np.zeros(scores.shape, dtype=bool)
                for t in range(tables):
                    met |= qh[at : at + AT_ONCE, t, None] == eh[None, :, t]
                scores[~met] = -np.inf
            least = np.full(len(some), -np.inf)
            if scores.shape[1] > k:
                # a product's order of additions may differ from that of the
                # exact score, and rounding may make scores equal
                slack = 10.0**-digits * 1.01 + 1e-12 * np.sqrt((some * some).sum(axis=1)) * largest
                least = np.partition(scores, -k, axis=1)[:, -k] - slack
            rows, columns = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
            exact = np.zeros(len(rows))
            for d in range(dim):
                exact += some[rows, d] * e[columns, d]
            first = np.lexsort((columns, -_half_up(exact, digits), rows))
            rows, columns, exact = rows[first], columns[first], exact[first]
            kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            for into, values in zip(found, (rows[kept] + at, columns[kept], exact[kept])):
                into.append(values)
        rows, columns, exact = (np.concatenate(x) if x else np.zeros(0) for x in found)
        return pa.table({"qid": queries["qid"].take(pa.array(rows.astype("int64"))), "id": ids.take(pa.array(columns.astype("int64"))), "score": pa.array(exact)})

    return best


def best_of_blocks(queries: DataFrame, entries: DataFrame, n: int, m: int, k: int, digits: int, dim: int, tables: int = 0) -> DataFrame:
    """qid, id, score (not rounded): at least the best ``k`` of every query, by
    rounded score and then by id. ``queries``: qid, qv; ``entries``: id, v; all
    ``dense``, about ``n`` and ``m`` rows. With ``tables`` both sides have as
    many hashes (qh, h), and only rows that share one in its place meet."""
    wide, deep = max(1, -(-n // QUERY_BLOCK)), max(1, -(-m // ENTRY_BLOCK))
    numbers = lambda count, name: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    block = lambda of, count, name: F.pmod(F.xxhash64(*of), F.lit(count)).cast("int").alias(name)
    left = queries.select("*", block(["qid", "qv"], wide, "qb"), numbers(deep, "eb"))
    right = entries.select("*", block(["id", "v"], deep, "eb"), numbers(wide, "qb"))
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, id {entries.schema['id'].dataType.simpleString()}, score double"
    return left.groupBy("qb", "eb").cogroup(right.groupBy("qb", "eb")).applyInArrow(_best(k, digits, dim, tables), schema)
