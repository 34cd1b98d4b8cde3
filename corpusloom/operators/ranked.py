"""BM25: blocks of queries meet blocks of documents.

A task adds up the scores of two blocks at a time and passes on the best ``n``
documents of each query in its block, so postings are not joined by token (a
common word is no key) and pairs are neither shuffled nor stored. Documents are
sent once for every ``QUERY_BLOCK`` tokens of queries, queries once for every
``DOC_BLOCK`` tokens of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.session import sized
from .nearest import _half_up

DOC_BLOCK, QUERY_BLOCK = 1 << 21, 1 << 20  # tokens of a block, about
CELLS = 1 << 21  # scores that a task holds
K1, B = 1.5, 0.75


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The row of every element of a list column, and the elements."""
    whole = column.combine_chunks()
    return np.asarray(pc.list_parent_indices(whole)).astype(np.int64), whole.flatten()


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... count[i] of them, for every i."""
    return np.arange(int(count.sum())) + np.repeat(start - np.cumsum(count) + count, count)


def _first(n: int, digits: int, doc: np.ndarray, query: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every query the n rows of the best rounded score; of equal ones the
    first documents."""
    order = np.lexsort((doc, -_half_up(score, digits), query))
    query = query[order]
    order = order[np.arange(len(query)) - np.searchsorted(query, query) < n]
    return doc[order], query[np.arange(len(query)) - np.searchsorted(query, query) < n], score[order]


def _best(key: list[str], n: int, digits: int, mean: float, counted: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def best(queries: pa.Table, docs: pa.Table) -> pa.Table:
        # numbers of documents in the order of their ids; rows of one id are one document
        docs = docs.take(pc.sort_indices(docs["id"], null_placement="at_start")) if docs.num_rows else docs
        ids = docs["id"].combine_chunks().dictionary_encode(null_encoding="encode")
        number, ids = np.asarray(ids.indices).astype(np.int64), ids.dictionary
        asker, asked = _lists(queries["tokens"])
        words = asked.unique()
        word = np.asarray(pc.index_in(asked, words)).astype(np.int64)
        order = np.argsort(word, kind="stable")
        asker, weight = asker[order], np.asarray(_lists(queries["weights"])[1])[order]
        first = np.searchsorted(word[order], np.arange(len(words) + 1))
        # the documents' tokens that are asked
        row, tokens = _lists(docs["tokens"])
        word = np.asarray(pc.fill_null(pc.index_in(tokens, words), -1)).astype(np.int64)
        row, word = row[word >= 0], word[word >= 0]
        length = docs["dl"].to_numpy().astype(np.int64)[row]
        doc, tf = number[row], np.ones(len(row))
        if counted:
            order = np.lexsort((word, length, doc))
            doc, length, word = doc[order], length[order], word[order]
            new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (length[1:] != length[:-1]) | (word[1:] != word[:-1])))) if len(doc) else np.zeros(0, np.int64)
            tf = np.diff(np.append(new, len(doc))).astype(np.float64)
            doc, length, word = doc[new], length[new], word[new]
        share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        meets = first[word + 1] - first[word]
        wide = queries.num_rows
        found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.full(wide, -np.inf)
        step = max(1, CELLS // max(wide, 1))
        for low in range(0, len(ids), step):
            a, b = np.searchsorted(doc, (low, low + step))
            many = min(step, len(ids) - low)
            scores = np.zeros(many * wide)
            edges = [a, *np.searchsorted(np.cumsum(meets[a:b]), np.arange(CELLS, int(meets[a:b].sum()), CELLS)) + a + 1, b]
            for c, d in zip(edges[:-1], edges[1:]):
                at = _spread(first[word[c:d]], meets[c:d])
                cell = np.repeat((doc[c:d] - low) * wide, meets[c:d]) + asker[at]
                scores += np.bincount(cell, np.repeat(share[c:d], meets[c:d]) * weight[at], many * wide)
            scores = scores.reshape(many, wide)
            if many > n:
                # rounding may make scores equal
                least = np.maximum(least, np.partition(scores, -n, axis=0)[-n] - 1.01 * 10.0**-digits)
            some, query = np.nonzero((scores > 0) & (scores >= least))
            found = _first(n, digits, *(np.concatenate(x) for x in zip(found, (some + low, query, scores[some, query]))))
        doc, query, score = found
        return pa.table({**{k: queries[k].take(pa.array(query)) for k in key}, "id": ids.take(pa.array(doc)), "score": pa.array(score)})

    return best


class Index:
    """Documents as lists of tokens."""

    def __init__(self, docs: DataFrame, tokens: Column, id_column: str = "id", counted: bool = False):
        self.docs, self.counted = docs.select(F.col(id_column).alias("id"), tokens.alias("tokens")), counted

    def best(self, queries: DataFrame, key: list[str], n: int, digits: int) -> DataFrame:
        """Key, id, score (not rounded): at least the best ``n`` documents
        that share a token with a query, by rounded score and then by id.
        ``queries``: key columns and ``token``, repeats counted. Rows of one id
        are one document; with ``counted``, equal tokens of its rows of one
        length count together."""
        asked = sized(queries.groupBy(*key, "token").agg(F.count("*").alias("times")))
        words = sized(asked.select("token").distinct())
        seen = Observation()
        docs = self.docs.withColumn("dl", F.size("tokens"))
        each = docs.observe(seen, F.count("*").alias("n"), F.count("dl").alias("full"), F.sum("dl").alias("total"))
        each = each.select("id", "dl", F.explode(F.array_distinct("tokens") if self.counted else F.col("tokens")).alias("token")).join(words, "token", "left_semi")
        often = F.count("*")
        if self.counted and not self.docs.groupBy("id").count().where("count > 1").isEmpty():
            often = F.count_distinct(F.struct("id", "dl"))
        df = sized(each.groupBy("token").agg(often.alias("df")))
        many, full, total = (seen.get[c] or 0 for c in ("n", "full", "total"))
        idf = F.log(1 + (many - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighed = asked.join(df, "token").select(*key, "token", (idf * F.col("times")).alias("weight"))
        wide, deep = max(1, -(-asked.count() // QUERY_BLOCK)), max(1, -(-total // DOC_BLOCK))
        numbers = lambda count, name: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
        block = lambda of, count, name: F.pmod(F.xxhash64(*of), F.lit(count)).cast("int").alias(name)
        listed = weighed.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("token", "weight"))).alias("x"))
        left = listed.select(*key, F.col("x.token").alias("tokens"), F.col("x.weight").alias("weights"), block(key, wide, "qb"), numbers(deep, "eb"))
        right = docs.where("dl > 0").select("id", "tokens", "dl", block(["id"], deep, "eb"), numbers(wide, "qb"))
        schema = ", ".join(f"{c} {t}" for c, t in left.select(*key).dtypes + right.select("id").dtypes) + ", score double"
        return left.groupBy("qb", "eb").cogroup(right.groupBy("qb", "eb")).applyInArrow(_best(key, n, digits, max(total / max(full, 1), 1e-9), self.counted), schema)
