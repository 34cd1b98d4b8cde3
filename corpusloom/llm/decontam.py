"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers ``<num>``, units after a number
``<unit>``, runs of capitalised words inside a sentence one ``<name>``; other
words are lower-cased and lose punctuation at their ends. A capitalised word
that opens a sentence may be a name or not: texts are read both ways, and a
match in either reading counts (each on its own diagonal). Windows of ``window`` template
tokens of the documents are hash-joined with those of the benchmark. Matches
on one diagonal (document position minus item position) belong together: a
document is contaminated by an item when at least ``coverage`` of the item's
windows match there and the slots are consistent, that is, equal values of the
item stand for equal values of the document and different ones for different
ones. So a question is caught with its numbers, names or units exchanged.

Windows with fewer than two plain words never count. An item or a document
shorter than a window is one window of all its words, so a short item is found
only as a whole document: in a longer text so few words prove nothing.

The benchmark's window hashes are broadcast to the scan only while there are
at most ``most_broadcast`` of them (16 MB); beyond that all windows go to the
join, with the same result.

Edge cases: null and empty texts and items match nothing; equal items are
reported each; repeated documents each on their own; empty tables give an
empty result; further columns are ignored (``find``) or pass through
(``drop_contaminated``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, fresh, stored, without

WINDOW = 5
COVERAGE = 0.8
UNITS = frozenset(
    "%,$,€,£,km,m,cm,mm,mi,miles,mile,feet,foot,ft,inch,inches,kg,g,mg,lb,lbs,pounds,pound,t,tons,l,ml,liters,litres,gallons,s,sec,seconds,second,min,minutes,minute,h,hours,hour,days,day,weeks,week,months,month,years,year,mph,km/h,dollars,dollar,euros,euro,cents,cent,percent,degrees,points,people,times".split(",")
)
_NUMBER = re.compile(rb"[+\-$\xc2\xa3\xe2\x82\xac]*\d[\d.,:/]*(?:%|st|nd|rd|th)?", re.I)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_JOIN = bytes.maketrans(b" \t\n\x0b\x0c\r", b"______")
PLAIN, NUM, UNIT, NAME = 0, 1, 2, 3


def _facts(words: list[bytes]) -> list[tuple[int, int, int]]:
    """Of each word by itself its class, a code of its plain form, and what
    stands at its end: 0 a letter or digit, 1 punctuation, 2 a sentence's end."""
    kinds, plain, ends = [], [], []
    for word in words:
        text = word.decode("utf-8", "replace")
        core = text if text[0].isalnum() and text[-1].isalnum() else _EDGE.sub("", text)
        last = text if text[-1].isalnum() else text.rstrip("\"')]")
        ends.append(2 if last.endswith((".", "!", "?", ":")) else int(not text[-1].isalnum()))
        low = core.lower() or text
        plain.append(low.encode().translate(_JOIN))
        if _NUMBER.fullmatch(core.encode()):
            kinds.append(NUM)
        else:
            kinds.append(UNIT if low in UNITS else NAME if len(core) > 1 and core[0].isupper() and core[1:].islower() else PLAIN)
    found = Words(plain)
    code = found.key[np.minimum(found.first[:-1], max(0, len(found.key) - 1))] if len(found.key) else np.zeros(len(words), np.uint64)
    return [(k, 0 if k == NUM else c, e) for k, c, e in zip(kinds, np.where(found.count > 0, code, 0).tolist(), ends)]


@dataclass
class Form:
    """One reading of a list of texts as template tokens; ``first`` and
    ``count`` say where the tokens of each text are."""

    token: np.ndarray
    slot: np.ndarray
    value: np.ndarray  # of slots: what stands there
    doc: np.ndarray
    first: np.ndarray
    count: np.ndarray

    def windows(self, size: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First token, length and key of every window."""
        n = np.minimum(self.count, size)
        number = np.where(self.count > 0, self.count - n + 1, 0)
        first = np.repeat(self.first[:-1], number) + (np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number))
        length = np.repeat(n, number)
        key = np.full(len(first), 0x2545F4914F6CDD1D + seed, np.uint64)
        plain = np.zeros(len(first), np.int8)
        token = np.append(self.token, np.zeros(size, np.uint64))
        word = np.append(~self.slot, np.zeros(size, bool))
        whole = bool((n[self.count > 0] == size).all())
        for k in range(size):
            mixed = (key ^ token[first + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
            if whole:
                key = mixed
                plain += word[first + k]
            else:
                inside = k < length
                key = np.where(inside, mixed, key)
                plain += inside & word[first + k]
        good = plain >= 2
        return first[good], length[good], key[good]


class Templates:
    """Template tokens of a list of texts, in both readings of capitalised
    words that open a sentence."""

    #: Words seen by this worker: keys in order, and kind, code and end of each.
    _known = tuple(np.zeros(0, kind) for kind in (np.uint64, np.int8, np.uint64, np.int8))

    def __init__(self, texts: list[bytes]):
        words = Words(texts, lower=False)
        keys, first, inverse = np.unique(words.key, return_index=True, return_inverse=True)
        known = Templates._known
        if len(known[0]) > 1_000_000:
            known = tuple(x[:0] for x in known)
        at = np.searchsorted(known[0], keys)
        new = np.ones(len(keys), bool)
        new[at < len(known[0])] = known[0][at[at < len(known[0])]] != keys[at < len(known[0])]
        if new.any():
            facts = zip(*_facts([words.bytes_of(i) for i in first[new]]))
            made = [keys[new], *(np.array(x, k.dtype) for x, k in zip(facts, known[1:]))]
            known = tuple(np.insert(x, at[new], y) for x, y in zip(known, made))
        Templates._known = known
        kind, code, ends = (x[np.searchsorted(known[0], keys)][inverse] for x in known[1:])
        value = np.where(kind == NUM, words.key, code)
        opens = np.ones(len(kind), bool)  # first in a text, a line or a sentence
        lines = np.cumsum(words.data == 10)
        opens[1:] = (ends[:-1] == 2) | (lines[words.start[1:]] != lines[words.start[:-1]]) | (words.doc[1:] != words.doc[:-1])
        apart = opens.copy()  # no name goes on here
        apart[1:] |= ends[:-1] > 0
        after_number = np.zeros(len(kind), bool)
        after_number[1:] = kind[:-1] == NUM
        kind = np.where((kind == UNIT) & ~after_number, PLAIN, kind)
        self.forms = []
        for named in (False, True):
            read = kind if named else np.where((kind == NAME) & opens, PLAIN, kind)
            goes_on = np.zeros(len(read), bool)
            goes_on[1:] = (read[1:] == NAME) & (read[:-1] == NAME) & ~apart[1:]
            head = np.flatnonzero(~goes_on)
            place = np.arange(len(read)) - np.repeat(head, np.diff(np.append(head, len(read))))
            slot = read[head] != PLAIN
            count = np.bincount(words.doc[head], minlength=len(texts))
            self.forms.append(
                Form(
                    np.where(slot, read[head].astype(np.uint64), code[head]),
                    slot,
                    np.add.reduceat(value * (2 * place + 1).astype(np.uint64), head) if len(head) else value,
                    words.doc[head],
                    np.concatenate([[0], np.cumsum(count)]),
                    count,
                )
            )


def _windows(df: DataFrame, id_column: str, window: int, wanted=None) -> DataFrame:
    """id, form, pos, key, slots (value of each slot of the window in turn)."""

    def run(batches):
        keys = np.asarray(wanted.value) if wanted is not None else None
        near = None
        if keys is not None:
            near = np.zeros(1 << 20, bool)
            near[(keys >> np.uint64(44)).astype(np.int64)] = True
        for batch, texts in chunks(batches, most=1 << 20):
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            for number, form in enumerate(Templates(texts).forms):
                first, length, key = form.windows(window, number)
                if keys is not None:
                    some = near[(key >> np.uint64(44)).astype(np.int64)]
                    some[some] = np.isin(key[some], keys)
                    first, length, key = first[some], length[some], key[some]
                doc = form.doc[first]
                slots = [form.value[a : a + n][form.slot[a : a + n]].view(np.int64) for a, n in zip(first.tolist(), length.tolist())]
                columns = [batch.column("id").take(pa.array(doc)), pa.array(rows[doc], pa.int64()), pa.array(np.full(len(doc), number, np.int32)), pa.array(first - form.first[doc], pa.int64()), pa.array(key.view(np.int64)), pa.array(slots, pa.list_(pa.int64()))]
                yield pa.record_batch(columns, ["id", "row", "form", "pos", "key", "slots"])

    return df.select(F.col(id_column).cast("long").alias("id"), "text", F.monotonically_increasing_id().alias("row")).mapInArrow(run, "id long, row long, form int, pos long, key long, slots array<long>")


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, most_broadcast: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, coverage, exact (whether all slots hold the item's own
    values) for every document and item that it contains."""
    spark = docs.sparkSession
    own = stored(_windows(benchmark, "item_id", window), "item-windows").withColumnsRenamed({"id": "item_id", "row": "item_row", "pos": "item_pos", "slots": "item_slots"})
    wanted = None
    distinct = own.select("key").distinct()
    if distinct.count() <= most_broadcast:
        wanted = spark.sparkContext.broadcast(distinct.toArrow()["key"].to_numpy().view(np.uint64))
    total = own.groupBy("item_row", "form").agg(F.count("*").alias("windows"))
    hits = stored(_windows(docs, "doc_id", window, wanted).withColumnRenamed("id", "doc_id").join(own, ["form", "key"]), "template-hits")
    place = ["doc_id", "row", "item_id", "item_row", "form", (F.col("pos") - F.col("item_pos")).alias("diagonal")]
    lined = hits.select(*place, "item_pos", "slots", "item_slots")
    group = ["doc_id", "row", "item_id", "item_row", "form", "diagonal"]
    same = ["row", "item_row", "form", "diagonal"]
    full = (
        lined.groupBy(*group)
        .agg(F.count("*").alias("n"), F.max(F.size("slots")).alias("most_slots"))
        .join(total, ["item_row", "form"])
        .withColumn("coverage", F.col("n") / F.col("windows"))
        .where(F.col("coverage") >= coverage)
    )
    slots = (
        lined.where(F.size("slots") > 0)
        .join(full.where("most_slots > 0").select(*same), same, "left_semi")
        .select(*same, F.inline(F.arrays_zip(F.col("item_slots").alias("there"), F.col("slots").alias("here"))))
        .distinct()
        .groupBy(*same)
        .agg(F.count("*").alias("pairs"), F.countDistinct("there").alias("theres"), F.countDistinct("here").alias("heres"), F.count_if(F.col("there") != F.col("here")).alias("changed"))
    )
    kept = full.join(slots, same, "left").where("pairs is null or (pairs = theres and pairs = heres)")
    return kept.groupBy("doc_id", "row", "item_id", "item_row").agg(F.max("coverage").alias("coverage"), F.max(F.coalesce(F.col("changed") == 0, F.lit(True))).alias("exact")).select("doc_id", "item_id", "coverage", "exact")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without rows whose text contains a benchmark item. The verdict
    follows from the text alone, so rows are told apart by a 64-bit hash of it:
    null and repeated doc_ids play no part, and all columns pass through."""
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    bad = find(docs.select(text.alias("doc_id"), "text"), benchmark, **options).select("doc_id").distinct()
    key = fresh(docs, "_text")
    return without(docs.withColumn(key, text), key, stored(bad, "leaks")).drop(key)
