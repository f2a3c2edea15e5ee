"""Filter interaction audit: what every order of the filters would keep, from one word per document.

A document is reduced to the filters it fails, and that to a truth table: a word with one bit for each subset of the filters,
set if the document survives all filters of the subset (five filters: 32 bits). Counting each bit over the documents of a
part, and over those with a label, gives the survivors of all subsets at once, from which every step of every order follows by
subtraction. The bits are counted with carry-save adders: three words make a sum word and a carry word of twice the weight, block by
block, until two words of a weight are left (``bit_counts``). Tasks add up their own batches; Spark adds up 32 numbers for each
part and label.

The five filters of the query are in ``failures``. Whether a smaller id has the same text is settled by the text's SHA-256:
documents are summed up by text, part and labels before they meet, so a text that fills a third of the table is a few
rows. Documents of one such sum share a word; they enter the adders as a word with a run length, at the weights of its binary digits.

Null texts are empty: no words, so they fail A only, and E if a smaller id is empty too. A null id is never the smaller one and
never fails E. Rows that repeat an id are documents of their own; with the smallest id of a text all its rows pass E. A null source is the part ''.
A null id has no label; labels that are null or missing are none; of several rows for one id the greatest counts. Texts of any length are read
whole. An empty table has no parts and gives no rows. Extra columns are not read and may have any name.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqstats.llm.common import map_batches, utf8

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 50, 65, 5
SYMBOLS = b"#$%&*|"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NOT_UPPER = bytes(set(range(256)) - set(_UPPER))
_INSIDE = bytes(range(0x80, 0xC0))


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails. ``bytes.split()`` cuts at the same six spaces as the words' pattern."""
    words = text.split()
    points = len(text.translate(None, _INSIDE))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * len(text.translate(None, _NOT_UPPER)) > UPPER_PERCENT * points) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


def truth_table(failed: int, filters: int) -> int:
    """The word whose bit S is set if none of the filters in subset S is failed."""
    return sum(1 << s for s in range(1 << filters) if not s & failed)


def _carry_save(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum words and carry words: full adders over thirds of the words, until fewer than three are left."""
    carries = [words[:0]]
    while len(words) > 2:
        third = len(words) // 3
        a, b, c, rest = words[:third], words[third : 2 * third], words[2 * third : 3 * third], words[3 * third :]
        half = a ^ b
        carries.append((a & b) | (half & c))
        words = np.concatenate([half ^ c, rest])
    return words, np.concatenate(carries)


def bit_counts(words: np.ndarray, runs: np.ndarray, bits: int) -> np.ndarray:
    """How many words have each bit, a word counting as often as its run says (64-bit totals)."""
    words, runs = words.astype(np.uint64), runs.astype(np.int64)
    totals, weight, carries = np.zeros(bits, np.int64), 0, words[:0]
    places = np.arange(bits, dtype=np.uint64)
    while len(carries) or (runs >> weight).any():
        level = np.concatenate([carries, words[(runs >> weight) & 1 == 1]])
        left, carries = _carry_save(level)
        totals += ((left[:, None] >> places) & np.uint64(1)).sum(axis=0).astype(np.int64) << weight
        weight += 1
    return totals


def survivors(rows: DataFrame, filters: int) -> DataFrame:
    """Survivors of every subset of the filters.

    rows: part, good, toxic (boolean), failed (bits) and run (documents with this word). Gives part, subset (its bits), kept,
    good and toxic: documents of the part that pass all filters of the subset, with either label.
    """
    size = 1 << filters
    table = np.array([truth_table(x, filters) for x in range(size)], np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed, runs = batch["failed"].to_numpy(), batch["run"].to_numpy()
            names = batch["part"].dictionary_encode()
            kinds = names.indices.to_numpy().astype(np.int64) * 4 + batch["good"].to_numpy(zero_copy_only=False) * 2 + batch["toxic"].to_numpy(zero_copy_only=False)
            order = np.argsort(kinds, kind="stable")
            found, starts = np.unique(kinds[order], return_index=True)
            counts = [bit_counts(table[failed[x]], runs[x], size) for x in np.split(order, starts[1:])] if len(order) else []
            yield pa.RecordBatch.from_arrays(
                [
                    names.dictionary.take(pa.array(found // 4)), pa.array((found // 2 % 2).astype(bool)), pa.array((found % 2).astype(bool)),
                    pa.array([x.tolist() for x in counts], pa.list_(pa.int64())),
                ],
                ["part", "good", "toxic", "counts"],
            )

    partial = map_batches(rows.select("part", "good", "toxic", F.col("failed").cast("int").alias("failed"), F.col("run").cast("long").alias("run")), count, "part string, good boolean, toxic boolean, counts array<bigint>")
    bit = F.posexplode("counts").alias("subset", "n")
    return partial.select("part", "good", "toxic", bit).groupBy("part", "subset").agg(
        F.sum("n").alias("kept"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def audit(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from ``survivors``.

    The orders and steps are a fixed list (600 of five filters). Every count is a difference of two entries of the arrays that
    hold a part's survivors.
    """
    n, size = len(names), 1 << len(names)
    arrays = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "kept", "good", "toxic"))).alias("_all"))
    arrays = arrays.select("part", *(F.col(f"_all.{c}").alias(f"_{c}") for c in ("kept", "good", "toxic")))
    shares = [
        sum(
            (F.col("_kept")[s] - F.col("_kept")[s | 1 << f]) * (math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count()))
            for s in range(size)
            if not s >> f & 1
        )
        for f in range(n)
    ]
    arrays = arrays.withColumn("_shares", F.array(*shares))
    steps = []
    for order in itertools.permutations(range(n)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(names[x] for x in order), step, f, before))
            before |= 1 << f
    listed = counts.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(steps)], "_at int, filter_order string, step int, _f int, _before int")
    rows = arrays.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))))
    rows = rows.join(F.broadcast(listed), "_at").withColumn("_bit", F.expr("shiftleft(1, _f)"))

    def at(array: str, subset: Column) -> Column:
        return F.element_at(array, subset + 1)

    with_it, last = F.col("_before").bitwiseOR(F.col("_bit")), F.lit(size - 1)
    removed = at("_kept", F.col("_before")) - at("_kept", with_it)
    return rows.select(
        "part", "filter_order", "step", at("_kept", with_it).alias("kept"), removed.alias("removed"),
        (at("_kept", F.lit(0)) - at("_kept", F.col("_bit")) - removed).alias("redundant"),
        (at("_kept", last - F.col("_bit")) - at("_kept", last)).alias("unique_fails"),
        (at("_good", F.col("_before")) - at("_good", with_it)).alias("good_lost"),
        (at("_toxic", F.col("_before")) - at("_toxic", with_it)).alias("toxic_lost"),
        F.element_at("_shares", F.col("_f") + 1).alias("shapley"),
    )


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by the filters they fail, in the form that ``survivors`` takes."""
    wide = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch["text"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], batch["part"], pa.array([failures(x) for x in texts], pa.int32()),
                    pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()),
                ],
                ["doc_id", "part", "failed", "digest"],
            )

    read = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text")
    each = map_batches(read, run, f"doc_id {wide.simpleString()}, part string, failed int, digest binary")
    each = each.groupBy("doc_id", "part", "failed", "digest").agg(F.count("*").alias("rows"))
    known = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_q"), F.max("toxic").alias("_t"))
    each = each.join(known, F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id", "part", "failed", "digest", "rows", F.coalesce(F.col("_q") == 1, F.lit(False)).alias("good"),
        F.coalesce(F.col("_t") == 1, F.lit(False)).alias("toxic"),
    )
    # By text, part and labels: all rows, those without an id, the smallest id and its rows.
    kinds = ["digest", "part", "failed", "good", "toxic"]
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "rows")))
    groups = each.groupBy(*kinds).agg(F.sum("rows").alias("rows"), F.sum(F.when(F.col("doc_id").isNull(), F.col("rows")).otherwise(0)).alias("nameless"), first.alias("first"))
    smallest = groups.groupBy(F.col("digest").alias("_digest")).agg(F.min("first.doc_id").alias("_smallest"))
    groups = groups.join(smallest, F.col("digest") == F.col("_digest"))
    passing = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("_smallest"), F.col("first.rows")).otherwise(0)
    both = F.explode(F.array(F.struct(F.col("failed"), passing.alias("run")), F.struct(F.col("failed").bitwiseOR(F.lit(16)).alias("failed"), (F.col("rows") - passing).alias("run"))))
    return groups.select("part", "good", "toxic", both.alias("_x")).select("part", "good", "toxic", "_x.failed", "_x.run").where("run > 0")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(survivors(judged(docs, labels), len(FILTERS)))


SQL = r"""
WITH RECURSIVE first AS (SELECT coalesce(text, '') AS t, min(doc_id) AS least FROM documents GROUP BY ALL),
l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY doc_id),
w AS (SELECT d.doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents d),
f AS (SELECT part, coalesce(q = 1, false) AS good, coalesce(x = 1, false) AS toxic,
    CAST(len(words) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INT)
    + 4 * CAST(100 * len(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 5 * len(w.t) AS INT)
    + 8 * CAST(regexp_matches(w.t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(w.doc_id > least, false) AS INT) AS failed
  FROM w JOIN first ON w.t = first.t LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY part, failed),
s AS (SELECT part, CAST(s AS INT) AS s, coalesce(sum(n) FILTER (failed & s = 0), 0) AS n, coalesce(sum(g) FILTER (failed & s = 0), 0) AS g,
    coalesce(sum(x) FILTER (failed & s = 0), 0) AS x FROM c, range(32) r(s) GROUP BY part, s),
o AS (SELECT '' AS filter_order, 0 AS step, 0 AS before, 0 AS bit, 0 AS reached
  UNION ALL SELECT filter_order || chr(CAST(65 + f AS INT)), step + 1, reached, CAST(1 << f AS INT), CAST(reached | (1 << f) AS INT)
  FROM o, range(5) r(f) WHERE reached & (1 << f) = 0),
p AS (SELECT full_order.filter_order, o.step, o.before, o.bit, o.reached
  FROM (SELECT filter_order FROM o WHERE step = 5) full_order JOIN o ON o.step > 0 AND full_order.filter_order[:o.step] = o.filter_order),
r AS (SELECT a.part, p.*, b.n AS kept, a.n - b.n AS removed, al.n - one.n - (a.n - b.n) AS redundant, rest.n - whole.n AS unique_fails,
    a.g - b.g AS good_lost, a.x - b.x AS toxic_lost
  FROM p JOIN s a ON a.s = p.before JOIN s b ON b.part = a.part AND b.s = p.reached JOIN s al ON al.part = a.part AND al.s = 0
  JOIN s one ON one.part = a.part AND one.s = p.bit JOIN s rest ON rest.part = a.part AND rest.s = 31 - p.bit
  JOIN s whole ON whole.part = a.part AND whole.s = 31)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
