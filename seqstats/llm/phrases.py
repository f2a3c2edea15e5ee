"""Phrase collocation mining by vertical partitioning of the corpus' word suffixes.

Every word position begins a suffix, cut after five words or at the end of its piece. Suffixes are partitioned by their word
prefixes: the prefixes of two words are counted, and one that is too frequent for a group of ``GROUP_SUFFIXES`` (the memory
budget) is lengthened word by word until its parts fit, each level by one more count over the text. Prefixes
that occur less often than a phrase must are left out, as no phrase begins there; so is the rest of a suffix after such a pair.
The others are packed into groups by hash, and each group's depth-truncated suffix subtree is built on its own (``Subtree``):
the suffixes in order, a node for every run that shares its first words, and a node's count read from the running totals of its
leaves. A group never needs another one, so a lost executor repeats its groups alone.

What tasks must know of the counts is the same size for any corpus: bit maps over 64-bit hashes of prefixes (``FILTER_BITS``) say
"frequent" and "too frequent". A bit that two prefixes share lets a suffix through that was not needed, or lengthens
a prefix that need not be; counts come from the words alone, so neither changes a result. Tasks add up equal prefixes and suffixes
before anything is shuffled, and hand all that a batch has for one group on as one row: a passage repeated in a third of the
documents is one line per batch.

Scores are exact: products are decimals of 38 digits, their quotient is an integer division.

Null and empty texts have no words. A null ``lang`` is 'und', as is a lang of that name. Repeated rows count each. Equal scores go by count, then by the phrase's
bytes; equally low cuts by the first. Texts of any length are read whole. An empty table gives no rows. Extra columns
are not read and may have any name.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqstats.llm.common import map_batches, utf8
from seqstats.session import written

LEAST, LONGEST, TOP, PERCENT = 100, 5, 2000, 100
#: Suffixes that a group's subtree is built from, at most in expectation: the memory budget of a task.
GROUP_SUFFIXES = 1 << 20
#: Bits of a map of prefixes (8 MB), whatever the corpus.
FILTER_BITS = 1 << 26
#: Words of the prefixes that are counted even if none is too frequent, to leave out what no phrase begins with.
PRUNED = 3
#: Distinct prefixes that a task adds up before it hands them on.
HELD = 1 << 21
_MARKS = b".,;:!?\n\x0b\x0c\r"
_CUT = bytes.maketrans(_MARKS + b"\t", b"." * len(_MARKS) + b" ")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: list[bytes]) -> list[bytes]:
    """Words of all texts, A-Z in lower case; a mark (which no word holds) ends each piece."""
    joined = b".".join(texts).lower().translate(_CUT).replace(b".", b" . ")
    return joined.split() + [b"."]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def changes(columns: list[np.ndarray]) -> np.ndarray:
    """Whether a row differs from the one before it; the first row does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return new


class Numbered:
    """A batch's tokens as numbers of its distinct words (0: the end of a piece), with the words' hashes."""

    def __init__(self, texts: list[bytes], lang: str):
        found = defaultdict(itertools.count().__next__)
        found[b"."]
        self.codes = np.fromiter(map(found.__getitem__, tokens(texts)), np.int32)
        self.words = list(found)
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        start = np.array([xxhash.xxh3_64_intdigest(lang.encode())], np.uint64)
        self.singles = mixed(start * _STEP + self.hashes)

    def keys(self, depth: int, places: np.ndarray) -> np.ndarray:
        """Hash of the language and the first ``depth`` words of the suffixes at ``places``; all of them must be words."""
        key = self.singles[self.codes[places]]
        for j in range(1, depth):
            key = mixed(key * _STEP + self.hashes[self.codes[places + j]])
        return key


class Map:
    """A set of hashes as bits; may hold more than was put in, never less."""

    def __init__(self, bits: int):
        self.data, self.bits = np.zeros(bits // 8, np.uint8), bits

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = (keys % np.uint64(self.bits)).astype(np.int64)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    names, texts = batch["lang"].dictionary_encode(), np.array(utf8(batch["text"]) + [b""], object)[:-1]
    for i, name in enumerate(names.dictionary.to_pylist()):
        yield name, texts[names.indices.to_numpy() == i].tolist()


class Partition:
    """Word prefixes by budget: which are frequent, and which are too frequent for one group, by their number of words."""

    def __init__(self, frequent: dict[int, Map], heavy: dict[int, Map], groups: int = 1):
        self.frequent, self.heavy, self.groups = frequent, heavy, groups

    def lengths(self, text: Numbered, longest: int) -> np.ndarray:
        """Words at each place that may be a frequent prefix: all parts of it may be, as far as they are known."""
        live = text.codes != 0
        if 1 in self.frequent:
            live &= self.frequent[1].has(text.singles)[text.codes]
        lengths = live.astype(np.int8)
        for depth in range(2, longest + 1):
            places = np.flatnonzero(live[:-1] & live[1:])
            if depth in self.frequent:
                places = places[self.frequent[depth].has(text.keys(depth, places))]
            live = np.zeros(len(live), bool)
            live[places] = True
            lengths += live
        return lengths

    def placed(self, text: Numbered, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(depth of the prefix, group key, place, length) of the suffixes, from the shortest prefixes to the longest.

        A suffix under a prefix that is too frequent also gives the prefix itself, for the prefix's own count.
        """
        lengths = self.lengths(text, longest)
        places = np.flatnonzero(lengths >= 2)
        lengths, depth = lengths[places], 2
        while len(places):
            key = text.keys(depth, places)
            heavy = self.heavy[depth].has(key) if depth in self.heavy else np.zeros(len(places), bool)
            yield depth, key, places, np.where(heavy, depth, lengths)
            longer = heavy & (lengths > depth)
            places, lengths, depth = places[longer], lengths[longer], depth + 1


@dataclass
class Subtree:
    """A group's suffixes in order; ``totals`` are running totals of the leaves' counts.

    A node of depth d is a run of leaves that agree in their first d words. Leaves shorter than d, and those whose counts
    belong to greater depths only (``since``), add nothing at depth d.
    """

    leaves: np.ndarray
    since: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, leaves: np.ndarray, since: np.ndarray, counts: np.ndarray) -> Subtree:
        order = np.lexsort(leaves.T[::-1])
        return cls(leaves[order], since[order], counts[order])

    def nodes(self, first: int = 3) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(depth, a leaf below, count) of all nodes; column 0 is the language, so a node of d words has d + 1 columns."""
        new = np.zeros(len(self.leaves), bool)
        new[:1] = True
        for column in range(self.leaves.shape[1]):
            new[1:] |= self.leaves[1:, column] != self.leaves[:-1, column]
            if column + 1 < first:
                continue
            starts = np.flatnonzero(new)
            counted = (self.leaves[:, column] >= 0) & (self.since <= column)
            totals = np.concatenate([[0], np.cumsum(np.where(counted, self.counts, 0))])
            yield column, starts, totals[np.append(starts[1:], len(new))] - totals[starts]


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase (one word), its key and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in by_lang(batch):
                text = Numbered(texts, lang)
                counts = np.bincount(text.codes, minlength=len(text.words))[1:]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(counts), pa.string()), pa.array(text.words[1:], pa.binary()).cast(pa.string()),
                        pa.array(text.singles[1:].view(np.int64)), pa.array(counts),
                    ],
                    ["lang", "phrase", "key", "n"],
                )

    counts = map_batches(docs, run, "lang string, phrase string, key bigint, n bigint")
    return counts.groupBy("lang", "phrase", "key").agg(F.sum("n").alias("n"))


def prefix_counts(docs: DataFrame, partition: Partition, depth: int) -> DataFrame:
    """key, n of the prefixes of ``depth`` words whose parts may be frequent."""
    known = docs.sparkSession.sparkContext.broadcast(partition)

    def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        every, n = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(every)
        every, n = every[order], n[order]
        starts = np.flatnonzero(changes([every]))
        sums = np.add.reduceat(n, starts) if len(starts) else n
        return pa.RecordBatch.from_arrays([pa.array(every[starts].view(np.int64)), pa.array(sums)], ["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for lang, texts in by_lang(batch):
                text = Numbered(texts, lang)
                found, n = np.unique(text.keys(depth, np.flatnonzero(known.value.lengths(text, depth) == depth)), return_counts=True)
                keys.append(found)
                counts.append(n)
                held += len(found)
            if held > HELD:
                yield added(keys, counts)
                keys, counts, held = [], [], 0
        if keys:
            yield added(keys, counts)

    return map_batches(docs, run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def bit_map(keys: DataFrame, bits: int) -> Map:
    """The hashes as a bit map: as many rows as the map has words come to the driver at most, whatever the corpus."""
    bit = F.expr(f"pmod(key, {bits})")  # the remainder of the signed hash: bits is a power of two
    words = keys.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit % 64))")).alias("set")).toArrow()
    found, rows = Map(bits), words["at"].to_numpy()
    found.data.view(np.uint64)[rows] = words["set"].to_numpy().view(np.uint64)
    return found


def partitioned(docs: DataFrame, words: DataFrame, least: int, longest: int, budget: int, bits: int) -> Partition:
    """Counts prefixes level by level: up to ``PRUNED`` words in any case, then as long as some are too frequent.

    A prefix may hold an eighth of a group; groups expect a half of the budget.
    """
    partition = Partition({1: bit_map(words.where(F.col("n") >= least), bits)}, {})
    for depth in range(2, longest):
        if depth > PRUNED and depth - 1 not in partition.heavy:
            break
        counts = written(prefix_counts(docs, partition, depth).where(F.col("n") >= least), "prefixes")
        if depth == 2:
            total = counts.agg(F.sum("n")).first()[0] or 0
            slots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            partition.groups = max(4 * slots, -(-2 * total // budget))
        partition.frequent[depth] = bit_map(counts, bits)
        heavy = counts.where(F.col("n") > budget // 8)
        if (depth == 2 or depth - 1 in partition.heavy) and not heavy.isEmpty():
            partition.heavy[depth] = bit_map(heavy, bits)
    return partition


def longer_phrases(docs: DataFrame, partition: Partition, least: int, longest: int) -> DataFrame:
    """lang, phrase, n of all phrases of two words or more with ``least`` occurrences: the nodes of all subtrees."""
    known, groups = docs.sparkSession.sparkContext.broadcast(partition), np.uint64(partition.groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in by_lang(batch):
                text = Numbered(texts, lang)
                for depth, key, at, reach in known.value.placed(text, longest):
                    columns = [np.where(reach > j, text.codes[np.minimum(at + j, len(text.codes) - 1)], -1) for j in range(longest)]
                    group = (key % groups).astype(np.int32)
                    order = np.lexsort([*columns[::-1], group])
                    columns, group, reach = [c[order] for c in columns], group[order], reach[order]
                    starts = np.flatnonzero(changes([group, *columns]))
                    n, group = np.diff(np.append(starts, len(order))), group[starts]
                    rows = zip(reach[starts].tolist(), *(c[starts].tolist() for c in columns))
                    suffixes = [b" ".join([text.words[x] for x in row[1 : 1 + row[0]]]) for row in rows]
                    # One row for each group: its suffixes as lines, and their counts.
                    cuts = np.append(np.flatnonzero(changes([group])), len(group))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(group[cuts[:-1]]), pa.array([lang] * (len(cuts) - 1), pa.string()),
                            pa.array(np.full(len(cuts) - 1, depth, np.int32)),
                            pa.array([b"\n".join(suffixes[i:j]) for i, j in zip(cuts[:-1], cuts[1:])], pa.binary()),
                            pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(n)),
                        ],
                        ["group", "lang", "since", "suffixes", "counts"],
                    )

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        langs, found = group["lang"].combine_chunks().dictionary_encode(), defaultdict(itertools.count().__next__)
        rows = [x.split(b" ") for lines in group["suffixes"].to_pylist() for x in lines.split(b"\n")]
        counts, each = np.concatenate(group["counts"].to_numpy()), [len(x) for x in group["counts"].to_pylist()]
        leaves = np.full((len(rows), longest + 1), -1, np.int32)
        leaves[:, 0] = np.repeat(langs.indices.to_numpy(), each)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        inside = np.arange(longest) < sizes[:, None]
        leaves[:, 1:][inside] = np.fromiter((found[w] for row in rows for w in row), np.int32)
        words = list(found)
        tree = Subtree.build(leaves, np.repeat(group["since"].to_numpy(), each), counts)
        out: tuple[list, list, list] = ([], [], [])
        for depth, starts, counts in tree.nodes():
            kept = counts >= least
            for row, n in zip(tree.leaves[starts[kept]].tolist(), counts[kept].tolist()):
                out[0].append(langs.dictionary[row[0]].as_py())
                out[1].append(b" ".join([words[x] for x in row[1 : depth + 1]]).decode())
                out[2].append(n)
        return pa.table({"lang": pa.array(out[0], pa.string()), "phrase": pa.array(out[1], pa.string()), "n": pa.array(out[2], pa.int64())})

    suffixes = map_batches(docs, run, "group int, lang string, since int, suffixes binary, counts array<bigint>")
    return suffixes.groupBy("group").applyInArrow(build, "lang string, phrase string, n bigint")


def scored(counts: DataFrame, totals: DataFrame, percent: int) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates that no longer one covers.

    counts: lang, phrase, size (words), a of all frequent phrases, single words among them; totals: lang, n.
    """
    words = F.split("phrase", " ")
    candidates = counts.where("size > 1").withColumn("words", words)
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.expr("sequence(1, size - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr("concat_ws(' ', slice(words, 1, k))").alias("_left"),
        F.expr("concat_ws(' ', slice(words, k + 1, size(words) - k))").alias("_right"),
    )
    part = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("a").alias("_a"))
    for side, name in (("_left", "l"), ("_right", "r")):
        cuts = cuts.join(part, (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_phrase"))).withColumn(name, F.col("_a")).drop("_lang", "_phrase", "_a")
    cuts = cuts.join(totals.withColumnRenamed("lang", "_lang"), F.col("lang") == F.col("_lang")).drop("_lang")
    score = F.expr("(1000 * (cast(a as decimal(19, 0)) * cast(n as decimal(19, 0)))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_x"))
    inner = candidates.where("size > 2").select("lang", "a", "words", F.explode(F.expr("sequence(2, size - 1)")).alias("_size"))
    inner = inner.select("lang", "a", F.explode(F.expr("transform(sequence(1, size(words) - _size + 1), i -> concat_ws(' ', slice(words, i, _size)))")).alias("phrase"))
    covers = inner.groupBy(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase")).agg(F.max("a").alias("_most"))
    covered = (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")) & (100 * F.col("_most") >= percent * F.col("a"))
    return lowest.join(covers, covered, "left_anti").select("lang", "phrase", "a", "_x.l", "_x.r", "n", "_x.score")


def phrases(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = PERCENT, budget: int = GROUP_SUFFIXES,
    bits: int = FILTER_BITS,
) -> DataFrame:
    """Each lang's ``top`` phrases of 2 to ``longest`` words with ``least`` occurrences: lang, rank, phrase, a, l, r, n, score."""
    read = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = written(word_counts(read), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    partition = partitioned(read, words, least, longest, budget, bits)
    longer = written(longer_phrases(read, partition, least, longest), "phrases")
    every = words.where(F.col("n") >= least).select("lang", "phrase", F.lit(1).alias("size"), F.col("n").alias("a")).unionByName(
        longer.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), F.col("n").alias("a"))
    )
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = scored(every, totals, percent).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) s(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, cut, x.a AS l, y.a AS r, n,
    CAST((1000::HUGEINT * cuts.a * n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cuts JOIN n ON cuts.lang = n.lang JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:cut], ' ')
  JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ones AS (SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (
  SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, a, w, k, unnest(range(2, k)) AS m FROM c))),
covers AS (SELECT lang, phrase, max(a) AS most FROM inner_ones GROUP BY lang, phrase)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, n, score
FROM best b LEFT JOIN covers v ON b.lang = v.lang AND b.phrase = v.phrase WHERE coalesce(most, 0) < b.a
QUALIFY rank <= 2000
"""
