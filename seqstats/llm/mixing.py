"""Mixing sources to target weights: certain whole copies, then a Pareto order sample of fixed size.

A source's target is its share of the mix by weight; targets stop at ``most`` times the source's size and the excess goes to
the others by weight. A document whose source wants t times its words gets floor(t) copies for certain. The rest of the target is a
sample whose size is fixed in words: every row has random odds u / (1 - u) from a hash, rows are ranked by random odds divided by
inclusion odds, and the first rows that fit the rest are taken. Inclusion odds are those of the missing share, times
(mean size / size) ** ``tilt``: a long document is drawn less readily, since it swallows much of a target at once. What
the first rows leave is filled in ``ROUNDS`` rounds by the next rows that still fit, at last by the one row that brings the
words nearest to the target, if any does.

Nothing is sorted or summed in one place: a source's ranks are cut by sums over bands of the ranking (``BANDS`` a
source) and only the band with the cut is walked row by row. Rows that agree in id, source and text are counted first and numbered
afterwards, so a row that is repeated any number of times is neither one task's work nor one draw.

Null texts and texts without words have size 0 and take 0. A null source is a source of its own, after all others; a null id is an id like
any other. Rows with one id are drawn each for itself. Equal ranks are told apart by the hash. Texts of any length count
whole. An empty table gives no rows. Extra columns are not read and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqstats.session import written

WORDS = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in the order of their names, from the first again when they end.
WEIGHTS = (3, 1, 2)
SHARE, MOST, TILT = 1.5, 2, 0.5
#: Rounds that fill what the rows before have left.
ROUNDS = 3
#: Bands of the ranking that are summed for themselves; the walked band of a source has about one row in so many.
BANDS = 1 << 14
#: Numbers that one row is multiplied to at a time.
RUN = 100_000


def repeated(df: DataFrame, count: str, number: str) -> DataFrame:
    """Each row ``count`` times, numbered from 1 in ``number``; large counts are dealt out in runs."""
    runs = df.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / RUN)))).where(f"{count} > 0")
    inside = F.sequence(F.col("_run") * RUN + 1, F.least(F.col(count).cast("long"), (F.col("_run") + 1) * RUN))
    return runs.withColumn(number, F.explode(inside)).drop("_run")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, digest of the text, size in words and number of equal rows (copies)."""
    text = F.coalesce("text", F.lit(""))
    return (
        docs.select("doc_id", "source", F.md5(text).alias("digest"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"))
        .groupBy("doc_id", "source", "digest", "size")
        .agg(F.count("*").alias("rows"))
    )


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> with its target. One row a source comes in, so the order of sources fits one window.

    Sources stop in the order of limit / weight: one stops if an even level of words per weight, over what those before it leave, reaches
    its limit.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    limit, everything = F.col("source_size") * float(most), Window.partitionBy()
    rows = sizes.select("source", "source_size", weight.alias("weight"), limit.alias("limit")).withColumn(
        "total", F.sum("source_size").over(everything) * float(share)
    )
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / after
    full = rows.withColumn("full", F.col("limit") / F.col("weight") <= level)
    taken = F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(everything)
    free = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    even = F.try_divide(F.col("total") - taken, free) * F.col("weight")
    return full.select("source", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(even).alias("target"))


def rank(odds: Column, inclusion: Column) -> Column:
    return odds / inclusion


def _with(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows with what is known of their source."""
    return rows.join(state.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _place(column: str = "rank") -> Column:
    return F.struct(F.col(column), F.col("mark"))


def _round(rows: DataFrame, state: DataFrame) -> DataFrame:
    """One round: the place up to which rows that fit are taken, and what that leaves.

    state: source, left (words), upto (place reached) and steps (left and place of each round).
    """
    fits = _with(rows, state).where((F.col("size") <= F.col("left")) & (F.col("upto").isNull() | (_place() > F.col("upto"))))
    fits = fits.withColumn("band", F.floor(F.col("rank") / (F.col("rank") + 1) * BANDS))
    bands = fits.groupBy("source", "band").agg(F.sum("size").alias("words"), F.max(_place()).alias("last"), F.first("left").alias("left"))
    upward = Window.partitionBy("source").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    bands = bands.withColumn("sum", F.sum("words").over(upward))
    # The bands that fit whole, and the first that does not.
    whole = bands.where("sum <= left").groupBy("source").agg(F.max("sum").alias("got"), F.max("last").alias("got_upto"))
    cut = bands.where("sum > left").groupBy("source").agg(F.min(F.struct("band", (F.col("sum") - F.col("words")).alias("base"))).alias("cut"))
    cut = cut.select("source", F.col("cut.band").alias("cut_band"), F.col("cut.base").alias("base"))
    walked = _with(fits, cut).where("band = cut_band")
    in_order = Window.partitionBy("source").orderBy("rank", "mark").rowsBetween(Window.unboundedPreceding, 0)
    walked = walked.withColumn("sum", F.col("base") + F.sum("size").over(in_order)).where("sum <= left")
    more = walked.groupBy("source").agg(F.max("sum").alias("more"), F.max(_place()).alias("more_upto"))
    found = state.join(whole.withColumnRenamed("source", "_w"), F.col("source").eqNullSafe(F.col("_w")), "left").drop("_w")
    found = found.join(more.withColumnRenamed("source", "_m"), F.col("source").eqNullSafe(F.col("_m")), "left").drop("_m")
    reached = F.coalesce("more_upto", "got_upto")
    step = F.struct(F.col("left").alias("left"), reached.alias("upto"))
    return found.select(
        "source", (F.col("left") - F.coalesce("more", "got", F.lit(0))).alias("left"), F.coalesce(reached, "upto").alias("upto"),
        F.when(reached.isNull(), F.col("steps")).otherwise(F.concat("steps", F.array(step))).alias("steps"),
    )


def plan(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, tilt: float = TILT,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, digest, size, source_size, target, copies, taken (long: copies * size).

    ``share``: words of the mix over all words. The result depends on the rows alone: another run gives the same.
    """
    counted = written(sized(docs), "sizes")
    sources = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("rows"))).alias("_n"))
    wanted = targets(sources.select("source", "source_size"), weights, share, most)
    wanted = wanted.withColumn("times", F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0)))
    wanted = wanted.withColumn("whole", F.floor("times"))
    wanted = _with(wanted, sources.select("source", "_n")).select(
        "source", "source_size", "target", "whole", (F.col("times") - F.col("whole")).alias("part"),
        F.try_divide(F.col("source_size").cast("double"), F.col("_n").cast("double")).alias("mean"),
    )
    wanted = written(wanted, "targets")
    named = F.concat_ws("|", "digest", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("source", F.lit("null")), F.col("number").cast("string"))
    rows = _with(repeated(counted, "rows", "number"), wanted).withColumn("mark", F.md5(named))
    u = (F.conv(F.substring("mark", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    lean = F.lit(1.0) if tilt == 0 else F.sqrt(F.col("mean") / F.col("size")) if tilt == 0.5 else F.pow(F.col("mean") / F.col("size"), F.lit(float(tilt)))
    inclusion = F.col("part") / (1.0 - F.col("part")) * lean
    drawn = (F.col("part") > 0) & (F.col("size") > 0)
    rows = rows.withColumn("rank", F.when(drawn, rank(u / (1.0 - u), inclusion)))
    rows = written(rows.select("doc_id", "source", "digest", "size", "number", "source_size", "target", "whole", "mark", "rank"), "ranks")
    ranked = rows.where("rank is not null").select("source", "size", "rank", "mark")
    place, step = "struct<rank:double,mark:string>", "array<struct<left:double,upto:struct<rank:double,mark:string>>>"
    state = wanted.select(
        "source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("left"), F.lit(None).cast(place).alias("upto"),
        F.array().cast(step).alias("steps"),
    )
    for _ in range(rounds):
        state = written(_round(ranked, state), "rounds")
    # What is still missing: the row that comes nearest to it, if taking it is better than taking none.
    unseen = _with(ranked, state).where((F.col("size") < 2 * F.col("left")) & ~_taken())
    last = unseen.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("left")).alias("off"), "rank", "mark")).alias("_last"))
    state = state.join(last.withColumnRenamed("source", "_l"), F.col("source").eqNullSafe(F.col("_l")), "left")
    state = written(state.select("source", "left", "steps", F.col("_last.mark").alias("last")), "cuts")
    extra = F.col("rank").isNotNull() & (_taken() | F.coalesce(F.col("mark") == F.col("last"), F.lit(False)))
    copies = F.col("whole") + F.when(extra, 1).otherwise(0)
    return _with(rows, state).select(
        "doc_id", "source", "digest", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def _taken() -> Column:
    return F.exists("steps", lambda s: (F.col("size") <= s["left"]) & (_place() <= s["upto"]))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: every row as often as ``plan`` says.

    Rows that agree in id, source and text are one document; one of them stands for all of their copies.
    """
    copies = plan(docs, **options).groupBy("doc_id", "source", "digest").agg(F.sum("copies").alias("_copies"))
    copies = copies.select(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("digest").alias("_md5"), "_copies").where("_copies > 0")
    texts = docs.withColumn("_digest", F.md5(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", "source", "_digest"])
    same = texts["doc_id"].eqNullSafe(copies["_id"]) & texts["source"].eqNullSafe(copies["_src"]) & (texts["_digest"] == copies["_md5"])
    return repeated(texts.join(copies, same), "_copies", "_number").select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


_ROUND = """
s{k} AS (SELECT source, max(got) AS got, max(struct_pack(rank := rank, mark := mark)) AS upto FROM (
    SELECT r.*, s.have, sum(r.size) OVER (PARTITION BY r.source ORDER BY r.rank, r.mark) AS got
    FROM r JOIN p{j} s ON r.source IS NOT DISTINCT FROM s.source WHERE r.size <= s.have AND NOT r.mark IN (SELECT mark FROM t{j}))
  WHERE got <= have GROUP BY source),
t{k} AS (SELECT mark FROM t{j} UNION ALL SELECT mark FROM r JOIN s{k} ON r.source IS NOT DISTINCT FROM s{k}.source
  JOIN p{j} ON r.source IS NOT DISTINCT FROM p{j}.source
  WHERE r.size <= p{j}.have AND struct_pack(rank := r.rank, mark := r.mark) <= s{k}.upto AND NOT r.mark IN (SELECT mark FROM t{j})),
p{k} AS (SELECT p{j}.source, p{j}.have - coalesce(s{k}.got, 0) AS have FROM p{j} LEFT JOIN s{k} ON p{j}.source IS NOT DISTINCT FROM s{k}.source),"""

SQL = (
    r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS digest, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, digest) AS number FROM d),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) FILTER (size > 0) AS k FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS top,
  sum(source_size) OVER () * 1.5::DOUBLE AS total FROM z),
l AS (SELECT *, top / weight <= (total - coalesce(sum(top) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS stops
  FROM w WINDOW b AS (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, k, CASE WHEN stops THEN top ELSE (total - sum(CASE WHEN stops THEN top ELSE 0 END) OVER ())
  / nullif(sum(CASE WHEN stops THEN 0 ELSE weight END) OVER (), 0) * weight END AS target FROM l),
h AS (SELECT *, floor(times) AS whole, times - floor(times) AS part FROM (SELECT *, coalesce(target / nullif(CAST(source_size AS DOUBLE), 0), 0) AS times FROM g)),
m AS (SELECT n.*, h.source_size, h.target, h.whole, h.part, source_size / CAST(k AS DOUBLE) AS mean,
  md5(concat_ws('|', digest, coalesce(CAST(doc_id AS VARCHAR), 'null'), coalesce(n.source, 'null'), number)) AS mark
  FROM n JOIN h ON n.source IS NOT DISTINCT FROM h.source),
u AS (SELECT *, (CAST(('0x' || substr(mark, 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM m),
r AS MATERIALIZED (SELECT *, (u / (1 - u)) / (part / (1 - part) * sqrt(mean / size)) AS rank FROM u WHERE part > 0 AND size > 0),
t0 AS (SELECT '' AS mark), p0 AS (SELECT source, target - whole * source_size AS have FROM h),"""
    + "".join(_ROUND.format(j=k, k=k + 1) for k in range(ROUNDS))
    + """
x AS (SELECT min(struct_pack(off := abs(size - have), rank := rank, mark := mark)).mark AS mark FROM r JOIN p3 ON r.source IS NOT DISTINCT FROM p3.source
  WHERE size < 2 * have AND NOT mark IN (SELECT mark FROM t3) GROUP BY r.source),
e AS (SELECT mark FROM t3 UNION ALL SELECT mark FROM x)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies
FROM (SELECT *, whole + CASE WHEN mark IN (SELECT mark FROM e) THEN 1 ELSE 0 END AS copies FROM m)
"""
)
