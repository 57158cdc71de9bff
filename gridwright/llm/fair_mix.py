"""Mixing sources to target weights by weighted fair queueing.

Every source is a stream of its documents in a fixed shuffled order, repeated up to `cap`
times. A copy's virtual finish time is the source's words so far, its own included, divided
by the source's target. Copies are taken by finish time over all sources until the budget,
the words of the whole input, is spent.

Both prefix sums, of a source's words in shuffled order and of the queue's words by finish time,
come from a global range sort: rows are dealt to ranges of about ROWS by all that orders them and a
number of their own, so a hot source, a repeated or null id, or a tie is cut like any other run of
rows; each range is summed up once, and only in the range where the budget ends is the cut sought.

Defined cases: null and blank texts have size 0 and nothing is taken of them; null is a source
of its own, the last; rows that repeat are documents of their own; an empty table gives an
empty result; columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import again_shuffled, files_for, materialize, release, table, word_count

WEIGHTS, CAP, SEED = (5, 2, 1), 3, "mix-1"
ROWS = 500_000


def shuffle_key(doc_id: Column) -> Column:
    """60 bits that order documents as if drawn, and alike in any engine that has MD5."""
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, rank, source_size, target, budget) from one row for each source: shares by weight, none above cap times its size, the excess shared again.

    By rising cap * size / weight, the sources that stop at their cap come first: one does while its cap is at most its share of what those before it leave."""
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    everything, rising = W.partitionBy(), W.orderBy((F.col("top") / F.col("w")), "rank")
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    shared = (
        ranked.withColumns({"w": weight, "top": F.col("source_size") * cap})
        .withColumns({"budget": F.sum("source_size").over(everything), "w_all": F.sum("w").over(everything)})
        .withColumns({"left": F.col("budget") - F.coalesce(F.sum("top").over(before), F.lit(0)), "w_left": F.col("w_all") - F.coalesce(F.sum("w").over(before), F.lit(0))})
        .withColumn("capped", F.col("top").cast("decimal(38,0)") * F.col("w_left") <= F.col("w").cast("decimal(38,0)") * F.col("left"))
    )
    free, held = F.when(~F.col("capped"), F.col("w")), F.when(F.col("capped"), F.col("top"))
    rest = F.col("budget") - F.coalesce(F.sum(held).over(everything), F.lit(0))
    target = F.when(F.col("capped"), F.col("top").cast("double")).otherwise(F.col("w") * rest.cast("double") / F.sum(free).over(everything))
    return shared.select("source", "rank", "source_size", target.alias("target"), "budget", *[c for c in sizes.columns if c not in ("source", "source_size")])


def in_ranges(df: DataFrame, n: int, order: list[str], files: int) -> DataFrame:
    """df, sorted globally into n ranges: part is a row's range, of which a file may hold several."""
    return materialize(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), files)


def before_ranges(ranged: DataFrame, groups: list[str]) -> DataFrame:
    """groups, part, before, n: the sum of size over the ranges before one, and over its own rows; a row for each range and group in it."""
    sums = ranged.groupBy(*groups, "part").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*groups).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sums.select(*groups, "part", before.alias("before"), "n")


def running_sum(groups: list[str], order: list[str]) -> Column:
    return F.sum("size").over(W.partitionBy("part", *groups).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def fair_mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, size, source_size, target, taken, copies: one row for each document."""
    spark, files = docs.sparkSession, files_for(docs)
    t = F.xxhash64(F.coalesce("text", F.lit("")))
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), shuffle_key(F.col("doc_id")).alias("h"), t.alias("t")).withColumn("rid", F.monotonically_increasing_id()))
    targets = materialize(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), weights, cap))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(targets.agg(F.sum("rows")).first()[0] or 0) // ROWS))
    ranked = sized.alias("s").join(again_shuffled(targets).alias("t"), F.expr("s.source <=> t.source")).select("s.doc_id", "size", "h", "t", "rid", "rank", "source_size", "target")
    shuffled = ["rank", "h", "doc_id", "size", "t", "rid"]
    ranged = in_ranges(ranked, n, shuffled, files)
    summed = ranged.withColumn("inside", running_sum(["rank"], shuffled)).join(again_shuffled(before_ranges(ranged, ["rank"])), ["rank", "part"])
    placed = materialize(summed.withColumn("upto", F.col("before") + F.col("inside")).drop("before", "inside", "n", "part"), files)
    release(sized, ranged)

    # A copy's words so far, and what orders the queue; written alike for a column and for the cut.
    so_far = lambda k: F.col("upto") + (k - 1) * F.col("source_size")
    within_target = lambda k: (F.col("size") > 0) & (so_far(k) - F.col("size") < F.col("target"))
    order = ["finish", "rank", "copy", "h", "doc_id", "size", "t", "rid"]
    queue = placed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(cap)))).where(within_target(F.col("copy"))).select((so_far(F.col("copy")) / F.col("target")).alias("finish"), *order[1:])
    cut = _cut(queue, n, order, targets.agg(F.max("budget")).first()[0], files)
    n_copies = F.lit(0)
    for k in range(1, cap + 1):
        taken = within_target(F.lit(k))
        if cut is not None:
            kinds = dict(queue.dtypes)
            mine = F.struct((so_far(F.lit(k)) / F.col("target")).alias("finish"), "rank", F.lit(k).alias("copy"), *order[3:])
            taken &= mine < F.struct(*[F.lit(cut[c]).cast(kinds[c]).alias(c) for c in order])
        n_copies = n_copies + F.when(taken, 1).otherwise(0)
    return placed.withColumn("copies", n_copies).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


def _cut(queue: DataFrame, n: int, order: list[str], budget, files: int):
    """The first copy, by finish time, that would take the mix beyond its budget; None if none does. Two single rows come to the driver."""
    ranged = in_ranges(queue, n, order, files)
    at = before_ranges(ranged, []).where(F.col("before") + F.col("n") > F.lit(budget)).orderBy("part").first()
    first = None
    if at is not None:
        inside = ranged.where(F.col("part") == at["part"]).withColumn("upto", F.lit(at["before"]) + running_sum([], order))
        first = inside.where(F.col("upto") > F.lit(budget)).orderBy(*order).select(*order).first()
    release(ranged)
    return first


def op7_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, row_number() OVER () AS rid, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(rank - 1) % {len(WEIGHTS)} + 1] AS w, {CAP} * source_size AS top, sum(source_size) OVER () AS budget FROM src),
f AS (SELECT *, budget - coalesce(sum(top) OVER before, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS w_rest
      FROM w WINDOW before AS (ORDER BY top / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, top * w_rest <= w * rest AS capped FROM f),
t AS (SELECT source, rank, source_size, budget, CASE WHEN capped THEN CAST(top AS DOUBLE)
        ELSE w * CAST(budget - coalesce(sum(CASE WHEN capped THEN top END) OVER (), 0) AS DOUBLE) / CAST(sum(CASE WHEN NOT capped THEN w END) OVER () AS DOUBLE) END AS target FROM c),
p AS (SELECT d.doc_id, d.rid, d.size, d.h, t.rank, t.source_size, t.target, t.budget,
        sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
      FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT p.*, n.n AS copy, CAST(upto + (n.n - 1) * source_size AS DOUBLE) / target AS finish
      FROM p, (SELECT unnest(range(1, {CAP} + 1)) AS n) n WHERE size > 0 AND upto + (n.n - 1) * source_size - size < target),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, copy, h, doc_id, size ROWS UNBOUNDED PRECEDING) AS running FROM q),
k AS (SELECT rid, count(*) AS n FROM r WHERE running <= budget GROUP BY rid)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(p.size * coalesce(k.n, 0) AS BIGINT) AS taken, CAST(coalesce(k.n, 0) AS INTEGER) AS copies
FROM p LEFT JOIN k USING (rid)
"""
