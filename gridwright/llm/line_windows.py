"""Line dedup by overlapping windows of three lines.

Lines are the \n-split parts of a text that hold a word, compared without the blanks around
them. Every three consecutive lines are a window (a text of one or two lines is one window of
all its lines). A window's first occurrence, by doc_id and then position, stays; the lines that
later occurrences cover, merged into spans, go. Blank lines inside a removed span go with it.

A passage laid out as one or two lines among others is in no equal window unless its neighbours
are equal too, so it stays: that is the method's limit.

Only hashes and positions (128 bits, a key and an integer for each line) cross the first
exchanges. Joins have plain exchanges on either side, so adaptive execution splits a window that
a third of all texts share.

Defined cases: null and blank texts have no lines and stay as they are; a null doc_id sorts first,
and texts that share an id follow each other by key; of rows equal in doc_id and text one is the
document, and the others, later ones, lose all their lines (such rows alone are written to the
shared folder, where they get numbers of their own); an empty table gives an empty result; other
columns are carried through by dedup_lines and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import again_shuffled, keyed, let, materialize, table

WIDTH = 3


def _lines(text: Column) -> Column:
    """(at, line) for each line with a word; at: its index among all \n-split lines."""
    split = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(i.alias("at"), F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "").alias("line")))
    return F.filter(split, lambda x: x["line"] != "")


def _windows(lines: Column, width: int) -> Column:
    """(start, stop, h1, h2): the \n-split lines that each window covers, and its 128 bits."""
    hashed = F.transform(lines, lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["line"]).alias("a"), F.xxhash64(F.lit(1), x["line"]).alias("b")))

    def all_of(h: Column) -> Column:
        n = F.size(h)
        span = F.least(n, F.lit(width))

        def window(i: Column) -> Column:
            part = F.slice(h, i + 1, span)
            return F.struct(F.get(h, i)["at"].alias("start"), (F.get(h, i + span - 1)["at"] + 1).alias("stop"), F.xxhash64(part["a"]).alias("h1"), F.xxhash64(F.lit(1), part["b"]).alias("h2"))

        return F.when(n == 0, F.array().cast("array<struct<start:int,stop:int,h1:bigint,h2:bigint>>")).otherwise(F.transform(F.sequence(F.lit(0), n - span), window))

    return let(hashed, all_of)


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs(doc_id, text) -> k1, k2, spans: for each document that loses lines, its merged spans of \n-split lines, [start, stop)."""
    rows = keyed(docs, "doc_id", "text")
    windows = rows.select("doc_id", "k1", "k2", F.explode(_windows(_lines(F.col("text")), width)).alias("w")).select("doc_id", "k1", "k2", "w.*")
    place = F.struct(F.col("doc_id").isNotNull().alias("x"), "doc_id", "k1", "k2", "start")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("h1", "h2", "first")
    later = windows.join(again_shuffled(first), ["h1", "h2"]).where(place != F.col("first")).groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("later"))

    def merged(a: Column) -> Column:
        """Starts that lie beyond the line before's stop open a span; as windows shift by one line, stops rise with starts."""
        opens = F.filter(F.transform(a, lambda x, i: F.when((i == 0) | (x["start"] > F.get(a, i - 1)["stop"]), x["start"])), lambda x: x.isNotNull())
        shuts = F.filter(F.transform(a, lambda x, i: F.when((i == F.size(a) - 1) | (F.get(a, i + 1)["start"] > x["stop"]), x["stop"])), lambda x: x.isNotNull())
        return F.zip_with(opens, shuts, lambda o, s: F.struct(o.alias("start"), s.alias("stop")))

    return later.select("k1", "k2", let(F.col("later"), merged).alias("spans"))


def _without(text: Column, spans: Column) -> Column:
    """text without the lines of spans: the slices between them, joined again."""
    def kept(lines: Column) -> Column:
        stops = F.concat(F.array(F.lit(0)), spans["stop"])
        starts = F.concat(spans["start"], F.array(F.size(lines)))
        return F.flatten(F.zip_with(stops, starts, lambda a, b: F.slice(lines, a + 1, b - a)))

    return F.array_join(let(F.split(text, "\n"), kept), "\n")


def dedup_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with text without repeated windows, and line_spans: what was removed (null: nothing). Other columns stay."""
    spans = repeated_spans(docs, width).select(F.col("k1").alias("__a"), F.col("k2").alias("__b"), F.col("spans").alias("__s"))
    first = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in ("doc_id", "text")]
    mine = docs.withColumns({"__k1": F.xxhash64(*first), "__k2": F.xxhash64(F.lit(1), *reversed(first))})
    same_key = F.expr("__k1 = __a and __k2 = __b")
    clean = lambda s: F.when(s.isNull(), F.col("text")).otherwise(_without(F.col("text"), s))
    told = lambda df, s: df.select(*[clean(s).alias("text") if c == "text" else F.col(c) for c in docs.columns if c != "line_spans"], s.alias("line_spans"))

    repeated = keyed(docs, "doc_id", "text").groupBy(F.col("k1").alias("__a"), F.col("k2").alias("__b")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    repeated = materialize(repeated)
    if repeated.isEmpty():
        return told(mine.join(again_shuffled(spans), same_key, "left"), F.col("__s"))
    single = mine.join(again_shuffled(repeated), same_key, "left_anti").join(again_shuffled(spans), same_key, "left")
    several = materialize(mine.join(again_shuffled(repeated), same_key, "left_semi").withColumn("__r", F.monotonically_increasing_id()))
    least = several.groupBy(F.col("__k1").alias("__a"), F.col("__k2").alias("__b")).agg(F.min("__r").alias("__first")).alias("m").join(spans.alias("s"), ["__a", "__b"], "left")
    lines = _lines(F.col("text"))
    whole = let(lines, lambda x: F.when(F.size(x) > 0, F.array(F.struct(F.get(x, F.lit(0))["at"].alias("start"), (F.get(x, F.size(x) - 1)["at"] + 1).alias("stop")))))
    copies = several.join(again_shuffled(least), same_key).withColumn("__s", F.when(F.col("__r") == F.col("__first"), F.col("__s")).otherwise(whole))
    return told(single, F.col("__s")).unionByName(told(copies, F.col("__s")))


def op8_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("whole"))
    text, spans = F.col("text"), F.col("line_spans")
    n = lambda x: F.size(_lines(x)).cast("long")
    return dedup_lines(docs).select(
        "doc_id",
        n(F.col("whole")).alias("n_lines"),
        F.when(spans.isNull(), 0).otherwise(n(F.col("whole")) - n(text)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["stop"])), ","), F.lit("")).alias("spans"),
        F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("clean_md5"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
l0 AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM d),
l AS (SELECT doc_id, text, pos, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l0),
n AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY doc_id, text) AS m FROM l WHERE line <> '' WINDOW w AS (PARTITION BY doc_id, text ORDER BY pos)),
win AS (SELECT doc_id, text, i, pos AS start, m,
          CASE WHEN m >= 3 THEN lead(pos, 2) OVER w WHEN m = 2 THEN lead(pos, 1) OVER w ELSE pos END + 1 AS stop,
          CASE WHEN m >= 3 THEN [line, lead(line, 1) OVER w, lead(line, 2) OVER w] WHEN m = 2 THEN [line, lead(line, 1) OVER w] ELSE [line] END AS lines
        FROM n WINDOW w AS (PARTITION BY doc_id, text ORDER BY pos)),
win2 AS (SELECT * FROM win WHERE i = 0 OR i + 3 <= m),
later AS (SELECT doc_id, text, start, stop FROM (SELECT *, row_number() OVER (PARTITION BY lines ORDER BY doc_id NULLS FIRST, md5(coalesce(text, '')), start) AS k FROM win2) WHERE k > 1),
gone AS (SELECT DISTINCT l0.doc_id, l0.text, l0.pos FROM l0 JOIN later ON l0.doc_id IS NOT DISTINCT FROM later.doc_id AND l0.text = later.text AND l0.pos >= later.start AND l0.pos < later.stop),
isl AS (SELECT doc_id, text, min(pos) AS a, max(pos) + 1 AS b FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) AS g FROM gone) GROUP BY doc_id, text, g),
sp AS (SELECT doc_id, text, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM isl GROUP BY doc_id, text),
k AS (SELECT l.doc_id, l.text, count(*) FILTER (l.line <> '') AS n_lines, count(*) FILTER (l.line <> '' AND gone.pos IS NOT NULL) AS n_removed
      FROM l LEFT JOIN gone ON l.doc_id IS NOT DISTINCT FROM gone.doc_id AND l.text = gone.text AND l.pos = gone.pos GROUP BY l.doc_id, l.text),
c AS (SELECT l0.doc_id, l0.text, md5(string_agg(l0.raw, chr(10) ORDER BY l0.pos)) AS clean_md5
      FROM l0 LEFT JOIN gone ON l0.doc_id IS NOT DISTINCT FROM gone.doc_id AND l0.text = gone.text AND l0.pos = gone.pos WHERE gone.pos IS NULL GROUP BY l0.doc_id, l0.text)
SELECT o.doc_id, k.n_lines, k.n_removed, coalesce(sp.spans, '') AS spans, coalesce(c.clean_md5, md5('')) AS clean_md5
FROM documents o JOIN k ON o.doc_id IS NOT DISTINCT FROM k.doc_id AND o.text IS NOT DISTINCT FROM k.text
LEFT JOIN sp ON o.doc_id IS NOT DISTINCT FROM sp.doc_id AND o.text IS NOT DISTINCT FROM sp.text
LEFT JOIN c ON o.doc_id IS NOT DISTINCT FROM c.doc_id AND o.text IS NOT DISTINCT FROM c.text
"""
