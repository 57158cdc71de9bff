r"""Quality rules: cross-document line frequency.

Lines are \n-split and normalised (lower case, digit runs as 0, blanks collapsed and trimmed),
then hashed to 128 bits. Within a host (here: `source`) a line's count is the number of distinct
texts that hold it, so exact copies of one text, which are deduplication's business, count once.
A line is removed if it is in more than `max_docs` distinct texts of the host, or, on hosts too
small for that, in more than `share` per cent of them and more than `min_docs`; a document that
loses more than `max_loss` per cent of its words this way is depleted and rejected.

The base rules are fixed: a document fails with under 50 words, or when over half of its words lie
in three-word windows that occur twice or more in it.

Only hashes cross exchanges, never texts; counts are pre-aggregated before them, and the table of
frequent lines (at most lines / min_docs for each host) is joined by a plain exchange on either side,
which adaptive execution splits where one line is hot.

Defined cases: a null text is an empty one and fails the base rules; null is a host of its own;
rows equal in source and text get equal results; an empty table gives an empty result; columns
other than doc_id, text and source are ignored (clean_documents carries them through).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, WORD, again_shuffled, keyed, let, materialize, table, word_count, words

MIN_DOCS, SHARE, MAX_DOCS, MAX_LOSS = 5, 10, 100, 70
MIN_WORDS, MAX_REPEAT = 50, 50


def repeated_words(w: Column) -> Column:
    """Words of w in three-word windows that occur twice or more: sort the windows' hashes, keep positions whose neighbour is equal, add up what each new position covers. Texts whose windows all differ, which are most, are not sorted."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    numbered = lambda h: F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    twice = lambda s: F.filter(F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"])), lambda x: x.isNotNull())
    new = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    covered = lambda h: let(F.sort_array(numbered(h)), lambda s: let(F.sort_array(twice(s)), new))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def base_measures(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), all long."""
    t = F.coalesce(text, F.lit(""))
    without = lambda chars: F.length(F.translate(t, chars, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        words(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            without(BLANKS).cast("long").alias("word_chars"),
            (F.length(t) - without("#*$%&|<>")).cast("long").alias("n_symbols"),
            let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long")).alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


def _line_hash(line: Column) -> Column:
    normal = F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), r"[\x20\x09-\x0D]+", " "))
    return let(normal, lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("n")))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """docs(source, text) -> k1, k2, n_gone, bad: for each distinct (source, text) with frequent lines, the words in them and their hashes."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), _line_hash), lambda x: x["n"] > 0)
    rows = keyed(docs, "source", "text").select("source", "k1", "k2", lines.alias("lines"))
    one = materialize(rows.groupBy("k1", "k2").agg(F.first("source").alias("source"), F.first("lines").alias("lines")))
    distinct = F.explode(F.array_distinct(F.transform("lines", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2")))))
    hosts = one.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = one.select("source", distinct.alias("h")).groupBy("source", "h.h1", "h.h2").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > min_docs)
    limits = (F.col("df") > max_docs) | (F.col("df") * 100 > share * F.col("n_docs"))
    over = counts.alias("c").join(hosts.alias("n"), F.expr("c.source <=> n.source")).where(limits).select("c.source", "c.h1", "c.h2")
    held = one.select("k1", "k2", "source", F.explode("lines").alias("x")).alias("l")
    hit = held.join(again_shuffled(over).alias("o"), F.expr("l.x.h1 = o.h1 and l.x.h2 = o.h2 and l.source <=> o.source"))
    return hit.groupBy("k1", "k2").agg(F.sum("x.n").alias("n_gone"), F.collect_set(F.struct(F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2"))).alias("bad"))


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, max_docs: int = MAX_DOCS, max_loss: float = MAX_LOSS) -> DataFrame:
    """docs(doc_id, source, text) -> doc_id, the base measures, base_failed, kept, n_gone_words: one row for each row."""
    rows = docs.select("doc_id", *_keys(), base_measures(F.col("text")).alias("m")).select("doc_id", "k1", "k2", "m.*")
    gone = again_shuffled(frequent_lines(docs, min_docs, share, max_docs).select("k1", "k2", "n_gone"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    n_gone = F.coalesce(F.col("n_gone"), F.lit(0))
    return rows.join(gone, ["k1", "k2"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (100 * n_gone <= max_loss * F.col("n_words"))).alias("kept"), n_gone.cast("long").alias("n_gone_words")
    )


def _keys() -> list[Column]:
    first = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in ("source", "text")]
    return [F.xxhash64(*first).alias("k1"), F.xxhash64(F.lit(1), *reversed(first)).alias("k2")]


def clean_documents(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, max_docs: int = MAX_DOCS, max_loss: float = MAX_LOSS) -> DataFrame:
    """docs without the documents that the rules reject, and without the frequent lines of those kept. All columns stay."""
    k1, k2 = _keys()
    gone = again_shuffled(frequent_lines(docs, min_docs, share, max_docs).select(F.col("k1").alias("__a"), F.col("k2").alias("__b"), F.col("n_gone").alias("__n"), F.col("bad").alias("__bad")))
    # One expression, so that the filter splits a text once; of the measures the rules need only these two.
    sound = let(words(F.col("text")), lambda w: (F.size(w) >= MIN_WORDS) & (100 * repeated_words(w) <= MAX_REPEAT * F.size(w)))
    good = docs.where(sound).withColumns({"__k1": k1, "__k2": k2})
    held = F.col("__n").isNull() | (100 * F.col("__n") <= max_loss * word_count(F.col("text")))
    both = good.join(gone, F.expr("__k1 = __a and __k2 = __b"), "left").where(held)
    key = lambda x: let(_line_hash(x), lambda h: F.struct(h["h1"].alias("h1"), h["h2"].alias("h2")))
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col("__bad"), key(x))), "\n")
    text = F.when(F.col("__bad").isNull(), F.col("text")).otherwise(rest)
    return both.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT rid, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, sum(least(3, coalesce(nxt - i, 3))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid),
ln AS (SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
hl AS (SELECT rid, source, text, line, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS x FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM hl GROUP BY rid),
df AS (SELECT source, x, count(DISTINCT text) AS df FROM hl GROUP BY source, x),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM d GROUP BY source),
bad AS (SELECT df.source, x FROM df JOIN hosts ON df.source IS NOT DISTINCT FROM hosts.source WHERE df > {MIN_DOCS} AND (df > {MAX_DOCS} OR df * 100 > {SHARE} * n)),
gone AS (SELECT rid, sum(len(regexp_extract_all(hl.x, '[^\x20\x09-\x0D]+'))) AS n FROM hl JOIN bad ON hl.x = bad.x AND hl.source IS NOT DISTINCT FROM bad.source GROUP BY rid),
m AS (SELECT d.rid, doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
       CAST(len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_gone_words
      FROM d JOIN w USING (rid) LEFT JOIN dl USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_gone_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AND 100 * n_gone_words <= {MAX_LOSS} * n_words AS kept
FROM m
"""
