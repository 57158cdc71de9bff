"""N-gram Jaccard join with Bayesian candidate pruning.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more.
Words are runs of ASCII letters, digits and non-ASCII characters, ASCII-lowered, so punctuation and
case don't count; a text of one to four words has one shingle of them all; a text without words has
none and no links.

1. Equal texts, told apart by 128 bits, are one node, numbered when the nodes are written. Each has
   HASHES MinHash values; BANDS bands of ROWS of them name its buckets (a pair at 0.8 shares one
   with a chance of 0.99995, a higher one with more).
2. Of buckets with equal members one is kept. In a bucket, MinHash values are compared STEP at a
   time; a pair is dropped as soon as the posterior probability that its similarity reaches the
   threshold, under a uniform prior, is below TOLERANCE. Of the pairs that survive, a bucket tells
   only a spanning forest, so a bucket of n texts sends at most n rows on.
3. Connected components of these edges bring together all texts that can be linked. There pairs are
   pruned the same way and the rest verified exactly on whole shingle sets.
4. Components of the verified links are the classes: class_id is the least doc_id in one, and
   class_key, 128 bits in hex, tells classes apart that share a doc_id.

Where only the classes count (all buckets, and keep_one), a large group is first compared with one
of its texts, its pivot; what is linked with that is settled, and only pairs with a text that isn't
are compared further. jaccard_join counts links, so there every pair of a component is.

Groups of more than BLOCK texts with their shingles, or BUCKET_BLOCK without, are cut into blocks,
each pair of which is a task's unit: no group meets in one task, no pair is lost, none is counted
twice, and pairs are never rows. A group has BLOCKS blocks at most, so a text, with its shingles,
which are made once, is sent to that many tasks; only where a block would exceed MOST texts or
shingles are there more.

Defined cases: a null text is a text without words; copies of a text share its class and links;
rows may repeat and doc_id may be null (a class of null ids only has class_id null) or stand on
several texts; an empty table gives an empty result; other columns are ignored (keep_one carries
them through).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import again_shuffled, files_for, materialize, release, table
from .components import components

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
HASHES, STEP, TOLERANCE = BANDS * ROWS, 25, 1e-5
BLOCK, BLOCK_SHINGLES, BUCKET_BLOCK, BLOCKS, TILE = 64, 200_000, 256, 24, 512
MOST, MOST_SHINGLES = 40_000, 16_000_000
U = np.uint64

_random = np.random.default_rng(5)
_XOR, _TIMES = _random.integers(0, 2**64, size=(2, HASHES), dtype=U)
_TIMES |= U(1)


def keys_of(text: Column) -> list[Column]:
    """128 bits for a text; equal texts, and null and the empty text, have the same."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2")]


def sets(texts: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each text, with repeats, and how many each has."""
    w = tb.words(texts, tb.ALNUM)
    return tb.shingles(w.hashes, w.counts, WIDTH)


def minhashes(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts, HASHES) uint32; rows of texts without shingles are zero."""
    out = np.zeros((len(counts), HASHES), np.uint32)
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        for k in range(HASHES):
            out[some, k] = np.minimum.reduceat((shingles ^ _XOR[k]) * _TIMES[k], starts) >> U(32)
    return out


def buckets(signatures: np.ndarray) -> np.ndarray:
    """(texts, BANDS) int64."""
    s = signatures.reshape(len(signatures), BANDS, ROWS).astype(U)
    h = np.broadcast_to(np.arange(BANDS, dtype=U), s.shape[:2]).copy()
    for j in range(ROWS):
        h = tb.mix(h * U(0x9E3779B97F4A7C15) + s[:, :, j])
    return h.view(np.int64)


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest matches among n MinHash values with which P(similarity >= threshold) is not below tolerance. Under a uniform prior that probability is P(Binomial(n + 1, threshold) <= matches)."""
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n


_LEAST = [least_matches(n) for n in range(STEP, HASHES + 1, STEP)]


def surviving(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of a, j of b; i < j if a is b) that are not dropped on the way through all MinHash values."""
    i = j = None
    matches = np.zeros(0, np.int64)
    for step, least in enumerate(_LEAST):
        cut = slice(step * STEP, (step + 1) * STEP)
        if i is None:
            found = np.zeros((len(a), len(b)), np.int16)
            for k in range(cut.start, cut.stop):
                found += a[:, None, k] == b[None, :, k]
            keep = found >= least
            if same:
                keep = np.triu(keep, 1)
            i, j = np.nonzero(keep)
            matches = found[i, j].astype(np.int64)
        else:
            for at in range(0, len(i), 1 << 16):
                part = slice(at, at + (1 << 16))
                matches[part] += (a[i[part], cut] == b[j[part], cut]).sum(1)
            keep = matches >= least
            i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each of n members' components under the edges i - j."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = new[new]
        if (new == label).all():
            break
        label = new[label]
    while (label[label] != label).any():
        label = label[label]
    return label


def verified(own: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs of sorted shingle sets reach the threshold."""
    used = np.unique(np.append(i, j))
    own, i, j = [own[k] for k in used], np.searchsorted(used, i), np.searchsorted(used, j)
    size = np.array([len(x) for x in own])
    if len(i) < 4 * len(own):
        both = np.array([len(np.intersect1d(own[p], own[q], assume_unique=True)) for p, q in zip(i, j, strict=True)], np.int64)
    else:  # many pairs: product of the 0/1 matrix of texts and shared shingles, some columns at a time
        vocabulary, column, n = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        text = np.repeat(np.arange(len(own)), size)
        shared = np.flatnonzero(n > 1)
        place = np.full(len(vocabulary), -1)
        place[shared] = np.arange(len(shared))
        column = place[column]
        text, column = text[column >= 0], column[column >= 0]
        order = np.argsort(column, kind="stable")
        text, column = text[order], column[order]
        total = np.zeros((len(own), len(own)), np.float32)
        for at in range(0, len(shared), 4096):
            lo, hi = np.searchsorted(column, (at, at + 4096))
            part = np.zeros((len(own), 4096), np.float32)
            part[text[lo:hi], column[lo:hi] - at] = 1
            total += part @ part.T
        both = total[i, j].astype(np.int64)
    return both >= threshold * (size[i] + size[j] - both) - 1e-9


def _signed(batches):
    for batch in batches:
        for texts in tb.chunks(batch.column("text")):
            shingle, counts = sets(texts)
            signature = minhashes(shingle, counts)
            part = batch.slice(texts.first, len(texts))
            flat = pa.array([x.tobytes() for x in signature], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "k1", "k2")), pa.array(counts.astype(np.int64)), flat], ["doc_id", "k1", "k2", "n_shingles", "signature"])


def _banded(batches):
    for batch in batches:
        s = _matrix(batch.column("signature"))
        keys = buckets(s)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), BANDS)), pa.array(keys.ravel())], ["node", "grp"])


def _shingled(batches):
    """The texts' sorted shingle sets in their place."""
    for batch in batches:
        for texts in tb.chunks(batch.column("text")):
            shingle, counts = sets(texts)
            own = [np.unique(x).tobytes() for x in np.split(shingle, np.cumsum(counts)[:-1])]
            part = batch.slice(texts.first, len(texts))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("grp", "node", "signature")), pa.array(own, pa.binary())], ["grp", "node", "signature", "shingles"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), HASHES)


def groups(batches, *keys: str):
    """Tables of rows that agree in keys, from batches sorted by them. A group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and tuple(c[0] for c in columns) != last
        cuts = np.flatnonzero(change)
        lo = 0
        for cut in cuts:
            if cut > lo:
                held.append(batch.slice(lo, cut - lo))
            if held:
                yield pa.Table.from_batches(held)
            held, lo = [], int(cut)
        held.append(batch.slice(lo))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def linked(t: pa.Table, a: np.ndarray, b: np.ndarray, same: bool):
    """Pairs of rows (of a, of b; each pair once if they are the same) that survive and, if t has shingles, reach the threshold: some at a time, as two arrays of rows."""
    s = _matrix(t.column("signature"))
    own = [np.frombuffer(x, U) for x in t.column("shingles").to_pylist()] if "shingles" in t.column_names else None
    for x in range(0, len(a), TILE):
        for y in range(x if same else 0, len(b), TILE):
            rows, columns = a[x : x + TILE], b[y : y + TILE]
            i, j = surviving(s[rows], s[columns], same and x == y)
            i, j = rows[i], columns[j]
            if own is not None and len(i):
                yes = verified(own, i, j)
                i, j = i[yes], j[yes]
            if len(i):
                yield i, j


def _told(node: np.ndarray, root: np.ndarray, links: np.ndarray):
    some = np.flatnonzero(links)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(root[some]), pa.array(links[some].astype(np.int64))], ["node", "root", "links"])


def _forests(batches):
    """For each pair of blocks: its nodes that are linked with a lesser one, and the least node they are connected to."""
    for batch in _by_blocks(batches):
        yield batch.filter(pc.not_equal(batch.column("node"), batch.column("root")))


def _by_blocks(batches):
    """For each pair of blocks: its nodes with links, a node that stands for all they are connected to, and their links."""
    for t in groups(batches, "grp", "lo", "hi"):
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        block, node = t.column("block").to_numpy(), t.column("node").to_numpy()
        links, edges = np.zeros(len(node), np.int64), [np.empty((2, 0), np.int64)]
        for i, j in linked(t, np.flatnonzero(block == lo), np.flatnonzero(block == hi), lo == hi):
            links += np.bincount(i, minlength=len(node)) + np.bincount(j, minlength=len(node))
            used = np.unique(np.append(i, j))
            label = used[forest(len(used), np.searchsorted(used, i), np.searchsorted(used, j))]
            edges.append(np.stack([used, label])[:, used != label])
        label = forest(len(node), *np.concatenate(edges, axis=1))
        yield from _told(node, node[label], links)


def _by_pivot(batches):
    """For each block of a group and its pivot: the nodes linked with that, which is their root."""
    for t in groups(batches, "grp", "block"):
        node = t.column("node").to_numpy()
        pivot, grp = t.column("pivot")[0].as_py(), t.column("grp")[0].as_py()
        found = [j for _, j in linked(t, np.flatnonzero(node == pivot), np.flatnonzero(node != pivot), False)]
        if found:
            j = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), grp)), pa.array(node[j]), pa.array(np.full(len(j), pivot))], ["grp", "node", "root"])


def blocks_of(n: Column, shingles: Column | None = None) -> Column:
    """Into how many blocks n texts with so many shingles, or without any, are cut."""
    cut = lambda of, least, most: F.greatest(F.least(F.ceil(of / least), F.lit(BLOCKS)), F.ceil(of / most))
    return (cut(n, BUCKET_BLOCK, MOST) if shingles is None else F.greatest(cut(n, BLOCK, MOST), cut(shingles, BLOCK_SHINGLES, MOST_SHINGLES))).cast("int")


def _block(of: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), "node"), of).cast("int")


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows(grp, node, rest, n_rest, n_done, ...) once for each pair of blocks that holds rest: lo, hi, and block, the row's own. n_rest, n_done: into how many blocks the group's rest, and what is settled, are cut."""
    block = F.when(F.col("rest"), _block(F.col("n_rest"))).otherwise(F.col("n_rest") + _block(F.greatest(F.col("n_done"), F.lit(1))))
    other = F.explode(F.sequence(F.lit(0), F.col("n_rest") + F.when(F.col("rest"), F.col("n_done")).otherwise(0) - 1))
    rows = rows.withColumn("block", block).withColumn("__o", other).withColumns({"lo": F.least("block", "__o"), "hi": F.greatest("block", "__o")}).drop("__o", "rest", "n_rest", "n_done")
    pair = F.expr("shiftright(cast(hi as bigint) * (hi + 1), 1) + lo")
    return _dealt(rows, pair).sortWithinPartitions("grp", "lo", "hi", "node")


def _dealt(rows: DataFrame, unit: Column) -> DataFrame:
    """rows by group and unit of work: a group's units go to consecutive partitions, where hashes of (group, unit) would put several into one."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionById(n, (F.pmod(F.xxhash64("grp"), F.lit(n)) + F.pmod(unit, F.lit(n))).cast("int"))


LINKS = "node bigint, root bigint, links bigint"


def all_links(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """rows(grp, node, signature, shingles), sized(grp, n, shingles) -> node, root, links: every pair of every group is compared."""
    dealt = sized.select("grp", blocks_of(F.col("n"), F.col("n_shingles")).alias("n_rest"))
    return in_blocks(rows.join(again_shuffled(dealt), "grp").withColumns({"rest": F.lit(True), "n_done": F.lit(0)})).mapInArrow(_by_blocks, LINKS)


def spanning(rows: DataFrame, sized: DataFrame, files: int) -> DataFrame:
    """rows(grp, node, signature, and shingles if links are to be verified), sized(grp, n, pivot, and n_shingles then) -> node, root: a spanning forest of each group's links, from far fewer pairs than all_links. rows must be written: they are read more than once. files: into how many to write what is made of them."""
    of = lambda n, share: blocks_of(n, F.col("n_shingles") * share) if "shingles" in rows.columns else blocks_of(n)
    sized = materialize(sized.withColumn("blocks", of(F.col("n"), F.lit(1))), files)
    whole = rows.join(again_shuffled(sized.where("blocks = 1").select("grp", F.col("blocks").alias("n_rest"))), "grp")
    out = in_blocks(whole.withColumns({"rest": F.lit(True), "n_done": F.lit(0)})).mapInArrow(_forests, LINKS).select("node", "root")
    if sized.where("blocks > 1").isEmpty():
        return out
    large = rows.join(again_shuffled(sized.where("blocks > 1").select("grp", "pivot", "blocks")), "grp")
    block = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(_block(F.col("blocks"))))
    dealt = large.withColumn("block", F.explode(block)).drop("blocks")
    linked_with = materialize(_dealt(dealt, F.col("block")).sortWithinPartitions("grp", "block", "node").mapInArrow(_by_pivot, "grp bigint, node bigint, root bigint").repartition(files))
    is_done = large.select("grp", "node", "pivot").alias("l").join(again_shuffled(linked_with).alias("w"), F.expr("l.grp = w.grp and l.node = w.node"), "left").select("l.grp", "l.node", (F.col("w.node").isNull() & (F.col("l.node") != F.col("pivot"))).alias("rest"))
    is_done = materialize(is_done, files)
    left = is_done.groupBy("grp").agg(F.count_if("rest").alias("r"), F.count_if(~F.col("rest")).alias("d")).where("r > 0").join(sized, "grp")
    # The group's shingles count for rest and settled texts by their share of texts.
    left = left.select("grp", *[F.greatest(of(F.col(c), F.col(c) / F.col("n")), F.lit(1)).alias(name) for c, name in (("r", "n_rest"), ("d", "n_done"))])
    further = is_done.join(again_shuffled(left), "grp")
    pairs = again_shuffled(further).alias("f").join(rows.alias("o"), F.expr("f.grp = o.grp and f.node = o.node")).select("o.*", "rest", "n_rest", "n_done")
    return out.unionByName(linked_with.select("node", "root")).unionByName(in_blocks(pairs).mapInArrow(_forests, LINKS).select("node", "root"))


def near_duplicate_classes(docs: DataFrame, count: bool = True) -> DataFrame:
    """docs(doc_id, text) -> k1, k2, root (the same for all texts of a class), class_id, class_key, n_links (if count), n_copies, n_shingles: one row for each distinct text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    files = files_for(docs)
    rows = docs.select("doc_id", "text", *keys_of(F.col("text")))
    signed = rows.mapInArrow(_signed, f"doc_id {kind}, k1 bigint, k2 bigint, n_shingles bigint, signature binary")
    one = signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_copies"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    nodes = materialize(one.withColumn("node", F.monotonically_increasing_id()), files)

    in_bucket = nodes.where("n_shingles > 0").select("node", "signature").mapInArrow(_banded, "node bigint, grp bigint")
    sums = [F.sum(F.xxhash64(F.lit(i), "node") % (1 << 40)).alias(f"h{i}") for i in (1, 2)]
    sized = in_bucket.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *sums, F.min("node").alias("a"), F.max("node").alias("z")).where("n > 1")
    kept = materialize(sized.groupBy("n", "h1", "h2", "a", "z").agg(F.min("grp").alias("grp")).select("grp", "n", F.col("a").alias("pivot")), files)
    members = in_bucket.join(again_shuffled(kept.select("grp")), "grp")
    compared = materialize(again_shuffled(members).join(nodes.select("node", "signature"), "node"), files)
    likely = materialize(components(spanning(compared, kept, files).select(F.col("node").alias("u"), F.col("root").alias("v")), files).select("node", F.col("root").alias("grp")), files)
    release(compared, kept)

    known = likely.join(nodes, "node")
    sized = known.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("n_shingles"), F.min("node").alias("pivot"))
    placed = known.select("k1", "k2", "node", "grp", "signature", "first_doc")
    whole = rows.alias("r").join(again_shuffled(placed).alias("p"), F.expr("r.k1 = p.k1 and r.k2 = p.k2 and r.doc_id <=> p.first_doc")).select("p.node", "grp", "signature", "text").dropDuplicates(["node"])
    own = whole.mapInArrow(_shingled, "grp bigint, node bigint, signature binary, shingles binary")
    own = own if count else materialize(own, files)
    # Units of work stay tasks of their own; only the links are brought together.
    links = materialize((all_links(own, sized) if count else spanning(own, sized, files)).repartition(files))
    release(own)

    roots = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")), files)
    with_root = nodes.drop("signature").join(again_shuffled(roots), "node", "left").withColumns({"is_linked": F.col("root").isNotNull(), "root": F.coalesce("root", "node")})
    if count:
        counted = links.groupBy("node").agg(F.sum("links").alias("n_links"))
        with_root = with_root.join(again_shuffled(counted), "node", "left").na.fill(0, ["n_links"])
    with_root = materialize(with_root, files)
    release(nodes, likely, links)
    classes = with_root.where("is_linked").groupBy("root").agg(F.min("first_doc").alias("class_doc"), F.min(F.struct("k1", "k2")).alias("key"))
    key = F.when(F.col("is_linked"), F.col("key")).otherwise(F.struct("k1", "k2"))
    return with_root.join(again_shuffled(classes), "root", "left").select(
        "k1", "k2", "root", F.when(F.col("is_linked"), F.col("class_doc")).otherwise(F.col("first_doc")).alias("class_id"), F.lower(F.concat(*[F.lpad(F.hex(key[c]), 16, "0") for c in ("k1", "k2")])).alias("class_key"), *["n_links"] * count, "n_copies", "n_shingles"
    )


def jaccard_join(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, class_id, class_key, n_links (other texts at the threshold or above), n_copies (rows with this very text), n_shingles: one row for each row."""
    classes = near_duplicate_classes(docs)
    rows = docs.select("doc_id", *keys_of(F.col("text")))
    return rows.join(again_shuffled(classes), ["k1", "k2"]).select("doc_id", "class_id", "class_key", "n_links", "n_copies", "n_shingles")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: that with the class's least doc_id; of rows that share it, one with the least key of its text. All columns stay."""
    classes = near_duplicate_classes(docs, count=False).select(F.col("k1").alias("__a"), F.col("k2").alias("__b"), F.col("root").alias("__root"), F.col("class_id").alias("__id"))
    k1, k2 = keys_of(F.col("text"))
    mine = docs.withColumns({"__k1": k1, "__k2": k2})
    both = mine.join(again_shuffled(classes), F.expr("__k1 = __a and __k2 = __b")).where(F.col("doc_id").eqNullSafe(F.col("__id")))
    # A row for each class is left but where doc_id repeats within it or is null; classes that share an id stay apart.
    rows = both.groupBy("__root").agg(F.min_by(F.struct(*docs.columns), F.struct("__k1", "__k2", *[F.col(c).cast("string") for c in docs.columns if c != "text"])).alias("row"))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op5_bayes_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
