r"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters, digits and non-ASCII, ASCII-lowered. A text and a benchmark item that
share seeds (SEED tokens in a row) are tiled: the longest common runs of unmarked tokens are marked
again and again, found by running Karp-Rabin hashes with a search length that falls from the
longest to SEED. An item is leaked into a text if its marked tokens are COVERAGE of it or more, in
whatever order the runs stand. Items of fewer than SEED tokens leak where they occur whole.

The items are the stated set of queries: their size is checked, and they are broadcast in blocks of
at most BLOCK_TOKENS tokens, one pass over the texts for each block. A text is never shuffled. A
pair goes on to tiling only if the item's positions in shared seeds, which bound what tiles of SEED
tokens or more can cover, reach the threshold, so the bound drops no pair.

Defined cases: null and blank texts or items hold no tokens and leak nothing; rows that repeat, on
either side, give rows of their own; null ids are carried; an empty table on either side gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import again_shuffled, keyed, materialize, table

SEED, COVERAGE = 4, 0.6
BLOCK_TOKENS = 4_000_000
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)


def _rolling(tokens: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of every window, each from the last: h' = (h - first * B^(n-1)) * B + next, all at once by prefix sums."""
    n = len(tokens) - length + 1
    if n <= 0:
        return np.empty(0, U)
    power = np.cumprod(np.append(U(1), np.full(len(tokens), _BASE)))
    upto = np.append(U(0), np.cumsum(tokens * power[: len(tokens)][::-1]))  # token i weighs B^(last - i)
    inverse = U(pow(int(_BASE), -1, 1 << 64))
    back = np.cumprod(np.append(U(1), np.full(len(tokens), inverse)))
    return (upto[length:] - upto[:-length]) * back[len(tokens) - length - np.arange(n)]


def _free(marked: np.ndarray, length: int) -> np.ndarray:
    """Starts of windows without a marked token."""
    total = np.append(0, np.cumsum(marked))
    return np.flatnonzero(total[length:] == total[:-length]) if len(marked) >= length else np.empty(0, np.int64)


def greedy_tiles(item: np.ndarray, text: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """(item position, text position, length) of the tiles: longest first, never overlapping on either side. item and text are token hashes."""
    tiles: list[tuple[int, int, int]] = []
    marked_item, marked_text = np.zeros(len(item), bool), np.zeros(len(text), bool)
    length = min(len(item), len(text))
    while length >= least:
        found = []
        hashes = _rolling(text, length)
        at_text = _free(marked_text, length)
        order = at_text[np.argsort(hashes[at_text], kind="stable")]
        known = hashes[order]
        at_item = _free(marked_item, length)
        own = _rolling(item, length)[at_item]
        lo, hi = np.searchsorted(known, own, "left"), np.searchsorted(known, own, "right")
        for p, a, b in zip(at_item, lo, hi, strict=True):
            for t in order[a:b]:
                if (item[p : p + length] == text[t : t + length]).all():
                    n = length
                    while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and not marked_item[p + n] and not marked_text[t + n]:
                        n += 1
                    found.append((n, int(p), int(t)))
        longest = max(found, default=(0,))[0]
        if longest > 2 * length:
            length = longest
            continue
        for n, p, t in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if not marked_item[p : p + n].any() and not marked_text[t : t + n].any():
                marked_item[p : p + n] = marked_text[t : t + n] = True
                tiles.append((p, t, n))
            # What an earlier tile has cut stays for the next, shorter search.
        if length == least:
            if not any(not marked_item[p : p + least].any() and not marked_text[t : t + least].any() for _, p, t in found):
                break
        else:
            length = max(least, length // 2)
    return tiles


class Items:
    """A block of benchmark items, indexed by seed."""

    def __init__(self, ids: pa.Array, texts: list, seed: int = SEED):
        self.ids, self.seed = ids, seed
        self.tokens = []
        for part in tb.chunks(pa.array(texts, pa.string())):
            w = tb.words(part, tb.ALNUM)
            self.tokens += np.split(w.hashes, np.cumsum(w.counts)[:-1])
        self.sizes = np.array([len(x) for x in self.tokens], np.int64)
        hashes, item, place = [np.empty(0, U)], [], []
        self.short: dict[int, list[int]] = {}
        for k, x in enumerate(self.tokens):
            if 0 < len(x) < seed:
                self.short.setdefault(len(x), []).append(k)
                continue
            h = seeds(x, seed)
            hashes.append(h)
            item.append(np.full(len(h), k))
            place.append(np.arange(len(h)))
        hashes = np.concatenate(hashes)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.concatenate(item)[order] if item else np.empty(0, np.int64)
        self.place = np.concatenate(place)[order] if place else np.empty(0, np.int64)
        self.known, self.first, self.times = np.unique(self.hashes, return_index=True, return_counts=True)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.known >> U(44)).astype(np.int64)] = True

    def leaks(self, tokens: np.ndarray, seen: np.ndarray, coverage: float) -> list[tuple[int, int, int]]:
        """(item, tiles, tokens covered) of items that leak into a text. seen: places of its seeds among those known."""
        out = []
        for n, items in self.short.items():
            inside = seeds(tokens, n)
            for k in items:
                if (inside == seeds(self.tokens[k], n)[0]).any():
                    out.append((k, 1, n))
        if len(seen):
            rows = np.concatenate([np.arange(f, f + t) for f, t in zip(self.first[seen], self.times[seen], strict=True)])
            for k in np.unique(self.item[rows]):
                bound = np.zeros(self.sizes[k] + 1, np.int64)
                places = self.place[rows[self.item[rows] == k]]
                np.add.at(bound, places, 1)
                np.add.at(bound, places + self.seed, -1)
                if (np.cumsum(bound[:-1]) > 0).sum() >= coverage * self.sizes[k] - 1e-9:
                    tiles = greedy_tiles(self.tokens[k], tokens, self.seed)
                    covered = sum(n for *_, n in tiles)
                    if covered >= coverage * self.sizes[k] - 1e-9:
                        out.append((int(k), len(tiles), covered))
        return sorted(out)


def seeds(tokens: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n tokens in a row."""
    if len(tokens) < n:
        return np.empty(0, U)
    h = np.zeros(len(tokens) - n + 1, U)
    for j in range(n):
        h = h * _BASE + tokens[j : len(tokens) - n + 1 + j]
    return tb.mix(h)


def _blocks(benchmark: DataFrame):
    """How many blocks there are, and the items in them. Their number of characters decides; a block is what comes to the driver at once."""
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = -(-size // (4 * BLOCK_TOKENS)) or 1
    yield n
    for k in range(n):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").toArrow()
        yield Items(got.column("item_id").combine_chunks(), got.column("text").to_pylist())


def tile_benchmark(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, item_id, n_item_tokens, n_covered, n_tiles, coverage, k1, k2: one row for each text and item leaked into it. k1, k2: the row's key (common.keyed)."""
    rows = keyed(docs, "doc_id", "text")
    kinds = {c: d.schema[c].dataType.simpleString() for c, d in (("doc_id", docs), ("item_id", benchmark))}
    fields = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, n_item_tokens bigint, n_covered bigint, n_tiles bigint, k1 bigint, k2 bigint"
    found = None
    blocks = _blocks(benchmark)
    n = next(blocks)
    for items in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            own = shared.value
            for batch in batches:
                out = []
                for texts in tb.chunks(batch.column("text")):
                    w = tb.words(texts, tb.ALNUM)
                    h = seeds(w.hashes, own.seed)
                    at = np.flatnonzero(own.sieve[(h >> U(44)).astype(np.int64)])
                    place = np.minimum(np.searchsorted(own.known, h[at]), max(0, len(own.known) - 1))
                    hit = own.known[place] == h[at] if len(own.known) else np.zeros(len(at), bool)
                    at, place = at[hit], place[hit]
                    ends = np.cumsum(w.counts)
                    doc = np.searchsorted(ends, at, "right")
                    inside = at + own.seed <= ends[doc] if len(at) else np.zeros(0, bool)
                    doc, place = doc[inside], place[inside]
                    for d in range(len(texts)) if own.short else np.unique(doc):
                        tokens = w.hashes[ends[d] - w.counts[d] : ends[d]]
                        lo, hi = np.searchsorted(doc, (d, d + 1))
                        out += [(texts.first + int(d), *x) for x in own.leaks(tokens, np.unique(place[lo:hi]), coverage)]
                if out:
                    row = pa.array([x[0] for x in out])
                    column = lambda c: batch.column(c).take(row)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [column("doc_id"), own.ids.take(pa.array([x[1] for x in out])), pa.array([int(own.sizes[x[1]]) for x in out]), pa.array([x[3] for x in out]), pa.array([x[2] for x in out]), column("k1"), column("k2")],
                        ["doc_id", "item_id", "n_item_tokens", "n_covered", "n_tiles", "k1", "k2"],
                    )

        part = rows.mapInArrow(run, fields)
        if n > 1:  # each block is done with before the next comes
            part = materialize(part)
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found.withColumn("coverage", F.col("n_covered") / F.col("n_item_tokens"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """docs without the rows into which an item leaked. All columns stay."""
    bad = again_shuffled(tile_benchmark(docs, benchmark, coverage).select(F.col("k1").alias("__a"), F.col("k2").alias("__b")).distinct())
    first = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in ("doc_id", "text")]
    mine = docs.withColumns({"__k1": F.xxhash64(*first), "__k2": F.xxhash64(F.lit(1), *reversed(first))})
    return mine.join(bad, F.expr("__k1 = __a and __k2 = __b"), "left_anti").select(*docs.columns)


def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k1", "k2")
