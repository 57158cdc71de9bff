"""The pipeline's stages and its run, against plain versions of each."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from gridwright.llm import bayes_join, components, fair_mix, line_frequency, string_tiling

from .test_defined_cases import plain_dedup, plain_mix
from .test_methods import plain_classes, plain_tiles, plain_tokens, plain_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_repeats(words):
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    return len({j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 3)})


def plain_quality(rows):
    """rows (doc_id, text, source) that stay, with their text."""
    normal = lambda line: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", line.lower())).strip(" ")
    split = lambda t: [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    texts, holders = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        texts[s].add(t or "")
        for line in (t or "").split("\n"):
            if split(line):
                holders[s, normal(line)].add(t or "")
    bad = {k for k, v in holders.items() if len(v) > line_frequency.MIN_DOCS and (len(v) > line_frequency.MAX_DOCS or 100 * len(v) > line_frequency.SHARE * len(texts[k[0]]))}
    out = []
    for d, t, s in rows:
        w = split(t or "")
        if len(w) < 50 or 100 * plain_repeats(w) > 50 * len(w):
            continue
        gone = [line for line in t.split("\n") if (s, normal(line)) in bad]
        if 100 * sum(len(split(normal(x))) for x in gone) <= 70 * len(w):
            out.append((d, "\n".join(x for x in t.split("\n") if (s, normal(x)) not in bad), s))
    return out


def plain_keep(rows):
    classes = plain_classes([(d, t or "") for d, t, _ in rows])
    return [r for r in rows if classes[r[0]][0] == r[0]]


def leaked(text, items):
    q = plain_tokens(text)
    for item in items:
        p = plain_tokens(item)
        if len(p) >= string_tiling.SEED and plain_tiles(p, q, string_tiling.SEED) >= 0.6 * len(p) - 1e-9:
            return True
        if 0 < len(p) < string_tiling.SEED and any(q[i : i + len(p)] == p for i in range(len(q))):
            return True
    return False


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    line = lambda n=14: " ".join(word() for _ in range(n))
    items = [line(12), line(9), "two words"]
    footer, passage = "Footer of the host 12", [line() for _ in range(4)]
    rows = []
    for i in range(70):
        lines = [line() for _ in range(6)]
        if i % 3 == 0:
            lines.append(footer.replace("12", str(i)))
        if i % 7 == 0:
            lines[1:1] = passage
        if i % 9 == 4:
            lines[2] += " " + rng.choice(items[:2])
        if i == 5:
            w = items[0].split()
            lines.append(" ".join(w[6:] + ["and"] + w[:6]))
        rows.append((i, "\n".join(lines), "hot" if i % 3 else rng.choice(["a", "b", None])))
    near = rows[8][1].split(" ")
    near[40] = "changed"
    rows += [(100, rows[2][1], "a"), (101, rows[2][1], "hot"), (102, " ".join(near), "hot"), (103, rows[8][1].upper(), "b"), (104, None, "a"), (105, "", None), (106, "short text", "b"), (107, "again and again " * 40, "b")]
    rows += [(110 + i, "\n".join([footer] * 30 + [line(8)]), "b") for i in range(7)]
    return rows, items


def frames(spark, corpus, tmp):
    rows, items = corpus
    docs = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], SCHEMA).repartition(3)
    docs.write.mode("overwrite").parquet(f"{tmp}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.mode("overwrite").parquet(f"{tmp}/benchmark.parquet")
    return docs


def triples(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def test_stages_and_run_against_plain(spark, corpus, tmp_path):
    rows, items = corpus
    sf = f"file://{tmp_path}"
    docs = frames(spark, corpus, sf)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "decontamination", "mixing"]
    stages = dict(corpus_pipeline.STAGES)

    after = plain_quality(rows)
    got = stages["quality_rules"](spark, docs, sf)
    assert got.columns == docs.columns and triples(got) == Counter(after)
    assert all(r.n_chars == len(r.text) for r in got.collect())
    assert len(after) < len(rows) and any(len(a[1]) < len(b[1]) for a, b in zip(after, [r for r in rows if r[0] in {x[0] for x in after}], strict=True))

    frame = lambda found: spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in found], SCHEMA).repartition(4)
    deduped = [(d, t, s) for (d, _, s), t in zip(after, plain_dedup([(d, t) for d, t, _ in after]), strict=True)]
    got = stages["line_dedup"](spark, frame(after), sf)
    assert got.columns == docs.columns and triples(got) == Counter(deduped) and deduped != after

    kept = plain_keep(deduped)
    got = stages["jaccard_join"](spark, frame(deduped), sf)
    assert got.columns == docs.columns and triples(got) == Counter(kept) and len(kept) < len(deduped)

    clean = [r for r in kept if not leaked(r[1], items)]
    got = stages["decontamination"](spark, frame(kept), sf)
    assert got.columns == docs.columns and triples(got) == Counter(clean) and len(clean) < len(kept)

    want = plain_mix([(d, s, len(plain_words(t))) for d, t, s in clean])
    mixed = lambda df: sorted([(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect()], key=str)
    assert mixed(stages["mixing"](spark, frame(clean), sf)) == want
    assert mixed(corpus_pipeline.run(spark, sf)) == want


def test_small_tables_take_few_files(spark, corpus, tmp_path, monkeypatch):
    """Of however many partitions a small table is made, it is written into few files, each of which starts processes on the executors: what the join and the mix write between, and what stages return."""
    sf = f"file://{tmp_path}"
    rows, items = corpus
    frames(spark, corpus, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    most, written = 2 * spark.sparkContext.defaultParallelism, []
    for module in (bayes_join, components, fair_mix):
        monkeypatch.setattr(module, "materialize", lambda *a, f=module.materialize, of=module.__name__, **b: written.append((of, f(*a, **b))) or written[-1][1])
    monkeypatch.setattr(bayes_join, "release", lambda *_: None)
    monkeypatch.setattr(components, "release", lambda *_: None)
    monkeypatch.setattr(fair_mix, "release", lambda *_: None)
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "20"}
    asked = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf).rdd.getNumPartitions() <= most, name
        assert Counter(r.doc_id for r in corpus_pipeline.jaccard_join(spark, docs, sf).collect()) == Counter(d for d, _, _ in plain_keep(rows))
        mixed = corpus_pipeline.mixing(spark, docs, sf)
        assert sorted([(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixed.collect()], key=str) == plain_mix([(d, s, len(plain_words(t or ""))) for d, t, s in rows])
        assert {of.rsplit(".")[-1] for of, _ in written} == {"bayes_join", "components", "fair_mix"}
        assert [(of, len(df.inputFiles())) for of, df in written if len(df.inputFiles()) > most] == []
    finally:
        for k, v in asked.items():
            spark.conf.set(k, v)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, ids on several texts, further columns, and no rows at all."""
    good = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(8))
    other = "\n".join(" ".join(f"v{i}y{j}" for j in range(12)) for i in range(8))
    long = " ".join(f"l{i}" for i in range(40000))
    rows = [(1, good, None, None, None), (1, good, None, None, None), (1, other, "en", "a", 3), (None, other, "en", "a", 3), (None, None, None, None, None), (2, "", "en", "b", 0), (3, long, "fr", "b", 1), (4, " \n ", None, "é", None)]
    docs = spark.createDataFrame([(*r, "k", 7, 1.5) for r in rows], SCHEMA + ", k1 string, node long, finish double")
    spark.createDataFrame([(None, None), (1, ""), (2, "never seen words at all here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = f"file://{tmp_path}"
    want = {
        "quality_rules": Counter({(1, good): 2, (1, other): 1, (None, other): 1, (3, long): 1}),
        # A null id comes first, so the copy under it stays and the later one goes; of equal rows one stays.
        "line_dedup": Counter({(1, good): 1, (1, ""): 2, (None, other): 1, (None, None): 1, (2, ""): 1, (3, long): 1, (4, " \n "): 1}),
        "decontamination": Counter((r[0], r[1]) for r in rows),
    }
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        found = got.collect()
        if name != "mixing":
            assert got.columns == docs.columns
        if name in want:
            assert Counter((r.doc_id, r.text) for r in found) == want[name], name
        if name == "jaccard_join":
            # other's least id is 1; texts without words are one class, whose least id is 2 and least text the empty one; " \n " has no words and stands alone.
            assert Counter((r.doc_id, r.text) for r in found) == Counter({(1, good): 1, (1, other): 1, (2, ""): 1, (3, long): 1, (4, " \n "): 1})
        if name == "mixing":
            assert len(found) == len(rows) and all(r.taken <= 3 * r["size"] for r in found)
        assert stage(spark, docs.limit(0), sf).count() == 0
