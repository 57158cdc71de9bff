"""Cases that a review found cut short: each failed before it was mended."""

from __future__ import annotations

import math
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from gridwright.llm import bayes_join, context_tree, line_frequency, zip_warc
from gridwright.storage import shared_dir

from .test_methods import plain_ctw


def test_every_context_is_kept(spark, monkeypatch):
    """Contexts seen once or twice count however long the corpus is; units and parts give what one tree gives."""
    monkeypatch.setattr(context_tree, "UNIT", 1 << 16, raising=False)
    rare = ["zebra quagga", "Ñandú the quick", "zebra quagga okapi", ""]
    rows = list(enumerate(["the cat sat on the mat " * 2000] * 8 + rare * 3))
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    train = [t for i, t in rows if i not in held]
    assert sum(map(len, train)) > 2 * 131072 and held
    got = {r.doc_id: r for r in context_tree.context_tree_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    plain = plain_ctw(train, rare, context_tree.DEPTH, 1 << 40)
    for i, t in rows:
        if t in rare:
            assert got[i].held_out == (i in held)
            assert math.isclose(got[i].score / math.log10(2), plain[rare.index(t)], abs_tol=1e-3)


def test_texts_that_share_an_id_stay_apart(spark):
    """One doc_id on two unlikely texts is two classes; near copies without ids are one."""
    text = lambda w, n=60: " ".join(f"{w}{i}" for i in range(n))
    rows = [(1, text("a")), (1, text("b")), (2, text("b") + " more"), (None, text("c")), (None, text("c") + " more"), (3, text("d"))]
    kept = bayes_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((r.doc_id or 0, r.text[0]) for r in kept)
    assert found == [(0, "c"), (1, "a"), (1, "b"), (3, "d")]


def test_lines_shared_on_a_large_host_go(spark):
    """A line in thousands of a large host's texts is over the limit though it is under a tenth of them; texts made of such lines are depleted."""
    own = lambda i: " ".join(f"{chr(97 + j % 26)}{i}x{j}q" for j in range(60)).translate(str.maketrans("0123456789", "zyxwvutsrq"))
    shared = [" ".join(f"{c}{chr(97 + j)}" for j in range(20)) for c in "abcd"]
    many = [(i, own(i) + ("\n" + shared[i % 4] if i < 1200 else ""), "hot") for i in range(13000)]
    made = [(20000, "\n".join(shared), "hot"), (20001, "\n".join(shared), "other")]
    docs = spark.createDataFrame(many + made, "doc_id long, text string, source string").repartition(4)
    got = {r.doc_id: r for r in line_frequency.judge(docs).collect()}
    assert all(got[i].kept and got[i].n_gone_words == 20 for i in range(1200)) and got[1200].n_gone_words == 0
    assert not got[20000].kept and not got[20000].base_failed and got[20000].n_gone_words == 80
    assert got[20001].kept
    small = spark.createDataFrame([(i, own(i) + ("\n" + shared[0] if i < 7 else ""), "small") for i in range(60)], "doc_id long, text string, source string")
    assert {r.doc_id for r in line_frequency.judge(small).collect() if r.n_gone_words} == set(range(7))


def test_small_archives_take_few_files_and_tasks(spark):
    """However many tasks write archives, Spark writes one file that names them, and small archives are read by few tasks: each file that Spark writes starts processes on the executors."""
    pages = spark.createDataFrame([(i, f"http://e/{i}", f"page {i} " * 200) for i in range(40)], "page_id long, url string, html string").repartition(8)
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    asked = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        manifest = zip_warc.write_archives(pages, f"{shared_dir(spark)}/w")
        assert len(manifest.inputFiles()) == 1 < manifest.count()
        read = zip_warc.read_archives(manifest)
        assert read.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
        assert sorted(int(r.page_id) for r in read.collect()) == list(range(40))
        assert zip_warc.read_archives(manifest.select("path")).count() == 40
    finally:
        for k, v in asked.items():
            spark.conf.set(k, v)


def test_a_part_holds_its_distinct_strings(spark, monkeypatch):
    """What a part holds follows its distinct strings and not what all units ask of it, and every unit gets its scores."""
    monkeypatch.setattr(context_tree, "FLUSH", 1 << 14)
    text = " ".join(f"w{i * i}" for i in range(2000))
    one = context_tree._asked(pa.table({"text": [text], "held_out": [False], "unit": pa.array([0], pa.int32())}), 1)
    units = 300
    table = pa.concat_tables([one.set_column(0, "unit", pa.array([i], pa.int32())) for i in range(units)])
    n = len(context_tree._keys(one.column("keys")[0].as_py()))
    assert n > 4000
    tracemalloc.start()
    key, _, _, total = context_tree._part(table)[1].lowest
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total[key & 255 == 1].sum() == units * (len(text) + 1)  # each context's first node counts all its bytes
    assert peak < 8 * units * n  # less than the strings unpacked at once
    asked = spark.createDataFrame(table.to_pandas(), context_tree.ASKED)
    got = context_tree.answers(asked, context_tree.train(asked)).collect()
    assert sorted(r.unit for r in got) == list(range(units)) and len({(bytes(r.keys), bytes(r.scores)) for r in got}) == 1
    assert len(got[0].scores) == 4 * n and np.all(np.frombuffer(got[0].scores, np.float32) < 0)
