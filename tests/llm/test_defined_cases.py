"""Nulls, empty and long texts, repeated rows, clashing columns, empty tables: each operator's defined results."""

from __future__ import annotations

import pytest

from gridwright.llm import bayes_join, context_tree, fair_mix, line_frequency, line_windows, pii_votes, string_tiling, toxicity, url_terms, zip_warc
from gridwright.llm.common import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, k1 string, size string, copies int, spans string, h string"
LONG = "word " * 30000 + "end"
TEXT = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(8))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, TEXT, "en", "a"), (1, TEXT, "en", "a"), (2, TEXT + " x", "en", None), (3, None, None, None), (4, "", "en", "a"), (5, " \t\n ", "en", "b"), (None, "one two", "en", "b"), (None, None, None, None),
        (6, LONG, "en", "b"), (7, "mail a.b@c.example.com now", "en", "é"), (8, "émile œuvre 日本語 \U0001f600 x", "fr", "𐐷"),
    ]
    return spark.createDataFrame([(*r, None, 9, "k", "s", 3, "sp", "h") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "one two"), (None, "never seen words here at all")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")


def test_mix(odd, spark):
    got = fair_mix.fair_mix(odd).collect()
    assert len(got) == 11
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert [r.taken for r in got if r.doc_id in (3, 4, 5)] == [0, 0, 0]
    assert sum(r.taken for r in got) <= sum(r["size"] for r in got)
    assert fair_mix.fair_mix(odd.limit(0)).count() == 0


def test_mix_targets_stop_at_three_times(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a") for i in range(3)] + [(i, "w " * 10, "b") for i in range(10, 100)], "doc_id long, text string, source string")
    got = {r.source_size: r.target for r in fair_mix.fair_mix(docs).collect()}
    assert got == {30: 90.0, 900: 840.0}
    taken = {}
    for r in fair_mix.fair_mix(docs).collect():
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    assert taken[30] == 90 and 830 <= taken[900] <= 840


def plain_mix(rows):
    """Targets by water filling, then copies taken one by one by finish time. rows: (doc_id, source, size)."""
    import hashlib

    names = sorted({s for _, s, _ in rows if s is not None}) + [None] * any(s is None for _, s, _ in rows)
    own = {s: sum(n for _, x, n in rows if x == s) for s in names}
    weight = {s: fair_mix.WEIGHTS[i % 3] for i, s in enumerate(names)}
    budget = sum(own.values())
    target, free, rest = {}, list(names), budget
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] >= 3 * own[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = float(3 * own[s])
            rest -= 3 * own[s]
            free.remove(s)
        if not free:
            break
    h = lambda d: int(hashlib.md5(f"{fair_mix.SEED}:{'null' if d is None else d}".encode()).hexdigest()[:15], 16)
    queue = []
    for i, s in enumerate(names):
        upto = 0
        mine = sorted((h(d), d is not None, d or 0, n) for d, x, n in rows if x == s)
        for k, (hh, x, d, n) in enumerate(mine):
            upto += n
            queue += [((upto + c * own[s]) / target[s], i, c, hh, x, d, n, k, s) for c in range(3) if n and upto + c * own[s] - n < target[s]]
    taken, total = {}, 0
    for f, i, c, hh, x, d, n, k, s in sorted(queue):
        total += n
        if total > budget:
            break
        taken[i, k] = taken.get((i, k), 0) + n
    out = []
    for i, s in enumerate(names):
        for k, (hh, x, d, n) in enumerate(sorted((h(d), d is not None, d or 0, n) for d, y, n in rows if y == s)):
            out.append((d if x else None, n, own[s], round(target[s], 6), taken.get((i, k), 0)))
    return sorted(out, key=str)


def test_mix_against_plain(spark, monkeypatch):
    """A hot source of null and repeated ids, ties, small sources; ranges far smaller than the source."""
    import random

    monkeypatch.setattr(fair_mix, "ROWS", 50)
    rng = random.Random(2)
    rows = [(None, "hot", 3)] * 400 + [(7, "hot", 2)] * 100 + [(i, rng.choice(["a", "b", "hot", None]), rng.randrange(9)) for i in range(600)] + [(5000, "tiny", 4), (5000, "tiny", 4)]
    docs = spark.createDataFrame([(d, "w " * n, s) for d, s, n in rows], "doc_id long, text string, source string").repartition(5)
    got = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in fair_mix.fair_mix(docs).collect()]
    assert sorted(got, key=str) == plain_mix(rows)


def test_line_frequency(odd, spark):
    got = line_frequency.judge(odd).collect()
    assert len(got) == 11
    assert all(r.base_failed and not r.kept for r in got if r.doc_id in (3, 4, 5, 7, 8))
    assert [r.kept for r in got if r.doc_id == 1] == [True, True]
    assert next(r for r in got if r.doc_id == 6).base_failed  # a word over and over
    clean = line_frequency.clean_documents(odd)
    assert clean.columns == odd.columns and sorted(r.doc_id for r in clean.collect()) == [1, 1, 2]
    assert line_frequency.judge(odd.limit(0)).count() == 0


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    own = lambda i: " ".join(f"{chr(97 + i)}{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(60))
    shared = " ".join(f"s{j}" for j in range(50))
    docs = spark.createDataFrame([(i, own(i) + "\nShared  LINE 12 here", "a") for i in range(20)] + [(100 + i, f"{shared}\nend{i}", "b") for i in range(20)] + [(200, f"{shared}\nend", "c")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_frequency.judge(docs).collect()}
    assert got[0].kept and got[0].n_gone_words == 4
    assert not got[105].kept and got[105].n_gone_words == 51  # digits are alike, so the last lines are one too
    assert got[200].kept  # counted for each host
    assert {r.text for r in line_frequency.clean_documents(docs).where("doc_id < 100").collect()} == {own(i) for i in range(20)}


def test_pii(odd, spark):
    got = pii_votes.find_personal_data(odd).collect()
    assert len(got) == 11
    (mail,) = [r.spans for r in got if r.doc_id == 7]
    assert [(s.start, s.kind, s.stop) for s in mail] == [(5, 0, 22)]
    assert pii_votes.find_personal_data(odd.limit(0)).count() == 0


def test_tiling(odd, bench, spark):
    got = string_tiling.tile_benchmark(odd, bench).collect()
    pairs = sorted((r.doc_id if r.doc_id else 0, r.item_id) for r in got)
    assert pairs == [(0, 4), (1, 1), (1, 1), (2, 1)]
    assert {r.coverage for r in got} == {1.0}
    rest = string_tiling.without_leaks(odd, bench)
    assert rest.columns == odd.columns and rest.count() == 7
    assert string_tiling.tile_benchmark(odd.limit(0), bench).count() == 0
    assert string_tiling.tile_benchmark(odd, bench.limit(0)).count() == 0


def test_join(odd, spark):
    got = bayes_join.jaccard_join(odd).collect()
    assert len(got) == 11
    by = {r.doc_id: r for r in got}
    assert by[1].class_id == by[2].class_id == 1 and by[1].n_links == 1 and by[1].n_copies == 2
    assert by[3].class_id == by[4].class_id == 3 and by[3].n_links == 0  # null and empty are one text without words
    assert by[6].class_id == 6
    one = bayes_join.keep_one(odd)
    assert one.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in one.collect()) == [(False, i) for i in (1, 3, 5, 6, 7, 8)] + [(True, 0)]
    assert bayes_join.jaccard_join(odd.limit(0)).count() == 0


def test_windows(odd, spark):
    got = line_windows.dedup_lines(odd)
    assert got.columns == [*odd.columns, "line_spans"]
    rows = got.collect()
    assert len(rows) == 11
    assert sorted(r.text for r in rows if r.doc_id == 1) == ["", TEXT]  # of equal rows one is the document
    assert next(r.text for r in rows if r.doc_id == 2) == TEXT.split("\n")[-1] + " x"
    assert [r.text for r in rows if r.doc_id == 3] == [None]
    assert line_windows.dedup_lines(odd.limit(0)).count() == 0


def plain_dedup(rows):
    """Windows of three lines in order of place; rows equal in id and text are places one after the other."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = set(), {}
    for i in order:
        split = (rows[i][1] or "").split("\n")
        at = [k for k, x in enumerate(split) if x.strip(" \t")]
        n = min(3, len(at))
        gone = set()
        for j in range(len(at) - n + 1 if at else 0):
            window = tuple(split[k].strip(" \t") for k in at[j : j + n])
            if window in seen:
                gone |= set(range(at[j], at[j + n - 1] + 1))
            seen.add(window)
        out[i] = None if rows[i][1] is None else "\n".join(x for k, x in enumerate(split) if k not in gone)
    return [out[i] for i in range(len(rows))]


def test_windows_against_plain(spark):
    """Null and repeated ids, repeated rows, a hot text: every later occurrence goes, and one copy of each stays."""
    import random
    from collections import Counter

    rng = random.Random(3)
    text = lambda n: "\n".join(rng.choice(["a", "b", "c", " a ", "", "d e"]) for _ in range(n))
    rows = [(i, text(rng.randrange(12))) for i in range(60)]
    rows += [(None, "p\nq\n\nr\ns")] * 3 + [(5000, "p\nq\n\nr\ns")] + [(5001, "hot\nhotter\n\n")] * 30 + [(5002, "x\nhot\nhotter")] + [(5003, None)] * 2 + [(5004, "")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.text) for r in line_windows.dedup_lines(docs).collect())
    assert got == Counter((d, x) for (d, _), x in zip(rows, plain_dedup(rows), strict=True))


def test_long_passages_on_one_or_two_lines(spark):
    """A passage of over 50 words goes where a window of three lines repeats, or where it is the whole text; on one or two lines among others it stays, as the method has it."""
    long = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(1, f"{long('a')}\n{long('b')}\n{long('c')}"), (2, f"own\n{long('a')}\n{long('b')}\n{long('c')}"), (3, long("d")), (4, long("d")), (5, f"mine\n{long('d')}\nother"), (6, f"{long('e')}\n{long('f')}"), (7, f"{long('e')}\n{long('f')}")]
    got = {r.doc_id: r.text for r in line_windows.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[2], got[4], got[7]) == ("own", "", "") and got[5] == rows[4][1]


def test_windows_inside_a_text(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nx\na\n\nb\nc\ny"), (2, "q\nr"), (3, " q \nr"), (4, "z"), (5, "z")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_windows.dedup_lines(docs).collect()}
    assert got == {1: "a\nb\nc\nx\ny", 2: "q\nr", 3: "", 4: "z", 5: ""}


def test_urls(spark):
    urls = ["http://a.example.com/en/7x", "http://WWW.Example.NET/de/81?q", "http://x.org/es/", "https://x.com/en/", "http://net/de/", "http://notnet/de/", None, "", "no scheme xxx", "http://h.io/free/sex", "http://h.io/freesex", "://com/en/y#z", "http://h.io/hot/hot"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_terms.judge_urls(pages).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[1] == ("www.example.net", "/de/81", "example.net/de/8", "block")
    assert got[2][2:] == ("org/es/", "block") and got[3][2:] == ("com/en/", "block") and got[4][2:] == ("net/de/", "allow")
    assert got[5][2:] == (None, "allow") and got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8] == ("", "", None, "block") and got[9][2:] == (None, "block") and got[10][2:] == (None, "allow")
    assert got[11] == ("com", "/en/y", "com/en/", "block") and got[12][2:] == (None, "allow")
    assert url_terms.judge_urls(pages.limit(0)).count() == 0


def test_urls_weigh_soft_terms(spark, tmp_path):
    """Variants count as their stem; two weak terms are not enough; a vocabulary may come from a file; long urls are read whole."""
    vocabulary = url_terms.Vocabulary.of(["casino"], {"sex": 2, "free": 1, "hot": 1, "girl": 1})
    block = {
        "http://a.io/casin0s": True, "http://a.io/free/hot": False, "http://a.io/free/hot/girls": True, "http://a.io/sex/s3x/sexs": False, "http://a.io/sex-fr33": True, "http://a.io/casinox": False,
        "http://a.io/" + "x/" * 50000 + "casino": True, "http://a.io/écasinoé": True, "": False,
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(block)], "page_id long, url string")
    got = {r.url: r.verdict == "block" for r in url_terms.judge_urls(pages, vocabulary=vocabulary).collect()}
    assert got == block
    (tmp_path / "terms.csv").write_text("Bad,strict\nworse, 2\nworst,1\n")
    read = url_terms.Vocabulary.read(spark, f"file://{tmp_path}/terms.csv")
    assert read.terms == (("bad", "bad", 0), ("worse", "worse", 2), ("worst", "worst", 1))
    assert url_terms.count_terms("x/bad-worse.worst/bads", read) == (1, 2, 3)
    assert len(url_terms.VOCABULARY.terms) > 300


def test_toxicity(odd, labels, spark):
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).count() == 11


def test_context_tree(odd, spark):
    got = context_tree.context_tree_scores(odd).collect()
    assert len(got) == 11
    assert [r.n_tokens for r in got if r.doc_id in (3, 4)] == [1, 1]
    assert all(r.score < 0 and r.base_score < 0 for r in got)
    assert context_tree.context_tree_scores(odd.limit(0)).count() == 0


def test_archives(spark):
    big = "é" * 600
    rows = [(1, "u", big), (2, "u\n2", big), (3, None, big), (None, "n", big), (4, "v", None), (5, "w", ""), (6, "x", "small"), (7, "y", "small"), (7, "y", "small"), (3, "again", big)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    manifest = zip_warc.write_archives(pages, f"{shared_dir(spark)}/w")
    got = sorted((r.page_id or "", r.record_type, r.refers_to, r.payload_bytes, bytes(r.payload)) for r in zip_warc.read_archives(manifest, payloads=True).collect())
    assert len(got) == len(rows)
    assert [x[:4] for x in got] == [
        ("", "revisit", "3", 1200), ("1", "revisit", "3", 1200), ("2", "revisit", "3", 1200), ("3", "response", None, 1200), ("3", "response", None, 1200),
        ("4", "response", None, 0), ("5", "response", None, 0), ("6", "response", None, 5), ("7", "response", None, 5), ("7", "response", None, 5),
    ]
    assert {x[4] for x in got if x[0] == "3"} == {big.encode()}
    assert zip_warc.read_archives(zip_warc.write_archives(pages.limit(0), f"{shared_dir(spark)}/e")).count() == 0
