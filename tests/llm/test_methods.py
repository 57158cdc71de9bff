"""The methods themselves against plain versions."""

from __future__ import annotations

import io
import math
import random
import re
import zipfile
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gridwright.llm import bayes_join, context_tree, pii_votes, string_tiling, textbytes, toxicity, zip_warc

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def plain_tokens(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# Bytes


def test_words_of_bytes():
    texts = ["Hello  World\nfoo", "", None, "x", "ünï Foo. HELLO world foo", " a\x0bb "] * 3
    got = []
    for part in textbytes.chunks(pa.array(texts), 16):
        w = textbytes.words(part)
        raw = textbytes.LOWER[part.data].tobytes()
        spans = [raw[a:b].decode() for a, b in zip(w.starts, w.stops, strict=True)]
        got += [list(x) for x in np.split(np.array(spans, object), np.cumsum(w.counts)[:-1])]
        by_word = defaultdict(set)
        for s, h in zip(spans, w.hashes, strict=True):
            by_word[s].add(int(h))
        assert all(len(x) == 1 for x in by_word.values())
    assert got == [plain_words(t) for t in texts]


def test_shingles():
    h = np.arange(1, 12, dtype=np.uint64)
    s, n = textbytes.shingles(h, np.array([7, 0, 3, 1]), 5)
    assert list(n) == [3, 0, 1, 1] and len(set(s.tolist())) == 5
    again, _ = textbytes.shingles(h[:3], np.array([3]), 5)
    assert again[0] != s[3]


# Personal data


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_base_spans_against_plain(spark, documents):
    rng = random.Random(3)
    odd = ["".join(rng.choice("a@.-_ 0123456789+()é") for _ in range(60)) for _ in range(300)]
    odd += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1 001.2.3.4", "4111 1111-1111 1111 x 4111  1111", "9" * 5000, "x" * 20000 + "@" + "y" * 10, "+1 (988) 555-2485.", "4" + " 1" * 3000, "é😀 a@b.co"]
    texts = odd + [r.text for r in documents.collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii_votes.find_personal_data(docs).collect():
        assert [(s.start, s.kind, s.stop) for s in r.spans if s.kind < pii_votes.BASE] == plain_spans(texts[r.doc_id]), texts[r.doc_id]


def test_votes_find_secrets_and_leave_other_tokens(spark):
    h = "0123456789abcdef"
    rng = random.Random(1)
    token = lambda n: "".join(rng.choice(h) for _ in range(n))
    good = [f'some words token = "{token(32)}" and more' for _ in range(30)]
    bad = [f"see example.org/{'long' * 6}{i} and averyveryverylongwordwithoutdigits here" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    n = {r.doc_id: sum(s.kind == 4 for s in r.spans) for r in pii_votes.find_personal_data(docs).collect()}
    assert all(n[i] == 1 for i in range(30)) and not any(n[i] for i in range(30, 90))


def test_values_assigned_to_named_secrets_are_candidates(spark):
    """A short password after a word of the gazetteer is put to the vote; the same word in prose is not found."""
    rng = random.Random(5)
    short = lambda: "".join(rng.choice("abcdefghkmnp") for _ in range(4)) + rng.choice("!$%.") + str(rng.randrange(10, 99))
    good = [f"text here\n{w} {sign} {q}{{}}{q} more text" for w in ("password", "Kennwort", "API_KEY", "contraseña") for sign in "=:" for q in ("'", '"')] * 3
    secrets = [short() for _ in good]
    bad = [f"the key was found by {short()} and the password of nobody" for _ in range(40)] + [f"see https://example.org/{'long' * 6}{i}/part" for i in range(40)]
    docs = spark.createDataFrame([(i, g.format(s)) for i, (g, s) in enumerate(zip(good, secrets, strict=True))] + [(1000 + i, b) for i, b in enumerate(bad)], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.stop) for s in r.spans if s.kind == 4] for r in pii_votes.find_personal_data(docs).collect()}
    for i, (g, s) in enumerate(zip(good, secrets, strict=True)):
        at = g.format(s).index(s)
        assert got[i] == [(at, at + len(s))], g
    assert not any(got[1000 + i] for i in range(len(bad)))


def test_ibans(spark):
    good = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR14 2004 1010 0505 0001 3M02 606"]
    wrong = ["DE88 3704 0044 0532 0130 00", "GB82WEST12345698765433"]
    rows = [f"Bank account {x} thanks" for x in good * 4] + [f"Part {x} of it" for x in wrong * 4]
    got = {r.doc_id: [s.kind for s in r.spans if s.kind == 6] for r in pii_votes.find_personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert all(got[i] == [6] for i in range(12)) and not any(got[i] for i in range(12, 20))


def plain_em(votes, rounds=50):
    """Dawid-Skene over single items."""
    prior, rate = 0.5, [{1: {1: 0.56, 0: 0.14, 2: 0.3}, 0: {1: 0.14, 0: 0.56, 2: 0.3}} for _ in range(3)]
    for _ in range(rounds):
        post = []
        for v in votes:
            yes, no = prior, 1 - prior
            for k in range(3):
                yes, no = yes * rate[k][1][v[k]], no * rate[k][0][v[k]]
            post.append(yes / (yes + no))
        prior = min(0.99, max(0.01, (1 + sum(post)) / (2 + len(votes))))
        for k in range(3):
            for y in (1, 0):
                got = {x: 1 + sum((p if y else 1 - p) for p, v in zip(post, votes, strict=True) if v[k] == x) for x in (0, 1, 2)}
                rate[k][y] = {x: g / sum(got.values()) for x, g in got.items()}
    return prior, rate, post


def test_reliabilities_against_plain_and_truth():
    """Votes drawn by known rates: the estimates are those of the plain version and near the truth, and the classifier tells the classes apart."""
    rng = random.Random(6)
    true = [(0.9, 0.05), (0.75, 0.2), (0.7, 0.1)]  # P(yes | true), P(yes | false), of votes given
    abstains = (0.0, 0.4, 0.2)
    items = []
    for _ in range(3000):
        y = rng.random() < 0.3
        items.append((y, tuple(2 if rng.random() < a else int(rng.random() < p[not y]) for p, a in zip(true, abstains, strict=True))))
    n = Counter(v for _, v in items)
    counts = [{"kind": 4, "v1": a, "v2": b, "v3": c, "f1": 0, "f2": 0, "n": k} for (a, b, c), k in n.items()]
    prior, rate = pii_votes.reliabilities(counts)
    want, rates, _ = plain_em([v for _, v in items])
    assert math.isclose(prior, want, rel_tol=1e-6)
    for k, v in enumerate(pii_votes.NAMES):
        for y in (0, 1):
            assert all(math.isclose(rate[v][y][x], rates[k][y][x], rel_tol=1e-6) for x in (0, 1, 2))
        for y, p in ((1, true[k][0]), (0, true[k][1])):
            assert abs(rate[v][y][1] - p * (1 - abstains[k])) < 0.08
    assert abs(prior - 0.3) < 0.06
    scores = pii_votes.fit(counts)
    right = sum((scores[4, *v, 0, 0] >= 0.5) == y for y, v in items)
    best = sum(max(c) for c in [[sum(1 for y, w in items if w == v and y == z) for z in (0, 1)] for v in n])
    assert right >= 0.97 * best


def test_spans_of_many_matches(spark):
    t = "x a1@b.cc " * 3000 + "é" + " 1.2.3.4" * 2000
    (r,) = pii_votes.find_personal_data(spark.createDataFrame([(1, t)], "doc_id long, text string")).collect()
    assert [(s.start, s.kind, s.stop) for s in r.spans] == plain_spans(t) and len(r.spans) == 5000


# Tiling


def plain_tiles(p, t, least):
    mp, mt, covered = [0] * len(p), [0] * len(t), 0
    while True:
        best, found = least - 1, []
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not mp[i + k] and not mt[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k >= least:
                    found.append((i, j))
        if best < least:
            return covered
        for i, j in found:
            if not any(mp[i : i + best]) and not any(mt[j : j + best]):
                mp[i : i + best] = mt[j : j + best] = [1] * best
                covered += best


def test_tiles_against_plain():
    rng = random.Random(2)
    for _ in range(200):
        v = rng.choice([2, 3, 5, 20])
        p, t = ([rng.randrange(v) for _ in range(rng.randrange(n))] for n in (40, 60))
        if len(p) > 8:
            t = t[:10] + p[len(p) // 3 :] + t[10:20] + p[: len(p) // 3]
        tiles = string_tiling.greedy_tiles(*(np.array(x, np.uint64) + np.uint64(9) for x in (p, t)), 3)
        assert all(p[i : i + n] == t[j : j + n] for i, j, n in tiles)
        for k in (0, 1):
            marks = Counter(x for tile in tiles for x in range(tile[k], tile[k] + tile[2]))
            assert not marks or max(marks.values()) == 1
        assert sum(n for *_, n in tiles) == plain_tiles(p, t, 3)


def test_reordered_passages_are_caught(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    other = lambda n: [f"o{rng.randrange(10**6)}" for _ in range(n)]
    parts = [words[i : i + 8] for i in range(0, 40, 8)]
    rng.shuffle(parts)
    texts = [" ".join([*other(50), *sum(parts, []), *other(50)]), " ".join([*other(80), *words[:10]]), " ".join(rng.sample(words, 40)), " ".join([*other(9), *words]).upper().replace(" ", ", ")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert sorted(r.doc_id for r in string_tiling.tile_benchmark(docs, bench).collect()) == [0, 3]


@pytest.mark.parametrize("kind", ["int", "string", "long"])
def test_leaks_against_plain(spark, monkeypatch, kind):
    """The whole query, in several blocks of items, against tiling every pair: passages cut, reordered and mixed, short items, items and texts that share words."""
    monkeypatch.setattr(string_tiling, "BLOCK_TOKENS", 60)
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(60)}"
    items = [" ".join(word() for _ in range(rng.choice([2, 3, 5, 12, 30]))) for _ in range(14)] + ["", None]
    texts = ["", None]
    for _ in range(40):
        own = [word() for _ in range(rng.randrange(30))]
        w = (rng.choice(items) or "").split()
        cut = rng.randrange(len(w) + 1)
        w = w[cut:] + w[:cut]
        if w and rng.random() < 0.4:
            w[rng.randrange(len(w))] = "other"
        at = rng.randrange(len(own) + 1)
        texts.append(" ".join(own[:at] + w + own[at:]))
    want = set()
    for d, t in enumerate(texts):
        for k, item in enumerate(items):
            p, q = plain_tokens(item), plain_tokens(t)
            if len(p) >= string_tiling.SEED:
                n = plain_tiles(p, q, string_tiling.SEED)
            else:
                n = len(p) if p and any(q[i : i + len(p)] == p for i in range(len(q))) else 0
            if p and n >= 0.6 * len(p) - 1e-9:
                want.add((d, k, n))
    name = str if kind == "string" else int
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    bench = spark.createDataFrame([(name(k), x) for k, x in enumerate(items)], f"item_id {kind}, text string")
    got = string_tiling.tile_benchmark(docs, bench)
    assert dict(got.dtypes)["item_id"] == {"long": "bigint"}.get(kind, kind)
    assert {(r.doc_id, int(r.item_id), r.n_covered) for r in got.collect()} == want and len(want) > 10
    bad = {d for d, _, _ in want}
    assert {r.doc_id for r in string_tiling.without_leaks(docs, bench).collect()} == set(range(len(texts))) - bad


# Near duplicates


def plain_classes(rows):
    first, shingles = {}, {}
    for d, t in rows:
        first[t] = min(first.get(t, d), d)
    for t, d in first.items():
        w = plain_tokens(t)
        shingles[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    holders, links, parent = defaultdict(list), Counter(), {d: d for d in shingles}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in sorted(shingles):
        shared = Counter(q for s in shingles[d] for q in holders[s])
        for s in shingles[d]:
            holders[s].append(d)
        for q, n in shared.items():
            if 5 * n >= 4 * (len(shingles[d]) + len(shingles[q]) - n):
                links[d] += 1
                links[q] += 1
                a, b = sorted((find(d), find(q)))
                parent[b] = a
    return {d: (find(first[t]), links[first[t]]) for d, t in rows}


def near_texts(groups, each, length, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"v{rng.randrange(5000)}" for _ in range(length)]
        for _ in range(each):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(length)] = f"n{rng.randrange(10**6)}"
            out.append(" ".join(w))
    rng.shuffle(out)
    return list(enumerate(out))


def test_classes_against_plain(spark, monkeypatch):
    monkeypatch.setattr(bayes_join, "BLOCK", 16)  # so groups are cut into blocks
    monkeypatch.setattr(bayes_join, "BUCKET_BLOCK", 16)
    rows = near_texts(6, 30, 150, 5) + [(1000 + i, t) for i, t in near_texts(10, 2, 60, 6)] + [(2000, ""), (2001, "a b"), (2002, "a b"), (2003, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_classes([(d, t or "") for d, t in rows])
    got = bayes_join.jaccard_join(docs).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == want
    keys = defaultdict(set)
    for r in got:
        keys[r.class_key].add(r.class_id)
    assert all(len(x) == 1 for x in keys.values()) and len(keys) == len({c for c, _ in want.values()})
    assert sorted(r.doc_id for r in bayes_join.keep_one(docs).collect()) == sorted({c for c, _ in want.values()})


def test_large_group_of_near_copies_whose_pivot_knows_few(spark, monkeypatch):
    """Texts in a chain: each is linked with its neighbours only, so the pivot settles few and the rest needs each other."""
    monkeypatch.setattr(bayes_join, "BLOCK", 8)
    monkeypatch.setattr(bayes_join, "BUCKET_BLOCK", 8)
    words = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(60):  # a word is replaced at a time
        rows.append((i, " ".join(words)))
        words[(i * 7) % 60] = f"d{i}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_classes(rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in bayes_join.jaccard_join(docs).collect()} == want
    assert sorted(r.doc_id for r in bayes_join.keep_one(docs).collect()) == sorted({c for c, _ in want.values()})


def test_joined_texts_may_share_ids(spark):
    """The join against brute force on rows whose ids repeat on other texts: classes by key, links by text."""
    rng = random.Random(8)
    rows = [(rng.randrange(25), t) for _, t in near_texts(8, 6, 150, 9)]
    rows += rows[:5] + [(None, rows[0][1]), (3, None), (3, "")]
    got = bayes_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = sorted({t or "" for _, t in rows})
    plain = plain_classes(list(enumerate(texts)))
    assert len(got) == len(rows)
    want = Counter()
    least = {}
    for d, t in rows:
        c = plain[texts.index(t or "")][0]
        least[c] = min(least.get(c, 999), 999 if d is None else d)
    copies = Counter(t or "" for _, t in rows)
    for d, t in rows:
        c, n = plain[texts.index(t or "")]
        want[d, least[c], n, copies[t or ""]] += 1
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got) == want
    assert len({r.class_key for r in got}) == len(least)
    kept = bayes_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(least.values())


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    lost = 0
    for _ in range(300):
        agree = rng.random(bayes_join.HASHES) < 0.8
        a = rng.integers(0, 2**32, (1, bayes_join.HASHES), dtype=np.uint32)
        b = np.where(agree, a, a + np.uint32(1))
        lost += not len(bayes_join.surviving(a, b, False)[0])
    assert lost == 0


# Toxicity


def test_held_out_accuracy(spark):
    rng = random.Random(7)
    bad = ["idiot", "scum", "moron", "loser"]
    rows, labels = [], []
    for i in range(1500):
        toxic = rng.random() < 0.15
        w = [f"w{int(rng.paretovariate(1)) % 3000}" for _ in range(80)]
        if toxic:
            for k in rng.sample(range(80), 3):
                w[k] = rng.choice(bad).upper() + "."
        rows.append((i, " ".join(w)))
        if rng.random() < 0.6:
            labels.append((i, 1, int(toxic)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, lab).where("held_out").join(lab, "doc_id").collect()
    recall = np.mean([r.predicted for r in got if r.toxic])
    wrong = np.mean([r.predicted for r in got if not r.toxic])
    assert recall > 0.9 and wrong < 0.05


def plain_fit(texts, positive, prior, epochs=300):
    """The risk estimator word by word, following the docstring: full features, Adam, steps turned round where the estimate of the clean risk is negative."""
    words = [set(plain_tokens(t)) for t in texts]
    n_p, n_u = sum(positive), len(texts) - sum(positive)
    seen = sorted({w for s in words for w in s})
    chosen = []
    for w in seen:
        a = sum(w in s for s, y in zip(words, positive, strict=True) if y)
        b = sum(w in s for s, y in zip(words, positive, strict=True) if not y)
        p, u = (a + 0.5) / (n_p + 1), (b + 0.5) / (n_u + 1)
        if a + b >= 5 and abs(p - u) / math.sqrt(u * (1 - u) / n_p + u * (1 - u) / n_u) > 4:
            chosen.append(w)
    w, bias = dict.fromkeys(chosen, 0.0), math.log(prior / (1 - prior))
    m, v = Counter(), Counter()
    soft = lambda x: math.log1p(math.exp(-x)) if x > -30 else -x
    for t in range(1, epochs + 1):
        x = [bias + sum(w[q] for q in s if q in w) for s in words]
        clean = sum(soft(-z) for z, y in zip(x, positive, strict=True) if not y) / n_u - prior * sum(soft(-z) for z, y in zip(x, positive, strict=True) if y) / n_p
        g = []
        for z, y in zip(x, positive, strict=True):
            s = 1 / (1 + math.exp(-z))
            of_clean = -prior * s / n_p if y else s / n_u
            g.append(of_clean + (-prior * (1 - s) / n_p if y else 0) if clean >= 0 else -of_clean)
        grad = {q: sum(gi for gi, s in zip(g, words, strict=True) if q in s) + 1e-4 * w[q] for q in chosen} | {None: sum(g)}
        for q, value in grad.items():
            m[q], v[q] = 0.9 * m[q] + 0.1 * value, 0.999 * v[q] + 0.001 * value**2
            step = 0.1 * (m[q] / (1 - 0.9**t)) / (math.sqrt(v[q] / (1 - 0.999**t)) + 1e-8)
            if q is None:
                bias -= step
            else:
                w[q] -= step
    return w, bias


def test_fit_against_plain():
    rng = random.Random(11)
    texts, positive = [], []
    for i in range(220):
        y = i < 60
        w = [f"w{int(rng.paretovariate(1)) % 60}" for _ in range(25)] + ["vile"] * (y or rng.random() < 0.1) + ["awful"] * (y and rng.random() < 0.7)
        rng.shuffle(w)
        texts.append(" ".join(w))
        positive.append(y)
    parts = [textbytes.words(x, textbytes.ALNUM) for x in textbytes.chunks(pa.array(texts))]
    lists = [np.unique(h) for w in parts for h in np.split(w.hashes, np.cumsum(w.counts)[:-1])]
    words, weights, bias = toxicity.fit(np.array(positive), np.array([len(x) for x in lists]), np.concatenate(lists), 0.15)
    want, b = plain_fit(texts, positive, 0.15)
    (texts_of,) = textbytes.chunks(pa.array(sorted(want)))
    by_hash = dict(zip(textbytes.words(texts_of, textbytes.ALNUM).hashes.tolist(), sorted(want), strict=True))
    assert {by_hash[h] for h in words.tolist()} == set(want) and "vile" in want
    assert math.isclose(bias, b, abs_tol=1e-6) and all(math.isclose(x, want[by_hash[h]], abs_tol=1e-6) for h, x in zip(words.tolist(), weights, strict=True))


def test_sample_takes_one_text_of_an_id(spark):
    rows = [(i % 40, f"text {i} {'x' * (i % 7)}") for i in range(200)]
    labels = spark.createDataFrame([(i, 1, 1) for i in range(0, 40, 3)], "doc_id long, quality int, toxic int")
    runs = []
    for n in (2, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        runs.append(sorted((r.positive, tuple(r.words)) for r in toxicity.sample(docs, labels).collect()))
    assert runs[0] == runs[1] and len(runs[0]) > 30


# Language model


def plain_ctw(train, test, depth, split):
    """Context-tree weighting by dictionaries, following the docstring's definition."""
    counts = defaultdict(lambda: defaultdict(int))
    total = 0
    pad = b"\0" * depth
    for t in train:
        data = pad + t.translate(LOWER).encode() + b"\0"
        for i in range(depth, len(data)):
            total += 1
            for d in range(depth + 1):
                counts[data[i - d : i]][data[i]] += 1
    least = max(1, -(-total // split))
    kept = {c for c, n in counts.items() if not c or sum(n.values()) >= least}

    def bits(context):
        a = defaultdict(lambda: [0, 0])
        for byte, n in counts[context].items():
            for j in range(8):
                a[(1 << j) | (byte >> (8 - j))][(byte >> (7 - j)) & 1] += n
        return a

    nodes = {c: bits(c) for c in kept}
    longer = defaultdict(list)
    for c in kept:
        if c:
            longer[c[1:]].append(c)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def rest_of(c, q):
        zero, one = nodes[c][q]
        for x in longer[c]:
            if q in nodes[x]:
                zero, one = zero - nodes[x][q][0], one - nodes[x][q][1]
        return zero, one

    memo = {}

    def log_pw(c, q):
        if (c, q) not in memo:
            here = kt(*nodes[c][q])
            memo[c, q] = here if len(c) == depth else np.logaddexp(here, sum(log_pw(x, q) for x in longer[c] if q in nodes[x]) + kt(*rest_of(c, q))) - math.log(2)
        return memo[c, q]

    def one(c, q, full):
        if q not in nodes[c]:
            return 0.5
        a, b = nodes[c][q]
        p = (b + 0.5) / (a + b + 1)
        if len(c) == depth:
            return p
        stop = math.exp(kt(a, b) - math.log(2) - log_pw(c, q))
        x = full[len(full) - len(c) - 1 :]
        if x in kept:
            deeper = one(x, q, full)
        else:
            z, o = rest_of(c, q)
            deeper = (o + 0.5) / (z + o + 1)
        return stop * p + (1 - stop) * deeper

    out = []
    for t in test:
        data, s = pad + t.translate(LOWER).encode() + b"\0", 0.0
        for i in range(depth, len(data)):
            for j in range(8):
                p = one(b"", (1 << j) | (data[i] >> (8 - j)), data[i - depth : i])
                s += math.log2(p if (data[i] >> (7 - j)) & 1 else 1 - p)
        out.append(s)
    return out


def test_context_tree_against_plain():
    train = ["the cat sat on the mat", "The dog sat.", "", "ñandú the cat"]
    test = ["the cat", "zebra ñ", "", "The mat sat"]
    for depth, split in ((2, 1000), (3, 30)):
        parts = [context_tree._counted(context_tree.strings(x, depth)[0]) for x in textbytes.chunks(pa.array(train))]
        keys, n = context_tree._merge(parts)
        least, levels = max(1, -(-int(n.sum()) // split)), []
        for d in range(depth + 1):
            k, c = context_tree._merge([(keys & np.uint64((1 << (8 * (d + 1))) - 1), n)])
            ctx, of = context_tree._merge([(k >> np.uint64(8), c)])
            keep = np.isin(k >> np.uint64(8), ctx[of >= least] if d else ctx)
            levels.append((k[keep], c[keep]))
        tree = context_tree.Tree(levels)
        (texts,) = textbytes.chunks(pa.array(test))
        code, size = context_tree.strings(texts, depth)
        cache = context_tree.Cache(tree, 4)  # small, so strings collide
        got = np.add.reduceat(cache.log2(code), np.cumsum(size) - size)
        assert np.allclose(got, plain_ctw(train, test, depth, split), atol=1e-3)
        every = np.arange(256, dtype=np.uint64) | (code[0] >> np.uint64(8) << np.uint64(8))
        assert abs(np.exp2(tree.log2(every)).sum() - 1) < 1e-5


def test_base_scores_against_plain(spark, documents, monkeypatch):
    import zlib

    monkeypatch.setattr(context_tree, "FREQUENT", 50)  # so most words go through the join
    rows = documents.select("doc_id", "text").collect()
    counts = Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            counts.update([*plain_words(r.text), None])
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in context_tree.context_tree_scores(documents).collect()}
    for r in rows:
        w = [*plain_words(r.text), None]
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(g.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)


# Archives


class _File(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


def test_zip_directories_round_trip():
    out = io.BytesIO()
    w = zip_warc.Writer(out)
    payloads = [b"x" * i for i in range(0, 3000, 37)]
    for i, p in enumerate(payloads):
        import hashlib

        w.add(zip_warc.record(i, f"http://e/{i}", p, hashlib.sha1(p).hexdigest()))
    w.close()
    f = _File(out.getvalue())
    assert [m.name for m in zip_warc.members(f, len(out.getvalue()))] == zipfile.ZipFile(out).namelist()
    got = [r.payload for start, lengths in zip_warc.runs_of(f, len(out.getvalue()), 2000) for r in zip_warc.read_records(f, start, lengths)]
    assert got == payloads


def test_zip64_directory():
    """A directory whose fields overflow into ZIP64 records, made by hand: sizes and offsets are what those say."""
    import struct

    name, data = b"archive/data.warc.gz", b"abc"
    local = b"PK\x03\x04" + struct.pack("<5H3I2H", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<2H2Q", 1, 16, 3, 3) + data
    extra = struct.pack("<2H3Q", 1, 24, 3, 3, 0)
    central = b"PK\x01\x02" + struct.pack("<6H3I5H2I", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = b"PK\x06\x06" + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    raw = local + central + end64 + b"PK\x06\x07" + struct.pack("<IQI", 0, len(local) + len(central), 1) + b"PK\x05\x06" + struct.pack("<4H2IH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    (m,) = zip_warc.members(_File(raw), len(raw))
    assert (m.size, m.header) == (3, 0)
    at = zip_warc.data_offset(_File(raw), m)
    assert raw[at : at + 3] == data


def other_record(i, payload, kind="response", base32=True):
    import base64
    import hashlib

    block = (f"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n".encode() if kind == "response" else b"") + payload
    sha = hashlib.sha1(payload).digest()
    digest = base64.b32encode(sha).decode() if base32 else sha.hex()
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nWARC-Target-URI: http://e/{i}\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Type: {'application/http; msgtype=response' if kind == 'response' else 'application/warc-fields'}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_archives_of_other_writers():
    """Several members, plain and gzipped, named by CDX or CDXJ lines in a gzipped index, or by none."""
    import gzip
    import json

    def member(ids, pack):
        raw, places, at = b"", [], 0
        for i in ids:
            x = pack(other_record(i, f"payload {i} ".encode() * i, "warcinfo" if i % 10 == 0 else "response", i % 2 == 0))
            places.append((at, len(x)))
            raw += x
            at += len(x)
        return raw, places

    a, at_a = member(range(0, 5), gzip.compress)
    b, at_b = member(range(10, 14), lambda x: x)
    c, _ = member(range(20, 26), gzip.compress)
    d, _ = member(range(30, 33), lambda x: x)
    cdxj = "".join(f"com,e)/{k} 2024 " + json.dumps({"filename": "rec-0.warc.gz", "offset": o, "length": str(n)}) + "\n" for k, (o, n) in enumerate(at_a))
    cdx = " CDX N b a m s k r M S V g\n" + "".join(f"com,e)/{k} 2024 http://e/{k} text/html 200 X - - {n} {o} archive/plain.warc\n" for k, (o, n) in enumerate(at_b))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}")
        z.writestr("archive/rec-0.warc.gz", a)
        z.writestr("archive/plain.warc", b)
        z.writestr("indexes/index.cdx.gz", gzip.compress(cdxj.encode()))
        z.writestr("indexes/more.cdx", cdx)
        z.writestr("archive/rec-1.warc.gz", c)
        z.writestr("archive/last.warc", d)
        z.writestr("archive/notes.txt", "no archive")
    f, size = _File(out.getvalue()), len(out.getvalue())
    for limit in (1, 500, 1 << 20):
        got = [r for start, lengths in zip_warc.runs_of(f, size, limit) for r in zip_warc.read_records(f, start, lengths)]
        ids = [int(zip_warc.page_of(r.headers["warc-record-id"])[len("<urn:uuid:") : -1]) for r in got]
        assert ids == [*range(0, 5), *range(10, 14), *range(20, 26), *range(30, 33)]
        assert [r.payload for r in got] == [f"payload {i} ".encode() * i for i in ids]
        assert {r.type for r in got} == {"response", "warcinfo"}
    with zipfile.ZipFile(out, "a", zipfile.ZIP_STORED) as z:
        z.writestr("indexes/wrong.cdxj", 'x 1 {"filename": "none.warc.gz", "offset": "0", "length": "1"}')
    with pytest.raises(ValueError, match="doesn't hold"):
        list(zip_warc.runs_of(_File(out.getvalue()), len(out.getvalue())))


def test_long_payloads_and_lost_bytes():
    import gzip
    import hashlib

    big = "é word ".encode() * 700_000
    out = io.BytesIO()
    w = zip_warc.Writer(out)
    w.add(zip_warc.record(1, "http://e/", big, hashlib.sha1(big).hexdigest()))
    w.close()
    f, size = _File(out.getvalue()), len(out.getvalue())
    (run,) = zip_warc.runs_of(f, size)
    (r,) = zip_warc.read_records(f, *run)
    assert r.payload == big and r.payload_bytes == len(big)
    with pytest.raises(ValueError, match="digest"):
        zip_warc.parse(zip_warc.record(1, "u", b"abc", "0" * 40))
    with pytest.raises(ValueError, match="length"):
        zip_warc.parse(zip_warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest()) + b"more")
    packed = gzip.compress(zip_warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest()))
    with pytest.raises(ValueError, match="cut off"):
        list(zip_warc.walked(_File(packed[:-5]), 0, len(packed) - 5))


def test_compressed_members_are_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zip_warc.DATA, b"x" * 100)
        z.writestr(zip_warc.INDEX, b"")
    with pytest.raises(ValueError, match="compressed"):
        list(zip_warc.runs_of(_File(out.getvalue()), len(out.getvalue())))
