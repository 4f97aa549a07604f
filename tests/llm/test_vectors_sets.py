"""Near vectors, set join and components against brute force, with the awkward rows each must survive."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docwarden.llm import near_vectors, set_join
from docwarden.llm.components import components
from docwarden.llm.shingles import in_repeated_windows, shingle_set


def classes(n: int, links) -> dict:
    parent = {i: i for i in n}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in n}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(2000, 2100)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    nodes = {x for a, b in links for x in (a, b) if a != b}
    assert got == classes(nodes, [(a, b) for a, b in links if a != b])
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(7)
    rows, centre = [], rng.standard_normal((40, 16))
    for i in range(400):
        rows.append((i, (centre[i % 40] + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.3])).tolist(), i % 3))
    rows += [(1000 + i, rows[5][1], 0) for i in range(6)] + [(1006, rows[5][1], 0)] * 2
    rows += [
        (2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, [None] + [1.0] * 15, 1),
        (2004, [float("inf")] * 16, 1), (2005, [], 1), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (None, rows[0][1], 1),
    ]
    return rows


@pytest.mark.parametrize("piece", [1024, 7])
def test_near_vectors(spark, vectors, piece):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, id int").withColumn("n_links", F.lit("x"))
    got = near_vectors.near_vectors(df, piece=piece, window=8).collect()
    assert len(got) == len(vectors)
    good = [(i, np.array(v)) for i, v, _ in vectors if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = [(i, v / np.linalg.norm(v)) for i, v in good]
    links, degree = [], [0] * len(unit)
    for a, (i, x) in enumerate(unit):
        for b, (j, y) in enumerate(unit):
            if a != b and len(x) == len(y) and x @ y >= 0.9:
                degree[a] += 1
                links.append((i, j))
    want = classes({i for i, *_ in vectors if i is not None}, links)
    assert sorted((r.vec_id, r.n_links) for r in got if r.vec_id in dict(unit)) == sorted((i, d) for (i, _), d in zip(unit, degree, strict=True))
    assert all(r.component_id == want[r.vec_id] and r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    alone = {r.vec_id: r for r in got if r.vec_id in (2000, 2001, 2002, 2003, 2004, 2005, None)}
    assert all(r.n_links == 0 and r.kept for r in alone.values()) and alone[None].component_id is None
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_across_ranges(spark, vectors):
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
        few = {r.vec_id: r.component_id for r in near_vectors.near_vectors(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert few == {r.vec_id: r.component_id for r in near_vectors.near_vectors(df).collect()}


def hot_cone(n: int, dims: int = 64) -> tuple[np.ndarray, int]:
    """Random vectors, a third of them in one cone (pairwise cosine about 0.7), then a partner at cosine 0.905 for the
    first 100 of the cone and the first 100 outside it."""
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x, axis = unit(rng.standard_normal((n, dims))), unit(rng.standard_normal(dims))
    x[: n // 3] = unit(np.sqrt(0.7) * axis + np.sqrt(0.3) * x[: n // 3])
    first = np.concatenate((x[:100], x[n // 3 : n // 3 + 100]))
    off = rng.standard_normal(first.shape)
    off = unit(off - (off * first).sum(axis=1, keepdims=True) * first)
    return np.concatenate((x, 0.905 * first + np.sqrt(1 - 0.905**2) * off)), 200


@pytest.mark.parametrize("n", [1200, 6000])
def test_near_vectors_in_a_hot_cone(spark, n):
    x, planted = hot_cone(n)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    # passes so small that the rows need many rounds of them
    got = {r.vec_id: r.component_id for r in near_vectors.near_vectors(df, n_passes=8, window=16).collect()}
    links = [(int(i), int(j)) for i, j in zip(*np.nonzero(x @ x.T >= 0.9), strict=True) if i != j]
    assert len(links) >= 2 * planted
    want = classes(set(range(len(x))), links)
    missed = sum(got[i] != got[j] for i, j in links) / len(links)
    assert missed <= 0.005 and all(want[got[i]] == want[i] for i in got)


def test_log_miss_is_from_prefixes():
    keys = np.sort(np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 500))
    agree = near_vectors._agree(keys, keys[::-1].copy())
    want = [64 - (int(np.uint64(a) ^ np.uint64(b))).bit_length() for a, b in zip(keys.view(np.uint64), keys[::-1].copy().view(np.uint64), strict=True)]
    assert agree.tolist() == want
    inside = near_vectors.log_miss(keys, 20, 0.9, opens=False)
    assert (inside <= 0).all() and inside[0] == 0 and near_vectors.log_miss(keys, 20, 0.9, opens=True)[0] < 0
    assert (near_vectors.log_miss(np.zeros(9, np.int64), 4, 0.9, opens=False) == 0).all()


def brute_sets(texts: dict, k: int, num: int, den: int) -> dict:
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for i, t in texts.items():
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [
        (a, b) for x, a in enumerate(ids) for b in ids[x + 1 :]
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    ]
    comp = classes(set(ids), links)
    return {i: (len(sets[i]), comp[i]) for i in ids}


def near_texts() -> dict:
    rng = random.Random(3)
    common = [f"w{rng.randrange(900)}" for _ in range(120)]
    texts = {}
    for i in range(160):
        words = list(common) if i < 110 else [f"w{rng.randrange(900)}" for _ in range(rng.randrange(1, 90))]
        for _ in range(rng.randrange(0, 8)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    texts |= {200: None, 201: "", 202: " \t\n", 203: "Two Words", 204: "two\twords", 205: "ONE", 206: "one", 207: "É one", 208: "é one"}
    texts |= {300 + i: texts[3].upper() for i in range(5)}
    texts[400] = "long " * 30_000 + "tail"
    texts[401] = " ".join(f"t{i}" for i in range(30_000))
    texts[402] = texts[401] + " end"
    return texts


@pytest.mark.parametrize(("k", "t", "piece"), [(3, (9, 10), 1000), (3, (9, 10), 9), (5, (4, 5), 20), (1, (1, 2), 16)])
def test_set_join(spark, k, t, piece):
    texts = near_texts()
    df = spark.createDataFrame([(i, x, "n", 1) for i, x in texts.items()], "doc_id long, text string, id string, lead int").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in set_join.join_sets(df, k, t, piece).collect()}
    assert got == brute_sets(texts, k, *t)


def test_set_join_repeated_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (None, None), (3, "z y x")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in set_join.join_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, 0), (0, 4, 1), (1, 4, 1), (1, 4, 1), (2, 4, 1), (3, 1, 3)]
    assert set_join.join_sets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_windows():
    words = "a b c a b c a x".split()
    hashes = np.array([hash(w) for w in words], np.int64).view(np.uint64)
    starts = [i for i in range(6) if [tuple(words[j : j + 3]) for j in range(6)].count(tuple(words[i : i + 3])) > 1]
    assert in_repeated_windows(hashes, 3).tolist() == [any(s <= i < s + 3 for s in starts) for i in range(8)]
    assert len(shingle_set("a b c a b c a b", 3)) == 3 and len(shingle_set("a b", 3)) == 1 and len(shingle_set(None, 3)) == 0


def test_firsts_of_groups_with_repeated_ids(spark):
    a, b, c = "a b c d e f g h i j k l", "p q r s t u v", "x y z x y z w"
    rows = [(1, a), (1, b), (1, a), (1, b), (2, a.upper() + " m"), (3, c), (4, c), (5, None), (5, None), (6, ""), (None, a), (None, a), (7, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("x")).repartition(4)
    got = set_join.firsts_of_groups(docs, 5, (4, 5))
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id or 0, r.text or "") for r in got.collect()), key=str)
    assert [r for r in kept if r[1] == b] == [(1, b)] and [r for r in kept if r[0] == 0] == [(0, a)] * 2
    # one of the two near-copies stays, and one of the equal texts, the one with the smaller id
    assert sum(t.lower().startswith(a) for i, t in kept if i) == 1 and [r for r in kept if r[1] == c] == [(3, c)]
    assert [i for i, t in kept if not t] == [5, 6] and (7, "short") in kept
    plain = docs.dropDuplicates(["doc_id"]).filter("doc_id is not null")
    assert set_join.firsts_of_groups(plain, 5, (4, 5)).count() <= plain.count()
    assert set_join.firsts_of_groups(docs.limit(0), 5, (4, 5)).count() == 0
