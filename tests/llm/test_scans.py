"""Word runs, the filter audit and license templates against brute force, with the awkward rows each must survive."""

from __future__ import annotations

import collections
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docwarden.llm import filter_audit, license_scan, license_templates, term_matrix, word_runs

AWKWARD = [None, "", " \t\n", "a", "word " * 600, "no_blank" * 5000, "é é é é é é 日本 日本", "x\x00y \x00 x\x00y", "a b " * 9 + "a"]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w: list, times: int, least: int) -> list[tuple[int, int, int]]:
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((i, n, q) for (i, n), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng: random.Random) -> list[int]:
    w, kinds, size = [], rng.choice([1, 2, 3, 9]), rng.randrange(1, 130)
    while len(w) < size:
        w += [rng.randrange(kinds) for _ in range(rng.randrange(1, 7))] * rng.choice([1, 1, 2, 3, 4, 5, 8])
    return w


def test_lyndon_arrays_and_runs():
    rng = random.Random(3)
    for _ in range(600):
        w = repetitive(rng)
        for ranks in (w, [-x for x in w]):
            want = [next((j for j in range(i + 1, len(w)) if ranks[j:] < ranks[i:]), len(w)) - i for i in range(len(w))]
            assert word_runs.lyndon_array(np.array(ranks)).tolist() == want
        for times, least in ((4, 6), (2, 2), (3, 7)):
            assert word_runs.runs(np.array(w), times, least) == plain_runs(w, times, least)


def test_word_runs(spark):
    rng = random.Random(5)
    texts = [*AWKWARD, *(" ".join(f"w{x}" for x in repetitive(rng)) for _ in range(120)), "p q r s\n" * 700]
    rows = [(i if i % 7 else None, t, i) for i, t in enumerate(texts)] + [(1, texts[40], 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumn("n_words", F.lit("x"))
    got = word_runs.word_runs(docs).collect()
    want = collections.Counter()
    for i, text, _ in rows:
        w = WORDS.findall(text or "")
        found = plain_runs(w, 4, 6)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        want[i, len(w), tuple(found), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    assert collections.Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in got) == want
    best = word_runs.word_runs(docs).filter("doc_id = 1").select(word_runs.greatest().alias("run"), "runs").collect()
    assert all(r.run is None if not r.runs else tuple(r.run) == min(map(tuple, r.runs), key=lambda x: (-x[1], x[0], x[2])) for r in best)
    assert word_runs.word_runs(docs.limit(0)).count() == 0


def test_stretches_lose_no_run():
    rng = random.Random(8)
    import pyarrow as pa

    from docwarden.llm.word_arrays import split_words

    for _ in range(300):
        rows = [repetitive(rng) for _ in range(3)]
        words = split_words(pa.array([" ".join(map(str, r)) for r in rows]))
        want = [(int(b) + s, n, q) for b, r in zip(words.bounds, rows, strict=False) for s, n, q in plain_runs(r, 4, 6)]
        got = [(a + s, n, q) for a, b in word_runs.stretches(words) for s, n, q in word_runs.runs(words.codes[a:b])]
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("block", [term_matrix.BLOCK, 100])
def test_term_matrix(spark, block):
    rng = random.Random(2)
    texts = [*AWKWARD, *(" ".join(rng.choice("ab cd ef gh ij é".split()) for _ in range(rng.randrange(60))) for _ in range(50))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("starts", F.lit(7)).repartition(3 if block > 100 else 40)
    matrix = term_matrix.term_matrix(docs, ["doc_id", "starts"], block)
    words = {r.term: r.word for r in matrix.dictionary.collect()}
    assert sorted(words) == list(range(len(words))) and sorted(words.values()) == sorted({w for t in texts for w in WORDS.findall(t or "")})
    assert matrix.joined.count() > (15 if block == 100 else 2)
    got = {}
    for r in matrix.cells().collect():
        assert r.terms == sorted(set(r.terms)) and r.carried.starts == 7
        got[r.carried.doc_id] = {words[t]: n for t, n in zip(r.terms, r.counts, strict=True)}
    assert got == {i: collections.Counter(WORDS.findall(t or "")) for i, t in enumerate(texts)}
    totals = {r.doc_id: (r.n_words, r.n_distinct) for r in matrix.totals().collect()}
    assert totals == {i: (len(w := WORDS.findall(t or "")), len(set(w))) for i, t in enumerate(texts)}
    assert term_matrix.term_matrix(docs.limit(0), ["doc_id"]).totals().count() == 0


def test_filter_audit(spark):
    rng = random.Random(4)
    texts = [None, "", "ABC def", "x # y", "a " * 300, " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(250)), " ".join(f"w{i}|" for i in range(250))]
    rows = [(rng.choice([None, *range(90)]), rng.choice(texts), rng.choice([None, "", "s", "t"])) for _ in range(160)] + [(3, "x # y", "s")] * 3
    labels = [(i, rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for i in range(0, 90, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n", F.lit(1)).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(docs, marks, block=500).collect()}
    good, bad = ({i for i, *y in labels if i is not None and y[k] == 1} for k in (0, 1))
    judged = []
    for i, text, source in rows:
        t = text or ""
        w = WORDS.findall(t)
        failed = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (x or "") == t for j, x, _ in rows),
        }
        judged.append((source or "", {k for k, f in failed.items() if f}, i in good, i in bad))
    parts = {p for p, *_ in judged}
    assert len(got) == 600 * len(parts)
    shapley: collections.Counter = collections.Counter()
    for part, order in itertools.product(parts, map("".join, itertools.permutations("ABCDE"))):
        left = [j for j in judged if j[0] == part]
        mine = list(left)
        for step, letter in enumerate(order, 1):
            out = [j for j in left if letter in j[1]]
            left = [j for j in left if letter not in j[1]]
            r = got[part, order, step]
            fails = [j for j in mine if letter in j[1]]
            assert (r.kept, r.removed, r.redundant) == (len(left), len(out), len(fails) - len(out))
            assert (r.unique_fails, r.good_lost, r.toxic_lost) == (sum(len(j[1]) == 1 for j in fails), sum(j[2] for j in out), sum(j[3] for j in out))
            shapley[part, letter] += len(out)
    assert all(r.shapley == shapley[p, order[step - 1]] for (p, order, step), r in got.items())
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert filter_audit.audit(docs, marks.limit(0)).filter("good_lost > 0 or toxic_lost > 0").count() == 0


# ---- license templates


def pattern(parts: list) -> str:
    """A template as a regular expression over words that each end with a blank."""
    out = ""
    for p in parts:
        out += f"{re.escape(p)} " if isinstance(p, str) else f"(?:[^ ]+ ){{{p[0]},{p[1]}}}" if isinstance(p, tuple) else f"(?:{pattern(p)})?"
    return out


def plain_scan(text: str | None) -> tuple:
    words = license_scan.words_of(text or "")
    line = "".join(f"{w} " for w in words)
    begins = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
    phrases = sorted(
        (label, i, len(p)) for label, phrase in license_templates.PHRASES for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p
    )
    longest: dict = {}
    for label, template in license_templates.TEMPLATES:
        found = re.compile(pattern(license_scan.parse(template)))
        for i, at in enumerate(begins[:-1]):
            # a regular expression takes the first way, not the longest: no template here ends with a region
            if m := found.match(line, at):
                longest[label, i] = max(longest.get((label, i), 0), m[0].count(" "))
    return len(words), phrases, sorted((label, i, n) for (label, i), n in longest.items())


def spelt(template: str, rng: random.Random) -> str:
    """A text that the template accepts."""

    def words(parts: list) -> list[str]:
        out = []
        for p in parts:
            if isinstance(p, str):
                out.append(rng.choice([p, p.upper(), p.title()]))
            elif isinstance(p, tuple):
                out += [rng.choice(["Jane", "the", "license", "2024"]) for _ in range(rng.randint(*p))]
            elif rng.random() < 0.5:
                out += words(p)
        return out

    return rng.choice(["", "Some words, then. "]) + "".join(w + rng.choice([" ", "\n", ", ", " -- "]) for w in words(license_scan.parse(template))) + rng.choice(["", "And more."])


def test_license_scan(spark, folder):
    rng = random.Random(6)
    texts = [*AWKWARD, "MIT License mit license", "general public general public license", "Released under the MIT", "licensed under the Apache License, version 2.1"]
    whole = [(label, spelt(t, rng)) for label, t in license_templates.TEMPLATES for _ in range(4)]
    broken = []
    for _, t in whole:
        w = t.split()
        k = rng.randrange(len(w))
        broken.append(" ".join([*w[:k], "oddword", *w[k + 1 :]]))
    texts += [t for _, t in whole] + broken + [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").limit(100).collect()] + ["Released under the MIT License. " * 3000]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    got = collections.Counter((r.doc_id, r.n_words, tuple(sorted(map(tuple, r.phrases))), tuple(sorted(map(tuple, r.matches)))) for r in license_scan.scan(docs).collect())
    assert got == collections.Counter((i, n, tuple(p), tuple(m)) for i, t in rows for n, p, m in [plain_scan(t)])
    by_text = {t: {m.label for m in r.matches} for t, r in zip(texts, license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect(), strict=True)}
    assert all(label in by_text[t] for label, t in whole)
    scores = [r.score for r in license_scan.scan(docs).collect()]
    assert all(0 <= s <= 1 for s in scores)
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_license_scores(spark):
    texts = ["Released under the MIT License.", "released under the license", "nothing of the kind", "released under"]
    got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.score for r in got] == pytest.approx([1.0, 0.6, 0.0, 0.4])


@pytest.mark.parametrize("template", ["<<beginOptional>>a", "a<<endOptional>>", "<<var;name=x;words=3-2>> a", "<<beginOptional>>a<<endOptional>>"])
def test_templates_that_are_refused(template):
    with pytest.raises(ValueError):
        license_scan.Matcher([("x", template)], [])
