"""Runs of repeated word sequences against a search of all periods, word by word."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from spindrift.llm import catalog, periodic


def brute(words, least, copies):
    """Every maximal run with its smallest period, from all periods."""
    n, found = len(words), {}
    for q in range(1, n // copies + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, copies * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def names(words):
    return np.array([hash(w) for w in words], dtype=np.int64)


def texts(seed, count=160):
    rng = random.Random(seed)
    out = [[], ["a"], ["a"] * 24, ["a"] * 23, ["a", "b"] * 40, (["a"] * 9 + ["b"]) * 12, list("abcab" * 9 + "xyz" * 11)]
    while len(out) < count:
        letters = "ab" if rng.random() < 0.5 else "abcdefgh"
        words = []
        for _ in range(rng.randrange(1, 6)):
            unit = [rng.choice(letters) for _ in range(rng.randrange(1, 9))]
            words += unit * rng.randrange(1, 12) + unit[: rng.randrange(0, len(unit) + 1)]
            words += [rng.choice(letters) for _ in range(rng.randrange(0, 12))]
        out.append(words)
    return out


@pytest.mark.parametrize(("least", "copies"), [(24, 3), (1, 2), (6, 2), (9, 4)])
def test_runs_equal_brute_force(least, copies):
    cases = texts(least)
    got = periodic.runs_of([names(w) for w in cases], least, copies)
    for words, runs in zip(cases, got, strict=True):
        assert [(r[0], r[1], r[2]) for r in runs] == brute(words, least, copies), words


def test_little_room_gives_the_same(monkeypatch):
    cases = texts(99, 60)
    want = periodic.runs_of([names(w) for w in cases])
    monkeypatch.setattr(periodic, "LEAVES", 7)
    assert periodic.runs_of([names(w) for w in cases]) == want
    assert [periodic.runs_of([names(w)])[0] for w in cases] == want


def test_long_text_of_one_word():
    assert periodic.runs_of([names(["x"] * 300_000)]) == [[(0, 300_000, 1)]]
    words = [str(i % 1000) for i in range(200_000)] + ["end"]
    assert periodic.runs_of([names(words)]) == [[(0, 200_000, 1000)]]


def test_strongest_is_exact():
    runs = [(5, 30, 7), (0, 60, 14), (2, 30, 7)]
    assert periodic.strongest(runs) == (0, 60, 14)
    assert periodic.strongest([(9, 10**15 + 1, 10**14), (3, 10**15, 10**14)]) == (9, 10**15 + 1, 10**14)
    assert periodic.strongest([]) is None


def test_table(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, " a\tb \n" * 30, "x", 1), (3, " a\tb \n" * 30, "x", 1), (None, "é " * 24 + "end", "x", 1), (4, "w " * 23, "x", 1)]
    rows.append((5, "start " + "long word here " * 40_000 + "end", "x", 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, n int").repartition(3)
    got = {(r.doc_id, r.n_words): r for r in periodic.periodic_runs(df).collect()}
    assert len(got) == 6
    assert got[1, 0].runs == [] and got[1, 0].best is None and got[1, 0].collapsed == "" == got[2, 0].collapsed
    assert tuple(got[3, 60].best) == (0, 60, 2) and got[3, 60].collapsed == "a b"
    assert tuple(got[None, 25].best) == (0, 24, 1) and got[None, 25].collapsed == "é end"
    assert got[4, 23].runs == []
    assert got[5, 80_002].collapsed == "start long word here end"
    assert periodic.periodic_runs(df.limit(0)).collect() == []


def test_query_equals_brute_force(spark, tmp_path):
    rng, rows = random.Random(4), []
    for i in range(400):
        words = [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(rng.randrange(0, 150))]
        if i % 7 == 0:
            words += ["x", "y"] * rng.randrange(8, 20) + words[:5]
        rows.append((i, None if i % 50 == 3 else rng.choice(["\n", " ", "\t "]).join(words)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in catalog.op12_periodic(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    planted = 0
    for i, text in rows:
        words = (text or "").split()
        h = zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a, planted = g % n, planted + 1
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
        runs = brute(words, 24, 3)
        drop = {k for s, m, q in runs for k in range(s + q, s + m)}
        r = got[i]
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(w for k, w in enumerate(words) if k not in drop))
        if runs:
            best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (*best, 1000 * best[1] // best[2])
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
    assert planted > 20
