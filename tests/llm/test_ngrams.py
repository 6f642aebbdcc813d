"""The n-gram model against one made of dictionaries, its arrays against plain ones."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import catalog, ngrams

SCHEMA = "doc_id long, text string, block int, keys string, score double"


def tokens_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + ["</s>"]


def model(texts, order, d):
    """p(word | context before it) of the interpolated model."""
    counts = [defaultdict(Counter) for _ in range(order)]
    for t in texts:
        seq = ["<s>", *tokens_of(t)]
        for i in range(1, len(seq)):
            for k in range(order):
                if i - k >= 0:
                    counts[k][tuple(seq[i - k : i])][seq[i]] += 1
    one = counts[0][()]
    total, words = sum(one.values()), len(one)

    def p(word, before):
        out = (one[word] + 1) / (total + words + 1)
        for k in range(1, min(order, len(before) + 1)):
            seen = counts[k].get(tuple(before[-k:]))
            if seen:
                n = sum(seen.values())
                out = max(seen[word] - d, 0) / n + d * len(seen) / n * out
        return out

    return p, one, total, words


def make(seed=1, n=220):
    rng = random.Random(seed)
    words = ["the"] * 30 + [f"w{i}" for i in range(60)] + ["Über", "ÀB", "x y", "AbC"]
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "the"), (4, "THE the"), (4, "THE the"), (None, "w1 w2 w3"), (6, "hot pair " * 400)]
    for i in range(7, n):
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))))
    return rows


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize(("order", "block", "width"), [(3, 2_000_000, 4), (3, 300, 30), (2, 700, 3), (4, 500, 2)])
def test_scores_equal_dictionaries(spark, monkeypatch, order, block, width):
    monkeypatch.setattr(ngrams, "BLOCK", block)
    monkeypatch.setattr(ngrams, "shuffle_width", lambda _: width)
    rows = make()
    df = spark.createDataFrame([(i, t, 1, "x", 0.5) for i, t in rows], SCHEMA).repartition(3)
    learn = ~(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    got = ngrams.score_texts(df, F.coalesce(learn, F.lit(True)), order=order).collect()
    assert len(got) == len(rows)
    p, one, total, words = model([t for i, t in rows if not is_held(i)], order, ngrams.DISCOUNT)
    by = {i: t for i, t in rows}
    for r in got:
        seq = ["<s>", *tokens_of(by[r.doc_id])]
        score = sum(math.log10(p(seq[i], seq[:i])) for i in range(1, len(seq)))
        base = sum(math.log10((one[w] + 1) / (total + words + 1)) for w in seq[1:])
        assert r.n_tokens == len(seq) - 1 and r.n_known == sum(one[w] > 0 for w in seq[1:])
        assert r.train_tokens == total and r.learned == (not is_held(r.doc_id))
        assert math.isclose(r.base_score, base, rel_tol=1e-12)
        assert abs(r.score - score) < 3e-4 * len(seq)


def test_probabilities_of_a_context_add_up():
    texts = [t for _, t in make(3, 60)]
    p, one, *_ = model(texts, 3, 0.75)
    for before in (["<s>"], ["the", "w1"], ["w1", "the"], ["unheard", "of"]):
        assert math.isclose(sum(p(w, before) for w in [*one, "never seen"]), 1, rel_tol=1e-9)


def test_nothing_learned_and_nothing_there(spark):
    df = spark.createDataFrame([(1, "a b", 1, "x", 0.5), (2, None, 1, "x", 0.5)], SCHEMA)
    got = {r.doc_id: r for r in ngrams.score_texts(df, F.lit(None).cast("boolean")).collect()}
    assert got[1].score == got[1].base_score == 0 and (got[1].n_tokens, got[1].n_known, got[1].train_tokens) == (3, 0, 0)
    assert ngrams.score_texts(df.limit(0), F.lit(True)).collect() == []


def test_arrays():
    rng = np.random.default_rng(3)
    for n, top in ((0, 9), (1, 1), (1, 2**63), (5000, 2**20), (3000, 2**62), (700, 40)):
        x = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=False))
        raw = np.frombuffer(ngrams.elias_fano(x), dtype=np.uint8)
        assert (ngrams.elias_fano_values(raw) == x).all()
        assert n < 3000 or len(raw) * 8 < n * (np.log2(top / n) + 3) + 300
        assert (ngrams.unpack(ngrams.pack(x), np.uint64) == x).all()
    p = np.array([1, 0.5, 1e-12, 0, 0.3])
    assert np.allclose(ngrams.unquantised(ngrams.quantised(p)), p, rtol=4e-4)


def test_children_are_found_in_their_context(tmp_path):
    rng = random.Random(8)
    pairs = {(a, b): rng.randrange(1, 5) for a in range(0, 40, 3) for b in rng.sample(range(50), rng.randrange(1, 20))}
    keys = np.array(sorted(a * 50 + b for a, b in pairs))
    counts = np.array([pairs[divmod(k, 50)] for k in keys.tolist()])
    trie = ngrams.Trie(str(tmp_path / "t"), ngrams.write_trie(str(tmp_path / "t"), [keys], [counts], 50, {}, 0.75))
    a, b = np.divmod(np.arange(60 * 50), 50)
    node, code = trie.children(0, trie.roots(a), b)
    for x, y, at, c in zip(a.tolist(), b.tolist(), node.tolist(), ngrams.unquantised(code), strict=True):
        total = sum(n for (k, _), n in pairs.items() if k == x)
        want = (pairs[x, y] - 0.75) / total if (x, y) in pairs else 0
        assert (at >= 0) == ((x, y) in pairs) and math.isclose(c, want, rel_tol=4e-4)


def test_query_beats_unigrams_on_held_out_texts(spark, tmp_path):
    rng, rows = random.Random(2), []
    for i in range(300):
        at = [rng.randrange(40)]
        for _ in range(50):
            at.append((at[-1] * 7 + rng.randrange(3)) % 40)
        rows.append((i, " ".join(f"v{x}" for x in at)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held = [r for r in catalog.op13_ngrams(spark, str(tmp_path)).collect() if r.held_out]
    assert len(held) > 20 and sum(r.score for r in held) > 0.5 * sum(r.base_score for r in held)
