"""The Merkle manifest against a tree built in one go: ragged ends, single rows, nulls, repeated rows, many levels."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from spindrift.llm import catalog, merkle

SCHEMA = "doc_id long, source string, text string, _digest string, _key int, _group string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def path(levels, i, fanout):
    out = []
    for nodes in levels[:-1]:
        start = i // fanout * fanout
        out.append((nodes[start:i], nodes[i + 1 : start + fanout]))
        i //= fanout
    return out


def expected(rows, fanout):
    """(doc_id, leaf) -> all (subroot, root, proof) of such rows."""
    groups = {}
    for doc, source, text, *_ in rows:
        groups.setdefault(source, []).append((doc is not None, doc or 0, digest(said(doc), said(source), said(text)), doc))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf for *_, leaf, _ in sorted(groups[s], key=lambda r: r[:3])], fanout) for s in names}
    top = tree([trees[s][-1][0] for s in names], fanout)
    out = {}
    for k, s in enumerate(names):
        for i, (*_, leaf, doc) in enumerate(sorted(groups[s], key=lambda r: r[:3])):
            proof = path(trees[s], i, fanout) + path(top, k, fanout)
            out.setdefault((doc, leaf), []).append((trees[s][-1][0], top[-1][0], proof))
    return out


def rows_of(n, seed):
    rng = random.Random(seed)
    out = [(i, rng.choice(["hot", "hot", "hot", "b", "ü", None, ""]), rng.choice(["x\ny", "é", "", None]), "d", 1, "g") for i in range(n)]
    return out + [(7000, "alone", "one", "d", 1, "g")] + [(7, "hot", "same", "d", 1, "g")] * 9 + [(None, "b", "no id", "d", 1, "g")] * 2


@pytest.mark.parametrize(("n", "fanout", "lift", "parts"), [(900, 3, 6, 4), (700, 2, 2, 9), (60, 3, 6, 30), (0, 3, 6, 4)])
def test_trees_and_proofs(spark, monkeypatch, n, fanout, lift, parts):
    monkeypatch.setattr(merkle, "LIFT", lift)
    monkeypatch.setattr(merkle, "shuffle_width", lambda _: parts)
    rows = rows_of(n, n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {}
    for r in merkle.manifest(df, ["doc_id", "source", "text"], fanout=fanout).collect():
        got.setdefault((r.doc_id, r.leaf), []).append((r.subroot, r.root, [(s.left, s.right) for s in r.proof]))
    want = expected(rows, fanout)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), ["doc_id", "text"]).collect() == []


def test_only_tampered_rows_fail(spark):
    df = spark.createDataFrame(rows_of(80, 3), SCHEMA)
    changed = F.when(F.col("doc_id") == 11, "forged").otherwise(F.col("text"))
    made = merkle.manifest(df, ["doc_id", "text"], tampered=[F.col("doc_id"), changed])
    wrong = made.where(merkle.fold(F.col("found_leaf"), F.col("proof")) != F.col("root"))
    assert [r.doc_id for r in wrong.collect()] == [11]


def test_query(spark, tmp_path):
    rows = [(i, f"s{i % 3}", "en", 3, None if i == 4 else f"a\n{i}") for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.op11_merkle(spark, str(tmp_path)).collect()
    assert len(got) == 50 and len({r.root for r in got}) == 1 and len({r.subroot for r in got}) == 3
    import zlib

    for r in got:
        tampered = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and r.doc_id != 4
        assert r.verified == (not tampered) == (r.folded_root == r.root)
