"""Numbers of rows that do not divide, and values that only large tables reach."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from spindrift.functions import parsing as ps
from spindrift.operators import batches as bt
from spindrift.operators import dataset as ds
from spindrift.operators import losses, metrics
from spindrift.operators import repository as rp
from spindrift.plans import catalog


def test_ragged_chunks_keep_the_rest(spark, tmp_path):
    got = bt.chunk(spark.range(7).withColumnRenamed("id", "row_id"), 3, 7, ragged=True)
    assert sorted((r.row_id, r.chunk) for r in got.collect()) == [(i, i // 3) for i in range(7)]
    docs = spark.range(101).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["b3_chunk"](spark, str(tmp_path)).collect()
    assert sorted((r.row_id, r.chunk) for r in got) == [(i, i // 50) for i in range(101)]


def test_ragged_parts_differ_by_one_row_at_most(spark, tmp_path):
    for n in range(1, 12):
        parts = bt.largest_differencing([7 * i % 5 + 1 for i in range(n)], 4, True, ragged=True)
        assert sorted(i for p in parts for i in p) == list(range(n))
        assert max(map(len, parts)) - min(map(len, parts)) == (1 if n % 4 else 0)
    rows = spark.range(70).select(F.col("id").alias("vec_id"), F.array_repeat(F.lit(0.5).cast("float"), 64).alias("embedding"))
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.queries()["b12_equal_parts"](spark, str(tmp_path)).collect()
    assert sorted(r.row_id for r in got) == list(range(70))
    assert sorted(sum(r.part == p for r in got if r.step == 1) for p in range(4)) == [1, 1, 2, 2]


def test_size_classes_of_cubes_beyond_a_long(spark, tmp_path):
    keys = {9: "n<1K", 10: "1K<n<10K", 999: "100M<n<1B", 1000: "n>1B", 9_000_000: "n>1B"}
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert {r.id: r.size for r in catalog.queries()["a19_size_class"](spark, str(tmp_path)).collect()} == keys


def test_coefficients_of_steps_longer_than_the_horizon(spark):
    rows = [(1, 0.1, 60_000), (2, 0.1, 50_000), (3, 0.9, 7_000), (4, 0.1, 200_000)]
    out = losses.adaptive_coefficients(spark.createDataFrame(rows, "step long, kl double, n long"), 0.05, 0.4, 10_000)
    beta = 0.05
    for r, (step, kl, n) in zip(out.orderBy("step").collect(), rows, strict=True):
        after = beta * (1 + min(0.2, max(-0.2, kl / 0.4 - 1)) * n / 10_000)
        assert (r.step, r.beta, r.next) == (step, beta, after)
        beta = after


def test_cents_are_those_of_the_hundredfold(spark):
    cases = {("1.005", "1"): 1.0, ("0.005", "0"): 0.0, ("2.005", "2.01"): 1.0, ("-0.005", "-0.01"): 1.0, ("3.004", "3"): 1.0, ("1e307", "1e307"): 1.0, ("1e307", "1e306"): 0.0, ("none", "1"): 0.0}
    rows = spark.createDataFrame(list(cases), "a string, b string").select("a", "b", ps.same_to_cents(F.col("a"), F.col("b")).alias("s")).collect()
    assert {(r.a, r.b): r.s for r in rows} == cases


def test_volumes_round_halves_to_even(spark):
    cases = {0: "0 B", 1023: "1023 B", 1024: "1.0 KiB", 1280: "1.2 KiB", 1792: "1.8 KiB", 2304: "2.2 KiB", 5 << 18: "1.2 MiB", 5 << 28: "1.2 GiB", 5 << 38: "1.2 TiB", 1 << 53: "8192.0 TiB"}
    rows = spark.createDataFrame([(n,) for n in cases], "n long").select("n", rp.human_bytes(F.col("n")).alias("v")).collect()
    assert {r.n: r.v for r in rows} == cases


def test_token_diversity_counts_pairs_without_making_them(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        t = [rng.randint(0, 2) if rng.random() < 0.9 else None for _ in range(rng.randint(0, 5))]
        rows.append((i % 3 if i < 58 else i, i, t, [rng.randint(0, 1) if rng.random() < 0.9 else None for _ in range(rng.randint(0, 6))]))
    got = metrics.token_diversity(spark.createDataFrame(rows, "uid long, row_id long, tokens array<int>, mask array<int>")).first()
    at = lambda xs, i: xs[i] if i < len(xs) else None
    means = []
    for g in range(3):
        shares = []
        for a, b in combinations([r for r in rows if r[0] == g], 2):
            both = [i for i in range(6) if at(a[3], i) and at(b[3], i)]
            shares.append(sum(at(a[2], i) is not None and at(a[2], i) == at(b[2], i) for i in both) / len(both) if both else 0.0)
        means.append(sum(shares) / len(shares))
    assert got.groups == 3 and got.pair_agreement == pytest.approx(sum(means) / 3, abs=1e-12)


def test_token_diversity_of_one_large_group(spark):
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i < F.col("id") % 4 + 2).cast("int"))
    rows = spark.range(40_000).select(F.lit(1).alias("uid"), F.col("id").alias("row_id"), F.array_repeat((F.col("id") % 2).cast("int"), 8).alias("tokens"), mask.alias("mask"))
    got = metrics.token_diversity(rows).first()  # 799,980,000 pairs
    assert (got.groups, round(got.pair_agreement, 9)) == (1, round((2 * 20_000 * 19_999 / 2) / (40_000 * 39_999 / 2), 9))


def test_greedy_rounds_are_few_and_carry_no_texts(spark, monkeypatch):
    """Sources that wait for each other's repeats; what a round writes is numbers, whatever the rows hold."""
    rng = random.Random(3)
    rows = [(i, f"s{i % 8}", i // 8 if i % 5 else i % 40, [f"m{rng.randint(0, 150)}"], "x" * 50, i % 8, rng.random()) for i in range(800)]
    df = spark.createDataFrame([(i, s, f"id{n}", a, t, o, r, 30) for i, s, n, a, t, o, r in rows], "row_id long, source string, identity string, anchors array<string>, text string, so int, r double, quota int")
    written = []
    monkeypatch.setattr(ds, "durable", lambda d, real=ds.durable: written.append(d.columns) or real(d))
    got = {r.row_id: r.verdict for r in ds.capped_greedy(df, 2, ["so", "r", "row_id"]).collect()}
    want, taken, ids, used = {}, {}, set(), {}
    for i, s, n, (a,), *_ in sorted(rows, key=lambda x: (x[5], x[6], x[0])):
        want[i] = "quota" if taken.get(s, 0) >= 30 else "identity" if n in ids else "cap" if used.get(a, 0) >= 2 else "taken"
        if want[i] == "taken":
            taken[s], used[a] = taken.get(s, 0) + 1, used.get(a, 0) + 1
            ids.add(n)
    assert got == want
    assert not any("text" in columns for columns in written)
    assert all(not {"identity", "anchors", "r"} & set(columns) for columns in written[1:])
    assert len(written) < 20  # 13: six or so rounds, not as many as sources wait for each other


def one_by_one(rows, train, size, cap):
    """The held-out selection row by row; rows are row_id, identity, anchor, rank."""
    ids, media = {r[1] for r in train}, {r[2] for r in train}
    want, taken, got, used = {}, set(), 0, {}
    for i, n, a, _ in sorted(rows, key=lambda x: (x[3], x[0])):
        if n in ids or a in media:
            want[i] = "train_identity" if n in ids else "train_media"
            continue
        want[i] = "quota" if got >= size else "identity" if n in taken else "cap" if used.get(a, 0) >= cap else "taken"
        if want[i] == "taken":
            got, used[a] = got + 1, used.get(a, 0) + 1
            taken.add(n)
    return want


@pytest.mark.parametrize(("media", "size", "cap"), [(1500, 6, 2), (3, 6, 1)])
def test_canary_writes_only_keys_of_all_candidates(spark, monkeypatch, media, size, cap):
    """Few rows are enough for the size, or all are needed: with three media files and a cap of one no more than three are taken."""
    rng = random.Random(7)
    made = [(i, f"id{rng.randint(0, 4000)}", f"m{rng.randint(0, media - 1)}") for i in range(5000)]
    df = spark.createDataFrame(made, "row_id long, identity string, anchor string").select(
        "row_id", "identity", F.lit("s").alias("source"), F.sha2("identity", 256).alias("digest"), F.col("row_id").alias("source_index"), F.array("anchor").alias("anchors"), F.array("anchor").alias("tokens")
    )
    train = df.where("row_id % 7 = 0") if media > 3 else df.where("row_id % 7 = 0").withColumn("tokens", F.array(F.lit("none")))
    ranks = {r.row_id: r.k for r in df.select("row_id", ds.candidate_order(17, "canary")[0].alias("k")).collect()}
    written = []

    def watched(d, real=ds.durable):
        out = real(d)
        written.append((set(out.columns), out.count()))
        return out

    monkeypatch.setattr(ds, "durable", watched)
    got = {r.row_id: r.verdict for r in ds.select_canary(df, train, size, cap=cap).collect()}
    rows = [(i, n, a, ranks[i]) for i, n, a in made]
    known = [(i, n, a if media > 3 else "none", 0) for i, n, a in made if i % 7 == 0]
    assert got == one_by_one(rows, known, size, cap)
    assert not any({"tokens", "digest"} & columns for columns, _ in written)
    if media > 3:
        assert all(n < 2000 for columns, n in written if columns != {"row_id", "verdict"})
