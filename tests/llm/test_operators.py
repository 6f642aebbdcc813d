"""Operators of the llm subpackage against brute force on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import (
    common,
    components,
    decontaminate,
    licenses,
    lines,
    mixing,
    near_duplicates,
    nearest,
    revisits,
    sharding,
    suffixes,
    toxicity,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _h string, _k string, row string, size int"


def make(spark, rows):
    """Documents with extra columns whose names clash with those that operators use."""
    full = [(i, t, "en", s, len(t or ""), "x", "y", "z", 7) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def blank_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def term_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


WORDS = "the of and Über Ñandú run river stone light Apple código vers le grand petit tree 42 x-ray".split()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))
    out = [(0, None, "a"), (1, "", "a"), (2, " \n\t ", None), (3, "one", "b"), (4, "one", "b"), (5, "one two", "b")]
    base = [text(60) for _ in range(6)]
    for i in range(6, 90):
        kind = rng.randrange(5)
        if kind == 0:
            t = base[rng.randrange(6)]
        elif kind == 1:
            w = base[rng.randrange(6)].split()
            for _ in range(rng.randrange(1, 6)):
                w[rng.randrange(len(w))] = rng.choice(WORDS) + "!"
            t = " ".join(w)
        elif kind == 2:
            t = text(rng.randrange(1, 30)) + "\n" + base[rng.randrange(6)][20:220] + "\n" + text(rng.randrange(1, 30))
        else:
            t = text(rng.randrange(1, 80))
        out.append((i, t, rng.choice(["hot", "hot", "hot", "b", "ü", None])))
    out.append((200, text(4000), "hot"))  # a long text
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows).repartition(5).cache()


def empty(docs):
    return docs.where("false")


# Suffix dedup ------------------------------------------------------------------------------------------------------


def brute_repeats(rows, length):
    seen, out = set(), []
    for _, t in rows:
        raw = (t or "").encode()
        cover = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            gram = raw[p : p + length]
            if gram in seen:
                cover[p : p + length] = b"\x01" * length
            else:
                seen.add(gram)
        kept = bytes(c for c, x in zip(raw, cover, strict=True) if not x)
        spans = sum(1 for i, x in enumerate(cover) if x and (i == 0 or not cover[i - 1]))
        out.append((len(raw), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [100, 40])
def test_repeats_match_brute_force(docs, rows, length):
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.remove_repeats(docs, length=length).collect()}
    expected = dict(zip([i for i, *_ in rows], brute_repeats([(i, t) for i, t, _ in sorted(rows)], length), strict=True))
    assert got == expected
    assert sum(e[1] for e in expected.values()) > 0


def test_repeats_of_periodic_and_hot_strings(spark):
    rows = [(i, ("ab" * (60 + i) if i % 2 else f"{i}" * 3 + "z" * 150 + f"{i:03d}" * 40), "s") for i in range(12)]
    small = suffixes.repeated_spans  # the crowded path: every group counts as hot
    texts = make(spark, rows).select(F.col("doc_id").alias("ord"), "text")
    spans = defaultdict(list)
    for r in small(texts, 100, hot=1).where("kind = 1").collect():
        for o, lo, hi in np.frombuffer(r.blob, dtype=suffixes.SPAN).tolist():
            spans[o].append((lo, hi))
    expected = brute_repeats([(i, t) for i, t, _ in rows], 100)
    for i, t, _ in rows:
        assert len({p for lo, hi in spans[i] for p in range(lo, hi)}) == expected[i][1], (i, t)


def test_repeats_with_null_and_repeated_ids(spark):
    text = "lorem ipsum " * 20
    rows = [(None, text, "s"), (7, text + "x", "s"), (7, text + "x", "s")]
    got = sorted(suffixes.remove_repeats(make(spark, rows).coalesce(1)).collect(), key=lambda r: (r.doc_id is not None, r.n_removed))
    expected = brute_repeats([(0, text), (1, text + "x"), (2, text + "x")], 100)
    assert [tuple(r)[1:] for r in got] == [expected[0], *sorted(expected[1:], key=lambda e: e[1])]
    assert suffixes.remove_repeats(make(spark, rows).where("false")).count() == 0


def test_names_that_run_over_many_blocks_are_settled_alike():
    rng = np.random.default_rng(2)
    x = np.zeros(3000, dtype=suffixes.SUFFIX)
    x["name"], x["stretch"] = rng.choice([3, 5, 8, *range(100, 400)], 3000, p=[0.3, 0.2, 0.2, *[0.3 / 300] * 300]), rng.integers(0, 40, 3000)
    x["ord"], x["at"], x["lo"], x["hi"] = rng.integers(0, 50, 3000), rng.integers(100, 900, 3000), rng.integers(3, 9, 3000), rng.integers(0, 3, 3000)
    x = x[np.lexsort([x[f] for f in ("at", "ord", "stretch", "name")])]

    def outcome(blocks, hot):
        parts = list(suffixes.settled(iter(blocks), 100, hot))
        return [sorted(np.concatenate([p[k] for p in parts]).tolist()) for k in (0, 1)]

    for hot in (5, 1000):
        whole = outcome([x], hot)
        assert outcome(np.array_split(x, 70), hot) == whole and outcome(np.array_split(x, 3), hot) == whole
    assert len(outcome([x], 5)[1]) > len(outcome([x], 1000)[1])


def test_a_text_beyond_one_scan(spark):
    rng = random.Random(11)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_300_000))
    passage = long[suffixes.SCAN - 300 : suffixes.SCAN + 200]
    rows = [(1, long, "s"), (2, "q" * 50 + passage + "r" * 50, "s"), (3, long[900_000:], "s")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove_repeats(make(spark, rows)).collect()}
    assert got == {1: (1_300_000, 0, 0), 2: (600, 500, 1), 3: (400_000, 400_000, 1)}


def test_external_sorter_spills_and_merges():
    rng = np.random.default_rng(1)
    sorter = suffixes.ExternalSorter(["ord", "p"], limit=4000, block=50)
    parts = []
    for _ in range(20):
        x = np.zeros(100, dtype=suffixes.WINDOW)
        x["ord"], x["p"] = rng.integers(0, 9, 100), rng.integers(0, 1000, 100)
        parts.append(x)
        sorter.add(x)
    assert len(sorter.runs) > 3
    got = np.concatenate(list(sorter.merged()))
    assert got[["ord", "p"]].tolist() == sorted(np.concatenate(parts)[["ord", "p"]].tolist())


# Toxicity ----------------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_automaton_finds_all_words_in_reach(edits):
    rng = random.Random(3)
    word = lambda a, b: "".join(rng.choice("abc") for _ in range(rng.randint(a, b)))
    lexicon = [word(5, 8) for _ in range(50)]
    trie = toxicity.Trie(lexicon, edits)
    for _ in range(500):
        w = word(3, 9)
        assert set(trie.near(w)) == {v for v in lexicon if distance(v, w) <= edits}


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(9)
    plain = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(30)]
        toxic = int(rng.random() < 0.2)
        if toxic:
            words[rng.randrange(30)] = rng.choice(["dimwit", "nitwitted", "grumblefoo", "grumblebar"])
        rows.append((i, " ".join(words).capitalize(), "s"))
        labels.append((i, 1, toxic))
    rows += [(900, None, "s"), (901, "", "s"), (902, "such a dimvit here", "s"), (903, 'he said "you dimwit" to me', "s"), (904, "you dimwit", "s"), (905, "a grumblebaz day", "s")]
    return make(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_held_out_rows_are_judged_right(judged):
    docs, labels, truth = judged
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [(i, x) for i, _, x in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum(got[i].predicted == x for i, x in held)
    assert right / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[904].predicted == 1 and got[905].predicted == 1
    assert got[902].predicted == 1  # misspelt
    assert got[903].score < got[904].score  # quoted
    assert got[900].predicted == got[901].predicted == 0


def test_clean_neighbour_of_a_term_leaves_other_misspellings_alone(judged):
    docs, labels, truth = judged
    clean = {i for i, _, x in truth if not x and i % 3 == 0}  # a common clean word one edit from a term
    text = F.when(F.col("doc_id").isin(clean), F.concat("text", F.lit(" dimwip"))).otherwise(F.col("text"))
    docs = docs.withColumn("text", text)
    more = make(docs.sparkSession, [(906, "such a dimwip here", "s"), (907, "you nitwittid thing", "s"), (908, "the grumblefo day", "s")])
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs.union(more), toxicity.learn(docs, labels)).collect()}
    assert got[906] == 0 and got[902] == got[907] == 1
    assert not any(got[i] for i in clean)


def test_misspellings_of_every_learned_word_are_looked_up(judged):
    short = toxicity.Scorer({"scum": 7.0, "git": 7.0}, -2.0)
    assert {w: short.misspelling(w) for w in ("scumm", "scm", "gitt", "gi", "word")} == {"scumm": ["scum"], "scm": ["scum"], "gitt": ["git"], "gi": ["git"], "word": []}
    many = [f"{a}{b}{c}{'xyzw' * 2}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uv"] + ["pqrstlmn"] * 2 + [f"zz{a}{b}qqqq" for a in "abcdefghij" for b in "klmnopqrst"]
    wide = toxicity.Scorer({w: 7.0 - k / 1000 for k, w in enumerate(many)}, -2.0)
    assert all(w in wide.misspelling(w[:-1] + "#") for w in many)
    docs, labels, _ = judged
    text = F.regexp_replace("text", "dimwit", "scum")
    docs = docs.withColumn("text", text).union(make(docs.sparkSession, [(906, "such scumm here", "s")]))
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, toxicity.learn(docs, labels)).collect()}
    assert got[906] == 1 and got[905] == 1 and got[901] == 0


@pytest.mark.parametrize(
    ("text", "quoted"),
    [
        ("he told her “come in” and then you dimwit left and “closed the door”", False),
        ('"' + "word " * 20 + 'word" you dimwit "closed the door"', False),
        ('"come in," and you dimwit, "closed"', False),
        ('a 5" pipe, you dimwit, and a 6" pipe', False),
        ("don’t you dimwit say it isn’t", False),
        ("„komm“ du dimwit „geh“", False),
        ("«viens» dimwit «va»", False),
        ("‘come’ you dimwit ‘go’", False),
        ("“ never closed, you dimwit", False),
        ("you dimwit", False),
        ('"you dimwit"', True),
        ('a 5" pipe and "you dimwit" there', True),
        ("“" + "word " * 30 + "dimwit" + " word" * 30 + "”", True),
        ("„du “so” dimwit“", True),
        ("„du dimwit“ und «du»", True),
        ("« un dimwit » là", True),
        ("‘you don’t, dimwit’ it was", True),
    ],
)
def test_only_hits_inside_one_quotation_are_discounted(text, quoted):
    model = toxicity.Scorer({"dimwit": 7.0}, -2.0)
    assert (model.score_all([text])[0] < 0.3) == quoted


def test_every_hit_adds_to_a_score():
    model = toxicity.Scorer({"dimwit": 0.8}, -2.0)
    scores = model.score_all([" ".join(["dimwit"] * n) for n in (1, 2, 3, 6, 9)])
    assert scores == sorted(set(scores))
    expected = [1 / (1 + math.exp(2.0 - 0.8 - sum(0.8 / 2**k for k in range(2, n + 1)))) for n in (1, 2, 3, 6, 9)]
    assert scores == pytest.approx(expected)


def test_verdicts_on_misspellings_need_the_automaton(judged, monkeypatch):
    docs, labels, truth = judged
    held = [i for i, _, x in truth if x and zlib.crc32(str(i).encode()) % 4 == 2]
    bent = docs.where(F.col("doc_id").isin(held)).withColumn("text", F.regexp_replace("text", "(?i)dimwit|nitwitted", "nitwittad"))
    bent = bent.where("text LIKE '%nitwittad%'").cache()
    model = toxicity.learn(docs, labels)
    assert bent.count() > 5 and {r.predicted for r in toxicity.score_toxicity(bent, model).collect()} == {1}
    blind = toxicity.Scorer({**model.words}, model.bias)
    blind.trie = toxicity.Trie([])
    assert {r.predicted for r in toxicity.score_toxicity(bent, blind).collect()} == {0}


def test_few_texts_of_a_batch_are_scored_at_once(spark):
    class Counting(toxicity.Scorer):
        def score_all(self, texts):
            return [float(len(texts))] * len(texts)

    docs = spark.range(1, 1001, numPartitions=1).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a b").alias("text"))
    scored = toxicity.score_toxicity(docs, Counting({}, -2.0)).agg(F.count("*").alias("n"), F.max("score").alias("most")).first()
    assert scored["n"] == 1000 and scored["most"] <= 200


def test_nothing_is_learned_without_toxic_labels(judged):
    docs, labels, _ = judged
    model = toxicity.learn(docs, labels.where("toxic = 0"))
    assert {r.predicted for r in toxicity.score_toxicity(docs, model).collect()} == {0}
    assert toxicity.civil_rows(docs.where("false"), labels).count() == 0


def test_civil_rows_keep_columns_that_clash(judged):
    docs, labels, _ = judged
    docs = docs.select("*", F.lit(5).alias("predicted"), F.lit("x").alias("score"), F.lit(1).alias("k0"), F.lit("t").alias("_text"))
    kept = toxicity.civil_rows(docs, labels)
    assert kept.columns == docs.columns
    assert kept.where("doc_id = 904").count() == 0 and kept.where("doc_id = 901").count() == 1


# Mixing ------------------------------------------------------------------------------------------------------------


def test_targets_are_shared_and_capped():
    shares = mixing.share_targets([10, 100, 1000], [5, 2, 1])
    assert shares[0] == 30 and sum(shares) == pytest.approx(1110)
    assert all(t <= 3 * s for t, s in zip(shares, [10, 100, 1000], strict=True))
    assert mixing.share_targets([], []) == []


def test_knapsack_is_exact():
    rng = random.Random(2)
    for _ in range(60):
        lengths = rng.sample(range(1, 40), rng.randint(1, 6))
        counts = [rng.randint(1, 4) for _ in lengths]
        budget = rng.randint(1, 120)
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        taken = mixing.knapsack(lengths, counts, budget)
        assert all(k <= counts[lengths.index(n)] for n, k in taken.items())
        assert sum(n * k for n, k in taken.items()) == max(s for s in sums if s <= budget)


def test_budgets_beyond_the_table_are_met():
    assert mixing.fit_budget([380_000, 380_001], [1, 1], 400_000) == [0, 1]
    assert mixing.fit_budget([700_000, 900_000, 30], [1, 1, 9], 1_000_000) == [0, 1, 9]
    rng = random.Random(3)
    for _ in range(30):
        sizes = rng.sample(range(200_000, 2_000_000), 4)
        taken = mixing.fit_budget(sizes, [1] * 4, 2_100_000)
        spent = sum(n * k for n, k in zip(sizes, taken, strict=True))
        assert spent <= 2_100_000 and all(spent + n > 2_100_000 for n, k in zip(sizes, taken, strict=True) if not k)


def test_mix_meets_targets(docs, rows):
    plan = mixing.plan_repeats(docs, mixing.word_count(F.col("text"))).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(blank_words(t))
    names = sorted((s for s in sizes if s is not None)) + [None]
    targets = dict(zip(names, mixing.share_targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    of = {i: (len(blank_words(t)), s) for i, t, s in rows}
    taken = Counter()
    for r in plan:
        size, source = of[r.doc_id]
        assert r["size"] == size and r.source_size == sizes[source] and r.target == pytest.approx(targets[source])
        assert r.taken == r.repeats * size <= 3 * size
        taken[source] += r.taken
    for s in names:
        assert abs(taken[s] - targets[s]) <= max(len(blank_words(t)) for _, t, z in rows if z == s)
    again = {r.doc_id: r.taken for r in mixing.plan_repeats(docs, mixing.word_count(F.col("text"))).collect()}
    assert again == {r.doc_id: r.taken for r in plan}


def test_mixed_rows_and_hot_lengths(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    rows = [(None if i % 3 == 0 else 5, "a b c", "hot") for i in range(90)] + [(1000, "w " * 500, "z")]
    mixed = mixing.mix_rows(make(spark, rows))
    assert mixed.columns == make(spark, rows).columns
    n = mixed.where("source = 'hot'").count()
    assert abs(3 * n - mixing.share_targets([270, 500], [5, 2])[0]) <= 3
    assert mixing.mix_rows(make(spark, rows).where("false")).count() == 0
    plan = mixing.plan_repeats(make(spark, rows), mixing.word_count(F.col("text"))).collect()
    assert mixed.count() == sum(r.repeats for r in plan) and n == sum(r.repeats for r in plan if r["size"] == 3)


def test_equal_rows_are_taken_in_portions(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    rows = [(7, "a b c", "hot")] * 50 + [(8, None, "hot"), (9, "", None)] + [(i, "w " * 11, "z") for i in range(100, 120)]
    docs = make(spark, rows).withColumn("_copies", F.lit(3)).withColumn("_more", F.lit(4))
    mixed = mixing.mix_rows(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in mixing.plan_repeats(docs, mixing.word_count(F.col("text"))).collect():
        want[r.doc_id] += r.repeats
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: v for k, v in want.items() if v})


# Near duplicates ---------------------------------------------------------------------------------------------------


def brute_components(rows, percent, size):
    sets = {}
    for i, t, _ in rows:
        w = blank_words(lower(t))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize(("percent", "size"), [(85, 3), (80, 5)])
def test_near_duplicates_match_brute_force(docs, rows, percent, size):
    got = {r.doc_id: tuple(r)[1:] for r in near_duplicates.near_duplicates(docs, percent, size).collect()}
    assert got == brute_components(rows, percent, size)


def test_blocks_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(near_duplicates, "CLUSTER_BLOCK", 8)
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(120)] = f"n{rng.randrange(10_000)}"
        rows.append((i, " ".join(w), "s"))
    got = {r.doc_id: tuple(r)[1:] for r in near_duplicates.near_duplicates(make(spark, rows), 85, 3).collect()}
    assert got == brute_components(rows, 85, 3)


def test_near_duplicates_with_null_and_repeated_ids(spark):
    rows = [(None, "a b c d", "s"), (3, "a b c d", "s"), (3, "a b c d", "s"), (1, "A B c d", "s"), (9, None, "s")]
    got = Counter(tuple(r) for r in near_duplicates.near_duplicates(make(spark, rows), 85, 3).collect())
    assert got == Counter({(None, 2, None, True): 1, (3, 2, 1, False): 2, (1, 2, 1, True): 1, (9, 0, 9, True): 1})
    kept = near_duplicates.distinct_rows(make(spark, rows), percent=85, size=3)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 9]
    assert kept.columns == make(spark, rows).columns
    assert near_duplicates.near_duplicates(make(spark, rows).where("false")).count() == 0


def test_distinct_rows_are_the_kept_ones(spark, docs, rows):
    kept = near_duplicates.near_duplicates(docs, 80, 5).where("kept")
    least = near_duplicates.distinct_rows(docs, percent=80, size=5)
    assert sorted(r.doc_id for r in least.collect()) == sorted(r.doc_id for r in kept.collect())
    assert least.count() < docs.count() and near_duplicates.distinct_rows(docs.where("false")).count() == 0
    one = "one two three four five six"
    rows = [(7, one, "s"), (7, one.upper(), "s"), (None, one, "s"), (9, one + " seven", "s")]
    got = near_duplicates.distinct_rows(make(spark, rows), percent=60, size=3).collect()
    assert len(got) == 1 and got[0].doc_id == 7


@pytest.mark.parametrize("small", [0, 1000])
def test_components_of_a_long_chain(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components.components(edges.where("false")).count() == 0


# Lines -------------------------------------------------------------------------------------------------------------


def brute_lines(rows, min_words=lines.MIN_WORDS):
    earlier, out = [], {}

    def near(a, b):
        return min(len(a), len(b)) >= min_words and abs(len(a) - len(b)) < 2 and distance(a, b) <= 1

    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        kept, exact, close = [], 0, 0
        for line in (t or "").split("\n"):
            w = tuple(blank_words(lower(line)))
            if w and w in earlier:
                exact += 1
            elif w and any(near(w, v) for v in earlier):
                close += 1
            else:
                kept.append(line)
            if w and w not in earlier:
                earlier.append(w)
        out[i] = ((t or "").count("\n") + 1, exact, close, "\n".join(kept))
    return out


@pytest.mark.parametrize("min_words", [5, 2, 1])
def test_lines_match_brute_force(spark, min_words):
    rng = random.Random(8)
    base = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in [*range(1, 13), 2, 3, 4, 90, 200, 63, 64, 65]]
    rows = [(0, None, "s"), (1, "", "s"), (2, " \n\n", "s")]
    for i in range(3, 40):
        out = []
        for _ in range(rng.randint(1, 5)):
            w = rng.choice(base).split()
            k = rng.randrange(len(w))
            edit = rng.randrange(5)
            w = w[:k] + w[k + 1 :] if edit == 0 else w[:k] + ["new"] + w[k + (edit == 1) :] if edit < 3 else w
            out.append(" ".join(w) if edit != 4 else "\t ".join(w).upper() + "\r")
        rows.append((i, "\n".join(out), "s"))
    got = {r.doc_id: tuple(r)[1:] for r in lines.dedup_lines(make(spark, rows), min_words=min_words).collect()}
    assert got == brute_lines(rows, min_words)
    assert sum(v[2] for v in got.values()) > 0
    assert lines.dedup_lines(make(spark, rows).where("false")).count() == 0


def test_a_hot_line_and_a_very_long_one(spark, monkeypatch):
    monkeypatch.setattr(common, "SALT_SHARE", 4)
    rng = random.Random(12)
    long = [rng.choice(WORDS) for _ in range(5000)]
    hot = "the same line of words again"
    rows = [(i, f"{hot}\n{hot} {i}\nthe same {i} of words again", "s") for i in range(60)]
    rows += [(100, " ".join(long), "s"), (101, " ".join(long[:4000] + long[4001:]), "s"), (102, " ".join([*long[:9], "x", *long[9:]]), "s")]
    got = {r.doc_id: tuple(r)[1:] for r in lines.dedup_lines(make(spark, rows)).collect()}
    assert got == brute_lines([r for r in rows if r[0] < 100]) | {
        100: (1, 0, 0, " ".join(long)), 101: (1, 0, 1, ""), 102: (1, 0, 1, ""),
    }


def test_lines_with_null_and_repeated_ids(spark):
    text = "a line of five words\nsecond"
    rows = [(None, text, "s"), (4, text, "s"), (4, text, "s")]
    got = sorted((r.n_exact, r.kept_text) for r in lines.dedup_lines(make(spark, rows)).collect())
    assert got == [(0, text), (2, ""), (2, "")]


# Nearest neighbours ------------------------------------------------------------------------------------------------


def test_nearest_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=12).astype("float32").tolist()) for i in range(300)]
    rows += [(i + 1000, rows[i][1]) for i in range(40)]  # ties
    odd = [(2000, None), (2100, [0.0] * 12), (2200, [math.nan] + [1.0] * 11), (2300, [math.inf] * 12), (2400, [1.0] * 5), (None, [1.0] * 12), (2500, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in nearest.nearest(df, F.col("vec_id") % 50 == 0, k=7, tile=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    for q, x in rows:
        if q % 50 == 0:
            near = sorted((math.dist(x, y), i) for i, y in rows if i != q)[:7]
            assert [(k, i) for k, i, _ in got[q]] == [(k, i) for k, (_, i) in enumerate(near, 1)]
            assert [s for *_, s in got[q]] == pytest.approx([s for s, _ in near], rel=1e-12, abs=1e-12)
    assert 2400 not in got and 2100 not in got
    assert nearest.nearest(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_vectors_of_extreme_magnitude(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=4) * 10.0**e).tolist()) for e in (-170, -160, 0, 155, 160, 300) for i in range(abs(e) * 1000 + (e < 0) * 50, abs(e) * 1000 + (e < 0) * 50 + 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit("x")).withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in nearest.nearest(df, F.lit(True), k=5, tile=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q, x in rows:
        near = sorted((math.dist(x, y), i) for i, y in rows if i != q)[:5]
        assert [i for i, _ in got[q]] == [i for _, i in near], q
        assert [s for _, s in got[q]] == pytest.approx([s for s, _ in near], rel=1e-12, abs=0)


def test_few_candidates_are_all_returned(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in nearest.nearest(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1.0)]


# Decontamination ---------------------------------------------------------------------------------------------------


def brute_contamination(rows, items, window):
    grams = defaultdict(set)
    for k, t in items:
        w = term_words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[i : i + n])].add("" if k is None else str(k))
    out = {}
    for i, t, _ in rows:
        w, hit, found = term_words(t), set(), set()
        for n in {len(g) for g in grams}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in grams:
                    hit.update(range(p, p + n))
                    found |= grams[tuple(w[p : p + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[i] = (len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_contamination_matches_brute_force(spark, docs, rows):
    texts = [t for _, t, _ in rows if t and len(term_words(t)) > 30]
    items = [(1, " ".join(texts[0].split()[3:24])), (2, texts[1][:160].upper()), (10, "one two"), (11, None), (12, "..."), (None, texts[2][30:200]), (13, "never seen here"), (1, " ".join(texts[3].split()[:15]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(docs, benchmark).collect()}
    expected = brute_contamination(rows, items, 13)
    assert got == expected
    assert any(e[4] for e in expected.values())
    clean = decontaminate.clean_rows(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, e in expected.items() if not e[4])


def test_clean_rows_of_other_columns_and_shares(spark):
    text = " ".join(f"w{i}" for i in range(14))
    benchmark = spark.createDataFrame([(5, text)], "item_id long, text string")
    rows = [(1, text), (1, text), (None, text + " tail"), (2, text + " x" * 26), (3, "alpha"), (4, None)]
    docs = spark.createDataFrame(rows, "nr long, body string")
    kept = decontaminate.clean_rows(docs, benchmark.withColumnRenamed("text", "body"), key="nr", text="body", share=2)
    assert sorted(r.nr for r in kept.collect()) == [2, 3, 4]
    kept = decontaminate.clean_rows(docs, benchmark.withColumnRenamed("text", "body"), key="nr", text="body", slop=2)
    assert sorted(r.nr for r in kept.collect()) == [3, 4]


def test_contamination_without_broadcasts_and_with_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    rows = [(1, text, "s"), (1, text, "s"), (None, text + " tail", "s"), (2, "alpha", "s")]
    benchmark = spark.createDataFrame([(5, text)], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.n_hit) for r in decontaminate.contamination(make(spark, rows), benchmark).collect())
    assert got == [(0, 14), (1, 14), (1, 14), (2, 0)]
    assert decontaminate.contamination(make(spark, rows).where("false"), benchmark).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(make(spark, rows), benchmark.where("false")).collect()} == {0}


def test_proximity_matches(spark):
    item = "rare1 common rare2 common common"
    benchmark = spark.createDataFrame([(5, item)], "item_id long, text string")
    rows = [(1, "rare1 x common rare2 common common", "s"), (2, item, "s"), (3, "rare1 a b c d e f g h i rare2", "s")]
    got = {r.doc_id: (r.n_items, r.n_near_items) for r in decontaminate.contamination(make(spark, rows), benchmark).collect()}
    assert got[1] == (0, 1) and got[2][0] == 1 and got[3] == (0, 0)


# Sharding ----------------------------------------------------------------------------------------------------------


def check_shards(rows, got, shards):
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    loads = Counter()
    for r in got:
        loads[r.shard] += r["size"]
    total = sum(loads.values())
    widest = max(r["size"] for r in got)
    assert all(abs(loads[s] - total / shards) <= widest for s in range(shards))
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_shards_are_contiguous_and_balanced(docs, rows):
    got = sharding.shard_by_bytes(docs, 8)
    got = got.collect()
    check_shards(rows, got, 8)
    text = {i: t for i, t, _ in rows}
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    in_order = [r.shard for r in sorted(got, key=lambda r: r.doc_id)]
    assert in_order == sorted(in_order)


def test_shards_of_one_hot_key(spark):
    rows = [(None if i % 2 else 3, "x" * 9, "s") for i in range(200)]
    check_shards(rows, sharding.shard_by_bytes(make(spark, rows), 8, keep=["_h", "lang"]).collect(), 8)
    assert sharding.shard_by_bytes(make(spark, rows).where("false"), 8).count() == 0


# Licences ----------------------------------------------------------------------------------------------------------


def brute_licences(text):
    """Every pattern tried at every place: base starts, base labels, all labels, best share."""
    w, starts, base, found, best = term_words(text), [], set(), set(), 0.0
    for t, p in enumerate(licenses.patterns()):
        for at in range(-len(p.words), len(w)):
            fits = {o for o, word in enumerate(p.words) if 0 <= at + o < len(w) and w[at + o] == word}
            if len(fits) >= p.need and p.must <= fits:
                found.add(p.label)
                best = max(best, len(fits) / len(p.words))
                if t < len(licenses.BASE_PHRASES):
                    starts.append(at)
                    base.add(p.label)
    ends = (min(starts), max(starts)) if starts else (None, None)
    return len(w), len(starts), *ends, ",".join(sorted(base)), ",".join(sorted(found)), best


def test_licences_match_brute_force(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    rows = [
        (0, None, "s"), (1, "", "s"), (2, "Released under the MIT License. MIT-License mit license", "s"),
        (3, "Licensed under the Apache License, Version 2.0.", "s"), (4, "The mitlicense of x", "s"),
        (5, "This work is licensed under the GNU General Public License, version 3. ÄPACHE LICENSE", "s"),
        (6, "general public of license", "s"), (7, "word " * 500 + "APACHE license", "s"), (8, "All rights reserved.", "s"),
        (2, "Released under the MIT License. MIT-License mit license", "s"), (2, "another text of the same id", "s"),
        (9, "licensed under an Apache License version 2 0", "s"),
        (10, "This work is licensed under the GNU General Public License, version 2", "s"),
        (11, "released under the old license. see mit license elsewhere", "s"),
        (12, "Licensed under the Apache License, Version 1.0.", "s"), (13, "licensed under CC BY 3.0", "s"), (14, "Licensed under CC BY-NC 4.0.", "s"),
        (15, "x " * 9 + mit + " y" * 9, "s"), (16, mit.replace("free of", "gratis of").replace("any", "each"), "s"),
        (17, mit.replace("hereby", ""), "s"), (18, mit[:120], "s"),
        (19, "// SPDX-License-Identifier: GPL-2.0-or-later", "s"), (20, "the mit license\n" * 400, "s"),
    ]
    rng = random.Random(13)
    every = [p.words for p in licenses.patterns()]
    for i in range(30, 90):  # damaged sentences among licence words
        w = [rng.choice(rng.choice(every)) for _ in range(rng.randrange(20))]
        for _ in range(rng.randint(1, 3)):
            part = list(rng.choice(every))
            for _ in range(rng.randrange(5)):
                k = rng.randrange(len(part))
                part[k : k + 1] = rng.choice([["zzz"], [], ["the", part[k]], [rng.choice(rng.choice(every))]])
                part = part or ["x"]
            w += part
        rows.append((i, " ".join(w), "s"))
    got = licenses.scan_licenses(make(spark, rows)).collect()
    assert sorted((r.doc_id, *tuple(r)[1:]) for r in got if r.doc_id != 2) == sorted((i, *brute_licences(t)) for i, t, _ in rows if i != 2)
    assert Counter(tuple(r)[1:] for r in got if r.doc_id == 2) == Counter(brute_licences(t) for i, t, _ in rows if i == 2)
    by_id = {r.doc_id: r for r in got}
    assert by_id[10].labels == "gpl,notice:gpl-2.0" and by_id[11].labels == "mit" and by_id[12].labels == "apache" and by_id[13].labels == ""
    assert by_id[5].labels == "gpl,notice:gpl-3.0" and by_id[16].labels == by_id[15].labels == "text:mit" and by_id[17].labels == ""
    assert licenses.scan_licenses(make(spark, rows).where("false")).count() == 0


def test_licences_without_broadcasts_and_with_null_ids(spark, monkeypatch):
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 0)
    rows = [(None, "all rights reserved", "s"), (None, "All Rights Reserved", "s"), (None, None, "s"), (4, "mit license", "s")]
    got = Counter((r.doc_id, r.n_base, r.labels, r.score) for r in licenses.scan_licenses(make(spark, rows)).collect())
    assert got == Counter({(None, 0, "notice:all-rights-reserved", 1.0): 2, (None, 0, "", 0.0): 1, (4, 1, "mit", 1.0): 1})


# Revisits ----------------------------------------------------------------------------------------------------------

RECORD = "record_id long, uri string, ts long, kind string, etag string, last_modified string, headers map<string,string>, payload string, found int, cell string"


def test_revisits_match_brute_force(spark):
    rng = random.Random(6)
    records = []
    for i in range(300):
        url = f"http://WWW.Ex{rng.choice('aaaab')}.org/p{rng.randrange(2)}" + rng.choice(["", "/", "#x", "?utm_source=f", "?q=1&ref=z"])
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        headers = {"date": str(i), "content-type": kind, "etag": f"e{i}"} if rng.random() < 0.9 else None
        records.append((i, url if i % 29 else None, rng.randrange(60) if i % 31 else None, kind, rng.choice(["a", "b", None]), None, headers, f"body{i}", 1, "c"))
    df = spark.createDataFrame(records, RECORD)
    keys = {r.record_id: r.k for r in df.select("record_id", revisits.canonical_url(F.col("uri")).alias("k")).collect()}
    got = {r.record_id: r for r in revisits.resolve_revisits(df).collect()}
    by_id = {r[0]: r for r in records}
    assert sorted(got) == [r[0] for r in records if r[3] == "revisit"]
    for i, r in got.items():
        own = by_id[i]
        before = [x for x in records if x[3] == "response" and x[1] and x[2] is not None and own[1] and own[2] is not None and keys[x[0]] == keys[i] and x[2] < own[2]]
        best = max(before, key=lambda x: (x[2], x[0]), default=None)
        assert r.resolved_id == (best and best[0])
        if best is None:
            assert r.status == "orphan" and r.payload is None
        elif own[4] and best[4] and own[4] != best[4]:
            assert r.status == "stale" and r.headers is None
        else:
            assert r.status == "resolved" and r.payload == best[7]
            expected = dict(best[6] or {})
            expected.update({k: v for k, v in (own[6] or {}).items() if k in revisits.PERMITTED})
            assert r.headers == expected
    assert revisits.resolve_revisits(df.where("false")).count() == 0


def test_weak_etags_and_repeated_record_ids(spark, monkeypatch):
    monkeypatch.setattr(common, "SALT_SHARE", 2)
    rows = [(1, "http://a.b/", 5, "response", 'W/"x"', None, {"date": "1"}, body, 0, "c") for body in ("old", "zoo", "")]
    rows += [(1, "http://a.b/other", 6, "response", "q", None, None, "else", 0, "c")]
    rows += [(i, "http://a.b", 9, "revisit", tag, None, None, None, 0, "c") for i, tag in ((10, '"x"'), (11, "w/\"x\""), (12, None), (13, '"y"'), (10, '"x"'))]
    got = sorted((r.record_id, r.status, r.payload) for r in revisits.resolve_revisits(spark.createDataFrame(rows, RECORD)).collect())
    assert got == [(10, "resolved", "zoo"), (10, "resolved", "zoo"), (11, "resolved", "zoo"), (12, "resolved", "zoo"), (13, "stale", None)]


def test_canonical_urls(spark):
    urls = ["https://www.A.com:443/x/?b=2&utm_id=1&a=1#f", "HTTP://a.com", "no url", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(revisits.canonical_url(F.col("u"))).collect()] == ["a.com/x?a=1&b=2", "a.com", "no url", None]
