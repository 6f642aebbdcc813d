"""Licence scans with a positional rare-token index.

Method: every file is reduced to the licence words it holds, which gives their document frequencies over the
whole corpus. A file is looked up by its own highest-IDF licence words: for each template that it may hold, the
rarest ones of which at least one must stand in place. Postings of the template's words are intersected by relative
position around those; a template counts where enough of its words stand at their places, one of the rare words
among them, and its mandatory key phrases stand word for word at theirs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import maybe_broadcast, terms
from spindrift.llm.licence_texts import BASE_PHRASES, TEMPLATES
from spindrift.session import durable

#: Share of a template's words that must stand at their places; of a base phrase all must.
MATCH_SHARE = 0.8
#: At most so many opened files are told to the scan by broadcast; more are matched by a shuffle.
BROADCAST_ROWS = 50_000


class Pattern:
    """A sentence to be found: its words, the places that are mandatory, and how many places must agree."""

    def __init__(self, sentence: str, label: str, phrases: tuple[str, ...], share: float):
        self.words, self.label = sentence.split(), label
        self.must: set[int] = set()
        for phrase in phrases:
            part = phrase.split()
            at = next(i for i in range(len(self.words)) if self.words[i : i + len(part)] == part)
            self.must.update(range(at, at + len(part)))
        self.need = max(1, math.ceil(share * len(self.words) - 1e-9))
        self.spare = len(self.words) - self.need


def patterns() -> list[Pattern]:
    """Base phrases first, then the templates. At most 63 words each: places are bits of a long."""
    base = [Pattern(p, label, (p,), 1.0) for p, label in BASE_PHRASES]
    return base + [Pattern(s, label, phrases, MATCH_SHARE) for s, label, phrases in TEMPLATES]


def _text_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def scan_licenses(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts all places where a base phrase stands; ``first_word`` and ``last_word`` are the smallest and
    largest start. ``labels`` adds those of the templates. ``score`` is the largest share of a pattern's words
    found in place where the pattern counts (1 for a base phrase, 0 for none). Null, empty and blank texts have no
    words, no labels and a score of 0; texts are read whole, however long. Rows that repeat key and text get the same
    result each; rows of one key and different texts are told apart; an empty table gives none. Labels of equal share
    are all given. Other columns are not used, so their names cannot clash.
    """
    spark, known = documents.sparkSession, patterns()
    vocabulary = sorted({w for p in known for w in p.words})
    row = F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit("")))
    files = documents.select(F.col(key), row.alias("_h"), terms(F.col(text)).alias("_w"))
    held = F.array_intersect("_w", _text_array(vocabulary))
    index = durable(files.select(key, "_h", F.size("_w").cast("long").alias("n_words"), held.alias("_held")))

    counts = {r["w"]: r["n"] for r in index.select(F.explode("_held").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    entrance = sorted({min((p.words[o] for o in p.must), key=lambda w: (counts.get(w, 0), w)) for p in known})
    possible = F.array(*[
        F.struct(
            F.lit(t).alias("t"), _text_array(sorted(set(p.words))).alias("words"), _text_array(sorted({p.words[o] for o in p.must})).alias("must"),
            F.lit(len(set(p.words)) - p.spare).alias("least"), F.lit(p.spare + 1).alias("keys"),
        )
        for t, p in enumerate(known)
    ])
    may_hold = F.filter(
        possible,
        lambda p: (F.size(F.array_except(p["must"], F.col("_held"))) == 0)
        & (F.size(F.array_intersect(F.col("_held"), p["words"])) >= p["least"]),
    )
    rarity = F.create_map(*[x for w in vocabulary for x in (F.lit(w), F.lit(counts.get(w, 0)))])
    ranked = F.transform(F.array_sort(F.transform("_held", lambda w: F.struct(F.element_at(rarity, w).alias("n"), w.alias("w")))), lambda x: x["w"])
    looked_up = F.transform(
        "_may", lambda p: F.struct(p["t"].alias("t"), F.slice(F.array_intersect(F.col("_ranked"), p["words"]), 1, p["keys"]).alias("keys"))
    )
    opened = (
        index.where(F.arrays_overlap("_held", _text_array(entrance)))
        .select(F.col(key).alias("_k"), F.col("_h").alias("_kh"), "_held", may_hold.alias("_may"))
        .where(F.size("_may") > 0)
        .dropDuplicates(["_kh"])
        .select("_k", "_kh", "_may", ranked.alias("_ranked"))
        .select("_k", "_kh", looked_up.alias("_plan"))
    )
    opened = maybe_broadcast(durable(opened), rows=BROADCAST_ROWS)
    same = (F.col("_h") == F.col("_kh")) & F.col(key).eqNullSafe(F.col("_k"))

    cells = ", ".join(f"({t}, {o}, '{w}')" for t, p in enumerate(known) for o, w in enumerate(p.words))
    places = spark.sql(f"SELECT * FROM VALUES {cells} AS p(_t, _o, _word)")  # fixed, under a thousand short rows
    rules = ", ".join(
        f"({t}, {p.need}, {sum(1 << o for o in p.must)}L, {len(p.words)}, '{p.label}', {t < len(BASE_PHRASES)})" for t, p in enumerate(known)
    )
    rules = spark.sql(f"SELECT * FROM VALUES {rules} AS r(_t, _need, _must, _m, _label, _base)")
    postings = (
        documents.select(F.col(key), row.alias("_h"), F.col(text).alias("_text"))
        .join(opened, same)
        .select(key, "_h", "_plan", F.posexplode_outer(terms(F.col("_text"))).alias("_pos", "_word"))
        .where(F.col("_word").isin(vocabulary))
    )
    own = F.filter("_plan", lambda p: p["t"] == F.col("_t"))
    placed = (
        postings.join(F.broadcast(places), "_word")
        .withColumn("_own", own)
        .where(F.size("_own") > 0)
        .groupBy(key, "_h", "_t", (F.col("_pos") - F.col("_o")).alias("_start"))
        .agg(
            F.bit_or(F.expr("shiftleft(1L, _o)")).alias("_bits"),
            F.max(F.array_contains(F.col("_own")[0]["keys"], F.col("_word")).cast("int")).alias("_rare"),
        )
        .where("_rare = 1")
        .join(F.broadcast(rules), "_t")
        .where("bit_count(_bits) >= _need AND (_bits & _must) = _must")
    )
    hits = placed.groupBy(key, "_h").agg(
        F.count(F.when(F.col("_base"), 1)).alias("_n"),
        F.min(F.when(F.col("_base"), F.col("_start"))).alias("_first"),
        F.max(F.when(F.col("_base"), F.col("_start"))).alias("_last"),
        F.collect_set(F.when(F.col("_base"), F.col("_label"))).alias("_bl"),
        F.collect_set("_label").alias("_all"),
        F.max(F.expr("bit_count(_bits) / _m")).alias("_score"),
    )  # at most one label for each pattern
    hits = hits.withColumnRenamed(key, "_k").withColumnRenamed("_h", "_kh")
    none = F.array().cast("array<string>")
    joined = index.drop("_held").join(hits, same, "left")
    return joined.select(
        key,
        "n_words",
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_base"),
        F.col("_first").cast("long").alias("first_word"),
        F.col("_last").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.coalesce("_bl", none)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.coalesce("_all", none)), ",").alias("labels"),
        F.coalesce("_score", F.lit(0.0)).alias("score"),
    )
