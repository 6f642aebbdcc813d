"""Benchmark decontamination with a distributed positional inverted index.

Method: the rarest terms of every benchmark window are looked up in the training texts, giving postings
(document, term, position) over the whole corpus. Document frequencies of those postings pick the two rarest
terms of each window; their lists are shifted by the terms' places in the item and intersected. Equal shifts are
checked word by word against the item; shifts that differ by at most ``slop`` are proximity matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import maybe_broadcast, terms
from spindrift.session import durable

#: Terms are first tested against a table of this many bits, whatever the size of the benchmark.
FILTER_BITS = 1 << 16
#: Terms kept for each window before the corpus counts choose between them.
RARE_TERMS = 3
#: A side is broadcast only if it has at most so many rows, and its bytes are few too; else it is shuffled.
BROADCAST_ROWS = 50_000


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return maybe_broadcast(df, rows=BROADCAST_ROWS)


def _row_hash(key: Column, text: Column) -> Column:
    """The same for rows that repeat key and text, and only for those (but for chance)."""
    return F.xxhash64(key, F.coalesce(text, F.lit("")))


def _slot(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FILTER_BITS)).cast("int")


def _items(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """One row for each different (item, text) that has words: _i, _item, _words, _w (its window length)."""
    found = (
        benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("_item"), terms(F.col(text)).alias("_words"))
        .where(F.size("_words") > 0)
        .distinct()
    )
    return found.select(
        F.xxhash64("_item", "_words").alias("_i"), "_item", "_words", F.least(F.lit(window), F.size("_words")).alias("_w")
    )


def _window_terms(items: DataFrame) -> DataFrame:
    """For every window its RARE_TERMS rarest terms within the benchmark: _i, _start, _p (place in the item), _term."""
    placed = items.select("_i", "_w", F.size("_words").alias("_n"), F.posexplode("_words").alias("_p", "_term"))
    rarity = placed.groupBy("_term").agg(F.count("*").alias("_own"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("_p") - F.col("_w") + 1), F.least(F.col("_p"), F.col("_n") - F.col("_w")))
    rank = Window.partitionBy("_i", "_start").orderBy("_own", F.length("_term").desc(), "_term", "_p")
    return (
        placed.join(rarity, "_term")
        .withColumn("_start", F.explode(starts))
        .withColumn("_rank", F.row_number().over(rank))
        .where(F.col("_rank") <= RARE_TERMS)
        .select("_i", "_start", "_p", "_term")
    )


def find_passages(
    documents: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    window: int = 13,
    slop: int = 3,
) -> dict[str, DataFrame]:
    """Every occurrence of a benchmark window in the documents.

    Returns ``words`` (one row a document: key, _h, n_words), ``exact`` (key, _h, item, word positions covered)
    and ``near`` (key, _h, item: the item's rarest terms stand within slop words of their places). ``_h`` is a
    hash of key and text: rows that repeat both share their matches. Without slop nothing is near. Null, empty or blank texts have no words and
    match nothing; an item of fewer words than the window is one window; items without words are left out, and a
    null item id counts as an empty one. Texts are read whole, however long; an empty table on either side matches
    nothing. Other columns of documents are not used, so their names cannot clash.
    """
    items = durable(_items(benchmark, item, text, window))
    choices = durable(_window_terms(items))
    vocabulary = choices.select("_term").distinct()
    slots = [r[0] for r in vocabulary.select(_slot(F.col("_term"))).distinct().collect()]  # FILTER_BITS rows at most
    table = [0] * (FILTER_BITS // 64)
    for slot in slots:
        table[slot // 64] |= 1 << (slot % 64)
    mask = F.array(*[F.lit(x - (1 << 64) if x >> 63 else x).cast("long") for x in table])

    slot = _slot(F.col("_term"))
    listed = F.getbit(F.get(mask, F.shiftright(slot, 6)), slot.bitwiseAND(63)) == 1
    first_word = F.coalesce("_pos", F.lit(0)) == 0  # kept for every document: it tells the number of words
    scanned = (
        documents.select(F.col(key), _row_hash(F.col(key), F.col(text)).alias("_h"), terms(F.col(text)).alias("_t"))
        .select(key, "_h", F.size("_t").cast("long").alias("n_words"), F.posexplode_outer("_t").alias("_pos", "_term"))
        .where(first_word | listed)
    )
    scanned = durable(scanned)
    words = scanned.where(first_word).select(key, "_h", "n_words")
    postings = scanned.select(key, "_h", "_pos", "_term").join(_maybe_broadcast(vocabulary), "_term").dropDuplicates(["_h", "_pos"])
    postings = durable(postings)

    frequency = postings.groupBy("_term").agg(F.count("*").alias("_df"))
    ranked = Window.partitionBy("_i", "_start").orderBy(F.coalesce("_df", F.lit(0)), "_term", "_p")
    pairs = (
        choices.join(frequency, "_term", "left")
        .withColumn("_rank", F.row_number().over(ranked))
        .groupBy("_i", "_start")
        .agg(
            F.max(F.when(F.col("_rank") == 1, F.struct("_p", "_term"))).alias("_a"),
            F.max(F.when(F.col("_rank") == 2, F.struct("_p", "_term"))).alias("_b"),
        )
        .select(
            "_i",
            F.col("_a._p").alias("_pa"),
            F.col("_a._term").alias("_ta"),
            F.coalesce("_b._p", "_a._p").alias("_pb"),
            F.coalesce("_b._term", "_a._term").alias("_tb"),
        )
        .distinct()
    )
    pairs = durable(pairs)

    def shifted(place: str, term: str, name: str) -> DataFrame:
        side = pairs.select("_i", "_pa", "_pb", F.col(place).alias("_p"), F.col(term).alias("_term"))
        return postings.join(_maybe_broadcast(side), "_term").select(
            key, "_h", "_i", "_pa", "_pb", (F.col("_pos") - F.col("_p")).alias(name)
        )

    step = F.lit(slop + 1)
    cells = [F.floor(F.col("_da") / step) + d for d in ((-1, 0, 1) if slop else (0,))]
    first = shifted("_pa", "_ta", "_da").withColumn("_cell", F.explode(F.array(*cells)))
    second = shifted("_pb", "_tb", "_db").withColumn("_cell", F.floor(F.col("_db") / step))
    on = ["_h", "_i", "_pa", "_pb", "_cell"]
    met = (
        first.withColumnRenamed(key, "_k")
        .join(second.withColumnRenamed(key, "_k2"), on)
        .where(F.col("_k").eqNullSafe(F.col("_k2")) & (F.abs(F.col("_da") - F.col("_db")) <= slop))
        .select(F.col("_k").alias(key), "_h", "_i", F.col("_da").alias("_d"), (F.col("_da") == F.col("_db")).alias("_same"))
        .distinct()
    )
    met = durable(met)
    aligned = met.where("_same").join(_maybe_broadcast(items.select("_i", F.size("_words").alias("_n"))), "_i")
    wanted = aligned.groupBy(key, "_h").agg(F.collect_set(F.struct("_i", "_d", "_n")).alias("_c"))
    wanted = durable(wanted)

    small = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    keys = wanted.select(F.col(key).alias("_k"), F.col("_h").alias("_kh"))
    source = documents.select(F.col(key), _row_hash(F.col(key), F.col(text)).alias("_h"), F.col(text).alias("_text"))
    same = (F.col("_h") == F.col("_kh")) & F.col(key).eqNullSafe(F.col("_k"))
    if small:
        source = source.join(F.broadcast(keys), same, "left_semi")
    cut = lambda c: F.struct(
        c["_i"].alias("_i"),
        c["_d"].alias("_d"),
        F.slice(F.col("_t"), F.greatest(c["_d"], F.lit(0)) + 1, c["_n"] + F.least(c["_d"], F.lit(0))).alias("_seg"),
    )
    named = wanted.select(F.col(key).alias("_k"), F.col("_h").alias("_kh"), "_c")
    segments = (
        source.join(named, same)
        .select(key, "_h", terms(F.col("_text")).alias("_t"), "_c")
        .select(key, "_h", F.explode_outer(F.transform("_c", cut)).alias("_x"))
        .select(key, "_h", "_x.*")
    )
    skipped = F.greatest(-F.col("_d"), F.lit(0))
    equal = F.zip_with(
        F.col("_seg"), F.slice(F.col("_words"), skipped + 1, F.greatest(F.size("_seg"), F.lit(0))), lambda a, b: F.coalesce(a == b, F.lit(False))
    )
    starts = F.when(
        F.size("_eq") >= F.col("_w"),
        F.filter(
            F.sequence(F.lit(0), F.size("_eq") - F.col("_w")),
            lambda s: F.forall(F.slice(F.col("_eq"), s + 1, F.col("_w")), lambda x: x),
        ),
    )
    covered = F.array_distinct(
        F.flatten(F.transform("_s", lambda s: F.transform(F.sequence(F.lit(0), F.col("_w") - 1), lambda j: s + j + F.col("_d") + F.col("_skip"))))
    )
    exact = (
        segments.join(_maybe_broadcast(items), "_i")
        .withColumn("_skip", skipped)
        .withColumn("_eq", equal)
        .withColumn("_s", starts)
        .where(F.size("_s") > 0)
        .select(key, "_h", "_item", covered.alias("_covered"))
    )
    names = items.select("_i", "_item")
    near = met.where("NOT _same").join(_maybe_broadcast(names) if slop else names, "_i").select(key, "_h", "_item").distinct()
    return {"words": words, "exact": durable(exact), "near": near}


def _hit_words(exact: DataFrame, key: str) -> DataFrame:
    """_hit: how many words of each key and _h lie inside occurrences."""
    return exact.select(key, "_h", F.explode("_covered").alias("_p")).distinct().groupBy(key, "_h").agg(F.count("*").alias("_hit"))


def contamination(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", share: int = 20, **options) -> DataFrame:
    """One row a document: n_words, n_hit, n_items, items_sha256, n_near_items, contaminated.

    A word is hit if it lies inside an occurrence of a benchmark window; a document is contaminated where hit
    words are at least one in ``share``. An empty benchmark contaminates nothing, an empty documents table gives
    no rows, and null or blank texts have no words and are clean. Rows that repeat key and text get the same
    result each. ``_h`` comes along as a hash of key and text.
    """
    found = find_passages(documents, benchmark, key=key, **options)
    exact = found["exact"]
    hits = _hit_words(exact, key)
    names = exact.groupBy(key, "_h").agg(F.array_sort(F.collect_set("_item")).alias("_names"))
    near = found["near"].groupBy(key, "_h").agg(F.count("*").alias("_near"))
    out = found["words"]
    for side in (hits, names, near):
        side = side.withColumnRenamed(key, "_k").withColumnRenamed("_h", "_kh")
        same = (F.col("_h") == F.col("_kh")) & F.col(key).eqNullSafe(F.col("_k"))
        out = out.join(side, same, "left").drop("_k", "_kh")
    n_hit = F.coalesce("_hit", F.lit(0)).cast("long")
    names = F.coalesce("_names", F.array().cast("array<string>"))
    return out.select(
        key,
        "n_words",
        n_hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        F.coalesce("_near", F.lit(0)).cast("long").alias("n_near_items"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        "_h",
    )


def clean_rows(
    documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", share: int = 20, **options
) -> DataFrame:
    """The documents that are not contaminated, with their own columns, repeated rows as often as they come.

    Hit words alone decide, so that near matches and the names of items are not looked for.
    """
    found = find_passages(documents, benchmark, key=key, text=text, **options | {"slop": 0})
    hits = _hit_words(found["exact"], key).select(F.col(key).alias("_k"), F.col("_h").alias("_kh"), "_hit")
    same = (F.col("_h") == F.col("_kh")) & F.col(key).eqNullSafe(F.col("_k"))
    bad = found["words"].join(hits, same).where(share * F.col("_hit") >= F.col("n_words")).select("_k", "_kh")
    rows = documents.select(F.struct("*").alias("row"))
    own = _row_hash(F.col(f"row.{key}"), F.col(f"row.{text}"))
    same = F.col(f"row.{key}").eqNullSafe(F.col("_k")) & (own == F.col("_kh"))
    return rows.join(_maybe_broadcast(durable(bad)), same, "left_anti").select("row.*")
