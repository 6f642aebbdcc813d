"""Line deduplication by a deletion-neighbourhood join, within one word of edit distance.

Method: equal lines form classes. A class that shares its first or last half with another one emits all variants
within the bound as hashed keys: the line without its i-th word (for a substitution at i, and for a deletion), and
the line itself. Equal keys join; each key keeps only its earliest lines, so no pair list is made. The words of the
joined lines are compared, and a line falls to any earlier one within the bound.

Two lines within one edit share a half, so a class that shares none has no partner and emits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import ascii_lower, maybe_broadcast, salted_join
from spindrift.llm.suffixes import ordered_texts
from spindrift.session import durable

#: Lines of fewer words are only compared for equality: one edit would change too much of them. 1 compares all.
MIN_WORDS = 5
#: Place hashes are added modulo this, so that no sum leaves a long.
_SPAN = 1 << 61
#: Words whose hashes are added up one by one, a power of two; longer sums go by blocks of so many.
_BLOCK = 64


def _lines(texts: DataFrame, *more: str) -> DataFrame:
    """ord, more, and the lines of each text, lower-cased, with single blanks between words (one at an end may be left)."""
    odd = F.contains("text", F.lit("\t")) | F.contains("text", F.lit("\r")) | F.contains("text", F.lit("\x0b")) | F.contains("text", F.lit("\x0c"))
    wide = F.contains("text", F.lit("  "))
    flat = texts
    for text in (
        F.coalesce("text", F.lit("")),
        ascii_lower(F.col("text")),
        F.when(odd, F.translate("text", "\t\r\x0b\x0c", "    ")).otherwise(F.col("text")),
        F.when(wide, F.regexp_replace("text", " {2,}", " ")).otherwise(F.col("text")),
    ):
        flat = flat.select("ord", *more, text.alias("text"))
    return flat.select("ord", *more, F.split("text", "\n").alias("lines"))


def _half_keys(line: Column, n: Column) -> Column:
    """Keys of the halves, heads and tails in turn: two lines of n and m words within one edit share one of them.

    With b = n div 2 and b = (n + 1) div 2, such lines agree on a b, and in their first or in their last b words.
    """

    def pair(b: Column) -> list[Column]:
        first = F.call_function("substring_index", line, F.lit(" "), b)
        last = F.call_function("substring_index", line, F.lit(" "), -b)
        return [F.xxhash64(F.lit(1), b, first), F.xxhash64(F.lit(2), b, last)]

    low, high = F.expr("w div 2").cast("int"), F.expr("(w + 1) div 2").cast("int")
    return F.when(n % 2 == 0, F.array(*pair(low))).otherwise(F.array(*pair(low), *pair(high)))


def _keyed_lines(texts: DataFrame, min_words: int) -> DataFrame:
    """One row for each line with words: ord, ln, two hashes of its words (h, h2) and the keys of its halves (k)."""
    # no text is without lines; the outer form only keeps the optimiser from testing that, which would normalise twice
    lines = _lines(texts).select("ord", F.posexplode_outer("lines").alias("ln", "line"))
    lines = lines.select("ord", "ln", F.trim("line").alias("line")).where("line <> ''")
    count = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    lines = lines.select("ord", "ln", "line", count.cast("int").alias("w"))
    halves = F.when(F.col("w") >= min_words, _half_keys(F.col("line"), F.col("w")))
    return lines.select("ord", "ln", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("h2"), halves.alias("k"))


def _opened(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """The words of the earliest line of each class that shares a half: h, h2, first, head, tail, words."""
    halves = classes.where("k IS NOT NULL").select("h", "h2", F.posexplode("k").alias("place", "half"))
    halves = halves.select("h", "h2", "half", (F.col("place") % 2 == 0).alias("head"))
    shared = durable(halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1"))
    paired = salted_join(halves, shared, ["half"]).groupBy("h", "h2").agg(
        F.max("head").alias("head"), F.max(~F.col("head")).alias("tail")
    )
    paired = paired.join(classes.select("h", "h2", "first"), ["h", "h2"])
    wanted = F.struct(F.col("first.ln").alias("ln"), "h", "h2", "first", "head", "tail")
    told = durable(paired.groupBy(F.col("first.ord").alias("_o")).agg(F.collect_list(wanted).alias("wanted")))  # lines of one text
    rows = _lines(texts.join(maybe_broadcast(told), F.col("ord") == F.col("_o")), "wanted")
    line = lambda x: F.trim(F.element_at(F.col("lines"), x["ln"] + 1))
    rows = rows.select(F.explode_outer(F.transform("wanted", lambda x: F.struct(x.alias("x"), F.split(line(x), " ").alias("words")))).alias("y"))
    return durable(rows.select("y.x.h", "y.x.h2", "y.x.first", "y.x.head", "y.x.tail", "y.words"))


def _add(values: Column) -> Column:
    """Sum modulo _SPAN."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: F.pmod(s + x, F.lit(_SPAN)))


def _variants(opened: DataFrame) -> DataFrame:
    """The hashed keys of every opened line: h, h2, first, role (s: a word replaced, d: a word left out, w: whole), key.

    A line that only shares its head with others can only be edited behind it, and the other way round. The hash of
    a line is the sum of the hashes of its words at their places (a), so leaving one out is a subtraction; behind
    it the places move down by one, which adds their differences c. Those are summed by blocks.
    """
    at = lambda w, i: F.pmod(F.xxhash64(w, i), F.lit(_SPAN))
    rows = opened.select("*", F.size("words").alias("n"), F.sequence(F.lit(0), F.expr(f"(size(words) - 1) div {_BLOCK}").cast("int")).alias("q"))
    rows = rows.withColumn("a", F.transform("words", at))
    rows = rows.withColumn("c", F.transform("words", lambda w, i: F.pmod(at(w, i - 1) - F.get("a", i), F.lit(_SPAN))))
    rows = rows.withColumn("total", _add(F.col("a")))
    rows = rows.withColumn("sums", F.transform("q", lambda q: _add(F.slice(F.col("c"), q * _BLOCK + 1, F.lit(_BLOCK)))))
    rows = rows.withColumn("behind", F.transform("q", lambda q: _add(F.slice(F.col("sums"), q + 2, F.size("q")))))
    begin = F.when(F.col("tail"), F.lit(0)).otherwise(F.expr("n div 2").cast("int"))
    end = F.when(F.col("head"), F.col("n") - 1).otherwise(F.expr("(n - 1) div 2").cast("int"))
    rows = rows.withColumn("open", F.sequence(begin, end))

    def cut(i: Column) -> Column:
        block = F.shiftright(i, _BLOCK.bit_length() - 1)
        near = _add(F.slice(F.col("c"), i + 2, _BLOCK * (block + 1) - i - 1))
        return F.pmod(F.col("total") - F.get("a", i) + F.get("behind", block) + near, F.lit(_SPAN))

    role = lambda r, key: F.struct(F.lit(r).alias("role"), key.alias("key"))
    keys = F.concat(
        F.transform("open", lambda i: role("s", F.xxhash64(F.lit("s"), i, F.pmod(F.col("total") - F.get("a", i), F.lit(_SPAN))))),
        F.transform("open", lambda i: role("d", F.xxhash64(F.lit("d"), cut(i)))),
        F.array(role("w", F.xxhash64(F.lit("d"), F.col("total")))),
    )
    return rows.select("h", "h2", "first", F.explode_outer(keys).alias("v")).select("h", "h2", "first", "v.role", "v.key")


def _near_classes(opened: DataFrame) -> DataFrame:
    """(h, h2) of the classes that have an earlier line within the bound."""
    emitted = _variants(opened)
    equal = durable(emitted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    joined = durable(salted_join(emitted, equal, ["key"]))
    own = F.struct("first", "h", "h2")
    least = joined.groupBy("key").agg(F.count("*").alias("n"), *[F.min(F.when(F.col("role") == r, own)).alias(f"min_{r}") for r in "sdw"])
    partner = F.when(F.col("role") == "s", F.col("min_s")).when(F.col("role") == "d", F.col("min_w")).otherwise(F.col("min_d"))
    met = salted_join(joined, durable(least), ["key"]).withColumn("p", partner).where(F.col("p.first") < F.col("first"))
    met = durable(met.select("h", "h2", F.col("p.h").alias("ph"), F.col("p.h2").alias("ph2")).distinct())
    partners = met.groupBy("ph", "ph2").agg(F.count("*").alias("n"))
    other = opened.select(F.col("h").alias("ph"), F.col("h2").alias("ph2"), F.col("words").alias("pw"))
    mine = met.join(opened.select("h", "h2", "words"), ["h", "h2"])
    compared = salted_join(mine, durable(partners.join(other, ["ph", "ph2"])), ["ph", "ph2"])
    return compared.where(within_one_word(F.col("words"), F.col("pw"))).select("h", "h2").distinct()


def repeated_lines(texts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(ord, ln, near) for every line of (ord, text) that falls to an earlier line; blank lines never do."""
    keyed = durable(_keyed_lines(texts, min_words))  # a few hashes a line
    classes = durable(
        keyed.groupBy("h", "h2").agg(F.min(F.struct("ord", "ln")).alias("first"), F.count("*").alias("n"), F.first("k").alias("k"))
    )
    near = _near_classes(_opened(texts, classes)).withColumn("near", F.lit(True))
    verdict = classes.select("h", "h2", "first", "n").join(near, ["h", "h2"], "left").where("n > 1 OR near")
    judged = salted_join(keyed.select("ord", "ln", "h", "h2"), durable(verdict), ["h", "h2"])
    again = (F.col("ord") != F.col("first.ord")) | (F.col("ln") != F.col("first.ln"))
    return judged.where(again | F.col("near")).select("ord", "ln", (~again).alias("near"))


def within_one_word(a: Column, b: Column) -> Column:
    """Whether the word edit distance of two arrays is at most one, in one pass over each."""
    n, m = F.size(a), F.size(b)
    longer, shorter = F.when(n >= m, a).otherwise(b), F.when(n >= m, b).otherwise(a)
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda x: x))
    flags = F.zip_with(shorter, F.slice(longer, F.lit(1), F.size(shorter)), lambda x, y: x == y)
    cut = F.array_position(F.concat(flags, F.array(F.lit(False))), False).cast("int")
    tail = F.slice(longer, cut + 1, F.size(longer)) == F.slice(shorter, cut, F.size(shorter))
    return F.when(n == m, differ <= 1).otherwise((F.abs(n - m) == 1) & tail)


def dedup_lines(documents: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row a document: key, n_lines, n_exact, n_near and kept_text (its lines that are left, in order).

    A line falls if an earlier line (smaller id, or higher up) has the same words, or, where both have at least
    ``min_words`` words, words within one substitution, insertion or deletion of a word; A-Z are lower-cased and
    blanks separate. With ``min_words=1`` lines of every length take part. It falls whether or not that earlier line
    stays; of equal lines the first stays. Blank lines stay. A null or empty text is one blank line, an empty table
    gives no rows. Lines may be as long as a text may be. Rows of equal or null ids follow their place in the input
    (nulls first) and are judged each. Columns other than key and text are neither used nor returned, so their names
    cannot clash.
    """
    texts, keys = ordered_texts(documents, key, text)
    gone = repeated_lines(texts, min_words).groupBy("ord").agg(
        F.collect_list("ln").alias("gone"), F.count(F.when(F.col("near"), 1)).alias("n_near"), F.count("*").alias("n_gone")
    )  # a document's own lines: no more than it has
    whole = texts.select("ord", F.coalesce("text", F.lit("")).alias("text"))
    count = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform(left, lambda i: F.element_at(F.col("lines"), i + 1)), "\n")
    joined = whole.join(gone, "ord", "left").select("*", F.when(F.col("gone").isNotNull(), F.split("text", "\n")).alias("lines"))
    out = joined.select(
        "ord",
        count.cast("long").alias("n_lines"),
        (F.coalesce("n_gone", F.lit(0)) - F.coalesce("n_near", F.lit(0))).cast("long").alias("n_exact"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
    )
    names = ["n_lines", "n_exact", "n_near", "kept_text"]
    if keys is None:
        return out.select(F.col("ord").cast(dict(documents.dtypes)[key]).alias(key), *names)
    return keys.join(out, "ord").select(key, *names)
