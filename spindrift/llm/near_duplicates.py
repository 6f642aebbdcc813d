"""MinHash near-duplicates with sequential Bayesian verification.

Method: documents of equal shingle sets form classes. The class signatures are banded into buckets; members of a
bucket are compared in batches of hashes, and a pair is dropped once the posterior probability that its
similarity reaches the threshold is below the chosen miss probability. What survives joins classes into clusters;
in a cluster surviving pairs are verified exactly on the full shingle sets.

Only connections matter, so large buckets and clusters are cut into blocks: the first block meets every block, which
settles most members, and only those outside the largest part that is then connected meet all blocks. No pair list
is ever made, and no group meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import maybe_broadcast, salted_join
from spindrift.llm.components import components
from spindrift.session import durable, shuffle_width

HASHES, BATCH = 144, 36
#: Members of a block of a bucket, and of a cluster.
BUCKET_BLOCK, CLUSTER_BLOCK = 1024, 256
#: Posterior probability at which a pair may be dropped.
MISS = 1e-6

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3 | (0x5BD1E995 << 32)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE % 2**64, pow(_BASE, -1, 2**64))):
                steps = np.full(size, _U(base))
                steps[0] = 1
                _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def shingles(text: str | None, size: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased; none without words."""
    if not text:
        return np.empty(0, dtype=_U)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    blank = _BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, dtype=_U)
    power, inverse = _grow(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, dtype=_U)
        np.cumsum((raw.astype(_U) + _U(1)) * power[: len(raw)], out=total[1:])
        words = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U) * _STEP)
        count = min(size, len(words))
        out = words[: len(words) - count + 1] + _U(count)
        for k in range(1, count):
            out = mix(out * _U(0xD6E8FEB86659FD93)) + words[k : len(words) - count + 1 + k]
    return np.unique(mix(out))


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        s = mix(np.arange(1, 2 * HASHES + 1, dtype=_U) * _STEP)
    return s[:HASHES] | _U(1), s[HASHES:]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of each minimum hash: one row for each set, none of them empty."""
    out = np.empty((len(sets), HASHES), dtype=np.uint16)
    a, b = _seeds()
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= 32768):
            n, j = n + len(sets[j]), j + 1
        x = np.concatenate(sets[i:j])
        at = np.cumsum([0] + [len(s) for s in sets[i : j - 1]])
        with np.errstate(over="ignore"):
            for h in range(HASHES):
                out[i:j, h] = (mix(np.minimum.reduceat(x * a[h] + b[h], at)) >> _U(48)).astype(np.uint16)
        i = j
    return out


def least_matches(threshold: float, miss: float) -> dict[int, int]:
    """After n hashes, the fewest matches with which P(similarity >= threshold | matches) is still above miss."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    table = {}
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            like = m * np.log(grid) + (n - m) * np.log1p(-grid)
            like = np.exp(like - like.max())
            if like[grid >= threshold].sum() >= miss * like.sum():
                table[n] = m
                break
    return table


def surviving(left: np.ndarray, right: np.ndarray, table: dict[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (left, right) that pass every batch, some rows of left at a time."""
    step = max(1, 2_000_000 // max(1, len(right) * BATCH))
    for i in range(0, len(left), step):
        rows, matches = left[i : i + step], None
        a, b = np.nonzero(np.ones((len(rows), len(right)), dtype=bool))
        matches = np.zeros(len(a), dtype=np.int32)
        for n, least in table.items():
            part = slice(n - BATCH, n)
            if n == BATCH:
                matches = (rows[:, None, part] == right[None, :, part]).sum(axis=2, dtype=np.int32).ravel()
            else:
                matches += (rows[a, part] == right[b, part]).sum(axis=1, dtype=np.int32)
            keep = matches >= least
            a, b, matches = a[keep], b[keep], matches[keep]
        order = np.argsort(-matches, kind="stable")
        yield a[order] + i, b[order]


class Forest:
    """Union-find over the positions of one task's members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The runs of equal key in a stream that is sorted by key."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        keys = pdf[key].to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(pdf)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and held[0][key].iloc[0] != keys[lo]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(pdf.iloc[lo:hi])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _portions(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of the batches, so that few texts are Python strings at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _row_hash(key: Column, text: Column) -> Column:
    return F.xxhash64(key, text)


def _sketch(documents: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """doc, _h (hash of id and text), _n (set size), _f1, _f2 (fingerprint of the set), _sig (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _portions(batches):
            sets = [shingles(t, size) for t in part.column("t").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = signatures([sets[i] for i in full])
            col: list[bytes | None] = [None] * len(sets)
            for i, row in zip(full, sig, strict=True):
                col[i] = row.tobytes()
            with np.errstate(over="ignore"):
                f1 = [int(mix(s).sum(dtype=_U).astype(np.int64)) for s in sets]
                f2 = [int(mix(s ^ _STEP).sum(dtype=_U).astype(np.int64)) for s in sets]
            numbers = [pa.array(x, pa.int64()) for x in ([len(s) for s in sets], f1, f2)]
            made = [part.column("doc"), part.column("_h"), *numbers, pa.array(col, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["doc", "_h", "_n", "_f1", "_f2", "_sig"])

    slim = documents.select(F.col(key).alias("doc"), _row_hash(F.col(key), F.col(text)).alias("_h"), F.col(text).alias("t"))
    kind = dict(slim.dtypes)["doc"]
    return slim.mapInArrow(run, f"doc {kind}, _h long, _n long, _f1 long, _f2 long, _sig binary")


def band_rows(percent: int) -> int:
    """Hashes in a band, so that a pair at the threshold meets in some band but for about 1e-5."""
    return next((r for r in (6, 5, 4, 3, 2) if (1 - (percent / 100) ** r) ** (HASHES // r) < 2e-5), 1)


def _compared(groups: DataFrame, pairs_of, columns: list[str]) -> DataFrame:
    """Edges a, b that pairs_of finds in each group: rows of _g, side (0 or 1), cid and columns.

    A group without rows of side 1 meets itself.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int]] = []
        for pdf in _groups(batches, "_g"):
            ids = pdf["cid"].tolist()
            sig = np.frombuffer(b"".join(pdf["_sig"]), dtype=np.uint16).reshape(len(pdf), HASHES)
            split = int((pdf["side"].to_numpy() == 0).sum())
            right = 0 if split == len(pdf) else split
            out += [(ids[i], ids[j]) for i, j in pairs_of(pdf, sig, split, right)]
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        yield pd.DataFrame(out, columns=["a", "b"])

    dealt = groups.select("_g", "side", "cid", *columns).repartition(shuffle_width(groups.sparkSession), "_g")
    return dealt.sortWithinPartitions("_g", "side", "cid").mapInPandas(run, "a long, b long")


def _first_meetings(members: DataFrame, payload: list[str]) -> DataFrame:
    """Groups of _g, side, cid: in each group ``_of`` the first block meets every block. members has _of, _nb, _block, cid."""
    alone, own = F.col("_nb") == 1, F.col("_block")
    to = F.when(alone | (own > 0), F.array(own)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1))
    side = ((own > 0) & ~alone).cast("int").alias("side")
    return members.select("_of", side, "cid", *payload, F.explode(to).alias("_to")).select(
        F.xxhash64("_of", "_to").alias("_g"), "side", "cid", *payload
    )


def _connected(members: DataFrame, block: int, payload: list[str], met) -> DataFrame:
    """Components (node, root) of what met finds in groups of members (_of, _nb, _block, cid and payload).

    A group that was cut is met in two steps: by its first block, and then by all members that this left outside the
    group's largest connected part.
    """
    joined = components(met(_first_meetings(members, payload)))
    cut = members.where("_nb > 1")
    if cut.isEmpty():
        return joined
    part = joined.withColumnsRenamed({"node": "cid", "root": "_part"})
    placed = durable(cut.select("_of", "cid").join(part, "cid", "left").select("_of", "cid", F.coalesce("_part", "cid").alias("_part")))
    parts = placed.groupBy("_of", "_part").agg(F.count("*").alias("_c"))
    main = parts.groupBy("_of").agg(F.max(F.struct("_c", "_part")).alias("_m")).select("_of", F.col("_m._part").alias("_main"))
    left = durable(placed.join(main, "_of").where("_part != _main").select("_of", "cid"))
    if left.isEmpty():
        return joined
    sizes = left.groupBy("_of").agg(F.expr(f"(count(*) + {block - 1}) div {block}").alias("_rb"))
    asking = left.join(sizes, "_of").join(cut, ["_of", "cid"])
    asking = asking.withColumn("_q", F.pmod(F.xxhash64("cid"), F.col("_rb"))).withColumn("_to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1)))
    asked = cut.join(sizes, "_of").withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rb") - 1))).withColumn("_to", F.col("_block"))
    pick = lambda df, side: df.select(F.xxhash64("_of", "_q", "_to").alias("_g"), F.lit(side).alias("side"), "cid", *payload)
    found = met(pick(asking, 0).union(pick(asked, 1)))
    return components(found.union(joined.where("node != root").toDF("a", "b")))


def _clusters(classes: DataFrame, table: dict[int, int], rows_in_band: int) -> DataFrame:
    """node and root of the classes that surviving pairs of some bucket connect."""
    width = 2 * rows_in_band
    band = F.explode(F.sequence(F.lit(0), F.lit(HASHES // rows_in_band - 1)))
    members = classes.select("cid", "_sig", band.alias("_band")).select(
        "cid", F.expr(f"xxhash64(_band, substring(_sig, 1 + _band * {width}, {width}))").alias("_of")
    )
    # the sum of hashed members tells buckets of the same members, which other bands make too
    sizes = members.groupBy("_of").agg(
        F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("cid"), F.lit(1 << 40))).alias("_x"), F.min("cid").alias("_y"), F.max("cid").alias("_z")
    )
    sizes = sizes.where("n > 1").groupBy("n", "_x", "_y", "_z").agg(F.min("_of").alias("_of"))
    sizes = durable(sizes.select("_of", "n", F.expr(f"(n + {BUCKET_BLOCK - 1}) div {BUCKET_BLOCK}").alias("_nb")))
    members = salted_join(members, sizes, ["_of"]).withColumn("_block", F.pmod(F.xxhash64("cid"), F.col("_nb")))
    members = durable(members)

    def pairs(pdf: pd.DataFrame, sig: np.ndarray, split: int, right: int) -> Iterator[tuple[int, int]]:
        forest = Forest(len(pdf))
        for a, b in surviving(sig[:split], sig[right:], table):
            for i, j in zip(a.tolist(), (b + right).tolist(), strict=True):
                if i != j and forest.join(i, j):
                    yield i, j

    def met(groups: DataFrame) -> DataFrame:
        return _compared(groups.join(classes.select("cid", "_sig"), "cid"), pairs, ["_sig"])

    return _connected(members, BUCKET_BLOCK, [], met)


def _verified_links(
    documents: DataFrame, key: str, text: str, classes: DataFrame, clusters: DataFrame, table: dict[int, int], percent: int, size: int
) -> DataFrame:
    """node and root of the classes that pairs with similar enough full sets connect; pairs lie in one cluster."""
    sizes = clusters.groupBy("root").agg(F.count("*").alias("n"))
    sizes = durable(sizes.select("root", "n", F.expr(f"(n + {CLUSTER_BLOCK - 1}) div {CLUSTER_BLOCK}").alias("_nb")))
    members = durable(
        salted_join(clusters, sizes, ["root"])
        .select(F.col("node").alias("cid"), F.col("root").alias("_of"), "_nb")
        .withColumn("_block", F.pmod(F.xxhash64("cid"), F.col("_nb")))
        .join(classes.select("cid", "_pick", "_sig"), "cid")
    )

    names = ["cid", "_of", "_nb", "_block", "_sig"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _portions(batches):
            found = pa.array([shingles(t, size).tobytes() for t in part.column("t").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*map(part.column, names), found], names=[*names, "_set"])

    texts = documents.select(_row_hash(F.col(key), F.col(text)).alias("_pick"), F.col(text).alias("t"))
    texts = texts.join(maybe_broadcast(members), "_pick").select(*names, "t")
    full = texts.mapInArrow(sets, "cid long, _of long, _nb long, _block long, _sig binary, _set binary")
    full = durable(full.dropDuplicates(["cid"]))

    def pairs(pdf: pd.DataFrame, sig: np.ndarray, split: int, right: int) -> Iterator[tuple[int, int]]:
        found = [np.frombuffer(s, dtype=_U) for s in pdf["_set"]]
        forest = Forest(len(pdf))
        for a, b in surviving(sig[:split], sig[right:], table):
            for i, j in zip(a.tolist(), (b + right).tolist(), strict=True):
                if i == j or forest.find(i) == forest.find(j):
                    continue
                x, y = found[i], found[j]
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    forest.join(i, j)
                    yield i, j

    payload = ["_sig", "_set"]
    return _connected(full, CLUSTER_BLOCK, payload, lambda groups: _compared(groups, pairs, payload))


#: What rows of equal sets share.
SAME = ["_n", "_f1", "_f2"]


def _linked(
    documents: DataFrame, percent: int, size: int, key: str, text: str, miss: float, more: dict[str, Column] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of all rows, the classes of equal sets (with aggregates ``more``), and node and root of linked classes."""
    sketch = durable(_sketch(documents, key, text, size))
    classes = sketch.where("_n > 0").groupBy(*SAME).agg(
        F.min("doc").alias("_doc"),
        F.min("_h").alias("_pick"),
        F.first("_sig").alias("_sig"),
        F.count("*").alias("n"),
        *[c.alias(name) for name, c in (more or {}).items()],
    )
    classes = durable(classes.withColumn("cid", F.xxhash64(*SAME)))
    table = least_matches(percent / 100, miss)
    clusters = _clusters(classes, table, band_rows(percent))
    return sketch, classes, _verified_links(documents, key, text, classes, clusters, table, percent, size)


def _grouped(documents: DataFrame, percent: int, size: int, key: str, text: str, miss: float) -> tuple[DataFrame, DataFrame]:
    """Rows with a set: doc, _h, _n, _group (class id of their group's root) and _least (its least id); and the others."""
    sketch, classes, joined = _linked(documents, percent, size, key, text, miss)
    named = durable(joined.select(F.col("node").alias("cid"), "root").join(classes.select("cid", "_doc"), "cid"))
    least = durable(named.groupBy("root").agg(F.min("_doc").alias("_least"), F.count("*").alias("n")))
    owner = salted_join(named.select("cid", "root"), least, ["root"])
    roots = classes.select("cid", *SAME, "_doc", "n").join(owner, "cid", "left")
    own = F.col("root").isNull()
    roots = roots.select(*SAME, "n", F.coalesce("root", "cid").alias("_group"), F.when(own, F.col("_doc")).otherwise(F.col("_least")).alias("_least"))
    rows = salted_join(sketch.where("_n > 0").drop("_sig"), durable(roots), SAME)
    return rows.select("doc", "_h", "_n", "_group", "_least"), sketch.where("_n = 0").select("doc", "_h", "_n")


def near_duplicates(
    documents: DataFrame, percent: int = 80, size: int = 5, key: str = "doc_id", text: str = "text", miss: float = MISS
) -> DataFrame:
    """One row a document: key, n_shingles, component_id (the least id reachable), kept (the id is its own).

    Documents are linked where 100 * intersection >= percent * union of their sets of shingles of ``size`` words. A link
    is missed only if no band agrees (about 1e-5 at the threshold) or by the chosen ``miss``; other links usually join the
    same documents anyway. Null, empty and blank texts have no set and no links; texts are read whole, however long. A
    null id has a null component and is kept. Rows that repeat an id keep their own sets, and the id may then be kept
    more than once. An empty table gives no rows. Other columns are not used, so their names cannot clash.
    """
    rows, bare = _grouped(documents, percent, size, key, text, miss)
    least = F.when(F.col("doc").isNotNull(), F.col("_least"))
    out = rows.select("doc", "_n", least.alias("_c")).union(bare.select("doc", "_n", F.col("doc").alias("_c")))
    return out.select(
        F.col("doc").alias(key),
        F.col("_n").alias("n_shingles"),
        F.col("_c").alias("component_id"),
        (F.col("doc").isNull() | (F.col("_c") == F.col("doc"))).alias("kept"),
    )


def distinct_rows(
    documents: DataFrame, key: str = "doc_id", percent: int = 80, size: int = 5, text: str = "text", miss: float = MISS
) -> DataFrame:
    """One row of each group of near-duplicates, with the columns of documents, whatever those are called.

    The row of the least id stays (null ids last), of equal ids that of the least text hash, and of equal rows one.
    Rows without words belong to no group and all stay; an empty table gives no rows. The least row of a group is the
    least of its classes' least rows, so that only classes meet their groups, and no row does.
    """
    order = F.struct(F.col("doc").isNull().alias("n"), F.col("doc").alias("d"), F.col("_h").alias("h"))
    sketch, classes, joined = _linked(documents, percent, size, key, text, miss, {"_m": F.min(order)})
    bare = sketch.where("_n = 0")
    groups = classes.select("cid", "_m", "n").join(joined.withColumnRenamed("node", "cid"), "cid", "left")
    groups = groups.groupBy(F.coalesce("root", "cid").alias("_group")).agg(F.min("_m").alias("m"), F.sum("n").alias("c"))
    stay = durable(groups.select(F.col("m.h").alias("_k"), "c"))
    whole = documents.select(F.struct("*").alias("row")).withColumn("_own", _row_hash(F.col(f"row.{key}"), F.col(f"row.{text}")))
    alone = stay.where("c = 1").select("_k").union(bare.select(F.col("_h").alias("_k")).distinct())
    single = whole.join(alone, F.col("_own") == F.col("_k"), "left_semi")
    grouped = whole.join(maybe_broadcast(stay.where("c > 1").select("_k")), F.col("_own") == F.col("_k"), "left_semi")
    return single.select("row.*").union(grouped.dropDuplicates(["_own"]).select("row.*"))
