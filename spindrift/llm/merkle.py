"""Merkle manifest of a table: a digest for each row, a tree for each group, one root, and a proof for each row.

Method: rows are range-sorted by group and key; the counts of each group in each partition, summed over the partitions
before, give every row its coordinate in its group's tree. A partition builds the subtrees that lie in it wholly; the
nodes whose parent it cannot build, at most two at either end of a level, are ragged. They are shuffled by the
coordinate of their ancestor LIFT levels up, where one small task finishes those levels; the ancestors go on to the next
round. Paths are then put together from the top down, so each row gets the siblings that lead to its root. The group
roots are leaves of one more tree, built in the same way.

No group meets in one task, whatever its size: a task holds a partition of the sorted rows, or the ragged nodes below one
ancestor. Null groups come first, then groups bytewise; in a group null keys come first, and equal keys follow their leaf
digest, then their place in the input, so repeated rows are leaves of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.session import durable, shuffle_width

#: Levels that one round of ragged nodes climbs.
LIFT = 6
STEP = "array<struct<left:array<string>,right:array<string>>>"
_SIDE = pa.list_(pa.string())
_STEPS = pa.list_(pa.struct([("left", _SIDE), ("right", _SIDE)]))


def node(parts: list[str]) -> str:
    """Digest of the concatenated digests of the children."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 of all values: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    said = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s), F.lit(":"), s)) for s in said]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof lead to."""
    up = lambda at, s: F.sha2(F.concat(F.array_join(s["left"], ""), at, F.array_join(s["right"], "")), 256)
    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    """SHA-256 of the siblings of a proof, level by level, left to right."""
    each = F.transform(proof, lambda s: F.concat(F.array_join(s["left"], ""), F.array_join(s["right"], "")))
    return F.sha2(F.array_join(each, ""), 256)


def _widths(total: int, fanout: int) -> list[int]:
    """Number of nodes on each level of a tree of so many leaves."""
    out = [total]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


def _local(digests: list[str], first: int, widths: list[int], fanout: int) -> list[tuple[int, list[str]]]:
    """The nodes that consecutive leaves determine: for each level the first coordinate and the digests."""
    levels = [(first, digests)]
    for width in widths[:-1]:
        at, nodes = levels[-1]
        end = at + len(nodes)
        lo, hi = -(-at // fanout), (-(-width // fanout) if end == width else end // fanout)
        if lo >= hi:
            break
        levels.append((lo, [node(nodes[max(0, g * fanout - at) : (g + 1) * fanout - at]) for g in range(lo, hi)]))
    return levels


def _siblings(nodes: list[str], at: int, coord: int, fanout: int) -> dict[str, list[str]]:
    """The others of a node's run, from a level's consecutive nodes."""
    start = coord // fanout * fanout - at
    return {"left": nodes[start : coord - at], "right": nodes[coord - at + 1 : start + fanout]}


def _segments(table: pa.Table) -> Iterator[tuple[str, int, int, pa.Table]]:
    """The rows of each group of one block, in order: group, first coordinate, leaves of the whole group, rows."""
    table = table.sort_by([("_group", "ascending"), ("_at", "ascending")])
    groups = table["_group"].to_pylist()
    start = 0
    for i in range(1, len(groups) + 1):
        if i == len(groups) or groups[i] != groups[start]:
            part = table.slice(start, i - start)
            yield groups[start], part["_at"][0].as_py(), part["_total"][0].as_py(), part
            start = i


def placed(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """Range-sort leaves (``_group``, ``_digest``) and add their ``_block``, coordinate ``_at`` and the group's ``_total``."""
    order = [*[F.col(k).asc_nulls_first() for k in keys], F.col("_digest"), F.col("_place")]
    cut = leaves.withColumn("_place", F.monotonically_increasing_id())
    cut = cut.repartitionByRange(shuffle_width(leaves.sparkSession), F.col("_group"), *order)
    cut = durable(cut.withColumn("_block", F.spark_partition_id()))  # range bounds are sampled: fix them
    whole = Window.partitionBy("_group")
    counts = cut.groupBy("_group", "_block").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(whole.orderBy("_block")) - F.col("_n")
    offsets = counts.select("_group", "_block", ahead.alias("_first"), F.sum("_n").over(whole).alias("_total"))
    inside = F.row_number().over(Window.partitionBy("_block", "_group").orderBy(*order)) - 1
    rows = cut.withColumn("_at", inside).join(offsets, ["_group", "_block"])
    return durable(rows.withColumn("_at", (F.col("_at") + F.col("_first")).cast("long")).drop("_place", "_first"))


NODES = "_group string, _block int, _level int, _coord long, _digest string, _total long"


def ragged(rows: DataFrame, fanout: int) -> DataFrame:
    """The topmost nodes that each block of placed leaves determines."""

    def run(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {c.split()[0]: [] for c in NODES.split(", ")}
        block = table["_block"][0].as_py()
        for group, first, total, part in _segments(table):
            levels = _local(part["_digest"].to_pylist(), first, _widths(total, fanout), fanout)
            for k, (at, nodes) in enumerate(levels):
                above = range(levels[k + 1][0], levels[k + 1][0] + len(levels[k + 1][1])) if k + 1 < len(levels) else ()
                for coord, digest in enumerate(nodes, at):
                    if coord // fanout not in above:
                        for name, value in zip(out, (group, block, k, coord, digest, total), strict=True):
                            out[name].append(value)
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64()]
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(out.items(), kinds, strict=True)})

    return rows.groupBy("_block").applyInArrow(run, NODES)


def _climbed(nodes: DataFrame, base: int, fanout: int) -> DataFrame:
    """Finish the levels from base on below each ancestor: the path of each node, and the digest it ends at.

    ``_over`` says that the tree ends there. Nodes are shuffled by their group and the ancestor's coordinate.
    """
    top = base + LIFT
    names = ["_group", "_block", "_level", "_coord", "_anc", "_total", "_path", "_top", "_over"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), _STEPS, pa.string(), pa.bool_()]

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        widths = _widths(rows[0]["_total"], fanout)
        last = min(top, len(widths) - 1)
        known: list[dict[int, str]] = [{} for _ in range(last + 1)]
        for r in rows:
            known[r["_level"]][r["_coord"]] = r["_digest"]
        for k in range(base, last):
            for g in {c // fanout for c in known[k]}:
                known[k + 1][g] = node([known[k][c] for c in range(g * fanout, min((g + 1) * fanout, widths[k]))])
        for r in rows:
            coord, path = r["_coord"], []
            for k in range(r["_level"], last):
                g = coord // fanout
                run_of = range(g * fanout, min((g + 1) * fanout, widths[k]))
                path.append({"left": [known[k][c] for c in run_of if c < coord], "right": [known[k][c] for c in run_of if c > coord]})
                coord = g
            r |= {"_path": path, "_top": known[last][coord], "_over": last < top}
        return pa.table({n: pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds, strict=True)})

    reach = F.element_at(F.array(*[F.lit(fanout**k).cast("long") for k in range(1, LIFT + 1)]), F.lit(top) - F.col("_level"))
    keyed = nodes.withColumn("_reach", reach).withColumn("_anc", F.expr("_coord div _reach")).drop("_reach")
    schema = f"_group string, _block int, _level int, _coord long, _anc long, _total long, _path {STEP}, _top string, _over boolean"
    return durable(keyed.groupBy("_group", "_anc").applyInArrow(run, schema))


def upper_paths(nodes: DataFrame, fanout: int) -> DataFrame:
    """For each ragged node its siblings up to its group's root (``_path``) and that root (``_top``)."""
    most = nodes.agg(F.max("_total")).first()[0] or 1
    rounds, rest, lifted = [], nodes, None
    for base in range(0, len(_widths(most, fanout)), LIFT):
        here = rest.where(F.col("_level").between(base, base + LIFT - 1))
        rounds.append(_climbed(here if lifted is None else here.unionByName(lifted), base, fanout))
        ended = rounds[-1].where("not _over").groupBy("_group", "_anc").agg(F.first("_top").alias("_digest"), F.first("_total").alias("_total"))
        lifted = ended.select("_group", F.lit(-1).alias("_block"), F.lit(base + LIFT).alias("_level"), F.col("_anc").alias("_coord"), "_digest", "_total")
    whole = rounds[-1]
    for part in reversed(rounds[:-1]):
        above = whole.where("_block = -1").select("_group", F.col("_coord").alias("_anc"), F.col("_path").alias("_rest"), F.col("_top").alias("_root"))
        climbed = part.where("not _over").join(above, ["_group", "_anc"])
        joined = climbed.withColumns({"_path": F.concat("_path", "_rest"), "_top": F.col("_root")}).select(*part.columns)
        whole = joined.unionByName(part.where("_over")).unionByName(whole.where("_block >= 0"))
    return durable(whole.where("_block >= 0").select("_group", "_block", "_level", "_coord", "_path", "_top"))


def with_proofs(rows: DataFrame, upper: DataFrame, fanout: int) -> DataFrame:
    """Placed leaves with ``_path``, their siblings up to their group's root, and ``_top``, that root.

    Further columns of upper, which must be strings, step arrays or longs, come along.
    """
    more = [c for c in upper.columns if c not in {"_group", "_block", "_level", "_coord", "_path"}]
    types = {"string": pa.string(), "bigint": pa.int64()}
    kinds = {c: types.get(t, _STEPS) for c, t in upper.dtypes}
    plain = [c for c in rows.columns if c not in {"_at", "_total", "_block"}]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tops = {(r["_group"], r["_level"], r["_coord"]): r for r in right.to_pylist()}
        parts, paths, extra = [], [], {c: [] for c in more}
        for group, first, total, part in _segments(left) if len(left) else ():
            levels = _local(part["_digest"].to_pylist(), first, _widths(total, fanout), fanout)
            parts.append(part.select(plain))
            for coord in range(first, first + len(part)):
                path, k = [], 0
                while (group, k, coord) not in tops:
                    at, nodes = levels[k]
                    path.append(_siblings(nodes, at, coord, fanout))
                    coord, k = coord // fanout, k + 1
                found = tops[group, k, coord]
                paths.append(path + found["_path"])
                for c in more:
                    extra[c].append(found[c])
        out = pa.concat_tables(parts) if parts else left.select(plain)
        out = out.append_column("_path", pa.array(paths, _STEPS))
        for c in more:
            out = out.append_column(c, pa.array(extra[c], kinds[c]))
        return out

    head = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c in plain)
    tail = ", ".join([f"_path {STEP}", *[f"{c} {dict(upper.dtypes)[c]}" for c in more]])
    return rows.groupBy("_block").cogroup(upper.groupBy("_block")).applyInArrow(run, f"{head}, {tail}")


def manifest(df: DataFrame, columns: list[str], group: str = "source", key: str = "doc_id", fanout: int = 3, tampered: list[Column] | None = None) -> DataFrame:
    """The manifest of df: ``key``, ``leaf``, ``subroot``, ``root`` and ``proof`` (the siblings of each level, left and right).

    A leaf digests the named columns, null or not, in that order. ``tampered`` gives the same values as found later:
    their digest is returned as ``found_leaf``. Columns of df that are not named take no part.
    """
    found = [leaf_digest(tampered).alias("_found")] if tampered else []
    named = F.when(F.col(group).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    leaves = df.select(named.alias("_group"), F.col(key).alias("_key"), leaf_digest([F.col(c) for c in columns]).alias("_digest"), *found)
    rows = placed(leaves, ["_key"])
    upper = upper_paths(ragged(rows, fanout), fanout)
    heads = upper.groupBy("_group").agg(F.first("_top").alias("_digest"))
    heads = placed(heads.select(F.lit("").alias("_group"), F.col("_group").alias("_name"), "_digest"), ["_name"])
    roots = with_proofs(heads, upper_paths(ragged(heads, fanout), fanout), fanout)
    roots = roots.select(F.col("_name").alias("_group"), F.col("_path").alias("_on"), F.col("_top").alias("_root"))
    full = with_proofs(rows, upper.join(roots, "_group"), fanout)
    return full.select(
        F.col("_key").alias(key),
        F.col("_digest").alias("leaf"),
        F.col("_top").alias("subroot"),
        F.col("_root").alias("root"),
        F.concat("_path", "_on").alias("proof"),
        *([F.col("_found").alias("found_leaf")] if tampered else []),
    )
