"""Merkle manifest of a dataset: a content-addressed DAG and proofs by descent.

A leaf is the SHA-256 of a row's fields (each ``-`` if null, else its UTF-8
byte count, ``:`` and its value). The leaves of a group ascend by the key;
while several nodes remain, every ``FANOUT`` consecutive ones become one node,
the SHA-256 of their digests (hex text, concatenated). What remains is the
group's subroot (a lone leaf is its own), and the subroots, ordered by group,
give the root of the dataset in the same way.

Method. Every level is a table of records digest -> children, the store. A
proof starts at the root: a request looks its node up in the store by digest,
goes on to the child that the next base-16 digit of its rank names, and keeps
the children that it did not go to as one segment of its path, split where the
chosen child stood. At the leaf the segments are reversed. Requests that share
a node go down together: the frontier holds a node once for all of them, so
the root is no hot key, and only the last step, from the nodes above the
leaves to the leaves, has one row per request.

Ranks come from one range-partitioned sort over (group, key, leaf) and the
row counts of its slices, so a group with a third of all rows is spread over
many tasks; the same holds for the nodes, at most ``FANOUT`` rows each.

Defined results: a null group comes first; null keys come first in their
group, rows with equal keys ascend by leaf, and repeated rows are a leaf each.
Null and empty texts differ (``-`` and ``0:``). An empty table has no root and
no rows. Other columns are ignored, whatever their names; long texts are only
hashed, in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.llm.common import materialize

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NO_PATH = "CAST(array() AS array<struct<before:string,after:string>>)"


def field_text(value: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(f) for f in fields]), 256)


def with_ranks(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` (written) with ``rank``, from 0 inside a non-null group, and ``n``, the size of the group.

    The slices of a range-partitioned sort are written with the place of each row; a row's rank is its
    place in its slice's run of the group plus the sizes of the group's runs in earlier slices."""
    keys = [F.col(group), *(F.col(c) for c in order)]
    placed = materialize(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()),
        "ranked").withColumn("slice", F.shiftright("place", 33))
    every = Window.partitionBy(group)
    runs = placed.groupBy(group, "slice").agg(F.min("place").alias("first"), F.count("*").alias("run")).select(
        group, "slice", "first",
        F.coalesce(F.sum("run").over(every.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("run").over(every).alias("n"))
    return placed.join(runs, [group, "slice"]).withColumn(
        "rank", F.col("place") - F.col("first") + F.col("before")).drop("slice", "place", "first", "before")


@dataclass
class Tree:
    """Trees of one forest. levels[k-1]: the nodes of height k (digest, children); roots: (tree, digest, height)."""

    levels: list[DataFrame]
    roots: DataFrame


def grow(leaves: DataFrame, label: str) -> Tree:
    """Trees over ``leaves`` (tree, rank, n, digest), one for each value of ``tree``."""
    now, levels, roots = leaves.select("tree", "rank", "n", "digest"), [], None
    most = now.agg(F.max("n")).first()[0] or 0
    while True:
        done = now.filter("n = 1").select("tree", "digest", F.lit(len(levels)).alias("height"))
        roots = done if roots is None else roots.unionByName(done)
        if FANOUT ** len(levels) >= most:
            return Tree(levels, materialize(roots, f"{label}-roots"))
        nodes = (now.filter("n > 1")
                 .groupBy("tree", F.expr(f"rank div {FANOUT}").alias("rank"))
                 .agg(F.first(F.expr(f"(n + {FANOUT - 1}) div {FANOUT}")).alias("n"),
                      F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("c")))
        now = materialize(nodes.select("tree", "rank", "n", F.col("c.digest").alias("children"))
                          .withColumn("digest", F.sha2(F.array_join("children", ""), 256)), f"{label}-{len(levels) + 1}")
        levels.append(now)


def _step(frontier: DataFrame, records: DataFrame, height: int) -> DataFrame:
    """The frontier with ``children`` for its nodes of that height, looked up by digest (null for lower ones)."""
    store = records.select(F.col("digest").alias("stored"), "children").dropDuplicates(["stored"])
    return frontier.join(store, (frontier["digest"] == store["stored"]) & (frontier["height"] == height), "left").drop("stored")


def _segment(children: Column, digit: Column) -> Column:
    """The unselected children, before and after the selected one."""
    before = F.array_join(F.slice(children, F.lit(1), digit), "")
    after = F.array_join(F.slice(children, digit + 2, F.greatest(F.size(children) - digit - 1, F.lit(0))), "")
    return F.struct(before.alias("before"), after.alias("after"))


def descend(frontier: DataFrame, tree: Tree, stop: int, wanted: DataFrame | None = None) -> DataFrame:
    """The nodes of height ``stop`` (or of lower roots) below the frontier (tree, rank, height, digest, path, ...).

    ``wanted`` (tree, rank of a leaf): only nodes above one of these are followed."""
    for height in range(len(tree.levels), stop, -1):
        looked = _step(frontier, tree.levels[height - 1], height)
        rest = [c for c in frontier.columns if c not in ("rank", "height", "digest", "path")]
        inside = F.col("children").isNotNull()
        child = looked.select(*rest, "rank", "height", "digest", "path", "children",
                              F.posexplode(F.coalesce("children", F.array("digest"))).alias("digit", "child"))
        frontier = child.select(
            *rest,
            F.when(inside, F.col("rank") * FANOUT + F.col("digit")).otherwise(F.col("rank")).alias("rank"),
            F.when(inside, F.col("height") - 1).otherwise(F.col("height")).alias("height"),
            F.col("child").alias("digest"),
            F.when(inside, F.concat("path", F.array(_segment(F.col("children"), F.col("digit"))))).otherwise(F.col("path")).alias("path"))
        if wanted is not None:
            # A node of height h and rank r stands above the leaves of rank r * FANOUT^h on.
            over = wanted.select(F.col("tree").alias("wt"), F.expr(f"rank div {FANOUT ** (height - 1)}").alias("wr")).distinct()
            frontier = frontier.join(over, (F.col("tree") == over["wt"]) & (
                (F.col("rank") == over["wr"]) | (F.col("height") < height - 1)), "left_semi")
    return frontier


@dataclass
class Manifest:
    """leaves: (key, tree, rank, n, digest, claimed); groups: one row per group, (rank, name, digest, height)."""

    leaves: DataFrame
    groups: DataFrame
    rows_tree: Tree
    group_tree: Tree
    root: str | None


def build_manifest(docs: DataFrame, claimed: Column | None = None, group_col: str = "source", key_col: str = "doc_id",
                   fields: tuple[str, ...] = FIELDS) -> Manifest:
    """The store of ``docs``. ``claimed``: a digest presented in place of a row's own leaf, null for its own."""
    own = [F.col(f"`{f}`") for f in fields]
    group = F.col(f"`{group_col}`").cast("string")
    rows = materialize(docs.select(
        F.col(f"`{key_col}`").alias("key"),
        # Null first, then bytewise: "-" sorts before "=".
        F.coalesce(F.concat(F.lit("="), group), F.lit("-")).alias("tree"),
        leaf_digest(own).alias("digest"),
        (F.lit(None) if claimed is None else claimed).cast("string").alias("claimed")), "leaves")
    leaves = materialize(with_ranks(rows, "tree", ["key", "digest"]), "leaves-ranked")
    rows_tree = grow(leaves, "nodes")
    tops = with_ranks(rows_tree.roots.select(F.lit("").alias("all"), F.col("tree").alias("name"), "digest", "height"),
                      "all", ["name"])
    groups = materialize(tops.select(F.col("all").alias("tree"), "rank", "n", "digest", "name", "height"), "groups")
    group_tree = grow(groups, "top")
    top = group_tree.roots.first()
    return Manifest(leaves, groups, rows_tree, group_tree, top.digest if top else None)


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """One row per requested leaf: key, leaf, claimed, subroot, root, path (segments before/after, from leaf to root).

    ``requests`` (tree, rank): a part of the leaves; by default every leaf."""
    leaves = manifest.leaves
    if requests is not None:
        asked = requests.select("tree", "rank").distinct()
        leaves = leaves.join(asked, ["tree", "rank"], "left_semi")
    wanted = None if requests is None else leaves.select("tree", "rank")
    top = manifest.group_tree.roots.select("tree", F.lit(0).cast("long").alias("rank"), "height", "digest",
                                           F.expr(_NO_PATH).alias("path"), F.col("digest").alias("root"))
    subroots = descend(top, manifest.group_tree, 0)
    names = manifest.groups.select("rank", F.col("name").alias("tree"), F.col("height").alias("below"))
    start = subroots.drop("tree", "height").join(names, "rank").select(
        "tree", F.lit(0).cast("long").alias("rank"), F.col("below").alias("height"), "digest", "path", "root",
        F.col("digest").alias("subroot"))
    if wanted is not None:
        start = start.join(wanted.select("tree").distinct(), "tree", "left_semi")
    above = descend(start, manifest.rows_tree, 1, wanted)
    if manifest.rows_tree.levels:
        above = _step(above, manifest.rows_tree.levels[0], 1)
    else:
        above = above.withColumn("children", F.lit(None).cast("array<string>"))
    above = above.select(F.col("tree").alias("at"), F.col("rank").alias("node"), "children", "path", "subroot", "root")
    met = leaves.join(above, (leaves["tree"] == above["at"]) & (F.expr(f"rank div {FANOUT}") == above["node"]))
    digit = (F.col("rank") % FANOUT).cast("int")
    down = F.when(F.col("children").isNotNull(), F.concat("path", F.array(_segment(F.col("children"), digit)))).otherwise(F.col("path"))
    return met.select("key", F.col("digest").alias("leaf"), "claimed", "subroot", "root", F.reverse(down).alias("path"))


def siblings_digest(path: Column) -> Column:
    """SHA-256 of the unselected digests of a path, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path (from leaf to root) give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))
