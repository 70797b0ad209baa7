"""Hash trees over the members of groups: one root a group, and from the roots down to what differs between two versions.

A node stands for a range of FAN keys, or of FAN nodes below it, so that no row ever holds more than FAN hashes. A node with a single
child takes its hash as it is: a root does not depend on how many levels there are above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Children of a node, at most: a power of two. A root has twice as many where keys are of both signs.
BITS = 6
FAN = 1 << BITS


def member(key: Column, hash_: Column) -> Column:
    """What stands for a member in its leaf; a null hash is a member that is missing."""
    return F.concat(key.cast("string"), F.lit(":"), F.coalesce(hash_, F.lit("missing")))


def _joined() -> Column:
    parts = F.transform(F.sort_array(F.collect_list(F.struct("child", "hash"))), lambda x: x["hash"])
    return F.when(F.size(parts) == 1, parts[0]).otherwise(F.sha2(F.array_join(parts, "|").cast("binary"), 256)).alias("hash")


def depth(key: str, *versions: DataFrame) -> int:
    """Levels that trees over all keys of these tables need."""
    low, high = 0, 0
    for v in versions:
        a, b = v.agg(F.min(key), F.max(key)).first()
        low, high = min(low, a or 0), max(high, b or 0)
    return max(1, -(-max(int(high).bit_length(), (-int(low)).bit_length()) // BITS))


def tree(members: DataFrame, group: str, key: str, hash_: str, levels_: int | None = None) -> list[DataFrame]:
    """Levels from the leaves to the roots, each group, node, hash, n (members) and present (members that are not missing).

    members: one row a group and key, an integer of 64 bits; hash_ is null for a member that is missing. Null groups are a group; rows
    without a key are no members. The roots have node 0. Each level has at most a FAN-th of the rows below it where keys are dense. Trees
    that are compared node by node need as many levels: see depth.
    """
    rows = members.where(F.col(key).isNotNull())
    leaf = rows.select(F.col(group).alias("group"), F.col(key).cast("long").alias("child"), F.sha2(member(F.col(key), F.col(hash_)).cast("binary"), 256).alias("hash"), F.lit(1).alias("n"), F.col(hash_).isNotNull().cast("int").alias("present"))
    levels, below = [], leaf
    top = levels_ or depth(key, rows)
    for level in range(1, top + 1):
        node = F.shiftright("child", BITS) if level < top else F.lit(0).cast("long")  # the last level also joins keys below and above 0
        now = below.groupBy("group", node.alias("node")).agg(_joined(), F.sum("n").alias("n"), F.sum("present").alias("present"))
        levels.append(now)
        below = now.withColumnRenamed("node", "child")
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """group and hash, null where all members are missing."""
    return levels[-1].select("group", F.when(F.col("present") > 0, F.col("hash")).alias("hash"))


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes of one level of two trees: group, node, x, y, their hashes."""
    x, y = a.select(F.col("group").alias("g"), F.col("node").alias("k"), F.col("hash").alias("x")), b.select("group", "node", F.col("hash").alias("y"))
    both = x.join(y, F.col("g").eqNullSafe(F.col("group")) & (F.col("k") == F.col("node")), "full_outer")
    return both.select(F.when(F.col("k").isNotNull(), F.col("g")).otherwise(F.col("group")).alias("group"), F.coalesce("k", "node").alias("node"), "x", "y")


def status(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """group and status of the second tree against the first: new, unreadable (it is gone), unchanged or changed."""
    return _pairs(b[-1], a[-1]).select("group", F.when(F.col("y").isNull(), "new").when(F.col("x").isNull(), "unreadable").when(F.col("x") == F.col("y"), "unchanged").otherwise("changed").alias("status"))


def changed_leaves(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """group and leaf (key shifted by BITS) of all leaves that differ, found from the roots: of each level only the children of nodes that differ are compared."""
    if len(a) != len(b):
        raise ValueError("trees of different depth")
    found = _differ(a[-1], b[-1])
    for level in range(len(a) - 2, -1, -1):
        parent = F.shiftright("node", BITS) if level < len(a) - 2 else F.lit(0).cast("long")
        wanted = found.select(F.col("group").alias("_g"), F.col("node").alias("_n"))
        own = [t[level].join(wanted, F.col("group").eqNullSafe(F.col("_g")) & (parent == F.col("_n")), "left_semi") for t in (a, b)]
        found = _differ(*own)
    return found.select("group", F.col("node").alias("leaf"))


def changed_members(a: DataFrame, b: DataFrame, group: str, key: str, hash_: str) -> DataFrame:
    """group, key and status (new, gone, changed) of members (one row a group and key) that differ between two versions; only those in leaves that differ are compared one by one."""
    n = depth(key, a, b)
    leaves = changed_leaves(tree(a, group, key, hash_, n), tree(b, group, key, hash_, n)).select(F.col("group").alias("_g"), "leaf")
    near = lambda rows, h: rows.where(F.col(key).isNotNull()).join(leaves, F.col(group).eqNullSafe(F.col("_g")) & (F.shiftright(F.col(key).cast("long"), BITS) == F.col("leaf")), "left_semi").select(F.col(group).alias(f"{h}g"), F.col(key).alias(f"{h}k"), F.struct(hash_).alias(h))
    both = near(a, "x").join(near(b, "y"), F.col("xg").eqNullSafe(F.col("yg")) & (F.col("xk") == F.col("yk")), "full_outer")
    state = F.when(F.col("x").isNull(), "new").when(F.col("y").isNull(), "gone").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return both.select(F.when(F.col("xk").isNotNull(), F.col("xg")).otherwise(F.col("yg")).alias(group), F.coalesce("xk", "yk").alias(key), state.alias("status")).where("status is not null")


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    return _pairs(a, b).where(~F.col("x").eqNullSafe(F.col("y"))).select("group", "node")
