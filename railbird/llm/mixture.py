"""A corpus mixed to target weights over a tree of sources. DataFrame functions only.

The budget goes down the tree: at each node it is dealt to the children by weight, none gets more than the tokens below
it allow, and what a child cannot use goes to its siblings. As a node is never dealt more than it can hold, a shortage
reaches an ancestor's siblings only where the node's own children cannot make it up.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railbird.llm.shards import prefix_sums
from railbird.operators.groups import durable

NONE = "(none)"
ADDED = ("n_tokens", "leaf_budget", "copies")


def node(levels: Sequence[str], depth: int):
    return F.concat_ws("/", *levels[:depth])


def deal(children: DataFrame, parent: list[str], share: str) -> DataFrame:
    """Deal the budget ``share`` of a parent to its rows, by ``weight`` and never beyond ``room``, as column ``given``.

    Filled in the order of room by weight, a row is full if the level that what is left would rise to reaches its room.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("room") / F.col("weight"), "weight", "path")
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col(share) - (F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("room"))
    leveled = children.withColumn("_level", left / F.sum("weight").over(rest))
    part_full = F.when(F.col("room") > F.col("_level") * F.col("weight"), F.col("_level"))
    level = F.max(part_full).over(Window.partitionBy(*parent))
    given = F.least(F.col("room"), F.coalesce(level * F.col("weight"), F.col("room")))
    return leveled.withColumn("given", F.greatest(given, F.lit(0.0))).drop("_level")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, float], share: float, epochs: int) -> DataFrame:
    """The whole tokens of each leaf's budget. ``leaves`` has the levels and ``tokens``; ``weights`` is by path.

    ``share`` of all tokens is dealt, as far as the tree can hold it. A node without a weight has 1; one with a weight
    of 0 or less is left out, with all below it. There is one row for each leaf of the tree, so this table is small.
    """
    spark = leaves.sparkSession
    depth = len(levels)
    listed = ", ".join(f"({_quoted(path)}, {float(weight)!r}D)" for path, weight in weights.items()) or "('', 1D)"
    known = spark.sql(f"SELECT * FROM VALUES {listed} AS t(path, _weight)")
    rooms: dict[int, DataFrame] = {}
    table = leaves.withColumn("room", (F.col("tokens") * epochs).cast("double"))
    for k in range(depth, 0, -1):
        table = table.withColumn("path", node(levels, k)).join(F.broadcast(known), "path", "left")
        table = table.withColumn("weight", F.coalesce("_weight", F.lit(1.0))).drop("_weight")
        table = table.withColumn("room", F.when(F.col("weight") > 0, F.col("room")).otherwise(F.lit(0.0)))
        rooms[k] = table = durable(table.select(*levels[:k], "path", "weight", "room", "tokens"))
        table = table.groupBy(*levels[: k - 1]).agg(F.sum("room").alias("room"), F.sum("tokens").alias("tokens"))
    given = table.select(F.least(F.col("room"), F.col("tokens") * F.lit(float(share))).alias("share"))
    for k in range(1, depth + 1):
        parent = list(levels[: k - 1])
        open_ = rooms[k].where(F.col("room") > 0)
        children = open_.join(given, parent) if parent else open_.crossJoin(F.broadcast(given))
        given = deal(children, parent, "share").select(*levels[:k], F.col("given").alias("share"))
    # sums of doubles may differ in the last digits, which must not cost a token
    whole = F.floor(F.col("share") + 1e-6).cast("long")
    return rooms[depth].select(*levels, "tokens").join(given, list(levels), "left").select(
        *levels, "tokens", F.coalesce(whole, F.lit(0)).cast("long").alias("leaf_budget")
    )


def _quoted(path: str) -> str:
    return "'" + path.replace("\\", "\\\\").replace("'", "\\'") + "'"


def leveled(docs: DataFrame, levels: Sequence[str]) -> DataFrame:
    return docs.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)) for c in levels})


def order_key(seed: int, epoch: str, doc_id: str):
    """Where a document comes in an epoch: a hash of the seed, the epoch and the document's id."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(epoch), F.coalesce(F.col(doc_id).cast("string"), F.lit(NONE))))


def leaf_cuts(
    sized: DataFrame, levels: Sequence[str], weights: Mapping[str, float], share: float, epochs: int, seed: int, doc_id: str
) -> DataFrame:
    """For each leaf: ``tokens``, ``leaf_budget``, the epochs read in full, and the first key that the next does not reach.

    ``sized`` is a narrow table of id, levels and ``n_tokens``. A large leaf spreads over many tasks: keys are summed up
    over the whole table, range-partitioned by leaf and key, less what lies before the leaf.
    """
    leaves = sized.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    dealt = durable(
        budgets(leaves, levels, weights, share, epochs).withColumn(
            "full", F.when(F.col("tokens") > 0, F.expr("leaf_budget div tokens")).otherwise(F.lit(0)).cast("long")
        )
    )
    keyed = sized.join(dealt.select(*levels, "full"), list(levels)).select(
        *levels, F.col("n_tokens").alias("_n"), order_key(seed, "full", doc_id).alias("_key")
    )
    placed = prefix_sums(keyed, [*levels, "_key"], ["_n"])
    starts = placed.groupBy(*levels).agg(F.min("_n_before").alias("_start"))
    room = F.col("leaf_budget") - F.col("full") * F.col("tokens")
    over = (
        placed.join(starts.join(dealt, list(levels)), list(levels))
        .where(F.col("_n_before") - F.col("_start") + F.col("_n") > room)
        .groupBy(*levels)
        .agg(F.min("_key").alias("cut"))
    )
    return dealt.join(over, list(levels), "left")


def mix(
    docs: DataFrame,
    levels: Sequence[str],
    tokens: str,
    weights: Mapping[str, float],
    share: float = 1.0,
    epochs: int = 2,
    seed: int = 0,
    doc_id: str = "doc_id",
) -> DataFrame:
    """Add to each document ``n_tokens``, the ``leaf_budget`` of its leaf, and ``copies``: how often it is taken.

    ``levels`` name the columns of the tree from the root down, ``tokens`` is an SQL expression. A leaf's budget is read
    from its documents in an order shuffled anew for each epoch: whole epochs first, then as many documents of the next
    as fit. No leaf is read more than ``epochs`` times. Rows with one id are taken together; a null level is a node of
    its own, ``(none)``; a document without tokens costs nothing; a leaf without tokens gets nothing; no documents give no
    rows. Columns named like the added ones are replaced.
    """
    known = docs.drop(*ADDED)
    paths = [f"_level{i}" for i in range(len(levels))]
    named = leveled(known.withColumns({p: F.col(c) for p, c in zip(paths, levels, strict=True)}), paths)
    counted = named.withColumn("n_tokens", F.coalesce(F.expr(tokens).cast("long"), F.lit(0).cast("long")))
    sized = durable(counted.select(doc_id, *paths, "n_tokens"))
    cuts = leaf_cuts(sized, paths, weights, share, epochs, seed, doc_id)
    return _taken(counted, cuts, paths, seed, doc_id).drop(*paths)


def _taken(counted: DataFrame, cuts: DataFrame, paths: list[str], seed: int, doc_id: str) -> DataFrame:
    working = {c: f"_{c}" for c in ("tokens", "full", "cut")}
    dealt = counted.join(cuts.withColumnsRenamed(working), paths)
    some = F.col("leaf_budget") > F.col("_full") * F.col("_tokens")
    inside = some & (F.col("_cut").isNull() | (order_key(seed, "_full", doc_id) < F.col("_cut")))
    return dealt.withColumn("copies", (F.col("_full") + inside.cast("long")).cast("int")).drop(*working.values())
