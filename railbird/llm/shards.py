"""Contiguous shards of nearly equal bytes, cut from global prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railbird.operators.groups import durable


def prefix_sums(df: DataFrame, order: list[str], weights: list[str]) -> DataFrame:
    """Add for each weight ``w`` the columns ``w_before``, its sum over the rows earlier in ``order``, and ``w_total``.

    Rows are range-partitioned by the order (ties cut at will, so that a value many rows share spreads over tasks) and
    fixed in the shared folder. Each partition is summed by itself; the totals of the partitions, as many as the shuffle
    has, are summed in turn and added. ``df`` should be narrow, as it is written once.
    """
    dealt = durable(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*order, "_tie")
        .withColumn("_part", F.spark_partition_id())
    )
    sums = [F.sum(w).alias(f"_sum_{w}") for w in weights]
    # from here on one row for each partition of the shuffle
    parts = dealt.groupBy("_part").agg(*sums)
    upto, everything = Window.orderBy("_part"), Window.partitionBy()
    starts = parts.select(
        "_part",
        *[(F.sum(f"_sum_{w}").over(upto) - F.col(f"_sum_{w}")).alias(f"_start_{w}") for w in weights],
        *[F.sum(f"_sum_{w}").over(everything).alias(f"{w}_total") for w in weights],
    )
    inside = Window.partitionBy("_part").orderBy(*order, "_tie")
    return (
        dealt.withColumns({f"_upto_{w}": F.sum(w).over(inside) for w in weights})
        .join(starts, "_part")
        .withColumns({f"{w}_before": F.col(f"_start_{w}") + F.col(f"_upto_{w}") - F.col(w) for w in weights})
        .drop("_part", "_tie", *[f"_start_{w}" for w in weights], *[f"_upto_{w}" for w in weights])
    )


def byte_shards(df: DataFrame, shards: int, order: list[str], size: str) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1) and ``slot`` (the place in the shard, from 0) to the rows of a narrow table.

    The rows are laid out in ``order``, and a row goes to the shard in whose equal share of all bytes its middle byte
    lies. So shards are contiguous and their sizes are equal to within the rows that lie across a cut. Sizes must be
    positive. Equal rows are told apart at will; nulls come first in the order; no rows give no rows; columns named
    ``shard`` or ``slot`` are replaced.
    """
    sized = df.drop("shard", "slot").withColumns({"_bytes": F.col(size).cast("long"), "_rows": F.lit(1).cast("long")})
    placed = prefix_sums(sized, order, ["_bytes", "_rows"])
    # twice the place of the middle byte; decimals, since the product may not fit a long
    wide = "decimal(38,0)"
    placed = placed.withColumns(
        {
            "_middle": ((F.col("_bytes_before").cast(wide) * 2 + F.col("_bytes")).cast("decimal(28,0)") * F.lit(shards)).cast(wide),
            "_double": (F.col("_bytes_total").cast(wide) * 2).cast(wide),
        }
    )
    shard = F.expr("_middle div _double").cast("int")
    cut = placed.withColumn("shard", F.least(shard, F.lit(shards - 1)))
    firsts = cut.groupBy("shard").agg(F.min("_rows_before").alias("_first"))
    working = ["_middle", "_double"] + [f"{w}{end}" for w in ("_bytes", "_rows") for end in ("", "_before", "_total")]
    return cut.join(firsts, "shard").withColumn("slot", F.col("_rows_before") - F.col("_first")).drop("_first", *working)
