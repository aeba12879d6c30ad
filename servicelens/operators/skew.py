"""Join a long table to a keyed one when a few keys hold most of the long table's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SHARES = 1000


def join_counted_key(rows: DataFrame, keyed: DataFrame, key: str, count: str, spread_by: str,
                     build_keyed: bool = False) -> DataFrame:
    """Inner join of `rows` to `keyed`, which has one row per key with the key's count in `rows`.

    A key whose rows exceed 1/1000 of the total is cut into as many slices as it needs to get below
    that share. At most 1000 keys can be that frequent, so the list of them is safe to broadcast,
    and the slices add at most 1000 more rows to the keyed side. Every other key takes one slice.

    With `build_keyed` the keyed side is built, a share of the keys in each task. That is for rows that
    come from Python, whose size Spark underestimates: it might broadcast them.
    """
    share = F.ceil(keyed.agg(F.sum(count)).scalar() / F.lit(_SHARES))
    frequent = (keyed.filter(F.col(count) > share)
                .select(key, F.ceil(F.col(count) / share).alias("_slices")))
    sliced = (keyed.join(F.broadcast(frequent), key, "left")
              .withColumn("_slice", F.explode(F.sequence(
                  F.lit(0), (F.coalesce("_slices", F.lit(1)) - 1).cast("int")))))
    slice_no = F.pmod(F.xxhash64(spread_by), F.coalesce("_slices", F.lit(1))).cast("int")
    spread = (rows.join(F.broadcast(frequent), key, "left")
              .withColumn("_slice", slice_no).drop("_slices"))
    sliced = sliced.drop("_slices")
    sliced = sliced.hint("shuffle_hash") if build_keyed else sliced
    return spread.join(sliced, [key, "_slice"]).drop("_slice")
