"""Input noise for self-supervised training, keyed by row so that a rerun gives the same noise."""

from __future__ import annotations

from collections.abc import Sequence

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortline.operators.ordering import running_totals

HEX = 8  # hex digits per draw: 32 bits
PER_DIGEST = 64 // HEX


def uniforms(keys: Sequence[str], seed: str, count: int) -> list[Column]:
    """``count`` draws in (0, 1) per row, eight from each SHA-256 of the row key."""
    row = [F.col(k).cast("string") for k in keys]
    digests = [
        F.sha2(F.concat_ws("|", *row, F.lit(f"{seed}.{block}")), 256) for block in range(-(-count // PER_DIGEST))
    ]
    draws = []
    for i in range(count):
        piece = F.substring(digests[i // PER_DIGEST], 1 + HEX * (i % PER_DIGEST), HEX)
        draws.append((F.conv(piece, 16, 10).cast("double") + 0.5) / float(16**HEX))
    return draws


def mask_noise(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    mask_rate: float = 0.25,
    noise_std: float = 0.05,
    seed: int = 42,
) -> DataFrame:
    """Set a share of the cells to zero, then add normal noise to every cell (Box-Muller)."""
    n = len(columns)
    masks, radius, angle = (uniforms(keys, f"{seed}.{name}", n) for name in ("mask", "radius", "angle"))
    noisy = {}
    for i, c in enumerate(columns):
        kept = F.when(masks[i] < mask_rate, F.lit(0.0)).otherwise(F.col(c).cast("double"))
        normal = F.sqrt(-2.0 * F.log(radius[i])) * F.cos(2.0 * math.pi * angle[i])
        noisy[c] = kept + normal * noise_std
    return df.withColumns(noisy)


#: Rows that share a window; every row reaches its donors however the blocks are cut.
RING_BLOCK = 4096


def swap_noise(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], swap_rate: float = 0.3, seed: int = 42
) -> DataFrame:
    """Replace a share of the cells by the same column's value in another, randomly chosen row.

    The rows form a ring in hash order. Column ``i`` borrows from the row ``i + 1`` places further (modulo the other
    rows, if the table is smaller than that), so columns do not share a donor and every row has one; a single row keeps its
    values. Blocks of the ring are windows; the first rows of a block are copied to the end of the block before it.
    """
    order = F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(f"{seed}.order")), 256)
    placed = running_totals(df.withColumns({"_order": order, "_one": F.lit(1)}), ["_order"], ["_one"])
    n = placed.count()
    if n < 2:
        return df
    last = (n - 1) // RING_BLOCK
    reach = min(len(columns), n - 1)
    place = F.col("_one_before")
    block = F.floor(place / RING_BLOCK)
    rows = placed.withColumns({"_block": block, "_place": place, "_copy": F.lit(False)})
    heads = rows.where(place - F.col("_block") * RING_BLOCK < reach).withColumns(
        {
            "_copy": F.lit(True),
            "_place": F.when(F.col("_block") == 0, F.col("_place") + n).otherwise(F.col("_place")),
            "_block": F.when(F.col("_block") == 0, F.lit(last)).otherwise(F.col("_block") - 1),
        }
    )
    # If the last block is shorter than the reach, the ring goes on with the first rows after it, which it holds, too;
    # the block before it needs those as well.
    far = heads.where((F.col("_place") >= n) & (F.col("_block") == last) & F.lit(last > 0)).withColumn("_block", F.lit(last - 1))
    ring = W.partitionBy("_block").orderBy("_place", "_order")
    swaps = uniforms(keys, f"{seed}.swap", len(columns))
    out = {}
    for i, c in enumerate(columns):
        donor = F.lead(F.struct(F.col(c).alias("v")), i % (n - 1) + 1).over(ring)
        out[c] = F.when((swaps[i] < swap_rate) & donor.isNotNull(), donor["v"]).otherwise(F.col(c))
    mixed = rows.unionByName(heads).unionByName(far).withColumns({f"_swapped_{c}": v for c, v in out.items()})
    return mixed.where("NOT _copy").select(*[F.col(f"_swapped_{c}").alias(c) if c in out else F.col(c) for c in df.columns])
