"""Applying a feed of inserts, updates and deletes as a signed multiset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEQ_BLOCK = 1 << 16


def apply_changes(
    changes: DataFrame,
    base: DataFrame | None = None,
    *,
    key: str = "doc_id",
    seq: str = "seq",
    image: str = "path",
    deletes: str = "is_delete",
    arrived: str = "received_at",
    block: int = SEQ_BLOCK,
) -> DataFrame:
    """Current state ``(key, image)`` after all changes are applied in order of ``seq``.

    Signed multiset: every deduplicated change adds its after-image once and takes its before-image away once;
    multiplicities are summed with those of ``base`` and rows above zero remain.

    * Copies of one ``seq`` count once; of copies that disagree the latest to arrive counts, then the greatest image.
    * Order of arrival does not matter. Rows without key, seq or delete flag change nothing.
    * A null image is an image like others. A delete of an absent key changes nothing.
    * Changes are newer than ``base`` whatever their seq. An empty feed returns ``base``; columns besides the named ones are ignored.

    The feed is cut into blocks of ``block`` consecutive seqs. Inside a block the before-image of a change is the one left
    by the change before; the first change of a key in a block gets it from that key's latest earlier block. So a key
    that owns a third of the feed is spread over all blocks, and what meets in one task is a block or one row a block.
    """
    rows = changes.select(
        F.col(key).alias("k"),
        F.col(seq).cast("long").alias("seq"),
        F.col(image).alias("image"),
        F.col(deletes).cast("boolean").alias("gone"),
        F.col(arrived).alias("arrived"),
    ).where("k is not null and seq is not null and gone is not null")
    rows = rows.withColumn("block", F.expr(f"(seq - pmod(seq, {block})) div {block}"))

    copies = Window.partitionBy("block", "seq").orderBy(
        F.desc_nulls_last("arrived"), F.desc_nulls_last("image"), F.desc("k"), F.desc("gone")
    )
    once = rows.repartition("block").withColumn("copy", F.row_number().over(copies)).where("copy = 1").drop("copy", "arrived")

    in_block = Window.partitionBy("block", "k").orderBy("seq")
    steps = (
        once.withColumn("was", F.lag(F.struct("image", "gone")).over(in_block))
        .withColumn("is_last", F.lead("seq").over(in_block).isNull())
        .where("is_last or was is null or was.gone <> gone or not (was.image <=> image)")
    )
    # Inside a block: before- and after-images whose sum is not zero already.
    inner = steps.where("was is not null").select(
        "k",
        F.explode(
            F.filter(
                F.array(
                    F.when(~F.col("was.gone"), F.struct(F.col("was.image").alias("image"), F.lit(-1).alias("m"))),
                    F.when(~F.col("gone"), F.struct(F.col("image"), F.lit(1).alias("m"))),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("x"),
    ).select("k", "x.image", "x.m")

    # Across blocks: each first change of a block meets the last image of the block before.
    edges = steps.where("is_last or was is null").select("k", "block", "seq", "image", "gone", F.col("was").isNull().alias("is_first"), "is_last")
    if base is not None:
        edges = edges.unionByName(
            base.select(F.col(key).alias("k"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("seq"), F.col(image).alias("image"), F.lit(False).alias("gone"), F.lit(False).alias("is_first"), F.lit(True).alias("is_last"))
            .where("k is not null")
        )
    by_key = Window.partitionBy("k").orderBy(F.asc_nulls_first("block"), F.asc_nulls_first("seq"))
    across = (
        edges.withColumn("was", F.lag(F.struct("image", "gone")).over(by_key))
        .where("is_first")
        .select(
            "k",
            F.explode(
                F.filter(
                    F.array(
                        F.when(F.col("was").isNotNull() & ~F.col("was.gone"), F.struct(F.col("was.image").alias("image"), F.lit(-1).alias("m"))),
                        F.when(~F.col("gone"), F.struct(F.col("image"), F.lit(1).alias("m"))),
                    ),
                    lambda x: x.isNotNull(),
                )
            ).alias("x"),
        )
        .select("k", "x.image", "x.m")
    )
    signed = inner.unionByName(across)
    if base is not None:
        signed = signed.unionByName(base.select(F.col(key).alias("k"), F.col(image).alias("image"), F.lit(1).alias("m")).where("k is not null"))
    return (
        signed.groupBy("k", "image")
        .agg(F.sum("m").alias("m"))
        .where("m > 0")
        .select(F.col("k").alias(key), F.col("image").alias(image))
    )
