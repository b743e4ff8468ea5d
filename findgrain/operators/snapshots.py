"""What changed between full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findgrain.functions.paths import with_plain_path
from findgrain.session import through_table


def snapshot_order(snapshots: DataFrame, snapshot: str, taken: str) -> DataFrame:
    """``(snapshot, idx)``: position of each snapshot in time, from 0. One row a snapshot, as few as there are deliveries."""
    per = snapshots.where(F.col(snapshot).isNotNull()).groupBy(snapshot).agg(F.min(taken).alias("t"))
    return per.select(snapshot, (F.row_number().over(Window.orderBy(F.asc_nulls_first("t"), snapshot)) - 1).alias("idx"))


def snapshot_changes(
    snapshots: DataFrame,
    *,
    snapshot: str = "snapshot_id",
    taken: str = "taken_at",
    key: str = "path",
    seen: str = "walked_at",
    carry: list[str] | None = None,
) -> DataFrame:
    """``(snapshot, key, change)`` for each snapshot but the first against the one before; change is added, removed or changed.

    Per key, a window over the snapshots' positions: attribute hashes that lag differently are changes, gaps in the
    positions are removals and later additions. A hash is taken per attribute, and one that is unknown (null) on either side
    proves nothing, except for ``mtime_ns``, where null and a time differ.

    * Spellings of one path are one key; its plain form is put out. Rows without snapshot or key are left out.
    * Of the rows of one key in a snapshot the one seen last counts; on a tie the greatest attributes.
    * A removed key is reported under the later snapshot. One snapshot alone has no changes; neither has an empty table.
    * ``carry`` names columns of the winning row (such as ``root``) to keep; for removals those of the earlier snapshot.
    """
    carry = carry or []
    # hashes, not values: any attribute type takes eight bytes
    attrs = F.struct(
        F.col(seen).alias("seen"),
        F.when(F.col("size").isNotNull(), F.xxhash64("size")).alias("size"),
        F.when(F.col("content_hash").isNotNull(), F.xxhash64("content_hash")).alias("content"),
        F.expr("mtime_ns div 1000").alias("mtime"),
        *[F.col(c).alias(f"c_{c}") for c in carry],
    )
    # as a table: it is joined twice, and the listings need be read for it only once
    order = through_table(snapshot_order(snapshots, snapshot, taken), "snapshot-order")
    rows = snapshots.where(F.col(snapshot).isNotNull() & F.col(key).isNotNull()).select(F.col(snapshot).alias("snap"), F.col(key).alias("k"), attrs.alias("a"))
    rows = with_plain_path(rows, "k", "k")
    # partial aggregation first: a key walked very often is reduced before it is sent
    last = rows.groupBy("snap", "k").agg(F.max("a").alias("a"))
    last = last.join(order.select(F.col(snapshot).alias("snap"), "idx"), "snap").drop("snap")

    over = Window.partitionBy("k").orderBy("idx")
    states = (
        last.withColumn("was", F.lag("a").over(over))
        .withColumn("was_idx", F.lag("idx").over(over))
        .withColumn("next_idx", F.lead("idx").over(over))
    )
    differs = (
        F.coalesce(F.col("was.size") != F.col("a.size"), F.lit(False))
        | F.coalesce(F.col("was.content") != F.col("a.content"), F.lit(False))
        | ~F.col("was.mtime").eqNullSafe(F.col("a.mtime"))
    )
    kept = [F.col(f"a.c_{c}").alias(c) for c in carry]
    came = F.when(F.col("was_idx") == F.col("idx") - 1, F.when(differs, F.lit("changed"))).otherwise(F.lit("added"))
    events = states.select(
        "k",
        *kept,
        F.explode(
            F.array(
                F.struct(F.col("idx").alias("idx"), F.when(F.col("idx") > 0, came).alias("change")),
                F.struct(
                    (F.col("idx") + 1).alias("idx"),
                    F.when(F.col("next_idx").isNull() | (F.col("next_idx") > F.col("idx") + 1), F.lit("removed")).alias("change"),
                ),
            )
        ).alias("e"),
    ).where("e.change is not null")
    # a removal after the last snapshot has no later snapshot and falls out here
    return events.select(F.col("e.idx").alias("idx"), "k", "e.change", *carry).join(order, "idx").select(
        F.col(snapshot), F.col("k").alias(key), "change", *carry
    )


LISTS = {"added": "to_add", "removed": "to_delete", "changed": "to_update"}
#: Paths of one part of a list.
LIST_PART = 10_000


def list_sizes(changes: DataFrame, *, snapshot: str = "snapshot_id", root: str = "root", key: str = "path") -> DataFrame:
    """Numbers of paths to add, delete and update per root and later snapshot, with the first and last path of each list."""
    def of(kind: str, name: str):
        hit = F.col("change") == kind
        return [
            F.count(F.when(hit, 1)).alias(f"n_{name}"),
            F.min(F.when(hit, F.col(key))).alias(f"first_{name}"),
            F.max(F.when(hit, F.col(key))).alias(f"last_{name}"),
        ]

    return changes.groupBy(snapshot, root).agg(*[c for kind, name in LISTS.items() for c in of(kind, name)])


def reconciliation_lists(changes: DataFrame, *, snapshot: str = "snapshot_id", root: str = "root", key: str = "path", part: int = LIST_PART) -> DataFrame:
    """``(snapshot, root, list, part, paths)``: the lists to_add, to_delete and to_update of each root's diff, in order.

    A list of more than about ``part`` paths comes in several parts, dealt by a hash of the path, so that no task and no row holds
    more whatever the size of a root; a part is in order of its paths. Lists without paths have no row. A null root is a root.
    """
    named = changes.withColumn("list", F.element_at(F.create_map(*[F.lit(x) for pair in LISTS.items() for x in pair]), F.col("change")))
    by = [snapshot, root, "list"]
    # few rows: one a root, snapshot and list
    sizes = named.groupBy(*by).agg(F.count("*").alias("n")).select(*[F.col(c).alias(f"s_{c}") for c in by], F.greatest(F.ceil(F.col("n") / part), F.lit(1)).alias("parts"))
    same = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in by]
    dealt = named.join(sizes, same[0] & same[1] & same[2]).withColumn("part", (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % F.col("parts")).cast("int"))
    return dealt.groupBy(*by, "part").agg(F.sort_array(F.collect_list(key)).alias("paths"))
