"""Exact deduplication through an extendible-hash index kept on shared files.

Texts are normalised by lower-casing A-Z. The 64-bit hash of a text is its key in the index, the
leading bits of the key choose a directory slot, the slot names a bucket, and a bucket with more
keys than its capacity is split in two, which doubles the directory when the bucket already uses
all directory bits. Each bucket is a contiguous key range that one owner task processes: it chains
the entries whose keys collide. Entries differ in the bytes of their text: they come from an
aggregation whose grouping key is the whole normalised text, so that copies collapse before the
shuffle, in the task that reads them, and a group of any size costs one row for each task. An entry
holds the size of its group and the row that stays; every row of the corpus reads them from there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridkin.llm._common import ascii_lower, literal_table, partitions, shared_dir, written

#: Directory bits at most; a bucket that is overfull at this depth chains its surplus.
MAX_DEPTH = 16


@dataclass(frozen=True)
class Directory:
    """depth: leading key bits in use. slots[i]: bucket of the keys that begin with the bits of i.
    doublings: how often a split had to double the directory."""

    depth: int
    slots: tuple[int, ...]
    doublings: int


def build_directory(histogram: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> Directory:
    """Split overfull buckets until each holds at most capacity keys or uses max_depth bits.

    histogram: keys for each value of the leading max_depth bits.
    """
    depth, doublings, slots = 0, 0, [0]
    local = {0: 0}  # bits that a bucket uses
    first = {0: 0}  # the leading bits of its keys
    sums = [0]
    for i in range(2**max_depth):
        sums.append(sums[-1] + histogram.get(i, 0))

    def load(bucket: int) -> int:
        span = max_depth - local[bucket]
        return sums[(first[bucket] + 1) << span] - sums[first[bucket] << span]

    todo = [0]
    while todo:
        b = todo.pop()
        if load(b) <= capacity or local[b] == max_depth:
            continue
        if local[b] == depth:
            slots = [x for x in slots for _ in range(2)]
            depth += 1
            doublings += 1
        new = len(local)
        local[b] += 1
        first[b] *= 2
        local[new], first[new] = local[b], first[b] + 1
        width = depth - local[new]
        slots[first[new] << width : (first[new] + 1) << width] = [new] * (1 << width)
        todo += [b, new]
    return Directory(depth, tuple(slots), doublings)


def build_index(entries: DataFrame, folder: str, capacity: int) -> DataFrame:
    """The index: bucket, key, chain (place among the entries of a key, from 1), sha, size,
    keep_uid, keep_id.

    entries: uid, id, key, norm, one for each row of the corpus, as a written table.
    """
    spark = entries.sparkSession
    compared = entries.groupBy("key", "norm").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("id", "uid")).alias("keep"))
    compared = written(compared.select("key", F.sha2("norm", 256).alias("sha"), "size", "keep"), folder, "chains")
    bits = F.shiftrightunsigned("key", 64 - MAX_DEPTH).cast("int")
    seen = compared.groupBy(bits.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    directory = build_directory({r.slot: r.n for r in seen.collect()}, capacity)
    slots = literal_table(spark, list(enumerate(directory.slots)), [("slot", "int"), ("bucket", "int")])
    owned = (
        compared.withColumn("slot", _slot(directory))
        .join(F.broadcast(slots), "slot")  # 2 ** MAX_DEPTH rows at most
        .repartition(partitions(spark), "bucket")
    )
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("sha"))
    return written(
        owned.select("bucket", "key", chain.alias("chain"), "sha", "size", F.col("keep.uid").alias("keep_uid"), F.col("keep.id").alias("keep_id")),
        folder, "index",
    )


def _slot(directory: Directory) -> Column:
    return (F.shiftrightunsigned("key", 64 - directory.depth) if directory.depth else F.lit(0)).cast("int")


def exact_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, key: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """One row for each row of docs: its id, keep_id (the id of the row that stays), group_size, kept,
    text_sha256 and bucket and chain (of the index). Other columns of docs, whatever their names, are left alone.

    A null text counts as empty. Of rows with equal texts the one with the largest id stays; a null
    id is smaller than any other, and of rows that tie one stays. Texts of any length are compared
    whole. An empty table gives no rows. key: a 64-bit hash of a text.
    """
    folder = shared_dir(docs.sparkSession)
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    entries = docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
    entries = written(entries.select(F.monotonically_increasing_id().alias("uid"), "id", "norm", key(F.col("norm")).alias("key")), folder, "entries")
    index = build_index(entries, folder, capacity)
    rows = entries.select("uid", "id", "key", F.sha2("norm", 256).alias("sha"))
    return rows.join(index, ["key", "sha"]).select(
        F.col("id").alias(id_col), "keep_id", F.col("size").alias("group_size"),
        (F.col("uid") == F.col("keep_uid")).alias("kept"), F.col("sha").alias("text_sha256"), "bucket", "chain",
    )


def kept_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever these are called; of rows with one id
    and one text, one."""
    stay = exact_dedup(docs, id_col=id_col, text_col=text_col, capacity=capacity)
    one = stay.where("kept").select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha"))
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].alias("id"), ascii_lower(F.coalesce(docs[text_col], F.lit(""))).alias("norm"))
    own = own.withColumn("sha", F.sha2("norm", 256)).drop("norm")
    joined = own.join(one, own["id"].eqNullSafe(one["id"]) & (own["sha"] == one["sha"]), "left_semi")
    again = stay.where(F.col(id_col).eqNullSafe(F.col("keep_id")) & ~F.col("kept"))
    if not again.isEmpty():  # rows repeated with their ids: one of them stays
        joined = joined.dropDuplicates(["id", "sha"])
    return joined.select(*(F.col("row")[c].alias(c) for c in docs.columns))
