"""Shards of near-equal size: sampled splitters, quantile boundaries, range partitions.

Records are ordered by (hash of the text, hash of the id). A sample, drawn with a chance in
proportion to size, gives quantile boundaries; each range between two boundaries is then measured
exactly, and an overfull one is subdivided with boundaries from a sample of its own rows.
Boundaries lie between different texts, so that copies stay together; only a text whose copies
outweigh a whole shard is cut between ids. Ranges are a small part of a shard: consecutive ones fill
a shard up to its share, and those that would overfill it go, largest first, to the shards with most
room.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridkin.llm._common import shared_dir, written

#: Bytes that a record costs besides its text.
RECORD_BYTES = 16
#: Before any tie.
LEAST = -(1 << 63)
#: Sampled rows for each range wanted.
OVERSAMPLE = 8


def range_of(key: Column, tie: Column, bounds: list[tuple[int, int]]) -> Column:
    """How many of the sorted bounds are at or below (key, tie): a binary search."""
    if not bounds:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps([{"k": k, "t": t} for k, t in bounds])), "array<struct<k:bigint,t:bigint>>")
    here = F.struct(key.alias("k"), tie.alias("t"))

    def halve(a: Column, _: Column) -> Column:
        mid = F.shiftright(a["lo"] + a["hi"], 1)
        above = F.struct((mid + 1).alias("lo"), a["hi"].alias("hi"))
        below = F.struct(a["lo"].alias("lo"), mid.alias("hi"))
        return F.when(a["lo"] >= a["hi"], a).when(F.get(table, mid) <= here, above).otherwise(below)

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), halve, lambda a: a["lo"])


def quantile_bounds(sample: list[tuple[int, int, float]], part: float, split: set[int]) -> list[tuple[int, int]]:
    """Boundaries that cut the sorted (key, tie, weight) rows into parts of about one weight.

    A boundary stands before all rows of its key, unless the key is one of split.
    """
    seen, found, due, before = 0.0, set(), part, None
    for k, t, w in sorted(sample):
        if k != before and (k in split or before in split):
            found.add((k, LEAST))
        if seen >= due:
            found.add((k, t if k in split else LEAST))
            due = (int(seen / part) + 1) * part
        seen, before = seen + w, k
    return sorted(found)


def deal(sizes: list[int], n_shards: int) -> list[int]:
    """The shard of each range, in range order: large ranges first, each to the emptiest shard; the others fill
    the shards in turn, and what would overfill one goes where there is most room."""
    share, filled, at = sum(sizes) / n_shards, [0] * n_shards, [0] * len(sizes)

    def spread(ranges: list[int]) -> None:
        room = [(x, s) for s, x in enumerate(filled)]
        heapq.heapify(room)
        for i in sorted(ranges, key=lambda i: (-sizes[i], i)):
            x, s = heapq.heappop(room)
            at[i], filled[s] = s, x + sizes[i]
            heapq.heappush(room, (filled[s], s))

    spread([i for i, size in enumerate(sizes) if size > share / 4])
    shard, left = 0, []
    for i, size in enumerate(sizes):
        if size > share / 4:
            continue
        if filled[shard] + size > share:
            left.append(i)
            shard = min(shard + 1, n_shards - 1)
            continue
        filled[shard] += size
        at[i] = shard
    spread(left)
    return at


def _draw(rows: DataFrame, m: int, total: int, seed: int) -> DataFrame:
    """About m rows, each with a chance in proportion to its size; at most 2 m whose chance is 1 or less."""
    chance = F.least(F.lit(1.0), F.col("size") * m / total)
    u = F.pmod(F.xxhash64("key", "tie", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return rows.where(u < chance).withColumn("weight", F.col("size") / chance)


def find_ranges(rows: DataFrame, n_shards: int, ranges_per_shard: int, rounds: int = 6) -> tuple[list, list]:
    """Boundaries, and (size, rows) of each range between them. rows: key, tie, size."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [], []
    parts = n_shards * ranges_per_shard
    want = total / parts
    share = total / n_shards
    drawn = [(r.key, r.tie, r.weight) for r in _draw(rows, parts * OVERSAMPLE, total, 1).select("key", "tie", "weight").collect()]
    # a text that outweighs a shard, by its exact size, is the only kind that is parted from its copies
    weighs: dict[int, float] = {}
    for k, _, w in drawn:
        weighs[k] = weighs.get(k, 0.0) + w
    heavy = [k for k, w in weighs.items() if w > share / 2]  # 2 * n_shards, give or take the draw
    sized = rows.where(F.col("key").isin(heavy)).groupBy("key").agg(F.sum("size").alias("size")).collect() if heavy else []
    split = {r.key for r in sized if r["size"] > share}
    bounds = quantile_bounds(drawn, want, split)
    for seed in range(2, 2 + rounds):
        ranged = rows.withColumn("range", range_of(F.col("key"), F.col("tie"), bounds))
        seen = {
            r.range: r
            for r in ranged.groupBy("range").agg(
                F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), (F.min("key") == F.max("key")).alias("one"), F.min("key").alias("key")
            ).collect()
        }
        over = {i: r for i, r in seen.items() if r["size"] > 2 * want and r.n > 1 and (not r.one or r.key in split)}
        if not over or seed == 1 + rounds:
            break
        sub = _draw(ranged.where(F.col("range").isin(list(over))), parts * OVERSAMPLE, total, seed)
        found: dict[int, list] = {i: [] for i in over}
        for r in sub.select("range", "key", "tie", "weight").collect():
            found[r.range].append((r.key, r.tie, r.weight))
        more = {b for i, s in found.items() for b in quantile_bounds(s, want, split)}
        if more <= set(bounds):
            break
        bounds = sorted({*bounds, *more})
    count = [(int(seen[i]["size"]), int(seen[i].n)) if i in seen else (0, 0) for i in range(len(bounds) + 1)]
    return bounds, count


def shard(
    docs: DataFrame, *, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int = 64
) -> DataFrame:
    """id, size (UTF-8 bytes of the text and RECORD_BYTES), text_crc32, shard (from 0), slot (place
    in the shard, gapless from 0), for each row of docs. Sizes of shards are near equal; rows with one
    text share a shard unless they outweigh one.

    A null text counts as empty; null ids sort together; repeated rows get a slot each; an empty
    table gives no rows. Other columns are left alone. The driver holds the boundaries and counts
    of n_shards * ranges_per_shard ranges and a few sampled keys for each, whatever the input.
    """
    folder = shared_dir(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        docs.select(
            F.col(id_col).alias("id"), (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("key"), F.xxhash64(F.col(id_col)).alias("tie"),
        ), folder, "records",
    )
    bounds, count = find_ranges(rows, n_shards, ranges_per_shard)
    at = deal([s for s, _ in count], n_shards)
    base, filled = [], [0] * n_shards
    for (_, n), s in zip(count, at, strict=True):
        base.append(filled[s])
        filled[s] += n
    place = F.from_json(
        F.lit(json.dumps([{"s": s, "b": b} for s, b in zip(at, base, strict=True)])), "array<struct<s:int,b:bigint>>"
    )
    ranged = rows.withColumn("range", range_of(F.col("key"), F.col("tie"), bounds))
    in_range = F.row_number().over(Window.partitionBy("range").orderBy("key", "tie", "size")) - 1
    return ranged.withColumn("place", F.get(place, F.col("range"))).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("place.s").alias("shard"),
        (F.col("place.b") + in_range).cast("long").alias("slot"),
    )
