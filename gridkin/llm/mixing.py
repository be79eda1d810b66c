"""Mixing sources to target weights by entropy balancing.

Targets: sources share a part of all words by weight, none above CAP times what it has; what is
over is shared again among the rest. Rates: within a source, the rates nearest to even ones (in
relative entropy between 0 and CAP) that meet the token constraint tilt exponentially with the
length of a document, rate = CAP / (1 + exp(-tilt * size / scale)). The dual is convex with one
tilt for each source; each Newton step needs two sums for each source, taken by one distributed
aggregation over the counts of (source, size). Copies: a document takes the whole part of its rate
and, where a number drawn from its id falls under the rest, one copy more; a threshold for each
source, found from a histogram, moves that draw until the words taken meet the target; of the
documents in its bin, the first by draw take a whole copy while the target is not passed, and of all
that then take none more, the one whose size is nearest to what is left takes one, if that helps.

All sums are of whole numbers, so that a second run gives the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridkin.llm._common import literal_table, shared_dir, written

#: Characters that part words.
WORD = r"[^\x20\x09-\x0D]+"
#: No document and no source is taken more often.
CAP = 2
#: Bins of the draw in which the threshold is sought.
BINS = 1 << 16
#: Fine bins of a coarse one.
SPREAD = 1 << 8
#: The sums of Newton's method count in these parts of a word.
UNIT = 1 << 16
#: Sources that a mix may have: their names and tilts are kept on the driver.
MAX_SOURCES = 100_000


def targets(sizes: list[int], weights: list[float], share: float) -> list[float]:
    """Words for each source: share of all words by weight, at most CAP * size, the excess reshared."""
    left, open_, found = share * sum(sizes), [i for i, n in enumerate(sizes) if n], [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > CAP * sizes[i]]
        if not full:
            for i in open_:
                found[i] = unit * weights[i]
            break
        for i in full:
            found[i] = float(CAP * sizes[i])
            left -= found[i]
        open_ = [i for i in open_ if i not in set(full)]
    return found


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def draw(id_: Column, size: Column) -> Column:
    """A number in [0, 1) that depends on the id and the size alone."""
    return F.pmod(F.xxhash64(id_, size), F.lit(1 << 40)) / float(1 << 40)


def rate(size: Column, plan: DataFrame) -> Column:
    tilted = CAP / (1.0 + F.exp(-plan["tilt"] * size / plan["scale"]))
    return F.when(plan["full"], F.lit(float(CAP))).otherwise(tilted)


def place_of(size: Column, u: Column, plan: DataFrame) -> Column:
    """Where a document stands in its source's draw: the lower, the sooner it takes one copy more."""
    r = rate(size, plan)
    return u - (r - F.floor(r))


def bin_of(size: Column, u: Column, plan: DataFrame) -> Column:
    return F.floor((place_of(size, u, plan) + 1.0) * (BINS // 2)).cast("int")


def newton(sized: DataFrame, tilts: dict[int, dict], steps: int = 60) -> None:
    """Set the tilt of each entry of tilts (index of the source: scale, target, tilt, lo, hi).

    sized: index, size, n. A step that leaves the bracket (lo, hi) is replaced by its middle.
    """
    spark, todo = sized.sparkSession, set(tilts)
    for _ in range(steps):
        if not todo:
            return
        now = literal_table(
            spark, [(i, tilts[i]["tilt"], tilts[i]["scale"], False) for i in sorted(todo)],
            [("i", "int"), ("tilt", "double"), ("scale", "double"), ("full", "boolean")],
        )
        joined = sized.join(F.broadcast(now), sized["index"] == now["i"])  # MAX_SOURCES rows at most
        r = rate(F.col("size"), now)
        slope = F.col("size") * F.col("size") / now["scale"] * r * (1.0 - r / CAP)
        whole = lambda x: F.sum((F.col("n") * F.round(x * UNIT)).cast("decimal(38,0)"))
        for row in joined.groupBy("i").agg(whole(F.col("size") * r).alias("f"), whole(slope).alias("d")).collect():
            t = tilts[row.i]
            off, d = float(row.f) / UNIT - t["target"], float(row.d) / UNIT
            t["lo" if off < 0 else "hi"] = t["tilt"]
            if abs(off) <= max(0.5, 1e-7 * t["target"]):
                todo.discard(row.i)
                continue
            step = t["tilt"] - off / d if d > 0 else math.inf
            if not t["lo"] < step < t["hi"]:
                lo, hi = t["lo"], t["hi"]
                step = (lo + hi) / 2 if math.isfinite(lo + hi) else 2 * t["tilt"] + (1 if off < 0 else -1)
            if step == t["tilt"]:
                todo.discard(row.i)
            t["tilt"] = step


def _crossing(rows: DataFrame, place: str, need: DataFrame) -> list[tuple[int, int, int]]:
    """(index, place, what is still needed there) where the running sum of w passes what is needed. need: i, need."""
    upto = F.sum("w").over(Window.partitionBy("index").orderBy(place))
    placed = rows.withColumn("upto", upto).join(F.broadcast(need), F.col("index") == F.col("i"))  # MAX_SOURCES rows at most
    over = placed.where("upto > need and w > 0").groupBy("index").agg(F.min_by(F.struct(place, (F.col("need") - F.col("upto") + F.col("w")).alias("rest")), place).alias("c"))
    return [(r["index"], int(r.c[0]), int(r.c[1])) for r in over.collect()]


def fit_mix(rows: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """One row for each source: source, source_size, target, tilt, scale, full, cut (bin of the
    threshold), last (the last place in that bin that takes a copy; -2 where none does), extra and
    extra_size (place and size of one more document that takes a copy; -2 and 0 where none does).

    rows: source, size, u (see draw()), as a written table.
    """
    spark, folder = rows.sparkSession, shared_dir(rows.sparkSession)
    counted = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), folder, "counted")
    n, size = F.col("n").cast("decimal(38,0)"), F.col("size")
    sums = counted.groupBy("source").agg(F.sum(n * size).alias("size"), F.sum(n * size * size).alias("sq"))
    found = sums.orderBy(F.col("source").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = [int(r["size"] or 0) for r in found]
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share)
    schema = [("source", "string"), ("index", "int"), ("source_size", "bigint"), ("target", "double"), ("tilt", "double"), ("scale", "double"), ("full", "boolean")]
    full = [t >= CAP * n for t, n in zip(want, sizes, strict=True)]
    scale = [float(r.sq) / n if n else 1.0 for r, n in zip(found, sizes, strict=True)]
    names = literal_table(spark, [(r.source, i) for i, r in enumerate(found)], schema[:2])
    keyed = rows.join(F.broadcast(names), rows["source"].eqNullSafe(names["source"])).select("index", "size", "u")
    tilts = {
        i: {"target": want[i], "scale": scale[i], "tilt": 0.0, "lo": -math.inf, "hi": math.inf}
        for i in range(len(found)) if not full[i] and want[i] > 0
    }
    sized = counted.where("size > 0").join(F.broadcast(names), counted["source"].eqNullSafe(names["source"])).select("index", "size", "n")
    newton(written(sized, folder, "sized"), tilts)
    base = literal_table(
        spark, [(r.source, i, sizes[i], want[i], tilts[i]["tilt"] if i in tilts else 0.0, scale[i], full[i]) for i, r in enumerate(found)], schema
    )
    rated = keyed.join(F.broadcast(base), "index").withColumn("b", bin_of(keyed["size"], keyed["u"], base))
    sure = (F.floor(rate(keyed["size"], base)) * keyed["size"]).cast("long")
    bins = written(rated.groupBy("index", "b").agg(F.sum(keyed["size"]).alias("w"), F.sum(sure).alias("sure")), folder, "bins")
    wanted = literal_table(spark, [(i, want[i]) for i in range(len(found))], [("i", "int"), ("target", "double")])
    # the threshold's coarse bin first, then the bin within it: SPREAD rows of a source at most meet in one task
    coarse = bins.groupBy("index", F.floor(F.col("b") / SPREAD).alias("c")).agg(F.sum("w").alias("w"), F.sum("sure").alias("sure"))
    taken = coarse.groupBy("index").agg(F.sum("sure").alias("sure")).join(F.broadcast(wanted), F.col("index") == F.col("i"))
    need = taken.select("i", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("sure")).alias("need"))
    cuts = _crossing(coarse.select("index", "c", "w"), "c", need)
    inside = literal_table(spark, cuts, [("i", "int"), ("at", "bigint"), ("need", "bigint")])
    fine = bins.join(F.broadcast(inside), (F.col("index") == F.col("i")) & (F.floor(F.col("b") / SPREAD) == F.col("at"))).select("index", "b", "w")
    cut = {i: (b, rest) for i, b, rest in _crossing(fine, "b", inside.select("i", "need"))}
    rated = rated.withColumn("place", place_of(keyed["size"], keyed["u"], base))
    edge = literal_table(spark, [(i, *c) for i, c in cut.items()], [("i", "int"), ("cut", "int"), ("rest", "bigint")])
    within = rated.join(F.broadcast(edge), (F.col("index") == F.col("i")) & (F.col("b") == F.col("cut")))  # one bin of each source
    summed = within.groupBy("i", "rest", "place").agg(F.sum("size").alias("w"))
    summed = summed.withColumn("upto", F.sum("w").over(Window.partitionBy("i").orderBy("place"))).where("upto <= rest")
    last = {r.i: (r.c.place, r.c.upto) for r in summed.groupBy("i").agg(F.max(F.struct("place", "upto")).alias("c")).collect()}
    left = {i: c[1] - last.get(i, (-2.0, 0))[1] for i, c in cut.items()}
    open_ = [(i, cut[i][0], last.get(i, (-2.0, 0))[0], n) for i, n in left.items() if n > 0]
    edge = literal_table(spark, open_, [("i", "int"), ("cut", "int"), ("last", "double"), ("left", "bigint")])
    after = rated.join(F.broadcast(edge), F.col("index") == F.col("i")).where("size > 0 and (b > cut or b = cut and place > last)")
    near = after.groupBy("i").agg(F.min(F.struct(F.abs(F.col("size") - F.col("left")).alias("off"), "place", "size")).alias("c")).collect()
    some = literal_table(spark, [(r.i, r.c.place, r.c["size"]) for r in near], [("i", "int"), ("at", "double"), ("of", "bigint")])
    same = rated.join(F.broadcast(some), F.expr("index = i and place = at and size = of"))  # more than one where an id repeats
    found_extra = same.groupBy("i", "at", "of").agg(F.sum("size").alias("w")).collect()
    extra = {r.i: (r["at"], r["of"]) for r in found_extra if abs(r.w - left[r.i]) < left[r.i]}
    return literal_table(
        spark,
        [(r.source, sizes[i], want[i], tilts[i]["tilt"] if i in tilts else 0.0, scale[i], full[i], cut[i][0] if i in cut else 2 * BINS, last.get(i, (-2.0, 0))[0], *extra.get(i, (-2.0, 0))) for i, r in enumerate(found)],
        [schema[0], *schema[2:], ("cut", "int"), ("last", "double"), ("extra", "double"), ("extra_size", "bigint")],
    )


def apply_mix(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with source_size, target, rate and taken. rows: source, size, u and other columns."""
    named = plan.withColumnRenamed("source", "_mixed")
    joined = rows.join(F.broadcast(named), rows["source"].eqNullSafe(named["_mixed"]))  # MAX_SOURCES rows at most
    size, r, b = rows["size"], rate(rows["size"], named), bin_of(rows["size"], rows["u"], named)
    place = place_of(size, rows["u"], named)
    more = (b < named["cut"]) | ((b == named["cut"]) & (place <= named["last"])) | ((place == named["extra"]) & (size == named["extra_size"]))
    part = F.when(more, size).otherwise(0)
    taken = F.when(named["full"], CAP * size).otherwise(F.least(CAP * size, F.floor(r) * size + part)).cast("long")
    return joined.select(*(rows[c] for c in rows.columns), named["source_size"], named["target"], r.alias("rate"), taken.alias("taken"))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5,
) -> DataFrame:
    """id, size (words of the text), source_size, target, rate and taken for each row of docs.

    taken counts words of whole copies; it is at most CAP * size, and the words that a source's
    documents take come as near to its target as whole copies at the threshold allow. A null text has no words and takes none; a null source is a
    source, the last; rows with one id and size draw alike; an empty table gives no rows.
    """
    folder = shared_dir(docs.sparkSession)
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"))
    rows = written(sized.withColumn("u", draw(F.col("id"), F.col("size"))), folder, "sizes")
    return apply_mix(rows, fit_mix(rows, weights=weights, share=share)).select(
        F.col("id").alias(id_col), "size", "source_size", "target", "rate", "taken"
    )


def mixed_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs as mixed: a row, with its text as it is, for each copy that its document takes."""
    folder = shared_dir(docs.sparkSession)
    own = docs.columns
    sized = docs.select(
        F.struct(*(docs[c] for c in own)).alias("row"), docs[id_col].alias("id"),
        docs[source_col].cast("string").alias("source"), words(docs[text_col]).alias("size"),
    ).withColumn("u", draw(F.col("id"), F.col("size")))
    plan = fit_mix(written(sized.select("source", "size", "u"), folder, "sizes"), **how)
    taken = apply_mix(sized, plan).where("taken > 0")
    copies = taken.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.floor(F.col("taken") / F.col("size")).cast("int"))))
    return copies.select(*(F.col(f"row.`{c}`").alias(c) for c in own))
