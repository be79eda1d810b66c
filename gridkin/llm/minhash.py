"""Near-duplicates by MinHash with tensored banding, verified on full shingle sets.

Each document has two small collections of hashes, every hash made of WIDTH minhashes. A table of
the index stands for a pair (i, j): its key combines hash i of the first collection with hash j of
the second. GROUPS hashes a side serve GROUPS ** 2 tables, so 2 * GROUPS * WIDTH minhashes are
computed where separate tables would need GROUPS times as many. Two documents of similarity s meet
in some table with probability (1 - (1 - s ** WIDTH) ** GROUPS) ** 2: all but 1 in 100,000 pairs at
s = 0.8, and more above.

Documents with one shingle set are one node. A bucket (the nodes with one key) links its members to
its smallest one, so that a bucket of true copies of any size costs one pair a member. What then
still lies in several components of a bucket is open: open nodes are first compared with the hubs of
the shingles they begin with, which brings copies together at a few pairs a node, and then an exact
filter gives the pairs across components that can be similar enough. In one order of all shingles, two sets of that
similarity share one of the first n - ceil(0.8 n) + 1 of each; the order puts rare shingles first,
and the sizes and the places of the shared shingle bound what two sets can have in common. So no
two members of a bucket stay apart unless a comparison says so, and none are compared in vain
because others of their bucket are copies. What is compared are the words of whole texts, not hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridkin.llm._common import find_package, give_back, release, removed, shared_dir, written
from gridkin.llm._graph import components
from gridkin.llm._words import blocks, mixed, span_hashes, spans

#: Hashes in each of the two collections, and minhashes in each hash.
GROUPS, WIDTH = 12, 2
#: Counters that order shingles by how common they are: a bound on what the driver holds.
COUNTERS = 1 << 18
#: Bits that tell rows that a join may need from others.
BITS = 1 << 24


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the sorted distinct shingle hashes of each text, one text after another."""
    low = [t.lower() for t in texts]  # of bytes: A-Z only
    buf = np.frombuffer(b" ".join(low) + b" ", np.uint8)
    lengths = np.array([len(t) + 1 for t in low], np.int64)
    ends_of = np.cumsum(lengths)
    white = (buf == 0x20) | ((buf >= 0x09) & (buf <= 0x0D))
    starts, ends = spans(~white)
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], ends_of])))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    words = span_hashes(buf, starts, ends)
    # shingles of width words; of a shorter text, the whole of it
    here = np.minimum(counts, width)
    n = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    first = np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(texts)), n)
    at = first[of] + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
    h = np.zeros(len(of), np.uint64)
    for k in range(width):
        live = here[of] > k
        h[live] = mixed(h[live] + words[at[live] + k], 0x5851F42D4C957F2D + k)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.bincount(of, minlength=len(texts))


def _per_text(h: np.ndarray, counts: np.ndarray, reduce: np.ufunc) -> np.ndarray:
    out = np.zeros(len(counts), np.uint64)
    full = counts > 0
    if full.any():
        out[full] = reduce.reduceat(h, (np.cumsum(counts) - counts)[full])
    return out


_RNG = np.random.default_rng(41)
#: An odd factor and a summand for each minhash: linear permutations of the 64-bit hashes, which are mixed already.
_FACTORS = _RNG.integers(0, 1 << 64, 2 * GROUPS * WIDTH, np.uint64) | np.uint64(1)
_SUMMANDS = _RNG.integers(0, 1 << 64, 2 * GROUPS * WIDTH, np.uint64)


def minhashes(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One row of 32-bit minhashes for each text."""
    out, space = np.zeros((len(counts), len(_FACTORS)), np.uint32), np.empty_like(h)
    for p, (factor, summand) in enumerate(zip(_FACTORS, _SUMMANDS, strict=True)):
        np.multiply(h, factor, out=space)
        space += summand
        out[:, p] = _per_text(space, counts, np.minimum) >> np.uint64(32)
    return out


def _signatures(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch["text"]]
            for at, some in blocks(texts):
                h, counts = shingle_sets(some, width)
                part = batch.iloc[at : at + len(some)]
                yield pd.DataFrame({
                    "id": part["id"].to_numpy(), "text_key": part["text_key"].to_numpy(), "n": counts.astype(np.int64),
                    "s1": _per_text(mixed(h, 0x1D8E4E27C47D124F), counts, np.add).view(np.int64),
                    "s2": _per_text(mixed(h, 0x60BEE2BEE120FC15), counts, np.add).view(np.int64),
                    "mins": list(minhashes(h, counts).view(np.int32)),
                })
        give_back()

    return run


def plain_set(text: str, width: int) -> frozenset[tuple[bytes, ...]]:
    """The shingles of a text, as words."""
    words = text.encode().lower().split()  # of bytes: A-Z only, ASCII white space only
    return frozenset(zip(*(words[i:] for i in range(width)))) if len(words) > width else frozenset([tuple(words)])


def _verify(width: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            linked, at, held = [], None, frozenset()
            for b, x, y in zip(batch["b"], batch["x"], batch["y"], strict=True):
                if b != at:
                    at, held = b, plain_set(y, width)
                own = plain_set(x, width)
                common = len(own & held)
                linked.append(100 * common >= percent * (len(own) + len(held) - common))
            yield batch.loc[np.array(linked, bool), ["a", "b"]]
        give_back()

    return run


def _hashed(batches: Iterator[pd.DataFrame], width: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Parts of batches with the shingle hashes of their texts, as shingle_sets() gives them."""
    for batch in batches:
        for at, some in blocks([t.encode() for t in batch["text"]]):
            yield batch.iloc[at : at + len(some)], *shingle_sets(some, width)


def _prefixes(width: int, percent: int, common):
    """The first shingles of each set in the order of common counters, then of the hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, h, n in _hashed(batches, width):
            seen, of = common.value[(h % np.uint64(COUNTERS)).astype(np.int64)], np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, seen, of))
            h, seen = h[order], seen[order]
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            # a shingle that one set has is nobody else's
            at = np.flatnonzero((place < (n + (-percent * n // 100) + 1)[of]) & (seen > 1))
            yield pd.DataFrame({
                "token": h[at].view(np.int64), "node": part["node"].to_numpy()[of[at]], "n": n[of[at]], "place": place[at],
                "component": part["component"].to_numpy()[of[at]],
            })
        give_back()

    return run


def _counters(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(COUNTERS, np.int64)
        for _, h, _ in _hashed(batches, width):
            counts += np.bincount((h % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        own = np.flatnonzero(counts)
        give_back()
        yield pd.DataFrame({"counter": own, "n": counts[own]})

    return run


def _collection(side: int) -> Column:
    """The hashes of a collection, as an array of struct<i, key>."""
    base = side * GROUPS * WIDTH
    hashes = [F.xxhash64(F.lit(side * GROUPS + i), *(F.get("mins", F.lit(base + i * WIDTH + k)) for k in range(WIDTH))) for i in range(GROUPS)]
    return F.array(*hashes)


def table_keys(nodes: DataFrame) -> DataFrame:
    """key, node: every combination of a hash of the first and one of the second collection that at
    least two nodes have. A hash that one node has makes no bucket of two, so it is not combined."""
    both = F.concat(
        F.transform(_collection(0), lambda k: F.struct(F.lit(0).alias("side"), k.alias("key"))),
        F.transform(_collection(1), lambda k: F.struct(F.lit(1).alias("side"), k.alias("key"))),
    )
    each = nodes.select("node", F.inline(both))
    seen = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    met = each.join(seen, "key")
    sides = met.groupBy("node").agg(*(F.collect_list(F.when(F.col("side") == s, F.col("key"))).alias(f"c{s}") for s in (0, 1)))  # GROUPS at most
    pairs = F.flatten(F.transform("c0", lambda a: F.transform("c1", lambda b: F.xxhash64(a, b))))
    return sides.select("node", F.explode(pairs).alias("key"))


def _linked(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, word by word."""
    x, y = (texts.select(F.col("node").alias(s), F.col("text").alias(c)) for s, c in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").mapInPandas(_verify(width, percent), "a bigint, b bigint")


def _among(keys: DataFrame, key: str):
    """Whether a number may be among those of a column: a bitmap of BITS bits goes to the tasks, so that most rows
    that no join would keep do not move."""
    place = F.pmod(F.xxhash64(key), F.lit(BITS))
    mask = F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))"))
    words = keys.select(place.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(mask.alias("mask")).toArrow()  # BITS / 64 rows at most
    bitmap = np.zeros(BITS // 64, np.uint64)
    bitmap[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    shared = keys.sparkSession.sparkContext.broadcast(bitmap)

    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for bits in batches:
            at = bits.to_numpy(np.int64)
            yield pd.Series((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return lambda column: F.pandas_udf(held, "boolean")(F.pmod(F.xxhash64(column), F.lit(BITS)))


def _pair(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _open_prefixes(keys: DataFrame, texts: DataFrame, found: DataFrame, width: int, percent: int, folder: str) -> DataFrame:
    """token, node, n, place, component and most for the first shingles of the open nodes: a node's set can be
    linked, over what begins with a token, with sets of at most so many shingles."""
    named = keys.select("key", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = named.groupBy("key").agg((F.min("component") != F.max("component")).alias("split")).where("split").select("key")
    rest = named.join(split, "key", "left_semi").select("node", "component").distinct()
    open_ = written(rest.join(texts, "node"), folder, "open")
    counted = open_.mapInPandas(_counters(width), "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # COUNTERS rows at most
    counts = np.zeros(COUNTERS, np.int64)
    counts[table["counter"].to_numpy()] = table["n"].to_numpy()
    common = open_.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))
    schema = "token bigint, node bigint, n bigint, place bigint, component bigint"
    first = written(open_.mapInPandas(_prefixes(width, percent, common), schema), folder, "first")
    common.unpersist()
    # a token and what follows it are n - place shingles, of which linked sets share percent * (n + other n) / (100 + percent)
    return first.withColumn("most", F.expr(f"(n - place) * {100 + percent} div {percent} - n"))


def _hub_pairs(first: DataFrame) -> DataFrame:
    """Pairs of each node with the hubs of its tokens: of the sets of like size that have a token, the one with the
    fewest shingles before it, which is the nearest to what they are copies of. Two pairs a token and node at most."""
    size = F.floor(F.log("n") / F.log(F.lit(1.25)))
    hub = F.min(F.struct("place", "node", "n", "most", "component")).alias("hub")
    hubs = first.groupBy("token", size.alias("own")).agg(hub).select("token", "hub", F.explode(F.array("own", F.col("own") + 1)).alias("size"))
    near = first.withColumn("size", size).join(hubs, ["token", "size"])
    near = near.where("component <> hub.component and n <= hub.most and hub.n <= most")
    return near.select(*_pair("node", "hub.node")).distinct()


def _open_pairs(first: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs that can be linked among open nodes, across components. At each token, the nodes outside the
    component that has most of its nodes meet all others; those of that component don't meet one another."""
    now = first.drop("component").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    reach = now.groupBy("token", "component").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least"), F.max("most").alias("most"))
    met = reach.groupBy("token").agg(
        (F.min("component") != F.max("component")).alias("met"), F.min("least").alias("least"), F.max("most").alias("widest"),
        F.max(F.struct("rows", "component"))["component"].alias("main"),
    )
    now = now.join(met.where("met").drop("met"), "token").where("least <= most and n <= widest")
    x, y = (now.select(*(F.col(c).alias(c + s) for c in ("token", "node", "n", "most", "component", "main"))) for s in "xy")
    apart = "tokenx = tokeny and componentx <> componenty and nx <= mosty and ny <= mostx and (nodex > nodey or componenty = mainy)"
    return x.where("componentx <> mainx").join(y, F.expr(apart)).select(*_pair("nodex", "nodey")).distinct()


def distinct_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that stay, with all their columns: those with the smallest id of their component,
    those without words, and those with a null id. Rows that share an id stay together."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **how)
    gone = found.where(~F.col("kept") & F.col(id_col).isNotNull()).select(F.struct(F.col(id_col)).alias("gone")).distinct()
    return docs.join(gone, F.struct(docs[id_col]) == gone["gone"], "left_anti")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """id, n_shingles, component_id, kept for each row of docs.

    Texts are lower-cased in A-Z and parted at ASCII white space; the set of a text is its distinct
    shingles of width words, of a shorter text the whole sequence. Two texts are linked if they have
    at least percent of the union of their sets in common. component_id is the smallest id that a
    row reaches over links, its own included; kept says that it is the row's own. A null or empty
    text has an empty set and is linked with nothing. Null ids name no component that has other
    ids; rows with one id keep their own texts and links. An empty table gives no rows. Other
    columns are left alone.
    """
    find_package(docs.sparkSession)
    folder = shared_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    id_type = rows.schema["id"].dataType.simpleString()
    signed = rows.mapInPandas(_signatures(width), f"id {id_type}, text_key bigint, n bigint, s1 bigint, s2 bigint, mins array<int>")
    signed = written(signed.withColumn("uid", F.monotonically_increasing_id()), folder, "signatures")
    classes = written(
        signed.where("n > 0").groupBy("s1", "s2").agg(F.min("uid").alias("node"), F.min("id").alias("low")), folder, "classes"
    )
    nodes = signed.join(classes.select(F.col("node").alias("uid")), "uid", "left_semi").withColumnRenamed("uid", "node")
    nodes = nodes.select("node", "id", "text_key", "n", "mins")
    keys = table_keys(nodes)
    shared = keys.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1")
    keys = written(keys.join(shared, "key").select("key", "node", "leader"), folder, "buckets")
    wanted = nodes.drop("mins").join(keys.select("node").distinct(), "node", "left_semi")
    nodes = written(wanted, folder, "nodes")
    rep = nodes.select("node", F.col("id").alias("_id"), F.col("text_key").alias("_key"))
    some = rows.where(_among(rep, "_key")(F.col("text_key")))
    texts = some.join(rep, (some["text_key"] == rep["_key"]) & some["id"].eqNullSafe(rep["_id"])).select("node", "text")
    texts = written(texts.dropDuplicates(["node"]), folder, "texts")

    size = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"))
    pairs = keys.where("node <> leader").select(*_pair("node", "leader")).distinct().join(size("a"), "a").join(size("b"), "b")
    pairs = pairs.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).select("a", "b")
    pairs = written(pairs, folder, "pairs")
    once = pairs.groupBy("a").agg(F.min("b").alias("b"))
    links = written(_linked(once, texts, width, percent), folder, "links")
    found = components(links, folder, "first")
    # copies are together now, so that their other leaders need no comparison
    of = lambda s: found.select(F.col("node").alias(s), F.col("component").alias(f"c_{s}"))
    named = pairs.join(once.select("a", F.col("b").alias("once")), "a").where("b <> once").join(of("a"), "a", "left").join(of("b"), "b", "left")
    apart = named.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
    links = links.union(written(_linked(apart, texts, width, percent), folder, "others"))
    found = components(links, folder, "second")
    release(docs.sparkSession)
    first = _open_prefixes(keys, texts, found, width, percent, folder)
    # what is a copy of a hub is in its component now, so that only what is not meets the rest
    hubs = written(_linked(_hub_pairs(first), texts, width, percent), folder, "hubs")
    if not hubs.isEmpty():
        links = links.union(hubs)
        found = components(links, folder, "third")
    more = written(_linked(_open_pairs(first, found), texts, width, percent), folder, "more")
    if not more.isEmpty():
        found = components(links.union(more), folder, "all")
    removed(docs.sparkSession, folder, "buckets", "nodes", "texts", "open", "first", "pairs", "links", "others", "hubs", "more")
    named = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of_class = named.join(lows, "component").select("s1", "s2", "component_id")
    out = signed.select("id", "n", "s1", "s2").join(of_class, ["s1", "s2"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))
