"""Byte-level BPE by Spark higher-order functions, over the distinct words of the corpus.

A text is cut into pieces by the tokenizer's pattern. The pieces' ids come from a fold: aggregate()
runs over the steps a piece can need, its state is the array of the piece's parts (at first its
bytes) as ids with the rank of every adjacent pair, and each step joins the leftmost pair of lowest
rank. The rank of a pair is also the id of what it becomes. The rank map is a literal: an array in
which the pairs of a left id lie at an offset of its own plus the right id, so that a lookup reads
two places. A piece that is itself in the vocabulary takes its id at once.

The pieces of all texts are counted; the most common (FREQUENT at most, by a threshold on the count)
are folded once, and their ids go to the readers of the texts as a table of that size. What a block
of texts has besides is folded where it stands, once for each distinct piece of a block. Decoding
looks up the bytes of each id and puts the binary pieces together, once for each distinct piece.

Pieces are found with array operations: characters are classed as letter, number, white space or
other, and the pattern's alternatives are boundaries between classes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridkin.llm._common import find_package, give_back, release, removed, shared_dir, written
from gridkin.llm._words import span_hashes

#: Pieces whose ids every reader of texts holds, at most.
FREQUENT = 1 << 19
#: Counts of pieces that the threshold tells apart: so many steps for each doubling.
STEPS = 16
#: Characters of text that are cut into pieces at a time.
BLOCK = 3_000_000
#: Bytes over which a piece is merged by a queue: a fold takes time in proportion to their square.
LONG_PIECE = 2000
#: Characters of a plan that Spark describes, so that the rank map is not kept as text for every query.
PLAN_CHARACTERS = 100_000
#: Of the second hash that pieces are known by.
SALT = 0x5D1B
#: Maps that the parts are dealt to.
MAPS = 1 << 13
#: The rank of no pair: above every rank.
NONE = 1 << 18

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: What the pattern's class for white space holds: the characters of property White_Space. A fixed value.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank of each part: lines of a base64 part and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.array([kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)], np.uint8)
    out[list(WHITE)] = SPACE
    return out


def piece_starts(chars: np.ndarray, new_text: np.ndarray) -> np.ndarray:
    """True where a piece begins. chars: code points of texts put together; new_text: True where one begins.

    The pattern: 's 't 're 've 'm 'll 'd; one space or none, then letters, numbers or others; white
    space but its last character if anything follows; white space.
    """
    n = len(chars)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[chars]
    begin = new_text.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    # the last of the white space before other characters parts from the rest of it
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~new_text[1:]
    begin |= last
    # and is part of the piece that follows if it is a space
    joined = np.zeros(n, bool)
    joined[1:] = last[:-1] & (chars[:-1] == 0x20)
    begin &= ~joined
    # a lone apostrophe that begins a piece takes certain letters with it
    at = np.flatnonzero(begin & (chars == 0x27))
    if len(at):
        ends = np.append(np.flatnonzero(new_text), n)
        left = ends[np.searchsorted(ends, at, "right")] - at  # characters up to the end of the text
        one, two = chars[np.minimum(at + 1, n - 1)], chars[np.minimum(at + 2, n - 1)]
        in1, in2 = left > 1, left > 2
        short = in1 & np.isin(one, [ord(c) for c in "stmd"])
        pairs = [(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")]
        long = in2 & np.logical_or.reduce(pairs)
        for where, k in ((at[short], 2), (at[long], 3)):
            begin[where + 1] = False
            if k == 3:
                begin[where + 2] = False
            end = where + k
            end = end[end < n]
            begin[end[~joined[end]]] = True
    return begin


@dataclass(frozen=True)
class Cut:
    """The pieces of some texts. buf: UTF-8 bytes of the texts put together; start, stop: where each distinct piece
    stands first; one: a 64-bit hash of each; codes: the distinct piece of each piece in turn; per_text:
    the number of pieces of each text."""

    buf: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    one: np.ndarray
    codes: np.ndarray
    per_text: np.ndarray

    def pieces(self, which: np.ndarray | None = None) -> list[bytes]:
        raw = self.buf.tobytes()
        start, stop = (self.start, self.stop) if which is None else (self.start[which], self.stop[which])
        return [raw[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]

    def two(self) -> np.ndarray:
        """Another hash of each distinct piece."""
        return span_hashes(self.buf, self.start, self.stop, SALT)


def distinct_pieces(texts: list[str]) -> Cut:
    lengths = np.array([len(t) for t in texts], np.int64)
    joined = "".join(texts)
    chars = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    none = np.zeros(0, np.int64)
    if not len(chars):
        return Cut(np.zeros(0, np.uint8), none, none, none.astype(np.uint64), none.astype(np.int32), np.zeros(len(texts), np.int64))
    ends = np.cumsum(lengths)
    new = np.zeros(len(chars), bool)
    firsts = (ends - lengths)[lengths > 0]
    new[firsts] = True
    begin = np.flatnonzero(piece_starts(chars, new))
    per_text = np.searchsorted(begin, ends) - np.searchsorted(begin, ends - lengths)
    if joined.isascii():
        buf, cuts = np.frombuffer(joined.encode(), np.uint8), np.append(begin, len(chars))
    else:
        buf = np.frombuffer(joined.encode("utf-8", "replace"), np.uint8)
        wide = np.cumsum((chars > 0x7F).astype(np.uint8) + (chars > 0x7FF) + (chars > 0xFFFF), dtype=np.int64)
        cuts = np.append(begin + np.where(begin > 0, wide[begin - 1], 0), len(buf))
    codes, one = pd.factorize(span_hashes(buf, cuts[:-1], cuts[1:]))
    first = np.zeros(len(one), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return Cut(buf, cuts[:-1][first], cuts[1:][first], one, codes.astype(np.int32), per_text)


@dataclass(frozen=True)
class Held:
    """Pieces that every reader of texts holds, by two hashes, as signed numbers: one (rising) and two; n: ids of each; said and plain:
    their decimal ids and their bytes, one after another, from said_at[i] to said_at[i + 1] and so on."""

    one: np.ndarray
    two: np.ndarray
    n: np.ndarray
    said: bytes
    said_at: np.ndarray
    plain: bytes
    plain_at: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> Held:
        """rows, by one: one, two, said, plain (binary) and n. The buffers of the columns are used as they are."""

        def parts(name: str) -> tuple[bytes, np.ndarray]:
            column = pa.concat_arrays(rows[name].chunks) if rows.num_rows else pa.array([], pa.binary())
            if not len(column):
                return b"", np.zeros(1, np.int32)
            return column.buffers()[2].to_pybytes(), np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)

        return Held(*(rows[c].to_numpy() for c in ("one", "two", "n")), *parts("said"), *parts("plain"))

    def places(self, cut: Cut) -> np.ndarray:
        """The place of each distinct piece, -1 for those that are not held."""
        if not len(self.one):
            return np.full(len(cut.one), -1, np.int64)
        one = cut.one.view(np.int64)
        at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
        return np.where((self.one[at] == one) & (self.two[at] == cut.two().view(np.int64)), at, -1)


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    some, n = [], 0
    for t in texts:
        if some and n + len(t) > BLOCK:
            yield some
            some, n = [], 0
        some.append(t)
        n += len(t)
    if some:
        yield some


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The rank of each pair of ids that together are a part."""
    found = {}
    for part, rank in ranks.items():
        for i in range(1, len(part)):
            left, right = ranks.get(part[:i]), ranks.get(part[i:])
            if left is not None and right is not None:
                found[left, right] = rank
    return found


def laid_out(pairs: dict[tuple[int, int], int], ids: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, places): the pair (a, b) has its rank r at places[offsets[a] + b], as a * 2 ** 17 + r; a place
    without a pair holds -1. The ids with most pairs are laid down first, each at an offset drawn until
    its pairs fall on free places."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for (a, b), r in pairs.items():
        rows.setdefault(a, []).append((b, r))
    rng, size = np.random.default_rng(seed), ids + 3 * len(pairs) + 1
    places, offsets = np.full(size + ids, -1, np.int64), np.full(ids, 1 << 30, np.int64)
    for a, own in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        right = np.array(own, np.int64)
        while True:
            drawn = rng.integers(0, size, 64)
            fits = np.flatnonzero((places[drawn[:, None] + right[:, 0]] < 0).all(1))
            if len(fits):
                break
        offsets[a] = drawn[fits[0]]
        places[offsets[a] + right[:, 0]] = (a << 17) + right[:, 1]
    return offsets, places


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The literal: bytes (id of each byte, null if it has none), offsets and places (see laid_out()), whole (ids
    of pieces that are parts, by their bytes as characters, dealt to maps by checksum)."""
    ids = max(ranks.values(), default=0) + 1
    if ids > 1 << 17:
        raise ValueError("a rank map has ids under 131,072")
    offsets, places = laid_out(pair_ranks(ranks), ids)
    maps: list[dict[str, int]] = [{} for _ in range(MAPS)]
    for part, rank in ranks.items():
        name = part.decode("latin-1")
        maps[zlib.crc32(name.encode()) % MAPS][name] = rank
    table = {"bytes": [ranks.get(bytes([i])) for i in range(256)], "offsets": offsets.tolist(), "places": places.tolist(), "whole": maps}
    return F.from_json(F.lit(json.dumps(table)), "bytes array<bigint>, offsets array<int>, places array<bigint>, whole array<map<string,int>>")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def folded(pieces: Column, ranks: Column) -> Column:
    """The ids of each piece of an array of strings (a character for each byte), in order: array<array<int>>.

    The rank map is bound to a variable, so that the plan holds it once.
    """
    return _let(ranks, lambda table: F.transform(pieces, lambda p: _folded(p, table)))


def _folded(piece: Column, table: Column) -> Column:
    """The state is an array with a number for each part, which holds the rank of the pair that the part begins
    (NONE for no pair), the part's place in the piece and its id: the least number is the leftmost pair of
    lowest rank."""
    id_bits, place_bits, last = 17, 23, F.lit((1 << 17) - 1).cast("long")
    low = F.lit((1 << (id_bits + place_bits)) - 1).cast("long")
    id_of = lambda x: x.bitwiseAND(last)
    rank_of = lambda x: F.shiftright(x, id_bits + place_bits)

    def pair(a: Column, b: Column) -> Column:
        """The rank of two ids, shifted to its place in a number."""
        held = F.get(table["places"], (F.get(table["offsets"], a.cast("int")) + b).cast("int"))
        return F.shiftleft(F.when(F.shiftright(held, id_bits) == a, held.bitwiseAND(last)).otherwise(F.lit(NONE).cast("long")), id_bits + place_bits)

    def joined(state: Column, at: Column, best: Column) -> Column:
        """The state after the pair at (from 1) has become one part, whose id is the pair's rank."""
        left, after = F.get(state, at - 2), F.get(state, at + 1)
        none = F.array().cast("array<bigint>")
        return F.concat(
            F.slice(state, F.lit(1), F.greatest(at - 2, F.lit(0))),
            F.when(at > 1, F.array(left.bitwiseAND(low).bitwiseOR(pair(id_of(left), rank_of(best))))).otherwise(none),
            F.array(
                F.when(after.isNull(), F.lit(NONE << (id_bits + place_bits))).otherwise(pair(rank_of(best), id_of(after)))
                .bitwiseOR(best.bitwiseAND(low).bitwiseAND(F.bitwise_not(last))).bitwiseOR(rank_of(best))
            ),
            F.slice(state, at + 2, F.size(state)),
        )

    def step(state: Column, _: Column) -> Column:
        def lowest(best: Column) -> Column:
            return F.when(rank_of(best) == NONE, state).otherwise(_let(F.array_position(state, best).cast("int"), lambda at: joined(state, at, best)))

        return _let(F.array_min(state), lowest)

    def fold(single: Column) -> Column:
        """single: the ids of the bytes."""
        after = F.slice(single, F.lit(2), F.size(single))
        rest = F.when(F.size(single) > 0, F.sequence(F.lit(0), F.size(single) - 1))
        near = F.zip_with(single, after, lambda a, b: F.when(b.isNull(), F.lit(NONE << (id_bits + place_bits))).otherwise(pair(a, b)).bitwiseOR(a))
        start = F.zip_with(near, rest, lambda x, i: x.bitwiseOR(F.shiftleft(i.cast("long"), id_bits)))
        return F.aggregate(F.sequence(F.lit(1), F.size(single)), start, step, lambda s: F.transform(s, lambda x: id_of(x).cast("int")))

    single = F.transform(F.filter(F.split(piece, ""), lambda c: c != ""), lambda c: F.get(table["bytes"], F.ascii(c)))
    whole = F.try_element_at(F.get(table["whole"], F.pmod(F.crc32(piece.cast("binary")), F.lit(MAPS)).cast("int")), piece)
    found = _let(single, lambda s: F.when(F.size(s) == 0, F.array().cast("array<int>")).otherwise(fold(s)))
    return F.coalesce(F.when(whole.isNotNull(), F.array(whole)), found)


def merged_by_queue(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece, by a queue of pairs: what the fold gives, for pieces of any length."""
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    gone = bytearray(n)
    while queue:
        _, i, stop = heapq.heappop(queue)
        j = after[i]
        if gone[i] or j >= n or end[j] != stop:  # one of the two has become part of something else
            continue
        gone[j], end[i], after[i] = 1, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < n and (r := ranks.get(piece[a : end[after[a]]])) is not None:
                heapq.heappush(queue, (r, a, end[after[a]]))
    return [ranks[piece[i : end[i]]] for i in range(n) if not gone[i]]


def count_pieces(docs: DataFrame) -> DataFrame:
    """piece (a character for each byte), n, over all texts. docs: text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for texts in _blocks([t or "" for t in batch["text"]]):
                cut = distinct_pieces(texts)
                if len(cut.one):
                    yield pd.DataFrame({"piece": [p.decode("latin-1") for p in cut.pieces()], "n": np.bincount(cut.codes, minlength=len(cut.one)).astype(np.int64)})
        give_back()

    return docs.mapInPandas(count, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))


def frequent_pieces(counted: DataFrame) -> DataFrame:
    """The pieces with the highest counts: as many classes of counts as have FREQUENT pieces at most."""
    height = F.floor(F.log2("n") * STEPS).cast("int")
    seen = {r.height: r.n for r in counted.groupBy(height.alias("height")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, left = max(seen, default=0) + 1, FREQUENT
    for h in sorted(seen, reverse=True):
        left -= seen[h]
        if left < 0:
            break
        least = h
    return counted.where((height >= least) & (F.char_length("piece") <= LONG_PIECE))


def decoded(ids: Column, table: Column) -> Column:
    """The bytes that an array of ids stands for. table: array of the hex of each id's bytes."""
    missing = F.raise_error(F.lit("an id has no part")).cast("string")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(table, i), missing)), ""))


def part_table(ranks: dict[bytes, int]) -> Column:
    parts = {v: k.hex() for k, v in ranks.items()}
    return F.from_json(F.lit(json.dumps([parts.get(i) for i in range(max(parts, default=-1) + 1)])), "array<string>")


def encode(docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256 (of the decimal ids, joined by one space), decoded_sha256 (of the
    decoded bytes) and, where asked for, ids (array<int>) for each row of docs.

    A null text counts as empty and has no ids; repeated rows each have a row; an empty table gives
    none; other columns are left alone. Texts and pieces of any length are encoded whole; a piece of more
    than LONG_PIECE bytes is merged by a queue in place of the fold.
    """
    spark = docs.sparkSession
    find_package(spark)
    if int(spark.conf.get("spark.sql.maxPlanStringLength").rstrip("b")) > PLAN_CHARACTERS:  # Spark keeps plans as text, literals too
        spark.conf.set("spark.sql.maxPlanStringLength", PLAN_CHARACTERS)
    ranks = read_ranks(ranks_path)
    table, parts = rank_map(ranks), part_table(ranks)
    give_back()
    folder = shared_dir(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    said = lambda ids: F.concat_ws(" ", ids.cast("array<string>"))
    counted = written(count_pieces(texts.select("text")), folder, "counts")
    known = frequent_pieces(counted).select("piece").repartition(2 * spark.sparkContext.defaultParallelism)
    known = known.select("piece", F.get(folded(F.array("piece"), table), 0).alias("ids"))
    known = written(known.select("piece", said(F.col("ids")).alias("said"), F.size("ids").alias("n"), _let(parts, lambda t: decoded(F.col("ids"), t)).alias("plain")), folder, "frequent")
    removed(spark, folder, "counts")
    release(spark)
    def hashed(salt: int) -> Column:
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                at = np.cumsum([0, *map(len, batch)])
                yield pd.Series(span_hashes(np.frombuffer(b"".join(batch), np.uint8), at[:-1], at[1:], salt).view(np.int64))

        return F.pandas_udf(run, "bigint")("piece")

    raw = known.select(F.encode("piece", "ISO-8859-1").alias("piece"), F.col("said").cast("binary").alias("said"), "plain", "n")
    raw = raw.select(hashed(0).alias("one"), hashed(SALT).alias("two"), "said", "plain", "n").orderBy("one")
    shared = spark.sparkContext.broadcast(Held.of(raw.toArrow()))  # FREQUENT rows at most
    long_ranks = spark.sparkContext.broadcast(ranks)
    give_back()
    release(spark)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent = shared.value
        for batch in batches:
            ids, all_texts, at = batch["id"].tolist(), [t or "" for t in batch["text"]], 0
            for some in _blocks(all_texts):
                own = distinct_pieces(some)
                place = frequent.places(own)
                is_long = (place < 0) & (own.stop - own.start > LONG_PIECE)
                rare, long = np.flatnonzero((place < 0) & ~is_long), np.flatnonzero(is_long)
                place[rare], place[long] = -1 - np.arange(len(rare)), -1 - len(rare) - np.arange(len(long))
                merged = [merged_by_queue(p, long_ranks.value) for p in own.pieces(long)] if len(long) else []
                yield pd.DataFrame({
                    "id": [ids[at : at + len(some)]], "per_text": [own.per_text], "codes": [own.codes.tobytes()], "place": [place.astype(np.int32).tobytes()],
                    "rare": [[p.decode("latin-1") for p in own.pieces(rare)]], "merged": [merged],
                })
                at += len(some)
        give_back()

    id_type = texts.schema["id"].dataType.simpleString()
    packed = texts.mapInPandas(cut, f"id array<{id_type}>, per_text array<bigint>, codes binary, place binary, rare array<string>, merged array<array<int>>")
    found = packed.withColumn("rest", F.concat(folded(F.col("rare"), table), "merged"))
    found = found.select(
        "id", "per_text", "codes", "place", F.transform("rest", said).alias("said"), F.transform("rest", F.size).alias("n"),
        _let(parts, lambda t: F.transform("rest", lambda ids: decoded(ids, t))).alias("plain"),
    )

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent = shared.value
        for batch in batches:
            for row in batch.itertuples(index=False):
                place = np.frombuffer(row.place, np.int32).astype(np.int64)
                rest, known = np.flatnonzero(place < 0), np.maximum(place, 0)
                many = frequent.n[known].astype(np.int64) if len(frequent.n) else np.zeros(len(place), np.int64)
                words, plain = ([blob[a:b] for a, b in zip(at[known].tolist(), at[known + 1].tolist(), strict=True)] if len(frequent.n) else [b""] * len(place)
                                for blob, at in ((frequent.said, frequent.said_at), (frequent.plain, frequent.plain_at)))
                many[rest] = np.asarray(row.n, np.int64)[-1 - place[rest]]
                for i, k in zip(rest.tolist(), (-1 - place[rest]).tolist(), strict=True):
                    words[i], plain[i] = row.said[k].encode(), row.plain[k]
                codes = np.frombuffer(row.codes, np.int32)
                out, at = [], 0
                for id_, n in zip(row.id, row.per_text, strict=True):
                    own = codes[at : at + n]
                    at += n
                    count, own = int(many[own].sum()), own.tolist()
                    line = b" ".join([words[c] for c in own])
                    out.append((
                        id_, count, hashlib.sha256(line).hexdigest(), hashlib.sha256(b"".join([plain[c] for c in own])).hexdigest(),
                        [int(i) for i in line.split()] if keep_ids else None,
                    ))
                yield pd.DataFrame(out, columns=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])
        give_back()

    done = found.mapInPandas(assemble, f"id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids array<int>")
    result = done.withColumnRenamed("id", id_col)
    return result if keep_ids else result.drop("ids")


def decode(rows: DataFrame, ranks_path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with the bytes that their ids stand for: binary pieces from a literal table, put together.
    Null ids decode to null, an empty array to no bytes; an id without a part fails the job."""
    plain = _let(part_table(read_ranks(ranks_path)), lambda t: decoded(F.col(ids_col), t))
    return rows.withColumn(out_col, F.when(F.col(ids_col).isNotNull(), plain))
