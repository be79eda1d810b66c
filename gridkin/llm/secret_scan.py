"""Secret scans: candidates in every text, told apart by who owns them across the corpus.

Patterns give candidates and their places. Every candidate's value is hashed, and the hashes are
aggregated over the corpus by the distinct repositories and owners that hold them: a value that many
owners have, or many repositories of one owner, is a copied example; one that a single owner has in
few repositories looks live. The weak kind, a long run of token characters that mixes cases and
digits, becomes a span only where its value looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridkin.llm._common import shared_dir, written

#: Kinds in the order in which spans of one start are listed: pattern, the group that holds the
#: value, the characters that the value needs.
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: What the ownership counts can add.
WEAK = {"token": (r"[A-Za-z0-9+/_-]{24,}", 0, 24)}
#: Hexadecimal runs shorter than this cannot pass; asking for them in the pattern finds the same
#: matches, since a run is taken whole.
FASTER = {"hex": r"[0-9a-f]{32,}", "access": r"AKIA[A-Z0-9]{12,}"}
#: Owners that make a value a copied example, and repositories of one owner that do.
COPIED, COPIED_REPOSITORIES = 3, 20
#: Matches whose places are added up one by one.
PART = 256


def matches_of(text: Column, kind: str, pattern: str, group: int) -> list[Column]:
    """Columns whole, value and between of a kind: its leftmost, non-overlapping matches, their values, and
    the text around them. They stand in a projection of their own, so that each is computed once."""
    rx = F.lit(FASTER.get(kind, pattern))
    whole = F.regexp_extract_all(text, rx, F.lit(0))
    value = F.regexp_extract_all(text, rx, F.lit(group)) if group else F.lit(None).cast("array<string>")
    return [whole.alias(f"{kind}_whole"), value.alias(f"{kind}_value"), F.split(text, rx, -1).alias(f"{kind}_between")]


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def spans_of(kind: str, group: int, least: int) -> Column:
    """array<struct<start, stop, kind, value>> of the matches whose value is long enough; places in code points.

    The text between matches and the matches themselves add up to the places: within parts of PART
    matches first, then over the parts, so that the work stays near the number of matches.
    """
    whole, between = F.col(f"{kind}_whole"), F.col(f"{kind}_between")
    value = F.col(f"{kind}_value") if group else whole
    each = F.zip_with(F.zip_with(F.slice(between, 1, F.size(whole)), whole, lambda b, w: F.struct(F.char_length(b).alias("gap"), F.char_length(w).alias("n"))), value, lambda x, v: F.struct(x["gap"], x["n"], v.alias("value")))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + x["n"]
        return F.struct(stop.alias("at"), F.array_append(acc["found"], F.struct(start.alias("start"), stop.alias("stop"), x["value"].alias("value"))).alias("found"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,value:string>>").alias("found"))
    starts = F.sequence(F.lit(1), F.size(whole), F.lit(PART))
    parts = _let(each, lambda all_: F.transform(starts, lambda i: F.aggregate(F.slice(all_, i, F.lit(PART)), zero, add)))
    offset = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    offsets = lambda p: F.aggregate(p, offset, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["found"], acc["at"]).alias("found")))["found"]
    moved = lambda x, o: F.transform(x["found"], lambda s: F.struct((s["start"] + o).alias("start"), (s["stop"] + o).alias("stop"), s["value"].alias("value")))
    found = _let(parts, lambda p: F.flatten(F.zip_with(p, offsets(p), moved)))
    enough = F.filter(found, lambda s: F.char_length(s["value"]) >= least)
    named = F.transform(enough, lambda s: F.struct(s["start"], s["stop"], F.lit(kind).alias("kind"), s["value"]))
    return F.when(F.size(whole) > 0, named).otherwise(F.array().cast("array<struct<start:int,stop:int,kind:string,value:string>>"))


def _listed(spans: Column) -> Column:
    """kind:start:stop, by start, then kind as listed, joined by commas."""
    order = [*KINDS, *WEAK]

    def rank(kind: Column) -> Column:
        return F.coalesce(*(F.when(kind == k, F.lit(i)) for i, k in enumerate(order)))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), rank(s["kind"]).alias("b"), s["stop"].alias("c"), s["kind"].alias("d"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["d"], s["a"].cast("string"), s["c"].cast("string"))), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """digest, repositories, owners: how many distinct ones hold each value.

    candidates: digest, repository, owner. The counts are of distinct pairs, so that a value that is
    everywhere comes to one row for each repository and owner before it is counted.
    """
    held = candidates.groupBy("digest", "repository", "owner").agg(F.count(F.lit(1)).alias("n"))
    by_owner = held.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("digest").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def scan_secrets(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source"
) -> DataFrame:
    """One row for each row of docs: id, base (array of the spans that the patterns give), added (of the
    weak kind, that look live), n_assign, n_access, n_hex, n_copied and n_live (base spans whose value at
    least COPIED owners or COPIED_REPOSITORIES repositories have, and one owner alone has in fewer),
    base_text and spans (kind:start:stop, joined by commas: the base spans, and all).

    A null text counts as empty; a null repository or owner counts as one; repeated rows have a row
    each and count as one repository; an empty table gives none. The work grows with the length of a
    text, whatever number of matches it has. Where no column names repositories, a document is one. Spans of different kinds may overlap; a weak span that overlaps
    a base span is left out. Other columns are left alone.
    """
    folder = shared_dir(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = {**KINDS, **WEAK}
    matched = [c for k, (rx, group, _) in kinds.items() for c in matches_of(F.col("text"), k, rx, group)]
    parts = [spans_of(k, group, least).alias(k) for k, (_, group, least) in kinds.items()]
    own = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.col(repository_col).cast("string").alias("repository"), F.col(owner_col).cast("string").alias("owner"))
    found = own.select("id", "repository", "owner", *matched).select("id", "repository", "owner", *parts)
    mixed = lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]")
    base = F.concat(*KINDS)
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    found = found.withColumn("base", base).select(
        F.monotonically_increasing_id().alias("uid"), "id", "repository", "owner", "base",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.filter("token", lambda s: mixed(s["value"]) & free(s)).alias("weak"),
    )
    found = written(found, folder, "found")
    each = found.where("size(base) + size(weak) > 0").select(
        "uid", "repository", "owner", F.explode(F.concat("base", "weak")).alias("span")
    )
    each = each.select("uid", "repository", "owner", F.sha2("span.value", 256).alias("digest"), F.col("span.kind").alias("kind"), F.col("span.start").alias("start"), F.col("span.stop").alias("stop"))
    owned = ownership(each.select("digest", "repository", "owner"))
    known = each.join(owned, "digest")
    is_base = F.col("kind").isin(list(KINDS))
    copied = (F.col("owners") >= COPIED) | (F.col("repositories") >= COPIED_REPOSITORIES)
    live = (F.col("owners") == 1) & ~copied
    weak = F.when(~is_base & live, F.struct("start", "stop", "kind"))
    said = known.groupBy("uid").agg(
        F.count_if(is_base & copied).alias("n_copied"),
        F.count_if(is_base & live).alias("n_live"),
        F.collect_list(weak).alias("added"),  # the spans of one text
    )
    joined = found.join(said, "uid", "left")
    bare = F.transform("base", lambda s: F.struct(s["start"], s["stop"], s["kind"]))
    added = F.coalesce("added", F.array().cast("array<struct<start:int,stop:int,kind:string>>"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select(
        F.col("id").alias(id_col), "base", added.alias("added"), *(f"n_{k}" for k in KINDS), zero("n_copied"), zero("n_live"),
        _listed(bare).alias("base_text"), _listed(F.concat(bare, added)).alias("spans"),
    )
