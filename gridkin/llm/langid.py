"""Language identification in two levels: the family, then the language within it.

Texts become frequencies of hashed three-byte sequences of their letters. Families are told apart by
linear support vector machines, one for each two families; the languages of the winning family then
by machines of their own, one for each two of them. A vote goes to the winner of each machine, ties
to the larger sum of margins. Machines are trained in numpy by dual coordinate descent on a bounded
sample of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridkin.llm._common import find_package, give_back, literal_table, shared_dir, written
from gridkin.llm._words import blocks

#: Hashed features of a text.
FEATURES = 4096
#: Labelled texts that training uses at most, shared by the languages.
SAMPLE = 3000
#: Texts and bytes whose features are held at a time.
BLOCK_TEXTS, BLOCK_BYTES = 512, 1_000_000
UNKNOWN = "und"
#: Families of closely related languages (ISO 639-1), a fixed value; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "be"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "ur", "mr", "pa", "gu"),
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_HAS_LETTER = regex.compile(r"\p{L}")


def _letters() -> np.ndarray:
    table = np.full(256, 0x20, np.uint8)
    for i in (*range(0x61, 0x7B), *range(0x80, 0x100)):
        table[i] = i
    return table


_LETTER = _letters()


def features(texts: list[str]) -> np.ndarray:
    """Frequencies of the hashed three-byte sequences of each text; others than letters count as one space."""
    padded = [b" " + t.lower().encode("utf-8", "replace") + b" " for t in texts]
    buf = _LETTER[np.frombuffer(b"".join(padded), np.uint8)].astype(np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in padded])
    if len(buf) < 3:
        return np.zeros((len(texts), FEATURES), np.float32)
    a, b, c = buf[:-2], buf[1:-1], buf[2:]
    good = (owner[:-2] == owner[2:]) & ~((a == 0x20) & (b == 0x20)) & ~((b == 0x20) & (c == 0x20))
    code = ((a << 16) | (b << 8) | c) * np.uint32(0x9E3779B1)
    at = owner[:-2][good] * FEATURES + (code[good] >> np.uint32(32 - 12)).astype(np.int64)
    counts = np.bincount(at, minlength=len(texts) * FEATURES).reshape(len(texts), FEATURES)
    return (counts / np.maximum(counts.sum(1, keepdims=True), 1) * 10.0).astype(np.float32)


def svm(x: np.ndarray, own: np.ndarray, y: np.ndarray, cost: float = 20.0, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with hinge loss over the rows own of x; y: 1 or -1 for each.
    Rows are read in place; the bias is a further feature of 1."""
    norms, alpha = np.array([1.0 + float((x[i].astype(np.float64) ** 2).sum()) for i in own]), np.zeros(len(own))
    w, bias = np.zeros(x.shape[1]), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for k in rng.permutation(len(own)):
            row = x[own[k]].astype(np.float64)
            g = y[k] * (w @ row + bias) - 1.0
            new = min(max(alpha[k] - g / norms[k], 0.0), cost)
            if new != alpha[k]:
                step = (new - alpha[k]) * y[k]
                w += step * row
                bias += step
                moved = max(moved, abs(new - alpha[k]))
                alpha[k] = new
        if moved < 1e-3:
            break
    return np.append(w, bias)


@dataclass(frozen=True)
class Machines:
    """names, and for each two of them (first, second, weights): a positive margin is the first's."""

    names: tuple[str, ...]
    pairs: tuple[tuple[int, int], ...]
    weights: np.ndarray

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner, and how sure its closest decision is, from 0 to 1."""
        n = len(self.names)
        if n == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        margin = x @ self.weights[:-1] + self.weights[-1]
        votes, sums = np.zeros((len(x), n)), np.zeros((len(x), n))
        for k, (i, j) in enumerate(self.pairs):
            votes[:, i] += margin[:, k] >= 0
            votes[:, j] += margin[:, k] < 0
            sums[:, i] += margin[:, k]
            sums[:, j] -= margin[:, k]
        best = np.lexsort((sums, votes), axis=1)[:, -1]
        least = np.full(len(x), np.inf)
        for k, (i, j) in enumerate(self.pairs):
            least = np.where(best == i, np.minimum(least, margin[:, k]), np.where(best == j, np.minimum(least, -margin[:, k]), least))
        return best, 1.0 / (1.0 + np.exp(-np.clip(2.0 * least, -30, 30)))


def machines(x: np.ndarray, labels: np.ndarray, rows: np.ndarray | None = None) -> Machines:
    """One machine for each two labels of the rows (all of x if not given)."""
    rows = np.arange(len(x)) if rows is None else rows
    labels = labels[rows]
    names = tuple(sorted(set(labels)))
    pairs, weights = tuple(combinations(range(len(names)), 2)), []
    for i, j in pairs:
        own = np.flatnonzero((labels == names[i]) | (labels == names[j]))
        weights.append(svm(x, rows[own], np.where(labels[own] == names[i], 1.0, -1.0)))
    stacked = np.stack(weights, 1) if weights else np.zeros((FEATURES + 1, 0))
    return Machines(names, pairs, stacked.astype(np.float32))


@dataclass(frozen=True)
class LanguageModel:
    families: Machines
    within: dict[str, Machines]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; UNKNOWN and 0 where there is no letter."""
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        own = [i for i, t in enumerate(texts) if t and _HAS_LETTER.search(t)]
        if not own or not self.families.names:
            return langs, scores
        x = features([texts[i] for i in own])
        family, sure = self.families.decide(x)
        for f, name in enumerate(self.families.names):
            here = np.flatnonzero(family == f)
            if len(here):
                lang, more = self.within[name].decide(x[here])
                for k, i in enumerate(here):
                    langs[own[i]] = self.within[name].names[lang[k]]
                    scores[own[i]] = sure[i] * more[k]
        return langs, scores


def fit(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Train on rows whose language and text are not null: at most sample of them (two of each language
    at least), a like number of each language as far as it has distinct texts. They are drawn among the
    distinct texts of a language, those with the least hashes, so that copies count once."""
    spark = labelled.sparkSession
    find_package(spark)
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = rows.withColumn("u", F.xxhash64("text", F.lit(11)))
    distinct = written(rows.select("lang", "u").distinct(), shared_dir(spark), "hashes")
    counts = {r.lang: r.n for r in distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return LanguageModel(Machines((), (), np.zeros((FEATURES + 1, 0))), {})
    each = max(2, sample // len(counts))
    # a bound under which a language has `each` hashes or more but for six standard deviations
    most = each + 6 * each**0.5 + 20
    bounds = [(k, (1 << 63) - 1 if most >= n else int((most / n * 2 - 1) * (1 << 63))) for k, n in counts.items()]
    bound = literal_table(spark, bounds, [("of", "string"), ("most", "bigint")])
    least: dict[str, list] = {}
    for r in distinct.join(F.broadcast(bound), (F.col("lang") == F.col("of")) & (F.col("u") <= F.col("most"))).select("lang", "u").collect():
        least.setdefault(r.lang, []).append(r.u)
    ends = literal_table(spark, [(k, sorted(v)[:each][-1]) for k, v in least.items()], [("of", "string"), ("most", "bigint")])
    drawn = rows.join(F.broadcast(ends), (F.col("lang") == F.col("of")) & (F.col("u") <= F.col("most"))).select("lang", "u", "text")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, int]] = set()  # drawn texts: each * languages at most
        for batch in batches:
            new = []
            for lang, u, text in zip(batch["lang"], batch["u"], batch["text"], strict=True):
                if (lang, u) not in seen:
                    seen.add((lang, u))
                    new.append((lang, u, text))
            for at, some in blocks([text.encode() for _, _, text in new], BLOCK_BYTES, BLOCK_TEXTS):
                own = new[at : at + len(some)]
                x = [v.astype(np.float16).tobytes() for v in features([text for _, _, text in own])]
                yield pd.DataFrame({"lang": [lang for lang, _, _ in own], "u": [u for _, u, _ in own], "x": x})

    once = drawn.mapInPandas(extract, "lang string, u long, x binary").groupBy("lang", "u").agg(F.min("x").alias("x"))
    labels, x = [], np.empty((sum(len(v[:each]) for v in least.values()), FEATURES), np.float16)
    for r in once.orderBy("lang", "u").toLocalIterator():  # sample rows, of FEATURES halves each
        x[len(labels)] = np.frombuffer(bytes(r.x), np.float16)
        labels.append(r.lang)
    labels, x = np.array(labels, object), x[: len(labels)]
    family = np.array([_FAMILY_OF.get(lang, f"other {lang}") for lang in labels], object)
    model = LanguageModel(machines(x, family), {f: machines(x, labels, np.flatnonzero(family == f)) for f in set(family)})
    del x
    give_back()
    return model


def said_of(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """struct<lang_pred, score> of a text column: the text is read whole, in blocks of bounded size."""
    find_package(spark)
    shared = spark.sparkContext.broadcast(model)  # weights of a fixed size for each two languages

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.tolist()
            langs, scores = [], []
            for at, some in blocks([(t or "").encode() for t in texts], BLOCK_BYTES, BLOCK_TEXTS):
                lang, score = shared.value.predict(texts[at : at + len(some)])
                langs += lang
                scores += score.tolist()
            yield pd.DataFrame({"lang_pred": langs, "score": pd.Series(scores, dtype=float)})
        give_back()

    return F.pandas_udf(run, "lang_pred string, score double")(text)


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1).

    A null text, and one without a letter, is UNKNOWN with score 0, as is every text if nothing could
    be learned. Texts that tie go to the language that sorts last. Repeated rows get one answer each,
    an empty table gives no rows; a column of docs that is called lang_pred or score gives way.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    both = docs.select(F.struct(*(docs[c] for c in kept)).alias("row"), said_of(docs.sparkSession, model, docs[text_col]).alias("said"))
    return both.select(*(F.col("row")[c].alias(c) for c in kept), F.col("said.lang_pred"), F.col("said.score"))


def in_language(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is in some language, with their columns, whatever these are called."""
    return docs.where(said_of(docs.sparkSession, model, docs[text_col])["lang_pred"] != UNKNOWN)
