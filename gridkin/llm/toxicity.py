"""Toxicity by a bidirectional gated recurrent network over words, with attention pooling.

A word enters as the sum of an embedding of the word and the mean embedding of its character
sequences (of three lengths, with marks at both ends). Windows of WINDOW words that overlap by half
run through a gated recurrent unit in each direction; attention over their states gives a vector for
the window, and a linear unit its logit. A text scores as its most toxic window. The network is
trained in numpy by Adam on a bounded sample of labelled texts; in the loss, a text is toxic unless
none of its windows is.

Embeddings come from hashed tables, so that the model has one size whatever the vocabulary. Input
projections are computed once for each distinct word of a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridkin.llm._common import find_package, shared_dir, written
from gridkin.llm._words import blocks, mixed, span_hashes, spans

#: Words of a window, and words from one window's start to the next one's.
WINDOW, STRIDE = 24, 12
#: Rows of the embedding tables and their width; units of the recurrent layer in each direction.
WORDS, CHARS, WIDE, UNITS = 1 << 13, 1 << 15, 16, 10
#: Lengths of the character sequences, in bytes.
GRAMS = (3, 5, 7)
#: Labelled texts that training uses at most, as many of either label as there are up to half of it.
SAMPLE = 3000
#: Bytes of all drawn texts together; where they are longer, fewer are drawn, each of them whole.
TRAINING_BYTES = 32_000_000
#: Windows whose states training holds at a time; more are run twice.
TRAINING_WINDOWS = 4096
#: Windows that run together, so that a step's arrays stay in the processor's cache; distinct words whose
#: character sequences are summed together.
WINDOWS_AT_A_TIME, WORDS_AT_A_TIME = 768, 8192
#: Updates that training makes at least.
LEAST_UPDATES = 200
#: UTF-8 bytes of text scored at a time.
BLOCK_BYTES = 2_000_000


def _word_bytes() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    return table


_IS_WORD = _word_bytes()


@dataclass(frozen=True)
class Tokens:
    """word: the index of each word in turn among the distinct ones; counts: words of each text;
    word_row: embedding row of each distinct word; gram_row, gram_of: embedding row of each of
    their character sequences, and the word it is of (rising)."""

    word: np.ndarray
    counts: np.ndarray
    word_row: np.ndarray
    gram_row: np.ndarray
    gram_of: np.ndarray


def tokens(texts: list[bytes]) -> Tokens:
    """Words are runs of letters and digits; A-Z count as a-z."""
    buf = np.frombuffer(b" ".join(t.lower() for t in texts) + b" ", np.uint8)
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    starts, ends = spans(_IS_WORD[buf])
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], ends_of])))
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Tokens(none, counts, none, none, none)
    codes, distinct = pd.factorize(span_hashes(buf, starts, ends))
    first = np.zeros(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    lengths = (ends - starts)[first]
    # the distinct words one after another, each between marks
    size = lengths + 2
    begin = np.cumsum(size) - size
    own = np.zeros(int(size.sum()), np.uint8)
    own[begin], own[begin + size - 1] = 0x3C, 0x3E
    of = np.repeat(np.arange(len(first)), lengths)
    step = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    own[begin[of] + 1 + step] = buf[starts[first][of] + step]
    owner = np.repeat(np.arange(len(first)), size)
    rows, owners = [], []
    for n in GRAMS:
        if len(own) < n:
            continue
        h = np.zeros(len(own) - n + 1, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + own[k : len(own) - n + 1 + k].astype(np.uint64) + np.uint64(1)
        inside = owner[: len(h)] == owner[n - 1 :]
        rows.append((mixed(h[inside], n) % np.uint64(CHARS)).astype(np.int64))
        owners.append(owner[: len(h)][inside])
    gram_row, gram_of = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(gram_of, kind="stable")
    return Tokens(codes, counts, (distinct % np.uint64(WORDS)).astype(np.int64), gram_row[order], gram_of[order])


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each window, its first word, its number of words): windows that overlap and cover
    each text; a text without words has none."""
    n = np.where(counts > 0, np.maximum(-(-(counts - WINDOW) // STRIDE), 0) + 1, 0)
    of = np.repeat(np.arange(len(counts)), n)
    at = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    base = np.cumsum(counts) - counts
    return of, base[of] + at, np.minimum(WINDOW, counts[of] - at)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def initial(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *s, scale: (rng.normal(size=s) * scale).astype(np.float32)
    p = {"word": draw(WORDS, WIDE, scale=0.05), "char": draw(CHARS, WIDE, scale=0.2)}
    for d in "fb":
        p |= {f"in_{d}": draw(WIDE, 3 * UNITS, scale=WIDE**-0.5), f"rec_{d}": draw(UNITS, 3 * UNITS, scale=UNITS**-0.5), f"bias_{d}": np.zeros(3 * UNITS, np.float32)}
    return p | {"attend": draw(2 * UNITS, scale=0.3), "out": draw(2 * UNITS, scale=0.3), "out_bias": np.full(1, -3.0, np.float32)}


def inputs(p: dict, t: Tokens) -> np.ndarray:
    """The input vector of each distinct word."""
    edge = np.searchsorted(t.gram_of, np.arange(len(t.word_row) + 1))
    out = p["word"][t.word_row]
    for a in range(0, len(out), WORDS_AT_A_TIME):
        cuts = edge[a : a + WORDS_AT_A_TIME + 1]
        sums = np.add.reduceat(p["char"][t.gram_row[cuts[0] : cuts[-1]]], cuts[:-1] - cuts[0])
        out[a : a + WORDS_AT_A_TIME] += sums / np.sqrt(np.diff(cuts)).astype(out.dtype)[:, None]
    return out


def projected(p: dict, t: Tokens) -> tuple[np.ndarray, list[np.ndarray]]:
    """The input vector of each distinct word, and for either direction what it adds to the reset, update and
    candidate parts. Sigmoids are taken as tanh of half their argument, so those parts come halved."""
    x = inputs(p, t)
    return x, [(x @ p[f"in_{d}"] + p[f"bias_{d}"]) * _halved(x.dtype) for d in "fb"]


def _halved(dtype: np.dtype) -> np.ndarray:
    return np.repeat(np.array([0.5, 1.0], dtype), [2 * UNITS, UNITS])


def forward(p: dict, t: Tokens, first: np.ndarray, size: np.ndarray, keep: bool = False, ready: tuple | None = None):
    """Logit of each window; with keep, what backward() needs. ready: projected(p, t), where it is at hand.

    Both directions run at once, the backward one over the words from the last; a state stays as it is
    beyond the end of a window. Attention needs two numbers of each state: its weight and its share of the logit.
    """
    x, proj = ready or projected(p, t)
    kind, n = proj[0].dtype, len(first)
    step = np.arange(WINDOW)[:, None]
    live = (step < size[None, :]).astype(kind)
    ids = t.word[np.minimum(first[None, :] + step, len(t.word) - 1)]
    rec = np.stack([p["rec_f"], p["rec_b"]]) * _halved(kind)
    read = np.stack([np.stack([p[k][i : i + UNITS] for k in ("attend", "out")], 1) for i in (0, UNITS)]).astype(kind)
    h, seen, saved = np.zeros((2, n, UNITS), kind), np.zeros((2, WINDOW, n, 2), kind), []
    add, m = np.empty((2, n, 3 * UNITS), kind), np.empty((2, n, 1), kind)
    for s in range(WINDOW):
        r = WINDOW - 1 - s
        np.take(proj[0], ids[s], axis=0, out=add[0])
        np.take(proj[1], ids[r], axis=0, out=add[1])
        m[0, :, 0], m[1, :, 0] = live[s], live[r]
        g = h @ rec
        gates = np.tanh(add[..., : 2 * UNITS] + g[..., : 2 * UNITS])
        gates += 1
        gates *= 0.5
        reset, update, cand = gates[..., :UNITS], gates[..., UNITS:], g[..., 2 * UNITS :]
        new = np.tanh(add[..., 2 * UNITS :] + reset * cand)
        if keep:
            saved.append((h, reset, update, new, cand, m.copy()))
        h = h + m * ((1 - update) * (new - h))
        told = h @ read
        seen[0, s], seen[1, r] = told[0], told[1]
    weight, share = (seen[0] + seen[1]).transpose(2, 0, 1)
    e = np.where(live > 0, weight, -1e9)
    a = np.exp(e - e.max(0))
    a /= a.sum(0)
    logit = (a * share).sum(0) + p["out_bias"][0]
    return (logit, (x, ids, a, share, read, saved)) if keep else logit


def pulled(p: dict, t: Tokens, state: tuple, d_logit: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients by the recurrent and read-out parameters, and (as proj_f, proj_b) by the projections of each
    distinct word."""
    x, ids, a, share, read, saved = state
    d_share = a * d_logit
    d_weight = d_share * (share - (a * share).sum(0))
    told = np.stack([d_weight, d_share], 2)  # by the two numbers of each state
    g: dict[str, np.ndarray] = {"out_bias": np.array([d_logit.sum()])}
    rec = np.stack([p["rec_f"], p["rec_b"]])
    by_proj, by_rec = np.empty((2, *ids.shape, 3 * UNITS), x.dtype), np.zeros_like(rec)
    by_read, carry = np.zeros((2, UNITS, 2), x.dtype), np.zeros_like(saved[0][0])
    for s in range(len(ids) - 1, -1, -1):
        prev, r, z, new, cand, m = saved[s]
        now = np.stack([told[s], told[len(ids) - 1 - s]]).astype(x.dtype)
        h = prev + m * ((1 - z) * (new - prev))
        by_read += h.transpose(0, 2, 1) @ now
        total = now @ read.transpose(0, 2, 1) + carry
        kept = total * m
        dz = -kept * (new - prev) * z * (1 - z)
        dn = kept * (1 - z) * (1 - new * new)
        dr = dn * cand * r * (1 - r)
        by_proj[:, s, :, :UNITS], by_proj[:, s, :, UNITS : 2 * UNITS], by_proj[:, s, :, 2 * UNITS :] = dr, dz, dn
        dg = np.concatenate([dr, dz, dn * r], 2)
        by_rec += prev.transpose(0, 2, 1) @ dg
        carry = total * (1 - m * (1 - z)) + dg @ rec.transpose(0, 2, 1)
    g["attend"], g["out"] = (np.concatenate([by_read[0, :, k], by_read[1, :, k]]) for k in (0, 1))
    place = np.arange(3 * UNITS)
    for k, (d, at) in enumerate((("f", ids), ("b", ids[::-1]))):
        flat = (at.reshape(-1, 1) * (3 * UNITS) + place).ravel()
        g |= {f"rec_{d}": by_rec[k], f"proj_{d}": np.bincount(flat, by_proj[k].ravel(), minlength=3 * UNITS * len(x)).reshape(len(x), 3 * UNITS)}
    return g


def finished(p: dict, t: Tokens, x: np.ndarray, g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Gradients by all parameters from what pulled() gives, summed over the windows."""
    dx = np.zeros((len(x), WIDE))
    for d in "fb":
        by_word = g.pop(f"proj_{d}")
        g |= {f"bias_{d}": by_word.sum(0), f"in_{d}": x.T @ by_word}
        dx += by_word @ p[f"in_{d}"].T
    share = dx / np.sqrt(np.bincount(t.gram_of, minlength=len(x)))[:, None]
    place = np.arange(WIDE)
    for name, row, by, n in (("char", t.gram_row, share[t.gram_of], CHARS), ("word", t.word_row, dx, WORDS)):
        g[name] = np.bincount((row[:, None] * WIDE + place).ravel(), by.ravel(), minlength=n * WIDE).reshape(n, WIDE)
    return g


def backward(p: dict, t: Tokens, state: tuple, d_logit: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of a loss whose derivative by each window's logit is d_logit."""
    return finished(p, t, state[0], pulled(p, t, state, d_logit))


def top_windows(logit: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The highest logit of each of n texts; -inf where a text has no window."""
    out = np.full(n, -np.inf)
    np.maximum.at(out, of, logit)
    return out


def train(texts: list[bytes], labels: np.ndarray, *, epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters after Adam on the log loss of texts that are toxic unless none of their windows is; of
    few texts, after as many epochs as make LEAST_UPDATES."""
    epochs = max(epochs, -(-LEAST_UPDATES * batch // max(1, len(texts))))
    p, rng = initial(), np.random.default_rng(seed)
    m, v = ({k: np.zeros(x.shape, np.float32) for k, x in p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for b in range(0, len(order), batch):
            own = order[b : b + batch]
            t = tokens([texts[i] for i in own])
            of, first, size = windows(t.counts)
            if not len(of):
                continue
            parts = [slice(i, i + WINDOWS_AT_A_TIME) for i in range(0, len(of), WINDOWS_AT_A_TIME)]
            ready, held = projected(p, t), len(of) <= TRAINING_WINDOWS
            runs = [forward(p, t, first[i], size[i], held, ready) for i in parts]
            logit = np.concatenate([r[0] if held else r for r in runs])
            y = labels[own].astype(np.float32)
            one = sigmoid(logit)
            none = np.exp(np.bincount(of, np.log1p(-np.minimum(one, 1 - 1e-6)), minlength=len(own)))  # no window is toxic
            odds = none / np.maximum(1 - none, 1e-6)
            d = np.where(y[of] > 0, -one * odds[of], one).astype(np.float32) / len(own)
            g: dict[str, np.ndarray] = {}
            for i, r in zip(parts, runs, strict=True):
                state = r[1] if held else forward(p, t, first[i], size[i], True, ready)[1]
                for k, x in pulled(p, t, state, d[i]).items():
                    g[k] = g[k] + x if k in g else x
            g = finished(p, t, ready[0], g)
            step += 1
            lr = rate * (1 - 0.9 * epoch / epochs)
            for k in p:
                d = g[k].astype(np.float32)
                m[k] += np.float32(0.1) * (d - m[k])
                v[k] += np.float32(0.01) * (d * d - v[k])
                p[k] -= np.float32(lr / (1 - 0.9**step)) * m[k] / (np.sqrt(v[k] / np.float32(1 - 0.99**step)) + np.float32(1e-6))
    return p


def score_texts(p: dict, texts: list[bytes]) -> np.ndarray:
    """Probability for each text, by its highest window; 0 where it has no word."""
    out = np.zeros(len(texts))
    for at, some in blocks(texts, BLOCK_BYTES):
        t = tokens(some)
        of, first, size = windows(t.counts)
        if len(of):
            ready, n = projected(p, t), WINDOWS_AT_A_TIME
            logit = np.concatenate([forward(p, t, first[i : i + n], size[i : i + n], ready=ready) for i in range(0, len(of), n)])
            top = top_windows(logit, of, len(some))
            out[at : at + len(some)] = np.where(np.isfinite(top), sigmoid(top), 0.0)
    return out


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE
) -> dict[str, np.ndarray] | None:
    """Train on texts of docs whose id labels gives a label of 0 or 1, at most sample of them, drawn by a
    hash of the id; None if either label is missing, as of an empty table. A drawn text is learned whole:
    where the drawn ones have more than TRAINING_BYTES together, the draw ends earlier, but not before
    each label has a text. An id with several labels is toxic if one says so, an id with several texts
    is learned by one of them (that of the least hash); null ids, texts and labels teach nothing. Other
    columns are left alone.

    The draw is made among the labels, so that texts are read in place and only drawn ones move.
    """
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where("_id is not null and y in (0, 1)").groupBy("_id").agg(F.max("y").alias("y"))
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    ones = min(counts[1], sample // 2)
    want = {1: ones, 0: min(counts[0], sample - ones, max(2 * ones, 200))}
    u = F.pmod(F.xxhash64("_id", F.lit(23)), F.lit(1 << 30)) / float(1 << 30)
    part = F.when(F.col("y") == 1, F.lit(1.2 * want[1] / counts[1])).otherwise(F.lit(1.2 * want[0] / counts[0]))
    some = rows.withColumn("u", u).where(F.col("u") < part).orderBy("u", "_id").limit(2 * sample)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where("text is not null")
    found = own.join(F.broadcast(some), "_id")  # 2 * sample ids at most
    found = found.groupBy("_id", "y", "u").agg(F.min(F.struct(F.xxhash64("text").alias("t"), F.octet_length("text").alias("n"), "text")).alias("c"))
    found = written(found.select("y", "u", "c.*"), shared_dir(docs.sparkSession), "drawn")
    left, last, taken = TRAINING_BYTES, {}, {0: 0, 1: 0}
    for r in sorted(found.select("y", "u", "t", "n").collect(), key=lambda r: (r.u, r.t)):
        if taken[r.y] < want[r.y]:
            left = left - r.n if r.n <= left else -1
            if left >= 0 or not taken[r.y]:
                taken[r.y] += 1
                last[r.y] = (r.u, r.t)
    if not min(taken.values()):
        return None
    upto = [(F.col("y") == y) & ((F.col("u") < u) | ((F.col("u") == u) & (F.col("t") <= t))) for y, (u, t) in last.items()]
    texts, marks = [], []
    for r in sorted(found.where(upto[0] | upto[1]).select("y", "u", "t", "text").collect(), key=lambda r: (r.u, r.t)):
        if taken[r.y]:
            taken[r.y] -= 1
            texts.append(r.text.encode("utf-8", "replace"))
            marks.append(r.y)
    return train(texts, np.array(marks))


def score(docs: DataFrame, model: dict[str, np.ndarray] | None, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1: how likely the most toxic window of the whole text has label 1.

    A null or empty text, and one without a letter or digit, scores 0, as does any without a model.
    Repeated rows get the same score, an empty table gives no rows; a column of docs named like the
    score gives way.
    """
    find_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of a fixed size

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if shared.value is None:
                yield pd.Series(np.zeros(len(batch)))
            else:
                yield pd.Series(score_texts(shared.value, [(t or "").encode("utf-8", "replace") for t in batch]))

    return docs.withColumn(score_col, F.pandas_udf(run, "double")(F.col(text_col)))
