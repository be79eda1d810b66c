"""The corpus operators against plain versions, and their edge cases."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("gridkin.llm")

from pyspark.sql import functions as F  # noqa: E402

from gridkin.llm import bpe, langid, toxicity  # noqa: E402
from gridkin.llm._graph import components  # noqa: E402
from gridkin.llm._common import shared_dir  # noqa: E402
from gridkin.llm.exact_dedup import build_directory, exact_dedup, kept_rows  # noqa: E402
from gridkin.llm.minhash import near_duplicates  # noqa: E402
from gridkin.llm.mixing import mix, mixed_rows, targets  # noqa: E402
from gridkin.llm.secret_scan import scan_secrets  # noqa: E402
from gridkin.llm.sharding import deal, quantile_bounds, shard  # noqa: E402
from gridkin.llm.topk import top_k  # noqa: E402
from gridkin.llm.url_filter import url_filter  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, key long, size string"
LONG = "word " * 30_000


def frame(spark, texts, ids=None):
    """documents with columns whose names the operators use too."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", None if k % 3 == 0 else f"s{k % 2}", 1, "x", 7, "y") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


EDGES = [None, "", "a", "A", "same text here now", "Same TEXT here now", LONG, LONG + "x", "É é", None, "''s don't  x\n\n y ", "b"]


def ascii_lower(t):
    return (t or "").encode().lower().decode()


def test_exact_dedup(spark):
    got = {r.doc_id: r for r in exact_dedup(frame(spark, EDGES), capacity=2).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(EDGES):
        groups[ascii_lower(t)].append(i)
    assert len(got) == len(EDGES)
    for i, t in enumerate(EDGES):
        own = groups[ascii_lower(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(own), len(own), i == max(own))
        assert got[i].text_sha256 == hashlib.sha256(ascii_lower(t).encode()).hexdigest()


def test_exact_dedup_ties_nulls_and_empty(spark):
    rows = frame(spark, ["t", "t", "t", "u", "u"], [5, 5, None, None, None])
    got = exact_dedup(rows).collect()
    assert Counter((r.text_sha256, r.kept) for r in got)[(hashlib.sha256(b"t").hexdigest(), True)] == 1
    assert sum(r.kept for r in got) == 2
    assert kept_rows(rows).count() == 2 and kept_rows(rows).columns == rows.columns
    assert exact_dedup(frame(spark, [])).count() == 0


def test_directory_doubles_where_buckets_are_overfull():
    d = build_directory({0: 10, 1: 10, 12: 1}, capacity=10, max_depth=4)
    assert d.depth == 4 and d.doublings == 4 and len(d.slots) == 16
    assert d.slots[0] != d.slots[1] and len(set(d.slots[8:])) == 1
    assert build_directory({}, 1).depth == 0


def plain_spans(t):
    kinds = [
        ("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 1, 8),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
    ]
    found = [(m.start(), k, m.end(), n) for k, (n, rx, g, least) in enumerate(kinds) for m in rx.finditer(t or "") if len(m.group(g)) >= least]
    return [f"{n}:{a}:{b}" for a, _, b, n in sorted(found)]


def test_secret_scan(spark):
    key = "0123456789abcdef" * 3
    texts = [
        f"password: secret: abcdefgh1 Token = 'abcDEF123456' 😀 api_key={key}", "AKIA" + "A" * 12 + " AKIAAKIA" + "B" * 9, None, "", key,
        "passwd='short' SECRET=longenough99", f"é{key[:31]} {key}", "Zz9" * 10 + " free", "Zz9" * 10, "Zz8" * 10, *["token=shared-example-1"] * 4,
    ]
    rows = frame(spark, texts).withColumn("source", F.concat(F.lit("o"), F.col("doc_id").cast("string")))
    got = {r.doc_id: r for r in scan_secrets(rows).collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t)
        assert got[i].base_text == ",".join(want)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex"))
        assert set(want) <= set(got[i].spans.split(",")) | {""} or not want
    assert "token:0:30" not in got[8].spans and got[9].spans == "token:0:30"  # two owners, one owner
    assert got[10].n_copied == 1 and got[0].n_live >= 1
    assert scan_secrets(frame(spark, [])).count() == 0


def shingles(t, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])


def plain_components(texts, k=2):
    sets = [shingles(t, k) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return sets, [find(i) for i in range(len(texts))]


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = list(EDGES)
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([5, 40, 200]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([1, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 3, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    for width in (2, 5):
        sets, want = plain_components(texts, width)
        got = {r.doc_id: r for r in near_duplicates(frame(spark, texts), width=width).collect()}
        assert len(got) == len(texts)
        for i in range(len(texts)):
            assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), want[i], want[i] == i)


def test_near_duplicates_nulls_and_empty(spark):
    got = near_duplicates(frame(spark, ["a b c", "a b c", "", "x"], [None, 4, 2, 2]), width=2).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter({(None, 4): 1, (4, 4): 1, (2, 2): 2})
    assert near_duplicates(frame(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 100), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), shared_dir(spark)).collect()))
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long"), shared_dir(spark)).count() == 0


def test_shard(spark):
    texts = EDGES + [f"text number {i} " * (i % 17) for i in range(300)] + ["hot"] * 200
    got = shard(frame(spark, texts), n_shards=7).collect()
    assert len(got) == len(texts)
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 16, zlib.crc32(t))
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard(frame(spark, [])).count() == 0
    even = shard(frame(spark, [f"{i:05d} " * 50 for i in range(2000)]), n_shards=7).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    total = [r.s for r in even]
    assert len(total) == 7 and max(total) < 1.02 * min(total)


def test_shard_parts():
    assert sorted(set(deal([5, 5, 5, 100, 5, 5], 2))) == [0, 1]
    hot = [(9, t, 1.0) for t in range(100)] + [(k, 0, 1.0) for k in range(20, 40)]
    assert not any(k == 9 and t > -(1 << 63) for k, t in quantile_bounds(hot, 12.0, set()))
    bounds = quantile_bounds(hot, 12.0, {9})
    assert (9, -(1 << 63)) in bounds and sum(k == 9 for k, _ in bounds) >= 6


def test_top_k(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(700, 8)).astype(np.float32)
    v[10:20] = v[0]  # ties
    rows = [(i, [float(x) for x in r], 1) for i, r in enumerate(v)] + [(900, None, 1), (950, [1.0, None] * 4, 1), (1000, [float("nan")] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for r in top_k(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    w = np.floor(256 * v.astype(float)).astype(np.int64)
    for q in range(0, 700, 50):
        s = w @ w[q]
        want = sorted((int(-s[i]), i) for i in range(700) if i != q)[:5]
        assert got[q] == [(i, -x) for x, i in want]
    assert set(got) == set(range(0, 700, 50))
    few = df.where("vec_id < 3")
    assert top_k(few, few.where("vec_id = 0")).count() == 2
    assert top_k(df.where("false"), df.where("false")).count() == 0


def test_mix(spark):
    rng = random.Random(2)
    texts = EDGES + [" ".join(["w"] * rng.randrange(1, 400)) for _ in range(200)]
    got = mix(frame(spark, texts)).collect()
    again = mix(frame(spark, texts)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    count = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    names = {0: None, 1: "s1", 2: "s0"}
    of = [None if k % 3 == 0 else f"s{k % 2}" for k in range(len(texts))]
    total = {s: sum(c for c, o in zip(count, of) if o == s) for s in ("s0", "s1", None)}
    want = dict(zip(("s0", "s1", None), targets([total["s0"], total["s1"], total[None]], [3, 1, 2], 1.5)))
    assert names and len(got) == len(texts)
    taken = Counter()
    for r in got:
        assert r.size == count[r.doc_id] and 0 <= r.taken <= 2 * r.size and r.source_size == total[of[r.doc_id]]
        assert r.target == pytest.approx(want[of[r.doc_id]])
        taken[of[r.doc_id]] += r.taken
    for s in want:
        assert taken[s] == pytest.approx(want[s], rel=1e-3)
    assert mix(frame(spark, [])).count() == 0 and mix(frame(spark, [None, ""])).count() == 2


def test_targets():
    assert targets([100, 100], [3, 1], 1.5) == [200.0, 100.0]
    assert targets([10, 1000, 0], [3, 1, 2], 1.5) == [20.0, 1495.0, 0.0]
    assert targets([], [], 1.5) == []


def test_mixed_rows(spark):
    texts = ["a b  c d e f", "g", None, "h i", "j k l"]
    docs = frame(spark, texts)
    taken = {r.doc_id: r.taken for r in mix(docs).collect()}
    rows = mixed_rows(docs)
    assert rows.columns == docs.columns
    words = Counter()
    for r in rows.collect():
        words[r.doc_id] += len(r.text.split())
    assert {i: words[i] for i in taken} == taken


def test_mixed_rows_are_whole_texts(spark):
    rng = random.Random(6)
    texts = ["  ".join(["w"] * rng.randrange(1, 400)) for _ in range(60)]
    docs = frame(spark, texts)
    rows = Counter((r.doc_id, r.text) for r in mixed_rows(docs).collect())
    assert all(text == texts[i] for i, text in rows)
    assert {r.doc_id: r.taken for r in mix(docs).collect()} == {i: len(t.split()) * rows[i, t] for i, t in enumerate(texts)}


def test_url_filter(spark):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    link = lambda u: f'<html><link rel="canonical" href="{u}"></html>'
    pages = [
        (1, "http://A.Example.COM/en/5", "", "com/en/", "block"), (2, "https://x.example.com/en/77?q", "", "example.com/en/7", "allow"),
        (3, "http://b.net/de/1", "", "net/de/", "allow"), (4, "http://example.net/de/8#x", "", "example.net/de/8", "block"),
        (5, "http://c.test/alias", link("http://a.com/en/9"), None, "block"), (6, "http://d.test/x", link("http://c.test/alias"), None, "block"),
        (7, "http://e.test/y", link("http://f.net/de/2"), None, "allow"), (8, None, None, None, "allow"), (9, "no scheme", "", None, "allow"),
        (10, "http://e.test/z", '<meta http-equiv="refresh" content="0; url=/y">', None, "allow"), (11, "http://notcom/en/", "", None, "allow"),
        (12, "http://host?x=://com/en/", "", None, "allow"), (13, "http://k.org/es/1", link("http://e.test/y"), "org/es/", "block"),
    ]
    df = spark.createDataFrame([(*p[:3], "z") for p in pages], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_filter(df, rules).collect()}
    for i, url, _, rule, verdict in pages:
        assert (got[i].rule, got[i].verdict) == (rule, verdict), url
    assert (got[12].host, got[12].path, got[8].host, got[1].host) == ("host", "", "", "a.example.com")
    assert url_filter(df.where("false"), rules).count() == 0


def corpus(n=120):
    rng = random.Random(9)
    parts = {"en": ["th", "ing", "er", "on", "wh"], "de": ["sch", "ung", "ei", "ß", "tz"], "fr": ["eau", "é", "ent", "ou", "ç"], "es": ["ción", "ñ", "ar", "os", "ll"]}
    out = []
    for i in range(n):
        lang = list(parts)[i % 4]
        out.append((" ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(30)), lang))
    return out


def test_language(spark):
    data = corpus()
    df = spark.createDataFrame(data + [("x", None), (None, "en")], "text string, lang string")
    model = langid.fit(df)
    assert set(model.within) == {"germanic", "romance"}
    texts = [None, "", "123 &&", "É", LONG] + [t for t, _ in corpus(40)]
    said = langid.identify(spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double"), model)
    got = {r.doc_id: r for r in said.collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and got[3].lang_pred != "und" and len(said.columns) == 4
    assert np.mean([got[5 + i].lang_pred == lang for i, (_, lang) in enumerate(corpus(40))]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = langid.fit(df.where("false"))
    assert langid.identify(df, nothing).select("lang_pred").distinct().collect()[0][0] == "und"


def test_language_learns_distinct_texts(spark, monkeypatch):
    data = [r for r in corpus(160) if r[1] in ("en", "de")]
    df = spark.createDataFrame(data + [(data[0][0], data[0][1])] * 3000, "text string, lang string")
    seen = []
    whole = langid.machines
    monkeypatch.setattr(langid, "machines", lambda x, labels, rows=None: seen.append((x, labels)) or whole(x, labels, rows))
    langid.fit(df, sample=60)
    x, labels = seen[0]
    assert len(x) == 60 and len(np.unique(x, axis=0)) == 60
    seen.clear()
    langid.fit(df)
    assert len(seen[0][0]) == 80  # forty distinct texts of each


def test_toxicity_learns_and_scores_whole_texts(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    texts, labels = [], []
    for i in range(240):
        w = [rng.choice(words) for _ in range(60)]
        if i % 3 == 0:
            w[rng.randrange(60)] = "zorkling"
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(zip(texts, labels))], "doc_id long, text string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.drop("text"))
    late = LONG + "zorkling"
    ask = spark.createDataFrame([(0, None), (1, ""), (2, "&&&"), (3, late), (4, LONG)] + list(enumerate(texts, 5)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(ask, model).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[3] > 0.5
    ranks = np.argsort(np.argsort([got[5 + i] for i in range(240)]))
    y = np.array(labels)
    auc = (ranks[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()
    assert auc > 0.95
    assert toxicity.fit(df, df.where("toxic = 0")) is None
    assert toxicity.score(ask, None).agg(F.max("score")).first()[0] == 0


def test_gradient_of_the_network():
    p = {k: v.astype(np.float64) for k, v in toxicity.initial(1).items()}
    t = toxicity.tokens([b"some words of one text", b"and of another one"])
    of, first, size = toxicity.windows(t.counts)
    f = lambda q: float(toxicity.forward(q, t, first, size).sum())
    _, state = toxicity.forward(p, t, first, size, keep=True)
    g = toxicity.backward(p, t, state, np.ones(len(of)))
    for name, at in (("in_f", (3, 5)), ("rec_b", (2, 4)), ("attend", (1,)), ("word", (int(t.word_row[0]), 2)), ("char", (int(t.gram_row[3]), 1))):
        q = {k: v.copy() for k, v in p.items()}
        q[name][at] += 1e-3
        r = {k: v.copy() for k, v in p.items()}
        r[name][at] -= 1e-3
        assert (f(q) - f(r)) / 2e-3 == pytest.approx(g[name][at], abs=2e-3)


def test_windows_overlap_and_cover():
    of, first, size = toxicity.windows(np.array([0, 3, 24, 25, 100]))
    covered = defaultdict(set)
    base = np.cumsum([0, 0, 3, 24, 25])
    for o, f, s in zip(of, first, size):
        covered[o] |= set(range(f - base[o], f - base[o] + s))
    assert {o: len(c) for o, c in covered.items()} == {1: 3, 2: 24, 3: 25, 4: 100}


def test_toxicity_learns_what_stands_late(spark, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(200)) for _ in range(20)]
    rows = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(66)]  # over 13,000 characters
        rows.append((i, " ".join(w + ["zorkling"] * (i % 3 == 0)), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.drop("text"))
    late, clean = toxicity.score_texts(model, [b"zorkling", words[0].encode()])
    assert late > 0.5 > clean
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: seen.append((texts, labels)))
    monkeypatch.setattr(toxicity, "TRAINING_BYTES", 100_000)
    toxicity.fit(df.drop("toxic"), df.drop("text"))
    texts, labels = seen[0]
    assert 2 <= len(texts) < 10 and set(labels) == {0, 1} and all(t.decode() in {r[1] for r in rows} for t in texts)


def test_training_in_blocks_of_windows(monkeypatch):
    texts, labels = [b"some words of a text " * 30, b"and others of another one " * 20], np.array([0, 1])
    monkeypatch.setattr(toxicity, "LEAST_UPDATES", 2)
    whole = toxicity.train(texts, labels, epochs=2)
    monkeypatch.setattr(toxicity, "TRAINING_WINDOWS", 5)
    blocks = toxicity.train(texts, labels, epochs=2)
    assert all(np.allclose(whole[k], blocks[k], atol=1e-3) for k in whole)


def test_windows_hold_passages_whole():
    _, first, size = toxicity.windows(np.array([200]))
    assert all(any(f <= at and at + 13 <= f + s for f, s in zip(first, size)) for at in range(200 - 12))


def public():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_library(spark):
    path, own = public()
    texts = EDGES[:6] + EDGES[8:] + [
        "it's I'll we've they're 's 'll  'd can't'x  ''s 'stop", "tab\t\tx \n \n y  ", "  lead", "trail  ", " 　x  y", "١٢٣ ½ ²x", "日本語 текст ελλ", "😀👍🏽 ok",
        "a" * 300, "=" * 120 + " x", "Zz9" * 60, "\x00\x01 \x1c\x85z", "don’t", "<|endoftext|>", "x" + " " * 50 + "y",
    ]
    got = {r.doc_id: r for r in bpe.encode(frame(spark, texts), path, keep_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert got[i].ids == ids, t
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(spark.createDataFrame([(i, list(r.ids)) for i, r in got.items()], "doc_id long, ids array<int>"), path)
    assert {r.doc_id: bytes(r.decoded).decode() for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(frame(spark, []), path).count() == 0


def test_long_text(spark):
    path, own = public()
    got = bpe.encode(frame(spark, [LONG, None]), path).collect()
    assert {r.n_tokens for r in got} == {0, len(own.encode_ordinary(LONG))}
