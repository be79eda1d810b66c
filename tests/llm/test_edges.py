"""Cases that the corpus operators must stand: long and odd texts, ties, repeats, clashing names, empty tables."""

import random
import time

import numpy as np
import pytest

pytest.importorskip("gridkin.llm")

from pyspark.sql import functions as F  # noqa: E402

from gridkin.llm import bpe, langid, minhash, toxicity, topk  # noqa: E402
from gridkin.llm._words import span_hashes  # noqa: E402
from gridkin.llm.exact_dedup import exact_dedup, kept_rows  # noqa: E402
from gridkin.llm.mixing import mix  # noqa: E402
from gridkin.llm.secret_scan import scan_secrets  # noqa: E402
from gridkin.llm.sharding import deal, shard  # noqa: E402
from gridkin.llm.url_filter import url_filter  # noqa: E402
from tests.llm.test_corpus import LONG, corpus, frame, plain_spans  # noqa: E402

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/")]


def test_keys_that_collide_are_told_apart(spark):
    texts = ["a", "b", "A", "c", "b"]
    got = {r.doc_id: r for r in exact_dedup(frame(spark, texts), key=lambda norm: F.lit(7).cast("long")).collect()}
    assert {i: (r.keep_id, r.group_size) for i, r in got.items()} == {0: (2, 2), 2: (2, 2), 1: (4, 2), 4: (4, 2), 3: (3, 1)}
    assert sorted({r.text_sha256: r.chain for r in got.values()}.values()) == [1, 2, 3]


def test_kept_rows_keeps_columns_of_any_name(spark):
    rows = [(1, "x", "p", 1), (2, "X", "q", 2), (2, "x", "r", 3), (None, None, "s", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _sha string, _key long")
    out = kept_rows(df)
    assert out.columns == df.columns and sorted((r.doc_id or 0, r._key) for r in out.collect())[0] == (0, 4) and out.count() == 2
    rows = spark.createDataFrame([(1, "a b c d", 5), (2, "a b c d", 6)], "doc_id long, text string, _gone long")
    assert [tuple(r) for r in minhash.distinct_rows(rows).collect()] == [(1, "a b c d", 5)]


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_words_that_polynomials_confuse(spark):
    x, y = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, [x, y, x]), width=2).collect()}
    assert (got[0].component_id, got[1].component_id, got[2].component_id) == (0, 1, 0)


def test_span_hashes_tell_bytes_and_lengths_apart():
    words = [b"", *(bytes([c]) * n for c in (0, 97, 255) for n in (1, 2, 7, 8, 9, 16, 17, 1024, 1025))]
    words += [b"a" * 8 + bytes([c]) for c in range(50)] + [b"a" * 1030 + bytes([c]) for c in range(50)]
    buf = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    h = span_hashes(buf, starts, ends)
    assert len(set(h.tolist())) == len(words)
    again = span_hashes(buf, starts[::-1].copy(), ends[::-1].copy())
    assert (again[::-1] == h).all()


def test_near_copies_of_one_text_lose_no_link(spark):
    """One large group whose members are not all similar to each other, with outliers just below the threshold."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(60)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randrange(3, 9)):
            copy[rng.randrange(60)] = rng.choice(words)
        texts.append(" ".join(copy))
    from tests.llm.test_corpus import plain_components

    _, want = plain_components(texts, 2)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, texts), width=2).collect()}
    assert len(set(want)) > 5 and [got[i] for i in range(150)] == want


def test_copies_of_one_text_are_compared_a_few_times_each(spark, monkeypatch):
    """One group of near copies, most of them linked only through the text they are copies of: comparisons don't
    grow with the square of the group, and the components are those of all pairs."""
    rng = random.Random(12)
    base, texts = [f"b{i}" for i in range(150)], []
    for i in range(240):
        copy = list(base)
        for k in rng.sample(range(10, 140, 10), 3 if i < 120 else 1):
            copy[k] = f"x{i}-{k}"
        texts.append(" ".join(copy))
    texts += [" ".join(base), *(" ".join([*base[:75], *(f"y{i}-{k}" for k in range(40)), *base[75:]]) for i in range(5))]
    from tests.llm.test_corpus import plain_components

    _, want = plain_components(texts, 5)
    compared, linked = [], minhash._linked

    def counted(pairs, *how):
        compared.append(pairs.count())
        return linked(pairs, *how)

    monkeypatch.setattr(minhash, "_linked", counted)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, texts), width=5).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) == 6
    assert sum(compared) < 20 * len(texts), compared


def test_recall_of_the_tables():
    """Of pairs at a similarity near 0.8, the tables bring all but few together."""
    rng = np.random.default_rng(4)
    n, pairs = 400, 600
    sets = []
    for _ in range(pairs):
        common = rng.integers(0, 1 << 63, n).astype(np.uint64)
        own = rng.integers(0, 1 << 63, (2, n // 8)).astype(np.uint64)
        sets += [np.sort(np.concatenate([common, own[0]])), np.sort(np.concatenate([common, own[1]]))]  # 400 / 500
    m = minhash.minhashes(np.concatenate(sets), np.array([len(s) for s in sets]))
    a, b = m[0::2] == m[1::2], minhash.WIDTH * minhash.GROUPS
    met = [x.reshape(pairs, minhash.GROUPS, minhash.WIDTH).all(2).any(1) for x in (a[:, :b], a[:, b:])]
    assert abs(a.mean() - 0.8) < 0.02 and (met[0] & met[1]).mean() > 0.995


def test_secrets_in_a_long_text(spark):
    texts = ["token=abcdefgh " * 12_000, "token=abcdefgh " * 3000, "x", None]
    rows = frame(spark, texts, [1, 1, 2, 2]).withColumn("source", F.lit(None).cast("string"))
    start = time.time()
    got = sorted(scan_secrets(rows).collect(), key=lambda r: -r.n_assign)
    assert time.time() - start < 60
    assert [r.n_assign for r in got] == [12_000, 3000, 0, 0] and got[1].base_text == ",".join(plain_spans(texts[1]))


def test_scores_of_repeated_rows_and_empty_tables(spark):
    rows = [(i % 6, f"text {i % 3} " + "zorkling" * (i % 2), i % 2) for i in range(12)] + [(None, "x", 1), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df)
    said = toxicity.score(df, model).collect()
    assert len(said) == len(rows) and all(len({r.score for r in said if r.text == t}) == 1 for t in {r[1] for r in rows})
    none = df.where("false")
    assert toxicity.fit(none, none) is None and toxicity.score(none, model).count() == 0


def test_shards_of_repeated_rows_and_null_ids(spark):
    got = shard(frame(spark, ["same"] * 50 + [None] * 10, [None] * 30 + [7] * 30), n_shards=3).collect()
    assert len(got) == 60 and all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(3))


def test_large_ranges_are_dealt_first():
    at = deal([10] * 30 + [90, 90, 120], 4)
    filled = [sum(s for s, x in zip([10] * 30 + [90, 90, 120], at) if x == k) for k in range(4)]
    assert max(filled) <= 160 and min(filled) >= 130


def test_vectors_of_unequal_length_and_repeated_queries(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 1.0]), (1, [1.0]), (2, [0.0, 3.0, 5.0]), (3, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id = 0"), factor=1).collect()))
    assert got == [(0, 1, 2, 3), (0, 2, 1, 1), (0, 3, 3, 0)]  # of the two queries the lesser answers


def test_blocks_are_passed_over():
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 16)) * 100
    rows = np.floor(np.repeat(centers, 100, axis=0) + rng.normal(size=(4000, 16)))
    ids, cells = np.arange(4000), np.repeat(np.arange(40), 100)
    search = topk.Search(ids[::50].copy(), rows[::50], 5)
    for a in range(0, 4000, 1000):  # in batches: the k-th score is carried
        search.show(ids[a : a + 1000], rows[a : a + 1000], cells[a : a + 1000])
    assert search.passed > 2 * search.scored
    got = search.answers()
    for q in range(0, 4000, 50):
        s = rows @ rows[q]
        want = sorted((-s[i], i) for i in range(4000) if i != q)[:5]
        own = got[got["query_id"] == q]
        assert list(zip(-own["score"], own["id"])) == want


def test_links_of_every_kind(spark):
    tag = lambda u: f'<link rel="canonical" href="{u}">'
    pages = [
        (1, "HTTP://Blocked.com/en/x#part", tag("y?a=1&amp;b=2")), (2, "http://blocked.com/en/y?a=1&b=2", None), (3, "http://q.test/a/b/c", tag("../../up/./") + tag("http://blocked.com/en/x")),
        (4, "http://q.test/up/", None), (5, "http://r.test/d?p=1", '<meta http-equiv="refresh" content="0; url=?p=2">'), (6, "http://r.test/d?p=2", tag("/up")),
        (7, "http://r.test/up", tag("//q.test/up/#z")), (8, "http://s.test/", tag("#only") + tag("mailto:x")), (9, "http://t.test/a", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter(df, RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "block", 8: "allow", 9: "allow"}
    moved = spark.createDataFrame([("http://t.test/a", "http://blocked.com/en/9"), ("http://s.test/", "http://n.net/de/"), ("http://s.test/", "http://blocked.com/en/")], "from_url string, to_url string")
    got = {r.page_id: r.verdict for r in url_filter(df, RULES, redirects=moved).collect()}
    assert got[9] == "block" and got[8] == "allow"


def test_long_urls(spark):
    urls = ["http://" + "a." * 16_000 + "com/en/", "http://x.com/en/" + "b/" * 30_000, "http://" + "c" * 100_000]
    start = time.time()
    got = url_filter(spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string"), RULES)
    assert {r.page_id: r.verdict for r in got.collect()} == {0: "block", 1: "block", 2: "allow"} and time.time() - start < 30


def test_language_of_long_texts_ties_and_names(spark):
    data = corpus(80)
    model = langid.fit(spark.createDataFrame(data, "text string, lang string"))
    df = spark.createDataFrame([(LONG * 3, "l", 1), (LONG * 3, "m", 2), ("sch ung tz", "n", 3)], "text string, said string, `row` int")
    got = langid.identify(df, model)
    assert got.columns == ["text", "said", "row", "lang_pred", "score"]
    said = {r.said: (r.lang_pred, r.score) for r in got.collect()}
    assert said["l"] == said["m"] and said["n"][0] == "de"
    assert langid.identify(df.where("false"), model).count() == 0


def test_mix_of_ties_and_one_hot_source(spark):
    texts = ["w " * 10] * 400 + ["v " * 7] * 5
    rows = frame(spark, texts, [1] * 300 + list(range(2, 107))).withColumn("source", F.when(F.col("doc_id") > 100, "s").otherwise("hot"))
    got = mix(rows).collect()
    assert len(got) == 405 and all(0 <= r.taken <= 2 * r.size for r in got)


def test_long_pieces_are_merged_whole(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgé") for _ in range(n)) for n in (1900, 1990, 5000, 30_000)] + ["=" * 3000, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), keep_ids=True).collect()}
    for i, t in enumerate(texts):
        assert list(got[i].ids) == own.encode_ordinary(t or "")
    back = bpe.decode(bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), keep_ids=True), P.path("byte_bpe_50k.tiktoken"))
    assert {r.doc_id: bytes(r.decoded).decode() for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
