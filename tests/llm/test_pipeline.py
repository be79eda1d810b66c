"""The pipeline against plain versions of its stages."""

import base64
import hashlib
from collections import Counter, defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_corpus import ascii_lower, plain_components  # noqa: E402


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept, frames = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, sf)
        if name != "tokens":
            assert out.columns == columns
        kept = out.persist()
        frames[name] = kept.collect()
    start = docs.collect()
    assert len(frames["language"]) == sum(any(c.isalpha() for c in r.text or "") for r in start)
    best = {}
    for r in frames["language"]:
        best[ascii_lower(r.text)] = max(best.get(ascii_lower(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in frames["exact"]) == sorted(best.values())
    rows = sorted(frames["exact"], key=lambda r: r.doc_id)
    _, part = plain_components([r.text for r in rows], 5)
    assert sorted(r.doc_id for r in frames["near"]) == [rows[i].doc_id for i in range(len(rows)) if part[i] == i]
    words, taken = {r.doc_id: len(r.text.split()) for r in frames["near"]}, Counter()
    for r in frames["mixture"]:
        taken[r.doc_id] += len(r.text.split())
    assert all(taken[i] <= 2 * n for i, n in words.items())
    by_source, total = defaultdict(int), 0
    for r in frames["near"]:
        by_source[r.source] += taken[r.doc_id]
        total += words[r.doc_id]
    assert sum(by_source.values()) == pytest.approx(1.5 * total, rel=0.01)

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r.doc_id, hashlib.sha256(" ".join(map(str, own.encode_ordinary(r.text))).encode()).hexdigest()) for r in frames["mixture"])
    assert Counter((r.doc_id, r.ids_sha256) for r in frames["tokens"]) == want


def test_stages_on_odd_rows(spark, sf):
    """Nulls in every column, empty, long, tied and repeated texts, clashing names, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, size long, row string, _sha string"
    row = lambda i, text, source=None: (i, text, None, source, None, None, None, None, None, "x")
    long = " ".join(f"word{i % 977}" for i in range(20_000))
    rows = [
        row(1, "the same text here"), row(2, "THE SAME text here", "s"), row(2, "THE SAME text here", "s"), row(None, None), row(3, ""), row(4, "12 34"),
        row(5, long), row(6, long + " end"), row(None, "letters without an id"),
    ]
    docs = spark.createDataFrame(rows, schema)
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0
        out = stage(spark, docs, sf).persist()
        ids[name] = sorted((r.doc_id or 0) for r in out.collect())
        if name != "tokens":
            assert out.columns == docs.columns
            docs = out
    assert ids["language"] == [0, 1, 2, 2, 5, 6] and ids["exact"] == [0, 2, 5, 6] and ids["near"] == [0, 2, 5]
    assert set(ids["tokens"]) <= {0, 2, 5} and len(ids["tokens"]) == len(ids["mixture"]) >= 1


def test_release_gives_the_drivers_heap_back(spark):
    from gridkin.llm import _common

    _common.release(spark)
    bean = _common._bean(spark, "com.sun.management:type=HotSpotDiagnostic")
    assert "value=25" in bean("getVMOption", "MaxHeapFreeRatio").toString()  # a JVM keeps up to 70 % free of itself
    assert "Trim" in str(_common._bean(spark, "com.sun.management:type=DiagnosticCommand")("systemTrimNativeHeap"))
