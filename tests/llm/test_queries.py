"""The queries opN_ over their whole tables against plain versions."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

entry = pytest.importorskip("gridkin.llm.entry")

from tests.llm.test_corpus import ascii_lower, plain_components, plain_spans  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def held(i, parts, part):
    return zlib.crc32(str(i).encode()) % parts == part


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def rows_of(query, spark, sf, columns):
    df = query(spark, sf)
    assert set(columns.split()) <= set(df.columns)
    return df.collect()


def test_op1(spark, sf, docs):
    groups = defaultdict(list)
    for i, r in docs.items():
        groups[ascii_lower(r.text)].append(i)
    got = rows_of(entry.op1_exact_dedup, spark, sf, "doc_id keep_id group_size kept text_sha256")
    assert len(got) == len(docs)
    for r in got:
        t = ascii_lower(docs[r.doc_id].text)
        assert (r.keep_id, r.group_size, r.kept) == (max(groups[t]), len(groups[t]), r.doc_id == max(groups[t]))
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_op2(spark, sf, docs):
    got = rows_of(entry.op2_secret_scan, spark, sf, "doc_id n_assign n_access n_hex base_sha256 spans")
    weak, owners, repositories, places = re.compile(r"[A-Za-z0-9+/_-]{24,}"), defaultdict(set), defaultdict(set), defaultdict(list)
    for i, r in docs.items():
        taken = [tuple(map(int, s.split(":")[1:])) for s in plain_spans(r.text)]
        kinds = {s: s.split(":")[0] for s in plain_spans(r.text)}
        for s, k in kinds.items():
            a, b = map(int, s.split(":")[1:])
            value = re.split(r"[:=]\x20*[\"']?", r.text[a:b], maxsplit=1)[-1] if k == "assign" else r.text[a:b]
            owners[value].add(r.source)
            repositories[value].add(i)
        for m in weak.finditer(r.text or ""):
            v = m.group()
            mixed = re.search("[a-z]", v) and re.search("[A-Z]", v) and re.search("[0-9]", v)
            if mixed and all(m.end() <= a or b <= m.start() for a, b in taken):
                owners[v].add(r.source)
                repositories[v].add(i)
                places[i].append((v, f"token:{m.start()}:{m.end()}"))
    assert len(got) == len(docs)
    for r in got:
        base = plain_spans(docs[r.doc_id].text)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))
        added = {s for v, s in places[r.doc_id] if len(owners[v]) == 1 and len(repositories[v]) < 20}
        assert set(filter(None, r.spans.split(","))) == set(base) | added


def test_op3(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in rows_of(entry.op3_toxicity, spark, sf, "doc_id held_out score predicted")}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == held(i, 5, 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    test = [(labels[i], r.predicted) for i, r in got.items() if r.held_out and i in labels]
    toxic, clean = [p for y, p in test if y == 1], [p for y, p in test if y == 0]
    assert sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.05 * len(clean)


def test_op4(spark, sf, docs):
    ids = sorted(docs)
    sets, part = plain_components([docs[i].text for i in ids], 2)
    got = {r.doc_id: r for r in rows_of(entry.op4_minhash, spark, sf, "doc_id n_shingles component_id kept")}
    assert len(got) == len(docs)
    for k, i in enumerate(ids):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[k]), ids[part[k]], part[k] == k)


def test_op5(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = rows_of(entry.op5_sharding, spark, sf, "doc_id size text_crc32 law shard slot grown_shard")
    assert sorted(r.doc_id for r in got) == sorted(docs) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    sizes, slots, where, weight = Counter(), defaultdict(list), defaultdict(set), Counter()
    for r in got:
        t = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 16, zlib.crc32(t))
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[t].add(r.shard)
        weight[t] += r.size
    assert set(sizes) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    share, largest = sum(sizes.values()) / 40, max(weight.values())
    assert all(len(s) == 1 for t, s in where.items() if weight[t] <= share)  # equal texts share a shard
    assert max(sizes.values()) <= share + largest


def test_op7(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    size = {i: len(WORD.findall(r.text or "")) for i, r in docs.items()}
    total, most = Counter(), Counter()
    for i, r in docs.items():
        total[r.source] += size[i]
        most[r.source] = max(most[r.source], size[i])
    names = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in total)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    want, left, free = {}, 1.5 * sum(total.values()), set(names)
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] > 2 * total[s]}
        want |= {s: 2.0 * total[s] if s in full else unit * weight[s] for s in (full or free)}
        left -= sum(want[s] for s in full)
        free = free - full if full else set()
    got = rows_of(entry.op7_mixing, spark, sf, "doc_id size source_size target taken")
    taken = Counter()
    assert len(got) == len(docs)
    for r in got:
        s = docs[r.doc_id].source
        assert (r.size, r.source_size) == (size[r.doc_id], total[s]) and 0 <= r.taken <= 2 * r.size and r.target == pytest.approx(want[s])
        assert r.size == 0 or r.taken % r.size == 0
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= most[s] / 2 for s in names)
    assert sorted(map(tuple, got)) == sorted(map(tuple, entry.op7_mixing(spark, sf).collect()))


def test_op9(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = rows_of(entry.op9_language_id, spark, sf, "doc_id held_out lang_pred score")
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.held_out == held(r.doc_id, 3, 1) for r in got)
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[r.doc_id].text or ""))
    test = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert len(test) > 100 and sum(test) >= 0.97 * len(test)


def test_op10(spark, sf, docs):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows_of(entry.op10_byte_bpe, spark, sf, "doc_id n_tokens ids_sha256 decoded_sha256")
    assert len(got) == len(docs)
    for r in got:
        text = docs[r.doc_id].text or ""
        ids = own.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
