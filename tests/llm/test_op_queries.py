"""Every numbered query by its name on the smallest tables, against libraries, SQL or brute force."""

import hashlib
import os
import re
import struct
import zlib

import duckdb
import pyarrow.parquet as pq
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from sparkloom.llm import bpe_codec, queries
from tests.llm.test_operators import brute_spans

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{DATA}/documents.parquet").to_pylist()


def rows(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


def words(text):
    return WORD.findall(text or "")


def test_op1(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d["doc_id"]: (len((d["text"] or "").encode()), len(library.encode(d["text"] or "", add_special_tokens=False).ids)) for d in docs}
    got = {r.doc_id: r for r in rows(spark, "op1_token_counts")}
    assert {i: (r.n_bytes, r.n_tokens) for i, r in got.items()} == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got.values())


def test_op2(spark, docs):
    sets = {}
    for d in docs:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d["text"] or ""))
        sets[d["doc_id"]] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows(spark, "op2_ngram_jaccard")}
    assert got == {i: (len(sets[i]), find(i)) for i in ids}


def test_op3(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op3_toxicity")}
    assert set(got) == {d["doc_id"] for d in docs}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())


def test_op4(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op4_language_id")}
    langs = {d["lang"] for d in docs if d["lang"]} | {"und"}
    assert set(got) == {d["doc_id"] for d in docs}
    assert all(r.lang_pred in langs and 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [d for d in docs if d["lang"] and d["text"] and got[d["doc_id"]].held_out]
    assert sum(got[d["doc_id"]].lang_pred == d["lang"] for d in held) >= 0.9 * len(held)


def test_op5(spark):
    pages = {p["page_id"]: p for p in pq.read_table(f"{DATA}/pages.parquet").to_pylist()}
    got = {r.page_id: r for r in rows(spark, "op5_html_main_text")}
    assert set(got) == set(pages)
    for i, r in got.items():
        assert r.url == pages[i]["url"] and r.n_chars == len(r.text) and r.text == " ".join(r.text.split()) and "<p>" not in r.text
    assert sum(r.n_chars > 0 for r in got.values()) > 0.8 * len(got)


@pytest.mark.parametrize("name", ["op6_one_bit_search", "op7_pq_dedup"])
def test_op6_op7(spark, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    plain = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    got = queries.QUERIES[name](spark, DATA).select(*want.columns).collect()
    assert sorted(map(plain, got)) == sorted(map(plain, want.fetchall()))


def test_op8(spark, docs):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_codec.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {}
    for d in docs:
        ids = library.encode_ordinary(d["text"] or "")
        want[d["doc_id"]] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows(spark, "op8_bpe_codec")} == want


def test_op9(spark, docs):
    size = {d["doc_id"]: len(words(d["text"])) for d in docs}
    of = {}
    for d in docs:
        of[d["source"]] = of.get(d["source"], 0) + size[d["doc_id"]]
    named = sorted((s for s in of if s is not None)) + [None] * (None in of)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(named)}
    target, held = {}, set()
    while True:
        left = sum(of.values()) - sum(3 * of[s] for s in held)
        total = sum(w for s, w in weight.items() if s not in held)
        target = {s: 3.0 * of[s] if s in held else left * weight[s] / total for s in named}
        over = {s for s in named if s not in held and target[s] > 3 * of[s]}
        if not over:
            break
        held |= over
    got = {r.doc_id: r for r in rows(spark, "op9_mixing")}
    taken = {}
    for d in docs:
        r = got[d["doc_id"]]
        assert r["size"] == size[d["doc_id"]] and r.source_size == of[d["source"]] and r.target == pytest.approx(target[d["source"]])
        assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[d["source"]] = taken.get(d["source"], 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= max(size.values()) for s in named)
    assert {r.doc_id: r.taken for r in rows(spark, "op9_mixing")} == {i: r.taken for i, r in got.items()}


def test_op10(spark, docs):
    for r in rows(spark, "op10_pii"):
        text = next(d["text"] for d in docs if d["doc_id"] == r.doc_id)
        spans = brute_spans(text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in spans) for kind in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        listed = [x.split(":") for x in r.spans.split(",") if x]
        assert {(k, int(a), int(b)) for k, a, b in listed} >= set(spans) and all(k in ("remove", "generalise") or (k, int(a), int(b)) in spans for k, a, b in listed)
