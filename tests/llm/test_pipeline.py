"""The corpus pipeline stage by stage on a small corpus."""

import random

import numpy as np
import public_tokenizers

import corpus_pipeline
from sparkloom.llm import bpe_codec, pii
from tests.llm.test_operators import brute_components, brute_spans


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    rows, labels = [], []
    for i in range(400):
        text = " ".join(rng.choice(words) for _ in range(50)) + (" zozzle quagmor" if i % 8 == 0 else "") + (f" me{i}@ex.org" if i % 9 == 0 else "")
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int(i % 8 == 0)))
    rows += [(400 + i, rows[i][1] + " more", "en", "s1", 3) for i in range(1, 40)]
    rows += [(500, None, None, None, None), (501, "", "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
        seen[name] = docs
    clean = {r.doc_id for r in seen["toxicity"].collect()}
    assert {i for i in range(400) if i % 8 == 0}.isdisjoint(clean) and len(clean) >= 0.98 * sum(1 for r in rows if not (r[0] < 400 and r[0] % 8 == 0))
    groups = brute_components([(r.doc_id, r.text) for r in seen["toxicity"].collect()], 5, 80, 100)
    assert {r.doc_id for r in seen["ngram_jaccard"].collect()} == {c for _, c in groups.values()}
    private = {r.doc_id: r.text for r in seen["pii"].collect()}
    assert len(private) == seen["ngram_jaccard"].count() and not any(brute_spans(t) for t in private.values())
    assert {i: private[i] for i in private if i % 9 and i < 400} == {i: rows[i][1] for i in private if i % 9 and i < 400}
    taken = [r.doc_id for r in seen["mixing"].collect()]
    assert set(taken) <= set(private) and max(map(taken.count, set(taken))) <= 3
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = seen["bpe_codec"].collect()
    assert sorted(r.doc_id for r in coded) == sorted(taken)
    for r in coded[:50]:
        assert bpe_codec.decode(np.array(r["ids"], "<u4").tobytes(), path).decode() == (private[r.doc_id] or "") and r.n_tokens == len(r["ids"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(coded)
    assert pii.KINDS == ("email", "ip", "card", "phone")


def test_stages_keep_what_they_do_not_know(spark, tmp_path):
    """Columns named like those of the operators, nulls, repeated rows and empty tables, in every stage."""
    extra = ["copies", "__score", "__row", "__base", "__same", "__added", "__id", "__source", "size", "target", "f1", "n", "kept", "score", "base"]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    mark = lambda i: [f"{c}{i}" for c in extra]
    rows = [(i, f"word{i} other{i * 7} third{i} " * 6 + (f"me{i}@ex.org" if i % 3 == 0 else ""), "en", f"s{i % 2}", 3, *mark(i)) for i in range(30)]
    rows += [(1, rows[1][1], "en", "s1", 3, *mark(1)), (40, None, None, None, None, *mark(40)), (41, "", "en", "s1", 0, *[None] * len(extra)), (None, "no id at all here", "en", None, 4, *mark(50))]
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for j, given in enumerate((spark.createDataFrame(rows, kinds), spark.createDataFrame([], kinds))):
            given.write.parquet(str(tmp_path / f"in{k}{j}"))
            docs = spark.read.parquet(str(tmp_path / f"in{k}{j}"))
            out = stage(spark, docs, str(tmp_path)).collect()
            assert j == 0 or out == []
            if name == "bpe_codec":
                assert len(out) == len(rows) * (1 - j)
                continue
            for r in out:
                assert [r[c] for c in extra] in (mark(50 if r.doc_id is None else r.doc_id), [None] * len(extra))
            if j == 0:
                ids = [r.doc_id for r in out]
                assert set(ids) <= {r[0] for r in rows} and (name in ("toxicity", "mixing") or set(ids) == {r[0] for r in rows})
                assert name != "pii" or (len(out) == len(rows) and {r.doc_id for r in out if "@" in (r.text or "")} == set())
                assert name != "ngram_jaccard" or ids.count(1) == 1
