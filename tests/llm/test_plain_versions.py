"""Fingerprints, scores and pipeline stages against plain versions; stages on rows of every odd kind."""

import re
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from piste.llm import common, ngram_join, order_minhash, pii, quality, tiling
from piste.llm.common import staged, table

SF = "/root/testdata/sf0.001"


def chained(parts, seed=42):
    """Spark's xxhash64 of several values: each seeds the next one."""
    for p in parts:
        seed = xxhash.xxh64_intdigest(p, seed)
    return seed


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def plain_fingerprint(text, k=3, bits=5, width=2):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]
    grams = [words] if 0 < len(words) < k else [words[i : i + k] for i in range(len(words) - k + 1)]
    seen, packed = Counter(), []
    for i, g in enumerate(grams):
        h = signed(chained([w.encode() for w in g]))
        numbered = chained([h.to_bytes(8, "little", signed=True), seen[h].to_bytes(4, "little")])
        seen[h] += 1
        packed.append(((numbered >> 26) << 26 | i, i))
    out = []
    for r in range(1 << bits):
        own = sorted((x, i) for x, i in packed if x >> (64 - bits) == r)[:width]
        hashes = [(x >> 27) & ((1 << 37) - 1) for x, _ in sorted(own, key=lambda p: p[1])]
        out.append(f"{chained([h.to_bytes(8, 'little') for h in hashes]) & 0xFFFFFFFF:08x}" if own else "-" * 8)
    return "".join(out)


def test_fingerprints_equal_a_plain_version(spark, documents, edge_rows):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["la", "lu", "é", "x1", "wörter", "and,"], int(rng.integers(0, 80))))) for i in range(60)]
    rows += [(100 + k, t) for k, (_, t) in enumerate(edge_rows) if t is None or len(t) < 100_000]
    got = documents(rows).select("doc_id", order_minhash.fingerprint("text").alias("f")).collect()
    want = dict(rows)
    assert all(r["f"] == plain_fingerprint(want[r["doc_id"]]) for r in got)


def test_scores_equal_a_plain_version():
    rng = np.random.default_rng(3)
    model = quality.Model(rng.normal(size=1 << 12).astype(np.float32), 0.25, 1 << 12)

    def trigram(chars):
        h = 3
        for c in chars:
            h = ((h ^ ord(c)) * 0x01000193) % (1 << 32)
            h ^= h >> 15
        return ((h * 0x85EBCA6B) % (1 << 32) >> 7) % model.buckets

    def plain(text):
        flat = re.sub(r"[ \t\n\x0b\f\r]", " ", text or "")
        parts = [trigram(flat[i : i + 3]) for i in range(len(flat) - 2) if flat[i + 1] != " "]
        hashes = [int(common.words(np.frombuffer(w.encode(), np.uint8), np.ones(len(w.encode()), bool))[0][0]) for w in flat.split()]
        parts += [h % model.buckets for h in hashes]
        parts += [int(common.mix(np.array([(a ^ b) + 1], np.uint64))[0]) % model.buckets for a, b in zip(hashes, hashes[1:])]
        logit = sum(float(model.weights[p]) for p in parts) / max(len(parts), 1) + model.bias
        return 1 / (1 + np.exp(-logit))

    for text in (None, "", " ", "ab", "the cat sat", "tab\tand\nline  two", "héé 漢字 word", "x" * 500 + " y"):
        assert quality.score_text(text, model) == pytest.approx(plain(text), abs=1e-6), text
    long_text = "word1 é " * 400_000
    a, b = quality.score_text(long_text, model), quality.score_text("word1 é " * 40_000, model)
    assert abs(a - b) < 1e-4


def test_stages_equal_plain_versions(spark):
    docs = table(spark, SF, "documents")
    model = quality.train(docs, table(spark, SF, "labels").where(~quality.held_out()))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = staged(corpus_pipeline.good(spark, docs, SF), "test")
    kept = {i: t for i, t in rows.items() if quality.score_text(t, model) >= 0.5}
    assert {r["doc_id"] for r in good.collect()} == set(kept)

    sets = {i: set(common.shingles(t).tolist()) for i, t in kept.items()}
    parent = {i: i for i in kept}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(kept)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    unlike = staged(corpus_pipeline.distinct(spark, good, SF), "test")
    left = {i for i in ids if top(i) == i}
    assert {r["doc_id"] for r in unlike.collect()} == left

    items = [common.word_hashes(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    clean = {i for i in left if not any(len(x) and tiling.covered(x, common.word_hashes(kept[i]), 5)[0] >= 0.6 for x in items)}
    uncontaminated = staged(corpus_pipeline.uncontaminated(spark, unlike, SF), "test")
    assert {r["doc_id"] for r in uncontaminated.collect()} == clean and clean < left

    trained = pii.train(uncontaminated)
    private = {r["doc_id"]: r["text"] for r in corpus_pipeline.anonymous(spark, uncontaminated, SF).collect()}
    assert private == {i: pii.redacted(kept[i], sum(pii.all_spans(kept[i], trained), [])) for i in clean}
    assert any("[EMAIL]" in t for t in private.values())


def test_every_stage_takes_odd_rows(spark, documents, edge_rows):
    rows = [*edge_rows, (20, "x " * 50_000, None), (21, ">" * 1000, None), (22, "q", "s"), (22, "q", "s"), (2**63 - 1, "last id of all", "s"), (-(2**63), "first id of all", None),
            (23, "1 " * 20_000, "s"), (24, "漢字。" * 300, None)]
    docs = documents(rows).withColumnsRenamed({"block": "own_hash", "id": "stays_id"})
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, SF), "test")
        texts = {r["doc_id"]: r["text"] for r in out.collect()} if "text" in out.columns else {}
        if name != "mixing":
            assert out.columns == docs.columns, name
        if name in ("benchmark", "personal data"):
            assert out.count() == len(rows), name
            assert texts[1] is None and texts[2] == ""
        if name == "near duplicates":
            assert out.where("doc_id = 22").count() == 1 and {None, 1, 2, 3, 2**63 - 1, -(2**63)} <= {r["doc_id"] for r in out.collect()}
        if name == "mixing":
            assert 1 not in {r["doc_id"] for r in out.collect()} and out.where("words <= 0").count() == 0
        assert stage(spark, docs.limit(0), SF).count() == 0
