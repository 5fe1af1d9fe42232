import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from piste.llm import catalog, lengths, mixing, order_minhash, quality, quotes
from piste.llm.common import table

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    scored = {r["doc_id"]: r for r in catalog.op2_quality_classifier(spark, SF).collect()}
    known = [(scored[r["doc_id"]], r["quality"]) for r in table(spark, SF, "labels").collect()]
    held = [(r["predicted"], q) for r, q in known if r["held_out"]]
    assert len(scored) == table(spark, SF, "documents").count()
    assert np.mean([p == q for p, q in held]) > 0.95


def test_quality_edges(spark, documents, edge_rows):
    docs = documents(edge_rows)
    none = spark.createDataFrame([], "doc_id long, quality int, text string")
    model = quality.train(docs, none)
    assert {r[0] for r in docs.select(quality.scorer(docs, model)).collect()} == {0.5}
    some = spark.createDataFrame([(4, 1, "x"), (5, 0, "x"), (6, 1, "x"), (99, 0, "x"), (None, 1, "x")], "doc_id long, quality int, text string")
    got = [r[0] for r in docs.select(quality.scorer(docs, quality.train(docs, some))).collect()]
    assert len(got) == len(edge_rows) and all(0 <= s <= 1 for s in got)


def test_repeated_ids_do_not_outgrow_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(1, None), (2, "other words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    got = quality.sample(docs, labels, "quality", 1 << 10, 10)
    assert got["doc_id"].to_pylist() == [1, 2] and got["label"].to_pylist() == [0, 1]


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Share out, stop at the cap, reshare the excess, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > cap * sizes[s]}
        if not over:
            out |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixing_meets_targets(documents):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), [None, "a", "b", "é", "z", "hot", "hot", "hot"][int(rng.integers(8))]) for i in range(400)]
    rows += [(7, "w w w", "a"), (None, "w w", "a"), (900, None, "a"), (901, "", "empty")]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    got = mixing.plan(documents(rows)).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(c["words"] for c in r["copies"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    order = [r["position"] for r in mixing.in_order(mixing.plan(documents(rows)), 4).collect()]
    assert order == sorted(order) and all(0 <= p <= 1 for p in order)
    assert mixing.plan(documents([])).count() == 0


def test_training_time_inverts_the_integral(spark):
    from pyspark.sql import functions as F

    for knots in mixing.SCHEDULES:
        for row in spark.range(0, 101).select((F.col("id") / 100).alias("p")).withColumn("t", mixing.training_time(F.col("p"), knots)).collect():
            assert mixing._integral(knots, row["t"]) / mixing._integral(knots, 1.0) == pytest.approx(row["p"], abs=1e-9)


def test_length_totals(documents, edge_rows):
    encode = lengths.encoder(lengths.RANKS, lengths.PATTERN).encode_ordinary
    rows = [r for r in edge_rows if len(r[1] or "") < 10_000] + [(i, "tok " * i) for i in range(50)]
    n = [len(encode(t or "")) for _, t in rows]
    limits = lengths.by_limit(lengths.histogram(documents(rows)), width=16)
    got = {r["n_tokens"]: r for r in limits.collect()}
    assert set(got) == set(n)
    for k, r in got.items():
        assert r["n_docs"] == n.count(k) and r["docs_fit"] == sum(x <= k for x in n) and r["total_tokens"] == sum(n)
        assert r["truncated_tokens"] == sum(min(x, k) for x in n) and r["tokens_fit"] == sum(x for x in n if x <= k)
    asked = {r["share"]: r["n_tokens"] for r in lengths.quantiles(limits, (0.5, 1.0)).collect()}
    assert asked == {0.5: sorted(n)[-(-len(n) // 2) - 1], 1.0: max(n)}
    assert lengths.by_limit(lengths.histogram(documents([]))).count() == 0


def test_fingerprints_edit_the_right_texts(documents, edge_rows):
    rows = edge_rows + [(i, f"text number {i} " + "lorem ipsum dolor " * (i % 7)) for i in range(20, 5000, 13)]
    got = order_minhash.fingerprints(documents(rows)).collect()
    assert len(got) == len(rows)
    order = sorted(((r[0] is None, r[0] or 0, r[1] or "") for r in rows))
    want = Counter()
    for k, (none, i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][2]
        half = len(t) // 2
        want[(None if none else i, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    prints = defaultdict(set)
    for r in got:
        prints[r["n_chars"] == 13, r["doc_id"] in (6, 7)].add(r["fingerprint"])
    assert len(prints[True, True]) == 1
    assert order_minhash.fingerprints(documents([])).count() == 0


def test_fingerprints_follow_order_and_occurrence(spark, documents):
    words = [f"w{i}" for i in range(300)]
    moved = words[150:] + words[:150]
    few = list(words)
    few[100] = "edit"
    rows = [(1, " ".join(words)), (2, " ".join(few)), (3, " ".join(moved)), (4, " ".join(f"v{i}" for i in range(300))),
            (5, "la la la la la la"), (6, "la la la la la la la la la la la la")]
    f = {r["doc_id"]: r["f"] for r in documents(rows).select("doc_id", order_minhash.fingerprint("text").alias("f")).collect()}

    def like(a, b):
        x, y = ([f[k][i : i + 8] for i in range(0, len(f[k]), 8)] for k in (a, b))
        used = [(p, q) for p, q in zip(x, y) if p != "-" * 8 or q != "-" * 8]
        return sum(p == q for p, q in used) / len(used)

    assert like(1, 2) > 0.8 and like(1, 4) == 0 and like(1, 3) < like(1, 2)
    assert 0 < like(5, 6) < 1  # a set of k-mers would be the same


def test_quotation_links(spark):
    rows = [(1, 0, "user", "Where is the station of this town?\nI am lost here."),
            (1, 1, "assistant", "It is behind the old market hall. Ask for the clock."),
            (1, 2, "user", "> Where is the station\n> of this town?\nForget it, I found it."),
            (1, 3, "assistant", ">> Where is the station of this town?\n> Forget it, I found it.\nGood to hear that from you."),
            (2, 0, "user", "> It is behind the old market hall.\nIs that true of all towns?"),
            (None, 0, "user", None), (3, None, "user", "no turn"), (4, 0, "user", ""), (4, 0, "user", "")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.conversations(m).collect()}
    ids = {k: r["id"] for k, r in got.items()}
    assert got[1, 2]["parent"] == ids[1, 0] and got[1, 2]["by"] == "quote" and got[1, 2]["own"] == "Forget it, I found it."
    assert got[1, 3]["parent"] == ids[1, 2] and set(got[1, 3]["quoted"]) == {ids[1, 0], ids[1, 2]}
    assert got[1, 1]["parent"] == ids[1, 0] and got[1, 1]["by"] == "turn"
    assert got[2, 0]["parent"] is None and got[2, 0]["quoted"] == [ids[1, 1]]
    assert got[4, 0]["copies"] == 2 and got[3, None]["thread"] == ids[3, None]
    assert all(got[1, t]["thread"] == ids[1, 0] for t in range(4))
    assert quotes.conversations(m.limit(0)).count() == 0


def test_long_conversations_chain_across_windows(spark):
    m = spark.range(3000).selectExpr("1L as conv_id", "id * 7 as turn", "'user' as role", "concat('message number ', id) as text")
    rows = sorted(quotes.conversations(m).collect(), key=lambda r: r["turn"])
    assert rows[0]["parent"] is None
    assert all(b["parent"] == a["id"] for a, b in zip(rows, rows[1:]))
