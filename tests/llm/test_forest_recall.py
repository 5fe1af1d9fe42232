"""Recall of the forest on a given table, and of pairs whose vertices are left to twins."""

from collections import Counter, defaultdict

import numpy as np

from piste.llm import common, ngram_join
from piste.llm.common import table

SF = "/root/testdata/sf0.1"


def test_links_of_every_twentieth_document_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    sets = {r["doc_id"]: np.unique(common.shingles(r["text"])).tolist() for r in docs.select("doc_id", "text").collect()}
    holders = defaultdict(list)
    for d, s in sets.items():
        for h in s:
            holders[h].append(d)
    links = {r["doc_id"]: r["links"] for r in ngram_join.join(docs).collect()}
    found = asked = 0
    for d in (d for d in sets if d % 20 == 0):
        common_count = Counter(o for h in sets[d] for o in holders[h])
        want = sum(1 for o, n in common_count.items() if o != d and n >= 0.8 * (len(sets[d]) + len(sets[o]) - n) - 1e-9)
        assert links[d] <= want
        asked, found = asked + want, found + links[d]
    assert asked > 200 and found >= 0.99 * asked, (found, asked)


def test_twins_are_left_to_one_of_them_and_lose_no_link(spark, documents):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(6):  # long bases of many twins, and texts at about the threshold of each other
        base = [f"g{g}w{i}" for i in range(1500)]
        for k in range(12):
            words = list(base)
            words[int(rng.integers(1500))] = f"one{g}x{k}"
            rows.append((len(rows), " ".join(words)))
        far = list(base)
        for p in rng.choice(1500, 30, replace=False):
            far[p] = f"far{g}x{p}"
        for k in range(12):
            words = list(far)
            words[int(rng.integers(1500))] = f"two{g}x{k}"
            rows.append((len(rows), " ".join(words)))
    sets = [set(common.shingles(t).tolist()) for _, t in rows]
    want = [sum(1 for j, t in enumerate(sets) if j != i and len(s & t) >= 0.8 * len(s | t)) for i, s in enumerate(sets)]
    got = {r["doc_id"]: r["links"] for r in ngram_join.join(documents(rows)).collect()}
    assert [got[i] for i in range(len(rows))] == want and min(want) >= 11
    prefixes = [8, 6, 4]
    made = ngram_join.prints(documents(rows), 5, 16, 8, prefixes).select((ngram_join.F.col("doc_id")).alias("id"), "sig", "keys")
    whole = ngram_join._likeness(made, ngram_join.leaves(made, 0, 16))
    assert whole.where("agrees >= 127 / 128D - 0.001").select("id").distinct().count() > len(rows) // 2  # most stop at once
