import numpy as np
import pytest

from piste.llm import common, ngram_join, tiling


def brute(rows, threshold=0.8):
    sets = [set(common.shingles(t).tolist()) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return links, [top(i) for i in range(len(rows))]


@pytest.fixture(scope="module")
def near_rows():
    rng, rows = np.random.default_rng(3), []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(30, 120)))]
        for _ in range(int(rng.integers(1, 14))):
            words = list(base)
            for p in rng.integers(0, len(words), int(rng.integers(0, 4))):
                words[p] = f"edit{rng.integers(10**9)}"
            rows.append((len(rows), " ".join(words)))
    return rows + [(len(rows) + k, rows[0][1].upper()) for k in range(3)]


def test_join_equals_brute_force(documents, near_rows):
    links, tops = brute(near_rows)
    got = {r["doc_id"]: r for r in ngram_join.join(documents(near_rows)).collect()}
    assert [got[i]["links"] for i in range(len(near_rows))] == links
    assert [got[i]["class_id"] for i in range(len(near_rows))] == tops


def test_join_in_small_blocks_is_the_same(documents, near_rows):
    keys = ("doc_id", "class_id", "links")
    a = {tuple(r[k] for k in keys) for r in ngram_join.join(documents(near_rows)).collect()}
    b = {tuple(r[k] for k in keys) for r in ngram_join.join(documents(near_rows), block=5).collect()}
    assert a == b


def test_join_edges(spark, documents, edge_rows):
    got = ngram_join.join(documents(edge_rows)).collect()
    assert len(got) == len(edge_rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["class_id"] for i in (1, 2, 3)] == [1, 2, 3] and by[2]["links"] == 0
    assert by[6]["class_id"] == by[7]["class_id"] == 6 and by[7]["links"] == 2
    assert by[None]["class_id"] < 0
    kept = ngram_join.representatives(documents(edge_rows))
    assert kept.columns == documents([]).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "6", "8", "None"])
    assert ngram_join.join(documents([])).count() == 0


def test_a_doc_id_of_several_texts_loses_no_link(documents):
    rows = [(1, "one two three four five six seven eight"), (2, "one two three four five six seven eight"), (1, "one two three four five six seven eight nine"), (1, "other words of no one else here at all")]
    got = sorted((r["doc_id"], r["links"], r["copies"]) for r in ngram_join.join(documents(rows)).collect())
    assert got == [(1, 0, 1), (1, 2, 1), (1, 2, 2), (2, 2, 2)]
    assert len({r["class_id"] for r in ngram_join.join(documents(rows)).collect()}) == 2
    assert ngram_join.representatives(documents(rows)).count() == 2


def test_null_ids_do_not_name_a_class_of_others(documents):
    base = [f"w{i}" for i in range(40)]
    rows = [(9, " ".join(base)), (None, " ".join([*base, "more"])), (4, " ".join(["first", *base]))]
    assert {r["class_id"] for r in ngram_join.join(documents(rows)).collect()} == {4}


def test_columns_of_any_name_pass_through(documents):
    docs = documents([(1, "a b c d e f"), (2, "a b c d e f")])
    for name in ("own_hash", "STAYS_ID", "stays_hash", "_id", "th", "sig"):
        docs = docs.withColumn(name, docs["doc_id"])
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns and [r["sig"] for r in kept.collect()] == [1]


def test_prefix_shortens_until_the_recall_is_reached():
    assert ngram_join.adaptive_depth(0.8, 16, 8, 0.99) == 6
    assert ngram_join.adaptive_depth(0.8, 16, 8, 0.5) == 8
    assert ngram_join.adaptive_depth(0.1, 1, 8, 0.99) == 1


def slow_tiles(item, doc, least):
    """Greedy string tiling as defined: scan all start pairs for the longest unmarked match."""
    a, b, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return out
        out.append((i, j, k))
        a[i : i + k] = [True] * k
        b[j : j + k] = [True] * k


def test_tiles_cover_what_the_definition_covers():
    rng = np.random.default_rng(2)
    for _ in range(60):
        item, doc = rng.integers(0, 4, 18).tolist(), rng.integers(0, 4, 40).tolist()
        least = 3
        pairs = [(i, j) for i in range(len(item) - 2) for j in range(len(doc) - 2) if item[i : i + 3] == doc[j : j + 3]]
        got = tiling.tiles(np.array(pairs), least) if pairs else []
        want = slow_tiles(item, doc, least)
        assert sorted(n for *_, n in got) == sorted(n for *_, n in want)
        assert all(item[i : i + n] == doc[j : j + n] for i, j, n in got)


def test_reordered_passages_are_caught_and_clean_ones_kept(spark, documents, edge_rows):
    item = " ".join(f"q{i}" for i in range(30))
    halves = item.split()[15:] + ["noise", "noise"] + item.split()[:15]
    rows = [(1, "pre " + item + " post"), (2, " ".join(halves)), (3, " ".join(item.split()[:12])), (4, "clean text of its own")]
    bench = spark.createDataFrame([(7, item, "x"), (8, None, "x"), (9, "", "x"), (10, "two words", "x")], "item_id long, text string, doc_id string")
    docs = documents(rows + [(i + 100 if i else None, t) for i, t in edge_rows])
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in tiling.contaminated(docs, bench).collect()}
    assert got == {(1, 7): 1.0, (2, 7): 1.0}
    small = {(r["doc_id"], r["item_id"]) for r in tiling.contaminated(docs, bench, listed_pairs=1).collect()}
    assert small == set(got)
    left = tiling.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 2
    assert tiling.contaminated(docs, bench.where("false")).count() == 0


def test_a_passage_repeated_many_times_is_one_match(documents, spark):
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = tiling.contaminated(documents([(1, " ".join([item] * 5000)), (2, " ".join(["q1 q2 q3 q4 q5"] * 3000))]), bench).collect()
    assert [(r["doc_id"], r["coverage"], r["tiles"]) for r in got] == [(1, 1.0, 1)]


def test_tiles_row_by_row_are_the_same():
    rng = np.random.default_rng(7)
    for _ in range(60):
        item, doc = rng.integers(0, 3, int(rng.integers(3, 25))), rng.integers(0, 3, int(rng.integers(3, 60)))
        pairs = [(i, j) for i in range(len(item) - 2) for j in range(len(doc) - 2) if (item[i : i + 3] == doc[j : j + 3]).all()]
        want = tiling.tiles(np.array(pairs), 3, len(item)) if pairs else []
        got = tiling.tiles_by_rows(item.astype(np.uint64), doc.astype(np.uint64), 3)
        assert sum(n for *_, n in got) == sum(n for *_, n in want) and sorted(got) == sorted(want)


def test_repeated_words_take_little_memory_and_time():
    import time
    import tracemalloc

    item, doc = np.full(400, 7, np.uint64), np.full(40_000, 7, np.uint64)
    tracemalloc.start()
    start = time.time()
    assert tiling.covered(item, doc, 5) == (1.0, 1)
    assert time.time() - start < 20 and tracemalloc.get_traced_memory()[1] < 50_000_000
    tracemalloc.stop()


def test_items_and_documents_without_id_count(spark, documents):
    item = " ".join(f"q{i}" for i in range(30))
    bench = spark.createDataFrame([(None, item), (None, item), (4, item), (5, None)], "item_id long, text string")
    docs = documents([(1, item), (None, "x " + item), (None, "other words that no item holds at all"), (1, "another text under one id of its own")])
    got = sorted((str(r["doc_id"]), str(r["item_id"]), r["coverage"]) for r in tiling.contaminated(docs, bench).collect())
    assert got == [("1", "4", 1.0), ("1", "None", 1.0), ("None", "4", 1.0), ("None", "None", 1.0)]
    assert sorted(r["text"] for r in tiling.clean(docs, bench).collect()) == ["another text under one id of its own", "other words that no item holds at all"]


def slow_pairs(docs, items, least=5, coverage=0.6):
    out = set()
    for d, text in docs:
        for i, item in items:
            a, b = common.word_hashes(item).tolist(), common.word_hashes(text).tolist()
            if a:
                n = sum(k for *_, k in slow_tiles(a, b, min(least, len(a))))
                if n / len(a) >= coverage:
                    out.add((d, i, n / len(a)))
    return out


def test_pairs_equal_brute_force(spark, documents):
    rng = np.random.default_rng(11)
    vocabulary = [f"v{i}" for i in range(25)]
    items = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 14))))) for i in range(25)]
    docs = []
    for d in range(40):
        words = rng.choice(vocabulary, int(rng.integers(0, 25))).tolist()
        for i in rng.integers(0, 25, 2):
            own = items[i][1].split()
            cut = int(rng.integers(0, len(own) + 1))
            words += own[cut:] + ["gap"] * int(rng.integers(0, 2)) + own[:cut]
        docs.append((d, " ".join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["coverage"]) for r in tiling.contaminated(documents(docs), bench).collect()}
    assert got == slow_pairs(docs, items)
