"""What the operators once left out: each of these failed before it was added."""

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from piste.llm import lengths, licences, ngram_join, order_minhash, pii, quotes, secrets


def test_pairs_under_an_unlike_head_stay_candidates(spark):
    rng = np.random.default_rng(3)
    head, one = (rng.integers(0, 1 << 32, 128, np.uint32) for _ in range(2))
    two, half, under = one.copy(), one.copy(), one.copy()
    two[:10] += 1  # agrees with one in 118 of 128 values, with the head in none
    half[:55] = head[:55]  # linked to the head
    under[:45] = head[:45]  # not linked to the head, but agrees with the one above in 118
    rows = [(1, [7], head.tobytes()), (2, [7], one.tobytes()), (3, [7], two.tobytes()),
            (11, [8], head.tobytes()), (12, [8], half.tobytes()), (13, [8], under.tobytes()),
            (21, [9], head.tobytes()), (22, [9], one.tobytes())]
    vertices = spark.createDataFrame(rows, "id long, keys array<long>, sig binary")
    near = ngram_join.near_agreement(0.8, 128)
    for block in (256, 1):  # 1: every pair meets in a block pair of its own
        root = {r["id"]: r["root"] for r in ngram_join.candidate_groups(vertices, 0.4, near, block).collect()}
        assert root == {2: 2, 3: 2, 11: 11, 12: 11, 13: 11}


def test_short_copies_of_a_passage_that_a_longer_text_heads(spark, documents):
    passage = " ".join(f"shared{i}" for i in range(50))
    pairs = [(100 + k, f"{passage} end{k // 2}") for k in range(2)]
    heads = [(k, passage + " " + " ".join(f"own{k}x{i}" for i in range(90))) for k in range(60)]
    got = {r["doc_id"]: r for r in ngram_join.join(documents(heads + pairs + [(200, f"{passage} last")])).collect()}
    assert got[100]["copies"] == 2 and got[100]["links"] == got[200]["links"] == 2 and got[200]["class_id"] == 100


def test_numbers_that_stand_together_are_each_proposed():
    card, other = "4111 1111 1111 1111", "5500 0000 0000 0004"
    for text, spans in ((f"{card} {other}", [("card", 0, 19), ("card", 20, 39)]), (f"{card} 12 2027 123", [("card", 0, 19)]),
                        ("call +49 30 1234567 2024-11-30 12:15", [("phone", 5, 19)]), ("x(030) 1234567 5000.00 17.50 881234", [("phone", 1, 14)])):
        assert set(spans) <= set(pii.candidates(text))
    assert len(pii.candidates("1 " * 100_000)) < 3_000_000


def test_cards_beside_other_numbers_are_redacted(spark, documents):
    def card(k):
        d = f"4{k:014d}"
        full = next(d + c for c in "0123456789" if pii._luhn(d + c))
        return " ".join(full[i : i + 4] for i in range(0, 16, 4))

    rows = [(i, f"paid by card {card(7919 * i)} on time") for i in range(200)]
    rows += [(i, f"paid by card {card(104729 * i)} {card(7919 * i + 1)} on time") for i in range(200, 400)]
    texts = {r["doc_id"]: r["text"] for r in pii.redact(documents(rows)).collect()}
    assert all(sum(c.isdigit() for c in t) == 0 for k, t in texts.items() if k < 200)
    left = [sum(c.isdigit() for c in t) for k, t in texts.items() if k >= 200]
    assert sum(n == 0 for n in left) >= 100, left


def test_credential_context_in_longer_names_and_wide_blanks():
    hard = "P@ss!9xQ#v2L"
    for text in (f"DB_PASSWORD={hard}", f"client_secret: {hard}", f"password{' ' * 11}= {hard}", f"password\t=\t{hard}", f"userpass={hard}",
                 f"dbPassword => '{hard}'", f"token_prod -> {hard}", f"auth={hard}", f"passKey={hard}", f"credentials: {hard}", f"the passcode is {hard}"):
        at = text.index(hard)
        assert secrets.added_spans(text, secrets.base_spans(text), {}, 10) == [("guess", at, at + len(hard))], text
    for text in (f"passenger: {hard}", f"shopping is {hard}", f"author: {hard}"):
        assert secrets.added_spans(text, [], {}, 10) == []
    assert list(secrets.in_context("pass" * 100_000 + " " * 100_000)) == []


def test_every_counted_word_has_a_rank_and_lowers_the_cost(spark, documents):
    name = lambda k: "w" + "".join(chr(97 + k // 26**j % 26) for j in range(4))
    common = " ".join(f"{name(k)} {name(k)} {name(k)}" for k in range(25_000))
    rows = [(1, common), (2, "qzxjvkwpfq"), (3, "token is qzxjvkwpfq"), (4, "pin is bvxjvkwpfq"), (4, "password=aaaaaaaa1 pwd is hgtrplmnzq!x"), (5, None)]
    ranks = {r["word"]: r["rank"] for r in secrets.word_ranks(documents(rows)).collect()}
    assert sorted(ranks.values()) == list(range(1, 25_002))  # qzxjvkwpfq is the one more
    assert ranks[min(name(k) for k in range(25_000))] <= 3 and ranks["qzxjvkwpfq"] > 25_000
    got = sorted((r["doc_id"], r["n_assign"], r["spans"]) for r in secrets.scan(documents(rows)).collect())
    assert got == [(1, 0, ""), (2, 0, ""), (3, 0, ""), (4, 0, "guess:7:17"), (4, 1, "assign:0:18,guess:26:38"), (5, 0, "")]


def test_quotes_of_lines_short_sentences_and_other_scripts(spark):
    rows = [(1, 0, "u", "first point\nsecond point\nthird one"), (1, 1, "a", "Why not? It is late."), (1, 2, "u", "私は行く。明日は雨です。"),
            (1, 3, "a", "unrelated"),
            (1, 4, "u", "> first point\nyes\n> second point\nno"), (1, 5, "u", "> Why not?\nbecause"), (1, 6, "u", "> 明日は雨です。\nso"),
            (1, 7, "u", "> first point second point third one\nre-wrapped"),
            (2, 0, "u", "> a sentence said elsewhere too.\nok"), (2, 1, "a", "A sentence said elsewhere too."), (3, 5, "a", "A sentence said elsewhere too."),
            (4, 0, "u", "> yes\nok")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.conversations(m).collect()}
    ids = {k: r["id"] for k, r in got.items()}
    for turn, parent in ((4, 0), (5, 1), (6, 2), (7, 0)):
        assert got[1, turn]["parent"] == ids[1, parent] and got[1, turn]["by"] == "quote"
    assert got[2, 0]["quoted"] == [ids[3, 5]]  # said later in its own conversation, which comes first
    assert got[4, 0]["quoted"] is None and got[1, 3]["by"] == "turn"


def test_lines_of_a_million_marks_and_blanks(spark):
    deep = ">" * 1_000_000 + " far down"
    rows = [(1, 0, "user", "far down"), (1, 1, "user", deep), (1, 2, "user", " " * 1_000_000 + "x\n" + "> " * 100_000 + "y"), (1, 3, "user", "    > four blanks\n>    > x")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r for r in quotes.conversations(m).collect()}
    assert got[1]["quoted"] == [got[0]["id"]] and got[1]["own"] == ""
    assert got[3]["own"].strip() == "> four blanks"
    lines = m.select("turn", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("turn", "i", quotes.level(F.col("line")).alias("level"))
    levels = [r["level"] for r in lines.orderBy("turn", "i").collect()]
    assert levels == [0, 1_000_000, 0, 100_000, 0, 1]


def plain_length(text):
    own = lengths.encoder(lengths.RANKS, lengths.PATTERN)
    return len(own.encode_ordinary(text))


def test_long_runs_are_encoded_as_by_the_pattern():
    own = lengths.encoder(lengths.RANKS, lengths.PATTERN)
    for run in (" " * 2000, "\n" * 2000, " \n\t　\xa0" * 400, " " * 1024):
        for before in ("", "word", "a.", "x "):
            for after in ("", "word", " ", "\x1c", "7", "'s", "\n"):
                text = before + run + after
                assert lengths.encoded_length(text, own) == plain_length(text), (before, run[:3], after)
                assert lengths.encoded_length(text + "mid" + text, own) == plain_length(text + "mid" + text)


def test_texts_of_one_character_a_million_times(spark, documents):
    rows = [(i, c * n) for i, (c, n) in enumerate([(" ", 10**6), ("\n", 10**6), ("x", 10**6), ("7", 10**6), ("-", 10**6), (" ", 10**7)])]
    got = {r["n_tokens"]: r["n_docs"] for r in lengths.histogram(documents(rows)).collect()}
    assert sum(got.values()) == 6 and max(got) == 10**7


def test_personal_data_in_a_number_table(spark, documents):
    import random

    rng = random.Random(2)
    table = "\n".join(" ".join(str(rng.randrange(10)) for _ in range(40)) for _ in range(500))
    rows = [(i, f"mail me at user{i}@example{i % 7}.org or call +49 30 {1234567 + i}") for i in range(200)] + [(900, table), (901, table)]
    got = {r["doc_id"]: r for r in pii.scan(documents(rows), training_candidates=500).collect()}
    assert len(got) == 202 and got[900]["spans"] == got[901]["spans"] and got[5]["n_email"] == got[5]["n_phone"] == 1


def test_a_task_keeps_no_more_training_rows_than_asked_for():
    least = pii._Least(10)
    keys = np.random.default_rng(1).permutation(1000).tolist()
    for at in range(0, 1000, 100):
        least.add([(k,) for k in keys[at : at + 100] if k <= least.limit])
        assert len(least.rows) <= 20
    assert least.cut() == [(k,) for k in range(10)]


def brute_selection(text, trained):
    """Every candidate scored alone, then taken greedily."""
    own, (model, thresholds) = pii.base_spans(text), trained
    scored = []
    for s in pii.candidates(text):
        if s not in own and not any(a < s[2] and s[1] < b for _, a, b in own):
            score = model.score(pii.features(text, [s]))[0]
            if score >= thresholds[s[0]]:
                scored.append((-score, s[1], s[2], s[0]))
    out = []
    for _, a, b, k in sorted(scored):
        if not any(x < b and a < y for _, x, y in out):
            out.append((k, a, b))
    return own, out


def test_selected_spans_equal_a_plain_loop(spark, documents):
    rows = [(i, f"call (030) {7000000 + 37 * i} or +49 30 {1234567 + i}, host 10.0.{i}.7 and 10.0.{i}.700, user(at)site{i}.org a@b{i}.de 4111 1111 1111 {1000 + i} {i} 2027")
            for i in range(150)]
    trained = pii.train(documents(rows))
    assert trained is not None
    model, _ = trained
    loose = (model, dict.fromkeys(pii.BASE, 0.05))
    for _, t in rows[:20]:
        assert pii.all_spans(t, trained) == brute_selection(t, trained)
        assert pii.all_spans(t, loose) == brute_selection(t, loose) and pii.all_spans(t, loose)[1]


def test_words_of_any_length_have_ranks(spark, documents):
    word = "donaudampfschifffahrtsgesellschaftskapitaen"
    docs = documents([(i, f"der {word} kommt") for i in range(40)] + [(99, f"password: {word}")])
    ranks = {r["word"]: r["rank"] for r in secrets.word_ranks(docs).collect()}
    assert ranks[word] <= 4 and secrets.guess_cost(word, ranks) < 2 < secrets.guess_cost(word, {})
    assert "guess" not in {r["doc_id"]: r["spans"] for r in secrets.scan(docs).collect()}[99]


def test_license_bands_of_several_rows_use_functions_of_their_own(documents):
    assert len(set(licences.factors(1000).tolist())) == 1000
    text = "intro words here " + licences.TEMPLATES["MIT-grant"] + " and more words after it"
    got = licences.scan(documents([(1, text)]), rows=3).collect()
    assert [r["template"] for r in got] == ["MIT-grant"] and got[0]["containment"] == 1.0


def test_texts_without_blanks_are_compared_by_character(spark, documents):
    rng = np.random.default_rng(8)
    sentences = ["".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 12)) + "。" for _ in range(61)]
    one, two = "".join(sentences[:60]), "".join(sentences[:59] + sentences[60:])
    got = {r["doc_id"]: r for r in ngram_join.join(documents([(1, one), (2, two)])).collect()}
    assert got[1]["links"] == got[2]["links"] == 1
    changed = one[:400] + "字" + one[400:]
    f = order_minhash.fingerprint("text")
    docs = documents([(1, one), (2, changed)]).select("doc_id", f.alias("f"))
    a, b = [r["f"] for r in docs.orderBy("doc_id").collect()]
    assert sum(a[i : i + 8] == b[i : i + 8] for i in range(0, len(a), 8)) > 20


def test_next_documents_of_ids_at_both_ends_and_of_repeated_rows(spark, documents):
    rng = np.random.default_rng(9)
    rows = [(-(2**63), "first text of all"), (2**63 - 1, "the last id there is"), (None, "no id"), (None, "no id either")]
    rows += [(2**62 + i, f"crowded text number {i} with words {int(rng.integers(9))}") for i in range(300)]
    rows += [(5, f"one id of many texts {i}") for i in range(200)] + [(7, "the same row again")] * 150
    docs = documents(rows)
    got = order_minhash.fingerprints(docs, copies_at_once=40).collect()
    hashes = dict(docs.select("text", F.xxhash64("text")).distinct().collect())
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1]]))
    want = Counter()
    for k, (i, t) in enumerate(order):
        nxt, half = order[(k + 1) % len(order)][1], len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    keys = spark.createDataFrame([(i, j) for i in range(100) for j in range(3)], "doc_id long, hash long")
    block, heads = order_minhash.blocked(keys, 20, 64)
    sizes = Counter(r[0] for r in keys.select(block).collect())
    assert len(sizes) == heads.count() >= 10 and max(sizes.values()) <= 60
