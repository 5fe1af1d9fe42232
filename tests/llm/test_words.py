import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from piste.llm import common, graph

TEXT = st.text(alphabet="aB1_ .,\n\té中ก…。’\u0301\x00-", max_size=60)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_words_agree_with_a_regular_expression(text):
    # letters and digits of any script with their marks; unspaced scripts have a word per letter
    want = re.findall(r"[中ก]\u0301*|[0-9a-z_é\u0301]+", text.lower())
    got = common.word_hashes(text)
    assert len(got) == len(want)
    ids = {}
    for w, h in zip(want, got.tolist()):
        assert ids.setdefault(w, h) == h
    assert len(set(ids.values())) == len(ids)


def test_pieces_do_not_change_hashes(monkeypatch):
    text = " ".join(f"w{i}" for i in range(500)) + " " + "z" * 900
    whole = common.word_hashes(text)
    monkeypatch.setattr(common, "PIECE", 64)
    assert np.array_equal(common.word_hashes(text), whole)


def test_offsets_are_code_points():
    text = "Ünï \U0001f600 word"
    _, first, last = common.spanned_words(text)
    a, b = common.code_points(text, [first[-1], last[-1]])
    assert text[a:b] == "word"


def test_components_match_union_find(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 440)] + [(500, 500)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    got = {r["id"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in list(parent)}
