"""Quotation links and reply order against a plain version in Python."""

import re
from collections import Counter

import numpy as np

from piste.llm import quotes

ENDS = re.compile(r"(?<=[.!?…؟۔।॥።]) |(?<=[。！？｡])")


def split_line(line):
    """(level, rest) of a line: marks at most three blanks apart."""
    lead = re.split(r"\s{4}", re.match(r"[\s>]*", line)[0])[0]
    if ">" not in lead:
        return 0, line
    end = lead.rindex(">") + 1
    return lead.count(">"), re.sub(r"^\s", "", line[end:])


def units(texts):
    parts = [p for t in texts for p in [t, *re.split(r"\n\s*\n", t), *t.split("\n")]]
    plain = [re.sub(r"\s+", " ", p).strip(" ").lower() for p in parts]
    return {u.strip(" ") for p in plain for u in [p, *ENDS.split(p)]} - {""}


def runs(text):
    out = []
    for level, rest in map(split_line, re.split(r"\r?\n", text)):
        if out and out[-1][0] == level:
            out[-1][1].append(rest)
        else:
            out.append((level, [rest]))
    return [(level, "\n".join(rest)) for level, rest in out]


def plain_version(rows):
    """Parent and place of every message (conv, turn, text), for distinct turns, and who is joined."""
    said, asked = {}, {}
    for m in sorted(rows):
        own = [t for level, t in runs(m[2]) if level == 0]
        whole = "\n".join(r for level, r in map(split_line, re.split(r"\r?\n", m[2])) if level == 0).strip(" \t\n")
        for u in units([*own, whole]) if whole else ():
            said.setdefault(u, {}).setdefault(m[0], m)
        quoted = [t for level, t in runs(m[2]) if level == 1]
        asked[m] = units([*quoted, "\n".join(quoted)]) if quoted else set()
    parent = {}
    for m in rows:
        here, there = Counter(), Counter()
        for u in asked[m]:
            first = said.get(u, {})
            if m[0] in first and first[m[0]][1] < m[1]:
                here[first[m[0]]] += 1
            elif len(u) >= quotes.LEAST_CHARS and (others := [c for c in sorted(first)[:2] if c != m[0]]):
                there[first[others[0]]] += 1
        earlier = [x for x in rows if x[0] == m[0] and x[1] < m[1]]
        if here:
            parent[m] = max(here, key=lambda x: (here[x], x[1]))
        elif earlier:
            parent[m] = max(earlier, key=lambda x: x[1])
        else:
            able = {x: n for x, n in there.items() if x[0] < m[0]}
            most = [x for x, n in able.items() if n == max(able.values())]
            parent[m] = most if most else None  # any of them: ids decide
    return parent


def walk(rows):
    """Reply order of result rows from their parents alone."""
    children, place = {}, {}
    for r in sorted((r for r in rows if r["turn"] is not None), key=lambda r: (r["turn"], r["id"])):
        children.setdefault(r["parent"], []).append(r)

    def visit(r, thread, n):
        place[r["id"]] = (thread, n)
        for c in children.get(r["id"], []):
            n = visit(c, thread, n + 1)
        return n

    for root in children.get(None, []):
        visit(root, root["id"], 0)
    return place


def test_links_and_order_equal_a_plain_version(spark):
    rng = np.random.default_rng(5)
    rows, words = [], "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    for conv in range(12):
        for turn in range(int(rng.integers(1, 12))):
            lines = []
            for _ in range(int(rng.integers(0, 3))):
                source = rows[int(rng.integers(len(rows)))] if rows and rng.random() < 0.3 else None
                mine = [r for r in rows if r[0] == conv]
                source = source or (mine[int(rng.integers(len(mine)))] if mine else None)
                if source:
                    some = source[2].split("\n")
                    lines += ["> " + x if x[:1] != ">" else ">" + x for x in some[: int(rng.integers(1, 3))]]
                lines.append(" ".join(rng.choice(words, 4)) + f" {conv} {turn}.")
            rows.append((conv, turn, "\n".join([*lines, f"message {turn} of conversation {conv} ends here. {rng.integers(10**6)}"])))
    m = spark.createDataFrame([(c, t, "user", x, 1, "x", 0.5) for c, t, x in rows],
                              "conv_id long, turn long, role string, text string, place long, thread string, block double")
    got = quotes.conversations(m, across=True).collect()
    by, of_id = {(r["conv_id"], r["turn"]): r for r in got}, {r["id"]: r for r in got}
    key = lambda x: x and (x[0], x[1])
    crossed = 0
    for x, want in plain_version(rows).items():
        r = by[key(x)]
        found = r["parent"] and (of_id[r["parent"]]["conv_id"], of_id[r["parent"]]["turn"])
        if isinstance(want, list):
            crossed += 1
            assert found in [key(w) for w in want]
        else:
            assert found == key(want), (x, found, want)
    assert crossed and sum(r["by"] == "quote" for r in got) > 20
    assert {r["id"]: (r["thread"], r["place"]) for r in got} == walk(got)
    assert [(r["thread"], r["place"]) for r in got] == sorted(((r["thread"], r["place"]) for r in got), key=lambda p: (of_id[p[0]]["conv_id"], p))


def test_order_follows_answers_and_not_turns(spark):
    rows = [(1, 0, "The first question stands here."), (1, 1, "An answer to the first one."), (1, 2, "> The first question stands here.\nAnother answer."),
            (1, 3, "> An answer to the first one.\nA remark on the first answer."), (2, 0, "> Another answer.\nseen elsewhere"), (2, 1, "indeed"), (3, None, "no turn")]
    m = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    joined = {(r["conv_id"], r["turn"]): r for r in quotes.conversations(m, across=True).collect()}
    assert [k for k in sorted(joined, key=lambda k: (joined[k]["thread"] != joined[1, 0]["thread"], joined[k]["place"]))][:6] == [
        (1, 0), (1, 1), (1, 3), (1, 2), (2, 0), (2, 1)]
    assert joined[2, 0]["parent"] == joined[1, 2]["id"] and joined[3, None]["thread"] == joined[3, None]["id"]
    apart = {(r["conv_id"], r["turn"]): r for r in quotes.conversations(m).collect()}
    assert apart[2, 0]["parent"] is None and apart[2, 1]["thread"] == apart[2, 0]["id"] and apart[1, 2]["place"] == 3


def test_hot_message_and_deep_chain(spark):
    first = "Everybody answers this very question."
    rows = [(1, 0, first)] + [(1, t, f"> {first}\nanswer number {t}") for t in range(1, 1500)] + [(2, t, f"chain {t}" if t % 2 else f"> chain {t - 1}\nchain {t}") for t in range(1, 600)]
    m = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = quotes.conversations(m, across=True).collect()
    assert {r["id"]: (r["thread"], r["place"]) for r in got if r["conv_id"] == 1} == {k: v for k, v in walk([r for r in got if r["conv_id"] == 1]).items()}
    assert sorted(r["place"] for r in got if r["conv_id"] == 2) == list(range(599))
