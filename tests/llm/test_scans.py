import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from piste.llm import boosting, licences, pii, secrets

PIECES = st.lists(st.sampled_from(["a@b.co", "@", ".", "x", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "+49 30 (1234) 567-8", "+", " ", "-", "password=", "token: ",
                                   "abcdefgh1", "AKIA", "ABCDEFGH12345678", "0123456789abcdef0123456789abcdef", "secret", ":", "=", "é", "7", "_d@e.f"]), max_size=14).map("".join)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_base_spans_are_those_of_the_plain_expressions(text):
    want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            want.append(("card", *m.span()))
    want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    assert sorted(pii.base_spans(text)) == sorted(want)
    assert set(want) <= set(pii.candidates(text))
    want = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
    want += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    want += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    assert sorted(secrets.base_spans(text)) == sorted(want)


def every_cost(value, ranks):
    """Guess cost by trying every segmentation, with the operator's costs for single parts."""
    best = {0: 0.0}
    for end in range(1, len(value) + 1):
        options = []
        for start in range(end):
            part = value[start:end]
            alone = secrets.guess_cost(part, ranks)
            options.append(best[start] + alone)
        best[end] = min(options)
    return best[len(value)]


def test_guess_costs():
    ranks = {"dragon": 1, "monkey": 50}
    assert secrets.guess_cost("dragon", ranks) < secrets.guess_cost("monkey", ranks) < secrets.guess_cost("dkwzqo", ranks)
    assert secrets.guess_cost("aaaaaaaaaa", ranks) < 3 and secrets.guess_cost("qwertyuiop", ranks) < 4
    assert secrets.guess_cost("2019-11-30", ranks) < 6 and secrets.guess_cost("k9$Xw2!qLz", ranks) > 10
    for value in ("dragonmonkey1999", "Dragon!!!qwert", "x7dragonzz"):
        assert secrets.guess_cost(value, ranks) == pytest.approx(every_cost(value, ranks))
    assert secrets.guess_cost("k9" * 20_000, ranks) > 1000


def test_scans_take_every_row(spark, documents, edge_rows):
    rows = edge_rows + [(20, "password is Zk9$vQ2!xLw7"), (21, "the password is dragon dragon")]
    got = {r["doc_id"]: r for r in secrets.scan(documents(rows)).collect()}
    assert got[20]["spans"] == "guess:12:24" and got[21]["spans"] == "" and got[20]["n_assign"] == 0
    assert got[1]["base_sha256"] == got[2]["base_sha256"]
    assert secrets.scan(documents(rows)).count() == len(rows)
    assert secrets.scan(documents([])).count() == 0


def test_pii_scan_and_redaction(spark, documents, edge_rows):
    people = [(i, f"mail me at user{i}@mail.example.org or +49 30 12345{i:02d} today") for i in range(30, 60)]
    people += [(i, f"order 4111-1111-1111-11{i} paid by card 4111 1111 1111 1111") for i in range(60, 90)]
    docs = documents(edge_rows + people)
    got = {r["doc_id"]: r for r in pii.scan(docs).collect()}
    assert got[30]["n_email"] == 1 and got[30]["n_phone"] == 1 and got[60]["n_card"] >= 1
    for r in got.values():  # base spans are kept among all
        assert r["spans"].count(":") // 2 >= r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[1] is None and texts[2] == "" and texts[30].startswith("mail me at [EMAIL] or [PHONE]")
    assert pii.scan(documents([])).count() == 0


def test_boosting_learns_and_calibration_holds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = (x[:, 0] > 0.3) ^ (x[:, 1] > 0)
    model = boosting.fit(x[:1500], y[:1500])
    score = model.score(x[1500:])
    assert ((score > 0.5) == y[1500:]).mean() > 0.95
    cut = boosting.calibrated(score, y[1500:], 0.9)
    assert y[1500:][score >= cut].mean() >= 0.9
    assert boosting.calibrated(np.array([0.5]), np.array([False]), 0.9) == float("inf")


def test_licences(spark, documents, edge_rows):
    rows = edge_rows + [(30, "some words here. Released under the MIT License. more"),
                        (31, "x " * 5000 + "this work is LICENSED under the GNU\nGeneral Public License version 3 " + "y " * 50),
                        (32, "the license of MIT students released a song"), (33, "Released under the MIT License. Released under the MIT License.")]
    got = sorted((r["doc_id"], r["template"], r["start"], r["end"]) for r in licences.scan(documents(rows)).collect())
    assert [g[:2] for g in got] == [(30, "MIT"), (31, "GPL-3.0"), (33, "MIT"), (33, "MIT")]
    assert rows[len(edge_rows)][1][got[0][2] : got[0][3]] == "Released under the MIT License"
    assert licences.scan(documents([])).count() == 0


def test_bands_reach_the_asked_probability():
    for s in (0.3, 0.5, 0.8):
        assert 1 - (1 - s**2) ** licences.band_count(s, 2, 0.999) >= 0.999


def every_window(text, templates, containment=0.8):
    """Templates whose shingles some stretch of the text holds to the asked share: every start, no bands."""
    import math

    found = set()
    g = licences.grams(licences.spanned_words(text or "")[0], licences.SHINGLE)
    for name, template in templates.items():
        own = np.unique(licences.grams(licences.spanned_words(template)[0], licences.SHINGLE))
        inside, need = np.flatnonzero(np.isin(g, own)), 1.0 if name in licences.TAGS else containment
        room = math.ceil(len(own) / need)
        if any(len(np.unique(g[inside[(inside >= k) & (inside < k + room)]])) >= need * len(own) for k in inside):
            found.add(name)
    return found


def test_retrieved_templates_equal_those_of_every_window(spark, documents):
    rng = np.random.default_rng(4)
    filler = [f"filler{i}" for i in range(400)]
    rows = []
    for i, text in enumerate(licences.TEMPLATES.values()):
        words = text.split()
        lost = set(rng.choice(len(words), int(rng.integers(0, max(1, len(words) // 8) + 1)), replace=False).tolist())
        kept = [w for k, w in enumerate(words) if k not in lost]
        rows.append((i, " ".join([*rng.choice(filler, int(rng.integers(0, 300))), *kept, *rng.choice(filler, int(rng.integers(0, 300)))])))
    given = [(10_000 + r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    found = {}
    for r in licences.scan(documents(rows + given)).collect():
        found.setdefault(r["doc_id"], set()).add(r["template"])
    want = {i: w for i, t in rows + given if (w := every_window(t, licences.TEMPLATES))}
    missed = sum(len(w - found.get(i, set())) for i, w in want.items())
    assert all(found[i] <= want.get(i, set()) for i in found) and sum(map(len, want.values())) > 80
    assert missed <= 0.005 * sum(map(len, want.values())), missed


def test_whole_license_texts_and_tags(documents):
    texts = licences.TEMPLATES
    rows = [(1, "Copyright (c) 2020 A. Person\n\n" + texts["BSD-3-Clause-text"]), (2, texts["LGPL-3.0-text"]), (3, "# SPDX-License-Identifier: GPL-2.0-or-later\nimport x"),
            (4, "Copyright 2019\n" + texts["ISC-text"]), (5, texts["Unlicense-text"]), (6, "this program is free of charge")]
    got = {}
    for r in licences.scan(documents(rows)).collect():
        got.setdefault(r["doc_id"], {})[r["template"]] = r["containment"]
    whole = {i: {t for t, share in found.items() if share == 1.0} for i, found in got.items()}  # variants hold most of each other
    assert whole == {1: {"BSD-3-Clause-text", "BSD"}, 2: {"LGPL-3.0-text", "LGPL-grant"}, 3: {"tag:GPL-2.0-or-later"},
                     4: {"ISC-text"}, 5: {"Unlicense-text", "Unlicense-notice"}}
    assert set(got[3]) == {"tag:GPL-2.0-or-later"} and got[2]["AGPL-3.0-text"] < 1
