"""Personal data by candidate gradient boosting.

High-recall generators propose spans that may overlap; boosted regression trees score each from
its format and its context; a threshold per kind, calibrated on candidates kept out of training,
selects those to redact beside the base spans (fixed formats with their validity rules).

The candidates' training labels are the validity rules themselves: a candidate is positive if it
is a valid base span, or would be one if it stood alone and no base span holds a part of it.  The
features hold its shape and surroundings but no rule's result, so what is added are spans that look
like, and stand like, valid ones.

Null text counts as empty; an empty text has no span; repeated rows each get their row; other
columns are ignored; an empty table, or one without candidates of both classes, adds nothing.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piste.llm.boosting import Boosted, calibrated, fit, fit_rows
from piste.llm.common import discard, staged
from piste.llm.spans import Span, digest_rows, digest_schema

BASE = ("email", "ip", "card", "phone")

LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]")

#: Wide generators, each a superset of a kind's base format.
WIDE = {
    "email": re.compile(r"[^\s@<>,;:()]{1,64}+(?:\x20?(?:@|\(at\)|\[at\])\x20?)[^\s@<>,;:()]{3,255}+"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,4}(?:[.:][0-9]{1,4}){3}(?![0-9])"),
}
#: Runs of digit groups that a card or phone may stand in, with its least and most digits.  Every
#: stretch of whole groups is proposed, so a number beside another one, or a date, is among them.
RUNS = {
    "card": (re.compile(r"[0-9]++(?:[\x20.-][0-9]++)*+"), 11, 21),
    "phone": (re.compile(r"[+(]?[0-9]++(?:[\x20()./-]{1,2}+[0-9]++)*+"), 7, 17),
}
_GROUP = re.compile(r"[0-9]+")
#: Words that announce a kind, in the corpus's languages.
CUES = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "anruf"),
}
CONTEXT = 24
FEATURES = 25
STEPS = 1 << 14  # possible thresholds, where there are too many scores for the driver
SCORED = 4096  # candidates scored at a time, so that memory does not follow a text's length


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Work from each @ outwards: the local part is the run before it, back to the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        m = DOMAIN.match(text, at + 1) if first < at else None
        if m:
            yield "email", first, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if "@" in text:
        found += _emails(text)
    if _DIGITS.search(text):
        if "." in text:
            found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(v := p.lstrip("0")) < 4 and int(v or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def _stretches(kind: str, text: str) -> Iterator[Span]:
    """Every stretch of whole digit groups of a run with a number of digits in the kind's range; a
    phone starts at the plus or bracket before it."""
    pattern, least, most = RUNS[kind]
    for run in pattern.finditer(text):
        groups = [m.span() for m in _GROUP.finditer(text, *run.span())]
        for i, (a, _) in enumerate(groups):
            start = a - 1 if kind == "phone" and a > run.start() and text[a - 1] in "+(" else a
            digits = 0
            for k in range(i, len(groups)):
                first, end = groups[k]
                digits += end - first
                if digits > most:
                    break
                if digits >= least:
                    yield kind, start, end


def proposed(text: str, own: set[Span]) -> Iterator[Span]:
    """Every span that a wide generator proposes beside the base spans, each once, one at a time."""
    marked, numbered = "@" in text or "at)" in text or "at]" in text, bool(_DIGITS.search(text))
    for kind, pattern in WIDE.items():
        if marked if kind == "email" else numbered:
            yield from (s for m in pattern.finditer(text) if (s := (kind, *m.span())) not in own)
    if numbered:
        for kind in RUNS:
            yield from (s for s in _stretches(kind, text) if s not in own)


def candidates(text: str) -> list[Span]:
    """Every span that a wide generator or a base format proposes, each once, in order."""
    own = set(base_spans(text))
    return sorted([*own, *proposed(text, own)], key=lambda s: (s[1], s[2], s[0]))


def _batches(spans: Iterator[Span]) -> Iterator[list[Span]]:
    while some := list(islice(spans, SCORED)):
        yield some


class _Taken:
    """Places of the text that spans hold, as disjoint ranges in order."""

    def __init__(self, spans: list[Span] = ()):
        self.starts, self.ends = [], []
        for _, a, b in sorted(spans, key=lambda s: s[1:]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        at = bisect_left(self.starts, b) - 1
        return at >= 0 and self.ends[at] > a

    def add(self, a: int, b: int) -> None:
        at = bisect_left(self.starts, a)
        self.starts.insert(at, a)
        self.ends.insert(at, b)


def _valid(text: str, span: Span, own: set[Span], taken: _Taken) -> bool:
    """Whether the span, taken alone, is a base span; a part of a longer base span is not."""
    kind, a, b = span
    return span in own or not taken.meets(a, b) and (kind, 0, b - a) in base_spans(text[a:b])


def features(text: str, spans: list[Span]) -> np.ndarray:
    """A row per span: its format and its context; no validity rule enters."""
    if not spans:
        return np.zeros((0, FEATURES))
    own = [text[a:b] for _, a, b in spans]
    before, after = [text[max(0, a - CONTEXT) : a] for _, a, _ in spans], [text[b : b + CONTEXT] for *_, b in spans]
    near = [f"{x} {y}".lower() for x, y in zip(before, after)]
    size = np.array([len(s) for s in own])
    owner, each = np.repeat(np.arange(len(own)), size), np.frombuffer("".join(own).encode("utf-32-le"), np.uint32)

    def share(test) -> np.ndarray:
        """How many characters of every span pass the test."""
        seen, place = np.unique(each, return_inverse=True)
        return np.bincount(owner, np.array([test(chr(c)) for c in seen], float)[place], len(own))

    digit = (each >= 48) & (each <= 57)
    starts = digit & ~np.concatenate([[False], digit[:-1] & (owner[1:] == owner[:-1])])
    group_owner, lengths = owner[starts], np.bincount(np.cumsum(starts)[digit] - 1) if starts.any() else np.zeros(0, np.int64)
    longest, shortest = np.zeros(len(own)), np.full(len(own), np.inf)
    np.maximum.at(longest, group_owner, lengths)
    np.minimum.at(shortest, group_owner, lengths)
    digits, last = share(str.isdigit), [s[-1:] for s in before]
    first = [s[:1] for s in after]
    return np.array([
        [BASE.index(k) for k, _, _ in spans], size, digits, digits / size, share(str.isalpha), *[share(c.__eq__) for c in ".- ("],
        [s.startswith("+") for s in own], [s.startswith("00") for s in own], share("@".__eq__) > 0, np.bincount(group_owner, minlength=len(own)),
        longest, np.where(np.isinf(shortest), 0, shortest), [len(set(s)) for s in own], np.array([s.rfind(".") for s in own]) / size,
        [sum(c in n for c in CUES[k]) for (k, _, _), n in zip(spans, near)], [c.isspace() or not c for c in last], [c.isalnum() for c in last],
        [c.isspace() or not c for c in first], [c.isalnum() for c in first], [c in ".,;" for c in first],
        [sum(map(str.isdigit, s)) for s in before], [sum(map(str.isdigit, s)) for s in after],
    ], float).T


class _Least:
    """Training rows of least key, ``count`` at most; memory for twice as many, whatever the texts hold."""

    def __init__(self, count: int):
        self.count, self.rows, self.limit = count, [], np.iinfo(np.int64).max

    def add(self, rows: list[tuple]) -> None:
        self.rows += rows
        if len(self.rows) > 2 * self.count:
            self.cut()

    def cut(self) -> list[tuple]:
        self.rows = heapq.nsmallest(self.count, self.rows)
        if len(self.rows) == self.count:
            self.limit = self.rows[-1][0]
        return self.rows


def train(docs: DataFrame, text: str = "text", training_candidates: int = 20_000, precision: float = 0.98) -> tuple[Boosted, dict] | None:
    """Model and thresholds from every candidate of every document.

    Equal candidates (kind, label and features) are one row with their number; up to
    ``training_candidates`` such rows are fitted on the driver, more in tasks.  The candidates of a
    quarter of all texts are kept out for calibration, so copies of a document stand on one side.
    """
    kinds_ = "held boolean, kind string, label boolean, x array<double>"

    def propose(batches):
        for batch in batches:
            for fold, t in zip(*(c.to_pylist() for c in batch.columns)):
                own = set(base_spans(t or ""))
                taken = _Taken(own)
                for spans in _batches(chain(sorted(own), proposed(t or "", own))):
                    x = features(t, spans)
                    cols = [fold == 0] * len(spans), [s[0] for s in spans], [_valid(t, s, own, taken) for s in spans], x.tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.bool_(), pa.string(), pa.bool_(), pa.list_(pa.float64())))],
                                                     names=["held", "kind", "label", "x"])

    asked = docs.select(F.expr(f"pmod(xxhash64(`{text}`), 4)").alias("fold"), text)
    made = staged(asked.mapInArrow(propose, kinds_).groupBy("held", "kind", "label", "x").agg(F.count(F.lit(1)).alias("n")), "candidates")
    fitted, kept = made.where("not held"), made.where("held")
    if fitted.select("label").distinct().count() < 2:
        return None
    if made.count() <= training_candidates:
        rows = made.orderBy("held", "kind", "label", "x").collect()
        held, x = np.array([r["held"] for r in rows], bool), np.array([r["x"] for r in rows], np.float64)
        y, n = np.array([r["label"] for r in rows], bool), np.array([r["n"] for r in rows])
        model = fit(x[~held], y[~held], n[~held])
        kinds, y, n = np.array([r["kind"] for r in rows])[held], y[held], n[held]
        score = model.score(x[held]) if held.any() else np.zeros(0)
    else:
        model = fit_rows(fitted)

        def steps(batches):
            for batch in batches:
                if batch.num_rows:
                    s = np.floor(model.score(np.array(batch.column(3).to_pylist(), float)) * STEPS).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(s), batch.column(4)], names=["kind", "label", "step", "n"])

        # thresholds are multiples of 1 / STEPS: one number for each, however many candidates there are
        counted = kept.mapInArrow(steps, "kind string, label boolean, step long, n long").groupBy("kind", "label", "step").agg(F.sum("n").alias("n"))
        rows = counted.orderBy("kind", "label", "step").collect()
        kinds, y, n = np.array([r["kind"] for r in rows]), np.array([r["label"] for r in rows], bool), np.array([r["n"] for r in rows])
        score = np.array([r["step"] for r in rows]) / STEPS
    discard(made)
    return model, {k: calibrated(score[kinds == k], y[kinds == k], precision, n[kinds == k]) for k in BASE}


_BY_NAME = sorted(BASE)


def all_spans(text: str, trained: tuple[Boosted, dict] | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and the selected candidates that overlap neither them nor a better one (of equal
    score the first by start, end and kind).

    Candidates are scored as they are proposed; of those that reach their threshold four numbers
    each are kept.
    """
    own = base_spans(text)
    if trained is None:
        return own, []
    model, thresholds = trained
    taken, best = _Taken(own), []
    for some in _batches(s for s in proposed(text, set(own)) if not taken.meets(s[1], s[2])):
        score = model.score(features(text, some))
        ok = np.flatnonzero(score >= np.array([thresholds[s[0]] for s in some]))
        best.append(np.array([(-score[i], some[i][1], some[i][2], _BY_NAME.index(some[i][0])) for i in ok], float).reshape(-1, 4))
    added, held = [], _Taken()
    if best:
        found = np.concatenate(best)
        for i in np.lexsort(found.T[::-1]):
            a, b, kind = map(int, found[i, 1:])
            if not held.meets(a, b):
                held.add(a, b)
                added.append((_BY_NAME[kind], a, b))
    return own, added


def scan(docs: DataFrame, text: str = "text", **training) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    trained = docs.sparkSession.sparkContext.broadcast(train(docs, text, **training))

    def find(batches):
        for batch in batches:
            each = (all_spans(t.as_py() or "", trained.value) for t in batch.column(1))
            yield digest_rows(batch.column(0), each, BASE, BASE)

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(find, digest_schema(BASE))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans merge into the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", **training) -> DataFrame:
    """The same rows and columns, with personal data in ``text`` replaced; null stays null."""
    trained = docs.sparkSession.sparkContext.broadcast(train(docs, text, **training))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([t if not t else redacted(t, sum(all_spans(t, trained.value), [])) for t in texts], dtype=object)

    return docs.withColumn(text, clean(text))
