"""Secret scan: fixed formats, and the guess cost of values that stand where credentials stand.

The guess cost of a value is the least sum, over all ways to cut it into words, dates, repeats,
keyboard walks and brute-force spans, of the log10 of the guesses that each part needs; a
dynamic program over cut points finds it in time linear in the value's length.  Word ranks are
those of all words of the whole corpus.  A value in credential context whose cost reaches ``min_cost`` is
a span of kind ``guess``, unless a base span covers it.

Null text counts as empty; an empty text has no span; repeated rows each get their row; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piste.llm.common import staged
from piste.llm.spans import Span, digest_rows, digest_schema, joined

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "guess")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Names that credentials go by, in any longer name (``DB_PASSWORD``); the short ones only where a
#: word of the name ends with them (``userpass``, not ``passenger``).
NAME = re.compile(
    r"""pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|credential|authorization|private[_-]?key|access[_-]?key|(?:pass|auth|pin)(?![^\W\d_])|(?:pass|auth|pin)(?-i:(?<=[a-z])(?=[A-Z]))""", re.I)
#: The rest of the name, a separator or copula, and a value without white space.
REST = re.compile(r"(?:[A-Za-z0-9_]|-(?!>))*+")
VALUE = re.compile(r"""["']?[\x20\t]*+(?:[:=]>?|\bis\b|->)[\x20\t]*+["']?([^\s"'<>,;]{4,})""", re.I)

#: Rows of common keyboards.
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm", "azertyuiop", "qsdfghjklm")
NEXT_KEY = {(a, b) for row in KEY_ROWS for line in (row, row[::-1]) for a, b in zip(line, line[1:])}
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?[01]\d[-/.]?[0-3]\d)?|[0-3]?\d[-/.][01]?\d[-/.](?:19|20)?\d\d")


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def _brute(char: str) -> float:
    """log10 of the alphabet a brute-force guess of this character draws from."""
    return 1.0 if char.isdigit() else math.log10(26) if char.isalpha() else math.log10(33)


def guess_cost(value: str, ranks: dict[str, int]) -> float:
    """log10 of the guesses of the cheapest segmentation of ``value``."""
    low, n = value.lower(), len(value)
    # length of the repeat and of the keyboard walk that end at each place
    repeat, walk = [1] * n, [1] * n
    for i in range(1, n):
        if value[i] == value[i - 1]:
            repeat[i] = repeat[i - 1] + 1
        if (low[i - 1], low[i]) in NEXT_KEY:
            walk[i] = walk[i - 1] + 1
    sizes = sorted({len(w) for w in ranks})
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if value[i].isdigit() and (m := DATE.match(value, i)):
            dates.setdefault(m.end(), []).append(i)
    switch = math.log10(2)  # a guesser also tries the kind of every part
    best = [0.0] * (n + 1)
    for end in range(1, n + 1):
        cost = best[end - 1] + _brute(value[end - 1])
        if (run := repeat[end - 1]) >= 3:
            cost = min(cost, best[end - run] + _brute(value[end - 1]) + math.log10(run) + switch)
        if (run := walk[end - 1]) >= 3:
            cost = min(cost, best[end - run] + math.log10(4 * len(KEY_ROWS) * run) + switch)
        for start in dates.get(end, ()):
            cost = min(cost, best[start] + math.log10(365 * 100) + switch)
        for start in (end - k for k in sizes if k <= end):
            if (rank := ranks.get(low[start:end])) is not None:
                upper = sum(c.isupper() for c in value[start:end])
                case = 0 if upper == 0 else switch if upper in (1, end - start) else math.log10(math.comb(end - start, upper))
                cost = min(cost, best[start] + math.log10(rank) + case + switch)
        best[end] = cost
    return best[n]


def in_context(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of every value in credential context; a name is read once, however many of its
    parts are credential names."""
    at = 0
    while m := NAME.search(text, at):
        at = REST.match(text, m.end()).end()
        if value := VALUE.match(text, at):
            yield value.span(1)
            at = value.end()


def uncovered(text: str, own: list[Span]) -> Iterator[tuple[int, int]]:
    """Values in credential context, without closing marks, that no base span covers."""
    for a, b in in_context(text):
        while b > a and text[b - 1] in ".:!?)]}":
            b -= 1
        if b - a >= 4 and not any(s <= a and b <= e for _, s, e in own):
            yield a, b


def added_spans(text: str, own: list[Span], ranks: dict[str, int], min_cost: float) -> list[Span]:
    """Values in credential context that no base span covers and that are hard to guess."""
    return [("guess", a, b) for a, b in uncovered(text, own) if guess_cost(text[a:b], ranks) >= min_cost]


LETTERS = re.compile(r"[^\W\d_]{3,}")
GUESS = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("value", pa.string())])


def word_ranks(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, rank): rank by frequency of every word seen more than once in the documents, ties by word.

    Every word of every document is counted: per batch in the task, then by a shuffled sum.  The
    words are sorted by range, and a word's rank is its place in its range after the ranges before;
    only the lengths of the ranges reach the driver.  A word seen once is in no guesser's dictionary.
    """

    def count(batches):
        for batch in batches:
            n: Counter = Counter()
            for t in batch.column(0):
                if t := t.as_py():
                    n.update(LETTERS.findall(t.lower()))
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["word", "n"])

    counted = staged(docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "words")
    placed = staged(counted.orderBy(F.desc("n"), "word").select("word", F.monotonically_increasing_id().alias("at")), "ranks")
    placed = placed.select("word", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    before, offsets = 0, []
    for r in placed.groupBy("range").agg(F.count("*").alias("n")).orderBy("range").collect():
        offsets.append((r["range"], before))
        before += r["n"]
    firsts = docs.sparkSession.createDataFrame(offsets, "range long, before long")
    return placed.join(firsts, "range").select("word", (F.col("before") + F.col("place") + 1).alias("rank"))


def hard_values(values: DataFrame, ranks: DataFrame, min_cost: float) -> DataFrame:
    """The distinct ``value`` that cost ``min_cost`` or more, by the ranks of all words inside them.

    Of a value's letters the stretches are looked up that are as long as some ranked word; the distinct
    lengths are few, as a corpus of n letters has at most the square root of 2n of them.
    """
    sizes = sorted(r[0] for r in ranks.select(F.length("word")).distinct().collect())
    each = staged(values.distinct().select("value", F.monotonically_increasing_id().alias("vid")), "values")

    def parts(batches):
        for batch in batches:
            vid, word = [], []
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low = value.lower()
                inside = {low[a:b] for m in LETTERS.finditer(low) for k in sizes if k <= m.end() - m.start()
                          for a in range(m.start(), m.end() - k + 1) for b in (a + k,)}
                vid += [i] * len(inside)
                word += inside
            yield pa.RecordBatch.from_arrays([pa.array(vid, pa.int64()), pa.array(word, pa.string())], names=["vid", "word"])

    known = (each.select("vid", "value").mapInArrow(parts, "vid long, word string").join(ranks, "word")
             .groupBy("vid").agg(F.collect_list(F.struct("word", "rank")).alias("words")))

    def hard(batches):
        for batch in batches:
            out = [r["value"] for r in batch.to_pylist()
                   if guess_cost(r["value"], {w["word"]: w["rank"] for w in r["words"] or ()}) >= min_cost]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return each.join(known, "vid", "left").select("value", "words").mapInArrow(hard, "value string")


def scan(docs: DataFrame, text: str = "text", min_cost: float = 10.0) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Values that are cheap without any word are dropped at once, as words only make them cheaper.
    """

    def find(batches):
        for batch in batches:
            own, guesses = [], []
            for t in batch.column(1):
                t = t.as_py() or ""
                own.append(base_spans(t))
                guesses.append([{"a": a, "b": b, "value": t[a:b]} for a, b in uncovered(t, own[-1]) if guess_cost(t[a:b], {}) >= min_cost])
            rows = digest_rows(batch.column(0), ((s, []) for s in own), BASE, KINDS)
            yield rows.append_column("guesses", pa.array(guesses, pa.list_(GUESS)))

    made = docs.select(F.col("doc_id").cast("long"), text).mapInArrow(find, digest_schema(BASE) + ", guesses array<struct<a: int, b: int, value: string>>")
    rows = staged(made.withColumn("row", F.monotonically_increasing_id()), "guesses")
    each = rows.where(F.size("guesses") > 0).select("row", F.explode("guesses").alias("g")).select("row", "g.*")
    hard = hard_values(each.select("value"), word_ranks(docs, text), min_cost)
    found = each.join(hard, "value").groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("found"))

    @F.pandas_udf("string")
    def merged(spans: pd.Series, found: pd.Series) -> pd.Series:
        def one(text, more):
            parts = [x.split(":") for x in text.split(",") if x]
            return joined([(k, int(a), int(b)) for k, a, b in parts] + [("guess", r["a"], r["b"]) for r in more], KINDS)

        return pd.Series([s if f is None else one(s, f) for s, f in zip(spans, found)], dtype=object)

    return (rows.drop("guesses").join(found, "row", "left").withColumn("spans", F.when(F.col("found").isNull(), F.col("spans")).otherwise(merged("spans", "found")))
            .drop("row", "found"))
