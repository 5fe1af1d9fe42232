"""License scan: MinHash bands over overlapping windows, verified by exact shingle containment.

A text is covered by windows of several sizes, one for each size class of the templates, stepping
by a quarter window, so a template's text lies whole in one of them with little else around.
Each window's MinHash bands look up templates; rows per band and the number of bands are chosen so
that a window holding ``containment`` of a template collides with it with probability at least
``probability``.  A retrieved template is then verified by the exact share of its shingles in the
window's neighbourhood, and reported with the span of the matching words.  Machine-readable tags
differ by a word and must be held whole.

Null and empty texts match nothing, as do texts shorter than the shortest template's share.
Repeated rows each get their rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piste.llm.common import code_points, grams, mix, spanned_words
from piste.llm.licence_texts import TAGS, TEMPLATES

SHINGLE = 2
SCHEMA = "doc_id long, template string, start long, end long, containment double"
_PART = 1 << 11  # windows at a time


def factors(count: int) -> np.ndarray:
    """As many independent hash functions, by their odd multipliers."""
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def band_count(similarity: float, rows: int, probability: float) -> int:
    """Bands of ``rows`` so that sets of that similarity share one with at least ``probability``."""
    return math.ceil(math.log(1 - probability) / math.log(1 - similarity**rows))


def _bitmap(keys: set[int]) -> np.ndarray:
    """Which leading 16 bits occur among the keys; asked before the exact table."""
    out = np.zeros(1 << 16, bool)
    out[[k >> 48 for k in keys]] = True
    return out


class Templates:
    """Shingles and band tables of the templates, by size class of window."""

    def __init__(self, texts: dict[str, str], containment: float, probability: float, rows: int, whole=frozenset(TAGS)):
        self.rows, self.names = rows, list(texts)
        self.needs = [1.0 if name in whole else containment for name in self.names]
        hashes = [spanned_words(t)[0] for t in texts.values()]
        self.sizes = [len(h) for h in hashes]
        self.sets = [np.unique(grams(h, SHINGLE)) for h in hashes]
        self.all = np.unique(np.concatenate(self.sets))
        self.windows: dict[int, tuple[int, dict]] = {}
        for size in sorted({1 << max(2, (n - 1).bit_length()) for n in self.sizes}):
            members = [i for i, n in enumerate(self.sizes) if 1 << max(2, (n - 1).bit_length()) == size]
            width = size + size // 4  # a step of size / 4 then puts every run of ``size`` words in one window
            # least similarity of a window holding the asked share of a template
            worst = min(self.needs[i] * len(self.sets[i]) / (width + len(self.sets[i]) * (1 - self.needs[i])) for i in members)
            bands, table = band_count(worst, rows, probability), {}
            for i in members:
                for b, key in enumerate(self.bands(self.sets[i], bands, len(self.sets[i]))[0]):
                    table.setdefault((b, int(key)), []).append(i)
            self.windows[size] = (bands, table, _bitmap({k for _, k in table}))

    def bands(self, g: np.ndarray, bands: int, step: int) -> np.ndarray:
        """Band keys of every window of five steps; the last ones are cut short by the end.

        Least hashes are taken once per step and then over five steps.
        """
        count = -(-len(g) // step)
        laid = np.concatenate([g, np.repeat(g[-1:], count * step - len(g))]).reshape(count, step).T.copy()
        total, multiply = np.arange(1, bands + 1, dtype=np.uint64)[:, None], factors(bands * self.rows).reshape(bands, self.rows)
        for r in range(self.rows):
            low = (laid * multiply[:, r, None, None]).min(1)
            near = low.copy()
            for k in range(1, min(5, count)):
                np.minimum(near[:, :-k], low[:, k:], out=near[:, :-k])
            total = mix(total + near)
        return total.T

    def find(self, text: str | None) -> Iterator[tuple[str, int, int, float]]:
        """(template, start, end, containment), by place; of overlapping finds of a template the best."""
        if not text:
            return
        h, first, last = spanned_words(text)
        g = grams(h, SHINGLE)
        if not len(g):
            return
        found: dict[int, list[tuple[float, int, int]]] = {}
        for size, (bands, table, known) in self.windows.items():
            width, step = size + size // 4, size // 4
            for at in range(0, len(g), _PART * step):  # parts overlap by a window
                keys = self.bands(g[at : at + _PART * step + width], bands, step)
                for w, b in zip(*np.nonzero(known[(keys >> np.uint64(48)).astype(np.int64)])):
                    for i in table.get((int(b), int(keys[w, b])), ()):
                        self._verify(i, at + int(w) * step, width, g, found.setdefault(i, []))
        spans = []
        for i, hits in found.items():
            free: list[tuple[int, int]] = []
            for share, a, b in sorted(set(hits), key=lambda x: (-x[0], x[1], x[2])):
                if not any(a < y and x < b for x, y in free):
                    free.append((a, b))
                    spans.append((a, b, i, share))
        if spans:
            spans.sort()
            places = code_points(text, [p for a, b, _, _ in spans for p in (first[a], last[b - 1])])
            for k, (_, _, i, share) in enumerate(spans):
                yield self.names[i], int(places[2 * k]), int(places[2 * k + 1]), share

    def _verify(self, i: int, at: int, width: int, g: np.ndarray, hits: list) -> None:
        """Exact containment around a window; the span is that of the template's shingles there."""
        low = max(0, at - width)
        near = g[low : at + 2 * width]
        inside = np.flatnonzero(np.isin(near, self.sets[i]))
        # runs no longer than the template allows for what it lacks, each started by a shingle of it
        room = math.ceil(len(self.sets[i]) / self.needs[i])
        for k in inside:
            run = inside[(inside >= k) & (inside < k + room)]
            share = len(np.unique(near[run])) / len(self.sets[i])
            if share >= self.needs[i]:
                hits.append((share, low + int(k), low + int(run[-1]) + SHINGLE))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", containment: float = 0.8,
         probability: float = 0.999, rows: int = 1) -> DataFrame:
    """(doc_id, template, start, end, containment): every notice found; start and end in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(Templates(templates or TEMPLATES, containment, probability, rows))

    def find(batches):
        for batch in batches:
            rows_ = [(d.as_py(), *m) for d, t in zip(batch.column(0), batch.column(1)) for m in shared.value.find(t.as_py())]
            cols = list(zip(*rows_)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "template", "start", "end", "containment"])

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(find, SCHEMA)
