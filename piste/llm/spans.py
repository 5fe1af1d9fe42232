"""Span bookkeeping shared by the two scanners: digests and counts of (kind, start, end)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa

Span = tuple[str, int, int]


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2])))


def digest_rows(ids: pa.Array, found: Iterator[tuple[list[Span], list[Span]]], base: tuple[str, ...],
                kinds: tuple[str, ...]) -> pa.RecordBatch:
    """A row per document: counts of base kinds, sha256 of the base spans, all spans."""
    counts, digests, texts = {k: [] for k in base}, [], []
    for own, added in found:
        for k in base:
            counts[k].append(sum(s[0] == k for s in own))
        digests.append(hashlib.sha256(joined(own, kinds).encode()).hexdigest())
        texts.append(joined(own + added, kinds))
    return pa.RecordBatch.from_arrays(
        [ids, *[pa.array(counts[k], pa.int64()) for k in base], pa.array(digests, pa.string()), pa.array(texts, pa.string())],
        names=["doc_id", *[f"n_{k}" for k in base], "base_sha256", "spans"])


def digest_schema(base: tuple[str, ...]) -> str:
    return "doc_id long, " + ", ".join(f"n_{k} long" for k in base) + ", base_sha256 string, spans string"
