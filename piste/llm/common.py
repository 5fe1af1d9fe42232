"""Shared helpers: table access, staged tables, vectorised word hashing.

Words are maximal runs of letters, marks, digits and connecting punctuation of any script, after
lower-casing; everything else separates them.  Scripts written without blanks between words
(Chinese, Japanese, Thai, Lao, Khmer, Burmese) have a word for every letter with its marks.  Where byte
offsets are asked for (``spanned_words``), any non-ASCII character belongs to a word.  Null text
counts as empty.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piste.operators.incremental import delete_path
from piste.session import checkpoint_root

PIECE = 1 << 20  # bytes hashed at a time, so that memory does not follow a text's length
EMPTY = np.zeros(0, np.uint64)
_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder (``spark.checkpoint.dir``) and read it back:
    cuts lineage, and what depends on it survives the loss of any executor."""
    path = f"{checkpoint_root(df.sparkSession)}/llm-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads again, such as those of a round once the next one is
    written."""
    for df in tables:
        delete_path(df.sparkSession, df._staged_path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores appended as keep it apart from every column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def least_by_hash(df: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The ``count`` rows of least hash of ``keys``, ties by ``keys``: a repeatable sample.

    Far larger tables are first cut by hash to about four times as many rows, so what meets in one
    task is bounded however many partitions there are.
    """
    rows, key = df.count(), F.shiftrightunsigned(F.xxhash64(*keys), 33)
    most = (4 * count << 31) // max(rows, 1)
    return df.where(key <= most).orderBy(key, *keys).limit(count)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser; spreads every input bit over the output."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _MUL, np.uint64), np.full(size, _INV, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _pieces(buf: np.ndarray, word: np.ndarray):
    """Slices of about PIECE bytes that end between words (later, if one word is longer)."""
    at = 0
    while at < len(buf):
        end = min(len(buf), at + PIECE)
        if end < len(buf):
            gaps = np.flatnonzero(~word[at:end])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                gaps = np.flatnonzero(~word[end:])
                end = end + int(gaps[0]) + 1 if len(gaps) else len(buf)
        yield at, end
        at = end


def words(buf: np.ndarray, word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and past-the-end byte of every word in a byte buffer."""
    word = _WORD[buf] if word is None else word
    hashes, firsts, lasts = [], [], []
    for at, end in _pieces(buf, word):
        part = buf[at:end]
        edge = np.flatnonzero(np.diff(word[at:end], prepend=False, append=False))
        starts, ends = edge[0::2], edge[1::2]
        up, down = _powers(PIECE if len(part) <= PIECE else 1 << len(part).bit_length())
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        hashes.append(mix((total[ends] - total[starts]) * down[starts]))
        firsts.append(starts + at)
        lasts.append(ends + at)
    if not hashes:
        return EMPTY, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (hashes[0], firsts[0], lasts[0]) if len(hashes) == 1 else tuple(map(np.concatenate, (hashes, firsts, lasts)))


_APART = regex.compile(r"[^\x00-\x7f\p{L}\p{M}\p{N}\p{Pc}]+")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*")


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words of a text, in order."""
    text = (text or "").lower()
    if not text.isascii():
        text = _UNSPACED.sub(r" \g<0> ", _APART.sub(" ", text))
    return words(np.frombuffer(text.encode(), np.uint8))[0]


def spanned_words(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`words`, lower-casing ASCII only so that byte offsets stay those of the text."""
    return words(_ASCII_LOWER[np.frombuffer((text or "").encode(), np.uint8)])


def code_points(text: str, offsets) -> np.ndarray:
    """Byte offsets in the UTF-8 text as code point offsets."""
    buf = np.frombuffer(text.encode(), np.uint8)
    return np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[np.asarray(offsets, np.int64)]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words; a shorter, non-empty text is one run."""
    if len(h) == 0:
        return EMPTY
    n = min(n, len(h))
    total = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        total = total * np.uint64(_MUL) + h[j : len(h) - n + 1 + j]
    return mix(total + np.uint64(n))


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct ``n``-word shingle hashes of a text."""
    return np.unique(grams(word_hashes(text), n))
