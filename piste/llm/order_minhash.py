"""Document fingerprints by Order MinHash, in DataFrame functions only.

The k-mers of a text's words are numbered by occurrence, so that a repeated k-mer counts as often
as it stands, and hashed.  The hash space is cut into ``sketches`` equal ranges; of each range the
``width`` least occurrence-numbered k-mers are kept, put back in text order and hashed as a tuple.
Two texts agree in a range when they keep the same k-mers in the same order there, which edits
and moved passages both undo: the share of agreeing ranges follows edit distance, not only the
set of k-mers.

Words stand between blanks; in scripts written without them every letter is a word.  A text of fewer
than k words has one k-mer, of all its words; null, empty and blank texts have none,
and are alike only with each other (likeness 1).  Equal texts have equal fingerprints.  A range
without k-mers is written as dashes and counts only where the other text has some.  Null ids come
last in the order of documents, and ids may lie anywhere in their type.  Other columns are ignored;
an empty table gives an empty result; the only document of a table is its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piste.llm.common import staged

K, SKETCH_BITS, WIDTH = 3, 5, 2
_DIGITS = 8  # hex digits of a range in a fingerprint
_PLACE_BITS = 26  # of a sort key, for a k-mer's place; the rest is hash
_BLANK = "-" * _DIGITS
#: Letters of scripts written without blanks between words, each a word with its marks; before them
#: the ranges that all of them lie in, which are cheaper to look for.
MAY_BE_UNSPACED = r"[\u0E00-\u1FFF\u2E80-\uFAFF\x{20000}-\x{3FFFF}]"
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]\p{M}*+"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _kmers(words: Column, k: int) -> Column:
    n = F.size(words)
    whole = F.array(F.xxhash64(*[F.get(words, F.lit(j)) for j in range(k)]))
    each = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, whole).otherwise(each)


def _pack(h: Column, place: Column) -> Column:
    """Hash in the high bits, place in the low ones: sorts by hash, and gives the place back.

    Only two k-mers equal in 38 bits of hash, or places past 2^26, would sort by other than hash.
    """
    mask = (1 << _PLACE_BITS) - 1
    return h.bitwiseAND(F.lit(~mask)).bitwiseOR(place.cast("bigint").bitwiseAND(F.lit(mask)))


def _numbered(kmers: Column) -> Column:
    """Packed hash of (k-mer, occurrence) and place, in any order.

    Most texts repeat no k-mer.  For others, k-mers are sorted with their places; equal ones then
    stand together, and an occurrence number, the distance to the first of them, is found bit by
    bit.
    """
    steps = F.array(*[F.lit(1 << p) for p in range(_PLACE_BITS, -1, -1)])

    def repeated(s: Column) -> Column:
        def occurrence(x: Column, j: Column) -> Column:
            farther = F.aggregate(steps, F.lit(0), lambda d, p: F.when(
                (j - d - p >= 0) & (F.get(s, F.greatest(j - d - p, F.lit(0)))["h"] == x["h"]), d + p).otherwise(d))
            return F.when((j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0)))["h"] == x["h"]), farther).otherwise(F.lit(0))

        return F.transform(s, lambda x, j: _pack(F.xxhash64(x["h"], occurrence(x, j)), x["i"]))

    def number(a: Column) -> Column:
        placed = F.sort_array(F.transform(a, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(a)) == F.size(a), F.transform(a, lambda h, i: _pack(F.xxhash64(h, F.lit(0)), i))).otherwise(
            _let(placed, repeated))

    return _let(kmers, number)


def fingerprint(text: str | Column, k: int = K, sketch_bits: int = SKETCH_BITS, width: int = WIDTH) -> Column:
    """Fingerprint of a whole text: ``2 ** sketch_bits`` ranges of eight hex digits (or dashes)."""
    text = F.col(text) if isinstance(text, str) else text
    text = F.coalesce(text, F.lit(""))
    spaced = F.when(text.rlike(MAY_BE_UNSPACED), F.regexp_replace(text, f"({UNSPACED})", " $1 ")).otherwise(text)
    words = F.filter(F.split(spaced, r"\s+"), lambda w: w != "")
    least = 64 - sketch_bits
    place = (1 << _PLACE_BITS) - 1

    def kept(s: Column) -> Column:
        """First ``width`` of each range, in hash order."""
        return F.filter(s, lambda x, i: (i < width) | (
            F.shiftrightunsigned(F.get(s, F.greatest(i - width, F.lit(0))), least) != F.shiftrightunsigned(x, least)))

    def tuples(s: Column) -> Column:
        def one(r: Column) -> Column:
            own = F.filter(s, lambda x: F.shiftrightunsigned(x, least) == r)
            # by place: swap the halves of the key, sort, take the hash
            turned = F.sort_array(F.transform(own, lambda x: F.shiftleft(x.bitwiseAND(F.lit(place)), 64 - _PLACE_BITS - 1)
                                              .bitwiseOR(F.shiftrightunsigned(x, _PLACE_BITS + 1))))
            hashes = F.transform(turned, lambda x: x.bitwiseAND(F.lit((1 << (64 - _PLACE_BITS - 1)) - 1)))
            hexed = F.lpad(F.lower(F.hex(F.xxhash64(hashes).bitwiseAND(F.lit(0xFFFFFFFF)))), _DIGITS, "0")
            return F.when(F.size(own) == 0, F.lit(_BLANK)).otherwise(hexed)

        return F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit((1 << sketch_bits) - 1).cast("bigint")), one), "")

    return _let(_let(F.sort_array(_numbered(_let(words, lambda w: _kmers(w, k)))), kept), tuples)


def likeness(a: Column, b: Column, sketch_bits: int = SKETCH_BITS) -> Column:
    """Share of equal ranges among those where either fingerprint has k-mers; 1 if neither has any."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit((1 << sketch_bits) - 1)), lambda r: F.struct(
        F.substring(a, r * _DIGITS + 1, F.lit(_DIGITS)).alias("x"), F.substring(b, r * _DIGITS + 1, F.lit(_DIGITS)).alias("y")))
    used = F.filter(pairs, lambda p: (p["x"] != _BLANK) | (p["y"] != _BLANK))
    return _let(used, lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(
        F.size(F.filter(u, lambda p: p["x"] == p["y"])).cast("double") / F.size(u)))


def _by_key(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows joined to ``keys`` on (doc_id, hash), where a null id equals itself."""
    own = lambda c: F.col(f"{c}.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col(f"{c}.hash") == F.col("k.hash"))
    out = rows.alias("r").join(keys.alias("k"), own("r"), how)
    return out if how == "left_anti" else out.select("r.*", *[F.col(f"k.{c}") for c in keys.columns if c not in ("doc_id", "hash")])


def _literal(numbers: list[int]) -> Column:
    """A constant array of longs, as one literal of the plan."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def blocked(keys: DataFrame, per_block: int, most_blocks: int) -> tuple[Column, DataFrame]:
    """The block of a row by its (doc_id, hash), and the first key of every block.

    Blocks are ranges of distinct keys of about equal number, whatever part of their type the ids
    crowd in.  Their first keys, ``most_blocks`` at most, are read by the driver and searched bit by
    bit in every row.
    """
    many = max(1, min(most_blocks, -(-keys.count() // per_block)))
    order = [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0).cast("bigint")), F.col("hash")]
    names = ["none", "id", "hash"]
    dealt = keys.select(*[c.alias(n) for c, n in zip(order, names)]).repartitionByRange(many, *names)
    heads = sorted(tuple(r["head"]) for r in dealt.groupBy(F.spark_partition_id()).agg(F.min(F.struct(*names)).alias("head")).collect())
    none, ids, hashes = (_literal([int(h[i]) for h in heads] or [0]) for i in range(3))

    def at_most(i: Column) -> Column:
        """Whether the i-th first key is not past the row's key."""
        a, b, c = (F.get(x, i) for x in (none, ids, hashes))
        own = [order[0].cast("bigint"), *order[1:]]
        return (a < own[0]) | ((a == own[0]) & ((b < own[1]) | ((b == own[1]) & (c <= own[2]))))

    steps = F.array(*[F.lit(1 << p) for p in range(max(1, len(heads)).bit_length() - 1, -1, -1)])
    block = F.aggregate(steps, F.lit(0), lambda d, p: F.when((d + p < len(heads)) & at_most(d + p), d + p).otherwise(d))
    rows = [(None if h[0] else h[1], h[2], (i - 1) % len(heads)) for i, h in enumerate(heads)]
    return block, keys.sparkSession.createDataFrame(rows, "doc_id long, hash long, before int")


def with_next(docs: DataFrame, keys: DataFrame, columns: list[str], finish=lambda rows: rows, per_block: int = 2048,
              most_blocks: int = 1 << 16) -> DataFrame:
    """Each row with ``next_<column>`` of the row after it by (doc_id, hash), nulls last; the last
    row's next is the first.  ``keys`` has the rows' (doc_id, hash), each once.

    The first row of every block also goes to the block before, so one shuffle by block suffices; the
    list of first keys (``most_blocks`` rows of three numbers at most) is broadcast.  ``finish`` adds columns to rows once it is known where they go.
    """
    block, heads = blocked(keys, per_block, most_blocks)
    rows = finish(docs.withColumn("block", block))
    copies = finish(_by_key(docs, F.broadcast(heads), "inner").withColumnRenamed("before", "block"))
    both = rows.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)))
    order = Window.partitionBy("block").orderBy("copy", F.col("doc_id").asc_nulls_last(), "hash")
    return both.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("not copy").drop("block", "copy")


def edited(rows: DataFrame) -> DataFrame:
    """The result of rows (doc_id, text, fingerprint, next_text, next_fingerprint, n), with n."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    made = rows.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", "n",
                       F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    marked = made.select("*", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("edited").alias("edited_fingerprint"))
    return marked.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                         likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                         likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), "n")


def fingerprints(docs: DataFrame, copies_at_once: int = 1024) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first
    as many (or all) of the next document's.  One row per document, by doc_id; rows of one id
    follow one another by hash of text.  Rows equal in id and text are worked on once, and written as
    often as they stand, ``copies_at_once`` a task: but for one of them the next is an equal row.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    keys = staged(own.groupBy("doc_id", "hash").agg(F.count("*").alias("n")), "keys")
    printed = lambda rows: rows.withColumn("fingerprint", fingerprint("text"))
    again = keys.where("n > 1")
    if again.isEmpty():
        return edited(with_next(own.withColumn("n", F.lit(1).cast("bigint")), keys, ["text", "fingerprint"], printed)).drop("n")
    copied = _by_key(own, again, "inner").groupBy("doc_id", "hash").agg(F.first("text").alias("text"), F.first("n").alias("n"))
    once = _by_key(own, again, "left_anti").withColumn("n", F.lit(1).cast("bigint"))
    result = edited(with_next(once.unionByName(copied), keys, ["text", "fingerprint"], printed)).drop("n")
    repeats = printed(copied).withColumns({"next_text": F.col("text"), "next_fingerprint": F.col("fingerprint")})
    spread = edited(repeats).withColumn("from", F.explode(F.sequence(F.lit(2).cast("bigint"), "n", F.lit(copies_at_once).cast("bigint")))).repartition("doc_id", "from")
    upto = F.least(F.col("n"), F.col("from") + copies_at_once - 1)
    return result.unionByName(spread.withColumn("i", F.explode(F.sequence("from", upto))).drop("from", "i", "n"))
