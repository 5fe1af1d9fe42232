"""N-gram Jaccard join by a MinHash LSH forest, exactly verified.

A text is the set of its five-word shingles (one shingle of all words if it has fewer).  Texts of
equal sets become one vertex before anything else, with their number, so copies cost nothing
further.  Each vertex has ``trees`` signatures of ``depth`` MinHash values, read as paths in prefix
tries; the vertices under a prefix are one node of a trie.

Every vertex starts from its whole paths and shortens them by what it finds.  One that meets a twin
there (at most ``twin_values`` signature values differ) leaves the search to that twin and stops.
All others shorten to the longest prefix at which pairs at the threshold meet in some tree with
probability ``recall``.  A vertex that searches for twins shortens further: by the triangle
inequality a pair at the threshold between two twins leaves their stand-ins no farther apart than
the threshold less twice the twins' distance, and the prefix is the longest one that finds such
pairs with probability ``recall``.

In every node each vertex is linked to the least vertex there; a link whose signatures disagree
widely is cut, and the members unlike the least one are compared with each other by signature, so
every pair that shares a prefix and may reach the threshold stays a candidate.  The components of
these links are the candidate groups.

Inside a group all pairs are verified on the exact sets, in blocks of at most about ``block``
vertices or ``block_shingles`` shingles, each block pair a task of its own; only counts of links and
one edge per vertex leave the task, never the pairs.  Verified edges give the classes.

Null, empty and wordless texts have no shingle and are linked to nothing.  Repeated rows are copies.
Other columns are ignored.  A class is named by its least doc_id, or, if all its ids are null, by a
negative hash.  A doc_id of several different texts names only the vertex of its least text hash;
a vertex left without a name has a negative hash.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piste.llm.common import discard, grams, mix, staged, unused, word_hashes
from piste.llm.graph import components

_STEP = 4096  # shingles hashed at a time


def adaptive_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """Longest prefix whose expected recall at the threshold reaches the target (1 at least)."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _factors(count: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def signature(sh: np.ndarray, factors: np.ndarray) -> np.ndarray:
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sh), _STEP):
        np.minimum(low, (factors[:, None] * sh[None, at : at + _STEP]).min(1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def prints(docs: DataFrame, n: int, trees: int, depth: int, prefixes: list[int]) -> DataFrame:
    """doc_id, text hash, and of its shingle set: 128-bit identity, size, signature, and ``keys``, the
    hashes of its paths' prefixes: all trees at the first length, then all at the next one."""
    factors = _factors(trees * depth)

    def make(batches):
        for batch in batches:
            one, two, size, sigs, keys = [], [], [], [], []
            for t in batch.column(2):
                sh = np.unique(grams(word_hashes(t.as_py()), n))
                one.append(int(mix(sh).sum(dtype=np.uint64).astype(np.int64)))
                two.append(int(mix(sh ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64).astype(np.int64)))
                size.append(len(sh))
                if not len(sh):
                    sigs.append(b"")
                    keys.append([])
                    continue
                sig = signature(sh, factors)
                sigs.append(sig.tobytes())
                path, found = np.zeros(trees, np.uint64), {}
                for j in range(depth):
                    path = mix(path + sig.reshape(trees, depth)[:, j].astype(np.uint64) + np.uint64(1))
                    found[j + 1] = path.astype(np.int64)
                keys.append(np.concatenate([found[p] for p in prefixes]))
            cols = (pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(size, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["doc_id", "th", "one", "two", "size", "sig", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(make, "doc_id long, th long, one long, two long, size long, sig binary, keys array<long>")


def near_agreement(threshold: float, values: int) -> float:
    """Share of equal signature values that a pair at the threshold all but surely (5.5 deviations)
    reaches."""
    return max(0.0, threshold - 5.5 * (threshold * (1 - threshold) / values) ** 0.5)


def _agreeing(group: dict, first: int, second: int, near: float) -> Iterator[tuple[int, int]]:
    """(id, root) of a block pair of one trie node: the components of its pairs that agree in ``near``."""
    left, right = ([i for i in group if group[i][1] == k] for k in (first, second))
    if not left or not right:
        return
    matrix = np.stack([np.frombuffer(group[i][0], np.uint32) for i in right])
    parent = {i: i for i in group}

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for a in left:
        same = (matrix == np.frombuffer(group[a][0], np.uint32)).mean(1) >= near
        for k in np.flatnonzero(same):
            x, y = sorted((top(a), top(right[k])))
            parent[y] = x
    for i in group:
        if top(i) != i:
            yield i, top(i)


def unlike_members(vertices: DataFrame, rest: DataFrame, near: float, block: int) -> DataFrame:
    """(a, b): links among the members ``rest`` (id, tree, key) of every trie node, all pairs compared
    by signature in blocks, each block pair a group of its own; the pairs never leave the task."""
    sizes = rest.groupBy("tree", "key").agg(F.ceil(F.count("*") / block).alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    own = rest.join(sizes, ["tree", "key"]).withColumn("block", F.expr("pmod(xxhash64(id), blocks)"))
    dealt = own.join(vertices.select("id", "sig"), "id").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    keys = ["tree", "key", "first", "second"]
    dealt = (dealt.select("tree", "key", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "id", "block", "sig")
             .repartition(int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "id"))

    def run(batches):
        now, group = None, {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                at = tuple(r[k] for k in keys)
                if at != now:
                    if now is not None:
                        out += _agreeing(group, now[2], now[3], near)
                    now, group = at, {}
                group[r["id"]] = (r["sig"], r["block"])
            yield rows(out)
        if now is not None:
            yield rows(list(_agreeing(group, now[2], now[3], near)))

    def rows(out: list) -> pa.RecordBatch:
        cols = list(zip(*out)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def leaves(vertices: DataFrame, level: int = 0, trees: int | None = None) -> DataFrame:
    """(id, tree, key): the nodes of each vertex at one of its prefix lengths (``trees``: of several)."""
    keys = F.col("keys") if trees is None else F.slice("keys", level * trees + 1, trees)
    return vertices.select("id", F.posexplode(keys).alias("tree", "key"))


def _likeness(vertices: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, head, agrees, nodes): every vertex with the least vertices of its nodes, and the nodes."""
    heads = nodes.groupBy("tree", "key").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    linked = (nodes.join(heads, ["tree", "key"]).where("id <> head")
              .groupBy("id", "head").agg(F.collect_list(F.struct("tree", "key")).alias("nodes")))

    @F.pandas_udf("double")
    def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float((np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).mean()) for x, y in zip(a, b)], dtype="float64")

    sigs = vertices.select("id", "sig")
    both = linked.join(sigs, "id").join(sigs.select(F.col("id").alias("head"), F.col("sig").alias("head_sig")), "head")
    return staged(both.select("id", "head", agreement("sig", "head_sig").alias("agrees"), "nodes"), "likeness")


def node_links(vertices: DataFrame, nodes: DataFrame, cut: float, near: float, block: int) -> DataFrame:
    """(a, b): the candidate links of the given nodes.

    A member is linked to the head of its node if their signatures agree in ``cut`` of all values.
    Members that agree with the head in less than ``1 + cut - near`` are compared with each other as
    well, and linked from ``near`` on.  So any two members of a node that agree in ``near`` are in one
    group: the share of unlike values is a metric, so if one of them is as near to the head as that,
    the other one is linked to the head too.
    """
    cut = min(cut, near)
    likeness = _likeness(vertices, nodes)
    rest = likeness.where(F.col("agrees") < 1 + cut - near).select("id", F.explode("nodes").alias("node")).select("id", "node.tree", "node.key")
    to_head = likeness.where(F.col("agrees") >= cut).select(F.col("id").alias("a"), F.col("head").alias("b"))
    return to_head.unionByName(unlike_members(vertices, rest, near, block))


def candidate_groups(vertices: DataFrame, cut: float, near: float, block: int = 256) -> DataFrame:
    """(id, root): the components of the links of all nodes, prefixes of one length."""
    return components(node_links(vertices, leaves(vertices), cut, near, block))


def forest_groups(vertices: DataFrame, trees: int, values: int, twin_values: int, cut: float, near: float, block: int) -> DataFrame:
    """(id, root): the components of all links that the vertices find while they shorten their paths.

    ``keys`` hold three lengths: whole paths, prefixes for pairs at the threshold, and those of
    vertices that stand for twins.
    """
    whole = _likeness(vertices, leaves(vertices, 0, trees))
    twins = whole.where(F.col("agrees") * values >= values - twin_values - 0.5)
    # a twin is left to a vertex that is left to nobody
    left = twins.join(twins.select(F.col("id").alias("head")).distinct(), "head", "left_anti").groupBy("id").agg(F.min("head").alias("head"))
    left = staged(left, "twins")
    searching = staged(vertices.join(left.select("id"), "id", "left_anti").select("id", "sig", "keys"), "searching")
    links = whole.where(F.col("agrees") >= min(cut, near)).select(F.col("id").alias("a"), F.col("head").alias("b"))
    links = links.unionByName(node_links(searching, leaves(searching, 1, trees), cut, near, block))
    short = leaves(searching, 2, trees)
    standing = short.join(left.select(F.col("head").alias("id")).distinct(), "id", "left_semi").select("tree", "key").distinct()
    return components(links.unionByName(node_links(searching, short.join(standing, ["tree", "key"], "left_semi"), cut, near, block)))


def _verify(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix: which of ``left`` and ``right`` reach the threshold, by exact counts.

    Shared shingles are counted by products of incidence matrices, some columns at a time.
    """
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    many = np.bincount(column)[column] > 1  # a shingle of one set is shared by none
    column, owner = np.cumsum(new & many)[many] - 1, owner[many]
    common = np.zeros((len(left), len(right)), np.float32)
    columns = int(column[-1]) + 1 if len(column) else 0
    wide = max(1, min(columns, 4_000_000 // len(sets)))
    for at in range(0, columns, wide):
        a, b = np.searchsorted(column, [at, at + wide])
        part = np.zeros((len(sets), wide), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        common += part[left] @ part[right].T
    either = size[left][:, None] + size[right][None, :] - common
    return common >= threshold * either - 1e-6


def _linked(group: dict, first: int, second: int, n: int, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(id, links, root) of a block pair: links counted in documents, edges reduced to one a vertex."""
    ids = list(group)
    sets = [np.unique(grams(word_hashes(group[i][0]), n)) for i in ids]
    docs, block = np.array([group[i][1] for i in ids], np.int64), np.array([group[i][2] for i in ids])
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    if not len(left) or not len(right):
        return
    near = _verify(sets, left, right, threshold)
    if first == second:
        np.fill_diagonal(near, False)
    links = np.zeros(len(ids), np.int64)
    links[left] += near @ docs[right]
    if first != second:
        links[right] += near.T @ docs[left]
    parent = list(range(len(ids)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for a, b in zip(*np.nonzero(near)):
        x, y = top(int(left[a])), top(int(right[b]))
        if x != y:
            x, y = (x, y) if ids[x] < ids[y] else (y, x)
            parent[y] = x
    for i, k in enumerate(ids):
        if links[i]:
            yield k, int(links[i]), ids[top(i)]


def verified(docs: DataFrame, vertices: DataFrame, groups: DataFrame, n: int, threshold: float, block: int, block_shingles: int) -> DataFrame:
    """(id, links, root) rows of all block pairs of all groups."""
    members = groups.join(vertices.select("id", "doc_id", "th", "size", "docs"), "id")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / block_shingles)).alias("blocks"))
    own = members.join(sizes, "root").withColumn("block", F.expr("pmod(xxhash64(id), blocks)"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    key = [F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.col("th")]
    named = lambda df: df.withColumns({f"k{i}": k for i, k in enumerate(key)}).drop("doc_id", "th")
    placed = named(own).join(named(texts), ["k0", "k1", "k2"]).drop("k0", "k1", "k2")
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    keys = ["root", "first", "second"]
    dealt = (pairs.select("root", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "id", "block", "docs", "text")
             .repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "id"))

    def run(batches):
        now, group = None, {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                at = (r["root"], r["first"], r["second"])
                if at != now:
                    if now is not None:
                        out += _linked(group, now[1], now[2], n, threshold)
                    now, group = at, {}
                group[r["id"]] = (r["text"], r["docs"], r["block"])  # repeated rows: once
            yield rows(out)
        if now is not None:
            yield rows(list(_linked(group, now[1], now[2], n, threshold)))

    def rows(out: list) -> pa.RecordBatch:
        cols = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "links", "root"])

    return dealt.mapInArrow(run, "id long, links long, root long")


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, trees: int = 16, depth: int = 8, recall: float = 0.99,
         cut: float = 0.4, twin_values: int = 1, twin_distance: float = 0.04, block: int = 256, block_shingles: int = 400_000) -> DataFrame:
    """One row per document: doc_id, class_id, links (documents at the threshold or nearer, copies
    included), copies (documents of its shingle set), th (hash of its text), stays (it names its
    class; true of wordless documents).

    ``twin_distance`` bounds the Jaccard distance of twins, of which all but ``twin_values`` of the
    signature values agree.
    """
    prefixes = [depth, *(adaptive_depth(t, trees, depth, recall) for t in (threshold, threshold - 2 * twin_distance))]
    made = staged(prints(docs, n, trees, depth, prefixes), "prints")
    worded = made.where("size > 0")
    # one vertex to each doc_id, in narrow rows that meet the vertices in the same grouping
    owners = worded.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("th", "one", "two")).alias("o")).select("o.one", "o.two", F.col("doc_id").alias("owned"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    merged = (worded.unionByName(owners, allowMissingColumns=True).groupBy("one", "two")
              .agg(least.alias("l"), F.min("owned").alias("owned"), F.count("size").alias("docs"), *[F.first(c, ignorenulls=True).alias(c) for c in ("size", "sig", "keys")]))
    name = F.coalesce("owned", -F.shiftrightunsigned("one", 2) - 1)
    vertices = staged(merged.select(name.alias("id"), "owned", "one", "two", "l.doc_id", "l.th", "docs", "size", "sig", "keys"), "vertices")
    groups = staged(forest_groups(vertices, trees, trees * depth, twin_values, cut, near_agreement(threshold, trees * depth), block), "groups")
    checked = staged(verified(docs, vertices, groups, n, threshold, block, block_shingles), "verified")
    discard(groups)
    linked = components(checked.select(F.col("id").alias("a"), F.col("root").alias("b")))
    names = linked.join(vertices.select("id", "owned"), "id").groupBy("root").agg(F.min("owned").alias("name"))
    classes = linked.join(names, "root").select("id", F.coalesce("name", "root").alias("root"))
    links = checked.groupBy("id").agg(F.sum("links").alias("links"))
    known = (vertices.select("one", "two", "id", F.col("doc_id").alias("least_id"), F.col("th").alias("least_th"), "docs").join(classes, "id", "left").join(links, "id", "left")
             .select("one", "two", "id", "least_id", "least_th", F.coalesce("root", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("links"), "docs"))
    out = made.select("doc_id", "th", "one", "two", "size").join(known, ["one", "two"], "left")
    some = F.col("size") > 0
    chosen = (F.col("id") == F.col("class_id")) & F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("th") == F.col("least_th"))
    return out.select("doc_id", F.when(some, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
                      F.when(some, F.col("links")).otherwise(F.lit(0)).cast("long").alias("links"),
                      F.when(some, F.col("docs")).otherwise(F.lit(1)).cast("long").alias("copies"),
                      "th", F.when(some, chosen).otherwise(F.lit(True)).alias("stays"))


def representatives(docs: DataFrame, **join_options) -> DataFrame:
    """One document of each class, the one of least doc_id, with all its columns; of repeated rows
    (equal doc_id and text) one stays.  Wordless documents stay."""
    own, its_id, its_hash = unused(docs, "own_hash", "stays_id", "stays_hash")
    stays = join(docs, **join_options).where("stays").select(F.col("doc_id").alias(its_id), F.col("th").alias(its_hash)).distinct()
    kept = docs.withColumn(own, F.xxhash64("text")).join(stays, F.col("doc_id").cast("long").eqNullSafe(F.col(its_id)) & (F.col(own) == F.col(its_hash)), "left_semi")
    return kept.dropDuplicates(["doc_id", own]).drop(own)
