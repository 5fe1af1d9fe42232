"""Text and page mining X01-X08 as column expressions and DataFrame jobs.

HTML extraction and key-point mining run as built-in regex / higher-order array
functions (JVM, codegen), one row per page or message: whole texts, no prefixes, no
per-row Python.  Regex extraction approximates a DOM parser; the rules are stated here
and pinned by tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piste.functions.core import fround
from piste.session import staged

# Elements removed before text extraction; entity table; price patterns.
NOISE_TAGS = ("script", "style", "nav", "footer")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&amp;", "&"))
PRICE_PATTERNS = (r"\$[\d,]+\.?\d*", r"€[\d,]+\.?\d*", r"£[\d,]+\.?\d*", r"USD\s*[\d,]+\.?\d*",
                  r"EUR\s*[\d,]+\.?\d*")
WS = r"[\s ]+"


def _block(tag: str) -> str:
    return rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>"


def strip_noise(html: Column) -> Column:
    for tag in NOISE_TAGS:
        html = F.regexp_replace(html, _block(tag), " ")
    return html


def html_text(fragment: Column) -> Column:
    """Tags -> spaces, comments dropped, entities decoded, whitespace collapsed."""
    t = F.regexp_replace(fragment, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for ent, ch in ENTITIES:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return F.trim(F.regexp_replace(t, WS, " "))


def _inner(html: Column, tag: str) -> Column:
    m = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    has = html.rlike(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>")
    return F.when(has, m)


def valid_url(url: Column) -> Column:
    """http(s) scheme, a host, and not an internal host."""
    host = F.regexp_extract(url, r"^https?://([^/:?#]+)", 1)
    ok = url.rlike(r"^https?://") & (host != "")
    internal = host.isin("localhost", "127.0.0.1") | host.startswith("192.168.")
    return F.coalesce(ok & ~internal, F.lit(False))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1)


def price_mentions(text: Column) -> Column:
    """Every distinct match of the currency patterns, sorted."""
    parts = [F.regexp_extract_all(text, F.lit("(?i)" + p), 0) for p in PRICE_PATTERNS]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def extract_pages(pages: DataFrame, url: str = "url", html: str = "html",
                  content_limit: int | None = None) -> DataFrame:
    """Title (fallback: host), main -> article -> body -> whole-page text, collapsed
    whitespace, whole unless ``content_limit`` is given; prices mined from the full text."""
    h = strip_noise(F.col(html))
    title = html_text(F.regexp_extract(h, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1))
    main = F.coalesce(_inner(h, "main"), _inner(h, "article"), _inner(h, "body"), h)
    text = html_text(main)
    out = pages.withColumn("__text", text)
    return out.select(
        "*",
        F.when(title != "", title).otherwise(url_host(F.col(url))).alias("title"),
        (F.col("__text") if content_limit is None else F.substring("__text", 1, content_limit)).alias("content"),
        F.length("__text").alias("content_chars"),
        price_mentions(F.col("__text")).alias("prices"),
        valid_url(F.col(url)).alias("url_valid"),
    ).drop("__text", html)


def document_inventory(docs: DataFrame, *keys: str) -> DataFrame:
    """Documents per type (here: language and source)."""
    return docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("documents"),
                                   F.sum(F.length("text")).alias("total_chars"))


# -- X06 key points --------------------------------------------------------------------
# a list item: a dash, star or dot, or a number with a full stop, then white space
LIST_MARKER = r"^([-*•]|[0-9]+\.)\s+"


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def key_points(text: Column, limit: int | None = None) -> Column:
    """The text's list items, in order; a text with fewer than three gives its other
    distinct sentences after them.  ``limit`` cuts the list, by default nothing does."""
    lines = F.transform(F.split(text, "\n"), _strip)
    items = F.transform(F.filter(lines, lambda x: x.rlike(LIST_MARKER)), lambda x: F.regexp_replace(x, LIST_MARKER, ""))
    sentences = F.filter(F.transform(F.split(text, "[.!?]+"), _strip), lambda x: x != "")
    rest = F.array_distinct(F.filter(sentences, lambda x: ~F.array_contains(items, x)))
    points = F.when(F.size(items) < 3, F.concat(items, rest)).otherwise(items)
    return points if limit is None else F.slice(points, 1, limit)


# -- X07 / X08 markdown sections and tables ----------------------------------------------
# a header line: one to three number signs, blanks, a title
HEADER_MARK = r"^#{1,3}[ \t]+"


def header_title(line: Column) -> Column:
    """The title of a header line, null for any other line."""
    title = F.regexp_replace(line, HEADER_MARK, "")
    return F.when(line.rlike(HEADER_MARK) & (title != ""), title)


def markdown_sections(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Split each message at '#'..'###' headers into (section_no, title, content).

    Lines are exploded with their position; a running header count per message gives
    the section id.  Content before the first header is the 'Overview' section; empty
    sections are dropped; a message without non-empty sections yields one 'Response'
    section with the whole text.
    """
    lines = df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("__pos", "__line"))
    w = Window.partitionBy(*keys).orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("__hdr", header_title(F.col("__line"))).withColumn(
        "__sec", F.count("__hdr").over(w))
    sec = lines.groupBy(*keys, "__sec").agg(
        F.max("__hdr").alias("__title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__hdr").isNull(),
                                                                   F.struct("__pos", "__line")))),
                                 lambda s: s["__line"]), "\n").alias("__body"))
    sec = sec.select(*keys, "__sec", F.coalesce("__title", F.lit("Overview")).alias("title"),
                     F.concat(F.col("__body"), F.lit("\n")).alias("content"))
    sec = sec.filter(_strip(F.col("content")) != "")
    w2 = Window.partitionBy(*keys).orderBy("__sec")
    sec = sec.withColumn("section_no", F.row_number().over(w2)).drop("__sec")
    empty = df.join(sec.select(*keys).distinct(), keys, "left_anti").select(
        *keys, F.lit("Response").alias("title"), F.col(text).alias("content"), F.lit(1).alias("section_no"))
    return sec.unionByName(empty)


def _cells(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, r"\|"), _strip), lambda c: c != "")


def table_blocks(lines: Column) -> Column:
    """Array of (header, first, last): line numbers (from 0) of the tables in an array of lines.

    Lines that begin and end with a bar form runs; a run's table starts at its first line that a rule
    (bars, dashes, colons, blanks) and at least one more line follow.  Runs and rules are found by
    comparing neighbouring entries, so the work is linear in the lines and nothing recurses.
    """
    bar = F.transform(lines, lambda x: (F.length(x) > 2) & x.startswith("|") & x.endswith("|"))
    rule = F.transform(lines, lambda x: (F.length(x) > 2) & x.startswith("|") & x.endswith("|") & (F.translate(x, "|-: \t", "") == "") & x.contains("-"))
    kinds = F.transform(F.arrays_zip(bar.alias("bar"), rule.alias("rule")), lambda k, i: F.struct(i.alias("i"), k["bar"].alias("bar"), k["rule"].alias("rule")))

    def runs(k: Column) -> Column:
        edge = lambda i, at: ~F.coalesce(F.get(k, at)["bar"], F.lit(False))
        starts = F.transform(F.filter(k, lambda x: x["bar"] & ((x["i"] == 0) | edge(x["i"], F.greatest(x["i"] - 1, F.lit(0))))), lambda x: x["i"])
        ends = F.transform(F.filter(k, lambda x: x["bar"] & edge(x["i"], x["i"] + 1)), lambda x: x["i"])
        # a rule that is not the first line of its run heads a table if a line of the run follows
        rules = F.filter(k, lambda x: x["rule"] & ~edge(x["i"], x["i"] + 1) & (x["i"] > 0) & ~edge(x["i"], F.greatest(x["i"] - 1, F.lit(0))))
        spans = F.arrays_zip(starts.alias("s"), ends.alias("e"))
        # both lists ascend: a rule's run is the last one that starts before it, found bit by bit
        steps = F.array(*[F.lit(1 << p) for p in range(30, -1, -1)])
        place = lambda i: F.aggregate(steps, F.lit(0), lambda d, p: F.when(
            (d + p < F.size(spans)) & (F.get(spans, d + p)["s"] <= i), d + p).otherwise(d))
        heads = F.transform(rules, lambda x: F.struct(place(x["i"]).alias("run"), x["i"].alias("rule")))
        first = F.filter(heads, lambda h, j: (j == 0) | (F.get(heads, F.greatest(j - 1, F.lit(0)))["run"] != h["run"]))
        return F.transform(first, lambda h: F.struct((h["rule"] - 1).alias("header"), (h["rule"] + 1).alias("first"), F.get(spans, h["run"])["e"].alias("last")))

    return F.element_at(F.transform(F.array(kinds), runs), 1)


def markdown_tables(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Markdown tables -> one row per body row: (table_no, row_no, headers, cells)."""
    lines = F.transform(F.split(F.col(text), "\n"), lambda x: F.rtrim(F.regexp_replace(x, "[\r\t]+$", "")))

    def cut(held: Column) -> Column:
        """Each table with its own lines, so that no row carries the whole text on."""
        return F.transform(table_blocks(held), lambda t: F.struct(
            F.get(held, t["header"]).alias("header"), F.slice(held, t["first"] + 1, t["last"] - t["first"] + 1).alias("body")))

    tables = df.where(F.col(text).contains("|")).select(*keys, F.posexplode(F.element_at(F.transform(F.array(lines), cut), 1)).alias("table_no", "__t"))
    rows = tables.select(*keys, "table_no", _cells(F.col("__t.header")).alias("headers"), F.col("__t.body").alias("__body"))
    rows = rows.select(*keys, "table_no", "headers", F.posexplode("__body").alias("row_no", "__r"))
    rows = rows.withColumn("cells", _cells(F.col("__r"))).drop("__r")
    return rows.filter((F.size("cells") > 0) & (F.size("headers") > 0))


def parse_number(cell: Column) -> Column:
    """Numeric value of a table cell after removing ',', '$' and '%' (NULL if none)."""
    return F.regexp_replace(cell, r"[,$%]", "").try_cast("double")


# -- X04 keyword search ------------------------------------------------------------------
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
_NEAR = 1e-5  # scores are ranked after rounding to 1e-6: bounds are kept this far from them
SEED_FACTOR = 20  # a query's first bound comes from the postings of its rarest terms, about this many per result


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: t != "")


def postings(docs: DataFrame, vocabulary: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Inverted index of the terms in ``vocabulary``: (doc, term, tf).

    Other terms are dropped before the shuffle, which is on (doc, term) and partial-aggregated map side.
    """
    t = docs.select(F.col(doc_id).alias("doc"), F.explode(tokens(F.col(text))).alias("term"))
    return t.join(vocabulary, "term", "left_semi").groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best documents of a query; every task keeps its own ``k`` before the shuffle."""
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def keyword_search(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75,
                   doc_id: str = "doc_id", query_id: str = "query_id", text: str = "text",
                   match: str = "any") -> DataFrame:
    """Keyword search ranked by BM25, top-k per query.

    ``match="any"`` scores documents that hold any query term, ``"all"`` those that hold every one.
    Any-term search prunes by score bounds (MaxScore).  The postings of a query's rarest terms give
    candidates whose k-th score is a lower bound for the result.  A term's score is at most its idf
    times its largest weight in any document; the terms whose bounds together stay below the
    query's k-th score cannot bring a document in by themselves, so frequent words create no
    candidates: documents come from the postings of the other terms, and those that their partial
    score and the remaining bounds cannot lift to the k-th score are dropped before the
    frequent terms are looked up.  No query x document product is formed, and no query is cut short:
    every document outside the candidates is proven to rank below k.
    """
    lens = staged(docs.select(F.col(doc_id).alias("doc"), F.size(tokens(F.col(text))).alias("n")).filter("n > 0")
                  .groupBy("doc").agg(F.sum("n").alias("dl")), "lengths")
    stats = lens.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")).first()
    n, avgdl = F.lit(stats["n_docs"]), F.lit(stats["avgdl"])
    q = staged(queries.select(F.col(query_id).alias("q"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).distinct(), "terms")
    found = postings(docs, q.select("term").distinct(), doc_id, text).join(lens, "doc")
    tf = F.col("tf").cast("double")
    post = staged(found.select("doc", "term", (tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / avgdl))).alias("w")), "postings")
    known = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("w").alias("top"))
    idf = F.log(F.lit(1.0) + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = known.select("term", "df", idf.alias("idf"), (idf * F.col("top")).alias("bound"))
    rising = Window.partitionBy("q").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    every = F.count(F.lit(1)).over(Window.partitionBy("q"))
    terms = q.join(known, "term", "left").withColumn("n_terms", every).withColumn("rarer", F.coalesce(F.sum("df").over(rising), F.lit(0)))
    terms = staged(terms.filter("df is not null"), "weights")

    def partial(asked: DataFrame) -> DataFrame:
        """Documents of the terms' postings, with the sum of these terms' scores."""
        hits = asked.select("q", "term", "idf").join(post, "term")
        return hits.groupBy("q", "doc").agg(F.sum(F.col("idf") * F.col("w")).alias("part"), F.count(F.lit(1)).alias("matched"))

    def completed(candidates: DataFrame, rest: DataFrame) -> DataFrame:
        """Candidates with the scores of further terms of their query added."""
        more = candidates.select("q", "doc").join(rest.select("q", "term", "idf"), "q").join(post, ["doc", "term"])
        added = more.groupBy("q", "doc").agg(F.sum(F.col("idf") * F.col("w")).alias("more"), F.count(F.lit(1)).alias("further"))
        return candidates.join(added, ["q", "doc"], "left").select(
            "q", "doc", fround(F.col("part") + F.coalesce("more", F.lit(0.0)), 6).alias("score"), (F.col("matched") + F.coalesce("further", F.lit(0))).alias("matched"))

    if match == "all":
        rarest = F.row_number().over(Window.partitionBy("q").orderBy("df", "term")) == 1
        marked = terms.withColumn("lead", rarest)
        all_known = terms.groupBy("q").agg(F.first("n_terms").alias("n_terms"), F.count(F.lit(1)).alias("known")).filter("known = n_terms")
        scored = completed(partial(marked.filter("lead")), marked.filter("not lead")).join(all_known, "q").filter("matched = n_terms")
    else:
        seeds = partial(terms.filter(F.col("rarer") < SEED_FACTOR * k)).withColumn("score", F.col("part"))
        first = completed(_best(seeds, 2 * k), terms.filter(F.col("rarer") >= SEED_FACTOR * k))
        reach = _best(first, k).groupBy("q").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
        weak = Window.partitionBy("q").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
        split = terms.join(reach.select("q", "kth"), "q", "left").withColumn("upto", F.sum("bound").over(weak))
        split = staged(split.withColumn("lead", F.coalesce(F.col("upto") >= F.col("kth") - _NEAR, F.lit(True))), "split")
        slack = split.groupBy("q").agg(F.first("kth").alias("kth"), F.coalesce(F.sum(F.when(~F.col("lead"), F.col("bound"))), F.lit(0.0)).alias("rest"))
        hopeful = partial(split.filter("lead")).join(slack, "q").filter(F.coalesce(F.col("part") + F.col("rest") >= F.col("kth") - _NEAR, F.lit(True)))
        scored = completed(hopeful.select("q", "doc", "part", "matched"), split.filter("not lead"))
    return _best(scored, k).select(F.col("q").alias(query_id), F.col("doc").alias(doc_id), "rank", "score")


# -- X04 vector variant ------------------------------------------------------------------------
PROTOTYPE_BLOCK = 256            # prototypes that one row of the block table holds
BROADCAST_BYTES = 64 * 1024 * 1024


def label_prototypes(emb: DataFrame, vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Mean vector per label, computed element-wise (explode by position, one grouped
    average, re-assembled in position order) -- no vector is collected to the driver."""
    e = emb.select(label_col, F.posexplode(vec_col).alias("__pos", "__x"))
    g = e.groupBy(label_col, "__pos").agg(F.avg(F.col("__x").cast("double")).alias("__m"))
    return g.groupBy(label_col).agg(F.array_sort(F.collect_list(F.struct("__pos", "__m"))).alias("__s")).select(
        label_col, F.transform("__s", lambda s: s["__m"]).alias("prototype"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def vector_prototype_search(emb: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
                            label_col: str = "label") -> DataFrame:
    """X04 (vector variant): the ``k`` vectors most cosine-similar to each label's prototype.

    The query set is the label prototypes, in a table of blocks of about PROTOTYPE_BLOCK; every vector
    meets every block once and is scored against its prototypes in place.  The block table is
    broadcast if it takes at most BROADCAST_BYTES, and joined by block number otherwise.  Each task
    keeps ``k`` vectors a label before the shuffle.
    """
    protos = staged(label_prototypes(emb, vec_col, label_col), "prototypes")
    size = protos.agg(F.count(F.lit(1)).alias("labels"), F.coalesce(F.max(F.size("prototype")), F.lit(0)).alias("dims")).first()
    many = max(1, -(-size["labels"] // PROTOTYPE_BLOCK))
    one = F.struct(F.col(label_col).alias("l"), F.col("prototype").alias("p"), F.sqrt(_dot(F.col("prototype"), F.col("prototype"))).alias("n"))
    table = protos.groupBy(F.pmod(F.xxhash64(label_col), F.lit(many)).alias("__block")).agg(F.collect_list(one).alias("__held"))
    if size["labels"] * (size["dims"] * 8 + 64) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    met = emb.select(F.col(id_col).alias("__id"), v.alias("__v")).withColumn("__n", F.sqrt(_dot(F.col("__v"), F.col("__v"))))
    met = met.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(many - 1).cast("bigint")))).join(table, "__block")
    scored = met.select("__id", F.explode(F.transform("__held", lambda c: F.struct(
        c["l"].alias("q"), fround(_dot(F.col("__v"), c["p"]) / (F.col("__n") * c["n"]), 6).alias("score")))).alias("__h"))
    scored = scored.select(F.col("__id").alias("doc"), F.col("__h.q").alias("q"), F.col("__h.score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.col("score").desc_nulls_last(), F.col("doc"))
    top = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.select(F.col("q").alias(label_col), F.col("doc").alias(id_col), "rank", "score")
