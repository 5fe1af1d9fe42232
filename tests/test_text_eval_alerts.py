
from pyspark.sql import functions as F

from piste.operators import alerts as AL
from piste.operators import evaluation as EV
from piste.operators import text as TX

PAGE_NO_TITLE = ("1", "https://shop.example.com/p?x=1",
                 "<html><head><script>var a='<main>';</script></head><body><nav>menu</nav>"
                 "<main><p>Day pass $89.00 &amp; season EUR 899, or €45 / £40 / USD 12 / $1 $2 $3 $4</p></main>"
                 "<footer>$999</footer></body></html>")
PAGE_ARTICLE = ("2", "http://192.168.0.1/x", "<title> Hello  World </title><article>Body <b>text</b></article>")


def test_extract_pages(spark):
    df = spark.createDataFrame([PAGE_NO_TITLE, PAGE_ARTICLE], "page_id string, url string, html string")
    rows = {r.page_id: r for r in TX.extract_pages(df).collect()}
    p1, p2 = rows["1"], rows["2"]
    assert p1.title == "shop.example.com" and p1.url_valid is True
    assert p1.content.startswith("Day pass $89.00 & season EUR 899")
    assert "$999" not in p1.content and "menu" not in p1.content
    assert p1.prices == sorted(p1.prices) and len(p1.prices) == 9
    assert p2.title == "Hello World" and p2.content == "Body text" and p2.url_valid is False


def test_key_points_sections_tables(spark):
    text = "Intro line here.\n- first bullet point text\n- second bullet point text\n* third bullet point text"
    r = spark.createDataFrame([(text,)], "t string").select(TX.key_points(F.col("t")).alias("k")).first()
    assert r.k == ["first bullet point text", "second bullet point text", "third bullet point text"]
    few = "One short. This sentence is long enough to count. This one too is quite long enough!"
    r = spark.createDataFrame([(few,)], "t string").select(TX.key_points(F.col("t")).alias("k")).first()
    assert r.k == ["One short", "This sentence is long enough to count", "This one too is quite long enough"]
    md = "intro\n# Revenue\nline a\n## Costs\nline b\n| k | v |\n|---|---|\n| a | $1,200 |\n| b | 15% |\n"
    df = spark.createDataFrame([(1, md)], "id int, text string")
    secs = [(r.section_no, r.title) for r in TX.markdown_sections(df, ["id"]).orderBy("section_no").collect()]
    assert secs == [(1, "Overview"), (2, "Revenue"), (3, "Costs")]
    tabs = TX.markdown_tables(df, ["id"]).orderBy("row_no").collect()
    assert tabs[0].headers == ["k", "v"] and [t.cells for t in tabs] == [["a", "$1,200"], ["b", "15%"]]
    nums = spark.createDataFrame([("$1,200",), ("15%",), ("n/a",)], "c string").select(
        TX.parse_number(F.col("c")).alias("n")).collect()
    assert [n.n for n in nums] == [1200.0, 15.0, None]


def test_keyword_search_for_all_terms(spark):
    docs = spark.createDataFrame([(1, "snow snow powder day"), (2, "powder day"), (3, "rain day")],
                                 "doc_id long, text string")
    q = spark.createDataFrame([(10, "powder day"), (11, "Snow"), (12, "hail")], "query_id long, text string")
    got = [(r.query_id, r.doc_id, r.rank) for r in TX.keyword_search(docs, q, k=5, match="all").orderBy("query_id", "rank").collect()]
    assert [g[:2] for g in got] == [(10, 2), (10, 1), (11, 1)]


def brute_bm25(docs, queries, k, k1=1.2, b=0.75):
    import math
    import re
    from collections import Counter

    toks = {d: [t for t in re.split(r"[^a-z0-9]+", t.lower()) if t] for d, t in docs}
    toks = {d: t for d, t in toks.items() if t}
    mean = sum(map(len, toks.values())) / len(toks)
    tf = {d: Counter(t) for d, t in toks.items()}
    df = Counter(t for c in tf.values() for t in c)
    out = []
    for q, text in queries:
        scored = []
        terms = {t for t in re.split(r"[^a-z0-9]+", text.lower()) if t}
        for d, c in tf.items():
            hits = [t for t in terms if t in c]
            if hits:
                s = sum(math.log(1 + (len(tf) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * len(toks[d]) / mean)) for t in hits)
                scored.append((-round(s, 6), d))
        out += [(q, d, r + 1, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return out


def test_keyword_search_finds_partial_matches_and_prunes_none_of_the_best(spark):
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 60)))) for i in range(900)] + [(901, ""), (902, None), (903, "w0 w0 w0")]
    queries = [(100 + j, " ".join({*rng.choices(words, weights, k=8), f"w{290 + j}"})) for j in range(8)]
    queries += [(200, "w0"), (201, "unknown w7 words"), (202, "nothing"), (203, None), (204, "w0 w1 w2"), (204, "w250")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(queries, "query_id long, text string")
    merged = {}
    for i, t in queries:
        merged[i] = f"{merged.get(i, '')} {t or ''}"
    for k in (1, 10):
        got = sorted(tuple(r) for r in TX.keyword_search(d, q, k=k).collect())
        want = brute_bm25([(i, t or "") for i, t in docs], merged.items(), k)
        assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
        assert all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, sorted(want)))


def test_tables_of_many_rows_and_odd_lines(spark):
    import time

    big = "| n | square |\n|---|---|\n" + "\n".join(f"| {i} | {i * i} |" for i in range(100_000))
    mixed = ("text | with bar\n|a|b|\nno rule\n|x|\n|--|\n|1|\n\n|p|q|\r\n|:-:|--|\r\n|2|3|\r\n|---|\n|4|  |\nend\n|only|\n|-|\n"
             "|l1|\n|l2|\n|-|\n|l3|")
    df = spark.createDataFrame([(1, big), (2, mixed), (3, None), (4, ""), (5, "|" * 200_000), (6, "|a|\n" * 50_000)], "id int, text string")
    start = time.time()
    rows = TX.markdown_tables(df, ["id"]).collect()
    assert time.time() - start < 120
    one = [r for r in rows if r.id == 1]
    assert len(one) == 100_000 and all(r.cells == [str(r.row_no), str(r.row_no**2)] for r in one)
    assert [(r.table_no, r.row_no, r.headers, r.cells) for r in rows if r.id == 2] == [
        (0, 0, ["x"], ["1"]), (1, 0, ["p", "q"], ["2", "3"]), (1, 1, ["p", "q"], ["---"]), (1, 2, ["p", "q"], ["4"]),
        (2, 0, ["only"], ["l1"]), (2, 1, ["only"], ["l2"]), (2, 2, ["only"], ["-"]), (2, 3, ["only"], ["l3"])]
    assert not [r for r in rows if r.id > 2]


def test_sql_similarity(spark):
    a = "SELECT c.SEGMENT, COUNT(*) FROM MARTS.FACT_PASS_USAGE p JOIN DIM_CUSTOMER c ON x = y GROUP BY c.SEGMENT"
    df = spark.createDataFrame([(a, a), (None, None), (a, "SELECT 1")], "g string, e string")
    sims = [r.s for r in df.select(EV.sql_similarity(F.col("g"), F.col("e")).alias("s")).collect()]
    assert abs(sims[0] - 1.0) < 1e-9 and abs(sims[1] - 1.0) < 1e-9 and sims[2] < 0.5
    tok = df.select(EV.sql_tokens(F.col("g")).alias("t")).first().t
    assert sorted(tok.tables) == ["DIM_CUSTOMER", "FACT_PASS_USAGE"] and tok.aggregations == ["COUNT"]


def test_due_alerts(spark):
    today = "2024-03-10"
    rows = [("1", "Daily", True, "2024-03-09 07:00:00"), ("2", "daily", True, "2024-03-10 07:00:00"),
            ("3", "WEEKLY", True, "2024-03-03 07:00:00"), ("4", "weekly", True, "2024-03-05 07:00:00"),
            ("5", "monthly", True, None), ("6", "daily", False, None)]
    a = spark.createDataFrame(rows, "alert_id string, frequency string, is_active boolean, last_sent_at string")
    a = a.withColumn("last_sent_at", F.col("last_sent_at").cast("timestamp_ntz"))
    assert sorted(r.alert_id for r in AL.due_alerts(a, today).collect()) == ["1", "3", "5"]
