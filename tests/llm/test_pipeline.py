import corpus_pipeline
from piste.llm import common, mixing, pii, tiling
from piste.llm.common import staged, table

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns, seen, last = docs.columns, [docs.count()], None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        seen.append(docs.count())
    bad = {r["doc_id"] for r in table(spark, SF, "labels").where("quality = 0").collect()}
    good = {r["doc_id"] for r in table(spark, SF, "labels").where("quality = 1").collect()}
    rows = docs.collect()
    ids = {r["doc_id"] for r in rows}
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.5 * seen[0]
    assert not bad & ids and len(good & ids) > 0.7 * len(good)
    sets = [(r["doc_id"], set(common.shingles(r["text"]).tolist())) for r in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 0.85 * max(len(a), len(b)) <= min(len(a), len(b)):
                assert len(a & b) < 0.85 * len(a | b), (i, j)
    assert tiling.contaminated(docs, table(spark, SF, "benchmark")).count() == 0
    assert not any(pii.base_spans(r["text"]) for r in rows)
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in mix} <= ids and len(mix) > len(rows) / 2


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
