"""The pipeline, stage by stage, on planted documents."""

import corpus_pipeline
from pyspark.sql import functions as F

from aerolith.llm import shared


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    good = docs.join(spark.read.parquet(f"{data}/labels.parquet").where("quality = 1 and toxic = 0"), "doc_id", "left_semi").where("length(text) between 2000 and 6000").orderBy("doc_id").limit(4)
    a, b, c, d = (r.text for r in good.collect())
    passage = " ".join(f"pass{i}" for i in range(60))
    words = a.split(" ")
    words[len(words) // 2] = "changed"
    planted = [(90001, a), (90002, " ".join(words)), (90003, b + " " + passage), (90004, c + " " + passage), (90005, "# * $ " * 200), (90006, d.upper() + " x"), (90007, None)]
    extra = spark.createDataFrame(planted, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    x = docs.unionByName(extra.select(docs.columns))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        x = shared.written(stage(spark, x, data), name)
        assert x.columns == docs.columns
        kept.append({r.doc_id: r for r in x.collect()})
    quality, near, substring = kept
    assert not {90005, 90007} & quality.keys() and {90001, 90003, 90004} <= quality.keys()
    assert not {90001, 90002} & near.keys() and near.keys() <= quality.keys()
    assert substring.keys() == near.keys()
    for i in {90003, 90004} & substring.keys():
        assert "pass30" not in substring[i].text and substring[i].n_chars == len(substring[i].text)
    assert all(substring[i].text == near[i].text for i in near if len((near[i].text or "").split()) < 35)
    packed = corpus_pipeline.STAGES[-1][1](spark, x, data).collect()
    assert {r.doc_id for r in packed} == substring.keys()


def odd_rows(spark, texts):
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(1, long), (1, long), (1, "another text under the same id " * 3), (2, long), (None, long), (None, "only here " * 12), (None, "only here " * 12), (3, None), (4, ""), (5, texts[0])]
    return spark.createDataFrame([(*r, "en", 7, True) for r in rows], "doc_id long, text string, node string, row_no int, component_id boolean").repartition(3)


def test_near_dedup_keeps_one_row_of_each_group(spark, data):
    """Ids that are null, repeated or shared by other texts; columns that clash with the operator's own."""
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(1).collect()]
    docs = odd_rows(spark, texts)
    out = corpus_pipeline.near_dedup_stage(spark, docs, data)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, (r.text or "")[:12]) for r in out.collect()), key=repr)
    assert got == sorted([(1, "word0 word1 "), (1, "another text"), (None, "only here on"), (3, ""), (5, texts[0][:12])], key=repr)


def test_stages_on_empty_and_odd_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumns({"k_id": F.lit("x"), "spans": F.lit(1), "row": F.lit(2.0), "score": F.lit("s")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), data).count() == 0
        assert stage(spark, docs, data).columns == docs.columns
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), data).count() == 0
    odd = odd_rows(spark, ["a b c"])
    assert corpus_pipeline.substring_stage(spark, odd, data).count() == odd.count()
    assert corpus_pipeline.packing_stage(spark, odd, data).where("piece = 0").count() == odd.count()
    assert corpus_pipeline.quality_stage(spark, odd, data).where("text is null or text = ''").count() == 0
