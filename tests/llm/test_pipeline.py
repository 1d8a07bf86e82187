import corpus_pipeline
from pyspark.sql import functions as F

from lexspark.llm import mixing
from tests.llm.test_operators import DOCS, WORD, brute_near, toxic_rows


def test_pipeline_against_its_steps_by_brute_force(spark, tmp_path):
    rows, labels = toxic_rows(400)
    rows += rows[:30] + [r + " tail" for r in rows[30:50]] + [None, ""]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(rows)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept.append(docs)
    clean = {r.doc_id for r in kept[0].collect()}
    assert sum(1 for i, t in labels if t and i in clean) < 10 and sum(1 for i, t in labels if not t and i not in clean) < 10
    last = {}
    for r in kept[0].collect():
        last[r.text or ""] = max(last.get(r.text or "", -1), r.doc_id)
    unique = {r.doc_id for r in kept[1].collect()}
    assert unique == set(last.values())
    order = sorted(unique)
    near = {order[i] for i, _, _, stays in brute_near([rows[i] for i in order]) if stays}
    assert {r.doc_id for r in kept[2].collect()} == near
    plan = {r.doc_id: r.taken for r in mixing.mix(kept[2]).collect()}
    words = dict.fromkeys(plan, 0)
    for r in kept[3].collect():
        words[r.doc_id] += len(WORD.findall(r.text or ""))
    assert words == plan and kept[4].count() == kept[3].count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[4].count()
