from pyspark.sql import functions as F

import corpus_pipeline
from sparkseek.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    words = [f"{a}{b}{c}" for a in ("the", "ing", "and") for b in ("er", "or", "st") for c in ("ed", "ly", "en")]
    text = lambda i: " ".join(words[(i * i + 7 * i * k + k * k) % 27] + words[(i * 31 + k * 17) % 27] for k in range(40 + i % 30))
    item = " ".join(f"{w}bench" for w in words[:25])
    rows = [(i, text(i), "en", f"s{i % 3}", 0) for i in range(120)]
    rows += [(500, text(5), "en", "s1", 0), (501, text(6), "en", "s2", 0), (502, item, "en", "s1", 0), (503, "123 456", None, "s1", 0), (504, None, "en", "s1", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert not {503, 504} & seen[0] and set(range(120)) <= seen[0]
    assert not {500, 501} & seen[1] and {5, 6, 502} <= seen[1]
    assert 502 not in seen[2] and seen[2] == seen[1] - {502}
    assert seen[3] <= seen[2] and len(seen[3]) > len(seen[2]) / 2
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in last.collect()} == seen[3] and set(docs.columns) < set(last.columns)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_on_nulls_clashes_and_nothing(spark, tmp_path):
    own = {"n_words": 3, "hit_spans": "a", "_source": "b", "_topic": "c", "_shard": "d", "score": "e", "sampled": "f", "_text": "g", "_row": "h", "fp": "i", "kept": "j"}
    rows = [(i, f"alpha{i} beta{i} gamma{i} delta{i} words go on", "en", "s", 0) for i in range(30)] + [(None, "no id at all here but words", "en", None, None), (None, None, None, None, None), (3, "a repeated id with other words", None, "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c, v in own.items():
        docs = docs.withColumn(c, F.lit(v))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        out = stage(spark, docs, str(tmp_path))
        assert out.schema == docs.schema and all(r[c] == v for r in out.collect() for c, v in own.items())
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert set(own) < set(last.columns) and last.count() > 20 and last.filter("fp <> 'i' or _shard <> 'd'").count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
