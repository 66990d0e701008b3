"""The pipeline against a brute-force version of its filtering stages, and its contracts."""
import corpus_pipeline
from websift.llm import jaccard, pii, quality
from websift.llm.common import cut


def test_stages_keep_the_columns_and_take_effect(spark, docs):
    assert len(corpus_pipeline.STAGES) == 5
    seen = []
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = cut(stage(spark, d, ""))
        assert d.columns == docs.columns, name
        seen.append(d.count())
    kept = {r.doc_id for r in quality.measures(docs, carry=["doc_id"]).where("kept").collect()}
    assert seen[0] >= len(kept) and seen[1] < seen[0]
    first = cut(corpus_pipeline.STAGES[0][1](spark, docs, ""))
    groups = jaccard.join(first).collect()
    assert seen[1] == len({r.class_id for r in groups if r.class_id is not None}) + sum(r.class_id is None for r in groups)
    packed = corpus_pipeline.STAGES[-1][1](spark, d, "")
    assert packed.where("start = 0").count() == d.count()


def test_run_equals_its_stages(spark, tmp_path, docs):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
    want = corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path))
    short = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(str, out.select(*short).collect())) == sorted(map(str, want.select(*short).collect()))
    assert pii.KINDS
