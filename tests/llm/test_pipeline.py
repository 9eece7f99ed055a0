import hashlib

import corpus_pipeline as pipeline
from millrace.llm import byte_bpe, toxicity
from test_corpus_operators import CLASHING, brute_components, brute_dedup, brute_hits, frame, near_copies

SF = "/root/testdata/sf0.001"


def test_pipeline_is_brute_force(spark):
    """Every stage's rows against a plain Python version of it (the learned scores are the operator's own)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = {r.doc_id: r.text for r in docs.collect()}
    score = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), pipeline.crc_mod(pipeline.F.col("doc_id"), 3) != 1)
    finder = score.automaton()
    now = {d: t for d, t in now.items() if score.score(*score.raw(finder, t)) < toxicity.THRESHOLD}
    now = brute_dedup(list(now.items()))
    ids = sorted(now)
    now = {ids[i]: now[ids[i]] for i, n, c in brute_components([now[d] for d in ids]) if c == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now = {d: t for d, t in now.items() if not brute_hits(t, items)[1]}
    bpe = byte_bpe.tokenizer()
    want = {(d, len(x := bpe.encode(t)), hashlib.sha256(" ".join(map(str, x.tolist())).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in now.items()}
    assert {tuple(r) for r in pipeline.run(spark, SF).collect()} == want


def test_stages_keep_columns_and_take_odd_tables(spark):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE encoding and decoding"]
    odd = frame(spark, near_copies()[:16], extra=CLASHING)
    odd = odd.union(odd.limit(3)).union(spark.createDataFrame([(None,) * len(odd.columns)] * 2, odd.schema))
    for table in (odd, odd.limit(0)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, table, SF)
            if name != pipeline.STAGES[-1][0]:
                assert out.columns == table.columns and out.schema["n_chars"].dataType == table.schema["n_chars"].dataType
            rows = out.collect()
            assert len(rows) <= table.count()
