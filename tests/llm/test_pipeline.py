from collections import Counter

import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F
from specloom.llm import mixing, pieces, secrets, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = now
        path = str(tmp_path / name)
        stage(spark, now, SF).write.parquet(path)
        now = spark.read.parquet(path)
        rows = {r.doc_id: r for r in before.collect()}
        if name != "sentencepiece":
            assert now.columns == docs.columns
        got = now.collect()
        assert got and {r.doc_id for r in got} <= set(rows)
        if name == "toxicity":
            scores = toxicity.score(before, toxicity.fit(before, labels)).collect()
            assert {r.doc_id for r in got} == {r.doc_id for r in scores if r.score < toxicity.THRESHOLD}
        elif name == "simhash_near_dedup":
            gone = set(rows) - {r.doc_id for r in got}
            kept = {r.doc_id: r.text for r in got}
            assert gone and len(set(kept.values())) == len(kept)
            reach = {d: [k for k, t in kept.items() if simhash.jaccard(rows[d].text, t) >= 0.5] for d in gone}
            assert sum(map(bool, reach.values())) >= 0.95 * len(gone)
            close = [(a, b) for a in kept for b in kept if a < b and simhash.jaccard(kept[a], kept[b]) >= 0.9]
            assert len(close) <= 1
        elif name == "secret_scans":
            found = [r for r in secrets.scan(before).collect() if r.secret]
            texts = {r.doc_id: r.text for r in got}
            assert len(got) == len(rows) and all(r.value not in texts[r.doc_id] for r in found)
            assert {d for d in texts if texts[d] != rows[d].text} == {r.doc_id for r in found}
        elif name == "mixing":
            times = {r.doc_id: r.times if r["size"] else 1 for r in mixing.mix(before).collect()}
            assert Counter(r.doc_id for r in got) == Counter({d: n for d, n in times.items() if n})
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
            assert all(r.ids == library.encode(rows[r.doc_id].text) for r in got)


def test_run_and_clashing_columns(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "source", "ids"] and out.where(F.size("ids") > 0).count() > 50
