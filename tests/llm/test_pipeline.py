import corpus_pipeline
from limnos.llm import bpe, jaccard, latent, quality, secrets
from limnos.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_whole(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "BPE encoding and decoding"]
    docs = table(spark, SF, "documents")
    good = {r.doc_id for r in quality.quality_rules(docs).filter("kept").select("doc_id").collect()}
    left = docs.filter(docs.doc_id.isin(*good))
    one = {r.doc_id for r in jaccard.jaccard_join(left, 5, 80).filter("component_id = doc_id").collect()}
    left = left.filter(left.doc_id.isin(*one))
    leaked = {r.doc_id for r in latent.leaks(left, table(spark, SF, "benchmark")).select("doc_id").collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == one - leaked
    masked = secrets.redact(left, secrets.Forest.train(secrets.labelled_findings(spark)))
    want = {r.doc_id: r for r in bpe.digests(bpe.encode_decode(masked, corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))).collect()}
    assert all(want[r.doc_id] == r for r in got)


def test_every_stage_takes_odd_and_no_rows(spark, odd, none):
    for docs in (odd, none):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            out.collect()
            if k + 1 < len(corpus_pipeline.STAGES):
                assert out.dtypes == docs.dtypes
