import corpus_pipeline as cp
import public_tokenizers
from tokenizers import Tokenizer

from acreline.llm import encoding, pii, quality
from acreline.llm.queries import QUERIES, op1_token_counts

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_rows(spark, documents):
    docs = documents
    for _, stage in cp.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        docs = after.checkpoint()
    pieces = cp.STAGES[-1][1](spark, docs, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(p["length"] for p in pieces) == ids


def test_quality_stage_drops_what_the_classifier_rejects(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r["doc_id"]: r["_llm_score"] for r in
              quality.score(documents, quality.train(documents, labels)).collect()}
    kept = {r["doc_id"] for r in cp.quality_filter(spark, documents, SF).collect()}
    assert kept == {i for i, s in scores.items() if s >= cp.REJECT_BELOW}


def test_pseudonym_stage_equals_the_operator(spark, documents):
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cp.pseudonyms(spark, documents, SF).collect()}
    want = {r["doc_id"]: r["text"] for r in pii.pseudonymize(documents, cp.PII_KEY).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_every_stage_takes_awkward_and_empty_tables(spark, awkward, nothing):
    for table in (awkward, nothing):
        for _, stage in cp.STAGES:
            stage(spark, table, SF).count()


def test_packing_leaves_no_encoder_in_the_worker(spark, documents, monkeypatch):
    seen, frame = [], type(documents)
    real = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **b: (seen.append(f), real(self, f, *a, **b))[1])
    cp.pack_sequences(spark, documents, SF)
    monkeypatch.setattr(encoding, "_ENCODERS", {})
    batches = documents.select("doc_id", "text").toArrow().to_batches()
    assert sum(map(len, seen[0](iter(batches)))) >= documents.count()
    assert not encoding._ENCODERS


def test_run_and_names(spark):
    assert cp.run(spark, SF).count() > 0
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert op1_token_counts(spark, SF).count() == 200
