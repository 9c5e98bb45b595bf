import corpus_pipeline


def test_stages_keep_columns_and_run_on_odd_rows(spark, odd, none):
    docs = odd.select("doc_id", "text", "lang", "source")
    for frame in (docs, none.select(*docs.columns)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            frame = corpus_pipeline.written(stage(spark, frame, ""), name)
            assert frame.columns == docs.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, frame, "").columns[0] == "doc_id"


def test_each_stage_as_brute_force(spark, small):
    """Rows of each stage on the smallest tables, as plain Python tells them from the stage's own input."""
    import hashlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from lodestream.llm import langid, mixing
    from tests.llm.test_exact import brute as brute_exact
    from tests.llm.test_minhash import brute as brute_near

    read = lambda df: [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = corpus_pipeline.written(corpus_pipeline.language(spark, docs, small), "language")
    identifier = langid.fit(langid.training_rows(docs))
    every = read(docs)
    rejected = identifier.predict([t for _, t, *_ in every])[3]
    assert sorted(read(kept), key=str) == sorted((r for r, out in zip(every, rejected) if not out), key=str)
    one = corpus_pipeline.written(corpus_pipeline.exact_dedup(spark, kept, small), "exact")
    stays = {i for i, _, _, k in brute_exact(read(kept)) if k}
    assert sorted(read(one)) == sorted(r for r in read(kept) if r[0] in stays)
    near = corpus_pipeline.written(corpus_pipeline.near_dedup(spark, one, small), "near")
    stays = {i for i, _, _, k in brute_near(read(one)) if k}
    assert sorted(read(near)) == sorted(r for r in read(one) if r[0] in stays)
    mixed = corpus_pipeline.written(corpus_pipeline.mix_sources(spark, near, small), "mixed")
    plan = sorted((p, r.id) for r in mixing.plan(near).collect() for p in r.positions)
    assert len({p for p, _ in plan}) == len(plan)  # so that the order is told in full
    tokens = corpus_pipeline.encode(spark, mixed, small).orderBy("position").collect()
    assert [r.doc_id for r in tokens] == [i for _, i in plan] and [r.position for r in tokens] == list(range(len(plan)))
    library, texts = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {r[0]: r[1] or "" for r in every}
    for r in tokens:
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
