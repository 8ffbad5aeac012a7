import sentencepiece

import brute
import corpus_pipeline as P
from panelkit.llm import mixing, quality
from panelkit.llm.common import release, written
from panelkit.llm.sentencepiece_trie import MODEL_PATH

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    """Every stage on the whole result of the one before it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "exact_dedup", "simhash_near_dedup", "mixing", "sentencepiece"]

    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    good = written(P.quality(spark, docs, SF), "t")
    assert good.columns == columns
    assert {r.doc_id for r in good.collect()} == {i for i, s in scores.items() if s >= 0.7}

    once = written(P.exact(spark, good, SF), "t")
    want = {r[0] for r in brute.exact([(r.doc_id, r.text) for r in good.collect()]) if r[3]}
    assert once.columns == columns and sorted(r.doc_id for r in once.collect()) == sorted(want)

    far = written(P.near(spark, once, SF), "t")
    want = {i for i, _, c in brute.near_components([(r.doc_id, r.text) for r in once.collect()]) if i == c}
    assert far.columns == columns and sorted(r.doc_id for r in far.collect()) == sorted(want)

    mixed = written(P.mix(spark, far, SF), "t")
    copies = {r.doc_id: r.copies for r in mixing.mix(far).collect()}
    seen = {}
    for r in mixed.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert mixed.columns == columns and seen == {i: c for i, c in copies.items() if c}

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    text = {r.doc_id: r.text for r in mixed.collect()}
    rows = P.tokens(spark, mixed, SF).collect()
    assert len(rows) == mixed.count() and all(r.token_ids == lib.encode(text[r.doc_id]) for r in rows)

    whole = P.run(spark, SF).collect()
    assert sorted((r.doc_id, tuple(r.token_ids)) for r in whole) == sorted((r.doc_id, tuple(r.token_ids)) for r in rows)
    assert release(spark) > 0


def test_empty_and_odd_documents_pass_through(spark, edge_docs, tmp_path):
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in P.STAGES[:-1]:
            now = written(stage(spark, now, str(tmp_path)), name)
            assert now.columns == docs.columns
        assert P.STAGES[-1][1](spark, now, str(tmp_path)).count() == now.count()


def test_queries_are_registered(spark):
    import __spark_entry__ as E
    found = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in found if n[2].isdigit()) == list(range(1, 11))
    assert "pipeline" in E.queries() and set(E.oracle_sql()) <= set(E.queries())
