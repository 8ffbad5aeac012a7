import pytest
from pyspark.sql import functions as F

import brute
from panelkit.llm import mixing as M
from panelkit.llm.queries import op6_mixing

SF = "/root/testdata/sf0.01"


def test_targets_match_repeated_resharing(spark):
    for sizes in ({"a": 100, "b": 5, "c": 60, None: 0}, {"src0": 1000, "src1": 10, "src2": 10, "é": 10, "z": 500, None: 7}, {"a": 0}, {"a": 5}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in M.with_targets(df).collect()}
        want = brute.targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
        assert got == pytest.approx(want)


def test_query_meets_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = op6_mixing(spark, SF).collect()
    size = {r.doc_id: len(brute.words(r.text)) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    total = {}
    for i, s in source.items():
        total[s] = total.get(s, 0) + size[i]
    want, taken = brute.targets(total), {}
    assert len(rows) == len(docs)
    for r in rows:
        assert r.size == size[r.doc_id] and r.source_size == total[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.02 * t, (s, taken[s], t)
    assert sorted(map(tuple, op6_mixing(spark, SF).collect())) == sorted(map(tuple, rows))


def test_solved_rates_meet_the_token_constraint(spark):
    sizes = spark.range(1, 500).select(F.lit("a").alias("source"), F.col("id").alias("size"), F.lit(2).cast("long").alias("n"))
    for share in (0.01, 0.3, 1.0, 1.7, 2.9):
        total = 499 * 500
        sources = spark.createDataFrame([("a", total, 998, total / 998, share * total)], "source string, source_size long, docs long, mean double, target double")
        lam = M.solve_rates(sizes, sources, 1).first().lam
        got = sizes.select(F.sum(F.col("n") * F.col("size") * M._rate(F.lit(lam), F.col("size"), F.lit(total / 998)))).first()[0]
        assert got == pytest.approx(share * total, rel=2e-4)


def test_edge_cases(edge_docs, no_docs):
    rows = M.mix(edge_docs).collect()
    assert len(rows) == edge_docs.count() and all(r.taken <= 3 * r.size for r in rows)
    assert len({r.copies for r in rows if r.doc_id == 4}) == 1                # repeated rows are decided alike
    out = M.mix_documents(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == sum(r.copies for r in rows)
    assert M.mix(no_docs).count() == 0 and M.mix_documents(no_docs).count() == 0


def test_no_python_on_the_main_path(edge_docs):
    plan = M.mix_documents(edge_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_blocks_stay_even_where_the_order_crowds(spark, monkeypatch):
    """Rates just above 1 crowd the fill order towards its end."""
    monkeypatch.setattr(M, "BLOCK_ROWS", 500)
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"),
                                    F.when(F.col("id") % 20 > 0, "a").otherwise("b").alias("source"))
    dealt = []
    plain = M.written
    monkeypatch.setattr(M, "written", lambda df, label="t": dealt.append((label, plain(df, label))) or dealt[-1][1])
    rows = M.mix(docs).collect()
    assert sum(r.taken for r in rows if r.source == "b") == pytest.approx(next(r.target for r in rows if r.source == "b"), rel=0.01)
    for label, df in dealt:
        if label == "dealt":
            sizes = [r["count"] for r in df.groupBy("source", "block").count().collect()]
            assert max(sizes, default=0) <= 1000


def test_texts_of_a_null_id_are_decided_apart(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("w "), F.col("id")).alias("text"),
                                    F.when(F.col("id") % 4 > 0, "a").otherwise("b").alias("source"))
    rows = M.mix(docs).collect()
    for s in "ab":
        mine = [r for r in rows if r.source == s]
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, rel=0.01)
    assert M.mix_documents(docs).count() == sum(r.copies for r in rows)
