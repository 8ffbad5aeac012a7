"""Splits are disjoint and complete; budgets never exceeded; folds stable."""

from pyspark.sql import functions as F

from panelkit.operators import sampling as SP


def test_split_exact_sizes(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    s = SP.split_exact(df, ["k"], 0.8).toPandas()
    assert len(s) == 1003 and s["is_train"].sum() == int(1003 * 0.8)


def test_split_stratified_ceil(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    s = SP.split_exact(df, ["k"], 0.8, by=["y"], rounding="ceil").toPandas()
    for y, g in s.groupby("y"):
        import math
        assert g["is_train"].sum() == math.ceil(0.8 * len(g))


def test_budget_never_exceeded_and_prefix(spark):
    ent = spark.range(200).select(F.col("id").alias("e"), ((F.col("id") * 7) % 50 + 1).alias("n"))
    adm = SP.budget_admit(ent, "e", "n", 1000).toPandas()
    assert adm["n"].sum() <= 1000
    assert adm["cumulative_rows"].max() == adm["n"].sum()
    top = SP.budget_admit(ent, "e", "n", 1000, order="largest").toPandas()
    assert top["n"].sum() <= 1000 and top["n"].min() >= ent.toPandas().sort_values(
        ["n", "e"], ascending=[False, True])["n"].iloc[len(top) - 1]


def test_null_stratum_keeps_its_rows(spark):
    df = spark.range(100).select(F.col("id").alias("k"), F.when(F.col("id") % 4 != 0, F.col("id") % 2).alias("s"))
    out = SP.split_exact(df, ["k"], 0.8, by=["s"])
    assert out.count() == 100
    assert {r["s"]: r["t"] for r in out.groupBy("s").agg(F.sum("is_train").alias("t")).collect()} == {None: 20, 0: 20, 1: 40}


def test_large_sample_takes_the_rank_path(spark, monkeypatch):
    df = spark.range(3000).withColumnRenamed("id", "k")
    small = {r["k"] for r in SP.sample_n(df, ["k"], 700).collect()}
    monkeypatch.setattr(SP, "TOP_K_ROWS", 10)
    assert {r["k"] for r in SP.sample_n(df, ["k"], 700).collect()} == small


def test_kfold_balanced_and_deterministic(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    a = SP.kfold(df, ["k"], 5).toPandas()
    b = SP.kfold(df, ["k"], 5).toPandas()
    assert (a.sort_values("k")["fold"].values == b.sort_values("k")["fold"].values).all()
    counts = a["fold"].value_counts()
    assert counts.min() > 500 and set(counts.index) == set(range(5))


def test_sample_n_exact(spark):
    df = spark.range(10000).withColumnRenamed("id", "k")
    assert SP.sample_n(df, ["k"], 480).count() == 480


def test_null_safe_enrich_and_distinct(spark):
    from panelkit.operators import aggregate as A, joins as J
    fact = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k int, v string")
    dim = spark.createDataFrame([(1, "x"), (None, "y")], "k int, w string")
    plain = {r["v"]: r["w"] for r in J.enrich(fact, dim, "k", "left").collect()}
    safe = {r["v"]: r["w"] for r in J.enrich(fact, dim, "k", "left", null_safe=True).collect()}
    assert plain == {"a": "x", "b": None, "c": None}
    assert safe == {"a": "x", "b": "y", "c": None}
    df = spark.range(5000).select((F.col("id") % 7).alias("g"), (F.col("id") % 101).alias("u"))
    exact = {r["g"]: r["n_distinct"] for r in A.n_distinct(df, "u", ["g"]).collect()}
    approx = {r["g"]: r["n_distinct"] for r in A.n_distinct(df, "u", ["g"], approx=True).collect()}
    assert all(exact[g] == 101 and abs(approx[g] - 101) <= 5 for g in exact)


def test_rename_by_name_position_and_safe(spark):
    from panelkit.operators import prep
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert prep.rename(df, {"a": "x"}).columns == ["x", "b", "c"]
    assert prep.rename(df, ["N households", "1st", "N households"], make_safe=True).columns == [
        "N.households", "X1st", "N.households.1"]
