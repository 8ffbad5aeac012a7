import pytest
from pyspark.sql import functions as F

import brute
from panelkit.llm import merkle as M
from panelkit.llm.queries import op8_merkle_fingerprints

SF = "/root/testdata/sf0.001"


def edits(rows):
    """(id, text, edited, next) in the order of descending ids, nulls last, ties by text."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    out = []
    for k, (i, t) in enumerate(order):
        nxt, h = order[(k + 1) % len(order)][1], len(t) // 2
        out.append((i, t, t[:len(t) - h] + nxt[:h], nxt))
    return out


def check(rows, want, fp):
    assert len(rows) == len(want)
    got = sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in rows], key=str)
    assert got == sorted([(i, len(t), brute.sha(e)) for i, t, e, _ in want], key=str)
    one = {}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) >= (r.fingerprint == r.edited_fingerprint)
    for i, t, _, _ in want:
        one.setdefault(t, set()).add(fp(i, t))
    assert all(len(x) == 1 for x in one.values()) and len({next(iter(x)) for x in one.values()}) == len(one)


def test_query(spark, small_rows):
    rows = op8_merkle_fingerprints(spark, SF).collect()
    want = edits([(i, t) for i, t, _ in small_rows])
    by = {r.doc_id: r.fingerprint for r in rows}
    check(rows, want, lambda i, t: by[i])
    long = [r for r in rows if r.n_chars > 400]
    assert all(0.2 < r.near_edited for r in long)
    assert sum(r.near_edited for r in long) / len(long) > 0.4


@pytest.mark.parametrize("blocks", [1, 4])
def test_edge_cases_and_block_borders(spark, edge_docs, no_docs, monkeypatch, blocks):
    monkeypatch.setattr(M, "BLOCK_ROWS", 14 // blocks)
    rows = M.fingerprint_edits(edge_docs).collect()
    texts = {(i, t or "") for i, t in [(r.doc_id, r.text) for r in edge_docs.collect()]}
    fps = {r.text: r.fingerprint for r in M.fingerprints(edge_docs).join(edge_docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id").collect()}
    fps["one"] = fps.get("one") or [r.fingerprint for r in rows if r.doc_id is None][0]
    want = edits([(r.doc_id, r.text) for r in edge_docs.collect()])
    check(rows, want, lambda i, t: fps.get(t))
    assert texts
    assert M.fingerprint_edits(no_docs).count() == 0


def test_blocks_follow_descending_ids(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 5)
    docs = spark.range(60).select((F.col("id") * F.col("id") * 7 - 300).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string"), F.lit(" tail " * 3)).alias("text"))
    want = edits([tuple(r) for r in docs.collect()])
    got = {r.doc_id: r.edited_sha256 for r in M.fingerprint_edits(docs).collect()}
    assert got == {i: brute.sha(e) for i, _, e, _ in want}


def test_edit_is_located(spark):
    lines = [f"line {i} has some words of its own number {i * i}" for i in range(60)]
    before, after = "\n".join(lines), "\n".join([*lines[:30], "something else entirely here", *lines[31:]])
    fp = {r.doc_id: r.fingerprint for r in M.fingerprints(spark.createDataFrame([(1, before), (2, after), (3, before)], "doc_id long, text string")).collect()}
    pairs = spark.createDataFrame([(fp[1], fp[2]), (fp[1], fp[3])], "before string, after string")
    changed, same = (r.changed for r in M.locate_edits(pairs).collect())
    assert same == [] and 1 <= len(changed) <= 2 and 1 <= sum(len(c.paragraphs) for c in changed) <= 3


def test_no_python_on_the_main_path(edge_docs):
    plan = M.fingerprint_edits(edge_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def next_of(rows):
    """Multiset of (id, text, next text), by descending id and text hash."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, brute.sha(r[1])), reverse=True)
    return sorted(((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)), key=str)


@pytest.mark.parametrize("rows", [
    [(i, f"t{i}") for i in range(400)] + [(10 ** 18, "far"), (-2 ** 63, "least"), (2 ** 63 - 1, "most")],
    [(None, f"t{i}") for i in range(400)] + [(5, "five")],
    [(7, "same")] * 300 + [(None, "same")] * 50 + [(i, "same") for i in range(20)],
    [(i % 3, f"t{i}") for i in range(200)],
    [(1, "one")]])
def test_next_wherever_the_ids_lie(spark, monkeypatch, rows):
    monkeypatch.setattr(M, "BLOCK_ROWS", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, M.with_next(df).collect()), key=str) == next_of(rows)


@pytest.mark.parametrize("ids", ["id", "if(id = 0, 1000000000000000000, id)", "cast(null as long)", "if(id % 3 = 0, null, id * id)"])
def test_blocks_are_bounded_wherever_the_ids_lie(spark, ids):
    keys = spark.range(20_000).selectExpr(f"{ids} as doc_id", "sha2(cast(id as string), 256) as th")
    sizes = [r["count"] for r in M.with_block(keys, M.block_starts(keys, 20_000)).groupBy("at").count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) == 9 and max(sizes) < 2 * M.BLOCK_ROWS
