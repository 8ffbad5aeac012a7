import re
from collections import Counter

import pytest

from panelkit.llm import lines as L
from panelkit.llm.queries import op7_line_dedup

SF = "/root/testdata/sf0.01"


def test_query_matches_duckdb(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.execute(L.SQL).fetchall()
    got = [tuple(r) for r in op7_line_dedup(spark, SF).collect()]
    assert sorted(got) == sorted(want) and sum(r[3] for r in got) > 0


def test_ratio_is_taken_per_host(spark):
    def page(i, host, body):
        return (i, f"https://{host}/x/{i}", f"<html><body><nav><a>Menu</a></nav><p>{body}</p><p>Foot</p></body></html>", "clash")
    pages = [page(i, "A.example", f"text {i % 9}") for i in range(10)] + [page(i, "b.example:80", f"Menu {i}") for i in range(20, 23)]
    rows = L.line_dedup(spark.createDataFrame(pages, "page_id long, url string, html string, lines string")).collect()
    by = {r.page_id: r for r in rows}
    assert by[0].host == "a.example" and by[0].kept_text == "text 0" and by[0].n_removed == 2
    assert by[20].host == "b.example" and by[20].kept_text == "Menu 20"      # small hosts are judged like others


def plain_lines(html):
    shown = re.sub(r"<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "\n", html or "", flags=re.I | re.S)
    cut = re.sub(r"<[^>]*>", "", re.sub(L.BLOCK, "\n", shown))
    return [x for x in (re.sub(r"[ \t\r]+", " ", y).strip(" ") for y in cut.split("\n")) if x]


def plain_host(url):
    m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "", flags=re.I)
    return m.group(1).lower() if m else ""


def brute(rows, ratio=0.3):
    cut = [(i, plain_host(u), plain_lines(h)) for i, u, h in rows]
    pages, seen = Counter(h for _, h, _ in cut), Counter((h, x) for _, h, lines in cut for x in set(lines))
    out = []
    for i, h, lines in cut:
        kept = [x for x in lines if not (seen[h, x] > 1 and seen[h, x] > ratio * pages[h])]
        out.append((i, h, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [L.BROADCAST_LIMIT_BYTES, 0])
def test_counts_in_plain_python(spark, monkeypatch, limit):
    """The given pages and hosts of 1, 2, 3 and 4 pages, boilerplate sent whole or joined."""
    monkeypatch.setattr(L, "BROADCAST_LIMIT_BYTES", limit)
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    for n in (1, 2, 3, 4):
        rows += [(10_000 * n + i, f"https://h{n}.example/{i}", f"<p>on all</p><p>own {i}</p>" + "<p>on two</p><p>on two</p>" * (i < 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted([tuple(r) for r in L.line_dedup(df.repartition(5)).collect()], key=str)
    assert got == brute(rows)
    by = {r[0]: r for r in got}
    assert [by[10_000 * n][3] for n in (1, 2, 3, 4)] == [0, 3, 3, 3]
    assert sum(r[3] for r in got if r[0] < 10_000) == 104


def test_edge_cases(spark):
    rows = [(1, None, None), (1, None, None), (None, "nonsense", ""), (2, "http://u:p@h.x/?q", "a\n" * 5000), (3, "HTTP://h.x", "<p>" + "z" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = L.line_dedup(df).collect()
    assert len(got) == 5 and {r.n_lines for r in got} == {0, 5000, 1}
    assert {r.host for r in got} == {"", "h.x"}
    assert L.line_dedup(df.limit(0)).count() == 0
    plan = L.line_dedup(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
