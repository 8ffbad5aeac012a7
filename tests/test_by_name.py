"""The by-name scan: ranges, bindings, ragged rows and quoting."""

import csv
import random

import pytest

from panelkit.sources import by_name as B
from panelkit.sources import io


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def mixed_dir(tmp_path_factory):
    """40 files in many column orders, and the rows they hold."""
    d = tmp_path_factory.mktemp("mixed files")
    rng = random.Random(3)
    names, want = ["k", "a", "b", "c"], []
    for i in range(40):
        order = names[:1] + rng.sample(names[1:], rng.randrange(0, 4)) + ["extra"]
        rng.shuffle(order)
        with open(d / f"f{i}.csv", "w", newline="") as f:
            w = csv.writer(f, delimiter=";", lineterminator=rng.choice(["\n", "\r\n"]))
            w.writerow(order)
            for j in range(rng.randrange(0, 30)):
                row = {n: rng.choice([f"{n}{i}-{j}", "", "x y", "a;b", "é🎉"]) for n in order}
                row["k"] = f"{i}-{j}"
                w.writerow([row[n] for n in order])
                want.append(tuple(row.get(n) or None for n in names))
    (d / "empty.csv").write_text("")
    (d / "header_only.csv").write_text("k;a\n")
    return str(d), names, sorted(want, key=str)


@pytest.mark.parametrize("split_bytes", [64 << 20, 97, 7])
def test_every_split_size_gives_the_rows_once(spark, mixed_dir, split_bytes):
    path, names, want = mixed_dir
    got = B.scan(spark, io.list_files(spark, path), names, ";", ["k"], split_bytes)
    assert _rows(got) == want


def test_blocks_smaller_than_lines(tmp_path, monkeypatch):
    lines = [b"x" * n + b"\n" for n in (0, 1, 5, 40, 3, 0, 17)] + [b"no end"]
    (tmp_path / "t").write_bytes(b"".join(lines))
    size = sum(map(len, lines))
    for block in (1, 3, 64):
        monkeypatch.setattr(B, "BLOCK_BYTES", block)
        for split in (1, 2, 9, 100):
            with B.open_file(f"file:{tmp_path}/t") as f:
                got = [x for a in range(0, size, split) for x in B.line_blocks(f, a, min(size, a + split))]
            assert b"".join(got) == b"".join(lines), (block, split)


def test_one_scan_for_many_headers_equals_the_union(spark, mixed_dir):
    path, names, want = mixed_dir
    one = io.read_delimited_dir(spark, path, names)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1 and "Union" not in plan
    assert _rows(one) == want == _rows(io.read_delimited_dir(spark, path, names, method="union"))


def test_odd_rows(spark, tmp_path):
    (tmp_path / "odd.csv").write_bytes(b"\xef\xbb\xbfk;v;w\n1;a\n2;b;c;d\n\n   \n3;\"q;\"\"r\"\"\";\n4;\"\";\xff\n5;last;z")
    got = _rows(io.read_delimited_dir(spark, str(tmp_path), ["k", "v", "w", "none"]))
    assert got == [("1", "a", None, None), ("2", "b", "c", None), ("3", 'q;"r"', None, None), ("4", "", "�", None), ("5", "last", "z", None)]


def test_no_files_give_no_rows(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    out = io.read_delimited_dir(spark, str(tmp_path), ["k", "v"])
    assert out.columns == ["k", "v"] and out.count() == 0


def test_compressed_files_go_to_sparks_reader(spark, tmp_path):
    import gzip
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(b"v;k\nx;1\n"))
    assert _rows(io.read_delimited_dir(spark, str(tmp_path), ["k", "v"], glob="*")) == [("1", "x")]
