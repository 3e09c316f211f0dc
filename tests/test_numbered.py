"""Numbers of lines and records in files of many splits."""

import csv
import io
import random

import pytest

from loomgraph.sources import numbered, readers


@pytest.fixture(params=[60, 1 << 27])
def splits(spark, request):
    """Splits of a few bytes, then whole files."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]
    for k, v in zip(keys, (request.param, 1)):
        spark.conf.set(k, v)
    yield request.param
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


def test_lines_of_many_splits(spark, tmp_path, splits):
    rng = random.Random(1)
    want = {}
    for name in ("a.txt", "b.txt", "empty.txt"):
        lines = [] if name == "empty.txt" else ["".join(rng.choices("xyé ", k=rng.choice([0, 0, 3, 9, 200]))) for _ in range(300)]
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name == "a.txt" else ""), encoding="utf-8")
        want |= {(name, k): x for k, x in enumerate(lines if lines and (name == "a.txt" or lines[-1]) else lines[:-1], 1)}
    frame = numbered.numbered_lines(spark, str(tmp_path))
    got = {(r.path.rsplit("/", 1)[1], r.line): r.value for r in frame.collect()}
    assert got == want
    if splits == 60:
        assert frame.select("line").rdd.getNumPartitions() > 8
        plan = frame._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert plan.count("Exchange") <= 6 and "SinglePartition" not in plan


CELLS = ["a", "", "b c", 'say "x"', "two\nlines", "\n\n", ",", '"', "é" * 30, "1\n\n2", " "]


def test_records_across_lines_and_splits(spark, tmp_path, splits):
    rng = random.Random(2)
    want = []
    for k, name in enumerate(("a.csv", "b.csv")):
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n")
        w.writerow(["text", "body", "n"])
        for i in range(120):
            row = [rng.choice(CELLS), rng.choice(CELLS), f"{k}-{i}"]
            w.writerow(row)
            want.append((name, i + 2, *row))
            if rng.random() < 0.1:
                out.write("\n")
        (tmp_path / name).write_text(out.getvalue(), encoding="utf-8")
    got = [(r.path__.rsplit("/", 1)[1], r.record__, r.text or "", r.body or "", r.n) for r in numbered.read_table(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    lines = {(r.path.rsplit("/", 1)[1], r.line): r.text for r in readers.read_records(spark, f"{tmp_path}/a.csv").collect()}
    assert lines == {(n, i): "\n".join(x for x in (t.strip(), b.strip()) if x).strip() for n, i, t, b, _ in want if n == "a.csv"}


def test_articles_of_many_splits(spark, tmp_path, splits):
    heads, blocks = [], []
    for k in range(40):
        heads += [f"# head {k}", "", *(f"line {k} {i}" for i in range(k % 5))]
        blocks += ["", *(f"line {k} {i}" for i in range(1 + k % 5))]
    (tmp_path / "h.txt").write_text("\n".join(heads))
    (tmp_path / "b.txt").write_text("\n".join(blocks))
    got = [(r.title, r.body) for r in readers.read_articles(spark, f"{tmp_path}/h.txt").orderBy("number").collect()]
    assert got == [(f"head {k}", " ".join(f"line {k} {i}" for i in range(k % 5))) for k in range(40)]
    got = [r.body for r in readers.read_articles(spark, f"{tmp_path}/b.txt").orderBy("number").collect()]
    assert got == [" ".join(f"line {k} {i}" for i in range(1 + k % 5)) for k in range(40)]


def test_tables_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,body\n")
    assert readers.read_records(spark, f"{tmp_path}/a.csv").collect() == []
    (tmp_path / "b.csv").write_text("")
    with pytest.raises(ValueError):
        numbered.read_table(spark, f"{tmp_path}/b.csv")
