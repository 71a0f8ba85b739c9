"""CSV in byte ranges, against a plain reader that goes through a file from its start."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lossworks.sources import claims, csv_ranges


def plain(text):
    """Records with the line they begin on; quotes count at a field's start, and everything within a quoted field."""
    out, held, first, quoted = [], [], 0, False
    for number, line in enumerate(text.split("\n"), 1):
        if not held:
            first = number
        held.append(line)
        fresh = not quoted
        k = 0
        while k < len(line):
            c = line[k]
            if quoted and c == '"':
                if line[k + 1 : k + 2] == '"':
                    k += 1
                else:
                    quoted, fresh = False, False
            elif not quoted and c == ",":
                fresh = True
                k += 1
                continue
            elif not quoted and c == '"' and fresh:
                quoted = True
            elif not quoted:
                fresh = False
            k += 1
        if not quoted:
            if held != [""]:
                out.append((first, "\n".join(held)))
            held = []
    return out + ([(first, None)] if held and held != [""] else [])


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def written(rng, n):
    fields = ["a", "b c", '"q"', '"a,b"', '"x\ny"', '"he said ""no"""', '"\n\n"', "", '5" pipe', '""', '"long ' + "z" * 60 + '\nend"', '"a"b', '"cut\n\n\nin four"', "é中"]
    return "".join(",".join(rng.choice(fields) for _ in range(rng.choice((1, 2, 4)))) + rng.choice(("\n", "\n", "\n\n")) for _ in range(n))


def test_records_over_ends_of_ranges(spark, small_ranges, tmp_path):
    rng = random.Random(1)
    texts = {f"f{i}.csv": written(rng, n) for i, n in enumerate((60, 1, 200, 30))} | {"open.csv": 'a,b\n1,"never closed\n' + "2,3\n" * 60, "odd.csv": 'x,"a\nb\n' * 41}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    source = csv_ranges.lines(spark, str(tmp_path))
    assert source.rdd.getNumPartitions() > 40  # as many tasks as ranges
    names = {r["f"]: r["p"].rpartition("/")[2] for r in spark.read.text(str(tmp_path)).select(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.file_path").alias("p")).distinct().collect()}
    counts = {}
    for r in source.groupBy("file", "start").count().collect():
        counts[names[r["file"]], r["start"]] = r["count"]
    got = {}
    for r in csv_ranges.records(source).collect():
        name = names[r["file"]]
        before = sum(n for (file, start), n in counts.items() if file == name and start < r["start"])
        got.setdefault(name, []).append((before + r["ord"], r["text"]))
    for name, text in texts.items():
        assert sorted(got[name], key=lambda x: x[0]) == plain(text), name


def test_states_without_a_broadcast(spark, small_ranges, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text(written(random.Random(5), 80))
    source = csv_ranges.lines(spark, str(tmp_path))
    want = sorted(map(tuple, csv_ranges.records(source).collect()), key=str)
    monkeypatch.setattr(csv_ranges, "small_enough", lambda df: False)
    assert sorted(map(tuple, csv_ranges.records(source).collect()), key=str) == want


def test_too_long_a_record_fails_alone(spark, small_ranges, tmp_path, monkeypatch):
    """Within a range, and over several ranges of an unclosed quote that together are too long."""
    monkeypatch.setattr(csv_ranges, "MOST_RECORD", 20)
    rows = [(1, 0, v, None) for v in ("a,b", '1,"' + "x" * 50, "", 'y"', "2,3", '"c', 'd"', '"open')]
    batch = pa.RecordBatch.from_pylist([dict(zip("abcd", r, strict=True)) for r in rows], pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.string()), ("d", pa.bool_())]))
    got = [(r["ord"], r["part"], r["text"]) for out in csv_ranges._records([batch]) for r in out.to_pylist()]
    assert got == [(1, 0, "a,b"), (2, 0, None), (5, 0, "2,3"), (6, 0, '"c\nd"'), (8, 3, '"open')]
    monkeypatch.setattr(csv_ranges, "MOST_RECORD", 300)
    (tmp_path / "a.csv").write_text('a,b\n1,"' + ("x" * 30 + "\n") * 20 + 'y"\n2,3\n1,"' + ("x" * 30 + "\n") * 5 + 'y"\n')
    got = sorted(csv_ranges.records(csv_ranges.lines(spark, str(tmp_path))).collect(), key=lambda r: (r["start"], r["ord"]))
    assert [r["text"] for r in got] == ["a,b", None, "2,3", '1,"' + ("x" * 30 + "\n") * 5 + 'y"']


HEADS = {
    "one.csv": "claim_id,accident_date,report_date,evaluation_date,paid_to_date,case_reserve,status,note",
    "two.csv": "\ufeffStatus,Case Reserve,paid to date,Note,Evaluation Date,Report Date,Accident Date,Claim ID,claim_id",
    "bad.csv": "claim_id,note",
}


def test_loss_runs_of_different_headers(spark, small_ranges, tmp_path):
    note = '"two\nlines, ""quoted"""'
    one = "".join(f"A{i},2020-01-0{i % 9 + 1},2020-02-01,2020-12-31,{i},0.5,open,{note if i % 3 == 0 else ''}\n" for i in range(50))
    two = "".join(f"CLOSED,7,{i},{note},2020-12-31,2020-02-01,2020-01-02,B{i},other\n" for i in range(50)) + 'open,x,1,"a\nb",2020-12-31,2020-02-01,2020-01-02,B99\n'
    for name, body in (("one.csv", one), ("two.csv", two), ("bad.csv", "1,2\n")):
        (tmp_path / name).write_text(HEADS[name] + "\n" + body)
    rows, errors = claims.loss_run_csv(spark, str(tmp_path))
    got = {r["claim_id"]: r for r in rows.collect()}
    assert set(got) == {f"{k}{i}" for k in "AB" for i in range(50)}
    assert all((got[f"A{i}"]["paid_to_date"], got[f"A{i}"]["case_reserve"], got[f"A{i}"]["status"]) == (i, 0.5, "open") for i in range(50))
    assert all((got[f"B{i}"]["paid_to_date"], got[f"B{i}"]["case_reserve"], got[f"B{i}"]["status"]) == (i, 7, "closed") for i in range(50))
    for k in "AB":  # numbers rise along a file
        assert [r["claim_id"] for r in sorted(got.values(), key=lambda r: r["seq"]) if r["claim_id"][0] == k] == [f"{k}{i}" for i in range(50)]
    said = {(r["source_file"].rpartition("/")[2], r["line"], r["message"]) for r in errors.collect()}
    assert said == {("two.csv", 102, "case_reserve is not a plain number"), ("bad.csv", 1, "SHAPE: missing column accident_date, report_date, evaluation_date, paid_to_date, case_reserve, status")}


def test_no_file_has_all_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    rows, errors = claims.loss_run_csv(spark, str(tmp_path))
    assert rows.count() == 0 and errors.count() == 1
