import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from lossworks.jobs import review
from lossworks.operators import triangles
from lossworks.sources import claims

SCHEMA = "segment string, claim_id string, accident_date date, report_date date, evaluation_date date, paid_to_date double, case_reserve double, status string, seq long"
D = dt.date.fromisoformat


def brute(rows, as_of, months):
    """Cells by looking up every claim's state at every cell date."""
    as_of = D(as_of)
    index = lambda d: d.year * 12 + d.month - 1
    end = lambda m: dt.date(m // 12 + (m % 12 == 11), (m + 1) % 12 + 1, 1) - dt.timedelta(days=1)
    last = index(as_of) if end(index(as_of)) == as_of else index(as_of) - 1
    out = {}
    for segment, group in itertools.groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0]):
        kept = [r for r in sorted(group, key=lambda r: r[8]) if r[4] <= as_of]
        if not kept:
            continue
        periods = [index(r[2]) // months for r in kept]
        lo, hi = min(periods), max(periods)
        n = (last - lo * months + 1) // months
        for p in range(lo, hi + 1):
            for j in range(n):
                at = p * months + (j + 1) * months - 1
                if at > last:
                    out[segment, p - lo, j] = None
                    continue
                cell = [0.0] * 7
                for _, snaps in itertools.groupby(sorted(kept, key=lambda r: (r[1], r[8])), key=lambda r: r[1]):
                    snaps = [*snaps]
                    if index(snaps[0][2]) // months != p or snaps[0][3] > end(at):
                        continue
                    seen = sorted((s for s in snaps if s[4] <= end(at)), key=lambda s: (s[4], s[8]))
                    s = seen[-1] if seen else None
                    paid, case, closed = (s[5], s[6] if s[7] == "open" else 0, s[7] == "closed") if s else (0, 0, False)
                    for k, v in enumerate((paid, paid + case, case, 1, not closed, closed, closed and paid > 0)):
                        cell[k] += v
                out[segment, p - lo, j] = cell
    return out


@pytest.mark.parametrize("cadence,as_of", [("annual", "2023-12-31"), ("quarterly", "2023-11-15")])
def test_triangles_match_brute_force(spark, cadence, as_of):
    rng = random.Random(3)
    rows, seq = [], 0
    for s in ("a", "b", "late"):
        for c in range(25):
            acc = dt.date(2021 if s != "late" else 2024, 1, 1) + dt.timedelta(days=rng.randrange(1000))
            rep = acc + dt.timedelta(days=rng.randrange(500))
            for _ in range(rng.randrange(1, 6)):
                ev = acc + dt.timedelta(days=rng.choice((100, 200, 400, 400, 700, 900)))
                rows.append((s, f"c{c}", acc, rep, ev, float(rng.randrange(100)), float(rng.randrange(50)), rng.choice(("open", "closed")), seq))
                seq += 1
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = triangles.build_triangles(df, as_of, cadence).collect()
    want = brute(rows, as_of, 12 if cadence == "annual" else 3)
    assert len(got) == len(want)
    for r in got:
        cell = want[r["segment"], r["origin_idx"], r["age_idx"]]
        assert [r[k] for k in triangles.KINDS] == (pytest.approx(cell) if cell else [None] * 7), r


def test_cells_worked_by_hand(spark):
    """X and Y of 2017 (Y reported a year later) end at 400 and 75, Z of 2018 closes without payment, W of 2019 is open."""
    rows = [
        ("s", "X", D("2017-02-20"), D("2017-05-05"), D("2017-12-31"), 120.0, 300.0, "open", 1), ("s", "X", D("2017-02-20"), D("2017-05-05"), D("2018-12-31"), 250.0, 90.0, "open", 2),
        ("s", "X", D("2017-02-20"), D("2017-05-05"), D("2019-12-31"), 400.0, 0.0, "closed", 3), ("s", "Y", D("2017-11-02"), D("2018-01-15"), D("2018-12-31"), 60.0, 40.0, "open", 4),
        ("s", "Y", D("2017-11-02"), D("2018-01-15"), D("2019-12-31"), 75.0, 0.0, "closed", 5), ("s", "Z", D("2018-08-09"), D("2018-09-01"), D("2018-12-31"), 0.0, 500.0, "open", 6),
        ("s", "Z", D("2018-08-09"), D("2018-09-01"), D("2019-06-30"), 0.0, 0.0, "closed", 7), ("s", "W", D("2019-04-04"), D("2019-04-20"), D("2019-12-31"), 33.0, 67.0, "open", 8),
        ("later", "V", D("2020-01-09"), D("2020-01-20"), D("2020-12-31"), 5.0, 5.0, "open", 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = triangles.build_triangles(df, "2019-12-31").orderBy("origin_idx", "age_idx").collect()
    none = None
    assert [r["paid"] for r in out] == [120, 310, 475, 0, 0, none, 33, none, none]
    assert [r["incurred"] for r in out] == [420, 440, 475, 500, 0, none, 100, none, none]
    assert [r["closed_with_pay_count"] for r in out] == [0, 0, 2, 0, 0, none, 0, none, none]
    assert [r["reported_count"] for r in out] == [1, 2, 2, 1, 1, none, 1, none, none]
    assert [(r["segment"], r["code"]) for r in triangles.build_errors(df, "2019-12-31").collect()] == [("later", "NO_CLAIMS")]
    assert triangles.build_triangles(df, "2019-12-31", "quarterly").orderBy("origin_idx").first()["origin"] == "2017Q1"


def test_loss_run(spark, tmp_path):
    path = tmp_path / "run.csv"
    path.write_text(
        "\ufeffClaim ID,Accident Date,report_date,evaluation_date,Paid To Date,case_reserve,Status,extra,status\r\n"
        'CL-1,2021-03-15,2021-04-01,2021-12-31,1000,500.5,Open,"a ""b"", c",closed\r\n'
        'CL-2,2021-02-30,2021-04-01,2021-12-31,"1,000",5,shut,,\r\n'
        "\r\n,2021-03-15,2021-03-01,2020-12-31,1,2,open,,\r\n"
    )
    rows, errors = claims.loss_run_csv(spark, str(path))
    assert [(r["claim_id"], r["case_reserve"], r["status"]) for r in rows.collect()] == [("CL-1", 500.5, "open")]
    said = errors.collect()
    assert len(said) == 6 and any("evaluation_date is before" in r["message"] for r in said)
    assert {(r["line"], r["row"]["claim_id"] or "") for r in said} == {(3, "CL-2"), (5, "")}
    (tmp_path / "bad.csv").write_text("claim_id,accident_date\n1,2\n")
    rows, errors = claims.loss_run_csv(spark, str(tmp_path))
    assert rows.count() == 1
    found = [r["message"] for r in errors.collect() if r["source_file"].endswith("bad.csv")]
    assert found == ["SHAPE: missing column report_date, evaluation_date, paid_to_date, case_reserve, status"]


def test_review_lists_every_check(spark):
    base = ("s", "CL-1", D("2021-03-15"), D("2021-04-01"), D("2021-12-31"), 1000.0, 500.0, "open")
    rows = [(*base, 1), (*base, 2), ("s", "CL-2", D("2021-03-15"), D("2021-03-01"), D("2021-02-01"), float("nan"), -1.0, "open", 3), ("s", "CL-3", D("2021-03-15"), D("2021-04-01"), D("2022-12-31"), -5.0, 1.0, "closed", 4)]
    checks, findings = review.review_claims(spark.createDataFrame(rows, SCHEMA), "2021-12-31")
    got = {r["check_id"]: (r["status"], r["n_findings"]) for r in checks.collect()}
    assert got["non-finite-value"] == ("fail", 1) and got["negative-paid"] == ("fail", 1) and got["negative-case"] == ("warning", 1)
    assert got["date-order"] == ("fail", 2) and got["duplicate-snapshot"] == ("fail", 1) and got["future-dated"] == ("fail", 1)
    assert got["closed-with-case"] == ("warning", 1) and got["paid-decreasing"] == ("pass", 0)
    assert review.shown(findings, 1).filter("check_id = 'date-order'").first()["more"] == 1
    assert {r["check_id"]: r["status"] for r in review.review_claims(spark.createDataFrame(rows, SCHEMA))[0].collect()}["future-dated"] == "not-evaluated"


def test_queries_match_sql(spark):
    """A few queries against their SQL twins at the smallest scale."""
    import duckdb

    from lossworks.registry import ORACLE_SQL, QUERIES

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("orders", "lineitem", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("build_triangles", "chain_ladder", "review_claims"):
        df = QUERIES[name](spark, sf)
        want = con.execute(ORACLE_SQL[name])
        names = [d[0] for d in want.description]
        rows = sorted(map(str, want.fetchall()))
        assert sorted(str(tuple(r[c] for c in names)) for r in df.select(*(F.col(c) for c in names)).collect()) == rows, name
