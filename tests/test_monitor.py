import datetime as dt

import pytest
from pyspark.sql import functions as F

from framelake.functions.measures import mbps
from framelake.operators import monitor
from framelake.schemas import COUNTERS
from framelake.sources import outputs


def samples(spark, rows):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    return spark.createDataFrame([(h, start + dt.timedelta(seconds=s), *c) for h, s, *c in rows], COUNTERS)


ROWS = [("a", 0, 100, 0, 90, 0), ("a", 2, 300, 4, 200, 1), ("a", 100_000, 50, 4, 40, 1), ("b", 1, 7, 0, 7, 0)]


@pytest.mark.parametrize("mode,drops,freezes", [("cumulative", [None, 4, 0, None], [None, 1, 0, None]),
                                                ("per_poll", [None, 4, 4, None], [None, 1, 1, None])])
def test_counter_rates(spark, mode, drops, freezes):
    got = monitor.counter_rates(samples(spark, ROWS), mode, block_us=10_000_000).orderBy("host", "ts").collect()
    assert [r.rx_packets_delta for r in got] == [None, 200, 50, None]  # the third sample follows a restart
    assert [r.rx_drops_delta for r in got] == drops
    assert [r.freeze_q_count_delta for r in got] == freezes
    assert got[1].rx_packets_per_sec == 100.0 and got[1].elapsed_sec == 2.0
    with pytest.raises(ValueError):
        monitor.counter_rates(samples(spark, ROWS), "sometimes")


def test_loss_verdict(spark):
    rows = [("good", 60, 0, 1), ("good", 40, 0, 0), ("lossy", 200, 1, 1), ("quiet", 99, 0, 1), ("mute", 500, 0, 0)]
    df = spark.createDataFrame(rows, "run string, rx_packets long, rx_drops long, output_lines long")
    assert {r.run: r.passed for r in monitor.loss_verdict(df).collect()} == {
        "good": True, "lossy": False, "quiet": False, "mute": False}


def test_breaking_point(spark):
    def run(name, drops, baseline):
        rates = (100_000, 250_000, 500_000, 1_000_000, 2_000_000, 0)
        return [(name, i, rate, rate or 9, d, baseline) for i, (rate, d) in enumerate(zip(rates, drops))]

    rows = run("clean", [3] * 6, 3) + run("mid", [0, 0, 0, 5, 9, 9], 0) + run("top", [1, 1, 1, 1, 1, 2], 1)
    df = spark.createDataFrame(rows, "run string, step long, offered_pps long, actual_pps long, rx_drops long, baseline_drops long")
    got = {r.run: r for r in monitor.breaking_point(df).collect()}
    assert (got["clean"].zero_loss, got["clean"].break_offered) == (True, None)
    assert (got["mid"].break_step, got["mid"].break_offered, got["mid"].last_clean_pps) == (3, "1000000", 500_000)
    assert (got["top"].break_offered, got["top"].break_drops) == ("unbounded", 2)


def test_benchmark_log_grows_and_compares(spark, work):
    path = work()
    rows = [("main", "c1", dt.date(2026, 5, 15), 547_171), ("main", "c2", dt.date(2026, 5, 16), 500_000), ("dev", "d1", dt.date(2026, 5, 1), 600_000)]
    for branch, commit, date, pps in rows:
        df = spark.createDataFrame([(branch, commit, "", date, pps, 100.0, 0, "")],
                                   "branch string, commit string, description string, date date, pps long, "
                                   "cpu_percent double, rx_drops_at_pps long, notes string")
        outputs.append_runs(monitor.with_throughput(df, 1000), path)
    runs = outputs.read_runs(spark, path)
    assert runs.filter("commit = 'c1'").select(F.round("gbps", 2)).first()[0] == 4.38
    got = {r.branch: r for r in monitor.bench_compare(runs).collect()}
    assert (got["main"].latest_commit, got["main"].best_commit, got["main"].runs) == ("c2", "c1", 2)
    assert got["dev"].latest_vs_best == 1.0


def test_megabits(spark):
    assert spark.range(1).select(mbps(F.lit(1000), F.lit(1000)).alias("m")).first().m == 8.0
