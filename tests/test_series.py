"""Series operators in cells and blocks, against loops."""

import datetime
import random

import pytest

from textloom.operators import evaluation, series


@pytest.fixture
def rows(spark):
    draw = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    out, at = [], 0
    for i in range(600):
        at += draw.choice([0, 0, 1, 5, 40])
        name = "busy" if i % 3 else draw.choice(["a", "b", None])
        out.append((name, i, i, start + datetime.timedelta(seconds=at), draw.choice([None, 4.0, 9.0]) if i % 50 == 7 else float(draw.randrange(30))))
    return out


def own(rows, name):
    return [r for r in rows if r[0] == name]


@pytest.fixture
def df(spark, rows):
    return spark.createDataFrame(rows, "series string, step long, seq long, ts timestamp, value double").repartition(6)


def test_loss_spikes(df, rows, monkeypatch):
    monkeypatch.setattr(series, "BLOCK_ROWS", 25)
    found = {r.step: r.spike for r in evaluation.loss_spikes(df.filter("series IS NOT NULL AND value IS NOT NULL"), 10, 1.5).collect()}
    for name in ("busy", "a", "b"):
        mine = [r for r in own(rows, name) if r[4] is not None]
        for i, r in enumerate(mine):
            last = [x[4] for x in mine[max(0, i - 9) : i + 1]]
            assert found[r[1]] == (len(last) == 10 and r[4] > 1.5 * sum(last) / 10)


@pytest.mark.parametrize("delta", [0.0, 2.0])
def test_early_stopping(df, rows, delta):
    found = {r.step: (r.bad, r.stop) for r in evaluation.early_stopping(df.filter("series IS NOT NULL AND value IS NOT NULL"), 5, delta).collect()}
    for name in ("busy", "a", "b"):
        best, bad = float("inf"), 0
        for r in own(rows, name):
            if r[4] is None:
                continue
            best, bad = (r[4], 0) if r[4] < best - delta else (best, bad + 1)
            assert found[r[1]] == (bad, bad >= 5)


def test_growth(df, rows, monkeypatch):
    monkeypatch.setattr(series, "BLOCK_ROWS", 7)
    found = {r.seq: r.rate for r in evaluation.growth(df.filter("series IS NOT NULL AND value IS NOT NULL")).collect()}
    for name in ("busy", "a", "b"):
        mine = [r for r in own(rows, name) if r[4] is not None]
        for before, r in zip([None, *mine], mine):
            wanted = None if before is None else (r[4] - before[4]) / max(1.0, (r[3] - before[3]).total_seconds())
            assert found[r[2]] == (wanted if wanted is None else pytest.approx(wanted))


def test_rolling_count(df, rows):
    found = {r.seq: r.n_recent for r in evaluation.rolling_count(df.filter("series IS NOT NULL"), 60).collect()}
    for name in ("busy", "a", "b"):
        mine = own(rows, name)
        for r in mine:
            assert found[r[2]] == sum(0 <= (r[3] - x[3]).total_seconds() <= 60 for x in mine)


def test_loss_spikes_without_a_series_and_with_repeated_steps(spark, monkeypatch):
    monkeypatch.setattr(series, "BLOCK_ROWS", 10)
    values = [float(1 + i // 7 % 5) for i in range(70)]
    data = [(name, i // 7, v) for name in (None, "a") for i, v in enumerate(values)]
    found = evaluation.loss_spikes(spark.createDataFrame(data, "series string, step long, value double"), 10, 1.5).collect()
    wanted = sorted((name or "", i // 7, i >= 9 and v > 1.5 * sum(values[i - 9 : i + 1]) / 10) for name in (None, "a") for i, v in enumerate(values))
    assert sorted((r.series or "", r.step, r.spike) for r in found) == wanted


def test_a_mean_is_rounded_as_the_sql_rounds_it(spark, monkeypatch):
    """Of values that are exactly twice the mean, rounding alone says which is over it."""
    import duckdb

    monkeypatch.setattr(series, "BLOCK_ROWS", 1_000)
    draw, values = random.Random(5), []
    while len(values) < 6_000:
        values.append(draw.randrange(1, 12_000))
        rest = sum(values[-99:])
        if len(values) >= 99 and rest % 49 == 0:  # 100 x = 2 (rest + x)
            values.append(rest // 49)
    rows = [("a" if i % 7 else "b", i, v / 100) for i, v in enumerate(values)]
    rows += [("c", i, v / 100) for i, v in enumerate(values)] + [(None, i, None if i % 50 == 0 else v / 10) for i, v in enumerate(values[:1000])]
    con = duckdb.connect()
    con.execute("CREATE TABLE s (series VARCHAR, step BIGINT, value DOUBLE)")
    con.executemany("INSERT INTO s VALUES (?, ?, ?)", rows)
    frame = spark.createDataFrame(rows, "series string, step long, value double").repartition(5)
    for window in (100, 300):
        w = f"OVER (PARTITION BY series ORDER BY step ROWS {window - 1} PRECEDING)"
        # One series at a time: DuckDB may put series together, and then adds up from another place in those that come second.
        sql = f"SELECT series, step, avg(value) {w}, value > 2.0 * avg(value) {w} AND count(*) {w} = {window} FROM s WHERE series IS NOT DISTINCT FROM ?"
        wanted = [r for name in ("a", "b", "c", None) for r in con.execute(sql, [name]).fetchall()]
        found = [(r.series, r.step, r.mean, r.spike) for r in evaluation.loss_spikes(frame, window).collect()]
        order = lambda r: (r[0] or "", r[1])
        assert sorted(found, key=order) == sorted(wanted, key=order)
