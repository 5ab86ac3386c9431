"""Labels, folds, sources, signals and back-tests."""

import datetime as dt
import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantpanel.catalog import relations
from quantpanel.operators import backtest, forest, labels, modelling, partitioning, signals
from quantpanel.operators.quantiles import exact_quantiles, pooled_quantiles
from quantpanel.plans.loader import BinaryLabelTransform, DataLoader, NaryLabelTransform, PurgedTimeSeriesPartition, TechnicalCovariateTransform
from quantpanel.sources import files
from quantpanel.streaming.bars import event_bars, write_bars

DAY = dt.date(2020, 1, 1)
DATA = "/root/testdata/sf0.001"


def panel(spark, sizes, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(t, DAY + dt.timedelta(i), float(100 + rng.normal()), 101.0 + rng.random(), 98.0, 10.0) for t, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, dates date, px_last double, px_high double, px_low double, px_volume double")


def test_folds_are_purged(spark):
    folds = partitioning.purged_folds(panel(spark, {"short": 302, "long": 303}), 5, 504, 60, 2)
    assert {r.ticker for r in folds.select("ticker").distinct().collect()} == {"long"}
    ends = folds.groupBy("fold", "role").agg(F.min("dates").alias("a"), F.max("dates").alias("b"), F.count("*").alias("n")).collect()
    by = {(r.fold, r.role): r for r in ends}
    for k in range(5):
        assert by[k, "test"].n == 60 and (by[k, "test"].a - by[k, "train"].b).days == 3
    plan = folds._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_fold_arguments():
    with pytest.raises(ValueError):
        PurgedTimeSeriesPartition(n_splits=1)
    with pytest.raises(ValueError):
        PurgedTimeSeriesPartition(test_size=0)


def test_walk_forward_members(spark):
    p = panel(spark, {"a": 12, "b": 12}).where("not (ticker = 'b' and dates = '2020-01-05')")
    found = {(r.window_id, r.ticker) for r in partitioning.walk_forward(p, 3, 1).collect()}
    assert found == {(i, "a") for i in range(3, 12)} | {(3, "b")} | {(i, "b") for i in range(8, 12)}
    rows = partitioning.window_rows(p, spark.createDataFrame([(8, "b")], "window_id int, ticker string"), 3, 1).collect()
    assert sorted((r.dates.day, r.role) for r in rows) == [(6, "train"), (7, "train"), (8, "train"), (9, "test")]


def test_quantile_labels_like_qcut(spark):
    rng = np.random.default_rng(0)
    rows = [(str(i), DAY + dt.timedelta(d), float(v)) for d in range(4) for i, v in enumerate(rng.integers(0, 9 if d else 2, 30))]
    df = spark.createDataFrame(rows, "ticker string, dates date, x double")
    got = {(r.ticker, r.dates): r.label for r in labels.nary_label(df, "x", 5).collect()}
    for d, g in pd.DataFrame(rows, columns=["t", "d", "x"]).groupby("d"):
        bins = pd.qcut(g.x, 5, labels=False, duplicates="drop")
        assert [got[t, d] for t in g.t] == list(bins.max() + 1 - bins)


def test_labels_per_fold_and_facade(spark):
    p = panel(spark, {t: 120 for t in "abcd"})
    index = p.where("ticker = 'a'").select("dates", "px_last")
    kinds = ((BinaryLabelTransform, {"index": index, "label_duration": 5, "quantile": 0.75}), (NaryLabelTransform, {"index": index, "label_duration": 5, "n_labels": 2}))
    for kind in kinds:
        loader = DataLoader(p, [(TechnicalCovariateTransform, {"sma": [5], "ema": [5], "mean_change": True})], [kind], ["px_low"], PurgedTimeSeriesPartition, {"n_splits": 3, "test_size": 20, "gap": 2}, label_per_partition=True)
        folds = loader.get_cv_folds()
        assert {"sma_5", "ema_5", "mean_change", "label", "fold", "role"} <= set(folds.columns) and "px_low" not in folds.columns
        assert folds.where("fold = 0 and role = 'test'").count() == 80


def test_duplicate_index_dates_raise(spark):
    p = panel(spark, {"a": 30})
    index = p.select("dates", "px_last")
    with pytest.raises(Exception, match="date twice"):
        labels.excess_returns(p, index.union(index), 5).collect()


def test_regimes(spark):
    assert list(labels.extend_labels([np.nan, 1, 0, 3, 3, 0, 2, 1, 0, 0, 1])) == [0, 1, 1, 1, 1, 0, -1, -1, -1, -1, 1]
    rng = np.random.default_rng(2)
    calm, wild = rng.normal(0, 0.005, 300), rng.normal(0, 0.05, 300)
    state = labels.markov_states(np.concatenate([calm, wild]))
    assert state[:300].mean() < 0.1 and state[300:].mean() > 0.9
    prices = 100 * np.exp(np.cumsum(np.concatenate([calm, wild])))
    index = spark.createDataFrame([(DAY + dt.timedelta(i), float(x)) for i, x in enumerate(prices)], "dates date, px_last double")
    assert set(labels.regimes(index).toPandas().regime_label.dropna()) <= {-1.0, 0.0, 1.0}


def test_wide_file(spark, tmp_path):
    (tmp_path / "wide.csv").write_text(
        "note,,,,,,,\n,IDX:X,,AB US:Y,,CD Z:W,,AB again:Q\nskip,,,,,,,\nDates,PX_LAST,PX_VOLUME,PX_LAST,PX_VOLUME,PX_LAST,PX_VOLUME,PX_LAST\n"
        "2020-01-02,1,2,3,4,#NAME?,6,7\nnot a date,1,2,3,4,5,6,7\n2020-01-03,1,2,,,5.5,,8\n"
    )
    rows = files.read_wide_panel(spark, str(tmp_path / "wide.csv")).orderBy("ticker", "dates").collect()
    assert [(r.ticker, r.dates.day, r.px_last, r.px_volume) for r in rows] == [("AB", 2, 3.0, 4.0), ("CD", 2, None, 6.0), ("CD", 3, 5.5, None)]
    kept = files.read_wide_panel(spark, str(tmp_path / "wide.csv"), first_block="keep")
    assert kept.where("ticker like 'IDX%'").count() == 2


def test_other_files(spark, tmp_path):
    (tmp_path / "i.csv").write_text("# c\n Dates , PX_LAST\n02.01.20, 5\n2020-01-03,6\nbad,7\n")
    assert [tuple(r) for r in files.read_index_tolerant(spark, str(tmp_path / "i.csv")).collect()] == [(dt.date(2020, 1, 2), 5.0), (dt.date(2020, 1, 3), 6.0)]
    (tmp_path / "p.csv").write_text("TickerIndex,DateIndex,pred_class\na,2020-01-02,4\n")
    assert files.read_predictions(spark, str(tmp_path / "p.csv")).first().asDict() == {"ticker": "a", "dates": dt.date(2020, 1, 2), "predicted_class": 4}
    made = spark.createDataFrame([("a", 1), ("b", 2)], "ticker string, window_id int")
    for _ in range(2):
        files.write_predictions(made, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


@pytest.mark.parametrize("start", [dt.date(2024, 1, d) for d in range(1, 9)])
def test_business_days(spark, start):
    made = spark.range(1).select(*(signals.business_days_after(F.lit(start), n).alias(str(n)) for n in (0, 1, 4, 5, 20))).first()
    for n in (0, 1, 4, 5, 20):
        expected = start + pd.offsets.BDay(n) if n or start.weekday() < 5 else start + dt.timedelta(7 - start.weekday())
        assert made[str(n)] == pd.Timestamp(expected).date()


def test_backtest_plans_agree(spark):
    p = panel(spark, {t: 90 for t in "abcdef"}, seed=4).where("dayofweek(dates) between 2 and 6")
    index = p.where("ticker = 'a'").select("dates", (F.col("px_last") * 2).alias("px_last"))
    chosen = p.where("dates < '2020-02-20' and px_last > 100.3").select("ticker", "dates", "px_last")
    one, two = (backtest.run_backtest(chosen, p, index, 1e6, 1e3, 5, 3, plan=x).orderBy("dates").toPandas() for x in ("unconstrained", "constrained"))
    assert len(one) and np.allclose(one.drop(columns="dates"), two.drop(columns="dates"))
    rows = backtest.trades(chosen, p, index, 1e3, 5, 3)
    assert one.cum_realized_pnl.iloc[-1] == pytest.approx(rows.agg(F.sum("profit")).first()[0])
    tight = backtest.run_backtest(chosen, p, index, 5e3, 1e3, 5, 3).toPandas()
    assert tight.invested_value.max() <= 5.2e3 and (tight.cash > -1e-6).all()
    assert backtest.run_backtest(chosen.where("false"), p, index).count() == 0


def test_repeated_signals_are_positions_of_their_own(spark):
    p = panel(spark, {t: 90 for t in "ab"}, seed=4).where("dayofweek(dates) between 2 and 6")
    index = p.where("ticker = 'a'").select("dates", (F.col("px_last") * 2).alias("px_last"))
    chosen = p.where("dates < '2020-02-10' and px_last > 100.3").select("ticker", "dates", "px_last")
    once, twice = (backtest.run_backtest(x, p, index, 1e6, 1e3, 5, 3).orderBy("dates").toPandas() for x in (chosen, chosen.unionByName(chosen)))
    assert np.allclose(2 * once.cum_realized_pnl, twice.cum_realized_pnl) and np.allclose(2 * once.invested_value, twice.invested_value)
    rows = backtest.trades(chosen.unionByName(chosen), p, index, 1e3, 5, 3)
    assert rows.count() == 2 * chosen.count() == rows.select("trade_id").distinct().count()


def test_folds_keep_all_columns(spark):
    p = panel(spark, {"a": 60}).withColumn("_own", F.lit(1)).withColumn("fold", F.lit(99)).withColumn("role", F.lit("x"))
    made = partitioning.purged_folds(p, 2, 20, 10, 1)
    assert [c for c in made.columns if c in ("_own", "fold", "role")] == ["_own", "fold", "role"] and made.where("fold = 99").count() == 0


def test_two_digit_years(spark):
    days = spark.createDataFrame([("1.2.95", dt.date(1995, 2, 1)), ("31.12.69", dt.date(1969, 12, 31)), ("5.6.07", dt.date(2007, 6, 5)), ("29.2.96", dt.date(1996, 2, 29)), ("x", None)], "t string, d date")
    assert days.where(~files.parse_date(F.col("t"), ("d.M.yy", "yyyy-MM-dd")).eqNullSafe(F.col("d"))).count() == 0


def test_benchmark(spark):
    log = spark.createDataFrame([(DAY + dt.timedelta(i),) for i in range(4)], "dates date")
    index = spark.createDataFrame([(DAY + dt.timedelta(1), 50.0), (DAY + dt.timedelta(3), 75.0)], "dates date, px_last double")
    assert [r.index_value for r in backtest.benchmark(log, index, 100.0).orderBy("dates").collect()] == [None, 100.0, 100.0, 150.0]


def test_stream_of_bars(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i // 4, i % 4), "k", float(i)) for i in range(16)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    write_bars(stream, str(tmp_path / "out"), str(tmp_path / "cp"), late="1 hour").awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.exceptAll(event_bars(events)).count() == 0 and out.count() == 3


@pytest.mark.parametrize("n_valid", [1, 3])
def test_walk_forward_training_predicts_each_date_once(spark, n_valid):
    p = panel(spark, {"a": 60, "b": 60, "c": 59}).select("ticker", "dates", F.lit(1.0).alias("f"), F.when(F.col("ticker") != "a", F.lit(None)).otherwise(1.0).alias("g"), "px_last")
    made = modelling.walk_forward_train(p, ["f", "g"], "px_last", 20, n_valid, full_attendance=False, trees=3).toPandas()
    assert not made.duplicated(["ticker", "dates"]).any() and len(made) == 40 + 40 + 39
    rows = p.toPandas()
    for r in made.itertuples():
        place = (r.dates - DAY).days
        assert r.window_id == 20 + (place - 20) // n_valid * n_valid
        seen = rows[(rows.dates >= DAY + dt.timedelta(r.window_id - 20)) & (rows.dates < DAY + dt.timedelta(r.window_id))].px_last  # one leaf: the feature is constant
        assert np.allclose([r.q10, r.q50, r.q90], np.quantile(np.tile(seen, 3), [0.1, 0.5, 0.9]))
    full = modelling.walk_forward_train(p.where("not (ticker = 'b' and dates = '2020-01-25')"), ["f"], "px_last", 20, 1, trees=3).toPandas()
    assert {(r.window_id, r.ticker) for r in full.itertuples()} == {(i, "a") for i in range(20, 60)} | {(i, "c") for i in range(20, 59)} | {(i, "b") for i in (*range(20, 24), *range(45, 60))}


def test_forest_finds_the_split():
    rng = np.random.default_rng(3)
    x = rng.random((400, 2))
    y = np.where(x[:, 1] > 0.5, 10.0, 0.0) + rng.random(400)
    q = forest.predict_quantiles(x, y, np.array([[0.5, 0.1], [0.5, 0.9]]), [0.5], trees=20, depth=4, least=1, share=1.0, seed=[1])
    assert 0 < q[0, 0] < 1 and 10 < q[1, 0] < 11


@pytest.mark.parametrize("wide, least, share, depth", [(1, 1, 1.0, 4), (2, 5, 0.5, 5), (3, 1, 0.9, 9), (3, 3, 0.3, 7)])
def test_forest_by_boxes_is_the_forest_by_rows(wide, least, share, depth):
    rng = np.random.default_rng(wide + depth)
    x = np.round(rng.normal(size=(900, wide)), 1)  # with ties
    x[:, 0] = np.round(x[:, 0])  # few bins
    rows = forest.Rows(x, x.sum(axis=1) + rng.normal(size=900), 5, rng)
    member = np.arange(900) % 7 != 3
    order = rng.permutation(int(member.sum()))
    made = [list(forest.grow(rows, member, order, x[~member], depth, least, share, np.random.default_rng(1), by=by)) for by in (forest.ByRows, forest.ByBoxes)]
    for one, other in zip(*made, strict=True):
        assert (one[0] == other[0]).all() and (one[1] == other[1]).all() and len(np.unique(one[0])) > 4


@pytest.mark.parametrize("n, depth", [(1, 3), (7, 2), (3000, 4), (3000, 10)])
def test_forest_quantiles_are_those_of_all_targets_in_the_leaves(monkeypatch, n, depth):
    monkeypatch.setattr(forest, "HELD", 30_000)  # several steps
    rng = np.random.default_rng(n)
    x, new = np.round(rng.normal(size=(n, 2)), 2), rng.normal(size=(200, 2))
    rows = forest.Rows(x, np.round(x[:, 0] + rng.normal(size=n), 2), 7, rng)
    member = rng.random(n) < 0.8 if n > 10 else np.ones(n, bool)
    q = [0.0, 0.1, 0.5, 0.9, 1.0]
    found = forest.pooled(rows, member, new, q, depth, 1, 0.9, np.random.default_rng(2))
    y = rows.y[member]
    leaves = list(forest.grow(rows, member, np.arange(len(y)), new, depth, 1, 0.9, np.random.default_rng(2)))
    for i, got in enumerate(found):
        assert np.allclose(got, np.quantile(np.concatenate([y[own == ours[i]] for own, ours in leaves]), q))


def test_forest_with_many_rows_to_predict_takes_little_more_time():
    """Each row's quantiles took a pass over all rows of the window."""
    rng = np.random.default_rng(5)
    x, new = rng.normal(size=(60_000, 3)), rng.normal(size=(8_000, 3))
    y = x[:, 0] + rng.normal(size=60_000)

    def took(n: int) -> float:
        began = time.process_time()
        forest.predict_quantiles(x, y, new[:n], [0.1, 0.5, 0.9], trees=20, depth=7, least=1, share=0.9, seed=[1])
        return time.process_time() - began

    assert min(took(8_000) for _ in range(3)) < 4 * min(took(20) for _ in range(3))


def test_walk_forward_query_has_every_window(spark, tmp_path):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    spark.read.parquet(f"{DATA}/lineitem.parquet").where("l_shipdate < '1996-03-21'").write.parquet(f"{tmp_path}/lineitem.parquet")
    os.symlink(f"{DATA}/orders.parquet", f"{tmp_path}/orders.parquet")
    dates = sorted(r.dates for r in relations.load_bars(spark, str(tmp_path)).select("dates").distinct().collect())
    made = relations.walk_forward_predictions(spark, str(tmp_path)).toPandas()
    assert len(dates) > 300 and not made.duplicated(["ticker", "dates"]).any()
    assert all(dates[w] == d for w, d in zip(made.window_id, made.dates, strict=True))
    with_rows = relations.technical(relations.load_bars(spark, str(tmp_path)), roc=[10], volatility=[20], price_vs_sma=[20]).na.drop("any", subset=relations.FEATURES)
    assert set(made.dates) == {r.dates for r in with_rows.select("dates").distinct().collect()} & set(dates[252:])


def test_rules_take_their_sides(spark):
    """The query's predictions are symmetric, so its skewness is 0: here are some that are not."""
    rows = [(-1.0, 1.0, 1.5, 4), (1.0, 2.0, 4.0, 3), (-9.0, 5.0, 40.0, 4), (-4.0, -3.0, 1.0, 0), (2.0, 2.0, 2.0, None)]
    made = spark.createDataFrame(rows, "q10 double, q50 double, q90 double, predicted_class int")
    found = made.agg(*(F.count(F.when(rule(), 1)).alias(n) for n, rule in signals.RULES.items()), F.count(F.when(signals.rule_class(), 1)).alias("class")).first().asDict()
    assert found == {"sharpe": 2, "skewness": 3, "spread": 1, "floor": 3, "combined": 1, "class": 2}


def test_sweep(spark):
    folds = partitioning.purged_folds(panel(spark, {"a": 30}), 3, 10, 5, 1)
    seen = []

    def score(train, test, parameters):
        seen.append((parameters["k"], train.count(), test.agg(F.min("dates")).first()[0]))
        return parameters["k"] * (1 + len(seen) % 3)

    found = modelling.sweep(folds, score, {"k": [1, 2, 3], "other": ["x"]}, trials=4)
    assert len(found) == 4 and [s for _, s in found] == sorted(s for _, s in found)
    assert all(s == pytest.approx(2 * p["k"]) and p["other"] == "x" for p, s in found)
    assert len(seen) == 12 and [d for *_, d in seen[:3]] == [DAY + dt.timedelta(i) for i in (15, 20, 25)] and {n for _, n, _ in seen} == {10}


@pytest.mark.parametrize("kind", ["normal", "ties", "skewed", "signs"])
def test_quantiles_of_a_column_that_is_read_in_parts(spark, kind):
    rng = np.random.default_rng(1)
    y = {"normal": rng.normal(size=30_000), "ties": np.round(rng.normal(size=30_000)), "skewed": np.exp(20 * rng.normal(size=30_000)), "signs": rng.choice([-0.0, 0.0, 1e-300, -5.0, 7.5], 30_000)}[kind]
    rows = spark.createDataFrame(pd.DataFrame({"y": y})).unionByName(spark.createDataFrame([(None,)] * 5, "y double"))
    shares = [0.0, 0.2, 0.37, 0.5, 0.75, 0.999, 1.0]
    expected = list(rows.agg(F.percentile("y", F.array(*map(F.lit, shares)))).first()[0])
    assert exact_quantiles(rows, "y", shares, at_once=50) == expected == exact_quantiles(rows, "y", shares)
    assert exact_quantiles(rows.where("y is null"), "y", shares) is None


def test_whole_table_quantiles_do_not_meet_in_one_task(spark):
    """One percentile() over a table gathers all its values in one task."""
    rows = panel(spark, {"a": 50, "b": 50})
    for made in (modelling.quantile_bins(rows, "px_last"), labels.binary_label(rows, "px_last", 0.75, per_date=False)):
        assert "percentile" not in made._jdf.queryExecution().toString()
    assert modelling.quantile_bins(rows, "px_last").groupBy("bin").count().orderBy("bin").toPandas()["count"].tolist() == [20] * 5


@pytest.mark.parametrize("ties", [False, True])
def test_pooled_quantiles_of_leaves(spark, ties):
    rng = np.random.default_rng(3)
    y = np.round(rng.normal(size=4000)) if ties else rng.normal(size=4000)
    have = rng.integers(0, 4, (4000, 5))
    want = have[:300]
    leaves = spark.createDataFrame(pd.DataFrame({"leaf": have.tolist(), "y": y}), "leaf array<int>, y double")
    wanted = spark.createDataFrame(pd.DataFrame({"leaf": want.tolist()}), "leaf array<int>")
    made = {tuple(r.leaf): (r.q0, r.q1, r.q2) for r in pooled_quantiles(leaves, wanted, (0.1, 0.5, 0.9), (5, 4)).collect()}
    assert set(made) == set(map(tuple, want.tolist()))
    for leaf, found in made.items():
        pool = np.concatenate([y[have[:, t] == k] for t, k in enumerate(leaf)])
        assert np.allclose(found, np.quantile(pool, [0.1, 0.5, 0.9]))


def test_forest_sends_no_targets_to_rows(spark):
    """A row's answer does not carry the targets of its leaves: with 16,000 of them a leaf these filled the disk."""
    rows = panel(spark, {"a": 300, "b": 300})
    model = modelling.fit_quantile_forest(rows, ["px_volume", "px_high"], "px_last", trees=3, depth=3)
    made = model.predict(rows, ["ticker", "dates"])
    assert "collect_list" not in made._jdf.queryExecution().toString() and made.count() == 600
    held = modelling._leaves(model.forest, modelling.assemble(rows, model.features)).toPandas()
    leaf = np.stack(held["_leaf"])
    found = held.merge(made.toPandas(), on=["ticker", "dates"])
    for i in range(0, 600, 37):
        pool = np.concatenate([held["px_last"][leaf[:, t] == leaf[i, t]] for t in range(3)])
        assert np.allclose(found.loc[i, ["q10", "q50", "q90"]].to_numpy(float), np.quantile(pool, [0.1, 0.5, 0.9]))


def test_roles_of_a_row(spark):
    p = panel(spark, {"a": 60, "b": 60, "c": 10})
    placed, folds = partitioning.purged_roles(p, 3, 20, 10, 1), partitioning.purged_folds(p, 3, 20, 10, 1)
    for k in range(3):
        for role in ("train", "test"):
            one, two = partitioning.role_rows(placed, k, role), partitioning.fold_part(folds, k, role)
            assert one.columns == two.columns and one.count() == two.count() and one.exceptAll(two).count() == 0


def test_wide_file_line_by_line(spark, tmp_path, monkeypatch):
    """Many columns make a plan that does not end; a ticker's cells of each line were looked up one by one."""
    p = panel(spark, {f"t{i}": 1 + i % 3 for i in range(40)}).withColumn("px_volume", F.when(F.dayofmonth("dates") != 2, F.col("px_volume")))
    files.write_wide_panel(p, str(tmp_path / "made"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "made")).collect()]
    assert {line.count(",") for line in lines if line[:1].isdigit()} == {80} and len(lines) == 7
    (tmp_path / "odd.csv").write_text(
        "note\n,IDX:X,,AB US:Y,,CD Z:W,,AB again:Q\nskip\nDates,PX_LAST,PX_VOLUME,PX_LAST,PX_VOLUME,PX_LAST,PX_VOLUME,PX_LAST\n"
        '2020-01-02,1,2,3,4,#NAME?,6,7\nnot a date,1,2,3,4,5,6,7\n"2020-01-03",1,"2",,,5.5,,8\n2020-01-04,"1,5",2,3\n2020-01-05,1,2,x,,,\n'
    )
    for path in ("made", "odd.csv"):
        made = []
        for wide in (10**6, 1):
            monkeypatch.setattr(files, "WIDE", wide)
            made.append(files.read_wide_panel(spark, str(tmp_path / path), first_block="keep"))
        one, two = made
        assert one.schema.simpleString() == two.schema.simpleString() and one.count() == two.count() > 0 and one.exceptAll(two).count() == 0
    assert files.read_wide_panel(spark, str(tmp_path / "made"), first_block="keep").exceptAll(p.select("ticker", "dates", "px_last", "px_volume")).count() == 0
