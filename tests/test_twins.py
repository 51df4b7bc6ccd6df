"""Operators against plain loops, pandas or numpy, on small cases with known answers."""

from __future__ import annotations

import datetime as dt
import math
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcraft.functions import calendar as cal
from panelcraft.functions import normal as N
from panelcraft.functions.ema import span, wilder, with_ema
from panelcraft.functions.symbols import canonical
from panelcraft.operators import asof as A
from panelcraft.operators import carry as C
from panelcraft.operators import crossval as CV
from panelcraft.operators import features as FT
from panelcraft.operators import options as O
from panelcraft.operators import panel as P
from panelcraft.operators import portfolio as PF
from panelcraft.operators import regression as RG
from panelcraft.operators import scoring as S
from panelcraft.operators import signals as SG
from panelcraft.operators import trials as TR
from panelcraft.operators import validate as V
from panelcraft.sources import landed as L
from panelcraft.streaming import jobs as J

DAY = dt.date(2017, 3, 13)  # a Monday


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# ---- expressions ----------------------------------------------------------------------------------


def test_week_end_is_sunday(spark):
    for d, want in (("2020-01-06", "2020-01-12"), ("2020-01-12", "2020-01-12"), ("2020-01-11", "2020-01-12")):
        assert str(one(spark, cal.week_end(F.lit(d).cast("date")))[0]) == want


def test_epoch_guard_rejects_seconds(spark):
    assert one(spark, cal.mixed_epoch_ms(F.lit("1700000000000000")))[0] == 1_700_000_000_000
    with pytest.raises(Exception, match="not an epoch"):
        one(spark, cal.ms_to_ts(F.lit(1_700_000_000)))


@pytest.mark.parametrize("name,base", [("BTCUSDT", "BTC"), ("BTC-USDT-SWAP", "BTC"), ("BTC", "BTC"), ("BTCBUSD", "BTC"), ("USDT", "USDT")])
def test_canonical_names(spark, name, base):
    assert one(spark, canonical(F.lit(name)))[0] == base


def test_normal_distribution(spark):
    for x in (-6.0, -1.5, 0.0, 0.3, 2.0, 7.5, 9.0):
        got = one(spark, N.phi(F.lit(x)))[0]
        assert got == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), abs=1e-14)
    assert one(spark, N.phi_inv(F.lit(0.975)))[0] == pytest.approx(1.959964, abs=1e-6)


def test_deflated_sharpe_published_value(spark):
    args = [F.lit(v) for v in (1.5, 60, -0.5, 5.0, 0.4, 30)]
    assert one(spark, N.dsr(*args))[0] == pytest.approx(0.766, abs=1e-3)


# ---- windows --------------------------------------------------------------------------------------


def test_recursive_average_equals_recursion(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000).cumsum() + 50
    x[[0, 1, 7, 900]] = np.nan
    pdf = pd.DataFrame({"k": "a", "i": range(3000), "x": x})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = with_ema(df, {"e": span("x", 26), "w": wilder("x", 14)}, ["k"], "i").orderBy("i").toPandas()
    for column, alpha, least in (("e", 2 / 27, 26), ("w", 1 / 14, 14)):
        want = pdf["x"].ewm(alpha=alpha, adjust=False, ignore_na=True, min_periods=least).mean().where(pdf["x"].notna())
        np.testing.assert_allclose(got[column].to_numpy(dtype=float), want.to_numpy(), rtol=1e-11)


def sample_bars(n: int = 300):
    rng = np.random.default_rng(17)
    close = 40 * np.exp(np.cumsum(rng.normal(0.0005, 0.025, n)))
    reach = rng.uniform(0.001, 0.03, (2, n))
    return pd.DataFrame({
        "symbol": "AAA", "date": pd.date_range(DAY, periods=n).date, "close": close, "high": close * (1 + reach[0]), "low": close * (1 - reach[1]),
        "dollar_volume": rng.lognormal(13, 0.6, n),
    })


def test_features_do_not_look_ahead(spark):
    pdf = sample_bars()
    full = FT.daily_features(spark.createDataFrame(pdf)).orderBy("date").toPandas().head(240)
    cut = FT.daily_features(spark.createDataFrame(pdf.head(240))).orderBy("date").toPandas()
    np.testing.assert_allclose(full[list(FT.SIGNALS)].to_numpy(float), cut[list(FT.SIGNALS)].to_numpy(float), rtol=1e-9)
    assert cut["sma_200d"].notna().sum() == 41 and cut["macd_diff_signal"].notna().sum() == 240 - 33


def test_ordered_pass_equals_windows(spark):
    """Keys of 1 to 300 rows with gaps, a constant series, zero volume and infinite prices, in batches far shorter than a key."""
    frames, rng = [], np.random.default_rng(5)
    for k, n in enumerate((1, 14, 15, 40, 300, 33, 120)):
        rows = sample_bars(300).head(n).assign(symbol=f"S{k}")
        if k % 2:
            rows.loc[rng.random(n) < 0.15, ["close", "dollar_volume"]] = np.nan
        frames.append(rows)
    frames[3]["close"], frames[6]["dollar_volume"] = 25.0, 0.0
    frames[2].loc[13:, "close"] = np.inf
    pdf = pd.concat(frames)
    bars = spark.createDataFrame(pdf).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("close", "dollar_volume")})
    names = ["macd", "macd_diff_signal", "volmacd", "volmacd_diff_signal", "rsi", "stochRSI"]
    finite = bars.where("symbol <> 'S2'")
    want = FT.relative_strength(FT.oscillators(finite)).select("symbol", "date", *names).orderBy("symbol", "date").toPandas()
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "7")
    try:
        got = FT.daily_features(bars).where("symbol <> 'S2'").select("symbol", "date", *names).orderBy("symbol", "date").toPandas()
    finally:
        spark.conf.set(setting, before)
    assert want["rsi"].notna().sum() > 200 and (want["rsi"] == 100.0).any() and want["volmacd"].notna().any()
    np.testing.assert_allclose(got[names].to_numpy(float), want[names].to_numpy(float), rtol=1e-8, atol=1e-11)
    assert FT.daily_features(bars.limit(0)).count() == 0


def test_daily_features_sort_once(spark):
    plan = FT.daily_features(spark.createDataFrame(sample_bars(30)))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Sort [") == 1 and plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_universe_does_not_look_ahead(spark):
    frames = [sample_bars().assign(symbol=s, dollar_volume=lambda d, k=k: d["dollar_volume"] * (1 + k + np.sin(np.arange(len(d)) * (k + 1)))) for k, s in enumerate("ABCD")]
    pdf = pd.concat(frames)
    keys = ["week_end", "symbol"]

    def flags(rows):
        out = P.liquid_universe(P.weekly_panel(spark.createDataFrame(rows)), top_n=2, min_history_weeks=3)
        return out.select(*keys, "eligible", "liquidity_rank").orderBy(*keys).toPandas()

    edge = DAY + dt.timedelta(days=7 * 20)
    a, b = flags(pdf), flags(pdf[pdf["date"] < edge])
    pd.testing.assert_frame_equal(a.merge(b[keys], on=keys), b)


def test_missing_week_breaks_return(spark):
    pdf = sample_bars(40)
    gone = (pdf["date"] >= DAY + dt.timedelta(days=14)) & (pdf["date"] < DAY + dt.timedelta(days=21))
    weeks = P.weekly_panel(spark.createDataFrame(pdf[~gone])).orderBy("week_end").collect()
    assert [w["gap_before"] for w in weeks] == [False, False, True, False, False]
    assert weeks[2]["weekly_return"] is None and weeks[1]["forward_return"] is None and weeks[3]["weekly_return"] is not None


# ---- joins ----------------------------------------------------------------------------------------


def test_asof_across_buckets_with_one_hot_key(spark):
    rng = np.random.default_rng(2)

    def side(n, step):
        keys = np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abc"), n))
        ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.choice(step * 4, n, replace=False), unit="min")
        return pd.DataFrame({"k": keys, "ts": ts, "v": rng.normal(size=n)})

    left, right = side(400, 5000).drop(columns="v").assign(id=range(400)), side(60, 5000)
    want = pd.merge_asof(left.sort_values("ts"), right.sort_values("ts"), on="ts", by="k", tolerance=pd.Timedelta(hours=30)).set_index("id")["v"].sort_index()
    l = spark.createDataFrame(left).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    r = spark.createDataFrame(right).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for rows in (7, 60, 1_000_000):  # 7: even the small keys are cut
        got = A.asof_backward(l, r, ["k"], "ts", ["v"], tolerance_hours=30, rows_per_bucket=rows).toPandas().set_index("id")["v"].sort_index()
        np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float))


def test_asof_many_sources_and_a_key_of_nine_tenths(spark):
    rng = np.random.default_rng(5)
    n = 6000
    minutes = np.sort(np.concatenate([rng.choice(2_000, 1_500, replace=False), 2_000_000 + rng.choice(900_000, n - 1_500, replace=False)]))  # a burst, then quiet
    pdf = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.9, "hot", rng.choice(list("abc"), n)), "ts": pd.Timestamp("2020-01-01") + pd.to_timedelta(minutes, unit="min"),
        "source": rng.choice(["event", "mark", "spot", "other"], n), "close": np.round(rng.normal(100, 5, n), 3), "id": range(n),
    })
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    edges = A.bucket_edges(df, ["k"], F.unix_micros(F.col("ts").cast("timestamp")), 500)
    sizes = df.join(edges, "k").groupBy(A.edge_bucket(F.col("_edges"), F.unix_micros(F.col("ts").cast("timestamp"))).alias("b")).count().toPandas()["count"]
    assert [r["k"] for r in edges.collect()] == ["hot"] and len(sizes) >= 10 and sizes.max() < 1.2 * sizes.mean()
    got = A.observations(df, ["k"], keep=["id"], tolerance_hours=48, rows_per_bucket=500).toPandas().set_index("id").sort_index()
    left = pdf[pdf.source == "event"][["k", "ts", "id"]]
    for name, kind in (("perp_close", "mark"), ("spot_close", "spot")):
        right = pdf[pdf.source == kind][["k", "ts", "close"]]
        want = pd.merge_asof(left, right, on="ts", by="k", tolerance=pd.Timedelta(hours=48)).set_index("id")["close"].sort_index()
        np.testing.assert_allclose(got[name].to_numpy(float), want.to_numpy(float))
    plan = A.observations(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "Join" not in plan


# ---- scoring --------------------------------------------------------------------------------------


def block_from_spectrum(x):
    """Block length from the circular spectrum of the padded series and symmetric flat-top weights."""
    n = len(x)
    if n < 11:
        return 1.0
    e = x - x.mean()
    power = np.abs(np.fft.rfft(e, 2 * n)) ** 2
    energy = np.concatenate([[0.0], np.cumsum(e**2)])
    run = max(5, int(math.log10(n)))
    lags = np.arange(math.ceil(math.sqrt(n)) + run + 1)
    cov = np.fft.irfft(power)[lags]
    corr = cov / np.sqrt((energy[n] - energy[lags + 1]) * energy[n - lags - 1])
    flat = np.lib.stride_tricks.sliding_window_view(np.abs(corr) < 2 * math.sqrt(math.log10(n) / n), run).all(axis=1)
    reach = min(2 * max(int(flat.argmax()), 1), lags[-1]) if flat.any() else lags[-1]
    around = np.abs(np.arange(-reach, reach + 1))
    weighted = np.clip(2 - 2 * around / reach, 0, 1) * cov[around]
    best = np.cbrt(n * ((around @ weighted) / weighted.sum()) ** 2)
    return min(best, math.ceil(min(3 * math.sqrt(n), n / 3)))


def ar_series(n, rho, seed):
    rng = np.random.default_rng(seed)
    x = np.zeros(n)
    for i in range(1, n):
        x[i] = rho * x[i - 1] + rng.normal()
    return x + 0.1


@pytest.mark.parametrize("chunk", [40, 4096])
def test_block_length_in_chunks(spark, chunk):
    data = {f"s{n}": ar_series(n, rho, n) for n, rho in ((8, 0.0), (30, 0.2), (211, 0.7), (800, 0.9))}
    pdf = pd.concat([pd.DataFrame({"series_id": k, "idx": range(len(v)), "ret": v}) for k, v in data.items()])
    got = S.block_lengths(spark.createDataFrame(pdf), chunk_rows=chunk).toPandas().set_index("series_id")["block"]
    for k, v in data.items():
        assert got[k] == pytest.approx(block_from_spectrum(v), rel=1e-8)


def test_constant_series_has_no_score(spark):
    pdf = pd.DataFrame({"series_id": "c", "idx": range(50), "ret": 0.5})
    row = S.score_series(spark.createDataFrame(pdf)).first()
    assert row["status"] == "zero_variance" and row["psr0"] is None
    assert S.block_lengths(spark.createDataFrame(pdf)).first()["block"] == 1.0


def test_splits_and_paths(spark):
    n = 47
    pdf = pd.DataFrame({"series_id": "s", "idx": range(n), "dt": [DAY + dt.timedelta(days=i) for i in range(n)], "ret": np.arange(n, dtype=float)})
    series = spark.createDataFrame(pdf)
    labels = CV.clipped_horizons(series, 3)
    roles = CV.combinatorial_splits(labels, horizon=3).toPandas()
    assert roles["split_id"].nunique() == 15 and len(roles) == 15 * n
    assert (roles.groupby("split_id")["role"].apply(lambda r: (r == "test").sum()) >= 2 * (n // 6)).all()
    groups = np.array_split(np.arange(n), 6)
    first = roles[roles["split_id"] == 0].set_index("idx")["role"]
    assert set(first[first == "test"].index) == set(groups[0]) | set(groups[1])
    paths = CV.split_paths(series).toPandas()
    assert (paths.groupby("path")["idx"].nunique() == n).all() and paths["path"].nunique() == 5
    joined = CV.test_series(series).toPandas()
    for split, rows in joined.groupby("split_id"):
        ordered = rows.sort_values("idx")
        assert list(ordered["idx"]) == list(range(len(rows))) and ordered["ret"].is_monotonic_increasing


# ---- portfolios -----------------------------------------------------------------------------------


def simulated(spark, pdf, cash_ret, rule, months, expense):
    assets = PF.complete_dates(spark.createDataFrame(pdf))
    cash = spark.createDataFrame(pd.DataFrame({"date": sorted(pdf["date"].unique()), "cash_ret": cash_ret}))
    return PF.simulate(assets, cash, PF.targets(PF.month_signals(assets, [months]), [rule]), expense).orderBy("date").toPandas()


def test_simulation_by_hand(spark):
    """Two months of history, then two held months: x is held at a half, y never."""
    days = [dt.date(2021, 1, 5), dt.date(2021, 2, 5), dt.date(2021, 3, 5), dt.date(2021, 3, 8), dt.date(2021, 4, 5)]
    pdf = pd.concat([
        pd.DataFrame({"asset": "x", "date": days, "ret": [0.0, 0.10, 0.10, -0.05, 0.02]}),
        pd.DataFrame({"asset": "y", "date": days, "ret": [0.0, -0.10, 0.0, 0.0, 0.0]}),
    ])
    fee, bill, cost = 0.001, 0.0002, 0.01
    got = simulated(spark, pdf, bill, PF.variant("v", 2, cost=cost), 2, fee)
    march = 1 - 0.5 * cost
    x1, c1 = march * 0.5 * 1.10 * (1 - fee), march * 0.5 * (1 + bill)
    x2, c2 = x1 * 0.95 * (1 - fee), c1 * (1 + bill)
    trade = abs(0.5 - x2 / (x2 + c2)) * cost * (x2 + c2)
    april = x2 + c2 - trade
    x3, c3 = april * 0.5 * 1.02 * (1 - fee), april * 0.5 * (1 + bill)
    np.testing.assert_allclose(got["wealth"], [x1 + c1, x2 + c2, x3 + c3], rtol=1e-13)
    np.testing.assert_allclose(got["cost_paid"], [0.5 * cost + march * 0.55 * fee, x1 * 0.95 * fee, trade + april * 0.51 * fee], rtol=1e-10)


def test_simulation_invariants(spark):
    """Wealth compounds the net returns, and in a market that stands still only costs leave the portfolio."""
    rng = np.random.default_rng(3)
    days = [DAY + dt.timedelta(days=i) for i in range(400)]
    moving = pd.concat([pd.DataFrame({"asset": a, "date": days, "ret": rng.normal(0.0003, 0.02, len(days))}) for a in "xyz"])
    got = simulated(spark, moving, 8e-5, PF.variant("v", 4), 4, 1e-5)
    np.testing.assert_allclose(got["wealth"], np.cumprod(1 + got["net_ret"]), rtol=1e-12)
    assert (got["cost_paid"] >= 0).all() and got["cost_paid"].sum() > 0
    still = simulated(spark, moving.assign(ret=0.0), 0.0, PF.variant("v", 4, always=True), 4, 1e-4)
    assert still["wealth"].iloc[-1] == pytest.approx(1 - still["cost_paid"].sum(), rel=1e-12) and len(still) > 200


def test_interval_series_conserve_net(spark):
    rng = np.random.default_rng(4)
    n = 60
    pdf = pd.DataFrame({
        "symbol": "S", "idx": range(n), "dt": [dt.datetime(2024, 1, 1) + dt.timedelta(hours=8 * i) for i in range(n)],
        "funding_rate": rng.normal(1e-4, 1e-4, n), "perp_close": 100 + rng.normal(size=n), "spot_close": 100 + rng.normal(size=n),
    })
    obs = spark.createDataFrame(pdf)
    priced = C.with_costs(C.trades(obs, (5,)))
    nets = C.strided(priced, 0).groupBy(*C.CELL).agg(F.sum("net").alias("net"))
    for amortise in (False, True):
        sums = C.interval_series(obs, priced, (5,), amortise).groupBy(*C.CELL).agg(F.sum("ret").alias("total"))
        both = nets.join(sums, list(C.CELL)).toPandas()
        np.testing.assert_allclose(both["net"], both["total"], atol=1e-14)
        assert len(both) == 8


def test_bad_trades_and_short_lists_raise(spark):
    def trade(underlying, hold):
        quote = {"instrument": "I1", "type": "call", "strike": 100.0, "bid": 0.05, "mark": 0.051, "delta": 0.5, "underlying": underlying, "terminal": 110.0, "hold_hours": hold}
        return O.short_trades(spark.createDataFrame([quote], "instrument string, type string, strike double, bid double, mark double, delta double, underlying double, terminal double, hold_hours double"))

    assert trade(100.0, 24.0).first()["payoff"] == pytest.approx(10 / 110)
    for underlying, hold in ((0.0, 24.0), (None, 24.0), (100.0, -1.0)):
        with pytest.raises(Exception, match="no trade"):
            trade(underlying, hold).collect()
    entries = spark.createDataFrame([("S", 3, i) for i in range(4)], "symbol string, horizon int, entry_idx long")
    assert C.random_entries(entries, 4, 1).count() == 4 and C.random_entries(entries, 25, 1, strict=False).count() == 4
    with pytest.raises(Exception, match="fewer entries"):
        C.random_entries(entries, 25, 1).collect()


def test_par_bond_duration(spark):
    pdf = pd.DataFrame({"date": [DAY, DAY + dt.timedelta(days=1)], "bond_yield": [0.05, 0.05]})
    row = PF.bond_returns(spark.createDataFrame(pdf)).first()
    assert row["duration"] == pytest.approx(7.7946, abs=1e-3) and row["bond_ret"] == pytest.approx(0.05 / 252)


def test_factor_regression_equals_dense(spark):
    rng = np.random.default_rng(5)
    n = 700
    f = rng.normal(0, 0.01, (n, 5))
    y = 0.0002 + f @ np.array([1.0, 0.1, -0.2, 0.3, 0.05]) + rng.normal(0, 0.002, n)
    pdf = pd.DataFrame(f, columns=list(RG.FACTORS)).assign(portfolio="p", rf=0.0001, date=[DAY + dt.timedelta(days=i) for i in range(n)])
    pdf["ret"] = y + pdf["rf"]
    x = np.column_stack([np.ones(n), f])
    solve, lag = np.linalg.pinv(x), max(1, int(4 * (n / 100) ** (2 / 9)))
    beta = solve @ y
    e = y - x @ beta
    place = np.arange(n)
    kernel = np.clip(1 - np.abs(place[:, None] - place) / (lag + 1), 0, None)
    t = beta[0] / math.sqrt((solve @ (kernel * np.outer(e, e)) @ solve.T)[0, 0])
    row = RG.factor_regression(spark.createDataFrame(pdf)).first()
    assert row["alpha"] == pytest.approx(beta[0], rel=1e-8) and row["alpha_t"] == pytest.approx(t, rel=1e-7)
    assert row["dominant_tilt"] == "rmw" and row["lag"] == lag


# ---- selection ------------------------------------------------------------------------------------


def test_selection_finds_planted_columns():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 10))
    y = 0.5 * x[:, 2] + 0.3 * x[:, 7] - 0.4 * x[:, 4] + rng.normal(0, 0.3, 600)
    x, y = (x - x.mean(0)) / x.std(0), y - y.mean()
    kept = SG.elastic_net_selection(600, x.T @ x, x.T @ y, y @ y)
    assert kept[2] and kept[7] and not kept[4]


def test_sparse_minimum_equals_coordinate_descent():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 3))
    x = base @ rng.normal(size=(3, 12)) + 0.5 * rng.normal(size=(300, 12))
    q, h, l1 = x.T @ (base[:, 0] + rng.normal(size=300)), x.T @ x + 5 * np.eye(12), 20.0
    w, g = np.zeros(12), np.zeros(12)
    for _ in range(20000):
        for j in range(12):
            rho = q[j] - g[j] + h[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0) / h[j, j]
            g, w[j] = g + h[j] * (new - w[j]), new
    np.testing.assert_allclose(SG._sparse_minimum(h, q, l1, np.zeros(12)), w, atol=1e-9)


# ---- rules, files, streams ------------------------------------------------------------------------


def test_rules_fail_loudly(spark):
    pdf = sample_bars(5)
    V.require_none(V.ohlc_violations(spark.createDataFrame(pdf)), "bars")
    pdf.loc[2, "low"] = pdf.loc[2, "close"] + 1
    with pytest.raises(V.DataRuleError, match="bars"):
        V.require_none(V.ohlc_violations(spark.createDataFrame(pdf)), "bars")


def test_trials_must_be_finite(spark):
    row = pd.DataFrame([{"dataset_fingerprint": "d", "strategy_family": "f", "sr": float("nan"), "t_observations": 9, "skew": 0.0, "kurt": 3.0, "metadata_json": "{}"}])
    with pytest.raises(Exception, match="invalid trial"):
        TR.checked_trials(spark.createDataFrame(row)).collect()


def test_zipped_klines(spark, tmp_path):
    lines = ["open_time,open,high,low,close,volume,close_time,quote_volume", "1,10,12,9,11,5,1700000000000,55", "2,11,13,10,12,5,1700086400000000,60"]
    with zipfile.ZipFile(tmp_path / "X.zip", "w") as archive:
        archive.writestr("X.csv", "\n".join(lines))
    rows = L.klines_of(L.read_zipped_lines(spark, str(tmp_path)).select("value")).orderBy("ts").collect()
    assert [r["close"] for r in rows] == [11.0, 12.0] and (rows[1]["ts"] - rows[0]["ts"]).days == 1


def test_changed_header_fails(spark, tmp_path):
    (tmp_path / "C-fundingRate-2020-01.csv").write_text("calc_time,hours,last_funding_rate\n1700000000000,8,0.0001\n")
    with pytest.raises(Exception):
        L.read_funding(spark, str(tmp_path)).collect()


def test_streamed_average_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"symbol": np.repeat(["a", "b"], 90), "ts": list(pd.date_range("2024-01-01", periods=90)) * 2, "close": rng.normal(100, 2, 180)})
    for i in range(3):
        part = pdf[(pdf["ts"].dt.dayofyear - 1) // 30 == i]
        spark.createDataFrame(part).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    schema = spark.read.parquet(f"{tmp_path}/in/0").schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with J.keyed_state(spark):
        J.run_to_table(J.running_averages(stream, 12), f"{tmp_path}/out", f"{tmp_path}/log")
    got = spark.read.parquet(f"{tmp_path}/out").toPandas().sort_values(["symbol", "ts"])
    want = pdf.groupby("symbol")["close"].transform(lambda x: x.ewm(span=12, adjust=False, min_periods=12).mean())
    np.testing.assert_allclose(got["ema"].to_numpy(float), want.to_numpy(), rtol=1e-12)
    assert got["rsi"].notna().sum() == 2 * (90 - 14)


def test_rules_catch_missing_values(spark):
    from panelcraft.operators import validate

    bars = spark.createDataFrame([(1.0, 2.0, 1.0, None), (1.0, 2.0, 1.0, 1.5), (float("nan"), 2.0, 1.0, 1.0)], "open double, high double, low double, close double")
    assert [r["rule"] for r in validate.index_bar_violations(bars).collect()] == ["missing_value"] * 2
    chain = spark.createDataFrame([(None, "call", 1.0, 1.0), ("BTC-1", None, 1.0, 1.0), ("BTC-1", "put", 1.0, 1.0)],
                                  "instrument string, type string, strike double, underlying double")
    assert sorted(r["rule"] for r in validate.option_violations(chain, "BTC").collect()) == ["foreign_symbol", "unknown_type"]


def test_block_bootstrap(spark):
    from panelcraft.operators import bootstrap as B

    rng = np.random.default_rng(4)
    values = {"a": rng.normal(size=40), "b": rng.normal(size=7), "c": rng.normal(size=1)}
    series = spark.createDataFrame([(k, i, float(x)) for k, v in values.items() for i, x in enumerate(v)], "series_id string, idx long, ret double")
    for expected in (1.0, 2.0, 9.0, 100.0):  # from single rows to blocks that go round the series several times
        blocks = spark.createDataFrame([(k, expected) for k in values], "series_id string, block double")
        cells = B.resample(series, 30, blocks, 3).toPandas()
        assert (cells.groupby(["series_id", "path"])["pos"].agg(["min", "max", "nunique"]).reset_index()
                .apply(lambda r: (r["min"], r["max"] + 1, r["nunique"]) == (0, len(values[r["series_id"]]), len(values[r["series_id"]])), axis=1)).all()
        want = cells.groupby(["series_id", "path"])["ret"].mean()
        got = B.path_means(series, 30, blocks, 3).toPandas().set_index(["series_id", "path"])["value"]
        np.testing.assert_allclose(got.sort_index().to_numpy(), want.sort_index().to_numpy(), atol=1e-12)
    lengths = B.block_draws(spark.range(20_000).selectExpr("'z' AS series_id", "id AS idx", "0D AS ret"), 20,
                            spark.createDataFrame([("z", 8.0)], "series_id string, block double"), 5)
    assert abs(lengths.agg(F.avg("len")).first()[0] - 8.0) < 0.15


def test_stream_keeps_open_windows(spark, tmp_path):
    rows = [("a", "2024-01-01 10:05:00", 1), ("a", "2024-01-01 10:40:00", 2), ("a", "2024-01-01 10:50:00", 3), ("b", "2024-01-01 10:10:00", 4)]
    for i, (name, at, ingest) in enumerate(rows):
        spark.createDataFrame([(name, at, ingest)], "instrument string, ts string, ingest long").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    quotes = spark.read.parquet(f"{tmp_path}/in/*")
    stream = spark.readStream.schema(quotes.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    J.run_to_updates(J.freshest_quotes(stream), f"{tmp_path}/out", f"{tmp_path}/log")
    windows = J.current_rows(spark.read.parquet(f"{tmp_path}/out"), ["instrument", "window_end"])
    assert {r["instrument"]: r["ingest"] for r in windows.collect()} == {"a": 3, "b": 4}
    for at, want in (("2024-01-01 10:45:00", {"a": 2, "b": 4}), ("2024-01-01 11:00:00", {"a": 3, "b": 4}), ("2024-01-01 10:07:00", {"a": 1})):
        assert {r["instrument"]: r["ingest"] for r in J.latest_as_of(windows, quotes, at).collect()} == want


def test_path_products_equal_laid_out_paths(spark):
    from panelcraft.operators import bootstrap as B

    rng = np.random.default_rng(12)
    values = {"a": rng.normal(size=60), "b": rng.normal(size=9), "c": rng.normal(size=2)}
    series = spark.createDataFrame([(k, i, float(x)) for k, v in values.items() for i, x in enumerate(v)], "series_id string, idx long, ret double")
    weights = series.select("series_id", "idx", (F.col("idx") * F.col("idx") + 0.5).alias("w"))  # an uneven calendar
    for expected in (1.0, 5.0, 80.0):
        blocks = spark.createDataFrame([(k, expected) for k in values], "series_id string, block double")
        laid = B.resample(series, 40, blocks, 3).join(weights.withColumnRenamed("idx", "pos"), ["series_id", "pos"])
        want = laid.groupBy("series_id", "path").agg(F.sum(F.col("ret") * F.col("w")).alias("v")).toPandas().set_index(["series_id", "path"])["v"].sort_index()
        got = B.path_products(series, weights, 40, blocks, 3).toPandas().set_index(["series_id", "path"])["value"].sort_index()
        assert len(got) == 120 and (got.index == want.index).all()
        np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), rtol=1e-9, atol=1e-9)
