import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.functions import paths as P
from tidewright.functions import signature as S
from tidewright.models import linear, oneclass, sequential, synthetic
from tidewright.models.cvar import TailRiskMachine
from tidewright.models.neural import MLP, SignatureLSTM
from tidewright.operators import scores as M
from tidewright.operators.strategy import entry_cost


def test_signature_identities():
    assert S.signatures_of(np.array([[[0, 0], [1, 2], [3, 1], [2, 5]]], float), 2)[0] == pytest.approx([2, 5, 2, 9, 1, 12.5])
    line = np.linspace(0, 1, 5)[:, None] * np.array([2.0, -1.0])
    s = S.split_levels(S.signatures_of(line[None], 4)[0], 2, 4)
    power, fact = np.ones(1), 1
    for k in range(1, 5):
        power, fact = np.multiply.outer(power, [2.0, -1.0]).ravel(), fact * k
        assert s[k] == pytest.approx(power / fact)
    with pytest.raises(ValueError):
        S.signatures_of(np.zeros((1, 1, 2)), 2)


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 3), st.integers(2, 4))
def test_chen_shuffle_and_time(seed, d, depth):
    p = np.random.default_rng(seed).normal(size=(1, 7, d))
    sig = lambda q: S.split_levels(S.signatures_of(q, depth)[0], d, depth)
    whole = sig(p)
    joined = S.tensor_product(sig(p[:, :4]), sig(p[:, 3:]), depth)
    for a, b in zip(whole, joined):
        assert a == pytest.approx(b)
    slow = np.repeat(p, 2, axis=1)
    for a, b in zip(whole, sig(slow)):
        assert a == pytest.approx(b)
    for a, b in zip(whole, sig(p + 5)):
        assert a == pytest.approx(b)
    e = [np.zeros(1), np.random.default_rng(seed + 1).normal(size=d)]
    assert S.paired(S.shuffle_elements(e, e, d), whole[:3]) == pytest.approx(S.paired(e, whole[:2]) ** 2)


def test_paths_in_spark_equal_numpy(spark):
    r = np.random.default_rng(0)
    raw = [r.normal(size=(n, 2)) for n in (2, 5, 5, 9)]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(raw)] + [(9, [[1.0, 2.0]]), (10, None)], "i int, path array<array<double>>")
    out = {x.i: x.sig for x in S.with_signature(df, 3).collect()}
    assert out[9] is None and out[10] is None
    for i, p in enumerate(raw):
        assert out[i] == pytest.approx(S.signatures_of(p[None], 3)[0].tolist())
    one = df.where("i = 1")
    got = lambda c: np.array(one.select(c).first()[0], float)
    p = raw[1]
    assert got(P.lead_lag(F.col("path"), "lag_lead")).shape == (9, 4)
    assert got(P.resampled(F.col("path"), 5)) == pytest.approx(p)
    assert got(P.recency_weighted(F.col("path"), 1e9)) == pytest.approx(p)
    assert got(P.add_basepoint(F.col("path")))[0].tolist() == [0.0, 0.0]
    x = spark.createDataFrame([([[1.0], [2.0], [4.0]],)], "path array<array<double>>")
    assert x.select(P.lead_lag(F.col("path"), "lag_lead")).first()[0] == [[1, 1], [1, 2], [2, 2], [2, 4], [4, 4]]
    assert x.select(P.lead_lag(F.col("path"), "leads_lags")).first()[0] == [[1, 1], [2, 1], [2, 2], [4, 2], [4, 4]]
    assert x.select(P.invisibility_reset(F.col("path"))).first()[0] == [[1, 1], [2, 1], [4, 1], [4, 0], [0, 0]]


def test_statistics():
    assert M.student_p(2.0, 10) == pytest.approx(0.07338803, rel=1e-6) and M.student_p(0.0, 3) == pytest.approx(1.0) and M.student_p(-3.5, 1) == pytest.approx(2 * np.arctan(1 / 3.5) / np.pi)
    assert M.normal_p(1.959964) == pytest.approx(0.05, rel=1e-5)
    assert entry_cost(1e-4 / 8760, 2.0) == pytest.approx(2 * 0.01 * 0.02 / 8760)
    with pytest.raises(ValueError):
        M.weibull_threshold(0.9, 0.5, 1.0, 4)
    a = M.weibull_threshold(0.01, 0.5, 0.3, 4)
    assert 0.5 * np.exp(-0.3 * a**0.5) == pytest.approx(0.01)


def test_rejections_and_rank_metrics(spark):
    p = spark.createDataFrame([(x,) for x in (0.001, 0.008, 0.039, 0.041, 0.2, 0.6)], "p double")
    assert M.benjamini_hochberg(p, "p", 0.1).where("rejected").count() == 4
    assert M.benjamini_hochberg(p.limit(0), "p").count() == 0
    x = spark.createDataFrame([(1.0, 0), (1.0, 1), (2.0, 1), (0.5, 0)], "s double, y int")
    assert M.rank_metrics(x, F.col("s"), F.col("y") == 1).first().auroc == pytest.approx(0.875)
    assert M.discovery_rates(x, F.lit(False), F.col("y") == 1).first().fdr == 0.0
    c = M.calibrated(spark.createDataFrame([(2.0,), (-1.0,), (9.0,)], "v double"), spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double"), "v")
    assert {r.v: r.p_value for r in c.collect()} == {2.0: 0.75, -1.0: 1.0, 9.0: 0.25}


def test_mahalanobis_and_mmd_equal_numpy(spark):
    r = np.random.default_rng(1)
    x, y = r.normal(size=(40, 5)), r.normal(size=(30, 5)) + 0.3
    frame = lambda v: spark.createDataFrame([(row.tolist(),) for row in v], "v array<double>")
    mean, cov = x.mean(axis=0), np.cov(x.T, bias=True)
    mu = np.trace(cov) / 5
    delta = ((cov - mu * np.eye(5)) ** 2).sum() / 5
    fourth = (((x - mean) ** 2).sum(axis=1) ** 2).mean()
    beta = min((fourth - (cov**2).sum()) / (40 * 5), delta)
    shrunk = (1 - beta / delta) * cov + beta / delta * mu * np.eye(5)
    want = np.sqrt(np.einsum("ij,jk,ik->i", y - mean, np.linalg.inv(shrunk), y - mean))
    got = [q.score for q in M.mahalanobis(frame(y), frame(x), "v").collect()]
    assert sorted(got) == pytest.approx(sorted(want.tolist()), rel=1e-6)
    k = lambda a, b: a @ b.T
    u = (k(x, x).sum() - np.trace(k(x, x))) / (40 * 39) + (k(y, y).sum() - np.trace(k(y, y))) / (30 * 29) - 2 * k(x, y).mean()
    assert M.mmd_squared(frame(x), frame(y), "v").first().mmd2 == pytest.approx(u)


def test_detectors_find_outliers(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 3))
    far = r.normal(size=(10, 3)) + 8
    for make in oneclass.DETECTORS.values():
        m = make().fit(x)
        assert m.score(far).min() > np.quantile(m.score(x), 0.95)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(np.vstack([x, far]))] + [(999, None)], "i bigint, v array<double>")
    out = {q.i: q for q in oneclass.scored(df, df.where("i < 300"), "v", "i").collect()}
    assert out[999].ocsvm is None and out[305].lof > 2
    share = sum(out[i].ocsvm > 0 for i in range(300)) / 300
    assert share < 0.12


def test_sequential_models():
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(0, 0.3, 200), r.normal(0, 3, 100), r.normal(0, 0.3, 200)])[:, None]
    m = sequential.GaussianHMM().fit(x)
    f, s = m.posteriors(x)
    j = m.lively()
    assert s[220:280, j].mean() > 0.9 and s[:150, j].mean() < 0.1 and np.allclose(f.sum(axis=1), 1)
    again, _ = m.posteriors(x[:250])
    assert again == pytest.approx(f[:250])  # filtered ones do not look ahead
    ret = np.zeros(3000)
    h = 1.0
    for t in range(1, 3000):
        h = 0.1 + 0.1 * ret[t - 1] ** 2 + 0.8 * h
        ret[t] = np.sqrt(h) * r.normal()
    o, a, b = sequential.fit_garch(ret)
    assert 0.03 < a < 0.2 and 0.6 < b < 0.95
    assert sequential.garch_forecast(np.array([2.0]), 0.1, 0.1, 0.8, 2)[0] == pytest.approx(2 + 0.1 + 0.9 * 2)
    y = np.concatenate([np.zeros(50), np.ones(50) * 5]) + r.normal(0, 0.1, 100)
    assert sequential.changepoints(y, 5.0) == [50]
    z = r.normal(size=120)
    m_, n = 10, 111
    norm = np.array([(z[i : i + m_] - z[i : i + m_].mean()) / z[i : i + m_].std() for i in range(n)])
    want = [min(np.linalg.norm(norm[i] - norm[k]) for k in range(n) if abs(i - k) >= 2) for i in range(n)]
    assert sequential.matrix_profile(z, m_) == pytest.approx(want, rel=1e-6, abs=1e-6)
    state = np.tile([0, 1], 200)
    q = sequential.q_learn(state, np.where(state == 0, 0.02, -0.02), np.zeros(400), 2, epochs=20)
    assert sequential.LEVELS[q.argmax(axis=1)].tolist() == [1.0, -1.0]


def test_multinomial_is_at_its_optimum():
    from tidewright.models.linear import multinomial

    r = np.random.default_rng(2)
    x, y = r.normal(size=(300, 4)), r.integers(3, size=300)
    x[:, 0] += y
    w, z = multinomial(x, y, 3, 0.05), np.column_stack([x, np.ones(300)])
    p = np.exp(z @ w) / np.exp(z @ w).sum(axis=1, keepdims=True)
    assert np.abs(z.T @ (p - np.eye(3)[y]) / 300 + 0.05 * w).max() < 1e-6


def test_tail_risk_machine_descends():
    r = np.random.default_rng(4)
    paths = np.cumsum(r.normal(0, 0.2, (50, 8, 2)), axis=1)
    m = TailRiskMachine(2, 2)
    deep = S.signatures_of(paths, 4)
    m.fit(deep.mean(axis=0), float(np.median(np.linalg.norm(deep[:, :6], axis=1))))
    at_zero = m._value(np.zeros(6))
    assert m.value <= at_zero[0]
    w = r.normal(size=6) * 0.1
    v, g, _ = m._value(w)
    for i in range(6):
        e = np.zeros(6)
        e[i] = 1e-6
        assert (m._value(w + e)[0] - m._value(w - e)[0]) / 2e-6 == pytest.approx(g[i], rel=1e-3, abs=1e-5)
    # the pairing with a shuffle power is the mean of powers of the pairing
    p, _ = m._powers(w)
    assert p[1] == pytest.approx(float((deep[:, :6] @ -w).mean())) and p[2] == pytest.approx(float(((deep[:, :6] @ -w) ** 2).mean()))


def test_linear_equals_numpy(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(200, 3))
    y = 1 + x @ [1.0, -2.0, 0.5] + r.normal(0, 0.1, 200)
    df = spark.createDataFrame([(a.tolist(), float(b), i // 40) for i, (a, b) in enumerate(zip(x, y))], "x array<double>, y double, f int")
    q = linear.gram(df, "x", "y")[0][1]
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert linear.solve(q) == pytest.approx(want)
    assert linear.squared_error(q, want) == pytest.approx(float(((y - np.column_stack([np.ones(200), x]) @ want) ** 2).sum()))
    z = (x - x.mean(0)) / x.std(0)
    b = np.linalg.solve(z.T @ z + 7 * np.eye(3), z.T @ (y - y.mean()))
    assert linear.solve(q, 7.0)[1:] * x.std(0) == pytest.approx(b)
    coef, penalty = linear.ridge(df, "x", "y", "f")
    assert coef == pytest.approx(want, abs=0.05) and penalty in linear.ALPHAS
    assert linear.gram(df.limit(0), "x", "y") == {}


def test_networks_learn_and_gradients_hold():
    r = np.random.default_rng(6)
    x = r.normal(size=(300, 4))
    y = x[:, 0] - 2 * x[:, 1]
    m = MLP(epochs=40).fit(x, y)
    assert ((m.predict(x) - y) ** 2).mean() < 0.1 * y.var()
    seq = r.normal(size=(40, 5, 3))
    lstm = SignatureLSTM(hidden=6, epochs=1).fit(seq, seq[:, -1, 0])
    xs, ys = seq[:8], r.normal(size=8)
    grads = lstm._gradient(xs, ys)
    for p, g in zip(lstm.params, grads):
        i = np.unravel_index(int(np.abs(g).argmax()), g.shape)
        keep = p[i]
        loss = lambda: ((lstm._forward(xs)[0] - ys) ** 2).mean()
        p[i] = keep + 1e-6
        up = loss()
        p[i] = keep - 1e-6
        down = loss()
        p[i] = keep
        assert (up - down) / 2e-6 == pytest.approx(g[i], rel=1e-4)


def test_synthetic_paths_and_bootstrap(spark):
    a = synthetic.synthetic_paths(spark, 3, 16).orderBy("id").collect()
    b = synthetic.synthetic_paths(spark, 3, 16).repartition(5).orderBy("id").collect()
    assert a == b and len(a) == 18
    with pytest.raises(ValueError):
        synthetic.shape("square", np.zeros(3))
    v = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    assert synthetic.bootstrap_p(v, "v", 1e9, 10, 99).first().p == pytest.approx(0.01)
    assert synthetic.bootstrap_p(v, "v", -1.0, 10, 99).first().p == 1.0
    assert 0.2 < synthetic.bootstrap_p(v, "v", 49.5, 10, 499).first().p < 0.8


def test_bootstrap_draws_as_many_as_observed(spark, small_dir):
    """Against the normal limit of a mean of n draws; the query draws as many values as there are error events."""
    from math import erfc, sqrt

    from tidewright.queries.scoring import m28_bootstrap

    e = spark.read.parquet(f"{small_dir}/events.parquet").select("event_type", "value").toPandas()
    own = e[e.event_type == "error"].value
    limit = erfc((own.mean() - e.value.mean()) / (e.value.std(ddof=0) / sqrt(len(own))) / sqrt(2)) / 2
    assert m28_bootstrap(spark, small_dir).first().p == pytest.approx(limit, abs=0.06)
    v = spark.createDataFrame([(k, float(i % 7) + k) for i in range(2000) for k in (0, 1)], "k int, v double")
    t = spark.createDataFrame([(0, 3.05, 3000), (0, 3.05, 3), (1, 3.05, 3000), (1, None, 5), (2, 1.0, 5)], "k int, observed double, size bigint")
    sd = np.std([i % 7 for i in range(2000)]) / sqrt(3000)
    mean = np.mean([i % 7 for i in range(2000)])
    for test in t.collect():
        out = synthetic.bootstrap_tests(v, ["k"], "v", spark.createDataFrame([test], t.schema), 999).first()
        if test.observed is None or test.k == 2:
            assert out.p is None and out.replicates == 0
        elif test.k == 1:
            assert out.p == 1.0
        elif test["size"] == 3000:
            assert out.p == pytest.approx(erfc((3.05 - mean) / sd / sqrt(2)) / 2, abs=0.06)
        else:
            assert out.p > 0.3


def test_bootstrap_over_chunks(spark, monkeypatch):
    """Values in several chunks follow the same law, and the result does not depend on how rows are laid out."""
    monkeypatch.setattr(synthetic, "CHUNK", 16)
    v = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    for size in (10, 5000):
        observed = 49.5 + 28.866 / size**0.5
        p = synthetic.bootstrap_p(v, "v", observed, size, 999).first().p
        assert p == pytest.approx(0.1587, abs=0.05)
        assert synthetic.bootstrap_p(v.repartition(7), "v", observed, size, 999).first().p == p


def test_penalties_from_one_decomposition():
    """Also where features are linear in each other."""
    x = np.random.default_rng(0).normal(size=(60, 4))
    x = np.column_stack([x, x[:, 0] - x[:, 1], np.ones(60)])
    z = np.column_stack([np.ones(60), x, x @ np.arange(6.0) + np.sin(np.arange(60))])
    for a, b in zip((1e-4, 1.0, 1e5), linear.solve_each(z.T @ z, np.array([1e-4, 1.0, 1e5]))):
        np.testing.assert_allclose(b, linear.solve(z.T @ z, a), rtol=1e-6, atol=1e-8)


def test_models_are_registered_at_full_settings(spark, small_dir, monkeypatch):
    """What the queries pass to the models: rounds, epochs and folds as the operators' own; signatures of whole daily paths to depth 3."""
    import inspect

    from tidewright.plans import forecast
    from tidewright.queries import scoring

    class Seen(Exception):
        pass

    def seen(*args, **kwargs):
        raise Seen(args, kwargs)

    assert scoring.SPEC.points is None
    x = scoring.g18_dataset(spark, small_dir).select(F.size("x_sig")).distinct().collect()
    assert [r[0] for r in x] == [S.signature_dim(7, 3)]
    assert inspect.signature(sequential.q_policy).parameters["epochs"].default == inspect.signature(sequential.q_learn).parameters["epochs"].default == 400
    epochs = MLP().epochs
    monkeypatch.setattr("pyspark.ml.regression.GBTRegressor", seen)
    monkeypatch.setattr("tidewright.models.neural.MLP", seen)
    monkeypatch.setattr(forecast, "purged_folds", seen)
    with pytest.raises(Seen) as e:
        scoring.m17_boosted_trees(spark, small_dir)
    assert (e.value.args[1]["maxIter"], e.value.args[1]["stepSize"], e.value.args[1]["maxDepth"]) == (500, 0.03, 3)
    with pytest.raises(Seen) as e:
        scoring.m18_networks(spark, small_dir)
    assert e.value.args[1].get("epochs", epochs) == 200
    for q in (scoring.m14_m16_x25_walk_forward, scoring.m31_ranking, scoring.x25_ablation):
        with pytest.raises(Seen) as e:
            q(spark, small_dir)
        assert e.value.args[0][4] == 4


def test_evaluations_have_multiple_and_p(spark):
    """Against the reference's formulas in numpy, on the whole and by period; detections before large moves get a small p."""
    import pandas as pd

    from tidewright.plans import novelty

    rng = np.random.default_rng(1)
    n = 400
    step = rng.normal(0, 0.01, n)
    at = np.arange(5, n - 10, 20)
    step[at + 1] = 0.03
    close = 100 * np.exp(step.cumsum())
    pdf = pd.DataFrame({"series": "a", "period": 0, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), "h"), "open": close, "high": close, "low": close, "close": close})
    bars = spark.createDataFrame(pd.concat([pdf, pdf.assign(series="b", period=1)])).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    move = np.abs(close[1:] / close[:-1] - 1)
    plain = move[7::20][: len(at)]
    pick = lambda first: F.expr(f"timestampdiff(hour, timestamp_ntz'2024-01-01 00:00:00', ts) % 20 = {first} and ts < timestamp_ntz'2024-01-01' + interval {n - 10} hours")
    one = bars.where("period = 0")
    for detections, mean in ((5, move[at].mean()), (7, plain.mean())):
        out = novelty.evaluate_detections(one, one.where(pick(detections)), [1], 3600).first()
        means = rng.choice(move, (4000, len(at))).mean(axis=1)
        assert (out.n, out.mean_ret, out.multiple) == (len(at), pytest.approx(mean), pytest.approx(mean / move.mean()))
        assert out.p == pytest.approx((means >= mean).mean(), abs=0.05)
        by = novelty.evaluate_by_period(bars, bars.where(pick(detections)), [1], 3600).orderBy("period").collect()
        assert [(r.period, r.n, r.multiple) for r in by] == [(k, len(at), pytest.approx(mean / move.mean())) for k in (0, 1)]
        assert all(r.p == pytest.approx(out.p, abs=0.05) for r in by)
    none = novelty.evaluate_detections(one, one.where("false"), [1], 3600).first()
    assert (none.n, none.mean_ret, none.p) == (0, None, None)


def test_ranking_compares_with_the_best(spark):
    from math import erfc, sqrt

    import pandas as pd

    from tidewright.plans import forecast

    rng = np.random.default_rng(3)
    n, h = 120, 4
    y = rng.normal(size=n)
    e = {"good": rng.normal(0, 0.5, n), "bad": rng.normal(0, 1.0, n), "near": rng.normal(0, 0.55, n)}
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), "D")
    rows = spark.createDataFrame(pd.concat([pd.DataFrame({"model": k, "fold": np.arange(n) // 40, "series": "all", "ts": ts, "y": y, "prediction": y - v}) for k, v in e.items()])).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = {r.model: r for r in forecast.ranking(rows, h).collect()}
    best = min(e, key=lambda k: (e[k] ** 2).mean())
    for k, v in e.items():
        d = v**2 - e[best] ** 2
        if k == best:
            assert out[k].best and out[k].dm is None and out[k].dm_p is None
            continue
        lrv = d.var() + 2 * sum((1 - g / h) * np.cov(d[g:], d[:-g])[0, 1] for g in range(1, h))
        dm = d.mean() / np.sqrt(lrv / n)
        assert not out[k].best and out[k].dm == pytest.approx(dm) and out[k].dm_p == pytest.approx(erfc(abs(dm) / sqrt(2)), abs=1e-6)
