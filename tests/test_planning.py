"""Plans stay small: what the optimiser holds must not grow with the steps of an operator or the tables attached."""

from cadenza import queries

SMALL = "/root/testdata/sf0.001"


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plan_of_betafp_stays_small(spark):
    df = queries.queries()["regress__betafp_signal"](spark, SMALL)
    assert len(optimised(df)) < 100_000


def test_plan_grows_in_step_with_residual_operators(spark):
    from cadenza.plans.catalog import factor
    from cadenza.plans.compiler import Library
    from cadenza.sources.standins import standins

    names = ["IntanBM", "IntanCFP", "IntanEP", "IntanSP"]
    size = lambda few: len(Library(standins(spark, SMALL)).wide({n: factor(n) for n in few})._jdf.queryExecution().analyzed().toString())
    assert size(names[:4]) < 4 * size(names[:1])


def test_residuals_are_written_before_others_attach(spark, monkeypatch):
    """What is written on the spot must not hold the daily regressions that the query names first."""
    from cadenza.operators import regression
    from cadenza.plans.catalog import factor
    from cadenza.plans.compiler import Library
    from cadenza.sources.standins import standins

    plans = []
    monkeypatch.setattr(regression, "written", lambda df, label: plans.append(optimised(df)) or df)
    Library(standins(spark, SMALL)).wide({n: factor(n) for n in ("PriceDelayTstat", "IntanBM")})
    assert len(plans) == 1 and "MapInPandas" not in plans[0]


def test_trailing_rmse_of_each_wanted_row():
    import numpy as np

    from cadenza.operators.daily import trailing_rmse

    rng = np.random.default_rng(1)
    e, x, y = np.repeat([1, 2], [40, 9]), rng.normal(size=49), rng.normal(size=49)
    y[3] = 1e9  # past, it leaves no rounding behind
    wanted = np.array([5, 20, 39, 41, 48])
    found = trailing_rmse(e, y, x, 12, 6, wanted)
    for at, value in zip(wanted, found, strict=True):
        rows = [i for i in range(max(0, at - 11), at + 1) if e[i] == e[at]]
        if len(rows) < 6:
            assert np.isnan(value)
            continue
        slope, constant = np.polyfit(x[rows], y[rows], 1)
        rest = y[rows] - constant - slope * x[rows]
        assert np.isclose(value, np.sqrt((rest**2).sum() / (len(rows) - 2)))
