import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions.exact import ks_exact, rank_sum_exact, rank_sum_shares
from cohortlens.operators.hypothesis import biomarker_screen, ks_2sample, mann_whitney
from cohortlens.operators.plotdata import kde_binned, kde_table


def arrangements(n1, n2):
    """U and the largest distance of the steps (times n1 * n2) of every arrangement."""
    for places in combinations(range(n1 + n2), n1):
        chosen = set(places)
        i = j = u = far = 0
        for k in range(n1 + n2):
            if k in chosen:
                i, u = i + 1, u + j
            else:
                j += 1
            far = max(far, abs(i * n2 - j * n1))
        yield u, far


@pytest.mark.parametrize(("n1", "n2"), [(1, 1), (1, 7), (2, 3), (4, 4), (3, 8), (8, 5), (8, 8)])
def test_p_values_equal_enumeration(n1, n2):
    every = list(arrangements(n1, n2))
    u, far = np.array([x[0] for x in every]), np.array([x[1] for x in every])
    shares = rank_sum_shares(n1, n2)
    assert np.allclose(shares, np.bincount(u, minlength=n1 * n2 + 1) / len(u))
    for seen in range(n1 * n2 + 1):
        top = max(seen, n1 * n2 - seen)
        assert rank_sum_exact(seen, n1, n2) == pytest.approx(min(1.0, 2 * (u >= top).mean()))
        assert rank_sum_exact(seen, n1, n2, "greater") == pytest.approx((u >= seen).mean())
        assert rank_sum_exact(seen, n1, n2, "less") == pytest.approx((u <= seen).mean())
    for k in sorted(set(far.tolist())):
        assert ks_exact(k / (n1 * n2), n1, n2) == pytest.approx((far >= k).mean())


def test_large_groups_stay_probabilities():
    shares = rank_sum_shares(8, 5000)
    assert shares.sum() == pytest.approx(1.0) and np.allclose(shares, shares[::-1], atol=1e-12)
    # Two large groups: the limit is near.
    assert ks_exact(0.08, 600, 500) == pytest.approx(0.0566, abs=0.006)


def grouped(spark, rows):
    return spark.createDataFrame(rows, "subject string, timepoint string, m double")


def test_methods_by_group_sizes_and_ties(spark):
    rng = random.Random(1)
    rows = [("small", t, rng.random()) for t in ("T0", "T2") for _ in range(6)]
    rows += [("tied", t, float(rng.randint(0, 2))) for t in ("T0", "T2") for _ in range(6)]
    rows += [("large", t, rng.random() + (t == "T2") / 9) for t in ("T0", "T2") for _ in range(60)]
    rows += [(None, "T0", 1.0), (None, "T2", 2.0), ("one", "T0", 3.0), ("gap", "T0", None), ("gap", "T2", 1.0)]
    df = grouped(spark, rows)
    found = {}
    for method in ("auto", "exact", "asymptotic"):
        tested = mann_whitney(df, ["m"], by=["subject"], method=method).collect()
        found[method] = {r.subject: r.p_value for r in tested}
    assert found["auto"].keys() == {"small", "tied", "large", None}
    assert found["auto"]["small"] == found["exact"]["small"] != found["asymptotic"]["small"]
    assert found["exact"]["tied"] is None and found["exact"]["large"] is None and found["exact"][None] == 1.0
    assert found["auto"]["tied"] == found["asymptotic"]["tied"] and found["auto"]["large"] == found["asymptotic"]["large"]
    small = [[v for s, t, v in rows if s == "small" and t == side] for side in ("T0", "T2")]
    u = sum(a > b for a in small[0] for b in small[1])
    assert found["auto"]["small"] == pytest.approx(rank_sum_exact(u, 6, 6))
    ks = {r.subject: r for r in ks_2sample(df, ["m"], by=["subject"], method="auto").collect()}
    assert ks["large"].p_value == pytest.approx(ks_exact(ks["large"].ks_d, 60, 60)) and ks[None].p_value == 1.0
    limit = {r.subject: r.p_value for r in ks_2sample(df, ["m"], by=["subject"], method="asymptotic").collect()}
    assert limit["large"] != ks["large"].p_value and abs(limit["large"] - ks["large"].p_value) < 0.05
    with pytest.raises(ValueError, match="unknown method"):
        ks_2sample(df, ["m"], method="other")
    screen = biomarker_screen(df.where("subject = 'small'"), ["m"], method="auto").first()
    assert screen.p_median == pytest.approx(found["auto"]["small"])


def test_binned_density_is_near_the_plain_one(spark):
    rng = random.Random(3)
    rows = [(g, "T0", rng.gauss(0, 1) if g == "a" else rng.expovariate(1.0)) for g in "ab" for _ in range(3000)]
    rows += [("flat", "T0", 1.0), ("flat", "T0", 1.0), ("a", "T0", None)]
    df = grouped(spark, rows)
    plain = {(r.subject, r.point): r for r in kde_table(df, ["m"], ["subject"]).collect()}
    binned = {(r.subject, r.point): r for r in kde_binned(df, ["m"], ["subject"]).collect()}
    assert plain.keys() == binned.keys() and len(plain) == 400
    assert all(abs(plain[k].density - binned[k].density) < 1e-4 and plain[k].x == pytest.approx(binned[k].x) for k in plain)
    # What is shuffled are the nodes of the grid, not the values.
    coarse = kde_binned(df, ["m"], ["subject"], cells=16)
    coarse.collect()
    plan = coarse._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Exchange" in plan and "node" in plan
    assert kde_binned(df.where(F.lit(False)), ["m"], ["subject"]).count() == 0
