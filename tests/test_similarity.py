"""Similar designs over a threshold against all pairs of shared tokens, and what is joined for them."""

import random

import pytest

from stylecast import registry
from stylecast.operators import similarity


@pytest.fixture(scope="module")
def tokens(spark):
    """Designs that copy each other but for some tokens; one token that all have, groups of which some are unknown."""
    rnd = random.Random(4)
    base = [[f"t{rnd.randrange(120)}" for _ in range(rnd.randrange(1, 12))] for _ in range(12)]
    rows = []
    for k in range(120):
        own = {t if rnd.random() < 0.8 else f"t{rnd.randrange(120)}" for t in rnd.choice(base)} | {"ALL"}
        rows += [(f"d{k:03}", t, (None, "x", "y")[k % 3]) for t in own]
    rows += [("lone", "ALL", "x"), ("lone2", "ALL", None), ("odd", "only", "y")]
    return spark.createDataFrame(rows, "design string, token string, grp string")


@pytest.mark.parametrize("least", [0.05, 0.3, 0.5, 0.8, 1.0])
def test_pairs_over_a_threshold(tokens, least):
    want = {(r.design, r.other): r.sim for r in similarity.pairs(tokens).collect() if r.design < r.other and r.sim >= least}
    rows = similarity.pairs_over(similarity.profiles(tokens), least).collect()
    assert len(rows) == len(want) and {(r.design, r.other) for r in rows} == want.keys()
    assert all(abs(want[r.design, r.other] - r.sim) < 2e-9 for r in rows)
    grp = {r.design: r.grp for r in tokens.collect()}
    assert all(r.grp == (grp[r.design] if grp[r.design] == grp[r.other] else None) for r in rows)


def test_no_pairs_of_nothing(tokens):
    assert similarity.pairs_over(similarity.profiles(tokens.limit(0)), 0.5).count() == 0


def test_a_common_token_makes_no_pairs(spark):
    """Two thousand designs with one token in common and two of their own each: all pairs would be two million."""
    rows = spark.range(2000).selectExpr("concat('d', id) AS design", "explode(array('ALL', concat('a', id), concat('b', id div 2))) AS token", "'x' AS grp")
    got = similarity.pairs_over(similarity.profiles(rows), 0.5)
    assert got.count() == 0 and similarity.pairs_over(similarity.profiles(rows), 0.3).count() == 1000


@pytest.mark.parametrize("name", ["j10_category_pairs", "j10_category_pairs_over"])
def test_category_pairs_are_whole(spark, name):
    """All pairs of a category that share a token, those under the threshold of the other query too."""
    from tests.test_queries import SF, test_query_matches_sql

    test_query_matches_sql(spark, name)
    sims = [r.sim for r in registry.QUERIES[name](spark, SF).collect()]
    assert (min(sims) < 0.3) == (name == "j10_category_pairs")
