import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import oracle  # noqa: E402

from placeloom import catalogue  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    oracle.same(catalogue.queries()[name](spark, SF), con, catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_fusion_identity(spark):
    """places = pois + records - merged, ids unique, one to one, the same again."""
    from placeloom.operators import match

    p, r = catalogue._pois(spark, SF), catalogue._records(spark, SF)
    merges, undecided = match.resolve_entities(spark, p, r)
    places = match.fuse(p, r, merges)
    n = merges.count()
    assert places.count() == p.count() + r.count() - n
    assert places.select("place_id").distinct().count() == places.count()
    assert merges.select("poi_id").distinct().count() == n == merges.select("rec_key").distinct().count()
    assert undecided.join(merges, "poi_id", "left_semi").count() == 0
    again, _ = match.resolve_entities(spark, p, r)
    assert sorted(map(tuple, again.select("poi_id", "rec_key").collect())) == sorted(map(tuple, merges.select("poi_id", "rec_key").collect()))


def test_match_plan_has_no_nested_loop(spark):
    from placeloom.operators import match

    pairs = match.spatial_candidates(match.prepare_pois(catalogue._pois(spark, SF)), match.prepare_records(catalogue._records(spark, SF)))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_diff_of_a_run_with_itself_is_empty(spark):
    from placeloom.operators.diff import diff_runs

    a, b = catalogue._run(spark, SF, 0), catalogue._run(spark, SF, 1)
    assert diff_runs(a, a).where("delta_kind <> 'newRoles'").count() == 0
    ab = {(r.delta_kind, r.key) for r in diff_runs(a, b).collect()}
    ba = {(r.delta_kind, r.key) for r in diff_runs(b, a).collect()}
    assert {k for kind, k in ab if kind == "appeared"} == {k for kind, k in ba if kind == "disappeared"}


def test_every_row_takes_part(spark):
    orders = catalogue._table(spark, SF, "orders")
    want = orders.selectExpr("o_custkey", "o_orderkey % 150", "o_orderkey % 2", "o_orderkey % 3 > 0").distinct().count()
    assert catalogue.queries()["verdict_fold"](spark, SF).count() == want
    runs = [catalogue._run(spark, SF, k).select("ord") for k in (0, 1)]
    assert runs[0].union(runs[1]).distinct().count() == orders.count()
    assert catalogue.queries()["excerpts"](spark, SF).count() == catalogue._table(spark, SF, "documents").count()
