"""What the transitions of the matcher move."""

from roadpulse.operators import matching
from roadpulse.streaming import pipeline


def _rows(spark):
    cand = lambda road, at: (road, at, 10.0, 50.0, 1.0, 0.5, 2.0, 100.0)
    first = (1, "d", 100, 10.0, 50.0, [cand(1, 0.5)], None, None, None)
    routes = [([1], [2], 3.0, 50.0, [7, 8]), ([1], [3], 4.0, 5000.0, [9])]
    second = (1, "d", 110, 10.001, 50.0, [cand(1, 0.75), cand(2, 0.25), cand(3, 0.5)], (100, 10.0, 50.0, [1]), routes, 60.0)
    return spark.createDataFrame([first, second], pipeline.ROUTED_SCHEMA)


def test_transitions_leave_roads_of_routes_and_places_of_candidates_behind(spark):
    """Costs and lengths of pairs, from rows whose exchange holds no path, longitude, latitude or distance."""
    found = matching.transition_rows(_rows(spark))
    assert sorted((r.src, r.tgt, r.cost) for r in found.collect()) == [(1, 1, 0.5), (1, 2, 0.5 * 2.0 + 3.0 + 0.25 * 2.0)]
    moved = found._jdf.queryExecution().optimizedPlan()
    while "Window" not in moved.nodeName():
        moved = moved.children().head()
    inner = moved.children().head().schema().simpleString()
    assert "routes:array" in inner and "road_cost" in inner
    assert not any(f"{sep}{name}:" in inner for sep in ",<" for name in ("path", "lon", "lat", "dist", "prev"))
