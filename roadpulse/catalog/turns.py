"""The path, allocation, turning and history queries on pairs with turns.

The pairs of the other catalogues run along one row. Here come those added whose vehicle changed its direction or lies behind
its last point: they take the cheapest route within a bound that counts the pieces of both end roads, through other rows and
columns. The check finds those routes on its own, by following every chain of successors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.catalog import network, registry, traces, traffic  # noqa: F401
from roadpulse.catalog.fixtures import CTES, Fixtures, stored
from roadpulse.catalog.network import TP
from roadpulse.functions import scalar as S
from roadpulse.operators import pairs as pairing
from roadpulse.operators import routing

#: Metres that a turning route may have, ends included.
BOUND = 700.0


class TurnFixtures(Fixtures):
    """Fixtures whose pairs include those with turns."""

    OWN = frozenset({"raw_pairs", "pairs", "turn_pairs"})

    @stored
    def turn_pairs(self) -> DataFrame:
        usable = pairing.usable_pairs(pairing.pair_up(self.matched(), ["gid", "offset", "passenger"]))
        a, b, forward = S.base_id(F.col("pre_gid")), S.base_id(F.col("gid")), S.is_forward(F.col("gid"))
        along = (F.pmod("pre_gid", F.lit(2)) == F.pmod("gid", F.lit(2))) & (
            F.when(forward, b > a).otherwise(b < a) | ((a == b) & (F.col("offset") >= F.col("pre_offset"))))
        size = self.roads().select("id", "length_m")
        rest = usable.filter(~along).join(size.withColumnsRenamed({"id": "pre_gid", "length_m": "_from"}), "pre_gid").join(
            size.withColumnsRenamed({"id": "gid", "length_m": "_to"}), "gid").withColumn(
            "ends", (1 - F.col("pre_offset")) * F.col("_from") + F.col("offset") * F.col("_to"))
        wanted = rest.select(F.col("pre_gid").alias("src"), F.col("gid").alias("tgt"), F.lit(BOUND).alias("bound"), "ends")
        found = routing.routes_between(wanted, self.roads(), self.successors())
        return rest.join(found.withColumnsRenamed({"src": "pre_gid", "tgt": "gid"}), ["pre_gid", "gid", "ends"]).select(
            "date", "suid", "pre_utc", "pre_gid", "pre_offset", "utc", "gid", "offset", F.col("path").alias("route"), "passenger")

    @stored
    def raw_pairs(self) -> DataFrame:
        return Fixtures(self.spark, self.dir).raw_pairs().unionByName(self.turn_pairs())

EXTRA = {
    "turn_rest": f"""
        SELECT p.*, (1 - pre_offset) * a.length_m + "offset" * b.length_m AS ends
        FROM paired p JOIN roads a ON a.id = p.pre_gid JOIN roads b ON b.id = p.gid
        WHERE pre_utc IS NOT NULL AND utc - pre_utc <= 600 AND passenger = pre_passenger AND NOT (gid % 2 = pre_gid % 2
          AND (CASE WHEN gid % 2 = 0 THEN gid // 2 > pre_gid // 2 ELSE gid // 2 < pre_gid // 2 END
            OR (gid // 2 = pre_gid // 2 AND "offset" >= pre_offset)))""",
    "turn_steps": f"SELECT s.id, s.succ_id, r.length_m, {TP} AS cost FROM successors s JOIN roads r ON r.id = s.id",
    "turn_chains": f"""
        SELECT src, succ_id AS node, 0e0 AS cost, 0e0 AS length, [src, succ_id] AS path
        FROM (SELECT DISTINCT pre_gid AS src FROM turn_rest) JOIN successors ON id = src
        UNION ALL
        SELECT c.src, s.succ_id, c.cost + s.cost, c.length + s.length_m, list_append(c.path, s.succ_id)
        FROM turn_chains c JOIN turn_steps s ON s.id = c.node WHERE c.length + s.length_m <= {BOUND}e0""",
    "turn_pairs": f"""
        SELECT date, suid, pre_utc, pre_gid, pre_offset, utc, gid, "offset", passenger,
          arg_min(path, {{'cost': c.cost, 'length': c.length, 'back': list_reverse(path)}}) AS route
        FROM turn_rest p JOIN turn_chains c ON c.src = p.pre_gid AND c.node = p.gid AND c.length + p.ends <= {BOUND}e0
        GROUP BY ALL""",
}


def with_turns(check: str) -> str:
    """The check with the pairs with turns among ``raw_pairs``."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in CTES[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in ("paired", "roads", "successors"):
        need(name)
    rest = check.removeprefix("WITH RECURSIVE ")
    parts = [f"{name} AS ({CTES[name][1]})" for name in order]
    for part in parts:
        rest = rest.replace(f"{part}, ", "", 1) if f"{part}, " in rest else rest.replace(f", {part}", "", 1)
    whole = f"raw_pairs AS ({CTES['raw_pairs'][1]})"
    if whole not in rest:
        raise ValueError("the check does not read the pairs")
    columns = 'date, suid, pre_utc, pre_gid, pre_offset, utc, gid, "offset", passenger, route'
    rest = rest.replace(whole, f"raw_pairs AS ({CTES['raw_pairs'][1]} UNION ALL SELECT {columns} FROM turn_pairs)", 1)
    return f"WITH RECURSIVE {', '.join([*parts, *[f'{n} AS ({t})' for n, t in EXTRA.items()]])}, {rest}"


@registry.query("G1_turning_routes", with_turns(
    f"WITH RECURSIVE raw_pairs AS ({CTES['raw_pairs'][1]}) SELECT suid, utc, pre_gid, gid, array_to_string(route, ',') AS route FROM turn_pairs"))
def _(f):
    """Routes of the pairs with turns."""
    found = TurnFixtures(f.spark, f.dir).turn_pairs()
    return found.select("suid", "utc", "pre_gid", "gid", F.array_join(F.transform("route", lambda x: x.cast("string")), ",").alias("route"))


for _name in ("G2_G5_path_totals", "G3_invalid_paths", "A6_pair_flags", "J9_route_elements", "W3_next_road", "J10_turning_lookup",
              "W4_allocate_times", "O2_T10_road_speeds", "A14_smooth_turnings", "K2_write_turnings", "W6_infer_gaps", "K4_history_upsert"):
    registry.query(f"{_name}_with_turns", with_turns(registry.ORACLES[_name]))(
        lambda f, fn=registry.FUNCTIONS[_name]: fn(TurnFixtures(f.spark, f.dir)))
