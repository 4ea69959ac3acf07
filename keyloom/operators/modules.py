"""Keyed application operators: each turns rows (key, metric, aux, category, sequence, branch) into rows of
the same shape, in order of (sequence, branch) within a key.

An operator is declared by the running sums and previous values it needs and by what it emits from them, in Spark SQL.
Remainders are never negative, whatever the sign of what they are taken of.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators.running import running, running_in_key

COLUMNS = ("key", "metric", "aux", "category", "sequence", "branch")


@dataclass(frozen=True)
class Module:
    """metric and aux emitted; sums and previous by name; then: sums over the first sums' results."""

    metric: str
    aux: str
    sums: dict[str, str] = field(default_factory=dict)
    previous: dict[str, str] = field(default_factory=dict)
    then: dict[str, str] = field(default_factory=dict)
    key: str = "key"

    @property
    def stateless(self) -> bool:
        return not (self.sums or self.previous or self.then)

    def apply(self, df: DataFrame, wrap: bool = False, spread: bool = True) -> DataFrame:
        """wrap: for inputs of any size, whose sums wrap around as 64-bit numbers. spread: cut keys into blocks."""
        add_up = running if spread else running_in_key
        rows = add_up(df, self.sums, self.previous, wrap=wrap) if self.sums or self.previous else df
        if self.then:
            rows = add_up(rows, self.then)
        return rows.select(F.expr(self.key).alias("key"), *[F.expr(e).cast("bigint").alias(n) for n, e in (("metric", self.metric), ("aux", self.aux))], "category", "sequence", "branch")


def _if(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


N = {"n": "1"}
EVEN_AUX, EVEN_METRIC = _if("(aux & 1) = 0"), _if("(metric & 1) = 0")
#: Keys that map matching re-keys to.
ROADS = 1000

MODULES = {
    "count": Module("s", "aux", {"s": "metric"}),
    "map_match": Module("metric", "metric * 31 + aux", key=f"pmod(metric * 31 + aux + sequence, {ROADS})"),
    "speed_calculate": Module("s div n", "n", {"s": "metric"} | N),
    "geo_finder": Module("pmod(metric + aux, 251)", "pmod(metric * 13 + aux, 4096)"),
    "geo_status": Module("n", "odd", N | {"odd": "aux & 1"}),
    "status_counter": Module("n", "bytes", N | {"bytes": "aux"}),
    "volume_counter": Module("n", "aux", N),
    "rcrf": Module("n", "targets", N | {"targets": _if("pmod(aux, 4) = 0")}),
    "ecrf": Module("n", "answers", N | {"answers": _if("(category & 1) = 0")}),
    "encr": Module("score", "established", {"score": "pmod(metric + aux, 7)", "established": EVEN_AUX}),
    "ct24": Module("n", "duration", N | {"duration": "metric"}),
    "ecr24": Module("established", "completed", {"established": EVEN_AUX, "completed": EVEN_METRIC}),
    "global_acd": Module("s div n", "n", {"s": "metric"} | N),
    "fofir": Module("score", "alerts", {"score": "metric + aux", "alerts": _if("aux > 4")}),
    "url": Module("score", "n", {"score": "metric + aux"} | N),
    "acd": Module("score", "n", {"score": "metric"} | N),
    "score": Module("total", "n", {"total": "metric + aux"} | N),
    "spike_detection": Module("alerts", "coalesce(was, metric)", {"alerts": _if("metric > aux")}, {"was": "metric"}),
    "average_speed": Module("s div n", "n", {"s": "metric"} | N),
    "last_average_speed": Module("metric", "metric - coalesce(was, metric)", {}, {"was": "metric"}),
    "accident_detection": Module("stalled", "aux", {}, {"was": "aux"}, {"stalled": _if("coalesce(was, aux) = aux")}),
    "count_vehicles": Module("n", "aux", N),
    "accident_notification": Module("active", "aux", {"active": _if("metric > 0")}),
    "daily_expenses": Module("toll", "distance", {"toll": "pmod(metric + aux, 50)", "distance": "metric"}),
    "toll_notification": Module("toll", "congestion", {"congestion": _if("metric > 40")}, {}, {"toll": "pmod(metric + congestion, 25)"}),
    "account_balance": Module("balance", "n", {"balance": "metric"} | N),
}


def rekeyed(df: DataFrame, **columns: str) -> DataFrame:
    """df with some of its columns computed anew, from their old values."""
    return df.select(*[F.expr(columns.get(c, c)).cast("bigint").alias(c) for c in COLUMNS])


def union(*frames: DataFrame) -> DataFrame:
    """Bag union; branch numbers keep rows of one sequence number in a fixed order."""
    out = None
    for k, f in enumerate(frames):
        f = f.withColumn("branch", F.col("branch") * 4 + k)
        out = f if out is None else out.unionByName(f)
    return out
