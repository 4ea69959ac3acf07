"""The seven keyed applications, and each of their operators on the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators import recurrent as rec
from keyloom.operators.modules import MODULES, rekeyed, union
from keyloom.operators.running import BLOCK, rows_of_largest_key
from keyloom.plans import application_sql
from keyloom.sources import views
from keyloom.sources.sinks import kept

KEYS, BATCH, SHARDS = 1000, 16, 4096


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Application rows of the event stream: user, an amount of 1 to 1000, an auxiliary number, a kind."""
    e = views.table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("key"),
        (F.round(F.col("value") * 100).cast("bigint") % 1000 + 1).alias("metric"),
        (F.col("event_id") % 97).alias("aux"),
        (F.col("event_id") % 8).alias("category"),
        F.col("event_id").alias("sequence"),
        F.lit(0).cast("bigint").alias("branch"),
    )


class Spark:
    """Builds an application's graph as a DataFrame.

    The rows of the largest key are counted wherever rows get other keys, and carried along: an operator gives a row for
    each of its own, a union the rows of its parts. While no key has more rows than a block, running totals are plain
    windows and operators that keep the key share one shuffle. Beyond, keys are cut into blocks; as such a total reads its
    input twice, rows that come out of one and go into another are then written in between: along a chain of n operators
    they would otherwise be computed 2**n times.
    """

    def __init__(self) -> None:
        self.made: list[DataFrame] = []
        self.largest: list[tuple[DataFrame, int]] = []

    def _most(self, x: DataFrame) -> int:
        known = next((n for f, n in self.largest if f is x), None)
        if known is None:
            known = rows_of_largest_key(x)
            self.largest.append((x, known))
        return known

    def _from(self, out: DataFrame, *sources: DataFrame, most: int | None = None) -> DataFrame:
        """out, known to be made by an operator if a source is."""
        if any(s is m for s in sources for m in self.made):
            self.made.append(out)
        if most is not None:
            self.largest.append((out, most))
        return out

    def op(self, name: str, x: DataFrame, wrap: bool = False) -> DataFrame:
        module = MODULES[name]
        if module.stateless:
            return self._from(module.apply(x, wrap), x, most=self._most(x) if module.key == "key" else None)
        most = self._most(x)
        spread = most > BLOCK
        if spread and any(x is m for m in self.made):
            x = kept(x, f"rows-{name}")
        out = module.apply(x, wrap, spread)
        if spread:
            self.made.append(out)
        self.largest.append((out, most))
        return out

    def map(self, x: DataFrame, **columns: str) -> DataFrame:
        return self._from(rekeyed(x, **{k: v.replace("//", "div") for k, v in columns.items()}), x, most=None if "key" in columns else self._most(x))

    def union(self, *x: DataFrame) -> DataFrame:
        return self._from(union(*x), *x, most=sum(map(self._most, x)))

    def step(self, x: DataFrame, step) -> DataFrame:
        """A recurrence: its rows are written, since Python made them and counting or joining them would do so again."""
        out = kept(rec.keyed(x, step), "rows-step")
        self.largest.append((out, self._most(x)))
        return out


def word_count_plain(g, x):
    """The running counts of words alone."""
    return g.op("count", g.map(x, key=f"pmod(key + metric + sequence, {KEYS})", metric="1", aux="metric"))


def word_count(g, x):
    return g.step(word_count_plain(g, x), rec.dense_value("WC.DenseValue", 6, True))


def fraud(g, x):
    return g.step(g.map(x, metric="metric + pmod(aux, 64)", aux="sequence"), rec.predict)


def spikes(g, x):
    return g.op("spike_detection", g.map(g.step(g.map(x, aux=str(BATCH)), rec.moving_average), aux="30"))


def traffic(g, x):
    x = g.map(x, metric="20 + pmod(metric, 80)", aux="aux * 1024 + pmod(sequence, 1024)")
    x = g.step(g.op("map_match", x), rec.dense_map("TM.SegmentCache", 1, 2, BATCH, 4))
    return g.step(g.op("speed_calculate", x, wrap=True), rec.dense_reduce_map("TM.TrafficPressure", 2, BATCH, 5))


def logs(g, x):
    geo = g.op("geo_status", g.op("geo_finder", g.map(x, metric="aux", aux="metric")))
    status = "(200 + pmod(category, 5) * 100)"
    statuses = g.op("status_counter", g.map(x, key=f"pmod(key * 131 + {status} + sequence, {KEYS})", metric=status, aux="metric"))
    volumes = g.op("volume_counter", g.map(x, key=f"pmod(key * 17 + sequence // {BATCH}, {KEYS})", metric="1", aux=f"sequence // {BATCH}"))
    return g.union(geo, statuses, volumes)


def voice(g, x):
    turned = g.map(x, key="aux", aux="key")
    rcrf, ecrf, encr = g.op("rcrf", x), g.op("ecrf", turned), g.op("encr", x)
    ct24, ecr24 = g.op("ct24", x), g.op("ecr24", turned)
    shared = g.op("global_acd", g.map(x, key=f"pmod(sequence * 17 + aux, {SHARDS})"))
    url = g.op("url", g.union(ecrf, encr))
    acd = g.op("acd", g.union(ct24, ecr24, shared))
    return g.op("score", g.union(g.op("fofir", rcrf), url, acd))


def roads_until_tolls(g, x, notified):
    x = g.map(x, key=f"pmod(aux + key, {KEYS})", metric="10 + pmod(metric, 90)")
    last = g.op("last_average_speed", g.op("average_speed", x))
    accidents = notified(g, g.op("accident_notification", g.union(g.op("accident_detection", x), g.op("count_vehicles", x))))
    return g.op("account_balance", g.op("toll_notification", g.union(last, accidents, g.op("daily_expenses", x))))


def roads(g, x):
    balance = roads_until_tolls(g, x, lambda g, x: g.step(x, rec.dense_map("LR.IncidentIndex", 1, 2, BATCH, 4)))
    return g.step(balance, rec.dense_reduce_map("LR.AccountPressure", 2, BATCH, 5))


def roads_plain(g, x):
    """The road application without its hashed stages."""
    return roads_until_tolls(g, x, lambda g, x: x)


APPLICATIONS = {"app_wc": word_count, "app_wc_plain": word_count_plain, "app_fd": fraud, "app_sd": spikes, "app_tm": traffic, "app_lg": logs, "app_vs": voice, "app_lr": roads, "app_lr_plain": roads_plain}
STEPS = {
    "predict": rec.predict,
    "moving_average": rec.moving_average,
    "dense_value": rec.dense_value("WC.DenseValue", 6, True),
    "dense_map": rec.dense_map("TM.SegmentCache", 1, 2, BATCH, 4),
    "dense_reduce_map": rec.dense_reduce_map("TM.TrafficPressure", 2, BATCH, 5),
}


def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose category falls in a set of residues."""
    return rows(spark, sf_dir).where(F.pmod("category", F.lit(5)).isin(1, 3))


QUERIES = {
    **{f"mod_{n}": (lambda spark, sf_dir, m=m: m.apply(rows(spark, sf_dir))) for n, m in MODULES.items()},
    **{f"mod_{n}": (lambda spark, sf_dir, s=s: rec.keyed(rows(spark, sf_dir), s)) for n, s in STEPS.items()},
    **{n: (lambda spark, sf_dir, f=f: f(Spark(), rows(spark, sf_dir))) for n, f in APPLICATIONS.items()},
    "mod_category_filter": category_filter,
}
ORACLE_SQL = application_sql.ORACLE_SQL
