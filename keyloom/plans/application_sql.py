"""Oracle SQL of the keyed applications and their operators, written apart from the plans: nothing here is made from their
declarations. Every operator is spelt with SQL's own window functions, recurrences with recursive queries."""

from __future__ import annotations

ROWS = "SELECT user_id AS key, CAST(round(value * 100) AS BIGINT) % 1000 + 1 AS metric, event_id % 97 AS aux, event_id % 8 AS category, event_id AS sequence, CAST(0 AS BIGINT) AS branch FROM events"
UP = "OVER (PARTITION BY key ORDER BY sequence, branch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BY = "OVER (PARTITION BY key ORDER BY sequence, branch)"


def mod(x: str, n: int) -> str:
    """A remainder that is never negative."""
    return f"((({x}) % {n} + {n}) % {n})"


def rows(source: str, metric: str, aux: str, key: str = "key") -> str:
    return f"SELECT CAST({key} AS BIGINT) AS key, CAST({metric} AS BIGINT) AS metric, CAST({aux} AS BIGINT) AS aux, category, sequence, branch FROM ({source})"


def seen(source: str) -> str:
    """Rows with their number and running sums."""
    return f"SELECT *, row_number() {BY} AS n, sum(metric) {UP} AS m, sum(aux) {UP} AS a FROM ({source})"


def running_count(s: str) -> str:
    return rows(seen(s), "m", "aux")


def mean(s: str) -> str:
    return rows(seen(s), "m // n", "n")


def numbered(s: str) -> str:
    return rows(seen(s), "n", "aux")


def both(s: str) -> str:
    """The running sum of metric and aux, and the row's number."""
    return rows(seen(s), "m + a", "n")


def balance(s: str) -> str:
    return rows(seen(s), "m", "n")


def times(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition}) {UP}"


def map_match(s: str) -> str:
    return rows(s, "metric", "31 * metric + aux", mod("31 * metric + aux + sequence", 1000))


def geo_finder(s: str) -> str:
    return rows(s, mod("metric + aux", 251), mod("13 * metric + aux", 4096))


def geo_status(s: str) -> str:
    return rows(f"SELECT *, row_number() {BY} AS n, {times(mod('aux', 2) + ' = 1')} AS odd FROM ({s})", "n", "odd")


def status_counter(s: str) -> str:
    return rows(seen(s), "n", "a")


def rcrf(s: str) -> str:
    return rows(f"SELECT *, row_number() {BY} AS n, {times('aux % 4 = 0')} AS hit FROM ({s})", "n", "hit")


def ecrf(s: str) -> str:
    return rows(f"SELECT *, row_number() {BY} AS n, {times('category % 2 = 0')} AS hit FROM ({s})", "n", "hit")


def encr(s: str) -> str:
    return rows(f"SELECT *, sum({mod('metric + aux', 7)}) {UP} AS x, {times('aux % 2 = 0')} AS hit FROM ({s})", "x", "hit")


def ct24(s: str) -> str:
    return rows(seen(s), "n", "m")


def ecr24(s: str) -> str:
    return rows(f"SELECT *, {times('aux % 2 = 0')} AS x, {times('metric % 2 = 0')} AS y FROM ({s})", "x", "y")


def fofir(s: str) -> str:
    return rows(f"SELECT *, sum(metric + aux) {UP} AS x, {times('aux > 4')} AS y FROM ({s})", "x", "y")


def spike_detection(s: str) -> str:
    return rows(f"SELECT *, {times('metric > aux')} AS hits, lag(metric, 1, metric) {BY} AS was FROM ({s})", "hits", "was")


def last_average_speed(s: str) -> str:
    return rows(f"SELECT *, metric - lag(metric, 1, metric) {BY} AS change FROM ({s})", "metric", "change")


def accident_detection(s: str) -> str:
    return rows(f"SELECT *, {times('was = aux')} AS still FROM (SELECT *, lag(aux, 1, aux) {BY} AS was FROM ({s}))", "still", "aux")


def accident_notification(s: str) -> str:
    return rows(f"SELECT *, {times('metric > 0')} AS active FROM ({s})", "active", "aux")


def daily_expenses(s: str) -> str:
    return rows(f"SELECT *, sum({mod('metric + aux', 50)}) {UP} AS x, sum(metric) {UP} AS y FROM ({s})", "x", "y")


def toll_notification(s: str) -> str:
    return rows(f"SELECT *, sum({mod('metric + c', 25)}) {UP} AS x FROM (SELECT *, {times('metric > 40')} AS c FROM ({s}))", "x", "c")


def wrapped(x: str) -> str:
    """A huge integer as a signed 64-bit number."""
    whole, half = "18446744073709551616::HUGEINT", "9223372036854775808::HUGEINT"
    return f"((({x}) + {half}) % {whole} + {whole}) % {whole} - {half}"


_NUMBERED = f"SELECT *, row_number() {BY} AS k FROM"


def predict(s: str) -> str:
    half = "CASE WHEN v < 0 THEN -((-v) // 2) ELSE v // 2 END"
    return f"""WITH RECURSIVE s AS ({_NUMBERED} ({s})),
r AS (SELECT key, category, sequence, branch, k, {half} AS score FROM (SELECT *, CAST(metric AS HUGEINT) AS v FROM s WHERE k = 1)
 UNION ALL SELECT key, category, sequence, branch, k, {half} FROM (SELECT s.*, {wrapped("r.score * 3 + 11 * abs(s.category - r.category) + (abs(s.sequence - r.sequence) & 31) + s.metric")} AS v FROM r JOIN s ON s.key = r.key AND s.k = r.k + 1))
SELECT key, CAST(score AS BIGINT) AS metric, k AS aux, category, sequence, branch FROM r"""


def moving_average(s: str) -> str:
    return f"""WITH RECURSIVE s AS (SELECT *, greatest(aux, 1) AS width FROM ({_NUMBERED} ({s}))),
r AS (SELECT key, k, metric AS average, metric AS held, CAST(1 AS BIGINT) AS n FROM s WHERE k = 1
 UNION ALL SELECT key, k, total // n, CASE WHEN n >= width THEN total // n ELSE total END, CASE WHEN n >= width THEN 1 ELSE n END
 FROM (SELECT s.key, s.k, s.width, r.held + s.metric AS total, least(s.width, r.n + 1) AS n FROM r JOIN s ON s.key = r.key AND s.k = r.k + 1))
SELECT key, average AS metric, aux, category, sequence, branch FROM r JOIN s USING (key, k)"""


def union(*sources: str) -> str:
    return " UNION ALL ".join(f"SELECT key, metric, aux, category, sequence, branch * 4 + {k} AS branch FROM ({s})" for k, s in enumerate(sources))


def word_count(s: str) -> str:
    return running_count(rows(s, "1", "metric", mod("key + metric + sequence", 1000)))


def logs(s: str) -> str:
    status = f"200 + 100 * {mod('category', 5)}"
    return union(
        geo_status(geo_finder(rows(s, "aux", "metric"))),
        status_counter(rows(s, status, "metric", mod(f"131 * key + {status} + sequence", 1000))),
        numbered(rows(s, "1", "sequence // 16", mod("17 * key + sequence // 16", 1000))),
    )


def voice(s: str) -> str:
    turned = rows(s, "metric", "key", "aux")
    by_shard = rows(s, "metric", "aux", mod("17 * sequence + aux", 4096))
    return both(union(fofir(rcrf(s)), both(union(ecrf(turned), encr(s))), balance(union(ct24(s), ecr24(turned), mean(by_shard)))))


def roads(s: str) -> str:
    s = rows(s, f"10 + {mod('metric', 90)}", "aux", mod("aux + key", 1000))
    notices = accident_notification(union(accident_detection(s), numbered(s)))
    return balance(toll_notification(union(last_average_speed(mean(s)), notices, daily_expenses(s))))


def spikes(s: str) -> str:
    return spike_detection(rows(moving_average(rows(s, "metric", "16")), "metric", "30"))


ORACLE_SQL = {
    **{f"mod_{n}": f(ROWS) for n, f in (
        ("count", running_count), ("map_match", map_match), ("speed_calculate", mean), ("geo_finder", geo_finder), ("geo_status", geo_status),
        ("status_counter", status_counter), ("volume_counter", numbered), ("rcrf", rcrf), ("ecrf", ecrf), ("encr", encr), ("ct24", ct24), ("ecr24", ecr24),
        ("global_acd", mean), ("fofir", fofir), ("url", both), ("acd", balance), ("score", both), ("spike_detection", spike_detection), ("average_speed", mean),
        ("last_average_speed", last_average_speed), ("accident_detection", accident_detection), ("count_vehicles", numbered), ("accident_notification", accident_notification),
        ("daily_expenses", daily_expenses), ("toll_notification", toll_notification), ("account_balance", balance), ("predict", predict), ("moving_average", moving_average),
    )},
    "mod_category_filter": f"SELECT * FROM ({ROWS}) WHERE category % 5 IN (1, 3)",
    "app_wc_plain": word_count(ROWS), "app_lg": logs(ROWS), "app_vs": voice(ROWS), "app_lr_plain": roads(ROWS),
    "app_fd": predict(rows(ROWS, f"metric + {mod('aux', 64)}", "sequence")), "app_sd": spikes(ROWS),
}
