"""Operational metrics over an event log: hourly buckets, histograms, percentiles, cubes, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..sources.tables import table
from .ordering import placed

#: Upper edges of the value histogram.
EDGES = (50, 100, 250, 500, 1000, 2000, 5000, 10000)


def hour_of(ts="ts"):
    return F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")


def bucket(value):
    """Upper edge of the value's bucket; values beyond the last edge count under the last edge plus one."""
    found = F.lit(EDGES[-1] + 1)
    for edge in reversed(EDGES):
        found = F.when(value <= edge, edge).otherwise(found)
    return found


def hourly(events: DataFrame) -> DataFrame:
    """Mergeable state of each hour and event type."""
    return events.groupBy(hour_of().alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.min("value").alias("low"), F.max("value").alias("high"), F.countDistinct("user_id").alias("users"))


def merged(hours: DataFrame) -> DataFrame:
    """Hourly states folded over the whole range."""
    return hours.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.round(F.try_divide(F.sum("total"), F.sum("n")), 6).alias("mean"))


def histogram_quantiles(events: DataFrame, quantiles=(0.5, 0.95)) -> DataFrame:
    """Upper edge of the first bucket whose running count reaches the quantile; the overflow reports the last edge."""
    counts = events.where("value is not null").groupBy("event_type", bucket(F.col("value")).alias("edge")).agg(F.count("*").alias("n"))
    running = F.sum("n").over(W.Window.partitionBy("event_type").orderBy("edge"))
    total = F.sum("n").over(W.Window.partitionBy("event_type"))
    rows = counts.withColumns({"running": running, "total": total})
    return rows.groupBy("event_type").agg(*(F.least(F.min(F.when(F.col("running") >= q * F.col("total"), F.col("edge"))), F.lit(EDGES[-1])).cast("double").alias(f"p{int(q * 100)}") for q in quantiles))


def daily_zero_filled(events: DataFrame) -> DataFrame:
    """A row for each day of the observed range and event type, zero where nothing happened."""
    days = events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    span = events.agg(F.explode(F.sequence(F.min(F.to_date("ts")), F.max(F.to_date("ts")), F.expr("interval 1 day"))).alias("day"))
    grid = span.join(F.broadcast(events.select("event_type").distinct()))
    return grid.join(days, ["day", "event_type"], "left").select("day", "event_type", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 4).alias("total"))


def weekly(events: DataFrame, first_day: int = 0) -> DataFrame:
    """Weeks that begin on Monday (0) or Sunday (6); partial weeks keep the label but report the days they saw."""
    day = F.to_date("ts")
    back = F.pmod(F.weekday(day) - first_day, F.lit(7)) if first_day else F.weekday(day)
    rows = events.select(day.alias("day"), F.date_sub(day, back).alias("week"), "value")
    return rows.groupBy("week").agg(F.min("day").alias("from_day"), F.max("day").alias("to_day"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _sorted_places(events: DataFrame) -> DataFrame:
    rows = placed(events.select("event_id", "event_type", "value").where("value is not null"), ["event_type"], ["value", "event_id"])
    return rows.select("event_id", "event_type", "value", (F.col("place") - 1).alias("place"), F.col("group_rows").alias("n"))


def percentiles(events: DataFrame) -> DataFrame:
    """Interpolated percentiles and spread of each event type; the values between which to interpolate come from exact places."""
    stats = events.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("deviation"))
    rows = _sorted_places(events)

    def between(q: float):
        at = q * (F.col("n") - 1)
        pick = lambda place: F.max(F.when(F.col("place") == place, F.col("value")))
        low, high = pick(F.floor(at)), pick(F.ceil(at))
        return F.round(low + (high - low) * F.max(at - F.floor(at)), 6)

    picked = rows.groupBy(F.col("event_type").alias("_type")).agg(between(0.5).alias("p50"), between(0.9).alias("p90"), between(0.95).alias("p95"))
    return stats.join(picked, F.col("event_type").eqNullSafe(F.col("_type")), "left").select("event_type", "low", "high", "mean", "p50", "p90", "p95", "deviation")


def nearest_rank(events: DataFrame) -> DataFrame:
    """The percentiles that pick one sorted value: s[n//2], s[int(n*.95)] and s[int(.95*(n-1))]; averages skip zeros."""
    rows = _sorted_places(events)
    pick = lambda at: F.max(F.when(F.col("place") == at, F.col("value")))
    n = F.col("n")
    return rows.groupBy("event_type").agg(pick(F.floor(n / 2)).alias("p50"), pick(F.least(F.floor(n * 0.95), n - 1)).alias("p95"), pick(F.floor((n - 1) * 0.95)).alias("timer_p95"), F.round(F.avg(F.nullif("value", F.lit(0.0))), 6).alias("mean_nonzero"))


def iqr_outliers(events: DataFrame, factor: float = 1.5) -> DataFrame:
    """Values beyond the fences, with quartiles picked as s[n//4] and s[3n//4]; groups of fewer than three have none."""
    rows = _sorted_places(events)
    n = F.col("n")
    fences = rows.where("n >= 3").groupBy("event_type").agg(F.max(F.when(F.col("place") == F.floor(n / 4), F.col("value"))).alias("q1"), F.max(F.when(F.col("place") == F.floor(3 * n / 4), F.col("value"))).alias("q3"))
    spread = (F.col("q3") - F.col("q1")) * factor
    joined = events.join(F.broadcast(fences), "event_type")  # one row an event type
    return joined.where((F.col("value") < F.col("q1") - spread) | (F.col("value") > F.col("q3") + spread)).select("event_id", "event_type", "value", "q1", "q3")


def metric_cube(events: DataFrame) -> DataFrame:
    """Every subset of the dimensions of an hour's events, as the per-key counters of a metrics store."""
    rows = events.select(F.to_date("ts").alias("day"), "event_type", F.concat(F.lit("u"), F.pmod("user_id", F.lit(5))).alias("agent"), "value")
    return rows.cube("day", "event_type", "agent").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("low"), F.max("value").alias("high"), F.grouping_id().cast("int").alias("level"))


def kpis(events: DataFrame) -> DataFrame:
    """Rates against all events and the distribution in percent."""
    counts = events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") == 0).alias("zeros"))
    every = W.Window.partitionBy(F.lit(0))  # a handful of rows, one for each event type
    return counts.select("event_type", "n", F.round(100 * F.col("n") / F.sum("n").over(every), 6).alias("percent"), F.round(F.try_divide("zeros", "n"), 6).alias("zero_rate"), F.dense_rank().over(every.orderBy(F.desc("n"))).alias("place"))


def summary_sets(docs: DataFrame) -> DataFrame:
    """Counts by language, by source, and overall, in one pass."""
    return docs.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def majority_domain(docs: DataFrame) -> DataFrame:
    """Dominant language of each source: the language if alone, ``mixed`` from 80 % on, else ``general``."""
    counts = docs.groupBy("source", "lang").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.Window.partitionBy("source"))
    top = counts.withColumn("share", F.col("n") / total).groupBy("source").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"), F.round(F.max("share"), 3).alias("share"))
    return top.select("source", "lang", "share", F.when(F.col("share") >= 1, F.col("lang")).when(F.col("share") >= 0.8, "mixed").otherwise("general").alias("domain"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Gap-separated sessions of each user."""
    window = F.session_window(F.col("ts").cast("timestamp"), gap)
    return events.groupBy("user_id", window.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n", "total")


def json_properties(events: DataFrame) -> DataFrame:
    """Top-level JSON keys of the properties and how often each is filled."""
    pairs = events.select(F.explode(F.from_json("props", "map<string,string>")).alias("path", "v"))
    return pairs.groupBy("path").agg(F.count("*").alias("n"), F.count_if(F.trim("v") != "").alias("filled"), F.round(F.avg(F.length("v")), 6).alias("avg_chars"), F.countDistinct("v").alias("different"))


def queries() -> dict[str, tuple]:
    def on(name, operator):
        return lambda spark, sf_dir: operator(table(spark, sf_dir, name))

    ev = lambda operator: on("events", operator)
    case = "CASE " + " ".join(f"WHEN value <= {e} THEN {e}" for e in EDGES) + f" ELSE {EDGES[-1] + 1} END"
    hour = "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total, min(value) AS low, max(value) AS high, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2"
    placed = "SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS cnt FROM events WHERE value IS NOT NULL"
    week = "SELECT {w} AS week, min(ts::DATE) AS from_day, max(ts::DATE) AS to_day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1"
    return {
        "hourly_metrics": (ev(hourly), hour),
        "merged_metrics": (ev(lambda e: merged(hourly(e))), f"SELECT event_type, sum(n)::BIGINT AS n, round(sum(total), 4) AS total, min(low) AS low, max(high) AS high, round(sum(total) / sum(n), 6) AS mean FROM ({hour}) GROUP BY 1"),
        "hist_quantile": (
            ev(histogram_quantiles),
            f"""WITH c AS (SELECT event_type, {case} AS edge, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
            r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY edge) AS running, sum(n) OVER (PARTITION BY event_type) AS total FROM c)
            SELECT event_type, least(min(edge) FILTER (WHERE running >= 0.5 * total), {EDGES[-1]})::DOUBLE AS p50, least(min(edge) FILTER (WHERE running >= 0.95 * total), {EDGES[-1]})::DOUBLE AS p95 FROM r GROUP BY 1""",
        ),
        "daily_zero_fill": (
            ev(daily_zero_filled),
            """WITH d AS (SELECT unnest(generate_series(min(ts::DATE), max(ts::DATE), INTERVAL 1 DAY))::DATE AS day FROM events),
            g AS (SELECT * FROM d, (SELECT DISTINCT event_type FROM events)),
            c AS (SELECT ts::DATE AS day, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2)
            SELECT day, event_type, coalesce(n, 0) AS n, round(coalesce(total, 0), 4) AS total FROM g LEFT JOIN c USING (day, event_type)""",
        ),
        "weekly_mon": (ev(weekly), week.format(w="date_trunc('week', ts)::DATE")),
        "weekly_sun": (ev(lambda e: weekly(e, 6)), week.format(w="(ts::DATE - dayofweek(ts)::INT)::DATE")),
        "interp_percentiles": (ev(percentiles), "SELECT event_type, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(stddev_samp(value), 6) AS deviation FROM events GROUP BY 1"),
        "nearest_rank_latency": (
            ev(nearest_rank),
            f"""SELECT event_type, max(value) FILTER (WHERE place = cnt // 2) AS p50, max(value) FILTER (WHERE place = least(floor(cnt * 0.95::DOUBLE), cnt - 1)) AS p95,
            max(value) FILTER (WHERE place = floor((cnt - 1) * 0.95::DOUBLE)) AS timer_p95, round(avg(nullif(value, 0)), 6) AS mean_nonzero FROM ({placed}) GROUP BY 1""",
        ),
        "iqr_outliers": (
            ev(iqr_outliers),
            f"""WITH f AS (SELECT event_type, max(value) FILTER (WHERE place = cnt // 4) AS q1, max(value) FILTER (WHERE place = 3 * cnt // 4) AS q3 FROM ({placed}) WHERE cnt >= 3 GROUP BY 1)
            SELECT event_id, event_type, value, q1, q3 FROM events JOIN f USING (event_type) WHERE value < q1 - (q3 - q1) * 1.5::DOUBLE OR value > q3 + (q3 - q1) * 1.5::DOUBLE""",
        ),
        "metric_cube": (
            ev(metric_cube),
            """SELECT day, event_type, agent, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, grouping(day, event_type, agent)::INT AS level
            FROM (SELECT ts::DATE AS day, event_type, 'u' || (user_id % 5) AS agent, value FROM events) GROUP BY CUBE (day, event_type, agent)""",
        ),
        "kpi_distribution": (ev(kpis), "WITH c AS (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value = 0) AS zeros FROM events GROUP BY 1) SELECT event_type, n, round(100 * n / sum(n) OVER (), 6) AS percent, round(zeros / n, 6) AS zero_rate, dense_rank() OVER (ORDER BY n DESC)::INT AS place FROM c"),
        "harvest_grouping_sets": (on("documents", summary_sets), "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())"),
        "majority_domain": (
            on("documents", majority_domain),
            """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY source) AS share, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang DESC) AS r FROM c),
            t AS (SELECT source, max(lang) FILTER (WHERE r = 1) AS lang, round(max(share), 3) AS share FROM s GROUP BY 1)
            SELECT *, CASE WHEN share >= 1 THEN lang WHEN share >= 0.8 THEN 'mixed' ELSE 'general' END AS domain FROM t""",
        ),
        "event_sessions": (
            ev(sessions),
            """WITH l AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
            s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
            SELECT user_id, min(ts)::TIMESTAMP AS started, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""",
        ),
        "json_properties": (
            ev(json_properties),
            """WITH k AS (SELECT props, unnest(json_keys(props)) AS path FROM events), v AS (SELECT path, json_extract_string(props, '$.' || path) AS v FROM k)
            SELECT path, count(*) AS n, count(*) FILTER (WHERE trim(v) <> '') AS filled, round(avg(length(v)), 6) AS avg_chars, count(DISTINCT v) AS different FROM v GROUP BY 1""",
        ),
    }
