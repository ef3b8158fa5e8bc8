"""Queries of joins and groups by time: as-of joins, overlapping intervals, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from horizonspark.functions.sql import register
from horizonspark.operators.asof import asof_join as asof
from horizonspark.operators.intervals import first_match, interval_join, micros
from horizonspark.operators.islands import islands
from horizonspark.operators.quantiles import exact_quantiles
from horizonspark.plans import sql as S
from horizonspark.sources import tables
from horizonspark.sources.store import work_folder

HOUR = 3_600_000_000


def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order, its customer's last line shipped by the order's day, and the next from that day on."""
    orders = tables.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    lines = tables.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.to_date("l_shipdate").alias("shipped"))
    owner = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("owner"))
    lines = lines.join(owner, "l_orderkey")
    out = asof(orders, lines, {"o_custkey": "owner"}, ("day", "shipped"), ["shipped", "l_orderkey", "l_linenumber", "l_extendedprice"], ["l_orderkey", "l_linenumber", "l_extendedprice"], "last", "next")
    named = [F.col(f"{d}.{c}").alias(f"{d}_{n}") for d in ("last", "next") for c, n in (("shipped", "shipped"), ("l_orderkey", "order"), ("l_linenumber", "line"), ("l_extendedprice", "price"))]
    return out.select("o_orderkey", "day", *named)


def _open_lines(spark: SparkSession, sf_dir: str, customers: DataFrame) -> DataFrame:
    """Lines of some customers (o_custkey) as spans of time in the years of the events: from order to shipping (or the other way round), with hours of their own."""
    o = tables.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(customers, "o_custkey", "left_semi")
    i = tables.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    at = lambda c: micros(F.col(c)) + F.lit(tables.SHIFT * 24 * HOUR)
    later: Column = F.col("l_linenumber") * F.lit(HOUR)
    return i.select("o_custkey", "l_orderkey", "l_linenumber", "l_returnflag", (F.least(at("o_orderdate"), at("l_shipdate")) + later).alias("opened"), (F.greatest(at("o_orderdate"), at("l_shipdate")) + later * 2).alias("closed"))


def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event, how many lines of the customer of its user's number are open then, and the first of them by line number and order."""
    events = tables.read(spark, sf_dir, "events").select("event_id", "user_id", micros(F.col("ts")).alias("at"))
    users = events.select(F.col("user_id").alias("o_custkey")).distinct()
    pairs = interval_join(events, _open_lines(spark, sf_dir, users), {"user_id": "o_custkey"}, ("at", "at"), ("opened", "closed"))
    found = first_match(pairs, ["event_id"], ["l_linenumber", "l_orderkey", "l_returnflag"], {"l_orderkey": "first_order", "l_linenumber": "first_line", "l_returnflag": "first_flag"})
    return events.select("event_id", "user_id").join(found, "event_id", "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))


#: Microseconds without an event that end an island of one user's events, and of all.
USER_GAP, ALL_GAP = 6 * HOUR, HOUR // 6


def event_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spells of activity of each user, and of all users together (user_id null)."""
    e = tables.read(spark, sf_dir, "events").select("user_id", micros(F.col("ts")).alias("at"))
    own, together = islands(e, ["user_id"], "at", USER_GAP), islands(e, [], "at", ALL_GAP)
    return own.unionByName(together.withColumn("user_id", F.lit(None).cast("bigint"))).select("user_id", F.col("island_start").alias("first_at"), F.col("island_end").alias("last_at"), F.col("n_rows").alias("n_events"))


PROBABILITIES = [0.1, 0.5, 0.9]


def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of line prices, by return flag and in all (flag null)."""
    lines = tables.read(spark, sf_dir, "lineitem")
    folder = work_folder(spark, "quantiles")
    by_flag = exact_quantiles(lines, ["l_returnflag"], "l_extendedprice", PROBABILITIES, folder, few=10_000)
    whole = exact_quantiles(lines, [], "l_extendedprice", PROBABILITIES, folder, few=10_000)
    both = by_flag.unionByName(whole.withColumn("l_returnflag", F.lit(None).cast("string")))
    return both.select("l_returnflag", "probability", F.round("quantile", 6).alias("quantile"), "n")


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of last week's demand as a forecast, and how the hours of each weekday's events differ from those of all, in SQL text by the library's SQL functions."""
    register(spark)
    text = """
        WITH pairs AS (SELECT a.series_id, a.demand AS y, b.demand AS p FROM {daily} a JOIN {daily} b ON b.series_id = a.series_id AND b.date = date_sub(a.date, 7)),
             hours AS (SELECT weekday(date) AS dow, hour, sum(demand) AS v FROM {hourly} GROUP BY 1, 2),
             every AS (SELECT * FROM (SELECT explode(sequence(0, 6)) AS dow, hour, v FROM (SELECT hour, sum(v) AS v FROM hours GROUP BY hour)) WHERE dow IN (SELECT dow FROM hours)),
             both AS (SELECT e.dow, e.hour, coalesce(h.v, 0D) AS own, e.v AS usual FROM every e LEFT JOIN hours h ON h.dow = e.dow AND h.hour = e.hour),
             shares AS (SELECT dow, hour, share_of(own, sum(own) OVER (PARTITION BY dow)) AS own, share_of(usual, sum(usual) OVER (PARTITION BY dow)) AS usual FROM both),
             vectors AS (SELECT dow, transform(array_sort(collect_list(struct(hour, own))), x -> x.own) AS own, transform(array_sort(collect_list(struct(hour, usual))), x -> x.usual) AS usual FROM shares GROUP BY dow)
        SELECT series_id AS name, round(avg(ape(y, p)), 6) AS plain, round(avg(ape_guarded(y, p)), 6) AS guarded, round(avg(ape_floor(y, p)), 6) AS floored, round(avg(clip(p / at_least(y, 1), 0.9, 1.1)), 6) AS ratio FROM pairs GROUP BY series_id
        UNION ALL
        SELECT concat('weekday ', dow), round(total_variation(own, usual), 6), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM vectors"""
    return spark.sql(text, daily=tables.daily_series(spark, sf_dir), hourly=tables.hourly_series(spark, sf_dir))


QUERIES = {f.__name__: f for f in (asof_join, interval_overlap, event_islands, price_quantiles, sql_functions)}

_LINES = "lines AS (SELECT o_custkey, l_orderkey, l_linenumber, l_extendedprice, CAST(l_shipdate AS DATE) AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
SQL = {
    "asof_join": f"""WITH {_LINES}, o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders),
        a AS (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY o_custkey, shipped ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) = 1),
        z AS (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY o_custkey, shipped ORDER BY l_orderkey, l_linenumber, l_extendedprice) = 1)
        SELECT o.o_orderkey, o.day, a.shipped AS last_shipped, a.l_orderkey AS last_order, a.l_linenumber AS last_line, a.l_extendedprice AS last_price,
               z.shipped AS next_shipped, z.l_orderkey AS next_order, z.l_linenumber AS next_line, z.l_extendedprice AS next_price
        FROM o ASOF LEFT JOIN a ON o.o_custkey = a.o_custkey AND o.day >= a.shipped ASOF LEFT JOIN z ON o.o_custkey = z.o_custkey AND o.day <= z.shipped""",
    "interval_overlap": f"""WITH i AS (SELECT o_custkey, l_orderkey, l_linenumber, l_returnflag, least(o_orderdate, l_shipdate) + INTERVAL {tables.SHIFT} DAY + l_linenumber * INTERVAL 1 HOUR AS opened,
                  greatest(o_orderdate, l_shipdate) + INTERVAL {tables.SHIFT} DAY + l_linenumber * INTERVAL 2 HOUR AS closed FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT event_id, user_id, count(l_orderkey) AS n_matches, arg_min(l_orderkey, (l_linenumber, l_orderkey, l_returnflag)) AS first_order, arg_min(l_linenumber, (l_linenumber, l_orderkey, l_returnflag)) AS first_line,
               arg_min(l_returnflag, (l_linenumber, l_orderkey, l_returnflag)) AS first_flag
        FROM events LEFT JOIN i ON o_custkey = user_id AND ts BETWEEN opened AND closed GROUP BY event_id, user_id""",
    "event_islands": f"""WITH e AS (SELECT user_id, epoch_us(ts) AS moment FROM events UNION ALL SELECT NULL, epoch_us(ts) FROM events),
        g AS (SELECT *, moment - lag(moment) OVER (PARTITION BY user_id ORDER BY moment) AS step FROM e),
        i AS (SELECT *, sum(CASE WHEN step IS NULL OR step > CASE WHEN user_id IS NULL THEN {ALL_GAP} ELSE {USER_GAP} END THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY moment) AS island FROM g)
        SELECT user_id, min(moment) AS first_at, max(moment) AS last_at, count(*) AS n_events FROM i GROUP BY user_id, island""",
    "price_quantiles": f"""WITH l AS (SELECT l_returnflag, l_extendedprice AS v FROM lineitem UNION ALL SELECT NULL, l_extendedprice FROM lineitem), q AS (SELECT unnest({PROBABILITIES}::DOUBLE[]) AS probability),
        a AS (SELECT l_returnflag, {", ".join(f"quantile_cont(v, {p}) AS q{i}" for i, p in enumerate(PROBABILITIES))}, count(v) AS n FROM l GROUP BY ALL)
        SELECT l_returnflag, probability, round(CASE probability {" ".join(f"WHEN {p} THEN q{i}" for i, p in enumerate(PROBABILITIES))} END, 6) AS quantile, n FROM a, q""",
    "sql_functions": S.with_(S.DAILY, S.HOURLY, """pairs AS (SELECT a.series_id, a.demand AS y, b.demand AS p FROM daily a JOIN daily b ON b.series_id = a.series_id AND b.date = a.date - 7),
        t AS (SELECT isodow(date) - 1 AS dow, hour, sum(demand) AS v FROM hourly GROUP BY ALL), u AS (SELECT hour, sum(demand) AS v FROM hourly GROUP BY ALL), d AS (SELECT DISTINCT dow FROM t),
        f AS (SELECT d.dow, h.h, coalesce(t.v, 0) / (SELECT sum(v) FROM t x WHERE x.dow = d.dow) AS a, coalesce(u.v, 0) / (SELECT sum(v) FROM u) AS b FROM d CROSS JOIN range(0, 24) h(h) LEFT JOIN t ON t.dow = d.dow AND t.hour = h.h LEFT JOIN u ON u.hour = h.h)""") + """
        SELECT series_id AS name, round(avg(CASE WHEN y <> 0 THEN abs(y - p) / abs(y) END), 6) AS plain, round(avg(CASE WHEN y > 0 THEN abs(y - p) / y END), 6) AS guarded, round(avg(abs(y - p) / greatest(y, 1)), 6) AS floored,
               round(avg(least(greatest(p / greatest(y, 1), 0.9), 1.1)), 6) AS ratio FROM pairs GROUP BY ALL
        UNION ALL SELECT 'weekday ' || dow, round(0.5 * sum(abs(a - b)), 6), NULL, NULL, NULL FROM f GROUP BY dow""",
}
