"""Queries of the operators that work in several passes: hot keys, intervals, sketches, quantiles, samples, reachable pairs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import neighbours, overlaps, quantiles, reach, samples, shredding, sketches, slices
from tessera.sources import segments
from tessera.sources.saved import saved
from tessera.sources.shared import fresh_path
from tessera.sources.tables import table
from tessera.streaming import timers, windows

#: Rows of a key from which these queries cut it, so that each of their few keys is cut on any tables.
SLICE_ROWS = 300


def hot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last click before each purchase, of all users whose number is as odd: two keys with all rows."""
    events = table(spark, sf_dir, "events").withColumn("odd", F.col("user_id") % 2)
    clicks, buys = (events.filter(F.col("event_type") == t) for t in ("click", "purchase"))
    joined = slices.asof_join(buys.select("event_id", "odd", "ts"), clicks, ["odd"], "ts", "ts", ["event_id", "value"], slice_rows=SLICE_ROWS)
    return joined.select("event_id", "r_event_id", "r_value")


def hot_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events of a type, whoever's: five keys with all rows."""
    return slices.sessions(table(spark, sf_dir, "events"), ["event_type"], "ts", "30 minutes", SLICE_ROWS)


def open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and deliveries of a customer at the same time: an order is open for a day for each 2000 of its price, a delivery lasts as many days as it has items."""
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("double")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", day("o_orderdate").alias("o_low"), (day("o_orderdate") + F.floor(F.col("o_totalprice") / 2000)).alias("o_high"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", day("l_shipdate").alias("l_low"), (day("l_shipdate") + F.col("l_quantity")).alias("l_high"))
    lines = saved(lines.join(orders.select("o_orderkey", "o_custkey"), "o_orderkey").withColumnRenamed("o_orderkey", "l_orderkey"), "lines-of-customers")
    return overlaps.overlap_join(orders, lines, ["o_custkey"], ("o_low", "o_high"), ("l_low", "l_high"), 1.0).select("o_custkey", "o_orderkey", "l_orderkey", "l_partkey")


def sketches_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly sketches rolled up to flags: whether each is within its stated error of the exact answer, the frequencies of all parts among them."""
    share = 0.005
    lines = table(spark, sf_dir, "lineitem").withColumn("month", F.date_trunc("month", F.col("l_shipdate").cast("timestamp")))
    fine = saved(sketches.sketches(lines, ["l_returnflag", "month"], "l_partkey", "l_extendedprice", "l_partkey", share), "monthly-sketches")
    states = saved(sketches.rolled_up(fine, ["l_returnflag"], share), "sketches-by-flag")
    found = states.select("l_returnflag", F.hll_sketch_estimate("hll").alias("d"), F.kll_sketch_get_quantile_double("kll", F.lit(0.9)).alias("q"))
    exact = lines.join(F.broadcast(found), "l_returnflag").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg((F.col("l_extendedprice") <= F.col("q")).cast("int")).alias("below"), F.first("d").alias("d"))
    depth, width = sketches.cell_sizes(share, 0.001)
    parts = lines.groupBy("l_returnflag", "l_partkey").agg(F.count("*").alias("times")).join(F.broadcast(states.select("l_returnflag", "cm")), "l_returnflag")
    over = parts.withColumn("over", sketches.frequency(F.col("cm"), F.col("l_partkey"), depth, width) - F.col("times"))
    checked = over.groupBy("l_returnflag").agg(F.count("*").alias("parts"), F.min("over").alias("least"), F.avg((F.col("over") <= share * F.col("cm.n")).cast("int")).alias("near"))
    both = exact.join(checked, "l_returnflag")
    # three standard errors of 2**12 registers; the normalised rank error of a KLL state of 200; all but one in a thousand frequencies
    return both.select(
        "l_returnflag", "n", "parts", (F.abs(F.col("d") - F.col("parts")) <= 0.05 * F.col("parts")).alias("distinct_near"), (F.abs(F.col("below") - 0.9) <= 0.0265).alias("quantile_near"),
        ((F.col("least") >= 0) & (F.col("near") >= 0.999)).alias("frequencies_near"),
    )


def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = [0.0, 0.01, 0.5, 0.9, 0.999]
    found = quantiles.exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", shares)
    return found.select("l_returnflag", "l_linestatus", *[F.round(F.get("quantiles", F.lit(i)), 4).alias(f"q{i}") for i in range(len(shares))])


def events_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.sampled(table(spark, sf_dir, "events"), ["event_type"], ["event_id"], 100, seed=11).select("event_id", "event_type", "value", "weight")


def trade_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that goods can reach, each nation's customers buying from the two nations where they spend most."""
    t = lambda name: table(spark, sf_dir, name)
    sold = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    spent = sold.groupBy("c_nationkey", "s_nationkey").agg(F.round(F.sum("l_extendedprice"), 0).alias("spent"))
    best = Window.partitionBy("c_nationkey").orderBy(F.desc("spent"), "s_nationkey")
    edges = spent.withColumn("place", F.row_number().over(best)).filter("place <= 2")
    return reach.reachable(edges, "s_nationkey", "c_nationkey")


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 50, among all; checked against brute force in the tests, as SQL can't say which pairs are candidates."""
    vecs = table(spark, sf_dir, "embeddings")
    found = neighbours.nearest(vecs.filter("vec_id % 50 = 0"), vecs, "vec_id", "embedding", 10, 64)
    return found.select("query", "rank", "neighbour", F.round("similarity", 6).alias("similarity"))


def shredded_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties by their frequent paths, what is left of them, and put together again."""
    events = table(spark, sf_dir, "events").select("event_id", "props")
    chosen = shredding.frequent(events, "props")
    names = ["p_" + "_".join(path) for path, _ in chosen]
    out = shredding.shred(events, "props", chosen, names)
    back = shredding.assembled(F.col("rest"), [(path, F.col(name)) for (path, _), name in zip(chosen, names, strict=True)])
    return out.select("event_id", *names, F.to_json("rest").alias("rest"), back.alias("whole"))


def through_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders through the connector, in files of ranges of keys; the filter on keys is the connector's."""
    segments.register(spark)
    path = fresh_path(spark, "segments")
    rows = table(spark, sf_dir, "orders").repartitionByRange("o_orderkey")
    rows.write.format("segments").mode("append").option("path", path).option("key", "o_orderkey").save()
    return spark.read.format("segments").option("path", path).load().filter("o_orderkey >= 400 and o_orderkey < 9000 and o_orderstatus <> 'F'")


def views_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views without a purchase of the user within two hours, from a stream's timers; those whose time is over by the last watermark."""
    name, store = timers.STORE
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    try:
        alone = lambda s: timers.unanswered(s, "view", "purchase", dt.timedelta(hours=2), dt.timedelta(minutes=10))
        return windows.replay(spark, sf_dir, table(spark, sf_dir, "events").schema, alone, "append", glob="events.parquet")
    finally:
        spark.conf.set(name, before)


DEEPER: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "nearest_neighbours": (near_vectors, None),
    "asof_join_of_hot_keys": (
        hot_asof,
        """
        SELECT b.event_id, c.event_id AS r_event_id, c.value AS r_value
        FROM (SELECT *, user_id % 2 AS odd FROM events WHERE event_type = 'purchase') b
        ASOF LEFT JOIN (SELECT *, user_id % 2 AS odd FROM events WHERE event_type = 'click') c ON b.odd = c.odd AND b.ts >= c.ts""",
    ),
    "sessions_of_hot_keys": (
        hot_sessions,
        """
        SELECT event_type, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM (
            SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts) AS s FROM (
                SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events) a) b
        GROUP BY event_type, s""",
    ),
    "overlap_join": (
        open_orders,
        """
        WITH o AS (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS low, floor(o_totalprice / 2000) AS days FROM orders),
        l AS (SELECT l_orderkey, l_partkey, o_custkey, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS low, l_quantity AS days FROM lineitem JOIN o ON l_orderkey = o_orderkey)
        SELECT o.o_custkey, o.o_orderkey, l.l_orderkey, l.l_partkey FROM o JOIN l ON o.o_custkey = l.o_custkey AND o.low <= l.low + l.days AND l.low <= o.low + o.days""",
    ),
    "rolled_up_sketches": (
        sketches_by_flag,
        "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS parts, true AS distinct_near, true AS quantile_near, true AS frequencies_near FROM lineitem GROUP BY l_returnflag",
    ),
    "exact_quantiles": (
        price_quantiles,
        """
        SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.0), 4) AS q0, round(quantile_cont(l_extendedprice, 0.01), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS q2,
               round(quantile_cont(l_extendedprice, 0.9), 4) AS q3, round(quantile_cont(l_extendedprice, 0.999), 4) AS q4 FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    ),
    "stratified_sample": (
        events_sampled,
        """
        SELECT event_id, event_type, value, n / least(n, 100) AS weight FROM (
            SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('11|' || event_id)) AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events) t WHERE place <= 100""",
    ),
    "reachable_nations": (
        trade_reach,
        """
        WITH RECURSIVE spent AS (SELECT c_nationkey, s_nationkey, round(sum(l_extendedprice), 0) AS spent FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
        e AS (SELECT s_nationkey AS a, c_nationkey AS b FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY spent DESC, s_nationkey) AS place FROM spent) t WHERE place <= 2),
        r(a, b, n) AS (SELECT a, b, 1 FROM e UNION SELECT r.a, e.b, r.n + 1 FROM r JOIN e ON r.b = e.a WHERE r.n < 30)
        SELECT a AS s_nationkey, b AS c_nationkey, CAST(min(n) AS BIGINT) AS steps FROM r GROUP BY a, b""",
    ),
    "shredded_json": (
        shredded_props,
        "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS p_k, '{}' AS rest, replace(props, ' ', '') AS whole FROM events",
    ),
    "segments_connector": (through_segments, "SELECT * FROM orders WHERE o_orderkey >= 400 AND o_orderkey < 9000 AND o_orderstatus <> 'F'"),
    "views_without_purchase": (
        views_alone,
        """
        WITH e AS (SELECT * FROM events WHERE event_type IN ('view', 'purchase'))
        SELECT user_id, event_id, ts FROM e v WHERE event_type = 'view' AND ts + INTERVAL 2 HOUR <= (SELECT max(ts) FROM e) - INTERVAL 10 MINUTE
        AND NOT EXISTS (SELECT 1 FROM e p WHERE p.event_type = 'purchase' AND p.user_id = v.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 2 HOUR)""",
    ),
}
