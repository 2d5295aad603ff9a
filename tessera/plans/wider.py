"""Queries whose Spark and DuckDB forms differ: expressions, Python operators, formats and streams, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import frames, groups, joins, quantiles
from tessera.sources import formats
from tessera.sources.shared import fresh_path
from tessera.sources.tables import table
from tessera.streaming import windows


def regular_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url")
    return rows.select(
        "page_id",
        F.regexp_extract("url", r"://([^/]+)", 1).alias("host"),
        F.regexp_replace("url", r"[0-9]+", "#").alias("masked"),
        F.regexp_count("url", F.lit(r"[/?=]")).cast("long").alias("marks"),
        F.regexp_like("url", F.lit(r"\d{3}")).alias("numbered"),
        F.size(F.regexp_extract_all("url", F.lit(r"[a-z]+"), F.lit(0))).cast("long").alias("words"),
    )


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    held = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    often = F.map_filter("m", lambda k, v: v >= 10)
    return held.select("user_id", F.cardinality("m").cast("long").alias("kinds"), F.try_element_at("m", F.lit("click")).alias("clicks"), F.array_join(F.sort_array(F.map_keys(often)), ",").alias("often"), F.aggregate(F.map_values(F.transform_values("m", lambda k, v: v * 2)), F.lit(0).cast("long"), lambda a, x: a + x).alias("doubled"))


def json_there_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return parsed.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct((F.col("p.k") + 1).alias("next"))).alias("j"))


def higher_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    lengths = F.transform("w", F.length)
    return words.select(
        "doc_id",
        F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n).alias("letters"),
        F.size(F.filter("w", lambda x: F.length(x) > 6)).cast("long").alias("long_words"),
        F.exists("w", lambda x: x == "the").alias("has_the"),
        F.forall("w", lambda x: F.length(x) > 0).alias("no_empty"),
        F.array_max(F.zip_with("w", lengths, lambda x, n: F.when(x.startswith("t"), n))).cast("long").alias("longest_t"),
    )


def exploded_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("place", "word"))
    return rows.select("item_id", F.col("place").cast("long").alias("place"), "word")


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By narrowing histograms: the percentile aggregate keeps a flag's distinct prices in one buffer."""
    found = quantiles.exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.9, 0.25])
    return found.select("l_returnflag", *[F.round(F.get("quantiles", F.lit(i)), 4).alias(name) for i, name in enumerate(("p90", "p25"))])


def sketched_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sketches are within their stated errors (three standard errors of the distinct counts, the accuracy of the quantile)."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey", F.lit(14))).alias("h"),
        F.percentile_approx("l_orderkey", 0.5, 1000).alias("m"),
    )
    # apart: beside an exact distinct count, Spark keeps the sketches of each different value
    exact = lines.select("l_returnflag", "l_partkey").distinct().groupBy("l_returnflag").agg(F.count("l_partkey").alias("n"))
    median = F.broadcast(rows.select("l_returnflag", "m"))  # three rows
    ranks = lines.join(median, "l_returnflag").groupBy("l_returnflag").agg(F.avg((F.col("l_orderkey") <= F.col("m")).cast("int")).alias("below"))
    near = lambda c, share: F.abs(F.col(c) - F.col("n")) <= share * F.col("n")
    return rows.join(exact, "l_returnflag").join(ranks, "l_returnflag").select("l_returnflag", near("a", 0.06).alias("approx"), near("h", 0.03).alias("hll"), (F.abs(F.col("below") - 0.5) <= 0.01).alias("quantile"))


def ordered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_acctbal", "c_custkey"))), lambda x: x["c_custkey"].cast("string")), ">").alias("ids"))


def last_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.last(F.when(F.col("value") > 80, F.col("value")), ignorenulls=True).over(before).alias("last_high"))


def soon_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kind = lambda t, name: events.filter(F.col("event_type") == t).select("user_id", F.col("event_id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_ts"))
    return joins.interval_join(kind("view", "view"), kind("purchase", "buy"), ["user_id"], "view_ts", "buy_ts", 7200).select("user_id", "view_id", "buy_id")


def days_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").filter("value > 97").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return groups.fill_gaps(days, ["event_type"], "day", "1 day", "n", 0)


def grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not rounded: exact results often lie halfway between two roundings."""
    return frames.centred(table(spark, sf_dir, "events"), "user_id", "event_id", "value")


def cogrouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    shares = frames.share_of_other(events.filter("event_type = 'purchase'"), events.filter("event_type = 'view'"), "user_id", "value")
    return shares.select("user_id", F.round(F.when(~F.isnan("share"), F.col("share")), 6).alias("share"))


def arrow_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.arrow_filter(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 600.0)


def arrow_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.arrow_udf("double")
    def net(price: pa.Array, discount: pa.Array) -> pa.Array:
        return pc.multiply(price, pc.subtract(1.0, discount))

    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.round(F.sum(net("l_extendedprice", "l_discount")), 2).alias("revenue"))


def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("tessera_split", frames.Split)
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, CAST(place AS BIGINT) AS place, word FROM nation, LATERAL tessera_split(n_name)")


def through(fmt: str) -> Callable[[SparkSession, str], DataFrame]:
    """A table written in a format and read back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, path = table(spark, sf_dir, "customer"), fresh_path(spark, fmt)
        if fmt == "text":
            rows = rows.select(F.concat_ws("|", "c_custkey", "c_name").alias("value"))
        formats.write(rows, path, fmt)
        return formats.read(spark, path, fmt, rows.schema)

    return run


def stream(transform, output: str = "append") -> Callable[[SparkSession, str], DataFrame]:
    """A query over the events as a stream."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return windows.replay(spark, sf_dir, table(spark, sf_dir, "events").schema, transform, output, glob="events.parquet")

    return run


def deduplicated(events: DataFrame) -> DataFrame:
    return windows.latest_by_key(events.unionByName(events), "31 days").select("event_id", "user_id", "event_type", "value")


def bought_after_view(events: DataFrame) -> DataFrame:
    kind = lambda t: events.filter(F.col("event_type") == t)
    return windows.followed(kind("view"), kind("purchase"), "2 hours", "10 minutes")


def last_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = windows.replay(spark, sf_dir, table(spark, sf_dir, "events").schema, windows.totals, "update", glob="events.parquet", keys=["user_id"])
    return last.select("user_id", "n", F.round("total", 4).alias("total"))


FOLLOWED = """
        SELECT v.user_id, v.event_id AS {a}, b.event_id AS {b} FROM events v JOIN events b ON v.user_id = b.user_id
        WHERE v.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= v.ts AND b.ts <= v.ts + INTERVAL 2 HOUR"""
#: In append mode, windows that end before the watermark are out; the last batch without rows brings it there.
CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"

WIDER: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "regular_expressions": (
        regular_expressions,
        """
        SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, regexp_replace(url, '[0-9]+', '#', 'g') AS masked, len(regexp_extract_all(url, '[/?=]')) AS marks,
               regexp_matches(url, '\\d{3}') AS numbered, len(regexp_extract_all(url, '[a-z]+')) AS words FROM pages""",
    ),
    "map_functions": (
        maps,
        """
        SELECT user_id, count(*) AS kinds, max(n) FILTER (WHERE event_type = 'click') AS clicks, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (WHERE n >= 10), '') AS often, CAST(2 * sum(n) AS BIGINT) AS doubled
        FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) t GROUP BY user_id""",
    ),
    "json_there_and_back": (
        json_there_and_back,
        "SELECT event_id, k, '{\"next\":' || (k + 1) || '}' AS j FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) t",
    ),
    "higher_order_functions": (
        higher_order,
        """
        SELECT doc_id, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS letters, len(list_filter(w, lambda x: length(x) > 6)) AS long_words, list_contains(w, 'the') AS has_the,
               NOT list_contains(w, '') AS no_empty, list_max(list_transform(w, lambda x: CASE WHEN starts_with(x, 't') THEN length(x) END)) AS longest_t
        FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents) t""",
    ),
    "exploded_places": (
        exploded_places,
        "SELECT item_id, CAST(unnest(range(0, len(w))) AS BIGINT) AS place, unnest(w) AS word FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark) t",
    ),
    "percentiles": (percentiles, "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25 FROM lineitem GROUP BY l_returnflag"),
    "sketched_counts": (sketched_counts, "SELECT l_returnflag, true AS approx, true AS hll, true AS quantile FROM lineitem GROUP BY l_returnflag"),
    "ordered_list": (ordered_list, "SELECT c_nationkey, string_agg(CAST(c_custkey AS VARCHAR), '>' ORDER BY c_acctbal, c_custkey) AS ids FROM customer GROUP BY c_nationkey"),
    "last_value_ignoring_nulls": (
        last_known,
        """
        SELECT event_id, last_value(CASE WHEN value > 80 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_high
        FROM events""",
    ),
    "interval_join": (soon_after, FOLLOWED.format(a="view_id", b="buy_id")),
    "gap_filling": (
        days_with_gaps,
        """
        SELECT e.event_type, e.day, count(x.ts) AS n
        FROM (SELECT event_type, CAST(unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day FROM events WHERE value > 97 GROUP BY event_type) e
        LEFT JOIN (SELECT * FROM events WHERE value > 97) x ON x.event_type = e.event_type AND CAST(x.ts AS DATE) = e.day GROUP BY e.event_type, e.day""",
    ),
    "grouped_map": (grouped_map, "SELECT user_id, event_id, value - avg(value) OVER (PARTITION BY user_id) AS value FROM events"),
    "cogrouped_map": (
        cogrouped_map,
        """
        SELECT user_id, round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0) / nullif(sum(value) FILTER (WHERE event_type = 'view'), 0), 6) AS share
        FROM events WHERE event_type IN ('purchase', 'view') GROUP BY user_id""",
    ),
    "arrow_batches": (arrow_batches, "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice >= 600"),
    "arrow_function": (arrow_function, "SELECT l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_linestatus"),
    "table_function": (table_function, "SELECT n_nationkey, CAST(unnest(range(0, len(w))) AS BIGINT) AS place, unnest(w) AS word FROM (SELECT n_nationkey, string_split(n_name, ' ') AS w FROM nation) t"),
    "csv_there_and_back": (through("csv"), "SELECT * FROM customer"),
    "json_lines_there_and_back": (through("json"), "SELECT * FROM customer"),
    "orc_there_and_back": (through("orc"), "SELECT * FROM customer"),
    "parquet_there_and_back": (through("parquet"), "SELECT * FROM customer"),
    "text_there_and_back": (through("text"), "SELECT c_custkey || '|' || c_name AS value FROM customer"),
    "streaming_append_window": (
        stream(lambda s: windows.counts(s, "1 day", late="10 minutes")),
        f"""
        SELECT * FROM (SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL) t
        WHERE window_start + INTERVAL 1 DAY <= {CLOSED}""",
    ),
    "streaming_sliding_window": (
        stream(lambda s: windows.counts(s, "2 hours", "1 hour", late="10 minutes")),
        f"""
        SELECT * FROM (SELECT time_bucket(INTERVAL '1 hour', ts) - h * INTERVAL '1 hour' AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total
                       FROM events, (SELECT unnest([0, 1]) AS h) GROUP BY ALL) t WHERE window_start + INTERVAL 2 HOUR <= {CLOSED}""",
    ),
    "streaming_sessions": (
        stream(lambda s: windows.session_counts(s, "6 hours", late="10 minutes")),
        f"""
        SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM (
            SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
                SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events) a) b
        GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= {CLOSED}""",
    ),
    "streaming_dedup": (stream(deduplicated), "SELECT event_id, user_id, event_type, value FROM events"),
    "streaming_interval_join": (stream(bought_after_view), FOLLOWED.format(a="first_id", b="second_id")),
    "streaming_keyed_state": (last_totals, "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id"),
}
