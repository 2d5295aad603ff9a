"""Registered queries over the star schema, events, vectors and documents, and their DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.operators import groups, joins, slices
from tessera.plans.deeper import DEEPER
from tessera.plans.shared_sql import SHARED
from tessera.plans.wider import WIDER
from tessera.sources.tables import TABLES, table
from tessera.streaming import windows

#: Parts of a nation's suppliers, each a join key with all suppliers of the nation on the other side.
NATION_PARTS = 64

NAMES = re.compile(rf"\b({'|'.join(TABLES)})\b")


def by_sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query of SQL text over the tables it names. They are given as arguments, so no view of the caller's is touched."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        named = {name: table(spark, sf_dir, name) for name in set(NAMES.findall(text))}
        return spark.sql(NAMES.sub(r"{\1}", text), **named)

    return run


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered scan, then one partial and one final hash aggregate over six groups."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        table(spark, sf_dir, "lineitem")
        .filter(F.col("l_shipdate") <= F.lit("2001-09-01").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            F.round(F.sum(net), 2).alias("sum_disc_price"),
            F.round(F.sum(net * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count("*").alias("count_order"),
        )
    )


def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    clicks, buys = (events.filter(F.col("event_type") == t) for t in ("click", "purchase"))
    return slices.asof_join(buys.select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", "ts", ["event_id", "value"]).select("event_id", "r_event_id", "r_value")


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    bands = table(spark, sf_dir, "supplier").select("s_suppkey", (F.abs("s_acctbal") / 10).alias("low"), (F.abs("s_acctbal") / 10 + 2).alias("high"))
    return joins.range_join(parts, bands, [], "p_retailprice", "low", "high", 2.0).select("p_partkey", "s_suppkey")


def orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT IN as an anti join: Spark would broadcast every line's key."""
    return joins.not_in(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")


def poorer_of_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of suppliers of a nation, the poorer one first. The few nations are cut into parts, so that the pairs are made in many tasks, and by merging, in bounded memory."""
    side = lambda name: table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_suppkey").alias(name), F.col("s_acctbal").alias(f"{name}_bal"))
    pairs = joins.salted_join(side("a"), side("b").hint("merge"), ["s_nationkey"], NATION_PARTS)
    return pairs.filter("a_bal < b_bal").select("a", "b")


def salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_quantity")
    sold = joins.salted_join(lines, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), ["l_suppkey"], 4)
    return sold.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


def top_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.top_per_group(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.asc("event_id")], 3)


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", "6 hours")


def hot_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.salted_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_orderkey")


def pivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = ["click", "error", "purchase", "signup", "view"]
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", types).agg(F.count(F.lit(1))).na.fill(0, types)


def unpivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").unpivot("doc_id", ["quality", "toxic"], "mark", "value")


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.counts(table(spark, sf_dir, "events"), "1 day")


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.counts(table(spark, sf_dir, "events"), "2 hours", "1 hour")


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily counts again, from the table replayed as a stream with a watermark."""
    schema = table(spark, sf_dir, "events").schema
    return windows.replay(spark, sf_dir, schema, lambda s: windows.counts(s, "1 day", late="10 minutes"), glob="events.parquet")


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", " ")
    docs = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    return docs.select("doc_id", F.size("w").cast("bigint").alias("n"), F.get("w", F.lit(0)).alias("first"), F.size(F.array_distinct("w")).cast("bigint").alias("distinct_n"), F.array_join(F.slice("w", 2, 3), "+").alias("part"))


def exploded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", " ")).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))


def vector_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector and its label's first vector."""
    vecs = table(spark, sf_dir, "embeddings")
    first = vecs.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor"))
    return vecs.join(first, "label").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("anchor")), 4).alias("similarity"))


def vectorised_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pandas UDF over Arrow batches."""

    @F.pandas_udf("double")
    def discounted(price: pd.Series, discount: pd.Series) -> pd.Series:
        return price * (1 - discount)

    net = discounted("l_extendedprice", "l_discount")
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.round(F.sum(net), 2).alias("revenue"))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"))


DAILY = """
    SELECT time_bucket(INTERVAL '{width}', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"""

OWN: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "pricing_summary": (
        pricing_summary,
        """
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
               round(sum(l_extendedprice), 2) AS sum_base_price,
               round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
               round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
               round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-01'
        GROUP BY l_returnflag, l_linestatus""",
    ),
    "asof_join": (
        asof,
        """
        SELECT b.event_id, c.event_id AS r_event_id, c.value AS r_value
        FROM (SELECT * FROM events WHERE event_type = 'purchase') b
        ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON b.user_id = c.user_id AND b.ts >= c.ts""",
    ),
    "range_join": (ranges, "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice BETWEEN abs(s_acctbal) / 10 AND abs(s_acctbal) / 10 + 2"),
    "not_in_subquery": (orders_without_lines, SHARED["not_in_subquery"]),
    "theta_join": (poorer_of_nation, SHARED["theta_join"]),
    "salted_join": (salted, "SELECT s_nationkey, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey"),
    "top_per_group": (
        top_events,
        """
        SELECT user_id, event_id, value, rank FROM (
            SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) t WHERE rank <= 3""",
    ),
    "sessions": (
        user_sessions,
        """
        SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM (
            SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
                SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events) a) b
        GROUP BY user_id, s""",
    ),
    "salted_distinct": (hot_distinct, "SELECT l_returnflag, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_distinct FROM lineitem GROUP BY l_returnflag"),
    "pivot": (
        pivoted,
        "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id",
    ),
    "unpivot": (unpivoted, "SELECT doc_id, 'quality' AS mark, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels"),
    "tumbling_window": (tumbling, DAILY.format(width="1 day")),
    "sliding_window": (
        sliding,
        """
        SELECT time_bucket(INTERVAL '1 hour', ts) - h * INTERVAL '1 hour' AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total
        FROM events, (SELECT unnest([0, 1]) AS h) GROUP BY ALL""",
    ),
    "streaming_tumbling_window": (streamed, DAILY.format(width="1 day")),
    "json_fields": (json_fields, "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1"),
    "array_functions": (
        array_functions,
        """
        SELECT doc_id, len(w) AS n, w[1] AS first, len(list_distinct(w)) AS distinct_n, array_to_string(list_slice(w, 2, 4), '+') AS part
        FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents) t""",
    ),
    "exploded_words": (
        exploded_words,
        "SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents) t GROUP BY lang, word",
    ),
    "vector_similarity": (
        vector_similarity,
        """
        SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(anchor AS DOUBLE[])) /
               (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(anchor AS DOUBLE[]), CAST(anchor AS DOUBLE[])))), 4) AS similarity
        FROM embeddings JOIN (SELECT label, arg_min(embedding, vec_id) AS anchor FROM embeddings GROUP BY label) a USING (label)""",
    ),
    "vectorised_udf": (vectorised_udf, "SELECT l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_linestatus"),
    "listed_values": (listed, "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
}

QUERIES = {name: by_sql(text) for name, text in SHARED.items()} | {name: run for name, (run, _) in (OWN | WIDER | DEEPER).items()}
ORACLE_SQL = dict(SHARED) | {name: text for name, (_, text) in (OWN | WIDER | DEEPER).items() if text}
