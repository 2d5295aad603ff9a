"""Queries whose text both Spark and DuckDB run as it stands."""

SHARED = {
    "revenue_by_nation": """
        SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name = 'ASIA' GROUP BY n_name""",
    "filtered_sum": """
        SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24""",
    "left_outer_join": """
        SELECT o_orderkey, count(l_linenumber) AS n_lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
    "right_outer_join": """
        SELECT d.doc_id, max(l.quality) AS quality FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.doc_id""",
    "full_outer_join": """
        SELECT coalesce(a.k, b.k) AS k, a.n AS n_customers, b.n AS n_suppliers
        FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey) a
        FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) b ON a.k = b.k""",
    "semi_join": """
        SELECT o_orderpriority, count(*) AS n FROM orders
        WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority""",
    "anti_join": """
        SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "not_in_subquery": """
        SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    "cross_join_of_dimensions": """
        SELECT r_name, s.seg AS segment FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer) s""",
    "theta_join": """
        SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b
        ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal""",
    "scalar_subquery": """
        SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)""",
    "lateral_join": """
        SELECT n_name, t.c_custkey, t.c_acctbal FROM nation,
        LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) t""",
    "recursive_cte": """
        WITH RECURSIVE t(s, k, n) AS (
            SELECT s_suppkey, s_suppkey, CAST(0 AS BIGINT) FROM supplier
            UNION ALL SELECT t.s, p.s_suppkey, t.n + 1 FROM t JOIN supplier p ON p.s_suppkey = CAST(floor(t.k / 2) AS BIGINT) WHERE t.k > 0)
        SELECT s, max(n) AS steps, min(k) AS root FROM t GROUP BY s""",
    "distinct_counts": """
        SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag""",
    "filtered_aggregates": """
        SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, round(avg(value) FILTER (WHERE value <= 50), 6) AS low_avg FROM events GROUP BY event_type""",
    "statistics": """
        SELECT l_shipyear, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_extendedprice), 2) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r
        FROM (SELECT *, CAST(year(l_shipdate) AS BIGINT) AS l_shipyear FROM lineitem) t GROUP BY l_shipyear""",
    "median_and_mode": """
        SELECT s.c_mktsegment, round(s.med, 4) AS med, m.c_nationkey AS most FROM (SELECT c_mktsegment, median(c_acctbal) AS med FROM customer GROUP BY c_mktsegment) s
        JOIN (SELECT c_mktsegment, c_nationkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC, c_nationkey) AS r FROM customer GROUP BY c_mktsegment, c_nationkey) m
        ON s.c_mktsegment = m.c_mktsegment AND m.r = 1""",
    "boolean_and_bit_aggregates": """
        SELECT l_returnflag, bool_and(l_quantity > 0) AS every_q, bool_or(l_discount > 0.09) AS any_d, bit_xor(l_partkey) AS x, bit_and(l_orderkey) AS a, bit_or(l_suppkey) AS o FROM lineitem GROUP BY l_returnflag""",
    "extreme_rows": """
        SELECT user_id, max_by(event_id, ts) AS last_id, min_by(event_id, ts) AS first_id, max_by(event_type, ts) AS last_type FROM events GROUP BY user_id""",
    "null_order": """
        SELECT doc_id, CAST(row_number() OVER (ORDER BY q ASC NULLS LAST, doc_id) AS BIGINT) AS low_first, CAST(row_number() OVER (ORDER BY q DESC NULLS FIRST, doc_id) AS BIGINT) AS high_first
        FROM (SELECT DISTINCT n_nationkey AS doc_id, nullif(n_regionkey, 2) AS q FROM nation) t""",
    "more_date_functions": """
        SELECT o_orderkey, CAST(dayofmonth(o_orderdate) AS BIGINT) AS d, CAST(weekofyear(o_orderdate) AS BIGINT) AS w, last_day(CAST(o_orderdate AS DATE)) AS l,
               CAST(o_orderdate + INTERVAL '2' MONTH AS DATE) AS two_on, CAST(o_orderdate - INTERVAL '1' YEAR AS DATE) AS year_ago, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y
        FROM orders""",
    "more_string_functions": """
        SELECT part.p_partkey, split_part(p_name, ' ', 1) AS one, CAST(ascii(p_brand) AS BIGINT) AS a, repeat(left(p_type, 2), 2) AS r, lower(right(p_type, 3)) AS e, translate(p_brand, 'Bran', '1234') AS t,
               p_type LIKE 'S%' AS s, ltrim(rtrim(concat('  ', p_brand, ' '))) AS b FROM part""",
    "correlated_exists_and_in": """
        SELECT c_custkey FROM customer c WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 2000)
        AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)""",
    "grouping_sets": """
        SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS g FROM lineitem
        GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""",
    "rollup": """
        SELECT n_regionkey, c_mktsegment, round(sum(c_acctbal), 2) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey
        GROUP BY ROLLUP (n_regionkey, c_mktsegment)""",
    "cube": """
        SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    "having": """
        SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12""",
    "ranking_windows": """
        SELECT c_custkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER s AS BIGINT) AS rk, CAST(dense_rank() OVER s AS BIGINT) AS dr,
               CAST(ntile(4) OVER w AS BIGINT) AS q, round(percent_rank() OVER s, 9) AS pr, round(cume_dist() OVER s, 9) AS cd
        FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), s AS (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 1000))""",
    "offset_windows": """
        SELECT event_id, lag(value) OVER w AS prev, lead(value, 2) OVER w AS next2, first_value(value) OVER w AS first_v, nth_value(value, 2) OVER w AS second_v
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "row_frame": """
        SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 2) AS moving
        FROM orders""",
    "range_frame": """
        SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS day_events FROM events""",
    "union_all": """SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier""",
    "union_distinct": """SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier""",
    "intersect": """SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000""",
    "intersect_all": """SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier""",
    "except_distinct": """SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels""",
    "except_all": """SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier""",
    "top_k": """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""",
    "string_functions": """
        SELECT c_custkey, upper(c_name) AS u, substr(c_name, 3, 5) AS s, CAST(length(c_mktsegment) AS BIGINT) AS n, reverse(c_mktsegment) AS r,
               lpad(c_mktsegment, 12, '*') AS p, replace(c_name, '0', 'o') AS z, concat(c_name, '/', c_mktsegment) AS c, md5(c_name) AS m, trim(c_name) AS t
        FROM customer""",
    "date_functions": """
        SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(quarter(o_orderdate) AS BIGINT) AS q,
               CAST(dayofyear(o_orderdate) AS BIGINT) AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, o_orderdate + INTERVAL '3' DAY AS later
        FROM orders""",
    "math_functions": """
        SELECT p_partkey, round(sqrt(p_retailprice), 6) AS s, round(ln(p_retailprice), 6) AS l, round(power(p_size, 2), 3) AS p, abs(-p_size) AS a, p_size % 7 AS m,
               greatest(p_size, 10) AS g, least(p_size, 10) AS e, round(p_retailprice / nullif(p_size - 5, 0), 6) AS d FROM part""",
    "case_and_nulls": """
        SELECT doc_id, CASE WHEN n_chars > 5000 THEN 'long' WHEN n_chars > 500 THEN 'mid' ELSE 'short' END AS size_class, nullif(lang, 'en') AS other, coalesce(nullif(source, 'src0'), '-') AS src
        FROM documents""",
    "casts": """SELECT event_id, CAST(floor(value) AS INTEGER) AS i, CAST(user_id AS VARCHAR(20)) AS u, CAST(ts AS DATE) AS d FROM events""",
}
