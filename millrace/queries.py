"""The query catalogue: every operator over the test tables, with the SQL that DuckDB must answer alike."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import Function, register_scalar
from .functions.ready import amplify, embed_score, normalise, tokenise, wide_intermediate
from .operators import Cast, ConcatStr, DateTrunc, Dedupe, Drop, Explode, FillNull, Filter, Hash, Join, Mask, Rename, Select, Union, chain
from .plans.contracts import Contract
from .session import prepare
from .sources import ParquetSource
from .sources.sql import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def query(oracle: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    """One text for both engines, unless they differ."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return sql(spark, text, {t: table(spark, sf, t) for t in TABLES if t in text})

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, oracle or text


# Projections, filters and nulls.


@query("SELECT c_name, c_custkey, c_acctbal FROM customer")
def select(spark, sf):
    return Select(["c_name", "c_custkey", "c_acctbal"]).apply(table(spark, sf, "customer"))


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part")
def drop(spark, sf):
    return Drop(["p_size", "p_retailprice"]).apply(table(spark, sf, "part"))


@query("SELECT n_nationkey AS key, n_name AS nation, n_regionkey FROM nation")
def rename(spark, sf):
    return Rename({"n_nationkey": "key", "n_name": "nation"}).apply(table(spark, sf, "nation"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size FROM part")
def cast_text(spark, sf):
    return chain(table(spark, sf, "part"), [Select(["p_partkey", "p_size"]), Cast({"p_size": "string"})])


@query("SELECT o_orderkey, TRY_CAST(o_orderpriority AS BIGINT) AS whole, TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS digit FROM orders")
def cast_lenient(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("whole"), F.substring("o_orderpriority", 1, 1).alias("digit"))
    return Cast({"whole": "int64", "digit": "int64"}).apply(o)


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS l_quantity FROM lineitem")
def cast_strict(spark, sf):
    return chain(table(spark, sf, "lineitem"), [Select(["l_orderkey", "l_linenumber", "l_quantity"]), Cast({"l_quantity": "int32"}, strict=True), Cast({"l_quantity": "double"}, strict=True)])


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 0 AND 255 THEN CAST(p_size AS SMALLINT) END AS p_size FROM part")
def cast_unsigned(spark, sf):
    return chain(table(spark, sf, "part"), [Select(["p_partkey", "p_size"]), Cast({"p_size": "uint8"})])


@query("SELECT * FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R'")
def filter_cmp(spark, sf):
    return Filter("l_quantity > 30 and l_returnflag == 'R'").apply(table(spark, sf, "lineitem"))


@query("SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice <= 50000) AND o_orderpriority <> '1-URGENT'")
def filter_bool(spark, sf):
    return Filter("not (o_orderstatus == 'F' or o_totalprice <= 50000) and o_orderpriority != '1-URGENT'").apply(table(spark, sf, "orders"))


@query("SELECT * FROM lineitem WHERE l_discount > l_tax")
def filter_colcol(spark, sf):
    return Filter("l_discount > l_tax").apply(table(spark, sf, "lineitem"))


@query("SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'R') AS flag FROM lineitem WHERE NOT (nullif(l_returnflag, 'R') = 'A') OR (nullif(l_returnflag, 'R') IS NULL AND l_quantity < 10)")
def filter_null3vl(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.nullif("l_returnflag", F.lit("R")).alias("flag"))
    return chain(li, [Filter("not (flag == 'A') or (is_null(flag) and l_quantity < 10)"), Drop("l_quantity")])


@query("SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_id < 5000")
def filter_time(spark, sf):
    return Filter("ts >= '2024-01-15' and event_id < 5000").apply(table(spark, sf, "events"))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R'")
def filter_select_cast(spark, sf):
    steps = [Filter("l_quantity > 30 and l_returnflag == 'R'"), Select(["l_orderkey", "l_linenumber", "l_quantity"]), Cast({"l_quantity": "int64"}), Cast({"l_quantity": "string"}), Rename({"l_quantity": "quantity"})]
    return chain(ParquetSource(f"{sf}/lineitem.parquet").load(prepare(spark)), steps)


def _gaps(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), '?') AS segment, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0) AS balance FROM customer")
def fill_null(spark, sf):
    return FillNull({"segment": "?", "balance": 0}).apply(_gaps(spark, sf))


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), '?') AS segment, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0) AS balance FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 5000")
def fill_null_filter(spark, sf):
    return chain(_gaps(spark, sf), [FillNull({"segment": "?", "balance": 0}), Filter("segment == '?' or balance > 5000")])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 100000")
def parquet_projection(spark, sf):
    return ParquetSource(f"{sf}/orders.parquet", columns=["o_orderstatus", "o_orderkey"], filters=[("o_totalprice", ">", 100000.0)]).load(prepare(spark))


# Rows.

FIRST = "SELECT event_id, ts, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1"


@query(FIRST)
def dedupe(spark, sf):
    return Dedupe(["user_id", "event_type"], order="event_id").apply(table(spark, sf, "events").drop("props"))


@query(FIRST)
def dedupe_source_order(spark, sf):
    from .operators.rows import ORDER

    e = ParquetSource(f"{sf}/events.parquet", columns=["event_id", "ts", "user_id", "event_type", "value"]).load(prepare(spark), order=True)
    return Dedupe(["user_id", "event_type"]).apply(e).drop(*ORDER)


@query("SELECT DISTINCT nullif(l_returnflag, 'R') AS flag, l_linestatus FROM lineitem")
def dedupe_null_keys(spark, sf):
    li = table(spark, sf, "lineitem").select(F.nullif("l_returnflag", F.lit("R")).alias("flag"), "l_linestatus")
    return Dedupe(["flag", "l_linestatus"]).apply(li)


@query("SELECT item_id, unnest(CASE WHEN l IS NULL OR len(l) = 0 THEN [NULL] ELSE l END) AS words FROM (SELECT item_id, CASE WHEN item_id % 7 = 0 THEN NULL WHEN item_id % 5 = 0 THEN [] ELSE string_split(text, ' ') END AS l FROM benchmark)")
def explode(spark, sf):
    b = table(spark, sf, "benchmark")
    words = F.when(F.col("item_id") % 7 == 0, None).when(F.col("item_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.split("text", " "))
    return Explode("words").apply(b.select("item_id", words.alias("words")))


# Text.

SIZE = "lpad(hex(strlen({0})), 2, '0') || '00000000000000'"


@query(f"SELECT n_nationkey, n_name, sha256(unhex('01' || {SIZE.format('n_name')} || hex(encode(n_name)))) AS hash FROM nation")
def hash_sha256(spark, sf):
    return chain(table(spark, sf, "nation"), [Drop("n_regionkey"), Hash("n_name")])


@query(f"SELECT n_nationkey, n, sha256(unhex('01' || {SIZE.format('CAST(n_nationkey AS VARCHAR)')} || hex(encode(CAST(n_nationkey AS VARCHAR))) || CASE WHEN n IS NULL THEN '00' ELSE '01' || {SIZE.format('n')} || hex(encode(n)) END)) AS digest FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 3 > 0 THEN n_name END AS n FROM nation)")
def hash_sha256_many(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 > 0, F.col("n_name")).alias("n"))
    return Hash(["n_nationkey", "n"], output="digest").apply(n)


@query(None)
def hash_blake3(spark, sf):
    return chain(table(spark, sf, "nation"), [Select(["n_nationkey", "n_name"]), Hash("n_name", algo="blake3")])


@query("SELECT c_custkey, repeat('*', length(c_name)) AS c_name FROM customer")
def mask_redact(spark, sf):
    return chain(table(spark, sf, "customer"), [Select(["c_custkey", "c_name"]), Mask("c_name")])


@query("SELECT c_custkey, repeat('*', greatest(length(c_name) - 4, 0)) || right(c_name, 4) AS c_name, repeat('*', length(c_mktsegment)) AS c_mktsegment FROM customer")
def mask_partial(spark, sf):
    return chain(table(spark, sf, "customer"), [Select(["c_custkey", "c_name", "c_mktsegment"]), Mask("c_name", "partial"), Mask("c_mktsegment", "partial", keep=0)])


@query("SELECT c_custkey, sha256(c_name) AS c_name FROM customer")
def mask_hash(spark, sf):
    return chain(table(spark, sf, "customer"), [Select(["c_custkey", "c_name"]), Mask("c_name", "hash")])


@query("SELECT c_custkey, CAST(NULL AS DOUBLE) AS c_acctbal FROM customer")
def mask_null(spark, sf):
    return chain(table(spark, sf, "customer"), [Select(["c_custkey", "c_acctbal"]), Mask("c_acctbal", "null")])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS name, CASE WHEN c_custkey % 3 > 0 THEN c_name END || '-' || CAST(c_custkey AS VARCHAR) AS tag FROM customer")
def concat_str(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("name"))
    return ConcatStr(["name", "c_custkey"], "-", "tag").apply(c)


def _trunc(unit: str) -> None:
    def run(spark, sf):
        return chain(table(spark, sf, "events"), [Select(["event_id", "ts"]), DateTrunc("ts", unit, output="cut")])

    QUERIES[f"date_trunc_{unit}"] = run
    ORACLES[f"date_trunc_{unit}"] = f"SELECT event_id, ts, date_trunc('{unit}', ts) AS cut FROM events"


for _unit in DateTrunc.UNITS:
    _trunc(_unit)


@query("SELECT event_id, CAST(date_trunc('month', ts) AS DATE) AS day FROM events")
def date_trunc_date(spark, sf):
    return DateTrunc("day", "month").apply(table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day")))


# Combining.


@query("SELECT * FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'O'")
def union(spark, sf):
    o = table(spark, sf, "orders")
    return Union().apply(Filter("o_totalprice > 200000").apply(o), Filter("o_orderstatus == 'O'").apply(o))


@query("SELECT doc_id, lang, upper(source) || '/' || lang AS tag, CAST(n_chars AS VARCHAR) AS size FROM (SELECT doc_id, lang, source, n_chars FROM documents)")
def zip_join(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.upper("source").alias("source"), "n_chars")
    return Join.fold(d, [[Select(["doc_id", "lang"])], [ConcatStr(["source", "lang"], "/", "tag"), Select("tag")], [Cast({"n_chars": "string"}), Rename({"n_chars": "size"}), Select("size")]])


class _Count:
    def setup(self, context):
        return {"rows": 0}

    def __call__(self, state, batch):
        state["rows"] += batch.num_rows

    def finish(self, state):
        return pa.RecordBatch.from_pydict({"rows": pa.array([state["rows"]], pa.int64())})


@query("SELECT count(*) AS rows FROM lineitem")
def finish_count(spark, sf):
    # Each task counts its part; one instance sums the counts, so a single task never reads all rows.
    parts = Function(_Count(), gives={"rows": "int64"}, name="count").apply(table(spark, sf, "lineitem").select("l_orderkey"))
    return parts.agg(F.sum("rows").alias("rows"))


def _upper(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), pc.utf8_upper(batch.column(1))], ["item_id", "text"])


@query("SELECT item_id, upper(text) AS text FROM benchmark")
def batch_function(spark, sf):
    return Function(_upper, gives={"item_id": "int64", "text": "string"}).apply(table(spark, sf, "benchmark").select("item_id", "text"))


def _half(frame: "pandas.DataFrame") -> "pandas.DataFrame":  # noqa: F821
    return frame[frame.c_custkey % 2 == 0]


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 2 = 0")
def frame_function(spark, sf):
    return Function(_half, gives={"c_custkey": "int64", "c_acctbal": "double"}).apply(table(spark, sf, "customer").select("c_custkey", "c_acctbal"))


@query("SELECT p_partkey, p_retailprice * 2 AS twice FROM part")
def scalar_udf(spark, sf):
    register_scalar(prepare(spark), "twice", lambda b: pa.RecordBatch.from_arrays([pc.multiply(b.column(0), 2.0)], ["x"]), "double")
    return sql(spark, "SELECT p_partkey, twice(p_retailprice) AS twice FROM part", {"part": table(spark, sf, "part")})


# Ready-made functions.


@query("SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda t: lower(regexp_replace(regexp_replace(t, '^[!-/:-@\\[-`{-~]+', ''), '[!-/:-@\\[-`{-~]+$', ''))), lambda t: t <> ''), ' ') AS text FROM documents")
def normalise_text(spark, sf):
    return normalise(table(spark, sf, "documents").select("doc_id", "text"), ["text"])


@query("SELECT item_id AS row_id, CAST(i - 1 AS INTEGER) AS token_index, CAST(list_sum(list_transform(parts[1:i], lambda p: strlen(p) + 1)) - 1 - strlen(parts[i]) AS INTEGER) AS token_start, CAST(list_sum(list_transform(parts[1:i], lambda p: strlen(p) + 1)) - 1 AS INTEGER) AS token_end, parts[i] AS token FROM (SELECT item_id, string_split(replace(text, chr(10), ' '), ' ') AS parts, unnest(range(1, len(string_split(replace(text, chr(10), ' '), ' ')) + 1)) AS i FROM benchmark)")
def tokenise_text(spark, sf):
    return tokenise(table(spark, sf, "benchmark"), "text", row="item_id")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount, 0.5 + l_quantity * 2.0 + l_discount * -1.0 AS score FROM lineitem")
def embed_score_query(spark, sf):
    out = embed_score(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), ["l_quantity", "l_discount"], [[2.0], [-1.0]], [0.5])
    return out.withColumn("score", F.col("score"))


ORACLES["embed_score_query"] = "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, round(0.5 + l_quantity * CAST(2.0 AS DOUBLE) + l_discount * CAST(-1.0 AS DOUBLE), 6) AS score FROM lineitem"
QUERIES["embed_score_query"] = lambda spark, sf, f=embed_score_query: f(spark, sf).withColumn("score", F.round("score", 6))


@query("SELECT CAST(p_size AS DOUBLE) * p_size AS p_0_0, p_size * p_retailprice AS p_0_1, p_retailprice * p_retailprice AS p_1_1 FROM part")
def wide_intermediate_query(spark, sf):
    return wide_intermediate(table(spark, sf, "part"), ["p_size", "p_retailprice"])


@query("SELECT c_custkey FROM customer, range(CASE WHEN c_custkey < 500 THEN 1 ELSE 4 END)")
def amplify_query(spark, sf):
    return amplify(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 500)


# The SQL plane.

_sql("sql_join_inner", "SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
_sql("sql_join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 150000")
_sql("sql_join_right", "SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 150000) o RIGHT JOIN customer ON c_custkey = o_custkey")
_sql("sql_join_full", "SELECT a.k AS a, b.k AS b FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey < 100) a FULL JOIN (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey > 3) b ON a.k = b.k")
_sql("sql_join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
_sql("sql_join_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_sql("sql_join_theta", "SELECT n.n_nationkey AS a, m.n_nationkey AS b FROM nation n JOIN nation m ON n.n_regionkey = m.n_regionkey AND n.n_nationkey < m.n_nationkey")
_sql("sql_join_using", "SELECT n_regionkey, n_name, r_name FROM nation JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) r USING (n_regionkey)")
_sql("sql_join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_sql("sql_where_arithmetic", "SELECT event_id, user_id % 7 AS bucket FROM events WHERE user_id % 7 > 3")
_sql("sql_empty", "SELECT 42 AS answer FROM region WHERE r_regionkey < 0")
_sql("sql_group_expr", "SELECT user_id % 10 AS bucket, count(*) AS n FROM events GROUP BY user_id % 10")
_sql("sql_agg", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_extendedprice), 2) AS price, min(l_discount) AS low, max(l_tax) AS high, round(stddev_samp(l_quantity), 4) AS spread, round(var_samp(l_quantity), 4) AS variance FROM lineitem GROUP BY l_returnflag, l_linestatus")
_sql("sql_agg_filter", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
_sql("sql_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_sql("sql_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
_sql("sql_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_sql("sql_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_sql("sql_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 10")
_sql("sql_window_rank", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS d, ntile(3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS t FROM orders",
     "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS n, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INTEGER) AS r, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INTEGER) AS d, CAST(ntile(3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS t FROM orders")
_sql("sql_window_lag", "SELECT event_id, user_id, lag(value, 1) OVER w AS before, lead(value, 2) OVER w AS later, first_value(event_id) OVER w AS first, last_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, nth_value(event_id, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
_sql("sql_window_frame", "SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS running, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS near FROM orders")
_sql("sql_topk", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
_sql("sql_order_offset", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice NULLS LAST, p_partkey LIMIT 15 OFFSET 5")
_sql("sql_union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
_sql("sql_setops", "(SELECT o_custkey AS k FROM orders WHERE o_totalprice > 100000 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) EXCEPT SELECT s_suppkey FROM supplier")
_sql("sql_setops_all", "(SELECT l_linenumber AS k FROM lineitem WHERE l_quantity > 49 INTERSECT ALL SELECT p_size FROM part) EXCEPT ALL SELECT r_regionkey FROM region")
_sql("sql_subquery", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
_sql("sql_cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), v(label, least) AS (VALUES ('low', 0), ('high', 500000)) SELECT label, count(*) AS n FROM big JOIN v ON total >= least GROUP BY label")
_sql("sql_scalar_text", "SELECT c_custkey, upper(c_mktsegment) AS u, substr(c_name, 3, 4) AS s, length(c_name) AS n, replace(c_name, '0', 'o') AS r, trim('  x ') AS t FROM customer", "SELECT c_custkey, upper(c_mktsegment) AS u, substr(c_name, 3, 4) AS s, CAST(length(c_name) AS INTEGER) AS n, replace(c_name, '0', 'o') AS r, trim('  x ') AS t FROM customer")
_sql("sql_scalar_math", "SELECT p_partkey, abs(p_size - 25) AS a, round(sqrt(p_retailprice), 4) AS q, floor(p_retailprice) AS f, round(ln(p_retailprice), 6) AS l, p_size % 4 AS m FROM part", "SELECT p_partkey, abs(p_size - 25) AS a, round(sqrt(p_retailprice), 4) AS q, CAST(floor(p_retailprice) AS BIGINT) AS f, round(ln(p_retailprice), 6) AS l, p_size % 4 AS m FROM part")
_sql("sql_scalar_date", "SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, CAST(ts AS DATE) AS day FROM events", "SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, CAST(ts AS DATE) AS day FROM events")
_sql("sql_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, coalesce(nullif(p_brand, 'Brand#1'), 'none') AS brand FROM part")
_sql("sql_regex", "SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '_') AS t FROM part WHERE regexp_like(p_name, 'a')", "SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS t FROM part WHERE regexp_matches(p_name, 'a')")


@query("SELECT vec_id, len(embedding) AS n, embedding[1] AS first, list_contains(embedding, embedding[3]) AS has FROM embeddings")
def sql_array(spark, sf):
    return sql(spark, "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, embedding[0] AS first, array_contains(embedding, embedding[2]) AS has FROM embeddings", {"embeddings": table(spark, sf, "embeddings")})


@query(None)
def sql_approx_distinct(spark, sf):
    return sql(spark, "SELECT event_type, approx_count_distinct(user_id) AS users FROM events GROUP BY event_type", {"events": table(spark, sf, "events")})


# Governed tables.


def _readings(spark, sf) -> Contract:
    rules = [
        {"op": "decide", "expr": "ctx.purpose == 'analytics'"},
        {"op": "admit", "expr": "ctx.tenant == 'all' || row.event_type == 'click'"},
        {"op": "assert", "name": "value", "expr": "row.value >= 20", "on_fail": "drop"},
        {"op": "transform", "column": "user_id", "expr": "hash_sha256(row.user_id)"},
    ]
    return Contract("demo/events", frame=table(spark, sf, "events"), owner="ops", expose=["event_id", "event_type", "user_id", "value"], rules=rules)


@query("SELECT event_id, event_type, sha256(CAST(user_id AS VARCHAR)) AS user_id, value FROM events WHERE event_type = 'click' AND value >= 20")
def contract_view(spark, sf):
    return _readings(spark, sf).read(spark, {"purpose": "analytics", "tenant": "demo"})


@query("SELECT event_type, count(*) AS n, max(value) AS top FROM events WHERE value >= 20 GROUP BY event_type")
def contract_sql(spark, sf):
    c = _readings(spark, sf)
    return sql(spark, 'SELECT event_type, count(*) AS n, max(value) AS top FROM "demo/events" GROUP BY event_type', {c.name: c.read(spark, {"purpose": "analytics", "tenant": "all"})})


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING count(*) >= 60)")
def contract_suppress(spark, sf):
    c = Contract("demo/customers", frame=table(spark, sf, "customer"), expose=["c_custkey", "c_nationkey"], rules=[{"op": "suppress", "k": 60, "by": "c_nationkey", "unless": "ctx.trusted == true"}])
    return c.read(spark, {"trusted": False})


@query("SELECT event_id, value, CASE WHEN value >= 20 THEN CAST([] AS VARCHAR[]) ELSE ['value'] END AS _violations FROM events")
def contract_violations(spark, sf):
    c = _readings(spark, sf)
    fails = c.asserts({})
    return table(spark, sf, "events").select("event_id", "value", F.array_compact(F.array(*[F.when(f, F.lit(n)) for n, f in fails.items()])).alias("_violations"))
