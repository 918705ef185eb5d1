"""All queries of the engine proper, by name, over the test tables that stand in for the domain.

customer: accounts; events: balances in order of arrival; orders: transactions; lineitem: their
redelivered versions and labels; part: categories. Each query has the SQL it is held against.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import categorize, classify, flatten, merge
from .plans import migrations, reports, sdl, tables
from .plans.store import Snapshots
from .shared import scratch
from .sources import files, paged, stored_service
from .sources.service import offsets
from .streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
REPORT_MONTH = ("10", "1997")
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def _query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")



def _arrival():
    return F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)
    return _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("reference"), F.col("o_custkey").alias("account_id"), F.col("o_orderstatus").alias("booking_status"),
        F.col("o_orderdate").alias("booking_date"), (sign * F.col("o_totalprice")).alias("amount"),
    )


def _labels_of_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are made for the month's references only, before they are aggregated."""
    wanted = reports.in_month(_transactions(spark, sf_dir), *REPORT_MONTH).select(F.col("reference").alias("l_orderkey"))
    lines = _table(spark, sf_dir, "lineitem").join(wanted, "l_orderkey", "left_semi")
    return lines.groupBy(F.col("l_orderkey").alias("reference")).agg(F.max_by("l_partkey", _arrival()).alias("category_id"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("category"), F.col("p_brand").alias("subcategory"))


@_query("SELECT event_type, avg(value) AS avg_value FROM events GROUP BY event_type")
def avg_by_key(spark, sf_dir):
    return reports.average_by_key(_table(spark, sf_dir, "events"), "event_type", "value", "avg_value")


_INCOME = "CAST(coalesce(sum(CASE WHEN a > 0 THEN a END), 0) AS DOUBLE) AS total_income, CAST(coalesce(sum(CASE WHEN a < 0 THEN -a END), 0) AS DOUBLE) AS total_expenses"


@_query(f"""
WITH last AS (SELECT l_orderkey, arg_max(l_partkey, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS part FROM lineitem GROUP BY l_orderkey),
lines AS (SELECT coalesce(p_type, 'uncategorized') AS category, CAST(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS DECIMAL(18, 2)) AS a
  FROM orders LEFT JOIN last ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = part
  WHERE o_orderdate >= TIMESTAMP '1997-10-01' AND o_orderdate < TIMESTAMP '1997-11-01')
SELECT '10' AS month, '1997' AS year, category, {_INCOME} FROM lines GROUP BY category""")
def monthly_report(spark, sf_dir):
    return reports.reports(_transactions(spark, sf_dir), _labels_of_month(spark, sf_dir), _parts(spark, sf_dir), *REPORT_MONTH)


@_query("""
WITH last AS (SELECT l_orderkey, arg_max(l_partkey, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS part FROM lineitem GROUP BY l_orderkey),
lines AS (SELECT coalesce(p_type, 'uncategorized') AS category, CAST(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS DECIMAL(18, 2)) AS a
  FROM orders LEFT JOIN last ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = part
  WHERE o_orderdate >= TIMESTAMP '1997-10-01' AND o_orderdate < TIMESTAMP '1997-11-01')
SELECT category, CAST(coalesce(sum(CASE WHEN a > 0 THEN a END), 0) AS DOUBLE) AS total_income, 'Report' AS __typename FROM lines GROUP BY category""")
def report_fields(spark, sf_dir):
    return reports.reports(_transactions(spark, sf_dir), _labels_of_month(spark, sf_dir), _parts(spark, sf_dir), *REPORT_MONTH, fields=("category", "total_income"), typename=True)


@_query(f"""
SELECT category, {_INCOME} FROM (SELECT p_type AS category, CAST(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(18, 2)) AS a
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
  WHERE o_orderdate >= TIMESTAMP '1997-10-01' AND o_orderdate < TIMESTAMP '1997-11-01') GROUP BY category""")
def monthly_report_lines(spark, sf_dir):
    orders = reports.in_month(_table(spark, sf_dir, "orders"), *REPORT_MONTH, date="o_orderdate").select("o_orderkey")
    lines = _table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    named = lines.join(_parts(spark, sf_dir), F.col("l_partkey") == F.col("id"))
    return reports.income_and_expenses(named.select("category", (sign * F.col("l_extendedprice")).alias("amount")))


def _versions(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag")


@_query("""
SELECT l_orderkey, first(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS account_id, last(l_extendedprice ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS amount,
  last(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS status FROM lineitem GROUP BY l_orderkey""")
def upsert_keep_account(spark, sf_dir):
    batch = _versions(spark, sf_dir).select("l_orderkey", F.col("l_suppkey").alias("account_id"), F.col("l_extendedprice").alias("amount"), F.col("l_returnflag").alias("status"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    table = batch.select("l_orderkey", "account_id", "amount", "status").limit(0)
    return merge.upsert(table, batch, ["l_orderkey"], _arrival(), keep=("account_id",))


@_query("""
SELECT l_orderkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1""")
def upsert_last_wins(spark, sf_dir):
    return merge.last_of_each(_versions(spark, sf_dir), ["l_orderkey"], _arrival()).select("l_orderkey", "l_suppkey", "l_extendedprice")


@_query("""
SELECT o_orderkey AS reference, CASE WHEN l_orderkey IS NULL THEN o_custkey END AS account_id, coalesce(price, o_totalprice) AS amount
FROM orders LEFT JOIN (SELECT l_orderkey, arg_max(l_extendedprice, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS price FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def replace_rows(spark, sf_dir):
    table = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("reference"), F.col("o_custkey").alias("account_id"), F.col("o_totalprice").alias("amount"))
    batch = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("reference"), F.col("l_extendedprice").alias("amount"), _arrival().alias("at"))
    return merge.replace(table, batch, ["reference"], F.col("at"))


@_query("""
SELECT account_id, day, amount FROM (SELECT user_id AS account_id, CAST(ts AS DATE) AS day, value AS amount, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def insert_ignore_first(spark, sf_dir):
    batch = _table(spark, sf_dir, "events").select(F.col("user_id").alias("account_id"), F.to_date("ts").alias("day"), F.col("value").alias("amount"), "ts", "event_id")
    return merge.insert_ignore(batch.select("account_id", "day", "amount").limit(0), batch, ["account_id", "day"], F.struct("ts", "event_id"))


@_query("SELECT o_orderkey AS reference, o_totalprice AS amount FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_uncategorized(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("reference"), F.col("o_totalprice").alias("amount"))
    return categorize.pending(orders, _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("reference")))


@_query("SELECT o_orderkey AS reference, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS is_categorized FROM orders")
def exists_flag(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("reference"))
    return categorize.with_label_flag(orders, _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("reference")))


@_query("SELECT o_orderkey AS reference FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def semi_categorized(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("reference"))
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("reference")).join(lines, "reference", "left_semi")


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_extract(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int", {"mode": "FAILFAST"})["k"].alias("k"))


@_query("SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1")
def json_group(spark, sf_dir):
    return json_extract(spark, sf_dir).groupBy("k").agg(F.count("*").alias("n"))


@_query("SELECT p_partkey, coalesce(TRY_CAST(regexp_extract(p_brand, '[0-9]+') AS DOUBLE), 0.0) AS number, 0.0::DOUBLE AS name_number FROM part")
def parse_or_zero(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    return part.select("p_partkey", C.parse_or_zero(F.regexp_extract("p_brand", "[0-9]+", 0)).alias("number"), C.parse_or_zero(F.concat(F.lit("x"), "p_name")).alias("name_number"))


@_query("SELECT row_number() OVER (ORDER BY p_type, p_brand)::INTEGER AS id, p_type AS category, p_brand AS subcategory FROM (SELECT DISTINCT p_type, p_brand FROM part)")
def dim_dedup(spark, sf_dir):
    return categorize.category_dim(_parts(spark, sf_dir))


@_query("""
WITH dim AS (SELECT row_number() OVER (ORDER BY p_type, p_brand)::INTEGER AS id, p_type, p_brand FROM (SELECT DISTINCT p_type, p_brand FROM part))
SELECT p_partkey AS reference, id AS category_id, 'given' AS reasoning, CAST(CAST(0.9 AS FLOAT) AS DOUBLE) AS confidence FROM part JOIN dim USING (p_type, p_brand)""")
def label_lookup(spark, sf_dir):
    answers = _parts(spark, sf_dir).select(F.col("id").alias("reference"), "category", "subcategory", F.lit(0.9).cast("float").alias("confidence"), F.lit("given").alias("reasoning"))
    return categorize.resolve(answers, dim_dedup(spark, sf_dir))[0]


@_query("""
SELECT turn, CASE WHEN regexp_matches(text, '(?i)the ') THEN 'English' WHEN regexp_matches(text, '(?i)der ') THEN 'German' ELSE 'other' END AS category, count(*) AS n FROM conversations GROUP BY 1, 2""")
def rule_labels(spark, sf_dir):
    label = categorize.by_rules(F.col("text"), [("(?i)the ", "English", "text"), ("(?i)der ", "German", "text")], ("other", "text"))
    return _table(spark, sf_dir, "conversations").select("turn", label["category"].alias("category")).groupBy("turn", "category").agg(F.count("*").alias("n"))


@_query("SELECT c_custkey AS account_id, n_name AS category FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def mandate_rules(spark, sf_dir):
    accounts = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_nationkey").alias("creditor_mandate_id"))
    rules = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("creditor_mandate_id"), F.col("n_name").alias("category_id"))
    return categorize.by_mandate(accounts, rules).select("account_id", F.col("category_id").alias("category"))


@_query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 20")
def page_slice(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy("o_orderkey").offset(20).limit(20)


@_query("SELECT CAST(unnest(range(0, (SELECT count(*) FROM orders), 5000)) AS BIGINT) AS page_offset")
def page_offsets(spark, sf_dir):
    matches = _table(spark, sf_dir, "orders").count()
    step = min(5000, matches)
    return spark.range(0, matches if offsets(step, matches) else 0, max(1, step)).select(F.col("id").alias("page_offset"))


@_query("SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1")
def page_concat(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")
    return orders.where("o_orderkey % 2 = 0").unionByName(orders.where("o_orderkey % 2 = 1"))


@_query("SELECT c_custkey AS account_id, count(o_orderkey) AS transactions FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def fk_left(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("account_id")).agg(F.count("*").alias("transactions"))
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id")).join(orders, "account_id", "left").select("account_id", F.coalesce("transactions", F.lit(0)).alias("transactions"))


@_query("SELECT user_id AS account_id, count(*) AS n FROM events WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id) GROUP BY user_id")
def fk_orphans(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select(F.col("user_id").alias("account_id"))
    return merge.orphans(events, _table(spark, sf_dir, "customer"), "account_id", "c_custkey").groupBy("account_id").agg(F.count("*").alias("n"))


@_query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    return merge.duplicates(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(spark, sf_dir):
    gone = _table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return merge.delete_cascade(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@_query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_orderdate AS DATE) AS date FROM orders")
def date_text(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return _table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), C.parse_date(day).alias("date"))


@_query("SELECT event_id, right(CAST(epoch_us(ts) // 1000 AS VARCHAR), 9) AS request_id FROM events")
def request_suffix(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", C.request_suffix(F.col("ts")).alias("request_id"))


@_query("SELECT page_id, regexp_replace(url || '/api/api', '(/api)+$', '') AS base FROM pages")
def suffix_strip(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", C.strip_suffix(F.concat("url", F.lit("/api/api")), "/api").alias("base"))


@_query("SELECT n_nationkey, replace('Use {categories} only.', '{categories}', n_name) AS prompt FROM nation")
def template_fill(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select("n_nationkey", C.fill_template(F.lit("Use {categories} only."), "categories", F.col("n_name")).alias("prompt"))


@_query("SELECT n_nationkey, CASE WHEN n_nationkey <= 1 THEN 10 WHEN n_nationkey = 2 THEN 20 WHEN n_nationkey = 3 THEN 40 ELSE 60 END AS minutes, greatest(3 - n_nationkey, 0) AS seconds_left, least(n_nationkey, 4) AS next_due FROM nation")
def schedule_functions(spark, sf_dir):
    n = F.col("n_nationkey")
    return _table(spark, sf_dir, "nation").select("n_nationkey", C.backoff_minutes(n).alias("minutes"), C.seconds_left(F.lit(3), n).alias("seconds_left"), F.least(n, F.lit(4)).alias("next_due"))


@_query("SELECT r_regionkey, unnest([r_name || '-a', r_name || '-b']) AS subcategory FROM region WHERE r_regionkey <> 2")
def explode_categories(spark, sf_dir):
    subs = F.when(F.col("r_regionkey") == 2, F.array().cast("array<string>")).otherwise(F.array(F.concat("r_name", F.lit("-a")), F.concat("r_name", F.lit("-b"))))
    return _table(spark, sf_dir, "region").select("r_regionkey", F.explode(subs).alias("subcategory"))


@_query("""
SELECT o_orderkey::VARCHAR AS reference, o_custkey::VARCHAR AS account_id, o_orderstatus AS booking_status, CAST(o_orderdate AS DATE) AS booking_date, o_totalprice AS amount,
  '' AS remitter, '' AS deptor, o_orderpriority AS creditor, '' AS creditor_id, '' AS creditor_mandate_id, o_orderpriority AS remittance_info, o_orderstatus AS transaction_type FROM orders""")
def flatten_transactions(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    nested = _table(spark, sf_dir, "orders").select(
        text("o_orderkey").alias("reference"), F.col("o_orderstatus").alias("bookingStatus"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("bookingDate"),
        F.struct(text("o_totalprice").alias("value")).alias("amount"), F.struct(none.alias("holderName")).alias("remitter"), none.alias("deptor"),
        F.struct(F.col("o_orderpriority").alias("holderName")).alias("creditor"), none.alias("directDebitCreditorId"), none.alias("directDebitMandateId"),
        F.col("o_orderpriority").alias("remittanceInfo"), F.struct(F.col("o_orderstatus").alias("text")).alias("transactionType"), text("o_custkey").alias("account"),
    )
    return flatten.booked(nested, F.col("account"))


@_query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS count FROM orders GROUP BY 1")
def yearly_counts(spark, sf_dir):
    return reports.chart_series(_table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("count")))


@_query("SELECT r_name, 'Hello, world!' AS hello FROM region")
def hello(spark, sf_dir):
    """The constant field beside those of a table."""
    return _table(spark, sf_dir, "region").select("r_name").join(reports.hello(spark), how="cross")  # one row on the right


# Queries over files and stored tables: the rows of test tables are written as the files that the sources read.


def _document(reference, day, amount, kind, state=None):
    text = lambda c: F.col(c).cast("string")
    return F.struct(
        text(reference).alias("reference"), (F.lit("BOOKED") if state is None else state).alias("bookingStatus"), F.date_format(day, "yyyy-MM-dd").alias("bookingDate"), F.struct(text(amount).alias("value"), F.lit("EUR").alias("unit")).alias("amount"),
        F.date_format(day, "yyyy-MM-dd").alias("valutaDate"), F.lit(False).alias("newTransaction"), F.lit("x").alias("remittanceInfo"), F.struct(F.lit("K").alias("key"), text(kind).alias("text")).alias("transactionType"),
    )


def _as_lines(spark, sf_dir) -> str:
    folder = scratch(spark)
    _table(spark, sf_dir, "orders").select(F.to_json(_document("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")).alias("value")).write.text(folder)
    return folder


@_query("SELECT o_orderkey::VARCHAR AS reference, CAST(o_orderdate AS DATE) AS booking_date, o_totalprice AS amount, o_orderstatus AS transaction_type FROM orders")
def json_lines(spark, sf_dir):
    rows = flatten.booked(files.read_lines(spark, _as_lines(spark, sf_dir)), F.lit("a"))
    return rows.select("reference", "booking_date", "amount", "transaction_type")


@_query("SELECT o_orderkey::VARCHAR AS reference, strftime(o_orderdate, '%Y-%m-%d') AS booking_date, o_totalprice AS amount, 'K' AS transaction_type FROM orders")
def file_import(spark, sf_dir):
    rows = flatten.filed(files.read_lines(spark, _as_lines(spark, sf_dir)))
    return rows.select("reference", "booking_date", "amount", "transaction_type")


@_query("SELECT o_orderkey::VARCHAR AS reference, CAST(o_orderdate AS DATE) AS booking_date, o_totalprice AS amount, o_orderstatus AS transaction_type FROM orders")
def json_array(spark, sf_dir):
    """Arrays of the orders of 2,000 keys, a file each."""
    folder = scratch(spark)
    packs = _table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 2000).alias("pack")).agg(F.to_json(F.collect_list(_document("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus"))).alias("value"))
    packs.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return flatten.booked(files.read_array(spark, folder), F.lit("a")).select("reference", "booking_date", "amount", "transaction_type")


@_query("SELECT DISTINCT p_type AS category, p_brand AS subcategory FROM part")
def category_file(spark, sf_dir):
    """Category trees, a file for each category; of its brands each stands once."""
    folder = scratch(spark)
    trees = _table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("category")).agg(F.collect_set("p_brand").alias("subcategories"))
    trees.select(F.to_json(F.array(F.struct("category", "subcategories"))).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return files.read_categories(spark, folder)


@_query("SELECT string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS value FROM nation GROUP BY n_regionkey")
def text_file(spark, sf_dir):
    """A file of names for each region, each read whole."""
    folder = scratch(spark)
    _table(spark, sf_dir, "nation").repartition("n_regionkey").sortWithinPartitions("n_regionkey", "n_nationkey").select("n_name", "n_regionkey").write.partitionBy("n_regionkey").text(folder)
    return files.read_text(spark, folder).select("value")


@_query("SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS count FROM orders GROUP BY 1")
def chart_file(spark, sf_dir):
    folder = scratch(spark)
    counts = _table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("count"))
    counts.agg(F.to_json(F.collect_list(F.struct("year", "count"))).alias("value")).write.text(folder)
    return reports.chart_series(files.read_points(spark, folder, "year long, count long"))


def _service(spark, sf_dir) -> dict:
    """A service of all customers and their orders."""
    text = lambda c: F.col(c).cast("string")
    account = F.struct(F.concat(F.lit("iban-"), text("c_custkey")).alias("iban"), text("c_nationkey").alias("bic"), text("c_custkey").alias("accountId"), F.col("c_name").alias("accountDisplayId"), F.struct(F.col("c_mktsegment").alias("text")).alias("accountType"))
    balances = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place"), F.to_json(F.struct(account.alias("account"), text("c_custkey").alias("accountId"), F.struct(text("c_acctbal").alias("value"), F.lit("EUR").alias("unit")).alias("balance"))).alias("value"))
    orders = _table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "P", "NOTBOOKED").otherwise("BOOKED")
    documents = orders.select(text("o_custkey").alias("account_id"), state.alias("state"), F.to_json(_document("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus", state)).alias("value"), "o_orderkey")
    return stored_service.store_answers(balances, documents, scratch(spark), max(8, orders.count() // 2000), F.col("o_orderkey")) | {"step": "7"}


@_query("SELECT c_custkey::VARCHAR AS account_id, c_acctbal AS amount, c_name AS display_id, c_custkey AS place FROM customer")
def account_balances(spark, sf_dir):
    """Accounts and balances of all pages of the service."""
    found = paged.balances_of(spark, _service(spark, sf_dir) | {"step": "50"})
    return found.select(F.col("account.accountId").alias("account_id"), C.parse_or_zero(F.col("balance.value")).alias("amount"), F.col("account.accountDisplayId").alias("display_id"), "place")


@_query("SELECT c_custkey::VARCHAR AS account_id, o_orderkey::VARCHAR AS reference, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'")
def paged_accounts(spark, sf_dir):
    """All accounts that the service has, and all pages of each that are booked; every third page is asked for twice, as the service is busy."""
    options = _service(spark, sf_dir) | {"busy": "3", "wait_seconds": "0"}
    accounts = paged.balances_of(spark, options | {"step": "50"}).select(F.col("account.accountId").alias("account_id"))
    return paged.transactions_of(accounts, options).select("account_id", F.get_json_object("value", "$.reference").alias("reference"), "place")


@_query("""
SELECT o_orderkey::VARCHAR AS reference, o_custkey::VARCHAR AS account_id, CAST(o_orderdate AS DATE) AS booking_date, o_totalprice AS amount, b.amount AS balance, b.account_type, 'Bank' AS institute, DATE '2025-01-02' AS date FROM orders
JOIN (SELECT c_custkey, c_acctbal AS amount, c_mktsegment AS account_type FROM customer) b ON c_custkey = o_custkey WHERE o_orderstatus <> 'P'""")
def import_cycle(spark, sf_dir):
    """Accounts, balances and transactions of the service in one commit, twice; then what is stored."""
    store = Snapshots(spark, scratch(spark), buckets=8)
    options, day = _service(spark, sf_dir) | {"step": "50"}, F.lit("2025-01-02").cast("date")
    for _ in range(2):
        ingest.import_all(spark, options, store, "Bank", day)
    balances = store.read("account_balance").select("account_id", F.col("amount").alias("balance"), "date").join(store.read("account").select("account_id", "account_type", "institute"), "account_id")
    return store.read("account_transactions").join(balances, "account_id").select("reference", "account_id", "booking_date", "amount", "balance", "account_type", "institute", "date")


@_query("SELECT o_custkey::VARCHAR AS account_id, o_orderkey::VARCHAR AS reference, 'NOTBOOKED' AS booking_status FROM orders WHERE o_orderstatus = 'P'")
def other_state(spark, sf_dir):
    """What isn't booked: the state goes into the requests."""
    accounts = _table(spark, sf_dir, "customer").select("c_custkey")
    found = paged.transactions_of(accounts, _service(spark, sf_dir) | {"state": "NOTBOOKED"}, "c_custkey")
    return found.select("account_id", F.get_json_object("value", "$.reference").alias("reference"), "booking_status")


@_query("SELECT c_custkey::VARCHAR AS account_id, c_name AS display_id, c_acctbal AS amount, true AS today FROM customer")
def loaded_accounts(spark, sf_dir):
    """Response files of 500 accounts each; accounts and balances come into the tables, with today's date."""
    folder = scratch(spark)
    text = lambda c: F.col(c).cast("string")
    account = F.struct(F.concat(F.lit("iban-"), text("c_custkey")).alias("iban"), F.lit("b").alias("bic"), text("c_custkey").alias("accountId"), F.col("c_name").alias("accountDisplayId"), F.struct(F.lit("t").alias("text")).alias("accountType"))
    value = F.struct(account.alias("account"), text("c_custkey").alias("accountId"), F.struct(text("c_acctbal").alias("value"), F.lit("EUR").alias("unit")).alias("balance"))
    pages = _table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 500).alias("page")).agg(F.collect_list(value).alias("values"))
    pages.select(F.to_json(F.struct("values")).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    store = Snapshots(spark, scratch(spark), buckets=8)
    ingest.load_accounts(spark, folder, store, "Bank")
    return store.read("account").join(store.read("account_balance"), "account_id").select("account_id", "display_id", "amount", (F.col("date") == F.current_date()).alias("today"))


@_query(f"SELECT l_orderkey::VARCHAR AS reference, last(l_extendedprice ORDER BY {_ORDER}) AS amount, count(*) > 1 AS again FROM lineitem GROUP BY l_orderkey")
def streamed_import(spark, sf_dir):
    """Files of two deliveries, imported by two runs of a stream: the first lines of orders, then the later ones; a third run finds nothing."""
    folder, at, store = scratch(spark), scratch(spark), Snapshots(spark, scratch(spark), buckets=8)
    for first in (True, False):
        last = merge.last_of_each(_first_lines(spark, sf_dir, first), ["l_orderkey"], F.col("at")).withColumn("day", F.lit("2025-01-02").cast("date"))
        last.select(F.to_json(_document("l_orderkey", "day", "amount", "status")).alias("value")).write.mode("append").text(folder)
        for _ in range(1 if first else 2):
            ingest.import_transactions(spark, folder, store, at, "a").awaitTermination()
    counts = _versions(spark, sf_dir).groupBy(F.col("l_orderkey").cast("string").alias("reference")).agg((F.count("*") > 1).alias("again"))
    return store.read("account_transactions").select("reference", "amount").join(counts, "reference")


def _first_lines(spark, sf_dir, first: bool) -> DataFrame:
    lines = _versions(spark, sf_dir).where("l_linenumber = 1" if first else "l_linenumber > 1")
    return lines.select("l_orderkey", F.col("l_suppkey").alias("account_id"), F.col("l_extendedprice").alias("amount"), F.col("l_returnflag").alias("status"), _arrival().alias("at"))


@_query(f"SELECT l_orderkey, first(l_suppkey ORDER BY {_ORDER}) AS account_id, last(l_extendedprice ORDER BY {_ORDER}) AS amount, last(l_returnflag ORDER BY {_ORDER}) AS status FROM lineitem GROUP BY l_orderkey")
def upsert_into_stored(spark, sf_dir):
    columns, at = ["l_orderkey", "account_id", "amount", "status"], F.col("at")
    empty = _first_lines(spark, sf_dir, True).select(*columns).limit(0)
    stored = merge.upsert(empty, _first_lines(spark, sf_dir, True), ["l_orderkey"], at, keep=("account_id",))
    return merge.upsert(stored, _first_lines(spark, sf_dir, False), ["l_orderkey"], at, keep=("account_id",))


@_query("""
SELECT l_orderkey, coalesce(s.account_id, b.account_id) AS account_id, coalesce(s.amount, b.amount) AS amount FROM
 (SELECT l_orderkey, arg_min(l_suppkey, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS account_id, arg_min(l_extendedprice, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS amount FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) s
 FULL JOIN (SELECT l_orderkey, arg_min(l_suppkey, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS account_id, arg_min(l_extendedprice, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS amount FROM lineitem WHERE l_linenumber > 1 GROUP BY 1) b USING (l_orderkey)""")
def insert_ignore_into_stored(spark, sf_dir):
    columns, at = ["l_orderkey", "account_id", "amount"], F.col("at")
    stored = merge.first_of_each(_first_lines(spark, sf_dir, True), ["l_orderkey"], at).select(*columns)
    return merge.insert_ignore(stored, _first_lines(spark, sf_dir, False), ["l_orderkey"], at)


@_query("SELECT l_partkey AS account_id, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = l_partkey) GROUP BY 1")
def fk_orphans_some(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("account_id"))
    return merge.orphans(lines, _table(spark, sf_dir, "customer"), "account_id", "c_custkey").groupBy("account_id").agg(F.count("*").alias("n"))


@_query("""
WITH a AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_extendedprice FROM lineitem WHERE l_partkey % 2 = 0),
 best AS (SELECT l_orderkey, arg_max(l_partkey, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS part FROM a GROUP BY 1)
SELECT o_orderkey AS reference, coalesce(part, 0) AS category_id, CASE WHEN part IS NULL THEN 'before' ELSE 'answer' END AS reasoning FROM orders LEFT JOIN best ON l_orderkey = o_orderkey""")
def label_write(spark, sf_dir):
    """Labels are replaced by a batch of answers; odd parts are no known pair and are set aside."""
    labels = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("reference"), F.lit(0).cast("bigint").alias("category_id"), F.lit("before").alias("reasoning"), F.lit(1.0).alias("confidence"))
    name = F.col("l_partkey").cast("string")
    answers = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("reference"), name.alias("category"), name.alias("subcategory"), F.lit("answer").alias("reasoning"), F.lit(0.5).alias("confidence"), _arrival().alias("at"))
    parts = _table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("category"), F.col("p_partkey").cast("string").alias("subcategory"))
    return categorize.write_labels(labels, answers, parts, F.col("at"))[0].select("reference", "category_id", "reasoning")


@_query("""
SELECT o_orderkey AS reference, CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END AS category FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber < 3)""")
def classify_pending(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("reference"), F.col("o_totalprice").alias("amount"))
    labels = _table(spark, sf_dir, "lineitem").where("l_linenumber < 3").select(F.col("l_orderkey").alias("reference"))
    size = F.when(F.col("amount") > 200000, "large").otherwise("small")
    answer = lambda df: df.select("reference", size.alias("category"), size.alias("subcategory"), F.lit("by amount").alias("reasoning"))
    return categorize.classify_pending(orders, labels, answer).select("reference", "category")


@_query("""
WITH stored AS (SELECT row_number() OVER (ORDER BY p_type, p_brand)::INTEGER AS id, p_type, p_brand FROM (SELECT DISTINCT p_type, p_brand FROM part WHERE p_size > 25)),
 fresh AS (SELECT DISTINCT p_type, p_brand FROM part EXCEPT SELECT p_type, p_brand FROM stored)
SELECT id, p_type AS category, p_brand AS subcategory FROM stored UNION ALL
SELECT ((SELECT coalesce(max(id), 0) FROM stored) + row_number() OVER (ORDER BY p_type, p_brand))::INTEGER, p_type, p_brand FROM fresh""")
def dim_grown(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").select("p_size", F.col("p_type").alias("category"), F.col("p_brand").alias("subcategory"))
    return categorize.category_dim(parts, categorize.category_dim(parts.where("p_size > 25")))


@_query("SELECT o_orderkey AS reference, printf('%s: %s/%s (%.2f)', o_orderkey::VARCHAR, o_orderstatus, o_orderpriority, 0.5) AS label FROM orders")
def label_text(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("reference"), C.label_text(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit(0.5)).alias("label"))


@_query("SELECT n_nationkey, '{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || ',\"note\":null}' AS body FROM nation")
def json_text(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select("n_nationkey", C.as_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), F.lit(None).cast("string").alias("note"))).alias("body"))


@_query("SELECT event_id, CAST(trunc((event_id * 7 - 5000) / 60.0) AS BIGINT) AS minutes, '[redacted]' AS secret FROM events")
def division_and_redaction(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", C.whole_minutes(F.col("event_id") * 7 - 5000).alias("minutes"), C.redacted(F.col("props")).alias("secret"))


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def first_or_fail(spark, sf_dir):
    return merge.first_or_fail(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.struct(-F.col("o_totalprice"), "o_orderkey"))


@_query("SELECT o_orderkey, o_custkey FROM orders")
def exactly_one(spark, sf_dir):
    return merge.exactly_one(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])


@_query("SELECT category, total_expenses FROM (SELECT p_type AS category, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS total_expenses FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY 1)")
def fields_by_condition(spark, sf_dir):
    """The field total_income is skipped and month isn't included, by the caller's conditions."""
    lines = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(_parts(spark, sf_dir), F.col("l_partkey") == F.col("id"))
    totals = reports.income_and_expenses(lines.select("category", (-F.col("l_extendedprice")).alias("amount"))).withColumn("month", F.lit("10"))
    return reports.select_fields(totals, ("month", "category", "total_income", "total_expenses"), include={"month": False}, skip={"total_income": True})


def _lines_store(spark, sf_dir) -> Snapshots:
    """The first lines of all orders in a stored table."""
    store = Snapshots(spark, scratch(spark), buckets=8)

    def work(tx):
        tx.create("moves", "l_orderkey bigint, account_id bigint, amount double, status string", ("l_orderkey",))
        tx.upsert("moves", _first_lines(spark, sf_dir, True), F.col("at"), keep=("account_id",))

    store.run(work)
    return store


@_query(f"SELECT l_orderkey, first(l_suppkey ORDER BY {_ORDER}) AS account_id, last(l_extendedprice ORDER BY {_ORDER}) AS amount, last(l_returnflag ORDER BY {_ORDER}) AS status FROM lineitem GROUP BY l_orderkey")
def stored_upsert(spark, sf_dir):
    """Upserts into the buckets of a stored table, in two commits."""
    store = _lines_store(spark, sf_dir)
    store.run(lambda tx: tx.upsert("moves", _first_lines(spark, sf_dir, False), F.col("at"), keep=("account_id",)), source="lines", batch=1)
    store.run(lambda tx: tx.overwrite("moves", tx.read("moves").limit(0)), source="lines", batch=1)  # a batch that counts already
    return store.read("moves")


@_query(f"""
WITH lines AS (SELECT *, l_linenumber > 1 AS later FROM lineitem),
 firsts AS (SELECT l_orderkey, min(later) AS later FROM lines GROUP BY 1)
SELECT l_orderkey, arg_min(l_suppkey, ({_ORDER})) AS account_id, CASE WHEN f.later THEN arg_min(l_extendedprice, ({_ORDER})) ELSE arg_max(l_extendedprice, ({_ORDER})) END AS amount
FROM lines JOIN firsts f USING (l_orderkey, later) GROUP BY l_orderkey, f.later""")
def stored_insert_ignore(spark, sf_dir):
    """New keys are added beside the stored files; of those the earliest line counts."""
    store = _lines_store(spark, sf_dir)
    before = store.manifest("moves", store.version()).folders
    store.run(lambda tx: tx.insert_ignore("moves", _first_lines(spark, sf_dir, False), F.col("at")))
    after = store.manifest("moves", store.version()).folders
    if any(after[b][: len(f)] != f for b, f in before.items()):
        raise AssertionError("a stored file was written anew")
    return store.read("moves").select("l_orderkey", "account_id", "amount")


@_query("""
SELECT o_orderkey AS reference, CASE WHEN o_custkey % 7 = 0 THEN 'aside' ELSE 'label' END AS kept_in, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey % 7 END AS category_id FROM orders""")
def label_commit(spark, sf_dir):
    """Labels of known categories and answers of unknown ones, two tables in one commit."""
    store = Snapshots(spark, scratch(spark), buckets=8)
    pair = F.concat(F.lit("c"), F.col("o_custkey") % 7)
    answers = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("reference"), pair.alias("category"), pair.alias("subcategory"), F.lit("r").alias("reasoning"), F.lit(0.5).alias("confidence"))
    dim = spark.range(1, 7).select("id", F.concat(F.lit("c"), "id").alias("category"), F.concat(F.lit("c"), "id").alias("subcategory"))

    def work(tx):
        tx.create("labels", "reference bigint, category_id bigint, reasoning string, confidence double", ("reference",))
        tx.create("aside", "reference bigint, category string", ("reference",))
        labels, unknown = categorize.write_labels(tx.read("labels"), answers, dim, F.col("reference"))
        tx.replace("labels", labels, F.lit(0))
        tx.replace("aside", unknown.select("reference", "category"), F.lit(0))

    store.run(work)
    aside = store.read("aside").select("reference", F.lit("aside").alias("kept_in"), F.lit(None).cast("bigint").alias("category_id"))
    return store.read("labels").select("reference", F.lit("label").alias("kept_in"), "category_id").unionByName(aside)


@_query("""
SELECT c_custkey AS account_id, iban FROM (SELECT c_custkey, c_nationkey || c_mktsegment AS iban, row_number() OVER (PARTITION BY c_nationkey || c_mktsegment ORDER BY c_acctbal, c_custkey) AS rn FROM customer) WHERE rn = 1""")
def unique_accounts(spark, sf_dir):
    """Accounts come in by balance, none whose second key another one has."""
    batch = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), F.concat("c_nationkey", "c_mktsegment").alias("iban"), "c_acctbal")
    return merge.insert_unique(batch.select("account_id", "iban").limit(0), batch, [["account_id"], ["iban"]], F.struct("c_acctbal", "account_id"))[0].select("account_id", "iban")


@_query("""
SELECT 'account' AS name, count(*) AS n FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'account_balance', count(*) FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT 'account_transactions', count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0""")
def stored_cascade(spark, sf_dir):
    """Accounts in the red go, and their balances and transactions with them, in one commit."""
    store, customers = Snapshots(spark, scratch(spark), buckets=8), _table(spark, sf_dir, "customer")
    given = {
        "account": customers.select(F.col("c_custkey").cast("string").alias("account_id"), F.col("c_name").alias("iban")), "account_balance": customers.select(F.col("c_custkey").cast("string").alias("account_id"), F.lit("2025-01-02").cast("date").alias("date"), F.col("c_acctbal").alias("amount")),
        "account_transactions": _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("reference"), F.col("o_custkey").cast("string").alias("account_id")),
    }
    store.run(lambda tx: [tx.replace(name, rows, F.lit(0)) for name, rows in given.items()])
    gone = customers.where("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("account_id"))
    store.run(lambda tx: tx.delete_with_children("account", gone, "account_id"))
    return functools.reduce(DataFrame.union, [store.read(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name in given])


class _Model:
    """Answers by the length and the last digit of a question; some of them break the contract."""

    def __init__(self, options: dict):
        pass

    def answer(self, question: str) -> str:
        good = {"reference": "", "category": f"c{len(question) % 2}", "subcategory": "s", "confidence": 0.5, "reasoning": question[-1]}
        bad = {"0": "no json", "1": {**good, "category": "other"}, "2": {**good, "confidence": 7}, "3": {k: v for k, v in good.items() if k != "reasoning"}}.get(question[-1], good)
        return bad if isinstance(bad, str) else json.dumps(bad)


@_query("""
SELECT o_orderkey::VARCHAR AS reference, CASE o_orderkey % 10 WHEN 0 THEN 'no JSON object of the schema' WHEN 1 THEN 'unknown category' WHEN 2 THEN 'confidence isn''t from 0 to 1' WHEN 3 THEN 'reasoning is missing' ELSE o_orderkey % 10 || '' END AS told,
  CASE WHEN o_orderkey % 10 > 3 THEN length(o_orderkey::VARCHAR) % 2 + 1 END AS category_id
FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber < 3)""")
def model_labels(spark, sf_dir):
    """A model's answers for the orders without a label, those that break the contract set aside with the reason."""
    store = Snapshots(spark, scratch(spark), buckets=8)
    store.write("categories", spark.range(2).select((F.col("id") + 1).cast("int").alias("id"), F.concat(F.lit("c"), "id").alias("category"), F.lit("s").alias("subcategory")))
    labelled = _table(spark, sf_dir, "lineitem").where("l_linenumber < 3").select(F.col("l_orderkey").cast("string").alias("reference")).distinct()
    store.write("transaction_categories", labelled.select("reference", F.lit(0).alias("category_id"), F.lit("before").alias("reasoning"), F.lit(1.0).alias("confidence")))
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("reference"))
    classify.label_pending(store, orders, F.col("reference"), {"model": f"{__name__}:_Model"})
    labels = store.read("transaction_categories").where("reasoning <> 'before'").select("reference", F.col("reasoning").alias("told"), "category_id")
    return labels.unionByName(store.read(classify.REJECTED).select("reference", F.col("reason").alias("told"), F.lit(None).cast("int").alias("category_id")))


@_query("SELECT c_custkey AS id, upper(c_mktsegment) || '!' AS segment, c_acctbal * 2 AS twice, NULL::VARCHAR AS note FROM customer")
def migrated_accounts(spark, sf_dir):
    """Migrations up, down and up again over stored rows."""
    store = Snapshots(spark, scratch(spark), buckets=8)
    steps = [
        migrations.Step(1, "accounts", (migrations.Create("held", "id bigint, segment string, balance double", ("id",)),), (migrations.Drop("held"),)),
        migrations.Step(2, "note", (migrations.AddColumn("held", "note", "string"), migrations.AddColumn("held", "twice", "double", "balance * 2")), (migrations.DropColumn("held", "note"), migrations.DropColumn("held", "twice"))),
        migrations.Step(3, "segment", (migrations.Update("held", (("segment", "upper(segment) || '!'"),)),), (migrations.Update("held", (("segment", "lower(substring(segment, 1, length(segment) - 1))"),)),)),
    ]
    migrations.migrate(store, steps, to=1)
    store.write("held", _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")))
    for to in (3, 1, 3):
        migrations.migrate(store, steps, to=to)
    return store.read("held").select("id", "segment", "twice", "note")


@_query("""
SELECT 'account' AS name, count(*) AS n FROM customer UNION ALL SELECT 'account_balance', count(*) FROM events UNION ALL SELECT 'account_transactions', count(*) FROM orders UNION ALL
SELECT 'categories', count(*) FROM part UNION ALL SELECT unnest(['mandate_categories', 'transaction_categories', 'transactions']), 0""")
def created_tables(spark, sf_dir):
    """Rows of the catalogue's tables after given rows were written into some, by a second creation that leaves them alone; the database goes afterwards."""
    database = f"ledger_{uuid.uuid4().hex[:12]}"
    tables.create_all(spark, database)
    try:
        day = F.to_date("ts").alias("date")
        given = {
            "account": _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id")), "account_balance": _table(spark, sf_dir, "events").select(F.col("user_id").alias("account_id"), day, F.col("value").alias("amount")),
            "account_transactions": _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("reference"), F.col("o_totalprice").alias("amount")), "categories": _parts(spark, sf_dir).select("category", "subcategory"),
        }
        for name, rows in given.items():
            kinds = spark.table(f"{database}.{name}").schema.fields
            rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds)).write.insertInto(f"{database}.{name}")
        tables.create_all(spark, database)
        counts = [spark.table(f"{database}.{r.tableName}").agg(F.count("*").alias("n")).select(F.lit(r.tableName).alias("name"), "n") for r in spark.sql(f"SHOW TABLES IN {database}").collect()]
        told = functools.reduce(DataFrame.union, counts).collect()  # a row for each table
    finally:
        tables.drop_all(spark, database)
        spark.sql(f"DROP DATABASE IF EXISTS {database}")
    return spark.createDataFrame(told, "name string, n bigint")


@_query("SELECT o_orderkey AS reference, o_orderkey % 4 = 0 AS kept FROM orders WHERE o_orderkey % 4 = 0")
def blank_lines(spark, sf_dir):
    """Lines of text of which three in four are blank: empty, plain spaces, or other white space."""
    kind = F.col("o_orderkey") % 4
    line = F.when(kind == 0, F.concat(F.lit("\t "), F.col("o_orderkey"))).when(kind == 1, "").when(kind == 2, "  ").otherwise("\u2003\t\u00a0")
    folder = scratch(spark)
    _table(spark, sf_dir, "orders").select(line.alias("value")).write.text(folder)
    kept = spark.read.text(folder).where(~C.is_blank(F.col("value")))
    return kept.select(F.trim(F.translate("value", "\t", "")).cast("bigint").alias("reference"), F.lit(True).alias("kept"))


@_query("""
SELECT c_custkey AS account_id, printf('http://bank/banking/v1/accounts/%d/transactions?transactionState=BOOKED&paging-first=%d', c_custkey, o) AS url
FROM customer, (SELECT unnest(range(0, 60, 20)) AS o)""")
def request_urls(spark, sf_dir):
    accounts = _table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(59), F.lit(20))).alias("at"))
    return accounts.select(F.col("c_custkey").alias("account_id"), C.page_url(F.lit("http://bank/api/api"), F.col("c_custkey").cast("string"), F.col("at")).alias("url"))


@_query("SELECT o_orderpriority AS priority, count(*) AS n, count(*) AS ids, 36::INTEGER AS length FROM orders GROUP BY 1")
def random_ids(spark, sf_dir):
    """An id for each row, no two alike."""
    marked = _table(spark, sf_dir, "orders").withColumn("id", C.random_id())
    return marked.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.max(F.length("id")).alias("length"))


@_query("""
WITH budget(category, most) AS (VALUES ('F', 100000.0), ('O', 250000.0), ('X', 1.0))
SELECT category, most::DOUBLE AS most, count(o_orderkey) AS above FROM budget LEFT JOIN orders ON o_orderstatus = category AND o_totalprice > most GROUP BY 1, 2""")
def over_budget(spark, sf_dir):
    """Stated rows, and how many transactions lie above each."""
    budget = reports.literal_rows(spark, [("F", 100000.0), ("O", 250000.0), ("X", 1.0)], "category string, most double")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    found = budget.join(orders, (F.col("o_orderstatus") == F.col("category")) & (F.col("o_totalprice") > F.col("most")), "left")
    return found.groupBy("category", "most").agg(F.count("o_orderkey").alias("above"))


_EXPORTED = {
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "events": "event_id ts user_id event_type value props", "conversations": "conv_id turn role text",
}


@_query(" UNION ALL ".join(f"SELECT '{t}' AS name, '{c}' AS field, count({c}) AS n FROM {t}" for t, cs in _EXPORTED.items() for c in cs.split()))
def schema_export(spark, sf_dir):
    """Schemas of stored tables to text and back; each table is read by what came back, and the values of each field are counted."""
    text = sdl.printed(sdl.Schema({t: _table(spark, sf_dir, t).schema for t in _EXPORTED}))
    parts = []
    for name, kind in sdl.parsed(text).types.items():
        rows = spark.read.schema(kind).parquet(f"{sf_dir}/{name}.parquet")
        counts = rows.agg(*[F.count(F.col(f)).alias(f) for f in rows.columns])
        parts.append(counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f).alias("field"), F.col(f).alias("n")) for f in rows.columns])).alias("r")).select("r.*"))
    return functools.reduce(DataFrame.union, parts)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
