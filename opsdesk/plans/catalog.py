"""The registered queries on the shared tables, each with the same result in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import checks, dates, numbers, text
from ..operators import aggregate, audit, calendars, clean, columns, diff, documents, files, lexicons, quality, ranks, reconcile, scan, timetable
from ..sources import delimited, sinks
from ..sources import files as sources
from ..streaming import live
from . import inputs
from .inputs import ASKED_SQL, HOLIDAYS_SQL, LEDGERS_SQL, MONEY_SQL, NUMBERS_SQL, SPLIT_SQL, STOPS_SQL, SUSPENDED_SQL, TRIPS_SQL, VERSIONS_SQL, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DEC = "decimal(18,4)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def dec(df: DataFrame) -> DataFrame:
    """Doubles as decimals, so that results of two engines compare."""
    return df.select(*[F.col(f"`{c}`").cast(DEC).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


def as_long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# --- aggregation -------------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, count(*) AS row_count, CAST(sum(l_quantity) AS DECIMAL(18,4)) AS sum_l_quantity, CAST(avg(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,4)) AS avg_l_quantity,
    CAST(median(l_extendedprice) AS DECIMAL(18,4)) AS median_l_extendedprice, CAST(quantile_cont(l_extendedprice, 0.9) AS DECIMAL(18,4)) AS p90_l_extendedprice, count(DISTINCT l_suppkey) AS distinct_l_suppkey,
    CAST(min(l_discount) AS DECIMAL(18,4)) AS min_l_discount, CAST(max(l_tax) AS DECIMAL(18,4)) AS max_l_tax, CAST(0 AS BIGINT) AS blank_l_tax FROM lineitem GROUP BY ALL""")
def agg_lineitem(spark, d):
    """AGG1-AGG9."""
    metrics = [("sum", "l_quantity"), ("avg", "l_quantity"), ("median", "l_extendedprice"), ("p90", "l_extendedprice"), ("distinct", "l_suppkey"), ("min", "l_discount"), ("max", "l_tax"), ("blank", "l_tax")]
    return dec(aggregate.aggregate(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], metrics))


@query(f"""SELECT st, count(*) AS row_count, CAST(sum(v) AS DECIMAL(18,4)) AS sum_a, count(*) - count(v) AS blank_a, CAST(min(v) AS DECIMAL(18,4)) AS min_a, CAST(max(v) AS DECIMAL(18,4)) AS max_a FROM ({MONEY_SQL}) GROUP BY st""")
def agg_parse_money(spark, d):
    """MTH1, AGG3, AGG5, AGG9 on money as people write it."""
    return dec(aggregate.aggregate(inputs.money_texts(spark, d), ["st"], [("sum", "a"), ("blank", "a"), ("min", "a"), ("max", "a")]))


@query("SELECT count(*) AS row_count, CAST(sum(l_quantity) AS DECIMAL(18,4)) AS sum_l_quantity, CAST(quantile_cont(l_quantity, 0.95) AS DECIMAL(18,4)) AS p95_l_quantity FROM lineitem")
def agg_global(spark, d):
    return dec(aggregate.aggregate(read(spark, d, "lineitem"), [], [("sum", "l_quantity"), ("p95", "l_quantity")]))


@query("SELECT event_type, user_id, count(*) AS row_count, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DECIMAL(18,2)) AS total FROM events GROUP BY ALL")
def agg_multi_key(spark, d):
    x = read(spark, d, "events").withColumn("value", F.col("value").cast("decimal(18,6)"))
    return aggregate.aggregate(x, ["event_type", "user_id"], [("sum", "value")]).select("event_type", "user_id", "row_count", F.col("sum_value").cast("decimal(18,2)").alias("total"))


@query("SELECT o_custkey, count(*) AS row_count, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,4)) AS total FROM orders GROUP BY 1 ORDER BY total DESC NULLS LAST, o_custkey LIMIT 10")
def agg_topn(spark, d):
    """SRT1, SRT3: a top-k report."""
    x = read(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast(DEC).alias("total"))
    return aggregate.sort_groups(x, "total", top=10).select("o_custkey", "row_count", "total")


def _describe_sql(table: str, numeric: list[str], texts: list[str]) -> str:
    n = "SELECT '{c}' AS column_name, count({c}) AS non_blank, count(*) - count({c}) AS blank, count(DISTINCT {c}) AS distinct_values, CAST(min({c}) AS DECIMAL(18,4)) AS min_value, CAST(max({c}) AS DECIMAL(18,4)) AS max_value, CAST(avg(CAST({c} AS DECIMAL(18,4))) AS DECIMAL(18,2)) AS avg_value, CAST(median(CAST({c} AS DOUBLE)) AS DECIMAL(18,4)) AS median_value, CAST(quantile_cont(CAST({c} AS DOUBLE), 0.9) AS DECIMAL(18,4)) AS p90_value, true AS \"numeric\" FROM {t}"
    t = "SELECT '{c}', count_if({c} <> ''), count_if({c} = ''), count(DISTINCT {c}), NULL, NULL, NULL, NULL, NULL, false FROM {t}"
    return " UNION ALL ".join([n.format(c=c, t=table) for c in numeric] + [t.format(c=c, t=table) for c in texts])


@query(_describe_sql("customer", ["c_custkey", "c_acctbal"], ["c_mktsegment", "c_name"]))
def agg_describe(spark, d):
    """AGG10."""
    x = aggregate.describe(read(spark, d, "customer"), ["c_custkey", "c_acctbal", "c_mktsegment", "c_name"])
    return dec(x.withColumn("avg_value", F.col("avg_value").cast("decimal(18,2)")))


@query("SELECT o_orderpriority AS key, count(*) AS n, CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1")
def subtotal_by(spark, d):
    """AGG11."""
    x = read(spark, d, "orders").withColumn("cents", F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long"))
    return aggregate.subtotals(x, "o_orderpriority", "cents")


@query("SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_line, max(event_id) AS last_line FROM events GROUP BY ALL HAVING count(*) > 1")
def dup_keys(spark, d):
    """AGG14."""
    return aggregate.duplicate_keys(read(spark, d, "events"), ["user_id", "event_type"], "event_id")


@query("SELECT user_id, event_type, n, event_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) WHERE n > 1")
def dup_lines(spark, d):
    """AGG14: each line of the keys that repeat."""
    return aggregate.duplicate_lines(read(spark, d, "events"), ["user_id", "event_type"], "event_id")


@query("SELECT CAST(sum(n - 1) AS BIGINT) AS repeats, count_if(n > 1) AS groups FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type)")
def dup_rows(spark, d):
    """AGG15."""
    return aggregate.duplicate_rows(read(spark, d, "events").select("user_id", "event_type"))


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_line FROM events GROUP BY 1 ORDER BY n DESC, first_line LIMIT 1")
def first_mode(spark, d):
    """AGG24: a mode is one row."""
    return aggregate.first_mode(read(spark, d, "events"), "event_type", "event_id")


# --- cleaning and profiles ---------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderdate AS DATE) END AS day, o_orderkey % 4 = 3 AS invalid FROM orders")
def clean_dates(spark, d):
    """DT1, DT2."""
    return inputs.date_texts(spark, d).select("k", dates.parse_date("d").alias("day"), dates.invalid_date("d").alias("invalid"))


@query("SELECT doc_id, sha256(trim('ABC 12' || replace(text, chr(12288), ' '), ' ' || chr(9) || chr(10) || chr(13))) AS digest FROM documents")
def clean_text(spark, d):
    """STR1, STR3 on texts with a full-width head and blanks around."""
    t = F.concat(F.lit("　ＡＢＣ　１２"), F.col("text"), F.lit("　"))
    return read(spark, d, "documents").select("doc_id", F.sha2(text.trim_u(text.half_width(t)), 256).alias("digest"))


@query(f"SELECT k, CASE WHEN v IS NOT NULL THEN CAST(v AS VARCHAR) ELSE CASE k % 5 WHEN 3 THEN '' ELSE 'n/a' END END AS a FROM ({MONEY_SQL})")
def clean_cells(spark, d):
    """PRJ3."""
    return clean.clean_cells(inputs.money_texts(spark, d), width=["a"], numbers=["a"]).select("k", "a")


@query("SELECT 'a' AS column_name, count_if(o_orderkey % 5 IN (0, 1, 2)) AS changed FROM orders UNION ALL SELECT 'st', CAST(0 AS BIGINT) FROM (SELECT 1)")
def clean_counts(spark, d):
    """PRJ3: how many cells cleaning altered."""
    x = inputs.money_texts(spark, d)
    return clean.change_counts(x, clean.clean_cells(x, width=["a"], numbers=["a"]), "k")


def _profile_sql() -> str:
    head = """SELECT '{c}' AS column_name, count(*) AS n_rows, count_if(trim(v) <> '') AS non_blank, count_if(trim(v) = '') AS blank, count(DISTINCT nullif(trim(v), '')) AS unique_values, '{t}' AS type,
        bool_or(v <> '' AND v <> trim(v)) AS padded, CAST(0 AS BIGINT) AS invalid_dates, CAST(min(n) AS DECIMAL(18,4)) AS min_value, CAST(max(n) AS DECIMAL(18,4)) AS max_value, count(n) AS numbers, CAST(avg(n) AS DECIMAL(18,2)) AS avg_value,
        CAST(count_if(trim(v) = '') / count(*) AS DECIMAL(18,4)) AS null_rate, array_to_string(list_slice(list_sort(list_distinct(list(nullif(trim(v), '')))), 1, 3), '|') AS samples,
        count(*) FILTER (n < lo OR n > hi) AS outliers FROM c"""
    inner = """ FROM (SELECT v, n, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT v, n, quantile_cont(n, 0.25) OVER () AS q1, quantile_cont(n, 0.75) OVER () AS q3 FROM (SELECT {c} AS v, TRY_CAST(trim({c}) AS DOUBLE) AS n FROM c)))"""
    parts = [(head.removesuffix(" FROM c") + inner).format(c=c, t=t) for c, t in (("c_custkey", "integer"), ("c_mktsegment", "string"), ("c_acctbal", "decimal"))]
    return "WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN ' ' || c_mktsegment ELSE c_mktsegment END AS c_mktsegment, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS c_acctbal FROM customer) " + " UNION ALL ".join(parts)


def _untidy_customers(spark, d):
    seg = F.when(F.col("c_custkey") % 7 == 0, "").when(F.col("c_custkey") % 5 == 0, F.concat(F.lit(" "), "c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), seg.alias("c_mktsegment"), F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("c_acctbal"))


@query(_profile_sql())
def profile_columns(spark, d):
    """AGG16, AGG17."""
    x = quality.profile(_untidy_customers(spark, d)).withColumns({"avg_value": F.col("avg_value").cast("decimal(18,2)"), "samples": F.array_join("samples", "|")})
    return dec(x)


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN ' ' || c_mktsegment ELSE c_mktsegment END AS s, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS n FROM customer),
    q AS (SELECT quantile_cont(n, 0.25) AS a, quantile_cont(n, 0.75) AS b FROM c)
    SELECT 'E' AS level, 'Q001' AS code, 'c_mktsegment' AS column_name, count_if(s = '') AS n, CAST(NULL AS VARCHAR) AS shown FROM c UNION ALL SELECT 'E', 'Q006', 'c_mktsegment', CAST(1 AS BIGINT), NULL UNION ALL
    SELECT 'E', 'Q005', 'c_mktsegment', CAST(count(DISTINCT trim(s)) AS BIGINT), string_agg(DISTINCT trim(s), '|' ORDER BY trim(s)) FROM c WHERE trim(s) NOT IN ('', 'BUILDING', 'MACHINERY') UNION ALL SELECT 'W', 'W102', 'c_custkey', count(*), NULL FROM customer
    UNION ALL SELECT 'W', 'W104', 'c_acctbal', count(*), NULL FROM c, q WHERE c.n < a - 1.5 * (b - a) OR c.n > b + 1.5 * (b - a) HAVING count(*) > 0""")
def quality_findings(spark, d):
    """RUL1, PRJ8."""
    x = quality.findings(_untidy_customers(spark, d), null_rate=0.1, enums={"c_mktsegment": ["BUILDING", "MACHINERY"]})
    return x.withColumn("shown", F.array_join("shown", "|"))


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
    SELECT event_id, CAST(value AS DECIMAL(18,4)) AS value FROM events, q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""")
def outliers_iqr(spark, d):
    """AGG18."""
    return dec(quality.outliers(read(spark, d, "events"), "value").select("event_id", "value"))


# --- differences and joins ---------------------------------------------------------------------------------------


@query(f"""WITH {VERSIONS_SQL} SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.st <> b.st OR a.p <> b.p THEN 'changed' ELSE 'unchanged' END AS status FROM a FULL JOIN b ON a.k = b.k""")
def table_diff(spark, d):
    """JN1, JN5: 1,234.50 and 1234.50 are the same cell."""
    return diff.table_diff(*inputs.order_versions(spark, d), ["k"]).select("k", "status")


@query(f"""WITH {VERSIONS_SQL}, j AS (SELECT a.k, a.st AS sa, b.st AS sb, a.p AS pa, b.p AS pb FROM a JOIN b USING (k))
    SELECT k, 'st' AS column_name, sa AS old, sb AS new FROM j WHERE sa <> sb UNION ALL SELECT k, 'p', CAST(pa AS VARCHAR), format('{{:,.2f}}', CAST(pb AS DOUBLE)) FROM j WHERE pa <> pb""")
def table_diff_cells(spark, d):
    """JN4."""
    return diff.changed_cells(diff.table_diff(*inputs.order_versions(spark, d), ["k"]), ["k"])


@query(f"WITH {VERSIONS_SQL} SELECT k FROM a ANTI JOIN b USING (k)")
def diff_removed(spark, d):
    """JN2, SET1."""
    a, b = inputs.order_versions(spark, d)
    return diff.only_in(a, b, ["k"]).select("k")


@query(f"WITH {VERSIONS_SQL} SELECT k, st FROM a SEMI JOIN b USING (k)")
def keys_in_both(spark, d):
    """SET2."""
    a, b = inputs.order_versions(spark, d)
    return diff.in_both(a, b, ["k"]).select("k", "st")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_per_key(spark, d):
    """WIN1."""
    return diff.first_per_key(read(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(f"""WITH RECURSIVE {LEDGERS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY cents ORDER BY line) AS k FROM a),
    r AS (SELECT cents, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS line_a, CAST(NULL AS BIGINT) AS line_b, CAST(NULL AS BIGINT) AS gap, CAST([] AS BIGINT[]) AS used FROM (SELECT DISTINCT cents FROM a)
      UNION ALL SELECT * FROM (SELECT r.cents, n.k, n.line AS line_a, b.line AS line_b, abs(date_diff('day', n.d, b.d)) AS gap, CASE WHEN b.line IS NULL THEN r.used ELSE list_append(r.used, b.line) END AS used
        FROM r JOIN n ON n.cents = r.cents AND n.k = r.k + 1 LEFT JOIN b ON b.cents = r.cents AND NOT list_contains(r.used, b.line) AND abs(date_diff('day', n.d, b.d)) <= 3
        QUALIFY row_number() OVER (PARTITION BY r.cents ORDER BY abs(date_diff('day', n.d, b.d)), b.line) = 1))
    SELECT line_a, line_b, CAST(gap AS INTEGER) AS gap FROM r WHERE line_b IS NOT NULL""")
def recon_exact(spark, d):
    """JN6: the greedy choice, by recursion over each amount's lines."""
    return reconcile.match_exact(*inputs.ledgers(spark, d), days=3)


@query(f"WITH {LEDGERS_SQL} SELECT count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM a")
def recon_totals(spark, d):
    """JN8, AGG13: what is matched and what is left add up to the side."""
    a, b = inputs.ledgers(spark, d)
    m = reconcile.match_exact(a, b, days=3)
    rest = reconcile.leftover(a, m, "line_a")
    return reconcile.totals(a.join(m, a.line == m.line_a, "left_semi").unionByName(rest))


@query(f"""WITH {LEDGERS_SQL} SELECT a.line AS line_a, b.line AS line_b, a.cents AS cents_a, b.cents AS cents_b, CAST(abs(date_diff('day', a.d, b.d)) AS INTEGER) AS gap FROM a JOIN b ON b.d BETWEEN a.d - 3 AND a.d + 3
    AND sign(a.cents) = sign(b.cents) AND a.cents <> b.cents AND abs(a.cents - b.cents) <= greatest(100, round(abs(a.cents) * 0.005))""")
def recon_near(spark, d):
    """JN9."""
    return reconcile.near_misses(*inputs.ledgers(spark, d), days=3, ratio=0.005)


@query(f"""WITH RECURSIVE {SPLIT_SQL}, r AS (SELECT CAST(-1 AS BIGINT) AS line, CAST([] AS BIGINT[]) AS lines, CAST([] AS BIGINT[]) AS used
      UNION ALL SELECT line, lines, list_concat(used, lines) FROM (SELECT a.line, s.lines, r.used, a.d, s.ds FROM r JOIN a ON a.line > r.line JOIN s ON s.t = a.cents AND NOT list_has_any(s.lines, r.used) QUALIFY row_number() OVER (PARTITION BY a.line ORDER BY s.ord) = 1)
        WHERE coalesce(list_max(list_transform(ds, lambda x: abs(date_diff('day', d, x)))), 0) <= 3 QUALIFY row_number() OVER (ORDER BY line) = 1)
    SELECT line AS line_a, lines AS lines_b FROM r WHERE line >= 0""")
def recon_split(spark, d):
    """JN7: orders that are sums of a few entries, in the order of lines."""
    return reconcile.match_split(*inputs.split_ledgers(spark, d), days=3)


# --- rule packs --------------------------------------------------------------------------------------------------

_CLAIMS = """c AS (SELECT o_orderkey AS line, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 83 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS person, o_orderpriority AS type,
    CAST(CASE WHEN o_orderkey % 97 = 0 THEN 0 WHEN o_orderkey % 89 = 0 THEN -floor(o_totalprice * 100 + 0.5) ELSE floor(o_totalprice * 100 + 0.5) END AS BIGINT) AS cents, o_orderkey % 9973 AS inv FROM orders)"""


@query(f"""WITH {_CLAIMS} SELECT line, 'E' AS level, 'E401' AS code FROM c WHERE person = '' UNION ALL SELECT line, 'E', 'E402' FROM c WHERE cents = 0 UNION ALL SELECT line, 'W', 'W506' FROM c WHERE cents < 0
    UNION ALL SELECT line, 'W', 'W503' FROM c WHERE date_diff('day', d, DATE '2000-01-01') > 2000 UNION ALL SELECT line, 'E', 'E406' FROM c WHERE d > DATE '2000-01-01'
    UNION ALL SELECT min(line), 'E', 'E403' FROM c GROUP BY inv HAVING count(*) > 1 UNION ALL SELECT min(line), 'W', 'W504' FROM c WHERE person <> '' GROUP BY person, d, cents, type HAVING count(*) > 1
    UNION ALL SELECT line, 'W', 'W501' FROM c WHERE type = '1-URGENT' AND cents > 20000000""")
def expense_audit(spark, d):
    """RUL2, JN12, SET4."""
    limits = spark.createDataFrame([(" 1-urgent", 20_000_000)], "type string, cents long")
    return audit.expense_findings(inputs.claims(spark, d), as_of="2000-01-01", limits=limits, max_age_days=2000)


@query(f"WITH {_CLAIMS} SELECT CAST(0 AS BIGINT) AS line, 'E' AS level, 'E405' AS code FROM c HAVING sum(cents) <> 1")
def expense_total(spark, d):
    """AGG12."""
    return audit.total_mismatch(inputs.claims(spark, d), 1)


_INVOICES = """i AS (SELECT l_orderkey * 10 + l_linenumber AS line, l_suppkey % 1000 AS code, floor(l_extendedprice * 100 + 0.5) / 100 AS amount, floor(l_extendedprice * l_tax * 100 + 0.5) / 100 AS tax, l_tax AS rate, l_orderkey, CAST(l_shipdate AS DATE) AS d FROM lineitem),
    t AS (SELECT *, CASE WHEN l_orderkey % 7 = 0 THEN amount + tax + 1 ELSE amount + tax END AS total, floor(amount * rate * 100 + 0.5) / 100 AS due FROM i),
    f AS (SELECT line, 'E' AS level, 'E105' AS code FROM t WHERE NOT list_contains([0, 1, 3, 5, 6, 9, 10, 11, 13, 16, 17], CAST(round(rate * 100) AS INTEGER)) UNION ALL SELECT line, 'E', 'E103' FROM t WHERE abs(due - tax) > 0.02 + 1e-9
    UNION ALL SELECT line, 'E', 'E104' FROM t WHERE abs(floor((amount + tax) * 100 + 0.5) / 100 - total) > 0.01 + 1e-9 UNION ALL SELECT line, 'E', 'E106' FROM t WHERE d > DATE '1998-01-01' UNION ALL SELECT line, 'W', 'W302' FROM t WHERE date_diff('day', d, DATE '1998-01-01') > 365
    UNION ALL SELECT line, 'E', 'E102' FROM t WHERE NOT regexp_full_match(lpad(CAST(line AS VARCHAR), 8, '0'), '[0-9]{8}') UNION ALL SELECT min(line), 'E', 'E201' FROM t GROUP BY lpad(CAST(code AS VARCHAR), 10, '1'), lpad(CAST(line AS VARCHAR), 8, '0') HAVING count(*) > 1)"""


@query(f"WITH {_INVOICES} SELECT line, level, code FROM f")
def invoice_check(spark, d):
    """RUL3, MTH8, MTH9."""
    return audit.invoice_findings(inputs.invoices(spark, d), as_of="1998-01-01")


@query(f"WITH {_INVOICES} SELECT level, code, count(*) AS n FROM f GROUP BY ALL")
def finding_tally(spark, d):
    """AGG19."""
    return audit.tally(audit.invoice_findings(inputs.invoices(spark, d), as_of="1998-01-01"))


# --- scans -------------------------------------------------------------------------------------------------------


_LUHN_SQL = "list_sum(list_transform(range(1, len({x}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr({x}, len({x}) - i + 1, 1) AS INTEGER) ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(substr({x}, len({x}) - i + 1, 1) AS INTEGER) + 1] END)) % 10 = 0"


_PERSON_SQL = "substr('10X98765432', CAST(list_sum(list_transform(range(1, 18), lambda i: CAST(substr(x, i, 1) AS INTEGER) * [7,9,10,5,8,4,2,1,6,3,7,9,10,5,8,4,2][i])) % 11 AS INTEGER) + 1, 1) = upper(right(x, 1)) AND right(x, 1) <> '2' AND coalesce(try_strptime(substr(x, 7, 8), '%Y%m%d') BETWEEN '1900-01-01' AND now(), false)"
_CREDIT_SQL = "regexp_full_match(upper(x), '[0-9ABCDEFGHJKLMNPQRTUWXY]{18}') AND substr('0123456789ABCDEFGHJKLMNPQRTUWXY', CAST((31 - list_sum(list_transform(range(1, 18), lambda i: (instr('0123456789ABCDEFGHJKLMNPQRTUWXY', substr(upper(x), i, 1)) - 1) * [1,3,9,27,19,26,16,17,20,29,25,13,8,24,10,30,28][i])) % 31) % 31 AS INTEGER) + 1, 1) = upper(right(x, 1))"


def _counted_sql(kind: str, valid: str = "true") -> str:
    shape = scan.PII[kind][0].replace(scan._A, r"\b").replace(scan._Z, r"\b")
    return f"CAST(len(list_filter(regexp_extract_all(text, '{shape}'), lambda x: {valid})) AS INTEGER) AS {kind}"


@query(f"""SELECT doc_id, {_counted_sql('idcard', _PERSON_SQL)}, {_counted_sql('uscc', _CREDIT_SQL)}, {_counted_sql('email')}, {_counted_sql('ipv4', "list_max(list_transform(string_split(x, '.'), lambda y: CAST(y AS INTEGER))) <= 255")},
    {_counted_sql('phone')}, {_counted_sql('bank', _LUHN_SQL.format(x="x"))}, {_counted_sql('plate')} FROM documents""")
def pii_counts(spark, d):
    """TXT1, MTH11, RUL4: all seven types."""
    return scan.pii_counts(read(spark, d, "documents"), tuple(scan.PII))


@query(r"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[0-9]{16,19}\b')) AS v FROM documents), s AS (SELECT doc_id, v, list_sum(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN (i % 2) = 1 THEN CAST(substr(v, len(v) - i + 1, 1) AS INTEGER)
    ELSE (CAST(substr(v, len(v) - i + 1, 1) AS INTEGER) * 2) % 10 + (CAST(substr(v, len(v) - i + 1, 1) AS INTEGER) * 2) // 10 END)) AS t FROM n) SELECT doc_id, v, t % 10 = 0 AS valid FROM s""")
def pii_luhn(spark, d):
    """MTH6."""
    x = read(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?<![0-9A-Za-z_])[0-9]{16,19}(?![0-9A-Za-z_])"), F.lit(0))).alias("v"))
    return x.select("doc_id", "v", checks.luhn("v").alias("valid"))


@query(r"""SELECT doc_id, sha256(regexp_replace(text, '([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*(@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', '\1***\2', 'g')) AS digest FROM documents""")
def redact_email(spark, d):
    """TXT5."""
    return read(spark, d, "documents").select("doc_id", F.sha2(scan.redact("text", ("email",)), 256).alias("digest"))


def _placed_sql(text: str, shape: str) -> str:
    """The matches of a pattern in a text with their places, counted from 1: what stands between them tells where they are."""
    shape = shape.replace("'", "''")
    return f"""list_transform(list_zip(regexp_extract_all({text}, '{shape}'), list_transform(regexp_split_to_array({text}, '{shape}'), lambda x: len(x))), lambda x, i: {{'v': x[1], 'i': i, 'gap': x[2]}})"""


_MASK_SQL = """CASE type WHEN 'phone' THEN left(v, 3) || '****' || right(v, 4) WHEN 'email' THEN left(v, 1) || '***' || substr(v, strpos(v, '@')) WHEN 'plate' THEN left(v, 2) || '***' || right(v, 2) WHEN 'uscc' THEN left(v, 2) || repeat('*', 12) || right(v, 4)
    WHEN 'ipv4' THEN split_part(v, '.', 1) || '.' || split_part(v, '.', 2) || '.*.*' ELSE repeat('*', len(v) - 4) || right(v, 4) END"""
_VALID_SQL = {"idcard": _PERSON_SQL, "bank": _LUHN_SQL.format(x="x"), "uscc": _CREDIT_SQL, "ipv4": "list_max(list_transform(string_split(x, '.'), lambda y: CAST(y AS INTEGER))) <= 255"}


def _spans_sql(types: tuple[str, ...]) -> str:
    kinds = " UNION ALL ".join(f"""SELECT doc_id, '{k}' AS type, unnest({_placed_sql("text", scan.PII[k][0].replace(scan._A, chr(92) + 'b').replace(scan._Z, chr(92) + 'b'))}) AS m FROM documents""" for k in types)
    valid = " ".join(f"WHEN '{k}' THEN {_VALID_SQL[k]}" for k in types if k in _VALID_SQL)
    return f"""WITH RECURSIVE m AS ({kinds}), p AS (SELECT doc_id, type, m.v AS x, CAST(sum(m.gap + len(m.v)) OVER (PARTITION BY doc_id, type ORDER BY m.i) - len(m.v) AS INTEGER) AS start FROM m WHERE m.v IS NOT NULL),
    h AS (SELECT doc_id, type, x AS v, start, CAST(start + len(x) AS INTEGER) AS stop FROM p WHERE {f"CASE type {valid} ELSE true END" if valid else "true"}),
    r AS (SELECT doc_id, min({{'a': start, 'b': -stop, 'type': type, 'v': v}}) AS s FROM h GROUP BY doc_id UNION ALL SELECT h.doc_id, min({{'a': h.start, 'b': -h.stop, 'type': h.type, 'v': h.v}}) FROM r JOIN h ON h.doc_id = r.doc_id AND h.start >= -r.s.b GROUP BY h.doc_id),
    s AS (SELECT doc_id, s.type AS type, s.a AS start, -s.b AS stop, s.v AS v FROM r)
    SELECT doc_id, type, start, stop, CAST(len(left(text, start)) - len(replace(left(text, start), chr(10), '')) + 1 AS INTEGER) AS line, {_MASK_SQL} AS masked FROM s JOIN documents USING (doc_id)"""


@query(_spans_sql(scan.DEFAULT_PII))
def pii_spans(spark, d):
    """TXT1, WIN7, RUL4: spans of several types, overlaps settled."""
    return scan.pii_spans(read(spark, d, "documents"))


@query(_spans_sql(tuple(scan.PII)))
def pii_spans_all(spark, d):
    """PRJ14, TXT1: spans of all types."""
    return scan.pii_spans(read(spark, d, "documents"), scan.chosen_types("all"))


@query(_spans_sql(("email", "ipv4")))
def pii_spans_chosen(spark, d):
    """PRJ14, TXT1: spans of two types."""
    return scan.pii_spans(read(spark, d, "documents"), scan.chosen_types("email, ipv4"))


@query(f"""WITH {inputs.LEAKY_SQL} SELECT doc_id, 2 AS line, pos AS "column", 1 AS nth, rule, level, masked FROM k WHERE rule = 'aws_ak'""")
def leak_aws(spark, d):
    """TXT2, STR7, SRT7."""
    return scan.leak_findings(inputs.leaky_texts(spark, d), ("aws_ak",))


@query(f"""WITH {inputs.LEAKY_SQL} SELECT doc_id, 2 AS line, pos AS "column", CAST(list_position({list(scan.LEAKS)}, rule) AS INTEGER) AS nth, rule, level, masked FROM k WHERE rule <> ''""")
def leak_rules(spark, d):
    """RUL5, TXT2, SRT7: planted keys of eight kinds and what only looks like one."""
    return scan.leak_findings(inputs.leaky_texts(spark, d))


def _leak_sql() -> str:
    secret = r"""regexp_replace(x, '^[^:=]*[:=]\s*["'']?', '')"""
    fits = lambda v: f"regexp_full_match({v}, '(?i){scan._PLACEHOLDER.pattern}')"
    person = "substr('10X98765432', CAST(list_sum(list_transform(range(1, 18), lambda i: CAST(substr(x, i, 1) AS INTEGER) * [7,9,10,5,8,4,2,1,6,3,7,9,10,5,8,4,2][i])) % 11 AS INTEGER) + 1, 1) = upper(right(x, 1)) AND try_strptime(substr(x, 7, 8), '%Y%m%d') BETWEEN '1900-01-01' AND now()"
    kept = {
        "db_url": f"NOT {fits(chr(39).join(['regexp_extract(x, ', '//[^:]+:([^@]+)@', ', 1)']))}", "generic_secret": f"NOT {fits(secret)} AND NOT regexp_matches({secret}, '[:=]$|^[0-9]+$') AND NOT (regexp_full_match({secret}, '[a-z]+') AND len({secret}) < 12)",
        "idcard": person, "bank": _LUHN_SQL.format(x="x"), "email": r"NOT regexp_matches(x, '(?i)@(example|test|localhost|domain)\.')",
    }
    shape = lambda rule: scan.LEAKS[rule][0].replace(r"(?a:\b)", r"\b").replace("'", "''")
    parts = [f"SELECT doc_id, '{rule}' AS rule, '{scan.LEAKS[rule][1]}' AS level, x FROM (SELECT doc_id, unnest(regexp_extract_all(v, '{shape(rule)}')) AS x FROM l) WHERE {kept.get(rule, 'true')}" for rule in scan.LEAKS]
    return f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS v FROM documents) SELECT doc_id, rule, level, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


@query(_leak_sql())
def leak_tally(spark, d):
    """RUL5, TXT2: findings of every rule in each document."""
    return scan.leak_findings(read(spark, d, "documents")).groupBy("doc_id", "rule", "level").agg(F.count(F.lit(1)).alias("n"))


def _leaks_sql() -> str:
    holder = "(?i)" + scan._PLACEHOLDER.pattern.replace("'", "''")
    value = """regexp_replace(x, '^[^:=]*[:=]\\s*["'']?', '')"""
    kept = {
        "db_url": f"NOT regexp_full_match(substr(split_part(x, '@', 1), strpos(x, '://') + 3 + strpos(substr(x, strpos(x, '://') + 3), ':')), '{holder}')",
        "generic_secret": f"NOT (regexp_full_match({value}, '{holder}') OR right({value}, 1) IN (':', '=') OR regexp_full_match({value}, '[0-9]+') OR (regexp_full_match({value}, '[a-z]+') AND len({value}) < 12))",
        "idcard": _PERSON_SQL, "bank": _LUHN_SQL.format(x="x"), "email": "NOT regexp_matches(x, '(?i)@(example|test|localhost|domain)\\.')",
    }
    plain = {rule: shape.replace(scan._B, chr(92) + "b") for rule, (shape, *_) in scan.LEAKS.items()}
    rules = " UNION ALL ".join(f"""SELECT doc_id, line, CAST({k} AS INTEGER) AS nth, '{rule}' AS rule, '{scan.LEAKS[rule][1]}' AS level, unnest({_placed_sql("t", shape)}) AS m FROM l WHERE regexp_matches(t, '{shape.replace("'", "''")}')""" for k, (rule, shape) in enumerate(plain.items(), 1))
    valid = " ".join(f"WHEN '{rule}' THEN {c}" for rule, c in kept.items())
    return f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ts FROM documents), l AS (SELECT doc_id, unnest(ts) AS t, CAST(unnest(range(1, len(ts) + 1)) AS INTEGER) AS line FROM d), m AS ({rules}),
    p AS (SELECT doc_id, line, nth, rule, level, m.v AS x, CAST(sum(m.gap + len(m.v)) OVER (PARTITION BY doc_id, line, rule ORDER BY m.i) - len(m.v) + 1 AS INTEGER) AS "column" FROM m WHERE m.v IS NOT NULL)
    SELECT doc_id, line, "column", nth, rule, level, CASE WHEN len(x) <= 8 THEN repeat('*', len(x)) ELSE left(x, 4) || repeat('*', CAST(least(12, len(x) - 8) AS INTEGER)) || right(x, 4) END AS masked FROM p WHERE CASE rule {valid} ELSE true END"""


@query(_leaks_sql())
def leak_scan(spark, d):
    """TXT2, RUL5, SRT7: all rules over all documents."""
    return scan.leak_findings(read(spark, d, "documents"))


@query(r"""WITH t AS (SELECT doc_id, lower(text) AS t FROM documents), w AS (SELECT * FROM (VALUES ('license', 'licensed under', 'licensed under'), ('license', 'licensed under', 'cc by'), ('license', 'licensed under', 'all rights reserved'),
    ('insult', 'idiot', 'idiot'), ('insult', 'idiot', 'clown'), ('insult', 'idiot', 'loser'), ('credential', 'password', 'password'), ('credential', 'password', 'token'), ('credential', 'password', 'api key')) v(category, word, v))
    SELECT doc_id, category, word, CAST(sum((len(text) - len(replace(text, v, ''))) / len(v)) AS BIGINT) AS n FROM documents, w WHERE contains(text, v) GROUP BY ALL""")
def lexicon_scan(spark, d):
    """TXT3, JN13."""
    return scan.word_hits(read(spark, d, "documents"), inputs.word_list(spark), normalise=False)


@query(f"""WITH {inputs.ADVERTISEMENTS_SQL} SELECT doc_id, CAST(start AS INTEGER) AS start, line, word, level, replace(substring(text, CAST(greatest(0, start - 12) + 1 AS BIGINT), CAST(start + len(word) + 12 - greatest(0, start - 12) AS BIGINT)), chr(10), ' ') AS context
    FROM c JOIN {inputs.AD_LEVELS_SQL} USING (word)""")
def ad_scan(spark, d):
    """TXT3, RUL6: restricted words of advertisements, settled against each other and against plain facts."""
    return lexicons.ad_findings(inputs.advertisements(spark, d))


@query(f"""WITH {inputs.POSTS_SQL} SELECT doc_id, x.c AS category, x.w AS word, replace(array_to_string(string_split(x.v, ''), chr(1)), chr(1), mark) AS matched, CAST(doc_id % 3 + 1 AS INTEGER) AS line FROM p""")
def banned_scan(spark, d):
    """TXT4, RUL7: banned words however they are set apart."""
    return lexicons.word_spans(inputs.posts(spark, d), lexicons.banned_words(spark))


@query(f"""WITH {inputs.ADVERTISEMENTS_SQL} SELECT doc_id, word, level FROM c JOIN {inputs.AD_LEVELS_SQL} USING (word) WHERE level <> 'low'""")
def ad_scan_levels(spark, d):
    """PRJ13, SRT6: findings from a level up."""
    return lexicons.ad_findings(inputs.advertisements(spark, d), min_level="medium").select("doc_id", "word", "level")


def _plain_sql(column: str) -> str:
    quoted = scan.IGNORED.replace("'", "''")
    return f"regexp_replace(lower(translate({column}, '{text.FULL}', '{text.HALF}')), '{quoted}', '', 'g')".replace(text.HALF, text.HALF.replace("'", "''"))


_WORDS_SQL = ", ".join(f"('{c}', '{w}', '{v}')" for c, w, vs in inputs.WORDS for v in (w, *vs))


@query(f"""WITH t AS (SELECT doc_id, {_plain_sql("text")} AS t FROM documents), w AS (SELECT DISTINCT category, word, {_plain_sql("v")} AS v FROM (VALUES {_WORDS_SQL}) x(category, word, v))
    SELECT doc_id, category, word, CAST(sum((len(t) - len(replace(t, v, ''))) / len(v)) AS BIGINT) AS n FROM t, w WHERE contains(t, v) GROUP BY ALL""")
def obfuscated_scan(spark, d):
    """TXT4, STR23: words between which punctuation, blanks or zero-width characters stand."""
    return scan.word_hits(read(spark, d, "documents"), inputs.word_list(spark))


def _clauses_sql(texts: str, profile: list[tuple[str, bool, list[str]]]) -> str:
    rows = ", ".join(f"('{c}', {r}, {i}, '{k}')" for c, r, ks in profile for i, k in enumerate(ks))
    return f"""WITH t AS ({texts}), k AS (SELECT * FROM (VALUES {rows}) v(clause, required, i, k)), h AS (SELECT doc_id, t, clause, required, i, k, (len(t) - len(replace(t, k, ''))) / len(k) AS n, nullif(strpos(t, k), 0) AS pos FROM t, k)
    SELECT doc_id, clause, required, CAST(sum(n) AS BIGINT) AS hits, CAST(min(len(left(t, pos - 1)) - len(replace(left(t, pos - 1), chr(10), '')) + 1) AS INTEGER) AS line,
    coalesce(array_to_string(list_slice(list(k ORDER BY i) FILTER (n > 0), 1, 3), '|'), '') AS sample, required AND sum(n) = 0 AS missing FROM h GROUP BY doc_id, clause, required"""


@query(_clauses_sql("SELECT doc_id, text AS t FROM documents", inputs.CLAUSES))
def clause_coverage(spark, d):
    """AGG22, RUL8."""
    return scan.clause_coverage(read(spark, d, "documents"), inputs.clauses(spark)).withColumn("sample", F.array_join("sample", "|"))


_GENERAL = [(c, r, ks.split()) for c, r, ks in lexicons.CONTRACTS["general"]]
_CONTRACT_WORDS = [k for _, _, ks in _GENERAL for k in ks]


@query(_clauses_sql(f"SELECT o_orderkey AS doc_id, '合同' || chr(10) || {_CONTRACT_WORDS}[CAST(o_orderkey % {len(_CONTRACT_WORDS)} AS INTEGER) + 1] || '：' || repeat({_CONTRACT_WORDS}[CAST(o_custkey % {len(_CONTRACT_WORDS)} AS INTEGER) + 1] || chr(10), CAST(o_orderkey % 3 AS INTEGER)) AS t FROM orders", _GENERAL))
def contract_review(spark, d):
    """RUL8, AGG22: contracts with one to three words of the built-in profile."""
    words, n = F.array(*map(F.lit, _CONTRACT_WORDS)), len(_CONTRACT_WORDS)
    pick = lambda k: F.get(words, (F.col(k) % n).cast("int"))
    t = F.concat(F.lit("合同\n"), pick("o_orderkey"), F.lit("："), F.repeat(F.concat(pick("o_custkey"), F.lit("\n")), (F.col("o_orderkey") % 3).cast("int")))
    return lexicons.contract_clauses(read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), t.alias("text"))).withColumn("sample", F.array_join("sample", "|"))


@query("""SELECT o_orderkey AS doc_id, p AS pair, CASE WHEN o_orderkey % 4 = 3 THEN 'both' ELSE 'single' END AS status FROM orders, (VALUES ('甲方/乙方')) v(p) WHERE o_orderkey % 4 <> 0""")
def contract_parties(spark, d):
    """AGG23: one side named, the other, or both."""
    k = F.col("o_orderkey") % 4
    t = F.concat(F.when(k.isin(1, 3), "甲方：A\n").otherwise(""), F.when(k >= 2, "乙方：B\n").otherwise("丙"))
    return lexicons.contract_parties(read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), t.alias("text")))


@query("""SELECT o_orderkey AS doc_id, CAST(nth AS INTEGER) AS nth, found FROM orders, (VALUES (0, '____'), (1, '（ ）'), (2, 'TBD')) v(nth, found) WHERE nth <= o_orderkey % 4 - 1""")
def blanks_to_fill(spark, d):
    """TXT6."""
    t = F.array_join(F.slice(F.array(F.lit("No. ____"), F.lit("by （ ）"), F.lit("on TBD")), F.lit(1), (F.col("o_orderkey") % 4).cast("int")), "; ")
    return scan.placeholders(read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), t.alias("text"))).withColumn("nth", F.col("nth").cast("int"))


# --- files -------------------------------------------------------------------------------------------------------


def _files(spark, d):
    t = F.col("text").cast("binary")
    return read(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("path"), F.octet_length("text").cast("long").alias("bytes"), t.alias("content"), F.timestamp_seconds("doc_id").alias("mtime"))


@query("""WITH h AS (SELECT lpad(CAST(doc_id AS VARCHAR), 10, '0') AS path, octet_length(encode(text)) AS bytes, sha256(text) AS hash FROM documents), g AS (SELECT hash, count(*) AS n FROM h GROUP BY 1 HAVING count(*) > 1)
    SELECT path, CAST(bytes AS BIGINT) AS bytes, hash, n, CAST(row_number() OVER (PARTITION BY hash ORDER BY path) AS INTEGER) AS rank FROM h JOIN g USING (hash)""")
def dup_documents(spark, d):
    """AGG20, WIN3."""
    return files.duplicates(_files(spark, d)).select("path", "bytes", "hash", "n", "rank")


@query("""WITH h AS (SELECT lpad(CAST(doc_id AS VARCHAR), 10, '0') AS path, octet_length(encode(text)) AS bytes, sha256(text) AS hash FROM documents)
    SELECT count(*) AS n_files, CAST(sum(bytes) AS BIGINT) AS bytes, sha256(string_agg(path || chr(0) || CAST(bytes AS VARCHAR) || chr(0) || hash || chr(10), '' ORDER BY path)) AS root FROM h""")
def manifest_root(spark, d):
    """AGG21, SNK5: the flat digest that other tools write."""
    return files.root_hash(files.manifest(_files(spark, d)), buckets=1)


#: crc32 of a path, bit by bit.
_CRC_SQL = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(path, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END), CAST(4294967295 AS BIGINT))"""


@query(f"""WITH h AS (SELECT lpad(CAST(doc_id AS VARCHAR), 10, '0') AS path, octet_length(encode(text)) AS bytes, sha256(text) AS hash FROM documents),
    b AS (SELECT {_CRC_SQL} % 1024 AS b, count(*) AS n, sum(bytes) AS bytes, sha256(string_agg(path || chr(0) || CAST(bytes AS VARCHAR) || chr(0) || hash || chr(10), '' ORDER BY path)) AS digest FROM h GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS n_files, CAST(sum(bytes) AS BIGINT) AS bytes, sha256(string_agg(digest, '' ORDER BY b)) AS root FROM b""")
def manifest_tree(spark, d):
    """AGG21 for any number of files."""
    return files.root_hash(files.manifest(_files(spark, d)))


@query("""SELECT lpad(CAST(doc_id AS VARCHAR), 10, '0') AS path, CASE WHEN doc_id % 10 = 1 THEN 'removed' WHEN doc_id % 10 = 2 THEN 'modified' WHEN doc_id % 10 = 3 THEN 'touched' ELSE 'unchanged' END AS status FROM documents""")
def manifest_verify(spark, d):
    """JN11, JN10."""
    old = files.manifest(_files(spark, d))
    k = F.col("path").cast("long") % 10
    new = old.where(k != 1).withColumn("hash", F.when(k == 2, F.lit("0")).otherwise(F.col("hash"))).withColumn("mtime", F.when(k == 3, F.timestamp_seconds(F.lit(0))).otherwise(F.col("mtime")))
    return files.compare(old, new)


@query("""SELECT lpad(CAST(doc_id AS VARCHAR), 10, '0') AS path, CASE doc_id % 97 WHEN 1 THEN 'removed' WHEN 2 THEN 'modified' WHEN 3 THEN 'touched' END AS status FROM documents WHERE doc_id % 97 IN (1, 2, 3)
    UNION ALL SELECT 'new/' || lpad(CAST(doc_id AS VARCHAR), 10, '0'), 'added' FROM documents WHERE doc_id % 97 = 4""")
def manifest_changes(spark, d):
    """JN10, JN11, AGG21: what changed between two snapshots, by descent of their trees of digests."""
    old = files.manifest(_files(spark, d))
    k = F.col("path").cast("long") % 97
    new = old.where(k != 1).withColumn("hash", F.when(k == 2, F.lit("0")).otherwise(F.col("hash"))).withColumn("mtime", F.when(k == 3, F.timestamp_seconds(F.lit(0))).otherwise(F.col("mtime")))
    new = new.union(old.where(k == 4).withColumn("path", F.concat(F.lit("new/"), "path")))
    folders = inputs.scratch(spark, "old"), inputs.scratch(spark, "new")
    for entries, folder in zip((old, new), folders, strict=True):
        files.snapshot(entries, folder)
    return files.compare_snapshots(spark, *folders)


@query("""SELECT p_name AS name, lower(replace(p_name, ' ', '-')) || '.txt' AS new_name FROM part""")
def rename_case(spark, d):
    """STR9, STR12, SNK7."""
    x = read(spark, d, "part").select(F.concat(F.lit("d"), (F.col("p_partkey")).cast("string"), F.lit("/"), F.col("p_name"), F.lit(".txt")).alias("path"), F.lit(0).alias("bytes"), F.current_timestamp().alias("mtime"))
    return files.rename_plan(x, style="kebab").select(F.regexp_replace("name", r"\.txt$", "").alias("name"), "new_name")


@query("""SELECT 'p' || (p_partkey % 5) || '/' AS dir, p_partkey || '.csv' AS name, 'file_' || lpad(CAST(row_number() OVER (PARTITION BY p_partkey % 5 ORDER BY 'p' || (p_partkey % 5) || '/' || p_partkey || '.csv') AS VARCHAR), 5, '0') || '.csv' AS new_name, CAST(NULL AS VARCHAR) AS problem FROM part""")
def rename_sequence(spark, d):
    """WIN2, WIN8, STR11, STR13."""
    x = read(spark, d, "part").select(F.concat(F.lit("p"), (F.col("p_partkey") % 5).cast("string"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".csv")).alias("path"), F.lit(0).alias("bytes"), F.current_timestamp().alias("mtime"))
    return files.rename_plan(x, template="file_{seq}.{ext}", pad=5)


# --- calendars and timetables ------------------------------------------------------------------------------------


@query(f"""WITH {HOLIDAYS_SQL}, x AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) + 15 AS nominal FROM orders)
    SELECT k, nominal, min(kinds.d) AS actual, min(kinds.d) > nominal AS postponed, false AS uncovered FROM x JOIN kinds ON kinds.d BETWEEN nominal AND nominal + 30 AND kind = 'workday' GROUP BY k, nominal""")
def calendar_deadline(spark, d):
    """DT5, DT6, JN17."""
    x = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("s"))
    return calendars.deadlines(x, inputs.holidays(spark), start="s", key="k", amount=15)


@query(f"""WITH {HOLIDAYS_SQL}, w AS (SELECT d, row_number() OVER (ORDER BY d) AS n FROM kinds WHERE kind = 'workday'), x AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) + 1 AS s FROM orders),
    y AS (SELECT k, (SELECT count(*) FROM w WHERE w.d < x.s) + 10 AS n FROM x) SELECT k, w.d AS actual FROM y JOIN w USING (n)""")
def workday_nth(spark, d):
    """DT7."""
    x = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("s"))
    return calendars.nth_workday(x, inputs.holidays(spark), start="s", key="k", n=10)


@query(f"WITH {HOLIDAYS_SQL} SELECT s.start, kinds.d, kind, CAST(isodow(kinds.d) AS INTEGER) AS weekday FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS start FROM orders) s JOIN kinds ON kinds.d BETWEEN s.start AND s.start + 6")
def day_list(spark, d):
    """DT8, DT16, TT6."""
    x = read(spark, d, "orders").select(F.to_date("o_orderdate").alias("s"))
    return calendars.next_days(x, inputs.holidays(spark), start="s", n=7).select("start", "d", "kind", "weekday")


@query("""WITH x AS (SELECT event_id, ts FROM events), g AS (SELECT DISTINCT date_trunc('day', ts) AS day0 FROM x), c AS (SELECT day0, day0 + INTERVAL 1 DAY * i + INTERVAL 1 MINUTE * m AS t FROM g, range(0, 30) r(i), (VALUES (510), (525), (1050), (1065)) v(m)
    WHERE dayofweek(day0 + INTERVAL 1 DAY * i) BETWEEN 1 AND 5), n AS (SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY c.t) AS nth, c.t FROM x JOIN c ON c.day0 = date_trunc('day', x.ts) AND c.t > ts)
    SELECT event_id, CAST(nth AS INTEGER) AS nth, t AS "at" FROM n WHERE nth <= 3""")
def cron_next(spark, d):
    """DT9, DT10, SET6."""
    return calendars.cron_next(read(spark, d, "events"), "30-59/15 8,17 * * mon-fri", start="ts", key="event_id", n=3)


# --- documents and formats ---------------------------------------------------------------------------------------


@query("SELECT event_id, json_valid(props) AS valid FROM events")
def json_validity(spark, d):
    """JSN2."""
    return documents.json_validity(read(spark, d, "events"), "props").select("event_id", "valid")


@query("WITH k AS (SELECT unnest(json_keys(props)) AS key FROM events) SELECT key, count(*) AS n, count(*) < (SELECT count(*) FROM events) AS optional FROM k GROUP BY key")
def json_shape(spark, d):
    """AGG25."""
    return documents.json_shape(read(spark, d, "events"), "props")


@query("""WITH t AS (SELECT CAST(n_nationkey AS VARCHAR) AS a, n_name AS b, CAST(n_regionkey AS VARCHAR) AS c FROM nation), w AS (SELECT CAST(greatest(11, max(len(a))) AS INTEGER) AS wa, CAST(greatest(6, max(len(b))) AS INTEGER) AS wb, CAST(greatest(11, max(len(c))) AS INTEGER) AS wc FROM t)
    SELECT CAST(row_number() OVER (ORDER BY CAST(a AS INTEGER)) + 1 AS BIGINT) AS line, '| ' || lpad(a, wa, ' ') || ' | ' || rpad(b, wb, ' ') || ' | ' || lpad(c, wc, ' ') || ' |' AS text FROM t, w
    UNION ALL SELECT 0, '| ' || lpad('n_nationkey', wa, ' ') || ' | ' || rpad('n_name', wb, ' ') || ' | ' || lpad('n_regionkey', wc, ' ') || ' |' FROM w UNION ALL SELECT 1, '| ' || repeat('-', wa - 1) || ':' || ' | ' || repeat('-', wb) || ' | ' || repeat('-', wc - 1) || ':' || ' |' FROM w""")
def markdown_table(spark, d):
    """SNK4, STR8, STR16, STR17."""
    return documents.markdown_table(read(spark, d, "nation"), ["n_nationkey"])


@query()
def markdown_lint(spark, d):
    """RUL9, WIN5, WIN6."""
    return documents.lint(read(spark, d, "documents"))


def _capital_sql(cents: str) -> str:
    digit = lambda x: f"substr('{numbers.CAPITALS}', CAST({x} AS INTEGER) + 1, 1)"
    places = "[" + ", ".join(f"'{p}'" for p in numbers.PLACES) + "]"
    four = lambda k: f"substr(s, {4 * k + 1}, 4)"
    section = lambda k, name: f"""CASE WHEN {four(k)} = '0000' THEN '零' ELSE regexp_replace(array_to_string(list_transform([1, 2, 3, 4], lambda j: CASE WHEN substr({four(k)}, j, 1) = '0' THEN '零' ELSE {digit(f"substr({four(k)}, j, 1)")} || {places}[j] END), ''), '零+$', '') || '{name}' END"""
    whole = " || ".join(section(k, name) for k, name in enumerate(numbers.SECTIONS))
    text = f"regexp_replace(regexp_replace({whole}, '零+', '零', 'g'), '^零|零$', '', 'g')"
    return f"""SELECT *, CASE WHEN c < 0 THEN '负' ELSE '' END || CASE WHEN abs(c) < 100 THEN '零' ELSE {text} END || '元' || CASE WHEN j = 0 AND f = 0 THEN '整' WHEN f = 0 THEN {digit('j')} || '角' WHEN j = 0 THEN '零' || {digit('f')} || '分' ELSE {digit('j')} || '角' || {digit('f')} || '分' END AS capital
    FROM (SELECT *, lpad(CAST(abs(c) // 100 AS VARCHAR), 16, '0') AS s, abs(c) // 10 % 10 AS j, abs(c) % 10 AS f FROM ({cents}))"""


@query(f"SELECT c_custkey, capital FROM ({_capital_sql('SELECT c_custkey, CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) AS c FROM customer')})")
def capital_amounts(spark, d):
    """MTH3."""
    return read(spark, d, "customer").select("c_custkey", numbers.capital_amount(F.floor(F.col("c_acctbal") * 100 + 0.5).cast("long")).alias("capital"))


@query(f"SELECT o_orderkey, capital FROM ({_capital_sql('SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN o_orderkey * 100000 WHEN 1 THEN o_custkey * 1000000007 WHEN 2 THEN -o_orderkey * 10000001000 WHEN 3 THEN o_orderkey % 100 ELSE o_orderkey * 10007000305 END AS BIGINT) AS c FROM orders')})")
def capital_large(spark, d):
    """MTH3: amounts from cents to trillions, with zeros inside."""
    k, u = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    cents = F.when(k % 5 == 0, k * 100000).when(k % 5 == 1, u * 1000000007).when(k % 5 == 2, -k * 10000001000).when(k % 5 == 3, k % 100).otherwise(k * 10007000305)
    return read(spark, d, "orders").select("o_orderkey", numbers.capital_amount(cents).alias("capital"))


@query("""SELECT doc_id, n, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN printf('%.1f KB', round(n / 1024.0, 1)) WHEN n < 1073741824 THEN printf('%.1f MB', round(n / 1048576.0, 1)) ELSE printf('%.2f GB', round(n / 1073741824.0, 2)) END AS size
    FROM (SELECT doc_id, CAST(length(text) * CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000003 END AS BIGINT) AS n FROM documents)""")
def text_sizes(spark, d):
    """STR18 from bytes to gigabytes."""
    factor = F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 1000).otherwise(1000003)
    x = read(spark, d, "documents").withColumn("n", (F.length("text") * factor.cast("long")).cast("long"))
    return x.select("doc_id", "n", text.human_size("n").alias("size"))


# --- scalar functions and streams' batch forms -------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN len(c_name) <= 8 THEN repeat('*', len(c_name)) ELSE left(c_name, 4) || repeat('*', CAST(least(12, len(c_name) - 8) AS INTEGER)) || right(c_name, 4) END AS masked FROM customer")
def masked_names(spark, d):
    """STR7."""
    return read(spark, d, "customer").select("c_custkey", text.mask("c_name").alias("masked"))


@query("""SELECT event_id, CASE WHEN contains(props, '"') OR contains(props, ',') THEN '"' || replace(props, '"', '""') || '"' ELSE props END AS cell FROM events""")
def csv_cells(spark, d):
    """STR6, SNK1."""
    return read(spark, d, "events").select("event_id", text.csv_escape("props").alias("cell"))


@query("SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS snake, lower(replace(p_name, ' ', '-')) AS kebab, upper(p_name) AS upper_name FROM part")
def case_styles(spark, d):
    """STR9."""
    return read(spark, d, "part").select("p_partkey", text.case_style("p_name", "snake").alias("snake"), text.case_style("p_name", "kebab").alias("kebab"), text.case_style("p_name", "upper").alias("upper_name"))


@query("SELECT o_orderkey, CAST(CAST(floor(o_totalprice * 100 + 0.5) / 100 AS DECIMAL(20,2)) AS VARCHAR) AS amount FROM orders")
def cents_as_text(spark, d):
    """MTH2."""
    return read(spark, d, "orders").select("o_orderkey", numbers.cents_text(F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")).alias("amount"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_tax AS DECIMAL(18,4)) AS rate FROM lineitem")
def tax_rates(spark, d):
    """MTH9: rates written as per cents and as fractions."""
    x = read(spark, d, "lineitem")
    r = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.round(F.col("l_tax") * 100).cast("int").cast("string"), F.lit("%"))).otherwise(F.round("l_tax", 2).cast("decimal(4,2)").cast("string"))
    return dec(x.select("l_orderkey", "l_linenumber", numbers.tax_rate(r).alias("rate")))


@query("SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INTEGER) AS age, CAST(coalesce(abs(date_diff('day', CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END, DATE '1996-06-30')), 0) AS INTEGER) AS gap FROM orders")
def day_gaps(spark, d):
    """DT3, DT4: a missing side is no gap."""
    day = F.to_date("o_orderdate")
    x = read(spark, d, "orders")
    return x.select("o_orderkey", F.datediff(F.lit("2000-01-01").cast("date"), day).alias("age"), dates.day_gap(F.when(F.col("o_orderkey") % 7 != 0, day), F.lit("1996-06-30").cast("date")).alias("gap"))


@query("SELECT event_id, CAST(((event_id * 7) % 1440 - event_id % 1440 + 1440) % 1440 AS INTEGER) AS minutes FROM events")
def durations(spark, d):
    """DT13: over midnight where the end is earlier."""
    at = lambda m: F.concat_ws(":", F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lpad((m % 60).cast("string"), 2, "0"))
    x = read(spark, d, "events")
    return x.select("event_id", dates.minutes_between(at(F.col("event_id") % 1440), at(F.col("event_id") * 7 % 1440)).cast("int").alias("minutes"))


@query("SELECT event_id, CAST((event_id * 37) % 86400000 AS BIGINT) AS ms, lpad(CAST((event_id * 37) % 86400000 // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST((event_id * 37) % 3600000 // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST((event_id * 37) % 60000 // 1000 AS VARCHAR), 2, '0') || ',' || lpad(CAST((event_id * 37) % 1000 AS VARCHAR), 3, '0') AS at FROM events")
def subtitle_times(spark, d):
    """DT15: written and read again."""
    x = read(spark, d, "events").select("event_id", dates.subtitle_time((F.col("event_id") * 37 % 86_400_000).cast("long")).alias("at"))
    return x.select("event_id", dates.subtitle_ms("at").alias("ms"), "at")


@query("SELECT DISTINCT event_type FROM events")
def distinct_values(spark, d):
    """SET3."""
    return read(spark, d, "events").select("event_type").distinct()


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nth FROM part")
def natural_order(spark, d):
    """SRT4: each brand's files, file 2 before file 10."""
    x = read(spark, d, "part").select("p_partkey", "p_brand", text.natural_key(F.concat(F.lit("File "), "p_partkey", F.lit(".txt"))).alias("key"))
    return ranks.positions(x, ["p_brand"], ["key"]).select("p_partkey", "nth")


@query("""SELECT doc_id, sha256(CASE WHEN text = '' THEN '' ELSE regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+$', '', 'gm'), '^(\\s*)-\\s+', '\\1- ', 'gm'), chr(10) || '+$', '') || chr(10) END) AS digest FROM documents""")
def markdown_fix(spark, d):
    """TXT8 on all texts, which have no fences, tabs, tables and other list marks (markdown_tables has the last two)."""
    return read(spark, d, "documents").select("doc_id", F.sha2(documents.fix("text"), 256).alias("digest"))


@query("""SELECT c_custkey AS doc_id, '| name' || repeat(' ', len(c_name) - 4) || ' | no' || repeat(' ', w - 2) || ' |' || chr(10) || '| ' || repeat('-', len(c_name)) || ' | ' || repeat('-', w) || ' |' || chr(10) || '| ' || c_name || ' | ' || c_custkey || repeat(' ', w - len(CAST(c_custkey AS VARCHAR))) || ' |' || chr(10)
    || '| x' || repeat(' ', len(c_name) - 1) || ' | ' || repeat(' ', w) || ' |' || chr(10) || chr(10) || '* a' || chr(10) || '* b' || chr(10) || '    c' || chr(10) || '```py' || chr(10) || '- x  ' || chr(10) || '```' || chr(10) AS text
    FROM (SELECT *, CAST(greatest(3, len(CAST(c_custkey AS VARCHAR))) AS INTEGER) AS w FROM customer)""")
def markdown_tables(spark, d):
    """TXT8: tables without separator and cells, mixed list marks, tabs, an open fence."""
    t = F.concat(F.lit("|name|no|\n|"), "c_name", F.lit(" |"), F.col("c_custkey").cast("string"), F.lit("|\n| x|  \n\n*  a\n- b \n\t\tc\n```py\n- x  \n\n"))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), documents.fix(t).alias("text"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DECIMAL(18,2)) AS total FROM events GROUP BY ALL")
def hourly_events(spark, d):
    """An addition: the windowed totals of streaming.live on a table."""
    x = live.windowed_totals(read(spark, d, "events").withColumn("value", F.col("value").cast("decimal(18,6)")))
    return x.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.col("total").cast("decimal(18,2)").alias("total"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    """An addition: the sessions of streaming.live on a table."""
    x = live.sessions(read(spark, d, "events"))
    return x.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


# --- check digits, sources, stations -----------------------------------------------------------------------------


@query(f"""WITH {NUMBERS_SQL}, s AS (SELECT *, list_sum(list_transform(range(1, 18), lambda i: CAST(substr(id, i, 1) AS INTEGER) * [7,9,10,5,8,4,2,1,6,3,7,9,10,5,8,4,2][i])) % 11 AS r,
    list_sum(list_transform(range(1, 18), lambda i: (instr('0123456789ABCDEFGHJKLMNPQRTUWXY', substr(code, i, 1)) - 1) * [1,3,9,27,19,26,16,17,20,29,25,13,8,24,10,30,28][i])) % 31 AS q FROM n)
    SELECT k, r <> 10 AND substr('10X98765432', CAST(r AS INTEGER) + 1, 1) = right(id, 1) AND try_strptime(substr(id, 7, 8), '%Y%m%d') IS NOT NULL AS id_ok,
    substr('0123456789ABCDEFGHJKLMNPQRTUWXY', CAST((31 - q) % 31 AS INTEGER) + 1, 1) = right(code, 1) AS code_ok, CASE WHEN length(old) = 15 THEN regexp_full_match(old, '[0-9]{{15}}') END AS old_ok FROM s""")
def check_digits(spark, d):
    """MTH4, MTH5, MTH7, RUL4."""
    x = inputs.numbers_with_checks(spark, d)
    return x.select("k", checks.id_number("id").alias("id_ok"), checks.credit_code("code").alias("code_ok"), checks.old_tax_number("old").alias("old_ok"))


@query(f"""WITH {NUMBERS_SQL}, s AS (SELECT k, id, list_sum(list_transform(range(1, 18), lambda i: CAST(substr(id, i, 1) AS INTEGER) * [7,9,10,5,8,4,2,1,6,3,7,9,10,5,8,4,2][i])) % 11 AS r FROM n)
    SELECT k AS doc_id, 'id ' || repeat('*', 14) || right(id, 4) || '; x***@y.org' AS text FROM s WHERE r <> 10 AND substr('10X98765432', CAST(r AS INTEGER) + 1, 1) = right(id, 1) AND try_strptime(substr(id, 7, 8), '%Y%m%d') IS NOT NULL""")
def redact_id_numbers(spark, d):
    """RUL4, TXT1, TXT5, SNK9: the texts in which a real personal number was masked."""
    x = inputs.numbers_with_checks(spark, d).select(F.col("k").alias("doc_id"), F.concat(F.lit("id "), "id", F.lit("; xy@y.org")).alias("text"))
    return scan.redacted(x, ("idcard", "email")).where(F.substring("text", 4, 14) == "*" * 14)


@query("""SELECT CAST(c_custkey AS VARCHAR) AS "客户号", c_name AS "名称", CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS "余额",
    CASE WHEN c_custkey % 5 = 0 THEN 'said "' || c_mktsegment || '"' || chr(10) || 'and left' ELSE '客户；' || c_mktsegment END AS "备注" FROM customer""")
def customer_tables(spark, d):
    """SRC1-SRC3, SRC5-SRC7, SRC9, PRJ1: tables in two encodings and two dialects, found by a walk, decoded, sniffed and parsed."""
    rows = delimited.records(spark, inputs.customer_files(spark, d), glob="*.csv")
    return delimited.table(rows).drop("line")


@query("SELECT c_mktsegment AS category, c_name AS word, [CAST(c_custkey AS VARCHAR)] AS variants FROM customer")
def word_file(spark, d):
    """SRC10: a word list read from lines with variants and comments."""
    path, x = inputs.scratch(spark, "words"), read(spark, d, "customer")
    x.select(F.concat_ws("|", "c_mktsegment", "c_name", F.concat(F.lit(" "), "c_custkey", F.lit(" ")))).union(spark.createDataFrame([("# a comment",), ("",)], "value string")).write.text(path)
    return delimited.word_list(spark, path)


@query("SELECT CAST(o_orderdate AS DATE) AS d, 'holiday' AS kind FROM orders WHERE o_orderkey % 2 = 0")
def holiday_file(spark, d):
    """SRC11."""
    path, x = inputs.scratch(spark, "days"), read(spark, d, "orders")
    day = F.to_date("o_orderdate").cast("string")
    x.select(F.concat(day, F.when(F.col("o_orderkey") % 2 == 0, "|Holiday").otherwise("|half"))).write.text(path)
    return delimited.holiday_list(spark, path)


@query("SELECT CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS amount FROM orders")
def amount_file(spark, d):
    """SRC15."""
    path, x = inputs.scratch(spark, "amounts"), read(spark, d, "orders")
    x.select(F.concat_ws(",", "o_orderkey", F.col("o_totalprice").cast("decimal(12,2)"), F.lit("CNY"))).write.text(path)
    return sources.amount_lines(spark, path, 2)


@query("SELECT p_brand AS type, CAST(max(p_partkey) * 100 AS BIGINT) AS cents FROM part GROUP BY 1")
def limit_rows(spark, d):
    """SRC12, JN12: of a type's limits the last counts."""
    x = read(spark, d, "part").select(F.col("p_partkey").alias("line"), F.array("p_brand", F.concat(F.lit("¥"), F.format_number("p_partkey", 2))).alias("cells"))
    return delimited.limit_list(x.union(spark.createDataFrame([(0, ["type", "limit"])], "line bigint, cells array<string>")))


@query("SELECT c_custkey AS doc_id, 'name' AS key, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'market-no', c_mktsegment FROM customer")
def front_matter(spark, d):
    """SRC19."""
    x = read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("---\nname: "), "c_name", F.lit('\nmarket-no: "'), "c_mktsegment", F.lit('"\n---\nbody: none')).alias("text"))
    return sources.front_matter(x)


# --- subtitles, links, packages, columns, logs -------------------------------------------------------------------


def _cues(spark, d):
    x = read(spark, d, "events")
    start = F.col("event_id") % 20 * 4000 + F.col("event_id") % 7 * 10
    body = F.concat("event_type", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(", and\n"), F.col("user_id").cast("string"))).otherwise(""))
    style = F.when(F.col("event_id") % 5 == 0, "Top")
    return x.select(F.floor(F.col("event_id") / 20).alias("doc_id"), F.col("event_id").alias("nth"), start.cast("long").alias("start_ms"), (start + 1230).cast("long").alias("end_ms"), body.alias("text"), style.alias("style"))


_CUES = """c AS (SELECT CAST(floor(event_id / 20) AS BIGINT) AS doc_id, event_id AS nth, CAST(event_id % 20 * 4000 + event_id % 7 * 10 AS BIGINT) AS start_ms, CAST(event_id % 20 * 4000 + event_id % 7 * 10 + 1230 AS BIGINT) AS end_ms,
    event_type || CASE WHEN event_id % 3 = 0 THEN ', and' || chr(10) || user_id ELSE '' END AS text, CASE WHEN event_id % 5 = 0 THEN 'Top' END AS style FROM events)"""


@query(f"WITH {_CUES} SELECT doc_id, start_ms, end_ms, text, coalesce(style, 'Default') AS style FROM c")
def subtitle_ass(spark, d):
    """SRC18, SNK8, STR21, TXT9: written as ASS and read by its Format line."""
    return documents.ass_cues(documents.subtitles(_cues(spark, d), "ass")).drop("nth")


@query(f"WITH {_CUES} SELECT doc_id, start_ms, end_ms, text FROM c")
def subtitle_srt(spark, d):
    """SRC18, SNK8: written as SRT and read again."""
    return documents.cues(documents.subtitles(_cues(spark, d), "srt")).drop("nth")


_AT = "lpad(CAST({x} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({x} % 3600000 // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({x} % 60000 // 1000 AS VARCHAR), 2, '0') || '.' || lpad(CAST({x} % 1000 AS VARCHAR), 3, '0')"


@query(f"WITH {_CUES} SELECT doc_id, sha256('WEBVTT' || chr(10) || chr(10) || string_agg({_AT.format(x='start_ms')} || ' --> ' || {_AT.format(x='end_ms')} || chr(10) || text, chr(10) || chr(10) ORDER BY start_ms, end_ms, nth) || chr(10)) AS digest FROM c GROUP BY doc_id")
def subtitle_vtt(spark, d):
    """SNK8, TXT9."""
    return documents.subtitles(_cues(spark, d), "vtt").select("doc_id", F.sha2("text", 256).alias("digest"))


@query(f"WITH {_CUES} SELECT doc_id, count(*) AS cues, count_if(style IS NOT NULL) AS styles_lost, CAST(0 AS BIGINT) AS times_cut FROM c GROUP BY doc_id")
def subtitle_lost(spark, d):
    """TXT9: what SRT can't keep."""
    return documents.subtitle_losses(_cues(spark, d))


@query("""WITH p AS (SELECT p_partkey AS k, ['p' || p_partkey || '.md', './p' || p_partkey || '.md', 'sub/../p' || p_partkey || '.md', '../docs/a%20b' || p_partkey || '.md', '/docs/p' || p_partkey || '.md', '../../p' || p_partkey || '.md'] AS t FROM part)
    SELECT k AS doc_id, 'docs' AS dir, CAST(1 + (i - 1) // 3 AS INTEGER) AS line, t[i] AS target FROM p, range(1, 7) r(i) WHERE k % 3 <> 0 OR i = 6""")
def links_dead(spark, d):
    """TXT10: links to files that aren't there: relative, decoded, by other ways through folders, absolute; addresses and anchors are none."""
    k, x = F.col("p_partkey").cast("string"), read(spark, d, "part")
    at = lambda *p: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in p])
    t = at("see [a](p", k, ".md#top), [b](./p", k, ".md) [w](https://x.org/y) [c](sub/../p", k, ".md)\n[d](../docs/a%20b", k, ".md) and [e](/docs/p", k, ".md) [f](#d) ![g](../../p", k, ".md)")
    there = x.where("p_partkey % 3 = 0").select(F.explode(F.array(at("docs/p", k, ".md"), at("docs/a b", k, ".md"), at("/docs/p", k, ".md"))).alias("path"))
    return documents.dead_links(x.select(F.col("p_partkey").alias("doc_id"), F.lit("docs").alias("dir"), t.alias("text")), there, folder="dir")


@query("""SELECT c_custkey AS doc_id, 'description' AS field, 'missing' AS problem FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'version', 'version' FROM customer WHERE c_custkey % 2 = 0""")
def package_heads(spark, d):
    """RUL10: fields of packages that are missing or no version number."""
    t = F.concat(F.lit("---\nname: "), "c_name", F.when(F.col("c_custkey") % 3 == 0, "").otherwise("\ndescription: d"), F.when(F.col("c_custkey") % 2 == 0, "\nversion: v1").otherwise("\nversion: 1.0.2"), F.lit("\n---\n"))
    return documents.package_findings(read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), t.alias("text")))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS package, 'deep' AS problem FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'junk' FROM part WHERE p_partkey % 5 = 0 UNION ALL
    SELECT CAST(p_partkey AS VARCHAR), 'stale' FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 = 0""")
def package_trees(spark, d):
    """RUL10: folders too deep, junk, versions that stayed."""
    x = read(spark, d, "part").withColumn("package", F.col("p_partkey").cast("string"))
    path = F.when(F.col("p_partkey") % 4 == 0, "a/b/c.md").otherwise("a/b.md")
    files_ = x.select("package", path.alias("path")).union(x.where("p_partkey % 5 = 0").select("package", F.lit("a/.DS_Store")))
    versions = x.select("package", F.lit("1.0.0").alias("version"), F.when(F.col("p_partkey") % 3 == 0, "1.0.0").otherwise("0.9.0").alias("old_version"), (F.col("p_partkey") % 2 == 0).alias("altered"))
    return documents.package_tree_findings(files_, versions)


@query("SELECT c_custkey AS line, c_mktsegment AS meaning, c_name AS named, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS nth FROM customer")
def columns_resolved(spark, d):
    """PRJ1, PRJ2, STR4: columns by meaning, by name without regard to case and by position."""
    x = read(spark, d, "customer").select(F.col("c_custkey").alias("line"), F.col("c_acctbal").cast("decimal(12,2)").cast("string").alias("b"), F.col("c_name").alias("Name"), F.col("c_mktsegment").alias("Segment (所属)"))
    return x.select("line", F.col(f"`{columns.resolve_meaning(x, ['market', 'segment'])}`").alias("meaning"), F.col(columns.resolve(x, "NAME")).alias("named"), F.col(columns.resolve(x, "2")).alias("nth"))


@query("""SELECT o_orderkey AS line, CASE o_orderkey % 5 WHEN 1 THEN 'a||' WHEN 2 THEN 'a|b|c' ELSE 'a|b|' || o_custkey END AS cells, o_orderkey % 5 IN (1, 2) AS ragged FROM orders WHERE o_orderkey % 5 <> 0""")
def rows_even(spark, d):
    """PRJ4, PRJ5: blank rows go, short rows are filled up and long ones cut."""
    k = F.col("o_orderkey") % 5
    cells = F.when(k == 0, F.array(F.lit(" "), F.lit("　"))).when(k == 1, F.array(F.lit("a"))).when(k == 2, F.array(*map(F.lit, "abcd"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.col("o_custkey").cast("string")))
    x = read(spark, d, "orders").select(F.col("o_orderkey").alias("line"), cells.alias("cells"))
    return clean.even_rows(clean.drop_blank_rows(x)).withColumn("cells", F.array_join("cells", "|"))


@query(f"WITH {LEDGERS_SQL} SELECT line, -cents AS cents FROM b")
def ledger_flipped(spark, d):
    """PRJ6."""
    return clean.flip(inputs.ledgers(spark, d)[1]).select("line", "cents")


@query("""SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS digits, format('{:,.2f}', CAST(p_partkey * 12.5 AS DOUBLE)) AS amount, CASE p_partkey % 3 WHEN 0 THEN 'box' WHEN 1 THEN 'city' ELSE 'name' END AS one,
    CASE p_partkey % 2 WHEN 0 THEN 'k' || p_partkey ELSE '"k-' || p_partkey || '"' END AS ident, CAST(p_partkey % 4 + 1 AS BIGINT) AS line, repeat(' ', CAST(least(p_partkey % 4, 2) AS INTEGER)) || 'HIT' || p_partkey AS around FROM part""")
def text_helpers(spark, d):
    """STR2, STR5, STR14, STR15, STR19, STR20."""
    k = F.col("p_partkey")
    t = F.concat(F.repeat(F.lit("\n"), (k % 4).cast("int")), F.lit("HIT"), k.cast("string"))
    wide = F.translate(F.lpad(k.cast("string"), 7, "0"), "0123456789", "０１２３４５６７８９")
    plural = F.when(k % 3 == 0, "boxes").when(k % 3 == 1, "cities").otherwise("names")
    ident = F.concat(F.when(k % 2 == 0, "k").otherwise("k-"), k.cast("string"))
    return read(spark, d, "part").select(
        "p_partkey", text.half_width_digits(wide).alias("digits"), text.thousands(k * 12.5).alias("amount"), text.singular(plural).alias("one"), text.identifier(ident).alias("ident"),
        text.line_of(t, (k % 4).cast("int")).cast("long").alias("line"), text.context(t, (k % 4).cast("int"), F.length(k.cast("string")) + 3, around=2).alias("around"),
    )


@query("SELECT event_id, strftime(ts, '%Y/%m/%d at %H.%M.%S') AS at FROM events")
def time_texts(spark, d):
    """DT12."""
    return read(spark, d, "events").select("event_id", dates.time_text("ts", "YYYY/MM/DD at HH.mm.ss").alias("at"))


@query("""SELECT lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS commit, c_name AS author, '2024-01-02' AS date, f AS file, CAST(n AS INTEGER) AS line, CASE n WHEN 12 THEN c_mktsegment WHEN 14 THEN '++ b/x' ELSE 'new' END AS text
    FROM customer, (VALUES ('a.txt', 12), ('a.txt', 14), ('d/b.txt', 1)) v(f, n)""")
def log_lines(spark, d):
    """SRC17, TXT7: the lines that commits add, with their places."""
    c = F.col
    t = F.concat(F.lit("commit "), F.lpad(c("c_custkey").cast("string"), 7, "0"), F.lit("\nAuthor: "), c("c_name"), F.lit("\nDate: 2024-01-02\n\n    text\n\ndiff --git a/a.txt b/a.txt\n--- a/a.txt\n+++ b/a.txt\n@@ -11,3 +11,4 @@ f\n kept\n+"), c("c_mktsegment"),
        F.lit("\n-gone\n kept\n+++ b/x\ndiff --git a/d/b.txt b/d/b.txt\n--- /dev/null\n+++ b/d/b.txt\n@@ -0,0 +1 @@\n+new\n"))
    return sources.added_lines(read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), t.alias("text")))


@query("""SELECT to_json({'n_nationkey': n_nationkey, 'n_name': n_name}) AS value FROM nation""")
def json_report(spark, d):
    """SNK3."""
    return sinks.report(read(spark, d, "nation").select("n_nationkey", "n_name"))


# --- timetables --------------------------------------------------------------------------------------------------

_ASKED = f"{STOPS_SQL}, {ASKED_SQL}, {TRIPS_SQL}"


def _asked(spark, d):
    return inputs.trips_asked(spark, d).withColumn("kinds", timetable.train_types("types"))


@query(f"""WITH {_ASKED} SELECT request, no, type, depart, arrive, minutes FROM trips WHERE list_contains(kinds, type) AND (after IS NULL OR depart > after)
    AND (via IS NULL OR EXISTS (FROM stops v WHERE v.no = trips.no AND v.eff_from = trips.eff_from AND v.station = trips.via AND v.seq BETWEEN sa AND sb))""")
def timetable_search(spark, d):
    """TT1, JN14, JN15, PRJ9, PRJ12, DT13: a table of requests."""
    return timetable.journeys(inputs.stops(spark, d), _asked(spark, d))


@query(f"""WITH {_ASKED}, {HOLIDAYS_SQL}, {SUSPENDED_SQL} SELECT request, trips.no, type, depart, arrive, minutes FROM trips JOIN kinds k ON k.d = trips.date
    WHERE NOT (workday_only AND k.kind <> 'workday') AND NOT EXISTS (FROM suspended s WHERE s.d = trips.date AND s.no IN (trips.no, '*'))""")
def timetable_in_force(spark, d):
    """PRJ9-PRJ11: runs of workdays, and suspended ones."""
    asked = inputs.trips_asked(spark, d).select("request", "origin", "to", "date")
    return timetable.journeys(inputs.stops(spark, d), asked, holidays=inputs.holidays(spark), suspended=inputs.suspensions(spark, d))


@query(f"""WITH {STOPS_SQL}, {ASKED_SQL}, near AS (SELECT request, CASE WHEN direction = 1 THEN CASE WHEN origin = 'st190' THEN 'st10' ELSE 'st190' END WHEN origin = 'st10' THEN 'st190' ELSE 'st10' END AS "to", origin, date, kinds, after, via FROM asked),
    {TRIPS_SQL.replace("FROM asked q", "FROM near q")} SELECT request, no, type, depart, arrive, minutes, "to" AS terminal, CAST(row_number() OVER (PARTITION BY request ORDER BY depart, no, arrive) AS INTEGER) AS nth
    FROM trips WHERE after IS NULL OR depart > after QUALIFY nth <= 2""")
def timetable_terminal(spark, d):
    """TT2, WIN9: the next two runs of each request to the end of the line that it asks for, from there to the other one."""
    asked = inputs.trips_asked(spark, d).select("request", F.col("origin").alias("station"), "direction", "date", "after")
    return timetable.next_runs(inputs.stops(spark, d), asked, ("st10", "st190"), n=2)


@query(f"""WITH {STOPS_SQL}, e AS (SELECT *, max(seq) OVER (PARTITION BY no, eff_from) AS z FROM stops WHERE eff_from <= DATE '1998-03-02' AND coalesce(eff_until, DATE '1998-03-02') >= DATE '1998-03-02')
    SELECT station, CAST(row_number() OVER (PARTITION BY station ORDER BY depart, no) AS INTEGER) AS nth, no, depart FROM e WHERE seq < z AND depart > '09:00' QUALIFY nth <= 3""")
def timetable_next(spark, d):
    """TT2, WIN9, WIN4: the next departures of every station on a day."""
    return timetable.next_departures(inputs.stops(spark, d), date="1998-03-02", after="09:00")


@query(f"WITH {STOPS_SQL} SELECT station, count(DISTINCT no) AS trains, min(depart) AS first, max(depart) AS last FROM stops GROUP BY 1")
def timetable_stations(spark, d):
    """TT4."""
    return timetable.station_info(inputs.stops(spark, d))


@query(f"""WITH {STOPS_SQL}, {ASKED_SQL}, versions AS (SELECT DISTINCT no, eff_from, eff_until FROM stops),
    c AS (SELECT request, no, v.eff_from, v.eff_from <= date AND coalesce(v.eff_until, date) >= date AS effective FROM asked JOIN versions v USING (no) QUALIFY row_number() OVER (PARTITION BY request ORDER BY effective DESC, v.eff_from DESC) = 1)
    SELECT request, seq, station, CASE WHEN seq > min(seq) OVER w THEN arrive END AS arrive, CASE WHEN seq < max(seq) OVER w THEN depart END AS depart, effective FROM c JOIN stops USING (no, eff_from) WINDOW w AS (PARTITION BY request)""")
def timetable_stops(spark, d):
    """TT3, WIN4: the version in force on the date asked for, or else the latest."""
    return timetable.stops_for(inputs.stops(spark, d), inputs.trips_asked(spark, d).select("request", "no", "date"))


@query(f"""WITH {_ASKED}, p AS (SELECT 'st' || (p_partkey % 200) AS a, 'st' || ((p_partkey + 11 * (p_partkey % 4)) % 200) AS b, CAST(p_retailprice AS DECIMAL(12,2)) AS price FROM part),
    f AS (SELECT least(a, b) AS low, greatest(a, b) AS high, min(price) AS price FROM p GROUP BY ALL), t AS (SELECT trips.*, origin FROM trips JOIN asked USING (request))
    SELECT request, no, type, depart, arrive, minutes, price FROM t LEFT JOIN f ON low = least(origin, "to") AND high = greatest(origin, "to")""")
def timetable_price(spark, d):
    """TT5, JN16: fares of the pairs of stations."""
    asked, k = inputs.trips_asked(spark, d).select("request", "origin", "to", "date"), F.col("p_partkey")
    prices = read(spark, d, "part").select(F.concat(F.lit("st"), k % 200).alias("a"), F.concat(F.lit("st"), (k + 11 * (k % 4)) % 200).alias("b"), F.col("p_retailprice").cast("decimal(12,2)").alias("price"))
    return timetable.journeys_priced(inputs.stops(spark, d), asked, prices)


@query(f"""WITH {STOPS_SQL} SELECT no, eff_from, station, CAST(row_number() OVER (PARTITION BY no, eff_from ORDER BY depart, station) AS INTEGER) AS seq, arrive, depart FROM stops""")
def timetable_maps(spark, d):
    """MAP1: stops from a run's map of stations; a station that isn't there is passed through."""
    s = inputs.stops(spark, d)
    trains = s.groupBy("no", "eff_from").agg(F.map_from_entries(F.collect_list(F.struct("station", F.struct("arrive", "depart")))).alias("t"))  # seven stops at most
    line = s.select("station").distinct().withColumn("position", F.col("station"))
    return timetable.stops_of_trains(trains, line).select("no", "eff_from", "station", "seq", "arrive", "depart")


# --- JSON texts --------------------------------------------------------------------------------------------------


@query(f"""WITH {inputs.JSON_TEXTS_SQL}, x AS (SELECT k FROM j WHERE k % 7 <> 0), r AS (SELECT count(*) AS n, count_if(k % 2 = 0) AS s, count_if(k % 5 > 0) AS o, count_if(k % 5 > 0 AND k % 3 = 0) AS z FROM x)
    SELECT path, kind, t.n AS n FROM r, LATERAL (VALUES ('', 'object', n), ('.id', 'number', n), ('.tag', 'string', s), ('.tag', 'number', n - s), ('.items', 'array', n), ('.items []', 'object', 2 * n), ('.items [] .n', 'number', 2 * n),
      ('.items [] .x', 'boolean', n), ('.sub', 'object', o), ('.sub .k', 'null', z), ('.sub .k', 'array', o - z)) t(path, kind, n) WHERE t.n > 0""")
def json_kinds(spark, d):
    """AGG25, JSN4: kinds of values at each place."""
    return documents.json_types(inputs.json_texts(spark, d), "text").withColumn("path", F.array_join("path", " "))


@query("""SELECT unnest([E'export interface Item {\n  n: number;\n  x?: boolean;\n}\n\nexport interface Sub {\n  k: null | unknown[];\n}\n\nexport interface Order {\n  id: number;\n  items: Item[];\n  sub?: Sub;\n  tag: number | string;\n}\n']) AS text FROM (SELECT count(*) FROM orders)""")
def json_interfaces(spark, d):
    """JSN4, SNK10: the interfaces of all texts."""
    text = documents.interfaces(inputs.json_texts(spark, d), "text", "Order")
    return read(spark, d, "orders").agg(F.lit(text).alias("text"))


@query(f"""WITH {inputs.JSON_TEXTS_SQL} SELECT doc_id, CAST(1 AS INTEGER) AS line, CAST(len(text) + 1 AS INTEGER) AS "column", left(text, 120) AS snippet FROM j WHERE k % 7 = 0""")
def json_faults(spark, d):
    """JSN1: where the texts that aren't JSON go wrong."""
    return documents.json_errors(inputs.json_texts(spark, d), "text").drop("message")


@query(f"""WITH {inputs.JSON_TEXTS_SQL} SELECT doc_id, '{{"id":' || k || ',"items":[{{"n":1}},{{"n":2,"x":true}}],' || CASE WHEN k % 5 > 0 THEN '"sub":{{"k":' || CASE WHEN k % 3 = 0 THEN 'null' ELSE '[]' END || '}},' ELSE '' END || '"tag":' || CASE WHEN k % 2 = 0 THEN '"' || o_orderstatus || '"' ELSE CAST(k AS VARCHAR) END || '}}' AS text
    FROM j JOIN orders ON o_orderkey = k WHERE k % 7 <> 0""")
def json_sorted_texts(spark, d):
    """JSN3, SNK11: minified, the keys of every object in order."""
    return documents.json_pretty(inputs.json_texts(spark, d), "text", indent=None, sort_keys=True).where("text is not null")


# --- histories and mixed files -----------------------------------------------------------------------------------


@query("""WITH c AS (SELECT c_custkey AS k, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS commit, c_name AS author, strftime(DATE '2024-01-01' + CAST(c_custkey * 13 % 300 AS INTEGER), '%Y-%m-%d') AS date FROM customer),
    f AS (SELECT 'aws_ak' AS rule, 'high' AS level, 'AKIA' || lpad(CAST(k % 37 AS VARCHAR), 16, '0') AS x, commit, date, author, 2 AS line FROM c UNION ALL SELECT 'generic_secret', 'medium', 'password = "Tr0ub4dor' || k % 5 || 'x', commit, date, author, 3 FROM c WHERE k % 3 = 0)
    SELECT rule, level, left(x, 4) || repeat('*', CAST(least(12, len(x) - 8) AS INTEGER)) || right(x, 4) AS masked, arg_min(commit, date || commit) AS commit, min(date) AS date, arg_min(author, date || commit) AS author, 'src/c.js' AS file, CAST(any_value(line) AS INTEGER) AS line, count(*) AS commits
    FROM f GROUP BY rule, level, x""")
def history_secrets(spark, d):
    """TXT7, SRC17, STR7: secrets of a history, each with the commit that brought it in first."""
    k = F.col("c_custkey")
    lines = F.concat(F.lit("+x\n+key = AKIA"), F.lpad((k % 37).cast("string"), 16, "0"), F.when(k % 3 == 0, F.concat(F.lit('\n+password = "Tr0ub4dor'), k % 5, F.lit('x"'))).otherwise(""))
    head = F.concat(F.lit("commit "), F.lpad(k.cast("string"), 8, "0"), F.lit("\nAuthor: "), "c_name", F.lit("\nDate:   "), F.expr("date_add(date'2024-01-01', cast(c_custkey * 13 % 300 as int))").cast("string"))
    log = F.concat(head, F.lit("\n\n    work\n\ndiff --git a/src/c.js b/src/c.js\n--- a/src/c.js\n+++ b/src/c.js\n@@ -0,0 +1,3 @@\n"), lines, F.lit("\n"))
    folder = inputs.scratch(spark, "log")
    read(spark, d, "customer").select(log.alias("text")).write.text(folder)
    return scan.history_findings(sources.added_lines(sources.commits(spark, folder)))


@query(f"""WITH {_CUES} SELECT doc_id, ['srt', 'vtt', 'ass'][doc_id % 3 + 1] AS format, start_ms, end_ms, text, CASE WHEN doc_id % 3 = 2 THEN coalesce(style, 'Default') END AS style FROM c""")
def subtitles_mixed(spark, d):
    """SRC18: files of three formats in one table, half of them with an ending."""
    x = _cues(spark, d)
    forms = [documents.subtitles(x.where(F.col("doc_id") % 3 == k), form).withColumn("path", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("film."), F.lit(form.upper()))).otherwise("film")) for k, form in enumerate(("srt", "vtt", "ass"))]
    return documents.any_cues(forms[0].union(forms[1]).union(forms[2])).drop("nth")


# --- files and texts, continued ----------------------------------------------------------------------------------

_COPIES = "h AS (SELECT lpad(CAST(doc_id AS VARCHAR), 10, '0') AS path, octet_length(encode(text)) AS bytes, sha256(text) AS hash FROM documents)"


@query(f"WITH {_COPIES} SELECT hash, count(*) AS n, CAST(max(bytes) * (count(*) - 1) AS BIGINT) AS reclaimable FROM h GROUP BY hash HAVING count(*) > 1")
def dup_reclaimable(spark, d):
    """SRT5: what deleting copies would free."""
    return files.reclaimable(files.duplicates(_files(spark, d)))


@query(f"WITH {_COPIES} SELECT path AS value FROM h QUALIFY row_number() OVER (PARTITION BY hash ORDER BY path) > 1")
def dup_deletions(spark, d):
    """SNK6: the list of copies beyond the kept one, as it is written."""
    folder = inputs.scratch(spark, "deletions")
    sinks.write_deletions(files.duplicates(_files(spark, d)), folder)
    return spark.read.text(folder)


@query(f"WITH {_COPIES} SELECT path, CAST(bytes AS BIGINT) AS bytes, hash FROM h")
def manifest_read(spark, d):
    """SRC16, MTH10: manifests of one document a folder, as other tools write them."""
    folder, entries = inputs.scratch(spark, "manifests"), files.manifest(_files(spark, d)).withColumn("part", F.col("path").cast("long") % 7)
    whole = entries.groupBy("part").agg(F.to_json(F.struct(F.collect_list(F.struct("path", "bytes", "hash", "mtime")).alias("files"))).alias("value"))
    whole.write.partitionBy("part").text(folder)
    return delimited.manifest_entries(spark, folder).select("path", "bytes", "hash")


@query(r"""SELECT 'p' || p_partkey || '.txt' AS name, replace(p_name, ' ', '_') || '.txt' AS plain, regexp_replace(p_name, '^(\S+) (\S+)$', '\2 \1') || '.txt' AS swapped FROM part""")
def rename_replaced(spark, d):
    """STR10: a literal and a pattern with groups in names."""
    x = read(spark, d, "part").select(F.concat(F.lit("d/p"), "p_partkey", F.lit("/"), "p_name", F.lit(".txt")).alias("path"), F.lit(0).alias("bytes"), F.current_timestamp().alias("mtime"))
    name = F.concat(F.regexp_extract("dir", r"(p\d+)/$", 1), F.lit(".txt")).alias("name")
    plain = files.rename_plan(x, find=" ", replace="_").select(name, F.col("new_name").alias("plain"))
    return plain.join(files.rename_plan(x, find=r"^(\S+) (\S+)$", replace="$2 $1", regex=True).select(name, F.col("new_name").alias("swapped")), "name")


@query(r"""SELECT p_partkey, [CAST(p_partkey AS VARCHAR), p_brand, CASE WHEN p_partkey % 3 = 0 THEN 'a\|b' ELSE '' END] AS cells FROM part""")
def table_cells(spark, d):
    """STR22: rows of Markdown tables with and without outer pipes, with escaped ones."""
    k = F.col("p_partkey")
    row = F.concat(F.when(k % 2 == 0, "| ").otherwise(""), k, F.lit(" | "), "p_brand", F.lit(" | "), F.when(k % 3 == 0, "a\\|b").otherwise(""), F.lit(" |"))
    return read(spark, d, "part").select("p_partkey", text.table_cells(row).alias("cells"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(ts AS DATE) WHEN 1 THEN CAST(ts AS DATE) + 1 WHEN 2 THEN CAST(ts AS DATE) + 2 WHEN 3 THEN DATE '2024-03-09' WHEN 4 THEN DATE '2023-12-31' ELSE CAST(ts AS DATE) END AS d FROM events""")
def days_named(spark, d):
    """DT14: days by their names, by month and day, in full, and words that name none."""
    word = F.element_at(F.array(*map(F.lit, ("今天", "tomorrow", "后天", "03-09", "2023-12-31", "02-30"))), (F.col("event_id") % 6 + 1).cast("int"))
    return read(spark, d, "events").select("event_id", calendars.named_days(word, F.to_date("ts")).alias("d"))


@query("""WITH e AS (SELECT DISTINCT extract('minute' FROM ts) AS m, extract('hour' FROM ts) AS h FROM events) SELECT m || ' ' || h || ' * * *' AS cron, '每天 ' || printf('%02d:%02d', h, m) AS said FROM e""")
def cron_said(spark, d):
    """DT11: what expressions say."""
    x = read(spark, d, "events").select(F.concat(F.minute("ts"), F.lit(" "), F.hour("ts"), F.lit(" * * *")).alias("cron"))
    return calendars.cron_texts(x, "cron")


@query("""SELECT o_orderkey AS k FROM orders WHERE o_orderpriority = (SELECT max(o_orderpriority) FROM orders)""")
def snapshot_newest(spark, d):
    """SET5, SRC14: the rows of the newest of several snapshots."""
    x = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("version"))
    return timetable.latest_or_fallback(x, x.select("k").limit(0))


# --- tables for people, packages, walks and samples --------------------------------------------------------------


@query("""WITH w AS (SELECT greatest(max(len(c_name)), 6) AS a, greatest(max(len(b)), 7) AS b, greatest(max(len(k)), 9) AS k FROM (SELECT c_name, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS b, CAST(c_custkey AS VARCHAR) AS k FROM customer))
    SELECT CAST(row_number() OVER (ORDER BY c_custkey) + 1 AS BIGINT) AS line, repeat(' ', CAST(w.k - len(CAST(c_custkey AS VARCHAR)) AS INTEGER)) || c_custkey || '  ' || c_name || repeat(' ', CAST(w.a - len(c_name) AS INTEGER)) || '  ' || repeat(' ', CAST(w.b - len(CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR)) AS INTEGER)) || CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS text FROM customer, w
    UNION ALL SELECT 0, 'c_custkey' || repeat(' ', CAST(k - 9 AS INTEGER)) || '  ' || '名称字' || repeat(' ', CAST(a - 6 AS INTEGER)) || '  ' || 'balance' || repeat(' ', CAST(b - 7 AS INTEGER)) FROM w UNION ALL SELECT 1, repeat('-', CAST(k AS INTEGER)) || '  ' || repeat('-', CAST(a AS INTEGER)) || '  ' || repeat('-', CAST(b AS INTEGER)) FROM w""")
def terminal_table(spark, d):
    """SNK2: a table for a terminal, with a wide head and numbers to the right."""
    x = read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("名称字"), F.col("c_acctbal").cast("decimal(12,2)").alias("balance"))
    return documents.console_table(x, ["c_custkey"], ["c_custkey", "balance"])


@query("""WITH p AS (SELECT 'p' || p_partkey AS package, p_partkey AS k FROM part), f AS (SELECT package, k, unnest(['name', 'description', 'description_zh', 'description_en', 'version', 'author', 'category', 'scenarios', 'roles']) AS field, unnest(range(9)) AS i FROM p WHERE k % 11 > 0)
    SELECT package, CASE WHEN i < 6 THEN 'E' ELSE 'W' END AS level, field, 'missing' AS problem FROM f WHERE k % 9 = i UNION ALL SELECT package, 'E', 'version', 'version' FROM f WHERE field = 'version' AND k % 9 <> 4 AND k % 4 = 0
    UNION ALL SELECT package, 'W', 'name', 'folder' FROM f WHERE field = 'name' AND k % 9 <> 0 AND k % 5 = 0 UNION ALL SELECT package, 'E', 'file', 'missing' FROM p WHERE k % 11 = 0""")
def package_report(spark, d):
    """RUL10: required and recommended fields, version numbers, names against folders."""
    k, fields = F.col("p_partkey"), documents.PACKAGE_FIELDS + documents.RECOMMENDED_FIELDS
    value = {"name": F.when(k % 5 == 0, "another").otherwise(F.concat(F.lit("'p"), k, F.lit("'"))), "version": F.when(k % 4 == 0, "1.0").otherwise('"1.0.2"')}
    rows = [F.when(k % 9 == i, F.lit(f"# {f}: no")).otherwise(F.concat(F.lit(f"{f}: "), value.get(f, F.lit("x")))) for i, f in enumerate(fields)]
    text = F.when(k % 11 > 0, F.concat(F.lit("---\n"), F.concat_ws("\n", *rows), F.lit("\n---\nname: body\n")))
    parts = read(spark, d, "part").select("p_partkey").repartition("p_partkey")  # a small file, of which much text is made
    return documents.package_report(parts.select(F.concat(F.lit("p"), k).alias("package"), text.alias("text")))


@query("SELECT p_partkey, [',', ';', chr(9), '|'][p_partkey % 4 + 1] AS delimiter FROM part")
def delimiters_sniffed(spark, d):
    """SRC4: samples whose first line has more of another delimiter than of the one that their records agree on."""
    k = F.col("p_partkey")
    at = lambda n: F.element_at(F.array(*map(F.lit, ",;\t|")), (F.pmod(k + n, F.lit(4)) + 1).cast("int"))
    sep, other = at(0), at(1)
    head = F.concat(F.lit("no"), sep, F.lit("name"), sep, F.lit('"brand'), other, other, other, F.lit('"'))
    row = lambda n: F.concat(F.lit("\n"), k + n, sep, "p_brand", sep, F.lit("x"))
    return read(spark, d, "part").select("p_partkey", delimited.delimiters(F.concat(head, row(1), row(2), row(3))).alias("delimiter"))


@query("SELECT c_name AS row FROM customer WHERE c_custkey % 6 IN (0, 1)")
def code_walk(spark, d):
    """SRC8: lines of files worth a scan: not those in skipped folders, of skipped kinds, with zero bytes or too large."""
    folder, k = inputs.scratch(spark, "code"), F.col("c_custkey") % 6
    x = read(spark, d, "customer")
    for n, place in enumerate(("src", "lib/a", "node_modules/m", "lib/dist/b", "src/zero", "src/packed")):
        name = F.concat(F.lit("a\0"), "c_name") if place == "src/zero" else F.col("c_name")
        # Files of code grow in number, not in size: one over the scan's limit is none of its lines.
        x.where(k == n).select(name.alias("value")).write.option("maxRecordsPerFile", 20_000).option("compression", "gzip" if place == "src/packed" else "none").text(f"{folder}/{place}")
    found = sources.code_files(spark, folder).select(sources.decoded("content").alias("t"))
    return found.select(F.explode(F.split(F.rtrim("t", F.lit("\n")), "\n")).alias("row")).where("row <> ''")


@query("""SELECT 'n=' || c_nationkey AS folder, CAST(sum(len(c_name) + 1) AS BIGINT) AS bytes FROM customer WHERE c_nationkey <> 3 GROUP BY c_nationkey HAVING sum(len(c_name) + 1) >= (SELECT sum(len(c_name) + 1) / 25 FROM customer)""")
def files_large(spark, d):
    """PRJ15, SRC7: files of a least size, without those of one name."""
    folder, x = inputs.scratch(spark, "sizes"), read(spark, d, "customer").select("c_name", F.col("c_nationkey").alias("n"))
    x.repartition("n").write.partitionBy("n").text(folder)
    least = x.agg(F.ceil(F.sum(F.length("c_name") + 1) / 25)).first()[0]
    return sources.files(spark, folder, min_bytes=least, exclude=("n=3",)).select(F.split("path", "/")[0].alias("folder"), "bytes")


@query("""SELECT o_orderkey AS line, 'E' AS level, 'E401' AS code FROM orders, (VALUES (83), (7)) v(m) WHERE o_orderkey % m = 0""")
def fields_required(spark, d):
    """PRJ7, RUL2: required fields that are blank; one that the table doesn't have is not asked for."""
    x = inputs.claims(spark, d).withColumn("approver", F.when(F.col("line") % 7 == 0, " \t").otherwise("A"))
    return audit.expense_findings(x, as_of="2000-01-01", required=("person", "approver", "cost_centre")).where("code = 'E401'")


@query("""SELECT p_partkey, row_number() OVER (ORDER BY p_partkey % 7, p_partkey) AS nth FROM part""")
def chinese_names(spark, d):
    """SRT2: names in the order of their pronunciation (an, bei, chen, ding, guo, huang, zhang)."""
    name = F.element_at(F.array(*map(F.lit, "安北陈丁郭黄张")), (F.col("p_partkey") % 7 + 1).cast("int"))
    x = read(spark, d, "part").select("p_partkey", text.chinese_order(name).alias("name"))
    return ranks.positions(x, [], ["name", "p_partkey"]).select("p_partkey", "nth")
