"""Untidy inputs made from the shared tables, by expressions that SQL can repeat (their SQL stands beside them)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexicons


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, st, a: order totals as people write them."""
    o = read(spark, sf_dir, "orders")
    m, plain = F.pmod("o_orderkey", F.lit(5)), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    wide = F.translate(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), "0123456789.", "０１２３４５６７８９．")
    a = F.when(m == 0, F.concat(F.lit("¥"), plain)).when(m == 1, F.concat(F.lit("("), plain, F.lit(")"))).when(m == 2, wide).when(m == 3, F.lit("")).otherwise(F.lit("n/a"))
    return o.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("st"), a.alias("a"))


#: The readable value of each text above.
MONEY_SQL = """SELECT o_orderkey AS k, o_orderstatus AS st, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) WHEN 1 THEN -CAST(o_totalprice AS DECIMAL(18,2))
    WHEN 2 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS v FROM orders"""


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, d: order dates in three notations, with impossible days between."""
    o = read(spark, sf_dir, "orders")
    m = F.pmod("o_orderkey", F.lit(4))
    d = F.when(m == 0, F.date_format("o_orderdate", "yyyy/M/d")).when(m == 1, F.date_format("o_orderdate", "yyyy年MM月dd日")).when(m == 2, F.date_format("o_orderdate", " yyyy-MM-dd　")).otherwise(F.lit("2026-02-30"))
    return o.select(F.col("o_orderkey").alias("k"), d.alias("d"))


def order_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """k, st, p as text: the orders without every 11th key, and without every 19th with some states and prices altered."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("st"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    a = o.where("k % 11 <> 0").select("k", "st", F.col("p").cast("string").alias("p"))
    b = o.where("k % 19 <> 0").select("k", F.when(F.col("k") % 13 == 0, "X").otherwise(F.col("st")).alias("st"), F.when(F.col("k") % 17 == 0, F.col("p") + 1).otherwise(F.col("p")).cast("decimal(18,2)").alias("p"))
    return a, b.select("k", "st", F.format_number("p", 2).alias("p"))


VERSIONS_SQL = """o AS (SELECT o_orderkey AS k, o_orderstatus AS st, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders),
    a AS (SELECT * FROM o WHERE k % 11 <> 0),
    b AS (SELECT k, CASE WHEN k % 13 = 0 THEN 'X' ELSE st END AS st, CASE WHEN k % 17 = 0 THEN p + 1 ELSE p END AS p FROM o WHERE k % 19 <> 0)"""


def ledgers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """line, cents, d: odd and even orders, amounts on a coarse grid, days shifted."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line"), (F.floor(F.col("o_totalprice") / 50) * 5000).cast("long").alias("cents"), F.to_date("o_orderdate").alias("d"))
    return o.where("line % 2 = 0"), o.where("line % 2 = 1").withColumn("d", F.expr("date_add(d, cast(line % 4 as int))"))


LEDGERS_SQL = """o AS (SELECT o_orderkey AS line, CAST(floor(o_totalprice / 50) * 5000 AS BIGINT) AS cents, CAST(o_orderdate AS DATE) AS d FROM orders),
    a AS (SELECT * FROM o WHERE line % 2 = 0), b AS (SELECT line, cents, d + CAST(line % 4 AS INTEGER) AS d FROM o WHERE line % 2 = 1)"""


def split_ledgers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """line, cents, d: an entry for each order, and a few, one for each nation, that some orders are sums of; a third of those
    without a date."""
    o, n = read(spark, sf_dir, "orders"), read(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    a = o.select(F.col("o_orderkey").alias("line"), (F.when(F.col("o_orderkey") % 4 == 0, -1).otherwise(1) * (F.col("o_orderkey") * 7919 % 300) * 100).cast("long").alias("cents"), F.to_date("o_orderdate").alias("d"))
    b = n.select(key.cast("long").alias("line"), (F.when(key % 5 == 0, -1).otherwise(1) * (1 + key * 37 % 101) * 100).cast("long").alias("cents"), F.when(key % 3 > 0, F.expr("date_add(date'1993-01-01', cast(n_nationkey * 61 as int))")).alias("d"))
    return a, b


#: Sets of two and three entries of b by their sum, in the order of the search (ord), and what the search does not go into.
SPLIT_SQL = """a AS (SELECT o_orderkey AS line, CAST((CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 1 END) * (o_orderkey * 7919 % 300) * 100 AS BIGINT) AS cents, CAST(o_orderdate AS DATE) AS d FROM orders),
    b AS (SELECT CAST(n_nationkey AS BIGINT) AS line, CAST((CASE WHEN n_nationkey % 5 = 0 THEN -1 ELSE 1 END) * (1 + n_nationkey * 37 % 101) * 100 AS BIGINT) AS cents, CASE WHEN n_nationkey % 3 > 0 THEN DATE '1993-01-01' + CAST(n_nationkey * 61 AS INTEGER) END AS d FROM nation),
    two AS (SELECT x.cents + y.cents AS t, [x.line, y.line] AS lines, [x.cents, y.cents] AS c, [x.d, y.d] AS ds FROM b x JOIN b y ON x.line < y.line),
    three AS (SELECT t + z.cents AS t, list_append(lines, z.line) AS lines, list_append(c, z.cents) AS c, list_append(ds, z.d) AS ds FROM two JOIN b z ON lines[2] < z.line),
    s AS (SELECT t, lines, ds, row_number() OVER (ORDER BY lines) AS ord FROM (SELECT * FROM two UNION ALL SELECT * FROM three WHERE c[1] + c[2] <> t)
      WHERE NOT (t <> 0 AND sign(c[1]) <> sign(t)) AND NOT (abs(c[1]) > abs(t) AND sign(c[1]) = sign(t))
      AND NOT (t <> c[1] AND sign(c[2]) <> sign(t)) AND NOT (abs(c[2]) > abs(t - c[1]) AND sign(c[2]) = sign(t - c[1]))
      AND (len(c) = 2 OR (sign(c[3]) = sign(t) AND NOT (abs(c[3]) > abs(t - c[1] - c[2]) AND sign(c[3]) = sign(t - c[1] - c[2])))))"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    cents = F.when(F.col("o_orderkey") % 97 == 0, 0).when(F.col("o_orderkey") % 89 == 0, -F.floor(F.col("o_totalprice") * 100 + 0.5)).otherwise(F.floor(F.col("o_totalprice") * 100 + 0.5)).cast("long")
    return o.select(
        F.col("o_orderkey").alias("line"), F.to_date("o_orderdate").alias("d"), F.to_date("o_orderdate").cast("string").alias("date_text"), F.when(F.col("o_orderkey") % 83 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("person"),
        F.col("o_orderpriority").alias("type"), cents.alias("cents"), cents.cast("string").alias("amount_text"), F.lpad((F.col("o_orderkey") % 9973).cast("string"), 8, "0").alias("invoice_no"), F.lit("").alias("approver"),
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "lineitem")
    line, amount = F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.floor(F.col("l_extendedprice") * 100 + 0.5) / 100
    tax = F.floor(F.col("l_extendedprice") * F.col("l_tax") * 100 + 0.5) / 100
    return x.select(
        line.alias("line"), F.lpad((F.col("l_suppkey") % 1000).cast("string"), 10, "1").alias("code"), F.lpad(line.cast("string"), 8, "0").alias("no"), amount.alias("amount"), tax.alias("tax"),
        F.when(F.col("l_orderkey") % 7 == 0, amount + tax + 1).otherwise(amount + tax).alias("total"), F.col("l_tax").alias("rate"), F.to_date("l_shipdate").alias("d"), F.to_date("l_shipdate").cast("string").alias("date_text"), F.lit("").alias("tax_no"),
    )


def holidays(spark: SparkSession) -> DataFrame:
    """Some days off and made-up working days of the years that the orders lie in."""
    return spark.sql("SELECT make_date(y, m, 1) AS d, 'holiday' AS kind FROM (SELECT explode(sequence(1990, 2030)) AS y), (SELECT explode(array(1, 5, 10)) AS m) UNION ALL SELECT make_date(y, 2, 8), 'workday' FROM (SELECT explode(sequence(1990, 2030)) AS y)")


HOLIDAYS_SQL = """h AS (SELECT make_date(y, m, 1) AS d, 'holiday' AS kind FROM range(1990, 2031) t(y), (VALUES (1), (5), (10)) v(m) UNION ALL SELECT make_date(y, 2, 8), 'workday' FROM range(1990, 2031) t(y)),
    days AS (SELECT CAST(x AS DATE) AS d FROM generate_series(DATE '1990-01-01', DATE '2030-12-31', INTERVAL 1 DAY) t(x)),
    kinds AS (SELECT days.d, coalesce(h.kind, CASE WHEN isodow(days.d) >= 6 THEN 'weekend' ELSE 'workday' END) AS kind FROM days LEFT JOIN h USING (d))"""


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of 200 stations: each order is a version of a run, four of a number in different periods, and its lines are the stops."""
    x = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().join(read(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    n, v, at = F.floor(F.col("o_orderkey") / 4).cast("int"), (F.col("o_orderkey") % 4).cast("int"), F.col("l_linenumber")
    begin = F.date_add(F.lit("1995-01-01").cast("date"), v * 600 + n % 500)
    clock = lambda m: F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))
    minute = F.lit(300) + n * 37 % 900 + at * 11
    return x.select(
        F.concat(F.lit("T"), n).alias("no"), at.alias("seq"), F.concat(F.lit("st"), (n * 7 + at * 11) % 200).alias("station"), clock(minute).alias("arrive"), clock(minute + 2).alias("depart"),
        F.element_at(F.array(F.lit("direct"), F.lit("express"), F.lit("normal")), n % 3 + 1).alias("type"), (F.col("o_orderkey") % 5 == 0).alias("workday_only"), begin.alias("eff_from"),
        F.when(~((n % 10 == 0) & (v == 3)), F.date_add(begin, 30 + n % 7 * 10)).alias("eff_until"),
    )


STOPS_SQL = """runs AS (SELECT o_orderkey AS k, o_orderkey // 4 AS n, o_orderkey % 4 AS v FROM orders),
    places AS (SELECT DISTINCT k, n, v, l_linenumber AS seq, 300 + n * 37 % 900 + l_linenumber * 11 AS m FROM lineitem JOIN runs ON k = l_orderkey),
    stops AS (SELECT 'T' || n AS no, seq, 'st' || ((n * 7 + seq * 11) % 200) AS station, printf('%02d:%02d', m // 60, m % 60) AS arrive, printf('%02d:%02d', (m + 2) // 60, (m + 2) % 60) AS depart,
      ['direct', 'express', 'normal'][n % 3 + 1] AS type, k % 5 = 0 AS workday_only, DATE '1995-01-01' + CAST(v * 600 + n % 500 AS INTEGER) AS eff_from,
      CASE WHEN NOT (n % 10 = 0 AND v = 3) THEN DATE '1995-01-01' + CAST(v * 600 + n % 500 + 30 + n % 7 * 10 AS INTEGER) END AS eff_until FROM places)"""


def trips_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request, origin, to, date, kinds, after, via, direction, no: a request for each event, some by type or over a station."""
    k = F.col("event_id")
    st = lambda x: F.concat(F.lit("st"), x % 200)
    return read(spark, sf_dir, "events").select(
        k.alias("request"), st(k).alias("origin"), st(k + 11 * (1 + k % 3)).alias("to"), F.date_add(F.lit("1995-01-01").cast("date"), (k * 7 % 2400).cast("int")).alias("date"),
        F.when(k % 4 == 0, "直达, 大站停").when(k % 4 == 1, "普通,unknown").otherwise("").alias("types"), F.when(k % 2 == 0, F.date_format("ts", "HH:mm")).alias("after"), F.when(k % 3 == 2, st(k + 11)).alias("via"),
        (k % 2).cast("int").alias("direction"), F.concat(F.lit("T"), k).alias("no"),
    )


ASKED_SQL = """asked AS (SELECT event_id AS request, 'st' || (event_id % 200) AS origin, 'st' || ((event_id + 11 * (1 + event_id % 3)) % 200) AS "to", DATE '1995-01-01' + CAST(event_id * 7 % 2400 AS INTEGER) AS date,
    CASE event_id % 4 WHEN 0 THEN ['direct', 'express'] WHEN 1 THEN ['normal'] ELSE ['direct', 'express', 'normal'] END AS kinds, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%H:%M') END AS after,
    CASE WHEN event_id % 3 = 2 THEN 'st' || ((event_id + 11) % 200) END AS via, CAST(event_id % 2 AS INTEGER) AS direction, 'T' || event_id AS no FROM events)"""
#: Runs between two stations on a date, before what is left out of them.
TRIPS_SQL = """trips AS (SELECT q.request, q.date, q.kinds, q.after, q.via, q."to", a.no, a.eff_from, a.type, a.workday_only, a.depart, b.arrive, a.seq AS sa, b.seq AS sb, CAST(split_part(b.arrive, ':', 1) AS INTEGER) * 60 + CAST(split_part(b.arrive, ':', 2) AS INTEGER)
      - CAST(split_part(a.depart, ':', 1) AS INTEGER) * 60 - CAST(split_part(a.depart, ':', 2) AS INTEGER) AS minutes
    FROM asked q JOIN stops a ON a.station = q.origin AND a.eff_from <= q.date AND coalesce(a.eff_until, q.date) >= q.date JOIN stops b ON b.no = a.no AND b.eff_from = a.eff_from AND b.station = q."to" AND b.seq > a.seq)"""


def suspensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """d, no: runs that don't run on a day, one for each customer; on a few days none runs."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(F.date_add(F.lit("1995-01-01").cast("date"), (k * 13 % 2400).cast("int")).alias("d"), F.when(k % 50 == 0, "*").otherwise(F.concat(F.lit("T"), k * 3 % 4000)).alias("no"))


SUSPENDED_SQL = """suspended AS (SELECT DATE '1995-01-01' + CAST(c_custkey * 13 % 2400 AS INTEGER) AS d, CASE WHEN c_custkey % 50 = 0 THEN '*' ELSE 'T' || (c_custkey * 3 % 4000) END AS no FROM customer)"""

WORDS = [("license", "licensed under", ["cc by", "all rights reserved"]), ("insult", "idiot", ["clown", "loser"]), ("credential", "password", ["token", "api key"])]


def word_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WORDS, "category string, word string, variants array<string>")


CLAUSES = [("rights", True, ["rights reserved", "licensed"]), ("contact", True, ["@mail", "example.com"]), ("secrets", False, ["password", "token"])]


def clauses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLAUSES, "clause string, required boolean, keywords array<string>")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share: below spark.checkpoint.dir, or a temporary one in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
    return f"{root.rstrip('/')}/opsdesk-{name}-{uuid.uuid4().hex}"


def numbers_with_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, id (18 characters of a personal number), code (18 of a credit code), old (an old tax number or none); about one in
    eleven or thirty-one has the right check character."""
    o = read(spark, sf_dir, "orders")
    born = F.when(F.col("o_orderkey") % 13 == 0, "19990230").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    person = F.concat(F.lpad((F.col("o_orderkey") % 999983).cast("string"), 6, "1"), born, F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.expr("substr('10X98765432', cast(o_orderkey % 11 as int) + 1, 1)"))
    code = F.concat(F.lit("9135"), F.lpad((F.col("o_orderkey") * 7919 % 9999991).cast("string"), 7, "2"), F.lit("MA"), F.lpad((F.col("o_custkey") % 9973).cast("string"), 4, "X"), F.expr("substr('0123456789ABCDEFGHJKLMNPQRTUWXY', cast(o_orderkey % 31 as int) + 1, 1)"))
    old = F.concat(F.lpad(F.col("o_custkey").cast("string"), 14, "3"), F.when(F.col("o_orderkey") % 3 == 0, "A").when(F.col("o_orderkey") % 3 == 1, "7").otherwise(""))
    return o.select(F.col("o_orderkey").alias("k"), person.alias("id"), code.alias("code"), old.alias("old"))


NUMBERS_SQL = """n AS (SELECT o_orderkey AS k, lpad(CAST(o_orderkey % 999983 AS VARCHAR), 6, '1') || CASE WHEN o_orderkey % 13 = 0 THEN '19990230' ELSE strftime(o_orderdate, '%Y%m%d') END || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0')
      || substr('10X98765432', CAST(o_orderkey % 11 AS INTEGER) + 1, 1) AS id,
    '9135' || lpad(CAST(o_orderkey * 7919 % 9999991 AS VARCHAR), 7, '2') || 'MA' || lpad(CAST(o_custkey % 9973 AS VARCHAR), 4, 'X') || substr('0123456789ABCDEFGHJKLMNPQRTUWXY', CAST(o_orderkey % 31 AS INTEGER) + 1, 1) AS code,
    lpad(CAST(o_custkey AS VARCHAR), 14, '3') || CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN '7' ELSE '' END AS old FROM orders)"""


def customer_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of customer tables as other tools export them: one file with semicolons and quotes in UTF-8, one with tabs in
    GB18030; line breaks and quotes inside cells."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    c = read(spark, sf_dir, "customer")
    note = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit('said "'), F.col("c_mktsegment"), F.lit('"\nand left'))).otherwise(F.concat(F.lit("客户；"), F.col("c_mktsegment")))
    rows = c.select(F.col("c_custkey").cast("string").alias("客户号"), F.col("c_name").alias("名称"), F.col("c_acctbal").cast("decimal(12,2)").cast("string").alias("余额"), note.alias("备注"))
    folder = scratch(spark, "customers")
    even = F.col("客户号").cast("long") % 2 == 0
    for part, sep, encoding in ((rows.where(even), ";", "UTF-8"), (rows.where(~even), "\t", "GB18030")):
        part.write.mode("append").options(sep=sep, encoding=encoding, header="true", quoteAll="true", escape='"').csv(folder)
    return folder


def leaky_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: on its second line each has one key, or something that only looks like one."""
    k = F.col("o_orderkey")
    m, s = k % 10, k.cast("string")
    row = (
        F.when(m == 0, F.concat(F.lit("id AKIA"), F.lpad(s, 16, "0"), F.lit(" end"))).when(m == 1, F.concat(F.lit('  password = "Tr0ub4dor'), s, F.lit('"'))).when(m == 2, F.lit("password: xxxxxxxx, token=your_token"))
        .when(m == 3, F.concat(F.lit("at postgres://u:pw"), s, F.lit("@db/x"))).when(m == 4, F.concat(F.lit("tel 1380000"), F.lpad((k % 10000).cast("string"), 4, "0"))).when(m == 5, F.concat(F.lit("mail a"), s, F.lit("@corp.io")))
        .when(m == 6, F.lit("mail a@example.com, postgres://u:changeme@db/x")).when(m == 7, F.concat(F.lit("ghp_"), F.lpad(s, 36, "a"))).when(m == 8, F.lit("-----BEGIN RSA PRIVATE KEY-----")).otherwise(F.concat(F.lit("LTAI"), F.lpad(s, 16, "b")))
    )
    return read(spark, sf_dir, "orders").select(k.alias("doc_id"), F.concat(F.lit("first\n"), row, F.lit("\nlast")).alias("text"))


#: What the texts above hold: the place of the key, its rule and level, and the key itself, masked.
LEAKY_SQL = """v AS (SELECT o_orderkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS s, o_orderkey % 10 AS m FROM orders),
    f AS (SELECT doc_id, CASE m WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 6 ELSE 1 END AS pos, ['aws_ak', 'generic_secret', '', 'db_url', 'phone', 'email', '', 'github_token', 'private_key', 'aliyun_ak'][m + 1] AS rule,
      ['high', 'medium', '', 'high', 'medium', 'low', '', 'high', 'high', 'high'][m + 1] AS level, CASE m WHEN 0 THEN 'AKIA' || lpad(s, 16, '0') WHEN 1 THEN 'password = "Tr0ub4dor' || s WHEN 3 THEN 'postgres://u:pw' || s || '@db'
      WHEN 4 THEN '1380000' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') WHEN 5 THEN 'a' || s || '@corp.io' WHEN 7 THEN 'ghp_' || lpad(s, 36, 'a') WHEN 8 THEN '-----BEGIN RSA PRIVATE KEY-----' WHEN 9 THEN 'LTAI' || lpad(s, 16, 'b') END AS x FROM v),
    k AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, rule, level, left(x, 4) || repeat('*', CAST(least(12, len(x) - 8) AS INTEGER)) || right(x, 4) AS masked FROM f)"""


def _alone(words: list[str]) -> list[str]:
    """Words that hold no other of them."""
    return [w for w in words if not any(o != w and o in w for o in words)]


AD_LEVELS = {w: level for level, words in lexicons.AD_WORDS.items() for w in words}
AD_LIST = _alone(list(AD_LEVELS))
BANNED_LIST = [(c, w, v) for c, w, *vs in (line.split("|") for line in lexicons.BANNED.strip().split("\n")) for v in (w, *vs)]
BANNED_LIST = [x for k, x in enumerate(BANNED_LIST) if x[2] in _alone([v for *_, v in BANNED_LIST]) and not any(x[2].lower() == y[2].lower() for y in BANNED_LIST[:k])]


def advertisements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: two restricted words on two lines, and, in every third, phrases in which such words are plain facts."""
    k = F.col("o_orderkey")
    word = lambda at: F.element_at(F.array(*map(F.lit, AD_LIST)), (at % len(AD_LIST) + 1).cast("int"))
    facts = F.when(k % 3 == 0, " 最佳赏味期 第一次 z").otherwise("")
    return read(spark, sf_dir, "orders").select(k.alias("doc_id"), F.concat(F.lit("k"), k, F.lit(" 本 "), word(k), F.lit(" 店\nx "), word(k * 7 + 3), F.lit(" y"), facts).alias("text"))


_WORD = lambda at: f"{AD_LIST}[{at} % {len(AD_LIST)} + 1]"
ADVERTISEMENTS_SQL = f"""a AS (SELECT o_orderkey AS doc_id, {_WORD('o_orderkey')} AS u, {_WORD('(o_orderkey * 7 + 3)')} AS v, 'k' || o_orderkey || ' 本 ' AS p, CASE WHEN o_orderkey % 3 = 0 THEN ' 最佳赏味期 第一次 z' ELSE '' END AS facts FROM orders),
    b AS (SELECT doc_id, p || u || ' 店' || chr(10) || 'x ' || v || ' y' || facts AS text, [{{'start': len(p), 'line': 1, 'word': u}}, {{'start': len(p) + len(u) + 5, 'line': 2, 'word': v}}] AS found FROM a),
    c AS (SELECT doc_id, text, unnest(found, recursive := true) FROM b)"""
AD_LEVELS_SQL = "(VALUES " + ", ".join(f"('{w}', '{level}')" for w, level in AD_LEVELS.items()) + ") l(word, level)"


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a banned word of each post, its characters set apart by marks and blanks."""
    k = F.col("o_orderkey")
    word = F.element_at(F.array(*[F.lit(v) for *_, v in BANNED_LIST]), (k % len(BANNED_LIST) + 1).cast("int"))
    mark = F.element_at(F.array(F.lit(""), F.lit(" * "), F.lit("·"), F.lit("，")), (k % 4 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select(k.alias("doc_id"), F.concat(F.repeat(F.lit("zz\n"), (k % 3).cast("int")), F.lit("zz "), F.call_function("array_join", F.split(word, ""), mark), F.lit(" zz")).alias("text"))


_BANNED = "[" + ", ".join(f"{{'c': '{c}', 'w': '{w}', 'v': '{v}'}}" for c, w, v in BANNED_LIST) + "]"
POSTS_SQL = f"""p AS (SELECT o_orderkey AS doc_id, {_BANNED}[o_orderkey % {len(BANNED_LIST)} + 1] AS x, ['', ' * ', '·', '，'][o_orderkey % 4 + 1] AS mark FROM orders)"""


def json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: an order as JSON with a tag of two kinds, items of which some lack a key, and, in every fifth, no sub; every seventh is cut."""
    k = F.col("o_orderkey")
    tag = F.when(k % 2 == 0, F.concat(F.lit('"'), "o_orderstatus", F.lit('"'))).otherwise(k.cast("string"))
    sub = F.when(k % 5 > 0, F.concat(F.lit(', "sub": {"k": '), F.when(k % 3 == 0, "null").otherwise("[]"), F.lit("}"))).otherwise("")
    text = F.concat(F.lit('{"id": '), k, F.lit(', "tag": '), tag, F.lit(', "items": [{"n": 1}, {"n": 2, "x": true}]'), sub, F.when(k % 7 == 0, "").otherwise("}"))
    return read(spark, sf_dir, "orders").select(k.alias("doc_id"), text.alias("text"))


JSON_TEXTS_SQL = """j AS (SELECT o_orderkey AS doc_id, o_orderkey AS k, '{"id": ' || o_orderkey || ', "tag": ' || CASE WHEN o_orderkey % 2 = 0 THEN '"' || o_orderstatus || '"' ELSE CAST(o_orderkey AS VARCHAR) END || ', "items": [{"n": 1}, {"n": 2, "x": true}]'
    || CASE WHEN o_orderkey % 5 > 0 THEN ', "sub": {"k": ' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '[]' END || '}' ELSE '' END || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '}' END AS text FROM orders)"""
