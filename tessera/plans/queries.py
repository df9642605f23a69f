"""Registered queries over the test tables, each with the same question in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import maths, strings, times, values
from tessera.operators import folds, lookups
from tessera.operators.rules import Like, Rule, apply_rules, switch, switch_bodies
from tessera.plans import ordered
from tessera.sources import records, sinks

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(table: str, sql: str | None) -> Callable:
    """Register a function of one table's rows; it may take (spark, sf_dir) behind them."""

    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark.read.parquet(f"{sf_dir}/{table}.parquet"), lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- patterns, projection, control flow

@query("lineitem", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30")
def filter_cmp(df, of):
    return df.where("l_returnflag = 'R' and l_quantity > 30").select("l_orderkey", "l_quantity")


@query("part", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%'")
def filter_literal_pattern(df, of):
    return df.where(strings.matches(F.col("p_name"), "ring")).select("p_partkey", "p_name")


@query("part", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '^Brand#[12][0-9]$')")
def filter_regex(df, of):
    return df.where(strings.matches(F.col("p_brand"), "^Brand#[12][[:digit:]]$")).select("p_partkey")


@query("part", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, 'econ', 'i')")
def filter_ignore_case(df, of):
    return df.where(strings.matches(F.col("p_type"), "econ", ignore_case=True)).select("p_partkey")


@query("lineitem", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def project_three(df, of):
    return df.select("l_orderkey", "l_partkey", "l_quantity")


@query("orders", "SELECT o_orderstatus || '-' || o_orderpriority AS line, o_orderkey FROM orders")
def concat_print(df, of):
    return df.select(F.concat("o_orderstatus", F.lit("-"), "o_orderpriority").alias("line"), "o_orderkey")


@query("orders", """SELECT o_orderkey, 0 AS rule, 'big' AS out FROM orders WHERE o_totalprice > 300000
    UNION ALL SELECT o_orderkey, 2, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'
    UNION ALL SELECT o_orderkey, 3, 'F' FROM orders WHERE o_orderstatus = 'F'""")
def rules_with_next(df, of):
    done = F.col("o_orderstatus") == "F"
    rules = [
        Rule(F.col("o_totalprice") > 300000, F.lit("big")),
        Rule(None, None),
        Rule(~done, F.col("o_orderpriority"), stop=True),
        Rule(None, F.col("o_orderstatus")),
    ]
    return apply_rules(df, rules, ["o_orderkey"])


@query("orders", """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'known' WHEN o_orderstatus = 'P' THEN 'partial'
    ELSE 'other' END AS state FROM orders""")
def switch_fall_through(df, of):
    state = switch(F.col("o_orderstatus"), [(["F", "O"], F.lit("known")), ("P", F.lit("partial"))], F.lit("other"))
    return df.select("o_orderkey", state.alias("state"))


@query("events", """WITH t AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN 0 WHEN event_type = 'signup' THEN 1 END IGNORE NULLS)
    OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open FROM events)
    SELECT event_id, event_type FROM t WHERE open = 1 OR event_type = 'signup'""")
def range_pattern(df, of):
    return ordered.between(df, "event_id", "event_type = 'signup'", "event_type = 'purchase'").select("event_id", "event_type")


@query("events", """SELECT event_id FROM events WHERE event_id <=
    (SELECT min(event_id) FROM events WHERE event_type = 'error' AND value > 50)""")
def exit_at(df, of):
    return ordered.until(df, "event_id", "event_type = 'error' and value > 50").select("event_id")


@query("events", """SELECT e.event_id, e.user_id FROM events e LEFT JOIN (SELECT user_id, min(event_id) AS cut FROM events
    WHERE event_type = 'error' GROUP BY user_id) c USING (user_id) WHERE cut IS NULL OR event_id < cut""")
def next_group(df, of):
    return ordered.until(df, "event_id", "event_type = 'error'", ["user_id"], inclusive=False).select("event_id", "user_id")


@query("events", "SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS nr FROM events) WHERE nr % 10 = 0")
def sample_every_tenth(df, of):
    return ordered.sampled(df, "event_id", 10).select("event_id", "value")


@query("events", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 20")
def head(df, of):
    return folds.top(df, [F.col("event_id")], 20).select("event_id", "event_type")


# --- ordered state

@query("events", "SELECT event_id, row_number() OVER (ORDER BY event_id) AS nr FROM events")
def record_number(df, of):
    return ordered.numbered(df, "event_id").select("event_id", "nr")


@query("events", "SELECT event_id, sum(user_id) OVER (ORDER BY event_id)::BIGINT AS total FROM events")
def running_sum(df, of):
    return ordered.running(df, "event_id", "total", "user_id").select("event_id", "total")


@query("events", "SELECT event_id, max(value) OVER (ORDER BY event_id) AS most FROM events")
def running_max(df, of):
    return ordered.running(df, "event_id", "most", "value", "max").select("event_id", "most")


@query("events", "SELECT event_id, count(*) FILTER (event_type = 'error') OVER (ORDER BY event_id) AS errors FROM events")
def running_count(df, of):
    return ordered.running(df, "event_id", "errors", "case when event_type = 'error' then 1 end", "count").select("event_id", "errors")


@query("orders", """SELECT o_orderkey, o_totalprice - coalesce(lag(o_totalprice) OVER (ORDER BY o_orderkey), 0) AS change FROM orders""")
def previous_difference(df, of):
    df = ordered.previous(df, "o_orderkey", "before", "o_totalprice")
    return df.select("o_orderkey", (F.col("o_totalprice") - F.coalesce("before", F.lit(0.0))).alias("change"))


@query("orders", "SELECT o_orderkey, lead(o_custkey) OVER (ORDER BY o_orderkey) AS next_customer FROM orders")
def look_ahead(df, of):
    return ordered.following(df, "o_orderkey", "next_customer", "o_custkey").select("o_orderkey", "next_customer")


@query("events", """SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN user_id END IGNORE NULLS) OVER (ORDER BY event_id) AS newest
    FROM events""")
def since_last_marker(df, of):
    return ordered.latched(df, "event_id", "newest", "user_id", "event_type = 'signup'").select("event_id", "newest")


@query("events", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events")
def rank_within_key(df, of):
    return ordered.ranked_within(df, ["user_id"], "event_id").select("event_id", "user_id", "n")


@query("events", """SELECT event_id, user_id, sum(o) OVER (PARTITION BY user_id ORDER BY event_id) ::BIGINT AS session FROM
    (SELECT *, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) <= 100 THEN 0 ELSE 1 END AS o FROM events)""")
def sessionise(df, of):
    return ordered.sessions(df, ["user_id"], "event_id", 100).select("event_id", "user_id", "session")


# --- accumulators

@query("lineitem", "SELECT round(sum(l_quantity), 2) AS total FROM lineitem")
def agg_sum(df, of):
    return folds.fold(df, [], total=F.round(F.sum("l_quantity"), 2))


@query("lineitem", "SELECT round(sum(l_quantity * l_discount), 2) AS total FROM lineitem")
def agg_sum_of_products(df, of):
    return folds.fold(df, [], total=F.round(F.sum(F.col("l_quantity") * F.col("l_discount")), 2))


@query("lineitem", "SELECT count(*) FILTER (l_discount > 0.05) AS n, count(*) AS nr FROM lineitem")
def agg_filtered_count(df, of):
    return folds.fold(df, [], n=F.count_if(F.col("l_discount") > 0.05), nr=F.count("*"))


@query("lineitem", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02'
    GROUP BY ALL""")
def flagship_pricing_summary(df, of):
    price = F.col("l_extendedprice")
    return folds.fold(
        df.where("l_shipdate <= timestamp '2001-09-02'"),
        ["l_returnflag", "l_linestatus"],
        sum_qty=F.round(F.sum("l_quantity"), 2),
        sum_price=F.round(F.sum(price), 2),
        sum_disc=F.round(F.sum(price * (1 - F.col("l_discount"))), 2),
        n=F.count("*"),
    )


@query("lineitem", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def agg_group_count(df, of):
    return folds.fold(df, ["l_suppkey"], n=F.count("*"))


@query("lineitem", "SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber")
def agg_composite_key(df, of):
    return folds.fold(df, ["l_orderkey", "l_linenumber"], q=F.sum("l_quantity"))


@query("part", "SELECT p_brand, min(p_retailprice) AS least, max(p_retailprice) AS most, round(sum(p_size) / count(*), 6) AS mean FROM part GROUP BY p_brand")
def agg_min_max_mean(df, of):
    return folds.fold(
        df, ["p_brand"], least=F.min("p_retailprice"), most=F.max("p_retailprice"), mean=F.round(F.sum("p_size") / F.count("*"), 6)
    )


@query("events", "SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def agg_first_last(df, of):
    first, last = (f(F.col("event_type"), "event_id") for f in (folds.first_by, folds.last_by))
    return folds.fold(df, ["user_id"], first_type=first, last_type=last)


@query("nation", "SELECT n_regionkey, round(product(n_nationkey + 0.5), 3) AS p FROM nation GROUP BY n_regionkey")
def agg_product(df, of):
    return folds.fold(df, ["n_regionkey"], p=F.round(folds.product(F.col("n_nationkey") + F.lit(0.5)), 3))


@query("orders", "SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders")
def count_distinct(df, of):
    return folds.fold(df, [], customers=F.count_distinct("o_custkey"), priorities=F.count_distinct("o_orderpriority"))


@query("part", "SELECT DISTINCT p_type, p_size FROM part")
def distinct_keys(df, of):
    return folds.distinct_values(df, ["p_type", "p_size"])


@query("events", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def dedup_first(df, of):
    return folds.seen_first(df.select("user_id", "event_id"), ["user_id"], "event_id")


@query("nation", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_nationkey) AS n_name FROM nation GROUP BY n_regionkey")
def text_accumulation(df, of):
    return folds.joined_text(df, ["n_regionkey"], "n_name", "n_nationkey", ";")


@query("orders", """SELECT 'status' AS name, o_orderstatus AS key, count(*)::DOUBLE AS value FROM orders GROUP BY o_orderstatus
    UNION ALL SELECT 'priority', o_orderpriority, count(*)::DOUBLE FROM orders GROUP BY o_orderpriority""")
def several_accumulators(df, of):
    return folds.folds(df, {"status": ("o_orderstatus", F.lit(1)), "priority": ("o_orderpriority", F.lit(1))})


@query("lineitem", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 10")
def top_k(df, of):
    return folds.top(folds.fold(df, ["l_partkey"], n=F.count("*")), [F.desc("n"), F.col("l_partkey")], 10)


@query("part", "SELECT p_brand AS key, count(*) AS value FROM part GROUP BY p_brand ORDER BY value DESC, key")
def sorted_by_value(df, of):
    counts = folds.fold(df, ["p_brand"], value=F.count("*")).withColumnRenamed("p_brand", "key")
    return folds.sorted_by(counts, "val_num_desc")


@query("part", "SELECT key, row_number() OVER (ORDER BY key) AS i FROM (SELECT DISTINCT p_brand AS key FROM part)")
def asorti_keys(df, of):
    keys = folds.distinct_values(df, ["p_brand"]).withColumnRenamed("p_brand", "key")
    return ordered.numbered(keys, "key", "i")


# --- lookups and several inputs

@query("customer", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_inner(df, of):
    table = lookups.table_of(of("nation").withColumnRenamed("n_nationkey", "c_nationkey"), ["c_nationkey"], ["n_name"])
    return lookups.lookup(df, table, ["c_nationkey"]).select("c_custkey", "n_name")


@query("customer", """SELECT c_custkey, coalesce(last_order, -1) AS last_order FROM customer LEFT JOIN
    (SELECT o_custkey, max(o_orderkey) AS last_order FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")
def join_left_last_wins(df, of):
    made = of("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("last_order"))
    table = lookups.table_of(made, ["c_custkey"], ["last_order"], "last_order")
    return lookups.lookup(df, table, ["c_custkey"], "left", {"last_order": -1}).select("c_custkey", "last_order")


@query("customer", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def join_semi(df, of):
    big = of("orders").where("o_totalprice > 400000").withColumnRenamed("o_custkey", "c_custkey")
    return lookups.within(df, big, ["c_custkey"]).select("c_custkey")


@query("customer", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti(df, of):
    return lookups.without(df, of("orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select("c_custkey")


@query("nation", """SELECT n_name AS name, 0 AS file_index FROM nation UNION ALL SELECT r_name, 1 FROM region""")
def union_inputs(df, of):
    return folds.union_all(df.select(F.col("n_name").alias("name")), of("region").select(F.col("r_name").alias("name")))


@query("orders", """SELECT DISTINCT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'""")
def intersect_keys(df, of):
    keys = of("customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("k"))
    return lookups.within(folds.distinct_values(df.select(F.col("o_custkey").alias("k")), ["k"]), keys, ["k"])


@query("events", """WITH s AS (SELECT user_id, event_id, value AS signup_value FROM events WHERE event_type = 'signup')
    SELECT p.event_id, p.user_id, s.signup_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.event_id >= s.event_id""")
def join_as_of(df, of):
    signups = df.where("event_type = 'signup'").select("user_id", "event_id", F.col("value").alias("signup_value"))
    bought = df.where("event_type = 'purchase'").select("event_id", "user_id")
    return ordered.as_of(bought, signups, ["user_id"], "event_id", ["signup_value"])


@query("orders", """SELECT o_orderkey, s_suppkey FROM orders JOIN (SELECT s_suppkey, s_acctbal AS low, s_acctbal + 50 AS high FROM supplier)
    ON o_totalprice / 50 >= low AND o_totalprice / 50 < high""")
def join_interval(df, of):
    bands = of("supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 50).alias("high"))
    points = df.select("o_orderkey", (F.col("o_totalprice") / 50).alias("point"))
    return lookups.in_interval(points, "point", bands, "low", "high", 50).select("o_orderkey", "s_suppkey")


# --- records and fields

@query("part", "SELECT p_partkey, len(string_split(p_name, ' ')) AS nf, string_split(p_name, ' ')[1] AS f1, string_split(p_name, ' ')[-1] AS last FROM part")
def fields_blank(df, of):
    parts = records.fields(F.col("p_name"))
    return df.select("p_partkey", F.size(parts).cast("bigint").alias("nf"), records.field(parts, 1).alias("f1"), records.field(parts, -1).alias("last"))


@query("customer", "SELECT c_custkey, string_split(c_name, '#')[2] AS f2, coalesce(string_split(c_name, '#')[5], '') AS f5 FROM customer")
def fields_character(df, of):
    parts = records.fields(F.col("c_name"), "#")
    return df.select("c_custkey", records.field(parts, 2).alias("f2"), records.field(parts, 5).alias("f5"))


@query("pages", "SELECT page_id, regexp_split_to_array(url, '[/.:?=&]+')[2] AS f2, len(regexp_split_to_array(url, '[/.:?=&]+')) AS nf FROM pages")
def fields_regex(df, of):
    parts = records.fields(F.col("url"), "[/.:?=&]+")
    return df.select("page_id", records.field(parts, 2).alias("f2"), F.size(parts).cast("bigint").alias("nf"))


@query("customer", "SELECT c_custkey, substr(c_name, 1, 3) AS a, substr(c_name, 6, 4) AS b, substr(c_name, 10) AS c FROM customer")
def fields_fixed_width(df, of):
    parts = records.fields_by_width(F.col("c_name"), "3 2:4 *")
    return df.select("c_custkey", *[records.field(parts, i).alias(n) for i, n in enumerate("abc", 1)])


@query("events", "SELECT event_id, regexp_extract_all(props, '[a-z]+|[0-9]+')[2] AS v FROM events")
def fields_by_content(df, of):
    return df.select("event_id", records.field(records.fields_by_content(F.col("props"), "[a-z]+|[0-9]+"), 2).alias("v"))


@query("part", """SELECT p_partkey, p_brand AS a, p_name || ', "' || p_type || '"' AS b, '' AS c FROM part""")
def fields_csv(df, of):
    line = F.concat("p_brand", F.lit(',"'), "p_name", F.lit(', ""'), "p_type", F.lit('""",'))
    parts = records.csv_fields(line)
    return df.select("p_partkey", *[records.field(parts, i).alias(n) for i, n in enumerate("abc", 1)])


@query("documents", """SELECT doc_id, pos, line AS record FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS pos FROM
    (SELECT doc_id, string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) AS parts FROM documents WHERE text <> ''))""")
def records_lines(df, of):
    return records.split_records(df.select("doc_id", "text"), "\n", "text").select("doc_id", "pos", "record")


@query("orders", "SELECT o_orderkey, o_orderstatus || ':X:' || o_custkey AS line FROM orders")
def field_assignment(df, of):
    parts = records.fields(records.record_of(df, ["o_orderstatus", "o_orderkey", "o_custkey"]))
    return df.select("o_orderkey", records.joined(records.with_field(parts, 2, F.lit("X")), ":").alias("line"))


@query("part", "SELECT p_partkey, split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) || ' ' AS line FROM part")
def field_count_assignment(df, of):
    return df.select("p_partkey", records.joined(records.with_count(records.fields(F.col("p_name")), 3)).alias("line"))


@query("part", """SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word""")
def word_count(df, of):
    return folds.fold(df.select(F.explode(records.fields(F.col("p_name"))).alias("word")), ["word"], n=F.count("*"))


@query("part", "SELECT p_partkey, p_size || ' ' || p_brand AS line FROM part")
def print_columns(df, of):
    return df.select("p_partkey", sinks.printed(df, ["p_size", "p_brand"]))


# --- text functions

@query("part", """SELECT p_partkey, length(p_name) AS n, strpos(p_name, 'i') AS at, substr(p_name, 2, 3) AS mid, upper(p_name) AS up,
    lower(p_type) AS low, reverse(p_brand) AS back FROM part""")
def str_basic(df, of):
    name = F.col("p_name")
    return df.select(
        "p_partkey", F.length(name).alias("n"), strings.index(name, "i").alias("at"), strings.substr(name, 2, 3).alias("mid"),
        F.upper(name).alias("up"), F.lower("p_type").alias("low"), F.reverse("p_brand").alias("back"),
    )


@query("part", """SELECT p_partkey, replace(p_name, 'ring', 'RING') AS a, regexp_replace(p_name, '[aeiou]', '<\\0>', 'g') AS b,
    regexp_replace(p_name, '[aeiou]', '-') AS c, len(regexp_extract_all(p_name, '[aeiou]')) AS n FROM part""")
def str_replace(df, of):
    name = F.col("p_name")
    return df.select(
        "p_partkey", strings.gsub(name, "ring", "RING").alias("a"), strings.gsub(name, "[aeiou]", "<&>").alias("b"),
        strings.sub(name, "[aeiou]", "-").alias("c"), strings.gsub_count(name, "[aeiou]").cast("bigint").alias("n"),
    )


@query("customer", "SELECT c_custkey, regexp_replace(c_name, '([A-Z])([a-z]+)', '\\2\\1', 'g') AS swapped FROM customer")
def str_gensub(df, of):
    return df.select("c_custkey", strings.gensub(F.col("c_name"), "([A-Z])([a-z]+)", r"\2\1", "g").alias("swapped"))


@query("customer", """SELECT c_custkey, strpos(c_name, '#') AS at, 10 AS size, regexp_extract(c_name, '#0*([0-9]+)', 1) AS id FROM customer""")
def str_match(df, of):
    found = strings.match(F.col("c_name"), "#[0-9]+")
    return df.select("c_custkey", found["start"].alias("at"), found["length"].alias("size"), strings.group(F.col("c_name"), "#0*([0-9]+)", 1).alias("id"))


@query("orders", "SELECT o_orderkey, p AS piece, i AS at FROM (SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS p, unnest([1, 2]) AS i FROM orders WHERE o_orderpriority LIKE '%-%')")
def split_explode(df, of):
    pieces = df.where(F.col("o_orderpriority").contains("-")).select("o_orderkey", F.posexplode(strings.pieces(F.col("o_orderpriority"), "-")).alias("at", "piece"))
    return pieces.select("o_orderkey", "piece", (F.col("at") + 1).alias("at"))


@query("part", "SELECT p_partkey, printf('%5d|%-12s|%x', p_size, p_brand, p_size) AS line FROM part")
def printf_fixed(df, of):
    return df.select("p_partkey", strings.formatted("%5d|%-12s|%x", F.col("p_size"), F.col("p_brand"), F.col("p_size")).alias("line"))


@query("part", """SELECT p_partkey, printf('%05d|%-8.3s|%+d|%8.2f|%g', p_size, p_brand, p_size, p_retailprice, p_size / 4.0::DOUBLE) AS line FROM part""")
def printf_precision(df, of):
    size = F.col("p_size")
    return df.select(
        "p_partkey",
        strings.formatted("%05d|%-*.*s|%+d|%8.2f|%g", size, 8, 3, F.col("p_brand"), size, F.col("p_retailprice"), size / 4).alias("line"),
    )


@query("customer", """SELECT c_custkey, regexp_extract(c_name, '([A-Za-z]+)#0*([0-9]+)', 1) AS word, regexp_extract(c_name, '([A-Za-z]+)#0*([0-9]+)', 2) AS id
    FROM customer""")
def str_match_groups(df, of):
    found = strings.match_groups(F.col("c_name"), "([A-Za-z]+)#0*([0-9]+)", 2)
    return df.select("c_custkey", F.get(found, 1).alias("word"), F.get(found, 2).alias("id"))


@query("events", """SELECT event_id, ascii(event_type) AS code, chr(ascii(event_type)) AS letter, TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS v FROM events""")
def str_codes(df, of):
    kind = F.col("event_type")
    code = strings.ordinal(kind)
    number = values.num(strings.group(F.col("props"), "[0-9]+", 0))
    return df.select("event_id", code.alias("code"), strings.character(code).alias("letter"), number.alias("v"))


@query("part", """SELECT p_partkey, coalesce(TRY_CAST(regexp_extract(p_name, '^[0-9]+') AS DOUBLE), 0) + TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS v,
    CASE WHEN TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) < 9 THEN 1 ELSE 0 END AS numeric_less,
    CASE WHEN split_part(p_brand, '#', 2) < '9' THEN 1 ELSE 0 END AS text_less FROM part""")
def coercion(df, of):
    brand = records.field(records.fields(F.col("p_brand"), "#"), 2)
    return df.select(
        "p_partkey",
        (values.num(F.col("p_name")) + values.num(brand)).alias("v"),
        maths.truth(values.compare(brand, "<", F.lit(9.0), right_kind="number")).alias("numeric_less"),
        maths.truth(values.compare(brand, "<", F.lit("9"), right_kind="string")).alias("text_less"),
    )


# --- numbers, bits, time

@query("lineitem", """SELECT l_orderkey, l_linenumber, round(sin(l_quantity), 9) AS s, round(cos(l_quantity), 9) AS c, round(atan2(l_quantity, 2), 9) AS a,
    round(exp(l_discount), 9) AS e, round(ln(l_quantity), 9) AS l, round(sqrt(l_extendedprice), 6) AS r, trunc(l_extendedprice) AS i,
    l_quantity % 7 AS m, pow(l_quantity, 2) AS p FROM lineitem""")
def math_functions(df, of):
    q, price = F.col("l_quantity"), F.col("l_extendedprice")
    return df.select(
        "l_orderkey", "l_linenumber", F.round(F.sin(q), 9).alias("s"), F.round(F.cos(q), 9).alias("c"),
        F.round(F.atan2(q, F.lit(2)), 9).alias("a"), F.round(F.exp("l_discount"), 9).alias("e"), F.round(maths.log(q), 9).alias("l"),
        F.round(F.sqrt(price), 6).alias("r"), maths.truncated(price).alias("i"), maths.modulo(q, F.lit(7)).alias("m"),
        F.pow(q, F.lit(2)).alias("p"),
    )


@query("part", """SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 3 AS o, xor(p_partkey, 5) AS x, p_partkey << 3 AS l, p_partkey >> 2 AS r, ~p_partkey AS c,
    p_partkey // 7 AS d, CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_partkey // (p_size % 5) END AS d0 FROM part""")
def bit_functions(df, of):
    k = F.col("p_partkey")
    return df.select(
        "p_partkey", maths.bit_and(k, F.lit(12)).alias("a"), maths.bit_or(k, F.lit(3)).alias("o"), maths.bit_xor(k, F.lit(5)).alias("x"),
        maths.shift_left(k, 3).alias("l"), maths.shift_right(k, 2).alias("r"), maths.complement(k).alias("c"),
        maths.intdiv(k, F.lit(7)).alias("d"), maths.intdiv0(k, F.col("p_size") % 5).alias("d0"),
    )


@query("orders", """SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S %j') AS line, epoch(o_orderdate)::BIGINT AS at, year(o_orderdate) AS y,
    dayofweek(o_orderdate) AS wd FROM orders""")
def time_functions(df, of):
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    parts = times.calendar(seconds)
    return df.select(
        "o_orderkey", times.strftime("%Y/%m/%d %H:%M:%S %j", seconds).alias("line"),
        times.mktime(F.date_format("o_orderdate", "yyyy MM dd HH mm ss")).alias("at"), parts["year"].cast("bigint").alias("y"),
        parts["weekday"].cast("bigint").alias("wd"),
    )


@query("events", "SELECT (floor(epoch(ts))::BIGINT // 3600) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def time_bucket_key(df, of):
    hour = maths.intdiv(F.unix_seconds(F.col("ts").cast("timestamp")), F.lit(3600))
    return folds.fold(df.withColumn("hour", hour), ["hour", "event_type"], n=F.count("*"))


# --- records and files, second part

@query("documents", """WITH a AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\A([ \\t]*\\n)+', '') AS t FROM documents),
    b AS (SELECT doc_id, t, rtrim(t, chr(32) || chr(9) || chr(10)) AS body FROM a),
    c AS (SELECT doc_id, body || split_part(substr(t, length(body) + 1), chr(10), 1) AS body, t FROM b),
    d AS (SELECT doc_id, string_split_regex(body, '\\n([ \\t]*\\n)+') AS parts,
                 list_append(regexp_extract_all(body, '\\n([ \\t]*\\n)+'), substr(t, length(body) + 1)) AS ends FROM c WHERE body <> '')
    SELECT doc_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS record, unnest(ends) AS rt FROM d""")
def records_paragraph(df, of):
    return records.split_records(df.select("doc_id", "text"), "", "text")


@query("documents", """WITH a AS (SELECT doc_id, string_split_regex(text, '[.!?][[:space:]]+') AS p, regexp_extract_all(text, '[.!?][[:space:]]+') AS e
    FROM documents WHERE text <> '')
    SELECT doc_id, i - 1 AS pos, p[i] AS record, coalesce(e[i], '') AS rt FROM (SELECT *, unnest(generate_series(1, len(p))) AS i FROM a)
    WHERE i < len(p) OR p[i] <> ''""")
def records_pattern(df, of):
    return records.split_records(df.select("doc_id", "text"), "[.!?][[:space:]]+", "text")


@query("orders", """SELECT o_orderpriority, 0 AS edge, min(o_orderkey) AS o_orderkey, 'begin' AS line FROM orders GROUP BY ALL
    UNION ALL SELECT o_orderpriority, 1, max(o_orderkey), count(*) || ' records' FROM orders GROUP BY ALL""")
def file_begin_and_end(df, of):
    return records.file_edges(df, "o_orderpriority", "o_orderkey", F.first(F.lit("begin")), F.concat(F.count("*").cast("string"), F.lit(" records")))


@query("nation", """SELECT n_name AS name, 0 AS file_index, 'x' AS tag FROM nation UNION ALL SELECT r_name, 1, 'x' FROM region
    UNION ALL SELECT c_mktsegment, 2, 'y' FROM customer""")
def assigned_between_files(df, of):
    parts = [df.select(F.col("n_name").alias("name")), of("region").select(F.col("r_name").alias("name")), of("customer").select(F.col("c_mktsegment").alias("name"))]
    return records.assigned(folds.union_all(*parts), "file_index", [(2, "y"), (0, "x")], "tag")


@query("part", """SELECT p_partkey, '"' || p_name || '",' AS a, p_type || '"' AS b FROM part""")
def fields_csv_quotes(df, of):
    line = F.concat(F.lit('"""'), F.col("p_name"), F.lit('"",","'), F.col("p_type"), F.lit('"""'))
    parts = records.csv_fields(line)
    return df.select("p_partkey", *[records.field(parts, i).alias(n) for i, n in enumerate("ab", 1)])


@query("orders", "SELECT o_orderkey, o_orderstatus || ' ' || (o_custkey + 1) AS line FROM orders")
def field_increment(df, of):
    parts = records.fields(records.record_of(df, ["o_orderstatus", "o_custkey"]))
    return df.select("o_orderkey", records.joined(records.updated_field(parts, 2, lambda x: values.text(values.num(x) + 1))).alias("line"))


@query("events", """WITH p AS (SELECT event_id, event_type || CASE WHEN event_type = 'error' THEN chr(10) ELSE ',' END AS piece FROM events),
    q AS (SELECT *, coalesce(sum(CASE WHEN piece LIKE '%' || chr(10) THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_no FROM p)
    SELECT line_no::BIGINT AS line_no, replace(string_agg(piece, '' ORDER BY event_id), chr(10), '') AS line FROM q GROUP BY line_no""")
def printf_fragments(df, of):
    piece = F.concat("event_type", F.when(F.col("event_type") == "error", "\n").otherwise(","))
    return sinks.fragments(df.withColumn("piece", piece), "event_id", "piece")


@query("customer", "SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_name) AS nr FROM customer")
def record_number_by_text(df, of):
    return ordered.numbered(df, "c_name").select("c_custkey", "c_name", "nr")


# --- rows as text: the shapes that are timed

_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]


@query("lineitem", "SELECT count(*) AS n FROM lineitem WHERE concat_ws(' ', l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linestatus) LIKE '%99 R%'")
def lineitem_pattern(df, of):
    return df.where(strings.matches(records.record_of(df, _LINE), "99 R")).agg(F.count("*").alias("n"))


@query("lineitem", "SELECT l_orderkey, l_linenumber, l_returnflag || '-' || l_suppkey AS line FROM lineitem")
def lineitem_concat(df, of):
    return df.select("l_orderkey", "l_linenumber", F.concat_ws("-", "l_returnflag", F.col("l_suppkey").cast("string")).alias("line"))


@query("lineitem", """SELECT l_orderkey, l_linenumber, replace(concat_ws(' ', l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linestatus), 'alpha', 'ALPHA') AS line
    FROM lineitem""")
def lineitem_gsub(df, of):
    return df.select("l_orderkey", "l_linenumber", strings.gsub(records.record_of(df, _LINE), "alpha", "ALPHA").alias("line"))


# --- case, kinds, bytes

@query("part", """SELECT p_partkey, regexp_replace(p_name, 'RING', '<\\0>', 'gi') AS a, regexp_replace(p_name, 'I', '-', 'i') AS b,
    len(regexp_split_to_array(p_name, '[iI]')) AS n, coalesce(nullif(strpos(lower(p_name), 'in'), 0), 0) AS at,
    CASE WHEN lower(p_name) < lower(upper(p_type)) THEN 1 ELSE 0 END AS less FROM part""")
def ignore_case_functions(df, of):
    name = F.col("p_name")
    return df.select(
        "p_partkey", strings.gsub(name, "RING", "<&>", ignore_case=True).alias("a"), strings.sub(name, "I", "-", ignore_case=True).alias("b"),
        F.size(strings.pieces(name, "I", ignore_case=True)).cast("bigint").alias("n"), strings.match(name, "IN", ignore_case=True)["start"].alias("at"),
        maths.truth(values.compare(name, "<", F.upper("p_type"), "string", "string", ignore_case=True)).alias("less"),
    )


@query("part", """SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '^[0-9]+$') THEN 'strnum' ELSE 'string' END AS a, 'strnum' AS b FROM part""")
def kinds_of_fields(df, of):
    return df.select("p_partkey", values.kind_of(F.col("p_brand")).alias("a"), values.kind_of(F.concat(F.lit(" "), F.col("p_size").cast("string"))).alias("b"))


@query("documents", """SELECT doc_id, octet_length(encode(text)) AS bytes, CASE WHEN strpos(text, 'ch') = 0 THEN 0
    ELSE octet_length(encode(substr(text, 1, strpos(text, 'ch') - 1))) + 1 END AS at FROM documents WHERE text IS NOT NULL""")
def bytes_mode(df, of):
    t = F.col("text")
    return df.where("text is not null").select("doc_id", strings.byte_length(t).cast("bigint").alias("bytes"), strings.byte_index(t, "ch").cast("bigint").alias("at"))


@query("part", """SELECT p_partkey, list_aggregate(regexp_extract_all(p_name, '[aeiou]+'), 'string_agg', '|') AS seps,
    list_aggregate(regexp_extract_all(p_name, '[^aeiou]+'), 'string_agg', '|') AS fields FROM part""")
def split_with_separators(df, of):
    name = F.col("p_name")
    return df.select(
        "p_partkey", F.array_join(strings.separators(name, "[aeiou]+"), "|").alias("seps"), F.array_join(strings.found(name, "[^aeiou]+"), "|").alias("fields")
    )


@query("customer", """SELECT c_custkey, 1 AS s1, strpos(c_name, '#') - 1 AS l1, length(c_name) - length(regexp_extract(c_name, '#0*([0-9]+)', 1)) + 1 AS s2,
    length(regexp_extract(c_name, '#0*([0-9]+)', 1)) AS l2 FROM customer""")
def match_group_offsets(df, of):
    found = strings.match_offsets(F.col("c_name"), "([A-Za-z]+)#0*([0-9]+)", 2)
    return df.select("c_custkey", found.alias("m")).selectExpr("c_custkey", "m[1].start as s1", "m[1].length as l1", "m[2].start as s2", "m[2].length as l2")


@query("part", "SELECT p_partkey, regexp_replace(p_name, '^([^aeiou]*[aeiou][^aeiou]*)([aeiou])', '\\1<\\2>') AS second FROM part")
def str_gensub_second(df, of):
    return df.select("p_partkey", strings.gensub(F.col("p_name"), "[aeiou]", "<&>", 2).alias("second"))


@query("part", """SELECT p_partkey, p_size::DOUBLE AS a, p_size::DOUBLE AS b, CASE WHEN p_size % 10 < 8 AND p_size // 10 < 8 THEN (p_size // 10 * 8 + p_size % 10)::DOUBLE
    ELSE p_size::DOUBLE END AS c FROM part""")
def strtonum_bases(df, of):
    size = F.col("p_size")
    return df.select(
        "p_partkey", strings.strtonum(F.concat(F.lit("0x"), F.hex(size))).alias("a"), strings.strtonum(F.concat(size.cast("string"), F.lit(" parts"))).alias("b"),
        strings.strtonum(F.concat(F.lit("0"), size.cast("string"))).alias("c"),
    )


@query("part", """SELECT p_partkey, chr(65 + p_size % 26) || '|%|' || p_brand || ' ' || p_size AS line FROM part""")
def printf_positions(df, of):
    code = F.lit(65) + F.col("p_size") % 26
    return df.select("p_partkey", strings.formatted("%3$c|%%|%2$s %1$d", F.col("p_size"), F.col("p_brand"), code).alias("line"))


# --- numbers and times, second part

@query("events", """WITH RECURSIVE r(n, x) AS (SELECT 0::BIGINT, 1::BIGINT UNION ALL
    SELECT n + 1, (x * 1103515245 + 12345) % 2147483648 FROM r WHERE n < (SELECT count(*) FROM events))
    SELECT event_id, (x >> 16) / 32768.0::DOUBLE AS v FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events) JOIN r USING (n)""")
def random_sequence(df, of):
    return ordered.numbered(df, "event_id", "n").select("event_id", maths.random_at(F.col("n")).alias("v"))


@query("orders", "SELECT o_orderpriority, CAST(sum(o_orderkey::HUGEINT * o_orderkey * o_orderkey) AS VARCHAR) AS cubes FROM orders GROUP BY o_orderpriority")
def exact_decimals(df, of):
    key = maths.exact(F.col("o_orderkey"))
    cube = maths.exact(maths.exact(key * key) * key)
    return folds.fold(df, ["o_orderpriority"], cubes=F.sum(cube).cast("string"))


@query("orders", "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS at FROM orders")
def mktime_utc(df, of):
    return df.select("o_orderkey", times.mktime(F.date_format("o_orderdate", "yyyy MM dd HH mm ss"), utc=True).alias("at"))


# --- sorting, switch, joins, second part

@query("part", """WITH v AS (SELECT CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_size::VARCHAR END AS value FROM part)
    SELECT value, row_number() OVER (ORDER BY TRY_CAST(value AS DOUBLE) IS NULL, TRY_CAST(value AS DOUBLE), value) AS i FROM v""")
def asort_values(df, of):
    mixed = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string"))
    return folds.values_in_order(df.select(mixed.alias("value")))


@query("part", """SELECT CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_size::VARCHAR END AS key, count(*) AS value FROM part GROUP BY key""")
def sorted_by_type(df, of):
    mixed = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string"))
    return folds.sorted_by(folds.fold(df.withColumn("key", mixed), ["key"], value=F.count("*")), "ind_type_asc")


@query("part", "SELECT row_number() OVER (ORDER BY p_size % 5 DESC, p_size) AS i, p_size FROM (SELECT DISTINCT p_size FROM part)")
def sorted_by_comparator(df, of):
    def after(a, b):
        return F.when(a["p_size"] % 5 == b["p_size"] % 5, a["p_size"] - b["p_size"]).otherwise(b["p_size"] % 5 - a["p_size"] % 5)

    return folds.sorted_with(folds.distinct_values(df, ["p_size"]), after, ["p_size"])


@query("part", """SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '^Brand#1') THEN 'one,two' WHEN p_brand = 'Brand#22' THEN 'two' ELSE 'other' END AS ran,
    CASE WHEN regexp_matches(p_brand, '[13]$') OR p_brand = 'Brand#22' THEN 'odd' ELSE 'rest' END AS kind FROM part""")
def switch_patterns(df, of):
    brand = F.col("p_brand")
    ran = switch_bodies(brand, [(Like("^Brand#1"), F.lit("one"), False), ("Brand#22", F.lit("two"), True), (None, F.lit("other"), True)], default=2)
    kind = switch(brand, [([Like("[13]$"), "Brand#22"], F.lit("odd"))], F.lit("rest"))
    return df.select("p_partkey", F.array_join(ran, ",").alias("ran"), kind.alias("kind"))


@query("customer", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def join_anti_some(df, of):
    big = of("orders").where("o_totalprice > 400000").withColumnRenamed("o_custkey", "c_custkey")
    return lookups.dropped_keys(df, big, ["c_custkey"]).select("c_custkey")


@query("lineitem", """SELECT l_returnflag, l_linestatus, l_orderkey, n FROM lineitem JOIN (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem
    WHERE l_quantity > 49 GROUP BY ALL) USING (l_returnflag, l_linestatus)""")
def join_composite_key(df, of):
    keys = ["l_returnflag", "l_linestatus"]
    table = folds.fold(df.where("l_quantity > 49"), keys, n=F.count("*"))
    return lookups.lookup(df, table, keys).select(*keys, "l_orderkey", "n")


@query("customer", """SELECT c_custkey, coalesce(n_name, c_mktsegment) AS shown FROM customer LEFT JOIN nation ON c_mktsegment = upper(n_name) OR
    (c_mktsegment = 'MACHINERY' AND n_nationkey = 3)""")
def translated_messages(df, of):
    entries = of("nation").select(F.when(F.col("n_nationkey") == 3, "MACHINERY").otherwise(F.upper("n_name")).alias("msgid"), F.col("n_name").alias("msgstr"))
    return lookups.translated(df, "c_mktsegment", entries, "shown").select("c_custkey", "shown")
