"""The operators as registered queries over the given tables, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions import classify, html, parse, text
from specloom.operators import components, firsts, issues, records, reviews, specs, translate
from specloom.plans import report
from specloom.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder by name, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def registered(sql: str | None = None) -> Callable:
    def add(make: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[make.__name__] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql:
            SQL[make.__name__] = sql
        return make

    return add


YEARS = list(range(1995, 2002))


@registered(
    "SELECT n_name, "
    + ", ".join(f'count(*) FILTER (WHERE year(o_orderdate) = {y}) AS "{y}"' for y in YEARS)
    + ", count(o_orderkey) AS total FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name"
)
def coverage_matrix(t: Tables) -> DataFrame:
    """Orders by nation and year; nations without any have zeros."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("n_name", F.year("o_orderdate").alias("year"))
    return report.coverage(rows, "n_name", "year", YEARS, t.nation.select(F.col("n_name").alias("name")).distinct())


@registered("""
    SELECT p_brand, p_size, l_returnflag, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high,
           CASE WHEN count(*) = 1 THEN 'one' WHEN min(l_extendedprice) = max(l_extendedprice) THEN 'same' ELSE 'range' END AS shape
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, p_size, l_returnflag""")
def config_groups(t: Tables) -> DataFrame:
    """Groups by an eight-part key's analogue with the range of a value and its shape."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    out = rows.groupBy("p_brand", "p_size", "l_returnflag").agg(F.count("*").alias("n"), specs.value_range("l_extendedprice").alias("r"))
    shape = F.when(F.col("n") == 1, "one").when(F.col("r.min") == F.col("r.max"), "same").otherwise("range")
    return out.select("p_brand", "p_size", "l_returnflag", "n", F.col("r.min").alias("low"), F.col("r.max").alias("high"), shape.alias("shape"))


@registered("""
    SELECT p_brand, p_type, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS numbers, min(p_size) AS low, max(p_size) AS high
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, p_type""")
def spec_value_sets(t: Tables) -> DataFrame:
    """The distinct values that the members of a component show, sorted."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("p_brand", "p_type").agg(F.array_join(firsts.distinct_sorted(F.col("l_linenumber").cast("string")), ",").alias("numbers"), F.min("p_size").alias("low"), F.max("p_size").alias("high"))


@registered("""
    SELECT l_partkey AS id, string_agg(s, ',' ORDER BY s) AS used_in, count(*) AS n
    FROM (SELECT DISTINCT l_partkey, 'supplier_' || lpad(l_suppkey::VARCHAR, 8, '0') AS s FROM lineitem) GROUP BY l_partkey""")
def used_in_index(t: Tables) -> DataFrame:
    """The suppliers that use each part: the reverse of records' component maps."""
    slug = F.concat(F.lit("supplier_"), F.lpad(F.col("l_suppkey").cast("string"), 8, "0"))
    linked = t.lineitem.select(slug.alias("slug"), F.lit("part").alias("kind"), F.col("l_partkey").alias("id"))
    return components.used_in(linked).select("id", F.array_join("used_in", ",").alias("used_in"), F.size("used_in").cast("long").alias("n"))


PRIORITY = {"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"}


@registered("""
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS label FROM orders""")
def dict_map_default(t: Tables) -> DataFrame:
    """A dictionary whose missing entries pass through."""
    return t.orders.select("o_orderkey", classify.looked_up(F.col("o_orderpriority"), PRIORITY).alias("label"))


@registered("""
    SELECT p_partkey, CASE WHEN contains(x, 'red') THEN 'R' WHEN contains(x, 'LARGE') THEN 'L' WHEN contains(x, 'bolt') THEN 'B' WHEN contains(x, 'SMALL') THEN 'S' ELSE x END AS kind
    FROM (SELECT p_partkey, p_type || ' ' || p_name AS x FROM part)""")
def enum_first_match(t: Tables) -> DataFrame:
    """Ordered rules by substring: the first that fits wins, else the text itself."""
    named = F.concat_ws(" ", "p_type", "p_name")
    return t.part.select("p_partkey", classify.first_containing(named, (("red", "R"), ("LARGE", "L"), ("bolt", "B"), ("SMALL", "S"))).alias("kind"))


@registered("""
    SELECT p_partkey, p_size / 10.0::DOUBLE AS engine_l, CASE WHEN p_size % 3 = 0 THEN p_retailprice END AS battery_kwh,
           CASE WHEN p_size % 2 = 0 THEN p_size * 7 END AS hp, p_name AS fuel FROM part""")
def composite_split(t: Tables) -> DataFrame:
    """Texts of parts with units, put together and taken apart again."""
    made = F.concat_ws(
        " / ", F.concat((F.col("p_size") / 10).cast("string"), F.lit(" L")), F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit(" kwh"))),
        F.when(F.col("p_size") % 2 == 0, F.concat((F.col("p_size") * 7).cast("string"), F.lit(" a.g."))), F.lit("gone"), F.col("p_name"),
    )
    return t.part.select("p_partkey", parse.composite(made).alias("c")).select("p_partkey", "c.engine_l", "c.battery_kwh", "c.hp", "c.fuel")


@registered("""
    SELECT p_partkey, CAST(nullif(regexp_extract(p_brand, '-?\\d+(\\.\\d+)?', 0), '') AS DOUBLE) AS brand_number,
           CAST(nullif(regexp_extract(p_name, '-?\\d+(\\.\\d+)?', 0), '') AS DOUBLE) AS name_number,
           CAST(regexp_replace(p_brand, '\\D', '', 'g') AS INTEGER) AS digits FROM part""")
def first_number(t: Tables) -> DataFrame:
    """The first number of a text; null where there is none."""
    return t.part.select("p_partkey", parse.first_number(F.col("p_brand")).alias("brand_number"), parse.first_number(F.col("p_name")).alias("name_number"), parse.digits_only(F.col("p_brand")).alias("digits"))


@registered("SELECT p_partkey, CAST(round_even(p_size::DOUBLE * 1.35962::DOUBLE, 0) AS INTEGER) AS hp, CASE WHEN p_size > 26 THEN CAST(round_even((p_size - 26)::DOUBLE * 1.35962::DOUBLE, 0) AS INTEGER) END AS none FROM part")
def hp_convert(t: Tables) -> DataFrame:
    """Kilowatts to metric horsepower, halves to even; zero and null give null."""
    return t.part.select("p_partkey", parse.metric_hp(F.col("p_size")).alias("hp"), parse.metric_hp(F.greatest(F.col("p_size") - 26, F.when(F.col("p_size") > 25, F.lit(0)))).alias("raw"), "p_size").select(
        "p_partkey", "hp", F.when(F.col("p_size") > 25, F.col("raw")).alias("none")
    )


@registered("""
    SELECT o_orderkey, amount, currency, azn, coalesce(azn <= 44000, false) AS under_budget FROM (
      SELECT o_orderkey, currency, amount, CAST(round_even(amount::DOUBLE * CASE currency WHEN 'USD' THEN 1.70::DOUBLE WHEN 'EUR' THEN 1.95::DOUBLE ELSE 1.0::DOUBLE END, 0) AS INTEGER) AS azn
      FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice / 10) AS INTEGER) WHEN o_orderkey % 2 = 0 THEN 0 END AS amount, CASE o_orderstatus WHEN 'F' THEN 'USD' WHEN 'O' THEN 'EUR' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'AZN' END END AS currency FROM orders))""")
def price_convert_flag(t: Tables) -> DataFrame:
    """Prices out of titles, else out of pages, in one currency, and whether they fit the budget; zero is a price."""
    shown = F.replace(F.format_number(F.floor(F.col("o_totalprice") / 10), 0), F.lit(","), F.lit(" "))
    title = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Model 7, qiyməti  "), shown, F.lit(" usd, 5 000 AZN"))).when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 2 == 0), F.lit("Qiyməti 0 AZN"))
    body = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("year 12 costs "), shown, F.lit(" € or 999 999 ₼"))).otherwise("12$")
    rows = t.orders.select("o_orderkey", parse.price(title, body).alias("p")).select("o_orderkey", "p.*")
    azn = parse.to_azn(F.col("amount"), F.col("currency"))
    return rows.select("o_orderkey", "amount", "currency", azn.alias("azn"), parse.under_budget(azn).alias("under_budget"))


@registered("""
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN CAST(floor(o_totalprice) AS BIGINT) + o_custkey * 10000 WHEN 'O' THEN nullif(o_custkey % 100, 0) + 12000 END AS units FROM orders""")
def units_sum_in_text(t: Tables) -> DataFrame:
    """The sum of all counts of units in a text, ten-thousands multiplied out; none gives null."""
    first = F.concat(F.lit("召回车辆共计 约 "), F.format_number(F.floor("o_totalprice"), 0), F.lit(" 余 辆，其中涉及"), F.col("o_custkey").cast("string"), F.lit(" 万 余 台，2019 年起。"))
    other = F.concat(F.lit("涉及车辆"), F.nullif(F.col("o_custkey") % 100, F.lit(0)).cast("string"), F.lit("辆 合计约1.2万辆 共....辆"))
    text_of = F.when(F.col("o_orderstatus") == "F", first).when(F.col("o_orderstatus") == "O", other).otherwise("共 5 人")
    return t.orders.select("o_orderkey", parse.units_sum(text_of).alias("units"))


WORDS = {"thea": "alpha", "ound": "beta", "tion": "gamma", "eau": "delta", "schaft": "epsilon", "ción": "zeta"}


@registered(
    "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(["
    + ", ".join(f"CASE WHEN contains(x, '{k}') THEN '{v}' END" for k, v in WORDS.items())
    + "], lambda v: v IS NOT NULL))), ',') AS brands, CASE WHEN contains(text, 'the') AND contains(text, 'que') THEN 'both' WHEN contains(text, 'the') THEN 'import' "
    "WHEN contains(text, 'que') THEN 'domestic' ELSE 'unknown' END AS origin FROM (SELECT *, replace(replace(text, 'the', ''), 'er', '') AS x FROM documents)"
)
def brand_contains_classify(t: Tables) -> DataFrame:
    """Names whose key a text holds once some prefixes are taken out; origin by two words."""
    body = classify.without(F.col("text"), ("the", "er"))
    return t.documents.select("doc_id", F.array_join(classify.contained(body, WORDS), ",").alias("brands"), classify.origin(F.col("text"), "the", "que").alias("origin"))


@registered("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_wins_dedup(t: Tables) -> DataFrame:
    """The first event of each user and type."""
    return firsts.first_rows(t.events, ["user_id", "event_type"], ["ts", "event_id"])


@registered("""
    SELECT l_partkey, l_suppkey, min(side) AS side, min(l_orderkey * 10 + l_linenumber) AS pos FROM (
      SELECT 0 AS side, * FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 1 AS side, * FROM lineitem WHERE l_returnflag <> 'R' AND (l_partkey, l_suppkey) NOT IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_returnflag = 'R'))
    GROUP BY l_partkey, l_suppkey""")
def anti_append(t: Tables) -> DataFrame:
    """Returned items first, then those of others whose part and supplier are new."""
    rows = t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    first, second = rows.where("l_returnflag = 'R'").withColumn("side", F.lit(0)), rows.where("l_returnflag <> 'R'").withColumn("side", F.lit(1))
    return firsts.appended_unseen(first, second, ["l_partkey", "l_suppkey"]).select("l_partkey", "l_suppkey", "side", "pos")


@registered("""
    SELECT c.c_custkey, c.c_name, coalesce(o.c_acctbal, c.c_acctbal) AS c_acctbal, coalesce(o.c_mktsegment, c.c_mktsegment) AS c_mktsegment
    FROM customer c LEFT JOIN customer o ON c.c_custkey % 5 = 0 AND o.c_custkey = c.c_custkey // 5""")
def copy_sync(t: Tables) -> DataFrame:
    """Customers that are copies take balance and segment from their origin."""
    rows = t.customer.withColumn("copy_of", F.when(F.col("c_custkey") % 5 == 0, F.floor(F.col("c_custkey") / 5)))
    return records.synced_copies(rows, "c_custkey", "copy_of", ["c_acctbal", "c_mktsegment"]).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@registered("""
    SELECT o_orderkey, arg_min(p_name, l_linenumber * 100000000 + l_partkey) AS name FROM orders LEFT JOIN (SELECT * FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 40) ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def best_match_by_position(t: Tables) -> DataFrame:
    """Of each order's parts in line order, the first that the large parts know."""
    lines = t.lineitem.groupBy("l_orderkey").agg(firsts.in_order("l_linenumber", "l_partkey").alias("x"))
    groups = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.transform("x", lambda x: x["l_partkey"]).alias("ids"))
    known = t.part.where("p_size > 40").select(F.col("p_partkey").alias("p"), F.col("p_name").alias("name"))
    return records.by_first_match(groups, "ids", known, "p", ["o_orderkey"], ["name"]).select("o_orderkey", "name")


@registered("""
    SELECT e.event_id, n.n_nationkey AS k, y.year FROM events e JOIN nation n ON e.event_id % 25 = n.n_nationkey JOIN (SELECT unnest(range(2018, 2027)) AS year) y
    ON CASE WHEN e.event_id % 11 = 0 THEN y.year % 2 = n.n_nationkey % 2 ELSE y.year BETWEEN 2018 + e.event_id % 5 AND 2018 + e.event_id % 5 + e.event_id % 3 OR y.year = 2020 + e.user_id % 7 END""")
def year_range_bind(t: Tables) -> DataFrame:
    """Reports whose car text names years and ranges of years, bound to the configurations of these years."""
    a = 2018 + F.col("event_id") % 5
    car = F.concat(F.lit("car "), a.cast("string"), F.lit(" – "), (a + F.col("event_id") % 3).cast("string"), F.lit(" or "), (2020 + F.col("user_id") % 7).cast("string"))
    rows = t.events.select((F.col("event_id") % 25).alias("key"), F.col("event_id").alias("pos"), car.alias("review_car"))
    groups = t.nation.select(F.col("n_nationkey").cast("long").alias("key"), F.explode(F.sequence(F.lit(2018), F.lit(2026))).alias("year"))
    rule = F.when(F.col("pos") % 11 == 0, F.col("year") % 2 == F.col("key") % 2)
    return issues.bound(rows, groups, rule).select(F.col("pos").alias("event_id"), F.col("key").cast("int").alias("k"), F.col("year").cast("long").alias("year"))


@registered("""
    WITH own AS (SELECT o_orderkey AS slug, o_orderstatus || '-' || o_orderpriority AS text, 'src' || (o_orderkey % 3) AS source, 0 AS rank, 0 AS pos, CAST(NULL AS VARCHAR) AS component, 'модель' AS origin, true AS own_model FROM orders),
         links AS (SELECT DISTINCT l_orderkey AS slug, o_orderstatus AS model, 'p' || (l_partkey % 20) AS id, 1 AS rank, 'двигатель' AS label FROM lineitem JOIN orders ON o_orderkey = l_orderkey
                   UNION SELECT DISTINCT l_orderkey, o_orderstatus, 's' || (l_suppkey % 10), 2, 'коробка' FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
         shared AS (SELECT 'p' || n AS id, 0 AS pos, 'part issue ' || (n % 7) AS text, 'src' || (n % 3) AS source, ['F', 'P'] AS reported FROM range(20) t(n)
                    UNION ALL SELECT 's' || n, 0, 'part issue ' || (n % 4), 'src' || (n % 3), CAST([] AS VARCHAR[]) FROM range(10) t(n)),
         every AS (SELECT slug, text, source, rank, pos, component, origin, own_model FROM own UNION ALL
                   SELECT l.slug, s.text, s.source, l.rank, s.pos, l.id, l.label || ' ' || upper(l.id) || ', отзыв по ' || coalesce(nullif(array_to_string(reported, ', '), ''), 'неизвестно') || CASE WHEN list_contains(reported, l.model) THEN ' (эта модель)' ELSE '' END, list_contains(reported, l.model)
                   FROM links l JOIN shared s USING (id))
    SELECT slug, source, text, arg_min(origin, (rank, pos, component)) AS origin, min(rank) AS rank, arg_min(own_model, (rank, pos, component)) AS own_model FROM every GROUP BY slug, source, text""")
def issue_inheritance(t: Tables) -> DataFrame:
    """Orders as records: their own issue, then those of their parts and suppliers that are new to them, with provenance."""
    own = t.orders.select(F.col("o_orderkey").alias("slug"), F.col("o_orderstatus").alias("model"), F.lit(0).alias("pos"), F.concat_ws("-", "o_orderstatus", "o_orderpriority").alias("text"), F.concat(F.lit("src"), F.col("o_orderkey") % 3).alias("source"))
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    link = lambda kind, letter, key, n: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(letter), (F.col(key) % n)).alias("id"))
    linked = lines.select(F.col("l_orderkey").alias("slug"), F.col("o_orderstatus").alias("model"), F.inline(F.array(link("engine", "p", "l_partkey", 20), link("transmission", "s", "l_suppkey", 10))))
    parts = t.part.select((F.col("p_partkey") % 20).alias("n")).distinct().select(F.lit("engine").alias("kind"), F.concat(F.lit("p"), "n").alias("id"), F.concat(F.lit("part issue "), F.col("n") % 7).alias("text"), F.concat(F.lit("src"), F.col("n") % 3).alias("source"), F.array(F.lit("F"), F.lit("P")).alias("reported_in"))
    sellers = t.lineitem.select((F.col("l_suppkey") % 10).alias("n")).distinct().select(F.lit("transmission").alias("kind"), F.concat(F.lit("s"), "n").alias("id"), F.concat(F.lit("part issue "), F.col("n") % 4).alias("text"), F.concat(F.lit("src"), F.col("n") % 3).alias("source"), F.array().cast("array<string>").alias("reported_in"))
    shared = parts.union(sellers)
    # Within one kind the component's id breaks ties, so it stands in the position.
    shared = shared.withColumn("pos", F.struct(F.lit(0).alias("n"), F.col("id").alias("id")))
    own = own.withColumn("pos", F.struct(F.col("pos").alias("n"), F.lit("").alias("id")))
    labels = shared.select("kind", "id", F.upper("id").alias("label")).distinct()
    return issues.inherited(own, linked, shared, labels).select("slug", "source", "text", "origin", "rank", "own_model")


@registered("""
    SELECT event_type, source, text, arg_min(car, event_id) AS review_car, count(DISTINCT model) AS models,
           array_to_string(list_sort(list_filter(list_distinct(flatten(list(more))), lambda m: m <> source)), ',') AS more
    FROM (SELECT *, 'src' || (user_id % 4) AS source, 'text ' || (event_id % 6) AS text, CASE WHEN event_id % 4 > 0 THEN 'car ' || event_id END AS car, 'model ' || (user_id % 9) AS model,
                 ['src' || (event_id % 5), 'src' || (user_id % 6)] AS more FROM events) GROUP BY event_type, source, text""")
def issue_consolidate(t: Tables) -> DataFrame:
    """Reports of one issue as one row: first car, all models, all other sources."""
    rows = t.events.select(
        F.lit("engine").alias("scope"), F.col("event_type").alias("component"), F.concat(F.lit("src"), F.col("user_id") % 4).alias("source"), F.concat(F.lit("text "), F.col("event_id") % 6).alias("text"),
        F.col("event_id").alias("pos"), F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("car "), "event_id")).alias("review_car"), F.concat(F.lit("model "), F.col("user_id") % 9).alias("model"),
        F.array(F.concat(F.lit("src"), F.col("event_id") % 5), F.concat(F.lit("src"), F.col("user_id") % 6)).alias("more_sources"),
    )
    out = issues.consolidated(rows.withColumn("pos", F.when(F.col("review_car").isNull(), F.col("pos") + (1 << 40)).otherwise(F.col("pos"))))
    return out.select(F.col("component").alias("event_type"), "source", "text", "review_car", F.size("reported_in").cast("long").alias("models"), F.array_join(F.sort_array(F.coalesce("more_sources", F.array().cast("array<string>"))), ",").alias("more"))


@registered("""
    SELECT o_orderkey, CASE WHEN count(l_orderkey) FILTER (WHERE l_returnflag = 'R') > 0 AND count(l_orderkey) FILTER (WHERE l_linestatus = 'F') > 0 AND o_totalprice > 50000 THEN 'verified' ELSE 'partial' END AS verification
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice""")
def verification_rule(t: Tables) -> DataFrame:
    """Records are verified if every core field is known."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.max(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("a"), F.max(F.when(F.col("l_linestatus") == "F", F.col("l_partkey"))).alias("b"))
    rows = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", records.verification(F.col("a"), F.col("b"), F.when(F.col("o_totalprice") > 50000, F.lit(1))).alias("verification"))


@registered("""
    SELECT c_custkey, coalesce(s_name, c_name) AS name, c_acctbal AS balance,
           CASE WHEN s_suppkey IS NULL THEN 'a=new' ELSE 'a=old' END || ';b=' || c_nationkey AS sources
    FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def merge_precedence(t: Tables) -> DataFrame:
    """New records over old ones: the name and entries of the map are the old ones' where they have any."""
    new = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.create_map(F.lit("a"), F.lit("new"), F.lit("b"), F.col("c_nationkey").cast("string")).alias("sources"))
    old = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.create_map(F.lit("a"), F.lit("old")).alias("sources"))
    merged = records.merged(new, old, ["k"], ["name"], ["sources"])
    keys = lambda c: F.try_element_at(F.col("sources"), F.lit(c))
    return merged.select(F.col("k").alias("c_custkey"), "name", "balance", F.concat(F.lit("a="), keys("a"), F.lit(";b="), keys("b")).alias("sources"))


@registered("SELECT DISTINCT source, lang FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT source, lang FROM documents WHERE doc_id % 2 = 1 AND n_chars > 1500")
def regression_gate(t: Tables) -> DataFrame:
    """What a run would lose: keys of before that after lacks."""
    return report.lost(t.documents.where("doc_id % 2 = 0"), t.documents.where("doc_id % 2 = 1 and n_chars > 1500"), ["source", "lang"])


@registered("""
    SELECT event_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value, CASE WHEN event_type = 'error' THEN 'HTTP ' || event_id % 600 END AS error FROM events""")
def union_ok_failed(t: Tables) -> DataFrame:
    """Good rows and failed ones, which have other columns, as one table."""
    ok = t.events.where("event_type <> 'error'").select("event_id", "event_type", "value")
    failed = t.events.where("event_type = 'error'").select("event_id", "event_type", F.concat(F.lit("HTTP "), F.col("event_id") % 600).alias("error"))
    return firsts.with_failures(ok, failed)


@registered("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) <= 2")
def topn_per_group(t: Tables) -> DataFrame:
    """The two largest events of each user and type."""
    return firsts.first_rows(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.desc("value"), "event_id"], 2)


@registered("SELECT event_type, CAST(props->>'$.k' AS INTEGER) % 4 AS path, max(event_id) AS last, count(*) AS n FROM events GROUP BY 1, 2")
def json_path_flatten(t: Tables) -> DataFrame:
    """Values out of nested JSON, put under their paths."""
    node = F.parse_json("props")
    rows = t.events.select("event_type", "event_id", (F.variant_get(node, "$.k", "int") % 4).alias("path"))
    return rows.groupBy("event_type", "path").agg(F.max("event_id").alias("last"), F.count("*").alias("n"))


@registered("""
    SELECT c_custkey, 'cust/' || c_mktsegment AS path, c_acctbal::VARCHAR AS value FROM customer UNION ALL
    SELECT c_custkey, 'cust/' || c_mktsegment || '>nation', c_nationkey::VARCHAR FROM customer UNION ALL
    SELECT c_custkey, 'cust/nation>deep', c_name FROM customer""")
def recursive_tree(t: Tables) -> DataFrame:
    """Nested configuration trees walked to rows of path and value; a path holds the name right above only."""
    leaf = lambda name, value, *kids: F.struct(F.lit(name).alias("name") if isinstance(name, str) else name.alias("name"), value.alias("value"), F.array(*kids).alias("child_config_list"))
    deep = F.struct(F.lit("deep").alias("name"), F.col("c_name").alias("value"))
    nation = leaf("nation", F.col("c_nationkey").cast("string"), deep)
    item = leaf(F.col("c_mktsegment"), F.col("c_acctbal").cast("string"), nation)
    kept = F.struct(F.lit("customer").alias("category_name"), F.array(item).alias("config_list"))
    skipped = F.struct(F.lit("other stuff").alias("category_name"), F.array(leaf("none", F.lit("x"), nation)).alias("config_list"))
    trims = t.customer.select(F.col("c_custkey").alias("trim_id"), F.parse_json(F.to_json(F.struct(F.array(F.to_json(kept)).alias("x")))).alias("y"), F.to_json(kept).alias("a"), F.to_json(skipped).alias("b"))
    trims = trims.select("trim_id", F.parse_json(F.concat(F.lit('{"config":['), "a", F.lit(","), "b", F.lit("]}"))).alias("tree"))
    return specs.flattened(trims.sparkSession, trims, skip=["stuff"]).select(F.col("trim_id").alias("c_custkey"), "path", "value")


@registered("SELECT sha256(trim(regexp_replace(text, '[\\s\\x0B\\x1c-\\x1f\\x85\\p{Z}]+', ' ', 'g'))) AS key, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1")
def text_key(t: Tables) -> DataFrame:
    """Texts by the hash of their collapsed form."""
    return t.documents.groupBy(text.text_key(F.col("text")).alias("key")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))


PHRASES = (("the", "le"), ("tion of", "tion de"), ("and", "et"), ("ation", "aison"))


@registered("SELECT doc_id, md5(replace(replace(replace(replace(text, 'tion of', 'tion de'), 'ation', 'aison'), 'the', 'le'), 'and', 'et')) AS folded FROM documents")
def fold_translate(t: Tables) -> DataFrame:
    """Literal fragments put in, the longer first."""
    return t.documents.select("doc_id", F.md5(text.replaced(F.col("text"), PHRASES)).alias("folded"))


@registered("""
    SELECT doc_id, CASE WHEN trim(b) = '' THEN 'empty' ELSE '' END || CASE WHEN list_sort(regexp_extract_all(a, '\\d+')) <> list_sort(regexp_extract_all(b, '\\d+')) THEN 'numbers' ELSE '' END
           || CASE WHEN contains(a, 'that') AND NOT contains(b, 'that') THEN 'term that' ELSE '' END AS problems
    FROM (SELECT doc_id, regexp_replace(text, '[^a-z0-9 ]', ' ', 'g') AS a, replace(replace(regexp_replace(text, '[^a-z0-9 ]', ' ', 'g'), '3', '4'), 'that t', 'tha t') AS b FROM documents)""")
def translation_qa(t: Tables) -> DataFrame:
    """What a translation lost: numbers, protected terms, everything."""
    plain = F.regexp_replace("text", "[^a-z0-9 ]", " ")
    rows = t.documents.select("doc_id", plain.alias("a"), F.replace(F.replace(plain, F.lit("3"), F.lit("4")), F.lit("that t"), F.lit("tha t")).alias("b"))
    return rows.select("doc_id", F.array_join(text.problems(F.col("a"), F.col("b"), ("that",)), "").alias("problems"))


_DECODED = "nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '&(lt|LT);?', '<', 'g'), '&(gt|GT);?', '>', 'g'), '&(quot|QUOT);?', '\"', 'g'), '&(amp|AMP);?', '&', 'g'), '\\s+', ' ', 'g')), '')"


# As in HTML, these references count without their semicolon too.
@registered(f"SELECT page_id, {_DECODED.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title, {_DECODED.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS h1, len(regexp_extract_all(html, '<a href')) AS links FROM pages")
def html_extract(t: Tables) -> DataFrame:
    """Title, heading and links of pages."""
    rows = t.pages.select("page_id", html.page_fields(F.col("html")).alias("f"))
    return rows.select("page_id", "f.title", "f.h1", F.size("f.links").cast("long").alias("links"))


CATEGORIES = {"a noise": "[a-z]*ound[a-z]*", "b cold": "the [a-z]{9,}", "c road": "que [a-z]+"}
NEGATION = "not|pas"
_MATCHES = " UNION ALL ".join(f"SELECT doc_id, text, '{k}' AS category, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS p FROM documents WHERE text IS NOT NULL" for k, p in CATEGORIES.items())


@registered(f"""
    WITH found AS ({_MATCHES}),
         places AS (SELECT doc_id, category, text, list_transform(range(1, len(m) + 1), lambda i: {{'at': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'n': length(m[i])}}) AS w FROM found WHERE len(m) > 0),
         windows AS (SELECT doc_id, category, list_transform(w, lambda x: [substr(text, CAST(greatest(x.at - 45, 0) + 1 AS BIGINT), CAST(x.at + x.n + 45 - greatest(x.at - 45, 0) AS BIGINT))]) AS w FROM places),
         kept AS (SELECT doc_id, category, list_reduce(w, lambda k, x: CASE WHEN regexp_matches(x[1], '{NEGATION}') OR len(list_filter(k, lambda y: contains(y, x[1][21:60]))) > 0 THEN k ELSE list_concat(k, x) END, CAST([] AS VARCHAR[])) AS k FROM windows)
    SELECT doc_id, category, CAST(i - 1 AS INTEGER) AS place, k[i] AS snippet FROM kept, unnest(range(1, least(len(k), 2) + 1)) u(i)""")
def review_categories(t: Tables) -> DataFrame:
    """Complaints by category with the letters around them, without negated and repeated ones: two to a review."""
    found = reviews.complaints(t.documents, "doc_id", "text", CATEGORIES, negation=NEGATION)
    return reviews.top_snippets(found, "doc_id")


@registered("""
    SELECT conv_id, turn, role, length(text) AS n, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations""")
def text_blocks(t: Tables) -> DataFrame:
    """Turns written as delimited blocks and read back as columns."""
    rows = t.conversations
    block = F.concat(F.lit("== "), F.col("conv_id").cast("string"), F.lit(" | "), "role", F.lit(" | post "), F.col("turn").cast("string"), F.lit(" | own 1 | 2\n  [text] "), F.replace("text", F.lit("\n"), F.lit(" ")))
    back = reviews.blocks(rows.select(block.alias("value")))
    cells = back.select(F.col("url").cast("long").alias("conv_id"), F.col("posted").cast("long").alias("turn"), F.col("spec").alias("role"), F.length(F.col("sections")[0]["text"]).cast("long").alias("n"))
    return cells.withColumn("turns", F.expr("count(*) over (partition by conv_id)"))


@registered("""
    SELECT c_name AS name, coalesce(string_agg(p, '/' ORDER BY first), '') AS hp, CASE WHEN min(low) = max(high) THEN min(low)::VARCHAR ELSE min(low)::VARCHAR || '-' || max(high)::VARCHAR END AS range,
           sum(n)::INTEGER AS issues, CASE WHEN sum(n) > 0 THEN 'ДА' ELSE '' END AS has_issues
    FROM (SELECT c_name, c_custkey, substr(o_orderpriority, 1, 1) AS p, min(o_orderkey) AS first, min(year(o_orderdate)) AS low, max(year(o_orderdate)) AS high, count(*) FILTER (WHERE o_orderstatus = 'F') AS n
          FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL) GROUP BY c_name, c_custkey""")
def index_report(t: Tables) -> DataFrame:
    """Index rows: distinct values in order, a range, counts and flags."""
    rows = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"))
    by = rows.groupBy("c_custkey", "c_name").agg(
        firsts.in_order("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("p")).alias("x"), F.min(F.year("o_orderdate")).alias("low"), F.max(F.year("o_orderdate")).alias("high"), F.collect_list(F.when(F.col("o_orderstatus") == "F", F.lit("x"))).alias("issues"),
    )
    return by.select(*report.index_row(F.transform("x", lambda x: x["p"]), F.col("low"), F.col("high"), F.col("issues"), F.col("c_name")))


@registered("""
    SELECT p_partkey, lower(replace(p_type, ' ', '')) || '_' || (2000 + p_size) || '_' || array_to_string(list_filter([CASE WHEN p_size % 3 = 0 THEN p_size || 'kwh' END, CASE WHEN p_size % 2 = 0 THEN p_size * 5 || 'kw' END,
           CASE WHEN p_size % 3 <> 0 THEN lower(replace(p_brand, ' ', '')) END, CASE WHEN p_size % 3 <> 0 AND p_size % 2 <> 0 THEN CASE WHEN contains(p_name, 'red') THEN '6at' ELSE 'gb' END END, CASE WHEN contains(p_name, 'bolt') THEN 'awd' END], lambda v: v IS NOT NULL), '-') AS slug FROM part""")
def slugs(t: Tables) -> DataFrame:
    """Names of configurations from the parts that tell them apart."""
    text_of = lambda c: c.cast("string")
    size = F.col("p_size")
    gearbox = classify.gearbox_slug(F.when(F.col("p_name").contains("red"), F.lit("6挡自动")).otherwise(F.lit("其他")))
    made = specs.slug(F.lower(F.replace("p_type", F.lit(" "), F.lit(""))), 2000 + size, F.when(size % 3 == 0, text_of(size)), F.when(size % 2 == 0, text_of(size * 5)), F.col("p_brand"), gearbox, F.when(F.col("p_name").contains("bolt"), F.lit("四驱")).otherwise(""))
    return t.part.select("p_partkey", made.alias("slug"))


@registered("""
    SELECT p_partkey, lower(p_type) || '_' || replace(lower(p_brand), ' ', '') || coalesce('_' || CASE WHEN p_size > 10 THEN printf('%.1f', p_size * 100 / 1000.0) WHEN regexp_matches(p_brand, '472|473|469|15') THEN '1.5' WHEN regexp_matches(p_brand, '486|484|20') THEN '2.0' END || CASE WHEN contains(p_name, 'red') THEN 't' ELSE '' END, '') AS engine_id,
           CASE WHEN p_size % 5 > 0 AND contains(p_name, 'bolt') THEN lower(p_type) || '_phev_' || lower(p_brand) || '_m' || p_size % 5 || CASE WHEN p_size % 4 > 0 THEN '-' || p_size % 4 ELSE '' END END AS fingerprint
    FROM part""")
def component_ids(t: Tables) -> DataFrame:
    """Engine ids and hybrid fingerprints; the latter only where every part is known."""
    rows = t.part
    kw = F.array(F.col("p_size") % 5, F.col("p_size") % 4)
    cc, code = F.when(F.col("p_size") > 10, F.col("p_size") * 100), F.lower("p_brand")
    gearbox = F.when(F.col("p_name").contains("bolt"), F.lit("E-CVT"))
    print_id = components.fingerprint(F.lower("p_type"), F.lit("PHEV_series_parallel"), code, F.when(F.col("p_size") % 5 > 0, kw), gearbox)
    return rows.select("p_partkey", components.engine_id(F.lower("p_type"), F.col("p_brand"), cc, F.when(F.col("p_name").contains("red"), "turbo")).alias("engine_id"), print_id.alias("fingerprint"))


@registered("""
    SELECT CASE WHEN s.k IS NULL THEN c.c_nationkey ELSE s.k END AS k, CASE WHEN c.c_nationkey IS NULL THEN s.name ELSE c.name END AS name, coalesce(s.issues, c.issues) AS issues,
           'a=' || CASE WHEN c.name IS NULL THEN 'old' ELSE c.name END || coalesce(';b=' || s.name, '') AS sources
    FROM (SELECT c_nationkey, min(c_name) AS name, count(*) AS issues FROM customer WHERE c_nationkey < 15 GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, min(s_name) AS name, count(*) AS issues FROM supplier WHERE s_nationkey > 5 GROUP BY 1) s ON s.k = c.c_nationkey""")
def component_upsert(t: Tables) -> DataFrame:
    """Rebuilt components over old ones: what is kept stays, components without users are untouched."""
    new = t.customer.where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_name").alias("name"), F.count("*").alias("issues"))
    old = t.supplier.where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_name").alias("name"), F.count("*").alias("issues"))
    new = new.withColumn("sources", F.create_map(F.lit("a"), "name"))
    old = old.withColumn("sources", F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.col("name")))
    out = components.upserted(old, new, ["k"], ["issues"], ["sources"])
    return out.withColumn("sources", F.array_join(F.transform(F.array_sort(F.map_keys("sources")), lambda k: F.concat(k, F.lit("="), F.element_at("sources", k))), ";"))


@registered("""
    SELECT sha256(t) AS key, t AS text, CASE WHEN max(a) THEN 'segment' ELSE 'status' END AS kind, CASE WHEN t = 'сегмент BUILDING' THEN 'building segment' WHEN max(a) THEN replace(t, 'сегмент', 'segment') END AS result,
           CASE WHEN t = 'сегмент BUILDING' THEN 'phrase' WHEN max(a) THEN 'fragments' END AS method, CASE WHEN max(a) THEN '' ELSE 'missing' END AS problems
    FROM (SELECT 'сегмент ' || c_mktsegment AS t, true AS a FROM customer UNION ALL SELECT 'статус ' || o_orderstatus, false FROM orders) GROUP BY t""")
def translation_build(t: Tables) -> DataFrame:
    """Texts of two kinds collected, translated by phrase or fragments, checked."""
    rows = t.customer.select(F.concat(F.lit("сегмент "), "c_mktsegment").alias("segment"), F.lit(None).cast("string").alias("status"))
    rows = rows.union(t.orders.select(F.lit(None).cast("string"), F.concat(F.lit("статус "), "o_orderstatus")))
    wanted = translate.texts(rows, {"segment": F.col("segment"), "status": F.col("status")})
    # The dictionaries come from the table's own names.
    phrases = t.customer.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("сегмент "), "c_mktsegment").alias("source"), F.concat(F.lower("c_mktsegment"), F.lit(" segment")).alias("target")).distinct()
    fragments = t.region.where("r_regionkey = 0").select(F.lit(0).alias("pos"), F.lit("сегмент").alias("source"), F.lit("segment").alias("target"), F.array(F.lit("segment")).alias("kinds"))
    out = translate.checked(translate.translated(wanted, phrases, fragments))
    return out.select("key", "text", "kind", "result", "method", F.array_join("problems", ",").alias("problems"))


@registered("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS exact, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice ELSE o_totalprice END AS low,
           CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice + 1 ELSE o_totalprice END AS high FROM orders""")
def union_typed_ranges(t: Tables) -> DataFrame:
    """A field that is a number in some documents and an object of min and max in others, as one struct."""
    price = F.col("o_totalprice")
    value = F.when(F.col("o_orderkey") % 3 == 0, F.to_json(F.struct(price.alias("w")))).otherwise(F.to_json(F.struct(F.struct(price.alias("min"), (price + 1).alias("max")).alias("w"))))
    node = F.variant_get(F.parse_json(value), "$.w", "variant")
    r = files.split_union(node)
    return t.orders.select("o_orderkey", F.try_variant_get(node, "$", "double").alias("exact"), r["min"].alias("low"), r["max"].alias("high"))


@registered("SELECT scope, kept, count(*) AS n FROM (SELECT ['engine', 'transmission', 'other'][1 + event_id % 3] AS scope, NOT (event_id % 2 = 0 AND event_id % 3 < 2 AND user_id % 3 > 0) AS kept FROM events) GROUP BY 1, 2")
def issue_migration(t: Tables) -> DataFrame:
    """Issues that move to the component their scope names, if it says so and the record has one; others stay."""
    scope = F.element_at(F.array(F.lit("engine"), F.lit("transmission"), F.lit("other")), (1 + F.col("event_id") % 3).cast("int"))
    rows = t.events.select(F.col("user_id").alias("slug"), F.col("event_id").cast("string").alias("text"), F.lit("s").alias("source"))
    scopes = t.events.select(F.col("event_id").cast("string").alias("text"), F.lit("s").alias("source"), scope.alias("scope"), (F.col("event_id") % 2 == 0).alias("move"))
    users = t.events.where("user_id % 3 > 0").select(F.col("user_id").alias("slug")).distinct()
    linked = users.select("slug", F.explode(F.array(F.lit("engine"), F.lit("transmission"))).alias("kind"), F.lit("c").alias("id"))
    goes, stays = issues.moved(issues.scoped(rows, scopes), linked)
    both = goes.select("scope", F.lit(False).alias("kept")).union(stays.select("scope", F.lit(True)))
    return both.groupBy("scope", "kept").agg(F.count("*").alias("n"))
