"""Queries of the page plans: listings, recalls, sources in pages, reviews, text functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.functions import text
from specloom.operators import prefix, reviews, specs
from specloom.plans import catalogue, report
from specloom.plans.queries import Tables, registered
from specloom.session import shared_folder
from specloom.sources import files, tables, web
from specloom.sources import reviews as paged


@registered("""
    SELECT o_orderkey, CASE WHEN gone THEN 'объявление удалено' WHEN late THEN 'late' END AS error, CASE WHEN NOT gone AND NOT late THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Head ' || o_orderkey ELSE 'Car, qiyməti ' || price || ' USD' END END AS title,
           CASE WHEN NOT gone AND NOT late THEN o_orderstatus END AS make, CASE WHEN NOT gone AND NOT late THEN 2000 + o_custkey % 25 END AS year, CASE WHEN NOT gone AND NOT late THEN o_custkey * 1000 END AS mileage_km,
           CASE WHEN NOT gone AND NOT late THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Автомат' ELSE 'Avtomat (Variator)' END END AS gearbox, CASE WHEN NOT gone AND NOT late AND o_orderkey % 2 = 0 THEN 'Полный' END AS drive, CASE WHEN NOT gone AND NOT late AND o_orderkey % 2 = 0 THEN 'Bakı' END AS city,
           CASE WHEN NOT gone AND NOT late THEN 1.5 END AS engine_l, CASE WHEN NOT gone AND NOT late AND o_orderkey % 2 = 0 THEN 18.3 END AS battery_kwh, CASE WHEN NOT gone AND NOT late THEN 100 + o_custkey % 50 END AS hp, CASE WHEN NOT gone AND NOT late THEN 'Гибрид' END AS fuel,
           CASE WHEN NOT gone AND NOT late THEN CAST(round_even(price * 1.70::DOUBLE, 0) AS INTEGER) END AS price_azn, CASE WHEN NOT gone AND NOT late THEN round_even(price * 1.70::DOUBLE, 0) <= 44000 ELSE false END AS under_budget
    FROM (SELECT *, o_orderkey % 13 = 0 AS gone, o_orderkey % 13 > 0 AND o_orderkey % 17 = 0 AS late, CAST(floor(o_totalprice / 10) AS INTEGER) + 100 AS price FROM orders)""")
def listing_rows(t: Tables) -> DataFrame:
    """Orders as listing pages: properties by their own markup or beside their labels, price, failed pages."""
    k, even = F.col("o_orderkey"), F.col("o_orderkey") % 2 == 0
    price = (F.floor(F.col("o_totalprice") / 10) + 100).cast("string")
    km, hp = F.replace(F.format_number(F.col("o_custkey") * 1000, 0), F.lit(","), F.lit(" ")), (100 + F.col("o_custkey") % 50).cast("string")
    item = lambda label, value: F.concat(F.lit(f'<div class="product-properties__i"><label class="x product-properties__i-name">{label}</label><span class="product-properties__i-value">'), value, F.lit("</span></div>"))
    beside = lambda label, value: F.concat(F.lit(f"<li><b>{label}</b> <i>"), value, F.lit("</i>"))
    year = (2000 + F.col("o_custkey") % 25).cast("string")
    primary = F.concat(item("Marka", F.col("o_orderstatus")), item("Buraxılış ili", year), item("Yürüş", F.concat(km, F.lit(" km"))), item("Sürətlər qutusu", F.lit("Avtomat")), item("Ötürücü", F.lit("Tam")), item("Şəhər", F.lit("Bakı")), item("Mühərrik", F.concat(F.lit("1.5 L / 18.3 kWh / "), hp, F.lit(" a.g. / Hibrid"))), item("Başqa", F.lit("x")))
    other = F.concat(item("Marka", F.col("o_orderstatus")), F.lit("<ul>"), beside("Buraxılış ili", year), beside("Yürüş", km), F.lit("<li><b>Sürətlər qutusu</b> Avtomat (Variator)"), beside("Mühərrik", F.concat(F.lit("1,5 L / 1.5 L / "), hp, F.lit(" a.g. / Hibrid"))), F.lit("</ul>"))
    head = F.when(k % 3 == 0, F.concat(F.lit("<h1>Head <b>"), k, F.lit("</b></h1>"))).otherwise("")
    page = F.concat(F.lit("<html><head><title>Car, qiyməti "), price, F.lit(" USD</title></head><body>"), head, F.when(even, primary).otherwise(other), F.lit("<script>var a = '999 999 AZN';</script></body></html>"))
    gone, late = k % 13 == 0, (k % 13 > 0) & (k % 17 == 0)
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    orders = orders.repartition(orders.sparkSession.sparkContext.defaultParallelism, "o_orderkey")  # a few bytes become a page each: dealt out before
    pages = orders.select(k.cast("string").alias("url"), F.when(gone, 404).when(late, F.lit(None).cast("int")).otherwise(200).alias("status"), F.when(~gone & ~late, page).alias("html"), F.when(late, "late").alias("error"))
    return catalogue.listings(pages).select(F.col("url").cast("long").alias("o_orderkey"), "error", "title", "make", "year", "mileage_km", "gearbox", "drive", "city", "engine_l", "battery_kwh", "hp", "fuel", "price_azn", "under_budget")


@registered("""
    WITH c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer WHERE c_custkey % 9 > 0 AND c_custkey % 7 > 0 AND c_custkey % 4 > 0)
    SELECT 'https://h.cn/x/zhdt/art/' || k || '.html' AS href, CASE k % 4 WHEN 1 THEN 'BYD' WHEN 2 THEN 'BYD,Geely' ELSE 'Wuling' END AS brands, CASE k % 4 WHEN 1 THEN 'import' WHEN 2 THEN 'both' ELSE 'domestic' END AS origin,
           CASE WHEN k % 2 = 0 THEN '2024-03-' || lpad((1 + k % 28)::VARCHAR, 2, '0') END AS list_date, CASE WHEN k % 10 < 8 THEN '2025-01-' || lpad((1 + k % 28)::VARCHAR, 2, '0') || ' 10:00' END AS pub_date, CASE WHEN k % 10 > 0 THEN 'k' || k END AS keywords,
           'M2025' || k AS recall_numbers, CASE WHEN k % 6 > 0 THEN k * 10 END AS affected_units_total, CASE WHEN k % 2 = 0 THEN repeat('b', 100) || chr(10) || k ELSE repeat('p', 30) || k END AS body,
           CASE WHEN k % 10 < 8 THEN '2025-01-' || lpad((1 + k % 28)::VARCHAR, 2, '0') || ' 10:00' WHEN k % 2 = 0 THEN '2024-03-' || lpad((1 + k % 28)::VARCHAR, 2, '0') ELSE '' END AS shown FROM c""")
def recall_rows(t: Tables) -> DataFrame:
    """Customers as recall notices in list pages: links with dates near them, drops before the details, details."""
    k = F.col("c_custkey")
    text_of = k.cast("string")
    brand = F.element_at(F.array(F.lit("本田"), F.lit("比亚迪进口"), F.lit("比亚迪、吉利进口及国产"), F.lit("上汽通用五菱国产")), (1 + k % 4).cast("int"))
    title = F.concat(brand, F.when(k % 9 == 0, "摩托车").when(k % 7 == 0, F.element_at(F.array(F.lit("自卸"), F.lit("牵引车"), F.lit("货车")), (1 + k % 3).cast("int"))).otherwise("汽车"), F.lit(" 召回公告"))
    day = F.lpad((1 + k % 28).cast("string"), 2, "0")
    link = F.concat(F.lit('<li><a href="art/'), text_of, F.lit('.html">'), title, F.lit("</a>"), F.when(k % 2 == 0, F.concat(F.lit("<span>2024-03-"), day, F.lit("</span>"))).otherwise(""), F.lit('</li><li><a href="/other/1">召回</a><a>召回</a>'))
    lists = t.customer.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), link.alias("l")))), lambda x: x["l"]), "").alias("l"))
    lists = lists.select(F.concat(F.lit("https://h.cn/x/zhdt/index_"), "c_nationkey", F.lit(".html")).alias("url"), F.concat(F.lit("<ul>"), "l", F.lit("</ul>")).alias("html"))
    wanted = catalogue.wanted_recalls(catalogue.recall_links(lists), {"比亚迪": "BYD", "吉利": "Geely", "五菱": "Wuling", "上汽": "SAIC"}, ("上汽通用",))
    meta = lambda name, value: F.concat(F.lit(f'<meta name="{name}" content="'), value, F.lit('">'))
    made = F.concat(F.lit("2025-01-"), day, F.lit(" 10:00"))
    metas = F.concat(F.when(k % 10 < 4, meta("PubDate", made)).when(k % 10 < 8, meta("MakeTime", made)).otherwise(""), F.when(k % 10 > 0, meta("Keywords", F.concat(F.lit(" k"), text_of))).otherwise(""))
    body = F.when(k % 2 == 0, F.concat(F.lit('<div class="article">short</div><div id="content"><p>' + "b" * 100 + "</p><p>"), text_of, F.lit("</p></div><p>" + "p" * 30 + "</p>"))).otherwise(F.concat(F.lit('<div class="view">x</div><p>short<p>' + "p" * 30), text_of))
    units = F.when(k % 6 > 0, F.concat(F.lit("<div>涉及 共计 "), (k * 10).cast("string"), F.lit(" 辆</div>"))).otherwise("")
    customers = t.customer.select("c_custkey")
    customers = customers.repartition(customers.sparkSession.sparkContext.defaultParallelism, "c_custkey")  # a few bytes become a page each: dealt out before
    details = customers.select(F.concat(F.lit("https://h.cn/x/zhdt/art/"), text_of, F.lit(".html")).alias("url"), F.concat(metas, body, units, F.lit("<div>召回编号： M2025"), text_of, F.lit(" </div>")).alias("html"), F.lit(None).cast("string").alias("error"))
    found = catalogue.recalls(wanted, details)
    shown = F.coalesce(F.nullif("pub_date", F.lit("")), F.nullif("list_date", F.lit("")), F.lit(""))
    return catalogue.recall_order(found).select("href", F.array_join("brands", ",").alias("brands"), "origin", "list_date", "pub_date", "keywords", F.array_join("recall_numbers", ",").alias("recall_numbers"), "affected_units_total", "body", shown.alias("shown"))


@registered("""
    SELECT n_nationkey, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS pos, s_suppkey::VARCHAR AS model_id, s_name || ' ' || s_suppkey % 3 AS name FROM nation JOIN supplier ON s_nationkey = n_nationkey""")
def brand_models(t: Tables) -> DataFrame:
    """The models that a brand's page lists, each once, in page order."""
    card = F.concat(F.lit('<a href="/model_'), "s_suppkey", F.lit('" class="brand-list-item--link"><b>'), "s_name", F.lit("</b>\n <i>"), F.col("s_suppkey") % 3, F.lit("</i></a> 参数"))
    pages = t.supplier.groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", card.alias("c")))), lambda x: F.concat(x["c"], x["c"])), "").alias("html"))
    return files.models_of(pages.withColumnRenamed("s_nationkey", "url")).select(F.col("url").alias("n_nationkey"), "pos", "model_id", "name")


@registered("SELECT c_nationkey AS url, CAST(pos // 10 AS BIGINT) AS batch, string_agg(c_custkey::VARCHAR, ',' ORDER BY pos) AS ids FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos FROM customer) GROUP BY 1, 2")
def trim_batches(t: Tables) -> DataFrame:
    """The trims that a model's page names, each once, in batches of ten."""
    pages = t.customer.groupBy(F.col("c_nationkey").alias("url")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda x: F.concat(F.lit("/trim_"), x, F.lit("/ trim_"), x)), " ").alias("html"))
    batches = web.batches_of(files.trims_of(pages), "pos", "trim_id", by=["url"])
    return batches.withColumn("ids", F.array_join("ids", ","))


@registered("SELECT s_suppkey AS spec_id, s_name AS name, s_nationkey AS reviews FROM supplier WHERE regexp_matches(s_name, '[02468]$') AND s_nationkey > 0")
def reviewed_trims(t: Tables) -> DataFrame:
    """Trims of nested groups by name that have reviews."""
    spec = F.struct(F.col("s_suppkey").alias("specid"), F.col("s_name").alias("specname"), F.col("s_nationkey").alias("koubeicount"))
    groups = t.supplier.groupBy(F.col("s_nationkey") % 5, "s_nationkey").agg(F.collect_list(spec).alias("speclist"))
    return reviews.reviewed_trims(groups.select(F.array(F.struct("speclist")).alias("specgroup")), "[02468]$")


@registered("SELECT c_custkey AS series, CAST(page AS INTEGER) AS page FROM customer, unnest(range(2, least(c_custkey % 14, 10) + 1)) u(page)")
def review_pages(t: Tables) -> DataFrame:
    """The pages of reviews to ask for after the first."""
    return reviews.pages_of(t.customer.select(F.col("c_custkey").alias("series"), (F.col("c_custkey") % 14).cast("int").alias("pagecount")))


@registered("SELECT o_orderkey, 'https://k.autohome.com.cn/detail/view_01' || o_orderkey || 'abcdefghijklmn.html' AS url, substr('01' || o_orderkey || 'abcdefghijklmn.html', 1, 14) AS short FROM orders WHERE o_orderkey % 4 > 0 AND contains(o_orderpriority, 'M')")
def owner_reviews(t: Tables) -> DataFrame:
    """Reviews of owners, not of visitors, of some trims, with their addresses and short ids."""
    extra = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.struct(F.lit("探店时间").alias("name")))).when(F.col("o_orderkey") % 4 == 1, F.array(F.struct(F.lit("x").alias("name"))))
    rows = reviews.owners_only(t.orders.select("o_orderkey", F.col("o_orderpriority").alias("specname"), extra.alias("exinfolist")), "M")
    url = reviews.review_url(F.concat(F.lit("01"), F.col("o_orderkey").cast("string"), F.lit("abcdefghijklmn")))
    return rows.select("o_orderkey", url.alias("url"), reviews.short_id(url).alias("short"))


@registered("""
    SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN trim(substr(x, 1, 1200)) ELSE '' END AS least FROM (SELECT doc_id, replace(regexp_replace(text, '[\\s\\x0B]+', ' ', 'g'), '  ', ' ') AS x FROM documents)""")
def least_liked(t: Tables) -> DataFrame:
    """What a review says its owner likes least: between two markers, cut to 1200 letters."""
    body = F.replace(F.regexp_replace("text", r"[\s\x0B]+", " "), F.lit("  "), F.lit(" "))
    page = F.concat(F.lit("最满意 all "), F.when(F.col("doc_id") % 3 > 0, F.lit("最不满意")).otherwise(""), body, F.lit(" 空间 4 and more 上述内容的版权 x 最不满意"))
    return t.documents.select("doc_id", reviews.least_liked(page).alias("least"))


_FAULTS = "onth|eshe|ound"


@registered(f"""
    WITH f AS (SELECT doc_id, text, regexp_extract_all(text, '{_FAULTS}') AS m, string_split_regex(text, '{_FAULTS}') AS p FROM documents),
         w AS (SELECT doc_id, text, i, m[i] AS word, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS place_at FROM f, unnest(range(1, least(len(m), 8) + 1)) u(i))
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS place, substr(text, CAST(greatest(place_at - 70, 0) + 1 AS BIGINT), CAST(place_at + length(word) + 70 - greatest(place_at - 70, 0) AS BIGINT)) AS snippet FROM w""")
def fault_snippets(t: Tables) -> DataFrame:
    """The first eight places of fault words in a text with the letters around."""
    return reviews.fault_snippets(t.documents, "doc_id", "text", faults=_FAULTS)


@registered("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{2}'))), ' ') AS tags FROM documents")
def sorted_tags(t: Tables) -> DataFrame:
    """The sorted distinct matches of a pattern in each text."""
    return t.documents.select("doc_id", F.array_join(reviews.sorted_tags(F.col("text"), "[A-Z][a-z]{2}"), " ").alias("tags"))


@registered("SELECT c_nationkey, array_to_string(list_distinct_ordered, ' ') AS tags FROM (SELECT c_nationkey, list_transform(list_sort(list_transform(list_distinct(list(c_mktsegment)), lambda s: {'first': list_position(list(c_mktsegment ORDER BY c_custkey), s), 's': substr(s, 1, 4)})), lambda x: x.s) AS list_distinct_ordered FROM customer GROUP BY 1)")
def trim_tags(t: Tables) -> DataFrame:
    """The distinct tags of a group's names in the order they come."""
    names = t.customer.groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_mktsegment"))), lambda x: x["c_mktsegment"]).alias("names"))
    return names.select("c_nationkey", specs.tags(F.col("names"), "^[A-Z]{4}").alias("tags"))


@registered("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE END AS length, CASE WHEN p_size % 2 = 0 THEN (p_size * 2)::DOUBLE END AS width, CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN p_size / 2.0::DOUBLE END AS height FROM part")
def dimension_split(t: Tables) -> DataFrame:
    """Three numbers out of one text; missing ones are null."""
    from specloom.functions import parse

    n = F.col("p_size")
    shown = F.when(n % 2 == 0, F.concat(n.cast("string"), F.lit("x"), (n * 2).cast("string"), F.when(n % 3 == 0, F.concat(F.lit("x"), (n / 2).cast("string"), F.lit(" mm"))).otherwise("x-")))
    d = parse.dimensions(shown)
    return t.part.select("p_partkey", d[0].alias("length"), d[1].alias("width"), d[2].alias("height"))


@registered("""
    SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN p_size / 10.0::DOUBLE END AS fuel, CASE WHEN p_size % 4 > 0 THEN '工信部综合 (с учётом электро)' END AS cycle, CASE WHEN p_size % 3 = 0 OR p_size % 5 = 0 THEN true WHEN p_size % 5 = 1 THEN false END AS dc_supported,
           CASE WHEN p_size % 3 = 0 THEN 0.5 END AS dc_to_80_h, nullif(p_size % 7, 0)::DOUBLE AS ac_full_h, CASE WHEN contains(p_name, 'bolt') THEN 'byd' WHEN contains(p_name, 'widget') THEN 'changan' ELSE 'other' END AS brand FROM part""")
def fuel_and_charging(t: Tables) -> DataFrame:
    """The last consumption figure with its cycle, charging with its three states, the brand a model's name tells."""
    from specloom.operators.components import model_brand

    n = F.col("p_size")
    fuel = catalogue.miit_fuel(F.concat(F.lit("9.9/"), F.when(n % 4 > 0, (n / 10).cast("string")).otherwise("-")))
    mode = F.when(n % 5 == 0, "快充+慢充").when(n % 5 == 1, "慢充").when(n % 5 == 2, "-")
    charging = catalogue.charging(F.when(n % 3 == 0, F.lit(0.5)).when(n % 3 == 1, F.lit(0.0)), (n % 7).cast("double"), mode)
    model = F.when(F.col("p_name").contains("bolt"), "BYD Song by Changan").when(F.col("p_name").contains("widget"), "Deepal S07").otherwise("X")
    return t.part.select("p_partkey", fuel["value"].alias("fuel"), fuel["cycle"].alias("cycle"), charging["dc_supported"].alias("dc_supported"), charging["dc_to_80_h"].alias("dc_to_80_h"), charging["ac_full_h"].alias("ac_full_h"), model_brand(model).alias("brand"))


@registered("SELECT path, A, B FROM (SELECT 'p' || k % 40 AS path, max(CASE WHEN k % 2 = 0 THEN CASE WHEN k % 3 > 0 THEN n END END) AS A, max(CASE WHEN k % 2 = 1 THEN CASE WHEN k % 3 > 0 THEN n END END) AS B FROM (SELECT s_suppkey AS k, s_name AS n FROM supplier) GROUP BY 1) WHERE A IS NOT NULL OR B IS NOT NULL")
def spec_pivot(t: Tables) -> DataFrame:
    """Long specification rows to one row per path with a column per trim; rows of missing values go."""
    k = F.col("s_suppkey")
    rows = t.supplier.select(F.when(k % 2 == 0, "A").otherwise("B").alias("trim_id"), F.concat(F.lit("p"), k % 40).alias("path"), F.when(k % 3 > 0, F.col("s_name")).otherwise("--").alias("value"), F.col("s_name").alias("pos"))
    return specs.wide(rows, ["A", "B"])


@registered("SELECT doc_id, md5(nfc_normalize(text)) AS composed, md5(nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)))) AS again FROM documents")
def composed_texts(t: Tables) -> DataFrame:
    """Texts in composed form, taken apart before or not."""
    apart = F.replace(F.replace("text", F.lit("é"), F.lit("é")), F.lit("ü"), F.lit("ü"))
    return t.documents.select("doc_id", F.md5(text.nfc(F.col("text"))).alias("composed"), F.md5(text.nfc(apart)).alias("again"))


@registered("SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '(a|e)t ', '\\1d ', 'g'), '#+', 'n', 'g')) AS folded FROM documents")
def regex_folds(t: Tables) -> DataFrame:
    """Patterns replaced one after the other."""
    return t.documents.select("doc_id", F.md5(text.replaced_patterns(F.col("text"), (("[0-9]+", "#"), ("(a|e)t ", "$1d "), ("#+", "n")))).alias("folded"))


@registered("""
    WITH o AS (SELECT *, o_custkey % 3 = 0 AS spec, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS n FROM orders)
    SELECT CASE WHEN spec THEN 'spec' ELSE 'series' END AS kind, CAST(o_custkey AS VARCHAR) AS id, n // 4 + 1 AS page, CASE WHEN n // 4 < 2 THEN n % 4 END AS pos,
           CASE WHEN n // 4 < 2 THEN o_orderkey::VARCHAR END AS show_id, CASE WHEN n // 4 < 2 THEN o_orderpriority END AS specname, CASE WHEN n // 4 < 2 THEN o_orderstatus = 'F' END AS visit,
           CASE WHEN n // 4 < 2 THEN CAST(o_orderdate AS VARCHAR) END AS said, CASE WHEN n // 4 >= 2 THEN 'HTTP 500' END AS error
    FROM o WHERE n // 4 < 2 OR n % 4 = 0""")
def review_answers(t: Tables) -> DataFrame:
    """Answers of a paged review API, a page each, as reviews with their failures; orders of a customer stand for reviews of a series."""
    o = t.orders.select("*", F.expr("row_number() over (partition by o_custkey order by o_orderkey) - 1").alias("n"))
    extra = F.array(F.struct(F.when(F.col("o_orderstatus") == "F", F.lit(reviews.VISIT)).otherwise(F.lit("x")).alias("name")))
    one = F.struct(F.col("o_orderkey").alias("showId"), F.col("o_orderpriority").alias("specname"), extra.alias("exinfolist"), F.array(F.struct(F.lit("x").alias("structuredname"), F.col("o_orderdate").cast("string").alias("content"))).alias("contents"))
    pages = o.groupBy("o_custkey", F.floor(F.col("n") / 4).cast("int").alias("p")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", one.alias("e")))), lambda x: x["e"]).alias("list"))
    good = F.col("p") < 2
    body = F.when(good, F.to_json(F.struct(F.struct("list").alias("result"))))
    answers = pages.select(F.when(F.col("o_custkey") % 3 == 0, "spec").otherwise("series").alias("kind"), F.col("o_custkey").cast("string").alias("id"), (F.col("p") + 1).alias("page"), body.alias("body"), F.when(~good, "HTTP 500").alias("error"))
    return paged.parsed(answers).select("kind", "id", "page", "pos", "show_id", "specname", "visit", F.try_element_at("sections", F.lit(1))["text"].alias("said"), "error")


@registered("""
    WITH o AS (SELECT o_orderkey AS k, o_orderkey % 6 AS n, o_custkey % 2 = 0 AS more FROM orders),
         f AS (SELECT k, 'rattle' AS category, 2 AS cat_place, CASE n WHEN 0 THEN '异响 在 ' || k ELSE '刹车 偏软 异响' END AS snippet FROM o WHERE n IN (0, 2) UNION ALL SELECT k, 'brake', 3, '刹车 偏软 异响' FROM o WHERE n = 2
               UNION ALL SELECT k, 'head_unit', 1, '黑屏 重启' FROM o WHERE n = 3 UNION ALL SELECT k, 'lights', 11, '大灯 APP' FROM o WHERE n = 4 UNION ALL SELECT k, 'app_key', 15, '大灯 APP' FROM o WHERE n = 4),
         c AS (SELECT category, count(*) AS reviews, row_number() OVER (ORDER BY count(*) DESC, min(k), any_value(cat_place)) AS rank FROM f GROUP BY category),
         r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY k) AS place FROM f)
    SELECT rank::INTEGER AS rank, place::INTEGER AS place, '  ' || k || ' ' || substr('trim number ' || k || ' of a long name', 1, 22) || '/3 months: ' || snippet AS line FROM r JOIN c USING (category) WHERE place <= 14
    UNION ALL SELECT rank::INTEGER, 0, '#### ' || category || ': ' || reviews || ' reviews' FROM c""")
def complaint_report(t: Tables) -> DataFrame:
    """Reviews by category of complaint, the first fourteen of each, as lines."""
    k = F.col("o_orderkey")
    n = k % 6
    body = F.when(n == 0, F.concat(F.lit("异响 在 "), k)).when(n == 1, "没有 异响").when(n == 2, "刹车 偏软 异响").when(n == 3, "黑屏 重启").when(n == 4, "大灯 APP").otherwise("好")
    orders = t.orders.select("o_orderkey")
    orders = orders.repartition(orders.sparkSession.sparkContext.defaultParallelism, "o_orderkey")  # a few bytes become a text each: dealt out before
    rows = orders.select("o_orderkey", body.alias("body"), F.concat(F.lit(" trim number "), k, F.lit(" of a long name")).alias("trim"))
    found = reviews.complaint_report(rows, "o_orderkey", "body", reviews.review_meta(F.col("trim"), F.lit("3 months ")), "o_orderkey")
    return reviews.report_lines(found, "o_orderkey")


@registered("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN substr('Характеристики ' || o_orderpriority || repeat(' x', o_orderkey % 200) || ' Недостатки шум ' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ' Поломки ' || o_orderstatus ELSE '' END || ' Оценка 5 Год выпуска 2020 ' || o_custkey || ' Комментарии', 1, 300) ELSE '' END AS spec,
           'шум ' || o_orderkey AS minus, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS broken, 'Год выпуска 2020 ' || o_custkey || ' ' AS body FROM orders""")
def page_opinions(t: Tables) -> DataFrame:
    """What the plain text of a review page says of specification, faults and breakdowns, and its body."""
    k = F.col("o_orderkey")
    spec = F.when(k % 3 > 0, "Характеристики ").otherwise("x ")
    broken = F.when(k % 2 == 0, F.concat(F.lit(" Поломки "), "o_orderstatus")).otherwise("")
    page = F.concat(F.lit("head "), spec, "o_orderpriority", F.repeat(F.lit(" x"), (k % 200).cast("int")), F.lit(" Недостатки шум "), k, broken, F.lit(" Оценка 5 Год выпуска 2020 "), "o_custkey", F.lit(" Комментарии"))
    rows = t.orders.select("o_orderkey", reviews.page_opinions(page).alias("o"), reviews.page_body(page).alias("body"))
    return rows.select("o_orderkey", "o.spec", "o.minus", "o.broken", "body")


@registered("SELECT p_partkey, CASE WHEN p_name LIKE 'b%' THEN 'b' WHEN p_name LIKE 'wi%' THEN 'wi' WHEN p_name LIKE 'w%' THEN 'w' WHEN p_name LIKE 'gear%' THEN 'gear' END AS family FROM part")
def prefix_families(t: Tables) -> DataFrame:
    """The first family whose prefix a name begins with, met by equality of cut names."""
    known = t.region.where("r_regionkey = 0").select(F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(p).alias("p"), F.lit(p).alias("family")) for i, p in enumerate(("b", "wi", "w", "gear"))])).alias("x")).select("x.*")
    return prefix.first_prefixed(t.part, "p_name", known, "p", "pos", "family").select("p_partkey", "family")


@registered("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'first' END AS segment, c_custkey % 3 < 2 AS early FROM customer")
def keyed_replace(t: Tables) -> DataFrame:
    """A table with a row a key: rows added, then put in place of others by key, in their buckets."""
    table = tables.KeyedTable(t.customer.sparkSession, f"{shared_folder(t.customer.sparkSession)}/specloom-keyed-{uuid.uuid4().hex}", "c_custkey", 16)
    early = F.col("c_custkey") % 3 < 2
    table.put(t.customer.where(early).select("c_custkey", F.lit("first").alias("segment"), F.lit(True).alias("early")))
    changed = t.customer.where(F.col("c_custkey") % 3 == 0).select("c_custkey", F.col("c_mktsegment").alias("segment"), F.lit(True).alias("early"))
    table.put(changed, force=True)
    table.put(t.customer.select("c_custkey", F.lit("first").alias("segment"), F.lit(False).alias("early")))
    return table.read()


@registered("SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS moved, count(*) FILTER (WHERE l_discount > 0.05) AS kept, count(*) FILTER (WHERE l_linenumber = 1) AS inherited FROM lineitem")
def process_counters(t: Tables) -> DataFrame:
    """How many rows a write moved, kept and inherited, counted by the pass that writes them."""
    spark = t.lineitem.sparkSession
    conditions = {"moved": F.col("l_returnflag") == "R", "kept": F.col("l_discount") > 0.05, "inherited": F.col("l_linenumber") == 1}
    told = report.written(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_discount"), f"{shared_folder(spark)}/specloom-written-{uuid.uuid4().hex}", conditions)
    return spark.createDataFrame([tuple(told.values())], ", ".join(f"{n} long" for n in told))
