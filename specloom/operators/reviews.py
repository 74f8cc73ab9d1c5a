"""Owner reviews: blocks of text, complaints by category, snippets."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.operators.firsts import first_rows
from specloom.session import settled

#: Letters on either side of a match; the part of a window that tells repeats.
CONTEXT, REPEAT = 45, (20, 60)


def blocks(text: DataFrame, column: str = "value") -> DataFrame:
    """Review blocks ``== url | spec | post date | own period | distance`` with ``  [section] text`` lines, as columns."""
    lines = F.split(F.col(column), "\n")
    head = F.transform(F.split(F.regexp_replace(F.element_at(lines, 1), "^== ", ""), r"\|"), lambda x: F.trim(x))
    field = lambda i, prefix="": F.regexp_replace(F.get(head, F.lit(i)), f"^{prefix}", "")
    section = lambda x: F.struct(F.regexp_extract(x, r"^  \[([^\]]*)\]", 1).alias("name"), F.regexp_extract(x, r"(?s)^  \[[^\]]*\] ?(.*)$", 1).alias("text"))
    return text.select(
        field(0).alias("url"), field(1).alias("spec"), field(2, "post ").alias("posted"), field(3, "own ").alias("owned"), field(4).alias("distance"),
        F.transform(F.filter(lines, lambda x: x.startswith("  [")), section).alias("sections"),
    )


def _windows(text: str, pattern: re.Pattern, negation: re.Pattern | None, context: int) -> list[str]:
    kept: list[str] = []
    for m in pattern.finditer(text):
        window = text[max(0, m.start() - context) : m.end() + context]
        if negation and negation.search(window):
            continue
        mark = window[REPEAT[0] : REPEAT[1]]
        if any(mark in k for k in kept):
            continue
        kept.append(window)
    return kept


def complaints(reviews: DataFrame, key: str, text: str, categories: Mapping[str, str], negation: str | None = None, context: int = CONTEXT, beside: Sequence[str] = ()) -> DataFrame:
    """(key, category, place, snippet) and the columns ``beside``: matches of each category's pattern with ``context`` letters around.

    A window that the negation matches is no complaint. One whose letters 20 to 60 stand in a kept window of the same
    text and category is a repeat. Spark has no function for the places of all matches, so texts that can match at
    all, told by a built-in filter, go through an Arrow function that holds the compiled patterns.
    """
    any_of = "|".join(f"(?:{p})" for p in categories.values())
    rows = reviews.where(F.col(text).rlike(any_of)).select(key, text, *beside)
    kinds = [f"`{c}` {reviews.schema[c].dataType.simpleString()}" for c in (key, *beside)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = {name: re.compile(p) for name, p in categories.items()}
        no = re.compile(negation) if negation else None
        for batch in batches:
            at, names, places, snippets = [], [], [], []
            for i, value in enumerate(batch.column(1)):
                for name, pattern in patterns.items():
                    for n, window in enumerate(_windows(value.as_py(), pattern, no, context)):
                        at.append(i), names.append(name), places.append(n), snippets.append(window)
            rows_at = pa.array(at, pa.int64())
            carried = [batch.column(i).take(rows_at) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows_at), pa.array(names, pa.string()), pa.array(places, pa.int32()), pa.array(snippets, pa.string()), *carried], names=[key, "category", "place", "snippet", *beside])

    return rows.mapInArrow(run, ", ".join([kinds[0], "category string, place int, snippet string", *kinds[1:]]))


def top_snippets(found: DataFrame, key: str, n: int = 2) -> DataFrame:
    """The first ``n`` snippets of each review and category."""
    return first_rows(found, [key, "category"], ["place"], n)


def category_counts(found: DataFrame, key: str, names: Sequence[str] = ()) -> DataFrame:
    """Categories by the number of reviews that complain, ties in the order of ``names`` (by name without them)."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("category")) if names else F.col("category")
    return found.groupBy("category").agg(F.count_distinct(key).alias("reviews")).orderBy(F.desc("reviews"), place)


#: Fixed values. Complaints by category, and what says in a match's window that there is none.
CATEGORIES = {
    "head_unit": "死机|黑屏|白屏|自动重启|重启|卡顿|卡死|闪退|花屏",
    "rattle": "异响|咯吱|嘎吱|吱吱|咔咔|哒哒",
    "brake": "刹车.{0,8}(异响|偏软|太软|发软|偏硬|点头|不线性|不跟脚|前段|行程|异常|抖)",
    "noise_road": "胎噪|风噪|路噪|隔音",
    "engine_noise": "发动机.{0,8}(噪音|声音|吵|轰|嗡|震动|抖)|增程器.{0,6}(噪音|声音|吵|震)",
    "suspension": "底盘.{0,6}(硬|软|松散|颠|异响|调校)|悬挂.{0,4}(硬|软)|减震.{0,4}(硬|软|差)|避震.{0,4}(硬|软|差)",
    "jerk": "顿挫|前窜|往前窜|窜一下|一冲一冲|耸",
    "range_fuel": "续航.{0,6}(虚|打折|缩水|掉|达成率)|亏电.{0,4}油耗.{0,6}(高|偏高)|油耗.{0,3}(高|偏高|大)",
    "paint_body": "车漆|漆面|漆薄|生锈|锈",
    "adas": "智驾|辅助驾驶|AEB|误刹|幽灵刹车|自动泊车|车道保持|NOA|领航",
    "lights": "大灯|车灯|远光|近光",
    "leak": "漏水|进水|渗水|漏油|起雾",
    "charge": "充电.{0,8}(故障|失败|慢|跳枪|中断|中止|充不进)|充不进",
    "climate": "空调.{0,8}(异味|不制冷|故障|噪音|吵)|热泵",
    "app_key": "APP|App|app|蓝牙钥匙|手机钥匙|NFC",
    "door_handle": "门把手",
    "smell": "异味|味道大|气味",
    "tire": "轮胎|胎压|爆胎|鼓包",
    "steering": "方向盘.{0,6}(抖|异响|跑偏|虚位)|跑偏",
    "battery12v": "亏电(?!.{0,4}油耗)|小电瓶|电瓶",
}
NEGATIONS = "没有|没遇到|无故障|还没|未出现|不卡顿|无卡顿|减少卡顿|不会卡|暂无|从未|零故障|目前没|无异响|没出现|没啥|几乎感觉不到|无顿挫|没有顿挫|毫无顿挫|感受不到"
#: Reviews that a report shows of a category, snippets of a review; letters of the trim's name in a review's line.
SHOWN, SNIPPETS, TRIM_LETTERS = 14, 2, 22


def review_meta(trim: Column, owned: Column) -> Column:
    """What a report says of a review beside its id: the beginning of the trim's name and how long it has been owned."""
    return F.concat(F.substring(F.trim(trim), 1, TRIM_LETTERS), F.lit("/"), F.trim(owned))


def complaint_report(reviews: DataFrame, key: str, text: str, meta: Column, position: str, categories: Mapping[str, str] | None = None, negation: str = NEGATIONS, shown: int = SHOWN) -> DataFrame:
    """(rank, category, reviews, place, key, meta, snippets): categories by the reviews that complain, the first ``shown`` of each.

    Categories with as many stand in the order in which they first occur, by ``position`` of the review, then as listed. A review shows
    its first SNIPPETS snippets, line ends as spaces, between bars. Keys tell reviews apart; those without one are left out. What is
    shuffled are the snippets only, with position and ``meta`` beside them.
    """
    names = CATEGORIES if categories is None else dict(categories)
    rows = reviews.where(F.col(key).isNotNull()).select(key, text, F.col(position).alias("_position"), meta.alias("meta"))
    found = complaints(rows, key, text, names, negation, beside=("_position", "meta")).where(F.col("place") < SNIPPETS)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "snippet"))), lambda x: F.replace(x["snippet"], F.lit("\n"), F.lit(" ")))
    each = found.groupBy(key, "category").agg(F.array_join(lines, " || ").alias("snippets"), F.first("_position").alias("_position"), F.first("meta").alias("meta"))
    each = settled(each)  # counted and shown: patterns are looked for once
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("category"))
    counts = each.groupBy("category").agg(F.count("*").alias("reviews"), F.min("_position").alias("_first")).withColumn("_place", place)
    counts = counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("reviews"), "_first", "_place")))  # a row a category
    # The place alone is the bound: so each task keeps the first rows of a category before they are dealt out.
    first = each.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy("_position", key))).where(F.col("place") <= shown)
    return first.join(F.broadcast(counts), "category").select("rank", "category", "reviews", "place", key, "meta", "snippets")


def report_lines(report: DataFrame, key: str) -> DataFrame:
    """(rank, place, line): a report as lines, each category's heading at place 0."""
    head = report.where("place = 1").select("rank", F.lit(0).alias("place"), F.format_string("#### %s: %d reviews", "category", "reviews").alias("line"))
    return head.union(report.select("rank", "place", F.format_string("  %s %s: %s", F.col(key).cast("string"), "meta", "snippets")))


#: Fixed values. Where parts of a review page begin and end, and how long they may be.
PAGE_SPEC, PAGE_MINUS, PAGE_BROKEN = ("Характеристики", 300), "Недостатки(.{0,1200}?)(Поломки|Оценка|Комментари|Достоинства)", "Поломки(.{0,600}?)(Оценка|Комментари)"
BODY_FROM, BODY_TO, BODY_LETTERS, BODY_MOST = "Год выпуска", ("Мнения владельцев", "Комментарии"), 4000, 3500


def page_opinions(text: Column) -> Column:
    """A struct of what a page's plain text gives as specification (empty without), faults and breakdowns (null without)."""
    at = F.instr(text, PAGE_SPEC[0])
    part = lambda pattern: F.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, 1)))
    return F.struct(F.when(at > 0, F.substr(text, at, F.lit(PAGE_SPEC[1]))).otherwise("").alias("spec"), part(PAGE_MINUS).alias("minus"), part(PAGE_BROKEN).alias("broken"))


def page_body(text: Column) -> Column:
    """A review page's text from BODY_FROM up to the first of BODY_TO after it; empty without a beginning."""
    at = F.instr(text, BODY_FROM)
    tail = F.substr(text, at, F.lit(BODY_LETTERS))
    ends = F.filter(F.array(*[F.instr(F.substr(text, at), p) for p in BODY_TO]), lambda e: e > 1)
    return F.when(at > 0, F.substr(tail, F.lit(1), F.least(F.coalesce(F.array_min(ends) - 1, F.lit(BODY_LETTERS)), F.lit(BODY_MOST)))).otherwise("")


def between(text: Column, start: str, stop: str, most: int = 1200) -> Column:
    """What stands between the markers, at most ``most`` letters; null without the first marker."""
    tail = F.element_at(F.split(text, f"\\Q{start}\\E", 2), -1)
    cut = F.substring_index(F.substring(tail, 1, most), stop, 1)
    return F.when(F.contains(text, F.lit(start)), F.trim(cut))


#: Fixed values. Words of faults, and what bounds the part on what an owner likes least.
FAULTS = "故障|坏了|异响|死机|黑屏|重启|漏水|漏油|渗|维修|返厂|更换|换了|召回|报警|抖动|顿挫|异味|生锈|开裂|脱落|失灵|断电|趴窝|亏电|熄火|无法启动|进水|起雾|卡顿|闪退"
LEAST, BEST, RIGHTS, AFTER = "最不满意", "最满意", "上述内容的版权", " 空间 \\d | 驾驶感受 \\d "
#: Fixed values. What marks a report of a visit to a dealer; an address of a review.
VISIT, REVIEW_URL = "探店时间", "https://k.autohome.com.cn/detail/view_%s.html"


def owners_only(reviews: DataFrame, trim: str = "") -> DataFrame:
    """Reviews (exinfolist array of name, specname) but for visits to dealers, of the trims whose name holds ``trim``."""
    visit = F.exists(F.coalesce("exinfolist.name", F.array().cast("array<string>")), lambda n: n == VISIT)
    rows = reviews.where(~F.coalesce(visit, F.lit(False)))
    return rows.where(F.contains("specname", F.lit(trim))) if trim else rows


def least_liked(text: Column, most: int = 1200) -> Column:
    """What a review's text says under LEAST, up to the next rating, at most ``most`` letters; without a rating, ``most`` from the mark's
    own beginning; empty without the mark."""
    body = F.substring_index(text, RIGHTS, 1)
    tail = F.when(F.contains(body, F.lit(LEAST)), F.element_at(F.split(body, LEAST, 2), 2))
    parts = F.split(tail, AFTER, 2)
    return F.coalesce(F.trim(F.substring(F.element_at(parts, 1), F.lit(1), F.when(F.size(parts) > 1, most).otherwise(most - len(LEAST)))), F.lit(""))


def fault_snippets(reviews: DataFrame, key: str, text: str, n: int = 8, context: int = 70, faults: str = FAULTS) -> DataFrame:
    """(key, place, snippet): the first ``n`` places of fault words with the letters around, from BEST on where it is."""
    body = F.substring_index(F.col(text), RIGHTS, 1)
    start = F.when(F.instr(body, BEST) > 0, F.instr(body, BEST)).otherwise(1)
    rows = reviews.select(key, F.substring(body, start, F.length(body)).alias("_body"))
    pieces, found = F.split("_body", faults), F.regexp_extract_all("_body", F.lit(f"({faults})"), F.lit(1))
    rows = rows.select(key, "_body", pieces.alias("_pieces"), found.alias("_found"))
    length = lambda array, i: F.aggregate(F.transform(F.slice(array, F.lit(1), i), lambda x: F.length(x)), F.lit(0), lambda a, x: a + x)

    def one(word: Column, i: Column) -> Column:
        at = length(F.col("_pieces"), i + 1) + length(F.col("_found"), i)
        first = F.greatest(at - context, F.lit(0))
        return F.substring(F.col("_body"), first + 1, at + F.length(word) + context - first)

    return rows.select(key, F.posexplode(F.transform(F.slice("_found", 1, n), one)).alias("place", "snippet"))


def review_url(review_id: Column) -> Column:
    return F.format_string(REVIEW_URL, review_id)


def short_id(url: Column) -> Column:
    """The 14 letters after ``view_`` of an address; the address itself without it."""
    return F.when(F.contains(url, F.lit("view_")), F.substring(F.element_at(F.split(url, "view_"), 2), 1, 14)).otherwise(url)


def sorted_tags(text: Column, pattern: str) -> Column:
    """The sorted distinct matches of a pattern."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))


def pages_of(answers: DataFrame, most: int = 10) -> DataFrame:
    """(series, page) of the pages to ask for, from the first answer's (series, pagecount): the rest, ``most`` at most.

    One row per page, so that a source reads them side by side.
    """
    last = F.least(F.col("pagecount"), F.lit(most))
    return answers.select("series", F.explode(F.when(last >= 2, F.sequence(F.lit(2), last)).otherwise(F.array().cast("array<int>"))).alias("page"))


def reviewed_trims(groups: DataFrame, pattern: str) -> DataFrame:
    """(spec_id, name, reviews) of the nested groups (specgroup of speclist) whose name matches and that have reviews."""
    rows = groups.select(F.explode("specgroup").alias("g")).select(F.explode("g.speclist").alias("s")).select("s.*")
    return rows.where(F.col("specname").rlike(pattern) & (F.col("koubeicount") > 0)).select(F.col("specid").alias("spec_id"), F.col("specname").alias("name"), F.col("koubeicount").alias("reviews"))
