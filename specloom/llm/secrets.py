"""Secret scans: candidates by shape, false positives removed by a random forest; DataFrame functions only."""

from __future__ import annotations

import math
import random

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, free, settled, table, unit

#: Findings that the forest is trained on, about and at most.
MAX_FINDINGS = 20_000
TREES, DEPTH, SEED = 20, 6, 11
#: Share of the weight in training that the stated findings have against those of the documents.
STATED_SHARE = 0.5
#: Score from which a candidate is a secret.
THRESHOLD = 0.5
#: Rows that may be broadcast, and bytes.
FEW, FEW_BYTES = 100_000, 16_000_000
#: A word is in the dictionary if this share of all documents has it, two at least.
DICTIONARY_SHARE = 1e-4

#: Fixed values. Names that stand before a secret.
NAMES = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)"
#: Fixed values. Shapes that only credentials of known issuers have.
ISSUED = r"(?:AKIA|ASIA)[A-Z2-7]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.|AIza[A-Za-z0-9_-]{35}"
#: A run of the characters that keys are made of.
RUN = r"[A-Za-z0-9+/_=.~-]{8,}"
#: Candidate words: a long run with a digit or mixed case, or a name, a sign and a value.
_SHAPE = r"[A-Za-z0-9+/_=~-]{16}"
_MIXED = "[0-9]|[a-z][A-Z]"
_NAMED = NAMES + r"['\"]?\s*[=:]\s*\S{6}"
#: What a name and a sign give: up to a blank, a quote or what parts fields.
_GIVEN = NAMES + r"['\"]?\s*[=:]\s*['\"]?([^\s'\"&,;<>]{6,})"
#: Runs in a word, parted at signs of equality but for padding.
_RUNS = r"[A-Za-z0-9+/_.~-]{16,}={0,2}"

#: Transitions between kinds of characters: a lower-case, B upper-case, 1 digit, - other; their shares are features.
TRANSITIONS = ["aa", "aB", "Ba", "BB", "a1", "1a", "B1", "1B", "11", "a-", "-a"]
#: Fixed values. Words of values that stand for a secret and are none, and of the text around such values.
STAND_INS = r"(?i)example|sample|dummy|placeholder|change.?me|your|insert|redact|replace|x{4,}|\*{3,}|\.{3}|\$\{|\{\{|test|fake|none|null|string|undefined|password|passwd|secret|token"
AROUND = r"(?i)example|sample|dummy|placeholder|fake|documentation|template"
#: Fixed values. Names and ways in which stated findings are given, values that are no secrets, and beginnings and lengths of issued keys.
STATED_NAMES = ["password", "passwd", "secret", "token", "api_key", "auth", "access_key", "client_secret"]
STATED_WAYS = ["{name}={value}", "{name}: {value}", 'set {name} = "{value}" here', '{{"{name}":"{value}"}}', "export {name}='{value}'", "url?{name}={value}&x=1"]
STATED_FALSE = [
    "string", "changeme", "changeme123", "change-me-now", "your-password-here", "your_api_key", "YOUR_TOKEN_HERE", "yourpassword", "example", "examplekey", "sample-secret", "dummy-value", "placeholder", "xxxxxxxx", "XXXXXXXXXXXXXXXX",
    "********", "........", "password", "password123", "mypassword", "secret", "supersecret", "secretkey", "token123", "testtest", "test1234", "testpassword", "undefined", "nullnull", "insert_key_here", "replace-this", "redacted", "${PASSWORD}",
    "{{token}}", "null,none", "required", "optional", "boolean", "integer", "function", "constant", "settings", "username", "process.env.API_KEY", "os.environ", "config.password", "request.token", "get_token()", "fake-token-000",
]
STATED_ISSUED = [("AKIA", 16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("ghp_", 36, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), ("sk_live_", 24, "abcdefghijklmnopqrstuvwxyz0123456789"), ("AIza", 35, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")]
STATED_WORDS = ["hunter", "dragon", "summer", "monkey", "purple", "winter", "coffee", "orange"]
FEATURES = ["stand_in", "around", "named", "assigned", "issued", "length", "digits", "uppers", "lowers", "signs", *[f"from_{t.replace('-', 'x')}" for t in TRANSITIONS], "pairs", "distinct", "hexadecimal", "coverage", "quoted", "path", "neighbours"]


def candidates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, then one row per candidate: place (of its word in the text), value, before, after, word.

    A word has as many candidates as values: what each secret's name in it is given, what a name in the two words
    before it is given, each issuer's shape and each long run; the first run of key characters if there are none.
    ``before`` is the text of the two words before it and of its own word up to the value; ``after`` the rest of
    its word and the next word. Texts are read whole.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def hit(w: Column) -> Column:
        return (F.length(w) >= 10) & ((w.rlike(_SHAPE) & w.rlike(_MIXED)) | w.rlike(_NAMED))

    def given(w: Column, last: Column) -> Column:
        return (F.length(w) >= 6) & (last.rlike(r"[=:]['\"]?$") | w.rlike(r"^['\"]?[=:]"))

    def found(words: Column) -> Column:
        near = lambda i: F.coalesce(F.get(words, i - 1), F.lit(""))
        at = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: hit(F.element_at(words, i)) | (given(F.element_at(words, i), near(i - 1)) & F.concat_ws(" ", near(i - 2), near(i - 1), near(i)).rlike(_GIVEN + r"\S*$")))
        return F.transform(
            at,
            lambda i: F.struct(
                i.alias("place"), near(i).alias("word"), F.concat_ws(" ", F.when(i > 2, near(i - 2)), F.when(i > 1, near(i - 1))).alias("left"), F.when(i < F.size(words), near(i + 1)).otherwise("").alias("right")
            ),
        )

    words = F.element_at(F.transform(F.array(F.split(text, BLANK)), found), 1)
    rows = docs.select(*keep, F.explode(words).alias("c"))
    every = lambda pattern, n: F.regexp_extract_all("c.word", F.lit(pattern), F.lit(n))
    spaced = F.regexp_extract(F.concat_ws(" ", "c.left", "c.word"), _GIVEN + r"\S*$", 1)
    runs = F.filter(every(_RUNS, 0), lambda r: r.rlike(_SHAPE))
    runs = F.when(F.col("c.word").rlike(_MIXED), runs).otherwise(F.array().cast("array<string>"))
    values = F.concat(every(_GIVEN, 1), F.array(spaced), every(f"(?:{ISSUED})[A-Za-z0-9_-]*", 0), runs)
    values = F.array_distinct(F.filter(F.transform(values, lambda v: F.regexp_replace(v, r"[.)\]}]+$", "")), lambda v: F.length(v) >= 6))
    tail = F.regexp_replace(F.regexp_extract("c.word", f"({RUN})", 1), "[.]+$", "")
    rows = rows.select(*keep, "c", F.explode(F.when(F.size(values) > 0, values).otherwise(F.array(tail))).alias("value"))
    rows = rows.select(*keep, F.col("c.place").alias("place"), F.col("c.word").alias("word"), "value", F.col("c.left").alias("left"), F.col("c.right").alias("right"))
    at = F.expr("instr(word, value)")
    return rows.where("value <> ''").select(
        *keep, "place", "word", "value", F.concat_ws(" ", "left", F.expr("substring(word, 1, instr(word, value) - 1)")).alias("before"), F.concat_ws(" ", F.expr("substring(word, instr(word, value) + length(value))"), "right").alias("after"), at.alias("at")
    )


def dictionary(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """(piece): the letter runs of candidates that enough documents have as a word (DICTIONARY_SHARE).

    Only words that candidates contain are kept, counted over all documents; a broadcast of few pieces drops the
    others before the count, many pieces are joined after each task has counted its words.
    """
    wanted = settled(pieces.select("piece").distinct())
    few = wanted.count() <= FEW  # pieces have at most 24 letters
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    words = F.array_distinct(F.filter(F.split(text, BLANK), lambda w: w.rlike(r"^[a-z]{4,24}$")))
    every = docs.select(F.explode(words).alias("piece"))
    if few:
        every = every.join(F.broadcast(wanted), "piece", "left_semi")
    counts = every.groupBy("piece").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, DICTIONARY_SHARE * docs.count()))
    return counts.select("piece") if few else counts.join(wanted, "piece", "left_semi").select("piece")


def pair_table(found: DataFrame) -> list[float]:
    """The logarithm of each letter's share after each letter (26 x 26), from the ordinary words around candidates."""
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", "before", "after")), F.lit(r"(?:^| )([a-z]{2,})(?= |$)"), F.lit(1))
    pairs = found.select(F.explode(F.regexp_extract_all(F.array_join(words, " "), F.lit(r"(?=([a-z]{2}))"), F.lit(1))).alias("pair"))
    n = [1.0] * 676
    for pair, count in pairs.groupBy("pair").count().collect():  # 676 rows at most
        n[(ord(pair[0]) - 97) * 26 + ord(pair[1]) - 97] += count
    return [math.log(x / sum(n[i // 26 * 26 : i // 26 * 26 + 26])) for i, x in enumerate(n)]


def featured(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``found`` with f_* columns (FEATURES), which the forest sees, and e_* columns (issued, named, assigned), which label.

    ``docs`` (text) gives the dictionary. Values are read whole; lengths count as logarithms.
    """
    value = F.col("value")
    size = F.greatest(F.length(value), F.lit(1)).cast("double")
    kind = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "1"), "[^aB1]", "-")
    runs = F.regexp_extract_all(F.lower(value), F.lit(r"([a-z]{4,24})"))
    values = settled(found.select("value").distinct().select("value", F.explode(runs).alias("piece")))
    known = dictionary(docs, values).withColumn("hit", F.lit(1))
    covered = values.join(known, "piece", "left").groupBy("value").agg(F.sum(F.when(F.col("hit") == 1, F.length("piece")).otherwise(0)).alias("covered"))
    likely = F.split(F.lit(",".join(f"{x:.4f}" for x in pair_table(found))), ",").cast("array<double>")  # folded to one literal
    pairs = F.regexp_extract_all(F.lower(value), F.lit(r"(?=([a-z]{2}))"), F.lit(1))
    place = lambda p: (F.ascii(p) - 97) * 26 + F.ascii(F.substring(p, 2, 1)) - 97
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / size
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    before, after = F.col("before"), F.col("after")
    columns = {
        "length": F.log2(size),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "signs": share("[^A-Za-z0-9]"),
        **{f"from_{t.replace('-', 'x')}": F.regexp_count(kind, F.lit(f"(?={t})")) / size for t in TRANSITIONS},
        "pairs": F.when(F.size(pairs) > 0, F.aggregate(F.transform(pairs, lambda p: F.get(likely, place(p))), F.lit(0.0), lambda s, x: s + x) / F.size(pairs)).otherwise(F.lit(-5.0)),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(size, F.lit(64.0)),
        "hexadecimal": flag(value.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        "quoted": flag(before.rlike(r"['\"]$") & after.rlike(r"^['\"]")),
        "path": flag(F.concat(before, value).rlike(r"https?:|www\.|\.[a-z]{2,4}/|/\w+/|@|\.(?:com|net|org|html?|php)\b")),
        "neighbours": F.regexp_count(F.regexp_replace(F.concat_ws(" ", before, after), NAMES, ""), F.lit(r"\b[a-z]{2,}\b")).cast("double"),
    }
    evidence = {
        "named": before.rlike(NAMES), "assigned": before.rlike(r"[=:]\s*['\"]?$"), "issued": value.rlike(f"^(?:{ISSUED})"),
        "stand_in": value.rlike(STAND_INS), "around": before.rlike(AROUND) | after.rlike(AROUND),
        "mixed": value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 6),
    }
    columns |= {n: flag(evidence[n]) for n in ("stand_in", "around", "named", "assigned", "issued")}
    rows = found.select("*", *[c.cast("double").alias(f"f_{n}") for n, c in columns.items()], *[flag(c).alias(f"e_{n}") for n, c in evidence.items()])
    rows = rows.join(covered, "value", "left")
    return rows.withColumn("f_coverage", F.coalesce(F.col("covered"), F.lit(0)) / size).drop("covered")


def labelled(rows: DataFrame) -> DataFrame:
    """``rows`` of documents whose label is fairly sure: ``label`` 1 for secrets, 0 for false positives.

    Secrets are values with an issuer's shape or assigned to a secret's name that mix letters and digits and have no word of a
    stand-in, in them or around. False positives are candidates without such a name or shape, and those with a stand-in's word in them.
    All others (passwords of letters, names without an assignment, values amid talk of examples) are left to the forest.
    """
    e = lambda n: F.col(f"e_{n}") == 1
    told = e("issued") | (e("named") & e("assigned"))
    sure = F.when(told & e("mixed") & ~e("stand_in") & ~e("around"), 1.0).when(~told & ~e("named"), 0.0).when(e("stand_in") & ~e("mixed"), 0.0)
    return rows.withColumn("label", sure).where("label is not null")


def stated(spark) -> DataFrame:
    """(text, value, label): stated findings, so that the forest sees what a corpus may lack: stand-ins as they are given and keys
    and passwords made by rule. About 1,600 rows, whatever the input."""
    rnd, rows = random.Random(SEED), []
    letters, hexadecimal = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdef"
    ways = [(name, way) for name in STATED_NAMES for way in STATED_WAYS]
    for n, value in enumerate(STATED_FALSE):
        rows += [(way.format(name=name, value=value), value, 0.0) for name, way in ways[n % 3 :: 3]]
    for n, (name, way) in enumerate(ways * 12):
        word = rnd.choice(STATED_WORDS)
        kinds = [
            "".join(rnd.choices(hexadecimal, k=rnd.choice([12, 18, 32, 40]))), "".join(rnd.choices(letters, k=rnd.choice([8, 16, 24, 44]))), "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=rnd.choice([7, 8, 10, 12]))),
            f"{word}{rnd.randint(1, 99)}{rnd.choice(['pass', '!', '#Zq', rnd.choice(STATED_WORDS)])}", f"{word.title()}-{rnd.choice(STATED_WORDS)}-{rnd.randint(10, 999)}", "".join(rnd.choices(letters[:52], k=rnd.choice([10, 22]))),
        ]
        rows.append((way.format(name=name, value=kinds[n % 6]), kinds[n % 6], 1.0))
    for n in range(160):
        head, size, of = STATED_ISSUED[n % 4]
        true = head + "".join(rnd.choices(of, k=size))
        false = head + (rnd.choice(of) * size if n % 8 < 4 else "".join(rnd.choices(of, k=size - 7)) + ("EXAMPLE" if head == "AKIA" else "example"))
        frame = ["see {} now", "key {}", "key={}", '"id": "{}"'][n // 4 % 4]
        rows += [(frame.format(true), true, 1.0), (frame.format(false), false, 0.0)]
    packed = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(v).alias("_value"), F.lit(x).alias("label")) for t, v, x in rows])
    return spark.range(0, 1, 1, 1).select(F.explode(packed).alias("x")).select("x.*")


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{n}" for n in FEATURES], outputCol="_features").transform(rows)


def train(findings: DataFrame, sure: DataFrame | None = None) -> RandomForestClassificationModel | None:
    """The forest over labelled findings (f_* columns and label); about MAX_FINDINGS of them, picked by hash, and all of ``sure``,
    the stated ones, which have STATED_SHARE of the weight. None if only one class is there."""
    names = [f"f_{x}" for x in FEATURES]
    part = MAX_FINDINGS / max(findings.count(), 1)
    rows = settled(findings.where(unit("value", "before", F.lit(3)) < part).select(*names, "label").withColumn("weight", F.lit(1.0)))
    if sure is not None:
        weight = max(1.0, rows.count() * STATED_SHARE / (1 - STATED_SHARE) / max(sure.count(), 1))
        rows = settled(rows.union(sure.select(*names, "label").withColumn("weight", F.lit(weight))))
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(_assembled(rows.repartition(4, *rows.columns).sortWithinPartitions(*rows.columns)))


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), findings: DataFrame | None = None) -> DataFrame:
    """One row per candidate: ``keep`` columns, place, word, value, score and secret (score >= THRESHOLD).

    Whole texts are read; null and empty texts have no candidates; an empty table gives no rows. Copies of one text
    give the same findings for each copy. Columns of ``docs`` other than ``keep`` and text play no part; ``keep``
    must not have names of this result. The score is the forest's probability and nothing else; evidence such as a secret's
    name before a value is one of its features. ``findings`` (value, label 0 or 1) are labels from elsewhere, used
    instead of ``labelled`` and ``stated``; if they have one class only, all candidates score 0.
    """
    own = free(docs, "stated")
    examples = candidates(stated(docs.sparkSession), ("_value", "label")).where("value = _value").drop("_value").withColumnRenamed("label", own)
    every = candidates(docs, keep).withColumn(own, F.lit(None).cast("double")).unionByName(examples, allowMissingColumns=True)
    rows = settled(featured(settled(every), docs))
    real = rows.where(F.col(own).isNull()).drop(own)
    if findings is not None:
        model = train(real.join(findings.select("value", F.col("label").cast("double").alias("label")).dropDuplicates(["value"]), "value"))
    else:
        model = train(labelled(real), rows.where(F.col(own).isNotNull()).withColumn("label", F.col(own)))
    if model is None:
        out = real.withColumn("score", F.lit(0.0))
    else:
        out = model.transform(_assembled(real)).withColumn("score", vector_to_array("probability")[1])
    return out.select(*keep, "place", "word", "value", "score", (F.col("score") >= THRESHOLD).alias("secret"))


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every found secret replaced by ``mask`` in the word where it was found, n_chars counted anew; all rows and columns stay.

    The same characters elsewhere in the text stay unless they are found there too. Rows are matched by doc_id and the hash of the
    text, so repeated ids with other texts keep their own findings. Null and empty texts stay as they are; an empty table gives none.
    """
    key, many = free(docs, "key"), free(docs, "values")  # names that no column of docs has
    made = F.xxhash64("doc_id", "text").alias(key)
    found = scan(docs.select(made, "text"), (key,)).where("secret")
    one = F.struct("place", "value")
    values = settled(found.groupBy(key).agg(F.array_sort(F.collect_set(one), lambda a, b: F.length(b["value"]) - F.length(a["value"])).alias(many)))
    n, size = values.agg(F.count("*"), F.sum(F.length(F.array_join(F.col(many)["value"], " ")) + 8 * F.size(many))).first()
    few = n <= FEW and (size or 0) <= FEW_BYTES
    rows = docs.withColumn(key, made)
    rows = rows.join(F.broadcast(values) if few else values, key, "left")
    text = F.col("text").cast("string")
    places = F.col(many)["place"]

    def masked(word: Column, i: Column) -> Column:
        here = F.filter(F.col(many), lambda m: m["place"] == i + 1)
        return F.when(F.array_contains(places, i + 1), F.aggregate(here, word, lambda t, m: F.replace(t, m["value"], F.lit(mask)))).otherwise(word)

    between = F.concat(F.regexp_extract_all(text, F.lit(f"({BLANK})"), F.lit(1)), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(F.transform(F.split(text, BLANK), masked), between, lambda word, blank: F.concat(word, blank)), "")
    rows = rows.withColumn("text", F.when(F.col(many).isNull(), F.col("text")).otherwise(whole))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(many).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def op8(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "place", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("length"), "score", "secret")
