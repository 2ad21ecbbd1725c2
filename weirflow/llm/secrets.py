"""Secret scan: base patterns, and character Markov models of random strings against ordinary identifiers.

The models are chains over single characters: how often one character follows another in random strings, and in
ordinary identifiers, both counted over labelled samples and smoothed. A token's log-likelihood ratio is the sum
over its character pairs of the log of the two chances' quotient; tokens at or above a threshold are spans of kind
`markov`. Everything is DataFrame and SQL functions: the two tables of chances make one literal array.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Of the runs [0-9a-f]+ only those of 24 and more count, so the pattern asks for them at once.
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
#: What may be a secret by the models: whole runs over the alphabet. Shorter ones hold too little for the models: when all of them were
#: compared, every other span was of prose, and the time was over its budget (see the README).
LEAST_TOKEN = 16
TOKEN = rf"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{{{LEAST_TOKEN},}}"
#: Matches of a text are placed by runs of this many.
RUN = 128
#: A token counts from this log-likelihood ratio on: it is e^12 times as likely from the model of random strings.
THRESHOLD = 12.0
#: Documents, about, whose words are the sample of ordinary identifiers: those whose keyed hash of the id is below a threshold.
SAMPLE_DOCUMENTS = 1_000
#: Random strings of each format in the sample of secrets.
SAMPLE_RANDOM = 2_000
#: Weight of the smoothing, in pairs.
SMOOTH = 20.0
KINDS = ("assign", "access", "hex", "markov")


def _let(value: Column, body) -> Column:
    """body with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def spans(text: Column, pattern: str, value_group: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points, end exclusive.

    Gaps between matches come from split() with the same pattern, so starts are sums of lengths: first of runs of RUN matches, then
    within each run, so that the time is no square of the number of matches.
    """
    p = F.lit(pattern)
    matches, values = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(value_group))
    empty = F.expr("array()").cast("array<struct<start:int,end:int,value:string>>")
    total = lambda numbers, b: F.aggregate(F.slice(numbers, b * RUN + 1, F.lit(RUN)), F.lit(0), lambda s, n: s + n)

    def placed(x: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(x["values"]) - 1) / RUN).cast("int"))
        begin = F.struct(F.lit(0).alias("at"), F.expr("array()").cast("array<int>").alias("out"))
        step = lambda s, b: F.struct((s["at"] + total(x["gaps"], b) + total(x["lengths"], b)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return _let(F.aggregate(runs, begin, step, lambda s: s["out"]), lambda starts: F.flatten(F.transform(starts, lambda start, b: one_run(x, start, b))))

    def one_run(x: Column, start: Column, b: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            left = s["at"] + F.get(x["gaps"], i)
            right = left + F.get(x["lengths"], i)
            return F.struct(right.alias("at"), F.concat(s["out"], F.array(F.struct(left.alias("start"), right.alias("end"), F.get(x["values"], i).alias("value")))).alias("out"))

        last = F.least(F.size(x["values"]), b * RUN + RUN) - 1
        return F.aggregate(F.sequence(b * RUN, last), F.struct(start.alias("at"), empty.alias("out")), step, lambda s: s["out"])

    lengths = lambda parts: F.transform(parts, F.length)
    found = _let(F.struct(lengths(F.split(text, pattern, -1)).alias("gaps"), lengths(matches).alias("lengths"), values.alias("values")), placed)
    return F.when(F.regexp_like(text, p), found).otherwise(empty)


def random_strings(spark: SparkSession, each: int = SAMPLE_RANDOM) -> DataFrame:
    """(token, secret = true): strings in the formats of keys, from digests of numbers."""
    digest = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256)
    short = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    formats = F.array(F.substring(digest, 1, 40), F.upper(F.substring(F.regexp_replace(short, "[+/]", ""), 1, 24)), short, F.regexp_replace(short, "[+/]", "_"))
    return spark.range(each).select(F.explode(formats).alias("token"), F.lit(True).alias("secret"))


def identifiers(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", most: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(token, secret = false): ordinary strings of three sorts.

    The words of a sample of about `most` documents (their texts stay where they are read; only words are counted), alone and joined as programmers join them; plain numbers, dates, versions
    and numbered names, as many again; and rules of one mark.
    """
    share = most / max(1, docs.count())
    chosen = F.xxhash64(F.col(f"`{id_col}`"), F.lit(8)) < F.lit(int(share * 2**64) - 2**63 if share < 1 else 2**63 - 1)
    sample = docs.where(chosen).select(F.col(f"`{text_col}`").cast("string").alias("t"))
    words = sample.select(F.explode(F.split("t", r"\s+")).alias("w")).select(F.regexp_replace("w", "[^A-Za-z]", "").alias("w")).where("length(w) between 2 and 40").groupBy("w").count()
    forms = F.array(F.col("w"), F.lower("w"), F.concat(F.lit("get_"), F.lower("w"), F.lit("_"), F.lower("w")), F.concat(F.lower("w"), F.initcap("w")), F.concat(F.upper("w"), F.lit("_"), F.upper("w")), F.concat("w", F.lit("."), "w", F.lit("-2024"), F.lit("/"), "w"))
    number = F.pmod(F.xxhash64("id"), F.lit(10**16)).cast("string")
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), (F.col("id") * 7).cast("int")), "yyyy-MM-dd")
    version = F.concat_ws(".", F.col("id") % 30, F.col("id") % 17, F.col("id") % 11)
    counted = F.array(number, number, F.concat(day, F.lit("/"), day), F.concat(F.lit("v"), version, F.lit("-"), version), F.concat(F.lit("item_"), F.col("id"), F.lit("="), F.substring(number, 1, 6)))
    marks = F.transform(F.split(F.lit("+/_=.-"), ""), lambda m: F.repeat(m, 30))
    numbered = docs.sparkSession.range(SAMPLE_RANDOM)
    ordinary = [words.select(forms.alias("t")), numbered.select(counted.alias("t")), docs.sparkSession.range(SAMPLE_RANDOM // 10).select(marks.alias("t"))]
    return ordinary[0].unionByName(ordinary[1]).unionByName(ordinary[2]).select(F.explode("t").alias("token"), F.lit(False).alias("secret"))


def train(samples: DataFrame) -> list[float]:
    """Log quotients of the two chances, for each pair of characters, row by row of the alphabet.

    samples: token, secret. The table of counts that comes to the driver has 2 * |alphabet|^2 rows at most.
    """
    n = len(ALPHABET)
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2))))
    counts = samples.where("length(token) >= 2").select("secret", pair.alias("pair")).where(F.col("pair").rlike("^[A-Za-z0-9+/_=.-]{2}$")).groupBy("secret", "pair").count()
    table = {True: [[0] * n for _ in range(n)], False: [[0] * n for _ in range(n)]}
    for secret, two, count in counts.collect():
        table[bool(secret)][ALPHABET.index(two[0])][ALPHABET.index(two[1])] += count
    chance = {}
    for k, rows in table.items():  # pairs are smoothed toward how often the second character comes at all
        column = [sum(row[j] for row in rows) + 0.5 for j in range(n)]
        alone = [x / sum(column) for x in column]
        chance[k] = [[(x + SMOOTH * a) / (sum(row) + SMOOTH) for x, a in zip(row, alone, strict=True)] for row in rows]
    return [math.log(chance[True][i][j] / chance[False][i][j]) for i in range(n) for j in range(n)]


def ratio(token: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a token over the alphabet."""
    n = len(ALPHABET)
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    table = F.lit(model)
    start = F.struct(F.lit(None).cast("int").alias("before"), F.lit(0.0).alias("sum"))
    step = lambda s, p: F.struct(p.alias("before"), (s["sum"] + F.coalesce(F.get(table, s["before"] * n + p), F.lit(0.0))).alias("sum"))
    return F.aggregate(places, start, step, lambda s: s["sum"])


def scan(docs: DataFrame, model: list[float], text_col: str = "text", threshold: float = THRESHOLD, column: str = "secrets") -> DataFrame:
    """docs with a column of array<struct<start, rank, end, kind>>: all spans, sorted; offsets are in code points.

    Base spans are never dropped. A markov span is a token that no base span overlaps. Null texts count as empty and have
    no spans. The columns of docs stay; one with the name of `column` is replaced.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    kind = lambda found, k: F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(k)).alias("rank"), s["end"].alias("end"), F.lit(k).alias("kind")))
    base = F.concat(
        kind(F.filter(spans(text, ASSIGN, 2), lambda s: F.length(s["value"]) >= LEAST_ASSIGN), "assign"),
        kind(F.filter(spans(text, ACCESS), lambda s: s["end"] - s["start"] >= LEAST_ACCESS), "access"),
        kind(spans(text, HEX), "hex"),
    )
    likely = F.filter(spans(text, TOKEN), lambda t: ratio(t["value"], model) >= threshold)
    b, t = unused(docs, "_base"), unused(docs, "_token")
    found = docs.withColumn(b, base).withColumn(t, likely)
    free = F.filter(t, lambda x: ~F.exists(b, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    every = F.when(F.size(t) > 0, F.array_sort(F.concat(F.col(b), kind(free, "markov")))).otherwise(F.array_sort(b))
    return found.withColumn(column, every).drop(b, t)


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov.

    Null texts count as empty, which have no spans; rows that repeat count each; very long texts are scanned whole; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    model = train(random_strings(docs.sparkSession).unionByName(identifiers(docs)))
    found = scan(docs, model)
    n = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] != "markov")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"), n("markov").alias("n_markov"))


def redact(docs: DataFrame, model: list[float], mark: str = "[SECRET]") -> DataFrame:
    """docs with each span of its text replaced by a mark; overlapping spans get one. Null texts stay null; all columns stay, whatever their names."""
    held = unused(docs, "_secrets")
    found = scan(docs, model, column=held)
    begin = F.struct(F.lit(0).alias("at"), F.expr("array()").cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        piece = F.concat(F.substring("text", s["at"] + 1, x["start"] - s["at"]), F.lit(mark))
        return F.when(fresh, F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(piece)).alias("out"))).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out")))

    text = F.aggregate(held, begin, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring("text", s["at"] + 1, F.length("text"))))
    return found.withColumn("text", F.when(F.size(held) > 0, text).otherwise(F.col("text"))).drop(held)
