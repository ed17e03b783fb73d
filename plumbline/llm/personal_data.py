"""Personal data: base patterns as seeds, and a bootstrapped extraction that learns where identifiers stand. DataFrame
functions only.

Base spans are the leftmost matches, not overlapping within their kind, of four patterns (email, ip, card, phone) that pass
their kind's test; a match that fails is dropped. They seed the bootstrap:

- a candidate is anything shaped like an identifier that no base span touches: a mail address without a top-level domain, with
  letters beyond ASCII or with `[at]`, a number of six digits or more, an address of hexadecimal groups;
- a lexical pattern is what stands before an identifier: the last word, or the last two, with the marks that follow;
- patterns and the identifiers (instances) seen after them form a graph, pre-aggregated to distinct edges. A pattern's
  confidence for a kind is the confidence of its instances, summed, over their number and one; an instance that is no seed has
  the noisy-or of its confident patterns. ROUNDS rounds of joins and sums spread confidence from the seeds;
- a pattern counts when MIN_SEEDS confident instances, a confidence of PATTERN and its words' own use support it: of all
  places in the corpus where these words stand, SPECIFIC at least must be before an identifier. So `the` never becomes one;
- a candidate is taken when its value is a seed elsewhere, or when it stands after a confident pattern of a kind that its
  shape allows and its own confidence reaches INSTANCE.

The patterns are written so that a scan is linear: runs are possessive and start where their run starts, which alters no
match. Places are code points from 0, ends exclusive.

Defined cases: null and empty text has no spans; rows that repeat (doc_id and text) have the same; texts without identifiers
cost a test each and are not shuffled; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import bounded_broadcast, materialize, release, row_hash

KINDS = ("email", "ip", "card", "phone")
ROUNDS, MIN_SEEDS, PATTERN, INSTANCE, SPECIFIC = 3, 3, 0.7, 0.75, 0.1
#: Characters before a match that its context is taken from; longest word of a context.
NEAR, WORD = 80, 30

_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns; \G lets a run start where the last match ended.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
IP_VALID = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"

_MAIL_CHARS = r"[^\s@<>()\[\]{}\"',;:|=]"
#: Shapes of candidates, one alternative each: mail addresses, mail addresses with a bracketed at, numbers in groups like a
#: telephone's, hexadecimal groups, other numbers.
CANDIDATE = "|".join(
    [
        rf"(?<!{_MAIL_CHARS}){_MAIL_CHARS}++@{_MAIL_CHARS}*+(?<=[\p{{L}}\p{{N}}])",
        rf"(?<!{_LOCAL}){_LOCAL}++\x20?[\[({{]\x20?(?i:at)\x20?[\])}}]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({{]\x20?(?i:dot)\x20?[\])}}]\x20?)[A-Za-z0-9-]++)*+",
        r"(?<![\p{L}\p{N}])\+?[0-9]{0,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\p{L}\p{N}])",
        r"(?<![\p{L}\p{N}:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![\p{L}\p{N}:])",
        r"(?<![\p{L}\p{N}])\+?\(?[0-9](?:[\x20().\-/]{0,2}+[0-9]){5,24}+(?![\p{L}\p{N}]|[\x20().\-/]{1,2}[0-9])",
    ]
)
#: The end of the text before a match: a word before, the last word with a letter, marks without letters.
CONTEXT = r"(?:(\S{1,30})\s+)?(?<!\S)(\S*\p{L}\S*)(\s*[^\s\p{L}]{0,6})$"


def _parts(text: Column, kind: str, pattern: str, can: Column) -> Column:
    """An element for every match and the piece of text before it, the last piece without a match."""
    pieces = F.transform(F.split(text, pattern), lambda p: F.struct(F.length(p).cast("long").alias("n"), F.right(p, F.lit(NEAR)).alias("tail")))
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"), pieces.alias("piece"))
    out = F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x["value"].alias("value"), x["piece"]["n"].alias("n"), x["piece"]["tail"].alias("tail")))
    out = F.filter(out, lambda x: x["value"].isNotNull())
    return F.when(can & text.rlike(pattern), out)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits has a sound check digit."""
    turned, total = F.reverse(digits), F.lit(0)
    for place in range(19):
        d = F.coalesce(F.substring(turned, place + 1, 1).try_cast("int"), F.lit(0))
        total = total + (d if place % 2 == 0 else F.floor(2 * d / 10).cast("int") + F.pmod(2 * d, F.lit(10)))
    return F.pmod(total, F.lit(10)) == 0


def valid(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    return (
        F.when(kind == "ip", value.rlike(IP_VALID))
        .when(kind == "card", F.when(n.between(14, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(True)
    )


def _shape_kinds(value: Column) -> Column:
    """Kinds that a candidate's shape allows."""
    n = F.length(_digits(value))
    return (
        F.when(value.rlike(r"@|(?i)[\[({]\x20?at\x20?[\])}]"), F.array(F.lit("email")))
        .when(value.rlike(r":|^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), F.array(F.lit("ip")))
        .otherwise(F.filter(F.array(F.when(n.between(12, 19), "card"), F.when(n.between(6, 15), "phone")), lambda k: k.isNotNull()))
    )


def _instance(value: Column) -> Column:
    """An identifier however its digits are grouped."""
    return F.when(value.rlike("[@A-Za-z]"), F.lower(value)).otherwise(F.regexp_replace(value, r"[\s()/\-]", ""))


def matches(docs: DataFrame) -> DataFrame:
    """row, kind (of KINDS, or `?` for candidates), start, end, value and its context (w2, w1, marks); base matches that fail
    their kind's test and candidates that touch a base span are left out."""
    text, digit = F.col("text"), F.col("text").rlike("[0-9]")
    can = {"email": text.contains("@"), "ip": digit, "card": digit, "phone": text.contains("+")}
    parts = [_parts(text, k, BASE[k], can[k]) for k in KINDS] + [_parts(text, "?", CANDIDATE, digit | text.rlike(r"@|(?i)[\[({]\x20?at\x20?[\])}]"))]
    none = F.array().cast("array<struct<kind:string,at:int,value:string,n:bigint,tail:string>>")
    rows = docs.select(row_hash(F.col("doc_id").cast("long"), text).alias("row"), F.explode(F.concat(*(F.coalesce(p, none) for p in parts))).alias("p"))
    rows = rows.select("row", "p.*").repartition("row").dropDuplicates(["row", "kind", "at"])
    w = Window.partitionBy("row", "kind").orderBy("at")
    size = F.length("value").cast("long")
    rows = rows.withColumn("end", F.sum(F.col("n") + size).over(w)).withColumn("start", F.col("end") - size)
    near = F.concat(F.when(F.col("n") < NEAR, F.lag(F.right("value", F.lit(NEAR)), 1, "").over(w)).otherwise(""), "tail")
    rows = rows.withColumn("near", F.right(near, F.lit(NEAR))).where(F.when(F.col("kind") == "?", F.size(_shape_kinds(F.col("value"))) > 0).otherwise(valid(F.col("kind"), F.col("value"))))
    base = F.col("kind") != "?"
    first = F.when(base, 0).otherwise(1)
    before = F.max(F.when(base, F.col("end"))).over(Window.partitionBy("row").orderBy("start", first).rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("row").orderBy(F.col("start").desc(), first.desc()).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("free", (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))).where(base | F.col("free"))
    context = {name: F.lower(F.regexp_extract("near", CONTEXT, k)) for k, name in ((1, "w2"), (2, "w1"), (3, "marks"))}
    return rows.select("row", "kind", "start", "end", "value", *(c.alias(k) for k, c in context.items()))


def _patterns() -> Column:
    """The patterns of a match: (words, w2, w1, marks), w2 null in that of one word."""
    marks = F.regexp_replace("marks", r"\s+", " ")
    one = F.struct(F.lit(None).cast("string").alias("w2"), F.col("w1").alias("w1"), marks.alias("marks"))
    two = F.struct(F.col("w2").alias("w2"), F.col("w1").alias("w1"), marks.alias("marks"))
    fits = (F.length("w1") > 0) & (F.length("w1") <= WORD)
    return F.filter(F.array(F.when(fits, one), F.when(fits & (F.length("w2") > 0), two)), lambda p: p.isNotNull())


def _uses(docs: DataFrame, asked: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """(w2, w1, uses): how often the corpus has each word of words (w1; w2 is null), and each pair of words of asked (w2, w1).
    Other pairs with the same last word are counted together, so that only what is asked for is shuffled."""
    w = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), "")
    pairs = docs.select(F.explode(F.arrays_zip(F.concat(F.array(F.lit("")), w).alias("w2"), w.alias("w1"))).alias("p")).select("p.*")
    pairs = pairs.where("w1 is not null").join(bounded_broadcast(words, n), "w1", "left_semi")
    asked = materialize(asked.where("w2 is not null").select("w2", "w1", F.lit(True).alias("asked")).distinct(), "pii-asked")
    pairs = pairs.join(bounded_broadcast(asked, asked.count()), ["w2", "w1"], "left")
    pairs = pairs.groupBy(F.when(F.col("asked"), F.col("w2")).alias("w2"), "w1").agg(F.count(F.lit(1)).alias("uses"))
    pairs = materialize(pairs, "pii-pairs")
    one = pairs.groupBy("w1").agg(F.sum("uses").alias("uses")).select(F.lit(None).cast("string").alias("w2"), "w1", "uses")
    return pairs.where("w2 is not null").unionByName(one)


def bootstrap(docs: DataFrame, found: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(patterns, instances) after the rounds: pattern, kind, p of confident patterns; value, kind, c of all that have any."""
    spark = docs.sparkSession
    base = F.col("kind") != "?"
    seen = found.select(_instance(F.col("value")).alias("value"), "kind", _shape_kinds(F.col("value")).alias("kinds"), F.explode(_patterns()).alias("pattern"))
    seeds = materialize(found.where(base).select(_instance(F.col("value")).alias("value"), "kind").distinct(), "pii-seeds")
    edges = seen.groupBy("pattern", "value", "kind").agg(F.count(F.lit(1)).alias("times"), F.first("kinds").alias("kinds"))
    edges = materialize(edges, "pii-all-edges")
    backed = edges.where(base).groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_SEEDS).select("pattern").distinct()
    stats = edges.groupBy("pattern").agg(F.sum("times").alias("times")).join(edges.select("pattern", "value").distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "pattern")
    stats = materialize(stats.join(backed, "pattern"), "pii-backed")
    words = materialize(stats.where(~F.col("pattern.marks").eqNullSafe("")).select(F.col("pattern.w1").alias("w1")).distinct(), "pii-words")
    n_words = words.count()
    if n_words:
        uses = materialize(_uses(docs, stats.select("pattern.*"), words, n_words), "pii-uses")
    else:
        uses = spark.createDataFrame([], "w2 string, w1 string, uses long")
    stats = stats.join(uses, F.col("pattern.w1").eqNullSafe(uses["w1"]) & F.col("pattern.w2").eqNullSafe(uses["w2"]), "left")
    stats = stats.where((F.col("pattern.marks") == "") | (F.col("times") >= SPECIFIC * F.col("uses"))).select("pattern", "n")
    stats = materialize(stats, "pii-patterns")
    n_patterns = stats.count()
    kept = materialize(edges.join(bounded_broadcast(stats, n_patterns), "pattern").select("pattern", "value", "kinds", "n").dropDuplicates(["pattern", "value"]), "pii-edges")
    loose = materialize(kept.join(seeds.select("value").distinct(), "value", "left_anti").select("pattern", "value", F.explode("kinds").alias("kind")), "pii-loose")
    sure = seeds.withColumn("c", F.lit(1.0))
    instances, old = sure, []
    for _ in range(rounds):
        scored = kept.join(instances, "value").groupBy("pattern", "kind").agg(F.sum("c").alias("sum"), F.first("n").alias("n"))
        scored = scored.withColumn("p", F.col("sum") / (F.col("n") + 1)).where((F.col("sum") >= MIN_SEEDS) & (F.col("p") >= PATTERN))
        patterns = materialize(scored.select("pattern", "kind", "p"), "pii-scores")
        few = bounded_broadcast(patterns, patterns.count())
        guessed = loose.join(few, ["pattern", "kind"]).groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("p"))))).alias("c"))
        instances = materialize(sure.unionByName(guessed), "pii-instances")
        old += [patterns, instances]
    release(edges, words, kept, loose, *old[:-2])
    return patterns, instances


def find(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """row (row_hash of doc_id and text), kind, start, end, value, base, confidence of every span in docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    found = materialize(matches(docs), "pii-matches")
    patterns, instances = bootstrap(docs, found, rounds)
    base = found.where(F.col("kind") != "?").select("row", "kind", "start", "end", "value", F.lit(True).alias("base"), F.lit(1.0).alias("confidence"))
    loose = found.where(F.col("kind") == "?").select("row", "start", "end", "value", _instance(F.col("value")).alias("instance"), _shape_kinds(F.col("value")).alias("kinds"), _patterns().alias("patterns"))
    loose = materialize(loose.join(instances.withColumnRenamed("value", "instance").where(F.col("c") >= INSTANCE), "instance").where(F.array_contains("kinds", F.col("kind"))), "pii-likely")
    n = patterns.count()
    placed = loose.where("c < 1").select("row", "start", "end", "value", "kind", "c", F.explode("patterns").alias("pattern")).join(bounded_broadcast(patterns, n), ["pattern", "kind"], "left_semi")
    more = loose.where("c >= 1").select("row", "start", "end", "value", "kind", "c").unionByName(placed.select("row", "start", "end", "value", "kind", "c"))
    more = more.groupBy("row", "start", "end", "value").agg(F.max_by("kind", F.struct("c", "kind")).alias("kind"), F.max("c").alias("confidence"))
    more = more.select("row", "kind", "start", "end", "value", F.lit(False).alias("base"), "confidence")
    return base.unionByName(more)


def digest(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_<kind>, base_sha256, spans: one row for each of docs, from the spans of find."""
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    per_row = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", number.alias("number"), "end", "kind", "base"))).alias("all"))  # of one document
    rows = docs.select("doc_id", row_hash(F.col("doc_id").cast("long"), F.col("text")).alias("row")).join(per_row, "row", "left")
    every = F.coalesce(F.col("all"), F.array().cast("array<struct<start:bigint,number:bigint,end:bigint,kind:string,base:boolean>>"))
    first = F.filter(every, lambda s: s["base"])

    def line(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    kinds = F.transform(first, lambda s: s["kind"])
    counts = [(F.size(first) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(line(first).cast("binary"), 256).alias("base_sha256"), line(every).alias("spans"))
