"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame functions only.

A candidate is a run of at least MIN_LENGTH characters of a credential's alphabet, taken with the two words before it, which
may be a candidate themselves, and the name that touches it (name="value"). A run name=value gives the value, its name goes
to the context. What is assigned to a credential's name is a candidate from NAMED_LENGTH characters on.
The forest (Spark ML, trained on labelled findings) looks at the candidate's length, its character transitions, the part of
it that the corpus' own words cover, whether it stands in a path or address, and the words beside it. Without
findings labelled by people, it is trained on labelled_findings: TRAIN_ROWS findings made up by Spark, half of them secrets
of common forms where they are usually written, half of them what is often taken for one (checksums, ids, paths, slugs, long
words, numbers). A finding's label is the kind it was made as, not a rule over the features.

The dictionary holds every word that at least MIN_COUNT places of the corpus have, counted over all texts. A frequent
candidate is judged once: findings are grouped by candidate and context before features are made.

Defined cases: null and empty text has no findings; rows that repeat find the same; findings that repeat in a text are one
row with `times`; when the labels hold one class only, it is everybody's verdict; an empty table gives an empty result;
other columns are ignored. `start` is the place of the first occurrence, from 1.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, row_hash

MIN_LENGTH, MIN_COUNT = 16, 5
TRAIN_ROWS, TREES, DEPTH = 20_000, 20, 6
#: A named value is a candidate from so many characters on.
NAMED_LENGTH = 8
#: Names that credentials are assigned to, and words of ordinary identifiers. `_` and `-` are borders.
NAMES = r"(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|pwd|credential|auth(?:orization)?|bearer|private[_-]?key)"
CREDENTIAL = rf"(?i)(?<![A-Za-z0-9]){NAMES}(?![A-Za-z0-9])"
IDENTIFIER = r"(?i)(?<![A-Za-z0-9])(?:commit|sha(?:1|256)?|md5|checksum|digest|hash|revision|uuid|guid|id|version|build|example|sample|placeholder)(?![A-Za-z0-9])"
ALPHABET = r"[A-Za-z0-9+/_=\-]"
#: A credential's name with what may follow it before the sign of an assignment.
_NAMED = rf"(?<![A-Za-z0-9])(?i:{NAMES})(?![A-Za-z0-9])[A-Za-z0-9_.\-]{{0,24}}[\\'\"`\]]{{0,4}}\s{{0,3}}"
#: A candidate: a whole run of the alphabet, long enough or else assigned to a credential's name: name=value in the run, or
#: name and sign before it. The look-behinds are bounded and the counts possessive, so a scan is linear.
CANDIDATE = (
    rf"(?<!{ALPHABET})(?:{ALPHABET}{{{MIN_LENGTH},}}+"
    rf"|(?=[A-Za-z0-9+/_\-]{{3,}}+=)(?=[A-Za-z0-9+/_\-]{{0,9}}?(?<![A-Za-z0-9])(?i:{NAMES})(?![A-Za-z0-9])[A-Za-z0-9+/_\-]{{0,9}}={{1,2}}[A-Za-z0-9+/_\-]{ALPHABET}{{{NAMED_LENGTH - 1}}}){ALPHABET}++"
    rf"|(?=={{1,2}}[A-Za-z0-9+/_\-]{ALPHABET}{{{NAMED_LENGTH - 1}}})(?<={_NAMED}){ALPHABET}++"
    rf"|(?={ALPHABET}{{{NAMED_LENGTH}}})(?<=[=:][\s>\\'\"`]{{0,6}})(?<={_NAMED}[=:]{{1,2}}>?\s{{0,3}}[\\'\"`]{{0,3}}){ALPHABET}++)"
)
#: A run that holds a name, the sign and a value.
ASSIGNMENT = r"^([^=]*)(=+)([^=].*)$"
#: The end of the text before a candidate: up to two words, and what touches the candidate: an assigned name, marks.
CONTEXT = r"((?:[^\s]{1,40}\s+){0,2}(?:[^\sA-Za-z0-9]{0,8}[A-Za-z0-9+/_.\-]{1,40}(?=[^\sA-Za-z0-9]*[=:]))?[^\sA-Za-z0-9]{0,8})$"
#: Characters before a candidate that can hold its context.
CONTEXT_LENGTH = 120

FEATURES = ["length", "digits", "uppers", "switches", "case_switches", "familiar", "hex", "distinct", "covered", "in_path", "names_credential", "names_other", "assigned", "quoted"]


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, context, candidate, times, start), one row per document and distinct candidate with its context.

    The candidates are the separators of a split, so piece i is the text between candidates i - 1 and i.
    """
    found = docs.where(F.col("text").rlike(CANDIDATE)).withColumn("row", row_hash(F.col("doc_id"), F.col("text")))
    parts = F.arrays_zip(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("candidate"), F.transform(F.split("text", CANDIDATE), _tail).alias("before"))
    found = found.select("doc_id", "row", F.posexplode(parts).alias("at", "part")).where("part.candidate is not null")
    found = found.select("doc_id", "row", "at", "part.candidate", "part.before.tail", "part.before.n").repartition("row").dropDuplicates(["row", "at"])
    w = Window.partitionBy("row").orderBy("at")
    start = F.sum(F.col("n") + F.length("candidate")).over(w) - F.length("candidate") + 1
    near = F.concat(F.when(F.col("n") < CONTEXT_LENGTH, F.lag("candidate", 1, "").over(w)).otherwise(F.lit("")), "tail")
    found = found.select("doc_id", F.col("candidate").alias("run"), near.alias("near"), start.alias("start"))
    found = found.withColumns({name: F.regexp_extract("run", ASSIGNMENT, k) for k, name in ((1, "name"), (2, "sign"), (3, "value"))})
    found = found.withColumn("context", _context(F.col("near"))).withColumn("with_name", _context(F.concat("near", "name", "sign")))
    # a name is no candidate itself, unless it is long and no credential's name; a short value needs such a name
    named = F.when(F.length("name") >= MIN_LENGTH, F.col("name").rlike(CREDENTIAL)).otherwise(F.col("with_name").rlike(CREDENTIAL))
    split = (F.length("value") >= MIN_LENGTH) & (F.length("name") < MIN_LENGTH) | (F.length("value") >= NAMED_LENGTH) & named
    found = found.select(
        "doc_id",
        F.when(split, F.col("with_name")).otherwise(F.col("context")).alias("context"),
        F.when(split, F.col("value")).otherwise(F.col("run")).alias("candidate"),
        F.when(split, F.col("start") + F.length("name") + F.length("sign")).otherwise(F.col("start")).alias("start"),
    )
    return found.groupBy("doc_id", "context", "candidate").agg(F.count(F.lit(1)).alias("times"), F.min("start").alias("start"))


def _context(near: Column) -> Column:
    return F.regexp_extract(F.right(near, F.lit(CONTEXT_LENGTH)), CONTEXT, 1)


def _tail(piece: Column) -> Column:
    return F.struct(F.right(piece, F.lit(CONTEXT_LENGTH)).alias("tail"), F.length(piece).cast("long").alias("n"))


def dictionary(docs: DataFrame) -> DataFrame:
    """Words of three letters or more that the corpus has at least MIN_COUNT times, in lower case."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+")).alias("word"))
    return words.where(F.length("word") >= 3).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT).select("word")


def transitions(words: DataFrame) -> dict[str, float]:
    """Log10 probability of a letter after another in the words of the corpus, for pairs of a-z, 26 * 26 at most; pairs that
    the words lack are smoothed by half a count."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr(F.col("word"), i, F.lit(2))))
    pairs = words.where(F.length("word") > 1).select(pair.alias("pair")).where(F.col("pair").rlike("^[a-z]{2}$"))
    n = {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    total = {a: sum(n.get(a + b, 0) for b in letters) for a in letters}
    return {a + b: math.log10((n.get(a + b, 0) + 0.5) / (total[a] + 13)) for a in letters for b in letters}


def _familiar(c: Column, odds: dict[str, float]) -> Column:
    """Mean log probability of the letter pairs of a candidate; 0 where it has none."""
    known = F.create_map(*(F.lit(x) for item in sorted(odds.items()) for x in item))
    low = F.lower(c)
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.element_at(known, F.substr(low, i, F.lit(2))))
    each = F.filter(each, lambda v: v.isNotNull())
    return F.coalesce(F.aggregate(each, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(each), F.lit(0)), F.lit(0.0))


def _number(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def features(pairs: DataFrame, words: DataFrame, odds: dict[str, float] | None = None) -> DataFrame:
    """pairs (candidate, context, ...) with one column of doubles for each of FEATURES. odds: transitions of the words, where
    they are known already."""
    odds = transitions(words) if odds is None else odds
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    runs = pairs.select("candidate").distinct().withColumn("word", F.explode(F.array_distinct(F.split(F.lower("candidate"), r"[^\p{L}]+"))))
    covered = runs.where(F.length("word") >= 3).join(words, "word").groupBy("candidate").agg(F.sum(F.length("word")).cast("double").alias("covered_letters"))
    out = pairs.join(covered, "candidate", "left")
    return out.select(
        *pairs.columns,
        n.alias("length"),
        (F.regexp_count(c, F.lit("[0-9]")) / n).alias("digits"),
        (F.regexp_count(c, F.lit("[A-Z]")) / n).alias("uppers"),
        (F.regexp_count(c, F.lit("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")) / n).alias("switches"),
        (F.regexp_count(c, F.lit("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])")) / n).alias("case_switches"),
        _familiar(c, odds).alias("familiar"),
        _number(c.rlike("^[0-9a-f]+$|^[0-9A-F]+$")).alias("hex"),
        (F.size(F.array_distinct(F.split(c, ""))) / n).alias("distinct"),
        F.least(F.lit(1.0), F.coalesce(F.col("covered_letters"), F.lit(0.0)) / n).alias("covered"),
        _number(F.col("context").rlike(r"(?:/|://|www\.|\.)[^\s]*$") | c.rlike("/[^/]*/")).alias("in_path"),
        _number(F.col("context").rlike(CREDENTIAL)).alias("names_credential"),
        _number(F.col("context").rlike(IDENTIFIER)).alias("names_other"),
        _number(F.col("context").rlike(r"[=:]>?\s*[\\'\"`]{0,3}$")).alias("assigned"),
        _number(F.col("context").rlike(r"['\"`]$")).alias("quoted"),
    )


#: Where secrets and other findings of labelled_findings stand. {n}: a credential's name.
_SECRET_PLACES = ('{n} = "', "{n}: ", '{n}="', "{n}=", 'set {n} "', '"{n}": "', "export {n}=", "your {n} is ", "{n} => '", "use ", "here: ")
_OTHER_PLACES = ("commit ", "the word ", "sha256: ", "id = ", "checksum=", "see https://host.example/", "in /usr/lib/", "version ", "and then ", "", "| ", 'uuid: "', "number ", "no token but ", "file ")
_CREDENTIALS = ("token", "api_key", "API_KEY", "secret", "password", "access_key", "AWS_SECRET_ACCESS_KEY", "github_token", "auth", "client-secret", "private_key", "passwd")
_STEMS = ("on", "re", "the", "tion", "ment", "ing", "er", "keit", "heit", "ver", "aus", "que", "able", "ound", "pre", "sch", "ado", "ent", "lich", "ess")


def labelled_findings(spark: SparkSession, rows: int = TRAIN_ROWS, seed: str = "findings") -> DataFrame:
    """(candidate, context, label): findings made up from digests of their numbers, so that reruns agree."""
    base = spark.range(rows).select("id", (F.col("id") % 2).cast("double").alias("label"))

    def draw(kind: str, n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(f"{seed}:{kind}"), "id"), F.lit(n)).cast("int")

    def digest(kind: str) -> Column:
        return F.sha2(F.concat(F.lit(f"{seed}:{kind}:"), F.col("id").cast("string")), 512)

    def pick(kind: str, values: tuple[str, ...]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), draw(kind, len(values)) + 1)

    hexes = digest("hex")
    mixed = F.regexp_replace(F.base64(F.unhex(digest("mixed"))), r"[+/=\s]", "")
    upper = F.upper(F.regexp_replace(F.base64(F.unhex(digest("upper"))), r"[^A-Za-z0-9]", ""))
    words = F.array_join(F.transform(F.sequence(F.lit(0), draw("n", 5) + 3), lambda k: F.element_at(F.array(*map(F.lit, _STEMS)), F.pmod(F.xxhash64(F.lit(seed), "id", k), F.lit(len(_STEMS))).cast("int") + 1)), "")
    slug, path = F.regexp_replace(words, "(?<=.{4})(?=.{3})", "-"), F.regexp_replace(words, "(?<=[aeiou])(?=.{2})", "/")
    digits = F.regexp_replace(F.concat(hexes, hexes), "[^0-9]", "")
    uuid = F.regexp_replace(F.substring(hexes, 1, 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    size = draw("size", 33) + 16
    secrets = [mixed.substr(F.lit(1), size), hexes.substr(F.lit(1), size), F.concat(F.lit("AKIA"), upper.substr(1, 16)), F.concat(F.lit("ghp_"), mixed.substr(1, 36)), F.concat(F.lit("sk-"), mixed.substr(1, 40)), mixed.substr(F.lit(1), draw("short", 9) + 8), mixed.substr(F.lit(1), size)]
    others = [words, slug, path, digits.substr(F.lit(1), draw("digits", 13) + 12), uuid, hexes.substr(1, 40), F.initcap(words), words, F.upper(words), F.upper(slug), F.concat(words, F.lit("_"), F.col("id").cast("string")), hexes.substr(1, 32)]

    def choose(kind: str, values: list[Column]) -> Column:
        return F.element_at(F.array(*values), draw(kind, len(values)) + 1)

    named = F.regexp_replace(pick("where", _SECRET_PLACES), r"\{n\}", F.concat(F.lit(""), pick("name", _CREDENTIALS)))
    before = F.concat(pick("before", ("some words ", "", "and ", "the text. ", "of a ")), F.when(F.col("label") == 1, named).otherwise(pick("other", _OTHER_PLACES)))
    out = base.select(F.when(F.col("label") == 1, choose("secret", secrets)).otherwise(choose("plain", others)).alias("candidate"), _context(before).alias("context"), "label")
    return out.where(F.length("candidate") >= NAMED_LENGTH)


def scan(docs: DataFrame, label: Column | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, start, candidate, context, times, probability, is_secret for every finding in docs (doc_id, text).

    label: from the columns candidate, context and FEATURES, 1, 0 or null (not labelled), where the corpus' own findings are
    labelled; else the forest is trained on labelled_findings.
    """
    docs = docs.select("doc_id", "text")
    found = materialize(findings(docs), "secret-findings")
    pairs = found.groupBy("candidate", "context").agg(F.sum("times").alias("seen"))
    words = materialize(dictionary(docs), "secret-dictionary")
    odds = transitions(words)
    pairs = materialize(features(pairs, words, odds), "secret-features")
    if label is None:
        labelled = features(labelled_findings(docs.sparkSession, train_rows), words, odds)
    else:
        labelled = pairs.withColumn("label", label.cast("double")).where("label is not null")
    labelled = materialize(labelled.select("candidate", "context", "label", *FEATURES), "secret-labelled")
    n = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        judged = pairs.withColumn("probability", F.lit(float(next(iter(n), 1.0))))
    else:
        pick = F.pmod(F.xxhash64("candidate", "context"), F.lit(1 << 40)) / float(1 << 40)
        share = F.when(F.col("label") == 1, min(1.0, train_rows / 2 / n[1.0])).otherwise(min(1.0, train_rows / 2 / n[0.0]))
        vector = VectorAssembler(inputCols=FEATURES, outputCol="vector")
        sample = vector.transform(labelled.where(pick < share))
        forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=11).fit(sample.select("vector", "label"))
        judged = forest.transform(vector.transform(pairs)).withColumn("probability", vector_to_array("probability")[1])
    judged = judged.select("candidate", "context", "probability")
    out = found.join(judged, ["candidate", "context"])
    return out.select("doc_id", "start", "candidate", "context", "times", "probability", (F.col("probability") >= 0.5).alias("is_secret"))
