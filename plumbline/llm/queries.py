"""Registered queries opN_<name> and their DuckDB SQL: thin digests of the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import brown_lm, exact_dedup, html_extract, jaccard_join, language_id, lexical_search, mixing, packing, personal_data, quality_lm, quality_rules, secret_scan, source_audit
from plumbline.llm.common import documents, materialize

#: Place of the vocabulary used by op1; None: the installed public tokenizers.
VOCABULARY_FILE: str | None = None


def vocabulary() -> str:
    if VOCABULARY_FILE:
        return VOCABULARY_FILE
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(documents(spark, sf_dir), vocabulary())
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules
    out = q.quality_filter(documents(spark, sf_dir).select("doc_id", "text"))
    base = {"n_words": q.n_words(), "word_chars": q.word_chars(), "n_symbols": q.n_symbols(), "n_dup_lines": q.n_dup_lines(), "n_repeat_words": q.n_repeat_words()}
    out = out.select("doc_id", "kept", *(c.alias(k) for k, c in base.items()))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", *base, failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


def _remainder(doc_id: str, of: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(of))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(_remainder("doc_id", 4) == 2, F.lit(False))
    model = language_id.fit(docs.where(~held_out))
    return language_id.predict(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return quality_lm.classify(documents(spark, sf_dir), trusted)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(documents(spark, sf_dir), exact_dedup.arrival_batch(F.col("doc_id")))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(documents(spark, sf_dir))
    return out.select("doc_id", "start", "candidate", "times", "probability", "is_secret")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.coalesce(_remainder("doc_id", 10) != 0, F.lit(True))
    out = brown_lm.score_texts(documents(spark, sf_dir), train)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(documents(spark, sf_dir))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return personal_data.digest(docs, personal_data.find(docs))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
hit AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
lin AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(lin.n_dup, 0)::BIGINT AS n_dup_lines,
        coalesce(hit.n, 0)::BIGINT AS n_repeat_words, coalesce(lin.n_lines, 0) AS n_lines,
        length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')) AS n_letters
      FROM d LEFT JOIN hit USING (r) LEFT JOIN lin USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 2 * n_upper > n_letters) AS kept
FROM b
"""

OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
cls AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY key) AS rep FROM (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(1) ORDER BY g)) AS key FROM sh GROUP BY doc_id)),
s AS (SELECT sh.doc_id, g, n FROM sh JOIN cls USING (doc_id) WHERE doc_id = rep),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, least(x, min(y)) AS component FROM r GROUP BY x)
SELECT d.doc_id, coalesce(cls.n, 0) AS n_shingles, coalesce(c.component, cls.rep, d.doc_id) AS component_id
FROM d LEFT JOIN cls USING (doc_id) LEFT JOIN c ON c.x = cls.rep
"""

OP5_SQL = rf"""
WITH base AS (SELECT doc_id, source, size, length(bin(greatest(size, 1))) AS weight FROM (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents)),
src AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM base GROUP BY source),
lv AS (SELECT *, 3 * source_size AS cap, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
  FROM src WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
one AS (SELECT arg_min(level, cap / weight) AS level FROM lv WHERE level * weight <= cap),
tg AS (SELECT source, source_size, coalesce(least((SELECT level FROM one) * weight, cap::DOUBLE), 0) AS target FROM lv),
cl AS (SELECT base.source, base.weight, sum(size)::BIGINT AS words, any_value(target) AS target, any_value(source_size) AS source_size FROM base JOIN tg ON base.source IS NOT DISTINCT FROM tg.source GROUP BY 1, 2),
fc AS (SELECT *, (target - 3::DOUBLE * coalesce(sum(words) OVER (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / nullif(sum(words * weight) OVER (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS factor FROM cl),
gd AS (SELECT source, arg_max(factor, weight) AS factor FROM fc WHERE factor * weight <= 3 GROUP BY source),
cp AS (SELECT fc.*, CASE WHEN target > 0 THEN least(coalesce(gd.factor * weight, 3), 3) ELSE 0 END AS copies FROM fc LEFT JOIN gd ON fc.source IS NOT DISTINCT FROM gd.source),
ex AS (SELECT source, weight, source_size, target, floor(copies) AS whole, copies - floor(copies) AS p, target - sum(floor(copies) * words) OVER (PARTITION BY source) AS need FROM cp),
u AS (SELECT base.*, ex.source_size, ex.target, ex.whole, ex.need, ex.p,
    (('0x' || substr(md5('mix:' || coalesce(base.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS x
  FROM base JOIN ex ON base.source IS NOT DISTINCT FROM ex.source AND base.weight = ex.weight),
o AS (SELECT *, CASE WHEN p > 0 THEN x / (1 - x) * (1 - p) / p END AS q FROM u),
c AS (SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q / (1 + q) NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM o)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN need > 0 AND p > 0 AND upto - size / 2 <= need THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM c
"""

OP7_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""

OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT lang, source, r, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
tg AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL), tl AS (SELECT lang, sum(n) AS total FROM n GROUP BY ALL), nl AS (SELECT lang, term, sum(n) AS n FROM n GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 1)) // (coalesce(tg.total, 0) + v.v)::HUGEINT) AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN tg ON tg.lang = g.lang AND tg.source = g.source LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term),
q AS (SELECT nl.lang, nl.term, (1 + (1000000000::HUGEINT * (nl.n + 1)) // (tl.total + v.v)::HUGEINT) AS q FROM nl JOIN tl USING (lang) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
k AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 200
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0), c AS (SELECT count(*)::BIGINT AS docs, sum(n)::HUGEINT AS terms FROM s),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
m AS (SELECT r, doc_id, (25 + (75::HUGEINT * n * docs) // terms)::BIGINT AS m FROM s, c),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, c),
x AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM i JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_best_fit_packing, op2_quality_rules, op3_language_id, op4_ngram_jaccard_join, op5_source_mixing, op6_quality_classifier, op7_exact_dedup, op8_secret_scan, op9_html_extraction, op10_lm_scoring, op11_source_divergence, op12_lexical_search, op13_personal_data)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2_SQL, "op4_ngram_jaccard_join": OP4_SQL, "op5_source_mixing": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op11_source_divergence": OP11_SQL, "op12_lexical_search": OP12_SQL}
