"""Every operator on the same awkward table: nulls in any column, empty and very long texts, ties, repeated rows, columns
whose names clash with an operator's own, and no rows at all."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import brown_lm, exact_dedup, html_extract, jaccard_join, language_id, lexical_search, mixing, packing, personal_data, quality_lm, quality_rules, secret_scan, source_audit
from plumbline.llm.queries import vocabulary

LONG = "a word and another one " * 20_000
ROWS = [
    (1, "Some plain words that stand in a row of their own.", "en", "s"), (1, "Some plain words that stand in a row of their own.", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (4, " \n\t ", "de", None),
    (5, LONG, None, "s"), (6, "x" * 300_000, "en", "t"), (None, "a null id with words", "de", "t"), (None, None, None, None), (7, "a null id with words", "de", "t"), (8, "ÄÖÜ ß 你好 \u0000   😀", "de", "t"),
    (9, 'token = "abcdef0123456789abcdef0123456789" and more', "en", "s"), (9, 'token = "abcdef0123456789abcdef0123456789" and more', "en", "s"),
]
CLASHES = (
    "size target rank bin sub need whole copies taken source_size host own around heads body n sig row bits key node rep region s cell component digest keep_id incoming maybe kept kept_id rejected_by words start candidate context "
    "times probability is_secret label vector prediction rawprediction train block place class c classes emission score lang_pred accepted gram good learned limit mean_logp sequence_id offset length piece ids id seq gap __q_words __q_text"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(f"own-{c}") for c in CLASHES})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def _ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


WANT = Counter(r[0] for r in ROWS)


def _same(rows):
    """Rows that repeat have one result."""
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(tuple(r))
    return by


@pytest.mark.parametrize(
    "run",
    [
        lambda d: quality_rules.quality_filter(d.drop("__q_words", "__q_text", "kept", "rejected_by")).select("doc_id", "kept"),
        lambda d: language_id.predict(d, language_id.fit(d)),
        lambda d: jaccard_join.jaccard_components(d),
        lambda d: mixing.mix(d),
        lambda d: quality_lm.classify(d, d.select("doc_id").where("doc_id in (1, 5, 7)")),
        lambda d: exact_dedup.exact_dedup(d, exact_dedup.arrival_batch(F.col("doc_id"))),
        lambda d: brown_lm.score_texts(d, F.col("doc_id") % 2 == 1),
        lambda d: personal_data.digest(d, personal_data.find(d)),
    ],
    ids=["rules", "language", "jaccard", "mixing", "classifier", "dedup", "brown", "personal"],
)
def test_one_row_a_document(run, docs, empty):
    out = run(docs)
    assert _ids(out) == WANT
    again = _same(out.collect())
    assert len(again[1]) == len(again[9]) == 1
    assert run(empty).count() == 0


def test_packing_keeps_every_token(docs, empty):
    pieces = packing.tokenize(docs, vocabulary())
    want = pieces.agg(F.sum("length"), F.count("*")).first()
    out = packing.pack(pieces.withColumn("seq", F.lit("own")))
    assert tuple(out.agg(F.sum("length"), F.count("*")).first()) == tuple(want)
    assert Counter(r.doc_id for r in out.where("piece = 0").collect()) == WANT and out.where("seq != 'own'").count() == 0
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    assert packing.pack(packing.tokenize(empty, vocabulary())).count() == 0


def test_secrets_of_rows_that_repeat_count_once(docs, empty):
    out = secret_scan.scan(docs).collect()
    mine = [r for r in out if r.doc_id == 9 and r.candidate.startswith("abcdef")]
    assert [(r.times, r.is_secret) for r in mine] == [(1, True)]
    assert len([r for r in out if r.doc_id == 6]) == 1
    assert secret_scan.scan(empty).count() == 0


def test_audit_and_search(spark, docs, empty):
    out = source_audit.audit(docs, 1).collect()
    pairs = {(r.lang, r.source, r["item"]) for r in out if r.part == "pair"}
    assert pairs == {("en", "s", "t"), ("en", "t", "s"), ("de", "", "t"), ("de", "t", ""), ("", "", "s"), ("", "s", "")}
    assert {r["item"] for r in out if r.part == "term" and r.lang == ""} == set()  # the one source with terms is as its language
    assert source_audit.audit(empty).count() == 0
    items = spark.createDataFrame([(1, "plain words, null id"), (2, None), (None, "XXX"), (3, LONG)], "item_id long, text string").withColumns({c: F.lit("own") for c in ("item", "term", "m", "score", "rank")})
    found = lexical_search.search(docs, items).collect()
    assert [r.doc_id for r in sorted((r for r in found if r.item_id == 1), key=lambda r: r.rank)][:2] == [None, 7]  # ties by doc_id, null first
    assert {r.item_id for r in found} == {1, 3} and next(r.doc_id for r in found if r.item_id == 3 and r.rank == 1) == 5
    assert lexical_search.search(empty, items).count() == 0 and lexical_search.search(docs, items.limit(0)).count() == 0


def test_pages(spark):
    pages = [(1, "http://h/1", "<article><p>One.</p></article>"), (1, "http://h/1", "<article><p>One.</p></article>"), (2, None, None), (None, "http://h/2", ""), (3, "http://h/3", "<p>" + LONG), (4, "", "\u0000<p>\u0000")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("host", "own", "around", "heads", "body", "text", "bucket")})
    got = html_extract.extract(df).collect()
    assert Counter((r.page_id, r.url) for r in got) == Counter((p[0], p[1]) for p in pages)
    assert {r.text for r in got if r.page_id == 1} == {"One."} and next(r.text for r in got if r.page_id == 3) == LONG.strip()
    assert {r.text for r in got if r.page_id in (2, None)} == {""}
    assert html_extract.extract(df.limit(0)).count() == 0


def test_empty_texts_alone_have_no_perplexity(spark):
    docs = spark.createDataFrame([(i, "", "en") for i in range(6)] + [(9, "words to learn from " * 9, "en")], "doc_id long, text string, lang string").coalesce(1)
    got = {r.doc_id: r for r in quality_lm.classify(docs, docs.where("doc_id = 9").select("doc_id")).collect()}
    assert len(got) == 7 and got[9].kept and all(got[i].perplexity is None and not got[i].kept for i in range(6))
    alone = docs.where("doc_id < 6")
    assert quality_lm.classify(alone, docs.limit(0).select("doc_id")).where("not kept").count() == 6
