"""Source audit, lexical search and personal data against brute-force versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from plumbline.llm import lexical_search, personal_data, source_audit

DOCS = "doc_id long, text string, lang string, source string"


def _random_docs(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    stems = ["alpha", "Beta", "gämma", "d", "E", "zeta", "eta", "Theta", "iota", "kappa", "漢字", "rare1x", "x y"]
    marks = ["", ",", ".", "(", "-", "_", "1", "\u0000", "alpha"]
    rows = []
    for i in range(n):
        words = [r.choice(stems) + r.choice(marks) + (r.choice(stems) if r.random() < 0.2 else "") for _ in range(r.choice([0, 1, 3, 8, 40]))]
        text = None if r.random() < 0.05 else r.choice([" ", "\n", "\t\x0b"]).join(words)
        rows.append((None if r.random() < 0.05 else i // 2, text, r.choice(["en", "de", None]), r.choice(["a", "b", "b", "c", None, "b"])))
    return rows + rows[:5] + [(900, "solo", "fr", "a"), (901, "", "it", "a"), (902, None, "it", "b")]


def _audit_brute(rows, min_docs, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        key = (lang or "", source or "")
        groups.add(key)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        counts[key].update(found)
        docs[key[0]].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        own = [g for g in groups if g[0] == lang]
        whole = Counter()
        for g in own:
            whole.update({t: counts[g][t] for t in kept})

        def p(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (total + len(kept)) for t in kept}

        ps, q = {g: p(counts[g]) for g in own}, p(whole)
        for g in own:
            pair = [(sum((ps[g][t] - ps[h][t]) ** 2 // ps[h][t] for t in kept), h[1]) for h in own if h != g]
            term = [((ps[g][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[g][t] and ps[g][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(*g, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("min_docs", [1, 2, 3])
def test_audit_is_brute_force(spark, min_docs):
    rows = _random_docs(min_docs, 60)
    got = [tuple(r) for r in source_audit.audit(spark.createDataFrame(rows, DOCS).repartition(3), min_docs, 5).collect()]
    assert len(got) == len(set(got))
    assert set(got) == _audit_brute(rows, min_docs, 5)


def test_audit_counts_documents_whose_chunks_share_a_term(spark):
    """Two chunks of two documents each make two, three or four documents: only row numbers tell."""
    rows = [(i, t, "en", "s") for i, t in enumerate(["w, w.", "w, w.", "v, v.", "v.", "v,", "u- u. u_", "u-"])]
    got = {r.term for r in source_audit.term_counts(spark.createDataFrame(rows, DOCS).coalesce(1)).collect()}
    assert got == {"v"}
    with pytest.raises(ValueError):
        source_audit.term_counts(spark.createDataFrame(rows, DOCS), 4)


def _search_brute(rows, items, k):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))
    own = [(i, Counter(term(t))) for i, t, *_ in rows]
    own = [(i, c) for i, c in own if c]
    n_docs, total = len(own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = set()
    for item, text in items:
        scored = []
        for i, c in own:
            m = 25 + 75 * c.total() * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in term(text) if c[t])
            if s > 0:
                scored.append((-s, i is not None, i or 0))
        out |= {(item, rank + 1, i if known else None, -s) for rank, (s, known, i) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("first,task,block", [(5_000, 4_000, 500), (3, 2, 2), (1, 50, 1)])
def test_search_is_brute_force(spark, monkeypatch, first, task, block):
    monkeypatch.setattr(lexical_search, "FIRST_DOCS", first)
    monkeypatch.setattr(lexical_search, "TASK_DOCS", task)
    rows = _random_docs(9, 80)
    items = [(1, "alpha BETA beta 漢字 unknown"), (2, "Theta kappa, 1"), (3, ""), (4, None), (5, "solo gämma alpha"), (6, "nowhere")]
    docs, asked = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in lexical_search.search(docs, asked, 4, block).select("item_id", "rank", "doc_id", "score").collect()]
    assert len(got) == len(set(got))
    assert set(got) == _search_brute(rows, items, 4)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
    return {"ip": lambda: all(int(x) <= 255 for x in value.split(".")), "phone": lambda: 10 <= len(digits) <= 15, "email": lambda: True}[kind]()


def _base(text):
    return sorted((m.start(), k, m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if _valid(k, m[0]))


def test_base_spans_are_those_of_the_plain_patterns(spark):
    r = random.Random(5)
    pieces = ["a@b.c", "_d@e.f", "x.y+z@", "@q.r", "1.2.3.4", ".5.6", "300.1.1.1", "007.0.0.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-2030", "+44 ", "12345678901234", " ", "-", ".", "é", "😀", "(", ")", "0", "+", "@"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 12))) for _ in range(400)]
    awkward = ["x", "1", "a.", "1.", "+1", " (", "a@", "1 2-", "a@b.", "+1 ("]
    texts += [None, "", *(a * 500 for a in awkward)]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = personal_data.find(docs).where("base")
    got = defaultdict(list)
    keys = {r.row: r.doc_id for r in docs.select("doc_id", personal_data.row_hash(docs["doc_id"], docs["text"]).alias("row")).collect()}
    for s in spans.collect():
        got[keys[s.row]].append((s.start, s.kind, s.end))
    for i, t in rows:
        assert sorted(got[i]) == _base(t), t[:200]
    # plain patterns take the square of a run's length
    long = spark.createDataFrame([(i, a * 15_000) for i, a in enumerate(awkward)], "doc_id long, text string")
    assert {(r.kind, r.end - r.start) for r in personal_data.find(long).where("base").collect()} == {("ip", 7), ("email", 5), ("email", 7)}


def _boot_rows():
    rows = [(i, f"Some words. Phone: +1 (555) 010-20{i:02d} or not, mail {'ab' * (i + 1)}@x.example and the 1{i}000000 of it") for i in range(12)]
    rows += [(20, "Words again. Phone: 555-0199 and so on"), (21, "In the 5550198 there is no number"), (22, "Phone: 5550123 said the other"), (23, "a mail jörg@localhost and mail root@localhost too"), (24, "seen before: Tel. 1 (555) 010-2003 the")]
    rows += [(25, "the +1 (555) 010-2003 192.168.1.1 both")]
    return rows


def test_bootstrap_finds_identifiers_beyond_the_patterns(spark):
    docs = spark.createDataFrame(_boot_rows(), "doc_id long, text string")
    out = {r.doc_id: r for r in personal_data.digest(docs, personal_data.find(docs)).collect()}
    text = dict(_boot_rows())
    new = {i: [text[i][int(s.split(":")[1]) : int(s.split(":")[2])] for s in r.spans.split(",") if s] for i, r in out.items() if i >= 20}
    assert new[20] == ["555-0199"] and new[22] == ["5550123"]
    assert new[21] == []  # `the` is no pattern: it stands before much else
    assert new[23] == ["jörg@localhost", "root@localhost"]
    assert new[25] == ["+1 (555) 010-2003", "192.168.1.1"]  # the first is known from another document
    assert all(r.n_phone == 1 and r.n_email == 1 for i, r in out.items() if i < 12)
    assert all(s.split(":")[0] != "card" for r in out.values() for s in r.spans.split(",") if s)


def _bootstrap_brute(docs, found, rounds):
    """Dictionaries instead of tables, over the matches of the operator."""
    seen, seeds, times, backed = defaultdict(set), set(), Counter(), defaultdict(lambda: defaultdict(set))
    kinds = {}
    for m in found:
        for p in m.patterns:
            key = (p.w2, p.w1, p.marks)
            seen[key].add(m.instance)
            times[key] += 1
            if m.kind != "?":
                backed[key][m.kind].add(m.instance)
        if m.kind != "?":
            seeds.add((m.instance, m.kind))
        kinds.setdefault(m.instance, m.kinds)
    uses = Counter()
    for _, text in docs:
        words = re.split(r"\s+", (text or "").lower().strip())
        for before, w in zip(["", *words], words, strict=False):
            uses[None, w] += 1
            uses[before, w] += 1
    good = {k for k in seen if any(len(v) >= personal_data.MIN_SEEDS for v in backed[k].values()) and (k[2] == "" or times[k] >= personal_data.SPECIFIC * uses[k[0], k[1]])}
    known = {v for v, _ in seeds}
    conf, patterns = dict.fromkeys(seeds, 1.0), {}
    for _ in range(rounds):
        patterns = {}
        for k in good:
            for kind in personal_data.KINDS:
                total = sum(conf.get((v, kind), 0) for v in seen[k])
                if total >= personal_data.MIN_SEEDS and total / (len(seen[k]) + 1) >= personal_data.PATTERN:
                    patterns[k, kind] = total / (len(seen[k]) + 1)
        conf, miss = dict.fromkeys(seeds, 1.0), defaultdict(lambda: 1.0)
        for (k, kind), p in patterns.items():
            for v in seen[k] - known:
                if kind in kinds[v]:
                    miss[v, kind] *= 1 - p
        conf |= {key: 1 - m for key, m in miss.items()}
    return patterns, conf


@pytest.mark.parametrize("rounds", [1, 3])
def test_bootstrap_is_brute_force(spark, rounds):
    rows = _boot_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = personal_data.materialize(personal_data.matches(docs), "test")
    patterns, conf = personal_data.bootstrap(docs, found, rounds)
    instance, shapes = personal_data._instance(found["value"]).alias("instance"), personal_data._shape_kinds(found["value"]).alias("kinds")
    seen = found.select("kind", instance, shapes, personal_data._patterns().alias("patterns")).collect()
    want_patterns, want_conf = _bootstrap_brute(rows, seen, rounds)
    got = {((r.pattern.w2, r.pattern.w1, r.pattern.marks), r.kind): r.p for r in patterns.collect()}
    assert got == pytest.approx(want_patterns) and got
    assert {(r.value, r.kind): r.c for r in conf.collect()} == pytest.approx(want_conf)
