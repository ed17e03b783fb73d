"""Main text of web pages: markup gives the blocks, a host's suffix intervals tell boilerplate from unique runs.

A page is read once into blocks with the part of the page that they stand in: inside an article container, in an element
that never holds the article (menus, footers, forms, scripts, ...), or in the open. An article inside a form or an element
that only its class name sets aside, or with such a name itself, counts where the page has no other. Where a page marks its article, the
container's blocks are its own; where it does not, all blocks in the open are. From a page's own blocks that goes which
repeats across the host's pages: the token streams of all blocks, own or not, are concatenated per host, and all
suffixes that share their first SPAN tokens form one interval of the host's suffix array. An interval met by PAGES pages
or more, and by SHARE of the host's pages, is boilerplate; tokens that such intervals cover go, the unique runs between them
stay. Inside a marked article, only runs go that also stand outside marked articles on as many pages, and headings never do.
Pages with the same own blocks (mirrors) count as one. A short block between blocks that stay is not removed, and a page
that would lose all of its text keeps it. A host of fewer than PAGES different pages, or no host, has no interval: what
repeats cannot be told there.

The suffix array is never built in one task. What its maximal repeats of SPAN tokens or more cover is what its intervals of
depth SPAN cover: each run of SPAN tokens in such a repeat stands on as many pages at least, and each run on that many pages
is part of a repeat (the tests compare with a suffix array built in one piece). An interval of depth SPAN is a group of the
suffixes' first SPAN tokens, so intervals form by aggregation over (host, tokens), and a host with a third of all pages is
no hot group. Only suffixes whose words are each
frequent on the host are grouped; words are counted first, in buckets, which can only add suffixes.

Defined cases: null html is empty and gives an empty text; a page without blocks gives an empty text; rows that repeat
are extracted alike and count once for an interval; a null url has no host; an empty table gives an empty result;
other columns are ignored. Character references are decoded, white space in a block becomes one blank, blocks are joined
by a line feed; nothing else is dropped or capped.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bounded_broadcast, materialize

#: An interval is boilerplate from PAGES different pages of a host on, if they are SHARE of the host's different pages.
SPAN, PAGES, SHARE = 8, 3, 0.5
#: Words are counted by this many buckets of their checksum: an interval is met often only if each of its words' buckets is.
BUCKETS = 4096
#: Hosts whose lists of frequent buckets and heads are broadcast.
BROADCAST_ENTRIES = 100_000
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

# Elements and class names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("head script style noscript template iframe svg math canvas object audio video textarea title".split())
AROUND = frozenset("nav footer aside form menu dialog button select label fieldset".split())
MAIN = frozenset("article main".split())
RAW = frozenset("script style textarea title".split())
AROUND_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus reply replies share sharing social related recommended newsletter subscribe "
    "subscription signup login search pagination pager toolbar".split()
)
#: Of these, names that are ordinary words too: they count alone or beside words of layout, not in "related-work".
AMBIGUOUS = frozenset("notice consent search share sharing social related recommended comment comments reply replies promotion subscription login signup banner".split())
LAYOUT = frozenset(
    "a area article articles bar block bottom box btn button buttons center column container content count entry fixed footer form global group header holder icon icons id in inner item items "
    "left link links list main media more news outer page pages panel post posts primary right row secondary section site sticky story stories the title toggle top widget widgets wrap wrapper".split()
)
NEGATIONS = frozenset("has have no non not with without hide hidden".split())
AROUND_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())

_QUOTES_OR_END = re.compile("[>\"']")
_NAME_END = re.compile(r"[\s/>]")
_ATTRIBUTE = re.compile(r"""([^\s=/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s]+))|([^\s=/]+)""")
_NAME = re.compile(r"[a-z0-9]+")

#: IN_NAMED is around by class name or form only, where an article may open again as IN_NESTED; that counts on pages without another.
IN_MAIN, IN_OPEN, IN_AROUND, IN_NAMED, IN_NESTED = "main", "open", "around", "named", "nested"


def _names_around(names: str) -> bool:
    """Whether a class or id names what never holds the article."""
    for name in names.lower().split():
        parts = _NAME.findall(name)
        for k, part in enumerate(parts):
            if part not in AROUND_NAMES or NEGATIONS.intersection(parts[:k]):
                continue
            if part not in AMBIGUOUS or all(x in AROUND_NAMES or x in LAYOUT or x.isdigit() for x in parts):
                return True
    return False


def _place(tag: str, attributes: str, in_main: bool) -> str | None:
    """The part of the page that an element opens, if it opens one; '' for what is never text."""
    if tag in SILENT:
        return ""
    if tag in ("form", "fieldset"):
        return IN_NAMED
    if tag in AROUND or (tag == "header" and not in_main):
        return IN_AROUND
    if not attributes.strip():
        return IN_MAIN if tag in MAIN else None
    found = {}
    for name, a, b, c, bare in _ATTRIBUTE.findall(attributes):
        found[(name or bare).lower()] = a or b or c
    role = found.get("role", "").lower()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return ""
    if tag not in ("html", "body") and role in AROUND_ROLES:
        return IN_AROUND
    named = tag not in ("html", "body") and _names_around(f"{found.get('class', '')} {found.get('id', '')}")
    if tag in MAIN or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody":
        return IN_NESTED if named else IN_MAIN
    return IN_NAMED if named else None


class _Markup:
    """Where the markup of a page begins and ends, found in one pass. A tag ends at the first `>` outside quotes; on a page
    whose quotes do not close, tags end at the first `>` from there on. A `<` that opens nothing is text."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.quoted = page, page.rfind(">"), True

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, tag, closes, attributes) of the first markup from `at` on; comments have no tag."""
        page, n = self.page, len(self.page)
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, n if end < 0 else end + 3, "", False, ""
            if at > self.last:
                return None
            after = page[at + 1 : at + 2]
            if after in ("!", "?"):
                return at, page.find(">", at) + 1, "", False, ""
            closes = after == "/"
            begin = at + 1 + closes
            if page[begin : begin + 1].isascii() and page[begin : begin + 1].isalpha():
                name_end = _NAME_END.search(page, begin).start()
                end = self._end(name_end)
                return at, end + 1, page[begin:name_end].lower(), closes, page[name_end:end]
            at += 1
        return None

    def _end(self, at: int) -> int:
        start = at
        while self.quoted:
            at = _QUOTES_OR_END.search(self.page, at)
            at = -1 if at is None else at.start()
            if at >= 0 and self.page[at] == ">":
                return at
            at = self.page.find(self.page[at], at + 1) + 1 if at >= 0 else 0
            self.quoted = at > 0
        return self.page.find(">", start)


def blocks(page: str) -> list[tuple[str, str]]:
    """(part, text) of every block in page order."""
    return [(part, text) for part, text, _ in titled_blocks(page)]


def titled_blocks(page: str) -> list[tuple[str, str, bool]]:
    """(part, text, whether it is a heading) of every block in page order."""
    out: list[tuple[str, str, bool]] = []
    stack: list[tuple[str, str]] = []  # open elements with the part of the page inside them
    opened_tags: dict[str, int] = {}
    part, held, at = IN_OPEN, [], 0
    markup = _Markup(page)

    def close() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((part, text, any(opened_tags.get(h) for h in HEADINGS)))
            held.clear()

    def pop(k: int) -> None:
        """Closes the elements from number k on."""
        nonlocal part
        inside = stack[k - 1][1] if k else IN_OPEN
        if inside != part:
            close()
        for tag, _ in stack[k:]:
            opened_tags[tag] -= 1
        del stack[k:]
        part = inside

    n = len(page)
    while at < n:
        found = markup.next(at)
        start, end, tag, closes, attributes = found or (n, n, "", False, "")
        if start > at and part:
            held.append(page[at:start])
        at = end
        if not tag:
            continue
        if tag in BREAKS or tag in SILENT or tag in AROUND:
            close()
        if closes:
            if opened_tags.get(tag):
                pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            end_tag = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = end_tag.start() if end_tag else n
        if tag in ("p", "li", "option") and stack and stack[-1][0] == tag:
            pop(len(stack) - 1)
        opened = _place(tag, attributes, part in (IN_MAIN, IN_NESTED))
        inside = part if part in ("", IN_AROUND) or opened is None else opened
        if inside == IN_MAIN and part in (IN_NAMED, IN_NESTED):
            inside = IN_NESTED
        if opened == "":
            inside = ""
        if inside != part:
            close()
        stack.append((tag, inside))
        opened_tags[tag] = opened_tags.get(tag, 0) + 1
        part = inside
    close()
    return out


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for page in pdf["html"]:
            found = titled_blocks(page or "")
            holder = next((p for p in (IN_MAIN, IN_NESTED) if any(p == q for q, *_ in found)), IN_OPEN)
            rows.append(([t for p, t, _ in found if p == holder], [t for p, t, _ in found if p != holder], [h for p, _, h in found if p == holder], holder != IN_OPEN))
        yield pdf[["page_id", "url", "host"]].assign(**{name: [r[k] for r in rows] for k, name in enumerate(("own", "around", "titled", "marked"))})


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def _bucket_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, bucket, n): pages that have a word of the bucket, added up as far as a task can."""
    held: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pd.DataFrame]:
        for host, counts in held.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"host": host, "bucket": at.astype(np.int32), "n": counts[at]})
        held.clear()

    for pdf in frames:
        for host, own, around in zip(pdf["host"], pdf["own"], pdf["around"], strict=True):
            words = {w for block in (*own, *around) for w in block.split(" ")}
            held.setdefault(host, np.zeros(BUCKETS, np.int64))[list({_bucket(w) for w in words})] += 1
        if len(held) > 1000:
            yield from flush()
    yield from flush()


def _heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per page and different head that may be met often, and whether it stands outside a marked article. Heads end
    with their block; a block shorter than SPAN is one head."""
    for pdf in frames:
        sets: dict[str, frozenset[int]] = {}
        out: list[tuple[str, int, str, bool]] = []
        for host, body, own, around, marked, buckets in zip(*(pdf[c] for c in ("host", "body", "own", "around", "marked", "buckets")), strict=True):
            often = sets.get(host) or sets.setdefault(host, frozenset(buckets))
            found: dict[str, bool] = {}
            for place, block in enumerate((*own, *around)):
                words, run = block.split(" "), 0
                for k, word in enumerate(words):
                    run = run + 1 if _bucket(word) in often else 0
                    if run >= SPAN or (run == len(words) == k + 1):
                        head = " ".join(words[max(k + 1 - SPAN, 0) : k + 1])
                        found[head] = found.get(head, False) or not marked or place >= len(own)
            out.extend((host, body, head, outside) for head, outside in found.items())
        yield pd.DataFrame(out, columns=["host", "body", "head", "outside"])


def _left(own: list[str], heads: frozenset[str], whole: list[bool] | None = None) -> str:
    """The text without tokens that heads cover. Blocks that are to stay whole do, a covered block shorter than SPAN stays
    between blocks that stay, and where nothing would be left all stays."""
    words = [block.split(" ") for block in own]
    left = []
    for b, ws in enumerate(words):
        if whole is not None and whole[b]:
            left.append(own[b])
            continue
        starts = [k for k in range(max(len(ws) - SPAN, 0) + 1) if " ".join(ws[k : k + SPAN]) in heads]
        covered = {k + n for k in starts for n in range(SPAN)}
        left.append(" ".join(w for k, w in enumerate(ws) if k not in covered))
    stay = [b for b, text in enumerate(left) if text]
    if not stay:
        return "\n".join(own)
    inner = [len(ws) < SPAN and stay[0] < b < stay[-1] for b, ws in enumerate(words)]
    return "\n".join(own[b] if inner[b] else left[b] for b in range(len(own)) if left[b] or inner[b])


def _assemble(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        sets: dict[tuple[str, bool], frozenset[str]] = {}
        texts = []
        for host, own, titled, marked, heads in zip(*(pdf[c] for c in ("host", "own", "titled", "marked", "heads")), strict=True):
            if heads is None:
                texts.append("\n".join(own))
                continue
            if (host, marked) not in sets:
                sets[host, marked] = frozenset(h["head"] for h in heads if h["outside"] or not marked)
            texts.append(_left(list(own), sets[host, marked], list(titled) if marked else None))
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts})


def _host() -> Column:
    """The url's host in lower case, also without a scheme; null where it has none."""
    with_scheme = F.regexp_extract("url", r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    bare = F.regexp_extract("url", r"^\s*([^\s/?#:@.]+(?:\.[^\s/?#:@.]+)+)(?::[0-9]+)?(?:[/?#]|$)", 1)
    return F.lower(F.coalesce(F.nullif(with_scheme, F.lit("")), F.nullif(bare, F.lit(""))))


def _few(by_host: DataFrame, lists: str) -> DataFrame:
    """Lists by host: broadcast when all their entries, counted, are few."""
    entries = by_host.agg(F.coalesce(F.sum(F.size(lists)), F.lit(0))).first()[0]
    return F.broadcast(by_host) if entries <= BROADCAST_ENTRIES else by_host


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text for every row of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", _host().alias("host"), "html")
    parsed = rows.mapInPandas(_parse, "page_id long, url string, host string, own array<string>, around array<string>, titled array<boolean>, marked boolean")
    parsed = materialize(parsed, "html-blocks")

    with_body = parsed.where("host is not null").withColumn("body", F.xxhash64("own"))
    bodies = with_body.select("host", "body").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("bodies")).where(F.col("bodies") >= PAGES)
    needs = materialize(bodies.select("host", F.greatest(F.lit(PAGES), F.ceil(F.col("bodies") * SHARE)).alias("need")), "html-hosts")
    needs = bounded_broadcast(needs, needs.count())
    counted = with_body.select("host", "own", "around")
    counted = counted.mapInPandas(_bucket_counts, "host string, bucket int, n long").groupBy("host", "bucket").agg(F.sum("n").alias("n"))
    often = counted.join(needs, "host").where("n >= need").groupBy("host").agg(F.collect_list("bucket").alias("buckets"))
    often = materialize(often, "html-buckets")
    heads = with_body.join(_few(often, "buckets"), "host").select("host", "body", "own", "around", "marked", "buckets")
    heads = heads.mapInPandas(_heads, "host string, body long, head string, outside boolean")
    heads = heads.groupBy("host", "body", "head").agg(F.max("outside").alias("outside"))
    met = heads.groupBy("host", "head").agg(F.count(F.lit(1)).alias("bodies"), F.count_if("outside").alias("outside")).join(needs, "host").where("bodies >= need")
    met = met.select("host", F.struct("head", (F.col("outside") >= F.col("need")).alias("outside")).alias("head"))
    met = materialize(met.groupBy("host").agg(F.collect_list("head").alias("heads")), "html-intervals")
    done = parsed.join(_few(met, "heads"), "host", "left").select("page_id", "url", "host", "own", "titled", "marked", "heads")
    return done.mapInPandas(_assemble, "page_id long, url string, text string")
