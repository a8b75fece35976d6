"""Main text of pages by a suffix array over the pages of a host.

Every page becomes two streams of tokens: its words, whatever blocks they stand in, and its blocks of
text, each with the path of elements that it stands in. The streams of a group of pages are laid end
to end and their suffixes sorted to depth ``WORDS`` and ``RUN``; suffixes that begin alike are one
run, with the least and the greatest page it stands on. The groups' runs are joined over the whole
host: a run of different pages is one that the host repeats, and the words and blocks that such runs
cover are the host's boilerplate, also when they are part of a block. A repeated passage of fewer
than ``WORDS`` words and ``RUN`` blocks stays, and so do fewer than ``WORDS`` words of a block that
also holds others. A page that declares its main
region (article or main) keeps the blocks of that region, whether or not other pages quote them; a
page that declares none keeps its unique runs. Elements that never hold main text (navigation,
forms, scripts, adverts, comments ...) are left out either way: by element name, because they are
hidden, or by a class, id or role whose last word is one of ``APART_WORDS``, or whose first word is
one and whose other words only name a place on the page (``FRAME_WORDS``). A name with a word of
``MODIFIERS`` says nothing, and an element that is also named as the main content stays. Names never
leave out an element around the outermost article or main; nor an outermost article or main
itself, or one further inside, if nothing else of the main region would stay. What stands around a
left-out element inside a block is one block. A tag that is never closed ends the page.

A host's pages are dealt into groups of about ``PAGES``, so no group grows with a host; the result
does not depend on the groups: a passage on more than half of a host's main texts is on more than half of
some group's, so the groups name the passages that may be common and these are counted over the host. Runs are
joined by 64-bit codes. Runs of whole pages are sought where a page declares no main region, runs of main
regions on hosts with at least ``COMMON`` different ones.

Defined cases: null or empty html gives an empty text with 0 characters; a null or malformed url is
a host of its own name; elements left open end with the element around them; repeated rows are
pages of their own (and do not count as distinct pages of each other if they share page_id).
Further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paramill.llm.common import arrow_map, ship, written

#: Blocks of a run that counts as repeated, words of one, and pages of a group.
RUN, WORDS, PAGES = 3, 12, 512
#: Different main texts of a host that hold a passage of its own notices, at least.
COMMON = 5
#: Hosts with several groups that may be broadcast (some 100 bytes each).
BROADCAST_HOSTS = 100_000
PAGE = "page_id long, url string, text string, n_chars long"
PARSED = "page_id long, url string, host string, declared boolean, texts array<string>, codes array<long>, own array<boolean>, main long"
MARKS = "host string, main long, code long"
FOUND = "host string, deal long, code long, low long, high long, blank boolean"
MAIN = frozenset({"article", "main"})
#: Elements that end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without main text.
APART = frozenset(
    "nav footer aside form script style noscript template head title menu button select textarea iframe object svg canvas dialog label input".split()
)
#: Elements whose content is not markup.
RAW = frozenset({"script", "style", "textarea", "title", "noscript", "iframe"})
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: First or last words of names in a class, id or role that mark an element without main text.
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion related respond share sharing sidebar "
    "signup social sponsor sponsored subscribe teaser teasers toolbar widget widgets".split()
)
#: Words that only name a place on the page or a kind of box.
FRAME_WORDS = frozenset(
    "area bar block body bottom box button buttons card cards col column container content feed form frame group holder icon icons inner "
    "item items left link links list lists main message module outer overlay panel popup posts region right row section slot slots strip "
    "text thread title toggle top unit widget widgets wrap wrapper zone".split()
)
#: Names of the main content, as words.
CONTENT_NAMES = frozenset(
    tuple(n.split("-"))
    for n in "article main content main-content page-content post-content entry-content article-content article-body story-body post-body".split()
)
#: Words of names that only say what the page's layout has.
MODIFIERS = frozenset("no not non without with has have show shows hide hides".split())
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r">|=\s*([\"'])")
_NAMES = re.compile(r"(?<![^\s\"'])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)
_HIDDEN = re.compile(
    r"(?:^|[\s\"'])(?:hidden(?=$|[\s=/])|aria-hidden\s*=\s*[\"']?true\b|style\s*=\s*(?:\"[^\"]*display\s*:\s*none|'[^']*display\s*:\s*none|display:none))", re.I
)
_CAPITAL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_WORD = re.compile(r"[a-z]+")


def _named_apart(name: str, attributes: str) -> bool:
    """Whether a class, id or role marks the element as one without main text."""
    if name in ("html", "body") or "=" not in attributes:
        return False
    apart = False
    for _, value in _NAMES.findall(attributes):
        for shown in value.strip("\"'").split():
            parts = tuple(_WORD.findall(_CAPITAL.sub("-", shown).lower()))
            if parts in CONTENT_NAMES:
                return False
            if parts and MODIFIERS.isdisjoint(parts):
                apart = apart or parts[-1] in APART_WORDS or (parts[0] in APART_WORDS and FRAME_WORDS.issuperset(parts[1:]))
    return apart


def _tag_end(page: str, at: int, last_quote: dict[str, int]) -> int:
    """Where the ``>`` of a tag stands, quoted values aside; -1 for a tag that never ends."""
    while True:
        stop = _STOP.search(page, at)
        if stop is None:
            return -1
        quote = stop.group(1)
        if quote is None:
            return stop.start()
        # an opening quote without a closing one is a character like others
        at = page.find(quote, stop.end()) + 1 if stop.end() <= last_quote[quote] else stop.end()


def blocks_of(page: str) -> list[tuple[str, str, bool, bool]]:
    """Blocks in page order: path of the elements around, text, in a main region, apart.

    Linear in the page: each character is looked at a bounded number of times, whatever is unclosed
    or stray.
    """
    out: list[tuple[str, str, bool, bool, list | None]] = []
    # open elements: name, in a main region, apart by an element's name, mark of the next element around that
    # is named apart, words of the block that goes on after the element; a mark: whether it holds,
    # whether it is an outermost article or main or has one inside, the mark around it
    open_: list[tuple[str, bool, bool, list | None, list[str] | None]] = [("", False, False, None, None)]
    counts: Counter[str] = Counter()
    words: list[str] = []
    last_quote = {q: page.rfind(q) for q in "\"'"}

    def close() -> None:
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            words.clear()
            if text:
                out.append((">".join(x[0] for x in open_[-4:]), text, *open_[-1][1:4]))

    def pop() -> None:
        nonlocal words
        name, _, _, _, around = open_[-1]
        if around is not None:
            close()
            words = around
        elif name in BLOCKS:
            close()
        open_.pop()
        counts[name] -= 1

    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start != at:
            words.append(page[at : start if start >= 0 else end])
            if start < 0:
                break
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        match = _NAME.match(page, start)
        if match is None:
            if page.startswith(("<!", "<?"), start):
                stop = page.find(">", start)
                at = stop + 1 if stop >= 0 else end
            else:
                words.append("<")
                at = start + 1
            continue
        name, slash = match.group(1).lower(), page[start + 1] == "/"
        stop = _tag_end(page, match.end(), last_quote)
        if stop < 0:
            break
        attributes, at = page[match.end() : stop], stop + 1
        if name == "br":
            words.append(" ")
        if slash:
            if name in BLOCKS:
                close()
            if counts[name] > 0:
                while open_[-1][0] != name:
                    pop()
                pop()
            continue
        if name in BLOCKS:
            close()
        if name in VOID or attributes.endswith("/"):
            continue
        hidden = bool(attributes) and _HIDDEN.search(attributes) is not None and name not in ("html", "body")
        apart, named = name in APART or hidden, name not in APART and _named_apart(name, attributes)
        if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and open_[-1][0] == name:
            pop()  # these end where the next one begins
        elif name in BLOCKS and len(open_) > 1 and open_[-1][0] == "p":
            pop()
        around = None
        if (apart or named) and name not in BLOCKS:
            around, words = words, []  # the block goes on behind the left-out element
        if name in RAW:
            stop = re.compile(f"</{name}", re.I).search(page, at)
            at = stop.start() if stop else end
        _, main, out_of, mark, _ = open_[-1]
        header = name == "header" and not main
        inside = name in MAIN and not (out_of or apart)
        above = mark if inside else None
        while above is not None and not above[1]:  # those further out were seen together with it
            above[0], above[1] = above[0] and main, True
            above = above[2]
        if named:
            mark = [True, inside, mark]
        open_.append((name, main or name in MAIN, out_of or apart or header, mark, around))
        counts[name] += 1
    while len(open_) > 1:
        pop()
    close()
    strict, lenient = _Held(lambda mark: mark[0]), _Held(lambda mark: mark[0] and not mark[1])
    held = strict if any(main and not out_of and not strict(mark) for _, _, main, out_of, mark in out) else lenient
    return [(path, text, main, out_of or held(mark)) for path, text, main, out_of, mark in out]


class _Held:
    """Whether a mark or one around it holds; every mark is asked once."""

    def __init__(self, holds):
        self.holds = holds
        self.known: dict[int, bool] = {}

    def __call__(self, mark: list | None) -> bool:
        chain = []
        while mark is not None and id(mark) not in self.known:
            chain.append(mark)
            mark = mark[2]
        answer = self.known[id(mark)] if mark is not None else False
        for own in reversed(chain):
            answer = self.known[id(own)] = answer or bool(self.holds(own))
        return answer


def code_of(text: str) -> int:
    """64-bit code of a token, the same in every process."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def run_codes(tokens: np.ndarray, run: int) -> np.ndarray:
    """Code of the run of ``run`` tokens that begins at each place of a stream."""
    places = max(0, len(tokens) - run + 1)
    code = np.full(places, run, dtype=np.uint64)
    for i in range(run):
        code = (code ^ code >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + tokens[i : i + places].view(np.uint64)
    return ((code ^ code >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def distinct_runs(streams: list[np.ndarray], run: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of all streams that hold ``run`` tokens, equal runs side by side, and where each
    distinct run begins among them.

    The suffix array is sorted to depth ``run`` by doubling; suffixes do not reach over the end of
    their stream.
    """
    lengths = [len(s) for s in streams]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if lengths else 0
    if not total:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    left = np.repeat(ends, lengths) - np.arange(total)  # tokens up to the stream's end
    rank = np.unique(np.concatenate(streams), return_inverse=True)[1].astype(np.int64) + 1
    depth = 1
    while depth < run:
        step = min(depth, run - depth)
        later = np.zeros(total, dtype=np.int64)
        inside = left > step
        later[inside] = rank[np.nonzero(inside)[0] + step]
        rank = np.unique(rank * (total + 2) + later, return_inverse=True)[1].astype(np.int64) + 1
        depth += step
    suffixes = np.argsort(rank, kind="stable")
    suffixes = suffixes[left[suffixes] >= run]
    return suffixes, np.nonzero(np.diff(rank[suffixes], prepend=-1))[0]


def streams_of(texts: list[str], codes: list[int], known: dict[str, int]) -> list[tuple[np.ndarray, int]]:
    """Streams of tokens of a page, blocks and words, each with the length of a run that counts."""
    words = [w for text in texts for w in text.split()]
    for w in words:
        if w not in known:
            known[w] = code_of(w)
    return [(np.array(codes, dtype=np.int64), RUN), (np.array([known[w] for w in words], dtype=np.int64), WORDS)]


def group_runs(pages: list[tuple[int | None, list[str], list[int]]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct runs of a group of pages: code, least and greatest page_id; on a page without one."""
    blank = np.array([page_id is None for page_id, _, _ in pages])
    ids = np.array([page_id or 0 for page_id, _, _ in pages], dtype=np.int64)
    most = np.iinfo(np.int64)
    out, known = [], {}
    for kind in zip(*(streams_of(texts, codes, known) for _, texts, codes in pages), strict=True):
        run = kind[0][1]
        streams = [tokens for tokens, _ in kind]
        suffixes, first = distinct_runs(streams, run)
        if not len(suffixes):
            continue
        owner = np.repeat(np.arange(len(streams)), [len(s) for s in streams])[suffixes]
        at = np.concatenate([np.concatenate([run_codes(s, run), np.zeros(min(run - 1, len(s)), dtype=np.int64)]) for s in streams])
        low = np.minimum.reduceat(np.where(blank, most.max, ids)[owner], first)
        high = np.maximum.reduceat(np.where(blank, most.min, ids)[owner], first)
        out.append((at[suffixes[first]], low, high, np.logical_or.reduceat(blank[owner], first)))
    if not out:
        return [np.zeros(0, dtype=np.int64)] * 3, np.zeros(0, dtype=bool)
    *numbers, blanks = (np.concatenate(x) for x in zip(*out, strict=True))
    return numbers, blanks


def covered(tokens: np.ndarray, run: int, repeated: np.ndarray) -> np.ndarray:
    """Which tokens of a stream lie in a run whose code is among the repeated ones."""
    starts = np.nonzero(np.isin(run_codes(tokens, run), repeated))[0]
    out = np.zeros(len(tokens), dtype=bool)
    for i in range(run):
        out[starts + i] = True
    return out


def unique_text(texts: list[str], codes: list[int], own: list[bool], repeated: np.ndarray, known: dict[str, int]) -> str:
    """Text of a page without declared main region: what no repeated run covers of its own blocks."""
    in_blocks, in_words = (covered(tokens, run, repeated).tolist() for tokens, run in streams_of(texts, codes, known))
    kept, at = [], 0
    for text, mine, common in zip(texts, own, in_blocks, strict=True):
        words = text.split()
        common_words = in_words[at : at + len(words)]
        at += len(words)
        if mine and not common and not all(common_words):
            parts = [(out, list(part)) for out, part in groupby(zip(words, common_words, strict=True), lambda x: x[1])]
            # the few words by which a run reaches into the next block are that block's own
            kept.append(" ".join(w for out, part in parts if not out or len(part) < WORDS for w, _ in part))
    return "\n".join(kept)


def _parse(batches):
    for batch in batches:
        columns: list[list] = [[], [], [], [], []]
        for page in batch.column(3).to_pylist():
            blocks = blocks_of(page or "")
            declared = any(main and not apart for _, _, main, apart in blocks)
            columns[0].append(declared)
            columns[1].append([text for _, text, _, _ in blocks])
            columns[2].append([code_of(f"{path}\0{text}") for path, text, _, _ in blocks])
            columns[3].append([not apart and (main or not declared) for _, _, main, apart in blocks])
            columns[4].append(code_of("\n".join(text for _, text, main, apart in blocks if main and not apart)) if declared else None)
        kinds = (pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            names=["page_id", "url", "host", "declared", "texts", "codes", "own", "main"],
        )


def main_streams(texts: list[str], known: dict[str, int]) -> list[tuple[np.ndarray, int]]:
    """Streams of the blocks of a main region, whatever elements they stand in."""
    return streams_of(texts, [code_of(text) for text in texts], known)


def frequent_runs(regions: list[list[str]]) -> np.ndarray:
    """Codes of the runs that stand in more than half of some main regions."""
    out, known = [np.zeros(0, dtype=np.int64)], {}
    for kind in zip(*(main_streams(texts, known) for texts in regions), strict=True):
        run, streams = kind[0][1], [tokens for tokens, _ in kind]
        suffixes, first = distinct_runs(streams, run)
        if not len(suffixes):
            continue
        lengths = [len(s) for s in streams]
        owner = np.repeat(np.arange(len(streams)), lengths)[suffixes]
        of = np.repeat(np.arange(len(first)), np.diff(first, append=len(suffixes)))
        pages = np.bincount(np.unique(of * len(streams) + owner) // len(streams), minlength=len(first))
        ends = np.cumsum(lengths)
        for at in suffixes[first[2 * pages > len(regions)]]:
            stream = np.searchsorted(ends, at, side="right")
            start = at - (ends[stream] - lengths[stream])
            out.append(run_codes(streams[stream][start : start + run], run))
    return np.concatenate(out)


def notices(parsed: DataFrame) -> DataFrame | None:
    """Runs in the main regions of more than half of a host's different pages: host, marks (their codes);
    None if there are none."""
    declared = parsed.filter("declared")
    sites = declared.groupBy("host").agg(F.count_distinct("main").alias("regions")).filter(F.col("regions") >= COMMON)
    sites = written(sites.withColumn("groups", F.ceil(F.col("regions") / PAGES)), "sites")
    if sites.count() <= BROADCAST_HOSTS:
        sites = F.broadcast(sites)
    regions = declared.join(sites, "host").select(
        "host", F.pmod(F.xxhash64("main"), F.col("groups")).alias("deal"), "main", F.filter("texts", lambda _, i: F.get("own", i)).alias("texts")
    )

    def once(batches):
        seen = set()  # codes of the task's pages: copies of a page are not shuffled
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            new = batch.filter(pa.array([key not in seen and not seen.add(key) for key in keys], pa.bool_()))
            texts = ["\n".join(blocks).encode("utf-8", "surrogatepass") for blocks in new.column(3).to_pylist()]
            packed = [pa.compress(text, codec="zstd", asbytes=True) for text in texts]  # Spark's own codec takes half as much again
            columns = [*new.columns[:3], pa.array([len(text) for text in texts], pa.int32()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "deal", "main", "size", "packed"])

    def find(key, table):
        pages = {main: (packed, size) for main, packed, size in zip(*(table.column(c).to_pylist() for c in ("main", "packed", "size")), strict=True)}
        texts = [pa.decompress(packed, size, codec="zstd", asbytes=True).decode("utf-8", "surrogatepass") for _, (packed, size) in sorted(pages.items())]
        codes = np.unique(frequent_runs([text.split("\n") for text in texts]))
        return pa.table({"host": pa.array([key[0].as_py()] * len(codes), pa.string()), "code": pa.array(codes, pa.int64())})

    dealt = arrow_map(regions, once, "host string, deal long, main long, size int, packed binary")
    found = dealt.groupBy("host", "deal").applyInArrow(find, "host string, code long")
    maybe = written(found, "frequent-runs")
    if maybe.isEmpty():
        return None
    asked = maybe.groupBy("host").agg(F.collect_set("code").alias("asked"))

    def held(batches):
        for batch in batches:
            known: dict[str, int] = {}
            rows = []
            for host, main, texts, codes in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                wanted = np.array(codes, dtype=np.int64)
                for tokens, run in main_streams(texts, known):
                    rows += [(host, main, code) for code in np.intersect1d(run_codes(tokens, run), wanted).tolist()]
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["host", "main", "code"])

    marks = arrow_map(regions.join(asked, "host").select("host", "main", "texts", "asked"), held, MARKS)
    marks = marks.groupBy("host", "code").agg(F.count_distinct("main").alias("n")).join(sites, "host")
    marks = marks.filter((F.col("n") >= COMMON) & (2 * F.col("n") > F.col("regions")))
    return written(marks.groupBy("host").agg(F.collect_list("code").alias("marks")), "notices")


def _without_notices(batches):
    for batch in batches:
        known: dict[str, int] = {}
        texts = []
        for blocks, marks in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            codes = [code_of(text) for text in blocks]
            kept = unique_text(blocks, codes, [True] * len(blocks), np.array(marks, dtype=np.int64), known) if marks else ""
            texts.append(kept or "\n".join(blocks))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        host.alias("host"),
        F.col("html").cast("string").alias("html"),
    )
    parsed = written(arrow_map(rows, _parse, PARSED).withColumn("row", F.monotonically_increasing_id()), "blocks", compression="zstd")
    declared, mine = parsed.filter("declared"), F.filter("texts", lambda _, i: F.get("own", i))
    common = notices(parsed)
    if common is None:
        declared = declared.select("page_id", "url", F.array_join(mine, "\n").alias("text"))
    else:
        marked = declared.join(F.broadcast(common) if common.count() <= BROADCAST_HOSTS else common, "host", "left")
        declared = arrow_map(marked.select("page_id", "url", mine.alias("texts"), "marks"), _without_notices, "page_id long, url string, text string")
    declared = declared.withColumn("n_chars", F.length("text").cast("long"))

    # hosts with a page that declares no main region, and into how many groups their pages are dealt
    hosts = parsed.groupBy("host").agg(F.count("*").alias("pages"), F.bool_and("declared").alias("all_declared"))
    hosts = written(hosts.filter("not all_declared").select("host", F.ceil(F.col("pages") / PAGES).alias("groups")), "open-hosts")
    if hosts.count() <= BROADCAST_HOSTS:  # beyond that the join shuffles the pages once more
        hosts = F.broadcast(hosts)
    dealt = parsed.join(hosts, "host").withColumn("deal", F.pmod(F.xxhash64("row"), F.col("groups")))

    def find(key, table):
        (codes, low, high), blank = group_runs(list(zip(*(table.column(c).to_pylist() for c in ("page_id", "texts", "codes")), strict=True)))
        none = low > high
        columns = [pa.array([k.as_py()] * len(codes), t) for k, t in zip(key, (pa.string(), pa.int64()), strict=True)]
        columns += [pa.array(codes, pa.int64()), pa.array(low, pa.int64(), mask=none), pa.array(high, pa.int64(), mask=none), pa.array(blank, pa.bool_())]
        return pa.table(dict(zip(("host", "deal", "code", "low", "high", "blank"), columns, strict=True)))

    def cut(left, right):
        repeated = np.array(right.column("code").to_pylist(), dtype=np.int64)
        known: dict[str, int] = {}
        texts = [unique_text(*page, repeated, known) for page in zip(*(left.column(c).to_pylist() for c in ("texts", "codes", "own")), strict=True)]
        return pa.table(
            {
                "page_id": left.column("page_id").cast(pa.int64()),
                "url": left.column("url").cast(pa.string()),
                "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            }
        )

    ship(pages.sparkSession)
    found = written(dealt.select("host", "deal", "page_id", "texts", "codes").groupBy("host", "deal").applyInArrow(find, FOUND), "runs")
    whole = found.groupBy("host", "code").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or("blank").alias("blank"))
    repeated = whole.filter("low <> high or (blank and low is not null)").select("host", "code")
    marks = found.select("host", "deal", "code").join(repeated, ["host", "code"], "left_semi").select("host", "deal", "code")
    undeclared = dealt.filter("not declared").select("host", "deal", "page_id", "url", "texts", "codes", "own")
    unique = undeclared.groupBy("host", "deal").cogroup(marks.groupBy("host", "deal")).applyInArrow(cut, PAGE)
    return declared.select("page_id", "url", "text", "n_chars").unionByName(unique)
