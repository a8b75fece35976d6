"""The operators against brute force, on whole small tables and on awkward rows."""

import collections
import functools
import html
import json
import re
import struct
import zlib

import numpy as np
import pytest
import public_tokenizers
from oracle_check import compare, connect, spark_entry
from tokenizers import Tokenizer

from paramill.llm import exact_dedup, html_text, jaccard_join, language, mixing, neighbours, packing, quality, token_counts, token_files

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, sequence_id long"
TEXTS = [
    None, "", " \n\t ", "One", "one", "ONE", "Ünïcode ÉCOLE", "a b c d e f g h i j", "A b c d e f g h i j", "a b c d e f g h i j k",
    "x" * 30_000, "word " * 9_000, "don't  stop\n\n<|endoftext|> now", "1 2 3 !!! ???", "İstanbul Σας ﬁ 中文 é", "trailing ", " leading",
]


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, ["en", None][i % 2], ["s1", "s2", None][i % 3], None, 0.5, 7) for i, t in enumerate(TEXTS)]
    rows += [(3, "One", "en", "s1", 3, 0.5, 7), (None, "one", None, None, None, None, None), (99, "one", "de", "s2", 1, 0.1, 1)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def ids_of(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def packed_bytes(ids, end):
    return np.array([*ids, end], dtype="<u4").tobytes()


@pytest.mark.parametrize("name", ["op2_ngram_jaccard_join", "op10_exact_dedup"])
def test_query_matches_sql(spark, con, folder, name):
    assert compare(spark, con, name, folder) is None


def test_exact_dedup_on_awkward_rows(odd, none):
    rows = exact_dedup.duplicates(odd, capacity=2).collect()  # a small capacity makes the directory double
    assert len(rows) == odd.count()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r.text_sha256].append(r)
    for g in groups.values():
        assert {r.group_size for r in g} == {len(g)} and sum(r.kept for r in g) == 1
        assert {r.keep_id for r in g} == {max(r.doc_id for r in g if r.doc_id is not None)}
    assert any(len(g) == 6 for g in groups.values())  # one, One, ONE, a repeated row, a null id, 99
    assert exact_dedup.without_duplicates(odd).count() == len(groups)
    assert exact_dedup.duplicates(none).count() == 0


def test_jaccard_join_on_awkward_rows(odd, none):
    rows = {r.doc_id: r for r in jaccard_join.near_duplicates(odd).collect() if r.doc_id not in (None, 3)}
    assert rows[0].n_shingles == rows[2].n_shingles == 0 and rows[0].component_id == 0 and rows[2].component_id == 2
    assert rows[99].component_id == rows[4].component_id == 3  # one word; a null id links with nothing
    assert rows[7].component_id == rows[8].component_id == rows[9].component_id == 7  # 6 of 7 shingles
    assert jaccard_join.near_duplicates(none).count() == 0


def test_large_block_is_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", 4)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[:i] + ["new"] + words[i + 1 :])) for i in range(5, 30)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()}
    sets = {r.doc_id: set(zip(*[r.text.split()[k:] for k in range(5)])) for r in docs.collect()}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_token_counts(odd, none, spark, folder):
    rows = token_counts.token_counts(odd, tables=True).collect()
    whole = ids_of("byte_bpe_50k.json", [t or "" for t in TEXTS])
    for r in rows:
        if r.doc_id is not None and r.doc_id < len(TEXTS):
            assert r.n_tokens == len(whole[r.doc_id]) and r.over_limit == (r.n_tokens > 1024)
            assert r.n_bytes == len((TEXTS[r.doc_id] or "").encode())
            table = token_counts.PrefixTable.load(bytes(r.prefixes))
            assert table.at(r.n_bytes) == r.n_tokens
    text = TEXTS[12]
    table = token_counts.PrefixTable(token_counts.counter().prefixes(text))
    for n in range(len(text) + 1):
        assert table.at(len(text[:n].encode())) == len(ids_of("byte_bpe_50k.json", [text[:n]])[0])
    cut = table.fits(4, text)
    assert table.at(cut) <= 4 and len(ids_of("byte_bpe_50k.json", [text.encode()[:cut].decode()])[0]) <= 4
    assert token_counts.token_counts(none).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = {r.doc_id: len(ids_of("byte_bpe_50k.json", [r.text])[0]) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()} == want


def check_packing(rows, texts, end=1, window=2048):
    whole = {i: packed_bytes(x, end) for i, x in zip(texts, ids_of("word_bpe_49k.json", texts.values()), strict=True)}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(whole[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
        assert r.doc_tokens == len(whole[r.doc_id]) // 4
    assert pieces.keys() == whole.keys()
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert 4 * at == len(whole[i])
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    return sum(len(w) // 4 for w in whole.values()) / (window * len(sequences))


def test_packing(spark, folder, odd, none):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert check_packing(packing.pack(docs).collect(), {r.doc_id: r.text for r in docs.collect()}) > 0.95
    some = odd.filter("doc_id < 17").dropDuplicates(["doc_id"])
    check_packing(packing.pack(some, open_windows=2).collect(), {r.doc_id: r.text for r in some.collect()})
    assert packing.pack(none).count() == 0


def test_token_files(spark, folder, odd, none):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    at = 0
    got = {r.doc_id: r for r in token_files.token_file_digest(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i in sorted(texts):
        data = packed_bytes(ids_of("word_bpe_49k.json", [texts[i]])[0], 2)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(data) // 4, zlib.crc32(data))
        at += len(data) // 4
    assert token_files.token_file_digest(odd).count() == odd.count()
    assert token_files.token_file_digest(none).count() == 0


def test_block_gives_single_documents():
    random = np.random.default_rng(3)
    docs = [struct.pack("<50I", *np.tile(random.integers(0, 30, 5), 10)) + struct.pack("<I", 2) for _ in range(200)]
    block = token_files.Block(token_files.Block.pack(list(range(200)), docs))
    assert len(block.rules) and len(block.symbols) < 0.7 * block.n_ids
    assert all(block.document(i).tobytes() == docs[i] for i in range(200))


def test_mixing(spark, folder, odd, none):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = mixing.mix(docs).collect()
    words = re.compile(r"[^\x20\x09-\x0D]+")
    size = {r.doc_id: len(words.findall(r.text or "")) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    total = collections.Counter()
    for i, s in source.items():
        total[s] += size[i]
    weights = dict(zip(sorted(total), (3, 1, 2) * len(total), strict=False))
    full, wanted = set(), 1.5 * sum(total.values())
    while True:  # share, stop the full ones, share their excess
        rest = wanted - sum(2 * total[s] for s in full)
        unit = rest / sum(weights[s] for s in weights if s not in full)
        target = {s: 2 * total[s] if s in full else unit * weights[s] for s in weights}
        if not (more := {s for s in weights if target[s] > 2 * total[s] + 1e-6} - full):
            break
        full |= more
    taken = collections.Counter()
    for r in rows:
        assert r.size == size[r.doc_id] and r.source_size == total[source[r.doc_id]] and r.taken in (0, r.size, 2 * r.size)
        assert r.target == pytest.approx(target[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    assert len(rows) == len(size) and all(abs(taken[s] - target[s]) <= 0.05 * target[s] + 5 for s in target)
    assert sorted(rows) == sorted(mixing.mix(docs).collect())
    assert mixing.mixed(docs).count() == sum(r.copies for r in rows)
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0


def test_language(spark, folder, odd, none):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = language.identify(docs).collect()
    held = [r for r in rows if r.held_out]
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows} == {True}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    pieces = language.Pieces()
    probability = np.full((pieces.size + 1, 1), 0.01)

    @functools.cache
    def ways(w):
        """Every segmentation of w, and how often each uses the piece "o": probability, uses."""
        if not w:
            return 1.0, 0.0
        cuts = [(w[:n], ways(w[n:])) for n in range(1, len(w) + 1) if n == 1 or w[:n] in pieces.ids]
        return sum(0.01 * p for _, (p, _) in cuts), sum(0.01 * (u + p * (first == "o")) for first, (p, u) in cuts)

    words = ["other", "x", "ꙮ", "straße", "日本語", "o" * 32, "an", "other"]
    total = [ways("▁" + w)[0] for w in words]
    assert np.allclose(pieces.forward(words, probability)[:, 0], total, rtol=1e-12, atol=0)
    times = np.arange(1, len(words) + 1)
    uses = sum(n * ways("▁" + w)[1] / p for w, n, p in zip(words, times, total, strict=True))
    assert pieces.expected(words, times, probability[:, 0])[pieces.ids["o"]] == pytest.approx(uses)
    got = {r.doc_id: r.lang_pred for r in language.identify(odd).collect()}
    assert got[0] == got[1] == got[2] == got[13] == "und" and got[9] == "en"
    assert language.identify(none).count() == 0


def test_quality(spark, odd, none):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality.classify(docs, labels).collect() if r.doc_id in truth and r.held_out]
    good, bad = ([r.score for r in rows if truth[r.doc_id] == q] for q in (1, 0))
    assert np.mean(np.array(good)[:, None] > np.array(bad)) > 0.9
    got = quality.classify(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == odd.count() and {r.score for r in got} == {0.5}
    assert quality.classify(none, labels).count() == 0
    network = quality.Network()
    text = "é plain text " * 9_000
    parts = network.pooled(quality.chunks_of(text.encode()))
    logit = network.logit(parts.max(axis=0), parts.mean(axis=0))
    assert network.scores(["", text])[1] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-4)


def test_neighbours(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = table.collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    got = collections.defaultdict(set)
    for r in neighbours.nearest(table).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for i in np.nonzero(ids % 50 == 0)[0]:
        near = [j for j in np.lexsort((ids, -(vectors @ vectors[i]))) if j != i][:5]
        hits += len({int(ids[j]) for j in near} & got[ids[i]])
    assert hits >= 0.9 * 5 * len(got) and len(got) == (ids % 50 == 0).sum()
    kind = "vec_id long, embedding array<float>, label int, score double"
    odd = [(0, [1.0, 0.0], 1, 0.0), (1, [0.0, 1.0], 1, 0.0), (2, None, 1, 0.0), (3, [0.0, 0.0], 1, 0.0), (4, [1.0, None], 1, 0.0)]
    odd += [(5, [float("nan"), 1.0], 1, 0.0), (6, [1.0, 2.0, 3.0], 1, 0.0), (None, [1.0, 1.0], 1, 0.0), (50, [2.0, 0.0], 1, 0.0)]
    odd += [(i, [1.0, 0.0], 1, 0.0) for i in range(60, 80)]
    got = neighbours.nearest(spark.createDataFrame(odd, kind)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 50), *((0, i) for i in range(60, 64)), (50, 0), *((50, i) for i in range(60, 64))]
    assert neighbours.nearest(spark.createDataFrame([], kind)).count() == 0


def test_html(spark, folder):
    table = spark.read.parquet(f"{folder}/pages.parquet")
    source = {r.page_id: r.html for r in table.collect()}
    for r in html_text.extract(table).collect():
        article = re.search(r"<article>(.*)</article>", source[r.page_id], re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    shared = "<div>Our shop</div><div>All rights</div><div>Contact us</div>"
    odd = [(1, "http://h/a", f"{shared}<p>First  &amp; own<br>text</p><form>no</form>"), (2, "http://h/b", f"{shared}<p>Second</p>")]
    odd += [(3, None, None), (4, "http://h/c", ""), (5, "x", "<main><p>In<aside>out</aside><div class='user-comments'>no</div><p>too</main><p>not")]
    odd += [(2, "http://h/b", f"{shared}<p>Second</p>"), (None, "y", "<p>a<script>if (a < b) {}</script>b &lt;i&gt;")]
    got = html_text.extract(spark.createDataFrame(odd, "page_id long, url string, html string")).collect()
    texts = collections.Counter((r.page_id, r.text) for r in got)
    assert texts == {(1, "First & own text"): 1, (2, "Second"): 2, (3, ""): 1, (4, ""): 1, (5, "In\ntoo"): 1, (None, "ab <i>"): 1}


def html_texts(spark, rows):
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return {r.page_id: r.text for r in got}


def test_html_large_host(spark):
    # two pages of a large host share a template each, far fewer than its groups would bring together
    n = 600
    rows = [(i, "http://large/a", "".join(f"<div>{w} {i % n}</div>" for w in ("shop", "rights", "contact")) + f"<p>own {i}") for i in range(2 * n)]
    assert 2 * n > 2 * html_text.PAGES
    assert html_texts(spark, rows) == {i: f"own {i}" for i in range(2 * n)}
    rows += [(None, "http://none/a", "<div>a</div><div>b</div><div>c</div><p>x"), (-1, "http://none/b", "<div>a</div><div>b</div><div>c</div><p>y")]
    rows += [(-2, "http://other/b", "<div>a</div><div>b</div><div>c</div><article>z"), (-3, "http://other/c", "<div>a</div><div>b</div><div>c</div><p>v")]
    got = html_texts(spark, rows[2 * n :])
    assert got == {None: "x", -1: "y", -2: "z", -3: "v"}


def test_html_repeated_passages(spark):
    notice = " ".join(f"notice{i}" for i in range(60))
    rows = [(i, "http://one/a", f"<p>{notice}</p><div>own {i}</div>") for i in range(4)]  # one block
    half = [" ".join(f"{w}{i}" for i in range(8)) for w in ("left", "right")]
    rows += [(i, "http://two/a", f"<p>own {i}</p><p>{half[0]}<div>{half[1]}</div>") for i in range(10, 14)]  # two blocks
    rows += [(i, "http://part/a", f"<p>before{i} {notice} after{i}</p><p>own {i}</p>") for i in range(20, 24)]  # part of a block
    rows += [(30, "http://else/a", f"<p>{notice}</p>"), (31, "http://few/a", "<p>a b c d"), (32, "http://few/a", "<p>a b c d")]
    want = {i: f"own {i}" for i in [*range(4), *range(10, 14)]} | {i: f"before{i} after{i}\nown {i}" for i in range(20, 24)}
    assert html_texts(spark, rows) == want | {30: notice, 31: "a b c d", 32: "a b c d"}


def test_html_class_names(spark):
    kept = [
        '<article class="post comments-open">{}</article>', '<main class="content page-with-sidebar">{}</main>',
        '<div class="col no-sidebar"><article>{}</article></div>', '<div id="social-science"><article>{}</article></div>',
        '<div class="sidebar widget"><main>{}</main></div>', '<article class="sponsored">{}</article>',
        '<main><div class="widget"><article>{}</article></div></main>', '<div class="noSidebar">{}</div>',
        '<article>{}<div class="comments"><article class="comment">no</article></div></article>',
    ]
    left = ['<div class="ad">{}</div>', '<div class="x user-comments">{}</div>', "<div id=siteFooter>{}</div>", '<ul role="navigation">{}</ul>']
    left += ['<main><div class="comments"><article>{}</article></div>main</main>']
    rows = [(i, f"http://h{i}/a", page.format(f"text {i}")) for i, page in enumerate(kept + left)]
    got = html_texts(spark, rows)
    assert [got[i] for i in range(len(kept))] == [f"text {i}" for i in range(len(kept))]
    assert [got[i] for i in range(len(kept), len(rows))] == ["", "", "", "", "main"]


def test_pipeline(spark, folder, none):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "source_mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = spark_entry.queries()["pipeline"](spark, folder).collect()
    repeats = collections.Counter(r.doc_id for r in docs.collect())
    ends = collections.Counter(r.doc_id for r in rows if r.start + r.length == r.doc_tokens)
    assert ends == repeats and {r.doc_id for r in rows} == set(texts)
    assert json.dumps(sorted(texts)) and all(stage(spark, none, folder).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_token_tables_of_the_query(spark, folder):
    rows = spark_entry.queries()["op5_token_counts"](spark, folder).limit(20).collect()
    for r in rows:
        table = token_counts.PrefixTable.load(bytes(r.prefixes))
        assert len(table.counts) == r.n_bytes + 1 and table.at(r.n_bytes) == r.n_tokens and table.at(0) == 0
