"""Vector codes, the filter audit and benchmark passages against brute force and SQL."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pytest
from oracle_check import compare, connect
from paramill.llm import decontamination, filter_audit, vector_codes
from pyspark.sql import functions as F

NAMES = ["op11_vector_codes", "op12_filter_audit", "op13_decontamination"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, folder, name):
    assert compare(spark, connect(folder), name, folder) is None


# --- vector codes ---------------------------------------------------------------------


def test_gnat_is_a_full_search():
    rng = np.random.default_rng(3)
    computed = 0
    for size in (1, 2, 5, 16, 40):
        for spread in (1, 3, 4000):
            entries = rng.integers(-spread, spread + 1, (size, 8))
            queries = rng.integers(-spread, spread + 1, (300, 8))
            squared = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
            who, best, n = vector_codes.Gnat(entries).nearest(queries)
            assert (who == squared.argmin(axis=1)).all() and (best == squared.min(axis=1)).all()
            computed += n
    far = np.repeat(np.arange(16)[:, None] * 10_000, 8, axis=1)  # well parted entries: most are never looked at
    _, _, n = vector_codes.Gnat(far).nearest(far + 1)
    assert n < 0.7 * 16 * 16


def brute_codes(rows):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [([math.floor(4096 * x) for x in v], i, label) for i, v, label in kept]
    order = sorted(range(len(whole)), key=lambda k: (whole[k][1] is None, whole[k][1] or 0, kept[k][1]))
    n = len(whole[order[0]][0])
    whole = [w for w in whole if len(w[0]) == n]
    cut = [p * n // 8 for p in range(9)]
    first = [w for w in (([math.floor(4096 * x) for x in kept[k][1]]) for k in order) if len(w) == n][:16]
    books = [[f[cut[p] : cut[p + 1]] for f in first] for p in range(8)]

    def nearest(book, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(6):
        for p in range(8):
            own = collections.defaultdict(list)
            for v, _, _ in whole:
                own[nearest(books[p], v[cut[p] : cut[p + 1]])[1]].append(v[cut[p] : cut[p + 1]])
            for k, parts in own.items():
                books[p][k] = [sum(c) // len(parts) for c in zip(*parts, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = []
    for v, i, label in whole:
        found = [nearest(books[p], v[cut[p] : cut[p + 1]]) for p in range(8)]
        coded.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    per = collections.Counter()
    for _, _, e, label in coded:
        per[label] += e
    return sorted((str(i), c, e, per[label], sha) for i, c, e, label in coded)


VECTOR = "vec_id long, embedding array<float>, label int, name string, code string, error double"


@pytest.mark.parametrize("width", [8, 16, 20])
def test_vector_codes_on_awkward_rows(spark, width):
    rng = np.random.default_rng(width)
    draw = lambda: [float(np.float32(x)) for x in np.round(rng.normal(0, 0.01, width), 3)]
    rows = [(i, draw(), [0, 1, None][i % 3]) for i in range(40)]
    rows += [(7, rows[7][1], 1), (7, draw(), 0), (None, draw(), None), (90, None, 1), (91, [None] * width, 1)]
    rows += [(92, [float("nan")] * width, 0), (93, [float("inf")] * width, 0), (94, [0.5] * (width - 1), 0), (95, [-1.0] * width, 2), (96, [], 1)]
    df = spark.createDataFrame([(*r, "x", "y", 0.5) for r in rows], VECTOR)
    got = sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.vector_codes(df).collect())
    assert got == brute_codes(rows)


def test_vector_codes_of_few_or_no_or_huge_rows(spark):
    few = [(3, [0.1] * 8, 1), (1, [0.2] * 8, 1), (2, [0.1] * 8, None)]
    df = spark.createDataFrame([(*r, "x", "y", 0.5) for r in few], VECTOR)
    got = sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.vector_codes(df).collect())
    assert got == brute_codes(few)
    assert vector_codes.vector_codes(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, [40000.0] * 8, 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(ValueError):
        vector_codes.vector_codes(huge)


# --- filter audit ---------------------------------------------------------------------


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    masks = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        same = [j for j, other, _ in docs if (other or "") == text and j is not None]
        fails = [
            len(words) < 100,
            100 * len(set(words)) < 80 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            bool(re.search("[#$%&*|]", text)),
            i is not None and min(same) < i,
        ]
        masks.append((lang or "", fails, i in good and i is not None, i in toxic and i is not None))
    rows = {}
    for part in {m[0] for m in masks}:
        own = [m[1:] for m in masks if m[0] == part]
        for order in itertools.permutations(range(5)):
            for step, f in enumerate(order):
                c = collections.Counter()
                for fails, is_good, is_toxic in own:
                    before = not any(fails[g] for g in order[:step])
                    c["kept"] += before and not fails[f]
                    c["removed"] += before and fails[f]
                    c["redundant"] += not before and fails[f]
                    c["unique_fails"] += fails[f] and sum(fails) == 1
                    c["good_lost"] += before and fails[f] and is_good
                    c["toxic_lost"] += before and fails[f] and is_toxic
                rows[part, "".join("ABCDE"[g] for g in order), step + 1] = c
    shapley = collections.Counter()
    for (part, order, step), c in rows.items():
        shapley[part, order[step - 1]] += c["removed"]
    return {k: (*[c[n] for n in filter_audit.COUNTS], shapley[k[0], k[1][k[2] - 1]]) for k, c in rows.items()}


def test_filter_audit_on_awkward_rows(spark):
    words = " ".join(f"w{i}" for i in range(120))
    texts = [None, "", "A", words, words, words + " # x", "WORDS " * 200, "é x " * 150, words.upper(), "x" * 50_000, " \t\x0b\r\n "]
    docs = [(i, t, ["en", "", None, "fr"][i % 4]) for i, t in enumerate(texts)]
    docs += [(None, words, "en"), (None, "only here", "en"), (3, words, "de"), (50, words, "fr"), (0, "A", "en"), (12, None, "fr")]
    labels = [(3, 1, 0), (3, 0, 1), (4, 1, 1), (6, None, 1), (None, 1, 1), (99, 1, 1), (1, 1, None)]
    d = spark.createDataFrame([(*r, 5, 6) for r in docs], "doc_id long, text string, lang string, mask int, n long")
    q = spark.createDataFrame([(*r, 7) for r in labels], "doc_id long, quality int, toxic int, part int")
    got = {(r.part, r.filter_order, r.step): (*[r[c] for c in filter_audit.COUNTS], r.shapley) for r in filter_audit.audit(d, q).collect()}
    assert got == brute_audit(docs, labels)
    assert filter_audit.audit(d.limit(0), q).count() == 0
    assert filter_audit.audit(d, q.limit(0)).count() == len(got)


# --- benchmark passages ---------------------------------------------------------------


def lowered(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_leaks(docs, items, window):
    windows = collections.defaultdict(set)
    for item, text in items:
        words = lowered(text)
        k = min(len(words), window)
        for i in range(len(words) - k + 1 if words else 0):
            windows[tuple(words[i : i + k])].add(item or "")
    rows = []
    for doc, text in docs:
        words, hit, found = lowered(text), set(), set()
        for k in {len(w) for w in windows}:
            for i in range(len(words) - k + 1):
                own = windows.get(tuple(words[i : i + k]))
                if own:
                    hit |= set(range(i, i + k))
                    found |= own
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        rows.append((str(doc), len(words), len(hit), len(found), sha, bool(hit)))
    return sorted(rows)


def made_up(seed):
    rng = np.random.default_rng(seed)
    letters = list("abcd")
    items = [(str(i), " ".join(rng.choice(letters, rng.integers(0, 9)))) for i in range(8)]
    items += [("1", "a b"), ("9", None), (None, "C,c;a"), ("10", "Éa é"), ("11", " ".join(rng.choice(letters, 60)))]
    docs = [(i, "  ".join(rng.choice(letters, rng.integers(0, 40)))) for i in range(40)]
    docs += [(1, "éa"), (None, "Éa,é! a b"), (5, None), (6, ""), (7, "x" * 20_000 + " A--B"), (8, items[-1][1]), (8, items[-1][1])]
    return docs, items


@pytest.mark.parametrize("window", [1, 2, 4, 10])
@pytest.mark.parametrize("shard_words", [12, 100_000])
def test_leaks_against_brute_force(spark, window, shard_words):
    docs, items = made_up(window)
    d = spark.createDataFrame([(*r, "s", 1) for r in docs], "doc_id long, text string, items string, marks int")
    b = spark.createDataFrame(items, "item_id string, text string")
    got = sorted((str(r.doc_id), *r[1:]) for r in decontamination.contamination(d, b, window, shard_words).collect())
    assert got == brute_leaks(docs, items, window)


def test_leaks_of_empty_tables_and_cut_spans(spark):
    docs, items = made_up(1)
    kinds = "doc_id long, text string, row string, marks int, `a b` int"
    d = spark.createDataFrame([(*r, "s", 1, 2) for r in docs], kinds)
    b = spark.createDataFrame(items, "item_id string, text string")
    assert decontamination.contamination(d.limit(0), b).count() == 0
    assert {r.n_hit for r in decontamination.contamination(d, b.limit(0)).collect()} == {0}
    passage = " ".join(f"k{i}" for i in range(12))
    texts = ["Before it, " + passage.upper() + "; and after it there are twelve more words of its own here.", passage, "clean", None]
    d = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in enumerate(texts)], kinds)
    b = spark.createDataFrame([("q", passage)], "item_id string, text string")
    for shard_words in (5, 1000):
        out = {r.doc_id: r for r in decontamination.decontaminated(d, b, 10, 0.5, shard_words).collect()}
        assert out.keys() == {0, 2, 3} and out[0].text == "Before it; and after it there are twelve more words of its own here."
        assert out[2].text == "clean" and out[3].text is None and out[0].asDict() | {"text": 0} == {"doc_id": 0, "text": 0, "row": "s", "marks": 1, "a b": 2}
    assert d.withColumn("x", F.lit(1)).columns == decontamination.decontaminated(d.withColumn("x", F.lit(1)), b).columns
