"""Pipeline stages on tables whose columns and rows are awkward."""

import collections

import pyarrow as pa
import pytest
from paramill.llm import common, exact_dedup, jaccard_join, language, mixing

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _sha string, _size int, row string, `a b` int, own int, place int"
TEXTS = ["the house and the garden are old", "the house and the garden are old", None, "", "½ ² Ⅷ ①", "हिन्दी में लिखा हुआ", "la maison est belle", "das Haus ist alt"]


@pytest.fixture(scope="module")
def docs(spark):
    learnt = [(100 + i, t, lang) for i in range(40) for t, lang in (("the house and the garden are old", "en"), ("das Haus und der Garten sind alt", "de"))]
    rows = [(i % 5, t, None, ["s", None][i % 2], 1, 7, "x", 7, "r", 8, 9, 10) for i, t in enumerate(TEXTS)]
    rows += [(i, f"{t} {i}", lang, "s", 1, 7, "x", 7, "r", 8, 9, 10) for i, t, lang in learnt]
    rows += [rows[0], rows[0], (None, "the house", None, "s", 1, 7, "x", 7, "r", 8, 9, 10)]
    return spark.createDataFrame(rows, EXTRA)


STAGES = [language.identified, exact_dedup.without_duplicates, jaccard_join.without_near_duplicates, mixing.mixed]


@pytest.mark.parametrize("stage", STAGES)
def test_clashing_columns_pass_unchanged(docs, stage):
    out = stage(docs)
    assert out.schema == docs.schema and stage(docs.limit(0)).count() == 0
    given = collections.Counter(docs.collect())
    rows = out.collect()
    assert rows and set(rows) <= set(given)
    if stage is not mixing.mixed:
        assert not collections.Counter(rows) - given


def test_each_row_is_judged_by_its_own_text(docs):
    left = collections.Counter(r.text for r in language.identified(docs).collect() if r.doc_id is None or r.doc_id < 5)
    assert left["the house and the garden are old"] == 4 and not {None, "", "½ ² Ⅷ ①"} & set(left)


def test_letters_take_their_marks():
    assert language.words_of("हिन्दी में ½Ⅷ② x²y é é") == ["हिन्दी", "में", "x", "y", "é", "é"]


def test_one_of_equal_texts_stays(docs):
    rows = exact_dedup.without_duplicates(docs).collect()
    texts = [(r.text or "").lower() for r in rows]
    assert len(texts) == len(set(texts)) == len({(r.text or "").lower() for r in docs.collect()})
    assert [r.doc_id for r in rows if r.text == TEXTS[0]] == [1]


def test_reruns_of_the_mix_agree(docs):
    first = collections.Counter(mixing.mixed(docs).collect())
    assert first == collections.Counter(mixing.mixed(docs.repartition(7)).collect())
    taken = {(r.doc_id, r.source, r.size): 0 for r in mixing.mix(docs).collect()}
    assert sum(first.values()) == sum(r.copies for r in mixing.mix(docs).collect()) and taken


def test_batches_are_small_in_both_directions(spark):
    """Whatever an operator hands back, a task holds few rows of it outside the heap at a time."""

    class Table:
        sparkSession = spark

        def mapInArrow(self, work, schema):
            return work

    held = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(["x" * 20_000] * 5000)], names=["id", "text"])
    out = list(common.arrow_map(Table(), lambda batches: [pa.Table.from_batches(list(batches)).combine_chunks().to_batches()[0]], "")(iter([held])))
    assert pa.Table.from_batches(out).equals(pa.Table.from_batches([held]))
    assert max(b.num_rows for b in out) <= common.ROWS_AT_ONCE and max(b.nbytes for b in out) <= common.BYTES_AT_ONCE
    assert int(spark.conf.get(common.BATCH_BYTES)) == common.HANDED_BYTES
    spark.conf.set(common.BATCH_BYTES, "5000000")
    common.small_batches(spark)  # what the session says stays
    assert spark.conf.get(common.BATCH_BYTES) == "5000000"
    spark.conf.unset(common.BATCH_BYTES)
    common.small_batches(spark)
    assert int(spark.conf.get(common.BATCH_BYTES)) == common.HANDED_BYTES
