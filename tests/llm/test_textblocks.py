import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from routewise.llm import decontam_sw, pfair_mix, quality_bt
from routewise.llm import textblocks as tb
from routewise.llm.common import prepare, releasing

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ é漢 \t\n.1", max_size=40)), max_size=8)


def words_of(text):
    return (text or "").encode().split()


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_match_split(texts):
    arr = pa.array(texts, pa.string())
    got, at = [], 0
    for lo, hi, buf, offs in tb.row_chunks(arr, max_bytes=16):
        assert lo == at
        at = hi
        h, s, e, rw = tb.word_hashes(buf, offs, tb.NOT_SPACE)
        for i in range(hi - lo):
            got.append([buf[a:z].tobytes() for a, z in zip(s[rw[i]:rw[i + 1]], e[rw[i]:rw[i + 1]])])
    assert got == [words_of(t) for t in texts]


def test_equal_words_have_equal_hashes_anywhere():
    arr = pa.array(["alpha Beta alpha", None, "BETA  alphA gamma"])
    buf, offs = tb.string_buffer(arr)
    h, _, _, rw = tb.word_hashes(buf, offs, tb.NOT_SPACE)
    a, b, c = h[0], h[1], h[5]
    assert h.tolist() == [a, b, a, b, a, c] and len({int(a), int(b), int(c)}) == 3
    assert rw.tolist() == [0, 3, 3, 6]


def test_ngrams_stay_in_their_rows():
    words = np.arange(7).astype(np.uint64)
    _, row, at = tb.ngram_hashes(words, np.array([0, 2, 2, 7]), 3)
    assert row.tolist() == [2, 2, 2] and at.tolist() == [2, 3, 4]


def test_slices_and_code_points():
    arr = pa.array(["skip", "é漢 a", "b"]).slice(1)
    buf, offs = tb.string_buffer(arr)
    s, _, rw = tb.word_spans(buf, offs, tb.NOT_SPACE)
    row = np.repeat(np.arange(2), np.diff(rw))
    assert tb.char_index(buf, offs, s, row).tolist() == [0, 3, 0]


def test_batches_of_the_pipelines_operators_are_small(spark, documents):
    docs, set_to = documents.limit(20), lambda: int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
    for f in (lambda: quality_bt.accepted(docs, {}), lambda: decontam_sw.without_leaks(docs, docs.limit(0).withColumnRenamed("doc_id", "item_id")), lambda: pfair_mix.mix(docs, {}, 1.0)):
        prepare(spark)
        f()
        assert set_to() <= 1 << 20


def test_released_memory_loses_no_batch():
    batches = [pa.record_batch({"x": [i]}) for i in range(3)]
    assert list(releasing(iter)(iter(batches))) == batches
