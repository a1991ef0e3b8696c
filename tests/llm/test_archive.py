"""Merkle audit (4) and token blocks (7)."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from routewise.llm import pfor_blocks, warc_merkle
from routewise.llm.queries import tokenizer_path


def test_audit_finds_planted_damage(spark):
    a = spark.range(5000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page "), "id").alias("html"))
    b = a.where("page_id not in (17, 4999)").withColumn("html", F.when(F.col("page_id").isin(0, 64, 3000), None).otherwise(F.col("html")))
    b = b.unionByName(spark.createDataFrame([(7000, "u", "new"), (40, "u", "page 40")], "page_id long, url string, html string"))
    got = {(r["offset"], r["status"]) for r in warc_merkle.audit(a, b, "page_id", ["url", "html"]).collect()}
    assert got == {(17, "missing"), (4999, "missing"), (0, "altered"), (64, "altered"), (3000, "altered"), (7000, "extra"), (40, "altered")}


def test_equal_replicas_and_empty_ones(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (None, "y")], "o long, p string")
    assert warc_merkle.audit(a, a.orderBy(F.rand()), "o", ["p"]).count() == 0
    got = {(r["offset"], r["status"]) for r in warc_merkle.audit(a, a.limit(0), "o", ["p"]).collect()}
    assert got == {(None, "missing"), (1, "missing")}
    assert warc_merkle.audit(a.limit(0), a.limit(0), "o", ["p"]).count() == 0
    swapped = spark.createDataFrame([(1, "x"), (1, None), (1, None), (None, "y")], "o long, p string")
    assert warc_merkle.audit(a, swapped, "o", ["p"]).first()["status"] == "altered"
    with pytest.raises(ValueError):
        warc_merkle.audit(spark.createDataFrame([(-1, "x")], a.schema), a, "o", ["p"])


def test_descent_reads_only_mismatching_branches(spark, tmp_path):
    a = spark.range(10_000).select(F.col("id").alias("o"), F.col("id").cast("string").alias("p"))
    b = a.withColumn("p", F.when(F.col("o") == 4321, "bad").otherwise(F.col("p")))
    for name, df in (("a", a), ("b", b)):
        warc_merkle.write_tree(df, f"{tmp_path}/{name}", "o", ["p"], 3)
    # nodes of other branches may go: the audit doesn't need them
    node = 4322
    for k in range(3):
        for name in ("a", "b"):
            level = warc_merkle.read_level(spark, f"{tmp_path}/{name}", k).where(F.col("parent") == node // 64)
            level.write.parquet(f"{tmp_path}/{name}{k}")
        node //= 64
    assert [r["node"] for r in warc_merkle.mismatches(spark, f"{tmp_path}/a", f"{tmp_path}/b", 3).collect()] == [4322]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 32) - 1), max_size=1500), st.sampled_from([0.5, 0.9, 0.95, 1.0]))
def test_pack_round_trip(ids, percentile):
    x = np.array(ids, np.uint32)
    assert (pfor_blocks.unpack(pfor_blocks.pack(x, percentile)) == x).all()


def test_outliers_are_exceptions():
    x = np.full(5120, 100, np.uint32)
    x[::100] = 1 << 30
    assert len(pfor_blocks.pack(x)) < 1000 and (pfor_blocks.unpack(pfor_blocks.pack(x)) == x).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aBzé ÈßŒ×÷'’.,<|>1٣2\u0301\u0085\x1c\t漢sdtm", max_size=25), min_size=1, max_size=4))
def test_units_encode_like_the_whole(texts):
    import pyarrow as pa

    from routewise.llm import textblocks as tb

    buf, offs = tb.string_buffer(pa.array(texts, pa.string()))
    ids, ends = ENCODER.rows(buf, offs)
    got = [ids[a:z].tolist() for a, z in zip([0, *ends[:-1].tolist()], ends.tolist())]
    assert got == [[*ENCODER.tok.encode(t, add_special_tokens=False).ids, 1] for t in texts]


ENCODER = pfor_blocks.WordEncoder(tokenizer_path())
TEXTS = [None, "", "  ", "Hello, WORLD! it's 42", "café ÀÉ ﬁ x y z", "á ́b", "<|endoftext|> <|startoftext|>x", "don't we'll 's", "漢字かな 😀😀", "word " * 5000, "\u0085a\x1cb\x1dc", "İ ẞ"]


def want(texts):
    from tokenizers import Tokenizer

    tok, start, out = Tokenizer.from_file(tokenizer_path()), 0, []
    for t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_tokens_equal_the_tokenizers(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    rows = pfor_blocks.encode_documents(df, tokenizer_path()).orderBy("doc_id").collect()
    assert [(r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows] == want(TEXTS)


def test_word_encoder_on_real_texts_and_small_cache(documents, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pfor_blocks, "CACHE_UNITS", 300)
    texts = [r["text"] for r in documents.limit(60).collect()] + TEXTS
    enc, got, at = pfor_blocks.WordEncoder(tokenizer_path()), [], 0
    from routewise.llm import textblocks as tb
    for _, _, buf, offs in tb.row_chunks(pa.array(texts, pa.string()), 20_000):
        ids, ends = enc.rows(buf, offs)
        for a, z in zip([0, *ends[:-1].tolist()], ends.tolist()):
            got.append((at, z - a, zlib.crc32(ids[a:z].astype("<u4").tobytes())))
            at += z - a
    assert got == want(texts)


def test_odd_rows_tokens(odd, empty):
    rows = pfor_blocks.encode_documents(odd, tokenizer_path()).collect()
    assert len(rows) == odd.count() and sorted(r["start"] for r in rows)[0] == 0
    ends = {r["start"] + r["n_tokens"] for r in rows}
    assert {r["start"] for r in rows} - ends == {0}
    assert min(rows, key=lambda r: r["start"])["doc_id"] is None
    assert pfor_blocks.encode_documents(empty, tokenizer_path()).count() == 0


def test_other_tokenizers_get_whole_texts(spark):
    """A cased tokenizer that keeps white space: units would give wrong ids."""
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    assert isinstance(pfor_blocks.encoder(tokenizer_path()), pfor_blocks.WordEncoder)
    assert isinstance(pfor_blocks.encoder(path), pfor_blocks.TextEncoder)
    texts = ["The the THE  quick\n\nfox", None, "", "Über x1 漢字", "the The"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pfor_blocks.encode_documents(df, path).orderBy("doc_id").collect()
    tok, at = Tokenizer.from_file(path), 0
    for r, text in zip(got, texts):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
