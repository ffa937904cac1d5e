import zlib
from functools import cache

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewright.llm import token_store as ts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab .,'s\n\t é1<|>endoftx日🙂")), max_size=60))
def test_encoder_equals_library(text):
    t = Tokenizer.from_file(PATH) if not hasattr(test_encoder_equals_library, "t") else test_encoder_equals_library.t
    t.encode_special_tokens = True
    test_encoder_equals_library.t = t
    assert ts.encoder(PATH, public_tokenizers.PATTERN)(text, 2).tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("ab .,'\n\té1日🙂")), max_size=20)), max_size=8), st.integers(0, 2))
def test_batch_equals_single(texts, skip):
    import pyarrow as pa

    e = ts.encoder(PATH, public_tokenizers.PATTERN)
    got = e.batch(pa.array(texts, pa.string()).slice(skip), 2)
    assert [x.tolist() for x in got] == [e(t, 2).tolist() for t in texts[skip:]]


@given(st.lists(st.binary(max_size=40), max_size=6))
def test_crc_concat(parts):
    assert ts.crc_concat([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_cut_depends_on_content_alone():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50_000, 20_000), rng.integers(0, 50_000, 777)
    x = {tuple(a[s:e]) for s, e in zip([0, *ts.cut(a)], ts.cut(a), strict=False)}
    both = np.concatenate([b, a])
    y = {tuple(both[s:e]) for s, e in zip([0, *ts.cut(both)], ts.cut(both), strict=False)}
    assert len(x & y) > 0.8 * len(x)
    assert all(len(c) <= ts.MOST for c in x)


def brute(rows, t):
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_store_equals_brute_force(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = ts.store_and_verify(docs).orderBy("start").collect()
    assert [tuple(r)[:4] for r in got] == brute(rows, plain)


def test_edges(spark, plain):
    rows = [(5, "a b  c\n"), (1, None), (3, ""), (None, "x"), (5, "a b  c\n"), (9, "word " * 30_000)]
    docs = spark.createDataFrame([(i, t, 7, "y") for i, t in rows], "doc_id long, text string, digest int, part string")
    path = ts.scratch_path(spark, "edge")
    got = ts.store_and_verify(docs, path=path).orderBy("start").collect()
    assert [tuple(r)[:4] for r in got] == brute(rows, plain)
    whole = ts.read_documents(spark, path).orderBy("start").collect()
    assert [zlib.crc32(bytes(r.ids)) for r in whole] == [r.ids_crc32 for r in got]
    assert spark.read.parquet(f"{path}/chunks").count() < sum(len(r.digests) for r in spark.read.parquet(f"{path}/recipes").collect())
    assert ts.store_and_verify(docs.limit(0)).count() == 0


@cache
def _library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("ab <|>endoftx\n")), max_size=12), st.just("a <|endoftext|> b"), st.just("<|endoftext|><|endoftext|>")), max_size=6))
def test_special_strings_as_their_ids(texts):
    import pyarrow as pa

    library = _library()
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    e = ts.encoder(PATH, public_tokenizers.PATTERN, special=True)
    assert [e(t, 2).tolist() for t in texts] == want
    assert [x.tolist() for x in e.batch(pa.array(texts, pa.string()), 2)] == want


def test_no_end_id(spark, plain):
    """Documents without ids have a recipe without chunks, and come back."""
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "c")], "doc_id long, text string")
    path = ts.scratch_path(spark, "no_end")
    got = ts.store_and_verify(docs, path=path, end_id=None).orderBy("doc_id").collect()
    n = [len(plain.encode(t).ids) for t in ("a b", "c")]
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(1, 0, n[0]), (2, n[0], 0), (3, n[0], 0), (4, n[0], n[1])]
    assert [bytes(r.ids) == b"" for r in ts.read_documents(spark, path).orderBy("doc_id").collect()] == [False, True, True, False]


def test_manifest_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(ts, "WIDTH_BITS", 2)
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(70)], "doc_id long, text string")
    path = ts.scratch_path(spark, "levels")
    got = ts.store_and_verify(docs, path=path).collect()
    levels = {r["level"]: r["count"] for r in spark.read.parquet(f"{path}/manifest").groupBy("level").count().collect()}
    assert levels == {0: 18, 1: 5, 2: 2, 3: 1}
    assert ts.verify_manifest(spark, path) == (70, sum(r.n_tokens for r in got))


@pytest.fixture(scope="module")
def stored(spark):
    docs = spark.createDataFrame([(1, "some text here"), (2, "more of it")], "doc_id long, text string")
    path = ts.scratch_path(spark, "damage")
    ts.store_and_verify(docs, path=path).collect()
    return path


@pytest.mark.parametrize("what", ["chunk", "recipe lost", "recipe twice", "recipe changed", "manifest lost", "manifest changed"])
def test_damage_is_found(spark, stored, what):
    path, other = stored, ts.scratch_path(spark, "damaged")
    chunks, recipes, manifest = (spark.read.parquet(f"{path}/{k}") for k in ("chunks", "recipes", "manifest"))
    if what == "chunk":
        chunks = chunks.withColumn("ids", F.lit(b"\x01\x00"))
    elif what == "recipe lost":
        recipes = recipes.where("doc_id = 1")
    elif what == "recipe twice":
        recipes = recipes.union(recipes.where("doc_id = 1"))
    elif what == "recipe changed":
        recipes = recipes.withColumn("n_tokens", F.col("n_tokens") + 1)
    elif what == "manifest lost":
        manifest = manifest.limit(0)
    else:
        manifest = manifest.withColumn("root", F.reverse("root"))
    for k, df in (("chunks", chunks), ("recipes", recipes), ("manifest", manifest)):
        df.write.parquet(f"{other}/{k}")
    with pytest.raises(Exception, match="content that it is stored under" if what == "chunk" else "manifest"):
        ts.read_checksums(spark, other).collect()
