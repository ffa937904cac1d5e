"""The pipeline's stages against brute force, each on what its predecessor kept."""

import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tidewright.llm import decontamination, mixing
from tidewright.llm.common import materialize, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF, "documents")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        out.append((name, docs))
    return dict(out)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower() if text.isascii() else text.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_columns(stages):
    for name in ("quality", "near_dedup", "decontaminate", "mix"):
        assert stages[name].dtypes == stages["documents"].dtypes


def test_quality_keeps_clean_and_drops_junk(spark, stages):
    left = {r.doc_id for r in stages["quality"].collect()}
    labels = [(r.doc_id, r.quality) for r in table(spark, SF, "labels").collect()]
    right = [(q == 1) == (i in left) for i, q in labels]
    assert sum(right) >= 0.95 * len(right)


def test_near_dedup(stages):
    before, after = ({r.doc_id: shingles(r.text) for r in stages[k].collect()} for k in ("quality", "near_dedup"))
    near = lambda a, b: bool(a | b) and 10 * len(a & b) >= 8 * len(a | b)
    assert not any(near(a, b) for a, b in itertools.combinations(after.values(), 2))
    for i in set(before) - set(after):
        assert any(near(before[i], s) for j, s in before.items() if j != i)


def test_decontaminate(spark, stages):
    before, after = ({r.doc_id: r.text for r in stages[k].collect()} for k in ("near_dedup", "decontaminate"))
    items = [decontamination.words_of(r.text) for r in table(spark, SF, "benchmark").collect()]
    whole = lambda t: any(" " + " ".join(w) + " " in " " + " ".join(decontamination.words_of(t)) + " " for w in items)
    assert not any(whole(t) for t in after.values())
    assert all(i in after for i, t in before.items() if not any(set(decontamination.shingles(w)) & set(decontamination.shingles(decontamination.words_of(t))) for w in items))


def test_mix(stages):
    before, after = ({r.doc_id: len((r.text or "").split()) for r in stages[k].collect()} for k in ("decontaminate", "mix"))
    assert set(after) <= set(before) and all(n <= before[i] for i, n in after.items())
    assert sum(after.values()) == round(0.9 * sum(before.values()))


def test_tokens(stages):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for r in sorted(stages["mix"].collect(), key=lambda r: r.doc_id):
        ids = [*t.encode(r.text, add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in stages["tokens"].orderBy("start").collect()] == want


def test_run_is_the_stages(spark, stages):
    assert sorted(map(tuple, entry.queries()["pipeline"](spark, SF).collect())) == sorted(map(tuple, stages["tokens"].collect()))


def test_odd_rows(spark):
    """Nulls, repeated ids, ties, a very long text and columns named as those used inside go through every stage."""
    base = [r.asDict() for r in table(spark, SF, "documents").limit(40).collect()]
    good = max(base, key=lambda r: len(r["text"] or ""))
    item = table(spark, SF, "benchmark").first().text
    more = [{**good, "doc_id": i, "text": t} for i, t in ((9001, None), (9002, ""), (None, good["text"]), (9003, good["text"]), (9003, "other words " * 40), (9004, good["text"] * 30), (9005, good["text"] + " " + item), (None, None))]
    kind = table(spark, SF, "documents").schema
    extra = {"score": -5.0, "gone": 1, "gone_": 2, "leak_": 3, "kept": 4, "slice": 5, "whole": 6, "docs": 7, "block": 8}
    names = ", ".join(f"{k} {'double' if k == 'score' else 'int'}" for k in extra)
    rows = [(*[r[c] for c in kind.names], *extra.values()) for r in base + more]
    docs = spark.createDataFrame(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind.fields) + ", " + names)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF), name)
        seen[name] = docs
        if name != "tokens":
            assert docs.dtypes == before.dtypes and all(tuple(r)[len(kind.names) :] == tuple(extra.values()) for r in docs.collect())
    assert 9005 not in {r.doc_id for r in seen["decontaminate"].collect()}
    ids = [r.doc_id for r in seen["near_dedup"].collect()]
    assert good["doc_id"] in ids and 9003 not in ids or good["doc_id"] not in {r.doc_id for r in seen["quality"].collect()}
    assert all(r.text for r in seen["mix"].collect()) and seen["tokens"].count() == seen["mix"].count()


def test_empty(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
    assert mixing.MOST_LEAVES > 0
