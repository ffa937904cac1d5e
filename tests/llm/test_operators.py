"""The operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import textwrap
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright.llm import chat_format, decontamination, embedding_dedup, html_extraction, license_scan, minhash_dedup, mixing, quality_mil, substring_dedup
from tidewright.llm.components import components

SF = "/root/testdata/sf0.001"
#: Columns with names that the operators use inside.
EXTRA = "u int, v int, id int, part string, key string, block int, bucket int, family int, rep int, hashes int, score double, label_ int, kept_ int, gone int, gone_ int, leak_ int, cid int, n int"


def documents(spark, rows):
    extra = (1, 2, 3, "p", "k", 4, 5, 6, 7, 8, 0.5, 9, 10, 11, 12, 13, 14, 15)
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, {EXTRA}")


def prose(n, seed=0, words=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def edited(text, every, seed):
    rng = random.Random(seed)
    return " ".join(f"e{rng.randrange(9999)}" if rng.random() < 1 / every else w for w in text.split())


@pytest.fixture(scope="module")
def corpus():
    base, other = prose(300, 1), prose(200, 2)
    rows = [(10, base), (11, base), (12, edited(base, 100, 3)), (13, edited(base, 60, 4)), (14, edited(edited(base, 100, 3), 100, 5)), (15, other), (16, edited(other, 80, 6)), (17, None), (18, ""), (19, " \n\t "), (20, "one two"), (21, "One\ttwo"), (22, "one"), (23, prose(20_000, 7, 50_000)), (24, prose(20_000, 7, 50_000)), (25, base + " " + other), (26, prose(30, 9)), (27, prose(30, 9) + " tail"), (10, base), (None, base), (None, None), (30, prose(80, 71)), (30, prose(80, 72)), (31, edited(prose(80, 72), 90, 8)), (32, prose(80, 71)), (33, prose(80, 73))]
    return rows + [(100 + k, edited(prose(60, 50), 40, k)) for k in range(30)]


def groups(n, linked):
    root = list(range(n))
    for i, j in itertools.combinations(range(n), 2):
        if linked(i, j):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, corpus, k, percent):
    sets = []
    for i, text in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}) if text else "")
        sets.append({tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set())
    live = [i is not None and bool(s) for (i, _), s in zip(corpus, sets, strict=True)]
    root = groups(len(corpus), lambda i, j: live[i] and live[j] and corpus[i][0] == corpus[j][0] or live[i] and live[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]))
    least = {r: min(corpus[i][0] for i in range(len(corpus)) if root[i] == r and corpus[i][0] is not None) for r in set(root) if any(root[i] == r and corpus[i][0] is not None for i in range(len(corpus)))}
    want = sorted([(i, len(s), least.get(r)) if live[x] else (i, len(s), i) for x, ((i, _), s, r) in enumerate(zip(corpus, sets, root, strict=True))], key=repr)
    got = minhash_dedup.near_duplicates(documents(spark, corpus), k, percent).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    for size in (60,) if k == 3 else (500,):  # families in parts
        small = minhash_dedup.near_duplicates(documents(spark, corpus), k, percent, family=size).collect()
        assert sorted(map(tuple, small), key=repr) == sorted(map(tuple, got), key=repr)
    docs = documents(spark, corpus)
    left = minhash_dedup.keep_one(docs, k, percent)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in got if r.kept or r.doc_id is None}
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_signatures_keep_the_promise():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, minhash_dedup.POSITIONS)
    for _ in range(200):
        b = a.copy()
        at = rng.choice(len(a), minhash_dedup.RADIUS, replace=False)
        b[at] = (b[at] + 1 + rng.integers(0, 1000, len(at))) % (1 << 16)
        x, y = minhash_dedup.keys(np.stack([a, b]).astype(np.uint64))
        assert set(x.tolist()) & set(y.tolist())


def brute_repeats(rows, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least: dict = {}
    for (i, _), w in zip(rows, words, strict=True):
        for p in range(len(w) - length + 1):
            if i is not None:
                x = tuple(w[p : p + length])
                least[x] = min(least.get(x, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for p in range(len(w) - length + 1):
            if i is not None and least[tuple(w[p : p + length])] < i:
                gone.update(range(p, p + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length, chars", [(13, 4_000_000), (13, 3000), (4, 3000), (1, 3000)])
def test_substring(spark, corpus, monkeypatch, length, chars):
    monkeypatch.setattr(substring_dedup, "BLOCK_CHARS", chars)
    got = substring_dedup.remove_repeats(documents(spark, corpus), length)
    assert sorted([tuple(r)[:4] for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()], key=repr) == brute_repeats(corpus, length)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got.collect())


def test_substring_levels():
    assert [substring_dedup.levels(n) for n in (1, 2, 5, 13, 50)] == [[1, 1], [1, 2], [3, 5], [4, 8, 13], [4, 8, 16, 32, 50]]


def test_substring_fingerprints_decide():
    """Windows that only share their 64-bit hash are told apart: here every hash of a window is the same in its first half."""
    rows = [(k, prose(40, k, 10_000)) for k in range(6)] + [(9, prose(40, 2, 10_000))]
    whole = substring_dedup.window_hashes

    def run(texts, ids):
        table = pa.table({"block": pa.array([0] * len(ids), pa.int32()), "doc_id": ids, "text": texts})
        block = substring_dedup.Block(table, 13)
        block.h[:] = 1
        known = np.empty(28, substring_dedup._KNOWN)
        starts = block.long_windows()
        of = starts[block.owner[starts] == 2]
        known["h"], known["g"], known["low"] = whole(block.h, 13)[of], whole(block.g, 13)[of], 2
        return substring_dedup.covered(block, known), block

    gone, block = run([t for _, t in rows], [i for i, _ in rows])
    assert [bool(gone[block.at[k] : block.at[k + 1]].any()) for k in range(7)] == [False] * 6 + [True]


def test_substring_sends_no_row_for_nothing():
    """Rows that a block sends are as many as the buckets it has windows for, however many there are."""
    entries = np.zeros(3, substring_dedup._SHORT)
    entries["h"] = [1 << 20, 1 << 62, (1 << 63) + 5]
    assert substring_dedup._rows(0, entries, 1_000_000_000).num_rows == 3
    assert substring_dedup._rows(0, entries, 1).num_rows == 1


def test_substring_empty(spark, corpus):
    assert substring_dedup.remove_repeats(documents(spark, corpus).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(0, 400) if k % 50] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(5, 5), (None, 3), (7, None)]
    want = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            ra, rb = want.get(a, a), want.get(b, b)
            want.setdefault(a, a), want.setdefault(b, b)
            low = min(ra, rb)
            want = {n: low if r in (ra, rb) else r for n, r in want.items()}
    got = components(spark.createDataFrame(links, "src long, dst long").repartition(7)).collect()
    assert dict(map(tuple, got)) == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((60, 16))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 20] + 0.12 * rng.standard_normal(16)).tolist(), (i % 20) % 3) for i in range(80)]
    rows += [(300, base[0].tolist(), 0), (301, base[0].tolist(), 1), (302, None, 0), (303, [0.0] * 16, 0), (304, [float("nan")] * 16, 0), (305, [None] + [1.0] * 15, 0), (306, base[0].tolist(), None), (307, [1.0, 2.0], 0), (308, [], 0), (None, base[0].tolist(), 0), (0, base[0].tolist(), 0), (309, (2 * base[0]).tolist(), 0)]
    return rows


@pytest.mark.parametrize("group, leaf", [(4096, 192), (16, 8)])
def test_embeddings(spark, monkeypatch, group, leaf):
    monkeypatch.setattr(embedding_dedup, "GROUP", group)
    monkeypatch.setattr(embedding_dedup, "LEAF", leaf)
    rows = vectors()
    units = [embedding_dedup.unit(v) if i is not None and k is not None else None for i, v, k in rows]

    def linked(i, j):
        a, b = units[i], units[j]
        return a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2] and a @ b >= 0.98

    root = groups(len(rows), linked)
    want = []
    for x, (i, _, _) in enumerate(rows):
        n = sum(linked(x, y) for y in range(len(rows)) if y != x)
        want.append((i, n, min(rows[y][0] for y in range(len(rows)) if root[y] == root[x]) if units[x] is not None else i))
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, label int, rep int, weight int, component int")
    got = embedding_dedup.near_vectors(df).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=repr) == sorted(want, key=repr)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_embedding_recall(spark):
    """All links of a table with planted neighbours at cosines about the threshold, against brute force."""
    own = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    rng = np.random.default_rng(6)
    more = []
    for k, r in enumerate(own[:1500]):
        v = np.array(r.embedding, float)
        n = rng.standard_normal(len(v))
        more.append((100_000 + k, (v / np.linalg.norm(v) + rng.uniform(0.05, 0.25) * n / np.linalg.norm(n)).tolist(), r.label))
    df = spark.createDataFrame([(r.vec_id, list(r.embedding), r.label) for r in own] + more, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(df).collect()}
    rows = df.collect()
    u = np.array([embedding_dedup.unit(list(r.embedding)) for r in rows])
    label = np.array([r.label for r in rows])
    want = ((u @ u.T >= 0.98) & (label[:, None] == label)).sum(axis=1) - 1
    assert sum(got.values()) >= 0.99 * want.sum() > 0
    assert all(got[r.vec_id] <= w for r, w in zip(rows, want.tolist(), strict=True))


TEXTS = ["hi", "</s>[INST] ok [/INST]", "<s>", "<\\s> and <\\\\s>", "[ROLE]x[/ROLE]", "<|endoftext|>", "a<", "[", "", None, " lead and trail ", "日本 🙂\n", "é" * 50, "x" * 40_000]


def test_chat(spark):
    rows = [(c, t, role, TEXTS[(c * 5 + t) % len(TEXTS)]) for c in range(12) for t, role in enumerate(["system", "user", "assistant", "user", "assistant"])] + [(50, 0, None, "no role"), (50, 1, "assistant", "x"), (50, 1, "assistant", "x"), (None, 0, "assistant", "lost"), (51, None, "user", "first"), (51, 1, "assistant", "<s>[ROLE]")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, known int")
    formatted = chat_format.format_conversations(df)
    got = {r.conv_id: r for r in chat_format.digests(formatted).collect()}
    back = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted([r[1:] for r in rows if r[0] == c], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        own = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in turns)
        loss = "".join(text or "" for _, role, text in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), hashlib.sha256(own.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert list(back[c].loss_texts) == [t for _, role, t in turns if role == "assistant" and t]
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_escape_round_trip():
    for parts in itertools.product(["<", "[", "\\", "s>", "/s>", "ROLE]", "/INST]", "|endoftext|>", "a"], repeat=4):
        t = "".join(parts)
        e = chat_format.escape(t)
        assert chat_format.unescape(e) == t and not any(c in e for c in chat_format.CONTROLS)


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality_mil.fit(docs, labels)
    scored = quality_mil.score(docs.select("doc_id", "text"), model).withColumn("held", quality_mil.held_out())
    r = scored.join(labels, "doc_id").where("held").agg(F.avg(((F.col("score") >= 0.7).cast("int") == F.col("quality")).cast("int")), F.count("*")).first()
    assert r[0] > 0.97 and r[1] > 500
    odd = documents(spark, [(1, None), (1, ""), (None, " \n"), (2, "word " * 50_000), (3, "日本")])
    got = quality_mil.score(odd, model)
    assert got.columns[-1] == "score" and got.count() == 5 and all(0 <= x.score <= 1 for x in got.collect())
    assert quality_mil.score(odd.limit(0), model).count() == 0
    assert [x.score for x in quality_mil.score(odd, quality_mil.fit(odd, labels.limit(0))).collect()] == [1.0] * 5


def test_quality_gradient():
    rng = np.random.default_rng(0)
    m = quality_mil.Model(rng)
    x, owner, y = rng.standard_normal((9, quality_mil.FEATURES)), np.array([0, 0, 0, 1, 2, 2, 3, 3, 3]), np.array([0.0, 1, 1, 0])
    w = np.ones(4)
    g = m.gradient(m.forward(x, owner, 4), owner, y, w)

    def loss():
        p = m.forward(x, owner, 4)["y"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for k, v in m.weights.items():
        at = tuple(rng.integers(n) for n in v.shape)
        old = v[at]
        v[at] = old + 1e-6
        up = loss()
        v[at] = old - 1e-6
        down = loss()
        v[at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-6, abs=1e-6), k


def test_decontamination(spark):
    items = [(1, prose(40, 21) + ". " + prose(12, 22)), (2, prose(18, 23)), (3, "short one"), (4, None), (5, "")] + [(10 + k, prose(35, 200 + k)) for k in range(30)]
    clean = [(k, prose(300, 300 + k)) for k in range(20)]
    leaks = [(100, prose(200, 31) + " " + items[0][1] + " " + prose(90, 32)), (101, items[1][1].upper() + "."), (102, prose(31, 33) + " " + items[7][1]), (103, "a b\nshort one c"), (102, prose(31, 33) + " " + items[7][1])]
    docs = documents(spark, clean + leaks + [(200, None), (201, ""), (202, " ".join(items[0][1].split()[:15])), (None, items[1][1])])
    items_df = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    got = sorted([(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items_df).collect()], key=repr)
    assert got == sorted([(100, 1), (101, 2), (102, items[7][0]), (102, items[7][0]), (103, 3), (None, 2)], key=repr)
    left = decontamination.without_leaks(docs, items_df)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {k for k, _ in clean} | {200, 201, 202}
    assert decontamination.contaminated(docs.limit(0), items_df).count() == 0
    assert decontamination.contaminated(docs, items_df.limit(0)).count() == 0


def exhaustive(ix, terms):
    """The score of every entry of an index against distinct words, without cursors or bounds."""
    scores: dict = {}
    for x in {ix.vocabulary[t] for t in terms if t in ix.vocabulary}:
        for e, v in zip(*ix.postings[x], strict=True):
            scores[e] = scores.get(e, 0) + v
    return scores


def odd_words(rng, n):
    return [f"w{min(int(rng.expovariate(0.05)), 300)}" for _ in range(n)]


@pytest.mark.parametrize("threshold, block", [(0.45, 4), (0.45, 1), (0.6, 50), (0.05, 4)])
def test_wand_finds_all_above_threshold(monkeypatch, threshold, block):
    monkeypatch.setattr(decontamination, "LEAST_BLOCK", block)
    rng = random.Random(8)
    ix = decontamination.Index([(k, " ".join(odd_words(rng, rng.randrange(5, 90)))) for k in range(120)])
    for _ in range(60):
        terms = set(odd_words(rng, 60))
        got = dict(ix.search(np.array(sorted(ix.vocabulary[t] for t in terms if t in ix.vocabulary)), threshold))
        want = {e: v for e, v in exhaustive(ix, terms).items() if v >= threshold - 1e-9}
        assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-12 for e in got)


def test_find_against_exhaustive_search():
    """find, end to end: every passage of every text scored against every entry by brute force, then verified."""
    rng = random.Random(9)
    items = [(k, " ".join(odd_words(rng, n)) + "? " + " ".join(odd_words(rng, 6))) for k, n in enumerate([8, 15, 30, 60, 120, 250] * 6)]
    ix = decontamination.Index(items)
    texts = [" ".join(odd_words(rng, rng.randrange(0, 200)) + items[k][1].split() + odd_words(rng, rng.randrange(0, 200))) for k in range(len(items))]
    texts += [" ".join(odd_words(rng, 300)) for _ in range(40)] + [" ".join(x for x in items[k][1].split() if rng.random() > 0.04) for k in range(len(items))]
    want = {}
    for r, text in enumerate(texts):
        words = decontamination.words_of(text)
        halves = [words[a : a + decontamination.HALF] for a in range(0, max(1, len(words)), decontamination.HALF)]
        for h in range(max(1, len(halves) - 1)):
            there, start = set(sum(halves[h : h + 2], [])), h * decontamination.HALF
            for d in {ix.items[e] for e, v in exhaustive(ix, there).items() if v >= decontamination.THRESHOLD - 1e-9}:
                more = len(ix.words[d])
                shares = ix.verify(d, words[max(0, start - more) : start + decontamination.PASSAGE + more])
                if shares[0] >= decontamination.SHARE and min(shares[1:]) >= decontamination.PART:
                    score = sum(v for w, v in ((w, ix.impacts[d].get(ix.vocabulary.get(w), 0)) for w in there))
                    want[r, d] = max(want.get((r, d), 0), score)
    got = {(r, d): score for r, d, score, *_ in decontamination.find(ix, pa.array(texts))}
    assert got.keys() == want.keys() and len(got) > len(items) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


@pytest.mark.parametrize("length", [20, 33, 64, 100, 150, 500, 2000])
def test_long_items_at_all_alignments(length):
    """A verbatim copy is found wherever it lies; half of it is not a leak."""
    words = lambda n, seed: " ".join(f"q{random.Random(seed * 7919 + k).randrange(400)}" for k in range(n))
    items = [(k, words(length if k < 3 else 20, k)) for k in range(40)]
    ix = decontamination.Index(items)
    texts = [f"{words(shift, 500)} {items[1][1]} {words(45, 600)}" for shift in range(64)]
    half = [f"{words(shift, 500)} {' '.join(items[1][1].split()[: length // 2])} {words(45, 600)}" for shift in range(0, 64, 9)]
    found = list(decontamination.find(ix, pa.array(texts + half)))
    assert [(r, ix.ids[d]) for r, d, *_ in found] == [(r, 1) for r in range(64)]
    assert all(shares == [1, 1, 1] for _, _, _, *shares in found)


PAGE = "<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav>{main}<footer>&copy; foot</footer></body></html>"


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain  text\n here", "plain text here"),
    (PAGE.format(main="<article><h1>Head &amp; line</h1><p>One <b>bold<i>!</i></b> word<p>Two&nbsp; spaces<br>next<ul><li>a<li>b</ul></article>"), "Head & line\nOne bold! word\nTwo spaces next\na\nb"),
    (PAGE.format(main="<article><p>Kept</p><div class='comments'><p>said</p></div><form>f<input></form><aside>s</aside><div class=\"ad-box\">buy</div><script>x='<p>no</p>'</script><p>too &lt;p&gt;</p></article>"), "Kept\ntoo <p>"),
    (PAGE.format(main="<main><p>m1</p></main><div id=sidebar>x</div>"), "m1"),
    ("<article><p>cut off he", "cut off he"), ("<article><p>a</p><!-- <p>no</p> --><p>b<", "a\nb<"),
    ("<article><p>a<p cla", "a"), ("<body><div class=cookie-notice>accept</div><p>body only</p></body>", "body only"),
    ("<article><p>a" + " b" * 30_000 + "</p></article>", "a" + " b" * 30_000),
])
def test_extract(page, text):
    assert html_extraction.extract(page) == text


def test_wrapper(spark):
    shared = "<div class=top><p>Welcome to the site of things</p></div>"
    page = lambda k: f"<html><body>{shared}<div class=content><p>{prose(40, k)}</p><p>{prose(30, 90 + k)}</p></div><div class=links><a href=1>{prose(5, k)}</a><a href=2>{prose(5, k + 1)}</a></div></body></html>"
    w = html_extraction.induce([page(k) for k in range(5)])
    assert w["slot"] == next(n.path for n in html_extraction.nodes(html_extraction.parse(page(0))) if n.key == "div.content")
    assert html_extraction.extract(page(7), w) == f"{prose(40, 7)}\n{prose(30, 97)}"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(9)] + [(20, None, None), (21, "odd", ""), (None, "http://a.example/x", page(3)), (3, "http://a.example/3", page(3))]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, wrapper int")
    got = html_extraction.main_texts(df).collect()
    assert sorted([(r.page_id, r.text) for r in got], key=repr) == sorted([(i, f"{prose(40, 3 if i is None else i)}\n{prose(30, 93 if i is None else 90 + i)}" if h else "") for i, _, h in rows], key=repr)
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extraction.main_texts(df.limit(0)).count() == 0


def test_content_by_slots_before_tags():
    """All varying articles are text, and a varying div is where the article is but a teaser."""
    many = lambda k: f"<body><h2>Site</h2><main><article><p>{prose(40, k)}</p></article><article><p>{prose(30, 50 + k)}</p></article></main></body>"
    w = html_extraction.induce([many(k) for k in range(5)])
    assert html_extraction.extract(many(9), w) == f"{prose(40, 9)}\n{prose(30, 59)}"
    card = lambda k: f"<body><div class=story><p>{prose(60, k)}</p></div><article><a href=x>{prose(9, 50 + k)}</a><p>{prose(4, 80 + k)}</p></article></body>"
    w = html_extraction.induce([card(k) for k in range(5)])
    assert html_extraction.extract(card(9), w) == prose(60, 9)


def test_wrapper_of_each_layout(spark):
    """Three layouts of one host, 10 to 1; content behind 500 nodes and 90 siblings."""
    menu = "".join(f"<div class=m><a href={k}>item {k}</a></div>" for k in range(90)) + "<span>x</span>" * 400
    page = lambda k: f"<body>{menu}<div class={'abc'[min(k // 20, 2)]}><p>{prose(40, k)}</p></div><div class=more{min(k // 20, 2)}><a href=x>{prose(5, k + 1)}</a></div></body>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(44)]
    got = html_extraction.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {k: prose(40, k) for k in range(44)}


def test_matching_of_whole_trees(monkeypatch):
    """As the plain recursion finds, also in halves; deep and long pages are read to their end."""

    def brute(a, b):
        if a.key != b.key:
            return 0
        xs, ys = ([c for c in n.children if isinstance(c, html_extraction.Node)] for n in (a, b))
        size = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, x in enumerate(xs, 1):
            for j, y in enumerate(ys, 1):
                size[i][j] = max(size[i - 1][j], size[i][j - 1], size[i - 1][j - 1] + brute(x, y))
        return size[-1][-1] + 1

    rng = random.Random(4)
    tree = lambda d: "".join(f"<{t}>{tree(d - 1) if d else ''}</{t}>" for t in rng.choices(["div", "b", "section"], k=rng.randrange(6)))
    for k in range(60):
        monkeypatch.setattr(html_extraction, "MOST_CELLS", (1, 1 << 20)[k % 2])
        a, b = html_extraction.parse(tree(3)), html_extraction.parse(tree(3))
        n, pairs = html_extraction.match(a, b)
        assert n == len(pairs) == brute(a, b) and all(x.key == y.key for x, y in pairs)
    long = [html_extraction.parse("<body>" + "".join(f"<div class={'xy'[(k * s) % 3 == 0]}>t</div>" for k in range(600)) + "<p>end") for s in (1, 2)]
    assert html_extraction.match(*long)[1][-1][0].tag in ("p", "div") and html_extraction.match(*long)[0] > 400
    deep = [html_extraction.parse("<div>" * 3000 + m) for m in ("<p>a", "<b>a")]
    assert html_extraction.match(*deep)[0] == 3001


def test_hostile_pages():
    """Deep nesting, quotes that are never closed, closing tags of nothing: read in time in proportion to the page."""
    began = time.process_time()
    assert html_extraction.extract("<div>" * 50_000 + "<p>deep") == "deep"
    assert html_extraction.extract("<p>a" + "</b>" * 50_000 + "<i>" * 50_000 + "</p><p>b") == "a\nb"
    assert html_extraction.extract("<p>x " + "<a " * 300_000 + '"') == "x"
    assert html_extraction.extract("<p>x " + '<a href="' * 100_001 + "y") == "x"
    assert html_extraction.extract("<p>x <a title=it's href='1'>l</a><b title=\"never closed>y</b>") == "x ly"
    assert html_extraction.extract("<p>x" + "<!--" * 250_000) == "x"
    deep = ["<div>" * 20_000 + f"<p>{k} {prose(9, k)}" for k in range(4)]
    assert html_extraction.extract(deep[0], html_extraction.induce(deep)) == f"0 {prose(9, 0)}"
    assert html_extraction.layout("<div>" * 50_000) != html_extraction.layout("<div>" * 49_999)
    assert time.process_time() - began < 60


def test_neutral_pages():
    """Pages whose tags and classes say nothing: the wrapper alone tells the text from menus, notices and link lists."""
    menu = "<div class=k1><span>" + "</span><span>".join(f"entry {k} of the list" for k in range(9)) + "</span></div>"
    page = lambda k: f"<div class=k0><div class=k2>The house rules, valid for all who read here.</div>{menu}<div class=k3><p>{prose(60, k)}</p><div class=k5><p>Read on below.</p></div><p>{prose(20, 70 + k)}</p></div><div class=k4>All rights are with the house.</div></div>"
    w = html_extraction.induce([page(k) for k in range(6)])
    text = f"{prose(60, 9)}\n{prose(20, 79)}"
    assert html_extraction.extract(page(9), w) == text
    assert html_extraction.extract(page(9)) != text and "house rules" in html_extraction.extract(page(9))


def test_pages_of_the_tables(spark):
    """All pages of sf0.01: the article's blocks, read by a plain reader; and with its tags and classes made neutral, by the wrapper alone."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")

    def plain(page):
        body = re.search(r"<article>([\s\S]*?)</article>", page)[1]
        body = re.sub(r'<div class="[^"]*comment[^"]*">[\s\S]*?</div>|<(aside|form|script|style|nav)\b[\s\S]*?</\1>|<!--[\s\S]*?-->', "", body)
        blocks = re.split(r"</?(?:p|h\d|div|ul|ol|li|table|tr|td|th|blockquote|pre|section)\b[^>]*>", re.sub(r"<br */?>", " ", body))
        return [t for b in blocks if (t := " ".join(html_extraction.entities.unescape(re.sub(r"<[^>]*>", "", b)).split()))]

    got = {r.page_id: r.text.split("\n") for r in html_extraction.main_texts(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows) and all(got[r.page_id] == plain(r.html) for r in rows)


def test_tree_matching():
    a, b = (html_extraction.parse(f"<body><div><p>x</p>{m}<p>y</p></div></body>") for m in ("", "<ul><li>z</ul>"))
    assert html_extraction.match(a, b)[0] == 5


def test_licenses(spark):
    rows = [(1, "prose\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache License, Version 2.0."), (3, None), (4, ""), (5, "He had a license to fish and the right to remain silent."), (None, "Licensed under CC BY-NC 4.0."), (2, "Licensed under the Apache License, Version 2.0."), (6, "This work is licensed under the GNU General Public License, version 3. " + "word " * 3), (7, prose(5000))]
    docs = documents(spark, rows)
    got = sorted([(r.doc_id, r.paragraph, r.family) for r in license_scan.find_licenses(docs).collect()], key=repr)
    assert got == sorted([(1, 1, "MIT"), (2, 0, "Apache-2.0"), (2, 0, "Apache-2.0"), (6, 0, "GPL"), (None, 0, "CC-BY-NC")], key=repr)
    assert license_scan.find_licenses(docs.limit(0)).count() == 0


def test_wrapped_licenses():
    """Every template, hard-wrapped and behind comment marks, is found once at its first line; blank lines part runs."""
    m = license_scan.Classifier([prose(12, k) for k in range(300)])
    texts = {f: max(ts, key=len) for f, ts in license_scan.TEMPLATES.items()}
    for mark, width in itertools.product(("", " * ", "// ", "# ", "dnl ", "REM "), (30, 50, 72)):
        for family, text in texts.items():
            lines = textwrap.wrap(text, width, initial_indent=mark, subsequent_indent=mark)
            page = [prose(9, 1), prose(9, 2), *lines, prose(9, 3), mark.strip(), prose(9, 4)]
            got = list(license_scan.classify(m, pa.array(["x", "\n".join(page)])))
            assert [(r, f) for r, _, f, *_ in got] == [(1, family)], (mark, width, family, got)
            _, at, _, _, share, statement = got[0]
            assert share >= license_scan.MATCH and statement in "\n".join(page) and 2 <= at < 2 + len(lines)
            if len(license_scan.tokens(text)) > 14:
                assert (at, statement) == (2, "\n".join(lines)), (mark, width, family, got)
    gpl = textwrap.wrap(texts["GPL"], 40)
    assert not list(license_scan.classify(m, pa.array(["\n\n".join(gpl)])))
    two = "\n".join([*gpl, "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."])
    assert [(p, f) for _, p, f, *_ in license_scan.classify(m, pa.array([two]))] == [(0, "GPL"), (len(gpl), "MIT"), (len(gpl) + 1, "Apache-2.0")]


def test_all_paragraphs_are_classified():
    """All at once, as one by one; and what classify finds on lines of their own against every line tried by brute force."""
    m = license_scan.Classifier([prose(12, k) for k in range(300)])
    rng = random.Random(12)
    stated = [t for ts in license_scan.TEMPLATES.values() for t in ts]
    lines = [prose(rng.randrange(1, 30), k) for k in range(150)] + [edited(rng.choice(stated), rng.randrange(2, 20), k) for k in range(300)]
    lines += [prose(6, k) + " " + rng.choice(stated) + " " + prose(6, 900 + k) for k in range(40)] + ["", " ", "v2.0-rc1/x", "(GPL/LGPL)", "é.ü", "MIT", "public domain", rng.choice(stated) * 20]
    rng.shuffle(lines)
    chance = m.chances(license_scan.Words(pa.array(lines)))[0]
    for line, p in zip(lines, chance, strict=True):
        family, probability = m.predict(line)
        assert family == "unknown" and (p.argmax() == 0 or p.max() < m.least) or license_scan.FAMILIES[p.argmax()] == family and abs(p.max() - probability) < 1e-9
    want = [(k, *m.predict(t)) for k, t in enumerate(lines) if m.predict(t)[0] != "unknown" and m.match(m.predict(t)[0], t) >= license_scan.MATCH]
    got = [(r, f, p) for r, _, f, p, *_ in license_scan.classify(m, pa.array(lines))]
    assert [x[:2] for x in got] == [(i, f) for i, f, _ in want]
    together = "\n\n".join(x for x in lines if x)  # in one text, behind blank lines
    assert len(list(license_scan.classify(m, pa.array([together])))) == len(want)
    assert [x[:2] for x in got] == [x[:2] for x in want] and len(want) > 150


def test_license_families_held_out():
    """Wordings that were not in the training set."""
    m = license_scan.Classifier([prose(12, k) for k in range(300)])
    for text, family in (("The code is released under the MIT License", "MIT"), ("All files are licensed under the Apache License, Version 2.0", "Apache-2.0"), ("everything here is licensed under CC BY-SA 4.0", "CC-BY-SA"), ("Redistribution and use in source or binary forms, with or without any modification, are permitted provided that these conditions are met", "BSD")):
        assert m.predict(text)[0] == family, text
    for text in ("The license plate was blue", "permission to land", "under the general public opinion", prose(20, 77)):
        family, _ = m.predict(text)
        assert family == "unknown" or m.match(family, text) < license_scan.MATCH


def test_shares():
    assert mixing.shares(100, {"a": 3, "b": 1}, {"a": 1000, "b": 1000}) == {"a": 75, "b": 25}
    assert mixing.shares(100, {"a": 3, "b": 1, "c": 1}, {"a": 10, "b": 1000, "c": 20}) == {"a": 10, "b": 70, "c": 20}
    assert mixing.shares(10, {"a": 1, "b": 1, "c": 1}, {"a": 9, "b": 9, "c": 9}) == {"a": 4, "b": 3, "c": 3}
    # A shortage stays among siblings while they can take it.
    held = {("d", "x", "1"): 10, ("d", "x", "2"): 100, ("e", "x", "1"): 500}
    assert mixing.allocate(120, held, {}) == {("d", "x", "1"): 10, ("d", "x", "2"): 50, ("e", "x", "1"): 60}
    assert mixing.allocate(400, held, {}) == {("d", "x", "1"): 10, ("d", "x", "2"): 100, ("e", "x", "1"): 290}
    assert mixing.allocate(400, held, {("e",): 0}) == {("d", "x", "1"): 10, ("d", "x", "2"): 100, ("e", "x", "1"): 0}


@pytest.mark.parametrize("epochs, budget", [(1, 0.5), (3, 1.7), (2, 10_000_000)])
def test_mix(spark, monkeypatch, epochs, budget):
    monkeypatch.setattr(mixing, "SLICES", 4)
    rows = [(k, prose(1 + k % 37, k), ["en", "de", None][k % 3], f"s{k % 5 if k % 4 else 0}", 7) for k in range(120)] + [(3, prose(4, 3), None, "s3", 7), (500, None, "en", "s0", 7), (501, "", "en", "s0", 7), (None, "a b\n c ", "en", "s0", 7)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars int, slice int")
    got = mixing.plan(docs, [F.col("lang"), F.col("source")], budget, {("en",): 3}, epochs, 9).collect()
    held: dict = {}
    for i, t, lang, s, _ in rows:
        held[lang, s] = held.get((lang, s), 0) + len((t or "").split())
    held = {k: v for k, v in held.items() if v}
    total = round(budget * sum(held.values())) if isinstance(budget, float) else budget
    want = mixing.allocate(total, {k: v * epochs for k, v in held.items()}, {("en",): 3})
    for leaf, tokens in want.items():
        own = [r for r in got if (r.l0, r.l1) == leaf]
        assert sum(r.take_tokens for r in own) == tokens and all(r.leaf_budget == tokens for r in own)
        assert sum(r.take_tokens < r.n_tokens for r in own) <= 1
        for e in range(tokens // held[leaf]):
            assert sum(r.n_tokens for r in own if r.epoch == e) == held[leaf]
    # Which documents a prefix holds, by brute force: the leaf's in the epoch's seeded order, until its tokens are spent.
    ordered = docs.withColumn("mark", F.xxhash64("text")).crossJoin(spark.range(epochs + 1).select(F.col("id").alias("whole")))
    ordered = ordered.withColumn("order", F.xxhash64(F.lit(9), "whole", "doc_id", "mark")).collect()
    for leaf, tokens in want.items():
        epoch, left, prefix = tokens // held[leaf], tokens % held[leaf], []
        mine = [r for r in ordered if (r.lang, r.source) == leaf and r.whole == epoch and (r.text or "").split()]
        for r in sorted(mine, key=lambda r: ((r.order >> 20) % 4, r.order)):
            n = min(left, len(r.text.split()))
            left -= n
            prefix += [(r.doc_id, n)] if n else []
        assert sorted(prefix, key=repr) == sorted([(r.doc_id, r.take_tokens) for r in got if (r.l0, r.l1) == leaf and r.epoch == epoch], key=repr)
    mixed = mixing.mix(docs, [F.col("lang"), F.col("source")], budget, {("en",): 3}, epochs, 9)
    assert mixed.columns == docs.columns and mixed.dtypes == docs.dtypes
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(want.values())
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.plan(docs.repartition(5), [F.col("lang"), F.col("source")], budget, {("en",): 3}, epochs, 9).collect()), key=repr)
    assert mixing.plan(docs.limit(0), [F.col("lang")], budget, {}).count() == 0
    for hot in (5,) if epochs == 3 else ():  # leaves that are too many for the driver: budgeted level by level, with the same result
        monkeypatch.setattr(mixing, "MOST_LEAVES", 2)
        monkeypatch.setattr(mixing, "HOT", hot)
        wide = mixing.plan(docs, [F.col("lang"), F.col("source")], budget, {("en",): 3}, epochs, 9).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, wide), key=repr)


def test_batches_of_words():
    from tidewright.llm.batches import Words

    texts = pa.array([None, "", " a  b ", "c\x0bd\x1ce", "f g a"])
    w = Words(texts.slice(1))
    got = [[w.distinct[c].as_py() for c in w.codes[a:b].tolist()] for a, b in itertools.pairwise(w.at.tolist())]
    assert got[:2] == [[], ["a", "b"]] and got[3][-1] == "a"
