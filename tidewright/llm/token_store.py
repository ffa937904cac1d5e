"""Token-ID / binary output: a content-addressed store.

Rolling hashes cut each document's id stream into chunks whose borders depend on the ids near them alone, every
distinct chunk is stored once under its SHA-256, and a recipe per document lists its chunks. A Merkle root over the
chunk digests seals each recipe; the manifest seals the recipes, in a tree of WIDTH branches. Reading verifies all of it.

Layout under a path: ``chunks/`` (digest, n_ids, ids: little-endian unsigned 16- or 32-bit), ``recipes/`` (seq, doc_id, start,
n_tokens, digests, lengths, merkle_root; files in ascending doc_id order), ``manifest/`` (level, node, start, documents, tokens, root:
at level 0 a row for each WIDTH recipes in order, at each further level one for each WIDTH rows below, up to a single one).

Strings of special tokens inside a text are ordinary text, as the vocabulary's own description encodes them
(encode_special_tokens), so that no document can write a control id; special=True gives them their ids, as Tokenizer.encode does unless told so.

Nulls and odd rows: a null text is an empty one and gives the end id alone (without an end id: no ids, and a recipe without chunks); rows with a
null doc_id come first; repeated doc_ids stay separate documents, ordered by their ids' digest; other columns are ignored, whatever their names.
An empty table gives empty tables.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, materialize, only, scratch_path

#: A chunk ends where the low bits of the rolling hash are zero: about 1 in 512 ids, at least 128 and at most 4096.
WINDOW, MEAN_BITS, LEAST, MOST = 16, 9, 128, 4096
MEMO = 300_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Branches of the manifest's tree, as a power of two, so that no row grows with the corpus.
WIDTH_BITS = 10
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Pieces(dict):
    """What stands between two cuts -> its ids. Two generations of at most MEMO entries: what is used again stays.

    lead: what goes before each piece; None: the pieces are pre-tokens themselves.
    """

    def __init__(self, encoder: DocumentEncoder, lead: str | None):
        self.encoder, self.lead, self.old = encoder, lead, {}

    def __missing__(self, piece: str) -> bytes | None:
        value = self.old.get(piece)
        if value is None:
            if self.lead is None:
                value = self.encoder.bpe(piece)
            elif piece.isalpha():
                value = self.encoder.bpe(self.lead + piece)
            elif not piece or piece[0].isspace() or piece[-1].isspace():
                return None
            elif piece[-1] in ".,;:!?" and piece[:-1].isalpha():  # two pre-tokens, not worth an entry
                return self[piece[:-1]] + self.encoder.pre[piece[-1]]
            else:
                value = self.encoder.split(self.lead + piece)
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[piece] = value
        return value


class DocumentEncoder:
    """Whole texts to ids, as tokenizers.Tokenizer.encode(text, add_special_tokens=False) gives them.

    special: added tokens inside a text get their ids; otherwise they are ordinary text. Byte-level BPE never merges across pre-tokens, so texts are cut where the pre-tokenizer cuts for certain, before
    a single space between two other characters, and what stands between is encoded once and kept.
    """

    def __init__(self, path: str, pattern: str, special: bool = False):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not special
        #: The whole library for texts that hold an added token, where those count.
        self.whole, self.added = tokenizer, [t.content for t in tokenizer.get_added_tokens_decoder().values()] if special else []
        self.wide = tokenizer.get_vocab_size() > 1 << 16
        self.dtype, self.code = np.dtype("<u4" if self.wide else "<u2"), "I" if self.wide else "H"
        self.model, self.pattern = tokenizer.model, regex.compile(pattern)
        self.bytes = str.maketrans({b: c for b, c in enumerate(_byte_letters())})
        self.first, self.later, self.pre = Pieces(self, ""), Pieces(self, " "), Pieces(self, None)

    def bpe(self, pre: str) -> bytes:
        if pre.isascii() and pre[1:].isalpha():
            letters = "\u0120" + pre[1:] if pre[0] == " " else pre
        else:
            letters = pre.encode().decode("latin-1").translate(self.bytes)
        return array(self.code, [x.id for x in self.model.tokenize(letters)]).tobytes()

    def split(self, text: str) -> bytes:
        return b"".join(map(self.pre.__getitem__, self.pattern.findall(text)))

    def __call__(self, text: str | None, end_id: int | None) -> np.ndarray:
        if text and any(t in text for t in self.added):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return np.array(ids if end_id is None else [*ids, end_id], self.dtype)
        pieces = text.split(" ") if text else []
        try:
            raw = b"".join([self.first[x] for x in pieces[:1]]) + b"".join(map(self.later.__getitem__, pieces[1:]))
        except TypeError:  # a cut beside other white space is none: take the text as it is
            raw = self.split(text)
        if end_id is not None:
            raw += int(end_id).to_bytes(self.dtype.itemsize, "little")
        return np.frombuffer(raw, self.dtype)

    def look_up(self, pieces: list[str]) -> list[bytes | None]:
        """self.later of each. A mark after a letter is a pre-token of its own, so such pieces are put together; words that are
        new are encoded in one loop."""
        later, old = self.later, self.later.old
        marks = {c: self.pre[c] for c in ".,;:!?"}
        out = list(map(later.get, pieces))
        wait, new = [], {}
        for i, v in enumerate(out):
            if v is not None:
                continue
            x = pieces[i]
            mark = marks.get(x[-1:])
            if mark is not None and x[-2:-1].isalpha():
                x = x[:-1]
                v = later.get(x)
            if v is None:
                v = old.get(x)
                if v is None and x.isalpha():
                    new[x] = None
                    wait.append((i, x, mark))
                    continue
                later[x] = v = later[x] if v is None else v
            out[i] = v if mark is None or v is None or len(x) == len(pieces[i]) else v + mark
        tokenize, code, table = self.model.tokenize, self.code, self.bytes
        for w in new:
            letters = "\u0120" + w if w.isascii() else "\u0120" + w.encode().decode("latin-1").translate(table)
            new[w] = array(code, [t.id for t in tokenize(letters)]).tobytes()
        for i, w, mark in wait:
            out[i] = new[w] if mark is None or len(w) == len(pieces[i]) else new[w] + mark
        if len(later) + len(new) > MEMO:
            later.old = dict(later)
            later.clear()
        later.update(new)
        return out

    def batch(self, texts: pa.Array, end_id: int | None) -> list[np.ndarray]:
        """The same for many texts: each distinct piece of the batch is looked up once."""
        if not len(texts):
            return []
        pieces = pc.split_pattern(pc.fill_null(texts, ""), " ")
        flat, at = pieces.flatten(), pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        coded = flat.dictionary_encode()
        entries = self.look_up(coded.dictionary.to_pylist())
        which = coded.indices.to_numpy().copy()
        which[at[:-1]] = len(entries) + np.arange(len(texts))
        entries += [self.first[x] if x else b"" for x in flat.take(pa.array(at[:-1])).to_pylist()]
        known, none = np.ones(len(entries), bool), [i for i, x in enumerate(entries) if x is None]
        known[none] = False
        for i in none:
            entries[i] = b""
        # A text that begins with a space has an empty first piece, whose space goes with what follows.
        known[len(entries) - len(texts) :] &= (np.diff(at) == 1) | np.array([x != b"" for x in entries[len(entries) - len(texts) :]])
        sizes = np.fromiter(map(len, entries), np.int32, len(entries)) // self.dtype.itemsize
        starts, pool = np.cumsum(sizes, dtype=np.int32) - sizes, np.frombuffer(b"".join(entries), self.dtype)
        sizes = sizes[which]
        ends = np.cumsum(sizes, dtype=np.int32)  # a batch has far fewer ids than 2 ** 31
        ids = pool[np.repeat(starts[which] - (ends - sizes), sizes) + np.arange(ends[-1], dtype=np.int32)]
        borders = np.concatenate([[0], ends[at[1:] - 1]])
        plain = np.logical_and.reduceat(known[which], at[:-1])
        for t in self.added:
            plain &= ~pc.fill_null(pc.match_substring(texts, t), False).to_numpy(zero_copy_only=False)
        end = np.array([] if end_id is None else [end_id], self.dtype)
        return [np.concatenate([ids[borders[i] : borders[i + 1]], end]) if plain[i] else self(texts[i].as_py(), end_id) for i in range(len(texts))]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_ENCODERS: dict[tuple[str, bool], DocumentEncoder] = kept("tokens")


def encoder(path: str, pattern: str, special: bool = False) -> DocumentEncoder:
    if (path, special) not in _ENCODERS:
        _ENCODERS[path, special] = DocumentEncoder(path, pattern, special)
    return _ENCODERS[path, special]


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def _powers(n: int) -> list[np.ndarray]:
    """BASE and its inverse to the powers 0, 1, 2 and so on, n of them at least."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, 1 << 14), base)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS


def cut(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream, by a Rabin-Karp hash of the last WINDOW ids modulo 2**64."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    up, down = _powers(n)
    total = ids.astype(np.uint64)
    total *= np.uint64(0xD6E8FEB86659FD93)
    total += np.uint64(1)
    total *= up[:n]
    np.cumsum(total, out=total)
    rolled = total[WINDOW:] - total[:-WINDOW]  # ends at WINDOW..n-1, scaled by BASE ** its place
    rolled *= down[: n - WINDOW]
    rolled ^= rolled >> np.uint64(29)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    ends, last = [], 0
    for e in (np.flatnonzero(rolled >> np.uint64(64 - MEAN_BITS) == 0) + WINDOW + 1).tolist():
        while e - last > MOST:
            last += MOST
            ends.append(last)
        if e - last >= LEAST:
            ends.append(e)
            last = e
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def merkle_root(digests: list[bytes]) -> bytes:
    """Binary Merkle tree; an odd node goes up as it is; leaves and inner nodes are told apart by a prefix."""
    level = [hashlib.sha256(b"\0" + d).digest() for d in digests] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


_STAGED = "doc_id long, n_tokens long, digests array<binary>, lengths array<int>, merkle_root binary, chunks array<binary>"


def _stage(path: str, pattern: str, end_id: int | None, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("tokens")
        encode = encoder(path, pattern, special)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                # A text that comes again in the batch is encoded and cut once.
                texts = pc.fill_null(batch.column(1).slice(at, 4096), "").dictionary_encode()
                rows = []
                for ids in encode.batch(texts.dictionary, end_id):
                    ends = cut(ids)
                    chunks = [ids[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]
                    digests = [hashlib.sha256(c).digest() for c in chunks]
                    rows.append((len(ids), digests, [len(c) // ids.itemsize for c in chunks], merkle_root(digests), chunks))
                n, d, ls, m, c = zip(*[rows[i] for i in texts.indices.to_pylist()], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 4096), pa.array(n, pa.int64()), pa.array(d, pa.list_(pa.binary())), pa.array(ls, pa.list_(pa.int32())), pa.array(m, pa.binary()), pa.array(c, pa.list_(pa.binary()))],
                    ["doc_id", "n_tokens", "digests", "lengths", "merkle_root", "chunks"],
                )

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str, pattern: str, end_id: int | None = 2, special: bool = False) -> None:
    """Encodes docs(doc_id, text) and writes the store. One scan of the texts; chunks are shuffled once, recipes are small."""
    spark = docs.sparkSession
    staged = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_stage(tokenizer, pattern, end_id, special), _STAGED), "staged_ids")
    (
        staged.select(F.explode(F.arrays_zip("digests", "lengths", "chunks")).alias("c"))
        .groupBy(F.col("c.digests").alias("digest"))
        .agg(F.first("c.lengths").alias("n_ids"), F.first("c.chunks").alias("ids"))  # partial first: a hot chunk leaves each task once
        .write.option("compression", "zstd").parquet(f"{path}/chunks")
    )
    ranged = staged.select("doc_id", "n_tokens", "digests", "lengths", "merkle_root")
    ranged = ranged.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("merkle_root")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "merkle_root")
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "recipes")
    # Ids and documents before each range: one row per range, however many documents there are.
    sums = ranged.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("d"))
    order = Window.orderBy("part")
    before = sums.select("part", (F.sum("n").over(order) - F.col("n")).alias("before"), (F.sum("d").over(order) - F.col("d")).alias("docs_before"))
    own = Window.partitionBy("part").orderBy("place")
    inside = F.sum("n_tokens").over(own.rowsBetween(Window.unboundedPreceding, -1))
    recipes = ranged.join(before, "part").select(
        (F.col("docs_before") + F.row_number().over(own) - 1).alias("seq"), "doc_id", (F.col("before") + F.coalesce(inside, F.lit(0))).alias("start"), "n_tokens", "digests", "lengths", "merkle_root", "part"
    )
    recipes.sortWithinPartitions("part", "seq").drop("part").write.option("compression", "zstd").parquet(f"{path}/recipes")
    level = materialize(_sealed(_leaves(spark, path)), "manifest")
    for k in range(60):
        level.select(F.lit(k).alias("level"), "*").write.mode("append").parquet(f"{path}/manifest")
        if level.count() < 2:
            break
        level = materialize(_sealed(level.withColumnRenamed("node", "seq")), "manifest")


def _leaves(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/recipes").select("seq", "start", F.lit(1).cast("long").alias("documents"), F.col("n_tokens").alias("tokens"), F.lower(F.hex("merkle_root")).alias("root"))


def _sealed(rows: DataFrame) -> DataFrame:
    """(seq, start, documents, tokens, root) -> the same of their parents, as node: the SHA-256 of their children's roots and places in order."""
    child = F.struct("seq", "start", "documents", "tokens", "root")
    said = F.transform("rows", lambda r: F.concat_ws(" ", r["seq"], r["start"], r["documents"], r["tokens"], r["root"]))
    grouped = rows.groupBy(F.shiftright("seq", WIDTH_BITS).alias("node")).agg(F.min("start").alias("start"), F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"), F.array_sort(F.collect_list(child)).alias("rows"))
    return grouped.select("node", "start", "documents", "tokens", F.sha2(F.array_join(said, "\n"), 256).alias("root"))


def verify_manifest(spark: SparkSession, path: str) -> tuple[int, int]:
    """(documents, tokens) that the manifest seals. Raises unless every recipe is there, as sealed, and every level seals the one below."""
    held = spark.read.parquet(f"{path}/manifest")
    if held.isEmpty():
        if not _leaves(spark, path).isEmpty():
            raise ValueError("there are recipes that the manifest does not have")
        return 0, 0
    columns = ["node", "start", "documents", "tokens", "root"]
    top = held.agg(F.max("level")).first()[0]
    for k in range(top + 1):
        below = _leaves(spark, path) if not k else held.where(F.col("level") == k - 1).withColumnRenamed("node", "seq")
        now, sealed = _sealed(below).select(*columns), held.where(F.col("level") == k).select(*columns)
        odd = now.withColumn("n", F.lit(1)).union(sealed.withColumn("n", F.lit(-1))).groupBy(*columns).agg(F.sum("n").alias("n")).where("n != 0")
        if not odd.isEmpty():
            raise ValueError(f"the manifest does not match what lies below its level {k}")
    last = held.where(F.col("level") == top).collect()
    if len(last) != 1:
        raise ValueError("the manifest has no single root")
    return last[0]["documents"], last[0]["tokens"]


def _crc_times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo that of CRC-32, bits reflected."""
    out, m = 0, 1 << 31
    while a:
        if a & m:
            out ^= b
            a ^= m
        m >>= 1
        b = b >> 1 ^ 0xEDB88320 if b & 1 else b >> 1
    return out


#: x to the powers 1, 2, 4, 8 and so on.
_SQUARES = [1 << 30]
while len(_SQUARES) < 64:
    _SQUARES.append(_crc_times(_SQUARES[-1], _SQUARES[-1]))
_SHIFTS: dict[int, int] = {}


def _shift(n: int) -> int:
    """x ** (8 n): what a CRC-32 is multiplied by when n bytes follow."""
    if n not in _SHIFTS:
        if len(_SHIFTS) > 100_000:
            _SHIFTS.clear()
        out = 1 << 31
        for k, square in enumerate(_SQUARES):
            if 8 * n >> k & 1:
                out = _crc_times(square, out)
        _SHIFTS[n] = out
    return _SHIFTS[n]


def crc_concat(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a concatenation, from each part's CRC-32 and length in bytes."""
    total = 0
    for crc, n in parts:
        total = (_crc_times(_shift(n), total) if total else 0) ^ crc
    return total


def _ids32(raw: bytes, n: int) -> bytes:
    return raw if len(raw) == 4 * n else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole documents rebuilt from the store: doc_id, start, n_tokens, ids (binary, 32-bit little-endian), merkle_root."""
    verify_manifest(spark, path)
    refs = spark.read.parquet(f"{path}/recipes").select("seq", "doc_id", "start", "n_tokens", "merkle_root", F.posexplode_outer("digests").alias("at", "digest"))
    chunks = spark.read.parquet(f"{path}/chunks")
    # A recipe has one row of digests; its chunks are put together by its number, which no other document has.
    grouped = refs.join(chunks, "digest", "left").groupBy("seq").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.first("n_tokens").alias("n_tokens"), F.first("merkle_root").alias("merkle_root"), F.array_sort(F.collect_list(F.struct("at", "digest", "n_ids", "ids"))).alias("parts"))

    def build(parts, root) -> bytes:
        parts = [p for p in parts if p["digest"] is not None]  # none of an empty document
        if any(p["ids"] is None for p in parts) or merkle_root([hashlib.sha256(bytes(p["ids"])).digest() for p in parts]) != bytes(root):
            raise ValueError("a document's chunks do not match its Merkle root")
        return b"".join(_ids32(bytes(p["ids"]), p["n_ids"]) for p in parts)

    return grouped.select("doc_id", "start", "n_tokens", F.udf(build, "binary")("parts", "merkle_root").alias("ids"), "merkle_root")


def _verify_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, n_ids, raws = (batch.column(k).to_pylist() for k in range(3))
        crcs = []
        for d, n, raw in zip(digests, n_ids, raws, strict=True):
            if hashlib.sha256(raw).digest() != d:
                raise ValueError(f"chunk {d.hex()} does not have the content that it is stored under")
            crcs.append(zlib.crc32(_ids32(raw, n)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], ["digest", "n_ids", "crc"])


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, merkle_root per document, read back and verified; the manifest first.

    Each chunk is read once where it lies; its CRC-32 and length, not its ids, meet the recipes, since the CRC-32 of a
    whole stream follows from those of its parts.
    """
    verify_manifest(spark, path)
    found = spark.read.parquet(f"{path}/chunks").select("digest", "n_ids", "ids").mapInArrow(_verify_chunks, "digest binary, n_ids int, crc long")
    refs = spark.read.parquet(f"{path}/recipes").select("seq", "doc_id", "start", "n_tokens", "merkle_root", F.posexplode_outer("digests").alias("at", "digest"))
    grouped = refs.join(found, "digest", "left").groupBy("seq").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.first("n_tokens").alias("n_tokens"), F.first("merkle_root").alias("merkle_root"), F.array_sort(F.collect_list(F.struct("at", "n_ids", "crc", "digest"))).alias("parts"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(4)
            flat, at = parts.flatten(), (parts.offsets.to_numpy() - parts.offsets[0].as_py()).tolist()
            n_ids, crc, digest = (flat.field(k).to_pylist() for k in (1, 2, 3))
            crcs = []
            for a, b, n, root in zip(at, at[1:], batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=False):
                if digest[a] is None:  # an empty document has no chunk
                    b = a
                if None in crc[a:b] or sum(n_ids[a:b]) != n or merkle_root(digest[a:b]) != root:
                    raise ValueError("a recipe does not match its chunks or its Merkle root")
                crcs.append(crc[a] if b == a + 1 else crc_concat([(c, 4 * k) for c, k in zip(crc[a:b], n_ids[a:b], strict=True)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(crcs, pa.int64()), batch.column(3)], ["doc_id", "start", "n_tokens", "ids_crc32", "merkle_root"])

    return grouped.select("doc_id", "start", "n_tokens", "merkle_root", "parts").mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long, merkle_root binary")


def store_and_verify(docs: DataFrame, tokenizer: str | None = None, pattern: str | None = None, end_id: int | None = 2, path: str | None = None, special: bool = False) -> DataFrame:
    """Writes docs to a store (in the scratch folder where no path is given) and returns read_checksums of it."""
    import public_tokenizers

    path = path or scratch_path(docs.sparkSession, "token_store")
    write_store(docs, path, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN, end_id, special)
    return read_checksums(docs.sparkSession, path)
