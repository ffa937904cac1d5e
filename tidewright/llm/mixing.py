"""Mixing sources to target weights by hierarchical budgeting.

Documents belong to leaves of a tree (domain, then language, then source). A budget of tokens goes down the tree by weight. A node takes
no more than its leaves hold in most_epochs passes; what it can't take goes to its siblings by their weights, and only
what a whole family of siblings can't take goes to their parent's siblings. Shares are rounded to whole tokens by largest remainder.

Up to MOST_LEAVES leaves are budgeted on the driver. Of more, each level is budgeted as a table, the children of a node being one
task's work (their numbers alone), by the same rule with the same result.

Each leaf then takes its prefix of tokens from seeded epochs: every epoch deals the leaf's documents in an order of its
own, from a hash of seed, epoch and document; whole epochs first, then a prefix, whose last document is cut. Prefix sums are over
hash slices of each leaf first and within the one slice that holds the border afterwards, so no task gets a whole leaf.

Nulls and odd rows: a null leaf column is a leaf of its own; a null or empty text has no tokens and is never taken; rows with a null doc_id
are dealt like others; repeated rows are separate documents; leaves without a weight weigh 1, and those of weight 0 take nothing; an empty table
gives no rows; other columns are ignored, or kept by mix(), unless they clash with the names added, which replace them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Hash slices of a leaf: SLICES, more where they would hold more than SLICE rows.
SLICES, SLICE, MOST_LEAVES, HOT, MOST_HOT = 1024, 100_000, 200_000, 10_000, 20_000

Path = tuple[str | None, ...]


def shares(budget: int, weights: dict, capacities: dict) -> dict:
    """Splits budget among siblings by weight, none above its capacity; what one can't take goes to the others by weight."""
    out, left = dict.fromkeys(weights, 0), min(budget, sum(capacities[k] for k in weights if weights[k] > 0))
    open_ = sorted((k for k in weights if weights[k] > 0 and capacities[k] > 0), key=repr)
    while left and open_:
        total = sum(Fraction(weights[k]) for k in open_)
        full = [k for k in open_ if left * Fraction(weights[k]) / total >= capacities[k]]
        if full:
            for k in full:
                out[k] = capacities[k]
                left -= capacities[k]
            open_ = [k for k in open_ if k not in set(full)]
            continue
        exact = {k: left * Fraction(weights[k]) / total for k in open_}
        for k in open_:
            out[k] = int(exact[k])
        rest = left - sum(out[k] for k in open_)
        for k in sorted(open_, key=lambda k: (out[k] - exact[k], repr(k)))[:rest]:
            out[k] += 1
        break
    return out


def allocate(budget: int, capacities: dict[Path, int], weights: dict[Path, float]) -> dict[Path, int]:
    """Tokens for each leaf. weights: of any node by its path from the top; 1 where it has none."""
    out: dict[Path, int] = {}

    def usable(leaf: Path) -> bool:
        return all(weights.get(leaf[: k + 1], 1) > 0 for k in range(len(leaf)))

    held: dict[Path, int] = {}
    below: dict[Path, set[Path]] = {}
    for leaf, n in capacities.items():
        for k in range(len(leaf)):
            below.setdefault(leaf[:k], set()).add(leaf[: k + 1])
        for k in range(len(leaf) + 1):
            held[leaf[:k]] = held.get(leaf[:k], 0) + (n if usable(leaf) else 0)

    def down(node: Path, tokens: int) -> None:
        if node not in below:
            out[node] = tokens
            return
        for child, n in shares(tokens, {c: weights.get(c, 1) for c in below[node]}, {c: held[c] for c in below[node]}).items():
            down(child, n)

    down((), min(budget, held.get((), 0)))
    return out


def allocate_wide(budget: int, totals: DataFrame, names: list[str], weights: dict[Path, float]) -> DataFrame:
    """allocate() for leaves that are too many for the driver. totals(names, capacity) -> names, leaf_budget."""
    path = lambda row: tuple(row[n] for n in names if n in row)
    kinds = [f"{n} string" for n in names]

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [path(r) for r in batch.select(names).to_pylist()]
            held = [c if all(weights.get(p[: k + 1], 1) > 0 for k in range(len(p))) else 0 for p, c in zip(rows, batch.column("capacity").to_pylist(), strict=True)]
            yield batch.set_column(batch.schema.get_field_index("capacity"), "capacity", pa.array(held, pa.int64()))

    def share(columns: list[str]):
        def run(group: pa.Table) -> pa.Table:
            rows = group.to_pylist()
            paths = [path(r) for r in rows]
            out = shares(rows[0]["leaf_budget"], {p: weights.get(p, 1) for p in paths}, {p: r["capacity"] for p, r in zip(paths, rows, strict=True)})
            return group.select(columns).append_column("leaf_budget", pa.array([out[p] for p in paths], pa.int64()))

        return run

    held = materialize(totals.select(*names, "capacity").mapInArrow(usable, ", ".join([*kinds, "capacity long"])), "held")
    most = held.agg(F.sum("capacity")).first()[0] or 0
    given = held.sparkSession.createDataFrame([(min(budget, most),)], "leaf_budget long")
    for k in range(len(names)):
        below = held.groupBy(*names[: k + 1]).agg(F.sum("capacity").alias("capacity"))
        same = reduce(lambda x, n: x & F.col(f"g.{n}").eqNullSafe(F.col(f"b.{n}")), names[:k], F.lit(True))
        below = below.alias("b").join(given.alias("g"), same).select("b.*", "leaf_budget")
        given = materialize(below.withColumn("top", F.lit(0)).groupBy("top", *names[:k]).applyInArrow(share(names[: k + 1]), ", ".join([*kinds[: k + 1], "leaf_budget long"])), "given")
    return given


def words_count(text: str = "text") -> Column:
    """Tokens where nothing else is given: runs of [^\\x20\\x09-\\x0D]."""
    t = F.regexp_replace(F.col(text), r"[\x20\x09-\x0D]+", " ")
    t = F.trim(t)
    return F.when(t.isNull() | (t == ""), 0).otherwise(F.char_length(t) - F.char_length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def plan(docs: DataFrame, leaves: list[Column], budget: int | float, weights: dict[Path, float], most_epochs: int = 1, seed: int = 1, tokens: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """doc_id, leaf columns l0.., epoch, n_tokens, take_tokens, leaf_budget; one row for each document and epoch taken.

    budget: tokens, or a share of all tokens where it is a float. keep: more columns of docs to carry along.
    """
    names = [f"l{k}" for k in range(len(leaves))]
    carried = [F.struct(*[F.col(c) for c in keep]).alias("kept")] if keep else []
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.cast("string").alias(n) for c, n in zip(leaves, names, strict=True)], F.coalesce(words_count() if tokens is None else tokens, F.lit(0)).cast("long").alias("n_tokens"), F.xxhash64(F.col("text").cast("string")).alias("mark"), *carried).where("n_tokens > 0")
    sized = materialize(sized, "sized")
    totals = materialize(sized.groupBy(*names).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")), "totals")
    n_leaves, n_tokens, n_docs = totals.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("docs"), F.lit(0))).first()
    want = round(budget * n_tokens) if isinstance(budget, float) else budget
    kinds = ", ".join(f"{n} string" for n in names)
    if n_leaves <= MOST_LEAVES:
        held = {tuple(r[k] for k in names): r["n"] for r in totals.collect()}
        given = allocate(want, {p: n * most_epochs for p, n in held.items()}, weights)
        rows = [(*p, int(given.get(p, 0))) for p in held]
        given = sized.sparkSession.createDataFrame(rows or [(*[None] * len(names), 0)], kinds + ", leaf_budget long")
    else:
        given = allocate_wide(want, totals.withColumn("capacity", F.col("n") * most_epochs), names, weights)

    def same(a: str, b: str) -> Column:
        return reduce(lambda x, n: x & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")), names, F.lit(True))

    per = given.alias("g").join(totals.alias("t"), same("g", "t")).select("g.*", "n", "docs")
    slices = F.greatest(F.lit(SLICES), F.ceil(F.col("docs") / SLICE)).cast("long").alias("slices")
    budgets = materialize(per.select(*names, "leaf_budget", F.expr("leaf_budget div n").alias("whole"), F.expr("leaf_budget % n").alias("rest"), slices, "docs"), "budgets")

    def at_leaves(rows: DataFrame, facts: DataFrame, *columns: str) -> DataFrame:
        """rows with columns of their leaves. Few leaves are broadcast, of many those with many rows, at most MOST_HOT."""
        pick = ["r.*", *[f"f.{c}" for c in columns]]
        join = lambda r, f, how="inner": r.alias("r").join(f.alias("f"), same("r", "f"), how)
        if n_leaves <= MOST_LEAVES:
            return join(rows, F.broadcast(facts)).select(*pick)
        hot = F.col("docs") > max(HOT, n_docs // MOST_HOT)
        often = F.broadcast(facts.where(hot))
        return join(rows, often).select(*pick).union(join(join(rows, often, "left_anti"), facts.where(~hot)).select(*pick))

    ready = at_leaves(sized, budgets, "leaf_budget", "whole", "rest", "slices", "docs")
    order = F.xxhash64(F.lit(seed), "whole", "doc_id", "mark")
    ready = ready.withColumn("order", order).withColumn("slice", F.pmod(F.shiftright("order", 20), F.col("slices")).cast("int"))
    full = ready.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int") - 1))).withColumn("take_tokens", F.col("n_tokens"))
    slices = ready.where("rest > 0").groupBy(*names, "slice").agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"), F.max("docs").alias("docs"))
    before = slices.withColumn("before", F.sum("n").over(Window.partitionBy(*names).orderBy("slice")) - F.col("n")).where("before < rest")
    last = before.where("before + n >= rest").select(*names, F.col("slice").alias("cut"), "before", "docs")  # one row per leaf
    partial = at_leaves(ready.where("rest > 0"), materialize(last, "cuts"), "cut", "before").where("slice <= cut")
    inside = partial.where("slice = cut").withColumn("sum_", F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*names).orderBy("order", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, 0)))
    border = inside.where("sum_ - n_tokens < rest").withColumn("take_tokens", F.least("n_tokens", F.col("rest") - (F.col("sum_") - F.col("n_tokens"))))
    columns = ["doc_id", *names, "epoch", "n_tokens", "take_tokens", "leaf_budget", *(["kept"] if keep else [])]
    some = partial.where("slice < cut").withColumn("take_tokens", F.col("n_tokens")).select(*ready.columns, "take_tokens").union(border.select(*ready.columns, "take_tokens"))
    return full.select(*columns).union(some.withColumn("epoch", F.col("whole").cast("int")).select(*columns))


def mix(docs: DataFrame, leaves: list[Column], budget: int | float, weights: dict[Path, float], most_epochs: int = 1, seed: int = 1) -> DataFrame:
    """The rows of docs that the mixture takes, once for each epoch, with their columns; a cut document's text ends after its last word taken."""
    taken = plan(docs, leaves, budget, weights, most_epochs, seed, keep=docs.columns)
    types = dict(docs.dtypes)
    whole = taken.where("take_tokens >= n_tokens").select(*[F.col(f"kept.`{c}`").alias(c) for c in docs.columns])
    # At most one cut document for each leaf.
    first_words = F.udf(lambda text, n: "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", text)[:n]), "string")
    cut = taken.where("take_tokens < n_tokens").withColumn("text_", first_words(F.col("kept.text"), "take_tokens"))
    new = {"text": F.col("text_"), "n_chars": F.char_length("text_")}
    return whole.union(cut.select(*[new.get(c, F.col(f"kept.`{c}`")).cast(types[c]).alias(c) for c in docs.columns]))
