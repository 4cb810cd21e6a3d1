"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document draws a repeatable exponential key scaled by its quality weight; within a source the
documents with the smallest keys come first, and a prefix sum of their sizes is cut at the source's word
budget. Complete epochs are taken before that fractional selection. No source is ever sorted as a whole:
the cut is found by radix descent over key slots, each level a partial aggregation with at most 4096 rows
a source, so a source with a third of all rows costs no more in one task than any other.

The quality weight of a document comes from its text (length, word length, symbols) unless a column of weights
is named, such as a classifier's scores.

Defined cases. Null or empty text: size 0, taken 0. Null source: a source of its own, ordered last. Null
or repeated doc_id: the key also depends on the text; of rows alike in doc_id, text and source each is numbered
and draws a key of its own (which of them gets which number is not defined, nor does it change doc_id or size).
So a source misses its target by half of one document at most. A source without words: target 0. An empty table gives an empty result. Other columns pass through
untouched, whatever their names; in mix(), a column named like one of the results is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD, guarded, materialize

#: Quality weights lie between this and 1.
LEAST_WEIGHT = 0.25
#: Bits of each level of the descent; rows alike that a task numbers.
BITS, BLOCK = 12, 100_000
OUT = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(size: Column, text: Column) -> Column:
    """1 for documents of ordinary length, word length and few symbols; halved for each that they are not."""
    mean = F.when(size > 0, F.length(text) / size)
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>{}", ""))
    return (F.when(size.between(50, 100_000), 1.0).otherwise(0.5) * F.when(mean.between(3, 12), 1.0).otherwise(0.5) * F.when(10 * symbols <= size, 1.0).otherwise(0.5)).cast("double")


def _code(doc_id: Column, text: Column) -> Column:
    return F.md5(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))), "utf-8"))


def _key(code: Column, number: Column, weight: Column) -> Column:
    """number: of a row among those alike, from 0."""
    own = F.when(number == 0, code).otherwise(F.md5(F.encode(F.concat(code, F.lit(":"), number.cast("string")), "utf-8")))
    u = (F.conv(F.substring(own, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def _slot(key: Column, bits: int) -> Column:
    """Slots keep the order of keys; none holds over 1 / LEAST_WEIGHT times its share."""
    return F.floor((1 - F.exp(-key * LEAST_WEIGHT)) * float(1 << bits)).cast("long")


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Water-filling over one row a source (source, source_size): share of all words by weight, at most cap times its own."""
    alone = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(alone) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("w", pick)
    order = (F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole)
    level = (F.lit(share) * total - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(rest)
    filled = ranked.withColumn("level", level).withColumn("level", F.when(F.col("level") * F.col("w") < F.lit(cap) * F.col("source_size"), F.col("level")))
    first = F.first("level", ignorenulls=True).over(whole)
    full = F.lit(cap) * F.col("source_size")
    return filled.withColumn("first", first).select("source", "source_size", F.coalesce(F.least(full, F.col("first") * F.col("w")), full).cast("double").alias("target"))


def _with_code(docs: DataFrame, quality: str | None) -> DataFrame:
    """doc_id, source, size, _code, _w, and the whole row apart, so that no name of its columns can clash."""
    d = docs.select("doc_id", "source", "text", (F.col(f"`{quality}`").cast("double") if quality else F.lit(None).cast("double")).alias("_w"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    d = d.withColumn("size", word_count(F.col("text")))
    w = F.coalesce("_w", F.lit(1.0)) if quality else quality_weight(F.col("size"), F.coalesce(F.col("text"), F.lit("")))
    w = F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(1.0), F.coalesce(w, F.lit(LEAST_WEIGHT))))
    return d.select("doc_id", "source", "size", _code(F.col("doc_id"), F.col("text")).alias("_code"), w.alias("_w"), "_row")


def _alike(by: str = "_code") -> Column:
    return F.xxhash64("source", by)


def _numbered(rows: DataFrame, again: DataFrame | None) -> DataFrame:
    """rows with _key instead of _code and _w. again: (_same) of rows that have others like them, if there are any.

    Those are written and numbered by their place: within blocks of BLOCK rows of a file in a task each, and
    shifted by the rows of the blocks before, so that any number of rows alike is numbered by many tasks.
    """
    kept = [c for c in rows.columns if c not in ("_code", "_w")]
    if again is None:
        return rows.select(*kept, _key(F.col("_code"), F.lit(0), F.col("_w")).alias("_key"))
    rows = rows.withColumn("_same", _alike())
    lone = rows.join(guarded(again), "_same", "left_anti").withColumn("_n", F.lit(0).cast("long"))
    many = materialize(rows.join(guarded(again), "_same", "left_semi"), "alike")
    block = F.struct(F.col("_metadata.file_name").alias("f"), F.floor(F.col("_metadata.row_index") / BLOCK).alias("k"))
    many = many.select(*many.columns, block.alias("_block"), F.col("_metadata.row_index").alias("_at"))
    sizes = many.groupBy("_same", "_block").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("_same").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_c")
    sizes = sizes.select(F.col("_same").alias("_s"), F.col("_block").alias("_b"), before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_same", "_block").orderBy("_at")) - 1
    many = many.withColumn("_own", own).join(sizes, (F.col("_same") == F.col("_s")) & (F.col("_block") == F.col("_b")))
    every = lone.select(*kept, "_code", "_w", "_n").union(many.select(*kept, "_code", "_w", (F.col("_own") + F.col("_before")).alias("_n")))
    return every.select(*kept, _key(F.col("_code"), F.col("_n"), F.col("_w")).alias("_key"))


def mix(docs: DataFrame, *, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, quality: str | None = None, thin: bool = False, packed: bool = False) -> DataFrame:
    """``docs`` with size, source_size, target and taken. quality: a column of weights, clipped to [LEAST_WEIGHT, 1].

    thin: keep doc_id and source alone, so that the text is read once. packed: keep the row as one column, _row.
    """
    coded = _with_code(docs, quality)
    rows = materialize(coded.drop("_row"), "codes")
    again = materialize(rows.groupBy(_alike().alias("_same")).agg(F.count("*").alias("n")).filter("n > 1").select("_same"), "again")
    again = again if again.limit(1).count() else None
    rows = _numbered(rows, again)
    rows = materialize(rows, "keys") if again is not None else rows
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = materialize(
        targets(sizes, weights, share, cap)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")),
        "targets",
    )
    bound = goal.select(F.col("source").alias("_s"), "budget", F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("before"))
    for level in (1, 2):
        bound = materialize(_descend(rows, bound, level * BITS), f"bound{level}")
    last = rows.join(guarded(bound), F.col("source").eqNullSafe(F.col("_s")) & (_slot(F.col("_key"), 2 * BITS) == F.col("slot")))
    units = last.groupBy("_s", "_key", "budget", "before").agg(F.sum("size").alias("size"))
    run = Window.partitionBy("_s").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0))
    cut = units.withColumn("prior", prior).filter(2 * F.col("prior") + F.col("size") <= 2 * F.col("budget")).groupBy("_s").agg(F.max("_key").alias("cut"))
    b, c = bound.select(F.col("_s").alias("_b"), "slot"), cut.select(F.col("_s").alias("_c"), "cut")
    plan = goal.join(b, F.col("source").eqNullSafe(F.col("_b")), "left").join(c, F.col("source").eqNullSafe(F.col("_c")), "left")
    plan = materialize(plan.select(F.col("source").alias("_s"), "source_size", "target", "epochs", "slot", "cut"), "plan")
    slot = _slot(F.col("_key"), 2 * BITS)
    chosen = (F.col("slot").isNull() | (slot < F.col("slot")) | ((slot == F.col("slot")) & (F.col("_key") <= F.col("cut"))))
    kept = ["doc_id", "source"] if thin else ["_row"]
    own = rows if thin else _numbered(coded, again)
    joined = own.join(guarded(plan), F.col("source").eqNullSafe(F.col("_s")), "inner")
    taken = F.col("size") * (F.col("epochs") + F.when(F.coalesce(chosen, F.lit(False)), 1).otherwise(0))
    out = joined.select(*kept, "size", "source_size", "target", taken.cast("long").alias("taken"))
    return out if thin or packed else out.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c not in OUT], *OUT)


def _descend(rows: DataFrame, bound: DataFrame, bits: int) -> DataFrame:
    """For each source, the slot of 2 ** bits in which its running size passes the budget, and the size before it."""
    wide = 1 << BITS
    at = _slot(F.col("_key"), bits)
    near = F.lit(True) if bits == BITS else F.floor(at / wide) == F.col("slot")
    inside = rows.join(guarded(bound), F.col("source").eqNullSafe(F.col("_s")) & near)
    sums = inside.withColumn("at", at).groupBy("_s", "at").agg(F.sum("size").alias("size"), F.first("budget").alias("budget"), F.first("before").alias("before"))
    run = F.sum("size").over(Window.partitionBy("_s").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("before")
    passed = sums.withColumn("run", run).filter(F.col("run") > F.col("budget"))
    first = passed.groupBy("_s").agg(F.min_by(F.struct("at", "run", "size", "budget"), "at").alias("x"))
    return first.select("_s", F.col("x.budget").alias("budget"), F.col("x.at").alias("slot"), (F.col("x.run") - F.col("x.size")).alias("before"))


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it was taken, with the columns that it had."""
    mixed = mix(docs, packed=True, **how)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    copies = mixed.withColumn("_times", times).filter("_times > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return copies.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), c AS (
  SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || t) AS code FROM d
), n AS (
  SELECT *, row_number() OVER (PARTITION BY source, code) - 1 AS number FROM c
), k AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(CASE WHEN number = 0 THEN code ELSE md5(code || ':' || CAST(number AS VARCHAR)) END, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / greatest(0.25, (CASE WHEN size BETWEEN 50 AND 100000 THEN 1.0 ELSE 0.5 END) * (CASE WHEN size > 0 AND length(t)::DOUBLE / size BETWEEN 3 AND 12 THEN 1.0 ELSE 0.5 END)
        * (CASE WHEN 10 * (length(t) - length(translate(t, '#*$%&|<>{}', ''))) <= size THEN 1.0 ELSE 0.5 END))::DOUBLE AS key
  FROM n
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
      - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), f AS (
  SELECT *, first_value(CASE WHEN level * w < 2.0::DOUBLE * source_size THEN level END IGNORE NULLS) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS top FROM l
), g AS (
  SELECT source, source_size, coalesce(least(2.0::DOUBLE * source_size, top * w), 2.0::DOUBLE * source_size)::DOUBLE AS target FROM f
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM g
), u AS (
  SELECT source, key, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(size) AS prior FROM k GROUP BY source, key
)
SELECT k.doc_id, k.size::BIGINT AS size, e.source_size, round(e.target, 6) AS target,
  (k.size * (e.epochs + CASE WHEN e.target - e.epochs * e.source_size > 0 AND 2 * u.prior + u.n <= 2 * (e.target - e.epochs * e.source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source JOIN u ON k.source IS NOT DISTINCT FROM u.source AND k.key = u.key
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs, thin=True).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")
