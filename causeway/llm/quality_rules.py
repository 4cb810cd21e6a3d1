"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document's counts become integer ratios. For every language and source, a mergeable quantile sketch of
each ratio is kept: counts of log-linear bins (exact below 64, then 32 bins for each power of two, so a
quantile is off by at most 1/32 of its value). Sketches merge by adding counts, are built with map-side
partial aggregation, and hold at most some hundred bins a group, so a hot group is no larger than another.
A document is rejected if one of its ratios lies beyond the group's outer fence, which is derived from the
sketch's quartiles and replaces a fixed cutoff. A group of fewer than MIN_GROUP documents has no quartiles worth
the name and uses the fences of all documents, so a verdict in it can change once the group has grown.

Defined cases. Null or empty text: all counts 0, base_failed, not kept. Null lang or source: a group of its
own. Repeated rows: each is judged alone and counts in the sketches. An empty table gives an empty result.
Columns beside doc_id, text, lang and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD, guarded, materialize

#: Groups below this many documents are judged by the fences of all documents.
MIN_GROUP = 20
#: Bins below this value are exact.
EXACT = 64
#: ratio -> (quartile distance factor, least distance of the fence from the upper quartile, lower fence too)
RULES = {
    "word_length": (6, 300, True),
    "symbols": (6, 100, False),
    "dup_lines": (6, 300, False),
    "repeat_words": (6, 300, False),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(docs: DataFrame, spare: int = 0) -> DataFrame:
    """The base counts of whole texts. spare: bits by which the hash of windows is shortened, for tests."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # Arrays that lambdas read are columns of their own, so that none is built anew for each element.
    d = docs.select("doc_id", "lang", "source", text.alias("text")).withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    d = d.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)))
    n = F.size("words")
    d = d.select(
        "doc_id", "lang", "source", "words", n.alias("n"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    # A window's hash and place share a long: as few low bits as the places need, the hash above them.
    bits = F.length(F.bin(F.col("n").cast("long"))).cast("int")
    d = d.withColumn("shift", bits + F.lit(spare))
    pack = "transform(sequence(0, n - 3), i -> shiftleft(xxhash64(words[i], words[i + 1], words[i + 2]), shift) | i)"
    d = d.withColumn("packed", F.expr(f"CASE WHEN n >= 4 THEN sort_array({pack}) ELSE array() END"))
    d = d.withColumn("m", F.size("packed"))
    # Long texts leave few bits to the hash, so windows of equal hashes are compared by their words.
    d = d.withColumn("low", F.expr("shiftleft(1L, shift) - 1"))
    place = lambda x, k: f"words[cast({x} & low as int) + {k}]"
    alike = " AND ".join(f"{place('a', k)} = {place('b', k)}" for k in range(3))
    # 0: other hashes, 1: the same window, 2: different windows of one hash, which may part others that are the same
    same = f"zip_with(slice(packed, 1, greatest(m - 1, 0)), slice(packed, 2, greatest(m - 1, 0)), (a, b) -> CASE WHEN shiftright(a, shift) <> shiftright(b, shift) THEN 0 WHEN {alike} THEN 1 ELSE 2 END)"
    d = d.withColumn("same", F.expr(f"CASE WHEN m >= 2 THEN {same} ELSE cast(array() AS array<int>) END"))
    d = d.withColumn("any_same", F.array_contains("same", 1)).withColumn("parted", F.array_contains("same", 2))
    twice = "filter(zip_with(packed, zip_with(array_append(same, 0), array_prepend(same, 0), (a, b) -> a = 1 OR b = 1), (p, s) -> IF(s, p & low, -1L)), p -> p >= 0)"
    # Where that happens the windows are sorted by their words.
    d = d.withColumn("whole", F.expr("CASE WHEN parted THEN sort_array(transform(sequence(0, n - 3), i -> struct(words[i] AS a, words[i + 1] AS b, words[i + 2] AS c, cast(i AS bigint) AS i))) END"))
    d = d.withColumn("next", F.expr("CASE WHEN parted THEN zip_with(slice(whole, 1, m - 1), slice(whole, 2, m - 1), (x, y) -> x.a = y.a AND x.b = y.b AND x.c = y.c) END"))
    exact = "filter(zip_with(whole, zip_with(array_append(next, false), array_prepend(next, false), (x, y) -> x OR y), (p, s) -> IF(s, p.i, -1L)), p -> p >= 0)"
    d = d.withColumn("at", F.expr(f"CASE WHEN parted THEN sort_array({exact}) WHEN any_same THEN sort_array({twice}) ELSE cast(array() AS array<bigint>) END")).withColumn("k", F.size("at"))
    covered = "CASE WHEN k > 0 THEN 3L + aggregate(zip_with(slice(at, 1, k - 1), slice(at, 2, k - 1), (a, b) -> least(3L, b - a)), 0L, (s, x) -> s + x) ELSE 0L END"
    return d.select("doc_id", "lang", "source", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.expr(covered).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _ratios() -> dict[str, Column]:
    """In thousandths of a word."""
    per = lambda c: F.expr(f"IF(n_words > 0, {c} * 1000 div n_words, 0L)")
    return {"word_length": per("word_chars"), "symbols": per("n_symbols"), "dup_lines": per("n_dup_lines * 10"), "repeat_words": per("n_repeat_words")}


def _bin(v: str) -> str:
    return f"IF({v} < {EXACT}, {v}, shiftleft(shiftright({v}, length(bin({v})) - 6), length(bin({v})) - 6))"


def fences(counted: DataFrame) -> DataFrame:
    """One row a language and source: low_ and high_ of each ratio; _all holds for small groups."""
    passed = counted.filter(~base_failed())
    r = passed.select("lang", "source", *[c.alias(k) for k, c in _ratios().items()])
    long = r.select("lang", "source", F.expr(f"stack({len(RULES)}, {', '.join(f"'{k}', {k}" for k in RULES)}) AS (rule, v)"))
    own = long.select("lang", "source", "rule", F.expr(_bin("v")).alias("bin")).groupBy("lang", "source", "rule", "bin").agg(F.count("*").alias("c"))
    own = materialize(own, "sketches")
    pool = own.groupBy("rule", "bin").agg(F.sum("c").alias("c"))
    q = lambda df, keys: _quartiles(df, keys)
    groups, whole = q(own, ["lang", "source", "rule"]), q(pool, ["rule"])
    whole = whole.select(F.col("rule").alias("_rule"), F.col("q1").alias("_q1"), F.col("q3").alias("_q3"))
    small = F.col("total") < MIN_GROUP
    both = groups.join(F.broadcast(whole), F.col("rule") == F.col("_rule"))  # as many rows as there are rules
    q1, q3 = F.when(small, F.col("_q1")).otherwise(F.col("q1")), F.when(small, F.col("_q3")).otherwise(F.col("q3"))
    out = []
    for k, (factor, least, lower) in RULES.items():
        reach = F.greatest(factor * (q3 - q1), F.lit(least))
        out.append(F.max(F.when(F.col("rule") == k, q3 + reach)).alias(f"high_{k}"))
        if lower:
            out.append(F.max(F.when(F.col("rule") == k, q1 - reach)).alias(f"low_{k}"))
    return both.groupBy("lang", "source").agg(*out)


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys)
    run = sketch.withColumn("run", F.sum("c").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("total", F.sum("c").over(w))
    at = lambda p: F.min(F.when(F.col("run") * 4 >= F.col("total") * p, F.col("bin")))
    return run.groupBy(*keys).agg(at(1).alias("q1"), at(3).alias("q3"), F.max("total").alias("total"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept, with each ratio's verdict."""
    c = materialize(counts(docs), "counts")
    f = materialize(fences(c), "fences").withColumnsRenamed({"lang": "_lang", "source": "_source"})
    ratios = c.withColumns({f"r_{k}": x for k, x in _ratios().items()})
    j = ratios.join(guarded(f), F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    good = F.lit(True)
    for k, (_, _, lower) in RULES.items():
        good = good & (F.col(f"r_{k}") <= F.col(f"high_{k}"))
        if lower:
            good = good & (F.col(f"r_{k}") >= F.col(f"low_{k}"))
    return j.select("doc_id", *COUNTS, base_failed().alias("base_failed"), F.coalesce(~base_failed() & good, F.lit(False)).alias("kept"))


_SQL_BIN = "CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END"
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), l AS (
  SELECT rid, t, lang, source, doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT rid, i, [ws[i], ws[i + 1], ws[i + 2]] AS w3 FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM l)
), p AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w3) AS n FROM g) WHERE n > 1
), r AS (
  SELECT rid, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n_repeat_words FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM p) GROUP BY rid
), c AS (
  SELECT l.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM l LEFT JOIN r ON l.rid = r.rid
), b AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS word_length, CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS symbols,
    CASE WHEN n_words > 0 THEN n_dup_lines * 10000 // n_words ELSE 0 END AS dup_lines, CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeat_words
  FROM c
), v AS (
  SELECT lang, source, rule, v FROM b UNPIVOT (v FOR rule IN (word_length, symbols, dup_lines, repeat_words)) WHERE NOT base_failed
), k AS (
  SELECT lang, source, rule, {_SQL_BIN} AS bin, count(*) AS c FROM v GROUP BY ALL
), q AS (
  SELECT lang, source, rule, max(total) AS total, min(bin) FILTER (WHERE run * 4 >= total) AS q1, min(bin) FILTER (WHERE run * 4 >= total * 3) AS q3 FROM (
    SELECT *, sum(c) OVER (PARTITION BY lang, source, rule ORDER BY bin) AS run, sum(c) OVER (PARTITION BY lang, source, rule) AS total FROM k) GROUP BY ALL
), a AS (
  SELECT rule, min(bin) FILTER (WHERE run * 4 >= total) AS q1, min(bin) FILTER (WHERE run * 4 >= total * 3) AS q3 FROM (
    SELECT *, sum(c) OVER (PARTITION BY rule ORDER BY bin) AS run, sum(c) OVER (PARTITION BY rule) AS total FROM (SELECT rule, bin, sum(c) AS c FROM k GROUP BY ALL)) GROUP BY ALL
), f AS (
  SELECT lang, source, rule, CASE WHEN total < {MIN_GROUP} THEN a.q1 ELSE q.q1 END AS q1, CASE WHEN total < {MIN_GROUP} THEN a.q3 ELSE q.q3 END AS q3 FROM q JOIN a USING (rule)
), h AS (
  SELECT lang, source, max(q3 + greatest(6 * (q3 - q1), 300)) FILTER (WHERE rule = 'word_length') AS high_l, max(q1 - greatest(6 * (q3 - q1), 300)) FILTER (WHERE rule = 'word_length') AS low_l,
    max(q3 + greatest(6 * (q3 - q1), 100)) FILTER (WHERE rule = 'symbols') AS high_s, max(q3 + greatest(6 * (q3 - q1), 300)) FILTER (WHERE rule = 'dup_lines') AS high_d,
    max(q3 + greatest(6 * (q3 - q1), 300)) FILTER (WHERE rule = 'repeat_words') AS high_r FROM f GROUP BY ALL
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(NOT base_failed AND word_length BETWEEN low_l AND high_l AND symbols <= high_s AND dup_lines <= high_d AND repeat_words <= high_r, false) AS kept
FROM b LEFT JOIN h ON b.lang IS NOT DISTINCT FROM h.lang AND b.source IS NOT DISTINCT FROM h.source
"""


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
