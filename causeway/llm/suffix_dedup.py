"""Removal of repeated strings by suffix arrays.

Every byte covered by a WINDOW-byte string that also starts elsewhere in the corpus is removed. Beside it, passages
of over 50 words that occur elsewhere are found in the same way, with a text taken as a string of its words: so
passages are seen whose words are too short to fill WINDOW bytes. What follows is said of bytes (symbols are bytes)
and holds for words (symbols are hashes of words) alike; `UNITS` has the figures of both.

1. Per text, numpy cuts its windows into pieces: a window belongs to the gram in it with the smallest hash, and
   neighbouring windows of one gram are one piece. Equal windows have equal grams, whatever text they are in.
2. Grams that occur once in the corpus are left aside. Of the pieces of the others, equal ones are one row with a
   number of occurrences, so groups of copies of any size cost one row from here on.
3. Pieces are laid into shards of bounded size. Each shard gets a suffix array by Larsson-Sadakane refinement in
   numpy (only groups not yet sorted are refined, up to a window) and common prefixes in Kasai's order of text
   positions; they give the classes of equal windows, and so those that occur twice, with occurrences counted.
4. A gram whose pieces hold over SPLIT bytes is dealt over several shards. Each sends its different windows of such
   grams, in order; the shards' ordered arrays are merged pairwise by searching one's windows in the other's, which
   finds windows that repeat across shards. Windows go to merging tasks by ranges of bounded size.
5. The windows' ranges return to every occurrence of their pieces, are united per text, and the bytes removed.

Texts are read twice: once for step 1, and once more for those with a repeated gram, which alone are shuffled.
Grams have hashes of 64 bits; texts, pieces and windows across shards of 128. Defined cases. Null or empty text: 0
bytes, nothing removed, the digest of no bytes. Shorter than a window: kept whole. Repeated rows: each is a document,
so both lose the text they share. A null doc_id is kept as it is. Other columns, whatever their names, are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words as words
from ._shared import as_bytes, discard, map_arrow, materialize, release, settle, slices

WINDOW, GRAM = 400, 160
#: Bytes in a shard; bytes of a gram's pieces in one shard; window digests in a range.
SHARD, SPLIT, RANGE = 2_000_000, 16_000, 500_000
#: Keys of texts (8 bytes each) up to which they are sent to all tasks, to find these texts without a shuffle.
KEYS = 400_000
_U = np.uint64


class Unit(NamedTuple):
    """What a symbol is: windows and grams are counted in symbols, and a piece has at most `most` windows."""

    window: int
    gram: int
    most: int
    wide: int  # bytes of a symbol where pieces are laid


UNITS = (Unit(WINDOW, GRAM, 2048, 1), Unit(51, 14, 256, 8))


def values(symbols: np.ndarray) -> np.ndarray:
    """64 bits for each symbol, from which hashes of strings are summed."""
    return words.SPREAD[symbols] if symbols.dtype == np.uint8 else words.mix(symbols.astype(_U))


def pieces(symbols: np.ndarray, at: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """Text, start in it, number of windows, occurrences of its gram, gram hash and digest of each piece."""
    window, gram = unit.window, unit.gram
    n, wide = len(symbols), window - gram + 1
    last = n - window + 1
    if last <= 0:
        return (np.zeros(0, np.int64),) * 6
    sums = words.sums(values(symbols))
    low = hashes = words.mix((sums[gram:] - sums[:-gram]) * words.powers(words.INVERSE, n + 1)[: n - gram + 1])
    span = 1
    while span * 2 <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:last], low[wide - span : wide - span + last])
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[:last]
    valid = at[1:][doc] - np.arange(last) >= window
    new = np.ones(last, bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, last))
    size, first = size[valid[first]], first[valid[first]]
    if (size > unit.most).any():  # text that repeats itself
        parts = -(-size // unit.most)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, size = np.repeat(first, parts) + step * unit.most, np.minimum(np.repeat(size, parts) - step * unit.most, unit.most)
    # Text that repeats itself within a window has its gram several times in one piece.
    least, code = np.unique(low[first], return_inverse=True)
    near = np.flatnonzero(hashes <= (least[-1] if len(least) else 0))
    slot = np.minimum(np.searchsorted(least, hashes[near]), max(0, len(least) - 1))
    near, slot = (x[least[slot] == hashes[near]] for x in (near, slot)) if len(least) else (near, slot)
    places = np.sort(slot * n + near)
    times = np.searchsorted(places, code * n + first + size + wide - 1) - np.searchsorted(places, code * n + first)
    view, digest, k = memoryview(symbols.tobytes()), xxhash.xxh3_64_intdigest, symbols.itemsize
    told = np.fromiter((digest(view[a:b]) for a, b in zip((first * k).tolist(), ((first + size + window - 1) * k).tolist())), _U, len(first))
    return doc[first], first - at[:-1][doc[first]], size, times, low[first].view(np.int64), told.view(np.int64)


def word_symbols(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and where each text's words start."""
    start, end, _ = words.find(raw, at)
    return words.ranges(words.prefix(raw), start, end), np.searchsorted(start, at)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of text (whole numbers from 0) in the order of their next `depth` symbols (or more), which end before all else."""
    n = len(text)
    bits = int(text.max(initial=0) + 1).bit_length()
    many = 64 // bits
    pad = np.concatenate([text.astype(_U) + _U(1), np.zeros(many, _U)])
    key = np.zeros(n, _U)
    for k in range(many):
        key = (key << _U(bits)) | pad[k : k + n]
    order = np.argsort(key)
    head = np.ones(n, bool)
    head[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    # a group's rank is the place of its first member, so refining a group leaves other ranks alone
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = many
    while h < depth:
        lone = head.copy()
        lone[:-1] &= head[1:]
        open_ = np.flatnonzero(~lone)
        if not len(open_):
            break
        at = order[open_]
        ahead = at + h
        # group and the group that follows in one number
        then = rank[at] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        move = np.argsort(then)
        at, then = at[move], then[move]
        order[open_] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = then[1:] != then[:-1]
        head[open_] = fresh
        rank[at] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        h *= 2
    return order


def common_prefixes(text: np.ndarray, before: np.ndarray, position: np.ndarray, most: int, every: int = 32) -> np.ndarray:
    """Common prefix, at most `most`, of the texts at position[i] and before[i]; position ascends.

    Kasai: the prefix at the next position is at most one shorter. So each `every`-th position is compared from
    the start, and those between them from what that leaves.
    """
    pad = np.concatenate([text, np.zeros(most + 8, text.dtype)])

    def extend(i: np.ndarray, have: np.ndarray) -> np.ndarray:
        have, going = have.copy(), np.arange(len(i))
        while len(going):
            p, q, h = position[i[going]], before[i[going]], have[going]
            same, more = np.ones(len(going), bool), np.zeros(len(going), np.int64)
            for k in range(8):
                same &= pad[p + h + k] == pad[q + h + k]
                more += same
            have[going] = np.minimum(h + more, most)
            going = going[same & (have[going] < most)]
        return have

    n = len(position)
    out = np.zeros(n, np.int64)
    mark = np.arange(0, n, every)
    out[mark] = extend(mark, np.zeros(len(mark), np.int64))
    rest = np.flatnonzero(np.arange(n) % every)
    if len(rest):
        base = rest - rest % every
        bound = np.maximum(out[base] - (position[rest] - position[base]), 0)
        # The bound holds for whole suffixes; ours are cut at `most` and leave out the ends of parts, so it is checked.
        sums, p, q = words.sums(values(pad)), position[rest], before[rest]
        holds = words.ranges(sums, p, p + bound) == words.ranges(sums, q, q + bound)
        out[rest] = extend(rest, np.where(holds, bound, 0))
    return out


def repeated(text: np.ndarray, size: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of parts of these sizes laid end to end in text: valid window starts in suffix order, class of equal windows, part of each."""
    end = np.cumsum(size)
    part = np.repeat(np.arange(len(size)), size)
    order = suffix_order(text, window)
    order = order[end[part[order]] - order >= window]
    if not len(order):
        return order, order, order
    before = np.empty(len(text), np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    position = np.sort(order[1:])
    prefix = np.zeros(len(text), np.int64)
    prefix[position] = common_prefixes(text, before[position], position, window)
    new = prefix[order] < window
    new[0] = True
    return order, np.cumsum(new) - 1, part[order]


def runs(flag: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true flags, none over two parts."""
    edge = np.flatnonzero(flag)
    if not len(edge):
        return edge, edge
    new = np.ones(len(edge), bool)
    new[1:] = (np.diff(edge) > 1) | (part[edge[1:]] != part[edge[:-1]])
    first = np.flatnonzero(new)
    return edge[first], edge[np.append(first[1:], len(edge)) - 1] + 1


def repeats_in_shard(group: pa.Table, units: tuple[Unit, ...]) -> pa.Table:
    """Ranges of a shard's windows that repeat in it, by piece (w1 null); of split grams also each class of equal windows once."""
    settle(__name__)
    group = group.combine_chunks()
    unit = units[group["unit"][0].as_py()]
    count, split = group["c"].to_numpy(), group["split"].to_numpy(zero_copy_only=False)
    cells = group["piece"].to_pylist()
    raw = np.frombuffer(b"".join(cells), np.uint8 if unit.wide == 1 else _U)
    size = np.fromiter(map(len, cells), np.int64, len(cells)) // unit.wide
    text = raw if unit.wide == 1 else np.unique(raw, return_inverse=True)[1]
    order, kind, part = repeated(text, size, unit.window)
    start = np.cumsum(size) - size
    weight = np.bincount(kind, count[part]) if len(kind) else np.zeros(1)
    flag = np.zeros(len(text), bool)
    flag[order] = weight[kind] > 1 if len(kind) else False
    a, b = runs(flag, np.repeat(np.arange(len(size)), size))
    own = np.searchsorted(start, a, "right") - 1
    out = [_found(group, own, a - start[own], b - start[own], None, None, np.ones(len(a), bool))]
    one = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(kind) else kind
    one = one[split[part[one]]]
    if len(one):
        p, i = order[one], part[one]
        told = [words.ranges(words.sums(v), p, p + unit.window).view(np.int64) for v in (values(raw), words.mix(values(raw) + _U(words.BASE)))]
        out.append(_found(group, i, p - start[i], p - start[i] + 1, *told, weight[kind[one]] == 1))
    return pa.concat_tables(out)


_FOUND = "unit int, shard long, gram long, digest long, a long, b long, w1 long, w2 long, own boolean"


def _found(group: pa.Table, i: np.ndarray, a: np.ndarray, b: np.ndarray, w1: np.ndarray | None, w2: np.ndarray | None, own: np.ndarray) -> pa.Table:
    none = pa.nulls(len(i), pa.int64())
    cols = [group[c].take(pa.array(i)) for c in ("unit", "shard", "gram", "digest")]
    cols += [pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(none if w is None else pa.array(w, pa.int64()) for w in (w1, w2)), pa.array(own)]
    return pa.table(cols, names=[c.split()[0] for c in _FOUND.split(", ")])


def merged(arrays: list[np.ndarray]) -> np.ndarray:
    """What is in several of these ordered arrays (each without repeats), by searching one in another, pair by pair."""
    state = [(x, np.zeros(len(x), bool)) for x in arrays]
    while len(state) > 1:
        after = []
        for k in range(0, len(state) - 1, 2):
            (a, hit), (b, hit_b) = sorted(state[k : k + 2], key=lambda s: -len(s[0]))
            at = np.searchsorted(a, b)
            same = at < len(a)
            same[same] = a[at[same]] == b[same]
            hit = hit.copy()
            hit[at[same]] = True
            after.append((np.insert(a, at[~same], b[~same]), np.insert(hit, at[~same], hit_b[~same])))
        state = [*after, *state[len(state) // 2 * 2 :]]
    return state[0][0][state[0][1]] if state else np.zeros(0, np.int64)


def repeats_across(group: pa.Table) -> pa.Table:
    """Single windows of a range of digests that another shard has too."""
    settle(__name__)
    group = group.combine_chunks()
    (u1, k1), (u2, k2) = (np.unique(group[c].to_numpy(), return_inverse=True) for c in ("w1", "w2"))
    key, shard = k1 * len(u2) + k2, group["shard"].to_numpy()  # a number for each digest, exact
    order = np.lexsort((key, shard))
    edge = np.flatnonzero(np.diff(shard[order])) + 1
    many = merged(np.split(key[order], edge))
    at = np.minimum(np.searchsorted(many, key), max(0, len(many) - 1))
    again = many[at] == key if len(many) else np.zeros(len(key), bool)
    keep = np.flatnonzero(again & group["own"].to_numpy(zero_copy_only=False))
    return group.select(["unit", "gram", "digest", "a", "b"]).take(pa.array(keep))


_PIECE = ["t1", "t2", "unit", "s", "n", "times", "gram", "digest"]


def _symbols(raw: np.ndarray, at: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    return (raw, at) if unit.wide == 1 else word_symbols(raw, at)


def _find(texts: DataFrame, units: tuple[Unit, ...]) -> DataFrame:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw, at = as_bytes(part.column("text"))
                for k, unit in enumerate(units):
                    doc, s, n, times, gram, digest = pieces(*_symbols(raw, at, unit), unit)
                    own = [part.column(c).to_numpy()[doc] for c in ("t1", "t2")]
                    # grams of units are apart, so that nothing else has to keep them so
                    yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in own], pa.array(np.full(len(doc), k), pa.int32()), *[pa.array(x, pa.int64()) for x in (s, n, times, gram ^ k, digest)]], _PIECE)

    return map_arrow(texts.select("t1", "t2", "text"), apply, "t1 long, t2 long, unit int, s long, n long, times long, gram long, digest long")


_LAID = "unit int, gram long, digest long, c long, bytes long, piece binary"


def _lay(wanted: DataFrame, units: tuple[Unit, ...]) -> DataFrame:
    """The symbols of each wanted piece (rows: a text and the array `want` of its pieces)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw, at = as_bytes(part.column("text"))
                lists = part.column("want")
                flat = lists.flatten()
                col = {c: flat.field(c).to_numpy() for c in ("unit", "s", "n", "gram", "digest", "c", "bytes")}
                doc = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy())
                for k, unit in enumerate(units):
                    pick = np.flatnonzero(col["unit"] == k)
                    if not len(pick):
                        continue
                    symbols, edge = _symbols(raw, at, unit)
                    first = (edge[doc[pick]] + col["s"][pick]) * unit.wide
                    last = first + (col["n"][pick] + unit.window - 1) * unit.wide
                    view = symbols.tobytes()
                    for a in range(0, len(pick), 4096):
                        own = pick[a : a + 4096]
                        cells = [view[x:y] for x, y in zip(first[a : a + 4096].tolist(), last[a : a + 4096].tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(col["unit"][own], pa.int32()), *[pa.array(col[c][own], pa.int64()) for c in ("gram", "digest", "c", "bytes")], pa.array(cells, pa.binary())], [c.split()[0] for c in _LAID.split(", ")])

    return map_arrow(wanted.select("text", "want"), apply, _LAID)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(17), text, F.octet_length(text)).alias("t2"))


def _of(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """t1, t2 and text of the texts with these keys, one row each. Keys are sent to all tasks if they are counted to be few, so that other texts stay where they are."""
    if keys.limit(KEYS + 1).count() <= KEYS:
        texts = texts.join(F.broadcast(keys.select("t1").distinct()), "t1", "left_semi")
    else:
        texts = texts.join(keys, ["t1", "t2"], "left_semi")
    return texts.groupBy("t1", "t2").agg(F.first("text").alias("text"))


class Repeats(NamedTuple):
    """texts: t1, t2 and text of those with a repeated gram. ranges: t1, t2 and, by unit, ranges of starts of repeated windows. across: windows that merging has found."""

    texts: DataFrame
    ranges: DataFrame
    across: DataFrame


def repeats(docs: DataFrame, units: tuple[Unit, ...] = UNITS, shard: int = SHARD, split: int = SPLIT) -> Repeats:
    spark = docs.sparkSession
    texts = _keyed(docs)
    found = materialize(_find(texts, units), "pieces")
    release(spark)
    by_unit = lambda f: F.element_at(F.array(*[F.lit(f(u)) for u in units]), F.col("unit") + 1)
    size = (F.col("n") + by_unit(lambda u: u.window) - 1) * by_unit(lambda u: u.wide)
    counted = found.groupBy("unit", "gram", "digest").agg(F.sum("times").alias("c"), F.max(size).alias("size"))
    grams = counted.groupBy("unit", "gram").agg(F.sum("c").alias("all"), F.sum("size").alias("bytes"))
    wanted = materialize(grams.filter("all > 1").select("gram", "bytes"), "grams")
    release(spark)
    hits = materialize(found.drop("times").join(wanted, "gram"), "hits")
    discard(found, wanted)
    release(spark)
    kinds = hits.groupBy("unit", "gram", "digest").agg(F.count("*").alias("c"), F.min(F.struct("t1", "t2", "s", "n", "bytes")).alias("x"))
    kinds = materialize(kinds.select("unit", "gram", "digest", "c", "x.*"), "kinds")
    release(spark)
    own = materialize(_of(texts, materialize(hits.select("t1", "t2").distinct(), "keys")), "texts")
    want = kinds.groupBy("t1", "t2").agg(F.collect_list(F.struct("unit", "s", "n", "gram", "digest", "c", "bytes")).alias("want"))
    laid = materialize(_lay(own.join(want, ["t1", "t2"]), units), "laid")
    discard(kinds)
    release(spark)
    total = laid.groupBy("unit").agg(F.sum(F.length("piece")).alias("b")).agg(F.max("b")).first()[0] or 0
    shards = max(1, math.ceil(total / shard))
    # A gram of over `split` bytes is dealt over as many shards as it needs, by its pieces' digests.
    spread = F.when(F.col("split"), F.pmod(F.xxhash64("digest"), F.ceil(F.col("bytes") / split))).otherwise(F.lit(-1))
    dealt = laid.withColumn("split", F.col("bytes") > split).withColumn("shard", F.pmod(F.xxhash64("gram", spread), F.lit(shards)).cast("long")).drop("bytes")

    def sort_shard(group: pa.Table) -> pa.Table:
        return repeats_in_shard(group, units)

    ordered = materialize(dealt.groupBy("unit", "shard").applyInArrow(sort_shard, _FOUND), "ordered")
    discard(laid)
    release(spark)
    inner = ordered.filter("w1 IS NULL").select("unit", "gram", "digest", "a", "b")
    sent = ordered.filter("w1 IS NOT NULL")
    parts = max(1, math.ceil(sent.count() / RANGE))
    across = sent.withColumn("range", F.pmod("w1", F.lit(parts))).groupBy("range").applyInArrow(repeats_across, "unit int, gram long, digest long, a long, b long")
    across = materialize(across, "across")
    # Many ranges of one piece are one row before they meet its occurrences.
    by_piece = inner.union(across).groupBy("gram", "digest").agg(F.collect_list(F.struct("a", "b")).alias("r"))
    every = hits.join(by_piece, ["gram", "digest"]).select("t1", "t2", "unit", F.transform("r", lambda x: F.struct((x.a + F.col("s")).alias("s"), (x.b + F.col("s")).alias("e"))).alias("r"))
    ranges = materialize(every.groupBy("t1", "t2", "unit").agg(F.flatten(F.collect_list("r")).alias("r")), "ranges")
    release(spark)
    return Repeats(own, ranges, across)


def united(ranges: list[dict], window: int) -> list[tuple[int, int]]:
    """Maximal runs of symbols that windows starting in these ranges cover."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"] + window - 1) for x in ranges):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def _cut(rows: DataFrame, keep: list[T.StructField], units: tuple[Unit, ...], with_text: bool = False) -> DataFrame:
    """keep, and per text (with r0, r1 .., the ranges by unit) n_removed, n_spans, kept_sha256, then n_covered and n_passages of each further unit."""
    more = [f"{c}{k}" for k in range(1, len(units)) for c in ("n_covered", "n_passages")]
    schema = T.StructType([*keep, *[T.StructField(x, T.LongType()) for x in ("n_removed", "n_spans", *more)], T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept", T.BinaryType())] if with_text else [])])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw, at = as_bytes(part.column("text"))
                raw, numbers, sha, kept = raw.tobytes(), [], [], []
                given = [part.column(f"r{k}").to_pylist() for k in range(len(units))]
                for i in range(len(part)):
                    spans = [united(r[i] or [], u.window) for r, u in zip(given, units)]
                    numbers.append([x for s in spans for x in (sum(b - a for a, b in s), len(s))])
                    text, edge = raw[at[i] : at[i + 1]], [0, *[x for s in spans[0] for x in s], int(at[i + 1] - at[i])]
                    left = b"".join(text[a:b] for a, b in zip(edge[::2], edge[1::2]))
                    sha.append(hashlib.sha256(left).hexdigest())
                    kept.append(left if with_text else b"")
                cols = [pa.array(c, pa.int64()) for c in zip(*numbers)] if numbers else [pa.array([], pa.int64())] * (2 * len(units))
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in keep], *cols, pa.array(sha, pa.string()), *([pa.array(kept, pa.binary())] if with_text else [])], schema.fieldNames())

    return map_arrow(rows, apply, schema)


def _ranges(found: Repeats, units: tuple[Unit, ...]) -> DataFrame:
    return found.ranges.groupBy("t1", "t2").agg(*[F.first(F.when(F.col("unit") == k, F.col("r")), ignorenulls=True).alias(f"r{k}") for k in range(len(units))])


def remove(docs: DataFrame, units: tuple[Unit, ...] = UNITS, shard: int = SHARD, split: int = SPLIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document; n_covered1 and n_passages1 are words and runs of them in repeated passages (the second unit)."""
    found = repeats(docs, units, shard, split)
    rows = found.texts.join(_ranges(found, units), ["t1", "t2"])
    keep = [T.StructField(f"_{t}", T.LongType()) for t in ("t1", "t2")]
    cut = _cut(rows.withColumnsRenamed({"t1": "_t1", "t2": "_t2"}), keep, units).withColumnRenamed("kept_sha256", "_sha")
    whole = _keyed(docs).select("doc_id", "t1", "t2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    out = whole.join(cut, (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_removed", "n_spans")]
    more = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in cut.columns if c.startswith(("n_covered", "n_passages"))]
    return out.select("doc_id", "n_bytes", *numbers, F.coalesce("_sha", "whole").alias("kept_sha256"), *more)


def cleaned(docs: DataFrame, units: tuple[Unit, ...] = UNITS, shard: int = SHARD, split: int = SPLIT) -> DataFrame:
    """As remove(), with kept, the bytes that are left. All texts are shuffled for it."""
    found = repeats(docs, units, shard, split)
    rows = _keyed(docs).join(_ranges(found, units), ["t1", "t2"], "left").withColumn("n_bytes", F.octet_length("text").cast("long"))
    return _cut(rows.drop("t1", "t2"), [docs.schema["doc_id"], T.StructField("n_bytes", T.LongType())], units, with_text=True)


def query(spark, sf_dir: str) -> DataFrame:
    out = remove(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.withColumnsRenamed({"n_covered1": "n_passage_words", "n_passages1": "n_passages"})
