import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import public_tokenizers as public
from causeway.llm import _components, bpe, language_id, mixing, pii, quality_classifier, quality_rules, simhash, suffix_dedup, token_files, topk_search

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty, blank and long texts, ties and repeated rows.
HARD = [
    (1, None, None, None, None), (None, "some words here", "en", "s1", 15), (2, "", "en", "s1", 0), (3, " \t\n ", None, "s2", 4),
    (4, "The same text twice. " * 40, "en", "s1", 840), (5, "The same text twice. " * 40, "en", "s2", 840), (6, "word " * 30_000, "de", "s2", 150_000),
    (7, "x" * 60_000, "fr", None, 60_000), (8, "é" * 500 + " 日本語 😀 don't", "fr", "s3", 514), (8, "é" * 500 + " 日本語 😀 don't", "fr", "s3", 514),
    (9, "mail a.b@c.example.org or +1 (555) 123-4567 from 10.0.0.1, card 4111 1111 1111 1111", "en", "s3", 90),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").persist()


def none(spark):
    return spark.createDataFrame([], DOCS)


# -- mixing


def brute_mix(rows):
    """Targets and taken words of (doc_id, text, source) rows, by sorting."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    per = Counter()
    for (_, _, s), n in zip(rows, size):
        per[s] += n
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    goal, left, pot = {}, set(order), 1.5 * sum(per.values())
    while left:
        level = pot / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] >= 2 * per[s]}
        for s in full or left:
            goal[s] = 2.0 * per[s] if full else level * weight[s]
        pot -= sum(goal[s] for s in full)
        left -= full or left
    out = []
    for s in order:
        def key(k):
            i, t, _ = rows[k]
            code = hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()
            alike[code] += 1
            if alike[code] > 1:
                code = hashlib.md5(f"{code}:{alike[code] - 1}".encode()).hexdigest()
            u = (int(code[:13], 16) + 0.5) / 2**52
            n, c = size[k], len(t or "")
            w = (1.0 if 50 <= n <= 100_000 else 0.5) * (1.0 if n and 3 <= c / n <= 12 else 0.5) * (1.0 if 10 * sum(x in "#*$%&|<>{}" for x in t or "") <= n else 0.5)
            return -math.log(u) / max(0.25, w)

        alike = Counter()
        epochs = int(goal[s] // per[s]) if per[s] else 0
        budget, before = goal[s] - epochs * per[s], 0
        for _, k in sorted((key(k), k) for k in range(len(rows)) if rows[k][2] == s):
            extra = 1 if 2 * before + size[k] <= 2 * budget and budget > 0 else 0
            out.append((rows[k][0], size[k], per[s], round(goal[s], 6), size[k] * (epochs + extra)))
            before += size[k]
    return sorted(out, key=repr)


@pytest.mark.parametrize("which", ["hard", "docs"])
def test_mixing_equals_brute_force(request, which):
    d = request.getfixturevalue(which)
    got = sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(d).collect()), key=repr)
    assert got == brute_mix([(r.doc_id, r.text, r.source) for r in d.collect()])
    thin = sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(d, thin=True).collect()), key=repr)
    assert thin == got


@pytest.mark.parametrize("block", [100_000, 7])
def test_rows_alike_draw_apart(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rows = [(None, "a b c d e " * 20, "s1")] * 50 + [(k, "x y z " * (k + 1), "s2") for k in range(40)] + [(3, "one two three", "s2")] * 7 + [(9, None, None), (9, "", None), (1, "q w", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    want = brute_mix(rows)
    for thin in (True, False):
        got = mixing.mix(d, thin=thin).collect()
        assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got), key=repr) == want
    hot = [r for r in got if r.source == "s1"]
    assert abs(sum(r.taken for r in hot) - hot[0].target) <= hot[0].size / 2
    weighed = mixing.mix(d.selectExpr("*", "0.5 AS w"), quality="w").collect()
    assert sum(r.taken for r in weighed if r.source == "s1") == sum(r.taken for r in hot)


def test_mixture_repeats_rows_and_keeps_odd_columns(spark, docs):
    clash = docs.selectExpr("*", "1 AS size", "2 AS slot", "3 AS _key", "4 AS taken", "5 AS cut", "6 AS _row")
    got = mixing.mixture(clash)
    assert got.columns == clash.columns
    assert got.count() == sum(r.taken // r.size for r in mixing.mix(docs).collect() if r.size)
    assert mixing.mix(none(spark)).count() == 0


# -- suffix arrays


def brute_repeats(texts, window, words):
    raw = [(t or "").encode() for t in texts]

    def covered(strings, window):
        seen = Counter(x[i : i + window] for x in strings for i in range(len(x) - window + 1))
        for x in strings:
            gone = np.zeros(len(x), bool)
            for i in range(len(x) - window + 1):
                if seen[x[i : i + window]] > 1:
                    gone[i : i + window] = True
            yield gone, int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))

    out = []
    for b, (gone, n, spans), (_, w, passages) in zip(raw, covered(raw, window), covered([tuple(re.findall(rb"[^\x20\x09-\x0D]+", b)) for b in raw], words)):
        out.append((len(b), n, spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest(), w, passages))
    return out


def units(window, gram, words=8):
    return suffix_dedup.Unit(window, gram, 64, 1), suffix_dedup.Unit(words, 3, 16, 8)


def windows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("window,gram,shard,split", [(40, 16, 2_000_000, 4000), (40, 16, 300, 100), (60, 20, 500, 10_000)])
def test_removal_equals_brute_force(spark, window, gram, shard, split):
    rnd = random.Random(window + shard)
    word = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    passages = [word(rnd.randint(20, 120)) for _ in range(4)]
    texts = [None, "", "ab" * 200, "a b " * 90]
    for _ in range(80):
        texts.append(word(rnd.randint(0, 120)) + (rnd.choice(passages) if rnd.random() < 0.6 else "") + word(rnd.randint(0, 120)))
    texts += texts[:20]
    d = windows(spark, texts).selectExpr("*", "1 AS t1", "2 AS unit", "3 AS r0", "4 AS n_bytes")
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.remove(d, units(window, gram), shard, split).collect()}
    want = brute_repeats(texts, window, 8)
    assert [got[i] for i in range(len(texts))] == want
    left = {r.doc_id: hashlib.sha256(r.kept).hexdigest() for r in suffix_dedup.cleaned(d, units(window, gram), shard, split).collect()}
    assert [left[i] for i in range(len(texts))] == [w[3] for w in want]


def test_windows_are_found_by_every_path(spark):
    """Shards find repeats, and merging finds what no shard sees; the split is that of production, shards are small."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 200").select("doc_id", "text")
    rnd = random.Random(4)
    line = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    passage = line(90)
    texts = [r.text for r in d.collect()] + [f"{line(40)} {passage} {line(40)}" for _ in range(60)]
    # the start of the passage, and a longer one than any other row has, are in two rows each, that need not share a shard
    head, tail = line(60), line(60)
    texts += [f"{line(9)} {head} {passage} {tail} {line(9)}" for _ in range(2)]
    found = suffix_dedup.repeats(windows(spark, texts), shard=20_000)
    by = {r.unit: r["count"] for r in found.across.groupBy("unit").count().collect()}
    assert by[0] > 0 and by[1] > 0, by
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove(windows(spark, texts), shard=20_000).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 400, 51)
    total = sum(r.n for r in found.ranges.selectExpr("aggregate(r, 0L, (s, x) -> s + x.e - x.s) AS n").collect())
    assert total > 20 * sum(by.values())  # shards find most


def test_passages_of_short_words_are_found(spark):
    passage = " ".join(f"{chr(97 + k % 26)}{k % 10}" for k in range(51))
    assert len(passage) < 400
    texts = [f"x{k} y {passage} z{k}" for k in range(3)] + [passage.rsplit(" ", 1)[0] + " other"]
    got = sorted(tuple(r)[1:] for r in suffix_dedup.remove(windows(spark, texts)).collect())
    assert got == sorted(brute_repeats(texts, 400, 51)) and sorted((r[1], r[4], r[5]) for r in got) == [(0, 0, 0), (0, 52, 1), (0, 52, 1), (0, 52, 1)]  # y and the passage


def test_merging_of_ordered_arrays():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 5, 9):
        arrays = [np.unique(rng.integers(0, 60, rng.integers(0, 30))) for _ in range(n)]
        count = Counter(x for a in arrays for x in a.tolist())
        assert suffix_dedup.merged(arrays).tolist() == sorted(x for x, c in count.items() if c > 1)


def test_removal_of_hard_rows(spark, hard):
    got = sorted((tuple(r) for r in suffix_dedup.remove(hard).collect()), key=repr)
    rows = hard.collect()
    assert got == sorted(((r.doc_id, *b) for r, b in zip(rows, brute_repeats([r.text for r in rows], 400, 51))), key=repr)
    assert suffix_dedup.remove(none(spark)).count() == 0


def test_suffix_order():
    rnd = random.Random(3)
    for _ in range(60):
        raw = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 150)))
        for depth in (3, 30):
            order = suffix_dedup.suffix_order(np.frombuffer(raw, np.uint8), depth)
            keys = [raw[i : i + depth] for i in order]
            assert keys == sorted(keys) and sorted(order) == list(range(len(raw)))


# -- language identification


def brute_cost(sample: list[bytes], text: bytes) -> float:
    """Code length by counting contexts in dictionaries."""
    order, counts = language_id.ORDER, {}
    for raw in sample:
        pad = bytes(order) + raw
        for i in range(order, len(pad)):
            for k in range(order + 1):
                counts.setdefault(pad[i - k : i], Counter())[pad[i]] += 1
    total, pad = 0.0, bytes(order) + text
    for i in range(order, len(pad)):
        for k in range(order, -1, -1):
            c = counts.get(pad[i - k : i])
            if c is None:
                continue
            n, d = sum(c.values()), len(c)
            if pad[i] in c:
                total += np.log2((n + d) / c[pad[i]])
                break
            total += np.log2((n + d) / d)
        else:
            total += 8
    return total


def test_code_lengths_equal_brute_force():
    samples = {"en": ["the cat sat on the mat", "then there were three"], "xx": ["zzy zyz yyz zzz"]}
    langs, trees = language_id.learn(samples)
    texts = ["the mat", "", "zyzzy", "qqq é", "a"]
    raw, at = language_id.as_bytes(pa.array(texts))
    got = language_id.Scorer(trees).lengths(raw, at)
    for i, t in enumerate(texts):
        for j, lang in enumerate(langs):
            assert got[i, j] == pytest.approx(brute_cost([x.encode() for x in samples[lang]], t.encode()), rel=1e-5)


def test_language_accuracy_and_hard_rows(spark, docs, hard):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    got = language_id.identify(hard).collect()
    assert len(got) == len(HARD) and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert all(0 <= r.score <= 1 for r in got)
    assert language_id.identify(none(spark)).count() == 0
    assert {r.lang_pred for r in language_id.identify(hard.withColumn("lang", hard.lang.substr(9, 1).cast("string")).selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_language_fit_holds_out_and_learns_long_texts(spark):
    """Held-out rows teach nothing; a language with long texts only is learned; odd columns change nothing."""
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, f"the quick brown fox and then some {i} " * 9, "en" if i not in held else "zz", "s", 0) for i in range(300)]
    rows += [(400 + i, "der schnelle braune fuchs und noch mehr davon " * 20_000, "de", "s", 0) for i in range(8)]  # 0.9 MB each
    d = spark.createDataFrame(rows, DOCS)
    langs, trees = language_id.fit(d)
    assert langs == ["de", "en"]
    assert len(trees[0].grams[0][0]) and int(trees[0].grams[0][1].sum()) >= 900_000
    got = language_id.identify(d.selectExpr("*", "1 AS share", "2 AS u", "3 AS code", "4 AS score", "'x' AS lang_pred")).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id >= 400} == {"de"} and {r.lang_pred for r in got if r.doc_id < 300} == {"en"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


# -- token files


def test_coder_round_trip_and_damage():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.geometric(0.01, 70_000), 50_000).astype(np.int32)
    table = token_files.Frequencies(*np.unique(ids, return_counts=True))
    for n in (1, 2, 31, 33, 1000, 70_000):
        raw = token_files.write_block([None, 5, "é"], np.array([0, n - 1, 1]), ids[:n], 9, table, every=8)
        block = token_files.Block(raw, table)
        assert block.doc_ids == [None, 5, "é"] and (block.ids() == ids[:n]).all() and block.before == 9
        for _ in range(20):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert (block.ids(a, b) == ids[a:b]).all()
    for place in (-5, 0, 5, 30, 60):
        broken = bytearray(raw)
        broken[place] ^= 1
        with pytest.raises(ValueError):
            token_files.Block(bytes(broken), table).ids()
    with pytest.raises(ValueError):
        token_files.Block(raw[: len(raw) // 2], table).ids()
    with pytest.raises(ValueError):
        token_files.Block(raw, token_files.Frequencies(np.array([1]), np.array([2])))
    with pytest.raises(ValueError):
        token_files.Frequencies.stored(table.ids, table.part + np.uint64(1), table.bits, table.crc)


def test_a_reader_starts_at_the_last_checkpoint(monkeypatch):
    ids = np.arange(40_000, dtype=np.int32) % 300
    table = token_files.Frequencies(*np.unique(ids, return_counts=True))
    raw = bytearray(token_files.write_block([1], np.array([len(ids)]), ids, 0, table, lanes=64, every=4))
    at = token_files.Block(bytes(raw), table)
    raw[-1 - 4 * int(at.marks["word"][1] // 2)] ^= 255  # some word of the first or last checkpoints
    block = token_files.Block(bytes(raw), table)
    good = 0
    for a in range(0, len(ids), 256):
        try:
            good += (block.ids(a, a + 256) == ids[a : a + 256]).all()
        except ValueError:
            pass
    assert good == len(ids) // 256 + 1 - 1  # the damage spoils one checkpoint alone


@pytest.mark.parametrize("which", ["hard", "docs", "named"])
def test_token_files_equal_the_library(spark, request, which):
    from tokenizers import Tokenizer

    d = request.getfixturevalue("hard" if which == "named" else which)
    if which == "named":
        d = d.selectExpr("concat('doc é', doc_id) AS doc_id", "text")
    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    where = token_files.write_files(d.selectExpr("doc_id", "text", "1 AS ids", "2 AS tie"))
    read = token_files.read_files(spark, where)
    assert dict(read.dtypes)["doc_id"] == dict(d.dtypes)["doc_id"]
    got = sorted((tuple(r) for r in read.collect()), key=lambda r: r[1])
    rows = {}
    for r in d.collect():
        rows.setdefault(r.doc_id, []).append([*t.encode(r.text or "", add_special_tokens=False).ids, 2])
    at, every = 0, []
    for doc_id, start, n, crc in got:
        ids = next(x for x in rows[doc_id] if zlib.crc32(np.array(x, "<u4").tobytes()) == crc)
        assert (start, n) == (at, len(ids))
        at += n
        every += ids
    order = [g[0] for g in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or (0 if which != "named" else ""))) and len(got) == d.count()
    for first, count in ((0, 5), (at // 2, 1000), (at - 3, 10), (at, 4)):
        parts = sorted(token_files.read_ids(spark, where, first, count).collect())
        assert [i for p in parts for i in p.ids] == every[first : first + count]


def test_token_files_are_read_by_another_process(spark, docs, tmp_path):
    import subprocess
    import sys

    where = token_files.write_files(docs, to=f"file://{tmp_path}/files")
    want = sorted(map(tuple, token_files.read_files(spark, where).collect()))
    code = f"""
from pyspark.sql import SparkSession
from causeway.llm import token_files
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", sorted(map(tuple, token_files.read_files(s, {where!r}).collect())))
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert said.stdout.partition("ROWS ")[2].strip() == repr(want), said.stderr[-2000:]


def test_token_files_of_no_rows(spark):
    where = token_files.write_files(none(spark))
    assert token_files.read_files(spark, where).count() == 0 and token_files.read_ids(spark, where, 0, 9).count() == 0


def test_special_strings_and_odd_characters():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        own = token_files.WordEncoder(f.read(), public.PATTERN)
    rnd = random.Random(1)
    texts = [None, "", "a<|endoftext|>b", "\x1c \x1f x\x0b\x0c", "²½ Ⅷ १२", "   a　b", "don't I'LL", " " * 90 + "x"]
    texts += ["".join(rnd.choice("ab c'd\n\t é²1_ \x1c!日\x0b<>|😀") for _ in range(rnd.randint(0, 50))) for _ in range(400)]
    ids, at = own.encode(pa.array(texts))
    for i, x in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == t.encode(x or "", add_special_tokens=False).ids


# -- SimHash


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    h = np.array(h, np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))


def brute_components(rows, radius=4):
    fp = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fp[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("which,bucket", [("hard", 256), ("docs", 256), ("docs", 2)])
def test_near_duplicates_equal_brute_force(request, which, bucket):
    d = request.getfixturevalue(which)
    got = sorted((tuple(r) for r in simhash.near_duplicates(d, bucket=bucket).collect()), key=repr)
    assert got == brute_components([(r.doc_id, r.text) for r in d.collect()])


def test_covering_guarantee():
    rnd = random.Random(5)
    for free in ((1 << 64) - 1, 0xFFFFFFFF, 0xFFF):
        masks, places = simhash.covering(free), [i for i in range(64) if free >> i & 1]
        for _ in range(300):
            diff = sum(1 << p for p in rnd.sample(places, rnd.randint(1, 4)))
            assert any(not diff & m for m in masks)


def test_no_table_of_few_bits_compares_nothing():
    for n in range(5, 31):
        assert all(simhash.covering((1 << n) - 1)), n


def test_split_buckets_lose_no_link(spark):
    """Pairs four bits apart in what two tables leave free, many in a bucket, any other two fingerprints further apart."""
    rnd, bound = random.Random(5), simhash.covering((1 << 64) - 1)[0]
    bound |= simhash.covering(((1 << 64) - 1) & ~bound)[0]
    places = [i for i in range(64) if not bound >> i & 1]
    word = lambda bits: sum(1 << p for p in bits)
    pairs = [(0, word((3, 7, 15, 32)))] if {3, 7, 15, 32} <= set(places) else []
    for _ in range(4000):
        a = word(p for p in places if rnd.random() < 0.5)
        b = a ^ word(rnd.sample(places, 4))
        if all((x ^ y).bit_count() > 4 for x in (a, b) for pair in pairs for y in pair):
            pairs.append((a, b))
    heads = [rnd.getrandbits(64) & bound for _ in range(40)]
    fps = [simhash.signed(h | x) for h in heads for pair in pairs for x in pair]
    x = np.array(fps, np.int64)
    i, j = np.nonzero(np.triu(np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= 4, 1))
    want = {frozenset((fps[a], fps[b])) for a, b in zip(i, j)}
    assert len(pairs) > 8 and len(fps) > 1000 and len(want) == len(fps) // 2
    d = spark.createDataFrame([(f,) for f in fps], "fp long")
    assert {frozenset((r.a, r.b)) for r in simhash.links(d, bucket=2).collect()} == want


def test_deduplicate(spark, docs, hard):
    kept = {r.doc_id for r in simhash.deduplicate(docs).collect()}
    assert kept == {c for _, _, c in brute_components([(r.doc_id, r.text) for r in docs.collect()])}
    clash = hard.selectExpr("*", "1 AS _id", "2 AS _code", "3 AS component_id", "4 AS _row")
    got = simhash.deduplicate(clash)
    assert got.columns == clash.columns and got.count() == len({c for _, _, c in brute_components([(r.doc_id, r.text) for r in hard.collect()])})
    assert simhash.deduplicate(none(spark)).count() == 0


def test_deduplicate_tells_rows_apart_by_more_than_their_id(spark):
    rnd = random.Random(9)
    text = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(30))
    same = text()
    rows = [(i, text()) for i in (None, None, None, 5, 5, 6)] + [(7, same), (None, same), (6, same), (6, same)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "map('a', doc_id) AS m", "1 AS fp", "2 AS file", "3 AS at")
    got = simhash.deduplicate(d)
    assert got.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([*rows[:6], (6, same)], key=repr)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.root for r in _components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}}


# -- top-k


def brute_search(rows, k=20):
    use = [(i, [math.floor(64 * float(a)) for a in x]) for i, x in rows if x is not None and all(a is not None and math.isfinite(a) for a in x)]
    out = []
    for r, (i, q) in enumerate(use):
        if i is not None and i % 20 == 0:
            end = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
            scored = [(-end(sum(a * b for a, b in zip(q, c))), j is None, j or 0) for s, (j, c) in enumerate(use) if s != r]
            out += [(i, n + 1, None if gone else j, -s) for n, (s, gone, j) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("held,large", [(2_000_000, False), (2000, False), (2000, True)])
def test_search_equals_brute_force(spark, monkeypatch, held, large):
    monkeypatch.setattr(topk_search, "HELD", held)
    rng = np.random.default_rng(1)
    v = [(int(i), rng.normal(size=24).round(1).tolist()) for i in range(400)]
    v += [(400, None), (401, [None] * 24), (402, [float("nan")] * 24), (403, [1.0]), (None, [1.0] * 24), (None, [1.0] * 24), (404, v[0][1]), (5, v[5][1]), (420, [float("inf")] * 24)]
    v += [(20, v[20][1]), (20, v[21][1]), (40, v[40][1])]  # rows that share an id, and repeated rows
    if large:
        v += [(440 + i, (rng.normal(size=24) * 10.0 ** rng.integers(5, 37)).tolist()) for i in range(40)]
        v += [(500, [3e38] * 24), (500, [-3e38] * 24), (501, [3e38] * 24), (60, [2.0**30 + 1] * 24), (61, [2.0**30] * 24)]
    v = [(i, None if x is None else [None if a is None else float(np.float32(a)) for a in x]) for i, x in v]
    d = spark.createDataFrame(v, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS v", "3 AS row", "4 AS floor")
    q = topk_search.materialize(topk_search.quantised(d), "vectors")
    got = sorted(map(tuple, topk_search.search(q.filter("vec_id % 20 = 0"), q).collect()), key=repr)
    assert got == brute_search(v)
    assert topk_search.search(q.limit(0), q.limit(0)).count() == 0
    few = q.filter("vec_id < 4")
    assert topk_search.search(few.filter("vec_id = 0"), few).count() == 3


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    a, b = rng.integers(-50, 50, (30, 10)).astype(float), rng.integers(-50, 50, (40, 10)).astype(float)
    for share in (0.1, 0.3, 0.5, 0.8, 1.0):
        start = topk_search.cuts(10, share)
        assert start[0] == 0 and (np.diff(start) > 0).all() and start[-1] < 10
        assert (topk_search.statistics(a, start) @ topk_search.statistics(b, start).T >= a @ b.T - 1e-6).all()
    x = rng.normal(size=(5000, 64))
    x = np.floor(64 * x / np.linalg.norm(x, axis=1, keepdims=True))
    left = topk_search.shares(x[::50], x)
    assert left == sorted(left, reverse=True) and left[-1] < 0.2  # vectors without any order: the last level alone prunes


# -- quality


def test_classifier(spark, hard):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classifier.scored(d, labels, carry=[]).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 40 and np.mean([r.predicted == r.quality for r in rows]) > 0.93
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    got = quality_classifier.scored(hard.selectExpr("*", "1 AS score", "'x' AS predicted"), labels)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "held_out", "score", "predicted"] and got.count() == len(HARD)
    no_labels = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_classifier.scored(hard, no_labels).collect()} == {0.5}
    assert quality_classifier.scored(none(spark), labels).count() == 0


def brute_ftrl(bags, labels, epochs):
    """Follow the regularised leader, a feature at a time, in dictionaries."""
    c, (z, n) = quality_classifier, ({}, {})
    order = np.random.default_rng(7)

    def weight(f):
        zi = z.get(f, 0.0)
        return 0.0 if abs(zi) <= c.L1 else -(zi - math.copysign(c.L1, zi)) / ((c.BETA + math.sqrt(n.get(f, 0.0))) / c.ALPHA + c.L2)

    for _ in range(epochs):
        for k in order.permutation(len(labels)):
            bag = {**bags[k], "bias": 1.0}
            w = {f: weight(f) for f in bag}
            p = 1 / (1 + math.exp(-sum(w[f] * x for f, x in bag.items())))
            for f, x in bag.items():
                g = (p - labels[k]) * x
                was = n.get(f, 0.0)
                n[f] = was + g * g
                z[f] = z.get(f, 0.0) + g - (math.sqrt(n[f]) - math.sqrt(was)) / c.ALPHA * w[f]
    return weight


def test_classifier_equals_brute_force(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    d, labels = d.filter("doc_id < 150").persist(), labels.filter("doc_id < 150").persist()
    text = {r.doc_id: r.text for r in d.collect()}

    def bag(t):
        slot, value, _ = quality_classifier.features(*quality_classifier.as_bytes(pa.array([t])))
        out = {}
        for s, v in zip(slot.tolist(), value.tolist()):
            out[s] = out.get(s, 0.0) + v
        return {s: float(np.float32(v)) for s, v in out.items()}

    used = [(r.doc_id, int(r._quality > 0)) for r in quality_classifier.chosen(labels).orderBy("_order").collect()]
    held = {i for i in text if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len(used) > 20 and not held & {i for i, _ in used} and {i for i, _ in used} == {r.doc_id for r in labels.collect()} - held
    weight = brute_ftrl([bag(text[i]) for i, _ in used], [q for _, q in used], quality_classifier.EPOCHS)
    for r in quality_classifier.scored(d, labels, carry=[]).collect():
        want = 1 / (1 + math.exp(-sum(weight(f) * x for f, x in {**bag(text[r.doc_id]), "bias": 1.0}.items())))
        assert r.score == pytest.approx(want, abs=1e-5) and r.held_out == (r.doc_id in held)


def test_sample_follows_the_hash_and_bears_long_texts(spark):
    rows = [(i, ("good word %d " % i if i % 2 else "bad thing %d ! " % i) * 30, None, None, None) for i in range(60)]
    rows[7] = (7, "good words all over here " * 60_000, None, None, None)  # 1.5 MB
    d, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    few = quality_classifier.chosen(labels, 10).collect()
    every = quality_classifier.chosen(labels, 60).orderBy("_order").collect()
    assert {r.doc_id for r in few} == {r.doc_id for r in every[:10]} and {r.doc_id for r in few} != set(range(10))
    got = quality_classifier.scored(d, labels, carry=[]).collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.9
    only = quality_classifier.fit(d.filter("doc_id = 7"), labels)
    assert np.count_nonzero(only[0]) > 3  # a long text is learned from


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    c, covered = Counter(tri), set()
    for i, t in enumerate(tri):
        if c[t] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("which", ["hard", "docs"])
def test_quality_counts_equal_brute_force(request, which):
    d = request.getfixturevalue(which)
    got = sorted((tuple(r)[:6] for r in quality_rules.judge(d.selectExpr("*", "1 AS words", "2 AS n", "3 AS packed")).collect()), key=repr)
    assert got == sorted(((r.doc_id, *brute_counts(r.text)) for r in d.collect()), key=repr)


@pytest.mark.parametrize("spare", [50, 54, 56])
def test_quality_counts_bear_windows_of_one_hash(spark, spare):
    rnd = random.Random(spare)
    texts = [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(4, 60))) for _ in range(60)]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.counts(d, spare).collect()}
    assert all(got[i] == brute_counts(t)[4] for i, t in enumerate(texts))


def test_quality_counts_of_random_texts(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(["a", "b", "c d", " ", "\n", "#", "\t", "é"]) for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: tuple(r)[1:6] for r in quality_rules.judge(d).collect()}
    assert all(got[i] == brute_counts(t) for i, t in enumerate(texts))
    assert quality_rules.judge(none(spark)).count() == 0


# -- byte pairs


def test_bpe_equals_the_library():
    import tiktoken

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        data = f.read()
    own = bpe.Codec(data, public.PATTERN, kept=500)
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(data), special_tokens={})
    rnd = random.Random(6)
    texts = [None, "", "a" * 3000, "ab" * 900, "-" * 700 + "=" * 90, " " * 200, "<|endoftext|>", "\x1c\x85　 x", "don't WE'll"]
    texts += ["".join(rnd.choice("ab c'd\n\t é²1_ \x1c!日😀") for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    for part in (texts[:9], texts[9:], texts[:40]):
        ids, at = own.encode(pa.array(part))
        for i, x in enumerate(part):
            assert ids[at[i] : at[i + 1]].tolist() == enc.encode_ordinary(x or "")
        assert own.decode(ids, at) == [(x or "").encode() for x in part]
    assert own.decode(ids[::-1], np.array([0, len(ids)])) != [b"".join((x or "").encode() for x in part)]
    with pytest.raises(ValueError):
        own.decode(np.array([10**7]), np.array([0, 1]))


@pytest.mark.parametrize("which", ["hard", "docs"])
def test_bpe_frames(spark, request, which):
    import tiktoken

    d = request.getfixturevalue(which)
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    e = bpe.encode(d.selectExpr("*", "1 AS ids", "2 AS decoded"))
    back = sorted(((r.doc_id, bytes(r.decoded).decode()) for r in bpe.decode(e).collect()), key=repr)
    assert back == sorted(((r.doc_id, r.text or "") for r in d.collect()), key=repr)
    want = []
    for r in d.collect():
        ids = enc.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(d).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.digests(none(spark)).count() == 0


def test_decoding_reads_the_ids(monkeypatch):
    """A wrong id changes what is decoded."""
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        own = bpe.Codec(f.read(), public.PATTERN)
    ids, at = own.encode(pa.array(["some words to encode", "more"]))
    monkeypatch.setattr(bpe, "TOGETHER", 3)
    assert own.decode(ids, at) == [b"some words to encode", b"more"]
    ids[1] += 1
    assert own.decode(ids, at)[0] != b"some words to encode"


# -- personal data


def brute_spans(t):
    out = {k: [] for k in pii.KINDS}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return out


def test_base_spans_equal_the_patterns():
    rnd = random.Random(1)
    for _ in range(8000):
        t = "".join(rnd.choice("ab@@..1 2+-()5%3_é4۳\n@.") for _ in range(rnd.randint(0, 60)))
        if rnd.random() < 0.3:
            t = t.replace("a", " 4111 1111 1111 1111 ").replace("b", "10.2.255.1")
        assert brute_spans(t) == pii.base_spans(t)


@pytest.mark.parametrize("text,kind,found", [
    ("mail john.doe (at) example (dot) com now", "email", "john.doe (at) example (dot) com"),
    ("write to mary at example dot org please", "email", "mary at example dot org"),
    ("user{at}host[.]net", "email", "user{at}host[.]net"),
    ("+1 (555) ５５５-１２３４ full", "phone", "+1 (555) ５５５-１２３４"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("call plus one five five five one two three four five six seven today", "phone", "plus one five five five one two three four five six seven"),
    ("ip one nine two dot one six eight dot one dot two end", "ip", "one nine two dot one six eight dot one dot two"),
    ("4111​1111​1111​1111", "card", "4111​1111​1111​1111"),
])
def test_disguises_map_back_to_the_source(text, kind, found):
    base, every = pii.spans(text)
    assert not any(base.values())
    assert [text[a:b] for a, b in every[kind]] == [found] and sum(map(len, every.values())) == 1
    assert pii.redact_text(text) == text.replace(found, f"[{kind.upper()}]")


@pytest.mark.parametrize("found,kind", [
    ("192 dot 168 dot 0 dot 1", "ip"),
    ("10 dot zero dot 0 dot one", "ip"),
    ("plus 49 151 2345678", "phone"),
    ("plus 49 (151) 2345678", "phone"),
    ("jane at firm dot online", "email"),
    ("jane at firm dot shop", "email"),
    ("jane at firm (dot) online", "email"),
    ("jane arroba firma punto online", "email"),
    ("john dot smith at example dot com", "email"),
    ("jean point dupont arobase exemple point fr", "email"),
    ("john dot smith at firm dot example dot shop", "email"),
])
def test_plain_disguises(found, kind):
    text = f"write: {found}, please"
    assert not any(pii.base_spans(text).values())
    every = pii.spans(text)[1]
    assert [text[a:b] for a, b in every[kind]] == [found] and sum(map(len, every.values())) == 1
    assert pii.redact_text(text) == f"write: [{kind.upper()}], please"


def test_prose_with_at_dot_and_plus_is_left_alone():
    for t in ("look at this point we", "looking at the dot product", "stare at paul dot and go", "look at example.com", "2 plus 3 plus 4", "5 point 3 and 7 point 2", "plus 12 de 20", "300 dot 1 dot 1 dot 1"):
        assert not any(pii.spans(t)[1].values()), t


@pytest.mark.parametrize("found,base", [
    ("jоhn@example.com", "hn@example.com"),
    ("jo\u200bhn@example.com", "hn@example.com"),
    ("a@mail.exаmple.com", "a@mail.ex"),
    ("a@host.co dot uk", "a@host.co"),
    ("a@host.co dot online", "a@host.co"),
    ("10.0.0.1２", "10.0.0.1"),
])
def test_disguised_finds_extend_base_spans(found, base):
    text = f"write {found}, please"
    have, every = pii.spans(text)
    kind, whole = "ip" if base[0] == "1" else "email", (6, 6 + len(found))
    assert [text[a:b] for a, b in have[kind]] == [base]
    assert set(every[kind]) == {*have[kind], whole} and sum(map(len, every.values())) == 2
    assert pii.redact_text(text) == f"write [{kind.upper()}], please"


def test_finds_within_base_spans_add_nothing():
    for t in ("john@example.com\u200b", "écrire à a@b.com point final", "a@b.com point 3"):
        base, every = pii.spans(t)
        assert base["email"] and base == every


def test_clean_prose_is_left_alone():
    for t in ("he was at home. Then dot", "look (at) this. (dot)", "un deux trois", "meet at 5 point 3", "один два", "a.b at c"):
        assert not any(pii.spans(t)[1].values()) and pii.redact_text(t) == t


def test_long_runs_are_linear():
    for t in ("a@" * 50_000, "1" * 100_000, "1." * 100_000, "+1" * 50_000, "one " * 20_000, "(at)" * 20_000, "x at " * 20_000):
        pii.spans(t)


def test_many_spans_are_linear():
    t = " ".join(f"u{k}@ex.com and joe{k} [at] site [dot] org," for k in range(8000))
    began = time.process_time()
    base, every = pii.spans(t)
    assert len(base["email"]) == 8000 and len(every["email"]) == 16_000 and time.process_time() - began < 20


@pytest.mark.parametrize("which", ["hard", "docs"])
def test_personal_data_frames_equal_the_patterns(request, which):
    d = request.getfixturevalue(which)
    want = []
    for r in d.collect():
        base, (_, every) = brute_spans(r.text or ""), pii.spans(r.text)
        assert all(set(base[k]) <= set(every[k]) for k in pii.KINDS)
        n = sum(map(len, every.values()))
        joined = lambda f: ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in f[k])
        want.append((r.doc_id, *[len(base[k]) for k in pii.KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), n, n - sum(map(len, base.values()))))
    got = pii.detect(d.selectExpr("*", "1 AS spans", "2 AS n_email"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_long_parts_of_addresses():
    name, host = "a" * 300, " dot ".join(["h" * 80, *"bcdefghi", "tech"])
    text = f"to {name} at {host} now"
    assert [text[a:b] for a, b in pii.spans(text)[1]["email"]] == [f"{name} at {host}"]
    for t in ("a dot " * 50_000, "a dot " * 30_000 + "b at c", "x at " + "a dot " * 50_000, "a" * 200_000 + " at " + "b" * 200_000):
        pii.spans(t)


def test_personal_data_frames(spark, hard):
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.detect(hard).collect()}
    assert (9, 1, 1, 1, 1) in got and (1, 0, 0, 0, 0) in got
    out = pii.redact(hard.selectExpr("*", "1 AS spans"))
    assert out.columns[-1] == "spans"
    for r in out.collect():
        assert (r.text is None) == (r.doc_id == 1) and (r.text is None or r.n_chars == len(r.text))
    assert pii.detect(none(spark)).count() == 0


# -- long texts


@pytest.fixture(scope="module")
def long_docs(spark, tmp_path_factory):
    """Texts beyond what a batch (4 MB) and a kernel's chunk (2 MB) hold, with all that the operators look for."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(120))
    five = " ".join(rnd.choice(vocabulary) for _ in range(770_000))
    twenty = (five + "\n") * 4
    five = five[:3_000_000] + f" {passage} write a.b@c.example.org or jo at firm dot online, 10.0.0.1 " + five[3_000_000:]
    rows = [(1, five, "en", "s1", len(five)), (2, twenty, "en", "s1", len(twenty)), (3, f"short {passage} text", "en", "s2", 0), (4, None, None, None, None)]
    assert len(five) > 4_500_000 and len(twenty) > 18_000_000
    names, where = ["doc_id", "text", "lang", "source", "n_chars"], str(tmp_path_factory.mktemp("long") / "documents.parquet")
    pq.write_table(pa.table([pa.array(c, pa.int64() if k in (0, 4) else pa.string()) for k, c in enumerate(zip(*rows))], names=names), where)
    return spark.read.parquet(where), rows


def test_long_texts_in_rules_mix_and_hashes(long_docs):
    d, rows = long_docs
    got = {r.doc_id: tuple(r)[1:6] for r in quality_rules.judge(d).collect()}
    assert all(got[i] == brute_counts(t) for i, t, *_ in rows)
    mixed = sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(d).collect()), key=repr)
    assert mixed == brute_mix([(i, t, s) for i, t, _, s, _ in rows])
    want = brute_components([(i, t) for i, t, *_ in rows])
    assert sorted((tuple(r) for r in simhash.near_duplicates(d).collect()), key=repr) == want
    assert simhash.deduplicate(d).count() == len({c for _, _, c in want})


def test_long_texts_in_tokens(spark, long_docs):
    import tiktoken
    from tokenizers import Tokenizer

    d, rows = long_docs
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    for r in bpe.digests(d).collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id) or ""
        ids = enc.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    t, at = Tokenizer.from_file(public.path("byte_bpe_50k.json")), 0
    got = {r.doc_id: r for r in token_files.read_files(spark, token_files.write_files(d)).collect()}
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_long_texts_in_models_and_spans(spark, long_docs):
    d, rows = long_docs
    teach = spark.createDataFrame([(100 + i, ("the cat sat on the mat " if i % 2 else "und der hund war im haus ") * 20, "en" if i % 2 else "de", "s", 0) for i in range(60)], DOCS)
    langs, trees = language_id.fit(teach)
    got = {r.doc_id: r for r in language_id.identify(d, (langs, trees)).collect()}
    for i, t, *_ in rows:
        raw, at = language_id.as_bytes(pa.array([t], pa.large_string()))
        cost = [tr.cost(language_id.strings(raw, at)).sum() for tr in trees]
        assert got[i].lang_pred == ("und" if t is None else langs[int(np.argmin(cost))])
    labels = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(teach, labels)
    for r in quality_classifier.scored(d, labels, model, carry=[]).collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        slot, value, _ = quality_classifier.features(*quality_classifier.as_bytes(pa.array([text], pa.large_string())))
        assert r.score == pytest.approx(1 / (1 + math.exp(-float(np.dot(model[0][slot], value)) - model[1])), abs=1e-6)
    for r in pii.detect(d).collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id) or ""
        base = brute_spans(text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(base[k]) for k in pii.KINDS) and (r.doc_id != 1 or r.n_added == 1)


def test_long_texts_in_suffix_arrays(spark, long_docs):
    """Brute force by sorting hashes of all windows."""
    d, rows = long_docs
    raw = [(t or "").encode() for _, t, *_ in rows]
    seen, place = [], []
    for k, b in enumerate(raw):
        x = np.frombuffer(b, np.uint8)
        if len(x) >= 400:
            s = suffix_dedup.words.prefix(x)
            p = np.arange(len(x) - 399)
            seen.append(suffix_dedup.words.ranges(s, p, p + 400))
            place.append((k, p))
    _, inverse, count = np.unique(np.concatenate(seen), return_inverse=True, return_counts=True)
    many, at = count[inverse] > 1, 0
    want = {i: 0 for i, *_ in rows}
    for (k, p), h in zip(place, seen):
        own = np.zeros(len(raw[k]) + 1, np.int64)
        hit = p[many[at : at + len(h)]]
        np.add.at(own, hit, 1)
        np.add.at(own, np.minimum(hit + 400, len(raw[k])), -1)
        want[rows[k][0]] = int((np.cumsum(own)[:-1] > 0).sum())
        at += len(h)
    got = {r.doc_id: r for r in suffix_dedup.remove(d).collect()}
    assert {i: got[i].n_removed for i in want} == want and all(got[i].n_bytes == len(b) for (i, *_), b in zip(rows, raw))
    assert want[2] == len(raw[1]) and got[3].n_passages1 == 1
