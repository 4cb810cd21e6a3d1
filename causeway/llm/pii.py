"""Personal data by offset-preserving deobfuscation.

Base detectors find emails, addresses, cards and phones in the text as it is. Then transducers rewrite the text
- look-alike characters to ASCII, zero-width characters to nothing, disguised `at` and `dot` to @ and .,
spelled digits to digits - each keeping, for every character it writes, the source characters that it stands
for. The same detectors run on the rewritten text, and a find that holds a rewritten character and reaches beyond
the spans found before is mapped back to the source: it may extend a base span. Base spans always stay.

All offsets are code points, ends exclusive. Every pattern is linear in the text, so very long texts and runs
of one character are safe. Defined cases. Null or empty text: no spans. Repeated rows: the same spans. Null
doc_id: kept as null. Other columns pass through `redact`; the query ignores them.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import map_arrow, slices

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Spelled digits of four languages, 0 to 9.
SPELLED = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
DIGIT_OF = {w: str(i) for words in SPELLED.values() for i, w in enumerate(words.split())} | {"oh": "0"}
DOT_WORDS, AT_WORDS = ("dot", "punkt", "point", "punto"), ("at", "arobase", "arroba")
# Letters of other scripts that look like Latin ones.
LOOKALIKE = dict(zip(
    "аеорсхуіјѕԁһкмтвнАВЕКМНОРСТХІЈЅУοανερτυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcxyijsdhkmtbhABEKMHOPCTXIJSYoaveptuikABEZHIKMNOPTYX",
))
# Last parts of host names that make "at" and "point", which prose has too, a disguise.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz name io co ai app dev me tv eu us uk de fr es it nl be at ch pl se no fi dk pt ie ru ua cn jp kr in br mx ar ca au nz za".split())
# Words that stand before a "dot", or after one, in prose; no host name has them there.
_BEFORE_DOT = frozenset("the a an each every this that these those one any some no his her its my your our their which".split())
_AFTER_DOT = frozenset("and or the of on an with from that this then but which was were when where at is are".split())
_HIDDEN = "­​‌‍⁠﻿"
_ODD = re.compile("[­Ͱ-ԯ٠-٩۰-۹०-९​-‍‐-―․⁠−①-⓿。﹒﹫﻿！-～\U0001d400-\U0001d7ff]")
_EXTRA = {"。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-"}

_AT = "|".join(AT_WORDS)
_DOT = "|".join(DOT_WORDS)
_BRACKET = re.compile(rf"[ ]?[(\[{{<] ?(?:({_AT}|@)|({_DOT}|\.)) ?[)\]}}>][ ]?", re.I)
# A local part begins at no part of another one, so that each is read once, however long it is.
_FIRST = "".join(f"(?<! {w} )" for w in DOT_WORDS)
_PROSE = re.compile(rf"(?<![\w.@+-]){_FIRST}([a-z0-9._%+-]++(?: (?:{_DOT}) [a-z0-9._%+-]++)*+)(?:( (?:{_AT}) )|@)([a-z0-9-]++(?:(?: (?:{_DOT}) |\.)[a-z0-9-]++)+)(?![\w@])", re.I)
_PROSE_DOT = re.compile(rf" (?:{_DOT}) ", re.I)
_TOKEN = "|".join(sorted(DIGIT_OF, key=len, reverse=True))
_RUN = re.compile(rf"(?<!\w)(?:(?:plus|{_TOKEN}|{_DOT}|[0-9]{{1,19}}|\+)(?:[ ,-]{{1,2}}|(?=\W)|$)){{2,}}", re.I)
_PART = re.compile(rf"(?<!\w)(?:(plus)|({_TOKEN})|({_DOT}))(?!\w)", re.I)
_TRIGGER = re.compile(rf"[(\[{{<] ?(?:{_AT}|@|{_DOT}|\.) ?[)\]}}>]| (?:{_AT}) | (?:{_DOT}) ", re.I)
_NUMERIC = re.compile(rf"(?<!\w)plus[ ,-]{{1,2}}[0-9]|[0-9][ ,-]{{1,2}}(?:{_DOT})[ ,-]", re.I)
_SPLIT = str.maketrans("-,.\n\t()", "       ")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost match can only start where the run before an @ does, so each @ is looked at once."""
    out, floor, p = [], 0, text.find("@")
    while p >= 0:
        s = p
        while s > floor and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, p + 1) if s < p else None
        if m:
            out.append((s, m.end()))
            floor = m.end()
        p = text.find("@", max(p + 1, floor))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(g) <= 3 and int(g) <= 255 or len(h := g.lstrip("0")) <= 3 and int(h or "0") <= 255 for g in m.groups()):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out["phone"].append(m.span())
    return out


class Rewritten:
    """A text, the source range of each of its characters, and which of them are rewritten."""

    def __init__(self, text: str):
        n = len(text)
        self.text, self.start, self.end, self.new = text, np.arange(n), np.arange(1, n + 1), np.zeros(n, bool)

    def letters(self, table: dict[int, str | None]) -> None:
        mapped = [table.get(ord(c), c) for c in self.text]
        keep = np.array([c is not None for c in mapped], bool)
        new = np.array([a != b for a, b in zip(mapped, self.text)], bool)
        # a hidden character counts as rewriting the one before it
        new[:-1] |= ~keep[1:]
        self.text = "".join(c for c in mapped if c is not None)
        self.start, self.end, self.new = self.start[keep], self.end[keep], (self.new | new)[keep]

    def put(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ranges of this text (ascending, apart); what is written stands for the whole range."""
        if not edits:
            return
        text, starts, ends, new, at = [], [], [], [], 0
        for a, b, r in edits:
            text += [self.text[at:a], r]
            lead = np.full(len(r), self.start[a]), np.full(len(r), self.end[b - 1])
            starts += [self.start[at:a], lead[0]]
            ends += [self.end[at:a], lead[1]]
            new += [self.new[at:a], np.ones(len(r), bool)]
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.start, self.end, self.new = (np.concatenate([*x, y[at:]]) for x, y in ((starts, self.start), (ends, self.end), (new, self.new)))


def _plain(c: str) -> str | None:
    if c in _HIDDEN:
        return None
    if c in LOOKALIKE or c in _EXTRA:
        return LOOKALIKE.get(c) or _EXTRA[c]
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    n = unicodedata.normalize("NFKC", c)
    return n if len(n) == 1 and n.isascii() else c


def _disguised(at: str, host: str, words: set[str], marked: bool) -> bool:
    """Whether a spelled "at" before a host name with these spelled dots (or marked ones, as "(dot)") is a disguise, not prose."""
    if not words and not marked:
        return False  # "look at example.com"
    end = re.split(r"[ .]", host)[-1]
    if end in TOP_LEVEL or marked:
        return True
    if at == "at" and words <= {"point"}:
        return False  # "look at this point we"
    return len(end) > 1 and end.isalpha() and end not in _AFTER_DOT and re.split(r"[ .]", host)[0] not in _BEFORE_DOT


def deobfuscate(text: str) -> Rewritten | None:
    """None if there is nothing to rewrite."""
    odd = not text.isascii() and _ODD.search(text)
    low = text.lower() if odd or _TRIGGER.search(text) else None
    spelled = not DIGIT_OF.keys().isdisjoint((low or text.lower()).translate(_SPLIT).split())
    numeric = spelled or _NUMERIC.search(text)
    if low is None and not numeric:
        return None
    r = Rewritten(text)
    if odd:
        r.letters({ord(c): _plain(c) for c in set(_ODD.findall(text))})
    r.put([(m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKET.finditer(r.text) if re.search(r"\w", r.text[m.end() : m.end() + 1]) and re.search(r"\w", r.text[max(0, m.start() - 1) : m.start()])])
    edits = []
    for m in _PROSE.finditer(r.text):
        local = list(_PROSE_DOT.finditer(r.text, m.start(1), m.end(1) + 1))
        dots = list(_PROSE_DOT.finditer(r.text, m.start(3) - 1, m.end(3)))
        words = {d.group().strip().lower() for d in dots}
        if not m[2] and "." in m[3]:
            # "point" and its like also follow a whole address in prose; "dot" does not
            known = re.split(r"[ .]", m[3])[-1].lower() in TOP_LEVEL
            dots = [d for d in dots if known or d.group().strip().lower() == "dot"]
        if m[2] and not _disguised(m[2].strip().lower(), m[3].lower(), words, any(r.text[k] == "." and r.new[k] for k in range(*m.span(3)))):
            continue
        # from the right, so that what is rewritten is one local part
        for d in reversed(local):
            if (w := d.group().strip().lower()) != "dot" and w not in words:
                break
            edits.append((d.start(), d.end(), "."))
        edits += [(m.start(2), m.end(2), "@")] if m[2] else []
        edits += [(d.start(), d.end(), ".") for d in dots]
    edits.sort()
    r.put(edits)
    if numeric:
        edits = []
        for m in _RUN.finditer(r.text):
            parts = list(_PART.finditer(r.text, m.start(), m.end()))
            # the detectors judge what is rewritten; fewer words than these can make no find
            if not (sum(bool(p[2]) for p in parts) >= 4 or any(p[1] for p in parts) or sum(bool(p[3]) for p in parts) >= 3):
                continue
            last = None
            for p in parts:
                # separators between spelled characters are part of the one that follows
                a, b = last if last is not None and not re.search(r"[0-9+]", r.text[last : p.start()]) else p.start(), p.end()
                # those between a digit and a dot, or a plus and a digit, are part of the dot or plus
                while p[3] and a > m.start() and a != last and r.text[a - 1] in " ,-":
                    a -= 1
                while not p[2] and b < m.end() and r.text[b] in " ,-":
                    b += 1
                edits.append((a, b, "+" if p[1] else DIGIT_OF[p[2].lower()] if p[2] else "."))
                last = b
        r.put(edits)
    return r


def spans(text: str | None) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans, and all spans, by kind in order of start."""
    text = text or ""
    base = base_spans(text)
    more = {k: list(v) for k, v in base.items()}
    r = deobfuscate(text)
    if r is not None and r.new.any():
        # a find that lies in other spans tells nothing new; a byte a character: a lookup costs as much as a span is long, however many spans there are
        taken = bytearray(len(text))
        for x, y in (s for v in base.values() for s in v):
            taken[x:y] = b"\1" * (y - x)
        for k, found in base_spans(r.text).items():
            for a, b in found:
                if not r.new[a:b].any():
                    continue
                s, e = int(r.start[a:b].min()), int(r.end[a:b].max())
                # a spelled-out word swallows the separator before it; a span starts at its word
                while s < e and text[s] in " ,-\t\n":
                    s += 1
                if taken.find(0, s, e) >= 0:
                    more[k].append((s, e))
                    taken[s:e] = b"\1" * (e - s)
            more[k].sort()
    return base, more


def joined(found: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in found[k])


def detect(docs: DataFrame) -> DataFrame:
    """doc_id with counts of base spans, the digest of base spans, all spans, their number, and how many of them the method added."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [spans(x) for x in part.column("text").to_pylist()]
                n = [pa.array([len(b[k]) for b, _ in rows], pa.int64()) for k in KINDS]
                sha = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in rows], pa.string())
                every = [sum(map(len, m.values())) for _, m in rows]
                added = [e - sum(map(len, b.values())) for e, (b, _) in zip(every, rows)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *n, sha, pa.array([joined(m) for _, m in rows], pa.string()), pa.array(every, pa.int64()), pa.array(added, pa.int64())], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_spans", "n_added"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_arrow(docs.select("doc_id", "text"), apply, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long")


def redact_text(text: str | None) -> str | None:
    """Overlapping spans become one placeholder, named after the kind that starts first."""
    if text is None:
        return None
    every = sorted((a, b, k) for k, v in spans(text)[1].items() for a, b in v)
    out, at, end = [], 0, -1
    for a, b, k in every:
        if a >= end:
            out += [text[at:a], f"[{k.upper()}]"]
        at = end = max(b, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets, n_chars (if there) kept true."""
    fields = list(docs.schema.fields)
    i = [f.name for f in fields].index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                cols = list(part.columns)
                cols[i] = pa.array([redact_text(x) for x in cols[i].to_pylist()], cols[i].type)
                yield pa.RecordBatch.from_arrays(cols, part.schema.names)

    out = map_arrow(docs, apply, T.StructType(fields))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out


def query(spark, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
