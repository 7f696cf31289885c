"""Secret scans: fixed patterns, and guess costs of values in a credential's context.

The fixed (base) patterns find assignments, access keys and hexadecimal runs. The method adds spans (kind `guess`): a
value that follows a credential word in wider contexts than an assignment's (`password is ...`, `pwd => ...`, quoted
keys) and that no base span contains is segmented by dynamic programming into common words, dates, repeats, keyboard or
alphabet walks, joining signs and brute-force spans. Each segment has a guess cost (log10); the cheapest segmentation is
the value's cost, and only values too costly to guess are reported, so prose after the word "password" is not. The cost
alone decides: letters only, or any length, make no exception.

Common words are ranked by their counts over all documents (one aggregation; values in a credential's context and base
spans don't count, so no secret teaches itself); the most frequent ones, KEPT at most, in at least LEAST places, are
broadcast, with a short fixed list of password words. Ties of counts go by the word.

A quoted value runs to its own quote in the same line, blanks and any script included; any other is a run of characters
that aren't blank, without the signs that close a sentence or bracket. The cost is the least over the segments offered:
words have 32 letters at most, and of repeats and walks over 128 characters not every part is offered.

Edge cases: null text counts as empty and has no spans; positions are code points, ends exclusive; very long texts are
scanned whole, and so are long values, whose costing ends early; a quote without its like in the line is no part of a value; repeated rows are
answered alike (their words count as often); without documents only the fixed words are known; only doc_id and text are
read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skein.session import remove, saved, scratch

from .common import map_texts, prepare

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "guess")
#: Of longer repeats and walks, segments that begin inside and end within this many characters or at the end are
#: offered; from its first place every end is.
STEPS = 128
#: Corpus words whose ranks are known, the least count, and letters in one.
KEPT, LEAST, LETTERS, GRADES = 100_000, 3, 32, 64
WORD = re.compile(r"[^\W\d_]{2,32}")
#: Distinct words that a task counts before it passes them on.
COUNTED = 200_000
#: A credential word, up to two joining words or signs, then the value: all that stands between two quotes of a kind in a
#: line, else a run of characters that aren't blank (a quote that isn't closed doesn't belong to it).
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credential|api[_-]?key|private[_-]?key|access[_-]?key)s?["']?"""
    r"""[ \t-\r]{0,3}(?:(?:is|was|=>|:=|[:=])[ \t-\r]{0,3}){1,2}(?:"([^"\r\n]{6,})"|'([^'\r\n]{6,})'|`([^`\r\n]{6,})`|["'`]?([^\s"'`]\S{5,}))""",
    re.I,
)
HINT = re.compile(r"pass(?:w|p|c)|pwd|secret|token|credential|[_-]?key", re.I | re.A)

#: Frequent password words in order of rank.
WORDS = (
    "password 123456 qwerty letmein admin welcome monkey dragon master login abc123 iloveyou sunshine princess football "
    "baseball shadow superman batman trustno1 hello freedom whatever secret token key pass user test guest root default "
    "changeme example sample demo none null true false your the and for with that this from have not are was you will "
    "must value string here reset please enter new old my our of is in to it on by at or as be api access private public"
).split()
#: Cost of a word: log10 of its rank and one.
FIXED = {w: math.log10(i + 2) for i, w in enumerate(WORDS)}
#: Signs that join words, and the cost of one.
JOINTS, JOINT = frozenset("-_.,:;/'+"), 0.7
#: Rows of a keyboard and the alphabet, walked either way.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
NEXT = {a + b for r in ROWS for s in (r, r[::-1]) for a, b in zip(s, s[1:])}
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d", re.A)
LEET = str.maketrans("4@301!5$7", "aaeoiisst")
#: Characters beyond ASCII that a guesser tries.
OTHERS = 100
#: log10 of the guesses from which a value counts as a secret.
THRESHOLD = 9.0


def _alphabet(s: str) -> float:
    """log10 of the characters a guesser must try for each of s."""
    plain = s if s.isascii() else [c for c in s if c < "\x80"]
    n = 26 * any(c.islower() for c in plain) + 26 * any(c.isupper() for c in plain) + 10 * any(c.isdigit() for c in plain) + 33 * any(not c.isalnum() for c in plain)
    n += OTHERS * (len(plain) < len(s))
    return math.log10(max(n, 2))


def _runs(low: str, size: int) -> list[int]:
    """For each place, how many characters from it on equal the one `size` further."""
    out = [0] * (len(low) + 1)
    for i in range(len(low) - size - 1, -1, -1):
        out[i] = out[i + 1] + 1 if low[i] == low[i + size] else 0
    return out


def _walks(low: str) -> list[int]:
    """For each place, the characters of the walk that starts there."""
    out = [1] * (len(low) + 1)
    for i in range(len(low) - 2, -1, -1):
        out[i] = out[i + 1] + 1 if low[i : i + 2] in NEXT else 1
    return out


def guess_cost(value: str, limit: float = math.inf, words: dict[str, float] = FIXED) -> float:
    """log10 of the guesses for value: the least sum over all segmentations. What reaches limit isn't followed further,
    so that a cost of limit or more may be told as any number from limit on."""
    n, low = len(value), value.lower()
    if len(low) != n:  # a few letters grow in lower case; they are no ranked words' anyway
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in value)
    plain = low.translate(LEET)
    each = _alphabet(value)
    best = [0.0] + [math.inf] * n
    runs, walks = [_runs(low, size) for size in range(1, 5)], _walks(low)
    last = 0  # the furthest place reached below limit
    for i in range(n):
        if i > last:
            break
        here = best[i]
        if here >= limit:
            continue

        def offer(j: int, cost: float) -> None:
            nonlocal last
            if here + cost < best[j]:
                best[j] = here + cost
                if best[j] < limit:
                    last = max(last, j)

        for j in range(i + 1, n + 1):
            offer(j, each * (j - i) + 0.3 * (i > 0))  # brute force
            if here + each * (j - i) > limit or j - i > 1 and here + each * (j - i) > best[n]:
                break
        if low[i] in JOINTS:
            offer(i + 1, JOINT)
        for j in range(i + 2, min(n, i + LETTERS) + 1):
            for word, extra in ((low[i:j], 0.0), (plain[i:j], 0.6)):
                if word in words:
                    offer(j, words[word] + extra + 0.3 * (value[i:j] != low[i:j]))
        if m := DATE.match(value, i):
            offer(m.end(), 4.3)
        for size in range(1, 5):
            times = runs[size - 1][i] // size + 1
            starts = i == 0 or not runs[size - 1][i - 1]
            for k in {*range(2, (times if starts else min(times, STEPS // size)) + 1), times} - {1}:
                offer(i + k * size, each * size + math.log10(k + 1))
        starts = i == 0 or walks[i - 1] == 1
        for k in {*range(3, (walks[i] if starts else min(walks[i], STEPS)) + 1), walks[i]} - {1, 2}:
            offer(i + k, math.log10(4 * 26 * k))
    return best[n]


def _base(text: str) -> list[tuple[int, int, int]]:
    spans = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if HINT.search(text):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    return spans


def _values(text: str) -> list[tuple[int, int]]:
    """Where the values in a credential's context stand."""
    out = []
    for m in CONTEXT.finditer(text) if HINT.search(text) else []:
        a = m.start(m.lastindex)
        value = m[m.lastindex]
        out.append((a, a + len(value if m.lastindex < 4 else value.rstrip(".,;:!?)]}>\"'`"))))
    return out


def find_secrets(text: str, threshold: float = THRESHOLD, words: dict[str, float] = FIXED) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of every span, in order of start, then kind."""
    spans = _base(text)
    taken = [(a, b) for a, _, b in spans]
    for a, b in _values(text):
        if b - a >= 6 and not any(x <= a and b <= y for x, y in taken) and guess_cost(text[a:b], threshold, words) >= threshold:
            spans.append((a, 3, b))
    return sorted(spans)


def common_words(docs: DataFrame, kept: int = KEPT, least: int = LEAST) -> dict[str, float]:
    """Costs of the most frequent words of all texts, and of the fixed ones: all words whose count is of a grade (a step of
    1 / GRADES of its logarithm) that, with the grades above it, comes to at most `kept` words. No more than that many rows
    of at most LETTERS letters come to the driver, from all tasks together."""
    prepare(docs.sparkSession)

    def run(batches):
        seen: Counter = Counter()

        def told():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                if not t:
                    continue
                hidden = sorted([(a, e) for a, _, e in _base(t)] + _values(t))
                at = 0
                for a, e in hidden:
                    seen.update(WORD.findall(t[at : max(at, a)].lower()))
                    at = max(at, e)
                seen.update(WORD.findall((t[at:] if at else t).lower()))
            if len(seen) > COUNTED:
                yield told()
        if seen:
            yield told()

    counts = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    folder = scratch(docs.sparkSession, "words")
    counts = saved(counts.withColumn("grade", F.floor(GRADES * F.log2("n")).cast("int")), folder)
    # grades of counts, a few thousand at most: the lowest that comes whole
    lowest, held = None, 0
    for r in sorted(counts.groupBy("grade").agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        held += r["words"]
        if held > kept:
            break
        lowest = r["grade"]
    top = counts.where(F.col("grade") >= lowest).select("word", "n").collect() if lowest is not None else []
    remove(docs.sparkSession, folder)
    costs = {r["word"]: math.log10(i + 2) for i, r in enumerate(sorted(top, key=lambda r: (-r["n"], r["word"])))}
    return {w: min(c, costs.get(w, c)) for w, c in (costs | FIXED).items()}


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess; a row per row. Only word counts are
    shuffled."""
    prepare(docs.sparkSession)
    ranked = docs.sparkSession.sparkContext.broadcast(common_words(docs))  # bounded by KEPT

    def columns():
        words = ranked.value

        def f(texts):
            found = [find_secrets(t, threshold, words) for t in texts]
            n = [[sum(k == kind for _, k, _ in s) for s in found] for kind in range(4)]
            return {
                "n_assign": pa.array(n[0], pa.int64()),
                "n_access": pa.array(n[1], pa.int64()),
                "n_hex": pa.array(n[2], pa.int64()),
                "base_sha256": pa.array([hashlib.sha256(_told([x for x in s if x[1] < 3]).encode()).hexdigest() for s in found], pa.string()),
                "spans": pa.array([_told(s) for s in found], pa.string()),
                "n_guess": pa.array(n[3], pa.int64()),
            }

        return f

    return map_texts(docs, ["doc_id"], columns, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")


def redact(docs: DataFrame, threshold: float = THRESHOLD, mark: str = "<SECRET>") -> DataFrame:
    """docs with every secret's characters in text replaced by the mark; overlapping spans become one. Of an assignment
    the value is replaced and its name stays. All other columns stay, n_chars counts the new text; a null text stays null."""
    prepare(docs.sparkSession)
    kind = docs.schema
    ranked = docs.sparkSession.sparkContext.broadcast(common_words(docs))  # bounded by KEPT

    def run(batches):
        words = ranked.value
        for b in batches:
            at = b.schema.get_field_index("text")
            out = []
            for t in b.column(at).to_pylist():
                parts, last = [], 0
                for a, k, e in find_secrets(t, threshold, words) if t else []:
                    if k == 0:
                        a = ASSIGN.match(t, a).start(2)
                    if e <= last:
                        continue
                    if a >= last:
                        parts += [t[last:a], mark]
                    last = e
                out.append("".join(parts) + t[last:] if t else t)
            cols = list(b.columns)
            cols[at] = pa.array(out, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    new = docs.mapInArrow(run, kind)
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(kind["n_chars"].dataType))
    return new
