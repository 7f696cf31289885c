"""Conversation structure repair: the cheapest edits of turns that make roles alternate, by a DP shared along a trie.

1. Turns get their first fault: blank (no character but blanks), duplicate (role and text stand earlier in the
   conversation), truncated (the last character that isn't blank is none of `.!?`). A conversation's turns in order, each
   as one letter for the initial of its role and its fault, are its signature.
2. Distinct signatures are dealt by ranges and sorted, so that a task meets them as the walk through a prefix trie. Its
   branch is kept as a stack of DP layers, one for each turn: a signature goes back to the prefix that it shares with the
   one before and computes only the layers behind it. At its last node the answer is told: cost, edits, counts of faults.
3. Answers go back to the conversations of that signature, and edits are carried out in a second walk over the turns,
   which streams texts and holds none.

A layer has a cell for each state behind a turn (nothing yet, system, user, assistant): the least cost, how its edits rank
among the layer's cells in ASCII order, and where it came from. Inserted turns in front of a turn belong to the turn's
step, so edits of a layer have the same number of other letters and end in one; none begins another, and whoever ranks
first stays first whatever follows. So no strings are held, and ties go to the least string as a whole.

Edits: Keep costs 0, Rerole to user or assistant 2, Delete 3, Insert of an empty user or assistant turn 2; a truncated turn
that isn't deleted adds 1; blank and duplicate turns must be deleted. The initials left must read (s?(ua)+)?.

A turn is one byte in a signature and 70 in a task's branch; a conversation's turns are streamed by one task, which its
digest needs (texts are never held together). Everything else is dealt by turn: copies of a turn are counted where they
are, and duplicates are found by salted parts of (conversation, role, text).

Edge cases: null conversation ids are one conversation of their own; null turns come first; null roles and texts are one
blank; rows of equal turn come by role, then by the SHA-256 of their text; repeated rows are duplicates; a role's initial is
its first character and other initials than s, u, a are never legal; conversations without rows after the damage have
zeros, no edits and the digest of nothing; an empty table gives an empty result; turns so far apart that the gap exceeds a
long have its greatest value; only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skein.session import remove, saved, scratch

from .common import prepare, with_group, with_told

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
_INITIALS = "sua"
_CLEAN, _CUT, _BLANK, _COPY = range(4)  # faults, in a signature's letters
_LETTER = ord("A")
_FAR = 1 << 60


def letter(initial: str, fault: int) -> str:
    """A turn in a signature."""
    at = _INITIALS.find(initial) if initial else -1
    return chr(_LETTER + 4 * fault + (at if at >= 0 else 3))


def next_state(state: int, initial: int) -> int | None:
    """Where a turn with this initial (place in sua) leads."""
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return USER if state != USER else None
    return ASSISTANT if initial == 2 and state == USER else None


def wanted(state: int) -> int:
    """The one role, user or assistant, that can follow: what an inserted or changed turn gets."""
    return ASSISTANT if state == USER else USER


def _inserts(state: int) -> list[int]:
    """States after 0, 1, 2 inserted turns, as long as they are new: a third leads back to the first at more cost."""
    out = [state]
    while (state := wanted(state)) not in out:
        out.append(state)
    return out


def _steps(code: int) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, edits) of all ways to take a turn with this letter."""
    fault, initial = divmod(code, 4)
    found = []
    for before in range(4):
        for n, state in enumerate(_inserts(before)):
            found.append((before, state, n * INSERT + DELETE, "I" * n + "D"))
            if fault in (_BLANK, _COPY):
                continue
            more = n * INSERT + (TRUNCATED if fault == _CUT else 0)
            if initial < 3 and (after := next_state(state, initial)) is not None:
                found.append((before, after, more + KEEP, "I" * n + "K"))
            found.append((before, wanted(state), more + REROLE, "I" * n + "R"))
    return found


_STEPS = [_steps(code) for code in range(16)]
_EDITS = sorted({s[3] for steps in _STEPS for s in steps})
#: The same with edits by their place in ASCII order.
_WAYS = [[(b, a, cost, _EDITS.index(e)) for b, a, cost, e in steps] for steps in _STEPS]
#: Inserted turns that end a conversation: none if nothing is left, else up to the assistant.
_CLOSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}


class Branch:
    """The trie's branch of the signature at hand: a layer of four cells a turn, in flat arrays."""

    def __init__(self):
        self.signature = ""
        self.cost = array("q", [0, _FAR, _FAR, _FAR])
        self.rank = bytearray(4)
        self.came = bytearray(4)  # the state before
        self.edit = bytearray(4)
        self.count = array("q", [0, 0, 0, 0])  # blank, duplicate, truncated, illegal
        self.layers = 0  # computed so far, for tests

    def _shared(self, signature: str) -> int:
        """The length of the prefix shared with the signature before."""
        old = self.signature
        if signature.startswith(old):
            return len(old)
        low, high = 0, min(len(old), len(signature))
        while low < high:
            middle = (low + high + 1) // 2
            if old[:middle] == signature[:middle]:
                low = middle
            else:
                high = middle - 1
        return low

    def go(self, signature: str) -> None:
        """Back to the shared prefix, and on to the signature's end."""
        keep = self._shared(signature)
        for cells in (self.cost, self.rank, self.came, self.edit, self.count):
            del cells[4 * (keep + 1) :]
        for at in range(keep, len(signature)):
            self._layer(ord(signature[at]) - _LETTER, (ord(signature[at - 1]) - _LETTER) % 4 if at else None)
        self.signature = signature

    def _layer(self, code: int, before: int | None) -> None:
        self.layers += 1
        cost, rank = self.cost[-4:], self.rank[-4:]
        best = [(_FAR,)] * 4
        for b, a, c, e in _WAYS[code]:
            if cost[b] < _FAR and (way := (cost[b] + c, rank[b], e, b)) < best[a]:
                best[a] = way
        order = {key: i for i, key in enumerate(sorted({w[1:3] for w in best if len(w) > 1}))}
        for w in best:
            self.cost.append(w[0])
            self.rank.append(order[w[1:3]] if len(w) > 1 else 0)
            self.edit.append(w[2] if len(w) > 1 else 0)
            self.came.append(w[3] if len(w) > 1 else 0)
        fault, initial = divmod(code, 4)
        legal = before is None or (before, initial) in ((0, 1), (1, 2), (2, 1))
        n = self.count[-4:]
        self.count.extend([n[0] + (fault == _BLANK), n[1] + (fault == _COPY), n[2] + (fault == _CUT), n[3] + (not legal)])

    def answer(self) -> tuple[int, str, int, int, int, int]:
        """cost, audit, blank, duplicate, truncated, illegal of the signature."""
        ends = [(self.cost[-4:][s] + n * INSERT, self.rank[-4:][s], s) for s, n in _CLOSING.items() if self.cost[-4:][s] < _FAR]
        cost, _, state = min(ends)
        parts = ["I" * _CLOSING[state]]
        for at in range(len(self.cost) - 4, 0, -4):
            parts.append(_EDITS[self.edit[at + state]])
            state = self.came[at + state]
        return cost, "".join(parts[::-1]), *self.count[-4:]


class Repair:
    """A conversation's turns, taken one by one with the edits at hand -> the digest of what is left."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.first = audit, 0, START, True
        self.digest = hashlib.sha256()

    def _put(self, role: str, text: str) -> None:
        if not self.first:
            self.digest.update(b"\n")
        self.first = False
        self.digest.update(f"{role}:{text}".encode())

    def _made(self, text: str) -> None:
        self.state = wanted(self.state)
        self._put("user" if self.state == USER else "assistant", text)

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._made("")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = next_state(self.state, _INITIALS.index(role[0]))
            self._put(role, text)
        elif edit == "R":
            self._made(text)

    def end(self) -> str:
        self._insert()
        return self.digest.hexdigest()


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> the same with nulls of role and text as one blank and, by crc32(conv_id:turn) % 20 (nulls:
    one blank): 0 dropped, 1 text emptied, 2 without `.!?`, 3 twice, 4 role user."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind, text = F.col("kind"), F.coalesce(F.col("text"), F.lit(" "))
    return (
        turns.select("conv_id", "turn", "role", "text", (F.crc32(name.cast("binary")) % 20).alias("kind"))
        .where(kind != 0)
        .select(
            "conv_id",
            "turn",
            F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role"), F.lit(" "))).alias("role"),
            F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
            F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
        )
        .drop("copy")
    )


def _key(conv_id: str = "conv_id") -> Column:
    """A conversation's name that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit("-"))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, initial, fault, first, n) -> key, signature."""
    last, parts = None, []
    for b in batches:
        keys, signatures = [], []
        for key, initial, fault, first, n in zip(*[c.to_pylist() for c in b.columns]):
            if key != last:
                if parts:
                    keys.append(last)
                    signatures.append("".join(parts))
                last, parts = key, []
            if fault == _BLANK:
                parts.append(letter(initial, _BLANK) * n)
            elif first:
                parts.append(letter(initial, fault) + letter(initial, _COPY) * (n - 1))
            else:
                parts.append(letter(initial, _COPY) * n)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(signatures, pa.string())], names=["key", "signature"])
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array(["".join(parts)])], names=["key", "signature"])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted signatures -> their answers."""
    branch = Branch()
    names = ["signature", "cost", "audit", "blank", "duplicate", "truncated", "illegal"]
    for b in batches:
        rows = []
        for s in b.column(0).to_pylist():
            branch.go(s)
            rows.append((s, *branch.answer()))
        cols = [pa.array([r[i] for r in rows], pa.string() if i in (0, 2) else pa.int64()) for i in range(7)]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, audit, role, text), where a conversation's edits stand in front of its turns -> key, digest."""
    last, work = None, None
    for b in batches:
        keys, digests = [], []
        for key, audit, role, text in zip(*[c.to_pylist() for c in b.columns]):
            if audit is None:
                work.turn(role, text)
                continue
            if work:
                keys.append(last)
                digests.append(work.end())
            last, work = key, Repair(audit)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(digests, pa.string())], names=["key", "repaired_sha256"])
    if work:
        yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([work.end()])], names=["key", "repaired_sha256"])


def repair(turns: DataFrame, damage: bool = True) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row
    for every conversation. With damage, turns are damaged first (see damaged)."""
    spark = turns.sparkSession
    prepare(spark)
    folder = scratch(spark, "conversations")
    named = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    if damage:
        rows = damaged(named)
    else:
        rows = named.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.select(_key().alias("key"), "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"))

    bare = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(bare == "", _BLANK).when(F.substring(bare, -1, 1).isin(".", "!", "?"), _CLEAN).otherwise(_CUT)
    narrow = rows.groupBy("key", "turn", "role", "digest", fault.alias("fault")).agg(F.count(F.lit(1)).alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    narrow = saved(narrow.withColumn("place", place), f"{folder}/turns")
    marked = with_group(narrow, ["key", "role", "digest"], "turn", [F.min("place").alias("low")], [F.min("low").alias("low")])
    marked = marked.select("key", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), "fault", F.col("place").eqNullSafe(F.col("low")).alias("first"), "n")
    sorted_ = marked.repartition("key").sortWithinPartitions("key", *_order()).select("key", "initial", "fault", "first", "n")
    signed = saved(sorted_.mapInArrow(_signatures, "key string, signature string"), f"{folder}/signed")

    distinct = saved(signed.select("signature").distinct(), f"{folder}/distinct")
    walk = distinct.repartitionByRange("signature").sortWithinPartitions("signature")
    answers = saved(walk.mapInArrow(_answers, "signature string, cost long, audit string, blank long, duplicate long, truncated long, illegal long"), f"{folder}/answers")
    told = saved(with_told(signed, answers, ["signature"], "key").drop("signature"), f"{folder}/told")

    edits = told.select("key", "audit", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(None).cast("binary").alias("digest"))
    both = edits.union(rows.select("key", F.lit(None).cast("string"), "turn", "role", "text", "digest"))
    both = both.repartition("key").sortWithinPartitions("key", F.col("audit").isNull(), *_order()).select("key", "audit", "role", "text")
    digests = saved(both.mapInArrow(_repaired, "key string, repaired_sha256 string"), f"{folder}/repaired")

    wide = "decimal(38,0)"
    far = F.max(F.col("turn").cast(wide)) - F.min(F.col("turn").cast(wide)) + 1 - F.count("turn")
    gaps = narrow.select("key", "turn").distinct().groupBy("key").agg(F.least(F.coalesce(far, F.lit(0).cast(wide)), F.lit((1 << 63) - 1).cast(wide)).cast("long").alias("gaps"))
    gaps = saved(gaps, f"{folder}/gaps")
    for name in ("turns", "signed", "distinct", "answers"):
        remove(spark, f"{folder}/{name}")
    none = F.lit(hashlib.sha256().hexdigest())
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    every = named.select("conv_id").distinct().withColumn("key", _key())
    return every.join(told, "key", "left").join(digests, "key", "left").join(gaps, "key", "left").select(
        "conv_id",
        *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", none).alias("repaired_sha256"),
    )
