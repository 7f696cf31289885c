"""Sentence pieces against the library, with the vocabulary as it is and with other settings appended to the model."""

import random
import re
import struct

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import types as T

from skein.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
WHOLE = open(PATH, "rb").read()


def field(number, value):
    def varint(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes(out) + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def compiled(rules):
    """A character map: the double array of a small trie, and its replacements."""
    texts, places = b"", {}
    for key, text in rules.items():
        places[key.encode()] = len(texts)
        texts += text.encode() + b"\0"
    units, free = {0: 0}, 1

    def put(node, prefix):
        nonlocal free
        below = sorted({k[len(prefix)] for k in places if k.startswith(prefix) and len(k) > len(prefix)})
        want = below + [0] * (prefix in places)
        base = free
        while any(base ^ b in units for b in want):
            base += 1
        free = base if len(want) < 2 else base + 1
        units[node] = units[node] | (node ^ base) << 10 | (256 if prefix in places else 0)
        if prefix in places:
            units[base] = places[prefix] | 1 << 31
        for b in below:
            units[base ^ b] = b
        for b in below:
            put(base ^ b, prefix + bytes([b]))

    put(0, b"")
    size = -(-(max(units) + 256) // 256) * 256
    trie = struct.pack(f"<{size}I", *[units.get(i, 1 << 31) for i in range(size)])
    return struct.pack("<I", len(trie)) + trie + texts


RULES = {"ﬁ": "fi", "A": "a", "\t": " ", "é": "e", "xy": "z", "xyz": " ", "  ": " ", "漢": "han ", "b": "", "́": ""}
MAP = field(3, field(2, compiled(RULES)))
CASES = {
    "as it is": b"",
    "map": MAP,
    "map, blanks squeezed": MAP + field(3, field(4, 1)),
    "blanks squeezed, no mark in front": field(3, field(4, 1) + field(3, 0)),
    "no mark in front": field(3, field(3, 0)),
    "no byte pieces": field(2, field(35, 0)),  # see below
    "user-defined": field(1, field(1, b"<sep>") + field(2, 0.0) + field(3, 4)) + field(1, field(1, "a▁b".encode()) + field(2, 0.0) + field(3, 4)),
    "user-defined with map": field(1, field(1, b"xy hello") + field(2, 0.0) + field(3, 4)) + MAP,
    "unused": field(1, field(1, b"zqj") + field(2, -1.0) + field(3, 5)) + field(1, field(1, b"zq") + field(2, -2.0) + field(3, 5)) + field(1, field(1, b"zqjzq") + field(2, -3.0)),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_as_the_library(case):
    data = WHOLE + CASES[case]
    if case == "no byte pieces":
        data = re.sub(rb"(?s)(\n\x06<0x..>\x15....)\x18\x06", lambda m: m[1] + b"\x18\x03", data)  # they become control pieces
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    model = pieces.PieceModel(data)
    r = random.Random(case)
    parts = [" ", "  ", "\t", "\n", "▁", "a", "b", "A", "hello", "the", "xy", "xyz", "ﬁ", "é", "漢", "😀", "<s>", "<sep>", "a b", "zqj", "zq", "xy hello", "́", "\0", "ß", "�", "<0x0A>", "."]
    for k in range(600):
        text = "".join(r.choice(parts) for _ in range(r.choice([0, 1, 2, 5, 20, 120])))
        ids, begins, ends = model.encode(text)
        want = library.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in want] and model.decimals(ids).decode() == ",".join(map(str, ids.tolist())), text
        assert list(zip(begins.tolist(), ends.tolist())) == [(p.begin, p.end) for p in want], text
        assert model.decode(ids.tolist()) == library.decode(ids.tolist()), text
        some = [r.randrange(270) if r.random() < 0.6 else r.randrange(len(model.pieces)) for _ in range(r.randrange(9))]
        assert model.decode(some) == library.decode(some), some


def test_plain_places_are_the_alignment():
    model = pieces.PieceModel(WHOLE)
    for text in ["", " ", "a", "  é 漢😀  x ", " \n ▁ "]:
        normal, align = model.normalise(text.encode())
        assert (normal, align.tolist()) == (model._by_rules(text.encode())[0] if text else b"", (model._by_rules(text.encode())[1] if text else align).tolist())
        ids, begins, ends = model.encode(text)
        at = 0
        for i, b, e in zip(ids.tolist(), begins.tolist(), ends.tolist()):
            n = len(model.pieces[i]) if model.kinds[i] != pieces.BYTE else 0
            if n:
                assert (align[at], align[at + n]) == (b, e)
                at += n
            else:
                break


def test_generations_of_chunks(monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    monkeypatch.setattr(pieces, "CHUNKS", 5)
    model = pieces.PieceModel(WHOLE)
    r = random.Random(2)
    for _ in range(200):
        text = " ".join(r.choice(["one", "two.", "three\n", "four,five", "x", "y", "Ünder", "漢字.", "e.g."]) for _ in range(9))
        assert model.encode(text)[0].tolist() == library.encode(text)
        assert len(model.chunks) <= 5 and len(model.chunks.old) <= 5


def test_long_chunks():
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    model = pieces.PieceModel(WHOLE)
    for text in ["ab" * 30_000, " " * 50_000, "漢字" * 5_000, "thequickbrownfox" * 4_000]:
        assert model.encode(text)[0].tolist() == library.encode(text)


def test_other_models_are_refused():
    for more in (field(2, field(3, 1)), field(2, field(24, 1)), field(5, field(2, b"x"))):
        with pytest.raises(ValueError):
            pieces.PieceModel(WHOLE + more)


def test_frames(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    schema = T.StructType.fromDDL("doc_id long, text string, ids string, Text2 int")
    texts = [None, "", "a b", "a b", " x\n漢" * 2000, "hello"]
    rows = [(i if i else None, t, "other", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, schema)
    got = pieces.encode(docs, PATH)
    assert [r.ids for r in got.collect()] == [library.encode(t or "") for t in texts]
    assert [r.text for r in pieces.decode(got, PATH).collect()] == [library.decode(library.encode(t or "")) for t in texts]
    digests = pieces.encode_decode(docs, PATH).collect()
    assert [r.doc_id for r in digests] == [None, 1, 2, 3, 4, 5] and all(r.covered for r in digests)
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests] == [
        (len(i), sha(",".join(map(str, i))), sha(library.decode(i))) for i in (library.encode(t or "") for t in texts)
    ]
    assert pieces.encode_decode(docs.limit(0), PATH).collect() == []
