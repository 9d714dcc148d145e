"""SentencePiece encoding with the place of every piece in the source text.

The text is normalised here, by the longest prefixes of the model's compiled
character map, and the source byte of every normalised byte is kept. The
sentencepiece library then segments the normalised text with the same model
without its normaliser. So ids equal the library's own, and each piece maps
back to a span of source bytes.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolekta.llm.common import fresh, read_table, with_text_columns

SPACE = "▁".encode()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _fields(data: bytes):
    """(number, value, raw bytes) of each field of a protocol buffer message."""
    i = 0

    def number():
        nonlocal i
        v = shift = 0
        while True:
            b = data[i]
            i += 1
            v |= (b & 127) << shift
            shift += 7
            if b < 128:
                return v

    while i < len(data):
        start, tag = i, number()
        kind = tag & 7
        if kind == 0:
            v = number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            v = data[i:i + size]
            i += size
        yield tag >> 3, v, data[start:i]


class CharMap:
    """The compiled character map: a double-array trie of prefixes and their replacements."""

    def __init__(self, blob: bytes):
        self.units, self.texts = (), b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, length) of the longest prefix of text[at:] in the map."""
        if not self.units:
            return None
        node, found = self._child(0), None
        for k in range(at, len(text)):
            c = text[k]
            node ^= c
            unit = self.units[node] if node < len(self.units) else 0
            if unit & 0x800000FF != c:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = self.texts[start:self.texts.index(0, start)], k + 1 - at
        return found

    def _child(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & 512) >> 6))


class Codec:
    """Encodes and decodes with one SentencePiece model, given as its serialized bytes."""

    def __init__(self, model: bytes):
        import numpy as np
        import sentencepiece
        pieces, spec, suffix, rest = [], b"", False, []
        for n, v, raw in _fields(model):
            if n == 1:
                pieces.append({a: b for a, b, _ in _fields(v)})
            elif n == 2:
                suffix = any(a == 24 and b for a, b, _ in _fields(v))
            if n == 3:
                spec = v
            else:
                rest.append(raw)
        flags = {3: 1, 4: 1, 5: 1} | {a: b for a, b, _ in _fields(spec)}
        self.map = CharMap(flags.get(2, b""))
        self.prefix, self.trim, self.escape, self.suffix = bool(flags[3]), bool(flags[4]), bool(flags[5]), suffix
        self.own = sorted((p[1] for p in pieces if p.get(3, 1) == 4), key=len, reverse=True)
        identity = bytes([10, 8]) + b"identity" + bytes([24, 0, 32, 0, 40, 0])
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.segment = sentencepiece.SentencePieceProcessor(
            model_proto=b"".join(rest) + bytes([26]) + _varint(len(identity)) + identity)
        self.size = np.array([1 if p.get(3, 1) == 6 else len(p.get(1, b"")) for p in pieces], np.int64)
        self.unknown, self.ends = self.library.unk_id(), (self.library.bos_id(), self.library.eos_id())

    def _next(self, text: bytes, at: int) -> tuple[bytes, int]:
        """(replacement, source bytes) of the longest prefix that the model knows, else of one character."""
        for s in self.own:
            if text.startswith(s, at):
                return s, len(s)
        found = self.map.longest(text, at)
        if found:
            return found
        c = text[at]
        size = 1 if c < 0xC0 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
        return text[at:at + size], size

    def normalise(self, text: bytes):
        """(normalised bytes, the source byte where each of them begins, and the end)."""
        import numpy as np
        if not self.map.units and not self.own and not self.trim and not self.suffix and self.escape:
            if not text:
                return b"", np.zeros(1, np.int64)
            b = np.frombuffer(text, np.uint8)
            at = np.repeat(np.arange(len(b)), np.where(b == 32, len(SPACE), 1))
            lead = SPACE if self.prefix else b""
            return lead + text.replace(b" ", SPACE), np.concatenate([np.zeros(len(lead), np.int64), at, [len(b)]])
        return self._normalise(text)

    def _normalise(self, text: bytes):
        import numpy as np
        space = SPACE if self.escape else b" "
        i, out, at = 0, bytearray(), []
        while self.trim and i < len(text):
            s, size = self._next(text, i)
            if s != b" ":
                break
            i += size
        if i == len(text):
            return b"", np.array([len(text)])
        if self.prefix and not self.suffix:
            out += space
            at += [i] * len(space)
        after_space = self.trim
        while i < len(text):
            s, size = self._next(text, i)
            while after_space and s.startswith(b" "):
                s = s[1:]
            if s:
                put = s.replace(b" ", space)
                out += put
                at += range(i, i + len(put)) if s == text[i:i + size] and len(put) == size else [i] * len(put)
                after_space = s.endswith(b" ")
            i += size
            after_space = after_space and self.trim
        end = len(text)
        while self.trim and out.endswith(space):
            del out[-len(space):]
            end = at[len(out)]
            del at[len(out):]
        if self.suffix and self.prefix:
            out += space
            at += [end] * len(space)
        return bytes(out), np.array([*at, end])

    def encode(self, texts: list[bytes], spans: bool = True):
        """[(ids, begins, ends)] with begin and end ids; the pieces' spans are
        source bytes [begin, end), empty for ids that stand for no text."""
        import numpy as np
        normal = [self.normalise(t) for t in texts]
        out = []
        for (n, at), ids in zip(normal, self.segment.encode([n.decode() for n, _ in normal], num_threads=1)):
            ids = np.array(ids, np.int64)
            begins = ends = None
            if spans:
                size = self.size[ids]
                if (ids == self.unknown).any():
                    size = np.array([1 if self.segment.is_byte(int(i)) else len(p.encode()) for i, p in
                                     zip(ids, self.segment.encode(n.decode(), out_type=str))], np.int64)
                stop = np.cumsum(size)
                if len(stop) and stop[-1] != len(n):
                    raise ValueError("pieces do not cover the normalised text")
                begins, ends = at[stop - size], at[stop]
            first, last = ([e] if e >= 0 else [] for e in self.ends)
            if spans:
                end = int(at[-1])
                begins = np.concatenate([[0] * len(first), begins, [end] * len(last)])
                ends = np.concatenate([[0] * len(first), ends, [end] * len(last)])
            out.append((np.concatenate([first, ids, last]).astype(np.int64), begins, ends))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1)


def default_model() -> bytes:
    """The 32k model of the installed public tokenizer files."""
    import public_tokenizers
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


KINDS = {"n_tokens": "long", "ids": "array<int>", "begins": "array<int>", "ends": "array<int>", "decoded": "string",
         "ids_sha256": "string", "spans_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, model: bytes | None = None, want: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with the columns ``want`` (kind of KINDS: column name; default all but the digests).

    ids carry begin and end ids; begins and ends are byte spans of the UTF-8
    source; decoded is the library's decode(ids). Digests are SHA-256 in
    lowercase hex: of the ids as little-endian unsigned 32-bit integers, of
    the begins then ends likewise, of the decoded UTF-8. Null text counts as
    empty; every other column passes through, and a new one whose name is
    taken gets underscores behind it.
    """
    want = want or {k: k for k in KINDS if not k.endswith("sha256")}
    taken = list(docs.columns)
    for kind, name in want.items():
        want = want | {kind: fresh(taken, name)}
        taken.append(want[kind])
    held = docs.sparkSession.sparkContext.broadcast(model or default_model())
    state: dict = {}

    def compute(texts):
        import hashlib

        import numpy as np
        codec = state.get("codec") or state.setdefault("codec", Codec(held.value))

        def digest(*arrays):
            return hashlib.sha256(b"".join(np.asarray(a).astype("<u4").tobytes() for a in arrays)).hexdigest()

        got = codec.encode(texts, spans=bool({"begins", "ends", "spans_sha256"} & set(want)))
        text = codec.decode([x[0].tolist() for x in got]) if {"decoded", "decoded_sha256"} & set(want) else []
        make = {
            "n_tokens": lambda: [len(x[0]) for x in got], "ids": lambda: [x[0].astype(np.int32) for x in got],
            "begins": lambda: [x[1].astype(np.int32) for x in got], "ends": lambda: [x[2].astype(np.int32) for x in got],
            "decoded": lambda: text, "ids_sha256": lambda: [digest(x[0]) for x in got],
            "spans_sha256": lambda: [digest(x[1], x[2]) for x in got],
            "decoded_sha256": lambda: [hashlib.sha256(t.encode()).hexdigest() for t in text]}
        return [make[k]() for k in want]

    return with_text_columns(docs, {v: KINDS[k] for k, v in want.items()}, compute)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: lengths and digests of the ids, decoded texts and spans of every document."""
    want = ("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256")
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return encode(docs, want={k: k for k in want}).drop("text")
