"""SentencePiece encoding and decoding with source offsets.

The model's own normaliser is applied by longest-prefix lookups in its compiled character map (a double-array trie over
UTF-8 bytes followed by a pool of replacements). Each normalised byte keeps the source byte it comes from, so every
piece of the encoded text projects to a span of original bytes. The library only merges: it gets the normalised text and a
copy of the model whose own normalisation is taken out.

Cases: a null or empty text has no pieces and decodes to the empty text. Very long texts are encoded whole. Repeated
rows give repeated rows. Other columns of the input are ignored. A text in which invalid UTF-8 stands is decoded with
replacement characters first.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_schema, id_and_bytes, slices

SPACE = "▁".encode()


def fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(blob):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, blob[at : at + n]
            at += n


class Normaliser:
    """A model's normaliser: `spec` is its NormalizerSpec message."""

    def __init__(self, spec: bytes):
        got = dict(fields(spec))
        self.dummy_prefix, self.squeeze, self.escape = (bool(got.get(n, 1)) for n in (3, 4, 5))
        charsmap = got.get(2, b"")
        self.units, self.pool = None, b""
        if charsmap:
            (n,) = struct.unpack_from("<I", charsmap)
            self.units = struct.unpack_from(f"<{n // 4}I", charsmap, 4)
            self.pool = charsmap[4 + n :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key of the character map that `text` has at `at`."""
        units, best = self.units, None
        node = 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for k in range(at, len(text)):
            byte = text[k]
            node ^= byte
            unit = units[node]
            if unit & ((1 << 31) | 0xFF) != byte:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                best = (k + 1 - at, self.pool[value : self.pool.index(b"\0", value)])
        return best

    def mapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Replaced text, and for each of its bytes and its end the source byte from which it comes."""
        if self.units is None:
            return text, np.arange(len(text) + 1)
        out, source, at = bytearray(), [], 0
        while at < len(text):
            first = text[at]
            n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            n, new = self.longest(text, at) or (n, text[at : at + n])
            out += new
            source += [at] * len(new)
            at += n
        return bytes(out), np.array([*source, len(text)])

    def normal(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised text and source bytes, with one more entry for the end."""
        got, source = self.mapped(text)
        if self.squeeze:
            raw = np.frombuffer(got, np.uint8)
            blank = raw == 32
            keep = ~blank | np.concatenate([[False], ~blank[:-1]]) if len(raw) else blank
            if len(keep):
                inside = np.flatnonzero(~blank)
                keep[: inside[0] if len(inside) else None] = False
                keep[inside[-1] + 1 if len(inside) else 0 :] = False
            got, end = raw[keep].tobytes(), source[-1:] if not len(raw) or keep.all() else source[[np.flatnonzero(keep)[-1] + 1 if keep.any() else -1]]
            source = np.concatenate([source[:-1][keep], end])
        if self.dummy_prefix and got:
            got, source = b" " + got, np.concatenate([source[:1], source])
        if self.escape:
            wide = np.ones(len(source), np.int64)
            wide[:-1][np.frombuffer(got, np.uint8) == 32] = len(SPACE)
            got, source = got.replace(b" ", SPACE), np.repeat(source, wide)
        return got, source


def message(number: int, value: bytes) -> bytes:
    """A field of a protocol buffer message that holds a message."""
    head, n = bytes([number << 3 | 2]), len(value)
    while n > 127:
        head, n = head + bytes([n & 127 | 128]), n >> 7
    return head + bytes([n]) + value


#: A normaliser's message that changes nothing: no character map, no prefix, blanks neither removed nor escaped.
NO_NORMALISER = bytes([3 << 3, 0, 4 << 3, 0, 5 << 3, 0])


class Encoder:
    """The model's normaliser, the library's merges over what it makes, and the alignment of the pieces."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        rest = b"".join(message(n, v) for n, v in fields(model) if n in (1, 2))
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=rest + message(3, NO_NORMALISER))
        pieces, spec, byte_fallback = [], b"", 0
        for n, value in fields(model):
            if n == 1:
                pieces.append(dict(fields(value)))
            elif n == 2:
                byte_fallback = dict(fields(value)).get(35, 0)
            elif n == 3:
                spec = value
        self.normaliser = Normaliser(spec)
        #: Bytes of normalised text for each id; a piece for a byte is one byte.
        self.sizes = np.array([1 if p.get(3, 1) == 6 else len(p.get(1, b"")) for p in pieces])
        self.aligned = bool(byte_fallback)
        self.shown = [str(k) for k in range(len(pieces))]

    def encode(self, text: bytes) -> tuple[list[int], np.ndarray]:
        """Ids, and the source bytes at which pieces begin, and the end: piece k is text[bounds[k]:bounds[k + 1]]."""
        normal, source = self.normaliser.normal(text)
        ids = self.merges.encode(normal.decode(), num_threads=1) if normal else []
        if not ids:
            return [], source[-1:]
        if self.aligned:
            ends = np.cumsum(self.sizes[ids])
        else:
            ends = np.cumsum([len(p.surface.encode()) for p in self.merges.encode(normal.decode(), out_type="immutable_proto").pieces])
        if ends[-1] != len(normal):
            raise ValueError(f"{ends[-1]} bytes of pieces over {len(normal)} bytes of normalised text")
        return ids, np.concatenate([source[:1], source[ends]])

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids) if ids else ""


def well_formed(text: bytes) -> bytes:
    """The text with replacement characters where it isn't UTF-8."""
    return text.decode("utf-8", "replace").encode()


@lru_cache(2)
def encoder(model: bytes) -> Encoder:
    return Encoder(model)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (array<int>), starts (array<long>: first source byte of each piece, then the end of the last), decoded.

    `model` is the path of a SentencePiece model; the driver reads it, and tasks carry its bytes (under a megabyte)."""

    def work(coder: Encoder, texts: list[bytes]) -> dict[str, list]:
        got = [coder.encode(t) for t in texts]
        return {"ids": [x for x, _ in got], "starts": [x for _, x in got], "decoded": [coder.decode(x) for x, _ in got]}

    return _per_text(docs, model, "doc_id long,ids array<int>,starts array<long>,decoded string", work)


def encode_ids(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), starts (as `encode`), round_trip (whether the ids decode to the text)."""

    def work(coder: Encoder, texts: list[bytes]) -> dict[str, list]:
        got = [coder.encode(t) for t in texts]
        return {"n_tokens": [len(x) for x, _ in got], "ids": [x for x, _ in got], "starts": [x for _, x in got], "round_trip": [coder.decode(x).encode() == t for t, (x, _) in zip(texts, got)]}

    return _per_text(docs, model, "doc_id long,n_tokens long,ids array<int>,starts array<long>,round_trip boolean", work)


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """As `encode`, with digests for the columns that are longer than the text: n_tokens, ids_sha256, decoded_sha256, starts_sha256."""

    def work(coder: Encoder, texts: list[bytes]) -> dict[str, list]:
        digest, got = lambda b: hashlib.sha256(b).hexdigest(), [coder.encode(t) for t in texts]
        return {
            "n_tokens": [len(x) for x, _ in got],
            "ids_sha256": [digest(",".join([coder.shown[k] for k in x]).encode()) for x, _ in got],
            "decoded_sha256": [digest(coder.decode(x).encode("utf-8", "replace")) for x, _ in got],
            "starts_sha256": [digest(x.astype("<i8").tobytes()) for _, x in got],
        }

    return _per_text(docs, model, "doc_id long,n_tokens long,ids_sha256 string,decoded_sha256 string,starts_sha256 string", work)


def _per_text(docs: DataFrame, model: str, schema: str, work) -> DataFrame:
    names = [c.split()[0] for c in schema.split(",")]
    kinds = arrow_schema(schema)
    with open(model, "rb") as f:
        blob = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(blob)
        for batch in batches:
            for part in slices(batch, 4 << 20):
                made = work(coder, [well_formed(t or b"") for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0) if n == "doc_id" else pa.array(made[n], kinds.field(n).type) for n in names], names=names)

    return id_and_bytes(docs).mapInArrow(run, schema)
