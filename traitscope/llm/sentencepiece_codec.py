"""SentencePiece models on the tokenizers library.

The model file's protobuf is read field by field; normaliser, metaspace marker, scores (unigram) or
merges (BPE) and byte fallback are rebuilt as a tokenizer, batches of texts are encoded by several
threads, and the ids are held against the sentencepiece library.

Where the model neither rewrites characters nor has a piece with the marker behind another
character, no piece crosses a blank that follows a non-blank. Texts are then cut there, and every
distinct unit is encoded once while there is room. Other models encode whole texts.

Defined cases: null and empty texts have no ids; a marker character in a text reads as a blank, as
in the library; null doc_ids and repeated rows are encoded one by one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitscope.llm.common import trimmed, whole
from traitscope.llm.tokens import LONGEST, ROOM, alone, encode_units, opening_ids, slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
CUT, GLUED = re.compile(f"(?<=[^ {MARK}]) "), re.compile(f"^ |[ {MARK}] ")


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed-width values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind in (1, 2, 5):
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {kind}")


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def parse_model(data: bytes) -> Model:
    """Pieces, trainer and normaliser settings of a serialized model."""
    out = Model()
    for number, value in wire(data):
        if number == 1:
            piece = dict(wire(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            out.pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(wire(value))
            out.kind = trainer.get(3, UNIGRAM)
            out.byte_fallback = bool(trainer.get(35, 0))
        elif number == 3:
            rules = dict(wire(value))
            out.charsmap = rules.get(2, b"")
            out.dummy_prefix, out.remove_extra, out.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
    return out


def merges_of(model: Model) -> list[tuple[str, str]]:
    """Merges in the order of the merged piece's score; splits of one piece by the ids of their parts."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
    out = []
    for piece, at in ids.items():
        for i in range(1, len(piece)):
            if piece[:i] in ids and piece[i:] in ids:
                out.append((-model.pieces[at][1], at, ids[piece[:i]], ids[piece[i:]], piece[:i], piece[i:]))
    return [m[4:] for m in sorted(out)]


def build(model: Model, prefix: bool | None = None):
    """A tokenizer with the model's ids. ``prefix`` overrides the marker in front of a text."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    unk = model.pieces[model.unknown][0]
    if model.kind == BPE:
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocabulary, merges_of(model), unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unknown, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix if prefix is None else prefix:
        steps.append(normalizers.Prepend(MARK))
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    last = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *last])
    user = [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER]
    if user:
        out.add_tokens(user)
    return out


class Codec:
    """Encode and decode batches of texts with a model file's content."""

    def __init__(self, data: bytes, threads: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = parse_model(data)
        self.by_unit = (
            self.model.dummy_prefix
            and not self.model.charsmap
            and not self.model.remove_extra
            and not any(MARK in p.lstrip(MARK) for p, _, kind in self.model.pieces if kind in (NORMAL, USER))
            and not any(kind == USER for *_, kind in self.model.pieces)
        )
        self.tokenizer = build(self.model, prefix=False if self.by_unit else None)
        self.opens = opening_ids(self.tokenizer, MARK)
        self.units: dict[str, bytes] = {}
        self.bytes_of = [self._piece(p, kind) for p, _, kind in self.model.pieces]

    @staticmethod
    def _piece(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        return {CONTROL: b"", UNKNOWN: " ⁇ ".encode()}.get(kind, piece.replace(MARK, " ").encode())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, as bytes."""
        if not self.by_unit:
            return [x if t else b"" for t, x in zip(texts, alone(self.tokenizer, texts))]
        if len(self.units) > ROOM:
            self.units.clear()
        cut = [(CUT.split(t) if GLUED.search(t) else t.split(" ")) if t else [] for t in texts]
        missing = [u for u in set().union(*cut) if u not in self.units]
        known = self.units
        known.update(zip(missing, encode_units(self.tokenizer, self.opens, missing, " " + MARK)))
        out = [b"".join(map(known.__getitem__, units)) for units in cut]
        for u in missing:
            if len(u) > LONGEST:
                del known[u]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: the pieces' bytes, without the blank of the prefix."""
        data = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        if self.model.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


_codecs: dict[str, tuple] = {}


def _codec(path: str, threads: int):
    if path not in _codecs:
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        _codecs[path] = Codec(data, threads), sentencepiece.SentencePieceProcessor(model_proto=data)
    return _codecs[path]


def _code(path: str, threads: int, check: bool, keep: bool):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, library = _codec(path, threads)
        for batch in source:
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            for a, b in slices(sizes):
                part = batch.slice(a, b - a)
                texts = part.column(1).to_pylist()
                coded = codec.encode(texts)
                ids = [np.frombuffer(x, "<u4") for x in coded]
                same = [t.replace(MARK, " ") == codec.decode(x) for t, x in zip(texts, ids)] if codec.by_unit else [None] * len(texts)
                equal = [x.tolist() == y for x, y in zip(ids, library.encode(texts, num_threads=threads))] if check else [None] * len(texts)
                columns = [
                    part.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x) for x in coded], pa.int64()),
                    pa.array(same, pa.bool_()),
                    pa.array(equal, pa.bool_()),
                ]
                names = ["doc_id", "n_tokens", "ids_crc32", "round_trip", "parity"]
                if keep:
                    columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def sentencepiece_code(docs: DataFrame, model: str, threads: int = 2, check: bool = True, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, round_trip (decoding gives the text back; null where the model
    rewrites texts), parity (the sentencepiece library gives the same ids; null without ``check``), and
    the ids if asked for, of every row of ``docs``. No shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    schema = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean"
    return rows.mapInArrow(trimmed(_code(model, threads, check, keep_ids)), schema + (", ids array<int>" if keep_ids else ""))


def _decode(path: str, threads: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, _ = _codec(path, threads)
        for batch in source:
            texts = [None if x is None else codec.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def sentencepiece_decode(coded: DataFrame, model: str, threads: int = 2) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""
    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(trimmed(_decode(model, threads)), "doc_id long, text string")
