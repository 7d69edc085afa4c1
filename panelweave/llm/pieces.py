"""SentencePiece encoding and decoding with piece scores: one pass of an Aho-Corasick automaton.

The automaton reports, at each character, all pieces that end there (it follows the output
links); each relaxes the best score of that place from the place where it begins. The best
path is the segmentation with the highest total score. Ties go to the longer last piece.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of, tidy, worker_state

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
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
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass(frozen=True)
class PieceModel:
    """Pieces (text, score, type) in the order of their ids, and how texts are prepared."""

    pieces: tuple[tuple[str, float, int], ...]
    dummy_prefix: bool = True
    byte_fallback: bool = True

    @staticmethod
    def load(path: str) -> PieceModel:
        """Read a model file; only the identity normalizer that keeps extra blanks is supported."""
        pieces, prefix, fallback = [], True, False
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    part = dict(_fields(value))
                    score = struct.unpack("<f", part[2])[0] if 2 in part else 0.0
                    pieces.append((part[1].decode(), score, part.get(3, _NORMAL)))
                elif number == 2:
                    fallback = bool(dict(_fields(value)).get(35, 0))
                elif number == 3:
                    norm = dict(_fields(value))
                    prefix = bool(norm.get(3, 1))
                    if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1):
                        raise ValueError("only identity normalization without blank removal is supported")
        return PieceModel(tuple(pieces), prefix, fallback)


@dataclass
class PieceCodec:
    """Encoder and decoder of a model.

    No piece holds a blank after another character, so a text's best path passes through the
    place before each blank that follows one; characters that no piece holds part it too.
    Segments between such places are therefore solved apart, and short ones remembered.
    """

    model: PieceModel
    limit: int = 500_000
    known: dict[str, tuple[bytes, int, float]] = field(default_factory=dict)

    def __post_init__(self):
        import ahocorasick

        self.automaton, self.byte_ids, alphabet, scores = ahocorasick.Automaton(), {}, set(), []
        self.single: set[str] = set()
        self.unknown_id = 0
        for i, (text, score, kind) in enumerate(self.model.pieces):
            if kind in (_NORMAL, _USER):
                self.automaton.add_word(text, (len(text), score, i))
                alphabet |= set(text)
                scores.append(score)
                if len(text) == 1:
                    self.single.add(text)
            elif kind == _BYTE:
                self.byte_ids[int(text[3:5], 16)] = i
            elif kind == _UNKNOWN:
                self.unknown_id = i
        self.automaton.make_automaton()
        self.matches = self.automaton.iter if len(self.automaton) else lambda text: ()
        self.penalty = min(scores, default=0.0) - 10
        inner = any(SPACE in text.lstrip(SPACE) for text, _, kind in self.model.pieces if kind in (_NORMAL, _USER))
        alone = "" if "\n" in alphabet else "\n"
        self.cut = re.compile(f" *[^ {alone}]+| +|{alone or chr(10)}") if not inner else re.compile(r"(?s).+")
        self.texts = [text.replace(SPACE, " ") if kind in (_NORMAL, _USER) else "" for text, _, kind in self.model.pieces]
        self.of_byte = {i: b for b, i in self.byte_ids.items()}

    def prepare(self, text: str) -> str:
        """The text as it is encoded, with blanks for the model's own sign."""
        text = text.replace(SPACE, " ")
        return " " + text if text and self.model.dummy_prefix else text

    def _segment(self, segment: str) -> tuple[bytes, int, float]:
        """Ids (u32 bytes), their number, and the score of a segment."""
        text = segment.replace(" ", SPACE)
        n = len(text)
        best, begin, piece = [0.0] + [-float("inf")] * n, [0] * (n + 1), [-1] * (n + 1)
        single, penalty, at = self.single, self.penalty, 0

        def unknowns(upto: int) -> None:
            """Places up to `upto` (exclusive) that no match has reached yet get their unknown character."""
            nonlocal at
            while at < upto:
                if text[at] not in single and best[at] + penalty > best[at + 1]:
                    best[at + 1], begin[at + 1], piece[at + 1] = best[at] + penalty, at, -1
                at += 1

        for end, (length, score, i) in self.matches(text):
            if at < end:
                unknowns(end)
            start = end + 1 - length
            total = best[start] + score
            if total > best[end + 1] or (total == best[end + 1] and start < begin[end + 1]):
                best[end + 1], begin[end + 1], piece[end + 1] = total, start, i
        unknowns(n)
        ids, place = [], n
        while place:
            start = begin[place]
            if piece[place] >= 0:
                ids.append(piece[place])
            elif self.model.byte_fallback and self.byte_ids:
                ids += [self.byte_ids[b] for b in reversed(text[start:place].encode("utf-8", "surrogatepass"))]
            else:
                ids.append(self.unknown_id)
            place = start
        ids.reverse()
        return struct.pack(f"<{len(ids)}I", *ids), len(ids), best[n]

    def encode(self, text: str) -> tuple[bytes, float]:
        """Ids of a whole text as u32 bytes, and the total score of its pieces."""
        parts, known = self.cut.findall(self.prepare(text)), self.known
        fresh = set(parts).difference(known)
        if fresh:
            if len(known) > self.limit:
                known.clear()
                fresh = set(parts)
            long = {}
            for s in fresh:
                (known if len(s) <= 64 else long)[s] = self._segment(s)
            if long:
                found = [long[s] if len(s) > 64 else known[s] for s in parts]
                return b"".join(f[0] for f in found), sum(f[2] for f in found)
        found = list(map(known.__getitem__, parts))
        return b"".join([f[0] for f in found]), sum([f[2] for f in found])

    def decode(self, ids: list[int]) -> str:
        """Text of ids; undecodable byte pieces give replacement characters."""
        of_byte, texts = self.of_byte, self.texts
        if of_byte.keys().isdisjoint(ids):
            out = "".join(map(texts.__getitem__, ids))
        else:
            parts, raw = [], bytearray()
            for i in ids:
                if i in of_byte:
                    raw.append(of_byte[i])
                else:
                    if raw:
                        parts.append(raw.decode("utf-8", "replace"))
                        raw = bytearray()
                    parts.append(texts[i])
            out = "".join(parts) + raw.decode("utf-8", "replace")
        return out[1:] if self.model.dummy_prefix and out.startswith(" ") else out


def codec(path: str) -> PieceCodec:
    """The worker's codec of this file."""
    return worker_state(f"pieces {path}", lambda: PieceCodec(PieceModel.load(path)))


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """Per document doc_id, ids (array), n_pieces, ids_crc32, score, round_trip.

    score is the sum of the pieces' scores on the best path; round_trip tells whether decoding
    gives the text back (but for the model's own blank sign, which decodes to a blank). Null or
    empty text has no pieces. Null and repeated ids keep a row each; an empty table gives no
    rows. Only doc_id and text are read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("score", pa.float64()), ("round_trip", pa.bool_())])

    def encode(batches):
        tool = codec(model)
        for batch in slices(batches):
            texts = texts_of(batch.column(1))
            found = [tool.encode(t) for t in texts]
            flat, ends = pa.py_buffer(b"".join(raw for raw, _ in found)), [0]
            for raw, _ in found:
                ends.append(ends[-1] + len(raw) // 4)
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, flat])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            ok = [tool.decode(memoryview(raw).cast("I").tolist()) == t.replace(SPACE, " ") for (raw, _), t in zip(found, texts, strict=True)]
            numbers = [len(raw) // 4 for raw, _ in found]
            columns = [batch.column(0), ids, numbers, [zlib.crc32(raw) for raw, _ in found], [float(s) for _, s in found], ok]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        tidy(encode, keeps=True), "doc_id long, ids array<int>, n_pieces long, ids_crc32 long, score double, round_trip boolean"
    )


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids (array); null ids decode to null."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def decode(batches):
        tool = codec(model)
        for batch in slices(batches):
            texts = [None if ids is None else tool.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=schema)

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(tidy(decode, keeps=True), "doc_id long, text string")
