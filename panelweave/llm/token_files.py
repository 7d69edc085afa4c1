"""Token-id files: frequency-ranked ids, byte-aligned, control bytes apart from data bytes.

A file set is a table of images in the shared folder. An image holds consecutive documents:

    magic "PWT1" | u32 documents | u64 ids before this image in its shard
    | i64 doc_ids | u8 id-is-null | u32 ids per document | control bytes | data bytes

Every four ids share a control byte with two bits each, low bits first: bytes of that id minus
one. The data bytes are the ids' frequency ranks, little-endian, in that many bytes. A set's
ranking (rank -> id) is stored once beside the images.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, record, slices, texts_of, tidy
from .encoding import encoder

MAGIC = b"PWT1"
HEAD = struct.Struct("<4sIQ")
#: Bytes of each of the four ids that a control byte describes.
WIDTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit ranks."""
    ranks = np.asarray(ranks, dtype="<u4")
    width = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    codes[: len(ranks)] = width - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    most = int(width.max(initial=1))
    if most <= 2:  # half as many bytes to choose from
        ranks = ranks.astype("<u2")
        keep = np.ones((len(ranks), 2), dtype=bool)
        keep[:, 1] = width == 2
        return control.tobytes(), ranks.view(np.uint8)[keep.ravel()].tobytes()
    raw = ranks.view(np.uint8).reshape(-1, 4)[:, :most]
    return control.tobytes(), raw[np.arange(most, dtype=np.uint8) < width[:, None]].tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """Inverse of encode_ranks by table lookup."""
    width = WIDTHS[control].ravel()[:n]
    most = 2 if width.max(initial=1) <= 2 else 4
    out = np.zeros((n, most), dtype=np.uint8)
    out[np.arange(most, dtype=np.uint8) < width[:, None]] = data
    return out.view(f"<u{most}").ravel()


def write_image(doc_ids: list, lengths: np.ndarray, ranks: np.ndarray, before: int) -> bytes:
    control, data = encode_ranks(ranks)
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    ids = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    return b"".join((HEAD.pack(MAGIC, len(doc_ids), before), ids.tobytes(), null.tobytes(), np.asarray(lengths, dtype="<u4").tobytes(), control, data))


def read_image(image: bytes) -> tuple[list, np.ndarray, np.ndarray, int]:
    """doc_ids, ids per document, ranks, ids before."""
    magic, n, before = HEAD.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a token-id image")
    at = HEAD.size
    ids = np.frombuffer(image, "<i8", n, at)
    null = np.frombuffer(image, np.uint8, n, at + 8 * n)
    lengths = np.frombuffer(image, "<u4", n, at + 9 * n)
    total, at = int(lengths.sum()), at + 13 * n
    control = np.frombuffer(image, np.uint8, -(-total // 4), at)
    ranks = decode_ranks(control, np.frombuffer(image, np.uint8, -1, at + len(control)), total)
    return [None if z else int(i) for i, z in zip(ids, null, strict=True)], lengths, ranks, before


@dataclass(frozen=True)
class TokenFiles:
    """A written file set: images(shard, seq, n_tokens, image) and ranking(ids), one row of u32 by rank."""

    images: DataFrame
    ranking: DataFrame


def _tokenized(docs: DataFrame, tokenizer: str, end_id: int, image_tokens: int) -> DataFrame:
    """Blocks of consecutive documents of a shard (kind 0) and each task's counts of ids (kind 1)."""
    schema = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("seq", pa.int32()), ("docs", pa.binary()), ("ids", pa.binary())])

    def block(batches):
        shard, seq, counts = TaskContext.get().partitionId(), 0, np.zeros(0, dtype=np.int64)
        held, size, before, end = [], 0, 0, int(end_id).to_bytes(4, "little")

        def flush():
            lengths = np.array([len(c) // 4 for _, c in held], dtype="<u4")
            null = np.array([d is None for d, _ in held], dtype=np.uint8)
            ids = np.array([0 if d is None else d for d, _ in held], dtype="<i8")
            tokens = np.frombuffer(b"".join(c for _, c in held), dtype="<u4")
            head = struct.pack("<QI", before, len(held)) + ids.tobytes() + null.tobytes() + lengths.tobytes()
            # Half the bytes where every id fits into sixteen bits; the first byte says which.
            narrow = not len(tokens) or int(tokens.max()) < 65536
            body = (b"\x02" + tokens.astype("<u2").tobytes()) if narrow else (b"\x04" + tokens.tobytes())
            return tokens, record(schema, [[0], [shard], [seq], [head], [body]])

        for batch in slices(batches):
            codes = encoder(tokenizer, 144 << 20).encode(texts_of(batch.column(1)))
            for doc, code in zip(batch.column(0).to_pylist(), codes, strict=True):
                held.append((doc, code + end))
                size += len(code) // 4 + 1
                if size >= image_tokens:
                    tokens, out = flush()
                    part = np.bincount(tokens)
                    if len(part) > len(counts):
                        counts = np.pad(counts, (0, len(part) - len(counts)))
                    counts[: len(part)] += part
                    yield out
                    held, seq, before, size = [], seq + 1, before + size, 0
        if held:
            tokens, out = flush()
            part = np.bincount(tokens)
            if len(part) > len(counts):
                counts = np.pad(counts, (0, len(part) - len(counts)))
            counts[: len(part)] += part
            yield out
        if len(counts):
            used = np.flatnonzero(counts)
            yield record(schema, [[1], [shard], [-1], [used.astype("<u4").tobytes()], [counts[used].astype("<i8").tobytes()]])

    return docs.mapInArrow(tidy(block, keeps=True), "kind int, shard int, seq int, docs binary, ids binary")


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, image_tokens: int = 1 << 20) -> TokenFiles:
    """Encode every whole text, append `end_id`, and write the ids in ascending doc_id order.

    Later steps leave the workers' encoders where they are: another table's words need not be learned again.
    Shards are ranges of doc_id; documents with equal ids are ordered by a hash of their text. A null
    id comes first. Null text counts as empty. Other columns are not read.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = keys.withColumn("tie", F.xxhash64("text"))
    ordered = keys.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    blocks = materialize(_tokenized(ordered, tokenizer, end_id, image_tokens), "token-blocks", ("kind",), codec="lz4_raw")

    tally = pa.schema([("counts", pa.binary())])

    def total(batches):
        counts = np.zeros(0, dtype=np.int64)
        for batch in slices(batches, 16):
            for used, count in zip(batch.column(0), batch.column(1), strict=True):
                used, count = np.frombuffer(used.as_buffer(), "<u4"), np.frombuffer(count.as_buffer(), "<i8")
                if used[-1] >= len(counts):
                    counts = np.pad(counts, (0, int(used[-1]) + 1 - len(counts)))
                counts[used] += count
        yield record(tally, [[counts.tobytes()]])

    # A vector of the vocabulary's size from each of at most 32 tasks.
    parts = blocks.where("kind = 1").select("docs", "ids").coalesce(32).mapInArrow(tidy(total, keeps=True), "counts binary").collect()
    parts = [np.frombuffer(bytes(r["counts"]), "<i8") for r in parts]
    counts = np.zeros(max(map(len, parts), default=0), dtype=np.int64)
    for part in parts:
        counts[: len(part)] += part
    ranking = np.argsort(-counts, kind="stable").astype("<u4")
    rank_of = np.zeros(len(ranking), dtype="<u4")
    rank_of[ranking] = np.arange(len(ranking), dtype="<u4")
    shared = spark.sparkContext.broadcast(rank_of)

    schema = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("image", pa.binary())])

    def images(batches):
        for batch in slices(batches, 1):
            shard, seq, head, body = (c[0].as_py() for c in batch.columns)
            before, n = struct.unpack_from("<QI", head)
            ids, null = np.frombuffer(head, "<i8", n, 12), np.frombuffer(head, np.uint8, n, 12 + 8 * n)
            lengths = np.frombuffer(head, "<u4", n, 12 + 9 * n)
            tokens = np.frombuffer(body, f"<u{body[0]}", -1, 1)
            names = [None if z else int(i) for i, z in zip(ids, null, strict=True)]
            yield record(schema, [[shard], [seq], [len(tokens)], [write_image(names, lengths, shared.value[tokens], before)]])

    coded = blocks.where("kind = 0").select("shard", "seq", "docs", "ids").mapInArrow(tidy(images, keeps=True), "shard int, seq int, n_tokens long, image binary")
    table = spark.createDataFrame([(bytearray(ranking.tobytes()),)], "ids binary")
    return TokenFiles(materialize(coded, "token-images", codec="lz4_raw"), materialize(table, "token-ranking"))


def read_token_files(files: TokenFiles) -> DataFrame:
    """Decode a file set: per document doc_id, start (ids before it), n_tokens, ids (bytes, u32 LE)."""
    return _decoded(files, keep_ids=True)


def _decoded(files: TokenFiles, keep_ids: bool) -> DataFrame:
    spark = files.images.sparkSession
    totals = files.images.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    bases, total = {}, 0
    for r in totals:
        bases[r["shard"]], total = total, total + r["n"]
    shared = spark.sparkContext.broadcast((bases, np.frombuffer(files.ranking.first()["ids"], "<u4")))
    kind = ("ids", pa.binary()) if keep_ids else ("ids_crc32", pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), kind])

    def decode(batches):
        for batch in slices(batches, 1):
            base, ranking = shared.value
            docs, lengths, ranks, before = read_image(batch.column(1)[0].as_py())
            ends = np.cumsum(lengths, dtype=np.int64)
            starts = ends - lengths
            raw = memoryview(ranking[ranks].astype("<u4").tobytes())
            parts = [raw[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)]
            last = [bytes(p) if keep_ids else zlib.crc32(p) for p in parts]
            yield record(schema, [docs, starts + before + base[batch.column(0)[0].as_py()], lengths.astype(np.int64), last])

    return files.images.select("shard", "image").mapInArrow(tidy(decode, keeps=True), f"doc_id long, start long, n_tokens long, {kind[0]} {'binary' if keep_ids else 'long'}")


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the file set of `docs`, read it back, and return doc_id, start, n_tokens, ids_crc32.

    Empty or null text gives the end id alone; repeated and null ids keep a row each; an
    empty table gives none.
    """
    return _decoded(write_token_files(docs, tokenizer, end_id), keep_ids=False)
