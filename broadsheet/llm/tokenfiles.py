"""Token ids in files: Simple-8b words in segments, and the readers for them.

A segment is one binary value: header, document ids and sizes, block offsets, exceptions, words. Ids of all documents
of a segment follow one another and are cut into blocks of ``BLOCK``; each block begins at a word of its own, whose
offset is in the segment, so that blocks decode independently and all blocks of a segment decode at once.

A word has a selector in its upper 4 bits and ``COUNTS[selector]`` ids of ``60 // COUNTS[selector]`` bits in the rest.
Selector 14 is the escape: its 60 bits number an entry of the segment's exceptions, which holds an id of over 60 bits.

Spark's Parquet writer carries the segments (columns part, segment, n_docs, n_ids, data), as its commit protocol makes
files appear whole, once, and on any file system, whatever executors are lost meanwhile. Documents are dealt by ranges of
their ids, so (part, segment) is ascending document order.

Defined results: null text is empty and encodes to the end id alone; rows with null ids come first; rows with equal ids
follow each other, ordered by text; an empty table writes no segment.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadsheet.llm import common, tokens, wordhash

MAGIC = b"S8B1"
BLOCK = 256
#: Ids in a word, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = 60 // COUNTS
ESCAPE = len(COUNTS)
PAD = int(COUNTS[0])
#: Bytes of text in a part, from which on there are more parts than the session's shuffle partitions.
PART_BYTES = 256 << 20
#: Characters of a text by which rows of one id are dealt to parts; within a part whole texts are compared.
TIE_CHARS = 32
FILE_SCHEMA = "part int, segment int, n_docs int, n_ids long, data binary"


_SHORT_WIDTHS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """The number of bits of each id."""
    if not ids.size or ids.max() < 1 << 16:
        return _SHORT_WIDTHS[ids]
    bits, wide = np.zeros(ids.shape, np.uint8), ids
    for step in (32, 16, 8, 4, 2, 1):
        over = wide >= (np.uint64(1) << np.uint64(step))
        bits += over.astype(np.uint8) * np.uint8(step)
        wide = np.where(over, wide >> np.uint64(step), wide)
    return bits + wide.astype(np.uint8)


def _selectors(ids: np.ndarray) -> np.ndarray:
    """For each place of (blocks, BLOCK + PAD) ids: the selector that packs most ids from there."""
    bits = _widths(ids)
    flat = np.concatenate([bits.ravel(), np.zeros(PAD, np.uint8)])
    n = bits.size
    largest = {1: flat}
    for count in sorted(COUNTS.tolist()):  # the largest width of the next `count` ids, from shorter runs
        if count > 1:
            have = max(k for k in largest if k < count)
            rest = count - have
            if rest not in largest:
                have = max(k for k in largest if k < count and (count - k) in largest)
                rest = count - have
            m = largest[have].copy()
            np.maximum(m[: len(m) - have], largest[rest][have:], out=m[: len(m) - have])
            largest[count] = m
    # Fewer ids in a word always fit if more do, so the selectors that do not fit are the first ones.
    best = np.zeros(n, np.uint8)
    for count, bit in zip(COUNTS.tolist(), BITS.tolist(), strict=True):
        best += largest[count][:n] > bit
    return best.reshape(ids.shape)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, offsets of the blocks in them, exceptions."""
    n_blocks = -(-len(ids) // BLOCK)
    sizes = np.minimum(BLOCK, len(ids) - BLOCK * np.arange(n_blocks))
    rows = np.zeros((n_blocks, BLOCK), np.uint64)
    rows.ravel()[: len(ids)] = ids
    rows = np.concatenate([rows, np.zeros((n_blocks, PAD), np.uint64)], axis=1)
    selector = _selectors(rows)
    step = np.append(COUNTS, 1)
    width = BLOCK + PAD
    at, flat = np.zeros(n_blocks, np.int64), selector.ravel()
    blocks, places, ranks, k = [], [], [], 0
    active = np.arange(n_blocks)
    while len(active):  # the k-th word of every block at once
        place = active * width + at[active]
        blocks.append(active)
        places.append(place)
        ranks.append(np.full(len(active), k))
        at[active] += step[flat[place]]
        active = active[at[active] < sizes[active]]
        k += 1
    if not blocks:
        return np.zeros(0, "<u8"), np.zeros(1, "<u4"), np.zeros(0, "<u8")
    block, place, rank = map(np.concatenate, (blocks, places, ranks))
    per_block = np.bincount(block, minlength=n_blocks)
    offsets = np.concatenate([[0], np.cumsum(per_block)])
    target = offsets[block] + rank
    chosen = flat[place]
    words = np.zeros(len(place), np.uint64)
    values = rows.ravel()
    for s, (count, bit) in enumerate(zip(COUNTS.tolist(), BITS.tolist(), strict=True)):
        if len(sel := np.flatnonzero(chosen == s)):
            got = np.zeros(len(sel), np.uint64)
            for j in range(count):
                got |= values[place[sel] + j] << np.uint64(j * bit)
            words[target[sel]] = got | (np.uint64(s) << np.uint64(60))
    exceptions = np.zeros(0, np.uint64)
    if len(sel := np.flatnonzero(chosen == ESCAPE)):
        exceptions = values[place[sel]]
        words[target[sel]] = np.arange(len(sel), dtype=np.uint64) | (np.uint64(ESCAPE) << np.uint64(60))
    return words.astype("<u8"), offsets.astype("<u4"), exceptions.astype("<u8")


def unpack(words: np.ndarray, offsets: np.ndarray, exceptions: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids again, as uint64."""
    n_blocks = len(offsets) - 1
    if not n_blocks:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = np.append(COUNTS, [1, 0])[selector]
    behind = np.concatenate([[0], np.cumsum(count)])
    block = np.repeat(np.arange(n_blocks), np.diff(offsets.astype(np.int64)))
    inside = behind[:-1] - behind[offsets[:-1].astype(np.int64)][block]
    width = BLOCK + PAD
    out = np.zeros(n_blocks * width, np.uint64)
    place = block * width + inside
    payload = words & np.uint64((1 << 60) - 1)
    for s, (n, bit) in enumerate(zip(COUNTS.tolist(), BITS.tolist(), strict=True)):
        if len(sel := np.flatnonzero(selector == s)):
            low = np.uint64((1 << bit) - 1)
            for j in range(n):
                out[place[sel] + j] = (payload[sel] >> np.uint64(j * bit)) & low
    if len(sel := np.flatnonzero(selector == ESCAPE)):
        out[place[sel]] = exceptions[payload[sel].astype(np.int64)]
    return out.reshape(n_blocks, width)[:, :BLOCK].ravel()[:n_ids]


def segment_bytes(doc_ids: np.ndarray, has_id: np.ndarray, n_tokens: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets, exceptions = pack(ids.astype(np.uint64))
    head = struct.pack("<4sIQQQQ", MAGIC, BLOCK, len(doc_ids), len(ids), len(words), len(exceptions))
    parts = (doc_ids.astype("<i8"), has_id.astype("u1"), n_tokens.astype("<u8"), offsets, exceptions, words)
    return head + b"".join(p.tobytes() for p in parts)


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, whether each is not null, their numbers of ids, all ids."""
    magic, block, n_docs, n_ids, n_words, n_exceptions = struct.unpack_from("<4sIQQQQ", data)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a segment of this format")
    at = struct.calcsize("<4sIQQQQ")

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    doc_ids, has_id, n_tokens = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    offsets, exceptions = take("<u4", -(-n_ids // block) + 1), take("<u8", n_exceptions)
    return doc_ids, has_id.astype(bool), n_tokens.astype(np.int64), unpack(take("<u8", n_words), offsets, exceptions, n_ids)


def write_token_files(
    df: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = tokens.END_ID, keep_space: bool = False
) -> None:
    """Encode every text, append ``end_id``, and write the ids at ``path`` in ascending order of the integer ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, segment = tokens.encoder(tokenizer_path, keep_space), TaskContext.get().partitionId(), 0
        for batch in batches:
            key = batch.column(0)
            for row, texts in wordhash.steps(batch.column(1), tokens.STEP_BYTES):
                ids, at = encoder.with_end(texts, end_id)
                doc = key.slice(row, len(at) - 1)
                data = segment_bytes(doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_valid().to_numpy(zero_copy_only=False), np.diff(at), ids)
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array([part], pa.int32()), "segment": pa.array([segment], pa.int32()), "n_docs": pa.array([len(doc)], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()), "data": pa.array([data], pa.binary())}
                )
                segment += 1

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # Rows with equal ids can be dealt to different parts, by the beginnings of their texts; equal beginnings stay together.
    rows = rows.withColumn("tie", F.substring("text", 1, TIE_CHARS))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    parts = -(-total // PART_BYTES)
    fewer = parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange("id", "tie") if fewer else rows.repartitionByRange(parts, "id", "tie")
    ordered = dealt.sortWithinPartitions("id", "text").select("id", "text")
    ordered.mapInArrow(encode, FILE_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and the ids if asked for."""
    schema = "part int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, data in zip(*(batch.column(c) for c in range(3)), strict=True):
                doc_ids, has_id, n_tokens, ids = read_segment(data.as_buffer())
                ends = np.cumsum(n_tokens)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), n_tokens.tolist(), strict=True)]
                n = len(doc_ids)
                out = {
                    "part": pa.array(np.full(n, part.as_py()), pa.int32()),
                    "segment": pa.array(np.full(n, segment.as_py()), pa.int32()),
                    "doc_id": pa.array(doc_ids, pa.int64(), mask=~has_id),
                    "inside": pa.array(ends - n_tokens, pa.int64()),
                    "n_tokens": pa.array(n_tokens, pa.int64()),
                    "ids_crc32": pa.array(crcs, pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(out)

    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # Two small levels: parts, and the segments of a part.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("k"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.select("part", (F.sum("k").over(upto) - F.col("k")).alias("part_start"))
    inner = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    segments = files.select("part", "segment", (F.sum("n_ids").over(inner) - F.col("n_ids")).alias("segment_start")).join(parts, "part")
    docs = files.select("part", "segment", "data").mapInArrow(decode, schema).join(segments, ["part", "segment"])
    start = (F.col("part_start") + F.col("segment_start") + F.col("inside")).alias("start")
    return docs.select("doc_id", start, "n_tokens", "ids_crc32", *["ids"] * with_ids)
