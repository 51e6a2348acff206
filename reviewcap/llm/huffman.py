"""Token-id files: canonical, length-limited Huffman codes with block checkpoints.

``write_token_files`` turns whole texts into ids, counts every id of the
corpus, derives one canonical code whose words have at most ``MAX_BITS``
bits, and writes the documents in ascending order of their id into file
images.  ``read_token_files`` decodes them with one table look-up a token;
blocks of ``BLOCK`` tokens start at known bit offsets, so that all blocks of
an image are decoded side by side (or one alone, with ``decode_blocks``).

A file image (little-endian but for the bit stream)::

    magic "RCHF", u16 version, u16 longest code, u32 ids of the code table,
    u32 documents, u64 tokens, u32 blocks, u64 bytes of the bit stream
    u8  [ids]        code length of each id (0: the id does not occur)
    i64 [documents]  document id;  u8 [documents]  1 where the id is null
    u32 [documents]  tokens of the document
    u64 [blocks]     bit offset of the block
    bit stream, most significant bit first

Every document begins a block and a byte.  The images are rows of a Parquet
table in the shared folder, so any store that Spark writes to holds them.
Nothing but the code lengths (one byte for each id of the vocabulary) and the
counts they come from (one number for each id) goes through the driver.

Defined results: a null or empty text has the end id alone; null document ids
come first; rows that repeat a document id keep their own entries, ordered by
their encoded bytes; an empty table gives no file; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import ID_BYTES, encoded_batches
from .common import col, stored

MAX_BITS = 18
BLOCK = 512
IMAGE_BYTES = 4 << 20  # an image is closed when its bit stream has this many bytes
GATHERED = 1 << 17  # tokens that are encoded at once
_HEAD = "<4sHHIIQIQ"


# ---- ids of texts ---------------------------------------------------------

def token_ids(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of two kinds: doc_id, ids (binary, little-endian u32), the ids of each whole text and the end id;
    and id, n, how often an id occurs among those of a task (null in the others)."""
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    names = ["doc_id", "ids", "id", "n"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in encoded_batches(it, path, end_id):
            total = added(total, batch.column(1))
            yield pa.record_batch([*batch.columns, pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.int64())], names)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.nulls(len(seen), pa.int64()), pa.nulls(len(seen), pa.binary()), pa.array(seen.astype(np.int32)), pa.array(total[seen])], names)

    return rows.mapInArrow(run, "doc_id long, ids binary, id int, n long")


# ---- the code -------------------------------------------------------------

def added(total: np.ndarray, ids: pa.Array) -> np.ndarray:
    """``total`` and how often each id occurs in ``ids`` (binary)."""
    got = np.bincount(np.frombuffer(b"".join(ids.to_pylist()), np.uint32))
    if len(got) > len(total):
        got[:len(total)] += total
        return got
    total[:len(got)] += got
    return total


def id_counts(ids: DataFrame) -> DataFrame:
    """id, n over all ids: counted in each task as they were made, then summed by id."""
    return ids.filter("id IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` (package-merge); 0 where the count is 0."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids need codes of more than {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    n = len(order)
    levels = []  # which entries of each merged list are leaves
    merged = weight
    levels.append(np.ones(n, bool))
    for _ in range(max_bits - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        at = np.argsort(both, kind="stable")
        merged = both[at]
        levels.append(at < n)
    take = 2 * n - 2
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        lengths[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code word of each id: by length, then by id, counting up."""
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    used = np.flatnonzero(lengths)
    for bits in np.unique(lengths[used]):
        own = used[lengths[used] == bits]
        code <<= int(bits) - last
        codes[own] = np.arange(code, code + len(own), dtype=np.uint64)
        code, last = code + len(own), int(bits)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each prefix of the longest length: the id, its length; and that length."""
    most = int(lengths.max(initial=1)) or 1
    ids, bits = np.zeros(1 << most, np.uint32), np.ones(1 << most, np.uint8)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    spans = (1 << (most - lengths[used].astype(np.int64)))
    ids[: spans.sum()] = np.repeat(used, spans)
    bits[: spans.sum()] = np.repeat(lengths[used], spans)
    return ids, bits, most


def encode_documents(ids: np.ndarray, n: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bit streams of documents of so many tokens each (whole bytes, one after the other), the bytes of each,
    and the bit offset of each token in its document's stream."""
    kind = np.int32 if len(ids) < 1 << 25 else np.int64
    bits = lengths[ids]
    starts = np.cumsum(bits, dtype=kind)
    ends = np.concatenate([np.zeros(1, kind), starts])[np.cumsum(n)]
    total = np.diff(ends, prepend=kind(0))
    sizes = (total + 7) // 8
    starts -= bits
    own = starts - np.repeat(ends - total, n)
    starts = own + np.repeat((np.cumsum(sizes, dtype=kind) - sizes) * 8, n)
    # A code word of at most 32 bits lies in two neighbouring words of 32 bits, which are added up as one of 64.
    word = starts >> 5
    placed = codes[ids] << (64 - (starts & 31) - bits).astype(np.uint64)
    out = np.zeros(int(sizes.sum()) // 4 + 3, np.uint32)
    if len(ids):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        summed, at = np.add.reduceat(placed, first), word[first]
        out[at] = summed >> np.uint64(32)
        out[at + 1] |= summed.astype(np.uint32)
    return out.astype(">u4").tobytes()[: int(sizes.sum())], sizes, own


def encode_ids(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of a document (whole bytes) and the bit offset of each block."""
    stream, _, starts = encode_documents(ids, np.array([len(ids)]), codes, lengths)
    return stream, starts[::BLOCK].astype(np.uint64)


def decode_blocks(stream: bytes, offsets: np.ndarray, tokens: np.ndarray, table: tuple) -> np.ndarray:
    """The ids of the blocks at these bit offsets, each of so many tokens, one after the other."""
    ids, bits, most = table
    raw = np.frombuffer(stream + bytes(8), np.uint8).astype(np.uint32)
    window = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
    order = np.argsort(-tokens.astype(np.int64), kind="stable")  # the blocks still running are a prefix
    at, left = offsets[order].astype(np.int64), tokens[order].astype(np.int64)
    where = (np.cumsum(tokens) - tokens)[order].astype(np.int64)
    out = np.empty(int(tokens.sum()), np.uint32)
    alive = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), side="left")
    for k, live in enumerate(alive):
        p = at[:live]
        key = (window[p >> 3] >> (32 - most - (p & 7)).astype(np.uint32)) & np.uint32((1 << most) - 1)
        out[where[:live] + k] = ids[key]
        p += bits[key]
    return out


# ---- files ----------------------------------------------------------------

def write_token_files(ids: DataFrame) -> DataFrame:
    """part, segment, n_docs, n_tokens, image: the files of a table of ``token_ids``, in order of doc_id.

    ``ids`` should be a stored table: it is read for the counts and again for the encoding.
    """
    got = id_counts(ids).collect()  # one row for each id of the vocabulary at most
    counts = np.zeros(max((r["id"] for r in got), default=-1) + 1, np.int64)
    for r in got:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    codes = canonical(lengths)
    ids = ids.filter("id IS NULL")

    # Ranges of the ids come from the ids alone, so that nothing is encoded twice to find them.
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / parts for i in range(1, parts)]
    cuts = ids.agg(F.percentile_approx("doc_id", steps, max(10_000, 10 * parts)).alias("cuts")).first()["cuts"] if steps else None
    borders = np.unique(np.array(cuts or [], np.int64))

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            payload, blocks = [], []
            to = np.searchsorted(borders, batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)).astype(np.int32)
            held = batch.column(1).to_pylist()
            n = np.array([len(b) // ID_BYTES for b in held], np.int64)
            before = np.cumsum(n) - n
            for group in np.split(np.arange(len(n)), np.flatnonzero(np.diff(before // GATHERED)) + 1):
                own = np.frombuffer(b"".join([held[i] for i in group]), np.uint32)
                stream, sizes, starts = encode_documents(own, n[group], codes, lengths)
                ends, at = np.cumsum(sizes).tolist(), (before[group] - before[group[:1]]).tolist()
                payload += [stream[a:b] for a, b in zip([0, *ends], ends)]
                blocks += [starts[a:a + k:BLOCK].astype(np.uint64).tobytes() for a, k in zip(at, n[group].tolist())]
            yield pa.record_batch([pa.array(to), batch.column(0), pa.array(n, pa.int64()), pa.array(payload, pa.binary()), pa.array(blocks, pa.binary())], ["to", "doc_id", "n", "payload", "blocks"])

    def image(ids_: list, n: list, payload: list, blocks: list) -> bytes:
        sizes = np.array([len(p) for p in payload], np.uint64)
        base = (np.cumsum(sizes) - sizes) * np.uint64(8)
        offsets = np.concatenate([np.frombuffer(b, np.uint64) + base[i] for i, b in enumerate(blocks)])
        head = struct.pack(_HEAD, b"RCHF", 1, int(lengths.max(initial=0)), len(lengths), len(n), sum(n), len(offsets), int(sizes.sum()))
        null = np.array([i is None for i in ids_], np.uint8)
        return b"".join([head, lengths.tobytes(), np.array([i or 0 for i in ids_], np.int64).tobytes(), null.tobytes(),
                         np.array(n, np.uint32).tobytes(), offsets.tobytes(), *payload])

    def assemble(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, size = TaskContext.get().partitionId(), 0, 0
        rows: list[list] = [[], [], [], []]

        def close() -> pa.RecordBatch:
            made = image(*rows)
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([len(rows[1])], pa.int64()), pa.array([sum(rows[1])], pa.int64()), pa.array([made], pa.binary())],
                                   ["part", "segment", "n_docs", "n_tokens", "image"])

        for batch in it:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for held, v in zip(rows, row):
                    held.append(v)
                size += len(row[2])
                if size >= IMAGE_BYTES:
                    yield close()
                    segment, size, rows = segment + 1, 0, [[], [], [], []]
        if rows[0]:
            yield close()

    coded = ids.select("doc_id", "ids").mapInArrow(encode, "to int, doc_id long, n long, payload binary, blocks binary")
    ordered = coded.repartitionById(parts, F.col("to")).drop("to").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "payload")
    return stored(ordered.mapInArrow(assemble, "part int, segment int, n_docs long, n_tokens long, image binary"), "token-files", "uncompressed")


def read_image(image: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """The document ids of a file image, the tokens of each, and all its ids."""
    magic, version, _, vocabulary, docs, tokens, blocks, _ = struct.unpack_from(_HEAD, image)
    if magic != b"RCHF" or version != 1:
        raise ValueError("not a token file of version 1")
    at = struct.calcsize(_HEAD)

    def take(kind: type, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(image, kind, n, at)
        at += out.nbytes
        return out

    lengths, ids, null, n = take(np.uint8, vocabulary), take(np.int64, docs), take(np.uint8, docs), take(np.uint32, docs).astype(np.int64)
    offsets = take(np.uint64, blocks)
    per = (n + BLOCK - 1) // BLOCK
    sizes = np.full(blocks, BLOCK, np.int64)
    last = np.cumsum(per) - 1
    sizes[last[per > 0]] = (n - (per - 1) * BLOCK)[per > 0]
    all_ids = decode_blocks(image[at:], offsets, sizes, decode_table(lengths))
    return [None if z else int(i) for i, z in zip(ids, null)], n, all_ids


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids of every document in the files."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part, segment, image in zip(*(batch.column(i).to_pylist() for i in range(3))):
                docs, n, ids = read_image(image)
                ends = np.cumsum(n)
                raw = ids.astype("<u4").tobytes()
                own = [raw[(e - k) * ID_BYTES:e * ID_BYTES] for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.record_batch([pa.array([part] * len(n), pa.int32()), pa.array([segment] * len(n), pa.int32()), pa.array(docs, pa.int64()), pa.array(ends - n), pa.array(n),
                                       pa.array([zlib.crc32(b) for b in own], pa.int64()), pa.array(own, pa.binary())],
                                      ["part", "segment", "doc_id", "within", "n_tokens", "ids_crc32", "ids"])

    docs = files.select("part", "segment", "image").mapInArrow(run, "part int, segment int, doc_id long, within long, n_tokens long, ids_crc32 long, ids binary")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition written
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_part"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = files.select("part", "segment", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("_segment"))
    starts = segments.join(parts, "part").select("part", "segment", (F.col("_part") + F.col("_segment")).alias("_start"))
    return docs.join(starts, ["part", "segment"]).select("doc_id", (F.col("_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "ids")
