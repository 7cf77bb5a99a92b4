"""Token ids in patched frame-of-reference files.

A file holds the ids of consecutive documents in blocks of 128.  Of each block the minimum is subtracted
and the low ``width`` bits of the rest are packed, where ``width`` fits the block's values up to a
percentile; the high bits of the outliers beyond it stand in an exception list with their positions.
An index gives the first word and the first exception of every block, so any block can be read alone.

Layout, little-endian: magic ``PFR1``, six u32 (documents, blocks, exceptions, words, block size, 0) and the
u64 number of ids; then i64 doc ids, u8 "has an id", u32 ids per document; per block u32 minimum, u32 first
word (+ end), u32 first exception (+ end), u8 width; u8 positions and u32 high bits of the exceptions; u32 words.
"""
from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerscope.llm import tokens
from ledgerscope.llm.common import map_batches, read
from ledgerscope.session import ensure_checkpoint_dir, materialize

MAGIC, BLOCK, LANE = b"PFR1", 128, 32
END_ID = 2


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs (0 for zero)."""
    return np.where(x > 0, np.frexp(x.astype(np.float64))[1], 0).astype(np.uint8)


def _pack(v: np.ndarray, w: int) -> np.ndarray:
    """Blocks of 128 values below 2**w as 4 * w words each: four lanes of 32 values, w words a lane."""
    lanes = np.ascontiguousarray(v.reshape(-1, LANE).T)
    out = np.zeros((w, lanes.shape[1]), np.uint32)
    for k in range(LANE):
        word, shift = divmod(k * w, 32)
        out[word] |= lanes[k] << np.uint32(shift)
        if shift + w > 32:
            out[word + 1] |= lanes[k] >> np.uint32(32 - shift)
    return np.ascontiguousarray(out.T).reshape(-1)


def _unpack(words: np.ndarray, w: int) -> np.ndarray:
    lanes = np.ascontiguousarray(words.reshape(-1, w).T)
    out = np.empty((LANE, lanes.shape[1]), np.uint32)
    mask = np.uint32((1 << w) - 1 if w < 32 else 0xFFFFFFFF)
    for k in range(LANE):
        word, shift = divmod(k * w, 32)
        x = lanes[word] >> np.uint32(shift)
        if shift + w > 32:
            x = x | (lanes[word + 1] << np.uint32(32 - shift))
        out[k] = x & mask
    return np.ascontiguousarray(out.T).reshape(-1, BLOCK)


def _encode_blocks(ids: np.ndarray, percentile: float):
    """Minimum, width, words and exceptions (block, position, high bits) of full blocks."""
    v = ids.reshape(-1, BLOCK)
    low = v.min(axis=1)
    v = v - low[:, None]
    at = min(BLOCK - 1, int(percentile * BLOCK))
    widths = _bits(np.partition(v, at, axis=1)[:, at])
    high = np.where(widths[:, None] < 32, v >> np.minimum(widths, 31)[:, None], 0).astype(np.uint32)
    rows, cols = np.nonzero(high)
    first_word = np.r_[0, np.cumsum(widths.astype(np.int64) * (BLOCK // 32))]
    words = np.zeros(int(first_word[-1]), "<u4")
    for w in np.unique(widths[widths > 0]):
        mine = np.flatnonzero(widths == w)
        mask = np.uint32((1 << int(w)) - 1 if w < 32 else 0xFFFFFFFF)
        span = int(w) * (BLOCK // 32)
        words[first_word[mine][:, None] + np.arange(span)] = _pack(v[mine] & mask, int(w)).reshape(-1, span)
    return low, widths, words, np.bincount(rows, minlength=len(v)), cols.astype("u1"), high[rows, cols]


def encode_file(doc_ids: list, counts: np.ndarray, ids: np.ndarray, percentile: float = 0.9, slice_blocks: int = 1 << 13) -> bytes:
    """One file from the documents' ids, put end to end; worked on in slices, so the scratch space stays small."""
    tail = np.full(-len(ids) % BLOCK, ids[-1] if len(ids) else 0, np.uint32)  # the last block is filled up with its last id
    ids, n_ids = np.r_[ids, tail].astype(np.uint32) if len(tail) else ids, len(ids)
    step = slice_blocks * BLOCK
    parts = [_encode_blocks(ids[a:a + step], percentile) for a in range(0, len(ids), step)]
    empty = (np.zeros(0, "u1"),) * 6
    low, widths, words, n_exc, cols, high = (np.concatenate(c) for c in (zip(*parts) if parts else [(e,) for e in empty]))
    first_exc = np.r_[0, np.cumsum(n_exc, dtype=np.int64)].astype("<u4")
    first_word = np.r_[0, np.cumsum(widths.astype(np.int64) * (BLOCK // 32))].astype("<u4")
    head = np.array([len(counts), len(low), len(cols), len(words), BLOCK, 0], "<u4")
    known = np.array([d is not None for d in doc_ids], "u1")
    named = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([MAGIC, head.tobytes(), np.array([n_ids], "<u8").tobytes(), named.tobytes(), known.tobytes(),
                     counts.astype("<u4").tobytes(), low.astype("<u4").tobytes(), first_word.tobytes(), first_exc.tobytes(),
                     widths.astype("u1").tobytes(), cols.tobytes(), high.astype("<u4").tobytes(), words.astype("<u4").tobytes()])


def decode_file(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """``(doc ids, ids per document, all ids)`` of a file."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    n_docs, n_blocks, n_exc, n_words, block, _ = (int(x) for x in np.frombuffer(data, "<u4", 6, 4))
    if block != BLOCK:
        raise ValueError(f"blocks of {block} ids are not supported")
    n_ids, at = int(np.frombuffer(data, "<u8", 1, 28)[0]), 36

    def take(kind, n):
        nonlocal at
        x = np.frombuffer(data, kind, n, at)
        at += x.nbytes
        return x

    named, known, counts = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
    low, first_word, first_exc = take("<u4", n_blocks), take("<u4", n_blocks + 1), take("<u4", n_blocks + 1)
    widths, cols, high, words = take("u1", n_blocks), take("u1", n_exc), take("<u4", n_exc), take("<u4", n_words)
    v = np.zeros((n_blocks, BLOCK), np.uint32)
    for w in np.unique(widths[widths > 0]):
        mine = np.flatnonzero(widths == w)
        v[mine] = _unpack(words[first_word[mine].astype(np.int64)[:, None] + np.arange(int(w) * (BLOCK // 32))], int(w))
    rows = np.repeat(np.arange(n_blocks), np.diff(first_exc.astype(np.int64)))
    v[rows, cols] |= (high.astype(np.uint64) << widths[rows].astype(np.uint64)).astype(np.uint32)
    return [int(d) if k else None for d, k in zip(named, known)], counts, (v + low[:, None]).reshape(-1)[:n_ids]


def _filesystem(folder: str):
    from pyarrow.fs import FileSystem
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return FileSystem.from_uri(folder)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
                 percentile: float = 0.9, file_ids: int = 1 << 22) -> DataFrame:
    """Encode ``docs`` in ascending id order into files under ``folder`` (a URI all executors reach); gives the written list of files.

    The rows are dealt by range of ``(id, hash of the text)``, so an id that repeats without end is cut as
    well, and a file closes after ``file_ids`` ids, which bounds a task's memory.  A file appears under its
    final name only when it is whole, and a repeated task writes the same file again.  Null ids come
    first; a null text is the empty one (its end id alone); an empty table writes no file.
    """
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]

    def run(batches):
        task = TaskContext.get()
        fs, base = _filesystem(folder)
        end, encode_all = np.array([end_id], "<u4").tobytes(), tokens.encoder(tokenizer, False).encode_all
        names, counts, parts, size, k = [], [], [], 0, 0

        def flush():
            data = encode_file(names, np.array(counts, np.int64), np.frombuffer(b"".join(parts), "<u4"), percentile)
            name = f"part-{task.partitionId():07d}-{k:05d}.pfr"
            fs.create_dir(base, recursive=True)
            with fs.open_output_stream(f"{base}/.{name}.{task.taskAttemptId()}") as out:
                out.write(data)
            fs.move(f"{base}/.{name}.{task.taskAttemptId()}", f"{base}/{name}")
            pa.default_memory_pool().release_unused()
            return pa.RecordBatch.from_pydict({"file": [name], "n_ids": [size], "n_docs": [len(names)], "bytes": [len(data)]})

        for b in batches:
            for name, ids in zip(b.column(0).to_pylist(), encode_all(b.column(1))):
                ids += end
                names.append(name)
                counts.append(len(ids) // 4)
                parts.append(ids)
                size += counts[-1]
                if size >= file_ids:
                    yield flush()
                    names, counts, parts, size, k = [], [], [], 0, k + 1
        if names:
            yield flush()

    placed = cols.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(map_batches(placed, run, "file string, n_ids long, n_docs long, bytes long"), "token_files")


def read_tokens(files: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """The documents of the listed files: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` (little-endian bytes)."""
    spark = files.sparkSession
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    listed = files.select("file", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)).alias("base"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    if files.isEmpty():
        return spark.createDataFrame([], schema)
    stored = (spark.read.format("binaryFile").option("pathGlobFilter", "*.pfr").load(folder)
              .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"))

    def run(batches):
        for b in batches:
            for i, base in enumerate(b.column(0).to_pylist()):
                names, counts, ids = decode_file(b.column(1)[i].as_buffer())
                ends = np.cumsum(counts.astype(np.int64))
                raw = memoryview(ids.astype("<u4").tobytes())
                docs = [raw[4 * (e - c):4 * e] for e, c in zip(ends.tolist(), counts.tolist())]
                cols = [pa.array(names, pa.int64()), pa.array(base + ends - counts), pa.array(counts.astype(np.int64)),
                        pa.array([zlib.crc32(d) for d in docs], pa.int64())]
                if with_ids:
                    cols.append(pa.array([bytes(d) for d in docs], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in schema.split(", ")])

    return map_batches(stored.join(listed, "file").select("base", "content"), run, schema)


def op1_pfor(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    files = write_tokens(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(files, folder)
