"""Token sequences in training order, as binary shards of a fixed stride.

Documents become one stream of tokens in each partition, cut into sequences of one length and numbered throughout. A keyed
Feistel network over the next even power of two, walked until it lands below the number of sequences, gives every sequence
a slot of its own: a shuffle that needs no sort key, no memory and no communication. Slots are ranges of shards; each range is written in
order, so that a reader goes on from any slot by one seek. Every sequence has its CRC behind it, inside the stride, and is held against it when it is read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, core, files

#: Tokens of a sequence, sequences of a shard, key of the permutation, rounds of the network.
LENGTH, SHARD, KEY, ROUNDS = 1024, 4096, 20240229, 6
#: magic, version, tokens of a sequence, bytes of a token, first slot, sequences
HEADER = "<4sIIIQQ"
HEADER_SIZE = struct.calcsize(HEADER)
MAGIC, VERSION, WIDTH, CRC = b"TOKS", 2, 2, 4


def permute(x: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The place of each x below n under the keyed permutation of range(n)."""
    half = np.uint64(max(1, -(-max(1, int(n - 1).bit_length()) // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = core.mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out, todo = np.asarray(x).astype(np.uint64), np.arange(len(x))
    while len(todo):
        v = out[todo]
        left, right = v >> half, v & mask
        for k in keys:
            left, right = right, left ^ (core.mix(right ^ k) & mask)
        out[todo] = v = left << half | right
        todo = todo[v >= np.uint64(n)]
    return out.astype(np.int64)


def streams(docs: DataFrame, tokenizer: str):
    """(partition, numbers of tokens) of the documents' token streams, an end token after each document that has any."""

    def count(batches):
        coder, n = bpe.load(tokenizer), 0
        for batch in batches:
            for _, _, data, offs in core.chunks(batch["text"]):
                each = coder.counts(data, offs)
                n += int(each.sum() + np.count_nonzero(each))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], ["part", "n"])

    return docs.mapInArrow(core.tidy(count), "part int, n long")


def materialise(docs: DataFrame, folder: str, length: int = LENGTH, shard: int = SHARD, key: int = KEY, tokenizer: str = bpe.PATH) -> DataFrame:
    """Writes the shards to folder; gives (shard, first_slot, sequences, crc) of each as a table that is written too.

    docs is read twice and must give the same partitions both times, as files do; if a partition's tokens differ, the job fails. The
    last sequence of a partition is filled up with end tokens. Null and empty texts add nothing; repeated rows are each written. An empty
    table gives no shard. A text of any length runs over as many sequences as it needs. Slots are distinct, so there are no ties. One number for each
    partition goes to the driver. Other columns are not read.
    """
    texts = core.ids_only(docs, "doc_id", "text").select("text")
    sizes = {r.part: r.n for r in streams(texts, tokenizer).collect()}
    parts = max(sizes, default=-1) + 1
    sequences = np.array([-(-sizes.get(p, 0) // length) for p in range(parts)], np.int64)
    first = np.cumsum(sequences) - sequences
    total = int(sequences.sum())

    def cut(batches):
        coder, part = bpe.load(tokenizer), TaskContext.get().partitionId()
        packer, number = zstandard.ZstdCompressor(1), int(first[part]) if part < parts else 0
        end = number + (int(sequences[part]) if part < parts else 0)
        rest = np.zeros(0, np.uint16)

        def rows(tokens):
            nonlocal number
            n = len(tokens) // length
            if number + n > end:
                raise ValueError("a partition has more tokens than it had before; write the input first")
            slots = permute(np.arange(number, number + n), total, key)
            number += n
            raw = tokens.tobytes()
            return pa.RecordBatch.from_arrays([pa.array(slots), pa.array([packer.compress(raw[2 * i * length : 2 * (i + 1) * length]) for i in range(n)], pa.binary())], ["slot", "tokens"])

        for batch in batches:
            for _, _, data, offs in core.chunks(batch["text"]):
                ids, at = coder.encode(data, offs)
                size = np.diff(at)
                some = size[size > 0]
                stream = np.full(len(ids) + len(some), coder.end, np.uint16)
                stream[np.arange(len(ids)) + np.repeat(np.arange(len(some)), some)] = ids
                rest = np.concatenate([rest, stream])
                whole = len(rest) // length * length
                if whole:
                    yield rows(rest[:whole])
                    rest = rest[whole:]
        if len(rest):
            yield rows(np.concatenate([rest, np.full(length - len(rest), coder.end, np.uint16)]))
        if number != end:
            raise ValueError("a partition has fewer tokens than it had before; write the input first")

    def write(batches):
        """One shard after the other; the rows come in order of slots."""
        unpacker = zstandard.ZstdDecompressor()
        now, crc, out, stream, manager, count = None, 0, [], None, None, 0

        def close():
            manager.__exit__(None, None, None)
            out.append((now, now * shard, count, crc))

        for batch in batches:
            for slot, blob in zip(batch["slot"].to_numpy().tolist(), batch["tokens"]):
                if slot // shard != now:
                    if now is not None:
                        close()
                    now, crc, count = slot // shard, 0, 0
                    manager = files.new_file(folder, f"shard-{now:08d}.bin")
                    stream = manager.__enter__()
                    stream.write(struct.pack(HEADER, MAGIC, VERSION, length, WIDTH, now * shard, min(shard, total - now * shard)))
                raw = unpacker.decompress(blob.as_py())
                crc = zlib.crc32(raw, crc)
                stream.write(raw + struct.pack("<I", zlib.crc32(raw)))
                count += 1
        if now is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["shard", "first_slot", "sequences", "crc"])

    shards = max(1, -(-total // shard))
    ranges = min(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    in_order = (
        texts.mapInArrow(core.tidy(cut), "slot long, tokens binary")
        .repartitionById(ranges, (F.floor(F.col("slot") / shard) * ranges / shards).cast("int"))
        .sortWithinPartitions("slot")
    )
    return core.written(in_order.mapInArrow(core.tidy(write), "shard long, first_slot long, sequences int, crc long"))


def read_from(folder: str, shard: int, slot: int, length: int = LENGTH, size: int = SHARD):
    """(slot, tokens) from the given slot of a shard on; one seek, then sequential.

    Another format, version or length, a shard that is cut short, and a sequence that isn't what was written are errors.
    """
    system, base = files.open_fs(folder)
    with system.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
        head = f.read(HEADER_SIZE)
        if len(head) < HEADER_SIZE:
            raise ValueError("a shard is cut short")
        magic, version, have, width, first, count = struct.unpack(HEADER, head)
        if magic != MAGIC or version != VERSION or have != length or width not in (2, 4):
            raise ValueError("not a shard of such sequences")
        if not first <= slot <= first + count:
            raise ValueError(f"shard {shard} has no slot {slot}")
        stride = length * width + CRC
        f.seek(HEADER_SIZE + (slot - first) * stride)
        for s in range(slot, first + count):
            raw = f.read(stride)
            if len(raw) != stride:
                raise ValueError("a shard is cut short")
            if zlib.crc32(raw[:-CRC]) != struct.unpack("<I", raw[-CRC:])[0]:
                raise ValueError(f"the sequence of slot {s} in shard {shard} is damaged")
            yield s, np.frombuffer(raw[:-CRC], f"<u{width}")


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame, from_slot: int = 0, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """(slot, shard, byte_offset, crc, first_token) of every sequence from from_slot on, one shard a task at a time. crc is that of the sequence's bytes.

    A shard that is read whole is also held against the manifest: another number of sequences or another CRC is an error. An empty manifest gives no rows.
    """

    def load(batches):
        for batch in batches:
            for s, first, count, want in zip(*(batch[c].to_pylist() for c in ("shard", "first_slot", "sequences", "crc"))):
                out, crc = [], 0
                for slot, t in read_from(folder, s, max(first, from_slot), length, shard):
                    raw = t.tobytes()
                    crc = zlib.crc32(raw, crc)
                    out.append((slot, s, HEADER_SIZE + (slot - first) * (len(raw) + CRC), zlib.crc32(raw), int(t[0])))
                if len(out) != first + count - max(first, from_slot) or (from_slot <= first and crc != want):
                    raise ValueError(f"shard {s} isn't the one of the manifest")
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["slot", "shard", "byte_offset", "crc", "first_token"])

    core.ship(spark)
    wanted = manifest.where(F.col("first_slot") + F.col("sequences") > from_slot).select("shard", "first_slot", "sequences", "crc")
    return wanted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard").mapInArrow(core.tidy(load), "slot long, shard long, byte_offset long, crc long, first_token int")


def query(spark, sf_dir: str) -> DataFrame:
    folder = core.shared_dir(spark)
    manifest = materialise(core.read(spark, sf_dir, "documents"), folder)
    return read_shards(spark, folder, manifest)
