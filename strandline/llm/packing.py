"""Best-fit packing by minimum bin slack.

Documents become pieces of at most one bin. Each bin begins with the longest piece left; a dynamic programme over the
lengths left, whose set of reachable sums is one integer used as a bitset, finds the fullest combination that fits beside it,
and its pieces are removed. Bins are filled inside groups of documents, which a hash draws from the whole table.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import bpe, core

#: Tokens of a bin, an end token after each document among them.
CAPACITY = 2048
#: Documents of a group, on average. Larger groups leave fewer bins part empty and take more memory of one task.
GROUP = 8192


def fill(available: dict[int, int], room: int, lengths: list[int] | None = None) -> list[tuple[int, int]]:
    """(length, times) of the combination of available lengths with the largest sum up to room. Longer lengths are tried first; of equal sums the first found counts.

    lengths: the keys of available in ascending order, if they are at hand.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    lengths = sorted(available) if lengths is None else lengths
    for length in reversed(lengths[: bisect.bisect_right(lengths, room)]):
        left, times = min(available[length], room // length), 1
        while left and not reach >> room:
            take = min(times, left)
            new = (reach << (length * take)) & mask & ~reach
            if new:
                steps.append((new, length, take))
                reach |= new
            left -= take
            times *= 2
        if reach >> room:
            break
    total, out = reach.bit_length() - 1, {}
    for new, length, take in reversed(steps):
        if total and new >> total & 1:
            total -= length * take
            out[length] = out.get(length, 0) + take
    return sorted(out.items(), reverse=True)


def bins(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, start in the bin) of each piece; equal lengths are used in their given order."""
    places: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        places.setdefault(int(lengths[i]), []).append(i)
    available = {x: len(p) for x, p in places.items()}
    bin_of, start = np.zeros(len(lengths), np.int32), np.zeros(len(lengths), np.int32)
    left, number = sorted(places), 0
    while left:
        longest, at = left[-1], 0

        def take(length: int, times: int) -> None:
            nonlocal at
            for _ in range(times):
                i = places[length].pop()
                bin_of[i], start[i] = number, at
                at += length
            available[length] -= times
            if not available[length]:
                del available[length]
                left.pop(bisect.bisect_left(left, length))

        take(longest, 1)
        for length, times in fill(available, capacity - longest, left) if capacity > longest else []:
            take(length, times)
        number += 1
    return bin_of, start


def packed(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, tokenizer: str = bpe.PATH) -> DataFrame:
    """(doc_id, piece, pack, bin, start, tokens): where each piece of each document lies; a bin is (pack, bin).

    A document of n tokens has n + 1 with its end token; it is cut into pieces of capacity and a rest, piece counts from 0. Null and
    empty texts have no piece. Repeated rows are packed each; equal lengths are used in order of doc_id and piece. Null ids are
    packed too. A text of any length is cut. An empty table gives no rows. Other columns are not read.
    """
    packs = max(1, -(-docs.count() // group))

    def measure(batches):
        coder = bpe.load(tokenizer)
        for batch in batches:
            for lo, hi, data, offs in core.chunks(batch["text"]):
                n = coder.counts(data, offs)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo).take(pa.array(some)), pa.array(n[some] + 1)], ["doc_id", "n"])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("n", "ascending")])
        n = table["n"].to_numpy()
        pieces = -(-n // capacity)
        doc = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        tokens = np.minimum(capacity, n[doc] - piece * capacity)
        bin_of, start = bins(tokens, capacity)
        columns = [table["doc_id"].combine_chunks().take(pa.array(doc)), pa.array(piece, pa.int32()), table["pack"].combine_chunks().take(pa.array(doc)), pa.array(bin_of), pa.array(start), pa.array(tokens, pa.int32())]
        return pa.Table.from_arrays(columns, ["doc_id", "piece", "pack", "bin", "start", "tokens"])

    sized = core.ids_only(docs, "doc_id", "text").mapInArrow(core.tidy(measure), "doc_id long, n long")
    # Rows without an id may be many; others have their group by id and length alone.
    spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    # So few bytes would be read by one or two tasks if the partitions weren't numbered.
    tasks = min(packs, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (
        sized.withColumn("pack", F.pmod(F.xxhash64("doc_id", "n", spread), F.lit(packs)).cast("int"))
        .repartition(tasks, "pack")
        .groupBy("pack")
        .applyInArrow(pack, "doc_id long, piece int, pack int, bin int, start int, tokens int")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return packed(core.read(spark, sf_dir, "documents"))
