"""Passages that repeat across documents, by sparse suffix arrays.

Of the suffixes of every document only those are retained that begin at a minimiser: the word run of least hash among those
that a window of the least passage length holds. Equal windows have equal minimisers, so that a repeated passage keeps a
suffix at the same place in each copy. Suffixes whose first words occur in one document only are dropped, and of suffixes with
equal surroundings one stands for all. Those left are sorted by the words that follow, in ranges of the whole sorted order;
inside a range neighbours are compared by their longest common prefix and matches are extended to the left by a second array
over the reversed words before. A match that may go on beyond its range's border is settled by an aggregation over the ranges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import core

#: Words of a passage at least, and words that a retained suffix is first compared by.
MIN_WORDS, KEY_WORDS = 50, 8
#: Suffixes of a range of the sorted order, about; ranges are as many as that takes. Suffixes of a range that the borders are drawn from, which the driver gets.
RANGE, DRAWN = 50_000, 10
_DRAWN = "spark.sql.execution.rangeExchange.sampleSizePerPartition"


def minimisers(h: np.ndarray, row: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, its minimiser, hashes of the k words from each position on); windows that cross a row's end are left out. Of equal hashes the leftmost counts."""
    g = core.grams(h, k)
    span = length - k + 1
    if len(g) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), g
    bits = np.uint64(max(20, int(len(g)).bit_length()))
    least = (core.mix(g) >> bits << bits) | np.arange(len(g), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(g) - span + 1], least[span - width :])
    window = np.flatnonzero(row[: len(least)] == row[length - 1 :])
    return window, (least[window] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), g


def run_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words h[start:end] for ascending starts and ends; equal runs hash alike wherever they are."""
    out, i, block = np.empty(len(start), np.uint64), 0, core.BLOCK // 4
    while i < len(start):
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, base + block, "right")))
        part = h[base : int(end[j - 1])]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * core._pow("up", len(part)))])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * core._pow("down", len(part) + 1)[s]
        i = j
    return core.mix(out)


def retained(h: np.ndarray, row: np.ndarray, length: int, k: int):
    """(place, least left, most left, key, hash of the surroundings) of each retained suffix.

    A suffix serves the windows that begin from least to most words left of it; its surroundings are the words of those windows.
    """
    window, at, g = minimisers(h, row, length, k)
    if not len(window):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)]))
    first, last, at = window[head], window[np.append(head[1:], len(window)) - 1], at[head]
    around = run_hashes(h, first, last + length)
    return at, at - last, at - first, g[at], core.mix(around ^ core.mix((last - first).astype(np.uint64) * np.uint64(1009) + (at - last).astype(np.uint64)))


def surroundings(h: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, left: int) -> np.ndarray:
    """32-bit codes of the words that each suffix's windows hold: length from the suffix on, then left before it, nearest first; 0 beyond the windows."""
    code = ((h >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)
    out = np.zeros((len(at), length + left), np.uint32)
    for i in range(length):
        some = np.flatnonzero(i < length - low)
        out[some, i] = code[at[some] + i]
    for i in range(left):
        some = np.flatnonzero(i < high)
        out[some, length + i] = code[at[some] - 1 - i]
    return out


def common(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Longest common prefix of each row, in this order, with the one before it; -1 for the first."""
    out = np.full(len(order), -1, np.int64)
    for lo in range(1, len(order), 1 << 14):
        here = order[lo - 1 : lo + (1 << 14)]
        same = words[here[1:]] == words[here[:-1]]
        out[lo : lo + len(same)] = np.where(same.all(1), words.shape[1], same.argmin(1))
    return out


def matched(words: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray, length: int):
    """Compares a range of the suffix array: (owners, border).

    owners[suffix, l]: the least document with the window that begins l words left of the suffix, -1 where only one is known to have it.
    border: (suffix, l, least, most) of the windows that suffixes of other ranges may have too, left out of owners. words are sorted.
    """
    n, left = len(words), words.shape[1] - length
    owners = np.full((n, left + 1), -1, np.int64)
    rows = np.arange(n)
    follow = common(words[:, :length], rows)
    before = np.ascontiguousarray(words[:, length:]).astype(">u4").view(f"V{4 * left}").ravel()
    back = np.argsort(before, kind="stable") if left else rows
    behind = common(words[:, length:], back)
    parts: list[tuple] = []
    for l in range(left + 1):
        some = np.flatnonzero((low <= l) & (high >= l))
        if not len(some):
            continue
        run = np.cumsum(follow < length - l)
        of_left = np.empty(n, np.int64)
        of_left[back] = np.cumsum(behind < l)
        code = run[some] * (n + 1) + of_left[some]
        order = np.argsort(code, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], code[order][1:] != code[order][:-1]]))
        lo, hi = np.minimum.reduceat(least[some][order], head), np.maximum.reduceat(most[some][order], head)
        group = np.empty(len(some), np.int64)
        group[order] = np.cumsum(np.bincount(head, minlength=len(some))[: len(some)]) - 1
        open_ = (run[some] == run[0]) | (run[some] == run[-1])
        inner = ~open_ & (lo < hi)[group]
        owners[some[inner], l] = lo[group[inner]]
        if open_.any():
            # One row for each suffix; least and most are those of the whole group, so that the aggregation meets them early.
            at = some[open_]
            parts.append((at, np.full(len(at), l), lo[group[open_]], hi[group[open_]]))
    border = tuple(np.concatenate(x) for x in zip(*parts)) if parts else tuple(np.zeros(0, np.int64) for _ in range(4))
    return owners, border


def window_hashes(words: np.ndarray, at: np.ndarray, l: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows that begin l words left of the suffixes at."""
    up = core._pow("up", length + 1)
    down = core._pow("down", words.shape[1] - length + 2)
    out = np.zeros(len(at), np.uint64)
    for i in range(length):
        out += np.where(i < length - l, words[at, i].astype(np.uint64) * up[i], np.uint64(0))
    for i in range(words.shape[1] - length):
        out += np.where(i < l, words[at, length + i].astype(np.uint64) * down[i + 1], np.uint64(0))
    return core.mix(out ^ core.mix(l.astype(np.uint64) + np.uint64(77)))


def repeated(docs: DataFrame, min_words: int = MIN_WORDS, key_words: int = KEY_WORDS, range_size: int = RANGE) -> DataFrame:
    """(doc_id, start_word, end_word, least_doc_id): maximal passages of windows of min_words words that another document has too.

    Words are runs of letters and digits; ASCII case and punctuation are ignored. end_word is exclusive. least_doc_id is the least
    document that has each window of the passage; a passage ends where that document changes, so passages with different partners may overlap in words.
    Where it is doc_id, this is the first copy. Repeats inside one document don't count, nor do rows that repeat a doc_id with
    the same text. Null, empty and shorter texts and null ids have no passages, nor has an empty table. A text of any length is compared whole.
    Ties don't arise: every window has one least document. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = core.ids_only(docs, "doc_id", "text").where("doc_id is not null")
    left = min_words - key_words

    def retain(batches):
        for batch in batches:
            for lo, hi, data, offs in core.chunks(batch["text"]):
                h, _, _, row = core.words(data, offs)
                at, low, high, key, around = retained(h, row, min_words, key_words)
                r = row[at]
                begin = np.searchsorted(row, np.arange(hi - lo))
                columns = [core.signed(key), core.signed(around), batch["doc_id"].slice(lo, hi - lo).take(pa.array(r)), (at - begin[r]).astype(np.int32), low.astype(np.int8), high.astype(np.int8)]
                yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], ["key", "around", "doc_id", "at", "low", "high"])

    suffixes = texts.mapInArrow(core.tidy(retain), "key long, around long, doc_id long, at int, low byte, high byte")
    keys = suffixes.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select(F.col("key").alias("shared"))
    shared = core.written(suffixes.join(keys, F.col("key") == F.col("shared")).select("around", "doc_id", "at"))
    # Of equal surroundings the least document's stand for all.
    one = shared.groupBy("around").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("most"))
    wanted = one.groupBy("id").agg(F.collect_list("around").alias("around"), F.collect_list("most").alias("most"))

    def look(batches):
        for batch in batches:
            for lo, hi, data, offs in core.chunks(batch["text"]):
                h, _, _, row = core.words(data, offs)
                at, low, high, _, around = retained(h, row, min_words, key_words)
                want, most = batch["around"].slice(lo, hi - lo), batch["most"].slice(lo, hi - lo)
                owner = np.repeat(np.arange(hi - lo), np.diff(want.offsets.to_numpy()))
                names, most = want.flatten().to_numpy().view(np.uint64), most.flatten().to_numpy()
                # Both sides by document and surroundings; of a document's equal suffixes the first is taken.
                mine = core.mix(around + core.mix(row[at].astype(np.uint64)))
                asked = core.mix(names + core.mix(owner.astype(np.uint64)))
                kinds, first = np.unique(mine, return_index=True)
                place = np.minimum(np.searchsorted(kinds, asked), max(0, len(kinds) - 1))
                ok = np.flatnonzero(kinds[place] == asked) if len(kinds) else np.zeros(0, np.int64)
                s = first[place[ok]]
                for i in range(0, len(s), 8192):
                    few, some = s[i : i + 8192], ok[i : i + 8192]
                    words = surroundings(h, at[few], low[few], high[few], min_words, left).astype(">u4")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * words.shape[1]), len(words), [None, pa.py_buffer(words.tobytes())]).cast(pa.binary()),
                            pa.array(core.signed(around[few])), pa.array(low[few].astype(np.int8)), pa.array(high[few].astype(np.int8)),
                            batch["doc_id"].slice(lo, hi - lo).take(pa.array(row[at[few]])), pa.array(most[some]),
                        ],
                        ["words", "around", "low", "high", "least", "most"],
                    )

    found = texts.join(wanted, F.col("doc_id") == F.col("id")).select("doc_id", "text", "around", "most")
    array = core.written(found.mapInArrow(core.tidy(look), "words binary, around long, low byte, high byte, least long, most long"))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-array.count() // range_size))

    def compare(batches):
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        words = np.frombuffer(b"".join(table["words"].to_pylist()), ">u4").reshape(table.num_rows, -1).astype(np.uint32)
        around = table["around"].to_numpy()
        low, high = (table[c].to_numpy().astype(np.int64) for c in ("low", "high"))
        owners, (s, l, lo, hi) = matched(words, low, high, table["least"].to_numpy(), table["most"].to_numpy(), min_words)
        flat = owners.ravel()
        head = np.concatenate([[True], flat[1:] != flat[:-1]])
        head[:: owners.shape[1]] = True
        a = np.flatnonzero(head)
        z = np.append(a[1:], len(flat)) - 1
        a, z = a[flat[a] >= 0] if flat.min() < 0 else a, z[flat[a] >= 0] if flat.min() < 0 else z
        width, none = owners.shape[1], pa.nulls(len(a), pa.int64())
        names = ["around", "first", "last", "least", "most", "window"]
        yield pa.RecordBatch.from_arrays([pa.array(around[a // width]), pa.array((a % width).astype(np.int32)), pa.array((z % width).astype(np.int32)), pa.array(flat[a]), none, none], names)
        at = l.astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(around[s]), pa.array(at), pa.array(at), pa.array(lo), pa.array(hi), pa.array(core.signed(window_hashes(words, s, l, min_words)))], names)

    before = spark.conf.get(_DRAWN)
    spark.conf.set(_DRAWN, DRAWN)
    try:
        compared = core.written(array.repartitionByRange(ranges, "words").sortWithinPartitions("words").mapInArrow(core.tidy(compare), "around long, first int, last int, least long, most long, window long"))
    finally:
        spark.conf.set(_DRAWN, before)
    border = compared.where("window is not null")
    met = border.groupBy("window").agg(F.min("least").alias("owner"), F.max("most").alias("other")).where("owner < other").select(F.col("window").alias("met"), "owner")
    runs = compared.where("window is null").select("around", "first", "last", F.col("least").alias("owner")).unionByName(border.join(met, F.col("window") == F.col("met")).select("around", "first", "last", "owner"))
    placed = shared.join(runs.withColumnRenamed("around", "of"), F.col("around") == F.col("of")).select("doc_id", (F.col("at") - F.col("last")).alias("a"), (F.col("at") - F.col("first")).alias("z"), "owner")
    order = Window.partitionBy("doc_id").orderBy("a", "z")
    new = (F.col("a") > F.max("z").over(order.rowsBetween(Window.unboundedPreceding, -1)) + 1) | (F.col("owner") != F.lag("owner").over(order))
    return (
        placed.withColumn("new", F.coalesce(new, F.lit(True)).cast("int"))
        .withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "island")
        .agg(F.min("a").alias("start_word"), (F.max("z") + min_words).alias("end_word"), F.min("owner").alias("least_doc_id"))
        .drop("island")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return repeated(core.read(spark, sf_dir, "documents"))


ORACLE = f"""WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+') AS words
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), windows AS (
  SELECT doc_id, i AS p, md5(array_to_string(words[i + 1:i + {MIN_WORDS}], ' ')) AS w
  FROM (SELECT doc_id, words, unnest(range(0, len(words) - {MIN_WORDS} + 1)) AS i FROM cut WHERE len(words) >= {MIN_WORDS})
), owners AS (
  SELECT w, min(doc_id) AS owner FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)
), shared AS (
  SELECT DISTINCT doc_id, p, owner FROM windows JOIN owners USING (w)
), marked AS (
  SELECT *, CASE WHEN p = lag(p) OVER o + 1 AND owner = lag(owner) OVER o THEN 0 ELSE 1 END AS new FROM shared WINDOW o AS (PARTITION BY doc_id ORDER BY p)
), islands AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS island FROM marked
)
SELECT doc_id, CAST(min(p) AS INTEGER) AS start_word, CAST(max(p) + {MIN_WORDS} AS INTEGER) AS end_word, min(owner) AS least_doc_id FROM islands GROUP BY doc_id, island"""
