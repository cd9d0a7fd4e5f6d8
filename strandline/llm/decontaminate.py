"""Benchmark decontamination with suffix arrays of the training text.

Training documents are read in shards; each shard's words get a suffix array, sorted by prefix doubling as deep as the
longest benchmark item, so that it orders all suffixes as far as a test suffix can tell them apart. Every suffix of every
item is then looked up by binary search, which gives the range of training positions that begin with its least words;
these are extended to the longest match. Documents with a match go.
"""

from __future__ import annotations

import atexit
import functools
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import core, files

#: Words of a match at least; an item of fewer words must occur whole.
MIN_WORDS = 13
#: Bytes of benchmark text that a task holds at once. A larger benchmark is looked up in parts, each in the same suffix arrays.
PASS_BYTES = 32 << 20


class Shard:
    """The suffix array of the words of some documents; a 0 after each document ends every match."""

    def __init__(self, h: np.ndarray, row: np.ndarray, rows: int, depth: int):
        self.names, inverse = np.unique(h, return_inverse=True)
        self.per = 3 if len(self.names) < (1 << 21) - 2 else 2
        self.bits = np.uint64(21 if self.per == 3 else 32)
        self.at = np.arange(len(h)) + row
        self.words = np.zeros(len(h) + rows + depth + self.per, np.int64)
        self.words[self.at] = inverse.ravel() + 1
        self.keys = self.pack(self.words)
        self.sort(depth)

    def pack(self, words: np.ndarray) -> np.ndarray:
        """The words from each position on, as one integer that sorts like them."""
        w = words.astype(np.uint64)
        n = len(w) - self.per + 1
        out = w[:n].copy()
        for k in range(1, self.per):
            out = (out << self.bits) | w[k : k + n]
        return out

    def sort(self, depth: int) -> None:
        order = np.argsort(self.keys[self.at])
        self.array = self.at[order]
        self.first = self.keys[self.array]
        n = len(order)
        if not n:
            return
        rank = np.zeros(len(self.words) + 2 * depth, np.int64)
        start = np.concatenate([[True], self.first[1:] != self.first[:-1]])
        head = np.maximum.accumulate(np.where(start, np.arange(n), 0))
        rank[self.array] = head + 1
        reach = self.per
        while reach < depth:
            alone = start & np.concatenate([start[1:], [True]])
            tied = np.flatnonzero(~alone)
            if not len(tied):
                break
            pos = self.array[tied]
            both = (rank[pos].astype(np.uint64) << np.uint64(32)) | rank[pos + reach].astype(np.uint64)
            sub = np.argsort(both)
            both, pos = both[sub], pos[sub]
            self.array[tied] = pos
            start[tied] = np.concatenate([[True], both[1:] != both[:-1]])
            rank[pos] = np.maximum.accumulate(np.where(start[tied], tied, 0)) + 1
            reach *= 2

    def find(self, item_words: np.ndarray, item_start: np.ndarray, item_end: np.ndarray, min_words: int):
        """(item, item word, position, words) of all left-maximal matches of at least the item's least words."""
        at = np.searchsorted(self.names, item_words)
        at = np.minimum(at, len(self.names) - 1)
        q = np.where(self.names[at] == item_words, at + 1, len(self.names) + 1)
        item = np.repeat(np.arange(len(item_start)), item_end - item_start)
        least = np.minimum(min_words, item_end - item_start)[item]
        s = np.arange(len(q))
        s = s[item_end[item] - s >= least]
        keys = self.pack(np.concatenate([q, np.zeros(self.per, np.int64)]))
        # Fewer words than a key holds are looked up as the range of keys that begin with them.
        rest = self.bits * np.maximum(0, self.per - least[s]).astype(np.uint64)
        low = keys[s] >> rest << rest
        lo, hi = np.searchsorted(self.first, low, "left"), np.searchsorted(self.first, low + (np.uint64(1) << rest) - np.uint64(1), "right")
        # A word that is in no document has a name above all, whose key may overflow.
        known = np.ones(len(s), bool)
        for k in range(self.per):
            known &= (k >= least[s]) | (q[np.minimum(s + k, len(q) - 1)] <= len(self.names))
        hi = np.where(known, hi, lo)
        block = self.per
        while len(s):
            on = lo < hi
            s, lo, hi = s[on], lo[on], hi[on]
            deeper = least[s] >= block + self.per
            if not deeper.any():
                break
            want, at = keys[s[deeper] + block], deeper
            left = self.bisect(want, lo[at], hi[at], block, False)
            hi[at] = self.bisect(want, left, hi[at], block, True)
            lo[at] = left
            block += self.per
        size = hi - lo
        s = np.repeat(s, size)
        p = self.array[np.repeat(lo, size) + np.arange(len(s)) - np.repeat(np.cumsum(size) - size, size)]
        new = (s == item_start[item[s]]) | (p == 0) | (self.words[p - 1] != q[s - 1])
        s, p = s[new], p[new]
        size, on = np.zeros(len(s), np.int64), np.arange(len(s))
        while len(on):
            a, b = s[on] + size[on], p[on] + size[on]
            ok = a < item_end[item[s[on]]]
            ok[ok] = q[a[ok]] == self.words[b[ok]]
            on = on[ok]
            size[on] += 1
        ok = size >= least[s]
        s, p, size = s[ok], p[ok], size[ok]
        return item[s], s - item_start[item[s]], p, size

    def bisect(self, want, lo, hi, block, right):
        lo, hi = lo.copy(), hi.copy()
        while (on := np.flatnonzero(lo < hi)).size:
            mid = (lo[on] + hi[on]) >> 1
            have = self.keys[self.array[mid] + block]
            go = have <= want[on] if right else have < want[on]
            lo[on[go]] = mid[go] + 1
            hi[on[~go]] = mid[~go]
        return lo


def passes(benchmark: DataFrame, limit: int = PASS_BYTES):
    """(item ids, word hashes, first words, end words) of so many items as one pass takes; none for an empty benchmark."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // limit))
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").toArrow()
        data, offs = core.text_bytes(rows["text"])
        h, _, _, row = core.words(data, offs)
        first, end = np.searchsorted(row, np.arange(rows.num_rows)), np.searchsorted(row, np.arange(rows.num_rows), "right")
        some = np.flatnonzero(end > first)
        if len(some):
            keep = np.isin(row, some)
            size = (end - first)[some]
            end = np.cumsum(size)
            yield rows["item_id"].combine_chunks().take(pa.array(some)), h[keep], end - size, end


def store(benchmark: DataFrame, limit: int) -> tuple[list[str], int]:
    """The passes as files in the shared folder, and the words of the longest item."""
    spark, folder, paths, longest = benchmark.sparkSession, core.shared_dir(benchmark.sparkSession), [], 0
    for ids, h, first, end in passes(benchmark, limit):
        raw = io.BytesIO()
        numbers = ids.fill_null(0).to_numpy()
        np.savez(raw, ids=numbers, null=ids.is_null().to_numpy(zero_copy_only=False), h=h, first=first, end=end)
        with files.new_file(folder, f"pass-{len(paths):05d}.npz") as out:
            out.write(raw.getvalue())
        paths.append(f"{folder}/pass-{len(paths):05d}.npz")
        longest = max(longest, int((end - first).max()))
    if paths:
        atexit.register(core.delete, spark, folder)
    return paths, longest


@functools.lru_cache(maxsize=2)
def load(path: str) -> tuple:
    """(item ids, word hashes, first words, end words) of a pass; a worker holds two at most."""
    system, base = files.open_fs(path)
    with system.open_input_stream(base, compression=None) as f:
        kept = np.load(io.BytesIO(f.read()))
    return pa.array(kept["ids"], mask=kept["null"]), kept["h"], kept["first"], kept["end"]


def matches(col: pa.Array, paths: list[str], longest: int, min_words: int):
    """(item ids, row, item, words, row's word, item's word) arrays of the longest match of each row and item; of equally long ones the first in the text.

    The suffix array of a chunk is built once and serves all passes.
    """
    for lo, hi, data, offs in core.chunks(col):
        h, _, _, row = core.words(data, offs)
        if not len(h):
            continue
        shard = Shard(h, row, hi - lo, longest + 3)
        begin = np.searchsorted(row, np.arange(hi - lo))
        for path in paths:
            ids, h_items, first, end = load(path)
            item, item_word, p, size = shard.find(h_items, first, end, min_words)
            if not len(item):
                continue
            r = np.searchsorted(shard.at, p)
            order = np.lexsort((item_word, r, -size, item, row[r]))
            key = row[r][order].astype(np.int64) * (len(first) + 1) + item[order]
            best = order[np.concatenate([[True], key[1:] != key[:-1]])]
            rows = row[r[best]]
            yield ids, lo + rows, item[best], size[best], r[best] - begin[rows], item_word[best]


def _least(min_words: int) -> None:
    if min_words < 1:
        raise ValueError("a match must have at least one word")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, item_id, match_words, doc_word, item_word): the longest verbatim match of each document with each item.

    Words are runs of letters and digits, ASCII case and punctuation are ignored. doc_word and item_word count from 0. A match has
    min_words words at least, or is the whole of an item of fewer, be it one word. Null and empty texts and items match nothing; repeated
    rows are each listed; of equally long matches the first in the document is given, and of those the first in the item.
    A text of any length is searched whole. An empty benchmark or table gives no rows. Other columns are not read.
    """
    _least(min_words)
    docs = core.ids_only(docs, "doc_id", "text")
    paths, longest = store(benchmark, pass_bytes)
    schema = "doc_id long, item_id long, match_words int, doc_word int, item_word int"
    if not paths:
        return docs.sparkSession.createDataFrame([], schema)

    def search(batches):
        for batch in batches:
            for ids, rows, item, size, doc_word, item_word in matches(batch["text"], paths, longest, min_words):
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(rows)), ids.take(pa.array(item)), pa.array(size, pa.int32()), pa.array(doc_word, pa.int32()), pa.array(item_word, pa.int32())],
                    ["doc_id", "item_id", "match_words", "doc_word", "item_word"],
                )

    return docs.mapInArrow(core.tidy(search), schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs without the rows that contaminated() lists, all columns as they are; no shuffle."""
    _least(min_words)
    core.ship(docs.sparkSession)
    paths, longest = store(benchmark, pass_bytes)
    if not paths:
        return docs

    def sift(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for _, rows, *_ in matches(batch.column("text"), paths, longest, min_words):
                keep[rows] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(core.tidy(sift), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(core.read(spark, sf_dir, "documents"), core.read(spark, sf_dir, "benchmark"))


ORACLE = f"""WITH cut AS (
  SELECT doc_id AS id, 0 AS kind, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents
  UNION ALL SELECT item_id, 1, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+') FROM benchmark
), least AS (
  SELECT id, w, least({MIN_WORDS}, len(w)) AS n FROM cut WHERE kind = 1 AND len(w) > 0
), spans AS (
  SELECT id AS item_id, w, n, i, array_to_string(w[i + 1:i + n], ' ') AS s FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS i FROM least)
), places AS (
  SELECT id AS doc_id, w AS d, n, j, array_to_string(w[j + 1:j + n], ' ') AS s FROM (SELECT c.id, c.w, l.n, unnest(range(0, len(c.w) - l.n + 1)) AS j FROM cut c, (SELECT DISTINCT n FROM least) l WHERE kind = 0 AND len(c.w) >= l.n)
), seeds AS (
  SELECT doc_id, item_id, i, j, spans.n, j - i AS diagonal FROM spans JOIN places USING (s, n)
), marked AS (
  SELECT *, CASE WHEN i = lag(i) OVER o + 1 THEN 0 ELSE 1 END AS new FROM seeds WINDOW o AS (PARTITION BY doc_id, item_id, diagonal ORDER BY i)
), runs AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM marked
), found AS (
  SELECT doc_id, item_id, max(i) - min(i) + any_value(n) AS match_words, min(j) AS doc_word, min(i) AS item_word FROM runs GROUP BY doc_id, item_id, diagonal, run
)
SELECT doc_id, item_id, CAST(match_words AS INTEGER) AS match_words, CAST(doc_word AS INTEGER) AS doc_word, CAST(item_word AS INTEGER) AS item_word
FROM found QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY match_words DESC, doc_word, item_word) = 1"""
