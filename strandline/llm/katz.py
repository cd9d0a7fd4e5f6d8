"""Katz backoff language model over token ids: third order, Good-Turing discounts, backoff weights, and scores of documents.

A document is its tokens and an end token, after two end tokens. Training counts token triples in numpy inside each batch and then
in one aggregation; the counts of pairs and single tokens are sums of those. Discounted probabilities and the backoff weight of
every context, exactly normalised by the mass that the next lower order gives to what wasn't seen, lie in a table of grams.
Scoring sends each chunk's distinct triples, with the places they occur in, to the buckets of their middle token, which hold all that the
recursion from triple to pair to token can ask for, and returns one sum for each document and bucket. The buckets of a frequent
middle token are split by the last one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import bpe, core

#: Counts up to this are discounted.
CUTOFF = 5
#: Grams in one part of the stored table, about; parts are at most as many as shuffle partitions.
PART = 500_000
#: Triples that a task counts at once, and grams that it packs at once.
COUNTED, PACKED = 8_000_000, 500_000
_ROW_BITS, _BITS = 13, 17
_MASK = (1 << _BITS) - 1
#: Codes: u, v, w of a triple one after the other; the marks tell the weight of the context u, v and the pair v, w.
CONTEXT, PAIR = 1 << 52, 1 << 53


@dataclass(frozen=True)
class Model:
    """grams: (code, value, v, w, part), stored: log probabilities of triples and pairs, and log backoff weights of contexts (u, v).

    unigram[w] and backoff[v] (of single-token contexts) are indexed by token id, as is counts, how often each id was seen.
    """

    grams: DataFrame
    unigram: np.ndarray
    backoff: np.ndarray
    counts: np.ndarray


def events(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(code of the triple that ends there, row) of every token and end of the rows that have tokens."""
    size = np.diff(at)
    some = np.flatnonzero(size)
    long = size[some] + 1
    row = np.repeat(some, long)
    word = np.full(len(row), end, np.int64)
    word[np.arange(len(ids)) + np.repeat(np.arange(len(some)), size[some])] = ids
    first = np.cumsum(long) - long
    before, last = np.roll(word, 1), np.roll(word, 2)
    before[first] = last[first] = end
    last[first[long > 1] + 1] = end
    return last << 2 * _BITS | before << _BITS | word, row


def discounts(frequencies: dict[int, int], cutoff: int = CUTOFF) -> np.ndarray:
    """The factor of each count up to cutoff, at 0 the one of larger counts. frequencies: how many grams have a count.

    Good-Turing with Katz's renormalisation. Where that isn't between 0 and 1, as in small samples, a count r gets
    1 - D / r with D = N1 / (N1 + 2 N2), or 1 / 2 if there are no single counts.
    """
    n = [0, *(frequencies.get(r, 0) for r in range(1, cutoff + 2))]
    d = 0.5 if not n[1] else min(0.9, n[1] / (n[1] + 2 * n[2]))
    top = (cutoff + 1) * n[cutoff + 1] / n[1] if n[1] else 1.0
    out = np.ones(cutoff + 1)
    for r in range(1, cutoff + 1):
        good = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top < 1 else 0.0
        out[r] = good if 0 < good < 1 else 1 - d / r
    return out


def unigrams(counts: np.ndarray, cutoff: int = CUTOFF) -> np.ndarray:
    """Discounted probabilities of all ids, those without a count alike; they sum to 1."""
    total = counts.sum()
    if not total:
        return np.full(len(counts), 1 / len(counts))
    factor = discounts({r: int((counts == r).sum()) for r in range(1, cutoff + 2)}, cutoff)
    p = np.where(counts > cutoff, counts, factor[np.minimum(counts, cutoff)] * counts) / total
    unseen = counts == 0
    if unseen.any() and p.sum() < 1 - 1e-12:
        p[unseen] = (1 - p.sum()) / unseen.sum()
    elif unseen.any():
        p = np.where(unseen, 1 / (total + unseen.sum()), counts / (total + unseen.sum()))
    return p / p.sum()


def _frequencies(grams: DataFrame, cutoff: int) -> dict[int, int]:
    return {r.n: r["count"] for r in grams.where(F.col("n") <= cutoff + 1).groupBy("n").count().collect()}


def _factor(table: np.ndarray, cutoff: int):
    return F.element_at(F.array(*[F.lit(float(x)) for x in table]), F.when(F.col("n") > cutoff, 1).otherwise(F.col("n").cast("int") + 1))


def _normalised():
    """(scale, backoff) columns of a context from its columns total, kept, lower.

    kept is the discounted count, lower the mass that the lower order gives to the words seen. If that is all, nothing is left to back
    off to and the seen words share 1; if nothing was discounted, there is one event more, for what wasn't seen.
    """
    total, kept, lower = F.col("total"), F.col("kept"), F.col("lower")
    full, none = 1 - lower < 1e-12, total - kept < 1e-9 * total
    scale = F.when(full, 1 / kept).when(none, 1 / (total + 1)).otherwise(1 / total)
    left = F.when(none, 1 / (total + 1)).otherwise(1 - kept / total)
    return scale, F.when(full, 0.0).otherwise(left / (1 - lower))


def train(docs: DataFrame, tokenizer: str = bpe.PATH, cutoff: int = CUTOFF) -> Model:
    """The model of all documents. Null and empty texts count nothing, repeated rows count each; an empty table gives equal probabilities.

    A text of any length is counted whole. What comes to the driver is bounded by the vocabulary. Other columns than text aren't read.
    """
    spark = docs.sparkSession

    def count(batches):
        coder, held = bpe.load(tokenizer), []

        def counted():
            codes = np.sort(np.concatenate(held))
            head = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            return pa.RecordBatch.from_arrays([pa.array(codes[head]), pa.array(np.diff(np.append(head, len(codes))))], ["code", "n"])

        for batch in batches:
            for _, _, data, offs in core.chunks(batch["text"]):
                if held and sum(map(len, held)) > COUNTED:
                    yield counted()
                    held = []
                held.append(events(*coder.encode(data, offs), coder.end)[0])
        if held and sum(map(len, held)):
            yield counted()

    counted = core.ids_only(docs, "doc_id", "text").select("text").mapInArrow(core.tidy(count), "code long, n long")
    triples = core.written(counted.groupBy("code").agg(F.sum("n").alias("n")))
    cut = lambda shift: F.shiftright("code", shift).bitwiseAND(F.lit(_MASK)).cast("int")
    # Every pair and token is the end of just one triple.
    pairs = core.written(triples.select(cut(_BITS).alias("v"), cut(0).alias("w"), "n").groupBy("v", "w").agg(F.sum("n").alias("n")))
    size = bpe.load(tokenizer).end + 1
    words = pairs.groupBy("w").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[words.w] = words.n
    unigram = unigrams(counts, cutoff)

    # Tables of one row for each token id are bounded by the vocabulary.
    lower = spark.createDataFrame(pa.table({"w": pa.array(np.arange(size), pa.int32()), "p1": unigram}))
    d = _factor(discounts(_frequencies(pairs, cutoff), cutoff), cutoff)
    scale, weight = _normalised()
    sums = pairs.join(F.broadcast(lower), "w").groupBy("v").agg(F.sum("n").alias("total"), F.sum(d * F.col("n")).alias("kept"), F.sum("p1").alias("lower"))
    sums = sums.select("v", scale.alias("scale"), weight.alias("backoff")).toPandas()
    backoff = np.ones(size)
    backoff[sums.v] = sums.backoff
    scales = spark.createDataFrame(sums[["v", "scale"]].astype({"v": "int32"}), "v int, scale double") if len(sums) else spark.createDataFrame([], "v int, scale double")
    second = pairs.join(F.broadcast(scales), "v").select("v", "w", (d * F.col("n") * F.col("scale")).alias("p2"))

    # A context has at most as many triples as the vocabulary has ids, so that its window is bounded.
    d = _factor(discounts(_frequencies(triples, cutoff), cutoff), cutoff)
    by = Window.partitionBy("u", "v")
    third = (
        triples.select("code", "n", cut(2 * _BITS).alias("u"), cut(_BITS).alias("v"), cut(0).alias("w"))
        .join(second, ["v", "w"])
        .select("code", "u", "v", "w", (d * F.col("n")).alias("kept_n"), F.sum("n").over(by).alias("total"), F.sum(d * F.col("n")).over(by).alias("kept"), F.sum("p2").over(by).alias("lower"), F.min("w").over(by).alias("one"))
        .withColumns({"scale": scale, "backoff": weight})
    )
    # The context's weight goes with its least word.
    context = (F.shiftleft(F.col("u").cast("long"), _BITS) + F.col("v") + F.lit(CONTEXT)).alias("code")
    rows = third.select(
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.col("code"), F.log(F.col("kept_n") * F.col("scale")).alias("value"), F.col("v"), F.col("w")),
                    F.when(F.col("w") == F.col("one"), F.struct(context, F.coalesce(F.log("backoff"), F.lit(float("-inf"))).alias("value"), F.col("v"), F.lit(-1).alias("w"))),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("x")
    ).select("x.*")
    rows = rows.unionByName(second.select((F.shiftleft(F.col("v").cast("long"), _BITS) + F.col("w") + F.lit(PAIR)).alias("code"), F.log("p2").alias("value"), "v", "w"))
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), triples.count() // PART))
    table = rows.withColumn("part", F.pmod(F.hash("v", "w"), F.lit(parts)))
    if parts > 1:
        table = table.repartitionById(parts, "part")
    return Model(core.written(table, "part"), unigram, backoff, counts)


def _pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(x) for x in arrays], np.uint32)
    return zstandard.ZstdCompressor(1).compress(sizes.tobytes() + b"".join(x.tobytes() for x in arrays))


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 4 * len(kinds), []
    for size, kind in zip(np.frombuffer(raw, np.uint32, len(kinds)).tolist(), kinds):
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return out


#: Of a post: u, v, w of its triples, how many rows each is in, the rows, and how often it is in each.
_POST = (np.uint16, np.uint16, np.uint16, np.uint16, np.uint16, np.uint16)
_WIDE = (np.uint32,) * 6


def _narrow(arrays):
    """One byte that tells the width, and the arrays packed."""
    small = all(not len(x) or x.max() < 1 << 16 for x in arrays)
    return bytes([small]) + _pack(*(x.astype(np.uint16 if small else np.uint32) for x in arrays))


def recursion(code: np.ndarray, keys: np.ndarray, values: np.ndarray, log_unigram: np.ndarray, log_backoff: np.ndarray) -> np.ndarray:
    """log P(w | u, v) of triples: the triple's own, or the context's weight and the pair's, or that of v and the token's. keys ascend."""

    def ask(which):
        if not len(keys):
            return np.zeros(len(which), bool), np.zeros(len(which))
        at = np.minimum(np.searchsorted(keys, which), len(keys) - 1)
        return keys[at] == which, values[at]

    seen, out = ask(code)
    todo = np.flatnonzero(~seen)
    if len(todo):
        pair = code[todo] & (1 << 2 * _BITS) - 1
        known, weight = ask(code[todo] >> _BITS | CONTEXT)
        both, value = ask(pair | PAIR)
        one = log_backoff[pair >> _BITS] + log_unigram[pair & _MASK]
        out[todo] = np.where(known, weight, 0.0) + np.where(both, value, one)
    return out


def scored(docs: DataFrame, model: Model, tokenizer: str = bpe.PATH) -> DataFrame:
    """(doc_id, tokens, logprob, perplexity) of every row with text; tokens counts the end token.

    Null and empty texts have no row, nor has an empty table; repeated rows have one each; a text of any length is scored whole.
    Other columns are not read.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A middle token that has more than an eighth of a bucket's share is dealt to several by the last token.
    shares = (1 + 8 * model.counts * buckets // max(1, int(model.counts.sum()))).astype(np.uint64)

    def cell(v, salt):
        return (core.mix(v.astype(np.uint64) << np.uint64(32) | salt.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)

    def bucket_of(v, w):
        return cell(v, core.mix(w.astype(np.uint64)) % shares[v])

    def post(batches):
        coder, task, number = bpe.load(tokenizer), TaskContext.get().partitionId(), 0
        for whole in batches:
            for first in range(0, whole.num_rows, 1 << _ROW_BITS):
                batch = whole.slice(first, 1 << _ROW_BITS)
                for lo, hi, data, offs in core.chunks(batch["text"]):
                    code, row = events(*coder.encode(data, offs), coder.end)
                    if not len(row):
                        continue
                    some = np.unique(row)
                    tokens = np.bincount(row, minlength=hi - lo)[some]
                    both = np.sort(code.view(np.uint64) << np.uint64(_ROW_BITS) | row.astype(np.uint64))
                    entry = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
                    n, both = np.diff(np.append(entry, len(both))), both[entry]
                    row, code = (both & np.uint64((1 << _ROW_BITS) - 1)).astype(np.int64), (both >> np.uint64(_ROW_BITS)).astype(np.int64)
                    head = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                    size, code = np.diff(np.append(head, len(code))), code[head]
                    v, w = code >> _BITS & _MASK, code & _MASK
                    bucket = bucket_of(v, w)
                    by = np.argsort(bucket.astype(np.uint16 if buckets < 1 << 16 else np.uint32), kind="stable")
                    bucket, code, v, w, size, head = bucket[by], code[by], v[by], w[by], size[by], head[by]
                    ends = np.cumsum(size)
                    entries = np.arange(int(size.sum())) + np.repeat(head - (ends - size), size)
                    row, n = row[entries], n[entries]
                    used = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                    blobs = [b""]
                    for i, j in zip(used.tolist(), [*used[1:].tolist(), len(bucket)]):
                        p, q = int(ends[i] - size[i]), int(ends[j - 1])
                        blobs.append(_narrow((code[i:j] >> 2 * _BITS, v[i:j], w[i:j], size[i:j], row[p:q], n[p:q])))
                    rows = len(blobs)
                    # The documents' ids go in a row of their own.
                    to = np.concatenate([[number % buckets], bucket[used]])
                    listed = lambda xs, kind: pa.array([xs] + [None] * (rows - 1), pa.list_(kind))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(to, pa.int32()), pa.array([1] * rows, pa.int8()), pa.array([task << 32 | number] * rows, pa.int64()),
                            pa.array(blobs, pa.binary()), listed(batch["doc_id"].slice(lo, hi - lo).take(pa.array(some)).to_pylist(), pa.int64()), listed(tokens.tolist(), pa.int64()), listed(some.tolist(), pa.int32()),
                        ],
                        ["bucket", "kind", "chunk", "blob", "ids", "tokens", "rows"],
                    )
                    number += 1

    def spread(batches):
        """The model's rows by buckets, many in one blob; a context's weight goes to all of its middle token's."""

        def packed(parts):
            bucket, code, value = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(bucket, kind="stable")
            bucket, code, value = bucket[order], code[order], value[order]
            used = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            blobs = [_pack(code[i:j], value[i:j]) for i, j in zip(used.tolist(), [*used[1:].tolist(), len(bucket)])]
            return pa.RecordBatch.from_arrays([pa.array(bucket[used].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        parts, held = [], 0
        for batch in batches:
            v, w = batch["v"].to_numpy(), batch["w"].to_numpy()
            many = np.where(w < 0, shares[v], 1).astype(np.int64)
            of = np.repeat(np.arange(len(v)), many)
            salt = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            bucket = np.where(w[of] < 0, cell(v[of], salt), bucket_of(v[of], np.maximum(w[of], 0)))
            parts.append((bucket, batch["code"].to_numpy()[of], batch["value"].to_numpy()[of]))
            held += len(of)
            if held > PACKED + 50 * buckets:
                yield packed(parts)
                parts, held = [], 0
        if held:
            yield packed(parts)

    with np.errstate(divide="ignore"):
        log_unigram, log_backoff = np.log(model.unigram), np.log(model.backoff)

    def look_up(batches):
        """Rows come by bucket, the model's before the posts; only one bucket's grams are held."""
        now, parts, keys, values = None, [], None, None
        for batch in batches:
            bucket, kind = batch["bucket"].to_numpy(), batch["kind"].to_numpy()
            step = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])])) if len(bucket) else []
            for i, j in zip(step, [*step[1:], len(bucket)]):
                if bucket[i] != now:
                    now, parts, keys = bucket[i], [], None
                part = batch.slice(i, j - i)
                if kind[i] == 0:
                    parts += [_unpack(x.as_py(), np.int64, np.float64) for x in part["blob"]]
                    continue
                if keys is None:
                    keys, values = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0))
                    # A context's row comes once for each of its buckets, and so perhaps twice to one.
                    keys, first = np.unique(keys, return_index=True)
                    values, parts = values[first], []
                sums = []
                for blob in part["blob"]:
                    raw = blob.as_py()
                    if not raw:
                        sums.append(None)
                        continue
                    u, v, w, size, row, n = _unpack(raw[1:], *(_POST if raw[0] else _WIDE))
                    value = recursion(u.astype(np.int64) << 2 * _BITS | v.astype(np.int64) << _BITS | w, keys, values, log_unigram, log_backoff)
                    rows = np.unique(row)
                    sums.append(_pack(rows.astype(np.uint16), np.bincount(np.searchsorted(rows, row), np.repeat(value, size) * n)))
                yield pa.RecordBatch.from_arrays([part["chunk"], pa.array(sums, pa.binary()), part["ids"], part["tokens"], part["rows"]], ["chunk", "sums", "ids", "tokens", "rows"])

    def gather(parts: pa.Table) -> pa.Table:
        flat = lambda c: parts[c].combine_chunks().flatten()
        rows, tokens = flat("rows").to_numpy(), flat("tokens").to_numpy()
        total = np.zeros(int(rows.max()) + 1)
        # In one order, so that the sums don't depend on how the rows arrive.
        for blob in sorted(x for x in parts["sums"].to_pylist() if x):
            at, sums = _unpack(blob, np.uint16, np.float64)
            total[at] += sums
        total = total[rows]
        return pa.table({"doc_id": flat("ids"), "tokens": tokens, "logprob": total, "perplexity": np.exp(-total / tokens)})

    posts = core.ids_only(docs, "doc_id", "text").mapInArrow(core.tidy(post), "bucket int, kind byte, chunk long, blob binary, ids array<long>, tokens array<long>, rows array<int>")
    grams = model.grams.select("code", "value", "v", "w").mapInArrow(core.tidy(spread), "bucket int, blob binary")
    grams = grams.select("bucket", F.lit(0).cast("byte").alias("kind"), F.lit(None).cast("long").alias("chunk"), "blob", *(F.lit(None).cast(t).alias(c) for c, t in (("ids", "array<long>"), ("tokens", "array<long>"), ("rows", "array<int>"))))
    met = grams.unionByName(posts).repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    looked = met.mapInArrow(core.tidy(look_up), "chunk long, sums binary, ids array<long>, tokens array<long>, rows array<int>")
    return looked.groupBy("chunk").applyInArrow(gather, "doc_id long, tokens long, logprob double, perplexity double").withColumn("tokens", F.col("tokens").cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    """The whole table under the model of the whole table."""
    docs = core.read(spark, sf_dir, "documents")
    return scored(docs, train(docs))
