"""Near duplicates by DartMinHash: weighted minwise signatures from hashed darts, joined by bands.

The plane of (weight, rank) of every element is tiled with cells of area 1, each of which holds a Poisson number of darts
at hashed places, the same for every document. A document throws the darts that fall under its weight and under a rank
bound that gives k ln k + 2k darts in all; each dart goes to a hashed coordinate, which keeps the one of least rank. Where a
coordinate stays empty, the bound is doubled. Two signatures agree in a coordinate with the probability of the weighted
Jaccard similarity. The cost is one cell per element and a fixed number of darts, not elements times coordinates.
Pairs whose estimate is clearly over the threshold are links at once. All others that meet it are found and decided exactly: shingles are
counted over all texts, each text's are ordered by how rare they are, and two texts whose similarity is t or more share one of the first
n - ceil(t n) + 1 of each (prefix filtering). Shingles of one text alone come first and need no partner, so that few are left to be met.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import core
from strandline.llm.graph import components

#: Coordinates, coordinates in a band, words in a shingle, least share of equal coordinates.
K, ROWS, SHINGLE, THRESHOLD = 128, 3, 3, 0.45
#: Standard errors by which an estimate must be over the threshold to be a link without its shingles.
DOUBT = 4.0
#: Bytes of text whose shingles one bucket counts, about, and the parts of a bucket (a power of two), of which one at a time is counted. A text has a part for its shared shingles too.
BUCKET, SPLIT = 64 << 20, 4
#: Pairs that a bucket holds before it drops repeated ones.
HELD = 1 << 22
#: Cells whose darts are thrown at once.
CELLS = 1 << 17
#: Times the rank bound is doubled at most. A coordinate that is empty after 2 ** 20 times the expected darts has no probability to speak of; it is an error.
DOUBLINGS = 20
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])


def shingles(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight): the hashed runs of n words of each row with their counts; a row of fewer words is one shingle."""
    g = core.grams(h, n)
    inside = row[: len(g)] == row[n - 1 :] if len(g) else np.zeros(0, bool)
    rows, size = np.unique(row, return_counts=True)
    short = rows[size < n]
    at = np.searchsorted(row, short)
    lone = h[at].copy()
    for k in range(1, n - 1):
        more = size[size < n] > k
        lone[more] = core.mix(lone[more] * np.uint64(31) + h[at[more] + k])
    rows, g = np.concatenate([row[: len(g)][inside], short]), np.concatenate([g[inside], lone])
    key = g ^ core.mix(rows.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    head = np.flatnonzero(_new(key[order]))
    # Any of equal ones stands for all; in order of rows.
    first, count = np.minimum.reduceat(order, head) if len(head) else head, np.diff(np.r_[head, len(key)])
    again = np.argsort(first)
    return rows[first[again]], g[first[again]], count[again]


def _new(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    return np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])


def throw(row, element, weight, bound):
    """(row, dart, rank) of all darts under each element's weight and its row's rank bound."""
    out = ([], [], [])
    top = bound[row]
    seed = core.mix(element)
    for nu in range(int(math.log2(1 + weight.max())) + 1):
        high = np.flatnonzero(weight > 2**nu - 1)
        if not len(high):
            break
        for rho in range(int(math.log2(1 + top[high].max())) + 1):
            high = high[top[high] > 2**rho - 1]
            if not len(high):
                break
            wide, tall = 2.0 ** (nu - rho), 2.0 ** (rho - nu)
            # The cells that an element reaches are taken together, so that short texts and frequent words, which reach many, take no more calls.
            across = np.clip(np.ceil((weight[high] - (2**nu - 1)) / wide), 1, 2**rho).astype(np.int64)
            up = np.clip(np.ceil((top[high] - (2**rho - 1)) / tall), 1, 2**nu).astype(np.int64)
            ends = np.cumsum(across * up)
            names = None if nu + rho > 12 else core.mix(_cells(nu, rho, np.repeat(np.arange(2**rho), 2**nu), np.tile(np.arange(2**nu), 2**rho)))
            lo = 0
            while lo < len(high):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CELLS, "right")))
                size = across[lo:hi] * up[lo:hi]
                some = np.repeat(high[lo:hi], size)
                w, r = np.divmod(np.arange(len(some)) - np.repeat(np.cumsum(size) - size, size), np.repeat(up[lo:hi], size))
                lo = hi
                z = core.mix(seed[some] ^ (core.mix(_cells(nu, rho, w, r)) if names is None else names[w * 2**nu + r]))
                w0, r0 = 2**nu - 1 + w * wide, 2**rho - 1 + r * tall
                darts = np.searchsorted(_POISSON, core.uniform(z), "right")
                j, left = 0, np.flatnonzero(darts)
                while len(left):
                    a = core.mix(z[left] + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 % 2**64))
                    i = some[left]
                    rank = r0[left] + tall * core.uniform(core.mix(a))
                    ok = (w0[left] + wide * core.uniform(a) < weight[i]) & (rank < top[i])
                    out[0].append(row[i[ok]])
                    out[1].append(a[ok])
                    out[2].append(rank[ok])
                    j += 1
                    left = left[darts[left] > j]
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)


def _cells(nu: int, rho: int, w: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The numbers of the cells (w, r) of a tile."""
    return (((w * 2654435761 + r) & 0xFFFFFFFF).astype(np.uint64) << np.uint64(32)) | np.uint64(nu | rho << 16)


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, k: int = K) -> np.ndarray:
    """The k dart names of each row; a row without elements has zeros."""
    total = np.bincount(row, weight, rows)
    sig = np.zeros((rows, k), np.uint64)
    t, todo = k * math.log(k) + 2 * k, np.flatnonzero(total)
    weight = weight.astype(np.float64)
    for double in range(DOUBLINGS):
        if not len(todo):
            break
        place = np.full(rows, -1)
        place[todo] = np.arange(len(todo))
        mine = place[row] >= 0
        dart_row, dart, rank = throw(place[row[mine]], element[mine], weight[mine], t * 2.0**double / total[todo])
        slot = dart_row.astype(np.int64) * k + (core.mix(dart ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(k)).astype(np.int64)
        least = np.full(len(todo) * k, np.inf)
        np.minimum.at(least, slot, rank)
        first = rank == least[slot]
        names = np.zeros(len(todo) * k, np.uint64)
        names[slot[first]] = dart[first]
        full = np.isfinite(least).reshape(-1, k).all(1)
        sig[todo[full]] = names.reshape(-1, k)[full]
        todo = todo[~full]
    if len(todo):
        raise ArithmeticError("a coordinate got no dart")
    return sig


def elements(row: np.ndarray, g: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, element): a shingle that occurs w times is w elements, so that the weighted similarity is that of plain sets; rows ascend."""
    times = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
    row, g = np.repeat(row, weight), np.repeat(g, weight)
    g = np.where(times > 0, core.mix(g + times.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), g)
    order = np.argsort(row, kind="stable")
    return row[order], g[order]


def _spared(run):
    """run, a function of a group, and then the memory that it used given back."""

    def spared(table: pa.Table) -> pa.Table:
        out = run(table)
        core.give_back()
        return out

    return spared


def _needed(n, threshold: float):
    """Elements that a text of n shares with any text as similar as the threshold, at least."""
    return np.ceil(threshold * n - 1e-9).astype(np.int64)


def _wholes(row: np.ndarray, e: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of all elements whatever their order, number of elements) of the rows there."""
    ends = np.searchsorted(row, there, "right")
    size = ends - np.searchsorted(row, there)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(core.mix(e), dtype=np.uint64)])
    return core.mix(sums[ends] - sums[ends - size] + size.astype(np.uint64)), size


def _sign(k: int, rows: int, n: int):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in core.chunks(batch["text"], core.CHUNK // 2):
                h, _, _, row = core.words(data, offs)
                if not len(h):
                    continue
                row, g, weight = shingles(h, row, n)
                sig = signatures(row, g, weight, hi - lo, k)
                there = np.flatnonzero(sig.any(1))
                sig = sig[there]
                bands = k // rows
                keys = np.zeros((len(sig), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
                for r in range(rows):
                    keys = core.mix(keys * np.uint64(0xD6E8FEB86659FD93) + sig[:, r : bands * rows : rows])
                whole, size = _wholes(*elements(row, g, weight), there)
                small = np.ascontiguousarray(core.mix(sig).astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(lo, hi - lo).take(pa.array(there)),
                        pa.array(core.signed(whole)),
                        pa.array(size.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * bands), pa.array(core.signed(keys.ravel()))),
                        pa.array([x.tobytes() for x in small], pa.binary()),
                    ],
                    ["doc_id", "whole", "n", "bands", "sig"],
                )

    return run


def _order(key: np.ndarray) -> np.ndarray:
    """The stable order of whole numbers from 0; plain numbers sort several times as fast as places."""
    if not len(key) or int(key.max()) >> 32 or len(key) >> 32:
        return np.argsort(key, kind="stable")
    both = (key.astype(np.uint64) << np.uint64(32)) | np.arange(len(key), dtype=np.uint64)
    both.sort()
    return (both & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _pack(text: np.ndarray, whole: np.ndarray, key: np.ndarray, *fields: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(key, blob) for each key: its number of runs, their texts' wholes and numbers of values, then the fields' values; rows ascend by key, then text. A run has 255 values at most."""
    if not len(key):
        return key, []
    new = _new(key)
    runs = np.flatnonzero(new | _new(text))
    nth = np.arange(len(key)) - np.repeat(runs, np.diff(np.r_[runs, len(key)]))
    heads = np.flatnonzero(nth % 255 == 0)
    count = np.diff(np.r_[heads, len(key)]).astype(np.uint8)
    names, starts = whole[text[heads]].astype(np.int64), np.flatnonzero(new)
    at = np.searchsorted(heads, np.r_[starts, len(key)])
    blobs = []
    for i, j, x, y in zip(at[:-1].tolist(), at[1:].tolist(), starts.tolist(), np.r_[starts[1:], len(key)].tolist()):
        blobs.append(np.array([j - i], np.int64).tobytes() + names[i:j].tobytes() + count[i:j].tobytes() + b"".join(f[x:y].tobytes() for f in fields))
    return key[starts], blobs


def _unpack(blobs, *types) -> list[np.ndarray]:
    """[whole of each run, values of each run, each field] of all blobs."""
    out = [[] for _ in range(2 + len(types))]
    for blob in blobs:
        x = blob.as_buffer()
        m = int(np.frombuffer(x, np.int64, 1)[0])
        out[0].append(np.frombuffer(x, np.int64, m, 8))
        out[1].append(np.frombuffer(x, np.uint8, m, 8 + 8 * m))
        at, size = 8 + 9 * m, int(out[1][-1].sum(dtype=np.int64))
        for o, t in zip(out[2:], types):
            o.append(np.frombuffer(x, t, size, at))
            at += size * np.dtype(t).itemsize
    return [o[0] if len(o) == 1 else np.concatenate([np.zeros(0, t), *o]) for o, t in zip(out, (np.int64, np.uint8, *types))]


def _planes(e: np.ndarray) -> bytes:
    """The first bytes of all elements, then the second ones and so on: those of high places are zeros, which compress."""
    return e.view(np.uint8).reshape(-1, 8).T.tobytes()


def _elements(planes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes.as_buffer(), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _spread(n: int, buckets: int):
    """(bucket, data): the elements of all texts by bucket, 32 bits of each."""

    def run(batches):
        for batch in batches:
            for _, _, data, offs in core.chunks(batch["text"], core.CHUNK // 2):
                h, _, _, row = core.words(data, offs)
                if not len(h):
                    continue
                row, e = elements(*shingles(h, row, n))
                there, text = np.unique(row, return_inverse=True)
                whole = core.signed(_wholes(row, e, there)[0])
                bucket = ((e >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
                order = _order(bucket)
                keys, blobs = _pack(text[order], whole, bucket[order], e[order].astype(np.uint32))
                for i in range(0, len(keys), 1 + (len(keys) << 24) // len(e)):
                    j = i + 1 + (len(keys) << 24) // len(e)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i:j]), pa.array(blobs[i:j], pa.binary())], ["bucket", "data"])

    return run


def _estimate(batches):
    """share: the estimated similarity of sig_a and sig_b."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            # Two different darts share a byte one time in 256.
            share = ((a == b).mean(1) - 1 / 256) / (1 - 1 / 256)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(share)], ["a", "b", "share"])


def _count(parts: int):
    """The elements of a bucket that more than one of all different texts have, sent to the part of each text, with a byte that grows with the number of texts."""

    def run(table: pa.Table) -> pa.Table:
        blobs = [_unpack([blob], np.uint32) for blob in table["data"]]
        names, text = np.unique(np.concatenate([whole for whole, _, _ in blobs]), return_inverse=True)
        text = np.split(text.astype(np.uint32), np.cumsum([len(whole) for whole, _, _ in blobs])[:-1])
        blobs = [(t, size, e) for t, (_, size, e) in zip(text, blobs)]
        shared, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        for k in range(SPLIT):
            both = []
            for t, size, e in blobs:
                some = np.flatnonzero(e >> np.uint32(32 - SPLIT.bit_length() + 1) == k)
                both.append((e[some].astype(np.uint64) << np.uint64(32)) | np.repeat(t, size)[some])
            both = np.concatenate(both)
            both.sort()
            # Of texts with the same elements one counts.
            both = both[_new(both)]
            count = np.diff(np.r_[np.flatnonzero(_new(both >> np.uint64(32))), len(both)])
            shared.append(both[np.repeat(count > 1, count)])
            count = count[count > 1]
            counts.append(np.repeat((np.log2(count) * 8).astype(np.uint8), count))
            del both, count
        del blobs
        shared, counts = np.concatenate(shared), np.concatenate(counts)
        part, text = (names % parts).astype(np.int32), (shared & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        place = np.empty(len(names), np.uint32)
        place[_order(part)] = np.arange(len(names))
        order = _order(place[text])
        text = text[order]
        keys, blobs = _pack(text, names, part[text], (shared[order] >> np.uint64(32)).astype(np.uint32), counts[order])
        bucket = pa.array([table["bucket"][0].as_py()] * len(keys), pa.int32())
        return pa.table([pa.array(keys, pa.int32()), bucket, pa.array(blobs, pa.binary())], ["part", "bucket", "data"])

    return run


def _gather(threshold: float):
    """The shared elements of each text of a part, rarest first; texts that have too few of them to be like another are left out."""

    def run(table: pa.Table) -> pa.Table:
        known = table.filter(table["data"].is_null()).sort_by("whole")
        # In a text's blobs elements ascend, and so they do over its buckets.
        back = table.filter(table["data"].is_valid()).sort_by("bucket")
        name, root, n = (known[c].to_numpy() for c in ("whole", "root", "n"))
        at, e, rank = [], [], []
        for bucket, blob in zip(back["bucket"].to_pylist(), back["data"]):
            w, size, x, r = _unpack([blob], np.uint32, np.uint8)
            where = np.searchsorted(name, w)
            if len(name) == 0 or (name[np.minimum(where, len(name) - 1)] != w).any():
                raise ValueError("two readings of the texts differ")
            at.append(np.repeat(where.astype(np.uint32), size))
            e.append(x.astype(np.uint64) | np.uint64(bucket << 32))
            rank.append(r)
        if not at:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary())], ["whole", "root", "n", "set"])
        at, e, rank = (np.concatenate(x) for x in (at, e, rank))
        size = np.bincount(at, minlength=len(name))
        enough = size >= np.maximum(1, _needed(n, threshold))
        keep = enough[at]
        at, e, rank = at[keep], e[keep], rank[keep]
        order = _order((at.astype(np.uint64) << np.uint64(8)) | rank)
        e, ends = e[order], np.cumsum(size[enough])
        sets = [_planes(e[i:j]) for i, j in zip((ends - size[enough]).tolist(), ends.tolist())]
        return pa.table([pa.array(name[enough]), pa.array(root[enough]), pa.array(n[enough].astype(np.int32)), pa.array(sets, pa.binary())], ["whole", "root", "n", "set"])

    return run


_POST = np.dtype([("e", np.uint32), ("n", np.int32), ("place", np.int32), ("whole", np.int64), ("root", np.int64)])


def _post(threshold: float):
    """(bucket, data): the elements among the first n - needed + 1 of each text; a field's values lie together."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, size = batch["n"].to_numpy().astype(np.int64), np.array([len(x) // 8 for x in batch["set"].to_pylist()])
            first = n - size
            take = np.clip(n - _needed(n, threshold) + 1 - first, 0, size)
            e = np.concatenate([_elements(x)[:t] for x, t in zip(batch["set"], take.tolist())])
            text = np.repeat(np.arange(len(n)), take)
            posts = {"n": n[text], "place": first[text] + np.arange(len(e)) - np.repeat(np.cumsum(take) - take, take), "whole": batch["whole"].to_numpy()[text], "root": batch["root"].to_numpy()[text]}
            bucket = (e >> np.uint64(32 - SPLIT.bit_length() + 1)).astype(np.int32)
            order = _order(bucket)
            bucket, posts = bucket[order], {"e": e[order]} | {c: x[order] for c, x in posts.items()}
            heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
            blobs = [b"".join(posts[c][i:j].astype(_POST[c]).tobytes() for c in _POST.names) for i, j in zip(heads.tolist(), np.r_[heads[1:], len(bucket)].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[heads]), pa.array(blobs, pa.binary())], ["bucket", "data"])

    return run


def meet(e, n, place, whole, root, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): all pairs of texts of different roots that share an element of e, but those whose lengths and places in their texts leave no room for the threshold."""
    order = np.lexsort((n, e))
    e, n, place, root = e[order], n[order].astype(np.int64), place[order].astype(np.int64), root[order]
    names, text = np.unique(whole[order], return_inverse=True)
    end = np.searchsorted(e, e, "right")
    head = np.searchsorted(e, e)
    # A group whose texts have one root has no pair to give.
    low, high = (f.reduceat(root, np.unique(head)) if len(root) else root for f in (np.minimum, np.maximum))
    many = np.repeat(low != high, np.diff(np.r_[np.unique(head), len(e)]))
    i, step, out, held = np.flatnonzero(many), 1, [np.zeros(0, np.int64)], 0
    while len(i):
        # Lengths ascend in a group: one that is too long for i is followed by longer ones.
        i = i[i + step < end[i]]
        i = i[n[i] >= threshold * n[i + step] - 1e-6]
        j = i + step
        room = np.minimum(n[i] - place[i], n[j] - place[j])
        ok = (root[i] != root[j]) & (room * (1 + threshold) >= threshold * (n[i] + n[j]) - 1e-6)
        a, b = text[i[ok]], text[j[ok]]
        out.append(np.minimum(a, b) * len(names) + np.maximum(a, b))
        held += len(out[-1])
        if held > HELD:
            out = [np.unique(np.concatenate(out))]
            held = len(out[0]) // 2
        step += 1
    pairs = np.unique(np.concatenate(out))
    return names[pairs // max(1, len(names))], names[pairs % max(1, len(names))]


def _meet(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        columns = {c: [] for c in _POST.names}
        for blob in table["data"]:
            x, at = np.frombuffer(blob.as_buffer(), np.uint8), 0
            m = len(x) // _POST.itemsize
            for c in _POST.names:
                to = at + m * _POST[c].itemsize
                columns[c].append(np.frombuffer(x[at:to].tobytes(), _POST[c]))
                at = to
        a, b = meet(*(np.concatenate(columns[c]) for c in _POST.names), threshold)
        return pa.table([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _verified(least: float):
    """The pairs whose similarity is least or more. Elements of one text alone aren't in the sets, but in n."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b, n, m in zip(batch["set_a"], batch["set_b"], batch["n_a"].to_pylist(), batch["n_b"].to_pylist()):
                both = len(np.intersect1d(_elements(a), _elements(b), assume_unique=True))
                keep.append(both / (n + m - both) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def duplicates(docs: DataFrame, threshold: float = THRESHOLD, k: int = K, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, keep_id, exact) for every document but the kept one of each group of near duplicates; any other is a group of its own.

    A group is a connected component of pairs whose weighted Jaccard similarity of word shingles (case is ignored) is threshold or more. No
    such pair is left out: those whose signatures meet in a band and whose estimate is DOUBT standard errors over the threshold are links
    at once, and every pair between the groups of these is found by the rare shingles that it must share, and decided by its shingles.
    A group keeps its least doc_id. exact: the shingles are the same as those of another document of the group; of such documents one
    stands for all. In a band's bucket every text is compared with two of it, the first and the last by hash, which saves comparisons and loses none.
    Null and empty texts and null ids are in no group; rows of one doc_id are one document. A text without words is empty; one of any length is
    signed whole. An empty table gives no rows.
    """
    texts = core.ids_only(docs, "doc_id", "text").where("doc_id is not null")
    buckets = 1 + (texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // BUCKET
    parts = buckets * SPLIT
    most = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sig = core.written(texts.mapInArrow(core.tidy(_sign(k, rows, shingle)), "doc_id long, whole long, n int, bands array<long>, sig binary"))
    # Frequent texts and bands are aggregated before they are shuffled, and met by joins, which split a frequent key.
    reps = core.written(sig.groupBy("whole").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    members = reps.select("whole", F.explode("bands").alias("band"))
    met = members.groupBy("band").agg(F.min("whole").alias("least"), F.max("whole").alias("last")).where("least < last").select(F.col("band").alias("bucket"), "least", "last")
    edges = members.join(met, F.col("band") == F.col("bucket")).select(F.col("whole").alias("a"), F.explode(F.array("least", "last")).alias("b")).where("a <> b")
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = (reps.select(F.col("whole").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    doubt = DOUBT * math.sqrt(threshold * (1 - threshold) / k)
    sure = edges.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(core.tidy(_estimate), "a long, b long, share double").where(F.col("share") >= threshold + doubt).select("a", "b")
    # The texts of a row of one doc_id belong together.
    ids = sig.select("doc_id", "whole").distinct()
    bound = ids.groupBy("doc_id").agg(F.min("whole").alias("a"), F.max("whole").alias("most")).where("a < most").select("doc_id", "a").join(ids, "doc_id").select("a", F.col("whole").alias("b")).where("a <> b")
    first = components(sure.unionByName(bound))
    # A text is sent once, to the buckets of its elements; what is shared comes back to its part, where its root is.
    known = reps.join(first, F.col("whole") == F.col("node"), "left").select(F.pmod("whole", F.lit(parts)).cast("int").alias("part"), F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("data"), "whole", F.coalesce("root", "whole").alias("root"), "n")
    blobs = texts.mapInArrow(core.tidy(_spread(shingle, buckets)), "bucket int, data binary")
    back = blobs.repartitionById(min(buckets, most), "bucket").groupBy("bucket").applyInArrow(_spared(_count(parts)), "part int, bucket int, data binary")
    back = back.select("part", "bucket", "data", F.lit(None).cast("long").alias("whole"), F.lit(None).cast("long").alias("root"), F.lit(None).cast("int").alias("n"))
    sets = core.written(known.unionByName(back).repartitionById(min(parts, most), "part").groupBy("part").applyInArrow(_spared(_gather(threshold)), "whole long, root long, n int, set binary"))
    posts = sets.mapInArrow(core.tidy(_post(threshold)), "bucket int, data binary")
    pairs = core.written(posts.repartitionById(min(parts, most), "bucket").groupBy("bucket").applyInArrow(_spared(_meet(threshold)), "a long, b long").distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    some = core.written(sets.join(wanted, F.col("whole") == F.col("id"), "left_semi").select("whole", "n", "set"))
    left, right = (some.select(F.col("whole").alias(c), F.col("n").alias(f"n_{c}"), F.col("set").alias(f"set_{c}")) for c in "ab")
    checked = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b", "n_a", "n_b").mapInArrow(core.tidy(_verified(threshold)), "a long, b long")
    root = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(checked))
    groups = reps.select("whole", "rep").join(root, F.col("whole") == F.col("node"), "left").select("whole", "rep", F.coalesce("root", "whole").alias("root"))
    kept = groups.groupBy("root").agg(F.min("rep").alias("keep_id"))
    found = ids.join(groups.join(kept, "root").select("whole", "rep", "keep_id"), "whole").select("doc_id", "keep_id", (F.col("doc_id") != F.col("rep")).alias("exact"))
    return found.where("doc_id <> keep_id").groupBy("doc_id").agg(F.min("keep_id").alias("keep_id"), F.max("exact").alias("exact"))


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """docs without those that duplicates() lists, all columns as they are."""
    gone = core.written(duplicates(docs, **parameters).select(F.col("doc_id").alias("gone_id")))
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return duplicates(core.read(spark, sf_dir, "documents"))
