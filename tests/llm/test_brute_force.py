"""Each operator against a brute-force version, an exact round trip or an exact identity."""

import collections
import io
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import automaton, bpe, core, decontaminate, graph, katz, minhash, packing, registry, secrets, suffixes, toxicity, training_order, transport, warc

SF = "/root/testdata/sf0.001"


def tokens(text):
    return re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group(0).lower(), text or ""))


@pytest.fixture(scope="module")
def docs(spark):
    return core.read(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "benchmark"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    mine, theirs = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLE[name]).df()
    assert set(mine.columns) == set(theirs.columns)
    columns = sorted(mine.columns)
    assert sorted(map(tuple, mine[columns].astype(str).values.tolist())) == sorted(map(tuple, theirs[columns].astype(str).values.tolist()))


def test_words_and_chunks():
    texts = ["Hello, World", None, "", "é-x1 y", "a" * 50, "b a"]
    col = pa.array(texts)
    for limit in (1, 13, 1 << 20):
        got = []
        for lo, hi, data, offs in core.chunks(col, limit):
            h, start, end, row = core.words(data, offs)
            got += [(lo + int(r), data[s:e].tobytes().decode().lower(), int(x)) for s, e, r, x in zip(start, end, row, h)]
        assert [(r, w) for r, w, _ in got] == [(i, w) for i, t in enumerate(texts) for w in tokens(t)]
        assert len({x for _, w, x in got}) == len({w for _, w, _ in got})


def test_automaton_is_one_pass_of_all_rules(texts):
    auto, compiled = automaton.Automaton(list(secrets.RULES.values())), [re.compile(p.encode()) for p in secrets.RULES.values()]
    assert auto.states <= auto.subsets
    random.seed(1)
    made = ["AKIA" + "A1" * 8, "xAKIA" + "A1" * 8, "AKIA" + "A1" * 8 + "B", "ghp_" + "a" * 36, "pwd: hunter22", "Password=abc", "TOKEN = 'abcdefghij012345'", "-----BEGIN RSA PRIVATE KEY-----", "eyJa.eyJb.c-d", "https://bob:pass1@host", "sk-" + "z" * 33, "xoxb-1-2-abc", "Bearer " + "q" * 20, "AIza" + "b" * 35, "é" + "AKIA" + "A1" * 8 + "é"]
    cases = list(texts.values()) + [random.choice(["", " ", "é", "."]).join(random.sample(made, 3)) for _ in range(300)] + made + [made[0] + " " * 5000 + made[3]]
    got = secrets.hits(pa.array(cases), auto)
    want = {i: {r for r, p in enumerate(compiled) if p.search(t.encode())} for i, t in enumerate(cases)}
    assert got == {i: x for i, x in want.items() if x}


def test_lanes_equal_one_lane():
    auto = automaton.Automaton([r"a[b-d]+e", r"\bxyz\b", r"(?i)foo(?:bar|baz){2,3}"])
    random.seed(2)
    data = np.array(random.choices([*b"abcdexyz fFoObarBZ", 255], k=50_000), np.uint8)
    one = auto.ends(data, lanes=1)
    for lanes, warm in ((7, 64), (190, 0), (64, 3)):
        many = auto.ends(data, lanes, warm)
        assert np.array_equal(one[0], many[0]) and np.array_equal(one[1], many[1])
    assert len(one[0])


@pytest.mark.parametrize("text,score", [
    ("you are an idiot", 1.5), ("an idiot here", 1.0), ("you are not an idiot", 0.0), ("he said you are an idiot", 0.3), ("i will kill you", 2.0),
    ("they kill time", 0.0), ("he wrote i will kill you", 0.0), ("not today you idiot", 1.5), ("nothing at all", 0.0), ("idiot moron", 2.0),
])
def test_grammar(text, score):
    total, _ = toxicity.scores(pa.array([text, None, text.upper() + "."]), toxicity.grammar())
    assert total.tolist() == pytest.approx([score, 0, score])


def test_composition_is_the_cascade():
    def run(t, xs):
        s, out = 0, []
        for x in xs:
            out.append(t.out[s][x])
            s = t.next[s][x]
        return out

    a = toxicity.transducer(2, lambda s, c: c % 2, lambda s, c: (c + s) % toxicity.CLASSES)
    b = toxicity.transducer(3, lambda s, c: (s + c) % 3, lambda s, c: (c * (s + 1)) % toxicity.CLASSES)
    random.seed(3)
    for _ in range(50):
        xs = random.choices(range(toxicity.CLASSES), k=20)
        assert run(b.after(a), xs) == run(b, run(a, xs))


def test_learned_insults_hold_out(spark):
    random.seed(4)
    base = [f"w{i}" for i in range(400)]
    data, labels = [], []
    for i in range(600):
        words = random.choices(base, k=40)
        if i % 6 == 0:
            for _ in range(4):
                words.insert(random.randrange(len(words)), random.choice(["grumf", "blarg", "zonk"]))
        data.append((i, " ".join(words)))
        if i < 400:
            labels.append((i, int(i % 6 == 0)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    found = {r.doc_id for r in toxicity.rejected(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert found == set(range(0, 600, 6))


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    pairs, rows, elements, weights = [], [], [], []
    for p in range(60):
        n = int(rng.integers(3, 400))
        ids = rng.integers(0, 1 << 63, n).astype(np.uint64)
        a, b = rng.integers(1, 6, n), rng.integers(1, 6, n)
        b = np.where(rng.random(n) < rng.random(), a, b) * (rng.random(n) > 0.1)
        b[0] = max(1, b[0])
        pairs.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
        for k, w in enumerate((a, b)):
            keep = w > 0
            rows.append(np.full(keep.sum(), 2 * p + k))
            elements.append(ids[keep])
            weights.append(w[keep])
    sig = minhash.signatures(np.concatenate(rows), np.concatenate(elements), np.concatenate(weights), 120, 128)
    assert (sig != 0).all()
    error = np.array([(sig[2 * p] == sig[2 * p + 1]).mean() - j for p, j in enumerate(pairs)])
    assert abs(error.mean()) < 0.02 and error.std() < 0.06


def test_near_duplicates_against_all_pairs(docs, texts):
    sets = {i: collections.Counter(tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))) for i, t in texts.items() if (w := tokens(t))}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if (m := sum((sets[a] & sets[b]).values())) and m / (sum(sets[a].values()) + sum(sets[b].values()) - m) >= 0.5]
    keep = {r.doc_id: r.keep_id for r in minhash.duplicates(docs).collect()}
    same = sum(keep.get(a, a) == keep.get(b, b) for a, b in pairs)
    assert same >= 0.9 * len(pairs) > 0


def test_components(spark):
    random.seed(6)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(70)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination_against_all_positions(spark, docs, texts):
    bench = {r.item_id: tokens(r.text) for r in core.read(spark, SF, "benchmark").collect()}
    want = {}
    for i, t in texts.items():
        w = tokens(t)
        place = collections.defaultdict(list)
        for j in range(len(w)):
            place[w[j]].append(j)
        for k, q in bench.items():
            least, best = min(13, len(q)), None
            for s in range(len(q) - least + 1):
                for j in place.get(q[s], ()):
                    n = 0
                    while s + n < len(q) and j + n < len(w) and q[s + n] == w[j + n]:
                        n += 1
                    if n >= least and (best is None or (-n, j, s) < best):
                        best = (-n, j, s)
            if best:
                want[i, k] = best
    got = {(r.doc_id, r.item_id): (-r.match_words, r.doc_word, r.item_word) for r in decontaminate.contaminated(docs, core.read(spark, SF, "benchmark")).collect()}
    assert got == want and want


def test_items_of_mixed_lengths(monkeypatch):
    rng = random.Random(5)
    for _ in range(60):
        words, least = rng.choice([3, 8, 40]), rng.choice([1, 2, 3, 5, 6, 8, 13])
        docs = [[f"w{rng.randrange(words)}" for _ in range(rng.randrange(30))] for _ in range(5)]
        items = [[f"w{rng.randrange(words)}" for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 9, 20]))] for _ in range(6)]
        h, _, _, row = core.words(*core.text_bytes(pa.array(map(" ".join, items))))
        first, end = np.searchsorted(row, np.arange(len(items))), np.searchsorted(row, np.arange(len(items)), "right")
        monkeypatch.setattr(decontaminate, "load", lambda _: (pa.array(range(len(items))), h, first, end))
        got = {x[:2]: x[2:] for _, *found in decontaminate.matches(pa.array(map(" ".join, docs)), ["one"], int((end - first).max()), least) for x in zip(*(a.tolist() for a in found))}
        want = {}
        for (i, d), (j, t) in itertools.product(enumerate(docs), enumerate(items)):
            best = None
            for x, y in itertools.product(range(len(d)), range(len(t))):
                n = next((k for k, (a, b) in enumerate(zip(d[x:], t[y:])) if a != b), min(len(d) - x, len(t) - y))
                if n >= min(least, len(t)) and (best is None or (-n, x, y) < best):
                    best = (-n, x, y)
            if best:
                want[i, j] = (-best[0], *best[1:])
        assert got == want


def test_suffix_array_is_sorted():
    random.seed(7)
    h = np.array(random.choices(range(5), k=400), np.uint64)
    row = np.repeat(np.arange(8), 50)
    shard = decontaminate.Shard(h, row, 8, 64)
    rest = [tuple(shard.words[p : p + 64]) for p in shard.array]
    assert rest == sorted(rest) and len(rest) == 400


@pytest.mark.parametrize("range_size", [suffixes.RANGE, 20])
def test_passages_against_all_windows(docs, texts, range_size):
    own = collections.defaultdict(set)
    words = {i: tokens(t) for i, t in texts.items()}
    for i, w in words.items():
        for s in range(len(w) - 49):
            own[tuple(w[s : s + 50])].add(i)
    want = set()
    for i, w in words.items():
        run = None
        for s in range(len(w) - 49):
            o = own[tuple(w[s : s + 50])]
            if len(o) > 1 and run and s == run[1] - 49 and min(o) == run[2]:
                run = (run[0], s + 50, run[2])
            else:
                want |= {(i, *run)} if run else set()
                run = (s, s + 50, min(o)) if len(o) > 1 else None
        want |= {(i, *run)} if run else set()
    assert {tuple(r) for r in suffixes.repeated(docs, range_size=range_size).collect()} == want and want


@pytest.mark.parametrize("range_size", [suffixes.RANGE, 40])
def test_passages_that_many_documents_share(spark, range_size):
    """A passage inside texts of their own, its tail with others before it, and exact copies: the hot keys lie in several ranges."""
    random.seed(11)
    passage = [f"p{i}" for i in range(120)]
    rest = lambda n: [f"w{random.randrange(10**9)}" for _ in range(n)]
    made = [rest(30 + i % 60) + passage + rest(70) for i in range(150)] + [rest(80) + passage[30:] + rest(40) for _ in range(60)] + [passage[:90] + rest(60)] * 40
    got = {tuple(r) for r in suffixes.repeated(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(made)], "doc_id long, text string"), range_size=range_size).collect()}
    want = {(i, 30 + i % 60, 150 + i % 60, 0) for i in range(150)} | {(150 + i, 80, 170, 0) for i in range(60)}
    for i in range(210, 250):
        want |= {(i, 0, 90, 0), (i, 41, 150, 210)}
    assert got == want


def good_turing(counts, cutoff=5):
    """The discounted count of each gram, from the definition."""
    n = collections.Counter(counts.values())
    share = (cutoff + 1) * n[cutoff + 1] / n[1] if n[1] else 1.0
    absolute = min(0.9, n[1] / (n[1] + 2 * n[2])) if n[1] else 0.5

    def kept(r):
        if r > cutoff:
            return float(r)
        factor = ((r + 1) * n[r + 1] / n[r] / r - share) / (1 - share) if share < 1 and n[r] else 0.0
        return r * factor if 0 < factor < 1 else r - absolute

    return {g: kept(r) for g, r in counts.items()}


def katz_by_hand(sequences, size):
    """P(w | context) as a function of a context of up to two tokens; all dictionaries, one gram at a time."""
    counts = [collections.Counter(), collections.Counter(), collections.Counter()]
    for seq in sequences:
        for i in range(2, len(seq)):
            for k in range(3):
                counts[k][tuple(seq[i - k : i + 1])] += 1
    total = sum(counts[0].values())
    one = {g: c / total for g, c in good_turing(counts[0]).items()}
    left = (1 - sum(one.values())) / (size - len(one))
    levels = [lambda context, w: one.get((w,), left)]
    for k in (1, 2):
        below, kept, by = levels[-1], good_turing(counts[k]), collections.defaultdict(list)
        for g in counts[k]:
            by[g[:-1]].append(g[-1])
        weight, scale = {}, {}
        for c, ws in by.items():
            n, d = sum(counts[k][(*c, w)] for w in ws), sum(kept[(*c, w)] for w in ws)
            n += n - d < 1e-9 * n
            scale[c] = 1 / n
            weight[c] = (1 - d / n) / (1 - sum(below(c[1:], w) for w in ws))
        levels.append(lambda c, w, kept=kept, weight=weight, scale=scale, below=below: kept[(*c, w)] * scale[c] if (*c, w) in kept else weight.get(c, 1.0) * below(c[1:], w))
    return levels[2]


@pytest.mark.parametrize("partitions", [3, 64])
def test_katz(spark, docs, texts, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        model = katz.train(docs.where("doc_id % 2 = 0"))
        got = {r.doc_id: (r.tokens, r.logprob) for r in katz.scored(docs, model).collect()}
        grams = {r.code: r.value for r in model.grams.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    coder = bpe.load()
    seqs = {i: [coder.end] * 2 + coder.encoding.encode_ordinary(t) + [coder.end] for i, t in texts.items()}
    p = katz_by_hand([s for i, s in seqs.items() if i % 2 == 0], coder.end + 1)
    assert set(got) == set(seqs)
    for i, s in seqs.items():
        want = sum(math.log(p((s[k - 2], s[k - 1]), s[k])) for k in range(2, len(s)))
        assert got[i][0] == len(s) - 2 and got[i][1] == pytest.approx(want, rel=1e-9)
    # All of the vocabulary after a context has the probability 1, in the model and by hand, seen or not.
    keys = np.array(sorted(grams))
    values = np.array([grams[k] for k in keys.tolist()])
    random.seed(12)
    with np.errstate(divide="ignore"):
        logs = np.log(model.unigram), np.log(model.backoff)
    for u, v in random.sample([(s[k], s[k + 1]) for s in seqs.values() for k in range(len(s) - 2)], 60) + [(coder.end, coder.end), (5, 7)]:
        code = np.arange(coder.end + 1) | v << 17 | u << 34
        assert np.exp(katz.recursion(code, keys, values, *logs)).sum() == pytest.approx(1, abs=1e-9)
    assert model.unigram.sum() == pytest.approx(1, abs=1e-12)


def test_tokens_are_the_tokenizers(texts):
    coder = bpe.load()
    cases = [*texts.values(), "a  b  c \n d  e é è", "", " x", " ", "x ", "don't 're  ''  　 z 12 3", " \n é a", "\xa0 y\xa0 z", "<|endoftext|> x"]
    for lo, _, data, offs in core.chunks(pa.array(cases), 1 << 16):
        ids, at = coder.encode(data, offs)
        for i in range(len(offs) - 1):
            assert ids[at[i] : at[i + 1]].tolist() == coder.encoding.encode_ordinary(cases[lo + i])
        assert coder.counts(data, offs).tolist() == np.diff(at).tolist()


def test_permutation():
    for n in (1, 2, 3, 5, 17, 1000, 4097):
        assert sorted(training_order.permute(np.arange(n), n).tolist()) == list(range(n))
    assert not np.array_equal(training_order.permute(np.arange(1000), 1000), training_order.permute(np.arange(1000), 1000, 5))


def test_shards_round_trip(spark, docs):
    docs = core.written(docs.repartition(3, "doc_id"))
    folder = core.shared_dir(spark)
    manifest = training_order.materialise(docs, folder, length=256, shard=64)
    coder, want = bpe.load(), []
    for part in docs.rdd.glom().collect():
        stream = [t for r in part if (ids := coder.encoding.encode_ordinary(r.text or "")) for t in [*ids, coder.end]]
        want += stream + [coder.end] * (-len(stream) % 256)
    read = {s: x for m in manifest.collect() for s, x in training_order.read_from(folder, m.shard, m.first_slot, 256, 64)}
    order = training_order.permute(np.arange(len(read)), len(read))
    assert np.array_equal(np.concatenate([read[s] for s in order.tolist()]), want)
    later = training_order.read_shards(spark, folder, manifest, 100, 256, 64).toPandas()
    assert sorted(later.slot) == list(range(100, len(read))) and all(zlib.crc32(read[s].tobytes()) == c for s, c in zip(later.slot, later.crc))


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_damaged_members(monkeypatch, size):
    monkeypatch.setattr(warc, "READ", size)
    made = [warc.record("response", f"http://x/{i}", f"urn:page:{i}", (b"ab%d" % i) * i * 1000) for i in range(5)]
    bad = bytearray(made[2])
    bad[len(bad) // 2] ^= 0xFF
    found = list(warc.members(io.BytesIO(b"".join([made[0], made[1], bytes(bad), made[3], made[4]]))))
    assert [x[0] for x in found] == [sum(map(len, made[:i])) for i in range(5)] and [x[2] is None for x in found] == [True, True, False, True, True]
    assert [x[2] for x in warc.members(io.BytesIO(made[0] + made[1][:-5]))] == [None, "cut short"]
    assert list(warc.members(io.BytesIO(b""))) == []


def test_record_errors():
    good = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Payload-Digest: " + warc.digest(b"abc").encode() + b"\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert warc.parse(good)["digest_ok"] and "error" not in warc.parse(good)
    assert warc.parse(good.replace(b"abc", b"abd"))["error"] == "another digest"
    assert warc.parse(good.replace(b"th: 3", b"th: 9"))["error"] == "shorter than its content length"
    assert warc.parse(good.replace(b"th: 3", b"th: 2"))["error"] == "no end after the content length"
    assert warc.parse(good.replace(b"Content-Length: 3\r\n", b""))["error"] == "no content length"
    assert warc.parse(b"nothing")["error"] == "no record header"


def test_streams_round_trip():
    random.seed(8)
    for trial in range(150):
        units = []
        for _ in range(random.randint(0, 6)):
            pts = random.choice([None, random.randrange(1 << 33)])
            dts = random.randrange(1 << 33) if pts is not None and random.random() < 0.5 else None
            size = random.choice([0, 1, 5, *range(160, 190), 400, 70_000 if trial < 3 else 3])
            units.append((random.randint(0, 2), pts, dts, random.random() < 0.5, random.randbytes(size)))
        data = transport.mux(units)
        got = transport.demux(b"junk\x47xx" * (trial % 2) + data)
        wrap = lambda t: None if t is None else t % (1 << 33)
        assert [(r[1], wrap(r[5]), wrap(r[6]), *r[8:10], r[11]) for r in got] == [(0x100 + t, p, p if q is None else q, k, False, x) for t, p, q, k, x in units]


def test_lost_and_doubled_packets():
    data = transport.mux([(0, i * 90_000, None, True, bytes([i]) * 1000) for i in range(5)])
    parts = [data[i : i + 188] for i in range(0, len(data), 188)]
    lost = transport.demux(b"".join(parts[:10] + parts[11:]))
    assert [r[9] for r in lost] == [False, True, False, False, False]
    doubled = transport.demux(b"".join(parts[:10] + [parts[9]] + parts[10:]))
    assert [(r[9], r[10]) for r in doubled] == [(False, 1000)] * 5
    assert transport.crc32(b"123456789") == 0x0376E6E7


def test_bins_are_the_fullest():
    random.seed(9)
    for _ in range(200):
        capacity = random.randint(5, 40)
        lengths = [random.randint(1, capacity) for _ in range(random.randint(1, 9))]
        bin_of, _ = packing.bins(np.array(lengths), capacity)
        left = list(range(len(lengths)))
        for b in range(bin_of.max() + 1):
            mine = [i for i in left if bin_of[i] == b]
            longest = max(lengths[i] for i in left)
            rest = [lengths[i] for i in left]
            rest.remove(longest)
            best = max(longest + sum(c) for n in range(len(rest) + 1) for c in itertools.combinations(rest, n) if longest + sum(c) <= capacity)
            assert sum(lengths[i] for i in mine) == best and max(lengths[i] for i in mine) == longest
            left = [i for i in left if i not in mine]
        assert not left


def test_pipeline(spark, docs, texts):
    import corpus_pipeline

    labels, bench = core.read(spark, SF, "labels"), core.read(spark, SF, "benchmark")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = core.written(stage(spark, now, SF))
        assert new.columns == docs.columns
        before, after = {r.doc_id for r in now.select("doc_id").collect()}, {r.doc_id for r in new.select("doc_id").collect()}
        gone = {
            "toxicity": lambda d: {r.doc_id for r in toxicity.rejected(d, labels).collect()},
            "near_duplicates": lambda d: {r.doc_id for r in minhash.duplicates(d).collect()},
            "decontamination": lambda d: {r.doc_id for r in decontaminate.contaminated(d, bench).collect()},
            "secrets": lambda d: set(),
        }[name](now)
        assert before - after == gone and after <= before
        now = new
    assert secrets.findings(now).count() == 0
    made = corpus_pipeline.STAGES[-1][1](spark, now, SF).toPandas()
    coder = bpe.load()
    want = {r.doc_id: n + 1 for r in now.collect() if (n := len(coder.encoding.encode_ordinary(r.text or "")))}
    assert made.groupby("doc_id").tokens.sum().to_dict() == want
