"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

from strandline.llm import core, decontaminate, katz, minhash, packing, secrets, suffixes, toxicity, training_order, transport, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, key long, bucket int, word string, n long, band long, score double, batch string"
PASSAGE = " ".join(f"passage{i}" for i in range(60))
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))


def rows():
    texts = [None, "", " ", "x", "one two", "é", PASSAGE, PASSAGE, "before " + PASSAGE + " after", LONG, LONG + " more", "you are an idiot, moron. Scum!", "token = \"" + "a" * 40 + "\"", "\n\n...", "same same same same same"]
    out = [(i, t, "en", None, None if t is None else len(t), 1, 2, 3, "w", None, 5, 0.5, "b") for i, t in enumerate(texts)]
    return out + [out[6], out[1], out[0], (None, PASSAGE, None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return core.written(spark.createDataFrame(rows(), SCHEMA))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "two"), (None, "one more item that is nowhere at all")], "item_id long, text string")


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(11, 0, 1), (11, 0, None), (3, None, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert [r.doc_id for r in toxicity.rejected(docs, labels).collect()] == [11]
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert toxicity.keep_clean(none, labels).count() == 0
    assert toxicity.rejected(docs, labels.limit(0)).count() == 1


def test_near_duplicates(docs, none):
    found = {r.doc_id: r.keep_id for r in minhash.duplicates(docs).collect()}
    assert found == {7: 6, 8: 6, 10: 9}
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").select("doc_id").distinct().collect()) == [0, 1, 2, 3, 4, 5, 6, 9, 11, 12, 13, 14]
    assert kept.where("doc_id is null").count() == 1
    assert minhash.duplicates(none).count() == 0


def test_decontamination(docs, none, benchmark):
    found = decontaminate.contaminated(docs, benchmark).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.item_id, r.match_words, r.doc_word, r.item_word) for r in found) == [(-1, 1, 60, 0, 0), (4, 4, 1, 1, 0), (6, 1, 60, 0, 0), (6, 1, 60, 0, 0), (7, 1, 60, 0, 0), (8, 1, 60, 1, 0)]
    kept = decontaminate.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 6
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.keep_clean(docs, benchmark.limit(0)).count() == docs.count()
    assert decontaminate.contaminated(none, benchmark).count() == 0
    # One item a pass gives the same.
    assert decontaminate.contaminated(docs, benchmark, pass_bytes=100).count() == 6


def test_secrets(docs, none):
    assert [(r.doc_id, r.rule, r.nth) for r in secrets.findings(docs).collect()] == [(12, "assigned_token", 1)]
    clean = secrets.redacted(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    row = clean.where("doc_id = 12").first()
    assert row.text == "[secret]" and row.n_chars == 8
    assert secrets.findings(none).count() == 0 and secrets.redacted(none).count() == 0


def test_passages(docs, none):
    found = sorted(tuple(r) for r in suffixes.repeated(docs).collect())
    assert found == [(6, 0, 60, 6), (7, 0, 60, 6), (8, 1, 61, 6), (9, 0, 60_000, 9), (10, 0, 60_000, 9)]
    assert suffixes.repeated(none).count() == 0


def test_packing(docs, none):
    made = packing.packed(docs, capacity=512).toPandas()
    assert set(made.doc_id.dropna().astype(int)) == {2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14}
    assert made.doc_id.isna().any()
    for _, x in made.groupby(["pack", "bin"]):
        x = x.sort_values("start")
        assert x.tokens.sum() <= 512 and list(x.start) == list(x.tokens.cumsum() - x.tokens)
    assert packing.packed(none).count() == 0


def test_katz(docs, none):
    model = katz.train(docs)
    made = katz.scored(docs, model).toPandas()
    assert len(made) == docs.where("length(text) > 0").count() and (made.logprob < 0).all()
    empty = katz.train(none)
    assert empty.grams.count() == 0 and katz.scored(none, empty).count() == 0
    assert abs(katz.scored(docs, empty).toPandas().perplexity - 50257).max() < 1


def test_training_order(docs, none):
    folder = core.shared_dir(docs.sparkSession)
    manifest = training_order.materialise(docs, folder, length=64, shard=16)
    made = training_order.read_shards(docs.sparkSession, folder, manifest, length=64, shard=16).toPandas()
    assert sorted(made.slot) == list(range(len(made))) and len(made) == manifest.agg({"sequences": "sum"}).first()[0]
    assert training_order.materialise(none, core.shared_dir(docs.sparkSession)).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", "<p>é</p>", 1), (2, None, None, None), (None, "u", "", 1), (1, "http://a/\r\nX: y", "<p>é</p>", 1), (3, "v", LONG, 1)], "page_id long, url string, html string, length int")
    made = warc.read_records(warc.write_pages(pages, core.shared_dir(spark))).collect()
    assert sorted(r.length for r in made) == sorted([9, 0, 0, 9, len(LONG)]) and all(r.digest_ok and r.error is None for r in made)
    assert {r.uri for r in made} == {"http://a/%0D%0AX: y", None, "u", "v"}
    assert warc.read_records(warc.write_pages(pages.limit(0), core.shared_dir(spark))).count() == 0
    assert warc.read_records(spark.createDataFrame([(None,)], "path string")).count() == 0


def test_transport(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, None, None), (None, 0, "user", "x"), (2, None, "user", "x"), (3, 0, "a", LONG)], "conv_id long, turn long, role string, text string")
    made = transport.packets_of(transport.conversation_streams(turns), "conv_id", "media").collect()
    assert sorted((r.conv_id, r.pts, r.n_bytes, r.broken) for r in made) == [(1, 0, 2, False), (1, 0, 2, False), (1, 90_000, 0, False), (3, 0, len(LONG), False)]
    media = spark.createDataFrame([("a", None, 1), ("b", b"", 2), ("c", b"\x47" * 500, 3), ("d", b"no stream", 4)], "name string, media binary, pid int")
    assert transport.packets_of(media, "name", "media").count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("at", range(5))
def test_stages(spark, docs, none, at):
    """Each stage of the pipeline on nulls, empty and very long texts, repeated rows and clashing names, and on no rows."""
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[at]
    # The fixture's ids are those of no labelled document of the table.
    odd = docs.withColumn("doc_id", F.col("doc_id") + 10**9)
    made = stage(spark, odd, SF)
    got = sorted(r.doc_id - 10**9 for r in made.select("doc_id").distinct().collect() if r.doc_id is not None)
    if name == "packing":
        assert got == list(range(2, 15)) and made.groupBy("pack", "bin").agg(F.sum("tokens").alias("n")).where("n > 2048").count() == 0
    else:
        assert made.columns == docs.columns
        assert got == {"toxicity": [x for x in range(15) if x != 11], "near_duplicates": [x for x in range(15) if x not in (7, 8, 10)]}.get(name, list(range(15)))
        assert made.where("doc_id is null").count() == 1
    assert stage(spark, none, SF).count() == 0
