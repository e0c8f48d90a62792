"""Nulls, empty and long texts, repeated rows, empty tables and clashing extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strideframe.llm import bpe, decontaminate, langid, licenses, pii, quality, simhash, substrings, suffix_array, toxicity

LONG = "un mot bien long avec mail a@b.co et encore " * 6000
ROWS = [
    (1, "All rights reserved. write to me@site.org or +1 (234) 567-8901, the end of this text is near", "en"),
    (1, "All rights reserved. write to me@site.org or +1 (234) 567-8901, the end of this text is near", "en"),
    (2, None, "en"),
    (None, "", None),
    (None, None, None),
    (3, LONG, "fr"),
    (4, " \t\n\x0b\x0c\r ", "de"),
    (5, "ß" * 30_000, "de"),
    (6, "12345 67890 ... 😀😀", None),
    (7, "the cat sat on the mat and the dog sat on the log while the sun went down over the hill again", "en"),
]
CLASH = ["h", "bucket", "row__", "key", "text_key", "spans", "doc", "shard", "n_words", "score", "fp", "places", "held_out", "w", "t"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return df.select("*", *[F.lit(7).alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 1), (None, None, None), (7, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat and the dog sat on the log"), (2, None), (3, ""), (4, "reserved write"), (None, "zzz")], "item_id long, text string")


def codec():
    P = pytest.importorskip("public_tokenizers")
    return bpe.read_vocabulary(P.path("byte_bpe_50k.json")), P.PATTERN


def operators(labels, benchmark):
    return {
        "bpe": lambda d: bpe.round_trip(d, *codec()),
        "bpe_ids": lambda d: bpe.encode_documents(d, *codec(), offsets=True),
        "licenses": licenses.scan_licenses,
        "pii": pii.report,
        "suffix_array": suffix_array.dedup_bytes,
        "suffix_spans": suffix_array.removed_bytes,
        "quality": lambda d: quality.judge(d, labels),
        "simhash": simhash.near_duplicates,
        "decontaminate": lambda d: decontaminate.summarise(decontaminate.find_matches(d, benchmark)),
        "substrings": substrings.dedup_words,
        "kept_texts": substrings.kept_texts,
        "language": lambda d: langid.identify(d, langid.train(d)),
        "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.learn(d, labels)),
    }


NAMES = sorted(operators(None, None))


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(docs, labels, benchmark, name):
    assert operators(labels, benchmark)[name](docs).count() == len(ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(docs, labels, benchmark, name):
    run = operators(labels.limit(0), benchmark.limit(0))[name]
    assert run(docs.limit(0)).collect() == []
    assert run(docs).count() == len(ROWS)


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, docs, benchmark, tmp_path, k):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, str(tmp_path))
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    if k < 4:
        assert out.columns == docs.columns
        assert {r["bucket"] for r in out.collect()} <= {7}
    assert 0 < out.count() <= len(ROWS)


def test_null_means(docs, labels, benchmark):
    run = operators(labels, benchmark)
    null = lambda name: [r for r in run[name](docs).collect() if r["doc_id"] == 2][0]
    assert null("language")["lang_pred"] == "und"
    assert null("licenses")["n_words"] == 0 and null("licenses")["labels"] == ""
    assert null("suffix_array")["n_bytes"] == 0
    assert null("simhash")["fingerprint"] == "0" * 16
    assert not null("decontaminate")["contaminated"]
    assert null("quality")["base_failed"] and not null("quality")["kept"]
    assert null("bpe")["n_tokens"] == 0
