"""Every text operator against a brute-force version, an exact round trip, or held-out accuracy."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from strideframe.llm import bpe, decontaminate, induced, langid, licenses, pii, quality, queries, simhash, substrings, suffix_array, toxicity
from strideframe.llm.components import components
from strideframe.llm.repeats import covered, segments, sliding_min
from tests.compare import SF

BLANK, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def corpus(seed=0, n=60):
    """Invented documents with copies, shared passages, repeats within a text, nulls and odd characters."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    shared = [" ".join(rng.choice(words) for _ in range(rng.randint(15, 60))) for _ in range(4)]
    texts: list = []
    for i in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(0, 120)))
        if i % 3 == 0:
            t = f"{t} {rng.choice(shared)}\n{t[:80]}"
        if i % 7 == 0 and texts:
            t = rng.choice(texts) or ""
        if i % 11 == 0 and texts:
            t = f"{rng.choice(texts) or ''} {rng.choice(words)}"
        texts.append(t)
    texts[5], texts[9], texts[10] = None, "", "日本語 😀 " * 30
    return list(zip(rng.sample(range(1000), n), texts))


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def whole(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


# byte-level BPE


def test_bpe_matches_the_rank_library(whole, rows, spark):
    P, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = [(10_000 + i, t) for i, t in enumerate(["<|endoftext|> it's I'll  x\n\n  y", "a" * 5000, "\t\t 12 345é😀", "   x"])]
    df = spark.createDataFrame(rows + more, "doc_id long, text string").unionByName(whole.select("doc_id", "text").where("doc_id < 200").withColumn("doc_id", F.col("doc_id") + 50_000))
    vocabulary = bpe.read_vocabulary(P.path("byte_bpe_50k.json"))
    got = by_id(bpe.round_trip(df, vocabulary, P.PATTERN), "n_tokens", "ids_sha256", "decoded_sha256")
    for doc_id, text in by_id(df, "text").items():
        t = text[0] or ""
        ids = own.encode_ordinary(t)
        assert got[doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    back = bpe.decode_documents(bpe.encode_documents(df, vocabulary, P.PATTERN), vocabulary, P.PATTERN)
    assert by_id(back, "text") == {k: (v[0] or "",) for k, v in by_id(df, "text").items()}
    codec = bpe.Codec(vocabulary, P.PATTERN)
    text = "naïve 😀 text"
    ids = codec.encode(text)
    spans = codec.offsets(text, ids)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(codec.token_bytes[i] in text[a:b].encode() for i, (a, b) in zip(ids, spans))


# licenses


def test_license_base(rows):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    more = ["CC BY, cc-by 4.0", "GNU General Public License, all RIGHTS reserved all rights reserved.", "cc by by cc by", "account by", "x" * 10]
    for text in [*more, *(t for _, t in rows)]:
        w = ALNUM.findall(lower(text or ""))
        hits = sorted((i, v) for k, v in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(k)]) == k)
        got = licenses.scan(text)
        assert (got["n_words"], got["n_base"]) == (len(w), len(hits))
        assert (got["first_word"], got["last_word"]) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert got["base_labels"] == ",".join(sorted({v for _, v in hits})) and set(filter(None, got["base_labels"].split(","))) <= set(got["labels"].split(","))
        assert 0 <= got["score"] <= 1


@pytest.mark.parametrize(
    ("text", "postfix", "free"),
    [
        ("MIT OR GPL-3.0-only", ["mit", "gpl-3.0-only", "or"], True),
        ("MIT AND GPL-2.0", ["mit", "gpl-2.0", "and"], False),
        ("GPL-2.0 WITH Classpath-exception-2.0 OR MIT AND BSD-3-Clause", ["gpl-2.0", "classpath-exception-2.0", "with", "mit", "bsd-3-clause", "and", "or"], True),
        ("(MIT OR Apache-2.0) AND (GPL-2.0 OR LGPL-2.1)", ["mit", "apache-2.0", "or", "gpl-2.0", "lgpl-2.1", "or", "and"], False),
        ("MIT OR", None, None), ("(MIT", None, None), ("OR MIT", None, None), ("", None, None),
    ],
)
def test_license_expressions(text, postfix, free):
    assert licenses.to_postfix(text)[0] == postfix
    if postfix:
        assert licenses.evaluate(postfix) is free
        got = licenses.scan(f"# SPDX-License-Identifier: {text}\ncode")
        assert got["permissive"] is free and set(got["labels"].split(",")) >= {t for t in postfix if t in licenses.IDENTIFIERS}


def test_license_identifiers():
    scan = licenses.scan
    for name in ("cc-by-nc-4.0", "cc-by-nc-nd-4.0", "gpl-2.0-only"):
        assert scan(f"SPDX-License-Identifier: {name.upper()}")["permissive"] is False
    assert scan("x mitre-special y SPDX-License-Identifier: mitre-special")["permissive"] is None
    prose = scan("SPDX-License-Identifier: see the file for details")
    assert (prose["labels"], prose["score"], prose["permissive"]) == ("", 0, None)
    assert scan("SPDX-License-Identifier: (MIT or please read everything")["labels"] == "mit"
    assert scan("é SPDX-License-Identifier: MIT */")["permissive"] is True
    found = scan("Under Apache-2.0, or LGPL-3.0-or-later; CC-BY-NC-4.0 for texts. Das ist mit der Hand gemacht.")
    assert found["labels"] == "apache-2.0,cc-by,cc-by-nc-4.0,lgpl-3.0-or-later" and found["n_base"] == 1
    assert scan("the mit license, without warranties or conditions of any kind")["labels"] == "apache,mit"


# personal data

PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def pii_valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def pii_brute(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PII) for m in re.finditer(p, text) if pii_valid(kind, m[0]))


def test_pii_base(spark, whole):
    rng = random.Random(3)
    odd = ["".join(rng.choice("ab@..--_+ 0123456789()") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    odd += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111 x +1 (234) 567-8901", "😀 é@é a@b.co 001.2.3.256", "m@x.org " * 800, "1" * 3000]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").unionByName(whole.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    found = by_id(pii.find_personal(df)[0], "base")
    for doc_id, (text,) in by_id(df, "text").items():
        assert [(x["start"], x["kind"], x["end"]) for x in found[doc_id][0]] == pii_brute(text), text[:80]


def test_pii_disclosing_terms(spark):
    """A name that stands next to one address in many contexts gives it away; a word that stands everywhere does not."""
    rng = random.Random(1)
    filler = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    texts = [f"{' '.join(rng.sample(filler, 5))} with Zebulon mail zeb@example.org {' '.join(rng.sample(filler, 5))}" for _ in range(6)]
    texts += [f"{' '.join(rng.sample(filler, 9))} with mail {' '.join(rng.sample(filler, 4))}" for _ in range(300)]
    texts += ["Quentin wrote once@example.org again"] * 50  # one text, however often copied
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, terms, _ = pii.find_personal(df)
    found = by_id(rows.join(terms, "text_key"), "terms")
    assert sorted(found) == list(range(6))
    for i in range(6):
        assert {texts[i][t["start"] : t["end"]] for t in found[i][0]} == {"Zebulon"}
    clean = by_id(pii.sanitise(df), "text")
    assert "with [NAME] mail [EMAIL] " in clean[0][0] and clean[100][0] == texts[100] and clean[310][0] == "Quentin wrote [EMAIL] again"


def letters(seed, filler_words=120):
    """Letters with a name of three letters at the head and an address at the foot, far apart, among other texts."""
    rng = random.Random(seed)
    filler = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    texts = [f"Ann {' '.join(rng.sample(filler, filler_words))} and Ann again {' '.join(rng.sample(filler, filler_words))} mail ann@example.org" for _ in range(3)]
    return texts + [f"{' '.join(rng.sample(filler, filler_words))} and again mail" for _ in range(300)]


def test_pipeline_marks_terms_of_whole_texts(spark):
    texts = letters(7)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = by_id(pii.sanitise(df), "text")
    for i, t in enumerate(texts):
        assert clean[i][0] == t.replace("ann@example.org", "[EMAIL]").replace("Ann", "[NAME]")


def test_pipeline_copies_conceal_no_term(spark):
    rng = random.Random(8)
    filler = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    texts = [f"{' '.join(rng.sample(filler, 5))} with Zebulon mail zeb@example.org {' '.join(rng.sample(filler, 5))}" for _ in range(3)]
    texts += [f"{' '.join(rng.sample(filler, 9))} with mail" for _ in range(300)]
    texts += [texts[0]] * 40 + [texts[9]] * 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = by_id(pii.sanitise(df), "text")
    assert all(("with [NAME] mail [EMAIL]" in clean[i][0]) == ("Zebulon" in t) for i, t in enumerate(texts))


def test_pii_a_term_within_a_long_address_is_no_term(spark):
    """However many other spans an address holds, what is inside it is not looked at."""
    inside = ".".join(["10.0.0.1"] * 30)
    texts = [f"zebulon.{inside}.zebulon{i}x@example.org and +1 234 567 8901 from zebulon number {i}" for i in range(4)] + [f"nothing of note in text {i}" for i in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, terms, _ = pii.find_personal(df)
    at = by_id(rows.join(terms, "text_key"), "base", "terms")
    for i in range(4):
        base, found = at[i]
        assert len(base) > 30 and found and all(t["start"] >= b["end"] or t["end"] <= b["start"] for t in found for b in base)


def test_nothing_personal_is_left(spark, tmp_path):
    """The shared folder holds no value in clear while results are read, and nothing once the driver has ended."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", "{tmp_path}").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from strideframe.llm import pii
df = spark.createDataFrame([(i, f"mail zebulon{{i % 2}}@example.org now Zebulon {{i}}") for i in range(8)], "doc_id long, text string")
assert pii.sanitise(df).where("text LIKE '%EMAIL%'").count() == 8
from pathlib import Path
held = b"".join(p.read_bytes() for p in Path("{tmp_path}").rglob("*") if p.is_file())
assert held and b"zebulon" not in held.lower()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[2], timeout=300)
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


# substrings


def bytes_brute(rows, k=50):
    seen, out = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - k + 1):
            seen[b[j : j + k]] = min(seen.get(b[j : j + k], i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - k + 1):
            if seen[b[j : j + k]] < i:
                gone[j : j + k] = True
        out[i] = (len(b), int(gone.sum()), len(re.findall(b"1+", (gone + 48).astype(np.uint8).tobytes())), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def words_brute(rows, k=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = BLANK.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if tuple(w[j : j + k]) in seen:
                gone[j : j + k] = [True] * k
            seen.add(tuple(w[j : j + k]))
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


def test_suffix_array_dedup(docs, rows):
    assert by_id(suffix_array.dedup_bytes(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == bytes_brute(rows)


def test_suffix_tree_dedup(docs, rows):
    assert by_id(substrings.dedup_words(docs), "n_words", "n_removed", "kept_sha256") == words_brute(rows)
    texts = by_id(substrings.kept_texts(docs), "text")
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, (t,) in texts.items()} == {i: v[2] for i, v in words_brute(rows).items()}


def test_many_buckets(docs, rows, monkeypatch):
    """The same result when every few texts are a bucket of their own."""
    from strideframe.llm import repeats

    for name, size in (("BUCKET_BYTES", 2000), ("SHARD_BYTES", 1000), ("ANCHOR_BYTES", 4000), ("STEP", 700)):
        monkeypatch.setattr(repeats, name, size)
    assert by_id(suffix_array.dedup_bytes(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == bytes_brute(rows)
    assert by_id(substrings.dedup_words(docs), "n_words", "n_removed", "kept_sha256") == words_brute(rows)


def test_long_texts_are_cut(spark, monkeypatch):
    """A text longer than a step goes through in steps that overlap, with the same result."""
    from strideframe.llm import repeats

    monkeypatch.setattr(repeats, "STEP", 64)
    many = corpus(3, 30)
    many.append((5000, " ".join(t or "" for _, t in many)))
    df = spark.createDataFrame(many, "doc_id long, text string")
    assert by_id(suffix_array.dedup_bytes(df), "n_bytes", "n_removed", "n_spans", "kept_sha256") == bytes_brute(many)
    assert by_id(substrings.dedup_words(df), "n_words", "n_removed", "kept_sha256") == words_brute(many)


def test_hot_passage_travels_once_a_bucket(spark, monkeypatch):
    """A passage that all documents hold: same result, and a shard's answer does not grow with the documents of a bucket."""
    passage = "the quick brown fox jumps over the lazy dog and runs away from all of it at once, never to be seen again " * 2
    many = [(i, f"{i} {passage} {i * 7}") for i in range(400)]
    df = spark.createDataFrame(many, "doc_id long, text string")
    assert by_id(suffix_array.dedup_bytes(df), "n_bytes", "n_removed", "n_spans", "kept_sha256") == bytes_brute(many)
    assert by_id(substrings.dedup_words(df), "n_words", "n_removed", "kept_sha256") == words_brute(many)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=30).map(str.encode), min_size=1, max_size=8), st.sampled_from([64, 1 << 20]), st.sampled_from([3, 20]))
def test_induced_sorting(parts, memory, k):
    """Order and common prefixes, with queues that go to disk at once or never."""
    data, lengths = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts])
    text = [s for i, p in enumerate(parts) for s in [*(b + 1 for b in p), -i]]
    want = sorted((i for i, s in enumerate(text) if s > 0), key=lambda i: text[i:])
    rows, prefix = (np.concatenate(x)[::-1].tolist() for x in zip(*induced.byte_suffixes(data, lengths, k, memory)))
    assert rows == want
    for a, b, n in zip(want, want[1:], prefix):
        assert n == next((j for j in range(k) if text[a + j] != text[b + j]), k)


def test_induced_sorting_beyond_memory():
    """A shard many times the limit: what is held at once stays far below its arrays, and several recursions are needed."""
    import tracemalloc

    rng = np.random.default_rng(3)
    words = [rng.integers(97, 105, rng.integers(2, 7)).astype(np.uint8).tobytes() + b" " for _ in range(40)]
    parts = [b"".join(words[i] for i in rng.integers(0, 40, 60)) for _ in range(1200)]
    parts += parts[:300]
    data, lengths = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts])
    limit = 1 << 15
    rows = list(induced.byte_suffixes(data, lengths, 50, 1 << 26))
    tracemalloc.start()
    got, seen = 0, []
    for (r, p) in induced.byte_suffixes(data, lengths, 50, limit):
        got += len(r)
        seen.append((int(r[0]), int(p[0])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == len(data) > 8 * limit
    whole_rows, whole_prefix = (np.concatenate(x) for x in zip(*rows))
    place = {int(r): int(p) for r, p in zip(whole_rows, whole_prefix)}
    assert all(place[r] == p for r, p in seen)
    # in memory the same sort holds some 40 bytes for each byte of text
    assert peak < 20 * len(data)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=3, max_size=20), min_size=1, max_size=6), st.integers(2, 5))
def test_subtree_groups(parts, limit):
    words, lengths = np.array([w for p in parts for w in p], np.uint64), np.array([len(p) for p in parts])
    got = substrings.equal_windows(words, lengths, 3, limit).tolist()
    windows = [tuple(p[i : i + 3]) for p in parts for i in range(len(p) - 2)]
    assert all((a == b) == (x == y) for (a, x), (b, y) in itertools.combinations(zip(windows, got), 2))
    deep = [(d, tuple(sorted(r.tolist()))) for d, r in substrings.maximal_repeats(words, lengths, 3, 8, 1 << 16)]
    assert all(len({tuple(words[i : i + d].tolist()) for i in r}) == 1 and len(r) > 1 for d, r in deep)


def test_anchors_are_content():
    """Equal windows have equal anchors wherever they stand, and every window is in one segment."""
    rng = np.random.default_rng(0)
    spec = suffix_array.SPEC
    passage = rng.integers(97, 101, 200).astype(np.uint8)
    seen = []
    for pad in (0, 13, 77):
        units = np.concatenate([rng.integers(97, 101, pad).astype(np.uint8), passage, rng.integers(97, 101, 60).astype(np.uint8)])
        begin, end, anchor, _ = segments(units, np.array([len(units)]), spec)
        of = {w: a for b, e, a in zip(begin.tolist(), end.tolist(), anchor.tolist()) for w in range(b, e - spec.k + 1)}
        assert sorted(of) == list(range(len(units) - spec.k + 1))
        seen.append([of[pad + w] for w in range(len(passage) - spec.k + 1)])
    assert seen[0] == seen[1] == seen[2]
    x = rng.integers(0, 100, 50)
    assert sliding_min(x, 7).tolist() == [x[i : i + 7].min() for i in range(44)]
    gone, n = covered(np.array([[2, 5], [4, 6], [8, 9]]), 10)
    assert gone.tolist() == [i in (2, 3, 4, 5, 8) for i in range(10)] and n == 2


# quality


def quality_brute(t):
    w = BLANK.findall(t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if BLANK.search(line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = {j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_quality_counts(spark, whole):
    odd = [None, "", " ", "a " * 500, "x\ny\nx\n\n \nx", "#*$%&|<> #", "é b c", "p q r s t u v w " * 3 + "z"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").unionByName(whole.select((F.col("doc_id") + 1000).alias("doc_id"), "text")).withColumn("lang", F.lit("en"))
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("doc_id", F.col("doc_id") + 1000)
    got = by_id(quality.judge(df, labels), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {i: quality_brute(t) for i, (t,) in by_id(df, "text").items()}


def test_quality_cutoffs(spark):
    """A cutoff that bad rows alone exceed is taken where labels suffice; one that many good rows exceed is not."""
    rules = list(quality.RULES)
    rows = [(i, "en" if i < 4000 else "xx", 0.5 if i % 4 == 0 else 0.0, 30.0 if i % 10 == 1 else 5.5) for i in range(4050)]
    signals = spark.createDataFrame(rows, "doc_id long, stratum string, symbol_share double, long_words double").select("*", F.col("doc_id").alias("text_key"), F.lit(0.0).alias("dup_line_share"), F.lit(0.0).alias("repeat_share"), F.lit(-5.5).alias("short_words"))
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(4050)], "doc_id long, quality int")
    cuts = {r["stratum"]: r for r in quality.cutoffs(signals, labels).collect()}
    assert set(cuts) == {"en"} and cuts["en"]["cut_symbol_share"] is not None
    assert all(cuts["en"][f"cut_{r}"] is None for r in rules if r != "symbol_share")
    # copies are no independent votes: 40 distinct texts bound nothing, however often each is labelled
    assert quality.cutoffs(signals.withColumn("text_key", F.pmod("doc_id", F.lit(40))), labels).count() == 0


def test_binomial_tail(spark):
    cases = [(0, 100, 0.05), (3, 100, 0.05), (20, 5000, 0.01), (0, 1, 0.5), (30, 900, 0.05)]
    df = spark.createDataFrame(cases, "k long, n long, p double")
    for r in [x for p in (0.05, 0.01, 0.5) for x in df.where(F.col("p") == p).select("*", quality.log_binomial_cdf(F.col("k"), F.col("n"), p).alias("l")).collect()]:
        want = math.fsum(math.comb(r["n"], i) * r["p"] ** i * (1 - r["p"]) ** (r["n"] - i) for i in range(r["k"] + 1))
        assert math.exp(r["l"]) == pytest.approx(want, rel=1e-9)


# near duplicates


def fingerprint_brute(text):
    w = BLANK.findall(lower(text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_brute(prints):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(prints), 2):
        if ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 2:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in prints}


def test_simhash(docs, rows):
    got = by_id(simhash.near_duplicates(docs), "fingerprint", "component_id")
    prints = {i: fingerprint_brute(t) for i, t in rows}
    assert {i: f for i, (f, _) in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: c for i, (_, c) in got.items()} == classes_brute(prints)


@pytest.mark.parametrize("leaf", [16, 4096])
def test_tree_finds_all_links(spark, leaf):
    """Fingerprints in chains of one and two bits, through many small shards."""
    rng = random.Random(leaf)
    prints = {0}
    while len(prints) < 900:
        base = rng.choice(sorted(prints)) if rng.random() < 0.6 else rng.getrandbits(64)
        prints.add(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = simhash.link(df, 2, leaf=leaf)
    assert all(r["a"] != r["b"] for r in links.collect())
    root = {r["node"]: r["root"] for r in components(links).collect()}
    want = classes_brute({i: p for i, p in enumerate(sorted(signed))})
    order = sorted(signed)
    assert all((root.get(order[a], order[a]) == root.get(order[b], order[b])) == (want[a] == want[b]) for a, b in itertools.combinations(range(len(order)), 2))


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}


def test_pipeline_near_duplicates(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    texts, family = [], []
    for f in range(40):
        base = [rng.choice(words) for _ in range(150)]
        for copy in range(1 + f % 4):
            t = list(base)
            if copy:
                t[rng.randrange(150)] = "changed"  # 5 of 146 shingles: similarity 0.93
            texts.append(" ".join(t))
            family.append(f)
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(4)
    kept = [r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()]
    assert sorted(kept) == [family.index(f) for f in range(40)]
    a, b = (simhash.sketches([t], 5)[2][0] for t in texts[-2:])
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts[-2:]]
    assert simhash.similarity(a, b) == pytest.approx(len(sets[0] & sets[1]) / len(sets[0] | sets[1]), abs=0.08)


def near_brute(texts, words=5, least=0.8):
    """The first row of each component of all pairs whose whole shingle sets are similar."""
    sets = [set(simhash.shingle_hashes(t, words).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        x, y = sets[i], sets[j]
        if min(len(x), len(y)) >= 0.7 * max(len(x), len(y)) and (x == y or len(x & y) / len(x | y) >= least):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return sorted({find(i) for i in range(len(texts))})


@pytest.mark.parametrize("length", [20, 60, 400])
def test_pipeline_near_duplicates_are_all_found(spark, length):
    """Families around the threshold, in chains, all with one long passage in common, against every pair."""
    rng = random.Random(length)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    passage = [rng.choice(words) for _ in range(length // 2)]
    texts = ["", "", "one two"]
    for f in range(60):
        t = [rng.choice(words) for _ in range(length // 2)] + passage
        for _ in range(5):
            texts.append(" ".join(t))
            cut = rng.randint(1, max(3, length // 6))
            t = t[cut:] + [rng.choice(words) for _ in range(cut)]
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    want = near_brute(texts)
    assert 60 < len(want) < len(texts) - 60
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()) == want


def test_pipeline_near_duplicates_of_shared_passages(spark, monkeypatch):
    """Texts that consist of common passages in part or wholly, with no sample to tell which shingles are common, against every pair."""
    monkeypatch.setattr(simhash, "COUNTED", 1)
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    passages = [[rng.choice(words) for _ in range(30)] for _ in range(6)]
    texts = []
    for f in range(60):
        own = [rng.choice(words) for _ in range((0, 5, 12, 40)[f % 4])]
        t = [w for p in rng.sample(passages, 1 + f % 3) for w in p] + own
        for _ in range(3):
            texts.append(" ".join(t))
            at = rng.randrange(len(t))
            t = t[:at] + [rng.choice(words)] + t[at + 1 + rng.randrange(2) :]
    rng.shuffle(texts)
    want = near_brute(texts)
    assert 30 < len(want) < len(texts) - 60
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(df, rounds=1).collect()) == want


def test_pipeline_near_duplicates_of_a_family(spark, monkeypatch):
    """Edited copies of one text, most less than 0.8 like each other: all links are found, and few pairs are looked at."""
    monkeypatch.setattr(simhash, "COUNTED", 1)
    rng = random.Random(17)
    template = [f"t{i}" for i in range(150)]
    texts = []
    for i in range(300):
        words = list(template)
        for at in rng.sample(range(150), rng.randint(2, 5)):
            words[at] = f"e{i}x{at}"
        if i % 10 == 9:  # near an edited copy, less so to the template
            words = texts[-1].split()
            words[rng.randrange(150)] = f"f{i}"
        texts.append(" ".join(words))
    made, real = [], simhash.materialise

    def seen(df):
        out, at = real(df)
        if out.columns == ["a", "b"]:
            made.append(out.count())
        return out, at

    monkeypatch.setattr(simhash, "materialise", seen)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(df).collect())
    assert got == near_brute(texts)
    assert 150 < len(got) < 290, len(got)
    assert max(made) < 20 * len(texts), made


@pytest.mark.parametrize("rounds", [0, 2])
def test_pipeline_near_duplicates_by_differences(spark, monkeypatch, rounds):
    """Families in chains and unlike texts with a passage, nearly all classes told apart by differences to a pivot, in squares."""
    monkeypatch.setattr(simhash, "COUNTED", 1)
    monkeypatch.setattr(simhash, "SMALL", 2)
    monkeypatch.setattr(simhash, "CROWD", 4)
    rng = random.Random(23 + rounds)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    passage = [rng.choice(words) for _ in range(40)]
    texts = ["", "one two"]
    for f in range(12):
        first = passage + [rng.choice(words) for _ in range((0, 10, 40, 110)[f % 4])]
        t = first
        for i in range(16):
            texts.append(" ".join(t))
            t = list(t if i % 3 else first)
            for _ in range(rng.randint(1, max(1, len(t) // 40))):
                at = rng.randrange(len(t))
                t[at : at + 1 + rng.randrange(2)] = [rng.choice(words)]
    rng.shuffle(texts)
    want = near_brute(texts)
    assert 20 < len(want) < len(texts) - 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(df, rounds=rounds).collect()) == want


def test_pipeline_near_duplicates_go_through_fingerprints(spark, monkeypatch):
    """Texts of near fingerprints are compared before any class of common shingles, and their links are kept."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    texts = []
    for _ in range(20):
        t = [rng.choice(words) for _ in range(400)]
        texts += [" ".join(t), " ".join(t[:-1] + ["changed"])]
    calls, real, none = [], simhash.link, simhash.prefix
    monkeypatch.setattr(simhash, "link", lambda nodes, radius: calls.append((nodes.count(), radius)) or real(nodes, radius))
    # without prefixes, what the fingerprints find is all
    monkeypatch.setattr(simhash, "prefix", lambda h, *rest: none(h, *rest)[:0])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()}
    prints = simhash.fingerprints([simhash.shingle_set(t, 5) for t in texts])
    want = {i for i in range(40) if i % 2 == 0 or int(prints[i] ^ prints[i - 1]).bit_count() > simhash.RADIUS}
    assert calls == [(len(set(prints.tolist())), simhash.RADIUS)]
    assert kept == want and len(want) < 40


@pytest.mark.parametrize("size", [0, 1, 5, 63, 700, 20000])
def test_parities_bound_the_difference(size):
    """Parities never differ in more bits than the sets do in shingles, and those of far sets rule them out at every size."""
    rng = np.random.default_rng(size)
    a = np.unique(rng.integers(0, 1 << 63, size, np.int64).astype(np.uint64))
    for keep, more in ((1.0, 0), (0.9, 0.1), (0.5, 0.5), (0.3, 2.0), (0.0, 1.0)):
        b = np.unique(np.concatenate([a[: int(len(a) * keep)], rng.integers(0, 1 << 63, int(len(a) * more), np.int64).astype(np.uint64)]))
        got = int(simhash.parity_distance([simhash.parities(a)], [simhash.parities(b)])[0])
        both = len(np.intersect1d(a, b))
        assert got <= len(a) + len(b) - 2 * both
        if size >= 700 and both < 0.6 * (len(a) + len(b) - both):
            assert got * 1.8 > 0.2 * (len(a) + len(b)) + 1e-6


# decontamination


def contamination_brute(rows, items, n=10):
    windows = {}
    for i, t in items:
        w = ALNUM.findall(lower(t or ""))
        m = min(n, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add(str(i))
    out = {}
    for i, t in rows:
        w = ALNUM.findall(lower(t or ""))
        hit, found = set(), set()
        for m in {len(k) for k in windows}:
            for k in range(len(w) - m + 1):
                if ids := windows.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    found |= ids
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_decontamination(spark, docs, rows, block):
    texts = [t for _, t in rows if t and len(t) > 300]
    items = [(1, texts[0][20:200]), (2, texts[1][:150].upper()), (3, "nowhere to be found in any text"), (4, None), (5, " ".join(texts[2].split()[3:6])), (10, texts[0][20:200]), (11, texts[3].split()[5])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_matches(docs, bench, block_bytes=block)
    want = contamination_brute(rows, items)
    assert by_id(decontaminate.summarise(found), "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    kept = {r["doc_id"] for r in decontaminate.decontaminate(docs, bench, block_bytes=block).collect()}
    assert kept == {i for i, v in want.items() if not v[-1]}
    words = {i: ALNUM.findall(lower(t or "")) for i, t in rows}
    of = {str(i): ALNUM.findall(lower(t or "")) for i, t in items}
    for r in found.collect():
        for p in r["places"]:  # every match is verbatim
            assert words[r["doc_id"]][p["word"] : p["word"] + p["length"]] == of[p["item"]][p["item_word"] : p["item_word"] + p["length"]]


# learned operators


def test_language_accuracy(whole):
    got = langid.identify(whole, langid.train(whole)).join(whole.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    right = got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert right > 0.97
    assert got.where("score < 0 OR score > 1").count() == 0


def test_language_ignores_labels(whole):
    net = langid.train(whole)
    a = langid.identify(whole, net).drop("held_out").orderBy("doc_id").collect()
    b = langid.identify(whole.withColumn("lang", F.lit("xx")), net).drop("held_out").orderBy("doc_id").collect()
    assert a == b


def test_toxicity(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]
    rows = []
    for i in range(900):
        t = [rng.choice(words) for _ in range(60)]
        if i % 3 == 0:
            for k in rng.sample(range(60), 4):
                t[k] = rng.choice(["grumph", "blorkan", f"zonk{rng.choice(words)}"])
        rows.append((i, " ".join(t), int(i % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    learned = toxicity.learn(docs, labels)
    assert all(learned.arc(w)[0] == "insult" and learned.arc(w)[1] > 3 for w in ("grumph", "blorkan"))
    got = toxicity.score_toxicity(docs, learned).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) / len(got) > 0.95
    assert learned.score("") < 0.5 and learned.score(None) < 0.5


def test_grammar_composition():
    classes = ["negation", "other", "insult", "insult", "insult", "target", "insult"]
    machine = toxicity.grammar()
    got = [s for s, _ in machine.run(classes)]
    assert got == ["negation", "other", "insult+negated", "insult+negated", "insult", "target+addressed", "insult+aimed"]
    assert [s for s, _ in machine.run(["intent", "other", "violence", "target"])][2:] == ["threat", "target+addressed"]
    assert "insult+negated+reported+aimed" in toxicity.emitted(machine)
    weights = {s: w for s, w in machine.run(["speech", "other", "insult"])}
    assert weights["insult+reported"] == toxicity.PRIOR["reported"]


def test_grammar_scores_clauses_not_words():
    """The same words score differently by where they stand: a counter of words cannot tell these apart."""
    g = toxicity.Grammar({"grumph": 7.0}, {}, {}, -0.02, coefficients=(0.4, 0.4, 0.0), bias=-3.0)
    assert g.score("you are a grumph") > 0.5 > g.score("not a grumph. no grumph")
    assert g.score("you aren't a grumph") < 0.5 < g.score("aren't you late. you grumph")
    assert g.score("he said it is a grumph") < 0.5 < g.score("it is a grumph he said")
    assert g.score("I will kill you") > 0.5 > g.score("you will see the frost kill")
    assert g.score("I will not kill you") < 0.5 and g.score("kill the process. will you") < 0.5


def test_grammar_learns_contexts(spark):
    """Where negated insults are labelled clean, the weight of negation comes from the labels."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]
    rows = []
    for i in range(1500):
        t = [rng.choice(words) for _ in range(40)]
        if i % 3 == 0:
            t[5:7] = ["you", "grumph"]
        if i % 9 == 1:
            t[5:7] = ["not", "grumph"]
        rows.append((i, " ".join(t), int(i % 3 == 0)))
    learned = toxicity.Grammar({"grumph": 4.0}, {}, {})
    seen = [collections.Counter(o for _, t, y in rows if y == k for path in learned.clauses(t) for o, _ in path) for k in (1, 0)]
    assert toxicity.context_weights(*seen)["negated"] < -4


# registered queries


def test_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "tokens"]


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    got = [r["doc_id"] for r in out.collect()]
    assert len(got) == len(set(got)) and 0.5 * spark.read.parquet(f"{SF}/documents.parquet").count() < len(got)
