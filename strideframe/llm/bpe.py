"""Byte-level BPE encoding and decoding over Arrow batches.

Each match of the split pattern is encoded on its own by the ``tokenizers`` library. Decoding
reverses the byte-to-character table of the vocabulary file, so characters that are split over
tokens come back whole. Offsets come from the bytes of each token.

Defined results: a null text counts as empty (no tokens, the digest of no bytes); unknown extra
columns are ignored; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm._common import map_texts, table

#: Pieces that a worker remembers before it starts anew: bounds its memory.
CACHE_PIECES = 300_000
#: Pieces that go to the library at a time.
ENCODE_PIECES = 4096
#: Longer pieces are encoded each time, so the cache holds short ones only.
CACHE_CHARS = 40


@cache
def byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, reversed."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """One vocabulary, given as the JSON text of its file: encode, decode and offsets."""

    def __init__(self, vocabulary: str, pattern: str):
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores; the library's threads would only contend
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True
        # the pieces come from the pattern below, so the library must not split them again
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = regex.compile(pattern).findall
        back = byte_characters()
        special = {i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.token_bytes: list[bytes] = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            self.token_bytes[i] = token.encode() if i in special else bytes(back[c] for c in token)
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        known = self.known
        new = list({p for p in pieces if p not in known})
        for k in range(0, len(new), ENCODE_PIECES):
            part = new[k : k + ENCODE_PIECES]
            known.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each whole text."""
        split = [self.split(t) for t in texts]
        self._learn([p for pieces in split for p in pieces])
        get = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(get, pieces)), "<u4") for pieces in split]
        # long pieces are seldom met again
        for p in {p for t, pieces in zip(texts, split) if len(t) > CACHE_CHARS for p in pieces if len(p) > CACHE_CHARS}:
            del self.known[p]
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist() if hasattr(ids, "tolist") else ids))

    def offsets(self, text: str, ids: np.ndarray) -> list[tuple[int, int]]:
        """Begin and end of each token in code points; a token that holds part of a character covers all of it."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        lead = np.concatenate([(raw & 0xC0) != 0x80, [True]])
        char_of = np.cumsum(lead) - 1  # of each byte, and one past the end
        ends = np.cumsum([len(self.token_bytes[i]) for i in ids]).astype(np.int64)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return [(int(char_of[a]), int(char_of[b - 1]) + 1) for a, b in zip(begins, ends)]


@lru_cache(2)
def codec_of(vocabulary: str, pattern: str) -> Codec:
    """One codec for each worker process, whose cache then serves all its tasks."""
    return Codec(vocabulary, pattern)


def read_vocabulary(path: str) -> str:
    """The vocabulary file's text: the driver reads it and ships it, so executors need no file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, *, offsets: bool = False) -> DataFrame:
    """doc_id, ids, and where asked for offset_begin and offset_end, of each text."""
    extra = ", offset_begin array<int>, offset_end array<int>" if offsets else ""

    def rows():
        codec = codec_of(vocabulary, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = codec.encode_all(texts)
            cols = [batch.column("doc_id"), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))]
            names = ["doc_id", "ids"]
            if offsets:
                spans = [codec.offsets(t, i) for t, i in zip(texts, ids)]
                cols += [pa.array([[s[k] for s in doc] for doc in spans], pa.list_(pa.int32())) for k in (0, 1)]
                names += ["offset_begin", "offset_end"]
            return pa.RecordBatch.from_arrays(cols, names)

        return step

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, f"doc_id long, ids array<int>{extra}")


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and text of each row of ids; bytes that are no UTF-8 become replacement characters."""

    def run(batches):
        codec = codec_of(vocabulary, pattern)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([codec.decode(i or []).decode("utf-8", "replace") for i in ids], pa.string())],
                ["doc_id", "text"],
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded bytes: encode, then decode, without keeping the ids."""

    def rows():
        codec = codec_of(vocabulary, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = codec.encode_all([t or "" for t in batch.column("text").to_pylist()])
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(codec.decode(i)).hexdigest() for i in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return step

    return map_texts(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
        rows,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents through the 50k byte-level vocabulary and back."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.PATTERN)
