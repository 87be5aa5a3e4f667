"""Packing without crossings: power-of-two decomposition of documents.

A document's ids (with the end id) are cut into pieces whose lengths are powers
of two: as many full pieces of the greatest length as fit, then the binary
digits of the rest, largest first. Every piece is a sequence of its own and
pieces of equal length share a bucket, so no sequence crosses documents and
none needs padding.

Ids are those of the tokenizer file, which is a parameter. Its byte-level
vocabulary is read once per worker and run by a faster engine with the same
vocabulary and merge order; texts that hold a special token's string or a very
long run of white space, and files of another kind, go through the tokenizers
library itself.

Defined cases: a null text is an empty one and yields the end id alone; texts of
any length are encoded whole; repeated rows yield their pieces again, each with
a sequence_id of its own; an empty table gives no rows; other columns are
ignored. sequence_id is unique: partition number and place within it.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import slices

MAX_TOKENS = 2048
END_ID = 1
#: White-space characters in a row from which the fast engine's pattern may run out of stack.
LONG_RUN = 1 << 16
_RUN = re.compile(rf"\s{{{LONG_RUN}}}")
#: The usual split of byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[str, object] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 bytes stand for themselves, others follow from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in visible}
    rest = [b for b in range(256) if b not in set(visible)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Texts to arrays of ids, equal to those of the tokenizers library for the file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._fast(spec)

    def _fast(self, spec: dict):
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if model.get("type") != "BPE" or not plain or spec.get("normalizer"):
            return None
        import tiktoken

        letters, special = _byte_letters(), set(self.special)
        try:
            ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        except KeyError:
            return None
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        order = [model["vocab"][m] for m in merged]
        if order != sorted(order):  # the engine merges by id
            return None
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        long_run = len(text) >= LONG_RUN and _RUN.search(text)
        if self.fast is None or long_run or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def piece_lengths(tokens: int, most: int = MAX_TOKENS) -> list[int]:
    """The power-of-two pieces of so many tokens, largest first."""
    out = [most] * (tokens // most)
    rest = tokens % most
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


PIECES = "doc_id long, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def pack(docs: DataFrame, path: str | None = None, most: int = MAX_TOKENS, with_ids: bool = True) -> DataFrame:
    """One row per piece: its place in the document, its ids, its sequence and bucket (log2 of the length)."""
    path = path or tokenizer_path()
    if most & (most - 1):
        raise ValueError("the greatest length must be a power of two")
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches):
        encode, sequence = encoder(path), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                out = {name: [] for name in names}
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.append(encode.ids(text or ""), np.uint32(END_ID)).astype("<u4")
                    start = 0
                    for length in piece_lengths(len(ids), most):
                        piece = ids[start : start + length]
                        row = (doc_id, start, length, piece.astype(np.int32) if with_ids else None, zlib.crc32(piece.tobytes()), len(ids), sequence, 0, length.bit_length() - 1)
                        for name, value in zip(names, row, strict=True):
                            out[name].append(value)
                        start += length
                        sequence += 1
                types = [pa.list_(pa.int32()) if n == "ids" else pa.int32() if n == "bucket" else pa.int64() for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write packed sequences with one folder per length, for batches of one length."""
    pieces.write.partitionBy("bucket").parquet(path)


def op6_pack_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, with_ids=False).drop("ids")
