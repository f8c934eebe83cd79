"""Encoding of whole texts with a public byte-level tokenizer, and decoding by raw bytes."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the tokenizer files; a parameter of every operator here.
TOKENIZERS = os.environ.get("TIDEWRIGHT_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pre-splitting pattern that belongs to the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts longer than this are encoded in pieces.
PIECE = 16_384
#: No token of the pattern reaches over these places: into white space from before it, or out of a run of letters.
SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}])")


@functools.lru_cache
def encoding(name: str, folder: str):
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text cut at safe places, each piece at least `size` characters if a safe place follows; encoded apart they give the same ids."""
    out, at = [], 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


def encode(text: str | None, name: str, folder: str) -> np.ndarray:
    if not text:
        return np.empty(0, np.uint32)
    enc = encoding(name, folder)
    if len(text) <= PIECE:
        return enc.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([enc.encode_to_numpy(p, disallowed_special=()) for p in pieces(text)])


def decode(ids: list[int], name: str, folder: str) -> bytes:
    """The bytes of the tokens one after the other; a token may end within a character, so text is made of the whole only."""
    return encoding(name, folder).decode_bytes(ids)


def token_ids(df: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids): the ids of each row's whole text without special tokens, whose strings are ordinary text. Null and empty texts have the empty
    list. Every row stands alone, rows repeated whole come out again; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode(t, name, folder) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def round_trip(df: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_tokens, n_bytes, same): whether the decoded bytes of a text's ids are its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, size, same = [], [], []
            for t in batch.column(1).to_pylist():
                ids, raw = encode(t, name, folder), (t or "").encode()
                n.append(len(ids))
                size.append(len(raw))
                same.append(decode(ids.tolist(), name, folder) == raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(size, pa.int64()), pa.array(same)], names=["doc_id", "n_tokens", "n_bytes", "same"])

    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, n_tokens int, n_bytes bigint, same boolean")
