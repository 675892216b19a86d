"""Encoding whole texts with a public byte-level BPE (problem 7) by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be joined by a merge,
so the text may be cut there. Of those certain cuts the ones before a blank, tab or line break that
follows a visible character are used, as no pre-token of the pattern spans them either and nothing
left of them changes how the right side is split. The fragments are encoded independently (each
distinct one once per worker while it stays in the cache) and their ids are concatenated.
"""

from __future__ import annotations

import base64
import os
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklode.runtime import spread

#: Folder of the public vocabulary files; every function takes another one as `vocab_dir`.
VOCAB_DIR = "/opt/tokenizers"
#: Distinct fragments a worker keeps, and the longest one kept: about 60 MB at most.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48
#: Rows turned into ids at a time.
SLICE = 500
#: The pattern that comes with the vocabulary files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLANKS = " \t\n\r"

_made: dict = {}


def certain_cuts(tokens) -> np.ndarray:
    """256 x 256 bools: True where the pair of bytes occurs inside no token."""
    free = np.ones((256, 256), bool)
    for t in tokens:
        if len(t) > 1:
            a = np.frombuffer(t, np.uint8)
            free[a[:-1], a[1:]] = False
    return free


def fragment_pattern(free: np.ndarray) -> re.Pattern:
    """Fragments of a text: cut before a run of BLANKS after a character that is no white space and
    whose last byte forms a certain cut with every blank."""
    unsafe = {b for b in range(256) if not all(free[b, ord(w)] for w in BLANKS)} - set(map(ord, BLANKS))
    keep = [c for c in range(0x10000) if chr(c).isspace() and chr(c) not in BLANKS or c < 0x80 and c in unsafe or c >= 0x80 and (0x80 | c & 0x3F) in unsafe]
    if any(b >= 0x80 for b in unsafe):  # one range for all beyond the basic plane: a table per plane would be slow
        keep += range(0x10000, sys.maxunicode + 1)
    runs: list[list[int]] = []
    for c in keep:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    glued = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
    return re.compile(f"[{BLANKS}]*[^{BLANKS}]+" + (f"(?:(?<=[{glued}])[{BLANKS}]+[^{BLANKS}]*)*" if glued else "") + f"|[{BLANKS}]+")


class Fragments(dict):
    """fragment -> its ids as int32 bytes; encodes what is missing."""

    def __init__(self, vocab_dir: str, name: str = "byte_bpe_50k"):
        import tiktoken

        with open(os.path.join(vocab_dir, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.split = fragment_pattern(certain_cuts(ranks)).findall

    def __missing__(self, s: str) -> bytes:
        ids = np.array(self.encode(s), np.int32).tobytes()
        if len(s) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[s] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text))) if text else b""


def fragments(vocab_dir: str, name: str = "byte_bpe_50k") -> Fragments:
    """One cache per Python worker."""
    if (vocab_dir, name) not in _made:
        _made[vocab_dir, name] = Fragments(vocab_dir, name)
    return _made[vocab_dir, name]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_dir: str = VOCAB_DIR) -> DataFrame:
    """(doc_id, ids array<int>): the ids of each text, unchanged, without special tokens.

    Null and empty texts give an empty list; strings that look like special tokens are ordinary
    text. One row per input row, repeats included; other columns are left out.
    """

    def run(batches):
        get = fragments(vocab_dir).ids
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                got = [get(t) for t in part.column(1).to_pylist()]
                ends = np.zeros(len(got) + 1, np.int32)
                np.cumsum([len(g) // 4 for g in got], out=ends[1:])
                ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(got))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), ids)], names=["doc_id", "ids"])

    t = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    return t.mapInArrow(run, f"doc_id {t.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def with_token_counts(docs: DataFrame, keep: list[str], text_col: str = "text", vocab_dir: str = VOCAB_DIR) -> DataFrame:
    """`keep` columns plus n_tokens bigint; 0 for null and empty texts. The text itself is dropped."""

    def run(batches):
        get = fragments(vocab_dir).ids
        for batch in batches:
            n = []
            for at in range(0, batch.num_rows, SLICE):
                n += [len(get(t)) // 4 for t in batch.column(len(keep)).slice(at, SLICE).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    t = spread(docs.select(*keep, F.col(text_col).cast("string").alias("_text")))
    schema = ", ".join(f"`{c}` {t.schema[c].dataType.simpleString()}" for c in keep)
    return t.mapInArrow(run, f"{schema}, n_tokens bigint")
