"""Byte-level BPE by monoid tree reduction.

A text is halved until its parts are short; the parts are encoded, and neighbours are joined on the
way up. Only a window around the seam can differ from the joined halves. It grows until its two
ends are provably stable, is encoded again, and takes the place of the tokens it covers.

Two kinds of ends are stable:

* Between pieces. No match of the pattern holds a blank after a non-blank, a non-letter after a
  letter, or a non-digit after a digit. At such a place a match always ends and the next begins,
  whatever stands around it, so tokens on either side never change.
* Within a piece. A sequence of tokens is the encoding of its bytes exactly if every two neighbours
  are the encoding of theirs: merges are made by rank, and a merge across a seam that could
  come before the merges on its sides would already show in that pair. So once the tokens at both
  ends of the re-encoded window agree with their neighbours outside, nothing further can change.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import fresh_name, on_workers

#: Parts up to so many code points (or bytes of one piece) are encoded at once.
LEAF = 1024
#: First size of a window on either side of a seam, in code points and in tokens.
REACH = 32
NEAR = 4

_STABLE = r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}\s])|(?<=\p{N})(?=[^\p{N}\s])"


@dataclass
class Vocabulary:
    """Ranks, the bytes of each id, and the two patterns."""

    ranks: dict[bytes, int]
    pieces: object
    stable: object
    tokens: list[bytes]
    merges: object

    def short(self, text: str) -> np.ndarray:
        """Encoding of a short text."""
        return np.frombuffer(self.merges.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32).astype(np.int32)

    def short_piece(self, raw: bytes) -> list[int]:
        """Encoding of the bytes of one short piece."""
        whole = self.ranks.get(raw)
        return [whole] if whole is not None else self.merges._encode_single_piece(raw)


@functools.lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Read a rank file once per process."""
    import regex
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for raw, rank in ranks.items():
        tokens[rank] = raw
    name = hashlib.sha256(f"{path}\0{pattern}".encode()).hexdigest()
    merges = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return Vocabulary(ranks, regex.compile(pattern), regex.compile(_STABLE), tokens, merges)


def _agree(v: Vocabulary, a: int, b: int) -> bool:
    """Whether two neighbouring tokens are the encoding of their bytes."""
    return v.short_piece(v.tokens[a] + v.tokens[b]) == [a, b]


def _join_pieces(v: Vocabulary, a: list[int], b: list[int]) -> list[int]:
    """Encoding of one piece from the encodings of its two parts."""
    near = NEAR
    while True:
        left, right = max(0, len(a) - near), min(len(b), near)
        raw = b"".join([v.tokens[t] for t in a[left:]]) + b"".join([v.tokens[t] for t in b[:right]])
        window = v.short_piece(raw)
        if (not left or _agree(v, a[left - 1], window[0])) and (
            right == len(b) or _agree(v, window[-1], b[right])
        ):
            return a[:left] + window + b[right:]
        near *= 2


def encode_piece(v: Vocabulary, raw: bytes, leaf: int = LEAF) -> list[int]:
    """Encoding of one match of the pattern, by halves."""
    whole = v.ranks.get(raw)
    if whole is not None:
        return [whole]
    if len(raw) <= leaf:
        return v.short_piece(raw)
    half = len(raw) // 2
    return _join_pieces(v, encode_piece(v, raw[:half], leaf), encode_piece(v, raw[half:], leaf))


def _window(v: Vocabulary, text: str, leaf: int) -> np.ndarray:
    """Encoding of the text of a window; one far beyond a leaf holds a piece as long."""
    if len(text) <= leaf:
        return v.short(text)
    ids: list[int] = []
    for piece in v.pieces.findall(text):
        ids += encode_piece(v, piece.encode(), leaf)
    return np.array(ids, dtype=np.int32)


def _seam(v: Vocabulary, text: str, lo: int, mid: int, hi: int) -> tuple[int, int]:
    """The last stable place before `mid` and the first after it, or the ends of the halves."""
    reach = REACH
    while True:
        start = max(lo, mid - reach)
        # One more code point on the left, for what the pattern looks back at.
        near = [m.start() for m in v.stable.finditer(text, max(lo, start - 1), mid)]
        near = [x for x in near if lo < x < mid]
        if near or start == lo:
            break
        reach *= 2
    left = near[-1] if near else lo
    reach = REACH
    while True:
        end = min(hi, mid + reach)
        after = next((m.start() for m in v.stable.finditer(text, mid, end) if m.start() > mid), None)
        if after is not None or end == hi:
            break
        reach *= 2
    return left, hi if after is None else after


def encode(v: Vocabulary, text: str, lo: int = 0, hi: int | None = None, leaf: int = LEAF) -> np.ndarray:
    """Token ids of `text[lo:hi]`, which stands by itself."""
    hi = len(text) if hi is None else hi
    if hi - lo <= leaf:
        return v.short(text[lo:hi])
    mid = (lo + hi) // 2
    a, b = encode(v, text, lo, mid, leaf), encode(v, text, mid, hi, leaf)
    left, right = _seam(v, text, lo, mid, hi)
    # What the window's two sides are as parts of the halves, and what it is as a whole.
    gone_a, gone_b = len(_window(v, text[left:mid], leaf)), len(_window(v, text[mid:right], leaf))
    return np.concatenate([a[: len(a) - gone_a], _window(v, text[left:right], leaf), b[gone_b:]])


def decode(v: Vocabulary, ids: np.ndarray, lo: int = 0, hi: int | None = None, leaf: int = LEAF) -> bytes:
    """The bytes of token ids: those of the halves, one after the other."""
    hi = len(ids) if hi is None else hi
    if hi - lo <= leaf:
        return b"".join([v.tokens[t] for t in ids[lo:hi].tolist()])
    mid = (lo + hi) // 2
    return decode(v, ids, lo, mid, leaf) + decode(v, ids, mid, hi, leaf)


def encode_texts(
    df: DataFrame, ranks: str, pattern: str, text_col: str = "text", ids_col: str = "ids", leaf: int = LEAF
) -> DataFrame:
    """`df` with the token ids of each whole text in `ids_col` (replaced if it is there).

    A null text counts as empty and has no ids. `ranks` is the path of a rank file that each
    machine has. Special tokens are ordinary text. The longest text is bounded by one row.
    """
    on_workers(df.sparkSession)

    @F.pandas_udf("array<int>")
    def encoded(column: pd.Series) -> pd.Series:
        v = vocabulary(ranks, pattern)
        return column.map(lambda t: encode(v, t or "", leaf=leaf), na_action=None)

    # So marked, the ids are made once however often a plan refers to them.
    once = encoded.asNondeterministic()
    return df.withColumn(ids_col, once(F.col(f"`{text_col}`").cast("string")))


def decode_ids(
    df: DataFrame, ranks: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded", leaf: int = LEAF
) -> DataFrame:
    """`df` with the bytes of each row's ids in `bytes_col`; null ids give no bytes."""
    on_workers(df.sparkSession)

    @F.pandas_udf("binary")
    def decoded(column: pd.Series) -> pd.Series:
        v = vocabulary(ranks, pattern)
        none = np.empty(0, dtype=np.int32)
        return column.map(lambda x: decode(v, none if x is None else np.asarray(x), leaf=leaf), na_action=None)

    return df.withColumn(bytes_col, decoded(F.col(f"`{ids_col}`")))


def digests(df: DataFrame, ranks: str, pattern: str, text_col: str = "text") -> DataFrame:
    """`df` with n_tokens, ids_sha256 and decoded_sha256 of each text, through encoding and decoding."""
    ids, raw = fresh_name(df, "_ids"), fresh_name(df, "_raw")
    both = decode_ids(encode_texts(df, ranks, pattern, text_col, ids), ranks, pattern, ids, raw)
    return both.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col(raw), 256).alias("decoded_sha256"),
    )


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """All documents encoded by the 50k byte vocabulary, and decoded again."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
