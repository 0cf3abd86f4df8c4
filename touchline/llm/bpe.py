"""Byte-level BPE by forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can never
be joined by a merge, so a cut between them is certain. Pre-tokens are cut at
such pairs, the fragments are encoded independently and their ids concatenated.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import quoted

#: Fixed pattern of the byte-level pre-tokenizer.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Where a text may be cut at a space: never beside other white space.
WHITE = re.compile(r" (?:\s|(?<=\s ))")
#: Stretches, and fragments, that a task remembers before it starts afresh.
REMEMBERED = 250_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(c): b for b, c in [*zip(plain, plain, strict=True), *((b, 256 + i) for i, b in enumerate(rest))]}


class ForcedBoundaryBPE:
    """Encoder and decoder of a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        letters = byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        by_id = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.bytes_of = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        #: Merges one fragment; the ranks of merges are those of the tokens they make.
        self.merges = tiktoken.Encoding("fragments", pat_str=r"\S+|\s+", mergeable_ranks=self.ids, special_tokens={})._core_bpe
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        #: joined[a, b]: some token holds byte a followed by byte b.
        self.joined = np.zeros((256, 256), bool)
        for t in self.ids:
            for a, b in zip(t, t[1:]):
                self.joined[a, b] = True
        self.inside = [bytes(np.flatnonzero(row).tolist()) for row in self.joined]
        #: The forced boundaries among a space and a to z; None: there are none.
        few = b" abcdefghijklmnopqrstuvwxyz"
        apart = [f"{chr(a)}[{''.join(chr(b) for b in few if b not in self.inside[a])}]" for a in few if not set(few) <= set(self.inside[a])]
        self.rare = re.compile("|".join(apart)) if apart else None
        self.fragments: dict[bytes, list[int]] = {}
        self.units: dict[str, bytes] = {}

    def forget(self) -> None:
        self.fragments.clear()
        self.units.clear()

    def cut(self, raw: bytes) -> list[bytes]:
        """Fragments between forced boundaries."""
        inside = self.inside
        cuts = [i for i, (a, b) in enumerate(zip(raw, raw[1:]), 1) if b not in inside[a]]
        return [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])] if cuts else [raw]

    def fragment(self, raw: bytes) -> list[int]:
        ids = self.fragments.get(raw)
        if ids is None:
            ids = self.merges.encode_single_piece(raw)
            if len(raw) < 64:
                if len(self.fragments) >= REMEMBERED:
                    self.fragments.clear()
                self.fragments[raw] = ids
        return ids

    def _unit(self, unit: str) -> bytes:
        """The ids, as little-endian integers, of a stretch of text that no pre-token crosses."""
        if unit[1:].isalpha() and unit[0] == " ":
            if unit.isascii() and unit.islower() and not (self.rare and self.rare.search(unit)):
                return array("I", self.merges.encode_single_piece(unit.encode())).tobytes()
            words = (unit,)
        elif unit[1:-1].isalpha() and unit[0] == " " and unit[-1] in ".,":
            words = (unit[:-1], unit[-1])
        else:
            words = PRETOKEN.findall(unit)
        return array("I", [i for p in words for f in self.cut(p.encode()) for i in self.fragment(f)]).tobytes()

    def stretches(self, text: str) -> list[str]:
        """The text cut where a single space stands between other characters: before it, a pre-token always ends."""
        if WHITE.search(text):
            cuts = [0, *(m.start() for m in re.finditer(r"(?<=\S) (?=\S)", text)), len(text)]
            return [text[a:b] for a, b in zip(cuts, cuts[1:])]
        if "\0" in text:
            return [text]
        return text.replace(" ", "\0 ").split("\0")

    def encoded(self, text: str | None) -> np.ndarray:
        """The ids of a text."""
        text, out, known = text or "", [], self.units
        for piece in self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else (text,):
            if piece in self.special:
                out.append(array("I", [self.special[piece]]).tobytes())
                continue
            parts = self.stretches(piece)
            found = list(map(known.get, parts))
            if None in found:
                for k, x in enumerate(found):
                    if x is None:
                        u = parts[k]
                        x = found[k] = self._unit(u)
                        if len(u) < 48:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            known[u] = x
            out += found
        return np.frombuffer(b"".join(out), np.uint32)

    def encode(self, text: str | None) -> list[int]:
        return self.encoded(text).tolist()

    def decode(self, ids) -> str:
        """Bytes of all ids, special ones too, read as UTF-8; what isn't valid becomes U+FFFD."""
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


_CODECS: dict[str, ForcedBoundaryBPE] = {}


@contextmanager
def codec(path: str) -> Iterator[ForcedBoundaryBPE]:
    """One a worker and vocabulary. What it remembered of a task's texts is forgotten at the end, as the worker may go on to other work."""
    if path not in _CODECS:
        _CODECS[path] = ForcedBoundaryBPE(path)
    try:
        yield _CODECS[path]
    finally:
        _CODECS[path].forget()


def round_trip(text: Column, path: str) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256, same) of each text; null counts as empty. same: decoding gives the text back."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with codec(path) as c:
            for texts in batches:
                rows = []
                for t in texts:
                    t = t or ""
                    ids = c.encoded(t).tolist()
                    d, back = ",".join([c.decimal[i] for i in ids]), c.decode(ids)
                    rows.append((len(ids), hashlib.sha256(d.encode()).hexdigest(), hashlib.sha256(back.encode("utf-8")).hexdigest(), back == t))
                yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "same"])

    return both(text)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """docs, whatever its columns' names, with ids array<int> of each text, which replaces a column ids; null or empty text: no ids."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with codec(path) as c:
            for texts in batches:
                yield pd.Series([c.encoded(t).astype(np.int32) for t in texts], dtype=object)

    return _beside(docs, ids(F.col("text").cast("string")).alias("ids"), {"ids": F.col("ids")})


def bpe_digest(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256. Null or empty text: no tokens, digests of the empty string. Repeated or null doc_id: each row stands for itself. No rows: none."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), round_trip(F.col("text").cast("string"), path).alias("r")).select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")


def _beside(docs: DataFrame, made: Column, columns: dict[str, Column]) -> DataFrame:
    """docs' columns but those of the names of `columns`, and these, which are taken from the column `made`."""
    keep = [c for c in docs.columns if c.lower() not in columns]
    df = docs.select(F.struct(*(F.col(quoted(c)) for c in keep)).alias("_row"), made)
    return df.select("_row.*", *(v.alias(k) for k, v in columns.items()))


def with_tokens(docs: DataFrame, path: str) -> DataFrame:
    """docs, whatever its columns' names, with n_tokens, ids_sha256 and decoded_sha256; columns of these names are replaced. Null text: as empty. No rows: none."""
    own = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return _beside(docs, round_trip(F.col("text").cast("string"), path).alias("_made"), {c: F.col("_made")[c] for c in own})
