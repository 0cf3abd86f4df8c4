"""Token ids in files of single documents compressed with a shared zstandard dictionary.

File: b"TKZ1", the dictionary's SHA-256 (32 bytes), the frames (one zstandard
frame a document: its ids as little-endian unsigned 32-bit integers), the index
(per document: id, offset and length of the frame, number of ids, as four
little-endian 64-bit integers), and the index's start and the number of
documents as two more. The dictionary lies beside the files; the manifest, a
Parquet table written last, lists the files in the order of their ids.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import WHITE, byte_letters
from .text import fresh_dir

MAGIC, HEAD = b"TKZ1", 36
#: A space, something else, and no white space at the end.
CHAINED = re.compile(r"(?s) \S(.*\S)?\Z")
#: Stretches that a worker remembers before it starts afresh: some 250 MB.
REMEMBERED = 1_200_000


class CachedTokenizer:
    """Serialized ids by the tokenizers library; stretches between single spaces, which no pre-token crosses, are remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        letters, vocab = byte_letters(), self.tokenizer.get_vocab()
        self.length = np.zeros(max(vocab.values()) + 1, np.int64)
        for t, i in vocab.items():
            self.length[i] = len(t) if all(c in letters for c in t) else len(t.encode())

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, stretches: list[str]) -> dict[str, bytes]:
        """Each stretch's ids. Those that start with their only space are encoded as one text, and its ids dealt by the bytes they stand for."""
        chained = list(map(CHAINED.match, stretches))
        rest = [s for s, m in zip(stretches, chained, strict=True) if not m]
        out = dict(zip(rest, self._library(rest), strict=True))
        chain = [s for s, m in zip(stretches, chained, strict=True) if m] if rest else stretches
        for k in range(0, len(chain), 4096):
            some = chain[k : k + 4096]
            raw = self._library(["".join(some)])[0]
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, some)), np.int64, len(some)))
            at = 4 * np.searchsorted(np.cumsum(self.length[np.frombuffer(raw, "<u4")]), ends) + 4
            out.update(zip(some, map(raw.__getitem__, map(slice, [0, *at[:-1].tolist()], at.tolist())), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        known, out, whole, waiting, new = self.known, [b""] * len(texts), {}, [], {}
        for i, t in enumerate(texts):
            if "\0" in t or WHITE.search(t) or any(s in t for s in self.special):
                whole[i] = t
                continue
            parts = t.replace(" ", "\0 ").split("\0")
            found = list(map(known.get, parts))
            if None in found:
                waiting.append((i, parts, found))
                new.update((p, None) for p, x in zip(parts, found, strict=True) if x is None)
            else:
                out[i] = b"".join(found)
        new.update(self._each(list(new)))
        for i, parts, found in waiting:
            out[i] = b"".join([new[p] if x is None else x for p, x in zip(parts, found, strict=True)])
        for i, raw in zip(whole, self._library(list(whole.values())), strict=True):
            out[i] = raw
        if len(known) + len(new) > REMEMBERED:
            known.clear()
        known.update(new)
        return out


_TOKENIZERS: dict[str, CachedTokenizer] = {}


def tokenizer(path: str) -> CachedTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = CachedTokenizer(path)
    return _TOKENIZERS[path]


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and path of a folder: any that pyarrow knows, or a plain local path."""
    return fs.FileSystem.from_uri(re.sub("^(file:/+|(?=/))", "file:///", uri, count=1))


def read_all(uri: str) -> bytes:
    store, path = opened(uri)
    with store.open_input_stream(path) as f:
        return f.read()


def dictionary(docs: DataFrame, path: str, end_id: int, samples: int, most_bytes: int, size: int) -> bytes:
    """A dictionary trained on a sample of bounded size: of `samples` documents at most (the least hashes of id and text) the serialized ids, of longer ones a stretch of `most_bytes` at a place told by the hash. Empty if there are too few."""
    some = docs.where(F.octet_length("text") > 0).select("text", F.xxhash64("doc_id", "text").alias("h")).orderBy("h", "text").limit(samples)

    def serialized(frames):
        t = tokenizer(path)
        for pdf in frames:
            rows = []
            for text, h in zip(pdf["text"], pdf["h"], strict=True):
                raw = t.encode([text])[0] + np.uint32(end_id).tobytes()
                at = 4 * (int(h) % (max(0, len(raw) - most_bytes) // 4 + 1))
                rows.append(raw[at : at + most_bytes])
            yield pd.DataFrame({"ids": rows})

    data = [bytes(r.ids) for r in some.mapInPandas(serialized, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(size, data, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write(docs: DataFrame, path: str, out: str, end_id: int = 2, file_bytes: int = 32 << 20, samples: int = 1000, most_bytes: int = 16384, size: int = 65536, level: int = 3) -> None:
    """Encodes all texts (null: empty), appends end_id, and writes the files to the folder `out` in ascending order of doc_id.

    Documents are dealt by ranges of doc_id (null first; equal ids by text), a
    file a range of about file_bytes of text; tasks hold one batch of texts and one
    file's index at a time. A task that runs again writes under a new name; the
    manifest names the one that counts.
    """
    spark = docs.sparkSession
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared = dictionary(df, path, end_id, samples, most_bytes, size)
    digest = hashlib.sha256(shared).digest()
    write_file(f"{out}/dictionary", shared)
    end = np.uint32(end_id).tobytes()
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def save(frames):
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(read_all(f"{out}/dictionary")) if shared else None)
        name, index, total, first = f"part-{uuid.uuid4().hex}.tkz", [], 0, None
        store, base = opened(out)
        f, t = None, tokenizer(path)
        for pdf in frames:
            if not len(pdf):
                continue
            if f is None:
                f = store.open_output_stream(f"{base}/{name}")
                f.write(MAGIC + digest)
                at, first = HEAD, None if pd.isna(pdf["doc_id"].iloc[0]) else int(pdf["doc_id"].iloc[0])
            ids = [None if pd.isna(i) else int(i) for i in pdf["doc_id"]]
            for k in range(0, len(ids), 512):
                for i, raw in zip(ids[k : k + 512], t.encode(list(pdf["text"].iloc[k : k + 512])), strict=True):
                    raw += end
                    frame = packer.compress(raw)
                    f.write(frame)
                    index.append((NULL_ID if i is None else i, at, len(frame), len(raw) // 4))
                    at += len(frame)
                    total += len(raw) // 4
        if f is not None:
            f.write(np.array(index, "<i8").tobytes() + np.array([at, len(index)], "<i8").tobytes())
            f.close()
            yield pd.DataFrame({"first": pd.array([first], dtype="Int64"), "file": [name], "docs": [len(index)], "tokens": [total]})

    ranged = df.repartitionByRange(max(1, -(-total // file_bytes)), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ranged.mapInPandas(save, "first long, file string, docs long, tokens long").withColumn("part", F.spark_partition_id()).write.parquet(f"{out}/manifest")


#: Stands for a null id in an index.
NULL_ID = -(1 << 63)


def write_file(uri: str, data: bytes) -> None:
    store, path = opened(uri)
    store.create_dir(os.path.dirname(path))
    with store.open_output_stream(path) as f:
        f.write(data)


class TokenFile:
    """One file: the index is read at once, a document's frame when it is asked for."""

    def __init__(self, folder: str, name: str):
        store, base = opened(folder)
        self.f = store.open_input_file(f"{base}/{name}")
        shared = read_all(f"{folder}/dictionary")
        head = self.f.read_at(HEAD, 0)
        if head[:4] != MAGIC or head[4:] != hashlib.sha256(shared).digest():
            raise ValueError(f"{name} isn't of this folder's dictionary")
        size = self.f.size()
        start, n = np.frombuffer(self.f.read_at(16, size - 16), "<i8").tolist()
        self.index = np.frombuffer(self.f.read_at(32 * n, start), "<i8").reshape(n, 4)
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared) if shared else None)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document."""
        _, at, length, n = self.index[k].tolist()
        return np.frombuffer(self.unpack.decompress(self.f.read_at(length, at), max_output_size=4 * n), "<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every document of this id in the file, by its sorted index."""
        a, b = np.searchsorted(self.index[:, 0], [doc_id, doc_id + 1]).tolist()
        return [self.ids(k) for k in range(a, b)]

    def close(self) -> None:
        self.f.close()


def read(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files: start counts the ids of all documents before it."""
    listed = spark.read.schema("first long, file string, docs long, tokens long, part int").parquet(f"{out}/manifest").toPandas().sort_values("part", kind="stable")
    listed["before"] = listed["tokens"].cumsum() - listed["tokens"]
    names = spark.createDataFrame(listed[["file", "before"]], "file string, before long").repartition(max(1, len(listed)))

    def load(frames):
        for pdf in frames:
            for name, start in zip(pdf["file"], pdf["before"], strict=True):
                f, rows = TokenFile(out, name), []
                for k in range(len(f.index)):
                    ids = f.ids(k)
                    rows.append((int(f.index[k, 0]), int(start), len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                f.close()
                got = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                got["doc_id"] = got["doc_id"].astype("Int64").mask(got["doc_id"] == NULL_ID)
                yield got

    return names.mapInPandas(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, out: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents of one id: the manifest tells the file, its index the frames. None: an empty list."""
    m = spark.read.parquet(f"{out}/manifest").select("first", "file", "part")
    least = m.where((F.col("first") < doc_id) | F.col("first").isNull()).agg(F.max("part")).first()[0]
    found = []
    for r in m.where((F.col("part") >= (0 if least is None else least)) & (F.col("first").isNull() | (F.col("first") <= doc_id))).orderBy("part").collect():
        f = TokenFile(out, r["file"])
        found += f.find(doc_id)
        f.close()
    return found


def token_files(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes docs to files in the shared folder and returns what `read` finds there; null or empty text: the end id alone, no rows: none."""
    out = fresh_dir(docs.sparkSession, "tokens")
    write(docs, path, out, end_id)
    return read(docs.sparkSession, out)
