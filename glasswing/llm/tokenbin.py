"""Token ids in binary files, each document compressed by itself with one shared dictionary.

A folder holds ``dictionary`` and shards. A shard is the magic, a JSON header with its length
before it, the documents' frames one after another, the index, and the index's offset. The header
names the SHA-256 of the dictionary, which readers check, and the bytes of an id. The index has a
row for each document in ascending order of its id: the id, whether it is null, where its frame
starts and ends, the ids before it in the shard, and their number. One document is read by a
search in the index and one read of its frame.

Documents are dealt out by ranges of their id, each task writes one shard under a name of its own
and moves it into place when it is whole, so a task that runs again leaves no half shard.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glasswing.llm.bpe import once
from glasswing.llm.common import partitions, shared_dir, short_batches
from glasswing.llm.pieces import cut, piece

MAGIC = b"GWTB0001"
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("start", "<u8"), ("end", "<u8"), ("before", "<u8"), ("tokens", "<u4")])
#: Documents that the dictionary is trained on, at most, and ids of each that it sees.
SAMPLE, SAMPLE_IDS, DICTIONARY = 1_000, 2_048, 64 << 10
LEVEL = 3
#: Encoded parts of texts that a worker holds before it forgets them.
MOST_WORDS = 1_000_000
MOST_BYTES = 64 << 20


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write each byte as: itself if printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)]


class LibraryEncoder(dict):
    """Encodes whole texts as the tokenizers library does, special tokens' strings included.

    With a byte-level pre-tokenizer and no normalizer, a text is cut where the pre-tokenizer cuts it
    too, and this dictionary holds the ids of each part: plain words are encoded by the library's
    merge model itself, all else by the whole tokenizer. Texts that hold an added token's string go
    through the whole tokenizer. When there are too many parts, they are forgotten and encoded anew.
    """

    def __init__(self, data: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(data)
        made = json.loads(data)
        pre = made.get("pre_tokenizer") or {}
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.by_piece = plain and not made.get("normalizer") and not made.get("post_processor")
        self.added = [x["content"] for x in made.get("added_tokens") or []]
        self.letters = {b: x for b, x in enumerate(byte_letters())}
        self.space = self.letters[32]
        self.model = self.tokenizer.model

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, text: str) -> bytes:
        seen = text.encode("utf-8").decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()

    def __missing__(self, part: str) -> bytes:
        """A part that stands behind a space, unless it begins with a line feed."""
        if part.isalpha():
            out = array("I", [t.id for t in self.model.tokenize(self.space + part)]).tobytes() if part.isascii() else self.word(" " + part)
        elif part[-1:] in (",", ".") and part[:-1].isalpha():
            out = self[part[:-1]] + self.word(part[-1])
        elif part[:1] == "\n" and part[1:].isalpha():
            out = self.word("\n") + self.word(part[1:])
        else:
            out = self.whole(piece(part))
        self[part] = out
        return out

    def __call__(self, text: str) -> bytes:
        if not self.by_piece or any(x in text for x in self.added):
            return self.whole(text)
        if len(self) > MOST_WORDS:
            self.clear()
        first, *rest = cut(text)
        return self.whole(first) + b"".join(map(self.__getitem__, rest))


def vocabulary(path: str) -> bytes:
    """A tokenizer file's bytes, read by the driver; its size is checked, as it is broadcast."""
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} has over {MOST_BYTES} bytes")
    return data


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _put(folder: str, name: str, write) -> str:
    """Writes a file under another name and moves it into place."""
    store, path = _store(folder)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        write(out)
    store.move(own, f"{path}/{name}")
    return name


def serialized(ids: bytes, wide: bool) -> bytes:
    return ids if wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def train_dictionary(docs: DataFrame, data: bytes, end: int) -> bytes:
    """A dictionary from the serialized ids of the documents with the smallest hash of their id; empty if too few."""
    shared = docs.sparkSession.sparkContext.broadcast(data)
    chosen = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).distinct()

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = once(LibraryEncoder, shared.value)
        for batch in batches:
            ids = [encoder(x or "") + struct.pack("<I", end) for x in batch.text]
            yield pd.DataFrame({"ids": [serialized(x[: SAMPLE_IDS * 4], encoder.wide) for x in ids]})

    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text").mapInPandas(of, "ids binary").limit(SAMPLE)
    parts = [bytes(r.ids) for r in sample.collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples
        return b""


def _dictionary(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def write(docs: DataFrame, data: bytes, folder: str | None = None, end: int = 0, shards: int | None = None) -> tuple[str, list[dict]]:
    """Encodes every whole text, appends id ``end``, writes shards in ascending order of doc_id.

    Returns the folder and a row for each shard, with the ids before it; their number is that of
    shards, not of documents. Null texts are empty, null ids come first, and rows that repeat an id
    stay in the order of their texts. Columns other than ``doc_id`` and ``text`` aren't written.
    """
    spark = docs.sparkSession
    short_batches(spark)
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    if "://" not in folder and ":/" not in folder:
        folder = f"file://{folder}"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dictionary = train_dictionary(docs, data, end)
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    _put(folder, "dictionary", lambda out: out.write(dictionary))
    digest = hashlib.sha256(dictionary).hexdigest()
    shared = spark.sparkContext.broadcast((data, dictionary))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = once(LibraryEncoder, shared.value[0])
        known = _dictionary(shared.value[1])
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=known) if known else zstandard.ZstdCompressor(level=LEVEL)
        batches = (b for b in batches if len(b))
        first = next(batches, None)
        if first is None:
            return
        shard, rows = TaskContext.get().partitionId(), []

        def fill(out) -> None:
            nonlocal first
            head = json.dumps({"dictionary_sha256": digest, "id_bytes": 4 if encoder.wide else 2, "end": end}).encode()
            out.write(MAGIC + struct.pack("<I", len(head)) + head)
            at, before = len(MAGIC) + 4 + len(head), 0
            while first is not None:
                for doc, text in zip(first.doc_id.astype("Int64"), first.text, strict=True):
                    coded = encoder(text) + struct.pack("<I", end)
                    frame = squeeze.compress(serialized(coded, encoder.wide))
                    out.write(frame)
                    null = doc is pd.NA
                    rows.append((0 if null else int(doc), null, at, at + len(frame), before, len(coded) // 4))
                    at, before = at + len(frame), before + len(coded) // 4
                first = next(batches, None)
            out.write(np.array(rows, INDEX).tobytes() + struct.pack("<QQ", at, len(rows)))

        name = _put(folder, f"shard-{shard:06d}", fill)
        yield pd.DataFrame({"shard": [shard], "name": [name], "docs": [len(rows)], "tokens": [int(sum(r[5] for r in rows))]})

    count = shards or partitions(spark)
    ordered = docs.repartitionByRange(count, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    made = ordered.mapInPandas(of, "shard int, name string, docs long, tokens long").collect()
    out, before = [], 0
    for r in sorted(made, key=lambda r: r.shard):
        out.append({"shard": r.shard, "name": r.name, "docs": r.docs, "tokens": r.tokens, "before": before})
        before += r.tokens
    return folder, out


class Shard:
    """Reads a shard: all documents in order, or one by its id."""

    def __init__(self, folder: str, name: str, dictionary: bytes | None = None):
        store, path = _store(folder)
        if dictionary is None:
            with store.open_input_file(f"{path}/dictionary") as f:
                dictionary = f.read()
        self.file = store.open_input_file(f"{path}/{name}")
        if self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{name} is no token shard")
        (n,) = struct.unpack("<I", self.file.read_at(4, len(MAGIC)))
        self.head = json.loads(self.file.read_at(n, len(MAGIC) + 4))
        if self.head["dictionary_sha256"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError(f"{name} was written with another dictionary")
        size = self.file.size()
        at, count = struct.unpack("<QQ", self.file.read_at(16, size - 16))
        self.index = np.frombuffer(self.file.read_at(count * INDEX.itemsize, at), INDEX)
        known = _dictionary(dictionary)
        self.open = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
        self.type = "<u4" if self.head["id_bytes"] == 4 else "<u2"

    def ids(self, row: int) -> np.ndarray:
        r = self.index[row]
        raw = self.open.decompress(self.file.read_at(int(r["end"] - r["start"]), int(r["start"])))
        return np.frombuffer(raw, self.type).astype("<u4")

    def find(self, doc_id: int) -> np.ndarray | None:
        """The ids of the first document with this id."""
        nulls = int(self.index["null"].sum())
        at = nulls + int(np.searchsorted(self.index["doc_id"][nulls:], doc_id))
        return self.ids(at) if at < len(self.index) and self.index["doc_id"][at] == doc_id else None


def read(spark: SparkSession, folder: str, manifest: list[dict], want: str = "digest") -> DataFrame:
    """``doc_id, start, n_tokens`` and ``ids_crc32`` (or ``ids`` with ``want="ids"``) from the files alone."""
    kind = "ids array<long>" if want == "ids" else "ids_crc32 long"
    schema = f"doc_id long, start long, n_tokens long, {kind}"
    if not manifest:
        return spark.createDataFrame([], schema)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, before in zip(batch.name, batch.before, strict=True):
                shard = Shard(folder, name)
                for a in range(0, len(shard.index), 2000):
                    part = shard.index[a : a + 2000]
                    ids = [shard.ids(i) for i in range(a, a + len(part))]
                    own = pd.Series(part["doc_id"].astype("int64"), dtype="Int64").mask(part["null"] == 1)
                    got = {"ids": ids} if want == "ids" else {"ids_crc32": [zlib.crc32(x.tobytes()) for x in ids]}
                    yield pd.DataFrame({"doc_id": own, "start": part["before"].astype("int64") + before, "n_tokens": part["tokens"].astype("int64"), **got})

    files = spark.createDataFrame([(m["name"], m["before"]) for m in manifest], "name string, before long")
    return files.repartition(len(manifest)).mapInPandas(of, schema)
