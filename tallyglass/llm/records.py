"""Token sequences as files of length-delimited binary records, with a separate offset index for shuffled reads.

A record file is a run of frames:

    8 bytes   length of the payload, unsigned, little-endian
    4 bytes   masked CRC-32 of these 8 bytes
    payload   1 byte: 1 if the sequence has an id, else 0; 8 bytes: the id, signed; 1 byte: bytes of a token id, 2 or 4;
              then the token ids, unsigned, little-endian
    4 bytes   masked CRC-32 of the payload
    1 byte    newline

A checksum is masked as ((crc >> 15 | crc << 17) + 0xA282EAD8) mod 2^32, so that checksums of data with checksums in them
stay sound. Files are in ascending order of ids, and so are the frames in them. Spark's own writer commits the files,
so lost tasks and executors leave no part of a file; readers use Spark's binary file source, so any store will do.
The index (Parquet) has for each record: file, offset, length, id, number of tokens, checksum of the tokens.

Results for odd input: a null or empty text is a sequence of the end id alone; a null id comes first; repeated rows are
repeated records, in the order of their texts; an empty table gives no records; other columns are not read.
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from itertools import batched, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .bpe import Memo, cut, joined
from .common import arrow_map, fresh_path, keeps, small

ROWS = 1_000


def masked(data: bytes) -> bytes:
    crc = zlib.crc32(data)
    return struct.pack("<I", ((crc >> 15 | crc << 17 & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF)


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    payload = struct.pack("<BqB", doc_id is not None, doc_id or 0, width) + ids
    size = struct.pack("<Q", len(payload))
    return b"".join((size, masked(size), payload, masked(payload)))


def frames(data: bytes):
    """(offset, length, id, token ids) of each frame of a file or part of one; raises ValueError where a checksum is wrong."""
    at, view = 0, memoryview(data).cast("B")
    while at < len(view):
        size = bytes(view[at : at + 8])
        n = struct.unpack("<Q", size)[0]
        if view[at + 8 : at + 12] != masked(size) or at + n + 17 > len(view):
            raise ValueError(f"length at {at} is damaged")
        payload = bytes(view[at + 12 : at + 12 + n])
        if view[at + 12 + n : at + 16 + n] != masked(payload) or view[at + 16 + n] != 10:
            raise ValueError(f"record at {at} is damaged")
        has_id, doc_id, width = struct.unpack_from("<BqB", payload)
        yield at, n + 17, doc_id if has_id else None, np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4", copy=False)
        at += n + 17


class WordEncoder:
    """A library tokenizer that drops space and joins nothing across it, nor a letter or digit to a dot or comma after it; with the ids of
    words it has met kept, as bytes of `width` each."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        size = self.lib.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.ends = np.zeros(size, bool)
        for name, i in self.lib.get_vocab(with_added_tokens=False).items():
            self.ends[i] = name.endswith("</w>")
        self.memo = Memo(12_000_000, 900_000)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _bytes(self, ids) -> bytes:
        return np.asarray(ids, f"<u{self.width}").tobytes()

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of words that are not in the memo; they are then. Words of letters are encoded many to a text, which costs less, and told
        apart by their end-of-word tokens."""
        made: dict[str, bytes] = {}
        plain = [w for w in new if w.isalpha()]
        for i in range(0, len(plain), 500):
            some = plain[i : i + 500]
            ids = np.asarray(self._ids([" ".join(some)])[0], f"<u{self.width}")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                raw, cuts = ids.tobytes(), (ends * self.width).tolist()
                made.update((w, raw[a:b]) for w, a, b in zip(some, [0, *cuts], cuts, strict=False))
            else:
                made.update((w, self._bytes(x)) for w, x in zip(some, self._ids(some), strict=True))
        other = [w for w in new if not w.isalpha()]
        made.update((w, self._bytes(x)) for w, x in zip(other, self._ids(other), strict=True))
        self.memo.room(new)
        self.memo.update(made)
        return made

    def encode(self, texts: pa.Array) -> list[memoryview]:
        """The ids of each text. Each distinct word of the texts is looked up once."""
        pieces, ends = cut(texts, space_apart=True)
        some = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.memo.get, some))
        if new := [w for w, x in zip(some, found, strict=True) if x is None]:
            learned = self.learn(new)
            found = [learned[w] if x is None else x for w, x in zip(some, found, strict=True)]
        at, ids = joined(pa.array(found, pa.large_binary()), pieces.indices, ends)
        return [ids[a:b] for a, b in pairwise(at.tolist())]


_encoders: dict[str, WordEncoder] = {}
keeps(__name__, _encoders.clear)


def _encoder(path: str) -> WordEncoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_records(docs: DataFrame, root: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_text_bytes: int = 64 << 20) -> None:
    """Writes root/records: the token ids of each text and end_id, in ascending order of ids. tokenizer_path: a tokenizer that
    drops space and marks ends of words, readable on every executor. file_text_bytes: text that goes into one file, about."""
    spark = docs.sparkSession

    def framed(batches):
        enc = _encoder(tokenizer_path)
        end = enc._bytes([end_id])
        for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            ids = enc.encode(b.column(1))
            yield pa.RecordBatch.from_arrays([pa.array([frame(d, b"".join((x, end)), enc.width) for d, x in zip(b.column(0).to_pylist(), ids, strict=True)], pa.binary())], names=["frame"])

    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / file_text_bytes))
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange(n, "id").sortWithinPartitions("id", "text")
    arrow_map(ordered, framed, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{root}/records")


def record_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, content) of the record files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{root}/records").select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("file"), "content")


def write_index(spark: SparkSession, root: str) -> DataFrame:
    """Reads the record files, checks them, writes root/index and returns it: file, offset, length, doc_id, n_tokens, ids_crc32,
    start_in_file (tokens of the file before this record)."""

    def scan(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, start = [], 0
                for at, length, doc_id, ids in frames(content.as_buffer()):
                    rows.append((file, at, length, doc_id, len(ids), zlib.crc32(ids), start))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k == 0 else pa.int64()) for k in range(7)], names=["file", "offset", "length", "doc_id", "n_tokens", "ids_crc32", "start_in_file"])

    arrow_map(record_files(spark, root), scan, "file int, offset long, length long, doc_id long, n_tokens long, ids_crc32 long, start_in_file long").write.parquet(f"{root}/index")
    return spark.read.parquet(f"{root}/index")


def with_starts(index: DataFrame) -> DataFrame:
    """The index with start: tokens of all records before. Only a row for each file is summed up in one place."""
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return index.join(small(totals), "file").withColumn("start", F.col("before") + F.col("start_in_file"))


def read_sequences(spark: SparkSession, root: str, wanted: DataFrame | None = None, rank_col: str | None = None) -> DataFrame:
    """(doc_id, ids) of all records, or of the rows of the index given as wanted: each file with wanted records is read once, and of it
    the frames at their offsets alone. rank_col: a column of wanted (of numbers); then (rank, doc_id, ids) in ascending order of it,
    as for one epoch of training in an order of one's own. Files without wanted records are not read."""
    rows = (spark.read.parquet(f"{root}/index") if wanted is None else wanted).select("file", F.struct(F.col(rank_col).cast("double").alias("rank") if rank_col else F.lit(0.0).alias("rank"), "offset", "length").alias("place"))
    places = rows.groupBy("file").agg(F.sort_array(F.collect_list("place")).alias("places"))

    def pick(batches):
        for b in batches:
            for content, places in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                data = content.as_buffer()
                for some in batched(places, ROWS):
                    got = [next(frames(data[p["offset"] : p["offset"] + p["length"]])) for p in some]
                    yield pa.RecordBatch.from_arrays([pa.array([p["rank"] for p in some], pa.float64()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.list_(pa.int64()))], names=["rank", "doc_id", "ids"])

    found = arrow_map(record_files(spark, root).join(places, "file").select("content", "places"), pick, "rank double, doc_id long, ids array<long>")
    return found.orderBy("rank") if rank_col else found.drop("rank")


def encode_to_records(docs: DataFrame, tokenizer_path: str, end_id: int = 1, root: str | None = None) -> DataFrame:
    """Writes record files and index below root (a new folder of the shared one by default) and returns what they hold."""
    spark = docs.sparkSession
    root = root or fresh_path(spark, "records")
    write_records(docs, root, tokenizer_path, end_id)
    return with_starts(write_index(spark, root))
