"""Token ids as length-delimited binary records with an offset index.

One record per document: an 8-byte length of the payload, the masked checksum
of these 8 bytes, the payload, its masked checksum, and a line feed that ends
the record. The payload holds the document's id (8 bytes, the least value of a
long for a null), the width of an id (one byte: 2 if every id of the tokenizer
fits two bytes, else 4) and the token ids; all numbers are little-endian.
A masked checksum is the CRC-32 rotated right by 15 bits plus a constant, so
that checksums of data that holds checksums stay useful.

Spark's own writer commits the files, so lost executors and retried tasks leave
no partial ones, on any file system Spark can reach. Files follow one another
in ascending doc_id order. The index, one row per record with its file, offset
and lengths, is a table of its own: a shuffled reader needs no scan.

Defined cases: a null or empty text has only the end id; a null doc_id comes
first; repeated doc_ids are ordered by text, equal rows follow one another; an
empty table writes no record; a text of any length is one record below 2 GB.
Only doc_id and text are read, so other columns never clash.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_path, small_batches

END_ID = 0
MASK_DELTA = 0xA282EAD8
TOKENIZER = "byte_bpe_50k.json"
_NULL_ID = -(1 << 63)
_HEAD, _TAIL = 12, 5
OUT_BYTES = 8 << 20
#: Records of a file: readers take a file whole, so it has to stay below 2 GB.
FILE_RECORDS = 16_384


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload)), b"\n"))


def frames(data: bytes):
    """(offset, payload) of each record; a damaged record raises."""
    at, view = 0, memoryview(data)
    while at < len(view):
        size = bytes(view[at : at + 8])
        if len(size) < 8 or struct.unpack("<I", view[at + 8 : at + 12])[0] != masked(size):
            raise ValueError(f"damaged length at byte {at}")
        n = struct.unpack("<Q", size)[0]
        payload = bytes(view[at + _HEAD : at + _HEAD + n])
        if len(payload) < n or struct.unpack("<I", view[at + _HEAD + n : at + _HEAD + n + 4])[0] != masked(payload):
            raise ValueError(f"damaged record at byte {at}")
        yield at, payload
        at += _HEAD + n + _TAIL


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Texts whose only white space are blanks and line feeds can be cut before runs of it, and between a letter and one of these signs.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PIECES = re.compile(rf"[ \n]*[{_LETTERS}]+(?=[,.;:!?)\"])|[ \n]*[^ \n]+|[ \n]+")
#: Such a piece is one part for the model, whatever the split pattern.
_WORD = re.compile(rf" ?[{_LETTERS}]+")
_OTHER_SPACE = re.compile(r"[^\S \n]")
CACHE_PIECES = 500_000


class _Pieces(dict):
    """The ids of pieces as bytes, made on first use; emptied by its owner when full."""

    def __init__(self, tokenizer, kind: str):
        self.split, self.ids, self.kind = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize, kind
        self.bytes_of = {k: "".join(p for p, _ in self.split(chr(k))) for k in range(256) if k == 32 or re.match(f"[{_LETTERS}]", chr(k))}

    def __missing__(self, piece: str) -> bytes:
        if _WORD.fullmatch(piece):
            ids = [t.id for t in self.ids(piece.translate(self.bytes_of))]
        else:
            ids = [t.id for part, _ in self.split(piece) for t in self.ids(part)]
        out = self[piece] = array(self.kind, ids).tobytes()
        return out


class Encoder:
    """Token ids of texts as bytes, from the tokenizers library, with a bounded cache of pieces.

    A byte-level tokenizer with its usual split pattern and no normaliser never
    joins white space to what stands before it, nor a letter to the sign after
    it, so a text may be cut there and the ids of the pieces are those of the
    whole. Other tokenizers, texts with other white space, and texts that hold
    an added token's string are encoded whole. Ids take two bytes each if all
    of the vocabulary's fit, otherwise four.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        split, model = made.get("pre_tokenizer") or {}, made["model"]
        self.cuts = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and made.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout")
        self.added = [t["content"] for t in made.get("added_tokens", [])]
        self.kind = "H" if max(self.tokenizer.get_vocab(with_added_tokens=True).values()) < 1 << 16 else "I"
        self.known = _Pieces(self.tokenizer, self.kind) if self.cuts else {}

    def __call__(self, text: str) -> bytes:
        if not self.cuts or _OTHER_SPACE.search(text) or any(a in text for a in self.added):
            return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, _PIECES.findall(text)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker, so that its tasks share the cache."""
    return Encoder(path)


def _records(path: str, end_id: int):
    def run(batches):
        encode = encoder(path)
        end, width = array(encode.kind, [end_id]).tobytes(), array(encode.kind).itemsize
        for b in batches:
            out, size = [], 0
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                out.append(frame(struct.pack("<qB", _NULL_ID if doc is None else doc, width) + encode(text.as_py() or "") + end))
                size += len(out[-1])
                if size > OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return run


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Write the records of docs (doc_id, text) below path, the file names in ascending doc_id order."""
    small_batches(docs.sparkSession)
    keys = ["doc_id", "text"]
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = partitions or max(d.sparkSession.sparkContext.defaultParallelism, d.rdd.getNumPartitions())
    # the head of the text deals the rows of one id to several partitions, in the order of the texts
    ordered = d.repartitionByRange(n, F.col("doc_id"), F.substring("text", 1, 64)).sortWithinPartitions(*keys)
    # the text writer puts the bytes down as they are, and the line feed ends the record
    body = ordered.mapInArrow(_records(tokenizer, end_id), "value binary").select(F.expr("substring(value, 1, length(value) - 1)").cast("string").alias("value"))
    body.write.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def ids_of(payload: bytes) -> tuple[int | None, np.ndarray]:
    """The doc_id and the token ids of a payload, as little-endian unsigned 32-bit numbers."""
    doc, width = struct.unpack("<qB", payload[:9])
    return None if doc == _NULL_ID else doc, np.frombuffer(payload, f"<u{width}", offset=9).astype("<u4")


def _scan(frames_):
    for f in frames_:
        out = []
        for name, data in zip(f.column("path").to_pylist(), f.column("content").to_pylist(), strict=True):
            for k, (at, payload) in enumerate(frames(data)):
                doc, ids = ids_of(payload)
                out.append((name, k, at, len(payload), doc, len(ids), zlib.crc32(ids.tobytes())))
        columns = list(zip(*out, strict=True)) or [[]] * 7
        types = [pa.string(), *[pa.int64()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "ordinal", "offset", "n_bytes", "doc_id", "n_tokens", "ids_crc32"])


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, offset, n_bytes (payload), doc_id, n_tokens, ids_crc32 of every record, all checksums verified."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(_scan, "file string, ordinal long, offset long, n_bytes long, doc_id long, n_tokens long, ids_crc32 long")


def file_order(path: Column) -> Column:
    """The place of a file among the others: its partition's number, then its own in the partition; as numbers, for names are padded to five digits only."""
    part = lambda pattern: F.coalesce(F.regexp_extract(path, pattern, 1).try_cast("long"), F.lit(0).cast("long"))
    return F.struct(part(r"part-(\d+)[^/]*$").alias("part"), part(r"-c(\d+)[^/]*$").alias("file"))


def with_starts(index: DataFrame) -> DataFrame:
    """index with start, the ids of all records before: running sums inside a file, and over one row per file."""
    at = file_order(F.col("file"))
    files = index.groupBy(at.alias("_f")).agg(F.sum("n_tokens").alias("_n"))
    files = files.select("_f", (F.sum("_n").over(W.orderBy("_f").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    inside = F.sum("n_tokens").over(W.partitionBy("_f").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens")
    return index.withColumn("_f", at).withColumn("_inside", inside).join(files, "_f").withColumn("start", F.col("_before") + F.col("_inside")).drop("_f", "_inside", "_before")


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    data, index = new_path(spark, "records"), new_path(spark, "record-index")
    write_records(docs, data, tokenizer_path())
    build_index(spark, data).write.parquet(index)
    return with_starts(spark.read.parquet(index)).select("doc_id", "start", "n_tokens", "ids_crc32")
