"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes.

Both tokenizers cut the bytes of a blank and the text. Offsets at which tokens
of both end cut the tokens into groups, and each pair of tokens of a group is a
link. A pair of ids counts the documents that hold it linked.

Counts meet by cogrouped postings. A task gathers some MB of texts and writes,
for each id pair, one posting with the documents that hold it and how often.
The postings are shuffled by the A id beside the pair's counts from all tasks,
and Spark's sort, which spills, puts an id's counts before its postings; so a
stream knows each count and the id's highest before the first posting comes,
and adds up what its postings give to the documents of their batches. These sums
travel as a row for each batch and stream, and meet in a stream sorted by batch;
a document meets at most as many streams as it has A ids. An id
with many postings is dealt to several streams, each with the id's counts: they
are no more than the ids of the other tokenizer, whatever the table.

Defined cases: a null or empty text, and one that either tokenizer doesn't give
back byte by byte, has no tokens: zeros and an empty digest; rows are documents,
so repeated rows and ids each have a row and count each; a null doc_id keeps its
row; a text of any length is cut whole; an empty table gives no rows. Only
doc_id and text are read, so other columns never clash.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, small_batches, stored
from .token_records import Encoder, tokenizer_path

A_TOKENIZER, B_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A batch ends with the text that passes so many bytes, or at so many documents (an ordinal takes two bytes).
BATCH_BYTES = 4 << 20
BATCH_ROWS = 1 << 14
#: Links made at a time; a group of more distinct pairs is cut by its A ids.
LINKS = 1 << 20
#: Entries of one A id that go to one stream.
STREAM_ENTRIES = 1 << 22
#: Sums of documents that a stream holds before it hands them on.
HELD_ROWS = 1 << 20
_ORDINAL_BITS = 16

_DDL = "batch long, ordinal int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, b int, entries long, docs binary, times binary"
_NAMES = [x.split()[0] for x in _DDL.split(", ")]


class Tokenizers:
    """Both tokenizers, with the bytes of each id. Strings of special tokens are plain text."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.encode = Encoder(a_path)
        self.encode.tokenizer.encode_special_tokens = True
        self.encode.added = []
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: k for k, c in _byte_letters().items()}
        size = self.encode.tokenizer.get_vocab_size(with_added_tokens=True)
        words = [self.encode.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(byte_of[c] for c in w) if all(c in byte_of for c in w) else w.encode() for w in words]
        self.b_bytes = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # the ids as text, with each of the marks that may follow
        self.text = [f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.ids = len(self.text) // 4

    def _piece(self, i: int) -> bytes:
        p = self.pieces.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode()

    def cut(self, text: str | None, pieces: list[int] | None) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both sides, or None if a side doesn't give back the blank and the text."""
        if not text:
            return None
        want = f" {text}".encode()
        a = np.frombuffer(self.encode(f" {text}"), f"<u{2 if self.encode.kind == 'H' else 4}")
        if b"".join(map(self.b_bytes.__getitem__, pieces)) != want or b"".join(map(self.a_bytes.__getitem__, a.tolist())) != want:
            return None
        return a.astype(np.int64), np.array(pieces, np.int64)


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: bytes that print stand for themselves, the others for the letters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [k for k in range(256) if k not in own]
    return {k: chr(k) for k in own} | {k: chr(256 + i) for i, k in enumerate(rest)}


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """One per Python worker."""
    return Tokenizers(a_path, b_path)


def groups_of(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group of each token of either side, and the byte at which each group ends; both sides end together."""
    common = np.intersect1d(end_a, end_b, assume_unique=True)
    return np.searchsorted(common, end_a), np.searchsorted(common, end_b), common


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def link_keys(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, doc: np.ndarray, b_bits: int, most: int = LINKS) -> tuple[np.ndarray, np.ndarray]:
    """(a, b, document) of every link as sorted distinct numbers, and how many links each has. doc: the document of each group.

    Equal tokens of one side of a group become one first; so a group makes its
    distinct pairs, about most of them at a time.
    """
    one_a, times_a = np.unique(group_a << 32 | a, return_counts=True)
    one_b, times_b = np.unique(group_b << 32 | b, return_counts=True)
    ga, gb = one_a >> 32, one_b >> 32
    size_b = np.bincount(gb, minlength=len(doc))
    first_b = np.cumsum(size_b) - size_b
    many = size_b[ga]
    keys, times = [], []
    turn = (np.cumsum(many) - many) // most
    for k in np.unique(turn):
        s = slice(*np.searchsorted(turn, [k, k + 1]))
        at_b, at_a = _ranges(first_b[ga[s]], many[s]), np.repeat(np.arange(s.start, s.stop), many[s])
        key = ((one_a[at_a] & 0xFFFFFFFF) << b_bits | (one_b[at_b] & 0xFFFFFFFF)) << _ORDINAL_BITS | doc[ga[at_a]]
        got, where = np.unique(key, return_inverse=True)
        keys.append(got)
        times.append(np.bincount(where, times_a[at_a] * times_b[at_b]).astype(np.int64))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(keys) == 1:
        return keys[0], times[0]
    got, where = np.unique(np.concatenate(keys), return_inverse=True)
    return got, np.bincount(where, np.concatenate(times)).astype(np.int64)


def _texts_of(t: Tokenizers, a, b, group_a, group_b, n_groups, doc, n_docs):
    """For each document its groups as text: ids joined by commas, a bar between the sides, semicolons between groups."""
    in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    code = np.empty(len(a) + len(b), np.int64)
    place_a, place_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + (before_a + in_a)[group_b]
    code[place_a], code[place_b] = a, b
    code[place_a[np.cumsum(in_a) - 1]] += t.ids  # the last A of a group
    ends = place_b[np.cumsum(in_b) - 1]
    code[ends] += 2 * t.ids
    last = np.r_[doc[1:] != doc[:-1], True]
    code[ends[last]] += t.ids  # nothing follows the last group of a document
    stop = np.zeros(n_docs, np.int64)
    stop[doc[last]] = ends[last] + 1
    words, at = list(map(t.text.__getitem__, code.tolist())), 0
    for k in range(n_docs):
        yield "".join(words[at : stop[k]]) if stop[k] else ""
        at = max(at, int(stop[k]))


def _batch(t: Tokenizers, number: int, ids: list, texts: list):
    """The record batches of some documents: a row for each, then the postings of their pairs."""
    found = [t.cut(x, p) for x, p in zip(texts, t.pieces.encode([x or "" for x in texts], num_threads=1), strict=True)]
    n = len(texts)
    some = [k for k, x in enumerate(found) if x]
    n_a, n_b, n_groups, n_links = np.zeros((4, n), np.int64)
    digest = [""] * n
    keys, times, bits = np.zeros(0, np.int64), np.zeros(0, np.int64), int(len(t.b_bytes) - 1).bit_length()
    if some:
        a, b = (np.concatenate([found[k][side] for k in some]) for side in (0, 1))
        n_a[some], n_b[some] = ([len(found[k][side]) for k in some] for side in (0, 1))
        group_a, group_b, common = groups_of(np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b]))
        doc = np.zeros(len(common), np.int64)
        doc[group_a] = np.repeat(np.arange(n), n_a)
        n_groups = np.bincount(doc, minlength=n)
        links = np.bincount(group_a, minlength=len(common)) * np.bincount(group_b, minlength=len(common))
        n_links = np.bincount(doc, links, n).astype(np.int64)
        digest = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in _texts_of(t, a, b, group_a, group_b, len(common), doc, n)]
        keys, times = link_keys(a, b, group_a, group_b, doc, bits)
    long = lambda x: pa.array(x, pa.int64())
    none = lambda kind: pa.nulls(n, kind)
    yield pa.RecordBatch.from_arrays([long(np.full(n, number)), pa.array(np.arange(n), pa.int32()), pa.array(ids, pa.int64()), long(n_a), long(n_b), long(n_groups), long(n_links), pa.array(digest, pa.string()), none(pa.int32()), none(pa.int32()), none(pa.int64()), none(pa.binary()), none(pa.binary())], names=_NAMES)
    if len(keys):
        pair = keys >> _ORDINAL_BITS
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        ends = np.r_[first, len(keys)]
        width = 1 if times.max() < 1 << 8 else 4
        lists = [_lists(ends, (keys & (1 << _ORDINAL_BITS) - 1).astype("<u2")), _lists(ends, times.astype(f"<u{width}"))]
        m, pair = len(first), pair[first]
        none = lambda kind: pa.nulls(m, kind)
        columns = [long(np.full(m, number)), none(pa.int32()), *(none(pa.int64()) for _ in range(5)), none(pa.string())]
        columns += [pa.array(pair >> bits, pa.int32()), pa.array(pair & (1 << bits) - 1, pa.int32()), long(np.diff(ends)), *lists]
        yield pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """Slices of an array of numbers as binary values."""
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _aligned(a_path: str, b_path: str, batch_bytes: int):
    def run(batches):
        t = tokenizers(a_path, b_path)
        number, size, ids, texts = TaskContext.get().partitionId() << 32, 0, [], []
        for b in batches:
            for i, x in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                x = x.as_py()
                ids.append(i)
                texts.append(x)
                size += len(x.encode()) if x else 0
                if size >= batch_bytes or len(ids) == BATCH_ROWS:
                    yield from _batch(t, number, ids, texts)
                    number, size, ids, texts = number + 1, 0, [], []
        if ids:
            yield from _batch(t, number, ids, texts)

    return run


def _flat(column, kind: str) -> np.ndarray:
    """The bytes of all values of a binary column as numbers."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]].view(kind) if len(offsets) else np.zeros(0, kind)


class _Held:
    """Sums of documents by batch and ordinal, to be handed on once there are more than most."""

    def __init__(self, most: int):
        self.of: dict[int, np.ndarray] = {}
        self.rows, self.most = 0, most

    def add(self, batch, docs, best, counts):
        """batch, docs: of each entry."""
        starts = np.flatnonzero(np.r_[True, batch[1:] != batch[:-1]])
        for i, j in zip(starts, np.r_[starts[1:], len(batch)], strict=True):
            k = int(batch[i])
            top = int(docs[i:j].max()) + 1
            have = self.of.get(k)
            if have is None or have.shape[1] < top:
                new = np.zeros((2, max(top, 256, 2 * (0 if have is None else have.shape[1]))), np.int64)
                if have is not None:
                    new[:, : have.shape[1]] = have
                self.rows += new.shape[1] - (0 if have is None else have.shape[1])
                self.of[k] = have = new
            # sums as whole numbers: doubles would round beyond 2^53
            np.add.at(have[0], docs[i:j], best[i:j])
            np.add.at(have[1], docs[i:j], counts[i:j])

    def flush(self):
        """A row for each batch: its documents that have sums, and these."""
        rows = []
        for k, have in self.of.items():
            some = np.flatnonzero(have[1])
            width = 4 if have[:, some].max(initial=0) < 1 << 32 else 8
            rows.append((k, some.astype("<u2").tobytes(), *(x[some].astype(f"<u{width}").tobytes() for x in have)))
        self.of, self.rows = {}, 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 3), strict=True)], names=["batch", "docs", "best", "sums"])


def _streams(held_rows: int):
    def run(batches):
        """What the postings of a sorted stream (a, salt, counts before postings) give to the documents of their batches."""
        held, now = _Held(held_rows), None
        known_b, known = [], []
        for r in batches:
            group = np.asarray(r.column("a")).astype(np.int64) << 32 | np.asarray(r.column("salt")).astype(np.int64)
            kind, b, total = (np.asarray(r.column(c)) for c in ("kind", "b", "total"))
            edges = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (kind[1:] != kind[:-1])])
            for i, j in zip(edges, np.r_[edges[1:], len(group)], strict=True):
                if group[i] != now:
                    now, known_b, known = group[i], [], []
                if kind[i] == 0:
                    known_b.append(b[i:j])
                    known.append(total[i:j])
                    continue
                if len(known) > 1:
                    known_b, known = [np.concatenate(known_b)], [np.concatenate(known)]
                count = known[0][np.searchsorted(known_b[0], b[i:j])]
                best = count == known[0].max()
                some = r.slice(i, j - i)
                entries = np.asarray(some.column("entries"))
                docs, width = _flat(some.column("docs"), "<u2"), np.asarray(pc.binary_length(some.column("times"))) // entries
                batch = np.asarray(some.column("batch"))
                for w in np.unique(width):
                    rows = width == w
                    pick = np.repeat(rows, entries)
                    times = _flat(some.column("times").filter(pa.array(rows)), f"<u{w}").astype(np.int64)
                    order = np.argsort(np.repeat(batch[rows], entries[rows]), kind="stable")
                    each = lambda x: np.repeat(x[rows], entries[rows])  # noqa: E731, B023
                    held.add(each(batch)[order], docs[pick][order], (times * each(best))[order], (times * each(count))[order])
                if held.rows > held.most:
                    yield from held.flush()
        yield from held.flush()

    return run


def _summed(batches):
    """n_best and count_sum of each document, from a stream of flushed rows sorted by batch: one batch's sums are held."""
    now, have = None, np.zeros((2, 1 << _ORDINAL_BITS), np.int64)

    def told():
        some = np.flatnonzero(have[1])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), now), pa.int64()), pa.array(some, pa.int32()), pa.array(have[0][some], pa.int64()), pa.array(have[1][some], pa.int64())], names=["batch", "ordinal", "n_best", "count_sum"])

    for r in batches:
        for k, docs, best, sums in zip(*(r.column(c) for c in ("batch", "docs", "best", "sums")), strict=True):
            if k.as_py() != now:
                if now is not None:
                    yield told()
                now = k.as_py()
                have[:] = 0
            at = np.frombuffer(docs.as_buffer(), "<u2")
            for i, x in enumerate((best, sums)):
                have[i][at] += np.frombuffer(x.as_buffer(), f"<u{len(x.as_buffer()) // len(at)}").astype(np.int64)
    if now is not None:
        yield told()


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, batch_bytes: int = BATCH_BYTES, stream_entries: int = STREAM_ENTRIES, held_rows: int = HELD_ROWS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    a_path, b_path = a_path or tokenizer_path(A_TOKENIZER), b_path or tokenizer_path(B_TOKENIZER)
    small_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got, path = stored(d.mapInArrow(_aligned(a_path, b_path, batch_bytes), _DDL), "alignment")
    rows = got.where("ordinal is not null").select("batch", "ordinal", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    postings = got.where("a is not null").select("a", "b", "batch", "entries", "docs", "times")
    counts, counts_path = stored(postings.groupBy("a", "b").agg(F.sum("entries").alias("total")), "pair-counts")
    # a row per A id: no more than its vocabulary
    salts = counts.groupBy("a").agg(F.ceil(F.sum("total") / stream_entries).cast("int").alias("salts"))
    salts, salts_path = stored(salts.where("salts > 1"), "alignment-salts")
    salted = lambda df: df.join(F.broadcast(salts), "a", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    known = salted(counts).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "b", "total", F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("entries"), none("binary", "docs"), none("binary", "times"))
    held = salted(postings).select("a", F.pmod(F.xxhash64("batch"), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), "b", F.lit(0).cast("long").alias("total"), "batch", "entries", "docs", "times")
    streams = known.unionByName(held).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind", "b")
    given = streams.mapInArrow(_streams(held_rows), "batch long, docs binary, best binary, sums binary")
    sums = given.repartition("batch").sortWithinPartitions("batch").mapInArrow(_summed, "batch long, ordinal int, n_best long, count_sum long")
    sums, sums_path = stored(sums, "alignment-sums")
    discard(counts_path, salts_path)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(sums, ["batch", "ordinal"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
