"""Token ids as files of length-delimited binary records, with an offset index beside them for shuffled reads.

Each document is one record: its payload (PAYLOAD, then the ids as little-endian integers of 2 or 4 bytes) is framed by its
length (8 bytes), the masked CRC-32C of these 8 bytes, and the masked CRC-32C of the payload behind it, so that a reader
finds the next record without decoding this one and sees every damaged byte. Documents are range-partitioned by id and
sorted inside their partition; each task encodes its documents and writes one file, batch by batch.

A file has a name of its own for every attempt of its task, and only the files that the index names count: the index is a
Parquet table that Spark commits as a whole, so lost executors, repeated and speculative tasks leave at most files that
nothing reads, and write() removes those it finds. Files are opened through pyarrow by the URI of the folder that the
cluster shares; records, ids and texts never reach the driver.

Encoding goes by pieces between blanks: no token and no rule of the tokenizer's normalisation spans a blank, so pieces are
encoded once each and remembered; `Encoder` says what that needs of a tokenizer."""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass
from functools import cache
from operator import add

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEAD = struct.Struct("<QI")  # payload bytes, their masked checksum
TAIL = struct.Struct("<I")  # masked checksum of the payload
PAYLOAD = struct.Struct("<qBBHI")  # document id (0 if it has none), 1 if it has one, bytes of an id, 0, ids

INDEX = "part int, file string, place long, doc_id long, offset long, length long, n_tokens long, before long"


@dataclass(frozen=True)
class RecordConfig:
    end: int = 2  # id that closes each document
    block: int = 4 << 20  # bytes of a file that one read task takes at a time
    task: int = 64 << 20  # bytes of records for each read task


# Checksums ----------------------------------------------------------------------------------------------------------

_POLY = 0x82F63B78  # Castagnoli, reflected
_WIDTH = 64  # bytes of a block: all blocks of a batch go through the tables side by side


def _columns(zeros: int) -> list[int]:
    """The effect of `zeros` zero bytes on each bit of the register."""
    out = []
    for bit in range(32):
        x = 1 << bit
        for _ in range(8 * zeros):
            x = (x >> 1) ^ (_POLY if x & 1 else 0)
        out.append(x)
    return out


def _apply(columns: list[int], x: int) -> int:
    out = 0
    for bit in range(32):
        if x >> bit & 1:
            out ^= columns[bit]
    return out


def _tables(columns: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The same for the low and the high half of the register at once."""
    halves = []
    for at in (0, 16):
        t = np.zeros(1, np.uint32)
        for bit in range(16):
            t = np.concatenate([t, t ^ np.uint32(columns[at + bit])])
        halves.append(t)
    return halves[0], halves[1]


@cache
def _word_tables() -> tuple[np.ndarray, np.ndarray]:
    return _tables(_columns(4))


@cache
def _shift_columns(level: int) -> tuple[int, ...]:
    if level == 0:
        return tuple(_columns(_WIDTH))
    half = list(_shift_columns(level - 1))
    return tuple(_apply(half, x) for x in half)


@cache
def _shift_tables(level: int) -> tuple[np.ndarray, np.ndarray]:
    """_WIDTH * 2^level zero bytes."""
    return _tables(list(_shift_columns(level)))


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each of the byte strings, of 4 bytes at least."""
    if not parts:
        return np.zeros(0, np.uint32)
    fill = [-len(p) % _WIDTH for p in parts]  # zeros in front of a message do not change the register while it is zero
    padded = []
    for p, n in zip(parts, fill):
        padded += (bytes(n), p) if n else (p,)
    raw = np.frombuffer(bytearray(b"".join(padded)), np.uint8)
    n = np.array([(len(p) + f) // _WIDTH for p, f in zip(parts, fill)], np.int64)
    first = np.cumsum(n) - n
    start = first * _WIDTH + np.array(fill, np.int64)
    for k in range(4):
        raw[start + k] ^= 0xFF  # a register of ones
    words = np.ascontiguousarray(raw.view("<u4").reshape(-1, _WIDTH // 4).T)
    low, high = _word_tables()
    x = np.zeros(words.shape[1], np.uint32)
    for w in words:
        x ^= w
        x = low[x & np.uint32(0xFFFF)] ^ high[x >> np.uint32(16)]
    level = 0
    while (n > 1).any():  # neighbours join in pairs until each message is one block
        low, high = _shift_tables(level)
        odd = n & 1
        first = np.cumsum(n + odd) - (n + odd)
        grown = np.zeros(int((n + odd).sum()), np.uint32)
        owner = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        grown[first[owner] + odd[owner] + within] = x
        left = grown[0::2]
        x = low[left & np.uint32(0xFFFF)] ^ high[left >> np.uint32(16)] ^ grown[1::2]
        n, level = (n + odd) // 2, level + 1
    return x ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """The checksum as it is stored, so that checksums of data that hold checksums stay telling."""
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(0xA282EAD8)


# Tokens -------------------------------------------------------------------------------------------------------------


class Encoder:
    """ids of texts by a tokenizer of the tokenizers library, given as its JSON.

    Texts are parted at blanks, tabs and line ends. That is exact for tokenizers that drop white space and whose
    normalisation, pattern and special tokens do not look across it, as a vocabulary with word ends has it; others take
    `whole`. Pieces of up to PIECE characters are kept as their ids, KNOWN of them at most; longer ones are encoded anew.

    Most new pieces are a word of Latin letters, perhaps with marks behind it. New words are encoded together, many in a
    text; the ids that stand at a word's end part them again. Where there are more or fewer of these ends than words, each
    is encoded alone."""

    PIECE, KNOWN = 100, 800_000
    #: Letters that stay one letter when they are normalised and lower-cased, and marks that then stand for themselves.
    PLAIN = re.compile("([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]{1,60})([.,;:!?]{0,3})")

    def __init__(self, spec: str, whole: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer, self.whole = Tokenizer.from_str(spec), whole
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        suffix = json.loads(spec)["model"].get("end_of_word_suffix")
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
            for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
                self.ends[i] = token.endswith(suffix)
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[str], together: int = 500) -> None:
        groups = [words[k : k + together] for k in range(0, len(words), together)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            to = (np.flatnonzero(self.ends[ids]) + 1) * self.width
            if len(to) != len(group):
                self.words.update(zip(group, self._ids(group)))
                continue
            raw, at = ids.tobytes(), 0
            for w, k in zip(group, to.tolist()):
                self.words[w] = raw[at:k]
                at = k

    def _learn(self, new: list[str]) -> None:
        words, pieces = self.words, self.pieces
        if len(words) > self.KNOWN:
            words.clear()
        other = new
        if self.ends is not None:
            other, plain, low, marks = [], [], [], []
            for p in new:
                m = self.PLAIN.fullmatch(p)
                if m is None:
                    other.append(p)
                else:
                    plain.append(p)
                    low.append(m[1].lower())
                    marks.append(m[2])
            self._learn_words(list(set(low) - words.keys()))
            kinds = list(set(marks))
            behind = dict(zip(kinds, self._ids(kinds)))
            pieces.update(zip(plain, map(add, map(words.__getitem__, low), map(behind.__getitem__, marks))))
        for k in range(0, len(other), 20_000):
            pieces.update(zip(other[k : k + 20_000], self._ids(other[k : k + 20_000])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, `width` bytes each."""
        if self.whole:
            return self._ids(texts)
        if len(self.pieces) > self.KNOWN:
            self.pieces.clear()
        parts = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        new = list(set().union(*parts) - self.pieces.keys())
        self._learn(new)
        out = [b"".join(map(self.pieces.__getitem__, p)) for p in parts]
        for p in new:
            if len(p) > self.PIECE:
                del self.pieces[p]
        return out


@cache
def encoder(spec: str, whole: bool = False) -> Encoder:
    """One for each worker: reading the vocabulary takes longer than a small task."""
    return Encoder(spec, whole)


# Writing ------------------------------------------------------------------------------------------------------------

_SLICE = 8 << 20  # characters that are encoded and written at once


def frames(ids: list[bytes], doc_ids: list[int | None], width: int) -> list[bytes]:
    payloads = [PAYLOAD.pack(d or 0, d is not None, width, 0, len(x) // width) + x for d, x in zip(doc_ids, ids)]
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    heads, tails = masked(crc32c(lengths)).tolist(), masked(crc32c(payloads)).tolist()
    return [b"".join((n, TAIL.pack(h), p, TAIL.pack(t))) for n, h, p, t in zip(lengths, heads, payloads, tails)]


def _slices(batch: pa.RecordBatch):
    texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size > _SLICE or k == len(texts) - 1:
            yield texts[at : k + 1], ids[at : k + 1]
            at, size = k + 1, 0


def _write_task(uri: str, spec: str, end: int, whole: bool):
    def run(batches):
        part = TaskContext.get().partitionId()
        name, enc, out = f"{part:08d}-{uuid.uuid4().hex}.records", encoder(spec, whole), None
        close, place, offset, before = end.to_bytes(enc.width, "little"), 0, 0, 0
        store, folder = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for texts, doc_ids in _slices(batch):
                ids = [x + close for x in enc.encode(texts)]
                made = frames(ids, doc_ids, enc.width)
                if out is None:
                    out = store.open_output_stream(f"{folder}/{name}")
                out.write(b"".join(made))
                length = np.array([len(f) for f in made], np.int64)
                n = np.array([len(x) // enc.width for x in ids], np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(np.full(len(n), part, np.int32)),
                        "file": pa.array([name] * len(n)),
                        "place": pa.array(place + np.arange(len(n))),
                        "doc_id": pa.array(doc_ids, pa.int64()),
                        "offset": pa.array(offset + np.cumsum(length) - length),
                        "length": pa.array(length),
                        "n_tokens": pa.array(n),
                        "before": pa.array(before + np.cumsum(n) - n),
                    }
                )
                place, offset, before = place + len(n), offset + int(length.sum()), before + int(n.sum())
        if out is not None:
            out.close()

    return run


def write(docs: DataFrame, uri: str, spec: str, cfg: RecordConfig = RecordConfig(), whole: bool = False) -> DataFrame:
    """Encodes docs (doc_id, text; other columns are not looked at) with the tokenizer's JSON `spec`, writes the files to
    `uri`/data in ascending order of doc_id and the index to `uri`/index, and returns the index: for each row of docs its
    file, place in it, byte offset and length of the record, ids, and ids before it in the file; files come in the order of
    `part`. Rows without id come first, null texts are empty, rows that share an id follow each other by a hash of the text.
    An empty table gives an empty index. docs should be a table: a row's number in it parts rows that are alike."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = ["doc_id", "_hash", "_row"]
    store, folder = fs.FileSystem.from_uri(uri)
    store.create_dir(f"{folder}/data", recursive=True)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(_write_task(f"{uri}/data", spec, cfg.end, whole), INDEX).write.parquet(f"{uri}/index")
    index = open_index(spark, uri)
    counted = {r.file for r in index.select("file").distinct().toLocalIterator()}
    for f in store.get_file_info(fs.FileSelector(f"{folder}/data")):
        if f.base_name.endswith(".records") and f.base_name not in counted:
            store.delete_file(f.path)  # of an attempt that did not count
    return index


def open_index(spark: SparkSession, uri: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{uri}/index")


# Reading ------------------------------------------------------------------------------------------------------------


def parse(data: bytes, name: str = "") -> list[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each record of data, which begins and ends with a record. Raises ValueError on damage."""
    lengths, heads, payloads, tails, at, end = [], [], [], [], 0, len(data)
    while at < end:
        n, head = HEAD.unpack_from(data, at) if at + HEAD.size <= end else (end, 0)
        lengths.append(data[at : at + 8])
        heads.append(head)
        if at + HEAD.size + n + TAIL.size > end:
            break
        payloads.append(data[at + HEAD.size : at + HEAD.size + n])
        tails.append(TAIL.unpack_from(data, at + HEAD.size + n)[0])
        at += HEAD.size + n + TAIL.size
    whole = len(payloads)
    for what, parts, sums in (("length", lengths[:whole], heads[:whole]), ("record", payloads, tails)):  # lengths first: a wrong one misplaces what follows
        wrong = np.flatnonzero(masked(crc32c(parts)) != np.array(sums, np.uint32))
        if len(wrong):
            raise ValueError(f"{name}: damaged {what} {wrong[0]} of {whole}")
    if at < end:
        raise ValueError(f"{name}: cut off or damaged behind record {whole}")
    out = []
    for p in payloads:
        doc_id, known, width, _, n = PAYLOAD.unpack_from(p)
        out.append((doc_id if known else None, np.frombuffer(p, f"<u{width}", n, PAYLOAD.size)))
    return out


def _spans(uri: str, batches):
    """The rows of the batches with the bytes that they point to; a file stays open while rows of it follow each other."""
    store, folder = fs.FileSystem.from_uri(uri)
    name = source = None
    for batch in batches:
        for r in batch.to_pylist():
            if r["file"] != name:
                if source is not None:
                    source.close()
                name, source = r["file"], store.open_input_file(f"{folder}/{r['file']}")
            yield r, source.read_at(r["length"], r["offset"])
    if source is not None:
        source.close()


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read_task(uri: str):
    def run(batches):
        for r, data in _spans(uri, batches):
            found, start = parse(data, r["file"]), r["start"]
            n = np.array([len(ids) for _, ids in found], np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([d for d, _ in found], pa.int64()),
                    "start": pa.array(start + np.cumsum(n) - n),
                    "n_tokens": pa.array(n),
                    "ids_crc32": pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in found], pa.int64()),
                }
            )

    return run


def _spread(df: DataFrame, total: int, cfg: RecordConfig, *by: str) -> DataFrame:
    """As many partitions as the bytes that the rows point to need, however small the rows are."""
    return df.repartition(max(1, -(-total // cfg.task), min(64, total >> 20)), *by)


def read(spark: SparkSession, uri: str, cfg: RecordConfig = RecordConfig()) -> DataFrame:
    """doc_id, start (ids of all records before it, over all files), n_tokens and ids_crc32 of each record, read back from
    the files in blocks and checked. The index says where blocks begin; what is returned comes from the records."""
    index = open_index(spark, uri)
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("_n"))  # a row for each file
    before = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_base"))
    block = F.floor(F.col("offset") / cfg.block).cast("long").alias("block")
    blocks = index.groupBy("part", "file", block).agg(
        F.min("offset").alias("offset"), F.sum("length").alias("length"), F.min("before").alias("_before")
    )
    blocks = blocks.join(before, "part").select("file", "block", "offset", "length", (F.col("_base") + F.col("_before")).alias("start"))
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return _spread(blocks, total, cfg, "file", "block").mapInArrow(_read_task(f"{uri}/data"), READ)


def _shuffled_task(uri: str):
    def run(batches):
        for r, data in _spans(uri, batches):
            ((doc_id, ids),) = parse(data, r["file"])
            yield pa.RecordBatch.from_pydict({"at": pa.array([r["at"]], pa.int64()), "doc_id": pa.array([doc_id], pa.int64()), "ids": pa.array([ids.astype(np.int64)])})

    return run


def shuffled(spark: SparkSession, uri: str, seed: int, cfg: RecordConfig = RecordConfig()) -> DataFrame:
    """at, doc_id and ids of every record in an order that seed alone decides: by `at`, ascending through the partitions.
    Only the index is shuffled; each record is then read by its offset."""
    index = open_index(spark, uri)
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    order = ["at", "part", "place"]
    dealt = index.withColumn("at", F.xxhash64(F.lit(seed), "part", "place")).repartitionByRange(max(1, -(-total // cfg.task)), *order)
    return dealt.sortWithinPartitions(*order).mapInArrow(_shuffled_task(f"{uri}/data"), "at long, doc_id long, ids array<long>")
