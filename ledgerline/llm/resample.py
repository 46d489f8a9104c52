"""Target-distribution importance resampling: documents drawn by how much likelier their n-grams are in a target corpus.

Features are runs of 1 to 3 consecutive words, hashed into `buckets` places by CRC-32. The features of both corpora are
counted whole; a place's gain compares its shares in them, with one added to each. The gains are an array that every task
holds; a document's weight is the sum of the gains at its features' places, looked up as arrays, and a Gumbel variable that
its id decides makes the highest scores a sample without replacement. Ranks come from a radix sort (radix.py) over score and id.

Features are not built as strings: the CRC of two joined strings follows from their CRCs and the second one's length, so a
batch's words are hashed once each and their runs by array look-ups."""

from __future__ import annotations

import hashlib
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.radix import ranked
from ledgerline.llm.tables import table

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Letters lower-cased, digits and bytes above 0x7F as they are, all else blank.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or bytes([b]) in [bytes([w]) for w in _WORD] else 32 for b in range(256))


@dataclass(frozen=True)
class ResampleConfig:
    buckets: int = 10_000
    longest: int = 3  # words of a feature
    least_words: int = 20  # of a document that can be drawn
    percent: int = 5
    seed: int = 42


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


# CRC-32 of joined strings -------------------------------------------------------------------------------------------

_JOINED = 64  # bytes of a second string that the tables reach to; longer ones are hashed by themselves


def _zero_tables() -> np.ndarray:
    """[n, k, b]: what n zero bytes make of byte b at place k of the register."""
    one = np.zeros((4, 256), np.uint32)
    step = np.zeros(256, np.uint32)
    for b in range(256):
        x = b
        for _ in range(8):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        step[b] = x
    out = np.zeros((_JOINED + 1, 4, 256), np.uint32)
    for k in range(4):
        one[k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    out[0] = one
    for n in range(1, _JOINED + 1):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ step[out[n - 1] & np.uint32(255)]
    return out


class Hasher:
    """CRC-32 of the word runs of documents."""

    KNOWN = 300_000

    def __init__(self, cfg: ResampleConfig):
        self.cfg, self.zeros = cfg, _zero_tables()
        self._clear()

    def _clear(self):
        self.code, self.word = {}, []
        self.alone, self.after, self.size = (np.zeros(self.KNOWN, t) for t in (np.uint32, np.uint32, np.int64))

    def _learn(self, new):
        if len(self.code) + len(new) > len(self.alone):
            grow = len(self.code) + len(new)
            self.alone, self.after, self.size = (np.concatenate([a, np.zeros(grow, a.dtype)]) for a in (self.alone, self.after, self.size))
        for w in new:
            i = self.code[w] = len(self.word)
            self.word.append(w)
            self.alone[i], self.after[i], self.size[i] = zlib.crc32(w), zlib.crc32(b" " + w), len(w) + 1

    def _join(self, first: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The CRC of a run and a blank and one more word."""
        n = self.size[code]
        long = np.flatnonzero(n > _JOINED)
        z, m = self.zeros, np.minimum(n, _JOINED)
        out = z[m, 0, first & 255] ^ z[m, 1, first >> 8 & 255] ^ z[m, 2, first >> 16 & 255] ^ z[m, 3, first >> 24] ^ self.after[code]
        for i in long:
            out[i] = zlib.crc32(b" " + self.word[code[i]], int(first[i]))
        return out

    def features(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The places of all features of the documents, and the document of each."""
        if len(self.code) > self.KNOWN:
            self._clear()
        self._learn(set().union(*docs) - self.code.keys() if docs else ())
        n = np.array([len(d) for d in docs], np.int64)
        code = np.fromiter((self.code[w] for d in docs for w in d), np.int64, int(n.sum()))
        owner = np.repeat(np.arange(len(docs)), n)
        run, at = self.alone[code], np.arange(len(code))
        places, owners = [run], [owner]
        for k in range(1, self.cfg.longest):
            if len(at) == 0:
                break
            go = (at + k < len(code)) & (owner[np.minimum(at + k, len(code) - 1)] == owner[at])
            at, run = at[go], run[go]
            run = self._join(run, code[at + k])
            places.append(run)
            owners.append(owner[at])
        return np.concatenate(places) % np.uint32(self.cfg.buckets), np.concatenate(owners)


def _batches(batch: pa.RecordBatch, most: int = 2_000_000):
    """Parts of a batch of so many words; a longer text is a part alone."""
    ids = batch.column("doc_id").to_pylist() if "doc_id" in batch.schema.names else [None] * batch.num_rows
    docs, part, size = [], [], 0
    for i, t in zip(ids, batch.column("text").to_pylist()):
        w = words_of(t)
        if size and size + len(w) > most:
            yield part, docs
            docs, part, size = [], [], 0
        docs.append(w)
        part.append(i)
        size += len(w)
    if docs:
        yield part, docs


def _count_task(cfg: ResampleConfig):
    def run(batches):
        h, n = Hasher(cfg), np.zeros(cfg.buckets, np.int64)
        for b in batches:
            for _, docs in _batches(b):
                n += np.bincount(h.features(docs)[0], minlength=cfg.buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(n[at])})

    return run


def bucket_counts(texts: DataFrame, cfg: ResampleConfig = ResampleConfig()) -> np.ndarray:
    """How often the features of all texts fall into each place. Each task sums its own; cfg.buckets numbers reach the driver."""
    rows = texts.select("text").mapInArrow(_count_task(cfg), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(cfg.buckets, np.int64)
    for r in rows.toLocalIterator():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of (share in the target / share in raw)) of each place, one added to each count."""
    b = len(raw)
    s_all, t_all = float(raw.sum() + b), float(target.sum() + b)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """floor(1000 x a Gumbel variable) that seed and id decide; a row without id takes the empty id's."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def _score_task(gain: np.ndarray, cfg: ResampleConfig):
    def run(batches):
        h = Hasher(cfg)
        for b in batches:
            for ids, docs in _batches(b):
                places, owner = h.features(docs)
                n = np.bincount(owner, minlength=len(docs))
                weight = np.zeros(len(docs), np.int64)
                np.add.at(weight, owner, gain[places])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(ids, pa.int64()),
                        "n_words": pa.array([len(d) for d in docs], pa.int64()),
                        "n_features": pa.array(n, pa.int64()),
                        "weight": pa.array(weight),
                        "score": pa.array(weight + np.array([gumbel(i, cfg.seed) for i in ids], np.int64)),
                    }
                )

    return run


def scored(docs: DataFrame, target: DataFrame, cfg: ResampleConfig = ResampleConfig()) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row of docs: how much its features speak for target against docs."""
    gain = gains(bucket_counts(docs, cfg), bucket_counts(target, cfg))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score_task(gain, cfg), SCORED)


def resample(docs: DataFrame, target: DataFrame, cfg: ResampleConfig = ResampleConfig()) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of docs: rank 1, 2, ... for the floor(percent / 100 x N) highest
    scores of the N rows with least_words words, null for the others. Ties go to the smaller doc_id, then to rows without
    one; rows that share an id and a score follow in some order. Null and empty texts have no features and weight 0; an empty
    target gives gains all the same, an empty docs no rows. Other columns are not looked at."""
    rows, _ = table(scored(docs, target, cfg), "resample")
    can = F.col("n_words") >= cfg.least_words
    n = rows.where(can).count()
    placed, _ = ranked(rows.where(can).withColumn("_down", -F.col("score")), ["_down", "doc_id"], "_rank")
    drawn = F.when(F.col("_rank") < cfg.percent * n // 100, F.col("_rank") + 1)
    names = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*names, drawn.cast("long").alias("rank")).unionByName(rows.where(~can).select(*names, F.lit(None).cast("long").alias("rank")))
