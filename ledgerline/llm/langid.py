"""Language identification by prediction by partial matching.

For each language a context tree of bytes, up to `order` bytes deep, is grown from a bounded sample; contexts seen less
than `least` times are pruned, so depth varies. In a context, a byte seen n times of N, among t distinct ones, has
probability n / (N + t); the escape t / (N + t) is shared out by the next shorter context over the bytes not seen here
(exclusion). The shortest context escapes to all 256 bytes alike. Statistics are frozen, every distribution sums to one, and
a text's exact code length in each language is a sum over its bytes. The shortest code wins; the score is its posterior
at even priors.

The trees are flattened to one table for each depth: a code length in each language for every byte that some language
saw in a context, and for every context the cost of its escape, after which the byte is looked up in the next shorter
context. No byte and no context is left out, so the lengths are those of the trees. Tasks look them up in numpy. One
pass over the texts, no shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.tables import crc_mod

LETTER = re.compile(r"[^\W\d_]")
PIECE = 1 << 20


@dataclass(frozen=True)
class PpmConfig:
    order: int = 3  # at most 3: a context and its byte fit into 32 bits
    sample_bytes: int = 2_000_000  # expected bytes of text learnt for each language
    least: int = 4


def padded(text: str | None, order: int) -> np.ndarray:
    return np.frombuffer(b"\n" * order + (text or "").encode("utf-8", "surrogatepass"), np.uint8)


def keys(b: np.ndarray, order: int) -> np.ndarray:
    """The (order + 1)-grams of b, big-endian."""
    k = b[: len(b) - order].astype(np.uint32)
    for i in range(1, order + 1):
        k = (k << np.uint32(8)) | b[i : len(b) - order + i]
    return k


def _count_task(order: int):
    def run(batches):
        held: dict[str, list[np.ndarray]] = {}

        def out():
            for lang, parts in held.items():
                k, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(k), pa.string()), "gram": pa.array(k, pa.int64()), "n": pa.array(n, pa.int64())})

        size = 0
        for b in batches:
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                held.setdefault(lang, []).append(keys(padded(t, order), order))
                size += len(t or "")
                if size > 4_000_000:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    return run


@dataclass
class Depth:
    """The contexts of one depth, ascending, and what they know. Entry e of context contexts[of[e]] is the byte byte[e]."""

    contexts: np.ndarray
    escape: np.ndarray  # context x language, nats
    of: np.ndarray
    byte: np.ndarray
    codes: np.ndarray  # entry x language, nats


@dataclass
class PpmModel:
    cfg: PpmConfig
    langs: list[str]
    depths: list[Depth]


def distributions(grams: dict[int, int], cfg: PpmConfig, contexts: np.ndarray) -> np.ndarray:
    """P(byte | context), rows for contexts (packed, order bytes), of one language with (order + 1)-gram counts `grams`."""
    g = np.fromiter(grams, np.int64, len(grams))
    return _distributions(g, np.fromiter(grams.values(), np.int64, len(grams)).astype(np.float64), cfg.order, cfg.least, contexts)[0]


def _distributions(g: np.ndarray, n: np.ndarray, order: int, least: int, contexts: np.ndarray):
    """P(byte | context), the bytes seen in the context, and the factor that an escape puts before the shorter context."""
    lower, lower_keys = np.full((1, 256), 1 / 256), np.zeros(1, np.int64)  # below order 0: all bytes alike
    for k in range(order + 1):
        ctx, byte = (g >> 8) & ((1 << (8 * k)) - 1), g & 255
        # the contexts of depth k that are wanted: the ends of the deepest ones
        want = np.unique(contexts & ((1 << (8 * k)) - 1))
        counts = np.zeros((len(want), 256))
        at = np.searchsorted(want, ctx)
        ok = (at < len(want)) & (want[np.minimum(at, len(want) - 1)] == ctx)
        np.add.at(counts, (at[ok], byte[ok]), n[ok])
        total = counts.sum(1, keepdims=True)
        if k:
            counts[(total < least).ravel()] = 0  # pruned: all its mass escapes
            total = counts.sum(1, keepdims=True)
        below = lower[np.searchsorted(lower_keys, want & ((1 << (8 * max(k - 1, 0))) - 1))] if k else np.repeat(lower, len(want), 0)
        seen = counts > 0
        distinct = seen.sum(1, keepdims=True)
        rest = np.where(seen, 0, below)
        left = rest.sum(1, keepdims=True)
        escape = np.where(left > 0, distinct / np.maximum(total + distinct, 1), 0)
        escape = np.where(total > 0, escape, 1)
        factor = escape / np.where(left > 0, left, 1)
        p = np.where(left > 0, counts / np.maximum(total + distinct, 1), counts / np.maximum(total, 1)) + factor * rest
        lower, lower_keys = p, want
    back = np.searchsorted(lower_keys, contexts)
    return lower[back], seen[back], factor[back]


def fit(train: DataFrame, cfg: PpmConfig = PpmConfig()) -> PpmModel:
    """train: doc_id, text, lang. Rows are drawn by a hash of the id so that each language has about sample_bytes; the
    collected counts are bounded by that sample. Null languages and texts teach nothing; without any other the model is
    empty. Rows that share an id are drawn together, each teaches."""
    train = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    size = {r.lang: r.n for r in train.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}  # a row for each language
    if not size:
        return PpmModel(cfg, [], [])
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)).cast("double") / (1 << 30)
    share = F.lit(1.0)
    for lang, n in size.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, cfg.sample_bytes / max(n, 1)))).otherwise(share)
    counts = train.where(draw < share).select("lang", "text").mapInArrow(_count_task(cfg.order), "lang string, gram long, n long")
    rows = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    grams = {k: (v["gram"].to_numpy(np.int64), v["n"].to_numpy(np.float64)) for k, v in rows.groupby("lang")}
    return flattened({k: grams.get(k, (np.zeros(0, np.int64), np.zeros(0))) for k in sorted(size)}, cfg)


def flattened(grams: dict[str, tuple[np.ndarray, np.ndarray]], cfg: PpmConfig) -> PpmModel:
    """The trees of languages with these (order + 1)-grams and their counts, as tables."""
    depths = []
    for k in range(cfg.order + 1):
        kept = [np.zeros(1, np.int64)] if k == 0 else []
        for g, n in grams.values() if k else ():
            ctx, back = np.unique((g >> 8) & ((1 << (8 * k)) - 1), return_inverse=True)
            kept.append(ctx[np.bincount(back, n, len(ctx)) >= cfg.least])
        contexts = np.unique(np.concatenate(kept))
        escape, of, byte, codes = [], [], [], []
        for at in range(0, len(contexts), 2048):  # in pieces, as the distributions are dense
            part = contexts[at : at + 2048]
            got = [_distributions(g & ((1 << (8 * (k + 1))) - 1), n, k, cfg.least, part) for g, n in grams.values()]
            e, b = np.nonzero(np.logical_or.reduce([seen for _, seen, _ in got]))
            of.append(e + at)
            byte.append(b)
            codes.append(np.stack([-np.log(p[e, b]) for p, _, _ in got], 1).astype(np.float32))
            escape.append(np.concatenate([-np.log(np.maximum(f, 1e-300)) for _, _, f in got], 1).astype(np.float32))
        m = len(grams)
        empty = np.zeros((0, m), np.float32)
        depths.append(Depth(contexts, np.concatenate([empty, *escape]), np.concatenate([np.zeros(0, np.int64), *of]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *byte]).astype(np.uint8), np.concatenate([empty, *codes])))
    return PpmModel(cfg, list(grams), depths)


class Lookup:
    """The tables as a task uses them: a row for every possible context (0 where it is not known), an entry for each byte
    (0 where it was not seen)."""

    def __init__(self, model: PpmModel):
        self.model, self.levels = model, []
        for k, d in enumerate(model.depths):
            row = np.zeros(1 << (8 * k), np.int32)
            row[d.contexts] = np.arange(1, len(d.contexts) + 1)
            entry = np.zeros((len(d.contexts) + 1, 256), np.int32)
            entry[d.of + 1, d.byte] = np.arange(1, len(d.of) + 1)
            pad = np.zeros((1, len(model.langs)), np.float32)
            self.levels.append((row, entry.ravel(), np.concatenate([pad, d.escape]), np.concatenate([pad, d.codes])))

    def lengths(self, text: str | None) -> np.ndarray:
        """The text's code length in nats in each language."""
        order, b, total = self.model.cfg.order, padded(text, self.model.cfg.order), np.zeros(len(self.model.langs))
        for at in range(0, len(b) - order, PIECE):
            x = b[at : at + PIECE + order].astype(np.int32)
            n = len(x) - order
            ctx = np.zeros(n, np.int32)
            for i in range(order):
                ctx = (ctx << 8) | x[i : i + n]
            x = x[order:]
            for k in range(order, -1, -1):
                row_of, entry, escape, codes = self.levels[k]
                row = row_of[ctx & ((1 << (8 * k)) - 1)]
                e = entry[row * 256 + x]
                total += codes.take(e, 0).sum(0, dtype=np.float64)
                missed = e == 0
                row = row[missed]
                total += escape.take(row, 0).sum(0, dtype=np.float64)
                ctx, x = ctx[missed], x[missed]
                if not len(x):
                    break
            total += len(x) * np.log(256)
        return total


def _predict_task(model: PpmModel):
    def run(batches):
        table = Lookup(model)
        for b in batches:
            lang, score = [], []
            for t in b.column("text").to_pylist():
                if not model.langs or t is None or not LETTER.search(t):
                    lang.append("und")
                    score.append(0.0)
                    continue
                d = table.lengths(t)
                best = int(d.argmin())
                lang.append(model.langs[best])
                score.append(float(1 / np.exp(-np.minimum(d - d[best], 700)).sum()))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    return run


def predict(docs: DataFrame, model: PpmModel) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs: `und` and 0 for a null text, one without letters, or an empty model;
    of equally short codes the first language by name."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predict_task(model), "doc_id long, lang_pred string, score double")


def identify_documents(docs: DataFrame, cfg: PpmConfig = PpmConfig()) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of docs. A null id is never learnt from."""
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(True))
    return predict(docs, fit(docs.where(~held), cfg)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
