"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of byte n-grams (3 to 6) of the text with A-Z lower-cased, hashed into 2^20 places. The
log-count ratio r of a place compares in how many toxic and clean training texts it occurs; all labelled texts are
counted, joined with their labels (broadcast up to a checked number of rows, by a shuffle beyond it). The `kept` places with the strongest chi-square enter a logistic
regression on r x presence, fitted by numpy on a bounded sample.

The sample, for the regression alone, is bounded to about `per_class` labelled rows of each class, drawn by a hash of the
id; the classes' true shares correct the intercept. It travels as its ids (a bounded broadcast) to the scan of the texts
and comes back as selected features. Every text is scored whole, in pieces that overlap by the longest n-gram, in one
pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.tables import crc_mod, cut, uniform

PIECE = 1 << 20  # bytes hashed at once
#: Odd 64-bit multipliers, one for each n-gram length.
SIZES = (3, 4, 5, 6)
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class ToxicConfig:
    per_class: int = 10_000
    broadcast_rows: int = 2_000_000  # labels that go to every task, some 30 bytes each; more are joined by a shuffle
    places: int = 1 << 20
    kept: int = 6_000
    least: int = 3  # labelled texts that a place must occur in
    smooth: float = 1.0
    l1: float = 2e-4
    l2: float = 1e-5
    steps: int = 250
    threshold: float = 0.7


def grams(text: str | None, places: int, sizes=SIZES):
    """Arrays of hashed n-grams that together cover the text; a space stands before and after it."""
    raw = b" " + (text or "").encode("utf-8", "surrogatepass").lower() + b" "
    for at in range(0, len(raw), PIECE):
        b = np.frombuffer(raw[at : at + PIECE + max(sizes) - 1], np.uint8).astype(np.uint64)
        word = b.copy()
        for k in range(1, max(sizes)):
            if len(b) <= k:
                break
            word = (word[:-1] << np.uint64(8)) | b[k:]
            if k + 1 in sizes:
                yield ((word * _MULTIPLY + np.uint64(k)) * _MULTIPLY >> np.uint64(40)).astype(np.int64) & (places - 1)


def _presence(text: str | None, flags: np.ndarray) -> np.ndarray:
    for g in grams(text, len(flags)):
        flags[g] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


def _count_task(cfg: ToxicConfig):
    """place, toxic, clean: in how many texts of each class a place occurs; place -1 counts the texts themselves."""

    def run(batches):
        flags = np.zeros(cfg.places, bool)
        n, rows = np.zeros((2, cfg.places), np.int32), [0, 0]
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                n[y, _presence(t, flags)] += 1
                rows[y] += 1
        yield pa.RecordBatch.from_pydict({"place": pa.array([-1], pa.int32()), "toxic": pa.array(rows[1:], pa.int64()), "clean": pa.array(rows[:1], pa.int64())})
        found = np.flatnonzero(n.any(0))
        for k in range(0, len(found), 100_000):
            at = found[k : k + 100_000]
            yield pa.RecordBatch.from_pydict({"place": pa.array(at, pa.int32()), "toxic": pa.array(n[1, at], pa.int64()), "clean": pa.array(n[0, at], pa.int64())})

    return run


def _selected(text: str | None, column: np.ndarray) -> np.ndarray:
    """The columns present in the text. column: place -> column, or -1."""
    got = [c[c >= 0] for c in (column[g] for g in grams(text, len(column)))]
    return np.unique(np.concatenate(got)) if got else np.empty(0, np.int32)


def _feature_task(column: np.ndarray):
    """toxic, lens, columns: arrays of a whole batch as bytes (int8, int32, int16), so that the driver holds nothing wider."""

    def run(batches):
        for b in batches:
            rows = [_selected(t, column) for t in b.column("text").to_pylist()]
            if rows:
                packed = np.array(b.column("toxic").to_pylist(), np.int8), np.array([len(x) for x in rows], np.int32), np.concatenate(rows).astype(np.int16)
                yield pa.RecordBatch.from_pydict({k: pa.array([x.tobytes()], pa.binary()) for k, x in zip(("toxic", "lens", "columns"), packed)})

    return run


def fit_linear(lens: np.ndarray, cols: np.ndarray, y: np.ndarray, r: np.ndarray, shares: np.ndarray, cfg: ToxicConfig) -> tuple[np.ndarray, float]:
    """Weights (times r) and intercept of a logistic regression by proximal Adam steps. Row i has lens[i] of cols."""
    ends = np.cumsum(lens)
    cuts = [0, *(np.searchsorted(ends, np.arange(1 << 20, int(ends[-1]) if len(ends) else 0, 1 << 20)) + 1), len(lens)]
    parts = []  # rows in pieces, so that temporary arrays stay small
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            full = np.flatnonzero(lens[lo:hi])
            first = ends[lo] - lens[lo]
            parts.append((lo, hi, full, (ends - lens)[lo:hi][full] - first, cols[first : ends[hi - 1]]))
    share = shares / np.maximum(np.bincount(y, minlength=2), 1)
    weight = share[y] / max(share[y].sum(), 1e-12)
    w, b = np.zeros(len(r)), float(np.log((shares[1] + 1e-9) / (shares[0] + 1e-9)))
    m, v, mb, vb = np.zeros(len(r)), np.zeros(len(r)), 0.0, 0.0
    for t in range(1, cfg.steps + 1):
        g, gb = cfg.l2 * w, 0.0
        wr = w * r
        for lo, hi, full, starts, c in parts:
            z = np.full(hi - lo, b)
            if len(full):
                z[full] += np.add.reduceat(wr[c], starts)
            d = weight[lo:hi] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[lo:hi])
            g += np.bincount(c, np.repeat(d, lens[lo:hi]), len(r)) * r
            gb += d.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 / (1 + t / 50)
        scale = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w -= scale * m / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(scale, 50.0) * cfg.l1, 0)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    return w * r, b


@dataclass
class ToxicModel:
    cfg: ToxicConfig
    column: np.ndarray  # place -> column with a weight, or -1
    weights: np.ndarray
    intercept: float


def _empty(cfg: ToxicConfig, share: float = 0.0) -> ToxicModel:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return ToxicModel(cfg, np.full(cfg.places, -1, np.int16), np.zeros(0), float(np.log(share / (1 - share))))


def known_texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, cfg: ToxicConfig = ToxicConfig()) -> ToxicModel:
    """docs: doc_id, text; labels: doc_id, toxic (null: no label; of several labels of an id the largest holds). Null ids
    are no labelled rows; each of the rows that share a labelled id counts as a text. Without labels of both
    classes, or without labelled texts, nothing can be told apart and every score is the share of the label 1, as if each
    class had one label more; without any label it is near 0."""
    known = cut(labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    have = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not have:
        return _empty(cfg)
    if len(have) < 2:
        return _empty(cfg, (have.get(1, 0) + 1) / (sum(have.values()) + 2))
    part = F.when(F.col("toxic") == 1, F.lit(cfg.per_class / have[1])).otherwise(F.lit(cfg.per_class / have[0]))
    drawn = known.where(uniform(F.col("doc_id"), 7) < part * (1 << 30))  # about 2 x per_class ids at most
    sample = known_texts(docs, F.broadcast(drawn))
    share = have[1] / sum(have.values())
    counts = cut(known_texts(docs, F.broadcast(known) if sum(have.values()) <= cfg.broadcast_rows else known).mapInArrow(_count_task(cfg), "place int, toxic long, clean long").groupBy("place").agg(F.sum("toxic").alias("p"), F.sum("clean").alias("q")))
    texts = counts.where("place < 0").first()
    if texts is None:
        return _empty(cfg, share)
    counts = counts.where((F.col("place") >= 0) & (F.col("p") + F.col("q") >= cfg.least))
    total = counts.agg(F.sum(F.col("p") + cfg.smooth).alias("p"), F.sum(F.col("q") + cfg.smooth).alias("q")).first()
    # chi-square of presence against the label, with each class as large as in the labels
    f1, f0 = (F.col("p") + 0.5) / (texts.p + 1), (F.col("q") + 0.5) / (texts.q + 1)
    f = share * f1 + (1 - share) * f0
    best = counts.withColumn("chi", F.pow(f1 - f0, 2) / (f * (1 - f) + 1e-9)).where("chi > 0").orderBy(F.desc("chi"), "place").limit(cfg.kept).toPandas()
    if not len(best):
        return _empty(cfg, share)
    place, p, q = (best[k].to_numpy(np.int64) for k in ("place", "p", "q"))
    r = np.log(((p + cfg.smooth) / total.p) / ((q + cfg.smooth) / total.q))
    column = np.full(cfg.places, -1, np.int16)
    column[place] = np.arange(len(place))
    got = sample.mapInArrow(_feature_task(column), "toxic binary, lens binary, columns binary").collect()  # about 2 x per_class texts at most
    y, lens, cols = (np.concatenate([np.frombuffer(r[k], t) for r in got] or [np.empty(0, t)]) for k, t in enumerate((np.int8, np.int32, np.int16)))
    y, lens = y.astype(np.int64), lens.astype(np.int64)
    del got
    w, b = fit_linear(lens, cols, y, r, np.array([1 - share, share]), cfg)
    used = np.flatnonzero(w)
    column = np.full(cfg.places, -1, np.int16)
    column[place[used]] = np.arange(len(used))
    return ToxicModel(cfg, column, w[used], b)


def probability(text: str | None, model: ToxicModel) -> float:
    z = model.intercept
    if len(model.weights):
        z += float(model.weights[_selected(text, model.column)].sum())
    return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, score (the probability of the label 1) for each row of docs, repeated and null ids included; null texts
    count as empty. An empty table has no rows, other columns are not looked at."""

    def run(batches):
        for b in batches:
            out = [probability(t, model) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": pa.array(out, pa.float64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is below the threshold; null and empty texts, null ids and
    repeated rows alike, each row by its own text. A model that tells no texts apart (labels of one class) rejects none."""
    if not len(model.weights):
        return docs

    def run(batches):
        for b in batches:
            at = b.schema.names.index("text")
            yield b.filter(pa.array([probability(t, model) < model.cfg.threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learnable():
    return F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, cfg: ToxicConfig = ToxicConfig()) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs. Labels of held-out rows are not read; a null id is
    held out."""
    scored = score(docs, fit(docs.where(learnable()), labels.where(learnable()), cfg))
    return scored.select("doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= cfg.threshold).cast("int").alias("predicted"))
