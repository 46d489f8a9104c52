"""Log-bilinear neural language model: noise-contrastive training in numpy inside Spark tasks, normalised scoring.

Tokens are the lower-cased (A-Z) runs of bytes other than space and tab..carriage return, then one end per text.
The end and the most frequent words (`groups` x `members` in all) have input and output vectors of their own. By
frequency they form groups; the context of `CONTEXT` tokens predicts first one of the groups or tail classes, then the
word in its group, each by a log-bilinear layer of its own. A tail class holds all other words that share
crc32(last three bytes) mod `tail_classes`; inside it a word has its smoothed share of the class's tokens, and one
unknown word per class takes the rest. So every text has a normalised probability over an open vocabulary.

Scale: word counts of the whole training part are one shuffle (tasks pre-aggregate). The network is trained on all
training tokens in `rounds`: a round deals its texts by a hash to tasks (their number depends on the number of tokens,
not on the files), each takes local stochastic gradient steps, and the parameters are averaged in two levels, in pieces.
Scoring reads the texts once, by batched matrix products over many texts. Only words outside the `head` most frequent
ones, no key of which can be hot, leave the task to meet their counts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.tables import crc_mod, cut

CONTEXT = 2
END = b""  # no word is empty
PIECE = 8192  # parameters averaged at once
LOT = 64  # vectors added up in a task
NEVER = np.float32(-1e9)  # log-odds of an output that no word has


@dataclass(frozen=True)
class LmConfig:
    groups: int = 64  # of words with vectors of their own, the end being the first
    members: int = 64
    tail_classes: int = 128
    dim: int = 32
    head: int = 200_000  # words whose counts every task holds
    noise: int = 32  # noise samples of the first layer, shared by a minibatch
    inner_noise: int = 16  # of the second layer, for each group, shared by its tokens in a minibatch
    batch: int = 4096
    rate: float = 0.2
    rounds: int = 3
    part_tokens: int = 4_000_000  # training tokens of a task
    parts: int = 4096  # tasks at most
    add: float = 0.1
    seed: int = 11

    @property
    def own(self) -> int:
        return self.groups * self.members


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def tail_class(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-3:]) % classes


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


def tail_classes(words: pa.Array, classes: int) -> np.ndarray:
    """tail_class() of all these words (binary, none null) at once."""
    if not len(words):
        return np.empty(0, np.int64)
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32, len(words) + 1, 4 * words.offset)
    size, last = np.diff(at), at[1:].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for k in (3, 2, 1):
        some = np.flatnonzero(size >= k)
        crc[some] = CRC[(crc[some] ^ data[last[some] - k]) & 255] ^ crc[some] >> 8
    return (~crc % np.uint32(classes)).astype(np.int64)


def parted(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """words_of() all these texts, one after another, and how many each has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, sizes = lists.flatten().cast(pa.binary()), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.greater(pc.binary_length(words), 0)  # before and behind blanks there are empty ones
    kept = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    ends = np.cumsum(sizes)
    return words if kept[-1] == len(words) else words.filter(real), kept[ends] - kept[ends - sizes]


def runs(texts: pa.Array, most: int = 1 << 22):
    """First and last + 1 of texts that have at most `most` bytes in all, or of one text."""
    bytes_ = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(bytes_):
        b = max(a + 1, int(np.searchsorted(bytes_, (bytes_[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


class Encoder:
    """Words to numbers: own words first, then tail classes."""

    def __init__(self, own: dict[bytes, int], cfg: LmConfig):
        self.own, self.cfg = pa.array(sorted(own, key=own.get), pa.binary()), cfg

    def __call__(self, words: pa.Array) -> np.ndarray:
        found = pc.index_in(words, value_set=self.own)
        ids = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        if found.null_count:
            ids[ids < 0] = self.cfg.own + tail_classes(words.filter(pc.is_null(found)), self.cfg.tail_classes)
        return ids


def laid_out(codes: np.ndarray, sizes: np.ndarray, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Texts of these sizes one after another, each with CONTEXT ends before it and one after it, and the places of its tokens."""
    lens = sizes + CONTEXT + 1
    ids = np.full(int(lens.sum()), end, np.int64)
    first = np.cumsum(lens) - lens
    target = np.ones(len(ids), bool)
    for i in range(CONTEXT):
        target[first + i] = False
    word = target.copy()
    word[first + lens - 1] = False
    ids[word] = codes
    return ids, np.flatnonzero(target)


def start(top: np.ndarray, inner: np.ndarray, cfg: LmConfig) -> dict[str, np.ndarray]:
    """Parameters before training, with unigram biases. top: masses of groups and tail classes, inner: of own words."""
    rng, d = np.random.default_rng(cfg.seed), cfg.dim
    log = lambda x: np.where(x > 0, np.log(np.maximum(x, 1e-30)), NEVER).astype(np.float32)
    return {
        "r": rng.normal(0, 0.1, (cfg.own + cfg.tail_classes, d)).astype(np.float32),
        "q": rng.normal(0, 0.1, (cfg.groups + cfg.tail_classes, d)).astype(np.float32),
        "w": rng.normal(0, 0.1, (cfg.own, d)).astype(np.float32),
        "c": (np.eye(d, dtype=np.float32)[None] / CONTEXT + rng.normal(0, 0.02, (CONTEXT, d, d)).astype(np.float32)),
        "b": log(top),
        "v": log(inner),
    }


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _met(ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ids (under `most`), and where in it each different one begins."""
    order = np.argsort(ids.astype(np.int16) if most <= 1 << 15 else ids, kind="stable")  # short numbers are sorted by radix
    ids = ids[order]
    return order, np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))


def _added(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows from each start to the next. Numbers are added in pairs, as complex ones, which takes half the time."""
    if rows.ndim == 2 and rows.shape[1] % 2 == 0 and rows.dtype == np.float32:
        return np.add.reduceat(np.ascontiguousarray(rows).view(np.complex64), starts, axis=0).view(np.float32)
    return np.add.reduceat(rows, starts, axis=0)


def _climb(p: np.ndarray, sums: np.ndarray, at: np.ndarray, g: np.ndarray, rate: float) -> None:
    """An Adagrad step on the rows `at` of p, all different."""
    s = sums.take(at, axis=0)
    s += g * g
    sums[at] = s
    np.sqrt(s, out=s)
    np.divide(g, s, out=s)
    s *= np.float32(rate)
    p[at] += s


def _climb_sums(p: np.ndarray, sums: np.ndarray, ids: np.ndarray, rows: np.ndarray, rate: float) -> None:
    """The same on the rows `ids`, which may repeat."""
    order, starts = _met(ids, len(p))
    _climb(p, sums, ids[order[starts]], _added(rows.take(order, axis=0), starts), rate)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in place."""
    np.negative(x, out=x)
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def nce_step(p: dict, sums: dict, ctx: np.ndarray, y: np.ndarray, noise: Noise, rng, cfg: LmConfig, rate: float) -> None:
    """One step on a minibatch: targets y (n) after contexts ctx (CONTEXT x n). Data and noise samples of both layers are
    told apart by logistic regression; a row's gradient is a mean over the minibatch. The minibatch is put in the order of
    its groups, then the tail classes, so that each group's tokens meet their shared noise as one matrix product."""
    n, d = np.float32(len(y)), cfg.dim
    top = np.where(y < cfg.own, y // cfg.members, y - cfg.own + cfg.groups)
    order, first = _met(top, cfg.groups + cfg.tail_classes)
    ctx, y, top = ctx.take(order, axis=1), y.take(order), top.take(order)
    # words repeat within a minibatch: what concerns a word of the context alone is done once for each
    there = np.zeros(len(p["r"]), bool)
    there[ctx] = True
    words = np.flatnonzero(there)
    number = np.empty(len(there), np.int64)
    number[words] = np.arange(len(words))
    rows, ctx = p["r"].take(words, axis=0), number.take(ctx)
    h = sum((rows @ m).take(c, axis=0) for c, m in zip(ctx, p["c"]))
    z = noise.top(rng)
    qy, qz = p["q"].take(top, axis=0), p["q"][z]
    up = _sigmoid((noise.log_top - p["b"]).take(top) - np.einsum("nd,nd->n", h, qy)) / n
    down = h @ qz.T
    down += p["b"][z] - noise.log_top[z]
    down = _sigmoid(down)
    down *= -1 / n
    gh = down @ qz
    qy *= up[:, None]
    gh += qy
    met = top[first]  # each once
    own = int(np.searchsorted(top, cfg.groups))
    if own:
        hi, yi = h[:own], y[:own]
        wy, off = p["w"].take(yi, axis=0), p["v"] - noise.log_inner
        up_i = _sigmoid(-np.einsum("nd,nd->n", hi, wy) - off.take(yi)) / n
        wy *= up_i[:, None]
        gh[:own] += wy
        groups = met[met < cfg.groups]
        ends = [*first[: len(groups)].tolist(), own]
        zi = noise.inner(groups, rng)
        wz, oz = p["w"].take(zi, axis=0), off.take(zi)
        down_i, gz = np.empty((own, zi.shape[1]), np.float32), np.empty((*zi.shape, d), np.float32)
        for k in range(len(groups)):
            np.add(hi[ends[k] : ends[k + 1]] @ wz[k].T, oz[k], out=down_i[ends[k] : ends[k + 1]])
        _sigmoid(down_i)
        down_i *= -1 / n
        for k in range(len(groups)):
            part = down_i[ends[k] : ends[k + 1]]
            gh[ends[k] : ends[k + 1]] += part @ wz[k]
            np.matmul(part.T, hi[ends[k] : ends[k + 1]], out=gz[k])
        ids = np.concatenate([yi, zi.ravel()])
        _climb_sums(p["w"], sums["w"], ids, np.concatenate([up_i[:, None] * hi, gz.reshape(-1, d)]), rate)
        _climb_sums(p["v"], sums["v"], ids, np.concatenate([up_i, np.add.reduceat(down_i, ends[:-1], axis=0).ravel()]), rate)
    ids = np.concatenate([met, z])
    _climb_sums(p["q"], sums["q"], ids, np.concatenate([_added(up[:, None] * h, first), down.T @ h]), rate)
    _climb_sums(p["b"], sums["b"], ids, np.concatenate([np.add.reduceat(up, first), down.sum(0)]), rate)
    back, g = np.zeros_like(rows), np.empty_like(p["c"])
    for i, c in enumerate(ctx):
        order, starts = _met(c, len(words))
        at, x = c[order[starts]], _added(gh.take(order, axis=0), starts)
        back[at] += x @ p["c"][i].T
        g[i] = rows.take(at, axis=0).T @ x
    sums["c"] += g * g
    p["c"] += rate * g / np.sqrt(sums["c"])
    _climb(p["r"], sums["r"], words, back, rate)


class Noise:
    """Noise of both layers: the unigram masses of groups and tail classes, and those of the words in each group."""

    def __init__(self, top: np.ndarray, inner: np.ndarray, cfg: LmConfig):
        self.cfg, self.cdf = cfg, np.cumsum(top)
        self.inner_cdf = (np.cumsum(inner.reshape(cfg.groups, cfg.members), 1) + np.arange(cfg.groups)[:, None]).ravel()
        log = lambda k, x: np.where(x > 0, np.log(np.maximum(k * x, 1e-30)), 0).astype(np.float32)
        self.log_top, self.log_inner = log(cfg.noise, top), log(cfg.inner_noise, inner)

    def top(self, rng) -> np.ndarray:
        return np.minimum(np.searchsorted(self.cdf, rng.random(self.cfg.noise) * self.cdf[-1], side="right"), len(self.cdf) - 1)

    def inner(self, group: np.ndarray, rng) -> np.ndarray:
        at = np.searchsorted(self.inner_cdf, rng.random((len(group), self.cfg.inner_noise)) + group[:, None], side="right")
        return np.clip(at, group[:, None] * self.cfg.members, (group[:, None] + 1) * self.cfg.members - 1)


def _minibatches(texts: pa.Array, encoder: Encoder, size: int):
    """(contexts, targets) of about `size` tokens over whole texts."""
    codes, sizes = np.empty(0, np.int64), np.empty(0, np.int64)  # of texts not yet given out
    for first, last in runs(texts):
        words, n = parted(texts[first:last])
        codes, sizes = np.concatenate([codes, encoder(words)]), np.concatenate([sizes, n])
        ends, tokens, a = np.concatenate(([0], np.cumsum(sizes))), np.concatenate(([0], np.cumsum(sizes + 1))), 0
        while a < len(sizes):
            b = int(np.searchsorted(tokens, tokens[a] + 8 * size))
            if b > len(sizes) and last < len(texts):
                break
            b = min(b, len(sizes))
            ids, at = laid_out(codes[ends[a] : ends[b]], sizes[a:b])
            for k in range(0, len(at), size):
                x = at[k : k + size]
                yield np.stack([ids[x - i - 1] for i in range(CONTEXT)]), ids[x]
            a = b
        codes, sizes = codes[ends[a] :], sizes[a:]


def _train_task(own: dict, params: dict, top: np.ndarray, inner: np.ndarray, cfg: LmConfig, turn: int):
    """One row for each PIECE of what the task adds to the parameters, in half precision, as a change is small."""

    def run(batches):
        p = {k: v.copy() for k, v in params.items()}
        sums = {k: np.full_like(v, 1e-4) for k, v in p.items()}
        rng, encoder, noise, seen = np.random.default_rng(cfg.seed + turn), Encoder(own, cfg), Noise(top, inner, cfg), 0
        for b in batches:
            for ctx, y in _minibatches(b.column("text"), encoder, cfg.batch):
                nce_step(p, sums, ctx, y, noise, rng, cfg, cfg.rate / (1 + turn))
                seen += len(y)
        if seen:
            flat = (pack(p) - pack(params)).astype(np.float16)
            pieces = [flat[k : k + PIECE].tobytes() for k in range(0, len(flat), PIECE)]
            yield pa.RecordBatch.from_pydict({"piece": pa.array(range(len(pieces)), pa.int32()), "seen": pa.array([seen] * len(pieces), pa.int64()), "x": pa.array(pieces, pa.binary())})

    return run


def _mean(given: type):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seen = pdf["seen"].to_numpy(np.float64)
        total = sum(n * np.frombuffer(x, given).astype(np.float64) for n, x in zip(seen, pdf["x"]))
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "seen": [int(seen.sum())], "x": [(total / seen.sum()).astype(np.float32).tobytes()]})

    return run


def _count_task(batches, most: int = 1_500_000):
    """word, n of some batches at a time, the words as words_of() has them; empty ones, before and behind blanks, are none."""
    held, words, texts = [], 0, 0

    def out():
        met = pc.value_counts(pa.chunked_array(held, pa.binary())) if held else None
        word, n = (met.field("values"), met.field("counts")) if held else (pa.array([], pa.binary()), pa.array([], pa.int64()))
        real = pc.greater(pc.binary_length(word), 0)
        word, n = pa.concat_arrays([word.filter(real), pa.array([END], pa.binary())]), pa.concat_arrays([n.filter(real), pa.array([texts], pa.int64())])
        return pa.RecordBatch.from_arrays([word, n], ["word", "n"])

    for b in batches:
        column = pc.fill_null(b.column("text"), "")
        for at in range(0, len(column), 200):
            part = pc.ascii_split_whitespace(pc.ascii_lower(column.slice(at, 200))).flatten().cast(pa.binary())
            held.append(part)
            words += len(part)
            texts += min(200, len(column) - at)
            if words > most:
                yield out()
                held, words, texts = [], 0, 0
    if texts:
        yield out()


def word_counts(train: DataFrame) -> DataFrame:
    """word (binary; the end is empty), n: occurrences over all texts of train."""
    return train.select("text").mapInArrow(_count_task, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The `most` most frequent words. Frequencies are told apart in 64 steps a doubling; of the words of the step where
    the bound is reached those with the least hashes are taken, as many as there is room for (or a few less, where
    hashes meet)."""
    step = F.floor(F.log2("n") * 64).cast("int")
    place = F.pmod(F.xxhash64("word"), F.lit(1 << 16)).cast("int")
    total, border = 0, None
    for s, n in sorted(((r.s, r.n) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True):
        if total + n > most:
            border = s
            break
        total += n
    if border is None:
        return counts
    least = 0
    for p, n in sorted((r.p, r.n) for r in counts.where(step == border).groupBy(place.alias("p")).agg(F.count("*").alias("n")).collect()):  # at most 65,536 rows
        total += n
        if total > most:
            break
        least = p + 1
    return counts.where((step > border) | ((step == border) & (place < least)))


@dataclass
class LanguageModel:
    cfg: LmConfig
    counts: DataFrame  # word, n, of every training token
    tokens: int
    distinct: int
    ends: int  # training texts
    own: dict[bytes, int]
    head: dict[bytes, int]  # counts of the most frequent words, the end not among them
    tail: list[tuple[int, int]]  # tokens and words of each tail class
    params: dict[str, np.ndarray]


def fit(train: DataFrame, cfg: LmConfig = LmConfig()) -> LanguageModel:
    """train: doc_id, text (null: empty, which is one end). Each row is a text, rows that share an id too. An empty table
    gives the smoothed uniform model. Of equally frequent words the lesser bytes come first."""
    counts = cut(word_counts(train))
    tokens, distinct = (x or 0 for x in counts.agg(F.sum("n"), F.count("*")).first())
    end = counts.where(F.octet_length("word") == 0).first()
    ends = end.n if end else 0
    head = {bytes(r.word): r.n for r in most_frequent(counts.where(F.octet_length("word") > 0), cfg.head).collect()}  # at most cfg.head rows
    ranked = sorted(head, key=lambda w: (-head[w], w))[: cfg.own - 1]
    own = {END: 0} | {w: i + 1 for i, w in enumerate(ranked)}
    # the words with outputs of their own are taken from the class totals, not filtered from the table
    cls = F.crc32(F.expr("substring(word, -3, 3)")) % F.lit(cfg.tail_classes)
    totals = {r.k: (r.n, r.v) for r in counts.groupBy(cls.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    tail = [totals.get(k, (0, 0)) for k in range(cfg.tail_classes)]
    for w, n in [(END, ends)] * (ends > 0) + [(w, head[w]) for w in ranked]:
        k = tail_class(w, cfg.tail_classes)
        tail[k] = (tail[k][0] - n, tail[k][1] - 1)
    inner = np.zeros(cfg.own)
    inner[: len(own)] = np.array([ends, *(head[w] for w in ranked)]) + 0.5
    mass = inner.reshape(cfg.groups, cfg.members).sum(1)
    top = np.concatenate([mass, [n + 0.5 for n, _ in tail]])
    top, inner = top / top.sum(), inner / np.maximum(np.repeat(mass, cfg.members), 1e-30)
    params = start(top, inner, cfg)
    key = F.xxhash64(F.lit(cfg.seed), "doc_id", "text")
    for turn in range(cfg.rounds if tokens else 0):
        dealt = train.where(F.pmod(key, F.lit(cfg.rounds)) == turn).withColumn("_key", key).repartition(min(cfg.parts, -(-tokens // (cfg.rounds * cfg.part_tokens))), "_key")
        locals_ = dealt.sortWithinPartitions("_key").select("text").mapInArrow(_train_task(own, params, top, inner, cfg, turn), "piece int, seen long, x binary")
        lots = locals_.withColumn("lot", F.floor(F.spark_partition_id() / LOT).cast("int")).groupBy("piece", "lot").applyInPandas(_mean(np.float16), "piece int, seen long, x binary")
        mean = {r.piece: r.x for r in lots.groupBy("piece").applyInPandas(_mean(np.float32), "piece int, seen long, x binary").collect()}  # the parameters
        if mean:
            params = unpack(pack(params) + np.concatenate([np.frombuffer(mean[k], np.float32) for k in sorted(mean)]), params)
    return LanguageModel(cfg, counts, tokens, distinct, ends, own, head, tail, params)


class Network:
    """Normalised log-probabilities of a trained model."""

    def __init__(self, params: dict, cfg: LmConfig):
        self.cfg, self.ones = cfg, np.ones(max(cfg.groups + cfg.tail_classes, cfg.members), np.float32)
        # what a token adds to the prediction at each distance; the last place of a prediction is 1, for the biases
        self.ahead = [np.concatenate([params["r"] @ m, np.full((len(params["r"]), 1), float(i == 0), np.float32)], 1) for i, m in enumerate(params["c"])]
        self.qt = np.concatenate([params["q"], params["b"][:, None]], 1).T.copy()
        w = np.concatenate([params["w"], params["v"][:, None]], 1)
        self.w = w.reshape(cfg.groups, cfg.members, -1).transpose(0, 2, 1).copy()
        own = np.arange(cfg.own)
        self.top = np.concatenate([own // cfg.members, cfg.groups + np.arange(cfg.tail_classes)]).astype(np.int16)

    def log_probs(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log P of the tokens at these places, each after the CONTEXT tokens before it."""
        out, size = np.empty(len(at), np.float64), 16_384
        for k in range(0, len(at), size):
            out[k : k + size] = self._batch(ids, at[k : k + size])
        return out

    def _batch(self, ids, at):
        cfg, y = self.cfg, ids[at]
        top = self.top[y]
        order = np.argsort(top, kind="stable")  # by group, then the tail classes
        at, y, top = at[order], y[order], top[order]
        h = self.ahead[0].take(ids[at - 1], axis=0)
        for i in range(1, CONTEXT):
            h += self.ahead[i].take(ids[at - 1 - i], axis=0)
        lp = np.empty(len(at), np.float32)
        for k in range(0, len(at), 1024):  # as many as a processor's cache holds
            lp[k : k + 1024] = self._softmax(h[k : k + 1024], self.qt, top[k : k + 1024])
        ends = np.searchsorted(top, np.arange(cfg.groups + 1, dtype=np.int16))
        member = y % cfg.members
        for g in np.flatnonzero(np.diff(ends)):
            mine = slice(ends[g], ends[g + 1])
            lp[mine] += self._softmax(h[mine], self.w[g], member[mine])
        out = np.empty(len(at), np.float32)
        out[order] = lp
        return out

    def _softmax(self, h: np.ndarray, to: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Log-probability of y in each row of the scores h @ to."""
        s = h @ to
        picked = s[np.arange(len(y)), y]
        with np.errstate(over="ignore"):
            np.exp(s, out=s)
        total = s @ self.ones[: s.shape[1]]
        if not (total.min() > 1e-30 and total.max() < 1e30):  # scores far from 0, or none at all: moved by the largest of their row
            s = h @ to
            s -= s.max(1, keepdims=True)
            picked, total = s[np.arange(len(y)), y], np.exp(s).sum(1)
        return picked - np.log(total)


SCORED = "uid long, doc_id long, word binary, salt long, tf long, n_tokens long, n_known long, base double, nn double"


def _score_task(model: LanguageModel):
    """One row per text, then one for each of its words that the head lacks."""
    cfg, tokens, distinct, params, tail, ends = model.cfg, model.tokens, model.distinct, model.params, model.tail, model.ends
    names = [x.split()[0] for x in SCORED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    known, n_of, encoder = pa.array(list(model.head), pa.binary()), np.array(list(model.head.values()), np.float64), Encoder(model.own, cfg)

    def run(batches):
        net = Network(params, cfg)
        log_all = np.log10(tokens + cfg.add * (distinct + 1))
        in_class = np.array([np.log10(n + cfg.add * (v + 1)) for n, v in tail])
        code = encoder(known)
        # an own word has its output, any other one a share of its class
        share_of = np.where(code < cfg.own, 0.0, np.log10(n_of + cfg.add) - in_class[np.maximum(code - cfg.own, 0)])
        base_of = np.log10(n_of + cfg.add) - log_all
        code, base_of, share_of = np.append(code, 0), np.append(base_of, 0.0), np.append(share_of, 0.0)  # the last place: any other word
        end = np.log10(ends + cfg.add) - log_all

        def batch(n, **columns):
            return pa.RecordBatch.from_arrays([pa.nulls(n, t) if columns.get(c) is None else pa.array(columns[c], t) for c, t in zip(names, types)], names)

        def scored(uids, docs, texts):
            words, sizes = parted(texts)
            found = pc.index_in(words, value_set=known)
            place = pc.fill_null(found, -1).to_numpy()
            codes, other = code[place], np.flatnonzero(place < 0)
            rest = words.filter(pc.is_null(found))
            codes[other] = cfg.own + tail_classes(rest, cfg.tail_classes)
            ids, at = laid_out(codes, sizes)
            lp = net.log_probs(ids, at) / np.log(10)
            i = np.arange(len(sizes))
            last = np.cumsum(sizes) + i  # places of the ends
            word = np.ones(len(at), bool)
            word[last] = False

            def total(of_word, of_end):
                x = np.empty(len(at))
                x[word], x[last] = of_word, of_end
                return np.add.reduceat(x, last - sizes)

            yield batch(
                len(sizes), uid=uids, doc_id=docs, word=[END] * len(sizes), salt=uids.to_numpy() + 1, tf=np.zeros(len(sizes), np.int64),
                n_tokens=sizes + 1, n_known=total(place >= 0, ends > 0).astype(np.int64), base=total(base_of[place], end), nn=np.add.reduceat(lp, last - sizes) + total(share_of[place], 0),
            )
            if len(other):
                seen = rest.dictionary_encode()
                pair, tf = np.unique(np.repeat(i, sizes)[other] * len(seen.dictionary) + seen.indices.to_numpy(), return_counts=True)
                text, word = np.divmod(pair, len(seen.dictionary))
                yield batch(len(pair), uid=uids.to_numpy()[text], word=seen.dictionary.take(pa.array(word)), salt=np.zeros(len(pair), np.int64), tf=tf)

        for b in batches:
            for first, last in runs(b.column("text")):
                yield from scored(*(b.column(c)[first:last] for c in ("uid", "doc_id", "text")))

    return run


def score(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: one row for each row of docs, repeated ids included.
    Null and empty texts have the end as their only token. base_score is the smoothed unigram log10 probability. An empty
    table has no rows; other columns are not looked at."""
    cfg = model.cfg
    log_all = float(np.log10(model.tokens + cfg.add * (model.distinct + 1)))
    in_class = F.array(*[F.lit(float(np.log10(n + cfg.add * (v + 1)))) for n, v in model.tail])
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), "text").mapInArrow(_score_task(model), SCORED)
    counts = model.counts.select("word", F.col("n").alias("c"), F.lit(0).cast("long").alias("salt"))
    cls = (F.crc32(F.expr("substring(word, -3, 3)")) % F.lit(cfg.tail_classes)).cast("int")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + F.lit(cfg.add))
    met = rows.join(counts, ["word", "salt"], "left").select(
        "uid",
        "doc_id",
        "n_tokens",
        F.coalesce("n_known", F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.coalesce("base", F.col("tf") * (log_c - F.lit(log_all))).alias("base"),
        F.coalesce("nn", F.col("tf") * (log_c - F.get(in_class, cls))).alias("nn"),
    )
    return (
        met.groupBy("uid")
        .agg(*(f(c).alias(c) for f, c in ((F.max, "doc_id"), (F.max, "n_tokens"), (F.sum, "n_known"), (F.sum, "base"), (F.sum, "nn"))))
        .select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("nn").alias("score"))
    )


def held_out(mod: int, rest: int):
    """True for rows that training leaves out; a null id is never trained on."""
    return F.coalesce(crc_mod("doc_id", mod) == rest, F.lit(True))


def score_documents(docs: DataFrame, cfg: LmConfig = LmConfig()) -> DataFrame:
    """Train on rows whose crc32(doc_id) mod 10 is not 0, score all rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(docs, fit(docs.where(~held_out(10, 0)), cfg))
    return scored.select("doc_id", held_out(10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
