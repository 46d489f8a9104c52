"""Benchmark decontamination by templates.

Tokens are canonicalised: numbers, units after numbers and names become typed placeholders whose values are kept as
slots. Every window of `window` tokens of a benchmark item gives a template; so does the window's plain lower-cased
wording. A text's windows meet the item's windows by hash. Windows of a text and an item that lie on one diagonal (same
distance between the two positions) form an alignment; a run of its adjacent windows counts if its slots are consistent,
that is if one benchmark value always stands for one value in the text (two may become equal). Consistency holds over
the item: of its runs, on all diagonals, the longest is taken first, and then each that agrees with those taken. A text
is contaminated by an item if these runs cover at least `cover` of the item's windows, or if one of them has `run`
tokens, however long the item is. So a question whose numbers or names were exchanged is found, and a text that only has
the same pattern of placeholders is not: a template needs `literal` plain words. Templates with fewer are enough
together: all windows of an item with `few` plain words lie on one diagonal and agree (items full of numbers). A run
whose one value has two values in the text is not counted, verbatim windows included. Items too short for windows
(fewer than `literal` tokens) are found verbatim, where they stand between sentence ends; a single token, where it is
the whole text.

The benchmark's hashes fill a bitmap of bounded size that every task has; only windows that hit it meet the benchmark's
windows by hash, in the task where these are few enough to be broadcast. A text that repeats an item sends its windows, no more.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.tables import cut, fresh

TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[$€£¥%°]|[.!?\n:;]+")
NUMBER, UNIT, CAPITAL, STOP, NAME, WORD = 1, 2, 3, 4, 5, 0
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
)
UNITS = frozenset(
    "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "centimeter centimeters mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes ml cl l liter liters litre litres "
    "gallon gallons pint pints s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur gbp mph kmh degree degrees percent $ € £ ¥ % °".split()
)
NAMES = frozenset(
    "alice amy anna ben bill bob carl carol charlie daniel david diana emily emma eric eva frank george grace hannah harry helen jack james jane janet "
    "jason jennifer jessica jim joe john jose julia karen kate kevin laura leo linda lisa lucy maria mark martha mary matt michael mike natalia nick "
    "nina olivia oscar pam paul peter rachel robert rosa ryan sam sara sarah sophie steve susan thomas tim tina tom tony victor wendy".split()
)


@dataclass(frozen=True)
class LeakConfig:
    window: int = 8
    literal: int = 5
    few: int = 2
    cover: float = 0.2
    run: int = 13  # adjacent tokens that are enough
    bits: int = 1 << 24  # at most, of the bitmap


_SLOT = {NUMBER: 0x1F83D9ABFB41BD6B, UNIT: 0x5BE0CD19137E2179, NAME: 0x9B05688C2B3E6C1F}
_M = 0x9E3779B97F4A7C15
_TAIL = 0xBF58476D1CE4E5B9
_IS_SLOT = np.isin(np.arange(6), list(_SLOT))
_SHAPE = np.array([_SLOT.get(k, 0) for k in range(6)], np.uint64)
TOKENS_AT_ONCE = 200_000
#: Windows of the benchmark, some 150 bytes each, that go to every task, so that a window which many texts and items share is
#: no key of a shuffle; more are joined by one.
BROADCAST_WINDOWS = 200_000


class Canon:
    """Canonical tokens of texts, with a memory of the tokens met."""

    def __init__(self):
        self.memo: dict[str, int] = {}
        self.lows: list[str] = []
        self.kinds, self.hashes = np.empty(1 << 12, np.int8), np.empty(1 << 12, np.uint64)
        self.symbols = np.zeros(1 << 12, bool)

    def _learn(self, token: str) -> int:
        low = token.lower()
        if token[0].isdigit() or low in NUMBERS:
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        elif not token[0].isalpha():
            kind = STOP
        elif low in NAMES and token[0].isupper():
            kind = NAME
        elif token[0].isupper() and not (len(token) > 1 and token.isupper()):
            kind = CAPITAL
        else:
            kind = WORD
        k = self.memo[token] = len(self.memo)
        if k == len(self.kinds):
            self.kinds, self.hashes, self.symbols = (np.resize(x, 2 * k) for x in (self.kinds, self.hashes, self.symbols))
        self.kinds[k], self.hashes[k], self.symbols[k] = kind, xxhash.xxh64_intdigest(low), low in "$€£¥"
        self.lows.append(low)
        return k

    def ids(self, text: str | None) -> list[int]:
        """The tokens' numbers, with a sentence end after them."""
        tokens = TOKEN.findall(text or "")
        tokens.append("\n")
        ids = list(map(self.memo.get, tokens))
        if None in ids:
            for i, v in enumerate(ids):
                if v is None:
                    k = self.memo.get(tokens[i])
                    ids[i] = self._learn(tokens[i]) if k is None else k
        return ids

    def __call__(self, texts: list[list[int]]) -> Canonical:
        """The canonical tokens of some texts, given as token numbers, one after another."""
        ids = np.fromiter((k for t in texts for k in t), np.int64, sum(map(len, texts)))
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        kinds = self.kinds[ids]
        before = np.concatenate(([STOP], kinds[:-1]))
        kinds = np.where(kinds == CAPITAL, np.where(before == STOP, WORD, NAME), kinds)  # a sentence's first word has a capital anyway
        kinds = np.where((kinds == UNIT) & (before != NUMBER) & ~self.symbols[ids], WORD, kinds)
        at = np.flatnonzero(kinds != STOP)
        ids, kinds, owner, gap = ids[at], kinds[at], owner[at], np.diff(at, prepend=-2, append=at[-1] + 2 if len(at) else 0) > 1
        plain = self.hashes[ids]
        slot = _IS_SLOT[kinds]
        return Canonical(ids, kinds, owner, plain, np.where(slot, _SHAPE[kinds], plain), slot, gap[:-1], gap[1:])


@dataclass
class Canonical:
    ids: np.ndarray
    kinds: np.ndarray
    owner: np.ndarray  # the token's text
    plain: np.ndarray  # hash of the wording
    shaped: np.ndarray  # hash of the wording or of the placeholder
    slot: np.ndarray
    starts: np.ndarray  # a sentence end before the token
    ends: np.ndarray  # and after it

    def windows(self, lengths: list[int], cfg: LeakConfig, bitmap: np.ndarray | None):
        """(n, whether of the wording, hashes, positions, strong) of the windows of n tokens, ascending lengths, that lie within a text and hit the
        bitmap: wordings, and templates with a plain word. The hashes of length n + 1 grow from those of n."""
        sums, ahead = [x.copy() for x in (self.plain, self.shaped)], np.concatenate(([0], np.cumsum(self.slot)))
        m, power = len(self.ids), 1
        for n in range(1, max(lengths, default=0) + 1):
            m = len(self.ids) - n + 1
            if m <= 0:
                return
            if n > 1:
                power = power * _M & (1 << 64) - 1
                sums = [s[:m] + x[n - 1 :] * np.uint64(power) for s, x in zip(sums, (self.plain, self.shaped))]
            if n not in lengths:
                continue
            inside = self.owner[:m] == self.owner[n - 1 :]
            slots = ahead[n:] - ahead[:-n]
            least = min(cfg.literal, n - 1)
            shaped = inside & (slots > 0) & (slots < n)
            if n < cfg.literal:  # an item as short as this stands alone
                inside, shaped = inside & self.starts[:m] & self.ends[n - 1 :], None
                if n == 1:
                    inside &= np.bincount(self.owner, minlength=1)[self.owner] == 1
            for seed, h, ok in ((1, sums[0], inside), (2, sums[1], shaped)):
                if ok is None:
                    continue
                h = (h ^ (h >> np.uint64(29))) * np.uint64(_TAIL) + np.uint64(seed + 2 * n)
                h ^= h >> np.uint64(32)
                if bitmap is not None:
                    b = h & np.uint64(len(bitmap) * 8 - 1)
                    ok = ok & (((bitmap[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1) == 1)
                where = np.flatnonzero(ok)
                if len(where):
                    yield n, seed == 1, h[where].view(np.int64), where, np.full(len(where), True) if seed == 1 else n - slots[where] >= least

    def slots_of(self, at: int, n: int, lows: list[str]) -> list[str]:
        return [f"{self.kinds[j]}={lows[self.ids[j]]}" for j in range(at, at + n) if self.slot[j]]


def _item_task(cfg: LeakConfig):
    names = ["item_id", "item_row", "hash", "item_pos", "n", "total", "strong", "item_slots"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string())]

    def run(batches):
        canon = Canon()
        for b in batches:
            out: list[list] = [[] for _ in names]
            for item, row, t in zip(b.column("item_id").to_pylist(), b.column("item_row").to_pylist(), b.column("text").to_pylist()):
                c = canon([canon.ids(t)])
                n = min(cfg.window, len(c.ids))
                if n < cfg.literal:  # an item is alone, and whole
                    c.starts[:], c.ends[:] = True, True
                for _, _, hashes, where, strong in c.windows([n], cfg, None) if n else ():
                    for h, i, s in zip(hashes.tolist(), where.tolist(), strong.tolist()):
                        if not s and (~c.slot).sum() < cfg.few:
                            continue
                        for col, v in zip(out, (item, row, h, i, n, len(c.ids) - n + 1, s, c.slots_of(i, n, canon.lows))):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)

    return run


def _text_task(cfg: LeakConfig, lengths: list[int], bitmap: bytes):
    names = ["doc_id", "row", "hash", "pos", "slots"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string())]

    def run(batches):
        canon, bits = Canon(), np.frombuffer(bitmap, np.uint8)

        def found(held):
            """held: (doc_id, row, token numbers) of some texts."""
            c, out = canon([ids for _, _, ids in held]), [[] for _ in names]
            first = np.searchsorted(c.owner, np.arange(len(held)))
            for n, worded, hashes, where, _ in c.windows(lengths, cfg, bits):
                for h, i in zip(hashes.tolist(), where.tolist()):
                    k = c.owner[i]
                    for col, v in zip(out, (held[k][0], held[k][1], h, i - int(first[k]), None if worded else c.slots_of(i, n, canon.lows))):
                        col.append(v)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)

        for b in batches:
            held, size = [], 0
            if len(canon.memo) > 300_000:
                canon = Canon()
            for doc, row, t in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), b.column("text").to_pylist()):
                held.append((doc, row, canon.ids(t)))
                size += len(held[-1][2])
                if size > TOKENS_AT_ONCE:
                    yield found(held)
                    held, size = [], 0
                    if len(canon.memo) > 300_000:
                        canon = Canon()
            if held:
                yield found(held)

    return run


def agrees(pairs, known: dict[str, str]) -> dict[str, str] | None:
    """known with the pairs (benchmark value, value in the text) added, or None if one value would stand for two."""
    out = dict(known)
    for a, b in pairs:
        if out.setdefault(a, b) != b:
            return None
    return out


def judge(hits: list[tuple], total: int, n: int, cfg: LeakConfig) -> tuple[int, bool] | None:
    """Windows of the item that are covered, and whether a value was exchanged; None if the item is not contained.
    hits: (position in the text, position in the item, strong, pairs of values)."""
    lines: dict[int, dict[int, tuple[bool, tuple]]] = defaultdict(dict)
    for pos, at, strong, pairs in hits:
        was = lines[pos - at].get(at)
        lines[pos - at][at] = (strong or bool(was and was[0]), pairs)
    runs = []  # (length, changed, first place, diagonal, pairs)
    for diagonal, line in lines.items():
        at = sorted(k for k, (strong, _) in line.items() if strong)
        cuts = [0, *(i for i in range(1, len(at)) if at[i] != at[i - 1] + 1), len(at)]
        for lo, hi in zip(cuts, cuts[1:]):
            pairs = {p for k in at[lo:hi] for p in line[k][1]}
            if hi > lo and agrees(pairs, {}) is not None:
                runs.append((lo - hi, any(a != b for a, b in pairs), at[lo], diagonal, pairs))
    known: dict[str, str] = {}
    places, tokens, changed = set(), 0, False
    for size, exchanged, first, _, pairs in sorted(runs, key=lambda r: r[:4]):
        with_these = agrees(pairs, known)
        if with_these is not None:
            known, tokens, changed = with_these, max(tokens, n - size - 1), changed or exchanged
            places.update(range(first, first - size))
    if places and (len(places) / total >= cfg.cover or tokens >= cfg.run):
        return len(places), changed
    whole = []
    for line in lines.values():
        pairs = {p for _, ps in line.values() for p in ps}
        if len(line) == total and agrees(pairs, {}) is not None:
            whole.append(any(a != b for a, b in pairs))
    return (total, min(whole)) if whole else None


def _judge_task(cfg: LeakConfig):
    names = ["doc_id", "item_id", "windows", "item_windows", "reparameterised"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in names]
            for r in b.to_pylist():
                hits = [(h["pos"], h["item_pos"], h["strong"], tuple(zip(h["item_slots"], h["item_slots"] if h["slots"] is None else h["slots"]))) for h in r["hits"]]
                got = judge(hits, r["total"], r["n"], cfg)
                if got:
                    for col, v in zip(out, (r["doc_id"], r["item_id"], got[0], r["total"], got[1])):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, cfg: LeakConfig = LeakConfig()) -> DataFrame:
    """doc_id, item_id, contaminated (true), windows, item_windows, coverage, reparameterised: a row for each pair found.

    Rows that share a doc_id (or an item_id) are judged each alone; the pair has the figures of the two rows with the
    largest coverage, of equal ones an exact copy. Null and empty texts have no windows. Items of fewer tokens than the
    window are one window. Null ids are passed over. An empty table on either side gives no rows; further columns are not
    looked at."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item_row"), "text")
    windows = cut(items.mapInArrow(_item_task(cfg), "item_id long, item_row long, hash long, item_pos int, n int, total int, strong boolean, item_slots array<string>"))
    n = windows.count()
    bits = 1 << 16
    while bits < min(cfg.bits, 16 * n):
        bits *= 2
    byte = F.pmod("hash", F.lit(bits))
    filled = windows.groupBy(F.floor(byte / 8).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (byte % 8).cast("int"))).alias("x")).collect()  # at most bits / 8 rows
    bitmap = bytearray(bits // 8)
    for at, x in filled:
        bitmap[at] = x
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())  # at most `window` values
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    hits = texts.mapInArrow(_text_task(cfg, lengths, bytes(bitmap)), "doc_id long, row long, hash long, pos int, slots array<string>")
    known = F.broadcast(windows) if n <= BROADCAST_WINDOWS else windows
    pairs = hits.join(known, "hash").groupBy("doc_id", "row", "item_id", "item_row").agg(
        F.max("total").alias("total"), F.max("n").alias("n"), F.collect_set(F.struct("pos", "item_pos", "strong", "slots", "item_slots")).alias("hits")
    )  # a group is the windows of one text
    found = pairs.select("doc_id", "item_id", "total", "n", "hits").mapInArrow(_judge_task(cfg), "doc_id long, item_id long, windows int, item_windows int, reparameterised boolean")
    share = F.col("windows") / F.col("item_windows")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct(share.alias("share"), "windows", "item_windows", (~F.col("reparameterised")).alias("plain"))).alias("b"))
    return best.select("doc_id", "item_id", F.lit(True).alias("contaminated"), "b.windows", "b.item_windows", F.round("b.share", 6).alias("coverage"), (~F.col("b.plain")).alias("reparameterised"))


def clean(docs: DataFrame, benchmark: DataFrame, cfg: LeakConfig = LeakConfig()) -> DataFrame:
    """docs without the rows whose doc_id is contaminated; rows with a null id stay."""
    gone = fresh(docs, "_leaked")
    found = cut(leaks(docs, benchmark, cfg).select(F.col("doc_id").alias(gone)).distinct())
    return docs.join(found, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
