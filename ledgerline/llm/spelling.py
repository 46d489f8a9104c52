"""Spelling variants: words of a corpus that differ by one code point, grouped under their frequent form.

Comparing all words with all words is out of the question, and the one-edit neighbourhood of a word over 90 letters is
large. So letters are hashed to a few symbols: an edit of a word is an edit of its reduced word, or none. The reduced
words' whole one-edit neighbourhoods are generated and joined with the reduced vocabulary, which links every two reduced
words that can hold near words; the words behind a link are then verified on their original strings.

A reduced word is known by a 64-bit polynomial code, so that a neighbour's code follows from sums over its two ends, and a
word of L letters costs 2 x L x symbols numbers however long it is; two reduced words that share a code only add words to
verify. Where the two sides of a link have more than `pairs` pairs of words, their words are reduced anew with more symbols,
at last with one for each letter, instead of being paired: nothing is left out and no pair table grows with a crowded group."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.tables import remove, table

#: The letters, as Latin-1: a-z and U+00C0 to U+00FF; A-Z lower-cased, all else blank.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
LETTERS = bytes(b for b in range(256) if _TABLE[b] == b and b != 32)


@dataclass(frozen=True)
class SpellingConfig:
    typo: int = 199  # one of so many word occurrences loses a letter; 0: none
    least_letters: int = 6
    least: int = 5  # occurrences of a word
    times: int = 5  # a form is so many times as frequent
    symbols: tuple[int, ...] = (8, 32, 256)  # of the reduced alphabets, one after the other; the last tells all letters apart
    pairs: int = 4096  # of words that a link may stand for


def _word_task(cfg: SpellingConfig, most: int = 200_000):
    def run(batches):
        n: dict[bytes, int] = {}
        utf8: dict[bytes, bytes] = {}

        def flush():
            return pa.RecordBatch.from_pydict({"word": pa.array([w.decode("latin-1") for w in n], pa.string()), "n": pa.array(list(n.values()), pa.int64())})

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                words = (text or "").encode("latin-1", "replace").translate(_TABLE).split()
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                typed = {}  # words of this document that lose a letter: it is the same one each time
                if cfg.typo:
                    for w in set(words):
                        raw = w
                        if not w.isascii():
                            raw = utf8.get(w) or utf8.setdefault(w, w.decode("latin-1").encode())
                        h = zlib.crc32(raw, start)
                        if h % cfg.typo == 0:
                            k = h % len(w)
                            typed[w] = w[:k] + w[k + 1 :]
                if typed:
                    words = [typed.get(w, w) for w in words]
                for w in words:
                    n[w] = n.get(w, 0) + 1
                if len(n) > most:
                    yield flush()
                    n.clear()
                    utf8.clear()
        yield flush()

    return run


def vocabulary(docs: DataFrame, cfg: SpellingConfig = SpellingConfig()) -> DataFrame:
    """word, n: the words of docs that are long and frequent enough. Each task sums its own words before they are shuffled."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_word_task(cfg), "word string, n long")
    long = rows.where(F.length("word") >= cfg.least_letters)
    return long.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= cfg.least)


# Reduced words ------------------------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15  # odd
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def symbol_of(symbols: int) -> dict[int, int]:
    """Letter -> symbol. A hash while symbols are few; one for each letter once they are as many as letters."""
    if symbols >= len(LETTERS):
        return {b: i for i, b in enumerate(LETTERS)}
    return {b: zlib.crc32(bytes([b])) % symbols for b in LETTERS}


_REDUCERS: dict[int, np.ndarray] = {}


def _reducer(symbols: int) -> np.ndarray:
    if symbols not in _REDUCERS:
        out = np.zeros(256, np.uint8)
        for b, s in symbol_of(symbols).items():
            out[b] = s
        _REDUCERS[symbols] = out
    return _REDUCERS[symbols]


def _values(symbols: int) -> np.ndarray:
    """A 64-bit number for each symbol."""
    x = (np.arange(min(symbols, len(LETTERS)), dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def codes(rows: np.ndarray, symbols: int) -> np.ndarray:
    """The code of each row of symbols, all of one length."""
    return (_values(symbols)[rows] * _powers(rows.shape[1])).sum(1, dtype=np.uint64).view(np.int64)


def neighbours(rows: np.ndarray, symbols: int) -> np.ndarray:
    """The codes of all words of one edit or none from each row."""
    v, p = _values(symbols), _powers(rows.shape[1] + 1)
    n, size = rows.shape
    x = v[rows] * p[:size]
    left = np.zeros((n, size + 1), np.uint64)
    np.cumsum(x, 1, dtype=np.uint64, out=left[:, 1:])
    whole = left[:, -1:]
    right = whole - left  # from each place on
    deleted = left[:, :-1] + right[:, 1:] * _INVERSE
    replaced = (whole - x)[:, :, None] + v * p[:size, None]
    inserted = (left + right * np.uint64(_BASE))[:, :, None] + v * p[:, None]
    return np.concatenate([whole, deleted, replaced.reshape(n, -1), inserted.reshape(n, -1)], 1).view(np.int64)


def _by_length(words: list[str], symbols: int, most: int = 200_000):
    """Indices of words of one length, and their symbols, so many letters at a time."""
    size = np.array([len(w) for w in words], np.int64)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        step = max(1, most // int(n))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            raw = np.frombuffer("".join(words[i] for i in part).encode("latin-1"), np.uint8).reshape(len(part), n)
            yield part, _reducer(symbols)[raw]


def _code_task(symbols: int):
    def run(batches):
        for b in batches:
            out = np.zeros(b.num_rows, np.int64)
            for at, rows in _by_length(b.column("word").to_pylist(), symbols):
                out[at] = codes(rows, symbols)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "code"])

    return run


def _neighbour_task(symbols: int, most: int):
    """A link is found from both of its sides; it is kept on the side of the lesser code."""

    def run(batches):
        for b in batches:
            for _, rows in _by_length(b.column("word").to_pylist(), symbols, most // (2 * symbols + 2)):
                own, near = codes(rows, symbols), np.sort(neighbours(rows, symbols), 1)
                keep = near >= own[:, None]
                keep[:, 1:] &= near[:, 1:] != near[:, :-1]
                yield pa.RecordBatch.from_pydict({"low": pa.array(np.repeat(own, keep.sum(1))), "high": pa.array(near[keep])})

    return run


def _join(a: DataFrame, b: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """a join b by a shuffle of both sides, which all grow with the vocabulary. Left to itself, Spark broadcasts one that it sizes
    too low: a neighbourhood as if it had a row for each word, a Parquet table at its compressed size."""
    return a.join(b.hint("merge"), on, how)


def near(vocab: DataFrame, cfg: SpellingConfig = SpellingConfig()) -> DataFrame:
    """word, n, near, near_n: each two words of vocab that differ by one code point, once from either side. vocab is read
    several times, so pass a table."""
    found, left = None, vocab
    for k, symbols in enumerate(cfg.symbols):
        coded, _ = table(left.mapInArrow(_code_task(symbols), "word string, n long, code long"), "reduced")
        reduced = F.col("word") if symbols >= len(LETTERS) else F.translate("word", LETTERS.decode("latin-1"), "".join(chr(0xC0 + symbol_of(symbols)[b]) for b in LETTERS))
        classes = coded.groupBy("code").agg(F.count("*").alias("size"))
        # any word stands for its reduced word, but two reduced words may share a code
        stand = coded.groupBy(reduced.alias("_reduced")).agg(F.min("word").alias("word")).select("word")
        around = stand.mapInArrow(_neighbour_task(symbols, 2_000_000), "low long, high long")
        linked = _join(around, classes.select(F.col("code").alias("high"), F.col("size").alias("high_size")), "high")
        linked = _join(linked, classes.select(F.col("code").alias("low"), F.col("size").alias("low_size")), "low").dropDuplicates(["low", "high"])
        links, _ = table(linked, "links")
        heavy = (F.col("low_size") * F.col("high_size") > cfg.pairs) if k + 1 < len(cfg.symbols) else F.lit(False)
        a = coded.select(F.col("code").alias("low"), "word", "n")
        b = coded.select(F.col("code").alias("high"), F.col("word").alias("near"), F.col("n").alias("near_n"))
        pairs = _join(_join(links.where(~heavy).select("low", "high"), a, "low"), b, "high")
        pairs = pairs.where((F.col("low") != F.col("high")) | (F.col("word") < F.col("near")))
        pairs = pairs.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")
        found = pairs if found is None else found.unionByName(pairs)
        crowded = links.where(heavy)
        if not crowded.take(1):
            break
        some = crowded.select(F.explode(F.array("low", "high")).alias("code")).distinct()
        left, _ = table(_join(coded, some, "code", "left_semi").select("word", "n"), "crowded")
    both, _ = table(found.unionByName(found.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))), "near")
    return both.distinct() if k else both  # a pair of crowded words can also have been met in a lighter link


def roots(forms: DataFrame) -> DataFrame:
    """word, root of each row of forms (word, form): its form's form's ... form, the word itself if it has none. Each round
    joins the roots so far with themselves, so a chain of n forms takes log2(n) rounds."""
    now, path = table(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = now.where(F.col("root") != F.col("word")).select(F.col("word").alias("root"), F.col("root").alias("_next"))
        new, old = _join(now, ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), path
        new, path = table(new, "roots")
        remove(forms.sparkSession, old)
        now = new.drop("_moved")
        if not new.where("_moved").take(1):
            return now


def variants(docs: DataFrame, cfg: SpellingConfig = SpellingConfig()) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word of docs: n_near words of the vocabulary are one inserted, deleted
    or replaced code point away; form is the most frequent of them (ties: the first in code-point order) if it is `times` as
    frequent as the word, else null; root is the end of the chain of forms. Null and empty texts have no words; rows without
    id are read as if their id were empty; repeated rows count as often as they are there. No words: no rows."""
    vocab, _ = table(vocabulary(docs, cfg), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("_best")
    met = near(vocab, cfg).groupBy("word").agg(F.count("*").alias("n_near"), best)
    holds = -F.col("_best.m") >= cfg.times * F.col("n")
    out = _join(vocab, met, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(holds, F.col("_best.w")).alias("form"),
        F.when(holds, -F.col("_best.m")).alias("form_n"),
    )
    out, _ = table(out, "variants")
    return _join(out, roots(out.select("word", "form")), "word").select("word", "form", "root", "n", "n_near", "form_n")
