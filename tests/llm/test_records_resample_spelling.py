"""op11 to op13 against brute force, exact round trips, and odd rows."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import queries, radix, records, resample, spelling
from ledgerline.llm.tables import scratch

SF = "/root/testdata/sf0.001"
SPEC = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
SCHEMA = "doc_id long, text string, lang string, file string, offset long, n long, word string, _hash long, bucket string"
#: Null id and texts, blank, long and repeated texts, other scripts, equal rows, clashing extra columns.
ODD = [(4, "a"), (1, None), (2, ""), (3, "  \n"), (5, " ".join(f"Word{i % 977}é" for i in range(20_000))), (7, "same text here"), (7, "same text here"), (7, "other"), (8, "same text here"), (None, "no id"), (None, None), (9, "日本語 ✓ é́ x\x1c!y ÀÉ×÷ß"), (10, "x" * 100_000), (-6, "<|endoftext|> it's\tI'LL a<|startoftext|>b    1234")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "f", 0, 1, "w", 5, "b") for i, t in rows], SCHEMA)


def docs(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


# 11 -----------------------------------------------------------------------------------------------------------------


def plain_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids + [2] for e in Tokenizer.from_str(SPEC).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_crc32c_is_the_known_one():
    def slow(data):
        x = 0xFFFFFFFF
        for b in data:
            x ^= b
            for _ in range(8):
                x = (x >> 1) ^ (0x82F63B78 if x & 1 else 0)
        return x ^ 0xFFFFFFFF

    assert slow(b"123456789") == 0xE3069283
    rng = np.random.default_rng(0)
    parts = [b"123456789", *[rng.bytes(int(n)) for n in [4, 5, 63, 64, 65, 127, 128, 129, 1000, 4097, *rng.integers(4, 700, 40)]]]
    assert records.crc32c(parts).tolist() == [slow(p) for p in parts]
    assert records.crc32c([]).tolist() == []
    assert records.masked(np.array([0], np.uint32)).tolist() == [0xA282EAD8]


def test_records_match_the_tokenizer_on_whole_texts(spark):
    got = [tuple(r) for r in queries.op11_token_records(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("doc_id").collect()]
    rows = sorted((r.doc_id, r.text) for r in docs(spark).collect())
    want, start = [], 0
    for (d, _), ids in zip(rows, plain_ids([t for _, t in rows])):
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


@pytest.mark.parametrize("whole", [False, True])
def test_records_of_odd_rows(spark, whole):
    uri = scratch(spark, "records")
    index = records.write(table(spark, ODD).repartition(3), uri, SPEC, whole=whole)
    by_text = dict(zip([t for _, t in ODD], plain_ids([t for _, t in ODD])))
    assert index.count() == len(ODD)
    got = records.read(spark, uri, records.RecordConfig(block=1000)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -6, 1, 2, 3, 4, 5, 7, 7, 7, 8, 9, 10]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got][:-1]]).tolist()
    want = Counter((i, len(by_text[t]), zlib.crc32(np.array(by_text[t], "<u4").tobytes())) for i, t in ODD)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want


def test_records_read_in_shuffled_order(spark):
    uri = scratch(spark, "records")
    d = docs(spark)
    records.write(d, uri, SPEC)
    one, again, other = (records.shuffled(spark, uri, s).collect() for s in (1, 1, 2))
    assert [r.at for r in one] == sorted(r.at for r in one) and one == again
    assert [r.doc_id for r in one] != [r.doc_id for r in other] and [r.doc_id for r in one] != sorted(r.doc_id for r in one)
    rows = d.collect()
    assert {r.doc_id: r.ids for r in one} == dict(zip([r.doc_id for r in rows], plain_ids([r.text for r in rows])))


def test_damage_is_seen_and_lost_attempts_do_not_count(spark):
    made = b"".join(records.frames([b"\1\0\2\0", b"\3\0\2\0"], [5, None], 2))
    assert [(d, ids.tolist()) for d, ids in records.parse(made)] == [(5, [1, 2]), (None, [3, 2])]
    length, _ = struct.unpack_from("<QI", made)
    assert length == records.PAYLOAD.size + 4
    for at in range(len(made)):
        with pytest.raises(ValueError):
            records.parse(made[:at] + bytes([made[at] ^ 4]) + made[at + 1 :])
    for n in (1, 11, 20, len(made) - 1):
        with pytest.raises(ValueError):
            records.parse(made[:n])
    uri = scratch(spark, "records")
    store, folder = records.fs.FileSystem.from_uri(uri)
    store.create_dir(f"{folder}/data", recursive=True)
    with store.open_output_stream(f"{folder}/data/00000000-dead.records") as f:
        f.write(made[:20])
    records.write(table(spark, ODD), uri, SPEC)
    assert records.read(spark, uri).count() == len(ODD)
    assert not [f for f in store.get_file_info(records.fs.FileSelector(f"{folder}/data")) if "dead" in f.base_name]
    with pytest.raises(ValueError, match="damaged|cut"):
        records.parse(b"\0" * 11)


def test_records_of_no_rows(spark):
    uri = scratch(spark, "records")
    assert records.write(table(spark, []), uri, SPEC).count() == 0
    assert records.read(spark, uri).collect() == [] and records.shuffled(spark, uri, 1).collect() == []


# 12 -----------------------------------------------------------------------------------------------------------------


def slow_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def slow_resample(rows, target, buckets=10000, least=20, percent=5):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(place, slow_features(x)[1]))
    for x in target:
        t.update(map(place, slow_features(x)[1]))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets))))
    out = []
    for d, x in rows:
        words, f = slow_features(x)
        w = sum(gain(place(y)) for y in f)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    can = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    rank = {id(x): k + 1 for k, x in enumerate(can[: percent * len(can) // 100])}
    return [(*x[:4], rank.get(id(x))) for x in out]


def test_resample_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in docs(spark).collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = [tuple(r) for r in queries.op12_importance_resampling(spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(got) == sorted(slow_resample(rows, target)) and sum(r[4] is not None for r in got) > 5


def test_resample_of_odd_rows(spark):
    rows = [*ODD, (11, "w" * 70 + " a " + "é" * 40 + " b"), (12, " ".join(["tie"] * 30)), (13, " ".join(["tie"] * 30)), (14, "0a Ab-c_d")]
    cfg = resample.ResampleConfig(least_words=2, percent=100)
    target = table(spark, [(1, "same text"), (2, None), (3, "w" * 70 + " a")])
    got = [tuple(r) for r in resample.resample(table(spark, rows), target, cfg).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    want = slow_resample(rows, ["same text", None, "w" * 70 + " a"], least=2, percent=100)
    assert Counter(r[:4] for r in got) == Counter(r[:4] for r in want)
    assert sorted(r[4] for r in got if r[4]) == sorted(r[4] for r in want if r[4])
    assert [r[3] for r in sorted((r for r in got if r[4]), key=lambda r: r[4])] == sorted((r[3] for r in got if r[4]), reverse=True)
    assert resample.resample(table(spark, []), target).count() == 0
    assert resample.resample(table(spark, rows), table(spark, [])).count() == len(rows)


def test_hasher_forgets_without_changing(spark):
    h = resample.Hasher(resample.ResampleConfig())
    h.KNOWN = 3
    text = [resample.words_of(x) for x in ("a bb ccc dddd", "", "e", "bb ccc " + "z" * 200 + " a")]
    for _ in range(3):
        places, owner = h.features(text)
        want = Counter((k, zlib.crc32(" ".join(w.decode() for w in d[i : i + n]).encode()) % 10000) for k, d in enumerate(text) for n in (1, 2, 3) for i in range(len(d) - n + 1))
        assert Counter(zip(owner.tolist(), places.tolist())) == want


@pytest.mark.parametrize("spread", [1, 3_000, 1 << 62])
def test_radix_ranks(spark, spread):
    rng = np.random.default_rng(spread)
    rows = [(int(a) if a % 7 else None, int(b)) for a, b in zip(rng.integers(-spread, spread + 1, 5_000), rng.integers(-9, 9, 5_000))]
    rows += [(-(1 << 63), 0), ((1 << 63) - 1, 0)] if spread > 1 << 60 else []
    rows += [(5, 5)] * 3_000
    df = spark.createDataFrame(rows, "a long, b long")
    got = [(r.b, r.a, r.at) for r in radix.ranked(df, ["b", "a"], "at", digit=8, chunk=(64, 256))[0].collect()]
    assert sorted(x[2] for x in got) == list(range(len(rows)))
    got.sort(key=lambda x: x[2])
    assert [x[:2] for x in got] == sorted(((b, a) for a, b in rows), key=lambda x: (x[0], x[1] is None, x[1] or 0))
    assert radix.ranked(df.limit(0), ["b", "a"], "at")[0].count() == 0


# 13 -----------------------------------------------------------------------------------------------------------------


def slow_vocabulary(rows, typo=199):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w if h % typo else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


COLS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants_match_brute_force(spark):
    want = slow_variants(slow_vocabulary([(r.doc_id, r.text) for r in docs(spark).collect()]))
    got = [tuple(r) for r in queries.op13_spelling_variants(spark, SF).select(*COLS).collect()]
    assert len(got) == len(want) > 500 and set(got) == want and sum(w[1] is not None for w in want) > 3


@pytest.mark.parametrize("symbols, pairs", [((2, 4, 256), 1), ((8, 256), 0), ((256,), 10)])
def test_crowded_links_are_reduced_anew_and_lose_nothing(spark, symbols, pairs):
    words = [f"{a}{b}cd{c}f" for a in "abcdé" for b in "xyz" for c in "aeiouÿ"] + ["lettré", "lettre", "letters", "letres"]
    rows = [(i, " ".join([w] * (5 + 7 * (i % 5)))) for i, w in enumerate(words)]
    cfg = spelling.SpellingConfig(typo=0, symbols=symbols, pairs=pairs)
    got = [tuple(r) for r in spelling.variants(table(spark, rows), cfg).select(*COLS).collect()]
    assert len(got) == len(words) and set(got) == slow_variants({w: 5 + 7 * (i % 5) for i, w in enumerate(words)})


def test_variants_chains_odd_rows_and_none(spark):
    chain = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "zzzzzz": 5, "zzzzzy": 25, "zzzzyz": 25}
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(chain.items())]
    got = {r.word: r for r in spelling.variants(table(spark, rows), spelling.SpellingConfig(typo=0)).collect()}
    assert {w: got[w].root for w in chain} == {w: ("aabbbb" if w[0] == "a" else "zzzzyz" if w == "zzzzzz" else w) for w in chain}
    long = "q" * 5_000
    rows = [*ODD, *[(20 + k, f"{long} {long}é ÉCOLES écoleś ÀÉ×÷ßx") for k in range(6)], *[(None, "nobody's letters")] * 7]
    n = slow_vocabulary(rows)
    assert long in n and "Écoles" in n and "letters" in n and "Àé×÷ßx" not in n
    got = {tuple(r) for r in spelling.variants(table(spark, rows)).select(*COLS).collect()}
    assert got == slow_variants(n)
    assert spelling.variants(table(spark, [(1, None), (2, "")])).count() == 0 and spelling.variants(table(spark, [])).count() == 0


def test_typos_are_made_per_document(spark):
    rows = [(d, " ".join(["Spelling"] * 3)) for d in range(2_000)]
    got = {r.word: r.n for r in spelling.vocabulary(table(spark, rows)).collect()}
    assert got == slow_vocabulary(rows) and len(got) > 1
    assert spelling.vocabulary(table(spark, rows).withColumn("text", F.upper("text"))).where("word = 'spelling'").count() == 1


def test_variants_broadcast_no_table(spark):
    """A neighbourhood has some hundred rows for each word, and Spark sizes it as if it had one."""
    rows = [(i, " ".join([f"{a}{b}cd{c}f"] * 5)) for i, (a, b, c) in enumerate((a, b, c) for a in "abcdé" for b in "xyz" for c in "aeiou")]
    ran = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    before = {x.executionId() for x in map(ran().apply, range(ran().size()))}
    # two levels of the alphabet, so that crowded links are met too
    assert spelling.variants(table(spark, rows), spelling.SpellingConfig(typo=0, symbols=(2, 256), pairs=1)).count() == len(rows)
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [x.physicalPlanDescription() for x in map(ran().apply, range(ran().size())) if x.executionId() not in before]
    assert any("MapInArrow" in p for p in plans) and sum("SortMergeJoin" in p for p in plans) >= 6
    assert not any("Broadcast" in p for p in plans)
