"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import itertools
import math
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import decontam, exact_dedup, langid, license, lm, ngram_join, packing, ranking, sharding, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket string, digest string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1.0, "x", "y") for i, t in rows], SCHEMA)


def odd(spark):
    """Null id and texts, blank, short and long texts, repeated rows, equal texts, clashing extra columns."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return table(spark, [(1, None), (2, ""), (3, "  \n"), (4, "a"), (5, long), (6, long), (7, "same text here for all of us"), (7, "same text here for all of us"), (8, "same text here for all of us"), (None, "no id at all"), (9, "日本語 ✓ é"), (10, "x" * 200_000)])


def docs(spark, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")


# 1 ------------------------------------------------------------------------------------------------------------------


def test_lm_base_score_and_counts_match_brute_force(spark):
    d = docs(spark)
    got = {r.doc_id: r for r in lm.score_documents(d, lm.LmConfig(head=50)).collect()}  # a small head: most words are joined
    rows = d.select("doc_id", "text").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows}
    counts = Counter()
    for r in rows:
        if not held[r.doc_id]:
            counts.update(lm.words_of(r.text))
            counts[b""] += 1
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        words = [*lm.words_of(r.text), b""]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        g = got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[r.doc_id], len(words), sum(counts[w] > 0 for w in words), n)
        assert g.base_score == pytest.approx(base, rel=1e-9)


def test_lm_end_and_head_are_exact_where_counts_tie(spark):
    rows = [(i, " ".join(f"t{k}" for k in range(30))) for i in (1, 2, 4)]
    assert all(zlib.crc32(str(i).encode()) % 10 for i, _ in rows)
    model = lm.fit(table(spark, rows), lm.LmConfig(head=10))
    assert len(model.head) == 10 and model.ends == 3 and len(model.own) == 11
    for head in (10, 200):
        got = lm.score_documents(table(spark, rows), lm.LmConfig(head=head)).collect()
        base = sum(math.log10(3.1 / (93 + 0.1 * 32)) for _ in range(31))
        assert all(r.n_known == r.n_tokens == 31 and r.base_score == pytest.approx(base) for r in got)


SMALL = lm.LmConfig(groups=4, members=5, tail_classes=12, dim=6)


def test_lm_probabilities_sum_to_one_and_learn(spark):
    model = lm.fit(docs(spark).where(~lm.held_out(10, 0)), SMALL)
    inside = sum(n for n, _ in model.tail) + model.ends + sum(model.head[w] for w in model.own if w)
    assert inside == model.tokens and len(model.own) == 20  # every training token is an outcome or in a class
    net, rng = lm.Network(model.params, SMALL), np.random.default_rng(0)
    for _ in range(20):
        before = rng.integers(0, 32, lm.CONTEXT)
        p = np.exp(net.log_probs(np.concatenate([np.array([*before, y]) for y in range(32)]), np.arange(32) * 3 + 2))
        assert p.sum() == pytest.approx(1, abs=1e-4)
    few = lm.fit(table(spark, [(1, "a b a"), (2, "b")]), SMALL)  # outputs that no word has take nothing
    net = lm.Network(few.params, SMALL)
    p = np.exp(net.log_probs(np.array([x for y in [0, 1, 2, *range(20, 32)] for x in (1, 2, y)]), np.arange(15) * 3 + 2))
    assert p.sum() == pytest.approx(1, abs=1e-4)
    got = lm.score_documents(docs(spark, "sf0.01")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_lm_score_matches_brute_force(spark):
    """Each text's probability by the formula, word by word, from the model's parameters."""
    cfg = replace(SMALL, head=60)
    d = docs(spark)
    model = lm.fit(d.where(~lm.held_out(10, 0)), cfg)
    counts = {bytes(r.word): r.n for r in model.counts.collect()}
    p = {k: v.astype(np.float64) for k, v in model.params.items()}
    members = defaultdict(list)
    for w in counts:
        if w not in model.own:
            members[lm.tail_class(w, 12)].append(w)
    number = lambda w: model.own.get(w, 20 + lm.tail_class(w, 12))
    softmax = lambda s: np.exp(s - s.max()) / np.exp(s - s.max()).sum()
    got = {r.doc_id: r.score for r in lm.score(d, model).collect()}
    for r in d.limit(40).collect():
        words, total = [b"", b"", *lm.words_of(r.text), b""], 0.0
        for i in range(2, len(words)):
            h = p["r"][number(words[i - 1])] @ p["c"][0] + p["r"][number(words[i - 2])] @ p["c"][1]
            top, k = softmax(p["q"] @ h + p["b"]), number(words[i])
            if k < 20:
                chance = top[k // 5] * softmax(p["w"][k // 5 * 5 : k // 5 * 5 + 5] @ h + p["v"][k // 5 * 5 : k // 5 * 5 + 5])[k % 5]
            else:
                all_n = sum(counts[w] for w in members[k - 20])
                chance = top[4 + k - 20] * (counts.get(words[i], 0) + 0.1) / (all_n + 0.1 * (len(members[k - 20]) + 1))
            total += math.log10(chance)
        assert got[r.doc_id] == pytest.approx(total, rel=1e-4)


def test_lm_noise_contrastive_training_nears_the_normalised_model():
    """On a Markov chain: held-out log-probability after NCE against the chain itself and a full softmax model."""
    cfg, rng = lm.LmConfig(groups=3, members=4, tail_classes=2, dim=8, noise=16, batch=256, rate=0.3), np.random.default_rng(5)
    chain = rng.dirichlet(np.full(12, 0.3), 12)
    walk = [0]
    for _ in range(40_000):
        walk.append(int(rng.choice(12, p=chain[walk[-1]])))
    ids = np.array(walk)
    uni = np.bincount(ids, minlength=12) / len(ids)
    mass = uni.reshape(3, 4).sum(1)
    top, inner = np.concatenate([mass * 0.999, [0.0005, 0.0005]]), uni / np.repeat(mass, 4)
    p, noise = lm.start(top, inner, cfg), lm.Noise(top, inner, cfg)
    sums, at = {k: np.full_like(v, 1e-4) for k, v in p.items()}, np.arange(2, 36_000)
    for turn in range(6):
        for k in range(0, len(at), cfg.batch):
            a = at[k : k + cfg.batch]
            lm.nce_step(p, sums, np.stack([ids[a - 1], ids[a - 2]]), ids[a], noise, rng, cfg, cfg.rate / (1 + turn))
    test = np.arange(36_002, len(ids))
    nce = lm.Network(p, cfg).log_probs(ids, test).mean()
    w = np.zeros((12, 12))  # the best bilinear model of one token before has a free table: full softmax by gradients
    for _ in range(400):
        s = np.exp(w) / np.exp(w).sum(1, keepdims=True)
        n = np.zeros((12, 12))
        np.add.at(n, (ids[:35_999], ids[1:36_000]), 1)
        w += 2 * (n / np.maximum(n.sum(1, keepdims=True), 1) - s)
    s = np.exp(w) / np.exp(w).sum(1, keepdims=True)
    full, true, plain = np.log(s[ids[test - 1], ids[test]]).mean(), np.log(chain[ids[test - 1], ids[test]]).mean(), np.log(uni[ids[test]]).mean()
    assert plain + 0.3 < full and full - 0.05 < nce <= true + 0.02


def test_lm_odd_rows(spark):
    got = lm.score_documents(odd(spark)).collect()
    assert len(got) == 12 and all(r.n_tokens >= 1 and r.score < 0 for r in got)
    assert [r.n_tokens for r in got if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert next(r for r in got if r.doc_id is None).held_out
    assert lm.score_documents(table(spark, [])).collect() == []


# 2 ------------------------------------------------------------------------------------------------------------------


def test_bounds_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        hist = [(int(x), int(n)) for x, n in zip(sorted(rng.choice(40, rng.integers(1, 9), replace=False)), rng.integers(1, 9, 9))]
        k = int(rng.integers(1, 5))
        cost = lambda tops: sum(n * min(t for t in tops if t >= x) for x, n in hist)
        best = min(cost([*c, hist[-1][0]]) for r in range(min(k, len(hist))) for c in itertools.combinations([x for x, _ in hist[:-1]], r))
        got = packing.bounds(hist, k)
        assert len(got) <= k and got == sorted(got) and cost(got) == best


def test_packing_pads_least_at_any_length(spark):
    """The whole query against every choice of bounds, with lengths above and below 1,024; then in bins."""
    lens = [0, 1, 1, 7, 7, 7, 1024, 1025, 1030, 2001, 2001, 2002, 9000]
    d = table(spark, [(i, " ".join(["w"] * n)) for i, n in enumerate(lens)])
    for k in (1, 2, 3, 4):
        top = sorted(set(lens))
        best = min(sum(min(t for t in (*c, top[-1]) if t >= n) for n in lens) for r in range(k) for c in itertools.combinations(top[:-1], r))
        assert sum(r.bucket_tokens for r in packing.pack(d, packing.PackConfig(buckets=k)).collect()) == best
        assert best <= sum(r.bucket_tokens for r in packing.pack(d, packing.PackConfig(buckets=k, exact=3)).collect()) <= best * (1 + 1 / 512)
    assert {r.bucket_tokens for r in packing.pack(table(spark, [(1, "w " * 2001), (2, "w " * 2001)])).collect()} == {2001}


def test_packing_keeps_every_row_within_budget(spark):
    d = docs(spark)
    cfg = packing.PackConfig(buckets=5, budget=2000)
    got = packing.pack(d, cfg).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in d.select("doc_id").collect())
    text = {r.doc_id: len((r.text or "").split()) for r in d.collect()}
    batches = defaultdict(list)
    for r in got:
        assert r.n_tokens == text[r.doc_id] <= r.bucket_tokens
        batches[r.batch].append(r)
    assert sorted(batches) == list(range(len(batches)))
    for b in batches.values():
        assert len({r.bucket for r in b}) == 1 and sorted(r.place for r in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0].bucket_tokens <= cfg.budget
    assert packing.pack(table(spark, [])).collect() == []
    assert packing.pack(odd(spark)).count() == 12


# 3 ------------------------------------------------------------------------------------------------------------------


def test_leaks(spark):
    item = "Alice has 3 apples and buys 4 more at the market so how many apples does Alice have now"
    bench = spark.createDataFrame([(9, item), (10, "tiny item"), (11, None)], "item_id long, text string")
    rows = [
        (1, f"Some words before. {item.upper()} and after"),
        (2, item.replace("Alice", "Bob").replace("3", "12").replace("4", "7")),
        (3, item.replace("Alice", "Bob", 1)),  # two people: not the same question
        (4, "Nothing of the kind is in this text, which only talks about the weather of last year"),
        (5, None),
        (6, ""),
        (7, " ".join(["Bob"] * 40)),
    ]
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(table(spark, rows), bench).collect()}
    assert set(got) == {(1, 9), (2, 9)}
    assert not got[1, 9].reparameterised and got[2, 9].reparameterised and got[2, 9].coverage == 1.0
    assert {r.doc_id for r in decontam.clean(table(spark, rows), bench).collect()} == {3, 4, 5, 6, 7}
    assert decontam.leaks(odd(spark), bench).count() == 0
    assert decontam.leaks(table(spark, []), bench.limit(0)).count() == 0


def test_leaks_by_row_and_run(spark):
    item = "Alice has 3 apples and buys 4 more at the market so how many apples does Alice have now"
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    rows = [
        (1, item.replace("3", "7").replace("4", "7")),  # two values become equal
        (2, item),
        (2, item.replace("3", "5").replace("4", "6")),  # another row of the id, with other values
        (3, item.replace("Alice", "Bob", 1).replace("at the market", "in the market").replace("Alice", "Carol")),
        (4, item.replace("Alice", "Bob", 1)),
    ]
    got = {r.doc_id: r for r in decontam.leaks(table(spark, rows), bench).collect()}
    assert got[1].coverage == 1.0 and got[1].reparameterised
    assert got[2].coverage == 1.0 and not got[2].reparameterised
    far = item + " if the shop is open until late in the evening and the road from the village to the town is free of snow"
    bench = spark.createDataFrame([(9, far)], "item_id long, text string")
    text = far.replace("Alice", "Bob", 1).replace("at the market", "in that market")  # Bob's and Alice's runs are apart
    assert {r.doc_id for r in decontam.leaks(table(spark, [(1, text)]), bench).collect()} == {1}


def test_leaks_finds_a_short_excerpt_of_a_long_item(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    bench = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    rows = [(1, " ".join(["before", *words[40:53], "after"])), (2, " ".join(["before", *words[40:52], "after"])), (3, " ".join(words[100:150]))]
    got = {r.doc_id: r.windows for r in decontam.leaks(table(spark, rows), bench).collect()}
    assert got == {1: 6, 3: 43}


def tokens_of(text):
    """(lower-cased word, placeholder or None) of each token, and whether a sentence end stands before and after it."""
    raw, out, kind_before = [*decontam.TOKEN.findall(text or ""), "\n"], [], "stop"
    ends = [not (t[0].isalnum() or t in "$€£¥%°") for t in raw]
    for i, t in enumerate(raw):
        low, kind = t.lower(), "word"
        if t[0].isdigit() or low in decontam.NUMBERS:
            kind = "number"
        elif low in decontam.UNITS and (kind_before == "number" or t in "$€£¥"):
            kind = "unit"
        elif ends[i]:
            kind = "stop"
        elif t[0].isupper() and low not in decontam.UNITS and (low in decontam.NAMES or (kind_before != "stop" and not (len(t) > 1 and t.isupper()))):
            kind = "name"
        if not ends[i]:
            out.append((low, kind if kind in ("number", "unit", "name") else None, i == 0 or ends[i - 1], ends[i + 1]))
        kind_before = kind if low not in decontam.UNITS or kind == "number" else "unit"
    return out


def brute_leak(text, item, cfg=decontam.LeakConfig()):
    """Windows of the item that the text covers, by comparing every window of the one with every window of the other."""
    a, b = tokens_of(item), tokens_of(text)
    n = min(cfg.window, len(a))
    if not n:
        return None
    total, lines = len(a) - n + 1, defaultdict(dict)
    for i in range(total):
        for j in range(len(b) - n + 1):
            x, y = a[i : i + n], b[j : j + n]
            same = [t[0] for t in x] == [t[0] for t in y]
            slots = sum(t[1] is not None for t in x)
            shaped = slots and n > slots and sum(t[1] is None for t in a) >= cfg.few and [t[1] or t[0] for t in x] == [t[1] or t[0] for t in y] and [t[1] for t in x] == [t[1] for t in y]
            if n < cfg.literal:
                same, shaped = same and y[0][2] and y[-1][3] and (n > 1 or len(b) == 1), False
            if same or shaped:
                lines[j - i][i] = (same or n - slots >= min(cfg.literal, n - 1), {(s[1], s[0], t[0]) for s, t in zip(x, y) if s[1]})
    one_to_one = lambda pairs: len({p[:2] for p in pairs}) == len(pairs)
    runs = []
    for d, line in lines.items():
        strong = [i for i in sorted(line) if line[i][0]]
        for i in strong:
            if i - 1 not in strong:
                length = next(k for k in itertools.count(1) if i + k not in strong)
                pairs = set().union(*(line[k][1] for k in range(i, i + length)))
                if one_to_one(pairs):
                    runs.append((-length, any(p[1] != p[2] for p in pairs), i, d, pairs))
    known, places, longest = set(), set(), 0
    for length, _, i, _, pairs in sorted(runs, key=lambda r: r[:4]):
        if one_to_one(known | pairs):
            known, longest = known | pairs, max(longest, n - length - 1)
            places |= set(range(i, i - length))
    if len(places) / total >= cfg.cover or longest >= cfg.run:
        return len(places)
    return total if any(len(line) == total and one_to_one(set().union(*(p for _, p in line.values()))) for line in lines.values()) else None


QUESTIONS = (
    "{A} has {n} apples and buys {m} more at the market so how many apples does {A} have now",
    "A train leaves the station at {n} km per hour and {A} rides it for {m} hours before meeting {B} in the old town",
    "{n} + {m} * {k} - {n} / {m} = {k} so what",
    "If {A} gives {B} {n} dollars and {B} gives back {m} then who owes {k} dollars to the other one in the end",
    "what is {n} times {m}",
    "Fill {n} {m} {k} {n} {m} {k} {n} then stop",
    "Mix {n} ml of oil with {m} ml of water and wait {k} minutes until the layers of both have parted again in the glass",
    "tiny item",
    "word",
)


def test_leaks_match_brute_force_on_changed_questions(spark):
    rng = np.random.default_rng(8)
    names, many = ["Alice", "Bob", "Carol", "David"], lambda: str(rng.integers(2, 90))
    fill = lambda q, one=False: q.format(A=names[rng.integers(2)], B=names[2 + rng.integers(2)], n=many(), m=many(), k=(x := many()), **{}) if not one else q.format(A="Alice", B="Carol", n=5, m=5, k=5)  # noqa: E731, F841
    items = [fill(q) for q in QUESTIONS]
    prose = "the weather of the last year was mild and the river stayed low in most of the valley"
    texts, planted = [], []
    for k, q in enumerate(QUESTIONS):
        for form in (items[k], fill(q), fill(q), fill(q, True), items[k].upper()):
            for where in ("{}", prose + ". {}. " + prose, prose + " {} " + prose):
                if form not in (items[k], items[k].upper()) and k < 7:
                    planted.append(len(texts))
                texts.append(where.format(form))
        half = items[k].split()
        texts += [" ".join(half[: len(half) * 2 // 3]), " ".join([*half[:9], "really", *half[9:]]), items[k].replace("Alice", "Erin", 1), items[k] + ". " + fill(q)]
    texts += [prose, "3 4 5 6 7 8 9 10 11 12", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.windows for r in decontam.leaks(table(spark, list(enumerate(texts))), bench).collect()}
    want = {(i, k): w for i, t in enumerate(texts) for k, q in enumerate(items) if (w := brute_leak(t, q)) is not None}
    assert got == want
    caught = {i for i, _ in got}
    assert sum(i in caught for i in planted) / len(planted) >= 0.9  # recall on exchanged numbers and names
    assert not caught & set(range(len(texts) - 4, len(texts)))


def test_leaks_finds_short_and_crowded_items(spark):
    bench = spark.createDataFrame([(1, "3 + 4 * 5 - 6 / 7 = 8 so what"), (2, "tiny item"), (3, "Capital of Peru?")], "item_id long, text string")
    rows = [(1, "First: 9 + 1 * 2 - 3 / 4 = 5 so what"), (2, "It was a tiny item of news"), (3, "Yes. Tiny item! No"), (4, "Question: capital of Peru? Lima"), (5, "the capital of Peru is far")]
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(table(spark, rows), bench).collect()} == {(1, 1), (3, 2), (4, 3)}


def test_leaks_match_brute_force(spark):
    d, b = docs(spark, "sf0.01"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    words = lambda s: [t.lower() for t in decontam.TOKEN.findall(s) if t[0].isalnum()]
    windows = defaultdict(set)
    for r in b.collect():
        w = words(r.text)
        for k in range(len(w) - 7):
            windows[tuple(w[k : k + 8])].add((r.item_id, len(w) - 7))
    hits = defaultdict(set)
    for r in d.collect():
        w = words(r.text)
        for k in range(len(w) - 7):
            for item, n in windows.get(tuple(w[k : k + 8]), ()):
                hits[r.doc_id, item, n].add(tuple(w[k : k + 8]))
    want = {(doc, item) for (doc, item, n), found in hits.items() if len(found) / n >= 0.2}
    assert want and want <= {(r.doc_id, r.item_id) for r in decontam.leaks(d, b).collect()}


# 4 ------------------------------------------------------------------------------------------------------------------


def test_license_best_span_matches_brute_force():
    rng = np.random.default_rng(1)
    words = "licensed under the mit apache license version 2 0 all rights x y".split()
    scanner = license.Scanner(license.TEMPLATES, 0.6)
    for _ in range(200):
        text = " ".join(rng.choice(words, rng.integers(0, 25)))
        got = {k: round(s, 9) for s, k, _, _ in scanner(text)}
        w, want = text.split(), {}
        for k, t in scanner.templates.items():
            best = max((license.dice(Counter(zip(w[i:j], w[i + 1 : j])), t) for i in range(len(w)) for j in range(i + 2, len(w) + 1)), default=0)
            if best >= 0.6 - 1e-12:
                want[k] = round(best, 9)
        assert got == want


def test_license_relatives_have_their_own_names(spark):
    """Every template is named by itself, whole in prose too, and so are licences that differ in a word or two."""
    names = list(license.TEMPLATES)
    rows = [(i, f"Some prose of ours stands here. {license.TEMPLATES[k]} More prose follows it") for i, k in enumerate(names)]
    rows.append((len(names), "Copyright 2020 by J. Doe. " + license.TEMPLATES["mit-text"].replace("copies or substantial portions", "copies or large portions").upper()))
    got = {r.doc_id: (r.license, r.dice) for r in license.scan(table(spark, rows)).collect()}
    assert {names[i]: got[i] for i in range(len(names))} == {k: (k, 1.0) for k in names}
    assert got[len(names)][0] == "mit-text" and got[len(names)][1] > 0.98


def test_license_scan(spark):
    got = {r.doc_id: r for r in license.scan(table(spark, [(1, "Prose.\nReleased under the MIT licence; no: Released under the MIT License."), (2, "nothing"), (3, None), (4, "ALL RIGHTS, RESERVED")])).collect()}
    assert got[1].license == "mit" and got[1].dice == 1.0 and got[2].license is None and got[3].licenses == [] and got[4].license == "all-rights-reserved"
    assert license.scan(odd(spark)).count() == 12 and license.scan(table(spark, [])).count() == 0


# 5 ------------------------------------------------------------------------------------------------------------------


def test_ppm_distributions_sum_to_one_and_exclude():
    grams = Counter()
    for k in langid.keys(langid.padded("abracadabra abracadabra", 2), 2):
        grams[int(k)] += 1
    ctx = np.unique(np.array([g >> 8 for g in grams] + [0x7A7A]))
    p = langid.distributions(dict(grams), langid.PpmConfig(order=2, least=1), ctx)
    assert np.allclose(p.sum(1), 1) and (p > 0).all()
    ab = p[np.searchsorted(ctx, 0x6162)]  # after "ab" only "r" was seen, four times
    assert ab[ord("r")] == pytest.approx(4 / 5)


SCRIPTS = {
    "en": "the quick brown fox jumps over the lazy dog and runs to the river with the other animals of the wood ",
    "ru": "съешь ещё этих мягких французских булок да выпей чаю и иди домой к своей семье вечером ",
    "zh": "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜",
    "el": "ο γρήγορος σκύλος τρέχει προς το ποτάμι και τα άλλα ζώα του δάσους τον κοιτούν ",
}


def direct_length(text, sample, order, least):
    """A text's code length by the PPM recursion, byte by byte, over a byte string's own statistics."""
    counts = defaultdict(Counter)
    for k in range(order + 1):
        for i in range(order, len(sample)):
            counts[sample[i - k : i]][sample[i]] += 1

    def p(ctx, byte):
        below = (lambda x: 1 / 256) if not ctx else (lambda x: p(ctx[1:], x))
        c = counts[ctx]
        n, t = sum(c.values()), len(c)
        if n == 0 or (ctx and n < least):
            return below(byte)
        if t == 256:
            return c[byte] / n
        if c[byte]:
            return c[byte] / (n + t)
        return t / (n + t) * below(byte) / sum(below(x) for x in range(256) if not c[x])

    raw = b"\n" * order + text.encode()
    return -sum(math.log(p(raw[i - order : i], raw[i])) for i in range(order, len(raw)))


def test_language_lengths_match_a_direct_recursion():
    cfg, order = langid.PpmConfig(order=2, least=2), 2
    samples = {k: b"\n" * order + (t * 3).encode() for k, t in SCRIPTS.items()}
    grams = {}
    for k, b in samples.items():
        g, n = np.unique(langid.keys(np.frombuffer(b, np.uint8), order), return_counts=True)
        grams[k] = (g.astype(np.int64), n.astype(np.float64))
    table = langid.Lookup(langid.flattened(grams, cfg))
    for text in ("the fox", "чай и лес", "天地 river", "σκύλος!", "", "\x00ü🙂"):
        assert table.lengths(text) == pytest.approx([direct_length(text, samples[k], order, 2) for k in SCRIPTS], rel=1e-4, abs=1e-3)


def test_language_keeps_all_bytes_and_scripts(spark):
    rows = [(i, " ".join([SCRIPTS[k][j:] + SCRIPTS[k][:j]] * 2), k) for i, (k, j) in enumerate((k, j) for k in SCRIPTS for j in range(12))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(d)
    assert set(model.depths[0].byte.tolist()) == {b for t in SCRIPTS.values() for b in (t + t).encode()}
    got = langid.identify_documents(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert got and all(r.lang_pred == r.lang for r in got)


def test_language_held_out_accuracy(spark):
    d = docs(spark, "sf0.01")
    got = langid.identify_documents(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.97


def test_language_odd_rows(spark):
    got = {r.doc_id: r for r in langid.identify_documents(odd(spark)).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[5].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify_documents(table(spark, [])).count() == 0


# 6 ------------------------------------------------------------------------------------------------------------------


def laws(rows, shards):
    n = Counter(r.shard for r in rows)
    assert max(n.values()) - min(n.get(s, 0) for s in range(shards)) <= 1
    for s, k in n.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(k))


def test_sharding_laws_and_groups(spark):
    d = docs(spark, "sf0.01")
    got = sharding.shard(d).collect()
    laws(got, 40)
    size = {r.doc_id: (len(r.text.encode()) + 16, zlib.crc32(r.text.encode())) for r in d.collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == size and {r.law for r in got} == {"rows"}
    groups = defaultdict(set)
    for r in got:
        groups[r.size, r.text_crc32].add(r.shard)
    assert sum(len(x) > 1 for x in groups.values()) <= 1


def test_sharding_keeps_groups_whole_where_all_rows_have_copies(spark):
    for n, copies in ((2000, 5), (4000, 2)):
        d = table(spark, [(i * copies + j, f"text {i}") for i in range(n) for j in range(copies)])
        got = sharding.shard(d).collect()
        laws(got, 40)
        homes = defaultdict(set)
        for r in got:
            homes[r.doc_id // copies].add(r.shard)
        assert sum(len(x) > 1 for x in homes.values()) <= 4 * 40  # the ends of the shards and of what was over


def test_flows_fit_the_room():
    rng = np.random.default_rng(1)
    wishes, room = rng.integers(0, 50, (6, 6)) * (1 - np.eye(6)), np.array([0, 0, 0, 5, 9, 100])
    f = sharding.flows(wishes, room) * wishes
    assert (f.sum(0) - f.sum(1) <= room + 0.5).all() and f.sum() > 0.3 * wishes.sum() and (f <= wishes + 1e-9).all()


def test_sharding_splits_a_hot_group_and_odd_rows(spark):
    rows = [(i, "copy") for i in range(300)] + [(i, f"t{i}") for i in range(300, 900)]
    got = sharding.shard(table(spark, rows)).collect()
    laws(got, 40)
    assert len({r.shard for r in got if r.doc_id < 300}) <= 25
    got = sharding.shard(odd(spark), 5).collect()
    laws(got, 5)
    assert len(got) == 12 and next(r.size for r in got if r.doc_id == 1) == 16
    assert sharding.shard(table(spark, [])).collect() == []


# 7 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.pmod(F.xxhash64(t), F.lit(7)).cast("string")])
def test_dedup_matches_brute_force_even_if_digests_collide(spark, digest):
    rows = [(i, f"text {i % 40}") for i in range(100)] + [(200, None), (201, ""), (202, "text 3"), (None, "text 3"), (None, "alone"), (203, "twice"), (203, "twice")]
    got = exact_dedup.groups(table(spark, rows), digest).collect()
    want = defaultdict(list)
    for i, t in rows:
        want[t or ""].append(i)
    expect = Counter((i, max((x for x in want[t or ""] if x is not None), default=None), len(want[t or ""])) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == expect
    assert all(r.kept == (r.doc_id == r.keep_id or r.keep_id is None) for r in got)


@pytest.mark.parametrize("files", [True, False])
def test_dedup_across_arrivals_checks_bytes(spark, tmp_path, files):
    """Digests collide within an arrival and between two; an earlier text is compared where its locator leads."""
    few = lambda t: F.pmod(F.length(t), F.lit(2)).cast("string")
    first, second = [(1, "a"), (2, "bb"), (3, "c"), (4, "a")], [(5, "a"), (6, "dd"), (7, "c"), (8, None), (9, "bb"), (None, "eee")]
    s = exact_dedup.StreamingDedup(spark, str(tmp_path / "state"), few)
    for k, rows in enumerate((first, second)):
        docs = table(spark, rows).select("doc_id", "text")
        if files:
            docs.unionByName(table(spark, [(70 + k, "zz")]).select("doc_id", "text")).write.parquet(str(tmp_path / f"docs{k}"))
            docs = spark.read.parquet(str(tmp_path / f"docs{k}")).where("doc_id is null or doc_id < 50")  # the file holds a row that does not arrive
        s.arrive(docs)
    assert sorted((r.keep_id, r.n) for r in s.state().collect()) == [(7, 6), (9, 4)]
    want = defaultdict(list)
    for i, t in first + second:
        want[t or ""].append(i)
    got = s.groups().collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == Counter((i, max((x for x in v if x is not None), default=None), len(v)) for v in want.values() for i in v)
    assert sum(r.locator == r.keep_at for r in got) == len(want)


def test_dedup_of_a_table_that_differs_from_its_files(spark, tmp_path):
    table(spark, [(1, "A"), (2, "a"), (3, "b")]).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs")).withColumn("text", F.lower("text"))
    assert {r.doc_id for r in exact_dedup.deduplicated(docs).collect()} == {2, 3}


def test_dedup_of_a_hot_text_has_no_hot_task(spark):
    docs = table(spark, [(i, "hot" if i % 2 else f"t{i}") for i in range(2000)]).cache()
    state = docs.groupBy("text").agg(F.count("*").alias("n"))
    got = ranking.hot_join(docs.select("doc_id", "text"), state, "text", "n", hot=8, least=10, small=0)
    assert got.count() == 2000 and "BroadcastHashJoin" in got._jdf.queryExecution().toString() and got.where("n = 1000").count() == 1000


def test_dedup_stage_and_odd_rows(spark):
    kept = exact_dedup.deduplicated(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 3, 4, 6, 8, 9, 10]
    assert exact_dedup.deduplicated(table(spark, [(1, "t"), (1, "t")])).count() == 1
    assert exact_dedup.deduplicated(table(spark, [])).count() == 0


# 8 ------------------------------------------------------------------------------------------------------------------


def brute_links(rows, t=0.8):
    sh = ngram_join.Shingler(5)
    sets = [set(sh(text).tolist()) for _, text in rows]
    n = [0] * len(rows)
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t:
            n[a] += 1
            n[b] += 1
            x, y = group[a], group[b]
            group = [min(x, y) if g in (x, y) else g for g in group]
    return n, group


def near(spark):
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for base in range(12):
        words = [f"w{rng.integers(5000)}" for _ in range(80)]
        for _ in range(8):
            v = list(words)
            for j in rng.choice(80, rng.integers(0, 5), replace=False):
                v[j] = f"z{rng.integers(5000)}"
            rows.append((k, " ".join(v)))
            k += 1
    return rows + [(k, rows[0][1]), (k + 1, ""), (k + 2, ""), (k + 3, "three words only"), (k + 4, "Three words, only")]


@pytest.mark.parametrize("block", [1024, 3, 1])
def test_join_links_and_groups_match_brute_force(spark, block):
    rows = near(spark)
    n, group = brute_links(rows)
    got = {r.doc_id: r for r in ngram_join.join(table(spark, rows), replace(ngram_join.JoinConfig(), block=block)).collect()}
    assert [got[i].n_links for i, _ in rows] == n and [got[i].class_id for i, _ in rows] == group
    if block == 1024:
        assert {r.doc_id for r in ngram_join.one_of_each(table(spark, rows)).collect()} == set(group)


def test_join_recall_on_the_tables(spark):
    """Against all pairs of the 1,000 documents of sf0.01; measured: every link found."""
    rows = [(r.doc_id, r.text) for r in docs(spark, "sf0.01").collect()]
    sh = ngram_join.Shingler(5)
    sets = {i: frozenset(sh(t).tolist()) for i, t in rows}
    by_size = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    links = Counter()
    for x, i in enumerate(by_size):
        for j in by_size[x + 1 :]:
            if len(sets[i]) < 0.8 * len(sets[j]):
                break
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
    got = {r.doc_id: r.n_links for r in ngram_join.join(docs(spark, "sf0.01")).collect()}
    assert len(got) == len(rows) and all(got[i] <= links[i] for i in got)
    assert sum(got.values()) >= 0.99 * sum(links.values()) > 0


def test_join_of_a_chain_compares_neighbours_only(spark):
    """400 texts, each like the next one only: a component of 400 classes, of which few pairs of blocks are compared."""
    words = [f"w{i}" for i in range(400 * 4 + 120)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 120])) for i in range(400)]
    cfg = replace(ngram_join.JoinConfig(), block=8)
    n, group = brute_links(rows[:120])
    got = {r.doc_id: r for r in ngram_join.join(table(spark, rows), cfg).collect()}
    assert [got[i].n_links for i in range(100)] == n[:100] and {r.class_id for r in got.values()} == {0}
    classes = spark.createDataFrame([(i, bytearray(ngram_join.signature(s, *ngram_join._permutations(cfg.trees * cfg.depth))), len(s), 0) for i, (_, t) in enumerate(rows) for s in [ngram_join.Shingler(5)(t)]], "id long, sign binary, shingles long, root long")
    _, pairs = ngram_join.blocks(classes, 4, cfg)
    blocks = {r.lo for r in pairs.collect()} | {r.hi for r in pairs.collect()}
    assert pairs.count() < len(blocks) ** 2 / 4


def test_join_of_rows_without_id(spark):
    t = " ".join(f"w{i}" for i in range(100))
    rows = [(None, t), (None, t + " more"), (5, "quite another text of five words"), (None, "quite another text of six words"), (9, t + " more or less")]
    got = [r.asDict() for r in ngram_join.join(table(spark, rows)).collect()]
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"]) for r in got) == [(0, 0, 0), (0, 9, 2), (0, 9, 2), (5, 5, 0), (9, 9, 2)]
    alone = ngram_join.join(table(spark, rows[:2])).collect()
    assert {r.n_links for r in alone} == {1} and len({r.class_name for r in alone}) == 1 and {r.class_id for r in alone} == {None}


def test_prefixes_shorten_until_the_target_recall():
    cfg = ngram_join.JoinConfig()
    assert ngram_join.found(0.8, 5, cfg) >= cfg.recall > ngram_join.found(0.8, 6, cfg)


def test_join_odd_rows(spark):
    got = ngram_join.join(odd(spark)).collect()
    assert len(got) == 12 and {r.n_links for r in got if r.doc_id in (5, 6)} == {1} and {r.n_links for r in got if r.doc_id == 7} == {2}
    assert ngram_join.join(table(spark, [])).count() == 0 and ngram_join.one_of_each(odd(spark)).columns == odd(spark).columns


# 9 ------------------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    d, labels = docs(spark, "sf0.1"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.score_documents(d, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    caught = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    wrong = sum(r.predicted for r in rows if not r.toxic) / sum(not r.toxic for r in rows)
    assert caught > 0.7 and wrong < 0.02 and all(0 <= r.score <= 1 for r in rows)


def test_toxicity_matches_brute_force(spark):
    """Places counted and chosen n-gram by n-gram, and the regression solved densely by many gradient steps."""
    rng = np.random.default_rng(2)
    words = "river stone cloud paper window garden silver morning".split()
    rows = [(i, " ".join(rng.choice(words, 12)) + (" vile" if i % 3 == 0 and i % 7 else "") + (" FOUL" if i % 3 == 0 and i % 2 else "")) for i in range(90)] + [(90, None), (91, "")]
    toxic = {i: int(i % 3 == 0) for i in range(70)}
    cfg = toxicity.ToxicConfig(places=1 << 12, kept=40, least=2, steps=4000, l1=1e-3, l2=1e-3, per_class=1000)
    d, labels = table(spark, rows), spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    learn = lambda i: zlib.crc32(str(i).encode()) % 3 != 1
    model = toxicity.fit(d.where(toxicity.learnable()), labels.where(toxicity.learnable()), cfg)
    mul, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def places(text):
        raw = b" " + (text or "").lower().encode() + b" "
        return {((int.from_bytes(raw[i : i + n], "big") * mul + n - 1) * mul & mask) >> 40 & 4095 for n in (3, 4, 5, 6) for i in range(len(raw) - n + 1)}

    known = [(places(t), toxic[i]) for i, t in rows if i in toxic and learn(i)]
    n1, n0 = sum(y for _, y in known), sum(1 - y for _, y in known)
    p, q = Counter(g for s, y in known if y for g in s), Counter(g for s, y in known if not y for g in s)
    seen = [g for g in {*p, *q} if p[g] + q[g] >= 2]
    tp, tq, share = sum(p[g] + 1 for g in seen), sum(q[g] + 1 for g in seen), n1 / (n1 + n0)

    def chi(g):
        f1, f0 = (p[g] + 0.5) / (n1 + 1), (q[g] + 0.5) / (n0 + 1)
        f = share * f1 + (1 - share) * f0
        return (f1 - f0) ** 2 / (f * (1 - f) + 1e-9)

    best = sorted(seen, key=lambda g: (-chi(g), g))[:40]
    r = np.array([math.log((p[g] + 1) / tp / ((q[g] + 1) / tq)) for g in best])
    assert set(np.flatnonzero(model.column >= 0)) <= set(best)
    x, y = np.array([[g in s for g in best] for s, _ in known], float) * r, np.array([y for _, y in known])
    weight = np.where(y == 1, share / n1, (1 - share) / n0)

    def cost(w, b):
        z = x @ w + b
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 5e-4 * (w**2).sum() + 1e-3 * np.abs(w).sum()

    w, b, step = np.zeros(40), 0.0, 1 / (0.25 * ((x**2).sum(1) + 1).max())
    for _ in range(60_000):
        e = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w = w - step * (x.T @ e + 1e-3 * w)
        w, b = np.sign(w) * np.maximum(np.abs(w) - step * 1e-3, 0), b - step * e.sum()
    got = np.array([model.weights[model.column[g]] / r[k] if model.column[g] >= 0 else 0.0 for k, g in enumerate(best)])
    assert cost(got, model.intercept) <= cost(w, b) + 2e-3
    scores = {i: s for i, s in ((k.doc_id, k.score) for k in toxicity.score(d, model).collect())}
    for i, t in rows:
        s = places(t)
        z = b + sum(w[k] * r[k] for k, g in enumerate(best) if g in s)
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=0.06)


def test_toxicity_counts_every_labelled_row(spark):
    ids = spark.range(1, 601).withColumnRenamed("id", "doc_id")
    order = [r.doc_id for r in ids.where("doc_id % 2 = 1").orderBy(toxicity.uniform(F.col("doc_id"), 7)).collect()]
    marked = set(order[:1] + order[-20:])  # a sample of 30 toxic rows holds one of these 21 texts only
    d = table(spark, [(i, "zyxwvut" if i in marked else f"plain words {i % 2}") for i in range(1, 601)])
    labels = ids.withColumn("toxic", (F.col("doc_id") % 2).cast("int"))
    model = toxicity.fit(d, labels, toxicity.ToxicConfig(per_class=30))
    assert toxicity.probability("zyxwvut", model) > toxicity.probability("", model) + 0.05


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 11)] + [(4, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    got = toxicity.score_documents(odd(spark), labels).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    none = toxicity.score_documents(odd(spark), labels.limit(0)).collect()
    assert {r.predicted for r in none} == {0}
    assert toxicity.score_documents(table(spark, []), labels).count() == 0


# 10 -----------------------------------------------------------------------------------------------------------------


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("substring(key, 2) % 17 = 3").unionByName(spark.createDataFrame([("elsewhere",)], "key string"))
    c = url_filter.cascade(listed, universe)
    wrong = universe.where(c.has(F.col("key")) != F.expr("substring(key, 2) % 17 = 3")).count()
    assert wrong == 0 and len(c.levels) >= 2


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/1?x", "https://a.example.com/en/", "https://example.com/fr/en/", "http://x.net/fr/", "http://x.net/de/", "http://net/es/a#b", "http://xnet/es/", "http://a.org", "http://a.com", "http://a.com/", "no scheme", "", None, "x://://y/", "http://www.example.com.evil.net/fr/9"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    none = (None, "allow")
    assert [got[i] for i in range(len(urls))] == [("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow"), ("net/fr/", "block"), none, ("net/es/", "block"), none, none, none, ("com/", "allow"), none, none, none, none, ("net/fr/", "block")]
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_urls_odd_rows(spark):
    long = "http://a.net/fr/" + "x" * 300_000
    rows = [(None, "http://x.com/", "h", "p", "r"), (1, long, "h", "p", "r"), (1, long, "h", "p", "r"), (2, None, None, None, None), (3, "http://" + "a." * 20_000 + "net/es/", "h", "p", "r")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string")).collect()
    assert sorted((r.page_id or 0, r.rule, r.verdict) for r in got if r.rule) == [(0, "com/", "allow"), (1, "net/fr/", "block"), (1, "net/fr/", "block"), (3, "net/es/", "block")]
    assert [(r.host, r.path, r.rule, r.verdict) for r in got if r.page_id == 2] == [("", "", None, "allow")]
    assert {r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, a string, b string, c string"), rules=()).collect()} == {"allow"}


def test_urls_need_no_python(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = url_filter.judge(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan
