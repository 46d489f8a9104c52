"""N-gram Jaccard join: a MinHash LSH forest proposes, exact comparison of shingle sets decides.

Rows with equal shingle sets (five normalised words) are one class from the start, so copies are never paired. Each
class has `trees` signature labels of `depth` minhashes; a node of a tree is a prefix of its label. Prefixes start at
full length and are shortened until a pair at the threshold shares a node with probability `recall`, and again if the
links found say that too many were missed: a link of similarity s is found with chance P(s), so n links stand for the
sum of 1 / P(s). Classes that share a node, directly or along a chain, form a candidate component; the exact
similarities inside a component are found from its shingle sets. A large one is cut into blocks, and blocks are compared
with each other only where members of theirs share a node. No list of pairs exists anywhere. Each document gets its group (connected through links) and its number of links.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.ranking import hot_join
from ledgerline.llm.tables import cut, fresh, remove, table

WORD = re.compile(r"\w+")
#: Members of candidate components (some 100 bytes each in a task) that are sent to the scan of the texts; more are joined
#: by a shuffle.
BROADCAST_ROWS = 500_000
_M = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class JoinConfig:
    words: int = 5
    threshold: float = 0.8
    trees: int = 24
    depth: int = 6
    recall: float = 0.9999
    block: int = 256  # classes of a component that a task holds on each side
    block_shingles: int = 1_000_000


class Shingler:
    def __init__(self, words: int):
        self.words, self.memo = words, {}
        self.powers = [np.uint64(pow(_M, i, 1 << 64)) for i in range(words)]

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the runs of `words` words; a shorter text is one run; no words: none."""
        words = WORD.findall((text or "").lower())
        if not words:
            return np.empty(0, np.uint64)
        memo = self.memo
        if len(memo) > 300_000:
            memo = self.memo = {}
        ids = list(map(memo.get, words))
        if None in ids:
            for i, v in enumerate(ids):
                if v is None:
                    ids[i] = memo[words[i]] = xxhash.xxh64_intdigest(words[i])
        w = np.array(ids, np.uint64)
        n = min(self.words, len(w))
        h = w[: len(w) - n + 1] * self.powers[0]
        for j in range(1, n):
            h = h + w[j : len(w) - n + 1 + j] * self.powers[j]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(h ^ (h >> np.uint64(32)))


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2024)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """Minhashes, four bytes each, in the order tree by tree."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 512):
        s = shingles[k : k + 512]
        np.minimum(least, (s[:, None] * a + b).min(0), out=least)
    return (least >> np.uint64(32)).astype(">u4").tobytes()


def _sign_task(cfg: JoinConfig):
    def run(batches):
        shingler, (a, b) = Shingler(cfg.words), _permutations(cfg.trees * cfg.depth)
        for batch in batches:
            digests, signs, sizes = [], [], []
            for t in batch.column("text").to_pylist():
                s = shingler(t)
                digests.append(digest(s) if len(s) else None)
                signs.append(signature(s, a, b) if len(s) else None)
                sizes.append(len(s))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "digest": pa.array(digests, pa.binary()), "sign": pa.array(signs, pa.binary()), "shingles": pa.array(sizes, pa.int64())})

    return run


def found(s: float | np.ndarray, depth: int, cfg: JoinConfig):
    """The chance that two sets of similarity s share a prefix of that length in some tree."""
    return 1 - (1 - s**depth) ** cfg.trees


def nodes_of(classes: DataFrame, depth: int, cfg: JoinConfig, *columns: str) -> DataFrame:
    """id, node (a prefix of the class's label in one of the trees), and these columns."""
    prefix = [F.xxhash64(F.lit(t), F.substring("sign", t * cfg.depth * 4 + 1, depth * 4)) for t in range(cfg.trees)]
    return classes.select("id", *columns, F.explode(F.array(*prefix)).alias("node"))


def shared_nodes(classes: DataFrame, depth: int, cfg: JoinConfig) -> DataFrame:
    """Edges u > v that connect all classes which share a node: from each member to the least of the node. As many edges as
    members at most, however large a node is."""
    nodes = nodes_of(classes, depth, cfg)
    shared = cut(nodes.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1"))
    return hot_join(nodes, shared, "node", "n").where("id > least").select(F.col("id").alias("u"), F.col("least").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges u > v: u, root for each vertex but the roots, where root is the least vertex of u's component. Rounds of large
    and small stars; each round's edges are a table in the shared folder, gone after the next."""
    edges, at = table(edges, "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, at_least = table(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large, at_large = table(hot_join(both, least, "u", "n").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        remove(edges.sparkSession, at)
        remove(edges.sparkSession, at_least)
        least, at_least = table(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = hot_join(large, least, "u", "n").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, at = table(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        remove(edges.sparkSession, at_large)
        remove(edges.sparkSession, at_least)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            out = cut(edges.select("u", F.col("v").alias("root")))
            remove(edges.sparkSession, at)
            return out
        before = now


VERIFIED = "u long, v long, links long, seen double, stands double"


def links_among(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Square arrays: whether two sets are linked, and their similarity. side: pairs of equal sides are compared if all
    sides are equal, else pairs of different ones."""
    m = len(sets)
    sizes = np.array([len(x) for x in sets], np.float64)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes.astype(np.int64))
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate(([True], every[1:] != every[:-1]))
    col = np.cumsum(new) - 1
    often = np.bincount(col)[col] > 1  # a shingle of one set adds nothing
    owner, col = owner[often], col[often]
    inter = np.zeros((m, m), np.float32)
    if len(col):
        _, col = np.unique(col, return_inverse=True)
        for k in range(0, int(col[-1]) + 1, 2048):
            lo, hi = np.searchsorted(col, (k, k + 2048))
            a = np.zeros((m, 2048), np.float32)
            a[owner[lo:hi], col[lo:hi] - k] = 1
            inter += a @ a.T
    s = inter / np.maximum(sizes[:, None] + sizes[None] - inter, 1)
    on = s >= threshold - 1e-7
    np.fill_diagonal(on, False)
    if (side != side[0]).any():
        on &= side[:, None] != side[None]
    return on, s


def _verify(cfg: JoinConfig, depth: int):
    none = pd.DataFrame({"u": [], "v": [], "links": [], "seen": [], "stands": []})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id")
        sets = [np.frombuffer(x, np.uint64) for x in pdf["set"]]
        copies, name, side = pdf["copies"].to_numpy(np.int64), pdf["id"].to_numpy(np.int64), pdf["block"].to_numpy()
        if len(sets) < 2 or (pdf["lo"].iloc[0] != pdf["hi"].iloc[0] and (side == side[0]).all()):
            return none
        on, s = links_among(sets, copies, side, cfg.threshold)
        linked = np.flatnonzero(on.any(1))
        if not len(linked):
            return none
        on = on[np.ix_(linked, linked)]
        stands = np.where(on, 1 / found(s[np.ix_(linked, linked)].astype(np.float64).clip(0.5, 1), depth, cfg), 0).sum(1)
        label = np.arange(len(linked))
        while True:  # least index over links, until nothing changes
            new = np.minimum(label, np.where(on, label[None], len(linked)).min(1))
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        return pd.DataFrame({"u": name[linked], "v": name[linked][label], "links": on.astype(np.int64) @ copies[linked], "seen": on.sum(1).astype(float), "stands": stands})

    return run


def _set_task(cfg: JoinConfig, keep: tuple[str, ...]):
    """digest and set of each text that has words, with these columns."""

    def run(batches):
        shingler = Shingler(cfg.words)
        for b in batches:
            sets = [shingler(t) for t in b.column("text").to_pylist()]
            own = [digest(s) if len(s) else None for s in sets]
            out = {"digest": pa.array(own, pa.binary())} | {k: b.column(k) for k in keep} | {"set": pa.array([s.tobytes() for s in sets], pa.binary())}
            ok = [d is not None and ("want" not in out or w == d) for d, w in zip(own, out["want"].to_pylist() if "want" in out else own)]
            yield pa.RecordBatch.from_pydict(out).filter(pa.array(ok, pa.bool_()))

    return run


def blocks(member: DataFrame, depth: int, cfg: JoinConfig) -> tuple[DataFrame, DataFrame]:
    """member: id, root, sign, shingles, and more. The members with their block, and the pairs of blocks (root, lo <= hi) to
    be compared. A component that a task can hold is one block. The members of a larger one are blocked by their node in
    the first tree, and those of a large node by a hash; two blocks are compared if members of theirs share a node in
    some tree."""
    fits = lambda n, s: F.ceil(F.greatest(F.col(n) / cfg.block, F.col(s) / cfg.block_shingles))
    size = cut(member.groupBy("root").agg(F.count("*").alias("n"), F.sum("shingles").alias("s")).select("root", fits("n", "s").alias("parts"), "n"))
    sized = cut(hot_join(member, size, "root", "n").drop("n"))
    small = sized.where("parts = 1").withColumn("block", F.lit(0).cast("long")).drop("parts")
    lone = size.where("parts = 1").select("root", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
    if not size.where("parts > 1").take(1):
        return small.drop("sign"), lone
    bucket = F.pmod(F.xxhash64("root", F.substring("sign", 1, depth * 4)), F.col("parts")).cast("long")
    large = cut(sized.where("parts > 1").withColumn("bucket", F.xxhash64("root", bucket)).drop("parts"))
    room = cut(large.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("shingles").alias("s")).select("bucket", fits("n", "s").alias("deal"), "n"))
    placed = hot_join(large, room, "bucket", "n").withColumn("block", F.xxhash64("bucket", F.pmod(F.xxhash64("id"), F.col("deal")))).drop("bucket", "deal", "n")
    placed = cut(placed)
    at = cut(nodes_of(placed, depth, cfg, "root", "block").select("root", "node", "block").distinct())
    pairs = at.alias("a").join(at.select("node", "root", F.col("block").alias("other")), ["node", "root"]).where("block <= other")
    return small.unionByName(placed).drop("sign"), lone.unionByName(pairs.select("root", F.col("block").alias("lo"), F.col("other").alias("hi")).distinct())


def verified(docs: DataFrame, classes: DataFrame, candidate: DataFrame, depth: int, cfg: JoinConfig) -> DataFrame:
    """u, v (a class that u is connected to), links, seen, stands, in parts to be summed by u."""
    root = candidate.select(F.col("u").alias("id"), "root")
    member = cut(root.unionByName(root.select(F.col("root").alias("id"), "root").distinct()).join(classes, "id"))
    member, pairs = blocks(member, depth, cfg)
    member, pairs = cut(member.select("id", "digest", "rep", "copies", "root", "block")), cut(pairs)
    keep = member.withColumnsRenamed({"digest": "want", "rep": "doc_id"})
    named = keep.where("doc_id is not null")
    named = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(named, "doc_id").select("text", "want", "id", "copies", "root", "block")
    sets = texts.mapInArrow(_set_task(cfg, ("want", "id", "copies", "root", "block")), "digest binary, want binary, id long, copies long, root long, block long, set binary")
    sets = sets.select("id", "copies", "root", "block", "set")
    if member.where("rep is null").take(1):  # sets that only rows without id have
        own = docs.where("doc_id is null").select("text").mapInArrow(_set_task(cfg, ()), "digest binary, set binary").dropDuplicates(["digest"])
        sets = sets.unionByName(own.join(member.where("rep is null"), "digest").select("id", "copies", "root", "block", "set"))
    ends = pairs.select("root", "lo", "hi", F.col("lo").alias("block")).unionByName(pairs.where("lo != hi").select("root", "lo", "hi", F.col("hi").alias("block")))
    return sets.join(ends, ["root", "block"]).groupBy("root", "lo", "hi").applyInPandas(_verify(cfg, depth), VERIFIED)


def join(docs: DataFrame, cfg: JoinConfig = JoinConfig()) -> DataFrame:
    """doc_id, class_id, n_links, same_id, copies, class_name: one row for each row of docs.

    class_id: the least id of the documents connected through links (its own if there are none); n_links: other rows at
    or above the threshold, copies counted each; same_id, copies: least id and number of the rows with the same shingle
    set; class_name: the same for all rows of a group, also where class_id is null because no row of it has an id. Null,
    empty and wordless texts have no links, and no name. An empty table has no rows; other columns are not looked at."""
    signed = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sign_task(cfg), "doc_id long, digest binary, sign binary, shingles long"))
    classes = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sign").alias("sign"), F.first("shingles").alias("shingles"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    depth = cfg.depth
    while depth > 1 and found(cfg.threshold, depth, cfg) < cfg.recall:
        depth -= 1
    while True:
        candidate = components(shared_nodes(classes, depth, cfg))
        links = cut(verified(docs, classes, candidate, depth, cfg))
        seen, stands = links.agg(F.sum("seen"), F.sum("stands")).first()
        if depth == 1 or not seen or seen / stands >= cfg.recall:
            break
        depth -= 1
    counted = links.groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "id")
    group = components(links.where("u > v").select("u", "v").unionByName(links.where("u < v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    group = group.unionByName(group.select(F.col("root").alias("u"), "root").distinct()).withColumnRenamed("u", "id")
    named = cut(group.join(classes.select("id", "rep", "digest"), "id"))
    first = cut(named.groupBy("root").agg(F.min("rep").alias("class_id"), F.min("digest").alias("name"), F.count("*").alias("n")))
    named = hot_join(named.select("id", "root"), first, "root", "n").select("id", "class_id", "name")
    known = cut(
        classes.select("id", "digest", "rep", "copies")
        .join(named, "id", "left")
        .join(counted, "id", "left")
        .select(
            "digest",
            F.coalesce("class_id", "rep").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.col("rep").alias("same_id"),
            "copies",
            F.lower(F.hex(F.coalesce("name", "digest"))).alias("class_name"),
        )
    )
    rows = signed.select("doc_id", "digest")
    with_words = hot_join(rows.where("digest is not null"), known, "digest", "copies").drop("digest")
    none = F.lit(None).cast("string").alias("class_name")
    return with_words.unionByName(rows.where("digest is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("same_id"), F.lit(1).cast("long").alias("copies"), none))


def one_of_each(docs: DataFrame, cfg: JoinConfig = JoinConfig()) -> DataFrame:
    """docs without the documents of a group other than its first one, by id. Rows that share an id go or stay together;
    rows without id stay, and texts without words."""
    gone = fresh(docs, "_gone")
    joined = join(docs, cfg)
    drop = joined.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias(gone)).distinct()
    stay = joined.where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(cut(drop.join(stay, gone, "left_anti")), F.col("doc_id").cast("long") == F.col(gone), "left_anti")
