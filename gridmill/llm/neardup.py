"""Near-duplicate detection by chosen-path set similarity join (operator 1).

Documents are sets of 5-word shingles (64-bit hashes); two are linked at Jaccard similarity >= 0.75, and the
classes are the connected components of the links.

1. Documents with equal sets are one class; only classes go on.
2. Each of TREES independent trees branches the classes by one chosen minwise token of the whole set; those that
   share it are a node.  A small node (at most SMALL classes) is compared exhaustively on the classes' minwise
   samples; pairs that pass are checked on full sets and give links.
3. Links give components.  Two classes of one component need no further check, so of a larger node only pairs of
   different components are open.  If these are few (PAIRS_A_NODE), they are all compared on full sets: the classes
   outside the node's largest component meet all others, dealt in blocks.  Each task gives a spanning forest of the
   links it finds, not all of them.  Before that, in some trees (LEADERS), one class of each large node, another in
   every tree, is compared with all others of it, which joins most of a large group of copies.
4. Any other node branches on: each class goes to FANOUT children by fresh minwise tokens, drawn from its whole set
   by hashes of the node's own, and steps 2 to 4 follow.  At level DEPTH nodes are compared as in 3, however large.
5. Components by local contraction, then by repeatedly taking the smallest label around and jumping.

A pair of similarity 0.75 shares a root with probability 3/4.  Of two children a node it shares at least one with
probability 15/16 and 1.5 on average, so it meets in some node of every depth with at least 0.88 of its
probability at the root: the 12 trees miss it with 6e-8 where nodes are small or exhausted at the root, and with
3e-6 where each has to branch without end.  Minwise samples travel as 16 bits each and only drop pairs far below
the threshold (mean minus five standard deviations: 3e-7), so full sets of small nodes meet only where they are
likely to link.  Comparing a node on full sets takes time with the square of its classes, but no rows.

Texts are not shuffled to check links: a scan keeps the documents whose id is in a bitmap of the wanted ones, and their
sets travel by the class that the set itself names.  Where classes branch (4), their texts alone are shuffled.  Nodes are counted without samples, which most rows never need.

Defined results: a null text or one without words has an empty set, n_shingles 0, and is linked with nothing;
with fewer than five words the whole sequence is the one shingle; rows that share a doc_id are judged each by its
own text; a null doc_id belongs to the class of its set: it takes that class's component if a document with an id
has the same set and is then not kept, else its component is null and it is kept; an empty table gives no rows;
other columns are not read.  Classes are named by 64 bits of their set's digest (of 10^9 some two coincide with 0.03).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import GOLDEN, discard, mixed, pieces, raw, release, stored, word_hashes

WORDS, PERCENT = 5, 75
TREES, SAMPLES = 12, 48
#: Classes of a small node; children of a class in a large one; the last level of branching.
SMALL, FANOUT, DEPTH = 48, 2, 6
#: A node with at most so many pairs in different components is compared exhaustively rather than branched.
PAIRS_A_NODE = 2_000_000
#: Estimates below this are not checked: 0.75 minus five standard deviations of a mean of 48 samples.
FLOOR = 0.75 - 5 * (0.75 * 0.25 / SAMPLES) ** 0.5
#: First and last tree of those that leaders are compared in, in two turns; classes of one block of a node.
LEADERS = ((0, 0), (1, 3))
BLOCK = 2048
LINKS_A_TASK = 1_000_000
SALT_ROWS, LEADER_ROWS = 256, 4096
#: Bits of a bitmap of ids: eight an id, between these; one part of it.
LEAST_BITS, MOST_BITS, PART_BITS = 18, 27, 15


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    own = raw(text).lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    h = word_hashes(own)
    n = max(1, len(h) - words + 1)
    code = np.full(n, len(own) if len(own) < words else words, np.uint64)
    for k in range(min(words, len(h))):
        code = mixed(code * np.uint64(GOLDEN) + h[k : k + n])
    return np.unique(code)


def minwise(codes: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """The smallest of ``samples`` hashes over a set."""
    out = np.full(samples, np.iinfo(np.uint64).max, np.uint64)
    salt = mixed(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(GOLDEN))
    for a in range(0, len(codes), 2048):
        h = codes[a : a + 2048, None] ^ salt
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(out, h.min(0), out=out)
    return out


def document_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (of equal sets), roots (the trees' first tokens), sig (16 bits of each minwise value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1_000_000):
            sizes, keys, roots, sigs = [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(t, words)
                sizes.append(len(s))
                if not len(s):
                    keys.append(None)
                    roots.append(None)
                    sigs.append(None)
                    continue
                m = minwise(s)
                keys.append(key_of(s))
                roots.append(m[:TREES].view(np.int64))
                sigs.append((m >> np.uint64(17)).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(roots, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "set_key", "roots", "sig"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return own.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_key binary, roots array<long>, sig binary")


PAIRS = "a long, b long, first boolean"


def signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), SAMPLES)


def similar(sigs: np.ndarray, to: np.ndarray) -> np.ndarray:
    return (sigs == to).mean(-1) >= FLOOR


def node_pairs(members: DataFrame) -> DataFrame:
    """(a, b, first) of small nodes, each compared exhaustively on samples; ``members``: node, rep, sig.

    ``first`` marks a class's pair with the smallest similar class of the node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held_sigs, held_reps = None, [], []
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            nodes, reps = np.asarray(batch.column("node")), np.asarray(batch.column("rep"))
            sigs = signatures(batch.column("sig"))
            edges = np.concatenate(([0], np.flatnonzero(nodes[1:] != nodes[:-1]) + 1, [len(nodes)]))
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a == z:
                    continue
                if nodes[a] != node:
                    node, held_sigs, held_reps = nodes[a], [], []
                k = len(held_reps)
                held_sigs += list(sigs[a:z])
                held_reps += reps[a:z].tolist()
                every, names = np.stack(held_sigs), np.array(held_reps)
                for j in range(max(1, k), len(names)):
                    hit = np.flatnonzero(similar(every[:j], every[j]))
                    if len(hit):
                        first = np.zeros(len(hit), bool)
                        first[0] = True
                        out.append((names[hit], np.full(len(hit), names[j]), first))
            cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_())], ["a", "b", "first"])

    return members.repartition("node").sortWithinPartitions("node", "rep").select("node", "rep", "sig").mapInArrow(run, PAIRS)


def leader_pairs(members: DataFrame) -> DataFrame:
    """(a, b) of large nodes: one class, chosen by the node's hash, against all others of other components.

    ``members``: node, n, rep, sig, label.  A hot node is salted; no task needs a whole node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pa.array((signatures(batch.column("sig")) == signatures(batch.column("leader_sig"))).mean(1) >= FLOOR)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(hit), batch.column("b").filter(hit)], ["a", "b"])

    salts = F.ceil(F.col("n") / LEADER_ROWS).cast("int")
    leaders = members.groupBy("node").agg(F.min(F.struct(F.xxhash64("node", "rep").alias("turn"), "rep", "sig", "label")).alias("leader"), F.max(salts).alias("salts"))
    leaders = leaders.select("node", "leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    met = members.withColumn("salt", F.pmod(F.xxhash64("rep"), salts).cast("int")).join(leaders, ["node", "salt"]).where(F.col("label") != F.col("leader.label"))
    pair = met.select(F.least("rep", "leader.rep").alias("a"), F.greatest("rep", "leader.rep").alias("b"), "sig", F.col("leader.sig").alias("leader_sig"))
    return pair.mapInArrow(run, "a long, b long").distinct()


def forest(left: list[np.ndarray], right: list[np.ndarray], labels: tuple[np.ndarray, np.ndarray], within: bool, percent: int) -> list[tuple[int, int]]:
    """Index pairs (left, right) of a spanning forest of the links between sets of different labels; ``within``: both sides are the same."""
    size = np.array([len(c) for c in right], np.int64)
    every, inverse = np.unique(np.concatenate(right), return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    row = np.repeat(np.arange(len(right)), size)[order]  # which sets hold a code, code by code
    count = np.bincount(inverse, minlength=len(every))
    start = np.cumsum(count) - count
    both_labels, root = np.unique(np.concatenate(labels), return_inverse=True)
    mine, theirs = root[: len(left)].copy(), root[len(left) :].copy()
    out = []
    for i, codes in enumerate(left):
        at = np.minimum(np.searchsorted(every, codes), len(every) - 1)
        at = at[every[at] == codes]
        n = count[at]
        flat = np.arange(int(n.sum())) + np.repeat(start[at] - np.cumsum(n) + n, n)
        both = np.bincount(row[flat], minlength=len(right))
        hit = np.flatnonzero((100 * both >= percent * (len(codes) + size - both)) & (theirs != mine[i]))
        if within:
            hit = hit[hit > i]
        while len(hit):
            j = int(hit[0])
            out.append((i, j))
            old = theirs[j]
            mine[mine == old] = mine[i]
            theirs[theirs == old] = mine[i]
            hit = hit[theirs[hit] != mine[i]]
    return out


def open_links(members: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, words: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b), enough to join whatever the pairs of different labels in a node link; ``members``: node, rep, label, major, n_major, n.

    Classes of the major label are blocks of their own, all others further blocks; one of these is on either side of each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("node", "low", "high")), strict=True))
            edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)] if keys else [0]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if keys[a] != key:
                    yield from compared(held)
                    key, held = keys[a], []
                held.append(batch.slice(a, z - a))
        yield from compared(held)

    def compared(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        column = lambda c: [x for b in held for x in b.column(c).to_pylist()]
        low, high = held[0].column("low")[0].as_py(), held[0].column("high")[0].as_py()
        own, reps, labels, codes = np.array(column("own")), np.array(column("rep")), np.array(column("label")), [np.frombuffer(c, np.uint64) for c in column("codes")]
        x, y = np.flatnonzero(own == low), np.flatnonzero(own == high)
        if not len(x) or not len(y):
            return
        found = forest([codes[k] for k in x], [codes[k] for k in y], (labels[x], labels[y]), low == high, percent)
        a, b = reps[x[[i for i, _ in found]]], reps[y[[j for _, j in found]]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

    minor = F.col("label") != F.col("major")
    some = lambda n: F.ceil(n / block).cast("int")
    minors, majors = some(F.col("n") - F.col("n_major")), some(F.col("n_major"))
    part = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    own = F.when(minor, part(minors)).otherwise(minors + part(majors))
    other = F.when(minor, F.sequence(F.lit(0), minors + majors - 1)).otherwise(F.sequence(F.lit(0), minors - 1))
    dealt = members.select("node", "rep", "label", own.alias("own"), F.explode(other).alias("other"))
    dealt = dealt.select("node", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "label")
    met = dealt.join(full_sets(members.select("rep"), classes, docs, words), "rep")
    return met.repartition("node", "low", "high").sortWithinPartitions("node", "low", "high").mapInArrow(run, "a long, b long").distinct()


def rooted(classes: DataFrame) -> DataFrame:
    """(node, tree, rep): every class in the first node of each tree; ``classes``: rep, roots."""
    members = classes.select("rep", F.posexplode("roots").alias("tree", "root"))
    return members.select(F.xxhash64("tree", "root").alias("node"), "tree", "rep")


def branched(members: DataFrame, classes: DataFrame, docs: DataFrame, words: int = WORDS, fanout: int = FANOUT) -> DataFrame:
    """(node, tree, rep) of the children of nodes: each class by fresh minwise tokens of its whole set;
    ``members``: node, tree, rep; ``classes``: rep, doc_id, set_key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1_000_000):
            nodes, trees, at = [], [], []
            for k, (t, key, own) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", "set_key", "nodes")), strict=True)):
                codes = shingles(t, words)
                if key_of(codes) != key:
                    continue
                for x in own:
                    for j in range(fanout):
                        salt = mixed(np.array([x["node"] & 0xFFFFFFFFFFFFFFFF], np.uint64) * np.uint64(GOLDEN) + np.uint64(j + 1))
                        nodes.append(int(mixed(mixed(codes ^ salt).min()[None] + salt).view(np.int64)[0]))
                        trees.append(x["tree"])
                        at.append(k)
            of = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(trees, pa.int32()), b.column("rep").take(of)], ["node", "tree", "rep"])

    wanted = members.groupBy("rep").agg(F.collect_set(F.struct("node", "tree")).alias("nodes")).join(classes.select("rep", "doc_id", "set_key"), "rep")
    own = among(docs, members, classes).join(wanted, "doc_id")
    return own.select("rep", "set_key", "nodes", "text").mapInArrow(run, "node long, tree int, rep long").distinct()


def key_of(codes: np.ndarray) -> bytes:
    return hashlib.blake2b(codes.tobytes(), digest_size=16).digest()


def among(docs: DataFrame, reps: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, text of the documents that name classes ``reps`` (rep), and few others: those whose id is in a bitmap."""
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * classes.count()).bit_length()))
    place = lambda doc_id: F.shiftrightunsigned(F.xxhash64(doc_id), 64 - bits)
    ids = classes.join(reps.select("rep").distinct(), "rep", "left_semi").select(place("doc_id").alias("at"))
    parts = ids.groupBy(F.shiftright("at", PART_BITS).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND((1 << PART_BITS) - 1)).alias("bits"))
    held = np.zeros((1 << bits - PART_BITS, (1 << PART_BITS) // 8), np.uint8)
    for r in parts.toLocalIterator():
        held[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(held.reshape(-1))

    @F.arrow_udf("boolean")
    def there(at: pa.Array) -> pa.Array:
        x = np.asarray(at)
        return pa.array((shared.value[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.where(there(place("doc_id")))


def full_sets(reps: DataFrame, classes: DataFrame, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(rep, codes): the whole sets of classes ``reps`` (rep) and few others, one row each; ``classes``: rep, doc_id."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1_000_000):
            found = [s for s in (shingles(t, words) for t in b.column("text").to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(key_of, found)), pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["set_key", "codes"])

    own = among(docs, reps, classes).select("text").mapInArrow(sets, "set_key binary, codes binary")
    return own.groupBy(F.xxhash64("set_key").alias("rep")).agg(F.first("codes").alias("codes"))


def linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets reach the threshold; ``classes``: rep, doc_id."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            out: list[tuple[int, int]] = []
            for x, y, codes in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("codes").to_pylist(), strict=True):
                own = np.frombuffer(codes, np.uint64)
                if y is None:
                    a, held = x, own
                    continue
                if x != a or not len(held):
                    continue
                at = np.minimum(np.searchsorted(held, own), len(held) - 1)
                both = int((held[at] == own).sum())
                if 100 * both >= percent * (len(held) + len(own) - both):
                    out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])

    full = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("rep")), classes, docs, words)
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    right = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("rep"))
    left = salts.select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("rep"))
    # One join for both sides: sets are read and dealt by their class once.
    met = left.unionByName(right).join(full, "rep").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return met.select("a", "b", "codes").mapInArrow(compare, "a long, b long")


def contracted(links: DataFrame, tasks: int) -> DataFrame:
    """(a, b) that join what ``links`` join: each task puts the smallest id of every component of its own links beside all its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.asarray(b.column("a")), np.asarray(b.column("b"))) for b in batches]
        if not held:
            return
        ids, at = np.unique(np.concatenate([x for pair in zip(*held, strict=True) for x in pair]), return_inverse=True)
        x, y = at[: len(at) // 2], at[len(at) // 2 :]
        label = np.arange(len(ids))
        while True:  # smallest label of both sides, then of that label, until nothing changes
            low = np.minimum(label[x], label[y])
            fresh = label.copy()
            np.minimum.at(fresh, x, low)
            np.minimum.at(fresh, y, low)
            np.minimum.at(fresh, label[x], low)
            np.minimum.at(fresh, label[y], low)
            fresh = fresh[fresh]
            if (fresh == label).all():
                break
            label = fresh
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["a", "b"])

    return links.select("a", "b").repartition(tasks).mapInArrow(run, "a long, b long")


def components(links: DataFrame, limit: int = 60, links_a_task: int = LINKS_A_TASK) -> DataFrame:
    """(rep, label) of every id in ``links`` (a, b): the smallest id that it is connected with.

    Tasks first join what their own share of the links, of a bounded size, joins.  Where there are several, rounds follow in
    which every id takes the smallest label of itself and its neighbours, then the label of that label.
    """
    tasks = -(-links.count() // links_a_task)
    near = stored(contracted(links, max(1, tasks)))
    if tasks <= 1:
        return renamed(near, a="rep", b="label")
    edges = stored(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(edges.groupBy(F.col("a").alias("rep")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    for _ in range(limit):
        around = edges.join(labels.select(F.col("rep").alias("b"), "label"), "b").groupBy(F.col("a").alias("rep")).agg(F.min("label").alias("near"))
        lower = labels.join(around, "rep", "left").select("rep", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        jump = labels.select(F.col("rep").alias("low"), F.col("label").alias("far"))
        fresh = stored(lower.join(jump, "low", "left").select("rep", F.col("label").alias("old"), F.least("low", F.coalesce("far", "low")).alias("label")))
        discard(labels)
        labels = fresh
        if fresh.where("old <> label").isEmpty():
            discard(edges, near)
            return renamed(labels, rep="rep", label="label")
    raise RuntimeError(f"components did not settle in {limit} rounds")


def renamed(held: DataFrame, **names: str) -> DataFrame:
    """Some columns of a stored table under other names, still to be discarded as one."""
    out = held.select(*[F.col(k).alias(v) for k, v in names.items()])
    out._stored_at = held._stored_at
    return out


def joined(classes: DataFrame, docs: DataFrame, percent: int, words: int, small: int, depth: int, pairs_a_node: int) -> DataFrame | None:
    """(rep, label) of the classes that are linked with others, or None; ``classes``: rep, doc_id, set_key, roots, sig."""
    labels: DataFrame | None = None

    def take(links: DataFrame) -> None:
        """Join what these links (a, b) link."""
        nonlocal labels
        links = stored(links)
        if not links.isEmpty():
            old = labels
            known = links if old is None else links.unionByName(old.select(F.col("rep").alias("a"), F.col("label").alias("b")).where("a <> b"))
            labels = components(known)
            discard(old)
        discard(links)

    def check(pairs: DataFrame) -> None:
        """Take the links among pairs (a, b), without those whose sides are in one component already."""
        if labels is not None:
            label_of = lambda name: labels.select(F.col("rep").alias(name), F.col("label").alias(f"label_{name}"))
            pairs = pairs.join(label_of("a"), "a", "left").join(label_of("b"), "b", "left")
            pairs = pairs.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")
        pairs = stored(pairs)
        if not pairs.isEmpty():
            take(linked(pairs, classes, docs, percent, words))
        discard(pairs)
        release(docs.sparkSession)

    def opened(members: DataFrame) -> DataFrame:
        """Members (node, tree, rep) of nodes with open pairs: adds label, n, apart (how many), major (label), n_major."""
        named = members.withColumn("label", F.col("rep"))
        if labels is not None:
            named = members.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        parts = named.groupBy("node", "label").agg(F.count(F.lit(1)).alias("c"))
        n, squares = F.sum("c"), F.sum(F.col("c").cast("double") * F.col("c"))
        nodes = parts.groupBy("node").agg(n.alias("n"), ((n.cast("double") * n - squares) / 2).alias("apart"), F.max(F.struct("c", "label")).alias("m"))
        nodes = nodes.where("apart > 0").select("node", "n", "apart", F.col("m.label").alias("major"), F.col("m.c").alias("n_major"))
        return stored(named.join(nodes, "node"))

    def leaders(large: DataFrame, first: int, last: int) -> DataFrame:
        some = large.where(F.col("tree").between(first, last))
        if labels is None:
            return leader_pairs(some.withColumn("label", F.col("rep")))
        return leader_pairs(some.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep")))

    plain = ["node", "tree", "rep"]
    members = rooted(classes)
    for level in range(depth + 1):
        # Rows alone in their node go no further.
        sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        held = stored(members.join(sizes, "node").join(classes.select("rep", "sig"), "rep"))
        large = held.where(F.col("n") > small)
        any_large = not large.isEmpty()
        pairs = stored(node_pairs(held.where(F.col("n") <= small)).groupBy("a", "b").agg(F.max("first").alias("first")))
        for (first, last), which in zip(LEADERS, ("first", "not first"), strict=True):
            some = pairs.where(which).select("a", "b")
            check(some.unionByName(leaders(large, first, last)).distinct() if any_large else some)
        discard(pairs)
        if not any_large:
            discard(held)
            break
        rest = opened(large.select(plain))
        discard(held)
        now = rest if level == depth else rest.where(F.col("apart") <= pairs_a_node)
        take(open_links(now, classes, docs, percent, words))
        wide = rest.where(F.col("apart") > pairs_a_node).select(plain)
        if level == depth or wide.isEmpty():
            discard(rest)
            break
        members = stored(branched(wide, classes, docs, words))
        discard(rest)
    return labels


def judged(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, small: int = SMALL, depth: int = DEPTH, pairs_a_node: int = PAIRS_A_NODE) -> DataFrame:
    """doc_id, text_hash, n_shingles, group, component_id: a row for every row of ``docs`` (doc_id, text); ``group`` names what
    is linked, and is null without words.
    """
    sets = stored(document_sets(docs, words))
    full = sets.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = stored(full.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("roots").alias("roots"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")).withColumn("rep", F.xxhash64("set_key")))
    labels = joined(classes, docs, percent, words, small, depth, pairs_a_node)
    named = classes.select("set_key", F.col("doc_id").alias("component_id"), F.col("rep").alias("group"))
    if labels is not None:
        # A component is called by its smallest doc_id.
        least = classes.join(labels, "rep").groupBy("label").agg(F.min("doc_id").alias("least"))
        called = labels.join(least, "label").select(F.col("rep").alias("group"), "least", "label")
        named = named.join(called, "group", "left").select("set_key", F.coalesce("least", "component_id").alias("component_id"), F.coalesce("label", "group").alias("group"))
    out = sets.select("doc_id", "text_hash", "n_shingles", "set_key").join(named, "set_key", "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("set_key").isNotNull(), F.coalesce("group", F.xxhash64("set_key"))).alias("group"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for every row of ``docs`` (doc_id, text)."""
    same = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return judged(docs, **options).select("doc_id", "n_shingles", "component_id", same.alias("kept"))


def without_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row left of each group, one of the smallest id (ids before null); rows without words all stay.

    Of rows that share id and text one stays.
    """
    found = judged(docs, **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    winners = found.where("`group` IS NOT NULL").groupBy("group").agg(first).select("first.doc_id", "first.text_hash", F.lit(True).alias("one"))
    empty = found.where("`group` IS NULL").select("doc_id", "text_hash", F.lit(False).alias("one")).distinct()
    stay = stored(winners.unionByName(empty).select(F.col("doc_id").alias("id"), "text_hash", "one"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_hash"))
    met = rows.join(stay, rows["own_id"].eqNullSafe(stay["id"]) & (rows["own_hash"] == stay["text_hash"]))
    key = ["id", "text_hash"]
    if met.where("one").groupBy(key).count().where("count > 1").isEmpty():
        return met.select("row.*")
    ranked = met.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64("row"))))
    return ranked.where("turn = 1 OR NOT one").select("row.*")
