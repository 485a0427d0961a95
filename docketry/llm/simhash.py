"""SimHash near-duplicate classes with a Gray-order hierarchical index.

A task sorts its fingerprints by Gray rank and builds a tree: a leaf is a run of neighbours, an upper node a run of nodes; the bits
that all members share are factored out as the node's masked pattern, a child keeps only what its parent lacks. A search adds up the
differences from the root and drops a whole group as soon as they exceed the limit (or once the group is linked to the query already).

A table of up to about ``tree_codes`` fingerprints is one tree. A larger one is dealt by blocks of bits: fingerprints that differ in at
most ``limit`` bits agree in one of limit + 1 blocks, so each fingerprint goes to limit + 1 trees, dealt by a hash of the
block's bits, and no link is lost. A block value that too many fingerprints share is dealt again by the blocks of its other bits. Only edges of a
spanning forest leave a tree; classes are joined across trees by alternating large-star and small-star steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.hashing import mixed
from docketry.llm.shared import bounded_batches, stash, table, text_bytes

SEED = 42
#: Members of a leaf and children of an upper node.
FANOUT = 8
#: (query, node) pairs that a search holds at most.
FRONTIER = 1_000_000
BITS = 64
#: Fingerprints of a tree, about: a small limit prunes large trees well, a wide one is better off with small ones.
TREE_CODES, WIDE_TREE_CODES = 16_384, 2048
#: A fingerprint that more rows hold than this (or than a 100,000th of all rows) is joined by broadcast; so at most 100,000 are.
HOT_ROWS = 10_000
#: Near copies that an exact test decides: words of a shingle and least Jaccard similarity; bits their fingerprints may differ in.
ALIKE_WIDTH, ALIKE_LEAST, ALIKE_LIMIT = 5, (4, 5), 8
#: Words of the shingles in those fingerprints: a changed word spoils fewer short shingles, so that alike texts differ in fewer bits.
ALIKE_PRINT = 2
#: Fingerprints of a text for near copies, of independent bits: a pair is a candidate if one of them is within the limit.
ALIKE_PRINTS = 2
#: Bins that the shingles of a text are counted in, to bound how many two texts can share; a text with a fuller bin than FULL may be like any other.
BINS, FULL = 256, 255
#: Rows whose keys are broadcast rather than shuffled with the texts.
BROADCAST_ROWS = 1_000_000
#: Pairs that a fingerprint may have tested in the first round after a failed test, and how many times more in each round after that.
NEAREST, GROWTH = 2, 16


def fingerprint(data: bytes, width: int = 3) -> int:
    """SimHash of a UTF-8 text: lower-case ASCII letters, words between ASCII white space, shingles of ``width`` words.

    A bit is set if it is set in over half of the shingles' XXH64. Fewer words than ``width`` are one shingle; none give 0.
    """
    return fingerprints(data, width, 1)[0]


def fingerprints(data: bytes, width: int, prints: int) -> list[int]:
    """:func:`fingerprint`, and others of bits that are mixed from the same hashes."""
    import xxhash

    words = data.lower().split()
    if not words:
        return [0] * prints
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    w = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    counts, total = np.zeros((prints, BITS), np.int64), len(words) - w + 1
    for at in range(0, total, 1 << 16):
        pairs = zip(starts[at : min(at + (1 << 16), total)].tolist(), ends[at + w - 1 :].tolist(), strict=False)
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in pairs), np.uint64)
        for k in range(prints):
            bits = mixed(hashes + np.uint64(k)) if k else hashes
            counts[k] += np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return [int(x) for x in np.packbits(counts * 2 > total, axis=1, bitorder="little").view(np.uint64)[:, 0]]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


@F.pandas_udf(T.StructType([T.StructField("code", T.LongType()), T.StructField("words", T.LongType())]))
def _fingerprints(texts: pd.Series, widths: pd.Series) -> pd.DataFrame:
    code = pd.Series([signed(fingerprint(bytes(t), int(w))) for t, w in zip(texts, widths, strict=True)], dtype="int64")
    return pd.DataFrame({"code": code, "words": _words(texts)})


@F.pandas_udf(T.StructType([T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("words", T.LongType()), T.StructField("bins", T.BinaryType())]))
def _fingerprints_and_bins(texts: pd.Series, widths: pd.Series) -> pd.DataFrame:
    codes = [[signed(c) for c in fingerprints(bytes(t), int(w), ALIKE_PRINTS)] for t, w in zip(texts, widths, strict=True)]
    return pd.DataFrame({"codes": pd.Series(codes, dtype=object), "words": _words(texts), "bins": pd.Series([shingle_bins(bytes(t)) for t in texts], dtype=object)})


def _words(texts: pd.Series) -> pd.Series:
    import xxhash

    return pd.Series([signed(xxhash.xxh64_intdigest(b" ".join(bytes(t).lower().split()), SEED)) for t in texts], dtype="int64")


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint", width: int = 3) -> DataFrame:
    """Add the 64-bit fingerprint as a long; null texts are empty."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(name, _fingerprints(text_bytes(text_col), F.lit(width)).getField("code"))


@lru_cache(4096)
def blocks(mask: int, limit: int) -> tuple[int, ...]:
    """``mask`` with each of limit + 1 blocks of the bits outside it; none if fewer bits are left. Two codes that agree under ``mask`` and are within ``limit`` agree under one of them."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    if len(free) < limit + 1:
        return ()
    return tuple(mask | sum(1 << int(b) for b in part) for part in np.array_split(free, limit + 1))


def way(key: int, limit: int) -> tuple[int, list[int]]:
    """Mask of a key, and the masks before it on the way there: a pair belongs to the first that it agrees under, so to one key.

    Key 0 has the empty mask; the ``limit`` + 1 children of key k are numbered from k * (limit + 1) + 1 on.
    """
    if not key:
        return 0, []
    parent, k = divmod(key - 1, limit + 1)
    mask, before = way(parent, limit)
    return blocks(mask, limit)[k], before + list(blocks(mask, limit)[:k])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Trees over fingerprints, one for each group; all levels are flat arrays, and places are those of the sorted ``codes``.

    ``visited`` counts the (query, node or member) pairs that a search looked at, ``pruned`` the groups that it dropped whole.
    """

    def __init__(self, groups: np.ndarray, codes: np.ndarray) -> None:
        self.order = np.lexsort((gray_rank(codes), groups))
        self.codes, self.groups = codes[self.order], groups[self.order]
        #: first child, end, mask, pattern and end place of each node; leaves first
        self.levels: list[tuple[np.ndarray, ...]] = []
        every, any_, stop = self.codes, self.codes, np.arange(1, len(codes) + 1)
        owner = self.groups
        while True:
            new = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[new, len(owner)])
            within = np.arange(len(owner)) - np.repeat(new, sizes)
            firsts = np.flatnonzero(within % FANOUT == 0)
            ends = np.r_[firsts[1:], len(owner)]
            every, any_ = np.bitwise_and.reduceat(every, firsts), np.bitwise_or.reduceat(any_, firsts)
            stop = stop[ends - 1]
            self.levels.append((firsts, ends, ~(every ^ any_), every, stop))
            owner = owner[firsts]
            if len(owner) == len(new):
                break
        starts = np.flatnonzero(np.r_[True, self.groups[1:] != self.groups[:-1]])
        sizes = np.diff(np.r_[starts, len(codes)])
        self.group_size, self.root = np.repeat(sizes, sizes), np.repeat(np.arange(len(starts)), sizes)
        self.visited = self.pruned = self.asked = 0
        self.link(np.arange(len(codes)))

    def link(self, classes: np.ndarray) -> None:
        """Let searches leave out pairs of one class (a number for each place)."""
        self.classes, self.one_class = classes, []
        least = most = classes
        for firsts, *_ in self.levels:
            least, most = np.minimum.reduceat(least, firsts), np.maximum.reduceat(most, firsts)
            self.one_class.append(np.where(least == most, least, -1))

    def pairs(self, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places a < b and differing bits of the pairs that share a group, differ in at most ``limit`` bits and are not of one class; all of an a at once."""
        asked = np.flatnonzero(self.group_size > 1)
        at = 0
        while at < len(asked):
            least = max(1, FRONTIER // int(self.group_size[asked[at]]))
            each = self.visited / self.asked if self.asked else math.inf
            batch = asked[at : at + int(np.clip(FRONTIER / each if each else least, least, 8 * least))]
            yield self._search(batch, limit)
            self.asked += len(batch)
            at += len(batch)

    def _search(self, rows: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nodes = self.root[rows]
        seen = self.levels[-1][2][nodes]  # a member has its root's pattern, so nothing differs yet
        gone = np.zeros(len(rows), np.uint8)
        for level in range(len(self.levels) - 1, -1, -1):
            first, end = self.levels[level][:2]
            width = end[nodes] - first[nodes]
            rows, gone, seen = np.repeat(rows, width), np.repeat(gone, width), np.repeat(seen, width)
            nodes = np.repeat(first[nodes] - (np.cumsum(width) - width), width) + np.arange(len(rows))
            self.visited += len(rows)
            if not level:
                break
            _, _, mask, pattern, stop = self.levels[level - 1]
            ahead = stop[nodes] > rows + 1  # the others hold no later place
            rows, nodes, gone, seen = rows[ahead], nodes[ahead], gone[ahead], seen[ahead]
            here = mask[nodes]
            gone = gone + np.bitwise_count((self.codes[rows] ^ pattern[nodes]) & here & ~seen)
            keep = (gone <= limit) & (self.one_class[level - 1][nodes] != self.classes[rows])
            self.pruned += len(keep) - int(np.count_nonzero(keep))
            rows, nodes, gone, seen = rows[keep], nodes[keep], gone[keep], here[keep]
        keep = (nodes > rows) & (self.classes[nodes] != self.classes[rows])
        rows, nodes, gone, seen = rows[keep], nodes[keep], gone[keep], seen[keep]
        gone = gone + np.bitwise_count((self.codes[rows] ^ self.codes[nodes]) & ~seen)
        keep = gone <= limit
        return rows[keep], nodes[keep], gone[keep]


def spanning(index: GrayIndex, limit: int, allowed) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a forest that joins all places which allowed pairs within ``limit`` join, the nearest pairs first."""
    parent = np.arange(int(index.classes.max()) + 1).tolist() if len(index.classes) else []

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for radius in sorted({(limit + 1) // 2, limit}):
        for a, b, gone in index.pairs(radius):
            keep = allowed(a, b)
            order = np.argsort(gone[keep], kind="stable")
            a, b = a[keep][order], b[keep][order]
            used = []
            for k, (x, y) in enumerate(zip(index.classes[a].tolist(), index.classes[b].tolist(), strict=True)):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    used.append(k)
            if used:
                yield a[used], b[used]
                root = np.array(parent)
                while not np.array_equal(up := root[root], root):
                    root = up
                index.link(root[index.classes])


def nearest(index: GrayIndex, limit: int, allowed, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Allowed pairs within ``limit``, for each first place at most the ``most`` nearest."""
    for a, b, gone in index.pairs(limit):
        keep = allowed(a, b)
        a, b, gone = a[keep], b[keep], gone[keep]
        order = np.lexsort((b, gone, a))
        a, b = a[order], b[order]
        firsts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]][: len(a)])
        turn = np.arange(len(a)) - np.repeat(firsts, np.diff(np.r_[firsts, len(a)]))
        yield a[turn < most], b[turn < most]


def dealt(units: DataFrame, limit: int, tree_codes: int) -> DataFrame:
    """``units`` with (key, bits), once for each key that it belongs to: no key and bits are shared by more than 2 * ``tree_codes`` different codes."""
    most = 2 * tree_codes
    done = None
    at = units.withColumns({"key": F.lit(0).cast("long"), "bits": F.lit(0).cast("long")})
    hot = [0] if units.count() > most else []
    while hot := [k for k in hot if blocks(way(k, limit)[0], limit)]:
        children = [F.struct(F.lit(c).cast("long").alias("key"), F.lit(signed(way(c, limit)[0])).alias("mask")) for k in hot for c in range(k * (limit + 1) + 1, (k + 1) * (limit + 1) + 1)]
        of = F.create_map(*[x for i, k in enumerate(hot) for x in (F.lit(k).cast("long"), F.array(*children[i * (limit + 1) : (i + 1) * (limit + 1)]))])
        at = at.withColumn("to", F.explode(F.element_at(of, F.col("key"))))
        at = stash(at.withColumns({"key": F.col("to.key"), "bits": F.col("code").bitwiseAND(F.col("to.mask"))}).drop("to"), "simhash-keys")
        sizes = at.select("key", "bits", "code").distinct().groupBy("key", "bits").agg(F.count(F.lit(1)).alias("n"))
        full = stash(sizes.filter(F.col("n") > most).select("key", "bits"), "simhash-full")
        hot = [r["key"] for r in full.select("key").distinct().collect()]
        if hot:
            small = at.join(full, ["key", "bits"], "left_anti")
            done = small if done is None else done.unionByName(small)
            at = at.join(full, ["key", "bits"], "left_semi")
    return at if done is None else done.unionByName(at)


def near_edges(units: DataFrame, limit: int = 2, tree_codes: int = TREE_CODES, most: int | None = None) -> DataFrame:
    """(u, v) that connect all units (unit, code, and optionally label and refused) whose codes are within ``limit`` bits.

    Units of one ``label`` count as connected; pairs with a unit in the array ``refused`` of either are left out, and those that cannot be alike by their ``bins``. Without ``most`` the edges of each
    tree are a forest; with it they are all pairs, but for each unit the nearest ``most`` of those that its tree has after it. Every pair belongs to one tree.
    """
    if "label" not in units.columns:
        units = units.withColumn("label", F.col("unit"))
    for name, kind in (("refused", "array<long>"), ("bins", "binary")):
        if name not in units.columns:
            units = units.withColumn(name, F.lit(None).cast(kind))
    rows = dealt(units.select("unit", "code"), limit, tree_codes).join(units.select("unit", "label", "refused", "bins"), "unit")
    trees = max(1, math.ceil(units.count() / tree_codes))
    rows = rows.withColumn("tree", F.pmod(F.xxhash64("key", "bits"), F.lit(trees)).cast("int"))
    tasks = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, trees))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [p for p in batches if len(p)]
        if not parts:
            return
        held = pd.concat(parts, ignore_index=True).sort_values(["key", "tree", "unit"], kind="stable", ignore_index=True)
        key, tree, unit = (held[c].to_numpy() for c in ("key", "tree", "unit"))
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tree[1:] != tree[:-1])])
        for at, to in zip(starts, np.r_[starts[1:], len(held)], strict=True):
            part = held.iloc[at:to]
            index = GrayIndex(np.zeros(to - at, np.int64), part["code"].to_numpy().view(np.uint64))
            names, of = unit[at:to], unit[at:to][index.order]
            index.link(np.unique(part["label"].to_numpy()[index.order], return_inverse=True)[1])
            own, before = way(int(key[at]), limit)
            own, before = np.uint64(own), [np.uint64(m) for m in before]
            place = np.empty(to - at, np.int64)
            place[index.order] = np.arange(to - at)
            bad = []
            for k, refused in enumerate(part["refused"]):
                if refused is not None and len(refused):
                    there = np.searchsorted(names, refused)
                    there = there[(there < len(names)) & (names[np.minimum(there, len(names) - 1)] == refused)]
                    bad += [(min(x, y), max(x, y)) for x, y in zip(place[there].tolist(), [int(place[k])] * len(there), strict=True)]
            banned = np.array(sorted({x * (to - at) + y for x, y in bad}), np.int64)
            bins = None
            if part["bins"].notna().all():
                bins = np.frombuffer(b"".join(part["bins"]), np.uint8).reshape(-1, BINS)[index.order]

            def allowed(a: np.ndarray, b: np.ndarray, index=index, own=own, before=before, banned=banned, bins=bins) -> np.ndarray:
                differ = index.codes[a] ^ index.codes[b]
                keep = differ & own == 0
                for m in before:
                    keep &= differ & m != 0
                if len(banned):
                    keep &= ~np.isin(a * len(index.codes) + b, banned)
                if bins is not None:
                    at = np.flatnonzero(keep)
                    for k in range(0, len(at), 1 << 14):
                        some = at[k : k + (1 << 14)]
                        keep[some] = can_be_alike(bins[a[some]], bins[b[some]])
                return keep

            for a, b in spanning(index, limit, allowed) if most is None else nearest(index, limit, allowed, most):
                yield pd.DataFrame({"u": of[a], "v": of[b]})

    return rows.repartition(tasks, "key", "tree").mapInPandas(search, "u long, v long")


def are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v only and is itself no v; rows may repeat."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("up")), F.struct(F.col("v").alias("node"), F.lit(None).cast("long").alias("up")))
    nodes = edges.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.min("e.up").alias("least"), F.max("e.up").alias("most"), F.bool_or(F.isnull("e.up")).alias("centre"))
    return not nodes.filter("least <> most OR (centre AND least IS NOT NULL)").count()


def star_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v), root the smallest node it is connected to.

    Alternating large-star and small-star steps, which keep what is connected so, until only stars are left, whose centres are the smallest
    nodes; each step's edges are written to the shared folder. A large-star step writes a row for each edge at most, so repeats stay in it.
    """
    one_way = lambda df: df.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = stash(one_way(edges).distinct(), "star-edges")
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        edges = stash(one_way(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "star-large")
        if are_stars(edges):
            break
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = stash(one_way(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))).distinct(), "star-small")
        if are_stars(edges):
            break
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) of ``labels`` (of :func:`star_components`) after ``edges`` (u, v) have joined their classes; only edges between classes are followed."""
    for side in ("u", "v"):
        edges = edges.join(labels.toDF(side, "root"), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
    up = stash(star_components(edges), "star-joined")
    old = labels.join(up.toDF("root", "upper"), "root", "left").select("node", F.coalesce("upper", "root").alias("root"))
    return old.unionByName(up)  # the smallest node of a class is no ``node``


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, limit: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (long), component_id (the smallest id reachable over links).

    Null texts are empty; texts without words have fingerprint 0 and link to each other; repeated rows stay, each with its row; a null id
    is no candidate for the smallest unless all ids of a class are null. Other columns are not read; an empty table gives no rows.
    """
    rows = with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", width=width).drop("text")
    rows = stash(rows, "simhash-rows")
    codes = stash(rows.groupBy(F.col("fingerprint").alias("code")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-codes")
    roots = star_components(near_edges(codes.select(F.col("code").alias("unit"), "code"), limit))
    classes = codes.join(roots, F.col("code") == F.col("node"), "left").select("code", "least", "n", F.coalesce("root", "code").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    known = stash(classes.join(smallest, "root").select(F.col("code").alias("fingerprint"), "component_id", "n"), "simhash-known")
    hot = F.col("n") > max(HOT_ROWS, rows.count() // 100_000)
    often, seldom = known.filter(hot).drop("n"), known.filter(~hot).drop("n")
    rest = rows.join(F.broadcast(often.select("fingerprint")), "fingerprint", "left_anti")
    found = rest.join(seldom, "fingerprint").unionByName(rows.join(F.broadcast(often), "fingerprint"))
    return found.select("doc_id", "fingerprint", "component_id")


@lru_cache(64)
def _shingles(data: bytes, width: int) -> frozenset[tuple[bytes, ...]]:
    words = data.lower().split()
    w = min(width, len(words))
    return frozenset(zip(*[words[k : len(words) - w + 1 + k] for k in range(w)], strict=True)) if words else frozenset()


def similar(a: bytes, b: bytes, width: int = ALIKE_WIDTH, least: tuple[int, int] = ALIKE_LEAST) -> bool:
    """Whether the sets of shingles of two texts have a Jaccard similarity of ``least`` (a fraction) or more; texts without words are similar to each other."""
    x, y = _shingles(a, width), _shingles(b, width)
    if min(len(x), len(y)) * least[1] < max(len(x), len(y)) * least[0]:
        return False
    both = len(x & y)
    return both * least[1] >= (len(x) + len(y) - both) * least[0]


def shingle_bins(data: bytes, width: int = ALIKE_WIDTH) -> bytes:
    """How many distinct shingles of a text fall into each of ``BINS`` bins by their hash, a byte each, ``FULL`` at most."""
    import xxhash

    words = data.lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    w = min(width, len(words))
    total = len(words) - w + 1 if words else 0
    code = np.zeros(total, np.uint64)
    for k in range(w):
        code = mixed(code + h[k : k + total])
    return np.minimum(np.bincount((np.unique(code) % np.uint64(BINS)).astype(np.int64), minlength=BINS), FULL).astype(np.uint8).tobytes()


def can_be_alike(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = ALIKE_LEAST) -> np.ndarray:
    """False only for rows of bins of texts whose similarity is below ``least``: two texts share at most the sum of the lesser counts."""
    shared = np.minimum(a, b).sum(1, dtype=np.int64)
    sizes = a.sum(1, dtype=np.int64) + b.sum(1, dtype=np.int64)
    return (shared * (least[0] + least[1]) >= sizes * least[0]) | (a.max(1, initial=0) == FULL) | (b.max(1, initial=0) == FULL)


@F.pandas_udf(T.BooleanType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similar(bytes(x), bytes(y)) for x, y in zip(a, b, strict=True)], dtype=bool)


def _few(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if a count shows it to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def alike_units(units: DataFrame, rows: DataFrame, limit: int = ALIKE_LIMIT, tree_codes: int = WIDE_TREE_CODES) -> DataFrame:
    """(node, root) of units that are linked by pairs within ``limit`` bits whose texts are :func:`similar`.

    ``units`` has (unit, codes, bins), ``ALIKE_PRINTS`` fingerprints each, ``rows`` (unit, text as bytes) with at least those units. A forest of the index's links, and of each code the links to its
    first unit, are tested on the texts first; pairs that cannot be alike by their bins are no links.
    Where a test fails, classes that the failed edges touch are searched again for pairs that lead out of them, the ``NEAREST`` first, ``GROWTH`` times as
    many in each later round, until every pair of different classes has been tested (no unit had pairs left out); so pairs within a class cost no test, nor do those whose counts of
    shingles in bins show that they cannot be alike.
    """
    no_edges = units.sparkSession.createDataFrame([], "u long, v long")
    of_print = lambda df, k: df.withColumn("code", F.col("codes")[k]).drop("codes")
    edges = no_edges
    for k in range(ALIKE_PRINTS):
        coded = of_print(units, k)
        firsts = stash(coded.groupBy("code").agg(F.min_by("bins", "unit").alias("bins"), F.min("unit").alias("unit")), "alike-codes")
        equal = coded.select("unit", "code").join(firsts.select("code", F.col("unit").alias("first")), "code").filter("unit <> first").select(F.col("first").alias("u"), F.col("unit").alias("v"))
        edges = edges.unionByName(stash(near_edges(firsts, limit, tree_codes).unionByName(equal), "alike-edges"))
    edges = stash(edges.distinct(), "alike-edges")
    needed = _few(edges.select(F.explode(F.array("u", "v")).alias("unit")).distinct())
    texts = stash(rows.join(needed, "unit").select("unit", "text"), "alike-texts")
    refused, labels, most, whole = no_edges, None, NEAREST, False
    while True:
        sides = edges.join(texts.select(F.col("unit").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("unit").alias("v"), F.col("text").alias("b")), "v")
        tested = stash(sides.select("u", "v", _similar("a", "b").alias("alike")), "alike-tested")
        found, failed = tested.filter("alike").drop("alike"), tested.filter("NOT alike").drop("alike")
        if not found.isEmpty():
            labels = stash(star_components(found) if labels is None else joined(labels, found), "alike-labels")
        if whole or (most == NEAREST and failed.isEmpty()):
            break
        refused = refused.unionByName(failed)
        known = texts.select("unit")
        if labels is not None:
            known = known.join(labels.withColumnRenamed("node", "unit"), "unit", "left").select("unit", F.coalesce("root", "unit").alias("label"))
        else:
            known = known.withColumn("label", F.col("unit"))
        known = stash(known, "alike-known")
        touched = refused.select(F.explode(F.array("u", "v")).alias("unit")).join(known, "unit").select("label").distinct()
        others = refused.groupBy(F.col("u").alias("unit")).agg(F.collect_list("v").alias("refused"))
        again = known.join(touched, "label", "left_semi").join(units, "unit").join(others, "unit", "left")
        again = stash(again.select("unit", "codes", "label", "refused", "bins"), "alike-again")
        found = [stash(near_edges(of_print(again, k), limit, tree_codes, most), "alike-edges") for k in range(ALIKE_PRINTS)]
        whole = all(x.groupBy("u").count().filter(F.col("count") >= most).isEmpty() for x in found)
        edges = stash(reduce(DataFrame.unionByName, found).distinct(), "alike-edges")
        if edges.isEmpty():
            break
        most *= GROWTH
    return no_edges.toDF("node", "root") if labels is None else labels


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = ALIKE_PRINT, limit: int = ALIKE_LIMIT, tree_codes: int = WIDE_TREE_CODES) -> DataFrame:
    """Rows of ``docs`` with all their columns, one of each group of near copies: that with the smallest id (nulls last, of repeated rows the first written).

    Texts with the same words (ASCII case aside) are copies. Others are near copies if one of their ``ALIKE_PRINTS`` fingerprints differs in at most ``limit`` bits and their
    five-word shingles have a Jaccard similarity of 0.8 or more; a group is what such pairs connect. Null texts are empty, and texts without words copies
    of each other. Texts are written once with their fingerprints and not shuffled, unless more than ``BROADCAST_ROWS`` rows go or are to be tested.
    An empty table gives no rows; columns of any name are kept as they are.
    """
    bounded_batches(docs.sparkSession)
    print_of = _fingerprints_and_bins(text_bytes(text_col), F.lit(width)).alias("f")
    rows = docs.select(F.struct("*").alias("doc"), print_of, F.monotonically_increasing_id().alias("row"))
    rows = stash(rows.select("doc", "f.codes", "f.words", "f.bins", "row"), "copies-rows")
    name = F.col("doc").getField(id_col)
    best = rows.groupBy("codes", "words").agg(F.min(F.struct(name.isNull().alias("no_id"), name.alias("id"), "row")).alias("m"), F.max("bins").alias("bins"))  # equal words, equal bins
    units = stash(best.select(F.col("m.row").alias("unit"), "codes", "m", "bins"), "copies-units")
    texts = rows.select(F.col("row").alias("unit"), text_bytes(F.col("doc").getField(text_col)).alias("text"))
    roots = alike_units(units.select("unit", "codes", "bins"), texts, limit, tree_codes)
    classes = units.join(roots.withColumnRenamed("node", "unit"), "unit", "left").select("m", F.coalesce("root", "unit").alias("root"))
    kept = stash(classes.groupBy("root").agg(F.min("m").alias("m")).select("m.row"), "copies-kept")
    gone = stash(rows.select("row").join(kept, "row", "left_anti"), "copies-gone")
    return rows.join(_few(gone), "row", "left_anti").select("doc.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
