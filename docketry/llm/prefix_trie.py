"""Prefix trie of conversations by hashing of fixed-length blocks of turns.

Conversations are cut into blocks of ``BLOCK`` turns and grouped by successive block digests first: a block with the digest of all before it names a class, and copies
end there. Turn boundaries are refined only where classes with the same past diverge; a block without siblings is a chain whose nodes all have its members.

The digest of a past is the exclusive or of one 128-bit hash for each of its blocks, place included, so it is a running aggregate: no fold over a conversation, and one
of millions of turns is spread over tasks (turns are numbered by ranges, pasts are added up in two levels).

Sums over subtrees need no walk. A node of depth d has m members; each member but the smallest shares with a smaller one the words A of its first turns, and A covers at
least the node: so its subtree saves the sum of A over the members, less the smallest's A, less (m - 1) times the words before the node. Leaves are counted at their
smallest member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.llm.shared import stash, table

#: Turns of a block, and blocks whose digests are added up in one step.
BLOCK, STEP = 4, 1024
#: Ids of a range whose decimals are joined before they are hashed.
RANGE = 4096
#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
NO_IDS = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, digest, words) with ``place``, from 1 in order of turn (null first), ties by digest.

    Rows are dealt by ranges of (conv_id, turn, digest), so that one conversation may take many tasks; a range's rows are numbered on their own and moved by the
    counts of the ranges before it.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    ranges = stash(turns.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "trie-ranges")
    counts = ranges.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    # a conversation has few ranges, and only those that go on in a later one matter
    before = counts.withColumn("ahead", F.sum("n").over(W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1))).filter("ahead > 0")
    own = ranges.withColumn("own", F.row_number().over(W.partitionBy("conv_id", "range").orderBy(F.col("turn").asc_nulls_first(), "digest")))
    out = own.join(before.select("conv_id", "range", "ahead"), ["conv_id", "range"], "left")
    return out.select("conv_id", (F.col("own") + F.coalesce("ahead", F.lit(0))).cast("long").alias("place"), "digest", "words")


def digested(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, digest, words): a turn's MD5 of role and text (nulls are empty) and its number of words. Rows without an id are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.regexp_count(text, F.lit(WORD))
    return rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), words.cast("long").alias("words"))


def regrown(places: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, place, digest, words) of the rebuilt conversations of the query's contract, and (conv_id) with a null place for those left without turns.

    Conversation c gets the first h turns of c - c % ``every`` before its own after its first h, h = crc32(decimal c) % ``most``.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    heads = places.filter((F.col("conv_id") % every == 0) & (F.col("place") < most)).select(F.col("conv_id").alias("base"), F.col("place"), "digest", "words")
    sizes = heads.groupBy("base").agg(F.max("place").alias("size"))
    convs = places.groupBy("conv_id").agg(F.max("place").alias("turns")).select("conv_id", "turns", base.alias("base"), h.alias("h"))
    convs = convs.join(sizes, "base", "left").withColumn("got", F.least("h", F.coalesce("size", F.lit(0))))
    convs = stash(convs.select("conv_id", "turns", "base", "h", "got"), "trie-convs")
    given = convs.filter("got > 0").join(heads, "base").filter("place <= got").select("conv_id", "place", "digest", "words")
    own = places.join(convs.filter("turns > h").select("conv_id", "h", "got"), "conv_id").filter("place > h")
    own = own.select("conv_id", (F.col("got") + F.col("place") - F.col("h")).alias("place"), "digest", "words")
    none = convs.filter("got = 0 AND turns <= h").select("conv_id", F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("words"))
    return given.unionByName(own).unionByName(none)


def _half(digest: Column, k: int) -> Column:
    """Half ``k`` of a hexadecimal MD5 as a signed long."""
    return F.conv(F.substring(digest, 1 + 16 * k, 16), 16, -10).cast("long")


def blocks_of(turns: DataFrame, block: int = BLOCK, step: int = STEP) -> DataFrame:
    """(conv_id, k, x, y, before, at, last) of each block: number, digest and words of all before it, its turns as an array, and whether it ends its conversation.

    An element of ``at`` has the digest (x, y) of the past up to that turn, the turn's words, and the words up to it within the block.
    """
    rows = turns.filter("place IS NOT NULL").withColumn("k", F.floor((F.col("place") - 1) / block).cast("long"))
    cut = rows.groupBy("conv_id", "k").agg(F.array_sort(F.collect_list(F.struct("place", "digest", "words"))).alias("turns"))
    head = lambda i: F.md5(F.concat(F.col("k").cast("string"), F.lit(":"), F.array_join(F.transform(F.slice("turns", 1, i), lambda t: t["digest"]), ":")).cast("binary"))
    total = lambda n: F.aggregate(F.slice("turns", 1, n), F.lit(0).cast("long"), lambda s, t: s + t["words"])
    made = F.transform(F.sequence(F.lit(1), F.size("turns")), lambda i: F.struct(head(i).alias("d"), F.element_at("turns", i)["words"].alias("words"), total(i).alias("upto")))
    halves = F.transform("made", lambda m: F.struct(_half(m["d"], 0).alias("x"), _half(m["d"], 1).alias("y"), m["words"].alias("words"), m["upto"].alias("upto")))
    cut = cut.withColumn("made", made).select("conv_id", "k", halves.alias("made"))
    cut = cut.withColumns({"whole": F.element_at("made", -1), "far": F.floor(F.col("k") / step)})
    cut = stash(cut.select("conv_id", "k", "far", "made", "whole.x", "whole.y", F.col("whole.upto").alias("w")), "trie-blocks")
    sums = lambda over: [F.coalesce(F.expr("bit_xor(x)").over(over), F.lit(0)).alias("px"), F.coalesce(F.expr("bit_xor(y)").over(over), F.lit(0)).alias("py"), F.coalesce(F.sum("w").over(over), F.lit(0)).alias("pw")]
    upto = W.unboundedPreceding, -1
    near = cut.select("conv_id", "k", "far", "made", *sums(W.partitionBy("conv_id", "far").orderBy("k").rowsBetween(*upto)))
    steps = cut.groupBy("conv_id", "far").agg(F.expr("bit_xor(x)").alias("x"), F.expr("bit_xor(y)").alias("y"), F.sum("w").alias("w"), F.max("k").alias("end"))
    far = steps.select("conv_id", "far", F.col("end"), F.lead("far").over(W.partitionBy("conv_id").orderBy("far")).isNull().alias("final"), *[c.alias(n) for c, n in zip(sums(W.partitionBy("conv_id").orderBy("far").rowsBetween(*upto)), ("qx", "qy", "qw"), strict=True)])
    out = near.join(far, ["conv_id", "far"]).withColumns({"px": F.col("px").bitwiseXOR(F.col("qx")), "py": F.col("py").bitwiseXOR(F.col("qy")), "pw": F.col("pw") + F.col("qw")})
    at = F.transform("made", lambda m: F.struct(m["x"].bitwiseXOR(F.col("px")).alias("x"), m["y"].bitwiseXOR(F.col("py")).alias("y"), m["words"].alias("words"), m["upto"].alias("upto")))
    return out.select("conv_id", "k", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pw").alias("before"), at.alias("at"), (F.col("final") & (F.col("k") == F.col("end"))).alias("last"))


def digests_of_ids(ends: DataFrame, by: int = RANGE) -> DataFrame:
    """(depth, x, y, sha): SHA-256 of the ascending, comma-joined decimal ids (conv_id) of each node.

    Ids are joined by ranges of numbers first, so what passes one by one through the task of a node are ranges, not ids; the hash is fed as they come.
    """
    parts = ends.groupBy("depth", "x", "y", F.floor(F.col("conv_id") / by).cast("long").alias("range")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha = None, None
        for batch in batches:
            out = []
            for depth, x, y, ids in zip(batch["depth"], batch["x"], batch["y"], batch["ids"], strict=True):
                if (depth, x, y) != now:
                    if sha:
                        out.append((*now, sha.hexdigest()))
                    now, sha = (depth, x, y), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["depth", "x", "y", "sha"]).astype({"depth": "int64", "x": "int64", "y": "int64", "sha": object})
        if sha:
            yield pd.DataFrame([(*now, sha.hexdigest())], columns=["depth", "x", "y", "sha"])

    node = ["depth", "x", "y"]
    return parts.repartition(*node).sortWithinPartitions(*node, "range").select(*node, "ids").mapInPandas(digest, "depth long, x long, y long, sha string")


def prefix_trie(turns: DataFrame, block: int = BLOCK, step: int = STEP) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, place from 1, digest, words): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation is its digests in order of place; one with only a null place has no turns and ends at the root. Repeated conversations are members of one node each. Without conversations there
    is no node, not even the root.
    """
    turns = stash(turns.select("conv_id", "place", "digest", "words"), "trie-turns")
    node, past = ["depth", "x", "y"], ["k", "x", "y"]
    blocks = stash(blocks_of(turns, block, step), "trie-pasts")
    last = F.element_at("at", -1)
    depth = (F.col("k") * block + F.size("at")).alias("depth")
    ends = blocks.filter("last").select("conv_id", depth, last["x"].alias("x"), last["y"].alias("y"))
    ends = ends.unionByName(turns.filter("place IS NULL").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in node]))
    ends = stash(ends, "trie-ends")

    # classes of equal blocks after equal pasts; the digest of the past up to its last turn tells a block
    named = blocks.withColumns({"ex": last["x"], "ey": last["y"], "size": F.size("at")})
    key = [*past, "size", "ex", "ey"]
    classes = named.groupBy(*key).agg(F.first("at").alias("at"), F.first("before").alias("before"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.count_if("last").alias("ends"))
    classes = stash(classes, "trie-classes")
    lone = classes.groupBy(*past).agg(F.count(F.lit(1)).alias("siblings")).filter("siblings = 1").select(*past, F.lit(True).alias("lone"))
    classes = stash(classes.join(lone, past, "left").withColumn("lone", F.coalesce("lone", F.lit(False))), "trie-siblings")
    each = classes.select(*key, "before", "at", "n", "least", "ends", "lone", F.posexplode("at").alias("r", "t"))
    each = each.select(
        *[F.col(c).alias(f"_{c}") for c in key], "lone", (F.col("k") * block + F.col("r") + 1).alias("depth"), "t.x", "t.y", "t.words", (F.col("before") + F.col("t.upto") - F.col("t.words")).alias("before"),
        F.when(F.col("r") > 0, F.element_at("at", F.greatest(F.col("r"), F.lit(1)))["x"]).otherwise(F.col("x")).alias("ux"), F.when(F.col("r") > 0, F.element_at("at", F.greatest(F.col("r"), F.lit(1)))["y"]).otherwise(F.col("y")).alias("uy"),
        "r", "n", "least", F.when(F.col("r") + 1 == F.col("size"), F.col("ends")).otherwise(0).alias("ends"),
    )
    each = stash(each, "trie-each")
    sums = [F.first(c).alias(c) for c in ("before", "ux", "uy")] + [F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("ends").alias("ends")]
    chained = each.filter("lone").select(*node, "before", "ux", "uy", "n", "least", "ends")
    nodes = stash(chained.unionByName(each.filter("NOT lone").groupBy(*node).agg(*sums)), "trie-nodes")

    # words that each conversation shares with a smaller one, and whether it is the smallest at a leaf
    ours = each.filter("NOT lone").join(nodes.select(*node, F.col("least").alias("node_least"), F.col("n").alias("node_n"), F.col("ends").alias("node_ends")), node)
    ours = ours.unionByName(each.filter("lone").withColumns({"node_least": F.col("least"), "node_n": F.col("n"), "node_ends": F.col("ends")}))
    refined = ours.groupBy(*[F.col(f"_{c}").alias(c) for c in key]).agg(F.array_sort(F.collect_list(F.struct("r", "words", "node_least", "node_n", "node_ends"))).alias("turns"))
    shared = F.expr("aggregate(turns, 0L, (s, t) -> s + IF(t.node_least < conv_id, t.words, 0L))")
    end = F.element_at("turns", -1)
    leaf = F.col("last") & (end["node_least"] == F.col("conv_id")) & (end["node_n"] == end["node_ends"])
    per_block = named.select("conv_id", "last", *key).join(stash(refined, "trie-refined"), key).select("conv_id", shared.alias("shared"), leaf.alias("leaf"))
    convs = stash(per_block.groupBy("conv_id").agg(F.sum("shared").alias("shared"), F.bool_or("leaf").alias("leaf")), "trie-shared")

    # the same classes and nodes again, with what their members share
    more = [F.sum("shared").alias("shared"), F.min(F.struct("conv_id", F.col("shared").alias("own"))).alias("smallest"), F.count_if("leaf").alias("leaves")]
    again = named.select("conv_id", *key).join(convs, "conv_id").groupBy(*key).agg(*more)
    again = each.join(again.select(*[F.col(c).alias(f"_{c}") for c in key], "shared", "smallest", "leaves"), [f"_{c}" for c in key])
    chained = again.filter("lone").select(*node, "shared", "smallest", "leaves")
    known = chained.unionByName(again.filter("NOT lone").groupBy(*node).agg(F.sum("shared").alias("shared"), F.min("smallest").alias("smallest"), F.sum("leaves").alias("leaves")))

    # a node's row of each kind, put together by one sum
    root = turns.select("conv_id").distinct().join(convs, "conv_id", "left").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.coalesce(F.sum("shared"), F.lit(0)).alias("shared"), F.count_if("leaf").alias("leaves"))
    root = stash(root.filter("n > 0").select(*[F.lit(0).cast("long").alias(c) for c in node], "n", "least", "shared", F.lit(0).cast("long").alias("own"), F.lit(0).cast("long").alias("before"), "leaves"), "trie-root")
    kinds = {
        "n": "long", "least": "long", "before": "long", "ux": "long", "uy": "long", "shared": "long", "own": "long", "leaves": "long", "child": "long", "sha": "string"
    }
    filled = lambda df: df.select(*node, *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    children = nodes.select((F.col("depth") - 1).alias("depth"), F.col("ux").alias("x"), F.col("uy").alias("y"), F.lit(1).alias("child"))
    rows = filled(nodes)
    for part in (root, known.select(*node, "shared", F.col("smallest.own").alias("own"), "leaves"), children, digests_of_ids(ends)):
        rows = rows.unionByName(filled(part))
    rows = rows.groupBy(*node).agg(*[F.sum(c).alias(c) if c == "child" else F.max(c).alias(c) for c in kinds])
    rows = stash(rows, "trie-rows")
    upper = rows.filter("depth > 0 AND child > 0").select((F.col("depth") + 1).alias("depth"), F.col("x").alias("ux"), F.col("y").alias("uy"), F.col("least").alias("parent"))
    low = rows.join(upper, ["depth", "ux", "uy"], "left")
    top = F.broadcast(root.select(F.col("least").alias("top")))  # one row
    low = low.join(top, F.col("depth") == 1, "left").withColumn("parent", F.coalesce("parent", "top"))
    saved = F.col("shared") - F.col("own") - (F.col("n") - 1) * F.col("before")
    children_of = F.coalesce("child", F.lit(0)).cast("long")
    leaves = F.when(F.col("depth") == 0, F.when(children_of == 0, F.lit(1)).otherwise(F.col("leaves"))).otherwise(F.col("leaves"))
    return low.select(
        F.col("least").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), children_of.alias("n_children"), leaves.cast("long").alias("n_leaves"),
        saved.cast("long").alias("saved_tokens"), F.coalesce("sha", F.lit(NO_IDS)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(regrown(numbered(digested(table(spark, sf_dir, "conversations")))))


# CRC-32 by its table; every prefix of every conversation by an MD5 of its turns, and every node with each of its upper nodes
ORACLE = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS p, d, w FROM (
    SELECT conv_id, turn, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS w
    FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc
), r AS (
  SELECT c.conv_id, 0 AS own, p, d, w FROM c JOIN t ON t.conv_id = base AND p <= h UNION ALL SELECT c.conv_id, 1, p, d, w FROM c JOIN t ON t.conv_id = c.conv_id AND p > h
), s AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, p) AS depth, d, w FROM r
), path AS (
  SELECT conv_id, 0 AS depth, '' AS node, NULL::VARCHAR AS up, 0 AS w FROM c UNION ALL SELECT s.conv_id, s.depth, md5(path.node || s.d), path.node, s.w FROM path JOIN s ON s.conv_id = path.conv_id AND s.depth = path.depth + 1
), n AS (
  SELECT depth, node, any_value(up) AS up, any_value(w) AS w, count(*) AS n, min(conv_id) AS least FROM path GROUP BY depth, node
), kids AS (
  SELECT depth - 1 AS depth, up AS node, count(*) AS kids FROM n WHERE depth > 0 GROUP BY 1, 2
), ends AS (
  SELECT depth, node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM (SELECT conv_id, max(depth) AS depth, arg_max(node, depth) AS node FROM path GROUP BY conv_id) GROUP BY depth, node
), below AS (
  SELECT DISTINCT a.depth, a.node, b.depth AS low, b.node AS under FROM path a JOIN path b ON a.conv_id = b.conv_id AND b.depth >= a.depth
), subtree AS (
  SELECT below.depth, below.node, sum((n - 1) * w)::BIGINT AS saved, count(*) FILTER (kids IS NULL) AS leaves FROM below JOIN n ON n.depth = low AND n.node = under LEFT JOIN kids ON kids.depth = low AND kids.node = under GROUP BY 1, 2
)
SELECT n.least::BIGINT AS conv_id, n.depth::BIGINT AS depth, p.least::BIGINT AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM n JOIN subtree s ON s.depth = n.depth AND s.node = n.node LEFT JOIN kids ON kids.depth = n.depth AND kids.node = n.node LEFT JOIN ends e ON e.depth = n.depth AND e.node = n.node LEFT JOIN n p ON p.depth = n.depth - 1 AND p.node = n.up
"""
