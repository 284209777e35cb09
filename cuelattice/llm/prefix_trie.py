"""The trie of conversations that share their first turns, by intervals of preorder.

Every prefix of a conversation is a node, named by a sum of hashes of its turns, which running sums give for all depths at
once. Nodes that two or more conversations share, and the first node of each that has one, are ranked lexicographically by
doubling: blocks of 2^k turns have ranks, and a pair of ranks is ranked again. The last ranks are places in preorder, so the
nodes below one are an interval; its end is the largest place at which a conversation of that node leaves the ranked part.
Leaves and savings below a node are differences of prefix sums over the places. What follows the first node of a single
conversation is a chain without branches, for which nothing has to be looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scans import in_order, numbered, ranked, running_sums
from .common import WORD_SPACE, cut, release
from .ordered import joined

EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def rebuilt(conversations: DataFrame, block: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(members, turns): conversations (conv_id) and their turns (conv_id, depth, role, text), some of which begin as another one.

    Conversation c takes its first h turns from conversation c - c % block, where h = crc32(c) % most, and then has its own
    after its first h. Turns are in order of turn (null first); of equal ones, of role and of the text's SHA-256. Null roles and texts are empty.
    Rows without a conv_id belong to none.
    """
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("deal", F.monotonically_increasing_id())
    rows = cut(numbered(rows, ["conv_id"], ["turn", "role", "digest", "deal"], "nth").select("conv_id", "nth", "role", "text"))
    c = F.col("conv_id")
    members = rows.groupBy("conv_id").agg(F.max("nth").alias("n_turns"))
    members = cut(members.select("conv_id", "n_turns", (F.crc32(c.cast("string").cast("binary")) % most).alias("h"), (c - c % block).alias("source")))
    lengths = members.filter(c == F.col("source")).select("source", F.col("n_turns").alias("source_turns"))
    members = cut(members.join(lengths, "source", "left").withColumn("taken", F.least("h", F.coalesce("source_turns", F.lit(0)))).select("conv_id", "h", "source", "taken"))
    heads = rows.filter((c % block == 0) & (F.col("nth") < most)).select(c.alias("source"), F.col("nth").alias("depth"), "role", "text")
    first = members.filter("taken > 0").join(heads, "source").filter("depth <= taken").select("conv_id", "depth", "role", "text")
    own = rows.join(members, "conv_id").filter("nth > h").select("conv_id", (F.col("nth") - F.col("h") + F.col("taken")).alias("depth"), "role", "text")
    return members.select("conv_id"), first.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, words, x, y, a, b, pa, pb): words of each turn, two hashes (x, y) of its place, role and text, their sums up to it (a, b) and ahead of it.

    The sums name the prefix: two conversations have the same first d turns if they have the same sums at depth d.
    """
    digest = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    words = F.size(F.filter(F.split("text", WORD_SPACE), lambda w: w != "")).cast("long")
    rows = turns.select("conv_id", "depth", words.alias("words"), digest.alias("digest"))
    rows = rows.select("conv_id", "depth", "words", *[F.xxhash64(F.lit(seed), "depth", "digest").alias(n) for seed, n in ((1, "x"), (2, "y"))])
    return cut(running_sums(rows, ["conv_id"], ["depth"], {"a": "x", "b": "y"}, {"pa": "x", "pb": "y"}))


def preorder(nodes: DataFrame) -> DataFrame:
    """Add `place` (1, 2, ...) to nodes (a, b, depth, pa, pb, x, y): ranks of their paths; a path comes ahead of those that go on from it.

    nodes has the parent of each node but of those at depth 1. In round k every node knows the rank of the turns of its own
    block of 2^k, up to itself, and the node ahead of that block (pa, pb). A block that is the second of a pair takes over
    the first one's. The number of rounds is the logarithm of the greatest depth.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    now, k = cut(ranked(nodes, ["x", "y"], ["a", "b"]).drop("x", "y")), 0
    while 1 << k < deepest:
        second = F.shiftright(F.col("depth") - 1, k) % 2 == 1
        ahead = now.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("rank").alias("p_rank"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
        paired = now.filter(second).join(ahead, ["pa", "pb"]).select("a", "b", "depth", F.col("qa").alias("pa"), F.col("qb").alias("pb"), F.col("p_rank").alias("k1"), F.col("rank").alias("k2"))
        alone = now.filter(~second).select("a", "b", "depth", "pa", "pb", F.col("rank").alias("k1"), F.lit(0).cast("long").alias("k2"))
        now, k = cut(ranked(paired.unionByName(alone), ["k1", "k2"], ["a", "b"]).drop("k1", "k2")), k + 1
        release(nodes.sparkSession)
    return now.select("a", "b", F.col("rank").alias("place"))


def prefix_trie(members: DataFrame, turns: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one per node; no members: no rows.

    members has all conversations (conv_id, distinct), turns theirs (conv_id, depth from 1 without gaps, role, text; no
    nulls). A conversation without turns ends at the root. Words of long texts are counted whole; a text is only ever in the
    row of its turn. Other columns aren't read.
    """
    steps = prefixes(turns)
    nodes = steps.groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.first(c).alias(c) for c in ("depth", "words", "x", "y", "pa", "pb")])
    nodes = cut(nodes)
    children = nodes.groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("n_children")).withColumnsRenamed({"pa": "a", "pb": "b"})
    above = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_convs"))
    whole = cut(nodes.filter("depth > 1").join(above, ["pa", "pb"]))
    count, least = members.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    kind = members.schema["conv_id"].dataType
    top = nodes.filter("depth = 1").withColumn("parent_conv_id", F.lit(least).cast(kind)).withColumn("parent_convs", F.lit(None).cast("long"))
    whole = whole.unionByName(top.select(*whole.columns))
    chained = (F.col("n_convs") == 1) & F.coalesce(F.col("parent_convs") == 1, F.lit(False))
    return _assembled(members, steps, whole, children, chained, count, least)


def _assembled(members: DataFrame, steps: DataFrame, whole: DataFrame, children: DataFrame, chained: Column, count: int, least) -> DataFrame:
    own = cut(whole.filter(~chained).join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    places = cut(preorder(own.select("a", "b", "depth", "pa", "pb", "x", "y")))
    # Where the conversations of a node leave the ranked part; the largest place among them ends the node's interval.
    at = cut(steps.select("conv_id", "a", "b").join(places, ["a", "b"]))
    left = at.groupBy("conv_id").agg(F.max("place").alias("last"))
    ends = at.join(left, "conv_id").groupBy("a", "b").agg(F.max("last").alias("end"))
    # A single conversation's first node stands for the chain that follows it, so it counts as a leaf.
    leaf = ((F.col("n_children") == 0) | (F.col("n_convs") == 1)).cast("long")
    own = own.join(places, ["a", "b"]).join(ends, ["a", "b"]).withColumn("leaf", leaf).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    sums = cut(running_sums(own, [], ["place"], {"leaves": "leaf", "savings": "saved"}))
    until = sums.select(F.col("place").alias("end"), F.col("leaves").alias("leaves_until"), F.col("savings").alias("savings_until"))
    below = [(F.col(f"{c}_until") - F.col(c) + F.col(one)).alias(n) for c, one, n in (("leaves", "leaf", "n_leaves"), ("savings", "saved", "saved_tokens"))]
    shown = ["a", "b", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children"]
    ranked_nodes = sums.join(until, "end").select(*shown, *below)
    chains = whole.filter(chained).join(children, ["a", "b"], "left").select(*shown[:-1], F.coalesce("n_children", F.lit(0)).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    total = sums.agg(F.sum("leaf").alias("n"), F.sum("saved").alias("s"), F.count_if(F.col("depth") == 1).alias("c"))
    zero = F.lit(0).cast("long")
    root = total.select(
        zero.alias("a"), zero.alias("b"), F.lit(least).cast(members.schema["conv_id"].dataType).alias("conv_id"), zero.alias("depth"), F.lit(None).cast(members.schema["conv_id"].dataType).alias("parent_conv_id"),
        F.lit(count).cast("long").alias("n_convs"), F.col("c").alias("n_children"), F.coalesce("n", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("s", zero).alias("saved_tokens"),
    ).filter(F.lit(count) > 0)
    last = steps.groupBy("conv_id").agg(F.max_by(F.struct("a", "b"), "depth").alias("at"))
    stops = members.join(last, "conv_id", "left").select(*[F.coalesce(f"at.{c}", zero).alias(c) for c in "ab"], "conv_id", F.col("conv_id").cast("string").alias("shown"))
    digests = joined(in_order(stops, ["a", "b", "conv_id"]), ["a", "b"], "shown", ",", "ends_sha256")
    found = ranked_nodes.unionByName(chains).unionByName(root).join(digests, ["a", "b"], "left")
    return found.select(*shown[2:], "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
