"""Sharding by balanced label propagation.

Documents start in shards of equal row counts (a pseudo-random order cut into
equal runs).  Then, round by round, every linked document looks at the shards of
its neighbours (a join of links and shards) and wants to move to the one that
holds more of them than its own.  Moves from shard i to shard j are paired with
moves from j to i, so that counts never change: first documents that want the
opposite way, then documents of j that have no links and so lose nothing.  The
quotas are a table of shards x shards; within a quota the larger gains go first.
Rounds end when nobody wants to move.  Links may be any undirected pairs; the query
links documents of equal text, each to the smallest id of its group.

Law ``rows``: counts are at most one apart from the first round to the last.

Spark does the work: joins for neighbours' shards, partial counts per document
and shard, distributed ranks (``common.running_total``) against quotas.  Only the
quota table (shards squared, whatever the data) reaches the driver.  A group that
holds a third of all documents is larger than a shard; it fills the quotas that
there are and the rest stays where it is.

Defined cases: a NULL text has no bytes and counts as equal to an empty one;
repeated rows (same id) are separate documents, told apart by a row number of
their own; no rows give no shards; fewer documents than shards leave shards empty;
extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, order_hash, running_total

# --- fixed values ---
SHARDS = 24
MAX_ROUNDS = 6
# --------------------


def nodes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow node table: doc_id, size, text_crc32, text key, ``node`` (unique) and
    its pseudo-random order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("key"))
    # repeated ids: number them, so that each row is a node of its own
    dup = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("size"))
    out = narrow.withColumn("node", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                                                F.substring("key", 1, 16), dup))
    return out.withColumn("h", order_hash(F.col("node"), salt="shard:"))


def equal_text_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b): every document to the first of its group of equal texts."""
    first = nodes.groupBy("key").agg(F.min(F.struct("doc_id", "node")).alias("f"), F.count(F.lit(1)).alias("n"))
    first = first.filter("n > 1").select("key", F.col("f.node").alias("hub"))
    return nodes.join(first, "key").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))


def initial_shards(nodes: DataFrame, shards: int, rows: int) -> DataFrame:
    """``nodes`` plus ``shard``: place in the pseudo-random order, cut into equal runs."""
    placed = running_total(nodes, [], "h", ["node"], None, "place", rows=rows)
    return placed.withColumn("shard", F.floor(F.col("place") * shards / F.lit(max(rows, 1))).cast("int")).drop("place")


def wishes(state: DataFrame, links: DataFrame) -> DataFrame:
    """For each node (node, h, shard): ``want`` (NULL: stay), ``gain``, ``linked``."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = (both.join(state.select(F.col("node").alias("b"), F.col("shard").alias("s")), "b")
            .groupBy("a", "s").agg(F.count(F.lit(1)).alias("c")))
    best = near.groupBy("a").agg(
        F.max(F.struct("c", (-F.col("s")).alias("m"))).alias("top"),
        F.map_from_entries(F.collect_list(F.struct("s", "c"))).alias("by"))   # an entry per shard at most
    out = state.join(best.withColumnRenamed("a", "node"), "node", "left")
    here = F.coalesce(F.element_at("by", F.col("shard")), F.lit(0))
    gain = F.col("top.c") - here
    return (out.withColumn("linked", F.col("top").isNotNull())
            .withColumn("want", F.when(gain > 0, -F.col("top.m")).cast("int"))
            .withColumn("gain", F.when(gain > 0, gain)).drop("top", "by"))


def quotas(demand: dict[tuple[int, int], int], free: dict[int, int], shards: int):
    """How many wishes (i, j) come true, and how many free documents go from j to i
    in return; both tables have shards x shards entries at most."""
    granted: dict[tuple[int, int], int] = {}
    back: dict[tuple[int, int], int] = {}
    left = dict(free)
    for i in range(shards):
        for j in range(shards):
            d, e = demand.get((i, j), 0), demand.get((j, i), 0)
            if d:
                granted[i, j] = min(d, e)
    for (i, j), d in sorted(demand.items(), key=lambda x: (-x[1], x[0])):
        more = min(d - granted[i, j], left.get(j, 0))
        if more > 0:
            granted[i, j] += more
            back[j, i] = back.get((j, i), 0) + more
            left[j] -= more
    return granted, back


def propagate(nodes: DataFrame, links: DataFrame, shards: int = SHARDS, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``nodes`` (``node``, ``h`` and any others) plus the final ``shard``."""
    spark = nodes.sparkSession
    rows = nodes.count()
    state = materialize(initial_shards(nodes.select("node", "h"), shards, rows), "shard-state")
    for turn in range(max_rounds):
        # Two linked documents that both move would only change places: moves go to
        # higher shards, then to lower ones, then both ways by a coin per document.
        wished = wishes(state, links)
        coin = F.conv(F.substring(order_hash(F.col("node"), salt=f"coin{turn}:"), 1, 2), 16, 10).cast("int") % 2 == 0
        allowed = (F.col("want") > F.col("shard"), F.col("want") < F.col("shard"), coin)[turn % 3]
        wished = materialize(wished.withColumn("wish", F.col("want").isNotNull())
                             .withColumn("want", F.when(allowed, F.col("want"))), "shard-wishes")
        # bounded: a row for each pair of shards and each shard
        counts = wished.groupBy("shard", "want", "wish", "linked").agg(F.count(F.lit(1)).alias("c")).collect()
        if not any(r["wish"] for r in counts):
            break
        demand = {(r["shard"], r["want"]): r["c"] for r in counts if r["want"] is not None}
        free = {r["shard"]: r["c"] for r in counts if not r["linked"]}
        granted, back = quotas(demand, free, shards)
        if not sum(granted.values()):
            continue
        # wishes: rank in (from, to), larger gains first by their share of the order
        asked = wished.filter("want IS NOT NULL").withColumn(
            "rank_h", order_hash(F.col("node"), salt=f"turn{turn}:"))
        asked = running_total(asked, ["shard", "want"], "rank_h", ["node"], None, "place",
                              rows=sum(demand.values()))
        grant = spark.createDataFrame([(i, j, n) for (i, j), n in granted.items()] or [(-1, -1, 0)],
                                      "shard int, want int, quota bigint")
        moved = (asked.join(F.broadcast(grant), ["shard", "want"]).filter("place < quota")
                 .select("node", F.col("want").alias("to")))
        # free documents in return: consecutive runs of each shard's order
        runs, at = [], {}
        for (j, i), n in sorted(back.items()):
            runs.append((j, i, at.get(j, 0), at.get(j, 0) + n))
            at[j] = at.get(j, 0) + n
        if runs:
            run = spark.createDataFrame(runs, "shard int, to int, lo bigint, hi bigint")
            loose = running_total(wished.filter("NOT linked"), ["shard"], "h", ["node"], None, "place",
                                  rows=sum(free.values()))
            back_moves = (loose.join(F.broadcast(run), "shard").filter("place >= lo AND place < hi")
                          .select("node", "to"))
            moved = moved.unionByName(back_moves)
        state = materialize(state.join(moved, "node", "left")
                            .withColumn("shard", F.coalesce("to", "shard")).drop("to"), "shard-state")
    return nodes.join(state.select("node", "shard"), "node")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per document: size, crc32 of the text, law, shard, slot (0, 1, ... within the
    shard, copies side by side) and grown_shard (NULL under this law)."""
    nodes = materialize(nodes_of(docs), "shard-nodes")
    links = materialize(equal_text_links(nodes), "shard-links")
    out = materialize(propagate(nodes, links, shards), "shard-final")
    # slots follow the text key, so equal texts are neighbours within the shard
    out = running_total(out.withColumn("slot_h", F.md5(F.col("key").cast("binary"))), ["shard"], "slot_h", ["node"], None, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
