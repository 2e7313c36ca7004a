"""Prefix trie of conversations by whole-sequence collapse.

Equal conversations become one weighted sequence with the list of those that end there. Only one
of each is spread into its prefixes; sequences that are proper prefixes of others are dropped by
an anti-join, which leaves the leaves. Weights of prefixes add up to members of nodes. Sums over
subtrees are read off the paths of the leaves: every node is owned by one leaf below it, so each
node counts once, whatever the depth of the trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import cut, map_arrow, running_totals

#: The first turns of every one of `FAMILY` conversations with neighbouring ids come from the first.
FAMILY, HEAD = 5, 9
#: Sums of 32-bit hashes of all (place, turn) of a prefix: 128 bits that tell prefixes apart.
LANES = ("l1", "l2", "l3", "l4")
KEY = ("depth", *LANES)
PARENT = ("p1", "p2", "p3", "p4")
#: Turns of a sequence that are joined under one key, so that no join has a hot conversation.
BLOCK_TURNS = 4096
#: Ids of a sequence's end list that travel as one text.
CHUNK_IDS = 4096


def ordered_turns(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id, place (from 1), role, text of every turn; see `prefix_trie` for nulls and ties."""
    turns = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.lit(1).cast("long").alias("one"),
    )
    # bounds of ranges are kept short; rows that agree in them are sorted by all of their texts
    cuts = ["turn", F.substring("role", 1, 32), F.substring("text", 1, 32)]
    placed = running_totals(turns, "conv_id", ["turn", "role", "text"], {"place": "one"}, cuts)
    return placed.select("conv_id", "place", "role", "text")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, part (0: lent, 1: own), place, role, text of every rebuilt conversation's turns.

    The first h turns are those of the family's first conversation, h = crc32(decimal id) % 9; its
    own first h turns go.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % HEAD
    own = turns.where(F.col("place") > h).select("conv_id", F.lit(1).alias("part"), "place", "role", "text")
    heads = turns.where(F.col("place") < HEAD).withColumnRenamed("conv_id", "lender")
    ids = turns.where("place = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("lender"), h.alias("h"))
    lent = heads.join(ids, "lender").where("place <= h").select("conv_id", F.lit(0).alias("part"), "place", "role", "text")
    return own.unionByName(lent)


def _hashes(place: Column, said: Column) -> list[Column]:
    """Four 32-bit numbers of a turn at its place."""
    halves = []
    for salt in (1, 2):
        h = F.xxhash64(F.lit(salt), place, said)
        halves += [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))]
    return halves


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, lanes of the prefix that ends there, lanes of the one before, bytes of the last text.

    turns: conv_id, the columns `part` and `place` to order by, role and text.
    """
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = turns.select("conv_id", "part", "place", F.unhex(said).alias("said"), F.octet_length("text").cast("long").alias("bytes"), F.lit(1).cast("long").alias("one"))
    placed = running_totals(rows, "conv_id", ["part", "place"], {"depth": "one"})
    hashed = placed.select("conv_id", "depth", "bytes", *[x.alias(f"h{i}") for i, x in enumerate(_hashes(F.col("depth"), F.col("said")))])
    summed = running_totals(hashed, "conv_id", ["depth"], {lane: f"h{i}" for i, lane in enumerate(LANES)}, cuts=())
    before = [(F.col(lane) - F.col(f"h{i}")).alias(p) for i, (lane, p) in enumerate(zip(LANES, PARENT))]
    return summed.select("conv_id", *KEY, *before, "bytes")


def sequences(paths: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences (key, weight, first_id) and the ends (key, conv_id) that they stand for.

    ids: every conv_id, also of conversations without turns. Sums of lanes only grow along a
    conversation, so its largest ones are those of the whole.
    """
    zeros = [F.lit(0).cast("long").alias(c) for c in KEY]
    every = paths.select("conv_id", *KEY).unionByName(ids.select("conv_id", *zeros))
    ends = cut(every.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in KEY]))
    found = ends.groupBy(*KEY).agg(F.count("*").alias("weight"), F.min("conv_id").alias("first_id"))
    return cut(found), ends


def _spread(paths: DataFrame, chosen: DataFrame, *columns: str) -> DataFrame:
    """Rows of the chosen sequences' prefixes (first_id, depth, columns of chosen), the root included."""
    block = F.floor(F.col("depth") / BLOCK_TURNS)
    blocks = chosen.select(
        "first_id", F.col("depth").alias("turns"), *columns, F.explode(F.sequence(F.lit(0).cast("long"), block)).alias("block")
    )
    rows = paths.withColumnRenamed("conv_id", "first_id").withColumn("block", block)
    zeros = [F.lit(0).cast("long").alias(c) for c in (*KEY, *PARENT, "bytes")]
    roots = chosen.select("first_id", F.col("depth").alias("turns"), *columns, *zeros)
    return rows.join(blocks, ["first_id", "block"]).drop("block").unionByName(roots)


def end_digests(ends: DataFrame) -> DataFrame:
    """Key and SHA-256 of the ids that end there, decimal, ascending, joined by commas.

    Ids are sorted and joined to texts of bounded size over ranges of (key, id); of each list only
    these texts pass through one task, one after the other, as its hash demands.
    """
    keys = list(KEY)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            rows = list(zip(*columns[:-1]))
            ids = columns[-1]
            at = [i for i in range(len(ids)) if i == 0 or rows[i] != rows[i - 1]]
            at = [j for i, stop in zip(at, [*at[1:], len(ids)]) for j in range(i, stop, CHUNK_IDS)]
            texts = [",".join(map(str, ids[i:stop])) for i, stop in zip(at, [*at[1:], len(ids)])]
            found = [pa.array([rows[i][k] for i in at], pa.int64()) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*found, pa.array([ids[i] for i in at], pa.int64()), pa.array(texts, pa.string())], [*keys, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None

        def out(done: list) -> pa.RecordBatch:
            columns = [pa.array([d[0][k] for d in done], pa.int64()) for k in range(len(keys))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([d[1].hexdigest() for d in done], pa.string())], [*keys, "ends_sha256"])

        for batch in batches:
            done = []
            columns = [c.to_pylist() for c in batch.columns]
            for row, text in zip(zip(*columns[: len(keys)]), columns[-1]):
                if row == last:
                    state.update(b",")
                else:
                    if last is not None:
                        done.append((last, state))
                    last, state = row, hashlib.sha256()
                state.update(text.encode())
            yield out(done)
        if last is not None:
            yield out([(last, state)])

    kinds = ", ".join(f"{k} long" for k in keys)
    dealt = ends.select(*keys, "conv_id").repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id")
    texts = map_arrow(dealt, join, f"{kinds}, first long, ids string")
    return map_arrow(texts.repartition(*keys).sortWithinPartitions(*keys, "first"), digest, f"{kinds}, ends_sha256 string")


def trie_of(paths: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie of conversations and the ends of its sequences.

    paths as `prefixes` returns them, ids: every conv_id. Nodes: key, parent's lanes, conv_id,
    parent_conv_id, n_convs, n_ends, n_children, n_leaves, saved_tokens.
    """
    found, ends = sequences(paths, ids)
    by_key = ["depth", *LANES]
    nodes = cut(
        _spread(paths, found, "weight")
        .groupBy(*by_key)
        .agg(
            F.sum("weight").alias("n_convs"),
            F.sum(F.when(F.col("depth") == F.col("turns"), F.col("weight")).otherwise(0)).alias("n_ends"),
            F.min("first_id").alias("conv_id"),
            F.max("bytes").alias("bytes"),
            *[F.max(p).alias(p) for p in PARENT],
        )
    )
    continued = nodes.where("n_convs > n_ends").select(*by_key)
    leaves = cut(found.join(continued, by_key, "left_anti").select(*by_key, "first_id"))
    through = cut(_spread(paths, leaves).select(*by_key, "first_id"))
    below = through.groupBy(*by_key).agg(F.count("*").alias("n_leaves"), F.min("first_id").alias("owner"))
    owned = nodes.join(below, by_key).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes"))
    owned = cut(running_totals(owned, "owner", ["depth"], {"saved_upto": "saved"}))
    # what a leaf owns in all; it owns the nodes from some depth to its end
    totals = owned.groupBy("owner").agg(F.sum("saved").alias("total"), F.max("depth").alias("depth"))
    totals = cut(totals.select(F.col("owner").alias("first_id"), "depth", "total").where("total > 0"))
    sums = _spread(paths, totals, "total").groupBy(*by_key).agg(F.sum("total").alias("total"))
    summed = cut(
        owned.join(sums, by_key, "left").withColumn("saved_tokens", F.coalesce("total", F.lit(0)) - F.col("saved_upto") + F.col("saved"))
    )
    parents = [F.col(p).alias(lane) for p, lane in zip(PARENT, LANES)]
    children = summed.where("depth > 0").select((F.col("depth") - 1).alias("depth"), *parents).groupBy(*by_key).agg(F.count("*").alias("n_children"))
    counted = cut(summed.join(children, by_key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    # the last join reads plain shuffled rows, so that a node with very many children can be split
    named = counted.select((F.col("depth") + 1).alias("depth"), *[F.col(lane).alias(p) for lane, p in zip(LANES, PARENT)], F.col("conv_id").alias("parent_conv_id"))
    nodes = counted.join(named, ["depth", *PARENT], "left").select(
        *by_key, *PARENT, "conv_id", "parent_conv_id", "n_convs", "n_ends", "n_children", "n_leaves", "saved_tokens"
    )
    return nodes, ends


def prefix_trie(conversations: DataFrame, rebuild: bool = True, id_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Nodes of the prefix trie of all conversations, and the ends of its sequences.

    conversations: conv_id (any whole number), turn, role, text; other columns are ignored whatever
    their names. Turns are ordered by turn, then role, then text, so ties and repeated rows have
    one order; null turns come first, null roles and texts count as empty, rows with a null id take
    no part. Texts are compared whole. With `rebuild` each conversation borrows its first turns,
    see `rebuilt`; one that is left without turns is a member of the root. An empty table gives no
    rows. `texts_of` has the last turn of each node.
    """
    turns = cut(ordered_turns(conversations, id_col))
    ids = turns.where("place = 1").select("conv_id")
    rows = rebuilt(turns) if rebuild else turns.withColumn("part", F.lit(1))
    return trie_of(cut(prefixes(rows)), ids)


def texts_of(nodes: DataFrame, conversations: DataFrame, rebuild: bool = True, id_col: str = "conv_id") -> DataFrame:
    """nodes with the role and text of their last turn; the root has neither."""
    turns = ordered_turns(conversations, id_col)
    rows = (rebuilt(turns) if rebuild else turns.withColumn("part", F.lit(1))).withColumn("one", F.lit(1).cast("long"))
    placed = running_totals(rows, "conv_id", ["part", "place"], {"depth": "one"})
    return nodes.join(placed.select("conv_id", "depth", "role", "text"), ["conv_id", "depth"], "left")


def trie_digest(conversations: DataFrame) -> DataFrame:
    """The nodes of the rebuilt conversations' trie with a hash of the ids that end at each."""
    nodes, ends = prefix_trie(conversations)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(end_digests(ends), list(KEY), "left").select(*columns, F.coalesce("ends_sha256", none).alias("ends_sha256"))
