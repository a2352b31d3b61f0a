"""Operator 4: near-duplicates by b-bit MinHash, with exact confirmation and connected components.

1. Every text gives its distinct word shingles (64-bit hashes), ``HASHES`` minima, a key for each band of
   ``ROWS`` minima, and the low ``BITS`` bits of all minima packed into eight longs.
2. Texts with equal sets are one class; one representative of a class goes on, so copies cost nothing more.
3. Representatives that share a band key are candidates. Each bucket links its members to its smallest one
   (as many rows as members, never pairs); connected components of these links are candidate clusters.
4. A cluster is cut into blocks of bounded size, and each block, then each pair of blocks, is one task's group:
   similarities estimated from matching bits, corrected for chance matches, drop clear misses; the rest is
   confirmed on the full sets. A block returns only links that join something, a pair of blocks only links that
   join parts which their blocks have left apart: a group of m near copies returns about m rows, not m for each block.
5. Connected components of the links; every document gets the smallest id of its component. Sets shared by
   over a thousandth of the documents are joined back by broadcast, the others by a shuffle.

A pair at the threshold is in no common bucket with probability (1 - 0.75^4)^32, about 5e-6; the estimate
drops it with less than 1e-7. Buckets, clusters and partners have no cap. A cluster of m different texts that
do not link ships m^2 / ``BLOCK`` sets and compares m^2 / 2 pairs, spread over its pairs of blocks.

Null and empty texts have no shingles and link to nothing. Fewer words than ``width`` are one shingle.
Repeated rows are copies. A null id is no component id: a component takes its smallest known id, and without
one it stays null. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _ship, fresh, join_hot, map_arrow, numbered, small_side, staged, text_chunks, texts_of, unstage, without
from .shingles import digest, forget_words, minima, shingle_sets

HASHES, ROWS, BANDS, BITS = 128, 4, 32, 4
WORDS_PACKED = HASHES * BITS // 64
#: Texts, and shingles, of a block.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Rows of candidate keys that may be broadcast, about 150 bytes each.
BROADCAST_ROWS = 200_000
_LOW = np.uint64(int("1" * 16, 16))


def pack_bits(m: np.ndarray) -> np.ndarray:
    """Low bits of the minima, 16 of them to a 64-bit word."""
    low = (m & np.uint64((1 << BITS) - 1)).reshape(len(m), WORDS_PACKED, 64 // BITS)
    shift = np.arange(0, 64, BITS, dtype=np.uint64)
    return np.bitwise_or.reduce(low << shift, axis=2) if len(m) else np.empty((0, WORDS_PACKED), np.uint64)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal b-bit values, corrected for the 2^-b that match by chance."""
    x = one ^ many
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    equal = 1 - np.bitwise_count(x & _LOW).sum(1) / HASHES
    chance = 2.0 ** -BITS
    return (equal - chance) / (1 - chance)


def cut_off(percent: int) -> float:
    """Estimates below this are 5.5 standard deviations under the threshold."""
    chance = 2.0 ** -BITS
    p = chance + (1 - chance) * percent / 100
    return percent / 100 - 5.5 * math.sqrt(p * (1 - p) / HASHES) / (1 - chance)


def band_keys(m: np.ndarray) -> np.ndarray:
    out = np.empty((len(m), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            h = np.full(len(m), b + 1, np.uint64)
            for r in range(ROWS):
                h = (h ^ m[:, b * ROWS + r]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
            out[:, b] = h
    return out


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """Staged: ``row, id, h`` (hash of the text), ``n`` (shingles), ``digest`` of the set, ``bands``, ``bits``."""
    kind = docs.schema["id"].dataType.simpleString()

    def sign(batches):
        for b in text_chunks(batches, "text"):
            sets = shingle_sets(texts_of(b, "text"), width)
            full = [i for i, s in enumerate(sets) if len(s)]
            m = minima([sets[i] for i in full], HASHES)
            bands, bits = [None] * len(sets), [None] * len(sets)
            for i, x, y in zip(full, band_keys(m).view(np.int64), pack_bits(m).view(np.int64)):
                bands[i], bits[i] = x, y
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("h"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())),
                 pa.array(np.zeros(len(sets), np.int32))], ["id", "h", "n", "digest", "bands", "bits", "all"])
        forget_words()  # workers live on; what a task has learned does not

    rows = numbered(docs, "all", "signatures", sign,
                    f"id {kind}, h long, n long, digest binary, bands array<long>, bits array<long>, all int")
    out = rows.withColumn("row", F.shiftleft(F.col("part").cast("long"), 40) + F.col("local")).drop("all", "part", "local")
    return out


def _ends(up: DataFrame) -> DataFrame:
    """``node, label`` (smaller than the node, or itself), each label followed to its end; four steps a round."""
    further = lambda t: t.select(F.col("node").alias("label"), F.col("label").alias("far"))
    while True:
        two = up.join(further(up), "label").select("node", F.col("far").alias("label"))
        new = staged(two.join(further(two), "label").select("node", F.col("label").alias("old"), F.col("far").alias("label")),
                     "labels")
        changed = new.filter("label <> old").limit(1).count()
        unstage(up)
        up = new.select("node", "label")
        up._staged_path = new._staged_path
        if not changed:
            return up


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` (smallest node reachable) of the nodes of ``edges`` (a, b).

    Each round takes a node to its least neighbour, and on to where that leads; the next round has only the
    distinct edges between those ends, of which two rounds leave at most half. So the edges of a group are joined
    once or twice, not in each round.
    """
    undirected = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    left, state = staged(undirected(edges), "edges"), None
    while True:
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = _ends(staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
            "node", F.least("node", "m").alias("label")), "labels"))
        at = lambda c: ends.select(F.col("node").alias(c), F.col("label").alias(f"{c}_end"))
        rest = left.join(at("a"), "a").join(at("b"), "b").filter("a_end <> b_end")
        rest = staged(undirected(rest.select(F.col("a_end").alias("a"), F.col("b_end").alias("b"))), "edges")
        unstage(left)
        if state is None:
            state = ends
        else:
            new = staged(state.join(at("label"), "label", "left").select("node", F.coalesce("label_end", "label").alias("label")),
                         "labels")
            unstage(state)
            unstage(ends)
            state = new
        left = rest
        if not left.limit(1).count():
            unstage(left)
            return state


def _link_block(percent: int, width: int):
    """Confirmed links within one block, or between two blocks, that join parts not joined before: rows (a, b)."""
    least = cut_off(percent)

    def link(group: pd.DataFrame) -> pd.DataFrame:
        g = group.drop_duplicates("row").sort_values("row")
        row, block = g["row"].to_numpy(), g["block"].to_numpy()
        apart = g["lo"].iloc[0] != g["hi"].iloc[0]
        n = g["n"].to_numpy()
        bits = np.stack(g["bits"].to_numpy()).astype(np.int64).view(np.uint64)
        ids = np.unique(np.concatenate(list(g["shingles"])), return_inverse=True)[1]
        end = np.cumsum(n)
        inside = np.zeros(int(ids.max()) + 1, bool)
        parent = np.unique(g["part"], return_inverse=True)[1]
        out = []
        for i in range(len(g) - 1):
            later = np.arange(i + 1, len(g))
            ok = (100 * np.minimum(n[i], n[later]) >= percent * np.maximum(n[i], n[later])) & (parent[later] != parent[i])
            if apart:
                ok &= block[later] != block[i]
            later = later[ok]
            later = later[estimate(bits[i], bits[later]) >= least]
            if not len(later):
                continue
            own = ids[end[i] - n[i]:end[i]]
            inside[own] = True
            at = np.concatenate([ids[end[j] - n[j]:end[j]] for j in later])
            common = np.add.reduceat(inside[at].astype(np.int64), np.cumsum(n[later]) - n[later])
            inside[own] = False
            for j in later[100 * common >= percent * (n[i] + n[later] - common)]:
                if parent[j] != parent[i]:
                    parent[parent == parent[j]] = parent[i]
                    out.append((row[i], row[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return link


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept, text_hash``: a row per document.

    Linked: 100 x common >= percent x union. Kept: the id is its component's.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    base = base.withColumn("h", F.xxhash64("text"))
    state = signatures(base, width)
    classes = staged(state.filter("n > 0").groupBy("digest").agg(F.min("row").alias("cls"), F.min("id").alias("first"),
                                                                 F.count(F.lit(1)).alias("copies")), "classes")
    reps = state.join(classes.select(F.col("cls").alias("row")), "row", "left_semi")

    # Candidate clusters: buckets' members linked to the smallest of them.
    places = reps.select("row", F.explode("bands").alias("key"))
    buckets = places.groupBy("key").agg(F.min("row").alias("pivot"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    stars = places.join(buckets, "key").filter("row <> pivot").select(F.col("pivot").alias("a"), F.col("row").alias("b")).distinct()
    clusters = components(stars)

    # The members' full sets, from their texts; blocks of bounded size, linked within; then pairs of blocks.
    members = reps.join(clusters.withColumnRenamed("node", "row"), "row").select("row", "id", "h", "n", "bits", "label")
    sizes = members.groupBy("label").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    members = staged(members.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks"))), "members")
    kept = ["row", "n", "bits", "label", "blocks", "block", "part"]

    def cut(batches):
        for b in text_chunks(batches, "text"):
            sets = [s.view(np.int64) for s in shingle_sets(texts_of(b, "text"), width)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(sets, pa.list_(pa.int64()))], [*kept, "shingles"])
        forget_words()

    def link(some: DataFrame, other) -> DataFrame:
        """Links of ``some`` members: their block with the block, or each of the blocks, ``other``."""
        known = small_side(some.select(F.col("id").alias("m_id"), F.col("h").alias("m_h"), *kept), BROADCAST_ROWS)
        texts = base.join(known, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("h") == F.col("m_h"))).select("text", *kept)
        sets = map_arrow(texts, cut, "row long, n long, bits array<long>, label long, blocks long, block long, part long, "
                                     "shingles array<long>")
        pairs = sets.withColumn("other", other).select("label", F.least("block", "other").alias("lo"), F.greatest(
            "block", "other").alias("hi"), "block", "part", "row", "n", "bits", "shingles")
        _ship(docs.sparkSession)
        return staged(pairs.groupBy("label", "lo", "hi").applyInPandas(_link_block(percent, width), "a long, b long"), "links")

    found = components(link(members.withColumn("part", F.col("row")), F.col("block")))
    several = members.filter("blocks > 1")
    if several.limit(1).count():  # what a block has joined is one part: pairs of blocks return fewer links than parts
        several = several.join(found.select(F.col("node").alias("row"), F.col("label").alias("part")), "row", "left")
        blocks = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        across = link(several.withColumn("part", F.coalesce("part", "row")), F.explode(F.filter(blocks, lambda x: x != F.col("block"))))
        found = components(across.union(found.select("node", "label")))

    # The components' smallest id, and back to the documents of each class.
    named = classes.join(found, F.col("cls") == F.col("node"), "left").withColumn("label", F.coalesce("label", "cls"))
    least = named.groupBy("label").agg(F.min("first").alias("component"))
    by_set = staged(named.select(F.col("digest").alias("d"), "label", "copies").join(least, "label").select(
        "d", "component", "copies"), "by_set")
    out = join_hot(state.select("id", "h", "n", "digest"), by_set, [("digest", "d")], "copies", state.count())
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"), F.col("h").alias("text_hash"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, and one of rows that repeat both id and text."""
    found = staged(near_duplicates(docs, width, percent, id_col, text_col), "components")
    left = without(docs, found.filter(~F.col("kept")), id_col, text_col)
    again = found.filter("kept").groupBy(id_col, "text_hash").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    if not again.limit(1).count():
        return left
    again = staged(again, "repeated")
    keys = again.select(F.col(id_col).alias("again_id"), F.col("text_hash").alias("again_hash"))
    rows = left.join(keys, left[id_col].eqNullSafe(keys["again_id"]) & (
        F.xxhash64(left[text_col].cast("string")) == keys["again_hash"]), "left_semi")
    tag = fresh(left, "text_hash")
    one = rows.withColumn(tag, F.xxhash64(F.col(text_col).cast("string"))).dropDuplicates([id_col, tag]).drop(tag)
    return without(left, again, id_col, text_col).unionByName(one)
