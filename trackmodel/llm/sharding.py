"""Operator 2: shards by balanced label propagation over groups of linked documents.

Documents are linked when they share a link value (here: equal text). All start on a shard by hash. Each
round, every group asks its members on other shards to join its fullest shard; what may move from shard a
to shard b is bounded by what b asks of a in exchange, plus b's free places, plus the rows without links, and the small
groups that are together, that b can give a for them; so sizes stay even while cut links shrink. Members that fill a shard by themselves stay there, and the rest of their group turns to the
next one. Last, rows above a shard's quota (those without links first) go to shards below theirs: counts
end at most one apart (law ``rows``).

A round is two group-bys with map-side sums, and a join of the counts per (group, shard) back to the rows; a
hot group is at most ``shards`` rows there, and is joined by broadcast, so its rows stay where they are. Only tables of shards x shards counts reach the driver. Ranks are
made of per-task counts, so no group or shard is gathered in a task. Rows carry no text, only its digest.

Rows are told apart by their place in a staged table, so repeated rows and repeated or null ids are rows of
their own. Null links link to nothing. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, numbered, ranked, small_scans, staged, unstage

ROUNDS = 12


def _quotas(asked: dict[tuple[int, int], int], free: list[int],
            loose: list[int]) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """How many of the asked moves may happen, and the loose rows that go the other way for them.

    Exchanges first, then free places, then loose rows of the shard that is moved to.
    """
    allowed = {(a, b): min(n, asked.get((b, a), 0)) for (a, b), n in asked.items()}
    given: dict[tuple[int, int], int] = {}
    free, loose = list(free), list(loose)
    for (a, b), n in sorted(asked.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - allowed[a, b], max(0, free[b]))
        free[b] -= more
        free[a] += more
        swap = min(n - allowed[a, b] - more, loose[b])
        loose[b] -= swap
        if swap:
            given[b, a] = swap
        allowed[a, b] += more + swap
    return {k: v for k, v in allowed.items() if v}, given


def _targets(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def _sizes(state: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """Rows per shard, and those of them without links."""
    got = {r[0]: (r[1], r[2]) for r in state.groupBy("shard").agg(
        F.count(F.lit(1)), F.count(F.when(F.col("g").isNull(), 1))).collect()}
    return [got.get(s, (0, 0))[0] for s in range(shards)], [got.get(s, (0, 0))[1] for s in range(shards)]


def balanced_shards(docs: DataFrame, links: list, shards: int = 16, rounds: int = ROUNDS, id_col: str = "doc_id",
                    keep: dict | None = None) -> DataFrame:
    """``id_col``, the ``keep`` columns, ``shard`` and ``slot`` (gapless from 0 in each shard).

    ``links``: columns that together name a document's group; all null: no group.
    """
    keep = keep or {}
    known = F.coalesce(*[c.isNotNull() for c in links]) if len(links) == 1 else F.greatest(*[c.isNotNull() for c in links])
    rows = docs.select(F.col(id_col).alias("id"), *[c.alias(k) for k, c in keep.items()],
                       F.when(known, F.md5(F.concat_ws("\x1f", *[c.cast("string") for c in links]))).alias("g"),
                       F.lit(0).alias("all"))
    with small_scans(docs.sparkSession):  # the only scan of whole texts
        state = numbered(rows, "all", "rows")
    state = state.withColumn("row", F.shiftleft(F.col("part").cast("long"), 40) + F.col("local"))
    state = state.drop("all", "part", "local")
    count = state.count()
    groups = state.filter("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("n_g")).filter("n_g > 1")
    singles = join_hot(state, groups.select(F.col("g").alias("gg"), "n_g"), [("g", "gg")], "n_g", count)
    state = staged(singles.withColumn("g", F.col("gg")).drop("gg", "n_g").withColumn(
        "shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")), "state")
    sizes, loose = _sizes(state, shards)
    total = sum(sizes)
    target = _targets(total, shards)

    tight: list[int] = []
    for turn in range(rounds):
        free = [target[s] - sizes[s] for s in range(shards)]
        held = state.filter("g is not null").groupBy("g", "shard").agg(F.count(F.lit(1)).alias("n"))
        full = F.create_map(*[F.lit(x) for s in range(shards) for x in (s, 0.95 * target[s])])
        large = F.col("n") * 16 > max(target)
        # Small groups look elsewhere than where the last round had no room; large ones go on asking.
        open_ = (F.col("n") < full[F.col("shard")]) & (large | ~F.col("shard").isin(tight))
        # The fullest shard that the group does not fill already; on a tie the one its hash points to first.
        order = F.struct(F.col("n"), F.hash("g", "shard"), F.col("shard"))
        groups = held.groupBy(F.col("g").alias("wg")).agg(F.count(F.lit(1)).alias("k"), F.max(F.when(open_, order)).alias("best"))
        wish = F.when((F.col("n") < full[F.col("shard")]) & (F.col("best.shard") != F.col("shard")), F.col("best.shard"))
        moves = held.join(groups, F.col("g") == F.col("wg")).select(
            F.col("g").alias("mg"), F.col("shard").alias("m_from"), "n", large.alias("large"), wish.alias("wish"),
            ((F.col("k") == 1) & ~large).alias("settled"))
        moves = staged(moves.filter("wish is not null or settled"), "moves")
        asked = {(r[0], r[1]): r[2] for r in moves.filter("wish is not null").groupBy("m_from", "wish").agg(F.sum("n")).collect()}
        for r in moves.filter("settled").groupBy("m_from").agg(F.sum("n")).collect():
            loose[r[0]] += r[1]
        allowed, given = _quotas(asked, free, loose)
        into = {b: sum(n for (_, x), n in asked.items() if x == b) for _, b in asked}
        tight = [b for b, n in into.items() if 2 * sum(v for (_, x), v in allowed.items() if x == b) < n]
        if not asked:
            unstage(moves)
            break
        # A group's part of a shard moves whole, by a hash against the quota; a large part moves row by row.
        share = F.create_map(*[F.lit(x) for (a, b), n in asked.items() for x in (
            a * shards + b, allowed.get((a, b), 0) / n)])
        odds = F.coalesce(F.try_element_at(share, F.col("m_from") * shards + F.col("wish")), F.lit(0.0))
        chance = F.pmod(F.xxhash64(F.lit(turn), "mg", "m_from", F.when(F.col("large"), F.col("row"))), F.lit(1 << 30)) / (1 << 30)
        # Rows without links and groups that are together give way: their hash falls into another shard's span or not.
        spans, at = [], defaultdict(float)
        for (b, a), n in sorted(given.items()):
            spans.append((b, a, at[b], at[b] + n / loose[b]))
            at[b] += n / loose[b]
        spot = F.pmod(F.xxhash64(F.lit(turn), F.lit("way"), F.coalesce("g", F.col("row").cast("string"))), F.lit(1 << 30)) / (1 << 30)
        way = F.col("shard")
        for b in {b for b, *_ in spans}:
            to = F.lit(b)
            for _, a, lo, hi in (x for x in spans if x[0] == b):
                to = F.when((spot >= lo) & (spot < hi), F.lit(a)).otherwise(to)
            way = F.when(F.col("shard") == b, to).otherwise(way)
        new = join_hot(state, moves, [("g", "mg"), ("shard", "m_from")], "n", count).withColumn("shard", F.when(
            F.col("wish").isNotNull(), F.when(chance < odds, F.col("wish")).otherwise(F.col("shard"))).when(
            F.col("g").isNull() | F.coalesce("settled", F.lit(False)), way).otherwise(F.col("shard")).cast("int"))
        new = staged(new.select(state.columns), "state")
        unstage(moves)
        unstage(state)
        state = new
        sizes, loose = _sizes(state, shards)

    return _even(state, target, sizes, id_col, list(keep))


def _even(state: DataFrame, target: list[int], sizes: list[int], id_col: str, keep: list[str]) -> DataFrame:
    """Exact quotas: rows over a shard's target fill the places under other shards' targets; then slots."""
    shards = len(target)
    over = [max(0, sizes[s] - target[s]) for s in range(shards)]
    under = [max(0, target[s] - sizes[s]) for s in range(shards)]
    # Rows without links leave first: they cut nothing. Class 2s holds them, 2s + 1 the linked ones.
    state = numbered(state.withColumn("class", F.col("shard") * 2 + F.col("g").isNotNull().cast("int")), "class", "classes")
    loose = defaultdict(int, {r[0]: r[1] for r in state.groupBy("class").count().collect()})
    leaving = {}
    for s in range(shards):
        leaving[2 * s] = min(over[s], loose[2 * s])
        leaving[2 * s + 1] = over[s] - leaving[2 * s]
    # Leaving rows in order of class and rank get the free places in order of shard.
    begin, at = {}, 0
    for c in range(2 * shards):
        begin[c] = at
        at += leaving[c]
    ends, so_far = [], 0
    for s in range(shards):
        so_far += under[s]
        ends.append(so_far)
    as_map = lambda d: F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, v)])
    rows = ranked(state, "class")
    place = as_map(begin)[F.col("class")] + F.col("rank")
    to = F.lit(shards - 1)
    for s in reversed(range(shards)):
        to = F.when(place < ends[s], s).otherwise(to)
    moved = rows.withColumn("shard", F.when(F.col("rank") < as_map(leaving)[F.col("class")], to).otherwise(
        F.col("shard")).cast("int")).drop("part", "local", "rank", "class")
    final = ranked(numbered(moved, "shard", "slots"), "shard")
    return final.select(F.col("id").alias(id_col), *keep, "shard", F.col("rank").cast("long").alias("slot"),
                        F.col("g").alias("link"))
