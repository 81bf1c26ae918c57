"""Best-fit packing of token pieces by a grouping genetic algorithm.

Documents become pieces of at most ``capacity`` tokens; pieces are dealt at
random into archipelagos of about ``POOL`` pieces.  In an archipelago several
islands evolve packings of the same pieces: a child takes whole well-filled
bins from one parent, drops the other parent's bins that hold any of those
pieces, and best-fits the pieces that this displaces.  After each epoch every
island sends its best packing to the next (elites migrate), and at the end the
fewest bins win.  Bins with room left over are opened again and their pieces
pooled anew with those of other archipelagos, so that each archipelago's
remainder does not stay.

All rows are small (an archipelago is one row of arrays), tasks are bounded by
POOL, and every random choice is seeded by the archipelago and island, so a
retried task repeats its result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm import scratch, textbuf, word_encoder

POOL = 4096
ISLANDS = 3
EPOCHS = 2
POPULATION = 4
GENERATIONS = 6
PIECES = "piece_key long, doc_id long, piece int, start long, length long, ids_crc32 long"


# ---- pieces -------------------------------------------------------------


def _pieces(tokenizer: str, end_id: int, capacity: int):
    def run(batches):
        end = np.array([end_id], np.uint32)
        for b in textbuf.slices(batches, "text"):
            ids, per = word_encoder.encode(b.column("text"), tokenizer)
            ends = np.cumsum(per).tolist()
            keys, docs, piece, start, length, crc = [], [], [], [], [], []
            for d, k, i, j in zip(b.column("doc_id").to_pylist(), b.column("row_key").to_pylist(), [0, *ends[:-1]], ends):
                whole = np.concatenate([ids[i:j], end]).astype("<u4")
                for p, at in enumerate(range(0, len(whole), capacity)):
                    part = whole[at : at + capacity]
                    keys.append(k)
                    docs.append(d)
                    piece.append(p)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            with np.errstate(over="ignore"):
                key = textbuf.mix(np.array([0 if d is None else d for d in docs], np.int64).view(np.uint64) * textbuf._GOLD + np.array(keys, np.int64).view(np.uint64) + np.array(piece, np.uint64))
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(docs, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["piece_key", "doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; a null text is empty, so its only token is the end id."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row_key"))
    return rows.mapInArrow(_pieces(tokenizer, end_id, capacity), PIECES)


# ---- the genetic algorithm on one pool ----------------------------------


def best_fit(lengths: list[int], items, bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Put items, largest first, into the fullest bin that takes them.

    Bins with equal room are kept in stacks and a bit set tells which rooms
    occur, so the best bin is the lowest set bit from the item's length on.
    """
    stacks: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(room):
        stacks.setdefault(r, []).append(b)
        mask |= 1 << r
    for i in sorted(items, key=lambda x: -lengths[x]):
        n = lengths[i]
        fit = mask >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = stacks[r].pop()
            if not stacks[r]:
                mask ^= 1 << r
        else:
            b, r = len(bins), capacity
            bins.append([])
            room.append(capacity)
        bins[b].append(i)
        r -= n
        room[b] = r
        if not mask >> r & 1:
            mask |= 1 << r
            stacks[r] = []
        stacks[r].append(b)


def exchange(lengths: list[int], displaced: list[int], bins: list[list[int]], room: list[int]) -> list[int]:
    """Trade displaced pieces for one or two smaller ones of a bin where that fills
    the bin better; what is displaced afterwards.

    Every trade leaves less room in a bin and smaller pieces outside, which fit
    elsewhere more easily.
    """
    outside = sorted(displaced, key=lengths.__getitem__)
    sizes = [lengths[i] for i in outside]
    for b in sorted((b for b, r in enumerate(room) if r), key=room.__getitem__, reverse=True):
        own, r = bins[b], room[b]
        best = None
        for x in range(len(own)):
            for y in range(x, len(own)):
                s = lengths[own[x]] + (lengths[own[y]] if y > x else 0)
                # one piece, or two, of more than s and at most s + r in all
                k = bisect_right(sizes, s + r) - 1
                if k >= 0 and sizes[k] > s and (best is None or sizes[k] - s > best[0]):
                    best = (sizes[k] - s, x, y, (k,))
                for i in range(bisect_right(sizes, (s + r) // 2) if y > x else 0):
                    j = bisect_right(sizes, s + r - sizes[i]) - 1
                    if j > i and sizes[i] + sizes[j] - s > (best[0] if best else 0):
                        best = (sizes[i] + sizes[j] - s, x, y, (i, j))
            if best and best[0] == r:
                break
        if best:
            gain, x, y, taken = best
            freed = [own[z] for z in {x, y}]
            bins[b] = [i for i in own if i not in freed] + [outside[k] for k in taken]
            room[b] = r - gain
            for k in sorted(taken, reverse=True):
                del outside[k], sizes[k]
            for i in freed:
                k = bisect_right(sizes, lengths[i])
                outside.insert(k, i)
                sizes.insert(k, lengths[i])
    return outside


def _room(bins, lengths, capacity):
    return [capacity - sum(lengths[i] for i in b) for b in bins]


def fitness(bins, lengths, capacity) -> tuple[int, float]:
    """Fewer bins first, then bins filled less evenly."""
    return -len(bins), sum(((capacity - r) / capacity) ** 2 for r in _room(bins, lengths, capacity))


def crossover(mother, father, lengths, capacity, rng):
    """Inject well-filled bins of the father into the mother; displaced pieces
    are traded where that fills bins, then best-fitted."""
    fill = [-r for r in _room(father, lengths, capacity)]
    ranked = sorted(range(len(father)), key=lambda b: -fill[b])
    half = ranked[: max(1, len(ranked) // 2)]
    lo = int(rng.integers(len(half)))
    chosen = [father[b] for b in half[lo : lo + max(1, int(rng.integers(1, max(2, len(half) // 2))))]]
    taken = {i for b in chosen for i in b}
    child = [list(b) for b in chosen]
    displaced = []
    for b in mother:
        if taken.isdisjoint(b):
            child.append(list(b))
        else:
            displaced.extend(i for i in b if i not in taken)
    room = _room(child, lengths, capacity)
    best_fit(lengths, exchange(lengths, displaced, child, room), child, room, capacity)
    return child


def mutate(bins, lengths, capacity, rng):
    """Empty the bins with most room and some others, and best-fit their pieces."""
    room = _room(bins, lengths, capacity)
    order = sorted(range(len(bins)), key=lambda b: -room[b])
    gone = set(order[: max(1, len(order) // 50)]) | {int(x) for x in rng.integers(len(bins), size=max(1, len(bins) // 50))}
    child = [list(b) for k, b in enumerate(bins) if k not in gone]
    items = [i for k in gone for i in bins[k]]
    room = _room(child, lengths, capacity)
    best_fit(lengths, exchange(lengths, items, child, room), child, room, capacity)
    return child


def evolve(lengths: list[int], capacity: int, seeds: list, rng, generations: int = GENERATIONS, least: int = 1):
    """The best packing after some generations from seeds, best fit and noise.

    After ``least`` generations it stops as soon as a packing has as few bins
    as the total length allows: no crossover could save another.  Equal
    numbers of bins are told apart by how much room is in one place.
    """
    bound = -(-sum(lengths) // capacity)
    score = lambda b: fitness(b, lengths, capacity)
    first: list[list[int]] = []
    best_fit(lengths, range(len(lengths)), first, [], capacity)
    people = [*seeds, first]
    if not first:
        return first
    while len(people) < 2:
        people.append(mutate(first, lengths, capacity, rng))
    scores = [score(b) for b in people]
    for g in range(generations):
        if g >= least:
            if -max(scores)[0] <= bound:
                break
            while len(people) < POPULATION:
                people.append(mutate(first, lengths, capacity, rng))
                scores.append(score(people[-1]))
        ranked = sorted(range(len(people)), key=scores.__getitem__, reverse=True)
        a, b = (ranked[i] for i in sorted(rng.permutation(len(people))[:2].tolist()))
        child = crossover(people[a], people[b], lengths, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, lengths, capacity, rng)
        own, worst = score(child), ranked[-1]
        if own > scores[worst]:
            people[worst], scores[worst] = child, own
    return people[max(range(len(people)), key=scores.__getitem__)]


# ---- pools, islands and epochs as rows -----------------------------------


def _pool_rows(batches):
    """One row for each pool: its pieces, by length and key."""
    for t in textbuf.whole_groups(batches, "pool"):
        pool, key, length = (t.column(c).to_numpy() for c in ("pool", "piece_key", "length"))
        for lo, hi in textbuf.group_bounds(pool):
            order = lo + np.lexsort((key[lo:hi], -length[lo:hi]))
            yield pa.record_batch([pa.array([int(pool[lo])]), pa.array([key[order].astype("<i8").tobytes()], pa.binary()), pa.array([length[order].astype("<i4").tobytes()], pa.binary())], ["pool", "keys", "lengths"])


def _unpack(raw: bytes) -> list[list[int]]:
    of = np.frombuffer(raw, "<i4")
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    return [x.tolist() for x in np.split(order, cuts)] if len(of) else []


def _pack(bins: list[list[int]], n: int) -> bytes:
    of = np.empty(n, "<i4")
    for b, items in enumerate(bins):
        of[items] = b
    return of.tobytes()


def _epoch(capacity: int, epoch: int):
    def run(batches):
        for b in batches:
            for pool, island, lengths, immigrants in zip(*(b.column(c).to_pylist() for c in ("pool", "island", "lengths", "immigrants"))):
                sizes = np.frombuffer(lengths, "<i4").tolist()
                rng = np.random.default_rng([pool & 0xFFFFFFFF, island, epoch])
                best = evolve(sizes, capacity, [_unpack(x) for x in immigrants or []], rng)
                n, squares = fitness(best, sizes, capacity)
                yield pa.record_batch([pa.array([pool]), pa.array([island], pa.int32()), pa.array([-n], pa.int32()), pa.array([squares]), pa.array([_pack(best, len(sizes))], pa.binary())], ["pool", "island", "n_bins", "squares", "packing"])

    return run


def _assign(capacity: int):
    def run(batches):
        for b in batches:
            for pool, keys, lengths, packing in zip(*(b.column(c).to_pylist() for c in ("pool", "keys", "lengths", "packing"))):
                key, size, of = np.frombuffer(keys, "<i8"), np.frombuffer(lengths, "<i4").astype(np.int64), np.frombuffer(packing, "<i4")
                order = np.argsort(of, kind="stable")
                key, size, of = key[order], size[order], of[order]
                before = np.cumsum(size) - size
                head = np.concatenate([[True], of[1:] != of[:-1]])
                offset = before - before[head][np.cumsum(head) - 1]
                used = np.bincount(of, weights=size).astype(np.int64)[of]
                yield pa.record_batch([pa.array(np.full(len(key), pool)), pa.array(of.astype(np.int64)), pa.array(key), pa.array(size), pa.array(offset), pa.array(used)], ["pool", "bin", "piece_key", "length", "offset", "used"])

    return run


def _pack_once(sizes: DataFrame, n: int, capacity: int, root: str, level: int) -> DataFrame:
    """(pool, bin, piece_key, length, offset, used) of pieces dealt into pools."""
    pools = max(1, round(n / POOL))
    dealt = sizes.select(F.pmod(F.xxhash64("piece_key", F.lit(level)), F.lit(pools)).alias("pool"), "piece_key", "length")
    rows = scratch.stored(dealt.repartition("pool").sortWithinPartitions("pool").mapInArrow(_pool_rows, "pool long, keys binary, lengths binary"), f"{root}/pools{level}")
    islands = rows.select("pool", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "lengths")
    best = None
    for epoch in range(EPOCHS):
        if best is None:
            fed = islands.withColumn("immigrants", F.lit(None).cast("array<binary>"))
        else:  # an island gets its own best and that of the island before it
            sent = best.select("pool", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))).alias("island"), "packing")
            fed = islands.join(sent.groupBy("pool", "island").agg(F.sort_array(F.collect_list("packing")).alias("immigrants")), ["pool", "island"])
        best = scratch.stored(fed.repartition("pool", "island").mapInArrow(_epoch(capacity, epoch), "pool long, island int, n_bins int, squares double, packing binary"), f"{root}/epoch{level}-{epoch}")
    winner = best.groupBy("pool").agg(F.min(F.struct("n_bins", -F.col("squares"), "island", "packing")).alias("w")).select("pool", F.col("w.packing").alias("packing"))
    return rows.join(winner, "pool").mapInArrow(_assign(capacity), "pool long, bin long, piece_key long, length long, offset long, used long")


def pack(parts: DataFrame, capacity: int = 4096, levels: int = 2, open_below: float = 0.98) -> DataFrame:
    """``parts`` (piece_key unique, length) with sequence_id and offset.

    Pieces of one sequence stand one after the other from offset 0.  Each
    further level pools the pieces of sequences filled less than
    ``open_below`` again.  An empty table gives an empty result.
    """
    spark = parts.sparkSession
    root = scratch.root(spark)
    left, done = parts.select("piece_key", "length"), None
    for level in range(levels):
        packed = scratch.stored(_pack_once(left, left.count(), capacity, root, level), f"{root}/packed{level}")
        full = packed if level == levels - 1 else packed.filter(F.col("used") >= open_below * capacity)
        named = full.select("piece_key", F.xxhash64(F.lit(level), "pool", "bin").alias("sequence_id"), "offset")
        done = named if done is None else done.union(named)
        left = packed.filter(F.col("used") < open_below * capacity).select("piece_key", "length")
    return done


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece, its end token; an empty table gives an
    empty result; texts of any length are encoded whole and cut into pieces of
    ``capacity``.  Rows that repeat an id are packed like any others; rows equal in id and
    text share a key and are told apart by a number.  Rows without an id are
    packed too.  Other columns are ignored.
    """
    spark = docs.sparkSession
    parts = pieces(docs, tokenizer, end_id, capacity, id_col, text_col)
    again = F.row_number().over(_equal_pieces()) - 1
    parts = scratch.stored(parts.withColumn("piece_key", F.when(again == 0, F.col("piece_key")).otherwise(F.xxhash64("piece_key", again))), scratch.root(spark) + "/pieces")
    return parts.join(pack(parts, capacity), "piece_key").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _equal_pieces():
    from pyspark.sql import Window as W

    return W.partitionBy("piece_key").orderBy("doc_id")
