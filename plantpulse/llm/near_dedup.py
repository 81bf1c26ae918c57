"""Near-duplicate documents with an LSH forest over MinHash signatures.

Texts become sets of 5-word shingles.  Equal sets are one class, so copies
cost nothing further.  A class has 64 MinHash values.  A tree of the forest is
an order of these values: the classes sorted by their values in that order.
Classes that agree on an order's first values stand together in its sorted
list and form a region; how far two of them agree from the start (their common
prefix) is how deep in the tree they part.

A region of up to ``REGION`` classes is searched to its root: neighbours of the
longest common prefix first, then all that it holds.  A region of more is only
searched in its deeper subtrees, each just deep enough to hold ``REGION``
classes or fewer, and across their borders from neighbour to neighbour; its
classes then go on to the next level, which has more orders and regions of
longer prefixes, so that a linked pair still meets almost surely:

    level   prefix   orders   missed pairs at similarity 0.85
    0       4        16       8e-6 (orders share no value)
    1       8        128      1e-5
    2       10       256      4e-5

Orders of one signature share its values; the figures of levels 1 and 2 count
that in (a mean over how many of the 64 values a pair agrees on).  ``levels``
and ``likely`` follow the threshold asked for: at 0.80 there are 32, 256 and
768 orders.  A region that is crowded even in the deepest level is one star
around its least id, so none of its pairs is dropped.

Candidates whose signatures make a link likely leave the task as stars (an
edge a member), never as all pairs.  The stars' components (clumps) bring
likely partners together once; there links are confirmed on full sets.  Clumps
of more than ``BLOCK`` classes, or of more than ``BLOCK_SHINGLES`` shingles,
are cut into blocks.  Each block is first confirmed together with
representatives of the whole clump; what that joins into the clump's largest
component needs no further pair among itself, and only the other members meet
every block.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm import scratch, textbuf
from plantpulse.llm.components import components

U64 = np.uint64
SHINGLE = 5
VALUES = 64
#: (prefix, step of the number of orders) of each level.
PREFIXES = ((4, 16), (8, 128), (10, 128))
#: Most pairs at the threshold that a level may miss, and its most orders.
MISSED = 5e-5
MAX_ORDERS = 1024
REGION = 2048
#: Classes of a crowded region that one task takes; more are dealt by their ids.
SPREAD = 32 * REGION
#: Bits of a region's key that tell its order.
ORDER_BITS = 10
BLOCK = 4096
BLOCK_SHINGLES = 4_000_000
#: One of so many members of a block stands for its clump.
PER_REPRESENTATIVE = 8
_KEEP = U64(14)

_SEEDS = textbuf._table(77, VALUES) | U64(1)


def _agreeing(percent: int) -> list[float]:
    """Chance that a pair at the threshold agrees on k of the 64 values, for each k."""
    s = percent / 100
    return [comb(VALUES, k) * s**k * (1 - s) ** (VALUES - k) for k in range(VALUES + 1)]


def missed(percent: int, prefix: int, orders: int) -> float:
    """The part of pairs at the threshold that agree on no order's prefix."""
    if prefix * orders <= VALUES:  # the orders share no value
        return (1 - (percent / 100) ** prefix) ** orders
    return sum(p * (1 - comb(k, prefix) / comb(VALUES, prefix)) ** orders for k, p in enumerate(_agreeing(percent)))


def levels(percent: int) -> list[tuple[int, int]]:
    """(prefix, orders) of each level.  A deeper level that would need more
    than ``MAX_ORDERS`` is left out; the one before is then the deepest."""
    out = []
    for prefix, step in PREFIXES:
        fit = next((n for n in range(step, MAX_ORDERS + 1, step) if missed(percent, prefix, n) <= MISSED), None)
        if fit is None:
            break
        out.append((prefix, fit))
    if not out:
        raise ValueError(f"no number of orders up to {MAX_ORDERS} finds pairs at {percent} %")
    return out


def likely(percent: int) -> int:
    """Agreeing values from which a pair is likely: fewer have a chance under 5e-6 at the threshold."""
    return int(np.searchsorted(np.cumsum(_agreeing(percent)), 5e-6))


def _orders(level: int, prefix: int, n: int) -> np.ndarray:
    """Orders of the 64 values; the prefixes of the first of level 0 share none."""
    return np.stack([np.roll(np.arange(VALUES), -prefix * i) if level == 0 and prefix * (i + 1) <= VALUES else np.random.default_rng(1000 * level + i).permutation(VALUES) for i in range(n)])


def shingle_sets(texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 50-bit shingle hashes, sorted in each text, and their counts.

    A text of fewer than five words has its whole sequence as one shingle; one
    without words has none.
    """
    buf, offs = textbuf.flat(texts)
    buf = textbuf.lower_ascii(buf)
    ws, we = textbuf.words(buf, offs)
    per = textbuf.counts(ws, offs)
    hashes = textbuf.span_hashes(buf, ws, we)
    grams = textbuf.rolling(hashes, SHINGLE)
    ok = np.flatnonzero(textbuf.inside(per, SHINGLE))
    first = np.concatenate([[0], np.cumsum(per)])
    short = np.flatnonzero((per > 0) & (per < SHINGLE))
    value = np.concatenate([grams[ok], textbuf.value_spans(hashes, first[short], first[short + 1])])
    doc = np.concatenate([textbuf.owner(per)[ok], short]).astype(U64)
    keyed = np.unique(doc << (U64(64) - _KEEP) | value >> _KEEP)
    sizes = np.bincount((keyed >> (U64(64) - _KEEP)).astype(np.int64), minlength=len(per))
    return keyed & ((U64(1) << (U64(64) - _KEEP)) - U64(1)), sizes


def signatures(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 MinHash values of each set that isn't empty."""
    full = sizes > 0
    at = (np.cumsum(sizes) - sizes)[full]
    out = np.empty((len(at), VALUES), np.uint32)
    x = textbuf.mix(sets.copy())
    with np.errstate(over="ignore"):
        for i in range(VALUES):
            y = x * _SEEDS[i]
            out[:, i] = np.minimum.reduceat(y ^ (y >> U64(29)), at) >> U64(32) if len(at) else 0
    return out


def _features(batches):
    for b in textbuf.slices(batches, "text"):
        sets, sizes = shingle_sets(b.column("text"))
        full = sizes > 0
        at = (np.cumsum(sizes) - sizes)[full]
        fp = np.zeros((2, len(sizes)), U64)
        with np.errstate(over="ignore"):
            for i in range(2):
                if len(at):
                    fp[i, full] = textbuf.mix(np.add.reduceat(textbuf.mix(sets + U64(7 + i)), at))
        raw = signatures(sets, sizes).tobytes()
        signed = [None] * len(sizes)
        for j, i in enumerate(np.flatnonzero(full).tolist()):
            signed[i] = raw[4 * VALUES * j : 4 * VALUES * (j + 1)]
        yield pa.record_batch([b.column("doc_id"), b.column("row_key"), pa.array(sizes.astype(np.int64)), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), pa.array(signed, pa.binary())], ["doc_id", "row_key", "n_shingles", "fp1", "fp2", "signature"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, VALUES)


def _hashed(m: np.ndarray, columns, key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        for c in columns:
            key = textbuf.mix(key * textbuf._GOLD + m[:, c])
    return key


def _region_keys(orders: np.ndarray, prefix: int):
    """(region, id): a row for each order; the low bits of a region name the order."""

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            m = _matrix(b.column("signature")).astype(U64)
            for i, order in enumerate(orders):
                key = _hashed(m, order[:prefix], np.full(len(m), U64(1 + i)))
                key = key >> U64(ORDER_BITS) << U64(ORDER_BITS) | U64(i)
                yield pa.record_batch([pa.array(key.view(np.int64)), b.column("id")], ["region", "id"])

    return run


def _places(orders: np.ndarray, prefix: int, region: int, spread: int):
    """(subtree, label, id): where each class stands in its region's order.

    A label is the signature in that order, a byte a value (unequal values
    look equal once in 256 times, equal ones always do).  Crowded regions are
    dealt by their next two values and, if very large, by ids.
    """

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            at, n = b.column("region").to_numpy(), b.column("n").to_numpy()
            order = orders[at & ((1 << ORDER_BITS) - 1)]
            m = np.take_along_axis(_matrix(b.column("signature")), order, 1)
            label = (m * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
            deeper = _hashed(m.astype(U64), (prefix, prefix + 1), at.view(U64))
            with np.errstate(over="ignore"):
                dealt = textbuf.mix(b.column("id").to_numpy().view(U64) * U64(3)) % (n // spread + 1).astype(U64)
                subtree = np.where(n > region, textbuf.mix(deeper + dealt), at.view(U64))
            raw = label.tobytes()
            yield pa.record_batch([pa.array(subtree.view(np.int64)), pa.array([raw[i : i + VALUES] for i in range(0, len(raw), VALUES)], pa.binary()), b.column("id")], ["subtree", "label", "id"])

    return run


def _common_prefixes(labels: np.ndarray) -> np.ndarray:
    """How many first values each sorted label shares with the one before; 0 for the first."""
    unlike = labels[1:] != labels[:-1]
    return np.concatenate([[0], np.where(unlike.any(1), unlike.argmax(1), labels.shape[1])])


def subtrees(prefixes: np.ndarray, lo: int, hi: int, most: int) -> list[tuple[int, int]]:
    """Sorted labels lo .. hi as subtrees of up to ``most``, no deeper than needed.

    Where more labels than that are equal they are cut anywhere.
    """
    out, open_ = [], [(lo, hi)]
    while open_:
        i, j = open_.pop()
        if j - i <= most:
            out.append((i, j))
            continue
        inner = prefixes[i + 1 : j]
        depth = inner.min()
        if depth >= VALUES:
            cuts = np.arange(i + most, j, most)
        else:
            cuts = i + 1 + np.flatnonzero(inner == depth)
            # children that fit together stay together: borders cost pairs
            ends, keep, begin = np.append(cuts[1:], j), [], i
            for c, e in zip(cuts.tolist(), ends.tolist()):
                if e - begin > most:
                    keep.append(c)
                    begin = c
            cuts = np.array(keep)
        bounds = [i, *cuts.tolist(), j]
        open_.extend(zip(bounds[:-1], bounds[1:]))
    return sorted(out)


def _stars(ids: np.ndarray, groups, near) -> pa.RecordBatch:
    """Edges from each member to the least id of its component in the group.

    ``near(i, others)`` tells which others are joined to i.  A member is
    compared with those not yet reached, so a group of alike ones takes about
    as many comparisons as it has members.
    """
    left, right = [], []
    for lo, hi in groups:
        rest = np.arange(lo, hi)
        while len(rest) > 1:
            reached, rest = [int(rest[0])], rest[1:]
            for i in reached:  # grows while it is read
                if len(rest) == 0:
                    break
                hit = near(i, rest)
                reached.extend(rest[hit].tolist())
                rest = rest[~hit]
            own = ids[reached]
            least = own.min()
            own = own[own != least]
            left.append(own)
            right.append(np.full(len(own), least))
    if not left:
        left = right = [np.empty(0, np.int64)]
    return pa.record_batch([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])


def _spanning(least: int, most: int):
    """The likely pairs of sorted labels as stars: neighbours of the longest
    common prefix, then all of a subtree, then neighbours across borders."""

    def run(batches):
        for t, _ in textbuf.group_chunks(batches, "subtree"):
            labels = np.frombuffer(b"".join(t.column("label").to_pylist()), np.uint8).reshape(-1, VALUES)
            ids = t.column("id").to_numpy()
            prefixes = _common_prefixes(labels)
            likely_next = np.concatenate([[False], (labels[1:] == labels[:-1]).sum(1) >= least])
            leaves, borders = [], []
            for lo, hi in textbuf.group_bounds(t.column("subtree").to_numpy()):
                parts = subtrees(prefixes, lo, hi, most)
                leaves.extend(parts)
                borders.extend(i for i, _ in parts if i > lo and likely_next[i])
            yield _stars(ids, leaves, lambda i, others: (labels[others] == labels[i]).sum(1) >= least)
            at = np.array(borders, np.int64)
            yield pa.record_batch([pa.array(ids[at]), pa.array(ids[at - 1])], ["a", "b"])

    return run


def likely_edges(classes: DataFrame, percent: int, root: str) -> DataFrame:
    """(a, b): stars of the likely components of all regions, level by level."""
    found = []
    left = classes
    depths = levels(percent)
    for level, (prefix, n) in enumerate(depths):
        orders, deepest = _orders(level, prefix, n), level == len(depths) - 1
        keys = left.mapInArrow(_region_keys(orders, prefix), "region long, id long")
        counts = keys.groupBy("region").agg(F.count("*").alias("n")).filter("n > 1")
        members = scratch.stored(keys.join(counts, "region"), f"{root}/regions{level}")
        searched = members.filter(F.col("n") <= REGION) if deepest else members
        placed = searched.join(classes, "id").mapInArrow(_places(orders, prefix, REGION, SPREAD), "subtree long, label binary, id long")
        found.append(placed.repartition("subtree").sortWithinPartitions("subtree", "label").mapInArrow(_spanning(likely(percent), REGION), "a long, b long"))
        crowded = members.filter(F.col("n") > REGION)
        if crowded.isEmpty():
            break
        if deepest:  # no longer prefix: all its members are likely
            least = crowded.groupBy("region").agg(F.min("id").alias("b"))
            found.append(crowded.join(least, "region").select(F.col("id").alias("a"), "b"))
        left = classes.join(crowded.select("id").distinct(), "id", "left_semi")
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    return edges.distinct()


def _linked(i: int, others: np.ndarray, sets, bounds, sizes, percent: int) -> np.ndarray:
    """Which of the other sets have a similarity of ``percent`` % or more to set i."""
    own = sets[bounds[i] : bounds[i + 1]]
    # sets whose sizes alone rule a link out
    small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
    out = 100 * small >= percent * large
    cand = others[out]
    if len(cand):
        n = sizes[cand]
        starts = np.cumsum(n) - n
        flat = sets[np.arange(int(n.sum())) - np.repeat(starts, n) + np.repeat(bounds[cand], n)]
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        common = np.add.reduceat((own[at] == flat).astype(np.int64), starts)
        out[out] = 100 * common >= percent * (sizes[i] + n - common)
    return out


class _Rare:
    """Which sets of a group can link at all, by their rarest shingles.

    Sets are read rarest shingle first (by the group's own counts).  A pair with
    ``percent`` % or more shares one of the first n - ceil(t * n) + 1 shingles of the
    larger set and, as both are no smaller than the smaller one, of the first
    n - ceil(2t / (1 + t) * n) + 1 of the smaller.  Of those left, sets
    whose bitmaps (a bit a shingle, by its hash) differ in more bits than linked
    sets can differ in shingles drop out.  Neither loses a pair; of sets that are
    alike but not enough so few pass both.
    """

    def __init__(self, sets: np.ndarray, bounds: np.ndarray, lo: int, hi: int, percent: int):
        self.lo, self.sizes = lo, np.diff(bounds[lo : hi + 1])
        owner = np.repeat(np.arange(hi - lo), self.sizes)
        token, n = np.unique(sets[bounds[lo] : bounds[hi]], return_inverse=True, return_counts=True)[1:]
        key = (owner << 16 | np.minimum(n[token], (1 << 16) - 1)) << 32 | token
        key.sort()
        token, shared = (key & ((1 << 32) - 1)).astype(np.int64), (key >> 32 & ((1 << 16) - 1)) > 1
        at = np.arange(len(token)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        # prefixes of a set as the larger and as the smaller one of a pair
        self.first = [self.sizes + 1 + -share * self.sizes // by for share, by in ((percent, 100), (2 * percent, 100 + percent))]
        self.tokens, self.begin, self.who = [], [], []
        for first in self.first:
            use = shared & (at < first[owner])
            self.tokens.append((token[use], np.concatenate([[0], np.cumsum(np.bincount(owner[use], minlength=hi - lo))])))
            order = np.argsort(token[use], kind="stable")
            self.who.append(owner[use][order])
            self.begin.append(np.searchsorted(token[use][order], np.arange(len(n) + 1)))
        self.place = np.full(hi - lo, -1)
        width = 1 << int(np.clip(np.ceil(np.log2(4 * max(self.sizes.mean(), 1))), 9, 12))
        member = np.zeros((hi - lo, width), bool)
        with np.errstate(over="ignore"):
            member[owner, (textbuf.mix(sets[bounds[lo] : bounds[hi]] * U64(5)) % U64(width)).astype(np.int64)] = True
        self.bits = np.packbits(member, axis=1).view(U64)
        self.percent = percent

    def alike(self, i: int, which: np.ndarray) -> np.ndarray:
        """Which of these sets the bitmaps don't rule out for set i."""
        both = self.sizes[which] + self.sizes[i]
        most = both - 2 * -(-self.percent * both // (100 + self.percent))
        return np.bitwise_count(self.bits[which] ^ self.bits[i]).sum(1) <= most

    def candidates(self, i: int, others: np.ndarray) -> np.ndarray:
        """Positions in ``others`` of the sets that may link with set i."""
        i -= self.lo
        spans = []
        for mine, theirs in ((0, 1), (1, 0)):
            tokens, bounds = self.tokens[mine]
            own = tokens[bounds[i] : bounds[i + 1]]
            start = self.begin[theirs][own]
            spans.append((mine, theirs, start, self.begin[theirs][own + 1] - start))
        if sum(int(n.sum()) for _, _, _, n in spans) > len(others):  # the bitmaps alone are quicker
            return np.flatnonzero(self.alike(i, others - self.lo))
        found = []
        for mine, theirs, start, n in spans:
            who = self.who[theirs][np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)]
            found.append(who[self.sizes[who] <= self.sizes[i]] if mine == 0 else who[self.sizes[who] >= self.sizes[i]])
        self.place[others - self.lo] = np.arange(len(others))
        hit = np.unique(self.place[np.concatenate(found)])
        self.place[others - self.lo] = -1
        hit = hit[hit >= 0]
        return hit[self.alike(i, others[hit] - self.lo)]


#: Comparisons a set of a group may fail on average before rare shingles choose them.
TRIES = 8


def _linker(sets: np.ndarray, sizes: np.ndarray, groups, percent: int):
    """``near`` for ``_stars``: members are compared directly as long as most
    comparisons link; a group where they don't gets an index of rare shingles."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    starts = np.array([lo for lo, _ in groups])
    failed, index = [0], [-1, None]

    def near(i: int, others: np.ndarray) -> np.ndarray:
        g = int(np.searchsorted(starts, i, "right")) - 1
        if index[0] != g:
            index[:], failed[0] = [g, None], 0
        lo, hi = groups[g]
        if index[1] is None and failed[0] > TRIES * (hi - lo):
            index[1] = _Rare(sets, bounds, lo, hi, percent)
        at = np.arange(len(others)) if index[1] is None else index[1].candidates(i, others)
        out = np.zeros(len(others), bool)
        if len(at):
            out[at] = _linked(i, others[at], sets, bounds, sizes, percent)
            failed[0] += len(at) - int(out.sum())
        return out

    return near


def _confirm(percent: int):
    def run(batches):
        for t in textbuf.whole_groups(batches, "task"):
            parts = [shingle_sets(b.column("text")) for b in textbuf.slices(t.to_batches(), "text")]
            sets, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            groups = textbuf.group_bounds(t.column("task").to_numpy())
            yield _stars(t.column("id").to_numpy(), groups, _linker(sets, sizes, groups, percent))

    return run


def _task_edges(rows: DataFrame, tasks: DataFrame, percent: int) -> DataFrame:
    """(a, b): the links inside each task, as stars; ``tasks``: id, text_key, tasks (array)."""
    # A merge join at every size: the plan doesn't hang on a side that happens to be small.
    texts = rows.join(tasks.hint("merge"), "text_key").select(F.explode("tasks").alias("task"), "id", "text")
    return texts.repartition("task").sortWithinPartitions("task").mapInArrow(_confirm(percent), "a long, b long")


def _share(n, shingles):
    """How many times a task's bounds that many classes and shingles are."""
    return F.greatest(n / BLOCK, shingles / BLOCK_SHINGLES)


def confirmed_edges(rows: DataFrame, clumps: DataFrame, percent: int, root: str) -> DataFrame:
    """(a, b): stars whose components are those of all links inside the clumps.

    ``rows``: text_key, text.  ``clumps``: id, component, n_shingles, text_key.  A clump that fits a task is one
    task.  A larger one is cut into blocks of half that.  First each block
    meets the clump's representatives.  Pairs inside the largest component
    found can't join anything more; every other pair of the clump has a member
    outside it, and those members (``rest``) meet all blocks.
    """
    sizes = clumps.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    share = _share(F.col("n"), F.col("s"))
    cut = clumps.join(sizes, "component").withColumn("blocks", F.when(share <= 1, 1).otherwise(F.ceil(2 * share)).cast("int"))
    placed = scratch.stored(cut.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), f"{root}/placed")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    stands = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks") * PER_REPRESENTATIVE) == 0)
    met = F.transform(F.when(stands, every).otherwise(F.array("own")), lambda j: F.xxhash64("component", j))
    first = scratch.stored(_task_edges(rows, placed.select("id", "text_key", met.alias("tasks")), percent), f"{root}/links0")
    large = placed.filter("blocks > 1")
    if large.isEmpty():
        return first
    named = large.join(components(first).select("id", F.col("component").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
    main = named.groupBy("component", "label").agg(F.count("*").alias("size")).groupBy("component").agg(F.max(F.struct("size", "label")).alias("main"))
    marked = scratch.stored(named.join(main, "component").withColumn("rest", F.col("label") != F.col("main.label")).select("id", "text_key", "component", "n_shingles", "blocks", "own", "rest"), f"{root}/marked")
    rest = marked.filter("rest").groupBy("component").agg(F.ceil(2 * _share(F.count("*"), F.sum("n_shingles"))).cast("int").alias("rest_blocks"))
    both = marked.join(rest, "component")
    as_any = F.transform(F.sequence(F.lit(0), F.col("rest_blocks") - 1), lambda i: F.xxhash64("component", i, "own"))
    rest_own = F.pmod(F.xxhash64("id", F.lit(2)), F.col("rest_blocks")).cast("int")
    as_rest = F.when(F.col("rest"), F.transform(every, lambda j: F.xxhash64("component", "rest_own", j))).otherwise(F.array().cast("array<bigint>"))
    tasks = both.withColumn("rest_own", rest_own).select("id", "text_key", F.array_distinct(F.concat(as_any, as_rest)).alias("tasks"))
    return first.union(_task_edges(rows, tasks, percent))


def _row_key(text_col: str):
    return F.xxhash64(F.col(text_col).cast("string"))


def _judged(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row_key, n_shingles, component_id, kept) of every row."""
    root = scratch.root(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _row_key(text_col).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    features = scratch.stored(rows.mapInArrow(_features, "doc_id long, row_key long, n_shingles long, fp1 long, fp2 long, signature binary"), f"{root}/features")
    usable = features.filter("doc_id is not null and n_shingles > 0")
    classes = scratch.stored(usable.groupBy("n_shingles", "fp1", "fp2").agg(F.min(F.struct("doc_id", "row_key")).alias("first"), F.first("signature").alias("signature")), f"{root}/classes")
    classes = scratch.stored(_with_ids(classes), f"{root}/named")
    clumps = components(likely_edges(classes.select("id", "signature"), percent, root)).join(classes.select("id", "n_shingles", "text_key"), "id")
    links = scratch.stored(components(confirmed_edges(rows.filter("doc_id is not null").select(_text_key("doc_id", "row_key").alias("text_key"), "text"), clumps, percent, root)), f"{root}/links")
    named = classes.join(links, "id", "left").select("n_shingles", "fp1", "fp2", "own", "second", F.coalesce("component", "id").alias("component"))
    # only where a second class of some id takes part is a component's id not its least doc_id
    marked = named.filter("second").select("component").distinct()
    renamed = scratch.stored(named.join(marked, "component", "left_semi").groupBy("component").agg(F.min("own").alias("least")), f"{root}/renamed")
    named = named.join(renamed, "component", "left").select("n_shingles", "fp1", "fp2", F.coalesce("least", "component").alias("class_component"))
    out = features.drop("signature").join(named, ["n_shingles", "fp1", "fp2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    out = out.withColumn("component_id", component)
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))).select("doc_id", "row_key", "n_shingles", "component_id", "kept")


def _text_key(doc_id, row_key):
    return F.xxhash64(doc_id, row_key)


def _with_ids(classes: DataFrame) -> DataFrame:
    """Classes with ``id``: the least doc_id, but for second classes of one
    doc_id (it has several texts) a number above all."""
    main = classes.groupBy("first.doc_id").agg(F.min("first.row_key").alias("main")).withColumnRenamed("doc_id", "own")
    both = classes.withColumn("own", F.col("first.doc_id")).join(main, "own").withColumn("second", F.col("first.row_key") != F.col("main"))
    above = F.lit(1 << 62) + F.xxhash64("own", "first.row_key").bitwiseAND(F.lit((1 << 61) - 1))
    return both.select(F.when(F.col("second"), above).otherwise(F.col("own")).alias("id"), "own", "second", _text_key("own", "first.row_key").alias("text_key"), "n_shingles", "fp1", "fp2", "signature")


def near_dedup(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents link if their sets' similarity is ``percent`` % or more; a
    component is named by its least doc_id, whose document is kept.  A null,
    empty or wordless text has an empty set and links with nothing.  Rows that
    repeat an id are documents of their own: each is judged by its own text,
    so one may stay where another goes, and rows equal in id and text are
    judged alike.  A row without an id stays alone, is kept and has no
    component_id.  Texts of any length are read whole.  An empty table gives
    an empty result; other columns are ignored.
    """
    return _judged(docs, percent, id_col, text_col).drop("row_key")


def without_near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_dedup`` keeps, with all their columns.

    Of rows equal in id and text all stay or none; null and empty texts stay,
    as do rows without an id.  Columns of any name are handed on.
    """
    gone_id, gone_key = scratch.fresh(docs, "gone_id", "gone_key")
    gone = _judged(docs, percent, id_col, text_col).filter("not kept").select(F.col("doc_id").alias(gone_id), F.col("row_key").alias(gone_key)).distinct()
    gone = scratch.stored(gone, scratch.root(docs.sparkSession) + "/gone")
    return docs.join(gone.hint("merge"), (F.col(id_col).cast("long") == F.col(gone_id)) & (_row_key(text_col) == F.col(gone_key)), "left_anti")
