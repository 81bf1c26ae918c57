"""Repair of the role structure of conversations by the cheapest edits.

A conversation must read ``(s?(ua)+)?`` in the initials of its roles.  An
automaton of four states says what may follow; the cheapest edits are a
shortest path through rows and states, found by dynamic programming from the
end (a Viterbi pass of costs to go) and traced from the start, at each point by
the least letter among the cheapest.

A conversation may hold a third of all rows, so the pass runs in parallel:

* Rows are range-partitioned by conversation and turn and numbered in order;
  a chunk is a conversation's rows within a block of ``BLOCK`` numbers.
* Every chunk runs back from a speculative cost vector at its end.  A fix-up
  pass hands each chunk the vector its right neighbour arrived at; the chunk
  reruns beside its former run and stops where both differ by a constant only,
  as from there on they choose alike.  Passes end when no chunk's vector
  changed by more than a constant.  Chunks of rows that must all go hand vectors
  through unchanged and are skipped.  What has not converged after
  ``PASSES`` (rows that fit no role can swing for ever) is settled exactly, by
  each chunk's costs from every state to every state.
* The stitched vectors drive the tracing of each chunk from every state that
  may enter it; one ordered pass strings the chunks' edits together.

The last pass holds a digest of one conversation's text, which is a serial sum:
a conversation streams through one task in order, in constant memory but for
its audit.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantpulse.llm import scratch

#: Rows of a chunk at most, as a power of two.
BLOCK_BITS = 10
#: Fix-up passes before what is left is settled by cost matrices.
PASSES = 10
SPACES = " \t\n\x0b\x0c\r"

# states: start, after system, after user, after assistant
START, S, U, A = range(4)
#: The state after an inserted or re-roled row, and the role it gets.
NEXT = np.array([U, U, A, U])
ROLE = {U: "user", A: "assistant"}
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
FAR = 1 << 28
#: Faults of a row; a row's code is its role's class (s, u, a, other) + 4 * fault.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
CLASSES = "sua"
LETTERS = np.frombuffer(b"DIKR", np.uint8)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Costs of keeping, where keeping leads, costs of re-roling, whole steps
    with insertions before the row, and the costs to go at the very end."""
    keep, to, role = np.full((16, 4), FAR), np.zeros((16, 4), np.int64), np.full(16, FAR)
    insert = np.full((4, 4), FAR)
    for s in range(4):
        at, paid = s, 0
        for _ in range(3):
            insert[s, at] = min(insert[s, at], paid)
            at, paid = NEXT[at], paid + INSERT
    steps = np.full((16, 4, 4), FAR)
    for code in range(16):
        kind, fault = code % 4, code // 4
        extra = CUT if fault == TRUNCATED else 0
        may = fault in (SOUND, TRUNCATED)
        for s in range(4):
            steps[code, s, s] = DELETE
            if may:
                role[code] = REROLE + extra
                steps[code, s, NEXT[s]] = min(steps[code, s, NEXT[s]], REROLE + extra)
                target = S if kind == 0 and s == START else U if kind == 1 and s != U else A if kind == 2 and s == U else None
                if target is not None:
                    keep[code, s], to[code, s] = KEEP + extra, target
                    steps[code, s, target] = min(steps[code, s, target], KEEP + extra)
    whole = np.minimum((insert[None, :, :, None] + steps[:, None, :, :]).min(2), FAR)
    last = np.minimum(insert[:, START], insert[:, A])
    return keep, to, role, whole, last


KEEP_COST, KEEP_TO, ROLE_COST, STEP, END = _tables()


def pack(vectors: np.ndarray) -> np.ndarray:
    """Cost vectors as numbers that are equal if they differ by a constant only."""
    v = vectors - vectors.min(1, keepdims=True)
    return v[:, 0] + (v[:, 1] << 8) + (v[:, 2] << 16) + (v[:, 3] << 24)


def unpack(packed) -> np.ndarray:
    p = np.asarray(packed, np.int64)
    return np.stack([p & 255, p >> 8 & 255, p >> 16 & 255, p >> 24 & 255], 1)


LAST = int(pack(END[None])[0])


class Lanes:
    """Chunks side by side, longest first, so that those alive are the first."""

    def __init__(self, codes: list[bytes]):
        size = np.array([len(c) for c in codes], np.int64)
        self.order = np.argsort(-size, kind="stable")
        self.size = size[self.order]
        self.codes = np.zeros((len(codes), int(self.size[0]) if len(size) else 0), np.uint8)
        for i, o in enumerate(self.order):
            self.codes[i, : self.size[i]] = np.frombuffer(codes[o], np.uint8)

    def alive(self, t: int) -> int:
        return int(np.searchsorted(-self.size, -t, "left"))

    def back(self, ends: np.ndarray) -> np.ndarray:
        """Costs to go before every row, in [lane, row, state]; ``ends`` by lane."""
        n, width = self.codes.shape
        out = np.zeros((n, width + 1, 4), np.int64)
        out[np.arange(n), self.size] = ends
        for t in range(width - 1, -1, -1):
            a = self.alive(t)
            out[:a, t] = (STEP[self.codes[:a, t]] + out[:a, t + 1, None, :]).min(2)
        return out

    def starts(self, ends: np.ndarray) -> np.ndarray:
        """Costs to go before each lane's first row."""
        now = ends.copy()
        for t in range(self.codes.shape[1] - 1, -1, -1):
            a = self.alive(t)
            now[:a] = (STEP[self.codes[:a, t]] + now[:a, None, :]).min(2)
        return now

    def fix(self, used: np.ndarray, out: np.ndarray, needed: np.ndarray) -> tuple[np.ndarray, int]:
        """(vectors before the first rows from ``needed`` ends, steps made).

        A lane runs beside its former run from ``used`` and stops where they
        differ by a constant; its former vector ``out`` holds then.
        """
        old, new = used.copy(), needed.copy()
        open_ = np.ones(len(out), bool)
        made = 0
        for t in range(self.codes.shape[1] - 1, -1, -1):
            go = np.flatnonzero(open_[: self.alive(t)])
            if len(go) == 0:
                continue
            step = STEP[self.codes[go, t]]
            old[go] = (step + old[go, None, :]).min(2)
            new[go] = (step + new[go, None, :]).min(2)
            made += len(go)
            gap = new[go] - old[go]
            open_[go[(gap == gap[:, :1]).all(1)]] = False
        return np.where(open_[:, None], new, out), made

    def trace(self, ends: np.ndarray) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
        """Edits, leaving states and costs from each of the four entering states."""
        costs = self.back(ends)
        n, width = self.codes.shape
        lane, s, i = np.repeat(np.arange(n), 4), np.tile(np.arange(4), n), np.zeros(4 * n, np.int64)
        paid = costs[:, 0].reshape(-1).copy()
        letters, at = np.zeros((4 * n, 3 * width + 4), np.uint8), np.zeros(4 * n, np.int64)
        live = np.flatnonzero(i < self.size[lane])
        while len(live):
            own, row, state = lane[live], i[live], s[live]
            here, after, code, k = costs[own, row], costs[own, row + 1], self.codes[own, row], np.arange(len(live))
            kept = KEEP_TO[code, state]
            ways = np.stack([DELETE + after[k, state], INSERT + here[k, NEXT[state]], KEEP_COST[code, state] + after[k, kept], ROLE_COST[code] + after[k, NEXT[state]]])
            pick = (ways == here[k, state]).argmax(0)
            letters[live, at[live]] = LETTERS[pick]
            at[live] += 1
            s[live] = np.choose(pick, [state, NEXT[state], kept, NEXT[state]])
            i[live] += pick != 1
            live = live[i[live] < self.size[own]]
        paid -= np.repeat(ends, 4, 0)[np.arange(4 * n), s]
        edits = [letters[j, : at[j]].tobytes() for j in range(4 * n)]
        return [edits[4 * j : 4 * j + 4] for j in range(n)], s.reshape(n, 4), paid.reshape(n, 4)


#: Cells of a batch of lanes at most, where no single lane is longer.
CELLS = 1 << 20


def _batches(batches):
    """Tables of chunks that fit ``CELLS``, sorted by length."""
    for b in batches:
        t = pa.Table.from_batches([b])
        if t.num_rows == 0:
            continue
        size = np.array([len(c) for c in t.column("codes").to_pylist()])
        t = t.take(pa.array(np.argsort(size, kind="stable")))
        size.sort()
        lo = 0
        while lo < t.num_rows:
            hi = lo + 1
            while hi < t.num_rows and (hi + 1 - lo) * int(size[hi]) <= CELLS:
                hi += 1
            yield t.slice(lo, hi - lo)
            lo = hi


def _in_order(lanes: Lanes, values: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[lanes.order] = values
    return out


def damage(conversations: DataFrame) -> DataFrame:
    """Rows spoilt by the checksum of ``conv_id:turn`` (null: one space) modulo
    20: 0 drops the row, 1 empties its text, 2 takes out its sentence ends, 3
    repeats it, 4 makes it the user's."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"), fate.alias("fate")).filter("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumns({"text": text, "role": role, "copy": F.explode(times)}).select("conv_id", "turn", "role", "text")


def ordered(conversations: DataFrame, path: str) -> DataFrame:
    """A stored table of the rows with ``place``, their number in order, and
    what repair needs of them: ``cid``, ``block``, ``code`` and ``key``."""
    left = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(left == "", BLANK).when(~F.right(left, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    kind = F.instr(F.lit(CLASSES), F.left("role", F.lit(1)))
    kind = F.when((F.col("role") == "") | (kind == 0), 3).otherwise(kind - 1)
    blank_role, blank_text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank_role.alias("role"), blank_text.alias("text"))
    rows = rows.withColumns({"code": (kind + 4 * fault).cast("int"), "key": F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))})
    rows = rows.withColumns({"head": F.substring("text", 1, 64), "salt": F.monotonically_increasing_id()})
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), *map(F.col, ("role", "head", "key", "salt"))]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    cid = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    return scratch.stored(placed.select(cid.alias("cid"), "turn", "role", "text", "code", "key", "place"), path).withColumn("block", F.shiftright("place", BLOCK_BITS))


CHUNK = "cid string, block long, codes binary, turns int, first_turn long, last_turn long"


def _chunks(batches):
    """Chunks from lists of their rows, with repeats within a chunk marked."""
    for b in batches:
        if b.num_rows == 0:
            continue
        rows = b.column("rows")
        offs = rows.offsets.to_numpy()
        items = rows.values
        code = items.field("code").to_numpy(zero_copy_only=False).astype(np.uint8)
        keys, turns = items.field("key").to_pylist(), items.field("turn").to_pylist()
        out = []
        for lo, hi in zip(offs[:-1], offs[1:]):
            seen, codes = set(), code[lo:hi].copy()
            for j in range(lo, hi):
                if codes[j - lo] // 4 == BLANK:
                    continue
                if keys[j] in seen:
                    codes[j - lo] = codes[j - lo] % 4 + 4 * DUPLICATE
                seen.add(keys[j])
            known = [t for t in turns[lo:hi] if t is not None]
            out.append((codes.tobytes(), len(set(known)), known[0] if known else None, known[-1] if known else None))
        codes, n, first, last = zip(*out)
        yield pa.record_batch([b.column("cid"), b.column("block"), pa.array(codes, pa.binary()), pa.array(n, pa.int32()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["cid", "block", "codes", "turns", "first_turn", "last_turn"])


def chunked(rows: DataFrame) -> DataFrame:
    """A row a chunk; a chunk has no more rows than a block."""
    lists = rows.groupBy("cid", "block").agg(F.sort_array(F.collect_list(F.struct("place", "code", "key", "turn"))).alias("rows"))
    return lists.mapInArrow(_chunks, CHUNK)


def _marked(batches):
    for b in batches:
        codes = []
        for c, late in zip(b.column("codes").to_pylist(), b.column("late").to_pylist()):
            if late:
                c = np.frombuffer(c, np.uint8).copy()
                c[late] = c[late] % 4 + 4 * DUPLICATE
                c = c.tobytes()
            codes.append(c)
        yield pa.record_batch([pa.array(codes, pa.binary()) if n == "codes" else b.column(n) for n in b.schema.names if n != "late"], [n for n in b.schema.names if n != "late"])


def mark_repeats(chunks: DataFrame, rows: DataFrame, split: DataFrame) -> DataFrame:
    """Chunks with the repeats of rows of earlier chunks marked.

    ``split`` has the conversations of several chunks.  Equal rows are combined
    in their chunk first, so a row that a conversation repeats for ever costs one
    row a chunk.
    """
    worded = rows.filter(F.floor(F.col("code") / 4) != BLANK).join(split.select("cid"), "cid", "left_semi")
    once = worded.groupBy("cid", "block", "key").agg(F.min("place").alias("place"))
    earliest = once.groupBy("cid", "key").agg(F.min("place").alias("first"))
    late = once.join(earliest, ["cid", "key"]).filter("place > first")
    # a chunk's rows are numbered from its least place
    begin = rows.join(split.select("cid"), "cid", "left_semi").groupBy("cid", "block").agg(F.min("place").alias("begin"))
    lists = late.join(begin, ["cid", "block"]).groupBy("cid", "block").agg(F.collect_list((F.col("place") - F.col("begin")).cast("int")).alias("late"))
    return chunks.join(lists, ["cid", "block"], "left").mapInArrow(_marked, CHUNK)


def _speculate(batches):
    for t in _batches(batches):
        codes = t.column("codes").to_pylist()
        lanes = Lanes(codes)
        out = _in_order(lanes, pack(lanes.starts(np.tile(END, (len(codes), 1)))))
        solid = [bool((np.frombuffer(c, np.uint8) // 4 % 3 == 0).any()) for c in codes]
        yield from pa.table([t.column("cid"), t.column("block"), pa.array(np.full(len(codes), LAST)), pa.array(out), pa.array(solid)], ["cid", "block", "used", "out", "solid"]).combine_chunks().to_batches()


def _fix(batches):
    for t in _batches(batches):
        lanes = Lanes(t.column("codes").to_pylist())
        used, out, needed = (unpack(t.column(c).to_numpy())[lanes.order] for c in ("used", "out", "needed"))
        fixed, _ = lanes.fix(used, out, needed)
        yield from pa.table([t.column("cid"), t.column("block"), t.column("needed"), pa.array(_in_order(lanes, pack(fixed))), t.column("solid")], ["cid", "block", "used", "out", "solid"]).combine_chunks().to_batches()


def _matrices(batches):
    for t in _batches(batches):
        lanes = Lanes(t.column("codes").to_pylist())
        unit = np.full((4, 4), FAR // 2)
        np.fill_diagonal(unit, 0)
        columns = [_in_order(lanes, lanes.starts(np.tile(unit[s], (t.num_rows, 1)))) for s in range(4)]
        flat = np.stack(columns, 2).reshape(t.num_rows, 16)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(flat.reshape(-1)), 16).cast(pa.list_(pa.int64()))
        yield from pa.table([t.column("cid"), t.column("block"), lists], ["cid", "block", "costs"]).combine_chunks().to_batches()


def _compose(batches):
    """Vectors at the chunks' ends from their matrices, sorted from the last."""
    cid = now = None
    for b in batches:
        used = []
        for c, costs in zip(b.column("cid").to_pylist(), b.column("costs").to_pylist()):
            if c != cid:
                cid, now = c, END
            used.append(int(pack(now[None])[0]))
            now = (np.array(costs).reshape(4, 4) + now).min(1)
            now = now - now.min()
        yield pa.record_batch([b.column("cid"), b.column("block"), pa.array(used, pa.int64())], ["cid", "block", "used"])


STATE = "cid string, block long, used long, out long, solid boolean"


def end_vectors(chunks: DataFrame, path: str, passes: int = PASSES) -> DataFrame:
    """(cid, block, used): the cost vector at every chunk's end, by fix-up passes."""
    state = chunks.mapInArrow(_speculate, STATE)
    later = W.partitionBy("cid").orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    for i in range(passes + 1):
        needed = F.coalesce(F.last(F.when(F.col("solid"), F.col("out")), ignorenulls=True).over(later), F.lit(LAST))
        state = scratch.stored(state.withColumn("needed", needed), f"{path}/pass{i}")
        changed = state.filter("needed <> used")
        if changed.isEmpty():
            return state.select("cid", "block", "used")
        if i < passes:
            redone = changed.join(chunks.select("cid", "block", "codes"), ["cid", "block"]).mapInArrow(_fix, STATE)
            state = state.filter("needed = used").drop("needed").unionByName(redone)
    # whole conversations, so that every vector comes from the very end
    left = chunks.join(changed.select("cid").distinct(), "cid", "left_semi")
    exact = left.mapInArrow(_matrices, "cid string, block long, costs array<long>").repartition("cid").sortWithinPartitions("cid", F.col("block").desc()).mapInArrow(_compose, "cid string, block long, used long")
    return state.join(changed.select("cid").distinct(), "cid", "left_anti").select("cid", "block", "used").unionByName(exact)


TRACED = "edits array<string>, leaves array<int>, costs array<long>, blank long, duplicate long, truncated long, illegal long, first_class int, last_class int, turns int, first_turn long, last_turn long"


def _trace(batches):
    for t in _batches(batches):
        codes = t.column("codes").to_pylist()
        lanes = Lanes(codes)
        edits, leaves, costs = lanes.trace(unpack(t.column("used").to_numpy())[lanes.order])
        rows = [None] * len(codes)
        for j, o in enumerate(lanes.order):
            c = np.frombuffer(codes[o], np.uint8)
            fault, kind = np.bincount(c // 4, minlength=4), (c % 4).astype(np.int64)
            legal = np.isin(4 * kind[:-1] + kind[1:], (1, 6, 9))  # su, ua, au
            rows[o] = [[e.decode() for e in edits[j]], leaves[j].tolist(), costs[j].tolist(), int(fault[BLANK]), int(fault[DUPLICATE]), int(fault[TRUNCATED]), int((~legal).sum()), int(kind[0]), int(kind[-1])]
        kinds = [pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.int64()] * 4, pa.int32(), pa.int32()]
        names = ["edits", "leaves", "costs", "blank", "duplicate", "truncated", "illegal", "first_class", "last_class"]
        made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield from pa.table([t.column("cid"), t.column("block"), *made, *[t.column(n) for n in ("turns", "first_turn", "last_turn")]], ["cid", "block", *names, "turns", "first_turn", "last_turn"]).combine_chunks().to_batches()


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
REPAIRED = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
TURNS = "conv_id long, number long, role string, text string, edit string"


class _Conversation:
    """What is known of the conversation that streams by."""

    def __init__(self, cid: str):
        self.cid, self.state, self.n = cid, START, 0
        self.counts = dict.fromkeys(COUNTS, 0)
        self.audit: list[str] = []
        self.digest = hashlib.sha256()
        self.turns, self.first, self.last, self.klass = 0, None, None, None
        self.letters, self.at, self.walk = "", 0, START

    def chunk(self, c: dict) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            self.counts[name] += c[name]
        if self.klass is not None and 4 * self.klass + c["first_class"] not in (1, 6, 9):
            self.counts["illegal"] += 1
        self.klass = c["last_class"]
        if c["turns"]:
            self.turns += c["turns"] - (self.last == c["first_turn"])
            self.first = c["first_turn"] if self.first is None else self.first
            self.last = c["last_turn"]
        self.letters, self.at, self.walk = c["edits"][self.state], 0, self.state
        self.audit.append(self.letters)
        self.counts["cost"] += c["costs"][self.state]
        self.state = c["leaves"][self.state]

    def put(self, role: str, text: str, edit: str) -> tuple:
        self.digest.update((b"\n" if self.n else b"") + f"{role}:{text}".encode())
        self.n += 1
        return self.cid, self.n - 1, role, text, edit

    def row(self, role: str, text: str) -> list[tuple]:
        """The rows that stand where this one stood."""
        out = []
        while True:
            letter, self.at = self.letters[self.at], self.at + 1
            if letter in "IR":
                self.walk = int(NEXT[self.walk])
                out.append(self.put(ROLE[self.walk], "" if letter == "I" else text, letter))
            elif letter == "K":
                self.walk = {"s": S, "u": U, "a": A}[role[0]]
                out.append(self.put(role, text, letter))
            if letter != "I":
                return out

    def close(self) -> list[tuple]:
        out = []
        while self.state not in (START, A):
            self.state = int(NEXT[self.state])
            self.audit.append("I")
            self.counts["cost"] += INSERT
            out.append(self.put(ROLE[self.state], "", "I"))
        if self.turns:
            self.counts["gaps"] = self.last - self.first + 1 - self.turns
        return out

    def result(self) -> tuple:
        return int(self.cid) if self.cid else None, *self.counts.values(), "".join(self.audit), self.digest.hexdigest()


def _assemble(whole: bool):
    """Conversations from rows sorted by conversation, block and place: a row
    before all chunks, and before each chunk's texts the chunk's edits."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()] if whole else [pa.int64(), *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
    names = [c.split()[0] for c in (TURNS if whole else REPAIRED).split(", ")]

    def batch(out):
        columns = list(zip(*out)) or [[] for _ in names]
        if whole and out:
            columns[0] = [int(c) if c else None for c in columns[0]]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, types)], names)

    def run(batches):
        now = None
        for b in batches:
            out = []
            cols = [b.column(c).to_pylist() for c in ("cid", "place", "role", "text", "chunk")]
            for cid, place, role, text, chunk in zip(*cols):
                if now is None or cid != now.cid:
                    if now:
                        rows = now.close()
                        out += rows if whole else [now.result()]
                    now = _Conversation(cid)
                if chunk is not None:
                    now.chunk(chunk)
                elif place >= 0:
                    rows = now.row(role, text)
                    out += rows if whole else []
            yield batch(out)
        if now:
            rows = now.close()
            yield batch(rows if whole else [now.result()])

    return run


def _solve(conversations: DataFrame, ids: DataFrame | None, passes: int, whole: bool) -> DataFrame:
    path = scratch.root(conversations.sparkSession)
    rows = ordered(conversations, f"{path}/rows")
    chunks = scratch.stored(chunked(rows), f"{path}/chunks")
    split = scratch.stored(chunks.groupBy("cid").agg(F.count("*").alias("n")).filter("n > 1"), f"{path}/split")
    alone = chunks.join(split, "cid", "left_anti").withColumn("used", F.lit(LAST).cast("long"))
    if not split.isEmpty():
        several = scratch.stored(mark_repeats(chunks.join(split, "cid", "left_semi"), rows, split), f"{path}/several")
        alone = alone.unionByName(several.join(end_vectors(several, path, passes), ["cid", "block"]))
    traced = alone.mapInArrow(_trace, f"cid string, block long, {TRACED}")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    chunk = F.struct(*[c for c in traced.columns if c not in ("cid", "block")]).alias("chunk")
    summary = traced.select("cid", "block", F.lit(-1).cast("long").alias("place"), none("string", "role"), none("string", "text"), chunk)
    texts = rows.select("cid", "block", "place", "role", "text", none(f"struct<{TRACED}>", "chunk"))
    ids = (conversations if ids is None else ids).select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("cid")).distinct()
    marks = ids.select("cid", F.lit(-1).cast("long").alias("block"), F.lit(-1).cast("long").alias("place"), none("string", "role"), none("string", "text"), none(f"struct<{TRACED}>", "chunk"))
    sorted_ = marks.unionByName(summary).unionByName(texts).repartition("cid").sortWithinPartitions("cid", "block", "place")
    return sorted_.mapInArrow(_assemble(whole), TURNS if whole else REPAIRED)


def repair(conversations: DataFrame, ids: DataFrame | None = None, passes: int = PASSES) -> DataFrame:
    """One row a conversation: faults, cost, edits and a digest of what they give.

    ``conversations``: conv_id, turn, role, text; other columns are ignored.
    Rows go by turn, nulls first; equal turns by role, then the text's first 64
    characters, then a digest.  Null roles and texts are one space, rows without an id are one
    conversation.  A row's first fault counts: blank, a repeat of an earlier
    role and text, or not ending in a sentence's end.  Edits and their costs
    are the module's constants; of equally cheap ones the least in ASCII counts.
    ``ids`` names conversations to report even without rows (zeros, no edits).
    Texts of any length are read whole; an empty table gives an empty result.
    """
    return _solve(conversations, ids, passes, False)


def repaired_turns(conversations: DataFrame, passes: int = PASSES) -> DataFrame:
    """The repaired rows themselves, numbered in order, each with its edit
    (K, R or I).  Odd rows are as in ``repair``."""
    return _solve(conversations, None, passes, True)
