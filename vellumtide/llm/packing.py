"""Best-fit packing of token sequences by bin completion.

Only a document longer than a sequence is cut: full pieces at its end, the rest as its first piece. So every document gives at most one
piece that needs company, and what matters for packing is how many pieces there are of each length. That histogram has at most
`capacity` rows at any input size. Bin completion runs on it, in two ways that share one incumbent, at first that of best fit. Residuals: a few sequences with waste and a
few others are opened, and completed anew with the fullest set around each largest piece; the outcome replaces them where it takes fewer sequences or gathers the waste in fewer.
Branch and bound: around the largest open length it enumerates undominated fillings, applies the best one as often as the counts allow, and branches on the others, and on applying
one once only, while a bound on the waste leaves hope of fewer sequences than the incumbent. Both end at the lower bound, else after ROUNDS idle residuals and MAX_NODES nodes with STEPS
sets each, for the problem is NP-hard: the incumbent stands then. The outcome, a few thousand (pattern, times) rows, is what goes to the executors; pieces find
their slot by their rank among pieces of their length, counted in two levels, so no length gathers in one task.

Defined cases: null text counts as empty and gives one piece, the end token alone; an empty table gives no rows; rows with one
doc_id are packed as separate documents; further columns are ignored.
"""

from __future__ import annotations

import json
import random
import sys
import zlib
from collections import Counter, deque
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumtide.llm._kit import arrow_batches, materialize, table

CAPACITY = 1024
END_ID = 2
RANK_BUCKETS = 1024
#: Nodes of the branch-and-bound search beyond the first dive, and sets looked at by the enumeration of a node's fillings.
MAX_NODES, STEPS = 1_500, 200
#: Residuals completed in vain before that search ends, and sequences that it opens at most: with waste, and others.
ROUNDS, OPENED = 6_000, (16, 24)
#: How byte-level BPE of this kind splits text before merging (fixed value).
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_letters() -> dict[str, int]:
    """The letters that a byte-level vocabulary writes for bytes: printable ones stand for themselves, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids as little-endian uint32 bytes, as the tokenizers file at `path` defines them.

    A byte-level BPE whose merges are numbered in order is the same thing as a table of ranks, for which tiktoken needs a third of the time that tokenizers needs; both give the same
    ids. Any other file, and texts that spell a special token, are left to tokenizers."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.ranks = self._as_ranks(spec)

    @cached_property
    def tok(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _as_ranks(self, spec: dict):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") not in ("BPE", None) or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("dropout") or model.get("ignore_merges"):
            return None
        letters, vocab = _byte_letters(), model["vocab"]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [vocab.get(m) for m in merged]
        if None in ids or ids != sorted(ids) or any(c not in vocab for c in letters):
            return None
        import tiktoken

        ranks = {bytes(letters[c] for c in t): vocab[t] for t in [*letters, *merged]}
        return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.ranks is not None and not any(s in text for s in self.special):
            try:
                return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4")
            except ValueError:  # the pattern engine gives up on very long runs of spaces
                pass
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")


def encoder(path: str) -> Encoder:
    """One a process, for tasks that share a Python worker. It hangs on `sys`, as functions travel to executors by value, with globals of their own."""
    held = sys.__dict__.setdefault("_vellumtide_encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces; nothing longer than capacity."""

    def run(it):
        enc, end = encoder(tokenizer), np.array([end_id], "<u4")
        for batch, data, offs in arrow_batches(it):
            raw, row, size, crc = data.tobytes(), [], [], []
            for i in range(len(offs) - 1):
                ids = np.append(enc.ids(raw[offs[i] : offs[i + 1]].decode()), end)
                n = len(ids)
                at, step = 0, n % capacity or capacity
                while at < n:
                    row.append(i)
                    size.append((at, step))
                    crc.append(zlib.crc32(ids[at : at + step].tobytes()))
                    at, step = at + step, capacity
            row, size = np.array(row, np.int64), np.array(size, np.int64).reshape(-1, 2)
            piece = np.arange(len(row)) - np.searchsorted(row, row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(size[:, 0]), pa.array(size[:, 1]), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """Martello and Toth's L2 over a histogram of lengths."""
    sizes = np.arange(len(count))
    total = int((count * sizes).sum())
    best = -(-total // capacity)
    number, mass = np.cumsum(count), np.cumsum(count * sizes)
    for low in range(capacity // 2 + 1):
        big = int(number[capacity] - number[capacity - low])
        half = int(number[capacity - low] - number[capacity // 2])
        half_mass = int(mass[capacity - low] - mass[capacity // 2])
        small_mass = int(mass[capacity // 2] - (mass[low - 1] if low else 0))
        best = max(best, big + half + max(0, -(-(small_mass - (half * capacity - half_mass)) // capacity)))
    return best


def _below(count: np.ndarray) -> np.ndarray:
    """The largest length with pieces left that is at most x, for each x; 0 if none."""
    return np.maximum.accumulate(np.where(count > 0, np.arange(len(count)), 0))


def _dominated(a: tuple, b: tuple) -> bool:
    """Whether filling a's pieces can stand in groups inside the pieces of b."""
    if a == b:
        return True

    def fit(items, rooms):
        if not items:
            return True
        x, rest, seen = items[0], items[1:], set()
        for i, r in enumerate(rooms):
            if r >= x and r not in seen:
                seen.add(r)
                if fit(rest, rooms[:i] + (r - x,) + rooms[i + 1 :]):
                    return True
        return False

    return len(a) <= 8 and fit(a, b)


def fillings(count: np.ndarray, below: np.ndarray, room: int, spare: int, steps: int = STEPS) -> list[tuple]:
    """Undominated sets of lengths that fit in room beside the largest piece and leave at most `spare` of it, least waste first, then fewest pieces.

    Every length is taken or skipped, sets of few pieces first; the last piece of a set is the largest that fits, for any other is dominated by it. What sums up to
    no more than the largest single piece is dominated by that. After `steps` sets the enumeration ends with what it has found."""
    alone = int(below[room])
    if not alone:
        return [()]
    found = [(alone,)]
    if alone < room:
        number, upto, low = count.tolist(), below.tolist(), max(alone + 1, room - spare)
        least, todo = int(np.flatnonzero(count)[0]), steps

        def walk(got: tuple, left: int, top: int, k: int, need: int) -> None:
            nonlocal todo
            todo -= 1
            x = upto[min(top, left - least * (k - 1))] if left >= least * k else 0
            while x and x * k >= need and todo > 0:
                if got.count(x) < number[x]:
                    if k > 1:
                        walk((*got, x), left - x, x, k - 1, need - x)
                    else:
                        found.append((*got, x))
                        return
                x = upto[x - 1]

        for k in range(2, room // least + 1):
            if todo <= 0:
                break
            walk((), room, alone, k, low)
    kept: list[tuple] = []
    for f in sorted(found, key=lambda f: (-sum(f), len(f), [-x for x in f])):
        if not any(_dominated(f, k) for k in kept):
            kept.append(f)
    return kept


def _apply(count: np.ndarray, big: int, filling: tuple) -> tuple[int, Counter]:
    """Takes the pattern as often as the counts allow; how often."""
    used = Counter(filling)
    used[big] += 1
    times = min(int(count[s]) // c for s, c in used.items())
    for s, c in used.items():
        count[s] -= times * c
    return times, used


def best_fit(count: np.ndarray, capacity: int) -> tuple[int, list]:
    """The incumbent: each largest piece with the best-fitting further pieces."""
    count, plan, bins = count.copy(), [], 0
    while (big := int(_below(count)[-1])) > 0:
        below, got, left, used = _below(count), [], capacity - big, Counter([big])
        x = int(below[left])
        while x:
            if count[x] > used[x]:
                got.append(x)
                used[x] += 1
                left -= x
                x = int(below[min(left, x)])
            else:
                x = int(below[x - 1])
        times, used = _apply(count, big, tuple(got))
        plan.append((times, used))
        bins += times
    return bins, plan


class _Pool:
    """Distinct patterns, any of which can be drawn or dropped in constant time."""

    def __init__(self):
        self.items, self.at = [], {}

    def add(self, x: tuple) -> None:
        if x not in self.at:
            self.at[x] = len(self.items)
            self.items.append(x)

    def drop(self, x: tuple) -> None:
        if x in self.at:
            i, last = self.at.pop(x), self.items.pop()
            if i < len(self.items):
                self.items[i] = last
                self.at[last] = i


def fullest(items: list[int], room: int) -> list[int]:
    """Places of items that fill most of room together (the first such set in their order), by a bit set of reachable sums."""
    full, sums, seen, tried = (2 << room) - 1, 1, [], []
    for i, x in enumerate(items):
        if x <= room:
            more = sums | (sums << x) & full
            if more != sums:
                seen.append(sums)
                tried.append(i)
                sums = more
                if sums >> room:
                    break
    left, got = sums.bit_length() - 1, []
    for before, i in zip(reversed(seen), reversed(tried)):
        if left and not (before >> left) & 1:
            got.append(i)
            left -= items[i]
    return got


def _completed(items: list[int], capacity: int, rng: random.Random) -> list[tuple]:
    """Sequences of the items: the largest one left with the fullest set beside it, again and again."""
    rng.shuffle(items)
    out = []
    while items:
        big = max(items)
        items.remove(big)
        got = fullest(items, capacity - big)  # last places first
        out.append((big, *sorted([items.pop(i) for i in got], reverse=True)))
    return out


def residuals(plan: list[tuple[int, Counter]], capacity: int, goal: int, rounds: int = ROUNDS) -> list[tuple[int, Counter]]:
    """plan, improved until it has `goal` sequences or `rounds` residuals in a row were completed in vain; more sequences are opened the longer nothing improves."""
    rng, held, every, loose = random.Random(1), Counter(), _Pool(), _Pool()

    def put(x: tuple, times: int) -> None:
        held[x] += times
        if held[x]:
            every.add(x)
            if sum(x) < capacity:
                loose.add(x)
        else:
            del held[x]
            every.drop(x)
            loose.drop(x)

    for times, used in plan:
        put(tuple(sorted(used.elements(), reverse=True)), times)
    bins, idle = sum(held.values()), 0
    while bins > goal and idle < rounds and loose.items:
        opened = Counter()
        for pool, most in zip((loose, every), OPENED):
            for _ in range(rng.randint(1, 4 + (most - 4) * idle // rounds)):
                x = pool.items[rng.randrange(len(pool.items))]
                if opened[x] < held[x]:
                    opened[x] += 1
        new = Counter(_completed([s for x in opened.elements() for s in x], capacity, rng))
        gain = opened.total() - new.total() or sum(n * sum(x) ** 2 for x, n in new.items()) - sum(n * sum(x) ** 2 for x, n in opened.items())
        if gain >= 0:
            # What is better once is better as often as the same patterns are there.
            times = min(held[x] // n for x, n in opened.items()) if gain > 0 else 1
            for x, n in opened.items():
                put(x, -times * n)
            for x, n in new.items():
                put(x, times * n)
            bins += times * (new.total() - opened.total())
        idle = 0 if gain > 0 else idle + 1
    return [(times, Counter(x)) for x, times in held.items()]


def complete(count: np.ndarray, capacity: int = CAPACITY, max_nodes: int = MAX_NODES) -> list[tuple[int, Counter]]:
    """(times, lengths) rows that hold every piece of the histogram `count` (index: length).

    Limited discrepancy search: nodes come in the order of how far they depart from the first choices, so with few nodes left to visit
    the largest open lengths are branched on as well as the last ones."""
    count = np.asarray(count, np.int64)
    total = int((count * np.arange(len(count))).sum())
    goal = lower_bound(count, capacity)
    bins, plan = best_fit(count, capacity)
    plan = residuals(plan, capacity, goal)
    bins = sum(times for times, _ in plan)
    # By departures: (what is left or None, to be taken from the chain of patterns; chain; sequences; waste).
    waves: dict[int, deque] = {0: deque([(count, (), 0, 0)])}
    nodes, dived = 0, False
    while waves and bins > goal and nodes < max_nodes:
        away = min(waves)
        left, done, used_bins, waste = waves[away].popleft()
        if not waves[away]:
            del waves[away]
        nodes += dived
        if waste > (bins - 1) * capacity - total:
            continue
        if left is None:
            left, chain = count.copy(), done
            while chain:
                (times, used), chain = chain
                for s, c in used.items():
                    left[s] -= times * c
        below = _below(left)
        big = int(below[-1])
        if not big:
            dived = True
            if used_bins < bins:
                bins, plan = used_bins, []
                while done:
                    plan.append(done[0])
                    done = done[1]
            continue
        # Fewer sequences than the incumbent's means at most this much waste.
        spare = (bins - 1) * capacity - total - waste
        left[big] -= 1
        sets = fillings(left, _below(left), capacity - big, spare)
        left[big] += 1
        options = []
        for f in sets:
            rest = left.copy()
            times, used = _apply(rest, big, f)
            for t in {times: 0, 1: 0}:
                lost = t * (capacity - big - sum(f))
                if lost <= spare:
                    options.append((t < times, (rest if t == times else None, ((t, used), done), used_bins + t, waste + lost)))
        options.sort(key=lambda o: o[0])
        dived |= not options
        for i, (_, node) in enumerate(options):
            if i == 0:
                waves.setdefault(away, deque()).appendleft(node)
            else:
                waves.setdefault(away + i, deque()).append((None, *node[1:]))
    return plan


def slots(plan: list[tuple[int, Counter]]) -> dict[str, np.ndarray]:
    """Where the k-th piece of a length goes: rows sorted by (size, first rank)."""
    rows, seq, seen = [], 0, Counter()
    for times, used in plan:
        at = 0
        for size in sorted(used, reverse=True):
            n = used[size]
            rows.append((size, seen[size], seq, n, at))
            seen[size] += times * n
            at += size * n
        seq += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("size", "rank", "sequence", "copies", "offset"), cols, strict=True))


def pack(pieces_: DataFrame, capacity: int = CAPACITY, buckets: int = RANK_BUCKETS) -> DataFrame:
    """pieces_ (materialized; with doc_id, piece, length) with sequence_id and offset."""
    spread = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)).cast("int")
    p = pieces_.withColumn("_b", spread)
    per = p.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    count = np.zeros(capacity + 1, np.int64)
    for r in per.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most `capacity` rows
        count[r["length"]] = r["n"]
    where = slots(complete(count, capacity))
    run = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("length", "_b", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("length", "_b").orderBy("doc_id", "piece")
    p = p.join(per, ["length", "_b"]).withColumn("_rank", F.col("_before") + F.row_number().over(inner) - 1)
    names = pieces_.columns

    def place(it):
        key = where["size"] * (1 << 44) + where["rank"]
        for pdf in it:
            size, rank = pdf["length"].to_numpy(), pdf["_rank"].to_numpy()
            i = np.searchsorted(key, size * (1 << 44) + rank, "right") - 1
            q = rank - where["rank"][i]
            out = pdf[names].copy()
            out["sequence_id"] = where["sequence"][i] + q // where["copies"][i]
            out["offset"] = where["offset"][i] + q % where["copies"][i] * size
            yield out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces_.schema.fields) + ", sequence_id long, offset long"
    return p.select(*names, "_rank").mapInPandas(place, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialize(pieces(docs, tokenizer or default_tokenizer(), capacity), "pieces"), capacity)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most CAPACITY tokens; one row a piece."""
    return pack_documents(table(spark, sf_dir, "documents"))
