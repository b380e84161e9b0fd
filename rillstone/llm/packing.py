"""Best-fit packing of token sequences by bin completion.

Documents of one length are interchangeable, so a corpus of any size is packed
as a histogram of at most ``capacity`` lengths: the driver sees those counts and
nothing else. Best fit decreasing gives the incumbent, and a lower bound says
whether it can be bettered. If so, the undominated fillings around the largest
length left are enumerated; the one of least waste is laid down as often as the
counts allow, and the last pieces go to a branch-and-bound search that prunes by
waste. Workers then deal each piece its place by its rank within its length.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from .bpe import LONGEST, WordBPE
from .common import map_arrow, written

CAPACITY = 4096
#: The id after each document.
END = 1
#: Fillings looked at around one piece, pieces of the last search, and its nodes.
LOOKS, TAIL, NODES = 400, 256, 40_000
#: Words that a worker keeps, twice as many at most; beside others' tables in one worker, so fewer than alone.
WORDS = 60_000
#: New words that are encoded in one text.
LEARNT = 32

Packing = list[tuple[tuple[int, ...], int]]


def best_fit(counts: dict[int, int], capacity: int) -> Packing:
    """Best-fit decreasing over counted lengths: (lengths of a sequence, how many such)."""
    open_: dict[int, list[list]] = {0: []}
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], times: int) -> None:
        if room and room not in open_:
            bisect.insort(rooms, room)
        open_.setdefault(room, []).append([pattern, times])

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            k = bisect.bisect_left(rooms, size)
            if k == len(rooms):
                # a new sequence takes as many as it holds before the next is opened
                each = capacity // size
                if left >= each:
                    put(capacity - each * size, (size,) * each, left // each)
                    left %= each
                else:
                    put(capacity - left * size, (size,) * left, 1)
                    left = 0
                continue
            room = rooms[k]
            pattern, times = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[k]
            used = min(times, left)
            put(room - size, (*pattern, size), used)
            if times > used:
                put(room, pattern, times - used)
            left -= used
    return [(p, t) for groups in open_.values() for p, t in groups]


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """A number of sequences below which no packing of the counted lengths can go.

    For each length K up to half a sequence: pieces beyond half stand in
    sequences of their own, and what those that leave K or more cannot take in of
    the pieces from K up to half needs further ones.
    """
    n = np.zeros(capacity + 2, np.int64)
    for s, times in counts.items():
        n[s] = times
    size = np.arange(capacity + 2)
    pieces, tokens = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])
    half = capacity // 2 + 1  # the first length of which two do not fit
    k = np.arange(0, half)
    alone = pieces[capacity + 1] - pieces[half]
    open_ = pieces[capacity - k + 1] - pieces[half]
    room = open_ * capacity - (tokens[capacity - k + 1] - tokens[half])
    return int(np.max(alone + np.maximum(0, -(-(tokens[half] - tokens[k] - room) // capacity)), initial=0))


def fillings(sizes: list[int], counts: dict[int, int], room: int, waste: int, looks: int = LOOKS) -> list[tuple[int, tuple[int, ...]]]:
    """(waste, lengths) of the undominated fillings of ``room`` that leave at most ``waste`` of it, least waste first, then larger lengths first; the first ``looks`` that are met.

    ``sizes`` are the lengths that are left, rising, ``counts`` how many of each.
    A filling is dominated, and left out, if one of its lengths could give way to
    a larger one that is left and still fits, or another could be added.
    """
    held = [0]
    for s in sizes:
        held.append(held[-1] + s * counts[s])
    out, seen = [], 0
    stack: list[tuple[int, int, tuple[int, ...]]] = [(room, len(sizes), ())]
    while stack and seen < looks:
        left, end, chosen = stack.pop()
        k = min(bisect.bisect_right(sizes, left), end) - 1
        while k >= 0 and chosen.count(sizes[k]) >= counts[sizes[k]]:
            k -= 1
        if k < 0:
            seen += 1
            if left <= waste and not any((j := bisect.bisect_right(sizes, x + left) - 1) >= 0 and sizes[j] > x and chosen.count(sizes[j]) < counts[sizes[j]] for x in {0, *chosen}):
                out.append((left, chosen))
                if left == 0 and len(chosen) == 1:
                    break  # one piece that fills it is better than any others that do
            continue
        if k > 0 and left - held[k] <= waste:  # without this length: smaller ones
            stack.append((left, k, chosen))
        stack.append((left - sizes[k], k + 1, (*chosen, sizes[k])))
    return sorted(out, key=lambda f: (f[0], tuple(-x for x in f[1])))


def within(counts: dict[int, int], capacity: int, target: int, nodes: int, looks: int) -> list[tuple[int, ...]] | None:
    """The counted lengths in ``target`` sequences, or None if none is found.

    Bin completion: the largest length left opens a sequence, whose undominated
    fillings are the branches, and a branch ends where more is wasted than
    ``target`` sequences have room for. Dives differ from the best branch at
    ever more places, until all are seen or ``nodes`` are.
    """
    spare = target * capacity - sum(s * n for s, n in counts.items())
    limit, whole = 0, False
    while nodes > 0 and not whole and spare >= 0:
        whole, path = True, []

        def branches(left: dict[int, int], slack: int, top: int):
            sizes = sorted(left)
            return iter(enumerate(fillings(sizes, left, capacity - top, slack, looks)))

        def opened(left: dict[int, int]) -> tuple[dict[int, int], int]:
            top = max(left)
            rest = dict(left)
            rest[top] -= 1
            if not rest[top]:
                del rest[top]
            return rest, top

        rest, top = opened(counts)
        stack = [(branches(rest, spare, top), rest, top, spare, limit)]
        while stack:
            tried, left, top, slack, turns = stack[-1]
            k, branch = next(tried, (0, None))
            if branch is None or k > turns or nodes <= 0:
                whole = whole and branch is None
                stack.pop()
                del path[-1:]
                continue
            nodes -= 1
            waste, chosen = branch
            rest = dict(left)
            for s in chosen:
                rest[s] -= 1
                if not rest[s]:
                    del rest[s]
            path.append((top, *chosen))
            if not rest:
                return path
            rest, top = opened(rest)
            stack.append((branches(rest, slack - waste, top), rest, top, slack - waste, turns - k))
        limit = 2 * limit + 1
    return None


def complete(counts: dict[int, int], capacity: int, nodes: int = NODES, looks: int = LOOKS) -> Packing:
    """As few sequences as the search finds for some lengths, from the best-fit incumbent down to least_sequences()."""
    best = best_fit(counts, capacity)
    for target in range(least_sequences(counts, capacity), sum(t for _, t in best)):
        found = within(counts, capacity, target, nodes, looks)
        if found is not None:
            return [(p, 1) for p in found]
    return best


def pack(counts: dict[int, int], capacity: int = CAPACITY, looks: int = LOOKS, tail: int = TAIL, nodes: int = NODES) -> Packing:
    """(lengths of a sequence, how many such) that hold all the counted lengths, each between 1 and capacity.

    The packing is the best-fit one if that meets least_sequences(), which proves
    it; or else one whose fillings of least waste are laid down around the
    largest length as often as the counts allow, until ``tail`` pieces are left,
    which the search packs. What it is above least_sequences() is the gap that
    is left unproven.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("a length is not between 1 and the capacity")
    used = lambda packing: sum(t for _, t in packing)
    incumbent, least = best_fit(left, capacity), least_sequences(left, capacity)
    if used(incumbent) == least:
        return incumbent
    sizes, total, out = sorted(left), sum(left.values()), []
    while sizes and total > tail:
        top = sizes[-1]
        left[top] -= 1  # the others of its length may fill its rest
        rest = sizes if left[top] else sizes[:-1]
        _, chosen = next(iter(fillings(rest, left, capacity - top, capacity, looks)), (0, ()))
        left[top] += 1
        need = Counter((top, *chosen))
        times = max(1, min(min(left[s] // n for s, n in need.items()), (total - tail) // (1 + len(chosen))))
        out.append(((top, *chosen), times))
        for s, n in need.items():
            left[s] -= n * times
            total -= n * times
        left = {s: n for s, n in left.items() if n}
        sizes = sorted(left)
    out += complete(left, capacity, nodes, looks) if left else []
    return out if used(out) < used(incumbent) else incumbent


class Words(WordBPE):
    """Ids by the tokenizers library; words met before come from a bounded table."""

    def __init__(self, path: str):
        super().__init__(path)
        self.known.most = WORDS
        # words come split and in normal form, so the library's own steps for that are left out
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.normalizer = normalizers.Sequence([])
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = np.zeros(max(self.names) + 1, bool)
        ends[[i for i, t in self.names.items() if t.endswith(self.suffix)]] = True
        self.ends = ends

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of each word, encoded in one text with a blank between any two; a word ends with a token that bears the suffix."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(ends) != len(words):
            return [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of different words; those not met before are learnt, some at a time."""
        out = list(map(self.known.get, words))
        old, own, fresh = self.known.old, {}, []
        for w in [w for w, x in zip(words, out) if x is None]:
            x = old.get(w)
            if x is not None:
                own[w] = x
            elif w in self.special:
                own[w] = self.special[w].to_bytes(4, "little")
            elif w:
                fresh.append(w)
        for k in range(0, len(fresh), LEARNT):
            own |= zip(fresh[k : k + LEARNT], self.learn(fresh[k : k + LEARNT]), strict=True)
        self.known.keep_all({w: x for w, x in own.items() if len(w) <= LONGEST})
        own[""] = b""
        return [own[w] if x is None else x for w, x in zip(words, out)]


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> Words:
    return Words(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, k long"


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, its task and rank among that task's pieces of its length, and, if asked for, its ids."""

    def start():
        words = loaded(path)
        part, seen = TaskContext.get().partitionId(), Counter()
        end = END.to_bytes(4, "little")

        def run(batch):
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, raw in zip(batch.column(0).to_pylist(), words.encode_all(texts), strict=True):
                raw += end
                for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    length = len(own) // 4
                    rows.append((doc, n, at // 4, length, zlib.crc32(own), part, seen[length], *([own] if keep_ids else [])))
                    seen[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *([pa.binary()] if keep_ids else [])]
            names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * keep_ids
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        return run

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), start, PIECES + ", ids binary" * keep_ids)


def places(packing: Packing) -> dict[int, list[np.ndarray]]:
    """By length: first rank, how many of it in a sequence, first sequence, and offset there, of each pattern that holds it."""
    rank, rows, first = Counter(), {}, 0
    for pattern, times in packing:
        offset = 0
        for size, n in sorted(Counter(pattern).items(), reverse=True):
            rows.setdefault(size, []).append((rank[size], n, first, offset))
            rank[size] += n * times
            offset += n * size
        first += times
    return {size: [np.array(c, np.int64) for c in zip(*r, strict=True)] for size, r in rows.items()}


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents with sequence_id and offset in sequences of at most ``capacity`` tokens.

    Null and empty texts are one token, END. Rows that repeat are packed each,
    and an empty table gives no rows. Pieces are written once to the shared
    folder; after that only counts by (task, length) and the pieces' own small
    rows are shuffled, never by length alone, so equal documents make no hot
    task. The driver gets ``capacity`` counts at most and the workers as many
    patterns; neither grows with the input.
    """
    rows = written(pieces(docs, path, id_col, text_col, capacity, keep_ids), "pieces")
    spark = rows.sparkSession
    held = rows.groupBy("part", "length").agg((F.max("k") + 1).alias("n"))
    before = held.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(pack(counts, capacity)))
    with_rank = rows.join(before, ["part", "length"]).withColumn("rank", F.col("k") + F.col("before")).drop("k", "part", "before")
    with_rank = with_rank.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", *(["ids"] if keep_ids else []))

    def start():
        def run(batch):
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for size in np.unique(length):
                own = np.flatnonzero(length == size)
                first_rank, each, first, at = table.value[int(size)]
                r = rank[own]
                g = np.searchsorted(first_rank, r, side="right") - 1
                r = r - first_rank[g]
                sequence[own] = first[g] + r // each[g]
                offset[own] = at[g] + r % each[g] * size
            kept = [i for i in range(batch.num_columns) if i != 5]
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(sequence), pa.array(offset)], [*(batch.schema.names[i] for i in kept), "sequence_id", "offset"])

        return run

    return map_arrow(with_rank, start, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long")
