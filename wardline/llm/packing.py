"""Best-fit packing by the linear grouping scheme.

Token lengths are at most the sequence length, so how many pieces have each
length is a small table whatever the corpus. The plan is made on that table:

1. Lengths above ``EPSILON`` of a sequence are large. They are cut into groups
   of equal cardinality and rounded up to their group's largest.
2. With so few sizes, a linear programme over configurations (Gilmore-Gomory
   columns) says how often to use each.
3. Real lengths are substituted for the rounded ones, largest first; what is
   left over in a sequence is known exactly. Pieces no configuration took are
   placed best-fit.
4. Small lengths are placed best-fit, longest first, in the tightest room.

The plan is a list of runs: so many sequences from number s on hold a piece of
length l at offset o. The n-th piece of a length is looked up in it. Pieces are
numbered by windows over (length, salt), so a length that a third of all pieces
have is numbered by many tasks.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm.bpe import json_encoder
from wardline.llm.common import bounded, checkpointed, concat_ranges, slices
from wardline.session import spread, table

SEQUENCE = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
EPSILONS = (0.25, 0.4)
GROUPS = (12, 36)
#: Windows number at most about this many pieces each; at least ``SALTS`` of them a length.
WINDOW_ROWS = 2_000_000
SALTS, MOST_SALTS = 64, 4096


def _cutter(path: str, pattern: str, length: int, end_id: int, with_ids: bool, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = json_encoder(path, pattern, added)
        for batch, texts in slices(batches):
            ids, at = encode(texts)
            n = np.diff(at)
            ids = np.insert(ids, at[1:], end_id).astype("<u4")  # one end id after each text
            begin = at[:-1] + np.arange(len(n))
            n = n + 1
            pieces = -(-n // length)
            lead = n - (pieces - 1) * length
            doc = np.repeat(np.arange(len(n)), pieces)
            number = concat_ranges(np.zeros(len(n), dtype=np.int64), pieces)
            start = np.where(number == 0, 0, lead[doc] + (number - 1) * length)
            size = np.where(number == 0, lead[doc], length)
            raw = memoryview(ids.tobytes())
            places = [(4 * a, 4 * b) for a, b in zip((begin[doc] + start).tolist(), (begin[doc] + start + size).tolist(), strict=True)]
            cols = {"doc_id": batch.column(0).take(pa.array(doc)), "piece": pa.array(number.astype(np.int32)), "start": pa.array(start), "length": pa.array(size), "ids_crc32": pa.array([zlib.crc32(raw[a:b]) for a, b in places], pa.int64())}
            if with_ids:
                cols["ids"] = pa.array([np.frombuffer(raw[a:b], dtype="<u4").astype(np.int32) for a, b in places], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(cols)
        encode.forget()

    return run


def tokenized(docs: DataFrame, length: int = SEQUENCE, tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False, added: bool = False) -> DataFrame:
    """Pieces of at most ``length`` ids: doc_id, piece, start, length, ids_crc32 (and ids); only a first piece of a longer document is shorter."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cutter(path, public_tokenizers.PATTERN, length, end_id, with_ids, added), schema)


def _simplex(columns: list[np.ndarray], demand: np.ndarray, sizes: np.ndarray, room: int) -> dict[tuple[int, ...], float]:
    """How often to use each configuration: min sum x, A x = demand, x >= 0, columns priced by a knapsack."""
    m = len(demand)
    basis = [c.astype(float) for c in columns]
    inverse = np.linalg.inv(np.stack(basis, axis=1))
    x = inverse @ demand
    for _ in range(60 * m):
        prices = inverse.sum(axis=0)
        # Most valuable filling of a sequence: best[c] is the value within c, took[c] the size added last.
        best, took = np.zeros(room + 1), np.full(room + 1, -1)
        for c in range(1, room + 1):
            fits = sizes <= c
            best[c] = best[c - 1]
            if fits.any():
                value = np.where(fits, best[np.maximum(c - sizes, 0)] + prices, -1)
                k = int(value.argmax())
                if value[k] > best[c] + 1e-12:
                    best[c], took[c] = value[k], k
        if best[room] <= 1 + 1e-7:
            break
        column, c = np.zeros(m), room
        while c > 0:
            if took[c] < 0:
                c -= 1
            else:
                column[took[c]] += 1
                c -= int(sizes[took[c]])
        way = inverse @ column
        up = way > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, way, 1), np.inf)
        out = int(ratio.argmin())
        basis[out] = column
        pivot = inverse[out] / way[out]
        inverse -= np.outer(way, pivot)
        inverse[out] = pivot
        x = np.maximum(inverse @ demand, 0)
    found: dict[tuple[int, ...], float] = defaultdict(float)
    for c, v in zip(basis, x, strict=True):
        if v > 1e-9:
            found[tuple(int(z) for z in c)] += v
    return found


class _Rooms:
    """Sequences by the room left in them: runs (first sequence, how many, offset of the room)."""

    def __init__(self, room: int):
        self.room, self.count = room, 0
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.placed: list[tuple[int, int, int, int]] = []  # length, sequence, how many, offset

    def put(self, left: int, first: int, n: int, size: int, each: int) -> None:
        """``each`` pieces of ``size`` into each of n sequences with ``left`` room."""
        for k in range(each):
            self.placed.append((size, first, n, self.room - left + k * size))
        if left - each * size:
            self.runs[left - each * size].append((first, n))

    def best_fit(self, size: int, n: int) -> None:
        """Place n pieces of ``size``, always in the tightest room that takes one; new sequences when there is none."""
        for left in sorted(k for k, v in self.runs.items() if v and k >= size):
            each = left // size
            while n and self.runs[left]:
                first, many = self.runs[left].pop()
                full = min(many, n // each)
                if full:
                    self.put(left, first, full, size, each)
                    n -= full * each
                elif n:  # fewer than one sequence takes
                    full = 1
                    self.put(left, first, 1, size, n)
                    n = 0
                if many > full:
                    self.runs[left].append((first + full, many - full))
            if not n:
                return
        each = self.room // size
        for per, many in ((each, n // each), (n % each, 1)):
            if per and many:
                self.put(self.room, self.count, many, size, per)
                self.count += many


def plan(counts: dict[int, int], room: int = SEQUENCE, epsilon: float = 0.12, groups: int = 48) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Number of sequences, and runs (length, first sequence, how many, offset) that place ``counts`` pieces of each length.

    A run's pieces go to consecutive sequences, one each.
    """
    rooms = _Rooms(room)
    large = sorted((k for k, v in counts.items() if k > epsilon * room and v), reverse=True)
    total = sum(counts[k] for k in large)
    if large:
        share = max(1, -(-total // groups))
        # Groups of equal cardinality over the sorted pieces; each is a list of (length, how many), longest first.
        cut: list[list[tuple[int, int]]] = [[]]
        free = share
        for k in large:
            n = counts[k]
            while n:
                if not free:
                    cut.append([])
                    free = share
                take = min(n, free)
                cut[-1].append((k, take))
                n, free = n - take, free - take
        sizes = np.array([g[0][0] for g in cut])
        same = np.concatenate([[True], sizes[1:] != sizes[:-1]])  # groups of one rounded size are one size
        merged: list[list[tuple[int, int]]] = []
        for g, new in zip(cut, same, strict=True):
            if new:
                merged.append([])
            merged[-1] += g
        sizes = np.array([g[0][0] for g in merged])
        demand = np.array([sum(n for _, n in g) for g in merged], dtype=float)
        first = [np.eye(len(sizes))[i] * (room // sizes[i]) for i in range(len(sizes))]
        for config, often in sorted(_simplex(first, demand, sizes, room).items(), reverse=True):
            slots = [k for k, c in enumerate(config) for _ in range(c)]
            have = min((sum(n for _, n in merged[k]) // config[k] for k in set(slots)), default=0)
            left_to_do = min(int(often + 1e-6), have)
            while left_to_do:
                # As many sequences as get the same real lengths in all slots; the longest pieces of a group go first.
                taken = []
                for k in sorted(set(slots)):
                    # c pieces of one length a sequence while the first length lasts, else one sequence across lengths
                    length, n = merged[k][0]
                    taken.append((k, config[k], length, n // config[k]))
                many = min(left_to_do, min(t[3] for t in taken))
                used = []
                if many:
                    for k, c, length, _ in taken:
                        used += [length] * c
                        rest = merged[k][0][1] - many * c
                        merged[k] = ([(length, rest)] if rest else []) + merged[k][1:]
                else:
                    many = 1
                    for k in sorted(set(slots)):
                        for _ in range(config[k]):
                            length, n = merged[k][0]
                            used.append(length)
                            merged[k] = ([(length, n - 1)] if n > 1 else []) + merged[k][1:]
                at = 0
                for length in used:
                    rooms.placed.append((length, rooms.count, many, at))
                    at += length
                if at < room:
                    rooms.runs[room - at].append((rooms.count, many))
                rooms.count += many
                left_to_do -= many
        for g in merged:
            for length, n in g:
                rooms.best_fit(length, n)
    for k in sorted((k for k, v in counts.items() if k <= epsilon * room and v), reverse=True):
        rooms.best_fit(k, counts[k])
    return rooms.count, rooms.placed


def best_plan(counts: dict[int, int], room: int = SEQUENCE) -> tuple[int, list[tuple[int, int, int, int]]]:
    """The plan of fewest sequences over ``EPSILONS`` and ``GROUPS``."""
    return min((plan(counts, room, e, g) for e in EPSILONS for g in GROUPS), key=lambda p: p[0])


def _placer(heads: dict[tuple[int, int], int], runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, salt = col["length"].to_numpy(), col["salt"].to_numpy()
            rank = col["rank"].to_numpy() - 1
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for k in np.unique(length).tolist():
                rows = np.flatnonzero(length == k)
                n = rank[rows] + np.array([heads[k, s] for s in salt[rows].tolist()])
                ends, first, at = runs[k]
                which = np.searchsorted(ends, n, side="right")
                begin = np.where(which > 0, ends[np.maximum(which - 1, 0)], 0)
                sequence[rows], offset[rows] = first[which] + n - begin, at[which]
            keep = [n for n in batch.schema.names if n not in ("salt", "rank")]
            yield pa.RecordBatch.from_arrays([*(col[n] for n in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, room: int = SEQUENCE) -> DataFrame:
    """Add sequence_id and offset to pieces with doc_id, piece and length (1 to ``room``), in as few sequences as the plan finds.

    Offsets in a sequence are gapless from 0. No pieces: no rows.
    """
    pieces = checkpointed(pieces)
    # At most ``room`` rows. A length is dealt to as many windows as its pieces need.
    sized = {r.length: max(SALTS, min(MOST_SALTS, -(-r.n // WINDOW_ROWS))) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    hot = [F.lit(x) for length, n in sized.items() if n > SALTS for x in (length, n)]
    salts = F.coalesce(F.create_map(*hot)[F.col("length")], F.lit(SALTS)) if hot else F.lit(SALTS)
    # Pieces without doc_id are alike to the windows; a number of their own deals them out.
    named = F.coalesce(F.col("doc_id"), F.monotonically_increasing_id())
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(named, "piece"), salts).cast("int"))
    # At most room x SALTS rows, and one more for each ``WINDOW_ROWS`` pieces, never over room x MOST_SALTS.
    found = sorted((r.length, r.salt, r.n) for r in salted.groupBy("length", "salt").agg(F.count("*").alias("n")).collect())
    heads: dict[tuple[int, int], int] = {}
    counts: dict[int, int] = defaultdict(int)
    for length, salt, n in found:
        heads[length, salt] = counts[length]
        counts[length] += n
    _, placed = best_plan(dict(counts), room)
    by: dict[int, list] = defaultdict(list)
    for length, first, n, at in placed:
        by[length].append((n, first, at))
    runs = {k: (np.cumsum([n for n, _, _ in v]), np.array([f for _, f, _ in v]), np.array([a for _, _, a in v])) for k, v in by.items()}
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(order).cast("long"))
    fields = [f for f in ranked.schema.fields if f.name not in ("salt", "rank")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_placer(heads, runs), schema)


def pack_documents(docs: DataFrame, length: int = SEQUENCE, tokenizer: str | None = None, with_ids: bool = False, added: bool = False) -> DataFrame:
    """Tokenise and pack whole documents: one row per piece.

    With ``added``, strings of the file's added tokens become their ids, as the
    tokenizers library has it by default; else they are ordinary text.

    Null and empty texts are the end id alone. Longer documents are cut into
    pieces of ``length``, the first of which may be shorter. Repeated rows and
    rows without doc_id are packed like others; pieces of one length take the
    places the plan has for it by a hash of doc_id and piece, then by doc_id
    and piece. Empty table: no rows. Other columns are ignored.
    """
    return pack(tokenized(docs, length, tokenizer, with_ids=with_ids, added=added), length)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spread(table(spark, sf_dir, "documents")), added=True)
