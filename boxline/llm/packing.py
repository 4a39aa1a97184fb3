"""Best-fit packing of token sequences with Martello-Toth dominance reduction.

Pieces of equal length are interchangeable, so an instance of any size is its
histogram of lengths: at most ``capacity`` counts, which is all that reaches
the driver. There, sets of one to three lengths that provably dominate every
other way to fill a sequence around its longest piece are fixed for as many
sequences as they last; the remainder is packed best-fit, longest first. The
plan is a table of runs: consecutive ranks of a length fill consecutive
sequences. Each piece finds its place by its rank among the pieces of its
length, which is its rank within its file part plus the counts of the parts
before; no group of pieces is ever sorted or gathered.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxline.llm.common import stored, text_of

CAPACITY = 2048
_SLICE = 1 << 20  # characters of text that are encoded and handed on together
_BROADCAST_ROWS = 200_000  # counts by length and part, up to which they are sent to every executor
# Fixed value: how byte-level vocabularies of this kind part a text before merging.
_PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def ranks_of(tokenizer: dict) -> dict[bytes, int] | None:
    """Merge ranks by token bytes, where a tokenizer file is plain byte-level BPE whose ids ascend with its merges; else None."""
    model, parts = tokenizer["model"], tokenizer["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not tokenizer["normalizer"] and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or parts.get("type") != "ByteLevel" or parts.get("add_prefix_space") or not parts.get("use_regex", True):
        return None
    # Bytes stand as printable characters; the others follow from 256 on.
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    added = {t["content"] for t in tokenizer["added_tokens"]}
    vocab = {w: i for w, i in model["vocab"].items() if w not in added}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    order = [vocab.get(w, -1) for w in merged]
    if order != sorted(set(order)) or set(vocab) != set(byte) | set(merged):
        return None
    return {bytes(byte[c] for c in w): i for w, i in vocab.items()}


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit values.

    The vocabulary is read by ``tokenizers``. Where it is plain byte-level BPE,
    ``tiktoken`` applies the same merges in the same order, several times as fast;
    other vocabularies, and texts that hold an added token's string, are left to
    ``tokenizers``. No text or word is kept.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = ranks_of(json.loads(self.tokenizer.to_str()))
        self.fast = ranks and tiktoken.Encoding(os.path.basename(path), pat_str=_PARTS, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast and not any(a in text for a in self.added):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker, set up once for all its tasks."""
    held = sys.modules.setdefault("boxline_llm_worker", ModuleType("boxline_llm_worker")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def _slices(column: pa.Array):
    """Runs of rows of about ``_SLICE`` characters, at least one row each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + _SLICE, "right")))
        yield first, last - first
        first = last


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenised pieces: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``part``, ``rank`` and, if asked for, ``ids``.

    A document's ids are its tokens and ``end``. Only longer ones than
    ``capacity`` are cut; what doesn't fill a piece comes first. ``rank`` counts
    pieces of equal length within a partition ``part``. Null text counts as empty.
    Texts are worked on and handed on a few at a time.
    """
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long" + ", ids array<int>" * with_ids
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]

    def run(batches):
        encode, part, ranks = encoder(tokenizer), TaskContext.get().partitionId(), {}
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            for first, count in _slices(batch.column(1)):
                rows, blobs = [], []
                ids_of, texts = (batch.column(i).slice(first, count).to_pylist() for i in (0, 1))
                for doc_id, content in zip(ids_of, texts):
                    ids = encode(content) + tail
                    total, start, piece = len(ids) // 4, 0, 0
                    while start < total:
                        length = (total - start) % capacity or capacity
                        rank = ranks[length] = ranks.get(length, -1) + 1
                        rows.append((doc_id, piece, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), part, rank))
                        start, piece = start + length, piece + 1
                    blobs.append(ids)
                held = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
                if with_ids:  # pieces are whole documents in order, so their ids are one flat array
                    flat = b"".join(blobs)
                    ends = np.cumsum([0, *(r[3] for r in rows)], dtype=np.int32)
                    held.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat) // 4, [None, pa.py_buffer(flat)])))
                yield pa.RecordBatch.from_arrays(held, names)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text"))
    return slim.mapInArrow(run, columns)


class Plan:
    """Runs ``(length, first rank, count, first sequence, pieces a sequence, offset)`` over a histogram of lengths."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left, self.used = capacity, [0] * (capacity + 1), [0] * (capacity + 1)
        for length, n in counts.items():
            if not 0 < length <= capacity:
                raise ValueError(f"length {length} does not fit a sequence of {capacity}")
            self.left[length] += n
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = self.fixed = 0

    def _run(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        self.runs.append((length, self.used[length], count, sequence, each, offset))
        self.used[length] += count
        self.left[length] -= count

    def _fix(self, lengths: tuple[int, ...]) -> None:
        """Fix as many sequences of exactly these lengths as there are pieces for."""
        need = {x: lengths.count(x) for x in lengths}
        times, offset = min(self.left[x] // n for x, n in need.items()), 0
        for length, n in need.items():
            self._run(length, times * n, self.sequences, n, offset)
            offset += n * length
        self.sequences += times
        self.fixed += times

    def _others(self, length: int, top: int):
        """Lengths up to ``top`` of the pieces left besides one of ``length``, from the longest; one entry a length."""
        return (x for x in range(min(top, self.capacity), 0, -1) if self.left[x] - (x == length) > 0)

    def _smallest(self, length: int, n: int) -> list[int]:
        found: list[int] = []
        for x in range(1, self.capacity + 1):
            found += [x] * min(self.left[x] - (x == length), n - len(found))
            if len(found) == n:
                break
        return found

    def _dominating(self, length: int) -> tuple[int, ...] | None:
        """Lengths of a set around one piece of ``length`` that dominates every other feasible set, or None.

        Set A dominates B if B's members can be parted so that each part fits in
        place of a different member of A: whatever a packing does with B, A can
        take its place at no cost.
        """
        room = self.capacity - length
        largest = next(self._others(length, room), 0)
        if not largest:
            return (length,)
        if largest == room:
            return (length, largest)
        small = self._smallest(length, 4)
        if len(small) < 2 or small[0] + small[1] > room:
            return (length, largest)  # nothing but one further piece fits
        # Sums of two or more further pieces, as if each length were there without end.
        sizes, once, more = list(self._others(length, room)), 0, 0
        for x in sizes:
            once |= 1 << x
        reach = once
        while True:
            grown = more
            for x in sizes:
                grown |= reach << x
            grown &= (1 << room + 1) - 1
            if grown == more:
                break
            more, reach = grown, once | grown
        if more.bit_length() - 1 <= largest:
            return (length, largest)  # any further pieces together fit in place of the largest
        if len(small) < 3 or sum(small[:3]) > room:
            # At most two further pieces: the best pair must be largest in both places.
            second = next((x for x in self._others(length, room - largest) if self.left[x] - (x == length) - (x == largest) > 0), 0)
            widest = next((y for y in sizes if any(x >= y and x + y <= room and self.left[x] - (x == length) - (x == y) > 0 for x in sizes)), 0)
            if second and widest <= second:
                return (length, largest, second)
        return None

    def reduce(self) -> None:
        for length in range(self.capacity, 0, -1):
            while self.left[length] and (chosen := self._dominating(length)):
                self._fix(chosen)

    def best_fit(self) -> None:
        """Pack what is left, longest first, each piece where the least room stays; equal pieces and sequences go together."""
        open_: list[list[tuple[int, int, int]]] = [[] for _ in range(self.capacity + 1)]  # by room: first sequence, number, offset
        for length in range(self.capacity, 0, -1):
            while n := self.left[length]:
                room = next((r for r in range(length, self.capacity) if open_[r]), self.capacity)
                each = room // length
                if room == self.capacity:
                    first, number, offset = self.sequences, -(-n // each), 0
                    self.sequences += number
                else:
                    first, number, offset = open_[room].pop()
                full, rest = divmod(min(n, each * number), each)
                if full:
                    self._run(length, full * each, first, each, offset)
                    open_[room - each * length].append((first, full, offset + each * length))
                if rest:
                    self._run(length, rest, first + full, rest, offset)
                    open_[room - rest * length].append((first + full, 1, offset + rest * length))
                if (over := number - full - bool(rest)) > 0:
                    open_[room].append((first + full + bool(rest), over, offset))

    def table(self) -> np.ndarray:
        return np.array(sorted(self.runs), np.int64).reshape(-1, 6)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    made = Plan(counts, capacity)
    made.reduce()
    made.best_fit()
    return made


_RUNS = "length long, first long, count long, first_sequence long, each long, first_offset long"


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored pieces (``length``, ``part`` and ``rank`` are read and the last two dropped).

    A piece's rank among its length is its rank within its part plus the counts
    of the parts before, which reach the pieces by broadcast while they are few
    and by a shuffle beyond. The runs of the plan come from at most ``capacity``
    counts and stay few whatever the number of pieces.
    """
    spark = cut.sparkSession
    parts = stored(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.createDataFrame(plan(counts, capacity).table().tolist(), _RUNS)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("length", "part", before.alias("before"))
    offsets = F.broadcast(offsets) if parts.count() <= _BROADCAST_ROWS else offsets.hint("merge")
    ranked = cut.join(offsets, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    inside = (ranked["length"] == runs["length"]) & (ranked["rank"] >= runs["first"]) & (ranked["rank"] < runs["first"] + runs["count"])
    placed = ranked.join(F.broadcast(runs), inside).drop(runs["length"])
    kept = [c for c in cut.columns if c not in ("part", "rank")]
    return placed.select(*kept, F.expr("first_sequence + (rank - first) div each").alias("sequence_id"), F.expr("first_offset + (rank - first) % each * length").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece with its place: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    Null and empty texts are one piece of one id. Repeated rows and null ids are
    packed like any other; an empty table gives no sequence.
    """
    packed = pack(stored(pieces(docs, tokenizer, text, capacity, with_ids=with_ids), "pieces"), capacity)
    first = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return packed.select(*first, *(["ids"] if with_ids else []))
