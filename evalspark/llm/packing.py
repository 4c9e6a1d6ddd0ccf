"""Operator 8, hierarchical multi-length packing of token ids into training sequences.

Context sizes are tiers of 1024, 512 and 256 ids. A document fills whole windows of the longest tier first; what
remains is routed to the smallest tier that holds it. Tiers are packed from the longest down: every remainder opens a
window of its tier, whose gap is filled from the shorter tiers, by the longest piece that fits and at last by a piece
cut to measure. What is left at the end of a partition is cut at powers of two. So no sequence holds padding.

Step groups are balanced: sequences of one tier form steps of STEP_TOKENS tokens, each of one shape; at the end of a
partition the open steps of all tiers are put together, longest sequences first, into steps of the same number of
tokens, so that of a partition's steps only the last one can be lighter.

Partitions pack on their own, in pools of bounded size: nothing is shuffled, and no partition holds more than one
pool of remainders. A reader joins pieces to ids by document and start, or takes the ids with the pieces.

Defined cases: a null text is the empty one and has only the end id; rows that repeat an id are packed each; a null
id passes through; an empty table gives no pieces; further columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from evalspark.llm.tokens import encoder

END_ID = 0
TIERS = (1024, 512, 256)
#: Remainders packed together; each is shorter than the longest tier.
POOL = 4096
#: Tokens of a step group.
STEP_TOKENS = 64 * 1024
_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())]


class _Piece:
    """Ids of a document from start on."""

    __slots__ = ("doc_id", "start", "ids", "total")

    def __init__(self, doc_id: int | None, start: int, ids: np.ndarray, total: int):
        self.doc_id, self.start, self.ids, self.total = doc_id, start, ids, total

    def cut(self, n: int) -> tuple[_Piece, _Piece]:
        return _Piece(self.doc_id, self.start, self.ids[:n], self.total), _Piece(self.doc_id, self.start + n, self.ids[n:], self.total)


class _Pool:
    """Pieces by tier, each tier sorted by length; ties keep the order of arrival."""

    def __init__(self) -> None:
        self.tiers: dict[int, list[tuple[int, int, _Piece]]] = {c: [] for c in TIERS}
        self.arrived = self.held = 0

    def add(self, piece: _Piece) -> None:
        tier = min(c for c in TIERS if c >= len(piece.ids))
        insort(self.tiers[tier], (len(piece.ids), self.arrived, piece))
        self.arrived += 1
        self.held += len(piece.ids)

    def _take(self, tier: int, k: int) -> _Piece:
        piece = self.tiers[tier].pop(k)[2]
        self.held -= len(piece.ids)
        return piece

    def longest(self, tier: int) -> _Piece:
        return self._take(tier, len(self.tiers[tier]) - 1)

    def fitting(self, gap: int, below: int) -> _Piece | None:
        """The longest piece of up to gap ids in the tiers from `below` down."""
        for tier in (c for c in TIERS if c <= below):
            k = bisect_right(self.tiers[tier], (gap, self.arrived))
            if k:
                return self._take(tier, k - 1)
        return None

    def longer(self, below: int) -> _Piece | None:
        """Some piece of the shortest tier that has one, its longest, to be cut."""
        for tier in (c for c in reversed(TIERS) if c <= below):
            if self.tiers[tier]:
                return self.longest(tier)
        return None

    def windows(self, last: bool) -> Iterator[tuple[int, list[_Piece]]]:
        """Full windows, tier by tier; what can't fill one stays, or is cut at powers of two if it is the last."""
        for tier in TIERS:
            # a tier's remainders are packed while the pool can fill their windows
            while self.tiers[tier] and self.held >= tier:
                window = [self.longest(tier)]
                gap = tier - len(window[0].ids)
                while gap:
                    piece = self.fitting(gap, tier)
                    if piece is None:
                        piece, rest = self.longer(tier).cut(gap) if self._has(tier) else self._split_longer(tier, gap)
                        self.add(rest)
                    window.append(piece)
                    gap -= len(piece.ids)
                yield tier, window
        while last and self.held:
            size = 1 << (self.held.bit_length() - 1)
            window, gap = [], size
            while gap:
                piece = self.fitting(gap, TIERS[0])
                if piece is None:
                    piece, rest = self.longer(TIERS[0]).cut(gap)
                    self.add(rest)
                window.append(piece)
                gap -= len(piece.ids)
            yield size, window

    def _has(self, below: int) -> bool:
        return any(self.tiers[c] for c in TIERS if c <= below)

    def _split_longer(self, tier: int, gap: int) -> tuple[_Piece, _Piece]:
        """Where no shorter piece is left, a longer one is cut."""
        return self.longer(TIERS[0]).cut(gap)


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier and step_group; with
    the piece's ids as little-endian unsigned 32-bit integers if asked for."""
    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    schema = pa.schema([*_FIELDS, *([("ids", pa.binary())] if with_ids else [])])
    whole = TIERS[0]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, pool = encoder(tokenizer), np.array([end_id], dtype="<u4"), _Pool()
        base = TaskContext.get().partitionId() << 40
        made = steps = 0
        open_steps: dict[int, list[list[_Piece]]] = {}
        columns: list[list] = [[] for _ in schema]

        def close(step: list[tuple[int, list[_Piece]]]) -> None:
            nonlocal made, steps
            for tier, window in step:
                offset = 0
                for p in window:
                    values = [p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids), p.total, base + made, offset, tier, base + steps]
                    for column, v in zip(columns, [*values, p.ids.tobytes()], strict=False):
                        column.append(v)
                    offset += len(p.ids)
                made += 1
            steps += 1

        def put(tier: int, window: list[_Piece]) -> None:
            step = open_steps.setdefault(tier, [])
            step.append(window)
            if len(step) * tier >= STEP_TOKENS:
                close([(tier, w) for w in open_steps.pop(tier)])

        def close_all() -> None:
            # sizes are powers of two: in falling order they fill every step but the last
            step, held = [], 0
            for tier in sorted(open_steps, reverse=True):
                for window in open_steps[tier]:
                    step.append((tier, window))
                    held += tier
                    if held >= STEP_TOKENS:
                        close(step)
                        step, held = [], 0
            if step:
                close(step)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            for c in columns:
                c.clear()
            return out

        def texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                ends, ids = enc.lists(part.column("text"))
                for name, a, b in zip(part.column("doc_id").to_pylist(), ends[:-1], ends[1:], strict=True):
                    yield name, np.concatenate((ids[a:b], end))

        waiting = 0
        for batch in batches:
            for name, ids in texts(batch):
                full = len(ids) - len(ids) % whole
                for a in range(0, full, whole):
                    put(whole, [_Piece(name, a, ids[a : a + whole].copy(), len(ids))])
                if full < len(ids):
                    pool.add(_Piece(name, full, ids[full:].copy(), len(ids)))
                    waiting += 1
                if waiting >= POOL:
                    for tier, window in pool.windows(last=False):
                        put(tier, window)
                    waiting = 0
                if len(columns[0]) >= 5000:
                    yield flush()
        for tier, window in pool.windows(last=True):
            put(tier, window)
        close_all()
        yield flush()

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long" + ", ids binary" * with_ids
    return narrow.mapInArrow(packed, ddl)
