"""Vector bin packing of tokenized examples into sequences.

Each example asks for a vector of room: tokens, segments (one) and
loss-bearing tokens. Every Spark task packs the rows of its own partition; it
keeps a bounded set of open sequences and puts an example into the one whose
free room has the largest dot product with what the example asks for. An
example that fits nowhere is cut to fill the fullest sequence, so that tasks
hold little in memory and only a task's last sequences are not full. Those are
packed anew and then cut at powers of two, which need no padding.

Tasks never exchange rows: there is no shuffle, and a task that runs again
gives the same pieces.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PreTokenized, Remembered
from .common import read_table

#: Sequences that a task holds open.
OPEN = 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"

_encoders: dict = {}


def _encoder(tokenizer: str, end_id: int) -> Callable[[str], bytes]:
    """text -> its ids and end_id, as little-endian unsigned 32-bit numbers."""
    if (tokenizer, end_id) not in _encoders:
        bpe, end = PreTokenized(tokenizer), np.array([end_id], "<u4").tobytes()
        pack = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
        if bpe.known:
            table = Remembered(lambda p: pack(bpe.piece_ids(p)))

            def encode(text: str) -> bytes:
                keys = bpe.words(text) if bpe.fold else None
                return b"".join(map(table.__getitem__, bpe.pieces(text) if keys is None else keys)) + end

            _encoders[tokenizer, end_id] = encode
        else:
            _encoders[tokenizer, end_id] = lambda text: pack(bpe.ids(text)) + end
    return _encoders[tokenizer, end_id]


class Packer:
    """Packs (doc, ids, loss share) examples; `done` collects the pieces of closed sequences.

    room: limits on tokens, segments and loss-bearing tokens of one sequence.
    """

    def __init__(self, room: tuple[int, int, int], first_id: int):
        self.room = np.array(room, dtype=np.float64)
        self.tokens, self.segments = int(room[0]), int(room[1])
        self.next_id, self.done = first_id, []
        self.free = np.tile(self.room, (OPEN, 1))
        self.held: list[list[tuple]] = [[] for _ in range(OPEN)]

    def add(self, doc, ids: bytes, loss: int, mask_from_end: bool = True) -> None:
        """Place a document of len(ids) / 4 tokens, of which the last `loss` bear loss."""
        total = len(ids) // 4
        start, left = 0, total
        unmasked = total - loss  # the tokens before this one bear no loss
        while left:
            ask = min(left, self.tokens)
            bears = self._loss(start, ask, unmasked)
            if bears > self.room[2]:
                ask = self._cut(start, ask, unmasked, self.room[2])
                bears = self._loss(start, ask, unmasked)
            need = np.array((ask, 1, bears), dtype=np.float64)
            fits = (self.free >= need).all(axis=1)
            if fits.any():
                score = (self.free / self.room) @ (need / self.room)
                at = int(np.argmax(np.where(fits, score, -np.inf)))
            else:  # fill up the sequence that has least room left, and go on with the rest
                at = int(np.argmin(self.free[:, 0] + 1e9 * (self.free[:, 1] < 1)))
                if self.free[at, 1] < 1 or self.free[at, 0] < 1 or self.free[at, 2] < 1:
                    self._close(int(np.argmin(self.free[:, 1] * self.free[:, 0])))
                    continue
                ask = min(ask, int(self.free[at, 0]))
                ask = self._cut(start, ask, unmasked, self.free[at, 2])
                if not ask:
                    self._close(at)
                    continue
                need = np.array((ask, 1, self._loss(start, ask, unmasked)), dtype=np.float64)
            self.held[at].append((doc, start, ask, ids[4 * start : 4 * (start + ask)], total, int(need[2])))
            self.free[at] -= need
            start, left = start + ask, left - ask
            if not self.free[at, 0]:
                self._close(at)

    @staticmethod
    def _loss(start: int, n: int, unmasked: int) -> int:
        return max(0, start + n - max(start, unmasked))

    def _cut(self, start: int, n: int, unmasked: int, most: float) -> int:
        return min(n, max(0, unmasked - start) + int(most))

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, n, ids, total, loss in pieces:
            self.done.append((doc, start, n, zlib.crc32(ids), total, self.next_id, at, loss))
            at += n
        self.next_id += 1

    def _close(self, at: int) -> None:
        self._cut_at_powers(self.held[at])
        self.held[at], self.free[at] = [], self.room

    def _cut_at_powers(self, pieces: list[tuple]) -> None:
        """Emit the pieces as sequences whose lengths are powers of two, largest first: none is padded."""
        pieces = pieces[::-1]
        left = sum(p[2] for p in pieces)
        while left:
            size = min(self.tokens, 1 << (left.bit_length() - 1)) if left != self.tokens else self.tokens
            now, room = [], size
            while room:
                doc, start, n, ids, total, loss = pieces.pop()
                take = min(n, room)
                bear = max(0, loss - (n - take))
                now.append((doc, start, take, ids[: 4 * take], total, min(loss, bear)))
                if take < n:
                    pieces.append((doc, start + take, n - take, ids[4 * take :], total, loss - min(loss, bear)))
                room -= take
            self._emit(now)
            left -= size

    def close_all(self) -> None:
        """Pack what is still open into as few sequences as the limits allow, and cut the last."""
        rest = sorted((p for held in self.held for p in held), key=lambda p: -p[2])
        self.held, self.free = [[] for _ in range(OPEN)], np.tile(self.room, (OPEN, 1))
        bag, size, segments, loss = [], 0, 0, 0
        for piece in rest:
            while piece:
                doc, start, n, ids, total, bear = piece
                quiet = n - bear
                take = min(n, self.tokens - size, quiet + int(self.room[2]) - loss)
                if take <= 0 or segments >= self.segments:
                    self._cut_at_powers(bag)
                    bag, size, segments, loss = [], 0, 0, 0
                    continue
                took = max(0, take - quiet)
                bag.append((doc, start, take, ids[: 4 * take], total, took))
                size, segments, loss = size + take, segments + 1, loss + took
                piece = (doc, start + take, n - take, ids[4 * take :], total, bear - took) if take < n else None
        self._cut_at_powers(bag)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    max_tokens: int = 4096,
    max_segments: int = 1024,
    max_loss: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    loss_share_col: str | None = None,
) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence (see SCHEMA).

    A sequence holds at most max_tokens ids, max_segments pieces and max_loss
    loss-bearing ids. loss_share_col (0 to 1, null: 1) is the share of a
    document's ids, counted from its end, that bear loss, as an answer after a
    prompt does; without it all do.
    A null or empty text still has its end id. Repeated rows and null ids are
    packed like any others. No rows give no rows. Other columns are ignored.
    """
    room = (max_tokens, max_segments, max_loss or max_tokens)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode = _encoder(tokenizer, end_id)
        packer = Packer(room, TaskContext.get().partitionId() << 40)
        columns = [c.split()[0] for c in SCHEMA.split(", ")]

        def out():
            rows, packer.done = packer.done, []
            return pd.DataFrame({c: pd.array(v, dtype="Int64") for c, v in zip(columns, zip(*rows))})

        for batch in batches:
            for doc, text, share in zip(batch["doc_id"], batch["text"], batch["share"]):
                ids = encode(text or "")
                n = len(ids) // 4
                packer.add(None if pd.isna(doc) else int(doc), ids, n if pd.isna(share) else round(n * min(max(share, 0.0), 1.0)))
                if len(packer.done) >= 20_000:
                    yield out()
        packer.close_all()
        if packer.done:
            yield out()

    share = F.col(loss_share_col).cast("double") if loss_share_col else F.lit(1.0)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), share.alias("share")).mapInPandas(run, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
