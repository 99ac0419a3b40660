"""Bounded-space online packing of token sequences.

Each task keeps a fixed number of open windows.  A piece goes to the open
window it fills best; when it fits none, the fullest window takes the head
of the piece, is emitted full, and the rest of the piece is placed again.
At the end of a partition the open windows are run together, which leaves
at most one partial window a partition; these are then merged, whole,
across partitions by best fit in groups of bounded size.

Defined cases: a null text counts as empty, and an empty text still has its
end id; a document longer than a window is cut; repeated rows are packed as
often as they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from .encoder import encoder, in_parts

WINDOW = 2048
OPEN_WINDOWS = 16
END_ID = 1
#: Partial windows that one task of the last merge looks at.
MERGE_GROUP = 256

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean"


class Windows:
    """The open windows of one partition."""

    def __init__(self, first_id: int, size: int = WINDOW, most: int = OPEN_WINDOWS):
        self.size, self.most, self.next_id = size, most, first_id
        self.open: list[list] = []  # [tokens, pieces]
        self.out: list[tuple] = []

    def _emit(self, pieces: list, partial: bool = False) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) >> 2
            self.out.append((doc, start, n, zlib.crc32(ids), total, self.next_id, at, partial))
            at += n
        self.next_id += 1

    def add(self, doc, ids: bytes) -> None:
        self._place(doc, 0, ids, len(ids) >> 2)

    def _place(self, doc, start: int, ids: bytes, total: int) -> None:
        while ids:
            n = len(ids) >> 2
            if n >= self.size:
                self._emit([(doc, start, ids[: 4 * self.size], total)])
                start, ids = start + self.size, ids[4 * self.size :]
                continue
            fits = [w for w in self.open if w[0] + n <= self.size]
            if fits:
                best = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.most:
                best = [0, []]
                self.open.append(best)
            else:
                best = max(self.open, key=lambda w: w[0])
            room = self.size - best[0]
            head, ids = ids[: 4 * room], ids[4 * room :]
            best[1].append((doc, start, head, total))
            best[0] += len(head) >> 2
            start += len(head) >> 2
            if best[0] == self.size:
                self._emit(best[1])
                self.open.remove(best)

    def close(self) -> None:
        """Run the open windows together; the last partial one is marked open."""
        left = sorted(self.open, key=lambda w: -w[0])
        self.open, self.most = [], 1
        for _, pieces in left:
            for doc, start, ids, total in pieces:
                self._place(doc, start, ids, total)
        for _, pieces in self.open:
            self._emit(pieces, partial=True)
        self.open = []

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _packer(tokenizer: str, size: int, most: int):
    names = [c.split()[0] for c in PIECES.split(", ")]
    types = [pa.bool_() if c == "open" else pa.int64() for c in names]

    def pack(batches):
        gc.disable()  # the caches hold no cycles, and walking them is slow
        enc, end = encoder(tokenizer), np.array([END_ID], "<u4").tobytes()
        windows = Windows(TaskContext.get().partitionId() << 32, size, most)

        def rows():
            got = zip(*windows.taken()) if windows.out else [[]] * len(names)
            return pa.record_batch([pa.array(list(x), t) for x, t in zip(got, types)], names)

        for batch in batches:
            docs, texts = (batch.column(k).to_pylist() for k in range(2))
            for at, part in in_parts(texts):
                for doc, ids in zip(docs[at : at + len(part)], enc.ids_of(part), strict=True):
                    windows.add(doc, ids + end)
            yield rows()
        windows.close()
        yield rows()

    return pack


def _merge_group(size: int):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """Best fit, largest first: each partial window is moved whole behind another."""
        out, bins = [], []  # bins: [tokens, id]
        for r in pdf.sort_values(["tokens", "sequence_id"], ascending=[False, True]).itertuples():
            fits = [b for b in bins if b[0] + r.tokens <= size]
            if fits:
                best = max(fits, key=lambda b: b[0])
            else:
                best = [0, r.sequence_id]
                bins.append(best)
            out.append((r.sequence_id, best[1], best[0]))
            best[0] += r.tokens
        return pd.DataFrame(out, columns=["sequence_id", "merged_id", "base"])

    return merge


def pack_documents(docs: DataFrame, tokenizer: str, size: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pieces of documents, placed in sequences of at most ``size`` tokens.

    Needs columns doc_id and text.  Returns doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset.  Only these figures are shuffled, never texts
    or ids.
    """
    packed = docs.select("doc_id", "text").mapInArrow(_packer(tokenizer, size, open_windows), PIECES)
    packed = C.stored(packed, "packed")
    partial = packed.where("open").groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
    group = F.shiftright("sequence_id", 32) / MERGE_GROUP
    moved = (
        partial.groupBy(F.floor(group).alias("part"))
        .applyInPandas(_merge_group(size), "sequence_id long, merged_id long, base long")
    )
    left = packed.where("open").join(moved, "sequence_id").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("merged_id").alias("sequence_id"),
        (F.col("offset") + F.col("base")).alias("offset"),
    )
    return packed.where("not open").drop("open").unionByName(left)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed with the public word-level vocabulary."""
    import public_tokenizers

    return pack_documents(C.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op5_packing": op5_packing}
ORACLE_SQL: dict[str, str] = {}
