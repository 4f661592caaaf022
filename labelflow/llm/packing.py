"""Sum-of-squares online packing of tokenised documents into windows.

Method. Every task packs its own documents as they arrive. A document's ids are cut into full
windows and one rest. The level array N counts the open windows of every fill level. A rest of r
ids goes to the level h (0: a new window) for which the sum of N[level]**2 over the partially
filled levels is smallest afterwards; moving a window from h to h + r changes that sum by
1 - 2 N[h] (for h > 0) plus 1 + 2 N[h + r] (unless h + r is full), so all levels are compared in
one numpy pass. After ``EPOCH`` rests, and at the end of a task, open windows are closed: the
emptiest are cut to fill the gaps of the fullest, which leaves one partial window; it is cut into
sequences whose lengths are powers of two, which need no padding. No shuffle, and memory is
bounded by one epoch.

Defined results: a null text is empty and gives one piece, the end id; a repeated row is packed
again; an empty table gives an empty result; null doc_ids are packed too; other columns are
ignored. Sequence ids are unique (task number, then a running number), not gapless.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import byte_chars, pieces_of, prepare

WINDOW = 2048
EPOCH = 20_000
END_ID = 1
SPECIAL = "<|endoftext|>"
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, sequence_tokens long")

_TOKENIZERS: dict = {}


class IdCoder:
    """Ids of a byte-level BPE vocabulary; strings of special tokens inside texts are those tokens.

    Whole texts are encoded at once: a memo of words costs more than encoding them again."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer
        model = json.loads(Tokenizer.from_file(path).to_str())
        back = {c: b for b, c in byte_chars().items()}
        ranks = {bytes(back[c] for c in tok): i for tok, i in model["model"]["vocab"].items() if tok != SPECIAL}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.enc = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        return self.enc.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype(np.uint16)


def coder(path: str) -> IdCoder:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = IdCoder(path)
    return _TOKENIZERS[path]


class Packer:
    """Open windows by fill level; ``out`` gets the pieces of closed windows."""

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.window, self.sequence, self.rests = window, first_sequence, 0
        self.count = np.zeros(window + 1, np.int64)  # the level array; level 0 and window hold none
        self.open: dict[int, list] = defaultdict(list)
        self.out: list[tuple] = []

    def close(self, pieces: list) -> None:
        """pieces: (doc_id, start, ids, doc_tokens) in the order of the window."""
        at, total = 0, sum(len(p[2]) for p in pieces)
        for doc, start, ids, n in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.sequence, at, total))
            at += len(ids)
        self.sequence += 1

    def level_for(self, r: int) -> int:
        w, n = self.window, self.count
        change = 2 * n[r:w + 1] + 1  # of the target levels r .. w
        change[w - r] = 0
        change[1:] += 1 - 2 * n[1:w - r + 1]
        change[1:][n[1:w - r + 1] == 0] = np.iinfo(np.int64).max
        return int(np.argmin(change))

    def add(self, doc, ids: np.ndarray) -> None:
        w, n = self.window, len(ids)
        cut = n - n % w
        for s in range(0, cut, w):
            self.close([(doc, s, ids[s:s + w], n)])
        if cut == n:
            return
        r, h = n - cut, self.level_for(n - cut)
        pieces = []
        if h:
            pieces = self.open[h].pop()
            self.count[h] -= 1
        pieces.append((doc, cut, ids[cut:].copy(), n))
        if h + r == w:
            self.close(pieces)
        else:
            self.open[h + r].append(pieces)
            self.count[h + r] += 1
        self.rests += 1
        if self.rests >= EPOCH:
            self.finish()

    def finish(self) -> None:
        """Close all open windows: fill the gaps of the fullest by cutting the emptiest."""
        w = self.window
        left = [p for h in sorted(self.open, reverse=True) for p in self.open[h]]
        lo, hi = 0, len(left) - 1
        while lo <= hi:
            pieces, lo = left[lo], lo + 1
            fill = sum(len(x[2]) for x in pieces)
            while fill < w and hi >= lo:
                if not left[hi]:
                    hi -= 1
                    continue
                doc, start, ids, n = left[hi].pop()
                take = min(len(ids), w - fill)
                pieces.append((doc, start, ids[:take], n))
                fill += take
                if take < len(ids):
                    left[hi].append((doc, start + take, ids[take:], n))
            if fill == w:
                self.close(pieces)
            elif fill:
                self._powers(pieces, fill)
        self.open.clear()
        self.count[:] = 0
        self.rests = 0

    def _powers(self, pieces: list, fill: int) -> None:
        """Cut the last window into sequences whose lengths are powers of two."""
        queue = list(pieces)
        while fill:
            size = 1 << (fill.bit_length() - 1)
            fill -= size
            now = []
            while size:
                doc, start, ids, n = queue[0]
                take = min(len(ids), size)
                now.append((doc, start, ids[:take], n))
                size -= take
                if take == len(ids):
                    queue.pop(0)
                else:
                    queue[0] = (doc, start + take, ids[take:], n)
            self.close(now)


def tokenised(path: str):
    """Arrow function for mapInArrow: tokenise and pack the documents of one task."""

    def run(batches):
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        packer, code = Packer(first), coder(path)
        for batch in batches:
            for part in pieces_of(batch):
                texts = [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                for doc, ids in zip(part.column(part.schema.get_field_index("doc_id")).to_pylist(), map(code.encode, texts)):
                    packer.add(doc, np.append(ids, np.uint16(END_ID)))
                yield from flushed(packer)
        packer.finish()
        yield from flushed(packer)

    return run


def flushed(packer: Packer):
    if packer.out:
        cols = list(zip(*packer.out))
        packer.out = []
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)


def pack(docs: DataFrame, path: str) -> DataFrame:
    """Pieces of all documents; ``path`` is the vocabulary file of a byte-level BPE with fewer than
    65,536 ids."""
    prepare(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(tokenised(path), SCHEMA)
