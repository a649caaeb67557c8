"""Packing: sum-of-squares online packing of documents into token windows.

A document is its ids and an end id. Whole windows of it are cut off at once; the piece that is left goes to the fill
level h (0 is a new window) for which the sum over levels of squared counts of partially filled windows becomes
least, and a level array holds these counts. A task packs its own documents in reading order, holds a bounded number of
open windows, and hands on closed ones in batches of bounded bytes; nothing is shuffled. When more would be open (documents of
half a window and more find no partners), and when the documents end, the emptiest open windows are cut up to fill the fullest.
The one window that stays partly filled at the end is cut at powers of two, where no padding is needed.

Defined results: null and empty texts are the end id alone; each repeated row is a document of its own; an empty
table gives no piece. sequence_id is the number of the task and a number in it, so it is the same whenever the table
is read in the same splits; a retried task gives the same rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewright.llm import _common as C

WINDOW = 1024
#: Windows that a task holds open at most.
MOST_OPEN = 4096
#: Rows of an output batch, and bytes of its ids (one piece, if a window has more), at most.
_ROWS, _BYTES = 8192, 1 << 21


class Tokenizer:
    """Ids of a byte-level BPE file of the tokenizers library, special strings in a text handled as by its default.

    The file's vocabulary is run by tiktoken, which gives the same ids several times as fast; texts that it refuses
    (such as a very long run of one kind of character) go to the tokenizers library itself.
    """

    #: Fixed value: the pattern of byte-level pre-tokens.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    #: A text with a longer run without a change between blank and other characters goes to the library.
    LONGEST_RUN = 20_000

    def __init__(self, path: str):
        import json
        import re

        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        special, vocab = {t["content"]: t["id"] for t in whole["added_tokens"]}, whole["model"]["vocab"]
        back = _byte_of_character()
        ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in special}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        self.long_run = re.compile(rf"\s{{{self.LONGEST_RUN}}}|\S{{{self.LONGEST_RUN}}}")

    @cached_property
    def library(self):
        """The tokenizers library's own; few texts need it."""
        import tokenizers

        t = tokenizers.Tokenizer.from_file(self.path)
        t.no_truncation()
        t.no_padding()
        return t

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if len(text) < self.LONGEST_RUN or not self.long_run.search(text):
            return np.asarray(self.fast.encode(text, allowed_special=self.special, disallowed_special=()), np.uint32)
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


def _byte_of_character() -> dict[str, int]:
    """The characters that stand for bytes in such files: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Packer:
    """Piece = (row, start, ids); emits (row, start, ids, sequence, offset) as windows close."""

    def __init__(self, window: int = WINDOW, most_open: int = MOST_OPEN):
        self.window, self.most_open, self.n_open = window, most_open, 0
        self.counts = np.zeros(window, np.int64)  # of open windows by level
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.sequences = 0
        self.out: list[tuple] = []

    def add(self, row, ids: np.ndarray) -> None:
        whole = len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            self._emit([(row, start, ids[start : start + self.window])])
        if whole < len(ids):
            self.place((row, whole, ids[whole:].copy() if whole else ids))  # a view would keep the whole document as long as its window is open

    def level(self, size: int) -> int:
        """The fill level to which a piece of this size goes; the fullest of equally good ones."""
        top = self.window - size  # the highest level with room
        n = self.counts
        change = np.empty(top + 1, np.int64)  # of the sum of squares
        change[1:] = 2 - 2 * n[1 : top + 1]
        change[:top] += 2 * n[size:]
        change[top] -= 1 if top else 0  # a window that becomes full leaves the sum
        change[0] = 2 * n[size] + 1
        change[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def place(self, piece: tuple) -> None:
        size = len(piece[2])
        h = self.level(size)
        window = self._take(h) if h else []
        window.append(piece)
        self._put(window, h + size)
        if self.n_open > self.most_open:
            while self.n_open > max(1, self.most_open // 2):
                self._merge()

    def _take(self, level: int) -> list:
        self.counts[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _put(self, window: list, level: int) -> None:
        if level == self.window:
            self._emit(window)
        elif level:
            self.counts[level] += 1
            self.n_open += 1
            self.open[level].append(window)

    def _merge(self) -> None:
        """Fills the fullest open window from the emptiest one, whose last piece is cut where it doesn't fit; one window fewer is open."""
        used = np.flatnonzero(self.counts)
        full, low = int(used[-1]), int(used[0])
        window, donors = self._take(full), self._take(low)
        gap = self.window - full
        kept = deque(donors)
        while gap and kept:
            row, start, ids = kept.popleft()
            window.append((row, start, ids[:gap]))
            if len(ids) > gap:
                kept.appendleft((row, start + gap, ids[gap:]))
            gap -= min(gap, len(ids))
        self._put(window, self.window - gap)
        self._put(list(kept), max(0, low + full - self.window))

    def finish(self) -> None:
        """Closes all open windows; one at most was not full, and is cut at powers of two."""
        while self.n_open > 1:
            self._merge()
        left = int(np.flatnonzero(self.counts)[0]) if self.n_open else 0
        pieces = deque(self._take(left) if left else ())
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            part = []
            while size:
                row, start, ids = pieces.popleft()
                part.append((row, start, ids[:size]))
                if len(ids) > size:
                    pieces.appendleft((row, start + size, ids[size:]))
                size -= min(size, len(ids))
            self._emit(part)

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for row, start, ids in pieces:
            self.out.append((row, start, ids, self.sequences, offset))
            offset += len(ids)
        self.sequences += 1


def pack(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """One row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids as binary.

    Sequences are filled from offset 0 without a gap; a sequence that is neither full nor a power of two long would be padded.
    """
    source = docs.select(key, text)
    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([source.schema[key], *(T.StructField(n, T.LongType()) for n in longs), T.StructField("ids", T.BinaryType())])
    most = max(1, min(_ROWS, _BYTES // (4 * window)))

    def run(batches):
        from pyspark import TaskContext

        cache = C.worker_cache()
        if ("tokenizer", path) not in cache:
            cache["tokenizer", path] = Tokenizer(path)
        tokenizer, packer = cache["tokenizer", path], Packer(window)
        first = TaskContext.get().partitionId() << 40
        end = np.array([end_id], np.uint32)
        kind = None

        def batches_of(found):
            for i in range(0, len(found), most):
                rows = found[i : i + most]
                parts = [ids.astype("<u4").tobytes() for _, _, ids, _, _ in rows]
                cols = [[start for _, start, *_ in rows], [len(p) // 4 for p in parts], [zlib.crc32(p) for p in parts], [row[1] for row, *_ in rows], [first + s for *_, s, _ in rows], [o for *_, o in rows]]
                yield pa.RecordBatch.from_arrays([pa.array([row[0] for row, *_ in rows], kind), *(pa.array(c, pa.int64()) for c in cols), pa.array(parts, pa.binary())], names=schema.names)

        for b in batches:
            kind = b.column(key).type
            for k, t in zip(b.column(key).to_pylist(), b.column(text), strict=True):
                ids = np.concatenate([tokenizer.ids(t.as_py()), end])
                packer.add((k, len(ids)), ids)
                if len(packer.out) >= most:
                    found, packer.out = packer.out, []
                    yield from batches_of(found)
        packer.finish()
        yield from batches_of(packer.out)

    return C.map_arrow(source, run, schema)
