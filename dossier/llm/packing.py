"""Hierarchical packing of token sequences for several context sizes.

Each task tokenises its documents and packs them as they come, so nothing is shuffled. A document gives whole
windows of the longest tier first; what is left is routed to the shortest tier that holds it. The tiers are
packed from the longest down: a fragment opens a window of its tier, the gap is filled with the largest fragments of the
shorter tiers that fit, and the last rest of the gap with a cut from the next larger fragment. So every window is
full. What remains at the end of a task is cut at powers of two. Windows are then put into step groups of
GROUP_TOKENS tokens, of one tier as long as there are enough of it, so that all steps cost the same.

A null text counts as empty; an empty document still has its end token. Repeated rows are packed as often as they
occur, a null id is carried along. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import sys
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from dossier.llm.base import query, table

TIERS = (256, 512, 1024, 2048)
END_ID = 1
GROUP_TOKENS = 16 * 2048
BUFFER_TOKENS = 1 << 19
CACHED_BYTES = 24 << 20  # chunks remembered by a worker, with 160 bytes a chunk for the two objects

PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, tier int, step_group bigint")


class _Chunks(dict):
    """Ids, as bytes, of a space and the chunk after it. Chunks that don't stand alone raise LookupError."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.size = 0

    def __missing__(self, chunk: str) -> bytes:
        if not stands_alone(chunk):
            raise LookupError
        ids = self[chunk] = self.encode(" " + chunk)
        self.size += len(chunk) + len(ids) + 160
        return ids

    def clear(self) -> None:
        super().clear()
        self.size = 0


def stands_alone(chunk: str) -> bool:
    """Whether the pre-tokeniser surely cuts at the single spaces on both sides of it."""
    return bool(chunk) and ("!" <= chunk[0] <= "~" or chunk[0].isalnum()) and ("!" <= chunk[-1] <= "~" or chunk[-1].isalnum())


class Encoder:
    """Ids of a byte-level vocabulary given both as a tokenizers file and as ranks.

    Texts are cut at single spaces, where this vocabulary's pre-tokeniser always cuts, and the ids of each chunk are
    remembered. Texts with other spacing go through the ranks whole, texts that hold a special token's string through
    the tokenizers file.
    """

    def __init__(self, name: str = "byte_bpe_50k", folder: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        at = (lambda n: f"{folder}/{n}") if folder else public_tokenizers.path
        self.whole = Tokenizer.from_file(at(f"{name}.json"))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(at(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = lambda text: np.array(coder.encode_ordinary(text), "<u4").tobytes()
        self.chunks = _Chunks(self.encode)

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        if rest and not stands_alone(first):
            return self.encode(text)
        if self.chunks.size > CACHED_BYTES:
            self.chunks.clear()
        try:
            return self.encode(first) + b"".join(map(self.chunks.__getitem__, rest))
        except LookupError:
            return self.encode(text)


_ENCODERS: dict = {}


def encoder(name: str, folder: str | None) -> Encoder:
    if (name, folder) not in _ENCODERS:
        _ENCODERS[name, folder] = Encoder(name, folder)
    return _ENCODERS[name, folder]


class Packer:
    """Packs the documents of one task; windows come out as lists of pieces."""

    def __init__(self, tiers=TIERS, buffer_tokens=BUFFER_TOKENS):
        self.tiers, self.longest, self.buffer_tokens = sorted(tiers), max(tiers), buffer_tokens
        self.pool: list[tuple[int, int, int]] = []  # (length, start, document), in order
        self.docs: dict[int, list] = {}  # document: [id, ids, length, fragments in the pool]
        self.next = self.waiting = 0

    def piece(self, doc: int, start: int, length: int) -> tuple:
        doc_id, ids, total, _ = self.docs[doc]
        return doc_id, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), total

    def put(self, length: int, start: int, doc: int) -> None:
        if length:
            insort(self.pool, (length, start, doc))
            self.docs[doc][3] += 1
            self.waiting += length

    def take(self, at: int) -> tuple[int, int, int]:
        length, start, doc = self.pool.pop(at)
        self.docs[doc][3] -= 1
        self.waiting -= length
        return length, start, doc

    def tier_of(self, length: int) -> int:
        return self.tiers[bisect_left(self.tiers, length)]

    def add(self, doc_id, ids: bytes) -> Iterator[tuple[int, list]]:
        n, doc = len(ids) // 4, self.next
        self.next += 1
        self.docs[doc] = [doc_id, ids, n, 0]
        whole = n // self.longest * self.longest
        for start in range(0, whole, self.longest):
            yield self.longest, [self.piece(doc, start, self.longest)]
        if n > whole:
            self.put(n - whole, whole, doc)
        else:
            del self.docs[doc]
        if self.waiting >= self.buffer_tokens:
            yield from self.pack()

    def pack(self, last: bool = False) -> Iterator[tuple[int, list]]:
        """Full windows, longest fragments first; at the end also the rest, cut at powers of two."""
        while self.pool and (last or self.waiting >= self.longest):
            parts = [self.take(-1)]
            size = self.tier_of(parts[0][0])
            gap = size - parts[0][0]
            while gap and self.pool:
                fits = bisect_right(self.pool, (gap, sys.maxsize, sys.maxsize)) - 1
                if fits >= 0:
                    parts.append(self.take(fits))
                    gap -= parts[-1][0]
                else:
                    length, start, doc = self.take(0)
                    parts.append((gap, start, doc))
                    self.put(length - gap, start + gap, doc)
                    gap = 0
            yield from [(size, parts)] if not gap else self.rest(parts)
        if not last:
            self.docs = {k: v for k, v in self.docs.items() if v[3]}

    def rest(self, parts: list) -> Iterator[tuple[int, list]]:
        total = sum(p[0] for p in parts)
        while total:
            size = 1 << (total.bit_length() - 1)
            window, need = [], size
            while need:
                length, start, doc = parts.pop(0)
                window.append((min(length, need), start, doc))
                if length > need:
                    parts.insert(0, (length - need, start + need, doc))
                need -= min(length, need)
            total -= size
            yield size, window

    def windows(self, documents: Iterator[tuple]) -> Iterator[tuple[int, list]]:
        def named(found):
            for size, parts in found:
                yield size, [p if len(p) == 5 else self.piece(p[2], p[1], p[0]) for p in parts]

        for doc_id, ids in documents:
            yield from named(self.add(doc_id, ids))
        yield from named(self.pack(last=True))


def in_steps(windows: Iterator[tuple[int, list]], group_tokens: int) -> Iterator[tuple[int, int, list]]:
    """(step, size, pieces): steps of group_tokens, of one window size while enough of it is there."""
    open_windows: dict[int, list] = {}
    step = 0
    for size, pieces in windows:
        mine = open_windows.setdefault(size, [])
        mine.append(pieces)
        if size * len(mine) >= group_tokens:
            yield from ((step, size, p) for p in mine)
            mine.clear()
            step += 1
    held = 0
    for size in sorted(open_windows, reverse=True):
        for pieces in open_windows[size]:
            if held + size > group_tokens:
                step, held = step + 1, 0
            held += size
            yield step, size, pieces


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str | None = None, tiers=TIERS,
         group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece of a document, with its place in a sequence and the sequence's tier and step group."""
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches):
        coder, task = encoder(tokenizer, folder), TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4").tobytes()

        def documents():
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    yield doc_id, coder.ids(text.as_py()) + end

        rows: list[tuple] = []
        for n, (step, size, pieces) in enumerate(in_steps(Packer(tiers).windows(documents()), group_tokens)):
            offset = 0
            for doc_id, start, length, crc, total in pieces:
                rows.append((doc_id, start, length, crc, total, task << 40 | n, offset, size, task << 40 | step))
                offset += length
            if len(rows) >= 20_000:
                yield _batch(rows, names)
                rows = []
        if rows:
            yield _batch(rows, names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int32() if n == "tier" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)]
    return pa.RecordBatch.from_arrays(columns, names)


@query("op4_packing")
def op4_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
