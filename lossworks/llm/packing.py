"""Packing token sequences: bounded-space online best-fit.

Each partition keeps a fixed number of open windows. A document's full windows go out at once; its rest goes to the open
window that it fills best; when none has room, the fullest is emitted and a new one opened. What is still open at a
partition's end is merged: leftovers of a bounded number of partitions meet in one task and are strung together, cut
where a window is full.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossworks.llm.common import documents, written

WINDOW = 2048
OPEN_WINDOWS = 64
END_ID = 1
#: Partitions whose leftovers one task merges: at most this many times OPEN_WINDOWS windows.
MERGED_PARTITIONS = 64
#: Encoded words that one Python worker remembers at most, about 200 bytes each.
REMEMBERED = 300_000

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
SEQUENCE_BITS = 33


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A word of Latin-1 letters with ASCII signs behind it: what the tokenizer splits in two, lower-cases and leaves else.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: 256 + n for n, b in enumerate(rest)}


# The steps of a tokenizer whose texts may be cut at blanks, and how it splits words.
NORMALIZERS, SPLITTERS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def drops_blanks(tokenizer: dict) -> bool:
    """Whether a tokenizer (its JSON) is of the build that ``Encoder`` cuts into parts and plain words."""
    steps, splits = (tokenizer.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
    own = [x["type"] for x in steps.get("normalizers", [])], [x["type"] for x in splits.get("pretokenizers", [])]
    if own != (NORMALIZERS, SPLITTERS) or tokenizer["model"].get("type") != "BPE" or tokenizer["model"].get("end_of_word_suffix") != "</w>":
        return False
    return splits["pretokenizers"][0].get("pattern", {}).get("Regex") == SPLIT and not splits["pretokenizers"][1].get("add_prefix_space")


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    A tokenizer of the known build drops white space before it merges, so the ids of a text are those of its blank-separated
    parts in order. A part is encoded once and remembered, up to ``REMEMBERED`` of them; later new ones are encoded each
    time. Plain words go straight to the tokenizer's merges, all others through the whole tokenizer. Any other tokenizer
    gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {"": b""}
        self.merge, self.letters = self.tokenizer.model.tokenize, byte_letters()
        self.by_parts = drops_blanks(json.loads(self.tokenizer.to_str()))

    def ids(self, part: str) -> bytes:
        if not (plain := PLAIN.fullmatch(part)):
            return self.packed(self.tokenizer.encode(part, add_special_tokens=False).ids)
        word, signs = plain.groups()
        return self.merged(word.lower()) + (self.merged(signs) if signs else b"")

    def merged(self, piece: str) -> bytes:
        if (found := self.known.get(piece)) is None:
            letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            found = self.packed([t.id for t in self.merge(letters)])
            if len(self.known) < REMEMBERED:
                self.known[piece] = found
        return found

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if not self.by_parts:
            return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts, known = text.replace("\n", " ").split(" "), self.known
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            new = {x: self.ids(x) for x in set(parts) if x not in known}
            if len(known) < REMEMBERED:
                known.update(new)
                return b"".join(map(known.__getitem__, parts))
            return b"".join([known[x] if x in known else new[x] for x in parts])


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, whatever number of tasks it runs."""
    return Encoder(path)


class Windows:
    """The open windows of a task, by fill; ``full`` collects what is emitted, as (window, pieces)."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.fills, self.pieces, self.made, self.full = size, most, [], {}, 0, []

    def add(self, piece: tuple, length: int) -> None:
        """``piece`` to the fullest window with room for it."""
        at = bisect_left(self.fills, (self.size - length + 1, -1)) - 1
        if at < 0:
            if len(self.fills) >= self.most:
                self.emit(self.fills.pop()[1])
            fill, window = 0, self.made
            self.made += 1
            self.pieces[window] = []
        else:
            fill, window = self.fills.pop(at)
        self.pieces[window].append((fill, piece))
        if fill + length == self.size:
            self.emit(window)
        else:
            insort(self.fills, (fill + length, window))

    def emit(self, window: int) -> None:
        self.full.append((window, self.pieces.pop(window)))

    def whole(self, piece: tuple) -> None:
        self.full.append((self.made, [(0, piece)]))
        self.made += 1

    def taken(self) -> list:
        out, self.full = self.full, []
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECE.split(", ")]
    kinds = [pa.binary() if n == "ids" else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _pack(path: str, window: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, open_ = encoder(path), Windows(window, most)
        end, step = np.array([END_ID], dtype="<u4").tobytes(), 4 * window

        def rows(found, kept):
            for number, pieces in found:
                for offset, (doc, start, ids, total) in pieces:
                    yield doc, start, len(ids) // 4, zlib.crc32(ids), total, (part << SEQUENCE_BITS) + number, offset, ids if kept else None

        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                cut = len(ids) - len(ids) % step
                for at in range(0, cut, step):
                    open_.whole((doc, at // 4, ids[at : at + step], total))
                if cut < len(ids):
                    open_.add((doc, cut // 4, ids[cut:], total), (len(ids) - cut) // 4)
                out.extend(rows(open_.taken(), False))
            if out:
                yield _batch(out)
        for _, number in open_.fills:
            open_.emit(number)
        if left := [*rows(open_.taken(), True)]:
            yield _batch(left)

    return run


def _merge(window: int):
    """Leftover pieces of a group, strung together in order and cut where a window is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, number, filled = None, 0, 0
        for batch in batches:
            out: list[tuple] = []
            for doc, start, total, ids, own in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "start", "doc_tokens", "ids", "_group")), strict=True):
                if own != group:
                    group, number, filled = own, 0, 0
                at = 0
                while at < len(ids):
                    piece = ids[at : at + 4 * (window - filled)]
                    # group's own range of ids: the sign bit's neighbour keeps it apart from the partitions' ids
                    out.append((doc, start + at // 4, len(piece) // 4, zlib.crc32(piece), total, (1 << 62) + (own << SEQUENCE_BITS) + number, filled, None))
                    at += len(piece)
                    filled += len(piece) // 4
                    if filled == window:
                        number, filled = number + 1, 0
            if out:
                yield _batch(out)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text is the end id alone. Repeated rows are packed each by itself, a null ``doc_id`` is carried
    along, an empty table gives no rows. Memory per task: one batch of texts, the open windows and the remembered words.
    The pieces are written once (to the shared folder), with ids only for those still open, so texts are encoded once and
    a lost executor repeats no more than its own partition; the leftovers, bounded by partitions times open windows, are
    then dealt to tasks of ``MERGED_PARTITIONS`` partitions each and sorted there, so that reruns agree.
    """
    run = _pack(tokenizer or default_tokenizer(), window, open_windows)
    pieces = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE), "pieces")
    left = (
        pieces.filter("ids is not null")
        .withColumn("_group", F.shiftright(F.shiftright("sequence_id", SEQUENCE_BITS), MERGED_PARTITIONS.bit_length() - 1))
        .repartition("_group")
        .sortWithinPartitions("_group", F.desc("sequence_id"), "offset")
        .select("doc_id", "start", "doc_tokens", "ids", "_group")
    )
    merged = left.mapInArrow(_merge(window), PIECE)
    return pieces.filter("ids is null").unionByName(merged).drop("ids")


def op4(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
