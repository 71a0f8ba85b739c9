"""Media columns: ISO base media files, written losslessly and read by walking their boxes.

The payload lies in ``mdat`` as raw 8-bit samples of one frame each; ``stsd`` names the codec, ``stts`` the durations,
``stsz`` the sizes, ``stsc`` and ``stco``/``co64`` the chunks, ``stss`` the keyframes. Reading decodes these tables only.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossworks.llm.common import documents

FRAME = 576
SIDE = 24
FRAMES_PER_CHUNK = 8
KEYFRAME_EVERY = 12
TIMESCALE = 1000
FRAME_TICKS = 40
#: Boxes that hold boxes.
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"))
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *body: bytes) -> bytes:
    size = 8 + sum(map(len, body))
    head = struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return b"".join((head, *body))


def full_box(kind: bytes, *body: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *body)


def table(values: np.ndarray, kind: str = ">u4") -> bytes:
    return values.astype(kind).tobytes()


def write_media(payload: bytes) -> bytes:
    """A file whose one video track holds ``payload``, a positive multiple of ``FRAME`` bytes, frame by frame."""
    n = len(payload) // FRAME
    chunks = -(-n // FRAMES_PER_CHUNK)
    last = n - (chunks - 1) * FRAMES_PER_CHUNK
    runs = [(1, FRAMES_PER_CHUNK, 1)] * (chunks > 1) + [(chunks, last, 1)] * (chunks == 1 or last != FRAMES_PER_CHUNK)
    top = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    data = len(top) + (8 if len(payload) + 8 < 1 << 32 else 16)
    starts = data + np.arange(chunks, dtype=np.int64) * FRAMES_PER_CHUNK * FRAME
    entry = box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1)
    )
    offsets = full_box(b"stco", struct.pack(">I", chunks), table(starts)) if starts[-1] < 1 << 32 else full_box(b"co64", struct.pack(">I", chunks), table(starts, ">u8"))
    keys = np.arange(1, n + 1, KEYFRAME_EVERY)
    samples = box(
        b"stbl",
        full_box(b"stsd", struct.pack(">I", 1), entry),
        full_box(b"stts", struct.pack(">III", 1, n, FRAME_TICKS)),
        full_box(b"stss", struct.pack(">I", len(keys)), table(keys)),
        full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full_box(b"stsz", struct.pack(">II", FRAME, n)),
        offsets,
    )
    ticks = n * FRAME_TICKS
    wide = ticks >= 1 << 32
    times = struct.pack(">QQIQ", 0, 0, TIMESCALE, ticks) if wide else struct.pack(">IIII", 0, 0, TIMESCALE, ticks)
    version = struct.pack(">I", wide << 24)
    track = struct.pack(">QQIIQ", 0, 0, 1, 0, ticks) if wide else struct.pack(">IIIII", 0, 0, 1, 0, ticks)
    movie = box(
        b"moov",
        box(b"mvhd", version, times, struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2)),
        box(
            b"trak",
            box(b"tkhd", struct.pack(">I", (wide << 24) | 3), track, bytes(8), struct.pack(">HHHH", 0, 0, 0, 0), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16)),
            box(
                b"mdia",
                box(b"mdhd", version, times, struct.pack(">HH", 0x55C4, 0)),
                full_box(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"),
                box(b"minf", full_box(b"vmhd", bytes(8), flags=1), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), samples),
            ),
        ),
    )
    return b"".join((top, box(b"mdat", payload), movie))


def walk(data: memoryview, start: int, end: int, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path, body start, body end) of every box, outer before inner. A box that runs beyond its parent ends the walk."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and body + 8 <= end:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            return
        yield (*path, kind), body, stop
        if kind in CONTAINERS:
            yield from walk(data, body, stop, (*path, kind))
        start = stop


class Unreadable(ValueError):
    """A file without a complete sample table; the message says what is missing."""


def tracks(data: memoryview) -> list[dict[bytes, tuple[int, int]]]:
    """Each track's boxes by kind, the first of a kind within its track, as (body start, body end)."""
    out: list[dict[bytes, tuple[int, int]]] = []
    for path, start, end in walk(data, 0, len(data)):
        if path[-1] == b"trak":
            out.append({})
        elif b"trak" in path:
            out[-1].setdefault(path[-1], (start, end))
    return out


def sample_sizes(data: memoryview, at: dict) -> np.ndarray:
    """The size of every sample, from ``stsz`` or the compact ``stz2`` (4, 8 or 16 bits each)."""
    if b"stsz" in at:
        start, end = at[b"stsz"]
        fixed, n = struct.unpack_from(">II", data[start:end], 4)
        sizes = np.full(n, fixed, dtype=np.int64) if fixed else np.frombuffer(data[start + 12 : start + 12 + 4 * n], dtype=">u4").astype(np.int64)
    elif b"stz2" in at:
        start, end = at[b"stz2"]
        bits, n = struct.unpack_from(">II", data[start:end], 4)
        raw = np.frombuffer(data[start + 12 : end], dtype=np.uint8)
        sizes = (
            np.stack((raw >> 4, raw & 15), axis=1).ravel() if bits & 255 == 4 else raw[: len(raw) // 2 * 2].view(">u2") if bits & 255 == 16 else raw
        ).astype(np.int64)[:n]
    else:
        return np.empty(0, dtype=np.int64)
    if len(sizes) != n:
        raise Unreadable("the table of sample sizes is cut off")
    return sizes


def read_media(media: bytes) -> dict:
    """Codec, durations, sample and keyframe byte ranges of a file's first track with samples; no payload is decoded.

    Tables never mix between tracks. ``duration`` is the sum of the samples' own durations (``stts``), or what ``mdhd``
    says where that table is missing. Files without such a track (empty, foreign, cut off before ``moov``, or with their
    samples in fragments, which have no sample table) raise ``Unreadable``.
    """
    data = memoryview(media)
    try:
        for at in tracks(data):
            if len(sizes := sample_sizes(data, at)):
                return _track(data, at, sizes)
    except (struct.error, KeyError, IndexError, ZeroDivisionError) as e:
        raise Unreadable(f"a box is missing or cut off: {e}") from e
    raise Unreadable("no track of the file has samples")


def _track(data: memoryview, at: dict, sizes: np.ndarray) -> dict:
    def ints(kind: bytes, width: str = ">u4", columns: int = 1) -> np.ndarray:
        start, end = at[kind]
        n = struct.unpack_from(">I", data[start:end], 4)[0]
        raw = data[start + 8 : min(end, start + 8 + n * columns * int(width[-1]))]
        if len(raw) != n * columns * int(width[-1]):
            raise Unreadable(f"the table {kind.decode()} is cut off")
        return np.frombuffer(raw, dtype=width).astype(np.int64)

    n = len(sizes)
    codec = bytes(data[at[b"stsd"][0] + 12 : at[b"stsd"][0] + 16]).decode("latin-1")
    start = at[b"mdhd"][0]
    scale, duration = struct.unpack_from(">IQ", data, start + 20) if data[start] else struct.unpack_from(">II", data, start + 12)
    if not scale:
        raise Unreadable("the time scale is 0")
    if b"stts" in at:
        times = ints(b"stts", columns=2).reshape(-1, 2)
        duration = int((times[:, 0] * times[:, 1]).sum())
    chunks = ints(b"stco") if b"stco" in at else ints(b"co64", ">u8")
    runs = ints(b"stsc", columns=3).reshape(-1, 3)
    lengths = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    if not len(runs) or (lengths < 0).any():
        raise Unreadable("the table of chunks is not in order")
    per_chunk = np.repeat(runs[:, 1], lengths)
    if int(per_chunk.sum()) < n:
        raise Unreadable("the chunks hold fewer samples than there are sizes")
    of_chunk = np.repeat(np.arange(len(per_chunk)), per_chunk)[:n]
    starts = np.cumsum(sizes) - sizes
    firsts = np.concatenate(([0], np.cumsum(per_chunk)[:-1]))
    offsets = chunks[of_chunk] + starts - starts[firsts[of_chunk]]
    keys = ints(b"stss") - 1 if b"stss" in at else np.arange(n)
    if len(keys) and not (0 <= keys.min() and keys.max() < n):
        raise Unreadable("a keyframe's number is no sample's")
    if len(offsets) and int((offsets + sizes).max()) > len(data):
        raise Unreadable("samples lie beyond the file's end")
    return {"codec": codec, "timescale": scale, "duration": duration, "offsets": offsets, "sizes": sizes, "keyframes": np.stack((offsets[keys], sizes[keys]), axis=1)}


def samples(media: bytes, found: dict) -> bytes:
    """The samples' bytes in order; neighbours in the file are read at once."""
    offsets, sizes = found["offsets"], found["sizes"]
    breaks = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    firsts, lasts = np.concatenate(([0], breaks)), np.concatenate((breaks, [len(offsets)])) - 1
    return b"".join(media[offsets[a] : offsets[b] + sizes[b]] for a, b in zip(firsts, lasts, strict=True))


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\xff" * (FRAME * max(1, -(-len(raw) // FRAME)) - len(raw)), len(raw)


MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, duration_ms long, n_frames long, keyframes array<struct<offset:long,size:long>>, problem string"
KEYFRAMES = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), 256):  # so that few files are held at a time
            part = batch.slice(at, 256)
            made = [payload_of(t.as_py()) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array([n for _, n in made], pa.int64()), pa.array([write_media(p) for p, _ in made], pa.binary())], names=["doc_id", "n_bytes", "media"]
            )


def feature() -> Column:
    """Codec, duration and keyframe ranges of a row of ``media_features`` in one string, the ranges as a digest."""
    keys = F.col("keyframes")
    digest = F.substring(F.sha2(F.unhex(F.array_join(F.transform(keys, lambda k: F.concat(F.lpad(F.hex(k["offset"]), 16, "0"), F.lpad(F.hex(k["size"]), 16, "0"))), "")), 256), 1, 16)

    def span(k: Column) -> Column:
        return F.concat_ws("+", k["offset"].cast("string"), k["size"].cast("string"))

    return F.concat(
        F.lit("codec="), F.coalesce(F.trim("codec"), F.lit("")), F.lit(";ms="), F.coalesce(F.col("duration_ms"), F.lit(0)).cast("string"), F.lit(";frames="), F.col("n_frames").cast("string"), F.lit(";keyframes="), F.size(keys).cast("string"),
        F.lit(";first="), span(F.get(keys, F.lit(0))), F.lit(";last="), span(F.get(keys, F.size(keys) - 1)), F.lit(";ranges="), digest,
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*(x.split() for x in FEATURES.split(", ")), strict=True)
    kinds = [{"string": pa.string(), "long": pa.int64()}.get(k, KEYFRAMES) for k in kinds]
    for batch in batches:
        rows = []
        for doc, n, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            media = media.as_py() or b""
            try:
                found = read_media(media)
                payload = samples(media, found)
                own = (found["codec"], found["duration"] * 1000 // found["timescale"], len(found["sizes"]), [{"offset": o, "size": n} for o, n in found["keyframes"].tolist()], None)
            except Unreadable as e:
                payload, own = b"", (None, None, 0, [], str(e))
            rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), *own))
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=names)


def encode_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text (null: empty) as UTF-8, padded with 255 to whole frames, in a media file.

    Row by row, so repeated rows, null ids and other columns need no rule; an empty table gives none.
    """
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_encode, MEDIA)


def media_features(media: DataFrame) -> DataFrame:
    """Digests, codec, duration and the byte range of every keyframe of files, from the stored bytes alone.

    A null file counts as an empty one. What has no readable sample table has an empty payload, no codec, duration or
    keyframes, and ``problem`` says why; it is null for all others.
    """
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, FEATURES)


def op8(spark, sf_dir: str) -> DataFrame:
    """The features, with codec, duration and ranges as one string that engines without arrays can compare."""
    out = media_features(encode_media(documents(spark, sf_dir)))
    return out.withColumn("feature", feature()).drop("codec", "duration_ms", "n_frames", "keyframes", "problem")
