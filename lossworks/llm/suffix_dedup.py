"""Suffix-array dedup: removes bytes that a document shares with one of a smaller id, in matches of a least length.

Where two documents share a string of that length they share its minimiser, the smallest hash of its 16-byte pieces. Each
text is cut into stretches of strings with one minimiser, and stretches meet by it: equal stretches are settled at once,
and those that differ go, together, through a suffix array. It is built in two stages: only the suffixes smaller than
their successors are sorted directly, all others are induced by a scan of the first-byte buckets; adjacent suffixes with a
long enough common prefix then belong together, and all but the smallest id lose the string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossworks.llm.common import broadcast_if_small, documents, text_or_empty, written

LENGTH = 50
PIECE = 16
#: Bytes by which the directly sorted suffixes are ordered; matches longer than that need more.
SORTED_BYTES = 56
#: Bytes that go through one suffix array; a minimiser with more distinct text than that is split into single strings.
MOST_SORTED = 2_000_000
MOST_HELD = 100_000
MOST_FETCHED = 4_000_000  # bytes that leave in one batch
MOST_BROADCAST = 16 << 20  # bytes
LONGEST_RUN = 1 << 20
U = np.uint64
_RANDOM = np.random.Generator(np.random.Philox(7))
BYTE_HASH = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
STEPS = _RANDOM.integers(1, 1 << 63, 8, dtype=np.uint64) | U(1)
START_BITS = 32  # a text has less than 2^31 bytes


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    return x ^ (x >> U(29))


class Powers:
    """Powers of an odd number and of its inverse, modulo 2^64, as far as they were needed."""

    def __init__(self):
        self.base, self.up, self.down = int(STEPS[7]), np.ones(1, dtype=U), np.ones(1, dtype=U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate(([U(1)], np.full(size - 1, U(b)))), dtype=U) for b in (self.base, pow(self.base, -1, 1 << 64)))
        return self.up, self.down


POWERS = Powers()


def minimisers(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string of ``length`` bytes the smallest hash of its 16-byte pieces; and those (by doubling: 2, 4, 8, 16)."""
    h = BYTE_HASH[data]
    for k, step in zip((1, 2, 4, 8), STEPS, strict=False):
        h = h[:-k] * step + h[k:]
    pieces = h = _mix(h)
    width, have = length - PIECE + 1, 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return (np.minimum(h[: len(h) - (width - have)], h[width - have :]) if width > have else h), pieces


def stretches(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, content hash, sides, first string, strings) of each stretch; they overlap by ``length`` - 1 bytes.

    Every string has half of its other bytes or more on one side of the minimiser's piece. ``sides`` holds a 32-bit hash of
    the piece with that many bytes before it, and one with those behind it (0 where the stretch has fewer). Texts that
    share a string share the one or the other; 0 as a whole says that the piece stands at several places.
    """
    m, pieces = minimisers(data, length)
    starts = np.concatenate(([0], np.flatnonzero(m[1:] != m[:-1]) + 1))
    counts = np.diff(np.append(starts, len(m)))
    if counts.max() > LONGEST_RUN:
        starts = np.concatenate([np.arange(s, s + c, LONGEST_RUN) for s, c in zip(starts, counts, strict=True)])
        counts = np.diff(np.append(starts, len(m)))
    up, down = POWERS(len(data) + 1)
    sums = np.concatenate((np.zeros(1, dtype=U), np.cumsum(BYTE_HASH[data] * up[: len(data)], dtype=U)))
    # powers alone let long texts be made that collide; the pieces' mixed hashes don't
    of_pieces = np.concatenate((np.zeros(1, dtype=U), np.cumsum(pieces, dtype=U)))
    ends = starts + counts + length - 1

    def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (sums[b] - sums[a]) * down[a]

    content = _mix(hashed(starts, ends) + counts.astype(U) + (of_pieces[ends - PIECE + 1] - of_pieces[starts]) * STEPS[6])
    width, half = length - PIECE + 1, -(-(length - PIECE) // 2)
    first = starts + (np.lib.stride_tricks.sliding_window_view(pieces, width)[starts] == m[starts][:, None]).argmax(axis=1)
    once = first >= starts + counts - 1
    left, right = first - half >= starts, first + PIECE + half <= ends
    a, b = np.where(left, first - half, starts), np.where(right, first + PIECE + half, ends)
    before = np.where(left & once, _mix(hashed(a, first + PIECE)) >> U(32) | U(1), U(0))
    behind = np.where(right & once, _mix(hashed(first, b)) >> U(32) | U(1), U(0))
    return m[starts], content, before << U(32) | behind, starts, counts


def _tag(text: bytes) -> int:
    """31 bits of the text, above a place in it: tells different texts of one id apart."""
    return (xxhash.xxh3_64_intdigest(text) & 0x7FFFFFFF) << START_BITS


def _cut(length: int):
    """Stretches as (k1, k2, sides, doc, at): 40 bits of the minimiser and 64 of the content, the count, the tagged place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, docs, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py().encode()
                if len(raw) < length:
                    continue
                m, c, sides, starts, counts = stretches(np.frombuffer(raw, dtype=np.uint8), length)
                k1 = (m & ~U(0xFFFFFF)) | (c >> U(40))
                k2 = ((c & U(0xFFFFFFFFFF)) << U(24)) | counts.astype(U)
                held.append((k1.view(np.int64), k2.view(np.int64), sides.view(np.int64), starts + _tag(raw)))
                docs.append((doc, len(starts)))
                size += len(starts)
                if size > 200_000:
                    yield _stretch_batch(held, docs)
                    held, docs, size = [], [], 0
            if held:
                yield _stretch_batch(held, docs)

    return run


def _stretch_batch(held: list, docs: list) -> pa.RecordBatch:
    ids = np.repeat(np.array([d for d, _ in docs], dtype=np.int64), [n for _, n in docs])
    k1, k2, sides, at = (np.concatenate(x) for x in zip(*held, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, sides, ids, at.astype(np.int64))], names=["k1", "k2", "sides", "doc", "at"])


def _repeated(group: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Whether another row of the group has the same side; 0 is no side."""
    key = group.astype(U) << U(32) | side
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out & (side != 0)


def _meet(length: int):
    """Rows sorted by (k1, k2, doc, at) to spans (group null) and to stretches for the suffix array (group set).

    Within equal stretches all documents but the first lose theirs at once. First ones go on if their minimiser has
    other documents and one of their sides another text. Only first ones wait for their minimiser's end, and no more
    than ``MOST_HELD`` of them.
    """

    def out(group, doc, at, size) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([group, pa.array(doc), pa.array(at), pa.array(size)], names=["grp", "doc", "at", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((5, 0), dtype=np.int64)
        sure = None  # a minimiser whose stretches go on in any case, as some have gone already
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate((rest, np.stack([batch.column(i).to_numpy() for i in range(5)])), axis=1)
            spans, firsts = settle(rows)
            if spans.shape[1]:
                yield out(pa.nulls(spans.shape[1], pa.int64()), spans[3], spans[4], (spans[1] & 0xFFFFFF) + length - 1)
            group = firsts[0] >> 24
            cut = int(np.searchsorted(group, group[-1]))
            done, rest = firsts[:, :cut], firsts[:, cut:]
            if rest.shape[1] > MOST_HELD:
                last = (rest[0] == rest[0, -1]) & (rest[1] == rest[1, -1])
                done, sure, rest = np.concatenate((done, rest[:, ~last]), axis=1), group[-1], rest[:, last]
            if (kept := mixed(done, sure)).shape[1]:
                yield out(pa.array(kept[0] >> 24), kept[3], kept[4], (kept[1] & 0xFFFFFF) + length - 1)
        if (kept := mixed(rest, sure)).shape[1]:
            yield out(pa.array(kept[0] >> 24), kept[3], kept[4], (kept[1] & 0xFFFFFF) + length - 1)

    def settle(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k1, k2, _, doc, _ = rows
        new = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
        first = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = doc > first
        return rows[:, later], rows[:, ~later]

    def mixed(rows: np.ndarray, sure) -> np.ndarray:
        if not rows.shape[1]:
            return rows
        group = rows[0] >> 24
        new = np.concatenate(([True], group[1:] != group[:-1]))
        starts, of = np.flatnonzero(new), np.cumsum(new) - 1
        several = (np.minimum.reduceat(rows[3], starts) != np.maximum.reduceat(rows[3], starts))[of]
        any_side = np.logical_or.reduceat(rows[2] == 0, starts)
        at = np.flatnonzero(several)
        sides = rows[2, at].view(U)
        met = any_side[of[at]] | _repeated(of[at], sides >> U(32)) | _repeated(of[at], sides & U(0xFFFFFFFF))
        keep = group == sure if sure is not None else np.zeros(len(group), dtype=bool)
        keep[at[met]] = True
        return rows[:, keep]

    return run


def suffix_order(data: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The suffixes of ``data`` in order of their first 56 bytes at least; ``word[i]`` holds 8 bytes from i on.

    A suffix smaller than its successor is sorted directly. The others are placed by bucket scans: when a first byte's
    bucket is complete, the suffixes one place before its members, in this order, are the next of their own buckets.
    """
    n = len(data)
    up = np.zeros(n, dtype=np.int8)
    up[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    up[-1] = -1
    where = np.where(up != 0, np.arange(n), n)
    small = up[np.minimum.accumulate(where[::-1])[::-1]] > 0
    direct = np.flatnonzero(small)
    direct = direct[np.lexsort([word[direct + 8 * k] for k in range(SORTED_BYTES // 8 - 1, -1, -1)])] if len(direct) else direct
    bounds = np.searchsorted(data[direct], np.arange(257))
    queue: list[list[np.ndarray]] = [[] for _ in range(256)]
    queue[data[-1]].append(np.array([n - 1]))
    order = []
    for c in range(256):
        level = np.concatenate(queue[c]) if queue[c] else np.empty(0, dtype=np.int64)
        bucket = []
        while len(level):
            bucket.append(level)
            level = level[level > 0] - 1
            level = level[data[level] == c]
        bucket.append(direct[bounds[c] : bounds[c + 1]])
        done = np.concatenate(bucket)
        order.append(done)
        before = done[done > 0] - 1
        before = before[data[before] > c]
        byte = data[before]
        by = np.argsort(byte, kind="stable")
        before, byte = before[by], byte[by]
        edges = np.searchsorted(byte, np.arange(c + 1, 257))
        for k in np.flatnonzero(np.diff(edges)):
            queue[c + 1 + k].append(before[edges[k] : edges[k + 1]])
    return np.concatenate(order)


def smallest_holder(parts: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, place, smallest id) for every string of ``length`` bytes in ``parts`` that a smaller id holds as well."""
    sizes = np.array([len(p) for p in parts])
    joined = np.frombuffer(b"\xff".join(parts) + bytes(max(length, SORTED_BYTES) + 8), dtype=np.uint8)  # byte 255 is in no UTF-8
    n = int(sizes.sum()) + len(parts) - 1
    word = np.zeros(n + max(length, SORTED_BYTES), dtype=U)
    for k in range(8):
        word |= joined[k : k + len(word)].astype(U) << U(56 - 8 * k)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    part = np.repeat(np.arange(len(parts)), sizes + 1)[:n]
    place = np.arange(n) - starts[part]
    order = suffix_order(joined[:n], word)
    order = order[place[order] <= sizes[part[order]] - length]
    a, b = order[:-1], order[1:]
    common = np.ones(len(a), dtype=bool)
    for k in range(length // 8):
        common &= word[a + 8 * k] == word[b + 8 * k]
    if rest := length % 8:
        common &= (word[a + length - rest] ^ word[b + length - rest]) >> U(64 - 8 * rest) == 0
    new = np.concatenate(([True], ~common))
    least = np.minimum.reduceat(docs[part[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
    lost = least < docs[part[order]]
    return part[order][lost], place[order][lost], least[lost]


def _sort(length: int):
    """Rows (grp, doc, at, bytes), sorted by grp, to the spans that lose (doc, at, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def spans(rows: list[tuple]) -> pa.RecordBatch:
            docs, at = np.array([r[1] for r in rows], dtype=np.int64), np.array([r[2] for r in rows], dtype=np.int64)
            part, place, _ = smallest_holder([r[3] for r in rows], docs, length)
            by = np.lexsort((place, part))
            part, place = part[by], place[by]
            new = np.concatenate(([True], (part[1:] != part[:-1]) | (place[1:] != place[:-1] + 1))) if len(part) else np.empty(0, bool)
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(part)))
            return pa.RecordBatch.from_arrays([pa.array(docs[part[first]]), pa.array(at[part[first]] + place[first]), pa.array(count + length - 1)], names=["doc", "at", "size"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if size > MOST_SORTED // 2 and row[0] != held[-1][0]:
                    yield spans(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield spans(held)

    return run


def _places(column: pa.ListArray, *names: str) -> tuple[np.ndarray, ...]:
    """(first value of each list and of the one behind the last, the named fields of all values) of lists of structs."""
    values = column.flatten()
    lengths = np.array(column.value_lengths().fill_null(0), dtype=np.int64)
    return np.concatenate(([0], np.cumsum(lengths))), *(values.field(n).to_numpy(zero_copy_only=False) for n in names)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the list of their stretches to (grp, doc, at, bytes)."""
    for batch in batches:
        bounds, grp, at, size = _places(batch.column(2), "grp", "at", "size")
        held, cut, total = [], [], 0

        def made(held: list, cut: list) -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(x)) for x in zip(*held, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(cut, pa.binary())], names=["grp", "doc", "at", "bytes"])

        for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
            raw = text.as_py().encode()
            tag = _tag(raw)
            own = np.arange(bounds[i], bounds[i + 1])
            own = own[at[own] >> START_BITS << START_BITS == tag]
            if len(own):
                held.append((grp[own], np.full(len(own), doc, dtype=np.int64), at[own]))
                starts = (at[own] - tag).tolist()
                cut.extend([raw[x : x + n] for x, n in zip(starts, size[own].tolist(), strict=True)])
                total += int(size[own].sum())
                if total > MOST_FETCHED:
                    yield made(held, cut)
                    held, cut, total = [], [], 0
        if held:
            yield made(held, cut)


def _finish(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            bounds, at, size = _places(batch.column(2), "at", "size")
            for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                raw = (text.as_py() or "").encode()
                kept, runs = raw, 0
                if bounds[i] < bounds[i + 1]:
                    tag = _tag(raw)
                    starts, sizes = at[bounds[i] : bounds[i + 1]], size[bounds[i] : bounds[i + 1]]
                    own = starts >> START_BITS << START_BITS == tag
                    a, b = starts[own] - tag, starts[own] - tag + sizes[own]
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    first = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1]))) if len(a) else np.empty(0, dtype=np.int64)
                    last = np.append(first[1:] - 1, len(a) - 1) if len(a) else first
                    edges = [0, *np.stack((a[first], b[last]), axis=1).ravel().tolist(), len(raw)]
                    kept, runs = b"".join([raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)]), len(first)
                rows.append((doc, len(raw), len(raw) - len(kept), runs, kept))
            ids, sizes, gone, runs, kept = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (ids, sizes, gone, runs)] + [pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    return run


def deduplicated(docs: DataFrame, length: int = LENGTH, most_sorted: int = MOST_SORTED) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes left, joined).

    A byte goes when a string of ``length`` bytes over it also starts in a document with a smaller id, judged on the
    input. Null texts are empty; a null id is no smaller and no larger than any, so such rows stay whole and take nothing;
    rows that share an id take nothing from each other; an empty table gives no rows.

    Exact copies of a smaller id's text go first (when their list is measured small enough to broadcast; else they take
    the general way to the same result). Stretches shuffle once, by minimiser, with about 20 bytes each; a string that very
    many documents share makes rows of one key, but no more than one row in a document's hundreds, and they stream.
    """
    if not PIECE <= length <= SORTED_BYTES:
        raise ValueError(f"the least length of a match is from {PIECE} to {SORTED_BYTES} bytes")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), text_or_empty().alias("text"))
    known = texts.filter("doc is not null").filter(F.octet_length("text") >= length)
    marks = written(known.select("doc", F.md5(F.encode("text", "UTF-8")).alias("mark"), F.octet_length("text").cast("long").alias("n")), "marks")
    first = marks.groupBy("mark").agg(F.min("doc").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    copies = written(marks.join(first, "mark").filter("doc > first").select("doc", "mark").distinct(), "copies")
    few = broadcast_if_small(copies, MOST_BROADCAST)
    if few is not copies:
        mark = F.md5(F.encode("text", "UTF-8"))
        known = known.withColumn("mark", mark).join(few, ["doc", "mark"], "left_anti").drop("mark")
    cut = known.mapInArrow(_cut(length), "k1 long, k2 long, sides long, doc long, at long")
    met = cut.repartition(F.shiftright("k1", 24)).sortWithinPartitions("k1", "k2", "doc", "at")
    met = written(met.mapInArrow(_meet(length), "grp long, doc long, at long, size long"), "stretches")
    spans = met.filter("grp is null").select("doc", "at", "size")

    left = met.filter("grp is not null")
    large = left.groupBy("grp").agg(F.sum("size").alias("total")).filter(F.col("total") > most_sorted).select("grp")
    wanted = left.groupBy("doc").agg(F.collect_list(F.struct("grp", "at", "size")).alias("wanted"))
    ids = broadcast_if_small(written(left.select("doc").distinct(), "holders"), MOST_BROADCAST)
    fetched = known.join(ids, "doc", "left_semi").join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(_fetch, "grp long, doc long, at long, bytes binary")
    fetched = written(fetched, "fetched")
    large = broadcast_if_small(written(large, "large"), MOST_BROADCAST)
    small = fetched.join(large, "grp", "left_anti").repartition("grp").sortWithinPartitions("grp", "doc", "at")
    sorted_ = small.select("grp", "doc", "at", "bytes").mapInArrow(_sort(length), "doc long, at long, size long")
    single = (
        fetched.join(large, "grp", "left_semi")
        .select("doc", "at", "bytes", F.explode(F.sequence(F.lit(1), F.octet_length("bytes") - (length - 1))).alias("k"))
        .select("doc", (F.col("at") + F.col("k") - 1).alias("at"), F.substring("bytes", F.col("k"), F.lit(length)).alias("string"))
    )
    least = single.groupBy("string").agg(F.min("doc").alias("least"))
    single = single.join(least, "string").filter("least < doc").select("doc", "at", F.lit(length).cast("long").alias("size"))
    spans = spans.unionByName(sorted_).unionByName(single)
    if few is not copies:
        tagged = known_copies(texts, few)
        spans = spans.unionByName(tagged)
    gone = written(spans, "spans").groupBy("doc").agg(F.collect_list(F.struct("at", "size")).alias("spans"))
    return texts.join(gone, "doc", "left").select("doc", "text", "spans").mapInArrow(
        _finish(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def known_copies(texts: DataFrame, copies: DataFrame) -> DataFrame:
    """The whole of each listed copy, as a span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.as_py().encode() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_tag(r) for r in raw], pa.int64()), pa.array([len(r) for r in raw], pa.int64())], names=["doc", "at", "size"]
            )

    marked = texts.withColumn("mark", F.md5(F.encode("text", "UTF-8"))).join(copies, ["doc", "mark"], "left_semi")
    return marked.select("doc", "text").mapInArrow(run, "doc long, at long, size long")


def op6(spark, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)
), m AS (
  SELECT s, min(doc_id) AS least FROM w GROUP BY 1
), g AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w JOIN m USING (s) WHERE least < doc_id
), r AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g
), sp AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY 1, 2
), k AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
         string_agg(piece, '' ORDER BY a) AS front
  FROM (SELECT sp.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY sp.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY sp.doc_id ORDER BY a), 0))) AS piece FROM sp JOIN d USING (doc_id)) GROUP BY 1
)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE front || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
