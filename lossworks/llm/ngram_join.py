"""N-gram Jaccard join: adaptive multi-match prefixes.

Documents are sets of word shingles. With all shingles in one order, rare before frequent, two sets of the wanted
similarity share a shingle within their prefixes; with prefixes longer by l - 1 they share l. Each document's prefix is
lengthened while that lowers its estimated candidate cost, and a pair is verified only if it shares as many prefix
shingles as the shorter lengthening of the two allows to ask for.

Equal sets are one class from the start. Every shingle's members are first verified against two of them (its pivots), so
that a group of near copies becomes one component from linearly many pairs; then the candidate pairs whose ends are still
in different components are verified. These meet only where the shingle can be the first they share and the sketches of
their prefixes leave room for all that must be shared, so members of a group that don't link don't pair up either. A pair
left out joins two documents that are linked already or can't link, so components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lossworks.llm.common import broadcast_if_small, documents, text_or_empty, unused, written

WORDS, PERCENT = 3, 90
#: Shingles whose frequency steers the order, at most; the list is broadcast (9 bytes each). Any list gives the same links.
MOST_FREQUENT = 1 << 20
#: Columns that say where a shingle stands in its document's order.
AT = ("rank", "before", "behind")
#: Columns of 64 bits each that sketch a document's prefix: every shingle that other documents have too sets one bit.
SKETCH = tuple(f"bits{k}" for k in range(4))
LONGEST = 4  # the most prefix shingles that a pair is asked to share
COUNTED = 2_000_000  # shingles that one task counts at a time
#: Names that one task remembers at most, about 200 bytes each.
REMEMBERED = 150_000
#: Texts whose shingles are held at a time, whatever the size of Arrow's batches.
TEXTS = 1000
#: Bytes of texts that are hashed together; a longer text is on its own.
BYTES = 1 << 20
#: A longer word is hashed on its own.
LONG_WORD = 128
#: Places, as a power of two, of the table that tells most rare shingles from frequent ones.
PLACES = 23
#: Bits of a set's name. Names that different sets share are replaced, so fewer bits only cost more replacements.
NAME_BITS = 64
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
MULTIPLIERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= MULTIPLIERS[1]
    x ^= x >> np.uint64(27)
    x *= MULTIPLIERS[2]
    x ^= x >> np.uint64(31)
    return x


def word_hashes(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of the words of a text (bytes, eight zeros at its end), all at once: eight bytes of each word in turn."""
    eights = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    out = mixed(sizes.astype(np.uint64) * MULTIPLIERS[0])
    at = np.flatnonzero(sizes <= LONG_WORD)
    taken = 0
    while len(at):
        left = np.minimum(sizes[at] - taken, 8)
        out[at] = mixed(out[at] * MULTIPLIERS[0] + (eights[starts[at] + taken] & FIRST_BYTES[left]))
        taken += 8
        at = at[sizes[at] > taken]
    for i in np.flatnonzero(sizes > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(text[starts[i] : starts[i] + sizes[i]].tobytes())
    return out


def chained(h: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """Hashes of the shingles of so many words that start at the places ``at`` of the word hashes."""
    out = np.full(len(at), words, dtype=np.uint64)
    for i in range(words):
        out *= MULTIPLIERS[0]
        out += h[at + i]
        out = mixed(out)
    return out


def shingles(texts: pa.StringArray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sorted distinct hashes of the texts' shingles, text after text, and their numbers, for some texts at a time.

    A-Z count as a-z. Fewer words make one shingle; none, none.
    """
    if not len(texts):
        return
    _, ends, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends, done = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64), 0
    while done < len(texts):
        upto = max(done + 1, int(np.searchsorted(ends, ends[done] + BYTES, side="right")) - 1)
        own = ends[done : upto + 1] - ends[done]
        valid = texts.slice(done, upto - done).is_valid().to_numpy(zero_copy_only=False)
        text = np.zeros(own[-1] + 8, np.uint8)
        if own[-1]:
            text[: own[-1]] = LOWER[np.frombuffer(data, np.uint8, own[-1], ends[done])]
        yield _shingles(text, own, valid, words)
        done = upto


def _shingles(text: np.ndarray, ends: np.ndarray, valid: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    solid = ~BLANK[text[:-8]]
    cut = np.zeros(len(text) - 7, bool)  # a text starts here
    cut[ends] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:-1]
    last[:-1] &= ~solid[1:] | cut[1:-1]
    starts = np.flatnonzero(first)
    h = word_hashes(text, starts, np.flatnonzero(last) + 1 - starts)
    of_text = np.searchsorted(starts, ends)
    begin, n_words = of_text[:-1], np.where(valid, np.diff(of_text), 0)
    sizes = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    stops = np.cumsum(sizes)
    at = np.arange(stops[-1]) + np.repeat(begin - (stops - sizes), sizes)
    out = np.empty(len(at), np.uint64)
    lengths = np.repeat(np.minimum(n_words, words), sizes)
    for k in range(1, words + 1):
        if k == words or (lengths == k).any():
            here = lengths == k
            out[here] = chained(h, at[here], k)
    found = out.view(np.int64)
    for a, b in zip((stops - sizes).tolist(), stops.tolist(), strict=True):
        if b - a > 1:
            found[a:b].sort()
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    new[(stops - sizes)[sizes > 0]] = True
    numbers = np.diff(np.r_[0, np.r_[0, np.cumsum(new)][stops]])
    return found[new], numbers


def shingle_sets(texts: pa.StringArray, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    for found, numbers in shingles(texts, words):
        stops = np.cumsum(numbers).tolist()
        yield from (found[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True))


def names_of(found: np.ndarray, bits: int = NAME_BITS) -> tuple[int, int]:
    """A set's name and its second name: the halves of a 128-bit hash, the first one cut to ``bits``."""
    first, second = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), dtype=np.int64)
    return int(first) >> (64 - bits), int(second)


def class_of(found: np.ndarray, bits: int, clashes: frozenset[int]) -> int:
    """The set's name, or where sets of other second names share that, its second name."""
    first, second = names_of(found, bits)
    return second if first in clashes else first


def _needed(n, percent: int):
    """The least overlap with any set of the wanted similarity."""
    return -(-n * percent // 100)


def few_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most ``TEXTS`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def _scan(words: int, bits: int):
    """Rows of documents (doc_id, mark, n, node, second) and of shingles seen twice or more in a batch (shingle, times)."""

    def frequent(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        found, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.int64),) * 2
        return found[times > 1], times[times > 1]

    def batch_of(ids, marks, n, node, second, shingle, times) -> pa.RecordBatch:
        a, b = len(ids), len(shingle)
        columns = [
            pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(b, pa.int64())]) for x in (ids, marks, n, node, second)
        ] + [pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(x, pa.int64())]) for x in (shingle, times)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "n", "node", "second", "shingle", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for batch in few_texts(batches):
            n, node, second = [], [], []
            for found in shingle_sets(batch.column(1), words):
                names = names_of(found, bits)
                n.append(len(found))
                node.append(names[0])
                second.append(names[1])
                if names not in seen:
                    held.append(found.copy())
                    size += len(found)
                    if len(seen) < REMEMBERED:
                        seen.add(names)
            full = size >= COUNTED
            yield batch_of(batch.column(0), batch.column(2), n, node, second, *(frequent(held) if full else ([], [])))
            if full:
                held, size = [], 0
        if held:
            yield batch_of([], [], [], [], [], *frequent(held))

    return run


def _prefixes(words: int, percent: int, frequent, bits: int, clashes: frozenset[int]):
    """The longest prefixes: (shingle, node, n, rank, end) in the order rare first, once for each set in a task.

    ``end`` is the place of a prefix's last shingle in the order, as a number.
    """

    def level_of(found: np.ndarray, keys: np.ndarray, levels: np.ndarray, places: np.ndarray) -> np.ndarray:
        level = np.zeros(len(found), np.int64)
        maybe = np.flatnonzero(places[place_of(found)])
        if len(maybe):
            own = found[maybe]
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            level[maybe] = np.where(keys[at] == own, levels[at], 0)
        return level

    def place_of(found: np.ndarray) -> np.ndarray:
        return found.view(np.uint64) >> np.uint64(64 - PLACES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, levels = frequent.value
        places = np.zeros(1 << PLACES, bool)
        places[place_of(keys)] = True
        seen: set[int] = set()
        for batch in few_texts(batches):
            out: list[np.ndarray] = []
            nodes, sizes, ends = [], [], []
            for found, numbers in shingles(batch.column(1), words):
                # the first shingles by hash, twice as many as are wanted, mostly hold enough rare ones
                stops = np.cumsum(numbers)
                wanted = numbers - _needed(numbers, percent) + LONGEST
                looked = np.minimum(2 * wanted + 8, numbers)
                tops = np.cumsum(looked)
                some = found[np.arange(tops[-1]) + np.repeat(stops - numbers - (tops - looked), looked)]
                rare = level_of(some, keys, levels, places) == 0
                n_rare = np.diff(np.r_[0, np.r_[0, np.cumsum(rare)][tops]])
                first_rare = np.cumsum(n_rare) - n_rare
                some = some[rare]
                for n, stop, most, held, at in zip(*(x.tolist() for x in (numbers, stops, wanted, n_rare, first_rare)), strict=True):
                    own = found[stop - n : stop]
                    node = class_of(own, bits, clashes)
                    if not n or node in seen:
                        continue
                    if len(seen) < REMEMBERED:
                        seen.add(node)
                    if held >= most:
                        own, last = some[at : at + most], 0
                    else:
                        level = level_of(own, keys, levels, places)
                        order = np.argsort(level, kind="stable")[:most]
                        own, last = own[order], int(level[order[-1]])
                    out.append(own)
                    ends.append((last << 56) + (int(own[-1]) >> 8) + (1 << 55))
                    nodes.append(node)
                    sizes.append(n)
            if out:
                lengths = [*map(len, out)]
                rank = np.concatenate([np.arange(x) for x in lengths])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out)), pa.array(np.repeat(nodes, lengths)), pa.array(np.repeat(sizes, lengths).astype(np.int32)), pa.array(rank.astype(np.int32)), pa.array(np.repeat(ends, lengths))],
                    names=["shingle", "node", "n", "rank", "end"],
                )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle those whose shingle has two nodes or more, with ``c``, its rows.

    A batch's last shingle may go on in the next one: its rows wait, as names and numbers only, for the end of the run.
    """
    names = ["shingle", "node", "n", "rank", "end"]
    rest: list[np.ndarray] = [np.empty(0, np.int64) for _ in names]

    def out(columns: list[np.ndarray]) -> pa.RecordBatch | None:
        new = np.concatenate(([True], columns[0][1:] != columns[0][:-1])) if len(columns[0]) else np.empty(0, bool)
        starts = np.flatnonzero(new)
        times = np.diff(np.append(starts, len(new)))
        c = np.repeat(times, times)
        keep = c > 1
        if not keep.any():
            return None
        kinds = [np.int64, np.int64, np.int32, np.int32, np.int64]
        return pa.RecordBatch.from_arrays([pa.array(x[keep].astype(k)) for x, k in zip(columns, kinds, strict=True)] + [pa.array(c[keep])], names=[*names, "c"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.concatenate((r, batch.column(i).to_numpy().astype(np.int64))) for i, r in enumerate(rest)]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        rest = [x[cut:] for x in columns]
        if cut and (found := out([x[:cut] for x in columns])) is not None:
            yield found
    if (found := out(rest)) is not None:
        yield found


def _sets(words: int, bits: int, clashes: frozenset[int]):
    """(node, set), once for each set in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in few_texts(batches):
            found = {class_of(x, bits, clashes): x for x in shingle_sets(batch.column(1), words)}
            found = {k: x for k, x in found.items() if k not in seen}
            if len(seen) < REMEMBERED:
                seen.update(found)
            sets = [*found.values()]
            values = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), np.concatenate([*sets, np.empty(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([pa.array([*found], pa.int64()), values], names=["node", "set"])

    return run


def frequent_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, levels) of the most frequent ones: all above a level that at most ``MOST_FREQUENT`` of them reach."""
    counts = written(rows.filter("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times")), "frequent")
    level = F.floor(F.log2(F.col("times").cast("double")) * 2).cast("int")
    per_level = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True)  # at most 128 rows
    room, least = MOST_FREQUENT, 1 << 30
    for r in per_level:
        room -= r["n"]
        if room < 0:
            break
        least = r["level"]
    found = counts.select("shingle", level.alias("level")).filter(F.col("level") >= least).toArrow()
    keys, levels = found["shingle"].to_numpy(), found["level"].to_numpy()
    order = np.argsort(keys)
    return keys[order], levels[order].astype(np.int32)


def adaptive(entries: DataFrame, percent: int) -> DataFrame:
    """``entries`` within each document's chosen prefix, with ``l``, the shared shingles it lets a pair be asked for,
    of the shingles that any other document's longest prefix has too the number ``before`` and ``behind`` this one, and
    their sketch.

    Asking for l costs reading the lists of the prefix lengthened to l, and verifying at most 1/l as many candidates as
    those lists have entries; a verification costs in proportion to the set's size.
    """
    own = Window.partitionBy("node")
    needed = F.ceil(F.col("n") * percent / 100)
    base = F.col("n") - needed + 1
    costs = []
    for length in range(1, LONGEST + 1):
        read = F.sum(F.when(F.col("rank") < base + (length - 1), F.col("c") - 1).otherwise(0)).over(own)
        cost = read.cast("double") * (1 + F.col("n") / (16.0 * length * length))
        costs.append(F.when(F.lit(length) <= needed, F.struct(cost.alias("cost"), F.lit(length).alias("l"))))
    chosen = entries.withColumn("l", F.array_min(F.filter(F.array(*costs), lambda c: c.isNotNull()))["l"])
    chosen = chosen.withColumn("before", F.row_number().over(own.orderBy("rank")) - 1).withColumn("behind", F.count("*").over(own) - 1 - F.col("before"))
    bit = F.expr("shiftleft(1L, cast(shingle & 63 as int))")
    word = F.shiftright("shingle", 6).bitwiseAND(len(SKETCH) - 1)
    chosen = chosen.withColumns({c: F.bit_or(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).over(own) for k, c in enumerate(SKETCH)})
    return chosen.filter(F.col("rank") < base + F.col("l") - 1).select("shingle", "node", "n", "l", *AT, *SKETCH)


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every end of a link: its component's smallest name, by repeated contraction.

    Each round every node moves to its smallest neighbour and the links are redrawn between the places moved to. Names
    are hashes, so the rounds are few (about the logarithm of a component's diameter).
    """
    edges = written(links.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        moved = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "moved")
        labels = written(labels.join(moved, labels["root"] == moved["a"], "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        first = moved.select("a", F.col("to").alias("a2"))
        second = moved.select(F.col("a").alias("b"), F.col("to").alias("b2"))
        edges = written(edges.join(first, "a").join(second, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b")).filter("a <> b").distinct(), "edges")
    return labels


def _overlap(a: str, b: str, percent: int):
    """The least overlap of two sets of these sizes that have the similarity."""
    return F.ceil((F.col(a) + F.col(b)) * percent / (100.0 + percent) - 1e-9)


def _short(n: str, percent: int, length) -> Column:
    """A prefix's length less the set's size, for prefixes lengthened to ``length``."""
    return F.least(F.lit(0), length - F.ceil(F.col(n) * percent / 100))


def _may_link(a: str, b: str, percent: int):
    """What a shared shingle tells of two documents with columns ``n`` and ``AT`` (suffixed ``a`` and ``b``).

    Their sizes must be near; what precedes the shingle in both and what follows it in both must leave room for the
    overlap; and the prefix that ends first must share all but (size - overlap) of its shingles, of which no more are
    shared than stand before this one in both prefixes, and behind it in both.
    """
    n1, n2, r1, r2, b1, b2, h1, h2 = (F.col(f"{c}{k}") for c in ("n", *AT) for k in (a, b))
    need = _overlap(f"n{a}", f"n{b}", percent)
    near = F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent
    room = F.least(r1, r2) + 1 + F.least(n1 - r1 - 1, n2 - r2 - 1) >= need
    longest = F.least(_short(f"n{a}", percent, F.lit(LONGEST)), _short(f"n{b}", percent, F.lit(LONGEST)))
    return near & room & (F.least(b1, b2) + 1 + F.least(h1, h2) >= longest + need)


def _may_be_first(a: str, b: str, percent: int):
    """What a shared shingle tells of two documents if it is the first one they share, with ``SKETCH`` besides.

    Every pair has such a shingle, within the prefixes of both, so that all others need not bring the two together. None
    of the overlap lies before it; and a bit that only one of the sketches has stands for a shingle that isn't shared.
    """
    n1, n2, r1, r2, b1, b2, h1, h2 = (F.col(f"{c}{k}") for c in ("n", *AT) for k in (a, b))
    need = _overlap(f"n{a}", f"n{b}", percent)
    ask = need + F.least(_short(f"n{a}", percent, F.lit(LONGEST)), _short(f"n{b}", percent, F.lit(LONGEST)))

    def shared_at_most(x: str, y: str, held: Column) -> Column:
        return held - sum(F.bit_count(F.col(f"{c}{x}").bitwiseAND(F.bitwise_not(F.col(f"{c}{y}")))) for c in SKETCH)

    near = F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent
    room = F.least(n1 - r1, n2 - r2) >= need
    return near & room & (F.least(h1, h2) + 1 >= ask) & (shared_at_most(a, b, b1 + h1 + 1) >= ask) & (shared_at_most(b, a, b2 + h2 + 1) >= ask)


def classified(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bits: int = NAME_BITS) -> DataFrame:
    """One row per document: ``doc_id``, ``mark`` (a hash of the text), ``n``, ``root`` and ``component_id``.

    ``root`` names the component (null without shingles), ``component_id`` is its smallest id. Names of ``bits`` bits that
    sets of different second names share (of 64 bits: less than one among 10^9 sets, about 300 among 10^11) are listed
    first, and these sets go by their second names, so that two sets are one only if all 128 bits agree.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(text_or_empty()).alias("mark"))
    rows = written(texts.mapInArrow(_scan(words, bits), "doc_id long, mark long, n long, node long, second long, shingle long, times long"), "sets")
    shared_names = rows.filter("n > 0").groupBy("node").agg(F.min("second").alias("low"), F.max("second").alias("high")).filter("low <> high")
    clashes = frozenset(r["node"] for r in shared_names.select("node").collect())
    own_name = F.when(F.col("node").isin(*clashes), F.col("second")).otherwise(F.col("node")) if clashes else F.col("node")
    own = rows.filter("node is not null").select("doc_id", "mark", "n", own_name.alias("node"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(rows))
    raw = texts.mapInArrow(_prefixes(words, percent, frequent, bits, clashes), "shingle long, node long, n int, rank int, end long")
    met = raw.repartition("shingle").sortWithinPartitions("shingle", "node", "rank")
    # a set that several tasks hold comes several times; its second row for a shingle goes
    shared = written(met.mapInArrow(_shared, "shingle long, node long, n int, rank int, end long, c long").dropDuplicates(["shingle", "node"]), "shared")
    entries = written(adaptive(shared, percent), "prefixes")

    own_row = F.struct("node", "n", *AT)
    # the most central member has the fewest shingles of its own: what near copies have in common links to it
    shared_part = F.struct(((F.col("before") + F.col("behind") + 1) / (F.col("n") + _short("n", percent, F.lit(LONGEST)))).alias("part"), "node")
    pivots = entries.groupBy("shingle").agg(F.min(own_row).alias("low"), F.max_by(own_row, shared_part).alias("high"))
    star = entries.join(pivots, "shingle").select(*(F.col(c).alias(f"{c}1") for c in ("node", "n", *AT)), F.explode(F.array("low", "high")).alias("p"))
    star = star.select("*", *(F.col(f"p.{c}").alias(f"{c}2") for c in ("node", "n", *AT))).filter((F.col("node1") != F.col("node2")) & _may_link("1", "2", percent))
    star = written(star.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct(), "pivot-pairs")
    classes = own.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"))

    profiles = shared.groupBy("node").agg(F.max("n").alias("n"), F.max("end").alias("end"), F.collect_list("shingle").alias("prefix"))
    profiles = written(profiles, "profiles")

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs whose prefixes share enough.

        A shingle of the prefix that ends first is within the other prefix or not in the other set at all. So those that
        the prefixes don't share are lost, and what is left must reach the overlap that the similarity asks for.
        """
        left, right = (profiles.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "end", "prefix"))) for x in "ab")
        met = pairs.join(left, "a").join(right, "b").withColumn("m", F.size(F.array_intersect("prefix_a", "prefix_b")))

        def enough(x: str):
            return F.col("m") >= _short(f"n_{x}", percent, F.lit(LONGEST)) + _overlap("n_a", "n_b", percent)

        ok = F.when(F.col("end_a") < F.col("end_b"), enough("a")).when(F.col("end_a") > F.col("end_b"), enough("b")).otherwise(enough("a") | enough("b"))
        return written(met.filter(ok).select("a", "b"), "likely")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = likely(pairs)
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        ids = broadcast_if_small(written(classes.join(ends, "node").select(F.col("first").alias("doc_id")).distinct(), "ends"))
        chosen = texts.join(ids, "doc_id").unionByName(texts.filter("doc_id is null"))
        sets = written(chosen.mapInArrow(_sets(words, bits, clashes), "node long, set array<long>"), "end-sets")
        left, right = (sets.select(F.col("node").alias(x), F.col("set").alias(f"s{x}")) for x in "ab")
        met = pairs.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
        return written(met.filter(F.col("i") * 100 >= (F.size("sa") + F.size("sb") - F.col("i")) * percent).select("a", "b").distinct(), "links")

    links = verified(star)
    roots = components(links)
    placed = entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed_ = placed.groupBy("shingle").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("shingle")
    placed = written(placed.join(mixed_, "shingle", "left_semi"), "placed")
    x, y = (placed.select("shingle", *(F.col(c).alias(f"{c}{k}") for c in ("node", "n", *AT, *SKETCH, "root"))) for k in (1, 2))
    met = x.join(y, "shingle").filter((F.col("node1") < F.col("node2")) & (F.col("root1") != F.col("root2")) & _may_be_first("1", "2", percent))
    pairs = met.select(F.col("node1").alias("a"), F.col("node2").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    more = verified(written(pairs, "pairs"))
    roots = components(links.unionByName(more)).withColumnRenamed("node", "_node")

    named = classes.join(roots, F.col("node") == F.col("_node"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    named = written(named, "classes")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = named.join(least, "root").select(F.col("node").alias("_node"), "root", "component_id")
    return own.join(of_class, (F.col("node") == F.col("_node")) & (F.col("n") > 0), "left").select("doc_id", "mark", "n", "root", "component_id")


def joined(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Documents link when 100 x intersection >= ``percent`` x union of their shingle sets; ``component_id`` is the
    smallest id reachable. Null and empty texts have no shingles and their own id. A null id is returned with its
    component's smallest id (null when all are). Repeated rows are one class; an empty table gives no rows; other columns
    are ignored. Sets are equal where 128-bit hashes of their sorted 64-bit shingle hashes are.
    """
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return classified(docs, words, percent).select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id (then of the smallest text hash).

    Documents without shingles all stay. Of equal rows one stays.
    """
    found = classified(docs, words, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("own")
    keep = found.filter("root is not null").groupBy("root").agg(first).select("own.doc_id", "own.mark")
    id_, keep_, mark = unused(docs.columns, "_id", "_keep", "_mark")
    keep = keep.unionByName(found.filter("root is null").select("doc_id", "mark").distinct()).select(F.col("doc_id").alias(id_), F.col("mark").alias(keep_))
    marked = docs.withColumn(mark, F.xxhash64(text_or_empty()))
    kept = marked.join(keep, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(mark) == F.col(keep_)), "left_semi")
    return kept.dropDuplicates(["doc_id", mark]).select(*docs.columns)


def op5(spark, sf_dir: str) -> DataFrame:
    return joined(documents(spark, sf_dir))


OP5_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d
), n AS (
  SELECT doc_id, count(g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.y) AS component_id FROM n JOIN r ON r.x = n.doc_id GROUP BY 1, 2
"""
