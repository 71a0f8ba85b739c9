"""Operators across documents, and the pipeline, against brute force."""

import collections
import hashlib
import random
import re

import pytest

import corpus_pipeline
from lossworks.llm import mixing, ngram_join, packing, pii, quality_rules, suffix_dedup
from tests.llm.data import documents, frame, prose

BLANK = re.compile("[\x20\x09-\x0d]+")


def shingle_set(text, k):
    words = [w for w in BLANK.split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def plain_components(rows, k, percent):
    """Smallest id reachable, over all pairs; rows are numbered so that nulls and repeated ids take part."""
    sets = [shingle_set(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                met = len(sets[i] & sets[j])
                if 100 * met >= percent * (len(sets[i]) + len(sets[j]) - met):
                    parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    out = [None] * len(rows)
    for group in groups.values():
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            out[i] = min(ids, default=None) if sets[i] else rows[i][0]
    return sets, out


def clump(rng, start, n, words=60):
    base = prose(rng, words).split()
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(40)}"
        rows.append((start + i, " ".join(own), "en", "src0", 0))
    return rows


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 50)])
def test_ngram_join(spark, k, percent):
    rng = random.Random(5)
    rows = documents() + clump(rng, 3000, 40) + clump(rng, 4000, 25, 11)
    sets, want = plain_components(rows, k, percent)
    got = ngram_join.joined(frame(spark, rows, clash=True), k, percent).collect()
    count = lambda xs: collections.Counter(map(repr, xs))
    assert count((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == count((r[0], len(s), c) for r, s, c in zip(rows, sets, want, strict=True))


def test_ngram_join_with_names_that_clash(spark):
    """Names of four bits: nearly all sets share theirs with others and go by their second names."""
    own = "doc_id, mark, n, component_id"
    long, short = (ngram_join.classified(frame(spark), 5, 80, bits).select(*own.split(", ")).collect() for bits in (64, 4))
    assert sorted(map(repr, long)) == sorted(map(repr, short))


def test_ngram_join_holds_few_texts_at_a_time(monkeypatch):
    """Slices of Arrow's batches, with the same rows."""
    import pyarrow as pa

    texts = [f"a{i} b{i % 7} c{i % 5} d e{i % 3}" for i in range(50)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(52), pa.int64()), pa.array(texts), pa.array(range(52), pa.int64())], names=["doc_id", "text", "mark"])

    def rows(texts_held: int) -> tuple[int, list, list]:
        monkeypatch.setattr(ngram_join, "TEXTS", texts_held)
        sets, scanned = ([*run(iter([batch]))] for run in (ngram_join._sets(3, 64, frozenset()), ngram_join._scan(3, 64)))
        key = lambda r: str(r)
        return max(b.num_rows for b in sets), *(sorted((r for b in found for r in b.to_pylist()), key=key) for found in (sets, scanned))

    most, *few = rows(8)
    assert most <= 8 and few == [*rows(1000)[1:]]


def test_ngram_join_hashes_words_together(monkeypatch):
    """A text of 20,000 distinct words takes few calls, not some for each word; sets are those of the plain shingles."""
    import sys

    import pyarrow as pa

    calls = collections.Counter()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(f"word{i}" for i in range(20_000))]), pa.array([1])], names=["doc_id", "text", "mark"])
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        found = [*ngram_join._sets(3, 64, frozenset())(iter([batch]))]
    finally:
        sys.setprofile(None)
    assert len(found[0]["set"][0]) == 19_998 and calls.total() < 2_000

    rng = random.Random(3)
    texts = [None, "", " \t", "a", "A b", "\x00 \x00\x00 a\x00", "É ß\x0b\x0c中文", "w" * 8 + " " + "w" * 16 + " " + "w" * 9, "x" * 128 + " " + "y" * 129 + " " + "x" * 700]
    texts += ["".join(rng.choice("abAB \t\n") for _ in range(rng.randrange(40))) for _ in range(400)]
    for k, most in ((1, 1 << 20), (3, 1 << 20), (3, 30), (5, 1)):
        monkeypatch.setattr(ngram_join, "BYTES", most)
        sets = [frozenset(s.tolist()) for s in ngram_join.shingle_sets(pa.array(["skipped", *texts]).slice(1), k)]
        want = [frozenset(shingle_set(t, k)) for t in texts]
        names = {}
        for own, plain in zip(sets, want, strict=True):
            assert len(own) == len(plain) and names.setdefault(plain, own) == own
        assert len(set(sets)) == len(set(want)) and len(frozenset().union(*sets)) == len(frozenset().union(*want))


def test_ngram_join_of_a_large_clump(spark):
    """2,000 near copies of one text, half of them too far from all others: components by matrices."""
    import numpy as np

    rng = random.Random(12)
    base, rows = prose(rng, 150).split(), []
    for i in range(2000):
        own = list(base)
        for at in rng.sample(range(150), rng.randrange(9)):
            own[at] = f"edit{rng.randrange(10_000)}"
        rows.append((i, " ".join(own), "en", "s", 0))
    sets = [shingle_set(r[1], 5) for r in rows]
    place = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(rows), len(place)), dtype=np.float32)
    for i, s in enumerate(sets):
        held[i, [place[x] for x in s]] = 1
    met = held @ held.T
    n = held.sum(axis=1)
    link, least = 100 * met >= 80 * (n[:, None] + n[None, :] - met), np.arange(len(rows))
    while True:
        new = np.where(link, least[None, :], len(rows)).min(axis=1)
        if np.array_equal(new, least):
            break
        least = new
    assert 200 < len(set(least.tolist())) < 1800
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.joined(frame(spark, rows), 5, 80).collect()}
    assert got == dict(enumerate(least.tolist()))


def test_ngram_join_does_not_depend_on_the_order(spark, monkeypatch):
    """Any list of frequent shingles gives the same links."""
    rng = random.Random(6)
    rows = clump(rng, 0, 60)
    want = sorted(ngram_join.joined(frame(spark, rows)).collect())
    monkeypatch.setattr(ngram_join, "MOST_FREQUENT", 3)
    assert sorted(ngram_join.joined(frame(spark, rows).repartition(1)).collect()) == want


def test_one_of_each(spark):
    rows = documents()
    _, want = plain_components(rows, 5, 80)
    sets = [shingle_set(r[1], 5) for r in rows]
    out = ngram_join.one_of_each(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = collections.Counter(r["doc_id"] for r in out.collect())
    smallest = {c for c, s in zip(want, sets, strict=True) if s and c is not None}
    assert all(kept[i] == 1 for i in smallest)
    for (doc_id, *_), s, c in zip(rows, sets, want, strict=True):
        if s and c is not None and doc_id != c:
            assert not kept[doc_id] or doc_id is None
    assert kept[900] == kept[901] == kept[902] == 1
    assert ngram_join.one_of_each(frame(spark, [])).count() == 0


def plain_dedup(rows, length):
    first = {}
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        if doc is not None:
            for i in range(len(raw) - length + 1):
                s = raw[i : i + length]
                first[s] = min(first.get(s, doc), doc)
    out = []
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        if doc is not None:
            for i in range(len(raw) - length + 1):
                if first[raw[i : i + length]] < doc:
                    gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        runs = sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def dedup_rows():
    rng = random.Random(8)
    rows = documents() + clump(rng, 3000, 12)
    rows += [(5000 + i, "ab" * 200 + str(i) + "a" * 300, "en", "s", 0) for i in range(4)]
    rows += [(5100, prose(rng, 40), "en", "s", 0), (5100, rows[2][1] + " other text of this id", "en", "s", 0)]
    rows += [(5150, prose(rng, 20) + rows[i % 40][1][:200] if rows[i % 40][1] else None, "en", "s", 0) for i in range(80)]  # many texts of one id
    rows += [(5200, rows[1][1][:49], "en", "s", 0), (5201, rows[1][1][:50], "en", "s", 0), (5202, "\x00" * 120, "en", "s", 0), (5203, "\x00" * 70, "en", "s", 0)]
    rows += [(5300 + i, prose(rng, 5) + "é中" * 40 + prose(rng, 5), "en", "s", 0) for i in range(3)]
    return rows


@pytest.mark.parametrize("length,most_sorted,copies", [(50, 2_000_000, 1_000_000), (50, 300, -1), (20, 2_000_000, 1_000_000)])
def test_suffix_dedup(spark, monkeypatch, length, most_sorted, copies):
    monkeypatch.setattr(suffix_dedup, "MOST_BROADCAST", copies)
    rows = dedup_rows()
    out = suffix_dedup.deduplicated(frame(spark, rows, clash=True), length, most_sorted).collect()
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in out]
    assert collections.Counter(map(repr, got)) == collections.Counter(map(repr, plain_dedup(rows, length)))


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.deduplicated(frame(spark, [])).count() == 0


def test_suffix_order():
    import numpy as np

    rng = np.random.default_rng(1)
    for letters in (1, 2, 5, 200):
        data = rng.integers(0, letters, 2000).astype(np.uint8)
        padded = np.concatenate((data, np.zeros(80, np.uint8)))
        word = np.zeros(2056, dtype=np.uint64)
        for k in range(8):
            word |= padded[k : k + 2056].astype(np.uint64) << np.uint64(56 - 8 * k)
        order, raw = suffix_dedup.suffix_order(data, word), padded.tobytes()
        keys = [raw[i : i + 56] for i in order]
        assert sorted(order.tolist()) == list(range(2000)) and keys == sorted(keys)


def pipeline_rows():
    rng = random.Random(9)
    rows = [r for r in documents() if r[0] is not None]
    rows += [(2000 + i, prose(rng, 60) + "\nmail me at bob.k@mail9.example.com now\nthis is a menu line of the site", "en", "hot", 0) for i in range(30)]
    rows += [(2100 + i, f"this is a menu line of the site\nonly little number {i} text here now", "en", "hot", 0) for i in range(12)]
    return rows


def test_pipeline(spark, tmp_path):
    """Each stage on what the one before kept, held against plain versions."""
    frame(spark, pipeline_rows()).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen[name] = ([tuple(r) for r in before.collect()], [tuple(r) for r in docs.collect()])
        if k < 4:
            assert docs.columns == before.columns, name

    before, after = seen["quality_rules"]
    verdict = {(r["doc_id"], r["text_hash"]): r["kept"] for r in quality_rules.judged(frame(spark, before)).collect()}
    assert len(after) == sum(v for v in verdict.values()) + len([r for r in before if r[0] in (3, 70)]) - 2
    assert all("menu line" not in r[1] for r in after) and not any(2100 <= r[0] < 2200 for r in after)
    assert all(r[4] == len(r[1]) for r in after)

    before, after = seen["near_duplicates"]
    _, want = plain_components(before, 5, 80)
    assert sorted(r[0] for r in after) == sorted(set(want))

    before, after = seen["personal_data"]
    old = {r[0]: r[1] for r in before}
    for r in after:
        entity = "bob.k@mail9" in old[r[0]]
        assert "bob.k@mail9" not in r[1] and (r[1] != old[r[0]] if entity else r[1] == old[r[0]])

    before, after = seen["mixing"]
    copies = collections.Counter({r["doc_id"]: r["copies"] for r in mixing.mix(frame(spark, before)).collect()})
    assert collections.Counter(r[0] for r in after) == +copies

    before, _ = seen["packing"]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = collections.Counter()
    for r in before:
        ids[r[0]] += len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1
    packed = collections.Counter()
    for r in docs.collect():
        packed[r["doc_id"]] += r["length"]
    assert packed == ids
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "mixing", "packing"]
    assert pii.KEY


def test_pipeline_of_an_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
