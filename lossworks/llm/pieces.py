"""SentencePiece encoding and decoding of merge-type (BPE) models: exact, by backtracking instead of merging.

A sequence of pieces is what merging gives exactly when merging gives each piece from its own characters and each two
adjacent pieces from theirs. So a text is cut from left to right: the longest piece that starts here (all of them come from
one Aho-Corasick pass), if it is compatible with the piece before it (their characters are merged anew, once for each
pair), else the next shorter one, else back by one piece. Positions from which nothing led on are marked in a bitfield and never
tried again, so the work grows with the length of the text.
"""

from __future__ import annotations

import codecs
import re
import struct
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossworks.llm.common import documents, text_or_empty

#: A blank, and the sign that stands for it in the model's file; here pieces hold blanks as they are.
SPACE, SIGN = " ", "▁"
#: Encoded parts of texts, and pairs of pieces, that one Python worker remembers at most.
REMEMBERED = 1_000_000

# Field numbers and kinds of the model file format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_TYPE = 2

NONE = float("-inf")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of a message in the model's binary format; fixed-width values as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = message[at]
            at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    while at < len(message):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, message[at : at + size]
            at += size


class Known(dict):
    """What ``make`` gives for short texts, remembered up to a number of them."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, text: str) -> bytes:
        found = self.make(text)
        if len(self) < REMEMBERED and len(text) <= 64:
            self[text] = found
        return found


class Model:
    """The pieces of a model, and encoding and decoding with them.

    Models that do more than merge raise ``ValueError``: other types, character maps, trimmed blanks, pieces defined by
    users or kept out of use.
    """

    def __init__(self, model: bytes):
        self.names, self.scores, self.kinds, self.id_of_foreign = [], [], [], {}
        trainer, normalizer = {}, {}
        for number, value in fields(model):
            if number == PIECES:
                piece = dict(fields(value))
                self.names.append(piece[1].decode().replace(SIGN, SPACE))
                self.scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                self.kinds.append(piece.get(3, NORMAL))
            elif number in (TRAINER, NORMALIZER):
                (trainer if number == TRAINER else normalizer).update(fields(value))
        if trainer.get(3) != MERGE_TYPE or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0) or {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("not a plain merge-type model")
        self.prefixed = bool(normalizer.get(3, 1))
        normal = [i for i, k in enumerate(self.kinds) if k == NORMAL]
        self.score = {self.names[i]: self.scores[i] for i in normal}
        self.id = {self.names[i]: i for i in normal}
        self.bytes = {int(self.names[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.known, self.pairs = Known(self.part), {}
        self._search()
        self._surfaces(trainer.get(44, " ⁇ ".encode()))

    def _search(self) -> None:
        """The automaton of the pieces that merging can make, their longest proper prefixes, and where texts may be cut.

        Tokens are the pieces by their ids; characters that are no piece get numbers behind, as they turn up.
        """
        import ahocorasick

        self.automaton, self.tokens = ahocorasick.Automaton(), list(self.names)
        made = {p for p in self.score if self.merged(p) == [p]}
        self.more, self.shorter = [0] * len(self.names), [-1] * len(self.names)
        for piece in made:
            i = self.id[piece]
            self.automaton.add_word(piece, i)
            self.more[i] = len(piece) - 1
            if len(piece) > 1:  # a first character that is no piece stands alone where nothing else fits
                shorter = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if piece[:k] in made), None)
                self.shorter[i] = self.foreign(piece[0]) if shorter is None else self.id[shorter]
        self.automaton.make_automaton()
        long = {p for p in made if len(p) > 1}
        self.parts = None if any(SPACE in p.lstrip(SPACE) for p in long) else re.compile(self._parts({p.lstrip(SPACE) for p in long}))

    def foreign(self, character: str) -> int:
        """The number of a character that is no piece."""
        found = self.id_of_foreign.get(character)
        if found is None:
            found = self.id_of_foreign[character] = len(self.tokens)
            self.tokens.append(character)
            self.more.append(0)
            self.shorter.append(-1)
        return found

    @staticmethod
    def _parts(pieces: set[str]) -> str:
        """A pattern of texts that merge apart from their neighbours: blanks, then characters that pieces link to each other.

        No piece goes on over a blank, from one group of linked characters to another, or to a character in no longer piece.
        """
        group: dict[str, set[str]] = {}
        for piece in pieces:
            own = set(piece)
            for other in {id(group[c]): group[c] for c in own if c in group}.values():
                own |= other
            if not own <= group.get(piece[:1], set()):
                group.update(dict.fromkeys(own, own))
        groups = sorted({id(g): g for g in group.values()}.values(), key=len, reverse=True)
        classes = ["".join(re.escape(c) for c in sorted(g)) for g in groups]
        return "|".join([*(f"{SPACE}*[{c}]+" for c in classes), f"{SPACE}+", f"[^{''.join(classes)}{SPACE}]"])

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text, by merging: the best score first, of equals the leftmost."""
        out, score = list(text), self.score.get
        scores = [score(a + b, NONE) for a, b in zip(out, out[1:], strict=False)]
        while scores and (best := max(scores)) > NONE:
            at = scores.index(best)
            out[at : at + 2] = [out[at] + out[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(out[at - 1] + out[at], NONE)
            if at < len(scores):
                scores[at] = score(out[at] + out[at + 1], NONE)
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the characters of both gives these two pieces."""
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        a, b = self.tokens[left], self.tokens[right]
        found = self.pairs[left << 24 | right] = self.merged(a + b) == [a, b]
        return found

    def cut(self, text: str) -> list[int]:
        """The tokens of a text."""
        n, more = len(text), self.more
        longest = [-1] * n
        for end, i in self.automaton.iter(text):  # of matches with one start, the longest ends last
            longest[end - more[i]] = i
        pairs, shorter, failed = self.pairs, self.shorter, bytearray(n // 8 + 1)
        out: list[int] = []
        at, last, i = 0, -1, -2
        while at < n:
            if i == -2:  # a new position
                i = longest[at]
                if i < 0:
                    i = self.foreign(text[at])
            if i < 0:  # nothing is left to try here
                failed[at >> 3] |= 1 << (at & 7)
                at -= more[last] + 1
                i = shorter[last]
                out.pop()
                last = out[-1] if out else -1
                continue
            end = at + more[i] + 1
            if failed[end >> 3] >> (end & 7) & 1:
                i = shorter[i]
                continue
            if last >= 0:
                fits = pairs.get(last << 24 | i)
                if not (self.compatible(last, i) if fits is None else fits):
                    i = shorter[i]
                    continue
            out.append(i)
            at, last, i = end, i, -2
        return out

    def part(self, text: str) -> bytes:
        """Ids of a text that is merged apart from its neighbours, as little-endian 32-bit integers."""
        out = self.cut(text)
        if max(out) >= len(self.names):
            found, out = out, []
            for i in found:
                if i < len(self.names):
                    out.append(i)
                elif self.bytes:
                    out.extend(self.bytes[b] for b in self.tokens[i].encode())
                elif not out or out[-1] != self.unknown:  # unknown characters in a row are one
                    out.append(self.unknown)
        return array("i", out).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        text = (SPACE if self.prefixed else "") + text.replace(SIGN, SPACE)
        if self.parts is None or not self.bytes:
            return self.part(text)
        return b"".join(map(self.known.__getitem__, self.parts.findall(text)))

    def _surfaces(self, unknown: bytes) -> None:
        self.surface = []
        for name, kind in zip(self.names, self.kinds, strict=True):
            own = bytes([int(name[3:5], 16)]) if kind == BYTE else unknown if kind == UNKNOWN else name.encode()
            self.surface.append(b"" if kind == CONTROL else own)
        self.controls = {i for i, k in enumerate(self.kinds) if k == CONTROL}
        self.plain = max(self.controls, default=-1) + 1

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, each by itself, and none is read across a control id."""
        if min(ids, default=self.plain) < self.plain and not self.controls.isdisjoint(ids):
            runs: list[list[int]] = [[]]
            for i in ids:
                if i in self.controls:
                    runs.append([])
                else:
                    runs[-1].append(i)
            text = "".join(b"".join(map(self.surface.__getitem__, run)).decode("utf-8", "one_by_one") for run in runs)
        else:
            text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "one_by_one")
        if self.prefixed and text.startswith(" "):
            first = next(i for i in ids if self.surface[i])
            text = text[1:] if self.kinds[first] == NORMAL else text
        return text


codecs.register_error("one_by_one", lambda e: ("�", e.start + 1))


@cache
def loaded(model: bytes) -> Model:
    """One for each Python worker, whatever number of tasks it runs."""
    return Model(model)


def read_model(path: str | None = None) -> bytes:
    """The model's bytes, read once by the driver and sent with the tasks: executors need no copy of the file."""
    with open(path or default_model(), "rb") as f:
        model = f.read()
    loaded(model)  # a model of another type fails here
    return model


def piece_ids(text: Column | str, model: bytes) -> Column:
    """The ids of a text as ``array<int>``; null for null, empty for empty."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        encode = loaded(model).encode
        each = [encode(x) if x else b"" for x in texts.to_pylist()]
        offsets = np.zeros(len(each) + 1, np.int64)
        np.cumsum([len(x) // 4 for x in each], out=offsets[1:])
        found = pa.array(np.frombuffer(b"".join(each), "<i4"))
        mask = texts.is_null() if texts.null_count else None
        if offsets[-1] < 1 << 31:
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found, mask=mask)
        return pa.array([None if x is None else np.frombuffer(e, "<i4") for x, e in zip(texts.to_pylist(), each, strict=True)], pa.list_(pa.int32()))

    return ids(text)


def pieces_text(ids: Column | str, model: bytes) -> Column:
    """The text of ids, as the library decodes them; null for null."""

    @F.arrow_udf("string")
    def texts(lists: pa.Array) -> pa.Array:
        decode, values = loaded(model).decode, lists.flatten().to_numpy()
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy()).tolist()
        each = (decode(values[a:b].tolist()) for a, b in zip([0, *ends], ends, strict=False))
        return pa.array([x if there else None for x, there in zip(each, lists.is_valid().to_pylist(), strict=True)], pa.string())

    return texts(ids)


def encoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded`` (columns of such names are replaced).

    Null texts count as empty: no ids, and an empty decoded text. Texts of any length are encoded whole; repeated rows
    alike, an empty table gives no rows, other columns pass as they are. No row meets another: there is no shuffle.
    """
    own = read_model(model)
    kept = [c for c in docs.columns if c.lower() not in ("ids", "decoded")]
    out = docs.select(*kept).withColumn("ids", piece_ids(text_or_empty(), own))
    return out.withColumn("decoded", pieces_text("ids", own))


def op12(spark, sf_dir: str) -> DataFrame:
    out = encoded(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
