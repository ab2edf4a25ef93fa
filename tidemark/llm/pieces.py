"""SentencePiece encoding and decoding by shared-prefix dynamic programming.

Texts are marked (a space becomes the mark, one is put in front) and split into units no piece can cross. The distinct new units
of a run of texts are sorted, which lays them out as the depth-first order of their trie; one stack of forward
states, a state per character, is kept while walking it, and a unit starts from the states of the prefix it shares with the one before.

The relaxation follows the model's own type. A unigram model takes the best sum of scores (Viterbi). The public
vocabulary is a BPE model, whose encoding is not the best sum of its scores: a prefix ends in the one piece that may
follow the encoding of what precedes it, where two pieces may be neighbours exactly if merging their joint
text gives these two again. That is the same forward pass with validity for a score, and its ids are the library's own.
Characters outside the vocabulary fall back to their bytes.

Nulls and edge cases: a null text has null ids and null decoding; an empty text has no ids and decodes to the empty text. A literal
U+2581 in a text decodes to a space, as it does in the library, and such a text does not make the round trip. Input columns named
ids, n_ids, decoded or round_trip give way to those made here. Ties do not arise: an encoding is unique. Units over ``CACHED`` characters are encoded but not remembered.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, frugal, read_table, strings, without

MARK = "▁"
LATIN = "[A-Za-z\u00c0-\u024f]"
#: Bounds of what a Python worker remembers: characters in a unit, units, and pairs of neighbours.
CACHED, REMEMBERED, PAIRS = 32, 200_000, 400_000


class Codec:
    """Encodes and decodes with the vocabulary of one SentencePiece model file; ``unigram`` overrides the model's own type."""

    def __init__(self, path: str, unigram: bool | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.score, self.raw, self.byte = {}, {}, [], {}
        for i in range(len(model)):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte[value] = i
                self.raw.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                piece = piece.replace(MARK, " ")  # marked as a space: texts stay in narrow strings
                self.ids[piece] = i
                self.score[piece] = model.get_score(i)
                self.raw.append(piece.encode())
        self.unigram = is_unigram(path) if unigram is None else unigram
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = min(self.score.values(), default=0.0) - 10.0
        # no piece crosses from a space's run to what precedes it, from or to a newline that is in no piece,
        # or from a Latin letter to a mark that follows none in any piece: units end there
        alone = "" if any("\n" in p for p in self.ids) else r"\n"
        after = {b for p in self.ids for a, b in zip(p, p[1:], strict=False) if re.match(LATIN, a)}
        marks = "".join(re.escape(c) for c in string.punctuation if c not in after)
        ends = f"(?=[ {marks}{alone}]|\\Z)"
        self.units = re.compile(f" *+{LATIN}++{ends}| *[^ {alone}]+| +" + (r"|\n" if alone else "")).findall
        #: All ends of pieces: what is none of these ends no longer piece.
        self.tails = {p[i:] for p in self.ids for i in range(len(p))}
        if any(" " in p.lstrip(" ") for p in self.ids):
            raise ValueError("a piece has the mark after other characters; units cannot be split at it")
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: join the neighbours with the best score, leftmost first, until none can be joined."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def neighbours(self, left: str, right: str) -> bool:
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        good = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return good

    def walk(self, units: list[str]) -> Iterator[tuple[str, list[str]]]:
        """Each of the sorted units with its pieces. ``last[d]`` is the last piece of the encoding of the first d characters."""
        last: list[str] = [""]
        best: list[float] = [0.0]
        before = ""
        ids, score, tails, pairs = self.ids, self.score, self.tails, self.pairs
        for unit in units:
            d, stop = 0, min(len(before), len(unit))
            while d < stop and before[d] == unit[d]:
                d += 1
            del last[d + 1 :], best[d + 1 :]
            for end in range(d + 1, len(unit) + 1):
                starts, start = [], end - 1
                while start >= 0 and (piece := unit[start:end]) in tails:
                    if piece in ids:
                        starts.append(start)
                    start -= 1
                if not starts or starts[0] != end - 1:
                    starts.insert(0, end - 1)  # a character outside the vocabulary
                if self.unigram:
                    values = [best[i] + score.get(unit[i:end], self.unknown) for i in starts]
                    top = max(values)
                    best.append(top)
                    last.append(unit[starts[values.index(top)] : end])
                    continue
                for i in reversed(starts):
                    piece = unit[i:end]
                    if not i:
                        break
                    good = pairs.get((last[i], piece))
                    if good if good is not None else self.neighbours(last[i], piece):
                        break
                last.append(piece)
            pieces, end = [], len(unit)
            while end:
                pieces.append(last[end])
                end -= len(last[end])
            yield unit, pieces[::-1]
            before = unit

    def learn(self, units: set[str]) -> dict[str, tuple[int, ...]]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        missing = units - self.known.keys()
        fresh = {}
        for unit, pieces in self.walk(sorted(missing)):
            out: list[int] = []
            for p in pieces:
                got = self.ids.get(p)
                out += [got] if got is not None else [self.byte[b] for b in (MARK if p == " " else p).encode()]
            (self.known if len(unit) <= CACHED else fresh)[unit] = tuple(out)
        return fresh

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        split = [None if t is None else self.units(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        wanted = set().union(*filter(None, split))
        fresh = self.learn(wanted)
        table = self.known | fresh if fresh else self.known
        return [None if s is None else list(chain.from_iterable(map(table.__getitem__, s))) for s in split]

    def decode(self, ids: list[int] | None) -> str | None:
        if ids is None:
            return None
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def is_unigram(path: str) -> bool:
    """The model type of a SentencePiece model file: trainer_spec (field 2), model_type (field 3); 1 is unigram."""
    data = open(path, "rb").read()

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    def fields(at: int, end: int) -> Iterator[tuple[int, int, int]]:
        while at < end:
            tag, at = varint(at)
            if tag & 7 == 0:
                value, after = varint(at)
                yield tag >> 3, value, at
            elif tag & 7 == 2:
                size, at = varint(at)
                after = at + size
                yield tag >> 3, size, at
            else:
                after = at + (8 if tag & 7 == 1 else 4)
            at = after

    for field, size, at in fields(0, len(data)):
        if field == 2:
            return next((v for f, v, _ in fields(at, at + size) if f == 3), 1) == 1
    return True


@lru_cache(4)
def codec(path: str, unigram: bool | None = None) -> Codec:
    return Codec(path, unigram)


def encode_decode(docs: DataFrame, path: str | None = None, unigram: bool | None = None) -> DataFrame:
    """``docs`` with its columns but ``text``, and ids array<int>, n_ids, decoded (from the ids alone), round_trip."""
    from .language_id import vocabulary_path

    path = path or vocabulary_path()
    docs = without(docs, "ids", "n_ids", "decoded", "round_trip")
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(*rest, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, unigram)
        for batch in batches:
            texts = strings(batch.column(batch.num_columns - 1))
            for i, j, _, _ in byte_slices(texts, 1 << 20):
                part = batch.slice(i, j - i)
                plain = texts.slice(i, j - i).to_pylist()
                ids = own.encode(plain)
                decoded = list(map(own.decode, ids))
                sizes = np.array([0 if x is None else len(x) for x in ids])
                none = np.array([x is None for x in ids])
                flat = pa.array(np.fromiter(chain.from_iterable(x or () for x in ids), np.int32, int(sizes.sum())))
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(none, False))
                same = pa.array([None if a is None else a == b for a, b in zip(plain, decoded, strict=True)], pa.bool_())
                counts = pa.array(sizes.astype(np.int32), mask=none)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(ends, flat), counts, pa.array(decoded, pa.string()), same], [*rest, "ids", "n_ids", "decoded", "round_trip"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(frugal(run), f"{kinds}, ids array<int>, n_ids int, decoded string, round_trip boolean")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
