"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary.

Every language has a probability for each piece of a public SentencePiece vocabulary (its byte pieces
included, so any text is covered). The probability of a word is the sum over all its segmentations, computed by the
forward algorithm on bytes; a text's is the product over its marked words. Piece probabilities are learned by
expectation maximisation (forward-backward expected counts) on a bounded sample: ``PER_LANGUAGE`` labelled documents of each
language, those first by a hash of their doc_id, none above ``LONGEST`` characters. Words of more than ``TOGETHER`` bytes (text without spaces) are learned from in runs between characters;
only pieces across the ends of runs go uncounted. Everything else covers all rows.

The score is the posterior of the predicted language under equal priors, its evidence tempered by ``1 / words^0.5``,
since neighbouring words are not independent.

Nulls and edge cases: a null text, or one without a letter, is ``und`` with score 0. With no labelled document at all
every text is ``und``. An equal best goes to the language first by code point. Input columns named as the two
made here give way to them. More than 512 languages raise a ValueError; a language all of whose labelled texts exceed ``LONGEST`` is not learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACED, Words, byte_slices, frugal, mix, read_table, strings, unused, without

PER_LANGUAGE, LONGEST, ROUNDS, SMOOTHING = 400, 20_000, 3, 0.05
#: Words up to so many bytes (with the mark's three) go through the forward pass together; longer ones alone, and are learned from in runs of so many.
TOGETHER = 32
#: Words that are learned from together, and words scored together.
BLOCK, AT_ONCE = 100_000, 1 << 14
#: Each byte of a word is worth this much more, so that products stay in range; taken off again in logarithms.
_LIFT = 12.0
_MARK = "▁".encode()


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(2)
def vocabulary(path: str) -> list[bytes]:
    """The pieces as bytes; byte pieces as their byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(len(model)):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            out.append(piece.encode())
    return sorted(set(out))


class Lattice:
    """Finds the pieces of a vocabulary in packed words."""

    def __init__(self, pieces: list[bytes]):
        data = np.frombuffer(b"".join(pieces), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.base = Words(data, offsets, np.ones(256, bool), lower=False).hashes()
        self.longest = int(np.diff(offsets).max())
        self.bits, left, self.tables = 20, np.arange(len(pieces)), []
        while len(left):  # each piece sits in the first table that has its place free
            slots = (self._turned(self.base[left], len(self.tables)) >> np.uint64(64 - self.bits)).astype(np.int64)
            table = np.full(1 << self.bits, -1, np.int32)
            table[slots[::-1]] = left[::-1]
            self.tables.append(table)
            left = left[table[slots] != left]

    @staticmethod
    def _turned(h: np.ndarray, k: int) -> np.ndarray:
        return h if k == 0 else mix(h + np.uint64(k))

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(h.shape, -1, np.int32)
        for k, table in enumerate(self.tables):
            at = table[(self._turned(h, k) >> np.uint64(64 - self.bits)).astype(np.int64)]
            hit = (at >= 0) & (self.base[at] == h)
            out[hit] = at[hit]
        return out


@lru_cache(2)
def lattice(path: str) -> Lattice:
    return Lattice(vocabulary(path))


def _padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Marked words as a byte matrix, and their lengths."""
    lens = np.array([len(w) for w in words])
    out = np.zeros((len(words), int(lens.max(initial=0))), np.uint8)
    out[np.arange(out.shape[1])[None, :] < lens[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return out, lens


def edges(lat: Lattice, words: list[bytes]) -> tuple[list[tuple[int, int, np.ndarray, np.ndarray]], np.ndarray]:
    """(from, to, rows, pieces) for every span of the words, longest words first in ``rows``; and lengths. Words fall by length."""
    from .common import _TABLE, _power

    grid, lens = _padded(words)
    n = grid.shape[1]
    sums = np.zeros((len(words), n + 1), np.uint64)
    np.cumsum(_TABLE[grid] * _power("up", n)[None, :], axis=1, out=sums[:, 1:])
    down, found = _power("down", n + 1), []
    for j in range(1, n + 1):
        rows = int(np.searchsorted(-lens, -j, "right"))
        for i in range(max(0, j - lat.longest), j):
            piece = lat.find(mix((sums[:rows, j] - sums[:rows, i]) * down[i]))
            hit = np.flatnonzero(piece >= 0)
            if len(hit):
                found.append((i, j, hit, piece[hit]))
    return found, lens


def log_likelihoods(lat: Lattice, prob: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Log of the summed probability of each marked word in each language; ``prob`` is pieces x languages."""
    out = np.empty((len(words), prob.shape[1]))
    lens = np.array([len(w) for w in words])
    short = np.flatnonzero(lens <= TOGETHER)
    sorted_ = short[np.argsort(-lens[short], kind="stable")]
    for k in range(0, len(sorted_), AT_ONCE):  # words of about one length share a lattice
        order = sorted_[k : k + AT_ONCE]
        spans, sized = edges(lat, [words[k] for k in order])
        ahead = np.zeros((int(sized[0]) + 1, len(order), prob.shape[1]))
        ahead[0] = 1.0
        for i, j, rows, piece in spans:
            ahead[j, rows] += ahead[i, rows] * prob[piece] * _LIFT ** (j - i)
        out[order] = np.log(ahead[sized, np.arange(len(order))]) - sized[:, None] * np.log(_LIFT)
    for k in np.flatnonzero(lens > TOGETHER):
        out[k] = _long(lat, prob, words[k])
    return out


def _long(lat: Lattice, prob: np.ndarray, word: bytes) -> np.ndarray:
    """One long word in logarithms, each language in its own scale; its pieces are found in blocks."""
    from .common import _TABLE, _power

    n, keep = len(word), lat.longest + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[np.frombuffer(word, np.uint8)] * _power("up", n), out=sums[1:])
    down = _power("down", n + 1)
    last = np.zeros((keep, prob.shape[1]))  # at j % keep the value up to byte j
    for start in range(1, n + 1, 4096):
        ends = np.arange(start, min(n + 1, start + 4096))
        begins = ends[:, None] - np.arange(1, lat.longest + 1)[None, :]
        piece = lat.find(mix((sums[ends][:, None] - sums[np.maximum(begins, 0)]) * down[np.maximum(begins, 0)]))
        piece[begins < 0] = -1
        for j, row in enumerate(piece, start):
            hit = np.flatnonzero(row >= 0)
            terms = last[(j - 1 - hit) % keep] + np.log(prob[row[hit]])
            top = terms.max(axis=0)
            last[j % keep] = top + np.log(np.exp(terms - top).sum(axis=0))
    return last[n % keep].copy()


def runs(word: bytes, longest: int = TOGETHER) -> list[bytes]:
    """A marked word in UTF-8, cut before characters into runs of ``longest`` bytes at most; nothing is left out."""
    out, at = [], 0
    while len(word) - at > longest:
        end = at + longest
        while end > at + 1 and word[end] & 0xC0 == 0x80:
            end -= 1
        out.append(word[at:end])
        at = end
    return [*out, word[at:]]


def learn(lat: Lattice, words: list[bytes], counts: np.ndarray, rounds: int = ROUNDS, block: int = BLOCK) -> np.ndarray:
    """Piece probabilities of one language by expectation maximisation over marked words and their counts.

    Longer words than TOGETHER are learned from in ``runs``. Spans are found once if all fit a block of words, else anew in each round.
    """
    size, often = len(lat.base), {}
    for w, c in zip(words, counts, strict=True):
        for run in runs(w):
            often[run] = often.get(run, 0.0) + float(c)
    order = sorted(often, key=len, reverse=True)
    prob = np.full(size, 1.0 / size)
    if not order:
        return prob
    weights = np.array([often[w] for w in order])
    parts = [slice(k, k + block) for k in range(0, len(order), block)]
    found = edges(lat, order) if len(parts) == 1 else None
    for _ in range(rounds):
        expected = np.full(size, SMOOTHING)
        for part in parts:
            spans, sized = found or edges(lat, order[part])
            n, at = int(sized[0]), np.arange(len(sized))
            ahead, back = np.zeros((n + 1, len(sized))), np.zeros((n + 1, len(sized)))
            ahead[0], back[sized, at] = 1.0, 1.0
            lifted = [prob[p] * _LIFT ** (j - i) for i, j, _, p in spans]
            for (i, j, rows, _), v in zip(spans, lifted, strict=True):
                ahead[j, rows] += ahead[i, rows] * v
            share = weights[part] / ahead[sized, at]
            for (i, j, rows, p), v in sorted(zip(spans, lifted, strict=True), key=lambda x: (-x[0][1], x[0][0])):
                back[i, rows] += back[j, rows] * v
            for (i, j, rows, p), v in zip(spans, lifted, strict=True):
                expected += np.bincount(p, ahead[i, rows] * v * back[j, rows] * share[rows], size)
        prob = expected / expected.sum()
    return prob


class Model:
    """Languages by code point, and pieces x languages probabilities."""

    def __init__(self, path: str, languages: list[str], prob: np.ndarray):
        self.path, self.languages, self.prob = path, languages, prob


def fit(docs: DataFrame, usable: Column, path: str | None = None, per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> Model:
    """Learn from rows of ``docs(doc_id, text, lang)`` where ``usable``: ``per_language`` of each at most, to the driver."""
    path = path or vocabulary_path()
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= longest))
    counts = rows.groupBy("lang").count().limit(513).collect()
    if len(counts) > 512:
        raise ValueError("lang has more than 512 values")
    # those first by hash lie in a share of the hash's range: only about twice as many as wanted are ever ranked together
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, 2.0 * per_language / r["count"] + 100.0 / r["count"]))]) if counts else F.create_map(F.lit(""), F.lit(1.0))
    drawn = F.xxhash64("doc_id", F.lit(5))
    near = rows.filter(drawn.cast("double") / 2.0**64 + 0.5 <= F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(1.0)))
    first = Window.partitionBy("lang").orderBy("drawn", "doc_id", "mark")
    few = near.select("lang", "doc_id", drawn.alias("drawn"), F.xxhash64("text").alias("mark")).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= per_language)
    few = few.select("lang", "doc_id", "mark").distinct().limit(512 * per_language)  # of bounded size, so it may be broadcast; texts stay where they are
    lat, counted = lattice(path), {}
    for lang, text in rows.select("lang", "text", "doc_id", F.xxhash64("text").alias("mark")).join(F.broadcast(few), ["lang", "doc_id", "mark"]).select("lang", "text").toLocalIterator():
        own = counted.setdefault(lang, {})
        for w in text.encode().split():
            own[w] = own.get(w, 0) + 1
    languages = sorted(counted)
    columns = [learn(lat, [_MARK + w for w in counted[x]], np.array(list(counted[x].values()), float)) for x in languages]
    return Model(path, languages, np.stack(columns, axis=1) if columns else np.empty((len(lat.base), 0)))


def score_texts(model: Model, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, best language, score) over runs of the texts."""
    lat = lattice(model.path)
    for i, j, data, offsets in byte_slices(texts, 1 << 20):
        words = Words(data, offsets, SPACED, lower=False)
        _, where, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        loglik = log_likelihoods(lat, model.prob, [_MARK + words.word(k) for k in where])
        sums = np.concatenate([np.zeros((1, loglik.shape[1])), np.cumsum(loglik[back], axis=0)])
        total = sums[words.first[1:]] - sums[words.first[:-1]]
        total /= np.sqrt(np.maximum(np.diff(words.first), 1))[:, None]
        best = total.argmax(axis=1)
        yield i, j, best, 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)


def identify(docs: DataFrame, model: Model, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with all its columns, and the predicted language and score of ``text`` in two more."""
    if len(model.languages) > 512:
        raise ValueError("the model is sent to every task; 512 languages at most")
    docs = without(docs, pred, score)
    rows = docs.withColumn(unused(docs, "__letter"), F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))
    text_at = docs.columns.index("text")
    names = [*docs.columns, pred, score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags = pa.array([*model.languages, "und"], pa.string())
        for batch in batches:
            if not model.languages:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(["und"] * n, pa.string()), pa.array([0.0] * n, pa.float64())], names)
                continue
            for i, j, best, sure in score_texts(model, strings(batch.column(text_at)).cast(pa.string())):
                part = batch.slice(i, j - i)
                letter = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
                best, sure = np.where(letter, best, len(model.languages)), np.where(letter, sure, 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], tags.take(pa.array(best)), pa.array(sure)], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return rows.mapInArrow(frugal(run), f"{kinds}, `{pred}` string, `{score}` double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = fit(docs, ~F.coalesce(held_out, F.lit(False)))
    return identify(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), model).drop("text")
