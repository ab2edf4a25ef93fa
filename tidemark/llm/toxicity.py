"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A word's weight is the sum of the weights of its parts: the whole word, its beginnings and endings, and the byte n-grams within it
(``BEGINNINGS``, ``ENDINGS``, ``WITHIN``), so that a stem speaks for endings never seen in learning. A sentence's probability is a
logistic function of its words' weights, and a document's evidence is that of noisy-or: toxic if any sentence is, or by
a leak, which takes the labels no sentence explains. The bias is fixed, so that a sentence without evidence counts for 1e-4.
A sentence ends at a stop or a new line, and after ``LONGEST_SENTENCE`` words at the latest.

Learning has three steps. Parts are screened by their association with the labels, one document counting once: first in
hashed buckets, then by themselves. Weights are learned from document labels by proximal gradient steps; they are not negative and at
first shrunk (L1), so that only parts with evidence in several documents keep one, and those are then fitted unshrunk. How much they are shrunk is
chosen on a fifth of the learning rows, left out for that; on the same fifth the score is calibrated: a logistic function of the evidence of
noisy-or and of the length, since words that resemble toxic ones turn up by accident in proportion to length.

Learning takes a bounded sample: ``DOCUMENTS`` labelled documents, those first by a hash of their doc_id, none
above ``LONGEST`` characters. All rows and whole texts are scored.

Nulls and edge cases: a text without evidence scores the leak alone, and so does a null, empty or wordless one. Without any labelled document all
score 0, with labels of one kind alone all score its share. Documents labelled twice count twice in learning; a null label is not used.
Repeated rows get equal results. Columns of ``docs`` named score, predicted or offending give way to those made here.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, Words, byte_slices, frugal, mix, read_table, strings, without

DOCUMENTS, LONGEST, LONGEST_SENTENCE = 8000, 20_000, 64
#: Bytes of the beginnings, endings and inner n-grams of a word that count as its parts.
BEGINNINGS, ENDINGS, WITHIN = range(3, 9), range(4, 9), range(5, 9)
#: A part is looked at in so many toxic documents, with so much likelihood ratio, and so many parts at most.
LEAST_DOCUMENTS, LEAST_RATIO, MOST_PARTS, BUCKET_BITS = 5, 14.0, 20_000, 22
ROUNDS, RATE, BIAS = 200, 0.5, -9.0
#: Shrinkages tried: so much of a document for each hundred documents learned from.
SHRINKS, LEAST_TOXIC = (0.02, 0.06, 0.2), 8
#: How far calibration makes up for the rarer label: 0 not at all, 1 wholly.
BALANCE = 0.5
_STOPS = np.zeros(256, bool)
_STOPS[[0x0A, 0x0D, 0x21, 0x2E, 0x3F]] = True
_KIND = {"begin": np.uint64(0x9E3779B97F4A7C15), "end": np.uint64(0xC2B2AE3D27D4EB4F), "in": np.uint64(0x165667B19E3779F9)}


class Sentences:
    """The sentences of some texts: words with their sentence and their distinct kind, each sentence's text and byte span."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = words = Words(data, offsets, ALNUM)
        hashes = words.hashes()
        text = np.searchsorted(words.first, np.arange(len(hashes)), "right") - 1
        stops = np.concatenate([[0], np.cumsum(_STOPS[data])])[words.start]
        new = np.ones(len(hashes), bool)
        new[1:] = (text[1:] != text[:-1]) | (stops[1:] != stops[:-1])
        begins = np.flatnonzero(new)
        if len(begins):  # and again after every so many words
            since = np.arange(len(hashes)) - np.repeat(begins, np.diff(np.append(begins, len(hashes))))
            new |= since % LONGEST_SENTENCE == 0
            begins = np.flatnonzero(new)
        self.of_word = np.cumsum(new) - 1
        self.text = text[begins]
        self.start = words.start[begins]
        self.end = words.end[np.append(begins[1:], len(hashes)) - 1] if len(begins) else words.end[:0]
        self.count = len(begins)
        #: hashes of the distinct words, a place of each, and which of them each word is
        self.kinds, self.place, self.kind = np.unique(hashes, return_index=True, return_inverse=True)

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(distinct words, hashes of a part of each), one kind of part after the other."""
        start, end = self.words.start[self.place], self.words.end[self.place]
        size = end - start
        yield np.arange(len(size)), self.kinds
        for n in BEGINNINGS:
            own = np.flatnonzero(size > n)
            yield own, mix(self.words.spans(start[own], start[own] + n) + _KIND["begin"])
        for n in ENDINGS:
            own = np.flatnonzero(size > n)
            yield own, mix(self.words.spans(end[own] - n, end[own]) + _KIND["end"])
        for n in WITHIN:
            longer = np.flatnonzero(size > n)
            places = size[longer] - n + 1
            own = np.repeat(longer, places)
            first = start[own] + np.arange(len(own)) - np.repeat(np.cumsum(places) - places, places)
            yield own, mix(self.words.spans(first, first + n) + _KIND["in"])


class Model:
    """Hashes of parts (sorted) and their weights, the leak, and the calibration: weights of evidence and length, and a constant."""

    def __init__(self, parts: np.ndarray, weights: np.ndarray, leak: float, calibration: np.ndarray | None = None):
        self.parts, self.weights, self.leak, self.calibration = parts, weights, leak, calibration
        self.marked = np.zeros(1 << 16, bool)
        self.marked[parts >> np.uint64(48)] = True

    def sentence_scores(self, s: Sentences) -> np.ndarray:
        weight = np.zeros(len(s.kinds))
        for own, part in s.parts() if len(self.parts) else ():
            maybe = np.flatnonzero(self.marked[part >> np.uint64(48)])
            at = np.minimum(np.searchsorted(self.parts, part[maybe]), len(self.parts) - 1)
            hit = self.parts[at] == part[maybe]
            weight += np.bincount(own[maybe[hit]], self.weights[at[hit]], len(weight))
        return 1 / (1 + np.exp(-np.clip(BIAS + np.bincount(s.of_word, weight[s.kind], s.count), -40, 40)))

    def evidence(self, s: Sentences, p: np.ndarray, texts: int) -> np.ndarray:
        """Of each text: minus the logarithm of the probability that no sentence is toxic, without what the bias alone makes of them."""
        return excess(s.text, p, texts)

    def document_scores(self, evidence: np.ndarray, words: np.ndarray) -> np.ndarray:
        if self.calibration is None:
            return 1 - (1 - self.leak) * np.exp(-evidence)
        return np.where(evidence > 0, 1 / (1 + np.exp(-np.clip(_design(evidence, words) @ self.calibration, -40, 40))), self.leak)


def excess(text: np.ndarray, p: np.ndarray, texts: int) -> np.ndarray:
    own = np.log1p(-np.minimum(p, 1 - 1e-12)) - np.log1p(-1 / (1 + np.exp(-BIAS)))
    return np.bincount(text, np.where(own < -1e-9, -own, 0.0), texts)


def _design(evidence: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.log(evidence + 1e-4), np.log1p(words), np.ones(len(evidence))], axis=1)


def calibrated(evidence: np.ndarray, words: np.ndarray, toxic: np.ndarray) -> np.ndarray | None:
    """Weights of a ridge logistic regression, the rarer label weighing more (``BALANCE``); None where evidence tells nothing."""
    x, y, b = _design(evidence, words), toxic.astype(float), np.zeros(3)
    weight = np.where(toxic, max(1.0, (~toxic).sum() / max(1, toxic.sum())) ** BALANCE, 1.0)
    ridge = np.array([0.05, 0.5, 0.01])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * b)
        b = b + step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
    return b if b[0] > 0 else None


def ratio(pos: np.ndarray, neg: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Log likelihood ratio of a part's rate in toxic and clean documents; 0 where toxic ones have it no oftener."""
    n, share = pos + neg, toxic / (toxic + clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (pos * np.log(np.maximum(pos, 1e-9) / (n * share)) + neg * np.log(np.maximum(neg, 1e-9) / (n * (1 - share))))
    return np.where(pos > n * share, g, 0.0)


class Sample:
    """The screened parts of labelled texts: which distinct words have which, and where those words stand."""

    def __init__(self, texts: list[str], toxic: np.ndarray):
        column, label = pa.array(texts, pa.string()), toxic.astype(bool)
        seen = np.zeros((2, 1 << BUCKET_BITS), np.int32)
        shift = np.uint64(64 - BUCKET_BITS)
        for i, j, s in self._slices(column):
            pairs = np.unique(s.text[s.of_word] * len(s.kinds) + s.kind)
            text, kind = pairs // len(s.kinds), pairs % len(s.kinds)
            for own, part in s.parts():
                # every part of every distinct word of a text, once a text
                first, count = np.searchsorted(own, kind, "left"), np.bincount(own, minlength=len(s.kinds))[kind]
                at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                key = np.unique((np.repeat(text, count) << BUCKET_BITS) | (part[at] >> shift).astype(np.int64))
                bucket, bad = key & ((1 << BUCKET_BITS) - 1), label[i + (key >> BUCKET_BITS)]
                np.add.at(seen[1], bucket[bad], 1)
                np.add.at(seen[0], bucket[~bad], 1)
        n1, n0 = int(label.sum()), int((~label).sum())
        worth = (seen[1] >= LEAST_DOCUMENTS) & (ratio(seen[1].astype(float), seen[0].astype(float), n1, n0) >= LEAST_RATIO)
        del seen
        kinds, parts, words, sentence, text, total, self.words = [], [], [], [], [], 0, np.zeros(len(texts))
        for i, j, s in self._slices(column):
            found = [(own[at], part[at]) for own, part in s.parts() for at in [np.flatnonzero(worth[part >> shift])]]
            own, part = (np.concatenate(x) for x in zip(*found, strict=True))
            kinds.append(s.kinds[own])
            parts.append(part)
            known = np.zeros(len(s.kinds), bool)
            known[own] = True
            keep = known[s.kind]
            words.append(s.kinds[s.kind[keep]])
            sentence.append(s.of_word[keep] + total)
            text.append(s.text + i)
            total += s.count
            self.words[i:j] = np.diff(s.words.first)
        whole = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        self.total, self.text, self.sentence, self.texts, self.label = total, whole(text, np.int64), whole(sentence, np.int64), len(texts), label
        names, self.kind = np.unique(whole(words, np.uint64), return_inverse=True)
        self.parts, part = np.unique(whole(parts, np.uint64), return_inverse=True)
        self.kinds, size = len(names), max(1, len(self.parts))
        # a part counts once in a word, however many slices and places of the word it comes from
        pairs = np.unique(np.searchsorted(names, whole(kinds, np.uint64)) * size + part)
        self.own, self.part = pairs // size, pairs % size
        self._keep(self._chosen())

    @staticmethod
    def _slices(column: pa.Array) -> Iterator[tuple[int, int, Sentences]]:
        for i, j, data, offsets in byte_slices(column, 1 << 19):
            s = Sentences(data, offsets)
            if len(s.kinds):
                yield i, j, s

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Toxic and clean documents that each part stands in."""
        size = max(1, len(self.parts))
        pairs = np.unique(self.text[self.sentence] * max(1, self.kinds) + self.kind)
        text, kind = pairs // max(1, self.kinds), pairs % max(1, self.kinds)
        count = np.bincount(self.own, minlength=self.kinds)  # own is sorted
        n = count[kind]
        at = np.repeat((np.cumsum(count) - count)[kind] - np.cumsum(n) + n, n) + np.arange(n.sum())
        key = np.unique(np.repeat(text, n) * size + self.part[at])
        bad = self.label[key // size]
        return np.bincount(key[bad] % size, minlength=size).astype(float), np.bincount(key[~bad] % size, minlength=size).astype(float)

    def _chosen(self) -> np.ndarray:
        if not len(self.parts):
            return np.zeros(0, bool)
        pos, neg = self.counts()
        g = np.where(pos >= LEAST_DOCUMENTS, ratio(pos, neg, int(self.label.sum()), int((~self.label).sum())), 0.0)
        # parts of the very same words are one part; the first stands for them
        mark = np.zeros(len(self.parts), np.uint64)
        np.add.at(mark, self.part, mix(self.own.astype(np.uint64) + np.uint64(1)))
        first = np.zeros(len(self.parts), bool)
        first[np.unique(mark, return_index=True)[1]] = True
        g = np.where(first, g, 0.0)
        floor = np.sort(g)[-MOST_PARTS] if len(g) > MOST_PARTS else 0.0
        return g >= max(LEAST_RATIO, floor)

    def _keep(self, good: np.ndarray) -> None:
        """Go on with ``good`` parts and the words that have one."""
        keep = good[self.part]
        self.part, self.parts = (np.cumsum(good) - 1)[self.part[keep]], self.parts[good]
        has = np.zeros(self.kinds, bool)
        has[self.own[keep]] = True
        number = np.cumsum(has) - 1
        self.own, self.kinds = number[self.own[keep]], int(has.sum())
        stays = has[self.kind]
        self.kind, self.sentence = number[self.kind[stays]], self.sentence[stays]

    def weights(self, rows: np.ndarray, shrink: float, rounds: int) -> tuple[np.ndarray, float]:
        """Weights of the parts and the leak, from the documents of ``rows``."""
        size, n = len(self.parts), int(rows.sum())
        kinds, standing = self.kinds, rows[self.text][self.sentence]
        sentence, kind = self.sentence[standing], self.kind[standing]
        # a word of many parts would take a step with each of them
        rate = RATE / max(1.0, len(self.part) / max(1, kinds)) ** 0.5
        w, seen, leak = np.zeros(size), np.full(size, 1e-8), -2.0
        alive = np.ones(size, bool)
        for turn in range(rounds):
            if turn == rounds // 2:  # only parts of clear evidence go on, unshrunk
                alive, shrink, seen = w > 0.05 * max(w.max(initial=0.0), 1e-9), 0.0, np.full(size, 1e-8)
                w = np.where(alive, w, 0.0)
            # the bias sinks to its place over the first half, else no sentence would ever be blamed
            bias = BIAS + (-3.0 - BIAS) * max(0.0, 1 - 2 * turn / rounds)
            of_kind = np.bincount(self.own, w[self.part], kinds)
            p = np.clip(1 / (1 + np.exp(-np.minimum(bias + np.bincount(sentence, of_kind[kind], self.total), 40))), 0, 1 - 1e-9)
            l = 1 / (1 + np.exp(-leak))
            clean = (1 - l) * np.exp(np.bincount(self.text, np.log1p(-p), self.texts))
            blame = np.where(rows, np.where(self.label, clean / np.maximum(1 - clean, 1e-9), -1.0), 0.0)
            push = np.bincount(kind, (blame[self.text] * p)[sentence], kinds)
            slope = np.bincount(self.part, push[self.own], size)
            seen += slope**2
            w = np.maximum(0.0, w + rate / np.sqrt(seen) * (slope - shrink * n / 100) * alive * (seen > 1e-7))
            leak += 0.1 * float(np.sign((blame * l).sum())) * (1 - turn / rounds)
        return w, float(1 / (1 + np.exp(-leak)))

    def evidence(self, w: np.ndarray) -> np.ndarray:
        of_kind = np.bincount(self.own, w[self.part], self.kinds)
        z = np.clip(BIAS + np.bincount(self.sentence, of_kind[self.kind], self.total), -40, 40)
        return excess(self.text, 1 / (1 + np.exp(-z)), self.texts)


def learn(texts: list[str], toxic: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Noisy-or over sentences from document labels; shrinkage and calibration from a fifth left out."""
    nothing = np.empty(0, np.uint64), np.empty(0)
    if not len(texts) or not toxic.any() or toxic.all():
        return Model(*nothing, float(toxic.mean()) if len(toxic) else 0.0)
    sample = Sample(texts, toxic)
    label, every = sample.label, np.ones(len(texts), bool)
    fold = np.array([zlib.crc32(t[:32].encode()) % 5 == 0 for t in texts])  # near copies begin alike and fall into one fold
    best, shrink, calibration = np.inf, SHRINKS[1], None
    if min((label & fold).sum(), (~label & fold).sum(), (label & ~fold).sum()) >= LEAST_TOXIC:
        for one in SHRINKS:
            w, leak = sample.weights(~fold, one, rounds)
            e = sample.evidence(w)
            told = fold & (e > 0)
            b = calibrated(e[told], sample.words[told], label[told])
            p = Model(sample.parts, w, leak, b).document_scores(e[fold], sample.words[fold])
            loss = -float(np.mean(np.log(np.clip(np.where(label[fold], p, 1 - p), 1e-3, 1))))
            if loss < best - 1e-4:
                best, shrink, calibration = loss, one, b
    w, leak = sample.weights(every, shrink, rounds)
    kept = w > 0
    return Model(sample.parts[kept], w[kept], leak, calibration)



def fit(docs: DataFrame, labels: DataFrame, usable: Column, documents: int = DOCUMENTS, longest: int = LONGEST) -> Model | None:
    """Learn from ``documents`` labelled rows at most where ``usable`` (on doc_id); None if there is none."""
    chosen = labels.filter(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    # those first by hash lie in a share of its range: about twice as many as wanted are ever sorted
    drawn, known = F.xxhash64("doc_id", F.lit(17)), max(1, chosen.count())
    chosen = chosen.filter(drawn.cast("double") / 2.0**64 + 0.5 <= min(1.0, (2.0 * documents + 100.0) / known)).orderBy(drawn, "doc_id", "toxic").limit(documents)
    rows = docs.select("doc_id", "text").filter(F.length("text") <= longest).join(chosen, "doc_id").orderBy("doc_id", "toxic", F.xxhash64("text"))
    got = rows.select("text", F.col("toxic").cast("int").alias("toxic")).limit(2 * documents).toPandas()
    got = got.drop_duplicates()  # copies are no further evidence
    return learn(list(got["text"]), got["toxic"].to_numpy()) if len(got) else None


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """``docs`` without text, and score, predicted, offending.

    ``offending`` has the sentences to blame, as start:end in code points: of a document predicted toxic, those whose own
    probability is a tenth or more of what noisy-or makes of all.
    """
    docs = without(docs, "score", "predicted", "offending")
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(*rest, F.col("text").cast("string").alias("text"))
    names = [*rest, "score", "predicted", "offending"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(batch.num_columns - 1))
            for i, j, data, offsets in byte_slices(texts, 1 << 20):
                out, where = np.zeros(j - i), [""] * (j - i)
                if model is not None:
                    s = Sentences(data, offsets)
                    p = model.sentence_scores(s)
                    evidence = model.evidence(s, p, j - i)
                    out = model.document_scores(evidence, np.diff(s.words.first))
                    bad = np.flatnonzero((out >= threshold)[s.text] & (p >= 0.1 * -np.expm1(-evidence[s.text])))
                    if len(bad):
                        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                        for k in bad.tolist():
                            at = chars[offsets[s.text[k]]]
                            where[s.text[k]] += f",{chars[s.start[k]] - at}:{chars[s.end[k]] - at}"
                out = np.clip(out, 0.0, 1.0)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out), pa.array((out >= threshold).astype(np.int32)), pa.array([x[1:] for x in where], pa.string())], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(frugal(run), f"{kinds}, score double, predicted int, offending string")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = fit(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    return score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
