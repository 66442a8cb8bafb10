"""Toxicity: a small convolutional text classifier trained in numpy.

Words are lower-cased runs of letters, digits and non-ASCII bytes. A word's
vector is the sum of hashed embeddings: two hashes of the whole word and one of
its first bytes, so that one collision never looks like the word itself. Filters
of widths 1, 2 and 3 run over the word vectors; each filter keeps its maximum
over the whole text (ReLU), and a linear layer gives the score.

Every label counts: texts that labels name are turned into the buckets of their
words once (``hashed``), each different text and label once, and dealt by a digest
into shards of about ``SHARD_DOCS`` texts. The first component of an embedding starts as the
smoothed log-odds of its bucket over all training texts, summed by Spark, the others
at random. Then ``ROUNDS`` rounds follow: each shard starts from the model of all
and trains on its texts by Adam on the log loss, with gradients flowing through the
maxima; the new model is the mean of the shards' weights, for a bucket that of the
shards that moved it, by how often they did. Sums are in whole numbers, so their order
does not matter. Buckets that no training text uses stay zero. Scores are calibrated on a
validation part, a seventh of the texts, that is not trained on (a logistic fit), and a threshold is
chosen for each language; a language without enough validation rows uses the
threshold of all. Both come from counts of all validation logits in steps of ``1 / GRAIN``.

The driver holds the weights (their number depends on ``BITS`` alone) and those counts;
a task holds one shard, ``PART_WORDS`` words of it at most and a text more. Training and
scoring take whole texts, a long one in steps of ``STEP_WORDS`` words.

To score, filters are folded into one table row per word: the activation of a
filter of width w is the sum of w table entries. So a text costs one gather and
a few maxima, in Arrow batches.

Defined results: a null or empty text has no words and gets the score of an
all-zero pooling. Repeated rows get equal scores, and a tie at a threshold is
rejected. Without any toxic or any clean label every score is the share of toxic
labels (0 without labels). Labels without an id or of other values than 0 and 1
are not used. A null language has the threshold of all. An empty table gives no
rows; extra columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robustlake.llm.common import Scratch, batches_of, prepare, tidy
from robustlake.llm.decontaminate import WORD_BYTES, words_of
from robustlake.llm.minhash import bounded

#: Texts of a shard, words that it trains on at a time, rounds, and passes of a shard over its texts in a round.
SHARD_DOCS = 3000
PART_WORDS = 3_000_000
ROUNDS, PASSES = 3, 2
#: Steps of a logit that are told apart in calibration, the largest logit, and steps of a weight in sums.
GRAIN, FAR, FIXED = 512, 60.0, 1 << 24
#: Bounds of ``training_rows``: documents of each label, and characters of all.
SAMPLE = 3500
SAMPLE_CHARS = 24_000_000
BITS = 17
DIMS = 6
WIDTHS = (1, 2, 3)
FILTERS = 6
PREFIX = 5
CUT = 0.7
#: Words that a worker keeps table rows for, and words in one numpy step.
KEPT_WORDS = 50_000
STEP_WORDS = 30_000

#: A byte that is part of no word.
SEPARATOR = re.compile(b"[" + b"".join(re.escape(bytes([k])) for k in range(256) if not WORD_BYTES[k : k + 1].strip()) + b"]")
_MASK = (1 << BITS) - 1


def buckets(word: bytes) -> tuple[int, int, int]:
    a = zlib.crc32(word)
    b = zlib.adler32(word[::-1]) * 0x9E3779B1 ^ (a >> 7)
    c = zlib.crc32(word[:PREFIX], 0x5BD1)
    return a & _MASK, (1 << BITS) + (b & _MASK), (2 << BITS) + (c & _MASK)


class Model:
    """Folded tables and calibration; small enough to broadcast (its size depends on BITS alone)."""

    def __init__(self, embeddings, filters, bias, head, head_bias):
        # parts[w][j]: what the j-th word of a window gives to the filters of width w
        self.embeddings = embeddings.astype(np.float32)
        self.filters = [[f[j].astype(np.float32) for j in range(w)] for w, f in zip(WIDTHS, filters)]
        self.bias = np.concatenate(bias).astype(np.float32)
        self.head, self.head_bias = head.astype(np.float32), float(head_bias)
        self.scale, self.shift = 1.0, 0.0
        self.thresholds: dict[str, float] = {}
        self.threshold = CUT
        self.constant: float | None = None

    def projection(self) -> np.ndarray:
        return np.concatenate([part for group in self.filters for part in group], axis=1)

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -30, 30)))


class Scorer:
    """Scores of texts, with a bounded table of folded word rows (one per Python worker)."""

    def __init__(self, model: Model):
        self.model, self.projection = model, model.projection()
        self.width = self.projection.shape[1]
        self.number: dict[bytes, int] = {}
        self.table = np.zeros((1024, self.width), np.float32)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        known = self.number
        new = [w for w in dict.fromkeys(words) if w not in known]
        if len(known) + len(new) > KEPT_WORDS + STEP_WORDS:
            known.clear()
            new = list(dict.fromkeys(words))
        if new:
            while len(known) + len(new) > len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            rows = np.array([buckets(w) for w in new])
            at = len(known)
            vectors = self.model.embeddings[rows].sum(axis=1)
            # term by term: a word's row must not depend on the words that came with it
            self.table[at : at + len(new)] = sum(vectors[:, d, None] * self.projection[d] for d in range(vectors.shape[1]))
            known.update(zip(new, range(at, at + len(new))))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _pooled(self, words: list[bytes], counts: list[int], last: list[bool]) -> np.ndarray:
        """Maxima of every filter over the windows of each part of a text.

        A last part has zeros behind it (one without words is a zero word). Of another part, windows that start at
        its last words belong to the next part, which begins with them.
        """
        pad = max(WIDTHS) - 1
        sizes = np.maximum(counts, 1) + pad
        starts = np.cumsum(sizes) - sizes
        rows = np.zeros((int(sizes.sum()) + 1, self.width), np.float32)
        places = np.arange(len(words)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
        numbers = self._numbers(words)  # may replace the table
        rows[places] = self.table[numbers]
        out, column = [], 0
        for width in WIDTHS:
            total = rows[:, column : column + FILTERS].copy()
            for j in range(1, width):
                total[:-j] += rows[j:, column + j * FILTERS : column + (j + 1) * FILTERS]
            column += width * FILTERS
            # the last windows would reach the next text: each text's own end before them, as in training
            windows = np.where(last, sizes - width + 1, sizes - 2 * pad)
            cuts = np.stack((starts, starts + windows), axis=1).ravel()
            out.append(np.maximum.reduceat(total, cuts, axis=0)[::2])
        return np.concatenate(out, axis=1)

    def logits(self, texts: list[bytes | None]) -> np.ndarray:
        best = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        words, counts, last, owner = [], [], [], []

        def step():
            if counts:
                np.maximum.at(best, owner, self._pooled(words, counts, last))
                for queue in (words, counts, last, owner):
                    queue.clear()

        for n, text in enumerate(texts):
            for part, ends in parts_of(text):
                if len(words) + len(part) > STEP_WORDS:
                    step()
                words += part
                counts.append(len(part))
                last.append(ends)
                owner.append(n)
        step()
        # a sum by rows, not a matrix product: the number of texts must not change the last digits
        return (np.maximum(best + self.model.bias, 0) * self.model.head).sum(axis=1) + self.model.head_bias

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant)
        return self.model.calibrated(self.logits(texts).astype(np.float64))


def parts_of(text: bytes | None) -> Iterator[tuple[list[bytes], bool]]:
    """(words, whether they end the text) of the parts of a text: at most STEP_WORDS // 2 + 3 words each.

    A part begins with the last words of the one before, as many as a window reaches.
    """
    text, at, own = text or b"", 0, []
    while True:
        end = at + STEP_WORDS  # a word and its gap take two bytes at least
        if end < len(text):  # on to the end of the word
            found = SEPARATOR.search(text, end)
            end = found.start() if found else len(text)
        own = own + words_of(text[at:end])
        at = end
        if at >= len(text):
            yield own, True
            return
        if len(own) >= max(WIDTHS):
            yield own, False
            own = own[1 - max(WIDTHS) :]


def _pieces(rows: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first word, vectors) of a text in steps; zeros behind its end, and a step reaches as far as a window does."""
    pad, n = max(WIDTHS) - 1, len(rows)
    for at in range(0, max(n, 1), STEP_WORDS):
        part = rows[at : at + STEP_WORDS + pad]
        vectors = np.zeros((min(STEP_WORDS, max(n - at, 1)) + pad, table.shape[1]), np.float32)
        vectors[: len(part)] = table[part].sum(axis=1)
        yield at, vectors


def _maxima(rows: np.ndarray, table: np.ndarray, filters: list, bias: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Pooled values of a text, and for each width the words where the windows of the maxima start."""
    pad = max(WIDTHS) - 1
    found, where = [None] * len(WIDTHS), [None] * len(WIDTHS)
    for start, vectors in _pieces(rows, table):
        n, ends = len(vectors) - pad, start + len(vectors) - pad >= len(rows)
        for i, (f, w) in enumerate(zip(filters, WIDTHS)):
            windows = n + pad - w + 1 if ends else n  # the windows that follow belong to the next step
            total = vectors[:windows] @ f[0]
            for j in range(1, w):
                total = total + vectors[j : windows + j] @ f[j]
            best = total.argmax(axis=0)
            top = total[best, np.arange(FILTERS)]
            if found[i] is None:
                found[i], where[i] = top, best + start
            else:
                more = top > found[i]
                found[i], where[i] = np.where(more, top, found[i]), np.where(more, best + start, where[i])
    return np.concatenate([t + b for t, b in zip(found, bias)]), where


def _split(params: list) -> tuple:
    k = len(WIDTHS)
    return params[0], params[1 : 1 + k], params[1 + k : 1 + 2 * k], params[-2], params[-1]


def descend(params: list[np.ndarray], docs: list[np.ndarray], labels: list[int], share: float, seed: int) -> tuple[list[np.ndarray], np.ndarray]:
    """``PASSES`` passes of Adam from ``params`` over texts (buckets of their words): new weights, and how often each bucket moved."""
    rng = np.random.default_rng(seed)
    params = [p.copy() for p in params]
    table, filters, bias, head, head_bias = _split(params)
    first, second = [None, *[np.zeros_like(p) for p in params[1:]]], [np.zeros_like(p) for p in params]
    moved = np.zeros(len(table), np.int64)
    order = np.array([k for k, rows in enumerate(docs) if len(rows)], np.int64)
    turn = 0
    for _ in range(PASSES):
        rng.shuffle(order)
        for at in range(0, len(order), 32):
            batch = order[at : at + 32]
            grads = [None, *[np.zeros_like(p) for p in params[1:]]]
            touched, touches = [], []
            for k in batch:
                rows = docs[k]
                n = len(rows)
                z, where = _maxima(rows, table, filters, bias)
                hidden = np.maximum(z, 0)
                p = 1 / (1 + np.exp(-np.clip(hidden @ head + head_bias[0], -30, 30)))
                y = labels[k]
                g = (p - y) * (0.5 / share if y else 0.5 / (1 - share)) / len(batch)
                grads[-1] += g
                grads[-2] += g * hidden
                back = np.where(z > 0, g * head, 0)
                for i, (f, w) in enumerate(zip(filters, WIDTHS)):
                    own = back[i * FILTERS : (i + 1) * FILTERS]
                    grads[1 + len(WIDTHS) + i] += own
                    for j in range(w):
                        at_word = where[i] + j
                        inside = np.flatnonzero(at_word < n)
                        if len(inside):
                            buckets_there = rows[at_word[inside]]
                            vectors = table[buckets_there].sum(axis=1)
                            grads[1 + i][j][:, inside] += (vectors * own[inside, None]).T
                            push = f[j].T[inside] * own[inside, None]
                            for h in range(3):
                                touched.append(buckets_there[:, h])
                                touches.append(push)
            turn += 1
            rate = 0.01 * min(1, turn / 20)
            for i in range(1, len(params)):
                first[i] = 0.9 * first[i] + 0.1 * grads[i]
                second[i] = 0.99 * second[i] + 0.01 * grads[i] ** 2
                params[i] -= rate * (first[i] / (1 - 0.9**turn) / (np.sqrt(second[i] / (1 - 0.99**turn)) + 1e-6))
            if touched:
                spots, inverse = np.unique(np.concatenate(touched), return_inverse=True)
                push = np.zeros((len(spots), DIMS), np.float32)
                np.add.at(push, inverse, np.concatenate(touches))
                second[0][spots] = 0.99 * second[0][spots] + 0.01 * push**2
                table[spots] -= 0.1 * rate * push / (np.sqrt(second[0][spots]) + 1e-4)
                moved[spots] += 1
    return params, moved


def _flat(params: list[np.ndarray]) -> np.ndarray:
    """All weights but the embeddings, in rows as long as those of the embeddings."""
    own = np.concatenate([p.ravel() for p in params[1:]])
    return np.concatenate((own, np.zeros(-len(own) % DIMS, np.float32))).reshape(-1, DIMS)


def _unflat(values: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    out, at, values = [], 0, values.ravel()
    for p in like[1:]:
        out.append(values[at : at + p.size].reshape(p.shape).astype(np.float32))
        at += p.size
    return out


HASHED = "shard int, mark binary, held boolean, toxic int, lang string, words binary"
COUNTS = "bucket int, clean long, toxic long"
WEIGHTS = "bucket int, n long, " + ", ".join(f"v{d} long" for d in range(DIMS))
BINS = "lang string, bin int, clean long, toxic long"
#: Rows of ``COUNTS`` that count documents: of the training and of the validation part.
TRAINED, HELD = -1, -2


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[f.split()[0] for f in schema.split(", ")])


def hashed(texts: DataFrame, shards: int) -> DataFrame:
    """``HASHED`` of (toxic, lang, text): three buckets (int32) for each word. A task sends a text that it meets again once."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, met = {}, np.zeros((1024, 3), np.int32), set()
        for batch in batches:
            out = []
            for toxic, lang, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                mark = hashlib.blake2b(text, digest_size=16).digest()
                if (mark, toxic, lang) in met:
                    continue
                if len(met) > KEPT_WORDS:
                    met.clear()
                met.add((mark, toxic, lang))
                parts = []
                for at, (own, _) in enumerate(parts_of(text)):
                    own = own[max(WIDTHS) - 1 :] if at else own  # a part begins with the last words of the one before
                    if len(number) > KEPT_WORDS:
                        number.clear()
                    new = [w for w in dict.fromkeys(own) if w not in number]
                    while len(number) + len(new) > len(rows):
                        rows = np.concatenate((rows, np.zeros_like(rows)))
                    if new:
                        rows[len(number) : len(number) + len(new)] = [buckets(w) for w in new]
                        number.update(zip(new, range(len(number), len(number) + len(new))))
                    parts.append(rows[np.fromiter(map(number.__getitem__, own), np.int64, len(own))].tobytes())
                out.append((int.from_bytes(mark[:8], "little") % shards, mark, zlib.crc32(text) % 7 == 0, toxic, lang, b"".join(parts)))
            if out:
                columns = list(zip(*out))
                kinds = (pa.int32(), pa.binary(), pa.bool_(), pa.int32(), pa.string(), pa.binary())
                yield _batch(HASHED, *(pa.array(c, kind) for c, kind in zip(columns, kinds)))

    return texts.select("toxic", "lang", "text").mapInArrow(work, HASHED).repartition("shard").sortWithinPartitions("shard", "mark", "toxic", "lang")


def _rows(batches: Iterator[pa.RecordBatch], hold: bool) -> Iterator[tuple[int, bool, int, str | None, np.ndarray]]:
    """(shard, held, toxic, lang, buckets) of each different row; rows of a shard follow each other, equal ones too."""
    last = None
    for batch in batches:
        for shard, mark, held, toxic, lang, words in zip(*(batch.column(c).to_pylist() for c in range(6))):
            if (mark, toxic, lang) != last:
                last = (mark, toxic, lang)
                yield shard, held and hold, toxic, lang, np.frombuffer(words, np.int32).reshape(-1, 3)


def _counter(hold: bool):
    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held_seen = np.zeros((2, 3 << BITS), np.int64), [0, 0]
        total = [0, 0]
        for _, held, toxic, _, rows in _rows(batches, hold):
            if held:
                held_seen[toxic] += 1
            else:
                total[toxic] += 1
                seen[toxic, np.unique(rows)] += 1
        used = np.flatnonzero(seen.sum(axis=0))
        clean, toxic = ([*(c[k] for c in (total, held_seen)), *seen[k, used].tolist()] for k in (0, 1))
        yield _batch(COUNTS, pa.array([TRAINED, HELD, *used.tolist()], pa.int32()), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64()))

    return work


def _trainer(shared, hold: bool, share: float, seed: int):
    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value

        def part(shard, docs, labels):
            params, moved = descend(start, docs, labels, share, seed + shard)
            spots = np.flatnonzero(moved)
            dense = _flat(params)
            bucket = np.concatenate((spots, len(moved) + np.arange(len(dense))))
            n = np.concatenate((moved[spots], np.full(len(dense), len(docs))))
            values = np.rint(np.concatenate((params[0][spots], dense)).astype(np.float64) * FIXED).astype(np.int64) * n[:, None]
            return _batch(WEIGHTS, bucket.astype(np.int32), n, *values.T.copy())

        own, docs, labels, size = None, [], [], 0
        for shard, held, toxic, _, rows in _rows(batches, hold):
            if docs and (shard != own or size > PART_WORDS):
                yield part(own, docs, labels)
                docs, labels, size = [], [], 0
            own = shard
            if not held:
                docs.append(rows)
                labels.append(toxic)
                size += len(rows)
        if docs:
            yield part(own, docs, labels)

    return work


def _measurer(shared, hold: bool, validation: bool):
    """Logits of the validation part, or of the training part, counted."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, filters, bias, head, head_bias = _split(shared.value)
        met: dict[tuple, list[int]] = {}
        for _, held, toxic, lang, rows in _rows(batches, hold):
            if bool(held) == validation:
                logit = np.maximum(_maxima(rows, table, filters, bias)[0], 0) @ head + head_bias[0]
                met.setdefault((lang or "", round(float(np.clip(logit, -FAR, FAR)) * GRAIN)), [0, 0])[toxic] += 1
        if met:
            langs, bins = zip(*met)
            clean, toxic = zip(*met.values())
            yield _batch(BINS, pa.array(langs, pa.string()), pa.array(bins, pa.int32()), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64()))

    return work


def _summed(rows: DataFrame, keys: list[str]) -> pa.Table:
    """Sums of all other columns by ``keys``; as many rows as keys, not as the input."""
    sums = [F.sum(c).alias(c) for c in rows.columns if c not in keys]
    with batches_of(rows.sparkSession, 50_000):
        return rows.groupBy(*keys).agg(*sums).toArrow()


def learnt(data: DataFrame, seed: int = 11) -> Model:
    """The model of ``data``, a written table of ``hashed``."""
    context = data.sparkSession.sparkContext
    size, rng = 3 << BITS, np.random.default_rng(seed)

    def counted(hold: bool):
        found = _summed(data.mapInArrow(_counter(hold), COUNTS), ["bucket"])
        bucket = found["bucket"].to_numpy()
        of = np.stack([found[c].to_numpy() for c in ("clean", "toxic")])
        docs = [of[:, bucket == k].sum(axis=1) for k in (TRAINED, HELD)]
        return bucket[bucket >= 0], of[:, bucket >= 0].astype(np.float32), *docs

    hold = True
    used, seen, trained, held = counted(hold)
    if trained.min() == 0 and held.sum():
        hold = False
        used, seen, trained, held = counted(hold)
    table = np.zeros((size, DIMS), np.float32)
    filters = [np.zeros((w, DIMS, FILTERS), np.float32) for w in WIDTHS]
    head = np.zeros(FILTERS * len(WIDTHS), np.float32)
    if trained.min() == 0:
        model = Model(table, filters, [np.zeros(FILTERS)] * len(WIDTHS), head, 0.0)
        model.constant = float(trained[1] / trained.sum()) if trained.sum() else 0.0
        return model

    # log-odds of each bucket by document frequency
    order = np.argsort(used)
    used, seen = used[order], seen[:, order]
    n0, n1 = trained.astype(float)
    odds = np.log((seen[1] + 0.5) / (n1 + 1.0)) - np.log((seen[0] + 0.5) / (n0 + 1.0))
    table[used] = rng.normal(0, 0.02, (len(used), DIMS))
    table[used, 0] = np.clip(odds, -2, 4) * (seen.sum(axis=0) / (seen.sum(axis=0) + 3.0)) / 3
    filters = [rng.normal(0, 0.1, f.shape).astype(np.float32) for f in filters]
    for f in filters:
        f[0, 0] += 1.0  # each filter starts as a detector of telling words
    bias = [np.full(FILTERS, -0.5, np.float32) for _ in WIDTHS]
    params = [table, *filters, *bias, head + np.float32(0.1), np.zeros(1, np.float32)]
    for turn in range(ROUNDS):
        shared = context.broadcast(params)
        found = _summed(data.mapInArrow(_trainer(shared, hold, n1 / (n0 + n1), seed + 1_000_003 * turn), WEIGHTS), ["bucket"])
        shared.destroy()
        bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
        mean = np.stack([found[f"v{d}"].to_numpy() for d in range(DIMS)], axis=1) / (n[:, None] * float(FIXED))
        params[0][bucket[bucket < size]] = mean[bucket < size]
        rest = np.argsort(bucket[bucket >= size])
        params = [params[0], *_unflat(mean[bucket >= size][rest], params)]
    table, filters, bias, head, head_bias = _split(params)
    model = Model(table, filters, bias, head, head_bias[0])

    shared = context.broadcast(params)
    found = _summed(data.mapInArrow(_measurer(shared, hold, held.sum() >= 50 and held.min() > 0), BINS), ["lang", "bin"]).sort_by([("lang", "ascending"), ("bin", "ascending")])
    shared.destroy()
    logits, counts = found["bin"].to_numpy() / GRAIN, np.stack([found[c].to_numpy() for c in ("clean", "toxic")]).astype(float)
    model.scale, model.shift = _logistic(logits, counts)
    scores = model.calibrated(logits)
    model.threshold = _threshold(scores, counts)
    own = np.array(found["lang"].to_pylist())
    for lang in sorted(set(own.tolist())):
        if counts[:, own == lang].sum(axis=1).min() >= 20:
            model.thresholds[lang] = _threshold(scores[own == lang], counts[:, own == lang])
    return model


def _logistic(logits: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic fit to logits and their clean and toxic rows, held back a little so that separable rows stay finite."""
    rows, total = counts.sum(axis=0), counts.sum()
    order = np.argsort(logits, kind="stable")
    centre = float(logits[order][np.searchsorted(np.cumsum(rows[order]), total / 2)])
    mean = float((logits * rows).sum() / total)
    spread = math.sqrt(float(((logits - mean) ** 2 * rows).sum() / total)) or 1.0
    x, a, b = (logits - centre) / spread, 1.0, 0.0
    share = np.clip(counts[1].sum() / total, 0.01, 0.99)
    weight = np.stack((counts[0] * 0.5 / (1 - share), counts[1] * 0.5 / share)) / total
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = weight[0] * p + weight[1] * (p - 1)
        a, b = a - 1.0 * ((g * x).sum() + 0.001 * a), b - 1.0 * g.sum()
    a = max(a, 1e-3)
    return a / spread, b - a * centre / spread


def _threshold(scores: np.ndarray, counts: np.ndarray) -> float:
    """The cut of the fewest errors (a rejected clean text counts twice); of equals, the nearest to CUT."""
    cuts = np.unique(np.clip(np.concatenate((scores, [CUT])), 0.05, 0.95))
    middle = np.concatenate((cuts, (cuts[1:] + cuts[:-1]) / 2))
    order = np.argsort(scores, kind="stable")
    clean, toxic = (np.concatenate(([0], np.cumsum(c[order]))) for c in counts)
    below = np.searchsorted(scores[order], middle, "left")
    cost = 2 * (clean[-1] - clean[below]) + toxic[below]
    best = np.flatnonzero(cost == cost.min())
    return float(middle[best[np.abs(middle[best] - CUT).argmin()]])


def known(labels: DataFrame, keep: Column | None = None) -> DataFrame:
    """(doc_id, toxic) of labels that can be used, each once. ``keep``: a condition on ``doc_id``."""
    wanted = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    wanted = wanted.where(keep) if keep is not None else wanted
    return wanted.select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: Column | None = None, chars: int = SAMPLE_CHARS) -> list:
    """(text, lang, toxic) of a bounded sample, in the order of a hash, for a look at labels. ``keep``: a condition on ``doc_id``.

    Nothing is learnt from it: ``fit`` takes every labelled text.
    """
    wanted = known(labels, keep)
    ids = None
    for label in (1, 0):  # sorted by a hash: the same rows at any partitioning
        part = wanted.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        ids = part if ids is None else ids.unionByName(part)
    data = F.col("text").cast("binary")
    texts = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= chars)).select("doc_id", "lang", data.alias("text"))
    # the sample is at most 2 * sample ids, so it may be broadcast; of a repeated id one row stays in each task
    found = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by(F.struct("lang", "text"), F.struct(F.xxhash64("text"), "text")).alias("r"))
    order = F.struct(F.xxhash64("doc_id"), "doc_id", "toxic")
    with Scratch() as scratch:
        held = scratch.written(found.select(order.alias("at"), "toxic", "r.lang", "r.text"), "labelled-texts")
        fits, total = [], 0
        for r in sorted(held.select("at", F.octet_length("text").alias("n")).collect(), key=lambda r: tuple(r["at"])):
            if total + r.n <= chars:
                fits.append((r["at"],))
                total += r.n
        chosen = held.sparkSession.createDataFrame(fits, held.select("at").schema)
        return sorted(held.join(F.broadcast(chosen), "at").collect(), key=lambda r: tuple(r["at"]))


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None, seed: int = 11) -> Model:
    """The model of all texts that a label names. ``keep``: a condition on ``doc_id``."""
    with Scratch() as scratch:
        ids = scratch.written(known(labels, keep), "labels")
        texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text"))
        shards = -(-ids.count() // SHARD_DOCS) or 1
        return learnt(scratch.written(hashed(texts.join(bounded(ids), "doc_id"), shards), "labelled-words"), seed)


def scorer_of(spark, model: Model):
    """A function from a text column to its score column."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    @tidy
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Scorer(shared.value)
        for batch in batches:
            yield pa.array(own.scores(batch.cast(pa.binary()).to_pylist()), pa.float64())

    return score


def rejected(score: Column, lang: Column, model: Model) -> Column:
    """Whether a score reaches the threshold of the document's language."""
    cut = F.lit(model.threshold)
    for name, value in model.thresholds.items():
        cut = F.when(lang == name, value).otherwise(cut)
    return score >= cut


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op1_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7) and rejected (the language's own threshold)."""
    spark = docs.sparkSession
    prepare(spark)
    model = fit(docs, labels, keep=~held_out(F.col("doc_id")))
    scored = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("lang"), scorer_of(spark, model)(F.col("text")).alias("score")
    )
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
        rejected(F.col("score"), F.col("lang"), model).alias("rejected"),
    )
