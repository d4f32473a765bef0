"""Problem 10: the subject areas of each document.

A sentence is the mean of the embeddings of its hashed words, word pairs and subwords; independent
logistic outputs, one a subject, read that mean. Training runs in rounds: every partition of the
training sentences sends the gradient of its rows, the driver adds them and takes one Adam step. The
fitted product of embeddings and outputs is one small table (buckets by subjects) with which every
sentence of every document is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise

#: Most labelled documents and most other documents in training (documented bounds; all are scored).
LABELLED, UNLABELLED = 2500, 5000
BUCKETS, DIMENSIONS = 1 << 15, 8
ROUNDS = 50
SLICES = 6  # a round reads one document in so many
RATE, DECAY = 0.15, 1e-6
PARTITIONS = 4  # of the sample, whose size is bounded; scoring runs on all partitions of the documents
#: Passes over the model's own labels, each going on from the one before: rounds, the score of a clear
#: sentence, and the share of characters in clear sentences that a document needs to be learnt from.
TEACHING = ((25, 0.5, 0.5), (25, 0.0, 0.4), (25, -1.0, 0.3))
SHARE = 0.2
SURE = 0.75  # share of a document's characters that its first subject needs to be learnt from
#: A sign that ends a sentence and the space after it, or line ends; found by its first sign, of which texts have few.
_END = re.compile(r"[.!?…。！？\n](?:(?<=[^\sA-ZА-ЯЁ][.!?…])\s+|(?<=\n)\n*|(?<=[。！？]))")
_TOKEN = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+")
_BEYOND = re.compile("[\U00010000-\U0010ffff]")
NUL = "\0"  # between texts that are read in a row


@lru_cache(2)
def _tokens(beyond: bool) -> re.Pattern:
    """``_TOKEN`` or NUL. Unless signs ``beyond`` the first plane matter, its letters are listed, which is found faster."""
    if beyond:
        return re.compile(f"{_TOKEN.pattern}|{NUL}")
    runs: list[list[int]] = []
    for c in range(0x10000):
        if _TOKEN.match(chr(c)) and not "㐀" <= chr(c) <= "鿿":
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return re.compile(f"[㐀-鿿{NUL}]|[{''.join(f'{chr(a)}-{chr(b)}' for a, b in runs)}]+")


def sentences(text: str) -> list[str]:
    out, at = [], 0
    for end in _END.finditer(text):
        i = end.start()
        out.append(text[at : i if text[i] == "\n" else i + 1])
        at = end.end()
    out.append(text[at:])
    return [s for s in out if s and not s.isspace()]


def parts(word: str) -> list[int]:
    """Buckets of a word: the word itself, and for longer words its prefixes and four-letter parts."""
    import xxhash

    own = [word]
    if len(word) >= 6 and word[0] < "㐀":
        own += ["^" + word[:4], "^" + word[:6]] + ["~" + word[i : i + 4] for i in range(1, len(word) - 3, 2)]
    return [xxhash.xxh32_intdigest(p.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for p in own]


class Vocabulary(dict):
    """A number for each word seen, with the buckets of each; forgets all when it grows too large. NUL is 0."""

    def __init__(self) -> None:
        super().__init__({NUL: 0})
        self.buckets: list[list[int]] = [[]]

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self.buckets)
        self.buckets.append(parts(word))
        return n

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row, and where each text ends."""
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row = NUL.join(texts)
        if row.count(NUL) >= len(texts):
            row = NUL.join(t.replace(NUL, " ") for t in texts)
        row = row.lower()
        found = _tokens(_BEYOND.search(row) is not None).findall(row)
        numbers = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        breaks = np.flatnonzero(numbers == 0)
        return numbers[numbers != 0], np.append(breaks, len(numbers)) - np.arange(len(texts))

    def forget(self, most: int = 300_000) -> bool:
        if len(self) > most:
            self.clear()
            self.__init__()
            return True
        return False


def pairs(first: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word with the word before it, and which words have one in their text."""
    has = np.ones(len(first), bool)
    starts = np.concatenate([[0], ends[:-1]])
    has[starts[starts < len(first)]] = False
    out = np.zeros(len(first), np.int64)
    out[1:] = (first[:-1] * 1_000_003 + first[1:] * 7919 + 12345) & (BUCKETS - 1)
    return out, has


def encode(texts: list[str], words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words, word parts and word pairs of all texts in a row, and where each text ends."""
    numbers, ends = words.numbers(texts)
    own = [words.buckets[n] for n in numbers.tolist()]
    pair, has = pairs(np.fromiter((x[0] for x in own), np.int64, len(own)), ends)
    rows = [x + [p] if h else x for x, p, h in zip(own, pair.tolist(), has.tolist())]
    sizes = np.concatenate([[0], np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))])
    return np.fromiter((i for x in rows for i in x), np.int64, int(sizes[-1])), sizes[ends]


def _sums(rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of the rows of each text, in double precision; ``ends`` says where each text ends."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    some = starts < ends
    out = np.zeros((len(ends), rows.shape[1]))
    if some.any():
        out[some] = np.add.reduceat(rows, starts[some], axis=0, dtype=np.float64)
    return out


@dataclass
class Model:
    subjects: list[str]
    table: np.ndarray  # buckets by subjects: embedding times output weights
    bias: np.ndarray

    def reader(self) -> "Reader":
        return Reader(self)

    def scores(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _sums(self.table.take(ids, axis=0), ends) / np.maximum(np.diff(ends, prepend=0), 1)[:, None] + self.bias


class Reader:
    """Scores texts with one table row a word, the sum over its buckets, kept for the words seen."""

    def __init__(self, model: Model) -> None:
        self.model, self.words = model, Vocabulary()
        k = model.table.shape[1]
        self.sums, self.sizes, self.first = np.zeros((1, k), np.float32), np.zeros(1), np.zeros(1, np.int64)  # NUL's

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.words.forget():
            self.sums, self.sizes, self.first = self.sums[:1], self.sizes[:1], self.first[:1]
        numbers, ends = self.words.numbers(texts)
        new = self.words.buckets[len(self.sizes) :]
        if new:
            table = self.model.table
            sizes = np.fromiter(map(len, new), np.int64, len(new))
            own = np.fromiter((i for b in new for i in b), np.int64, int(sizes.sum()))
            self.sums = np.vstack([self.sums, np.add.reduceat(table.take(own, axis=0), np.cumsum(sizes) - sizes, axis=0)])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.first = np.concatenate([self.first, [b[0] for b in new]])
        pair, has = pairs(self.first[numbers], ends)
        each = self.model.table.take(pair, axis=0)
        each[~has] = 0
        each += self.sums.take(numbers, axis=0)
        size = _sums((self.sizes.take(numbers) + has)[:, None], ends)
        return _sums(each, ends) / np.maximum(size, 1) + self.model.bias


def _gradient(ids: np.ndarray, ends: np.ndarray, y: np.ndarray, e: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    sizes = np.diff(ends, prepend=0)
    inverse = 1 / np.maximum(sizes, 1)
    mean = _sums(e.take(ids, axis=0), ends) * inverse[:, None]
    z = mean @ w + b
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    g = p - y
    back = (g @ w.T) * inverse[:, None]
    grad_e = np.stack([np.bincount(ids, np.repeat(x, sizes), BUCKETS) for x in np.ascontiguousarray(back.T)], axis=1)
    loss = -float(np.sum(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)))
    return grad_e, mean.T @ g, g.sum(axis=0), loss


def train(rows: DataFrame, subjects: list[str], rounds: int = ROUNDS, start: list[np.ndarray] | None = None) -> tuple[Model, list[np.ndarray]]:
    """Fit on ``rows`` (ids array<int>, ends array<int>, subject array<int>, slice int), one row a document, from the parameters ``start``.

    Every subject of a document is a target of its own. A round reads one of the slices that have rows.
    """
    spark = rows.sparkSession
    random = np.random.RandomState(5)
    k = len(subjects)
    params = start or [random.normal(0, 0.1, (BUCKETS, DIMENSIONS)), random.normal(0, 0.5, (DIMENSIONS, k)), np.full(k, -2.0)]
    e, w, b = params
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    slices = sorted(r.slice for r in rows.select("slice").distinct().collect())  # at most SLICES
    for t in range(1, rounds + 1 if slices else 1):
        shared = spark.sparkContext.broadcast([e.astype(np.float32), w, b])

        def partial(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = None
            n = 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, sizes, y = [], [], []
                for i, s, label in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    ids.append(i.values.to_numpy())
                    sizes += np.diff(s, prepend=0).tolist()
                    own = np.zeros(k)
                    own[label] = 1
                    y += [own] * len(s)
                target = np.array(y)
                parts = _gradient(np.concatenate(ids).astype(np.int64), np.cumsum(sizes), target, *shared.value)
                n += len(y)
                total = parts if total is None else tuple(a + c for a, c in zip(total, parts))
            if total is not None:
                blob = np.concatenate([total[0].ravel(), total[1].ravel(), total[2], [total[3], n]]).astype(np.float32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["g"])

        grads = [np.frombuffer(bytes(r.g), np.float32).astype(np.float64) for r in rows.where(F.col("slice") == slices[t % len(slices)]).select("ids", "ends", "subject").mapInArrow(partial, "g binary").collect()]
        shared.destroy()
        g = np.sum(grads, axis=0)
        n = max(1.0, g[-1])
        cut = np.cumsum([e.size, w.size, b.size])
        own = [g[: cut[0]].reshape(e.shape) / n, g[cut[0] : cut[1]].reshape(w.shape) / n, g[cut[1] : cut[2]] / n]
        for i, p in enumerate(params):
            d = own[i] + (DECAY * p if i == 0 else 0)
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.99 * v[i] + 0.01 * d**2
            p -= RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-7)
    return Model(subjects, (e @ w).astype(np.float32), b.copy()), params


ENCODED = "doc_id bigint, ids array<int>, ends array<int>, chars array<int>"


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id and the encoded sentences of each document with text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary()
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sentences(text)
                ids, ends = encode(own, words)
                if len(ids):
                    out.append({"doc_id": key, "ids": ids.astype(np.int32), "ends": ends.astype(np.int32), "chars": [len(s) for s in own]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("chars", pa.list_(pa.int32()))]))

    return docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def _smooth(held: np.ndarray) -> np.ndarray:
    around = np.vstack([held[:1], held, held[-1:]])
    return 0.25 * around[:-2] + 0.5 * around[1:-1] + 0.25 * around[2:]


def shares(scores: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Share of the characters that each subject has in a document.

    Scores are clipped and averaged with those of the sentences beside, so that a stray sentence or
    term counts little. A sentence goes to its best subject when that beats 0.5; one that says
    nothing goes with the others of the document.
    """
    held = np.clip(scores, -2, 4)
    smooth = _smooth(held)
    best = smooth.argmax(axis=1)
    sure = smooth[np.arange(len(best)), best] > 0
    out = np.zeros(scores.shape[1])
    if not sure.any():
        out[(held * chars[:, None]).sum(axis=0).argmax()] = 1.0
        return out
    out += np.bincount(best[sure], chars[sure], scores.shape[1])
    return out / out.sum()


def shares_of(scores: np.ndarray, chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``shares`` of many documents, a row each; ``sizes`` says how many sentences (one at least) each has."""
    k = scores.shape[1]
    starts = np.cumsum(sizes) - sizes
    held = np.clip(scores, -2, 4)
    before, after = np.roll(held, 1, axis=0), np.roll(held, -1, axis=0)
    before[starts] = held[starts]
    after[starts + sizes - 1] = held[starts + sizes - 1]
    smooth = 0.25 * before + 0.5 * held + 0.25 * after
    best = smooth.argmax(axis=1)
    sure = smooth.max(axis=1) > 0
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out = np.bincount((owner * k + best)[sure], chars[sure], len(sizes) * k).reshape(-1, k)
    open_ = np.flatnonzero(~out.any(axis=1))
    out[open_, np.add.reduceat(held * chars[:, None], starts, axis=0)[open_].argmax(axis=1)] = 1
    return out / out.sum(axis=1, keepdims=True)


def _taught(rows: DataFrame, model: Model, clear: float, least: float) -> DataFrame:
    """The documents that the model is sure of, with its own label; a hand label must agree.

    Passages in other languages get the label of their document, so what is known in one language
    is carried to others.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, own = [], []
            for i, (ids, ends, chars, label) in enumerate(zip(batch.column(1), batch.column(2), batch.column(3), batch.column(4).to_pylist())):
                scores, size = shared.value.scores(ids.values.to_numpy(), ends.values.to_numpy().astype(np.int64)), chars.values.to_numpy()
                s = shares(scores, size)
                told = size[_smooth(np.clip(scores, -2, 4)).max(axis=1) > clear].sum() / max(1, size.sum())
                if s.max() >= SURE and told >= least and (label is None or int(s.argmax()) in label):
                    keep.append(i)
                    own.append([int(s.argmax())])
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(take), batch.column(2).take(take), pa.array(own, pa.list_(pa.int32())), batch.column(5).take(take)], names=["ids", "ends", "subject", "slice"])

    return rows.select("doc_id", "ids", "ends", "chars", "subject", "slice").mapInArrow(judged, "ids array<int>, ends array<int>, subject array<int>, slice int")


def fit(docs: DataFrame, labels: DataFrame, subjects: DataFrame) -> Model | None:
    """A model from hand labels, then from documents of a bounded sample that the first model is sure of.

    All different labels of a document count; labels outside ``subjects`` and null ones are left out.
    None without labels.
    """
    names = sorted(r.subject for r in subjects.select("subject").distinct().collect() if r.subject is not None)
    if not names:
        return None
    number = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("subject")).cast("int") - 1
    known = labels.where(F.col("subject").isin(names)).groupBy("doc_id").agg(F.sort_array(F.collect_set(number)).alias("subject"))  # a set of subjects, few by definition
    n = known.count()
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n // LABELLED)))) == 0) if n > LABELLED else known
    step = max(1, docs.count() // UNLABELLED)
    picked = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id", "left").where(F.col("subject").isNotNull() | (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(step)) == 0))  # at most LABELLED rows are broadcast
    both = encoded_with(picked.select("doc_id", "text", "subject")).withColumn("slice", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(SLICES)).cast("int"))
    both = materialise(both.repartition(PARTITIONS, "doc_id"))
    first = both.where("subject is not null").select("ids", "ends", "subject", "slice").cache()
    if not first.limit(1).count():
        return None
    model, params = train(first, names)
    first.unpersist()
    for rounds, clear, least in TEACHING:
        own = materialise(_taught(both, model, clear, least)).coalesce(PARTITIONS).cache()
        if own.limit(1).count():
            model, params = train(own, names, rounds, params)
        own.unpersist()
    return model


def encoded_with(docs: DataFrame) -> DataFrame:
    own = encoded(docs.select("doc_id", "text"))
    return own.join(docs.select("doc_id", "subject"), "doc_id")


SHARES = "doc_id bigint, subject string, share double"


def subject_shares(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, subject, share of every subject that has a share of a document's text.

    Null and blank texts and null ids give no rows; without a model nothing does. Repeated doc_ids
    give repeated rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        reader = model.reader() if model else None
        for batch in batches:
            keys, which, found = [], [], []
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 200):
                own = [sentences(t) for t in texts[at : at + 200]]
                some = [i for i, x in enumerate(own) if any(map(_TOKEN.search, x))]
                if not some or reader is None:
                    continue
                flat = [s for i in some for s in own[i]]
                out = shares_of(reader.scores(flat), np.array([len(s) for s in flat]), np.array([len(own[i]) for i in some]))
                i, j = np.nonzero(out)
                keys.append(batch.column(0).take(pa.array(np.array(some)[i] + at)))
                which.append(j)
                found.append(out[i, j])
            if keys:
                names = pa.array(model.subjects, pa.string()).take(pa.array(np.concatenate(which)))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(keys), names, pa.array(np.concatenate(found))], names=["doc_id", "subject", "share"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return rows.mapInArrow(run, SHARES)
