"""Problem 4: pages that are template residue, filler, error pages or notices."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.urls import host
from tessera.llm import lexicon
from tessera.llm.pages import CONTENT, roles, squeezed

#: Most pages in the training sample (a documented bound; every page is scored).
SAMPLE = 3000
BUCKETS = 1 << 14
DENSE = 10
ROUNDS = 120
PENALTIES = (1e-4, 1e-3, 1e-2)
DOUBT = 1.0  # log odds
_PLACE = re.compile(lexicon.PLACEHOLDER)
_WORD = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+")
_SPLIT = re.compile(r"(?<=[.!?…。！？])\s*|\n")
_EMPTY_WORDS = frozenset(("undefined", "null", "nan", "none", "object", "ref", "lorem", "ipsum", "tbd", "todo", "text", "bla", "test", "value", "error", "n/a"))


@lru_cache(1)
def _known() -> tuple[re.Pattern, frozenset]:
    phrases = sorted((p for words in lexicon.SHELL_PHRASES.values() for p in words), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, phrases))), frozenset(w for words in lexicon.FUNCTION_WORDS.values() for w in words)


def body(text: str, by_words: list[int] | None = None) -> str:
    """The lines of a page that aren't furniture by their words (``by_words``, where known)."""
    lines = text.split("\n")
    kept = [squeezed(x) for x, r in zip(lines, by_words or roles(lines)) if r == CONTENT]
    return "\n".join(x for x in kept if x)


class _Words(dict):
    """A row number for each word; the rows hold its bucket, whether it is a function word or an empty word, its length."""

    def __init__(self) -> None:
        self.rows = np.zeros((1024, 4), np.int64)

    def __missing__(self, word: str) -> int:
        import xxhash

        n = len(self)
        if n == len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        key = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)
        self.rows[n] = (key, word in _known()[1], word in _EMPTY_WORDS, len(word))
        self[word] = n
        return n

    def read(self, words: list[str]) -> np.ndarray:
        if len(self) > 50_000:
            self.clear()
        numbers = [self[w] for w in words]
        return self.rows[numbers] if numbers else self.rows[:0]


@lru_cache(1)
def _words() -> _Words:
    return _Words()


def features(main: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and weights of the hashed word n-grams of a page's body, and the dense features.

    Dense: log length, words per line, share of words known as function words, share of different
    words, placeholders per word, share of digits and signs, longest line, share of empty words,
    and of the title (the first line): log length and whether it has words at all.
    """
    low = main.lower()
    plain, holes = _PLACE.subn(" ▯ ", low)
    w = _WORD.findall(plain)
    rows = _words().read(w)
    n = max(1, len(w))
    lines = low.split("\n")
    title = _WORD.findall(lines[0])
    different = len(np.unique(rows[:, 0]))
    dense = np.array(
        [
            math.log1p(len(low)) / 5,
            min(1.0, n / max(1, len(lines)) / 30),
            rows[:, 1].sum() / n * 2,
            different / n,
            min(1.0, 6 * holes / (n + holes)),
            1 - rows[:, 3].sum() / max(1, len(low.replace(" ", ""))),
            min(1.0, max(map(len, lines)) / 300),
            rows[:, 2].sum() / n,
            math.log1p(len(lines[0])) / 5,
            float(bool(title)),
        ]
    )
    own = rows[:, 0]
    starts = (own[: len(title)] * 31 + 17) & (BUCKETS - 1)
    pairs = (own[:-1] * 7919 + own[1:] * 104_729 + 5) & (BUCKETS - 1)
    keys = np.unique(np.concatenate([own, pairs, starts, [3] * bool(holes)])).astype(np.int64)
    return keys, np.full(len(keys), 2 / math.sqrt(max(1, len(keys)))), dense


def weak_label(main: str, status: int | None) -> int | None:
    """1 for a shell, 0 for an article, None where the phrases and the response status don't tell.

    Filler has no phrase of its own. It is known by what all of it has in common: a sentence that says
    the same few words again and again, or a text without the function words of any language.
    """
    low = main.lower()
    phrase, function = _known()
    parts = [p for p in _SPLIT.split(low) if p and p.strip()]
    total = sum(map(len, parts))
    if not total:
        return None
    hit = prose = 0
    for p in parts:
        w = _WORD.findall(p)
        holes = len(_PLACE.findall(p))
        if phrase.search(p) or holes and holes * 6 >= len(w) or len(w) >= 6 and len(set(w)) * 3 <= len(w):
            hit += len(p)
        elif len(w) >= 6 and sum(x in function for x in w) >= 0.15 * len(w):
            prose += len(p)
    failed = status is not None and status >= 400
    if hit >= 0.5 * total and prose < 0.35 * total or failed and hit and prose < 200:
        return 1
    words = _WORD.findall(low)
    if len(words) >= 25 and not prose and sum(x in function for x in words) < 0.06 * len(words):
        return 1
    if not failed and not hit and prose >= 80 and prose >= 0.5 * total:
        return 0
    return None


@dataclass
class Model:
    weights: np.ndarray
    dense: np.ndarray
    bias: float
    accuracy: float  # against the weak labels of hosts not seen in training
    penalty: float

    def score(self, main: str) -> float:
        keys, values, dense = features(main)
        z = float(self.weights[keys] @ values) + float(self.dense @ dense) + self.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _fit(rows: list[tuple], y: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, float]:
    keys = np.concatenate([r[0] for r in rows])
    values = np.concatenate([r[1] for r in rows])
    sizes = np.array([len(r[0]) for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    dense = np.array([r[2] for r in rows])
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))  # both classes weigh the same
    theta = np.zeros(BUCKETS + DENSE + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, ROUNDS + 1):
        z = np.bincount(owner, theta[keys] * values, len(rows)) + dense @ theta[BUCKETS:-1] + theta[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        grad = np.concatenate([np.bincount(keys, g[owner] * values, BUCKETS), dense.T @ g, [g.sum()]])
        grad[:-1] += penalty * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:BUCKETS], theta[BUCKETS:-1], float(theta[-1])


def train(sample: list[tuple[str, int | None, str | None]]) -> Model | None:
    """A model from (text, status, host) rows with weak labels; None without both labels.

    The penalty is the one with the best log-loss on held-out hosts (a fifth, by a hash of the host);
    the model is then fitted on all rows.
    """
    import xxhash

    rows, labels, held = [], [], []
    for text, status, site in sample:
        if text and (main := body(text)) and (label := weak_label(main, status)) is not None:
            rows.append(features(main))
            labels.append(label)
            held.append(xxhash.xxh32_intdigest((site or "").encode()) % 5 == 0)
    y, held = np.array(labels, float), np.array(held, bool)
    if not len(y) or y.min() == y.max():
        return None
    best = (math.inf, PENALTIES[0], 0.0)
    seen = [r for r, h in zip(rows, held) if not h]
    if held.any() and len(seen) and 0 < y[~held].sum() < (~held).sum():
        for penalty in PENALTIES:
            w, d, b = _fit(seen, y[~held], penalty)
            z = np.array([w[r[0]] @ r[1] + d @ r[2] + b for r, h in zip(rows, held) if h])
            p = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-6, 1 - 1e-6)
            loss = -np.mean(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p))
            if loss < best[0]:
                best = (loss, penalty, float(np.mean((p > 0.5) == (y[held] == 1))))
    w, d, b = _fit(rows, y, best[1])
    return Model(w, d, b, best[2], best[1])


def fit_pages(pages: DataFrame, most: int = SAMPLE) -> Model | None:
    """Train on a bounded sample of ``pages`` (artifact_id, url, status_code, text_content), chosen by a hash of the id."""
    total = pages.count()
    step = max(1, total // most)
    rows = pages.where((F.pmod(F.xxhash64("artifact_id"), F.lit(step)) == 0) & F.col("text_content").isNotNull())
    return train([tuple(r) for r in rows.select("text_content", "status_code", host(F.col("url"))).limit(most).collect()])


def is_shell(main: str, model: Model | None) -> bool:
    """Whether the body of a page is no article. An empty body is none; without a model the weak label decides.

    Where the model is in doubt (log odds within DOUBT of even) the weak label counts as one more
    piece of evidence of that size.
    """
    if not main.strip():
        return False
    if model is None:
        return weak_label(main, None) == 1
    p = model.score(main)
    odds = math.log(p / (1 - p))
    if abs(odds) < DOUBT:
        odds += {0: -DOUBT, 1: DOUBT, None: 0.0}[weak_label(main, None)]
    return odds > 0


def shell_pages(pages: DataFrame, model: Model | None) -> DataFrame:
    """artifact_id of each page whose main part is residue, filler, an error message or a notice.

    Null ids and null or blank texts give no rows; repeated rows count once.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = pa.array([is_shell(body(t), shared.value) for t in batch.column(1).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(flags)], names=["artifact_id"])

    rows = pages.where("artifact_id is not null and text_content is not null").select(F.col("artifact_id").cast("long").alias("artifact_id"), "text_content")
    return rows.mapInArrow(run, "artifact_id bigint").distinct()
