"""Problem 2: the language of each record and of foreign passages, by Bayesian evidence fusion."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.urls import host
from tessera.llm import lexicon
from tessera.llm.pages import CONTENT, roles
from tessera.llm.shells import Model, body, is_shell
from tessera.session import materialise

LANGS = lexicon.LANGUAGES
BUCKETS = 1 << 18  # of hashed words, so that a model of any table has one size
PASSES = 2  # times the texts are labelled anew by their own model
LEAST_CHARACTERS = 40
LEAST_WORDS = 4  # known words that a line needs to count as prose
HOST_WEIGHT, SUFFIX_WEIGHT = 8.0, 20.0  # pseudo-counts that hold a host to its suffix, a suffix to the whole
LABEL_TRUST = 0.85
#: Nats that a word's worth of text (WORD characters) costs in a text of another main language: the
#: log of the share of foreign passages in a text. A line costs no more than its own likelihood ratio.
FOREIGN, WORD = 0.75, 6
_TOKEN = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+")
_SILENT = re.compile("[\u00ad\u200b\ufeff]")  # signs that folding leaves out
_LINK = re.compile(r"^\s*(https?://|www\.|doi:|\[\d+\])")
_MARGIN = 3.0  # nats by which a foreign line must beat the main language
RECORDS = "tbl string, rec_id bigint, host string, suffix string, label string, markup string, counts array<double>, likelihood array<double>, words double, lines array<struct<line_no:int,lang:int,margin:double>>, shell boolean"
OUT = "tbl string, rec_id bigint, line_no int, lang string, confidence double, label string"


@lru_cache(1)
def _folds() -> dict[int, str]:
    out = {}
    for c in range(0xC0, 0x250):
        plain = "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))
        if plain != chr(c):
            out[c] = plain
    return out | {0x451: "е", 0x439: "и", 0xDF: "ss"}


def tokens(text: str) -> list[str]:
    """The words of a text in lower case; ``_Buckets`` folds their letters, once for each different word."""
    low = text.lower()
    return _TOKEN.findall(low if low.isascii() else _SILENT.sub("", low))


class _Buckets(dict):
    """The bucket of each word seen, by its folded letters; forgets all when it grows too large."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        self[word] = b = xxhash.xxh32_intdigest(word.translate(_folds()).encode("utf-8", "surrogatepass")) & (BUCKETS - 1)
        return b


@lru_cache(1)
def _buckets() -> _Buckets:
    return _Buckets()


def encode(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of all lines in a row, and how many each line has."""
    found = [tokens(x) for x in lines]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(map(_buckets().__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum())), sizes


def _sums(table: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``table`` that each line's words have."""
    ends = np.cumsum(sizes)
    sums = np.vstack([np.zeros((1, table.shape[1])), np.cumsum(table[ids], axis=0, dtype=np.float64)])
    return sums[ends] - sums[ends - sizes]


class Likelihoods:
    """Log-likelihood of each known word under each language, by the bucket of the word."""

    def __init__(self, table: np.ndarray, known: np.ndarray) -> None:
        self.table, self.known = table, known

    def lines(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the log-likelihoods of each line (one row a line), and its known words."""
        ids, sizes = encode(lines)
        ends = np.cumsum(sizes)
        known = np.concatenate([[0], np.cumsum(self.known[ids])])
        return _sums(self.table, ids, sizes), known[ends] - known[ends - sizes]


@lru_cache(1)
def _seeds() -> np.ndarray:
    """Which buckets the function words of each language have."""
    out = np.zeros((BUCKETS, len(LANGS)))
    for k, lang in enumerate(LANGS):
        out[encode(lexicon.FUNCTION_WORDS[lang])[0], k] = 1
    return out


def paragraphs(text: str | None) -> list[str]:
    return [p for p in (text or "").split("\n") if len(p) >= LEAST_CHARACTERS]


def labelled(ids: np.ndarray, sizes: np.ndarray, declared: np.ndarray, model: Likelihoods | None) -> np.ndarray:
    """The language of each paragraph by the model so far (by the function words without one), -1 where it is open.

    ``declared`` is the language that the record's label names, else -1; it only breaks ties without a model.
    """
    if not len(sizes):
        return np.zeros(0, np.int64)
    if model is None:
        scores = _sums(_seeds(), ids, sizes) / (1 + 0.02 * _seeds().sum(axis=0)) + 0.5 * (declared[:, None] == np.arange(len(LANGS)))
        second, best = np.partition(scores, -2, axis=1)[:, -2:].T
        clear = (best >= 1) & (second <= 0.7 * best)
    else:
        scores = _sums(model.table, ids, sizes)
        second, best = np.partition(scores, -2, axis=1)[:, -2:].T
        clear = second <= best - _MARGIN
    return np.where(clear, scores.argmax(axis=1), -1)


def cells(ids: np.ndarray, sizes: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """Number of each word's cell (language, bucket), for the paragraphs whose language is known."""
    each = np.repeat(langs, sizes)
    return (each * BUCKETS + ids)[each >= 0]


def _passes(count: Callable[[Likelihoods | None], np.ndarray]) -> Likelihoods:
    """A model from ``count``: words by language and bucket, of paragraphs labelled by the model so far.

    Fixed function words seed the counts; then the paragraphs are labelled by the model so far and
    counted, PASSES times.
    """
    model = None
    for _ in range(PASSES + 1):
        counts = count(model).reshape(len(LANGS), BUCKETS).T + 5 * _seeds()
        known = counts.sum(axis=1) >= 3
        own = counts[known]
        table = np.zeros((BUCKETS, len(LANGS)), np.float32)
        own = np.log((own + 0.3) / (counts.sum(axis=0) + 0.3 * len(own)))
        table[known] = np.clip(own - own.mean(axis=1, keepdims=True), -6, 6)
        model = Likelihoods(table, known)
    return model


def learn(rows: list[tuple[str, str | None]]) -> Likelihoods:
    """Word likelihoods from a list of texts with labels that may be wrong or missing; ``fit`` does the same for tables."""
    split = [(paragraphs(text), LANGS.index(label) if label in LANGS else -1) for text, label in rows]
    ids, sizes = encode([p for own, _ in split for p in own])
    declared = np.array([k for own, k in split for _ in own], np.int64)
    return _passes(lambda model: np.bincount(cells(ids, sizes, labelled(ids, sizes, declared, model)), minlength=len(LANGS) * BUCKETS))


def fit(texts: DataFrame) -> Likelihoods:
    """Word likelihoods from all rows of ``texts`` (text, label), whose labels may be wrong or missing.

    The paragraphs' words are hashed once; each pass adds its tasks' counts by grouped aggregation. The
    driver gets a count for each language and bucket, however many rows there are.
    """
    spark = texts.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                own = [paragraphs(t) for t in part.column(0).to_pylist()]
                ids, sizes = encode([p for x in own for p in x])
                rows = np.concatenate([[0], np.cumsum([len(x) for x in own])])  # first paragraph of each row
                words = np.concatenate([[0], np.cumsum(sizes)])[rows]
                lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v, pa.int32())) for o, v in ((words, ids), (rows, sizes))]
                yield pa.RecordBatch.from_arrays([*lists, part.column(1)], names=["ids", "sizes", "label"])

    label = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LANGS]), label_language(F.col("label"))).cast("int") - 1, F.lit(-1))
    words = materialise(texts.where("text is not null").select("text", label.alias("label")).mapInArrow(read, "ids array<int>, sizes array<int>, label int"))

    def count(model: Likelihoods | None) -> np.ndarray:
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(LANGS) * BUCKETS, np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    ids, sizes = (part.column(c).flatten().to_numpy().astype(np.int64) for c in (0, 1))
                    declared = np.repeat(part.column(2).to_numpy(), part.column(1).value_lengths().to_numpy())
                    found, n = np.unique(cells(ids, sizes, labelled(ids, sizes, declared, shared.value)), return_counts=True)
                    total[found] += n
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], names=["cell", "n"])

        counts = words.mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        shared.destroy()
        total = np.zeros(len(LANGS) * BUCKETS, np.int64)
        total[counts["cell"].to_numpy()] = counts["n"].to_numpy()
        return total

    return _passes(count)


@lru_cache(1)
def _names() -> dict[str, str]:
    return {name: lang for lang, names in lexicon.LABEL_NAMES.items() for name in names}


def label_language(label: Column) -> Column:
    """Language that a declared label names by code, three letters, name, region or letter case; else null."""
    plain = F.lower(F.trim(label))
    names = F.create_map(*[F.lit(x) for pair in _names().items() for x in pair])
    return F.coalesce(F.try_element_at(names, plain), F.try_element_at(names, F.regexp_extract(plain, r"^([a-z]{2,3})[-_]", 1)))


def read_records(texts: DataFrame, model: Likelihoods, shells: Model | None) -> DataFrame:
    """Text evidence of each record: characters by language, log-likelihood of the text under each main
    language, known words, and lines that may be foreign.

    Under a main language a line has that language's likelihood or, as a foreign passage, that of its
    best language times the chance of foreign text, whichever is larger; the lines of a text add up.

    ``texts`` has tbl, rec_id, text, url, label, markup, page; ``page`` says that furniture lines
    are to be left out of foreign passages and that shells count.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((model, shells))
    kind = pa.list_(pa.struct([("line_no", pa.int32()), ("lang", pa.int32()), ("margin", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, shells = shared.value
        for batch in batches:
            texts, pages = batch.column(2).to_pylist(), batch.column(6).to_pylist()
            counts, likely, known, foreign, shell = [], [], [], [], []
            for at in range(0, len(texts), 500):
                split = [t.split("\n") if t and t.strip() else [] for t in texts[at : at + 500]]
                flat = [x for lines in split for x in lines]
                scores, words = model.lines(flat)
                sizes = np.fromiter(map(len, flat), np.int64, len(flat))
                best = scores.argmax(axis=1) if len(flat) else np.zeros(0, np.int64)
                k = 0
                for lines, page, text in zip(split, pages[at : at + 500], texts[at : at + 500]):
                    own = slice(k, k + len(lines))
                    k += len(lines)
                    b, w, n, s = best[own], words[own], sizes[own], scores[own]
                    share = np.bincount(b[w > 0], n[w > 0], len(LANGS)) if len(lines) else np.zeros(len(LANGS))
                    counts.append(share.tolist())
                    behind = np.minimum(s.max(axis=1, keepdims=True) - s, FOREIGN * n[:, None] / WORD)[w > 0]
                    likely.append((-behind.sum(axis=0)).tolist() if len(behind) else [0.0] * len(LANGS))
                    known.append(float(w.sum()))
                    main = int(share.argmax())
                    close = np.partition(share, -2)[-2] >= 0.5 * share[main]  # label or host may turn it round
                    odd = np.flatnonzero(((b != main) | close) & (n >= LEAST_CHARACTERS) & (w >= LEAST_WORDS)) if len(lines) else ()
                    role = roles(lines) if page and lines else None
                    own_lines = []
                    for i in odd:
                        margin = float(s[i, b[i]] - (s[i, main] if b[i] != main else np.partition(s[i], -2)[-2]))
                        line = lines[i]
                        if margin >= _MARGIN and len(line.strip()) >= LEAST_CHARACTERS and not _LINK.match(line) and (role is None or role[i] == CONTENT):
                            own_lines.append({"line_no": int(i), "lang": int(b[i]), "margin": margin})
                    foreign.append(own_lines)
                    shell.append(bool(role and is_shell(body(text, role), shells)))
            columns = [batch.column(0), batch.column(1), *(batch.column(c) for c in (3, 4, 5, 7))]
            yield pa.RecordBatch.from_arrays(
                [columns[0], columns[1], columns[2], columns[5], columns[3], columns[4], pa.array(counts, pa.list_(pa.float64())), pa.array(likely, pa.list_(pa.float64())), pa.array(known, pa.float64()), pa.array(foreign, kind), pa.array(shell, pa.bool_())],
                names=["tbl", "rec_id", "host", "suffix", "label", "markup", "counts", "likelihood", "words", "lines", "shell"],
            )

    site = host(F.col("url"))
    ready = texts.where("rec_id is not null").select("tbl", F.col("rec_id").cast("long").alias("rec_id"), "text", site.alias("host"), "label", "markup", "page", F.regexp_extract(site, r"\.([a-z]+)$", 1).alias("suffix"))
    return ready.mapInArrow(run, RECORDS)


def fused(records: DataFrame) -> DataFrame:
    """Language and confidence of each record: text likelihoods times declared languages, address suffix and host prior.

    The host prior counts the records of a host by the language of their text, smoothed towards the
    counts of its suffix and these towards the whole, all by grouped aggregation. Records without any
    text are left out. Adds lang, confidence, named (the language of the label).
    """
    seen = records.where("words > 0").select("host", "suffix", F.expr("array_position(counts, array_max(counts)) - 1").cast("int").alias("k"))
    grid = [F.sum((F.col("k") == i).cast("double")).alias(f"n{i}") for i in range(len(LANGS))]
    by_host = seen.where("host is not null").groupBy("host", F.coalesce("suffix", F.lit("")).alias("suffix")).agg(F.array(*grid).alias("by_host"))
    by_suffix = by_host.groupBy("suffix").agg(F.array(*[F.sum(F.col("by_host")[i]) for i in range(len(LANGS))]).alias("by_suffix"))
    whole = by_suffix.agg(F.array(*[F.coalesce(F.sum(F.col("by_suffix")[i]), F.lit(0.0)) for i in range(len(LANGS))]).alias("whole"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    zero = F.array_repeat(F.lit(0.0), len(LANGS))
    smooth = by_host.join(by_suffix, "suffix").select("host", "by_host", "by_suffix").join(F.broadcast(whole))  # whole is one row
    level0 = F.transform("whole", lambda x: (x + 1) / (total(F.col("whole")) + len(LANGS)))
    smooth = smooth.withColumn("p0", level0)
    level1 = F.zip_with("by_suffix", "p0", lambda n, p: (n + SUFFIX_WEIGHT * p) / (total(F.col("by_suffix")) + SUFFIX_WEIGHT))
    smooth = smooth.withColumn("p1", level1)
    level2 = F.zip_with("by_host", "p1", lambda n, p: (n + HOST_WEIGHT * p) / (total(F.col("by_host")) + HOST_WEIGHT))
    smooth = smooth.select("host", level2.alias("prior"))
    rows = records.join(smooth, "host", "left").join(F.broadcast(whole.select(level0.alias("p0"))))
    langs = F.array(*[F.lit(x) for x in LANGS])
    suffixes = F.create_map(*[F.lit(x) for pair in lexicon.SUFFIX_LANGUAGES.items() for x in pair])
    rows = rows.withColumn("named", label_language(F.col("label"))).withColumn("marked", label_language(F.col("markup"))).withColumn("ended", F.try_element_at(suffixes, F.col("suffix")))
    wrong = (1 - LABEL_TRUST) / (len(LANGS) - 1)

    def says(column: str, lang: Column, trust: float) -> Column:
        return F.when(F.col(column).isNull(), 0.0).when(F.col(column) == lang, float(np.log(trust))).otherwise(float(np.log(trust * wrong / LABEL_TRUST)))

    text = F.coalesce("likelihood", zero)
    beside = F.transform(langs, lambda x: says("named", x, LABEL_TRUST) + says("marked", x, LABEL_TRUST) + says("ended", x, 0.6))
    prior = F.transform(F.coalesce("prior", "p0"), lambda p: F.log(p))
    score = F.zip_with(F.zip_with(text, beside, lambda a, b: a + b), prior, lambda a, b: a + b)
    rows = rows.withColumn("score", score).withColumn("top", F.array_max("score"))
    rows = rows.withColumn("lang", F.element_at(langs, F.array_position("score", F.col("top")).cast("int")))
    return rows.withColumn("confidence", 1 / total(F.transform("score", lambda x: F.exp(x - F.col("top")))))


def languages(texts: DataFrame, model: Likelihoods, shells: Model | None) -> DataFrame:
    """One row per record (line_no -1) and per foreign line: tbl, rec_id, line_no, lang, confidence, label.

    Null and blank texts and shells give no rows. Records without known words are judged by label,
    markup, suffix and host alone. Repeated rows of a record give one row; where their labels differ,
    the smallest counts. ``label`` is the declared label as given; a foreign line's label is null.
    """
    some = texts.where(F.col("text").isNotNull() & F.col("text").rlike(r"[^\s\p{Z}]"))
    rows = fused(materialise(read_records(some, model, shells))).where("not shell")
    whole = rows.select("tbl", "rec_id", F.lit(-1).alias("line_no"), "lang", "confidence", "label", "named")
    foreign = rows.select("tbl", "rec_id", "lang", F.explode("lines").alias("x"))
    foreign = foreign.select("tbl", "rec_id", F.col("x.line_no").alias("line_no"), F.element_at(F.array(*[F.lit(x) for x in LANGS]), F.col("x.lang") + 1).alias("l"), (1 / (1 + F.exp(-F.col("x.margin")))).alias("confidence"), "lang").where("l <> lang")
    foreign = foreign.select("tbl", "rec_id", "line_no", F.col("l").alias("lang"), "confidence", F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("named"))
    return whole.unionByName(foreign).groupBy("tbl", "rec_id", "line_no").agg(F.min(F.struct("label", "lang", "confidence", "named")).alias("r")).select("tbl", "rec_id", "line_no", "r.lang", "r.confidence", "r.label", "r.named")
