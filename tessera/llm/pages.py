"""Problem 7: the main body of a page, by tag-path ratios.

Text length and punctuation are aggregated per tag path (down to the element that holds a group of
blocks, and per path inside it), smoothed, and fused with two more views: a model of words that learns
from the lines whose tag paths are clear, and what the whole host says (repeated lines, and the share
of article under each of its tag paths), by grouped aggregation. A threshold on the fused log odds
decides. No word list takes part; those below serve problems 2 and 4, which look past furniture.
"""

from __future__ import annotations

import html
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
from tessera.operators.markup import decoded
from tessera.session import materialise

CONTENT, FURNITURE = 0, 1
#: Most pages from which words are learnt (a documented bound; every line is scored).
SAMPLE = 2000
BUCKETS, ROUNDS, PENALTY = 1 << 16, 60, 1e-6
CLEAR = 1.5  # tag-path score of a line from which words are learnt
WORDS = 0.6  # weight of the words beside tag paths
SURE = -1 - 4 * WORDS  # a tag-path score below this can't be turned by the words' 4 and the host's 1
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>|<!--.*?-->|([^<]+)", re.S)
_SKIPPED = re.compile(r"<(script|style|template)\b.*?</\1\s*>", re.I | re.S)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset("p li h1 h2 h3 h4 h5 h6 div td th tr table ul ol section article aside nav footer header main blockquote pre dd dt figcaption body title noscript option button form".split())
_CLOSED_BY = {"p": frozenset("p li h1 h2 h3 h4 h5 h6 table ul ol div".split()), "li": frozenset(("li",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "tr": frozenset(("tr",))}
_ZONES = frozenset(("nav", "aside", "footer", "noscript"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CELLS, _ITEMS = frozenset(("td", "th")), frozenset(("li", "dd", "dt"))
_BOXES = frozenset("body div td section article aside nav footer header main blockquote form".split())
_INLINE = frozenset("a b i em strong span small u font sup sub code abbr mark".split())
_WORDS = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+|[^\w\s]")
_IDEOGRAPH = re.compile("[㐀-鿿]")
_DIGITS = re.compile(r"\d+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
_SENTENCE = re.compile(r"[.!?…。！？][\"'»”)]*\s*$")
_ENTRY = re.compile(r"\| \d|: \d+$")  # rows of figures are no teasers
_SEPARATORS = re.compile(r"\s*[|/·•»›>]\s*|\s{2,}|\s[-–]\s")


@lru_cache(1)
def _cues() -> tuple[re.Pattern, re.Pattern, re.Pattern, frozenset]:
    starts = "|".join(f"(?:{p})" for words in lexicon.FURNITURE_STARTS.values() for p in words)
    anywhere = "|".join(f"(?:{p})" for p in lexicon.FURNITURE_ANYWHERE)  # looked for in lines of ordinary length
    heads = "|".join(f"(?:{p})" for p in lexicon.TEASER_HEADS)
    menu = frozenset(w for words in lexicon.MENU_WORDS.values() for w in words)
    return re.compile(starts), re.compile(anywhere), re.compile(heads), menu


def squeezed(line: str) -> str:
    return " ".join(line.split())


def cue(line: str) -> int:
    """2 for the head of a list of teasers, 1 for other furniture by its words, 0 for neither."""
    return _short_cue(line) if len(line) <= 80 else _cue(line)


def _cue(line: str) -> int:
    furniture, anywhere, heads, menu = _cues()
    low = _DIGITS.sub("0", line.lower())
    if len(low) <= 120 and heads.match(low):
        return 2
    if furniture.match(low) or len(low) <= 300 and anywhere.search(low):
        return 1
    if len(low) <= 400:
        if low.strip(" .:") in menu:
            return 1
        parts = [p for p in _SEPARATORS.split(low) if p]
        if len(parts) > 1 and sum(p in menu for p in parts) >= 0.6 * len(parts):
            return 1
    return 0


_short_cue = lru_cache(20_000)(_cue)  # menus and the like come again and again


def roles(lines: list[str]) -> list[int]:
    """Role of each line by its words alone: furniture, or a teaser in a list under a head of such."""
    out, teasers = [], False
    for raw in lines:
        line = squeezed(raw)
        if not line:
            out.append(CONTENT)
            continue
        kind = cue(line)
        if kind:
            teasers = kind == 2
            out.append(FURNITURE)
        elif teasers and line.count(" ") >= 2 and not _ENTRY.search(line) and (len(line) < 110 or line.endswith("…") or not _SENTENCE.search(line)):
            out.append(FURNITURE)
        else:
            teasers = False
            out.append(CONTENT)
    return out


class Block:
    """A text block: its root-to-leaf tag path, the element that contains it, and what the tags say."""

    __slots__ = ("box", "heading", "leaf", "link", "path", "plain", "text", "zone")

    def __init__(self, text: str, path: tuple, box: int, link: bool, plain: int) -> None:
        self.text, self.path, self.box, self.link, self.plain = text, path, box, link, plain
        self.leaf = next((t for t in reversed(path) if t in _BLOCKS), "")
        self.zone = any(t in _ZONES for t in path)
        self.heading = self.leaf in _HEADINGS or self.leaf == "title"


def blocks(markup: str) -> list[Block]:
    """Text blocks of a page in order, each with its root-to-leaf tag path; cells of a row are joined.

    The box of a block is the innermost element that holds groups of blocks; a cell of figures belongs
    to the box around its table.
    """
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    words: list[str] = []
    linked = total = elements = row = 0
    place: tuple = ()
    last_row = -1

    def flush() -> None:
        nonlocal linked, total, words, last_row
        if words:
            text = squeezed(html.unescape(" ".join(words)))
            if text:
                path = tuple(t for t, _ in place)
                cell = path and path[-1] in _CELLS
                if cell and out and out[-1].path == path and row == last_row:
                    out[-1].text += " | " + text
                    out[-1].plain += total - linked
                else:
                    above = place
                    if cell:
                        tables = [k for k, (t, _) in enumerate(place) if t == "table"]
                        above = place[: tables[-1]] if tables else place[:-1]
                    box = next((n for t, n in reversed(above) if t in _BOXES), -1)
                    out.append(Block(text, path, box, linked * 2 > total, total - linked))
                    last_row = row
        words, linked, total = [], 0, 0

    for m in _TAG.finditer(_SKIPPED.sub(" ", markup)):
        text = m[3]
        if text is not None:
            if text.isspace():
                continue
            if not words:
                place = tuple(x for x in stack if x[0] not in _INLINE)
            words.append(text)
            n = len(text.strip())
            total += n
            if any(t == "a" for t, _ in stack):
                linked += n
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "br" or tag in _BLOCKS:
            flush()
        if tag == "tr":
            row += 1
        if tag in _VOID:
            continue
        if m[1]:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
        else:
            while stack and (stack[-1][0] == "a" and tag in _BLOCKS or tag in _CLOSED_BY.get(stack[-1][0], ())):
                stack.pop()
            elements += 1
            stack.append((tag, elements))
    flush()
    return out


def width(text: str) -> int:
    """Characters, where an ideograph counts as three."""
    return len(text) if text.isascii() else len(text) + 2 * len(_IDEOGRAPH.findall(text))


def path_scores(found: list[Block]) -> list[float]:
    """Fused tag-path score of each block as log odds: above 0 for the article.

    Per box (the path down to one element) the plain text, weighed by its punctuation, against the
    page's best box: the box of the article holds most. Per tag path inside the box the mean length
    and punctuation of its blocks; a block's own density is smoothed towards that of its path. Links
    and zones of navigation speak against a block, headings, cells and unlinked list items of the best
    box for it.
    """
    headed = {b.box for b in found if b.leaf == "h1" and not b.link and not b.zone}  # the title of the article stands there
    boxes: dict[int, list[float]] = {}
    paths: dict[tuple, list[float]] = {}
    sizes, marks = [width(b.text) for b in found], [len(_PUNCTUATION.findall(b.text)) for b in found]
    for b, size, n in zip(found, sizes, marks):
        plain = 0.0 if b.link or b.leaf == "title" else size * (1 + min(n, 5))
        boxes.setdefault(b.box, [0.0])[0] += plain * (3 if b.box in headed else 1)
        if not b.link:
            sums = paths.setdefault((b.box, b.path), [0.0, 0.0])
            sums[0] += 1
            sums[1] += min(1.0, size / 80) * (1.0 if n else 0.3)
    best = max((x[0] for x in boxes.values()), default=0.0)
    out = []
    for b, size, n in zip(found, sizes, marks):
        share = boxes[b.box][0] / best if best else 0.0
        inside = 4 * min(share, 0.5) - 1  # -1 for a box without plain text, 1 for one with half as much as the best
        if b.leaf == "title":
            out.append(4.0)
        elif b.link or b.zone:
            out.append(-4.0)
        elif b.heading:
            out.append(2 * inside + 2)
        elif b.leaf in _CELLS or b.leaf in _ITEMS:
            out.append(1.5 * inside + 1)
        else:
            n_blocks, dense = paths[b.box, b.path]
            own = min(1.0, size / 80) * (1.0 if _SENTENCE.search(b.text) else 0.3)
            smooth = 0.8 * own + 0.2 * dense / n_blocks
            log_odds = 7 * (smooth - 0.5)
            out.append(min(2.5 * inside, log_odds) if inside < 0.8 else log_odds)
    return out


class _Words(dict):
    """The bucket of each word, kept while it is in use."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def line_features(lines: list[str], known: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all lines in a row, and where each line's end.

    Words and pairs of words, the first word and pair and the last word as such, the form of the line
    (length, words, separators, how it ends). Digit runs count as one digit.
    """
    found = [["^", *_WORDS.findall(_DIGITS.sub("0", x.lower())), "$"] for x in lines]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    h = np.fromiter((known[w] for x in found for w in x), np.int64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    after = np.ones(len(h), bool)
    after[ends - 1] = False
    pair = np.zeros(len(h), np.int64)
    pair[:-1] = h[:-1] * 7919 + h[1:] * 104_729 + 5
    forms = np.array([(min(width(x), 400) // 25, 20 + min(n, 30) // 3, 40 + min(len(_SEPARATORS.findall(x)), 4), 50 + (2 if _SENTENCE.search(x) else 1 if x[-1:].isalnum() else 0)) for x, n in zip(lines, sizes.tolist())], np.int64).reshape(-1, 4)
    owner = np.repeat(np.arange(len(lines)), sizes)
    keys = np.concatenate([h, pair[after], (forms * 2_654_435_761 + 99).ravel()]) & (BUCKETS - 1)
    owners = np.concatenate([owner, owner[after], np.repeat(np.arange(len(lines)), 4)])
    order = np.argsort(owners, kind="stable")
    return keys[order], np.cumsum(np.bincount(owners, minlength=len(lines)))


@dataclass
class LineModel:
    """Log odds that a line is of the article by its words alone, learnt from tag paths."""

    weights: np.ndarray
    bias: float
    agreement: float  # with the tag paths of hosts not seen in training

    def scores(self, lines: list[str], known: _Words) -> np.ndarray:
        if not lines:
            return np.zeros(0)
        keys, ends = line_features(lines, known)
        sizes = np.diff(ends, prepend=0)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[keys], dtype=np.float64)])
        return (sums[ends] - sums[ends - sizes]) / np.sqrt(np.maximum(sizes, 1)) + self.bias


def _fit(keys: np.ndarray, ends: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    sizes = np.diff(ends, prepend=0)
    owner = np.repeat(np.arange(len(ends)), sizes)
    scale = 1 / np.sqrt(np.maximum(sizes, 1))
    weigh = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    theta = np.zeros(BUCKETS + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, ROUNDS + 1):
        z = np.bincount(owner, theta[keys], len(ends)) * scale + theta[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weigh
        grad = np.append(np.bincount(keys, (g * scale)[owner], BUCKETS) + PENALTY * theta[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def train(sample: list[tuple[str, bytes | None, str | None]]) -> LineModel | None:
    """A model from (text, raw, host) rows: lines whose tag-path score is clear are its examples.

    None where no page has both kinds. A fifth of the hosts is held out first, to say how often the
    words agree with the tag paths.
    """
    import xxhash

    lines, y, held = [], [], []
    for text, raw, site in sample:
        if not text or not raw:
            continue
        out = xxhash.xxh32_intdigest((site or "").encode()) % 5 == 0
        for line, found in zip(*_structure(text, raw)):
            if found is not None and abs(found[0]) >= CLEAR:
                lines.append(line)
                y.append(found[0] > 0)
                held.append(out)
    y, held = np.array(y, float), np.array(held, bool)
    if not len(y) or y.min() == y.max():
        return None
    known = _Words()
    agreement = 0.0
    if held.any() and 0 < y[~held].sum() < (~held).sum():
        keys, ends = line_features([x for x, h in zip(lines, held) if not h], known)
        part = LineModel(*_fit(keys, ends, y[~held]), 0.0)
        agreement = float(np.mean((part.scores([x for x, h in zip(lines, held) if h], known) > 0) == (y[held] == 1)))
    keys, ends = line_features(lines, known)
    return LineModel(*_fit(keys, ends, y), agreement)


def structure(text: str, raw: bytes | None) -> list[float | None]:
    """Tag-path score of each line of ``text``; None for blank lines and those not found in the markup."""
    return [x and x[0] for x in _structure(text, raw)[1]]


def _structure(text: str, raw: bytes | None) -> tuple[list[str], list[tuple[float, tuple] | None]]:
    """The lines, squeezed, and the score and tag path of each."""
    lines = [squeezed(x) for x in text.split("\n")]
    if not raw:
        return lines, [None] * len(lines)
    found = blocks(decoded(raw))
    scores = path_scores(found)
    at: dict[str, list[int]] = {}
    for k, b in enumerate(found):
        at.setdefault(b.text, []).append(k)
    out: list[tuple[float, tuple] | None] = []
    for line in lines:
        places = at.get(line)
        if not line or not places:
            out.append(None)
            continue
        if found[places[0]].leaf == "title" and len(places) > 1:
            places.pop(0)  # the title stands in the head and again in the body
        k = places.pop(0) if len(places) > 1 else places[0]
        out.append((scores[k], found[k].path))
    return lines, out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


LINES = "artifact_id bigint, page bigint, line_no int, line bigint, path bigint, score double"


def scored_lines(pages: DataFrame, model: LineModel | None, shells=None) -> DataFrame:
    """Every non-blank line of ``pages`` with its fused log odds of being article.

    The tag-path score is fused with the words' score (WORDS of it; alone where there is no markup).
    ``line`` and ``path`` are hashes of host and normalised line, and of host and tag path. Pages that
    ``shells`` calls shells are left out.
    """
    shared = pages.sparkSession.sparkContext.broadcast((model, shells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        from tessera.llm.shells import body, is_shell

        model, shells = shared.value
        known = _Words()
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for at in range(0, batch.num_rows, 200):
                ids, numbers, texts, tags, where, lines, places = [], [], [], [], [], [], []
                for key, text, raw, site, page in zip(*(c[at : at + 200] for c in columns)):
                    if shells is not None and is_shell(body(text), shells):
                        continue
                    for k, (line, found) in enumerate(zip(*_structure(text, raw))):
                        if line:
                            ids.append(key)
                            where.append(page)
                            numbers.append(k)
                            texts.append(line)
                            tags.append(found[0] if found else np.nan)
                            seed = site or str(page)  # a page without host stands alone
                            lines.append(xxhash.xxh64_intdigest(f"{seed}\t{_DIGITS.sub('0', line.lower())}".encode("utf-8", "surrogatepass")))
                            places.append(_signed(xxhash.xxh64_intdigest(f"{seed}\t{'/'.join(found[1])}".encode())) if found else None)
                if not ids:
                    continue
                tag, words = np.array(tags), np.zeros(len(texts))
                open_ = np.flatnonzero(~(tag < SURE))
                if model:
                    words[open_] = np.clip(model.scores([texts[k] for k in open_], known), -4, 4)
                score = np.where(np.isnan(tag), words, np.nan_to_num(tag) + WORDS * words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(where, pa.int64()), pa.array(numbers, pa.int32()), pa.array(np.array(lines, np.uint64).view(np.int64)), pa.array(places, pa.int64()), pa.array(score)],
                    names=["artifact_id", "page", "line_no", "line", "path", "score"],
                )

    page = F.xxhash64(F.coalesce("canonical_url", "url", F.col("artifact_id").cast("string")))
    rows = pages.where("artifact_id is not null and text_content is not null")
    rows = rows.select(F.col("artifact_id").cast("long").alias("artifact_id"), "text_content", F.col("raw_content").cast("binary").alias("raw_content"), host(F.col("url")).alias("site"), page.alias("page"))
    return rows.mapInArrow(run, LINES)


def fused(lines: DataFrame) -> DataFrame:
    """The lines with what a whole host says about them, by grouped aggregation over all of its pages.

    A line that a host repeats on several different pages is the less of an article the more pages
    have it. A tag path of the host, the more of an article the larger the share of its lines is whose
    own score is above 0. Only lines that this can still turn round take part in the joins.
    """
    pages = lines.where("score > -1").select("line", "page").distinct().groupBy("line").agg(F.count("*").alias("pages")).where("pages > 1")
    ratio = lines.where("path is not null").groupBy("path").agg(F.sum((F.col("score") > 0).cast("double")).alias("for"), F.count("*").alias("all"))
    ratio = ratio.select("path", F.log((F.col("for") + 2) / (F.col("all") - F.col("for") + 2)).alias("odds"))
    turn = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), 0.3 * F.coalesce("odds", F.lit(0.0)))) - F.least(F.lit(3.0), 0.75 * F.log2(F.coalesce("pages", F.lit(1)).cast("double")))
    open_ = lines.where("score > -1 and score <= 4").join(pages.hint("merge"), "line", "left").join(ratio.hint("merge"), "path", "left")
    sure = lines.where("score <= -1 or score > 4")
    names = ["artifact_id", "line_no", "score"]
    return sure.select(*names).unionByName(open_.withColumn("score", F.col("score") + turn).select(*names))


def fit_lines(pages: DataFrame, most: int = SAMPLE) -> LineModel | None:
    """Learn words from a bounded sample of ``pages`` (artifact_id, url, text_content, raw_content), chosen by a hash of the id."""
    step = max(1, pages.count() // most)
    rows = pages.where((F.pmod(F.xxhash64("artifact_id"), F.lit(step)) == 0) & F.col("text_content").isNotNull() & F.col("raw_content").isNotNull())
    return train([(r[0], bytes(r[1]), r[2]) for r in rows.select("text_content", "raw_content", host(F.col("url"))).limit(most).collect()])


def furniture_lines(pages: DataFrame, model: LineModel | None = None, shells=None) -> DataFrame:
    """artifact_id and line_no of each non-blank line that is not article.

    ``pages`` has artifact_id, url, canonical_url, text_content, raw_content; ``model`` knows words,
    ``shells`` is the model of pages without content. Null texts and ids and such pages give no rows;
    repeated rows count once; lines without markup are judged by their words and by their host's
    other pages, without a model by these alone.
    """
    return fused(materialise(scored_lines(pages, model, shells))).where("score < 0").select("artifact_id", "line_no").distinct()


def main_body(pages: DataFrame, model: LineModel | None = None) -> DataFrame:
    """artifact_id, main_text (the article's lines) and main_text_ratio (its share of the non-blank characters).

    One row per artifact_id (of repeated rows with different texts the largest text counts); a null
    text gives null and null, a blank text an empty text and null.
    """
    drop = furniture_lines(pages, model).groupBy("artifact_id").agg(F.collect_set("line_no").alias("drop"))  # line numbers of one page
    one = pages.where("artifact_id is not null").groupBy(F.col("artifact_id").cast("long").alias("artifact_id")).agg(F.max("text_content").alias("text"))
    blank = r"^[\s\p{Z}]*$"
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: ~p["x"].rlike(blank))
    kept = F.filter("lines", lambda p: ~F.coalesce(F.array_contains("drop", p["i"]), F.lit(False)))
    chars = lambda c: F.aggregate(c, F.lit(0), lambda n, p: n + F.length(F.trim(p["x"])))
    rows = one.join(drop.hint("merge"), "artifact_id", "left").withColumn("lines", lines).withColumn("kept", kept)
    text = F.array_join(F.transform("kept", lambda p: p["x"]), "\n")
    ratio = F.when(chars("lines") > 0, chars("kept") / chars("lines"))
    return rows.select("artifact_id", F.when(F.col("text").isNotNull(), text).alias("main_text"), ratio.cast("double").alias("main_text_ratio"))
