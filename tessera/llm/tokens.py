"""Problem 8: encode a corpus with a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE = 400_000  # distinct slices kept by a worker
CHARACTERS = 1_000_000  # characters looked at together
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
TOKENS = "array<int>"


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in chain(range(0x3400), range(0x4DC0, 0x4E00), range(0x9FF0, 0xAC00), range(0xD7A0, 0x20000), range(0x2A6D0, 0x32400), range(0xE0000, 0xE0200)):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            kinds[c] = LETTER if kind == "L" else NUMBER
    for a, b in ((0x3400, 0x4DC0), (0x4E00, 0x9FF0), (0xAC00, 0xD7A0), (0x20000, 0x2A6D0)):
        kinds[a:b] = LETTER
    kinds[_WHITE] = SPACE
    return kinds


# States of the scanner after a character: what slice it is in.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, JOINING, ONE_LEFT, TWO_LEFT, ENDED = range(9)
STATES = 9
# Symbols: class of a character and what follows it. A tail is the last white space before something.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_BLANK_TAIL, S_WHITE_TAIL, S_WHITE = range(8)
SYMBOLS = 8  # the first character of a text has the same symbol raised by SYMBOLS
BLOCK = 64


@lru_cache(1)
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """For each symbol (the last does nothing) and state: the next state, and whether a slice starts.

    A slice is a contraction (an apostrophe that starts a slice, with one or two letters), or letters,
    numbers or other characters, each with one blank before them, or white space, whose last character
    is set apart when something follows.
    """
    after = np.zeros((2 * SYMBOLS + 1, STATES), np.uint8)
    starts = np.zeros((2 * SYMBOLS + 1, STATES), bool)
    run = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHER, S_SHORT: IN_OTHER, S_LONG: IN_OTHER}
    for symbol in range(SYMBOLS):
        for state in range(STATES):
            if state in (ONE_LEFT, TWO_LEFT):  # inside a contraction
                new, start = (ENDED if state == ONE_LEFT else ONE_LEFT), False
            elif symbol in run:
                start = state not in (JOINING, run[symbol])
                new = {S_SHORT: ONE_LEFT, S_LONG: TWO_LEFT}.get(symbol, run[symbol]) if start else run[symbol]
            else:
                new = JOINING if symbol == S_BLANK_TAIL else IN_WHITE
                start = symbol != S_WHITE or state != IN_WHITE
            after[symbol, state], starts[symbol, state] = new, start
        after[symbol + SYMBOLS], starts[symbol + SYMBOLS] = after[symbol, START], True
    after[2 * SYMBOLS] = np.arange(STATES)
    return after, starts


def symbols(c: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbol of each of the code points ``c``; ``first`` marks the starts of texts."""
    n = len(c)
    kind = classes()[c]
    out = np.array([S_LETTER, S_NUMBER, S_WHITE, S_OTHER], np.uint8)[kind]
    ended = np.ones(n, bool)  # the text ends after this character
    ended[:-1] = first[1:]
    space = kind == SPACE
    tail = space & ~ended
    tail[:-1] &= ~space[1:]
    out[tail] = S_WHITE_TAIL
    out[tail & (c == 32)] = S_BLANK_TAIL
    quote = np.flatnonzero((c == 39) & ~ended)
    if len(quote):
        one = c[quote + 1]
        at = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & ~ended[quote + 1], c[at], 0)
        out[quote[np.isin(one, [115, 116, 109, 100])]] = S_SHORT
        out[quote[((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)]] = S_LONG
    out[first] += SYMBOLS
    return out


def boundaries(c: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a slice starts in the code points ``c``; ``first`` marks the starts of texts.

    A scan over transition functions, which are associative: the functions of each block of BLOCK
    characters are composed for all blocks at once, then those of the blocks by doubling, and with
    each block's first state known all blocks are walked again at once.
    """
    after, starts = transitions()
    n = len(c)
    blocks = -(-n // BLOCK)
    s = np.full(blocks * BLOCK, 2 * SYMBOLS, np.intp)
    s[:n] = symbols(c, first)
    s = np.ascontiguousarray(s.reshape(blocks, BLOCK).T) * STATES
    flat = after.ravel().astype(np.intp)
    whole = np.repeat(np.arange(STATES, dtype=np.intp)[:, None], blocks, axis=1)
    for k in range(BLOCK):
        whole = flat[s[k] + whole]
    back = 1
    while back < blocks:  # whole[:, b] becomes the function of all blocks up to b
        whole[:, back:] = np.take_along_axis(whole[:, back:], whole[:, :-back], axis=0)
        back *= 2
    state = np.concatenate([[START], whole[START, :-1]])
    told = starts.ravel()
    out = np.empty((BLOCK, blocks), bool)
    for k in range(BLOCK):
        at = s[k] + state
        out[k] = told[at]
        state = flat[at]
    return out.T.reshape(-1)[:n]


class Encoder(dict):
    """Ids by slice; a slice that isn't known is merged pair by pair once."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.merge = tiktoken.Encoding("corpus", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.bytes[rank] = piece
        self.lengths = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > CACHE:
            self.clear()
        ids = tuple(self.merge(piece if piece.isascii() else piece.encode("utf-8", "replace").decode()))
        if len(piece) < 40:
            self[piece] = ids
        return ids

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the place where each text's ids end."""
        lengths = np.array([len(t) if t else 0 for t in texts], np.int64)
        joined = "".join(t for t in texts if t)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum(lengths)
        first = np.zeros(len(c) + 1, bool)
        first[ends - lengths] = True
        at = np.flatnonzero(boundaries(c, first[:-1]))
        places = at.tolist()
        found = [self[joined[a:b]] for a, b in zip(places, [*places[1:], len(joined)])]
        ids = np.fromiter(chain.from_iterable(found), np.int32)
        sizes = np.concatenate([[0], np.fromiter(accumulate(map(len, found)), np.int64)])
        return ids, sizes[np.searchsorted(at, ends)]

    def offsets(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where each id starts in the UTF-8 bytes of its text."""
        total = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        sizes = np.diff(ends, prepend=0)
        return total[:-1] - np.repeat(total[ends - sizes], sizes)

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes[k] for k in ids]).decode("utf-8", "replace")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for k, t in enumerate(texts):
        if k > at and size + len(t or "") > CHARACTERS:
            yield at, k
            at, size = k, 0
        size += len(t or "")
    if at < len(texts):
        yield at, len(texts)


def encode_texts(docs: DataFrame, path: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """doc_id and ids of each row; null and empty texts give an empty list, strings that look like
    special tokens are plain text. Extra columns are dropped; repeated rows give repeated results.
    With ``offsets`` also where each id starts in the text's UTF-8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _groups(texts):
                ids, ends = coder.encode(texts[a:b])
                places = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                columns = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(places, pa.array(ids))]
                if offsets:
                    columns.append(pa.ListArray.from_arrays(places, pa.array(coder.offsets(ids, ends).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "offsets"][: len(columns)])

    more = f", offsets {TOKENS}" if offsets else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids {TOKENS}{more}")


def decode_texts(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and text of each row of ids; an empty list gives an empty text, null gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = [None if ids is None else coder.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def count_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of each row; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _groups(texts):
                _, ends = coder.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(ends, prepend=0))], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint")
