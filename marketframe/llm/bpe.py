"""Byte-level BPE encoding and decoding.

Texts are cut into slices without a regular expression: code points become classes
(letter, number, white space, other), classes with the next two characters become
symbols, and a symbol is a function from the states of a small automaton to its
states.  Functions are composed by an associative scan: blocks of symbols first,
then the blocks' functions by doubling, so that every block knows its state at once.
A very long text goes through in windows that hand the state on.  A slice begins
where the automaton says so.  Distinct slices of a window are merged pair by pair
(least rank first, the leftmost of equal ones), with a cache of bounded size.

A text's tokens come as ids and as the bytes' places where they begin; decoding puts
each token's bytes at its place.

Defined cases: null texts are empty and have no tokens; texts of any length are read
whole; other columns aren't looked at.  Ids that the vocabulary lacks can't be decoded
and raise an error; null lists of ids decode to null.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from marketframe.llm.arrays import PIECE, pieces

OTHER, LETTER, NUMBER, SPACE = range(4)
#: White space of Unicode, and the letters and numbers that Unicode 16 has added to 15.1.
SPACE_RANGES = [(0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

#: Symbols: what a character is, and whether it is the last white space before something else; Q1 and Q2 are
#: apostrophes before a contraction's one or two letters.  A text's first character has its symbol plus FIRST.
L, N, O, W, BLANK, LAST, Q1, Q2, FIRST, NONE = 0, 1, 2, 3, 4, 5, 6, 7, 8, 16  # noqa: E741
#: States: inside a run of letters, numbers, others or white space; after a space that the next run takes along; in a
#: contraction with one or two letters to come; after one.
IN_L, IN_N, IN_O, IN_W, TAKEN, ONE, TWO, DONE = range(8)
#: Symbols of a block that are composed one after another.
BLOCK = 128
CACHE, CACHED_BYTES = 1 << 18, 64


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each symbol and state: the next state, and whether a slice begins."""
    step, begins = np.zeros((17, 8), np.uint8), np.ones((17, 8), bool)
    for symbol, inside in ((L, IN_L), (N, IN_N), (O, IN_O), (W, IN_W), (BLANK, TAKEN), (LAST, IN_W), (Q1, ONE), (Q2, TWO)):
        step[symbol] = step[symbol + FIRST] = inside
    for symbol, inside in ((L, IN_L), (N, IN_N), (O, IN_O)):
        begins[symbol, [inside, TAKEN]] = False
    begins[W, IN_W] = False
    for symbol in (Q1, Q2):  # no contraction inside a run of others
        step[symbol, [IN_O, TAKEN]], begins[symbol, [IN_O, TAKEN]] = IN_O, False
    step[L, [ONE, TWO]], begins[L, [ONE, TWO]] = [DONE, ONE], False
    step[NONE], begins[NONE] = np.arange(8), False
    return step.ravel(), begins.ravel()


STEP, BEGINS = _tables()


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = "".join(unicodedata.category(chr(c))[0] for c in range(0x110000))
    codes = np.frombuffer(kinds.encode(), np.uint8)
    table[codes == ord("L")], table[codes == ord("N")] = LETTER, NUMBER
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER), (SPACE_RANGES, SPACE)):
        for first, last in ranges:
            table[first : last + 1] = kind
    return table


def code_points(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The code points of the characters that begin at these bytes."""
    lead = data[starts].astype(np.int64)
    if len(starts) == len(data):
        return lead
    after = [data[np.minimum(starts + i, len(data) - 1)].astype(np.int64) & 0x3F for i in (1, 2, 3)]
    two = (lead & 0x1F) << 6 | after[0]
    three = (lead & 0x0F) << 12 | after[0] << 6 | after[1]
    four = (lead & 0x07) << 18 | after[0] << 12 | after[1] << 6 | after[2]
    return np.minimum(np.select([lead < 0x80, lead < 0xE0, lead < 0xF0], [lead, two, three], four), 0x10FFFF)


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbol of each character; first: those that begin a text."""
    kind = classes()[points]
    after = np.append(kind[1:], SPACE)
    after[np.flatnonzero(first[1:])] = SPACE  # a text's end
    out = np.array([O, L, N, W], np.uint8)[kind]
    space = (kind == SPACE) & (after != SPACE)
    out[space] = np.where(points[space] == 0x20, BLANK, LAST)
    at = np.flatnonzero((points == 0x27) & (after == LETTER))
    one, last = points[at + 1], np.minimum(at + 2, len(points) - 1)
    two = np.where((at + 2 < len(points)) & ~first[last], points[last], 0)
    out[at[np.isin(one, [*map(ord, "sdmt")])]] = Q1
    out[at[((one == ord("l")) & (two == ord("l"))) | (np.isin(one, [*map(ord, "vr")]) & (two == ord("e")))]] = Q2
    return out + FIRST * first.astype(np.uint8)


def scan(found: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """Where slices begin, and the state after the last symbol."""
    n = len(found)
    blocks = -(-n // BLOCK)
    table = np.full(blocks * BLOCK, NONE, np.int64)
    table[:n] = found
    table = np.ascontiguousarray(table.reshape(blocks, BLOCK).T) * 8
    whole = np.tile(np.arange(8), (blocks, 1))
    for column in table:  # each block's function
        whole = STEP[column[:, None] + whole]
    step = 1
    while step < blocks:  # and those of all blocks up to it
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step], 1)
        step *= 2
    now = np.append(state, whole[:-1, state]).astype(np.int64)
    begins = np.zeros((BLOCK, blocks), bool)
    for i, column in enumerate(table):
        at = column + now
        begins[i], now = BEGINS[at], STEP[at]
    return begins.T.ravel()[:n], int(whole[-1, state])


def _windows(data: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, seen) of windows that end between characters; up to seen for two more characters."""
    first = 0
    while first < len(data):
        last = min(first + size, len(data))
        while last < len(data) and data[last] & 0xC0 == 0x80:
            last += 1
        yield first, last, min(last + 8, len(data))
        first = last


def slices(data: np.ndarray, offsets: np.ndarray, size: int = 2 * PIECE) -> Iterator[np.ndarray]:
    """Bytes where slices begin, and where the last of them ends, window by window; a text begins at each offset but the last."""
    head = np.zeros(len(data) + 1, bool)
    head[offsets[:-1]] = True
    state, rest = DONE, None
    for first, last, seen in _windows(data, size):
        part = data[first:seen]
        starts = np.flatnonzero(((part & 0xC0) != 0x80) | head[first:seen])
        made = symbols(code_points(part, starts), head[first + starts])
        inside = np.searchsorted(starts, last - first)
        begins, state = scan(made[:inside], state)
        at = first + starts[:inside][begins]
        rest = at if rest is None else np.concatenate([rest, at])
        if last == len(data):
            yield np.append(rest, last)
        elif len(rest) > 1:
            yield rest
            rest = rest[-1:]


class Vocabulary:
    """Tokens by rank; what is made of them and the cache stay in the process."""

    def __init__(self, tokens: list[bytes | None]):
        self.tokens = tokens

    def __getstate__(self):
        return self.tokens

    def __setstate__(self, tokens):
        self.tokens = tokens

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.tokens) if t is not None}

    @cached_property
    def cache(self) -> dict[bytes, list[int]]:
        return {}

    @cached_property
    def places(self) -> np.ndarray:
        """Where each token's bytes begin in all of them."""
        return np.cumsum([0, *(len(t or b"") for t in self.tokens)])

    @cached_property
    def data(self) -> np.ndarray:
        return np.frombuffer(b"".join(t or b"" for t in self.tokens), np.uint8)

    @cached_property
    def known(self) -> np.ndarray:
        return np.array([t is not None for t in self.tokens])

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a slice."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        if (ids := self.cache.get(piece)) is not None:
            return ids
        n = len(piece)
        ends, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that begins at a byte; before it
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or ends[i] == n or ends[ends[i]] != end:
                continue  # one of the two parts is another one by now
            alive[ends[i]] = False
            ends[i] = end
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if i and (r := ranks.get(piece[(p := before[i]) : end])) is not None:
                heapq.heappush(heap, (r, p, end))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        if n <= CACHED_BYTES:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def ids(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slices between these bytes, and how many each slice has."""
        cut = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at[0] : at[-1]]))])
        coded = cut.dictionary_encode()
        lists = [self.merged(p) for p in coded.dictionary.to_pylist()]
        size = np.array([len(x) for x in lists])
        flat, first = np.array([i for x in lists for i in x], np.int32), np.cumsum(size) - size
        which = coded.indices.to_numpy()
        counts = size[which]
        return flat[np.repeat(first[which] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())], counts

    def encoded(self, column: pa.Array) -> pa.Array:
        """ids and starts of each text."""
        n, ids, sizes = 0, [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for _, data, offsets in pieces(column):
            size = np.zeros(len(offsets) - 1, np.int64)
            if len(data):
                texts = np.flatnonzero(np.diff(offsets))  # of some bytes
                begin = offsets[texts]
                for at in slices(data, np.append(begin, len(data))):
                    found, counts = self.ids(data, at)
                    ids.append(found)
                    size += np.bincount(texts[np.searchsorted(begin, at[:-1], "right") - 1], counts, len(size)).astype(np.int64)
            sizes.append(size)
            n += len(size)
        flat, size = np.concatenate(ids), np.concatenate(sizes)
        first = np.append(0, np.cumsum(size))
        ends = np.cumsum(np.diff(self.places)[flat])
        begins = np.append(0, ends)[: len(flat)]
        base = np.append(begins, 0)[np.minimum(first[:-1], len(flat))]
        starts = (begins - np.repeat(base, size)).astype(np.int32)
        offsets = pa.array(first, pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.ListArray.from_arrays(offsets, pa.array(starts))], ["ids", "starts"])

    def decoded(self, ids: pa.Array, starts: pa.Array) -> pa.Array:
        """The bytes of each list of ids."""
        flat, size = ids.flatten().to_numpy(zero_copy_only=False), ids.value_lengths().fill_null(0).to_numpy()
        if len(flat) and not ((flat >= 0) & (flat < len(self.tokens)) & self.known[np.clip(flat, 0, len(self.tokens) - 1)]).all():
            raise ValueError("an id that the vocabulary lacks")
        flat = flat.astype(np.int64)
        long = np.diff(self.places)[flat]
        rows = np.repeat(np.arange(len(size)), size)
        bytes_ = np.bincount(rows, long, len(size)).astype(np.int64)
        first = np.append(0, np.cumsum(bytes_))
        place = first[rows] + starts.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros(first[-1], np.uint8)
        if len(flat):
            step = np.arange(first[-1]) - np.repeat(np.cumsum(long) - long, long)
            out[np.repeat(place, long) + step] = self.data[np.repeat(self.places[flat], long) + step]
        made = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(out)])
        return pc.if_else(ids.is_valid(), made, pa.scalar(None, pa.binary()))


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file of ranks: lines of a token in base 64 and its rank."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return Vocabulary([ranks.get(i) for i in range(max(ranks) + 1)])


def encode(known: Vocabulary, text: Column) -> Column:
    """A struct of ids and of the bytes where the tokens begin."""
    shared = SparkSession.active().sparkContext.broadcast(known)
    return F.arrow_udf(lambda column: shared.value.encoded(column), "ids array<int>, starts array<int>")(text)


def decode(known: Vocabulary, ids: Column, starts: Column) -> Column:
    """The bytes of ids whose tokens begin at these places."""
    shared = SparkSession.active().sparkContext.broadcast(known)
    return F.arrow_udf(lambda a, b: shared.value.decoded(a, b), "binary")(ids, starts)
