"""Token-ID output as Re-Pair grammars.

Documents are range-partitioned and sorted by id; each partition is one shard of the output. Its texts
are tokenised, an end id follows each document, and the ids are packed in blocks of about
``block_tokens`` (whole documents). In a block the frequent pairs of neighbouring ids are replaced by new
nonterminals, round after round, until no pair occurs ``LEAST_PAIRS`` times. A block stores its rules, the
expansion length of each, the replaced sequence, and the documents' ids and lengths, so any range of tokens
is decoded from the few symbols that cover it. Blocks are rows of a Parquet table, so Spark's commit protocol
covers them.

Tokenising: texts are cut before single spaces that stand between two other characters, between a letter and
a mark, and around a line break between a letter or mark and a letter; there a byte-level BPE with the usual
pattern of words, numbers and marks cuts anyway, so each distinct piece is tokenised once. Pieces are hashed (128 bits) and looked
up in a bounded table with numpy, so that no Python code runs for a piece that is known, nor for a new one
that is a plain word, number or run of marks. Texts with runs of white space at a space, or with special tokens, are tokenised whole.

Defined cases: a null text counts as empty and gives the end id alone; rows without an id come first;
rows with the same id are ordered by their text; an empty table gives an empty output. Columns besides
the id and the text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kernels, shared

END_ID = 0
BLOCK_TOKENS = 1 << 19
#: A round replaces all pairs that are at least a SHARE-th as frequent as the most frequent one.
SHARE = 32
LEAST_PAIRS = 8
#: Pieces that a worker's table may hold; beyond that, and between tasks, rare pieces are forgotten.
CACHE_PIECES = 700_000
#: Bytes of texts that are tokenised together, and new pieces that the library gets in one text.
PORTION_BYTES = kernels.BLOCK_BYTES
PIECES_A_CALL = 1024
_NEW = -1
_ODD = -1
_HEAD = struct.Struct("<4sIIII")
_encoders: dict[str, Encoder] = {}


_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
#: Marks that the tokenizer cuts off a word in one run: neither an apostrophe nor what opens a special token.
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BYTE_VALUES = np.random.default_rng(77).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Keeps so many of the first 16 bytes, in two numbers.
_FIRST_BYTES = (np.arange(16) < np.arange(17)[:, None]).astype(np.uint8).__mul__(255).view("<u8")
#: Odd on the diagonal, even above it, so that no two pairs of numbers give the same pair.
_FACTORS = _BYTE_VALUES[:, :2] - np.array([[0, 1], [0, 0]], np.uint64)


class _Table:
    """Numbers of 128-bit keys, in the order in which they came: open addressing over numpy arrays."""

    def __init__(self, slots: int = 1 << 16):
        self.mask = slots - 1
        self.keys = np.zeros((2, slots), np.uint64)
        self.number = np.full(slots, _NEW, np.int32)
        self.used = 0

    def in_order(self) -> np.ndarray:
        """All keys, as they are numbered."""
        slots = np.flatnonzero(self.number >= 0)
        return self.keys[:, slots[np.argsort(self.number[slots])]]

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        out = np.full(len(a), _NEW, np.int32)
        left, slot = np.arange(len(a)), (a & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            number = self.number[slot]
            same = (self.keys[0, slot] == a[left]) & (self.keys[1, slot] == b[left]) & (number >= 0)
            out[left[same]] = number[same]
            on = (number >= 0) & ~same
            left, slot = left[on], (slot[on] + 1) & self.mask
        return out

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Number distinct keys that are not in the table, which grows to twice as many slots as keys at least."""
        if 2 * (self.used + len(a)) > self.mask + 1:
            known = self.in_order()
            self.__init__(1 << int(2 * (self.used + len(a))).bit_length())
            self.add(*known)
        left, slot = np.arange(len(a)), (a & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.number[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[0, slot[won]], self.keys[1, slot[won]] = a[left[won]], b[left[won]]
            self.number[slot[won]] = self.used + left[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask
        self.used += len(a)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """Token ids of texts by a byte-level BPE of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.cut_words = Tokenizer(self.tokenizer.model)  # the same BPE for text that is cut at spaces already
        self.cut_words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # how a byte-level BPE writes bytes: printable Latin-1 characters as they are, others from U+0100 on
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.letters = {b: b if b in printable else next(rest) for b in range(256)}
        self.letters |= {32: " Ġ", 1: " Ġ "}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.space = vocabulary["Ġ"]
        self.opens = np.zeros(self.size, bool)  # tokens that begin with a space
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.forget()
        sample = ["Plain Words, (and) marks!! of it's 12th\nline.\nNext: été #1 x2", " led", "trails\n", "a  b"]
        self.cuts_hold = True
        ids, sizes = self.encode([t.encode() for t in sample], None)
        if [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] != self._whole(sample):
            self.cuts_hold = False  # another pattern: texts are tokenised whole

    def forget(self) -> None:
        self.table = _Table()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.length, self.uses = (np.zeros(1 << 15, np.int32) for _ in range(3))

    def _whole(self, texts: list[str]) -> list[list[int]]:
        out = []
        for k in range(0, len(texts), 256):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[k : k + 256], add_special_tokens=False)]
        return out

    def _joined(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, which: np.ndarray, after_space: bool) -> None:
        """Store the ids of plain pieces: a word, a number or a run of marks each."""
        for k in range(0, len(which), PIECES_A_CALL):
            lengths = end[k : k + PIECES_A_CALL] - start[k : k + PIECES_A_CALL]
            first = np.cumsum(lengths) - lengths
            flat = np.insert(raw[_ranges(start[k : k + PIECES_A_CALL], lengths)], first, 32 if after_space else 1)
            joined = flat.tobytes().decode("latin-1").translate(self.letters)
            ids = np.array(self.cut_words.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            if after_space:  # each begins with a space, and nothing else does
                starts = np.flatnonzero(self.opens[ids])
                counts = np.diff(np.append(starts, len(ids)))
            else:  # a lone space stands before each
                starts = np.flatnonzero(ids == self.space)
                counts = np.diff(np.append(starts, len(ids))) - 1
                ids = ids[ids != self.space]
            self._keep(which[k : k + PIECES_A_CALL], ids, counts)

    def _learn(self, raw: np.ndarray, letter: np.ndarray, start: np.ndarray, end: np.ndarray, bare: np.ndarray, base: int) -> None:
        """Ids of new pieces, numbered from ``base``; those that are not ``bare`` follow a space.

        A piece that is empty or has white space at an end, or may hold a special token, gets length -1."""
        n = base + len(start)
        while len(self.at) < n:
            self.at, self.length, self.uses = (np.concatenate((x, np.zeros(max(len(x), 1 << 15), np.int32))) for x in (self.at, self.length, self.uses))
        size = end - start
        plain, some = np.zeros(len(start), bool), np.flatnonzero(size)
        if len(some):  # the kinds of characters that all bytes of a piece have
            at = _ranges(start[some], size[some])
            kinds = letter[at].view(np.uint8) | _DIGIT[raw[at]].view(np.uint8) << 1 | _MARK[raw[at]].view(np.uint8) << 2
            plain[some] = np.bitwise_and.reduceat(kinds, np.cumsum(size[some]) - size[some]) > 0
        line = np.append(raw, 0)[start] == 10  # between lines
        plain = (plain | (line & (size == 1) & bare)) & (size > 0)
        for after_space in (True, False):
            which = np.flatnonzero(plain & (bare != after_space))
            self._joined(raw, start[which], end[which], base + which, after_space)
        inner, opening, text = [], [], raw.tobytes()
        for k in np.flatnonzero(~plain).tolist():
            piece = text[start[k] : end[k]].decode()
            if not piece or piece[0].isspace() or piece[-1].isspace() or "<|" in piece:
                self.length[base + k] = _ODD
            else:
                (opening if bare[k] else inner).append((base + k, piece))
        for k in range(0, len(inner), 1024):
            part = inner[k : k + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(" " + p for _, p in part)], add_special_tokens=False)[0].ids, np.uint32)
            self._keep(np.array([i for i, _ in part], np.int64), ids, np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids))))
        known = self._whole([p for _, p in opening])
        self._keep(np.array([i for i, _ in opening], np.int64), np.array([i for own in known for i in own], np.uint32), np.array([len(own) for own in known], np.int64))

    def _keep(self, which: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Store the ids, one after another, of the pieces of the given numbers."""
        if len(which) != len(lengths):
            raise ValueError("pieces and tokens do not match")
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate((self.flat, np.zeros(max(len(self.flat), 1 << 16), np.uint32)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.length[which] = lengths
        self.at[which] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)

    def _shrink(self) -> None:
        """Forget the pieces that came once or twice; all, if that leaves too many."""
        kept = np.flatnonzero(self.uses[: self.table.used] > 2)
        if len(kept) > CACHE_PIECES // 2:
            return self.forget()
        keys, length, at, uses = self.table.in_order()[:, kept], self.length[kept], self.at[kept], self.uses[kept]
        flat = self.flat[_ranges(at.astype(np.int64), np.maximum(length, 0).astype(np.int64))]
        self.forget()
        self.table.add(*keys)
        self.flat, self.used = flat, len(flat)
        self.length, self.uses = length, uses
        self.at = (np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)).astype(np.int32)

    def encode(self, texts: list[bytes], end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has, the end id included."""
        if self.table.used > CACHE_PIECES:
            self._shrink()
        if not self.cuts_hold:
            known = self._whole([t.decode() for t in texts])
            tail = [] if end is None else [end]
            return np.array([i for own in known for i in (*own, *tail)], np.uint32), np.array([len(own) + len(tail) for own in known], np.int64)
        size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        text_end = np.cumsum(size)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        some = size > 0
        text_start = text_end - size
        spaces = np.flatnonzero(raw == 32)
        letter, cuts = self._cuts(raw, text_start[some])
        begins = np.sort(np.concatenate((spaces + 1, text_start[some], cuts)), kind="stable")
        ends = np.sort(np.concatenate((spaces, text_end[some], cuts)), kind="stable")
        inside = sum(np.searchsorted(x, text_end) - np.searchsorted(x, text_start) for x in (spaces, cuts))
        counts = np.where(some, inside + 1, 0)
        stops = np.cumsum(counts)
        first = np.append(raw, 0)[np.maximum(begins - 1, 0)] != 32  # no space before
        first[(stops - counts)[some]] = True
        keys = self._keys(raw, begins, ends, first)
        number = self.table.find(*keys)
        new = np.flatnonzero(number == _NEW)
        if len(new):
            _, sample, inverse = np.unique(keys[0][new], return_index=True, return_inverse=True)
            if not (keys[1][new][sample][inverse] == keys[1][new]).all():  # one hash in common, not both
                _, sample, inverse = np.unique(np.stack([k[new] for k in keys], axis=1), axis=0, return_index=True, return_inverse=True)
            base, own = self.table.used, new[sample]
            self.table.add(keys[0][own], keys[1][own])
            self._learn(raw, letter, begins[own], ends[own], first[own], base)
            number[new] = base + inverse
        np.add(self.uses[: self.table.used], np.bincount(number, minlength=self.table.used).astype(np.int32), out=self.uses[: self.table.used])
        length = self.length[number].astype(np.int64)
        odd = np.unique(np.repeat(np.arange(len(texts)), counts)[length == _ODD])
        whole = dict(zip(odd.tolist(), (np.array(i, np.uint32) for i in self._whole([texts[k].decode() for k in odd]))))
        length = np.maximum(length, 0)
        ids = self.flat[_ranges(self.at[number].astype(np.int64), length)]
        stop = np.concatenate(([0], np.cumsum(length)))[stops]
        begin = np.concatenate(([0], stop[:-1]))
        tail = np.zeros(0 if end is None else 1, np.uint32) + np.uint32(end or 0)
        out = [x for k in range(len(texts)) for x in (whole[k] if k in whole else ids[begin[k] : stop[k]], tail)]
        sizes = stop - begin + len(tail)
        for k, own in whole.items():
            sizes[k] = len(own) + len(tail)
        return np.concatenate(out) if out else np.zeros(0, np.uint32), sizes

    @staticmethod
    def _cuts(raw: np.ndarray, text_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where letters are (ASCII, and U+00C0 to U+00FF), and the places besides spaces at which texts are cut."""
        letter = _ALPHA[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
        letter[lead] = letter[lead + 1] = True
        if len(raw) < 3:
            return letter, np.zeros(0, np.int64)
        mark = _MARK[raw]
        begin = np.zeros(len(raw), bool)
        begin[text_start] = True
        tail = np.flatnonzero(letter[:-1] & mark[1:] & ~begin[1:]) + 1
        line = np.flatnonzero((raw[1:-1] == 10) & (letter[:-2] | mark[:-2]) & letter[2:] & ~begin[1:-1] & ~begin[2:]) + 1
        return letter, np.sort(np.concatenate((tail, line, line + 1)), kind="stable")

    @staticmethod
    def _keys(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each piece."""
        size = ends - begins
        rows = np.lib.stride_tricks.sliding_window_view(np.concatenate((raw, np.zeros(16, np.uint8))), 16)[begins].view("<u8")
        rows &= _FIRST_BYTES[np.minimum(size, 16)]
        long = np.flatnonzero(size > 16)  # the others are their own bytes
        if len(long):
            flat, stop = raw[_ranges(begins[long], size[long])], np.cumsum(size[long])
            start = stop - size[long]
            up, down = kernels.powers(len(flat) + 1)
            for k, values in enumerate(_BYTE_VALUES):
                sums = np.zeros(len(flat) + 1, np.uint64)
                np.cumsum(values[flat] * up[: len(flat)], out=sums[1:])
                rows[long, k] = (sums[stop] - sums[start]) * down[start]
        kind = (size * 2 + first).astype(np.uint64)
        a, b = (kernels.mix(rows[:, 0] * x + rows[:, 1] * y + kind * values[2]) for (x, y), values in zip(_FACTORS, _BYTE_VALUES))
        return a, b


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; it lives as long as the worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def repair(ids: np.ndarray, first_symbol: int, *, least: int = LEAST_PAIRS, share: int = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Rules (left, right) of the nonterminals from ``first_symbol`` on, and the replaced sequence.

    A round takes all pairs that occur at least ``least`` times and a ``share``-th as often as the commonest one;
    the last round is the one after which no pair occurs ``least`` times."""
    symbol = max(first_symbol, int(ids.max(initial=0)) + 1)
    if symbol != first_symbol:
        raise ValueError("an id is not below the first nonterminal")
    used = np.zeros(first_symbol, bool)
    used[ids] = True
    used = np.flatnonzero(used)  # ids are numbered by their order among these, so that most pairs fit in 32 bits
    symbol = len(used)
    half = 16 if symbol < 1 << 16 else 32
    place = np.zeros(first_symbol, np.uint32 if half == 16 else np.uint64)
    place[used] = np.arange(symbol)
    sequence, rules = place[ids], []
    while len(sequence) > 1:
        kind = sequence.dtype.type
        pairs = sequence[:-1] << kind(half) | sequence[1:]  # a pair in one number
        pairs.sort()
        last = np.append(np.flatnonzero(pairs[1:] != pairs[:-1]), len(pairs) - 1)
        counts = np.diff(last, prepend=-1)
        if counts.max() < least:
            break
        chosen = pairs[last[counts >= max(least, int(counts.max()) // share)]]
        if half == 16 and symbol + len(chosen) > 1 << 16:
            half, sequence = 32, sequence.astype(np.uint64)
            continue
        left, right = (chosen >> kind(half)).astype(np.int64), (chosen & kind((1 << half) - 1)).astype(np.int64)
        which = _rule_of(sequence, left, right, symbol)
        at = np.flatnonzero(which != 0)
        # of neighbouring places that overlap, every other one is taken
        run = np.zeros(len(at), np.int64)
        new = np.flatnonzero(at[1:] - at[:-1] > 1) + 1
        run[new] = new
        at = at[(np.arange(len(at)) - np.maximum.accumulate(run)) & 1 == 0]
        sequence[at] = (symbol - 1 + which[at].astype(np.int64)).astype(kind)
        keep = np.ones(len(sequence), bool)
        keep[at + 1] = False
        sequence = sequence[keep]
        rules.append(np.stack((left, right), axis=1))
        symbol += len(chosen)
    name = np.concatenate((used, np.arange(first_symbol, first_symbol + symbol - len(used)))).astype(np.uint32)
    return name[np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)], name[sequence]


def _rule_of(sequence: np.ndarray, left: np.ndarray, right: np.ndarray, symbols: int) -> np.ndarray:
    """At each place the number (from 1) of the pair that begins there, 0 for none of them."""
    rows, columns = np.unique(left), np.unique(right)
    width = len(columns) + 1
    row, column = np.zeros(symbols, np.int64), np.zeros(symbols, np.int64)
    row[rows], column[columns] = np.arange(1, len(rows) + 1) * width, np.arange(1, width)
    number = np.arange(1, len(left) + 1, dtype=np.uint16 if len(left) < 1 << 16 else np.int32)
    at = sequence.astype(np.int64)
    cell = row.take(at[:-1])
    cell += column.take(at[1:])
    if (len(rows) + 1) * width <= 1 << 24:
        table = np.zeros((len(rows) + 1) * width, number.dtype)
        table[row[left] + column[right]] = number
        return table.take(cell)
    wanted = row[left] + column[right]
    order = np.argsort(wanted)
    at = np.minimum(np.searchsorted(wanted[order], cell), len(order) - 1)
    return np.where(wanted[order][at] == cell, number[order][at], 0)


def _levels(rules: np.ndarray, first_symbol: int) -> Iterator[tuple[int, int]]:
    """Ranges of rules of which none refers to another of its own range."""
    top = rules.max(axis=1).astype(np.int64) - first_symbol if len(rules) else np.zeros(0, np.int64)
    a = 0
    while a < len(rules):
        inside = np.flatnonzero(top[a:] >= a)
        b = a + int(inside[0]) if len(inside) else len(rules)
        if b == a:
            raise ValueError("a rule refers to itself or a later one")
        yield a, b
        a = b


class Grammar:
    """A block's rules with the expansion of each, and its sequence."""

    def __init__(self, first_symbol: int, rules: np.ndarray, lengths: np.ndarray, sequence: np.ndarray):
        self.first_symbol, self.rules, self.lengths, self.sequence = first_symbol, rules, lengths, sequence
        self._expanded: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @classmethod
    def of(cls, ids: np.ndarray, first_symbol: int, **how) -> Grammar:
        rules, sequence = repair(ids, first_symbol, **how)
        lengths = np.ones(len(rules) + 1, np.uint32)  # the first is a terminal's
        for a, b in _levels(rules, first_symbol):
            lengths[a + 1 : b + 1] = lengths[np.maximum(rules[a:b].astype(np.int64) - first_symbol + 1, 0)].sum(axis=1)
        return cls(first_symbol, rules, lengths[1:], sequence)

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(b"TMRP", 1, self.first_symbol, len(self.rules), len(self.sequence))
        return head + b"".join(x.astype("<u4").tobytes() for x in (self.rules, self.lengths, self.sequence))

    @classmethod
    def from_bytes(cls, data: bytes) -> Grammar:
        magic, version, first_symbol, n_rules, n = _HEAD.unpack_from(data)
        if magic != b"TMRP" or version != 1:
            raise ValueError("not a token block")
        body = np.frombuffer(data, "<u4", offset=_HEAD.size)
        return cls(first_symbol, body[: 2 * n_rules].reshape(-1, 2), body[2 * n_rules : 3 * n_rules], body[3 * n_rules : 3 * n_rules + n])

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        return self._table()[1][np.maximum(symbols.astype(np.int64) - self.first_symbol + 1, 0)]

    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terminals of all rules one after another, and length and start of each; the first is a terminal's own."""
        if self._expanded is None:
            lengths = np.concatenate(([1], self.lengths.astype(np.int64)))
            starts = np.cumsum(lengths) - lengths
            flat = np.zeros(int(lengths.sum()), np.uint32)
            for a, b in _levels(self.rules, self.first_symbol):
                children = self.rules[a:b].astype(np.int64)
                rule = np.maximum(children - self.first_symbol + 1, 0)
                at = np.stack((starts[a + 1 : b + 1], starts[a + 1 : b + 1] + lengths[rule[:, 0]]), axis=1).ravel()
                rule, n, children = rule.ravel(), lengths[rule.ravel()], children.ravel()
                flat[_ranges(at, n)] = flat[_ranges(starts[rule], n)]
                flat[at[rule == 0]] = children[rule == 0]
            self._expanded = flat, lengths, starts
        return self._expanded

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Terminals of some symbols."""
        flat, lengths, starts = self._table()
        rule = np.maximum(symbols.astype(np.int64) - self.first_symbol + 1, 0)
        n = lengths[rule]
        ends = np.cumsum(n)
        out = flat[np.repeat(starts[rule] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        single = rule == 0
        out[ends[single] - 1] = symbols[single]
        return out

    def decode(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Token ids from ``start`` up to ``stop``, expanding only the symbols that cover them."""
        ends = np.cumsum(self._sizes(self.sequence))
        total = int(ends[-1]) if len(ends) else 0
        stop = total if stop is None else min(stop, total)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(self.sequence[a:b])[start - before : stop - before]


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write the ids of all texts in ascending order of id: a row for each block."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    ordered = docs.select(id_col, text_col).withColumnsRenamed({id_col: "id", text_col: "text"})
    # rows of one id, or without an id, are dealt out by the beginnings of their texts
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(parts, "id", F.substring("text", 1, 64)).sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = encoder(tokenizer_file), TaskContext.get().partitionId()
        number = start = held = 0
        ids, sizes, names = [], [], []

        def block() -> pa.RecordBatch:
            grammar = Grammar.of(np.concatenate(ids), coder.size)
            tokens = np.concatenate(sizes)
            columns = [pa.array([shard]), pa.array([number]), pa.array([start]), pa.array([int(tokens.sum())])]
            name = pa.concat_arrays(names)
            columns += [pa.ListArray.from_arrays(pa.array([0, len(name)], pa.int32()), name), pa.array([tokens.tolist()], pa.list_(pa.int64())), pa.array([grammar.to_bytes()])]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "block", "start", "n_tokens", "doc_ids", "doc_tokens", "grammar"])

        for batch in batches:
            texts = kernels.texts_of(batch.column(1))
            for at, to in kernels.blocks(texts, PORTION_BYTES):
                own, n = coder.encode(texts[at:to], end_id)
                ids.append(own), sizes.append(n), names.append(batch.column(0).slice(at, to - at))
                held += len(own)
                if held >= block_tokens:
                    yield block()
                    number, start, held = number + 1, start + held, 0
                    ids, sizes, names = [], [], []
        if held:
            yield block()
        coder._shrink()  # the worker lives on

    schema = f"shard long, block long, start long, n_tokens long, doc_ids array<{kind}>, doc_tokens array<long>, grammar binary"
    ordered.mapInArrow(kernels.freed(run), schema).write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the decoded blocks at ``path``."""
    blocks = spark.read.parquet(path)
    base, before = [], 0
    for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():  # a row for each partition
        base.append((r.shard, before))
        before += r.n
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start, names, sizes, grammar in zip(*(batch.column(k) for k in range(5))):
                ids = Grammar.from_bytes(grammar.as_py()).decode().astype("<u4")
                n = np.array(sizes.as_py(), np.int64)
                stop = np.cumsum(n)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (b - k) : 4 * b]) for b, k in zip(stop.tolist(), n.tolist())]
                columns = [names.values, pa.array(np.full(len(n), shard.as_py())), pa.array(stop - n + start.as_py()), pa.array(n), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shard", "start", "n_tokens", "ids_crc32"])

    spread = blocks.select("shard", "start", "doc_ids", "doc_tokens", "grammar")
    got = spread.mapInArrow(kernels.freed(run), f"doc_id {kind}, shard long, start long, n_tokens long, ids_crc32 long")
    offsets = F.broadcast(spark.createDataFrame(base, "shard long, before long"))
    return got.join(offsets, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_rows(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Write ``docs`` to the shared folder and read the documents' positions and checksums back."""
    path = shared.fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_file)
    return read_tokens(docs.sparkSession, path)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op2_token_id_output(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the written blocks."""
    return token_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
