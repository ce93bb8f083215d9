"""Byte-level BPE encoding and decoding.

A word's bytes form a doubly linked list of symbols. A priority queue holds the
adjacent pairs by merge rank, then position; the best pair is merged, its new
neighbours are queued, and entries whose symbols changed meanwhile are skipped as
stale. Decoding concatenates the vocabulary strings of the ids. Words come from
the tokenizer's own splitting pattern; results of short words are kept in a
bounded table per task. The vocabulary file is read on the driver and broadcast
(its size is fixed by the tokenizer, a few MB).

Defined results: a null text counts as empty and gives no ids; repeated rows are
each answered; special strings inside texts become their special id, as by default.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

MOST_WORDS = 1 << 18  # words whose ids a task keeps; when full, and after a task, the table goes back to its first words
FIRST_WORDS = 1 << 16  # those met first are the frequent ones
LONGEST_WORD = 64  # longer words are not kept


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class Merges:
    """Ids of byte symbols and ranked merges. ``suffix`` marks the last symbol of a word."""

    def __init__(self, vocab: dict[str, int], merges: Sequence, suffix: str | None = None):
        letters = byte_letters()
        self.first = [vocab[c] for c in letters]
        self.last = [vocab[c + suffix] for c in letters] if suffix else self.first
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            self.rank.setdefault(vocab[a] << 32 | vocab[b], rank)
            self.made.append(vocab[a + b])

    def encode(self, word: bytes) -> list[int]:
        """Ids of one word."""
        rank_of, n = self.rank.get, len(word)
        ids = [*map(self.first.__getitem__, word)]
        ids[-1] = self.last[word[-1]]
        # the rank of each symbol and its next, None where they do not merge or the symbol is gone
        now = [rank_of(a << 32 | b) for a, b in zip(ids, islice(ids, 1, None))]
        now.append(None)
        # a queue entry is the rank with the position in its low bits, so ranks order first and positions next
        bits = n.bit_length()
        low = (1 << bits) - 1
        queue = [r << bits | i for i, r in enumerate(now) if r is not None]
        if not queue:
            return ids
        made, pop, push = self.made, heapq.heappop, heapq.heappush
        heapq.heapify(queue)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while queue:
            best = pop(queue)
            rank, i = best >> bits, best & low
            if now[i] != rank:
                continue  # stale: one of the two symbols has been merged since
            j = after[i]
            new = ids[i] = made[rank]
            ids[j] = -1
            now[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = now[i] = rank_of(new << 32 | ids[k])
                if r is not None:
                    push(queue, r << bits | i)
            else:
                now[i] = None
            h = before[i]
            if h >= 0:
                r = now[h] = rank_of(ids[h] << 32 | new)
                if r is not None:
                    push(queue, r << bits | h)
        return [x for x in ids if x >= 0]


class Codec:
    """A byte-level BPE tokenizer from its JSON text."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, special = spec["model"], [t for t in spec["added_tokens"]]
        plain = {"normalizer": None, "dropout": None, "byte_fallback": False, "ignore_merges": False}
        if any((spec | model).get(k) != v for k, v in plain.items()) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in special):
            raise ValueError("only plain byte-level BPE files are supported")
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in special}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        back = {c: b for b, c in enumerate(byte_letters())}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.strings = [b""] * size
        for token, i in model["vocab"].items():
            self.strings[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.digits = [str(i) for i in range(size)]
        # the contractions may stand behind letters and numbers, which do not begin with their mark
        self.words = regex.compile(r" ?\p{L}+| ?\p{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.ascii_words = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
        self.odd, self.exact = newer_letters(), None
        self.kept: dict[str, list[int]] = {}

    def pieces(self, text: str) -> list[str]:
        """Words of a text by the library's letters and numbers, also where this interpreter's tables are newer."""
        if text.isascii():
            return self.ascii_words.findall(text)
        if self.odd[0] is not None and holds(text, self.odd[0]):
            if self.exact is None:
                self.exact = regex.compile(self.odd[1], regex.V1)
            return self.exact.findall(text)
        return self.words.findall(text)

    def word_ids(self, word: str) -> list[int]:
        ids = self.kept.get(word)
        if ids is None:
            ids = self.merges.encode(word.encode())
            if len(word) <= LONGEST_WORD:
                if len(self.kept) >= MOST_WORDS:
                    self.trim()
                self.kept[word] = ids
        return ids

    def trim(self) -> None:
        """Keep the words met first, so that a worker does not hold the table of an earlier job."""
        if len(self.kept) > FIRST_WORDS:
            self.kept = dict(islice(self.kept.items(), FIRST_WORDS))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for i, part in enumerate(self.split_special.split(text) if "<|" in text else (text,)):
            if i % 2:
                out.append(self.special[part])
            elif part:
                out += chain.from_iterable(map(self.word_ids, self.pieces(part)))
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 read as U+FFFD. Ids outside the vocabulary add nothing."""
        strings, size = self.strings, len(self.strings)
        known = ids if len(ids) and min(ids) >= 0 and max(ids) < size else [i for i in ids if 0 <= i < size]
        return b"".join(map(strings.__getitem__, known)).decode(errors="replace")

    def decimal(self, ids: Sequence[int]) -> str:
        """Ids of this vocabulary as decimal numbers joined by commas."""
        return ",".join(map(self.digits.__getitem__, ids))


def marked(letters) -> np.ndarray:
    """A table that marks the given characters among all code points."""
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in letters]] = True
    return table


def holds(text: str, table: np.ndarray) -> bool:
    return bool(table[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any())


_newer: list = []


def newer_letters():
    """Code points that ``regex`` calls letters or numbers and the tokenizer library, with older tables, does not."""
    if not _newer:
        from tokenizers import Regex, pre_tokenizers

        odd = {}
        for name in "LN":
            own, split = regex.compile(rf"\p{{{name}}}"), pre_tokenizers.Split(Regex(rf"\p{{{name}}}"), "removed", invert=True)
            found = "".join(own.findall("".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))))
            theirs = set("".join(p for p, _ in split.pre_tokenize_str(found)))
            odd[name] = "".join(c for c in found if c not in theirs)
        if not any(odd.values()):
            _newer.append((None, None))
        else:
            letter, number = (rf"[\p{{{n}}}--[{odd[n]}]]" if odd[n] else rf"[\p{{{n}}}]" for n in "LN")
            _newer.append((marked(odd["L"] + odd["N"]),
                           rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?(?:(?!{letter}|{number})\S)+|\s+(?!\S)|\s+"))
    return _newer[0]


_codecs: dict[int, Codec] = {}


def codec(source: str) -> Codec:
    """One codec per worker process and file."""
    key = hash(source)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(source)
    return _codecs[key]


def trim() -> None:
    for c in _codecs.values():
        c.trim()


def _shared(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:  # the tokenizer file lies with the program, not with the data
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Append the ids of every whole text as ``ids array<int>``."""
    source = _shared(docs, path)

    def make():
        c = codec(source.value)
        return lambda texts: [list(map(c.encode, texts.to_pylist()))]

    return map_texts(docs, text, f"`{ids}` array<int>", make, done=trim)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Append the text of an id list; null ids give null."""
    source = _shared(encoded, path)

    @F.arrow_udf("string")
    def back(lists):
        c = codec(source.value)
        return pa.array([None if x is None else c.decode(x) for x in lists.to_pylist()], pa.string())

    return encoded.withColumn(text, back(F.col(ids)))


def round_trip(docs: DataFrame, path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Append ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas), ``decoded_sha256`` and, if asked for, ``ids``."""
    source = _shared(docs, path)

    def make():
        from hashlib import sha256

        c = codec(source.value)

        def each(texts):
            counts, of_ids, of_text, kept = [], [], [], []
            for t in texts.to_pylist():
                ids = c.encode(t)
                if with_ids:
                    kept.append(pa.array(ids, pa.int32()))
                counts.append(len(ids))
                of_ids.append(sha256(c.decimal(ids).encode()).hexdigest())
                of_text.append(sha256(c.decode(ids).encode()).hexdigest())
            lists = not with_ids or [pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), pa.concat_arrays(kept) if kept else pa.array([], pa.int32()))]
            return counts, of_ids, of_text, *(lists if with_ids else [])
        return each

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return map_texts(docs, text, fields, make, drop=[text], done=trim)
