"""Token counts by a compiled splitting rule and a merge queue.

The tokenizer's splitting rule is compiled into a deterministic transducer over
character classes: seven states, eleven classes, and on each transition what it
emits (a word starts here, or started one character ago). A stream of texts is
cut into chunks of equal length. For every chunk the map from each entry state to
its exit state is computed, all chunks at once; a parallel prefix scan composes
the maps, which gives every chunk its real entry state; a second sweep then reads
the emissions. No transition carries a token count: each word goes through the
merge queue of ``bpe.Merges``, and the numbers of tokens of words of up to 64
characters are kept in a bounded table. The count of a text is the sum over its words.

Defined results: a null text counts as empty and has no tokens; repeated rows are
each answered; texts of any length are read whole, in bounded segments whose state
is carried on.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame

from .bpe import Merges, holds, marked
from .common import map_texts

CHUNK = 256
SEGMENT = 1 << 20  # characters whose state maps are held at once
MOST_WORDS = 1 << 19  # transitions a task keeps; when full, and after a task, the table goes back to its first ones
FIRST_WORDS = 1 << 16
LIMIT = 2048

# Character classes. The letters that contractions are made of have their own.
SPACE, LETTER, NUMBER, OTHER, QUOTE, STMD, R, V, L, E, BREAK = range(11)
LETTERS = (LETTER, STMD, R, V, L, E)
# States: between words, in letters, in other signs, after an opening quote, and after a quote with r, v or l.
BETWEEN, IN_LETTERS, IN_OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)
NOTHING, STARTS, STARTED, BOTH = range(4)  # emissions: a word starts at this character, at the one before, at both


def transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission for each (state, class), for 's 't 're 've 'm 'll 'd, letter runs, single numbers and runs of other signs."""
    to, emits = np.zeros((7, 11), np.uint8), np.zeros((7, 11), np.uint8)
    fresh = {SPACE: (BETWEEN, NOTHING), BREAK: (BETWEEN, NOTHING), NUMBER: (BETWEEN, STARTS), OTHER: (IN_OTHERS, STARTS),
             QUOTE: (QUOTED, STARTS), **{c: (IN_LETTERS, STARTS) for c in LETTERS}}
    rows = {s: dict(fresh) for s in range(7)}
    rows[IN_LETTERS] |= {c: (IN_LETTERS, NOTHING) for c in LETTERS}
    rows[IN_OTHERS] |= {OTHER: (IN_OTHERS, NOTHING), QUOTE: (IN_OTHERS, NOTHING)}
    rows[QUOTED] |= {OTHER: (IN_OTHERS, NOTHING), QUOTE: (IN_OTHERS, NOTHING), STMD: (BETWEEN, NOTHING),
                     R: (QUOTED_R, NOTHING), V: (QUOTED_V, NOTHING), L: (QUOTED_L, NOTHING)}
    for state, closing in ((QUOTED_R, E), (QUOTED_V, E), (QUOTED_L, L)):
        # without its last letter it is no contraction: the letter after the quote began a word
        rows[state] = {c: (s, STARTED | e) for c, (s, e) in rows[IN_LETTERS].items()} | {closing: (BETWEEN, NOTHING)}
    for s, row in rows.items():
        for c, (t, e) in row.items():
            to[s, c], emits[s, c] = t, e
    return to, emits


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of state maps (chunks x states), by doubling strides."""
    maps, stride = maps.copy(), 1
    while stride < len(maps):
        maps[stride:] = np.take_along_axis(maps[stride:], maps[:-stride].astype(np.intp), axis=1)
        stride *= 2
    return maps


def emissions(classes: np.ndarray, to: np.ndarray, emits: np.ndarray, entry: int = BETWEEN, chunk: int = CHUNK) -> tuple[np.ndarray, int]:
    """Emission of every character of a stream that is entered in a state, and the exit state."""
    n = len(classes)
    if not n:
        return np.zeros(0, np.uint8), entry
    count = -(-n // chunk)
    padded = np.full(count * chunk, BREAK, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(count, chunk).T)
    states = len(to)
    flat, out = to.ravel(), emits.ravel()
    width = to.shape[1]
    maps = np.repeat(np.arange(states, dtype=np.uint8)[:, None], count, axis=1)
    for c in columns:  # every entry state of every chunk, one character on
        maps = flat[maps * np.uint8(width) + c]
    before = compose(np.ascontiguousarray(maps.T))
    state = np.empty(count, np.uint8)
    state[0], state[1:] = entry, before[:-1, entry]
    said = np.empty_like(columns)
    exit_state, last = entry, (n - 1) % chunk
    for k, c in enumerate(columns):
        at = state * np.uint8(width) + c
        said[k], state = out[at], flat[at]
        if k == last:
            exit_state = int(state[-1])
    return np.ascontiguousarray(said.T).ravel()[:n], exit_state


@cache
def library_tables() -> tuple[bytes, dict[int, str]]:
    """The class of every code point and the lower-case forms where the tokenizer library differs from this interpreter.

    The library is asked once on the driver, so its Unicode version counts everywhere.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    table = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, number in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        for piece, _ in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(everything):
            table[np.frombuffer(piece.encode("utf-32-le"), np.uint32)] = number
    table[ord("'")] = QUOTE
    for letters, number in (("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        table[[ord(c) for c in letters]] = number
    table[ord("\n")] = BREAK  # normalised texts hold no line ends: it separates texts in a stream
    lower = normalizers.Lowercase()
    odd = {}
    for at in range(0, len(everything), 256):
        some = everything[at:at + 256]
        if lower.normalize_str(some) != "".join(map(str.lower, some)):
            odd |= {ord(c): s for c in some if c.lower() != (s := lower.normalize_str(c))}
    return table.tobytes(), odd | {ord("Σ"): "σ"}  # the library has no final form


class Counter:
    """Counts tokens of texts for a lower-casing word BPE file."""

    def __init__(self, source: str, table: bytes, odd: dict[int, str]):
        spec = json.loads(source)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != PATTERN:
            raise ValueError("the file's normaliser or splitting rule is not the one this transducer is made for")
        self.merges = Merges(spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]))
        self.table, self.odd = np.frombuffer(table, np.uint8), odd
        self.odd_letters = marked(map(chr, odd))
        self.to, self.emits = transducer()
        self.closing: dict[str, int] = {}  # number of tokens by word

    def normal(self, text: str) -> str:
        """NFC and lower case as the library has them; every line end becomes a blank."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if holds(text, self.odd_letters):
                text = text.translate(self.odd)
        return text.lower().replace("\n", " ")

    def tokens(self, word: str) -> int:
        """Number of tokens of a word that is not in the table."""
        n = len(self.merges.encode(word.encode()))
        if len(word) <= 64:
            if len(self.closing) >= MOST_WORDS:
                self.trim()
            self.closing[word] = n
        return n

    def trim(self) -> None:
        """Keep the words met first, which are the frequent ones."""
        if len(self.closing) > FIRST_WORDS:
            self.closing = dict(islice(self.closing.items(), FIRST_WORDS))

    def counts(self, texts: list[str | None]) -> list[int]:
        parts, totals = [], []
        for t in texts:
            # a special string ends what stands before it, and both sides are normalised alone
            pieces = self.special.split(t) if t else []
            parts.append("\n".join(map(self.normal, pieces)))
            totals.append(max(len(pieces) - 1, 0))
        stream = "\n".join(parts) + "\n"
        classes = self.table[np.frombuffer(stream.encode("utf-32-le"), np.uint32)]
        said, state = np.empty(len(classes), np.uint8), BETWEEN
        for a in range(0, len(classes), SEGMENT):
            said[a:a + SEGMENT], state = emissions(classes[a:a + SEGMENT], self.to, self.emits, state)
        starts = (said & STARTS).astype(bool)
        starts[:-1] |= (said[1:] & STARTED).astype(bool)
        bounds = np.flatnonzero(starts | (classes == SPACE) | (classes == BREAK))
        which = np.flatnonzero(starts[bounds])
        begin, end = bounds[which], bounds[which + 1]  # the stream ends in a break
        words = [stream[a:b] for a, b in zip(begin.tolist(), end.tolist())]
        each = np.fromiter((self.closing.get(w) or self.tokens(w) for w in words), np.int64, len(words))
        run = np.concatenate(([0], np.cumsum(each)))
        cuts = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
        at = np.searchsorted(begin, cuts)
        return (run[at[1:]] - run[at[:-1]] + np.array(totals, np.int64)).tolist()


# Fixed value: the splitting rule of the tokenizer file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_counters: dict[int, Counter] = {}


def count(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Append ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) for every whole text."""
    with open(path, encoding="utf-8") as f:  # the tokenizer file lies with the program, not with the data
        source = docs.sparkSession.sparkContext.broadcast((f.read(), *library_tables()))

    def make():
        key = hash(source.value[0])
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(*source.value)
        counter = _counters[key]

        def each(texts):
            found = texts.to_pylist()
            n = counter.counts(found)
            return [len(t.encode()) if t else 0 for t in found], n, [x > limit for x in n]
        return each

    return map_texts(docs, text, "n_bytes long, n_tokens long, over_limit boolean", make, drop=[text], limit=1 << 20,
                     done=lambda: [c.trim() for c in _counters.values()])
