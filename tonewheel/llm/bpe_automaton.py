"""Byte-level BPE by a compiled tokenization automaton.

A state is the token read last; its arcs say which token may come next. The automaton starts with a state for each byte
and all arcs between them. Each merge (u, v), in rank order, is a gadget: a state for the joined token is added, entered
wherever u is and left wherever v is, and the arc from u to v is taken away. What is left accepts exactly one path for
each word, which is its BPE encoding. States with the same arcs share a row and tokens with the same way in a column, so
the finished table has one bit for each row and column. Words are read by a byte table to the longest token, a bit of
the arc table and a table of next shorter tokens.
"""

from __future__ import annotations

import functools
import hashlib
import json
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewheel.llm.lean import lean

# Fixed: the pre-split of the byte-level tokenizer family.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS_KEPT, LONGEST_KEPT = 150_000, 64


def _byte_letters() -> dict[str, int]:
    """The letter each byte is written as in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Arcs:
    """The arcs left by a sequence of merges, as one bit for each class of states and class of tokens.

    A new state shares the arcs of its parts as they are at that rank: it keeps how many of the part's removals had been
    made, not a copy. Two merges into one token: the first defines its state.
    """

    def __init__(self, size: int, merges: Iterable[tuple[int, int, int]]):
        self.size = size
        self.removed_after: dict[int, list[int]] = {}
        self.removed_before: dict[int, list[int]] = {}
        self.leaves_as: dict[int, tuple[int, int]] = {}
        self.entered_as: dict[int, tuple[int, int]] = {}
        for u, v, joined in merges:
            self._gadget(u, v, joined)
        self._fill()

    def _gadget(self, u: int, v: int, joined: int) -> None:
        after, before = self.removed_after.setdefault(u, []), self.removed_before.setdefault(v, [])
        # pairs are joined from the left: what ends in a joined pair u u may go on with u, u alone not with a joined pair
        left = v, len(self.removed_after.get(v, ()))
        after.append(v)
        before.append(u)
        if joined not in self.leaves_as:
            self.leaves_as[joined] = left
            self.entered_as[joined] = u, len(self.removed_before.get(u, ()))

    def _classes(self, removed: dict[int, list[int]], shares: dict[int, tuple[int, int]]) -> tuple[list[int], list[tuple]]:
        """The class of each token, and of each class the (token, removals of it) that make up its arcs."""
        numbers: dict[tuple, int] = {}
        of = []
        for token in range(self.size):
            key, here, count = [], token, len(removed.get(token, ()))
            while True:
                if count:
                    key.append((here, count))
                if here not in shares:
                    break
                here, count = shares[here]
            of.append(numbers.setdefault(tuple(key), len(numbers)))
        return of, list(numbers)

    def _fill(self) -> None:
        row_of, rows = self._classes(self.removed_after, self.leaves_as)
        column_of, columns = self._classes(self.removed_before, self.entered_as)
        reached: dict[tuple[int, int], list[int]] = {}
        for number, key in enumerate(columns):
            for token, count in key:
                for before in self.removed_before[token][:count]:
                    reached.setdefault((before, token), []).append(number)
        hit = {pair: np.array(found, dtype=np.int32) for pair, found in reached.items()}
        self.width = (len(columns) + 7) // 8
        table = np.empty((len(rows), self.width), dtype=np.uint8)
        for number, key in enumerate(rows):
            line = np.ones(self.width * 8, dtype=bool)
            gone = [hit[token, after] for token, count in key for after in self.removed_after[token][:count] if (token, after) in hit]
            if gone:
                line[np.concatenate(gone)] = False
            table[number] = np.packbits(line, bitorder="little")
        self.bits = table.tobytes()
        self.row = [number * self.width for number in row_of]
        self.byte = [number >> 3 for number in column_of]
        self.bit = [1 << (number & 7) for number in column_of]
        del self.removed_after, self.removed_before, self.leaves_as, self.entered_as

    def allowed(self, state: int, token: int) -> bool:
        """Whether `token` may follow `state`."""
        return self.bits[self.row[state] + self.byte[token]] & self.bit[token] != 0


class Words(dict[str, bytes]):
    """The ids of words met before; all are forgotten when they are too many."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        found = array("i", self.automaton.path(word.encode())).tobytes()
        if len(word) <= LONGEST_KEPT:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = found
        return found


class Automaton:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte, vocab = _byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        spelled = {i: bytes(byte[c] for c in token) for token, i in vocab.items() if token not in self.special}
        size = max([*spelled, *self.special.values()]) + 1
        self.emits = [spelled.get(i, b"") for i in range(size)]
        for token, i in self.special.items():
            self.emits[i] = token.encode()
        merges, built = [], {vocab[c] for c in byte}
        for merge in spec["model"]["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            merges.append((vocab[left], vocab[right], vocab[left + right]))
            built.add(vocab[left + right])
        self.arcs = Arcs(size, merges)
        self._read_bytes({i: spelled[i] for i in built})
        self.split = regex.compile(SPLIT)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = Words(self)

    def _read_bytes(self, tokens: dict[int, bytes]) -> None:
        """`step` leads from a place in a token and a byte to the next place, `ends` from a place to the token ending there."""
        self.step: dict[int, int] = {}
        self.ends = [-1]
        self.shorter = [-1] * len(self.emits)
        for token, data in sorted(tokens.items(), key=lambda item: item[1]):
            place, before = 0, -1
            for b in data:
                arc = place << 8 | b
                place = self.step.get(arc, 0)
                if not place:
                    place = self.step[arc] = len(self.ends)
                    self.ends.append(-1)
                if self.ends[place] >= 0:
                    before = self.ends[place]
            self.ends[place] = token
            self.shorter[token] = before
        self.length = [len(data) for data in self.emits]
        self.reach = max(map(len, tokens.values()))

    def _longest(self, data: bytes, start: int) -> int:
        """The longest token that `data` goes on with at `start`, a step of the byte table each byte."""
        step, ends, place, token = self.step, self.ends, 0, -1
        for b in data[start:start + self.reach]:
            place = step.get(place << 8 | b)
            if place is None:
                break
            if ends[place] >= 0:
                token = ends[place]
        return token

    def path(self, data: bytes) -> list[int]:
        """The one path that spells `data`. A place from which the path cannot go on is left for good."""
        bits, row, byte, bit = self.arcs.bits, self.arcs.row, self.arcs.byte, self.arcs.bit
        length, shorter = self.length, self.shorter
        path: list[int] = []
        closed: set[int] = set()
        at, token = 0, self._longest(data, 0)
        while at < len(data):
            while token >= 0:
                if at + length[token] not in closed and (not path or bits[row[path[-1]] + byte[token]] & bit[token]):
                    break
                token = shorter[token]
            if token >= 0:
                path.append(token)
                at += length[token]
                token = self._longest(data, at)
            else:
                closed.add(at)
                token = path.pop()
                at -= length[token]
                token = shorter[token]
        return path

    def encode(self, text: str) -> bytes:
        """The ids of `text`, 32 bits each."""
        pieces: list[bytes] = []
        for piece in self.specials.split(text) if self.specials else [text]:
            if piece in self.special:
                pieces.append(array("i", [self.special[piece]]).tobytes())
            else:
                pieces.extend(map(self.words.__getitem__, self.split.findall(piece)))
        return b"".join(pieces)

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.emits.__getitem__, ids)).decode(errors="replace")


@functools.lru_cache(1)
def load(path: str) -> Automaton:
    return Automaton(path)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row; a null text counts as empty."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def measure(texts: pa.Array) -> pa.Array:
        automaton, n, ids_sha, decoded_sha = load(path), [], [], []
        for text in texts:
            ids = np.frombuffer(automaton.encode(text.as_py()), dtype=np.int32).tolist()
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(automaton.decode(ids).encode()).hexdigest())
        made = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
        return pa.StructArray.from_arrays(made, names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", measure(F.coalesce(F.col("text"), F.lit(""))).alias("m")).select("doc_id", "m.*")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """`docs` with the array `token_ids` of each text (null: empty); a column of that name is replaced."""

    @F.arrow_udf("array<int>")
    @lean
    def rows(texts: pa.Array) -> pa.Array:
        automaton = load(path)
        found = [automaton.encode(text.as_py()) for text in texts]
        ends = np.cumsum([0, *map(len, found)]) // 4
        ids = pa.array(np.frombuffer(b"".join(found), dtype=np.int32))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)

    return docs.withColumn("token_ids", rows(F.coalesce(F.col("text"), F.lit(""))))


def decode(rows: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """`rows` with the text of `ids` as `decoded` (null ids: null)."""

    @F.arrow_udf("string")
    def text(batch: pa.Array) -> pa.Array:
        automaton = load(path)
        return pa.array([automaton.decode(some.as_py()) if some.is_valid else None for some in batch], pa.string())

    return rows.withColumn("decoded", text(F.col(ids)))
