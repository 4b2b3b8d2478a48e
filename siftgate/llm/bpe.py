"""Byte-level BPE as a deterministic automaton over tokens.

Compilation. The universal automaton has an arc for every token after every token. Merges
are taken in order; the gadget of merge (a, b) takes the arc labelled v away from the state
reached by u whenever the boundary u|v shows a and b to that merge: a is on u's right edge
and b on v's left edge, and neither has been merged into something larger by then. So a
state is the last token emitted, and what is left are exactly the token sequences that the
merges produce. Removed arcs are kept in factored form, one gadget per merge in a table
keyed by (a, b), and a transition that is asked for is settled once and put in the table.

Encoding. A word's bytes are read through the table of token spellings, from each
position with the state reached there. For every prefix there is one accepted sequence,
so each position gets one state, and the path to the end is the word's encoding.
Decoding emits the arcs' labels.

Null texts count as empty: no tokens, empty text. Special tokens that a text spells out get
their own ids, as in the tokenizer's file. The file's path is a parameter.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed value: the pre-split pattern of this tokenizer family, its classes spelled out by split_pattern().
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
CACHED_WORDS = 400_000
CACHED_LENGTH = 100
SETTLED_ARCS = 1_000_000
_NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def split_pattern() -> tuple[str, str]:
    """The pattern with letters, numbers and white space as this tokenizer family knows them.

    First the pattern for texts of the basic plane, which is faster, then that for all texts.

    Python and the regex package follow different Unicode versions. Where they disagree
    (some thousand rare or unassigned code points) the family's own splitter is asked, if installed.
    """
    try:
        from tokenizers.pre_tokenizers import ByteLevel

        pieces = ByteLevel(add_prefix_space=False).pre_tokenize_str
    except ImportError:
        pieces = None
    known = {k: regex.compile(p) for k, p in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\p{White_Space}"))}
    members: dict[str, list[int]] = {"L": [], "N": [], "S": []}
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.category(c)[0]
        if kind == "C" and code > 0xFF and not 0xD800 <= code <= 0xF8FF and pieces:
            kind = next((k for k, p in known.items() if p.match(c)), "")
            if kind:  # not assigned in Python's version
                kind = next((k for k, first in (("L", "a"), ("N", "1")) if len(pieces(first + c)) == 1), "")
        elif kind not in ("L", "N"):
            kind = "S" if known["S"].match(c) else ""
        if kind in members:
            members[kind].append(code)
    basic = {k: _ranges([c for c in v if c < 1 << 16]) for k, v in members.items()}
    return SPLIT.format(**basic), SPLIT.format(**{k: _ranges(v) for k, v in members.items()})


def _ranges(codes: list[int]) -> str:
    out, at = [], 0
    for i in range(1, len(codes) + 1):
        if i == len(codes) or codes[i] != codes[i - 1] + 1:
            out.append(f"\\U{codes[at]:08x}-\\U{codes[i - 1]:08x}")
            at = i
    return "".join(out)


class Words(dict):
    """Packed ids of words; the first CACHED_WORDS ones, which hold the frequent ones, are kept."""

    def __init__(self, encode: Callable[[bytes], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < CACHED_WORDS and len(word) <= CACHED_LENGTH:
            self[word] = packed
        return packed


class Automaton:
    def __init__(self, spellings: list[bytes], merges: list[tuple[int, int, int]], specials: dict[str, int], split: tuple[str, str]):
        """spellings by id; merges as (left, right, result) in order; special texts to ids."""
        self.spellings = list(spellings)
        self.specials = dict(specials)
        self.gadgets: dict[int, int] = {}
        n = len(spellings)
        self.left, self.right, self.rank = [-1] * n, [-1] * n, [-1] * n
        made = set()
        for rank, (a, b, ab) in enumerate(merges):
            self.gadgets.setdefault(a << 32 | b, rank)
            if ab not in made:
                made.add(ab)
                self.left[ab], self.right[ab], self.rank[ab] = a, b, rank
        self.arcs: dict[int, bool] = {}
        self._shown: dict[int, tuple[list, list]] = {}
        # Spelling table: children and token of each node, and by token the longest token that starts it.
        self.kids: list[dict[int, int]] = [{}]
        self.label: list[int] = [-1]
        self.tokens: dict[bytes, int] = {}
        self.length = [len(x) for x in self.spellings]
        self.longest = max(self.length, default=0)
        for token, spelling in enumerate(self.spellings):
            if not spelling or token in self.specials.values():
                continue
            self.tokens[spelling] = token
            node = 0
            for byte in spelling:
                known = self.kids[node].get(byte)
                if known is None:
                    known = self.kids[node][byte] = len(self.kids)
                    self.kids.append({})
                    self.label.append(-1)
                node = known
            self.label[node] = token
        self.shorter = [-1] * n
        for spelling, token in self.tokens.items():
            for size in range(len(spelling) - 1, 0, -1):
                if spelling[:size] in self.tokens:
                    self.shorter[token] = self.tokens[spelling[:size]]
                    break
        self._words = Words(self.word_ids)
        self._special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self._split, self._split_all = map(re.compile, split)
        self._beyond = re.compile("[\U00010000-\U0010ffff]")

    def _edges(self, token: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """What a token's left and right edge show: (part, rank of the merge that hides it)."""
        known = self._shown.get(token)
        if known is None:
            sides = []
            for side in (self.left, self.right):
                shown, until, part = [], _NEVER, token
                while part >= 0:
                    shown.append((part, until))
                    until = self.rank[part]
                    part = side[part]
                sides.append(shown)
            known = self._shown[token] = (sides[0], sides[1])
        return known

    def may_follow(self, u: int, v: int) -> bool:
        """Whether the arc v is left at the state of u."""
        known = self.arcs.get(u << 32 | v)
        if known is None:
            known = True
            gadget = self.gadgets.get
            labels = self._edges(v)[0]
            for a, a_until in self._edges(u)[1]:
                for b, b_until in labels:
                    rank = gadget(a << 32 | b)
                    # At equal ranks the merge further left comes first.
                    if rank is not None and rank < a_until and rank <= b_until:
                        known = False
                        break
                if not known:
                    break
            if len(self.arcs) >= SETTLED_ARCS:
                self.arcs.clear()
            self.arcs[u << 32 | v] = known
        return known

    def word_ids(self, word: bytes) -> list[int]:
        """The accepted path that spells the word.

        Long arcs are tried first, then the next shorter token that starts the same. A
        position is reached in one state only, so one from which the end was not reached is
        closed for good.
        """
        whole = self.tokens.get(word)
        if whole is not None:
            return [whole]
        kids, label, shorter, length, arcs = self.kids, self.label, self.shorter, self.length, self.arcs
        ids: list[int] = []
        closed: set[int] = set()
        n, at, last, longest = len(word), 0, -1, self.longest
        while at < n:
            node, token = 0, -1
            for byte in word[at : at + longest]:
                node = kids[node].get(byte)
                if node is None:
                    break
                if label[node] >= 0:
                    token = label[node]
            while True:
                while token >= 0:
                    if last < 0:
                        allowed = True
                    else:
                        allowed = arcs.get(last << 32 | token)
                        if allowed is None:
                            allowed = self.may_follow(last, token)
                    if allowed and not (closed and at + length[token] in closed):
                        break
                    token = shorter[token]
                if token >= 0:
                    break
                if not ids:
                    raise ValueError("the vocabulary does not spell every byte")
                closed.add(at)
                token = ids.pop()
                at -= length[token]
                last = ids[-1] if ids else -1
                token = shorter[token]
            ids.append(token)
            at += length[token]
            last = token
        return ids

    def _plain(self, text: str) -> bytes:
        split = self._split_all if self._beyond.search(text) else self._split
        return b"".join(map(self._words.__getitem__, split.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self._special is None or not self._special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.specials[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, packed: bytes) -> str:
        spelled = self.spellings
        raw = b"".join(map(spelled.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        return raw.decode("utf-8", "replace")


def load(path: str) -> tuple[list[bytes], list[tuple[int, int, int]], dict[str, int], tuple[str, str]]:
    """What a byte-level BPE file of the tokenizers library holds."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    letters = byte_letters()
    vocab = data["model"]["vocab"]
    specials = {t["content"]: t["id"] for t in data["added_tokens"]}
    spellings = [b""] * (max([*vocab.values(), *specials.values()]) + 1)
    for token, i in vocab.items():
        spellings[i] = bytes(letters[c] for c in token)
    for token, i in specials.items():
        spellings[i] = token.encode()
    merges = []
    for pair in data["model"]["merges"]:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges.append((vocab[a], vocab[b], vocab[a + b]))
    return spellings, merges, specials, split_pattern()


_built: dict[str, Automaton] = {}


def _automaton(spark: SparkSession, path: str) -> Callable[[], Automaton]:
    """The file's automaton, for tasks to ask for.

    The driver reads the file; tasks get its tables by broadcast, their size that of the vocabulary.
    """
    tables = spark.sparkContext.broadcast(load(path))

    def automaton() -> Automaton:
        if path not in _built:
            _built[path] = Automaton(*tables.value)
        return _built[path]

    return automaton


def codec(spark: SparkSession, path: str) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """(encode, decode) column functions: text to packed ids, packed ids to text.

    A plan that returns both the ids and their text would encode twice, as Spark evaluates
    decode(encode(text)) beside encode(text): round_trip() is for that.
    """
    automaton = _automaton(spark, path)

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        a = automaton()
        return pa.array([a.encode(t.as_py() or "") for t in texts], pa.binary())

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        a = automaton()
        return pa.array([a.decode(v.as_py() or b"") for v in ids], pa.string())

    return encode, decode


def round_trip(spark: SparkSession, path: str) -> Callable[[Column], Column]:
    """Column function: text to a struct of its packed ids and the text they decode to, each made once."""
    automaton = _automaton(spark, path)

    @F.arrow_udf("struct<ids: binary, decoded: string>")
    def both(texts: pa.Array) -> pa.Array:
        a = automaton()
        ids = [a.encode(t.as_py() or "") for t in texts]
        decoded = pa.array(map(a.decode, ids), pa.string())
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), decoded], ["ids", "decoded"])

    return both
