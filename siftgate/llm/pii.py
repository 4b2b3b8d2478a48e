"""Personal data in whole texts: base patterns, and a skip-chain conditional random field.

The base kinds are regex matches that pass their tests. The field runs over a document's
tokens (runs without white space). Tokens without a digit or an at sign cannot be part of
an entity and are fixed to `none`, which cuts the chain into stretches; tokens in base
spans are fixed to their kind. The rest are inferred: unary potentials from a softmax on
token shape and context, chain potentials between adjacent tokens, and skip potentials
between distant tokens that repeat each other (equal texts, equal last seven digits, equal
names before the at sign). Loopy sum-product messages pass labels along both, so a token that
repeats an entity elsewhere in the document gets its label. Tokens whose marginal
for a kind reaches CERTAIN are added, adjacent ones of a kind as one span; base spans stay.

Training is piecewise, in numpy on the driver: on at most SAMPLE_ROWS documents with the base
labels, the unary softmax is fitted with features dropped at random, and the chain and skip
potentials are smoothed log ratios of how often labels meet.

Repeats within a document are linked to their previous and first occurrence, so links stay
linear in the tokens. Null texts are empty; texts without digits or at signs have no spans.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgate.llm.common import hashed_sample

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
BITS = 14
SAMPLE_ROWS = 2_000
STEPS = 30_000
CERTAIN = 0.8
ROUNDS = 10
SPAN = "struct<kind:string,start:int,end:int,base:boolean>"

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start where a run of digits starts, and greedy parts never give back.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile("[0-9@]")
_SPACE = re.compile(r"\s")
_EDGES = ",.;:!?\"'()[]{}<>|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end), by kind, then start."""
    found = []
    at = done = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            found.append((0, start, m.end()))
            done = m.end()
        at += 1
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append((3, m.start(), m.end()))
    return found


def tokens(text: str) -> list[tuple[int, int]]:
    """Start and end of the tokens with a digit or an at sign, punctuation at the edges cut off."""
    found = []
    end = 0
    while m := _SIGN.search(text, end):
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        stop = _SPACE.search(text, m.end())
        end = stop.start() if stop else len(text)
        a, z = start, end
        while a < z and text[a] in _EDGES:
            a += 1
        while z > a and text[z - 1] in _EDGES:
            z -= 1
        if a < z:
            found.append((a, z))
    return found


def _shape(token: str) -> str:
    out = []
    for c in token[:64]:
        s = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if len(out) < 2 or out[-1] != s or out[-2] != s:
            out.append(s)
    return "".join(out)


def features(text: str, spans: list[tuple[int, int]], i: int) -> list[int]:
    a, z = spans[i]
    token = text[a:z]
    before = text[max(0, a - 24) : a].split()
    after = text[z : z + 24].split()
    n = len(_digits(token))
    names = [
        "bias",
        f"shape {_shape(token)}",
        f"digits {min(n, 20)}",
        f"length {min(len(token), 40) // 4}",
        f"dots {min(token.count('.'), 4)}",
        f"at {'@' in token}",
        f"start {token[0]}",
        f"before {before[-1].lower() if before else ''}",
        f"after {after[0].lower() if after else ''}",
        f"plus {text[max(0, a - 2) : a]}",
    ]
    return [zlib.crc32(x.encode()) >> (32 - BITS) for x in names]


def possible(token: str) -> list[bool]:
    """Labels that a token's characters allow."""
    number = set(token) <= set("0123456789()+.-")
    return [True, "@" in token, number and "." in token, number and len(_digits(token)) >= 4, number]


def complete(kind: int, text: str) -> bool:
    """Whether a span that the field adds has what its kind needs."""
    digits = _digits(text)
    if kind == 0:
        return "@" in text[1:-1]
    if kind == 1:
        return bool(_IP.fullmatch(text)) and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text.split("."))
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 7 <= len(digits) <= 15


def _keys(token: str) -> list[str]:
    digits = _digits(token)
    keys = [token.lower()] if len(token) >= 6 else []
    if len(digits) >= 7:
        keys.append("digits " + digits[-7:])
    name, at, _ = token.partition("@")
    if at and len(name) >= 3:
        keys.append("name " + name.lower())
    return keys


def links(text: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain pairs (only white space and punctuation between) and skip pairs."""
    chain = [(i, i + 1) for i in range(len(spans) - 1) if not text[spans[i][1] : spans[i + 1][0]].strip(_EDGES + " \t\n\r")]
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    skip = set()
    for i, (a, z) in enumerate(spans):
        for key in _keys(text[a:z]):
            if key in first:
                skip |= {(first[key], i), (last[key], i)}
            first.setdefault(key, i)
            last[key] = i
    return chain, sorted(skip)


def labelled(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> np.ndarray:
    """Label of each token that a base span overlaps, 0 for the others."""
    out = np.zeros(len(spans), np.int64)
    starts, ends = (np.array([s[k] for s in spans], np.int64) for k in (0, 1))
    for kind, a, z in reversed(base):
        out[np.searchsorted(ends, a, "right") : np.searchsorted(starts, z, "left")] = kind + 1
    return out


@dataclass
class Field:
    """Unary weights (buckets x labels), chain and skip potentials (labels x labels)."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, feats: list[list[int]], can: np.ndarray, fixed: np.ndarray, chain, skip) -> np.ndarray:
        """Loopy sum-product; labels that a token cannot have are out, fixed ones (above 0) clamped."""
        own = np.where(can, [self.unary[f].sum(axis=0) for f in feats], -60.0)
        own -= own.max(axis=1, keepdims=True)
        held = fixed > 0
        own[held] = -30.0
        own[held, fixed[held]] = 0.0
        pairs = np.array([*chain, *skip], np.int64).reshape(-1, 2)
        if not len(pairs):
            p = np.exp(own)
            return p / p.sum(axis=1, keepdims=True)
        table = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)])
        source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        weight = np.exp(np.concatenate([table, table.transpose(0, 2, 1)]))
        back = (np.arange(len(source)) + len(pairs)) % len(source)
        message = np.zeros((len(source), len(LABELS)))
        for _ in range(ROUNDS):
            belief = own.copy()
            np.add.at(belief, target, message)
            sent = belief[source] - message[back]
            sent = np.exp(sent - sent.max(axis=1, keepdims=True))
            new = np.log(np.einsum("el,elm->em", sent, weight) + 1e-30)
            message = 0.5 * message + 0.5 * (new - new.max(axis=1, keepdims=True))
        belief = own.copy()
        np.add.at(belief, target, message)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def train(texts: list[str], steps: int = STEPS, seed: int = 3) -> Field:
    """Piecewise training on base labels; without tokens everything is `none`."""
    rng = np.random.default_rng(seed)
    n = len(LABELS)
    rows, labels = [], []
    met = {"chain": np.ones((n, n)), "skip": np.ones((n, n))}
    for text in texts:
        spans = tokens(text)
        y = labelled(spans, base_spans(text))
        rows += [features(text, spans, i) for i in range(len(spans))]
        labels += y.tolist()
        for name, pairs in zip(("chain", "skip"), links(text, spans)):
            for i, j in pairs:
                met[name][y[i], y[j]] += 1
                met[name][y[j], y[i]] += 1
    unary = np.zeros((1 << BITS, n))
    unary[:, 0] = 0.1
    if rows:
        x, y = np.array(rows), np.array(labels)
        for k in range(steps):
            i = rng.integers(len(y))
            f = x[i][rng.random(x.shape[1]) < 0.7]
            z = unary[f].sum(axis=0)
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            np.subtract.at(unary, f, 0.2 * (1 - k / steps) * p[None, :])

    share = np.bincount(np.array(labels, np.int64), minlength=n) + 1.0
    share /= share.sum()

    def ratio(c: np.ndarray) -> np.ndarray:
        return np.clip(np.log(c / c.sum() / (share[:, None] * share[None, :])), -4, 4)

    # What repeats an entity is one: labels of repeats agree, however rare repeats were in the sample.
    agree = np.where(np.eye(n, dtype=bool), 4.0, 0.0)
    agree[0, 1:] = agree[1:, 0] = -8.0
    return Field(unary, ratio(met["chain"]), np.clip(ratio(met["skip"]), -2, 2) + agree)


def find(text: str, field: Field) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by kind as listed, then start."""
    if not _SIGN.search(text):
        return []
    base = base_spans(text)
    out = [(k, a, z, True) for k, a, z in base]
    spans = tokens(text)
    fixed = labelled(spans, base)
    if len(spans) and not fixed.all():
        chain, skip = links(text, spans)
        feats = [features(text, spans, i) for i in range(len(spans))]
        p = field.marginals(feats, np.array([possible(text[a:z]) for a, z in spans]), fixed, chain, skip)
        best = np.where((fixed == 0) & (p[:, 1:].max(axis=1) >= CERTAIN), p[:, 1:].argmax(axis=1), -1)
        near = set(chain)
        added: list[list[int]] = []
        for i in np.flatnonzero(best >= 0).tolist():
            # Numbers of several tokens are one span; the other kinds are one token.
            if i and best[i] == best[i - 1] == KINDS.index("phone") and (i - 1, i) in near:
                added[-1][2] = spans[i][1]
            else:
                added.append([int(best[i]), *spans[i]])
        out += [(k, a, z, False) for k, a, z in added if complete(k, text[a:z])]
    return [(KINDS[k], a, z, b) for k, a, z, b in sorted(out)]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Field:
    """Train on at most `rows` documents, those with the smallest hashes of their ids among the ones with a digit or an at sign."""
    text = F.col(text_col)
    marked = docs.where(text.rlike("[0-9@]")).select(F.col(id_col).alias("id"), text.alias("t"))
    sample = hashed_sample(marked, ["id"], rows).toArrow()["t"].to_pylist()
    return train(sorted(sample))


def finder(docs: DataFrame, field: Field) -> Callable[[Column], Column]:
    """A column function: whole text to an array of SPAN. The field's tables (fixed size) are broadcast."""
    model = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    @F.arrow_udf(f"array<{SPAN}>")
    def of(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts:
            rows.append([dict(zip(("kind", "start", "end", "base"), s)) for s in find(text.as_py() or "", model.value)])
        return pa.array(rows, kind)

    return lambda text: of(F.coalesce(text, F.lit("")))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
