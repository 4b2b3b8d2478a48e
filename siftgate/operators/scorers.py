"""Layer scorers: the slots of a run and how to fill them.

A scorer builds one column, struct<score,reason,error,details>, from the inputs routed to
its layer. A non-null error marks the item as failed in that layer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgate.constants import DEFAULT_SCORE, DEFAULT_SCORER_IDS, LAYERS, SPECIALISED_TARGETS
from siftgate.functions.text import match_text
from siftgate.operators.matching import MATCHED, Entry, WordlistIndex, matched_in, severity_score

Inputs = Mapping[str, Column]


@dataclass(frozen=True)
class Scorer:
    """prepare: steps whose columns are computed in projections of their own, one after
    the other, and join the inputs. For expressions used in several places, which would
    otherwise be evaluated once per use."""

    id: str
    version: str
    score: Callable[[Inputs], Column]
    prepare: Sequence[Callable[[Inputs], Mapping[str, Column]]] = ()


def outcome(
    score: Column | float,
    reason: Column | str,
    error: Column | None = None,
    details: Mapping[str, Column] | None = None,
) -> Column:
    """The column a scorer returns. On error the score is -1 and the reason tells it."""
    score = F.lit(float(score)) if isinstance(score, (int, float)) else score.cast("double")
    reason = F.lit(reason) if isinstance(reason, str) else reason
    details = details or {"none": F.lit(None).cast("string")}
    if error is None:
        error = F.lit(None).cast("string")
    failed = error.isNotNull()
    return F.struct(
        F.when(failed, F.lit(-1.0)).otherwise(score).alias("score"),
        F.when(failed, F.concat(F.lit("error: "), error)).otherwise(reason).alias("reason"),
        error.alias("error"),
        F.struct(*[v.alias(k) for k, v in details.items()]).alias("details"),
    )


def constant_scorer(target: str, score: float = DEFAULT_SCORE, scorer_id: str | None = None) -> Scorer:
    """A fixed score, reason stub-<target>."""
    return Scorer(
        scorer_id or DEFAULT_SCORER_IDS.get(target, f"{target}-constant"),
        "0.4.0",
        lambda i: outcome(
            score, f"stub-{target}", details={"target": F.lit(target), "score": F.lit(float(score))}
        ),
    )


def text_default() -> Scorer:
    return Scorer(
        DEFAULT_SCORER_IDS["text_risk"],
        "0.2.0",
        lambda i: outcome(
            DEFAULT_SCORE, "stub-text-risk", details={"matched_words": F.array().cast("array<string>")}
        ),
    )


def vision_default() -> Scorer:
    axes = ("porn_score", "violence_score", "ad_score", "political_score")
    return Scorer(
        DEFAULT_SCORER_IDS["vision"],
        "0.2.0",
        lambda i: outcome(
            DEFAULT_SCORE,
            "stub-vision",
            details={
                **{axis: F.lit(DEFAULT_SCORE) for axis in axes},
                "exif_keys": F.coalesce(F.map_keys(i["exif"]), F.array().cast("array<string>")),
            },
        ),
    )


def metadata_default() -> Scorer:
    return Scorer(
        DEFAULT_SCORER_IDS["metadata"],
        "0.2.0",
        lambda i: outcome(
            DEFAULT_SCORE,
            "stub-metadata",
            details={k: F.lit(False) for k in ("has_exif", "has_gps", "ai_gen_suspected")},
        ),
    )


def wordlist_scorer(entries: Sequence[Entry] | WordlistIndex, scorer_id: str = "text-risk-wordlist") -> Scorer:
    """Text score from a wordlist: severity_score of the matched entries.

    A short list goes into the plan; an index of a wordlist table is held by the workers.
    """
    matched = entries.matched if isinstance(entries, WordlistIndex) else lambda text: matched_in(text, entries)
    return Scorer(
        scorer_id,
        "0.1.0",
        wordlist_outcome,
        [
            lambda i: {"normal": match_text(i["ocr_text"])},
            lambda i: {"matched": matched(i["normal"])},
        ],
    )


def wordlist_outcome(inputs: Inputs) -> Column:
    """The text outcome of rows whose `matched` is known."""
    return outcome(severity_score(inputs["matched"]), "wordlist-match", details={"matched_words": inputs["matched"]})


def matched_elsewhere(scorer_id: str = "text-risk-wordlist") -> Scorer:
    """Stands in for a wordlist scorer whose `matched` is joined later: an outcome of the same type."""
    return Scorer(scorer_id, "0.1.0", lambda i: wordlist_outcome({"matched": F.array().cast(MATCHED)}))


def native_scorer(scorer_id: str, fn: Callable[[Inputs], Column], reason: str, error=None) -> Scorer:
    """A score from built-in functions. `error` may give a message column, null when fine."""
    return Scorer(scorer_id, "0.1.0", lambda i: outcome(fn(i), reason, error(i) if error else None))


def column_scorer(scorer_id: str, column: str, reason: str) -> Scorer:
    """A score that is already a column of the items, e.g. from a model's own table."""
    return Scorer(scorer_id, "0.1.0", lambda i: outcome(F.col(column), reason))


def _scored_apart(fn: Callable[..., pd.Series], columns: Sequence[pd.Series]) -> tuple[list, list]:
    """Scores and errors of all rows. A batch that throws, or gives another number of values than
    rows, is halved until the rows at fault are alone, and only they fail."""
    n = len(columns[0]) if columns else 0
    scores: list = [None] * n
    errors: list = [None] * n
    spans = [(0, n)] if n else []
    while spans:
        lo, hi = spans.pop()
        try:
            values = list(fn(*[c.iloc[lo:hi].reset_index(drop=True) for c in columns]))
            if len(values) != hi - lo:
                raise ValueError(f"{len(values)} scores for {hi - lo} rows")
            scores[lo:hi] = values
        except Exception as exc:
            if hi - lo == 1:
                errors[lo] = str(exc) or type(exc).__name__
            else:
                middle = (lo + hi) // 2
                spans += [(lo, middle), (middle, hi)]
    return scores, errors


def _frame(live: np.ndarray, scores: list, errors: list) -> pd.DataFrame:
    out = pd.DataFrame({"score": [None] * len(live), "error": [None] * len(live)}, dtype=object)
    out.loc[live, "score"] = pd.Series(scores, index=out.index[live], dtype=object)
    out.loc[live, "error"] = pd.Series(errors, index=out.index[live], dtype=object)
    return out


def _python(scorer_id: str, version: str, run: Callable, inputs: Sequence[str], reason: str) -> Scorer:
    return Scorer(
        scorer_id,
        version,
        lambda i: outcome(i["result"]["score"], reason, i["result"]["error"]),
        [lambda i: {"result": run(i["runs"], *[i[name] for name in inputs])}],
    )


def python_scorer(
    scorer_id: str, fn: Callable[..., pd.Series], inputs: Sequence[str], reason: str, version: str = "0.1.0"
) -> Scorer:
    """A score from a function over pandas Series, run on Arrow batches.

    Skipped items are not passed on; items with null inputs are. Rows at fault fail alone.
    """

    @F.pandas_udf("struct<score:double,error:string>")
    def run(goes: pd.Series, *columns: pd.Series) -> pd.DataFrame:
        live = goes.to_numpy(dtype=bool)
        return _frame(live, *_scored_apart(fn, [c[live].reset_index(drop=True) for c in columns]))

    return _python(scorer_id, version, run, inputs, reason)


# The models of this process, by the scorer they were set up for.
_MODELS: dict[str, Callable[..., pd.Series]] = {}


def _model(token: str, setup: Callable[[], Callable[..., pd.Series]]) -> Callable[..., pd.Series]:
    if token not in _MODELS:
        _MODELS[token] = setup()
    return _MODELS[token]


def _weights(column: pd.Series) -> np.ndarray:
    """Bytes of each value, roughly."""
    if column.dtype != object:
        return np.full(len(column), 8)
    return np.array([len(v) if isinstance(v, (str, bytes, bytearray, list, dict, np.ndarray)) else 8 for v in column], np.int64)


def _cuts(columns: Sequence[pd.Series], batch_bytes: int, batch_rows: int) -> list[tuple[int, int]]:
    """Spans of rows of at most batch_rows rows and batch_bytes bytes; a larger row is alone."""
    sizes = np.sum([_weights(c) for c in columns], axis=0)
    spans, lo, total = [], 0, 0
    for i, size in enumerate(sizes):
        if i > lo and (total + size > batch_bytes or i - lo == batch_rows):
            spans.append((lo, i))
            lo, total = i, 0
        total += size
    return [*spans, (lo, len(sizes))] if len(sizes) else []


def batch_scorer(
    scorer_id: str,
    setup: Callable[[], Callable[..., pd.Series]],
    inputs: Sequence[str],
    reason: str,
    version: str = "0.1.0",
    batch_bytes: int = 16_000_000,
    batch_rows: int = 1_000,
) -> Scorer:
    """A score from a model that is costly to set up and wants batches of its own size.

    setup() gives the function over pandas Series; it is called once per Python worker
    process, which serves many tasks and batches. Incoming batches are joined and cut
    again to at most batch_rows rows and batch_bytes bytes of input (a larger row is alone).
    Skipped items are not passed on. Rows at fault fail alone; when setup throws, the job fails.
    """
    token = f"{scorer_id}-{uuid.uuid4().hex}"

    def flush(held: list[tuple[np.ndarray, list[pd.Series]]]) -> pd.DataFrame:
        live = np.concatenate([goes for goes, _ in held])
        columns = [pd.concat(parts, ignore_index=True) for parts in zip(*[c for _, c in held])]
        scores, errors = [], []
        for lo, hi in _cuts(columns, batch_bytes, batch_rows):
            found = _scored_apart(_model(token, setup), [c.iloc[lo:hi].reset_index(drop=True) for c in columns])
            scores += found[0]
            errors += found[1]
        return _frame(live, scores, errors)

    @F.pandas_udf("struct<score:double,error:string>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        held, rows, size = [], 0, 0
        for goes, *columns in batches:
            live = goes.to_numpy(dtype=bool)
            given = [c[live].reset_index(drop=True) for c in columns]
            held.append((live, given))
            rows += int(live.sum())
            size += int(sum(_weights(c).sum() for c in given))
            if rows >= batch_rows or size >= batch_bytes:
                yield flush(held)
                held, rows, size = [], 0, 0
        if held:
            yield flush(held)

    return _python(scorer_id, version, run, inputs, reason)


class ScorerRegistry:
    """Named scorers in order of registration."""

    def __init__(self) -> None:
        self._scorers: dict[str, Scorer] = {}

    def register(self, target: str, scorer: Scorer) -> None:
        if target in self._scorers:
            raise ValueError(f"a scorer for {target!r} is already registered")
        self._scorers[target] = scorer

    def get(self, target: str) -> Scorer | None:
        return self._scorers.get(target)

    def targets(self) -> list[str]:
        return list(self._scorers)

    def size(self) -> int:
        return len(self._scorers)

    def slots(self) -> dict[str, Scorer]:
        return dict(self._scorers)


def default_slots(**overrides: Scorer) -> dict[str, Scorer]:
    """A scorer for each of the seven layers; layers not given get their default."""
    unknown = set(overrides) - set(LAYERS)
    if unknown:
        raise ValueError(f"unknown layers: {sorted(unknown)}")
    slots = {
        "text_risk": text_default(),
        "vision": vision_default(),
        "metadata": metadata_default(),
        **{target: constant_scorer(target) for target in SPECIALISED_TARGETS},
    }
    return {layer: overrides.get(layer, slots[layer]) for layer in LAYERS}


def route(layer: str, unless: Column | None = None) -> dict[str, Column]:
    """Inputs of a layer, from the item columns. `unless`: rows to pass null for, so that
    batch scorers skip them."""
    text, boxes = F.col("ocr_text"), F.col("bboxes")
    if layer == "text_risk":
        inputs = {
            "ocr_text": F.coalesce(text, F.lit("")),
            "bboxes": F.coalesce(boxes, F.array().cast("array<string>")),
        }
    elif layer == "vision":
        inputs = {"ocr_text": text, "exif": F.col("exif")}
    elif layer == "metadata":
        inputs = {"content": F.coalesce("content", F.lit(b""))}
    else:
        inputs = {"target": F.lit(layer)}
    inputs["item_id"] = F.col("item_id")
    if unless is None:
        return inputs
    return {name: F.when(~unless, value) for name, value in inputs.items()}


def runs(unless: Column | None) -> Column:
    """Whether batch scorers get a row."""
    return F.lit(True) if unless is None else ~F.coalesce(unless, F.lit(False))


def layer_inputs(items: DataFrame) -> DataFrame:
    """One struct column per layer holding its inputs with their defaults."""
    return items.select(
        "item_id", *[F.struct(*[c.alias(n) for n, c in route(layer).items()]).alias(layer) for layer in LAYERS]
    )


PARTS = ("score", "reason", "error", "details")


def score_layers(
    items: DataFrame, slots: Mapping[str, Scorer], unless: Column | Mapping[str, Column] | None = None
) -> DataFrame:
    """Add the outcome of each layer as columns <layer>_score, _reason, _error, _details.

    `unless`: rows to skip, for all layers or by layer.

    Flat columns, as the optimizer would copy the expression behind a struct field into
    every place that reads it. Inputs of skipped rows are null; their outcomes are
    meaningless and must be masked by the caller. Batch scorers are evaluated for every
    row of a conditional, so masking the inputs is what saves their work.
    """
    skip = {layer: unless.get(layer) if isinstance(unless, Mapping) else unless for layer in LAYERS}
    inputs = {layer: {**route(layer, skip[layer]), "runs": runs(skip[layer])} for layer in LAYERS}
    ready, temporary = items, []
    for step in range(max(len(slots[layer].prepare) for layer in LAYERS)):
        added: dict[str, Column] = {}
        for layer in LAYERS:
            if step < len(slots[layer].prepare):
                for name, value in slots[layer].prepare[step](inputs[layer]).items():
                    added[f"__{layer}_{name}"] = value
                    inputs[layer][name] = F.col(f"__{layer}_{name}")
        ready = ready.withColumns(added)
        temporary += added
    outcomes = {}
    for layer in LAYERS:
        out = slots[layer].score(inputs[layer])
        outcomes.update({f"{layer}_{part}": out[part] for part in PARTS})
    return ready.withColumns(outcomes).drop(*temporary)


def pack_layers(slots: Mapping[str, Scorer]) -> list[Column]:
    """The flat layer columns as one struct column per layer, with the id of its scorer."""
    return [
        F.struct(*[F.col(f"{layer}_{part}").alias(part) for part in PARTS], F.lit(slots[layer].id).alias("agent")).alias(layer)
        for layer in LAYERS
    ]
