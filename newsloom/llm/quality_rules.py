"""Quality rules as a learned decision list.

Statistics of every whole text are computed first.  Sequential covering then learns, from a bounded
sample of labelled rows, conjunctions of thresholds on them: a rule grows by the condition with the
largest information gain, is pruned on held-out rows, and the rows that it covers leave the training
set.  The list becomes one ordered Spark conditional expression, so all rows are judged without Python.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import BLANK_BYTES, encoded, pieces, ready

# fixed values: the symbols that the base statistics count
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
CONTINUATION = bytes(range(128, 192))
STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_marks", "n_letters",
)
MARKS = b"!?"
# shares only: none of them drifts with the length of a text
FEATURES = {
    "mean_word": lambda: _ratio("word_chars", "n_words"),
    "symbols_per_word": lambda: _ratio("n_symbols", "n_words"),
    "dup_line_share": lambda: _ratio("n_dup_lines", "n_lines"),
    "repeat_share": lambda: _ratio("n_repeat_words", "n_words"),
    "upper_share": lambda: _ratio("n_upper", "n_letters"),
    "marks_per_word": lambda: _ratio("n_marks", "n_words"),
    "letters_per_word": lambda: _ratio("n_letters", "n_words"),
}


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def count_statistics(raw: bytes) -> tuple[int, ...]:
    """The values of STATISTICS for one text in UTF-8."""
    words = raw.split()
    joined = raw.translate(None, BLANK_BYTES)
    word_chars = len(joined.translate(None, CONTINUATION))
    n_symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip(BLANK_BYTES)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    distinct = len(set(windows))
    repeated = 0
    if distinct < len(windows):
        seen: dict[tuple, int] = {}
        for window in windows:
            seen[window] = seen.get(window, 0) + 1
        end = 0
        for at, window in enumerate(windows):
            if seen[window] > 1:
                repeated += at + 3 - max(end, at)
                end = at + 3
    letters = len(joined.translate(None, CONTINUATION)) - len(joined.translate(None, LETTERS))
    return (
        len(words),
        word_chars,
        n_symbols,
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(joined) - len(joined.translate(None, UPPER)),
        len(joined) - len(joined.translate(None, MARKS)),
        letters,
    )


def _kernel(text_at: int, keep: list[int], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [count_statistics(raw) for raw in encoded(batch.column(text_at))]
            counted = [pa.array(column, pa.int64()) for column in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + counted, names)

    return run


def with_statistics(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) and the statistics of the text.

    A null text has zero everywhere.  Columns of ``docs`` that are named like a statistic are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in STATISTICS]
    source = ready(docs).select(*keep, *([] if text_col in keep else [text_col]))
    kept = [source.schema[c] for c in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{s} long" for s in STATISTICS])
    kernel = _kernel(source.columns.index(text_col), [source.columns.index(c) for c in keep], [*keep, *STATISTICS])
    return source.mapInArrow(kernel, schema)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values > self.threshold if self.above else values <= self.threshold

    def expression(self) -> Column:
        value = FEATURES[self.feature]()
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    inside = np.ones(len(next(iter(x.values()))), bool)
    for condition in rule:
        inside &= condition.holds(x[condition.feature])
    return inside


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, thresholds: int, max_conditions: int) -> Rule:
    """Adds the condition with the largest gain until only bad rows are covered."""
    inside, rule = np.ones(len(bad), bool), ()
    while len(rule) < max_conditions and (p0 := int((inside & bad).sum())) and (inside & ~bad).any():
        base = math.log2(p0 / int(inside.sum()))
        best, gain = None, 1e-9
        for feature, values in x.items():
            now = values[inside]
            cuts = np.unique(np.quantile(now, np.linspace(0, 1, thresholds), method="lower"))
            order = np.sort(now), np.sort(now[bad[inside]])
            below_all, below_bad = (np.searchsorted(part, cuts, "right") for part in order)
            for above in (True, False):
                n = len(now) - below_all if above else below_all
                p = p0 - below_bad if above else below_bad
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(p > 0, p * (np.log2(p / np.maximum(n, 1)) - base), -1.0)
                at = int(gains.argmax())
                if gains[at] > gain:
                    best, gain = Condition(feature, above, float(cuts[at])), float(gains[at])
        if best is None:
            break
        beyond = x[best.feature][inside & (x[best.feature] > best.threshold)]
        if len(beyond):  # halfway to the next value
            best = replace(best, threshold=(best.threshold + float(beyond.min())) / 2)
        rule = (*rule, best)
        inside &= best.holds(x[best.feature])
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drops final conditions while the held-out rows do not speak against it."""

    def worth(candidate: Rule) -> float:
        inside = _covers(candidate, x)
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    cuts = [rule[:i] for i in range(len(rule), 0, -1)]
    return max(cuts, key=worth) if cuts else ()


def learn_rules(
    x: dict[str, np.ndarray],
    bad: np.ndarray,
    hold_out: np.ndarray,
    max_rules: int = 16,
    max_conditions: int = 4,
    thresholds: int = 64,
    min_precision: float = 0.97,
    min_covered: int = 4,
) -> list[Rule]:
    """Ordered rules that name bad rows, found by sequential covering.

    Without bad rows, or without good ones, no rule is learned: everything stays.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules and (bad & left & ~hold_out).any() and (~bad & left).any():
        part = left & ~hold_out
        rule = _grow({k: v[part] for k, v in x.items()}, bad[part], thresholds, max_conditions)
        test = left & hold_out
        rule = _prune(rule, {k: v[test] for k, v in x.items()}, bad[test])
        if not rule:
            break
        inside = _covers(rule, x) & left
        p, n = int((inside & bad).sum()), int(inside.sum())
        if n < min_covered or p < min_precision * n:
            break
        rules.append(rule)
        left &= ~inside
    return rules


def rule_number(rules: list[Rule]) -> Column:
    """The decision list: number of the first rule that covers the row, from 1; 0 without one."""
    out = F.when(F.lit(False), F.lit(0))
    for number, rule in enumerate(rules, 1):
        condition = F.lit(True)
        for part in rule:
            condition = condition & part.expression()
        out = out.when(condition, F.lit(number))
    return out.otherwise(F.lit(0))


def fit_rules(docs: DataFrame, labels: DataFrame, sample: int = 8192, id_col="doc_id", text_col="text", **options) -> list[Rule]:
    """Rules from at most ``sample`` labelled rows, those with the smallest hash of their id.

    ``labels`` has ``doc_id`` and ``quality`` (0: bad).  Rows without id or quality are not used.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .select(F.col("doc_id").cast("long").alias("_label_id"), F.col("quality").alias("_quality"))
        .orderBy(F.xxhash64("_label_id"), "_label_id", "_quality")
        .limit(sample)
    )
    # at most `sample` rows of two numbers
    labelled = docs.select(id_col, text_col).join(F.broadcast(chosen), F.col(id_col).cast("long") == F.col("_label_id"))
    measured = with_statistics(labelled, keep=["_label_id", "_quality"], text_col=text_col)
    rows = measured.select("_label_id", "_quality", *(FEATURES[f]().alias(f"f_{f}") for f in FEATURES)).toPandas()
    rows = rows.drop_duplicates("_label_id").sort_values("_label_id")
    x = {f: rows[f"f_{f}"].to_numpy(float) for f in FEATURES}
    bad = rows["_quality"].to_numpy() == 0
    # every third of the ids in hash order is held out for pruning
    hold_out = (rows["_label_id"].to_numpy(np.int64) * 2654435761 >> 7) % 3 == 0
    return learn_rules(x, bad, hold_out, **options)


def judge(docs: DataFrame, rules: list[Rule], keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Statistics, base_failed, rule (number, 0: none) and kept for every row of ``docs``.

    The base fails a text under 50 words, or with more than half of its words in repeated 3-word windows;
    hence a null or empty text is not kept.  Repeated rows are judged alike.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        with_statistics(docs, keep, text_col)
        .withColumn("base_failed", base)
        .withColumn("rule", rule_number(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    )


def describe(rules: list[Rule]) -> list[str]:
    return [" and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:g}" for c in rule) for rule in rules]
