"""Quality rules: a learned decision list over text statistics, emitted as one ordered Spark conditional expression.

Statistics of every whole text come from one pass over its bytes. Sequential covering learns rules for label 0: a rule
grows by the threshold on a share (counts would judge long texts by their length) that gains most information on two thirds of the labelled rows still uncovered, is pruned on the
other third, and joins the list if it is precise enough there; rows that it covers leave. The list becomes
``CASE WHEN rule THEN false ... ELSE true END``, readable and evaluated on the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, lean

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["mean_word", "symbol_share", "upper_share", "digit_share", "bar_share", "mark_share", "dup_line_share", "repeat_share", "distinct_share", "line_words", "other_share"]
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_KIND = np.zeros(256, np.int64)
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[ord("|")] = 3
for _c in b"!?.,;:":
    _KIND[_c] = 4
_KIND[128:192] = 5  # continuation bytes are no code points
for _c in b"#*$%&<>":
    _KIND[_c] = 6
_KIND[9:14] = 7
_KIND[32] = 7


def statistics_of(text: bytes) -> tuple:
    """The values of BASE and SHARES for one text; shares of nothing are 0."""
    words = text.split()
    n = len(words)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=8)
    chars = len(text) - int(kinds[5])
    word_chars = chars - int(kinds[7])
    symbols = int(kinds[3] + kinds[6])
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup_lines = len(lines) - len(set(lines))
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
    repeat = 0
    if n >= 3:
        d = len(number)
        if d < 2_000_000:
            key = (ids[:-2] * d + ids[1:-1]) * d + ids[2:]
        else:
            _, pair = np.unique(ids[:-1] * d + ids[1:], return_inverse=True)
            key = pair[:-1] * d + ids[2:]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        if same.any():
            hit = np.zeros(n, bool)
            at = np.concatenate([order[1:][same], order[:-1][same]])
            for j in range(3):
                hit[at + j] = True
            repeat = int(hit.sum())
    c, w = max(1, word_chars), max(1, n)
    return (
        n, word_chars, symbols, dup_lines, repeat,
        word_chars / w, symbols / c, kinds[1] / c, kinds[2] / c, kinds[3] / c, kinds[4] / c,
        dup_lines / max(1, len(lines)), repeat / w, len(number) / w, n / max(1, len(lines)), (c - kinds[0] - kinds[1] - kinds[2] - symbols - kinds[4]) / c,
    )


def statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, by default; those that clash with a statistic's name are left out) with the statistics."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in BASE + SHARES]
    kept = docs.select(*[F.col(f"`{c.replace('`', '``')}`") for c in names], F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("__bytes"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = pd.DataFrame([statistics_of(t) for t in p["__bytes"]], columns=BASE + SHARES)
            yield pd.concat([p.drop(columns="__bytes").reset_index(drop=True), rows.astype(dict.fromkeys(BASE, "int64"))], axis=1)

    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__bytes"]
    return lean(kept).mapInPandas(run, ", ".join([*fields, *(f"{c} long" for c in BASE), *(f"{c} double" for c in SHARES)]))


@dataclass(frozen=True)
class Condition:
    stat: str
    above: bool
    bound: float

    def holds(self, rows: pd.DataFrame) -> np.ndarray:
        x = rows[self.stat].to_numpy()
        return x >= self.bound if self.above else x <= self.bound

    def column(self) -> Column:
        return F.col(self.stat) >= F.lit(self.bound) if self.above else F.col(self.stat) <= F.lit(self.bound)


Rule = list[Condition]


def covers(rule: Rule, rows: pd.DataFrame) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(rows) for c in rule), np.ones(len(rows), bool))


def _grow(rows: pd.DataFrame, bad: np.ndarray, cuts: int) -> Rule:
    rule: Rule = []
    inside = np.ones(len(rows), bool)
    while len(rule) < 4 and (~bad & inside).any():
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        best, gain = None, 1e-6
        for stat in SHARES:
            x = rows[stat].to_numpy()[inside]
            y = bad[inside]
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            steps = np.flatnonzero(x[1:] > x[:-1])
            if not len(steps):
                continue
            if len(steps) > cuts:
                steps = steps[np.linspace(0, len(steps) - 1, cuts).astype(int)]
            pos = np.cumsum(y)
            for above in (False, True):
                p = (pos[-1] - pos[steps]) if above else pos[steps]
                t = (len(x) - 1 - steps) if above else steps + 1
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / t) - np.log2(p0 / (p0 + n0))), -1)
                k = int(g.argmax())
                if g[k] > gain:
                    gain, bound = g[k], (x[steps[k]] + x[steps[k] + 1]) / 2
                    best = Condition(stat, above, float(bound))
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(rows)
    return rule


def _prune(rule: Rule, rows: pd.DataFrame, bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        hit = covers(r, rows)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1:
        shorter = max((rule[:i] + rule[i + 1 :] for i in range(len(rule))), key=worth)
        if worth(shorter) < worth(rule):
            break
        rule = shorter
    return rule


def learn(rows: pd.DataFrame, bad: np.ndarray, rules: int = 12, precision: float = 0.8, support: int = 3, cuts: int = 400, seed: int = 3) -> list[Rule]:
    """An ordered list of rules for ``bad`` rows; empty if there are none, or no rule is precise enough."""
    r = np.random.default_rng(seed)
    out: list[Rule] = []
    left = np.ones(len(rows), bool)
    while len(out) < rules and (bad & left).sum() >= support:
        i = np.flatnonzero(left)
        third = r.random(len(i)) < 1 / 3
        grow, check = i[~third], i[third]
        rule = _grow(rows.iloc[grow], bad[grow], cuts)
        if not rule:
            break
        rule = _prune(rule, rows.iloc[check], bad[check])
        hit = covers(rule, rows) & left
        if hit.sum() < support or (hit & bad).sum() < precision * hit.sum():
            break
        out.append(rule)
        left &= ~hit
    return out


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: false for the first rule that holds, true if none does."""
    if not rules:
        return F.lit(True)
    case = None
    for rule in rules:
        when = reduce(lambda a, b: a & b, (c.column() for c in rule))
        case = F.when(when, F.lit(False)) if case is None else case.when(when, F.lit(False))
    return case.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000) -> list[Rule]:
    """Rules learnt from the statistics of at most ``max_rows`` labelled documents (a documented bound), held-out
    documents and documents that the base rules reject left out. Of rows that repeat an id, the one of the smallest
    statistics counts; null texts are empty and fail the base rules. Without documents or labels there are no rules."""
    sample = labelled_sample(labels, "quality", max_rows)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), ["doc_id", "label"])
    one = rows.filter(~base_failed()).groupBy("doc_id").agg(F.min(F.struct(*BASE, *SHARES, "label")).alias("x"))
    got = one.select("doc_id", "x.*").limit(max_rows).toPandas().sort_values("doc_id").reset_index(drop=True)
    return learn(got, (got["label"] == 0).to_numpy())


def judged(docs: DataFrame, rules: list[Rule], keep: list[str] | None = None) -> DataFrame:
    """``docs`` with statistics, ``base_failed`` and ``kept``.

    A null text is an empty one: it has no words and fails the base rules. Without labels of both kinds the list is
    empty and only the base rules count. Repeated rows get a row each; an empty table gives no rows. Columns of ``docs``
    whose names clash with those added are left out."""
    rows = statistics(docs, [c for c in (docs.columns if keep is None else keep) if c not in ("base_failed", "kept")])
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
