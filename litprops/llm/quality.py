"""Quality rules: a learned decision list over plain statistics of a text.

Sequential covering: a rule for bad documents is grown condition by condition (the threshold with the most information gain), then pruned
from its end on documents it was not grown on, and added if enough of what it covers there is bad; covered documents leave, and the next
rule is grown. Where a rule is not good enough, the next one starts with another statistic or direction, until none is left. The list becomes
one ordered Spark ``CASE WHEN``.

Rules are learned from documents that the base rule lets through, among at most :data:`SAMPLE` labelled documents chosen by the hash of their
id; statistics are taken from whole texts of all rows. A list has at most 12 rules of at most 4 conditions; a rule is right for at least 90 per
cent of what it covers in the pruning third and covers at least 2 per cent of the bad documents there, and 2 of them (arguments of :func:`learn`).

Defined results: null, empty or word-less text has all statistics 0; ratios over no words are 0; rows repeated under one id are judged
alike; a label that is null is ignored, of several labels of one document the smallest counts; without labels the list is empty and keeps
everything; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litprops.llm.words import batches, window_hashes, word_hashes

#: Labelled documents that rules are learned from at most.
SAMPLE = 20_000
WINDOW = 8
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
STATISTICS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_same_words long"


def _repeats(windows: np.ndarray) -> int:
    """Words in windows that occur twice or more."""
    order = np.argsort(windows, kind="stable")
    s = windows[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(s) + WINDOW, np.int64)
    at = order[twice]
    edge[at] += 1  # places are distinct
    edge[at + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def _statistics(iterator):
    for piece in batches(iterator, size=2 << 20):
        texts = piece.column(1).to_pylist()
        first, words = word_hashes(piece.column(1))
        windows = window_hashes(words, WINDOW)
        chars, symbols, lines, repeats, again = [], [], [], [], []
        same = words[1:] == words[:-1]
        for text, a, b in zip(texts, first[:-1].tolist(), first[1:].tolist()):
            text = text or ""
            chars.append(len(text) - sum(map(text.count, _SPACES)))
            symbols.append(sum(map(text.count, SYMBOLS)))
            own = [x for x in text.split("\n") if x.strip(_SPACES)]
            lines.append(len(own) - len(set(own)))
            repeats.append(_repeats(windows[a : b - WINDOW + 1]) if b - a > WINDOW else 0)
            again.append(int(same[a : max(a, b - 1)].sum()))
        columns = [np.diff(first), chars, symbols, lines, repeats, again]
        yield pa.RecordBatch.from_arrays([piece.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=[f.split()[0] for f in STATISTICS.split(", ")])


def statistics(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_statistics, STATISTICS)


def features() -> dict[str, Column]:
    """What rules may compare, as expressions over the statistics."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / n,
        "symbol_share": F.col("n_symbols") / n,
        "repeat_share": F.col("n_repeat_words") / n,
        "dup_lines": F.col("n_dup_lines").cast("double"),
        "same_share": F.col("n_same_words") / n,
    }


Condition = tuple[int, str, float]


def _covers(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, op, t in rule:
        hit &= x[:, f] > t if op == ">" else x[:, f] <= t
    return hit


def _best_condition(x: np.ndarray, bad: np.ndarray, barred: set = frozenset()) -> tuple[float, Condition | None]:
    """The condition with the most information gain over rows that the rule covers so far, except ``barred`` statistics and directions."""
    p0, n0 = bad.sum(), (~bad).sum()
    base = np.log2(p0 / (p0 + n0))
    best: tuple[float, Condition | None] = (1e-9, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, b = x[order, f], bad[order]
        edge = np.flatnonzero(v[1:] != v[:-1])
        if not len(edge):
            continue
        p_low, n_low = np.cumsum(b)[edge], np.cumsum(~b)[edge]
        for op, p, n in (("<=", p_low, n_low), (">", p0 - p_low, n0 - n_low)):
            if (f, op) in barred:
                continue
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9)) - base), -1.0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), (f, op, float((v[edge[k]] + v[edge[k] + 1]) / 2)))
    return best


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.9, least: float = 0.02, conditions: int = 4, rules: int = 12) -> list[list[Condition]]:
    """Ordered rules for bad rows. Every third row prunes; rows come in a random order that does not depend on them."""
    prune = np.arange(len(x)) % 3 == 0
    gx, gb, px, pb = x[~prune], bad[~prune], x[prune], bad[prune]
    enough = max(2, least * pb.sum())
    out: list[list[Condition]] = []
    barred: set[tuple[int, str]] = set()  # starts that gave no good rule
    while len(out) < rules and gb.any():
        rule: list[Condition] = []
        while len(rule) < conditions:
            hit = _covers(rule, gx)
            if not gb[hit].any() or gb[hit].all():
                break
            condition = _best_condition(gx[hit], gb[hit], frozenset() if rule else barred)[1]
            if condition is None:
                break
            rule.append(condition)
        if not rule:
            break
        worth = []
        for k in range(1, len(rule) + 1):
            hit = _covers(rule[:k], px)
            p, n = int(pb[hit].sum()), int((~pb[hit]).sum())
            worth.append(((p - n) / (p + n + 1), p, n, k))
        _, p, n, k = max(worth, key=lambda w: (w[0], -w[3]))
        if p < enough or p < precision * (p + n):
            barred.add(rule[0][:2])
            continue
        rule = rule[:k]
        out.append(rule)
        gx, gb = gx[~_covers(rule, gx)], gb[~_covers(rule, gx)]
        px, pb = px[~_covers(rule, px)], pb[~_covers(rule, px)]
    return out


def base_failed() -> Column:
    """The fixed rule, over the statistics."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def learn_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Condition]]:
    labels = labels.select("doc_id", "quality").filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    rows = statistics(texts).filter(~base_failed()).join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id").alias("nth"), "quality", *[e.alias(k) for k, e in features().items()]).collect()
    if not rows:
        return []
    rows = sorted(tuple(r) for r in rows)
    return learn(np.array([r[2:] for r in rows]), np.array([r[1] == 0 for r in rows]))


def verdict(rules: list[list[Condition]]) -> Column:
    """True where no rule of the list fits."""
    columns, out = list(features().values()), None
    for rule in rules:
        fits = F.lit(True)
        for f, op, t in rule:
            fits = fits & (columns[f] > t if op == ">" else columns[f] <= t)
        out = F.when(fits, F.lit(False)) if out is None else out.when(fits, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """All statistics of every row, ``base_failed`` and ``kept``."""
    rules = learn_rules(docs, labels, sample)
    return statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
