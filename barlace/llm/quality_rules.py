"""Operator 5: quality rules, a learned decision list over native text statistics.

Statistics are DataFrame expressions alone.  The list is learned on the driver
from a bounded sample of labelled documents by sequential covering: a rule
grows condition by condition (best information gain on two thirds of the
sample), is pruned on the last third, and its documents are set aside before
the next rule starts.  The result is an ordered CASE expression: the first rule
that fits a document rejects it, and what no rule fits is kept.

Window hashes are 64-bit; two different windows of one text would be taken for
equal with a chance below n^2 / 2^64 for n words.

Cases: null or empty text has no words and fails the base rule; null ids are
kept as they are; repeated rows are judged each; labels that are null or name
unknown documents teach nothing; without labels of both kinds the list is empty
and only the base rule holds; extra columns pass through; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the list is learned from, at most, chosen by a hash of their id.
FIT_ROWS = 6000
#: Rules in the list and conditions in a rule, at most.
MOST_RULES, MOST_CONDITIONS = 12, 3
#: A rule stays if so large a share of what it rejects on the pruning part is of low quality.
LEAST_PRECISION = 0.9
#: Thresholds tried for each statistic: so many quantiles.
QUANTILES = 64

#: Statistics that conditions may use: name and SQL over the counts.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "exclamations": "n_exclamations / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}


def let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def repeated_words_sql(words: str) -> str:
    """Words in 3-word windows that occur twice or more in the array ``words``."""
    windows = f"transform(slice({words}, 1, size({words}) - 2), (v, i) -> xxhash64(v, get({words}, i + 1), get({words}, i + 2)))"
    ordered = "sort_array(transform(g, (h, i) -> struct(h as h, i as i)))"
    twice = "filter(s, (x, k) -> (k > 0 and get(s, k - 1).h = x.h) or coalesce(get(s, k + 1).h = x.h, false))"
    covered = "aggregate(transform(p, (v, k) -> coalesce(least(3, get(p, k + 1) - v), 3)), 0L, (a, x) -> a + x)"
    count = let("s", ordered, let("p", f"sort_array(transform({twice}, x -> x.i))", covered))
    some = let("g", windows, f"if(size(array_distinct(g)) = size(g), 0L, {count})")
    return f"if(size({words}) < 4, 0L, {some})"


def stats_sql(text: str) -> str:
    """SQL of one struct with all counts of a text column; each pass over the text is made once."""
    space = "concat(' ', char(9), char(10), char(11), char(12), char(13))"
    words = "array_remove(split(t, '[\\\\x20\\\\x09-\\\\x0D]+'), '')"
    lines = "filter(split(t, '\\\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    removed = lambda chars: f"cast(length(t) - length(translate(t, {chars}, '')) as long)"
    counts = (
        f"named_struct('n_words', cast(size(w) as long), 'word_chars', cast(length(translate(t, {space}, '')) as long), "
        f"'n_symbols', {removed(repr('#*$%&|<>'))}, 'n_lines', cast(size(l) as long), "
        f"'n_dup_lines', cast(size(l) - size(array_distinct(l)) as long), 'n_repeat_words', {repeated_words_sql('w')}, "
        f"'n_capitals', {removed(repr('ABCDEFGHIJKLMNOPQRSTUVWXYZ'))}, 'n_exclamations', {removed(repr('!'))})"
    )
    return let("t", f"coalesce({text}, '')", let("w", words, let("l", lines, counts)))


def with_stats(docs: DataFrame, text_col: str = "text", to: str = "_stats") -> DataFrame:
    return docs.withColumn(to, F.expr(stats_sql(f"cast(`{text_col}` as string)")))


BASE_FAILED = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.feature]
        return x >= self.threshold if self.above else x <= self.threshold

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def fits(rule: Rule, table: dict[str, np.ndarray]) -> np.ndarray:
    n = len(next(iter(table.values())))
    return np.logical_and.reduce([c.holds(table) for c in rule]) if rule else np.ones(n, bool)


def rules_sql(rules: list[Rule]) -> str:
    """Ordered conditional: number of the first rule that rejects, 0 if none does."""
    if not rules:
        return "0"
    cases = " ".join(f"when {' and '.join(c.sql() for c in rule)} then {k}" for k, rule in enumerate(rules, 1))
    return f"case {cases} else 0 end"


def _grow(table: dict[str, np.ndarray], low: np.ndarray) -> Rule:
    """Adds the condition of largest FOIL gain until the rule is pure."""
    rule: Rule = ()
    inside = np.ones(len(low), bool)
    while len(rule) < MOST_CONDITIONS:
        p0, n0 = (inside & low).sum(), (inside & ~low).sum()
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for feature, x in table.items():
            for t in np.unique(np.quantile(x[inside], np.linspace(0, 1, QUANTILES + 1), method="nearest")):
                for above in (True, False):
                    now = inside & (x >= t if above else x <= t)
                    p, n = (now & low).sum(), (now & ~low).sum()
                    if p and (value := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = Condition(feature, above, float(t)), value
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(table)
    return rule


def _prune(rule: Rule, table: dict[str, np.ndarray], low: np.ndarray) -> tuple[Rule, float]:
    """The prefix of the rule of largest (p - n) / (p + n) on the pruning part, and its precision there."""
    best, worth, precision = rule, -2.0, 0.0
    for k in range(len(rule), 0, -1):
        now = fits(rule[:k], table)
        p, n = (now & low).sum(), (now & ~low).sum()
        if p + n and (value := (p - n) / (p + n)) > worth:
            best, worth, precision = rule[:k], value, p / (p + n)
    return best, precision


def learn_rules(table: dict[str, np.ndarray], low: np.ndarray) -> list[Rule]:
    """Sequential covering; every third row prunes, the others grow."""
    rules: list[Rule] = []
    index = np.arange(len(low))
    while len(rules) < MOST_RULES:
        grow, prune = index[index % 3 != 2], index[index % 3 == 2]
        part = lambda rows: {k: v[rows] for k, v in table.items()}
        if not low[grow].any() or low[grow].all():
            break
        rule = _grow(part(grow), low[grow])
        rule, precision = _prune(rule, part(prune), low[prune])
        if not rule or precision < LEAST_PRECISION:
            break
        rules.append(rule)
        index = index[~fits(rule, part(index))]
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[Rule]:
    """Decision list from at most FIT_ROWS labelled documents that pass the base rule."""
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label"))
        .where("_id is not null and _label is not null")
        .orderBy(F.xxhash64("_id"), "_id", "_label")
        .limit(FIT_ROWS)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    # the base rule is applied below: as a Spark filter it would move under the join, to every document
    known = with_stats(texts.join(F.broadcast(chosen), "_id"), "_text").select("_id", "_label", "_stats.*")
    rows = (
        known.select("_label", "_id", F.expr(BASE_FAILED).alias("_failed"), *(F.expr(sql).cast("double").alias(name) for name, sql in FEATURES.items()))
        .orderBy(F.xxhash64("_id"), "_id", *FEATURES)
        .limit(2 * FIT_ROWS)
        .collect()  # bounded by the limit
    )
    rows = [r for r in rows if not r["_failed"]]
    table = {name: np.array([r[name] for r in rows], float) for name in FEATURES}
    return learn_rules(table, np.array([r["_label"] == 0 for r in rows], bool))


def judged(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The documents with ``_stats`` (counts, base_failed, rule, kept)."""
    out = with_stats(docs, text_col)
    named = {name: f"_stats.{name}" for name in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_exclamations")}

    def on_stats(sql: str):
        for name, path in named.items():
            sql = _word(name).sub(path, sql)
        return F.expr(sql)

    verdict = F.struct("_stats.*", on_stats(BASE_FAILED).alias("base_failed"), on_stats(rules_sql(rules)).alias("rule"))
    out = out.withColumn("_stats", verdict)
    return out.withColumn("_stats", F.struct("_stats.*", F.expr("not _stats.base_failed and _stats.rule = 0").alias("kept")))


def _word(name: str):
    import re

    return re.compile(rf"\b{name}\b")


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Counts, base_failed, rule and kept for each document."""
    rules = fit_rules(docs, labels, id_col, text_col, label_col)
    return judged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rules).select(
        "doc_id", "_stats.n_words", "_stats.word_chars", "_stats.n_symbols", "_stats.n_dup_lines", "_stats.n_repeat_words",
        "_stats.base_failed", "_stats.kept", "_stats.rule",
    )


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The documents that the base rule and the list keep, with all their columns."""
    rules = fit_rules(docs, labels, id_col, text_col, label_col)
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))  # no given column can clash
    return judged(given, rules).where("_stats.kept").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
