"""Quality rules as learned decision lists, in DataFrame functions only.

Statistics of a text are columns. Labelled rows are counted once by their binned
statistics, which leaves at most ``BINS ** len(FEATURES)`` patterns. Sequential covering
then grows a conjunction of thresholds for low quality on one part of the rows, prunes it
on the other, removes what it covers and goes on. The list becomes one ``F.when`` chain.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from bidlens.llm.common import held_out, let
from bidlens.session import materialise

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
# A window's place in the low bits of a long, above it a second hash.
PLACE_BITS = 32

# Statistic, decimals it is rounded to before thresholds are chosen.
FEATURES = {"word_length": 1, "symbol_rate": 2, "dup_line_rate": 2, "repeat_rate": 2, "upper_rate": 2, "mark_rate": 2}
# Thresholds: quantiles of the rows of good quality, and of those of low quality.
GOOD_QUANTILES = (0.01, 0.05, 0.95, 0.99)
LOW_QUANTILES = (0.25, 0.5, 0.75)
BINS = len(GOOD_QUANTILES) + len(LOW_QUANTILES) + 1
MAX_RULES = 12
MAX_CONDITIONS = 4
MIN_PRECISION = 0.9
MIN_COVERED = 5
RECORD = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more in the text.

    Windows are sorted by two hashes (96 bits) and place, so equal ones are neighbours;
    neighbours are compared word by word.
    """

    def windows(ws: Column) -> Column:
        def window(i: Column) -> Column:
            three = [F.get(ws, i + k) for k in range(3)]
            return F.struct(F.xxhash64(*three).alias("h"), F.shiftleft(F.hash(*three).cast("long"), PLACE_BITS).bitwiseOR(i.cast("long")).alias("p"))

        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(ws) - 3), window))

    def places(ws: Column) -> Column:
        def twice(s: Column) -> Column:
            return F.filter(s, lambda x, k: same(ws, F.get(s, k - 1), x) | same(ws, x, F.get(s, k + 1)))

        return F.transform(let(windows(ws), twice), place)

    def same(ws: Column, a: Column, b: Column) -> Column:
        equal = a["h"] == b["h"]
        for step in range(3):
            equal = equal & (F.get(ws, place(a) + step) == F.get(ws, place(b) + step))
        return F.coalesce(equal, F.lit(False))

    def place(window: Column) -> Column:
        return window["p"].bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), p - F.get(at, k - 1))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    return let(words, lambda ws: F.when(F.size(ws) < 4, F.lit(0).cast("long")).otherwise(let(F.sort_array(places(ws)), covered)))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every whole text and the rates that rules look at."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    t = F.col("_text")
    parts = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    size = F.length(t)
    step = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text")).select(
        "doc_id",
        let(parts, lambda ws: F.struct(F.size(ws).cast("long").alias("n"), repeat_words(ws).alias("repeated"))).alias("_w"),
        F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (size - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))).alias("_l"),
        (size - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("_upper"),
        (size - F.length(F.translate(t, "!?", ""))).alias("_marks"),
    )
    counted = step.select(
        "doc_id", F.col("_w.n").alias("n_words"), "word_chars", "n_symbols", (F.col("_l.n") - F.col("_l.d")).alias("n_dup_lines"),
        F.col("_w.repeated").alias("n_repeat_words"), F.col("_l.n").alias("_lines"), "_upper", "_marks",
    )

    def rate(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return counted.select(
        "doc_id", *RECORD,
        rate("word_chars", "n_words").alias("word_length"), rate("n_symbols", "word_chars").alias("symbol_rate"),
        rate("n_dup_lines", "_lines").alias("dup_line_rate"), rate("n_repeat_words", "n_words").alias("repeat_rate"),
        rate("_upper", "word_chars").alias("upper_rate"), rate("_marks", "word_chars").alias("mark_rate"),
    )


def thresholds(labelled: DataFrame) -> dict[str, list[float]]:
    """Cut points of each statistic: quantiles of both classes, over all labelled rows, of rounded values."""
    asked = []
    for name, digits in FEATURES.items():
        for good, quantiles in ((1, GOOD_QUANTILES), (0, LOW_QUANTILES)):
            value = F.when(F.col("_good") == good, F.round(F.col(name), digits))
            asked.append(F.percentile(value, F.array(*map(F.lit, quantiles))).alias(f"{name}_{good}"))
    row = labelled.agg(*asked).first()
    # Between the values that occur, so that a rounded value does not decide.
    return {
        name: sorted({round(v, digits) + 0.5 * 10 ** -digits for good in (0, 1) for v in row[f"{name}_{good}"] or []})
        for name, digits in FEATURES.items()
    }


def patterns(labelled: DataFrame, cuts: dict[str, list[float]]) -> list[tuple]:
    """(bins, low and good rows to grow on, low and good rows to prune on), counted by Spark."""
    bins = [sum((F.col(n) >= F.lit(c)).cast("int") for c in cuts[n]) + F.lit(0) for n in FEATURES]
    prune = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    low = F.col("_good") == 0
    # At most BINS ** len(FEATURES) rows, whatever the number of labels.
    counted = labelled.groupBy(*[b.alias(n) for b, n in zip(bins, FEATURES)]).agg(
        *[F.sum(c.cast("long")).alias(n) for n, c in (("a", low & ~prune), ("b", ~low & ~prune), ("c", low & prune), ("d", ~low & prune))]
    )
    return sorted((tuple(r[:len(FEATURES)]), r["a"], r["b"], r["c"], r["d"]) for r in counted.collect())


def learn_rules(rows: list[tuple], cuts: dict[str, list[float]]) -> list[list[tuple[str, str, float]]]:
    """Ordered conjunctions (statistic, ">=" or "<", cut) that mark low quality."""
    names = list(FEATURES)
    tests = [(f, op, k) for f, n in enumerate(names) for k in range(1, len(cuts[n]) + 1) for op in (">=", "<")]

    def holds(test, bins) -> bool:
        f, op, k = test
        return (bins[f] >= k) == (op == ">=")

    def totals(covered) -> list[int]:
        return [sum(r[i] for r in covered) for i in (1, 2, 3, 4)]

    left, rules = rows, []
    while len(rules) < MAX_RULES:
        rule, covered = [], left
        while len(rule) < MAX_CONDITIONS:
            p, n, _, _ = totals(covered)
            if not p or not n:
                break
            now, best = math.log2(p / (p + n)), (1e-9, None, None)
            for test in tests:
                inside = [r for r in covered if holds(test, r[0])]
                q, m, _, _ = totals(inside)
                if q:
                    gain = q * (math.log2(q / (q + m)) - now)
                    if gain > best[0]:
                        best = (gain, test, inside)
            if best[1] is None:
                break
            rule, covered = [*rule, best[1]], best[2]

        def worth(conditions) -> tuple[float, list]:
            inside = [r for r in left if all(holds(t, r[0]) for t in conditions)]
            _, _, p, n = totals(inside)
            return ((p - n) / (p + n) if p + n else -1.0), inside

        while len(rule) > 1 and worth(rule[:-1])[0] >= worth(rule)[0]:
            rule = rule[:-1]
        inside = worth(rule)[1] if rule else []
        p, n, c, d = totals(inside)
        if not rule or p + c < MIN_COVERED or not c or c / (c + d) < MIN_PRECISION or p / (p + n) < MIN_PRECISION:
            break
        rules.append([(names[f], op, cuts[names[f]][k - 1]) for f, op, k in rule])
        left = [r for r in left if not all(holds(t, r[0]) for t in rule)]
    return rules


def rule_column(rules: list[list[tuple[str, str, float]]]) -> Column:
    """Number of the first rule that holds, null if none does."""
    chain = None
    for k, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for name, op, cut in rule:
            holds = holds & (F.col(name) >= F.lit(cut) if op == ">=" else F.col(name) < F.lit(cut))
        chain = F.when(holds, F.lit(k)) if chain is None else chain.when(holds, F.lit(k))
    return F.lit(None).cast("int") if chain is None else chain


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> list[list[tuple[str, str, float]]]:
    """Rules from all labelled rows that are not held out; no labels, no rules."""
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(quality_col).alias("_good")).filter(
        F.col("_good").isin(0, 1) & ~held_out(F.col("_id"))
    )
    labelled = stats.join(known, F.col("doc_id") == F.col("_id"))
    cuts = thresholds(labelled)
    return learn_rules(patterns(labelled, cuts), cuts)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, the four counts, base_failed, kept, rule) of every whole text.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated windows.
    ``rule`` is the number of the learned rule that rejects the text, null if none does;
    ``kept`` is false if the base failed or a rule rejects. Null texts count as empty and
    fail the base; repeated rows are judged each; without labels only the base decides;
    labels other than 0 and 1 are not used. A text of any length is one array of words, so
    it has to fit into a task; an empty table gives an empty one; further columns, whatever
    their names, are left behind.
    """
    # Thresholds, patterns and the verdict read the statistics, which are costly; numbers only are written.
    stats = materialise(statistics(docs, id_col, text_col), "statistics")
    rules = learn(stats, labels)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = stats.withColumn("base_failed", failed).withColumn("rule", rule_column(rules))
    return judged.select("doc_id", *RECORD, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
