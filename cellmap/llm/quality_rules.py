"""Quality rules: decision lists learned by sequential covering, in DataFrame operations only.

The statistics of every text are built-in expressions over one array of words per row;
nothing is shuffled. Rules are conjunctions of thresholds on ratios of those statistics.
They are grown on labelled rows by information gain, pruned on held-out labelled rows,
and emitted as one ordered CASE expression that Spark evaluates for all rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete_chars, one_space, smallest_hashed

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

FEATURES = ["words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "bang_share", "upper_share"]


def with_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``n_lines``, ``n_bangs``, ``n_upper``.

    A null or blank text has no words and zeros everywhere. Any existing columns of these
    names are replaced. A text of any length is worked on in its own row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    blank = one_space(text)
    line = F.filter(F.split(text, "\n"), lambda x: F.length(delete_chars(x, " \t\x0b\x0c\r")) > 0)
    out = df.withColumns({
        "_w": F.array_remove(F.split(blank, " "), ""),
        "_lines": line,
        "word_chars": F.length(F.replace(blank, F.lit(" "), F.lit(""))).cast("long"),
        "n_symbols": (F.octet_length(text) - F.octet_length(delete_chars(text, SYMBOLS))).cast("long"),
        "n_bangs": (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("!"), F.lit("")))).cast("long"),
        "n_upper": (F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long"),
    })
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    }).drop("_lines")
    n = F.size("_w") - 2
    windows = F.arrays_zip(*[F.slice("_w", i, n).alias(k) for i, k in ((1, "a"), (2, "b"), (3, "c"))], F.sequence(F.lit(1), n).alias("i"))
    out = out.withColumn("_z", F.when(n > 1, F.sort_array(windows))).drop("_w")

    def same(x: Column, y: Column) -> Column:
        return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def twice(x: Column, k: Column) -> Column:  # equal windows are neighbours; beyond either end there is null
        z = F.col("_z")
        return F.coalesce(same(x, F.get(z, k + 1)), F.lit(False)) | F.coalesce(same(x, F.get(z, k - 1)), F.lit(False))

    starts = F.transform(F.filter("_z", twice), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
    return out.withColumn("n_repeat_words", F.coalesce(F.size(F.array_distinct(F.flatten(starts))), F.lit(0)).cast("long")).drop("_z")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def feature_columns() -> dict[str, Column]:
    """Each of ``FEATURES`` as an expression over the statistics; zero where a text has no words."""
    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "bang_share": share("n_bangs", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.threshold if self.above else row[self.feature] < self.threshold

    def column(self) -> Column:
        e = feature_columns()[self.feature]
        return e >= F.lit(self.threshold) if self.above else e < F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covered(rule: Rule, rows: list[dict]) -> list[dict]:
    return [r for r in rows if all(c.holds(r) for c in rule)]


def _thresholds(values: list[float], most: int = 24) -> list[float]:
    distinct = sorted(set(values))
    return [distinct[len(distinct) * i // most] for i in range(1, most)] if len(distinct) > most else distinct[1:]


def _grow(bad: list[dict], good: list[dict], longest: int = 4) -> Rule:
    """Add the condition of the largest gain until no good row is covered."""
    rule: Rule = ()
    while good and bad and len(rule) < longest:
        before = math.log2(len(bad) / (len(bad) + len(good)))
        best, gain = None, 1e-9
        for f in FEATURES:
            pairs = sorted([(r[f], 1) for r in bad] + [(r[f], 0) for r in good])
            p_all, n_all = len(bad), len(good)
            cuts, i, p, n = _thresholds([v for v, _ in pairs]), 0, 0, 0
            for cut in cuts:
                while i < len(pairs) and pairs[i][0] < cut:
                    p, n, i = p + pairs[i][1], n + 1 - pairs[i][1], i + 1
                for above, cp, cn in ((False, p, n), (True, p_all - p, n_all - n)):
                    if cp and (g := cp * (math.log2(cp / (cp + cn)) - before)) > gain:
                        best, gain = Condition(f, above, cut), g
        if best is None:
            break
        rule = (*rule, best)
        bad, good = _covered((best,), bad), _covered((best,), good)
    return rule


def _worth(rule: Rule, bad: list[dict], good: list[dict]) -> float:
    p, n = len(_covered(rule, bad)), len(_covered(rule, good))
    return (p - n) / (p + n) if p + n else -1.0


def learn_rules(rows: list[dict], precision: float = 0.9, most_rules: int = 12) -> list[Rule]:
    """Rules that reject, in order.

    ``rows`` hold FEATURES and ``quality`` (1 good, 0 bad). Every third row prunes, the others
    grow. A rule is taken while it covers held-out or growing rows with at least
    ``precision`` bad ones; the rows it covers then leave both sets. No rows, or rows of one
    class, give no rules.
    """
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    rules: list[Rule] = []
    while len(rules) < most_rules:
        gb, gg = [r for r in grow if r["quality"] == 0], [r for r in grow if r["quality"] == 1]
        pb, pg = [r for r in prune if r["quality"] == 0], [r for r in prune if r["quality"] == 1]
        if not gb or not gg:
            break
        rule = _grow(gb, gg)
        while len(rule) > 1 and (shorter := max((rule[:i] for i in range(1, len(rule))), key=lambda x: _worth(x, pb, pg))) and _worth(shorter, pb, pg) >= _worth(rule, pb, pg):
            rule = shorter
        p, n = len(_covered(rule, gb + pb)), len(_covered(rule, gg + pg))
        if not rule or p < max(3, 0.002 * len(rows)) or p < precision * (p + n) or _worth(rule, pb, pg) < 2 * precision - 1:
            break
        rules.append(rule)
        grow = [r for r in grow if not all(c.holds(r) for c in rule)]
        prune = [r for r in prune if not all(c.holds(r) for c in rule)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered CASE expression: the first rule that holds rejects; a row that none covers is kept."""
    out = None
    for rule in rules:
        e = rule[0].column()
        for c in rule[1:]:
            e = e & c.column()
        out = F.when(e, F.lit(False)) if out is None else out.when(e, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 10_000) -> list[dict]:
    """Features of at most ``most`` labelled rows: those whose hashed identifiers are smallest.

    A document whose labels disagree, or that has none of 0 and 1, is left out.
    """
    agreed = (
        labels.filter(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("_max"))
        .filter("quality = _max").drop("_max")
    )
    chosen = smallest_hashed(agreed, "_id", most)
    mine = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    found = with_stats(mine, "_text").select("_id", "quality", *[e.alias(k) for k, e in feature_columns().items()])
    return [r.asDict() for r in sorted(found.collect(), key=lambda r: (r["_id"], *[r[f] for f in FEATURES]))]


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 10_000) -> DataFrame:
    """``docs`` as ``row`` (a struct of all its columns), the statistics, ``base_failed`` and ``kept``.

    A filter on ``kept`` must not be pushed below the statistics: it would evaluate the sorted
    windows anew for each of their elements. A row number, which is never negative, holds it above.
    """
    rules = learn_rules(labelled_rows(docs, labels, id_col, text_col, most))
    out = with_stats(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].alias("_text")), "_text").drop("_text")
    out = out.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules) & (F.monotonically_increasing_id() >= 0))
