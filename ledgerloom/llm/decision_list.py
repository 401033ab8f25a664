"""Quality rules: a decision list learned from labelled statistics.

Sequential covering: each rule is grown, threshold by threshold, on one part of
the labelled sample, pruned on the other, and kept while it rejects bad documents
with enough precision on both; what it covers is taken out before the next rule.
Candidates are searched on histograms (statistic, bin), which Spark counts in one
job per step and which are as small as statistics times bins. The result is plain
data and turns into an ordered chain of Spark conditions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.common import evaluated, words, written

WINDOW = 8

STATISTICS = (
    "n_words", "mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share",
    "mean_line_words",
)


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.statistic)
        return value >= self.threshold if self.above else value < self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        joined = F.lit(True)
        for condition in self.conditions:
            joined = joined & condition.column()
        return joined


def _joined(found: Column, steps: tuple[int, ...]) -> Column:
    """Hashes of every element together with those ``steps`` after it.

    At the end fewer elements are hashed, which gives values that nothing else has.
    """
    return F.transform(found, lambda h, i: F.xxhash64(h, *[F.get(found, i + step) for step in steps]))


def _covered(found: Column) -> Column:
    """Words inside those windows, given by their hashes, that have an equal one."""
    order = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    at = lambda rows, i: F.get(rows, i)["h"]

    def positions(rows: Column) -> Column:
        again = F.filter(rows, lambda row, i: (row["h"] == at(rows, i - 1)) | (row["h"] == at(rows, i + 1)))
        return F.sort_array(F.transform(again, lambda row: row["i"]))

    def total(places: Column) -> Column:
        each = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(each, F.lit(0), lambda a, b: a + b)

    return _bind(_bind(order, positions), total)


def _with_repeated_words(rows: DataFrame) -> DataFrame:
    """Add n_repeat_words: words inside windows of ``WINDOW`` (8) words found twice or more in the text.

    Fours are hashed first. A repeated window of eight repeats its five fours, so a
    text with fewer repeats than that among all its fours has none; windows are
    hashed for the other texts, and sorted for those with equal ones.
    """
    fours = F.when(F.size("__hashes") > WINDOW, _joined(F.col("__hashes"), (1, 2, 3)))
    rows = evaluated(rows, __fours=fours)
    few = F.size("__fours") - F.size(F.array_distinct("__fours")) < WINDOW // 2 + 1
    rows = evaluated(rows, __few=F.coalesce(few, F.lit(True)))
    rows = evaluated(rows, __eights=F.when(~F.col("__few"), _joined(F.col("__fours"), (4,))))
    rows = evaluated(rows, __single=F.coalesce(F.size(F.array_distinct("__eights")) == F.size("__eights"), F.lit(True)))
    rows = evaluated(rows, n_repeat_words=F.when(F.col("__single"), 0).otherwise(_covered(F.col("__eights"))).cast("bigint"))
    return rows.drop("__fours", "__few", "__eights", "__single")


def _bind(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), lambda bound: use(bound)), F.lit(0))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts and shares of every whole text; a null text counts as empty, shares of nothing are 0."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = evaluated(docs, __whole=whole, __words=words(whole))
    rows = evaluated(rows, __hashes=F.transform("__words", lambda word: F.xxhash64(word)))
    lines = F.filter(F.split("__whole", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("__words").cast("bigint")
    rows = evaluated(
        _with_repeated_words(rows), __lines=lines, n_words=n, word_chars=F.length(F.array_join("__words", "")).cast("bigint"),
        n_symbols=F.regexp_count("__whole", F.lit(r"[#*$%&|<>]")).cast("bigint"),
        __distinct=F.size(F.array_distinct("__hashes")),
        __upper=F.regexp_count("__whole", F.lit(r"\p{Lu}")),
    )
    rows = rows.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"))
    share = lambda part, of: F.when(of > 0, part / of).otherwise(0.0)
    chars, n, n_lines = F.col("word_chars"), F.col("n_words"), F.size("__lines")
    shares = {
        "mean_word_chars": share(chars, n), "symbol_share": share(F.col("n_symbols"), chars),
        "dup_line_share": share(F.col("n_dup_lines"), n_lines), "repeat_share": share(F.col("n_repeat_words"), n),
        "distinct_share": share(F.col("__distinct"), n), "upper_share": share(F.col("__upper"), chars),
        "mean_line_words": share(n, n_lines),
    }
    rows = evaluated(rows, **shares)
    return rows.drop("__whole", "__words", "__hashes", "__lines", "__distinct", "__upper")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """Statistics, ``bad`` and a part (0 grows, 1 prunes) of about ``limit`` labelled documents.

    Labels that are null or contradict each other for a key are left out. Chosen by
    a hash of the key, so the sample is the same in every run.
    """
    clear = labels.filter(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(
        F.min("quality").alias("__low"), F.max("quality").alias("__high")
    ).filter("__low = __high")
    n = clear.count()
    drawn = clear.filter(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(max(n, 1))) < limit).select(key, (F.col("__low") == 0).alias("bad"))
    # About ``limit`` keys: a bound that the parameter states.
    rows = docs.select(key, "text").join(F.broadcast(drawn), key)
    rows = with_statistics(rows).filter(~base_failed())
    part = F.pmod(F.xxhash64(key, F.lit(2)), F.lit(3)) == 2
    return written(rows.select(*STATISTICS, "bad", part.cast("int").alias("part")), "labelled")


def _at_most(value: Column):
    return lambda cut: cut <= value


def _histogram(rows: DataFrame, edges: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """(bad, good) per statistic and bin; bin b holds values from edge b - 1 to below edge b."""
    bins = []
    for name, cuts in edges.items():
        value = F.col(name)
        place = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), _at_most(value)))
        bins.append(F.struct(F.lit(name).alias("statistic"), place.alias("bin")))
    if not bins:
        return {}
    counted = rows.select("bad", F.inline(F.array(*bins))).groupBy("statistic", "bin").agg(
        F.count(F.when(F.col("bad"), 1)).alias("bad"), F.count(F.when(~F.col("bad"), 1)).alias("good")
    )
    found = {name: [(0, 0)] * (len(cuts) + 1) for name, cuts in edges.items()}
    for name, place, bad, good in counted.collect():
        found[name][place] = (bad, good)
    return found


def _edges(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    """Thresholds of every statistic: quantiles of bad and of good documents apart."""
    quantiles = [i / bins for i in range(1, bins)]
    cuts: dict[str, set[float]] = {name: set() for name in STATISTICS}
    for bad in (True, False):
        row = rows.filter(F.col("bad") == bad).agg(*[F.percentile_approx(s, quantiles, 10000).alias(s) for s in STATISTICS]).first()
        for name in STATISTICS:
            cuts[name] |= {float(v) for v in row[name] or [] if v is not None}
    return {name: sorted(values) for name, values in cuts.items() if values}


def _grow(rows: DataFrame, edges: dict, most: int, precision: float) -> tuple[Condition, ...]:
    conditions: tuple[Condition, ...] = ()
    for _ in range(most):
        inside = rows.filter(Rule(conditions).column())
        best, score = None, None
        for name, cells in sorted(_histogram(inside, edges).items()):
            all_bad, all_good = (sum(c[i] for c in cells) for i in (0, 1))
            bad = good = 0
            for cut, (b, g) in zip(edges[name], cells):
                bad, good = bad + b, good + g
                for above, p, q in ((False, bad, good), (True, all_bad - bad, all_good - good)):
                    # Laplace precision first, then coverage.
                    value = (round((p + 1) / (p + q + 2), 6) * (p > 0), p)
                    if score is None or value > score:
                        best, score, pure = Condition(name, above, cut), value, p / max(p + q, 1)
        if best is None or best in conditions:
            break
        conditions += (best,)
        if pure >= precision:
            break
    return conditions


def _worth(rows: DataFrame, rule: Rule) -> tuple[int, int]:
    covered = rows.filter(rule.column()).agg(F.count(F.when(F.col("bad"), 1)), F.count(F.when(~F.col("bad"), 1))).first()
    return covered[0], covered[1]


def learn(sample: DataFrame, max_rules: int = 8, max_conditions: int = 3, bins: int = 24, precision: float = 0.97, least: int = 3) -> list[Rule]:
    """An ordered list of rules that reject; empty when there are no labels of both kinds.

    A rule stays if, on the part it was not grown on, at least ``precision`` of what
    it covers is bad and it covers ``least`` bad documents in the whole sample.
    """
    rules: list[Rule] = []
    left = sample
    for _ in range(max_rules):
        growing, pruning = left.filter("part = 0"), left.filter("part = 1")
        if not growing.filter("bad").count():
            break
        conditions = _grow(growing, _edges(growing, bins), max_conditions, precision)
        # Reduced-error pruning: the shortest beginning that separates the held-out part best.
        options = [Rule(conditions[:k]) for k in range(1, len(conditions) + 1)]
        worth = [_worth(pruning, rule) for rule in options]
        scores = [(p - q) / (p + q) if p + q else -1.0 for p, q in worth]
        if not options:
            break
        k = max(range(len(options)), key=lambda i: (scores[i], -i))
        rule, (bad, good) = options[k], worth[k]
        more_bad, more_good = _worth(growing, rule)
        if bad + more_bad < least or bad < precision * (bad + good) or more_bad < precision * (more_bad + more_good):
            break
        rules.append(rule)
        left = left.filter(~rule.column())
    return rules


def rejected_by(rules: list[Rule]) -> Column:
    """Number (from 1) of the first rule that covers the row; null if none does."""
    chain = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, start=1))):
        chain = F.when(rule.column(), number).otherwise(chain)
    return chain


def judge(docs: DataFrame, labels: DataFrame, sample_limit: int = 12_000) -> DataFrame:
    """``docs`` with all statistics, base_failed, rule and kept.

    The list is learned from about ``sample_limit`` labelled documents and applied to
    all of them without a shuffle. A null or empty text has no words and fails the
    base. Repeated rows get equal verdicts; without labels only the base decides.
    Columns of the input that carry the name of a result are replaced.
    """
    results = {*STATISTICS, "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept"}
    docs = docs.drop(*[c for c in docs.columns if c in results])
    rules = learn(labelled_sample(docs, labels, sample_limit))
    judged = with_statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", rejected_by(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
