"""Mixing sources to target weights by entropy balancing.

Each document gets a rate between 0 and ``cap`` copies. Among all rates whose
tokens meet the targets of the sources, those nearest to the neutral rate
``cap / 2`` in the entropy of a bounded rate are ``cap / (1 + exp(-tilt * size))``:
an exponential tilt of the odds, with one tilt per source. The tilts solve the
convex dual, whose Hessian is diagonal over sources, by Newton steps that stay in
a bracket. Documents of one source and size share a rate, so the steps run on the
table of (source, size, number of documents), and the rates are rounded there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm.common import global_rank, written

# Documents of one source and size are numbered in groups of about so many.
GROUP = 4096
# Rates in whole millionths: their sums are exact, so reruns agree.
RATE = 10**6


def size_table(docs: DataFrame) -> DataFrame:
    """(source, size, bucket, n): one row for about ``GROUP`` documents or fewer of one source and size."""
    counts = docs.groupBy("source", "size").agg(F.count("*").alias("total"))
    return counts.withColumn("buckets", F.ceil(F.col("total") / GROUP))


def share_targets(sizes: DataFrame, weights: tuple[float, ...], factor: float, cap: float) -> DataFrame:
    """(source, source_size, target): ``factor`` times all sizes shared by weight, at most ``cap`` times a source.

    Sources in code point order, null last, get ``weights`` in turn. What the cap
    takes from a source is shared again by weight until no source is above it.
    """
    per_source = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("total")).alias("source_size"))
    ranked = global_rank(per_source, [F.asc_nulls_last("source")])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = written(ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap))), "sources")
    left = factor * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, closed = 0.0, -1
    while True:
        full = (F.col("most") <= F.col("weight") * F.lit(level)) if closed >= 0 else F.lit(False)
        taken, open_weight, n = sources.agg(
            F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
            F.count(F.when(full, 1)),
        ).first()
        if n == closed or not open_weight:
            break
        closed, level = n, (left - taken) / open_weight
    target = F.least("most", F.col("weight") * F.lit(level)) if open_weight else F.col("most")
    return sources.select("source", "source_size", target.alias("target"))


def solve_tilts(sizes: DataFrame, targets: DataFrame, cap: float, steps: int = 60, tolerance: float = 1e-5) -> DataFrame:
    """(source, tilt): the root of sum(n * size * cap / (1 + exp(-tilt * size))) = target of every source.

    ``tilt`` is null where the target leaves no freedom (nothing, or all of ``cap``).
    Sums are exact decimals, so reruns agree whatever the order of rows.
    """
    scale = F.col("source_size") / F.col("documents")
    counted = sizes.filter("size > 0").groupBy("source").agg(
        F.sum("total").alias("documents"), F.min("size").alias("smallest"),
        (F.sum((F.col("size") * F.col("size") * F.col("total")).cast("double")) / F.sum(F.col("size") * F.col("total"))).alias("typical"),
    )
    share = F.try_divide("target", F.col("source_size") * cap)
    state = _join(targets, counted).filter((share > 0) & (share < 1)).select(
        "source", "target", scale.alias("scale"),
        # At the bracket's ends even the smallest document is on the right side of the target.
        (-F.abs(F.log(share / (1 - share))) / F.col("smallest") * scale - 1e-9).alias("low"),
        (F.abs(F.log(share / (1 - share))) / F.col("smallest") * scale + 1e-9).alias("high"),
        # A first guess: the tilt that would do if every token sat in a document of the size typical for tokens.
        F.round(F.log(share / (1 - share)) / F.col("typical") * scale, 6).alias("tilt"), F.lit(False).alias("done"),
    )
    state = written(state, "tilts")
    for _ in range(steps):
        if state.filter("not done").isEmpty():
            break
        x = F.col("size") / F.col("scale")
        p = 1 / (1 + F.exp(-F.col("tilt") * x))
        exact = lambda value: F.sum(value.cast("decimal(38, 9)"))
        sums = _join(sizes, state.filter("not done")).groupBy("source").agg(
            exact(F.col("total") * F.col("size") * cap * p).cast("double").alias("tokens"),
            exact(F.col("total") * F.col("size") * cap * p * (1 - p) * x).cast("double").alias("slope"),
        )
        gap = F.col("tokens") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (step > F.col("new_low")) & (step < F.col("new_high"))
        moved = _join(state.filter("not done"), sums).withColumn("new_low", low).withColumn("new_high", high)
        near = F.abs(gap) <= tolerance * F.col("target")
        moved = moved.select(
            "source", "target", "scale", F.col("new_low").alias("low"), F.col("new_high").alias("high"),
            F.when(near, F.col("tilt")).when(inside, step).otherwise((F.col("new_low") + F.col("new_high")) / 2).alias("tilt"),
            near.alias("done"),
        )
        state = written(state.filter("done").unionByName(moved), "tilts")
    return state.select("source", (F.col("tilt") / F.col("scale")).alias("tilt"))


def _join(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Join on source (and other keys) where null equals null; the left side's keys stay."""
    names = ("source", *keys)
    renamed = right.select(*[F.col(c).alias(f"__{c}" if c in names else c) for c in right.columns])
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(name).eqNullSafe(F.col(f"__{name}"))
    return left.join(renamed, condition, how).drop(*[f"__{name}" for name in names])


def round_copies(sizes: DataFrame, targets: DataFrame, tilts: DataFrame, cap: int, corrections: int = 8) -> DataFrame:
    """(source, size, total, buckets, copies): whole copies for all documents of a source and size together.

    Rates add up in order of size and a copy is due whenever the sum passes a whole
    number, which keeps a source within its largest document of the target. Then
    the largest size that fits the rest gets a copy more (or less), again and again.
    """
    rated = _join(_join(sizes, targets), tilts, how="left")
    share = F.try_divide("target", "source_size")
    rate = F.when(F.col("tilt").isNotNull(), cap / (1 + F.exp(-F.col("tilt") * F.col("size")))).otherwise(F.coalesce(share, F.lit(0.0)))
    rated = rated.withColumn("due", F.round(rate * RATE).cast("bigint") * F.col("total"))
    upto = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rated = rated.withColumn("sum", F.sum("due").over(upto))
    copies = F.expr(f"(sum + {RATE // 2}) div {RATE} - (sum - due + {RATE // 2}) div {RATE}")
    rounded = rated.select("source", "size", "total", "buckets", "target", F.least(copies, F.col("total") * cap).alias("copies"))
    rounded = written(rounded, "copies")
    for _ in range(corrections):
        rest = rounded.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("rest"))
        gaps = _join(rounded.filter("size > 0"), rest)
        free = F.when(F.col("rest") > 0, F.col("copies") < F.col("total") * cap).otherwise(F.col("copies") > 0)
        # Half a document beyond the rest is still nearer to the target than leaving it.
        fits = free & (F.col("size") < 2 * F.abs("rest"))
        best = gaps.filter(fits).groupBy("source").agg(
            F.max_by("size", F.struct(-F.abs(F.abs("rest") - F.col("size")), F.col("size"))).alias("size"),
            F.first(F.signum("rest")).cast("bigint").alias("change"),
        )
        best = written(best, "corrections")
        if best.isEmpty():
            break
        changed = _join(rounded, best, "size", how="left")
        rounded = written(changed.withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("change"), "copies")
    return rounded.drop("target")


def mix(docs: DataFrame, size: Column, weights: tuple[float, ...] = (3, 1, 2), factor: float = 1.5, cap: int = 2, key: str = "doc_id") -> DataFrame:
    """Documents with size, source_size, target and ``copies`` (0 to ``cap``).

    ``weights`` go to the sources in code point order, null last, in turn; the mix
    has ``factor`` times all tokens. Nulls: a null text has size 0, a null source is
    a source. Documents without tokens keep the neutral rate and take nothing.
    Repeated rows are documents of their own; equal keys are told apart by their
    order alone, which does not change how many copies they get together. An empty
    table gives an empty result. Other columns pass through unless they carry the
    names of the results or begin with ``__``.
    """
    results = ["size", "source_size", "target", "copies"]
    kept = docs.drop(*[c for c in results if c in docs.columns])
    sized = kept.withColumn("size", size)
    sizes = written(size_table(sized), "sizes")
    targets = written(share_targets(sizes, weights, factor, cap), "targets")
    tilts = solve_tilts(sizes, targets, cap)
    copies = _join(round_copies(sizes, targets, tilts, cap), targets)
    deal = copies.select("source", "size", "buckets", "total", F.col("copies").alias("__copies"), "source_size", "target")
    rows = _join(sized, deal.withColumnRenamed("total", "__total"), "size")
    # Every group of about GROUP documents gets its part of the copies, by what the groups before it got.
    rows = rows.withColumn("__group", F.pmod(F.xxhash64(key), F.col("buckets")))
    group = Window.partitionBy("source", "size", "__group")
    members = rows.groupBy("source", "size", "__group").agg(
        F.count("*").alias("__n"), F.first("__copies").alias("__copies"), F.first("__total").alias("__total")
    )
    before = Window.partitionBy("source", "size").orderBy("__group").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    members = members.withColumn("__upto", F.sum("__n").over(before))
    part = F.expr("__upto * __copies div __total - (__upto - __n) * __copies div __total")
    members = members.withColumn("__part", part)
    members = members.select("source", "size", "__group", F.col("__n"), "__part")
    dealt = _join(rows.drop("__copies", "__total", "buckets"), members, "size", "__group")
    dealt = dealt.withColumn("__rank", F.row_number().over(group.orderBy(F.xxhash64(key), F.col(key))))
    each = F.expr("__part div __n")
    extra = (F.col("__rank") <= F.col("__part") - each * F.col("__n")).cast("bigint")
    return dealt.withColumn("copies", (each + extra).cast("bigint")).drop("__group", "__n", "__part", "__rank")
