"""Secret scans with multipart credential linking.

Sure kinds (assign, access, hex) always count. Weak parts (secret-like words,
identifiers, endpoints) count only when complementary parts stand in their scope:
an interval join of identifiers, secrets and endpoints of one text, by cells of
its length, links the parts of a credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm.common import written

SCOPE = 300

#: Fixed values of the base kinds, in the order they are listed. (pattern, least length of the value)
SURE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    "access": (r"(AKIA[A-Z0-9]{14,})", 18),
    "hex": (r"([0-9a-f]{16,})", 16),
}
WEAK = {
    # Long words of the base64 alphabet with upper case, lower case and a digit.
    "secret": (
        r"(?<![A-Za-z0-9+/=_-])((?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2})(?![A-Za-z0-9+/=_-])",
        20,
    ),
    "identifier": (
        r"""(?i:access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", 3,
    ),
    "endpoint": (r"""((?:https?|s3|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+)""", 8),
}
KINDS = {**SURE, **WEAK}


def _matches(text: Column, pattern: str) -> Column:
    """Lengths of the gaps before matches, of matches and of their values; null without a match."""
    length = lambda part: F.length(part)
    gaps = F.transform(F.split(text, pattern, -1), length)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), length)
    values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), length)
    return F.when(text.rlike(pattern), F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("found"), values.alias("value")))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, kind arrays): the matches of every text, written once; ``row`` tells repeated rows apart."""
    whole = F.coalesce(F.col(text), F.lit(""))
    fields = "array<struct<gap:int,found:int,value:int>>"
    kinds = [_matches(F.col("__text"), pattern).cast(fields).alias(f"__{kind}") for kind, (pattern, _) in KINDS.items()]
    rows = docs.select(F.col(key), whole.alias("__text")).select(key, *kinds)
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "matches")


def parts(scanned: DataFrame) -> DataFrame:
    """(row, kind, number of the kind, start, end) of all matches that are long enough; code points, end exclusive."""
    def tagged(kind: str, number: int) -> Column:
        return F.transform(
            F.coalesce(F.col(f"__{kind}"), F.array()),
            lambda m, i: F.struct(F.lit(kind).alias("kind"), F.lit(number).alias("n"), i.alias("i"), m.alias("m")),
        )

    each = [tagged(kind, number) for number, kind in enumerate(KINDS)]
    rows = scanned.select("row", F.explode(F.concat(*each)).alias("p")).select("row", "p.kind", "p.n", "p.i", "p.m.*")
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("found")).over(upto))
    least = F.create_map(*[F.lit(x) for kind, (_, n) in KINDS.items() for x in (kind, n)])
    rows = rows.filter(F.col("value") >= least[F.col("kind")])
    return rows.select("row", "kind", "n", (F.col("end") - F.col("found")).alias("start"), "end")


def credentials(found: DataFrame, scope: int = SCOPE) -> tuple[DataFrame, DataFrame]:
    """(identifier and secret in one scope, those with an endpoint in the scope of the secret).

    Two parts share a scope when at most ``scope`` code points lie between their
    starts. The join meets on cells of that length, so a part sees only its own and
    the neighbouring cells of the same text.
    """
    cell = F.floor(F.col("start") / scope)
    near = F.explode(F.array(cell - 1, cell, cell + 1))

    def side(kinds: tuple[str, ...], name: str, where: Column) -> DataFrame:
        rows = found.filter(F.col("kind").isin(*kinds))
        return rows.select("row", where.alias("cell"), F.struct("kind", "n", "start", "end").alias(name))

    close = lambda a, b: F.abs(F.col(f"{a}.start") - F.col(f"{b}.start")) <= scope
    identifiers = side(("access", "identifier"), "identifier", near)
    secrets = side(("assign", "hex", "secret"), "secret", cell)
    pairs = secrets.join(identifiers, ["row", "cell"]).filter(close("secret", "identifier")).drop("cell")
    endpoints = side(("endpoint",), "endpoint", near)
    held = pairs.select("row", "secret").distinct().withColumn("cell", F.floor(F.col("secret.start") / scope))
    with_endpoint = held.join(endpoints, ["row", "cell"]).filter(close("secret", "endpoint")).drop("cell")
    return pairs, with_endpoint


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """(key, spans): kind, n (place of the kind in the list), start and end of every reported span, in order.

    Sure spans always stay; a weak part stays if it is part of a credential and does
    not lie in an assignment. Null counts as the empty text; a text without secrets
    has an empty list. Repeated rows are scanned by themselves, an empty table gives
    an empty result, other columns are left out.
    """
    scanned = scan(docs, key, text)
    found = written(parts(scanned), "parts")
    before = Window.partitionBy("row").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = F.max(F.when(F.col("kind") == "assign", F.col("end"))).over(before)
    weak = F.col("kind").isin(*WEAK)
    free = found.withColumn("__taken", taken).filter(~weak | F.col("__taken").isNull() | (F.col("__taken") <= F.col("start")))
    pairs, with_endpoint = credentials(free.drop("__taken"), scope)
    linked = pairs.select("row", F.explode(F.array("secret", "identifier")).alias("s")).unionByName(with_endpoint.select("row", F.col("endpoint").alias("s")))
    sure = found.filter(~weak).select("row", F.struct("kind", "n", "start", "end").alias("s"))
    spans = sure.unionByName(linked.filter(F.col("s.kind").isin(*WEAK)).distinct())
    ordered = F.array_sort(F.collect_list(F.struct("s.start", "s.n", "s.end", "s.kind"))).alias("spans")
    listed = spans.groupBy("row").agg(ordered)
    none = F.array().cast("array<struct<start:bigint,n:int,end:bigint,kind:string>>")
    return scanned.select("row", key).join(listed, "row", "left").select(key, F.coalesce("spans", none).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
