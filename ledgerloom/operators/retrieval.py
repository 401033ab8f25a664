"""Nearest chunks, the unit declaration that governs them, and the question context."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom import settings as S
from ledgerloom.functions.documents import excerpt, mentions_scale, unit_scale
from ledgerloom.functions.similarity import cosine, norm
from ledgerloom.operators.skew import top_k
from ledgerloom.session import kept


# Vectors and questions that meet in one task, and entries of the similarities held there at once.
SHARD, ASKED, HELD = 4096, 2048, 1 << 19


def _matrix(vectors: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of the vectors have ``dim`` numbers and no null, these as rows of doubles)."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    whole = pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False).to_numpy(zero_copy_only=False)
    values = lists.filter(pa.array(whole)).flatten()
    rows = values.to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)
    if values.null_count:
        full = values.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dim).all(axis=1)
        at = np.flatnonzero(whole)
        whole[at[~full]] = False
        rows = rows[full]
    return np.flatnonzero(whole), rows


def _similarities(asked: np.ndarray, norms: np.ndarray, rows: np.ndarray, row_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarities, where they are null) of every question to every row, added up in the order of ``cosine``."""
    dots = np.zeros((len(asked), len(rows)))
    columns = np.ascontiguousarray(rows.T)
    for place, column in enumerate(columns):
        dots += asked[:, place, None] * column
    by = norms[:, None] * row_norms
    null = by == 0
    return np.divide(dots, by, out=np.zeros_like(dots), where=~null), null


def _first(similarity: np.ndarray, null: np.ndarray, index: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest similarities, NaN before numbers and null after them, ties by ``index``."""
    value = np.where(null, -np.inf, np.where(np.isnan(similarity), np.inf, similarity))
    if len(value) > k:
        at = np.flatnonzero(value >= np.partition(value, len(value) - k)[len(value) - k])
    else:
        at = np.arange(len(value))
    order = np.lexsort((index[at], -value[at], ~(np.isnan(similarity[at]) & ~null[at]), null[at]))
    return at[order[:k]]


def _nearest_in(k: int):
    """For questions and vectors of a group, the ``k`` nearest vectors of every question."""

    def run(asked: pa.Table, stored: pa.Table) -> pa.Table:
        index = stored["chunk_index"].to_numpy()
        stored_norms = stored["norm"].to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(asked["vector"]), 0).to_numpy(zero_copy_only=False)
        asked_norms = asked["question_norm"].to_numpy(zero_copy_only=False)
        rows, places, found, empty = [], [], [], []
        at_once = max(1, HELD // max(len(index), 1))
        for dim in np.unique(sizes):
            of_dim = np.flatnonzero(sizes == dim)
            known, vectors = _matrix(asked["vector"].take(pa.array(of_dim)), int(dim)) if dim else (np.empty(0, int), None)
            usable, matrix = _matrix(stored["embedding"], int(dim)) if len(known) else (np.empty(0, int), None)
            numbered = dict(zip(of_dim[known].tolist(), range(len(known))))
            for start in range(0, len(of_dim), at_once):
                some = of_dim[start : start + at_once]
                similarity, null = np.zeros((len(some), len(index))), np.ones((len(some), len(index)), bool)
                inside = [i for i, q in enumerate(some.tolist()) if q in numbered]
                if inside and len(usable):
                    those = [numbered[some[i]] for i in inside]
                    cells = np.ix_(inside, usable)
                    similarity[cells], null[cells] = _similarities(vectors[those], asked_norms[some[inside]], matrix, stored_norms[usable])
                for i, q in enumerate(some):
                    best = _first(similarity[i], null[i], index, k)
                    rows.append(np.full(len(best), q))
                    places.append(best)
                    found.append(similarity[i][best])
                    empty.append(null[i][best])
        none = [np.empty(0, int)]
        row, place = pa.array(np.concatenate(rows or none)), pa.array(np.concatenate(places or none))
        asked, stored = asked.select(["question_id", "accession_number"]).take(row), stored.select(["chunk_index", "content"]).take(place)
        values = pa.array(np.concatenate(found or none).astype("f8"), mask=np.concatenate(empty or none).astype(bool))
        return pa.table([*asked.columns, *stored.columns, values], names=["question_id", "accession_number", "chunk_index", "content", "similarity"])

    return run


def nearest(questions: DataFrame, chunks: DataFrame, on: list[str], k: int) -> DataFrame:
    """(question_id, accession_number, chunk_index, content, similarity): the ``k`` nearest of every shard, for each question.

    ``questions`` has question_norm, ``chunks`` has norm. Both meet on ``on``: the vectors
    of a key are dealt to shards and its questions to groups of bounded size, each shard
    meets each group in a task of its own, and only the winners leave it. So no pair is
    a row, and a large filing is worked on by many tasks.
    """
    def parts(rows: DataFrame, size: int, name: str) -> DataFrame:
        return rows.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(name))

    sizes = parts(chunks, SHARD, "shards").join(parts(questions, ASKED, "groups"), on)
    wanted = ["question_id", "accession_number", "vector", "question_norm"]
    asked = questions.join(sizes, on).withColumn("group", F.pmod(F.xxhash64("question_id"), F.col("groups")).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    stored = chunks.join(sizes, on).withColumn("shard", F.pmod(F.xxhash64("chunk_index"), F.col("shards")).cast("int"))
    stored = stored.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    keys = [*on, "shard", "group"]
    both = asked.select(*dict.fromkeys([*keys, *wanted])).groupBy(*keys).cogroup(
        stored.select(*dict.fromkeys([*keys, "chunk_index", "content", "embedding", "norm"])).groupBy(*keys)
    )
    kinds = {**dict(questions.dtypes), **dict(chunks.dtypes), "similarity": "double"}
    names = ["question_id", "accession_number", "chunk_index", "content", "similarity"]
    return both.applyInArrow(_nearest_in(k), ", ".join(f"{name} {kinds[name]}" for name in names))


def match_chunks(questions: DataFrame, chunks: DataFrame, k: int = S.RETRIEVED_CHUNKS, dim: int | None = None) -> DataFrame:
    """The ``k`` nearest chunks of each question within its own filing, exactly.

    With ``dim``, vectors of any other length are left out on both sides.

    ``questions``: (question_id, accession_number, vector); ``chunks``:
    (accession_number, chunk_index, content, embedding). Shards of a filing give their
    nearest for groups of its questions (``nearest``), and the ``k`` first of these remain.
    """
    if dim is not None:
        chunks = chunks.filter(F.size("embedding") == dim)
        questions = questions.filter(F.size("vector") == dim)
    stored = chunks.select("accession_number", "chunk_index", "content", "embedding", norm(F.col("embedding")).alias("norm"))
    asked = questions.select("question_id", "accession_number", "vector", norm(F.col("vector")).alias("question_norm"))
    found = nearest(asked, stored, ["accession_number"], k)
    order = [F.col("similarity").desc_nulls_last(), F.col("chunk_index")]
    return top_k(found, ["question_id", "accession_number"], order, k, spread=["chunk_index"])


# The parameters are a row of their own that meets the chunks on the filing, so that a lateral
# call for many questions is an equi-join as well. It meets shards of chunks, not single ones:
# each gives its first p_k, and only these are ordered with those of the others.
MATCH_CHUNKS_SQL = """
CREATE OR REPLACE TEMPORARY FUNCTION match_chunks(p_accession STRING, p_embedding ARRAY<DOUBLE>, p_k INT)
RETURNS TABLE (chunk_index BIGINT, content STRING, similarity DOUBLE)
RETURN
  SELECT chunk_index, content, similarity
  FROM (
    SELECT -m.best.back AS chunk_index, m.best.content, m.best.similarity, m.k,
           row_number() OVER (ORDER BY m.best.similarity DESC NULLS LAST, m.best.back DESC) AS place
    FROM (
      SELECT s.k, explode(s.best) AS best
      FROM (
        SELECT p.k, transform(nearest_in_row(c.chunks.embedding, c.chunks.norm, c.chunks.chunk_index, p.vector, p.norm, p.k),
                 h -> named_struct('similarity', h.similarity, 'back', -CAST(c.chunks[h.place].chunk_index AS BIGINT),
                                   'content', c.chunks[h.place].content)) AS best
        FROM (SELECT match_chunks.p_accession AS accession, match_chunks.p_embedding AS vector, match_chunks.p_k AS k,
                     sqrt(aggregate(match_chunks.p_embedding, 0D, (t, x) -> t + x * x)) AS norm) p
        JOIN filing_shards f ON f.accession_number = p.accession
        JOIN filing_chunks c ON c.accession_number = f.accession_number AND c.shard = f.shard
      ) s
    ) m
  )
  WHERE place <= k
"""
# Chunks in a row of ``filing_chunks``.
ROW = 1024


def _nearest_in_row(embeddings: pa.Array, norms: pa.Array, indexes: pa.Array, vectors: pa.Array, vector_norms: pa.Array, ks: pa.Array) -> pa.Array:
    """Of the chunks of every row, the places of the first k and their similarity."""
    found = []
    for row in range(len(vectors)):
        index, stored_norms = indexes[row].values.to_numpy(zero_copy_only=False), norms[row].values.to_numpy(zero_copy_only=False)
        similarity, null = np.zeros(len(index)), np.ones(len(index), bool)
        dim = len(vectors[row]) if vectors[row].is_valid else 0
        if dim and not vectors[row].values.null_count:
            usable, matrix = _matrix(embeddings[row].values, dim)
            vector = vectors[row].values.to_numpy(zero_copy_only=False)[None, :]
            cells, empty = _similarities(vector, np.array([vector_norms[row].as_py()]), matrix, stored_norms[usable])
            similarity[usable], null[usable] = cells[0], empty[0]
        best = _first(similarity, null, index, ks[row].as_py())
        found.append([{"place": int(i), "similarity": None if null[i] else float(similarity[i])} for i in best])
    return pa.array(found, pa.list_(pa.struct([("place", pa.int32()), ("similarity", pa.float64())])))


def register_match_chunks(chunks: DataFrame, row: int = ROW) -> None:
    """Register the SQL table function match_chunks(accession, vector, k) over ``chunks``.

    ``FROM questions q, LATERAL match_chunks(q.accession_number, q.vector, 4)`` asks
    many questions at once; equal questions are worked out once. The chunks of a filing
    are dealt to shards of about ``row`` of them, and each is a row.
    """
    shards = chunks.groupBy("accession_number").agg(F.ceil(F.count(F.lit(1)) / F.lit(row)).cast("int").alias("shards"))
    shards.select("accession_number", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")).createOrReplaceTempView("filing_shards")
    dealt = chunks.join(shards, "accession_number").withColumn("shard", F.pmod(F.xxhash64("chunk_index"), F.col("shards")).cast("int"))
    one = F.struct("chunk_index", "content", "embedding", norm(F.col("embedding")).alias("norm"))
    dealt.groupBy("accession_number", "shard").agg(F.collect_list(one).alias("chunks")).createOrReplaceTempView("filing_chunks")
    nearest_in_row = F.arrow_udf(_nearest_in_row, "array<struct<place: int, similarity: double>>")
    chunks.sparkSession.udf.register("nearest_in_row", nearest_in_row)
    chunks.sparkSession.sql(MATCH_CHUNKS_SQL)


# --- search that leaves vectors out by bounds -------------------------------------------

PIVOTS = 8


def _angle(left: Column, right: Column, left_norm: Column, right_norm: Column) -> Column:
    """Null for vectors that have no direction or another length."""
    similarity = cosine(left, right, left_norm, right_norm)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), similarity)))


def vector_pivots(chunks: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """(accession_number, pivots): a few of every filing's vectors with their norms, the same ones on every run."""
    usable = chunks.select("accession_number", "chunk_index", "embedding", norm(F.col("embedding")).alias("norm")).filter("norm > 0")
    first = top_k(usable, ["accession_number"], [F.xxhash64("chunk_index"), F.col("chunk_index")], pivots, spread=["chunk_index"])
    # At most ``pivots`` vectors in a group.
    listed = F.array_sort(F.collect_list(F.struct("rank", "embedding", "norm")))
    return first.groupBy("accession_number").agg(listed.alias("pivots"))


def with_angles(chunks: DataFrame, pivots: DataFrame) -> DataFrame:
    """``chunks`` as they are stored for searches: with norm, angles to the filing's pivots, and block (the nearest pivot).

    The block is null for a vector without direction.
    """
    normed = chunks.withColumn("norm", norm(F.col("embedding"))).join(pivots, "accession_number", "left")
    angles = F.transform("pivots", lambda p: _angle(p["embedding"], F.col("embedding"), p["norm"], F.col("norm")))
    rows = normed.withColumn("angles", F.when(~F.exists(angles, lambda a: a.isNull()), angles)).drop("pivots")
    return rows.withColumn("block", F.array_position("angles", F.array_min("angles")).cast("int"))


def vector_blocks(vectors: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """(accession_number, block, n, low, high): size of every block and the range of its angles to each pivot."""
    ranges = [
        F.array(*[pick(F.get("angles", F.lit(i))) for i in range(pivots)]).alias(name) for name, pick in (("low", F.min), ("high", F.max))
    ]
    return vectors.groupBy("accession_number", "block").agg(F.count(F.lit(1)).alias("n"), *ranges)


def _bound(asked: str, low: Column, high: Column) -> Column:
    """The greatest similarity that angles within ``low`` and ``high`` of the pivots leave possible; 1 if nothing is known."""
    gaps = F.zip_with(F.zip_with(F.col(asked), low, lambda q, l: l - q), F.zip_with(F.col(asked), high, lambda q, h: q - h), lambda x, y: F.greatest(x, y))
    widest = F.coalesce(F.array_max(gaps), F.lit(0.0))
    return F.coalesce(F.cos(F.least(F.greatest(widest, F.lit(0.0)), F.lit(math.pi))), F.lit(1.0))


# Rounding of angles; a block goes only if its bound stays below the k-th similarity by this.
SLACK = 1e-6


def asked_blocks(questions: DataFrame, pivots: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(question_id, accession_number, vector, question_norm, asked, block, bound, first): the blocks of each question's filing.

    ``first`` marks the most promising blocks that hold ``k`` vectors together. A
    filing has a block for each pivot and one for vectors without direction, whose
    bound is 1: the latter come last in any case, so they are only first if nothing else is.
    """
    normed = questions.select("question_id", "accession_number", "vector", norm(F.col("vector")).alias("question_norm"))
    asked = normed.join(pivots, "accession_number", "left")
    angles = F.transform("pivots", lambda p: _angle(p["embedding"], F.col("vector"), p["norm"], F.col("question_norm")))
    asked = asked.withColumn("asked", F.when(~F.exists(angles, lambda a: a.isNull()), angles)).drop("pivots")
    rows = asked.join(blocks, "accession_number").withColumn("bound", _bound("asked", F.col("low"), F.col("high")))
    order = Window.partitionBy("question_id", "accession_number").orderBy(F.col("block").isNull(), F.desc("bound"), "block")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("first", before < k).drop("n", "low", "high")


def match_in_blocks(questions: DataFrame, vectors: DataFrame, pivots: DataFrame, blocks: DataFrame, k: int = S.RETRIEVED_CHUNKS) -> DataFrame:
    """``match_chunks`` over stored vectors (``with_angles``): the same rows, blocks left out where bounds allow it.

    The triangle inequality of angles bounds the similarity of a block by its angles to
    the pivots. The most promising blocks are searched first; of the others only those
    are read whose bound reaches the k-th similarity found. Both searches meet on
    (filing, block), by ``nearest``. A vector's own bound would cost more than its similarity.
    """
    plan = asked_blocks(questions, pivots, blocks, k).withColumn("block", F.coalesce("block", F.lit(0)))
    order = [F.col("similarity").desc_nulls_last(), F.col("chunk_index")]
    keys, on = ["question_id", "accession_number"], ["accession_number", "block"]
    # Blocks are numbered from 1; without a direction it is 0.
    stored = vectors.withColumn("block", F.coalesce(F.col("block").cast("int"), F.lit(0)))
    best = top_k(nearest(plan.filter("first"), stored, on, k), keys, order, k, spread=["chunk_index"]).drop("rank")
    # Fewer than k similarities, or one without a value, bound nothing.
    reached = best.groupBy(*keys).agg(F.min("similarity").alias("least"), F.count("similarity").alias("n")).filter(F.col("n") >= k).drop("n")
    open_blocks = plan.filter(~F.col("first")).join(reached, keys, "left").filter((F.col("bound") >= F.col("least") - SLACK) | F.col("least").isNull())
    more = nearest(open_blocks, stored, on, k)
    return top_k(best.unionByName(more), keys, order, k, spread=["chunk_index"])


# Chunk indexes of a stretch in which declarations are looked up by one task.
STRETCH = 4096


def declarations(chunks: DataFrame) -> DataFrame:
    """(accession_number, chunk_index, scale): the chunks that mention a scale, with what they declare if anything."""
    found = chunks.filter(mentions_scale(F.col("content")))
    return found.select("accession_number", F.col("chunk_index").cast("bigint").alias("chunk_index"), unit_scale(F.col("content")).alias("scale"))


def nearest_scale(anchors: DataFrame, chunks: DataFrame, candidates: int = S.SCALE_CANDIDATES, stretch: int = STRETCH) -> DataFrame:
    """Unit declaration governing each (accession_number, anchor); null when there is none.

    The nearest mentions at or above the anchor are tried first. Only a filing
    without any mention above falls back to its first ones; mentions above that
    declare nothing do not.

    An as-of join: every mention knows what counts from it on, and an anchor takes that
    of the last mention at or above it. A filing is cut into stretches of indexes; the
    last ``candidates`` mentions of a stretch are all that later ones need of it, so they
    are carried over its end as rows, and every stretch is a task's work of its own.
    """
    # The texts are read once; what they declare is short.
    said = kept(declarations(chunks), "declarations").withColumn("s", F.floor(F.col("chunk_index") / stretch))
    at = ["accession_number", "s"]
    inside = Window.partitionBy(*at).orderBy(F.desc("chunk_index"))
    # The ends of stretches: a few rows of each, from which those of the whole filing so far follow.
    ends = said.withColumn("back", F.row_number().over(inside)).filter(F.col("back") <= candidates)
    asked = anchors.select("accession_number", F.floor(F.col("anchor").cast("bigint") / stretch).alias("s")).distinct()
    places = asked.unionByName(said.select(*at).distinct()).distinct()
    whole = Window.partitionBy("accession_number").orderBy("chunk_index")
    item = F.struct("chunk_index", "scale")
    last = F.array(item, *[F.lag(item, n).over(whole) for n in range(1, candidates)])
    carried = ends.withColumn("last", F.filter(last, lambda x: x.isNotNull())).filter("back = 1").select(*at, "last")
    before = Window.partitionBy("accession_number").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    seams = places.join(carried, at, "left").withColumn("past", F.last("last", ignorenulls=True).over(before))
    seams = seams.select(*at, F.explode("past").alias("m")).select(*at, "m.*")
    # What counts from a mention on: of it and the ones before, the nearest that declares something.
    mentions = said.select(*at, "chunk_index", "scale").unionByName(seams)
    order = Window.partitionBy(*at).orderBy("chunk_index")
    counts = F.coalesce("scale", *[F.lag("scale", n).over(order) for n in range(1, candidates)])
    valid = mentions.select(*at, F.col("chunk_index").alias("__at"), F.lit(0).alias("__kind"), F.struct(counts.alias("scale")).alias("__valid"))
    rows = anchors.withColumn("s", F.floor(F.col("anchor").cast("bigint") / stretch)).withColumn("__at", F.col("anchor").cast("bigint"))
    rows = rows.withColumn("__kind", F.lit(1)).unionByName(valid, allowMissingColumns=True)
    so_far = Window.partitionBy(*at).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("__valid", F.last("__valid", ignorenulls=True).over(so_far)).filter("__kind = 1")
    # Without a mention above, the first ones of the filing.
    first = top_k(said.select("accession_number", "chunk_index", "scale"), ["accession_number"], [F.col("chunk_index")], candidates, spread=["chunk_index"])
    first = first.groupBy("accession_number").agg(F.min_by("scale", F.when(F.col("scale").isNotNull(), F.col("rank"))).alias("__first"))
    scale = F.when(F.col("__valid").isNotNull(), F.col("__valid.scale")).otherwise(F.col("__first"))
    return met.join(first, "accession_number", "left").select(*anchors.columns, scale.alias("unit_scale"))


def question_context(questions: DataFrame, matches: DataFrame, scales: DataFrame) -> DataFrame:
    """Prompt text and cited excerpts of each question.

    ``questions``: (question_id, question); ``matches`` from ``match_chunks``;
    ``scales``: (question_id, unit_scale). At most k chunks per question are
    grouped. A question without matches gets no row.
    """
    ranked = F.array_sort(F.collect_list(F.struct("rank", "chunk_index", "content")))
    grouped = matches.groupBy("question_id").agg(ranked.alias("__found"))
    numbered = F.transform(
        "__found", lambda m: F.concat(F.lit("["), m["rank"].cast("string"), F.lit("] "), m["content"])
    )
    sources = F.transform(
        "__found", lambda m: F.struct(m["chunk_index"].alias("chunk_index"), excerpt(m["content"]).alias("excerpt"))
    )
    scale_line = F.coalesce(F.concat(F.lit("Unit scale: "), F.col("unit_scale"), F.lit("\n\n")), F.lit(""))
    context = F.concat(
        F.lit("Question: "), F.col("question"), F.lit("\n\n"), scale_line,
        F.lit("Excerpts from the filing:\n\n"), F.array_join(numbered, "\n\n"),
    )
    joined = questions.join(grouped, "question_id").join(scales, "question_id", "left")
    return joined.select("question_id", context.alias("context"), sources.alias("sources"), "unit_scale")
