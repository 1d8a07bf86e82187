"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sources share all words by weight; a source's target stops at MOST_REPEATS times its words, and the excess is shared again by
weight until no target is above that.  A source's words are cut into blocks (runs of at most BLOCK_WORDS words of one
document) which a keyed permutation puts in order.  A target of e times the source and some words takes every block e
times and then blocks from the head of the permutation, the last one in part, so taken words equal the rounded target.

The exact block quotas of all sources are split among output shards by a tree: at each node the left half's
quota vector is one draw of a multivariate hypergeometric distribution, seeded by the node, so that each shard gets a
random mix while no block is lost or drawn twice.  Every use that a block could have is a candidate; its rank in its source's
permutation says which leaf draws it, or that none does, and what the leaves draw is the mix.  Every task finds its
candidates' leaves by walking the tree.  Inside a shard blocks are shuffled by a keyed hash.

Ranks come from sums by bucket of the permutation and a running sum inside each bucket, so a source with a third of all
rows is no single task's work.  The number of sources must fit the driver: a target needs all their sizes.

Defined results: a null text has size 0; a null source is a source of its own, after all others; a document of size 0 is
never taken; rows that agree in doc_id, source and text are one document, counted, mixed and returned once (the first of them
in their other columns' order); an empty table gives an empty result; the result depends on the rows and the seed alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.columns import pick, positional, text_of
from lexspark.llm.exact_dedup import content_hash
from lexspark.llm.storage import Scratch

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 4096
SHARD_WORDS = 1 << 24
SEED = 20_240_601
WORD = r"[^\x20\x09-\x0D]+"
#: Blocks of one bucket of a permutation, about; population from which on numpy does not draw; rows of sources that are broadcast.
BUCKET_BLOCKS, MOST_DRAWN, MOST_SOURCES = 4096, 10**9, 100_000


def _mark(doc_id: Column, text: Column) -> Column:
    """What tells documents of one doc_id, source and size apart: a hash of the text, longer where there is no doc_id."""
    return F.when(doc_id.isNull(), content_hash(text)).otherwise(F.unhex(F.hex(F.xxhash64(text))))


def _size(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, mark, copies): the number of words of each document, and of rows that are this document."""
    found = pick(docs, "doc_id", "source", "text").select("doc_id", "source", _size(text_of()).alias("size"), _mark(F.col("doc_id"), text_of()).alias("mark"))
    return found.groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("copies"))


def targets(totals: list[tuple[str | None, int]]) -> list[tuple[str | None, int, float]]:
    """(source, words, target) in order of code points, null last."""
    order = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(order))]
    goal: dict[int, float] = {}
    left, open_ = float(sum(n for _, n in order)), list(range(len(order)))
    while open_:
        share = left / sum(weights[i] for i in open_)
        above = [i for i in open_ if share * weights[i] > MOST_REPEATS * order[i][1]]
        if not above:
            goal |= {i: share * weights[i] for i in open_}
            break
        for i in above:
            goal[i] = float(MOST_REPEATS * order[i][1])
            left -= goal[i]
        open_ = [i for i in open_ if i not in goal]
    return [(s, n, goal[i]) for i, (s, n) in enumerate(order)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, size: int) -> int:
    """How many of size draws without replacement are good, for populations of any size.

    Inversion over the values within 12 standard deviations of the mode, from the ratios of neighbouring probabilities.
    """
    low, high = max(0, size - bad), min(good, size)
    total = good + bad
    if low == high:
        return low
    mode = min(high, max(low, (size + 1) * (good + 1) // (total + 2)))
    wide = 10 + int(12 * math.sqrt(size * (good / total) * (bad / total) * ((total - size) / max(1, total - 1))))
    low, high = max(low, mode - wide), min(high, mode + wide)
    x = np.arange(low, high, dtype=np.float64)
    log = np.append(0.0, np.cumsum(np.log(good - x) + np.log(size - x) - np.log(x + 1) - np.log(bad - size + x + 1)))
    upto = np.cumsum(np.exp(log - log.max()))
    return low + int(np.searchsorted(upto, rng.random() * upto[-1], "right"))


def _draw(quotas: np.ndarray, size: int, node: tuple[int, ...]) -> np.ndarray:
    """The left part, of this size in all, of the quotas: one source after another, given what is left."""
    total, rng = int(quotas.sum()), np.random.default_rng([SEED, *node])
    if total < MOST_DRAWN:
        return rng.multivariate_hypergeometric(quotas, size)
    out = np.zeros(len(quotas), np.int64)
    for i, q in enumerate(quotas.tolist()):
        total -= q
        out[i] = hypergeometric(rng, q, total, size)
        size -= int(out[i])
    return out


#: Draws that this process has made, by node and what was drawn from, and the bytes that they take; all tasks draw the same.
_DRAWN: dict[tuple, np.ndarray] = {}
_HELD, MOST_HELD = [0], 64 << 20


def _left_part(quotas: np.ndarray, size: int, node: tuple[int, ...]) -> np.ndarray:
    """The draw of a node, made once in each process as far as MOST_HELD bytes reach."""
    key = (SEED, node, size, quotas.tobytes())
    if key not in _DRAWN:
        if _HELD[0] > MOST_HELD:
            _DRAWN.clear()
            _HELD[0] = 0
        _DRAWN[key] = _draw(quotas, size, node)
        _HELD[0] += 2 * quotas.nbytes + 400
    return _DRAWN[key]


def leaves(source: np.ndarray, rank: np.ndarray, quotas: np.ndarray, shards: int) -> np.ndarray:
    """The shard that draws each block, from its source's index and its rank among the source's blocks; -1: none does."""
    total, out = int(quotas.sum()), np.full(len(source), -1, np.int64)
    edge = lambda j: j * total // shards
    inside = np.flatnonzero(rank < quotas[source])
    todo = [(0, shards, quotas.astype(np.int64), inside, rank[inside].astype(np.int64))]
    while todo:
        lo, hi, quota, rows, ranks = todo.pop()
        if not len(rows):
            continue
        if hi - lo == 1:
            out[rows] = lo
            continue
        mid = (lo + hi) // 2
        left = _left_part(quota, edge(mid) - edge(lo), (lo, hi))
        goes = ranks < left[source[rows]]
        todo.append((lo, mid, left, rows[goes], ranks[goes]))
        todo.append((mid, hi, quota - left, rows[~goes], ranks[~goes] - left[source[rows[~goes]]]))
    return out


def _few(table: DataFrame, rows: int) -> DataFrame:
    """The table, to be broadcast if it is known to be small."""
    return F.broadcast(table) if rows <= MOST_SOURCES else table


def mix_plan(sized: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The plan (doc_id, source, size, mark, block, epoch, words, shard, place) and (source, source_size, target).

    A row of the plan is one drawn block: its first ``words`` words, in its ``epoch``-th use; ``place`` orders a shard.
    """
    spark = sized.sparkSession
    goals = targets([(r["source"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").cast("bigint").alias("n")).collect()])
    schema = "source string, s int, source_size bigint, target double, epochs bigint, rest bigint"
    rows = [(s, i, n, t, round(t) // n if n else 0, round(t) % n if n else 0) for i, (s, n, t) in enumerate(goals)]
    table = spark.createDataFrame(rows, schema)
    n_blocks = max(1, sum(n for _, n, _ in goals) // BLOCK_WORDS + sized.count())
    bits = max(0, math.ceil(math.log2(n_blocks / BUCKET_BLOCKS)))
    cut = F.sequence(F.lit(0), F.floor((F.col("size") - 1) / BLOCK_WORDS).cast("int"))
    blocks = sized.filter("size > 0").select("doc_id", "source", "size", "mark", F.explode(cut).alias("block"))
    words = F.least(F.lit(BLOCK_WORDS), F.col("size") - F.col("block") * BLOCK_WORDS).cast("bigint")
    key = F.xxhash64(F.lit(SEED), "doc_id", "block", "size", "mark")  # a null mark changes nothing
    keyed = blocks.withColumn("words", words).withColumn("key", key).withColumn("bucket", F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("bigint"))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("words").alias("w"), F.count("*").alias("c"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("src"), F.col("bucket").alias("bkt"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "block", "mark")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = keyed.withColumn("w1", F.sum("words").over(upto) - F.col("words")).withColumn("r1", F.row_number().over(inside) - 1)
    placed = ranked.join(offsets, F.col("source").eqNullSafe(F.col("src")) & (F.col("bucket") == F.col("bkt"))).join(_few(table, len(rows)).withColumnRenamed("source", "src2"), F.col("source").eqNullSafe(F.col("src2")))
    left = F.col("rest") - F.col("w0") - F.col("w1")
    ordered = scratch.save(placed.select("doc_id", "source", "size", "mark", "block", "words", "s", "epochs", (F.col("c0") + F.col("r1")).alias("rank"), left.alias("left")), "blocks")
    counts = {r["s"]: (r["n"], r["p"]) for r in ordered.groupBy("s").agg(F.count("*").alias("n"), F.sum((F.col("left") > 0).cast("bigint")).alias("p")).collect()}
    full = np.array([counts.get(i, (0, 0))[0] for i in range(len(rows))], np.int64)
    quotas = np.array([rows[i][4] * counts.get(i, (0, 0))[0] + counts.get(i, (0, 0))[1] for i in range(len(rows))], np.int64)
    taken_words = sum(round(t) for _, n, t in goals if n)
    shards = max(1, math.ceil(taken_words / SHARD_WORDS))
    # The block that the target ends in is used in part the last time.
    ends_here = (F.col("epoch") == F.col("epochs")) & (F.col("left") > 0) & (F.col("left") < F.col("words"))
    candidates = ordered.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("epochs"))))
    uses = candidates.select("doc_id", "source", "size", "mark", "block", F.when(ends_here, F.col("left")).otherwise(F.col("words")).alias("words"), "s", "rank", "epoch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, rank, epoch = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("s", "rank", "epoch"))
            shard = leaves(s, epoch * full[s] + rank, quotas, shards)
            yield batch.append_column("shard", pa.array(shard)).drop_columns(["s", "rank"]).filter(pa.array(shard >= 0))

    kept = "doc_id bigint, source string, size bigint, mark binary, block int, words bigint, epoch bigint, shard bigint"
    plan = uses.mapInArrow(run, kept).withColumn("place", F.xxhash64(F.lit(SEED + 1), "shard", "doc_id", "block", "epoch", "mark"))
    return plan, _few(table.select("source", "source_size", "target"), len(rows))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, n_shards) for every document."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.save(sizes(docs), "sizes")
    plan, goals = mix_plan(sized, scratch)
    taken = plan.groupBy(F.col("doc_id").alias("d"), F.col("source").alias("src"), F.col("size").alias("n"), F.col("mark").alias("m")).agg(F.sum("words").alias("taken"), F.count_distinct("shard").alias("n_shards"))
    all_ = sized.join(goals.withColumnRenamed("source", "src2"), F.col("source").eqNullSafe(F.col("src2")))
    both = all_.join(taken, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("src")) & (F.col("size") == F.col("n")) & F.col("mark").eqNullSafe(F.col("m")), "left")
    return both.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), F.coalesce("n_shards", F.lit(0)).alias("n_shards"))


def _cut(text: str, blocks: list, size: int) -> str:
    """The words of these blocks, with the white space between them as it was."""
    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    parts: list[list[int]] = []
    for block, words in sorted(blocks):
        begin, end = block * size, block * size + words
        if parts and parts[-1][1] == begin:
            parts[-1][1] = end
        else:
            parts.append([begin, end])
    return "\n".join(text[spans[b][0] : spans[e - 1][1]] for b, e in parts)


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix as rows of documents, shard by shard and shuffled inside: one row for each use of a document in a shard, with the
    words that fall there alone where it is cut."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.save(sizes(docs), "sizes")
    plan, _ = mix_plan(sized, scratch)
    key = ["d", "s", "n", "m"]
    uses = plan.groupBy(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("n"), F.col("mark").alias("m"), "epoch", "shard").agg(F.min("place").alias("place"), F.sum("words").alias("taken"), F.collect_list(F.struct("block", "words")).alias("blocks"))
    rows, (doc_id, source, text) = positional(docs, "doc_id", "source", "text")
    whole = F.coalesce(F.col(text), F.lit(""))
    marked = rows.withColumn("size", _size(whole)).withColumn("mark", _mark(F.col(doc_id), whole))
    same = F.col(doc_id).eqNullSafe(F.col("d")) & F.col(source).eqNullSafe(F.col("s")) & (F.col("size") == F.col("n")) & (F.col("mark") == F.col("m"))
    repeated = sized.filter("copies > 1").select(*[F.col(c).alias(k) for c, k in zip(("doc_id", "source", "size", "mark"), key, strict=True)])
    if not repeated.isEmpty():  # one row of each document, the first by its other columns
        rest = F.min(F.struct(*[F.col(c) for c in rows.columns])).alias("row")
        once = marked.join(repeated, same, "left_semi").groupBy(doc_id, source, "size", "mark").agg(rest)
        marked = marked.join(repeated, same, "left_anti").unionByName(once.select("row.*", "size", "mark"))
    block_words = BLOCK_WORDS
    cut = F.pandas_udf(lambda t, b: t.combine(b, lambda x, y: _cut(x, [(int(r["block"]), int(r["words"])) for r in y], block_words) if isinstance(x, str) else None), "string")
    laid = marked.join(uses, same).repartitionByRange("shard", "place", "epoch").sortWithinPartitions("shard", "place", "epoch")
    # Python sees the texts that are cut alone.
    part = F.col("taken") < F.col("n")
    out = laid.withColumn(text, F.when(part, cut(F.when(part, F.col(text)), F.when(part, F.col("blocks")))).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        count = f"c{docs.columns.index('n_chars')}"
        out = out.withColumn(count, F.when(part, F.length(text).cast(rows.schema[count].dataType)).otherwise(F.col(count)))
    return out.select(*rows.columns).toDF(*docs.columns)
