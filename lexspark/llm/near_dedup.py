"""MinHash near-dedup by an inverted join over signature coordinates.

A document's set is its distinct shingles of five words (of all words, if fewer), lower-cased.  Equal sets are one class,
found by a 128-bit digest.  Each class gets a signature of SIGNATURE min-hashes; a pair at the similarity bound agrees
in about three quarters of them, and pairs that agree in at least AGREE are candidates (a pair at the bound has fewer
with a chance of 2 * 10**-5).

Candidates come from an inverted join: classes are posted under the first COORDINATES coordinate-value pairs.  Values
that one class alone has are skipped; a class with fewer than MATCHES others is skipped whole; the rest are posted under a
prefix only, the rarest ``n - MATCHES + 1`` of their n values in one global order, as two classes with MATCHES common values
meet in their prefixes (a pair at the bound has fewer common ones with a chance of 1.5 * 10**-6).

Links are only needed as far as they connect, so two steps avoid all pairs of a group of near copies.  In a few rounds,
every class counts its collisions with the hubs of its lists and is compared with the one it meets most, in another component;
then all pairs of a list that are still in different components are compared by signature, so that no link between
components is lost.  Candidates are confirmed on full sets: a hub's text meets its partners' texts in salted groups that
stream through a task.  Members of long lists are dealt out as pairs of blocks, with their texts, and confirmed where
they meet, as pairs of a group of near copies that differ from each other just too much would else be many rows.

Defined results: texts without words or null have an empty set and link with nothing; ties in every order are broken by
value and id; every row is judged by its own text, so rows of one doc_id with different texts can be in different
components; a component is named by its smallest doc_id (null if it has none), and kept are the rows of the smallest
(doc_id, hash of text) in it, null doc_ids last; repeated rows each get a row; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.columns import pick, positional, text_of
from lexspark.llm.components import components
from lexspark.llm.exact_dedup import content_hash
from lexspark.llm.storage import Scratch
from lexspark.llm.words import U64, Sequences, Words, give_back, list_array, mix, slices

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
COORDINATES, MATCHES = 32, 12
#: Coordinates of the whole signature and how many a candidate pair agrees in; the first COORDINATES are posted.
SIGNATURE, AGREE = 96, 54
HUB_ROUNDS = 2
#: Members of a posting list up to which it is short; members and bytes of text of a block; partners of a hub in one group.
SHORT, BLOCK, BLOCK_BYTES, PARTNERS = 64, 1024, 1 << 22, 256

_SEEDS = mix(np.arange(1, SIGNATURE + 1, dtype=U64) * U64(0xD1B54A32D192ED03)) | U64(1)


def shingle_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts (repeats included), and the number for each text."""
    size = np.diff(words.first)
    per = np.where(size >= SHINGLE, size - SHINGLE + 1, np.minimum(size, 1))
    text = np.repeat(np.arange(len(size)), per)
    at = words.first[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    length = np.minimum(size, SHINGLE)[text]
    return Sequences(words.hashes()).at(at, length), per


def _sets(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    hashes, per = shingle_hashes(Words(data, bounds, lower=True))
    return [np.unique(x) for x in np.split(hashes, np.cumsum(per)[:-1])]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, digest, signature): signature is null for an empty set; text_key: the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                hashes, per = shingle_hashes(Words(data, bounds, lower=True))
                full = np.flatnonzero(per)
                begin = (np.cumsum(per) - per)[full]
                least = np.empty((len(full), SIGNATURE), np.int32)
                for k, seed in enumerate(_SEEDS if len(full) else []):
                    least[:, k] = (np.minimum.reduceat((hashes ^ (hashes >> U64(29))) * seed, begin) >> U64(32)).astype(np.uint32).view(np.int32)
                count, digest = np.zeros(len(per), np.int64), [b""] * len(per)
                for d, b in zip(full.tolist(), begin.tolist(), strict=True):
                    own = np.unique(hashes[b : b + per[d]])
                    count[d] = len(own)
                    digest[d] = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(count), pa.array(digest, pa.binary()), list_array(least.ravel(), np.where(per > 0, SIGNATURE, 0))], names=["doc_id", "text_key", "n_shingles", "digest", "signature"])
        give_back()

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", content_hash(text_of()).alias("text_key")).mapInArrow(run, "doc_id bigint, text_key binary, n_shingles bigint, digest binary, signature array<int>")


def postings(classes: DataFrame) -> DataFrame:
    """(list, id): classes under the rarest of their coordinate-value pairs."""
    posted = F.slice("signature", 1, COORDINATES)
    pairs = classes.select("id", F.posexplode(posted).alias("k", "v")).select("id", (F.col("k").cast("bigint") * F.lit(1 << 32) + F.col("v")).alias("list"))
    df = pairs.groupBy("list").agg(F.count("*").alias("df")).filter("df > 1")
    common = pairs.join(df, "list").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "list"))).alias("all")).filter(F.size("all") >= MATCHES)
    return common.select("id", F.explode(F.slice("all", F.lit(1), F.size("all") - (MATCHES - 1))).alias("p")).select(F.col("p.list").alias("list"), "id")


def _agree(a: str, b: str):
    """Whether two signatures agree in AGREE coordinates."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same >= AGREE


def _at(posted: DataFrame, component: DataFrame) -> DataFrame:
    return posted.join(component, "id", "left").select("list", "id", F.coalesce("component", "id").alias("c"))


def _hub_pairs(posted: DataFrame, signed: DataFrame, component: DataFrame, turn: int) -> DataFrame:
    """(a, b): each class b with one hub, that of another component which it meets in most lists, if they agree."""
    order = F.xxhash64(F.lit(turn), "id") if turn else F.col("id")
    at = _at(posted, component)
    hubs = at.groupBy("list").agg(F.min_by("id", order).alias("a"), F.min_by("c", order).alias("ca"), F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1").select("list", "a", "ca")
    met = at.join(hubs, "list").filter("c <> ca").groupBy("id", "a").agg(F.count("*").alias("n"))
    best = met.groupBy("id").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), F.col("id").alias("b"))
    with_b = best.join(signed.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")
    return with_b.join(signed.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a").filter(_agree("sa", "sb")).select("a", "b")


def _mixed(posted: DataFrame, texts: DataFrame, component: DataFrame) -> DataFrame:
    """(list, id, c, n, blocks): lists of classes in more than one component; n members go to so many blocks."""
    at = _at(posted, component).join(texts.select("id", "bytes"), "id")
    sized = at.groupBy("list").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n"), F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES)).alias("blocks"))
    return at.drop("bytes").join(sized.filter("c0 <> c1").select("list", "n", F.greatest("blocks", F.lit(1)).alias("blocks")), "list")


def _short_pairs(mixed: DataFrame, signed: DataFrame) -> DataFrame:
    """(a, b): pairs of a short list in different components that agree, fewer than SHORT / 2 for each posting."""
    keyed = mixed.filter(F.col("n") <= SHORT).join(signed, "id").select("list", "id", "c", "signature").repartition("list").sortWithinPartitions("list", "id")

    def pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists, ids, comp = (batch.column(i).to_numpy() for i in range(3))
        sig, found = batch.column(3).flatten().to_numpy().reshape(-1, SIGNATURE), [np.zeros((2, 0), np.int64)]
        for apart in range(1, SHORT):  # every row with the one so many rows on, while lists are that long
            same = lists[:-apart] == lists[apart:]
            if not same.any():
                break
            i = np.flatnonzero(same & (comp[:-apart] != comp[apart:]))
            i = i[(sig[i] == sig[i + apart]).sum(1) >= AGREE]
            found.append(np.sort(np.stack([ids[i], ids[i + apart]]), axis=0))
        both = np.concatenate(found, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the begin of the last list, SHORT rows at most
        for batch in batches:
            (batch,) = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()
            whole = int(np.searchsorted(batch.column(0).to_numpy(), batch.column(0)[-1].as_py(), "left"))
            yield pairs(batch.slice(0, whole))
            held = [batch.slice(whole)]
        for batch in held:
            yield pairs(batch)

    return keyed.mapInArrow(run, "a bigint, b bigint").distinct()


def _linked(g: int, h: int, own: np.ndarray, ids: np.ndarray, comp: np.ndarray, sig: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between blocks g and h, confirmed on the sets; only those that join what was apart until then."""
    size = np.array([len(x) for x in sets])
    start = np.cumsum(size) - size
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes = codes.astype(np.int32)
    mark, root, right, found = np.zeros(len(names), bool), comp.copy(), np.flatnonzero(own == h), []
    for i in np.flatnonzero(own == g):
        others = right[(root[right] != root[i]) & ((ids[right] > ids[i]) if g == h else True)]
        hits = others[(sig[others] == sig[i]).sum(1) >= AGREE]
        if not len(hits):
            continue
        mark[codes[start[i] : start[i] + size[i]]] = True
        begin = np.cumsum(size[hits]) - size[hits]
        at = np.repeat(start[hits] - begin, size[hits]) + np.arange(size[hits].sum())
        common = np.add.reduceat(mark[codes[at]].astype(np.int64), begin)
        mark[codes[start[i] : start[i] + size[i]]] = False
        for j in hits[100 * common >= PERCENT * (size[i] + size[hits] - common)]:
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return found


def _long_links(mixed: DataFrame, signed: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links in long lists between different components.

    Members meet in pairs of blocks, with their texts, and are confirmed there, so no pair leaves a task but those that
    join components: fewer than the rows that came in.
    """
    dealt = mixed.filter(F.col("n") > SHORT).withColumn("own", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    keyed = dealt.join(signed, "id").join(texts, "id").select("list", F.least("own", "other").alias("g"), F.greatest("own", "other").alias("h"), "own", "id", "c", "signature", "text")

    def compare(table: pa.Table) -> pa.Table:
        (batch,) = table.combine_chunks().to_batches()
        g, h, own, ids, comp = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("g", "h", "own", "id", "c"))
        sig = batch.column(batch.schema.get_field_index("signature")).flatten().to_numpy().reshape(-1, SIGNATURE)
        sets = [x for _, data, bounds in slices(batch, "text") for x in _sets(data, bounds)]
        found = np.array(_linked(g[0], h[0], own, ids, comp, sig, sets), np.int64).reshape(-1, 2)
        give_back()
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return keyed.groupBy("list", "g", "h").applyInArrow(compare, "a bigint, b bigint").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the bound.

    texts: (id, text).  Groups are (a, salt), a salt for every PARTNERS partners; sorted rows stream through a task, a's own
    text first, so a task holds two texts at a time.
    """
    n = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("salts"))
    salted = pairs.join(n, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").alias("salt"))
    members = salted.join(texts.withColumnRenamed("id", "b"), "b").select("a", "salt", "b", "text", F.lit(1).alias("kind"))
    hubs = n.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt")).join(texts.withColumnRenamed("id", "a"), "a").select("a", "salt", F.col("a").alias("b"), "text", F.lit(0).alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, U64)
        for batch in batches:
            out_a, out_b = [], []
            for rows, data, bounds in slices(batch, "text"):
                a, b, kind = (rows.column(i).to_numpy() for i in (0, 2, 4))
                for i, s in enumerate(_sets(data, bounds)):
                    if kind[i] == 0:
                        hub, own = a[i], s
                        continue
                    if hub != a[i]:
                        raise RuntimeError("a partner without its hub")
                    common = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * common >= PERCENT * (len(own) + len(s) - common) and common:
                        out_a.append(a[i])
                        out_b.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
        give_back()

    together = members.unionByName(hubs).select("a", "salt", "b", "text", "kind").repartition("a", "salt").sortWithinPartitions("a", "salt", "kind", "b")
    return together.mapInArrow(run, "a bigint, b bigint")


def _judged(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) for every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    signed = scratch.save(signatures(docs), "signatures")
    # A class has a number of its own; doc_ids only name components.  rep: its first row, null doc_ids last.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("rep")
    grouped = signed.filter("n_shingles > 0").groupBy("digest").agg(first, F.first("signature").alias("signature"))
    classes = scratch.save(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")
    own = classes.select("id", "signature")
    posted = scratch.save(postings(own), "postings")
    used = posted.select("id").distinct()
    own = scratch.save(own.join(used, "id", "left_semi"), "used")
    reps = classes.join(used, "id", "left_semi").select("id", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"))
    picked = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).withColumn("text_key", content_hash(F.col("text")))
    found = picked.join(reps, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_key") == F.col("rep_key")))
    texts = scratch.save(found.select("id", "text", F.octet_length("text").alias("bytes")).dropDuplicates(["id"]), "texts")
    links = scratch.save(spark.createDataFrame([], "a bigint, b bigint"), "links")
    component = scratch.save(spark.createDataFrame([], "id bigint, component bigint"), "component")

    def joined(more: DataFrame, linked: DataFrame | None = None) -> tuple[DataFrame, DataFrame, bool]:
        found = confirmed(scratch.save(more, "pairs"), texts)
        found = scratch.save(found.unionByName(linked) if linked else found, "links")
        if found.isEmpty():
            return links, component, False
        # Components so far enter as one star each.
        stars = component.filter("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))
        return found, scratch.save(components(stars.unionByName(found), scratch), "component"), True

    for turn in range(HUB_ROUNDS):
        links, component, more = joined(_hub_pairs(posted, own, component, turn))
        if not more:
            break
    mixed = scratch.save(_mixed(posted, texts, component), "mixed")
    links, component, _ = joined(_short_pairs(mixed, own), _long_links(mixed, own, texts))
    named = classes.select("id", "digest", "rep").join(component, "id", "left").select("digest", "rep", F.coalesce("component", "id").alias("c"))
    least = named.groupBy("c").agg(F.min("rep").alias("least"))
    of_digest = named.join(least, "c").select("digest", "least")
    is_least = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key"))
    full = signed.filter("n_shingles > 0").join(of_digest, "digest").select("doc_id", "text_key", "n_shingles", F.col("least.doc_id").alias("component_id"), is_least.alias("kept"))
    empty = signed.filter("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return full.unionByName(empty)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    return _judged(docs).drop("text_key")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows that are kept, with all their columns."""
    kept = _judged(docs).filter("kept").select(F.col("doc_id").alias("kept"), "text_key").distinct()
    rows, (doc_id, text) = positional(docs, "doc_id", "text")
    own = content_hash(F.coalesce(F.col(text), F.lit("")))
    return rows.join(kept, F.col(doc_id).eqNullSafe(F.col("kept")) & (own == F.col("text_key")), "left_semi").toDF(*docs.columns)
