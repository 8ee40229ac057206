"""MinHash near-dedup with min-max hashing.

Each permutation is evaluated once a shingle and yields two signature values, its minimum and its maximum. 120
permutations give 240 values, cut into 48 bands of 5 values of distinct permutations: a pair at Jaccard 0.75 shares no
band with probability (1 - 0.75^5)^48, about 2 in a million. Candidates are confirmed on full shingle sets.

Skew: exact copies (same set) collapse first, with partial aggregation; in a band bucket the members are compared with
one hub (a star, never all pairs). Buckets whose members are then in one component are settled. In the others, members
outside the lowest component are compared with all members of other components: as pair rows in small buckets, in large
ones as pairs of blocks, compared inside a task, which emit only links. So no cap or sample drops a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.components import connected_components
from postmill.llm.scratch import broadcast_if_small, materialize, release, small_batches, text_key
from postmill.llm.word_sets import keys, mix, shingle_sets

PERMUTATIONS, ROWS = 120, 5
BANDS = 2 * PERMUTATIONS // ROWS
#: Members up to which an unsettled bucket is finished as pair rows, at most this many a member; larger ones as blocks.
PAIRS = 16
#: Members of a block, on average: a task compares two blocks, whatever the size of the bucket.
BLOCK = 256
_TIMES, _FLIP = keys(PERMUTATIONS, 11)[:, None], keys(PERMUTATIONS, 12)[:, None]
_BAND, _PICK = keys(BANDS, 13)[:, None], keys(ROWS, 14)


def bands(shingles: np.ndarray) -> np.ndarray:
    """The 48 band hashes of a non-empty set: 24 over minima, 24 over maxima."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for k in range(0, len(shingles), 1024):
        part = (shingles[None, k : k + 1024] ^ _FLIP) * _TIMES
        np.minimum(low, part.min(1), out=low)
        np.maximum(high, part.max(1), out=high)
    values = np.concatenate([low, high]).reshape(BANDS, ROWS)
    return mix((mix(values + _BAND) * _PICK).sum(1, dtype=np.uint64))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingle_sets(batch.column(1))
        prints = [(mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) for s in sets]
        prints = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
        values = [bands(s).view(np.int64) for s in sets if len(s)]
        offsets = np.concatenate([[0], np.cumsum([BANDS * (len(s) > 0) for s in sets])]).astype(np.int32)
        flat = np.concatenate(values) if values else np.zeros(0, np.int64)
        yield pa.record_batch([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.ListArray.from_arrays(offsets, flat)], ["id", "n", "f1", "f2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingle_sets(batch.column(1))
        yield pa.record_batch([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "members"])


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(linked, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return run


def _links_of_blocks(percent: int):
    """Links between the left and the right rows of a group that are in different components, one a row and component."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in part["members"]]
        ids, groups, left = part["id"].to_numpy(), part["c"].to_numpy(), part["left"].to_numpy()
        tokens = np.unique(np.concatenate(sets), return_inverse=True)[1]
        sizes = np.array([len(s) for s in sets])
        ends = np.cumsum(sizes)
        right = np.flatnonzero(~left)
        owned = np.concatenate([tokens[ends[k] - sizes[k] : ends[k]] for k in right]) if len(right) else tokens[:0]
        starts = np.cumsum(sizes[right]) - sizes[right]
        mark = np.zeros(len(tokens), np.int32)
        out: list[tuple[int, int]] = []
        for k in np.flatnonzero(left) if len(right) else ():
            mine = tokens[ends[k] - sizes[k] : ends[k]]
            mark[mine] = 1
            common = np.add.reduceat(mark[owned], starts)
            mark[mine] = 0
            hit = (100 * common >= percent * (sizes[k] + sizes[right] - common)) & (groups[right] != groups[k])
            found = right[hit]
            out += [(min(ids[k], ids[f]), max(ids[k], ids[f])) for f in found[np.unique(groups[found], return_index=True)[1]]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Documents are linked where 100 * |A and B| >= percent * |A or B| over distinct 5-word shingles; component_id is the
    smallest id reachable, kept marks it. Null, empty and wordless texts have no shingles and link with nothing. Rows
    that repeat an id count as one document, linked by each of their texts. A row with a null id is kept and has a null
    component. Other columns are never read, so their names cannot clash. An empty table gives an empty table.
    ``percent`` below 75 lowers the recall of the banding (see the module's text).
    """
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(spark, texts.mapInArrow(_signatures, "id long, n long, f1 long, f2 long, bands array<long>"), "signatures")
    plain = F.col("id").isNull() | (F.col("n") == 0)
    real = rows.where(~plain)
    # tables of keys are written first: the join then reads both sides straight from a shuffle, which adaptive execution can split
    classes = real.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.max("id").alias("top")).where("rep < top").drop("top")
    classes = materialize(spark, classes, "classes")
    rep = F.coalesce("rep", "id")
    member = real.join(broadcast_if_small(classes), ["f1", "f2", "n"], "left").select("id", "n", rep.alias("rep"), F.when(F.col("id") == rep, F.col("bands")).alias("bands"))
    member = materialize(spark, member, "members")
    links = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")  # ids with several texts
    links = None if links.isEmpty() else member.join(links.select("id", "a"), "id").select("a", F.col("rep").alias("b")).where("a < b")
    keyed = member.where("bands is not null").select("id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub < top").select("key", "hub")
    shared = materialize(spark, shared, "shared")
    buckets = materialize(spark, keyed.join(broadcast_if_small(shared), "key").select("key", "id", "hub"), "buckets")
    ids = materialize(spark, buckets.select("id").distinct(), "candidates")
    members = materialize(spark, texts.join(broadcast_if_small(ids), "id", "left_semi").mapInArrow(_sets, "id long, n long, members binary"), "sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        x = members.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("members").alias("x"))
        y = members.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("members").alias("y"))
        near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
        both = pairs.join(x, "a").join(y, "b").where(near).select("a", "b", "x", "y")
        return both.mapInArrow(_confirmed(percent), "a long, b long")

    def settle(links: DataFrame | None, pairs: DataFrame) -> DataFrame:
        found = confirm(pairs)
        return materialize(spark, found if links is None else links.union(found), "confirmed")

    links = settle(links, buckets.where("hub < id").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    groups = connected_components(spark, links)
    now = buckets.join(groups, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    lowest = now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo < hi").drop("hi")
    lowest = materialize(spark, lowest, "lowest")
    unsettled = materialize(spark, now.join(broadcast_if_small(lowest), "key"), "unsettled")
    few, many = unsettled.where(F.col("size") <= PAIRS), unsettled.where(F.col("size") > PAIRS)
    other = few.select("key", F.col("id").alias("id2"), F.col("c").alias("c2"))
    pairs = few.where("c <> lo").join(other, "key").where("c <> c2").select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
    parts = many.groupBy("key").agg(F.ceil(F.count_if(F.col("c") != F.col("lo")) / BLOCK).alias("nb"), F.ceil(F.count("*") / BLOCK).alias("nc"))
    parts = materialize(spark, parts, "parts")
    cut = many.join(broadcast_if_small(parts), "key").join(members, "id")
    slot = F.xxhash64("id")
    across = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = cut.where("c <> lo").select("key", F.pmod(slot, F.col("nb")).alias("i"), across("nc").alias("j"), "id", "c", "members", F.lit(True).alias("left"))
    right = cut.select("key", across("nb").alias("i"), F.pmod(slot, F.col("nc")).alias("j"), "id", "c", "members", F.lit(False).alias("left"))
    blocks = left.union(right).groupBy("key", "i", "j").applyInPandas(_links_of_blocks(percent), "a long, b long")
    more = settle(blocks, pairs)
    if not more.isEmpty():
        groups = connected_components(spark, links.union(more))
    release(spark, classes, shared, buckets, ids, members, lowest, unsettled, parts, links, more)
    linked = member.join(groups, F.col("rep") == F.col("node"), "left").select("id", "n", F.coalesce("component", "rep").alias("c"))
    out = linked.union(rows.where(plain).select("id", "n", F.col("id").alias("c")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.coalesce(F.col("c") == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates; columns as before.

    A document is an id with a text; of a group the one with the smallest (doc_id, text key) stays. Rows that repeat both
    are one document and stay or go together; an id with several texts is several documents, each judged by its own text.
    Rows with a null id and texts without words stay. An empty table gives an empty table.
    """
    keyed = docs.select("doc_id", *text_key(F.col("text")), "text")
    key = F.struct("t1", "t2")
    several = keyed.where("doc_id is not null").groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo < hi").select("doc_id")
    several = materialize(spark, several, "several")
    if several.isEmpty():
        gone = materialize(spark, near_duplicates(spark, docs).where("not kept").select("doc_id").distinct(), "gone")
        return docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(docs.columns)
    # each text of an id with several gets a number of its own, below all ids
    low = keyed.agg(F.min(F.col("doc_id").cast("long"))).first()[0]
    texts = materialize(spark, keyed.join(broadcast_if_small(several), "doc_id").select("doc_id", "t1", "t2").distinct(), "texts")
    texts = materialize(spark, texts.withColumn("node", low - 1 - F.monotonically_increasing_id()), "nodes")
    numbered = keyed.join(broadcast_if_small(texts), ["doc_id", "t1", "t2"], "left").withColumn("node", F.coalesce("node", F.col("doc_id").cast("long")))
    groups = near_duplicates(spark, numbered.select("node", "text"), id_col="node").select(F.col("doc_id").alias("node"), F.col("component_id").alias("c")).where("node is not null").distinct()
    groups = materialize(spark, groups, "groups")
    mixed = groups.groupBy("c").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("c")
    nodes = materialize(spark, groups.join(broadcast_if_small(materialize(spark, mixed, "mixed")), "c"), "mixed-nodes")
    named = numbered.join(broadcast_if_small(nodes), "node").select("c", F.struct("doc_id", "t1", "t2").alias("d"))
    named = materialize(spark, named.distinct(), "named")
    first = named.groupBy("c").agg(F.min("d").alias("first"))
    gone = materialize(spark, named.join(first, "c").where("d <> first").select("d.*"), "gone")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", *text_key(F.col("text")))
    return rows.join(broadcast_if_small(gone), ["doc_id", "t1", "t2"], "left_anti").select("row.*")
