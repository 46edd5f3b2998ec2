"""Near-duplicate classes by min-max hashing, every link confirmed on the full shingle sets.

Each of 64 permutations of the shingles' hashes gives its least and its greatest value, so 128 signature values cost 64
evaluations. Bands of two permutations (four values) are equal with a chance of about J^4: two texts at J = 0.8 agree in
none of the 32 bands with a chance of 5e-8. Texts of equal sets are one class before anything is paired.

Buckets are settled in two steps, neither of which pairs all members of one. First every member is compared with its
bucket's centre (the least class): a group of near copies is then one component, for as many pairs as it has members.
What is in a bucket with another component is left: these classes meet by their rarest shingles. A set of n shingles
shares one of its n - ceil(0.8 n) + 1 rarest with every set that it is linked to (prefix filter), whatever the order as
long as it is one; pairs inside a component need no second look. Pages of one template share their frequent
shingles and not the rare ones, so they make no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm import textvec
from tessella.llm.components import connected
from tessella.llm.shared import bitmap, bound_batches, in_bitmap, mark, release, returning, texts, written, written_by

PERMUTATIONS, PER_BAND = 64, 2
BANDS = PERMUTATIONS // PER_BAND
#: Rows of one bucket, or pairs of one centre, that go to one part of a join; larger ones are spread.
SALTS = 8
PAIRS_PER_SALT = 1000

_RNG = np.random.Generator(np.random.PCG64(20240229))
_A = _RNG.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, PERMUTATIONS, np.uint64)


def shingles(raw: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): of row i those from bounds[i] to bounds[i + 1], in order and with repeats. A row of fewer than n
    words, but one at least, has one shingle, all of it."""
    h, _, _, bounds = textvec.words(raw, offs)
    count = np.diff(bounds)
    grams = textvec.ngrams(h, n)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(bounds[:-1] - out[:-1], size) + np.arange(int(out[-1]))
    got = grams[at]
    for i in np.flatnonzero((count > 0) & (count < n)).tolist():
        short = h[bounds[i] : bounds[i + 1]]
        got[out[i]] = textvec.mix(textvec.ngrams(short, len(short))[:1] + np.uint64(len(short)))[0]
    return got, out


def signature(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Band keys (rows x BANDS) of rows that all have a shingle."""
    starts = bounds[:-1]
    out = np.empty((len(starts), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(len(starts), band, np.uint64)
            for p in range(band * PER_BAND, (band + 1) * PER_BAND):
                v = h * _A[p] + _B[p]
                for edge in (np.minimum, np.maximum):
                    key = textvec.mix(key * np.uint64(0x9E3779B97F4A7C15) + edge.reduceat(v, starts))
            out[:, band] = key
    return out


def _set_id(s: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return np.array([s.sum(), textvec.mix(s ^ np.uint64(0xA0761D6478BD642F)).sum()], np.uint64).tobytes()


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_hash and row, which rows share only if they repeat doc_id and text."""
    return texts(docs).withColumn("text_hash", F.xxhash64("text")).withColumn("row", F.xxhash64("doc_id", "text_hash"))


def features(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_hash, row, n_shingles, set_id (16 bytes, equal for equal sets; null for an empty one), bands (binary, BANDS longs)."""
    bound_batches(docs.sparkSession)
    names = ["doc_id", "text_hash", "row", "n_shingles", "set_id", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, bands = [], [], []
            for _, _, raw, offs in textvec.chunks(batch.column(1)):
                h, bounds = shingles(raw, offs, n)
                rows = np.flatnonzero(np.diff(bounds))
                keys = iter(signature(h, np.append(bounds[rows], len(h))) if len(rows) else ())
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    s = np.unique(h[a:b])
                    sizes.append(len(s))
                    ids.append(_set_id(s) if len(s) else None)
                    bands.append(next(keys).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, pa.binary())], names)

    return _keyed(docs).mapInArrow(returning(run), "doc_id long, text_hash long, row long, n_shingles long, set_id binary, bands binary")


def _members(classes: DataFrame, keys: np.ndarray | None = None) -> DataFrame:
    """(key, cid) for every band of every class; of bands whose keys are in a bitmap, where there is one."""
    shared = None if keys is None else classes.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, _ = textvec.buffers(batch.column(1))
            key, cid = raw.view(np.int64), np.repeat(batch.column(0).to_numpy(), BANDS)
            if shared is not None:
                kept = in_bitmap(shared.value, key)
                key, cid = key[kept], cid[kept]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(cid)], ["key", "cid"])

    return classes.select("cid", "bands").mapInArrow(returning(run), "key long, cid long")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(cid, set): sorted shingle hashes of the classes wanted (cid, row, set_id). Texts stay where they are: a bitmap
    of the wanted rows tells almost all others, and only sets are moved."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bitmap(wanted, "row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: set[int] = set()
        for batch in batches:
            rows = batch.column(1).to_numpy()
            hit = in_bitmap(shared.value, rows)
            hit[np.fromiter((x in last for x in rows.tolist()), bool, len(rows))] = False
            first = np.zeros(len(rows), bool)
            first[np.unique(rows, return_index=True)[1]] = True
            hit &= first  # rows that repeat in this batch or the last one give their set once
            last = set(rows.tolist())
            ids, sets = [], []
            for _, _, raw, offs in textvec.chunks(batch.column(0).filter(pa.array(hit))):
                h, bounds = shingles(raw, offs, n)
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    s = np.unique(h[a:b])
                    ids.append(_set_id(s))
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows[hit]), pa.array(ids, pa.binary()), pa.array(sets, pa.binary())], ["row", "set_id", "set"])

    bound_batches(spark)
    found = _keyed(docs).select("text", "row").mapInArrow(returning(run), "row long, set_id binary, set binary")
    return found.join(wanted.select("row", "set_id", "cid").hint("merge"), ["row", "set_id"]).select("row", "set_id", "cid", "set").dropDuplicates(["row", "set_id"]).select("cid", "set")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared, united): sizes of the intersection and union for every pair (a, b). A set that many pairs want is
    given to several parts, each with its share of them."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(PAIRS_PER_SALT))).cast("int").alias("_parts"))
    first = sets.hint("merge").join(parts, F.col("cid") == F.col("a")).select("a", "_parts", F.col("set").alias("set_a"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_salt"))
    spread = pairs.join(parts, "a").withColumn("_salt", F.pmod(F.xxhash64("b"), F.col("_parts").cast("long")).cast("int")).drop("_parts")
    # Sets are never broadcast, at any size: the plan of a small table is that of a large one.
    other = sets.select(F.col("cid").alias("b"), F.col("set").alias("set_b")).hint("merge")
    joined = spread.join(other, "b").join(first.drop("_parts").hint("merge"), ["a", "_salt"]).select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, united = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([p, q]))
                same = int((both[1:] == both[:-1]).sum())
                shared.append(same)
                united.append(len(p) + len(q) - same)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(united, pa.int64())], ["a", "b", "shared", "united"])

    return joined.mapInArrow(returning(run), "a long, b long, shared long, united long")


def _rare(sets: DataFrame, percent: int) -> DataFrame:
    """(token, cid, n, place): each set's rarest shingles as far as a linked set must share one, without those of one set.

    n is the set's size, place the shingle's place in the order by frequency. Shingles of one set alone come first in it,
    whatever their number, so that they need be counted and no more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = textvec.buffers(batch.column(1))
            size = np.diff(offs) // 8
            yield pa.RecordBatch.from_arrays([pa.array(raw.view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), size)), pa.array(np.repeat(size, size))], ["token", "cid", "n"])

    tokens = sets.select("cid", "set").mapInArrow(returning(run), "token long, cid long, n long")
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    of = W.partitionBy("cid")
    least = F.expr(f"n - ceil({percent} * n / 100D - 1e-9) + 1")
    placed = tokens.join(shared, "token").withColumn("place", F.col("n") - F.count(F.lit(1)).over(of) + F.row_number().over(of.orderBy("held", "token")))
    return placed.filter(F.col("place") <= least).select("token", "cid", "n", "place")


def _left(crowd: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of classes in different components so far (labels) that may be linked, of those that share a bucket
    of crowd (key, cid) with another component. In a group by shingle, only members outside its largest component look
    for partners."""
    labelled = crowd.join(labels.withColumnRenamed("id", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
    open_ = written(labelled.join(mixed, "key", "left_semi").select("cid", "label").distinct(), "open")
    rare = written(_rare(sets.hint("merge").join(open_, "cid", "left_semi"), percent).join(open_, "cid"), "rare")
    kinds = rare.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max(F.struct("k", "label")).alias("m"), F.count(F.lit(1)).alias("kinds"))
    groups = kinds.filter("kinds > 1").select("token", F.col("m.label").alias("main"))
    ours = rare.join(groups, "token")
    x, y = ours.filter("label <> main").alias("x"), ours.alias("y")
    # The sets' sizes, and what can still be shared from these places on, must allow a link.
    may = f"x.label <> y.label AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND {100 + percent} * (1 + least(x.n - x.place, y.n - y.place)) >= {percent} * (x.n + y.n)"
    pairs = x.join(y, F.expr(f"x.token = y.token AND {may}"))
    return pairs.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()


def links(docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b) of classes whose sets have 100 * shared >= percent * united, enough of them to connect all that are linked."""
    near = F.expr(f"100 * shared >= {percent} * united")
    begun = mark()
    buckets = written(_members(classes).groupBy("key").agg(F.min("cid").alias("centre"), F.max("cid").alias("last"), F.count(F.lit(1)).alias("k")).filter("k > 1"), "buckets")
    # Buckets of two are a pair already; members of larger ones are looked up.
    large = buckets.filter("k > 2").select("key", "centre")
    larger = large.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    crowd = written(_members(classes, bitmap(large, "key")).withColumn("_salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int")).join(larger, ["key", "_salt"]).select("key", "cid", "centre"), "crowd")
    two = buckets.filter("k = 2").select(F.col("centre").alias("a"), F.col("last").alias("b"))
    pairs = written(two.union(crowd.filter("cid <> centre").select(F.col("centre").alias("a"), F.col("cid").alias("b"))).distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = written(classes.select("cid", "row", "set_id").join(ids, "cid", "left_semi"), "wanted")
    sets = written_by(_sets(docs, wanted, n).repartition(parts, "cid"), "sets", "cid", parts)
    found = written(_verified(pairs, sets).filter(near).select("a", "b"), "found")
    rest = written(_left(crowd.select("key", "cid"), sets, connected(found), percent), "rest")
    out = written(found.union(_verified(rest, sets).filter(near).select("a", "b")), "linked")
    release(docs.sparkSession, begun, keep=1)
    return out


def _judged(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """near_duplicates() with text_hash and row, and first_hash, the least of the component's."""
    rows = written(features(docs, n), "features")
    grouped = rows.filter(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.min("text_hash").alias("hash"), F.min("row").alias("row"), F.any_value("bands").alias("bands"))
    classes = written(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    labels = connected(links(docs, classes, n, percent))
    named = classes.join(labels.withColumnRenamed("id", "cid"), "cid", "left").select("set_id", "rep", "hash", F.coalesce("label", "cid").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"), F.min("hash").alias("first_hash"))
    of = named.join(least, "root").select("set_id", "component_id", "first_hash")
    component = F.coalesce("component_id", "doc_id")
    return rows.drop("bands").join(of, "set_id", "left").select("doc_id", "text_hash", "row", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True) & component.isNull()).alias("kept"), "first_hash")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row: documents linked by a Jaccard similarity of percent or more.

    Words are lower-cased (A-Z) runs of other than white space; a set holds the distinct runs of n words; fewer words make
    one shingle. component_id is the least doc_id reachable, kept says whether it is the row's own. A null or empty text,
    or one without words, has no shingles and is linked with nothing. Repeated rows stay and belong to one component; a
    null doc_id is never a component_id where the component has another, and is kept where it has none.
    """
    return _judged(docs, n, percent).drop("text_hash", "row", "first_hash")


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, that stay: of each component the document of the least doc_id.

    Of a component without a doc_id the rows of one text stay, that of the least hash. Rows that repeat a doc_id and text stay once. Documents without words stay, being linked with nothing.
    """
    stays = F.expr("kept AND (component_id IS NOT NULL OR first_hash IS NULL OR text_hash = first_hash)")
    judged = _judged(docs, n, percent).groupBy("row", "text_hash", F.col("doc_id").alias("_id")).agg(F.max(stays).alias("_stays"), F.count(F.lit(1)).alias("_times"))
    special = written(judged.filter("NOT _stays OR _times > 1").select("row", F.col("text_hash").alias("_hash"), "_id", "_stays"), "special")
    words = bitmap(special, "row")
    spark = docs.sparkSession
    parts = spark.createDataFrame(enumerate(p.tolist() for p in words.view("<i8").reshape(-1, 512)), "_part int, _words array<long>")
    hash_ = F.xxhash64(F.col("text").cast("string"))
    place = F.xxhash64(F.col("doc_id").cast("long"), hash_).bitwiseAND(F.lit(8 * len(words) - 1))
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    told = docs.select(row, place.alias("_place"), F.floor(place / 32768).cast("int").alias("_part")).join(F.broadcast(parts), "_part")
    hit = F.getbit(F.get("_words", F.floor(F.col("_place") % 32768 / 64).cast("int")), (F.col("_place") % 64).cast("int")) == 1
    free = told.filter(~hit).select("_row.*")
    # The rest, with what the bitmap let pass by chance, is joined; rows that repeat doc_id and text stay once.
    id_, text = F.col("_row")["doc_id"].cast("long"), F.xxhash64(F.col("_row")["text"].cast("string"))
    held = told.filter(hit).select("_row", id_.alias("_own"), text.alias("_text"), F.xxhash64(id_, text).alias("row"))
    joined = held.join(special, (held["row"] == special["row"]) & held["_own"].eqNullSafe(special["_id"]) & (held["_text"] == special["_hash"]), "left").filter("_stays IS NULL OR _stays")
    once = W.partitionBy("_own", "_text").orderBy("_own")
    repeated = joined.withColumn("_times", F.when(F.col("_stays"), F.row_number().over(once)).otherwise(1))
    return free.union(repeated.filter("_times = 1").select("_row.*"))


def oracle(n: int = 4, percent: int = 80) -> str:
    """DuckDB SQL for near_duplicates(), by joining all shingles."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= {n} THEN list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
u AS MATERIALIZED (SELECT doc_id, unnest(sh) AS x, len(sh) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * same >= {percent} * (na + nb - same)),
r(id, reach) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON c.id = s.doc_id
"""
