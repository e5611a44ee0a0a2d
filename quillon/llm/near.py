"""MinHash near-dedup with HyperMinHash signatures.

Every shingle is hashed once. The top bits choose one of 128 registers; of the smallest remainder in each register only its leading-zero count
and ten mantissa bits are stored (16 bits). Registers that no shingle reached borrow one that is filled, in an order fixed for each register.
Bands of four registers are the blocking keys. Pairs that share a band are first judged by the collision-corrected estimate of Jaccard, with a
margin of six standard deviations, and then verified on the full sets.

Sets that are equal are one class from the start; only classes are compared. Links are found in two steps so that no group is expanded into
all its pairs: first every member of a bucket is compared with the bucket's smallest member (estimate, then full sets); buckets that then still hold
several components compare the members outside their largest one with all others, exactly and in blocks that give out nothing but links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import _text
from quillon.llm.components import components
from quillon.llm.rows import keyed, staying
from quillon.runtime import bounded, materialize, ship

REGISTERS = 128
ROWS = 4
BANDS = REGISTERS // ROWS
MANTISSA = 10
_INDEX_BITS = REGISTERS.bit_length() - 1
#: Shingles on either side of a block in which members of unlike components are compared.
BLOCK = 500_000
_EDGES = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - _INDEX_BITS)
#: Row j: the order in which register j asks the others when it is empty.
_PROBES = np.stack([np.random.default_rng(1000 + j).permutation(REGISTERS) for j in range(REGISTERS)])
SIGNATURE = "doc_id long, tag long, n_shingles long, digest binary, sig binary"


def registers(h: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16) of a sorted array of distinct hashes, at least one."""
    at = np.searchsorted(h, _EDGES)
    low = h[np.minimum(at, len(h) - 1)]
    filled = (at < len(h)) & ((low >> np.uint64(64 - _INDEX_BITS)) == np.arange(REGISTERS, dtype=np.uint64))
    rest = (low << np.uint64(_INDEX_BITS)) | np.uint64(1 << (_INDEX_BITS - 1))
    zeros = 64 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1] - 11
    mantissa = np.where(zeros < 63, (rest << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA), 0)
    out = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    if not filled.all():
        empty = np.flatnonzero(~filled)
        asked = _PROBES[empty]
        out[empty] = out[asked[np.arange(len(empty)), filled[asked].argmax(1)]]
    return out


def sets(ids: pa.Array, texts: pa.Array, k: int) -> Iterator[tuple[object, np.ndarray]]:
    """Each id with the sorted distinct hashes of its shingles."""
    data, at = _text.buffers(texts)
    for a, b in _text.runs(at):
        h, first = _text.words(data, at[a : b + 1])
        for i in range(a, b):
            yield ids[i].as_py(), np.unique(_text.shingles(h[first[i - a] : first[i - a + 1]], k))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """docs: doc_id, tag, text."""

    @_text.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sig = [], [], []
            for _, h in sets(batch.column(0), batch.column(2), k):
                n.append(len(h))
                digest.append(_digest(h) if len(h) else None)
                sig.append(registers(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "tag", "n_shingles", "digest", "sig"])

    return docs.mapInArrow(run, SIGNATURE)


def _digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard by the share of equal registers, less the collisions expected of unlike sets of these sizes (Yu and Weber's approximation)."""
    most, least = np.maximum(na, nb).astype(float), np.minimum(na, nb).astype(float)
    ratio = most / least
    expected = 0.169919487159739093975315012348 * 2.0 ** (_INDEX_BITS - MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return ((a == b).sum(1) - expected) / REGISTERS


def _promising(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b, n_a, n_b) whose estimate is not far below the threshold; sizes alone rule out some."""

    @_text.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sig_a", "sig_b")]
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            t = num / den
            margin = 6 * np.sqrt(t * (1 - t) / np.minimum(REGISTERS, np.minimum(na, nb) / 2))
            keep = estimate(*sig, na, nb) >= t - margin
            yield batch.filter(pa.array(keep)).select(["a", "b", "n_a", "n_b"])

    fits = pairs.where(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
    return fits.mapInArrow(run, "a long, b long, n_a long, n_b long")


def _verified(pairs: DataFrame, classes: DataFrame, full: DataFrame, num: int, den: int) -> DataFrame:
    """Those of pairs (a, b) with den * intersection >= num * union."""
    side = classes.select("rep", "sig", "n")
    for c in ("a", "b"):
        pairs = pairs.join(side.toDF(c, f"sig_{c}", f"n_{c}"), c)
    pairs = _promising(pairs, num, den)
    for c in ("a", "b"):
        pairs = pairs.join(full.toDF(c, f"set_{c}"), c)
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return pairs.where(both * den >= (F.col("n_a") + F.col("n_b") - both) * num).select("a", "b")


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The sorted shingle hashes of the wanted classes. docs: doc_id, text; wanted: rep, id, digest. Of rows that repeat an id, those with that digest."""

    @_text.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, values, ends = [], [], [0]
            digests = batch.column("digest").to_pylist()
            for i, (rep, h) in enumerate(sets(batch.column("rep"), batch.column("text"), k)):
                if _digest(h) != digests[i]:
                    continue
                reps.append(rep)
                values.append(h.view(np.int64))
                ends.append(ends[-1] + len(h))
                if ends[-1] > 1 << 20:
                    yield _lists(reps, values, ends)
                    reps, values, ends = [], [], [0]
            yield _lists(reps, values, ends)

    chosen = docs.join(bounded(wanted), docs.doc_id == wanted.id).select("rep", "text", "digest")
    return chosen.mapInArrow(run, "rep long, hashes array<long>")


def _lists(ids: list, values: list, ends: list) -> pa.RecordBatch:
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["rep", "hashes"])


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b, by products of 0/1 matrices over the elements that occur more than once."""
    flat = np.concatenate([*a, *b])
    element, count = np.unique(flat, return_inverse=True, return_counts=True)[1:]
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    shared = count[element] > 1
    name = np.cumsum(count > 1) - 1
    row, element = row[shared], name[element[shared]]
    order = np.argsort(element, kind="stable")
    row, element = row[order], element[order]
    out, width = np.zeros((len(a), len(b)), np.int64), 2048
    for low in range(0, int(element[-1]) + 1 if len(element) else 0, width):
        x, y = np.searchsorted(element, [low, low + width])
        grid = np.zeros((len(a) + len(b), width), np.float32)
        grid[row[x:y], element[x:y] - low] = 1
        out += (grid[: len(a)] @ grid[len(a) :].T).astype(np.int64)
    return out


def _linked_within(members: list[tuple], num: int, den: int) -> list[tuple[int, int]]:
    """members (id, comp, rare, set) of one block -> links between unlike components with a rare end, as many as connect them all."""
    top: dict[int, int] = {}

    def root(c: int) -> int:
        while top.setdefault(c, c) != c:
            top[c] = c = top[top[c]]
        return c

    out = []
    rare = [m for m in members if m[2]]
    size = np.array([len(m[3]) for m in members])
    for low in range(0, len(rare), 512):
        part = rare[low : low + 512]
        n = np.array([len(m[3]) for m in part])[:, None]
        both = _intersections([m[3] for m in part], [m[3] for m in members])
        for i, j in zip(*np.nonzero(both * den >= (n + size[None] - both) * num)):
            x, y = root(part[i][1]), root(members[j][1])
            if x != y:
                top[max(x, y)] = min(x, y)
                out.append((part[i][0], members[j][0]))
    return out


def _between(left: DataFrame, full: DataFrame, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between unlike components of a bucket. left: bucket, id, comp, n (size of the set).

    Only members outside the largest component of a bucket (the rare) are compared with all others, exactly and in blocks that hold the sets of
    about `block` shingles of either side; a task works on one block at a time and gives out links only.
    """
    counted = left.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    major = bounded(materialize(counted.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("major")), "major"))
    marked = left.join(major, "bucket").withColumn("rare", F.col("comp") != F.col("major")).drop("major")
    parts = lambda c: F.ceil(F.coalesce(F.sum(c), F.lit(0)) / block).cast("int")
    sizes = bounded(materialize(marked.groupBy("bucket").agg(parts(F.col("n")).alias("ms"), parts(F.when(F.col("rare"), F.col("n"))).alias("rs")), "sizes"))
    dealt = marked.join(sizes, "bucket")
    own = F.pmod(F.xxhash64("id"), F.col("ms")).cast("int"), F.pmod(F.xxhash64("id"), F.greatest("rs", F.lit(1))).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    others = dealt.where("NOT rare").select("bucket", "id", "comp", "rare", own[0].alias("m"), to(F.col("rs")).alias("r"))
    # a rare member stands in each block of its row as one end, and in its own column's blocks as the other
    ends = dealt.where("rare").select("bucket", "id", "comp", "rare", to(F.col("ms")).alias("m"), own[1].alias("r"))
    beside = dealt.where("rare AND rs > 1").select("bucket", "id", "comp", F.lit(False).alias("rare"), own[0].alias("m"), own[1].alias("mine"), to(F.col("rs")).alias("r")).where("r <> mine").drop("mine")
    rows = others.unionByName(ends).unionByName(beside).join(full.withColumnRenamed("rep", "id"), "id")

    @_text.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def links() -> pa.RecordBatch:
            found = _linked_within(held, num, den)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        for batch in batches:
            lists = batch.column("hashes")
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            keys = zip(*(batch.column(c).to_pylist() for c in ("bucket", "m", "r")))
            for i, (key, who, comp, rare) in enumerate(zip(keys, *(batch.column(c).to_pylist() for c in ("id", "comp", "rare")))):
                if key != at:
                    if held:
                        yield links()
                    at, held = key, []
                held.append((who, comp, rare, values[ends[i] : ends[i + 1]].copy()))
        if held:
            yield links()

    order = ["bucket", "m", "r"]
    return rows.repartition(*order).sortWithinPartitions(*order).select(*order, "id", "comp", "rare", "hashes").mapInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """docs: doc_id, tag, text -> row, doc_id, tag, n_shingles, component_id, leader (the row that stays for its group: of the smallest id).

    A class is a set of shingles, whatever ids its rows have; it is named by one of its rows, so an id that has several texts is in several classes.
    """
    signed = materialize(signatures(docs.select("doc_id", "tag", "text"), shingle).withColumn("row", F.monotonically_increasing_id()), "signed")
    usable = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "row", "n_shingles", "sig")).alias("s")
    classes = usable.groupBy("digest").agg(first).select("digest", F.col("s.row").alias("rep"), F.col("s.doc_id").alias("id"), F.col("s.n_shingles").alias("n"), F.col("s.sig").alias("sig"))
    classes = materialize(classes, "classes")

    width = 2 * ROWS
    keys = F.array(*(F.concat(F.lit(bytes([b])), F.substring("sig", width * b + 1, width)) for b in range(BANDS)))
    banded = classes.select(F.col("rep").alias("id"), F.explode(keys).alias("bucket"))
    # written first: a join of two plain shuffles can be split where a bucket holds very many rows, one on top of an aggregate cannot
    shared = materialize(banded.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last").drop("last"), "hubs")
    members = materialize(banded.join(shared, "bucket"), "members")
    wanted = materialize(classes.select("rep", "id", "digest").join(members.select(F.col("id").alias("rep")).distinct(), "rep"), "wanted")
    full = materialize(_full_sets(docs.select("doc_id", "text"), wanted, shingle).dropDuplicates(["rep"]), "sets")

    links = materialize(_verified(members.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), classes, full, num, den), "links")
    found = components(links)
    everyone = members.where("id <> hub").select("bucket", "id").union(members.select("bucket", F.col("hub").alias("id")).distinct())
    left = everyone.join(found, "id", "left").select("bucket", "id", F.coalesce("comp", "id").alias("comp"))
    mixed = left.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("bucket")
    left = left.join(bounded(materialize(mixed, "mixed")), "bucket", "left_semi").join(classes.select(F.col("rep").alias("id"), "n"), "id")
    fresh = materialize(_between(materialize(left, "left"), full, num, den), "links")
    if not fresh.isEmpty():
        found = components(links.union(fresh))
    # the row that stays for a group of classes is the one with the smallest id of all
    placed = materialize(classes.select("digest", "rep", "id").join(found.withColumnRenamed("id", "rep"), "rep", "left"), "placed")
    best = placed.where("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct("id", "rep")).alias("best"))
    named = placed.join(bounded(materialize(best, "best")), "comp", "left").select("digest", F.coalesce("best.id", "id").alias("component"), F.coalesce("best.rep", "rep").alias("leader"))
    out = signed.select("row", "doc_id", "tag", "n_shingles", "digest").join(materialize(named, "named"), "digest", "left")
    has_id = F.col("doc_id").isNotNull()
    return out.select("row", "doc_id", "tag", "n_shingles", F.when(has_id, F.coalesce("component", "doc_id")).alias("component_id"), F.when(has_id, F.coalesce("leader", "row")).otherwise(F.col("row")).alias("leader"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    r"""For every row: doc_id, n_shingles, component_id, kept. Documents are linked if den * |A & B| >= num * |A | B| for their sets of shingles.

    Words are [^\x20\x09-\x0D]+ with A-Z lower-cased. A text of fewer words than `shingle` has one shingle; null, empty and blank texts have
    none and are linked with nothing. A row with a null id is linked with nothing either (component_id null, kept true). Rows that repeat an id are
    rows like others: each is linked by its own text. Other columns are ignored. A pair at the threshold shares no band with probability 5e-8.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("tag"), F.col(text_col).alias("text"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return _grouped(rows, shingle, num, den).select("doc_id", "n_shingles", "component_id", kept)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """docs with one row of each group, the one with the smallest id; columns as they were. Rows that repeat an id and a text are a group as well.

    Rows with a null id, and without words, all stay.
    """
    ship(docs.sparkSession)
    rows = keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    found = _grouped(rows, shingle, 80, 100).where("doc_id IS NOT NULL")
    return staying(docs, found.select(F.col("doc_id").alias("doc"), "tag", (F.col("row") == F.col("leader")).alias("stays")), id_col, text_col)


def op1_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), shingle=4, num=80, den=100)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D]', ' ', 'g'), ' +'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
g AS MATERIALIZED (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 80 * (x.n + y.n - inter)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, dest) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.dest)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.dest) AS component_id, n.doc_id = min(r.dest) AS kept
FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n"""
