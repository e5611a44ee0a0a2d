"""Suffix dedup: which bytes of a corpus lie in strings of a given length that start more than once.

The construction is column-wise over many documents: in each round every string gets one symbol more (from the right), the order of all strings
by what follows (the positional Burrows-Wheeler transform) is updated by a stable sort on that symbol, and the common prefixes of neighbours are
updated from range minima over the last round's. A window is repeated if it shares `length` symbols with a neighbour in that order.

So that no collection is unbounded, windows are first dealt out by content: the anchor of a window is the leftmost of its 16-byte grams with the
smallest hash, and equal windows have equal anchors at the same place. Neighbouring windows with one anchor are kept as one context (at most
2 * length - 16 bytes). Contexts whose anchor stands nowhere else are done. Equal contexts are one, and all their windows are repeated. Unlike
contexts of one anchor are split in two by where the anchor stands in a window: all windows of a half have the bytes around the anchor in common,
which deals them out further. What still shares those bytes is compared by the construction, aligned at the anchor, so rounds are bounded by the
length of a context, not by the longest document. Columns go through sequential files in the shared folder when a collection is larger than
`memory`. Collections of more than `most` strings are halved again in the same way, down to single windows, which are equal if their bytes are.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import _text
from quillon.llm.rows import keyed
from quillon.runtime import bounded, materialize, shared_dir, ship

LENGTH = 400
GRAM = 16
OCCURRENCE = "anchor long, digest binary, doc long, tag long, start long, size int, lead int, behind int, ahead int"
PART = "key binary, anchor long, digest binary, low int, high int, base int, lead int, part binary"


def grams(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the 16 bytes from each position."""
    n = len(data) - GRAM + 1
    at = np.ndarray(n + 8, "<u8", np.ascontiguousarray(data), 0, (1,))
    x = at[:n] * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x += at[8:]
    return _text.mix(x)


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of `width` values."""
    n = len(v) - width + 1
    blocks = -(-len(v) // width)
    padded = np.full(blocks * width, np.iinfo(v.dtype).max, v.dtype)
    padded[: len(v)] = v
    grid = padded.reshape(blocks, width)
    down = np.minimum.accumulate(grid, axis=1).ravel()
    up = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(up[:n], down[width - 1 : width - 1 + n])


def contexts(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of consecutive texts: hash of the anchor, its position, and first and last window start, for every run of windows with one anchor."""
    if len(data) < length:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    h = grams(data)
    keyed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    least = sliding_least(keyed, length - GRAM + 1)
    inside = np.zeros(len(least) + 1, np.int8)
    long = at[1:] - at[:-1] >= length
    np.add.at(inside, at[:-1][long], 1)
    np.add.at(inside, at[1:][long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]))
    where = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else np.zeros(0, np.int64)
    pos = where[cut]
    return h[pos], pos, starts[cut], starts[np.append(cut[1:], len(starts)) - 1] if len(cut) else starts[:0]


def _pieces(data: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts, and a long text in overlapping pieces: first text, offset of the piece in it, bytes, boundaries."""
    for a, b in _text.runs(at):
        if b - a == 1 and at[b] - at[a] > 2 * _text.CHUNK:
            for s in range(int(at[a]), int(at[b]) - length + 1, _text.CHUNK):
                piece = data[s : min(s + _text.CHUNK + length - 1, at[b])]
                yield a, s - int(at[a]), piece, np.array([0, len(piece)])
        else:
            yield a, 0, data[at[a] : at[b]], at[a : b + 1] - at[a]


def _windows(low: int, high: int, lead: int, size: int) -> tuple[int, int]:
    """First and last window of a context whose anchor stands at low to high - 1 in the window. lead: where it stands in the context."""
    return max(0, lead - high + 1), min(size - 1, lead - low)


def _core(low: int, high: int, lead: int, length: int) -> tuple[int, int]:
    """The bytes of a context that all those windows have."""
    return lead - low, lead + length - high + 1


def _halves(low: int, high: int) -> tuple[tuple[int, int], tuple[int, int]]:
    middle = (low + high) // 2
    return (low, middle), (middle, high)


def occurrences(docs: DataFrame, length: int) -> DataFrame:
    """docs: doc, tag, text -> every context; behind and ahead: hash of what the windows of either half have in common, null without such windows."""
    (low, mid), (_, high) = _halves(0, length - GRAM + 1)

    @_text.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _text.buffers(batch.column(2))
            for first, offset, part, bounds in _pieces(data, at, length):
                anchor, pos, lo, hi = contexts(part, bounds, length)
                if not len(anchor):
                    continue
                doc = np.searchsorted(bounds, pos, "right") - 1
                raw = part.tobytes()
                digest = [hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(lo.tolist(), (hi + length).tolist())]
                lead, size = pos - lo, hi - lo + 1
                marks = []
                for a, b in ((mid, high), (low, mid)):
                    held = np.maximum(0, lead - b + 1) <= np.minimum(size - 1, lead - a)
                    crc = np.fromiter((zlib.crc32(raw[x - a : x + length - b + 1]) if h else 0 for x, h in zip(pos.tolist(), held.tolist())), np.uint32, len(pos))
                    marks.append(pa.array(crc.view(np.int32), mask=~held))
                rows = pa.array(first + doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(digest, pa.binary()), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(lo - bounds[doc] + offset), pa.array(size.astype(np.int32)), pa.array(lead.astype(np.int32)), *marks],
                    ["anchor", "digest", "doc", "tag", "start", "size", "lead", "behind", "ahead"],
                )

    return docs.mapInArrow(run, OCCURRENCE)


class Columns:
    """A collection of strings, given out symbol column by symbol column from the right; over `memory` bytes through files that are read once, in order."""

    def __init__(self, folder: str, memory: int):
        self.folder, self.memory, self.rows, self.held, self.files = folder, memory, [], 0, []
        self.left, self.right = [], []

    def add(self, text: bytes, lead: int) -> None:
        """lead: where in text the anchor starts."""
        self.rows.append(text)
        self.left.append(-lead)
        self.right.append(len(text) - lead)
        self.held += len(text)
        if self.held > self.memory:
            self._spool()

    def _block(self) -> tuple[np.ndarray, int, int]:
        n = len(self.rows)
        left, right = np.array(self.left[-n:]), np.array(self.right[-n:])
        lo, hi = int(left.min()), int(right.max())
        grid = np.zeros((n, hi - lo), np.uint8)
        for i, t in enumerate(self.rows):
            grid[i, left[i] - lo : right[i] - lo] = np.frombuffer(t, np.uint8)
        return np.ascontiguousarray(grid.T), lo, hi

    def _spool(self) -> None:
        grid, lo, hi = self._block()
        fs, root = pafs.FileSystem.from_uri(self.folder)
        fs.create_dir(root, recursive=True)
        path = f"{root}/{uuid.uuid4().hex}"
        with fs.open_output_stream(path) as out:
            out.write(np.ascontiguousarray(grid[::-1]))
        self.files.append((fs, path, grid.shape[1], lo, hi))
        self.rows, self.held = [], 0

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        """(column, symbols of all strings), from the last column to the first; symbols outside a string mean nothing."""
        last, blocks = None, []
        if self.rows:
            last = self._block()
        opened = [(fs.open_input_stream(path), n, lo, hi) for fs, path, n, lo, hi in self.files]
        try:
            for j in range(max(self.right) - 1, min(self.left) - 1, -1):
                blocks = [np.frombuffer(f.read(n), np.uint8) if lo <= j < hi else np.zeros(n, np.uint8) for f, n, lo, hi in opened]
                if last:
                    grid, lo, hi = last
                    blocks.append(grid[j - lo] if lo <= j < hi else np.zeros(grid.shape[1], np.uint8))
                yield j, np.concatenate(blocks) if len(blocks) > 1 else blocks[0]
        finally:
            for f, *_ in opened:
                f.close()
            for fs, path, *_ in self.files:
                fs.delete_file(path)


def repeated_windows(columns: Columns, group: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string, for each of its windows (len - length + 1): whether another string of its group has it at the same place from the anchor.

    group: ascending number of each string's group. Order and common prefixes of the strings that have begun are updated in each round.
    """
    left, right = np.array(columns.left), np.array(columns.right)
    sizes = right - left - length + 1
    flags = [np.zeros(max(n, 0), bool) for n in sizes]
    hits: list[tuple[int, np.ndarray]] = []
    order, common = np.zeros(0, np.int64), np.zeros(0, np.int64)  # common[r]: shared symbols of order[r - 1] and order[r]
    begins = {int(j): np.flatnonzero(right - 1 == j) for j in np.unique(right - 1)}
    ends = {int(j): True for j in np.unique(left)}
    for j, symbols in columns:
        if j in begins:  # a string with nothing to its right goes before all others and shares nothing
            order = np.concatenate([begins[j], order])
            common = np.concatenate([np.zeros(len(begins[j]), np.int64), common])
            if len(common) > len(begins[j]):
                common[len(begins[j])] = 0
        key = group[order] * 256 + symbols[order]
        to = np.argsort(key, kind="stable")
        sorted_key = key[to]
        fresh = np.zeros(len(to), np.int64)
        same = np.flatnonzero(sorted_key[1:] == sorted_key[:-1]) + 1
        if len(same):
            apart = to[same] - to[same - 1]
            near = apart == 1
            value = np.empty(len(same), np.int64)
            value[near] = common[to[same[near]]]
            far = np.flatnonzero(~near)
            if len(far):
                pair = np.empty(2 * len(far), np.int64)
                pair[0::2], pair[1::2] = to[same[far] - 1] + 1, to[same[far]] + 1
                value[far] = np.minimum.reduceat(np.append(common, 0), pair)[0::2]
            fresh[same] = np.minimum(value + 1, length)
        order, common = order[to], fresh
        full = common >= length
        if full.any():
            hit = full.copy()
            hit[:-1] |= full[1:]
            hits.append((j, order[hit]))
        if j in ends:
            stay = left[order] != j
            if not stay.all():  # what a leaving string shared with both neighbours, they share with each other
                kept = np.flatnonzero(stay)
                if len(kept):
                    common = np.minimum.reduceat(common[: kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1]))
                    common[0] = 0
                order, common = order[kept], common[: len(kept)]
    for j, who in hits:
        for i in who.tolist():
            k = j - left[i]
            if 0 <= k < len(flags[i]):
                flags[i][k] = True
    return flags


def spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs [lo, hi) of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist()))


def _judged(length: int, folder: str, memory: int):
    """Parts sorted by key -> (anchor, digest, lo, hi): runs of repeated windows, by their place in the context."""

    @_text.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        columns, groups, group, key, waiting = Columns(folder, memory), [], -1, None, None

        def judge() -> pa.RecordBatch:
            flags = repeated_windows(columns, np.array(groups), length) if held else []
            found = [(a, d, base + x, base + y) for (a, d, base), f in zip(held, flags) for x, y in spans(f)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * 4, (pa.int64(), pa.binary(), pa.int32(), pa.int32()))], ["anchor", "digest", "lo", "hi"])

        def add(row: tuple) -> None:
            _, a, digest, base, lead, part = row
            held.append((a, digest, base))
            groups.append(group)
            columns.add(part, lead)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "anchor", "digest", "base", "lead", "part"))):
                if row[0] != key:  # one that is alone with its key is not repeated
                    key, waiting = row[0], row
                    continue
                if waiting is not None:
                    if columns.held > memory // 2 or columns.files:  # whole groups only
                        yield judge()
                        held, columns, groups, group = [], Columns(folder, memory), [], -1
                    group += 1
                    add(waiting)
                    waiting = None
                add(row)
        if held:
            yield judge()

    return run


def _part(anchor: int, digest: bytes, low: int, high: int, context: bytes, base: int, lead: int, length: int) -> tuple | None:
    """The windows of a context (or a part of one, from `base` on) whose anchor stands at low to high - 1, and the key that equal ones share."""
    first, last = _windows(low, high, lead, len(context) - length + 1)
    if first > last:
        return None
    x, y = _core(low, high, lead, length)
    key = hashlib.blake2b(context[x:y], digest_size=16, key=f"{anchor}:{low}:{high}".encode()).digest()
    return key, anchor, digest, low, high, base + first, lead - first, context[first : last + length]


_PART_TYPES = (pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
_PART_NAMES = ["key", "anchor", "digest", "low", "high", "base", "lead", "part"]


def _part_batches(rows: Iterator[tuple | None]) -> Iterator[pa.RecordBatch]:
    """Batches that end at a few MB."""
    held, size = [], 0
    for r in rows:
        if r is None:
            continue
        held.append(r)
        size += len(r[7])
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _PART_TYPES)], _PART_NAMES)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _PART_TYPES)], _PART_NAMES)


def _fetched(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted (doc, tag, anchor, digest, start, size, lead, low, high) as parts. Each text is read once for all that is wanted of it, and only texts
    of which something is wanted leave their place."""
    lists = wanted.groupBy("doc", "tag").agg(F.collect_list(F.struct("anchor", "digest", "start", "size", "lead", "low", "high")).alias("cuts"))
    lists = materialize(lists, "cuts")
    some = docs.join(bounded(lists.select("doc", "tag")), ["doc", "tag"], "left_semi").dropDuplicates(["doc", "tag"])

    @_text.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = _text.buffers(b.column(0))
            cuts = b.column(1)

            def parts(b=b, data=data, at=at, cuts=cuts) -> Iterator[tuple | None]:
                for i in range(b.num_rows):
                    for c in cuts[i].as_py():
                        x = int(at[i]) + c["start"]
                        context = data[x : x + c["size"] + length - 1].tobytes()
                        yield _part(c["anchor"], c["digest"], c["low"], c["high"], context, 0, c["lead"], length)

            yield from _part_batches(parts())

    return some.join(lists, ["doc", "tag"]).select("text", "cuts").mapInArrow(run, PART)


def _halved(parts: DataFrame, length: int) -> DataFrame:
    """Every part as its two halves, with keys of their own."""

    @_text.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("anchor", "digest", "low", "high", "base", "lead", "part")))
            yield from _part_batches(_part(a, d, x, y, part, base, lead, length) for a, d, low, high, base, lead, part in rows for x, y in _halves(low, high))

    return parts.mapInArrow(run, PART)


def _ranges(parts: DataFrame, length: int, memory: int, most: int) -> DataFrame:
    """(anchor, digest, lo, hi): the windows of each context that another context of its anchor has too, at the same place."""
    folder, found = f"{shared_dir(parts.sparkSession)}/quillon/columns", []
    while True:
        keys = parts.groupBy("key").agg(F.count("*").alias("n"), F.first("low").alias("low"), F.first("high").alias("high"))
        crowded = materialize(keys.where((F.col("n") > most) & (F.col("high") - F.col("low") > 1)).select("key"), "crowded")
        rest = parts.join(bounded(crowded), "key", "left_anti").repartition("key").sortWithinPartitions("key")
        several = rest.where("high - low > 1").mapInArrow(_judged(length, folder, memory), "anchor long, digest binary, lo int, hi int")
        single = materialize(keys.where("n > 1 AND high - low = 1").select("key"), "single")
        found.append(several)
        if not single.isEmpty():
            found.append(parts.where("high - low = 1").join(bounded(single), "key", "left_semi").select("anchor", "digest", F.col("base").alias("lo"), (F.col("base") + 1).alias("hi")))
        if crowded.isEmpty():
            break
        parts = materialize(_halved(parts.join(bounded(crowded), "key", "left_semi"), length), "parts")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return materialize(out, "ranges")


def repeated_spans(docs: DataFrame, length: int = LENGTH, memory: int = 32 << 20, most: int = 50_000) -> DataFrame:
    """(doc, tag, lo, hi): byte ranges [lo, hi) that strings of `length` bytes cover that also start elsewhere; ranges may overlap.

    docs: doc, tag and text; rows that are equal in doc and tag have equal texts. memory: bytes of contexts that a task holds before it uses files.
    most: strings that are compared at once; larger collections are halved, with the same result.
    """
    spark = docs.sparkSession
    ship(spark)
    seen = materialize(occurrences(docs, length), "occurrences")
    anchors = seen.groupBy("anchor").agg(F.count("*").alias("n"), F.min("digest").alias("first"), F.max("digest").alias("last")).where("n > 1").select("anchor", (F.col("first") != F.col("last")).alias("mixed"))
    anchors = materialize(anchors, "anchors")  # written first: a join of two plain shuffles can be split where an anchor stands in very many places
    again = materialize(seen.join(anchors, "anchor"), "again")
    one = F.min(F.struct("doc", "tag", "start", "size", "lead", "behind", "ahead")).alias("at")
    kinds = again.where("mixed").groupBy("anchor", "digest").agg(F.count("*").alias("n"), one).select("anchor", "digest", "n", "at.*")
    kinds = materialize(kinds, "kinds")
    (low, mid), (_, high) = _halves(0, length - GRAM + 1)
    sides = F.array(*(F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), F.col(c).alias("mark")) for a, b, c in ((low, mid, "ahead"), (mid, high, "behind"))))
    halves = kinds.withColumn("side", F.explode(sides)).select("anchor", "digest", "doc", "tag", "start", "size", "lead", "side.*").where("mark IS NOT NULL")
    shared = materialize(halves.groupBy("anchor", "low", "mark").agg(F.count("*").alias("unlike")).where("unlike > 1").drop("unlike"), "shared")
    wanted = materialize(halves.join(bounded(shared), ["anchor", "low", "mark"], "left_semi"), "wanted")
    ranges = _ranges(materialize(_fetched(docs, wanted, length), "parts"), length, memory, most)

    copies = kinds.where("n > 1").select("anchor", "digest")
    whole = again.where("NOT mixed").select("doc", "tag", F.col("start").alias("lo"), (F.col("start") + F.col("size")).alias("hi"))
    whole = whole.union(again.where("mixed").join(copies, ["anchor", "digest"], "left_semi").select("doc", "tag", "start", F.col("start") + F.col("size")))
    partly = again.where("mixed").join(ranges, ["anchor", "digest"]).select("doc", "tag", F.col("start") + F.col("lo"), F.col("start") + F.col("hi"))
    return whole.union(partly).select("doc", "tag", "lo", (F.col("hi") + length - 1).alias("hi"))


def _cut(texts: pa.Array, found: pa.Array) -> Iterator[tuple[int, int, int, bytes]]:
    """Bytes, removed bytes, removed runs and what is left, for each text."""
    data, at = _text.buffers(texts)
    for i, ranges in enumerate(found.to_pylist()):
        raw, kept, end, runs, removed = data[at[i] : at[i + 1]], [], 0, 0, 0
        last = None
        for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges or ()):
            if last is None or lo > last:
                runs += 1
                kept.append(raw[end:lo].tobytes())
                removed += hi - lo
                last = end = hi
            elif hi > last:
                removed += hi - last
                last = end = hi
        kept.append(raw[end:].tobytes())
        yield len(raw), removed, runs, b"".join(kept)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **limits: int) -> DataFrame:
    """For every row: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay).

    Texts are UTF-8 bytes, null counts as empty. Every byte is removed that a string of `length` bytes covers which starts anywhere else too, in
    the same document or another; strings are judged on the input. Texts shorter than `length` stay whole. Rows are told apart by id and text, so ids
    may be null or repeated: every row counts as a document, and rows with equal texts lose the same bytes. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = keyed(docs)
    found = repeated_spans(docs.select("doc", "tag", "text"), length, **limits).groupBy("doc", "tag").agg(F.collect_set(F.struct("lo", "hi")).alias("found"))

    @_text.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(_cut(b.column(1), b.column(2)))
            n, removed, runs, kept = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = docs.join(found, ["doc", "tag"], "left").select("doc_id", "text", "found")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("has_repeats"), (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"))


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substring(h, 2 * i + 1, 800)) AS m FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 399)) AS i FROM d)),
t AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
s AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM w SEMI JOIN t USING (m)),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
r AS (SELECT doc_id, run, min(i) AS lo, max(i) + 400 AS hi FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM r),
c AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substring(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS before, max(hi) AS last
  FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(before, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256, coalesce(n_removed, 0) > 0 AS has_repeats,
  CAST(len(h) // 2 AS BIGINT) - coalesce(n_removed, 0) AS n_kept
FROM d LEFT JOIN c USING (doc_id)"""
