"""SentencePiece encoding with seeded merge-dropout, and decoding.

Merges of neighbouring symbols are taken from an agenda, best score first, leftmost of equals. Each candidate that is met is skipped with the dropout
rate, as the library does it: the draw is a hash of the seed, the document, the copy of it, the word's place in it and the candidate's number in the
word. Every occurrence of a word thus has draws of its own, and the same text has other segmentations under other seeds, and the same under the same.
What a word becomes depends only on the numbers of the candidates that were skipped, so the results are remembered by these (within a bound), which
changes none of them. Those that are new are segmented together: words of one length share an agenda whose best entries are taken in lockstep, with
numpy. Words with characters that have no piece have an agenda of their own (a heap), with the same result; so have long words, which are not
remembered. Characters without a piece become byte pieces, and so does a literal U+2581, which would otherwise turn into a space: decoding gives back
every text.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quillon.llm import _text
from quillon.runtime import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 20240229
#: Segmentations that a worker remembers, and characters of text that it works on at once.
REMEMBERED, AT_ONCE = 100_000, 3 << 19
#: Longest word of the shared agenda (its positions take five bits), and fewest words of one length for which it pays.
SHARED, FEWEST = 24, 24
#: Merges never cross a line feed or the start of a run of spaces.
_WORDS = re.compile(r" +[^ \n]*|\n|[^ \n]+")
_BREAK = re.compile(r"(?<! ) |\n")
_MASK = (1 << 64) - 1
_NEVER = np.int32(2**31 - 1)
_HASHING = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


class Vocabulary:
    """Pieces (with spaces in place of U+2581), their scores, and which pairs of pieces merge into which."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i).replace("▁", " "): i for i in plain}
        self.scores = {p: (-sp.get_score(i), i) for p, i in self.ids.items()}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = [b""] * len(ids)
        for p, i in self.ids.items():
            self.bytes[i] = p.encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])
        self.letters = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.letters[ord(p)] = i
        #: rank[piece]: place among the scores, equal for equal scores
        self.rank = np.zeros(len(ids), np.int32)
        place = {s: k for k, s in enumerate(sorted({s for s, _ in self.scores.values()}))}
        for s, i in self.scores.values():
            self.rank[i] = place[s]
        self._pairs()

    def _pairs(self) -> None:
        """An open-addressing table of pairs of pieces whose concatenation is a piece."""
        found = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    found[a << 32 | b] = i
        bits = max(4, (4 * len(found)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.merged = np.full(1 << bits, _MASK, np.uint64), np.full(1 << bits, -1, np.int32)
        keys, values = np.array(list(found), np.uint64), np.array(list(found.values()), np.int32)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == _MASK)
            first = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[first]], self.merged[at[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(_HASHING[0])) >> self.shift).astype(np.int64)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that a and b make, -1 for none (also where a or b is -1)."""
        keys = a.astype(np.uint64) << np.uint64(32) | (b.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.merged[at], np.int32(-1))
        left = np.flatnonzero((seen != keys) & (seen != _MASK))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            seen = self.keys[at[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.merged[at[left[hit]]]
            left = left[~hit & (seen != _MASK)]
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _draws(keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The draws (of 2 ** 32) of words with these keys for their candidates of these numbers."""
    return _text.mix(keys ^ (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(_HASHING[1])) >> np.uint64(32)


def _draw(key: int, number: int) -> int:
    """_draws() of one."""
    x = (key ^ (number + 1) * _HASHING[1]) & _MASK
    x = (x ^ x >> 30) * _HASHING[2] & _MASK
    x = (x ^ x >> 27) * _HASHING[3] & _MASK
    return (x ^ x >> 31) >> 32


def _walk(word: str, vocab: Vocabulary, skipped: Callable[[int], bool]) -> tuple[list[int], int]:
    """Piece ids of one word, and how many candidates were met. skipped: of a candidate's number."""
    scores, n, met = vocab.scores, len(word), 0
    parts: list[str | None] = list(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple[float, int, str]] = []

    def offer(i: int, j: int) -> None:
        found = scores.get(parts[i] + parts[j])
        if found is not None:
            heapq.heappush(agenda, (found[0], i, parts[i] + parts[j]))

    for i in range(n - 1):
        offer(i, i + 1)
    while agenda:
        _, i, merged = heapq.heappop(agenda)
        j = after[i] if parts[i] is not None else n
        if j >= n or parts[i] + parts[j] != merged:
            continue
        met += 1
        if skipped(met - 1):
            continue
        parts[i], parts[j] = merged, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            offer(i, k)
        if before[i] >= 0:
            offer(before[i], i)
    out: list[int] = []
    for p in parts:
        if p is not None:
            found = vocab.ids.get(p)
            out.extend([found] if found is not None else [vocab.byte_ids[b] for b in p.encode()])
    return out, met


def segment(word: str, vocab: Vocabulary, key: int, limit: int) -> list[int]:
    """Piece ids of one word. A candidate whose draw is below limit (of 2 ** 32) is skipped."""
    return _walk(word, vocab, lambda number: _draw(key, number) < limit)[0]


def segment_all(letters: np.ndarray, vocab: Vocabulary, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """letters: ids of single characters, a column for each word, all of one length; skips: 128 bits for each word (two rows), set for candidates that
    are skipped. -> the pieces in the same grid, -1 where a piece goes on, and how many candidates each word met.

    Every round takes the best candidate of every word that has one; a word is done when it has none.
    """
    n, width = letters.shape
    out, met_out = letters.copy(), np.zeros(width, np.int64)
    sym, who, met = letters.copy(), np.arange(width), np.zeros(width, np.int64)
    after = np.repeat(np.arange(1, n + 1, dtype=np.int8)[:, None], width, 1)
    before = np.repeat(np.arange(-1, n - 1, dtype=np.int8)[:, None], width, 1)
    made = np.full((n, width), -1, np.int32)
    order = np.full((n, width), _NEVER, np.int32)

    def offer(i: np.ndarray, j: np.ndarray, cols: np.ndarray) -> None:
        piece = vocab.merge(sym[i, cols], sym[j, cols])
        made[i, cols] = piece
        order[i, cols] = np.where(piece >= 0, vocab.rank[piece] << 5 | i, _NEVER)

    every = np.arange(width)
    for i in range(n - 1):
        offer(np.full(width, i), np.full(width, i + 1), every)
    while True:
        best = order.min(axis=0)
        cols = np.flatnonzero(best != _NEVER)
        if len(cols) < 0.6 * len(best):
            out[:, who], met_out[who] = sym, met
            if not len(cols):
                return out, met_out
            sym, after, before, made, order, skips, met, who, best = (x[..., cols] for x in (sym, after, before, made, order, skips, met, who, best))
            cols = np.arange(len(cols))
        i = (best[cols] & 31).astype(np.int64)
        order[i, cols] = _NEVER
        number = met[cols]
        met[cols] += 1
        taken = (skips[number >> 6, cols] >> (number & 63).astype(np.uint64) & np.uint64(1)) == 0
        i, cols = i[taken], cols[taken]
        j = after[i, cols].astype(np.int64)
        k = after[j, cols].astype(np.int64)
        h = before[i, cols].astype(np.int64)
        sym[i, cols], sym[j, cols] = made[i, cols], -1
        after[i, cols] = k
        order[j, cols] = _NEVER
        more = k < n
        before[k[more], cols[more]] = i[more]
        offer(i[more], k[more], cols[more])
        more = h >= 0
        offer(h[more], i[more], cols[more])


class Encoder:
    """Encodes texts; remembers what words become with each set of skipped candidates, within a bound."""

    def __init__(self, path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED):
        self.vocab, self.limit, self.seed = vocabulary(path), int(dropout * 2**32), seed
        #: The key of an occurrence of a word is any number of 64 bits; these are the first few, among which one does without dropout.
        self.streams = 4 if dropout else 1
        self.keys = np.arange(self.streams, dtype=np.uint64)
        self._forget()

    def _forget(self) -> None:
        #: Of a word without skips, and of number << 32 | candidate for what is as that number but skips this later candidate too.
        self.numbers: dict[str | int, int] = {}
        self.words: list[str] = []
        self.skips = np.zeros((2, 0), np.uint64)
        #: By number: where its ids start in flat, how many they are, and how many candidates it meets.
        self.start, self.size, self.met = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)

    def _learn(self, fresh: list[str] | np.ndarray) -> None:
        """Numbers and segments what is not known yet: distinct words, or what skips one more candidate."""
        n = len(fresh)
        if not n:
            return
        if isinstance(fresh, list):
            words, skips = fresh, np.zeros((2, n), np.uint64)
            self.numbers.update(zip(fresh, range(len(self.words), len(self.words) + n)))
        else:
            self.numbers.update(zip(fresh.tolist(), range(len(self.words), len(self.words) + n)))
            parents, number = fresh >> 32, fresh & 0xFFFFFFFF
            words, skips = [self.words[p] for p in parents.tolist()], self.skips[:, parents]
            skips[number >> 6, np.arange(n)] |= np.uint64(1) << (number & 63).astype(np.uint64)
        self.words += words
        start, size, met = np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        found, rest = [self.flat], []
        end = len(self.flat)
        bounds = np.searchsorted(lengths[order], np.arange(SHARED + 2))
        for n in range(1, SHARED + 1):
            for low in range(bounds[n], bounds[n + 1], 1 << 15):
                at = order[low : min(low + (1 << 15), bounds[n + 1])]
                if len(at) < FEWEST:
                    rest += at.tolist()
                    continue
                codes = np.frombuffer("".join([words[w] for w in at.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n)
                letters = self.vocab.letters[codes]
                plain = (letters >= 0).all(1)
                rest += at[~plain].tolist()
                at = at[plain]
                if not len(at):
                    continue
                grid, met[at] = segment_all(np.ascontiguousarray(letters[plain].T), self.vocab, skips[:, at])
                grid = grid.T
                stays = grid >= 0
                size[at] = counts = stays.sum(1)
                start[at] = end + np.cumsum(counts) - counts
                found.append(grid[stays])
                end += len(found[-1])
        for at in rest:
            bits = int(skips[0, at]) | int(skips[1, at]) << 64
            ids, met[at] = _walk(words[at], self.vocab, lambda number, bits=bits: bool(bits >> number & 1))
            start[at], size[at] = end, len(ids)
            found.append(np.array(ids, np.int32))
            end += len(ids)
        self.flat = np.concatenate(found)
        self.start, self.size, self.met = (np.concatenate(x) for x in ((self.start, start), (self.size, size), (self.met, met)))
        self.skips = np.concatenate([self.skips, skips], 1)

    def _find(self, words: list[str], keys: np.ndarray) -> np.ndarray:
        """The number of what each of these words (of at most SHARED characters) becomes under its key."""
        self._learn(list(set(words).difference(self.numbers)))
        at = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        left, number = np.arange(len(words) if self.limit else 0), np.zeros(len(words), np.int64)
        while len(left):
            skipping = []
            while len(left := left[number[left] < self.met[at[left]]]):
                skips = _draws(keys[left], number[left]) < self.limit
                skipping.append(left[skips])
                left = left[~skips]
                number[left] += 1
            left = np.concatenate([np.zeros(0, np.int64), *skipping])
            distinct, which = np.unique(at[left] << 32 | number[left], return_inverse=True)
            known = np.fromiter(map(self.numbers.get, distinct.tolist(), repeat(-1)), np.int64, len(distinct))
            new = known < 0
            known[new] = np.arange(len(self.words), len(self.words) + new.sum())
            self._learn(distinct[new])
            at[left] = known[which]
            number[left] += 1
        return at

    def _ids(self, words: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each with the draws of its key, and how many each has."""
        if len(self.numbers) > REMEMBERED:
            self._forget()
        keys = keys.astype(np.uint64)
        long = [k for k, w in enumerate(words) if len(w) > SHARED]
        extra = []
        if long:
            words = list(words)
            for k in long:
                extra.append(np.array(segment(words[k], self.vocab, int(keys[k]), self.limit), np.int32))
                words[k] = ""
        at = self._find(words, keys)
        del words
        start, size, flat = self.start[at], self.size[at].astype(np.int64), self.flat
        if long:
            counts = np.fromiter(map(len, extra), np.int64, len(extra))
            size[long], start[long] = counts, len(flat) + np.cumsum(counts) - counts
            flat = np.concatenate([flat, *extra])
        ends = np.cumsum(size)
        place = np.repeat((start - ends + size).astype(np.int32), size)
        place += np.arange(len(place), dtype=np.int32)
        return flat[place], size

    def _parts(self, text: str) -> Iterator[list[str]]:
        """The words of a text (with the space that is put before it), AT_ONCE characters at a time where they part."""
        text, at = " " + text, 0
        while at < len(text):
            end = len(text)
            if end - at > AT_ONCE and (cut := _BREAK.search(text, at + AT_ONCE)):
                end = cut.start()
            yield _WORDS.findall(text, at, end)
            at = end

    def encode_all(self, texts: list[str | None], docs: list, copies: list | None = None) -> Iterator[np.ndarray]:
        """The ids of each text; docs: what names each; copies: which copy of it each is (by default 1). Null and empty texts have none."""
        held: list[str] = []
        counts: list[int] = []
        seeds: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[np.ndarray]:
            ids, sizes = self._ids(held, np.concatenate(seeds) if seeds else np.zeros(0, np.uint64))
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *counts])]
            yield from (ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()))

        for text, doc, copy in zip(texts, docs, copies or [1] * len(docs)):
            seed = np.uint64(int.from_bytes(hashlib.blake2b(f"{self.seed}:{doc}:{copy}".encode(), digest_size=8).digest(), "big"))
            if text and len(text) > 2 * AT_ONCE:
                yield from flush()
                held, counts, seeds, size = [], [], [], 0
                long, n = [], 0
                for part in self._parts(text):
                    long.append(self._ids(part, self._keys(seed, n, len(part)))[0])
                    n += len(part)
                yield np.concatenate(long)
                continue
            words = _WORDS.findall(" " + text) if text else []
            held += words
            counts.append(len(words))
            seeds.append(self._keys(seed, 0, len(words)))
            size += len(text or "")
            if size > AT_ONCE:
                yield from flush()
                held, counts, seeds, size = [], [], [], 0
        yield from flush()

    def _keys(self, seed: np.uint64, first: int, n: int) -> np.ndarray:
        """The keys of n words from word `first` of a text."""
        return _text.mix(seed + np.arange(first, first + n, dtype=np.uint64) * np.uint64(_HASHING[0]))

    def encode(self, text: str | None, doc: object = None, copy: int = 1) -> list[int]:
        return next(self.encode_all([text], [doc], [copy])).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.vocab.bytes.__getitem__, ids)).decode()[1:]


def with_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, copy_col: str | None = None) -> DataFrame:
    """docs with a column ids (in place of one of that name). Null and empty texts have no ids; rows that repeat an id and a text have equal ids, but
    for those that copy_col tells apart.

    A null id is a key like others. model: a SentencePiece model file of merge type that every executor has.
    """
    ship(docs.sparkSession)
    docs = docs.drop("ids")
    key, at = docs.columns.index(id_col), docs.columns.index(text_col)
    nth = None if copy_col is None else docs.columns.index(copy_col)

    @_text.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, dropout, seed)
        for b in batches:
            values, ends, done = [], [0], 0
            copies = None if nth is None else b.column(nth).to_pylist()
            for i, found in enumerate(encoder.encode_all(b.column(at).to_pylist(), b.column(key).to_pylist(), copies)):
                values.append(found)
                ends.append(ends[-1] + len(values[-1]))
                if ends[-1] > 1 << 20 or i == b.num_rows - 1:
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values)))
                    part = b.slice(done, i + 1 - done)
                    yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, "ids"])
                    values, ends, done = [], [0], i + 1

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """For every row: doc_id, ids; as with_ids()."""
    rows = docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text")
    return with_ids(rows, model=model, dropout=dropout, seed=seed).select("doc_id", "ids")


def decoded(pieces: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded() -> doc_id, text. No ids (or null) give an empty text."""
    ship(pieces.sparkSession)

    @_text.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encoder.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return pieces.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


DIGESTS = "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string, lossless boolean"


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """encoded() and decoded() in one pass, as digests: ids_sha256 is of the ids as 32-bit little-endian numbers."""
    ship(docs.sparkSession)

    @_text.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, dropout, seed)
        for b in batches:
            rows = []
            docs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for doc, text, ids in zip(docs, texts, encoder.encode_all(texts, docs)):
                back = encoder.decode(ids.tolist())
                rows.append((doc, len(ids), hashlib.sha256(ids.astype("<i4")).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == (text or "")))
            columns = zip(*rows) if rows else [()] * 5
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "lossless"])

    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, DIGESTS)


def op9_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
