"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with two roots, one for the start of a word and one for what continues it. Every node has a failure link, the node that
stands for what is left after its longest pieces are taken off, and the number of pieces that following the link takes off. Reading a word is one
walk along its bytes that never goes back, and the number of greedy longest-match-first pieces is the sum of the counts on the way: no piece is built.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import _text
from quillon.runtime import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Words whose counts a worker remembers.
REMEMBERED = 400_000
#: Bytes of a text whose words are held at once.
AT_ONCE = 1 << 20


class Automaton:
    """first: pieces that start a word. further: pieces that continue one. Counts of words that no pieces make up are 1 (an unknown word)."""

    def __init__(self, first: Iterable[bytes], further: Iterable[bytes]):
        self.go: dict[int, int] = {}
        ends = {}
        nodes = 2
        for root, pieces in ((0, first), (1, further)):
            for piece in pieces:
                at = root
                for c in piece:
                    key = at << 8 | c
                    at = self.go.get(key, 0)
                    if not at:
                        at = self.go[key] = nodes
                        nodes += 1
                if at != root:
                    ends[at] = True
        self.fail, self.popped = [-1] * nodes, [0] * nodes
        below: dict[int, list[tuple[int, int]]] = {}
        for key, child in self.go.items():
            below.setdefault(key >> 8, []).append((key & 255, child))
        queue = deque((0, 1))
        while queue:  # by depth: the link of a node needs those of shorter strings
            node = queue.popleft()
            for c, child in below.get(node, ()):
                if child in ends:
                    self.fail[child], self.popped[child] = 1, 1
                else:
                    to, n = self.fail[node], self.popped[node]
                    while to >= 0 and to << 8 | c not in self.go:
                        n += self.popped[to]
                        to = self.fail[to]
                    if to >= 0:
                        self.fail[child], self.popped[child] = self.go[to << 8 | c], n
                queue.append(child)

    def count(self, word: bytes) -> int:
        go, fail, popped, at, n = self.go, self.fail, self.popped, 0, 0
        for c in word:
            to = go.get(at << 8 | c)
            while to is None:
                if fail[at] < 0:
                    return 1
                n += popped[at]
                at = fail[at]
                to = go.get(at << 8 | c)
            at = to
        while at > 1:
            if fail[at] < 0:
                return 1
            n += popped[at]
            at = fail[at]
        return n


def byte_letters() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces that start a word (written with a leading space) and pieces that continue one, of a byte-level vocabulary file."""
    letters = byte_letters()
    found = [bytes(letters[c] for c in p) for p in json.load(open(path, encoding="utf-8"))["model"]["vocab"] if all(c in letters for c in p)]
    return [p for p in found if p[:1] == b" " and p.count(b" ") == 1], [p for p in found if b" " not in p]


@cache
def automaton(path: str) -> Automaton:
    return Automaton(*pieces(path))


def _parts(text: np.ndarray) -> Iterator[bytes]:
    """A text in parts of about AT_ONCE bytes that end between words, so that the words of a very long one are never all held at once."""
    at = 0
    while len(text) - at > 2 * AT_ONCE:
        end = at + AT_ONCE
        while end < len(text) and not _text.SPACE[text[end]]:
            end += 1
        yield text[at:end].tobytes()
        at = end
    yield text[at:].tobytes()


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    r"""For every row: doc_id, n_words, n_tokens. Words are [^\x20\x09-\x0D]+; each is split greedily into the longest pieces, the first with a leading space.

    Null and empty texts count 0. A byte of another encoding is a byte like others. Null ids and repeated rows are rows like others; other columns
    are ignored. vocabulary: a byte-level vocabulary file that every executor has.
    """
    ship(docs.sparkSession)

    @_text.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = automaton(vocabulary), {}
        for b in batches:
            data, at = _text.buffers(b.column(1))
            words, tokens = [], []
            for i in range(b.num_rows):
                n = seen = 0
                for part in _parts(data[at[i] : at[i + 1]]):
                    found = part.split()
                    for w in found:
                        k = known.get(w)
                        if k is None:
                            k = machine.count(b" " + w)
                            if len(known) >= REMEMBERED:
                                known.clear()
                            if len(w) < 64:
                                known[w] = k
                        n += k
                    seen += len(found)
                words.append(seen)
                tokens.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
