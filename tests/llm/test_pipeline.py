import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from quillon.llm import mixing, pieces, toxicity
from test_dedup import re, shingles
from test_others import needs_vocabulary, water

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def without_copies(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append(r)
    return [min(g, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0)) for g in groups.values()]


def without_near_copies(rows):
    sets = [shingles(r["text"], 5) if r["doc_id"] is not None else set() for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i])
    return [min(g, key=lambda r: r["doc_id"] or 0) for g in groups.values()]


def taken(rows):
    """(row, copy, position) of each pass that takes half of a row or more."""
    sources = sorted({r["source"] for r in rows if r["source"] is not None}) + [None] * any(r["source"] is None for r in rows)
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows]
    sizes = [sum(n for r, n in zip(rows, size) if r["source"] == s) for s in sources]
    out, grid = [], np.linspace(0, 1, 20_001)
    for k, (s, total, target) in enumerate(zip(sources, sizes, water(sizes, [1 + i % 3 for i in range(len(sources))]))):
        rate = np.interp(grid, *zip(*mixing.SCHEDULES[k % 3]))
        spent = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
        own = sorted((i for i, r in enumerate(rows) if r["source"] == s), key=lambda i: (hashlib.md5(str("" if rows[i]["doc_id"] is None else rows[i]["doc_id"]).encode()).hexdigest(), size[i]))
        at, copy, goal = 0, 1, round(target)
        while at < goal:
            for i in own:
                words = min(size[i], goal - at)
                if words > 0 and 2 * words >= size[i]:
                    out.append((rows[i], copy, float(np.interp((at + words / 2) / goal, spent / spent[-1], grid))))
                at += words
            copy += 1
    return out


def ids_of(encoder, text, doc, copy):
    words = pieces._WORDS.findall(" " + text) if text else []
    seed = np.uint64(int.from_bytes(hashlib.blake2b(f"{encoder.seed}:{doc}:{copy}".encode(), digest_size=8).digest(), "big"))
    return [i for w, key in zip(words, encoder._keys(seed, 0, len(words)).tolist()) for i in pieces.segment(w, encoder.vocab, key, encoder.limit)]


@needs_vocabulary
def test_pipeline_matches_brute_force(spark, small, tmp_path):
    rows = [r.asDict() for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").limit(120).collect()]
    rows = [r | {"text": r["text"][:6000]} for r in rows]
    copy = rows[7]["text"]
    for doc_id, text, source in ((None, copy, "s"), (None, "an entirely other text without id", None), (None, None, None), (5000, "", "s"), (5001, " \n", None), (5002, copy, "s"), (5002, copy, "s"), (5002, "one id and two unlike texts", "t"), (5003, f"{copy} and one word more", None)):
        rows.append({"doc_id": doc_id, "text": text, "lang": None, "source": source, "n_chars": None})
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], COLUMNS).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    model = toxicity.fit(docs, labels.select("doc_id", "toxic"))
    scores = {t: model.score(next(iter(toxicity.features(*toxicity._text.buffers(toxicity.pa.array([t])))), np.zeros(0, np.int32))) for t in {r["text"] or "" for r in rows}}
    left = [r for r in rows if scores[r["text"] or ""] < 0.5]
    encoder = pieces.Encoder()
    want = [(r, c, p, ids_of(encoder, r["text"], r["doc_id"], c)) for r, c, p in taken(without_near_copies(without_copies(left)))]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((g.doc_id, g.source, g.copy, tuple(g.ids)) for g in got) == Counter((r["doc_id"], r["source"], c, tuple(i)) for r, c, _, i in want)
    places = defaultdict(list)
    for r, c, p, _ in want:
        places[r["doc_id"], c].append(p)
    assert all(min(abs(g.position - p) for p in places[g.doc_id, g.copy]) < 1e-3 and g.n_pieces == len(g.ids) for g in got)
    assert max(g.copy for g in got) > 1


@needs_vocabulary
def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "minhash near-dedup", "mixing", "sentencepiece"] and Path(corpus_pipeline.__file__).parent == Path(__file__).parents[2]
