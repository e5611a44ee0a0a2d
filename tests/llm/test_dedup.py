import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillon.llm import exact, near, repeats
from quillon.llm.components import components


def shingles(text, k):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(texts, k=5):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(3)
    texts, n = {}, 0
    for g in range(12):
        base = [f"w{rng.integers(400)}" for _ in range(int(rng.integers(3, 120)))]
        for _ in range(6):
            words = list(base)
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(len(words)))] = f"e{rng.integers(10**6)}"
            texts[n] = " ".join(words)
            n += 1
    texts |= {n: "", n + 1: None, n + 2: "one", n + 3: "ONE "}
    got = near.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shingle=4).collect()
    want = brute_components(texts, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_edges(edge, empty):
    got = near.near_duplicates(edge).collect()
    assert len(got) == edge.count()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [r.component_id for r in by[1]] == [1, 1] and by[6][0].component_id == 1 and not by[6][0].kept
    assert by[2][0].n_shingles == by[3][0].n_shingles == by[4][0].n_shingles == 0 and by[2][0].kept
    assert all(r.component_id is None and r.kept for r in by[None])
    assert near.near_duplicates(empty).count() == 0
    assert near.drop_near_duplicates(edge).columns == edge.columns


def test_near_duplicates_of_unlike_texts_under_one_id(spark):
    b = " ".join(f"w{i}" for i in range(50))
    rows = [(1, "quite another text of its own", "p"), (1, b, "q"), (2, f"{b} more", "r"), (3, "quite another text of its own", "s"), (3, b, "t"), (3, b, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near.near_duplicates(docs).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (3, 1, False)]
    assert sorted(r.row for r in near.drop_near_duplicates(docs).collect()) == ["p", "q"]


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(40):
            both = rng.integers(0, 2**63, 2000, dtype=np.uint64) * np.uint64(2)
            cut = int(2000 * (1 - share) / 2)
            a, b = np.unique(both[cut:]), np.unique(both[: len(both) - cut])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            sig = [near.registers(x)[None] for x in (a, b)]
            errors.append(near.estimate(*sig, np.array([len(a)]), np.array([len(b)]))[0] - true)
        assert abs(np.mean(errors)) < 0.03


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (10, 11), (11, 12), (12, 10), (7, 7), (20, 2), (5, 4)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 20: 2, 10: 10, 11: 10, 12: 10}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_duplicates(spark, edge, empty):
    rows = [(i, t) for i, t in enumerate(["a b", "ab", "a  b", "c", None, "", " ", "ab c", "abc"] * 3)]
    got = {r.doc_id: r for r in exact.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), fan=2, segments=3).collect()}
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in rows}
    for i, t in rows:
        same = [j for j in norm if norm[j] == norm[i]]
        keep = min(same, key=lambda j: (-len(rows[j][1] or ""), j))
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (keep, len(same), keep == i)
        assert got[i].text_sha256 == hashlib.sha256(norm[i].encode()).hexdigest()
    out = exact.exact_duplicates(edge).collect()
    assert len(out) == edge.count() and exact.exact_duplicates(empty).count() == 0
    assert exact.drop_exact_duplicates(edge).columns == edge.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in exact.drop_exact_duplicates(edge).collect()]
    assert sorted(texts) == sorted({re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in edge.collect()})


def test_exact_copies_under_one_id(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "c"), (None, "d"), (None, "d"), (2, "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sum(r.kept for r in exact.exact_duplicates(docs).collect()) == 3
    assert sorted(map(tuple, exact.drop_exact_duplicates(docs).collect()), key=str) == [(1, "a b"), (1, "c"), (None, "d")]


def test_segments_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(exact, "SEGMENT_ROWS", 7)
    rows = [(i, f"t{i % 40}") for i in range(200)]
    got = exact.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(9), fan=2).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {i: (min(j for j, t in rows if t == f"t{i % 40}" and len(t) == len(f"t{i % 40}")), 5) for i, _ in rows}


def brute_repeats(texts, length):
    count = Counter(t[i : i + length] for t in texts.values() for i in range(len(t) - length + 1))
    out = {}
    for k, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(t)))
        out[k] = (len(t), sum(gone), runs, bytes(x for x, g in zip(t, gone) if not g))
    return out


@pytest.mark.parametrize("limits", [{}, {"most": 1}, {"most": 3}, {"memory": 2_000}])
def test_repeats_match_brute_force(spark, limits):
    rng = np.random.default_rng(8)
    letters = list("abcdé ")
    base = "".join(rng.choice(letters, 900))
    texts = {i: "".join(rng.choice(letters, int(rng.integers(0, 300)))) + base[int(rng.integers(0, 300)) : int(rng.integers(500, 900))] + "".join(rng.choice(letters, 100)) for i in range(12)}
    texts |= {50: "ab" * 700, 51: "x" + "ab" * 300, 52: None, 53: "", 54: base}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.without_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), **limits).collect()}
    assert got == brute_repeats({i: (t or "").encode() for i, t in texts.items()}, 400)


def test_repeats_of_a_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(repeats._text, "CHUNK", 500)
    data = np.frombuffer(bytes(np.random.default_rng(1).integers(97, 101, 3000, dtype=np.uint8)), np.uint8)
    starts = []
    for _, offset, part, bounds in repeats._pieces(data, np.array([0, len(data)]), 400):
        _, _, lo, hi = repeats.contexts(part, bounds, 400)
        starts += [offset + i for a, b in zip(lo, hi) for i in range(a, b + 1)]
    assert starts == list(range(len(data) - 399))


def test_repeats_edges(edge, empty):
    assert repeats.without_repeats(edge).count() == edge.count()
    assert repeats.without_repeats(empty).count() == 0


def test_repeats_under_one_id_and_without_id(spark):
    rng = np.random.default_rng(2)
    base = "".join(rng.choice(list("abcdef "), 1500))
    rows = [(1, "x" + base[:700]), (1, "y" + base[300:]), (None, base[200:900]), (None, None), (2, "z" * 100), (3, base[:460]), (3, base[:460])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.without_repeats(docs).collect())
    want = brute_repeats({i: (t or "").encode() for i, (_, t) in enumerate(rows)}, 400)
    assert got == sorted((rows[i][0] or 0, *w) for i, w in want.items())
