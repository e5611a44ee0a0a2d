import hashlib
import io
import json
import random
import re
import tarfile
import zlib
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest

from quillon.llm import chat, media, mixing, pieces, toxicity, urls, wordpiece

needs_vocabulary = pytest.mark.skipif(not Path(wordpiece.VOCABULARY).exists(), reason="no vocabulary files here")


def greedy(word, first, further):
    n = at = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (further if at else first)), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


def test_automaton_is_greedy_longest_match():
    r = random.Random(4)
    for _ in range(500):
        first, further = ({bytes(r.choice(b"abc") for _ in range(r.randint(1, 4))) for _ in range(6)} for _ in range(2))
        machine = wordpiece.Automaton(first, further)
        for _ in range(6):
            word = bytes(r.choice(b"abc") for _ in range(r.randint(0, 9)))
            assert machine.count(word) == greedy(word, first, further)


@needs_vocabulary
def test_token_counts(spark, small, edge, empty):
    first, further = map(set, wordpiece.pieces(wordpiece.VOCABULARY))
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(25)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in wordpiece.token_counts(docs).collect():
        words = texts[r.doc_id].encode().split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(greedy(b" " + w, first, further) for w in words))
    got = wordpiece.token_counts(edge).collect()
    assert len(got) == edge.count() and {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {0}
    assert wordpiece.token_counts(empty).count() == 0


@needs_vocabulary
def test_token_counts_of_a_long_text_in_parts(spark, monkeypatch):
    text = np.frombuffer(b"ab  cde\n fg " * 300 + b"z" * 700 + b" end", np.uint8)
    monkeypatch.setattr(wordpiece, "AT_ONCE", 100)
    parts = list(wordpiece._parts(text))
    assert len(parts) > 20 and b"".join(parts) == text.tobytes() and [w for p in parts for w in p.split()] == text.tobytes().split()


@needs_vocabulary
def test_pieces_without_dropout_are_the_library_s(spark, small):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    encoder = pieces.Encoder(dropout=0)
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(40).collect()] + ["a  b   c\n\n d", " ", "漢字 🎉é", "\t"]
    assert [encoder.encode(t) for t in texts] == [sp.encode(t) for t in texts]


@needs_vocabulary
def test_shared_agenda_is_each_word_s_own(spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    words = list(dict.fromkeys(w for t in texts for w in pieces._WORDS.findall(" " + t))) + ["x" * 40, " 漢字é🎉", "      a", "\n"]
    for dropout in (0.0, 0.1, 0.5):
        encoder = pieces.Encoder(dropout=dropout)
        for stream in range(encoder.streams):
            ids, sizes = encoder._ids(words, np.full(len(words), stream))
            got = np.split(ids, np.cumsum(sizes)[:-1])
            assert [g.tolist() for g in got] == [pieces.segment(w, encoder.vocab, int(encoder.keys[stream]), encoder.limit) for w in words]


@needs_vocabulary
def test_every_occurrence_has_draws_of_its_own():
    encoder = pieces.Encoder()
    keys = np.random.default_rng(5).integers(0, 1 << 63, 2000, dtype=np.uint64)
    for word in (" a", " understanding", "漢é-word"):
        ids, sizes = encoder._ids([word] * len(keys), keys)
        got = [tuple(x) for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got[:500] == [tuple(pieces.segment(word, encoder.vocab, int(k), encoder.limit)) for k in keys[:500]]
    keys = encoder._keys(np.uint64(1), 0, 3000)
    met = np.array([pieces._walk(" understanding", encoder.vocab, lambda number, k=int(k): pieces._draw(k, number) < encoder.limit)[1] for k in keys])
    skipped = sum(sum(pieces._draw(int(k), i) < encoder.limit for i in range(m)) for k, m in zip(keys, met))
    assert abs(skipped / met.sum() - pieces.DROPOUT) < 0.01
    text = "understanding " * 2000
    assert len({tuple(encoder.encode("understanding", doc)) for doc in range(2000)}) > 4
    assert encoder.encode(text, 1) == encoder.encode(text, 1) != encoder.encode(text, 1, 2)


@needs_vocabulary
def test_copies_of_a_document_differ(spark):
    text = "the segmentation of every repeated document differs from that of its other copies " * 5
    docs = spark.createDataFrame([(1, text, c) for c in (1, 2, 3)], "doc_id long, text string, copy int")
    assert len({tuple(r.ids) for r in pieces.with_ids(docs, copy_col="copy").collect()}) == 3
    assert len({tuple(r.ids) for r in pieces.with_ids(docs).collect()}) == 1


@needs_vocabulary
def test_long_texts_are_encoded_in_parts(monkeypatch):
    text = "ab  cd\n efg " * 500 + "z" * 3000 + " end"
    whole = pieces.Encoder().encode(text, 1)
    monkeypatch.setattr(pieces, "AT_ONCE", 100)
    parts = pieces.Encoder()
    assert parts.encode(text, 1) == whole and parts.decode(whole) == text


@needs_vocabulary
def test_pieces_vary_and_decode(spark, small, edge, empty):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60).unionByName(edge.drop("score"), allowMissingColumns=True).select("doc_id", "text")
    rows = docs.collect()
    one, two = (pieces.encoded(docs, seed=s).collect() for s in (1, 2))
    again = pieces.encoded(docs.repartition(3), seed=1).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, again))
    assert sum(a.ids != b.ids for a, b in zip(one, two)) > 40
    back = pieces.decoded(pieces.encoded(docs)).collect()
    assert sorted((repr(r.doc_id), r.text) for r in back) == sorted((repr(r.doc_id), r.text or "") for r in rows)
    assert all(r.lossless and r.decoded_sha256 == hashlib.sha256((t.text or "").encode()).hexdigest() for r, t in zip(pieces.round_trip(docs).collect(), rows))
    assert pieces.encoded(empty).count() == 0 and pieces.with_ids(edge).columns == [*edge.columns, "ids"]


def test_toxicity_finds_held_out_rows(spark, edge, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    hit = sum(r.predicted for r in got if r.toxic)
    assert hit >= 0.9 * sum(r.toxic for r in got)
    assert sum(r.predicted for r in got if not r.toxic) <= 0.005 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in toxicity.toxicity(edge.where("doc_id IS NOT NULL"), labels).collect())
    none = labels.limit(0)
    flat = toxicity.toxicity(edge, none).collect()
    assert len(flat) == edge.count() and {r.predicted for r in flat} == {0} and len({r.score for r in flat}) == 1
    assert toxicity.toxicity(empty, labels.limit(5)).count() == 0
    assert toxicity.drop_toxic(edge, none).columns == edge.columns


def test_nnpu_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(0)
    noise = lambda: rng.integers(0, 3000, 40)
    p = [np.unique(np.append(noise(), 5000 + rng.integers(3))).astype(np.int32) for _ in range(300)]
    u = [np.unique(np.append(noise(), 5000 + rng.integers(3)) if rng.random() < 0.1 else noise()).astype(np.int32) for _ in range(1500)]
    model = toxicity.train(p, u, 0.1)
    fresh = [np.unique(noise()).astype(np.int32) for _ in range(200)]
    assert sum(model.score(f) >= 0.5 for f in fresh) == 0
    assert all(model.score(np.unique(np.append(f, 5001))) >= 0.5 for f in fresh)


def test_media_payloads_read_back(spark, edge, empty, tmp_path):
    folder = f"file://{tmp_path}/shards"
    rows = edge.collect()
    got = media.media(edge, folder=folder, shard_bytes=200_000).collect()
    assert len(got) == len(rows)
    payloads = [media.padded((r.text or "").encode()) for r in rows]
    for r in got:
        match = [p for p in payloads if hashlib.sha256(p).hexdigest() == r.payload_sha256]
        assert match and (r.payload_bytes, r.tail_crc32, r.feature) == (len(match[0]), zlib.crc32(match[0][-64:]), media.feature(match[0]))
        assert r.width == 64 and r.width * r.height == r.payload_bytes and r.payload_bytes >= max(64, r.n_bytes)
    names = set()
    for shard in Path(tmp_path, "shards").iterdir():
        with tarfile.open(shard) as t:
            for m in t.getmembers():
                stored = t.extractfile(m).read()
                names.add(m.name)
                assert hashlib.sha256(media.decode(stored)).hexdigest() + ".png" == m.name
    assert len(names) == len(set(payloads))
    assert media.media(empty).count() == 0
    with pytest.raises(ValueError):
        media.decode(media.encode(b"x" * 64)[:-20] + b"\0" * 20)


def test_header_reads_touch_only_headers(spark):
    stored = media.encode(b"y" * 640)
    assert media.metadata(stored[: media.HEADER]) == (64, 10, 8)


def water(sizes, weights, most=3):
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(most * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        share = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / share > most * sizes[i] + 1e-9]
        if not over:
            return [most * sizes[i] if i in capped else rest * weights[i] / share for i in range(len(sizes))]
        capped.update(over)


def test_mixture(spark, edge, empty):
    r = random.Random(2)
    rows = [(i, " ".join("w" * (1 + i % 3) for _ in range(r.randint(0, 40))), r.choice(["a", "b", "c", "d", None] + ["e"] * 6)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(docs).collect()
    assert len(got) == 400 and got == mixing.mixture(docs.repartition(5)).collect()
    sources = ["a", "b", "c", "d", "e", None]
    sizes = [sum(len(t.split()) for _, t, s in rows if s == x) for x in sources]
    want = dict(zip(sources, water(sizes, [1, 2, 3, 1, 2, 3])))
    for x in sources:
        own = [g for g in got if g.source == x]
        assert abs(own[0].target - want[x]) < 1e-6 and abs(sum(g.taken for g in own) - want[x]) <= 0.5
    assert all(0 <= g.taken <= 3 * g.size for g in got)
    placed = [g.position for g in got if g.position is not None]
    assert placed == sorted(placed) and 0 <= placed[0] and placed[-1] <= 1
    grid = np.linspace(0, 1, 20_001)
    for k, x in enumerate(sources):  # the demand before a document, turned into a time by the integral of its source's schedule
        rate = np.interp(grid, *zip(*mixing.SCHEDULES[k % 3]))
        spent = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
        own, goal, at = sorted((g for g in got if g.source == x), key=lambda g: hashlib.md5(str(g.doc_id).encode()).hexdigest()), round(want[x]), 0
        for g in own:
            first = g.size if goal >= sizes[k] else g.taken
            if g.taken:
                assert abs(g.position - np.interp((at + first / 2) / goal, spent / spent[-1], grid)) < 1e-4
            at += g.size
    assert len(mixing.mixture(edge).collect()) == edge.count() and mixing.mixture(empty).count() == 0
    assert mixing.mixed(edge).columns == edge.columns


def test_every_pass_has_positions(spark):
    r = random.Random(3)
    rows = [(i if i % 50 else None, " ".join("w" for _ in range(r.randint(1, 40))), r.choice(["a", "b", "c", "d", "e"] + ["f"] * 30)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain = {(g.doc_id, g.source, g.size, g.position): g for g in mixing.mixture(docs).collect() if g.taken}
    got = mixing.passes(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    words = Counter((g.doc_id, g.source) for g in got)
    assert max(words.values()) >= 3 and sum(g.words for g in got) == sum(p.taken for p in plain.values())
    for k, s in enumerate("abcdef"):  # the copies of a source fill its demand without gaps, in the order of their positions
        own, at = sorted((g for g in got if g.source == s), key=lambda g: g.position), 0
        goal = sum(g.words for g in own)
        grid = np.linspace(0, 1, 20_001)
        rate = np.interp(grid, *zip(*mixing.SCHEDULES[k % 3]))
        spent = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
        for g in own:
            assert abs(g.position - np.interp((at + g.words / 2) / goal, spent / spent[-1], grid)) < 1e-4
            assert g.copy == 1 + at // sizes[s]
            at += g.words
    out = mixing.mixed(docs, "copy", "position").collect()
    assert [g.position for g in out] == sorted(g.position for g in out) and max(g.copy for g in out) == 3
    want = Counter((g.doc_id, g.source, g.size, g.copy, g.position) for g in got if 2 * g.words >= g.size)
    assert Counter((g.doc_id, g.source, len(g.text.split()), g.copy, g.position) for g in out) == want
    assert [g.text for g in mixing.mixed(docs).collect()] == [g.text for g in out]


def test_positions_invert_schedules(spark):
    for k, knots in enumerate(mixing.SCHEDULES):
        total = sum((w0 + w1) / 2 * (t1 - t0) for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
        rows = spark.range(1, 100).selectExpr("id / 100D AS u", f"{k} AS kind")
        for r in rows.select("u", mixing.position(rows.u, *mixing._pieces(mixing.SCHEDULES)).alias("t")).collect():
            grid = np.linspace(0, r.t, 2001)
            spent = np.trapezoid(np.interp(grid, *zip(*knots)), grid)
            assert abs(spent / total - r.u) < 1e-6


def test_url_filter(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url")
    more = spark.createDataFrame([(1000, None), (1001, "no scheme"), (1002, "HTTP://WWW.Example.COM/en/1?x=/fr/"), (1003, "http://net"), (1003, "http://a.net/es/"), (None, "x://b.net/fr/#é")], "page_id long, url string")
    pages = pages.union(more)
    rules = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})

    def brute(url):
        if url is None or "://" not in url:
            return "", "", None, None
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(low)
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *(max(fits)[1:] if fits else (None, None))

    want = sorted(map(repr, ((p.page_id, *brute(p.url)) for p in pages.collect())))
    got = urls.filtered(pages, rules).collect()
    assert sorted(repr((g.page_id, g.host, g.path, g.rule, g.verdict if g.rule else None)) for g in got) == want
    assert {g.verdict for g in got} <= {"allow", "block"}
    assert urls.filtered(pages.limit(0), rules).count() == 0


def test_mined_rules_hold_on_held_out_hosts(spark):
    pages = spark.createDataFrame([(f"http://h{i}.{'com' if i % 3 else 'net'}/{'es' if i % 2 else 'en'}/{i}",) for i in range(600)], "url string")
    got = urls.measured(pages, spark.createDataFrame(urls.RULES, "verdict string, host string, path string")).first()
    assert got.n > 50 and got.settled >= 0.9 * got.n and got.right >= 0.95 * got.settled and got.found >= 0.9 * got.blocked > 0


def test_mined_rules_match_brute_force(spark):
    r = random.Random(1)
    rows = []
    for _ in range(300):
        have = sorted({x for x in "abcdef" if r.random() < 0.4})
        rows.append((have, "block" if {"a", "b"} <= set(have) else "allow"))
    labelled = spark.createDataFrame(rows, "items array<string>, label string")
    rules = urls.mine(labelled, 0.05, 0.95).collect()
    assert any(x.items == ["a", "b"] and x.label == "block" for x in rules)
    for x in rules:
        hit = [lab for have, lab in rows if set(x["items"]) <= set(have)]
        assert abs(hit.count(x.label) / len(hit) - x.confidence) < 1e-9 and x.confidence >= 0.95
    pages = labelled.select("items").distinct()
    for p in urls.matched(pages, urls.mine(labelled, 0.05, 0.95)).collect():
        fit = [(x.confidence, x.support, -len(x["items"]), "\n".join(x["items"]), x.label) for x in rules if set(x["items"]) <= set(p["items"])]
        assert p.mined == (max(fit)[-1] if fit else None)
    assert urls.matched(pages, urls.mine(labelled.limit(0))).where("mined IS NOT NULL").count() == 0


def test_chat_levels_and_links(spark):
    calls = [("k", "a", None), ("k", "b", "a"), ("k", "c", "b"), ("k", "x", "y"), ("k", "y", "x"), ("k", "z", "x"), ("k", "o", "gone"), ("k", None, "a"), (None, "a", None)]
    got = chat.levels(spark.createDataFrame(calls, "conv string, call_id string, after string"), ["conv"]).collect()
    assert {(r.conv, r.call_id): r.depth for r in got} == {("k", "a"): 0, ("k", "b"): 1, ("k", "c"): 2, ("k", "x"): None, ("k", "y"): None, ("k", "z"): None, ("k", "o"): 0, (None, "a"): 0}


def test_chat_longest_paths(spark):
    r = random.Random(6)
    after = {f"c{i}": sorted({f"c{r.randrange(i)}" for _ in range(r.choice([0, 1, 1, 1, 2, 3]))}) if i else [] for i in range(120)}
    after |= {"x": ["y", "c3"], "y": ["x"], "z": ["c5", "y"], "o": ["gone", None]}
    depth = {}
    for c, before in after.items():
        if c[0] == "c":
            depth[c] = max((depth[b] + 1 for b in before), default=0)
    depth |= {"x": None, "y": None, "z": None, "o": 0}
    rows = spark.createDataFrame([("k", c, b) for c, b in after.items()], "conv string, call_id string, after array<string>")
    assert {g.call_id: g.depth for g in chat.levels(rows, ["conv"]).collect()} == depth


def test_chat_further_columns_and_canonical_arguments(spark):
    calls = spark.createDataFrame([("k", "a", None, "reply", ' {"turn":3,  "text":"hi", "z": {"b":1,"a":[ 2 ]}}', 7, "c"), ("k", "b", "a", "reply", "no json", 8, "d"), ("k", "d", None, "reply", None, 9, "e")], "conv string, call_id string, after string, name string, arguments string, extra int, json string")
    results = spark.createDataFrame([("k", "a", "long " * 200_000, "m")], "conv string, call_id string, content string, other string")
    got = {(g.kind, g.call_id): g for g in chat.linked(calls, results, ["conv"]).collect()}
    assert json.loads(got["call", "a"].json)["arguments"] == '{"text":"hi","turn":3,"z":{"a":[2],"b":1}}'
    assert json.loads(got["call", "b"].json)["arguments"] == "no json" and "arguments" not in json.loads(got["call", "d"].json)
    assert got["call", "a"].extra == 7 and got["call", "a"].other is None and got["result", "a"].other == "m"
    assert len(json.loads(got["result", "a"].json)["content"]) == 1_000_000


def test_chat_arguments(spark):
    cases = {'{"text":"hi","turn":3}': True, '{"turn":3,"text":"hi"}': True, '{"text":"","turn":3}': False, '{"text":"hi"}': False, '{"text":5,"turn":3}': False, '{"text":"hi","turn":"3"}': False, '{"text":"hi","turn":-1}': False, '{"text":"hi","turn":3,"more":1}': False, "[1]": False, "no": False, None: False}
    rows = spark.createDataFrame([(k,) for k in cases], "a string")
    from pyspark.sql import functions as F

    assert {r.a: r.v for r in rows.select("a", chat.valid_arguments(F.lit("reply"), F.col("a")).alias("v")).collect()} == cases
    assert not rows.select(chat.valid_arguments(F.lit("other"), F.col("a")).alias("v")).where("v").count()


def test_chat_edges(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", 'a"\n'), (1, 2, "assistant", 'a"\n'), (1, 3, "user", None), (2, 0, "assistant", "orphan"), (None, 1, "user", "n"), (3, None, "user", "t"), (4, 1, None, None)]
    got = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 1].linked and by[1, 2].level == by[1, 1].level + 1 and by[1, 3].level == by[1, 1].level + 2 and not by[1, 3].valid
    assert by[2, 0].level is None and not by[2, 0].linked and by[None, 1].call_id is None
    for r in got:
        parsed = json.loads(r.json)
        assert r.json == json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
