"""Operators against brute force, round trips and planted cases; nulls, empty tables, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborplan.llm import chat, common, fingerprints, media, mixing, ngram_join, packing, quality, sharding, suffix_dedup, toxicity
from arborplan.llm.components import components

KIND = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}{c}" for i in range(60) for c in "aé"]


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(900)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    texts = [prose(r, r.choice([3, 30, 120, 200])) for _ in range(50)]
    passage = prose(r, 90)
    texts += [t[: len(t) // 2] + " " + passage + " " + t[len(t) // 2 :] for t in texts[:8]]  # a shared passage
    for t in texts[20:40]:  # near copies
        w = t.split(" ")
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", "  \n", "one", "ONE", "a" * 900, "é" * 500, "x y z", texts[3], texts[3]]
    out = [(i, t, "en", r.choice(["s0", "s0", "s1", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[5], out[-1], (None, texts[7], None, "s1", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def raw(t):
    return (t or "").encode()


def runs_of(rows, window):
    seen = Counter(raw(t)[k : k + window] for t in rows for k in range(len(raw(t)) - window + 1))
    return [suffix_dedup.merged([{"a": k, "b": k + 1} for k in range(len(raw(t)) - window + 1) if seen[raw(t)[k : k + window]] > 1], window) for t in rows]


def test_suffix_dedup(docs, none, rows):
    texts = [t for _, t, *_ in rows]
    want = []
    for (i, t, *_), runs, short in zip(rows, runs_of(texts, 400), runs_of(texts, suffix_dedup.PASSAGE), strict=True):
        want.append((i, len(raw(t)), sum(y - x for x, y in runs), len(runs), hashlib.sha256(suffix_dedup._kept(raw(t), runs)).hexdigest(), sum(y - x for x, y in short)))
    own = lambda d: [tuple(r) for r in suffix_dedup.spanned(d.select("doc_id", suffix_dedup.utf8().alias("t")), (400, suffix_dedup.PASSAGE), suffix_dedup.PASSAGE_GRAM).select("doc_id", "t", "spans0", "spans1").mapInArrow(suffix_dedup._digests, suffix_dedup._DIGEST).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(own(docs), key=key) == sorted(want, key=key)
    assert own(none) == []


@pytest.mark.parametrize(("window", "gram"), [(400, 152), (250, 100), (40, 16)])
def test_without_repeats(spark, none, rows, window, gram):
    # Names that helpers could have, a column twice, and rows that differ in them only.
    names = ["doc_id", "text", "lang", "source", "n_chars", "key", "t", "spans0", "row", "k0", "cell"]
    wide = [(*r, k, "t", "s", "r", "k", k) for k, r in enumerate(rows)]
    df = spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, key int, t string, spans0 string, row string, k0 string, cell int").repartition(3)
    left = suffix_dedup.without_repeats(df, window, gram)
    assert left.columns == names
    want = {}
    for r, runs in zip(wide, runs_of([r[1] for r in rows], window), strict=True):
        rest = suffix_dedup.whole_characters(raw(r[1]), runs) if r[1] is not None else None
        if not runs or rest:
            want[r[5]] = (r[0], rest, *r[2:4], r[4] if r[1] is None else len(rest), *r[5:])
    assert {r.key: tuple(r) for r in left.collect()} == want
    assert suffix_dedup.without_repeats(none, window, gram).count() == 0


def test_copies_are_removed_whole_and_long_texts_in_parts(spark, monkeypatch):
    r = random.Random(8)
    one, long = prose(r, 90), prose(r, 3000)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1 << 12)
    texts = [one, one, one, "x" + one, long, prose(r, 20) + long[500:9000], "a" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {x.doc_id: suffix_dedup.merged(x.spans) for x in suffix_dedup.with_spans(df).collect()}
    assert [got[i] for i in range(len(texts))] == runs_of(texts, 400)


@pytest.mark.parametrize("heavy", [3, 8192])
def test_heavy_anchors(spark, monkeypatch, heavy):
    monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)
    r = random.Random(1)
    core = prose(r, 60)
    texts = [prose(r, 20) + core[i % 3 :] + prose(r, 20)[: i * 40] for i in range(9)] + [core[:320] + "y", "z" + core[10:300]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", suffix_dedup.utf8().alias("t"))
    out = sorted(suffix_dedup.spanned(rows, (400, 250), 100).collect(), key=lambda x: x.doc_id)
    assert [suffix_dedup.merged(x.spans0, 400) for x in out] == runs_of(texts, 400)
    assert [suffix_dedup.merged(x.spans1, 250) for x in out] == runs_of(texts, 250)


def test_passage_of_51_words(spark):
    """A passage of 51 words goes from every document that holds it, and documents without one stay as they are."""
    r = random.Random(12)
    passage = " ".join(r.choice(["that", "with", "from", "into"]) + r.choice("aeiou") for _ in range(51))
    assert suffix_dedup.PASSAGE <= len(passage) < suffix_dedup.WINDOW
    texts = [prose(r, 80) + f" {passage} " + prose(r, 80) if i % 2 else prose(r, 160) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {x.doc_id: x.text for x in suffix_dedup.without_repeats(df, suffix_dedup.PASSAGE, suffix_dedup.PASSAGE_GRAM).collect()}
    assert all(passage not in left[i] for i in range(1, 40, 2)) and all(left[i] == texts[i] for i in range(0, 40, 2))


def brute_links(texts, size=4, percent=85):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    return sets, [(a, b) for a, b in combinations(range(len(sets)), 2) if (sets[a] or sets[b]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


@pytest.mark.parametrize("light", [32, 1])
def test_ngram_join(docs, none, rows, light, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIGHT", light)
    sets, links = brute_links([t for _, t, *_ in rows])
    root = list(range(len(rows)))
    for _ in rows:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    low = {}
    for k, (i, *_) in zip(root, rows, strict=True):
        low[k] = min(low.get(k, 10**9), 10**9 if i is None else i)
    want = Counter((i, len(s), None if low[k] == 10**9 else low[k]) for (i, *_), s, k in zip(rows, sets, root, strict=True))
    got = ngram_join.ngram_components(docs)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want
    if light == 1:
        return
    assert ngram_join.ngram_components(none).count() == 0
    kept = [r.doc_id for r in ngram_join.keep_one(docs).collect()]
    words = {i for (i, *_), s in zip(rows, sets, strict=True) if not s}
    assert sorted(kept) == sorted({c for (_, n, c) in want if n} | words)
    assert ngram_join.keep_one(none).count() == 0
    # Any names, and repeated rows that differ elsewhere: one stays, with its own values.
    odd = ngram_join.keep_one(docs.selectExpr("*", "doc_id as id", "text as h", "hash(text) as row", "1 as k0", "rand() as __own", "'g' as g"))
    assert odd.columns[5:] == ["id", "h", "row", "k0", "__own", "g"] and sorted(r.doc_id for r in odd.collect()) == sorted(kept)


@pytest.mark.parametrize(("size", "percent"), [(5, 80), (2, 60)])
def test_other_shingles(spark, size, percent):
    r = random.Random(21)
    base = [prose(r, 60).split(" ") for _ in range(6)]
    texts = []
    for w in base * 6:
        w = list(w)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = "other"
        texts.append(" ".join(w[: r.randrange(50, 61)]))
    texts += ["a b", "a b", "A  B", "x" * 300 + " y", "x" * 300 + " y", None]
    sets, links = brute_links(texts, size, percent)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = Counter(i for link in links for i in link)
    assert {x.doc_id: x.n_links for x in ngram_join.ngram_components(df, True, size, percent).collect()} == {i: want[i] for i in range(len(texts))}


def test_rows_that_cannot_pair_go():
    """_shared, in batches of any size, keeps both rows of every first shared token of two sets that can link."""
    import pyarrow as pa

    r = random.Random(2)
    rows = sorted({(r.randrange(8), r.randrange(5, 60), r.randrange(12), bytes([r.randrange(40)]) * ngram_join.NAME) for _ in range(400)})
    rows = [x for i, x in enumerate(rows) if x[3] not in {y[3] for y in rows[:i] if y[0] == x[0]}]
    rows = sorted(rows + rows[::7])
    need = lambda a, b: -(-85 * (a + b) // 185)
    want = {a for a in rows for b in rows if a[0] == b[0] and a[3] != b[3] and min(a[1], b[1]) * 100 >= max(a[1], b[1]) * 85 and min(a[1] - a[2], b[1] - b[2]) >= need(a[1], b[1])}
    for step in (1, 3, 50, 1000):
        parts = (pa.RecordBatch.from_arrays([pa.array([x[0] for x in p], pa.int64()), pa.array([x[3] for x in p], pa.binary()), pa.array([x[1] for x in p], pa.int32()), pa.array([x[2] for x in p], pa.int32())], ["token", "node", "n", "pos"]) for p in (rows[i : i + step] for i in range(0, len(rows), step)))
        out = [(t, n, p, node) for b in ngram_join._shared()(parts) for t, node, n, p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert len(out) == len(set(out)) and want <= set(out) <= set(rows) and (step == 1 or len(out) < len(set(rows)))


@pytest.mark.parametrize("block", [128, 3])
def test_all_links_are_found(spark, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "COLUMNS", 64)
    r = random.Random(9)
    base = prose(r, 120).split(" ")
    texts = []
    for k in range(24):  # near copies, some nearer than others
        w = list(base)
        for _ in range(k % 6):
            w[r.randrange(len(w))] = "other"
        texts.append(" ".join(w))
    texts += [texts[1], texts[1], prose(r, 80), None, "", "one", "ONE"]
    sets, links = brute_links(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = Counter(i for link in links for i in link)
    got = {x.doc_id: x.n_links for x in ngram_join.ngram_components(df, with_links=True).collect()}
    assert got == {i: want[i] for i in range(len(texts))}
    join = ngram_join.Join(df)
    node = {x.doc_id: bytes(x.node) for x in join.rows.where("node is not null").collect()}
    pairs = [(bytes(x.a), bytes(x.b)) for x in join.links(join.roots()).collect()]
    assert sorted(pairs) == sorted({(min(node[a], node[b]), max(node[a], node[b])) for a, b in links if node[a] != node[b]})


def test_components(spark):
    links = [(1, 2), (3, 2), (4, 5), (6, 6), (9, 5), (7, 8), (8, 10), (10, 11), (11, 12), (1, 13), (13, 12)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 4, 6: 6, 7: 1, 8: 1, 10: 1, 11: 1, 12: 1, 13: 1}


def test_quality(docs, none):
    r = random.Random(2)
    good = [prose(r, 60).encode() for _ in range(160)]
    bad = [(" ".join(w + r.choice(["###", "&&&"]) for w in prose(r, 60).split()) if i % 2 else " ".join([prose(r, 1)] * 60)).encode() for i in range(160)]
    net = quality.train([*good[:120], *bad[:120]], np.array([1.0] * 120 + [0.0] * 120))
    score = lambda t: net.scores(np.frombuffer(b"".join(t), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in t]))))
    assert (score(good[120:]) > 0.5).mean() > 0.9 and (score(bad[120:]) < 0.5).mean() > 0.9
    together, alone = score([*good[:3], b"", *bad[:3]]), [score([x])[0] for x in (*good[:3], b"", *bad[:3])]
    assert np.allclose(together, alone, atol=1e-5)
    out = quality.score_quality(docs, net)
    assert out.columns == [*docs.columns, "score"] and out.where("score between 0 and 1").count() == docs.count()
    assert quality.score_quality(none, net).count() == 0
    assert quality.train([], np.zeros(0)).share == 0.5 and quality.train([b"a"], np.ones(1)).share == 1.0


def test_toxicity(spark, docs, none):
    r = random.Random(3)
    clean = [". ".join(prose(r, 8) for _ in range(6)) for _ in range(150)]
    toxic = [t.replace(". ", f" {r.choice(['vile', 'wretch', 'fool'])}. ", 2) for t in clean[:75]]
    model = toxicity.train([t.encode() for t in toxic[:50] + clean[75:125]], np.array([1.0] * 50 + [0.0] * 50))
    score = lambda t: model.scores(np.frombuffer("".join(t).encode(), np.uint8), np.concatenate(([0], np.cumsum([len(x.encode()) for x in t]))))
    assert (score(toxic[50:]) >= 0.5).mean() > 0.9 and (score(clean[125:]) < 0.5).mean() > 0.9
    one = spark.createDataFrame([(1, toxic[60]), (2, None), (3, "")], "doc_id long, text string")
    spans = toxicity.toxic_spans(one, model).collect()
    assert spans and all(re.search("vile|wretch|fool", toxic[60].encode()[s.start : s.end].decode()) for s in spans)
    assert toxicity.score_toxicity(docs, model).where("score between 0 and 1").count() == docs.count()
    assert toxicity.score_toxicity(none, model).count() == 0


def test_sharding(docs, none, rows, tmp_path):
    out = sharding.ranked(sharding.shard_documents(docs, 4)[0]).collect()
    assert len(out) == len(rows)
    stored = sharding.ranked(sharding.shard_documents(docs, 4, path=str(tmp_path / "maps"))[0]).collect()
    assert Counter(stored) == Counter(out)
    assert sharding.shard_documents(none, 4, path=str(tmp_path / "empty"))[0].count() == 0
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    loads = [sum(r.size for r in out if r.shard == s) for s in range(4)]
    assert max(loads) - min(loads) < 0.1 * sum(loads) / 4
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len(raw(t)) + 1, zlib.crc32(raw(t))) for i, t, *_ in rows)
    assert sharding.ranked(sharding.shard_documents(none, 4)[0]).count() == 0
    sizes = {i: i % 17 + 1 for i in range(500)}
    old = sharding.first_map(sizes, 4)
    new = old.grown(sizes)
    assert new.version == 2 and all(new.owner[k] in (v, 4) for k, v in old.owner.items()) and 4 in new.owner.values()
    bumped = {k: v * (5 if old.owner[k] == 0 else 1) for k, v in sizes.items()}
    again = old.rebalanced(bumped)
    spread = lambda m: max(x := [sum(b for k, b in bumped.items() if m.owner[k] == s) for s in range(4)]) - min(x)
    assert again.version == 2 and spread(again) < spread(old) / 5


def test_slot_map_is_stored(spark, tmp_path):
    m = sharding.first_map({1: 5, 2: 6}, 2)
    m.store(spark, str(tmp_path / "maps"))
    sharding.SlotMap(2, {1: 0, 2: 0}, {2: 4}, 2).store(spark, str(tmp_path / "maps"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "maps")) == sharding.SlotMap(2, {1: 0, 2: 0}, {2: 4}, 2) and sharding.SlotMap.load(spark, str(tmp_path / "maps"), 1) == m
    sharding.SlotMap(3, {}).store(spark, str(tmp_path / "none"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "none")) == sharding.SlotMap(3, {})
    assert spark.read.parquet(str(tmp_path / "maps")).groupBy("version").count().count() == 2


def test_mixing(spark, docs, none, rows):
    assert mixing.weights(["b", None, "a", "c", "d"]) == {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    assert mixing.targets({"a": 100, "b": 1}, {"a": 1, "b": 2}) == {"a": Fraction(98), "b": Fraction(3)}
    assert mixing.sainte_lague({"a": 53, "b": 24, "c": 23}, 7) == {"a": 3, "b": 2, "c": 2}
    r = random.Random(5)
    for _ in range(30):
        votes, seats = {k: r.randrange(1, 999) for k in range(r.randrange(1, 7))}, r.randrange(0, 40)
        plain = dict.fromkeys(votes, 0)
        for _ in range(seats):
            plain[max(votes, key=lambda k: (Fraction(votes[k], 2 * plain[k] + 1), -k))] += 1  # noqa: B023
        assert mixing.sainte_lague(votes, seats) == plain
    out = mixing.mix_sources(docs, shards=4, block=16).collect()
    again = mixing.mix_sources(docs.repartition(5), shards=4, block=16).collect()
    assert Counter((x.doc_id, x.h, x.taken) for x in out) == Counter((x.doc_id, x.h, x.taken) for x in again)
    assert len(out) == len(rows) and all(0 <= x.taken <= 3 * x.size for x in out)
    words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(words_of(t))
    want = mixing.targets(dict(sizes), mixing.weights(list(sizes)))
    for s in {x.source for x in out}:
        own = [x for x in out if x.source == s]
        assert own[0].source_size == sizes[s] and own[0].target == float(want[s])
        assert abs(sum(x.taken for x in own) - own[0].target) <= 16
    assert sorted((x.doc_id, x.size) for x in out if x.doc_id is not None) == sorted((i, len(words_of(t))) for i, t, *_ in rows if i is not None)
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed(none).count() == 0
    # Rows that differ in one column only keep their own values, whatever the columns are called.
    wide = [(*r, k, "x", "y", "z") for k, r in enumerate(rows)]
    df = spark.createDataFrame(wide, KIND + ", __id int, __sum string, row string, key string").repartition(3)
    made = mixing.mixed(df, shards=4, block=16)
    assert made.columns == df.columns
    made = made.collect()
    assert sum(len(words_of(x.text)) for x in made) == sum(x.taken for x in out)
    for x in made:
        t = rows[x["__id"]][1]
        assert x.doc_id == rows[x["__id"]][0] and x.n_chars == len(x.text) and (x.text == t or all(p in t for p in x.text.split("\n") if " \n" not in t))
    assert all(sum(len(words_of(x.text)) for x in made if x["__id"] == k) <= 3 * len(words_of(r[1])) for k, r in enumerate(rows))


def test_blocks_are_chosen_by_a_seeded_order():
    for n in (1, 2, 7, 64, 1000):
        step, first = mixing.steps(1, "a", 3, n)
        assert sorted((step * b + first) % n for b in range(n)) == list(range(n))
    assert mixing.steps(1, "a", 3, 1000) != mixing.steps(2, "a", 3, 1000)


def test_quality_filter_keeps_columns(spark, docs, none, monkeypatch):
    net = quality.Network.new()
    df = docs.selectExpr("*", "doc_id as score", "'t' as t", "1 as row")
    left = quality.kept(df, net, 0.5)
    score = {(x.doc_id, x.text): x.score for x in quality.score_quality(docs, net).collect()}
    want = Counter(tuple(x) for x in df.collect() if score[x.doc_id, x.text] >= 0.5)
    assert left.columns == df.columns and Counter(tuple(x) for x in left.collect()) == want
    assert quality.kept(none, net).count() == 0
    text = np.frombuffer(b"abcde fghij klmno " * 500, np.uint8)
    whole = net.scores(text, np.array([0, len(text)]))
    monkeypatch.setattr(quality, "LONG", 1024)
    assert np.allclose(net.scores(text, np.array([0, len(text)])), whole, atol=1e-6)


def test_gif(spark, docs, none, rows):
    r = random.Random(6)
    for n in (0, 1, 254, 255, 3000):
        for pool in (b"ab", bytes(range(256))):
            x = bytes(r.choice(pool) for _ in range(n))
            assert media.lzw_read(media.lzw_packed(x), 8, n) == x == media.lzw_read(media.lzw_literal(np.frombuffer(x, np.uint8)), 8, n)
    colours = np.array([[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]], np.uint8)
    one = media.Frame(0, 0, 4, 4, np.zeros((4, 4), np.uint8), colours, 5)
    hole = media.Frame(1, 1, 2, 2, np.array([[1, 3], [3, 1]], np.uint8), colours, 7, disposal=2, transparent=3)
    back = media.Frame(0, 0, 1, 1, np.full((1, 1), 2, np.uint8), colours, 0, disposal=3)
    for pack in (False, True):
        data = media.write_gif(4, 4, [one, hole, back, one], pack)
        w, h, frames = media.read_gif(data)
        shown = list(media.composed(w, h, frames))
        assert [t for t, _ in shown] == [0, 50, 120, 120]
        assert shown[1][1][1, 1].tolist() == [0, 255, 0, 255] and shown[1][1][1, 2].tolist() == [255, 0, 0, 255]
        assert shown[2][1][1, 1].tolist() == [0, 0, 0, 0] and shown[2][1][0, 0].tolist() == [0, 0, 255, 255]
    frames = media.gif_frames(spark.createDataFrame([("a", data), ("b", b"junk"), ("c", None)], "id string, content binary")).collect()
    assert [r.ok for r in frames if r.id == "a"] == [True] * 4 and not any(r.ok for r in frames if r.id != "a")
    out = media.text_media(docs).collect()
    want = Counter((i, len(raw(t)), hashlib.sha256(media.padded(raw(t))).hexdigest(), zlib.crc32(media.padded(raw(t))[-16:])) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in out) == want
    for r in out:
        hist = np.bincount(np.frombuffer(next(media.padded(raw(t)) for i, t, *_ in rows if i == r.doc_id), np.uint8) >> 5, minlength=8)
        assert r.feature.endswith("grey=" + ",".join(map(str, hist.tolist()))) and r.media_bytes > r.payload_bytes
    data = media.store_bytes(bytes(range(192)) * 5)
    assert {r.media_sha256 for r in media.text_media(spark.createDataFrame([(1, "x")], "doc_id long, text string")).collect()} == {hashlib.sha256(media.store_bytes(b"x" + b" " * 191)).hexdigest()}
    assert b"".join(f.indices.tobytes() for f in media.read_gif(data)[2]) == bytes(range(192)) * 5
    assert media.text_media(none).count() == 0


def test_packing(docs, none, rows):
    out = packing.pack(docs, packing.tokenizer_path(), 64, with_ids=True).collect()
    assert sorted(r.sequence_id for r in out) == list(range(len(out)))
    assert all(r.length & (r.length - 1) == 0 and r.offset == 0 and len(r.ids) == r.length <= 64 for r in out)
    tok = packing.Chunks(packing.tokenizer_path()).tokenizer
    odd = ["a  b\n\n c", " lead", "it's 's\nnew  line ", "x<|endoftext|>y", " nb sp", "tab\tand 12 34é"]
    chunks = packing.Chunks(packing.tokenizer_path())
    for t in [*odd, *(t for _, t, *_ in rows if t)]:
        assert np.frombuffer(chunks.ids([t])[0], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    by = Counter()
    for r in out:
        by[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    want = Counter()
    for i, t, *_ in rows:
        want[i] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    assert by == want and packing.pack(none, packing.tokenizer_path()).count() == 0


def test_fingerprints(spark, docs, none, rows, monkeypatch):
    out = fingerprints.edited_fingerprints(docs).collect()
    order = sorted(rows, key=lambda r: -(10**9) if r[0] is None else r[0])
    assert len(out) == len(rows)
    texts = [r[1] or "" for r in order]
    for k, (i, *_) in enumerate(order):
        if sum(r[0] == i for r in order) > 1 or sum(r[0] == order[(k + 1) % len(order)][0] for r in order) > 1:
            continue
        t, nxt = texts[k], texts[(k + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        got = next(r for r in out if r.doc_id == i)
        assert got.n_chars == len(t) and got.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, ed, after = (int(fingerprints.simhash(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())]))[0]) for x in (t, edited, nxt))
        assert (got.fingerprint, got.edited_fingerprint) == (f"{own:016x}", f"{ed:016x}")
        assert got.near_edited == 1 - (own ^ ed).bit_count() / 64 and got.near_next == 1 - (own ^ after).bit_count() / 64
    assert fingerprints.edited_fingerprints(none).count() == 0
    text = np.frombuffer((" ".join(texts[3:40]) + " " + "y" * 300).encode(), np.uint8)
    whole = fingerprints.simhash(text, np.array([0, len(text)]))
    monkeypatch.setattr(fingerprints, "TERMS", 50)
    monkeypatch.setattr(common, "BLOCK_BYTES", 256)
    assert fingerprints.simhash(text, np.array([0, len(text)])) == whole
    monkeypatch.undo()
    r = random.Random(7)
    base = [r.getrandbits(64) for _ in range(40)]
    prints = {x ^ sum(1 << r.randrange(64) for _ in range(r.randrange(5))) & (1 << 64) - 1 for x in base for _ in range(6)}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    want = {(min(a, b), max(a, b), d) for a, b in combinations(signed, 2) if (d := ((a ^ b) & (1 << 64) - 1).bit_count()) <= 3}
    df = spark.createDataFrame([(x,) for x in signed + signed[:5] + [None]], "fingerprint long")
    found = [tuple(x) for x in fingerprints.near_pairs(df).collect()]
    assert set(found) == want and len(found) == len(want)


def test_chat(spark):
    calls = spark.createDataFrame(
        [(1, "a", 1, "add", '{"y": 2, "x":1}'), (1, "b", 3, "add", '{"x":"1"}'), (1, "c", 5, "none", "{}"), (1, "d", 7, "add", "oops"), (1, "e", 9, "add", '{"x":1,"y":2,"z":[1,{"b":1,"a":"\\""}]}'), (1, "a", 2, "add", "{}"), (2, None, 1, "add", "{}"), (2, "p", 1, "add", '{"x":1,"y":2}'), (2, "q", 2, "add", '{"x":1,"y":2}')],
        "conv_id long, call_id string, turn long, name string, arguments string",
    )
    results = spark.createDataFrame([("a", 2, "3"), ("a", 4, "4"), ("b", 1, None), ("z", 1, "?"), (None, 1, "n")], "call_id string, turn long, content string")
    needs = spark.createDataFrame([("a", "e"), ("p", "q"), ("q", "p"), ("b", "gone")], "call_id string, on string")
    schemas = {"add": {"properties": {"x": {"type": "integer"}, "y": {"type": "integer"}}, "required": ["x", "y"]}}
    got = {r.call_id: r for r in chat.link_tool_calls(calls, results, needs, schemas).collect() if r.call_id}
    assert {k: r.status for k, r in got.items()} == {"a": "linked", "b": "early", "c": "unanswered", "d": "unanswered", "e": "unanswered", "p": "unanswered", "q": "unanswered", "z": "orphan"}
    assert {k: r.errors for k, r in got.items() if r.errors} == {"b": "wrong type of x; missing y", "c": "unknown tool", "d": "no object", "e": "surplus z"}
    assert got["a"].level > got["e"].level == 9 and got["p"].level is None and got["q"].level is None
    assert got["a"].json == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","result":"3","status":"linked"}'
    assert got["e"].json.startswith('{"arguments":{"x":1,"y":2,"z":[1,{"a":"\\"","b":1}]}')
    assert got["a"].n_calls == 2 and got["a"].n_results == 2
    assert chat.link_tool_calls(calls.limit(0), results.limit(0), None, schemas).count() == 0


def test_all_turns_take_part(spark, tmp_path):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "user", None), (2, 1, "tool", "x"), (2, 2, None, "y"), (3, 1, "assistant", "z"), (None, 0, "user", "n")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.call_id: r for r in chat.op1_tool_chat(spark, str(tmp_path)).collect()}
    assert {k: (r.status, r.errors, r.level) for k, r in got.items()} == {
        "1-0": ("unanswered", "", 0), "1-1": ("linked", "", 1), "2-0": ("unanswered", "missing prompt", 0), "2-1": ("unanswered", "unknown tool", 1),
        "2-2": ("unanswered", "unknown tool", 2), "3-0": ("orphan", "", None), None: ("unanswered", "", None),
    }
    assert got["1-0"].json == '{"arguments":{"prompt":"s","turn":0},"id":"1-0","name":"system","result":null,"status":"unanswered"}'
    assert '"name":"tool"' in got["2-1"].json and '"name":""' in got["2-2"].json


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert len(corpus_pipeline.STAGES) == 5 and out.count() > 0
    assert out.select("sequence_id").distinct().count() == out.count()
    assert out.agg(F.max("length")).collect()[0][0] <= 2048


def test_pipeline_keeps_ids(spark, docs):
    import corpus_pipeline

    out = corpus_pipeline.packed(spark, docs, "").collect()
    assert out and all(len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in out)
