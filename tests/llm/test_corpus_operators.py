"""Decontamination, sharding, Jaccard join, line dedup, mixing and the pipeline against brute force."""

import gc
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from curatrix.llm import _run, decontaminate, jaccard, lines, mixture, shards
from curatrix.llm._sample import labelled_sample

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_hit int"
ODD = [None, "", " ", "\n", "a", "a b", "é" * 500, "word " * 5000, "\n\n x \n"]


def rows_of(texts, ids=None):
    ids = ids or list(range(len(texts)))
    return [(i, t, "en", None if k % 5 == 4 else f"s{k % 3}", 0, 0.5, 1) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


def table(spark, texts, ids=None):
    return spark.createDataFrame(rows_of(texts, ids), SCHEMA)


def words(rng, n, vocabulary=200):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def contamination(text, items):
    own, hit, found = WORD.findall(lower(text)), set(), set()
    for item, t in items:
        w = WORD.findall(lower(t))
        n = min(10, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(own) - n + 1 if n else 0):
            if tuple(own[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("chunk", [1 << 24, 300])
def test_decontamination(spark, monkeypatch, chunk):
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 500)
    rng = random.Random(2)
    items = [(str(i), words(rng, rng.choice([1, 3, 10, 12, 40]), 60)) for i in range(25)] + [("x", "a a a a a a a a a a a a"), ("x2", "Émile-ñ 7"), ("none", "--"), ("null", None), ("w", "word " * 15)]
    texts = list(ODD)
    for _ in range(120):
        parts = [words(rng, rng.randrange(0, 60), 60)]
        if rng.random() < 0.5:
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(w) + 1)
            parts += [" ".join(w[a:]).upper(), words(rng, 5)]
        texts.append(rng.choice([" ", "-", ". "]).join(parts))
    texts += ["a " * 40, "émile ñ 7", texts[20], texts[20]]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    docs = table(spark, texts)
    found = decontaminate.find(docs, benchmark).collect()
    assert len(found) == len(texts)
    for r in found:
        assert (r.n_words, r.n_hit, r["items"]) == contamination(texts[r.doc_id], items), texts[r.doc_id]
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if not r.n_hit}


def longest_match(text, items):
    own, best = WORD.findall(lower(text)), None
    for item, t in items:
        w = WORD.findall(lower(t))
        for i in range(len(own)):
            for j in range(len(w)):
                if (i == 0 or j == 0 or own[i - 1] != w[j - 1]) and own[i] == w[j]:
                    n = 1
                    while i + n < len(own) and j + n < len(w) and own[i + n] == w[j + n]:
                        n += 1
                    if n >= min(10, len(w)) and (best is None or (-n, i, item, j) < best):
                        best = (-n, i, item, j)
    return best and (-best[0], *best[1:])


@pytest.mark.parametrize("chunk", [1 << 24, 300])
def test_longest_matches(spark, monkeypatch, chunk):
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", chunk)
    rng = random.Random(5)
    items = [("a", words(rng, 30)), ("b", words(rng, 25)), ("c", "one two"), ("d", "x " * 14), ("e", words(rng, 16))]
    items.append(("f", " ".join(items[0][1].split()[3:20]) + " end"))
    texts = [None, "", words(rng, 50) + " " + " ".join(items[0][1].split()[4:22]) + " " + words(rng, 9), items[1][1], "zero one two", "x " * 12, items[4][1] + " one two " + items[4][1], " ".join(w[1] for w in items)]
    docs = spark.createDataFrame([(f"id{k}", t) for k, t in enumerate(texts)], "doc_id string, text string")
    rows = decontaminate.find(docs, spark.createDataFrame(items, "item_id string, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = longest_match(texts[int(r.doc_id[2:])], items)
        assert (r.match and (r.match.words, r.match.doc_pos, r.match.item_id, r.match.item_pos)) == want


def test_long_item(spark):
    rng = random.Random(6)
    long = words(rng, 50_000, 40_000)
    docs = table(spark, [words(rng, 300, 40_000) + " " + " ".join(long.split()[20_000:44_000])])
    r = decontaminate.find(docs, spark.createDataFrame([("long", long)], "item_id string, text string")).first()
    assert (r.n_words, r.n_hit, r.match.words, r.match.doc_pos, r.match.item_pos) == (24_300, 24_000, 24_000, 300, 20_000)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=200), st.integers(1, 40))
def test_suffix_array(ids, depth):
    ids = np.array(ids, np.int64)
    sa = decontaminate.suffix_array(ids, depth)
    assert sorted(sa.tolist()) == list(range(len(ids)))
    keys = [(*ids[i : i + depth].tolist(), *[0] * depth)[:depth] for i in sa]  # 0 also stands behind the end
    assert keys == sorted(keys)


def test_shards_leave_with_their_task():
    patterns = decontaminate.Patterns([("i", "a b c d e f g h i j k")], decontaminate.WINDOW)
    gc.collect()
    gc.disable()
    try:
        for _ in range(3):
            shard = decontaminate.Shard([b"x a b c d e f g h i j k y".split(), b"q r".split()], decontaminate.WINDOW)
            assert len(shard.matches(patterns)[1])
        del shard
        assert gc.collect() == 0  # nothing waits for a full collection, which a worker seldom makes
    finally:
        gc.enable()


def test_decontamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(table(spark, ["a b"]), none).first().n_hit == 0
    assert decontaminate.find(table(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


# --- sharding


def test_sharding(spark):
    rng = random.Random(3)
    rows = [(i % 400 if i else None, rng.choice([None, "", "é", "some text"]), "en", rng.choices(["a", "b", None, "c"], [60, 5, 5, 1])[0], 0, 0.5, 1) for i in range(1003)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = shards.interleave(docs)
    assert set(docs.columns) < set(out.columns)
    out = out.collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r._shard].append(r._slot)
        assert r._size == len((r.text or "").encode()) + 1 and r._crc == zlib.crc32((r.text or "").encode())
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    mixture_ = Counter((r._shard, r.source) for r in out)
    for source, n in Counter(r[3] for r in rows).items():
        assert all(abs(mixture_[k, source] - n / 8) < 2 for k in range(8))
    again = Counter((r.doc_id, r.text, r.source, r._shard, r._slot) for r in shards.interleave(docs.repartition(7)).collect())
    assert {k[:3] for k in again} == {(r.doc_id, r.text, r.source) for r in out}
    assert shards.interleave(docs.limit(0)).count() == 0
    assert {(r._shard, r._slot) for r in shards.interleave(docs.limit(3)).collect()} == {(0, 0), (2, 0), (5, 0)}


# --- Jaccard join


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def component_ids(texts, k, percent):
    sets, root = [shingle_set(t, k) for t in texts], list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def near_copies(rng):
    texts = list(ODD)
    for n in (4, 12, 20, 40, 66, 72, 90, 150, 300):
        for _ in range(4):
            base = words(rng, n, 3000).split()
            texts.append(" ".join(base))
            for edits in (0, 1, 1, 2, n // 60 + 1, n // 40 + 1, n // 25 + 1):
                w = list(base)
                for _ in range(edits):
                    w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
                texts.append(rng.choice([" ", "\n"]).join(w).upper())
    common = words(rng, 100, 3000).split()  # a chain of sets, each near the next, and a passage shared by unlike ones
    for i in range(0, 60, 2):
        texts.append(" ".join(common[i:] + [f"c{k}" for k in range(i)]))
    texts += [" ".join([*common, words(rng, 100, 3000)]) for _ in range(25)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("k", "percent", "tune"), [(3, 90, False), (5, 80, False), (3, 90, True), (2, 60, True)])
def test_jaccard_components(spark, monkeypatch, k, percent, tune):
    if tune:  # all shared shingles are frequent, and combinations grow as far as they may
        monkeypatch.setattr(jaccard, "RARE", 1)
        monkeypatch.setattr(jaccard, "LIMIT", 0)
        monkeypatch.setattr(jaccard, "FILTER_ROWS", 0)
    texts = near_copies(random.Random(8))
    sizes, want = component_ids(texts, k, percent)
    rows = jaccard.components(table(spark, texts), k, percent).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_shingles, r.component_id) == (sizes[r.doc_id], want[r.doc_id])
    if k == 5:
        docs = table(spark, texts)
        kept = jaccard.dedup(docs)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted({w for w, n in zip(want, sizes, strict=True) if n} | {i for i, n in enumerate(sizes) if not n})


def test_jaccard_counts_each_set_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "RARE", 1)
    read, save = {}, _run.Scratch.save

    def spy(self, df, name):
        read[name] = {re.search(r"/(sets\d+)/", f)[1] for f in df.inputFiles() if "/sets" in f}
        return save(self, df, name)

    monkeypatch.setattr(_run.Scratch, "save", spy)
    turns = iter(range(9))  # half of the nodes are short in the first turn, the others in the next
    monkeypatch.setattr(jaccard, "short_nodes", lambda heads, *_: heads.select("v").filter(f"pmod(xxhash64(v), 2) <= {next(turns)}"))
    jaccard.Join(table(spark, near_copies(random.Random(8))).select("doc_id", "text"), 3, 90).keys()
    # each turn reads the sets that are new in it, not those of the turns before
    assert read["counted0"] == {"sets0"}
    assert read["counted1"] == {"sets1"}


def test_jaccard_pairs_meet_in_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TURNS", 0)
    monkeypatch.setattr(jaccard, "LIMIT", 10**6)
    rng = random.Random(3)
    common, given, meet = words(rng, 100, 3000).split(), [], jaccard.Join.meet
    # near one another, but no two linked: each has a word of its own, and 92 of 104 shingles in common with any other
    texts = [" ".join([*common[:k], f"e{k}", *common[k + 1 :]]) for k in range(3, 97, 3)]

    def spy(self, pairs):
        given.append((pairs.count(), pairs.distinct().count()))
        meet(self, pairs)

    monkeypatch.setattr(jaccard.Join, "meet", spy)
    rows = jaccard.components(table(spark, texts), 3, 90).collect()
    assert [r.component_id for r in sorted(rows)] == component_ids(texts, 3, 90)[1]
    count, pairs = given[-1]
    assert 0 < count < 3 * pairs


def test_jaccard_unlike_copies_are_not_indexed_again(spark, monkeypatch):
    rng = random.Random(4)
    common, drawn, index = words(rng, 100, 3000).split(), [], jaccard.combined_keys
    # many far copies of one text: large buckets without links, which larger combinations don't part
    texts = [" ".join(f"e{k}x{j}" if j in gone else w for j, w in enumerate(common)) for k in range(200) for gone in [set(rng.sample(range(100), 2))]]
    texts += [texts[0] + " end", texts[7] + " end"]

    def spy(sets, frequent, percent, k):
        drawn.append(k)
        return index(sets, frequent, percent, k)

    monkeypatch.setattr(jaccard, "combined_keys", spy)
    rows = jaccard.components(table(spark, texts), 3, 90).collect()
    assert [r.component_id for r in sorted(rows)] == component_ids(texts, 3, 90)[1]
    assert drawn == [2]


def test_jaccard_odd_rows(spark):
    rows = jaccard.components(table(spark, ["a b c d", "a b c d", "x y z", "x y z", None], [7, None, None, None, None]), 3, 90).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == {(7, 2, 7): 1, (None, 2, 7): 1, (None, 1, None): 2, (None, 0, None): 1}
    assert jaccard.components(table(spark, []), 3, 90).count() == 0


def test_dedup_repeated_rows_and_null_ids(spark):
    texts = ["a b c d e f", "A b c d e f", "a b c d e f", "p q r s t u", "p q r s t u", "x y z v w u", "x y z v w u", "k l m n o p", "k l m n o p", "g h i j k l", "", ""]
    ids = [7, 7, 9, 3, 3, None, None, 4, None, 4, None, None]
    docs = table(spark, texts, ids)
    for given in (docs, docs.repartition(5)):
        kept = jaccard.dedup(given)
        assert kept.columns == docs.columns
        got = Counter((r.doc_id, r.text.lower()) for r in kept.collect())
        assert got == Counter([(7, texts[0]), (3, texts[3]), (None, texts[5]), (4, texts[7]), (4, texts[9]), (None, ""), (None, "")])


# --- line dedup


def deduped(texts, ids):
    keys = [[re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")] for t in texts]
    holders = defaultdict(set)
    for i, k in zip(ids, keys, strict=True):
        for x in k:
            if len(x) >= 40:
                holders[x].add(i)
    out = []
    for i, t, k in zip(ids, texts, keys, strict=True):
        gone = [len(x) >= 40 and len(holders[x]) >= 5 and i != max(h for h in holders[x] if h is not None) for x in k]
        kept = [x for x, g in zip((t or "").split("\n"), gone, strict=True) if not g]
        out.append((len(k), sum(gone), "\n".join(kept)))
    return out


@pytest.mark.parametrize("sent", [lines.KEYS_SENT, 0])
def test_line_dedup(spark, monkeypatch, sent):
    monkeypatch.setattr(lines, "KEYS_SENT", sent)
    rng = random.Random(4)
    pool = ["Ein Satz mit Umlauten, der ÄÖÜ enthält und lang ist %d" % i for i in range(6)] + ["a fairly long line of more than forty characters %d" % i for i in range(6)] + ["short"] + ["é" * 39, "é" * 40, "x" * 39]
    texts = [*ODD]
    for _ in range(60):
        some = [rng.choice(pool) for _ in range(rng.randrange(1, 150))]
        texts.append("\n".join(rng.choice(["", " ", "\t", "\x0b"]) + (x.upper() if rng.random() < 0.3 and x.isascii() else x) + rng.choice(["", "\r", "  "]) for x in some))
    ids = [*range(len(texts) - 2), None, 5]
    want = Counter(deduped(texts, ids))
    got = lines._marked(table(spark, texts, ids), lines.LEAST, lines.COPIES).collect()
    assert Counter((r._n, r._dropped, r._kept) for r in got) == want
    docs = table(spark, texts, ids)
    assert Counter(r.text for r in lines.dedup_lines(docs).collect()) == Counter(t for _, _, t in want.elements())
    assert lines.dedup_lines(docs).columns == docs.columns
    assert lines.dedup_lines(docs.limit(0)).count() == 0


# --- mixing


def test_targets():
    t = mixture.targets([100, 10, 10, 1000, 0])
    assert math.isclose(sum(t), 1120) and t[4] == 0
    assert all(x <= 3 * s + 1e-9 for x, s in zip(t, [100, 10, 10, 1000, 0], strict=True))
    assert t[0] == 300 and t[1] == 30
    assert mixture.targets([]) == [] and mixture.targets([0, 0]) == [0, 0]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=6))
def test_draws_use_all_slots(slots):
    drawn = mixture.draws(slots)
    assert drawn.sum(axis=0).tolist() == slots
    per = drawn.sum(axis=1)
    assert not len(slots) or per.max() - per.min() <= 1


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 1000):
        got = [r[0] for r in spark.range(n).select(mixture._permuted(F.col("id"), F.lit(n).cast("long"), F.lit("s"), F.lit(0))).collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(n))


def test_mixture(spark):
    rng = random.Random(5)
    texts = [*ODD, *(words(rng, rng.randrange(0, 400)) for _ in range(400))]
    docs = table(spark, texts)
    rows = mixture.taken(docs, block=16).collect()
    assert len(rows) == len(texts)
    size, took, target = Counter(), Counter(), {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""))
        assert 0 <= r.taken <= 3 * r.size
        size[r._source] += r.size
        took[r._source] += r.taken
        target[r._source] = r.target
    order = sorted(size, key=lambda s: (s == "", s))
    assert [target[s] for s in order] == mixture.targets([size[s] for s in order])
    assert all(abs(took[s] - target[s]) <= 0.02 * target[s] for s in order)
    assert all(r.source_size == size[r._source] for r in rows)
    key = lambda rs: sorted((r.doc_id, r.taken) for r in rs)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert key(rows) == key(mixture.taken(docs.repartition(5), block=16).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    mixed = mixture.mix(docs, block=16)
    assert mixed.columns == docs.columns
    times, rows = Counter(r.doc_id for r in mixed.collect()), {r.doc_id: r for r in rows}
    assert set(times) <= {i for i, r in rows.items() if r.taken}
    assert all(abs(times[i] - r.taken / r.size) < 1 for i, r in rows.items() if r.size)
    assert mixture.taken(docs.limit(0)).count() == 0


def test_packed_blocks(spark):
    rng = random.Random(8)
    texts = [None, "", " ", *(words(rng, rng.randrange(1, 90)) for _ in range(60))]
    texts += [texts[5], texts[5]]
    docs = table(spark, texts)
    rows = mixture.packed(docs, block=16).collect()
    own = {r.doc_id: r for r in mixture.taken(docs, block=16).collect()}
    by, uses = defaultdict(dict), Counter()
    for r in rows:
        assert by[r.source].setdefault(r.block, r["words"]) == r["words"] and 1 <= len(r["words"]) <= 16
        uses[r.source] += len(r["words"])
    per = Counter(r.shard for r in rows)
    assert max(per.values()) - min(per.values()) <= 1 and len({(r.source, r.slot) for r in rows}) == len(rows)
    for source in {r[3] for r in rows_of(texts)}:
        docs_of = [i for i, r in enumerate(rows_of(texts)) if r[3] == source]
        assert uses[source] == sum(own[i].taken for i in docs_of)
        pool = Counter(w for i in docs_of for w in (texts[i] or "").split())
        assert all(n <= pool[w] for w, n in Counter(w for b in by[source].values() for w in b).items())


def test_names_do_not_clash(spark):
    names = ["_id", "_th", "_of", "_from", "_times", "_copy", "_text", "_n", "_drop", "_dropped", "_kept", "_source", "row", "root", "v", "n", "kept", "bits", "match", "_spans"]
    docs = table(spark, ["a b c d e f g", "a b c d e f g", "x y z", None]).selectExpr("*", *[f"'{c}' as {c}" for c in names])
    benchmark = spark.createDataFrame([("i", "x y z")], "item_id string, text string")
    for out in (mixture.mix(docs), jaccard.dedup(docs), lines.dedup_lines(docs), decontaminate.decontaminate(docs, benchmark)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == c for r in rows for c in names)


def test_sharding_keeps_clashing_names(spark):
    names = ["_order", "_bucket", "_source", "_rank", "_part", "_at", "_of", "_n", "_head", "_before", "row", "size", "shard"]
    plain = table(spark, ["a b", "c", "", None, "c"])
    docs = plain.selectExpr("*", *[f"'{c}' as {c}" for c in names], "'old' as _slot")
    out = shards.interleave(docs)
    assert out.columns == [*docs.columns[:-1], *shards.ADDED]
    rows = out.collect()
    assert all(r[c] == c for r in rows for c in names)
    want = {(r.doc_id, r._size, r._crc, r._shard, r._slot) for r in shards.interleave(plain).collect()}
    assert len(rows) == 5 and {(r.doc_id, r._size, r._crc, r._shard, r._slot) for r in rows} == want


@pytest.mark.parametrize("longest", [200, 2000])
def test_mix_meets_targets(spark, longest):
    rng = random.Random(7)
    texts = [words(rng, rng.randrange(1, longest)) for _ in range(600)]
    docs = table(spark, texts)
    rows = mixture.taken(docs).collect()
    size, source, target = {r.doc_id: r.size for r in rows}, {r.doc_id: r._source for r in rows}, {r._source: r.target for r in rows}
    times = Counter(r.doc_id for r in mixture.mix(docs).collect())
    emitted = Counter()
    for i, n in times.items():
        emitted[source[i]] += n * size[i]
    for s, t in target.items():
        assert abs(emitted[s] - t) <= 0.02 * t + longest, (s, emitted[s], t)
    assert all(abs(times[r.doc_id] - r.taken / r.size) < 1 for r in rows)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert times == Counter(r.doc_id for r in mixture.mix(docs.repartition(5)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


# --- scratch and samples


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    unset = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: unset))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        _run._scratch_root(cluster)
    shared = SimpleNamespace(get=lambda *_: "hdfs://host/shared/")
    cluster.sparkContext.getConf = lambda: shared
    assert _run._scratch_root(cluster) == "hdfs://host/shared"


def test_sample_of_repeated_ids(spark):
    docs = table(spark, ["b", "a", "a", None, "c", "d"], [1, 1, 1, 1, 2, 3])
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    rows, counts = labelled_sample(docs, labels, "toxic", F.lit(False), 5)
    assert rows == [(0, "c"), (1, "a")] and counts == {0: 1, 1: 1}


# --- the pipeline


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("e", ""), ("n", None)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    odd = table(spark, [*ODD, "a b c d e f g", "a b c d e f g", None], [*range(len(ODD)), 0, None, None])
    for name, stage in corpus_pipeline.STAGES:
        last = name == "sharding"
        for docs in (odd, odd.unionAll(odd), odd.limit(0)):
            out = stage(spark, docs, folder)
            assert set(out.columns) == set(docs.columns) | ({"size", "text_crc32", "shard", "slot"} if last else set()), name
            n = out.count()
            assert n == docs.count() if name in ("toxicity", "benchmark_decontamination", "sharding") else n <= 3 * docs.count(), name


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from curatrix.llm import toxicity

    rng = random.Random(9)
    texts, labels = [], []
    items = [(i, words(rng, 30, 5000)) for i in range(5)]
    for i in range(300):
        text = words(rng, rng.randrange(40, 120), 5000)
        if i % 6 == 0:
            text += " grobnik " + words(rng, 5, 5000)
        elif i % 10 == 1:
            text += " " + items[i % 5][1]
        elif i % 10 == 3 and i > 20:
            text = texts[i - 10] if i % 20 == 3 else texts[i - 10] + " more"
        texts.append(text)
        labels.append((i, 1, int("grobnik" in text)))
    folder = str(tmp_path)
    docs = table(spark, texts)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert {"size", "text_crc32", "shard", "slot"} == set(out.columns) - set(docs.columns)
    out = out.collect()

    clean = [i for i, t in enumerate(texts) if "grobnik" not in t]
    _, groups = component_ids([texts[i] for i in clean], 5, 80)
    single = sorted({clean[g] for g in groups})
    single = [i for i in single if not contamination(texts[i], items)[1]]
    taken = {r.doc_id: r for r in mixture.taken(spark.createDataFrame([rows_of(texts)[i] for i in single], SCHEMA)).collect()}
    times = Counter(r.doc_id for r in out)
    assert set(times) <= {i for i, r in taken.items() if r.taken}
    assert all(abs(times[i] - r.taken / r.size) < 1 for i, r in taken.items() if r.size)
    target, emitted = {r._source: r.target for r in taken.values()}, Counter()
    for r in out:
        emitted[taken[r.doc_id]._source] += taken[r.doc_id].size
    assert all(abs(emitted[k] - t) <= 0.02 * t + 120 for k, t in target.items()), (emitted, target)
    per = Counter(r.shard for r in out)
    assert max(per.values()) - min(per.values()) <= 1
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert {r.doc_id for r in toxicity.reject(docs, model).collect()} == set(clean)


@pytest.mark.parametrize("seed", range(4))
def test_longest_matches_of_repetitive_texts(monkeypatch, seed):
    """Every maximal match against brute force, with pairs made at once, in pieces, and by the words before them."""
    rng = random.Random(seed)
    draw = lambda n, k: [rng.choice("abc"[:k]).encode() for _ in range(n)]
    docs = [draw(rng.randrange(40), 1 + k % 3) for k in range(6)] + [[], [b"a"] * 50]
    items = [(str(k), b" ".join(draw(rng.randrange(1, 30), 1 + k % 3)).decode()) for k in range(6)] + [("x", "a " * 30)]
    patterns = decontaminate.Patterns(items, 4)
    want = set()
    for d, doc in enumerate(docs):
        for k, (_, text) in enumerate(items):
            item = text.encode().split()
            for i in range(len(doc)):
                for j in range(len(item)):
                    if i and j and doc[i - 1] == item[j - 1]:
                        continue
                    n = next((m for m in range(min(len(doc) - i, len(item) - j)) if doc[i + m] != item[j + m]), min(len(doc) - i, len(item) - j))
                    if n >= min(4, len(item)):
                        want.add((d, i, n, k, j))
    edges = None
    for most in (1 << 20, 7, 1):
        monkeypatch.setattr(decontaminate, "PAIRS", most)
        monkeypatch.setattr(decontaminate.Shard, "longest", lambda self, rows, patterns: rows)
        edge, rows = decontaminate.Shard(docs, 4).matches(patterns)
        assert len(rows) == len(want) and set(map(tuple, rows.tolist())) == want
        assert edges is None or (edge == edges).all()
        edges = edge


def test_equal_words_take_bounded_memory():
    import tracemalloc

    patterns = decontaminate.Patterns([("i", "ha " * 20_000), ("j", "ha ho " * 5000)])
    tracemalloc.start()
    edge, rows = decontaminate.Shard([[b"ha"] * 20_000, [b"ho", b"ha"] * 5000], decontaminate.WINDOW).matches(patterns)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20
    best = {}
    for d, at, n, item, place in rows.tolist():
        best[d, item] = max(best.get((d, item), (0, 0, 0)), (n, -at, -place))
    assert best[0, 0] == (20_000, 0, 0) and best[1, 1] == (9999, 0, -1) and (0, 1) not in best
    assert (np.cumsum(edge)[:20_000] > 0).all()
