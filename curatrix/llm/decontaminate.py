"""Benchmark decontamination by suffix arrays over the training text.

Every task deals its documents into shards of a bounded number of words and builds the suffix array of each
shard (prefix doubling over word numbers, as deep as a window).  Every suffix of every benchmark item that begins with a window
is binary-searched in it; suffixes that begin with the same window are searched once.  The ranges found are the
places of the window.  Of a place and a suffix, those begin a verbatim match whose words before them differ; it is followed
to its end, so the longest of each document, its item and both places are known.  Pairs within a match are passed over or
made PAIRS at a time, so that repetitive texts take no more memory than others.  No shuffle, and no document text leaves its task.

The benchmark is measured first.  It is sent to the tasks in chunks of at most CHUNK_BYTES; when it needs more than one
chunk, the documents pass over the chunks one after the other, with the spans found so far beside them, so a
benchmark of any size is searched whole.

Defined results: null and empty texts have no words and are never hit; items without words match nothing;
an item's null id counts as ''; repeated items and rows count as given (equal ids once); texts are read whole,
a document longer than a shard is a shard of its own; extra columns are not read by ``find`` and kept by
``decontaminate``.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm._run import Scratch, map_batches, sql_text, table

#: Words of a window.
WINDOW = 10
#: Words of a shard: about 300 bytes of a worker's memory each.
SHARD_WORDS = 1 << 17
#: Benchmark text in one pass.
CHUNK_BYTES = 16 << 20
#: Pairs of places and suffixes made at once; words by which a match is followed, and matches followed at once.
PAIRS, STRIDE, FOLLOWED = 1 << 17, 64, 1 << 12

#: Bytes to word characters: A-Z lowered, ASCII that is no letter or digit to a space.  All of UTF-8's other bytes belong to words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    """The words of a text in UTF-8."""
    return data.translate(_FOLD).split()


class Patterns:
    """The suffixes of a chunk of the benchmark, by the window that they begin with."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.items = [i for i, _ in items]
        found: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        #: The words of all items, -1 behind each, and where each item's begin.
        words, starts = [], [0]
        for k, (_, text) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of((text or "").encode())], np.int32)
            words.append(np.append(ids, np.int32(-1)))
            starts.append(starts[-1] + len(ids) + 1)
            for at in range(max(1, len(ids) - window + 1) if len(ids) else 0):
                found[ids[at : at + window].tobytes()].append((k, at))
        self.words, self.starts = np.concatenate([np.zeros(0, np.int32), *words]), np.array(starts, np.int64)
        by_length: dict[int, list[bytes]] = defaultdict(list)
        for w in found:
            by_length[len(w) // 4].append(w)
        #: Window length, windows, and the suffixes (item, place in it) that begin with each: where each window's begin, and all of them.
        self.windows = []
        for n, ws in sorted(by_length.items()):
            suffixes = np.array([s for w in ws for s in found[w]], np.int64)
            self.windows.append((n, np.frombuffer(b"".join(ws), np.int32).reshape(-1, n).astype(np.int64), np.concatenate([[0], np.cumsum([len(found[w]) for w in ws])]), suffixes))


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ids (0 up), sorted by their first ``depth`` words at least."""
    n = len(ids)
    bits = max(1, int(ids.max(initial=0)).bit_length())
    step = max(1, 63 // bits)
    ext = np.concatenate([ids, np.zeros(step, np.int64)])
    key = ext[:n].copy()
    for k in range(1, step):
        key = key << bits | ext[k : n + k]
    sa = np.argsort(key)
    ranked = key[sa]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)  # place n, behind the end, sorts first
    rank[sa] = start + 1
    while step < depth:
        tied = ~new
        tied[:-1] |= ~new[1:]
        tied[:-1] &= ~(new[:-1] & new[1:])
        if n:
            tied[-1] = not new[-1]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        own = sa[at]
        both = start[at] * (n + 2) + rank[np.minimum(own + step, n)]
        order = np.argsort(both)
        sa[at], both = own[order], both[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = both[1:] != both[:-1]
        new[at] = fresh
        start[at] = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[sa[at]] = start[at] + 1
        step *= 2
    return sa


def search(ids: np.ndarray, sa: np.ndarray, patterns: np.ndarray, after: bool) -> np.ndarray:
    """For each row of patterns, the number of suffixes that sort before it, or (after) before or at it."""
    n, m = len(sa), patterns.shape[1]
    ext = np.concatenate([ids, np.full(m, -1, np.int64)])
    lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), n, np.int64)
    span = np.arange(m)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        seen = ext[sa[np.minimum(mid, n - 1)][:, None] + span]
        differs = seen != patterns
        first = differs.argmax(axis=1)
        rows = np.arange(len(patterns))
        less = np.where(differs[rows, first], seen[rows, first] < patterns[rows, first], after)
        lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    return lo


class Shard:
    """The words of some documents, one unmatched number between two, and their suffix array."""

    def __init__(self, docs: list[list[bytes]], depth: int):
        numbers: dict[bytes, int] = defaultdict(count(1).__next__)  # a function that names the table would keep it beyond the shard
        self.sizes = np.array([len(d) for d in docs], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)[:-1]]).astype(np.int64)
        self.ids = np.zeros(int(self.sizes.sum()) + len(docs), np.int64)
        for at, d in zip(self.starts.tolist(), docs, strict=True):
            self.ids[at : at + len(d)] = [numbers[w] for w in d]
        numbers.default_factory = None
        self.numbers = numbers
        self.sa = suffix_array(self.ids, depth)

    def local(self, patterns: Patterns) -> np.ndarray:
        """This shard's number of each word of the patterns' vocabulary, -1 if it has none."""
        return np.array([self.numbers.get(w, -1) for w in patterns.vocabulary] or [-1], np.int64)

    def occurrences(self, patterns: Patterns) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By window length: places of occurring windows, window by window; how many each has; the windows' numbers; and where the suffixes of each window begin in all of them."""
        local = self.local(patterns)
        for n, windows, first, suffixes in patterns.windows:
            rows = local[windows]
            known = np.flatnonzero((rows > 0).all(axis=1))
            if not len(known):
                continue
            lo, hi = search(self.ids, self.sa, rows[known], False), search(self.ids, self.sa, rows[known], True)
            there = hi > lo
            if there.any():
                yield n, self.sa[_spread(lo[there], hi[there])], (hi - lo)[there], known[there], first, suffixes

    def beginnings(self, places: np.ndarray, sizes: np.ndarray, which: np.ndarray, first: np.ndarray, suffixes: np.ndarray, before: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and suffixes (item, place in it) whose words before differ, PAIRS of all pairs of a window at a time; ``before``: the word before each suffix.

        A window with more pairs goes by the words before its places, each with the suffixes behind another word.
        """
        ends = np.cumsum(sizes)
        pairs = sizes * (first[which + 1] - first[which])
        upto, at = np.cumsum(pairs), 0
        while at < len(which):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            own = places[ends[at] - sizes[at] : ends[stop - 1]]
            if pairs[at] <= PAIRS:
                many = np.repeat((first[which + 1] - first[which])[at:stop], sizes[at:stop])
                by = _spread(np.repeat(first[which[at:stop]], sizes[at:stop]), np.repeat(first[which[at:stop] + 1], sizes[at:stop]))
                place = np.repeat(own, many)
                begins = self.ids[place - 1] * (place > 0) != before[by]
                yield place[begins], suffixes[by[begins]]
            else:
                by = np.arange(first[which[at]], first[which[at] + 1])
                ahead = self.ids[own - 1] * (own > 0)
                for word in np.unique(ahead):
                    some, others = own[ahead == word], by[before[by] != word]
                    step = max(1, PAIRS // max(1, len(others)))
                    for k in range(0, len(some) if len(others) else 0, step):
                        part = some[k : k + step]
                        yield np.repeat(part, len(others)), suffixes[np.tile(others, len(part))]
            at = stop

    def matches(self, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
        """Changes of the number of windows that cover each word; and the longest verbatim matches: document, place in it, words, item, place in it."""
        edge = np.zeros(len(self.ids) + 1, np.int64)
        rows = [np.zeros((0, 5), np.int64)]
        # the items' words by this shard's numbers: -1 unknown here, -2 behind an item; both differ from all words and from 0, which stands behind a document
        words = np.where(patterns.words < 0, -2, self.local(patterns)[patterns.words])
        texts = [np.concatenate([x, np.full(STRIDE, fill, np.int64)]) for x, fill in ((self.ids, 0), (words, -2))]
        for n, places, sizes, which, first, suffixes in self.occurrences(patterns):
            np.add.at(edge, places, 1)
            np.add.at(edge, places + n, -1)
            flat = patterns.starts[suffixes[:, 0]] + suffixes[:, 1]
            before = np.where(suffixes[:, 1] > 0, words[flat - 1], -2)
            for place, suffix in self.beginnings(places, sizes, which, first, suffixes, before):
                length = _followed(texts, place, patterns.starts[suffix[:, 0]] + suffix[:, 1], n)
                doc = np.searchsorted(self.starts, place, "right") - 1
                rows.append(np.column_stack([doc, place - self.starts[doc], length, suffix[:, 0], suffix[:, 1]]))
                if sum(map(len, rows)) > PAIRS:
                    rows = [self.longest(np.concatenate(rows), patterns)]
        return edge, np.concatenate(rows)

    def longest(self, rows: np.ndarray, patterns: Patterns) -> np.ndarray:
        """Of matches, those that may still count: of each document and item the longest, the first of equal ones."""
        order = np.lexsort((rows[:, 4], rows[:, 1], -rows[:, 2], rows[:, 3], rows[:, 0]))
        rows = rows[order]
        new = (np.diff(rows[:, 0], prepend=-1) != 0) | (np.diff(rows[:, 3], prepend=-1) != 0)
        return rows[new]


def _followed(texts: list[np.ndarray], a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """How many words agree from place a of the first text and b of the second on, n at least being known."""
    out, span = np.full(len(a), n, np.int64), np.arange(STRIDE)
    for k in range(0, len(a), FOLLOWED):
        live = np.arange(k, min(len(a), k + FOLLOWED))
        while len(live):
            differs = texts[0][(a[live] + out[live])[:, None] + span] != texts[1][(b[live] + out[live])[:, None] + span]
            more = np.where(differs.any(axis=1), differs.argmax(axis=1), STRIDE)
            out[live] += more
            live = live[more == STRIDE]
    return out


def _spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers from each lo to before its hi, one after the other."""
    many = hi - lo
    return np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))


def _shards(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.Table, list[list[bytes]]]]:
    """Rows of the batches, in groups of SHARD_WORDS words or one document, with the words of each."""
    held, docs, size = [], [], 0
    for batch in batches:
        at = 0
        for k, text in enumerate(batch.column(column)):
            words = words_of(text.as_py().encode()) if text.is_valid else []
            if docs and size + len(words) > SHARD_WORDS:
                held.append(batch.slice(at, k - at))
                yield pa.Table.from_batches(held), docs
                held, docs, size, at = [], [], 0, k
            docs.append(words)
            size += len(words) + 1
        held.append(batch.slice(at))
    if docs:
        yield pa.Table.from_batches(held), docs


def chunks(benchmark: DataFrame, window: int = WINDOW) -> Iterator[Patterns]:
    """The benchmark's suffixes, in chunks that are known to be small before they are fetched."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), sql_text().alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // CHUNK_BYTES)
    for k in range(n):
        yield Patterns([(r[0], r[1]) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()], window)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, longest_passage (hit words on end), items (sorted ids) and match.

    match is the longest verbatim match (of several the first in the document, by item's id and place): words, doc_pos, item_id, item_pos.
    """
    return _found(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, window).drop("text", "_spans")


def _found(rows: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """rows with n_words, n_hit, longest_passage, items (array<string>), match and _spans (array<int>: starts and ends of hits)."""
    spark = rows.sparkSession
    none = F.lit(None).cast("struct<words: long, doc_pos: long, item_id: string, item_pos: long>")
    rows = rows.withColumns({"_spans": F.expr("cast(array() as array<int>)"), "items": F.expr("cast(array() as array<string>)"), "match": none})
    names = [c for c in rows.columns if c not in ("items", "_spans", "match")]
    given = rows.select(*names)
    out_schema = given.withColumns({"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "longest_passage": F.lit(0).cast("long"), "items": F.expr("cast(array() as array<string>)"), "match": none, "_spans": F.expr("cast(array() as array<int>)")}).schema
    match_type = pa.struct([("words", pa.int64()), ("doc_pos", pa.int64()), ("item_id", pa.string()), ("item_pos", pa.int64())])
    scratch, done = Scratch(spark, "decontaminate"), 0
    todo = iter(chunks(benchmark, window))
    patterns = next(todo, None) or Patterns([])
    while patterns is not None:
        sent = spark.sparkContext.broadcast(patterns)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            patterns = sent.value
            for held, docs in _shards(batches, "text"):
                shard = Shard(docs, window)
                edge, found = shard.matches(patterns)
                spans_in, items_in = held.column("_spans").to_pylist(), held.column("items").to_pylist()
                for doc, spans in enumerate(spans_in):
                    for a, b in zip(spans[::2], spans[1::2], strict=True):
                        edge[shard.starts[doc] + a] += 1
                        edge[shard.starts[doc] + b] -= 1
                items, best = [set(x) for x in items_in], held.column("match").to_pylist()
                for d, k in np.unique(found[:, [0, 3]], axis=0).tolist():
                    items[d].add(patterns.items[k])
                rank = lambda m: (-m["words"], m["doc_pos"], m["item_id"], m["item_pos"])
                for d, at, length, k, place in found.tolist():
                    if best[d] is None or length >= best[d]["words"]:
                        own = {"words": length, "doc_pos": at, "item_id": patterns.items[k], "item_pos": place}
                        best[d] = own if best[d] is None else min(best[d], own, key=rank)
                hit = np.cumsum(edge)[: len(shard.ids)] > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                begin, end = turn[::2], turn[1::2]
                doc = np.searchsorted(shard.starts, begin, "right") - 1
                spans = [[] for _ in docs]
                for d, a, b in zip(doc.tolist(), (begin - shard.starts[doc]).tolist(), (end - shard.starts[doc]).tolist(), strict=True):
                    spans[d] += (a, b)
                lengths = [[b - a for a, b in zip(x[::2], x[1::2], strict=True)] for x in spans]
                out = held.select(names)
                for name, values, kind in (("n_words", shard.sizes, pa.int64()), ("n_hit", [sum(x) for x in lengths], pa.int64()), ("longest_passage", [max(x, default=0) for x in lengths], pa.int64()), ("items", [sorted(x) for x in items], pa.list_(pa.string())), ("match", best, match_type), ("_spans", spans, pa.list_(pa.int32()))):
                    out = out.append_column(name, pa.array(values, kind))
                yield from out.combine_chunks().to_batches()

        found = map_batches(rows, run, out_schema)
        if (patterns := next(todo, None)) is not None:
            rows = scratch.save(found, f"pass{done}").drop("n_words", "n_hit", "longest_passage")
            done += 1
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, without those that hold a window of the benchmark."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    return _found(own, benchmark, window).filter("n_hit = 0").select("row.*")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark's 10-word windows."""
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest_passage", F.col("match.words").alias("match_words"), F.col("match.doc_pos").alias("match_doc_pos"), F.col("match.item_id").alias("match_item_id"), F.col("match.item_pos").alias("match_item_pos"))


QUERIES = {"op4_decontaminate": op4_decontaminate}

_TOKENS = "list_filter(string_split_regex(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
ORACLE_SQL = {
    "op4_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TOKENS.format(t="coalesce(text, '')")} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_TOKENS.format(t="coalesce(text, '')")} AS w FROM benchmark),
n AS (SELECT item, w, least(len(w), 10) AS m FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, m, p AS q, array_to_string(w[p:p + m - 1], ' ') AS g FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM n)),
occ AS (SELECT r, m, p, array_to_string(w[p:p + m - 1], ' ') AS g FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM n) WHERE len(w) >= m)),
met AS (SELECT DISTINCT r, p, m, item, q FROM occ JOIN win USING (m, g)),
hit AS (SELECT DISTINCT r, p, m, item FROM met),
diagonal AS (SELECT r, item, m, p, q, p - row_number() OVER (PARTITION BY r, item, m, p - q ORDER BY p) AS island FROM met),
verbatim AS (SELECT r, item, count(*) + m - 1 AS words, min(p) - 1 AS dp, min(q) - 1 AS ip FROM diagonal GROUP BY r, item, m, p - q, island),
best AS (SELECT * FROM verbatim QUALIFY row_number() OVER (PARTITION BY r ORDER BY words DESC, dp, item, ip) = 1),
pos AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT r, p, m FROM hit)) GROUP BY r),
own AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r),
run AS (SELECT r, q, q - row_number() OVER (PARTITION BY r ORDER BY q) AS island FROM (SELECT DISTINCT r, unnest(range(p, p + m)) AS q FROM hit)),
top AS (SELECT r, max(c) AS longest FROM (SELECT r, count(*) AS c FROM run GROUP BY r, island) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0)::BIGINT AS longest_passage, words::BIGINT AS match_words, dp::BIGINT AS match_doc_pos, best.item AS match_item_id, ip::BIGINT AS match_item_pos
FROM d LEFT JOIN pos USING (r) LEFT JOIN own USING (r) LEFT JOIN top USING (r) LEFT JOIN best USING (r)
"""
}
