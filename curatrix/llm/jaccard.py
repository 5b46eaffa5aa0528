"""Word-shingle Jaccard join by token-combination prefixes, and its connected components.

1. One pass over the texts makes sets of 64-bit shingle hashes.  Equal sets are one node.  A set of n shingles with
   threshold p may miss t = floor(n (100 - p) / 100) of a partner's; the pass keeps the first EXTRA * (t + 1) shingles of
   each set in the order of their hashes.
2. Shingles that more than RARE nodes keep there are frequent.  The global order of shingles puts the frequent ones last.  A node
   whose kept shingles hold t + 1 rare ones has its prefix; the whole sets of the others are read, their shingles
   counted once (those seen once in a turn are forgotten, which costs time at most), and this repeats until no new shingle turns frequent in a way that leaves another node short.
3. Nodes with t + 1 rare shingles index these.  The prefix of any other is extended over its frequent shingles, which are dealt
   into classes by hash, until no t removals can break every class: a rare shingle counts 1, the c shingles of a class
   c - k + 1.  Indexed are its rare shingles and all combinations of k shingles of one class.  Of two sets that link, the one whose
   prefix ends first keeps a rare shingle, or k of one class, in common with the other's prefix, so the join is
   exact.  The number of classes grows with the power of two at or below the set's size, so keys grow with the set's
   size only; a set that may have a smaller partner below that power is indexed for the next lower one, too.
4. Two sets may only link in a bucket if their sizes and the places of the shared key in either set leave room for enough
   common shingles.  In each bucket the node with the fewest shingles before the key is paired with all others, a node in its
   largest bucket first, in the others where it is in another component then; links found are contracted.  Where many pairs across components remain, the nodes outside a bucket's largest component meet one node of
   it, drawn anew TURNS times or until no link is found.  Of what remains, pairs across components follow: the nodes outside the bucket's largest component
   with all others, each pair in the first bucket that it shares as far as the first keys of either tell.  Buckets with more than LIMIT * COMPARED such pairs a node are not expanded: their nodes are indexed again with
   combinations of k + 1, which costs twice the rows and does not part copies of one text.  Candidates are first bounded by parities of hash classes, of which sets that link differ in few, then
   verified on the whole sets.

No bucket, pair or link is dropped: at MOST_K the remaining buckets are expanded as they are.  Sets are named by 128-bit
digests, which are numbered for the join.

Defined results: null and empty texts (and texts of white space) have no shingles and link with nothing; shorter
texts are one shingle; repeated rows and equal sets are one node; rows with null doc_id take part and get the
least doc_id of their component, null if it has none; extra columns, whatever their names, are not read by ``components`` and kept by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm._run import Scratch, map_batches, sql_text, table

#: Words of a shingle and least similarity in per cent, where no contract says otherwise.
WORDS, PERCENT = 5, 80
#: Shingles kept of a set, in prefixes; nodes that may keep a shingle before it is frequent.
EXTRA, RARE = 1.5, 8
#: Frequent shingles held in memory at most: beyond, only more frequent ones count as such.
MOST_FREQUENT = 4_000_000
#: Shingles of a combination, to begin with and at most; rows across components that a bucket may cost for each node.
LEAST_K, MOST_K, LIMIT = 2, 4, 32
#: Pairs compared by their parities, which make no row, for the cost of an index row.
COMPARED = 64
#: Times that the nodes outside a bucket's largest component meet a node of it before pairs are expanded, and the pairs a node from which they do.
TURNS, CROWDED = 3, 8
#: Rows up to this number are sent to the tasks as a filter; more are joined by a shuffle. Of pairs, so many at most.
FILTER_ROWS, FILTER_PAIRS = 2_000_000, 500_000
#: First index keys of a node by which a pair is known to have met before.
FIRST = 16
#: Parities of a set at least, and longs that these are folded to and compared by inside a bucket.
PARITIES, WORDS_COMPARED = 1024, 8

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_SEEN: dict[bytes, int] = {}
_MOST_SEEN = 100_000


def shingles(data: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text in UTF-8."""
    if len(_SEEN) > _MOST_SEEN:
        _SEEN.clear()
    seen, hashes = _SEEN, []
    for w in data.translate(_LOWER).split():
        if (h := seen.get(w)) is None:
            h = seen[w] = xxhash.xxh64_intdigest(w)
        hashes.append(h)
    one = np.array(hashes, np.uint64)
    k = min(words, len(one))
    if not k:
        return one
    out = np.full(len(one) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ one[i : len(one) - k + 1 + i]) * _A
        out = (out ^ (out >> np.uint64(29))) * _B
    return np.unique(out ^ (out >> np.uint64(32)))


def misses(n: int, percent: int) -> int:
    """How many of n shingles a partner may lack."""
    return n * (100 - percent) // 100


@lru_cache(maxsize=256)
def _subsets(c: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(c), k)), np.int64).reshape(-1, k)


def signatures(own: np.ndarray, often: np.ndarray, percent: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set, and how many of its shingles stand before each; ``often`` marks the frequent ones.

    own is in the order of hashes, so the global order is its rare shingles, then the frequent ones.
    """
    n, rare = len(own), own[~often]
    t, r = misses(n, percent), len(rare)
    if r > t:
        return rare[: t + 1], np.arange(t + 1)
    rest, keys = own[often], [rare]
    low = 1 << (n.bit_length() - 1)
    for size in [low] + [low // 2] * (-(-n * percent // 100) < low):
        least = -(-size * percent // 100)  # shingles that any set of this size or more keeps
        few = min(k, least)
        classes = max(1, min((misses(size, percent) + 1) // 2, (least - 1) // (few - 1) if few > 1 else n))
        group = (rest * _C >> np.uint64(33)) % np.uint64(classes)
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.diff(group[order], prepend=np.uint64(classes)))
        nth = np.empty(len(rest), np.int64)
        nth[order] = np.arange(len(rest)) - np.repeat(first, np.diff(np.append(first, len(rest))))
        end = int(np.searchsorted(np.cumsum(nth >= few - 1), t + 1 - r)) + 1
        order = order[order < end]
        first = np.flatnonzero(np.diff(group[order], prepend=np.uint64(classes)))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
            if b - a >= few:
                some = rest[order[a:b]][_subsets(b - a, few)]
                key = np.full(len(some), size * 8 + few, np.uint64)
                for i in range(few):
                    key = (key ^ some[:, i]) * _A
                    key = (key ^ (key >> np.uint64(31))) * _B
                keys.append(key)
    keys = np.unique(np.concatenate(keys[1:])) if len(keys) > 1 else rest[:0]
    return np.concatenate([rare, keys]), np.concatenate([np.arange(r), np.full(len(keys), r)])


def parities(own: np.ndarray) -> np.ndarray:
    """Of each hash class whether the set has an odd number of shingles of it, 64 to a word: two sets differ in as many bits at most as in shingles.

    There are as many classes as shingles or more, a power of two and PARITIES at least, so that the bits of long sets tell, too.  Words a
    power of two apart, joined by exclusive or, are the parities of fewer classes.
    """
    classes = max(PARITIES, 1 << (len(own) - 1).bit_length()) if len(own) else PARITIES
    odd = np.bincount((own % np.uint64(classes)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _folded(bits: str, words: str) -> str:
    """SQL of the parities in so many words."""
    return f"if(size({bits}) = {words}, {bits}, transform(sequence(0, {words} - 1), i -> aggregate(sequence(i, size({bits}) - 1, {words}), 0L, (s, j) -> s ^ {bits}[j])))"


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """A list<long> array."""
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", sql_text().alias("text")).select("doc_id", F.xxhash64("text").alias("_th"), "text")


def index(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, _th (hash of the text), n (set size), node (digest of the set, null if empty), kept (its first shingles) and bits (the set's parities) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text.as_py().encode(), words) for text in batch.column(2)]
            nodes = [blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None for own in sets]
            kept = [own[: int(EXTRA * (misses(len(own), percent) + 1))] for own in sets]
            cols = [batch.column(0), batch.column(1), pa.array([len(own) for own in sets], pa.int64()), pa.array(nodes, pa.binary()), _lists(kept), _lists([parities(own) for own in sets])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "_th", "n", "node", "kept", "bits"])

    return map_batches(_texts(docs), run, f"doc_id {kind}, _th long, n long, node binary, kept array<long>, bits array<long>")


def whole_sets(docs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """v and own (its sorted shingles) of the rows v, doc_id, _th given, as often as docs has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingles(t.as_py().encode(), words) for t in batch.column(1)])], ["v", "own"])

    want = rows.select("v", F.col("doc_id").alias("_id"), F.col("_th").alias("_of"))
    few = rows.count() <= FILTER_ROWS
    want = F.broadcast(want) if few else want.hint("shuffle_hash")
    texts = _texts(docs).join(want, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_of"))).select("v", "text")
    return map_batches(texts, run, "v long, own array<long>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list<long> array as unsigned numbers, and where its lists begin and end."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


class Frequent:
    """The frequent shingles, sorted."""

    def __init__(self, known: np.ndarray):
        self.known = known

    def __call__(self, some: np.ndarray) -> np.ndarray:
        """Which of some are frequent."""
        if not len(self.known):
            return np.zeros(len(some), bool)
        return self.known[np.minimum(np.searchsorted(self.known, some), len(self.known) - 1)] == some

    def short(self, kept: pa.Array, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of rows of kept shingles: all these, which are rare, where rows begin and end, and which rows keep too few rare ones."""
        values, ends = _flat(kept)
        rare = ~self(values)
        upto = np.concatenate([[0], np.cumsum(rare)])
        return values, rare, ends, upto[ends[1:]] - upto[ends[:-1]] <= n * (100 - percent) // 100


_KEYS = "sig long, v long, n long, pos long"


def short_nodes(heads: DataFrame, frequent: Frequent, percent: int) -> DataFrame:
    """v of the nodes whose kept shingles hold too few rare ones for a prefix."""
    sent = heads.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *_, short = sent.value.short(batch.column(2), batch.column(1).to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(short))], ["v"])

    return map_batches(heads.select("v", "n", "kept"), run, "v long")


def rare_keys(heads: DataFrame, frequent: Frequent, percent: int) -> DataFrame:
    """Index rows of the nodes that keep enough rare shingles."""
    sent = heads.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy()
            values, rare, ends, short = sent.value.short(batch.column(2), n, percent)
            owner = np.repeat(np.arange(len(n)), np.diff(ends))
            place = np.cumsum(rare) - 1
            place -= np.repeat(np.concatenate([[0], np.cumsum(rare)])[ends[:-1]], np.diff(ends))
            used = np.flatnonzero(rare & ~short[owner] & (place <= (n * (100 - percent) // 100)[owner]))
            yield pa.RecordBatch.from_arrays([pa.array(values[used].view(np.int64)), pa.array(batch.column(0).to_numpy()[owner[used]]), pa.array(n[owner[used]]), pa.array(place[used])], ["sig", "v", "n", "pos"])

    return map_batches(heads.select("v", "n", "kept"), run, _KEYS)


def combined_keys(sets: DataFrame, frequent: Frequent, percent: int, k: int) -> DataFrame:
    """Index rows of whole sets (v, own)."""
    sent = sets.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = _flat(batch.column(1))
            often = sent.value(values)
            for v, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                sigs, pos = signatures(values[a:b], often[a:b], percent, k)
                yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(np.full(len(sigs), v)), pa.array(np.full(len(sigs), b - a)), pa.array(pos)], ["sig", "v", "n", "pos"])

    return map_batches(sets.select("v", "own"), run, _KEYS)


def contract(links: DataFrame, roots: DataFrame | None, scratch: Scratch, name: str) -> DataFrame:
    """v and root, the least node of its component, for the nodes of roots and of links (a, b).

    Each component hooks onto its least neighbour, pointers are followed until they are roots, and links inside
    a component go; of any two linked components the greater one goes in each turn.
    """
    edges, turn, old = between(links, roots), 0, []
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        last = f"{name}-up{turn}-0"
        up = scratch.save(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("root")), last)
        sent = F.broadcast if up.count() <= FILTER_ROWS else lambda df: df  # its rows stay as many
        jump, moved = 0, True
        while moved:
            for _ in range(2):
                to = sent(up.select(F.col("v").alias("root"), F.col("root").alias("next")))
                up = up.join(to, "root", "left").select("v", F.coalesce("next", "root").alias("root"), (F.col("next") < F.col("root")).alias("moved"))
            jump += 1
            up = scratch.save(up, f"{name}-up{turn}-{jump}")
            scratch.drop(last)
            last = f"{name}-up{turn}-{jump}"
            moved = not up.filter("moved").isEmpty()
            up = up.drop("moved")
        if roots is None:
            roots = up
        else:
            to = sent(up.select(F.col("v").alias("root"), F.col("root").alias("next")))
            older = roots.join(to, "root", "left").select("v", F.coalesce("next", "root").alias("root"))
            roots = scratch.save(older.unionAll(up.join(small(roots.select("v")), "v", "left_anti").select("v", "root")), f"{name}-roots{turn}")
            old.append(f"{name}-roots{turn}")
        edges = scratch.save(between(edges, up), f"{name}-edges{turn}")
        scratch.drop(*([f"{name}-edges{turn - 1}"] if turn else []), *old[:-1])
        old = old[-1:]
        if edges.isEmpty():
            return roots
        turn += 1


def between(links: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Links (a, b) as links between different roots, each once."""
    if roots is not None:
        sent = F.broadcast if roots.count() <= FILTER_ROWS else lambda df: df
        for c in "ab":
            links = links.join(sent(roots.select(F.col("v").alias(c), F.col("root").alias(f"r{c}"))), c, "left")
        links = links.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    return links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def small(df: DataFrame, most: int = FILTER_ROWS) -> DataFrame:
    """df, to be sent to the tasks if it has so many rows at most."""
    return F.broadcast(df) if df.count() <= most else df


class Join:
    """One similarity join: its scratch tables, the components and the pairs found so far."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("percent must be 50 to 100: below, a prefix may not suffice")
        self.docs, self.words, self.percent, self.scratch = docs, words, percent, Scratch(docs.sparkSession, "jaccard")
        self.roots: DataFrame | None = None
        self.met: DataFrame | None = None
        self.sets: DataFrame | None = None
        self.added: DataFrame | None = None  # those that the last call of _add_sets found
        self.turn = 0
        save = self.scratch.save
        rows = save(index(docs, words, percent).withColumn("uid", F.monotonically_increasing_id()), "index")
        full = rows.filter("n > 0")
        # the row that stands for a node is the one with the least doc_id; the node has its number
        of = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_th", "uid")).alias("of")
        nodes = full.groupBy("node").agg(of, F.count(F.lit(1)).alias("c")).select("node", "c", "of.doc_id", "of._th", F.col("of.uid").alias("v"))
        self.nodes = save(nodes, "nodes")
        narrow = rows.select("doc_id", "_th", "n", "node", "uid").join(self.nodes.select("node", "v"), "node", "left").drop("node")
        self.rows = save(narrow, "rows")
        copies = small(self.rows.filter("v <> uid").select("uid"))
        self.heads = save(full.select("uid", "n", "kept", "bits").join(copies, "uid", "left_anti").withColumnRenamed("uid", "v"), "heads")
        self.repeated = not self.rows.groupBy("doc_id", "_th").count().filter("count > 1").isEmpty()
        self.scratch.drop("index")

    def _add_sets(self, nodes: DataFrame) -> DataFrame:
        """The known sets, those of nodes (v) among them."""
        want = nodes if self.sets is None else nodes.join(self.sets.select("v"), "v", "left_anti")
        more = whole_sets(self.docs, self.nodes.join(want, "v", "left_semi"), self.words)
        more = self.scratch.save(more.dropDuplicates(["v"]) if self.repeated else more, f"sets{self.turn}")
        self.turn += 1
        self.added = more
        self.sets = more if self.sets is None else self.sets.unionAll(more)
        return self.sets

    def keys(self) -> DataFrame:
        """The index with combinations of LEAST_K shingles; finds the frequent shingles first."""
        save = self.scratch.save
        counted = save(self.heads.select(F.explode("kept").alias("sig")).groupBy("sig").count().filter(F.col("count") > RARE), "counted")
        most = RARE
        while counted.filter(F.col("count") > most).count() > MOST_FREQUENT:
            most *= 2
        fetch = lambda found: np.sort(found.filter(F.col("count") > most).select("sig").toArrow()["sig"].to_numpy().view(np.uint64))
        self.frequent = Frequent(fetch(counted))
        turn, short, counts = 0, None, None
        while True:
            now = short_nodes(self.heads, self.frequent, self.percent)
            now = save(now if short is None else now.join(short, "v", "left_anti"), f"short{turn}")
            if now.isEmpty():
                break
            short = now if short is None else short.unionAll(now)
            # each set is counted once, when it is new: the sums so far stand for the others
            self._add_sets(now)
            each = self.added.select(F.explode("own").alias("sig"), F.lit(1).cast("long").alias("count"))
            each = each if counts is None else each.unionAll(counts)
            counts = save(each.groupBy("sig").agg(F.sum("count").alias("count")).filter("count > 1"), f"counted{turn}")
            more = np.union1d(self.frequent.known, fetch(counts))
            if len(more) == len(self.frequent.known) or len(more) > 2 * MOST_FREQUENT:
                break
            self.frequent, turn = Frequent(more), turn + 1
        out = rare_keys(self.heads, self.frequent, self.percent)
        return out if short is None else out.unionAll(combined_keys(self.sets, self.frequent, self.percent, LEAST_K))

    def shared(self, keys: DataFrame, name: str) -> DataFrame:
        """The index rows of keys that two nodes have, one of them so near its begin that the other may be larger."""
        keys = self.scratch.save(keys, f"{name}-all")
        # one sum counts the nodes and, in units of 2**32, those near their begin
        both = F.sum(F.when(self.leads(), (1 << 32) + 1).otherwise(1)).alias("c")
        both = keys.groupBy("sig").agg(both).filter(f"c > {1 << 32} and c & {(1 << 32) - 1}L > 1").select("sig")
        both = self.scratch.save(both, f"{name}-sigs")
        out = self.scratch.save(keys.join(small(both), "sig"), name)
        self.scratch.drop(f"{name}-all", f"{name}-sigs")
        return out

    def leads(self) -> F.Column:
        """Whether a node may link in the bucket with one of its size or more."""
        return F.expr(f"(n - pos) * {100 + self.percent} >= n * {2 * self.percent}")

    def fits(self, n: str, pos: str, m: str, at: str) -> F.Column:
        """Whether sizes and places leave room for enough common shingles."""
        return F.expr(f"least({n} - {pos}, {m} - {at}) * {100 + self.percent} >= {self.percent} * ({n} + {m})")

    def near(self, n: str, m: str, differ: str) -> F.Column:
        """Whether sets that differ in so many parities may link: those that do differ in (n + m) (100 - p) / (100 + p) shingles at most."""
        return F.expr(f"({differ}) * {100 + self.percent} <= ({n} + {m}) * {100 - self.percent}")

    def preceded(self, rows: DataFrame) -> DataFrame:
        """Index rows with before, those of the node's FIRST keys that stand before this one in the global order (places, then keys: the same order in all sets).

        Two sets that link do so by the first key that both have, so a pair with such a key in common need not meet in this bucket: near copies
        share hundreds of buckets.
        """
        key = F.struct("pos", "sig")
        each = rows.groupBy("v").agg(F.slice(F.sort_array(F.collect_list(key)), 1, FIRST).alias("firsts"))
        return rows.join(each, "v").withColumn("before", F.filter("firsts", lambda x: x < key)["sig"]).drop("firsts")

    def rooted(self, keys: DataFrame) -> DataFrame:
        if self.roots is None:
            return keys.withColumn("root", F.col("v"))
        return keys.join(small(self.roots), "v", "left").withColumn("root", F.coalesce("root", "v"))

    def meet(self, pairs: DataFrame) -> bool:
        """Verify the pairs (a, b) that have not met, and contract the links; whether there are any."""
        save, turn = self.scratch.save, self.turn
        self.turn += 1
        pairs = pairs.distinct()
        pairs = save(pairs if self.met is None else pairs.join(small(self.met, FILTER_PAIRS), ["a", "b"], "left_anti"), f"pairs{turn}")
        if pairs.isEmpty():
            return False
        self.met = pairs if self.met is None else self.met.unionAll(pairs)
        # either side's parities to the pair, by one shuffle
        sides = lambda pairs: pairs.select("a", "b", F.explode(F.array("a", "b")).alias("v"))
        bits = self.heads.select("v", "n", "bits").join(small(sides(pairs), 2 * FILTER_PAIRS), "v").groupBy("a", "b").agg(F.collect_list(F.struct("n", "bits")).alias("of"))
        bits = bits.select("a", "b", *[F.col("of")[k][c].alias(name) for k, names in ((0, ("n", "x")), (1, ("m", "y"))) for c, name in zip(("n", "bits"), names, strict=True)])
        words = "least(size(x), size(y))"
        differ = f"aggregate(zip_with({_folded('x', words)}, {_folded('y', words)}, (p, q) -> bit_count(p ^ q)), 0, (s, c) -> s + c)"
        near = save(bits.filter(self.near("n", "m", differ)).select("a", "b"), f"near{turn}")
        if near.isEmpty():
            return False
        want = save(sides(near).select("v").distinct(), f"near-ends{turn}")
        # the sets stay where they are but for one copy of each to the pairs that it is in
        both = self._add_sets(want).join(small(sides(near), 2 * FILTER_PAIRS), "v").groupBy("a", "b").agg(F.collect_list("own").alias("own")).select("a", "b", F.col("own")[0].alias("x"), F.col("own")[1].alias("y"))
        common = F.size(F.array_intersect("x", "y")).cast("long")
        links = both.filter(100 * common >= self.percent * (F.size("x") + F.size("y") - common)).select("a", "b")
        links = save(links, f"links{turn}")
        linked = not links.isEmpty()
        if linked:
            self.roots = contract(links, self.roots, self.scratch, f"roots{turn}")
        self.scratch.drop(f"near{turn}", f"near-ends{turn}", f"links{turn}")
        return linked

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (v, w, others) those across components."""
        if self.roots is None:
            return pairs
        of = lambda c, root: small(self.roots.select(F.col("v").alias(c), F.col("root").alias(root)))
        both = pairs.join(of("v", "root"), "v", "left").join(of("w", "other"), "w", "left")
        return both.filter(F.coalesce("root", "v") != F.coalesce("other", "w")).drop("root", "other")

    def search(self, keys: DataFrame, last: bool) -> DataFrame | None:
        """Find all links in the buckets of the index rows; returns the nodes (v) of buckets that are left to larger combinations."""
        save, name = self.scratch.save, f"bucket{self.turn}"
        # the node with the fewest shingles before the key with each of the others
        lead = keys.groupBy("sig").agg(F.min(F.struct("pos", "v", "n")).alias("c"), F.count(F.lit(1)).alias("size"))
        led = save(keys.join(lead, "sig").filter("v <> c.v"), f"{name}-led")
        pairs = led.filter(self.fits("n", "pos", "c.n", "c.pos")).select("sig", "v", F.col("c.v").alias("w"), "size")
        # first each in its largest bucket, then across the components that are left: groups of near copies share many buckets
        one = self.apart(pairs).groupBy("v").agg(F.max_by("w", F.struct("size", "sig")).alias("w"))
        self.meet(one.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")))
        self.meet(self.apart(pairs).select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")))

        rest = save(led.filter("size > 2").select("sig", "v", "n", "pos"), f"{name}-rest")
        self.scratch.drop(f"{name}-led")
        turn = 0
        while True:
            now = save(self.rooted(rest), f"{name}-{turn}")
            drawn = F.min(F.struct(F.xxhash64("v", F.lit(turn)).alias("h"), "v", "n", "pos")).alias("drawn")
            each = now.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("c"), F.max(self.leads().cast("int")).alias("leads"), drawn)
            whole = each.groupBy("sig").agg(F.max("leads").alias("leads"), F.sum("c").alias("size"), F.max(F.struct("c", "root", "drawn")).alias("top"), F.sum(F.expr("c * c")).alias("inner"))
            more = lambda most: F.expr("size * size - inner") > 2 * most * F.col("size")
            left = whole.filter("top.c < size and leads > 0").select("sig", F.col("top.root").alias("top"), F.col("top.drawn").alias("c"), more(LIMIT * COMPARED).alias("large"), more(CROWDED).alias("crowded"))
            left = save(left, f"{name}-open{turn}")
            crowded = left.filter("crowded").select("sig", "top", "c")
            if turn == TURNS or crowded.isEmpty():
                break
            pairs = now.join(small(crowded), "sig").filter("root <> top").filter(self.fits("n", "pos", "c.n", "c.pos"))
            if not self.meet(pairs.select(F.least("v", "c.v").alias("a"), F.greatest("v", "c.v").alias("b"))):
                break  # the components are as they were
            self.scratch.drop(f"{name}-{turn}", f"{name}-open{turn}")
            turn += 1
        folded = self.heads.select("v", F.expr(_folded("bits", str(WORDS_COMPARED))).alias("x")).select("v", *[F.col("x")[k].alias(f"x{k}") for k in range(WORDS_COMPARED)])
        wide = save(now.join(small(left.drop("c")), "sig").join(folded, "v"), f"{name}-wide")
        some = self.preceded(wide if last else wide.filter("not large"))
        minor = some.filter("root <> top").select("sig", F.col("v").alias("w"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("root").alias("other"), F.col("before").alias("earlier"), *[F.col(f"x{k}").alias(f"y{k}") for k in range(WORDS_COMPARED)])
        # two nodes outside the largest component meet once
        ahead = (F.col("root") != F.col("other")) & ((F.col("root") == F.col("top")) | (F.col("v") < F.col("w")))
        near = self.near("n", "m", " + ".join(f"bit_count(x{k} ^ y{k})" for k in range(WORDS_COMPARED)))
        pairs = some.join(minor, "sig").filter(ahead & self.fits("n", "pos", "m", "at") & near & ~F.arrays_overlap("before", "earlier"))
        self.meet(pairs.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")))
        again = None if last or left.filter("large").isEmpty() else save(wide.filter("large").select("v").distinct(), f"{name}-nodes")
        self.scratch.drop(f"{name}-{turn}", f"{name}-open{turn}", f"{name}-rest", f"{name}-wide")
        return again

    def run(self) -> DataFrame:
        """doc_id, _th, n, component_id and root (a key of the component, null for empty sets) of every row."""
        keys, k = self.shared(self.keys(), "keys"), LEAST_K
        while (again := self.search(keys, k == MOST_K)) is not None:
            k += 1
            sets = self._add_sets(again).join(again, "v", "left_semi")
            keys = self.shared(combined_keys(sets, self.frequent, self.percent, k), f"keys{k}")
        named = self.rooted(self.nodes.select("v", "doc_id"))
        least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        named = named.select("v", "root").join(least, "root")
        out = self.rows.join(named, "v", "left").select("doc_id", "_th", "n", F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "root")
        return self.scratch.only(out, "components")


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, _th (hash of the text), n_shingles, component_id and root (a key of the component, null without shingles) of every row: rows link when 100 * common >= percent * union shingles."""
    return Join(docs.select("doc_id", "text"), words, percent).run().withColumnRenamed("n", "n_shingles")


def dedup(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs, all columns: the rows without shingles, and one row of each component, the first by doc_id (null last), hash of the text and JSON of the row."""
    key = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_of"))
    found = components(docs.select("doc_id", "text"), words, percent).filter("n_shingles > 0")
    heads = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_th")).alias("of")).select(F.col("of.doc_id").alias("_id"), F.col("of._th").alias("_of"))
    each = found.groupBy("doc_id", "_th").agg(F.count(F.lit(1)).alias("_n"))
    repeated = each.filter("_n > 1").join(heads, key, "left_semi").select("doc_id", "_th")
    gone = each.join(heads, key, "left_anti").select("doc_id", "_th")
    # rows stay in a struct, so that no name of theirs can clash
    rows = docs.select("doc_id", F.xxhash64(sql_text()).alias("_th"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    again = not repeated.isEmpty()
    some = (gone.unionAll(repeated) if again else gone).toDF("_id", "_of")
    kept = rows.join(some.hint("shuffle_hash"), key, "left_anti").select("row.*")
    if again:
        copies = rows.join(repeated.toDF("_id", "_of").hint("shuffle_hash"), key, "left_semi")
        kept = kept.unionAll(copies.groupBy("doc_id", "_th").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))
    return kept


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the documents whose 3-word shingles overlap by 90 per cent."""
    return components(table(spark, sf_dir, "documents"), 3, 90).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op7_jaccard": op7_jaccard}
ORACLE_SQL = {
    "op7_jaccard": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda p: array_to_string(w[p:p + 2], ' '))) END AS g FROM d),
e AS MATERIALIZED (SELECT r, len(g) AS n, unnest(g) AS t FROM s),
c AS (SELECT x.r AS a, y.r AS b, count(*) AS m, any_value(x.n) AS na, any_value(y.n) AS nb FROM e x JOIN e y ON x.t = y.t AND x.r < y.r AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 90 GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c WHERE 100 * m >= 90 * (na + nb - m)),
k AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT r AS a, r AS b FROM s UNION SELECT reach.a, k.b FROM reach JOIN k ON reach.b = k.a)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM s JOIN reach ON s.r = reach.a JOIN s o ON o.r = reach.b GROUP BY s.r, s.doc_id, s.g
"""
}
