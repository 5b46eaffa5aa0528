"""Cross-tokenizer alignment by a dictionary of groups.

Two tokenizers cut the same bytes; where tokens of both end at one place, a group of A ids and B ids is closed.  Every token has a
byte at least, so the last two tokens of a group, and no others, end together: a group holds one link.

Texts are encoded in blocks of about BLOCK_BYTES.  A block interns its groups: equal groups get one number, and every document keeps the
numbers that it holds with their frequencies.  The blocks' dictionaries, one row for each distinct group of a block, are added up to
that of the corpus, so that the most frequent group has one row a block, not one an occurrence; links are expanded once for each distinct
group and multiplied by its frequency.  Counts of id pairs come back to the blocks' dictionaries by the group's key (its ids as text), and to the
documents by block.  The table of id pairs is bounded by the vocabularies: of two tokens that end together one is a suffix of the other.

Texts without tokens (null, empty, or if the joined bytes of either tokenizer differ from space + text) have zeros and ''.  Further
defined results: very long texts are encoded whole and fill a block; repeated rows and null doc_ids are answered one by
one and count as often as they are there; ties for a B id's highest count are all best; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm._run import Scratch, map_batches, sql_text, table

#: The folder of the tokenizers' files, and the files of A and B.
FOLDER, FILE_A, FILE_B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a block, of texts encoded in one call.
BLOCK_BYTES, CALL_BYTES = 4 << 20, 1 << 18
# How a byte-level tokenizer cuts a text before it merges bytes (a fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters after Latin Extended-B.
BEYOND = re.compile("[^\x00-\u024F]")


class Aligned(NamedTuple):
    """``documents``: a row for each document; ``groups``: key, a, b, n of the corpus' distinct groups; ``pairs``: a, b, count, best of the linked ids."""

    documents: DataFrame
    groups: DataFrame
    pairs: DataFrame


class Tokenizers:
    """Both tokenizers of a worker, with the bytes of every id."""

    kept: dict[tuple[str, str], Tokenizers] = {}

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        # the byte-level alphabet: printable characters stand for themselves, other bytes for those from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
        self.bytes_a = [bytes(map(byte.__getitem__, self.a.id_to_token(i))) for i in range(self.a.get_vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.vocab_size()))]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in known], np.int64) for known in (self.bytes_a, self.bytes_b))
        if min(self.sizes_a.min(), self.sizes_b.min()) < 1:
            raise ValueError("a token without bytes")
        self.fast = self._fast()

    def _fast(self):
        """A's vocabulary in the library that encodes it five times as fast; None where its file asks for more than byte-level merges in the order of their ids."""
        import tiktoken

        form = json.loads(self.a.to_str())
        model, before = form["model"], form["pre_tokenizer"] or {}
        whole = form["normalizer"] is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        bare = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        special = {x["id"] for x in form["added_tokens"]}
        made = [model["vocab"]["".join(x.split(" ") if isinstance(x, str) else x)] for x in model["merges"]]
        if not whole or not bare or made != sorted(set(made)) or len(made) + 256 != len(self.bytes_a) - len(special):
            return None
        return tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks={x: i for i, x in enumerate(self.bytes_a) if i not in special}, special_tokens={})

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        """A's ids of each text. Characters beyond LATIN, whose classes libraries may know from other editions of Unicode, go the slow way."""
        out: list = [self.fast.encode_ordinary(t) if self.fast and not BEYOND.search(t) else None for t in texts]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, x in zip(rest, self.a.encode_batch([texts[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = x.ids
        return out

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Tokenizers:
        if (path_a, path_b) not in cls.kept:
            cls.kept[path_a, path_b] = cls(path_a, path_b)
        return cls.kept[path_a, path_b]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of A and B of each text; None if it has no tokens."""
        out = []
        for text, a, b in zip(texts, self.encode_a([" " + t for t in texts]), self.b.encode(texts, num_threads=1), strict=True):
            whole = (" " + text).encode()
            same = text and b"".join(map(self.bytes_a.__getitem__, a)) == whole and b"".join(map(self.bytes_b.__getitem__, b)) == whole
            out.append((np.array(a, np.int32), np.array(b, np.int32)) if same else None)
        return out


def _mixed(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ids."""
    place = np.arange(len(ids)) - np.repeat(starts, sizes)
    x = (ids.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.add.reduceat(x ^ (x >> np.uint64(32)), starts)


def _interned(ids: list[np.ndarray], starts: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each group, equal for equal groups, and the first group of each number.

    Numbers are dealt by hash; every group is then compared with the first of its number, and should one differ, by the ids themselves.
    """
    mixed = [_mixed(*x) for x in zip(ids, starts, sizes, strict=True)]
    code, _ = pd.factorize(mixed[0] * np.uint64(0x94D049BB133111EB) + mixed[1])
    first = np.empty(code.max() + 1, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    for x, at, n in zip(ids, starts, sizes, strict=True):
        as_first = np.repeat(at[first[code]] - at, n) + np.arange(len(x)) if (n == n[first[code]]).all() else None
        if as_first is None or not (x == x[as_first]).all():
            seen: dict[tuple, int] = {}
            keys = [tuple(bytes(x[s : s + k]) for x, s, k in zip(ids, at, n, strict=True)) for at, n in zip(zip(*starts, strict=True), zip(*sizes, strict=True), strict=True)]
            code = np.array([seen.setdefault(k, len(seen)) for k in keys])
            first = np.unique(code, return_index=True)[1]
            break
    return code, first


_SPANS = pa.list_(pa.int32())
_GROUP = pa.struct([("key", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])


def _listed(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[str]:
    """The ids of each run as text."""
    ends = np.cumsum(sizes)
    names = list(map(str, ids[np.repeat(starts - ends + sizes, sizes) + np.arange(sizes.sum())].tolist()))
    return [",".join(names[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _block(own: Tokenizers, doc_ids: pa.Array, encoded: list[tuple[np.ndarray, np.ndarray] | None]) -> pa.RecordBatch:
    """The row of a block: its documents and its dictionary."""
    has = np.array([e is not None for e in encoded])
    there = [e for e in encoded if e is not None]
    n_ids = [np.array([len(e[k]) if e is not None else 0 for e in encoded], np.int64) for k in (0, 1)]
    n_groups = np.zeros(len(encoded), np.int64)
    held, times, digests, groups = [[]] * len(encoded), [[]] * len(encoded), [""] * len(encoded), []
    if there:
        ids = [np.concatenate([e[k] for e in there]) for k in (0, 1)]
        # both tokenizers cut the same bytes, so places run on from text to text
        ends = [np.cumsum(size[x]) for size, x in zip((own.sizes_a, own.sizes_b), ids, strict=True)]
        ended = np.zeros((2, ends[0][-1] + 1), bool)
        for k in (0, 1):
            ended[k, ends[k]] = True
        last = [np.flatnonzero(ended[1 - k, ends[k]]) for k in (0, 1)]
        starts = [np.concatenate([[0], x[:-1] + 1]) for x in last]
        sizes = [x - s + 1 for x, s in zip(last, starts, strict=True)]
        code, first = _interned(ids, starts, sizes)
        keys = list(map("|".join, zip(*(_listed(x, s[first], n[first]) for x, s, n in zip(ids, starts, sizes, strict=True)), strict=True)))
        groups = pa.StructArray.from_arrays([pa.array(keys), pa.array(ids[0][last[0][first]]), pa.array(ids[1][last[1][first]]), pa.array(np.bincount(code, minlength=len(first)))], fields=list(_GROUP))
        # groups of each document: those up to its last token
        upto = np.searchsorted(last[0], np.cumsum(n_ids[0][has]))
        n_groups[has] = np.diff(upto, prepend=0)
        for k, lo, hi in zip(np.flatnonzero(has).tolist(), [0, *upto[:-1].tolist()], upto.tolist(), strict=True):
            part = code[lo:hi]
            digests[k] = sha256(";".join(map(keys.__getitem__, part.tolist())).encode()).hexdigest()
            held[k], times[k] = np.unique(part, return_counts=True)
    docs = pa.StructArray.from_arrays(
        [doc_ids, *(pa.array(x) for x in (n_ids[0], n_ids[1], n_groups)), pa.array(digests), *(_lists(x) for x in (held, times))],
        ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "held", "times"],
    )
    whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), whole(docs), whole(groups if len(groups) else pa.array([], _GROUP))], ["block", "docs", "groups"])


def _lists(parts: list) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)))


def blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each block: its name, documents and dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, encoded, size = Tokenizers.of(path_a, path_b), [], [], 0
        for batch in batches:
            texts, call, begun = batch.column(1), [], 0
            for k, text in enumerate(chain(texts, [None])):
                if k == len(texts) or begun >= CALL_BYTES:
                    encoded += own.encode(call)
                    ids.append(batch.column(0).slice(k - len(call), len(call)))
                    size, call, begun = size + begun, [], 0
                    if size >= BLOCK_BYTES:
                        yield _block(own, pa.concat_arrays(ids), encoded)
                        ids, encoded, size = [], [], 0
                if k < len(texts):
                    call.append(text.as_py())
                    begun += len(call[-1].encode()) + 1
        if encoded:
            yield _block(own, pa.concat_arrays(ids), encoded)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block string, docs array<struct<doc_id: {kind}, n_a: long, n_b: long, n_groups: long, groups_sha256: string, held: array<int>, times: array<int>>>, groups array<struct<key: string, a: int, b: int, n: long>>"
    return map_batches(docs.select("doc_id", sql_text().alias("text")), run, schema)


def _counted(key: tuple, docs: pa.Table, groups: pa.Table) -> pa.Table:
    """The documents of a block with their sums over links."""
    docs, groups = docs.combine_chunks(), groups.combine_chunks()
    known = np.zeros((2, groups.num_rows), np.int64)
    place = groups["pos"].to_numpy()
    known[0, place], known[1, place] = groups["count"].to_numpy(), groups["best"].to_numpy()
    held, times = (pa.concat_arrays(docs[c].chunks) if docs.num_rows else pa.array([], _SPANS) for c in ("held", "times"))
    ends = np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False))])
    upto = [np.concatenate([[0], np.cumsum(x[held.flatten().to_numpy()] * times.flatten().to_numpy())])[ends] for x in known]
    sums = [np.diff(x) for x in upto]
    return pa.table({"doc_id": docs["doc_id"], "n_a": docs["n_a"], "n_b": docs["n_b"], "n_groups": docs["n_groups"], "n_links": docs["n_groups"], "n_best": sums[1], "count_sum": sums[0], "groups_sha256": docs["groups_sha256"]})


def align(docs: DataFrame, path_a: str = f"{FOLDER}/{FILE_A}", path_b: str = f"{FOLDER}/{FILE_B}") -> Aligned:
    """The alignment of all documents' texts, the dictionary of groups and the linked id pairs."""
    scratch = Scratch(docs.sparkSession, "alignment")
    made = scratch.save(blocks(docs, path_a, path_b), "blocks")
    local = made.select("block", F.posexplode("groups").alias("pos", "g")).select("block", "pos", "g.*")
    groups = scratch.save(local.groupBy("key").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.sum("n").alias("n")), "groups")
    linked = groups.groupBy("a", "b").agg(F.sum("n").alias("count"))
    highest = linked.groupBy("b").agg(F.max("count").alias("most"))
    pairs = scratch.save(linked.join(highest, "b").select("a", "b", "count", F.expr("CAST(count = most AS INT)").alias("best")), "pairs")
    known = groups.join(pairs, ["a", "b"]).select("key", "count", "best")
    local = local.select(F.col("block").alias("of_block"), "pos", "key").join(known, "key").drop("key")
    each = made.select("block", F.inline("docs"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return Aligned(each.groupBy("block").cogroup(local.groupBy("of_block")).applyInArrow(_counted, schema), groups, pairs)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of all documents."""
    return align(table(spark, sf_dir, "documents")).documents


QUERIES = {"op12_alignment": op12_alignment}
ORACLE_SQL: dict[str, str] = {}
