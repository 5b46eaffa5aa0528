"""Table functions that SQL can call: lyric lines, line differences and blocks, with one row for each line or block instead of a joined text.

    register(spark)
    SELECT t.id, l.* FROM tracks t, LATERAL lyric_lines(t.lyrics, 10) l
    SELECT b.* FROM lyric_blocks(TABLE(lines) PARTITION BY doc ORDER BY at) b
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from curatrix.functions import lyrics
from curatrix.packing import ship


class LyricLines:
    """at and line: lines of at most so many syllables."""

    def eval(self, text: str, most: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(lyrics.split_lines(text, most).split("\n"))


class LinePairs:
    """at, before and after: the lines that differ, old beside new."""

    def eval(self, before: str, after: str) -> Iterator[tuple[int, str, str]]:
        for k, (a, b) in enumerate(lyrics.line_pairs(before, after)):
            yield k, a, b


class LyricBlocks:
    """doc, filename and text of the blocks of a partition: the lines (doc, at, line) of one text, in their order. Of equal names the last wins."""

    def __init__(self):
        self.doc, self.name, self.lines, self.found = None, None, [], {}

    def eval(self, row: Row) -> None:
        bare = (row["line"] or "").strip()
        self.doc = row["doc"]
        if bare.startswith("----") and bare.endswith("----"):
            self._close()
            self.name, self.lines = bare[4:-4].strip(), []
        else:
            self.lines.append(row["line"] or "")

    def _close(self) -> None:
        if self.name is not None:
            self.found[self.name] = "\n".join(self.lines).strip("\n")

    def terminate(self) -> Iterator[tuple[int, str, str]]:
        self._close()
        for name, text in self.found.items():
            yield self.doc, name, text


#: Name in SQL, class and the type of its rows.
TABLE_FUNCTIONS = {
    "lyric_lines": (LyricLines, "at: int, line: string"),
    "line_pairs": (LinePairs, "at: int, before: string, after: string"),
    "lyric_blocks": (LyricBlocks, "doc: bigint, filename: string, text: string"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the table functions known to SQL; returns their names."""
    ship(spark)
    for name, (fn, kind) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(fn, returnType=kind))
    return sorted(TABLE_FUNCTIONS)
