"""Source divergence audit: how far the term shares of every source of a language lie from its other sources and the language.

Plain relational.  Terms, the matches of TERM (A-Z lower-cased), are exploded and counted by language, source and term; a language keeps
the terms that are in at least ``least_docs`` of its rows.  Groups are crossed with the kept terms of their language, so that
absent terms get a count of zero; a self-join on language and term then sums the differences of every two sources, and
windows rank them.  Shares are whole numbers, p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)), computed in decimals.

For skew: a row's terms are sorted and each compared with the one before it, so that rows and occurrences are counted by one
aggregation with partial sums; what a language has of a term is a window over its sources; the crossing is dealt by (language, salt of the term), the self-join by (language, term), which
has one row for each source, and it meets every pair of sources once.  A term that is no term (null) is crossed along with the kept ones: it
gives every pair of sources a row, also where no term is kept.  The ranks of terms stop at ``most_ranks`` before rows are shuffled.

Defined results: null text, lang and source are ''; null and empty texts have no terms but count as rows of their group; very
long texts are read whole; repeated rows count as often as they are there; ties are ranked by the UTF-8 order of the item; an
empty table gives an empty result; doc_id and extra columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.llm._run import Scratch, shuffle_partitions, sql_text, table

#: What a term is, once A-Z are lower-cased, and what lies between terms: splitting at it gives the matches of TERM, eight times as fast as regexp_extract_all.
TERM, BETWEEN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of a language that a kept term is in, at least; ranks of the part ``term``; scale and smoothing of shares.
LEAST_DOCS, MOST_RANKS, SCALE, SMOOTH = 30, 50, 1_000_000_000, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Audit(NamedTuple):
    """``shares``: lang, source, term, n, p and q (the language's p) of every group and kept term; ``pairs``: lang, source, item, value of every two sources."""

    shares: DataFrame
    pairs: DataFrame


def lowered(text: Column) -> Column:
    """A-Z in small letters. For texts of one byte a character that is what lower does, at a fraction of the cost."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows that hold it)."""
    terms = docs.select(sql_text("lang").alias("lang"), sql_text("source").alias("source"), F.sort_array(F.split(lowered(sql_text()), BETWEEN, -1)).alias("term"))
    # each beside the one before it; what is empty comes first and goes
    before = F.concat(F.array(F.lit("")), F.slice("term", F.lit(1), F.size("term") - 1))
    each = terms.withColumn("before", before).select("lang", "source", F.inline(F.arrays_zip("term", "before"))).filter("term <> ''")
    return each.groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("term") != F.col("before")).alias("docs"))


def _share(n: str, total: str, kept: str) -> Column:
    """The smoothed share of a count in whole numbers."""
    wide = "CAST({} AS DECIMAL(20, 0))"
    return F.expr(f"1 + ({wide.format(f'{n} + {SMOOTH}')} * {SCALE}) div ({wide.format(total)} + {SMOOTH} * {wide.format(kept)})")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS) -> Audit:
    """Shares of the kept terms in every group, and the divergence of every two sources of a language."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "divergence")
    salts = shuffle_partitions(spark)
    counted = scratch.save(counts(docs), "counts")
    of_term = Window.partitionBy("lang", "term")
    present = counted.withColumns({"of_lang": F.sum("n").over(of_term), "docs": F.sum("docs").over(of_term)}).filter(F.col("docs") >= least_docs)
    present = scratch.save(present.select("lang", "source", "term", "n", "of_lang"), "present")
    kept = scratch.save(present.groupBy("lang", "term").agg(F.first("of_lang").alias("of_lang")), "kept")
    # one row for each group: its rows exist even without terms
    langs = kept.groupBy("lang").agg(F.sum("of_lang").alias("lang_total"), F.count(F.lit(1)).alias("kept"))
    totals = present.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(sql_text("lang").alias("lang"), sql_text("source").alias("source")).distinct()
    groups = scratch.save(groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "kept"]), "groups")
    # the kept terms of a language, and the term that is none, dealt by salt
    none = groups.select("lang").distinct().select("lang", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("of_lang"))
    salted = kept.select("lang", "term", "of_lang").unionByName(none).withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)))
    wide = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).join(salted, ["lang", "salt"]).drop("salt")
    dense = wide.join(present.drop("of_lang"), ["lang", "source", "term"], "left").na.fill(0, ["n"])
    known = F.col("term").isNotNull()
    shares = dense.select("lang", "source", "term", "n", F.when(known, _share("n", "total", "kept")).otherwise(0).alias("p"), F.when(known, _share("of_lang", "lang_total", "kept")).otherwise(0).alias("q"))
    shares = scratch.save(shares, "shares")
    # null terms as a value of their own; kept terms are never empty
    one, two = (shares.select("lang", F.coalesce("term", F.lit("")).alias("term"), F.col("source").alias(f"source_{k}"), F.col("p").alias(f"p_{k}")) for k in (1, 2))
    halves = one.join(two, ["lang", "term"]).filter("source_1 < source_2").groupBy("lang", "source_1", "source_2").agg(F.sum(F.abs(F.col("p_1") - F.col("p_2"))).alias("value"))
    pairs = halves.select("lang", "value", F.inline(F.array(*[F.struct(F.col(f"source_{a}").alias("source"), F.col(f"source_{b}").alias("item")) for a, b in ((1, 2), (2, 1))])))
    return Audit(shares.filter(known), scratch.save(pairs.select("lang", "source", "item", "value"), "pairs"))


def ranked(found: Audit, most_ranks: int = MOST_RANKS) -> DataFrame:
    """lang, source, part, item, value and rank: the other sources of every group, and the terms that it uses most above its language."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    pairs = found.pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    above = found.shares.filter("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = above.withColumn("rank", rank).filter(F.col("rank") <= most_ranks)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return ranked(audit(table(spark, sf_dir, "documents")))


QUERIES = {"op11_divergence": op11_divergence}
ORACLE_SQL = {
    "op11_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '{TERM}')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCS}),
l AS (SELECT lang, sum(n) AS total, count(*) AS v FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n::HUGEINT AS of_lang
          FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT dense.lang, source, term, n,
             1 + ({SCALE}::HUGEINT * (n + {SMOOTH})) // (sum(n) OVER (PARTITION BY dense.lang, source) + {SMOOTH} * v) AS p,
             1 + ({SCALE}::HUGEINT * (of_lang + {SMOOTH})) // (total + {SMOOTH} * v) AS q
      FROM dense JOIN l ON l.lang = dense.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM s WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {MOST_RANKS}
""",
}
