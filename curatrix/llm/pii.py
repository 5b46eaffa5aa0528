"""Personal data: regex, gazetteer and context labelers vote on candidate spans; DataFrame functions only.

Candidates are the matches of the patterns in KINDS.  Each gets three votes (1, -1 or 0): of its form (digit counts,
check digits, ranges), of a gazetteer (domains, issuers, country codes, given names), and of the words before it.
All candidates of the corpus are counted by kind, votes and two shape features, a table whose size is fixed by the
labelers.  On these counts expectation-maximisation estimates how reliable each labeler is and how likely each
combination is personal data; a logistic classifier is then trained on those soft labels, and its table of
probabilities decides which candidates of the added kinds are reported.

Matches and their places come from ``split`` and ``regexp_extract_all`` by the same pattern; places are summed up in
chunks.  Patterns use possessive repeats, and may start inside a run of their first class only where a match ended, so
that time grows with the text's length.

Defined results: null and empty texts have no spans; places are code points, end exclusive; base spans are always
reported, added ones only if they overlap none; very long texts are read whole, places are summed up by CHUNK; repeated rows and null doc_ids are answered one by one; an empty table gives an
empty result and trains nothing; extra columns are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm._run import Scratch, sql_text, table

#: Matches of one fold: bounds the cost of appending to arrays.
CHUNK = 500
#: Code points before a match that the context labeler sees.
BEFORE = 32
#: Rounds of expectation-maximisation, and of the classifier's descent.
ROUNDS, STEPS = 60, 400

# Gazetteers (fixed values).
DOMAINS = "com|org|net|edu|gov|info|io|co|de|fr|es|it|uk|us|ca|eu|ch|at|nl"
COUNTRY_CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|35|6011|65"
GIVEN_NAMES = "James|Mary|John|Patricia|Robert|Jennifer|Michael|Linda|David|Elizabeth|Thomas|Susan|Anna|Peter|Maria|Hans|Sophie|Pierre|Carlos|Lucia"
IBAN_COUNTRIES = "AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE"


class Kind(NamedTuple):
    """A kind of span: pattern, a text it always holds, whether it is a base kind, what is kept, and its labelers."""

    name: str
    pattern: str
    needs: str
    base: bool
    form: object  # Column of the match -> Column boolean: the form is right
    gazetteer: object  # Column of the match -> Column of a vote
    context: str  # words before it that speak for it
    least_digits: int = 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _vote(yes: Column) -> Column:
    return F.when(yes, 1).otherwise(-1)


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: Base kinds first, in the order of their spans.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, lambda m: F.lit(True), lambda m: _vote(m.rlike(rf"(?i)\.(?:{DOMAINS})$")), "mail|contact|write|reply|address"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", ".", True, lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), lambda m: _vote(~m.rlike(r"^0*(?:0|10|127|22[4-9]|2[3-5][0-9])\.")), "ip|host|server|addr|login|client"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", True, lambda m: F.length(_digits(m)).between(14, 19) & F.call_function("luhn_check", _digits(m)), lambda m: _vote(m.rlike(f"^(?:{ISSUERS})")), "card|visa|credit|debit|pay|account", 12),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", True, lambda m: F.length(_digits(m)).between(10, 15), lambda m: _vote(m.rlike(rf"^\+(?:{COUNTRY_CODES})")), "tel|phone|call|mobile|fax|contact"),
    Kind("phone_local", r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", "", False, lambda m: F.length(_digits(m)) == 10, lambda m: _vote(m.rlike(r"^\(?[2-9]")), "tel|phone|call|mobile|fax|contact"),
    Kind("email_spelled", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]{1,63}+){1,8}+", "at", False, lambda m: F.lit(True), lambda m: _vote(m.rlike(rf"(?i)[.)\]\x20](?:{DOMAINS})$")), "mail|contact|write|reply|address"),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", False, lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), lambda m: F.lit(0), "ssn|social|security|id|number"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])", "", False, lambda m: F.length(_digits(m)) >= 8, lambda m: _vote(m.rlike(f"^(?:{IBAN_COUNTRIES})")), "iban|account|bank|konto|transfer"),
    Kind("person", rf"(?<![A-Za-z])(?:{GIVEN_NAMES})\x20[A-Z][a-z]++(?![A-Za-z])", "", False, lambda m: F.length(m) >= 7, lambda m: F.lit(1), "mr|mrs|ms|dr|dear|name|contact|herr|frau|señor|madame"),
)
_SPAN = "array<struct<k: int, s: int, e: int, ok: boolean, form: int, gazetteer: int, context: int, size: int, digits: int>>"


def _candidates(k: int) -> Column:
    """The candidates of a kind, in order."""
    kind, text, pattern = KINDS[k], F.col("text"), F.lit(KINDS[k].pattern)
    pairs = F.zip_with(F.split(text, kind.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda p, m: F.struct(p.alias("p"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        m, start = x["m"], acc["pos"] + F.length(x["p"])
        end = start + F.length(m)
        before = F.lower(F.right(x["p"], F.lit(BEFORE)))
        digits = F.length(_digits(m))
        span = F.struct(
            F.lit(k).alias("k"), start.alias("s"), end.alias("e"), kind.form(m).alias("ok"), _vote(kind.form(m)).alias("form"), kind.gazetteer(m).alias("gazetteer"),
            F.when(before.rlike(rf"(?:^|[^\p{{L}}])(?:{kind.context})[^\p{{L}}]"), 1).when(before.rlike(r"(?:version|ver|build|part|order|page)[^\p{L}]*$"), -1).otherwise(0).alias("context"),
            F.least(F.lit(4), F.floor(F.length(m) / 8)).cast("int").alias("size"), F.floor(digits * 4 / F.greatest(F.lit(1), F.length(m))).cast("int").alias("digits"),
        )
        keep = m.isNotNull() & (digits >= kind.least_digits if kind.least_digits else F.lit(True))
        return F.struct(end.alias("pos"), F.when(keep, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def chunk(done: Column, part: Column) -> Column:
        start = F.struct(F.coalesce(F.try_element_at(done, F.lit(-1))["pos"], F.lit(0)).alias("pos"), F.array().cast(_SPAN).alias("out"))
        return F.array_append(done, F.aggregate(part, start, step))

    def spans(pairs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), lambda i: F.slice(pairs, i * CHUNK + 1, F.lit(CHUNK)))
        folded = F.aggregate(parts, F.array().cast(f"array<struct<pos: int, out: {_SPAN}>>"), chunk)
        return F.flatten(F.transform(folded, lambda x: x["out"]))

    # the pairs are bound to a variable, so that they are made once
    found = F.get(F.transform(F.array(pairs), spans), F.lit(0))
    may = F.contains(text, F.lit(kind.needs)) if kind.needs else F.lit(True)
    return F.when(may & text.rlike(kind.pattern), found).otherwise(F.array().cast(_SPAN))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and spans: every candidate of every kind, with its votes."""
    rows = docs.select("doc_id", sql_text().alias("text"))
    return rows.select("doc_id", F.concat(*[_candidates(k) for k in range(len(KINDS))]).alias("spans"))


_FEATURES = ("k", "form", "gazetteer", "context", "size", "digits")


def estimate(counts: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Expectation-maximisation over (features, count) rows: how likely each row is personal data.

    Each kind has a prior; each labeler a reliability, its distribution of votes on true and on false spans.  Priors lean
    towards the labelers being better than chance, as the majority vote begins.
    """
    post = {f: min(0.95, max(0.05, 0.5 + 0.225 * sum(f[1:4]))) for f, _ in counts}
    for _ in range(rounds):
        prior: dict[int, list[float]] = {}
        votes = {(j, v, y): (2.0 if v == y else 0.5 if v == -y else 1.0) for j in (1, 2, 3) for v in (-1, 0, 1) for y in (-1, 1)}
        for f, n in counts:
            p = post[f]
            a = prior.setdefault(f[0], [1.0, 1.0])
            a[0] += n * p
            a[1] += n * (1 - p)
            for j in (1, 2, 3):
                votes[j, f[j], 1] += n * p
                votes[j, f[j], -1] += n * (1 - p)
        total = {(j, y): sum(votes[j, v, y] for v in (-1, 0, 1)) for j in (1, 2, 3) for y in (-1, 1)}
        for f, _ in counts:
            odds = math.log(prior[f[0]][0] / prior[f[0]][1])
            odds += sum(math.log(votes[j, f[j], 1] / total[j, 1] * total[j, -1] / votes[j, f[j], -1]) for j in (1, 2, 3))
            post[f] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post


def classify(counts: list[tuple[tuple[int, ...], int]], post: dict[tuple[int, ...], float], steps: int = STEPS) -> dict[tuple[int, ...], float]:
    """A logistic classifier trained on the soft labels; its probability for each combination of features."""
    weights: dict[tuple[int, int], float] = {}
    total = sum(n for _, n in counts)
    for step in range(steps):
        slope: dict[tuple[int, int], float] = {}
        for f, n in counts:
            x = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(i, 0.0) for i in enumerate(f))))))
            for i in enumerate(f):
                slope[i] = slope.get(i, 0.0) + n / total * (x - post[f])
        for i, g in slope.items():
            weights[i] = weights.get(i, 0.0) * (1 - 1e-4) - 4 / math.sqrt(1 + step / 20) * g
    return {f: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(i, 0.0) for i in enumerate(f)))))) for f, _ in counts}


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and added: arrays of the spans reported, by place and kind."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "pii")
    found = scratch.save(candidates(docs), "candidates")
    counted = found.select(F.explode("spans").alias("x")).groupBy(*[F.col(f"x.{f}").alias(f) for f in _FEATURES]).count()
    counts = [(tuple(r[:-1]), r[-1]) for r in counted.collect()]  # as many rows as there are combinations of features
    counts.sort()
    likely = classify(counts, estimate(counts))
    accepted = sorted(f for f, p in likely.items() if p >= 0.5 and not KINDS[f[0]].base)
    n_base = sum(kind.base for kind in KINDS)
    key = lambda x: F.concat_ws(":", *[x[f] for f in _FEATURES])
    base = F.filter("spans", lambda x: (x["k"] < n_base) & x["ok"])
    added = F.filter("spans", lambda x: (x["k"] >= n_base) & key(x).isin([":".join(map(str, f)) for f in accepted] or [""]))
    alone = F.filter("added", lambda a: ~F.exists("base", lambda b: (b["s"] < a["e"]) & (b["e"] > a["s"])))
    narrow = lambda spans: F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    rows = found.select("doc_id", base.alias("base"), added.alias("added"))
    return rows.select("doc_id", narrow(F.col("base")).alias("base"), narrow(alone).alias("added"))


def _count(k: int) -> Column:
    """The number of base spans of a kind."""
    return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k].name}")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = find(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(kind.name) for kind in KINDS])
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")
    return found.select("doc_id", *[_count(k) for k in range(4)], F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(F.array_sort(F.concat("base", "added"))).alias("spans"))


QUERIES = {"op3_pii": op3_pii}
ORACLE_SQL: dict[str, str] = {}
