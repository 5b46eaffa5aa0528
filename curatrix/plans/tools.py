"""The registry of named operations that an assistant may call: read-only ones and actions, each a function of DataFrames."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.operators import aggregates, edits, matching, merging, rules

READ: dict[str, Callable[..., DataFrame]] = {
    "get_dataset_summary": lambda s: summary_rows(s),
    "list_tracks": lambda s: s.select("pos", "filename", F.left("caption", F.lit(80)).alias("preview")),
    "audit_captions": rules.audit,
    "validate_manifest": lambda s: rules.manifest_issues(s, list(rules.REQUIRED_METADATA)),
    "get_dataset_sound_profile": aggregates.sound_profile,
    "curate_dataset": lambda s, target: curation(s, target),
    "scan_health": lambda s: said(s, "not available: the scan was removed"),
    "detect_instruments": lambda s: said(s, "runs with the structural analysis: see operators.audio.analyse"),
    "find_gaps": rules.gaps,
    "tag_stats": aggregates.tag_stats,
    "lookup_instruments": lambda s: s.select("id", matching.lookup_instruments(F.col("filename"), F.lit(""), matching.SONG_INSTRUMENTS).alias("instruments")),
}
ACTIONS: dict[str, Callable[..., DataFrame]] = {
    "set_track_metadata": edits.set_field,
    "write_caption": lambda s, where, text: edits.set_field(s, where, "caption", text),
    "import_lyrics": edits.import_lyrics,
    "create_virtual_dataset": lambda s, specs: s.unionByName(edits.virtual_tracks(specs), allowMissingColumns=True),
    "normalize_audio": merging.loudness_plan,
    "stage_temp_mp3": lambda s, folder: s.select("id", F.when(T.text_of(F.col("audio_path")) != "", merging.mp3_command(F.col("audio_path"), F.concat(F.lit(f"{folder}/"), T.staged_name(F.col("filename"))))).alias("command")),
}


def summary_rows(samples: DataFrame, shown: int = 12) -> DataFrame:
    """pos and line: the first tracks, and behind them how many more there are."""
    first = samples.orderBy("pos").limit(shown).select("pos", "filename")
    more = samples.agg((F.count(F.lit(1)) - shown).alias("n")).filter("n > 0").select(F.lit(None).cast("long").alias("pos"), F.format_string("… %d more", "n").alias("filename"))
    return first.unionAll(more)


def said(samples: DataFrame, text: str) -> DataFrame:
    """One row with a message."""
    return samples.sparkSession.createDataFrame([(text,)], "message string")


def curation(samples: DataFrame, target: str) -> DataFrame:
    """kind, value and n: the sound aimed at, and the present profile to set against it."""
    if not (target or "").strip():
        raise ValueError("a target sound is needed: an artist, a genre or a mood")
    aim = samples.sparkSession.createDataFrame([("target", target.strip(), None)], "kind string, value string, n long")
    return aim.unionByName(aggregates.sound_profile(samples))


def call(name: str, samples: DataFrame, *args, **options) -> DataFrame:
    """Run an operation by name."""
    fn = READ.get(name) or ACTIONS.get(name)
    if fn is None:
        raise ValueError(f"no operation {name}")
    return fn(samples, *args, **options)


def register(spark: SparkSession) -> list[str]:
    """Make the lyric and caption functions and the table functions known to SQL; returns their names."""
    from curatrix.functions import lyrics
    from curatrix.packing import ship
    from curatrix.plans import table_functions

    ship(spark)
    own = {"split_lyric_lines": lyrics.split_lines, "trim_caption": lyrics.trim_caption, "line_diff": lyrics.line_diff, "tidy_lyrics": lambda t: lyrics.Tidy()(t)[0]}
    for name, fn in own.items():
        spark.udf.register(name, _scalar(fn))
    return sorted([*own, *table_functions.register(spark)])


def _scalar(fn: Callable[..., str]):
    """A scalar Arrow UDF that SQL can call."""
    import inspect

    if len(inspect.signature(fn).parameters) == 2 and fn.__name__ == "line_diff":

        @F.pandas_udf("string")
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([fn(x, y) for x, y in zip(a, b, strict=True)])
    else:

        @F.pandas_udf("string")
        def run(a: pd.Series) -> pd.Series:
            return pd.Series([fn(x) for x in a])

    return run
