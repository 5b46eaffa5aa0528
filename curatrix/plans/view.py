"""The samples view: the canonical track schema over the ``documents`` table.

The expressions are plain SQL that Spark and DuckDB read alike, so queries and their oracles start from one definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column to SQL expression over ``documents``.
SAMPLE_COLUMNS = {
    "pos": "cast(doc_id as bigint)",
    "id": "cast(doc_id as string)",
    "audio_path": "concat('/music/set', cast(doc_id % 7 as string), '/track_', cast(doc_id as string), '.wav')",
    "filename": "case when doc_id % 50 = 0 then 'dup.wav' else concat('0', cast(doc_id % 10 as string), '-Artist - song ', cast(doc_id as string), '.wav') end",
    "caption": "case when doc_id % 11 = 0 then '' when doc_id % 13 = 0 then concat('Rock, Electric Guitar, Drums, male vocal, warm. Recorded at 120 BPM in A minor. **Bold** ', coalesce(text, '')) when doc_id % 17 = 0 then 'pop, piano, bass, drums, tenor, bright. A calm verse opens the song. The chorus lifts it with organ.' else coalesce(text, '') end",
    "genre": "case when doc_id % 19 = 0 then ' ' else coalesce(source, '') end",
    "keyscale": "case doc_id % 5 when 0 then 'A minor' when 1 then 'C major' when 2 then 'G major' when 3 then '' else 'E minor' end",
    "timesignature": "case when doc_id % 4 = 0 then '3/4' else '4/4' end",
    "bpm": "cast(case when doc_id % 7 = 0 then 0 when doc_id % 101 = 0 then 400 else 60 + doc_id % 120 end as bigint)",
    "duration": "cast(coalesce(n_chars, 0) as double) / 10",
    "language": "case when doc_id % 23 = 0 then '' else coalesce(lang, '') end",
    "is_instrumental": "doc_id % 3 = 0",
    "virtual": "doc_id % 29 = 0",
    "lyrics": "case when doc_id % 4 = 0 then '' when doc_id % 4 = 1 then concat('[verse ', cast(doc_id % 3 as string), ' - quiet]', chr(10), 'she''ll be singing ', coalesce(lang, ''), chr(10), 'walking on', chr(10), '[Chorus]', chr(10), '[loud]', chr(10), 'don''t look back!') else 'la la la la la la la la la la la la la la la' end",
    "raw_lyrics": "case when doc_id % 8 = 1 then 'raw words' else '' end",
    "formatted_lyrics": "case when doc_id % 6 = 1 then 'Formatted words' else '' end",
    "custom_tag": "case doc_id % 6 when 0 then 'Guitar, synth pads; drums' when 1 then '' when 2 then 'Rhodes|Bass / organ' when 3 then 'guitar' when 4 then 'mood, , warm' else 'Drum Kit' end",
    "detected_instruments": "case doc_id % 4 when 0 then 'Drums, Bass' when 1 then 'electric guitars,Vocals' when 2 then '' else ' synth , piano' end",
    "caption_ai_raw": "case when doc_id % 9 = 0 then 'ERROR: no reply' when doc_id % 9 = 1 then ' ' when doc_id % 9 = 2 then 'a new caption' else coalesce(text, '') end",
    "prompt_override": "case doc_id % 4 when 0 then 'caption' when 1 then 'genre' when 2 then 'true' else null end",
}

#: A common table expression of the view, for oracles.
SAMPLES_SQL = "samples AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in SAMPLE_COLUMNS.items()) + " FROM documents)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each track; unused columns are pruned to the scan."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(*[F.expr(e).alias(c) for c, e in SAMPLE_COLUMNS.items()])


def sql(body: str) -> str:
    """An oracle over the samples view."""
    return f"WITH {SAMPLES_SQL}\n{body}"
