"""Operators, sources, sinks, versions and the stream on small tables; and all queries against their SQL."""

import json
import os

import pytest
from pyspark.sql import functions as F

from curatrix import catalog
from curatrix.operators import edits, filters, matching, numeric, sequences, versions
from curatrix.sources import readers, writers
from curatrix.streaming import incremental

FOLDER = "/root/testdata/sf0.001"


def test_dataset_round_trip(spark, tmp_path):
    doc = {"metadata": {"name": "x"}, "samples": [{"id": "a", "filename": "a.wav", "caption": "é", "bpm": 90, "lyrics": "la", "is_instrumental": True}, {"id": "b", "audio_path": "/m/b.wav", "caption": None, "virtual": True}]}
    path = str(tmp_path / "in.json")
    with open(path, "w") as f:
        json.dump(doc, f)
    metadata, rows = readers.dataset(spark, path)
    assert json.loads(metadata.first()[0]) == {"name": "x"}
    keys = {r.id: set(r["keys"]) for r in rows.collect()}
    assert "caption" in keys["b"] and "genre" not in keys["b"]
    own = edits.normalize(rows.drop("keys"))
    assert {r.id: r.is_instrumental for r in own.collect()} == {"a": False, "b": None}
    writers.write_json(own, {"name": "x", "instrumental_mode": "mixed"}, str(tmp_path / "out"))
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "out")).collect())
    out = json.loads(text)
    assert out["metadata"] == {"name": "x", "num_samples": 1} and out["samples"][0]["caption"] == "é" and out["samples"][0]["audio_path"] == "a.wav"
    writers.write_csv(own, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == list(writers.CSV_COLUMNS)
    writers.write_jsonl(own, str(tmp_path / "jsonl"))
    assert spark.read.json(str(tmp_path / "jsonl")).count() == 1
    writers.write_files(spark.createDataFrame([("a.txt", "one"), ("b.txt", None)], "name string, text string"), str(tmp_path / "side"))
    assert sorted(os.listdir(tmp_path / "side")) == ["a.txt", "b.txt"]
    sizes = writers.write_folders(own.withColumn("genre", F.lit("g")), str(tmp_path / "split"), 0.5)
    assert {r.split: r.n for r in sizes.collect()} == {"train": 1}


def test_listings(spark, tmp_path):
    for name in ("a.WAV", "b.txt", "c.mp3", "d.mp3.part", "dataset-metadata.json", "e.mp3"):
        (tmp_path / name).write_bytes(b"" if name == "e.mp3" else b"x")
    assert [os.path.basename(r.path) for r in readers.audio_files(spark, str(tmp_path)).collect()] == ["a.WAV", "c.mp3"]
    report = {r.name: r.reason for r in readers.staging_report(readers.small_listing(spark, str(tmp_path))).collect()}
    assert report == {"a.WAV": None, "b.txt": "unsupported format", "c.mp3": None, "d.mp3.part": "interrupted transcode", "dataset-metadata.json": "metadata, not audio", "e.mp3": "empty or unreadable"}
    added = readers.add_paths(spark.createDataFrame([("/x/a.wav",)], "audio_path string"), spark.createDataFrame([("/x/a.wav",), ("/x/b.wav",), ("/x/b.wav",)], "path string"))
    assert {r.filename for r in added.collect()} == {None, "b.wav"}


def test_result_documents(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"results": [{"file": "/o/a.mp3", "caption": "one"}, {"file": "a.mp3", "caption": "two"}, {"file": "", "caption": "x"}]}))
    rows = matching.last_results(readers.results(spark, str(path)))
    assert {r.name: r.caption for r in rows.collect()} == {"a.mp3": "two"}
    path.write_text("[]")
    with pytest.raises(Exception, match="no list of results"):
        readers.results(spark, str(path)).collect()


def test_small_sources(spark, tmp_path):
    lines = spark.createDataFrame(enumerate(["# no", "", "Rock", "rock ", "Pop"]), "pos int, line string")
    assert [r.term for r in readers.term_lines(lines).orderBy("pos").collect()] == ["Rock", "Pop"]
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"artists": {"A": {"mood": ["dark", "slow"], "_note": ["x"]}}, "general": {"mix": ["dry"]}}))
    assert {(r.artist, r.facet, r.term) for r in readers.vocabulary(spark, str(path)).collect()} == {("A", "mood", "dark"), ("A", "mood", "slow"), (None, "mix", "dry")}
    x = spark.createDataFrame([('a<<{"k": 1}>>b', '[{"stream_name":"stdout","data":"o"},{"stream_name":"stderr","data":"e"},{"stream_name":"stdout","data":"k"}]', "CAPTION: c LYRICS: l")], "m string, log string, out string")
    r = x.select(readers.marked_json(F.col("m"), "<<", ">>", "k int").alias("m"), readers.log_stdout(F.col("log")).alias("log"), readers.split_output(F.col("out")).alias("out")).first()
    assert (r.m.k, r.log, r.out.caption, r.out.lyrics) == (1, "ok", "c", "l")
    files = spark.createDataFrame([("/s/a_vocals.wav",), ("/s/a_vocals.mp3",), ("/s/b_drums.wav",)], "path string")
    assert [(r.stem_type, r.path) for r in readers.stem_files(files, spark.createDataFrame([("a",)], "base string")).collect()] == [("vocals", "/s/a_vocals.mp3")]
    both = readers.overlay(spark.createDataFrame([("A", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("a", 9)], "k string, v int"), "k")
    assert {r.k: r.v for r in both.collect()} == {"a": 9, "b": 2}


def test_folds(spark):
    row = spark.range(1)
    kept = row.select(sequences.keep_apart(F.expr("array(0D, 3D, 8D, 9D, 20D)"), F.lit(8.0), F.lit(25.0))).first()[0]
    assert kept == [0.0, 8.0, 25.0]
    merged = row.select(sequences.merge_short(F.expr("array(named_struct('start',0D,'end',2D,'label','a'), named_struct('start',2D,'end',4D,'label','b'), named_struct('start',4D,'end',20D,'label','c'), named_struct('start',20D,'end',21D,'label','d'))"), 5.0)).first()[0]
    assert [(m.start, m.end, m.label) for m in merged] == [(0, 4, "a"), (4, 20, "c"), (20, 21, "d")]
    tiles = row.select(sequences.tiles(F.lit(65.0), 30.0)).first()[0]
    assert [(t.start, t.end) for t in tiles] == [(0, 30), (30, 60), (60, 65)]
    assert len(row.select(sequences.tiles(F.lit(60.4), 30.0)).first()[0]) == 2


def test_numbers_and_refs():
    assert filters.parse_numbers("3-1, 5,,5") == [1, 2, 3, 5]
    assert filters.parse_numbers("1 3 5") == [1, 3, 5] and filters.parse_numbers("2,4-5 9") == [2, 4, 5, 9] and filters.parse_numbers(" ") == []
    assert filters.parse_numbers("1-x") is None and filters.parse_numbers("1-2-3") is None


def test_export_of_all_formats(spark, tmp_path):
    rows = [(k, str(k), f"/m/t{k}.wav" if k else "", f"t{k}.wav", "g", 90, "A minor", 1.0, False, " tag ", " cap " if k % 2 else " ", "", "", "", k == 5) for k in range(6)]
    samples = spark.createDataFrame(rows, "pos long, id string, audio_path string, filename string, genre string, bpm long, keyscale string, duration double, is_instrumental boolean, custom_tag string, caption string, lyrics string, raw_lyrics string, formatted_lyrics string, virtual boolean")
    assert writers.export(samples, {"name": "x"}, str(tmp_path), {"folders", "csv", "sidecar"}) == ["csv", "sidecar", "folders"]
    header = next(line for f in sorted(os.listdir(tmp_path / "dataset.csv")) if f.endswith(".txt") for line in open(tmp_path / "dataset.csv" / f))
    assert [c.strip('"') for c in header.strip().split(",")] == ["id", "filename", "audio_path", "genre", "bpm", "keyscale", "duration", "is_instrumental", "custom_tag", "caption"]
    assert sorted(os.listdir(tmp_path / "captions")) == [f"t{k}.txt" for k in range(1, 5)]
    manifest = json.loads("".join(r[0] for r in spark.read.text(str(tmp_path / "manifest.json")).collect()))
    assert manifest == {"val_ratio": 0.2, "stratify": True, "tracks": []}  # no audio is there
    with pytest.raises(ValueError, match="unknown formats"):
        writers.export(samples, {}, str(tmp_path), {"xml"})


def test_markers_structure_and_fallback(spark, tmp_path):
    lines = spark.createDataFrame(enumerate(["# no", " [Solo] ", ""]), "pos int, line string")
    assert [r.marker for r in readers.section_markers(lines).collect()] == ["[Solo]"]
    assert [r.marker for r in readers.section_markers(None).orderBy("pos").collect()] == ["[Intro]", "[Verse]", "[Chorus]", "[Bridge]", "[Outro]"]
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"results": [{"file": "/o/a.wav", "segments": [{"name": "Verse", "start": 0, "end": 9.5}]}]}))
    assert [tuple(r) for r in readers.structure(spark, str(path), "/m/a.wav").collect()] == [(0, "Verse", 0.0, 9.5)]
    assert readers.structure(spark, str(path), "b.wav").count() == 0
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "x.txt").write_text("x")
    (tmp_path / "deep.wma").write_bytes(b"x")
    assert readers.nearest_audio(spark, str(tmp_path / "in"), str(tmp_path)).count() == 1


def test_history_and_decisions(spark):
    samples = spark.createDataFrame([("a", "old", ""), ("b", "", ""), ("c", "keep", "")], "id string, caption string, caption_ai_raw string")
    history = spark.createDataFrame([("a", "old", 1), ("c", "before", 1)], "id string, caption string, at int")
    got = edits.push_history(history, samples, F.lit(2))
    assert sorted((r.id, r.caption) for r in got.collect()) == [("a", "old"), ("c", "before"), ("c", "keep")]
    decisions = spark.createDataFrame([("a", "new", "use", None), ("b", "ERROR: x", "use", None), ("c", "p", "edit", " mine ")], "id string, proposed string, decision string, edited string")
    out = {r.id: r for r in edits.apply_decisions(samples, decisions).collect()}
    assert (out["a"].caption, out["a"].caption_before, out["b"].caption, out["c"].caption) == ("new", "old", "", "mine")


def test_versions(spark, tmp_path):
    a = spark.createDataFrame([("1", 5), ("2", 6)], "id string, n int")
    root = str(tmp_path)
    first = versions.save_version(a, root, "20240101", "start")
    versions.save_version(a.limit(1), root, "20240102")
    assert [(r.name, r.tracks) for r in versions.list_versions(spark, root).collect()] == [("v_20240102", 1), ("v_20240101_start", 2)]
    assert versions.load_version(spark, root, first).count() == 2
    diff = versions.diff_rows(a, spark.createDataFrame([("2", 7), ("3", 1)], "id string, n int"))
    assert {(r.id, r.change) for r in diff.collect()} == {("1", "removed"), ("2", "changed"), ("3", "added")}
    h = versions.History(3)
    for n in "abcd":
        h.push(n)
    assert (h.undo(), h.undo(), h.undo(), h.redo(), h.redo(), h.redo()) == ("c", "b", None, "c", "d", None)


def test_numeric(spark):
    rows = spark.createDataFrame([(k, [numeric.MAJOR[(i - k) % 12] for i in range(12)]) for k in range(12)], "k int, c array<double>")
    assert [r[0] for r in rows.orderBy("k").select(numeric.key_of(F.col("c"))).collect()] == [f"{n} major" for n in numeric.KEYS]
    pair = spark.createDataFrame([([1.0, -1.0], [1.0, -1.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 1.0], None)], "l array<double>, r array<double>")
    assert [r[0].label for r in pair.select(numeric.stereo(F.col("l"), F.col("r"))).collect()] == ["mono", "stereo", "mono"]
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(10)], "id int, embedding array<double>")
    got = numeric.project_2d(flat).orderBy("id").collect()
    assert abs(abs(got[0].x - got[9].x) - 9 * 5**0.5) < 1e-6 and all(abs(r.y) < 1e-6 for r in got)
    top = spark.range(1).select(numeric.top_labels(F.expr("array(named_struct('score', 1D, 'label', 'a'), named_struct('score', 3D, 'label', 'b'))"), 1)).first()[0]
    assert top[0].label == "b"


def test_stream_merges_once(spark, tmp_path):
    folder, table, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    os.makedirs(folder)
    with open(f"{folder}/1.json", "w") as f:
        f.write('{"file": "a.mp3", "caption": "one", "seq": 1}\n{"file": "b.mp3", "caption": "ERROR: x", "seq": 2}\n')
    incremental.merge_into(incremental.result_stream(spark, folder), table, check).awaitTermination()
    with open(f"{folder}/2.json", "w") as f:
        f.write('{"file": "o/a.mp3", "caption": "two", "seq": 3}\n{"file": "a.mp3", "caption": " ", "seq": 4}\n')
    for _ in range(2):
        incremental.merge_into(incremental.result_stream(spark, folder), table, check).awaitTermination()
    assert {r.name: r.caption for r in incremental.merged(spark, table).collect()} == {"a.mp3": "two"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, name):
    import duckdb

    df = catalog.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if (text := catalog.oracle_sql().get(name)) is None:
        return
    db = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    found = db.execute(text)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = [df.columns.index(c) for c in columns]
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted((tuple(r[i] for i in order) for r in rows), key=key) == sorted(found.fetchall(), key=key)
