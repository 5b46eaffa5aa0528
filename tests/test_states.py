"""Saved states, polled lists, debounced edits, table functions, typed documents."""

import json
import os
from datetime import datetime, timedelta, timezone

import pytest

from pyspark.sql import functions as F

from curatrix.functions import lyrics
from curatrix.operators import sequences, versions
from curatrix.plans import table_functions, tools
from curatrix.sources import polled, readers
from curatrix.streaming import edits


# --- saved states


def ids(rows):
    return sorted(r.id for r in rows[1].select("id").collect())


def test_saves_follow_each_other(spark, tmp_path):
    root, table = f"{tmp_path}/set", lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    with pytest.raises(FileNotFoundError):
        versions.load_current(spark, root)
    first = versions.save_current(table("a"), {"name": "é"}, root, "1")
    assert versions.load_current(spark, root)[0] == {"name": "é", "num_samples": 1} and versions.backups(spark, root) == []
    versions.save_current(table("a", "b"), {}, root, "2")
    # two saves of one second keep both backups
    versions.save_current(table("c"), {}, root, "2")
    assert ids(versions.load_current(spark, root)) == ["c"] and versions.backups(spark, root) == ["CURRENT.bak-2", "CURRENT.bak-2-1"]
    assert versions.restore_backup(spark, root, "CURRENT.bak-2") == first
    assert ids(versions.load_current(spark, root)) == ["a"] and len(versions.backups(spark, root)) == 3
    assert versions.prune(spark, root) == []
    # a state is read by a frame that outlives the next save
    old = versions.load_current(spark, root)
    versions.save_current(table("z"), {}, root, "3")
    assert ids(old) == ["a"] and ids(versions.load_current(spark, root)) == ["z"]


@pytest.mark.parametrize("step", ["data", "_put0", "_put1", "_put2", "_move"])
def test_a_save_that_dies_leaves_the_old_state(spark, tmp_path, monkeypatch, step):
    root = f"{tmp_path}/set"
    versions.save_current(spark.createDataFrame([("old",)], "id string"), {"k": 1}, root, "1")
    pointer = open(f"{root}/CURRENT").read()
    new = spark.createDataFrame([("new",)], "id string")
    if step == "data":
        new = new.select(F.when(F.col("id") == "new", F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("string").alias("id"))
    else:
        own, count = getattr(versions, step.rstrip("012")), [0]

        def dies(*a):
            count[0] += 1
            if step == "_move" or count[0] == int(step[-1]) + 1:
                raise OSError("lost")
            return own(*a)

        monkeypatch.setattr(versions, step.rstrip("012"), dies)
    with pytest.raises(Exception, match="lost"):
        versions.save_current(new, {"k": 2}, root, "2")
    monkeypatch.undo()
    metadata, rows = versions.load_current(spark, root)
    assert (metadata["k"], [r.id for r in rows.collect()], open(f"{root}/CURRENT").read()) == (1, ["old"], pointer)
    assert len(versions.prune(spark, root)) == 1
    assert ids(versions.load_current(spark, root)) == ["old"]
    versions.save_current(spark.createDataFrame([("later",)], "id string"), {}, root, "3")
    assert ids(versions.load_current(spark, root)) == ["later"]


def test_deletes_keep_audio_and_rows(spark, tmp_path):
    for name in ("a/x.wav", "b/x.wav", "y.wav"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(name.encode())
    rows = [("1", f"{tmp_path}/a/x.wav", "c1"), ("2", f"{tmp_path}/b/x.wav", "c2"), ("3", f"{tmp_path}/y.wav", "c3"), ("4", f"{tmp_path}/none.wav", "c4"), ("5", "", "c5"), ("6", None, "c6")]
    samples = spark.createDataFrame(rows, "id string, audio_path string, caption string")
    gone = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    kept = str(tmp_path / "deleted")
    stays = versions.delete_with_backup(samples, gone("1", "2", "4", "5", "none"), kept, "t1")
    assert sorted(r.id for r in stays.collect()) == ["3", "6"]
    assert (tmp_path / "deleted/x.wav").read_bytes() == b"a/x.wav" and (tmp_path / "deleted/x_t1-2.wav").read_bytes() == b"b/x.wav"
    # a name that an earlier delete took
    (tmp_path / "c").mkdir()
    (tmp_path / "c/x.wav").write_bytes(b"third")
    versions.delete_with_backup(spark.createDataFrame([("7", f"{tmp_path}/c/x.wav", "c7")], samples.schema), gone("7"), kept, "t2")
    assert (tmp_path / "deleted/x.wav").read_bytes() == b"a/x.wav" and (tmp_path / "deleted/x_t2-7.wav").read_bytes() == b"third"
    assert {(r.id, r.caption) for r in spark.read.parquet(f"{kept}/rows").collect()} == {("1", "c1"), ("2", "c2"), ("4", "c4"), ("5", "c5"), ("7", "c7")}


# --- polled lists


def answer(folder, name, value):
    (folder / f".{name}").write_text(value if isinstance(value, str) else json.dumps(value))
    os.replace(folder / f".{name}", folder / name)


def test_answers_arrive_once(spark, tmp_path):
    folder = tmp_path / "answers"
    folder.mkdir()
    where = [str(tmp_path / x) for x in ("out", "check")]

    def run(most=0):
        rows = polled.polled(spark, str(folder), most)
        rows.writeStream.format("parquet").option("path", where[0]).option("checkpointLocation", where[1]).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.poll for r in spark.read.schema("poll string, value string").parquet(where[0]).collect())

    answer(folder, "001.json", [{"render_id": 40, "name": "Roformer", "algorithm_fields": [{"a": 1}]}, "no object", {"name": "no id"}, {"render_id": "41"}])
    answer(folder, "002.json", "no json")
    (folder / "note.txt").write_text("x")
    assert run() == ["001.json", "002.json"]
    assert run() == ["001.json", "002.json"]  # a restart reads nothing twice
    answer(folder, "003.json", {"success": True, "status": "done"})
    answer(folder, "004.json", {"success": False})
    answer(folder, "005.json", {"success": True, "status": "processing"})
    assert run(1)[:3] == ["001.json", "002.json", "003.json"]
    for _ in range(2):
        got = run(1)
    assert got == [f"00{k}.json" for k in range(1, 6)]
    rows = spark.read.schema("poll string, value string").parquet(where[0])
    assert [tuple(r) for r in polled.algorithms(rows).orderBy("pos").collect()] == [("001.json", 0, "40", "Roformer", '[{"a":1}]'), ("001.json", 3, "41", "41", "[]")]
    states = {r.poll: r.s for r in rows.select("poll", polled.job_state(F.col("value")).alias("s")).collect()}
    assert [states[f"00{k}.json"] for k in (3, 4, 5)] == ["done", "failed", "processing"]


# --- debounced edits


def test_edits_are_written_once_they_rest(spark, tmp_path):
    folder, base = tmp_path / "in", datetime(2024, 1, 1, tzinfo=timezone.utc)
    folder.mkdir()
    batches = [
        [("a", 1, 0.0, "x"), ("a", 2, 0.5, "xy"), ("b", 1, 0.2, "one"), ("a", 2, 0.5, "xy")],
        [("a", 3, 1.5, "xyz"), ("a", 1, 0.1, "late")],
        [("c", 1, 20.0, "moves the watermark")],
        [("a", 3, 1.5, "xyz"), ("b", 2, 21.0, "one"), ("a", 4, 21.0, "again")],
        [("c", 2, 60.0, "far")],
        [("c", 3, 90.0, "farther")],
    ]
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for k, rows in enumerate(batches):
            lines = [json.dumps({"id": i, "seq": s, "ts": (base + timedelta(seconds=t)).isoformat(), "text": x}) for i, s, t, x in rows]
            (tmp_path / f"{k}.json").write_text("\n".join(lines))
            os.utime(tmp_path / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
            os.replace(tmp_path / f"{k}.json", folder / f"{k}.json")
            # every batch in a query of its own: state and timers outlive restarts
            stream = spark.readStream.schema("id string, seq long, ts timestamp, text string").json(str(folder))
            edits.debounced(stream, quiet=2.0, late="5 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        got = sorted((r.id, r.seq, r.text, r.edits) for r in spark.read.schema(edits.WRITTEN).parquet(str(tmp_path / "out")).collect())
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # the repeats and the late edit give no rows, nor does b's second edit, which repeats its text
    assert got == [("a", 3, "xyz", 3), ("a", 4, "again", 1), ("b", 1, "one", 1), ("c", 1, "moves the watermark", 1), ("c", 2, "far", 1)]


# --- table functions


def test_table_functions_equal_the_columns(spark):
    names = tools.register(spark)
    assert {"lyric_lines", "line_pairs", "lyric_blocks", "split_lyric_lines"} <= set(names)
    text = "[verse]\nwalking down the long and winding road to nowhere in the night\n\nshort"
    rows = [(0, text, "a\nb\nc"), (1, None, "a\nx\nc\nd"), (2, "", ""), (3, "la", None)]
    spark.createDataFrame(rows, "id long, before string, after string").createOrReplaceTempView("t")
    got = spark.sql("SELECT t.id, l.at, l.line FROM t, LATERAL lyric_lines(t.before, 10) l").collect()
    for k, before, _ in rows:
        assert "\n".join(r.line for r in sorted((r for r in got if r.id == k), key=lambda r: r.at)) == lyrics.split_lines(before, 10)
    pairs = spark.sql("SELECT t.id, p.* FROM t, LATERAL line_pairs(t.before, t.after) p").collect()
    for k, before, after in rows:
        assert [(r.before, r.after) for r in sorted((r for r in pairs if r.id == k), key=lambda r: r.at)] == lyrics.line_pairs(before, after)


def test_blocks_as_a_table_function(spark):
    table_functions.register(spark)
    texts = [(1, "lost\n---- a.wav ----\nla\n\n----b - c --- ----\nx\n---- a.wav ----\nlater\n--------\nz\n"), (2, "nothing"), (3, "---- only ----")]
    docs = spark.createDataFrame(texts, "doc long, text string")
    docs.select("doc", F.posexplode(F.split("text", "\n")).alias("at", "line")).createOrReplaceTempView("lines")
    got = spark.sql("SELECT * FROM lyric_blocks(TABLE(lines) PARTITION BY doc ORDER BY at)").collect()
    want = sequences.parse_blocks(docs).collect()
    assert sorted((r.doc, r.filename, r.text) for r in got) == sorted((r.doc, r.filename, r.text) for r in want) and len(want) == 4


def test_operations_by_name(spark):
    rows = spark.createDataFrame([(0, "a.wav", "cap", "g", "", "drums", 90, False)], "pos long, filename string, caption string, genre string, keyscale string, detected_instruments string, bpm long, is_instrumental boolean")
    assert len(tools.READ) + len(tools.ACTIONS) == 17  # tag_stats is one of ours
    aim = tools.call("curate_dataset", rows, " dark synth ").collect()
    assert (aim[0].kind, aim[0].value) == ("target", "dark synth") and {r.value for r in aim} >= {"tracks", "drums"}
    with pytest.raises(ValueError, match="target"):
        tools.call("curate_dataset", rows, " ")
    assert "removed" in tools.call("scan_health", rows).first().message
    with pytest.raises(ValueError, match="no operation"):
        tools.call("other", rows)


# --- typed documents


def test_profiles_are_typed(spark, tmp_path):
    docs = {
        "full.json": {"name": "N", "contractions": {"she'll": "sheel"}, "ing_exceptions": ["king"], "case_fixed": ["b", "A"], "ing_to_in": 1, "capitalize_tags": False, "strip_punctuation": "", "notes": "n"},
        "bare.JSON": {}, "empty.json": {"name": "", "contractions": None, "ing_exceptions": None, "case_fixed": [], "ing_to_in": [], "capitalize_tags": None, "strip_punctuation": "no", "notes": None},
    }
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc))
    (tmp_path / "corrupt.json").write_text('{"name": "x",')
    (tmp_path / "list.json").write_text("[1]")
    got = {r.file: r.profile for r in readers.typed_profiles(spark, str(tmp_path)).collect()}
    assert got["corrupt"] is None and got["list"] is None and len(got) == 5
    f, b, e = got["full"], got["bare"], got["empty"]
    assert tuple(f) == ("N", {"she'll": "sheel"}, ["king"], ["A", "b"], True, False, False, "n")
    assert tuple(b) == ("bare", {}, [], [], False, True, True, "")
    assert tuple(e) == ("empty", {}, [], [], False, False, True, "")


def test_catalog(spark, tmp_path):
    path = tmp_path / "models.json"
    path.write_text(json.dumps({"schema_version": 1, "models": [{"id": "a", "name": "A", "default": True, "size": 3}, {"id": "b", "note": "first"}, {"id": "b", "note": "second"}], "leaderboards": [{"name": "L", "url": "u"}, {"name": "M"}]}))
    rows = readers.models(spark, str(path))
    assert [(r.id, r.name, r.default, r.hf_repo) for r in rows.orderBy("pos").collect()] == [("a", "A", True, ""), ("b", "", False, ""), ("b", "", False, "")]
    wanted = spark.createDataFrame([("b",), ("none",), ("b",)], "id string")
    assert [(r.id, r.note) for r in readers.find_model(rows, wanted).collect()] == [("b", "first")]
    assert [(r.name, r.url) for r in readers.leaderboards(spark, str(path)).orderBy("pos").collect()] == [("L", "u"), ("M", "")]
    files = spark.createDataFrame([("/m/a/w.bin",), ("/m/c/x",)], "path string")
    assert {(r.id, r.downloaded) for r in readers.downloaded(rows, files).collect()} == {("a", True), ("b", False)}


def test_writes_of_a_call_come_in_one_frame():
    from types import SimpleNamespace

    import pandas as pd

    kept, timers = [None], []
    own = edits.Debounce(60)
    own.handle = SimpleNamespace(registerTimer=timers.append, deleteTimer=timers.remove)
    own.state = SimpleNamespace(get=lambda: kept[0], update=lambda x: kept.__setitem__(0, x), exists=lambda: kept[0] is not None)
    at = pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:02:00", "2024-01-01 00:01:59.999", "2024-01-01 00:05:00", "2024-01-01 00:06:00"], format="ISO8601")
    made = list(own.handleInputRows(("a",), iter([pd.DataFrame({"seq": [1, 3, 2, 4, 5], "ts": at, "text": ["p", "r", "q", "s", "t"]})]), None))
    assert len(made) == 1
    assert made[0].values.tolist() == [["a", "p", 1, 1], ["a", "r", 3, 2], ["a", "s", 4, 1]]
    last = list(own.handleExpiredTimer(("a",), None, None))
    assert [x.values.tolist() for x in last] == [[["a", "t", 5, 1]]] and list(own.handleExpiredTimer(("a",), None, None)) == []
    assert kept[0] == ("t", 5, -1, 0, "t", 5) and len(timers) == 1
