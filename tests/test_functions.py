"""Lyric rules and native text functions against plain expectations."""

import pytest
from pyspark.sql import functions as F

from curatrix.functions import lyrics, text as T
from curatrix.functions.lyrics import Tidy
from curatrix.operators import rules


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("[verse 1]", "[Verse 1]"), ("[pre-chorus]", "[Pre-Chorus]"), ("[GUITAR SOLO]", "[Guitar Solo]"), ("[Chorus]\nshe'll be there", "[Chorus]\nSheel be there"), ("SHE'LL GO", "SHEEL GO"),
        ("I'm here", "eyem here"), ("and I'm here", "And eyem here"), ("rock 'n' roll", "Rock n roll"), ("[Rock 'n' Roll] rock 'n' roll", "[Rock 'n' Roll] Rock n roll"), ("hello world!", "Hello world"),
        ('"hello', "Hello"), ("save me!)", "Save me)"), ("[Chorus - loud - big]", "[Chorus]"), ("[EN - Verse]", "[En - verse]"), ("[Verse 1]\n[Raspy Vocal] [Groove]\nI walked", "[Verse 1]\nI walked"),
        ("[Verse]\n\n[Chorus]", "[Verse]\n\n[Chorus]"), ("iPhone song", "iPhone song"), ("---- a's b.wav ----\ncan't stop,", "---- a's b.wav ----\nCant stop"), ("", ""), ("go'em now", "Goem now"),
        ("- dash first", "- dash first"), ("walk on …", "Walk on"),
    ],
)
def test_tidy(given, want):
    assert Tidy()(given)[0] == want


def test_tidy_options_and_report():
    text, report = Tidy(ing_to_in=True)('singing "all" morning\ncan\'t, don\'t\n[verse - soft]\n[x]')
    assert text == "Singin all morning\nCant, dont\n[Verse]"
    assert (report["ing"], report["quotes"], report["contractions"], report["tags_trimmed"], report["tags_dropped"], report["apostrophes"], report["capitalized"]) == (1, 2, 2, 1, 1, 2, 2)
    assert ("singing", "Singin") in report["word_changes"]
    plain = Tidy(contractions={}, capitalize_tags=False, strip_punctuation=False, capitalize_lines=False, strip_quotes=False, trim_modifiers=False, drop_stray=False)
    assert plain('[a - b]\n[c]\n"it," she said!')[0] == '[a - b]\n[c]\n"it," she said!'
    once = Tidy()("[verse - x]\nshe'll don't!")[0]
    assert Tidy()(once)[0] == once


def test_case_twins():
    table = lyrics.case_twins({"she'll": "sheel", "i'm": "eyem", "She'll": "Shell"})
    assert table["SHE'LL"] == "SHEEL" and table["She'll"] == "Shell" and "I'm" not in table
    assert lyrics.case_twins(table) == table


@pytest.mark.parametrize(("new", "old", "want"), [("sheel", "SHE'LL", "SHEEL"), ("sheel", "She'll", "Sheel"), ("sheel", "she'll", "sheel"), ("abcdef", "aBcD", "aBcDef"), ("ab", "aBcD", "Ab"), ("x", "''", "x")])
def test_match_case(new, old, want):
    assert lyrics.match_case(new, old) == want


def test_split_and_trim():
    assert all(lyrics.syllables(x) <= 10 for x in lyrics.split_lines("banana " * 12).split("\n"))
    assert lyrics.split_lines("[a very long marker line that stays as it is all along]\n\nshort") == "[a very long marker line that stays as it is all along]\n\nshort"
    assert lyrics.trim_caption("a, b. Short.") == "a, b. Short."
    assert lyrics.trim_caption("a, b, c. One two three. Four five six seven.", 8, 2) == "a, b. One two three. Four five six."
    assert lyrics.trim_caption(None) == ""
    assert lyrics.line_diff("a\nb", "a\nc").split("\n") == ["-b", "+c"]
    assert lyrics.line_diff("same", "same") == "" and lyrics.line_pairs("same", "same") == []
    assert lyrics.line_pairs("[verse]\nShe'll run", "[Verse]\nSheel run\nx") == [("[verse]", "[Verse]"), ("She'll run", "Sheel run"), (None, "x")]


def value(spark, column, **given):
    rows = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in given.items()))
    return rows.select(column).first()[0]


def test_native_functions(spark):
    x = F.col("x")
    assert value(spark, T.lrc_time(x), x=61.0) == "[01:01.00]"
    assert value(spark, T.lrc_time(x), x=0.999) == "[00:01.00]"
    assert value(spark, T.trim_tag_modifiers(x), x="[Chorus - a] [EN - Verse] [Pre-Chorus]") == "[Chorus] [EN - Verse] [Pre-Chorus]"
    assert value(spark, T.strip_apostrophes(x), x="it's [don't] ’n") == "its [don't] n"
    assert value(spark, T.song_name(x), x="03. Band - My  Song.mp3") == "My_Song"
    assert value(spark, T.staged_name(x), x="/a/b/Tränen?.flac") == "Tr_nen_.mp3"
    assert value(spark, T.staged_name(x, False), x="a.FLAC") == "a.flac" and value(spark, T.staged_name(x, False), x="a.wma") == "a.wma"
    assert [value(spark, T.song_name(x), x=v) for v in (" 3 - A - B\tC .mp3", "_x_.wav", "12.Song.ogg")] == ["B_C", "x", "Song"]
    assert value(spark, T.staged_name(x), x="") == "track.mp3"
    assert [value(spark, T.parse_clock(x), x=v) for v in ("", "90s", "2:05", "1:00:00", "abc", "2.5")] == [0, 90, 125, 3600, None, 2]
    assert value(spark, T.normalize_instrument(x), x=" Guitars ") == "guitar" and value(spark, T.normalize_instrument(x), x="kazoo") == "kazoo"
    assert value(spark, T.mime_of(x), x="a.FLAC") == "audio/flac"
    assert value(spark, T.count_syllables(x), x="banana rhythm 7 it's") == 6
    assert value(spark, T.strip(x), x=" \x85 a b ") == "a b"


GOOD = "rock, electric guitar, drums, bass, male vocal. A steady beat carries the verse. The chorus opens wide with harmonies."


@pytest.mark.parametrize(
    ("caption", "codes"),
    [
        (GOOD, []), ("", ["empty"]), (" \n", ["empty"]), (GOOD.replace("male vocal", "warm"), ["no_vocal_term"]), ("Genre & Style: x\n" + GOOD, ["heading"]), (GOOD + " **bold**", ["markdown"]),
        (GOOD.replace("steady", "120 BPM"), ["bpm"]), (GOOD.replace("steady", "3/4"), ["time_signature"]), (GOOD.replace("steady", "A minor"), ["key"]), (GOOD + " One more line here. And another line here.", ["many_sentences"]),
        (GOOD.replace("wide", "la la la la la"), ["ngram_repeat", "word_run"]), ("tenor. " + "Word after word goes. " * 2, ["few_tags"]),
    ],
)
def test_caption_rules(spark, caption, codes):
    got = value(spark, F.transform(rules.caption_issues(F.col("x")), rules.rule_of), x=caption)
    assert got == codes


def test_repeats(spark):
    assert tuple(value(spark, rules.max_ngram_repeat(F.col("x")), x="b b b a a a b b b a a a")) == (2, "b b b")
    assert tuple(value(spark, rules.max_ngram_repeat(F.col("x")), x="a b")) == (0, "")
    assert tuple(value(spark, rules.max_consecutive_repeat(F.col("x")), x="x y y z z")) == (2, "y")
    assert tuple(value(spark, rules.max_consecutive_repeat(F.col("x")), x="...")) == (1, "")
