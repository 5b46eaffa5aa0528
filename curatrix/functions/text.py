"""Native text functions: every one is a Column expression, inside code generation where Spark allows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that text is stripped of and split at.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{BLANKS}]"


def bound(x: Column, body) -> Column:
    """body(x) with x made once, however often the body names it."""
    return F.get(F.transform(F.array(x), lambda v: body(v)), F.lit(0))


# Instrument aliases and the names they lead to.
ALIASES = {
    "fiddle": "violin", "upright bass": "double bass", "standup bass": "double bass", "string bass": "double bass", "acoustic bass": "double bass",
    "lap steel": "pedal steel guitar", "steel guitar": "pedal steel guitar", "pedal steel": "pedal steel guitar", "acoustic bass guitar": "bass", "bass guitar": "bass",
    "backing vocal": "backing vocals", "backing vocals": "backing vocals", "harmony vocal": "backing vocals", "harmony vocals": "backing vocals",
    "male vocal": "lead vocal", "female vocal": "lead vocal", "male vocals": "lead vocal", "female vocals": "lead vocal", "singer": "lead vocal", "vocalist": "lead vocal", "vocals": "lead vocal", "voice": "lead vocal",
    "electric bass": "bass", "rhythm guitar": "guitar", "lead guitar": "guitar", "acoustic steel guitar": "acoustic guitar", "classical guitar": "acoustic guitar",
    "drum kit": "drums", "keyboard": "piano", "synths": "synth", "electric piano": "rhodes",
}
CANONICAL = (
    "organ", "harpsichord", "accordion", "vibraphone", "rhodes", "piano", "guitar", "acoustic guitar", "electric guitar", "pedal steel guitar", "steel guitar",
    "harp", "mandolin", "banjo", "sitar", "ukulele", "dobro", "violin", "viola", "cello", "double bass", "bass", "drums", "synth", "saxophone", "flute",
    "trumpet", "trombone", "clarinet", "harmonica", "brass", "woodwind", "percussion", "tambourine", "congas", "marimba", "xylophone", "bells", "cowbell",
)
# Audio suffixes that are accepted for staging.
AUDIO = ("wav", "mp3", "flac", "m4a", "ogg", "aac", "wma")


def text_of(x: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(x, F.lit(""))


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text_of(x), F.lit(BLANKS))


def words(x: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(text_of(x), f"{SPACE}+"), lambda w: w != "")


def n_words(x: Column, most: int = -1) -> Column:
    """How many words there are; counting stops at ``most``. Splitting is several times as fast as counting matches."""
    return F.when(strip(x) == "", 0).otherwise(F.size(F.split(strip(x), f"{SPACE}+", most)))


def first_of(*xs: Column) -> Column:
    """The first text that is not empty, else an empty one."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in xs], F.lit(""))


def basename(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The base name without its last suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def splitext(path: Column) -> tuple[Column, Column]:
    """The path without its last suffix, and the suffix with its full stop; leading full stops of the name begin no suffix."""
    suffix = F.regexp_extract(path, r"^(?:.*/)?\.*[^/.][^/]*?(\.[^./]*)$", 1)
    return F.left(path, F.length(path) - F.length(suffix)), suffix


def strip_apostrophes(line: Column) -> Column:
    """Without apostrophes, straight, curly, modifier or prime, outside square brackets."""
    return F.regexp_replace(line, "(\\[[^\\]]*\\])|['’‘ʼ′]", "$1")


def strip_quotes(line: Column) -> Column:
    """Without double quotes, straight, curly or guillemets."""
    return F.translate(line, '"“”„‟«»', "")


def trim_tag_modifiers(text: Column) -> Column:
    """[Chorus - loud] to [Chorus]; a bracket that begins with a language code stays."""
    return F.regexp_replace(text, r"\[(?![A-Z]{2}\s* -)([^\]]*?)\s* -[^\]]*\]", "[$1]")


def count_syllables(text: Column) -> Column:
    """Vowel groups, one at least, of each word."""
    found = F.regexp_extract_all(F.lower(text_of(text)), F.lit("[a-z0-9']+"), F.lit(0))
    return F.aggregate(found, F.lit(0), lambda n, w: n + F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouy]+"))))


def lrc_time(seconds: Column) -> Column:
    """[mm:ss.cc]; hundredths that round to 100 carry into the seconds."""
    cs = F.bround(seconds * 100).cast("long")
    return F.format_string("[%02d:%02d.%02d]", F.floor(cs / 6000), F.floor(cs / 100) % 60, cs % 100)


def normalize_instrument(name: Column) -> Column:
    """The name trimmed and lower-cased, then its alias, or the alias or known name of its singular, else itself."""
    low = F.lower(F.trim(name))
    table = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    known = F.array(*[F.lit(x) for x in CANONICAL])
    chop = F.substring(low, F.lit(1), F.length(low) - 1)
    single = F.when(low.endswith("s"), F.coalesce(table[chop], F.when(F.array_contains(known, chop), chop)))
    return F.coalesce(table[low], single, low)


def format_tags(bpm: Column, key: Column, timesig: Column, instruments: Column, instrumental: Column, stereo: Column) -> Column:
    """BPM; key; time signature; instruments; Instrumental; mono recording: those that are known."""
    return F.concat_ws(
        "; ",
        F.when(bpm > 0, F.concat(bpm.cast("string"), F.lit(" BPM"))), F.nullif(key, F.lit("")), F.nullif(timesig, F.lit("")),
        F.when(F.size(instruments) > 0, F.concat(F.lit("Instruments: "), F.array_join(instruments, ", "))),
        F.when(instrumental, "Instrumental"), F.when(stereo == F.lit(False), "mono recording"),
    )


def compose_caption(tags: Column, prose: Column, ratio: Column) -> Column:
    """Prose at 0, tags at 100 (prose if there are none), both between."""
    r = F.greatest(F.lit(0), F.least(F.lit(100), ratio))
    both = F.when((text_of(tags) != "") & (text_of(prose) != ""), F.concat(tags, F.lit("\n\n"), prose)).otherwise(first_of(tags, prose))
    return F.when(r == 0, text_of(prose)).when(r == 100, first_of(tags, prose)).otherwise(both)


def staged_name(path: Column, to_mp3: bool = True) -> Column:
    """The name of a track in staging: unsafe runs of its stem as an underscore, and an accepted suffix."""
    bare = F.trim(F.regexp_replace(stem(text_of(path)), r"[^A-Za-z0-9._ ()-]+", "_"))
    suffix = F.lower(F.regexp_extract(basename(text_of(path)), r".(\.[^.]*)$", 1))
    kept = F.lit(".mp3") if to_mp3 else F.when(suffix.isin([f".{x}" for x in AUDIO]), suffix).otherwise(".mp3")
    return F.concat(first_of(bare, F.lit("track")), kept)


def slug(text: Column) -> Column:
    """Runs of other characters than letters, digits, underscore and hyphen replaced, trimmed of underscores."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")


def estimate_tokens(text: Column) -> Column:
    """Tokens, estimated at 3.7 characters each."""
    return F.ceil(F.char_length(text_of(text)) / F.lit(3.7)).cast("int")


def over_by(tokens: Column, cap: int = 512) -> Column:
    """Tokens above the cap."""
    return F.greatest(F.lit(0), tokens - cap)


def tag_prefix(text: Column) -> Column:
    """The comma-separated tags before the first full stop."""
    return F.filter(F.transform(F.split(F.substring_index(strip(text), ".", 1), ","), strip), lambda t: t != "")


def count_sentences(text: Column) -> Column:
    """Sentences of three words or more after the first full stop."""
    tail = F.element_at(F.split(text_of(text), r"\.", 2), -1)
    return F.when(F.contains(text_of(text), F.lit(".")), F.size(F.filter(F.split(tail, "[.!?]+"), lambda s: n_words(s, 3) >= 3))).otherwise(0)


def song_name(filename: Column) -> Column:
    """The title in a file name: without track number, what follows the last ' - ', white space as underscores, none of these at the ends."""
    bare = F.regexp_replace(splitext(filename)[0], rf"^{SPACE}*\d{{1,3}}{SPACE}*[-._]{SPACE}*", "")
    return F.btrim(F.regexp_replace(F.substring_index(bare, " - ", -1), f"{SPACE}+", "_"), F.lit("_"))


def split_tags(text: Column) -> Column:
    """Tags between commas, semicolons, bars or slashes."""
    return F.filter(F.transform(F.split(text_of(text), r"[,;|/]"), lambda t: F.trim(t)), lambda t: t != "")


def extract_tags(instruments: Column, custom_tag: Column, genre: Column) -> Column:
    """Instruments, custom tags and genres of a row, lower-cased."""
    parts = F.concat(F.split(text_of(instruments), ","), split_tags(custom_tag), split_tags(genre))
    return F.filter(F.transform(parts, lambda t: F.lower(F.trim(t))), lambda t: t != "")


def extract_reply(text: Column) -> Column:
    """What follows the last 'assistant'."""
    return F.trim(F.substring_index(text_of(text), "assistant", -1))


def log_tail(text: Column, most: int = 6000) -> Column:
    """The last characters, behind an ellipsis if some were cut."""
    return F.when(F.char_length(text_of(text)) > most, F.concat(F.lit("…"), F.right(text, F.lit(most)))).otherwise(text_of(text))


def is_access_token(text: Column) -> Column:
    return F.trim(text_of(text)).startswith("KGAT_")


def mime_of(path: Column) -> Column:
    """The MIME type of an audio file, by its suffix; that of MP3 for others."""
    # Suffixes and their types.
    kinds = {"wav": "audio/wav", "mp3": "audio/mpeg", "flac": "audio/flac", "ogg": "audio/ogg", "m4a": "audio/mp4", "aac": "audio/aac", "wma": "audio/x-ms-wma"}
    table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return F.coalesce(table[F.lower(F.regexp_extract(text_of(path), r"[^/]\.([^./]+)$", 1))], F.lit("audio/mpeg"))


def parse_clock(text: Column) -> Column:
    """Seconds of '90', '90s', 'm:ss' or 'h:mm:ss', rounded half-even; 0 if blank, null if it can't be read."""
    bare = F.regexp_replace(F.trim(text_of(text)), "[sS]$", "")
    parts = F.transform(F.split(bare, ":"), lambda p: p.try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p)
    return F.when(bare == "", 0).when(F.size(parts) <= 3, F.bround(total).cast("int"))


def slug_problem(text: Column) -> Column:
    """Why an owner/slug is refused; null if it may be one, or is blank, which is a choice too."""
    # Owners that are placeholders.
    placeholders = ["me", "you", "user", "owner", "username", "your-username", "yourname", "someone", "example"]
    bare = strip(text)
    parts = F.transform(F.split(bare, "/", -1), strip)
    return F.when(bare == "", None).when((F.size(parts) != 2) | F.array_contains(parts, ""), "must be owner/slug").when(F.lower(F.get(parts, F.lit(0))).isin(placeholders), "placeholder owner")
