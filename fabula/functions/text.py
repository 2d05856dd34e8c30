"""Text functions of book ingestion as column expressions.

Offsets and lengths count code points. White space is what Unicode calls so, as
far as it occurs in books: an explicit class, since Java's ``\\s`` and ``trim`` know
ASCII only. NFC and NFKC need a function of Python's, which sees no plain ASCII.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: The titles that start a chapter. A word border is one between ASCII word
#: characters and others, so a Cyrillic numeral word needs a following sign or digit.
CHAPTER_PATTERNS = (
    r"^(chapter|part|book)[\s\u00a0]+([ivxlcdm]+|\d+|one|two|three|four|five|six|seven|eight|nine|ten)(?![A-Za-z0-9_])[\s\u00a0:.-]*(.*)$",
    r"^(глава|часть)[\s\u00a0]+([ivxlcdm]+(?![A-Za-z0-9_])|\d+(?![A-Za-z0-9_])|[а-яё]+(?=[A-Za-z0-9_]))[\s\u00a0:.-]*(.*)$",
    r"^\d{1,3}[\s\u00a0.:-]+[^\n]{1,120}$",
)
#: Fixed value: one form of address before a name.
HONORIFIC = r"(?i)^(mr|mrs|ms|miss|dr|sir|lady|lord)\.?\s+"
#: Place nouns that a loose location key leaves out.
PLACE_NOUNS = "city|park|square|street|district|building|room|apartment"
#: Russian endings, tried in this order.
STEM_SUFFIXES = "ами ями ого ему ыми ими ах ях ом ем ой ый ий ая ое ые ов ев а у е ы и".split()
#: Relative time markers in the order in which they are tried.
MARKERS = (
    ("childhood", ("childhood", "детств")),
    ("next_day", ("next day", "следующ")),
    ("year_later", ("year later", "через год")),
    ("before", ("before", "до ")),
    ("after", ("after", "после")),
)
#: How far each marker moves an event.
MARKER_WEIGHTS = {"childhood": -1_000_000, "before": -100, "same_time": 0, "next_day": 10, "after": 50, "year_later": 365}


def _unicode_form(form: str):
    @F.arrow_udf("string")
    def convert(s: pa.Array) -> pa.Array:
        return pa.array([x if x is None or unicodedata.is_normalized(form, x) else unicodedata.normalize(form, x) for x in s.to_pylist()], pa.string())

    return convert


#: Characters that a normal form leaves as they are, whatever stands beside them: Latin, Cyrillic and
#: punctuation. Only what has others goes to Python.
_STABLE = {
    "NFC": r"\x00-\u02ff\u0400-\u0482\u048a-\u052f\u2010-\u2027\u2030-\u205e\u20ac\u2116",
    "NFKC": r"\x00-\x7f\u00a1-\u00a7\u00a9\u00ab\u00ac\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0400-\u0482\u048a-\u052f\u2018-\u201f\u20ac",
}


def unicode_normalize(text: Column, form: str = "NFC") -> Column:
    """``text`` in a Unicode normal form. Python sees a null in place of what is normal by its
    characters alone."""
    other = F.when(text.rlike(f"[^{_STABLE[form]}]"), text)
    return F.coalesce(_unicode_form(form)(other), text)


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def collapse_ws(text: Column) -> Column:
    return F.regexp_replace(text, f"{WS}+", " ")


#: The same white space as single characters, for trimming without a pattern; within a line, without its end.
_BLANKS = " \t\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def normalize_book_text(text: Column, nfc: bool = True) -> Column:
    """Composed characters, one kind of line end, single spaces, at most one blank line in a
    row, trimmed lines. Lines are trimmed after blank lines are reduced. A pattern only matches
    what it changes: a single space between words is left alone."""
    t = unicode_normalize(text) if nfc else text
    t = F.replace(t, F.lit("\x00"), F.lit(""))
    t = F.when(F.contains(t, F.lit("\r")), F.regexp_replace(t, r"\r\n?", "\n")).otherwise(t)
    t = F.regexp_replace(t, r"[\t\f\x0b\u00a0][ \t\f\x0b\u00a0]*| [ \t\f\x0b\u00a0]+", " ")
    t = F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)
    t = F.array_join(F.transform(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(_BLANKS))), "\n")
    return F.btrim(t, F.lit(_BLANKS + "\n"))


def strip_xml_tags(html: Column) -> Column:
    """Scripts, styles and tags become spaces; six entities are decoded in this order."""
    t = F.regexp_replace(html, r"(?is)<script.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style.*?</style>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        t = F.replace(t, F.lit(entity), F.lit(plain))
    return t


def is_chapter_title(line: Column) -> Column:
    fits = F.length(line).between(3, 140)
    first, second, third = CHAPTER_PATTERNS
    return fits & (line.rlike("(?i)" + first) | line.rlike("(?iu)" + second) | line.rlike(third))


def may_be_chapter_title(line: Column) -> Column:
    """True for every title, white space around it included, and cheaper to tell."""
    return line.rlike(f"(?iu)^{WS}*+(?:chapter|part|book|глава|часть|[0-9])")


def parse_absolute_date(value: Column) -> Column:
    """A date with or without a time and an offset; null for what isn't one."""
    return F.try_to_timestamp(F.when(trim_ws(value) != "", trim_ws(value)))


def char_code_sum(text: Column) -> Column:
    """The sum of the code points, which begins a seed."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda s, c: s + F.ascii(c))


def progress_percent(done: Column, total: Column) -> Column:
    """Whole percent after ``done`` (from 0) of ``total`` steps, halves up."""
    return F.floor((done + 1) / total * 100 + 0.5).cast("long")


def scene_title(text: Column) -> Column:
    """Single spaces, 80 characters at most, the last three of a longer one being dots."""
    t = trim_ws(collapse_ws(text))
    return F.when(F.length(t) > 80, F.concat(F.substring(t, 1, 77), F.lit("..."))).otherwise(t)


def storage_key(project: Column, scene: Column, seed: Column, media_type: Column) -> Column:
    extension = F.when(media_type == "image/jpeg", "jpg").otherwise("png")
    return F.concat_ws("/", F.lit("scenes"), project.cast("string"), scene.cast("string"), F.concat(seed.cast("string"), F.lit("."), extension))


def json_text(value: Column, is_string: bool = False) -> Column:
    """A string as it is, any other value as JSON without blanks, its fields in their order."""
    return value if is_string else F.to_json(value)


def graph_value(value: Column, kind: str) -> Column:
    """What a graph's property may hold: times as ISO text in UTC, structures as JSON."""
    if kind in ("timestamp", "date"):
        return F.date_format(F.to_utc_timestamp(value.cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.to_json(value) if kind.startswith(("struct", "map", "array")) else value.cast("string")


def token_estimate(text: Column, chars_per_token: int = 4) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / chars_per_token)).cast("long")


def uuid_from_sha256(text: Column) -> Column:
    """The first 128 bits of the SHA-256 with the marks of a version 4 UUID."""
    h = F.sha2(text, 256)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def slugify(text: Column, most: int = 140) -> Column:
    t = F.regexp_replace(F.lower(text), "['\"]", "")
    t = F.regexp_replace(t, "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(t, "^-+|-+$", ""), 1, most)


def normalize_text(value: Column, nfc: bool = True) -> Column:
    v = unicode_normalize(value) if nfc else value
    return collapse_ws(F.lower(trim_ws(v)))


def normalize_name(name: Column, nfc: bool = True) -> Column:
    """For characters: without one leading honorific."""
    v = F.lower(trim_ws(unicode_normalize(name) if nfc else name))
    return collapse_ws(F.regexp_replace(v, HONORIFIC, ""))


def has_honorific(name: Column) -> Column:
    return trim_ws(name).rlike(HONORIFIC)


def loose_location_key(name: Column) -> Column:
    t = F.regexp_replace(normalize_text(name), r"^the\s+", "")
    t = F.regexp_replace(t, rf"(?<![A-Za-z0-9_])({PLACE_NOUNS})(?![A-Za-z0-9_])", "")
    return F.trim(collapse_ws(t))


def last_word(name: Column) -> Column:
    return F.element_at(F.split(name, " "), -1)


def classify_marker(marker: Column) -> Column:
    low = F.lower(marker)
    out = F.lit("unknown")
    for label, words in reversed(MARKERS):
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        out = F.when(hit, F.lit(label)).otherwise(out)
    return F.when(marker.isNotNull() & (marker != ""), out)


def marker_weight(hint: Column) -> Column:
    out = F.lit(0)
    for label, weight in MARKER_WEIGHTS.items():
        out = F.when(hint == label, F.lit(weight)).otherwise(out)
    return out.cast("long")


def scene_text(value: Column) -> Column:
    """Lower case, only letters, digits, spaces and hyphens, single spaces."""
    return F.trim(F.regexp_replace(F.lower(value), r"[^a-z0-9\p{L}\p{N}-]+", " "))


def stem_token(token: Column) -> Column:
    """Without the first ending that leaves more than three letters; as longer endings come
    first, that is the longest. What doesn't end in a Cyrillic letter has none."""
    ending = "|".join(STEM_SUFFIXES)
    return F.when(token.rlike("[а-яё]$"), F.regexp_replace(token, rf"^(.{{4,}}?)(?:{ending})$", "$1")).otherwise(token)


def contains_phrase(text: Column, phrase: Column) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))


#: Fixed value: words that begin with a capital and have two letters at least, side by side.
CAPITALIZED = r"(?:^|[^\p{L}\p{N}_])(\p{Lu}[\p{L}\p{N}-]+(?:\s+\p{Lu}[\p{L}\p{N}-]+)*)"


def capitalized_mentions(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CAPITALIZED), 1))


def embedding_tokens(text: Column, nfkc: bool = True) -> Column:
    t = F.lower(text)
    t = unicode_normalize(t, "NFKC") if nfkc else t
    return F.filter(F.split(t, r"[^\p{L}\p{N}]+"), lambda x: F.length(x) > 1)
