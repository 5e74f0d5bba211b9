"""Text functions as Column expressions. Patterns keep to what Java, RE2 and Python read alike."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that all dialects here read alike.
WHITE = r"[ \t\n\r\f\x0B]"

# Headers and footers, in the order of removal; case is ignored and lines are anchored.
BOILERPLATE = (
    rf"^{WHITE}*confidential{WHITE}*$",
    rf"^{WHITE}*proprietary{WHITE}*$",
    rf"\b(copyright|©|\(c\))\b.{{0,100}}?(?:19[0-9]{{2}}|20[0-9]{{2}})(?:{WHITE}*[-–—]{WHITE}*(?:19[0-9]{{2}}|20[0-9]{{2}}))?",
    rf"^{WHITE}*all rights reserved\b{WHITE}*",
    rf"\n+{WHITE}*Sent from my.*?$",
    r"\.{5,}",
    rf"\n+--{WHITE}*\n.*$",
)

# Words that don't add to a segment's rank.
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "with", "by")

# Languages that translation knows, by code.
LANGUAGES = {
    "ar": "Arabic",
    "cs": "Czech",
    "da": "Danish",
    "en": "English",
    "et": "Estonian",
    "fi": "Finnish",
    "fr": "French",
    "de": "German",
    "el": "Greek",
    "he": "Hebrew",
    "hu": "Hungarian",
    "it": "Italian",
    "lv": "Latvian",
    "lt": "Lithuanian",
    "no": "Norwegian",
    "fa": "Persian",
    "pl": "Polish",
    "pt": "Portuguese",
    "ro": "Romanian",
    "ru": "Russian",
    "sk": "Slovak",
    "es": "Spanish",
    "sv": "Swedish",
    "zh": "Chinese",
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(x: Column | str) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(_c(x), r"\s+", " "))


def normalized(x: Column | str) -> Column:
    return F.lower(collapse(x))


def single_line(x: Column | str) -> Column:
    return F.replace(_c(x), F.lit("\n"), F.lit(" "))


def clean_scanned(x: Column | str) -> Column:
    """Long dashes and underscores of scanned text, then white space."""
    return collapse(F.translate(_c(x), "—_", "- "))


def strip_lines(x: Column | str, patterns: Iterable[str] = BOILERPLATE, custom: Iterable[str] = ()) -> Column:
    """Whatever matches a pattern goes, pattern by pattern; case is ignored and only a line feed ends a line."""
    out = _c(x)
    for p in (*patterns, *custom):
        out = F.regexp_replace(out, f"(?imd){p}", "")
    return out


def language_name(code: Column | str) -> Column:
    """The name of a language code, or empty."""
    names = F.create_map(*[F.lit(v) for pair in LANGUAGES.items() for v in pair])
    return F.coalesce(names[_c(code)], F.lit(""))


def compression_ratio(before: Column | str, after: Column | str) -> Column:
    """Length after by length before; 1 for empty text."""
    b, a = F.length(_c(before)), F.length(_c(after))
    return F.when(b > 0, a / b).otherwise(1.0)


def words(x: Column | str) -> Column:
    """Lower-cased runs of visible characters."""
    return F.filter(F.split(F.lower(_c(x)), r"\s+"), lambda w: w != "")


def first_tokens(x: Column | str, n: int) -> Column:
    """The first ``n`` runs of visible characters, joined by spaces."""
    return F.array_join(F.slice(F.filter(F.split(_c(x), r"\s+"), lambda w: w != ""), 1, n), " ")


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` evaluated once, also where ``f`` uses it inside a lambda."""
    return F.transform(F.array(x), f)[0]


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct runs of ``n`` tokens; the distinct tokens if there are fewer."""
    return bind(tokens, lambda t: _ngrams(t, n))


def tokens(text: str) -> list[str]:
    """Lower-cased words between white space, in Python."""
    return text.lower().split()


def runs(words: list[str], n: int) -> Iterator[str]:
    """The runs of ``n`` words, in Python; none where there are fewer."""
    return map(" ".join, zip(*(words[i:] for i in range(n))))


def _ngrams(tokens: Column, n: int) -> Column:
    size = F.size(tokens)
    many = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.array_distinct(F.when(size >= n, many).otherwise(tokens))


def overlap(a: Column, b: Column) -> Column:
    """Shared members by the smaller set; 1 if both are empty, 0 if one is."""
    sizes = F.struct(F.size(F.array_distinct(a)).alias("x"), F.size(F.array_distinct(b)).alias("y"))
    return bind(sizes, lambda s: F.when((s["x"] == 0) & (s["y"] == 0), 1.0).when((s["x"] == 0) | (s["y"] == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(s["x"], s["y"])))


def segment_rank(x: Column | str) -> Column:
    """Length, weighted by how many of the words aren't stop words; not yet divided by the largest."""
    length = F.length(_c(x))

    def rank(tokens: Column) -> Column:
        content = F.size(F.filter(tokens, lambda w: ~w.isin(list(STOP_WORDS))))
        return F.when(F.size(tokens) > 0, 0.7 * length + 0.3 * (content / F.size(tokens)) * length).otherwise(0.7 * length)

    return bind(F.regexp_extract_all(F.lower(_c(x)), F.lit(r"(?U)(\w+)"), F.lit(1)), rank)


def extension(path: Column | str) -> Column:
    """Lower-cased extension with its dot, or empty."""
    return F.lower(F.regexp_extract(_c(path), r"(\.[^./]+)$", 1))


def placeholders(x: Column | str) -> Column:
    """Distinct names in braces, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(_c(x), F.lit(r"\{([A-Za-z0-9_]+)\}"), F.lit(1)))


def between_markers(x: Column | str, start: str = "### Question:", stop: str = "### Answer:") -> Column:
    """What stands after ``start`` and before ``stop`` or the end, trimmed; null without ``start``."""
    found = F.regexp_extract(_c(x), f"(?s){start}(.*?)(?:{stop}|$)", 1)
    return F.when(F.contains(_c(x), F.lit(start)), F.trim(F.regexp_replace(found, r"^\s+|\s+$", "")))


def title(x: Column | str, most: int = 30) -> Column:
    return F.substring(_c(x), 1, most)


def milliseconds(start: Column | str, end: Column | str) -> Column:
    """Whole milliseconds from start to end; 0 if either is null."""
    micros = F.unix_micros(_c(end).cast("timestamp")) - F.unix_micros(_c(start).cast("timestamp"))
    return F.coalesce((micros / 1000).cast("long"), F.lit(0).cast("long"))


# The RFC 4122 namespaces of names.
NAMESPACES = {"dns": "6ba7b8109dad11d180b400c04fd430c8", "url": "6ba7b8119dad11d180b400c04fd430c8"}


def name_uuid(x: Column | str, namespace: str = "dns") -> Column:
    """The version 5 UUID of a name in a namespace (RFC 4122): equal names, equal ids."""
    h = F.lower(F.sha1(F.concat(F.unhex(F.lit(NAMESPACES[namespace])), _c(x).cast("binary"))))
    variant = F.lower(F.conv(F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 8, 10, 16))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def epoch_seconds(x: Column | str) -> Column:
    """Seconds since 1970, with fractions, of a timestamp."""
    return F.unix_micros(_c(x).cast("timestamp")) / 1e6


def setting(x: Column | str) -> Column:
    """A setting's text as (number, flag, text): quotes around it go; digits are a number, true and false a flag."""
    bare = F.regexp_replace(F.trim(_c(x)), "^([\"'])(.*)\\1$", "$2")
    number = F.when(bare.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), bare.cast("double"))
    flag = F.when(F.lower(bare).isin("true", "false"), F.lower(bare) == "true")
    return F.struct(number.alias("number"), flag.alias("flag"), F.when(number.isNull() & flag.isNull(), bare).alias("text"))


def strip_links(x: Column | str) -> Column:
    """Markdown links to their text; asterisks at the ends go."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"\[([^\[\]]+)\]\([^)]+\)", "$1"), r"^\*+|\*+$", "")


def slide_headings(x: Column | str) -> Column:
    """Headings one level down, slide comments to headings of the first level."""
    lower = F.regexp_replace(_c(x), r"(?m)^(#{1,6})", "#$1")
    return F.regexp_replace(lower, r"<!-- Slide number: ([0-9]+) -->", "# Slide $1")


def drop_picture_marks(x: Column | str) -> Column:
    """Marks that stand for omitted pictures of a converted page."""
    return F.trim(F.regexp_replace(_c(x), r"==> picture \[[0-9]+ x [0-9]+\][^<\n]*<==", ""))


def stream_tokens(x: Column | str) -> Column:
    """Pieces as a generator would send them: a word and the white space after it."""
    return F.regexp_extract_all(_c(x), F.lit(r"(\S+\s?)"), F.lit(1))


def flushed_sentences(x: Column | str) -> Column:
    """Parts that end at a stop mark, as a speech queue would flush them; the rest is a part."""
    return F.filter(F.regexp_extract_all(_c(x), F.lit("([^.?!。，！]*[.?!。，！]|[^.?!。，！]+$)"), F.lit(1)), lambda p: F.trim(p) != "")
