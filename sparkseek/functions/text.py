"""Text scalars as Column expressions: everything here stays inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letter pairs and characters that optical reading confuses, and plain Latin letters.
LOOKALIKE_PAIRS = (("rn", "m"), ("vv", "w"), ("cl", "d"))
LOOKALIKE_FROM = "01il|!5$8"
LOOKALIKE_TO = "olllllssb"
ACCENTED = {
    "a": "àáâãäåā",
    "c": "çćč",
    "e": "èéêëēėę",
    "i": "ìíîïī",
    "n": "ñń",
    "o": "òóôõöøō",
    "u": "ùúûüū",
    "y": "ýÿ",
    "s": "šś",
    "z": "žźż",
    "l": "ł",
    "d": "đ",
}
UPPER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_ASCII = "abcdefghijklmnopqrstuvwxyz"

# Patterns of things a reader can act on.
TOP_DOMAINS = "com net org io dev app ai co in me gg xyz edu gov info so sh tv ly uk us de".split()
EMAIL_PATTERN = r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b"
URL_PATTERN = rf"""\bhttps?://[^\s<>"'`]+|\b(?:www\.)?[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.(?:{"|".join(TOP_DOMAINS)})(?:/[^\s<>"'`]*)?"""
CODE_HINT_PATTERN = r"\b(code|otp|one[- ]time|verification|passcode|pin|2fa|security)\b"
CODE_PATTERN = r"\b(?:[A-Z]-)?\d{4,8}\b"
PHONE_PATTERN = r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,5}(?:[ .-]\d{2,5}){1,3}|\+\d{10,13}\b"
DATE_PATTERN = r"^\d{1,4}[.-]\d{1,2}[.-]\d{1,4}$"
HEX_COLOR_PATTERN = r"#(?:[0-9a-f]{6}|[0-9a-f]{3})\b"
MAX_ACTIONS = 16

ALNUM = r"\p{IsAlphabetic}\p{N}"
ACTION = "struct<kind: string, value: string>"


def ascii_lower(s: Column) -> Column:
    """Only A-Z in lower case, as the catalog's own comparisons fold."""
    return F.translate(s, UPPER_ASCII, LOWER_ASCII)


def strip_accents(s: Column) -> Column:
    accents = "".join(ACCENTED.values())
    return F.translate(s, accents, "".join(plain * len(marked) for plain, marked in ACCENTED.items()))


def _paired(s: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), LOOKALIKE_PAIRS, F.lower(s))


def fold(s: Column) -> Column:
    """One form for all readings of a word that look alike."""
    return F.translate(strip_accents(_paired(s)), LOOKALIKE_FROM, LOOKALIKE_TO)


def folded_length(s: Column) -> Column:
    """The length of fold(s): only the pairs make a text shorter, the rest goes letter by letter."""
    return F.length(_paired(s))


def words(s: Column) -> Column:
    """Lower-case words of three letters or digits or more."""
    return F.transform(F.filter(F.split(F.coalesce(s, F.lit("")), f"[^{ALNUM}]+"), lambda w: F.length(w) >= 3), F.lower)


def literal(term: str) -> str:
    """The term as a regular expression that matches it alone."""
    return r"\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"


def overlaps_itself(term: str) -> bool:
    return any(term[:i] == term[-i:] for i in range(1, len(term)))


def has_word(text: Column, term: str) -> Column:
    """True if the lower-case text has the term with no letter or digit on either side.

    Occurrences are tried one after another without overlap, so a term that overlaps itself is
    searched by taking out earlier occurrences.
    """
    if not overlaps_itself(term):
        return text.rlike(f"(?<![{ALNUM}]){literal(term)}(?![{ALNUM}])")
    pieces = F.split(text, literal(term))
    last = F.size(pieces) - 1

    def side(i: Column, at_edge: Column) -> Column:
        """What adjoins an occurrence: a piece, or where that is empty the next occurrence, if there is one."""
        return F.when(F.get(pieces, i) != "", F.get(pieces, i)).when(at_edge, F.lit("")).otherwise(F.lit(term))

    whole = lambda i: ~side(i - 1, i == 1).rlike(f"[{ALNUM}]$") & ~side(i, i == last).rlike(f"^[{ALNUM}]")
    return F.when(text.contains(term), F.exists(F.sequence(F.lit(1), last), whole)).otherwise(F.when(text.isNotNull(), False))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes in hexadecimal; 64 if either can't be read."""
    bits = lambda s: F.conv(s, 16, -10).cast("long")
    readable = lambda s: s.rlike("^[+]?[0-9A-Fa-f]{1,16}$")
    return F.when(F.coalesce(readable(a) & readable(b), F.lit(False)), F.bit_count(bits(a).bitwiseXOR(bits(b)))).otherwise(64)


def color_name(hex_color: Column) -> Column:
    """One of twelve names for a colour written as #rrggbb; unreadable parts count as 00."""

    def channel(at: int) -> Column:
        two = F.substring(hex_color, at, 2)
        return F.when(two.rlike("^[0-9A-Fa-f]{2}$"), F.conv(two, 16, 10).cast("double")).otherwise(0.0) / 255.0

    r, g, b = channel(2), channel(4), channel(6)
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    light, spread = (high + low) / 2, high - low
    saturation = F.when(spread == 0, 0.0).otherwise(spread / F.when(1 - F.abs(2 * light - 1) == 0, 1.0).otherwise(1 - F.abs(2 * light - 1)))
    d = F.when(spread == 0, 1.0).otherwise(spread)
    sector = F.when(high == r, (g - b) / d).when(high == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    hue = F.pmod(sector * 60 + 360, F.lit(360.0))
    return (
        F.when(light < 0.12, "black")
        .when((light > 0.92) & (saturation < 0.5), "white")
        .when(saturation < 0.15, "gray")
        .when((hue < 15) | (hue >= 345), "red")
        .when((hue < 45) & (light < 0.4), "brown")
        .when(hue < 45, "orange")
        .when(hue < 70, "yellow")
        .when(hue < 165, "green")
        .when(hue < 195, "teal")
        .when(hue < 255, "blue")
        .when(hue < 290, "purple")
        .otherwise("pink")
    )


def color_tags(colors: Column) -> Column:
    """``c:<name>`` of each (hex, share) whose share is noticeable: 0.30 for black, white and gray, else 0.06."""
    named = F.transform(colors, lambda c: F.struct(color_name(c["hex"]).alias("name"), c["share"].cast("double").alias("share")))
    least = lambda c: F.when(c["name"].isin("black", "white", "gray"), 0.30).otherwise(0.06)
    return F.array_distinct(F.transform(F.filter(named, lambda c: c["share"] >= least(c)), lambda c: F.concat(F.lit("c:"), c["name"])))


def _all(text: Column, pattern: str, flags: str = "U") -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?{flags}){pattern}"), F.lit(0))


def emails(text: Column) -> Column:
    return _all(text, EMAIL_PATTERN)


def urls(text: Column) -> Column:
    """Links without closing punctuation, and without those that are the end of an e-mail address."""
    found = F.transform(_all(text, URL_PATTERN, "iU"), lambda u: F.regexp_replace(u, r"[),.;:!?\]]+$", ""))
    mails = emails(text)
    return F.filter(found, lambda u: ~F.exists(mails, lambda m: F.endswith(F.lower(m), F.lower(u))))


def codes(text: Column) -> Column:
    """Numbers of 4 to 8 digits on lines that speak of codes."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda line: line.rlike(f"(?iU){CODE_HINT_PATTERN}"))
    return F.flatten(F.transform(lines, lambda line: _all(line, CODE_PATTERN)))


def phones(text: Column) -> Column:
    """Numbers of 10 to 13 digits that are not written like a date."""
    found = F.transform(_all(text, PHONE_PATTERN), lambda p: F.trim(p))
    digits = lambda p: F.length(F.regexp_replace(p, "[^0-9]", ""))
    return F.filter(found, lambda p: digits(p).between(10, 13) & ~p.rlike(f"(?U){DATE_PATTERN}"))


def hex_colors(text: Column) -> Column:
    return F.transform(_all(text, HEX_COLOR_PATTERN, "iU"), F.lower)


#: What finds each kind of action, in order, and a cheap test that holds wherever there is one.
ACTIONS = {
    "email": (emails, lambda t: t.contains("@")),
    "url": (urls, lambda t: t.contains(".") | t.contains("://")),
    "code": (codes, lambda t: t.rlike("[0-9]{4}")),
    "phone": (phones, lambda t: t.rlike("[0-9]{2}")),
    "color": (hex_colors, lambda t: t.contains("#")),
}


def detect_actions(text: Column, kinds: tuple[str, ...] = tuple(ACTIONS)) -> Column:
    """Up to 16 distinct (kind, value) of these kinds, in the order e-mail, link, code, phone, colour."""
    t = F.coalesce(text, F.lit(""))
    named = lambda kind: lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    none = F.array().cast(f"array<{ACTION}>")
    found = F.concat(*(F.when(test(t), F.transform(f(t), named(k))).otherwise(none) for k, (f, test) in ACTIONS.items() if k in kinds))
    same = lambda a, b: (a["kind"] == b["kind"]) & (ascii_lower(a["value"]) == ascii_lower(b["value"]))
    add = lambda seen, x: F.when(F.exists(seen, lambda s: same(s, x)) | (F.size(seen) >= MAX_ACTIONS), seen).otherwise(F.concat(seen, F.array(x)))
    return F.aggregate(found, F.array().cast(f"array<{ACTION}>"), add)


def action_tags(text: Column) -> Column:
    """Sorted ``h:<kind>`` of the actions in the text, and ``h:text`` if there is any text."""
    kinds = F.array_sort(F.array_distinct(F.transform(detect_actions(text), lambda a: F.concat(F.lit("h:"), a["kind"]))))
    return F.concat(kinds, F.when(F.coalesce(text, F.lit("")) != "", F.array(F.lit("h:text"))).otherwise(F.array().cast("array<string>")))


def percent_decode(s: Column) -> Column:
    return F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))


def openable(url: Column) -> Column:
    """True for links that may be opened: http, https and mailto, and those without a scheme."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return (scheme == "") | scheme.isin("http", "https", "mailto")


def byte_size(n: Column, largest: str = "TB") -> Column:
    """A size in steps of 1000 up to the largest unit, with one decimal below ten of a unit."""
    units = ("B", "KB", "MB", "GB", "TB")
    units = units[: units.index(largest) + 1]
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(units[1:], 1):
        scaled = n / float(1000**i)
        out = F.when(n >= 1000**i, F.concat(F.when(scaled < 10, F.format_string("%.1f", scaled)).otherwise(F.format_string("%.0f", scaled)), F.lit(f" {unit}"))).otherwise(out)
    return out
