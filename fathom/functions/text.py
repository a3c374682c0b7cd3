"""Scalar text functions as Column expressions: normalisation, language, and the analysis of a query string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, spelled out so that Java and RE2 agree on it.
WHITE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same characters, one by one.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
POINTS = r"[\x{591}-\x{5BD}\x{5BF}\x{5C1}\x{5C2}\x{5C4}\x{5C5}\x{5C7}]"
ACCENTS = r"[\x{591}-\x{5AF}]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that mark Aramaic whatever they end with.
ARAMAIC = ("די", "קא", "לאו", "הכי", "האי")
ALEF = "א"

EXACT, SHORT, CONCEPTUAL, MIXED, UNKNOWN = "ExactReference", "Short", "Conceptual", "Mixed", "Unknown"
ALPHA = {EXACT: 0.85, SHORT: 0.7, MIXED: 0.5, CONCEPTUAL: 0.3, UNKNOWN: 0.5}
RARE_CHARS = 5


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, f) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def strip_points(x: Column | str) -> Column:
    """Without Hebrew vowel points and accents."""
    return F.regexp_replace(_col(x), POINTS, "")


def strip_accents(x: Column | str) -> Column:
    """Without cantillation marks."""
    return F.regexp_replace(_col(x), ACCENTS, "")


def collapse(x: Column | str) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.regexp_replace(F.regexp_replace(_col(x), f"{WHITE}+", " "), "^ | $", "")


def unicode_trim(x: Column | str) -> Column:
    """Without white space at the ends, which is all that is looked at: a pattern would try every character between them."""
    return F.btrim(_col(x), F.lit(BLANKS))


def normalize(x: Column | str) -> Column:
    """Marks stripped, geresh and gershayim as ASCII quotes, white space collapsed."""
    return collapse(F.translate(strip_accents(strip_points(x)), "׳״", "'\""))


def normalize_for_cache(x: Column | str) -> Column:
    """normalize, with ASCII letters in lower case; other letters keep their case."""
    return F.translate(normalize(x), UPPER, LOWER)


def truncate_chars(x: Column | str, n: int) -> Column:
    return F.substring(_col(x), 1, n)


def words(x: Column | str) -> Column:
    """Tokens between white space; none for a blank text."""
    c = collapse(x)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def detect_language(x: Column | str) -> Column:
    """Hebrew, Aramaic, Mixed or Other, by the shares of Hebrew and ASCII letters among all letters."""
    x = _col(x)
    letters = F.regexp_count(x, F.lit(r"\p{L}"))
    hebrew = F.regexp_count(x, F.lit(r"[\x{5D0}-\x{5EA}]"))
    latin = F.regexp_count(x, F.lit("[A-Za-z]"))
    w = words(x)
    ends = F.size(F.filter(w, lambda t: t.endswith(ALEF) & (F.octet_length(t) > 2)))
    known = F.size(F.filter(w, lambda t: t.isin(*ARAMAIC)))
    signs = ends + known
    return (
        F.when(x.isNull() | (letters == 0), "Other")
        .when((latin > 0) & (hebrew > 0), "Mixed")
        .when(hebrew / letters > 0.8, F.when((signs > 1) | ((signs > 0) & (F.size(w) <= 3)), "Aramaic").otherwise("Hebrew"))
        .otherwise("Other")
    )


def query_language(x: Column | str) -> Column:
    """hebrew, mixed or other: the coarser rule of query analysis."""
    hebrew = _col(x).rlike(r"[\x{590}-\x{5FF}]")
    latin = _col(x).rlike("[A-Za-z]")
    return F.when(hebrew & ~latin, "hebrew").when(hebrew & latin, "mixed").otherwise("other")


def quoted_phrases(x: Column | str) -> Column:
    """Texts between a quote and the next; trimmed, blanks dropped, an unterminated one ignored."""
    parts = F.split(_col(x), '"')
    inside = F.filter(parts, lambda p, i: (i % 2 == 1) & (i < F.size(parts) - 1))
    return F.filter(F.transform(inside, unicode_trim), lambda p: p != "")


def rare_tokens(x: Column | str) -> Column:
    """Tokens of more than five characters, in order, with repeats."""
    return F.filter(words(x), lambda t: F.char_length(t) > RARE_CHARS)


def has_quote(x: Column | str, requires_pair: bool = False) -> Column:
    """Whether there is a quote; requires_pair: whether a phrase is quoted, so that a lone mark of abbreviation isn't taken for one."""
    return F.size(quoted_phrases(x)) > 0 if requires_pair else F.contains(_col(x), F.lit('"'))


def _type_of(w: Column, quoted: Column) -> Column:
    digit = F.exists(w, lambda t: t.rlike("[0-9]"))
    kind = lambda n: F.when(n == 0, UNKNOWN).when(quoted, EXACT).when(n <= 2, F.when(digit, EXACT).otherwise(SHORT)).when(n >= 5, CONCEPTUAL).otherwise(MIXED)
    return kind(F.size(w))


def query_type(x: Column | str, requires_pair: bool = False) -> Column:
    return let(words(x), lambda w: _type_of(w, has_quote(x, requires_pair)))


def alpha(x: Column | str, requires_pair: bool = False) -> Column:
    """Weight of the lexical side: 1 for a quoted query, else by its type."""
    by_type = F.create_map(*[F.lit(v) for kv in ALPHA.items() for v in kv])
    return let(query_type(x, requires_pair), lambda kind: F.when((kind == EXACT) & has_quote(x, requires_pair), 1.0).otherwise(F.element_at(by_type, kind)))


def query_features(x: Column | str, requires_pair: bool = False) -> Column:
    """All features of a query as a struct."""
    quoted = has_quote(x, requires_pair)

    def of(w: Column) -> Column:
        n = F.size(w)
        total = F.aggregate(w, F.lit(0), lambda a, t: a + F.char_length(t))
        return F.struct(
            n.alias("token_count"),
            quoted.alias("has_quoted_phrase"),
            F.when(n > 0, total / n).otherwise(F.lit(0.0)).alias("avg_token_length"),
            _type_of(w, quoted).alias("estimated_type"),
            F.exists(w, lambda t: t.rlike("[0-9]")).alias("has_numbers"),
            query_language(x).alias("detected_language"),
            F.filter(w, lambda t: F.char_length(t) > RARE_CHARS).alias("rare_tokens"),
            quoted_phrases(x).alias("quoted_phrases"),
        )

    return let(words(x), of)
