"""Text matching as JVM-side column expressions.

Offsets and lengths are in characters (code points), never UTF-16 units or bytes.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from echolens.fixed import DOMAIN_RULES

WORD = r"[\p{L}\p{N}_]"
SPACES = (r"\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
          r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
URL = rf"(?iu)https?://[^{SPACES})\],\"'<>]+"
HOST = r"(?iu)^https?://([^/?#]*)"

# Letters whose case variants the upper-case mapping alone would keep apart.
_FOLD_FROM, _FOLD_TO = "İẞϴΩKÅͅ", "ißθωkåι"


def strip_spaces(text: Column) -> Column:
    """Remove white space of any kind from both ends (``trim`` only knows the blank)."""
    return F.regexp_replace(text, rf"^[{SPACES}]+|[{SPACES}]+\z", "")


def fold(text: Column) -> Column:
    """Case-insensitive form: equal for any two strings the term pattern treats as equal."""
    # Translating is slow, and very few texts hold one of the letters: none that are plain ASCII.
    plain = F.octet_length(text) == F.char_length(text)
    special = reduce(Column.__or__, [F.contains(text, F.lit(letter)) for letter in _FOLD_FROM])
    return F.upper(F.when(plain | ~special, text).otherwise(F.translate(text, _FOLD_FROM, _FOLD_TO)))


def term_pattern(term: Column) -> Column:
    """Whole-word, case-insensitive pattern of a literal term.

    The word class is spelled out because the engine's own boundary depends on the JDK. A term that starts
    or ends with a non-word character needs a word character next to it there, as a boundary does. The
    literal comes first, so most positions of a text fail on one character.
    """
    body = F.regexp_replace(term, r"([^\p{L}\p{N}_\s])", r"\\$1")
    left = F.concat(F.when(term.rlike(f"^{WORD}"), "(?<!").otherwise("(?<="), F.lit(WORD), body, F.lit(")"))
    right = F.when(term.rlike(f"{WORD}\\z"), f"(?!{WORD})").otherwise(f"(?={WORD})")
    return F.concat(F.lit("(?iu)"), body, left, right)


def snippet(text: Column, offset: Column, length: Column, around: int = 100) -> Column:
    start = F.greatest(offset - around, F.lit(0))
    return strip_spaces(F.substring(text, start + 1, offset + length + around - start))


def extract_urls(text: Column) -> Column:
    """Distinct URLs in order of first appearance, trailing punctuation removed."""
    raw = F.regexp_extract_all(text, F.lit(URL), F.lit(0))
    return F.array_distinct(F.transform(raw, lambda u: F.rtrim(u, F.lit(".,;)"))))


def url_domain(url: Column, strict_www: bool = False) -> Column:
    """Lower-cased host part with port; by default any leading ``w`` and ``.`` are removed one by one."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    if strict_www:
        return F.regexp_replace(host, r"^www\.", "")
    return F.ltrim(host, F.lit("w."))


def classify_domain(domain: Column) -> Column:
    chain = None
    for name, pattern in DOMAIN_RULES:
        hit = domain.rlike(f"(?iu){pattern}")
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    two_parts = F.size(F.split(F.ltrim(domain, F.lit("w.")), r"\.", -1)) == 2
    return chain.when(two_parts, "brand_owned").when(domain.isNotNull(), "other")
