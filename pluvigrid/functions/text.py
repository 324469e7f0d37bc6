"""Place names and raw text values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pluvigrid.functions.fixed_values import NULL_TOKENS

_SPACE = r"[\s\x1c-\x1f]+"
_DECIMAL = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"
_CASED = r"\p{IsLowercase}\p{IsUppercase}\p{Lt}"


def strip_space(text: Column) -> Column:
    """Drop all leading and trailing white space, tabs and no-break spaces included."""
    return F.regexp_replace(text, f"(?U)^{_SPACE}|{_SPACE}$", "")


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(text, F.lit(f"([{_CASED}]+|[^{_CASED}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def clean_name(text: Column) -> Column:
    """Strip, then title case.

    ``initcap`` is several times cheaper and gives the same for ASCII words between
    single blanks in which no letter follows a digit or sign.
    """
    plain_words = text.rlike(r"^(?!.*[^A-Za-z ][A-Za-z])[!-~]+( [!-~]+)*$")
    return F.when(plain_words, F.initcap(text)).otherwise(title_case(strip_space(text)))


def null_tokens(text: Column) -> Column:
    """NULL for every spelling of a missing value."""
    return F.when(~text.isin(*NULL_TOKENS), text)


def parse_amount(text: Column) -> Column:
    """Text to DOUBLE; NULL for missing tokens and for text that is no plain decimal number.

    A cast alone would also take Java's spellings: ``3d``, ``2f`` and hexadecimal.
    """
    token = null_tokens(text)
    return F.when(token.rlike(_DECIMAL), token.try_cast("double"))


def parse_amount_strict(text: Column) -> Column:
    """Like :func:`parse_amount`, but text that is no number stops the job."""
    parsed = parse_amount(text)
    bad = null_tokens(text).isNotNull() & parsed.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit("not a number: "), text)).cast("double")).otherwise(parsed)
