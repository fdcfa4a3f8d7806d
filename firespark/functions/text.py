"""Text normalisation without Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower-case accented letters and what they fold to.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"

# Words that stay lower-case inside a place name.
PARTICLES = ("de", "del", "la", "las", "el", "los", "y", "e", "a", "al")

# Accented province names.
PROVINCES = {
    "avila": "Ávila", "leon": "León", "burgos": "Burgos", "palencia": "Palencia",
    "salamanca": "Salamanca", "segovia": "Segovia", "soria": "Soria",
    "valladolid": "Valladolid", "zamora": "Zamora",
}


BLANKS = " \t\n\r\f\v"


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only spaces."""
    return F.btrim(text, F.lit(BLANKS))


def fold(text: Column) -> Column:
    """Lower-case, trimmed and without accents; also drops combining marks."""
    plain = F.translate(F.lower(text), ACCENTED, PLAIN)
    return strip(F.regexp_replace(plain, "[\\u0300-\\u036f]", ""))


def blank_to_null(text: Column) -> Column:
    return F.when(strip(text) != "", strip(text))


def lookup(table: dict, key: Column, default: Column | None = None) -> Column:
    """Small fixed dictionary as one CASE chain; unknown keys give ``default``."""
    expr = F.lit(None) if default is None else default
    chain = None
    for k, v in table.items():
        chain = F.when(key == k, F.lit(v)) if chain is None else chain.when(key == k, F.lit(v))
    return chain.otherwise(expr)


def first_matching(text: Column, needles: dict[str, str], default: str) -> Column:
    """Value of the first needle contained in the lower-cased text."""
    low = F.lower(F.trim(text))
    chain = F.when(text.isNull() | (text == ""), F.lit(default))
    for needle, value in needles.items():
        chain = chain.when(low.contains(needle), F.lit(value))
    return chain.otherwise(F.lit(default))


def _capitalised(token: Column) -> Column:
    # One letter may become two when raised; only the first stays a capital.
    head = F.upper(F.substring(token, 1, 1))
    return F.concat(F.substring(head, 1, 1), F.lower(F.substr(head, F.lit(2))), F.lower(F.substr(token, F.lit(2))))


def place_name(text: Column) -> Column:
    """Proper case: particles stay low unless first, hyphen parts are capitalised."""
    words = F.filter(F.split(F.lower(strip(text)), "\\s+"), lambda w: w != "")

    def cased(word: Column, position: Column) -> Column:
        parts = F.transform(F.split(word, "-"), _capitalised)
        return F.when((position > 0) & word.isin(*PARTICLES), word).otherwise(
            F.array_join(parts, "-")
        )

    return blank_to_null(F.array_join(F.transform(words, cased), " "))


def province_name(text: Column) -> Column:
    known = lookup(PROVINCES, F.lower(F.trim(text)))
    return F.when(F.length(text) > 0, F.coalesce(known, place_name(text)))


def number(text: Column) -> Column:
    """Safe numeric coercion."""
    return text.try_cast("double")


def fixed3(value: Column) -> Column:
    """Three decimals, half-even on the exact binary value."""
    return F.replace(F.format_number(value, 3), F.lit(","), F.lit(""))


def kilovolts(text: Column) -> Column:
    """First voltage of a ``;`` list in whole kV, 0 when it is not a number."""
    first = F.trim(F.split(F.coalesce(text, F.lit("")), ";")[0])
    return F.when(
        first.rlike("^[0-9]+$"), F.floor(first.try_cast("long") / 1000).cast("long")
    ).otherwise(F.lit(0).cast("long"))


def code_prefix(text: Column) -> Column:
    return F.trim(F.split(text, ";")[0])
