"""Text rules used by the mining stages, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the mining scripts strip it (all Unicode white space and the four separators), and float syntax.
_WS = r"[\s\x1c-\x1f]"
_STRIP = rf"(?U)\A{_WS}+|{_WS}+\z"
_FLOAT = r"(?i)\A[+-]?(?:(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:e[+-]?\d(?:_?\d)*)?|inf|infinity|nan)\z"
_H1 = r"(?U)(?:\A|[\r\n])[\s\x1c-\x1f&&[^\r\n]]*#[\s\x1c-\x1f&&[^\r\n]]+([^\s\x1c-\x1f][^\r\n]*)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it. Keeps nested expressions small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c) -> Column:
    """Trim every kind of Unicode white space (``trim`` removes blanks only)."""
    return F.regexp_replace(_col(c), _STRIP, "")


def blank_to_null(c) -> Column:
    """Stripped text, NULL when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def strip_fences(c, variant: str = "extractor") -> Column:
    """Remove a code fence around a model response.

    ``extractor`` drops a leading ```` ```json ````, then a leading ```` ``` ````, then a trailing fence. ``generator`` leaves a bare
    leading fence in place.
    """
    if variant not in ("extractor", "generator"):
        raise ValueError(f"unknown fence variant: {variant!r}")
    out = F.regexp_replace(strip(c), r"\A```json", "")
    if variant == "extractor":
        out = F.regexp_replace(out, r"\A```", "")
    return strip(F.regexp_replace(out, r"```\z", ""))


def h1_title(c) -> Column:
    """First level-one Markdown heading, NULL if there is none. One regex scan, no array of lines."""
    return F.nullif(strip(F.regexp_extract(_col(c), _H1, 1)), F.lit(""))


def to_float(c) -> Column:
    """Text to DOUBLE by Python's float syntax; NULL where that would fail (``1d`` is not a number)."""
    return F.regexp_replace(F.regexp_substr(strip(c), F.lit(_FLOAT)), "_", "").try_cast("double")


def parse_ratio(c, strict: bool = False) -> Column:
    """``97-99`` -> 98, ``1e-3`` -> 0.001, ``-5--3`` -> -4.

    A dash past the first character splits a range when both sides are numbers; otherwise the whole text must be one. NULL stays
    NULL. Unparsable text gives NULL, or fails the job when ``strict``.
    """

    def parse(s: Column) -> Column:
        dash = F.locate("-", s, 2)
        low = to_float(F.substring(s, F.lit(1), dash - 1))
        high = to_float(F.substring(s, dash + 1, F.length(s)))
        value = F.coalesce(F.when(dash > 1, (low + high) / 2.0), to_float(s))
        if not strict:
            return value
        return F.when(s.isNotNull(), F.coalesce(value, F.raise_error(F.concat(F.lit("bad ratio: "), s)).cast("double")))

    return let(strip(_col(c).cast("string")), parse)


def normalize_doi(c) -> Column:
    """Trimmed, lower-case DOI without resolver address or ``doi:`` prefix; NULL if blank."""
    s = F.lower(strip(c))
    s = F.regexp_replace(s, r"\A(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")
    return blank_to_null(s)


def file_stem(c) -> Column:
    """Last path part without its final extension."""
    return F.regexp_replace(F.regexp_extract(_col(c), r"([^/]*)\z", 1), r"(?<=.)\.[^.]*\z", "")


def dataset_name(c, drop_part_suffix: bool = False) -> Column:
    """``val_Tg_1.json`` -> ``Tg``; a name without the ``val_`` prefix is its own dataset.

    ``drop_part_suffix`` first removes one ``_train`` / ``_test`` ending.
    """
    stem = file_stem(c)
    if drop_part_suffix:
        stem = F.regexp_replace(stem, r"_(?:train|test)\z", "")
    return F.regexp_replace(stem, r"\Aval_(.+?)(?:_\d+)?\z", "$1")


def python_json_spacing(c) -> Column:
    """Put one blank after each separator of compact JSON text, leaving strings alone.

    Escapes are masked with control characters (which valid JSON never holds raw), so that a string is a plain quoted run.
    """
    s = F.replace(_col(c), F.lit("\\\\"), F.lit("\u0002"))
    s = F.replace(s, F.lit('\\"'), F.lit("\u0003"))
    s = F.regexp_replace(s, r'("[^"]*+")|([,:])', "$1$2\u0001")
    s = F.replace(s, F.lit('"\u0001'), F.lit('"'))
    s = F.replace(s, F.lit("\u0001"), F.lit(" "))
    s = F.replace(s, F.lit("\u0003"), F.lit('\\"'))
    return F.replace(s, F.lit("\u0002"), F.lit("\\\\"))


# A double as the JVM prints it with an exponent.
_SCIENTIFIC = r"-?[0-9]\.[0-9]+E-?[0-9]+"


def _python_number(t: Column) -> Column:
    """One double in the JVM's exponent notation, as Python prints it: plain from 1e-4 up to below 1e16, else ``1.5e-07``."""
    part = lambda i: F.regexp_extract(t, r"\A(-?)([0-9])\.([0-9]+)E(-?[0-9]+)\z", i)
    frac = F.when(part(3) == "0", "").otherwise(part(3))
    digits, x = F.concat(part(2), frac), part(4).cast("int")
    whole = F.when(F.length(digits) > x, F.substring(digits, F.lit(1), x + 1)).otherwise(F.rpad(digits, x + 1, F.lit("0")))
    rest = F.when(F.length(digits) > x + 1, F.substring(digits, x + 2, F.length(digits))).otherwise("0")
    size = F.abs(x).cast("string")
    power = F.concat(F.when(x < 0, "e-").otherwise("e+"), F.when(F.length(size) < 2, "0").otherwise(""), size)
    return F.concat(
        part(1),
        F.when(x == -4, F.concat(F.lit("0.000"), digits))
        .when(x.between(7, 15), F.concat(whole, F.lit("."), rest))
        .otherwise(F.concat(part(2), F.when(frac == "", "").otherwise(F.concat(F.lit("."), frac)), power)),
    )


def python_json_numbers(c) -> Column:
    """Doubles of compact JSON text as Python prints them; strings stay as they are. Text without an exponent is not taken apart."""
    s = _col(c)
    masked = F.replace(F.replace(s, F.lit("\\\\"), F.lit("\u0002")), F.lit('\\"'), F.lit("\u0003"))
    tokens = F.regexp_extract_all(masked, F.lit(rf'"[^"]*+"|{_SCIENTIFIC}|[,:\[\]{{}}]|[^",:\[\]{{}}]++'), F.lit(0))
    shown = F.transform(tokens, lambda t: F.when(t.rlike(rf"\A{_SCIENTIFIC}\z"), _python_number(t)).otherwise(t))
    back = F.replace(F.replace(F.array_join(shown, ""), F.lit("\u0003"), F.lit('\\"')), F.lit("\u0002"), F.lit("\\\\"))
    return F.when(s.rlike(r"[0-9]E-?[0-9]"), back).otherwise(s)


def json_string(c) -> Column:
    """A JSON string literal (or ``null``) for a text column."""
    boxed = F.to_json(F.struct(_col(c).alias("x")), {"ignoreNullFields": "false"})
    return F.substring(boxed, F.lit(6), F.length(boxed) - 6)
