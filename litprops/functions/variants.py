"""Small helpers on VARIANT values. They keep *missing*, *null* and *wrong type* apart, which a typed ``from_json`` does not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litprops.functions import text
from litprops.functions.text import let


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def child(v: Column, key: str) -> Column:
    """Member ``key`` as VARIANT; SQL NULL when missing."""
    path = f"$.{key}" if key.isidentifier() else f"$['{key}']"
    return F.try_variant_get(v, path, "variant")


def members(v: Column) -> Column:
    """All members of an object as a map; NULL unless the value is an object. Cheaper than asking for the schema of a large value."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def elements(v: Column) -> Column:
    """The array's elements as ``array<variant>``; NULL unless the value is an array."""
    return F.try_variant_get(v, "$", "array<variant>")


def kind(v: Column) -> Column:
    """``OBJECT``, ``ARRAY``, ``STRING``, ``BOOLEAN``, ``VOID`` (JSON null) or a numeric type name; NULL when missing.

    It walks the whole value: use :func:`members` or :func:`elements` where a container is expected.
    """
    return F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)


def is_kind(v: Column, *names: str) -> Column:
    return F.coalesce(kind(v).isin(*names), F.lit(False))


#: As strict as the JSON standard, and no limit on the length of one string.
_STRICT = {"allowSingleQuotes": "false", "maxStringLen": str(2**31 - 1)}


def json_array(s: Column) -> Column:
    """Elements of text that is exactly one JSON array as ``array<variant>``, else NULL.

    The text is cut into elements before any of them becomes a VARIANT, so VARIANT's size limit holds for one element and not for the
    text; an element above it is an error, never a NULL. The second parse tells whether something stands behind the array.
    """
    inside = F.from_json(F.concat(F.lit('{"v":'), s, F.lit("}")), "v ARRAY<VARIANT>", _STRICT)["v"]
    alone = F.from_json(F.concat(F.lit("["), s, F.lit("]")), "ARRAY<STRING>", _STRICT)
    return F.when(F.size(alone) == 1, inside)


def strict_json(s: Column) -> Column:
    """VARIANT of text that is exactly one JSON value, else NULL.

    ``try_parse_json`` stops after the first value and ignores what follows. Text that parses both as the only element of an array
    and as the only member of an object has nothing behind its value.
    """

    def only(items: Column) -> Column:
        member = F.try_parse_json(F.concat(F.lit('{"v":'), s, F.lit("}")))
        return F.when((F.size(items) == 1) & member.isNotNull(), F.get(items, F.lit(0)))

    return let(elements(F.try_parse_json(F.concat(F.lit("["), s, F.lit("]")))), only)


def lenient_json_array(c) -> Column:
    """Entries of a model response as ``array<variant>``.

    An array is itself, an object becomes a one-element array, any other JSON gives NULL. Broken JSON is tried again on the text
    from the first ``[`` to the last ``]``. Blank or hopeless text gives NULL.
    """

    def parse(s: Column) -> Column:
        first = F.locate("[", s)
        last = F.length(s) - F.locate("]", F.reverse(s)) + 1
        inner = F.when((first > 0) & F.contains(s, F.lit("]")) & (last > first), F.substring(s, first, last - first + 1))
        other = lambda v: F.when(v.isNull(), json_array(inner)).when(members(v).isNotNull(), F.array(v))
        return let(json_array(s), lambda items: F.when(items.isNotNull(), items).otherwise(let(strict_json(s), other)))

    return let(text.blank_to_null(c), parse)
