"""JSON texts as VARIANT values: paths, a canonical form, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: stands behind a text while it is parsed: what follows a value would be passed over otherwise
END = "end of the text"


def parsed(text: Column) -> Column:
    """The value of a JSON text; null if it is none, or if anything but spaces follows the value."""
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{END}"]')))
    return F.when(F.try_variant_get(both, "$[1]", "string") == END, F.try_variant_get(both, "$[0]", "variant"))


def path_of(key: str) -> str:
    """A path to ``a.b`` or ``items[0].name``; a part in double quotes may hold dots: ``"a.b".c``."""
    parts, rest = [], key
    while rest:
        if rest.startswith('"'):
            end = rest.index('"', 1)
            name, rest = rest[1:end], rest[end + 1 :]
        else:
            end = min((i for i in (rest.find("."), rest.find("[")) if i >= 0), default=len(rest))
            name, rest = rest[:end], rest[end:]
        if name:
            parts.append(f"['{name}']")
        if rest.startswith("["):
            end = rest.index("]")
            parts.append(rest[: end + 1])
            rest = rest[end + 1 :]
        rest = rest.removeprefix(".")
    return "$" + "".join(parts)


def at_path(text: Column, key: str, kind: str = "string") -> Column:
    """What lies at a path of a JSON text, as ``kind``; null if there is nothing, or nothing of that kind."""
    return F.try_variant_get(parsed(text), path_of(key), kind)


def is_string(value: Column) -> Column:
    """Whether a VARIANT holds a text."""
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def canonical(text: Column) -> Column:
    """The same JSON without spaces and with the keys of every object in order; null if it is no JSON."""
    return F.to_json(parsed(text))


def object_digest(text: Column) -> Column:
    """SHA-256 of the canonical form: equal objects share it, whatever the order of their keys."""
    return F.sha2(canonical(text), 256)


def quoted(text: Column) -> Column:
    """A text as JSON in ASCII: what is beyond goes as lower-case ``\\uxxxx``, as other writers do by default."""
    line = F.to_json(F.struct(text.cast("string").alias("t")), {"writeNonAsciiCharacterAsCodePoint": "true"})
    body = F.substring(line, 6, 1 << 30)  # after {"t":
    body = F.left(body, F.length(body) - 1)
    slash = F.lit("\x01")  # cannot stand in JSON, where control characters are escaped
    parts = F.split(F.replace(body, F.lit("\\\\"), slash), r"\\u", -1)
    low = F.concat(F.slice(parts, 1, 1), F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.concat(F.lower(F.left(p, F.lit(4))), F.substring(p, 5, 1 << 30))))
    out = F.replace(F.replace(F.array_join(low, "\\u"), slash, F.lit("\\\\")), F.lit("\x7f"), F.lit("\\u007f"))
    return F.when(text.isNotNull(), out)


def document_digest(doc_id: Column, excerpt: Column) -> Column:
    """SHA-256 of ``{"excerpt": ..., "id": ...}``, the keys in order."""
    return F.sha2(F.concat(F.lit('{"excerpt": '), F.coalesce(quoted(excerpt), F.lit("null")), F.lit(', "id": '), F.coalesce(quoted(doc_id), F.lit("null")), F.lit("}")), 256)
