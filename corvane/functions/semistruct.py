"""Semi-structured values: allow-lists, property filters, alias promotion, key checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_number(value: Column) -> Column:
    """The value as a double if it is a finite number, else null."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def one_of(value: Column, allowed: list[str]) -> Column:
    """The trimmed value if it is allowed, else null."""
    v = F.trim(value)
    return F.when(v.isin(*allowed), v)


def allowed_properties(props: Column, keep: list[str], defaults: dict[str, str]) -> Column:
    """Allowed entries whose value isn't null, with the defaults over them."""
    kept = F.map_filter(props, lambda k, v: k.isin(*keep) & ~k.isin(*defaults) & v.isNotNull())
    extra = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]) if defaults else F.create_map().cast("map<string,string>")
    return F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), extra)


def promoted(json: Column, name: str, aliases: list[str]) -> Column:
    """The raw value of name, or of its first alias that is present; presence counts, a JSON null too."""
    keys = F.json_object_keys(json)
    fields = F.from_json(json, "map<string,string>")
    out = F.when(F.array_contains(keys, name), fields[name])
    for a in aliases:
        out = out.when(F.array_contains(keys, a), fields[a])
    return out


def unknown_fields(json: Column, known: list[str]) -> Column:
    """Sorted keys of the object that aren't known; null if it is no object."""
    return F.array_sort(F.array_except(F.json_object_keys(json), F.array(*[F.lit(k) for k in known])))


def single_object(json: Column, most: int = 16 << 20) -> Column:
    """Whether the text is a single JSON object of at most `most` bytes."""
    one = F.json_array_length(F.concat(F.lit("["), json, F.lit("]"))) == 1  # null where another value follows
    return (F.octet_length(json) <= most) & F.json_object_keys(json).isNotNull() & F.coalesce(one, F.lit(False))
