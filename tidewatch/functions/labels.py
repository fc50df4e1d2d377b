"""Label sets: maps of strings in which a missing label is an empty one."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ieee import let

NAME = "__name__"


def canonical(labels: Column) -> Column:
    """Entries in key order, empty values left out."""
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(labels, lambda _, v: F.coalesce(v, F.lit("")) != ""))))


def key(labels: Column) -> Column:
    """A string that is equal for equal label sets."""
    return F.to_json(canonical(labels))


def label(labels: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit(""))


def by(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, _: k.isin(*names)) if names else F.map_filter(labels, lambda k, _: F.lit(False))


def without(labels: Column, names: list[str]) -> Column:
    """All labels but these and the metric's name."""
    return F.map_filter(labels, lambda k, _: ~k.isin(NAME, *names))


def nameless(labels: Column) -> Column:
    return without(labels, [])


def merged(winner: Column, other: Column) -> Column:
    """Both maps' entries; where both have a key, winner's."""
    return let(winner, lambda w: F.map_concat(w, F.map_filter(other, lambda k, _: ~F.map_contains_key(w, k))))


def with_label(labels: Column, name: str, value: Column) -> Column:
    """labels with a label set, or taken away if the value is empty; an empty label is a missing one."""
    rest = F.map_filter(labels, lambda k, _: k != name)
    return F.map_filter(F.map_concat(rest, F.create_map(F.lit(name), value)), lambda _, v: v != "")


def anchored(pattern: str) -> str:
    """A pattern that must match a whole value."""
    return f"^(?s:{pattern})$"


def matches(labels: Column, name: str, op: str, value: str) -> Column:
    """Matcher `=`, `!=`, `=~` or `!~` on a label."""
    own = label(labels, name)
    found = own.rlike(anchored(value)) if "~" in op else own == value
    return ~found if op[0] == "!" else found


def label_replace(labels: Column, target: str, replacement: str, source: str, pattern: str) -> Column:
    """If the whole source label matches, target becomes the replacement with its $1 or ${name} filled in."""
    own = label(labels, source)
    whole = anchored(pattern)
    names = re.compile(pattern).groupindex
    parts, at = [], 0
    for found in re.finditer(r"\$\$|\$\{(\w+)\}|\$(\w+)", replacement):
        parts.append(F.lit(replacement[at : found.start()]))
        ref = found[1] or found[2]
        if ref is None:
            parts.append(F.lit("$"))
        else:
            group = int(ref) if ref.isdigit() else names.get(ref)
            known = group is not None and group <= re.compile(pattern).groups
            parts.append(F.regexp_extract(own, whole.replace("(?P<", "(?<"), group) if known else F.lit(""))
        at = found.end()
    value = F.concat(*parts, F.lit(replacement[at:]))
    return F.when(own.rlike(whole.replace("(?P<", "(?<")), with_label(labels, target, value)).otherwise(labels)


def label_join(labels: Column, target: str, separator: str, sources: list[str]) -> Column:
    return with_label(labels, target, F.concat_ws(separator, *(label(labels, s) for s in sources)))


def sanitised(labels: Column) -> Column:
    """Keys with anything but letters, digits and underscores as underscores; of clashing keys the first in order."""
    entries = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.struct(F.regexp_replace(e["key"], "[^a-zA-Z0-9_]", "_").alias("key"), e["value"].alias("value")))
    names = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1))


def candidates(name: str) -> list[str]:
    """Attribute keys that a sanitised label name may stand for: dots or underscores between its parts."""
    parts = name.split("_")
    out = [parts[0]]
    for part in parts[1:]:
        out = [a + sep + part for a in out for sep in ("_", ".")]
    return out


def with_resource(labels: Column, resource: Column, service: Column) -> Column:
    """A sample's labels over its resource's, with service_name from the service's column if nothing else has it."""
    named = lambda both: F.when(label(both, "service_name") == "", with_label(both, "service_name", F.coalesce(service, F.lit("")))).otherwise(both)
    return let(merged(labels, sanitised(resource)), named)


def natural(value: Column) -> Column:
    """Sort key in which runs of digits compare as numbers."""
    parts = F.regexp_extract_all(value, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 32, "0")).otherwise(p)), "")
