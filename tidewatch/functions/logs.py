"""Log lines: levels, filters, parsers and units, as column expressions.

A log frame has ts (long, microseconds), line (string) and labels (map<string,string>).
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import labels as lb

ERROR = "__error__"
# The keys that may hold a level, in order, and the names that levels go by.
LEVEL_KEYS = ["detected_level", "level", "log.level", "severity", "severity_text"]
LEVEL_NAMES = {"trace": ["trace", "trc"], "debug": ["debug", "dbg"], "info": ["info", "inf", "information"], "warn": ["warn", "wrn", "warning"], "error": ["error", "err"], "critical": ["critical"], "fatal": ["fatal"]}
# Nanoseconds and bytes of units.
DURATIONS = {"ns": 1.0, "us": 1e3, "µs": 1e3, "ms": 1e6, "s": 1e9, "m": 6e10, "h": 3.6e12, "d": 8.64e13}
SIZES = {"b": 1.0, "kb": 1e3, "mb": 1e6, "gb": 1e9, "tb": 1e12, "pb": 1e15, "kib": 2.0**10, "mib": 2.0**20, "gib": 2.0**30, "tib": 2.0**40, "pib": 2.0**50}


def detected_level(attributes: Column, severity: Column) -> Column:
    """The record's level: from its attributes, then its severity; unknown if there is none."""
    named = F.array(*(lb.label(attributes, k) for k in LEVEL_KEYS), F.coalesce(severity, F.lit("")), F.lit("unknown"))
    names = F.create_map(*(F.lit(x) for name, forms in LEVEL_NAMES.items() for form in forms for x in (form, name)))
    raw = F.lower(F.get(F.filter(named, lambda v: v != ""), F.lit(0)))
    return lb.let(raw, lambda r: F.coalesce(F.try_element_at(names, r), r))


def pattern_regex(pattern: str, whole: bool = False) -> tuple[str, list[str]]:
    """Regular expression and capture names of a pattern with <name> and <_> in it."""
    out, names, at = "", [], 0
    for found in re.finditer(r"<(\w+)>", pattern):
        out += re.escape(pattern[at : found.start()])
        rest = pattern[found.end() :]
        out += ("(?:.*?)" if found[1] == "_" else "(.*?)") if rest else ("(?:.*)" if found[1] == "_" else "(.*)")
        names += [found[1]] if found[1] != "_" else []
        at = found.end()
    out = "(?s)" + ("^" if whole else "") + out + re.escape(pattern[at:])
    return out + ("$" if whole else ""), names


def line_matches(line: Column, op: str, *values: str) -> Column:
    """Line filter `|=` `!=` `|~` `!~` `|>` `!>`; several values are alternatives."""
    test = {"=": lambda v: line.contains(v), "~": lambda v: line.rlike(v), ">": lambda v: line.rlike(pattern_regex(re.sub(r"^(<_>)+|(<_>)+$", "", v))[0])}[op[1]]
    found = test(values[0])
    for v in values[1:]:
        found = found | test(v)
    return ~found if op[0] == "!" else found


def _ip_number(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\."), lambda p: p.cast("long"))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p)


def ip_bounds(spec: str) -> tuple[int, int]:
    """First and last address of one address, a range a-b, or a network, as numbers."""
    if "-" in spec:
        a, b = (ipaddress.ip_address(x.strip()) for x in spec.split("-"))
        return int(a), int(b)
    network = ipaddress.ip_network(spec, strict=False)
    return int(network[0]), int(network[-1])


def has_ip(text: Column, spec: str) -> Column:
    """Whether a text holds an address within the spec."""
    if ":" in spec:
        low, high = ip_bounds(spec)

        @F.pandas_udf(T.BooleanType())
        def six(lines: pd.Series) -> pd.Series:
            def holds(line: str | None) -> bool:
                for word in re.findall(r"[0-9a-fA-F:]*:[0-9a-fA-F:.]+", line or ""):
                    try:
                        if low <= int(ipaddress.IPv6Address(word)) <= high:
                            return True
                    except ValueError:
                        pass
                return False

            return lines.map(holds)

        return six(text)
    low, high = ip_bounds(spec)
    octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    found = F.regexp_extract_all(text, F.lit(rf"(?<![\d.])({octet}\.{octet}\.{octet}\.{octet})(?![\d.])"), F.lit(1))
    return F.exists(found, lambda a: _ip_number(a).between(low, high))


def _clean(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")


def extracted(labels: Column, found: Column) -> Column:
    """Labels with parsed ones; a parsed name that a label already has gets the suffix _extracted."""

    def both(x: Column) -> Column:
        own = x["own"]
        renamed = F.transform(F.map_entries(x["found"]), lambda e: F.struct(F.when(F.map_contains_key(own, e["key"]), F.concat(e["key"], F.lit("_extracted"))).otherwise(e["key"]).alias("key"), e["value"].alias("value")))
        clash = F.map_concat(own, F.map_from_entries(F.filter(renamed, lambda e: ~F.map_contains_key(own, e["key"]))))
        return F.when(F.arrays_overlap(F.map_keys(own), F.map_keys(x["found"])), clash).otherwise(F.map_concat(own, x["found"]))

    return lb.let(F.struct(labels.alias("own"), found.alias("found")), both)


def _last_wins(pairs: Column) -> Column:
    """A map of pairs (k, v); of pairs with one key the last."""

    def of(x: Column) -> Column:
        keys = F.transform(x, lambda p: p["k"])
        later = lambda i: F.slice(keys, i + 2, F.size(x))
        last = F.filter(x, lambda p, i: ~F.array_contains(later(i), p["k"]))
        entries = lambda y: F.map_from_entries(F.transform(y, lambda p: F.struct(p["k"].alias("key"), p["v"].alias("value"))))
        return F.when(F.size(F.array_distinct(keys)) == F.size(x), entries(x)).otherwise(entries(last))

    return lb.let(pairs, of)


#: Levels of a JSON line that become labels of their own; an object below them is one label, its text.
JSON_LEVELS = 8


def _flat_json(line: Column) -> Column:
    """Leaves of a JSON object by path, joined with underscores; of clashing names the last; null if it is no object.

    Lists are left out, nulls are empty, numbers are written as Spark writes them.
    """

    def entries(text: Column, prefix: Column) -> Column:
        one = lambda e: F.struct(F.concat(prefix, _clean(e["key"])).alias("k"), F.to_json(e["value"]).alias("text"), F.coalesce(e["value"].cast("string"), F.lit("")).alias("v"))
        return F.transform(F.map_entries(F.from_json(text, "map<string,variant>")), one)

    is_object = lambda e: e["text"].startswith("{")

    def deeper(found: Column) -> Column:
        opened = F.flatten(F.transform(found, lambda e: F.when(is_object(e), entries(e["text"], F.concat(e["k"], F.lit("_")))).otherwise(F.array(e))))
        return F.when(F.exists(found, is_object), opened).otherwise(found)

    found = entries(line, F.lit(""))
    for _ in range(JSON_LEVELS - 1):
        found = lb.let(found, deeper)
    return _last_wins(F.filter(found, lambda e: ~e["text"].startswith("[")))


def parse_json(labels: Column, line: Column) -> Column:
    failed = F.create_map(F.lit(ERROR), F.lit("JSONParserErr"))
    return extracted(labels, F.coalesce(_flat_json(line), failed))


def parse_json_paths(labels: Column, line: Column, paths: dict[str, str]) -> Column:
    """Labels from paths like user.id, by name; a missing one is empty and so left out."""
    out = labels
    for name, path in paths.items():
        out = lb.with_label(out, name, F.coalesce(F.get_json_object(line, "$." + path), F.lit("")))
    return out


def parse_logfmt(labels: Column, line: Column, keep_empty: bool = False, strict: bool = False, names: dict[str, str] | None = None) -> Column:
    """Labels from key=value pairs; values may be quoted.

    strict marks a line with anything else in it as an error. names takes only some keys, each under a name of its
    own, missing ones as empty.
    """
    pair = r'[^\s="]+=(?:"(?:[^"\\]|\\.)*"|[^\s"]*)'

    def parts(text: Column) -> Column:
        value = F.substring(text, F.instr(text, "=") + 1, F.length(text))
        bare = F.when(value.startswith('"'), F.regexp_replace(F.substring(value, F.lit(2), F.length(value) - 2), r'\\(["\\])', "$1")).otherwise(value)
        return F.struct(_clean(F.substring_index(text, "=", 1)).alias("k"), bare.alias("v"))

    found = _last_wins(F.transform(F.regexp_extract_all(line, F.lit(pair), F.lit(0)), parts))
    if names is not None:
        found = lb.let(found, lambda f: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.coalesce(F.try_element_at(f, F.lit(key)), F.lit("")) for key in names.values()))))
    out = extracted(labels, found if keep_empty or names is not None else F.map_filter(found, lambda _, v: v != ""))
    if not strict:
        return out
    whole = line.rlike(rf"^\s*(?:{pair}(?:\s+|$))*$")
    return F.when(whole, out).otherwise(lb.with_label(labels, ERROR, F.lit("LogfmtParserErr")))


def parse_regexp(labels: Column, line: Column, pattern: str) -> Column:
    """Labels from named groups."""
    java = pattern.replace("(?P<", "(?<")
    groups = re.compile(pattern.replace("(?<", "(?P<") if "(?P<" not in pattern else pattern).groupindex
    found = F.create_map(*(x for name, i in groups.items() for x in (F.lit(name), F.regexp_extract(line, java, i))))
    return F.when(line.rlike(java), extracted(labels, F.map_filter(found, lambda _, v: v != ""))).otherwise(labels)


def parse_pattern(labels: Column, line: Column, pattern: str) -> Column:
    java, names = pattern_regex(pattern)
    if pattern.startswith("<"):  # nothing to search for: the first capture starts the line
        java = java.replace("(?s)", "(?s)^", 1)
    found = F.create_map(*(x for i, name in enumerate(names, 1) for x in (F.lit(name), F.regexp_extract(line, java, i))))
    return F.when(line.rlike(java), extracted(labels, found)).otherwise(labels)


def unpack(labels: Column, line: Column) -> tuple[Column, Column]:
    """Labels and line of a packed line: a JSON object of strings whose _entry is the line."""
    found = F.from_json(line, "map<string,string>")
    return (
        extracted(labels, F.coalesce(F.map_filter(found, lambda k, v: (k != "_entry") & v.isNotNull()), F.create_map(F.lit(ERROR), F.lit("JSONParserErr")))),
        F.coalesce(F.try_element_at(found, F.lit("_entry")), line),
    )


def _units(text: Column, units: dict[str, float]) -> Column:
    scale = F.create_map(*(x for k, v in units.items() for x in (F.lit(k), F.lit(v))))
    part = r"(\d+(?:\.\d+)?)\s*([a-zA-Zµ]+)"

    def value(low: Column) -> Column:
        numbers, names = F.regexp_extract_all(low, F.lit(part), F.lit(1)), F.regexp_extract_all(low, F.lit(part), F.lit(2))
        each = F.zip_with(numbers, names, lambda n, u: n.try_cast("double") * F.try_element_at(scale, u))
        sign = F.when(low.startswith("-"), -1.0).otherwise(1.0)
        return F.when(low.rlike(r"^[-+]?(?:\d+(?:\.\d+)?\s*[a-zA-Zµ]+\s*)+$"), F.aggregate(each, F.lit(0.0), lambda a, x: a + x) * sign)

    return lb.let(F.lower(F.trim(text)), value)


def duration_seconds(text: Column) -> Column:
    """Seconds of a text like 1h30m or 250ms; null if it is none."""
    return _units(text, DURATIONS) / 1e9


def byte_size(text: Column) -> Column:
    """Bytes of a text like 5KB or 2MiB, or a plain number; null if it is neither."""
    return F.coalesce(_units(text, SIZES), text.try_cast("double"))  # no text is both


CONVERT = {"number": lambda t: t.try_cast("double"), "duration": duration_seconds, "bytes": byte_size}


def label_filter(labels: Column, name: str, op: str, value: float, kind: str = "number") -> tuple[Column, Column]:
    """Whether a row stays, and its labels: a value that can't be read stays, marked as an error; a missing one goes."""
    from .ieee import COMPARE

    text = lb.label(labels, name)
    number = CONVERT[kind](text)
    holds = lb.let(number, lambda n: COMPARE[op](n, F.lit(float(value))))
    return (text != "") & F.coalesce(holds, F.lit(True)), lb.with_label(labels, ERROR, F.when(number.isNull(), "LabelFilterErr").otherwise(lb.label(labels, ERROR)))


#: A filter of labels: from the labels, whether the row stays and its labels then.
Condition = Callable[[Column], tuple[Column, Column]]


def condition(name: str, op: str, value: float | str, kind: str = "string") -> Condition:
    """A comparison of one label: of text, or of a number, duration, or bytes as :func:`label_filter` makes it."""
    if kind == "string":
        return lambda labels: (lb.matches(labels, name, op, str(value)), labels)
    return lambda labels: label_filter(labels, name, op, float(value), kind)


def all_of(*conditions: Condition) -> Condition:
    """Rows that pass all conditions; one that an earlier condition marks as an error goes on marked."""

    def both(labels: Column) -> tuple[Column, Column]:
        stays, out = conditions[0](labels)
        for c in conditions[1:]:
            more, out = c(out)
            stays = stays & more
        return stays, out

    return both


def any_of(*conditions: Condition) -> Condition:
    """Rows that pass a condition, with the labels that the first one that they pass gives."""

    def first(labels: Column) -> tuple[Column, Column]:
        tried = [c(labels) for c in conditions]
        stays, out = tried[0][0], labels
        for more, _ in tried[1:]:
            stays = stays | more
        for passes, own in reversed(tried):
            out = F.when(passes, own).otherwise(out)
        return stays, out

    return first


def unwrap(labels: Column, name: str, kind: str = "number") -> tuple[Column, Column]:
    """Sample value of a label, and the labels without it."""
    return CONVERT[kind](lb.label(labels, name)), F.map_filter(labels, lambda k, _: k != name)


#: Functions of templates: a text and the arguments, which come before it there.
FILTERS = {
    "ToUpper": F.upper, "ToLower": F.lower, "TrimSpace": F.trim, "upper": F.upper, "lower": F.lower, "trim": F.trim, "title": F.initcap,
    "Replace": lambda v, old, new, n="-1": F.replace(v, F.lit(old), F.lit(new)) if int(n) < 0 else _replace_some(v, old, new, int(n)),
    "replace": lambda v, old, new: F.replace(v, F.lit(old), F.lit(new)),
    "Trim": lambda v, cut: F.trim(v, F.lit(cut)), "TrimLeft": lambda v, cut: F.ltrim(v, F.lit(cut)), "TrimRight": lambda v, cut: F.rtrim(v, F.lit(cut)),
    "TrimPrefix": lambda v, cut: F.when(v.startswith(cut), F.substring(v, F.lit(len(cut) + 1), F.length(v))).otherwise(v), "trimPrefix": lambda v, cut: FILTERS["TrimPrefix"](v, cut),
    "TrimSuffix": lambda v, cut: F.when(v.endswith(cut), F.substring(v, F.lit(1), F.length(v) - len(cut))).otherwise(v), "trimSuffix": lambda v, cut: FILTERS["TrimSuffix"](v, cut),
    "regexReplaceAll": lambda v, pattern, new: F.regexp_replace(v, pattern, re.sub(r"\$\{(\w+)\}", r"$\1", new)),
    "substr": lambda v, a, b: F.substring(v, F.lit(int(a) + 1), F.lit(int(b) - int(a))), "trunc": lambda v, n: F.substring(v, 1, int(n)) if int(n) >= 0 else F.right(v, F.lit(-int(n))),
    "repeat": lambda v, n: F.repeat(v, F.lit(int(n))), "default": lambda v, other: F.when(v == "", other).otherwise(v), "len": lambda v: F.length(v).cast("string"),
    "alignLeft": lambda v, n: F.rpad(v, int(n), " "), "alignRight": lambda v, n: F.when(F.length(v) >= int(n), F.right(v, F.lit(int(n)))).otherwise(F.lpad(v, int(n), " ")),
    "add": lambda v, n: _whole(v, lambda x: x + int(n)), "mul": lambda v, n: _whole(v, lambda x: x * int(n)),
    "b64enc": lambda v: F.base64(v.cast("binary")), "b64dec": lambda v: F.unbase64(v).cast("string"), "urlencode": F.url_encode, "urldecode": F.url_decode,
}


def _replace_some(v: Column, old: str, new: str, n: int) -> Column:
    for _ in range(n):
        v = F.regexp_replace(v, f"(?s)^(.*?){re.escape(old)}", "$1\x00")
    return F.replace(v, F.lit("\x00"), F.lit(new))


def _whole(v: Column, f) -> Column:
    return F.coalesce(f(v.try_cast("long")).cast("string"), F.lit("0"))


def template(text: str, labels: Column, line: Column, ts: Column | None = None) -> Column:
    """A text with fields like {{.name}}, {{.name | ToUpper | trunc 3}} or {{ Replace .name "a" "b" -1 }} filled in.

    Fields are labels; {{__line__}} is the line. Functions are those of FILTERS; in a pipe the text comes last among
    a function's arguments, as it does before it for the capitalised ones of the second form.
    """

    def field(name: str) -> Column:
        name = name.lstrip(".")
        return line if name == "__line__" else ts.cast("string") if name == "__timestamp__" and ts is not None else lb.label(labels, name)

    parts, at = [], 0
    for found in re.finditer(r"\{\{(.*?)\}\}", text):
        value = None
        for step in re.findall(r'(?:"(?:[^"\\]|\\.)*"|`[^`]*`|[^|])+', found[1]):
            words = [w[1:-1] if w[0] in '"`' else w for w in re.findall(r'"(?:[^"\\]|\\.)*"|`[^`]*`|\S+', step)]
            if value is not None:
                value = FILTERS[words[0]](value, *words[1:])
            elif words[0] in FILTERS:
                own = next(w for w in words[1:] if w.startswith(".") or w == "__line__")
                value = FILTERS[words[0]](field(own), *(w for w in words[1:] if w != own))
            else:
                value = field(words[0])
        parts += [F.lit(text[at : found.start()]), value]
        at = found.end()
    return F.concat(*parts, F.lit(text[at:]))


def decolorize(line: Column) -> Column:
    return F.regexp_replace(line, r"\x1B\[[0-9;]*[A-Za-z]", "")
