"""Log queries over `events`, `documents`, `pages` and `conversations`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as lb, logs as lg, ranges
from ..operators import logs as lo, matching as mt, metadata as md, metrics as m
from ..sources import adapters as ad
from .metrics import DAYS, RANGE, _extrapolated, _grid, _windows, flat

QUERIES: dict = {}
SQL: dict[str, str] = {}

_K = "cast(json_extract_string(props, '$.k') as double)"
_T = "(epoch_us(ts) // 1000)"
_LEVEL = "case when event_type = 'error' then 'error' else 'info' end"


def add(name: str, f, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lo.streams(ad.event_logs(spark, sf_dir), ("event_type", "=~", ".+"))


def rows(logs: DataFrame, *names: str) -> DataFrame:
    return logs.select("ts", "line", *(lb.label(F.col("labels"), n).alias(n) for n in names))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lo.streams(ad.document_logs(spark, sf_dir))


def _doc_ids(logs: DataFrame) -> DataFrame:
    return logs.select(F.col("ts").alias("doc_id"), lb.label(F.col("labels"), "source").alias("source"))


add("log_stream_selector", lambda s, d: rows(lo.streams(ad.event_logs(s, d), ("event_type", "=~", "c.*|error"), ("event_type", "!=", "click")), "event_type", "user", "detected_level"),
    f"""select epoch_us(ts) as ts, props as line, event_type, user_id::varchar as "user", {_LEVEL} as detected_level from events where event_type = 'error'""")
add("log_level", lambda s, d: events(s, d).groupBy(lb.label(F.col("labels"), "detected_level").alias("level")).agg(F.count("*").alias("n")), f"select {_LEVEL} as level, count(*) as n from events group by 1")
add("line_contains", lambda s, d: _doc_ids(lo.lines(docs(s, d), "|=", "the", "que")), "select doc_id, source from documents where contains(text, 'the') or contains(text, 'que')")
add("line_not_contains", lambda s, d: _doc_ids(lo.lines(docs(s, d), "!=", "###")), "select doc_id, source from documents where not contains(coalesce(text, ''), '###')")
add("line_regex", lambda s, d: _doc_ids(lo.lines(docs(s, d), "|~", "[0-9]{6,}")), "select doc_id, source from documents where regexp_matches(text, '[0-9]{6,}')")
add("line_pattern", lambda s, d: _doc_ids(lo.lines(docs(s, d), "|>", "<_>the <_> of<_>")), "select doc_id, source from documents where regexp_matches(text, 'the .* of', 's')")
add("line_ip", lambda s, d: _doc_ids(docs(s, d).where(lg.has_ip(F.col("line"), "128.0.0.0/1"))),
    r"""with x as (select doc_id, source, unnest(regexp_extract_all(text, '(?:^|[^\d.])((?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3})', 1)) as ip, text from documents)
select distinct doc_id, source from x where split_part(ip, '.', 1)::int >= 128 and regexp_matches(text, '(^|[^\d.])' || replace(ip, '.', '\.') || '([^\d.]|$)')""")  # fmt: skip
add("parse_json", lambda s, d: rows(lo.parse(events(s, d), lg.parse_json), "event_type", "k"), "select epoch_us(ts) as ts, props as line, event_type, json_extract_string(props, '$.k') as k from events")
add("parse_json_paths", lambda s, d: rows(lo.parse(events(s, d), lg.parse_json_paths, {"number": "k"}), "number"), "select epoch_us(ts) as ts, props as line, json_extract_string(props, '$.k') as number from events")
_LOGFMT = "level={{.detected_level}} user={{.user}} msg=\"{{.event_type}} seen\""


def _formatted(s: SparkSession, d: str) -> DataFrame:
    return lo.line_format(events(s, d), _LOGFMT)


_FORMATTED = f"""'level=' || {_LEVEL} || ' user=' || user_id || ' msg="' || event_type || ' seen"'"""
add("line_format", lambda s, d: rows(_formatted(s, d)), f"select epoch_us(ts) as ts, {_FORMATTED} as line from events")
add("parse_logfmt", lambda s, d: rows(lo.parse(_formatted(s, d), lg.parse_logfmt), "level", "user_extracted", "msg"), f"select epoch_us(ts) as ts, {_FORMATTED} as line, {_LEVEL} as level, user_id::varchar as user_extracted, event_type || ' seen' as msg from events")
add("parse_regexp", lambda s, d: rows(lo.parse(_formatted(s, d), lg.parse_regexp, r"user=(?P<digits>\d+) msg=.(?P<what>\w+)"), "digits", "what"), f"select epoch_us(ts) as ts, {_FORMATTED} as line, user_id::varchar as digits, event_type as what from events")
add("parse_pattern", lambda s, d: rows(lo.parse(_formatted(s, d), lg.parse_pattern, "level=<lv> user=<_> msg=\"<what> "), "lv", "what"), f"select epoch_us(ts) as ts, {_FORMATTED} as line, {_LEVEL} as lv, event_type as what from events")
_PACKED = """'{"_entry":"' || event_type || '","app":"a' || user_id || '"}'"""
add("unpack", lambda s, d: rows(lo.unpack(lo.line_format(events(s, d), '{"_entry":"{{.event_type}}","app":"a{{.user}}"}')), "app"), "select epoch_us(ts) as ts, event_type as line, 'a' || user_id as app from events")
add("label_filter_number", lambda s, d: rows(lo.where_label(lo.parse(events(s, d), lg.parse_json), "k", ">", 50, "number"), "k"), f"select epoch_us(ts) as ts, props as line, json_extract_string(props, '$.k') as k from events where {_K} > 50")
add("label_filter_error", lambda s, d: rows(lo.where_label(events(s, d), "event_type", ">", 5, "number"), "event_type", "__error__"), "select epoch_us(ts) as ts, props as line, event_type, 'LabelFilterErr' as __error__ from events")
add("label_filter_duration", lambda s, d: rows(lo.where_label(lo.label_format(lo.parse(events(s, d), lg.parse_json), took="{{.k}}ms"), "took", "<=", 0.03, "duration"), "took"), f"select epoch_us(ts) as ts, props as line, json_extract_string(props, '$.k') || 'ms' as took from events where {_K} <= 30")
add("label_filter_bytes", lambda s, d: rows(lo.where_label(lo.label_format(lo.parse(events(s, d), lg.parse_json), size="{{.k}}KiB"), "size", ">=", 51200, "bytes"), "size"), f"select epoch_us(ts) as ts, props as line, json_extract_string(props, '$.k') || 'KiB' as size from events where {_K} >= 50")
add("label_filter_string", lambda s, d: rows(lo.where_label(events(s, d), "user", "=~", "[1-4]."), "user"), """select epoch_us(ts) as ts, props as line, user_id::varchar as "user" from events where regexp_full_match(user_id::varchar, '[1-4].')""")
add("label_filter_or", lambda s, d: rows(lo.where(lo.parse(events(s, d), lg.parse_json), lg.any_of(lg.condition("event_type", "=", "error"), lg.all_of(lg.condition("k", ">", 90, "number"), lg.condition("user", "=~", "1.*")), lg.condition("user", ">=", 95, "number"))), "user", "k", "__error__"),
    f"""select epoch_us(ts) as ts, props as line, user_id::varchar as "user", json_extract_string(props, '$.k') as k, '' as __error__ from events where event_type = 'error' or ({_K} > 90 and user_id::varchar like '1%') or user_id >= 95""")
add("label_filter_or_error", lambda s, d: rows(lo.where(events(s, d), lg.any_of(lg.condition("user", "<", 10, "number"), lg.condition("event_type", ">", 1, "duration"))), "user", "__error__"),
    """select epoch_us(ts) as ts, props as line, user_id::varchar as "user", case when user_id < 10 then '' else 'LabelFilterErr' end as __error__ from events""")  # fmt: skip
add("parse_logfmt_strict", lambda s, d: rows(lo.parse(lo.line_format(events(s, d), 'level={{.detected_level}} {{.event_type | Replace "view" "a view"}}=1'), lg.parse_logfmt, strict=True), "level", "click", "__error__"),
    f"select epoch_us(ts) as ts, 'level=' || {_LEVEL} || ' ' || replace(event_type, 'view', 'a view') || '=1' as line, case when event_type = 'view' then '' else {_LEVEL} end as level, case when event_type = 'click' then '1' else '' end as click, case when event_type = 'view' then 'LogfmtParserErr' else '' end as __error__ from events")
add("parse_logfmt_named", lambda s, d: rows(lo.parse(_formatted(s, d), lg.parse_logfmt, names={"lv": "level", "what": "msg"}), "lv", "what", "user"), f"""select epoch_us(ts) as ts, {_FORMATTED} as line, {_LEVEL} as lv, event_type || ' seen' as what, user_id::varchar as "user" from events""")
add("template_functions", lambda s, d: rows(lo.line_format(events(s, d), '{{.event_type | trunc 2 | alignRight 4}}|{{ Replace .event_type "r" "_" 1 }}|{{.user | add 5 | default "x"}}|{{.none | default "x"}}|{{.event_type | regexReplaceAll "(.)l" "${1}L" | TrimPrefix "c"}}|{{.event_type | substr 1 3 | upper | repeat 2}}')),
    """select epoch_us(ts) as ts, lpad(left(event_type, 2), 4, ' ') || '|' || regexp_replace(event_type, 'r', '_') || '|' || (user_id + 5) || '|x|' || (case when starts_with(replace(event_type, 'l', 'l'), 'c') then substr(regexp_replace(event_type, '(.)l', '\\1L', 'g'), 2) else regexp_replace(event_type, '(.)l', '\\1L', 'g') end) || '|' || repeat(upper(substr(event_type, 2, 2)), 2) as line from events""")  # fmt: skip
add("label_format", lambda s, d: rows(lo.rename_label(lo.label_format(events(s, d), tag="{{.event_type | ToUpper}}-{{.user}}"), "who", "user"), "tag", "who", "user"), """select epoch_us(ts) as ts, props as line, upper(event_type) || '-' || user_id as tag, user_id::varchar as who, '' as "user" from events""")
add("drop_labels", lambda s, d: rows(lo.drop(events(s, d), "detected_level", matchers=(("event_type", "=", "view"),)), "event_type", "detected_level"), "select epoch_us(ts) as ts, props as line, case when event_type = 'view' then '' else event_type end as event_type, '' as detected_level from events")
add("keep_labels", lambda s, d: rows(lo.keep(events(s, d), "user"), "user", "event_type"), """select epoch_us(ts) as ts, props as line, user_id::varchar as "user", '' as event_type from events""")
add("decolorize", lambda s, d: rows(lo.decolorize(lo.line_format(events(s, d), "\x1b[31m{{.event_type}}\x1b[0m"))), "select epoch_us(ts) as ts, event_type as line from events")


def _typed(s: SparkSession, d: str) -> DataFrame:
    """Streams by type only, with k as a label."""
    return lo.parse(lo.keep(events(s, d), "event_type"), lg.parse_json)


def _per_window(value: str, digits: int = 8) -> str:
    return f"with {_grid(DAYS)} select event_type, p as ts, round(({value})::double, {digits}) as value from events join g on {_T} > p - {RANGE} and {_T} <= p group by 1, 2"


_SECONDS = RANGE / 1000.0
for _f, _sql in {"count_over_time": "count(*)", "rate": f"count(*) / {_SECONDS}::double", "bytes_over_time": "sum(strlen(props))", "bytes_rate": f"sum(strlen(props)) / {_SECONDS}::double"}.items():
    add(f"log_{_f}", lambda s, d, f=_f: flat(lo.over_lines(lo.keep(events(s, d), "event_type"), f, DAYS, RANGE), "event_type"), _per_window(_sql))
for _f, _sql in {"sum": "sum", "avg": "avg", "min": "min", "max": "max", "stddev": "stddev_pop", "stdvar": "var_pop"}.items():
    add(f"unwrap_{_f}_over_time", lambda s, d, f=_f: flat(lo.over_values(_typed(s, d), "k", f"{f}_over_time", DAYS, RANGE), "event_type"), _per_window(f"{_sql}({_K})"))
add("unwrap_quantile_over_time", lambda s, d: flat(lo.over_values(_typed(s, d), "k", ranges.quantile_over_time(0.9), DAYS, RANGE), "event_type"), _per_window(f"quantile_cont({_K}, 0.9)"))
add("unwrap_rate", lambda s, d: flat(lo.over_values(_typed(s, d), "k", "rate", DAYS, RANGE), "event_type"), _per_window(f"sum({_K}) / {_SECONDS}::double"))
add("unwrap_first_over_time", lambda s, d: flat(lo.over_values(_typed(s, d), "k", "first_over_time", DAYS, RANGE), "event_type"), _per_window(f"arg_min({_K}, {{'t': {_T}, 'v': {_K}}})"))
add("unwrap_last_over_time", lambda s, d: flat(lo.over_values(_typed(s, d), "k", "last_over_time", DAYS, RANGE), "event_type"), _per_window(f"arg_max({_K}, {{'t': {_T}, 'v': {_K}}})"))
add("unwrap_bytes", lambda s, d: flat(lo.over_values(lo.label_format(_typed(s, d), size="{{.k}}KB").withColumn("labels", lb.by(F.col("labels"), ["event_type", "size"])), "size", "sum_over_time", DAYS, RANGE, kind="bytes"), "event_type"), _per_window(f"sum({_K}) * 1000"))
add("unwrap_by", lambda s, d: flat(lo.over_values(lo.parse(events(s, d), lg.parse_json), "k", "max_over_time", DAYS, RANGE, by=["event_type"]), "event_type"), _per_window(f"max({_K})"))
add("log_absent_over_time", lambda s, d: flat(m.absent_over_time(lo.streams(ad.event_logs(s, d), ("event_type", "=", "none")).select("labels", F.col("ts"), F.lit(1.0).alias("value")), DAYS, RANGE, labels={"event_type": "none"}), "event_type"), f"with {_grid(DAYS)} select 'none' as event_type, p as ts, 1.0::double as value from g")
add("log_sum_by_level", lambda s, d: flat(m.aggregate(lo.over_lines(events(s, d), "count_over_time", DAYS, RANGE), "sum", by=["detected_level"]), "detected_level"), _per_window("count(*)").replace("select event_type", f"select {_LEVEL} as detected_level"))
add("log_topk", lambda s, d: flat(m.ranked(m.aggregate(lo.over_lines(events(s, d), "count_over_time", DAYS, RANGE), "sum", by=["user"]), 3, True), "user"),
    f"""with {_grid(DAYS)}, c as (select user_id::varchar as "user", p, count(*)::double as n from events join g on {_T} > p - {RANGE} and {_T} <= p group by 1, 2)
select "user", p as ts, n as value from c qualify row_number() over (partition by p order by n desc, '{{"user":"' || "user" || '"}}') <= 3""")  # fmt: skip
add("log_approx_topk", lambda s, d: flat(m.ranked(m.aggregate(lo.over_lines(events(s, d), "count_over_time", DAYS, RANGE), "sum", by=["user"]), 5, True), "user"),
    f"""with {_grid(DAYS)}, c as (select user_id::varchar as "user", p, count(*)::double as n from events join g on {_T} > p - {RANGE} and {_T} <= p group by 1, 2)
select "user", p as ts, n as value from c qualify row_number() over (partition by p order by n desc, '{{"user":"' || "user" || '"}}') <= 5""")  # fmt: skip
add("unwrap_rate_counter", lambda s, d: flat(lo.over_values(lo.label_format(lo.keep(events(s, d), "event_type"), n="{{__timestamp__}}"), "n", "rate_counter", DAYS, RANGE), "event_type", digits=4),
    _windows().replace("max(value) as v", f"max(epoch_us(ts))::double as v") + _extrapolated("lv - fv + lost", True, True).replace(", 8) as value", ", 4) as value"))
add("log_binary", lambda s, d: flat(mt.binary(lo.over_lines(lo.keep(events(s, d), "event_type"), "bytes_over_time", DAYS, RANGE), "/", lo.over_lines(lo.keep(events(s, d), "event_type"), "count_over_time", DAYS, RANGE)), "event_type"), _per_window("sum(strlen(props)) / count(*)::double"))
add("log_variants", lambda s, d: flat(lo.variants(lo.keep(events(s, d), "event_type"), ["count_over_time", "bytes_over_time"], DAYS, RANGE), "event_type", "__variant__"),
    f"with {_grid(DAYS)}, c as (select event_type, p, count(*)::double as n, sum(strlen(props))::double as b from events join g on {_T} > p - {RANGE} and {_T} <= p group by 1, 2) select event_type, '0' as __variant__, p as ts, n as value from c union all select event_type, '1', p, b from c")

# Discovery.
add("label_names", lambda s, d: md.label_names(events(s, d)), "select unnest(['event_type', 'user', 'detected_level']) as label")
add("label_values", lambda s, d: md.label_values(events(s, d), "user"), "select distinct user_id::varchar as val from events")
add("series_list", lambda s, d: md.series(ad.event_samples(s, d)), """select distinct '{"__name__":"event_value","event_type":"' || event_type || '","user":"' || user_id || '"}' as series from events""")
add("index_stats", lambda s, d: md.stats(docs(s, d)), "select count(distinct (source, lang, doc_id)) as streams, count(*) as entries, sum(strlen(text))::bigint as bytes from documents")
add("index_volume", lambda s, d: md.volume(docs(s, d), ["source", "lang"], 20), "select source, lang, sum(strlen(text))::bigint as bytes from documents group by 1, 2 order by bytes desc, source, lang limit 20")
add("detected_fields", lambda s, d: md.detected_fields(lo.keep(lo.parse(events(s, d), lg.parse_json), "event_type", "detected_level")), "select 'event_type' as field, 'string' as kind, count(distinct event_type) as cardinality from events union all select 'detected_level', 'string', 2")
# all fields, parsed ones too; their number of values is approximate, so tests hold it against the exact one
add("detected_fields_all", lambda s, d: md.detected_fields(lo.parse(events(s, d), lg.parse_json)))
add("line_templates", lambda s, d: md.templates(_formatted(s, d)), f"""with e as (select {_LEVEL} as level, event_type, case when regexp_matches(event_type, '[0-9]') then '<_>' else event_type end as shown from events)
select level, 'level=' || level || ' <_> ' || (case when count(distinct shown) > 1 then '<_>' else 'msg="' || min(shown) end) || ' seen"' as template, count(*) as n from e group by 1 having count(*) >= 30""")
