"""SQL twins of the queries, for DuckDB over the same tables."""

from __future__ import annotations

from .plans.window import Window
from .sources.adapters import ctes

_LOCAL_HOURS = {"Asia/Tokyo": 9, "UTC": 0}


def _t(x) -> str:
    return f"timestamp '{x:%Y-%m-%d %H:%M:%S}'"


def _in(w: Window, service: bool = True) -> str:
    return f"timestamp >= {_t(w.start)} and timestamp < {_t(w.end)}" + (" and service_name = 'source-svc' and resource_type = 'cloud_run_revision'" if service else "")


def _requests(w: Window) -> str:
    return ctes("a_requests") + f""", r as (select *, regexp_matches(path, '^/v2/(ask|conversations)(/|$)') as is_core, status >= 500 as is_5xx from (
 select timestamp, cast(status as bigint) as status, try_cast(nullif(regexp_extract(latency, '([0-9.]+)', 1), '') as double) * 1000 as latency_ms,
  coalesce(nullif(regexp_extract(requestUrl, 'https?://[^/]+(/[^? ]*)', 1), ''), '/unknown') as path,
  case when regexp_matches(lower(userAgent), '(iphone|android|mobile|ipad)') then 'mobile' when userAgent is null or userAgent = '' then 'unknown' else 'desktop' end as device_class
 from a_requests where {_in(w)}))"""


def _lines(w: Window, prefix: str) -> str:
    return f"select timestamp, textPayload as line from a_stdout where {_in(w)} and starts_with(textPayload, '{prefix}')"


def _kv(key: str) -> str:
    return f"nullif(regexp_extract(line, '{key}=([^ ]+)', 1), '')"


def _num(key: str) -> str:
    return f"try_cast(nullif(regexp_extract(line, '{key}=([0-9]+)', 1), '') as bigint)"


_COUNTS = "count(*) as request_count, count(*) filter (is_core) as core_request_count, count(*) filter (not is_core) as system_request_count, count(*) filter (is_5xx) as error_5xx_count"
_P95 = "round(quantile_disc(latency_ms, 0.95), 6)"


def _bucket(w: Window, ts: str) -> str:
    t = f"({ts} + interval {_LOCAL_HOURS[w.tz]} hour)"
    return f"cast({t} as date)" if w.by_day else f"date_trunc('hour', {t}) + to_minutes(cast(floor(minute({t}) / {w.bucket_minutes}) * {w.bucket_minutes} as int))"


def _grid(w: Window) -> str:
    step = "interval 1 day" if w.by_day else f"interval {w.bucket_minutes} minute"
    first = _bucket(w, _t(w.start))
    last = f"{_t(w.end)} - interval 1 second + interval {_LOCAL_HOURS[w.tz]} hour"
    return f"select {'cast(b as date)' if w.by_day else 'b'} as bucket from unnest(generate_series(cast({first} as timestamp), {last}, {step})) u(b)"


def _labels(w: Window) -> str:
    key, label = ("%Y-%m-%d", "%m-%d") if w.by_day else ("%Y-%m-%d %H:%M", "%H:%M" if w.seconds <= 86400 else "%m-%d %H:%M")
    return f"strftime(bucket, '{key}') as bucket_key, strftime(bucket, '{label}') as bucket_label"


_DEVICES = "(values ('desktop'), ('mobile'), ('unknown')) d(device_class)"


def overview(w: Window) -> str:
    mean = lambda paths: f"round(avg(latency_ms) filter (status < 500 and path in {paths}), 6)"
    return _requests(w) + f""", a_stdout as ({ctes('a_stdout').split(' as (', 1)[1][:-1]}),
q as (select {_kv('stage')} as stage, {_num('latency_ms')} as l, {_num('suggestion_count')} as n from ({_lines(w, 'query_suggest_result ')})),
t as (select {_kv('event')} as event from ({_lines(w, 'chat_sync_telemetry ')}) where contains(line, 'event=restore_'))
select * from (select {_COUNTS}, {_P95} as request_p95_latency_ms, {mean("('/v2/ask', '/v2/ask/stream')")} as first_answer_avg_ms, {mean("('/v2/ask/enhance_full', '/v2/ask/enhance_full/stream')")} as enhance_answer_avg_ms,
 round(count(*) filter (is_5xx) / nullif(count(*), 0), 6) as error_5xx_rate from r),
(select count(*) as qs_total, count(*) filter (stage = 'stable') as qs_stable_count, count(*) filter (stage = 'degraded') as qs_degraded_count, round(avg(l), 6) as qs_avg_latency_ms, round(avg(n), 6) as qs_avg_suggestion_count, round(count(*) filter (stage = 'stable') / nullif(count(*), 0), 6) as qs_stable_rate from q),
(select count(*) as restore_total, count(*) filter (event in ('restore_success', 'restore_empty')) as restore_success_count, round(count(*) filter (event in ('restore_success', 'restore_empty')) / nullif(count(*), 0), 6) as restore_success_rate from t)"""


def usage(w: Window) -> str:
    return _requests(w) + f""", g as ({_grid(w)}), a as (select {_bucket(w, 'timestamp')} as bucket, device_class, {_COUNTS}, {_P95} as p95 from r group by all)
select {_labels(w)}, device_class, coalesce(request_count, 0) as request_count, coalesce(core_request_count, 0) as core_request_count, coalesce(system_request_count, 0) as system_request_count, coalesce(error_5xx_count, 0) as error_5xx_count,
 coalesce(round(error_5xx_count / request_count, 6), 0.0::double) as error_5xx_rate, coalesce(p95, 0.0::double) as p95_latency_ms from g cross join {_DEVICES} left join a using (bucket, device_class)"""


def error_trend(w: Window) -> str:
    return _requests(w) + f", g as ({_grid(w)}), a as (select {_bucket(w, 'timestamp')} as bucket, count(*) as n from r where is_5xx group by all) select {_labels(w)}, coalesce(n, 0) as error_5xx_count from g left join a using (bucket)"


def top_endpoints(w: Window) -> str:
    return _requests(w) + " select path as endpoint, count(*) as error_5xx_count from r where is_5xx group by all order by 2 desc, 1 limit 30"


def top_errors(w: Window) -> str:
    return ctes("a_stdout", "a_stderr") + f""", l as (select textPayload as line from a_stderr where {_in(w)} union all select textPayload from a_stdout where {_in(w)})
select coalesce(nullif(regexp_extract(line, '([A-Za-z_][A-Za-z0-9_]*(?:Error|Exception|Failed|Timeout|Conflict))', 1), ''), nullif(regexp_extract(line, '([a-z_]+(?:_failed|_error|_timeout|_conflict))', 1), ''), 'unknown') as error_type, count(*) as count
from l where regexp_matches(lower(line), '(error|exception|failed|timeout|traceback|conflict)') group by all order by 2 desc, 1 limit 30"""


def devices(w: Window) -> str:
    return _requests(w) + f" select device_class, count(*) as request_count, count(*) filter (is_5xx) as error_5xx_count, {_P95} as p95_latency_ms, round(count(*) filter (is_5xx) / count(*), 6) as error_5xx_rate from r group by all"


def suggest_stages(w: Window) -> str:
    return ctes("a_stdout") + f" select {_kv('stage')} as stage, count(*) as count, round(avg({_num('latency_ms')}), 6) as avg_latency_ms, round(avg({_num('suggestion_count')}), 6) as avg_suggestion_count from ({_lines(w, 'query_suggest_result ')}) group by 1"


def suggest_fallbacks(w: Window) -> str:
    return ctes("a_stdout") + f" select {_kv('fallback')} as fallback_source, {_kv('reason')} as reason, count(*) as count from ({_lines(w, 'query_suggest_refine_degraded ')}) group by 1, 2"


def _json(w: Window, name: str) -> str:
    body = f"regexp_extract(line, '{name}_json=(.*)$', 1)"
    return ctes("a_stdout") + f", j as (select timestamp, cast(b as json) as p from (select timestamp, {body} as b from ({_lines(w, name + '_json=')})) where json_valid(b))"


def _scalar(key: str) -> str:
    return f"case when json_type(p, '$.{key}') in ('OBJECT', 'ARRAY') then null else json_extract_string(p, '$.{key}') end"


def followups(w: Window) -> str:
    return _json(w, "followup_open_result") + f""", f as (select lower(coalesce(nullif({_scalar('event')}, ''), 'unknown')) as event_name, coalesce(nullif({_scalar('user_id')}, ''), 'unknown') as user_id, lower(coalesce({_scalar('user_email')}, '')) as user_email from j)
select event_name, user_id, user_email, count(*) as event_count from f group by all"""


def followup_users(w: Window) -> str:
    return f"""select user_id, user_email, cast(coalesce(sum(event_count) filter (event_name = 'recognized'), 0) as bigint) as recognized_count, cast(coalesce(sum(event_count) filter (event_name = 'success'), 0) as bigint) as success_count,
 round(coalesce(sum(event_count) filter (event_name = 'success'), 0) / nullif(coalesce(sum(event_count) filter (event_name = 'recognized'), 0), 0), 6) as success_rate from ({followups(w)}) group by 1, 2"""


def _user_requests(w: Window) -> str:
    b = _scalar("is_core")
    return _json(w, "request_user_metric") + f", u as (select timestamp, nullif({_scalar('user_id')}, '') as user_id, lower(coalesce({_scalar('user_email')}, '')) as user_email, lower(coalesce(nullif({_scalar('device_class')}, ''), 'unknown')) as device_class, coalesce(case lower({b}) when 'true' then true when 'false' then false end, false) as is_core from j)"


def request_users(w: Window) -> str:
    by = ", ".join(f"count(*) filter (device_class = '{d}') as {d}_request_count" for d in ("desktop", "mobile", "unknown"))
    return _user_requests(w) + f" select coalesce(user_id, 'unknown') as user_id, user_email, count(*) as request_count, count(*) filter (is_core) as core_request_count, count(*) filter (not is_core) as system_request_count, {by} from u group by 1, 2"


def user_series(w: Window, key: str) -> str:
    return _user_requests(w) + f""", g as ({_grid(w)}), a as (select {_bucket(w, 'timestamp')} as bucket, device_class, count(*) as n, count(*) filter (is_core) as c from u where lower(user_id) = '{key}' or user_email = '{key}' group by all)
select {_labels(w)}, device_class, coalesce(n, 0) as request_count, coalesce(c, 0) as core_request_count, greatest(coalesce(n, 0) - coalesce(c, 0), 0) as system_request_count from g cross join {_DEVICES} left join a using (bucket, device_class)"""


def _counter_rows() -> str:
    def one(name, cond):
        return f"select timestamp, '{name}' as metric from a_stdout where service_name = 'source-svc' and {cond}"

    return ctes("a_requests", "a_stdout") + ", c as (" + " union all ".join(["select timestamp, 'error_5xx' as metric from a_requests where service_name = 'source-svc' and status >= 500", one("qs_total", "starts_with(textPayload, 'query_suggest_result ')"), one("qs_degraded", "regexp_matches(textPayload, '^query_suggest_result .* stage=degraded ')"), one("restore_total", "regexp_matches(textPayload, '^chat_sync_telemetry .*event=restore_')"), one("restore_failed", "regexp_matches(textPayload, '^chat_sync_telemetry .*event=restore_failed')")]) + ")"


def log_counters(w: Window) -> str:
    return _counter_rows() + f" select metric, count(*) as count from c where {_in(w, False)} group by 1"


def alert(name: str, metric: str, least: int, seconds: int) -> str:
    return _counter_rows() + f" select '{name}' as alert, cast(floor(epoch(timestamp) / {seconds}) * {seconds} as bigint) as window_start, count(*) as count from c where metric = '{metric}' group by 2 having count(*) >= {least}"


def view(name: str) -> str:
    ts, own = "strftime(timestamp, '%Y-%m-%d %H:%M:%S') as ts", "service_name = 'source-svc' and resource_type = 'cloud_run_revision'"
    if name == "v_requests":
        return ctes("a_requests") + f""" select {ts}, cast(status as bigint) as status, 'GET' as method, requestUrl as request_url, try_cast(nullif(regexp_extract(latency, '([0-9.]+)', 1), '') as double) * 1000 as latency_ms, lower(userAgent) as user_agent,
 case when regexp_matches(lower(userAgent), '(iphone|android|mobile|ipad)') then 'mobile' when userAgent is null or userAgent = '' then 'unknown' else 'desktop' end as device_class, service_name from a_requests where {own}"""
    prefix, columns = {
        "v_query_suggest_results": ("query_suggest_result ", ", ".join([f"{_kv(k)} as {k}" for k in ("mode", "conversation_id", "stage", "stable")] + [f"{_num(k)} as {k}" for k in ("latency_ms", "suggestion_count")])),
        "v_query_suggest_degraded": ("query_suggest_refine_degraded ", f"{_kv('reason')} as reason, {_kv('fallback')} as fallback_source, {_kv('conversation_id')} as conversation_id"),
        "v_sync_telemetry": ("chat_sync_telemetry ", f"{_kv('event')} as event, {_kv('conversation_id')} as conversation_id, nullif(regexp_extract(line, 'detail=(\\{{.*\\}})$', 1), '') as detail_json"),
    }[name]
    return ctes("a_stdout") + f" select {ts}, {columns} from (select timestamp, textPayload as line from a_stdout where {own} and starts_with(textPayload, '{prefix}'))"
