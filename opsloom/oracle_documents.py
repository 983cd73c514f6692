"""SQL twins of the document queries, for DuckDB over the same tables."""

from __future__ import annotations

from . import oracle
from .operators.documents import COUNTS, RATES
from .plans.window import DEFAULT_TZ, Window
from .sources.adapters import VIEWS, ctes
from .sources.message_documents import GROUNDS


def _at(x: str) -> str:
    return f"try_cast(case when regexp_matches(trim({x}), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then trim({x}) end as timestamp)"


def _local(x: str, tz: str = DEFAULT_TZ) -> str:
    return f"coalesce(strftime({_at(x)} + interval {oracle._LOCAL_HOURS[tz]} hour, '%Y-%m-%d %H:%M:%S'), '')"


def _within(x: str, w: Window, days: int | None = None) -> str:
    start = oracle._t(w.start) if days is None else f"{oracle._t(w.end)} - interval {days} day"
    return f"({x} >= {start} and {x} < {oracle._t(w.end)})"


_BASE = ctes("a_users", "a_conversations", "a_messages", "a_facts")
_USERS = f", u as (select *, {_at('updated_at')} as moment from (select user_id, userEmail as user_email, subject, case when updatedAt = '' then lastSeenAt else updatedAt end as updated_at from a_users where updatedAt is not null))"
_SEEN = ", c as (select * from a_conversations where lower(case when coalesce(visibility, '') = '' then 'active' else visibility end) <> 'hidden' and user_id in (select user_id from u))"


def _activity(w: Window) -> str:
    return f"count(*) filter ({_within('moment', w, 1)}) as dau, count(*) filter ({_within('moment', w, 7)}) as wau, count(*) filter ({_within('moment', w)}) as active_users_in_window, count(*) as users_scanned"


def list_users(limit: int = 100, q: str = "") -> str:
    hit = " or ".join(f"contains(lower({c}), '{q.lower()}')" for c in ("user_id", "userEmail", "subject"))
    return ctes("a_users") + f""" select user_id, case when updatedAt = '' then lastSeenAt else updatedAt end as updated_at, {_local("case when updatedAt = '' then lastSeenAt else updatedAt end")} as updated_at_local,
 lastSeenAt as last_seen_at, {_local('lastSeenAt')} as last_seen_at_local, identitySource as identity_source, identityVerified as identity_verified, userEmail as user_email, subject
 from (select * from a_users where updatedAt is not null order by updatedAt desc, user_id desc limit {limit}) where {hit}"""


def usage(w: Window, by_conversation: bool = False) -> str:
    if by_conversation:
        v, source = f"select lower(trim(feedback)) as f from a_messages join k using (user_id, conv_id) where lower(trim(feedback)) in ('good', 'bad') and ({_at('timestamp')} is null or {_within(_at('timestamp'), w)})", "message_scan"
    else:
        v, source = f"select feedback as f from a_messages where feedback in ('good', 'bad') and {_within(_at('timestamp'), w)}", "collection_group"
    return _BASE + _USERS + _SEEN + f""", k as (select c.* from c join u using (user_id) where u.moment is not null and {_within(_at('c.updatedAt'), w)}),
n as (select case when messageCount >= 0 then messageCount else (select count(*) from a_messages m where m.user_id = k.user_id and m.conv_id = k.conv_id) end as n from k), v as ({v})
select *, '{source}' as feedback_source from (select {_activity(w)} from u), (select count(*) as conversation_count, cast(coalesce(sum(n), 0) as bigint) as message_count from n),
(select count(*) filter (f = 'good') as feedback_good_count, count(*) as feedback_total_count, round(count(*) filter (f = 'good') / nullif(count(*), 0), 6) as feedback_like_rate from v)"""


def suggestion_funnel(w: Window) -> str:
    names = {"impressions": "impressions", "clicks": "clicks", "adoptions": "adoptions", "editAfterAccepts": "edit_after_accepts", "dismisses": "dismisses"}
    sums = ", ".join(f"cast(coalesce(sum(greatest(coalesce({n}, 0), 0)), 0) as bigint) as {a}" for n, a in names.items())
    at = _at("lastEventAt")
    return _BASE + _USERS + _SEEN + f"""select *, round(clicks / nullif(impressions, 0), 6) as click_rate, round(adoptions / nullif(clicks, 0), 6) as adoption_rate, round(edit_after_accepts / nullif(adoptions, 0), 6) as edit_after_accept_rate
 from (select {sums} from a_facts where (user_id, conv_id) in (select (user_id, conv_id) from c) and ({at} is null or {_within(at, w)})), (select count(*) as documents_scanned from c)"""


def _header(prefix: str = "", lower: bool = True, full: bool = False) -> str:
    vis = "case when coalesce(visibility, '') = '' then 'active' else visibility end"
    got = {"title": "title", "mode": "trim(mode)", "updated_at": "updatedAt", "updated_at_local": _local("updatedAt"), "created_at": "createdAt", "created_at_local": _local("createdAt"), "visibility": f"lower({vis})" if lower else vis, "is_favorite": "isFavorite", "message_count": "messageCount", "integrity_state": "integrityState"}
    got |= {"deleted_at": "''", "deleted_at_local": "''", "last_message_preview": "''"} if full else {}
    return ", ".join(f"{v} as {prefix}{k}" for k, v in got.items())


def list_conversations(user: str, include_hidden: bool = False, limit: int = 200, q: str = "") -> str:
    hit = " or ".join(f"contains(lower({c}), '{q.lower()}')" for c in ("conv_id", "title", "mode"))
    return ctes("a_conversations") + f""" select * from (select conv_id, {_header(full=True)} from (select * from a_conversations where user_id = '{user}' and updatedAt is not null order by updatedAt desc, conv_id desc limit {limit}))
 where ({hit})""" + ("" if include_hidden else " and visibility <> 'hidden'")


def conversation(user: str, conv: str) -> str:
    return ctes("a_conversations") + f" select conv_id, {_header(lower=False)} from a_conversations where user_id = '{user}' and conv_id = '{conv}'"


_KIND = """case when lower(trim(chatFlowType)) = 'continued_chat' then 'followup' when lower(trim(chatFlowType)) = 'new_chat' then 'new' when trim(parentTurnId) <> '' then 'followup'
 when lower(trim(role)) = 'user' then case when place = 1 then 'new' else 'followup' end else '' end"""


def _detailed(where: str) -> str:
    """Messages of conversations that meet the condition, each with its place among the user's turns."""
    return f""", k as (select * from a_conversations where {where}), m as (select m.*, k.mode as conv_mode, sum(case when lower(trim(role)) = 'user' then 1 else 0 end) over (partition by m.user_id, m.conv_id order by timestamp, msg_id rows unbounded preceding) as place
 from a_messages m join k using (user_id, conv_id) where timestamp is not null),
d as (select user_id, conv_id, msg_id as message_id, trim(timestamp) as timestamp, {_local('timestamp')} as timestamp_local, trim(case when coalesce(modeAtSend, '') = '' then conv_mode else modeAtSend end) as mode_at_send, {_KIND} as question_kind,
 '' as attachment_names, '' as attachment_file_ids, trim(role) as role, trim(content, ' ' || chr(9) || chr(10) || chr(13)) as content, trim(status) as status, trim(errorMessage) as error_message, trim(feedback) as feedback, trim(chatFlowType) as chat_flow_type,
 '' as conversation_id_at_send, '' as turn_id, trim(parentTurnId) as parent_turn_id, '' as client_origin from m)"""


def messages(user: str, conv: str, limit: int = 500) -> str:
    return ctes("a_conversations", "a_messages") + _detailed(f"user_id = '{user}' and conv_id = '{conv}'") + f" select * exclude (user_id, conv_id) from d order by timestamp, message_id limit {limit}"


def export_messages(user: str, conv: str | None = None, include_hidden: bool = True) -> str:
    which = "updatedAt is not null" if conv is None else f"conv_id = '{conv}'"
    hidden = "" if include_hidden else " and lower(coalesce(visibility, '')) <> 'hidden'"
    cells = ("message_id", "timestamp", "timestamp_local", "mode_at_send", "question_kind", "attachment_names", "attachment_file_ids", "role", "content", "status", "error_message", "feedback", "chat_flow_type", "conversation_id_at_send", "turn_id", "parent_turn_id", "client_origin")
    return _BASE + _detailed(f"user_id = '{user}' and {which}{hidden}") + f""" select b.*, coalesce(a.userEmail, '') as user_email, {', '.join(f"coalesce(d.{x}, '') as {x}" for x in cells)}
 from (select user_id, conv_id, {_header('conversation_', lower=conv is None)} from k) b left join a_users a using (user_id) left join d using (user_id, conv_id)"""


def _messages(w: Window) -> str:
    mode = "lower(trim(case when coalesce(modeAtSend, '') = '' then mode else modeAtSend end))"
    return _BASE + _USERS + _SEEN + f""", m as (select m.*, c.mode, c.isFavorite, c.integrityState, lower(trim(role)) as r, lower(trim(feedback)) as f, lower(trim(status)) = 'error' or trim(errorMessage) <> '' as failed,
 sum(case when lower(trim(role)) = 'user' then 1 else 0 end) over (partition by m.user_id, m.conv_id order by timestamp, msg_id rows unbounded preceding) as place from a_messages m join c using (user_id, conv_id) where {_within(_at('timestamp'), w)}),
g as (select user_id, count(distinct conv_id) as conversation_count, count(*) as message_count, count(*) filter (f = 'good') as feedback_good_count, count(*) filter (f in ('good', 'bad')) as feedback_total_count, count(*) filter (failed) as message_failure_count,
 count(*) filter (r = 'assistant') as assistant_message_count, count(*) filter (r = 'assistant' and has_citation) as citation_covered_count, count(distinct conv_id) filter (isFavorite) as favorite_conversation_count,
 count(distinct conv_id) filter (lower(trim(integrityState)) in ('empty', 'empty_shell', 'unknown')) as integrity_risk_conversation_count, count(*) filter ({mode} = 'internal') as internal_count, count(*) filter ({mode} = 'websearch') as websearch_count,
 count(*) filter (r = 'user' and {_KIND} = 'new') as new_question_count, count(*) filter (r = 'user' and {_KIND} = 'followup') as followup_count from m group by 1),
e as (select user_id, case when trim(errorMessage) = '' then 'unknown' else regexp_replace(trim(errorMessage), '\\s+', ' ', 'g') end as error_reason, count(*) as count from m where failed group by 1, 2)"""


_RATES = ", ".join(f"round({a} / nullif({b}, 0), 6) as {k}" for k, (a, b) in RATES.items()) + ", round(followup_count / nullif(followup_count + new_question_count, 0), 6) as followup_rate, conversation_count as active_conversation_count"


def monitor(w: Window) -> str:
    sums = ", ".join(f"cast(coalesce(sum({n}), 0) as bigint) as {n}" for n in COUNTS)
    return _messages(w) + f" select *, {_RATES} from (select {_activity(w)} from u), (select {sums} from g)"


def monitor_errors(w: Window, n: int = 10) -> str:
    return _messages(w) + f" select error_reason, cast(sum(count) as bigint) as count from e group by 1 order by 2 desc, 1 limit {n}"


def monitor_user_errors(w: Window, n: int = 5) -> str:
    return _messages(w) + f" select * from (select *, cast(row_number() over (partition by user_id order by count desc, error_reason) as int) as place from e) where place <= {n}"


def monitor_users(w: Window) -> str:
    counts = ", ".join(f"cast(coalesce({n}, 0) as bigint) as {n}" for n in COUNTS)
    return _messages(w) + f" select *, {_RATES} from (select user_id, user_email, subject, updated_at, {_local('updated_at', w.tz)} as updated_at_local, {counts} from u left join g using (user_id))"


def _merged(w: Window) -> str:
    counts = ", ".join(f"coalesce({n}, 0) as {n}" for n in (*COUNTS, "active_conversation_count"))
    rates = ", ".join((*RATES, "followup_rate"))
    kinds = ", ".join(f"{k}_request_count" for k in ("core", "system", "desktop", "mobile", "unknown"))
    return f"""with p as ({monitor_users(w)}), r as ({oracle.request_users(w)}), o as ({oracle.followup_users(w)}),
x as (select coalesce(p.user_id, r.user_id) as user_id, coalesce(p.user_email, r.user_email) as user_email, coalesce(subject, '') as subject, coalesce(updated_at, '') as updated_at, coalesce(updated_at_local, '') as updated_at_local, {counts}, {rates},
 request_count as total_request_count, {kinds}, round(desktop_request_count / nullif(request_count, 0), 6) as desktop_request_rate, round(mobile_request_count / nullif(request_count, 0), 6) as mobile_request_rate
 from p full join r on p.user_id = r.user_id and lower(p.user_email) = r.user_email),
y as (select x.*, o.recognized_count as followup_recognized_count, o.success_count as followup_success_count, o.success_rate as followup_open_success_rate from x left join o on x.user_id = o.user_id and lower(x.user_email) = o.user_email)"""


def dashboard_users(w: Window) -> str:
    active = "(message_count > 0 or conversation_count > 0 or coalesce(total_request_count, 0) > 0 or coalesce(core_request_count, 0) > 0)"
    return _merged(w) + f" select * from y where {active} or not exists (select 1 from y where {active})"


_RANK = "message_count desc, coalesce(total_request_count, 0) desc, conversation_count desc, user_id, user_email"


def selected_user(w: Window, lookup: str) -> str:
    key = lookup.lower()
    return _merged(w) + f" select * from y where contains(lower(user_id), '{key}') or contains(lower(user_email), '{key}') order by {_RANK} limit 1"


def selected_series(w: Window, lookup: str) -> str:
    key = f"(select user_id from ({selected_user(w, lookup)}) where total_request_count > 0)"
    return "select * from (" + oracle.user_series(w, "@").replace("'@'", key) + f") where exists {key}"


def dashboard_summary(w: Window) -> str:
    return f"""select dau, wau, active_users_in_window, active_session_stickiness, conversation_count, message_count, feedback_like_rate, message_failure_rate, citation_coverage_rate,
 first_answer_avg_ms, enhance_answer_avg_ms, qs_stable_rate, qs_avg_latency_ms, restore_success_rate, request_count, core_request_count, error_5xx_rate, request_p95_latency_ms,
 a as followup_recognized_count, b as followup_success_count, round(b / nullif(a, 0), 6) as followup_open_success_rate from ({monitor(w)}), ({oracle.overview(w)}),
 (select cast(coalesce(sum(recognized_count), 0) as bigint) as a, cast(coalesce(sum(success_count), 0) as bigint) as b from ({oracle.followup_users(w)}))"""


def _joined(name: str) -> str:
    word = "case when x is null or json_type(x) = 'NULL' then 'None' when json_type(x) = 'BOOLEAN' then case cast(x as varchar) when 'true' then 'True' else 'False' end else json_extract_string(x, '$') end"
    return f"case when json_type(d, '$.{name}') = 'ARRAY' then array_to_string(list_transform(cast(json_extract(d, '$.{name}') as json[]), lambda x: {word}), '|') else '' end"


def _member(name: str) -> str:
    return f"case when json_type(d, '$.{name}') in ('OBJECT', 'ARRAY', 'NULL') then null else json_extract_string(d, '$.{name}') end as {name}"


def of_documents(sql: str) -> str:
    """A twin over messages, taken out of whole documents."""
    texts = ("role", "content", "timestamp", "status", "errorMessage", "feedback", "modeAtSend", "chatFlowType", "parentTurnId", "turnId", "clientOrigin")
    cited = " or ".join(f"coalesce(json_array_length(d, '$.grounded.{g}'), 0) > 0" for g in GROUNDS)
    rows = f"select user_id, conv_id, msg_id, {', '.join(map(_member, texts))}, {_joined('attachmentNames')} as names, {_joined('attachmentFileIds')} as files, {cited} as has_citation from (select *, cast(doc as json) as d from a_message_docs)"
    sql = sql.replace(f"a_messages as ({VIEWS['a_messages'].strip()})", f"a_message_docs as ({VIEWS['a_message_docs'].strip()}), a_messages as ({rows})")
    return sql.replace("'' as attachment_names, '' as attachment_file_ids", "names as attachment_names, files as attachment_file_ids").replace("'' as turn_id", "coalesce(turnId, '') as turn_id").replace("'' as client_origin", "coalesce(clientOrigin, '') as client_origin")
