"""Sources derived from the test tables: SQL text that Spark and DuckDB both run as it stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: The table that each view reads.
BASE = {"a_requests": "events", "a_stdout": "events", "a_stderr": "events", "a_users": "customer", "a_conversations": "conversations", "a_messages": "conversations", "a_message_docs": "conversations", "a_facts": "events"}

VIEWS = {
    "a_requests": """
select ts as timestamp, 'cloud_run_revision' as resource_type,
  case when event_id % 20 = 0 then 'other-svc' else 'source-svc' end as service_name,
  case when event_id % 97 = 0 then null when event_type = 'error' then (case event_id % 3 when 0 then 500 when 1 then 503 else 404 end) else 200 end as status,
  concat(cast(cast(floor(value) as bigint) as string), '.', lpad(cast(event_id % 1000 as string), 3, '0'), 's') as latency,
  case when event_id % 53 = 0 then 'malformed' else concat('https://svc.example.com',
    case event_type when 'click' then '/v2/ask' when 'view' then concat('/v2/conversations/', cast(user_id as string))
      when 'purchase' then '/v2/ask/enhance_full/stream' when 'signup' then '/api/health' else '/v2/asks' end,
    case when event_id % 2 = 0 then '?q=1' else '' end) end as requestUrl,
  case when event_id % 41 = 0 then null else (case user_id % 4 when 0 then 'Mozilla/5.0 (iPhone; CPU)' when 1 then ''
    when 2 then 'Mozilla/5.0 (Windows NT 10.0)' else 'Mozilla/5.0 (Linux; ANDROID 14)' end) end as userAgent
from events
""",
    "a_stdout": """
select ts as timestamp, 'cloud_run_revision' as resource_type,
  case when event_id % 20 = 0 then 'other-svc' else 'source-svc' end as service_name,
  case event_type
    when 'view' then concat('query_suggest_result mode=internal conversation_id=c', cast(user_id as string),
      case when event_id % 37 = 0 then '' when event_id % 5 = 0 then ' stage=degraded' else ' stage=stable' end,
      ' stable=true latency_ms=', cast(cast(floor(value * 10) as bigint) as string),
      case when event_id % 29 = 0 then '' else concat(' suggestion_count=', cast(event_id % 6 as string)) end)
    when 'error' then concat('query_suggest_refine_degraded reason=', case event_id % 3 when 0 then 'timeout' else 'empty' end,
      case when event_id % 11 = 0 then '' else ' fallback=local' end, ' conversation_id=c', cast(user_id as string))
    when 'signup' then concat('chat_sync_telemetry event=', case event_id % 4 when 0 then 'restore_success' when 1 then 'restore_empty'
      when 2 then 'restore_failed' else 'pull_ok' end, ' conversation_id=c', cast(user_id as string), ' detail={"n": ', cast(event_id % 9 as string), '}')
    when 'purchase' then concat('request_user_metric_json=', case when event_id % 31 = 0 then '{bad' when event_id % 43 = 0 then 'null'
      else concat('{"user_id":"', case when event_id % 23 = 0 then '' else concat('u', cast(user_id as string)) end, '","user_email":"U', cast(user_id as string),
        '@Example.com","device_class":"', case event_id % 4 when 0 then 'desktop' when 1 then 'Mobile' when 2 then 'tablet' else '' end,
        '","is_core":', case event_id % 3 when 0 then 'true' when 1 then 'false' else '"1"' end, '}') end)
    else concat('followup_open_result_json=', case when event_id % 31 = 0 then '{bad' when event_id % 19 = 0 then '{"event":{"x":1}}'
      else concat('{"event":"', case event_id % 3 when 0 then 'success' else 'Recognized' end, '","user_id":"u', cast(user_id as string), '","user_email":"U', cast(user_id as string), '@Example.com"}') end)
  end as textPayload
from events
""",
    "a_stderr": """
select ts as timestamp, 'cloud_run_revision' as resource_type, 'source-svc' as service_name,
  case event_id % 4 when 0 then 'worker TimeoutError: upstream' when 1 then 'job sync_failed code=7' when 2 then 'INFO ok' else 'Traceback (most recent call last)' end as textPayload
from events where event_type = 'error'
""",
    "a_users": """
select concat('u', cast(c_custkey as string)) as user_id,
  case when c_custkey % 13 = 0 then '' else concat('U', cast(c_custkey as string), '@Example.com') end as userEmail,
  concat('sub-', cast(c_custkey as string)) as subject,
  case when c_custkey % 17 = 0 then '' when c_custkey % 19 = 0 then 'garbage'
    else concat('2024-01-', lpad(cast(1 + c_custkey % 30 as string), 2, '0'), 'T03:00:00Z') end as updatedAt,
  '2024-01-10T00:00:00+00:00' as lastSeenAt, 'iap' as identitySource, c_custkey % 2 = 0 as identityVerified
from customer
""",
    "a_conversations": """
select distinct concat('u', cast(conv_id % 40 + 40 * cast(floor(conv_id / 400) as bigint) as string)) as user_id, concat('c', cast(conv_id as string)) as conv_id,
  concat('Title ', cast(conv_id as string)) as title,
  case conv_id % 5 when 0 then 'internal' when 1 then ' WebSearch ' when 2 then 'deepthinking' when 3 then 'custom' else '' end as mode,
  case when conv_id % 7 = 0 then 'Hidden' when conv_id % 7 = 1 then '' else 'active' end as visibility,
  conv_id % 3 = 0 as isFavorite,
  case conv_id % 6 when 0 then 'empty_shell' when 1 then 'unknown' when 2 then '' else 'ok' end as integrityState,
  case when conv_id % 4 = 0 then cast(null as bigint) else conv_id % 9 end as messageCount,
  concat('2024-01-', lpad(cast(1 + conv_id % 30 as string), 2, '0'), 'T00:00:00Z') as createdAt,
  concat('2024-01-', lpad(cast(1 + conv_id % 30 as string), 2, '0'), 'T08:00:00Z') as updatedAt
from conversations
""",
    "a_messages": """
select concat('u', cast(conv_id % 40 + 40 * cast(floor(conv_id / 400) as bigint) as string)) as user_id, concat('c', cast(conv_id as string)) as conv_id,
  concat('m', cast(conv_id as string), '-', lpad(cast(turn as string), 3, '0')) as msg_id, role, text as content,
  concat('2024-01-', lpad(cast(1 + conv_id % 30 as string), 2, '0'), 'T', lpad(cast(turn % 24 as string), 2, '0'), ':15:00Z') as timestamp,
  case when (conv_id + turn) % 11 = 0 then 'error' else 'done' end as status,
  case when (conv_id + turn) % 13 = 0 then concat('upstream  failed code ', cast(turn as string)) else '' end as errorMessage,
  case (conv_id + turn) % 9 when 0 then 'good' when 1 then 'bad' when 2 then ' Good ' else '' end as feedback,
  (conv_id + turn) % 2 = 0 as has_citation,
  case (conv_id + turn) % 4 when 0 then 'internal' when 1 then 'websearch' else '' end as modeAtSend,
  case (conv_id + turn) % 10 when 0 then 'new_chat' when 1 then 'continued_chat' else '' end as chatFlowType,
  case when (conv_id + turn) % 8 = 0 then concat('t', cast(turn as string)) else '' end as parentTurnId
from conversations
""",
    "a_message_docs": """
select user_id, conv_id, msg_id, concat('{"role":"', role, '","content":"',
  replace(replace(replace(replace(replace(content, chr(92), concat(chr(92), chr(92))), chr(34), concat(chr(92), chr(34))), chr(10), concat(chr(92), 'n')), chr(13), concat(chr(92), 'r')), chr(9), concat(chr(92), 't')),
  '","timestamp":"', timestamp, '","status":"', status, '","errorMessage":"', errorMessage, '","feedback":"', feedback, '","modeAtSend":"', modeAtSend, '","chatFlowType":"', chatFlowType, '","parentTurnId":"', parentTurnId, '"',
  case n % 6 when 0 then ',"attachmentNames":["plan.pdf",null,"photo 1.png"]' when 1 then ',"attachmentNames":[]' when 2 then ',"attachmentNames":[null],"attachmentFileIds":["f1",7,true,null]'
    when 3 then ',"attachmentNames":null,"attachmentFileIds":"no list"' when 4 then ',"attachmentFileIds":["f2","f3"]' else '' end,
  case n % 8 when 0 then ',"grounded":{"citations":["x"]}' when 1 then ',"grounded":{"citationIndex":[{"a":1}]}' when 2 then ',"grounded":{"citation_index":[1],"citations":[]}' when 3 then ',"grounded":{"sources":["s"]}'
    when 4 then ',"grounded":{"evidence":[null]}' when 5 then ',"grounded":{"sources":"text","evidence":[]}' when 6 then ',"grounded":["citations"]' else '' end,
  ',"turnId":"turn-', cast(n as string), '","clientOrigin":', case when n % 3 = 0 then '"web"' when n % 3 = 1 then 'null' else '{"app":1}' end, '}') as doc
from (select user_id, conv_id, msg_id, role, content, timestamp, status, errorMessage, feedback, modeAtSend, chatFlowType, parentTurnId, number as n from (
{MESSAGES}) m) docs
""",
    "a_facts": """
select concat('u', cast(user_id % 40 + 40 * cast(floor(user_id / 400) as bigint) as string)) as user_id, concat('c', cast(user_id as string)) as conv_id, case when event_id % 15 = 0 then '' else concat(cast(cast(ts as date) as string), 'T12:00:00Z') end as lastEventAt,
  event_id % 12 - 1 as impressions, event_id % 4 as clicks, event_id % 2 as adoptions, case when event_id % 10 = 0 then 1 else 0 end as editAfterAccepts, event_id % 3 as dismisses
from events where event_type = 'view'
""",
}


VIEWS["a_message_docs"] = VIEWS["a_message_docs"].replace("{MESSAGES}", VIEWS["a_messages"].strip().replace("select concat", "select conv_id + turn as number, concat", 1))


#: Schemas of the test tables by path, as they were first found; inferring one takes a job of its own.
_FOUND: dict[str, StructType] = {}


def _base(spark: SparkSession, path: str) -> DataFrame:
    if path not in _FOUND:
        _FOUND[path] = spark.read.parquet(path).schema
    return spark.read.schema(_FOUND[path]).parquet(path)


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base = BASE[name]
    _base(spark, f"{sf_dir}/{base}.parquet").createOrReplaceTempView(f"opsloom_{base}")
    return spark.sql(VIEWS[name].replace(f"from {base}", f"from opsloom_{base}"))


def ctes(*names: str) -> str:
    """The same views for an SQL twin."""
    return "with " + ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in names)
