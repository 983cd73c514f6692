"""Users, conversations and messages: listings, exports, usage and quality metrics, and the dashboard merge.

Messages are counted by conversation before anything is joined, so a very long conversation is combined inside the
map tasks. The metrics cover all users; limits exist only in the listings, where they are the feature. A document
without the field that a listing sorts by is not listed. Times are compared as instants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.window import DEFAULT_TZ, Window
from ..sources.message_documents import GROUNDS
from ..sources.tables import Sources, of_days
from . import logs

CONV = ["user_id", "conv_id"]
#: Modes with a count of their own, states of damaged conversations.
COUNTED_MODES = ("internal", "websearch")
RISKY = ("empty", "empty_shell", "unknown")
TOP_REASONS, TOP_USER_REASONS = 10, 5


def _text(df: DataFrame, name: str) -> Column:
    return S.trimmed(F.col(name).cast("string")) if name in df.columns else F.lit("")


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _filled(c: Column, other: Column) -> Column:
    """``other`` where ``c`` is null or empty (blanks count as text)."""
    return F.coalesce(F.nullif(c, F.lit("")), other)


def _local_text(c: Column, tz: str) -> Column:
    return F.coalesce(F.date_format(S.local(S.iso_time(c), tz), "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def _instant(m: DataFrame) -> Column:
    """A message's time: parsed when it was stored, or now."""
    return F.col("at") if "at" in m.columns else S.iso_time(F.col("timestamp"))


def _within(c: Column, w: Window, days: int | None = None) -> Column:
    start = F.lit(w.start) if days is None else F.lit(w.end) - F.expr(f"interval {days} day")
    return (c >= start) & (c < F.lit(w.end))


def _visibility() -> Column:
    return S.trimmed(_filled(F.col("visibility"), F.lit("active")))


def _keyword(df: DataFrame, q: str, *names: str) -> DataFrame:
    key = q.strip().lower()
    hit = F.lit(not key)
    for n in names if key else ():
        hit = hit | F.lower(n).contains(key)
    return df.where(hit)


def list_users(src: Sources, limit: int = 100, q: str = "", tz: str = DEFAULT_TZ) -> DataFrame:
    """The users last updated; the keyword filters what the limit has left."""
    u = src.users.where("updatedAt is not null").orderBy(F.desc("updatedAt"), F.desc("user_id")).limit(max(1, min(limit or 100, 2000)))
    at, seen = S.trimmed(_filled(F.col("updatedAt"), F.col("lastSeenAt"))), _text(u, "lastSeenAt")
    out = u.select("user_id", at.alias("updated_at"), _local_text(at, tz).alias("updated_at_local"), seen.alias("last_seen_at"), _local_text(seen, tz).alias("last_seen_at_local"), _text(u, "identitySource").alias("identity_source"), _flag("identityVerified").alias("identity_verified"), _text(u, "userEmail").alias("user_email"), _text(u, "subject").alias("subject"))
    return _keyword(out, q, "user_id", "user_email", "subject")


def _users(src: Sources) -> DataFrame:
    """Every user with the instant of its last update, null where that cannot be parsed."""
    u = src.users.where("updatedAt is not null")
    seen = _text(u, "lastSeenAt")
    text = _filled(S.trimmed(_filled(F.col("updatedAt"), F.col("lastSeenAt"))), seen)
    return u.select("user_id", _text(u, "userEmail").alias("user_email"), _text(u, "subject").alias("subject"), text.alias("updated_at"), S.iso_time(text).alias("at"))


def _activity(w: Window) -> list[Column]:
    at = F.col("at")
    return [F.count_if(_within(at, w, 1)).alias("dau"), F.count_if(_within(at, w, 7)).alias("wau"), F.count_if(_within(at, w)).alias("active_users_in_window"), F.count("*").alias("users_scanned")]


def _visible(src: Sources, users: DataFrame) -> DataFrame:
    """Conversations of those users that are not hidden."""
    return src.conversations.where(F.lower(_visibility()) != "hidden").join(users.select("user_id"), "user_id", "left_semi")


def _total(*names: str) -> list[Column]:
    return [F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in names]


def usage(src: Sources, w: Window, by_conversation: bool = False) -> DataFrame:
    """One row of activity, volume and feedback. Feedback is counted over all messages by its exact value, or
    (``by_conversation``) over visible conversations of the window, blanks and case ignored."""
    users = _users(src)
    conv = _visible(src, users.where("at is not null")).where(_within(S.iso_time(F.col("updatedAt")), w))
    m = src.messages
    kids = src.message_counts.groupBy(*CONV).agg(F.sum("n").alias("kids")) if src.has("message_counts") else m.groupBy(*CONV).agg(F.count("*").alias("kids"))
    m = of_days(m, w.start, w.end, undated=by_conversation)
    volume = conv.select(*CONV, "messageCount").join(kids, CONV, "left").select(F.when(F.col("messageCount") >= 0, F.col("messageCount")).otherwise(F.coalesce("kids", F.lit(0))).alias("n"))
    volume = volume.agg(F.count("*").alias("conversation_count"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("message_count"))
    value = F.lower(_text(m, "feedback")) if by_conversation else F.col("feedback")
    at = S.iso_time(_filled(F.col("timestamp"), _text(m, "updatedAt"))) if by_conversation and "updatedAt" in m.columns else _instant(m)
    keep = _within(at, w) | at.isNull() if by_conversation else _within(at, w)
    votes = m.where(value.isin("good", "bad") & keep).groupBy(*CONV).agg(F.count_if(value == "good").alias("feedback_good_count"), F.count("*").alias("feedback_total_count"))
    votes = votes.join(conv.select(*CONV), CONV, "left_semi") if by_conversation else votes
    votes = votes.agg(*_total("feedback_good_count", "feedback_total_count"))
    row = users.agg(*_activity(w)).crossJoin(volume).crossJoin(votes)
    return row.withColumns({"feedback_like_rate": S.rate(F.col("feedback_good_count"), F.col("feedback_total_count")), "feedback_source": F.lit("message_scan" if by_conversation else "collection_group")})


#: The counters of a suggestion fact.
FACT_COUNTS = {"impressions": "impressions", "clicks": "clicks", "adoptions": "adoptions", "editAfterAccepts": "edit_after_accepts", "dismisses": "dismisses"}


def suggestion_facts(src: Sources, conv: DataFrame) -> DataFrame:
    """Facts of those conversations (user_id, conv_id): of the runtime summary if it is a filled object,
    else of the runtime document. Members of the array that are no objects are skipped, counts below zero are zero."""
    summary = F.try_parse_json("querySuggestRuntimeSummary")
    filled = F.coalesce(F.schema_of_variant(summary).rlike("^OBJECT<.+>"), F.lit(False))
    rows = conv.select(*CONV).join(src.summaries, CONV, "left").join(src.runtime, CONV, "left").select(*CONV, F.when(filled, F.col("querySuggestRuntimeSummary")).otherwise(F.col("payload")).alias("payload"))
    rows = rows.select(*CONV, F.explode(F.from_json("payload", "suggestionFacts array<variant>")["suggestionFacts"]).alias("fact"))
    rows = rows.where(F.schema_of_variant("fact").startswith("OBJECT"))
    count = lambda n: F.greatest(F.coalesce(F.try_variant_get("fact", f"$.{n}", "bigint"), F.lit(0)), F.lit(0))
    return rows.select(*CONV, F.try_variant_get("fact", "$.lastEventAt", "string").alias("lastEventAt"), *[count(n).alias(a) for n, a in FACT_COUNTS.items()])


def suggestion_funnel(src: Sources, w: Window) -> DataFrame:
    """Sums and rates of suggestion facts of visible conversations; a fact without a time counts in every window."""
    conv = _visible(src, _users(src))
    at = S.iso_time(F.col("lastEventAt"))
    facts = suggestion_facts(src, conv)
    sums = facts.where(_within(at, w) | at.isNull()).agg(*_total(*FACT_COUNTS.values()))
    rates = {"click_rate": ("clicks", "impressions"), "adoption_rate": ("adoptions", "clicks"), "edit_after_accept_rate": ("edit_after_accepts", "adoptions")}
    return sums.withColumns({k: S.rate(F.col(a), F.col(b)) for k, (a, b) in rates.items()}).crossJoin(conv.agg(F.count("*").alias("documents_scanned")))


def _header(c: DataFrame, tz: str, lower: bool = True) -> dict[str, Column]:
    times = {}
    for a, n in (("updated_at", "updatedAt"), ("created_at", "createdAt"), ("deleted_at", "deletedAt")):
        times |= {a: _text(c, n), f"{a}_local": _local_text(_text(c, n), tz)}
    vis = F.lower(_visibility()) if lower else _visibility()
    return {"title": _text(c, "title"), "mode": _text(c, "mode")} | times | {"visibility": vis, "is_favorite": _flag("isFavorite"), "message_count": F.col("messageCount"), "integrity_state": _text(c, "integrityState"), "last_message_preview": _text(c, "lastMessagePreview")}


def list_conversations(src: Sources, user: str, include_hidden: bool = False, limit: int = 200, q: str = "", tz: str = DEFAULT_TZ) -> DataFrame:
    """A user's conversations last updated; hidden ones and the keyword are filtered after the limit."""
    c = src.conversations.where((F.col("user_id") == user.strip()) & F.col("updatedAt").isNotNull())
    c = c.orderBy(F.desc("updatedAt"), F.desc("conv_id")).limit(max(1, min(limit or 200, 500)))
    out = c.select("conv_id", *[v.alias(k) for k, v in _header(c, tz).items()])
    out = out if include_hidden else out.where("visibility <> 'hidden'")
    return _keyword(out, q, "conv_id", "title", "last_message_preview", "mode")


def conversation(src: Sources, user: str, conv: str, tz: str = DEFAULT_TZ) -> DataFrame:
    """One conversation's header; no row if there is none."""
    c = src.conversations.where((F.col("user_id") == user.strip()) & (F.col("conv_id") == conv.strip()))
    h = _header(c, tz, lower=False)
    return c.select("conv_id", *[h[k].alias(k) for k in h if not k.startswith(("deleted", "last_"))])


def _stated_kind(m: DataFrame) -> Column:
    """What flow or parent turn say about a message; null where the turn's place has to."""
    flow = F.lower(_text(m, "chatFlowType"))
    return F.when(flow == "continued_chat", "followup").when(flow == "new_chat", "new").when(_text(m, "parentTurnId") != "", "followup")


def _is_user(m: DataFrame) -> Column:
    return F.lower(_text(m, "role")) == "user"


def _detailed(src: Sources, conv: DataFrame, tz: str) -> DataFrame:
    """Messages of those conversations (user_id, conv_id, mode), with the kind of question each one is."""
    m = src.messages.where("timestamp is not null").join(conv.select(*CONV, _text(conv, "mode").alias("conv_mode")), CONV)
    first = F.min(F.when(_is_user(m), F.struct("timestamp", "msg_id"))).over(Over.partitionBy(*CONV))
    by_place = F.when(_is_user(m), F.when(F.struct("timestamp", "msg_id") == first, "new").otherwise("followup")).otherwise("")
    joined = lambda n: F.coalesce(F.array_join(n, "|", "None"), F.lit("")) if n in m.columns else F.lit("")
    names = {"role": "role", "content": "content", "status": "status", "error_message": "errorMessage", "feedback": "feedback", "chat_flow_type": "chatFlowType", "conversation_id_at_send": "conversationIdAtSend", "turn_id": "turnId", "parent_turn_id": "parentTurnId", "client_origin": "clientOrigin"}
    at = _text(m, "timestamp")
    return m.select(*CONV, F.col("timestamp").alias("_at"), F.col("msg_id").alias("message_id"), at.alias("timestamp"), _local_text(at, tz).alias("timestamp_local"), S.trimmed(_filled(F.col("modeAtSend"), F.col("conv_mode"))).alias("mode_at_send"), F.coalesce(_stated_kind(m), by_place).alias("question_kind"), joined("attachmentNames").alias("attachment_names"), joined("attachmentFileIds").alias("attachment_file_ids"), *[_text(m, n).alias(a) for a, n in names.items()])


def messages(src: Sources, user: str, conv: str, limit: int = 500, tz: str = DEFAULT_TZ) -> DataFrame:
    """A conversation's first messages, in order."""
    c = src.conversations.where((F.col("user_id") == user.strip()) & (F.col("conv_id") == conv.strip()))
    return _detailed(src, c, tz).orderBy("_at", "message_id").limit(max(1, min(limit or 500, 2000))).drop("_at", *CONV)


def export_messages(src: Sources, user: str, conv: str | None = None, include_hidden: bool = True, tz: str = DEFAULT_TZ) -> DataFrame:
    """Every message of a user, or of one conversation, with its conversation and user; a conversation without
    messages gives one row of empty message fields."""
    c = src.conversations.where(F.col("user_id") == user.strip())
    c = c.where("updatedAt is not null") if conv is None else c.where(F.col("conv_id") == conv.strip())
    h = _header(c, tz, lower=conv is None)
    c = c if include_hidden else c.where(F.lower(_visibility()) != "hidden")
    base = c.select(*CONV, *[h[k].alias(f"conversation_{k}") for k in h if not k.startswith(("deleted", "last_"))])
    who = src.users.select("user_id", _text(src.users, "userEmail").alias("user_email"))
    m = _detailed(src, c, tz).drop("_at")
    cells = [x for x in m.columns if x not in CONV]
    rows = base.join(who, "user_id", "left").join(m, CONV, "left")
    return rows.select(*CONV, F.coalesce("user_email", F.lit("")).alias("user_email"), *[x for x in base.columns if x not in CONV], *[F.coalesce(x, F.lit("")).alias(x) for x in cells])


COUNTS = ("conversation_count", "message_count", "feedback_good_count", "feedback_total_count", "message_failure_count", "assistant_message_count", "citation_covered_count", "favorite_conversation_count", "integrity_risk_conversation_count", "internal_count", "websearch_count", "new_question_count", "followup_count")
RATES = {"active_session_stickiness": ("message_count", "conversation_count"), "feedback_like_rate": ("feedback_good_count", "feedback_total_count"), "message_failure_rate": ("message_failure_count", "message_count"), "citation_coverage_rate": ("citation_covered_count", "assistant_message_count"), "favorite_conversation_rate": ("favorite_conversation_count", "conversation_count"), "integrity_risk_rate": ("integrity_risk_conversation_count", "conversation_count")}


def _rated(df: DataFrame) -> DataFrame:
    rates = {k: S.rate(F.col(a), F.col(b)) for k, (a, b) in RATES.items()}
    rates["followup_rate"] = S.rate(F.col("followup_count"), F.col("followup_count") + F.col("new_question_count"))
    return df.withColumns({"active_conversation_count": F.col("conversation_count")} | rates)


def _failed(m: DataFrame) -> Column:
    return (F.lower(_text(m, "status")) == "error") | (_text(m, "errorMessage") != "")


def _window_messages(src: Sources, w: Window) -> DataFrame:
    m = of_days(src.messages, w.start, w.end)
    return m.where(_within(_instant(m), w))


def _by_user(src: Sources, w: Window) -> DataFrame:
    """Counts by user id, whether there is such a user or not, over visible conversations with a message in the window."""
    m = _window_messages(src, w)
    role, said, placed = F.lower(_text(m, "role")), _stated_kind(m), _is_user(m) & _stated_kind(m).isNull()
    grounded = [F.size(f"grounded.{g}") > 0 for g in GROUNDS if "grounded" in m.columns and g in m.schema["grounded"].dataType.names]
    cited = F.coalesce(F.array_max(F.array(*grounded)), F.lit(False)) if grounded else F.lit(False)
    mode, vote = F.coalesce(F.col("modeAtSend"), F.lit("")), F.lower(_text(m, "feedback"))
    per = m.groupBy(*CONV).agg(
        F.count("*").alias("message_count"), F.count_if(role == "assistant").alias("assistant_message_count"), F.count_if((role == "assistant") & cited).alias("citation_covered_count"),
        F.count_if(_failed(m)).alias("message_failure_count"), F.count_if(vote == "good").alias("feedback_good_count"), F.count_if(vote.isin("good", "bad")).alias("feedback_total_count"),
        *[F.count_if(F.lower(S.trimmed(mode)) == x).alias(f"{x}_count") for x in COUNTED_MODES], F.count_if(mode == "").alias("unmoded"),
        F.count_if(_is_user(m) & (said == "new")).alias("new_said"), F.count_if(_is_user(m) & (said == "followup")).alias("followup_said"), F.count_if(placed).alias("placed"),
        F.min(F.when(_is_user(m), F.struct("timestamp", "msg_id", placed.cast("int").alias("placed")))).getField("placed").alias("first_placed"),
    )
    conv = src.conversations.where(F.lower(_visibility()) != "hidden")
    conv = conv.select(*CONV, F.lower(_text(conv, "mode")).alias("mode"), _flag("isFavorite").cast("int").alias("favorite_conversation_count"), F.lower(_text(conv, "integrityState")).isin(*RISKY).cast("int").alias("integrity_risk_conversation_count"), F.lit(1).alias("conversation_count"))
    first = F.coalesce("first_placed", F.lit(0))
    more = {f"{x}_count": F.col(f"{x}_count") + F.when(F.col("mode") == x, F.col("unmoded")).otherwise(0) for x in COUNTED_MODES}
    more |= {"new_question_count": F.col("new_said") + first, "followup_count": F.col("followup_said") + F.col("placed") - first}
    return conv.join(per, CONV).withColumns(more).groupBy("user_id").agg(*_total(*COUNTS))


def monitor(src: Sources, w: Window) -> DataFrame:
    """One row of quality metrics over all users."""
    return _rated(_users(src).join(_by_user(src, w), "user_id", "left").agg(*_activity(w), *_total(*COUNTS)))


def _reasons(src: Sources, w: Window) -> DataFrame:
    m = _window_messages(src, w)
    got = m.where(_failed(m)).groupBy(*CONV, S.short_reason(F.col("errorMessage")).alias("error_reason")).agg(F.count("*").alias("count"))
    return got.join(_visible(src, _users(src)).select(*CONV), CONV, "left_semi").groupBy("user_id", "error_reason").agg(F.sum("count").alias("count"))


def monitor_errors(src: Sources, w: Window, n: int = TOP_REASONS) -> DataFrame:
    got = _reasons(src, w).groupBy("error_reason").agg(F.sum("count").alias("count"))
    return got.orderBy(F.desc("count"), "error_reason").limit(n)


def monitor_user_errors(src: Sources, w: Window, n: int = TOP_USER_REASONS) -> DataFrame:
    """The commonest reasons of each user."""
    place = F.row_number().over(Over.partitionBy("user_id").orderBy(F.desc("count"), "error_reason"))
    return _reasons(src, w).withColumn("place", place).where(F.col("place") <= n)


def monitor_users(src: Sources, w: Window) -> DataFrame:
    """The metrics of each user, zero for those without a message in the window."""
    rows = _users(src).drop("at").join(_by_user(src, w), "user_id", "left")
    local = _local_text(F.col("updated_at"), w.tz).alias("updated_at_local")
    return _rated(rows.select("user_id", "user_email", "subject", "updated_at", local, *logs.zero(*COUNTS)))


def _log_totals(facts: DataFrame) -> DataFrame:
    """Requests and follow-up opens by trimmed user id and lower-cased e-mail; null where there are none of a kind."""
    asked, opened, n = F.col("kind") == "asked", F.col("kind") == "opened", F.col("n")
    who = S.trimmed(F.coalesce("user_id", F.lit("unknown")))
    some = lambda kind, when: F.sum(F.when(kind, F.when(when, n).otherwise(0)))
    sums = {"total": F.lit(True), "core": F.col("is_core"), "system": ~F.col("is_core")} | {d: F.col("name") == d for d in logs.DEVICES}
    return facts.groupBy(F.when(who == "", "unknown").otherwise(who).alias("k_id"), F.lower(S.trimmed(F.col("user_email"))).alias("k_mail")).agg(
        *[some(asked, when).alias(f"{k}_request_count") for k, when in sums.items()], *[some(opened, F.col("name") == e).alias(f"followup_{e}_count") for e in ("recognized", "success")]
    )


def _merged(src: Sources, w: Window, log=logs) -> DataFrame:
    """Users of either half by id and lower-cased e-mail; follow-ups join, but add no users. Each table is read once."""
    on, people = ["k_id", "k_mail"], monitor_users(src, w)
    people = people.withColumns({"k_id": S.trimmed(F.col("user_id")), "k_mail": F.lower(S.trimmed(F.col("user_email")))})
    rows = people.join(_log_totals(log.user_facts(src, w)), on, "full").where("user_id is not null or total_request_count is not null")
    whole = {n: F.coalesce(n, F.lit(0)).cast("bigint") for n in (*COUNTS, "active_conversation_count")}
    texts = {n: F.coalesce(n, F.lit("")) for n in ("subject", "updated_at", "updated_at_local")}
    share = {f"{d}_request_rate": S.rate(F.col(f"{d}_request_count"), F.col("total_request_count")) for d in ("desktop", "mobile")}
    share |= {"followup_open_success_rate": S.rate(F.col("followup_success_count"), F.col("followup_recognized_count"))}
    return rows.withColumns({"user_id": F.coalesce("user_id", "k_id"), "user_email": F.coalesce("user_email", "k_mail")} | texts | whole | share).drop(*on)


def _ranked() -> list[Column]:
    return [F.desc("message_count"), F.desc(F.coalesce("total_request_count", F.lit(0))), F.desc("conversation_count"), F.col("user_id"), F.col("user_email")]


def dashboard_users(src: Sources, w: Window, log=logs) -> DataFrame:
    """Active users in order of rank; all users if none is active. Who has no requests keeps null request counts. What the
    logs say comes from ``log``: the module that reads them, or a rollup of them."""
    rows = _merged(src, w, log)
    active = (F.col("message_count") > 0) | (F.col("conversation_count") > 0) | (F.coalesce("total_request_count", F.lit(0)) > 0) | (F.coalesce("core_request_count", F.lit(0)) > 0)
    # asked of all columns, so that it runs on the same shuffles as the rows themselves
    anyone = rows.agg(F.max(F.when(active, F.hash(*rows.columns))).isNotNull().alias("_any"))
    return rows.crossJoin(F.broadcast(anyone)).where(active | ~F.col("_any")).drop("_any").orderBy(*_ranked())


def selected_user(src: Sources, w: Window, lookup: str, log=logs) -> DataFrame:
    """The first user in order of rank whose id or e-mail holds the text."""
    key = lookup.strip().lower()
    hit = (F.lower("user_id").contains(key) | F.lower("user_email").contains(key)) if key else F.lit(False)
    return _merged(src, w, log).where(hit).orderBy(*_ranked()).limit(1)


def selected_series(src: Sources, w: Window, lookup: str, log=logs) -> DataFrame:
    """That user's request series; no rows where there is no such user or no request. Reads one row to know whom."""
    one = selected_user(src, w, lookup, log).select("user_id", "user_email", "total_request_count").first()
    if one is None or not one.total_request_count:
        return log.user_series(src, w, "").where("false")
    return log.user_series(src, w, one.user_id or one.user_email)


def dashboard_summary(src: Sources, w: Window, log=logs) -> DataFrame:
    """One row that sets document metrics beside log metrics (from ``log``, as above)."""
    docs = monitor(src, w).select("dau", "wau", "active_users_in_window", "active_session_stickiness", "conversation_count", "message_count", "feedback_like_rate", "message_failure_rate", "citation_coverage_rate")
    names = ("first_answer_avg_ms", "enhance_answer_avg_ms", "qs_stable_rate", "qs_avg_latency_ms", "restore_success_rate", "request_count", "core_request_count", "error_5xx_rate", "request_p95_latency_ms")
    opened = log.user_facts(src, w).where("kind = 'opened'").agg(*[F.coalesce(F.sum(F.when(F.col("name") == e, F.col("n"))), F.lit(0)).cast("bigint").alias(f"followup_{e}_count") for e in ("recognized", "success")])
    opened = opened.withColumn("followup_open_success_rate", S.rate(F.col("followup_success_count"), F.col("followup_recognized_count")))
    return docs.crossJoin(log.overview(src, w).select(*names)).crossJoin(opened)
