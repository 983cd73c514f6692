"""Document operators on small made-up data: order of limit and filter, nulls, turns that restart in a window."""

import csv
import glob
import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from opsloom.operators import documents as D
from opsloom.plans.window import Window
from opsloom.sources.sinks import write_csv, write_json
from opsloom.sources.tables import SCHEMAS, registered

UTC = timezone.utc
W = Window(datetime(2024, 1, 2, tzinfo=UTC), datetime(2024, 1, 9, tzinfo=UTC), "UTC")


def _rows(spark, table, rows):
    schema = spark.createDataFrame([], SCHEMAS[table]).schema
    return spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in rows], schema)


@pytest.fixture(scope="module")
def src(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    users = [dict(user_id="a", userEmail=" A@x ", updatedAt="2024-01-08T12:00:00Z"), dict(user_id="b", updatedAt="", lastSeenAt="2024-01-03T00:00:00+00:00"), dict(user_id="c", updatedAt="garbage"), dict(user_id="d", userEmail="d@x")]
    conv = [dict(user_id="a", conv_id="1", mode=" Internal ", updatedAt="2024-01-03T00:00:00Z", integrityState="EMPTY", isFavorite=True), dict(user_id="a", conv_id="2", visibility="Hidden", updatedAt="2024-01-04T00:00:00Z"), dict(user_id="a", conv_id="3", updatedAt="2024-01-05T00:00:00Z", messageCount=-1), dict(user_id="zz", conv_id="9", updatedAt="2024-01-05T00:00:00Z")]
    say = lambda c, i, at, role="user", user="a", **more: dict(user_id=user, conv_id=c, msg_id=i, timestamp=at, role=role) | more
    talk = [
        say("1", "m1", "2024-01-01T00:00:00Z"), say("1", "m2", "2024-01-02T00:00:00Z"), say("1", "m3", "2024-01-02T00:00:01Z", modeAtSend="websearch"), say("1", "m4", "2024-01-02T00:00:02Z", chatFlowType="New_Chat"),
        say("1", "m5", "2024-01-02T00:00:03Z", role=" Assistant ", grounded=(["x"],), feedback=" Good "), say("1", "m6", "2024-01-02T00:00:04Z", role="assistant", status="ERROR"),
        say("2", "h1", "2024-01-03T00:00:00Z", feedback="good"), say("9", "z1", "2024-01-03T00:00:00Z", user="zz", feedback="bad"), say("1", "m7", None),
    ]
    return registered(spark, users=_rows(spark, "users", users), conversations=_rows(spark, "conversations", conv), messages=_rows(spark, "messages", talk))


def test_limit_comes_before_keyword(src):
    assert [r.user_id for r in D.list_users(src, 1, "c").collect()] == ["c"]
    assert D.list_users(src, 1, "b").collect() == []
    got = {r.user_id: r for r in D.list_users(src).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].user_email == "A@x" and got["b"].updated_at == "2024-01-03T00:00:00+00:00" and got["c"].updated_at_local == "" and got["b"].identity_verified is False


def test_monitor_restarts_turns_in_the_window(src):
    m = D.monitor(src, W).first()
    assert (m.dau, m.wau, m.active_users_in_window, m.users_scanned) == (1, 2, 2, 3)
    assert (m.conversation_count, m.message_count, m.favorite_conversation_count, m.integrity_risk_conversation_count) == (1, 5, 1, 1)
    # m2 is the first turn in the window, m3 follows it, m4 says that it is new
    assert (m.new_question_count, m.followup_count, m.internal_count, m.websearch_count) == (2, 1, 4, 1)
    assert (m.assistant_message_count, m.citation_covered_count, m.message_failure_count, m.feedback_good_count) == (2, 1, 1, 1)
    assert {r.user_id: r.message_count for r in D.monitor_users(src, W).collect()} == {"a": 5, "b": 0, "c": 0}
    assert [tuple(r) for r in D.monitor_errors(src, W).collect()] == [("unknown", 1)]


def test_drill_down_counts_turns_from_the_start(src):
    got = [(r.message_id, r.question_kind, r.mode_at_send) for r in D.messages(src, "a", "1").collect()]
    assert got == [("m1", "new", "Internal"), ("m2", "followup", "Internal"), ("m3", "followup", "websearch"), ("m4", "new", "Internal"), ("m5", "", "Internal"), ("m6", "", "Internal")]
    assert D.messages(src, "a", "none").collect() == [] and len(D.messages(src, "a", "1", 2).collect()) == 2


def test_usage_of_both_kinds(src):
    u = D.usage(src, W).first()
    assert (u.conversation_count, u.message_count, u.feedback_good_count, u.feedback_total_count, u.feedback_like_rate) == (2, 7, 1, 2, 0.5)
    u = D.usage(src, W, by_conversation=True).first()
    assert (u.feedback_good_count, u.feedback_total_count, u.feedback_source) == (1, 1, "message_scan")


def test_export_keeps_conversations_without_messages(src):
    got = D.export_messages(src, "a", include_hidden=False).collect()
    assert len(got) == 7 and [r.message_id for r in got if r.conv_id == "3"] == [""] and all(r.user_email == "A@x" for r in got)
    assert {r.conversation_visibility for r in D.export_messages(src, "a", "2").collect()} == {"Hidden"}


def test_dashboard_of_nobody_active_keeps_all(src):
    quiet = Window(datetime(2020, 1, 2, tzinfo=UTC), datetime(2020, 1, 9, tzinfo=UTC), "UTC")
    assert len(D.dashboard_users(src, quiet).collect()) == 3
    assert [r.user_id for r in D.dashboard_users(src, W).collect()] == ["a"]
    assert D.selected_user(src, W, "").collect() == [] and D.selected_series(src, W, "a").collect() == []


def test_everything_missing(spark):
    none = registered(spark)
    assert D.monitor(none, W).first().message_count == 0 and D.usage(none, W).first().feedback_like_rate is None
    assert D.suggestion_funnel(none, W).first().documents_scanned == 0
    for df in (D.list_users(none), D.list_conversations(none, "a"), D.conversation(none, "a", "1"), D.export_messages(none, "a"), D.dashboard_users(none, W), D.monitor_user_errors(none, W)):
        assert df.collect() == []


def test_facts_of_summary_or_document(spark):
    conv = [dict(user_id="a", conv_id=c, querySuggestRuntimeSummary=x) for c, x in (("1", '{"suggestionFacts": [{"impressions": 5, "clicks": -2, "lastEventAt": "2024-01-03T00:00:00Z"}, "x", 3, null, [1], {"impressions": "2"}]}'), ("2", "{}"), ("3", "[1]"), ("4", None), ("5", "garbage"), ("6", '{"other": 1}'))]
    runtime = [dict(user_id="a", conv_id=c, payload='{"suggestionFacts": [{"impressions": %d}]}' % (10 ** int(c))) for c in "123456"] + [dict(user_id="b", conv_id="4", payload='{"suggestionFacts": [{"impressions": 7}]}')]
    src = registered(spark, users=_rows(spark, "users", [dict(user_id="a", updatedAt="x"), dict(user_id="b", updatedAt="x")]), conversations=_rows(spark, "conversations", conv), summaries=_rows(spark, "summaries", conv), runtime=_rows(spark, "runtime", runtime))
    f = D.suggestion_funnel(src, W).first()
    # the summary of 1 and 6 counts (6 has no facts); of the others the document; the document of b has no conversation
    assert (f.impressions, f.clicks, f.documents_scanned) == (7 + 100 + 1000 + 10_000 + 100_000, 0, 6)


def test_modes(spark):
    from opsloom.functions.scalars import mode_class

    got = spark.createDataFrame([(" WebSearch ",), ("standard",), ("custom",), ("",), (None,)], "m string").select(mode_class(F.col("m"))).collect()
    assert [r[0] for r in got] == ["websearch", "standard", "unknown", "unknown", "unknown"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi",\nthere', None, True), (2, "", "é ", False)], "n long, t string, u string, b boolean").coalesce(1)
    write_csv(df, f"{tmp_path}/c")
    text = open(glob.glob(f"{tmp_path}/c/part-*")[0], encoding="utf-8", newline="").read()
    assert text.startswith("\ufeffn,")
    assert list(csv.reader(text[1:].splitlines(keepends=True))) == [["n", "t", "u", "b"], ["1", 'say "hi",\nthere', "", "True"], ["2", "", "é ", "False"]]
    write_json(df, f"{tmp_path}/j")
    assert json.loads(open(glob.glob(f"{tmp_path}/j/part-*")[0]).readline()) == {"n": 1, "t": 'say "hi",\nthere', "u": None, "b": True}


def test_reports_and_exports(spark, tmp_path):
    from opsloom.catalogue import WEEK, queries
    from opsloom.operators import reports
    from opsloom.sources.tables import from_dir

    sf = "/root/testdata/sf0.001"
    src = from_dir(spark, sf)
    with reports.shared(src, WEEK) as once:
        parts = {k: sorted(map(str, df.collect())) for k, df in reports.report(once, WEEK, "dashboard").items()}
    for part, name in (("overview", "q01_overview"), ("series", "q02_usage_day"), ("errors", "q07_top_errors"), ("users", "q24_dashboard_users"), ("summary", "q26_dashboard_summary")):
        assert parts[part] == sorted(map(str, queries()[name](spark, sf).collect())), part
    keys = [r.bucket_key for r in reports.report(src, WEEK, "errors")["trend"].collect()]
    assert keys == sorted(keys) and len(keys) > 5
    assert set(reports.report(src, WEEK, "query_suggest")) == {"stages", "fallbacks", "facts"}
    head, said = reports.drill_down(src, "u7", "c7")
    assert head.count() == 1 and said.count() > 0
    with pytest.raises(reports.NotFound):
        reports.drill_down(src, "u7", "nowhere")
    reports.export(src, "errors/trend", str(tmp_path / "e"), WEEK)
    reports.export(src, "conversations", str(tmp_path / "c"), user="u7", conv="c7")
    lines = sum(len(open(f, encoding="utf-8-sig").read().splitlines()) - 1 for f in glob.glob(f"{tmp_path}/e/part-*"))
    assert lines == len(keys) and glob.glob(f"{tmp_path}/c/part-*")
    with pytest.raises(reports.Gone):
        reports.export(src, "messages", str(tmp_path / "m"))
