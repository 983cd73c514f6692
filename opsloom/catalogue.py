"""Every query of the analytics engine by name, and its SQL twin."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from . import oracle, oracle_documents
from .operators import documents, logs, rollup, views
from .plans.window import window
from .sources.tables import from_dir

FLAGSHIP = "q02_usage_day"


def _at(day: int, hour: int = 0, minute: int = 0) -> datetime:
    return datetime(2024, 1, day, hour, minute, tzinfo=timezone.utc)


#: The standard windows over the test tables.
WEEK, THREE_DAYS, DAY = window(_at(8), _at(15), bucket=1440), window(_at(8), _at(11)), window(_at(10), _at(11))
SIX_HOURS, HOUR, ODD_HOUR = window(_at(10), _at(10, 6)), window(_at(10, 0, 10), _at(10, 1, 10)), window(_at(10, 0, 12), _at(10, 1, 12))
MONTH = window(_at(1), _at(31), "UTC", 1440)
USER = "u7"

_LOGS = {
    "q01_overview": ("overview", WEEK),
    "q02_usage_day": ("usage", WEEK),
    "q02_usage_month_utc": ("usage", MONTH),
    "q03_usage_30min": ("usage", DAY),
    "q03_usage_60min": ("usage", THREE_DAYS),
    "q03_usage_15min": ("usage", SIX_HOURS),
    "q03_usage_5min": ("usage", HOUR),
    "q03_usage_5min_odd": ("usage", ODD_HOUR),
    "q04_error_trend_day": ("error_trend", WEEK),
    "q05_error_trend_30min": ("error_trend", DAY),
    "q06_top_endpoints": ("top_endpoints", WEEK),
    "q07_top_errors": ("top_errors", WEEK),
    "q08_devices": ("devices", WEEK),
    "q09_qs_stages": ("suggest_stages", WEEK),
    "q10_qs_fallbacks": ("suggest_fallbacks", WEEK),
    "q11a_followup_raw": ("followups", WEEK),
    "q11b_followup_users": ("followup_users", WEEK),
    "q12_request_users": ("request_users", WEEK),
    "q13_user_series_day": ("user_series", WEEK, USER),
    "q14_user_series_30min": ("user_series", DAY, USER),
    "q28_log_counters": ("log_counters", MONTH),
}

#: Log questions that a rollup answers as well, windows that cut a step in two among them.
_ROLLED = {
    "q01_overview_rollup": "q01_overview", "q02_usage_day_rollup": "q02_usage_day", "q03_usage_30min_rollup": "q03_usage_30min", "q03_usage_5min_odd_rollup": "q03_usage_5min_odd",
    "q04_error_trend_day_rollup": "q04_error_trend_day", "q06_top_endpoints_rollup": "q06_top_endpoints", "q07_top_errors_rollup": "q07_top_errors", "q08_devices_rollup": "q08_devices",
    "q09_qs_stages_rollup": "q09_qs_stages", "q10_qs_fallbacks_rollup": "q10_qs_fallbacks", "q11a_followup_raw_rollup": "q11a_followup_raw", "q12_request_users_rollup": "q12_request_users", "q14_user_series_30min_rollup": "q14_user_series_30min",
}

#: Document queries: a window first, where one is taken.
_DOCUMENTS = {
    "q15_users": ("list_users", 2000),
    "q15_users_keyword": ("list_users", 100, "u11"),
    "q16_usage": ("usage", MONTH),
    "q16_usage_week_by_conversation": ("usage", WEEK, True),
    "q17_suggestion_funnel": ("suggestion_funnel", MONTH),
    "q18_conversations": ("list_conversations", USER, True),
    "q18_conversations_keyword": ("list_conversations", USER, False, 200, "title"),
    "q19_conversation": ("conversation", USER, "c7"),
    "q19_messages": ("messages", USER, "c7"),
    "q20_export_user": ("export_messages", USER),
    "q21_export_conversation": ("export_messages", USER, "c7"),
    "q22_monitor": ("monitor", MONTH),
    "q22_monitor_week": ("monitor", WEEK),
    "q22_monitor_errors": ("monitor_errors", MONTH),
    "q23_monitor_users": ("monitor_users", MONTH),
    "q23_monitor_user_errors": ("monitor_user_errors", MONTH),
    "q24_dashboard_users": ("dashboard_users", WEEK),
    "q25_selected_user": ("selected_user", WEEK, USER),
    "q25_selected_series": ("selected_series", WEEK, USER),
    "q26_dashboard_summary": ("dashboard_summary", WEEK),
}
#: Document queries over messages shredded from whole documents.
_SHREDDED = ("q16_usage_week_by_conversation", "q19_messages", "q20_export_user", "q21_export_conversation", "q22_monitor", "q22_monitor_errors", "q23_monitor_users", "q24_dashboard_users")


def queries():
    found = {name: (lambda spark, sf_dir, f=getattr(logs, f), args=args: f(from_dir(spark, sf_dir), *args)) for name, (f, *args) in _LOGS.items()}
    found |= {name: (lambda spark, sf_dir, f=getattr(documents, f), args=args: f(from_dir(spark, sf_dir), *args)) for name, (f, *args) in _DOCUMENTS.items()}

    found |= {f"{name}_documents": (lambda spark, sf_dir, f=getattr(documents, _DOCUMENTS[name][0]), args=_DOCUMENTS[name][1:]: f(from_dir(spark, sf_dir, documents=True), *args)) for name in _SHREDDED}

    def rolled(spark, sf_dir, f, args):
        return getattr(rollup.of_logs(src := from_dir(spark, sf_dir)), f)(src, *args)

    found |= {name: (lambda spark, sf_dir, f=_LOGS[of][0], args=_LOGS[of][1:]: rolled(spark, sf_dir, f, args)) for name, of in _ROLLED.items()}
    found["q26_dashboard_summary_rollup"] = lambda spark, sf_dir: documents.dashboard_summary(src := from_dir(spark, sf_dir), WEEK, rollup.of_logs(src))
    for letter, name in zip("abc", logs.ALERTS, strict=True):
        found[f"q29{letter}_alert_{name}"] = lambda spark, sf_dir, name=name: logs.alert(logs.counter_rows(from_dir(spark, sf_dir)), name)
    for letter, (name, f) in zip("abcd", views.VIEWS.items(), strict=True):
        found[f"q27{letter}_{name}"] = lambda spark, sf_dir, f=f: f(from_dir(spark, sf_dir)).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return found


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(oracle, f)(*args) for name, (f, *args) in _LOGS.items()}
    found |= {name: getattr(oracle_documents, f)(*args) for name, (f, *args) in _DOCUMENTS.items()}
    found |= {f"{name}_documents": oracle_documents.of_documents(found[name]) for name in _SHREDDED}
    found |= {name: found[of] for name, of in _ROLLED.items()} | {"q26_dashboard_summary_rollup": found["q26_dashboard_summary"]}
    for letter, name in zip("abc", logs.ALERTS, strict=True):
        found[f"q29{letter}_alert_{name}"] = oracle.alert(name, *logs.ALERTS[name])
    for letter, name in zip("abcd", views.VIEWS, strict=True):
        found[f"q27{letter}_{name}"] = oracle.view(name)
    return found
