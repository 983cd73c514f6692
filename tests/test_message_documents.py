"""Documents of odd shapes: members of the wrong kind, no documents, variants as well as text."""

from pyspark.sql import functions as F

from opsloom.operators import documents as D
from opsloom.sources.message_documents import shredded
from opsloom.sources.tables import SCHEMAS, registered


def test_members_of_any_shape(spark):
    docs = [
        ('{"role": "user", "content": 5, "feedback": {"x": 1}, "attachmentNames": ["a", null, 1.5, false, [1], {"k": "v"}], "grounded": {"evidence": [null]}}', "user", "5", None, ["a", None, "1.5", "False", "[1]", '{"k":"v"}'], True),
        ('{"role": null, "attachmentNames": "abc", "grounded": {"sources": {"a": 1}, "citations": []}}', None, None, None, None, False),
        ('{"grounded": [1], "attachmentNames": []}', None, None, None, [], False),
        ("[1, 2]", None, None, None, None, False),
        ("no document", None, None, None, None, False),
        (None, None, None, None, None, False),
    ]
    rows = spark.createDataFrame([("u", "c", str(i), d[0]) for i, d in enumerate(docs)], "user_id string, conv_id string, msg_id string, doc string")
    for source in (rows, rows.withColumn("doc", F.try_parse_json("doc"))):
        got = {r.msg_id: r for r in shredded(source).collect()}
        for i, (_, role, content, vote, names, cited) in enumerate(docs):
            r = got[str(i)]
            assert (r.role, r.content, r.feedback, r.attachmentNames) == (role, content, vote, names)
            assert any(g for g in r.grounded or ()) == cited
    plan = shredded(rows).select("role").where("role = 'user'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson(") == 1 and "attachmentNames" not in plan  # parsed once, only what is asked taken out


def test_attachments_in_drill_down_and_export(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    docs = [("a", "1", "m1", '{"role":"user","timestamp":"2024-01-02T00:00:00Z","attachmentNames":["x.pdf",null],"attachmentFileIds":["f"],"modeAtSend":""}'), ("a", "1", "m2", '{"role":"user"}')]
    conv = spark.createDataFrame([("a", "1", "t", "internal", None, None, None, None, "2024-01-01T00:00:00Z", "2024-01-03T00:00:00Z")], SCHEMAS["conversations"])
    src = registered(spark, conversations=conv, messages=shredded(spark.createDataFrame(docs, "user_id string, conv_id string, msg_id string, doc string")))
    got = D.messages(src, "a", "1").collect()
    assert [(r.message_id, r.attachment_names, r.attachment_file_ids, r.mode_at_send) for r in got] == [("m1", "x.pdf|None", "f", "internal")]
    assert [r.attachment_names for r in D.export_messages(src, "a").collect()] == ["x.pdf|None"]
