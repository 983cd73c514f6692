"""Messages as they are stored: one document each, of whatever members it has, shredded into columns where it is read.

A document is JSON text or a variant. A column takes its member if that has the right shape, else it is null: texts take
scalars, attachment lists take arrays (whose null members stay, as text "None" later on), each grounding field takes
arrays. Text that is no document gives a row of nulls, which is in no window. Only members that a query uses are taken out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

TEXTS = ("role", "content", "timestamp", "updatedAt", "status", "errorMessage", "feedback", "modeAtSend", "chatFlowType", "parentTurnId", "turnId", "conversationIdAtSend", "clientOrigin")
LISTS = ("attachmentNames", "attachmentFileIds")
#: The members of ``grounded`` that show a citation.
GROUNDS = ("citations", "citationIndex", "citation_index", "sources", "evidence")


def _array(doc: Column, path: str) -> Column:
    member = F.try_variant_get(doc, path, "variant")
    return F.when(F.schema_of_variant(member).startswith("ARRAY"), F.try_variant_get(doc, path, "array<variant>"))


def _word(x: Column) -> Column:
    """A member of a list as text; of truth values the words with a capital."""
    return F.when(F.schema_of_variant(x) == "BOOLEAN", F.initcap(x.cast("string"))).otherwise(x.cast("string"))


def shredded(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """(user_id, conv_id, msg_id, document) rows as the messages that the queries read."""
    d = F.col(doc) if dict(docs.dtypes)[doc] == "variant" else F.try_parse_json(doc)
    rows = docs.select("user_id", "conv_id", "msg_id", F.explode(F.array(d)).alias("d"))  # parsed once, whatever is read
    d = F.col("d")
    grounded = F.struct(*[_array(d, f"$.grounded.{g}").alias(g) for g in GROUNDS])
    return rows.select("user_id", "conv_id", "msg_id", *[S.json_scalar(d, n).alias(n) for n in TEXTS], *[F.transform(_array(d, f"$.{n}"), _word).alias(n) for n in LISTS], grounded.alias("grounded"))
