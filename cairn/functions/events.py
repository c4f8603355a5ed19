"""Payloads of progress events: one schema for each type, read from JSON by way of VARIANT, rejects counted by reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of each event's payload.
FIELDS = {
    "started": {"files": "bigint", "symbols_only": "boolean", "vectors_only": "boolean"},
    "prepared": {"path": "string", "language": "string", "chunks": "bigint", "symbols": "bigint"},
    "skipped": {"path": "string", "language": "string", "reason": "string"},
    "embedded": {"batch_chunks": "bigint", "chunks_done": "bigint", "chunks_total": "bigint", "elapsed_ms": "bigint"},
    "indexed": {"path": "string", "language": "string", "count": "bigint"},
    "done": {"files": "variant", "files_indexed": "bigint", "chunks": "bigint", "elapsed_ms": "bigint"},
    "error": {"code": "string", "detail": "string"},
}


#: By field type, what schema_of_variant says of a value of it.
KINDS = {"bigint": "^BIGINT$", "boolean": "^BOOLEAN$", "string": "^STRING$", "variant": "^(?:OBJECT|ARRAY)<"}


def _read(events: DataFrame, payload: str) -> DataFrame:
    """``events`` with the payload as a variant, and the kind of each of its fields as a map (null: no object)."""
    v = events.withColumn("_v", F.try_parse_json(F.col(payload)))
    return v.withColumn("_k", F.transform_values(F.expr("try_cast(_v AS map<string, variant>)"), lambda _, x: F.schema_of_variant(x)))


def _fault(event: str) -> Column:
    """What is wrong with a payload, or null: broken, no_object, or the first field that is missing or of another type.

    Values count as of their own type only; a number in quotes is no number.
    """
    kind = lambda name: F.col("_k")[name]
    checks = [F.when(kind(name).isNull() | (kind(name) == "VOID"), F.lit(f"{name} is missing")).when(~kind(name).rlike(KINDS[t]), F.lit(f"{name} is no {t}")) for name, t in FIELDS[event].items()]
    return F.when(F.col("_v").isNull(), "broken").when(F.col("_k").isNull(), "no_object").otherwise(F.coalesce(*checks))


def payloads(events: DataFrame, event: str, payload: str = "payload") -> DataFrame:
    """The sound events of one type, with a column for each of its fields in place of the payload (done's files as JSON)."""
    sound = _read(events.where(F.col("event") == event), payload).where(_fault(event).isNull())
    field = lambda name, t: F.to_json(F.try_variant_get("_v", f"$.{name}", "variant")) if t == "variant" else F.try_variant_get("_v", f"$.{name}", t)
    rest = [c for c in events.columns if c not in (payload, "event")]
    return sound.select(*rest, *[field(name, t).alias(name) for name, t in FIELDS[event].items()])


def rejected(events: DataFrame, payload: str = "payload") -> DataFrame:
    """event, reason, n of the events whose payload does not fit their type; a type that is not known is unknown."""
    known = F.coalesce(*[F.when(F.col("event") == e, F.coalesce(_fault(e), F.lit(""))) for e in FIELDS], F.lit("unknown"))
    faults = F.explode(F.filter(F.array(known), lambda r: r != ""))
    return _read(events, payload).select("event", faults.alias("reason")).groupBy("event", "reason").agg(F.count(F.lit(1)).alias("n"))
