"""Decoding of change-log text, primary keys, identifiers and JSON rows (SRC-10, SCAN-5, FLT-5, CDC-7 to CDC-9)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Postgres type OIDs by the kind of value they decode to.
BOOL, INTS, FLOATS, LOCAL_TIMES, ZONED_TIMES = (16,), (20, 21, 23, 26), (700, 701, 1700), (1082, 1114), (1184,)

UUID = r"^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"
INT = r"^[+-]?[0-9]+$"


def decode_text(text: Column, oid: Column) -> Column:
    """A tuple value's text as a struct with one field per kind (SRC-10).

    ``b``, ``i``, ``f``, ``ts`` (local time), ``tz`` (instant) are set for the types that have them; a
    value that doesn't parse, and every other type, stays raw in ``s``.  A date is midnight.
    Zones are whole hours, as the log's layout has them; other zones stay raw.
    """
    is_ = lambda oids: oid.isin(*oids)
    boolean = F.when(is_(BOOL), text.isin("t", "true", "TRUE"))
    integer = F.when(is_(INTS) & text.rlike(INT), text.try_cast("bigint"))
    real = F.when(is_(FLOATS), text.try_cast("double"))
    local = F.when(is_(LOCAL_TIMES) & text.rlike(r"^\d{4}-\d\d-\d\d( \d\d:\d\d:\d\d(\.\d+)?)?$"), text.try_cast("timestamp_ntz"))
    zoned = F.when(is_(ZONED_TIMES) & text.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d+)?[+-]\d\d$"), F.concat(text, F.lit(":00")).try_cast("timestamp"))
    parsed = F.coalesce(boolean.cast("string"), integer.cast("string"), real.cast("string"), local.cast("string"), zoned.cast("string"))
    return F.struct(boolean.alias("b"), integer.alias("i"), real.alias("f"), local.alias("ts"), zoned.alias("tz"), F.when(parsed.isNull(), text).alias("s"))


def canonical_uuid(text: Column) -> Column:
    """Lower-case dashed form of a UUID with or without dashes; null if it isn't one."""
    plain = F.lower(F.regexp_replace(text, "-", ""))
    cut = lambda a, n: F.substring(plain, a, n)
    return F.when(text.rlike(UUID), F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12)))


def uuid_place(uuid: Column) -> Column:
    """A canonical UUID's first 60 bits as a whole number, which is in the order of the texts."""
    return F.conv(F.concat(F.substring(uuid, 1, 8), F.substring(uuid, 10, 4), F.substring(uuid, 15, 3)), 16, 10).cast("bigint")


def primary_key(text: Column) -> Column:
    """A key's text as a struct: kind (int, uuid or unset), pk_int, pk_uuid."""
    number = F.when(text.rlike(INT), text.try_cast("bigint"))
    uuid = F.when(number.isNull(), canonical_uuid(text))
    return F.struct(F.when(number.isNotNull(), "int").when(uuid.isNotNull(), "uuid").otherwise("unset").alias("kind"), number.alias("pk_int"), uuid.alias("pk_uuid"))


def next_key(pk: Column, n: int) -> Column:
    """The key that a chunk of ``n`` dense integers after ``pk`` would reach; UUIDs and unset keys stay (CDC-9)."""
    return pk.withField("pk_int", pk["pk_int"] + F.lit(n).cast("bigint"))


def in_range(pk: Column, low: Column, high: Column) -> Column:
    """pk in (low, high], a null bound being open and a null key outside (FLT-5)."""
    return pk.isNotNull() & F.coalesce((low.isNull() | (pk > low)) & (high.isNull() | (pk <= high)), F.lit(False))


def snapshot_xmin(snapshot: Column) -> Column:
    """xmin of ``xmin:xmax:xip``; text that isn't a 32-bit number gives 0, so that nothing is taken for stale (SCAN-5)."""
    n = F.regexp_extract(snapshot, r"^([0-9]+)", 1).try_cast("bigint")
    return F.when(n <= 0xFFFFFFFF, n).otherwise(F.lit(0).cast("bigint"))


def qualify(schema: Column, table: Column) -> Column:
    """schema.table, or the table alone without a schema (CDC-7)."""
    return F.when(F.coalesce(schema, F.lit("")) == "", table).otherwise(F.concat(schema, F.lit("."), table))


def split_qualified(name: Column) -> Column:
    """(schema, table), split at the first dot; without one the schema is empty (CDC-7)."""
    dot = F.instr(name, ".")
    return F.struct(F.when(dot > 0, F.substring(name, F.lit(1), dot - 1)).otherwise("").alias("schema"), F.when(dot > 0, F.substring(name, dot + 1, F.length(name))).otherwise(name).alias("table"))


def quote_identifier(name: Column) -> Column:
    """An SQL identifier in double quotes, inner ones doubled (CDC-8)."""
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def parse_row(row: Column, schema: T.StructType | str) -> Column:
    """A typed view of a JSON row; fields that don't fit are null."""
    return F.from_json(row, schema)


def as_json(row: Column) -> Column:
    return F.to_json(row)
