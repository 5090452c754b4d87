"""Data model: typed subject-predicate-object facts, identifiers, hints, errors and session presets."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACTS = T.StructType(
    [
        T.StructField("topic_id", T.IntegerType(), False),
        T.StructField("subject", T.StringType(), False),
        T.StructField("predicate", T.StringType(), False),
        T.StructField("o_kind", T.StringType(), False),
        T.StructField("o_text", T.StringType(), False),
        T.StructField("o_num", T.DoubleType(), True),
        T.StructField("entity_type", T.ByteType(), True),
        T.StructField("semantic_hash", T.ShortType(), True),
        T.StructField("flags", T.ByteType(), True),
        T.StructField("ingest_seq", T.LongType(), True),
    ]
)
#: What makes a fact the same fact.
FACT_KEY = ["topic_id", "subject", "predicate", "o_kind", "o_text"]
VECTORS = "entity_id bigint, topic_id int, embedding array<float>, semantic_hash smallint"
CONTENT = "entity_id bigint, data binary, ingest_seq bigint"
DEFAULT_TOPIC = 1
MAX_TOPIC = (1 << 24) - 1
LOCAL_BITS = 40
ENTITY_TYPES = ("unknown", "func", "var", "class", "module", "interface", "type", "const", "package")
IS_PUBLIC, IS_DEPRECATED, IS_TEST, IS_GENERATED = 8, 4, 2, 1


class StoreError(Exception):
    """Base of all errors of this library."""


class InvalidFact(StoreError):
    pass


class NotFound(StoreError):
    pass


class ReadOnly(StoreError):
    pass


class DimensionMismatch(StoreError):
    pass


class PartitionLimit(StoreError):
    pass


class LimitExceeded(StoreError):
    pass


class Int32(int):
    """An integer that keeps its 32-bit type in a fact (a plain int is kept as 64-bit and read back as text)."""


class Float32(float):
    """A float that keeps its 32-bit type in a fact."""


def render(value: Any) -> tuple[str, str, float | None]:
    """(kind, canonical text, number or None) of an object value."""
    if value is None:
        raise InvalidFact("the object is null")
    if isinstance(value, bool | np.bool_):
        return "bool", "true" if value else "false", None
    if isinstance(value, Int32 | np.int32):
        if not -(1 << 31) <= int(value) < 1 << 31:
            raise InvalidFact(f"{value} is no 32-bit integer")
        return "i32", str(int(value)), float(value)
    if isinstance(value, Float32 | np.float32):
        text = np.format_float_positional(np.float32(value), unique=True, trim="-") if math.isfinite(value) else str(float(value))
        return "f32", text, float(text)
    if isinstance(value, int | np.integer):
        return "i64", str(int(value)), float(value)
    if isinstance(value, float | np.floating):
        return "f64", f"{float(value):.17g}", float(value)
    text = str(value)
    return "str", text, number(text)


def number(text: str) -> float | None:
    """The number a text spells, by the rules of the numeric filters (``numeric``): no blanks, no overflow, no NaN."""
    import re

    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text):
        x = float(text)
        return x if math.isfinite(x) else None
    if re.fullmatch(r"[+-]?(inf|infinity)", text, re.I):
        return -math.inf if text.startswith("-") else math.inf
    return None


def numeric(text: Column) -> Column:
    """Column form of ``number``; null where the text is no number."""
    plain = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    inf = F.lower(text).rlike(r"^[+-]?inf(inity)?$")
    value = F.when(plain, text.try_cast("double"))
    value = F.when(F.abs(value) < F.lit(math.inf), value)
    return F.when(inf, F.when(text.startswith("-"), F.lit(-math.inf)).otherwise(F.lit(math.inf))).otherwise(value)


@dataclass(frozen=True)
class Fact:
    subject: str
    predicate: str
    object: Any

    def check(self) -> Fact:
        if not self.subject or not self.predicate or self.object is None:
            raise InvalidFact(f"{self}: subject and predicate must be non-empty, the object non-null")
        return self

    def __str__(self) -> str:
        return f"<{self.subject}, {self.predicate}, {self.object}>"


def facts_df(spark: SparkSession, rows: Iterable[Fact | tuple], topic: int = DEFAULT_TOPIC, entity_type: int = 0, flags: int = 0, first_seq: int = 0) -> DataFrame:
    """A facts table from Python values; every fact is validated before any is used."""
    valid_topic(topic)
    out = []
    for i, f in enumerate(rows):
        f = (f if isinstance(f, Fact) else Fact(*f)).check()
        kind, text, num = render(f.object)
        out.append((topic, f.subject, f.predicate, kind, text, num, entity_type, fnv1a(f.subject) & 0xFF, flags, first_seq + i))
    return spark.createDataFrame(out, FACTS)


def object_column() -> Column:
    """The object as a struct with one field of each type that keeps it, the others null."""
    k, t = F.col("o_kind"), F.col("o_text")
    return F.struct(
        F.when(k == "bool", t == "true").alias("bool"),
        F.when(k == "i32", t.cast("int")).alias("i32"),
        F.when(k == "f32", t.cast("float")).alias("f32"),
        F.when(~k.isin("bool", "i32", "f32"), t).alias("text"),
    )


def value_of(kind: str, text: str) -> Any:
    """Python value of a stored object; 64-bit numbers come back as text."""
    return {"bool": lambda: text == "true", "i32": lambda: Int32(text), "f32": lambda: Float32(text)}.get(kind, lambda: text)()


def valid_topic(topic: int) -> int:
    if not 1 <= topic <= MAX_TOPIC:
        raise StoreError(f"topic {topic} is not in 1..{MAX_TOPIC}")
    return topic


def next_topic(topic: int) -> int:
    return min(topic + 1, MAX_TOPIC)


def pack_id(topic: Column, local: Column) -> Column:
    return F.shiftleft(topic.bitwiseAND(F.lit(MAX_TOPIC)).cast("bigint"), LOCAL_BITS).bitwiseOR(local.bitwiseAND(F.lit((1 << LOCAL_BITS) - 1)))


def unpack_topic(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, LOCAL_BITS).cast("int")


def unpack_local(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))


def pack_bool(value: Column) -> Column:
    """Inline id of a boolean: bit 39 set, bit 38 clear, bit 0 the value."""
    return F.lit(1 << 39).bitwiseOR(value.cast("bigint"))


def pack_int32(value: Column) -> Column:
    """Inline id of a 32-bit integer: bits 39 and 38 set, bit 37 clear, the raw bits below."""
    return F.lit(3 << 38).bitwiseOR(value.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))


def unpack_int32(packed: Column) -> Column:
    raw = packed.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(raw >= 1 << 31, raw - (1 << 32)).otherwise(raw).cast("int")


def pack_float32(bits: Column) -> Column:
    """Inline id of the IEEE bits of a 32-bit float (see ``functions.columns.float_bits``): bits 39, 38 and 37 set."""
    return F.lit(7 << 37).bitwiseOR(bits.bitwiseAND(F.lit(0xFFFFFFFF)))


def is_inline(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(1 << 39)) != 0


def encode_hints(entity_type: Column, semantic_hash: Column, flags: Column) -> Column:
    """Sixteen bits: entity type (4), semantic hash (8), flags (4)."""
    return F.shiftleft(entity_type.cast("int").bitwiseAND(F.lit(15)), 12).bitwiseOR(F.shiftleft(semantic_hash.cast("int").bitwiseAND(F.lit(255)), 4)).bitwiseOR(flags.cast("int").bitwiseAND(F.lit(15)))


def decode_hints(hints: Column) -> Column:
    return F.struct(
        F.shiftright(hints, 12).bitwiseAND(F.lit(15)).alias("entity_type"), F.shiftright(hints, 4).bitwiseAND(F.lit(255)).alias("semantic_hash"), hints.bitwiseAND(F.lit(15)).alias("flags")
    )


def fnv1a(text: str) -> int:
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def semantic_hash(text: Column) -> Column:
    """FNV-1a (32 bit) of the UTF-8 bytes, lowest byte; plain column arithmetic, no Python."""
    digits = F.hex(F.encode(text, "UTF-8"))
    byte = lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("bigint")
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), (F.length(digits) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    h = F.aggregate(places, F.lit(2166136261).cast("bigint"), lambda h, i: (h.bitwiseXOR(byte(i)) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))
    return h.bitwiseAND(F.lit(255)).cast("smallint")


#: Session settings by use: for large batch work, for serving within limits, for readers only, for the least resources.
PRESETS: dict[str, dict[str, str]] = {
    "default": {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.parquet.filterPushdown": "true"},
    "serving": {"spark.sql.adaptive.enabled": "true", "spark.scheduler.mode": "FAIR", "spark.sql.broadcastTimeout": "60"},
    "read_only": {"spark.sql.adaptive.enabled": "true", "spark.tessera.readOnly": "true"},
    "minimum": {"spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": "4", "spark.sql.autoBroadcastJoinThreshold": "1m"},
}


def preset(name: str) -> dict[str, str]:
    if name not in PRESETS:
        raise StoreError(f"no preset {name!r}; there are {sorted(PRESETS)}")
    return dict(PRESETS[name])
