"""From a writer's record schema to the reader's (S2, P2): the rules of the public Avro specification, as column expressions.

A field of the reader takes the writer's field of its name, or of one of its aliases; a number is promoted (int, long, float,
double, in that order), text and bytes stand for each other, and null fits where the reader allows it. What the writer lacks gets the
reader's default; what the reader lacks is dropped. Whether a writer can be read is known before any message is: ``problems``. How a
body is decoded does not matter: any decoder that gives the writer's fields will do.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The primitive types, and what each may be read as besides itself.
PRIMITIVES = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType()}
PROMOTED = {"int": ("long", "float", "double"), "long": ("float", "double"), "float": ("double",), "string": ("bytes",), "bytes": ("string",)}
#: Logical types of a long, as parts of a second.
INSTANTS = {"timestamp-millis": 1_000, "timestamp-micros": 1_000_000}
MISSING = object()


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    logical: str | None
    nullable: bool
    default: Any
    aliases: tuple[str, ...]


def fields_of(schema: str) -> list[Field]:
    """The fields of a record of primitives, each of them optional or not."""
    record = json.loads(schema)
    if record.get("type") != "record":
        raise ValueError("not a record schema")
    out = []
    for f in record["fields"]:
        branches = f["type"] if isinstance(f["type"], list) else [f["type"]]
        kinds = [b for b in branches if b != "null"]
        if len(kinds) != 1:
            raise ValueError(f"{f['name']}: one type, or null and one type, can be resolved")
        kind = kinds[0]
        name, logical = (kind["type"], kind.get("logicalType")) if isinstance(kind, dict) else (kind, None)
        if name not in PRIMITIVES:
            raise ValueError(f"{f['name']}: no primitive type: {name}")
        out.append(Field(f["name"], name, logical, "null" in branches, f.get("default", MISSING), tuple(f.get("aliases", ()))))
    return out


def writer_struct(schema: str) -> T.StructType:
    """The columns that a decoder gives for a writer's body."""
    return T.StructType([T.StructField(f.name, PRIMITIVES[f.kind]) for f in fields_of(schema)])


def _source(reader: Field, writer: dict[str, Field]) -> Field | None:
    return next((writer[n] for n in (reader.name, *reader.aliases) if n in writer), None)


def problems(writer: str, reader: str) -> list[str]:
    """Why records of the writer cannot be read; nothing if they can."""
    known, out = {f.name: f for f in fields_of(writer)}, []
    for f in fields_of(reader):
        source = _source(f, known)
        if source is None:
            if f.default is MISSING:
                out.append(f"{f.name}: the writer lacks it and it has no default")
        elif source.kind != f.kind and f.kind not in PROMOTED.get(source.kind, ()):
            out.append(f"{f.name}: {source.kind} cannot be read as {f.kind}")
    return out


def _value(column: Column, field: Field) -> Column:
    """A value of the field's primitive type, as its logical type."""
    if field.kind == "long" and field.logical in INSTANTS:
        return F.timestamp_micros(column * (1_000_000 // INSTANTS[field.logical]))
    return column


def resolved(record: Column, writer: str, reader: str, into: T.StructType | None = None) -> Column:
    """A struct with the reader's fields, of a record that was decoded into the writer's; null if there is none (a decoder in
    permissive mode gives a record of nulls for what does not decode). With ``into`` the fields are those, by name, and of its types."""
    if wrong := problems(writer, reader):
        raise ValueError(f"the writer's schema does not fit the reader's: {wrong}")
    known = {f.name: f for f in fields_of(writer)}
    parts = {}
    for f in fields_of(reader):
        source, kind = _source(f, known), PRIMITIVES[f.kind]
        column = F.lit(f.default) if source is None else record[source.name]
        if source is not None and source.kind == "bytes" and f.kind == "string":
            column = F.decode(column, "utf-8")
        parts[f.name] = _value(column.cast(kind), f)
    if into is not None:
        parts = {f.name: parts.get(f.name, F.lit(None)).cast(f.dataType) for f in into.fields}
    found = F.lit(False)
    for name in known:
        found = found | record[name].isNotNull()
    return F.when(found, F.struct(*(column.alias(name) for name, column in parts.items())))


def resolving_decoder(reader: str, body: Callable[[Column, T.StructType], Column]) -> Callable[[Column, str, T.StructType], Column]:
    """A decoder for the landing: bodies are read into the writer's fields by ``body``, then resolved into the reader's schema and the
    pipeline's record."""

    def decode(payload: Column, writer: str, record: T.StructType) -> Column:
        # As the variable of a lambda the body is decoded once, and not for each of its fields.
        return F.get(F.transform(F.array(body(payload, writer_struct(writer))), lambda found: resolved(found, writer, reader, record)), F.lit(0))

    return decode


def json_body(payload: Column, writer: T.StructType) -> Column:
    """A JSON body with the writer's fields."""
    return F.from_json(payload.cast("string"), writer, {"mode": "PERMISSIVE"})
