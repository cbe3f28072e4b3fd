"""Codecs: how a topic's binary value becomes a column and back, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Codec:
    """``decode`` and ``encode`` map columns; ``loads`` and ``dumps`` do the same for one Python value in handlers."""

    type: T.DataType = T.BinaryType()

    def decode(self, value: Column) -> Column:
        raise NotImplementedError

    def encode(self, value: Column) -> Column:
        raise NotImplementedError

    def null_value(self) -> Column:
        """What an absent value decodes to where nulls are decoded."""
        return F.lit(None).cast(self.type)

    def loads(self, data: bytes | None) -> object:
        raise NotImplementedError

    def dumps(self, value: object) -> bytes:
        raise NotImplementedError


class Bytes(Codec):
    def decode(self, value: Column) -> Column:
        return value

    def encode(self, value: Column) -> Column:
        return value

    def loads(self, data: bytes | None) -> bytes | None:
        return data

    def dumps(self, value: object) -> bytes:
        if not isinstance(value, (bytes, bytearray)):
            raise TypeError(f"Bytes codec needs bytes, not {type(value).__name__}")
        return bytes(value)


class String(Codec):
    type = T.StringType()

    def decode(self, value: Column) -> Column:
        return F.decode(value, "UTF-8")

    def encode(self, value: Column) -> Column:
        return F.encode(value, "UTF-8")

    def null_value(self) -> Column:
        return F.lit("")

    def loads(self, data: bytes | None) -> str:
        return (data or b"").decode()

    def dumps(self, value: object) -> bytes:
        if not isinstance(value, str):
            raise TypeError(f"String codec needs str, not {type(value).__name__}")
        return value.encode()


class Int64(Codec):
    """Decimal text, not big-endian bytes; text that is no number fails the query."""

    type = T.LongType()

    def decode(self, value: Column) -> Column:
        return F.decode(value, "UTF-8").cast("long")

    def encode(self, value: Column) -> Column:
        return F.encode(value.cast("string"), "UTF-8")

    def null_value(self) -> Column:
        return F.lit(0).cast("long")

    def loads(self, data: bytes | None) -> int:
        return int((data or b"").decode())

    def dumps(self, value: object) -> bytes:
        if isinstance(value, bool) or not isinstance(value, int):
            raise TypeError(f"Int64 codec needs int, not {type(value).__name__}")
        return str(value).encode()


@dataclass
class Json(Codec):
    """JSON text of a struct, array or map; malformed text fails the query."""

    schema: T.DataType | str

    def __post_init__(self) -> None:
        self.type = T._parse_datatype_string(self.schema) if isinstance(self.schema, str) else self.schema

    def decode(self, value: Column) -> Column:
        ddl = self.schema if isinstance(self.schema, str) else self.schema.simpleString()
        return F.from_json(F.decode(value, "UTF-8"), ddl, {"mode": "FAILFAST"})

    def encode(self, value: Column) -> Column:
        return F.encode(F.to_json(value), "UTF-8")

    def loads(self, data: bytes | None) -> object:
        import json

        return None if data is None else json.loads(data)

    def dumps(self, value: object) -> bytes:
        import json

        return json.dumps(value, separators=(",", ":")).encode()
