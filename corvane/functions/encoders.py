"""Encodings of entry values as column functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidKeyLength


class JSONEncoder:
    """Plain JSON text as UTF-8 bytes."""

    def encode(self, value: Column) -> Column:
        return F.to_json(value, {"ignoreNullFields": "false"}).cast("binary")

    def decode(self, data: Column, schema: T.StructType) -> Column:
        return F.from_json(data.cast("string"), schema, {"mode": "PERMISSIVE"})


@dataclass(frozen=True)
class EncryptedJSONEncoder(JSONEncoder):
    """AES-GCM over JSON: 12 random bytes, ciphertext, 16-byte tag. Values that do not decrypt are read as plain JSON."""

    key: bytes

    def __post_init__(self) -> None:
        if len(self.key) not in (16, 24, 32):
            raise InvalidKeyLength(f"an AES key has 16, 24 or 32 bytes, not {len(self.key)}")

    def encode(self, value: Column) -> Column:
        return F.aes_encrypt(super().encode(value), F.lit(self.key), F.lit("GCM"))

    def decode(self, data: Column, schema: T.StructType) -> Column:
        # an array's element is computed once, however often the branches name it
        opened = F.try_aes_decrypt(data, F.lit(self.key), F.lit("GCM"))
        both = F.array(F.struct(data.alias("raw"), opened.alias("opened")))

        def readable(x: Column) -> Column:
            plain = F.substring(x["raw"], 1, 1).isin(bytearray(b"{"))
            wrong = F.raise_error(F.lit("value is neither encrypted with this key nor plain JSON")).cast("binary")
            return F.when(x["opened"].isNotNull(), x["opened"]).when(x["raw"].isNull() | plain, x["raw"]).otherwise(wrong)

        return super().decode(F.get(F.transform(both, readable), F.lit(0)), schema)
