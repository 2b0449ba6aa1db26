"""Helpers that several training-data operators share."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceloom.sources.tables import discard, settle, stored, table

__all__ = ["ASCII_SPACE", "ASCII_WORD", "CRC_TABLE_SQL", "crc32_sql", "discard", "row_hash", "settle", "stored", "table"]

ASCII_SPACE = r"[\x20\x09-\x0D]+"
ASCII_WORD = r"[^\x20\x09-\x0D]+"


def row_hash(rows: DataFrame) -> Column:
    """A hash of all columns of a row; maps, which have none, count as their JSON."""
    return F.xxhash64(*[F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in rows.schema])

#: The CRC-32 table (fixed polynomial) for crc32_sql.
CRC_TABLE_SQL = """crc_table AS (SELECT list(c ORDER BY n) AS crc FROM (
  SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n)))"""


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of a text's UTF-8 bytes; needs crc_table in FROM."""
    digit = lambda k: f"strpos('0123456789ABCDEF', substr(hex(encode({text})), (2 * k + {k})::INT, 1)) - 1"
    data = f"list_transform(range(octet_length(encode({text}))), lambda k: (16 * ({digit(1)}) + {digit(2)})::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])))"
