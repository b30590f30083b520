"""SQL text that the twins share."""

from __future__ import annotations


def crc32_sql(name: str, rows: str, column: str) -> str:
    """Common table expressions ending in ``name``: (column, crc) with the unsigned CRC-32 of the UTF-8
    bytes of each distinct text of ``rows``, by the reflected polynomial, bytewise over a table that
    follows from it."""
    return f"""crc_table AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
{name} AS MATERIALIZED (SELECT {column}, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({column}))), lambda i: ('0x' || substr(hex(encode({column})), 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc
FROM (SELECT DISTINCT {column} FROM ({rows})), crc_table)"""
