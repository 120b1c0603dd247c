"""Parts of the SQL on conversations."""

from __future__ import annotations

import zlib

import duckdb
from barloom.llm import conversation_sql


def test_crc32_in_sql():
    con = duckdb.connect()
    for text in ("0", "7:12", "123456789", "-4: "):
        assert con.execute(f"SELECT {conversation_sql.crc32(repr(text))}").fetchone()[0] == zlib.crc32(text.encode())
