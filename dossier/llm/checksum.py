"""CRC-32 as SQL, for the queries that are held against a database without that function."""

# The table of the checksum's polynomial, one list in one row.
CRC_TABLE_SQL = """crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), b) ORDER BY b) AS crc_of FROM range(256) r(b))"""


def crc_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text's UTF-8 bytes; needs `crc_of` of the table above."""
    size = f"octet_length(encode({text}))"
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    return (f"xor(list_reduce(list_transform(range({size}), lambda i: {byte}), "
            "lambda c, x: xor(c >> 8, crc_of[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)")


CRC_OF_ID_SQL = crc_sql("doc_id::VARCHAR")
