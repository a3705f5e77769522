"""SQL that checks the queries which SQL can express."""

from __future__ import annotations


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": """
WITH f AS (
  SELECT DISTINCT file_id, CASE WHEN content IS NULL OR content = '' THEN 0
    ELSE length(content) - length(replace(content, chr(10), '')) + CASE WHEN ends_with(content, chr(10)) THEN 0 ELSE 1 END END AS lines
  FROM ingested_files),
i AS (
  SELECT DISTINCT 'symbol' AS item_kind, symbol_id AS item_id, file_id, start_line, end_line FROM extracted_symbols
  UNION SELECT DISTINCT 'chunk', chunk_id, file_id, start_line, end_line FROM extracted_chunks)
SELECT item_kind, item_id FROM i JOIN f USING (file_id)
WHERE end_line IS NOT NULL AND start_line IS NOT NULL AND least(end_line, lines) - greatest(start_line, 1) + 1 > 80""",
    }
