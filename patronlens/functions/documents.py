"""JSON documents as rows, so that whole documents can be compared and queried."""

from __future__ import annotations

from pyspark.sql import DataFrame

# A container's own row comes before its members; numbers of all kinds are doubles.
_ROWS = """
WITH RECURSIVE part(path, value) AS (
  SELECT '$', parse_json({document}) FROM {documents} WHERE {document} IS NOT NULL
  UNION ALL
  SELECT CASE WHEN member.key IS NULL THEN concat(part.path, '[', member.pos, ']')
              ELSE concat(part.path, '.', member.key) END, member.value
  FROM part, LATERAL variant_explode(part.value) AS member
),
typed AS (SELECT path, value, schema_of_variant(value) AS shape FROM part)
SELECT path,
       CASE WHEN shape LIKE 'OBJECT%' THEN 'object' WHEN shape LIKE 'ARRAY%' THEN 'array'
            WHEN shape = 'STRING' THEN 'string' WHEN shape = 'BOOLEAN' THEN 'boolean'
            WHEN shape = 'VOID' THEN 'null' ELSE 'number' END AS type,
       CASE WHEN shape IN ('STRING', 'BOOLEAN') THEN try_variant_get(value, '$', 'string') END AS text,
       CASE WHEN shape NOT LIKE 'OBJECT%' AND shape NOT LIKE 'ARRAY%' AND shape NOT IN ('STRING', 'BOOLEAN', 'VOID')
            THEN try_variant_get(value, '$', 'double') END AS number
FROM typed
"""


def document_rows(documents: DataFrame, column: str) -> DataFrame:
    """Rows (path, type, text, number) for every part of the JSON documents in a column.

    Paths read like $.kpis.activeCustomers.value and $.segments[0]. Meant for documents that are bounded by
    design, such as reports: the nesting is followed level by level, and a null document has no rows.
    """
    sql = _ROWS.replace("{document}", f"`{column}`")
    return documents.sparkSession.sql(sql, documents=documents)
