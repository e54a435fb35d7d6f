"""Column layouts. One append-only log holds every version of every record."""

from __future__ import annotations

LOG = "space string, table_name string, record_id string, commit_version bigint, seq int, deleted boolean, body string, schema_version int, txn_id string, updated_ms bigint"
KEY = ("space", "table_name", "record_id")
RECORD = (*KEY, "body", "schema_version", "commit_version", "deleted")
#: Records of this table are schema documents.
SCHEMA_TABLE = "_schema"
#: Schemas bound to a table are registered under this and the table's name.
BINDING = "_table::"
