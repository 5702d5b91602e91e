"""Named queries: each operator bound to the given tables, with the SQL that checks it."""
