"""Session analytics on Spark: logs to tables, tables to rollups, rollups to answers."""
