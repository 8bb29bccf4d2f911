"""Stream and batch analytics on PySpark: functions, joins, aggregates, windows, sources and sinks."""
