"""A PySpark-native engine for versioned key-value data: change logs, snapshots, merges, compaction, transactions."""
