"""A PySpark-native analytics engine with PostgreSQL-flavoured SQL."""
