"""A PySpark-native engine for a compact SQL dialect over keyed tables and Parquet."""
