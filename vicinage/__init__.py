"""Exact similarity analytics on Apache Spark: joins, searches and layouts over vector relations."""
