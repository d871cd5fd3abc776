"""Satellite plume, glint and flaring analytics as Spark DataFrame plans."""
