"""Repair-record analytics as plain Spark DataFrame operators."""
