"""Earshot: analytics over media libraries and listening behaviour on PySpark."""
