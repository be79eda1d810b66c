"""Landscape-genetics analytics on PySpark: tables in, tables out."""
