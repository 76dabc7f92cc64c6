"""Readers and writers: landed files and stored tables to and from DataFrames."""
