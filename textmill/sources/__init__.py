"""Readers and writers: files and tables in and out of typed DataFrames."""
