"""Readers and writers: files and tables in, files and tables out."""
