"""Readers and writers: typed files, topics, keyed tables, replay."""
