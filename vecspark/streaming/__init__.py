"""Streams of inserts with a sliding window of live rows."""
