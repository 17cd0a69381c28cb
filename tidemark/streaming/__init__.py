"""Streams of events and bars."""
