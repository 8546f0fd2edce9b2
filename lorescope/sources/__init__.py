"""Readers, writers and resumable sinks."""
