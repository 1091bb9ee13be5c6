"""Frames over the supplied tables, file parsers and sinks."""
