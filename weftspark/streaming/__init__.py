"""Streams over the same operators: an incremental run for each batch, and windowed metrics with a watermark."""
