"""Structured Streaming jobs: windows with late data, a tile work queue, incremental loads."""
