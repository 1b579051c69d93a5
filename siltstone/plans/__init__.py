"""Whole workflows, composed of sources, operators and sinks."""
