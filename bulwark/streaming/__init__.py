"""Streams of text parts: the same transforms over ordered rows and over Structured Streaming state."""
