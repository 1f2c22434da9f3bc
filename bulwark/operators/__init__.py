"""Checks over text and tool calls, and the algebra over their results."""
