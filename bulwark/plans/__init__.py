"""Registered queries, each with its SQL counterpart where SQL can say the same."""
