"""Streaming mirrors of batch operators."""
