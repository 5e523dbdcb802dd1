"""Structured Streaming: windows with watermarks, and state machines by key."""
