"""Streams of deltas: tokens split over deltas, server-sent events, state with time to live."""
