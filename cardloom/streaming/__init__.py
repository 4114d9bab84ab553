"""Stateful streams: ballots and confirmation sessions with event-time timers."""
