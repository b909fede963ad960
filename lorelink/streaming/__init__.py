"""The same operators over streams: uniqueness, counters and graphs by context, counts by time."""
