"""Sources and sinks: archives of wide text tables, validated tables, partitioned stores, JSON rectangles."""
