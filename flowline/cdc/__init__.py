"""Change-data capture: chunked snapshots, the change log, their merge, and resume offsets."""
