"""DataFrame-to-DataFrame operators of message pipelines; they run alike in batch and in micro-batches."""
