"""Evolution of a placement under batches and streams of changes."""
