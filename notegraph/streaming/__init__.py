"""Notes as a stream: new texts are parsed, filtered and counted as they arrive."""
