"""Following a store's change log as a stream."""
