"""Files and the snapshot store."""
