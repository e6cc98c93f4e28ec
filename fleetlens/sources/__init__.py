"""Reading and writing the registry and the logs."""
