"""Column functions; nothing in this layer triggers a job."""
