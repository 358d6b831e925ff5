"""Reading captured pages, listings and records, and writing what the jobs make."""
