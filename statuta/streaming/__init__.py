"""The daily jobs over streams of landed files; state is kept in tables, not in memory."""
