"""Column and DataFrame operators over typed records."""
