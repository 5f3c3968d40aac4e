"""Types, schema language and scalar expressions."""
