"""Column functions with the semantics of an analytical SQL database."""
