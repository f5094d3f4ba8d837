"""Files that keep arriving, into tables of a database."""
