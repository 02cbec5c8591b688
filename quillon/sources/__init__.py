"""Reading corpora from folders, and writing feature rows."""
