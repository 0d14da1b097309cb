"""Reading and writing annotation files."""
