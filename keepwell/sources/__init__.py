"""Reading and writing the tables and side datasets."""
