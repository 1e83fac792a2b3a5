"""Reading and writing the lake's layers and tables."""
