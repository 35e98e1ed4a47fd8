"""Reading and writing vector tables."""
