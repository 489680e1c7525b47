"""Generated, local, file and stored datasets."""
