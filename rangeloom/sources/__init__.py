"""Reading and writing ranges."""
