"""Column functions and their plain-Python counterparts."""
