"""Column functions and Arrow functions over text, names, notes and HTML."""
