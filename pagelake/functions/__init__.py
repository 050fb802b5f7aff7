"""Column functions and the page reader."""
