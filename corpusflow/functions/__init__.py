"""Column functions. Everything is a built-in expression except the HTML, chunk and embedding helpers."""
