"""Built graphs, the queries registered over them, and their SQL."""
