"""The engine's inputs are static graphs: it has no streaming operators."""
