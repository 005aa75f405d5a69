"""Possession runs and persistence over a stream of frames."""
