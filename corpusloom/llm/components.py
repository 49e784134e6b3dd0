"""Connected components of an edge table, as the training-data operators name them."""

from corpusloom.operators.components import MAX_ROUNDS, connected_components

__all__ = ["MAX_ROUNDS", "connected_components"]
